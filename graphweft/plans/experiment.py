"""Experiments: graph, split and operation of a specification as one plan a relation, and what they write."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import bucketed, forget, stored
from ..operators import features as fx
from ..operators import graph as g
from ..operators import models, paths, walks
from ..sources import synthetic, triples
from ..sources.specs import known_keys

#: Keys of a generated relation set, in the order of the fields that they set.
GENERATED = {
    "num_entities": "entities", "num_base_relations": "bases", "num_pra_relations": "targets", "num_pra_relation_training_instances": "training",
    "num_pra_relation_testing_instances": "testing", "num_rules": "rules", "min_rule_length": "shortest", "max_rule_length": "longest",
    "rule_prob_mean": "chance", "rule_prob_stddev": "spread", "num_base_relation_training_duplicates": "training_names",
    "num_base_relation_testing_duplicates": "testing_names", "num_base_relation_overlapping_instances": "overlapping",
    "num_base_relation_noise_instances": "base_noise", "num_noise_relations": "noise_relations", "num_noise_relation_instances": "noise",
    "num_negatives_per_positive": "negatives",
}


def plan(params: dict, seed: int = 1) -> synthetic.Plan:
    known_keys(params, ["name", *GENERATED], "generation params")
    return synthetic.Plan(seed=seed, **{GENERATED[k]: v for k, v in params.items() if k != "name"})


def graph(spark: SparkSession, spec: dict) -> DataFrame:
    """Edges (s, r, t) of a graph specification."""
    known_keys(spec, ["name", "relation sets", "deduplicate edges", "output binary file", "output plain text file", "shard plain text graph", "output matrices", "max matrix file size"], "graph")
    sets = []
    for x in spec["relation sets"]:
        if x.get("type") == "generated":
            sets.append({"triples": synthetic.generated(spark, plan(x["generation params"]))[0]})
            continue
        known_keys(x, ["type", "relation file", "relation prefix", "is kb", "alias file", "alias relation", "alias file format", "aliases only", "embeddings file", "keep original edges", "replace relations with"], "relation set")
        read = triples.kb_triples if x.get("is kb", True) else triples.surface_triples
        one = {"triples": read(spark, x["relation file"]), "prefix": x.get("relation prefix"), "replace": x.get("replace relations with"), "keep": x.get("keep original edges", False), "aliases_only": x.get("aliases only", False), "alias_relation": x.get("alias relation", g.ALIAS)}
        if x.get("alias file"):
            one["aliases"] = triples.aliases(spark, x["alias file"], x.get("alias file format", "nell"))
        if x.get("embeddings file"):
            one["clusters"] = triples.clusters(spark, x["embeddings file"]).select("r", F.explode("clusters").alias("cluster"))
        sets.append(one)
    return g.build(sets, spec.get("deduplicate edges", False))


@dataclass
class Result:
    """Scores (relation, source, target, label, score, in_training), weights (relation, feature, weight), and the two
    feature tables (relation, iid, source, target, label, feature, value)."""

    scores: DataFrame
    weights: DataFrame
    training: DataFrame
    testing: DataFrame


def _pattern_options(name: object, params: dict) -> dict:
    out = {k: params[k] for k in ("include", "exclude") if k in params}
    return {k: [v] if isinstance(v, str) else v for k, v in out.items()} if name == "PraFeatureExtractorWithFilter" else {}


#: Keys that a feature specification may have, by its type, and those of its parts.
SUBGRAPHS = {"": ["type", "path finder", "feature extractors", "feature size", "include bias"], "path finder": ["type", "number of steps", "max fan out"]}
WALKS = {
    "": ["type", "path finder", "path selector", "path follower"], "path finder": ["type", "walks per source", "path finding iterations", "reset probability", "path accept policy"],
    "path selector": ["name", "number of paths to keep"], "path follower": ["name", "walks per path", "normalize walk probabilities", "matrix accept policy", "matrix accept policy: training", "matrix accept policy: test"],
}
#: Names that the parts may choose, each the only one that an experiment runs.
PARTS = {"subgraphs": {"path finder": ["BfsPathFinder"]}, "pra": {"path finder": ["RandomWalkPathFinder"], "path selector": ["MostFrequentPathTypeSelector"], "path follower": ["random walks"]}}


def checked(spec: dict) -> str:
    """The type of a feature specification, all of whose keys and choices are known; others raise."""
    kind = spec.get("type", "pra")
    if kind not in PARTS:
        raise ValueError(f"unknown feature type: {kind}")
    for part, keys in (SUBGRAPHS if kind == "subgraphs" else WALKS).items():
        known_keys(spec.get(part, {}) if part else spec, keys, part or f"{kind} features")
        name = spec.get(part, {}).get("name", spec.get(part, {}).get("type")) if part else None
        if name is not None and name not in PARTS[kind][part]:
            raise ValueError(f"unknown {part}: {name}")
    for x in spec.get("feature extractors", []):
        if not isinstance(x, str):
            known_keys(x, ["name", "include", "exclude"] if x.get("name") == "PraFeatureExtractorWithFilter" else ["name"], f"extractor {x.get('name')}")
    return kind


def subgraph_features(inst: DataFrame, adj: DataFrame, spec: dict, held_out: list[str], nodes: bool = False) -> DataFrame:
    """(iid, feature, value): what all extractors give, once each; a bias for instances that have a feature, if asked for."""
    finder = spec.get("path finder", {})
    steps = finder.get("number of steps", 2)
    cap = finder.get("max fan out", 100)
    wanted = spec.get("feature extractors", ["PathAndEndNodeFeatureExtractor" if nodes else "PraFeatureExtractor"])
    wanted = [(x, x if isinstance(x, str) else x["name"]) for x in wanted]
    makes = [fx.extractor(name, nodes) for _, name in wanted]
    alone = "OneSidedPathOnlyFeatureExtractor"
    if nodes or not all(name in [alone, *fx.JOINING] for _, name in wanted):
        adj = bucketed(g.capped(adj, cap), "n", "adjacency")
        parts, sub = None, stored(paths.node_subgraph(inst, adj, steps) if nodes else paths.pair_subgraph(inst, adj, steps, held_out), "subgraph")
        forget(adj)
    else:  # no row for each pair and node
        shared, single, met = paths.pair_parts_met(inst, g.searched(adj, cap), steps, held_out, False)
        met = stored(met, "joining")
        parts, sub = (shared, single.unionAll(met)), met.select("iid", "start", "node", paths.labels(F.col("path")).alias("path"))
    out = None
    for (x, name), make in zip(wanted, makes):
        if parts and name == alone:
            f = fx.one_sided_paths(parts, inst)
        else:
            f = make(sub) if nodes else make(sub, inst, **_pattern_options(name, {} if isinstance(x, str) else x))
        out = f if out is None else out.unionAll(f)
    out = out.distinct()
    if spec.get("feature size", -1) > 0:
        out = fx.hashed(out, spec["feature size"])
    if spec.get("include bias", False):
        out = fx.with_bias(out)
    return out.withColumn("value", F.lit(1.0))


def walk_features(training: DataFrame, tests: DataFrame, adj: DataFrame, spec: dict, held_out: list[str], closed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(source, target, feature, value) of both sets: paths that walks on training pairs find most, followed from either set's sources.
    Rows come from the walks."""
    finder, selector, follower = spec.get("path finder", {}), spec.get("path selector", {}), spec.get("path follower", {})
    step = bucketed(adj, "n", "steps", walks.counted)
    accept, options = finder.get("path accept policy", "paired-only"), (finder.get("walks per source", 100), finder.get("path finding iterations", 3), finder.get("reset probability", 0.0), held_out)
    if accept == "paired-only":  # no row for each pair and node
        found = walks.meeting_paths(training, step, *options)
    else:
        found = [walks.found_paths(training, side, adj, *options) for side in ("source", "target")]
    counts = walks.direct_and_paired(*found, training, accept).withColumnRenamed("n_pairs", "visits")
    keep = selector.get("number of paths to keep", 1000)
    chosen = counts.orderBy(F.desc("visits"), paths.encode(F.col("path")))
    chosen = stored((chosen if keep < 0 else chosen.limit(keep)).select("path"), "paths")
    both = training.select("source", "target").unionAll(tests.select("source", "target"))
    every = walks.follow_paths(both.select(F.col("source").alias("n")), step, chosen, follower.get("normalize walk probabilities", True), follower.get("walks per path", 100), closed)
    policies = [follower.get(f"matrix accept policy: {fold}", follower.get("matrix accept policy", "all-targets")) for fold in ("training", "test")]
    if policies[0] == policies[1]:
        every = walks.rows_kept(every, both, policies[0])
    every = stored(every.select("start", "target", paths.encode(F.col("path")).alias("feature"), "p"), "followed")  # of both folds at once
    forget(step)
    out = []
    for inst, policy in zip((training, tests), policies):
        got = every.join(inst.select(F.col("source").alias("start")).distinct(), "start", "left_semi")
        out.append(walks.rows_kept(got, inst, policy).select(F.col("start").alias("source"), "target", "feature", F.col("p").alias("value")))
    return out[0], out[1]


def _features(relation: str, split: DataFrame, edges: DataFrame, spec: dict, held_out: list[str], nodes: bool = False) -> tuple[DataFrame, DataFrame]:
    adj = g.both_ways(edges)
    own = split.where(F.col("relation") == relation).select("fold", "source", "target", "label").distinct()
    inst = stored(own.select(F.xxhash64("fold", "source", "target", "label").alias("iid"), "*"), "instances")
    folds = [inst.where(F.col("fold") == f).drop("fold") for f in ("training", "testing")]
    if checked(spec) == "subgraphs":
        both = stored(subgraph_features(inst.drop("fold"), adj, spec, held_out, nodes).join(inst, "iid"), "features")  # of both folds at once
        out = [both.where(F.col("fold") == f) for f in ("training", "testing")]
    elif nodes:
        raise ValueError("walk features are for pairs of nodes")
    else:
        pairs = inst.select("source", "target").distinct()
        shut = edges.where(F.col("r").isin(held_out)).distinct()
        ends = (F.col("s") == F.col("source")) & (F.col("t") == F.col("target"))
        shut = shut.join(pairs, ends, "left_semi").union(shut.join(pairs.select(F.col("target").alias("source"), F.col("source").alias("target")), ends, "left_semi"))
        rows = walk_features(folds[0], folds[1], adj, spec, held_out, stored(g.both_ways(shut.distinct()), "closed"))
        out = []
        for f, x in zip(rows, folds):
            yes = x.where("label > 0").select("source", "target").distinct().withColumn("label", F.lit(1))
            out.append(f.join(yes, ["source", "target"], "left").select(F.xxhash64("source", "target").alias("iid"), "source", "target", F.coalesce("label", F.lit(-1)).alias("label"), "feature", "value"))
    cols = [F.lit(relation).alias("relation"), "iid", "source", "target", "label", "feature", "value"]
    return out[0].select(*cols), out[1].select(*cols)


def model(spec: dict, features: DataFrame, tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights, and scores of the tests. A kernel machine has support rows and no weights, so its first table is empty."""
    known_keys(spec, ["type", "l1 weight", "l2 weight", "binarize features", "kernel", "log level", "max training examples"], "learning")
    kind, kernel, most = spec.get("type", "LR"), spec.get("kernel", "linear"), spec.get("max training examples")
    kernel = kernel if isinstance(kernel, dict) else {"type": kernel}
    f, tests = ((models.binarised(x) for x in (features, tests)) if spec.get("binarize features") else (features, tests))
    if most is not None:
        order = Window.partitionBy("relation").orderBy(F.xxhash64("iid"), "iid")
        few = f.select("relation", "iid").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
        f = f.join(few.select("relation", "iid"), ["relation", "iid"], "left_semi")
    if kind == "SVM" and kernel["type"] != "linear":
        name, gamma = kernel["type"], kernel.get("gamma", 1.0)
        support = stored(models.kernel_svm(f, name, gamma), "support")
        return f.sparkSession.createDataFrame([], models.WEIGHTS), models.kernel_scores(tests, support, name, gamma)
    if kind not in ("LR", "SVM"):
        raise ValueError(f"unknown model: {kind}")
    w = models.logistic(f, spec.get("l1 weight", 0.0), spec.get("l2 weight", 0.0)) if kind == "LR" else models.linear_svm(f)
    w = stored(w, "weights")
    return w, models.scores(tests, w)


def train_and_test(spark: SparkSession, spec: dict, split: DataFrame, edges: DataFrame | None = None, unallowed: dict[str, list[str]] | None = None) -> Result:
    """The operation of a specification over a split (relation, fold training or testing, source, target, label); without a column
    target its instances are nodes, whose target is empty in all results. Each relation's features are stored before the next's, so
    no plan grows with the relations. unallowed: relations whose edges are held out for a relation, besides itself. Operations: train and test, create
    matrices (no model), sgd train and test (a test row without features scores 0)."""
    known_keys(spec, ["graph", "split", "relation metadata", "operation", "output"], "the specification")
    op = spec.get("operation", {})
    kind = op.get("type", "train and test")
    if kind not in ("train and test", "create matrices", "sgd train and test"):
        raise ValueError(f"unknown operation: {kind}")
    nodes = "target" not in split.columns
    split = split.withColumn("target", F.lit("")) if nodes else split
    edges = stored(graph(spark, spec["graph"]) if edges is None else edges.select("s", "r", "t"), "edges")
    relations = [r[0] for r in split.select("relation").distinct().orderBy("relation").collect()]  # a vocabulary
    made = []
    for r in relations:
        both = _features(r, split, edges, op.get("features", {}), [r, *(unallowed or {}).get(r, [])], nodes)
        made.append([stored(x, n) for x, n in zip(both, ("training", "testing"))])
    training, testing = (reduce(DataFrame.unionByName, x) for x in zip(*made))
    learning = op.get("learning", {})
    if kind == "create matrices":
        w = spark.createDataFrame([], models.WEIGHTS)
        scores = models.scores(testing, w)
    elif kind == "sgd train and test":
        w = models.online(training, learning.get("learning rate a", 1.0), learning.get("learning rate b", 1.0), learning.get("learning rate momentum", 0.5), learning.get("l2 weight", 0.0), learning.get("iterations", 5))
        w = stored(w, "weights")
        scores = models.scores(testing, w)
    else:
        w, scores = model(learning, training, testing)
    rows = testing.select("relation", "iid", "source", "target", "label").distinct()
    scored = rows.join(scores, ["relation", "iid"])
    if kind == "sgd train and test":
        every = split.where("fold = 'testing'").select("relation", "source", "target", "label").distinct()
        silent = every.join(rows, ["relation", "source", "target"], "left_anti").select("relation", "source", "target", "label", F.lit(0.0).alias("score"))
        scored = scored.drop("iid").unionByName(silent)
    known = split.where("fold = 'training'").select("relation", "source", "target").distinct().withColumn("in_training", F.lit(True))
    scored = scored.join(known, ["relation", "source", "target"], "left").withColumn("in_training", F.coalesce("in_training", F.lit(False)))
    return Result(scored.select("relation", "source", "target", "label", "score", "in_training"), w, training, testing)


def score_lines(scores: DataFrame) -> DataFrame:
    """(relation, source, lines): for each source its targets, best first, each with * if it is positive and ^ if a training pair."""
    mark = F.concat(F.when(F.col("label") > 0, "*").otherwise(""), F.when(F.col("in_training"), "^").otherwise(""))
    line = F.struct((-F.col("score")).alias("o"), F.col("target").alias("t"), F.concat_ws("\t", "source", F.when(F.col("target") != "", F.col("target")), F.col("score").cast("string"), mark).alias("x"))
    return scores.groupBy("relation", "source").agg(F.transform(F.sort_array(F.collect_list(line)), lambda z: z["x"]).alias("lines"))


def write(result: Result, folder: str, matrices: bool = False) -> None:
    """scores, weights and, if asked for, matrices below a folder, partitioned by relation. An existing folder raises."""
    text = score_lines(result.scores).select("relation", F.concat(F.array_join("lines", "\n"), F.lit("\n")).alias("value"))
    text.repartitionByRange("relation", "value").sortWithinPartitions("relation", "value").write.partitionBy("relation").text(f"{folder}/scores")
    w = result.weights.select("relation", F.concat_ws("\t", "feature", F.col("weight").cast("string")).alias("value"), "weight", "feature")
    w.repartitionByRange("relation", F.desc("weight"), "feature").sortWithinPartitions("relation", F.desc("weight"), "feature").select("relation", "value").write.partitionBy("relation").text(f"{folder}/weights")
    if matrices:
        for name, f in (("training", result.training), ("testing", result.testing)):
            row = F.array_join(F.sort_array(F.collect_list(F.concat("feature", F.lit(","), F.col("value").cast("string")))), " -#- ")
            lines = f.groupBy("relation", "source", "target", "label").agg(row.alias("row"))
            lines.select("relation", F.concat_ws("\t", "source", "target", F.col("label").cast("string"), "row").alias("value")).write.partitionBy("relation").text(f"{folder}/{name}_matrix")


def read_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(relation, source, target, score, correct, in_training) of written scores."""
    x = spark.read.text(f"{folder}/scores").where("value <> ''").withColumn("c", F.split("value", "\t"))
    return x.select("relation", F.col("c")[0].alias("source"), F.col("c")[1].alias("target"), F.col("c")[2].cast("double").alias("score"), F.col("c")[3].contains("*").alias("correct"), F.col("c")[3].contains("^").alias("in_training"))
