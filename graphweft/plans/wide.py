"""Further queries: splits and predictions, lexicalised paths, lookups, what writers give back to readers, comparisons of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import folder, stored
from ..operators import datasets, graph, lexicalised, models, paths, walks
from ..sources import ingest, sinks
from ..sources.triples import kg
from . import experiment, scorer
from .catalogue import _scored, _sims, ends, instances, near
from .more import _nations, _node, _regions, _table


def _fresh(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{folder(spark)}/graphweft/{name}-{uuid.uuid4().hex}"


def _metadata(s, d):
    """Customers of each nation as instances of two relations."""
    x = instances(s, d).where("label = 1")
    return x.select(F.lit("in/nation").alias("relation"), "source", "target", "label").unionAll(_regions(s, d).select(F.lit("in_region"), "source", "target", "label"))


def _split(s, d):
    return datasets.split_from_metadata(_metadata(s, d), kg(s, d), ["in/nation", "in_region"], 0.7)


def _split_negatives(s, d):
    one = instances(s, d).where("label = 1").select(F.lit("in_nation").alias("relation"), "source", "target", "label")
    split = datasets.prefix_split(one, 0.7, ["source", "target"], ["relation", "label"]).select("relation", "fold", "source", "target", "label")
    cats = ends(s, d, "source").select(F.lit("customer").alias("a"), F.col("n").alias("b")).unionAll(ends(s, d, "target").select(F.lit("nation"), "n"))
    of = lambda v: s.createDataFrame([("in_nation", v)], "a string, b string")
    return datasets.with_negatives(stored(split, "split"), kg(s, d), near(s, d), "test", of("customer"), of("nation"), cats, steps=2)


def _predicted(s, d):
    known = instances(s, d).where("label = 1")
    return datasets.potential_predictions(ends(s, d, "source"), near(s, d), known, _nations(s, d), ratio=3, most=200, steps=3)


def _lexical(s, d):
    """Regions of customers, over nations by name."""
    e = kg(s, d).where("r in ('in_nation', 'in_region', 'supp_nation')")
    return lexicalised.pra_with_nodes(_regions(s, d), graph.capped(graph.both_ways(e), 100), 2, ["placed_by"]).groupBy("feature").agg(F.count("*").alias("n"))


def _colons(s, d):
    n = kg(s, d).where("r = 'in_region'")
    return n.select("s", lexicalised.shown(F.col("s"), "yes").alias("last"), lexicalised.shown(F.concat(F.lit("x:KEEP:"), F.col("t")), "filter").alias("kept"), lexicalised.shown(F.concat(F.lit("x:REMOVE:"), F.col("t")), "filter").alias("removed"))


def _walked(s, d):
    return stored(_regions(s, d), "regions"), stored(graph.both_ways(kg(s, d).where("r in ('in_nation', 'in_region', 'supp_nation')")), "edges")


def _combined(policy):
    def run(s, d):
        out = walks.pair_counts(*_walked(s, d), policy, walks=100, steps=2)
        return out.select(paths.encode(F.col("path")).alias("path"), F.round("n_pairs", 2).alias("n_pairs"))

    return run


def _walk_subgraph(s, d):
    inst, e = _walked(s, d)
    few = stored(walks.alike(inst, e), "alike")
    a, b = (stored(walks.found_paths(few, side, e, walks=100, steps=2), side) for side in ("source", "target"))
    x = walks.local_subgraphs(a, b).join(few.select("iid", "times"), "iid")
    return x.groupBy(paths.encode(F.col("path")).alias("path")).agg(F.sum("times").alias("n"))


def _related_union(s, d):
    starts = _table(s, d, "customer").select(_node("c", "c_custkey").alias("n"))
    return paths.related_any(starts, graph.both_ways(kg(s, d)), ["-in_nation-", "-in_nation-in_region-", "-_placed_by-from_supp-supp_nation-"])


def _edges_back(s, d):
    """The graph written as text with dictionaries, and read back by names."""
    e, at = kg(s, d).where("r in ('in_nation', 'supp_nation', 'in_region')"), _fresh(s, "graph")
    sinks.write_graph(e, at, matrices=1000)
    n = s.read.csv(f"{at}/node_dict.tsv", sep="\t", schema="id int, name string")
    r = s.read.csv(f"{at}/edge_dict.tsv", sep="\t", schema="id int, name string")
    x = sinks.read_edges(s, at)
    for c, names in (("s", n), ("t", n), ("r", r)):
        x = x.join(names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")), c).drop(c)
    return x.select(F.col("s_name").alias("s"), F.col("r_name").alias("r"), F.col("t_name").alias("t"))


def _binary_back(s, d):
    at = _fresh(s, "edges")
    c = _table(s, d, "customer").select(F.col("c_custkey").cast("int").alias("s"), F.col("c_nationkey").cast("int").alias("t"), F.lit(1).alias("r"))
    sinks.write_edges(c, at, binary=True, text=False)
    return sinks.read_edges(s, at)


def _matrices_back(s, d):
    at, e = _fresh(s, "matrices"), kg(s, d)
    names = e.select("r").distinct().orderBy("r").collect()  # a vocabulary
    ids = s.createDataFrame([(i, x[0]) for i, x in enumerate(names, 1)], "id long, name string")
    sinks.write_matrices(graph.matrix_files(e, ids, 20_000), at)
    return sinks.read_matrices(s, at).groupBy("file", "r").agg(F.count("*").alias("entries"))


def _dense_back(s, d):
    at = _fresh(s, "dense")
    x = models.densify(kg(s, d).where("r in ('in_nation', 'in_region')"), _sims(s))
    sinks.write_matrices(x.select(F.col("r").alias("file"), "r", "s", "t", F.round("value", 6).alias("value")), at)
    return sinks.read_matrices(s, at).select("r", "s", "t", "value")


def _split_back(s, d):
    at = _fresh(s, "split")
    sinks.write_split(_split(s, d), at, {"percent training": 0.7})
    return sinks.read_split(s, at)


def _metrics(s, d):
    """Two experiments: the predictions, and those of even quantities alone."""
    p, known = _scored(s, d)
    p = stored(p.withColumn("in_training", F.lit(False)), "predictions")
    few = p.where("pmod(cast(score as long), 2) = 0")
    return scorer.score({"all": (p, known), "even": (few, known)})


def _metrics_back(s, d):
    at = _fresh(s, "metrics")
    sinks.write_metrics(_metrics(s, d).withColumn("value", F.round("value", 6)), at)
    return sinks.read_metrics(s, at).select("experiment", "relation", "metric", F.col("value"))


def _compared(s, d):
    m = stored(_metrics(s, d).withColumn("value", F.round("value", 6)), "metrics")
    return scorer.significance(m).select("first", "second", F.round("p", 6).alias("p"))


def _schema(s, d):
    """Domains by a schema of the nations' regions."""
    n = _table(s, d, "nation")
    lines = n.select(F.concat_ws("\t", F.lit("argtypes"), F.col("n_name"), F.col("n_regionkey").cast("string"), F.lit("range")).alias("value"))
    inverses, domains, ranges = ingest.schema(lines.unionAll(s.createDataFrame([("inverse\ta\tb",), ("other\tc",)], "value string")))
    return inverses.withColumn("kind", F.lit("inverse")).unionAll(domains.withColumn("kind", F.lit("domain"))).unionAll(ranges.withColumn("kind", F.lit("range")))


def _dump_back(s, d):
    """Members by category and instances by relation of a dump, read back from its folder."""
    at = _fresh(s, "metadata")
    e = kg(s, d).where("r in ('in_nation', 'in_region')").withColumn("r", F.when(F.col("r") == "in_region", ingest.TYPE).otherwise(F.col("r")))
    ingest.write(e, s.createDataFrame([("inverse\ta\tb",)], "value string"), at)
    return ingest.read_members(s, at).unionAll(ingest.read_instances(s, at).select("target", "source"))


def _display(s, d):
    names = _table(s, d, "nation").select(_node("n", "n_nationkey").alias("n"), F.col("n_name").alias("name"))
    return sinks.named(instances(s, d).select("iid", "source", "target"), ["source", "target"], names)


NODES = {"operation": {"type": "create matrices", "features": {"type": "subgraphs", "path finder": {"number of steps": 2}, "feature extractors": ["PathOnlyFeatureExtractor"]}}}


def _node_experiment(s, d):
    """Customers of the first five nations against the others, by paths alone."""
    c = _table(s, d, "customer").select(F.lit("early").alias("relation"), _node("c", "c_custkey").alias("source"), F.when(F.col("c_nationkey") < 5, 1).otherwise(-1).alias("label"))
    split = datasets.prefix_split(c, 0.75, ["source"], ["label"])
    got = experiment.train_and_test(s, NODES, split, kg(s, d)).testing
    return got.select("source", "label", "feature", "value")


QUERIES = {
    "experiment_nodes": _node_experiment,
    "split_from_metadata": _split,
    "split_with_negatives": _split_negatives,
    "potential_predictions": _predicted,
    "feat_pra_with_nodes": _lexical,
    "node_names_colons": _colons,
    "walk_counts_paired": _combined("paired-only"),
    "walk_counts_everything": _combined("everything"),
    "walk_subgraphs": _walk_subgraph,
    "related_nodes_union": _related_union,
    "kg_counts": lambda s, d: graph.counts(kg(s, d)),
    "kg_grouped_lists": lambda s, d: graph.grouped(kg(s, d)).select("n", "r", F.array_join("ins", " ").alias("ins"), F.array_join("outs", " ").alias("outs")),
    "kg_node": lambda s, d: graph.node(graph.both_ways(kg(s, d)), "n:3"),
    "kg_without_tests": lambda s, d: graph.without_tests(kg(s, d), _split(s, d).withColumn("relation", F.translate("relation", "/", "_"))),
    "sink_edges": _edges_back,
    "sink_edges_binary": _binary_back,
    "sink_matrices": _matrices_back,
    "sink_dense_matrices": _dense_back,
    "sink_split": _split_back,
    "sink_metrics": _metrics_back,
    "scorer_significance": _compared,
    "ingest_schema": _schema,
    "ingest_dump": _dump_back,
    "display_names": _display,
}
