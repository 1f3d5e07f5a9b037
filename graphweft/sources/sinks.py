"""Writers of graphs, dictionaries, matrices, splits, scores, paths, vectors and metrics, in forms that the readers take back.

A folder that exists is never written over. Text parts are named by Spark; a folder counts as done when it has _SUCCESS."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph

#: From so many edges on, so many shards; two below the first.
SHARDS = [(5_000_000, 3), (10_000_000, 4), (40_000_000, 5), (100_000_000, 6), (150_000_000, 7), (250_000_000, 8), (350_000_000, 9), (500_000_000, 10)]


def _lines(df: DataFrame, *columns: str | Column) -> DataFrame:
    return df.select(F.concat_ws("\t", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]).alias("value"))


def shards(edges: int) -> int:
    return max([2, *(n for least, n in SHARDS if edges >= least)])


def with_ids(e: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges (s, t, r) by the ids of two dictionaries (id, name)."""
    n = lambda c: nodes.select(F.col("name").alias(c), F.col("id").cast("int").alias(f"{c}_id"))
    r = relations.select(F.col("name").alias("r"), F.col("id").cast("int").alias("r_id"))
    return e.join(r, "r").join(n("s"), "s").join(n("t"), "t").select(F.col("s_id").alias("s"), F.col("t_id").alias("t"), F.col("r_id").alias("r"))


def write_edges(ids: DataFrame, folder: str, binary: bool = False, text: bool = True, sharded: bool = False) -> None:
    """Edges of ids (s, t, r): tab-separated text below edges.tsv, dealt by source into shards by their number if wanted; packed
    big-endian integers, three an edge, as one row of bytes a part below edges.dat."""
    if text:
        n = shards(ids.count()) if sharded else 0
        _lines(ids.repartition(n, "s") if n else ids, "s", "t", "r").write.text(f"{folder}/edges.tsv")
    if binary:
        word = lambda c: F.unhex(F.lpad(F.hex(F.when(F.col(c) < 0, F.col(c).cast("long") + (1 << 32)).otherwise(F.col(c).cast("long"))), 8, "0"))
        ids.select(F.concat(word("s"), word("t"), word("r")).alias("edge")).write.parquet(f"{folder}/edges.dat")


def signed(hexadecimal: Column) -> Column:
    """A 32-bit integer of eight hexadecimal digits."""
    x = F.conv(hexadecimal, 16, 10).cast("long")
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")


def read_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of ids (s, t, r) of such a folder: packed ones if there are any, else text."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/edges.dat")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        at = lambda i: signed(F.hex(F.substring("edge", 4 * i + 1, 4)))
        return spark.read.parquet(f"{folder}/edges.dat").select(at(0).alias("s"), at(1).alias("t"), at(2).alias("r"))
    return spark.read.csv(f"{folder}/edges.tsv", sep="\t", schema="s int, t int, r int")


def write_dictionary(names: DataFrame, folder: str) -> None:
    """id and name, in the order of ids."""
    _lines(names.repartitionByRange("id").sortWithinPartitions("id"), "id", "name").write.text(folder)


def write_graph(e: DataFrame, folder: str, binary: bool = False, text: bool = True, sharded: bool = False, matrices: int = 0, deduplicate: bool = False) -> None:
    """A graph (s, r, t) by ids of first appearance, with its dictionaries and, for a largest number of entries, its matrix files."""
    e = e.dropDuplicates(["s", "r", "t"]) if deduplicate else e
    nodes = graph.dictionary(e, ["s", "r", "t"])
    relations = e.select(F.col("r").alias("name")).distinct().orderBy("name")
    named = relations.collect()  # a vocabulary
    relations = e.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(named, 1)], "id long, name string")
    write_dictionary(nodes, f"{folder}/node_dict.tsv")
    write_dictionary(relations, f"{folder}/edge_dict.tsv")
    ids = with_ids(e, nodes, relations)
    write_edges(ids, folder, binary, text, sharded)
    if matrices:
        by = ids.select(F.col("s").cast("string").alias("s"), F.col("r").cast("string").alias("r"), F.col("t").cast("string").alias("t"))
        numbers = relations.select("id", F.col("id").cast("string").alias("name"))
        write_matrices(graph.matrix_files(by, numbers, matrices), f"{folder}/matrices")


def write_matrices(entries: DataFrame, folder: str) -> None:
    """Entries (file, r, s, t and, for dense ones, value) below a folder for each file, relations after one another."""
    columns = ["r", "s", "t", *(["value"] if "value" in entries.columns else [])]
    x = entries.select("file", *columns).repartitionByRange("file", "r", "s", "t").sortWithinPartitions("file", "r", "s", "t")
    x.select("file", F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value")).write.partitionBy("file").text(folder)


def read_matrices(spark: SparkSession, folder: str) -> DataFrame:
    c = F.split("value", "\t")
    x = spark.read.text(folder).select(F.col("file").cast("string").alias("file"), c.alias("c"))
    return x.select("file", F.col("c")[0].alias("r"), F.col("c")[1].alias("s"), F.col("c")[2].alias("t"), F.get("c", F.lit(3)).cast("double").alias("value"))


def segment(relation: Column) -> Column:
    """A relation's name as part of a path."""
    return F.translate(relation, "/", "_")


def instance_lines(inst: DataFrame) -> DataFrame:
    """value: source, target (of pairs) and label, and the private graph if there is one."""
    ends = [c for c in ("source", "target") if c in inst.columns]
    graph_text = [F.array_join(F.transform("graph", lambda e: F.concat_ws("^,^", e["s"], e["r"], e["t"])), " ### ")] if "graph" in inst.columns else []
    return _lines(inst, *ends, F.when(F.col("label") > 0, 1).otherwise(-1), *graph_text)


def write_split(split: DataFrame, folder: str, params: dict | None = None) -> None:
    """A split (relation, fold, source, target, label): its relations, and a folder for each relation and fold."""
    spark = split.sparkSession
    names = split.select("relation").distinct().orderBy("relation")
    names.coalesce(1).select(F.col("relation").alias("value")).write.text(f"{folder}/relations_to_run.tsv")  # a vocabulary
    lines = F.concat_ws("\t", "source", "target", F.when(F.col("label") > 0, "1").otherwise("-1"))
    x = split.select(segment(F.col("relation")).alias("relation"), "fold", lines.alias("value"))
    x.repartitionByRange("relation", "fold", "value").write.partitionBy("relation", "fold").text(f"{folder}/instances")
    if params is not None:
        spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/params.json")


def split_folder(spec: object, base: str) -> str:
    """Where a split is: an absolute path, a name below splits, or an object with such a name."""
    name = spec.get("name") if isinstance(spec, dict) else spec
    if not isinstance(name, str) or not name:
        raise ValueError(f"no name of a split: {spec!r}")
    return name.rstrip("/") if "://" in name or name.startswith("/") else f"{base.rstrip('/')}/splits/{name}"


def read_split(spark: SparkSession, spec: object, base: str = "") -> DataFrame:
    """(relation, fold, source, target, label) of a written split, with its relations' own names."""
    folder = split_folder(spec, base)
    names = spark.read.text(f"{folder}/relations_to_run.tsv").where("value <> ''").select(F.col("value").alias("name"))
    c = F.split("value", "\t")
    x = spark.read.schema("value string, relation string, fold string").text(f"{folder}/instances").select("relation", "fold", c.alias("c"))
    label = F.when(F.coalesce(F.get("c", F.lit(2)).cast("int"), F.lit(1)) == 1, 1).otherwise(-1)
    x = x.select("relation", "fold", F.col("c")[0].alias("source"), F.col("c")[1].alias("target"), label.alias("label"))
    return x.join(F.broadcast(names.withColumn("relation", segment(F.col("name")))), "relation").select(F.col("name").alias("relation"), "fold", "source", "target", "label")


def named(df: DataFrame, columns: list[str], names: DataFrame | None) -> DataFrame:
    """Nodes by their display names (n, name) where they have one."""
    for c in columns if names is not None else []:
        of = names.select(F.col("n").alias(c), F.col("name").alias("shown__"))
        df = df.join(of, c, "left").withColumn(c, F.coalesce("shown__", c)).drop("shown__").select(*df.columns)
    return df


def _ranked_text(df: DataFrame, score: str, name: list[str], folder: str) -> None:
    order = [F.desc(score), *name]
    _lines(df.repartitionByRange(*order).sortWithinPartitions(*order), *name, score).write.text(folder)


def write_node_scores(scores: DataFrame, folder: str, names: DataFrame | None = None) -> None:
    """Nodes and scores, best first."""
    _ranked_text(named(scores.select("source", "score"), ["source"], names), "score", ["source"], folder)


def write_path_counts(counts: DataFrame, folder: str) -> None:
    """Paths and their counts, commonest first."""
    _ranked_text(counts.select("path", "n_pairs"), "n_pairs", ["path"], folder)


def write_instance_paths(counts: DataFrame, folder: str) -> None:
    """Source, target, path and count of each pair's paths."""
    keys = ["source", "target", F.desc("visits"), "path"]
    _lines(counts.repartitionByRange(*keys).sortWithinPartitions(*keys), "source", "target", "path", "visits").write.text(folder)


def write_paths(chosen: DataFrame, folder: str) -> None:
    """Selected paths, a line each, in the order of their names."""
    _lines(chosen.select("path").distinct().repartitionByRange("path").sortWithinPartitions("path"), "path").write.text(folder)


def write_vectors(vectors: DataFrame, folder: str) -> None:
    """A relation (r) and its components (v) a line."""
    _lines(vectors, "r", F.array_join(F.transform("v", lambda x: x.cast("string")), "\t")).write.text(folder)


def write_similarities(pairs: DataFrame, folder: str) -> None:
    _lines(pairs, "r1", "r2", "weight").write.text(folder)


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """Experiment, relation, metric and value, a line each."""
    keys = ["experiment", "relation", "metric"]
    _lines(metrics.repartitionByRange(*keys).sortWithinPartitions(*keys), *keys, "value").write.text(folder)


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.csv(folder, sep="\t", schema="experiment string, relation string, metric string, value double")


def write_generated(edges: DataFrame, instances: DataFrame, rules: DataFrame, folder: str) -> None:
    """What the generator made: triples (subject, relation, object), a split, and the rules as relation, sign, probability and body."""
    _lines(edges, "s", "r", "t").write.text(f"{folder}/triples.tsv")
    write_split(instances, f"{folder}/split")
    body = F.array_join(F.transform("body", lambda x: x.cast("string")), ",")
    _lines(rules, "relation", F.when(F.col("positive"), "+").otherwise("-"), "p", body).write.text(f"{folder}/rules.tsv")


def same_params(spark: SparkSession, folder: str, params: dict, ignore: list[str] = ()) -> bool:
    """Whether a folder was made with these parameters (but for those to ignore); False if there is none. Others raise, and so does a
    folder that isn't finished: it has no _SUCCESS."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = fs.Path(folder)
    at = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not at.exists(path):
        return False
    if not at.exists(fs.Path(f"{folder}/params.json/_SUCCESS")):
        raise ValueError(f"{folder} is not finished")
    old = json.loads("\n".join(r[0] for r in spark.read.text(f"{folder}/params.json").collect()))
    keep = lambda x: {k: v for k, v in x.items() if k not in ignore}
    if keep(old) != keep(params):
        raise ValueError(f"{folder} was made with other parameters")
    return True


def write_params(spark: SparkSession, folder: str, params: dict) -> None:
    """Written last, so that it marks a folder as finished."""
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.text(f"{folder}/params.json")
