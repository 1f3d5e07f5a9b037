"""Readers: relation triples, aliases, cluster maps, edge files, dictionaries, datasets, and the graph over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples (s, r, t) of the order, customer and part tables; names carry their kind."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = [
        ("customer", "c", "c_custkey", "in_nation", "n", "c_nationkey"),
        ("supplier", "s", "s_suppkey", "supp_nation", "n", "s_nationkey"),
        ("nation", "n", "n_nationkey", "in_region", "r", "n_regionkey"),
        ("orders", "o", "o_orderkey", "placed_by", "c", "o_custkey"),
        ("lineitem", "o", "l_orderkey", "has_part", "p", "l_partkey"),
        ("lineitem", "o", "l_orderkey", "from_supp", "s", "l_suppkey"),
        ("part", "p", "p_partkey", "brand", "b", "p_brand"),
    ]
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    return reduce(DataFrame.unionAll, [t(tab).select(name(a, x).alias("s"), F.lit(r).alias("r"), name(b, y).alias("t")) for tab, a, x, r, b, y in parts])


def _columns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t").alias("c"))


def kb_triples(spark: SparkSession, path: str) -> DataFrame:
    """subject, object, relation."""
    return _columns(spark, path).where(F.size("c") >= 3).select(F.col("c")[0].alias("s"), F.col("c")[2].alias("r"), F.col("c")[1].alias("t"))


def surface_triples(spark: SparkSession, path: str) -> DataFrame:
    """subject, verb, object; further columns are ignored."""
    return _columns(spark, path).where(F.size("c") >= 3).select(F.col("c")[0].alias("s"), F.col("c")[1].alias("r"), F.col("c")[2].alias("t"))


def aliases(spark: SparkSession, path: str | None, kind: str = "nell") -> DataFrame:
    """(phrase, concept). nell: a concept, then phrases. freebase: rows of exactly four columns; first and last. Other kinds raise."""
    if kind not in ("nell", "freebase"):
        raise ValueError(f"unknown alias format: {kind}")
    if path is None:
        return spark.createDataFrame([], "phrase string, concept string")
    c = _columns(spark, path)
    if kind == "freebase":
        return c.where(F.size("c") == 4).select(F.col("c")[3].alias("phrase"), F.col("c")[0].alias("concept"))
    return c.select(F.explode(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0)))).alias("phrase"), F.col("c")[0].alias("concept"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(r, clusters): the first column, and the others."""
    return _columns(spark, path).select(F.col("c")[0].alias("r"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("clusters"))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return _columns(spark, path).select(F.col("c")[0].alias("r"), F.transform(F.slice("c", 2, F.size("c")), lambda x: x.cast("double")).alias("v"))


def similarities(spark: SparkSession, path: str) -> DataFrame:
    """(r1, r2, weight) with the diagonal; repeated pairs are summed."""
    m = _columns(spark, path).select(F.col("c")[0].alias("r1"), F.col("c")[1].alias("r2"), F.col("c")[2].cast("double").alias("weight"))
    own = m.select(F.col("r1").alias("r")).union(m.select("r2")).distinct().selectExpr("r r1", "r r2", "1.0D weight")
    return m.unionAll(own).groupBy("r1", "r2").agg(F.sum("weight").alias("weight"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Edge file of ids: source, target, relation, as tab-separated text; packed big-endian integers if the name ends in .dat."""
    if path.endswith(".dat"):
        whole = spark.read.format("binaryFile").load(path).select(F.hex("content").alias("h"))
        rows = whole.select(F.explode(F.regexp_extract_all("h", F.lit("(.{24})"), F.lit(1))).alias("x"))
        word = lambda i: F.conv(F.substring("x", 8 * i + 1, 8), 16, 10).cast("long")
        at = lambda i: F.when(word(i) >= 1 << 31, word(i) - (1 << 32)).otherwise(word(i)).cast("int")
        return rows.select(at(0).alias("s"), at(1).alias("t"), at(2).alias("r"))
    return spark.read.csv(path, sep="\t", schema="s int, t int, r int")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="id int, name string")


def parse_graph(graph: Column) -> Column:
    """Private graph of an instance: edges parted by ' ### ', fields by '^,^'."""
    return F.transform(F.split(graph, " ### "), lambda e: F.struct(F.split(e, r"\^,\^")[0].alias("s"), F.split(e, r"\^,\^")[1].alias("r"), F.split(e, r"\^,\^")[2].alias("t")))


def dataset(spark: SparkSession, path: str, nodes: bool = False, graphs: bool = False, shared: DataFrame | None = None) -> DataFrame:
    """Instances (source[, target], label 1 or -1[, graph]). A missing label is positive; one that is no integer raises."""
    if graphs and shared is not None:
        raise ValueError("a dataset with graphs of its own can't be used with a shared graph")
    c = _columns(spark, path)
    n = 1 if nodes else 2
    label = F.when(F.coalesce(F.try_element_at("c", F.lit(n + 1)).cast("int"), F.lit(1)) == 1, 1).otherwise(-1)
    out = [F.col("c")[0].alias("source"), *([] if nodes else [F.col("c")[1].alias("target")]), label.alias("label")]
    return c.select(*out, *([parse_graph(F.col("c")[n + 1]).alias("graph")] if graphs else []))


def metadata(spark: SparkSession, path: str, symmetric: bool = False) -> DataFrame:
    """Pairs (a, b): inverses (symmetric), domains, ranges, category members."""
    p = spark.read.csv(path, sep="\t", schema="a string, b string")
    return p.union(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct() if symmetric else p


def weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="feature string, weight double").where("weight <> 0")
