"""Metadata of a knowledge base out of its dump and its schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import segment

#: Fixed value: the relation whose objects are categories.
TYPE = "/type/object/type"


def schema(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inverses, domains and ranges (a, b) of the lines (value) of a schema: `inverse a b` and `argtypes relation domain range`, with
    tabs between; other lines are left out."""
    c = lines.select(F.split("value", "\t").alias("c"))
    args = c.where((F.col("c")[0] == "argtypes") & (F.size("c") >= 4))
    inverses = c.where((F.col("c")[0] == "inverse") & (F.size("c") >= 3)).select(F.col("c")[1].alias("a"), F.col("c")[2].alias("b"))
    pick = lambda i: args.select(F.col("c")[1].alias("a"), F.col("c")[i].alias("b"))
    return inverses, pick(2), pick(3)


def categories(triples: DataFrame) -> DataFrame:
    """Members (a: category, b: node) by the edges of the type relation."""
    return triples.where(F.col("r") == TYPE).select(F.col("t").alias("a"), F.col("s").alias("b"))


def relations(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("r") != TYPE)


def write(triples: DataFrame, schema_lines: DataFrame, folder: str) -> None:
    """A metadata folder: members by category, instances by relation, all edges as subject, object and relation, and the schema's
    tables. Each file is one pass over the triples, dealt by its folder."""
    tab = lambda *c: F.concat_ws("\t", *c)
    x = categories(triples).select(segment(F.col("a")).alias("category"), F.col("b").alias("value"))
    x.repartition("category", F.pmod(F.xxhash64("value"), F.lit(32))).write.partitionBy("category").text(f"{folder}/category_instances")
    y = relations(triples).select(segment(F.col("r")).alias("relation"), tab("s", "t").alias("value"))
    y.repartition("relation", F.pmod(F.xxhash64("value"), F.lit(32))).write.partitionBy("relation").text(f"{folder}/relations")
    triples.select(tab("s", "t", "r").alias("value")).write.text(f"{folder}/labeled_edges.tsv")
    for name, table in zip(("inverses", "domains", "ranges"), schema(schema_lines)):
        table.select(tab("a", "b").alias("value")).write.text(f"{folder}/{name}.tsv")


def read_members(spark: SparkSession, folder: str) -> DataFrame:
    """(a, b) of a metadata folder's categories; a names a part of a path."""
    return spark.read.schema("value string, category string").text(f"{folder}/category_instances").select(F.col("category").alias("a"), F.col("value").alias("b"))


def read_instances(spark: SparkSession, folder: str) -> DataFrame:
    """(relation, source, target, label): a third column other than 1 is a negative; none is a positive."""
    c = F.split("value", "\t")
    x = spark.read.schema("value string, relation string").text(f"{folder}/relations").select("relation", c.alias("c"))
    label = F.when(F.coalesce(F.get("c", F.lit(2)).cast("int"), F.lit(1)) == 1, 1).otherwise(-1)
    return x.select("relation", F.col("c")[0].alias("source"), F.col("c")[1].alias("target"), label.alias("label"))
