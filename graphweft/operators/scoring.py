"""Metrics of ranked predictions and paired permutation tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered


def kept(predictions: DataFrame) -> DataFrame:
    """Predictions that count: a target, a score above 0, and not a known training pair."""
    return predictions.where("target is not null and target <> '' and score > 0 and not coalesce(in_training, false)")


def ranked(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Correct predictions with their rank among all of their group and among the correct ones, best first, ties by name. Groups of
    sources are short and sorted in windows; whole relations are not, so their ranks come from ranges of the order."""
    order = [F.desc("score"), "source", "target"]
    if "source" in by:
        w = Window.partitionBy(*by).orderBy(*order)
        out = predictions.withColumn("rank", F.row_number().over(w)).withColumn("hits", F.sum(F.col("correct").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return out.where("correct")
    x = predictions.select(*by, "source", "target", "score", "correct").withColumn("score", -F.col("score"))
    out = numbered(x, ["score", "source", "target"], by, "rank").where("correct")
    return numbered(out, ["rank"], by, "hits")


def average_precision(predictions: DataFrame, positives: DataFrame, by: list[str]) -> DataFrame:
    """(by, ap, rr): precision at each hit over the number of positives; one over the rank of the first hit; 0 without any."""
    r = ranked(predictions, by)
    got = r.groupBy(*by).agg(F.sum(F.col("hits") / F.col("rank")).alias("sum_p"), F.min("rank").alias("first"))
    n = positives.groupBy(*by).agg(F.count("*").alias("n"))
    return n.join(got, by, "left").select(*by, F.coalesce(F.col("sum_p") / F.col("n"), F.lit(0.0)).alias("ap"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def per_relation(predictions: DataFrame, positives: DataFrame) -> DataFrame:
    """AP and RR over a relation's whole list; means over its sources, over those with predictions (-1 if none), and the share of
    sources without predictions."""
    whole = average_precision(predictions, positives, ["relation"])
    each = average_precision(predictions, positives, ["relation", "source"])
    has = predictions.select("relation", "source").distinct().withColumn("has", F.lit(True))
    each = each.join(has, ["relation", "source"], "left")
    q = each.groupBy("relation").agg(F.avg("ap").alias("query_map"), F.avg("rr").alias("query_mrr"), F.coalesce(F.avg(F.when(F.col("has"), F.col("ap"))), F.lit(-1.0)).alias("predicted_map"), F.coalesce(F.avg(F.when(F.col("has"), F.col("rr"))), F.lit(-1.0)).alias("predicted_mrr"), F.avg(F.when(F.col("has"), 0.0).otherwise(1.0)).alias("no_prediction"))
    return whole.join(q, "relation")


def over_relations(m: DataFrame) -> DataFrame:
    real = lambda c: F.coalesce(F.avg(F.when(F.col(c) > -1, F.col(c))), F.lit(-1.0))
    return m.agg(F.avg("ap").alias("map"), F.avg("rr").alias("mrr"), F.avg("query_map").alias("mmap"), F.avg("query_mrr").alias("mmrr"), real("predicted_map").alias("predicted_mmap"), real("predicted_mrr").alias("predicted_mmrr"))


def permutation_test(pairs: DataFrame, exact_below: int = 15, samples: int = 10_000, seed: int = 1) -> float:
    """Two-sided p value of the mean difference d: all sign flips for few pairs, else sampled ones; -1 without pairs."""
    n = pairs.count()
    if not n:
        return -1.0
    spark = pairs.sparkSession
    w = Window.orderBy("relation")
    d = pairs.select("d", (F.row_number().over(w) - 1).alias("i"))
    if n < exact_below:
        flips, sign = spark.range(1 << n), F.when(F.expr("shiftright(id, i) & 1") == 1, -1).otherwise(1)
    else:
        flips, sign = spark.range(samples), F.when(F.pmod(F.xxhash64("id", "i", F.lit(seed)), F.lit(2)) == 1, -1).otherwise(1)
    sums = flips.crossJoin(F.broadcast(d)).groupBy("id").agg(F.abs(F.sum(F.col("d") * sign)).alias("x"))  # one row a relation is broadcast
    real = abs(d.agg(F.sum("d")).first()[0])
    return sums.agg(F.avg(F.when(F.col("x") >= real - 1e-12, 1.0).otherwise(0.0))).first()[0]
