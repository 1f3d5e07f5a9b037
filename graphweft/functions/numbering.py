"""Positions of rows in an order, without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


def numbered(df: DataFrame, order: list[str | Column], by: list[str] = (), name: str = "pos") -> DataFrame:
    """Each row with its place (from 1) in that order within its group. Rows are dealt by range and stored, so a group of any size
    spreads over partitions; what groups hold in earlier partitions is added from a row for each group and partition.
    The order should be total: rows that tie come in any order."""
    keys = [*by, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stored(placed.select("*", F.spark_partition_id().alias("part__"), F.monotonically_increasing_id().alias("at__")), "numbered")
    runs = placed.groupBy(*by, "part__").agg(F.min("at__").alias("first__"), F.count("*").alias("n__"))
    before = Window.partitionBy(*by).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    runs = runs.withColumn("before__", F.coalesce(F.sum("n__").over(before), F.lit(0)))
    runs = runs.select(*[F.col(c).alias(f"{c}__of") for c in by], F.col("part__").alias("part__of"), "first__", "before__")
    same = F.col("part__") == F.col("part__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__of"))
    out = placed.join(runs, same)
    return out.select(*[F.col(c) for c in df.columns], (F.col("at__") - F.col("first__") + 1 + F.col("before__")).alias(name))
