"""Which vectors take part, and a bounded sample of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that an index is fitted on, at most: those with the smallest hash of vec_id.
FIT_ROWS = 16384


def valid(v: Column) -> Column:
    """Not null nor empty, no null, NaN or infinite component, and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(df: DataFrame) -> DataFrame:
    """Valid rows with a vec_id, of the commonest dimension (ties: the larger)."""
    rows = df.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    top = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("embedding") == F.lit(top["d"] if top else 0))


def usable_like(df: DataFrame, dimension: int) -> DataFrame:
    return df.where(F.col("vec_id").isNotNull() & valid(F.col("embedding")) & (F.size("embedding") == dimension))


def sample(df: DataFrame, columns: list[str], rows: int = FIT_ROWS) -> list:
    return df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select(*columns).collect()


def matrix(column) -> np.ndarray:
    """An Arrow list column as rows of doubles."""
    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
