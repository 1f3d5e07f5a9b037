"""Candidates of test pairs by page rank, scored by a linear model and ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as extractors
from . import models, paths, walks
from ..functions.tables import stored


def candidates(tests: DataFrame, training: DataFrame, adj: DataFrame, most: int = 10, steps: int = 3, sources: DataFrame | None = None, targets: DataFrame | None = None, held_ranks: DataFrame | None = None) -> DataFrame:
    """(source, target) that pair the known end of a test pair with the most nodes that its walks visit most (ties by
    name), from both ends. Training pairs are no candidates. sources and targets: only these nodes stand on that side."""
    known = training.select("source", "target").distinct()
    out = None
    for own, other, fits in (("source", "target", targets), ("target", "source", sources)):
        starts = tests.where(F.col(own).isNotNull()).select(F.col(own).alias("n")).distinct()
        ranks = held_ranks if held_ranks is not None else walks.page_rank(starts, adj, walks=50, steps=steps, allowed=fits)
        pairs = ranks.join(starts.withColumnRenamed("n", "start"), "start", "left_semi").select(F.col("start").alias(own), F.col("node").alias(other), "visits")
        pairs = walks.top(pairs.join(known, ["source", "target"], "left_anti"), own, "visits", other, most).select("source", "target")
        out = pairs if out is None else out.unionByName(pairs)
    return out.distinct()


def ranked(tests: DataFrame, training: DataFrame, adj: DataFrame, weights: DataFrame, extract=extractors.one_sided, steps: int = 2, held_out: list[str] | None = None, **options) -> DataFrame:
    """(source, target, score) of the candidates, best first; one without a feature scores 0. weights: (feature, weight)."""
    got = candidates(tests, training, adj, **options)
    inst = stored(got.select(F.xxhash64("source", "target").alias("iid"), "source", "target"), "candidates")
    f = extract(paths.pair_subgraph(inst, adj, steps, held_out), inst)
    x = f.select(F.lit("").alias("relation"), "iid", "feature", F.lit(1.0).alias("value"))
    s = models.scores(x, weights.select(F.lit("").alias("relation"), "feature", "weight"))
    return inst.join(s, "iid", "left").select("source", "target", F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "source", "target")
