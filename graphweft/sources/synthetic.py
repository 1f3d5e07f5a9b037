"""Synthetic graphs whose target relations follow from rules over base relations. Every draw is a hash of its place and the seed, so
partitioning and repeated tasks change nothing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    entities: int
    bases: int
    targets: int
    training: int
    testing: int
    rules: int
    shortest: int = 1
    longest: int = 3
    chance: float = 0.6
    spread: float = 0.2
    training_names: int = 1
    testing_names: int = 0
    overlapping: int = 0
    base_noise: int = 0
    noise_relations: int = 0
    noise: int = 0
    negatives: int = 1
    seed: int = 1


def names(plan: Plan, base: int, training: bool) -> list[str]:
    """Names of a base relation on one side; without names of their own, test pairs use those of training pairs."""
    if training or not plan.testing_names:
        return [f"base_{base:02d}_training_{k:02d}" for k in range(1, plan.training_names + 1)]
    return [f"base_{base:02d}_testing_{k:02d}" for k in range(1, plan.testing_names + 1)]


def rules(spark: SparkSession, plan: Plan) -> DataFrame:
    """(relation, rule, positive, body, p): bodies of distinct base relations; p is Gaussian, clamped to 0 and 1."""
    rng, out = np.random.default_rng(plan.seed), []
    for t in range(1, plan.targets + 1):
        for k in range(2 * plan.rules):
            length = min(int(rng.integers(plan.shortest, plan.longest + 1)), plan.bases)
            body = [int(x) for x in rng.permutation(plan.bases)[:length] + 1]
            out.append((f"pra_{t:02d}", k, k < plan.rules, body, float(np.clip(rng.normal(plan.chance, plan.spread), 0, 1))))
    return spark.createDataFrame(out, "relation string, rule int, positive boolean, body array<int>, p double")


def _draw(plan: Plan, what: str, *at: Column | str, below: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(what), F.lit(plan.seed), *at), F.lit(below))


def instances(spark: SparkSession, plan: Plan) -> DataFrame:
    """(relation, fold, id, k, source, target, label): k is 0 for the positive pair and counts its negatives, which share its source."""
    per = plan.training + plan.testing
    x = spark.range(plan.targets * per).select((F.floor(F.col("id") / per) + 1).alias("no"), (F.col("id") % per).alias("at"), "id")
    x = x.select(F.format_string("pra_%02d", "no").alias("relation"), F.when(F.col("at") < plan.training, "training").otherwise("testing").alias("fold"), "id", F.explode(F.sequence(F.lit(0), F.lit(plan.negatives))).alias("k"))
    ends = [_draw(plan, "source", "id", below=plan.entities).alias("source"), _draw(plan, "target", "id", "k", below=plan.entities).alias("target")]
    return x.select("relation", "fold", "id", "k", *ends, F.when(F.col("k") == 0, 1).otherwise(-1).alias("label"))


def _named(plan: Plan, base: Column, training: Column, *at: Column | str) -> Column:
    """A concrete name of a base relation, the same choice that names() lists."""
    n = F.when(training, plan.training_names).otherwise(plan.testing_names or plan.training_names)
    side = F.when(training | F.lit(not plan.testing_names), "training").otherwise("testing")
    return F.format_string("base_%02d_%s_%02d", base, side, F.pmod(F.xxhash64(F.lit("name"), F.lit(plan.seed), *at), n) + 1)


def supporting(inst: DataFrame, body: DataFrame, plan: Plan) -> DataFrame:
    """Edges along the bodies of the rules that fire, through random nodes from source to target."""
    x = inst.join(F.broadcast(body), "relation").where(F.col("positive") == (F.col("label") > 0))  # 2 * targets * rules rows
    fires = _draw(plan, "fires", "id", "k", "rule", below=1 << 30) / F.lit(float(1 << 30)) < F.col("p")
    x = x.where(fires).select("*", F.posexplode("body").alias("hop", "base"))
    between = lambda h: _draw(plan, "node", "id", "k", "rule", h, below=plan.entities)
    s = F.when(F.col("hop") == 0, F.col("source")).otherwise(between(F.col("hop")))
    t = F.when(F.col("hop") == F.size("body") - 1, F.col("target")).otherwise(between(F.col("hop") + 1))
    return x.select(s.alias("s"), _named(plan, F.col("base"), F.col("fold") == "training", "id", "k", "rule", "hop").alias("r"), t.alias("t"))


def noise(spark: SparkSession, plan: Plan) -> DataFrame:
    """Pairs under two names of one base relation, edges of noise relations, and stray edges of base relations."""
    pair = [_draw(plan, "s", "what", "id", below=plan.entities).alias("s"), _draw(plan, "t", "what", "id", below=plan.entities).alias("t")]
    none = spark.createDataFrame([], "s long, r string, t long")
    both = [sorted({*names(plan, b, True), *names(plan, b, False)}) for b in range(1, plan.bases + 1)]
    out = none
    if plan.overlapping and both and len(both[0]) > 1:
        x = spark.range(plan.bases * plan.overlapping).select("id", F.lit("overlap").alias("what"), (F.floor(F.col("id") / plan.overlapping)).alias("b"))
        every = F.element_at(F.array(*[F.array(*[F.lit(v) for v in group]) for group in both]), (F.col("b") + 1).cast("int"))
        n = len(both[0])
        first, step = _draw(plan, "first", "id", below=n), _draw(plan, "step", "id", below=n - 1) + 1
        x = x.select(*pair, F.explode(F.array(F.get(every, first.cast("int")), F.get(every, F.pmod(first + step, F.lit(n)).cast("int")))).alias("r"))
        out = out.unionByName(x)
    if plan.noise_relations and plan.noise:
        x = spark.range(plan.noise_relations * plan.noise).select("id", F.lit("noise").alias("what"))
        out = out.unionByName(x.select(*pair, F.format_string("noise_%02d", F.floor(F.col("id") / plan.noise) + 1).alias("r")))
    if plan.bases and plan.base_noise:
        x = spark.range(plan.bases * plan.base_noise).select("id", F.lit("stray").alias("what"))
        side = _draw(plan, "side", "id", below=2) == 1
        out = out.unionByName(x.select(*pair, _named(plan, F.floor(F.col("id") / plan.base_noise) + 1, side, F.lit("stray"), "id").alias("r")))
    return out


def generated(spark: SparkSession, plan: Plan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (s, r, t as text), instances and rules. Training positives are edges too; each pair's edges are distinct."""
    body, inst = rules(spark, plan), instances(spark, plan)
    own = inst.where("fold = 'training' and label > 0").select(F.col("source").alias("s"), F.col("relation").alias("r"), F.col("target").alias("t"))
    e = own.unionByName(supporting(inst, body, plan)).unionByName(noise(spark, plan)).distinct()
    text = lambda c: F.col(c).cast("string").alias(c)
    return e.select(text("s"), "r", text("t")), inst.select("relation", "fold", text("source"), text("target"), "label").distinct(), body
