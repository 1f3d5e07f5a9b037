"""Scores of several experiments: metrics by relation and over all, saved ones, comparisons and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..sources import sinks

#: The row of metrics over all relations; metrics shown, with their titles, in order; by which experiments are sorted.
ALL = "__DATASET__"
SHOWN = [("map", "MAP"), ("mmap", "MMAP"), ("mrr", "MRR"), ("mmrr", "MMRR"), ("predicted_mmap", "MMAP+"), ("predicted_mmrr", "MMRR+")]
SORTED = ["-map", "-mrr"]
SIGNIFICANT = 0.05


def predictions(lines: DataFrame) -> DataFrame:
    """(source, target, score, in_training) of score lines (value): source, target, score and, if there is one, a mark, with tabs
    between; lines with fewer fields are left out."""
    c = F.split("value", "\t")
    x = lines.select(c.alias("c")).where(F.size("c") >= 3)
    return x.select(F.col("c")[0].alias("source"), F.col("c")[1].alias("target"), F.col("c")[2].cast("double").alias("score"), F.coalesce(F.get("c", F.lit(3)).contains("^"), F.lit(False)).alias("in_training"))


def positives(lines: DataFrame) -> DataFrame:
    """(source, target) of test lines: those of two fields, or labelled 1."""
    c = F.split("value", "\t")
    x = lines.select(c.alias("c")).where((F.size("c") == 2) | (F.get("c", F.lit(2)) == "1"))
    return x.select(F.col("c")[0].alias("source"), F.col("c")[1].alias("target")).distinct()


def metrics(scores: DataFrame, tests: DataFrame) -> DataFrame:
    """(relation, metric, value) of one experiment's scores (relation, source, target, score, in_training) against the positives of its
    tests (relation, source, target), with a row for all relations."""
    known = tests.select("relation", "source", "target").distinct()
    hit = known.withColumn("correct", F.lit(True))
    p = scores.drop("correct").join(hit, ["relation", "source", "target"], "left").withColumn("correct", F.coalesce("correct", F.lit(False)))
    per = scoring.per_relation(scoring.kept(p), known)
    long = lambda df, key: df.unpivot([key], [c for c in df.columns if c != key], "metric", "value")
    return long(per, "relation").unionAll(long(scoring.over_relations(per).withColumn("relation", F.lit(ALL)), "relation"))


def merged(fresh: DataFrame, saved: DataFrame) -> DataFrame:
    """(experiment, relation, metric, value): fresh values, and saved ones that have none."""
    keys = ["experiment", "relation", "metric"]
    return fresh.unionByName(saved.join(fresh, keys, "left_anti").select(*keys, "value"))


def significance(all_metrics: DataFrame, metric: str = "ap") -> DataFrame:
    """(first, second, p): the paired test of each two experiments over the relations that both have; -1 without any. Experiments and
    relations are a vocabulary."""
    x = all_metrics.where((F.col("metric") == metric) & (F.col("relation") != ALL)).select("experiment", "relation", "value")
    names = [r[0] for r in all_metrics.select("experiment").distinct().orderBy("experiment").collect()]
    rows = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            one, two = (x.where(F.col("experiment") == n).select("relation", F.col("value").alias(v)) for n, v in ((a, "a"), (b, "b")))
            rows.append((a, b, float(scoring.permutation_test(one.join(two, "relation").select("relation", (F.col("a") - F.col("b")).alias("d"))))))
    return all_metrics.sparkSession.createDataFrame(rows, "first string, second string, p double")


def by_relation(all_metrics: DataFrame, metric: str = "ap") -> DataFrame:
    """A row for each relation and a column for each experiment."""
    x = all_metrics.where((F.col("metric") == metric) & (F.col("relation") != ALL))
    names = [r[0] for r in all_metrics.select("experiment").distinct().orderBy("experiment").collect()]
    return x.groupBy("relation").pivot("experiment", names).agg(F.first("value")).orderBy("relation")


def order(all_metrics: DataFrame, keys: list[str] = SORTED) -> list[str]:
    """Experiments by these metrics over all relations (- for the largest first); those without one come last, ties by name."""
    rows = {}
    for r in all_metrics.where(F.col("relation") == ALL).collect():
        rows.setdefault(r["experiment"], {})[r["metric"]] = r["value"]
    names = {r[0] for r in all_metrics.select("experiment").distinct().collect()}

    def place(name: str) -> tuple:
        got = rows.get(name, {})
        out = []
        for k in keys:
            down, k = k.startswith("-"), k.lstrip("-")
            out.append((-got[k] if down else got[k]) if k in got else (1.0 if down else -1.0))
        return (*out, name)

    return sorted(names, key=place)


def report(all_metrics: DataFrame, shown: list[tuple[str, str]] = SHOWN, tests: tuple[str, ...] = ("ap",), relations: tuple[str, ...] = ("ap",), colour: bool = False) -> str:
    """The tables as text: metrics over all relations, p values of each two experiments (below the threshold marked with *, or green), and
    metrics by relation."""
    names = order(all_metrics)
    value = {(r["experiment"], r["relation"], r["metric"]): r["value"] for r in all_metrics.collect()}  # experiments x relations
    out = ["Experiment".ljust(45) + "".join(t.rjust(15) for _, t in shown)]
    for i, n in enumerate(names, 1):
        cells = [f"{value[n, ALL, m]:15.4f}" if (n, ALL, m) in value else "No value".rjust(15) for m, _ in shown]
        out.append(f"({i:2d}) {n:<40}" + "".join(cells))
    for metric in tests:
        p = {(r[0], r[1]): r[2] for r in significance(all_metrics, metric).collect()}
        out += ["", f"Significance tests for metric {metric}", "    " + "".join(f"{i:>9d}" for i in range(1, len(names) + 1))]
        for i, a in enumerate(names):
            line = f"{i + 1:2d}  "
            for j, b in enumerate(names):
                if j <= i:
                    line += " " * 9
                    continue
                x = p.get((a, b), p.get((b, a), -1.0))
                text, low = f"{x:8.5f}", 0 <= x < SIGNIFICANT
                line += (f"\033[32m{text}\033[0m " if colour else text + "*") if low else text + " "
            out.append(line)
    for metric in relations:
        rows = sorted({r for _, r, m in value if m == metric and r != ALL})
        out += ["", f"Per-relation {metric}:", "Relation".ljust(60) + "".join(f"{i:>9d}" for i in range(1, len(names) + 1))]
        out += [f"{r:<60}" + "".join(f"{value[n, r, metric]:9.5f}" if (n, r, metric) in value else " " * 9 for n in names) for r in rows]
    return "\n".join(out) + "\n"


def kept(names: list[str], filters: list[str] = ()) -> list[str]:
    """Names that hold one of the filters; all without any."""
    return [n for n in names if not filters or any(f in n for f in filters)]


def score(experiments: dict[str, tuple[DataFrame, DataFrame]], saved: DataFrame | None = None, filters: list[str] = ()) -> DataFrame:
    """(experiment, relation, metric, value) of experiments (name: scores and tests), put before what was saved."""
    names = kept(sorted(experiments), filters)
    if not names:
        raise ValueError("no experiments to score")
    fresh = reduce(DataFrame.unionByName, [metrics(*experiments[n]).select(F.lit(n).alias("experiment"), "relation", "metric", "value") for n in names])
    return fresh if saved is None else merged(fresh, saved)


def main(spark: SparkSession, results: dict[str, tuple[DataFrame, DataFrame]], folder: str, filters: list[str] = (), saved: str | None = None) -> str:
    """Scores experiments, writes all metrics to a new folder, and returns the tables."""
    got = score(results, sinks.read_metrics(spark, saved) if saved else None, filters)
    sinks.write_metrics(got, folder)
    return report(sinks.read_metrics(spark, folder))
