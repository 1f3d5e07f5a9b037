"""Models of features (relation, iid, label, feature, value) for each relation, and their scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.tables import stored

WEIGHTS = "relation string, feature string, weight double"


def _design(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    iids, i = np.unique(rows["iid"], return_inverse=True)
    names, j = np.unique(rows["feature"].astype(str), return_inverse=True)
    y = np.zeros(len(iids))
    y[i] = (rows["label"].to_numpy() > 0).astype(float)
    return i, j, rows["value"].to_numpy(float), y, len(names)


#: Feature values of a relation that one task may train on; larger relations are trained over the cluster.
TASK_VALUES = 2_000_000


def logistic(features: DataFrame, l1: float = 0.0, l2: float = 1.0, iterations: int = 300, task_values: int = TASK_VALUES) -> DataFrame:
    """Weights that maximise the log likelihood - l2 * sum(w^2) - l1 * sum(|w|) for each relation; the intercept is learned, bears
    no penalty and isn't returned; weights below 1e-8 are 0. Relations of up to task_values values are trained side by side, each
    in a task by accelerated proximal steps; of larger ones one after the other, with gradients summed over the cluster."""
    sizes = features.groupBy("relation").count().where(F.col("count") > task_values).collect()  # a vocabulary
    large = sorted(r["relation"] for r in sizes)
    out = _fitted(features.where(~F.col("relation").isin(large)) if large else features, l1, l2, iterations)
    for r in large:
        out = out.unionAll(_spread(features.where(F.col("relation") == r), r, l1, l2, iterations))
    return out


def _spread(features: DataFrame, relation: str, l1: float, l2: float, iterations: int) -> DataFrame:
    """logistic() of one relation by quasi-Newton steps over all partitions. The weights, one a feature, come to the driver."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    spark = features.sparkSession
    names = stored(numbered(features.select("feature").distinct(), ["feature"], name="place"), "feature-names")
    d = names.count()
    cells = features.join(names, "feature").groupBy("iid", "label", "place").agg(F.sum("value").alias("value"))
    rows = cells.groupBy("iid").agg(F.max((F.col("label") > 0).cast("double")).alias("y"), F.sort_array(F.collect_list(F.struct((F.col("place") - 1).cast("int").alias("i"), "value"))).alias("x"))
    sparse = F.udf(lambda x: Vectors.sparse(d, [e["i"] for e in x], [e["value"] for e in x]), VectorUDT())
    rows = stored(rows.select("y", "x"), "training").select("y", sparse("x").alias("x"))
    n, total = rows.count(), l1 + 2 * l2
    fit = LogisticRegression(featuresCol="x", labelCol="y", maxIter=iterations, regParam=total / n, elasticNetParam=l1 / total if total else 0.0, standardization=False, tol=1e-10).fit(rows)
    w = fit.coefficients.toArray()
    keep = np.flatnonzero(np.abs(w) > 1e-8)
    got = spark.createDataFrame([(int(i) + 1, float(w[i])) for i in keep], "place long, weight double")
    return got.join(names, "place").select(F.lit(relation).alias("relation"), "feature", "weight")


def _fitted(features: DataFrame, l1: float, l2: float, iterations: int) -> DataFrame:

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        i, j, v, y, d = _design(rows)
        names = np.unique(rows["feature"].astype(str))
        w, z, t, b, zb = np.zeros(d), np.zeros(d), 1.0, 0.0, 0.0
        norm = np.bincount(i, v * v, len(y))
        step = 1.0 / (0.25 * (norm.sum() + len(y)) + 2 * l2)
        step = max(step, 1.0 / (0.25 * (np.abs(np.bincount(j, np.abs(v) * np.bincount(i, np.abs(v), len(y))[i], d)).max() + len(y)) + 2 * l2))
        for _ in range(iterations):
            e = 1 / (1 + np.exp(-(np.bincount(i, v * z[j], len(y)) + zb))) - y
            g = np.bincount(j, v * e[i], d) + 2 * l2 * z
            new = z - step * g
            new = np.sign(new) * np.maximum(0, np.abs(new) - step * l1)
            nb = zb - step * e.sum()
            nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
            z, zb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
            w, b, t = new, nb, nt
        keep = np.abs(w) > 1e-8
        return pd.DataFrame({"relation": rows["relation"].iloc[0], "feature": names[keep], "weight": w[keep]})

    return features.groupBy("relation").applyInPandas(fit, WEIGHTS)


def _kinds(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relation, iid, y, kind) of all rows, and (relation, kind, feature, value): rows with the same features are of one kind, whose
    features come once."""
    rows = features.groupBy("relation", "iid").agg(F.max((F.col("label") > 0).cast("int")).alias("y"), F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("row"))
    rows = stored(rows.withColumn("kind", F.md5(F.to_json("row").cast("binary"))), "rows")
    # read apart: sides of a cogroup that share columns may lose them when Spark plans anew after a stage
    again = rows.sparkSession.read.schema(rows.schema).parquet(rows.stored_at[1])
    kinds = again.groupBy("relation", "kind").agg(F.any_value("row").alias("row")).select("relation", "kind", F.inline("row"))
    return rows.select("relation", "iid", "y", "kind"), kinds


def _in_order(rows: pd.DataFrame, kinds: pd.DataFrame) -> tuple[list[str], list[list[int]], list[list[float]], list[int], list[int]]:
    """Names of features, places and values of the features of each kind, and kind and y of each row in order of iid."""
    names, j = np.unique(kinds["feature"].astype(str), return_inverse=True)
    of, k = np.unique(kinds["kind"].astype(str), return_inverse=True)
    order = np.argsort(k, kind="stable")
    cuts = np.searchsorted(k[order], np.arange(len(of) + 1))
    at, values = j[order], kinds["value"].to_numpy(float)[order]
    parts = [slice(*x) for x in zip(cuts, cuts[1:])]
    by = np.argsort(rows["iid"].to_numpy(), kind="stable")
    seq = pd.Index(of).get_indexer(rows["kind"])[by]
    return names.tolist(), [at[x].tolist() for x in parts], [values[x].tolist() for x in parts], seq.tolist(), rows["y"].to_numpy()[by].tolist()


def _trained(features: DataFrame, fit) -> DataFrame:
    """Weights that fit(names, places, values, kinds of rows, y) gives for each relation, in one task."""

    def run(rows: pd.DataFrame, kinds: pd.DataFrame) -> pd.DataFrame:
        relation = rows["relation"].iloc[0]
        names, *of = _in_order(rows, kinds)
        return pd.DataFrame({"relation": relation, "feature": names, "weight": fit(len(names), *of)})

    rows, kinds = _kinds(features)
    return rows.groupBy("relation").cogroup(kinds.groupBy("relation")).applyInPandas(run, WEIGHTS)


def online(features: DataFrame, rate: float = 1.0, decay: float = 1.0, momentum: float = 0.5, l2: float = 0.0, passes: int = 5) -> DataFrame:
    """One update a row in order of iid, with rate / (decay + k) in pass k, momentum, and shrinking of the weights a row touches."""

    def fit(d: int, places: list, values: list, seq: list, y: list) -> list[float]:
        w, last = [0.0] * d, [0.0] * d
        of = [list(zip(f, x)) for f, x in zip(places, values)]
        for k in range(passes):
            a = rate / (decay + k)
            for kind, yes in zip(seq, y):
                z = 0.0
                for f, x in of[kind]:
                    z += w[f] * x
                e = yes - 1 / (1 + math.exp(-min(20.0, max(-20.0, z))))
                for f, x in of[kind]:
                    last[f] = a * (e * x - 2 * l2 * w[f]) + momentum * last[f]
                    w[f] += last[f]
        return w

    return _trained(features, fit)


def linear_svm(features: DataFrame, c: float = 1.0, passes: int = 30) -> DataFrame:
    """Weights of a linear support vector machine, by dual coordinate descent in fixed order; a pass that changes nothing is the
    last."""

    def fit(d: int, places: list, values: list, seq: list, y: list) -> list[float]:
        w, alpha = [0.0] * d, [0.0] * len(seq)
        of = [(list(zip(f, x)), sum(v * v for v in x)) for f, x in zip(places, values)]
        for _ in range(passes):
            moved = False
            for r, (kind, yes) in enumerate(zip(seq, y)):
                row, q = of[kind]
                if q:
                    sign, z = 2 * yes - 1, 0.0
                    for f, x in row:
                        z += w[f] * x
                    new = min(c, max(0.0, alpha[r] - (sign * z - 1) / q))
                    if new != alpha[r]:
                        by = (new - alpha[r]) * sign
                        for f, x in row:
                            w[f] += by * x
                        alpha[r], moved = new, True
            if not moved:
                break
        return w

    return _trained(features, fit)


def log_likelihood(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(relation, value): the mean log likelihood of the rows' labels, scores clamped at 20 as in online training."""
    labels = features.select("relation", "iid", (F.col("label") > 0).alias("yes")).distinct()
    z = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("score")))
    p = 1 / (1 + F.exp(-z))
    return scores(features, weights).join(labels, ["relation", "iid"]).groupBy("relation").agg(F.avg(F.log(F.when(F.col("yes"), p).otherwise(1 - p))).alias("value"))


def feature_counts(features: DataFrame) -> DataFrame:
    """(relation, positive, negative, unseen, unseen_weight): values of rows by label (null: unseen), and the weight of an unseen one
    that makes up for what negatives lack against positives; null where they lack nothing or none is unseen."""
    count = lambda c: F.count_if(c).alias
    x = features.groupBy("relation").agg(count(F.col("label") > 0)("positive"), count(F.col("label") <= 0)("negative"), count(F.col("label").isNull())("unseen"))
    return x.withColumn("unseen_weight", F.when((F.col("positive") > F.col("negative")) & (F.col("unseen") > 0), (F.col("positive") - F.col("negative")) / F.col("unseen")))


def nonzero(paths: DataFrame, weights: DataFrame) -> DataFrame:
    """Paths (path) that some weight other than 0 uses."""
    return paths.join(weights.where("weight <> 0").select(F.col("feature").alias("path")).distinct(), "path", "left_semi")


def scores(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(relation, iid, score): the linear sum; features without a weight count 0."""
    x = features.join(weights, ["relation", "feature"], "left")
    return x.groupBy("relation", "iid").agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias("score"))


def densify(edges: DataFrame, sims: DataFrame) -> DataFrame:
    """(s, r, t, value): each pair's relations times their similarities to all."""
    one = edges.select("s", "t", F.col("r").alias("r1")).distinct()
    return one.join(sims, "r1").groupBy("s", F.col("r2").alias("r"), "t").agg(F.sum("weight").alias("value"))


MOST_VECTORS = 4096


def similar_pairs(vectors: DataFrame, lower: float, upper: float = 2.0) -> DataFrame:
    """Pairs of relation vectors (r, v), scaled to length 1, with lower < dot < upper, both ways. For a vocabulary: more than
    MOST_VECTORS raise; vectors.similar_hashed has no such limit."""
    if len(vectors.select("r").head(MOST_VECTORS + 1)) > MOST_VECTORS:
        raise ValueError(f"more than {MOST_VECTORS} vectors to compare with one another: use similar_hashed")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    u = vectors.where(norm > 0).select("r", F.transform("v", lambda x: F.try_divide(x, norm)).alias("v"))
    a, b = u.select(F.col("r").alias("r1"), F.col("v").alias("x")), u.select(F.col("r").alias("r2"), F.col("v").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return a.join(b, F.col("r1") != F.col("r2")).select("r1", "r2", dot.alias("weight")).where((F.col("weight") > lower) & (F.col("weight") < upper))


SUPPORT = "relation string, of long, alpha double, norm double, features map<string,double>"


#: Kernel values that a task keeps; those of further rows are worked out anew each time.
KEPT_VALUES = 16_000_000


def kernel_svm(features: DataFrame, kernel: str = "rbf", gamma: float = 1.0, c: float = 1.0, passes: int = 30) -> DataFrame:
    """Support rows of a support vector machine for each relation, by dual coordinate descent over all rows in order of iid; a pass that
    changes nothing is the last. Kernels: linear, quadratic (the dot product squared), rbf. Rows with the same features
    share their kernel values and are one support row, with the sum of their alphas and the least of their iids."""
    if kernel not in ("linear", "quadratic", "rbf"):
        raise ValueError(f"unknown kernel: {kernel}")

    def fit(rows: pd.DataFrame, kinds: pd.DataFrame) -> pd.DataFrame:
        relation, iids = rows["relation"].iloc[0], np.sort(rows["iid"].to_numpy(), kind="stable")
        names, places, values, seq, y = _in_order(rows, kinds)
        own = [{} for _ in places]
        for x, f, v in zip(own, places, values):
            for j, z in zip(f, v):
                x[j] = x.get(j, 0.0) + z
        norm = np.array([sum(v * v for v in x.values()) for x in own])
        holders = [[] for _ in names]
        for k, x in enumerate(own):
            for j, v in x.items():
                holders[j].append((k, v))
        holders = [(np.array([k for k, _ in h], dtype=np.int64), np.array([v for _, v in h])) for h in holders]
        kept, most = {}, max(1, KEPT_VALUES // len(own))

        def against(k: int) -> np.ndarray:
            """Kernel values of a kind with all kinds."""
            if k in kept:
                return kept[k]
            dot = np.zeros(len(own))
            for j, v in own[k].items():
                of, z = holders[j]
                dot[of] += v * z
            if kernel == "quadratic":
                dot *= dot
            elif kernel == "rbf":
                dot = np.exp(-gamma * np.maximum(0, norm[k] + norm - 2 * dot))
            if len(kept) < most:
                kept[k] = dot
            return dot

        with_self = [{"linear": q, "quadratic": q * q, "rbf": 1.0}[kernel] for q in norm.tolist()]
        sign, alpha, f = [2 * v - 1 for v in y], [0.0] * len(seq), np.zeros(len(own))
        for _ in range(passes):
            moved = False
            for r, (k, s) in enumerate(zip(seq, sign)):
                if with_self[k]:
                    new = min(c, max(0.0, alpha[r] - (s * float(f[k]) - 1) / with_self[k]))
                    if new != alpha[r]:
                        f += (new - alpha[r]) * s * against(k)
                        alpha[r], moved = new, True
            if not moved:
                break
        alpha, seq = np.array(alpha), np.array(seq)
        on = np.flatnonzero(alpha)
        total = np.bincount(seq[on], (alpha * np.array(sign))[on], len(own))
        keep, first = np.unique(seq[on], return_index=True)
        lists = [{names[j]: v for j, v in own[k].items()} for k in keep]
        return pd.DataFrame({"relation": [relation] * len(keep), "of": iids[on][first], "alpha": total[keep], "norm": norm[keep], "features": lists})

    rows, kinds = _kinds(features)
    return rows.groupBy("relation").cogroup(kinds.groupBy("relation")).applyInPandas(fit, SUPPORT)


def kernel_scores(features: DataFrame, support: DataFrame, kernel: str = "rbf", gamma: float = 1.0) -> DataFrame:
    """(relation, iid, score) of all rows. Only rows and support rows that share a feature are joined: what an rbf kernel has for all
    others is one sum for a relation. Rows with the same features are scored once, and support rows with the same features are one."""
    entries = F.sort_array(F.map_entries("features"))
    support = support.groupBy("relation", entries.alias("entries")).agg(F.sum("alpha").alias("alpha"), F.min("norm").alias("norm"), F.min("of").alias("of"))
    s = support.select("relation", "of", "alpha", "norm", F.explode("entries").alias("e")).select("relation", "of", "alpha", "norm", F.col("e.key").alias("feature"), F.col("e.value").alias("z"))
    rows = features.groupBy("relation", "iid").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("row"))
    rows = rows.withColumn("kind", F.sha2(F.to_json("row"), 256))
    named = rows.select("relation", "iid", "kind")
    x = rows.groupBy("relation", F.col("kind").alias("iid")).agg(F.any_value("row").alias("row")).select("relation", "iid", F.explode("row").alias("e")).select("relation", "iid", "e.feature", "e.value")
    norms = x.groupBy("relation", "iid").agg(F.sum(F.col("value") * F.col("value")).alias("size"))
    dots = x.join(s, ["relation", "feature"]).groupBy("relation", "iid", "of", "alpha", "norm").agg(F.sum(F.col("value") * F.col("z")).alias("dot"))
    if kernel == "rbf":
        g = F.lit(float(gamma))
        part = F.col("alpha") * (F.exp(-g * F.greatest(F.lit(0.0), F.col("size") + F.col("norm") - 2 * F.col("dot"))) - F.exp(-g * (F.col("size") + F.col("norm"))))
        shared = dots.join(norms, ["relation", "iid"]).groupBy("relation", "iid").agg(F.sum(part).alias("part"))
        base = support.groupBy("relation").agg(F.sum(F.col("alpha") * F.exp(-g * F.col("norm"))).alias("base"))
        out = norms.join(base, "relation", "left").join(shared, ["relation", "iid"], "left")
        out = out.select("relation", F.col("iid").alias("kind"), (F.coalesce("base", F.lit(0.0)) * F.exp(-g * F.col("size")) + F.coalesce("part", F.lit(0.0))).alias("score"))
        return named.join(out, ["relation", "kind"]).select("relation", "iid", "score")
    part = F.col("alpha") * (F.col("dot") if kernel == "linear" else F.col("dot") * F.col("dot"))
    got = dots.groupBy("relation", "iid").agg(F.sum(part).alias("part"))
    out = norms.join(got, ["relation", "iid"], "left").select("relation", F.col("iid").alias("kind"), F.coalesce("part", F.lit(0.0)).alias("score"))
    return named.join(out, ["relation", "kind"]).select("relation", "iid", "score")


def binarised(features: DataFrame) -> DataFrame:
    return features.where("value <> 0").withColumn("value", F.lit(1.0))
