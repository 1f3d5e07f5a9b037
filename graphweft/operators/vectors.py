"""Vectors of relations: decomposition, hyperplane hashing, walks between similar relations, clusters of paths.

Names, vectors and counts of relations are a vocabulary, not data: it is what the driver holds here, and never pairs or edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import label_name
from .paths import encode

VECTORS = "r string, v array<double>"
SIMILAR = "r1 string, r2 string, weight double"
JOINED = " C+C "
MOST_RELATIONS = 20_000


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors (r, v) of length 1; null and zero ones and those with a component that is no number go."""
    norm = F.sqrt(dot("v", "v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where("v is not null").where(fine).where(norm > 0).select("r", F.transform("v", lambda x: F.try_divide(x, norm)).alias("v"))


def gram(edges: DataFrame) -> DataFrame:
    """(r1, r2, g): inner products of the relations' columns in the matrix of pairs by relations, whose cells count edges.
    Pairs are first grouped by what they hold, so the product of relations is formed once for each different content."""
    cells = edges.groupBy("s", "t", "r").agg(F.count("*").cast("double").alias("k"))
    rows = cells.groupBy("s", "t").agg(F.sort_array(F.collect_list(F.struct("r", "k"))).alias("row"))
    kinds = rows.groupBy("row").agg(F.count("*").alias("n"))
    both = kinds.select("n", "row", F.explode("row").alias("x")).select("n", "x", F.explode("row").alias("y"))
    return both.groupBy(F.col("x.r").alias("r1"), F.col("y.r").alias("r2")).agg(F.sum(F.col("x.k") * F.col("y.k") * F.col("n")).alias("g"))


def decomposed(edges: DataFrame, dims: int, rounds: int = 200, seed: int = 1) -> DataFrame:
    """Vectors (r, v) of the relations from the matrix of pairs by relations: right singular vectors of the dims largest singular
    values, each times the root of its value, then scaled to length 1. Not centred. The component that is largest in size
    over all relations is positive in each dimension. A relation outside those dimensions has no vector."""
    spark = edges.sparkSession
    if len(edges.select("r").distinct().head(MOST_RELATIONS + 1)) > MOST_RELATIONS:
        raise ValueError(f"more than {MOST_RELATIONS} relations to decompose on the driver")
    g = gram(edges).toPandas()
    names, at = np.unique(np.concatenate([g["r1"].to_numpy(str), g["r2"].to_numpy(str)]), return_inverse=True)
    n = len(names)
    if not n:
        return spark.createDataFrame([], VECTORS)
    i, j, w, dims = at[: len(g)], at[len(g) :], g["g"].to_numpy(float), min(dims, n)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, dims + 8))))[0]
    for _ in range(rounds):  # subspace iteration on the sparse products
        before, z = q, np.zeros_like(q)
        np.add.at(z, i, w[:, None] * q[j])
        q = np.linalg.qr(z)[0]
        if np.linalg.norm(q - before @ (before.T @ q)) < 1e-12:
            break
    z = np.zeros_like(q)
    np.add.at(z, i, w[:, None] * q[j])
    values, turn = np.linalg.eigh(q.T @ z)
    best = np.argsort(-values)[:dims]
    v = (q @ turn[:, best]) * np.sign((q @ turn[:, best])[np.abs(q @ turn[:, best]).argmax(0), np.arange(dims)])
    v = v * np.maximum(values[best], 0) ** 0.25
    norm = np.linalg.norm(v, axis=1)
    return spark.createDataFrame([(str(names[k]), [float(x) for x in v[k] / norm[k]]) for k in range(n) if norm[k] > 1e-9], VECTORS)


def hashed(vectors: DataFrame, tables: int, bits: int, seed: int = 1) -> DataFrame:
    """(r, v, tab, code) of unit vectors: codes by hyperplanes drawn with the mean and deviation of each dimension."""
    if not 0 < bits < 63:
        raise ValueError("a code has 1 to 62 bits")
    u = unit(vectors)
    each = u.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d")).orderBy("i").toPandas()
    dims = len(each)
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims)) * each["d"].to_numpy(float) + each["m"].to_numpy(float)
    planes = planes.reshape(tables * bits, dims)

    def run(batches):
        for b in batches:
            if len(b):
                side = (np.stack(b["v"].to_numpy()) @ planes.T > 0).reshape(len(b), tables, bits)
                code = side @ (1 << np.arange(bits, dtype=np.int64)[::-1])
                yield pd.DataFrame({"r": np.repeat(b["r"].to_numpy(), tables), "tab": np.tile(np.arange(tables), len(b)), "code": code.ravel()})

    codes = u.mapInPandas(run, "r string, tab int, code long")
    return codes.join(u, "r")


def similar_hashed(vectors: DataFrame, lower: float, upper: float = 0.99999, tables: int = 8, bits: int = 8, most: int = -1, ignore: list[str] = (), seed: int = 1) -> DataFrame:
    """(r1, r2, weight) of relations that share a code in some table, with lower < weight < upper, and for each r1 the most
    similar ones if most is not -1 (ties by name). Products are formed once a pair; crowded codes are not given up."""
    v = vectors.where(~F.col("r").isin(list(ignore))) if ignore else vectors
    codes = hashed(v, tables, bits, seed).select("r", "tab", "code")
    met = codes.withColumnRenamed("r", "r1").join(codes.withColumnRenamed("r", "r2"), ["tab", "code"]).where("r1 < r2").select("r1", "r2").distinct()
    u = unit(v)
    near = met.join(u.select(F.col("r").alias("r1"), F.col("v").alias("x")), "r1").join(u.select(F.col("r").alias("r2"), F.col("v").alias("y")), "r2")
    near = near.select("r1", "r2", dot("x", "y").alias("weight")).where((F.col("weight") > lower) & (F.col("weight") < upper))
    out = near.unionAll(near.select("r2", "r1", "weight"))
    if most < 0:
        return out
    w = Window.partitionBy("r1").orderBy(F.desc("weight"), "r2")
    return out.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def next_label(adj: DataFrame, label: str, vectors: DataFrame, spikiness: float, reset: float) -> DataFrame:
    """(n, l, q): chances that a walk at n that should follow label takes l, of the same direction. They go with
    exp(spikiness * dot) of unit vectors; reset is the weight of giving up. A label without a vector is followed itself, and so
    is one that is all a node has; labels without vectors are else not taken."""
    back = label.startswith("_")
    own = unit(vectors).where(F.col("r") == label.lstrip("_") if back else F.col("r") == label).head(1)
    here = adj.where(F.col("l").startswith("_") == F.lit(back)).select("n", "l").distinct()
    if not own:
        return here.where(F.col("l") == label).withColumn("q", F.lit(1.0))
    base = F.array(*[F.lit(float(x)) for x in own[0]["v"]])
    like = unit(vectors).select(F.col("r"), F.exp(F.lit(float(spikiness)) * dot("v", base)).alias("weight"))
    x = here.withColumn("r", label_name()).join(like, "r", "left").select("n", "l", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    of = Window.partitionBy("n")
    x = x.select("n", "l", "weight", F.sum("weight").over(of).alias("total"), F.count("*").over(of).alias("c"))
    return x.select("n", "l", F.when((F.col("c") == 1) & (F.col("l") == label), 1.0).otherwise(F.col("weight") / (F.col("total") + F.lit(float(reset)))).alias("q")).where("q > 0")


def follow_similar(starts: DataFrame, adj: DataFrame, path: list[str], vectors: DataFrame, spikiness: float = 3.0, reset: float = 0.25) -> DataFrame:
    """(start, target, p): where a walk along the labels, or similar ones, ends, given that it does."""
    degree = adj.groupBy("n", "l").agg(F.count("*").alias("d"))
    step = adj.groupBy("n", "l", "m").agg(F.count("*").alias("k")).join(degree, ["n", "l"])
    now = starts.select(F.col("n").alias("start"), F.col("n").alias("node")).distinct().withColumn("w", F.lit(1.0))
    for label in path:
        move = step.join(next_label(adj, label, vectors, spikiness, reset), ["n", "l"])
        now = now.join(move, F.col("node") == F.col("n")).groupBy("start", F.col("m").alias("node")).agg(F.sum(F.col("w") * F.col("q") * F.col("k") / F.col("d")).alias("w"))
    return now.select("start", F.col("node").alias("target"), (F.col("w") / F.sum("w").over(Window.partitionBy("start"))).alias("p"))


def signature(path: Column, known: Column) -> Column:
    """The path with v for each relation that has a vector."""
    return encode(F.transform(path, lambda x: F.when(F.array_contains(known, F.regexp_replace(x, "^_", "")), F.when(x.startswith("_"), "_v").otherwise("v")).otherwise(x)))


def clustered_paths(counts: DataFrame, vectors: DataFrame, threshold: float, keep: int = -1) -> DataFrame:
    """(path, n_pairs) of clusters of paths (path array, n_pairs). Paths of one signature merge, the most similar two first (ties:
    the earlier names), while the product of their joined unit vectors is above threshold. A merged position is called
    'a C+C b' and its vector is the mean weighted by the counts, scaled to length 1; counts add up. keep: that many, ties by name.
    Paths of one signature go to one task: they are kinds of paths, whose number follows the vocabulary."""
    u = unit(vectors)
    known = u.agg(F.collect_set("r").alias("known"))
    x = counts.crossJoin(F.broadcast(known))  # one row
    x = x.select("path", "n_pairs", signature(F.col("path"), F.col("known")).alias("kind"), F.posexplode("path").alias("i", "l"))
    x = x.withColumn("r", label_name()).join(u, "r", "left")
    x = x.groupBy("kind", "path", "n_pairs").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda z: z["v"]).alias("vs"))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        items = sorted(([list(p), int(n), [None if v is None else np.asarray(v, float) for v in vs]] for p, n, vs in zip(rows["path"], rows["n_pairs"], rows["vs"])), key=lambda it: it[0])
        whole = lambda it: np.concatenate([v for v in it[2] if v is not None])
        if len(items) > 1 and any(v is not None for v in items[0][2]):
            m = np.stack([whole(it) for it in items])
            sim = np.triu(m @ m.T, 1) + np.tril(np.full((len(m), len(m)), -np.inf))
            while len(items) > 1:
                a, b = divmod(int(sim.argmax()), len(items))
                if not sim[a, b] > threshold:
                    break
                (pa, na, va), (pb, nb, vb) = items[a], items[b]
                path, vs = [], []
                for la, lb, x1, x2 in zip(pa, pb, va, vb):
                    if x1 is None:
                        path.append(la)
                        vs.append(None)
                    else:
                        mean = x1 * na + x2 * nb
                        size = np.linalg.norm(mean)
                        path.append(la + JOINED + (lb[1:] if lb.startswith("_") else lb))
                        vs.append(mean / size if size else mean)
                rest = [k for k in range(len(items)) if k not in (a, b)]
                items = [items[k] for k in rest] + [[path, na + nb, vs]]
                m = np.concatenate([m[rest], whole(items[-1])[None]])
                grown = np.full((len(items), len(items)), -np.inf)
                grown[:-1, :-1] = sim[np.ix_(rest, rest)]
                grown[:-1, -1] = m[:-1] @ m[-1]
                sim = grown
        return pd.DataFrame({"path": ["-" + "-".join(p) + "-" for p, _, _ in items], "n_pairs": [n for _, n, _ in items]})

    out = x.groupBy("kind").applyInPandas(merge, "path string, n_pairs long").orderBy(F.desc("n_pairs"), "path")
    return out if keep < 0 else out.limit(keep)
