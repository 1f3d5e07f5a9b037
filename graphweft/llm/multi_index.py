"""Nearest neighbours by multi-index hashing of learned binary codes (operator 5)."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow_file import filesystem
from .shared import fresh_path, table
from .vectors import matrix, sample, usable, usable_like

#: Bits of a code, and its 16-bit parts, each of which is indexed.
PARTS = 16
BITS = 16 * PARTS
#: Rows of an index shard, and queries of a block: a task holds one of each.
SHARD, QUERIES = 16384, 256
#: The share of true neighbours of the sample that the radius is to hold.
HELD = 0.975
#: Rows of the sample that give a query its floor, and tasks at most (each takes pairs in turn, so memory doesn't grow).
FLOOR_ROWS, MOST_TASKS = 8192, 100_000
#: Rows of the sample that the rotation is learned from.
ROTATED_ROWS = 4096

_VALUES = np.arange(65536, dtype=np.uint16)
_ORDER = np.argsort(np.bitwise_count(_VALUES), kind="stable").astype(np.uint16)
_WITHIN = np.cumsum(np.bincount(np.bitwise_count(_VALUES), minlength=17))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of codes (rows of 64-bit words)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Codes:
    """Binary codes of vectors, from a rotation that is learned so that signs lose little (iterative quantisation).

    Inner products become angles: vectors are divided by the largest norm and get one more component that makes them
    unit; queries get 0 there. The share of differing bits estimates the angle; spread is how many standard
    errors that estimate is off for HELD of the true neighbours of the sample."""

    def __init__(self, x: np.ndarray, top: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.top, self.sample = top, x[:FLOOR_ROWS]
        a = self.unit(x)
        d = a.shape[1]
        basis = np.linalg.svd(a.T @ a)[0]
        wide = basis[:, :BITS] if d >= BITS else basis @ np.linalg.qr(rng.normal(size=(BITS, d)))[0].T
        z = a[:ROTATED_ROWS] @ wide
        turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
        for _ in range(8):
            u, _, vt = np.linalg.svd(z.T @ np.where(z @ turn >= 0, 1.0, -1.0))
            turn = u @ vt
        self.map = wide @ turn
        self.spread = 2.0
        if len(x) > 100:
            q = x[:256]
            s = q @ x.T
            np.fill_diagonal(s[:, : len(q)], -np.inf)
            near = np.argsort(-s, axis=1)[:, :20]
            bits = distance(self.query(q)[:, None], self.data(x)[near]).astype(float)
            p = self.share(np.take_along_axis(s, near, 1) / np.linalg.norm(q, axis=1)[:, None])
            self.spread = float(np.clip(np.quantile((bits - BITS * p) / np.sqrt(BITS * p * (1 - p) + 0.25), HELD), 0.5, 6))

    def unit(self, x: np.ndarray) -> np.ndarray:
        x = x / self.top
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])

    def share(self, score: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(score / self.top, -1, 1)) / np.pi

    def _pack(self, z: np.ndarray) -> np.ndarray:
        return np.packbits(z >= 0, axis=1).view("<u8")

    def data(self, x: np.ndarray) -> np.ndarray:
        return self._pack(self.unit(x) @ self.map)

    def query(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._pack(np.hstack([x, np.zeros((len(x), 1))]) @ self.map)

    def radius(self, score: float, norm: float) -> int:
        """So far may the code of a vector with that inner product be."""
        p = float(self.share(np.array(score / norm)))
        return int(min(BITS, np.ceil(BITS * p + self.spread * np.sqrt(BITS * p * (1 - p) + 0.25))))

    def floor(self, q: np.ndarray, k: int) -> np.ndarray:
        """An inner product that the k-th best of all rows reaches at least: that of the k + 1 best of the sample (one may be
        the query's own row)."""
        s = q @ self.sample.T
        return np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1] if s.shape[1] > k else np.full(len(q), -np.inf)


class Shard:
    """Up to SHARD vectors and a table of their codes for each 16-bit part."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray):
        self.ids, self.x, self.codes = ids, x, codes
        self.tables = []
        for part in codes.view(np.uint16).reshape(len(ids), -1).T:
            self.tables.append((np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=65536))])))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs in at most radius bits: one of its parts differs in radius / PARTS at most. Where the
        values to probe would be more than the rows, the codes themselves are compared, with the same result."""
        masks = _ORDER[: _WITHIN[min(16, radius // PARTS)]]
        if len(masks) * PARTS > len(self.ids):
            return np.flatnonzero(distance(self.codes, code) <= radius)
        seen = np.zeros(len(self.ids), bool)
        for part, (rows, bounds) in zip(code.view(np.uint16), self.tables):
            values = masks ^ part
            a = bounds[values]
            n = bounds[values.astype(np.int64) + 1] - a
            a, n = a[n > 0], n[n > 0]
            if len(n):
                seen[rows[np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)]] = True
        got = np.flatnonzero(seen)
        return got[distance(self.codes[got], code) <= radius]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def nearest(codes: Codes, shard: Shard, own: int, q: np.ndarray, code: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The shard's k best, as far as they can be among the k best of all (floor: what those reach at least), and how many rows
    were reranked. The radius grows until it holds what can be as near as the k-th best known or the floor."""
    norm = float(np.linalg.norm(q))
    radius = codes.radius(floor, norm) if np.isfinite(floor) else BITS // 4
    while True:
        at = shard.within(code, radius)
        at = at[shard.ids[at] != own]
        ids, worth = _best(shard.ids[at], (shard.x[at] * q).sum(axis=1), k)
        if radius >= BITS or len(ids) == k and (np.isfinite(floor) or codes.radius(worth[-1], norm) <= radius):
            return ids, worth, len(at)
        radius = min(BITS, max(radius + 1, codes.radius(worth[-1], norm)) if len(ids) == k else radius + BITS // 32)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors with the largest inner product for each query, its own row
    (same vec_id) left out; nearest first, ties to the smaller vec_id; all, if there are fewer.

    Rows dealt evenly become index shards in the shared folder, queries become blocks there. A task takes pairs of a
    block and a shard, one after the other, so it holds one of each; a query's bests of all shards are then merged. The bounded
    sample gives an inner product that the k-th best reaches at least, so the radius is as narrow in every shard as in one.
    The rotation is fitted on at most FIT_ROWS rows, all are indexed. Null, empty, zero and non-finite vectors, those of
    another dimension than the commonest and rows with a null vec_id take no part; equal vectors each count; an empty table
    gives an empty result; other columns aren't read."""
    spark = vectors.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    total = rows.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    if not total["n"]:
        return spark.createDataFrame([], out)
    codes = Codes(np.array([r[0] for r in sample(rows, ["embedding"])], float), float(np.sqrt(total["top"])))
    folder = fresh_path(spark, "multi-index")

    def stored(most: int, of_queries: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, inner = filesystem(folder)
            at.create_dir(inner, recursive=True)
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def put(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
                name, data = f"{uuid.uuid4().hex}.npz", io.BytesIO()  # of its own for each attempt
                np.savez(data, ids=ids, x=x, codes=codes.query(x) if of_queries else codes.data(x), floor=codes.floor(x, k) if of_queries else [])
                with at.open_output_stream(f"{inner}/{name}") as f:
                    f.write(data.getvalue())
                return pa.RecordBatch.from_pydict({"name": [name]})

            for batch in batches:
                for i in range(0, batch.num_rows, most):
                    part = batch.slice(i, most)
                    held.append((np.asarray(part.column(0)), matrix(part.column(1))))
                    if sum(len(h[0]) for h in held) >= most:
                        ids, x = (np.concatenate(c) for c in zip(*held))
                        yield put(ids[:most], x[:most])
                        held = [(ids[most:], x[most:])] if len(ids) > most else []
            if held:
                yield put(*(np.concatenate(c) for c in zip(*held)))

        return run

    def files(df: DataFrame, n: int, most: int, of_queries: bool) -> list[str]:
        """One name for most rows or so: what comes to the driver."""
        return sorted(r[0] for r in df.repartition(max(1, -(-n // most))).sortWithinPartitions("vec_id").mapInArrow(stored(most, of_queries), "name string").collect())

    asked = usable_like(queries.selectExpr("cast(vec_id as long) vec_id", "cast(embedding as array<double>) embedding"), codes.map.shape[0] - 1)
    shards, blocks = files(rows, total["n"], SHARD, False), files(asked, asked.count(), QUERIES, True)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inner = filesystem(folder)

        def load(name: str) -> dict[str, np.ndarray]:
            with at.open_input_file(f"{inner}/{name}") as f, np.load(io.BytesIO(f.read())) as z:
                return dict(z)

        last, shard = "", None
        for batch in batches:
            for number in batch.column(0).to_pylist():
                of, block = divmod(number, len(blocks))
                if shards[of] != last:
                    z = load(shards[of])
                    last, shard = shards[of], Shard(z["ids"], z["x"], z["codes"])
                q = load(blocks[block])
                found = [nearest(codes, shard, *x, k) for x in zip(q["ids"].tolist(), q["x"], q["codes"], q["floor"].tolist())]
                n = np.array([len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q["ids"], n)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], names=["query_id", "vec_id", "score"])

    if not blocks:
        return spark.createDataFrame([], out)
    pairs = len(shards) * len(blocks)
    found = spark.range(0, pairs, 1, min(pairs, MOST_TASKS)).mapInArrow(probe, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows a shard
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20; the cases of search()."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
