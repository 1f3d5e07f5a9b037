"""What the operators share: the shared folder, written tables, sorted groups and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import folder as shared_dir
from ..functions.tables import stored as written  # noqa: F401  cuts lineage, and outlives any executor


_HELD: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None] | None = None) -> None:
    """For the start of a task's function: Python workers live on from stage to stage, so what other operators keep in this one
    is dropped."""
    others = [x for x in _HELD if x != name]
    for other in others:
        _HELD.pop(other)()
    if others:
        trim()
    if clear:
        _HELD[name] = clear


def trim() -> None:
    """Gives free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run, a task's function over batches, with nothing of other operators kept beside it, and what is free given back at its end: a
    worker that waits for its next task then holds little."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(run.__name__)
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphweft/{name}-{uuid.uuid4().hex}"


#: Bytes of a batch between the JVM and Python: either side holds a few of them for each task.
BATCH_BYTES = 8 << 20


def steady(spark: SparkSession) -> None:
    """For this session from now on: short batches, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    steady(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nested(docs: DataFrame, *names: str) -> DataFrame:
    """docs with all columns inside one, row, so that no name clashes with an operator's own; and those named (doc_id as a
    long, text as a string)."""
    kinds = {"doc_id": "long", "text": "string"}
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), *(F.col(c).cast(kinds[c]).alias(c) for c in names))


def unnested(rows: DataFrame, docs: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of docs out of row, some of them with new values of the same type."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    return rows.select(*((new[c].cast(kinds[c]) if new and c in new else F.col("row").getField(c)).alias(c) for c in docs.columns))


def text_hash(text: Column) -> Column:
    """A hash of the text; a null one is empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sorted_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str, order: list[str] = ()) -> DataFrame:
    """fn over the rows of each value of keys, as one Arrow table. Rows are dealt by keys and sorted,
    so a task holds one group at a time; callers bound the size of a group (see the blocks of each operator)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None

        def flush():
            if held:
                out = fn(pa.concat_tables(held) if len(held) > 1 else held[0])
                if out is not None and out.num_rows:
                    yield from out.combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            cols = [rows.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(len(cols[0]), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), rows.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(c[a] for c in cols)
                if key != last:
                    yield from flush()
                    held, last = [], key
                held.append(rows.slice(a, b - a))
        yield from flush()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(tidy(run), schema)


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(i) for i in range(len(self.up))), np.int64, len(self.up))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars around the smallest node: at most one edge a node. Works in slices, so memory is bounded."""
    for batch in batches:
        a, b = (np.asarray(batch.column(i)) for i in (0, 1))
        if not len(a):
            continue
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(nodes))
        for x, y in zip(flat[: len(a)].tolist(), flat[len(a) :].tolist()):
            forest.join(x, y)
        root = forest.roots()
        keep = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root[keep]]), pa.array(nodes[keep])], names=["a", "b"])


def components(edges: DataFrame, name: str = "components", rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for each node that has an edge.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a grouped minimum with map-side
    combining, so a hub's edges never meet in one task; each round is a written table. Converges in about
    log(n) rounds. Empty edges give an empty table; loops and repeated edges change nothing."""
    spark = edges.sparkSession
    now = written(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").mapInArrow(_stars, "a long, b long").distinct(), f"{name}-0")

    def total(df):
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    before = total(now)
    for i in range(rounds):
        if not before[0]:
            break
        # large star: every larger neighbour of u goes to the smallest node in u's neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").selectExpr("m as a", "b").where("a <> b")
        large = large.distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low2 = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low2, "b").selectExpr("m", "a", "b")
        now = small.where("a <> m").selectExpr("m as a", "a as b").union(low2.selectExpr("m as a", "b")).distinct()
        now = written(now, f"{name}-{i + 1}")
        after = total(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: no fixed point in {rounds} rounds")
    roots = now.select(F.col("a").alias("node")).distinct().selectExpr("node", "node as component")
    return now.selectExpr("b as node", "a as component").union(roots)


#: Bytes of text that are hashed at once: the arrays of a slice stay within a few MB.
SLICE = 1 << 18


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes, one row at least."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each row's begin; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C55 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 19)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, np.uint64(base))
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than space and 09-0D, A-Z lower-cased) of the rows of a text column:
    64-bit hash, first byte, byte after the last, and the row bounds in these arrays."""
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    solid = ~_SEP[raw]
    left = solid.copy()
    left[1:] &= ~solid[:-1] | edge[1:n]
    right = solid.copy()
    right[:-1] &= ~solid[1:] | edge[1:n]
    begin, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(h), begin, end, np.searchsorted(begin, at)


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words; windows that leave a row are for the caller to drop."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0xFF51AFD7ED558CCD) + h[i : i + n]
    return mixed(out + np.uint64(k))
