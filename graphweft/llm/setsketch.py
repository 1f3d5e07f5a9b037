"""Near-duplicate documents by SetSketch registers, bands, a likelihood test and exact verification (operator 4)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SLICE, Forest, components, mixed, nested, rolled, slices, sorted_groups, steady, table, text_bytes, text_hash, tidy, unnested, words, written

#: Words in a shingle; op4 links documents from 85 : 100 on, the stage of the pipeline from 80 : 100 on.
WORDS, PER, OF = 5, 85, 100
STAGE_PER, STAGE_OF = 80, 100
#: Registers: 24 bands of 4; a pair at 0.85 shares no band once in 4e7, one at 0.80 once in 3e5. Base of their spacing.
BANDS, ROWS, BASE = 24, 4, 1.001
#: Rows of a bucket, and shingles of a group, that a task holds at once; larger ones are dealt in pairs of blocks.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000

_rng = np.random.Generator(np.random.PCG64(20240601))
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each row, sorted, end to end, and the row bounds. A row with fewer words than a shingle
    has one for its whole sequence; without words it has none."""
    h, _, _, rows = words(raw, at)
    r = rolled(h, WORDS)
    out = []
    for s, e in zip(rows.tolist(), rows[1:].tolist()):
        if e - s >= WORDS:
            out.append(np.unique(r[s : e - WORDS + 1]))
        elif e > s:
            out.append(rolled(h[s:e], e - s))
        else:
            out.append(np.zeros(0, np.uint64))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def registers(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per set and register: 1 - log(least exponential value), to the base, cut to 16 bits. The registers of a union
    are the larger of both; equal registers come with a probability near the Jaccard similarity."""
    low = np.empty((len(starts), len(FACTORS)), np.uint64)
    with np.errstate(over="ignore"):
        for j, a in enumerate(FACTORS):
            low[:, j] = np.minimum.reduceat(x * a, starts)
    u = (low.astype(np.float64) + 1.0) / 2.0**64
    e = -np.log1p(-np.minimum(u, 1 - 1e-16))
    return np.clip(np.floor(1.0 - np.log(e) / math.log(BASE)), 0, 65535).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    out = np.empty((len(regs), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            v = np.full(len(regs), np.uint64(b + 1))
            for r in range(ROWS):
                v = v * np.uint64(0x9FB21C651E98DF25) + regs[:, b * ROWS + r].astype(np.uint64) + np.uint64(1)
            out[:, b] = mixed(v)
    return out


def lowest(per: int, of: int) -> float:
    """Pairs whose likeliest similarity is below this aren't verified: four standard errors under the limit."""
    x = per / of
    return math.floor(100 * (x - 4 * math.sqrt(x * (1 - x) / (BANDS * ROWS)))) / 100


def likely(less: np.ndarray, more: np.ndarray, same: np.ndarray, n: np.ndarray, m: np.ndarray, per: int = PER, of: int = OF) -> np.ndarray:
    """Whether the likelihood of the similarity, given how often one set's register is below, above or equal to the other's
    and both sizes, still rises at the lowest: its peak is there or higher. Pairs whose sizes rule a link out are not likely."""
    low = lowest(per, of)
    small, large = np.minimum(n, m), np.maximum(n, m)
    u, v = n / (n + m), m / (n + m)
    fits = small * of >= large * per
    k = (BASE - 1) / BASE
    x1, x2 = np.where(fits, u - v * low, 0.5), np.where(fits, v - u * low, 0.5)
    p = lambda x: -np.log1p(-x * k) / math.log(BASE)
    d = lambda x: k / (math.log(BASE) * (1 - x * k))
    p1, p2 = p(x1), p(x2)
    slope = -more * v * d(x1) / p1 - less * u * d(x2) / p2 + same * (v * d(x1) + u * d(x2)) / np.maximum(1e-12, 1 - p1 - p2)
    return fits & (slope >= 0)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), F.col("text").cast("string").alias("text"))


def sketch(rows: DataFrame) -> DataFrame:
    """doc_id, th, n (size of the shingle set), fa and fb (fingerprint of the set), regs, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = text_bytes(batch.column(2))
            for a, b in slices(at, SLICE):
                part = batch.slice(a, b - a)
                x, rows = shingles(*text_bytes(part.column(2)))
                n = np.diff(rows)
                full = np.flatnonzero(n)
                fa, fb, regs, keys = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), [None] * len(n), [None] * len(n)
                if len(full):
                    starts = rows[:-1][full]
                    with np.errstate(over="ignore"):
                        fa[full] = np.add.reduceat(x * np.uint64(0xC2B2AE3D27D4EB4F), starts)
                        fb[full] = np.bitwise_xor.reduceat(mixed(x + np.uint64(1)), starts)
                    r = registers(x, starts)
                    k = bands(r).view(np.int64)
                    for i, row, key in zip(full.tolist(), r, k.tolist()):
                        regs[i], keys[i] = row.tobytes(), key
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64)), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "th", "n", "fa", "fb", "regs", "bands"])

    return rows.mapInArrow(tidy(run), "doc_id long, th long, n long, fa long, fb long, regs binary, bands array<long>")


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(pairs: list[tuple[int, int]]) -> pa.Table | None:
    return pa.table({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}, schema=EDGES) if pairs else None


def _bucket(rows: pa.Table, per: int = PER, of: int = OF) -> pa.Table | None:
    """Candidates of a bucket, or of a pair of its blocks, as a forest: at most one edge a row."""
    ids, n, side = (rows.column(c).combine_chunks().to_numpy() for c in ("node", "n", "block"))
    regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(len(ids), -1)
    order = np.argsort(side, kind="stable")
    ids, n, side, regs = ids[order], n[order], side[order], regs[order]
    both = side[0] != side[-1]
    first = int(np.searchsorted(side, side[-1])) if both else len(ids)
    least = (lowest(per, of) - 0.2) * regs.shape[1]
    forest, out = Forest(len(ids)), []
    for r in range(first):
        lo = first if both else r + 1
        same = (regs[lo:] == regs[r]).sum(axis=1)
        near = np.flatnonzero(same >= least)
        if not len(near):
            continue
        x = near + lo
        more = (regs[r] > regs[x]).sum(axis=1)
        ok = x[likely(regs.shape[1] - same[near] - more, more, same[near], np.full(len(x), n[r]), n[x], per, of)]
        for y in ok.tolist():
            if forest.join(r, y):
                out.append((int(ids[r]), int(ids[y])))
    return _edges(out)


def links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, per: int = PER, of: int = OF) -> list[tuple[int, int]]:
    """A forest of the links (verified on full sets) within one block, or across two. Every link lies within a tree.

    Shingles are ranked by how rare they are here; two sets as similar as the limit share one of the rarest
    n - ceil(limit * n) + 1 of each (prefix filter), so sets that differ too much never meet, and those that are
    connected already aren't compared."""
    k = len(ids)
    n = np.array([len(s) for s in sets], np.int64)
    bounds = np.concatenate([[0], np.cumsum(n)])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    rank, common = place[token], count > 1
    shared = np.zeros(len(count), bool)
    shared[place] = common
    who = np.repeat(np.arange(k), n)
    by = np.argsort(rank, kind="stable")
    holders, first = who[by], np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=len(count)))])
    both = side.min() != side.max()
    forest, out = Forest(k), []
    for d in range(k):
        mine = np.sort(rank[bounds[d] : bounds[d + 1]])
        prefix = mine[: n[d] - (-(-per * n[d] // of)) + 1]
        prefix = prefix[shared[prefix]]
        if not len(prefix):
            continue
        near = np.unique(np.concatenate([holders[first[t] : first[t + 1]] for t in prefix.tolist()]))
        near = near[near < d]
        if both:
            near = near[side[near] != side[d]]
        near = near[(np.minimum(n[near], n[d]) * of >= np.maximum(n[near], n[d]) * per)]
        root = forest.find(d)
        near = [x for x in near.tolist() if forest.find(x) != root]
        if not near:
            continue
        if len(near) > 32:
            full = mine[shared[mine]]
            meet = np.bincount(np.concatenate([holders[first[t] : first[t + 1]] for t in full.tolist()]), minlength=k)
        else:
            meet = {x: len(np.intersect1d(sets[d], sets[x], assume_unique=True)) for x in near}
        for x in near:
            common_n = int(meet[x])
            if of * common_n >= per * (int(n[d]) + int(n[x]) - common_n) and forest.join(d, x):
                out.append((int(ids[d]), int(ids[x])))
    return out


def _group(rows: pa.Table, per: int = PER, of: int = OF) -> pa.Table | None:
    ids, side = (rows.column(c).combine_chunks().to_numpy() for c in ("node", "block"))
    return _edges(links(ids, [np.frombuffer(x, np.uint64) for x in rows.column("x").to_pylist()], side, per, of))


def _pairs(df: DataFrame) -> DataFrame:
    """A row for each pair of blocks (i <= j) that its block is in; a pair of a block with itself comes once."""
    df = df.withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return df.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def _grouped(docs: DataFrame, per: int, of: int) -> DataFrame:
    """Every row's doc_id, th (hash of its text), n, component_id, and whether it is the text of its component that stays."""
    rows = keyed(docs)
    s = written(sketch(rows), "sketches")
    real = s.where("n > 0 and doc_id is not null")
    classes = real.groupBy("fa", "fb", "n").agg(F.min(F.struct("doc_id", "th")).alias("rep")).select("fa", "fb", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.th").alias("rep_th"))
    classes = written(classes, "classes")
    # A class is the node of its first doc_id; where different texts have that id, each has a hash for its own.
    shared_ids = classes.groupBy("rep").agg(F.count("*").alias("texts")).where("texts > 1").select("rep", F.lit(True).alias("again"))
    nodes = written(classes.join(shared_ids, "rep", "left").withColumn("node", F.when(F.col("again"), F.xxhash64("rep", "rep_th", "fa")).otherwise(F.col("rep"))).drop("again"), "nodes")
    own = nodes.select(F.col("rep").alias("doc_id"), F.col("rep_th").alias("th"), "node")
    reps = real.select("doc_id", "th", "n", "regs", "bands").dropDuplicates(["doc_id", "th"]).join(own.hint("merge"), ["doc_id", "th"])
    reps = written(reps.drop("doc_id", "th"), "representatives")
    each = reps.select("node", F.explode("bands").alias("key"))
    buckets = each.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("who"), F.min("node").alias("low")).where("c > 1")
    buckets = buckets.groupBy("c", "who", "low").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("c") / BLOCK).cast("long").alias("blocks"))
    members = each.join(buckets, "key").join(reps.select("node", "n", "regs"), "node")
    coarse = components(sorted_groups(_pairs(members).select("key", "i", "j", "node", "block", "n", "regs"), ["key", "i", "j"], partial(_bucket, per=per, of=of), "a long, b long"), "candidates")
    coarse = written(coarse.withColumnRenamed("component", "group").join(reps.select("node", "n"), "node"), "groups")
    sizes = coarse.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("blocks"))
    chosen = coarse.join(sizes, "group").join(own, "node").select("doc_id", "th", "node", "group", "blocks")
    texts = rows.dropDuplicates(["doc_id", "th"]).join(chosen.hint("merge"), ["doc_id", "th"])  # chosen grows with the data: never broadcast

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = text_bytes(batch.column(3))
            for a, b in slices(at, SLICE):
                part = batch.slice(a, b - a)
                x, rows = shingles(*text_bytes(part.column(3)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([x[p:q].tobytes() for p, q in zip(rows, rows[1:])], pa.binary())], names=["node", "group", "blocks", "x"])

    full = texts.select("node", "group", "blocks", "text").mapInArrow(tidy(sets), "node long, group long, blocks long, x binary").where(F.octet_length("x") > 0)
    found = components(sorted_groups(_pairs(full).select("group", "i", "j", "node", "block", "x"), ["group", "i", "j"], partial(_group, per=per, of=of), "a long, b long"), "links")
    linked = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = linked.groupBy("component").agg(F.min(F.struct("rep", "rep_th")).alias("first"))
    linked = linked.join(first, "component").select("fa", "fb", "n", F.col("first.rep").alias("component_id"), F.col("first.rep_th").alias("component_th"))
    out = s.select("doc_id", "th", "n", "fa", "fb").join(linked, ["fa", "fb", "n"], "left")
    bound = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    stays = ~bound | ((F.col("doc_id") == F.col("component_id")) & (F.col("th") == F.col("component_th")))
    return out.select("doc_id", "th", "n", F.when(bound, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), stays.alias("stays"))


def near_duplicates(docs: DataFrame, per: int = PER, of: int = OF) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row; documents link from a similarity of per : of on.

    Rows with equal sets are one class first, by grouped minimum. Class representatives that share a band are
    candidates; buckets with the same members are read once. Candidate pairs of a bucket give a forest, so rows grow with
    documents and not with pairs. Within the components of those forests full sets are compared, again to a
    forest; large buckets and groups are dealt in pairs of blocks, each of which fits a task.

    component_id is the smallest doc_id reachable, kept whether it is the row's own. Null or empty texts and texts without
    words have n_shingles 0 and link with nothing; a null doc_id links with nothing, has no component and is kept; rows that
    repeat a doc_id with its text are alike, those with another text are nodes of their own; an empty table gives an empty
    result; columns other than doc_id and text are not read."""
    return _grouped(docs, per, of).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents from 85 : 100 on; the cases of near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked from 80 : 100 on, with all its columns: that with the smallest doc_id, then hash of
    its text; of rows that repeat both, that with the smallest hash of all columns. Documents without words and rows with a
    null doc_id are each their own and all stay; different texts with one doc_id are judged each for itself; an empty table gives an
    empty one; columns may have any name."""
    steady(spark)
    fate = written(_grouped(docs, STAGE_PER, STAGE_OF).where("n > 0 and doc_id is not null").groupBy("doc_id", "th").agg(F.min("stays").alias("stays"), F.count("*").alias("rows")).where("not stays or rows > 1"), "fate")
    rows = nested(docs, "doc_id", "text").withColumn("th", text_hash(F.col("text"))).drop("text")
    left = rows.join(fate.hint("merge"), ["doc_id", "th"], "left")  # grows with the data: never broadcast
    out = unnested(left.where("rows is null"), docs)
    repeats = fate.where("stays").select("doc_id", "th")
    if repeats.isEmpty():  # the commonest case, for speed alone
        return out
    one = rows.join(repeats.hint("merge"), ["doc_id", "th"]).groupBy("doc_id", "th").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return out.unionByName(unnested(one, docs))
