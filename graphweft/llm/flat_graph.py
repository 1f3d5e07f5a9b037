"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Forest, components, sorted_groups, table, written
from .vectors import matrix, sample, usable

LIMIT = 0.93
#: Vectors for one centre, centres of a label at most, rows of a task at once (larger shards are dealt in pairs of blocks).
TARGET, CENTRES, BLOCK = 1024, 1024, 2048
#: Edges of a node in one shard: those that pruning leaves, reversed ones (the nearest), and random ones that pruning never takes.
DEGREE, BACK, RANDOM, ALPHA = 16, 16, 8, 1.2
#: Nodes that a greedy search holds while the graph is built and when it is searched; those it expands at once; queries at once.
BUILD_BEAM, BEAM, EXPAND, QUERIES = 24, 40, 4, 512
#: Centres that a vector goes to, tried in this order until the audit finds enough links; then labels are compared in full.
OVERLAPS, AUDIT_ROWS, ENOUGH = (2, 4, 8), 256, 0.97


def normed(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(rows: list, counts: dict[int, int], seed: int = 3) -> dict[int, np.ndarray]:
    """Spherical k-means for each label, on a bounded sample."""
    rng, out = np.random.default_rng(seed), {}
    by: dict[int, list] = {}
    for label, v in rows:
        by.setdefault(label, []).append(v)
    for label, n in counts.items():
        x = normed(np.array(by[label], float)) if label in by else None
        if x is None:
            continue
        k = max(1, min(CENTRES, len(x) // 4, -(-n // TARGET)))
        c = x[rng.permutation(len(x))[:k]]
        for _ in range(8 if k > 1 else 0):
            near = (x @ c.T).argmax(axis=1)
            c = np.stack([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(k)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        out[label] = c
    return out


def beam(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, width: int, trace: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search from the medoid for rows of q at once: the width nearest nodes that each has met (-1 fills), nearest first, with
    their products; with trace, also the nodes expanded on the way."""
    m, rows = len(q), np.arange(len(q))
    ids, sims, done = np.full((m, width), -1), np.full((m, width), -np.inf, x.dtype), np.ones((m, width), bool)
    seen = np.zeros((m, len(x)), bool)
    ids[:, 0], sims[:, 0], done[:, 0], seen[:, start] = start, q @ x[start], False, True
    way: list[np.ndarray] = []
    while True:
        open_ = np.where(done, -np.inf, sims)
        pick = np.argpartition(-open_, EXPAND, axis=1)[:, :EXPAND]
        live = np.take_along_axis(open_, pick, 1) > -np.inf
        r = np.flatnonzero(live.any(axis=1))
        if not len(r):
            break
        pick, live = pick[r], live[r]
        cur = np.where(live, ids[r[:, None], pick], -1)
        done[r[:, None], pick] = True
        if trace:
            step = np.full((m, EXPAND), -1)
            step[r] = cur
            way.append(step)
        near = np.where(cur[:, :, None] >= 0, edges[cur], -1).reshape(len(r), -1)
        order = np.argsort(near, axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = (near >= 0) & ~seen[r[:, None], near]
        near = np.where(fresh, near, -1)
        i, j = np.nonzero(fresh)
        seen[r[i], near[i, j]] = True
        s = np.full(near.shape, -np.inf, x.dtype)
        s[i, j] = np.einsum("ij,ij->i", x[near[i, j]], q[r[i]])
        every = np.concatenate([sims[r], s], axis=1)
        best = np.argpartition(-every, width - 1, axis=1)[:, :width]
        ids[r] = np.take_along_axis(np.concatenate([ids[r], near], axis=1), best, 1)
        sims[r] = np.take_along_axis(every, best, 1)
        done[r] = np.take_along_axis(np.concatenate([done[r], np.zeros(near.shape, bool)], axis=1), best, 1) | (ids[r] < 0)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    if trace:
        ids = np.concatenate([ids, *way], axis=1)
    return ids, sims


def pruned(x: np.ndarray, of: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Edges of the nodes of out of their candidates (-1 fills): the nearest goes in; those that are closer to it, by the factor
    alpha, than to the node go out; and so on."""
    cand = np.sort(np.where(cand == of[:, None], -1, cand), axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    far = np.where(cand >= 0, 1.0 - np.einsum("ijk,ik->ij", x[cand], x[of]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")[:, : 3 * degree]
    cand, far = np.take_along_axis(cand, order, 1), np.take_along_axis(far, order, 1)
    rows, out = np.arange(len(of)), np.full((len(of), degree), -1)
    v = x[cand]
    among = 1.0 - v @ v.transpose(0, 2, 1)
    alive = np.isfinite(far)
    for k in range(degree):
        first = alive.argmax(axis=1)
        ok = alive[rows, first]
        if not ok.any():
            break
        out[ok, k] = cand[rows, first][ok]
        alive &= alpha * among[rows, first] > far
        alive[rows, first] = False
    return out


def reversed_edges(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """For each node the BACK nearest of those that have an edge to it (ties: the smaller row)."""
    i, k = np.nonzero(edges >= 0)
    j = edges[i, k]
    order = np.lexsort((i, -np.einsum("ij,ij->i", x[i], x[j]), j))
    i, j = i[order], j[order]
    place = np.arange(len(j)) - np.searchsorted(j, j)
    out = np.full((len(edges), BACK), -1)
    out[j[place < BACK], place[place < BACK]] = i[place < BACK]
    return out


def medoid(u: np.ndarray) -> int:
    return int((u @ u.mean(axis=0)).argmax())


def build(u: np.ndarray) -> np.ndarray:
    """Edges of each row (-1 fills). From a random graph, two rounds over all rows: a greedy search from the medoid for the row
    gives its candidates, and robust pruning its edges (the second round with ALPHA); then edges go both ways."""
    n, rng, x = len(u), np.random.default_rng(5), u.astype(np.float32)
    if n <= DEGREE + 1:
        return np.array([[j for j in range(n) if j != i] or [-1] for i in range(n)])
    chance = rng.integers(0, n - 1, (n, RANDOM))
    chance += chance >= np.arange(n)[:, None]
    own, back, start = np.full((n, DEGREE), -1), np.full((n, BACK), -1), medoid(u)
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for a in range(0, n, QUERIES):
            of = order[a : a + QUERIES]
            found, _ = beam(x, np.concatenate([own, back, chance], axis=1), start, x[of], BUILD_BEAM, True)
            own[of] = pruned(x, of, np.concatenate([found, own[of], back[of]], axis=1), DEGREE, alpha)
            back = reversed_edges(x, own)
    return np.concatenate([own, back, chance], axis=1)


def around(u: np.ndarray, edges: np.ndarray, query: int, front: np.ndarray, limit: float) -> np.ndarray:
    """Rows with that cosine or more that range-expanding search reaches from where the greedy search ended."""
    seen = np.zeros(len(u), bool)
    hits = []
    seen[front] = True
    while len(front):
        good = front[(u[front] * u[query]).sum(axis=1) >= limit]
        hits.append(good)
        nxt = np.unique(edges[good]) if len(good) else np.zeros(0, np.int64)
        nxt = nxt[nxt >= 0]
        front = nxt[~seen[nxt]]
        seen[front] = True
    got = np.concatenate(hits)
    return got[got != query]


ROWS = "label long, shard long, i long, j long, block long, vec_id long, shards array<bigint>, mult long, embedding array<double>"


def _assign(reps: DataFrame, c: dict[int, np.ndarray], overlap: int) -> DataFrame:
    """A row for each shard of a vector (the centres that are nearest); shards: all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(1))
            x = normed(matrix(batch.column(2)))
            shards: list = [[0]] * len(label)
            for value in np.unique(label):
                at = np.flatnonzero(label == value)
                if value in c:
                    s = x[at] @ c[value].T
                    m = min(overlap, s.shape[1])
                    near = np.sort(np.argsort(-s, axis=1, kind="stable")[:, :m], axis=1)
                    for i, row in zip(at.tolist(), near.tolist()):
                        shards[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(shards, pa.list_(pa.int64()))], names=["vec_id", "label", "embedding", "mult", "shards"])

    rows = reps.select("vec_id", "label", "embedding", "mult").mapInArrow(run, "vec_id long, label long, embedding array<double>, mult long, shards array<bigint>")
    rows = written(rows.withColumn("shard", F.explode("shards")), "shards")
    blocks = rows.groupBy("label", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    rows = rows.join(blocks, ["label", "shard"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))


def _graph():
    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").combine_chunks().to_numpy()
        edges = build(normed(matrix(rows.column("embedding"))))
        keep = edges >= 0
        return pa.table({"vec_id": pa.array(ids), "edges": pa.array([ids[e[k]].tolist() for e, k in zip(edges, keep)], pa.list_(pa.int64()))})

    return run


FOUND = "label long, a long, b long, links long"


def _found(label: int, ids: np.ndarray, links: np.ndarray, tree: list[tuple[int, int]]) -> pa.Table:
    """Links of each row that has any, and a forest of the links."""
    some = np.flatnonzero(links)
    a = np.concatenate([ids[some], np.array([p[0] for p in tree], np.int64)])
    b = pa.array([None] * len(some) + [p[1] for p in tree], pa.int64())
    w = np.concatenate([links[some], np.zeros(len(tree), np.int64)])
    return pa.table({"label": pa.array(np.full(len(a), label, np.int64)), "a": pa.array(a), "b": b, "links": pa.array(w)})


def _search(limit: float):
    def run(rows: pa.Table) -> pa.Table | None:
        ids, block, mult = (rows.column(c).combine_chunks().to_numpy() for c in ("vec_id", "block", "mult"))
        order = np.argsort(ids, kind="stable")
        rows, ids, block, mult = rows.take(pa.array(order)), ids[order], block[order], mult[order]
        u = normed(matrix(rows.column("embedding")))
        mine = rows.column("shard")[0].as_py()
        lists = rows.column("edges").to_pylist()
        known = []
        for x in lists:
            x = np.array(x, np.int64)
            k = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
            known.append(k[ids[k] == x])
        edges = np.full((len(ids), max([1, *map(len, known)])), -1, np.int64)
        for i, k in enumerate(known):
            edges[i, : len(k)] = k
        shards = rows.column("shards").to_pylist()
        wide = np.full((len(ids), max(map(len, shards))), -1, np.int64)
        for i, s in enumerate(shards):
            wide[i, : len(s)] = s
        both = block.min() != block.max()
        x, start = u.astype(np.float32), medoid(u)
        ends = np.concatenate([beam(x, edges, start, x[a : a + QUERIES], BEAM)[0] for a in range(0, len(u), QUERIES)])
        links, forest, out = np.zeros(len(ids), np.int64), Forest(len(ids)), []
        met = np.zeros((len(ids), len(ids)), bool)
        for q in range(len(ids)):
            hit = around(u, edges, q, ends[q][ends[q] >= 0], limit)
            if both:
                hit = hit[block[hit] != block[q]]
            met[q, hit] = met[hit, q] = True  # a pair counts for both ends, whichever search found it
        for q in range(len(ids)):
            hit = np.flatnonzero(met[q])
            if not len(hit):
                continue
            # A pair that lies in several shards counts in the first of them.
            common = (wide[hit][:, :, None] == wide[q][None, None, :]) & (wide[hit] >= 0)[:, :, None]
            first = np.where(common.any(axis=2), wide[hit], np.iinfo(np.int64).max).min(axis=1)
            links[q] = int(mult[hit[first == mine]].sum())
            root = forest.find(q)
            for h in hit.tolist():
                if forest.find(h) != root and forest.join(q, h):
                    out.append((int(ids[q]), int(ids[h])))
                    root = forest.find(q)
        return _found(rows.column("label")[0].as_py(), ids, links, out)

    return run


def _compare(limit: float):
    """All links of a block, or across a pair of blocks, by comparison."""

    def run(rows: pa.Table) -> pa.Table | None:
        ids, block, mult = (rows.column(c).combine_chunks().to_numpy() for c in ("vec_id", "block", "mult"))
        order = np.argsort(ids, kind="stable")
        ids, block, mult = ids[order], block[order], mult[order]
        u = normed(matrix(rows.column("embedding")))[order]
        both = block.min() != block.max()
        if not both and (rows.column("i")[0].as_py() != rows.column("j")[0].as_py()):
            return None  # the other block is empty
        links, forest, out = np.zeros(len(ids), np.int64), Forest(len(ids)), []
        for a in range(0, len(ids), 512):
            near = u[a : a + 512] @ u.T >= limit
            near[np.arange(len(near)), np.arange(a, a + len(near))] = False
            if both:
                near &= block[a : a + 512, None] != block
            links[a : a + 512] = near @ mult
            for q, hits in enumerate(near, a):
                root = forest.find(q)
                for h in np.flatnonzero(hits).tolist():
                    if forest.find(h) != root and forest.join(q, h):
                        out.append((int(ids[q]), int(ids[h])))
                        root = forest.find(q)
        return _found(rows.column("label")[0].as_py(), ids, links, out)

    return run


def failing(audit: dict[int, tuple[int, int]], got: dict[int, int], enough: float) -> list[int]:
    """Labels of which too few links were found: by the sum over their audited rows, or by the mean of the rows' shares."""
    by: dict[int, list[tuple[int, int]]] = {}
    for v, (label, n) in audit.items():
        if n:
            by.setdefault(label, []).append((min(got.get(v, 0), n), n))
    bad = lambda x: sum(g for g, _ in x) < enough * sum(n for _, n in x) or sum(g / n for g, n in x) < enough * len(x)
    return sorted(label for label, x in by.items() if bad(x))


def linked(vectors: DataFrame, limit: float = LIMIT, enough: float = ENOUGH) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links join rows with the same label (not null) and a cosine of
    limit or more, in doubles.

    Equal vectors of a label are one class (grouped minimum) that carries its size. Each label's classes go to the
    shards of their nearest centres, which are fitted on at most FIT_ROWS rows; each shard builds its graph;
    adjacency lists of all shards are united; a greedy search from the shard's medoid and an expanding search around its end
    find what is near, and every pair found is verified. A bounded set of rows is compared with all rows of its
    label; where too few of a label's links were found, its vectors go to more shards, and at last all pairs of the label
    are compared. Shards that are too large for a task are dealt in pairs of blocks. Output rows of a task grow with its vectors, not with pairs.

    Null, empty, zero and non-finite vectors, those of another dimension than the commonest and rows with a null label
    have no links and are kept, as are rows with a null vec_id, whose component is null; an empty table gives an
    empty result; other columns aren't read."""
    spark = vectors.sparkSession
    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(label as long) label", "cast(embedding as array<double>) embedding")
    good = written(usable(rows.where("label is not null")).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0))), "vectors")
    classes = written(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("mult")), "vector-classes")
    counts = {r["label"]: r["count"] for r in classes.groupBy("label").count().collect()}  # one row a label
    c = centres([(r[0], r[1]) for r in sample(classes, ["label", "embedding"])], counts)
    audit = _audit(classes, limit)
    parts, part, again, exact = [], classes, None, []
    for overlap in OVERLAPS:
        placed = written(_assign(part, c, overlap), "placed")
        adjacency = sorted_groups(placed.select("label", "shard", "i", "j", "vec_id", "embedding"), ["label", "shard", "i", "j"], _graph(), "vec_id long, edges array<bigint>")
        adjacency = written(adjacency.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")), "adjacency")  # a few lists of bounded length
        searched = placed.select("label", "shard", "i", "j", "block", "vec_id", "shards", "mult", "embedding").join(adjacency, "vec_id")
        found = written(sorted_groups(searched, ["label", "shard", "i", "j"], _search(limit), FOUND), "found")
        sums = found.where(F.col("a").isin(list(audit))).groupBy("a").agg(F.sum("links").alias("links"))
        got = {r["a"]: r["links"] for r in sums.collect()} if audit else {}  # AUDIT_ROWS rows
        bad = failing({v: x for v, x in audit.items() if again is None or x[0] in again}, got, enough)  # AUDIT_ROWS labels at most
        parts.append(found.where(~F.col("label").isin(bad)) if bad else found)
        again = [x for x in bad if overlap != OVERLAPS[-1] and x in c and len(c[x]) > overlap]
        exact += [x for x in bad if x not in again]
        if not again:
            break
        part = classes.where(F.col("label").isin(again))
    if exact:
        placed = written(_assign(classes.where(F.col("label").isin(exact)), {}, 1), "placed")
        parts.append(written(sorted_groups(placed.select("label", "shard", "i", "j", "block", "vec_id", "mult", "embedding"), ["label", "shard", "i", "j"], _compare(limit), FOUND), "compared"))
    found = parts[0]
    for x in parts[1:]:
        found = found.unionAll(x)
    links = found.groupBy(F.col("a").alias("vec_id")).agg(F.sum("links").alias("links"))
    group = components(found.where("b is not null").select("a", "b"), "vector-links")
    of = classes.withColumnRenamed("vec_id", "rep").join(links.withColumnRenamed("vec_id", "rep"), "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    done = good.join(of, ["label", "embedding"]).select(F.col("vec_id").alias("of"), "n_links", "component_id").dropDuplicates(["of"])
    out = rows.select("vec_id").join(done, F.col("vec_id") == F.col("of"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _audit(classes: DataFrame, limit: float) -> dict[int, tuple[int, int]]:
    """Label and links of a bounded set of rows to other classes, by comparison with every row of their label."""
    chosen = sample(classes, ["vec_id", "label", "embedding"], AUDIT_ROWS)
    if not chosen:
        return {}
    ids, label = np.array([r[0] for r in chosen]), np.array([r[1] for r in chosen])
    q = normed(np.array([r[2] for r in chosen], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                near = normed(matrix(part.column(2))) @ q.T >= limit
                near &= (np.asarray(part.column(1))[:, None] == label) & (np.asarray(part.column(0))[:, None] != ids)
                total += (near * np.asarray(part.column(3))[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["vec_id", "n"])

    out = classes.select("vec_id", "label", "embedding", "mult").mapInArrow(run, "vec_id long, n long")
    total = {r["vec_id"]: r["n"] for r in out.groupBy("vec_id").agg(F.sum("n").alias("n")).collect()}
    return {r[0]: (r[1], total.get(r[0], 0)) for r in chosen}


def op2_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of one label from a cosine of 0.93 on; the cases of linked()."""
    return linked(table(spark, sf_dir, "embeddings"))
