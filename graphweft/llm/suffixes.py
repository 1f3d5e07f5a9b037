"""Repeated passages by a sparse suffix array (operator 3).

Every window of LEAST words selects one position by content: that of the least 8-word gram among its first WINDOW words
(a minimiser). Suffixes at selected positions are sorted over the cluster by rank: by a hash of their first AGREE words, then
by one of the whole stretch that the windows of the position cover. Neighbours in that order are compared: a suffix whose
first AGREE words no neighbour has repeats nothing; where all suffixes with these words agree on the whole stretch, all of its
windows repeat. Elsewhere (a passage ends in the stretch) matches are extended to the left and right, window by window, among
one suffix for each different stretch. Equal windows select the same position in themselves, so the result is exact up to
64-bit hashes: the words of all windows of LEAST words that occur twice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SLICE, _powers, mixed, nested, rolled, slices, steady, table, text_bytes, text_hash, tidy, unnested, words, written

LEAST = 50
GRAM, WINDOW = 8, 20
#: Words of a suffix that lie in each window which selects it.
AGREE = LEAST - WINDOW + 1
_AT = np.uint64((1 << 28) - 1)


def _least(x: np.ndarray) -> np.ndarray:
    """Minimum of each WINDOW consecutive values."""
    n, width, y = len(x), 1, x
    while width * 2 <= WINDOW:
        y = np.minimum(y[: len(y) - width], y[width:])
        width *= 2
    rest = WINDOW - width
    return np.minimum(y[: n - WINDOW + 1], y[rest : rest + n - WINDOW + 1])


def selected(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions that windows select (the first of equal grams), the first and the last window of each, and its row."""
    n = len(h) - LEAST + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    grams = mixed(rolled(h, GRAM) ^ np.uint64(0x5851F42D4C957F2D))
    pick = (_least((grams & ~_AT) | np.arange(len(grams), dtype=np.uint64))[:n] & _AT).astype(np.int64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[:n]
    s = np.flatnonzero(np.arange(n) + LEAST <= rows[row + 1])
    if not len(s):
        return (np.zeros(0, np.int64),) * 4
    pick, row = pick[s], row[s]
    change = np.flatnonzero((pick[1:] != pick[:-1]) | (row[1:] != row[:-1])) + 1
    first, last = np.concatenate([[0], change]), np.concatenate([change, [len(s)]]) - 1
    return pick[first], s[first], s[last], row[first]


def _prefix(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(h) + 1)
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)]), down


def _hashes(sums: np.ndarray, down: np.ndarray, begin: np.ndarray, end: np.ndarray, more: np.ndarray | int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((sums[end] - sums[begin]) * down[begin] + np.asarray(more, np.uint64)).view(np.int64)


SUFFIX = "h long, k long, doc_id long, th long, start int, n int"


def suffixes(docs: DataFrame) -> DataFrame:
    """One row a selected suffix: the hash of its first AGREE words (h), that of its stretch (k), its text (doc_id, th: hash
    of the text), and the first word and the number of the windows that select it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = text_bytes(batch.column(2))
            for a, b in slices(at, SLICE):
                part = batch.slice(a, b - a)
                h, _, _, rows = words(*text_bytes(part.column(2)))
                p, first, last, row = selected(h, rows)
                if not len(p):
                    continue
                sums, down = _prefix(h)
                lead = _hashes(sums, down, p, p + AGREE)
                with np.errstate(over="ignore"):
                    kind = _hashes(sums, down, first, last + LEAST, ((p - first) * 64 + last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                take = pa.array(row)
                cols = [pa.array(lead), pa.array(kind), part.column(0).take(take), part.column(1).take(take)]
                cols += [pa.array(x.astype(np.int32)) for x in (first - rows[row], last - first + 1)]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "k", "doc_id", "th", "start", "n"])

    return docs.mapInArrow(tidy(run), SUFFIX)


ARRAY = f"{SUFFIX}, low boolean, border boolean, alone boolean, many long"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition, each suffix compared with its neighbours. Holds one batch. Two kinds of rows come out.

    Without many: suffixes of which a neighbour has the first words, and the partition's first and last (border), which may have
    such a neighbour in another partition only (alone). low: the first one with its stretch here.
    With many: the first suffix of a stretch and how many have it here, for stretches that share their first words with another one
    here (low), and for the partition's first and last (border)."""
    names = ["h", "k", "doc_id", "th", "start", "n"]

    def out(cols: list[np.ndarray], low, border, alone=False, many=None) -> pa.RecordBatch:
        n = len(cols[0])
        arrays = [pa.array(c) for c in cols] + [pa.array(np.broadcast_to(np.asarray(x, bool), n)) for x in (low, border, alone)]
        return pa.RecordBatch.from_arrays([*arrays, pa.nulls(n, pa.int64()) if many is None else pa.array(many)], names=[*names, "low", "border", "alone", "many"])

    last = None  # the last row, which waits for its neighbour
    lowest: list[np.ndarray] = []  # first row of the last one's stretch
    count, inner, before, first, opening = 0, False, False, True, True
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(6)]
        if last is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(last, cols)]
        new = np.ones(len(cols[0]), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols[:5]], axis=0)
        if not new.all():  # a row that is there twice is one occurrence
            cols = [c[new] for c in cols]
        m = len(cols[0])
        same_h = cols[0][1:] == cols[0][:-1]
        same_k = same_h & (cols[1][1:] == cols[1][:-1])
        begins = np.concatenate([[0], np.flatnonzero(~same_k) + 1])
        low = [c[begins] for c in cols]
        sizes = np.diff(np.append(begins, m))
        is_low = np.concatenate([[True], ~same_k])
        inside = np.concatenate([[inner], same_h[begins[1:] - 1]])
        if last is not None:
            for x, y in zip(low, lowest):
                x[0] = y[0]
            sizes[0] += count - 1
            is_low[0] = count == 1
        if m > 1:
            several = inside[:-1] | same_h[begins[1:] - 1]
            border = np.zeros(len(several), bool)
            border[:1] = opening
            done = np.flatnonzero(several | border)
            if len(done):
                yield out([c[done] for c in low], several[done], border[done], many=sizes[done])
            opening = opening and not len(several)
            company = same_h | np.concatenate([[before], same_h[:-1]])
            border = np.zeros(m - 1, bool)
            border[0] = first
            keep = np.flatnonzero(company | border)
            if len(keep):
                yield out([c[keep] for c in cols], is_low[keep], border[keep], ~company[keep])
            before, first = bool(same_h[-1]), False
        last, lowest, count, inner = [c[-1:] for c in cols], [c[-1:] for c in low], int(sizes[-1]), bool(inside[-1])
    if last is not None:
        yield out(lowest, inner, True, many=np.array([count]))
        yield out(last, count == 1, True, not before)


def sorted_array(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Suffixes whose first words another one has, and the first suffix of each stretch where several share first words.

    Ranges split a hot key. What partitions can't see across their borders is put right from the borders' own rows: two of each
    kind for a partition at most, so those are broadcast."""
    order = ["h", "k", "doc_id", "th", "start"]
    array = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(_compared), ARRAY), "suffix-array")
    single, kinds = array.where("many is null").drop("many"), array.where("many is not null").drop("alone")
    met = F.broadcast(single.where("border").groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    company = single.where("not alone").unionByName(single.where("alone").join(met, "h", "left_semi"))
    of, at = F.struct("doc_id", "th", "start", "n"), kinds.where("border")
    whole = at.groupBy("h", "k").agg(F.min(of).alias("lowest"), F.sum("many").alias("many"), F.max("low").alias("low"))
    wrong = at.join(F.broadcast(whole.select("h", "k", "lowest")), ["h", "k"]).where(of != F.col("lowest")).select("h", "k", "doc_id", "th", "start", F.lit(True).alias("wrong"))
    company = company.join(F.broadcast(wrong), order, "left").withColumn("low", F.col("low") & F.col("wrong").isNull())
    heads = whole.groupBy("h").agg((F.max("low") | (F.count("*") > 1)).alias("several")).where("several").select("h")
    several = whole.join(F.broadcast(heads), "h", "left_semi").select("h", "k", "lowest.*", "many")
    return company.drop("border", "alone", "wrong"), kinds.where("not border").drop("low", "border").unionByName(several)


def _flat(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds of the rows of a list of structs, and its fields end to end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.slice(at[0], at[-1] - at[0])
    return at - at[0], [np.asarray(flat.field(x)) for x in names]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the stretches that are asked for."""
    for batch in batches:
        _, at = text_bytes(batch.column(2))
        for a, b in slices(at, SLICE):
            part = batch.slice(a, b - a)
            h, _, _, rows = words(*text_bytes(part.column(2)))
            bounds, (k, start, n, many) = _flat(part.column(3), ["k", "start", "n", "many"])
            if not len(k):
                continue
            row = np.repeat(np.arange(len(rows) - 1), np.diff(bounds))
            of = np.repeat(np.arange(len(k)), n)
            j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            s = rows[row][of] + start[of] + j
            sums, down = _prefix(h)
            take = pa.array(row[of])
            cols = [pa.array(_hashes(sums, down, s, s + LEAST)), pa.array(k[of]), pa.array(j.astype(np.int32)), part.column(0).take(take), part.column(1).take(take), pa.array((start[of] + j).astype(np.int32)), pa.array(many[of])]
            yield pa.RecordBatch.from_arrays(cols, names=["w", "k", "j", "doc_id", "th", "s", "many"])


def extended(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """For each stretch that is asked for, bits of its windows: those that repeat, and those of which its first suffix holds
    the first occurrence."""
    wanted = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("k", "start", "n", "many")).alias("asked"))  # bounded by the text
    once = texts.dropDuplicates(["doc_id", "th"])
    found = written(once.join(wanted, ["doc_id", "th"]).select("doc_id", "th", "text", "asked").mapInArrow(tidy(_windows), "w long, k long, j int, doc_id long, th long, s int, many long"), "windows")
    twice = found.groupBy("w").agg(F.sum("many").alias("all"), F.min(F.struct("doc_id", "th", "s")).alias("lowest")).where("all > 1").select("w", "lowest")
    of = found.join(written(twice, "repeated-windows"), "w", "left")
    bit = lambda x: F.bit_or(F.when(x, F.expr("shiftleft(1, j)")).otherwise(F.lit(0)))
    return of.groupBy("k").agg(bit(F.col("lowest").isNotNull()).alias("rep"), bit(F.coalesce(F.struct("doc_id", "th", "s") == F.col("lowest"), F.lit(False))).alias("lead"))


def _union(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of windows that begin there (ascending), as runs."""
    if not len(s):
        return s, s
    cut = np.flatnonzero(s[1:] > s[:-1] + LEAST) + 1
    return s[np.concatenate([[0], cut])], s[np.concatenate([cut, [len(s)]]) - 1] + LEAST


def _inside(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(begin):
        return np.zeros(len(x), bool)
    i = np.searchsorted(begin, x, "right") - 1
    return (i >= 0) & (x < end[np.maximum(i, 0)])


#: Stretches whose windows are looked at together.
MARKED = 1 << 14


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of words in repeated windows, cut where those of first occurrences begin and end."""
    for batch in batches:
        at, _ = _flat(batch.column(2), ["start"])
        for a, b in slices(at, MARKED):
            yield _spans_of(batch.slice(a, b - a))


def _spans_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    bounds, (start, rep, lead) = _flat(batch.column(2), ["start", "rep", "lead"])
    row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
    reach = np.zeros(batch.num_rows, np.int64)
    np.maximum.at(reach, row, start.astype(np.int64))
    base = np.concatenate([[0], np.cumsum(reach + 2 * LEAST)])
    at = base[row] + start

    def windows(bits: np.ndarray) -> np.ndarray:
        i, j = np.nonzero(bits[:, None] >> np.arange(WINDOW) & 1)
        return np.sort(at[i] + j)

    begin, end = _union(windows(rep))
    first = _union(windows(lead))
    cuts = np.unique(np.concatenate([begin, end, *first]))
    cuts, after = cuts[:-1], cuts[1:]
    ok = _inside(cuts, begin, end)
    cuts, after = cuts[ok], after[ok]
    of = np.searchsorted(base, cuts, "right") - 1
    take = pa.array(of)
    cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array((cuts - base[of]).astype(np.int32)), pa.array((after - cuts).astype(np.int32)), pa.array(_inside(cuts, *first))]
    return pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "start_word", "n_words", "first"])


def repeated(docs: DataFrame) -> DataFrame:
    """Passages of LEAST words or more that occur elsewhere (in the same text or another): doc_id, th (hash of the text),
    start_word, n_words, first (whether the words are part of a window that is the first of its kind: smallest doc_id, then
    th and place). Words are runs of bytes other than white space, A-Z lower-cased.

    The rows are exactly the words of windows of LEAST words that occur at two places or more, cut where first changes;
    parts of a passage that are cut so may be shorter. Null, empty and short texts give no rows; rows with a null doc_id are
    left out; rows that repeat a doc_id and its text are one text; an empty table gives an empty result; other columns
    aren't read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("th"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    company, asked = sorted_array(written(suffixes(rows), "suffixes"))
    bits = written(extended(rows, asked), "extended")
    whole = F.expr("shiftleft(1, n) - 1")
    marked = company.join(bits, "k", "left").select("doc_id", "th", "start", F.coalesce("rep", whole).alias("rep"), F.when(F.col("low"), F.coalesce("lead", whole)).otherwise(F.lit(0)).alias("lead"))
    per = marked.where("rep <> 0").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "rep", "lead")).alias("x"))  # bounded by the text
    return per.mapInArrow(tidy(_spans), "doc_id long, th long, start_word int, n_words int, first boolean")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents; the cases of repeated()."""
    return repeated(table(spark, sf_dir, "documents")).drop("th")


def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without those runs of words (start_word, n_words); the white space around them stays. Null where there are none."""
    out: list[str | None] = [None] * len(texts)
    bounds, (start, n) = _flat(gone, ["start_word", "n_words"])
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        raw, at = text_bytes(texts.slice(i, 1))
        _, begin, end, _ = words(raw, at)
        kept, last, data = [], 0, raw.tobytes()
        for a, m in sorted(zip(start[bounds[i] : bounds[i + 1]].tolist(), n[bounds[i] : bounds[i + 1]].tolist())):
            kept.append(data[last : begin[a]])
            last = int(end[a + m - 1])
        out[i] = b"".join([*kept, data[last:]]).decode("utf-8")
    return pa.array(out, pa.string())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document, or an earlier place of the same one, has; all columns stay, n_chars
    is counted anew where a text changes. A text of which nothing is left stays as an empty one. Null and empty texts, rows with
    a null doc_id and rows without such a passage are unchanged; rows that repeat a doc_id and its text change alike, and are
    no copies of one another here; an empty table gives an empty one; columns may have any name."""
    steady(spark)
    gone = repeated(docs).where("not first").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start_word", "n_words")).alias("gone"))
    gone = written(gone, "gone").hint("merge")  # grows with the data: never broadcast
    rows = nested(docs, "doc_id", "text").withColumn("th", text_hash(F.col("text")))
    out = rows.join(gone, ["doc_id", "th"], "left")
    cut = F.arrow_udf(without, "string")
    changed = F.col("gone").isNotNull()
    text = F.when(changed, cut(F.when(changed, F.col("text")), F.coalesce("gone", F.array().cast("array<struct<start_word:int,n_words:int>>")))).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"])
    return unnested(out, docs, new)
