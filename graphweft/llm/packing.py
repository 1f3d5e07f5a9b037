"""Vector bin packing of token sequences (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import claim, slices, steady, table, text_bytes, trim
from .tokens import CACHE_PIECES, TEXT_BYTES, encoder, ended, public_path

#: Tokens that a task gathers before it packs; what doesn't fill a sequence waits for the next window.
WINDOW_TOKENS = 1 << 20


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most."""

    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens) < 1:
            raise ValueError("limits of a sequence are 1 at least")


def fill(tokens: np.ndarray, loss_from: np.ndarray, limits: Limits, last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Packs items (ids in a document: those before loss_from bear no loss) into sequences of (item, start, length).

    One sequence is open at a time. It takes the item that fits with the largest dot product of demand and
    room left, each as a share of the limits, ties to the earlier item. When none fits, a cut of the item with
    the largest product fills it, so a sequence ends below its token limit only where another limit binds or the
    items run out. Returns the sequences, and (item, start) of what is left over for the next window
    (nothing if last)."""
    begin = np.zeros(len(tokens), np.int64)
    rest = tokens.astype(np.int64).copy()
    caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    out: list[list[tuple[int, int, int]]] = []
    live = np.flatnonzero(rest > 0)
    for i in live[rest[live] >= limits.tokens]:  # whole sequences of one long document
        while rest[i] >= limits.tokens and min(limits.tokens, rest[i]) - max(0, min(limits.tokens, loss_from[i] - begin[i])) <= limits.loss_tokens:
            out.append([(int(i), int(begin[i]), limits.tokens)])
            begin[i] += limits.tokens
            rest[i] -= limits.tokens
    live = live[rest[live] > 0]
    demand = np.stack([rest, np.ones_like(rest), rest - np.clip(loss_from - begin, 0, rest)], axis=1) / caps
    total = int(rest[live].sum())
    while len(live) and (last or total >= 2 * limits.tokens):
        room, seq = np.ones(3), []
        while len(live):
            need = demand[live]
            score = need @ room
            score[(need > room + 1e-12).any(axis=1)] = -1.0
            best = int(score.argmax())
            if score[best] < 0:
                left = round(room[0] * caps[0]), round(room[1] * caps[1]), round(room[2] * caps[2])
                if left[0] < 1 or left[1] < 1:
                    break
                best = int((need @ room).argmax())
                i = int(live[best])
                free = max(0, int(loss_from[i] - begin[i]))
                cut = min(left[0], free + left[2], int(rest[i]))
                if cut < 1:
                    break
            else:
                i, cut = int(live[best]), int(rest[live[best]])
            bears = cut - min(cut, max(0, int(loss_from[i] - begin[i])))
            seq.append((i, int(begin[i]), cut))
            room = room - np.array([cut, 1, bears]) / caps
            begin[i] += cut
            rest[i] -= cut
            total -= cut
            if rest[i]:
                demand[i] = np.array([rest[i], 1, rest[i] - min(rest[i], max(0, loss_from[i] - begin[i]))]) / caps
            else:
                live = np.delete(live, best)
            if room[0] * caps[0] < 0.5:
                break
        out.append(seq)
    return out, [(int(i), int(begin[i])) for i in live]


OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(docs: DataFrame, path: str, end_id: int = 1, limits: Limits = Limits(), prompt_tokens: str | None = None, pieces: int = CACHE_PIECES, text_size: int = TEXT_BYTES) -> DataFrame:
    """Pieces of documents in sequences: one row a piece, with its ids (unsigned 32-bit, little-endian).

    docs has doc_id and text, and may have a column that counts the leading tokens without loss (instruction
    data). Each document is its ids and end_id; a null or empty text is end_id alone; a null prompt count is 0.
    Equal rows are packed each for itself; an empty table gives an empty result; other columns are not read.
    Each task packs its own rows in windows of bounded size, without a shuffle; sequence_id holds the task's
    number in its upper half, so sequences of different tasks never mix. The last sequence of a task is short.
    pieces: encoded pieces that a worker keeps, and text_size: bytes of text encoded at once, for speed alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(path, pieces)
        number, held, count = TaskContext.get().partitionId() << 32, [], 0

        def close(last: bool):
            nonlocal number, held, count
            seqs, left = fill(np.array([len(x[1]) - x[3] for x in held], np.int64), np.array([x[2] - x[3] for x in held], np.int64), limits, last)
            cols: list[list] = [[] for _ in range(8)]
            for seq in seqs:
                at = 0
                for i, start, length in seq:
                    doc, ids, free, off = held[i]
                    begin = off + start
                    row = (doc, begin, length, ids[begin : begin + length].astype("<u4").tobytes(), len(ids), number, at, length - min(length, max(0, free - begin)))
                    for c, v in zip(cols, row):
                        c.append(v)
                    at += length
                number += 1
            held = [(*held[i][:3], held[i][3] + start) for i, start in left]
            count = sum(len(x[1]) - x[3] for x in held)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in OUT.split(", ")])

        for batch in batches:
            _, at = text_bytes(batch.column(1))
            for a, b in slices(at, text_size):
                part = batch.slice(a, b - a)
                ids, bounds = ended(*enc.column(part.column(1)), end_id)
                for doc, i, j, free in zip(part.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist(), part.column(2).to_pylist()):
                    held.append((doc, ids[i:j], free or 0, 0))
                    count += j - i
                if count >= WINDOW_TOKENS:
                    yield close(False)
        yield close(True)
        if pieces < CACHE_PIECES:  # beside other stages an encoder would wait in memory for a task that may never come
            claim("packing")
            trim()

    free = F.col(prompt_tokens).cast("long") if prompt_tokens else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), free.alias("free")).mapInArrow(run, OUT)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents; the cases of pack()."""
    out = pack(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), text_size=2 * TEXT_BYTES)  # no other stage needs the memory
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, the pipeline's last stage; the cases of pack(). Workers that other stages use too keep fewer
    encoded pieces."""
    steady(spark)
    out = pack(docs, public_path("byte_bpe_50k.json"), pieces=CACHE_PIECES // 8)
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
