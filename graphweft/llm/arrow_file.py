"""Equal-length token sequences and masks in Arrow files, read back without copies (operator 7)."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_path, slices, table, text_bytes
from .tokens import TEXT_BYTES, encoder, ended, public_path

#: Ids in a sequence, and sequences in a record batch.
SEQUENCE, BATCH = 2048, 256


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([pa.field("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), pa.field("mask", pa.list_(pa.bool_(), length))])


def _batch(ids: np.ndarray, length: int) -> pa.RecordBatch:
    """Whole sequences; the last is filled with 0 under a false mask."""
    n = -(-len(ids) // length) * length
    mask = np.zeros(n, bool)
    mask[: len(ids)] = True
    full = np.zeros(n, ids.dtype)
    full[: len(ids)] = ids
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(full), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=_schema(ids.dtype, length))


class _Writer:
    """A file in the shared folder, under a name of its own for each attempt: a repeated task leaves the first one's files alone."""

    def __init__(self, folder: str, name: str, schema: pa.Schema):
        self.at, inner = filesystem(folder)
        self.at.create_dir(inner, recursive=True)
        self.path = f"{folder}/{name}"
        self.sink = self.at.open_output_stream(f"{inner}/{name}")
        self.file = pa.ipc.new_file(self.sink, schema)

    def close(self) -> None:
        self.file.close()
        self.sink.close()


def write(docs: DataFrame, path: str, folder: str, end_id: int = 1, length: int = SEQUENCE) -> DataFrame:
    """Writes ids of documents, each followed by end_id, and returns the manifest: one row a shard, in order.

    Documents are dealt by range of doc_id and sorted, nulls first; a shard is one contiguous stream of ids, cut
    into sequences of equal length in an Arrow file (type: the smallest that holds the vocabulary), and a second
    Arrow file has each document's place in that stream. Null or empty texts are end_id alone; rows with the
    same doc_id are ordered by their text; an empty table gives an empty manifest; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc, tag = encoder(path), uuid.uuid4().hex
        ids = index = None
        held: list[np.ndarray] = []
        count = tokens = documents = 0
        step = length * BATCH
        for batch in batches:
            _, at = text_bytes(batch.column(1))
            for a, b in slices(at, TEXT_BYTES):
                part = batch.slice(a, b - a)
                flat, bounds = ended(*enc.column(part.column(1)), end_id)
                if ids is None:
                    ids = _Writer(folder, f"{shard:06d}-{tag}.arrow", _schema(enc.dtype, length))
                    index = _Writer(folder, f"{shard:06d}-{tag}.index.arrow", pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
                sizes, starts = np.diff(bounds), tokens + bounds[:-1]
                index.file.write_batch(pa.RecordBatch.from_arrays([part.column(0), pa.array(starts), pa.array(sizes)], names=["doc_id", "start", "n_tokens"]))
                tokens, documents, count = tokens + len(flat), documents + len(sizes), count + len(flat)
                held.append(flat)
                if count >= step:
                    flat = np.concatenate(held)
                    whole = len(flat) // step * step
                    for i in range(0, whole, step):
                        ids.file.write_batch(_batch(flat[i : i + step], length))
                    held, count = [flat[whole:]], len(flat) - whole
        if ids is not None:
            if count:
                ids.file.write_batch(_batch(np.concatenate(held), length))
            ids.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "ids_file": [ids.path], "index_file": [index.path], "documents": [documents], "tokens": [tokens]}, schema=pa.schema([("shard", pa.int64()), ("ids_file", pa.string()), ("index_file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    schema = "shard long, ids_file string, index_file string, documents long, tokens long"
    done = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema).collect()  # a few rows a shard: a list of files
    base, listed = 0, []
    for r in sorted(done, key=lambda r: r["shard"]):
        listed.append((*r, base))
        base += r["tokens"]
    return spark.createDataFrame(listed, schema + ", base long")


def opened(path: str) -> pa.RecordBatchFileReader:
    """Random access to a file's batches: mapped into memory where it is local."""
    at, inner = filesystem(path)
    return pa.ipc.open_file(pa.memory_map(inner) if isinstance(at, pafs.LocalFileSystem) else at.open_input_file(inner))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (unsigned 32-bit little-endian binary) of each document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, index = opened(row["ids_file"]), opened(row["index_file"])
                length = ids.schema.field("ids").type.list_size
                step, held = length * BATCH, {}

                def stream(a: int, b: int) -> np.ndarray:
                    parts = []
                    for k in range(a // step, (b - 1) // step + 1):
                        if k not in held:
                            for old in [x for x in held if x < a // step]:
                                del held[old]
                            held[k] = ids.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
                        parts.append(held[k][max(0, a - k * step) : b - k * step])
                    return parts[0] if len(parts) == 1 else np.concatenate(parts)

                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    start, size = part.column(1).to_numpy(), part.column(2).to_numpy()
                    got = [stream(a, a + n).astype("<u4").tobytes() for a, n in zip(start.tolist(), size.tolist())]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(start + row["base"]), part.column(2), pa.array(got, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    shards = manifest.sparkSession.createDataFrame(manifest.collect(), manifest.schema)
    n = max(1, shards.count())
    return shards.repartition(n, F.col("shard")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def sequence(manifest_row: dict, number: int) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of a shard and its mask."""
    file = opened(manifest_row["ids_file"])
    row = file.get_batch(number // BATCH).slice(number % BATCH, 1)
    return row.column(0).flatten().to_numpy(zero_copy_only=True), row.column(1).flatten().to_numpy(zero_copy_only=False)


def op7_arrow_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents as read back from the files; the cases of write()."""
    manifest = write(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), fresh_path(spark, "arrow"))
    return read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
