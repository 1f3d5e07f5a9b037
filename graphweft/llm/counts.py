"""Token counts through a digest cache (operator 8)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, slices, table, text_bytes, written
from .tokens import TEXT_BYTES, encoder, kind, public_path

CACHE = "version string, digest binary, n_tokens long"

#: A digest is hot above this share of all rows, so fewer than 1 / SHARE are; each hot one is dealt in SALTS parts.
SHARE, SALTS = 1 / 512, 64


def version(path: str) -> str:
    """Digest of a tokenizer's file: counts of another file are never taken."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def normalised(text: Column, path: str) -> Column:
    """A form of the text with the same number of tokens. For tokenizers that lower-case and drop white space: ASCII
    letters lower-cased and runs of ASCII white space as one space, unless a special token may be in the text.
    For all others the text itself."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if kind(spec) == "word ends" and all("<" in t["content"] for t in spec["added_tokens"]):
            same = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            return F.when(text.contains("<"), F.concat(F.lit("="), text)).otherwise(F.concat(F.lit("~"), F.trim(F.regexp_replace(same, "[ \\x09-\\x0D]+", " "))))
    return text


def counted(docs: DataFrame, path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; new counts are appended to the cache at cache_path.

    Each distinct digest that the cache lacks is encoded and appended once, from the text with the smallest doc_id. A null or
    empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows each give a row; an empty table gives
    an empty result and appends nothing; other columns are not read. Digests are made once, and shuffled with map-side
    combining; texts are shuffled once, to meet the keys (doc_id and a short hash) of those to encode."""
    spark = docs.sparkSession
    tag = version(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("th", F.xxhash64("text", F.col("doc_id").isNull()))
    digest = F.unhex(F.sha2(normalised(F.col("text"), path), 256))
    keys = written(rows.select("doc_id", "id", "th", F.octet_length("text").cast("long").alias("n_bytes"), digest.alias("digest")), "digests")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == tag).dropDuplicates(["digest"]).select("digest", "n_tokens")
    misses = keys.groupBy("digest").agg(F.min(F.struct("id", "th")).alias("of")).join(cache, "digest", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            _, at = text_bytes(batch.column(1))
            for a, b in slices(at, TEXT_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(enc.lengths(part.column(1)))], names=["digest", "n_tokens"])

    chosen = misses.select("of.id", "of.th", "digest")
    texts = rows.dropDuplicates(["id", "th"]).join(chosen.hint("merge"), ["id", "th"])  # chosen grows with the data: never broadcast
    new = texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")
    new.select(F.lit(tag).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    now = spark.read.schema(CACHE).parquet(cache_path).where(F.col("version") == tag).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    hot = keys.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") > max(1, keys.count() * SHARE)).select("digest", F.lit(True).alias("hot"))
    hot = F.broadcast(hot)  # fewer than 512 rows at every size
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "n_bytes"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    parts = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    now = now.join(hot, "digest", "left").select("digest", "n_tokens", F.explode(parts).alias("part"))
    out = keys.join(hot, "digest", "left").withColumn("part", part).join(now, ["digest", "part"], "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; the cases of counted(). The cache of a table is found again by the table's folder, so a
    second run over it encodes what is new only."""
    of = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:32]
    return counted(table(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), f"{shared_dir(spark)}/graphweft/counts-{of}")
