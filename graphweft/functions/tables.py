"""Tables that a plan reads several times, stored once in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STORED: list[str] = []
_TABLES: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local session, as in tests, gets one of this machine; on a cluster,
    whose executors could not see that, it raises."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="graphweft-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Spark's setting that deletes what a query shuffled as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _swept(spark: SparkSession):
    """What is written within leaves no shuffle files behind: else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in that folder: joins of several hops then scan it instead of building it for each hop, and it outlives a
    lost executor."""
    spark = df.sparkSession
    path = f"{folder(spark)}/graphweft/{name}-{uuid.uuid4().hex}"
    with _swept(spark):
        df.write.option("compression", "zstd").parquet(path)
    _STORED.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = (None, path)
    return out


#: Bytes of rows, as Spark estimates them, that a large table deals at once, and the most parts that it is dealt in: a part's shuffle
#: files are gone before the next one's.
DEALT, PARTS = 256 << 20, 6


def parts_of(df: DataFrame) -> int:
    """How many parts a table is dealt in."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // DEALT)))


def part(key: str, buckets: int, parts: int) -> Column:
    """The part that holds a key's bucket."""
    return F.pmod(F.pmod(F.hash(key), F.lit(buckets)), F.lit(parts))


#: Bits of a filter of keys, as a power of two: eight for each key between these limits; and those of one of its rows.
BITS, ROW_BITS = (16, 26), 15


def key_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """What may_hold() looks in: a bit for each of 2^bits hashes of a key, in rows (block, words); and bits. 8 MB at most, which is broadcast."""
    spark, n = keys.sparkSession, keys.count()
    bits = max(BITS[0], min(BITS[1], (8 * n).bit_length()))
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    x = keys.where(F.col(key).isNotNull()).select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    x = x.select("word", F.expr("shiftleft(1L, bit)").alias("bits")).unionAll(spark.range(1 << (bits - 6)).select("id", F.lit(0).cast("long")))
    x = x.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])
    return stored(x.groupBy(F.shiftright("word", ROW_BITS - 6).alias("block")).agg(words.alias("words")), "filter"), bits


def may_hold(df: DataFrame, key: str, keys: tuple[DataFrame, int], name: str | None = None) -> DataFrame:
    """Rows of df whose key may be one of key_filter()'s, by hash: all that are, and some others. name: all rows, and a column that says so."""
    rows, bits = keys
    place = F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    x = df.join(F.broadcast(rows), F.shiftright(place, ROW_BITS) == F.col("block"))
    word = F.get("words", F.shiftright(place, 6).bitwiseAND(F.lit((1 << ROW_BITS - 6) - 1)).cast("int"))
    yes = F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1
    return x.where(yes).drop("block", "words") if name is None else x.withColumn(name, yes).drop("block", "words")


def _new_table(spark: SparkSession, name: str) -> tuple[str, str]:
    table, path = f"graphweft_{name}_{uuid.uuid4().hex}", f"{folder(spark)}/graphweft/{name}-{uuid.uuid4().hex}"
    _STORED.append(path)
    _TABLES.append(table)
    return table, path


def _add(rows: DataFrame, key: str, buckets: int, table: str, path: str, made: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    spark = rows.sparkSession
    with _swept(spark):
        made(rows.repartition(buckets, key)).write.mode("append").option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    out.stored_at, out.buckets = (table, path), buckets
    return out


def bucketed(df: DataFrame, key: str, name: str, made: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """stored() by hash of a column: joins on it scan the buckets side by side and shuffle only what they join. Large tables are dealt
    in parts of the buckets, each from all rows of df that belong there. made: what becomes of rows, which lie by key then."""
    spark = df.sparkSession
    n, parts, at = int(spark.conf.get("spark.sql.shuffle.partitions")), parts_of(df), _new_table(spark, name)
    for i in range(parts):
        out = _add(df if parts == 1 else df.where(part(key, n, parts) == i), key, n, *at, made)
    return out


def dealt(df: DataFrame, key: str, name: str) -> list[DataFrame]:
    """bucketed() with a table for each part, so that it can go as soon as it has been read: the i-th has the keys of part() i."""
    spark = df.sparkSession
    n, parts = int(spark.conf.get("spark.sql.shuffle.partitions")), parts_of(df)
    return [_add(df if parts == 1 else df.where(part(key, n, parts) == i), key, n, *_new_table(spark, name)) for i in range(parts)]


def forget(df: DataFrame) -> None:
    """Deletes a stored() or bucketed() table that no plan reads any more."""
    spark, (table, path) = df.sparkSession, df.stored_at
    if table is not None:
        spark.sql(f"drop table if exists {table}")
        _TABLES.remove(table)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _STORED.remove(path)


def clear(spark: SparkSession) -> int:
    """Deletes what this process has stored, when no plan reads it any more; returns how many tables went."""
    jvm, n = spark.sparkContext._jvm, 0
    while _TABLES:
        spark.sql(f"drop table if exists {_TABLES.pop()}")
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n
