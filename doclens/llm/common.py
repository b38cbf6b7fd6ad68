"""Session, storage and Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.session import import_path

#: Largest Arrow batch handed to a Python worker, so that a run of long texts does not fill its memory.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """To be called before a Python stage is planned."""
    import_path(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_temporary: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one temporary folder on a local master (tests); a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _temporary:
            _temporary.append(tempfile.mkdtemp(prefix="doclens-"))
        found = _temporary[0]
    return found


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd") if partition_by is None else df.write.option("compression", "zstd").partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path) if partition_by is None else spark.read.parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what cut() wrote for these frames. To be called once all that reads them has been written itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size of df, or a kilobyte a row where it has none. It sets numbers of partitions and buckets only, never results."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 56 else 1000 * df.count()


def buckets_for(df: DataFrame, bytes_each: int = 8 << 20, least: int = 8) -> int:
    return max(least, -(-estimated_bytes(df) // bytes_each))


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on and are shared with whatever runs next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


#: Of a key's rows, those with more than 1/HOT of all rows are hot; there are fewer than HOT such keys.
HOT = 1000


def look_up(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """rows (key never null) with the columns of facts (one row a key; `held` is its number of rows in rows), which every key has.

    The facts of hot keys, fewer than HOT whatever the input, are broadcast, so that their rows stay where they are; all others are shuffled.
    """
    hot = facts.filter(F.col("held") * HOT > total).drop("held")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.drop("held"), key))


#: Words of 64 bits in a filter, at most: its broadcast is bounded (2**20 rows of two longs) whatever the input.
FILTER_WORDS_LOG2 = 20


def mark_listed(rows: DataFrame, hashed: str, listed: DataFrame, n_listed: int, as_col: str) -> DataFrame:
    """rows with a boolean `as_col`: false only where the 64-bit hash in column `hashed` is not in `listed` (one column of that name).

    A Bloom filter of one bit a hash, in tables: words of 64 bits, four or so listed hashes a word, until the bound is met. Beyond it
    the filter lets more rows through, and the caller's exact join does more work, with the same result.
    """
    log2 = max(6, min(FILTER_WORDS_LOG2, (n_listed // 4).bit_length()))
    place = lambda c: F.shiftrightunsigned(c, 64 - log2)
    bit = lambda c: F.expr(f"shiftleft(1L, cast({c} & 63 AS int))")
    words = listed.select(place(hashed).alias("filter_word"), bit(f"`{hashed}`").alias("bit")).groupBy("filter_word").agg(F.bit_or("bit").alias("filter_bits"))
    joined = rows.join(F.broadcast(words), place(hashed) == F.col("filter_word"), "left")
    return joined.withColumn(as_col, F.coalesce(F.col("filter_bits").bitwiseAND(bit(f"`{hashed}`")) != 0, F.lit(False))).drop("filter_word", "filter_bits")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def crc_mod(name: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null stays null."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % F.lit(n)


def hash_share(*columns: Column | str) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.pmod(F.xxhash64(*columns, F.lit(77)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def share_for(wanted: int, there: int) -> float:
    """The share of `there` rows in which a sample of `wanted` is sought, so that what is sorted for it does not grow with the input."""
    return min(1.0, (wanted + 5 * wanted**0.5) / max(1, there))


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[], Callable[[pa.Array], pa.Array]]) -> DataFrame:
    """The rows of docs whose text the built predicate keeps; all columns pass through untouched."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predicate = keep()
        for batch in batches:
            yield batch.filter(predicate(batch.column(at)))
        give_back()

    return docs.mapInArrow(run, docs.schema)
