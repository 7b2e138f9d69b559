"""Small helpers the operators share: words, batches, intermediate tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meterbook.session import scratch_path

ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# rows of one Arrow batch: a few MB of usual texts, and one very long text does not pull thousands of others with it
BATCH_ROWS = "512"
#: Bits of the filters that are sent to tasks (8 MB).
FILTER_BITS = 1 << 26
#: A written table of more rows is never broadcast; one of half as many, of a few numbers each, was a hash table of 17 MB.
BROADCAST_ROWS = 500_000


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of the Python tasks: batches small enough for executors with little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def split_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 text: ``bytes.split`` cuts at exactly these six bytes."""
    return data.split()


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8, null as empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [t or b"" for t in column.to_pylist()]


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    prepare(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        return_memory()

    return df.mapInArrow(task, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder; it is compressed and outlives its executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_rows(df: DataFrame) -> DataFrame:
    """A written table for a join, shuffled if it has many rows: Spark goes by the size of its files, which are packed."""
    return df.hint("merge") if df.count() > BROADCAST_ROWS else df


def small_side(df: DataFrame) -> DataFrame:
    """A written table for a join with rows that Spark cannot size, as after an explode: it is broadcast if it has few rows, the other side never is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("merge")


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of frames that are gone; it does so when it collects garbage, which may be much later."""
    gc.collect()
    spark._jvm.System.gc()


def return_memory() -> None:
    """Give the memory that a Python task has freed back to the system (Arrow's, and with glibc the rest): Spark keeps its worker, idle, beside the tasks that come next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bitmap_of(values: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of the values (one bigint column, evenly spread) by their low bits; ``bits / 8`` bytes whatever the table holds.

    As a filter it lets more pass the fuller it gets, and never drops a value of the table.
    """
    at = F.col(values.columns[0]).bitwiseAND(F.lit(bits - 1))
    packed = values.select(F.shiftright(at, 15).alias("bucket"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    # one row of 4 KB for each 32768 bits, made before the shuffle
    rows = packed.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap")).collect()
    out = np.zeros((max(bits >> 15, 1), 4096), np.uint8)
    for row in rows:
        out[row.bucket] = np.frombuffer(row.bitmap, np.uint8)
    return out.ravel()


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether values (64 bits each) may be in the table of a bitmap."""
    at = values.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def having(df: DataFrame, key: str, wanted: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``df`` with a wanted key (one column), and perhaps some others: a filter before wide rows are shuffled for a join."""
    names = df.columns
    held = df.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(F.xxhash64(wanted.columns[0]).alias("h")), bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = in_bitmap(held.value, batch.column(len(names)).to_numpy())
            yield batch.select(names).filter(pa.array(keep))

    return map_batches(df.select("*", F.xxhash64(key).alias("__h")), work, df.schema)


def words(text: Column) -> Column:
    """Array of words ``[^\\x20\\x09-\\x0D]+``; null and empty texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda variable is bound, a repeated column expression is not."""
    return F.transform(F.array(value), body)[0]
