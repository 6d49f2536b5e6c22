"""Tables that several jobs of one operator read: written once to the folder all executors share."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from statproof.functions.scale import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: later jobs neither recompute it nor depend on one executor."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` written once with a unique row number `_row`.  The numbers are stored, so every later job sees the same
    ones, whatever is recomputed; rows that are equal in all columns keep different numbers."""
    return written(df.withColumn("_row", F.monotonically_increasing_id()), name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SLICE = 1 << 22  # bytes of text or sets taken from an Arrow batch at a time


def slices(batch: pa.RecordBatch, at: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices of some `size` bytes of its column `at` (text or binary), one row at least: a task holds the
    Python values of little more than one slice besides the batch.  Unused memory of Arrow goes back after the last one."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, side="right")))
        yield batch.slice(first, last - first)
        first = last
    pa.default_memory_pool().release_unused()


BITMAP = 1 << 20  # bits


def bitmap(df: DataFrame, column: str) -> Column:
    """A bitmap of fixed size (128 KB) of the hashes of a column, as a scalar for filters before an exact join: it lets
    every value of the column through, and others only where hashes agree."""
    at = F.pmod(F.xxhash64(column), F.lit(BITMAP))
    words = (df.where(F.col(column).isNotNull()).select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, int(pmod(xxhash64({column}), 64)))").alias("b"))
             .groupBy("w").agg(F.bit_or("b").alias("b")))
    every = df.sparkSession.range(0, BITMAP // 64, 1, 1).withColumnRenamed("id", "w").join(words, "w", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))), lambda x: x["b"]).alias("bits")).scalar()


def in_bitmap(bits: Column, value: Column) -> Column:
    at = F.pmod(F.xxhash64(value), F.lit(BITMAP))
    return F.coalesce(F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1, F.lit(False))
