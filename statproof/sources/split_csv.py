"""Quoted CSV with line breaks inside values, read in as many tasks as its files have splits.

A line break ends a record only outside quotes, and whether a split begins inside quotes depends on all quotes before it.
The first pass counts quotes per split (one small row each); sums over the splits of a file give every split its start.
The second pass cuts records inside each split.  Only the pieces at split edges are shuffled and joined again; they are
found by a scan of their own, which costs less than a stored copy of the texts.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from statproof.functions.scale import stable

_SPLIT = ["file", "block"]
_LIMIT = 1_000_000  # splits that begin inside quotes and are still broadcast: 17 bytes each
_PIECES = "file string, block long, pos long, edge string, head boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the split they begin in; `\\r` stays, because it may belong to a value."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("pos"), "value")


def _starts(lines: DataFrame) -> DataFrame:
    """(file, block) of the splits that begin inside quotes: an odd number of quotes stands before them in their file."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.pmod(F.coalesce(F.sum("n").over(before), F.lit(0)), F.lit(2)) == 1
    return (lines.groupBy(*_SPLIT).agg(F.sum(quotes).alias("n")).withColumn("inside", odd).where("inside").select(*_SPLIT, "inside"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines in file order -> whole records, and the pieces of records that cross an edge of their split: `end` closes a
    record of an earlier split, `middle` lies wholly inside one, `begin` is closed by a later split."""
    split, held, out = None, [], []
    inside = first = head = False

    def close(edge: str | None):
        nonlocal head
        out.append((*split, held[0][0], edge, head, "\n".join(v for _, v in held)))
        held.clear()
        head = False
    for batch in batches:
        for file, block, pos, value, starts_inside in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != split:
                if held:
                    close("middle" if first else "begin")
                split, inside, head = (file, block), bool(starts_inside), block == 0
                first = inside
            held.append((pos, value))
            if value.count('"') % 2:
                inside = not inside
            if not inside:
                close("end" if first else None)
                first = False
        if len(out) >= 4096:
            yield _batch(out)
            out.clear()
    if held:
        close("middle" if first else "begin")
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)],
                                      names=["file", "block", "pos", "edge", "head", "record"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, pos, head, record): every record's text with the place of its first line; sorted by them it is the
    order of the source; `head` marks the first record of a file.  An unclosed quote makes one record of the rest of its
    file, as in any CSV reader."""
    lines = _lines(spark, path)
    starts = stable(_starts(lines))
    if starts.count() <= _LIMIT:
        placed = lines.join(F.broadcast(starts), _SPLIT, "left")
    else:
        placed = lines.join(starts, _SPLIT, "left").repartition(*_SPLIT).sortWithinPartitions(*_SPLIT, "pos")
    pieces = placed.select("file", "block", "pos", "value", "inside").mapInArrow(_cut, _PIECES)
    order = Window.partitionBy("file").orderBy("block", "pos")
    # Keys alone decide which pieces belong together: the block of the last `begin` up to here.
    edges = pieces.where("edge IS NOT NULL")
    begun = F.struct(F.col("block").alias("b"), F.col("pos").alias("p"))
    at = F.last(F.when(F.col("edge") == "begin", begun), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    joined = (edges.withColumn("_at", at).groupBy("file", F.col("_at.b").alias("block"), F.col("_at.p").alias("pos"))
              .agg(F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct(F.col("block").alias("b"), F.col("pos").alias("p"), "record"))).alias("r"))
              .select("file", "block", "pos", "head", F.array_join(F.transform("r", lambda x: x["record"]), "\n").alias("record")))
    return pieces.where("edge IS NULL").drop("edge").unionByName(joined)


def read_csv_splits(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, plus `row_no`, the place in the source (its text sorts in that order).

    Every file begins with a header line.  `columns` names the fields; without it the first header is read.  Quotes are
    doubled inside quoted values.  Blank lines are no records; missing fields are null.  A lone quote inside an unquoted
    value is not allowed here, since it would open a quoted value: read such files with one task each instead."""
    if columns is None:
        columns = [c.lstrip("﻿") for c in spark.read.csv(path, header=True, quote='"', escape='"').columns]
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    found = records(spark, path)
    text = F.regexp_replace("record", r"\r$", "")
    body = found.where("NOT head").withColumn("record", text).where("record <> ''")
    place = F.concat_ws("#", "file", F.lpad(F.col("block").cast("string"), 15, "0"), F.lpad(F.col("pos").cast("string"), 19, "0"))
    parsed = F.from_csv("record", F.lit(schema), {"quote": '"', "escape": '"', "multiLine": "true"})
    return body.select(place.alias("row_no"), parsed.alias("c")).select("row_no", "c.*")
