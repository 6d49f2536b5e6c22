"""Article scans (CSV with or without BOM, JSON lines) and the spreadsheet-safe CSV sink."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from statproof.functions import lexicon as lx
from statproof.functions.scale import with_row_number
from statproof.sources.split_csv import read_csv_splits


def resolve_headers(raw: DataFrame) -> DataFrame:
    """Map known header aliases to title, date, section, url, body, label; the first alias with a value wins."""
    present = set(raw.columns)

    def pick(field: str):
        found = [F.col(f"`{a}`").cast("string") for a in lx.FIELD_ALIASES[field] if a in present]
        value = F.coalesce(*found, F.lit(""))
        return value.alias(field) if field == "body" else F.trim(value).alias(field)
    keep = ["row_no"] if "row_no" in present else []
    return raw.select(*keep, *[pick(f) for f in lx.FIELD_ALIASES])


def read_articles(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Read a CSV or JSONL dataset (`csv`: one task a file; `csv_splits`: one task a split).  `row_no` keeps the row order of the source whatever split a file lands in: file,
    first byte of the split, position; its text sorts in that order."""
    kind = kind or ("csv" if path.rstrip("/").endswith("csv") else "jsonl")
    if kind == "csv_splits":
        return resolve_headers(read_csv_splits(spark, path))
    if kind == "csv":
        raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
        raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    elif kind == "jsonl":
        raw = spark.read.json(path, primitivesAsString=True)
    else:
        raise ValueError(f"unsupported format: {kind}")
    place = F.concat_ws("#", "_metadata.file_path", F.lpad(F.col("_metadata.file_block_start").cast("string"), 15, "0"),
                        F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0"))
    return resolve_headers(raw.withColumn("row_no", place))


def spreadsheet_safe(df: DataFrame) -> DataFrame:
    """Prefix an apostrophe where a spreadsheet would run a formula or trip over a leading control character."""
    def safe(f):
        c = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, StringType):
            return c
        risky = c.rlike(r"^[\s\x00-\x1f]*[=+\-@]") | c.rlike(r"^[\t\r\n]")
        return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c).alias(f.name)
    return df.select(*[safe(f) for f in df.schema.fields])


def write_safe_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    spreadsheet_safe(df).write.mode(mode).csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                              ignoreTrailingWhiteSpace=False)


def export_size(df: DataFrame, max_rows: int, max_bytes: int) -> DataFrame:
    """One row: rows, bytes of the CSV body, and whether the export may run."""
    text = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    size = df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0)).alias("n_bytes"))
    return size.withColumn("allowed", (F.col("n_rows") <= max_rows) & (F.col("n_bytes") <= max_bytes))


def bounded_export(df: DataFrame, order: list, max_rows: int = 50_000, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """Newest-first export rows; running it fails when the result is larger than allowed (nothing is cut off)."""
    safe = spreadsheet_safe(df)
    ok = export_size(safe, max_rows, max_bytes).select("allowed").scalar()
    guard = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("export exceeds the row or byte limit")).cast("boolean"))
    return safe.where(guard).orderBy(*order)


def export_parts(df: DataFrame, key: str, order: list, max_rows: int = 50_000, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """Every export row with the file it belongs to (`part`, from 0): a table beyond the limits of one export leaves whole, in
    several files.  Files follow the order of the unique numeric `key`, rows inside a file stand in `order`.  A file holds as
    many rows as fit both limits at the size of the largest row; a single row beyond the byte limit is an error."""
    safe = spreadsheet_safe(df)
    text = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns])
    largest = safe.agg(F.coalesce(F.max(F.octet_length(text) + 1), F.lit(1)).alias("n")).scalar()
    rows = F.least(F.lit(max_rows), F.floor(F.lit(max_bytes) / largest))
    rows = F.when(rows >= 1, rows).otherwise(F.raise_error(F.lit("a row exceeds the byte limit")).cast("long"))
    return with_row_number(safe, key, "_row").withColumn("part", F.floor((F.col("_row") - 1) / rows)).drop("_row").orderBy("part", *order)
