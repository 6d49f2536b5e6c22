"""Exact deduplication with an extendible-hash index on shared files.

1. *Log*: each Arrow batch is collapsed to one representative per distinct text (hash, then byte comparison), so a
   text that fills a third of the table reaches its owner at most once per batch.  Only representatives keep a text.
2. *Directory*: a histogram of the first `DIRECTORY_BITS` hash bits (bounded, 4,096 rows) drives extendible hashing:
   an overfull bucket splits on its next bit, doubling the directory when it is as deep as the directory.
3. *Owners*: neighbouring buckets form a key range per owner task.  Inside, rows are ordered by hash; rows of one hash
   form a chain of different texts, told apart by their bytes.  The index entries are written to the shared folder.
4. The log meets the index on the representative: every row learns the row that stays.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import partitions, slices, written

DIRECTORY_BITS = 12
BUCKET_ROWS = 20_000
SPACE = r"[\x20\x09-\x0D]+"
_SPACE = re.compile(SPACE)


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE, " ")


def _norm(text: str | None) -> str:
    return _SPACE.sub(" ", text or "")


def directory(counts: dict[int, int], capacity: int, bits: int = DIRECTORY_BITS) -> list[int]:
    """Extendible hashing over a histogram of hash prefixes: bucket number of each of the 2**depth entries.
    Buckets are numbered in key order.  A bucket that is overfull at full depth stays: its owner chains."""
    load = [0] * (1 << bits)
    for prefix, n in counts.items():
        load[prefix] += n
    depth, table, local = 0, [0], {0: 0}
    open_ = [(0, 0)]  # bucket, its first prefix
    while open_:
        bucket, first = open_.pop()
        width = 1 << (bits - local[bucket])
        if sum(load[first:first + width]) <= capacity or local[bucket] == bits:
            continue
        if local[bucket] == depth:
            table, depth = [b for b in table for _ in range(2)], depth + 1
        twin = len(local)
        local[bucket] = local[twin] = local[bucket] + 1
        half = first + width // 2
        for entry in range(half >> (bits - depth), (first + width) >> (bits - depth)):
            table[entry] = twin
        open_ += [(bucket, first), (twin, half)]
    order = {b: i for i, b in enumerate(dict.fromkeys(table))}
    return [order[b] for b in table]


def owners(table: list[int], counts: dict[int, int], tasks: int, bits: int = DIRECTORY_BITS) -> list[int]:
    """Owner task of each directory entry: contiguous ranges of buckets with about equal loads."""
    step, load = (1 << bits) // len(table), {}
    for prefix, n in counts.items():
        load[table[prefix // step]] = load.get(table[prefix // step], 0) + n
    total, seen, owner = max(1, sum(load.values())), 0, {}
    for b in sorted(set(table)):
        owner[b] = min(tasks - 1, seen * tasks // total)
        seen += load.get(b, 0)
    return [owner[b] for b in table]


def _lookup(values: list[int], index: Column) -> Column:
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>"), (index + 1).cast("int"))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, texts, hashes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_key", "_row", "_text", "_hash"))
        chains: dict[int, list[list[int]]] = {}
        for i, h in enumerate(hashes):
            for group in chains.setdefault(h, []):
                if _norm(texts[group[0]]) == _norm(texts[i]):
                    group.append(i)
                    break
            else:
                chains[h].append([i])
        rep, copies = [0] * len(rows), [None] * len(rows)
        for group in (g for chain in chains.values() for g in chain):
            first = min(group, key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))
            copies[first] = len(group)
            for i in group:
                rep[i] = rows[first]
        at = batch.schema.get_field_index("_text")
        shown = pa.array([t if n else None for t, n in zip(texts, copies)], batch.schema.field(at).type)
        columns = [shown if i == at else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(rep, pa.int64()), pa.array(copies, pa.int64())], names=[*batch.schema.names, "_rep", "_copies"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by hash, then key: the first row of a text is the one that stays."""
    names = ["_rep", "_keep", "keep_id", "group_size", "_link"]
    out: list[tuple] = []

    def entries(chain):
        return [(rep, g[1], g[2], g[3], link) for link, g in enumerate(chain) for rep in g[4]]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=names)
    current, chain = None, []
    for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
        for h, key, row, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
            if h != current:
                out += entries(chain)
                current, chain = h, []
            body = _norm(text)
            for group in chain:
                if group[0] == body:
                    group[3] += copies
                    group[4].append(row)
                    break
            else:
                chain.append([body, row, key, copies, [row]])
        if len(out) >= 10_000:
            yield table(out)
            out = []
    yield table(out + entries(chain))


def marked(df: DataFrame, key: str = "doc_id", text: str = "text", hashed: Column | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every input row: `_key`, `_text`, `_rest` (its other columns), `keep_id`, `group_size`, `kept`, `text_sha256`.

    Null texts count as empty and equal one another and the empty text.  Of equal texts the smallest key stays (null
    keys last); of rows that share text and key exactly one stays.  `_text` is null in rows that are not the first of
    their batch, so read it from kept rows only.  An empty table gives no rows.  Other columns may have any names.
    `hashed` replaces the 64-bit hash of the normalised text."""
    spark = df.sparkSession
    others = [F.col(f"`{c}`") for c in df.columns if c not in (key, text)] or [F.lit(0).alias("none")]
    rows = (df.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"), F.struct(*others).alias("_rest"))
            .withColumn("_row", F.monotonically_increasing_id()).withColumn("_norm", normalised("_text"))
            .withColumn("text_sha256", F.sha2("_norm", 256)).withColumn("_hash", F.xxhash64("_norm") if hashed is None else hashed).drop("_norm"))
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema] + [StructField("_rep", LongType()), StructField("_copies", LongType())])
    log = written(rows.mapInArrow(_collapse, schema), "dedup-log")
    firsts = log.where("_copies is not null")
    prefix = F.shiftrightunsigned("_hash", 64 - DIRECTORY_BITS)
    counts = {r[0]: r[1] for r in firsts.groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 4,096 rows
    tasks = partitions(spark)
    table = directory(counts, max(1, min(bucket_rows, sum(counts.values()) // (4 * tasks))))
    entry = F.shiftrightunsigned("_hash", 64 - (len(table).bit_length() - 1)) if len(table) > 1 else F.lit(0)
    owned = (firsts.withColumn("_owner", _lookup(owners(table, counts, tasks), entry))
             .select("_owner", "_hash", "_key", "_row", "_copies", "_text")
             .repartitionById(tasks, F.col("_owner"))
             .sortWithinPartitions("_hash", F.col("_key").asc_nulls_last(), "_row").drop("_owner"))
    index = written(owned.mapInArrow(_chains, "_rep long, _keep long, keep_id long, group_size long, _link long"), "dedup-index")
    return (log.join(index.drop("_link"), "_rep").withColumn("kept", F.col("_row") == F.col("_keep"))
            .select("_key", "_text", "_rest", "keep_id", "group_size", "kept", "text_sha256"))


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256 (see `marked`)."""
    return marked(df.select(key, text), key, text).select(F.col("_key").alias(key), "keep_id", "group_size", "kept", "text_sha256")


def distinct_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of the input."""
    named = {key: F.col("_key").alias(key), text: F.col("_text").alias(text)}
    return marked(df, key, text).where("kept").select(*[named.get(c, F.col("_rest").getField(c).alias(c)) for c in df.columns])
