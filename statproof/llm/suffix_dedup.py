"""Removal of repeated byte strings by bucket-pointer refinement over sparse suffixes.

A suffix matters only where its first `WIDTH` bytes occur twice.  So suffixes are bucketed by a q-gram that every window
of `WIDTH` bytes chooses by content alone (the smallest hashed `GRAM` bytes in it): equal windows choose the same q-gram
at the same offset, and an anchor (a chosen q-gram) owns the run of windows that chose it.

1. Anchors shuffle on their q-gram bucket.  Bucket identifiers of doubled length come from those of half the length at a
   later offset (8, 16, 32, 64, 100 bytes), and the identifier of all bytes that an anchor's windows cover refines its
   bucket.  Buckets of one anchor are finished (nothing repeats).  An anchor that is not the first of its refined bucket
   is finished too: all its windows repeat.  So is the first one if its q-gram bucket holds no other refined bucket.
2. The rest, the first anchors of different surroundings of one q-gram, are refined to single windows.  In buckets of
   at most `WIDE` surroundings (some 70 KB) this is exact bucket-pointer refinement inside a task: ranks of 4 bytes, then
   of 8, 16, 32, 64 and 100 by sorting on the ranks at later offsets.  Larger buckets (a common line, a large group of
   near copies) are never gathered: they are refined on 128-bit identifiers built by the same doubling, first on the
   bytes that `GROUP` neighbouring windows have in common (where these occur once, none of the windows repeats), then
   on the windows; a task folds equal ones before they leave it, and minima are combined before the shuffle.
3. Repeated windows meet their document again and the covered bytes go.

Copies inside one task are folded before any shuffle, so a text or passage held by a third of the rows sends one anchor
per task and bucket.  Texts are kept once, compressed, in the shared folder.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .shared import numbered, partitions, written

WIDTH = 100
GRAM = 24
SPAN = WIDTH - GRAM       # a window holds SPAN + 1 q-grams
PIECE = 1 << 22           # windows of a document per array
FLUSH = 1 << 20           # anchors folded at once
HOT = 64                  # surroundings of one q-gram in one task
WIDE = 512                # surroundings of one q-gram that one task may refine
GROUP = 8                 # neighbouring windows refined together
CORE = WIDTH - GROUP + 1  # bytes they have in common
LAST = (1 << 63) - 1
OWN, SPREAD, MARKER, FOLDED = range(4)
FULL, OPEN, OPEN_WIDE = range(3)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifier of a longer string from those of its parts."""
    x = (a * _A ^ (b + _B)) * _C
    return x ^ (x >> np.uint64(31))


def _doubled(ids: np.ndarray, size: int, wanted: int) -> np.ndarray:
    """Identifiers of `wanted` bytes from those of `size` bytes, by doubling; the last step overlaps."""
    while size < wanted:
        step = min(size, wanted - size)
        ids, size = _join(ids[:-step], ids[step:]), size + step
    return ids


def _identifiers(raw: np.ndarray, seed: int, wanted: int) -> np.ndarray:
    return _doubled((raw.astype(np.uint64) + np.uint64(seed)) * _B, 1, wanted)


def anchors(raw: np.ndarray, counts: list[int], begins: list[int]):
    """Of joined pieces (first window and number of windows of each): gram, context, piece, at, first, last (offsets in
    the joined array; the anchor at `at` owns the windows that start at first..last)."""
    grams = _identifiers(raw, 1, GRAM)
    windows = _doubled(grams, GRAM, WIDTH)
    best = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size < SPAN + 1:
        step = min(size, SPAN + 1 - size)
        best, size = np.minimum(best[:-step], best[step:]), size + step
    starts = np.concatenate([np.arange(b, b + n) for b, n in zip(begins, counts)])
    piece = np.repeat(np.arange(len(counts)), counts)
    at = (best[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
    first, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    at = at[new]
    shape = ((at - first) * 128 + (at - last)).astype(np.uint64)
    return grams[at].view(np.int64), _join(_join(windows[first], windows[last]), shape).view(np.int64), piece[new], at, first, last


def _text(packed: bytes) -> bytes:
    return zstandard.decompress(packed)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], names=["_key", "_packed"])


_ANCHOR = "slot long, context long, k long, row long, p long"


def _rows(columns, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


def _fold(found: list[np.ndarray]) -> pa.RecordBatch:
    """One anchor per q-gram and surroundings of a task's share; the others are known to repeat."""
    gram, context, k, row, p = map(np.concatenate, zip(*found))
    order = np.lexsort((p, row, k, context, gram))
    gram, context, k, row, p = (x[order] for x in (gram, context, k, row, p))
    new_gram = np.concatenate([[True], gram[1:] != gram[:-1]])
    first = new_gram | np.concatenate([[True], context[1:] != context[:-1]])
    number = np.cumsum(new_gram) - 1
    hot = np.bincount(number, first)[number] >= HOT
    slot = np.where(first, np.where(hot, _join(gram.view(np.uint64), context.view(np.uint64)).view(np.int64), gram), _join(row.view(np.uint64), p.view(np.uint64)).view(np.int64))
    kind = np.where(first, np.where(hot, SPREAD, OWN), FOLDED)
    marks = gram[new_gram & hot]
    none = np.zeros(len(marks), np.int64)
    return _rows([np.concatenate(x) for x in ((slot, marks), (context, none), (k, none), (row, none), (p | kind, none + MARKER))], _ANCHOR)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """p packs the offset, the distances to the first and last window, and the kind."""
    found, pending, size = [], [], 0

    def flush_pieces():
        begins = np.cumsum([0, *(len(body) for _, _, _, body in pending)])[:-1]
        raw = np.frombuffer(b"".join(x[3] for x in pending), np.uint8)
        gram, context, piece, at, first, last = anchors(raw, [len(x[3]) - WIDTH + 1 for x in pending], begins.tolist())
        k, row, offset = (np.array([x[i] for x in pending], np.int64)[piece] for i in range(3))
        found.append((gram, context, k, row, (at - begins[piece] + offset) << 20 | (at - first) << 12 | (at - last) << 4))
        pending.clear()
    for batch in batches:
        for row, key, packed in zip(*(c.to_pylist() for c in batch.columns)):
            body = _text(packed)
            for offset in range(0, len(body) - WIDTH + 1, PIECE):
                part = body[offset:offset + PIECE + WIDTH - 1]
                if size + len(part) > PIECE and pending:
                    flush_pieces()
                    size = 0
                pending.append((LAST if key is None else key, row, offset, part))
                size += len(part)
        if sum(len(x[0]) for x in found) >= FLUSH:
            yield _fold(found)
            found = []
    if pending:
        flush_pieces()
    if found:
        yield _fold(found)


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by slot, context, key, row, offset."""
    names = "row long, p long, status int, slot long"

    def judge(slot, context, k, row, p):
        kind = p & 15
        alone = kind == FOLDED
        out = [(row[alone], p[alone], np.full(alone.sum(), FULL), slot[alone])]
        slot, context, row, p, kind = (x[~alone] for x in (slot, context, row, p, kind))
        if len(slot):
            new = np.concatenate([[True], slot[1:] != slot[:-1]])
            number = np.cumsum(new) - 1
            real = kind != MARKER
            first = (new | np.concatenate([[True], context[1:] != context[:-1]]) | ~np.concatenate([[True], real[:-1]])) & real
            marked = np.bincount(number, kind != OWN)[number] > 0
            kinds = np.bincount(number, first)[number]
            keep = real & (~first | marked | (kinds > 1))
            status = np.where(first, np.where(marked | (kinds > WIDE), OPEN_WIDE, OPEN), FULL)
            out.append((row[keep], p[keep], status[keep], slot[keep]))
        row, p, status, slot = map(np.concatenate, zip(*out))
        return _rows([row, p, status.astype(np.int32), slot], names)
    held = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield judge(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield judge(*held)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the windows of each open anchor, with key, row, first window, and how far the anchor is behind it."""
    for batch in batches:
        out = []
        for row, key, packed, marks in zip(*(c.to_pylist() for c in batch.columns)):
            body = _text(packed)
            for mark in marks:
                at, far, near = mark["p"] >> 20, mark["p"] >> 12 & 255, mark["p"] >> 4 & 255
                out.append((mark["slot"], mark["status"], LAST if key is None else key, row, at - far, far, body[at - far:at - near + WIDTH]))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=["slot", "status", "k", "row", "first", "far", "body"])


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges first..last, and the index of their range."""
    counts = np.maximum(last - first + 1, 0)
    which = np.repeat(np.arange(len(counts)), counts)
    return first[which] + np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts), which


def _joined(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in bodies], np.int64)
    return np.frombuffer(b"".join(bodies), np.uint8), np.cumsum(sizes) - sizes, sizes


def ranks(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Exact bucket numbers of the windows at `starts`: q-gram buckets refined by the buckets at later offsets."""
    code = raw.astype(np.int64)
    bucket, size = np.unique(code[:-3] << 24 | code[1:-2] << 16 | code[2:-1] << 8 | code[3:], return_inverse=True)[1], 4
    while size < WIDTH:
        step = min(size, WIDTH - size)
        left, right = (bucket[:-step], bucket[step:]) if size + step < WIDTH else (bucket[starts], bucket[starts + step])
        bucket, size = np.unique(left * (int(bucket.max()) + 1) + right, return_inverse=True)[1], size + step
    return bucket


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows among the contexts of whole q-gram buckets; rows come by slot."""
    def repeated(rows):
        k, row, first = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        raw, begins, sizes = _joined([r[4] for r in rows])
        starts, which = _spread(begins, begins + sizes - WIDTH)
        k, row, at = k[which], row[which], first[which] + starts - begins[which]
        bucket = ranks(raw, starts)
        order = np.lexsort((at, row, k, bucket))
        again = order[1:][bucket[order][1:] == bucket[order][:-1]]
        return _rows([row[again], at[again], at[again]], "row long, first long, last long")
    held, size = [], 0
    for batch in batches:
        for item in zip(*(c.to_pylist() for c in batch.columns)):
            if size > PIECE and item[0] != held[-1][0]:
                yield repeated(held)
                held, size = [], 0
            held.append(item)
            size += len(item[4])
    if held:
        yield repeated(held)


def _both(raw: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    return [_identifiers(raw, seed, size)[starts].view(np.int64) for seed in (3, 5)]


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifier of the bytes common to each group of windows.  Groups count from the anchor, so equal windows of
    different documents fall into the same group."""
    for batch in batches:
        for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
            ids, far = part.column(0).to_numpy(), part.column(1).to_numpy()
            raw, begins, sizes = _joined(part.column(2).to_pylist())
            near = far - (sizes - WIDTH)
            group, which = _spread(near // GROUP, far // GROUP)
            yield _rows([*_both(raw, begins[which] + far[which] - GROUP * group, CORE), ids[which], group], "a long, b long, id long, group long")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of the groups whose common bytes repeat.  Of equal windows in a task's share the first is left to be
    compared; the others are known to repeat and leave as runs."""
    held, size = [], 0

    def fold() -> pa.RecordBatch:
        k, row, first, far = (np.array([h[i] for h in held], np.int64) for i in range(4))
        raw, begins, sizes = _joined([h[4] for h in held])
        near = far - (sizes - WIDTH)
        owner = np.repeat(np.arange(len(held)), [len(h[5]) for h in held])
        group = np.concatenate([np.array(h[5], np.int64) for h in held])
        back, which = _spread(np.maximum(group * GROUP, near[owner]), np.minimum(group * GROUP + GROUP - 1, far[owner]))
        which = owner[which]
        inside = far[which] - back
        a, b = _both(raw, begins[which] + inside, WIDTH)
        k, row, at = k[which], row[which], first[which] + inside
        order = np.lexsort((at, row, k, b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        lead, rest = order[new], order[~new]
        rest = rest[np.lexsort((at[rest], row[rest]))]
        r, t = row[rest], at[rest]
        cut = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (t[1:] != t[:-1] + 1)])) if len(rest) else np.zeros(0, np.int64)
        ends = np.concatenate([cut[1:], [len(rest)]]).astype(np.int64) - 1 if len(rest) else cut
        none = np.zeros(len(cut), np.int64)
        return _rows([np.concatenate(x) for x in ((a[lead], none), (b[lead], none), (k[lead], none), (row[lead], r[cut]), (at[lead], t[cut]), (at[lead], t[ends]),
                                                  (np.zeros(len(lead), bool), np.ones(len(cut), bool)))], _WINDOW)
    for batch in batches:
        for item in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(item)
            size += len(item[4])
            if size > PIECE:
                yield fold()
                held, size = [], 0
    if held:
        yield fold()


_WINDOW = "a long, b long, k long, row long, first long, last long, known boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, packed, runs in zip(*(c.to_pylist() for c in batch.columns)):
            body = _text(packed)
            edge = np.zeros(len(body) + 1, np.int64)
            for run in runs or []:
                edge[run["first"]] += 1
                edge[run["last"] + WIDTH] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
            runs_gone = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((key, len(body), int(gone.sum()), runs_gone, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)], names=["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Null and empty texts have no bytes; texts under 100 bytes repeat nothing.  Null keys come after all others; rows that
    share a key count in the order in which they are stored.  Long texts are read whole; an empty table gives no rows;
    other columns are not read."""
    spark = df.sparkSession
    size = partitions(spark)
    packed = df.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(_pack, "_key long, _packed binary")
    packed = numbered(packed, "packed").select(F.col("_row").alias("row"), "_key", "_packed")
    marks = written(packed.mapInArrow(_anchors, _ANCHOR).repartition(size, "slot").sortWithinPartitions("slot", "context", "k", "row", "p")
                    .mapInArrow(_classify, "row long, p long, status int, slot long"), "anchors")
    wanted = marks.where(f"status <> {FULL}").groupBy("row").agg(F.collect_list(F.struct("p", "status", "slot")).alias("marks"))
    contexts = numbered(packed.join(wanted, "row").mapInArrow(_contexts, "slot long, status int, k long, row long, first long, far long, body binary"), "contexts")
    narrow = (contexts.where(f"status = {OPEN}").select("slot", "k", "row", "first", "body").repartition(size, "slot").sortWithinPartitions("slot")
              .mapInArrow(_refine, "row long, first long, last long"))
    contexts = contexts.where(f"status = {OPEN_WIDE}")
    cores = written(contexts.select("_row", "far", "body").mapInArrow(_cores, "a long, b long, id long, group long"), "cores")
    common = cores.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    live = cores.join(common, ["a", "b"]).groupBy(F.col("id").alias("_row")).agg(F.collect_set("group").alias("groups"))
    windows = written(contexts.join(live, "_row").select("k", "row", "first", "far", "body", "groups").mapInArrow(_windows, _WINDOW), "windows")
    single = windows.where("not known")
    place = F.struct("k", "row", "first")
    earliest = single.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")).where("n > 1").drop("n")
    repeated = single.join(earliest, ["a", "b"]).where(place != F.col("place")).select("row", "first", "last")
    at = F.shiftright("p", 20)
    full = marks.where(f"status = {FULL}").select("row", (at - F.shiftright("p", 12).bitwiseAND(255)).alias("first"), (at - F.shiftright("p", 4).bitwiseAND(255)).alias("last"))
    runs = full.unionByName(narrow).unionByName(windows.where("known").select("row", "first", "last")).unionByName(repeated).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return (packed.join(runs, "row", "left").select("_key", "_packed", "runs")
            .mapInArrow(_cut, "_key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("_key", key))
