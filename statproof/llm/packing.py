"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Packing depends on piece lengths only, and there are at most `limit` different ones.  So the driver packs a histogram
(at most 4,096 counts, whatever the number of documents); pieces find their place by (length, rank):

* reduction: a set {j, k} that provably dominates every feasible set with j becomes a finished sequence: k is the
  largest length that fits beside j and it fills the sequence exactly, or no two other pieces fit beside j.  A piece
  beside which nothing fits is finished alone.  Fixing sets shrinks the instance, so the rules run until none applies.
* remainder: best fit in decreasing length order, on groups of equal sequences instead of single ones.
"""
from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .shared import slices, written
from .words import Memo

LIMIT = 4096
END_ID = 1
SEGMENT = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")

Group = tuple[list[tuple[int, int]], int]  # ((length, times) ..., number of equal sequences)


class WordTokens:
    """Ids of whole texts as the tokenizer file gives them.  The file lower-cases, drops white space and merges inside
    words, so chunks between blanks are independent; they are memoised.  Letters with plain punctuation go through a
    byte-rank form of the same vocabulary (a word end is a byte that no UTF-8 text holds), all else through the library."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {}
        for token, i in model["vocab"].items():
            body = token.removesuffix("</w>")
            if all(c in byte_of for c in body):
                ranks.setdefault(bytes(map(byte_of.__getitem__, body)) + (b"\xff" if body != token else b""), i)
        self.pieces = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks={k: v for k, v in ranks.items() if v < 49_406}, special_tokens={})._core_bpe.encode_single_piece
        self.word = Memo(lambda w: np.array(self.pieces(w.encode() + b"\xff"), "<u4").tobytes())
        self.chunk = Memo(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if plain := SEGMENT.fullmatch(chunk):
            return self.word[plain[1].lower()] + (self.word[plain[2]] if plain[2] else b"")
        return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        return b"".join(map(self.chunk.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@functools.lru_cache(2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece; `_task` and `_nth` rank pieces of one length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task, seen = word_tokens(path), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            keys, rows = batch.column(0).to_pylist(), []
            for k, t in zip(keys, batch.column(1).to_pylist()):
                ids = memoryview(tokens.ids(t or "") + end)
                for i, at in enumerate(range(0, len(ids) // 4, limit)):
                    part = ids[4 * at:4 * (at + limit)]
                    n = len(part) // 4
                    rows.append((k, i, at, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)
    names = [key, "piece", "start", "length", "ids_crc32", "_task", "_nth"]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, _task int, _nth long"
    return df.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def reduce_dominated(counts: dict[int, int], limit: int = LIMIT) -> tuple[list[Group], dict[int, int]]:
    """Finished sequences that some optimal packing contains, and the counts that remain."""
    left, done = {s: n for s, n in counts.items() if n > 0}, []
    changed = True
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                sizes, room = sorted(left), limit - j

                def others(size: int) -> int:
                    return left[size] - (size == j)
                low = [s for s in sizes[:3] for _ in range(min(2, others(s)))][:2]
                if not low or low[0] > room:
                    done.append(([(j, 1)], times := left[j] if 2 * j > limit else 1))
                    used = {j: times}
                else:
                    at = bisect.bisect_right(sizes, room) - 1
                    k = sizes[at] if others(sizes[at]) > 0 else sizes[at - 1]
                    if k != room and (len(low) == 2 and sum(low) <= room):
                        break
                    times = left[j] // 2 if j == k else min(left[j], left[k])
                    done.append(([(j, 2)] if j == k else [(j, 1), (k, 1)], times))
                    used = {j: 2 * times} if j == k else {j: times, k: times}
                for s, n in used.items():
                    left[s] -= n
                    if not left[s]:
                        del left[s]
                changed = True
    return done, left


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> list[Group]:
    """Best fit in decreasing order.  `open_[r]` holds the groups of equal sequences with r tokens of room."""
    open_: dict[int, list[Group]] = {}
    rooms: list[int] = []

    def put(room: int, content: list, number: int) -> None:
        if number:
            if room not in open_:
                bisect.insort(rooms, room)
            open_.setdefault(room, []).append((content, number))
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                content, number = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, content, number = limit, [], -(-left // (limit // size))
            each = room // size
            full, rest = min(number, left // each), 0
            put(room - each * size, [*content, (size, each)], full)
            left -= full * each
            if full < number and left:
                rest = left
                put(room - rest * size, [*content, (size, rest)], 1)
                left = 0
            put(room, content, number - full - bool(rest))
    return [group for groups in open_.values() for group in groups]


def plan(counts: dict[int, int], limit: int = LIMIT) -> np.ndarray:
    """Rows (length, first rank, first sequence, times per sequence, offset) that give every piece its place.

    Bound: a histogram has at most `limit` lengths; each length finishes whole groups and splits at most one, so there
    are O(limit) groups, and a group holds fewer than sqrt(2 * limit) different lengths."""
    done, left = reduce_dominated(counts, limit)
    rank, sequence, rows = Counter(), 0, []
    for content, number in [*done, *best_fit(left, limit)]:
        offset = 0
        for size, times in content:
            rows.append((size, rank[size], sequence, times, offset))
            rank[size] += times * number
            offset += times * size
        sequence += number
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone.  Documents longer than `limit` ids are cut into pieces of `limit`; other
    pieces stay whole.  Repeated rows, null keys and ties are packed like any other row; other columns are not read; an
    empty table gives no rows.  Ranks come from counts per (length, task), so no task orders all pieces of a length."""
    log = written(pieces(df, path, key, text, limit, end_id), "pieces")
    counts = log.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `limit` rows
    table = df.sparkSession.sparkContext.broadcast(plan(histogram, limit))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = log.join(starts, ["length", "_task"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_nth")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        code = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            run = rows[np.searchsorted(code, (length << 48) + rank, "right") - 1] if len(length) else np.zeros((0, 5), np.int64)
            inside = rank - run[:, 1]
            times = np.maximum(run[:, 3], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(run[:, 2] + inside // times), pa.array(run[:, 4] + inside % times * length)], names=names)
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)
