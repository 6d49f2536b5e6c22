"""Exact best-first search of blocks of queries over pages of whole-number vectors.

Pages carry a shape that bounds every inner product inside them, and so do the nodes that they hang under (at most
`NODES`).  Every block first meets the shapes alone, and its few best pages give each of its queries a k-th score, which is
written.  Then the work is a grid: a cell holds some pages in memory (at most some `STREAM`, or `HELD` bytes) and takes some
blocks through them, one after the other, each from the nodes to the pages that still reach its floor, best bound first,
with a floor that rises on the way.  So a page travels once for each `GROUP` blocks and a block once for each part of the
pages; pairs of them are never stored or shuffled.  A page is scored by one matrix product over the leaves that some query of
the block cannot exclude.  Tasks can be repeated at any point; nothing but node shapes and counts comes to the driver, and no
table is broadcast but those of at most `NODES` rows.

A query has one or more asks: k scores within [low, high], of rows with its label, of other labels, or of all rows.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import partitions, written

NODES = 1024
PAGE = 1024
BLOCK = 128
FIRST = 4
STREAM = 256
HELD = 1 << 26
GROUP = 256
SPREAD = 16
TASKS = 64
STEPS = 63
FLOAT = 1 << 24  # whole numbers below are exact in single precision
BLOCKS = "block long, data binary"
PAGES = "page long, node int, shape binary, data binary"
FOUND = "query long, slot int, key long, row long, score long"


def usable(vec: Column) -> Column:
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dump(**parts) -> bytes:
    return pickle.dumps(parts, pickle.HIGHEST_PROTOCOL)


def compact(whole: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    top = np.abs(whole).max(initial=0)
    return whole.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64)


def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def drawn(rows: DataFrame, total: int, most: int) -> np.ndarray:
    """At most `most` vectors of the `total` rows by the hash of their number.  Every partition sends its own first ones, so in a
    large table only a share of some 4 times as many rows takes part."""
    chosen = rows.where(F.pmod(F.xxhash64("_row"), F.lit(max(1, total // (4 * most)))) == 0)
    return np.array([r[0] for r in chosen.orderBy(F.xxhash64("_row")).select("vec").limit(most).collect()])


class Best:
    """The k best of every ask so far, and the score that others must reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.ask, self.score, self.key, self.row = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting, self.count = [], 0

    def add(self, ask, score, key, row) -> None:
        """Others are folded in when they are many; until then the floor stays lower than it could be."""
        self.waiting.append((ask, score, key, row))
        self.count += len(ask)
        if 2 * self.count >= self.k * len(self.floor):
            self.fold()

    def fold(self) -> None:
        if not self.waiting:
            return
        ask, score, key, row = (np.concatenate(c) for c in zip((self.ask, self.score, self.key, self.row), *self.waiting))
        self.waiting, self.count = [], 0
        order = np.lexsort((row, key, -score, ask))
        place = np.arange(len(order)) - np.searchsorted(ask[order], ask[order])
        order = order[place < self.k]
        self.ask, self.score, self.key, self.row = ask[order], score[order], key[order], row[order]
        last = place[place < self.k] == self.k - 1
        self.floor[self.ask[last]] = np.maximum(self.floor[self.ask[last]], self.score[last])


def opened(data) -> dict:
    """A block or page as stored, with its vectors as floats: single ones, if every sum of products of theirs is exact in them."""
    parts = pickle.loads(data)
    whole = parts["vectors"].astype(np.float64)
    parts["norm"] = np.sqrt((whole * whole).sum(1).max(initial=0))
    if "query" in parts:
        parts["vectors"], parts["single"] = whole, whole.astype(np.float32)
    return parts


def _asked(block: dict, upper: np.ndarray, lower: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which shapes (columns) some ask of the block cannot exclude, as a table of asks and shapes."""
    q = block["ask_query"]
    return (upper[q] >= np.maximum(floor, block["low"])[:, None]) & (lower[q] <= block["high"][:, None])


def _scan(shape, block: dict, page: dict, best: Best, same: bool | None) -> None:
    queries = block["vectors"]

    def left(upper, lower):
        return _asked(block, upper, lower, best.floor).any(0)
    upper, lower = shape.bounds(queries, page["shapes"], shape.products(queries, page["parent"]), left)
    need = left(upper, lower)
    if not need.any():
        return
    at = page["order"]  # by key, then row: of equal scores the first ones win
    if not need.all():
        at = at[need[page["leaf"][at]]]
    at = shape.narrow(block, page, at, best.floor)
    if not len(at):
        return
    exact = block["norm"] * page["norm"] < FLOAT
    kind, asker = (np.float32, block["single"]) if exact else (np.float64, queries)
    scores = asker @ page["vectors"][at].astype(kind).T
    ask_query, own, k = block["ask_query"], block["query"], best.k
    if len(ask_query) != len(queries):  # else every query has one ask, in order
        scores = scores[ask_query]
    keys, rows = page["keys"][at], page["rows"][at]
    ok = scores >= np.maximum(best.floor, block["low"]).astype(kind)[:, None]
    if np.isfinite(block["high"]).any():
        ok &= scores <= block["high"].astype(kind)[:, None]
    if np.count_nonzero(ok) > 2 * k * len(ok):
        ok &= rows != own[ask_query][:, None]
        if same is not None:
            ok &= (page["labels"][at] == block["label"][ask_query][:, None]) == same
        if len(at) > k:
            cut = np.partition(np.where(ok, scores, -np.inf), len(at) - k, axis=1)[:, len(at) - k][:, None]
            tied = ok & (scores == cut)
            ok = (ok & (scores > cut)) | (tied & (np.cumsum(tied, axis=1) <= k))
        ask, j = np.nonzero(ok)
    else:
        ask, j = np.nonzero(ok)
        good = rows[j] != own[ask_query[ask]]
        if same is not None:
            good &= (page["labels"][at[j]] == block["label"][ask_query[ask]]) == same
        ask, j = ask[good], j[good]
    if len(ask):
        best.add(ask, scores[ask, j].astype(np.float64), keys[j], rows[j])


class Part:
    """The pages of a cell, or their shapes alone, and the nodes they hang under."""

    def __init__(self, shape, nodes: dict[int, np.ndarray], rows: list[tuple]):
        self.shape, numbers, self.heads = shape, {n: i for i, n in enumerate(nodes)}, np.stack(list(nodes.values()))
        self.names, self.node = np.array([r[0] for r in rows]), np.array([numbers[r[1]] for r in rows])
        self.shapes, self.pages = np.stack([np.frombuffer(r[2]) for r in rows]), [r[3] for r in rows]

    def reached(self, block: dict, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the pages that some ask cannot exclude, best bound first; their bounds, upper and lower ones."""
        shape, queries = self.shape, block["vectors"]

        def left(upper, lower):
            return _asked(block, upper, lower, floor).any(0)
        at = np.flatnonzero(left(*shape.bounds(queries, self.heads, None, None))[self.node])
        products = shape.products(queries, self.heads)
        upper, lower = shape.bounds(queries, self.shapes[at], None if products is None else products[:, self.node[at]], left)
        reach = _asked(block, upper, lower, floor)
        bound = np.where(reach, np.minimum(upper[block["ask_query"]], block["high"][:, None]), -np.inf).max(0)
        order = np.lexsort((self.names[at], -bound))
        order = order[reach.any(0)[order]]
        return at[order], bound[order], upper[:, order], lower[:, order]


def _cells(shape, nodes: dict[int, np.ndarray], visit):
    """Rows come by cell: first its pages (kind 0), then its blocks (kind 1), each of which visits them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, part = None, [], None
        for batch in batches:
            for number, kind, name, node, form, data in zip(*(c.to_pylist() for c in batch.columns[:5]), batch.column(5)):
                if number != cell:
                    cell, held, part = number, [], None
                if kind == 0:
                    held.append((name, node, form, opened(data.as_buffer()) if data.is_valid else None))
                    continue
                if part is None and held:
                    held, part = [], Part(shape, nodes, held)
                if part is not None:
                    yield from visit(name, opened(data.as_buffer()), part)
    return run


def _nearest(name: int, block: dict, part: Part) -> Iterator[pa.RecordBatch]:
    """The first pages of a block."""
    at, bound, _, _ = part.reached(block, block["floor"])
    at, bound = at[:FIRST], bound[:FIRST]
    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.int64()), pa.array(part.names[at], pa.int64()), pa.array(bound, pa.float64())], names=["block", "page", "bound"])


def _searched(shape, k: int, same: bool | None):
    """The k best of every ask of a block in the pages of one cell, as one row."""
    def visit(name: int, block: dict, part: Part) -> Iterator[pa.RecordBatch]:
        best = Best(block["floor"], k)
        at, _, upper, lower = part.reached(block, best.floor)
        for i, page in enumerate(at):
            if _asked(block, upper[:, i:i + 1], lower[:, i:i + 1], best.floor).any():
                _scan(shape, block, part.pages[page], best, same)
        best.fold()
        if len(best.ask):
            data = dump(query=block["query"][block["ask_query"][best.ask]], slot=block["slot"][best.ask], score=best.score, key=best.key, row=best.row)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([data], pa.binary())], names=["block", "data"])
    return visit


def _raised(shape, k: int, same: bool | None):
    """Rows come by block in order of rank: first the block, then its first pages, best bound first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, raw, block, best = None, None, None, None

        def done() -> pa.RecordBatch:
            best.fold()
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([dump(**raw | {"floor": best.floor})], pa.binary())], names=["block", "data"])
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                if number != held:
                    if held is not None:
                        yield done()
                    held, raw, block = number, pickle.loads(data.as_buffer()), opened(data.as_buffer())
                    best = Best(block["floor"], k)
                else:
                    _scan(shape, block, opened(data.as_buffer()), best, same)
        if held is not None:
            yield done()
    return run


def _merged(k: int):
    """Rows come by block: the best of every cell become the best of all, with their rank."""
    fields, kinds = ("query", "slot", "key", "row", "score"), (np.int64, np.int32, np.int64, np.int64, np.int64)

    def fold(parts: list[dict]) -> tuple[dict, np.ndarray]:
        whole = {f: np.concatenate([p[f] for p in parts]) for f in fields}
        order = np.lexsort((whole["row"], whole["key"], -whole["score"], whole["slot"], whole["query"]))
        query, slot = whole["query"][order], whole["slot"][order]
        first = np.concatenate([[True], (query[1:] != query[:-1]) | (slot[1:] != slot[:-1])])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        return {f: whole[f][order[place < k]] for f in fields}, place[place < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []

        def done() -> pa.RecordBatch:
            whole, place = fold(parts)
            return pa.RecordBatch.from_arrays([*(pa.array(whole[f].astype(t)) for f, t in zip(fields, kinds)), pa.array((place + 1).astype(np.int32))], names=[*fields, "rank"])
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != held:
                    if parts:
                        yield done()
                    held, parts = number, []
                parts.append(pickle.loads(data.as_buffer()))
                if len(parts) == SPREAD:
                    parts = [fold(parts)[0]]
        if parts:
            yield done()
    return run


def unlimited(queries: DataFrame) -> DataFrame:
    """One ask for each query, with any score."""
    return queries.withColumns({"slot": F.lit(0), "low": F.lit(float("-inf")), "high": F.lit(float("inf"))})


def blocks(asks: DataFrame, size: int) -> DataFrame:
    """A stored table of query blocks from asks (block, query, label, vec, slot, low, high): at most some `BLOCK` queries each."""
    def build(group: pa.Table) -> pa.Table:
        query, slot = group.column("query").to_numpy(), group.column("slot").to_numpy()
        order = np.lexsort((slot, query))
        names, first, at = np.unique(query[order], return_index=True, return_inverse=True)
        first = order[first]
        low, high = group.column("low").to_numpy()[order], group.column("high").to_numpy()[order]
        data = dump(vectors=compact(matrix(group.column("vec"), size)[first]), query=names, label=group.column("label").to_numpy()[first], ask_query=at, slot=slot[order], low=low, high=high, floor=np.full(len(order), -np.inf))
        return pa.table({"block": group.column("block")[:1].combine_chunks(), "data": pa.array([data], pa.binary())})
    return written(asks.select("block", "query", "label", "vec", "slot", "low", "high").groupBy("block").applyInArrow(build, BLOCKS), "blocks")


def paged(tiled: DataFrame, value: str, page: int) -> DataFrame:
    """`tiled` (_row, node, ...) with a column `page`: each node is cut into pages of about `page` rows by quantiles of `value`;
    rows of equal value are dealt by hash.  A node has at most `STEPS` + 1 ranges of its own; each is dealt by hash beyond."""
    steps = F.array(*[F.lit((i + 1) / (STEPS + 1)) for i in range(STEPS)])
    cuts = written(tiled.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, steps, 1000).alias("cuts")), "cuts")  # at most NODES rows
    at = F.size(F.filter("cuts", lambda c: c < F.col(value)))
    ties = F.size(F.filter("cuts", lambda c: c == F.col(value))) + 1
    chance = F.pmod(F.xxhash64("_row"), F.lit(1 << 20)) / float(1 << 20)
    chunks = F.ceil(F.col("n") / page)
    chunk = F.least(F.floor(chunks * (at + ties * chance) / (STEPS + 1)), chunks - 1)
    return tiled.join(F.broadcast(cuts), "node").withColumn("page", F.col("node").cast("long") * (1 << 32) + chunk)


def seated(queries: DataFrame) -> DataFrame:
    """Queries (node, _row, ...) with a column `block`: those of a node, dealt by hash into blocks of about `BLOCK`."""
    parts = queries.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))  # at most NODES rows
    return queries.join(F.broadcast(parts), "node").withColumn("block", F.col("node").cast("long") * (1 << 32) + F.pmod(F.xxhash64("_row"), F.col("parts")))


def grid(pages: int, size: int, blocks: int, tasks: int) -> tuple[int, int]:
    """Into how many parts pages of `size` bytes are cut and into how many groups the blocks."""
    parts = max(1, -(-pages // STREAM), -(-size // HELD), min(pages, tasks, SPREAD))
    return parts, max(1, -(-blocks // GROUP), min(blocks, -(-tasks // parts)))


def search(pages: DataFrame, blocks: DataFrame, shape, k: int, same: bool | None = None) -> DataFrame:
    """(query, slot, key, row, score, rank): the k best of every ask, ties to the smaller key, then to the smaller row."""
    spark = pages.sparkSession
    heads = pages.select("node", "shape").groupBy("node").applyInArrow(_union(shape), "node int, n long, shape binary").collect()  # at most NODES
    nodes = {r["node"]: np.frombuffer(r["shape"]) for r in heads}
    n_blocks = blocks.count()
    if not nodes or not n_blocks:
        return spark.createDataFrame([], FOUND + ", rank int")
    n_pages, tasks = sum(r["n"] for r in heads), min(partitions(spark), TASKS)
    starts = np.cumsum([0] + [r["n"] for r in heads])[:-1].tolist()
    starts = spark.createDataFrame([(r["node"], start) for r, start in zip(heads, starts)], "node int, start long")  # at most NODES
    dealt = pages.join(F.broadcast(starts), "node").withColumn("place", F.col("start") + F.pmod("page", F.lit(1 << 32)))

    def cells(data: Column, size: int, of: DataFrame, visit, schema: str) -> DataFrame:
        """Pages (`data` of them) and blocks meet in a grid."""
        parts, groups = grid(n_pages, size, n_blocks, tasks)
        own_part, own_group = F.pmod("place", F.lit(parts)), F.pmod(F.xxhash64("block"), F.lit(groups))
        every_group = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: (own_part * groups + g).cast("int"))
        every_part = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: (p * groups + own_group).cast("int"))
        held = dealt.select(F.explode(every_group).alias("cell"), F.lit(0).alias("kind"), F.col("page").alias("name"), "node", "shape", data.alias("data"))
        asked = of.select(F.explode(every_part).alias("cell"), F.lit(1).alias("kind"), F.col("block").alias("name"), F.lit(-1).alias("node"), F.lit(None).cast("binary").alias("shape"), "data")
        return held.unionByName(asked).repartitionById(parts * groups, "cell").sortWithinPartitions("cell", "kind", "name").mapInArrow(_cells(shape, nodes, visit), schema)

    width = len(next(iter(nodes.values()))) * 8
    near = cells(F.lit(None).cast("binary"), n_pages * width, blocks, _nearest, "block long, page long, bound double")
    best = Window.partitionBy("block").orderBy(F.desc("bound"), "page")
    near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= FIRST)
    seats = near.hint("merge").join(pages.select("page", "data"), "page").select("block", "rank", "data")
    first = blocks.select("block", F.lit(0).alias("rank"), "data").unionByName(seats).repartition("block").sortWithinPartitions("block", "rank")
    raised = written(first.mapInArrow(_raised(shape, k, same), BLOCKS), "floors")
    size = pages.agg(F.sum(F.octet_length("data"))).first()[0]
    found = cells(F.col("data"), size, raised, _searched(shape, k, same), BLOCKS)
    return found.repartition("block").sortWithinPartitions("block").mapInArrow(_merged(k), FOUND + ", rank int")


def _union(shape):
    def run(group: pa.Table) -> pa.Table:
        whole = shape.union(group.column("node")[0].as_py(), np.stack([np.frombuffer(s) for s in group.column("shape").to_pylist()]))
        return pa.table({"node": group.column("node")[:1].combine_chunks(), "n": pa.array([len(group)], pa.int64()), "shape": pa.array([whole.tobytes()], pa.binary())})
    return run
