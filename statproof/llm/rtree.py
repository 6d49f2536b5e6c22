"""Hard negatives with an STR-packed R-tree.

Packing by sort-tile-recursive order: the coordinate that spreads most cuts the vectors into slabs, the next one every slab
into tiles (the nodes), the third one every tile into pages, and the fourth one a page into leaves.  The bounds of
slabs and tiles come from a sample of `SAMPLE` rows, those of pages from all rows; any bounds give the same results.  Equal
coordinates are dealt by hash, so one vector may fill a third of the rows.  Every page and leaf keeps its minimum bounding
box; a box gives an interval for each product q_i x_i and, summed, one for the inner product.  Best-first search excludes
boxes whose interval misses the score window of every ask or lies strictly below its k-th score.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .best_first import NODES, PAGE, PAGES, blocks, compact, drawn, dump, matrix, paged, search, seated, unlimited, usable
from .shared import numbered, written

SAMPLE = 4096
LEAF = 64


class Box:
    """Boxes as rows of lowest, then highest coordinates; bounds are sums of whole numbers, so exact below 2^53."""

    @staticmethod
    def of(vectors: np.ndarray) -> np.ndarray:
        return np.concatenate([vectors.min(0), vectors.max(0)])

    @staticmethod
    def union(node: int | None, boxes: np.ndarray) -> np.ndarray:
        half = boxes.shape[1] // 2
        return np.concatenate([boxes[:, :half].min(0), boxes[:, half:].max(0)])

    @staticmethod
    def products(queries: np.ndarray, box) -> None:
        """A box has no centre."""

    @staticmethod
    def bounds(queries: np.ndarray, boxes: np.ndarray, parent=None, left=None) -> tuple[np.ndarray, np.ndarray]:
        lowest, highest = np.split(boxes, 2, axis=1)
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        return plus @ highest.T + minus @ lowest.T, plus @ lowest.T + minus @ highest.T

    @staticmethod
    def narrow(block: dict, page: dict, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return at


class Tiles:
    """Tile of a vector by its two most spread coordinates."""

    def __init__(self, sample: np.ndarray, pages: int):
        self.axes = np.argsort(-sample.var(0), kind="stable")
        self.n = min(int(NODES ** 0.5), max(1, round(pages ** (1 / 3))))
        cuts = np.linspace(0, 1, self.n + 1)[1:-1]
        a, b = sample[:, self.axes[0]], sample[:, self.axes[min(1, len(self.axes) - 1)]]
        self.slabs = np.quantile(a, cuts) if len(cuts) else np.zeros(0)
        slab = np.searchsorted(self.slabs, a)
        self.tiles = [np.quantile(b[slab == i], cuts) if len(cuts) and (slab == i).any() else np.zeros(len(cuts)) for i in range(self.n)]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        slab = np.searchsorted(self.slabs, vectors[:, self.axes[0]])
        b, out = vectors[:, self.axes[min(1, len(self.axes) - 1)]], np.zeros(len(vectors), np.int32)
        for i in range(self.n):
            at = slab == i
            out[at] = i * self.n + np.searchsorted(self.tiles[i], b[at])
        return out


def _build(size: int, axis: int):
    def run(group: pa.Table) -> pa.Table:
        vectors = matrix(group.column("vec"), size)
        keys, rows, labels = (group.column(c).to_numpy() for c in ("key", "_row", "label"))
        order = np.lexsort((rows, vectors[:, axis]))
        vectors, keys, rows, labels = vectors[order], keys[order], rows[order], labels[order]
        leaf = np.arange(len(rows)) // LEAF
        boxes = np.stack([Box.of(vectors[i:i + LEAF]) for i in range(0, len(rows), LEAF)])
        data = dump(vectors=compact(vectors), keys=keys, rows=rows, labels=labels, leaf=leaf, shapes=boxes, parent=None, order=np.lexsort((rows, keys)))
        return pa.table({"page": group.column("page")[:1].combine_chunks(), "node": group.column("node")[:1].combine_chunks(),
                         "shape": pa.array([Box.union(None, boxes).tobytes()], pa.binary()), "data": pa.array([data], pa.binary())})
    return run


def pack(rows: DataFrame, size: int, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """The stored pages of rows (_row, key, label, vec) of one length, and the rows with their tile."""
    total = rows.count()
    sample = drawn(rows, total, SAMPLE)
    tiles = Tiles(sample, -(-total // page))
    third, fourth = (int(tiles.axes[min(i, size - 1)]) for i in (2, 3))

    def assign(batches):
        for batch in batches:
            vectors = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "key", "label")), pa.array([v.tobytes() for v in vectors], pa.binary()),
                                              pa.array(tiles.of(vectors)), pa.array(np.ascontiguousarray(vectors[:, third]))], names=["_row", "key", "label", "vec", "node", "third"])
    tiled = written(rows.select("_row", "key", "label", "vec").mapInArrow(assign, "_row long, key long, label int, vec binary, node int, third double"), "tiled")
    return written(paged(tiled, "third", page).select("_row", "key", "label", "vec", "node", "page").groupBy("node", "page").applyInArrow(_build(size, fourth), PAGES), "pages"), tiled


def mine(df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", scale: float = 256.0, every: int = 50, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95, page: int = PAGE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose key is divisible by `every`; scores are inner products of floor(scale * x).  For each anchor
    and each of its `positives` best other rows of its label: the `negatives` best rows of other labels that score between
    `low` and `high` percent of the positive; ties go to the smaller key.  Fewer rows give fewer results.

    Null, empty and non-finite vectors, null labels and null keys take no part; vectors of different lengths never meet.
    Rows are told apart by number: rows with one key are different rows, so another row with the anchor's key may be its
    positive.  An empty table gives no rows; other columns are not read.  Products must stay below 2**53."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    rows = rows.dropna(subset=["key", "label"]).where(usable(F.col("vec"))).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    rows = numbered(rows.withColumn("size", F.size("vec")), "vectors")
    out = None
    for size in sorted(r[0] for r in rows.select("size").distinct().collect()):  # one index for each length
        found = _mined(rows.where(F.col("size") == size), size, every, positives, negatives, low, high, page)
        out = found if out is None else out.unionByName(found)
    return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out


def _mined(rows: DataFrame, size: int, every: int, positives: int, negatives: int, low: int, high: int, page: int) -> DataFrame:
    pages, tiled = pack(rows, size, page)
    anchors = written(seated(tiled.where(F.col("key") % every == 0)).select("block", F.col("_row").alias("query"), "key", "label", "vec"), "anchors")
    positive = search(pages, blocks(unlimited(anchors), size), Box, positives, True)
    positive = written(positive.select("query", F.col("rank").alias("slot"), F.col("key").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least, most = F.expr(f"({low} * positive_score + 99) div 100"), F.expr(f"({high} * positive_score) div 100")
    wanted = positive.where("positive_score >= 0").select("query", "slot", least.cast("double").alias("low"), most.cast("double").alias("high"))
    negative = search(pages, blocks(anchors.join(wanted.hint("merge"), "query"), size), Box, negatives, False)
    return (negative.select("query", "slot", "rank", F.col("key").alias("negative_id"), F.col("score").alias("negative_score")).hint("merge").join(positive, ["query", "slot"])
            .join(anchors.select("query", F.col("key").alias("anchor_id")).hint("merge"), "query")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
