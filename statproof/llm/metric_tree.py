"""Exact top-k by inner product with a paged M-tree.

Metric nodes in four levels: routing vectors (chosen farthest first from a sample of `SAMPLE` rows), pages of about `PAGE`
vectors under them, cut by the distance to the routing vector, leaves inside a page, and entries.  Every node keeps its
covering radius and the distance to its parent's centre; every entry its distance to the centre of its leaf.  By Cauchy and
Schwarz a node with centre c and radius r holds no inner product above q.c + |q| r; and as q.c <= q.p + |q| d(c, p), the
stored distance to the parent p gives a bound before q.c is computed.  `best_first` takes blocks of queries through the
pages, best bound first.  Scores are integers and bounds get a margin above rounding errors, so results are exact.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .best_first import NODES, PAGE, PAGES, blocks, compact, drawn, dump, matrix, paged, search, seated, unlimited, usable
from .shared import numbered, written

SAMPLE = 4096
LEAVES = 16


def _far_first(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of at most k different vectors, each the farthest from those before it."""
    chosen, near = [0], ((vectors - vectors[0]) ** 2).sum(1)
    while len(chosen) < k and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0))


def _margin(distance: np.ndarray) -> np.ndarray:
    """Distances come from differences of products; the margin covers their cancellation."""
    return distance * (1 + 1e-9) + 1e-3


class Ball:
    """Balls as rows of centre, covering radius, distance to the parent's centre.  Nodes are centred on their routing vector."""

    def __init__(self, routes: np.ndarray):
        self.routes = routes

    def union(self, node: int, balls: np.ndarray) -> np.ndarray:
        return np.concatenate([self.routes[node], [_margin(balls[:, -1] + balls[:, -2]).max(), 0.0]])

    @staticmethod
    def products(queries: np.ndarray, ball: np.ndarray) -> np.ndarray:
        return queries @ ball[..., :-2].T

    @staticmethod
    def bounds(queries: np.ndarray, balls: np.ndarray, parent=None, left=None) -> tuple[np.ndarray, np.ndarray]:
        norm = np.linalg.norm(queries, axis=1)[:, None]
        lower = np.full((len(queries), len(balls)), -np.inf)
        if parent is None:
            upper = queries @ balls[:, :-2].T + norm * _margin(balls[:, -2])
        else:
            upper = (parent if parent.ndim == 2 else parent[:, None]) + norm * _margin(balls[:, -1] + balls[:, -2])
            live = left(upper + 0.25, lower)  # centres that stored distances exclude are not touched
            upper[:, live] = np.minimum(upper[:, live], queries @ balls[live, :-2].T + norm * _margin(balls[live, -2]))
        return upper + np.maximum(0.25, 1e-9 * np.abs(upper)), lower

    @staticmethod
    def narrow(block: dict, page: dict, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Entries whose distance to the centre of their leaf lets them reach the floor of some query."""
        queries, heads = block["vectors"], page["shapes"][:, :-2]
        lowest = np.full(len(queries), np.inf)
        np.minimum.at(lowest, block["ask_query"], floor)
        norm = np.linalg.norm(queries, axis=1)
        if not np.isfinite(lowest).all() or not norm.all():
            return at
        products = queries @ heads.T
        reach = ((lowest[:, None] - products - 1 - 1e-9 * np.abs(products)) / norm[:, None]).min(0)
        return at[_margin(page["inside"][at]) >= reach[page["leaf"][at]]]


def _build(size: int, routes: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        vectors, keys, rows = matrix(group.column("vec"), size), group.column("key").to_numpy(), group.column("_row").to_numpy()
        node = group.column("node")[:1].combine_chunks()
        order = np.argsort(rows, kind="stable")
        vectors, keys, rows = vectors[order], keys[order], rows[order]
        centre = np.rint(vectors.mean(0))
        heads = vectors[_far_first(vectors, LEAVES)]
        apart = _distances(vectors, heads)
        leaf = apart.argmin(1)
        inside = apart[np.arange(len(rows)), leaf]
        radius = np.zeros(len(heads))
        np.maximum.at(radius, leaf, inside)
        balls = np.column_stack([heads, radius, _distances(heads, centre[None])[:, 0]])
        ball = np.concatenate([centre, [_distances(vectors, centre[None]).max(), _distances(centre[None], routes[node[0].as_py()][None])[0, 0]]])
        data = dump(vectors=compact(vectors), keys=keys, rows=rows, labels=None, leaf=leaf, inside=inside, shapes=balls, parent=ball, order=np.lexsort((rows, keys)))
        return pa.table({"page": group.column("page")[:1].combine_chunks(), "node": node, "shape": pa.array([ball.tobytes()], pa.binary()), "data": pa.array([data], pa.binary())})
    return run


def top_k(df: DataFrame, key: str = "vec_id", vec: str = "embedding", scale: float = 64.0, every: int = 20, k: int = 20, page: int = PAGE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by `every`, its k highest inner products of
    floor(scale * x) with all other rows, ties to the smaller key.

    Null, empty and non-finite vectors and null keys take no part; vectors of different lengths never meet.  Rows are told
    apart by number: rows that share a key are different rows, so another row with the query's key may be among its
    results, and each such row asks for itself.  Fewer than k others give fewer rows; an empty table gives none; other
    columns are not read.  Products must stay below 2**53."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vec).cast("array<double>").alias("vec")).where(F.col("key").isNotNull() & usable(F.col("vec")))
    rows = numbered(rows.select("key", F.transform("vec", lambda x: F.floor(x * scale).cast("double")).alias("vec"), F.size("vec").alias("size")), "vectors")
    out = None
    for size in sorted(r[0] for r in rows.select("size").distinct().collect()):  # one index for each length
        found = _top_k(rows.where(F.col("size") == size), size, every, k, page)
        out = found if out is None else out.unionByName(found)
    return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def _top_k(rows: DataFrame, size: int, every: int, k: int, page: int) -> DataFrame:
    total = rows.count()
    sample = drawn(rows, total, SAMPLE)
    routes = sample[_far_first(sample, min(NODES, max(1, round((total / page) ** 0.5))))]

    def assign(batches):
        for batch in batches:
            vectors = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            apart = _distances(vectors, routes)
            node = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("key"), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array(node.astype(np.int32)),
                                              pa.array(apart[np.arange(len(node)), node])], names=["_row", "key", "vec", "node", "apart"])
    tiled = written(rows.select("_row", "key", "vec").mapInArrow(assign, "_row long, key long, vec binary, node int, apart double"), "routed")
    pages = written(paged(tiled, "apart", page).select("_row", "key", "vec", "node", "page").groupBy("node", "page").applyInArrow(_build(size, routes), PAGES), "pages")
    queries = written(seated(tiled.where(F.col("key") % every == 0)).select("block", F.col("_row").alias("query"), F.col("key").alias("query_id"), F.lit(0).alias("label"), "vec"), "queries")
    found = search(pages, blocks(unlimited(queries), size), Ball(routes), k)
    return (found.hint("merge").join(queries.select("query", "query_id"), "query")
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("vec_id"), "score"))
