"""Best-first search as a grid: no join is left to a size estimate, and every way to cut the grid gives the same rows."""
from __future__ import annotations

import numpy as np
import pytest

from statproof.llm import best_first, metric_tree, rtree
from tests.llm.test_search_and_variants import brute_negatives


def vectors(n, size=6, seed=7):
    rng = np.random.default_rng(seed)
    return [(5 * i, rng.normal(size=size).tolist(), int(rng.integers(0, 3))) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def brute_top(rows, k=20):
    whole = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v, _ in rows]
    out = []
    for n, (q, vector) in enumerate(whole):
        if q % 20 == 0:
            others = sorted((-int(vector @ v), i) for m, (i, v) in enumerate(whole) if m != n)
            out += [(q, rank, i, -score) for rank, (score, i) in enumerate(others[:k], 1)]
    return sorted(out)


OPERATORS = {"top_k": (metric_tree, metric_tree.top_k, brute_top), "mine": (rtree, rtree.mine, brute_negatives)}


@pytest.mark.parametrize("name", OPERATORS)
def test_joins_are_not_left_to_estimates(spark, monkeypatch, name):
    """The size of blocks sent through Python is far above its estimate: such a side, broadcast, filled the driver."""
    module, run, brute = OPERATORS[name]
    rows, plans, kept = vectors(60), [], best_first.written

    def seen(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, name)
    for m in (best_first, module):
        monkeypatch.setattr(m, "written", seen)
    found = run(table(spark, rows), page=16)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert joins and all("strategy=" in line for line in joins), joins
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_several_groups_and_parts(spark, monkeypatch, name):
    _, run, brute = OPERATORS[name]
    for constant, value in (("GROUP", 2), ("HELD", 4096), ("BLOCK", 4), ("FIRST", 1), ("SPREAD", 2)):
        monkeypatch.setattr(best_first, constant, value)
    rows = vectors(150) + [(5 * i + 1, [0.25, -0.5, 0.25, 0.125, 0.0, 1.0], i % 3) for i in range(40)]
    assert sorted(tuple(r) for r in run(table(spark, rows), page=16).collect()) == brute(rows)


def test_large_numbers_are_not_rounded(spark):
    """Scores beyond the whole numbers of single precision."""
    rows = [(20 * i, [3000.0 + i, 2500.0, 1.0 + i % 2], 0) for i in range(30)]
    assert sorted(tuple(r) for r in metric_tree.top_k(table(spark, rows)).collect()) == brute_top(rows)


@pytest.mark.parametrize("pages,size,blocks,tasks", [(1, 10, 1, 1), (51, 9 << 20, 25, 12), (3000, 540 << 20, 1200, 64), (9, 1 << 30, 3, 4)])
def test_grid_is_bounded(pages, size, blocks, tasks):
    parts, groups = best_first.grid(pages, size, blocks, tasks)
    assert pages <= parts * best_first.STREAM and size <= parts * best_first.HELD and blocks <= groups * best_first.GROUP
    assert parts * groups <= 2 * max(tasks, -(-pages // best_first.STREAM) * -(-blocks // best_first.GROUP), -(-size // best_first.HELD))
