"""The resuming crawl against a queue in plain Python, and the small operators beside it."""
import random
from collections import deque

import pytest

from statproof.operators import corpus, crawl, eda, evaluation


def plain(entries, roots, unreadable=()):
    """Lists in the order in which a queue sees them, and how many are visited before an unreadable one."""
    queue, seen, visited = deque(sorted(set(roots))), [], 0
    seen += queue
    while queue:
        at = queue.popleft()
        if at in unreadable:
            break
        visited += 1
        for child, is_table in entries.get(at, []):
            if not is_table and child not in seen:
                seen.append(child)
                queue.append(child)
    return seen, visited


@pytest.fixture(scope="module")
def catalog():
    rng = random.Random(12)
    names = [f"L{i}" for i in range(60)]
    entries = {n: [(rng.choice(names), False) for _ in range(rng.choice((0, 1, 2, 7)))] + [(f"T{rng.randrange(90)}", True) for _ in range(rng.randrange(3))] for n in names}
    entries["L0"] = [("L0", False), ("L1", False), ("L2", False), ("L1", False), ("T1", True), ("L2", False)]  # names itself and repeats
    entries["L1"] = [("L0", False), ("L3", False), ("L9", False)]  # a cycle
    return entries


@pytest.fixture(scope="module")
def edges(spark, catalog):
    rows = [(p, c, t, i) for p, es in catalog.items() for i, (c, t) in enumerate(es)]
    return spark.createDataFrame(rows + rows[:20], "parent_id string, child_id string, is_table boolean, ord int").repartition(3)


def listed(df):
    return [(r.list_id, r.position, r.state) for r in df.orderBy("position").collect()]


def test_runs_of_n_equal_one_run(spark, edges, catalog, tmp_path):
    roots = spark.createDataFrame([("L5",), ("L0",), ("L0",)], "root_id string")
    order, total = plain(catalog, ["L0", "L5"])
    assert total == len(order) > 20
    for _ in range(3):
        parts = crawl.crawl(edges, roots, f"{tmp_path}/parts", 4)
    whole = crawl.crawl(edges, roots, f"{tmp_path}/whole", 12)
    assert listed(parts) == listed(whole)
    assert [x[0] for x in listed(whole)] == order[:len(listed(whole))] and sum(x[2] == "visited" for x in listed(whole)) == 12
    done = crawl.crawl(edges, roots, f"{tmp_path}/whole", 1000)  # cycles end
    assert [(n, s) for n, _, s in listed(done)] == [(n, "visited") for n in order]
    assert listed(crawl.crawl(edges, roots, f"{tmp_path}/whole", 5)) == listed(done)  # nothing is left to visit
    first = {}
    for name in order:
        for child, is_table in catalog[name]:
            if is_table:
                first.setdefault(child, name)
    assert {(r.tbl_id, r.list_id) for r in crawl.crawled_tables(edges, done).collect()} == set(first.items())


def test_an_interrupted_list_comes_first_again(spark, edges, catalog, tmp_path):
    roots = spark.createDataFrame([("L0",)], "root_id string")
    order, _ = plain(catalog, ["L0"])
    broken = order[4]
    bad = spark.createDataFrame([(broken,), ("elsewhere",)], "list_id string")
    _, visited = plain(catalog, ["L0"], {broken})
    stopped = listed(crawl.crawl(edges, roots, str(tmp_path), 50, bad))
    assert [x[2] for x in stopped[:visited + 1]] == ["visited"] * visited + ["interrupted"] and stopped[visited][0] == broken
    assert all(x[2] == "pending" for x in stopped[visited + 1:])
    spark.createDataFrame([("ghost", 99, 2)], crawl.POSITIONS).write.parquet(f"{tmp_path}/positions/2")  # a run that broke off
    assert "ghost" not in {x[0] for x in listed(crawl.queue(spark, str(tmp_path)))}
    resumed = listed(crawl.crawl(edges, roots, str(tmp_path), 1))
    assert resumed[visited][0] == broken and resumed[visited][2] == "visited"
    assert [x[0] for x in listed(crawl.crawl(edges, roots, str(tmp_path), 1000))] == order


def test_empty_catalog(spark, edges, tmp_path):
    none = spark.createDataFrame([], "root_id string")
    assert crawl.crawl(edges, none, f"{tmp_path}/a", 3).count() == 0
    root = spark.createDataFrame([("R",)], "root_id string")
    assert listed(crawl.crawl(edges.where("false"), root, f"{tmp_path}/b", 3)) == [("R", 1, "visited")]
    with pytest.raises(ValueError):
        crawl.crawl(edges, root, f"{tmp_path}/c", 0)


def test_selected_rows(spark):
    small, large = spark.range(7).withColumnRenamed("id", "row_no"), spark.range(2000).withColumnRenamed("id", "row_no")
    assert corpus.selected_rows(small, "row_no", 2, 3).count() == 7
    assert corpus.selected_rows(large, "row_no", 2, 3).count() == 0
    assert sorted(r.row_no for r in corpus.selected_rows(large, "row_no", 2, 3, confirmed=True).collect()) == [1, 2]
    for wrong in ((None, None), (1, 2001), (0, 5), (5, 4), (1, 1001)):
        with pytest.raises(ValueError):
            corpus.selected_rows(large, "row_no", *wrong, confirmed=True)
    assert corpus.selected_rows(small.where("false"), "row_no").count() == 0


def test_asset_counts(spark):
    rules = spark.createDataFrame([("a", "guard", "x"), ("b", "guard", ""), ("c", None, None), ("d", " ", "y")], "rule_id string, type string, pattern string")
    assert {tuple(r) for r in evaluation.rule_stats(rules).collect()} == {("guard", 2, 1), ("?", 2, 1)}
    aliases = spark.createDataFrame([("a", "b", "F12"), ("c", "d", "user"), ("e", "f", None)], "alias string, canonical string, origin string")
    assert evaluation.alias_stats(aliases).first() == (3, 1)


def test_filter_articles(spark):
    rows = [(i, None, [] if i % 5 else ["missing_date"], 100 + i) for i in range(40)] + [(40, None, [], 5000), (41, "duplicate", [], 120)]
    rows = spark.createDataFrame(rows, "row_no int, exclusion string, warnings array<string>, clean_length int")
    profile = spark.createDataFrame([(i, j, j % 2 == 0) for i in range(42) for j in range(4)], "row_no int, sentence_idx int, candidate boolean")

    def ids(**options):
        return {r.row_no for r in eda.filter_articles(rows, profile, **options).collect()}
    assert ids(quality="outliers") == {40} and ids(quality="warnings") == set(range(0, 40, 5))
    assert ids(quality="clean") == set(range(40)) - set(range(0, 40, 5))
    assert ids(band="short") == set(range(11)) and 40 in ids(band="long") and ids(min_candidates=3) == set()
