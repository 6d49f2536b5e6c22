"""Brute-force checks of the distributed building blocks on one hot key, file sources and streaming re-delivery."""
import random

import pytest
from pyspark.sql import functions as F

from statproof.functions import scale
from statproof.operators import corpus, ranking, snapshots
from statproof.plans import corpus_queries
from statproof.sources import articles as src
from statproof.streaming import jobs


def test_row_number_and_running_values_with_hot_key(spark):
    rnd = random.Random(3)
    keys = rnd.sample(range(10**6), 500)
    rows = [(k, "hot" if i % 3 else f"k{i % 7}", k // 1000, i % 5) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "id long, key string, bucket long, v int")
    got = {r["id"]: r["row_number"] for r in scale.with_row_number(df, "id", buckets=8).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    lag = {r["id"]: r["prev"] for r in scale.lag_by_bucket(df, ["key"], F.col("bucket"), ["id"], "v", "prev").collect()}
    run = {r["id"]: r["total"] for r in scale.running_sum_by_bucket(df, ["key"], F.col("bucket"), ["id"], F.col("v"), "total").collect()}
    last, total = {}, {}
    for k, key, _, v in sorted(rows):
        assert lag[k] == last.get(key)
        total[key] = total.get(key, 0) + v
        assert run[k] == total[key]
        last[key] = v


def test_contains_join_is_exact(spark):
    texts = [(i, "".join(random.Random(i).choices("abc", k=12))) for i in range(60)]
    needles = [(n,) for n in ("a", "ab", "abc", "cab", "bbbb", "c")]
    got = scale.anchored_contains(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame(needles, "n string"), "n")
    assert {(r["id"], r["n"]) for r in got.collect()} == {(i, n) for i, t in texts for (n,) in needles if n in t}


def test_first_per_key_is_trimmed_map_side(spark):
    plan = scale.first_per_key(spark.range(10).selectExpr("id", "id % 2 AS k"), ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_csv_jsonl_and_safe_sink(spark, tmp_path):
    rows = [("=SUM(1)", "2024-01-01", "https://x/1", "줄 하나\n줄 둘"), ("b", None, "", "본문")]
    df = spark.createDataFrame(rows, "`제목` string, `작성일` string, URL string, `본문` string")
    df.write.csv(str(tmp_path / "in.csv"), header=True, quote='"', escape='"')
    df.write.json(str(tmp_path / "in.jsonl"))
    for name in ("in.csv", "in.jsonl"):
        got = src.read_articles(spark, str(tmp_path / name)).select("title", "date", "url", "body").collect()
        assert {(r["title"], r["body"]) for r in got} == {("=SUM(1)", "줄 하나\n줄 둘"), ("b", "본문")}
    src.write_safe_csv(df, str(tmp_path / "out"))
    assert "'=SUM(1)" in spark.read.text(str(tmp_path / "out")).agg(F.concat_ws("", F.collect_list("value"))).first()[0]


def test_bounded_export_refuses_instead_of_cutting(spark):
    df = spark.range(20).select("id", F.lit("x").alias("c"))
    assert src.bounded_export(df, [F.desc("id")], max_rows=20).first()["id"] == 19
    with pytest.raises(Exception, match="limit"):
        src.bounded_export(df, [F.desc("id")], max_rows=19).collect()


def test_export_parts_hold_every_row_within_the_limits(spark):
    df = spark.range(25).select("id", F.concat(F.lit("="), F.repeat(F.lit("x"), F.col("id").cast("int"))).alias("c"))
    got = src.export_parts(df, "id", [F.desc("id")], max_rows=10, max_bytes=10_000)
    assert [(r["part"], r["id"]) for r in got.collect()] == [(p, i) for p, ids in ((0, range(9, -1, -1)), (1, range(19, 9, -1)), (2, range(24, 19, -1))) for i in ids]
    sizes = src.export_parts(df, "id", ["id"], max_rows=10, max_bytes=100).groupBy("part").agg(F.sum(F.length("id") + F.length("c") + 2).alias("n"), F.count("id").alias("k")).collect()
    assert sum(r["k"] for r in sizes) == 25 and max(r["n"] for r in sizes) <= 100
    assert src.export_parts(df.where("id < 0"), "id", ["id"]).count() == 0
    with pytest.raises(Exception, match="byte limit"):
        src.export_parts(df, "id", ["id"], max_bytes=20).collect()


def test_export_query_gives_more_rows_than_one_export_may_hold(spark, tmp_path):
    docs = spark.range(50_001).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit("t").alias("text"), F.lit(1).alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_queries.QUERIES["a14_export_rows"](spark, str(tmp_path)).count() == 50_001


def test_catalog_cycles_and_row_range(spark):
    edges = spark.createDataFrame([("r", "a", False), ("a", "b", False), ("b", "a", False), ("b", "T1", True), ("r", "T1", True), ("x", "T2", True)], "parent_id string, child_id string, is_table boolean")
    got = ranking.expand_catalog(edges, spark.createDataFrame([("r",)], "root_id string")).collect()
    assert [(r["tbl_id"], r["depth"], r["list_id"]) for r in got] == [("T1", 0, "r")]
    with pytest.raises(ValueError):
        corpus.row_range(spark.range(5), "id", 1, 1001)


def test_selection_text(spark):
    r = spark.range(1).select(snapshots.parse_selection(F.lit(" a = 1 ;b=2")).alias("m"), snapshots.parse_selection(F.lit("a=;b=2")).alias("bad")).first()
    assert r["m"] == {"a": "1", "b": "2"} and r["bad"] is None


def test_lifecycle_stream_over_batches(spark, tmp_path):
    schema = "event_id long, claim_id long, ts timestamp, state string, reason string"
    def put(name, rows):
        spark.createDataFrame(rows, "event_id long, claim_id long, ts string, state string, reason string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    put("a", [(1, 1, "2024-01-01 00:00:00", "DETECTED", ""), (2, 1, "2024-01-03 00:00:00", "PARSED", "")])
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    jobs.stream_lifecycle(stream(), out, ck)
    put("b", [(3, 1, "2024-01-04 00:00:00", "MAPPED", ""), (4, 1, "2024-01-02 00:00:00", "MAPPED", ""), (5, 2, "2024-01-04 00:00:00", "UNVERIFIABLE", "")])
    jobs.stream_lifecycle(stream(), out, ck)
    got = {r["event_id"]: r["check"] for r in spark.read.parquet(out).collect()}
    assert got == {1: "ok", 2: "ok", 3: "ok", 4: "late", 5: "reason_required"}


def test_deep_catalog_is_expanded_to_the_end(spark):
    chain = [(f"l{i}", f"l{i + 1}", False) for i in range(12)] + [("l12", "T", True)]
    edges = spark.createDataFrame(chain, "parent_id string, child_id string, is_table boolean")
    got = ranking.expand_catalog(edges, spark.createDataFrame([("l0",)], "root_id string")).collect()
    assert [(r["tbl_id"], r["depth"]) for r in got] == [("T", 12)]


def test_articles_with_equal_short_ids_are_both_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "with_article_id", lambda df: df.withColumn("article_id", F.lit("art_same")))
    rows = [(i, f"title {i}", "2024-01-01", "", f"https://x/{i % 2}", f"본문 {i}는 사과 농가 이야기다.", "") for i in range(4)]
    df = spark.createDataFrame(rows, "row_no long, title string, date string, section string, url string, body string, label string")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.stream_ingest(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
        df.write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(r["url"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["https://x/0", "https://x/1"]


def test_lifecycle_drops_redelivered_events(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "DETECTED", ""), (2, 1, "2024-01-03 00:00:00", "PARSED", "")],
                               "event_id long, claim_id long, ts string, state string, reason string").withColumn("ts", F.to_timestamp("ts"))
    for _ in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        jobs.stream_lifecycle(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted((r["event_id"], r["check"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "ok"), (2, "ok")]


def test_shared_coordinate_pairs_nothing(spark):
    stats = spark.createDataFrame([("T", f"r{i}", "축", f"v{i}", "항목", f"20{i:02d}", "건") for i in range(30)], "tbl_id string, row_no string, c1_obj_nm string, c1_nm string, itm_nm string, prd_de string, unit_nm string")
    claims = spark.createDataFrame([(1, "T", "v3", "2003", "건", ""), (2, "T", "v4", "", "건", "항"), (3, "T", "none", "", "건", "")], "claim_id long, tbl_id string, subject string, period string, unit string, comparison string")
    coords = snapshots.recommend_coords(snapshots.coordinate_axes(stats), claims)
    assert {(r["claim_id"], r["label"]) for r in coords.collect()} == {(1, "축"), (1, "시점"), (1, "단위"), (2, "축"), (2, "단위"), (2, "항목"), (3, "단위")}
    plan = coords._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {(r["claim_id"], r["row_no"]) for r in snapshots.rows_at(stats, coords).collect()}
    assert got == {(1, "r3"), (2, "r4")} | {(3, f"r{i}") for i in range(30)}


def test_contained_maps_with_a_pair_shared_by_most(spark):
    rng = random.Random(6)
    offered = [(i, {"flag": "A", **{k: str(rng.randint(0, 3)) for k in "xyz"}}) for i in range(120)] + [(500, {"x": "1"})]
    wanted = [(0, {"flag": "A", "x": "1", "y": "2"}), (1, {"flag": "A"}), (2, {"x": "1"}), (3, {"x": "9", "flag": "A"}), (4, {"nope": "1"})]
    got = scale.contained_maps(spark.createDataFrame(wanted, "w long, wmap map<string,string>"), spark.createDataFrame(offered, "o long, omap map<string,string>"))
    assert {tuple(r) for r in got.collect()} == {(w, o) for w, m in wanted for o, n in offered if m.items() <= n.items()}
