"""Joins whose sizes are misjudged before texts are cut, or whose keys have few values."""
from pyspark.sql import functions as F

from statproof.functions import scale
from statproof.operators import evidence, ranking


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_cut_into_grams_are_not_broadcast(spark, tmp_path):
    spark.range(1000).select("id", F.lit("다문화 혼인 비중").alias("sentence"), F.lit("2024").alias("period")).write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    registry = spark.createDataFrame([("m", "혼인", 2023, 1, 2), ("m", "혼인", 2024, 3, 4)], "metric string, alias string, year int, numerator long, denominator long")
    pairs = scale.anchored_contains(texts, "sentence", registry.select("metric", "alias").distinct(), "alias")
    assert "BroadcastHashJoin" not in _plan(pairs) and pairs.count() == 1000
    got = evidence.share_metric(texts.withColumnRenamed("id", "claim_id"), registry)
    assert [tuple(r) for r in got.groupBy("metric", "share", "previous_share").count().collect()] == [("m", 75.0, 50.0, 1000)]


def test_one_key_is_dealt_to_groups(spark):
    big = spark.range(500).select("id", F.lit("k").alias("key")).unionByName(spark.range(500, 510).select("id", F.lit("none").alias("key")))
    small = spark.createDataFrame([("k", 1), ("k", 2)], "key string, v int")
    for how, n in (("inner", 1000), ("left", 1010)):
        got = scale.salted_join(big, small, ["key"], ["id"], how)
        assert got.columns == ["key", "id", "v"] and got.count() == n == got.distinct().count()
        assert "_salt" in _plan(got) and "BroadcastHashJoin" not in _plan(got)


def test_the_catalog_is_not_joined_with_its_own_texts(spark, tmp_path):
    spark.range(30).select(F.col("id").alias("ord"), F.concat(F.lit("t"), F.col("id") % 3).alias("doc")).write.parquet(str(tmp_path / "c"))
    scored = spark.createDataFrame([(7, 1, 0.5, 0.5), (7, 0, 0.4, 0.4)], "qg long, dg long, score double, sort_score double")
    got = ranking._expand(scored, spark.createDataFrame([(7, "q"), (9, "q")], "qid long, query string"), spark.read.parquet(str(tmp_path / "c")), 12)
    assert _plan(got).count("FileScan parquet") == 1
    want = [(i + 1, o, 0.5) for i, o in enumerate(range(1, 30, 3))] + [(11, 0, 0.4), (12, 3, 0.4)]
    assert sorted((r["qid"], r["rank"], r["ord"], r["score"]) for r in got.collect()) == [(q, *w) for q in (7, 9) for w in want]
