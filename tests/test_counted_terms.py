"""Search terms of a table are counted by distinct sentence, and a sentence is labelled once."""
import datetime

import pytest
from pyspark.sql import functions as F

from statproof.operators import extraction, ranking as op
from statproof.plans import ranking_queries as q


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i if i % 10 else None, i % 4, datetime.date(1995 + i % 3, 1, 1) if i % 7 else None) for i in range(120)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["c12_query_plan", "c12_query_budget"])
def test_a_sentence_is_labelled_once(spark, folder, name):
    plan = q.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[가-힣]|%p") == 1  # the first pattern of a label
    assert "Aggregate [" in plan[plan.index("Generate"):]


def test_counts_are_those_of_all_rows(spark):
    sentence = F.when(F.col("id") % 3 == 0, "작년 취업자는 5만 명이다.").when(F.col("id") % 4 == 0, "서울 청년 실업률은 올해 6.1%다.").when(F.col("id") % 5 > 0, "아무 관련 없는 문장")
    sent = spark.range(90).select(sentence.alias("sentence"), F.lit(7).alias("n"))
    each = extraction.search_terms(sent).select(F.coalesce(F.get("terms", F.lit(0)), F.lit("")).alias("query"), "source.domain")
    counted = extraction.counted_terms(sent)
    expected = {tuple(r) for r in each.groupBy("query", "domain").count().collect()}
    assert {tuple(r) for r in counted.groupBy("query", "domain").agg(F.sum("n")).collect()} == expected and len(expected) > 2
    assert {tuple(r) for r in op.query_plan(counted, "n").collect()} == {tuple(r) for r in op.query_plan(each).collect()}
    assert op.query_budget(counted, 2, "n").collect() == op.query_budget(each, 2).collect()
    assert op.query_plan(extraction.counted_terms(sent.where("false")), "n").count() == 0
    none = op.query_budget(extraction.counted_terms(sent.where("false")), 2, "n").first()
    assert none == op.query_budget(each.where("false"), 2).first()
