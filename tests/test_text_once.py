"""What depends on the text of a claim alone is worked out once for each distinct text."""
from pyspark.sql import functions as F

from statproof.operators import evidence as op

STATS = ("org_id string, tbl_id string, tbl_nm string, survey string, c1_obj_nm string, c1_nm string, c2_obj_nm string, c2_nm string,"
         " itm_nm string, unit_nm string, prd_de string, dt string, lst_chn_de string")


def _stats(spark, rows):
    return spark.createDataFrame([("1", t, "표", "", "지역", c, "", "계", "주문 건수", "건", "1996", "5", "") for t, c in rows], STATS)


def test_a_sentence_is_parsed_once_for_all_its_claims(spark, tmp_path):
    sentence = F.when(F.col("id") % 2 == 0, "1996년 서울 주문 건수는 5건이다.").when(F.col("id") % 3 > 0, "작년 주문 건수는 7건이다.")
    spark.range(60).select(F.col("id").alias("claim_id"), sentence.alias("sentence"), F.lit("1997-06-15").alias("article_date"), "id").write.parquet(str(tmp_path / "c"))
    claims = spark.read.parquet(str(tmp_path / "c"))
    got = op.parse_for_verdict(claims)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    generated = plan.index("Generate")
    assert "Aggregate [sentence" in plan[generated:] and plan.count("Generate") == 1
    assert got.columns == [*claims.columns, "path", "q", "op", "trend", "period", "early"]
    assert {tuple(r) for r in got.groupBy("sentence", "period", "q.value").count().collect()} == {
        ("1996년 서울 주문 건수는 5건이다.", "1996", 5.0, 30), ("작년 주문 건수는 7건이다.", "1996", 7.0, 20), (None, "1997", None, 10)}


def test_claims_of_one_text_share_the_pick_of_their_slice(spark):
    claims = spark.createDataFrame([(1, "A", "1996", "서울 5건"), (1, "B", "1996", "서울 5건"), (2, "A", "1996", "서울 5건"), (3, "A", "1996", None),
                                    (4, "C", "1996", "서울 5건"), (5, "A", None, "서울 5건"), (6, None, "1996", "서울 5건")],
                                   "claim_id long, tbl_id string, period string, sentence string")
    stats = _stats(spark, [("A", "서울"), ("A", "전국"), ("B", "부산"), ("B", "전국"), ("C", "부산")])
    got = sorted(((r.claim_id, r.tbl_id or "", r.c1_pick) for r in op.pick_category(claims, stats).collect()))
    assert got == [(1, "A", "서울"), (1, "B", "전국"), (2, "A", "서울"), (3, "A", "전국"), (4, "C", None), (5, "A", None), (6, "", None)]
