"""Candidate tables of a claim, and the evidence operators on every (claim, table) pair."""
from statproof.operators import evidence as op

CATALOG = [("A", "A", "1", "주문 건수", "주문 건수", "1990", "1999"), ("B", "B", "1", "주문 금액", "주문 금액", "1990", "1994"),
           ("C", "C", "2", "주문 건수", "주문 건수", None, None), ("D", "D", "2", "날씨", "날씨", "1990", "1999")]
CLAIMS = [(1, "1996년 서울 주문 건수는 5건이다.", "1996"), (2, "1993년 주문 금액은 5원이다.", "1993"), (3, "아무것도 아니다.", "1996"),
          (4, "1996년 서울 주문 건수는 5건이다.", None)]


def _pairs(spark, depth=10):
    claims = spark.createDataFrame(CLAIMS, "claim_id long, sentence string, period string")
    catalog = spark.createDataFrame(CATALOG, "ord string, tbl_id string, org_id string, tbl_nm string, doc string, start_prd string, end_prd string")
    return op.candidate_tables(claims, catalog, depth)


def test_tables_outside_the_year_go_and_ties_follow_the_catalog(spark):
    got = {(r.claim_id, r.rank): (r.tbl_id, r.orig_rank) for r in _pairs(spark).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 1): ("A", 1), (1, 2): ("C", 2)}
    assert got[(2, 1)] == ("B", 1) and {v[0] for k, v in got.items() if k[0] == 2} == {"A", "B", "C"}
    assert not [k for k in got if k[0] == 3]
    assert {v[0] for k, v in got.items() if k[0] == 4} == {"A", "B", "C"}  # no known year excludes nothing


def test_every_pair_resolves_its_category_in_its_own_table(spark):
    rows = [("A", "서울", "1996", "5"), ("A", "전국", "1996", "9"), ("C", "부산", "1996", "1"), ("C", "부산", "1996", "2"), ("A", "서울", "1995", "4")]
    stats = spark.createDataFrame([("1", t, "표", "", "지역", c, "", "계", "주문 건수", "건", p, v, "") for t, c, p, v in rows],
                                  "org_id string, tbl_id string, tbl_nm string, survey string, c1_obj_nm string, c1_nm string, c2_obj_nm string, c2_nm string,"
                                  " itm_nm string, unit_nm string, prd_de string, dt string, lst_chn_de string")
    pairs = op.per_table(_pairs(spark).where("claim_id = 1"))
    ev = op.category_evidence(pairs, stats)
    got = sorted((r.claim_id.claim_id, r.claim_id.tbl_id, r.c1_pick, r.value) for r in ev.collect())
    assert got == [(1, "A", "서울", 5.0), (1, "C", None, 1.0), (1, "C", None, 2.0)]


def test_year_before(spark):
    df = spark.createDataFrame([("1996",), ("1996-03",), ("1996Q1",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(op.year_before(df.p)).collect()] == ["1995", "1995-03", "1995Q1", None, None]
