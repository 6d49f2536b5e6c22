"""Registered queries D01-D30 with their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from statproof.functions import lexicon as lx, text as tx, verdict as vd
from statproof.operators import evidence as op
from statproof.plans.fixtures import Tables, with_clause

K = "claim_id"


def _catalog(t):
    c = t.catalog_tables
    return c.select(F.xxhash64("tbl_id").alias("ord"), "tbl_id", "org_id", "tbl_nm", F.concat_ws(" ", "tbl_nm", "survey").alias("doc"))


def _tabled(t, tbl="DT_ORD_Y"):
    s = F.col("sentence")
    return (op.parse_for_verdict(t.claims.select(K, "sentence", "article_date")).withColumn("tbl_id", F.lit(tbl)).withColumn("tbl_nm", F.lit("국가별 주문 건수")))


def d01(spark, d):
    t = Tables(spark, d)
    ev = op.fetch_evidence(_tabled(t).select(K, "tbl_id", "period"), t.official_stats, c2="계")
    return ev.groupBy(K, "prd_se", "unit").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def d02(spark, d):
    t = Tables(spark, d)
    return op.pick_category(_tabled(t), t.official_stats).select(K, "c1_pick")


def d03(spark, d):
    t = Tables(spark, d)
    ev = op.match_basis(op.category_evidence(_tabled(t, "DT_RATE_Y"), t.official_stats))
    return ev.groupBy(K, "basis", "basis_missing", "basis_used").agg(F.count(F.lit(1)).alias("n"))


def d04(spark, d):
    t = Tables(spark, d)
    total = t.official_stats.where("tbl_id = 'DT_IDX_Y'")
    both = total.unionByName(total.withColumn("itm_nm", F.lit("생활지수")))
    ev = op.prefer_total(op.category_evidence(_tabled(t, "DT_IDX_Y"), both))
    return ev.groupBy(K, "itm_nm").agg(F.count(F.lit(1)).alias("n"))


def d05(spark, d):
    t = Tables(spark, d)
    return op.guard_granularity(op.category_evidence(_tabled(t), t.official_stats))


def d06(spark, d):
    t = Tables(spark, d)
    return op.guard_revision(op.category_evidence(_tabled(t), t.official_stats)).select(K, "latest", "stale")


def d07(spark, d):
    t = Tables(spark, d)
    c = _tabled(t).withColumn("tbl_nm", F.lit("거래량지수(1996=100)"))
    return op.guard_base_year(c).select(K, F.coalesce("base_year_risk", F.lit(False)).alias("base_year_risk"), vd.index_base_year(F.col("tbl_nm")).alias("base_year"))


def d08(spark, d):
    """Age bands: customers by nation and balance band stand in for a table with age-band categories."""
    t = Tables(spark, d)
    age = (20 + F.pmod(F.col("c_custkey"), F.lit(6)) * 10).cast("string")
    rows = t.customer.groupBy("c_nationkey", age.alias("age")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    bands = rows.select("c_nationkey", F.when(F.col("age") == "70", F.lit("70세 이상")).otherwise(F.concat("age", F.lit("~"), (F.col("age") + 9).cast("int").cast("string"), F.lit("세"))).alias("dim"), "value")
    total = rows.groupBy("c_nationkey").agg(F.sum("value").alias("value")).select("c_nationkey", F.lit("계").alias("dim"), "value")
    ev = bands.unionByName(total).withColumn("claim_id", F.col("c_nationkey").cast("long"))
    ev = ev.withColumn("sentence", F.concat((F.col("claim_id") % 5 * 10 + 30).cast("string"), F.lit("세 이상 인구 비율은 40%다.")))
    for c in ("c1_nm", "c2_nm", "itm_nm", "prd_de"):
        ev = ev.withColumn(c, F.col("dim"))
    return op.ratio_age_band(ev).select(K, F.round("ratio", 6).alias("ratio"))


def d09(spark, d):
    t = Tables(spark, d)
    cur = _tabled(t)
    prev = cur.withColumn("period", (F.col("period").cast("int") - 1).cast("string"))
    return op.change_rate(op.category_evidence(cur, t.official_stats), op.category_evidence(prev, t.official_stats)).select(
        K, F.round("rate", 6).alias("rate"), "direction")


def _share_claims(t):
    return t.orders.select(F.col("o_orderkey").alias(K), (2023 + F.col("o_orderkey") % 3).cast("string").alias("period"), F.when(
        F.col("o_custkey") % 3 == 0, F.lit("다문화 혼인 비중은 9.6%다.")).when(F.col("o_custkey") % 3 == 1, F.lit("다문화 출생 구성비가 늘었다.")).otherwise(F.lit("다문화 혼인이 늘었다.")).alias("sentence"))


def _registry(spark):
    return spark.createDataFrame(lx.DEFAULT_SHARES, "metric string, alias string, year int, numerator long, denominator long")


def d10(spark, d):
    s = op.share_metric(_share_claims(Tables(spark, d)), _registry(spark))
    return s.groupBy("metric", F.round("share", 6).alias("share"), F.round("point_change", 6).alias("point_change")).agg(F.count(F.lit(1)).alias("n"))


_UNIT_OF = {i: u for i, u in enumerate(["%", "명", "만명", "억원", "㎢", "곳", "", "천가구"])}


def d11(spark, d):
    o = Tables(spark, d).orders
    unit = F.lit("")
    for i, u in _UNIT_OF.items():
        unit = F.when(F.col("o_orderkey") % 8 == i, F.lit(u)).otherwise(unit)
    f = o.withColumn("f", tx.unit_family(unit))
    return f.select("o_orderkey", F.round(F.col("o_totalprice") * F.col("f.factor"), 0).alias("value"), "f.family")


def d12(spark, d):
    l = Tables(spark, d).lineitem
    units, offs = ["건", "%", "만명", "명"], ["건", "%p", "명", "원"]

    def pick(values, key):
        out = F.lit(values[-1])
        for i, v in enumerate(values[:-1]):
            out = F.when(key % 4 == i, F.lit(v)).otherwise(out)
        return out
    op_ = F.when(F.col("l_linenumber") % 5 == 1, "gte").when(F.col("l_linenumber") % 5 == 2, "lte").otherwise("eq")
    official = F.col("l_quantity") * (1 + F.col("l_discount") * F.when(F.col("l_suppkey") % 3 == 0, 0.05).when(F.col("l_suppkey") % 3 == 1, 0.2).otherwise(1.0)) * F.when(
        F.col("l_partkey") % 4 == 2, 10000.0).otherwise(1.0)
    # official units follow the claim unit, except that part keys divisible by 8 are deliberately crossed
    ou = F.when(F.col("l_partkey") % 8 == 0, pick(offs, F.col("l_suppkey"))).otherwise(F.when(F.col("l_partkey") % 4 == 2, "명").otherwise(pick(units, F.col("l_partkey"))))
    c = vd.compare(F.col("l_quantity"), pick(units, F.col("l_partkey")), F.lit(1), official, ou, op_)
    return l.select(c.alias("c")).groupBy("c.label", "c.path", "c.confidence").agg(F.count(F.lit(1)).alias("n"))


def verdicts(spark, d):
    t = Tables(spark, d)
    return op.verify_claims(t.claims.select(K, "sentence", "article_date"), _catalog(t), t.official_stats, _registry(spark))


def d13(spark, d):
    return verdicts(spark, d).select(K, "label", "confidence", "reason", F.array_join("rules", ",").alias("rules"))


def d13_summary(spark, d):
    v = verdicts(spark, d)
    tier = vd.triage(F.col("label"), F.col("confidence"), F.col("calculation"), F.lit("KOSIS_DOMESTIC"))
    return v.groupBy("label", "reason", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def d14(spark, d):
    a = op.audit_rows(verdicts(spark, d), "https://kosis.kr/openapi/Param/statisticsParameterData.do")
    return a.select(K, "tbl_id", "prd_de", "prd_se", "url")


QUERIES = {"d01_fetch_evidence": d01, "d02_pick_category": d02, "d03_match_basis": d03, "d04_prefer_total": d04, "d05_guard_granularity": d05,
           "d06_guard_revision": d06, "d07_guard_base_year": d07, "d08_ratio_age_band": d08, "d09_change_rate": d09, "d10_share_metric": d10,
           "d11_normalize_units": d11, "d12_compare_values": d12, "d13_verify_claims": d13, "d13_verify_summary": d13_summary, "d14_audit_rows": d14}

_C = with_clause("claims", "official_stats")
_NAME = "CASE WHEN c1 = '전국' THEN c1 ELSE concat('국가 : ', c1) END"
_PER = "CASE k WHEN 7 THEN y + 2 ELSE y END"
_EV = _C + f""", pc AS (SELECT *, {_PER} AS p FROM claims),
  ev AS (SELECT pc.*, c2_nm, itm_nm, prd_de, TRY_CAST(replace(dt, ',', '') AS DOUBLE) AS value, lst_chn_de FROM pc JOIN official_stats o ON o.tbl_id = '{{tbl}}' AND o.prd_de LIKE p || '%'
    AND o.c1_nm = {_NAME} WHERE TRY_CAST(replace(dt, ',', '') AS DOUBLE) IS NOT NULL)"""
_STALE = "(c1 = 'NATION_7')"
_RATE = "(100.0 * (n - prev_n) / prev_n)"
_EXPECT = f"""SELECT claim_id, CASE k WHEN 9 THEN 'no_quantity' WHEN 7 THEN 'forecast'
    WHEN 8 THEN CASE WHEN prev_n IS NULL THEN 'no_data' ELSE 'index_base_year' END
    WHEN 6 THEN CASE WHEN prev_n IS NULL THEN 'no_data' END
    WHEN 11 THEN 'granularity' ELSE CASE WHEN {_STALE} THEN 'revised_after_article' WHEN k = 5 AND prev_n IS NULL THEN 'unit_mismatch' END END AS refusal, * EXCLUDE (claim_id) FROM claims"""
_D13 = with_clause("claims") + f""", x AS ({_EXPECT}), v AS (SELECT *,
   CASE WHEN refusal IS NOT NULL THEN 'unverifiable' WHEN k IN (0, 4, 2, 6) THEN 'match' WHEN k IN (1, 3, 10) THEN 'mismatch' WHEN k = 5 AND n <= prev_n THEN 'mismatch' ELSE 'match' END AS label,
   CASE WHEN refusal IS NOT NULL THEN NULL WHEN k IN (0, 1, 4, 6) THEN 'high' WHEN k = 2 THEN CASE WHEN 1.0 / (n - 1) <= 0.01 THEN 'low' ELSE 'medium' END
     WHEN k = 3 THEN CASE WHEN 5.0 / (n - 5) <= 0.01 THEN 'low' ELSE 'medium' END ELSE 'medium' END AS confidence,
   coalesce(refusal, CASE WHEN k IN (0, 4, 6) THEN 'rounded' WHEN k IN (1, 10) THEN 'relative' WHEN k IN (2, 3) THEN 'threshold' WHEN n <= prev_n THEN 'direction' ELSE 'rounded' END) AS reason,
   CASE WHEN refusal = 'granularity' THEN 'A2-0015' WHEN refusal = 'revised_after_article' THEN 'A2-0012' WHEN refusal = 'index_base_year' THEN 'A2-0013'
     WHEN refusal IS NOT NULL THEN '' WHEN k IN (2, 3) THEN 'A2-0001' WHEN k = 6 THEN 'A2-0016' WHEN k = 5 THEN CASE WHEN n <= prev_n THEN 'A2-0009' ELSE 'A2-0009,A2-0004' END ELSE '' END AS rules FROM x)"""
_CU = "CASE l_partkey % 4 WHEN 0 THEN '건' WHEN 1 THEN '%' WHEN 2 THEN '만명' ELSE '명' END"
_OU = f"CASE WHEN l_partkey % 8 = 0 THEN CASE l_suppkey % 4 WHEN 0 THEN '건' WHEN 1 THEN '%p' WHEN 2 THEN '명' ELSE '원' END WHEN l_partkey % 4 = 2 THEN '명' ELSE {_CU} END"
_FAM = "CASE {0} WHEN '%' THEN 'percent' WHEN '%p' THEN 'percent_point' WHEN '원' THEN 'krw' ELSE 'count' END"

ORACLE = {
    "d01_fetch_evidence": _C + f""" SELECT claim_id, 'Y' AS prd_se, '건' AS unit, count(*) AS n, round(sum(CAST(replace(dt, ',', '') AS DOUBLE)), 3) AS total FROM claims
      JOIN official_stats o ON o.tbl_id = 'DT_ORD_Y' AND o.c2_nm = '계' AND o.prd_de = CAST({_PER} AS STRING) GROUP BY 1""",
    "d02_pick_category": _C + f""" SELECT claim_id, CASE WHEN EXISTS (SELECT 1 FROM official_stats o WHERE o.tbl_id = 'DT_ORD_Y' AND o.prd_de = CAST({_PER} AS STRING)) THEN {_NAME} END AS c1_pick FROM claims""",
    "d03_match_basis": _EV.replace("{tbl}", "DT_RATE_Y") + """ SELECT claim_id, CASE WHEN k = 6 THEN '전년' ELSE '' END AS basis, FALSE AS basis_missing, k = 6 AS basis_used, count(*) AS n FROM ev GROUP BY claim_id, k""",
    "d04_prefer_total": _EV.replace("{tbl}", "DT_IDX_Y") + " SELECT claim_id, '총지수' AS itm_nm, count(*) AS n FROM ev GROUP BY 1",
    "d05_guard_granularity": _EV.replace("{tbl}", "DT_ORD_Y") + " SELECT claim_id, k = 11 AS granularity_mismatch FROM ev GROUP BY claim_id, k",
    "d06_guard_revision": _EV.replace("{tbl}", "DT_ORD_Y") + " SELECT claim_id, max(lst_chn_de) AS latest, max(lst_chn_de) > any_value(article_date) AS stale FROM ev GROUP BY claim_id",
    "d07_guard_base_year": _C + " SELECT claim_id, k = 8 AS base_year_risk, '1996' AS base_year FROM claims",
    "d08_ratio_age_band": """WITH c AS (SELECT c_nationkey, 20 + c_custkey % 6 * 10 AS age FROM customer)
      SELECT CAST(c_nationkey AS BIGINT) AS claim_id, round(count(*) FILTER (age >= c_nationkey % 5 * 10 + 30) * 100.0 / count(*), 6) AS ratio FROM c GROUP BY c_nationkey
      HAVING count(*) FILTER (age >= c_nationkey % 5 * 10 + 30) > 0""",
    "d09_change_rate": _C + f", z AS (SELECT *, CASE k WHEN 7 THEN NULL ELSE {_RATE} END AS rate FROM claims WHERE k IN (5, 10) AND prev_n IS NOT NULL) SELECT claim_id, round(rate, 6) AS rate, CASE WHEN rate > 0 THEN 'up' ELSE 'down' END AS direction FROM z",
    "d10_share_metric": """WITH c AS (SELECT 2023 + o_orderkey % 3 AS y, o_custkey % 3 AS m FROM orders) SELECT CASE m WHEN 0 THEN '다문화 혼인' ELSE '다문화 출생' END AS metric,
      round(CASE m WHEN 0 THEN 21450 / 222412 ELSE 13416 / 238317 END * 100, 6) AS share, round(CASE m WHEN 0 THEN 21450 / 222412 - 20431 / 193657 ELSE 13416 / 238317 - 12150 / 230028 END * 100, 6) AS point_change,
      count(*) AS n FROM c WHERE y = 2024 AND m < 2 GROUP BY m""",
    "d11_normalize_units": """SELECT o_orderkey, round(o_totalprice * CASE o_orderkey % 8 WHEN 2 THEN 1e4 WHEN 3 THEN 1e8 WHEN 4 THEN 100 WHEN 7 THEN 1000 ELSE 1 END, 0) AS value,
      CASE o_orderkey % 8 WHEN 0 THEN 'percent' WHEN 1 THEN 'count' WHEN 2 THEN 'count' WHEN 3 THEN 'krw' WHEN 4 THEN 'area_ha' WHEN 5 THEN 'unknown' WHEN 6 THEN 'unitless' ELSE 'count' END AS family FROM orders""",
    "d12_compare_values": f"""WITH a AS (SELECT l_quantity AS c, {_CU} AS cu, {_OU} AS ou, CASE l_linenumber % 5 WHEN 1 THEN 'gte' WHEN 2 THEN 'lte' ELSE 'eq' END AS op,
        l_quantity * (1 + l_discount * CASE l_suppkey % 3 WHEN 0 THEN 0.05::DOUBLE WHEN 1 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END) * CASE WHEN l_partkey % 4 = 2 THEN 10000.0::DOUBLE ELSE 1.0::DOUBLE END AS o FROM lineitem),
      b AS (SELECT *, {_FAM.format('cu')} AS f1, {_FAM.format('ou')} AS f2, CASE WHEN cu = '만명' THEN 1e4::DOUBLE ELSE 1.0::DOUBLE END AS cf FROM a),
      e AS (SELECT *, c * cf AS cv, o AS ov, cf <> 1 OR op <> 'eq' OR cu <> ou AS conv, abs(o - c * cf) / greatest(abs(c * cf), 1e-12) AS mar, abs(o - c * cf) / greatest(abs(o), 1e-12) AS rel,
        round_even(o / cf, 1) = round_even(c, 1) AS rd FROM b),
      r AS (SELECT CASE WHEN f1 <> f2 THEN CASE WHEN f1 IN ('percent', 'percent_point') AND f2 IN ('percent', 'percent_point') THEN 'mismatch' ELSE 'unverifiable' END
          WHEN op = 'gte' THEN CASE WHEN ov >= cv THEN 'match' ELSE 'mismatch' END WHEN op = 'lte' THEN CASE WHEN ov <= cv THEN 'match' ELSE 'mismatch' END WHEN rd OR rel <= 0.005 THEN 'match' ELSE 'mismatch' END AS label,
        CASE WHEN f1 <> f2 THEN CASE WHEN f1 IN ('percent', 'percent_point') AND f2 IN ('percent', 'percent_point') THEN 'percent_point_confusion' ELSE 'unit_family' END
          WHEN op <> 'eq' THEN 'threshold' WHEN rd THEN 'rounded' ELSE 'relative' END AS path,
        CASE WHEN f1 <> f2 THEN CASE WHEN f1 IN ('percent', 'percent_point') AND f2 IN ('percent', 'percent_point') THEN 'medium' END WHEN op <> 'eq' THEN CASE WHEN mar <= 0.01 THEN 'low' ELSE 'medium' END
          WHEN NOT rd AND rel <= 0.005 AND rel > 0.0025 THEN 'low' WHEN NOT rd AND rel > 0.005 AND rel <= 0.015 THEN 'low' WHEN conv THEN 'medium' ELSE 'high' END AS confidence FROM e)
      SELECT label, path, confidence, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "d13_verify_claims": _D13 + " SELECT claim_id, label, confidence, reason, rules FROM v",
    "d13_verify_summary": _D13 + """ SELECT label, reason, CASE WHEN label = 'unverifiable' THEN 'UNVERIFIABLE' ELSE 'NEEDS_REVIEW' END AS tier, count(*) AS n FROM v GROUP BY 1, 2, 3""",
    "d14_audit_rows": with_clause("claims") + f""", x AS ({_EXPECT}) SELECT claim_id, CASE k WHEN 8 THEN 'DT_IDX_Y' WHEN 6 THEN 'DT_RATE_Y' ELSE 'DT_ORD_Y' END AS tbl_id, CAST(y AS STRING) AS prd_de, 'Y' AS prd_se,
      concat('https://kosis.kr/openapi/Param/statisticsParameterData.do?method=getList&apiKey={{API_KEY}}&itmId=ALL&objL1=ALL&objL2=&objL3=&objL4=&objL5=&objL6=&objL7=&objL8=&format=json&jsonVD=Y&prdSe=Y&orgId=',
        CASE k WHEN 8 THEN '102' ELSE '101' END, '&tblId=', CASE k WHEN 8 THEN 'DT_IDX_Y' WHEN 6 THEN 'DT_RATE_Y' ELSE 'DT_ORD_Y' END, '&startPrdDe=', y, '&endPrdDe=', y) AS url FROM x WHERE k NOT IN (7, 9)""",
}
