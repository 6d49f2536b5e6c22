"""Registered queries D15-D30 with their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from statproof.operators import snapshots as op
from statproof.plans.fixtures import Tables, with_clause


def _map(**cols):
    return F.create_map(*[x for k, c in cols.items() for x in (F.lit(k), c)])


def _snap(df):
    return df.withColumn("selection", _map(flag=F.col("flag"), status=F.col("status")))


def _stats(t):
    s = t.official_stats
    return s.withColumn("row_no", F.concat_ws("|", "prd_de", "c1_nm", "c2_nm", "itm_nm"))  # unique in a table, and its order


def d15(spark, d):
    return op.build_snapshots(Tables(spark, d).official_stats).select("org_id", "tbl_id", "n_records", "snapshot_id", "content_hash")


def d15_tree(spark, d):
    return op.snapshot_tree(Tables(spark, d).official_stats).select("org_id", "tbl_id", "n_records", "snapshot_id", "content_hash")


def d16(spark, d):
    s = Tables(spark, d).snapshot_before
    a = op.evidence_id(F.col("tbl_id"), F.col("indicator"), _map(flag=F.col("flag"), status=F.col("status")))
    b = op.evidence_id(F.concat(F.lit(" "), "tbl_id"), F.concat("indicator", F.lit("  ")), _map(status=F.col("status"), flag=F.concat("flag", F.lit(" "))))
    want = F.concat(F.lit("DT_SHIP:"), F.substring(F.sha2(F.concat(F.lit("DT_SHIP|출하 수량|flag="), "flag", F.lit(";status="), "status"), 256), 1, 16))
    return s.select("flag", "status", a.alias("evidence_id"), (a == b).alias("stable"), (a == want).alias("as_defined")).distinct()


def _diff(t):
    return op.diff_snapshots(_snap(t.snapshot_before), _snap(t.snapshot_after))


def d17(spark, d):
    return _diff(Tables(spark, d)).select("period", "sel", "change_type", "value_before", "value_after")


def d17_counts(spark, d):
    return op.diff_counts(_diff(Tables(spark, d)))


def _impacts(t):
    m = t.ship_mappings
    sel = F.map_filter(_map(flag=F.col("sel_flag"), status=F.col("sel_status")), lambda k, v: v != "")
    return op.revision_impact(_diff(t), m.select("mapping_id", sel.alias("selection")))


def d18(spark, d):
    return _impacts(Tables(spark, d)).groupBy("mapping_id").agg(F.count(F.lit(1)).alias("n"), F.min("period").alias("first_period"))


def d19(spark, d):
    t = Tables(spark, d)
    imp = _impacts(t)
    ids = imp.select("tbl_id", op.review_id(imp, "b1", "a1").alias("review_id"), "period").distinct()
    old = ids.where("substr(period, 6, 2) = '01'").select("review_id", "tbl_id")
    dec = ids.where("substr(period, 6, 2) IN ('01', '07')").select("review_id", F.when(F.substring("period", 6, 2) == "01", "approved").otherwise("bogus").alias("action"), F.col("period").alias("decided_at"))
    return op.revision_queue(imp, old, dec, "b1", "a1").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _snapshot_claims(t):
    c = t.claims
    return c.select("claim_id", "sentence", F.col("article_date").alias("date"), F.when(F.col("claim_id") % 17 == 0, "NONE").otherwise("DT_ORD_Y").alias("tbl_id"),
                    F.when(F.col("claim_id") % 13 == 0, "다른 항목").otherwise("주문 (건수)").alias("evidence_indicator"),
                    F.create_map(F.lit("국가"), F.when(F.col("c1") == "전국", F.col("c1")).otherwise(F.concat(F.lit("국가 : "), "c1")), F.lit("우선순위"), F.when(F.col("claim_id") % 11 == 0, "X").otherwise("계")).alias("evidence_selection"))


def d20(spark, d):
    t = Tables(spark, d)
    return op.compare_snapshot(_snapshot_claims(t), op.snapshot_records(t.official_stats)).select("claim_id", "status", "gate", F.array_join("gates_passed", ",").alias("gates_passed"))


def d21(spark, d):
    t = Tables(spark, d)
    final = t.snapshot_before.where("status = 'F'").select("period", "flag", F.concat("value", "unit").alias("official_value"))
    flags = t.snapshot_before.select("period", "flag").distinct().join(final, ["period", "flag"], "left")
    c = flags.select(F.concat("period", "flag").alias("claim_id"), F.lit("DT_SHIP").alias("tbl_id"), F.col("period").alias("claim_period"), F.lit("건").alias("claim_unit"), F.lit("출하수량").alias("evidence_indicator"), _map(flag=F.col("flag"), status=F.lit("F")).alias("evidence_selection"),
                     F.when(F.col("flag") == "A", "not_comparable").otherwise("match").alias("status"), "official_value")
    r = op.rank_records(c, _snap(t.snapshot_before).select("tbl_id", "period", "indicator", "selection", "value", "unit"))
    return r.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_primary").alias("primaries"), F.max("match_score").alias("best"), F.min_by("value", "position").alias("top_value"))


def d21_order(spark, d):
    """Claims that name a flag alone, so that records of several statuses pass all gates; the compared one is the largest."""
    t = Tables(spark, d)
    decided = t.snapshot_before.groupBy("period", "flag").agg(F.max("value").alias("v"))
    c = decided.select(F.concat("period", "flag").alias("claim_id"), F.lit("DT_SHIP").alias("tbl_id"), F.replace("period", F.lit("-"), F.lit(".")).alias("claim_period"), F.lit(" 건").alias("claim_unit"),
                       F.lit("출하수량").alias("evidence_indicator"), _map(flag=F.col("flag"), status=F.lit("")).alias("evidence_selection"),
                       F.when(F.col("flag") == "R", "not_comparable").otherwise("match").alias("status"), F.concat("v", F.lit("건")).alias("official_value"))
    r = op.rank_records(c, _snap(t.snapshot_before).select("tbl_id", "period", "indicator", "selection", "value", "unit"))
    return r.select("claim_id", "position", "is_primary", "period", F.col("rsel")["flag"].alias("flag"), F.col("rsel")["status"].alias("record_status"), "value", "match_score")


def d22(spark, d):
    return op.table_structure(_stats(Tables(spark, d)))


def d23(spark, d):
    return op.coordinate_axes(_stats(Tables(spark, d))).groupBy("tbl_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def _coord_claims(t):
    rate = F.col("claim_id") % 5 == 0
    return t.claims.select("claim_id", F.when(rate, "DT_RATE_Y").otherwise("DT_ORD_M").alias("tbl_id"), F.when(F.col("c1") == "전국", "전국").otherwise(F.concat(F.lit("국가 : "), "c1")).alias("subject"),
                           F.concat(F.col("y").cast("string"), F.lit("-0"), (F.col("claim_id") % 8 + 1).cast("string")).alias("period"), F.lit("건").alias("unit"), F.when(rate, "전년비").otherwise("발주량").alias("comparison"))


def d24(spark, d):
    t = Tables(spark, d)
    s = _stats(t)
    return op.recommend_coords(op.coordinate_axes(s), _coord_claims(t)).select("claim_id", "label", "value")


def d24_rows(spark, d):
    t = Tables(spark, d)
    s = _stats(t)
    coords = op.recommend_coords(op.coordinate_axes(s), _coord_claims(t))
    return op.rows_at(s, coords).join(s.select("tbl_id", "row_no", "dt", "prd_de"), ["tbl_id", "row_no"]).select("claim_id", "prd_de", "dt")


def d25(spark, d):
    s = _stats(Tables(spark, d))
    e = op.evidence_draft(s.withColumn("org_nm", F.when(F.col("org_id") == "101", " 통계청").otherwise("한국은행"))
                          .withColumn("prd_se", F.when(F.length("prd_de") == 6, "m").otherwise("Y")))
    return e.withColumn("parsed", F.size(op.parse_selection(F.col("source_selection"))).cast("long"))


def d26(spark, d):
    t = Tables(spark, d)
    c = op.complete_claims(_snapshot_claims(t), op.snapshot_records(t.official_stats), op.build_snapshots(t.official_stats))
    return c.groupBy("verdict", "gate", F.col("snapshot_id").isNotNull().alias("has_snapshot")).agg(F.count(F.lit(1)).alias("n"))


def d27(spark, d):
    o = Tables(spark, d).orders
    k = F.col("o_orderkey")
    sel = o.select(F.concat(F.lit("e"), k).alias("evidence_id"), F.when(k % 7 == 1, "").otherwise("T1").alias("tbl_id"), F.when(k % 11 == 2, " ").otherwise("s1").alias("snapshot_id"), F.when(k % 5 == 3, "s2").alias("comparison_snapshot_id"),
                   F.when(k % 9 == 4, "T2").otherwise("").alias("snapshot_tbl_id"), F.when(k % 13 == 5, "").otherwise("문장").alias("sentence"), F.when(k % 3 == 0, "match").when(k % 3 == 1, "not_comparable").otherwise("mismatch").alias("status"))
    return op.freeze_completions(sel).groupBy("error", "verdict").agg(F.count(F.lit(1)).alias("n"))


MODES = ["direct", "change_rate", "difference", "ratio", "historical_maximum", "historical_minimum", "count_lt_zero", "nonsense"]


def d28(spark, d):
    li = Tables(spark, d).lineitem
    m = F.element_at(F.array(*[F.lit(x) for x in MODES]), (F.col("l_partkey") % 8 + 1).cast("int"))
    c = li.select(m.alias("mode"), F.lit(5.0).alias("claimed"), F.lit(2.0).alias("tolerance"), F.col("l_quantity").alias("a"), (F.col("l_linenumber") - 3).cast("double").alias("b"),
                  F.when(F.col("l_suppkey") % 5 > 0, F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(-1.0))).alias("series"))
    return op.evaluate_formulas(c).groupBy("mode", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("official"), 4).alias("total"))


def d29(spark, d):
    p = Tables(spark, d).part
    k = F.col("p_partkey")
    plans = p.select(k.alias("plan_id"), F.when(k % 2 == 0, F.concat(F.lit("I"), k)).alias("item"), _map(C1=F.col("p_size").cast("string"), note=F.lit("x")).alias("shared"),
                     F.when(k % 3 == 0, F.array(_map(C2=F.lit("a")), _map(C1=F.lit("over"), C3=F.lit("b")))).alias("components"))
    return op.expand_coords(plans).select("plan_id", F.col("component").cast("long").alias("component"), op.canonical_map(F.col("request")).alias("request"))


def d30(spark, d):
    t = Tables(spark, d)
    r = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("request_id"), _map(flag=F.col("l_returnflag"), line=F.col("l_linenumber").cast("string"), part=(F.col("l_partkey") % 50).cast("string")).alias("params"))
    done = t.part.where("p_size > 25").select(F.when(F.col("p_partkey") % 2 == 0, _map(flag=F.lit("A"), part=(F.col("p_partkey") % 50).cast("string"))).otherwise(_map(line=(F.col("p_size") % 8).cast("string"), part=(F.col("p_partkey") % 50).cast("string"))).alias("params"))
    return op.pending_requests(r, done).select("request_id")


QUERIES = {"d15_build_snapshots": d15, "d15_snapshot_tree": d15_tree, "d16_evidence_id": d16, "d17_diff_snapshots": d17, "d17_diff_counts": d17_counts, "d18_revision_impact": d18, "d19_revision_queue": d19, "d20_compare_snapshot": d20, "d21_rank_records": d21, "d21_record_order": d21_order,
           "d22_table_structure": d22, "d23_coordinate_axes": d23, "d24_recommend_coords": d24, "d24_rows_at": d24_rows, "d25_evidence_draft": d25, "d26_complete_claims": d26, "d27_freeze_completions": d27, "d28_evaluate_formulas": d28,
           "d29_expand_coords": d29, "d30_pending_requests": d30}

_S = with_clause("snapshot_before", "snapshot_after", "ship_mappings")
_DIFF = _S + """, df AS (SELECT coalesce(a.period, b.period) AS period, coalesce(a.flag, b.flag) AS flag, coalesce(a.status, b.status) AS status, CASE WHEN b.period IS NULL THEN 'added' WHEN a.period IS NULL THEN 'removed'
  WHEN a.value <> b.value OR a.last_changed <> b.last_changed THEN 'changed' END AS change_type, coalesce(b.value, '') AS value_before, coalesce(a.value, '') AS value_after FROM snapshot_before b FULL JOIN snapshot_after a ON a.period = b.period AND a.flag = b.flag AND a.status = b.status)"""
_IMP = _DIFF + """, imp AS (SELECT mapping_id, df.* FROM ship_mappings m JOIN df ON change_type IN ('changed', 'removed') AND (sel_flag <> '' OR sel_status <> '') AND (sel_flag = '' OR sel_flag = flag) AND (sel_status = '' OR sel_status = status))"""
_O = with_clause("claims", "official_stats")
_G20 = _O + """, g AS (SELECT claim_id, CASE WHEN k = 9 THEN 'no_quantity' WHEN claim_id % 17 = 0 THEN 'no_snapshot' WHEN k = 7 AND NOT EXISTS (SELECT 1 FROM official_stats WHERE tbl_id = 'DT_ORD_Y' AND prd_de = CAST(y + 2 AS STRING)) THEN 'period' WHEN claim_id % 13 = 0 THEN 'indicator'
    WHEN claim_id % 11 = 0 THEN 'selection' WHEN k IN (5, 6) THEN 'value_kind' WHEN k IN (8, 10) THEN 'unit' END AS gate, CASE WHEN k IN (0, 4, 11) THEN 'match' WHEN k = 7 THEN CASE WHEN n = (SELECT CAST(replace(dt, ',', '') AS BIGINT) FROM official_stats o
    WHERE tbl_id = 'DT_ORD_Y' AND c2_nm = '계' AND prd_de = CAST(y + 2 AS STRING) AND c1_nm = CASE WHEN c1 = '전국' THEN c1 ELSE '국가 : ' || c1 END) THEN 'match' ELSE 'mismatch' END ELSE 'mismatch' END AS st FROM claims)"""
_AX = _O + """, ax AS (SELECT tbl_id, '국가' AS label, c1_nm AS value FROM official_stats UNION SELECT tbl_id, c2_obj_nm, c2_nm FROM official_stats WHERE c2_nm <> '' UNION SELECT tbl_id, '항목', itm_nm FROM official_stats
  UNION SELECT tbl_id, '시점', prd_de FROM official_stats UNION SELECT tbl_id, '단위', unit_nm FROM official_stats WHERE unit_nm <> '')"""
_C24 = "CASE WHEN c1 = '전국' THEN c1 ELSE '국가 : ' || c1 END"
# The hash tree from the definition: every level from the entries, children hashed where a node holds more than a leaf.
_TREE_DEPTH = 6
_TREE = _O + """, e AS (SELECT org_id, tbl_id, h, h || '*' || count(*) AS x, count(*) AS c FROM (SELECT org_id, tbl_id,
    sha256(concat_ws('|', prd_de, itm_nm, concat(c1_obj_nm, '=', c1_nm, CASE WHEN c2_nm = '' THEN '' ELSE concat(';', c2_obj_nm, '=', c2_nm) END), dt, unit_nm, lst_chn_de)) AS h FROM official_stats) GROUP BY org_id, tbl_id, h)""" + "".join(
    f""", t{k} AS (SELECT org_id, tbl_id, a.node, n, CASE WHEN m <= {op.LEAF} THEN a.s ELSE b.s END AS d FROM (SELECT org_id, tbl_id, substr(h, 1, {k}) AS node, sum(c)::BIGINT AS n, count(*) AS m, sha256(string_agg(x, ';' ORDER BY x)) AS s FROM e GROUP BY ALL) a
    LEFT JOIN """ + (f"(SELECT org_id, tbl_id, substr(node, 1, {k}) AS node, sha256(string_agg(substr(node, {k + 1}, 1) || d, ';' ORDER BY node)) AS s FROM t{k + 1} GROUP BY ALL)" if k < _TREE_DEPTH else
                     "(SELECT NULL AS s, '' AS org_id, '' AS tbl_id, '' AS node)") + " b USING (org_id, tbl_id, node))" for k in range(_TREE_DEPTH, -1, -1))
ORACLE = {
    "d15_snapshot_tree": _TREE + " SELECT org_id, tbl_id, n AS n_records, 'snap-' || substr(d, 1, 16) AS snapshot_id, d AS content_hash FROM t0",
    "d15_build_snapshots": _O + """, l AS (SELECT org_id, tbl_id, sha256(concat_ws('|', prd_de, itm_nm, concat(c1_obj_nm, '=', c1_nm, CASE WHEN c2_nm = '' THEN '' ELSE concat(';', c2_obj_nm, '=', c2_nm) END), dt, unit_nm, lst_chn_de)) AS h FROM official_stats),
      p AS (SELECT org_id, tbl_id, substr(h, 1, 3) AS p, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM l GROUP BY ALL),
      c AS (SELECT org_id, tbl_id, sum(n)::BIGINT AS n_records, sha256(string_agg(d, '' ORDER BY p)) AS content_hash FROM p GROUP BY ALL)
      SELECT org_id, tbl_id, n_records, 'snap-' || substr(content_hash, 1, 16) AS snapshot_id, content_hash FROM c""",
    "d16_evidence_id": _S + " SELECT DISTINCT flag, status, 'DT_SHIP:' || substr(sha256('DT_SHIP|출하 수량|flag=' || flag || ';status=' || status), 1, 16) AS evidence_id, TRUE AS stable, TRUE AS as_defined FROM snapshot_before",
    "d17_diff_snapshots": _DIFF + " SELECT period, concat('flag=', flag, ';status=', status) AS sel, change_type, value_before, value_after FROM df WHERE change_type IS NOT NULL",
    "d17_diff_counts": _DIFF + " SELECT change_type, count(*) AS n FROM df WHERE change_type IS NOT NULL GROUP BY 1",
    "d18_revision_impact": _IMP + " SELECT mapping_id, count(*) AS n, min(period) AS first_period FROM imp GROUP BY 1",
    "d19_revision_queue": _IMP + ", q AS (SELECT DISTINCT mapping_id, period FROM imp) SELECT CASE WHEN substr(period, 6, 2) = '01' THEN 'approved' ELSE 'pending' END AS status, count(*) AS n FROM q GROUP BY 1",
    "d20_compare_snapshot": _G20 + """ SELECT claim_id, CASE WHEN gate IS NOT NULL THEN 'not_comparable' ELSE st END AS status, coalesce(gate, 'compared') AS gate,
      CASE gate WHEN 'no_quantity' THEN '' WHEN 'no_snapshot' THEN '' WHEN 'period' THEN '' WHEN 'indicator' THEN 'period' WHEN 'selection' THEN 'period,indicator' WHEN 'value_kind' THEN 'period,indicator,selection'
        WHEN 'unit' THEN 'period,indicator,selection,value_kind' ELSE 'period,indicator,selection,value_kind,unit' END AS gates_passed FROM g""",
    "d21_rank_records": _S + """, c AS (SELECT DISTINCT period, flag FROM snapshot_before) SELECT concat(c.period, c.flag) AS claim_id, count(*) AS n, count(*) FILTER (s.period = c.period AND s.flag = c.flag AND s.status = 'F' AND c.flag <> 'A') AS primaries,
      max((s.period = c.period)::INT + 1 + (s.flag = c.flag AND s.status = 'F')::INT + 1) AS best, arg_min(s.value, (s.period <> c.period, NOT (s.flag = c.flag AND s.status = 'F'), s.period, s.flag, s.status)) AS top_value FROM c, snapshot_before s GROUP BY 1""",
    "d21_record_order": _S + """, c AS (SELECT period AS p, flag AS f, max(value) AS v FROM snapshot_before GROUP BY 1, 2),
      r AS (SELECT concat(p, f) AS claim_id, s.period, s.flag, s.status, s.value, CAST(2 + (s.period = p)::INT + (s.flag = f)::INT AS INT) AS match_score, s.period = p AS gp, s.flag = f AS gs,
        f <> 'R' AND s.period = p AND s.flag = f AND s.value = v AS used FROM c, snapshot_before s),
      m AS (SELECT *, row_number() OVER (PARTITION BY claim_id, used ORDER BY status) = 1 AND used AS is_primary FROM r)
      SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY is_primary DESC, gp DESC, gs DESC, period, flag, status, value) AS INT) AS position, is_primary, period, flag, status AS record_status, value, match_score FROM m""",
    "d22_table_structure": _O + """ SELECT tbl_id, CASE WHEN tbl_id = 'DT_ORD_Y' THEN 2 ELSE 1 END AS varying, CASE tbl_id WHEN 'DT_ORD_Y' THEN 'crosstab' WHEN 'DT_RATE_Y' THEN 'indicator_bundle' ELSE 'time_series' END AS structure FROM official_stats GROUP BY tbl_id""",
    "d23_coordinate_axes": _AX + " SELECT tbl_id, label, count(*) AS n, min(value) AS lo, max(value) AS hi FROM ax GROUP BY 1, 2",
    "d24_recommend_coords": _AX + f""", cc AS (SELECT claim_id, {_C24} AS subj, y || '0' || (claim_id % 8 + 1) AS p FROM claims)
      SELECT claim_id, label, value FROM cc JOIN ax ON claim_id % 5 <> 0 AND tbl_id = 'DT_ORD_M' AND CASE label WHEN '시점' THEN value = p WHEN '단위' THEN value = '건' WHEN '항목' THEN contains(value, '발주량') ELSE value = subj END
      UNION ALL SELECT claim_id, label, value FROM cc JOIN ax ON claim_id % 5 = 0 AND tbl_id = 'DT_RATE_Y' AND CASE label WHEN '항목' THEN value = '전년비(%)' WHEN '국가' THEN value = subj ELSE FALSE END""",
    "d24_rows_at": _O + f""", cc AS (SELECT claim_id, {_C24} AS subj, y || '0' || (claim_id % 8 + 1) AS p FROM claims)
      SELECT claim_id, prd_de, dt FROM cc JOIN official_stats ON c1_nm = subj AND prd_de = p WHERE claim_id % 5 <> 0 AND tbl_id = 'DT_ORD_M'
      UNION ALL SELECT claim_id, prd_de, dt FROM cc JOIN official_stats ON c1_nm = subj WHERE claim_id % 5 = 0 AND tbl_id = 'DT_RATE_Y' AND itm_nm = '전년비(%)'""",
    "d25_evidence_draft": _O + """, f AS (SELECT * FROM official_stats QUALIFY row_number() OVER (PARTITION BY tbl_id ORDER BY concat_ws('|', prd_de, c1_nm, c2_nm, itm_nm)) = 1)
      SELECT tbl_id, tbl_nm AS title, itm_nm AS indicator, CASE WHEN c2_obj_nm = '' THEN c1_obj_nm ELSE concat(c1_obj_nm, ', ', c2_obj_nm) END AS dimensions, unit_nm AS unit, CASE org_id WHEN '101' THEN '국가데이터처' ELSE '한국은행' END AS organization, CASE length(prd_de) WHEN 6 THEN '월' ELSE '연' END AS time_dimension,
        CASE WHEN c2_nm = '' THEN concat(c1_obj_nm, '=', c1_nm) ELSE concat(c1_obj_nm, '=', c1_nm, ';', c2_obj_nm, '=', c2_nm) END AS source_selection, CAST(CASE WHEN c2_nm = '' THEN 1 ELSE 2 END AS BIGINT) AS parsed FROM f""",
    "d26_complete_claims": _G20 + " SELECT CASE WHEN gate IS NOT NULL THEN 'hold' ELSE st END AS verdict, coalesce(gate, 'compared') AS gate, claim_id % 17 <> 0 AS has_snapshot, count(*) AS n FROM g GROUP BY 1, 2, 3",
    "d27_freeze_completions": """WITH z AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 5 THEN 'sentence_required' WHEN o_orderkey % 7 = 1 THEN 'evidence_required' WHEN o_orderkey % 11 = 2 THEN 'snapshot_required' WHEN o_orderkey % 5 = 3 THEN 'comparison_snapshot_differs'
      WHEN o_orderkey % 9 = 4 THEN 'snapshot_table_differs' END AS error FROM orders) SELECT error, CASE WHEN error IS NULL THEN CASE k % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'hold' ELSE 'mismatch' END END AS verdict, count(*) AS n FROM z GROUP BY 1, 2""",
    "d28_evaluate_formulas": f"""WITH c AS (SELECT {MODES!r}[l_partkey % 8 + 1] AS mode, l_quantity AS a, CAST(l_linenumber - 3 AS DOUBLE) AS b, CASE WHEN l_suppkey % 5 > 0 THEN [l_quantity, CAST(l_linenumber AS DOUBLE), -1.0::DOUBLE] END AS s FROM lineitem),
      e AS (SELECT *, CASE mode WHEN 'historical_maximum' THEN list_max(s) WHEN 'historical_minimum' THEN list_min(s) END AS x FROM c),
      o AS (SELECT *, coalesce(abs(a - x) > 2, FALSE) AS beat, CASE mode WHEN 'direct' THEN a WHEN 'change_rate' THEN CASE WHEN b <> 0 THEN (a / b - 1) * 100 END WHEN 'difference' THEN a - b WHEN 'ratio' THEN CASE WHEN b <> 0 THEN a / b END
        WHEN 'count_lt_zero' THEN CASE WHEN s IS NOT NULL THEN 1.0::DOUBLE END WHEN 'nonsense' THEN NULL ELSE CASE WHEN s IS NOT NULL THEN CASE WHEN abs(a - x) > 2 THEN x ELSE a END END END AS v FROM e)
      SELECT mode, CASE WHEN v IS NULL THEN 'not_comparable' WHEN beat THEN 'mismatch' WHEN abs(5 - v) <= 2 THEN 'match' ELSE 'mismatch' END AS status, count(*) AS n, round(sum(v), 4) AS total FROM o GROUP BY 1, 2""",
    "d29_expand_coords": """WITH c AS (SELECT p_partkey AS k, p_size AS s, unnest(CASE WHEN p_partkey % 3 = 0 THEN [0, 1] ELSE [2] END) AS comp FROM part)
      SELECT k AS plan_id, CAST(CASE WHEN comp = 1 THEN 1 ELSE 0 END AS BIGINT) AS component, concat(CASE WHEN k % 2 = 0 THEN 'itm_id=I' || k || ';' ELSE '' END, CASE comp WHEN 1 THEN 'obj_l1=over;obj_l3=b' WHEN 0 THEN 'obj_l1=' || s || ';obj_l2=a' ELSE 'obj_l1=' || s END) AS request FROM c""",
    "d30_pending_requests": """SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING)) AS request_id FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p_size > 25 AND p_partkey % 2 = 0 AND l_returnflag = 'A' AND p_partkey % 50 = l_partkey % 50)
      AND NOT EXISTS (SELECT 1 FROM part p WHERE p_size > 25 AND p_partkey % 2 = 1 AND p_size % 8 = l_linenumber AND p_partkey % 50 = l_partkey % 50)""",
}
