"""Registered queries G01-G14 with their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from statproof.operators import lab as op
from statproof.plans.fixtures import Tables, with_clause


def _rows(t):
    return t.detector_rows


def g01(spark, d):
    r = _rows(Tables(spark, d))
    return op.mode_counts(op.run_modes(r.select("doc_id", "rule_candidate"), r.where("judge_status <> 'not_called'"), "doc_id"))


def g02(spark, d):
    return op.compare_modes(_rows(Tables(spark, d))).groupBy("run_id", "disagreement").agg(F.count(F.lit(1)).alias("n"))


def g03(spark, d):
    return op.reviewed_metrics(_rows(Tables(spark, d)))


def _runs(t):
    """One run per customer; its rows are the orders."""
    return t.orders.groupBy(F.col("o_custkey").alias("run_id")).agg(F.min("o_orderdate").alias("created_at"), F.count(F.lit(1)).alias("sentence_count"), F.max("o_orderpriority").alias("model"))


def g04(spark, d):
    return op.list_runs(_runs(Tables(spark, d)), date_from="1995-01-05", page=2, page_size=15, model="5-LOW").select("run_id", "total", "pages")


def g05(spark, d):
    f = op.facets(_runs(Tables(spark, d)).withColumn("created_at", F.to_date("created_at")), ["model", "sentence_count"])
    return f


def g06(spark, d):
    t = Tables(spark, d)
    runs = t.customer.select(F.concat(F.lit("run"), F.col("c_custkey")).alias("run_id"))
    return op.history_summary(runs, _rows(t))


def g07(spark, d):
    t = Tables(spark, d)
    r = op.compare_modes(_rows(t)).withColumn("disagreement", F.when(F.col("doc_id") % 31 == 3, "ODD").when(F.col("doc_id") % 29 == 4, "P_PLUS_H_PLUS").otherwise(F.col("disagreement")))
    r = r.withColumn("judge_candidate", F.when(F.col("doc_id") % 37 == 5, F.lit(None)).when(F.col("doc_id") % 40 == 9, F.lit(True)).otherwise(F.col("judge_candidate")))
    runs = _rows(t).groupBy("run_id").agg((F.count(F.lit(1)) + F.when(F.col("run_id") == "run3", 1).otherwise(0)).alias("sentence_count"))
    return op.validate_runs(runs, r)


def g08(spark, d):
    t = Tables(spark, d)
    e = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "unclear").otherwise("true_candidate").alias("label"))
    return op.update_reviews(_rows(t), e, "doc_id").groupBy("review_state", "review").agg(F.count(F.lit(1)).alias("n"))


def g08_promote(spark, d):
    t = Tables(spark, d)
    return op.promote(_rows(t), t.documents.where("lang = 'fr'").select(F.col("text").alias("sentence")), "doc_id").select("doc_id", "review")


def _shadow(t):
    return op.shadow_rows(_rows(t).withColumn("n_quantities", F.col("n_chars") % 4).withColumn("period", F.when(F.col("doc_id") % 6 == 0, "").otherwise("2024")))


def g09(spark, d):
    return _shadow(Tables(spark, d)).select("doc_id", F.array_join("risk_reasons", ",").alias("risks"), "review_state")


def g09_summary(spark, d):
    return op.shadow_summary(_shadow(Tables(spark, d)))


def _li(t):
    return t.lineitem.select(F.col("l_orderkey").alias("row_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


def g10(spark, d):
    """Lines that the export leaves in equal order stand as in the file of the table."""
    t = Tables(spark, d)
    li = t.lineitem.select(F.col("l_orderkey").alias("row_id"), "l_partkey", "l_returnflag", (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("o"),
                           F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"), "o_orderstatus")
    order = ["o", "file", "row"]
    x = op.shadow_export(rows, {"mappings": (li.where("l_returnflag <> 'N'"), "l_partkey", order), "comparisons": (li.where("l_returnflag = 'N'"), "l_returnflag", order)}, ["row_id"])
    return x


def g11(spark, d):
    t = Tables(spark, d)
    v = t.documents.select(F.concat(F.lit(" "), "text", F.lit(" ")).alias("sentence"), F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("v"), "doc_id")).otherwise("x").alias("verdict"), F.col("doc_id").alias("seq"))
    return op.attach_verdicts(_rows(t).select("doc_id", "sentence"), v.where("lang <> 'de'")).select("doc_id", "verdict")


def g12(spark, d):
    t = Tables(spark, d)
    r = _rows(t).withColumn("judge_status", F.when(F.col("run_id") == "run2", "success").when(F.col("run_id") == "run4", "not_configured").otherwise(F.col("judge_status")))
    m = _rows(t).select("run_id", F.col("source").alias("evidence_id"))
    c = _rows(t).select("run_id", F.when(F.col("doc_id") % 3 == 0, "match").when(F.col("doc_id") % 3 == 1, "mismatch").otherwise("hold").alias("verdict"), F.concat("lang", F.lit(" | "), "source", F.lit(" | ")).alias("snapshot_ids"))
    return op.run_summary(r, m, c)


def _registry(t):
    ev = t.part.select(F.concat(F.lit("e"), "p_partkey").alias("evidence_id"), F.col("p_partkey").cast("string").alias("tbl_id"))
    snaps = t.lineitem.where("l_discount > 0.05 AND l_partkey % 5 > 0").select(F.col("l_partkey").cast("string").alias("tbl_id"))
    maps = t.lineitem.where("l_partkey % 4 > 0").select(F.concat(F.lit("e"), "l_partkey").alias("evidence_id"))
    rev = t.lineitem.where("l_partkey % 3 = 0").select(F.col("l_partkey").cast("string").alias("tbl_id"), F.when(F.col("l_returnflag") == "A", "pending").otherwise("approved").alias("status"))
    return op.evidence_registry(ev, snaps, maps, rev)


def g13(spark, d):
    return _registry(Tables(spark, d)).select("evidence_id", "snapshot_count", "mapping_count", "pending_review_count")


def g14(spark, d):
    return op.case_status(_registry(Tables(spark, d))).groupBy("completed_steps", "next_action").agg(F.count(F.lit(1)).alias("n"))


def g14_guide(spark, d):
    t = Tables(spark, d)
    li = _li(t)
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"))
    cmp = li.where("l_suppkey % 2 = 0").select("row_id", F.when(F.col("l_returnflag") == "A", "match").otherwise("not_comparable").alias("status"))
    g = op.row_guide(rows, li.where("row_id % 4 > 0"), cmp, li.where("l_linenumber = 7").select("row_id"), ["row_id"])
    return g.groupBy("find_candidate", "compare_value", "review_export", "completed", "next_step").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"g01_run_modes": g01, "g02_compare_modes": g02, "g03_reviewed_metrics": g03, "g04_list_runs": g04, "g05_facets": g05, "g06_history_summary": g06, "g07_validate_runs": g07, "g08_update_reviews": g08, "g08_promote": g08_promote,
           "g09_shadow_rows": g09, "g09_shadow_summary": g09_summary, "g10_shadow_export": g10, "g11_attach_verdicts": g11, "g12_run_summary": g12, "g13_evidence_registry": g13, "g14_case_status": g14, "g14_row_guide": g14_guide}

_D = with_clause("detector_rows")
_OUT = "CASE WHEN judge_status <> 'success' THEN 'JUDGE_ERROR' WHEN rule_candidate AND judge_candidate THEN 'P_PLUS_H_PLUS' WHEN rule_candidate THEN 'P_PLUS_H_MINUS' WHEN judge_candidate THEN 'P_MINUS_H_PLUS' ELSE 'P_MINUS_H_MINUS' END"
_RUNS = "WITH r AS (SELECT o_custkey AS run_id, min(o_orderdate) AS created_at, count(*) AS sentence_count, max(o_orderpriority) AS model FROM orders GROUP BY 1)"
_M3 = _D + """, k AS (SELECT *, review = 'true_candidate' AS t, judge_status = 'success' AS ok, coalesce(judge_candidate, FALSE) AS j FROM detector_rows), u AS (SELECT 'rules' AS detector, t, review IN ('true_candidate', 'false_positive') AS used, rule_candidate AS p FROM k
  UNION ALL SELECT 'judge', t, review IN ('true_candidate', 'false_positive') AND ok, j FROM k UNION ALL SELECT 'either', t, review IN ('true_candidate', 'false_positive'), rule_candidate OR (ok AND j) FROM k),
  c AS (SELECT detector, count(*) FILTER (used AND t AND p) AS tp, count(*) FILTER (used AND NOT t AND p) AS fp, count(*) FILTER (used AND t AND NOT p) AS fn, count(*) FILTER (used AND NOT t AND NOT p) AS tn FROM u GROUP BY 1)"""
_RISK = """array_to_string(list_filter([CASE WHEN judge_status <> 'success' THEN 'judge_error' END, CASE WHEN judge_status = 'success' AND rule_candidate <> judge_candidate THEN 'candidate_conflict' END, CASE WHEN rule_candidate AND n_chars % 4 = 0 THEN 'required_slot_missing' END,
  CASE WHEN rule_candidate AND doc_id % 6 = 0 THEN 'ambiguous_time_or_unit' END], lambda x: x IS NOT NULL), ',')"""
_REG = """WITH p AS (SELECT p_partkey AS k FROM part), rg AS (SELECT k, (SELECT count(*) FROM lineitem WHERE l_partkey = k AND l_discount > 0.05 AND k % 5 > 0) AS sc, (SELECT count(*) FROM lineitem WHERE l_partkey = k AND k % 4 > 0) AS mc,
  (SELECT count(*) FROM lineitem WHERE l_partkey = k AND k % 3 = 0 AND l_returnflag = 'A') AS rc FROM p)"""
ORACLE = {
    "g01_run_modes": _D + """ SELECT count(*) AS sentences, count(*) FILTER (rule_candidate) AS rules, count(*) FILTER (judge_status = 'success' AND judge_candidate) AS judge, count(*) FILTER (rule_candidate AND (judge_status <> 'success' OR judge_candidate)) AS hybrid,
      CAST(count(*) + count(*) FILTER (rule_candidate) AS BIGINT) AS judge_calls FROM detector_rows""",
    "g02_compare_modes": _D + f" SELECT run_id, {_OUT} AS disagreement, count(*) AS n FROM detector_rows GROUP BY 1, 2",
    "g03_reviewed_metrics": _M3 + """ SELECT *, (SELECT round(count(*) FILTER (ok) / count(*), 6) FROM k) AS response_rate, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
      round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1 FROM c""",
    "g04_list_runs": _RUNS + ", f AS (SELECT * FROM r WHERE created_at >= TIMESTAMP '1995-01-05' AND model = '5-LOW') SELECT run_id, (SELECT count(*) FROM f) AS total, CAST(greatest(1, ceil((SELECT count(*) FROM f) / 15)) AS BIGINT) AS pages FROM f ORDER BY created_at DESC, run_id DESC LIMIT 15 OFFSET 15",
    "g05_facets": _RUNS + " SELECT 'date_min' AS facet, CAST(min(created_at)::DATE AS STRING) AS value FROM r UNION ALL SELECT 'date_max', CAST(max(created_at)::DATE AS STRING) FROM r UNION ALL SELECT DISTINCT 'model', model FROM r UNION ALL SELECT DISTINCT 'sentence_count', CAST(sentence_count AS STRING) FROM r",
    "g06_history_summary": _D + f", z AS (SELECT {_OUT} AS o FROM detector_rows) SELECT (SELECT count(*) FROM customer) AS runs, count(*) AS sentences, " + ", ".join(f"count(*) FILTER (o = '{x}') AS {x.lower()}" for x in op.OUTCOMES) + " FROM z",
    "g07_validate_runs": _D + f""", z AS (SELECT run_id, judge_status = 'success' AS ok, doc_id, judge_status, rule_candidate, CASE WHEN doc_id % 37 = 5 THEN NULL WHEN doc_id % 40 = 9 THEN TRUE ELSE judge_candidate END AS jc,
        CASE WHEN doc_id % 31 = 3 THEN 'ODD' WHEN doc_id % 29 = 4 THEN 'P_PLUS_H_PLUS' ELSE {_OUT} END AS shown FROM detector_rows)
      SELECT run_id, 'class_mismatch' AS problem, count(*) AS n FROM z WHERE shown <> {_OUT.replace('judge_candidate', 'coalesce(jc, FALSE)')} GROUP BY 1 UNION ALL
      SELECT run_id, 'success_without_candidate' AS problem, count(*) AS n FROM z WHERE ok AND jc IS NULL GROUP BY 1 UNION ALL SELECT run_id, 'failure_with_candidate', count(*) FROM z WHERE NOT ok AND jc IS NOT NULL GROUP BY 1
      UNION ALL SELECT run_id, 'unknown_class', count(*) FROM z WHERE doc_id % 31 = 3 GROUP BY 1 UNION ALL SELECT 'run3', 'sentence_count', 1""",
    "g08_update_reviews": _D + """, j AS (SELECT d.review, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'unclear' ELSE 'true_candidate' END AS nl FROM detector_rows d LEFT JOIN labels l USING (doc_id))
      SELECT CASE WHEN nl IS NULL THEN 'untouched' WHEN nl = review THEN 'no_op' ELSE 'updated' END AS review_state, coalesce(nl, review) AS review, count(*) AS n FROM j GROUP BY 1, 2""",
    "g08_promote": _D + f""", g AS (SELECT *, {_OUT} AS o FROM detector_rows), h AS (SELECT trim(sentence) AS s, min(doc_id) AS doc_id, arg_min(review, doc_id) AS review FROM g WHERE o IN ('P_PLUS_H_MINUS', 'P_MINUS_H_PLUS') AND review IN ('true_candidate', 'false_positive') GROUP BY 1)
      SELECT doc_id, review FROM h WHERE s NOT IN (SELECT trim(text) FROM documents WHERE lang = 'fr')""",
    "g09_shadow_rows": _D + f" SELECT doc_id, {_RISK} AS risks, CASE WHEN {_RISK} <> '' THEN 'needs_review' ELSE 'auto' END AS review_state FROM detector_rows",
    "g09_shadow_summary": _D + f" SELECT run_id, count(*) AS row_count, count(*) FILTER ({_RISK} <> '') AS review_count, count(*) FILTER (judge_status = 'success') AS responses FROM detector_rows GROUP BY 1",
    "g10_shadow_export": """WITH l AS (SELECT l_orderkey AS k, l_partkey AS p, l_returnflag AS f, l_linenumber * 1000000 + l_partkey AS o FROM lineitem), m AS (SELECT k, string_agg(CAST(p AS STRING), ' | ' ORDER BY o) AS v, count(*) AS n FROM l WHERE f <> 'N' GROUP BY k),
      c AS (SELECT k, string_agg(f, ' | ' ORDER BY o) AS v, count(*) AS n FROM l WHERE f = 'N' GROUP BY k) SELECT o_orderkey AS row_id, o_orderstatus, coalesce(m.v, '') AS mappings, coalesce(m.n, 0) AS n_mappings, coalesce(c.v, '') AS comparisons, coalesce(c.n, 0) AS n_comparisons
      FROM orders LEFT JOIN m ON m.k = o_orderkey LEFT JOIN c ON c.k = o_orderkey""",
    "g11_attach_verdicts": """WITH v AS (SELECT trim(text) AS s, arg_max(CASE WHEN n_chars % 2 = 0 THEN concat('v', doc_id) ELSE 'x' END, doc_id) AS verdict FROM documents WHERE lang <> 'de' GROUP BY 1) SELECT doc_id, verdict FROM documents LEFT JOIN v ON v.s = trim(text)""",
    "g12_run_summary": _D + """ SELECT run_id, count(*) AS total, count(*) FILTER (CASE run_id WHEN 'run2' THEN TRUE WHEN 'run4' THEN FALSE ELSE judge_status = 'success' END) AS responses, CASE run_id WHEN 'run2' THEN 'complete' WHEN 'run4' THEN 'not_configured'
      ELSE CASE WHEN bool_and(judge_status = 'success') THEN 'complete' ELSE 'partial_failure' END END AS status, count(DISTINCT source) AS mapped_evidence, count(*) FILTER (doc_id % 3 = 0) AS match_count, count(*) FILTER (doc_id % 3 = 1) AS mismatch_count,
      count(DISTINCT source) + count(DISTINCT lang) AS snapshots FROM detector_rows GROUP BY run_id""",
    "g13_evidence_registry": _REG + " SELECT concat('e', k) AS evidence_id, sc AS snapshot_count, mc AS mapping_count, rc AS pending_review_count FROM rg",
    "g14_case_status": _REG + """ SELECT 1 + (sc > 0)::INT + (mc > 0)::INT + (mc > 0 AND rc = 0)::INT AS completed_steps, CASE WHEN sc = 0 THEN 'save_snapshot' WHEN mc = 0 THEN 'map_sentence' WHEN rc > 0 THEN 'decide_reviews' ELSE 'complete' END AS next_action, count(*) AS n FROM rg GROUP BY 1, 2""",
    "g14_row_guide": """WITH g AS (SELECT o_orderkey AS k, o_orderkey % 4 > 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS m, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 2 = 0 AND l_returnflag = 'A') AS dn,
        EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey % 2 = 0 AND l_returnflag <> 'A') AS nc, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 7) AS r FROM orders),
      h AS (SELECT *, CASE WHEN m THEN 'complete' ELSE 'next' END AS a, CASE WHEN NOT m THEN 'locked' WHEN dn THEN 'complete' WHEN nc THEN 'review_needed' ELSE 'next' END AS b FROM g), i AS (SELECT *, CASE WHEN r THEN 'complete' WHEN b <> 'complete' THEN 'locked' ELSE 'next' END AS c FROM h)
      SELECT a AS find_candidate, b AS compare_value, c AS review_export, 2 + (a = 'complete')::INT + (b = 'complete')::INT + (c = 'complete')::INT AS completed, CASE WHEN a = 'next' THEN 'find_candidate' WHEN b IN ('next', 'review_needed') THEN 'compare_value' WHEN c = 'next' THEN 'review_export' END AS next_step,
        count(*) AS n FROM i GROUP BY 1, 2, 3, 4, 5""",
}
