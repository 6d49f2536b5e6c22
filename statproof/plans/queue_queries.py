"""Registered queries E01-E15 with their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from statproof.operators import queue as op
from statproof.plans import oracle_parts as o
from statproof.plans.fixtures import Tables, with_clause

NOW = "1999-06-01 00:00:00"


def _now():
    return F.to_timestamp(F.lit(NOW))


def _claims(t):
    return op.triage(t.queue_claims).withColumn("tier", F.when(F.col("reviewed"), "CONFIRMED").otherwise(F.col("tier")))


def e01(spark, d):
    t = Tables(spark, d)
    ids = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("article_id"))
    return op.pending_claims(t.queue_claims, t.queue_articles, _now(), article_ids=ids, limit=200).select("claim_id", "article_id", "article_date")


def e01_count(spark, d):
    return op.pending_count(Tables(spark, d).queue_claims)


def e03_retry(spark, d):
    t = Tables(spark, d)
    return op.retry_failed(t.queue_claims).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("retry_count").cast("long").alias("retries"), F.count("retry_at").alias("waiting"))


def e02(spark, d):
    return op.triage_stats(Tables(spark, d).queue_claims)


def e03(spark, d):
    t = Tables(spark, d)
    f = t.events.select((F.col("event_id") * 3).alias("claim_id"), F.col("event_type").alias("error"), (F.col("event_type") != "error").alias("retryable"))
    return op.apply_failures(t.queue_claims, f, _now())


def e04(spark, d):
    t = Tables(spark, d)
    c = _claims(t).join(t.order_sentences.select("claim_id", "sentence"), "claim_id")
    return op.reclassify(c).groupBy("route", "status", "changed", "skipped_reviewed").agg(
        F.count(F.lit(1)).alias("n"), F.count("previous_result").alias("kept_previous"), F.count("label").alias("with_label"))


def e05(spark, d):
    return op.requeue(_claims(Tables(spark, d))).groupBy("outcome", "status").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("labels"))


def e06(spark, d):
    t = Tables(spark, d)
    return op.apply_reviews(_claims(t), t.reviews).groupBy("tier", "status").agg(F.count(F.lit(1)).alias("n"))


def e06_distinct(spark, d):
    return op.distinct_reviews(Tables(spark, d).reviews).select("review_id", "claim_id", "action")


def e07(spark, d):
    q = op.review_queue(_claims(Tables(spark, d)))
    return q.select("claim_id", "label", "confidence")


def e08(spark, d):
    t = Tables(spark, d)
    c = t.queue_claims.join(t.order_sentences.select("claim_id", "sentence"), "claim_id")
    return op.list_results(c, t.queue_articles, status="DONE", search="취업자", limit=50, offset=20).select("claim_id", "article_date", "title")


def e09(spark, d):
    return op.summary(_claims(Tables(spark, d)))


def e10(spark, d):
    t = Tables(spark, d)
    c = t.orders.select(F.col("o_orderkey").alias("claim_id"), F.concat(F.lit("조사는 "), F.when(F.col("o_orderkey") % 3 == 0, F.lit("곧")).otherwise(
        F.concat(F.month("o_orderdate"), F.lit("월 "), F.day("o_orderdate"), F.lit("일"))), F.lit(" 시작한다")).alias("sentence"))
    n = t.orders.select(F.col("o_orderkey").alias("claim_id"), F.when(F.col("o_custkey") % 4 == 0, F.date_add("o_orderdate", 1)).otherwise(F.to_date("o_orderdate")).alias("effective_date"))
    return op.check_notices(c, n).groupBy("label", "reason").agg(F.count(F.lit(1)).alias("n"))


def e11(spark, d):
    return op.validate_transitions(Tables(spark, d).state_log).select("event_id", "from_state", "state", "check")


def e12(spark, d):
    t = Tables(spark, d)
    return op.append_immutable(t.payload_a, t.payload_b, "k").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


def e13(spark, d):
    t = Tables(spark, d)
    return op.upsert(t.payload_a, t.payload_b, "k").select("k", "payload")


def e13_latest(spark, d):
    return op.latest(Tables(spark, d).orders, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


def e14(spark, d):
    return op.rate_audit(Tables(spark, d).call_log, 1).select("api_key", "ts", "in_window", "wait_seconds")


def e15(spark, d):
    return op.budget_ledger(Tables(spark, d).call_log, 300).select("call_id", "used", "remaining", "warn", "over_limit", "first_overrun")


QUERIES = {"e01_pending_claims": e01, "e01_pending_count": e01_count, "e03_retry_failed": e03_retry, "e02_triage": e02, "e03_apply_failures": e03, "e04_reclassify": e04, "e05_requeue": e05, "e06_apply_reviews": e06,
           "e06_distinct_reviews": e06_distinct, "e07_review_queue": e07, "e08_list_results": e08, "e09_summary": e09, "e10_check_notices": e10,
           "e11_validate_transitions": e11, "e12_append_immutable": e12, "e13_upsert": e13, "e13_latest": e13_latest, "e14_rate_audit": e14, "e15_budget_ledger": e15}

_TIER = """CASE label WHEN 'not_claim' THEN 'SKIPPED' WHEN 'unverifiable' THEN 'UNVERIFIABLE' WHEN 'mismatch' THEN 'NEEDS_REVIEW'
  ELSE CASE WHEN confidence = 'high' AND calculation = '' AND source_type <> 'KOSIS_BUT_COMPLEX' THEN 'AUTO_CONFIRMED' ELSE 'NEEDS_REVIEW' END END"""
_Q = with_clause("queue_claims", "queue_articles", "order_sentences", "reviews") + f", tc AS (SELECT *, CASE WHEN reviewed THEN 'CONFIRMED' ELSE {_TIER} END AS tier FROM queue_claims)"
_TS = f"TIMESTAMP '{NOW}'"
ORACLE = {
    "e01_pending_claims": _Q + f""" SELECT claim_id, article_id, article_date FROM queue_claims JOIN queue_articles USING (article_id) WHERE status = 'PENDING' AND route = 'KOSIS_RETRIEVAL'
      AND (retry_at IS NULL OR retry_at <= {_TS}) AND article_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY created_at, claim_id LIMIT 200""",
    "e02_triage": _Q + f""", z AS (SELECT label, {_TIER} AS tier FROM queue_claims) SELECT 'tier' AS dimension, tier AS value, count(*) AS n FROM z GROUP BY tier UNION ALL SELECT 'label', label, count(*) FROM z GROUP BY label""",
    "e01_pending_count": _Q + " SELECT count(*) AS n FROM queue_claims WHERE status = 'PENDING' AND route = 'KOSIS_RETRIEVAL'",
    "e03_retry_failed": _Q + """ SELECT CASE WHEN status = 'FAILED' THEN 'PENDING' ELSE status END AS status, count(*) AS n, CAST(sum(CASE WHEN status = 'FAILED' THEN 0 ELSE retry_count END) AS BIGINT) AS retries,
      count(CASE WHEN status <> 'FAILED' THEN retry_at END) AS waiting FROM queue_claims GROUP BY 1""",
    "e03_apply_failures": _Q + f""", f AS (SELECT event_id * 3 AS claim_id, event_type <> 'error' AS retryable FROM events)
      SELECT claim_id, CASE WHEN f.claim_id IS NULL THEN status WHEN retryable AND retry_count < 2 THEN 'PENDING' ELSE 'FAILED' END AS status,
        CASE WHEN retryable THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN f.claim_id IS NULL THEN retry_at WHEN retryable AND retry_count < 2 THEN {_TS} + INTERVAL 2 MINUTE END AS retry_at,
        CASE WHEN retryable THEN 'CONNECTION' ELSE '' END AS failure_kind FROM queue_claims c LEFT JOIN f USING (claim_id)""",
    "e04_reclassify": _Q + ", cs AS (SELECT tc.*, sentence FROM tc JOIN order_sentences USING (claim_id)), ct AS (SELECT claim_id, sentence FROM cs), " + o.source_cte("ct", "ns") + """,
      j AS (SELECT cs.*, ns.route AS nr, CASE WHEN ns.route = 'KOSIS_RETRIEVAL' THEN 'PENDING' ELSE 'CLASSIFIED' END AS nst, tier IN ('CONFIRMED', 'CORRECTED') AS hum FROM cs JOIN ns USING (claim_id)),
      k AS (SELECT *, NOT hum AND (route <> nr OR status <> nst) AS ch FROM j)
      SELECT CASE WHEN hum THEN route ELSE nr END AS route, CASE WHEN hum THEN status ELSE nst END AS status, ch AS changed, hum AS skipped_reviewed, count(*) AS n, count(*) FILTER (ch) AS kept_previous,
        count(*) FILTER (NOT ch) AS with_label FROM k GROUP BY 1, 2, 3, 4""",
    "e05_requeue": _Q + """, z AS (SELECT *, CASE WHEN label = 'unverifiable' AND tier NOT IN ('CONFIRMED', 'CORRECTED') THEN 'requeued' WHEN label = 'unverifiable' THEN 'skipped_reviewed' ELSE 'untouched' END AS outcome FROM tc)
      SELECT outcome, CASE WHEN outcome = 'requeued' THEN 'PENDING' ELSE status END AS status, count(*) AS n, count(*) FILTER (outcome <> 'requeued') AS labels FROM z GROUP BY 1, 2""",
    "e06_apply_reviews": _Q + """, la AS (SELECT claim_id, arg_max(action, (ts, review_id)) AS a FROM reviews GROUP BY 1)
      SELECT CASE a WHEN 'approve' THEN 'CONFIRMED' WHEN 'correct' THEN 'CORRECTED' WHEN 'reject' THEN NULL ELSE tier END AS tier, CASE WHEN a = 'reject' THEN 'PENDING' ELSE status END AS status, count(*) AS n
      FROM tc LEFT JOIN la USING (claim_id) GROUP BY 1, 2""",
    "e06_distinct_reviews": _Q + """, z AS (SELECT *, lag(action) OVER (PARTITION BY claim_id ORDER BY ts, review_id) AS b FROM reviews) SELECT review_id, claim_id, action FROM z WHERE action IS DISTINCT FROM b""",
    "e07_review_queue": _Q + " SELECT claim_id, label, confidence FROM tc WHERE tier = 'NEEDS_REVIEW'",
    "e08_list_results": _Q + """ SELECT claim_id, article_date, title FROM queue_claims JOIN order_sentences USING (claim_id) JOIN queue_articles USING (article_id) WHERE status = 'DONE' AND contains(sentence, '취업자')
      ORDER BY article_date DESC, title, created_at, claim_id LIMIT 50 OFFSET 20""",
    "e09_summary": _Q + """ SELECT 'status' AS dimension, status AS value, count(*) AS n FROM tc GROUP BY status UNION ALL SELECT 'label', label, count(*) FROM tc GROUP BY label UNION ALL SELECT 'tier', tier, count(*) FROM tc GROUP BY tier""",
    "e10_check_notices": """WITH z AS (SELECT o_orderkey % 3 = 0 OR o_custkey % 4 <> 0 AS ok FROM orders) SELECT CASE WHEN ok THEN 'match' ELSE 'mismatch' END AS label, CASE WHEN ok THEN 'date_match' ELSE 'date_mismatch' END AS reason, count(*) AS n FROM z GROUP BY ok""",
    "e11_validate_transitions": with_clause("state_log") + """, z AS (SELECT *, lag(state) OVER (PARTITION BY claim_id ORDER BY ts, event_id) AS f FROM state_log)
      SELECT event_id, f AS from_state, state, CASE WHEN state = 'UNVERIFIABLE' THEN CASE WHEN reason = '' THEN 'reason_required' ELSE 'ok' END WHEN f IS NULL THEN CASE WHEN state = 'DETECTED' THEN 'ok' ELSE 'illegal_start' END
        WHEN f = 'UNVERIFIABLE' THEN 'from_terminal' WHEN (f = 'DETECTED' AND state = 'PARSED') OR (f = 'VERDICTED' AND state = 'EXPLAINED') THEN 'ok' ELSE 'illegal' END AS "check" FROM z""",
    "e12_append_immutable": with_clause("payload_a", "payload_b") + """, z AS (SELECT b.k, CASE WHEN a.k IS NULL THEN 'inserted' WHEN a.payload = b.payload THEN 'ignored' ELSE 'conflict' END AS outcome FROM payload_b b LEFT JOIN payload_a a ON a.k = b.k)
      SELECT outcome, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM z GROUP BY 1""",
    "e13_upsert": with_clause("payload_a", "payload_b") + " SELECT k, payload FROM payload_b UNION ALL SELECT k, payload FROM payload_a WHERE k NOT IN (SELECT k FROM payload_b)",
    "e13_latest": "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
    "e14_rate_audit": with_clause("call_log") + """, z AS (SELECT api_key, ts, count(*) OVER w AS in_window, min(ts) OVER w AS oldest FROM call_log
        WINDOW w AS (PARTITION BY api_key ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW))
      SELECT DISTINCT api_key, ts, in_window, round(CASE WHEN in_window > 1 THEN 60.0 - (epoch_us(ts) - epoch_us(oldest)) / 1e6 ELSE 0 END, 6) AS wait_seconds FROM z""",
    "e15_budget_ledger": with_clause("call_log") + """, z AS (SELECT call_id, row_number() OVER (PARTITION BY api_key ORDER BY ts, call_id) AS used FROM call_log)
      SELECT call_id, used, greatest(300 - used, 0) AS remaining, used >= 240 AS warn, used > 300 AS over_limit, used = 301 AS first_overrun FROM z""",
}
