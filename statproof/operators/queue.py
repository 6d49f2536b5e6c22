"""Work queue, review and lifecycle tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from statproof.functions import text as tx, verdict as vd
from statproof.functions.scale import first_per_key, lag_by_bucket, running_sum_by_bucket

HUMAN_TIERS = ["CONFIRMED", "CORRECTED"]
RETRIEVAL = "KOSIS_RETRIEVAL"
TRANSITIONS = [("DETECTED", "PARSED"), ("PARSED", "MAPPED"), ("MAPPED", "EVIDENCED"), ("EVIDENCED", "VERDICTED"), ("VERDICTED", "EXPLAINED"),
               ("EXPLAINED", "IN_REVIEW"), ("IN_REVIEW", "CONFIRMED"), ("IN_REVIEW", "CORRECTED"), ("IN_REVIEW", "REJECTED"), ("REJECTED", "PARSED")]
TERMINAL = ["CONFIRMED", "CORRECTED", "UNVERIFIABLE"]


def pending_claims(claims: DataFrame, articles: DataFrame, now: Column, article_ids: DataFrame | None = None,
                   claim_ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    due = claims.where((F.col("status") == "PENDING") & (F.col("route") == RETRIEVAL) & (F.col("retry_at").isNull() | (F.col("retry_at") <= now)))
    if article_ids is not None:
        due = due.join(article_ids.select("article_id"), "article_id", "left_semi")
    if claim_ids is not None:
        due = due.join(claim_ids.select("claim_id"), "claim_id", "left_semi")
    out = due.join(articles.select("article_id", "article_date"), "article_id").orderBy("created_at", "claim_id")
    return out.limit(limit) if limit else out


def pending_count(claims: DataFrame) -> DataFrame:
    return claims.where((F.col("status") == "PENDING") & (F.col("route") == RETRIEVAL)).agg(F.count(F.lit(1)).alias("n"))


def triage(results: DataFrame) -> DataFrame:
    return results.withColumn("tier", vd.triage(F.col("label"), F.col("confidence"), F.col("calculation"), F.col("source_type")))


def triage_stats(results: DataFrame) -> DataFrame:
    """Counts by tier and by label from one pass."""
    g = triage(results).groupingSets([["tier"], ["label"]], "tier", "label").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.when(F.col("tier").isNotNull(), "tier").otherwise("label").alias("dimension"), F.coalesce("tier", "label").alias("value"), "n")


def apply_failures(claims: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """failures(claim_id, error, retryable): third retryable failure and every other error is final; earlier ones are
    due again in two minutes."""
    f = first_per_key(failures, ["claim_id"], ["error"]).withColumn("_f", F.lit(True))
    j = claims.join(f, "claim_id", "left")
    tries = F.col("retry_count") + 1
    hit, again = F.col("_f").isNotNull(), F.col("retryable") & (tries < 3)
    return j.select("claim_id", F.when(hit, F.when(again, "PENDING").otherwise("FAILED")).otherwise(F.col("status")).alias("status"),
                    F.when(hit & F.col("retryable"), tries).otherwise(F.col("retry_count")).alias("retry_count"),
                    F.when(hit, F.when(again, now + F.expr("INTERVAL 2 MINUTES"))).otherwise(F.col("retry_at")).alias("retry_at"),
                    F.when(hit & F.col("retryable"), "CONNECTION").otherwise("").alias("failure_kind"))


def retry_failed(claims: DataFrame) -> DataFrame:
    failed = F.col("status") == "FAILED"
    return (claims.withColumn("retry_count", F.when(failed, 0).otherwise(F.col("retry_count"))).withColumn("retry_at", F.when(~failed, F.col("retry_at")))
            .withColumn("status", F.when(failed, "PENDING").otherwise(F.col("status"))))


def reclassify(claims: DataFrame) -> DataFrame:
    """Re-route all claims without touching human decisions; a changed route or status clears the result and keeps
    the previous one."""
    human = F.coalesce(F.col("tier").isin(HUMAN_TIERS), F.lit(False))
    s = claims.withColumn("_s", F.when(~human, tx.source_label(F.col("sentence"))))
    new_status = F.when(F.col("_s.route") == RETRIEVAL, "PENDING").otherwise("CLASSIFIED")
    s = s.withColumn("_new", new_status).withColumn("changed", ~human & ((F.col("route") != F.col("_s.route")) | (F.col("status") != F.col("_new"))))
    previous = F.when(F.col("changed"), F.struct("label", "confidence", "tier", "status", "route"))
    out = s.withColumn("previous_result", previous)
    for c in ("label", "confidence", "tier"):
        out = out.withColumn(c, F.when(~F.col("changed"), F.col(c)))
    return (out.withColumn("route", F.coalesce("_s.route", "route")).withColumn("source_type", F.coalesce("_s.source_type", "source_type"))
            .withColumn("status", F.when(F.col("_s").isNull(), F.col("status")).otherwise(F.col("_new"))).withColumn("skipped_reviewed", F.col("_s").isNull()).drop("_s", "_new"))


def requeue(claims: DataFrame) -> DataFrame:
    """Unverifiable claims go back to the queue unless a human decided them."""
    target = F.col("label") == "unverifiable"
    human = F.coalesce(F.col("tier").isin(HUMAN_TIERS), F.lit(False))
    go = target & ~human
    out = claims.withColumn("outcome", F.when(go, "requeued").when(target, "skipped_reviewed").otherwise("untouched"))
    for c in ("label", "confidence", "tier"):
        out = out.withColumn(c, F.when(F.col("outcome") != "requeued", F.col(c)))
    return out.withColumn("status", F.when(F.col("outcome") == "requeued", "PENDING").otherwise(F.col("status")))


def latest_action(reviews: DataFrame) -> DataFrame:
    """Last action per claim by a mergeable aggregate: a claim with very many reviews needs no sort."""
    return reviews.groupBy("claim_id").agg(F.max_by("action", F.struct("ts", "review_id")).alias("action"))


def apply_reviews(claims: DataFrame, reviews: DataFrame) -> DataFrame:
    a = F.col("action")
    j = claims.join(latest_action(reviews), "claim_id", "left")
    return (j.withColumn("tier", F.when(a == "approve", "CONFIRMED").when(a == "correct", "CORRECTED").when(a == "reject", F.lit(None)).otherwise(F.col("tier")))
            .withColumn("status", F.when(a == "reject", "PENDING").otherwise(F.col("status"))).drop("action"))


def distinct_reviews(reviews: DataFrame) -> DataFrame:
    """Drop a review that repeats the action before it."""
    m = lag_by_bucket(reviews, ["claim_id"], F.date_trunc("day", "ts"), ["ts", "review_id"], "action", "_before")
    return m.where(~F.col("action").eqNullSafe(F.col("_before"))).drop("_before")


def review_queue(claims: DataFrame) -> DataFrame:
    urgency = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "high", 2).otherwise(3)
    return claims.where("tier = 'NEEDS_REVIEW'").orderBy(F.when(F.col("label") == "mismatch", 0).otherwise(1), urgency, "created_at", "claim_id")


def list_results(claims: DataFrame, articles: DataFrame, status=None, label=None, route=None, search="", limit=None, offset=0) -> DataFrame:
    out = claims
    for c, v in (("status", status), ("label", label), ("route", route)):
        if v:
            out = out.where(F.col(c) == v)
    if search.strip():
        out = out.where(F.col("sentence").contains(search.strip()))
    out = out.join(articles, "article_id").orderBy(F.desc("article_date"), "title", "created_at", "claim_id")
    return out if limit is None else out.offset(max(0, offset)).limit(limit)


def summary(claims: DataFrame) -> DataFrame:
    g = claims.groupingSets([["status"], ["label"], ["tier"]], "status", "label", "tier").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    dim = F.when(F.col("g") == 3, "status").when(F.col("g") == 5, "label").otherwise("tier")
    value = F.when(F.col("g") == 3, F.col("status")).when(F.col("g") == 5, F.col("label")).otherwise(F.col("tier"))
    return g.select(dim.alias("dimension"), value.alias("value"), "n").where("value IS NOT NULL")


def check_notices(claims: DataFrame, notices: DataFrame) -> DataFrame:
    """Announcement claims against the registered effective date: month/day named in the sentence must agree."""
    p = r"(\d{1,2})월\s*(\d{1,2})일"
    j = claims.join(notices, "claim_id")
    named = F.col("sentence").rlike(p)
    eff = F.col("effective_date")
    same = (F.regexp_extract("sentence", p, 1).try_cast("int") == F.month(eff)) & (F.regexp_extract("sentence", p, 2).try_cast("int") == F.day(eff))
    ok = ~named | same
    return j.withColumn("label", F.when(ok, "match").otherwise("mismatch")).withColumn("reason", F.when(ok, "date_match").otherwise("date_mismatch"))


def validate_transitions(log: DataFrame) -> DataFrame:
    """log(claim_id, event_id, ts, state, reason) -> verdict on each step against the state before it."""
    m = lag_by_bucket(log, ["claim_id"], F.date_trunc("day", "ts"), ["ts", "event_id"], "state", "from_state")
    frm, to = F.col("from_state"), F.col("state")
    allowed = F.concat_ws(">", frm, to).isin([f"{a}>{b}" for a, b in TRANSITIONS])
    return m.withColumn("check", F.when((to == "UNVERIFIABLE") & (F.col("reason") == ""), "reason_required")
                        .when(to == "UNVERIFIABLE", "ok").when(frm.isNull(), F.when(to == "DETECTED", "ok").otherwise("illegal_start"))
                        .when(frm.isin(TERMINAL), "from_terminal").when(allowed, "ok").otherwise("illegal"))


def append_immutable(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Every incoming row with its fate: inserted, ignored (equal payload) or conflict (same key, other payload)."""
    def digest(df):
        return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns) if c != key]), 256)
    old = existing.select(key, digest(existing).alias("_old"))
    j = incoming.withColumn("_new", digest(incoming)).join(old, key, "left")
    return j.withColumn("outcome", F.when(F.col("_old").isNull(), "inserted").when(F.col("_old") == F.col("_new"), "ignored").otherwise("conflict")).drop("_old", "_new")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    both = existing.withColumn("_src", F.lit(0)).unionByName(incoming.withColumn("_src", F.lit(1)))
    return first_per_key(both, [key], [F.desc("_src")]).drop("_src")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    return first_per_key(df, [key], [F.desc(order)])


def rate_audit(calls: DataFrame, per_minute: int) -> DataFrame:
    """Calls of the trailing 60 s per key and the wait the limit would have asked for.

    Calls are counted per (key, instant) first; each minute bucket then sees its own instants and those of the minute
    before it, so a window never spans more than two minutes of one key."""
    per = calls.groupBy("api_key", "ts").agg(F.count(F.lit(1)).alias("n"), F.max("call_id").alias("call_id"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    minute = F.floor(micros / 60_000_000)
    own = per.withColumn("m", minute).withColumn("ghost", F.lit(False))
    seen = own.unionByName(own.withColumn("m", F.col("m") + 1).withColumn("ghost", F.lit(True))).withColumn("us", micros)
    w = Window.partitionBy("api_key", "m").orderBy("us").rangeBetween(-59_999_999, 0)
    counted = seen.withColumn("in_window", F.sum("n").over(w)).withColumn("oldest", F.min("us").over(w)).where("NOT ghost")
    wait = F.when(F.col("in_window") > per_minute, F.lit(60.0) - (F.col("us") - F.col("oldest")) / 1e6).otherwise(0.0)
    return counted.select("api_key", "ts", "call_id", "n", "in_window", F.round(wait, 6).alias("wait_seconds"))


def budget_ledger(calls: DataFrame, limit: int, warn_at: float = 0.8) -> DataFrame:
    m = running_sum_by_bucket(calls, ["api_key"], F.date_trunc("day", "ts"), ["ts", "call_id"], F.lit(1), "used")
    return (m.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0))).withColumn("warn", F.col("used") >= limit * warn_at)
            .withColumn("over_limit", F.col("used") > limit).withColumn("first_overrun", F.col("used") == limit + 1))
