"""Two-detector comparison: rules against a judge whose recorded decisions arrive as a table.

rows: run_id, row key, sentence, rule_candidate, judge_status, judge_candidate, review (human label)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statproof.functions import text as tx

OUTCOMES = ["P_PLUS_H_PLUS", "P_PLUS_H_MINUS", "P_MINUS_H_PLUS", "P_MINUS_H_MINUS", "JUDGE_ERROR"]
REVIEWABLE = ["P_PLUS_H_MINUS", "P_MINUS_H_PLUS"]


def _rule() -> Column:
    return F.col("rule_candidate")


def _judge() -> Column:
    return F.coalesce(F.col("judge_candidate"), F.lit(False))


def _answered() -> Column:
    return F.col("judge_status") == "success"


def run_modes(sent: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """rules / judge / hybrid result per sentence; hybrid asks the judge only for rule candidates and keeps them when
    the judge fails.  A sentence without a decision counts as not configured."""
    j = sent.join(decisions.select(key, "judge_status", "judge_candidate"), key, "left").withColumn("judge_status", F.coalesce("judge_status", F.lit("not_configured")))
    judged = F.when(_answered(), F.col("judge_candidate"))
    return (j.withColumn("judge_mode", judged).withColumn("hybrid_mode", _rule() & F.coalesce(judged, F.lit(True)))
            .withColumn("judge_calls", (F.lit(1) + _rule().cast("int"))))


def mode_counts(modes: DataFrame) -> DataFrame:
    return modes.agg(F.count(F.lit(1)).alias("sentences"), F.count_if(_rule()).alias("rules"), F.count_if("judge_mode").alias("judge"), F.count_if("hybrid_mode").alias("hybrid"), F.sum("judge_calls").alias("judge_calls"))


def outcome() -> Column:
    return (F.when(~_answered(), "JUDGE_ERROR").when(_rule() & _judge(), "P_PLUS_H_PLUS").when(_rule(), "P_PLUS_H_MINUS").when(_judge(), "P_MINUS_H_PLUS").otherwise("P_MINUS_H_MINUS"))


def compare_modes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("disagreement", outcome())


def reviewed_metrics(rows: DataFrame) -> DataFrame:
    """Precision / recall / F1 of rules, judge and either on human-labelled rows; null where undefined.  Judge rows
    count on success only, `either` falls back to the rules; response coverage is over all rows."""
    known, truth = F.col("review").isin("true_candidate", "false_positive"), F.col("review") == "true_candidate"
    det = F.array(F.struct(F.lit("rules").alias("detector"), known.alias("used"), _rule().alias("pred")), F.struct(F.lit("judge").alias("detector"), (known & _answered()).alias("used"), _judge().alias("pred")),
                  F.struct(F.lit("either").alias("detector"), known.alias("used"), (_rule() | (_answered() & _judge())).alias("pred")))
    m = rows.select(truth.alias("t"), _answered().alias("ok"), F.explode(det).alias("d")).select("t", "ok", "d.*")
    a = m.groupBy("detector").agg(*[F.count_if(F.col("used") & c).alias(n) for n, c in (("tp", F.col("t") & F.col("pred")), ("fp", ~F.col("t") & F.col("pred")), ("fn", F.col("t") & ~F.col("pred")), ("tn", ~F.col("t") & ~F.col("pred")))],
                                  F.round(F.try_divide(F.count_if("ok"), F.count(F.lit(1))), 6).alias("response_rate"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(F.try_divide(2 * p * r, p + r), 6))


def run_heads(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("sentence_count"), F.min("created_at").alias("created_at"))


def list_runs(runs: DataFrame, date_from=None, date_to=None, page: int = 1, page_size: int = 20, **equals) -> DataFrame:
    """Newest-first page with the total and the page count."""
    out = runs
    if date_from is not None:
        out = out.where(F.col("created_at") >= date_from)
    if date_to is not None:
        out = out.where(F.col("created_at") < date_to)
    for c, v in equals.items():
        if v:
            out = out.where(F.col(c) == v)
    total = out.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (out.orderBy(F.desc("created_at"), F.desc("run_id")).offset((max(1, page) - 1) * page_size).limit(page_size)
            .withColumn("total", total).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / page_size))))


def facets(runs: DataFrame, columns: list) -> DataFrame:
    """(facet, value) rows: date bounds and distinct values; kept as rows because a facet can have many values."""
    bounds = runs.agg(F.min("created_at").cast("string").alias("lo"), F.max("created_at").cast("string").alias("hi"))
    edge = bounds.select(F.explode(F.array(F.struct(F.lit("date_min").alias("facet"), F.col("lo").alias("value")), F.struct(F.lit("date_max").alias("facet"), F.col("hi").alias("value")))).alias("x")).select("x.*")
    vals = runs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").distinct()
    return edge.unionByName(vals)


def history_summary(runs: DataFrame, rows: DataFrame) -> DataFrame:
    per = compare_modes(rows).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("disagreement") == o).alias(o.lower()) for o in OUTCOMES])
    j = runs.select("run_id").join(per, "run_id", "left")
    return j.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("n"), F.lit(0)).alias("sentences"), *[F.coalesce(F.sum(o.lower()), F.lit(0)).alias(o.lower()) for o in OUTCOMES])


def validate_runs(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """(run_id, problem, n): sentence count, candidate/status and class consistency."""
    expected = outcome()
    row_bad = tx.present((_answered() & F.col("judge_candidate").isNull(), "success_without_candidate"), (~_answered() & F.col("judge_candidate").isNotNull(), "failure_with_candidate"),
                         (~F.col("disagreement").isin(OUTCOMES), "unknown_class"), (F.col("disagreement") != expected, "class_mismatch"))
    bad = rows.select("run_id", F.explode(row_bad).alias("problem")).groupBy("run_id", "problem").agg(F.count(F.lit(1)).alias("n"))
    counts = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    miss = runs.join(counts, "run_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("sentence_count")).select("run_id", F.lit("sentence_count").alias("problem"), F.lit(1).cast("long").alias("n"))
    return bad.unionByName(miss)


def update_reviews(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Apply new labels; an equal label is a no-op and says so."""
    j = rows.join(edits.select(key, F.col("label").alias("_l")), key, "left")
    state = F.when(F.col("_l").isNull(), "untouched").when(F.col("review").eqNullSafe(F.col("_l")), "no_op").otherwise("updated")
    return j.withColumn("review_state", state).withColumn("review", F.coalesce("_l", "review")).drop("_l")


def promote(rows: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Reviewed disagreements, once per sentence hash, that the gold set does not hold yet."""
    good = compare_modes(rows).where(F.col("disagreement").isin(REVIEWABLE) & F.col("review").isin("true_candidate", "false_positive"))
    h = good.withColumn("sentence_hash", F.sha2(F.trim("sentence"), 256))
    known = gold.select(F.sha2(F.trim("sentence"), 256).alias("sentence_hash"))
    return h.groupBy("sentence_hash").agg(F.min_by("review", key).alias("review"), F.min(key).alias(key)).join(known, "sentence_hash", "left_anti")


def shadow_rows(rows: DataFrame) -> DataFrame:
    """Risk reasons and review state; rows carry n_quantities and period of the sentence."""
    risks = tx.present((~_answered(), "judge_error"), (_answered() & (_rule() != _judge()), "candidate_conflict"), (_rule() & (F.col("n_quantities") == 0), "required_slot_missing"), (_rule() & (F.col("period") == ""), "ambiguous_time_or_unit"))
    return rows.withColumn("risk_reasons", risks).withColumn("review_state", F.when(F.size("risk_reasons") > 0, "needs_review").otherwise("auto"))


def shadow_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("review_state") == "needs_review").alias("review_count"), F.count_if(_answered()).alias("responses"))


def shadow_export(rows: DataFrame, parts: dict, key: list) -> DataFrame:
    """One flat line per row; every detail table is joined into one ` | ` text in its own order before the join.
    parts = {name: (df, value column, order columns)}; the value itself comes last in the order."""
    out = rows
    for name, (df, value, order) in parts.items():
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.col(value).cast("string").alias("v")))), lambda x: x["v"]), " | ")
        out = out.join(df.groupBy(*key).agg(text.alias(name), F.count(F.lit(1)).alias(f"n_{name}")), key, "left")
    return out.na.fill("", list(parts)).na.fill(0, [f"n_{n}" for n in parts])


def attach_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts(sentence, verdict, seq): the last one per trimmed sentence, found before the join."""
    v = verdicts.groupBy(F.trim("sentence").alias("_s")).agg(F.max_by("verdict", "seq").alias("verdict"))
    return rows.withColumn("_s", F.trim("sentence")).join(v, "_s", "left").drop("_s")


def run_summary(rows: DataFrame, mappings: DataFrame, completions: DataFrame) -> DataFrame:
    """Execution status and semantic counts per run; snapshot ids arrive as ` | ` joined text."""
    st = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(_answered()).alias("ok"), F.count_if(F.col("judge_status") == "not_configured").alias("off"))
    status = F.when(F.col("ok") == F.col("total"), "complete").when(F.col("off") == F.col("total"), "not_configured").otherwise("partial_failure")
    m = mappings.groupBy("run_id").agg(F.countDistinct("evidence_id").alias("mapped_evidence"))
    c = completions.groupBy("run_id").agg(*[F.count_if(F.col("verdict") == v).alias(f"{v}_count") for v in ("match", "mismatch")])
    s = (completions.select("run_id", F.explode(F.split("snapshot_ids", r"\|")).alias("s")).select("run_id", F.trim("s").alias("s")).where("s <> ''")
         .groupBy("run_id").agg(F.countDistinct("s").alias("snapshots")))
    out = st.select("run_id", "total", F.col("ok").alias("responses"), status.alias("status"))
    for d in (m, c, s):
        out = out.join(d, "run_id", "left")
    return out.na.fill(0)


def evidence_registry(ev: DataFrame, snaps: DataFrame, maps: DataFrame, reviews: DataFrame) -> DataFrame:
    """Evidence with snapshot and mapping counts and open revision reviews."""
    def n(df, key, name):
        return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return (ev.join(n(snaps, "tbl_id", "snapshot_count"), "tbl_id", "left").join(n(maps, "evidence_id", "mapping_count"), "evidence_id", "left")
            .join(n(reviews.where("status = 'pending'"), "tbl_id", "pending_review_count"), "tbl_id", "left").na.fill(0, ["snapshot_count", "mapping_count", "pending_review_count"]))


def case_status(registry: DataFrame) -> DataFrame:
    c = F.col
    saved, snap = F.coalesce(c("tbl_id"), F.lit("")) != "", c("snapshot_count") > 0
    mapped = c("mapping_count") > 0
    checked = mapped & (c("pending_review_count") == 0)
    action = F.when(~snap, "save_snapshot").when(~mapped, "map_sentence").when(c("pending_review_count") > 0, "decide_reviews").otherwise("complete")
    return registry.withColumn("completed_steps", sum((x.cast("int") for x in (saved, snap, mapped, checked)), F.lit(0))).withColumn("next_action", action)


def row_guide(rows: DataFrame, mappings: DataFrame, comparisons: DataFrame, reviews: DataFrame, key: list) -> DataFrame:
    """Five-step guide per row: execute, select, candidate, compare, review."""
    def flag(df, name):
        return df.select(*key).distinct().withColumn(name, F.lit(True))
    cmp = comparisons.groupBy(*key).agg(F.max(F.col("status").isin("match", "mismatch")).alias("_done"), F.max(F.col("status") == "not_comparable").alias("_nc"))
    j = rows.select(*key).join(flag(mappings, "_m"), key, "left").join(cmp, key, "left").join(flag(reviews, "_r"), key, "left").na.fill(False, ["_m", "_done", "_nc", "_r"])
    compare = F.when(~F.col("_m"), "locked").when(F.col("_done"), "complete").when(F.col("_nc"), "review_needed").otherwise("next")
    j = j.withColumn("find_candidate", F.when(F.col("_m"), "complete").otherwise("next")).withColumn("compare_value", compare)
    j = j.withColumn("review_export", F.when(F.col("_r"), "complete").when(F.col("compare_value") != "complete", "locked").otherwise("next"))
    steps = [F.lit("complete"), F.lit("complete"), F.col("find_candidate"), F.col("compare_value"), F.col("review_export")]
    nxt = F.coalesce(*[F.when(F.col(n).isin("next", "review_needed"), n) for n in ("find_candidate", "compare_value", "review_export")])
    return j.withColumn("completed", sum(((s == "complete").cast("int") for s in steps), F.lit(0))).withColumn("next_step", nxt).drop("_m", "_done", "_nc", "_r")
