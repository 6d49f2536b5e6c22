"""Evaluation metrics and gold-set quality checks as aggregations and joins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from statproof.functions import text as tx, verdict as vd
from statproof.functions.scale import first_per_key, stable, top_per_key, with_row_number

THRESHOLDS = {"detection_f1": 0.80, "verdict_accuracy": 0.75, "fallback_f1": 0.80}
STAGES = ["ingest", "detect", "parse", "map", "evidence", "verdict", "explain", "review", "eval"]
FAILURE_TYPES = ["detection", "extraction", "mapping", "alignment", "verdict", "explanation"]


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty).cast("double")).otherwise(a / b)


def prf(df: DataFrame, empty: float = 0.0) -> DataFrame:
    """Add rounded precision, recall, f1 to columns tp, fp, fn."""
    tp, p, r = F.col("tp"), _ratio(F.col("tp"), F.col("tp") + F.col("fp"), empty), _ratio(F.col("tp"), F.col("tp") + F.col("fn"), empty)
    return (df.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4))
            .withColumn("f1", F.round(F.when(tp == 0, 0.0).otherwise(2 * p * r / (p + r)), 4)))


def _counts(gold: Column, pred: Column) -> list:
    return [F.count_if(gold & pred).alias("tp"), F.count_if(~gold & pred).alias("fp"), F.count_if(gold & ~pred).alias("fn"), F.count_if(~gold & ~pred).alias("tn")]


def eval_detection(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return prf(rows.agg(*_counts(F.col(gold), F.col(pred))))


def detection_misses(rows: DataFrame, gold: str, pred: str) -> DataFrame:
    return rows.where(F.col(gold) != F.col(pred)).withColumn("kind", F.when(F.col(pred), "detect_fp").otherwise("detect_fn"))


def predict_verdicts(gold: DataFrame) -> DataFrame:
    """Predicted label per gold claim; missing evidence means unverifiable."""
    c = vd.compare(F.col("claimed_value"), F.col("claimed_unit"), F.lit(1), F.col("evidence_value"), F.col("evidence_unit"), F.coalesce("claimed_op", F.lit("eq")))
    return gold.where("gold_label IS NOT NULL").withColumn("pred", F.when(F.col("evidence_value").isNull(), "unverifiable").otherwise(c["label"]))


def class_metrics(pairs: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Per-class counts and P/R/F1 from one confusion aggregation."""
    cells = pairs.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)
    sides = cells.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("gn"), F.lit(0).cast("long").alias("pn"), hit.cast("long").alias("tp")),
                                           F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("gn"), F.col("n").alias("pn"), F.lit(0).cast("long").alias("tp")))).alias("s")).select("s.*")
    per = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("gn").alias("gn"), F.sum("pn").alias("pn"))
    return prf(per.select("label", "tp", (F.col("pn") - F.col("tp")).alias("fp"), (F.col("gn") - F.col("tp")).alias("fn")))


def classification_report(pairs: DataFrame) -> DataFrame:
    """Accuracy and macro F1 (mean of the rounded class F1 values)."""
    m = class_metrics(pairs)
    n = F.sum(F.col("tp") + F.col("fn"))
    return m.agg(n.alias("n"), F.round(F.sum("tp") / n, 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("macro_f1"))


def fallback_metrics(pairs: DataFrame, label: str = "unverifiable") -> DataFrame:
    return prf(pairs.agg(*_counts(F.col("gold") == label, F.col("pred") == label))).drop("tn")


def diff_runs(runs: DataFrame) -> DataFrame:
    """runs(metric, run_no, value): change against the run before, per metric."""
    w = Window.partitionBy("metric").orderBy("run_no")
    m = runs.withColumn("prev", F.lag("value").over(w)).where("prev IS NOT NULL AND value IS NOT NULL")
    return m.select("metric", "run_no", "prev", F.col("value").alias("now"), F.round(F.col("value") - F.col("prev"), 4).alias("delta"))


def failure_records(misses: DataFrame, key: str) -> DataFrame:
    kind = F.col("kind")
    return misses.select(F.concat(F.lit("F"), F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), kind), 256), 1, 12)).alias("fail_id"), F.lit("eval").alias("stage"),
                         F.when(kind.startswith("detect"), "detection").otherwise("verdict").alias("type"), kind, F.col(key), F.lit(False).alias("resolved"),
                         F.array().cast("array<string>").alias("derived_assets"))


def with_vocabulary_check(failures: DataFrame) -> DataFrame:
    """Failure records with `problem`: a stage or type outside the fixed vocabularies is refused (null = accepted)."""
    return failures.withColumn("problem", F.when(~F.coalesce(F.col("stage").isin(STAGES), F.lit(False)), "unknown_stage")
                               .when(~F.coalesce(F.col("type").isin(FAILURE_TYPES), F.lit(False)), "unknown_type"))


def failure_stats(failures: DataFrame) -> DataFrame:
    accepted = with_vocabulary_check(failures).where("problem IS NULL")
    return accepted.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("resolved"),
                                        _ratio(F.count_if(F.col("resolved") & (F.size("derived_assets") > 0)), F.count_if("resolved"), None).alias("asset_conversion_rate"))


def resolve(failures: DataFrame, resolutions: DataFrame) -> DataFrame:
    """resolutions(fail_id, assets): accepted only with at least one derived asset; the outcome says what happened."""
    j = failures.join(resolutions, "fail_id", "full")
    ok = F.coalesce(F.size("assets") > 0, F.lit(False))
    known = F.col("stage").isNotNull()
    return j.select("fail_id", "type", F.when(known, F.col("resolved") | (ok & F.col("assets").isNotNull())).alias("resolved"),
                    F.when(ok, F.col("assets")).otherwise(F.col("derived_assets")).alias("derived_assets"),
                    F.when(F.col("assets").isNull(), "open").when(~known, "unknown_id").when(ok, "resolved").otherwise("rejected_no_asset").alias("outcome"))


def routing_metrics(pairs: DataFrame) -> DataFrame:
    """Source routing quality; precision and recall are 1.0 when undefined."""
    def official(c):
        return F.col(c).startswith("KOSIS")
    a = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("hit"), F.count_if(F.col("pred") == "UNKNOWN").alias("unknown"),
                  *_counts(official("gold"), official("pred")))
    return a.select("n", F.round(F.col("hit") / F.col("n"), 4).alias("source_type_accuracy"),
                    F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp"), 1.0), 4).alias("official_precision"),
                    F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn"), 1.0), 4).alias("official_recall"), F.round(F.col("unknown") / F.col("n"), 4).alias("unknown_rate"))


def eval_mapping(gold: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """gold(case_id, gold_ids array), hits(case_id, rank, tbl_id): any/all hits at 1 and k, cases without gold skipped."""
    ranked = hits.where(F.col("rank") <= k).groupBy("case_id").agg(F.collect_set(F.when(F.col("rank") == 1, F.col("tbl_id"))).alias("t1"), F.collect_set("tbl_id").alias("tk"))
    j = gold.join(ranked, "case_id", "left")
    empty = F.array().cast("array<string>")
    has = F.size("gold_ids") > 0

    def flags(col, name):
        inter = F.size(F.array_intersect("gold_ids", F.coalesce(col, empty)))
        return [F.count_if(has & (inter > 0)).alias(f"hit_any_at_{name}"), F.count_if(has & (inter == F.size(F.array_distinct("gold_ids")))).alias(f"hit_all_at_{name}")]
    return j.agg(F.count_if(has).alias("evaluated"), F.count_if(~has).alias("skipped"), *flags("t1", "1"), *flags("tk", "k"))


def eval_paths(gold: DataFrame, rankings: DataFrame) -> DataFrame:
    """gold(qid, gold_ord), rankings(path, mode, qid, rank, ord): Hit@1, Hit@3, MRR per path and mode, gain over raw
    queries, best path of the generated queries."""
    n = gold.agg(F.count(F.lit(1)).alias("n")).scalar()
    hit = F.col("ord") == F.col("gold_ord")
    agg = rankings.where("rank <= 3").join(gold.hint("merge"), "qid", "left").groupBy("path", "mode").agg(
        F.count_if(hit & (F.col("rank") == 1)).alias("h1"), F.count_if(hit).alias("h3"), F.sum(F.when(hit, 1.0 / F.col("rank")).otherwise(0.0)).alias("s"))
    # One row per path and mode, read three times below: the searches behind it run once.
    m = stable(agg.select("path", "mode", "h1", "h3", F.round(F.col("s") / n, 6).alias("mrr")))
    raw = m.where("mode = 'raw'").select("path", F.col("h3").alias("raw_h3"))
    out = m.join(raw, "path", "left").withColumn("gain", F.when(F.col("mode") != "raw", F.col("h3") - F.col("raw_h3"))).drop("raw_h3")
    best = m.where("mode = 'gen'").agg(F.max_by("path", F.struct("h3", "mrr")).alias("b")).scalar()
    return out.withColumn("best", (F.col("mode") == "gen") & (F.col("path") == best))


def e2e_progress(cases: DataFrame, catalog: DataFrame, compared: DataFrame) -> DataFrame:
    """cases(candidate_id, tbl_id or null, one row per gold table): status per case, then counts."""
    known = catalog.select("tbl_id", F.lit(True).alias("_k")).distinct()
    done = compared.select("candidate_id", F.lit(True).alias("_d")).distinct()
    c = (cases.join(known, "tbl_id", "left").groupBy("candidate_id").agg(F.count("tbl_id").alias("n"), F.count("_k").alias("k")).join(done, "candidate_id", "left"))
    status = (F.when(F.col("_d"), "verdict_verified").when(F.col("n") == 0, "no_table_mapping").when(F.col("k") < F.col("n"), "needs_catalog").otherwise("needs_coordinates_and_snapshot"))
    return c.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def e2e_summary(verdicts: DataFrame) -> DataFrame:
    """Case-level result with precedence mismatch > match > unverifiable."""
    c = verdicts.groupBy("case_id").agg(*[F.max(F.coalesce(F.col("verdict") == v, F.lit(False))).alias(v) for v in ("mismatch", "match", "unverifiable")],
                                        F.max(F.coalesce(F.col("snapshot_id"), F.lit("")) != "").alias("backed"))
    return c.agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.col("mismatch") | F.col("match") | F.col("unverifiable")).alias("final_count"),
                 F.count_if("mismatch").alias("mismatch_count"), F.count_if(~F.col("mismatch") & F.col("match")).alias("match_count"),
                 F.count_if(~F.col("mismatch") & ~F.col("match") & F.col("unverifiable")).alias("unverifiable_count"), F.count_if("backed").alias("evidence_backed_count"))


def metric_gate(metrics: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    need = F.lit(None).cast("double")
    for name, value in thresholds.items():
        need = F.when(F.col("metric") == name, F.lit(value)).otherwise(need)
    return metrics.withColumn("threshold", need).where("threshold IS NOT NULL").withColumn("passed", F.col("value") >= F.col("threshold"))


def _label_pairs(a: DataFrame, b: DataFrame, fields: list) -> DataFrame:
    def side(df, tag):
        return df.select("row_id", *[F.lower(F.trim(F.coalesce(f, F.lit("")))).alias(f"{f}_{tag}") for f in fields])
    j = side(a, "a").join(side(b, "b"), "row_id")
    filled = [F.greatest(*[F.col(f"{f}_{t}") for f in fields], F.lit("")) != "" for t in "ab"]
    return j.where(filled[0] & filled[1])


def agreement(a: DataFrame, b: DataFrame, fields: list) -> DataFrame:
    """Raw agreement and Cohen's kappa per field (kappa is 1 when chance agreement is 1)."""
    long = _label_pairs(a, b, fields).select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_a").alias("a"), F.col(f"{f}_b").alias("b")) for f in fields])).alias("x")).select("x.*")
    cells = long.groupBy("field", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy("field").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("hit"))
    ma = cells.groupBy("field", F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    mb = cells.groupBy("field", F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = ma.join(mb, ["field", "v"]).groupBy("field").agg(F.sum(F.col("na") * F.col("nb")).alias("s"))
    j = total.join(chance, "field", "left")
    po, pe = F.col("hit") / F.col("n"), F.coalesce(F.col("s"), F.lit(0)) / (F.col("n") * F.col("n"))
    return j.select("field", "n", "hit", F.round(po, 6).alias("rate"), F.round(F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)), 6).alias("kappa"))


def merge_labels(a: DataFrame, b: DataFrame, fields: list, gold: DataFrame) -> DataFrame:
    """Per labelled row: agreed and mergeable, agreed but already gold or negative, or disagreement with both values."""
    j = _label_pairs(a, b, fields).join(gold.select("row_id", F.lit(True).alias("_g")), "row_id", "left")
    diffs = tx.present(*[(F.col(f"{f}_a") != F.col(f"{f}_b"), F.concat(F.lit(f + ":"), F.col(f"{f}_a"), F.lit("|"), F.col(f"{f}_b"))) for f in fields])
    positive = F.col(f"{fields[0]}_a").isin("true", "1", "y", "yes", "t")
    return j.withColumn("differences", diffs).select("row_id", "differences", F.when(F.size("differences") > 0, "disagree").when(~positive, "negative")
                                                     .when(F.col("_g"), "already_gold").otherwise("merged").alias("outcome"))


def stratified_sample(df: DataFrame, n: int, weights: dict, key: str, seed: int = 7, negative_share: float = 0.15) -> DataFrame:
    """Weighted domains, spread over claim types, topped up from the rest, plus negatives taken in turn per source.

    The random draw is a seeded hash order, so the sample is reproducible.  Every cut is a top-k per group, which Spark
    trims map-side; only candidates (at most the quota per group) reach the later steps."""
    n_neg = round(n * negative_share)
    n_pos = n - n_neg
    h = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    pos = h.where("is_positive")
    quota = F.lit(None).cast("int")
    for d, w in weights.items():
        quota = F.when(F.col("domain") == d, F.lit(round(n_pos * w))).otherwise(quota)
    pos = pos.withColumn("_quota", quota).where("_quota IS NOT NULL")
    types = pos.groupBy("domain", "claim_type").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("domain")
    types = types.withColumn("_types", F.count(F.lit(1)).over(w)).withColumn("_torder", F.row_number().over(w.orderBy(F.desc("_n"), "claim_type"))).drop("_n")
    top = top_per_key(pos, ["domain", "claim_type"], ["_h", key], max([round(n_pos * x) for x in weights.values()] + [1]), "_r").join(types, ["domain", "claim_type"])
    per = F.greatest(F.lit(1), F.floor(F.col("_quota") / F.col("_types")))
    staged = top.withColumn("_fill", F.when(F.col("_r") <= per, 0).otherwise(1))
    order = ["_fill", F.when(F.col("_fill") == 0, F.col("_torder")).otherwise(0), "_h", key]
    picked = staged.withColumn("_p", F.row_number().over(w.orderBy(*order))).where("_p <= _quota").select(key, F.lit("positive").alias("kind"), "domain", "claim_type")
    neg = top_per_key(h.where("NOT is_positive"), ["source_type"], ["_h", key], max(n_neg, 1), "_r").orderBy("_r", F.xxhash64("source_type", F.lit(seed)), "source_type").limit(n_neg)
    return picked.unionByName(neg.select(key, F.lit("negative").alias("kind"), "domain", "claim_type"))


# --- gold set -----------------------------------------------------------------------------------------------
def _t(c) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def validate_gold(df: DataFrame, required: list, vocab: dict, approved_required: list, order: str = "row_no") -> DataFrame:
    """One row per issue.  Duplicates are found by the first row of each id / sentence (a mergeable minimum)."""
    sentence = F.lower(F.trim(F.regexp_replace(_t("sentence"), r"\s+", " ")))
    base = df.withColumn("_s", sentence).withColumn("_id", _t("claim_id"))
    first_id = base.where("_id <> ''").groupBy("_id").agg(F.min(order).alias("_fid"))
    first_s = base.where("_s <> ''").groupBy("_s").agg(F.min(order).alias("_fs"))
    b = base.join(first_id, "_id", "left").join(first_s, "_s", "left")

    def issue(code, field):
        return F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))
    checks = [(_t(f) == "", issue("required_field", f)) for f in sorted(required)]
    checks += [((_t(f) != "") & ~_t(f).isin(words), issue(f"invalid_{f}", f)) for f, words in vocab.items()]
    checks += [(F.col("_fid") < F.col(order), issue("duplicate_claim_id", "claim_id")), (F.col("_fs") < F.col(order), issue("duplicate_sentence", "sentence"))]
    checks += [((_t("review_status") == "approved") & (_t(f) == ""), issue("approved_required", f)) for f in approved_required]
    found = F.array_compact(F.array(*[F.when(c, i) for c, i in checks]))
    return b.select(order, F.col("_id").alias("claim_id"), F.explode(found).alias("i")).select(order, "claim_id", "i.*")


def parity(a: DataFrame, b: DataFrame, fields: list, order: str = "row_no") -> DataFrame:
    """Issues between two formats of one gold set: duplicates, missing ids, multiplicity, positional field mismatch."""
    def side(df, tag):
        w = Window.partitionBy("claim_id").orderBy(order)
        return (df.select(_t("claim_id").alias("claim_id"), order, *[_t(f).alias(f) for f in fields]).where("claim_id <> ''")
                .withColumn("occ", F.row_number().over(w)).select("claim_id", "occ", F.struct(*fields).alias(tag)))
    x, y = side(a, "a"), side(b, "b")

    def size(df, tag):
        return df.groupBy("claim_id").agg(F.count(F.lit(1)).alias(f"n{tag}"))
    n = size(x, "a").join(size(y, "b"), "claim_id", "full")
    codes = tx.present((F.col("na") > 1, "duplicate_in_a"), (F.col("nb") > 1, "duplicate_in_b"), (F.col("nb").isNull(), "missing_in_b"), (F.col("na").isNull(), "missing_in_a"),
                       (F.col("na") != F.col("nb"), "multiplicity_mismatch"))
    ids = n.select("claim_id", F.explode(codes).alias("code"), F.lit("claim_id").alias("field"))
    pairs = x.join(y, ["claim_id", "occ"])
    diff = tx.present(*[(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), f) for f in sorted(fields)])
    return ids.unionByName(pairs.select("claim_id", F.lit("field_mismatch").alias("code"), F.explode(diff).alias("field")))


def gold_progress(df: DataFrame, targets: dict, issues: DataFrame) -> DataFrame:
    """(kind, name, target, current, gap): domains against targets, review states, valid evaluation rows."""
    dom = df.groupBy(_t("domain").alias("domain")).agg(F.count(F.lit(1)).alias("c"))
    counts = F.map_from_entries(F.collect_list(F.struct("domain", "c")))
    want = F.array(*[F.struct(F.lit(d).alias("name"), F.lit(t).alias("target")) for d, t in targets.items()])
    domains = (dom.where(F.col("domain").isin(list(targets))).agg(counts.alias("m")).select(F.explode(want).alias("w"), "m")
               .select(F.lit("domain").alias("kind"), "w.name", F.col("w.target").cast("long").alias("target"), F.coalesce(F.try_element_at("m", F.col("w.name")), F.lit(0)).alias("current")))
    reviews = df.where(_t("review_status") != "").groupBy(_t("review_status").alias("name")).agg(F.count(F.lit(1)).alias("current"))
    valid = (df.where(_t("review_status") == "approved").withColumn("claim_id", _t("claim_id")).join(issues.select("claim_id").distinct(), "claim_id", "left_anti")
             .agg(F.count(F.lit(1)).alias("current")))
    null = F.lit(None).cast("long").alias("target")
    out = (domains.unionByName(reviews.select(F.lit("review").alias("kind"), "name", null, "current"))
           .unionByName(valid.select(F.lit("valid").alias("kind"), F.lit("evaluation_rows").alias("name"), null, "current")))
    return (out.withColumn("gap", F.greatest(F.lit(0), F.col("target") - F.col("current")))
            .withColumn("issue", F.when(F.col("current") < F.col("target"), "domain_target_under").when(F.col("current") > F.col("target"), "domain_target_over")))


def append_gold(gold: DataFrame, new: DataFrame, labels: list, key: str = "row_no") -> DataFrame:
    """Accepted new rows with their next numbers: unknown labels, known sentences and repeats are refused."""
    s = F.trim("sentence")
    ok = new.where(F.col("gold_label").isin(labels) & (s != "")).withColumn("_s", s)
    fresh = first_per_key(ok.join(gold.select(F.trim("sentence").alias("_s")), "_s", "left_anti"), ["_s"], [key]).drop("_s")
    base = gold.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).scalar()
    return with_row_number(fresh, key, "_n").withColumn("gold_no", F.col("_n") + base).drop("_n")


def asset_stats(gold: DataFrame, field: str = "gold_label") -> DataFrame:
    return gold.groupBy(field).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("review_status") == "approved").alias("approved"))


def rule_stats(rules: DataFrame) -> DataFrame:
    """(type, total, executable) of rules(rule_id, type, pattern): rules of each type, `?` without one, and those with a pattern."""
    kind = F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("?"))
    return rules.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(F.col("pattern"), F.lit("")) != "").alias("executable"))


def alias_stats(aliases: DataFrame) -> DataFrame:
    """(total, from_failure) of aliases(alias, canonical, origin): those whose origin is a failure record, `F...`."""
    return aliases.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("origin").startswith("F")).alias("from_failure"))
