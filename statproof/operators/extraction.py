"""Claim extraction as corpus jobs: each takes a sentence table and returns a table."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statproof.functions import lexicon as lx, text as tx
from statproof.functions.scale import last_known_by_bucket



def S() -> Column:
    return F.col("sentence")


def extract_quantities(sent: DataFrame, keys: list) -> DataFrame:
    return sent.select(*keys, F.posexplode(tx.quantities(S())).alias("q_idx", "q")).select(*keys, "q_idx", "q.*")


def resolve_period(sent: DataFrame) -> DataFrame:
    return sent.withColumn("period", tx.period(S(), F.col("date")))


def claim_op(sent: DataFrame) -> DataFrame:
    return sent.withColumn("op", tx.comparison_op(S())).withColumn("trend", tx.trend(S()))


def parse_claims(sent: DataFrame) -> DataFrame:
    out = claim_op(resolve_period(sent.withColumn("quantities", tx.quantities(S()))))
    none, undated = F.size("quantities") == 0, F.col("period") == ""
    return (out.withColumn("notes", tx.present((none, "no_quantity"), (undated, "no_period")))
            .withColumn("parse_complete", ~none & ~undated).withColumn("primary", tx.primary_quantity(F.col("quantities"))))


def detect_candidates(sent: DataFrame, rules=()) -> DataFrame:
    return sent.where(tx.is_candidate(S(), rules))


def apply_rules(sent: DataFrame, rules) -> DataFrame:
    """First matching rule id per sentence.  Rules are reviewed configuration, so they become compiled literals
    instead of a pairwise join of sentences and patterns."""
    return sent.withColumn("rule_id", tx.rule_hit(S(), rules))


def _rule_label(rules=()) -> Column:
    return tx.let(tx.detection_path(S(), rules), _label_of_path)


def _label_of_path(path: Column) -> Column:
    numeric, any_digit = tx.has_number(S()), S().rlike(lx.NUMBER)
    return (F.when(path == "number_unit", "NUMERIC_UNIT").when(path == "number_trend", "NUMERIC_TREND")
             .when(path == "superlative", "SUPERLATIVE").when(path.startswith("rule:"), F.regexp_replace(path, "^rule:", ""))
             .when(tx.strip(S()).rlike(lx.NOISE_ONLY), "EXCLUDED_DATE_ONLY").when(S().rlike(lx.SITE_CHROME), "EXCLUDED_SITE_CHROME")
             .when(any_digit & ~numeric, "CONTEXTUAL_NUMBER_ONLY").when(numeric, "NUMERIC_NO_CLAIM").otherwise("NO_MATCH"))


def rule_evidence(sent: DataFrame, rules=()) -> DataFrame:
    return sent.withColumn("candidate", tx.is_candidate(S(), rules)).withColumn("rule_label", _rule_label(rules))


def mixed_fragments(sent: DataFrame) -> DataFrame:
    return sent.withColumn("mixed", tx.mixed_fragments(S()))


def classify_source(sent: DataFrame, routing: dict = lx.DEFAULT_ROUTING) -> DataFrame:
    return sent.withColumn("source", tx.source_label(S(), routing))


def search_terms(sent: DataFrame, routing: dict = lx.DEFAULT_ROUTING) -> DataFrame:
    return classify_source(sent, routing).withColumn("terms", tx.search_terms(F.col("source")))


def counted_terms(sent: DataFrame, routing: dict = lx.DEFAULT_ROUTING) -> DataFrame:
    """query, domain, n: the first search term of a sentence ('' without one), its domain and how many rows hold the sentence.

    Each distinct sentence is labelled once, spread anew because its work is far above its size; the exploded label keeps
    filters on the term from making it again."""
    texts = sent.groupBy("sentence").agg(F.count(F.lit(1)).alias("n"))
    texts = texts.repartition(int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    labelled = texts.select("n", F.explode(F.array(tx.source_label(S(), routing))).alias("source"))
    return labelled.select(F.coalesce(F.get(tx.search_terms(F.col("source")), F.lit(0)), F.lit("")).alias("query"), "source.domain", "n")


def make_queries(sent: DataFrame, aliases=()) -> DataFrame:
    """Adds query and variants; the variants read the query of the row instead of making it again."""
    return sent.withColumn("query", tx.make_query(S(), aliases)).withColumn("variants", tx.variants_of(F.col("query"), tx.substitute_aliases(S(), aliases)))


def apply_aliases(df: DataFrame, column: str, aliases) -> DataFrame:
    return df.withColumn(column, tx.substitute_aliases(F.col(column), aliases))


def claim_profiles(sent: DataFrame, article: str = "article_id", order: str = "sentence_idx", tie: str = "row_no") -> DataFrame:
    """Profile per sentence; a vague indicator with an anaphor inherits from the nearest earlier sentence that has one.

    Rows without URL can share an article id by their title and date; their sentences of equal index stand in `tie` order,
    if the input has that column."""
    own = sent.withColumn("p", tx.claim_profile(S()))
    prior = last_known_by_bucket(own, [article], F.floor(F.col(order) / 1000), [order, tie] if tie in sent.columns else [order],
                                 F.when(F.col("p.indicator") != "", F.col("p")), "prior")
    inherit = (F.col("p.indicator").isin(lx.GENERIC_INDICATORS) & F.col("prior").isNotNull() & S().rlike(lx.ANAPHOR))

    def taken(field, always=False):
        mine, theirs = F.col(f"p.{field}"), F.col(f"prior.{field}")
        return F.when(inherit & (F.lit(always) | (mine == "")), theirs).otherwise(mine).alias(field)
    final = F.struct(taken("topic", True), taken("indicator", True), F.col("p.period").alias("period"),
                     F.col("p.comparison").alias("comparison"), F.col("p.unit").alias("unit"), taken("region"), taken("population"),
                     F.col("p.qualifiers").alias("qualifiers"), F.coalesce(inherit, F.lit(False)).alias("context_inherited"))
    out = prior.withColumn("profile", final).drop("p", "prior")
    terms = F.concat(F.col("profile.qualifiers"), F.when(F.col("profile.indicator") != "", F.array("profile.indicator"))
                     .otherwise(F.array().cast("array<string>")))
    return out.withColumn("search_terms", terms).withColumn("search_query", F.array_join(terms, " "))


def article_period(sent: DataFrame) -> DataFrame:
    """One observation period per article, only when every strong cue names the same one."""
    cues = sent.where(S().rlike(lx.STRONG_PERIOD)).withColumn("period", tx.period(S(), F.col("date"))).where("period <> ''")
    return (cues.groupBy("article_id").agg(F.min("period").alias("period"), F.max("period").alias("_hi"),
                                           F.min(F.col("sentence_idx") + 1).cast("int").alias("row_index"))
            .where(F.col("period") == F.col("_hi")).drop("_hi"))


def atomic_claims(sent: DataFrame, keys: list) -> DataFrame:
    return sent.select(*keys, F.inline(tx.atomic_claims(S())))


# --- claim cards --------------------------------------------------------------------------------------------
def _readiness(reviewed: Column) -> tuple[Column, Column]:
    out_of_scope = F.col("route") != "KOSIS_RETRIEVAL"
    reasons = tx.present((F.col("indicator") == "", "indicator_missing"), (F.col("claim_value_raw") == "", "value_missing"),
                         (F.col("period") == "", "period_missing"), ((F.col("quantity_count") > 1) & ~reviewed, "several_quantities"))
    state = F.when(out_of_scope, "out_of_scope").when(F.size(reasons) > 0, "needs_review").otherwise("ready")
    return state, F.when(out_of_scope, F.array(F.lit("route_out_of_scope"))).otherwise(reasons)


def claim_cards(sent: DataFrame) -> DataFrame:
    """Unconfirmed claim card per sentence: profile, parse and source label side by side, with readiness."""
    parsed = parse_claims(classify_source(claim_profiles(sent)))
    only = F.when(F.size("quantities") == 1, F.try_element_at("quantities", F.lit(1)))
    base = [c for c in sent.columns]
    flat = parsed.withColumn("only", only).select(
        *base, F.col("profile.topic").alias("topic"), F.col("profile.indicator").alias("indicator"),
        F.coalesce("only.raw", F.lit("")).alias("claim_value_raw"), F.col("only.value").alias("claim_value"),
        F.col("only.normalized_value").alias("normalized_value"),
        F.coalesce(F.nullif("only.unit", F.lit("")), "profile.unit").alias("unit"), "period",
        F.col("profile.comparison").alias("comparison"), "op", "trend", F.col("profile.region").alias("region"),
        F.col("profile.population").alias("population"), F.lit("").alias("subject"), F.col("source.source_type").alias("source_type"),
        F.col("source.claim_type").alias("claim_type"), F.col("source.route").alias("route"), F.col("source.reason").alias("route_reason"),
        F.col("profile.context_inherited").alias("context_inherited"), F.size("quantities").alias("quantity_count"))
    state, reasons = _readiness(F.lit(False))
    return flat.withColumn("reviewed", F.lit(False)).withColumn("readiness", state).withColumn("readiness_reasons", reasons)


REVIEWABLE = ["claim_value_raw", "unit", "period", "indicator", "topic", "region", "population", "subject"]


def review_cards(cards: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Apply human edits (null = keep) and recompute readiness; cards without an edit row stay as they are."""
    e = edits.select(F.col(key), F.lit(True).alias("_edited"), *[
        (F.col(f) if f in edits.columns else F.lit(None).cast("string")).alias(f"_{f}") for f in REVIEWABLE])
    j = cards.join(e, key, "left")
    for f in REVIEWABLE:
        j = j.withColumn(f, F.when(F.col("_edited"), F.trim(F.coalesce(f"_{f}", f))).otherwise(F.col(f)))
    j = j.withColumn("reviewed", F.col("reviewed") | F.coalesce("_edited", F.lit(False)))
    state, reasons = _readiness(F.col("reviewed"))
    return j.withColumn("readiness", state).withColumn("readiness_reasons", reasons).select(*cards.columns)


# --- judge responses ----------------------------------------------------------------------------------------
EVIDENCE_STATUSES = ["sufficient", "needs_retrieval", "not_applicable", "unknown"]


def judge_decisions(responses: DataFrame) -> DataFrame:
    """Normalise recorded judge replies (sentence, response) into a decision; unreadable replies stay undecided."""
    d = responses.withColumn("_obj", tx.first_json_object(F.col("response"))).withColumn("_v", F.try_parse_json("_obj"))

    def text(path):
        return F.try_variant_get("_v", f"$.{path}", "string")
    flag = F.try_variant_get("_v", "$.candidate", "boolean")
    is_bool = F.schema_of_variant(F.try_variant_get("_v", "$.candidate", "variant")) == "BOOLEAN"
    has_flag = F.get_json_object("_obj", "$.candidate").isNotNull()
    missing = F.col("_obj").isNull()
    legacy = ~missing & ~has_flag
    decided = legacy | F.coalesce(is_bool, F.lit(False))
    status = text("evidence_status")
    spans = F.coalesce(F.try_variant_get("_v", "$.quoted_spans", "array<string>"), F.array().cast("array<string>"))
    return d.select(
        *[c for c in responses.columns if c != "response"],
        F.when(legacy, F.coalesce(F.try_variant_get("_v", "$.verifiable", "boolean"), F.lit(True))).when(decided, flag).alias("candidate"),
        F.when(missing, "parse_error").when(decided, "success").otherwise("invalid_response").alias("judge_status"),
        F.when(legacy, F.coalesce(text("reason"), F.lit("legacy_response"))).when(missing, "json_parse_failed")
         .when(decided, F.coalesce(text("candidate_reason"), F.lit("no_reason"))).otherwise("candidate_incomplete").alias("candidate_reason"),
        F.when(decided & ~legacy & status.isin(EVIDENCE_STATUSES), status).otherwise("unknown").alias("evidence_status"),
        F.when(decided & ~legacy, F.filter(spans, lambda s: (s != "") & S().contains(s))).otherwise(F.slice(spans, 1, 0)).alias("quoted_spans"))


# --- query planning -----------------------------------------------------------------------------------------
_MONTH_MEMO, _YEAR_MEMO = r"(?<![\p{L}\p{N}_])(\d{4}-\d{2})(?![\p{L}\p{N}_])", r"(?<![\p{L}\p{N}_])(\d{4})(?![\p{L}\p{N}_])"


def expand_periods(plans: DataFrame, keys: list, memo: str, maximum: int | None = None) -> DataFrame:
    """Period memo -> ordered (period, prd_se) requests: same-month year ranges, month lists or year lists.
    `maximum` is the request cap of one run."""
    m = F.col(memo)
    months = F.array_distinct(F.regexp_extract_all(m, F.lit(_MONTH_MEMO), F.lit(1)))
    years = F.array_distinct(F.regexp_extract_all(m, F.lit(_YEAR_MEMO), F.lit(1)))
    a, b = F.get(months, F.lit(0)), F.get(months, F.lit(1))
    y0, y1 = F.substring(a, 1, 4).cast("int"), F.substring(b, 1, 4).cast("int")
    ranged = m.contains("~") & (F.size(months) >= 2) & (F.substring(a, 6, 2) == F.substring(b, 6, 2)) & (y0 <= y1)
    spread = F.transform(F.sequence(y0, F.when(ranged, y1).otherwise(y0)),
                         lambda y: F.concat(y.cast("string"), F.lit("-"), F.substring(a, 6, 2)))
    chosen = F.when(ranged, spread).when(F.size(months) > 0, months).otherwise(years)
    kind = F.when(F.size(months) > 0, "M").otherwise("Y")
    out = plans.select(*keys, kind.alias("prd_se"), F.posexplode(chosen).alias("request_idx", "period"))
    return out if maximum is None else out.orderBy(*keys, "request_idx").limit(maximum)
