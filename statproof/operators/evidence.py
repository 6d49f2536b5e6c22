"""Evidence join, refusal guards, derived values and verdicts.

Evidence of a claim is found by equality on (table, period prefix, category): the category is resolved first against
the distinct categories of the slice, so a claim meets only the rows it can use, not its whole table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from statproof.functions import lexicon as lx, text as tx, verdict as vd
from statproof.functions.scale import SALTS, anchored_contains, salted_join, stable
from statproof.operators.ranking import filter_coverage, search_overlap

_ROW_ORDER = ["c1_nm", "c2_nm", "itm_nm", "prd_de"]


def per_text(df: DataFrame, found: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """`df` with the columns that `found` holds for its `keys`; nulls meet nulls.  What depends on these keys alone is worked
    out once for each of their values, however many rows share it.  Spark splits a value that most rows share."""
    other = found.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in found.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return df.join(other.hint("merge"), same, how).drop(*[f"_of_{k}" for k in keys])


# --- tables of a claim --------------------------------------------------------------------------------------
def candidate_tables(claims: DataFrame, catalog: DataFrame, depth: int = 10) -> DataFrame:
    """claims(claim_id, sentence, period, ...) x the `depth` best tables of each sentence that can hold its year.

    catalog(ord, tbl_id, org_id, tbl_nm, doc, start_prd, end_prd).  `rank` counts the tables that stay, `orig_rank` all hits;
    an unknown year or range excludes nothing.  A claim whose sentence shares no word part with any table has no row.
    Claims of one sentence and period are searched and cut once."""
    asked = stable(claims.select("sentence", "period").where("sentence IS NOT NULL").distinct().withColumn("claim_id", F.struct("sentence", "period")))
    hits = search_overlap(asked.select("sentence").distinct().select(F.col("sentence").alias("qid"), F.col("sentence").alias("query")), catalog.select("ord", "doc"), depth)
    met = asked.join(hits.select(F.col("qid").alias("sentence"), "ord", "rank").hint("merge"), "sentence").join(catalog.drop("doc"), "ord")
    return per_text(claims, filter_coverage(met, depth).drop("ord", "score", "start_prd", "end_prd", "claim_id"), ["sentence", "period"])


def per_table(claims: DataFrame) -> DataFrame:
    """Make every (claim, table) pair a claim of its own: `claim_id` becomes the struct (claim_id, tbl_id), so that the
    operators below work on all candidate tables of a claim at once, each table apart from the others."""
    return claims.withColumn("claim_id", F.struct("claim_id", "tbl_id"))


def year_before(period: Column) -> Column:
    """The same period one year earlier; null without a leading year."""
    return F.concat((F.substring(period, 1, 4).try_cast("int") - 1).cast("string"), F.substring(period, 5, 100))


# --- evidence slices ----------------------------------------------------------------------------------------
def official_rows(stats: DataFrame) -> DataFrame:
    """Cube rows with a numeric value, an inferred unit and one row per usable period prefix (year, month/quarter)."""
    unit = vd.infer_unit(F.col("unit_nm"), F.col("itm_nm"), F.col("tbl_nm"))
    prefixes = F.array_distinct(F.array(F.substring("prd_de", 1, 4), F.substring("prd_de", 1, 6), F.col("prd_de")))
    return (stats.withColumn("value", tx.official_number(F.col("dt"))).where("value IS NOT NULL").withColumn("unit", unit)
            .withColumn("pkey", F.explode(prefixes)))


def fetch_evidence(claims: DataFrame, stats: DataFrame, c1: str = "", c2: str = "", itm: str = "") -> DataFrame:
    """claims(claim_id, tbl_id, period) -> matching rows; optional partial filters on category and item names."""
    rows = official_rows(stats)
    for column, part in (("c1_nm", c1), ("c2_nm", c2), ("itm_nm", itm)):
        if part:
            rows = rows.where(F.col(column).contains(part))
    frequency = (F.when(F.upper("period").contains("Q"), "Q").when(F.length("pkey") >= 6, "M").otherwise("Y"))
    asked = claims.withColumn("pkey", F.replace("period", F.lit("-"), F.lit(""))).withColumn("prd_se", frequency)
    return asked.join(rows.drop("org_id", "tbl_nm", "survey"), ["tbl_id", "pkey"])


def _category_tail(c: Column) -> Column:
    return F.trim(F.element_at(F.split(c, ":"), -1))


def pick_category(claims: DataFrame, stats: DataFrame) -> DataFrame:
    """Add `c1_pick`: the longest category named in the sentence, else the national total, else null (= all rows).  It is
    picked once for all claims that share slice and sentence."""
    keys = ["tbl_id", "pkey", "sentence"]
    asked = stable(claims.withColumn("pkey", F.replace("period", F.lit("-"), F.lit(""))))  # a parse behind it runs once
    texts = stable(asked.select(*keys).distinct())
    cats = (official_rows(stats).select("tbl_id", "pkey", "c1_nm").distinct().join(texts.select("tbl_id", "pkey").distinct(), ["tbl_id", "pkey"], "left_semi")
            .withColumn("tail", _category_tail(F.col("c1_nm"))))
    forms = F.array_distinct(F.array("tail", F.regexp_replace("tail", "[특별시광역시도]+$", "")))
    needles = cats.withColumn("needle", F.explode(forms))
    named = (anchored_contains(texts, "sentence", needles, "needle", on=["tbl_id", "pkey"], salts=SALTS)
             .groupBy(*keys).agg(F.min_by("c1_nm", F.struct(-F.length("tail"), F.col("c1_nm"))).alias("_named")))
    national = cats.where("c1_nm = '전국'").select("tbl_id", "pkey", F.lit("전국").alias("_total"))
    picks = (salted_join(texts.join(named.hint("merge"), keys, "left"), national, ["tbl_id", "pkey"], ["sentence"], "left")
             .select(*keys, F.coalesce("_named", "_total").alias("c1_pick")))
    return per_text(asked, picks, keys, "left")


def category_evidence(claims: DataFrame, stats: DataFrame) -> DataFrame:
    """Evidence rows of the picked category.  Claims without any category fall back to their whole slice."""
    picked = stable(pick_category(claims, stats))  # read for both kinds of pick
    rows = official_rows(stats).select("tbl_id", "pkey", "c1_nm", "c2_nm", "itm_nm", "prd_de", "value", "unit", "lst_chn_de")
    rows = rows.join(picked.select("tbl_id", "pkey").distinct(), ["tbl_id", "pkey"], "left_semi")  # only these are copied below
    exact = salted_join(picked.where("c1_pick IS NOT NULL"), rows.withColumnRenamed("c1_nm", "c1_pick"), ["tbl_id", "pkey", "c1_pick"], ["claim_id"]).withColumn("c1_nm", F.col("c1_pick"))
    whole = salted_join(picked.where("c1_pick IS NULL"), rows, ["tbl_id", "pkey"], ["claim_id"])
    return exact.unionByName(whole).withColumn("dim", F.coalesce(F.nullif("c2_nm", F.lit("")), "itm_nm"))


# --- guards -------------------------------------------------------------------------------------------------
def match_basis(ev: DataFrame) -> DataFrame:
    """Keep items of the claim's comparison basis.  A table with one item only ignores the basis; with several items
    and none that fits, every row is marked `basis_missing`."""
    w = Window.partitionBy("claim_id")
    basis = vd.claim_basis(F.col("sentence"), F.col("period"))
    fits = F.replace("itm_nm", F.lit(" "), F.lit("")).contains(F.col("basis"))
    m = (ev.withColumn("basis", basis).withColumn("_fit", (F.col("basis") != "") & fits).withColumn("_any", F.max("_fit").over(w))
         .withColumn("_multi", F.min("itm_nm").over(w) != F.max("itm_nm").over(w)))
    return (m.withColumn("basis_missing", (F.col("basis") != "") & ~F.col("_any") & F.col("_multi"))
            .withColumn("basis_used", (F.col("basis") != "") & (F.col("_any") | F.col("_multi")))
            .where((F.col("basis") == "") | F.col("_fit") | ~F.col("_any")).drop("_fit", "_any", "_multi"))


def prefer_total(ev: DataFrame) -> DataFrame:
    named = tx.contains_any(F.col("sentence"), lx.NAMED_INDEXES)
    total = F.col("c1_nm").contains("총지수") | F.col("itm_nm").contains("총지수")
    m = ev.withColumn("_t", total).withColumn("_any", F.max("_t").over(Window.partitionBy("claim_id")))
    return m.where(named | ~F.col("_any") | F.col("_t")).drop("_t", "_any")


def guard_granularity(ev: DataFrame) -> DataFrame:
    """(claim_id, granularity_mismatch): monthly wording while every row is annual."""
    fine = F.substring("prd_de", 1, 6).rlike(r"^\d{6}$")
    return ev.groupBy("claim_id").agg((F.max(F.col("sentence").rlike(lx.MONTHLY_CLAIM)) & ~F.max(fine)).alias("granularity_mismatch"))


def guard_revision(ev: DataFrame) -> DataFrame:
    """(claim_id, stale): the latest revision of the used rows is after the article."""
    latest = F.max(F.nullif(F.trim("lst_chn_de"), F.lit("")))
    return ev.groupBy("claim_id").agg(latest.alias("latest"), F.any_value("article_date").alias("_a")).select(
        "claim_id", "latest", F.coalesce(tx.article_day(F.col("latest")) > tx.article_day(F.col("_a")), F.lit(False)).alias("stale"))


def guard_base_year(claims: DataFrame) -> DataFrame:
    base = vd.index_base_year(F.col("tbl_nm"))
    return claims.withColumn("base_year_risk", base.isNotNull() & vd.is_index_level(F.col("sentence"), F.col("q.unit")))


def _band_start(dim: Column) -> Column:
    hit = F.regexp_extract(dim, lx.AGE_BAND, 1)
    return F.coalesce(F.nullif(hit, F.lit("")), F.nullif(F.regexp_extract(dim, lx.AGE_BAND, 2), F.lit(""))).cast("int")


def ratio_age_band(ev: DataFrame) -> DataFrame:
    """(claim_id, ratio): bands from the cut-off age over the total, in percent."""
    cutoff = F.nullif(F.regexp_extract("sentence", lx.AGE_RATIO_CLAIM, 1), F.lit("")).cast("int")
    m = ev.withColumn("_cut", cutoff).where("_cut IS NOT NULL").withColumn("_band", _band_start(F.col("dim")))
    order = F.struct(*_ROW_ORDER)
    agg = m.groupBy("claim_id").agg(F.sum(F.when(F.col("_band") >= F.col("_cut"), F.col("value"))).alias("bands"),
                                    F.min_by("value", F.when(F.col("dim") == "계", order)).alias("total"))
    return agg.where("bands IS NOT NULL AND total <> 0").select("claim_id", (F.col("bands") / F.col("total") * 100).alias("ratio"))


def totals(ev: DataFrame, value: str, unit: str) -> DataFrame:
    """First total row per claim."""
    return (ev.where("dim = '계'").groupBy("claim_id").agg(F.min_by(F.struct("value", "unit"), F.struct(*_ROW_ORDER)).alias("_t"))
            .select("claim_id", F.col("_t.value").alias(value), F.col("_t.unit").alias(unit)))


def change_rate(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(claim_id, rate, direction) from the total rows of both years; zero change counts as down."""
    j = (totals(current, "cur", "cur_unit").join(totals(previous, "prev", "prev_unit"), "claim_id")
         .join(current.groupBy("claim_id").agg(F.any_value("sentence").alias("sentence"), F.any_value("trend").alias("trend")), "claim_id"))
    ok = F.col("trend").isin("up", "down") & (F.col("prev") != 0) & vd.metric_guard(F.col("sentence"), F.col("cur_unit"))
    rate = (F.col("cur") - F.col("prev")) / F.col("prev") * 100
    return j.where(ok).select("claim_id", rate.alias("rate"), F.when(rate > 0, "up").otherwise("down").alias("direction"))


def share_metric(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered share (numerator / denominator) of the claim year and the year before.  registry(metric, alias,
    year, numerator, denominator); the first registered metric named in the sentence counts.  Claim ids are unique."""
    year = F.when(F.col("period").rlike(r"^\d{4}$"), F.col("period").cast("int"))
    asked = claims.where(tx.contains_any(F.col("sentence"), ["비중", "구성비"])).withColumn("_year", year).where("_year IS NOT NULL")
    pairs = anchored_contains(asked.select("claim_id", "_year", "sentence"), "sentence", registry.select("metric", "alias").distinct(), "alias", salts=SALTS)
    chosen = pairs.groupBy("claim_id", "_year").agg(F.min("metric").alias("metric"))
    now = registry.select("metric", F.col("year").alias("_year"), (F.col("numerator") / F.col("denominator") * 100).alias("share")).distinct()
    before = now.select("metric", (F.col("_year") + 1).alias("_year"), F.col("share").alias("previous_share"))
    return (chosen.join(now, ["metric", "_year"]).join(before, ["metric", "_year"])
            .select("claim_id", "metric", "share", "previous_share", (F.col("share") - F.col("previous_share")).alias("point_change")))


# --- end to end ---------------------------------------------------------------------------------------------
def parse_for_verdict(claims: DataFrame, rules=()) -> DataFrame:
    """Claims with path, q, op, trend, period and early; each distinct sentence of a date is parsed once."""
    s = F.col("sentence")
    p = (claims.select("sentence", "article_date").distinct().withColumn("path", tx.detection_path(s, rules)).withColumn("_q", tx.quantities(s)).withColumn("q", tx.primary_quantity(F.col("_q"))).drop("_q")
         .withColumn("op", tx.comparison_op(s)).withColumn("trend", tx.trend(s)).withColumn("_p", tx.period(s, F.col("article_date")))
         .withColumn("period", F.coalesce(F.nullif("_p", F.lit("")), F.substring("article_date", 1, 4))).drop("_p"))
    early = (F.when(F.col("path").isin("empty", "noise", "site_chrome", "none"), "not_claim").when(tx.mixed_fragments(s), "mixed_fragments")
              .when(F.col("q").isNull(), "no_quantity").when(tx.contains_any(s, ["전망", "예상된다"]), "forecast"))
    # One generated struct is a barrier: filters and later projections use its fields instead of re-running the parse.
    done = p.withColumn("early", early)
    parsed = done.select(F.explode(F.array(F.struct(*done.columns))).alias("c")).select("c.*")
    return per_text(claims, parsed, ["sentence", "article_date"])


def verify_claims(claims: DataFrame, catalog: DataFrame, stats: DataFrame, registry: DataFrame | None = None, rules=()) -> DataFrame:
    """claims(claim_id, sentence, article_date) -> one verdict per claim with its reason and rule trail.

    Every guard is a flag; the first one in the fixed order decides.  catalog(ord, tbl_id, org_id, tbl_nm, doc).
    The parse, the chosen tables and the evidence feed several branches each; reliable checkpoints keep them computed
    once and keep the plan of the later self-joins small (analysis time grows with every re-used subtree)."""
    parsed = stable(parse_for_verdict(claims, rules))
    live = parsed.where("early IS NULL")
    if registry is not None:
        shares = share_metric(live, registry).select("claim_id", "share")
    else:
        shares = live.sparkSession.createDataFrame([], "claim_id long, share double")
    hits = search_overlap(live.select(F.col("claim_id").alias("qid"), F.col("sentence").alias("query")), catalog.select("ord", "doc"), 1)
    tabled = stable(live.join(hits.select(F.col("qid").alias("claim_id"), "ord", "score"), "claim_id").join(catalog.drop("doc"), "ord"))
    ev = prefer_total(match_basis(category_evidence(tabled, stats)))
    family = tx.unit_family(F.col("unit"))["family"]
    claim_family = tx.unit_family(F.col("q.composed_unit"))["family"]
    order = F.struct((F.col("dim") != "계").alias("_d"), *_ROW_ORDER)
    ev = stable(ev.withColumn("_same", family == claim_family))
    used = ev.groupBy("claim_id").agg(
        F.max("basis_missing").alias("basis_missing"), F.max("basis_used").alias("basis_used"),
        F.min_by(F.struct("value", "unit", "c1_nm", "c2_nm", "itm_nm", "prd_de"), F.when(F.col("_same"), order)).alias("official"),
        F.count(F.lit(1)).alias("rows_used"))
    needs = ev.groupBy("claim_id").agg(F.max("_same").alias("_has")).where("NOT _has").select("claim_id")
    derived = ev.join(needs, "claim_id", "left_semi").where(claim_family == "percent")
    earlier = tabled.join(derived.select("claim_id").distinct(), "claim_id", "left_semi").withColumn(
        "period", (F.substring("period", 1, 4).cast("int") - 1).cast("string"))
    rates = change_rate(derived, category_evidence(earlier, stats))
    j = parsed.join(tabled.select("claim_id", "tbl_id", "org_id", "tbl_nm", "score"), "claim_id", "left")
    for side in (shares, used, guard_granularity(ev), guard_revision(ev), ratio_age_band(derived), rates):
        j = j.join(side, "claim_id", "left")
    j = guard_base_year(j)
    q, op = F.col("q"), F.col("op")
    official = F.coalesce("share", "official.value", "ratio", F.abs("rate"))
    unit = F.when(F.col("share").isNotNull(), "%").when(F.col("official").isNotNull(), F.col("official.unit")).otherwise("%")
    result = vd.compare(q["value"], q["composed_unit"], q["decimals"], official, unit, op)
    shared = F.col("share").isNotNull()
    refusal = F.coalesce(
        F.col("early"), F.when(shared, F.lit(None)).otherwise(F.coalesce(
            F.when(F.col("tbl_id").isNull(), "no_table"), F.when(F.col("rows_used").isNull(), "no_data"),
            F.when(F.col("basis_missing"), "basis_missing"), F.when(F.col("granularity_mismatch"), "granularity"),
            F.when(F.col("stale"), "revised_after_article"), F.when(F.col("base_year_risk"), "index_base_year"),
            F.when(F.col("official").isNull() & F.col("ratio").isNull() & F.col("rate").isNull(), "unit_mismatch"))))
    yoy = ~shared & F.col("official").isNull() & F.col("ratio").isNull() & F.col("rate").isNotNull()
    derived_used = yoy | (~shared & F.col("official").isNull() & F.col("ratio").isNotNull())
    wrong_way = refusal.isNull() & yoy & (F.col("trend") != F.col("direction"))
    j = j.withColumn("refusal", refusal).withColumn("cmp", result).withColumn("wrong_way", wrong_way)
    label = (F.when(F.col("refusal") == "not_claim", "not_claim").when(F.col("refusal").isNotNull(), "unverifiable")
              .when(F.col("wrong_way"), "mismatch").otherwise(F.col("cmp.label")))
    confidence = (F.when(F.col("refusal").isNotNull(), F.lit(None)).when(F.col("wrong_way"), "medium").when(shared, "medium")
                   .when(derived_used & (F.col("cmp.confidence") == "high"), "medium").otherwise(F.col("cmp.confidence")))
    reason = F.coalesce("refusal", F.when(F.col("wrong_way"), "direction"), "cmp.path")
    decided = F.col("refusal").isNull()
    rule_trail = tx.present(
        (F.col("path").startswith("rule:"), F.regexp_replace("path", "^rule:", "")), (shared & decided, "D1-MULTICULTURAL-MARRIAGE-SHARE"),
        (~shared & F.coalesce("basis_used", F.lit(False)), "A2-0016"), (F.col("refusal") == "granularity", "A2-0015"),
        (F.col("refusal") == "revised_after_article", "A2-0012"), (F.col("refusal") == "index_base_year", "A2-0013"),
        (decided & derived_used & ~yoy, "A2-0007"), (decided & yoy, "A2-0009"), (decided & ~F.col("wrong_way") & ~shared & op.isin("gte", "lte"), "A2-0001"),
        (decided & ~F.col("wrong_way") & derived_used & (F.col("cmp.confidence") == "high"), "A2-0004"))
    return j.select("claim_id", "sentence", "article_date", label.alias("label"), confidence.alias("confidence"), reason.alias("reason"),
                    q["raw"].alias("quantity"), "period", "tbl_id", "org_id", "tbl_nm", F.col("score").alias("match_score"),
                    F.when(decided, official).alias("official_value"), F.when(decided, unit).alias("official_unit"), F.col("official").alias("evidence"),
                    F.when(decided, F.col("cmp.path")).alias("calculation"), rule_trail.alias("rules"))


def audit_rows(verdicts: DataFrame, base_url: str) -> DataFrame:
    """Reproduction record: parameters, rules, the row used and a request URL with a masked key."""
    compact = F.replace("period", F.lit("-"), F.lit(""))
    kind = F.when(F.col("period").contains("Q"), "Q").when(F.length(compact) >= 6, "M").otherwise("Y")
    levels = "".join(f"&objL{i}={'ALL' if i == 1 else ''}" for i in range(1, 9))
    url = F.concat(F.lit(base_url + "?method=getList&apiKey={API_KEY}&itmId=ALL" + levels + "&format=json&jsonVD=Y&prdSe="), kind,
                   F.lit("&orgId="), F.url_encode("org_id"), F.lit("&tblId="), F.url_encode("tbl_id"),
                   F.lit("&startPrdDe="), compact, F.lit("&endPrdDe="), compact)
    return verdicts.where("tbl_id IS NOT NULL").select(
        "claim_id", "tbl_id", "org_id", "tbl_nm", "match_score", kind.alias("prd_se"), F.col("period").alias("prd_de"), "evidence", "rules", url.alias("url"))
