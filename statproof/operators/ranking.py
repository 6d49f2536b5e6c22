"""Table search and ranking: inverted-index joins, fusion, rerank signals and candidate fit.

Search operators take queries(qid, query) and a catalog(ord, doc).  Identical query texts and identical documents are
scored once: only distinct texts meet in the gram join, and of each distinct document only its first k tables can
reach a top-k list, so popular texts add no pairs.  Which pairs meet is decided by the bounds of `search`.
"""
from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window, functions as F

from statproof.functions import lexicon as lx, text as tx
from statproof.functions.scale import anchored_contains, first_per_key, ranked_per_key, stable, top_per_key
from statproof.operators.search import top_candidates

_WORDS = r"([가-힣A-Za-z0-9]+)"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_WORDS), F.lit(1))


def _windows(word: Column, n: int) -> Column:
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))
                  ).otherwise(F.array().cast("array<string>"))


def overlap_grams(c: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(_words(c), lambda w: F.concat(F.array(w), _windows(w, 2)))))


def tfidf_grams(c: Column) -> Column:
    return F.flatten(F.transform(_words(c), lambda w: F.concat(F.array(w), _windows(w, 2), _windows(w, 3))))


def _distinct_texts(df: DataFrame, key: str, text: str, gid: str) -> DataFrame:
    return df.groupBy(F.col(text).alias("text")).agg(F.min(key).alias(gid))


def _expand(scored: DataFrame, queries: DataFrame, catalog: DataFrame, k: int) -> DataFrame:
    """Scores of distinct (text, text) pairs -> top-k tables of every query, ties in catalog order.  Estimates of the sides rest
    on the file size of the catalog, not on its rows, so the joins are sorted rather than broadcast on them."""
    groups = top_per_key(scored, ["qg"], [F.desc("sort_score"), "dg"], k, "_g")
    # the first table of a text names it: no table meets the distinct texts again, whose size an estimate may take for small
    members = top_per_key(catalog.select("ord", F.col("doc").alias("text")), ["text"], ["ord"], k, "_m").select(
        F.min("ord").over(Window.partitionBy("text")).alias("dg"), "ord")
    best = top_per_key(groups.join(members.hint("merge"), "dg"), ["qg"], [F.desc("sort_score"), "ord"], k)
    asked = queries.select("qid", F.col("query").alias("text")).join(_distinct_texts(queries, "qid", "query", "qg").hint("merge"), "text").select("qid", "qg")
    return asked.join(best.select("qg", "ord", "rank", "score").hint("merge"), "qg").select("qid", "rank", "ord", "score")


def search_overlap(queries: DataFrame, catalog: DataFrame, k: int = 3) -> DataFrame:
    """Shared word/bigram count over the root of the union size."""
    def side(df, key, text, gid, w, size):
        grams = _distinct_texts(df, key, text, gid).withColumn("grams", overlap_grams(F.col("text")))
        return grams.select(gid, F.explode("grams").alias("g"), F.lit(1.0).alias(w), F.size("grams").alias(size))
    def score(inter, nq, nd):
        return F.round(inter / F.sqrt(nq + nd - inter), 4)
    pairs = top_candidates(side(queries, "qid", "query", "qg", "wq", "aq"), side(catalog, "ord", "doc", "dg", "wd", "ad"), k, score,
                           lambda rest, nq: F.round(rest / F.sqrt(nq), 4))
    return _expand(pairs.withColumn("score", score(F.col("dot"), F.col("aq"), F.col("ad"))).withColumn("sort_score", F.col("score")), queries, catalog, k)


def search_tfidf(queries: DataFrame, catalog: DataFrame, k: int = 3, keywords: str = "keywords") -> DataFrame:
    """Cosine of word/2-/3-gram TF-IDF vectors; idf is fitted on documents and keyword strings together."""
    corpus = catalog.select(F.array("doc", F.coalesce(keywords, F.lit(""))).alias("t")).select(F.explode("t").alias("t"))
    n = catalog.agg((F.count(F.lit(1)) * 2).alias("n")).scalar()
    df = corpus.groupBy("t").agg(F.count(F.lit(1)).alias("c")).select("c", F.explode(F.array_distinct(tfidf_grams(F.col("t")))).alias("g"))
    idf = stable(df.groupBy("g").agg(F.sum("c").alias("df")).select("g", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf")))

    def vectors(frame, key, text, gid, w, size):
        tf = (_distinct_texts(frame, key, text, gid).select(gid, F.explode(tfidf_grams(F.col("text"))).alias("g"))
              .groupBy(gid, "g").agg(F.count(F.lit(1)).alias("tf"))).join(idf.hint("merge"), "g").withColumn("w", F.col("tf") * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(gid)))
        return tf.select(gid, "g", (F.col("w") / norm).alias(w), F.lit(1).alias(size))
    pairs = top_candidates(vectors(queries, "qid", "query", "qg", "wq", "aq"), vectors(catalog, "ord", "doc", "dg", "wd", "ad"), k,
                           lambda dot, aq, ad: dot, lambda rest, aq: rest)
    # equal vectors can differ in the last bits by summation order; ties are decided on nine decimals
    return _expand(pairs.withColumn("score", F.col("dot")).withColumn("sort_score", F.round("dot", 9)).where("sort_score > 0"), queries, catalog, k)


def search_substring(queries: DataFrame, catalog: DataFrame, k: int = 10) -> DataFrame:
    """Number of (query word, document word) pairs where one contains the other, from a vocabulary-level containment join."""
    def side(df, key, text, gid):
        return _distinct_texts(df, key, text, gid).select(gid, F.explode(F.array_distinct(_words(F.col("text")))).alias("w"))
    q, d = side(queries, "qid", "query", "qg"), side(catalog, "ord", "doc", "dg")
    qw, dw = q.select(F.col("w").alias("qw")).distinct(), d.select(F.col("w").alias("dw")).distinct()
    pairs = (anchored_contains(dw, "dw", qw, "qw").select("qw", "dw")
             .unionByName(anchored_contains(qw, "qw", dw, "dw").select("qw", "dw")).distinct())
    one = F.lit(1)
    asked = q.withColumnRenamed("w", "qw").join(pairs.hint("merge"), "qw").groupBy("qg", F.col("dw").alias("g")).agg(F.count(one).cast("double").alias("wq")).withColumn("aq", one)
    hits = top_candidates(asked, d.select("dg", F.col("w").alias("g"), F.lit(1.0).alias("wd"), one.alias("ad")), k, lambda dot, aq, ad: dot, lambda rest, aq: rest)
    return _expand(hits.withColumn("score", F.round("dot").cast("long")).withColumn("sort_score", F.col("score")), queries, catalog, k)


def rrf(rankings: DataFrame, k: int = 60, top: int = 3) -> DataFrame:
    """Fuse rankings(qid, path_no, rank, ord): each list is cut to `top` first; ties keep first appearance."""
    cut = rankings.where(F.col("rank") <= top)
    fused = cut.groupBy("qid", "ord").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"),
                                          F.min(F.struct("path_no", "rank")).alias("_first"))
    return (top_per_key(fused.withColumn("_s", F.round("score", 12)), ["qid"], [F.desc("_s"), "_first"], top)
            .select("qid", "rank", "ord", "score"))


def union_hits(hits: DataFrame) -> DataFrame:
    """hits(claim_id, term_idx, rank, org_id, tbl_id, ...) -> one row per table, ranked as first seen."""
    first = first_per_key(hits.where(F.coalesce("tbl_id", F.lit("")) != ""), ["claim_id", "org_id", "tbl_id"], ["term_idx", "rank"])
    return ranked_per_key(first.withColumnRenamed("rank", "term_rank"), ["claim_id"], ["term_idx", "term_rank"])


def _year(c: Column) -> Column:
    y = F.substring(F.coalesce(c, F.lit("")), 1, 4)
    return F.when(y.rlike(r"^\d+$"), y)


def covers(period: Column, start: Column, end: Column) -> Column:
    """True / False / null when the claim year or the table range is unknown."""
    y, lo, hi = _year(period), _year(start), _year(end)
    return F.when(y.isNotNull() & lo.isNotNull() & hi.isNotNull(), (lo <= y) & (y <= hi))


def filter_coverage(hits: DataFrame, top: int = 10) -> DataFrame:
    """Drop tables that cannot hold the claim year; the rank score keeps the position before the filter."""
    ok = F.coalesce(covers(F.col("period"), F.col("start_prd"), F.col("end_prd")), F.lit(True))
    scored = hits.withColumn("score", F.round(1.0 / F.col("rank"), 4)).where(ok)
    return top_per_key(scored.withColumnRenamed("rank", "orig_rank"), ["claim_id"], ["orig_rank"], top)


def claim_flags(sentence: Column) -> Column:
    """What the rerank signals ask of a sentence alone: compute it once per claim, before its hits multiply it."""
    return F.struct(sentence.rlike(lx.REGION_CLAIM).alias("region"), sentence.rlike(lx.MONTHLY_CLAIM).alias("monthly"),
                    sentence.rlike(lx.ANNUAL_CLAIM).alias("annual"), sentence.rlike(lx.FORECAST_CLAIM).alias("forecast"),
                    F.array(*[sentence.contains(t) for t in lx.CORE_TERMS]).alias("core"))


def rerank_signals(flags: Column, sentence: Column, period: Column, tbl: Column, survey: Column, path: Column, vw: Column, start: Column, end: Column):
    """[(condition, points, reason)] of every metadata signal."""
    doc = F.concat_ws(" ", tbl, survey, path)
    abroad = (vw == "MT_RTITLE") | path.contains("국제기구별")
    regional = (vw == "MT_GTITLE01") | tbl.contains("(시도") | tbl.contains("시도/시")
    region_claim, monthly, annual = flags["region"], flags["monthly"], flags["annual"]
    monthly_tbl, annual_tbl = tbl.contains("월별"), tbl.contains("연도별") | tbl.contains("연간")
    topic = F.replace(survey, F.lit("조사"), F.lit(""))
    cover = covers(period, start, end)
    projection, forecast = doc.rlike(lx.PROJECTION_TABLE), flags["forecast"]
    axis = F.regexp_extract(tbl, lx.LEADING_AXIS, 1)
    core = [(flags["core"][i] & doc.contains(t), 2.5, f"core_term:{t}") for i, t in enumerate(lx.CORE_TERMS)]
    return core + [
        (abroad, -5.0, "international_table"), (~abroad & (vw == "MT_ZTITLE"), 2.0, "domestic_topic_table"),
        (regional & region_claim, 2.0, "regional_match"), (regional & ~region_claim, -3.0, "regional_table_for_national_claim"),
        (monthly & monthly_tbl, 4.0, "monthly_match"), (monthly & ~monthly_tbl & annual_tbl, -3.0, "annual_table_for_monthly_claim"),
        (~monthly & annual & annual_tbl, 3.0, "annual_match"), (~monthly & annual & ~annual_tbl & monthly_tbl, -1.0, "monthly_table_for_annual_claim"),
        ((topic != "") & sentence.contains(topic), 1.5, "survey_named"),
        (~cover, -4.0, "period_not_covered"), (cover, 1.0, "period_covered"),
        (projection & forecast, 1.0, "projection_match"), (projection & ~forecast, -4.0, "projection_table_for_actual_claim"),
        ((axis != "") & ~tx.contains_any(axis, lx.REGION_AXIS_TOKENS) & ~sentence.contains(axis), -3.0, "unmentioned_axis")]


def rerank(hits: DataFrame) -> DataFrame:
    """Reorder hits(claim_id, rank, sentence, period, tbl_nm, survey, path, vw_cd, start_prd, end_prd) by metadata fit.
    Hits that carry `claim_flags` use them; others get theirs here."""
    c = F.col
    if "claim_flags" not in hits.columns:
        hits = hits.withColumn("claim_flags", F.explode(F.array(claim_flags(c("sentence")))))
    signals = rerank_signals(c("claim_flags"), c("sentence"), c("period"), c("tbl_nm"), c("survey"), c("path"), c("vw_cd"), c("start_prd"), c("end_prd"))
    total = F.lit(0.0)
    for cond, points, _ in signals:
        total = total + F.when(cond, F.lit(points)).otherwise(0.0)
    scored = (hits.withColumn("rerank_score", F.round(total, 2)).withColumn("reasons", tx.present(*[(s[0], s[2]) for s in signals]))
              .withColumnRenamed("rank", "orig_rank"))
    return ranked_per_key(scored, ["claim_id"], [F.desc("rerank_score"), "orig_rank"])


# --- candidate fit ------------------------------------------------------------------------------------------
def _squeeze(c: Column) -> Column:
    return tx.compact(F.lower(c))


def _by_value(value: Column, table: dict, text: Column) -> Column:
    out = F.lit(False)
    for name, tokens in table.items():
        out = F.when(value == name, tx.contains_any(text, tokens)).otherwise(out)
    return out


def item_score(item: Column, profile: Column) -> Column:
    z = _squeeze(item)
    return (F.when((profile["indicator"] != "") & z.contains(_squeeze(profile["indicator"])), 100).otherwise(0)
            + F.when((profile["comparison"] != "") & _by_value(profile["comparison"], lx.TITLE_COMPARISON, z), 10).otherwise(0)
            + F.when(profile["unit"].isin("%", "%p") & item.contains("%"), 2).otherwise(0))


def best_item(items: Column, profile: Column) -> Column:
    """First item with the highest score ('' without items)."""
    scored = F.transform(items, lambda it, i: F.struct(item_score(it, profile).alias("s"), (-i).alias("i"), it.alias("item")))
    return F.coalesce(F.array_max(scored)["item"], F.lit(""))


def candidate_fit(hits: DataFrame) -> DataFrame:
    """Score hits(profile, tbl_nm, survey, items) on the signals the claim actually carries; fit is the share of the
    reachable maximum on a 100-point scale."""
    hits = (hits.withColumn("_title", _squeeze(F.col("tbl_nm"))).withColumn("selected_item", best_item(F.col("items"), F.col("profile")))
            .withColumn("_text", _squeeze(F.concat_ws(" ", F.array("tbl_nm", "survey"), F.col("items"))))
            .withColumn("_official", F.array_join("items", " ")))
    p, title, text, official, item = F.col("profile"), F.col("_title"), F.col("_text"), F.col("_official"), F.col("selected_item")
    asks = [  # (asked, met, points, label)
        (p["indicator"] != "", title.contains(_squeeze(p["indicator"])), 50, F.lit("indicator")),
        (p["period"] != "", _by_value(p["period"], lx.TITLE_PERIOD, title), 20, F.lit("period")),
        (p["unit"].isin("%", "%p"), tx.contains_any(title, lx.TITLE_RATE), 20, F.lit("rate")),
        (p["comparison"] != "", _by_value(p["comparison"], lx.TITLE_COMPARISON, title), 10, F.lit("comparison")),
        ((p["topic"] == "물가") & (F.size(p["qualifiers"]) > 0),
         F.col("tbl_nm").contains("품목별") & F.col("tbl_nm").contains("소비자물가"), 50, F.lit("item_axis"))]
    named = F.filter(p["qualifiers"], lambda q: q != "")
    found = F.filter(named, lambda q: F.col("_text").contains(_squeeze(q)))
    absent = F.filter(named, lambda q: ~F.col("_text").contains(_squeeze(q)))
    places = [(p[f] != "", text.contains(_squeeze(p[f])), 10, F.concat(F.lit(f"{f}:"), p[f])) for f in ("region", "population")]
    score, top = 15 * F.coalesce(F.size(found), F.lit(0)), 15 * F.coalesce(F.size(named), F.lit(0))
    for asked, met, points, _ in [*asks, *places]:
        score = score + F.when(asked & met, points).otherwise(0)
        top = top + F.when(asked, points).otherwise(0)
    item_hit = (item != "") & (p["indicator"] != "") & _squeeze(item).contains(_squeeze(p["indicator"]))
    score, top = score + F.when(item_hit, 20).otherwise(0), top + F.when(item_hit, 20).otherwise(0)
    conflict = ((item != "") & ~item_hit & (((p["indicator"] == "수출액") & _squeeze(item).contains("수출물량"))
                                            | ((p["indicator"] == "수입액") & _squeeze(item).contains("수입물량"))))
    yearly = p["comparison"] == "전년동월비"
    wrong_basis = yearly & official.contains("전월비") & ~official.contains("전년")
    right_basis = yearly & ~wrong_basis & (official.contains("전년비") | official.contains("전년동월비"))
    scored = hits.withColumn("_base", score).withColumn("max_score", (top + F.when(yearly, 20).otherwise(0)).cast("int"))
    deduction = F.least(F.lit(40), F.col("_base"))
    final = F.col("_base") - F.when(wrong_basis, deduction).otherwise(0) + F.when(right_basis, 20).otherwise(0)

    def labels(qualifiers, sign):
        none = F.array().cast("array<string>")
        return F.coalesce(F.transform(qualifiers, lambda q: F.concat(F.lit(sign + "qualifier:"), q)), none)

    def signed(group):
        return tx.present(*[(a & m, F.concat(F.lit(f"+{pts} "), label)) for a, m, pts, label in group])
    return (scored.withColumn("score", final.cast("int"))
            .withColumn("fit_score", F.when(F.col("max_score") <= 0, 0).otherwise(
                F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.col("score") * 100.0 / F.col("max_score"), 0).cast("int")))))
            .withColumn("reasons", F.concat(
                tx.present(*[(a & m, label) for a, m, _, label in asks]), labels(found, ""),
                tx.present(*[(a & m, label) for a, m, _, label in places], (item_hit, "official_item"), (right_basis, "official_basis"))))
            .withColumn("penalties", F.concat(
                tx.present(*[(a & ~m, label) for a, m, _, label in asks]), labels(absent, ""),
                tx.present(*[(a & ~m, label) for a, m, _, label in places], (conflict, "item_conflict"),
                           (wrong_basis, "official_basis_conflict"))))
            .withColumn("score_breakdown", F.concat(
                signed(asks), labels(found, "+15 "), signed(places),
                tx.present((item_hit, "+20 official_item"), (right_basis, "+20 official_basis"),
                           (wrong_basis, F.concat(F.lit("-"), deduction.cast("string"), F.lit(" official_basis"))))))
            .drop("_title", "_text", "_official", "_base"))


def suggest(hits: DataFrame, items: DataFrame, k: int = 3, metadata_limit: int | None = None) -> DataFrame:
    """Top-k candidates per claim.  A caller may restrict the official items to the first `metadata_limit` hits."""
    names = items.groupBy("tbl").agg(F.array_sort(F.collect_set(F.struct("item_no", "item"))).alias("_i"))
    joined = hits.join(names, "tbl", "left")
    known = F.array_distinct(F.transform("_i", lambda x: x["item"]))
    known = known if metadata_limit is None else F.when(F.col("rank") <= metadata_limit, known)
    fit = candidate_fit(joined.withColumn("items", F.coalesce(known, F.array().cast("array<string>"))).drop("_i"))
    return top_per_key(fit.withColumnRenamed("rank", "hit_rank"), ["claim_id"], [F.desc("score"), "hit_rank"], k)


def search_hits(profiles: DataFrame, catalog: DataFrame, qualified_depth: int = 100, plain_depth: int = 10) -> DataFrame:
    """profiles(claim_id, profile) against catalog(ord, doc, org_id, tbl_id, ...) -> claim_id, rank and the columns of the table.

    A profile with qualifiers asks each qualifier and then its indicator, and every table counts where it is seen first;
    one without asks its indicator alone.  A profile without any term has no hits.  All distinct terms search one index."""
    terms = F.array_compact(F.transform(F.concat(F.col("profile.qualifiers"), F.array("profile.indicator")), lambda t: F.nullif(F.trim(t), F.lit(""))))
    asked = profiles.select("claim_id", F.when(F.size("profile.qualifiers") > 0, qualified_depth).otherwise(plain_depth).alias("_depth"),
                            F.posexplode(F.array_distinct(terms)).alias("term_idx", "term"))
    distinct = stable(asked.select(F.col("term").alias("qid"), F.col("term").alias("query")).distinct())
    found = search_overlap(distinct, catalog.select("ord", "doc"), max(qualified_depth, plain_depth)).drop("score")
    hits = (asked.join(found.withColumnRenamed("qid", "term"), "term").where(F.col("rank") <= F.col("_depth"))
            .join(catalog.drop("doc"), "ord").drop("term"))
    return union_hits(hits).where(F.col("rank") <= F.col("_depth")).drop("_depth", "term_idx", "term_rank")


def suggest_for_claims(claims: DataFrame, catalog: DataFrame, items: DataFrame, k: int = 3, metadata_limit: int = 3) -> DataFrame:
    """claims(claim_id, sentence) -> top-k candidates: profile, search, fit and order in one step.

    A profile holds few fixed values, so each distinct one is searched and fitted once and its k candidates are handed to
    its claims.  The official items of the first `metadata_limit` hits are read.  A sentence without indicator and
    qualifier, or a null one, gives no candidate."""
    profiled = claims.select("claim_id", F.explode(F.array(tx.claim_profile(F.coalesce("sentence", F.lit("")).alias("sentence")))).alias("profile"))
    profiled = stable(profiled.where((F.col("profile.indicator") != "") | (F.size("profile.qualifiers") > 0)))
    kinds = profiled.groupBy("profile").agg(F.min("claim_id").alias("claim_id"))
    hits = search_hits(kinds, catalog).join(kinds, "claim_id")
    best = suggest(hits, items, k, metadata_limit).drop("claim_id")
    return profiled.join(best, "profile")


def candidate_log(suggested: DataFrame) -> DataFrame:
    """One nested record per claim, then flattened to log rows (rank order kept)."""
    rec = F.struct("rank", "tbl_id", "score", "fit_score", "selected_item")
    nested = suggested.groupBy("claim_id").agg(F.array_sort(F.collect_list(rec)).alias("candidates"))
    return nested.select("claim_id", F.size("candidates").alias("n_candidates"), F.inline("candidates"))


def match_score(pairs: DataFrame) -> DataFrame:
    """Applicability of an evidence object to a sentence: indicator 40, unit 25, time 20, selection 15."""
    s = F.col("sentence")
    z, ind = tx.compact(s), tx.compact(F.col("indicator"))
    direct = (ind != "") & z.contains(ind)
    meaning = ((ind.contains("전년동월") & tx.contains_any(z, ["지난해같은달", "전년동월", "전년동월대비"]))
               | (ind.contains("전월비") & tx.contains_any(z, ["전월대비", "지난달대비"])))
    unit = F.coalesce(*[F.when(s.contains(u), F.lit(u)) for u in lx.MATCH_UNITS], F.lit(""))
    kind = (F.when(s.rlike(r"\d{4}년"), "연").when(s.rlike(r"\d{1,2}월") | tx.contains_any(s, ["지난달", "이번달"]), "월")
             .when(s.contains("분기"), "분기"))
    chosen = F.filter(F.map_values("selection"), lambda v: (v != "") & ~v.isin("계", "전체"))
    picked = (F.size(chosen) > 0) & F.forall(chosen, lambda v: s.contains(v))
    unit_ok, unit_bad = (unit != "") & (unit == F.col("unit")), (unit != "") & (unit != F.col("unit"))
    time_ok = F.coalesce(kind == F.col("time_dimension"), F.lit(False))
    score = (F.when(direct | meaning, 40).otherwise(0) + F.when(unit_ok, 25).otherwise(0) + F.when(time_ok, 20).otherwise(0)
             + F.when(picked, 15).otherwise(0))
    reasons = tx.present((direct, "indicator_direct"), (~direct & meaning, "indicator_meaning"), (~direct & ~meaning, "indicator_unconfirmed"),
                         (unit_ok, "unit_match"), (unit_bad, "unit_conflict"), (unit == "", "unit_unknown"),
                         (time_ok, "time_match"), (~time_ok, "time_unconfirmed"), (picked, "selection_named"),
                         (~picked & (F.size(chosen) > 0), "selection_unconfirmed"), (F.size(chosen) == 0, "no_selection"))
    return (pairs.withColumn("score", score).withColumn("reasons", reasons)
            .withColumn("status", F.when((F.col("score") >= 80) & ~unit_bad, "high").otherwise("needs_review")))


# --- planning and catalog -----------------------------------------------------------------------------------
def query_plan(claims: DataFrame, counted: str | None = None) -> DataFrame:
    """Distinct search terms with claim count and most frequent domain (domain name breaks ties).  A row stands for one claim,
    or for as many as its column `counted` says."""
    per = claims.where("query <> ''").groupBy("query", "domain").agg((F.sum(counted) if counted else F.count(F.lit(1))).alias("n"))
    return per.groupBy("query").agg(F.sum("n").alias("n_claims"), F.max_by("domain", F.struct("n", "domain")).alias("domain"))


def query_budget(claims: DataFrame, remaining: int, counted: str | None = None) -> DataFrame:
    plan = query_plan(claims, counted)
    return plan.agg(F.count(F.lit(1)).alias("needed"), F.sum("n_claims").alias("claims"),
                    F.round(F.sum("n_claims") / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("claims_per_query"),
                    F.ceil(F.count(F.lit(1)) / F.lit(max(remaining, 1))).alias("batches"))


def expand_catalog(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Tables reachable from the root lists.  edges(parent_id, child_id, is_table); one join per level expands the
    whole frontier until it is empty, and a list named by several parents, or by itself, is expanded once."""
    lists = edges.where(~F.col("is_table")).select("parent_id", "child_id")
    seen = roots.select(F.col("root_id").alias("list_id"), F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in itertools.count(1):
        step = (frontier.join(lists, frontier["list_id"] == lists["parent_id"])
                .select(F.col("child_id").alias("list_id")).distinct().join(seen, "list_id", "left_anti"))
        frontier = stable(step.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    tables = edges.where("is_table").join(seen, F.col("parent_id") == F.col("list_id"))
    return tables.groupBy(F.col("child_id").alias("tbl_id")).agg(
        F.min(F.struct("depth", "list_id")).alias("m")).select("tbl_id", "m.depth", "m.list_id")


def capped_visits(lists: DataFrame, max_calls: int) -> DataFrame:
    """First `max_calls` lists of a breadth-first order are visited in this run, the others stay pending."""
    chosen = lists.orderBy("depth", "list_id").limit(max_calls).select("list_id", F.lit(True).alias("_v"))
    return lists.join(chosen, "list_id", "left").select("list_id", "depth", F.when(F.col("_v"), "visited").otherwise("pending").alias("state"))


def merge_catalog(previous: DataFrame, current: DataFrame, key: str = "tbl_id") -> DataFrame:
    """Snapshot merge by table id, the newer row wins."""
    both = previous.withColumn("_new", F.lit(0)).unionByName(current.withColumn("_new", F.lit(1)))
    return first_per_key(both, [key], [F.desc("_new")]).drop("_new")


def semantic_cards(candidates: DataFrame) -> DataFrame:
    """Draft card per (claim, candidate): seven axes, each inferred or unconfirmed."""
    p = F.col("profile")
    item = F.coalesce(F.nullif("selected_item", F.lit("")), p["indicator"])
    axes = {"topic": p["topic"], "indicator": item, "target_scope": p["population"], "spatial": p["region"], "time": p["period"],
            "unit": p["unit"], "definition_formula": F.lit("")}
    status = F.create_map(*[x for n, v in axes.items() for x in (F.lit(n), F.when(v != "", "inferred").otherwise("unconfirmed"))])
    return candidates.select("claim_id", "tbl_id", "org_id", F.col("tbl_nm").alias("table_name"), *[v.alias(n) for n, v in axes.items()],
                             status.alias("field_status"), F.round(F.col("fit_score") / 100, 2).alias("semantic_confidence"))


def card_summary(cards: DataFrame, current: DataFrame, reused: DataFrame, pending: DataFrame) -> DataFrame:
    """Catalog growth counts; the id sets meet in one flag aggregation instead of driver-side sets."""
    def flagged(df, name):
        return df.select(F.trim("tbl_id").alias("tbl_id")).distinct().withColumn(name, F.lit(True))
    f = (flagged(cards, "c").join(flagged(current, "u"), "tbl_id", "full").join(flagged(reused, "r"), "tbl_id", "full"))
    n = pending.agg(F.count(F.lit(1)).alias("n")).scalar()
    return f.agg(F.count_if(F.col("c") & (F.col("tbl_id") != "")).alias("catalog_card_count"),
                 F.count_if(F.col("u") & F.col("r").isNull()).alias("current_run_new_card_count"),
                 F.count_if(F.col("u") & F.col("r")).alias("current_run_reused_card_count")).withColumn("pending_card_count", n)
