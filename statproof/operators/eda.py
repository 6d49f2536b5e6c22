"""Corpus EDA: row quality, duplicates, sentence profile, structure statistics and their views."""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from statproof.functions import lexicon as lx, text as tx
from statproof.functions.scale import stable, stored, value_positions
from statproof.operators.extraction import _rule_label

ARTICLE_END = r"(?s)(?:관련 기사|기자 프로필|기자 약력|구독).*$"
ISSUE_ORDER = ["missing_title", "missing_date", "invalid_date", "missing_body", "empty_after_cleaning", "duplicate", "row_error"]
QUANTITY_TYPES = ["percentage", "money", "people_household", "count_rank", "other"]
PERIOD_CLASSES = ["past", "current", "forecast", "unknown"]
WARNINGS = ["missing_title", "missing_date", "invalid_date"]


@pandas_udf(StringType())
def _nfkc(s):  # Unicode compatibility folding has no SQL function
    return s.map(lambda v: unicodedata.normalize("NFKC", v) if v is not None else None)


# Starters that NFKC leaves alone and that never join the character before them: a text of these only is its own folding.
FOLDED = r"\x00-\x7F\u00A1\u00A7\u00A9\u00AB\u00B0\u00B7\u00BB\u00BF\u00C0-\u00FF\u2013\u2014\u2018\u2019\u201C\u201D\u4E00-\u9FFF\uAC00-\uD7A3"


def _fold(c: Column, wanted: Column) -> Column:
    """NFKC of the wanted values (the others are not used); only texts with a character it may change go to Python."""
    return F.coalesce(_nfkc(F.when(wanted & c.rlike(f"[^{FOLDED}]"), c)), c)


def _squeeze(c: Column) -> Column:
    return tx.strip(F.regexp_replace(c, r"\s+", " "))


def _day(c: Column) -> Column:
    p = r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
    return F.when(c.rlike(p), F.try_to_date(F.concat_ws("-", *[F.regexp_extract(c, p, i) for i in (1, 2, 3)]), "yyyy-M-d"))


def quality_rows(raw: DataFrame) -> DataFrame:
    """Warnings and at most one exclusion per row.  A duplicate is a later row with the same URL, or without URL the
    same title/body fingerprint; the first row per key is a mergeable minimum, so no key is ever sorted in one task."""
    t = F.trim("title")
    clean = tx.clean_body(tx.strip(F.regexp_replace(tx.strip_chrome(F.col("body")), ARTICLE_END, "")))
    r = raw.withColumn("_c", F.explode(F.array(F.struct(clean.alias("clean"), (tx.strip(F.coalesce("body", F.lit(""))) == "").alias("blank")))))
    r = r.select("row_no", "title", "date", "url", F.length(F.coalesce("body", F.lit(""))).alias("raw_length"), "_c.clean", "_c.blank")
    bare = F.coalesce(F.col("url"), F.lit("")) == ""
    r = r.withColumn("_title", _fold(F.col("title"), bare)).withColumn("_text", _fold(F.col("clean"), bare))
    folded = F.sha2(F.concat(F.lower(_squeeze(F.col("_title"))), F.lit("\x00"), _squeeze(F.col("_text"))), 256)
    usable = ~F.col("blank") & (F.col("clean") != "")
    # stored: the cleaning runs once, though first rows and rows are read apart here and the rows again by every view
    keyed = stored(r.withColumn("_key", F.when(bare, F.concat(F.lit("f:"), folded)).otherwise(F.concat(F.lit("u:"), F.col("url")))).drop("_title", "_text"), "quality-rows")
    first = keyed.where(usable).groupBy("_key").agg(F.min("row_no").alias("_first"))
    j = keyed.join(first, "_key", "left")
    exclusion = (F.when(F.col("blank"), "missing_body").when(F.col("clean") == "", "empty_after_cleaning").when(F.col("_first") < F.col("row_no"), "duplicate"))
    warn = tx.present((F.trim("title") == "", "missing_title"), (F.trim("date") == "", "missing_date"), ((F.trim("date") != "") & _day(F.col("date")).isNull(), "invalid_date"))
    return (j.withColumn("exclusion", exclusion).withColumn("warnings", warn).withColumn("clean_length", F.length("clean"))
            .withColumn("removed_length", F.greatest(F.lit(0), F.col("raw_length") - F.col("clean_length"))).drop("_key", "_first", "blank"))


def quality_issues(rows: DataFrame) -> DataFrame:
    codes = F.array_compact(F.concat(F.array("exclusion"), F.col("warnings")))
    return (rows.withColumn("codes", codes).where(F.size("codes") > 0)
            .select("row_no", F.when(F.col("exclusion").isNotNull(), "excluded").otherwise("warning").alias("severity"), F.get("codes", F.lit(0)).alias("code"), "title", "codes"))


def issue_counts(rows: DataFrame) -> DataFrame:
    code = F.explode(F.array_compact(F.concat(F.array("exclusion"), F.col("warnings"))))
    return rows.select(code.alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def valid_articles(rows: DataFrame) -> DataFrame:
    return rows.where("exclusion IS NULL")


def period_class(period: Column, claim_type: Column, day: Column) -> Column:
    year = F.substring(period, 1, 4).try_cast("int")
    month, quarter = F.regexp_extract(period, r"^\d{4}-(\d{2})$", 1).try_cast("int"), F.regexp_extract(period, r"^\d{4}-Q([1-4])$", 1).try_cast("int")
    marker = F.coalesce(month, quarter * 3, F.lit(0))
    ok = period.rlike(r"^\d{4}$") | month.between(1, 12) | quarter.isNotNull()
    same_quarter = quarter.isNotNull() & (F.quarter(day) == quarter)
    return (F.when(claim_type == "전망형", "forecast").when((period == "") | day.isNull() | ~F.coalesce(ok, F.lit(False)), "unknown")
             .when(year < F.year(day), "past").when(year > F.year(day), "forecast").when(marker == 0, "current").when(marker < F.month(day), "past")
             .when((marker == F.month(day)) | same_quarter, "current").otherwise("forecast"))


def profile_sentences(articles: DataFrame) -> DataFrame:
    """Every sentence of the valid articles with quantities, numeric flag, period class, type, route and rule."""
    s = articles.select("row_no", "date", F.posexplode(tx.sentence_array(F.col("clean"))).alias("sentence_idx", "sentence"))
    day = _day(F.col("date"))
    raw = F.struct(tx.quantities(F.col("sentence")).alias("quantities"), tx.has_number(F.col("sentence")).alias("number"), tx.source_label(F.col("sentence")).alias("source"), _rule_label().alias("rule"),
                   F.when(day.isNotNull(), tx.period(F.col("sentence"), F.date_format(day, "yyyy-MM-dd"))).otherwise("").alias("period"))
    p = s.withColumn("p", F.explode(F.array(raw))).select("row_no", "date", "sentence_idx", "sentence", "p.*")
    return (p.withColumn("candidate", F.col("rule").isin("NUMERIC_UNIT", "NUMERIC_TREND", "SUPERLATIVE"))
            .withColumn("numeric", F.col("number") & ~F.col("sentence").rlike(lx.NOISE_ONLY) & ~F.col("sentence").rlike(lx.SITE_CHROME))
            .withColumn("period_class", period_class(F.col("period"), F.col("source.claim_type"), day)).drop("number"))


def quantity_type(unit: Column) -> Column:
    return (F.when(unit.isin("%", "%p", "퍼센트", "포인트"), "percentage").when(unit == "원", "money").when(unit.isin("명", "인", "가구", "세대"), "people_household")
             .when(unit.isin("건", "개", "배", "위", "호"), "count_rank").otherwise("other"))


def structure_stats(df: DataFrame, value: str) -> DataFrame:
    """min, max, mean, interpolated median, nearest-rank quartiles and outlier bounds (four rows or more)."""
    v = F.col(value)
    a = df.agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.avg(v).alias("mean"))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("lo") <= position) & (position < F.col("hi")), F.col("value")).cast("double"))
    total = F.col("total")
    places = value_positions(df, value).agg(F.struct(
        ((at(F.floor((total - 1) / 2)) + at(F.ceil((total - 1) / 2))) / 2).alias("median"),
        at(F.ceil(total * 0.25) - 1).alias("q1"), at(F.ceil(total * 0.75) - 1).alias("q3")).alias("q")).scalar()
    a = a.withColumn("_q", places).select("*", "_q.*").drop("_q")
    iqr = F.col("q3") - F.col("q1")
    return (a.withColumn("low", F.when(F.col("n") >= 4, F.col("q1") - 1.5 * iqr)).withColumn("high", F.when(F.col("n") >= 4, F.col("q3") + 1.5 * iqr)))


def outliers(df: DataFrame, value: str) -> DataFrame:
    s = structure_stats(df, value)
    return df.where((F.col(value) < s.select("low").scalar()) | (F.col(value) > s.select("high").scalar()))


def eda_counts(profile: DataFrame) -> DataFrame:
    """(kind, key, n): totals over sentences, quantity types over all of them, classes over the candidates."""
    c, num = F.col("candidate"), F.col("numeric")
    names = [("total_sentences", F.lit(True)), ("numeric_sentences", num), ("candidates", c), ("numeric_candidates", c & num),
             ("nonnumeric_candidates", c & ~num), ("retrieval_candidates", c & (F.col("source.route") == "KOSIS_RETRIEVAL"))]
    # One pass over the sentences: its groups are few, and the totals are read out of them.
    tags = F.concat(F.array_compact(F.array(*[F.when(x, F.struct(F.lit("total").alias("kind"), F.lit(n).alias("key"))) for n, x in names])), F.transform("quantities", lambda q: F.struct(F.lit("quantity").alias("kind"), quantity_type(q["unit"]).alias("key"))),
                    F.when(c, F.array(F.struct(F.lit("period").alias("kind"), F.col("period_class").alias("key")), F.struct(F.lit("claim_type").alias("kind"), F.col("source.claim_type").alias("key")),
                                      F.struct(F.lit("route").alias("kind"), F.col("source.route").alias("key")))).otherwise(F.array().cast("array<struct<kind:string,key:string>>")))
    found = stable(profile.select(F.explode(tags).alias("t")).select("t.*").groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")))
    totals = found.agg(*[F.coalesce(F.sum(F.when((F.col("kind") == "total") & (F.col("key") == n), F.col("n"))), F.lit(0)).alias(n) for n, _ in names])
    long = totals.select(F.explode(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(n).alias("key"), F.col(n).alias("n")) for n, _ in names])).alias("t")).select("t.*")
    return long.unionByName(found.where("kind <> 'total'"))


def histogram(df: DataFrame, value: str, limit: int = 10) -> DataFrame:
    """At most ten integer bins by the square-root rule; empty bins are kept."""
    v = F.col(value)
    a = df.agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).where("n > 0")
    span = F.col("hi") - F.col("lo") + 1
    bins = F.least(F.lit(limit), span, F.ceil(F.sqrt("n")))
    a = a.withColumn("width", F.greatest(F.lit(1), F.ceil(span / bins)).cast("long")).withColumn("bins", F.ceil(span / F.col("width")).cast("int"))
    lo, width = a.select("lo").scalar(), a.select("width").scalar()
    counts = df.groupBy(F.floor((v - lo) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = a.select(F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"), "lo", "hi", "width")
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).cast("long").alias("start"),
                                                   F.least(F.col("hi"), F.col("lo") + (F.col("bin") + 1) * F.col("width") - 1).cast("long").alias("end"), F.coalesce("n", F.lit(0)).alias("n"))


def issue_view(rows: DataFrame) -> DataFrame:
    order = F.lit(len(ISSUE_ORDER))
    for i, c in enumerate(ISSUE_ORDER):
        order = F.when(F.col("code") == c, i).otherwise(order)
    return issue_counts(rows).withColumn("position", order).orderBy("position", "code")


def problem_rows(rows: DataFrame, limit: int = 100) -> DataFrame:
    """First problem rows of the report with the total and a truncation flag."""
    issues = quality_issues(rows)
    total = issues.agg(F.count(F.lit(1)).alias("n")).scalar()
    return issues.orderBy("row_no", "code").limit(limit).select("row_no", "code", "title").withColumn("total", total).withColumn("truncated", F.col("total") > limit)


def kpi_view(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Quality KPIs, sentence KPIs and zero-filled category rows as (group, key, value)."""
    q = rows.agg(F.count(F.lit(1)).alias("source_rows"), F.count_if(F.col("exclusion").isNull()).alias("valid_articles"), F.count("exclusion").alias("excluded_articles"),
                 F.count_if(F.col("exclusion").isNull() & (F.size("warnings") > 0)).alias("warning_articles"))
    quality = q.select(F.explode(F.array(*[F.struct(F.lit("quality").alias("grp"), F.lit(c).alias("key"), F.col(c).alias("value")) for c in q.columns])).alias("x")).select("x.*")
    counts = eda_counts(profile)
    claims = counts.where("kind = 'total'").select(F.lit("claims").alias("grp"), "key", F.col("n").alias("value"))
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("key")) for k, cs in (("quantity", QUANTITY_TYPES), ("period", PERIOD_CLASSES)) for c in cs])
    found = counts.where("kind IN ('quantity', 'period')").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "kind", "key"), "n"))).alias("m"))
    cats = found.select(F.explode(wanted).alias("w"), "m").select(F.col("w.kind").alias("grp"), "w.key", F.coalesce(F.try_element_at("m", F.concat_ws(":", "w.kind", "w.key")), F.lit(0)).alias("value"))
    return quality.unionByName(claims).unionByName(cats)


def filter_articles(rows: DataFrame, profile: DataFrame, quality: str = "all", band: str = "all", min_candidates: int = 0, max_candidates: int | None = None) -> DataFrame:
    """Valid articles by quality, body-length band (nearest-rank quartiles) and candidate count."""
    art = valid_articles(rows)
    per = profile.groupBy("row_no").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("candidate").alias("n_candidates"))
    a = stable(art.join(per, "row_no", "left").na.fill(0, ["n_sentences", "n_candidates"]))  # read several times below
    # One row each, cut off from its plan: a scalar that holds another scalar cannot be resolved inside a filter.
    sb, ss = stable(structure_stats(a, "clean_length")), stable(structure_stats(a, "n_sentences"))
    out = ((F.col("clean_length") < sb.select("low").scalar()) | (F.col("clean_length") > sb.select("high").scalar())
           | (F.col("n_sentences") < ss.select("low").scalar()) | (F.col("n_sentences") > ss.select("high").scalar()))
    warned = F.size("warnings") > 0
    keep = {"all": F.lit(True), "warnings": warned, "outliers": out, "clean": ~warned & ~out}[quality]
    q1, q3 = sb.select("q1").scalar(), sb.select("q3").scalar()
    length = F.col("clean_length")
    fits = {"all": F.lit(True), "short": length <= q1, "typical": (length > q1) & (length <= q3), "long": length > q3}[band]
    ranged = (F.col("n_candidates") >= min_candidates) & (F.lit(True) if max_candidates is None else F.col("n_candidates") <= max_candidates)
    return a.where(keep & fits & ranged)
