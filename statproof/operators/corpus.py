"""Corpus preparation: from raw article rows to clean, unique, split and identified text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from statproof.functions import text as tx
from statproof.functions.scale import first_per_key, stored, with_row_number

MAX_RANGE = 1000
SECRET_PATTERNS = [  # fixed values
    ("credential_assignment", r"""(?i)(api[_-]?key|secret|token|password)\s*[:=]\s*['"][A-Za-z0-9_\-]{16,}"""),
    ("cloud_key", r"nv-[A-Za-z0-9]{20,}"),
]
_META_NAME_FIRST = r"""(?i)<meta\s+(?:name|property)=["'](?:description|og:description)["']\s+content=["']([^"']+)["']"""
_META_CONTENT_FIRST = r"""(?i)<meta\s+content=["']([^"']+)["']\s+(?:name|property)=["'](?:description|og:description)["']"""


def row_range(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Rows start..end (1-based, inclusive) in key order; a range may span at most 1,000 rows."""
    if start < 1 or end < start or end - start + 1 > MAX_RANGE:
        raise ValueError("the range must be 1 to 1,000 consecutive rows")
    return with_row_number(df, key).where(F.col("row_number").between(start, end))


def selected_rows(df: DataFrame, key: str, start: int | None = None, end: int | None = None, confirmed: bool = False) -> DataFrame:
    """The rows of one analysis, numbered: a table of at most 1,000 rows whole, whatever range is asked for; of a larger one
    nothing before the range is confirmed, then rows start..end, which must lie inside it."""
    total = df.agg(F.count(F.lit(1))).first()[0]
    if total <= MAX_RANGE:
        return with_row_number(df, key)
    if not confirmed:
        return with_row_number(df.where("false"), key)
    if start is None or end is None or end > total:
        raise ValueError("choose a range of rows of the table")
    return row_range(df, key, start, end)


def strip_chrome(df: DataFrame) -> DataFrame:
    return df.withColumn("anchored", tx.anchored(F.col("body"))).withColumn("body", tx.strip_chrome(F.col("body")))


def clean_body(df: DataFrame) -> DataFrame:
    return df.withColumn("body", tx.clean_body(F.col("body")))


def derive_section(df: DataFrame) -> DataFrame:
    return df.withColumn("section", F.coalesce(F.nullif(F.col("section"), F.lit("")), tx.section_from_url(F.col("url"))))


def dedupe_articles(df: DataFrame) -> DataFrame:
    """Rows with text, first row per URL.  A row without URL is its own key, so the empty URL is never a hot group."""
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("row:"), F.col("row_no").cast("string")))
    kept = first_per_key(df.where(F.col("body") != "").withColumn("_key", key), ["_key"], ["row_no"])
    return kept.drop("_key")


def article_key() -> Column:
    """What identifies an article: its URL, else title and date.  `article_id` is a short hash of it for display;
    deduplication compares the key itself, because different articles can share a short hash."""
    return F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.concat(F.trim("title"), F.lit("|"), F.trim("date")))


def with_article_id(df: DataFrame) -> DataFrame:
    return df.withColumn("article_id", F.concat(F.lit("art_"), F.substring(F.sha1(article_key()), 1, 12)))


def with_claim_id(df: DataFrame) -> DataFrame:
    key = F.concat("article_id", F.lit("|"), "sentence")
    return df.withColumn("claim_id", F.concat(F.lit("clm_"), F.substring(F.sha1(key), 1, 16)))


def usable_bodies(raw: DataFrame) -> DataFrame:
    """Cleaned rows that still hold text.  Exploding a zero-or-one element array cleans each body exactly once; a
    plain filter would be pushed below the cleaning and run it a second time."""
    clean = tx.clean_body(tx.strip_chrome(F.col("body")))
    return raw.withColumn("anchored", tx.anchored(F.col("body"))).withColumn(
        "body", F.explode(F.filter(F.array(clean), lambda b: b != "")))


def prepare_articles(raw: DataFrame) -> DataFrame:
    """Raw rows -> cleaned, unique articles with section and id."""
    return with_article_id(derive_section(dedupe_articles(usable_bodies(raw))))


def split_sentences(df: DataFrame) -> DataFrame:
    """One row per sentence with its 0-based index; every other column is kept except the body."""
    keep = [c for c in df.columns if c != "body"]
    return df.select(*keep, F.posexplode(tx.sentence_array(F.col("body"))).alias("sentence_idx", "sentence"))


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is new, one per key; existing rows stay untouched."""
    unique = first_per_key(incoming, [key], sorted(c for c in incoming.columns if c != key)[:1] or [key])
    return unique.join(existing.select(key), key, "left_anti")


def insert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    keys = incoming.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = existing.select(key).distinct().withColumn("_known", F.lit(True))
    return keys.join(known, key, "left").agg(
        F.sum("n").cast("long").alias("seen"), F.count_if(F.col("_known").isNull()).alias("inserted"),
        (F.sum("n") - F.count_if(F.col("_known").isNull())).cast("long").alias("ignored"))


def candidate_sentences(articles: DataFrame, rules=()) -> DataFrame:
    """Sentences of prepared articles with detection result and source label."""
    s = F.col("sentence")
    return (split_sentences(articles).withColumn("candidate", tx.is_candidate(s, rules))
            .withColumn("source", F.when(F.col("candidate"), tx.source_label(s))))


def ingest_report(raw: DataFrame, existing_ids: DataFrame) -> DataFrame:
    """(metric, value) rows of one import: article funnel, sentence funnel, queue, routes, source types.

    The article funnel never carries bodies through a shuffle: duplicates are counted on (url, row) pairs."""
    prepared = prepare_articles(raw)
    source = raw.agg(F.count(F.lit(1)).alias("source_rows"))
    known = existing_ids.select("article_id").distinct().withColumn("_known", F.lit(1))
    per_id = (prepared.groupBy("article_id", article_key().alias("_key")).agg(F.count(F.lit(1)).alias("n"))
              .join(known, "article_id", "left"))
    read = per_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("read"), F.count_if(F.col("_known").isNull()).alias("imported"))
    cand = candidate_sentences(prepared)
    # claims are keyed by (article, sentence): a repeated sentence of one article is queued once
    claims = cand.groupBy("article_id", "sentence").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("candidate").alias("candidate"), F.any_value("source").alias("source"))
    funnel = claims.agg(F.sum("n").alias("sentences"), F.sum(F.when(F.col("candidate"), F.col("n")).otherwise(0)).alias("candidates"),
                        F.count_if(F.col("source.route") == "KOSIS_RETRIEVAL").alias("queued"),
                        F.count_if(F.col("candidate") & (F.col("source.route") != "KOSIS_RETRIEVAL")).alias("classified"))

    def long(df, *names):
        return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value"))
                                             for n in names])).alias("m")).select("m.*")
    parts = (long(source, "source_rows").unionByName(long(read, "read", "imported"))
             .unionByName(long(funnel, "sentences", "candidates", "queued", "classified")))
    total = parts.agg(*[F.sum(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in
                        ("source_rows", "read", "imported", "sentences", "candidates", "queued", "classified")])
    total = (total.withColumn("discarded_articles", F.col("source_rows") - F.col("read"))
             .withColumn("duplicates", F.col("read") - F.col("imported")))
    tagged = claims.where("candidate").select(F.explode(F.array(
        F.concat(F.lit("route:"), "source.route"), F.concat(F.lit("source_type:"), "source.source_type"))).alias("metric"))
    return long(total, *total.columns).unionByName(tagged.groupBy("metric").agg(F.count(F.lit(1)).alias("value")))


def import_previews(raw: DataFrame) -> DataFrame:
    """Retrieval-routed candidates, newest article first, unreadable dates last.  They are stored before the sort, which
    reads its input twice: once for the bounds of its ranges."""
    cand = candidate_sentences(prepare_articles(raw)).where(F.col("source.route") == "KOSIS_RETRIEVAL")
    s = F.col("sentence")
    found = cand.select("article_id", "title", "date", "sentence_idx", "sentence", "source.source_type", tx.period(s, F.col("date")).alias("period"),
                        F.array_join(F.transform(tx.quantities(s), lambda q: q["raw"]), " · ").alias("quantity_display"))
    return (stored(found, "previews")
            .orderBy(tx.article_day(F.col("date")).desc_nulls_last(), "article_id", "sentence_idx"))


def secret_scan(docs: DataFrame, key: str, text: str, patterns=SECRET_PATTERNS) -> DataFrame:
    """(key, pattern_id, hits) for every secret-like pattern found; one regex pass per pattern, no join."""
    found = F.array(*[F.struct(F.lit(n).alias("pattern_id"), F.regexp_count(F.col(text), F.lit(p)).cast("long").alias("hits"))
                      for n, p in patterns])
    return docs.select(key, F.explode(found).alias("f")).where("f.hits > 0").select(key, "f.*")


def _normal_sentences(text: str):
    parts = F.transform(F.split(F.lower(F.col(text)), r"[.!?\n]+"), lambda p: tx.strip(F.regexp_replace(p, r"\s+", " ")))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 20))


def contamination(docs: DataFrame, doc_key: str, gold: DataFrame, gold_key: str, text: str = "text") -> DataFrame:
    """Gold items whose sentences occur in a document: (doc, item, shared sentences, share of the item).

    Equi-join on the sentence hash, confirmed on the text; sentences are unique per side before the shuffle."""
    def side(df, key):
        return df.select(key, F.explode(_normal_sentences(text)).alias("s")).withColumn("h", F.xxhash64("s"))
    g = side(gold, gold_key)
    sizes = gold.select(gold_key, F.size(_normal_sentences(text)).alias("n_item"))
    hits = side(docs, doc_key).join(g, ["h", "s"]).groupBy(doc_key, gold_key).agg(F.count(F.lit(1)).alias("shared"))
    return hits.join(sizes, gold_key).select(doc_key, gold_key, "shared", F.round(F.col("shared") / F.col("n_item"), 4).alias("item_share"))


@pandas_udf(StringType())
def _unescape(s):  # entity tables exist only in Python; runs on the short extracted description alone
    import html
    return s.map(lambda v: html.unescape(v) if v is not None else None)


def page_definitions(pages: DataFrame, hosts: list[str]) -> DataFrame:
    """Explicit description of each https page on an allowed host; never inferred from page text."""
    host = F.lower(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")))
    allowed = F.lit(False)
    for h in hosts:
        allowed = allowed | (host == h) | host.endswith("." + h)
    first, second = F.regexp_extract("html", _META_NAME_FIRST, 1), F.regexp_extract("html", _META_CONTENT_FIRST, 1)
    found = (pages.where(F.col("url").startswith("https://") & allowed)
             .select("page_id", "url", F.when(first != "", first).otherwise(second).alias("d")).where("d <> ''"))
    text = tx.strip(F.regexp_replace(F.regexp_replace(_unescape("d"), r"<[^>]+>", " "), r"\s+", " "))
    return found.select("page_id", "url", text.alias("definition"), F.lit("meta_description").alias("method")).where("definition <> ''")
