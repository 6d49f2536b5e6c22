"""Registered queries A01-A15 with their DuckDB oracles."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statproof.functions import text as tx
from statproof.functions.scale import shared_folder
from statproof.operators import corpus as op
from statproof.plans import oracle_parts as o
from statproof.plans.fixtures import Tables, with_clause
from statproof.sources import articles as src


def a01(spark, d):
    n = Tables(spark, d).news
    korean = n.select("row_no", F.nullif("title", F.lit("")).alias("제목"), F.col("title").alias("기사 제목"), F.col("date").alias("작성일"),
                      "section", F.col("url").alias("URL"), F.col("body").alias("본문"), F.col("label").alias("레이블"))
    out = src.resolve_headers(korean)
    return out.select("row_no", "title", "date", "section", "url", F.length("body").alias("body_len"), "label")


def a01_files(spark, d):
    """The same articles through both file formats and back."""
    out = None
    for kind in ("csv", "jsonl"):
        path = f"{shared_folder(spark)}/articles-{uuid.uuid4().hex}.{kind}"
        rows = Tables(spark, d).news.select(F.col("title").alias("제목"), F.col("date").alias("작성일"), F.col("url").alias("URL"), F.col("body").alias("본문"))
        (rows.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False) if kind == "csv" else rows.write.json(path))
        got = src.read_articles(spark, path).select(F.lit(kind).alias("kind"), "title", "date", "url", F.md5("body").alias("h"))
        out = got if out is None else out.unionByName(got)
    return out.groupBy("kind", "title", "date", "url", "h").agg(F.count(F.lit(1)).alias("n"))


def a01_splits(spark, d):
    """Articles whose bodies hold quotes and line breaks, written as CSV and cut at true record ends in every split."""
    path = f"{shared_folder(spark)}/articles-{uuid.uuid4().hex}.csv"
    body = F.concat("body", F.lit('\n"'), "title", F.lit('"\r\n, '), "date")
    rows = Tables(spark, d).news.select(F.col("title").alias("제목"), F.col("date").alias("작성일"), F.col("url").alias("URL"), body.alias("본문"))
    rows.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = src.read_articles(spark, path, "csv_splits").select("title", "date", "url", F.md5("body").alias("h"))
    return got.groupBy("title", "date", "url", "h").agg(F.count(F.lit(1)).alias("n"))


def a02(spark, d):
    rows = op.row_range(Tables(spark, d).news, "row_no", 101, 700)
    return rows.select(F.col("row_number").cast("long").alias("row_number"), "row_no", "title")


def a02_selected(spark, d):
    """A table of at most 1,000 rows is taken whole; a larger one gives the confirmed range."""
    rows = op.selected_rows(Tables(spark, d).news, "row_no", 101, 700, confirmed=True)
    return rows.select(F.col("row_number").cast("long").alias("row_number"), "row_no", "title")


def a03(spark, d):
    return op.strip_chrome(Tables(spark, d).news).select("row_no", "anchored", F.length("body").alias("n"), F.md5("body").alias("h"))


def a04(spark, d):
    out = op.clean_body(op.strip_chrome(Tables(spark, d).news))
    return out.select("row_no", F.length("body").alias("n"), F.md5("body").alias("h"))


def a05(spark, d):
    return op.derive_section(Tables(spark, d).news).select("row_no", "section")


def a06(spark, d):
    n = op.derive_section(op.clean_body(op.strip_chrome(Tables(spark, d).news)))
    return op.dedupe_articles(n).select("row_no", "url", "section")


def a07(spark, d):
    arts = op.prepare_articles(Tables(spark, d).news)
    s = op.with_claim_id(op.split_sentences(arts))
    return s.select("row_no", "article_id", "sentence_idx", "claim_id")


def a08(spark, d):
    return op.split_sentences(op.prepare_articles(Tables(spark, d).news)).select("row_no", "sentence_idx", F.md5("sentence").alias("h"))


def a09(spark, d):
    t = Tables(spark, d)
    new = op.insert_new(t.payload_a, t.payload_b, "k")
    return new.select("k", "payload")


def a09_counts(spark, d):
    t = Tables(spark, d)
    return op.insert_counts(t.payload_a, t.payload_b, "k")


def _known(t):
    ids = op.prepare_articles(t.news)
    return ids.where(F.col("row_no") % 4 == 1).select("article_id")


def a10(spark, d):
    t = Tables(spark, d)
    return op.ingest_report(t.news, _known(t))


def a10_previews(spark, d):
    return op.import_previews(Tables(spark, d).news).select("article_id", "title", "date", "sentence_idx", "source_type", "period", "quantity_display")


def a11(spark, d):
    return op.secret_scan(Tables(spark, d).documents, "doc_id", "text")


def a12(spark, d):
    t = Tables(spark, d)
    return op.contamination(t.documents, "doc_id", t.benchmark, "item_id")


def a13(spark, d):
    return src.spreadsheet_safe(Tables(spark, d).risky_cells)


def a14(spark, d):
    t = Tables(spark, d)
    runs = t.detector_rows.select("run_id", "doc_id", "lang", "review")
    return src.export_size(src.spreadsheet_safe(runs), 50_000, 50 * 1024 * 1024)


def a14_rows(spark, d):
    runs = Tables(spark, d).detector_rows.select("run_id", "doc_id", "lang", F.concat(F.lit("="), "review").alias("review"))
    return src.export_parts(runs, "doc_id", [F.desc("run_id"), "doc_id"]).select(*runs.columns)


HOSTS = ["example.com", "example.org"]


def a15(spark, d):
    return op.page_definitions(Tables(spark, d).described_pages, HOSTS).select("page_id", "definition", "method")


QUERIES = {
    "a01_article_scan": a01, "a01_article_files": a01_files, "a01_article_splits": a01_splits, "a02_row_range": a02, "a02_selected_rows": a02_selected, "a03_strip_chrome": a03, "a04_clean_body": a04, "a05_derive_section": a05,
    "a06_dedupe_articles": a06, "a07_content_ids": a07, "a08_split_sentences": a08, "a09_insert_new": a09,
    "a09_insert_counts": a09_counts, "a10_ingest_report": a10, "a10_import_previews": a10_previews, "a11_secret_scan": a11,
    "a12_contamination": a12, "a13_safe_csv": a13, "a14_bounded_export": a14, "a14_export_rows": a14_rows, "a15_page_definitions": a15,
}

_A = o.ARTICLES
_CAND = _A + f""", o_cand0 AS (SELECT *, {o.candidate('sentence')} AS candidate FROM o_sents), {o.source_cte('o_cand0', 'o_src')}"""
_SECRET = "".join(f"""{' UNION ALL ' if i else ''}SELECT doc_id, {o.q(n)} AS pattern_id, CAST(len(regexp_extract_all(text, {o.q(p)})) AS BIGINT) AS hits
 FROM documents WHERE regexp_matches(text, {o.q(p)})""" for i, (n, p) in enumerate(op.SECRET_PATTERNS))
_NORM = (r"list_distinct(list_filter(list_transform(string_split(regexp_replace(lower(text), '[.!?\n]+', chr(1), 'g'), chr(1)), "
         r"lambda p: regexp_replace(regexp_replace(p, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda p: length(p) >= 20))")
_HOST = r"lower(regexp_extract(url, '^https://([^/:?#]+)', 1))"
_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(c, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"""

ORACLE = {
    "a01_article_files": with_clause("news") + " SELECT kind, trim(coalesce(title, '')) AS title, trim(coalesce(date, '')) AS date, trim(coalesce(url, '')) AS url, md5(coalesce(body, '')) AS h, count(*) AS n FROM news, (VALUES ('csv'), ('jsonl')) k(kind) GROUP BY ALL",
    "a01_article_splits": with_clause("news") + """ SELECT trim(coalesce(title, '')) AS title, trim(coalesce(date, '')) AS date, trim(coalesce(url, '')) AS url,
      coalesce(md5(body || chr(10) || '"' || title || '"' || chr(13) || chr(10) || ', ' || date), md5('')) AS h, count(*) AS n FROM news GROUP BY ALL""",
    "a01_article_scan": with_clause("news") + " SELECT row_no, title, date, section, url, length(body) AS body_len, label FROM news",
    "a02_row_range": with_clause("news") + " SELECT * FROM (SELECT row_number() OVER (ORDER BY row_no) AS row_number, row_no, title FROM news) WHERE row_number BETWEEN 101 AND 700",
    "a02_selected_rows": with_clause("news") + """ SELECT row_number, row_no, title FROM (SELECT row_number() OVER (ORDER BY row_no) AS row_number, count(*) OVER () AS total, row_no, title FROM news)
      WHERE total <= 1000 OR row_number BETWEEN 101 AND 700""",
    "a03_strip_chrome": _A + " SELECT row_no, anchored, length(body) AS n, md5(body) AS h FROM o_chrome",
    "a04_clean_body": _A + " SELECT row_no, length(body) AS n, md5(body) AS h FROM o_clean",
    "a05_derive_section": _A + " SELECT row_no, section FROM o_section",
    "a06_dedupe_articles": _A + " SELECT row_no, url, section FROM o_unique",
    "a07_content_ids": _A + " SELECT row_no, article_id, sentence_idx, concat('clm_', substr(sha1(concat(article_id, '|', sentence)), 1, 16)) AS claim_id FROM o_sents",
    "a08_split_sentences": _A + " SELECT row_no, sentence_idx, md5(sentence) AS h FROM o_sents",
    "a09_insert_new": with_clause("payload_a", "payload_b") + " SELECT k, payload FROM payload_b WHERE k NOT IN (SELECT k FROM payload_a)",
    "a09_insert_counts": with_clause("payload_a", "payload_b") + """ SELECT CAST(count(*) AS BIGINT) AS seen, CAST(count(*) FILTER (k NOT IN (SELECT k FROM payload_a)) AS BIGINT) AS inserted,
      CAST(count(*) FILTER (k IN (SELECT k FROM payload_a)) AS BIGINT) AS ignored FROM payload_b""",
    "a10_ingest_report": _CAND + """, known AS (SELECT DISTINCT article_id FROM o_ids WHERE row_no % 4 = 1),
      per_id AS (SELECT article_id, count(*) AS n FROM o_ids GROUP BY 1),
      cl AS (SELECT article_id, sentence, count(*) AS n, any_value(candidate) AS candidate, any_value(route) AS route, any_value(source_type) AS source_type FROM o_src GROUP BY 1, 2)
      SELECT 'source_rows' AS metric, CAST(count(*) AS BIGINT) AS value FROM news
      UNION ALL SELECT 'read', CAST(count(*) AS BIGINT) FROM o_ids
      UNION ALL SELECT 'imported', count(*) FROM per_id WHERE article_id NOT IN (SELECT article_id FROM known)
      UNION ALL SELECT 'discarded_articles', (SELECT count(*) FROM news) - (SELECT count(*) FROM o_ids)
      UNION ALL SELECT 'duplicates', (SELECT count(*) FROM o_ids) - (SELECT count(*) FROM per_id WHERE article_id NOT IN (SELECT article_id FROM known))
      UNION ALL SELECT 'sentences', count(*) FROM o_sents
      UNION ALL SELECT 'candidates', CAST(sum(n) AS BIGINT) FROM cl WHERE candidate
      UNION ALL SELECT 'queued', count(*) FROM cl WHERE candidate AND route = 'KOSIS_RETRIEVAL'
      UNION ALL SELECT 'classified', count(*) FROM cl WHERE candidate AND route <> 'KOSIS_RETRIEVAL'
      UNION ALL SELECT concat('route:', route), count(*) FROM cl WHERE candidate GROUP BY 1
      UNION ALL SELECT concat('source_type:', source_type), count(*) FROM cl WHERE candidate GROUP BY 1""",
    "a11_secret_scan": _SECRET,
    "a12_contamination": f"""WITH g AS (SELECT item_id, unnest({_NORM}) AS s FROM benchmark), ng AS (SELECT item_id, len({_NORM}) AS n FROM benchmark),
      dd AS (SELECT doc_id, unnest({_NORM}) AS s FROM documents)
      SELECT doc_id, item_id, count(*) AS shared, round(count(*) / any_value(n), 4) AS item_share FROM dd JOIN g USING (s) JOIN ng USING (item_id) GROUP BY 1, 2""",
    "a13_safe_csv": with_clause("risky_cells") + r""" SELECT doc_id, CASE WHEN regexp_matches(cell, '^[\s\x00-\x1f]*[=+\-@]') OR regexp_matches(cell, '^[\t\r\n]') THEN concat('''', cell) ELSE cell END AS cell, lang FROM risky_cells""",
    "a14_export_rows": with_clause("detector_rows") + " SELECT run_id, doc_id, lang, concat(chr(39), '=', review) AS review FROM detector_rows",
    "a14_bounded_export": with_clause("detector_rows") + """, z AS (SELECT count(*) AS n_rows, CAST(sum(strlen(concat_ws(',', run_id, CAST(doc_id AS STRING), lang, review)) + 1) AS BIGINT) AS n_bytes FROM detector_rows)
      SELECT n_rows, n_bytes, n_rows <= 50000 AND n_bytes <= 52428800 AS allowed FROM z""",
    "a15_page_definitions": with_clause("described_pages") + rf""", c0 AS (SELECT page_id, {_HOST} AS host, regexp_extract(html, {o.q(op._META_NAME_FIRST)}, 1) AS c1,
      regexp_extract(html, {o.q(op._META_CONTENT_FIRST)}, 1) AS c2 FROM described_pages WHERE starts_with(url, 'https://')),
      c1 AS (SELECT page_id, CASE WHEN c1 <> '' THEN c1 ELSE c2 END AS c FROM c0 WHERE host IN ('example.com', 'example.org') OR ends_with(host, '.example.com') OR ends_with(host, '.example.org'))
      SELECT page_id, {_CLEAN} AS definition, 'meta_description' AS method FROM c1 WHERE c <> '' AND {_CLEAN} <> ''""",
}
