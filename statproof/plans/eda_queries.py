"""Registered queries H01-H09 with their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from statproof.functions import lexicon as lx
from statproof.operators import eda as op
from statproof.plans import oracle_parts as o
from statproof.plans.extraction_queries import period_cte
from statproof.plans.fixtures import Tables, with_clause


def _rows(spark, d):
    return op.quality_rows(Tables(spark, d).news)


def _profile(rows):
    return op.profile_sentences(op.valid_articles(rows))


def h01(spark, d):
    return op.quality_issues(_rows(spark, d)).select("row_no", "severity", "code", F.array_join("codes", ",").alias("codes"))


def h02(spark, d):
    return _rows(spark, d).where("exclusion = 'duplicate'").select("row_no", "url")


def h03(spark, d):
    return _profile(_rows(spark, d)).select("row_no", "sentence_idx", F.array_join(F.transform("quantities", lambda q: q["raw"]), "|").alias("quantities"), "numeric", "period", "period_class",
                                     "source.claim_type", "source.source_type", "source.route", "rule", "candidate")


def h04(spark, d):
    return op.structure_stats(Tables(spark, d).documents, "n_chars").select("n", "minimum", "maximum", F.round("mean", 6).alias("mean"), "median", "q1", "q3", "low", "high")


def h04_outliers(spark, d):
    return op.outliers(Tables(spark, d).documents, "n_chars").select("doc_id", "n_chars")


def h05(spark, d):
    return op.eda_counts(_profile(_rows(spark, d)))


def h06(spark, d):
    return op.histogram(Tables(spark, d).documents, "n_chars")


def h07(spark, d):
    return op.issue_view(_rows(spark, d))


def h07_problems(spark, d):
    return op.problem_rows(_rows(spark, d))


def h08(spark, d):
    rows = _rows(spark, d)
    return op.kpi_view(rows, _profile(rows))


def h09(spark, d):
    rows = _rows(spark, d)
    return op.filter_articles(rows, _profile(rows), quality="clean", band="typical", min_candidates=1).select("row_no", "n_candidates", "clean_length")


QUERIES = {"h01_quality_issues": h01, "h02_mark_duplicates": h02, "h03_profile_sentences": h03, "h04_structure_stats": h04, "h04_outliers": h04_outliers, "h05_eda_counts": h05,
           "h06_histogram": h06, "h07_issue_view": h07, "h07_problem_rows": h07_problems, "h08_kpi_view": h08, "h09_filter_articles": h09}

q = o.q
_WS = r"regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_LINES = (rf"array_to_string(list_filter(list_transform(string_split(b2, chr(10)), lambda l: {o._LINE}), lambda s: s <> '' AND NOT regexp_matches(s, {q(lx.COPYRIGHT)}) AND NOT regexp_matches(s, {q(lx.REPORTER_LINE)})), ' ')")
_DAY = r"CASE WHEN regexp_matches(date, '^\s*\d{4}[-/.]\d{1,2}[-/.]\d{1,2}($|\D)') THEN try_strptime(regexp_extract(date, '(\d{4}[-/.]\d{1,2}[-/.]\d{1,2})', 1).replace('.', '-').replace('/', '-'), '%Y-%m-%d') END"
_ROWS = o.ARTICLES + rf""", e0 AS (SELECT row_no, title, date, url, raw_body, {o.strip(r"regexp_replace(body, '(?s)(?:관련 기사|기자 프로필|기자 약력|구독).*$', '')")} AS b2 FROM o_chrome),
  e1 AS (SELECT *, regexp_replace({o.strip('raw_body')}, '^$', '') = '' AS blank, {o.strip(rf"regexp_replace({_LINES}, '[ \t ]+', ' ', 'g')")} AS clean FROM e0),
  e2 AS (SELECT *, CASE WHEN url <> '' THEN 'u:' || url ELSE 'f:' || lower({_WS.format('nfc_normalize(title)')}) || '|' || {_WS.format('clean')} END AS ky FROM e1),
  e3 AS (SELECT *, min(CASE WHEN NOT blank AND clean <> '' THEN row_no END) OVER (PARTITION BY ky) AS fst FROM e2),
  rows0 AS (SELECT row_no, title, date, url, clean, length(clean) AS clean_length, CASE WHEN blank THEN 'missing_body' WHEN clean = '' THEN 'empty_after_cleaning' WHEN fst < row_no THEN 'duplicate' END AS exclusion,
    list_filter([CASE WHEN title = '' THEN 'missing_title' END, CASE WHEN date = '' THEN 'missing_date' END, CASE WHEN date <> '' AND {_DAY} IS NULL THEN 'invalid_date' END], lambda x: x IS NOT NULL) AS warnings FROM e3)"""
_ISS = _ROWS + ", iss AS (SELECT row_no, title, CASE WHEN exclusion IS NOT NULL THEN 'excluded' ELSE 'warning' END AS severity, list_filter(list_concat([exclusion], warnings), lambda x: x IS NOT NULL) AS codes FROM rows0)"
_UNIT = "coalesce(m[6], '')"
_PROF = (_ROWS + rf""", ar AS (SELECT row_no, date, list_filter(list_transform(string_split(regexp_replace(clean, '([다요임음됨함까죠네]\.|[?!])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda s: {o.strip('s')}), lambda s: s <> '') AS ss FROM rows0 WHERE exclusion IS NULL),
  hs AS (SELECT row_no, date, i - 1 AS sentence_idx, ss[i] AS sentence, CASE WHEN date LIKE '____.__.__' THEN CAST(replace(date, '.', '-') AS DATE) END AS dy FROM ar, unnest(range(1, len(ss) + 1)) u(i)), """
         + o.source_cte("hs", "hsrc") + ", " + period_cte("hsrc", "hper") + f""", prof AS (SELECT * REPLACE (CASE WHEN dy IS NULL THEN '' ELSE period END AS period), {o.quantity_list('sentence')} AS ms, {o.has_number('sentence')} AS num, {o.has_unit_quantity('sentence')} AS uq,
    regexp_matches(sentence, {q(lx.NOISE_ONLY)}) AS noise, regexp_matches(sentence, {q(lx.SITE_CHROME)}) AS chrome, regexp_matches(sentence, {q(lx.TREND_HINT)}) AS tr, regexp_matches(sentence, {q(lx.SUPERLATIVE)}) AS sup FROM hper),
  prof2 AS (SELECT *, num AND NOT noise AND NOT chrome AS numeric, NOT noise AND NOT chrome AND (uq OR (num AND tr) OR sup) AS candidate,
    CASE WHEN claim_type = '전망형' THEN 'forecast' WHEN period = '' OR dy IS NULL THEN 'unknown' WHEN CAST(left(period, 4) AS INT) < year(dy) THEN 'past' WHEN CAST(left(period, 4) AS INT) > year(dy) THEN 'forecast'
      WHEN length(period) = 4 THEN 'current' WHEN contains(period, 'Q') THEN CASE WHEN CAST(right(period, 1) AS INT) * 3 < month(dy) THEN 'past' WHEN CAST(right(period, 1) AS INT) * 3 = month(dy) OR quarter(dy) = CAST(right(period, 1) AS INT) THEN 'current' ELSE 'forecast' END
      WHEN CAST(right(period, 2) AS INT) < month(dy) THEN 'past' WHEN CAST(right(period, 2) AS INT) = month(dy) THEN 'current' ELSE 'forecast' END AS period_class FROM prof)""")
_STAT = """st AS (SELECT count(*) AS n, min({v}) AS minimum, max({v}) AS maximum, avg({v}) AS mean, median({v}) AS median, CAST(quantile_disc({v}, 0.25) AS DOUBLE) AS q1, CAST(quantile_disc({v}, 0.75) AS DOUBLE) AS q3 FROM {t})"""
_QT = f"CASE WHEN {_UNIT} IN ('%', '%p', '퍼센트', '포인트') THEN 'percentage' WHEN {_UNIT} = '원' THEN 'money' WHEN {_UNIT} IN ('명', '인', '가구', '세대') THEN 'people_household' WHEN {_UNIT} IN ('건', '개', '배', '위', '호') THEN 'count_rank' ELSE 'other' END"
_CNT = _PROF + f""", cnt AS (SELECT 'total' AS kind, 'total_sentences' AS key, count(*) AS n FROM prof2 UNION ALL SELECT 'total', 'numeric_sentences', count(*) FROM prof2 WHERE numeric UNION ALL SELECT 'total', 'candidates', count(*) FROM prof2 WHERE candidate
  UNION ALL SELECT 'total', 'numeric_candidates', count(*) FROM prof2 WHERE candidate AND numeric UNION ALL SELECT 'total', 'nonnumeric_candidates', count(*) FROM prof2 WHERE candidate AND NOT numeric
  UNION ALL SELECT 'total', 'retrieval_candidates', count(*) FROM prof2 WHERE candidate AND route = 'KOSIS_RETRIEVAL'
  UNION ALL SELECT 'quantity', k, count(*) FROM (SELECT unnest(list_transform(ms, lambda m: {_QT})) AS k FROM prof2) GROUP BY 2 UNION ALL SELECT 'period', period_class, count(*) FROM prof2 WHERE candidate GROUP BY 2
  UNION ALL SELECT 'claim_type', claim_type, count(*) FROM prof2 WHERE candidate GROUP BY 2 UNION ALL SELECT 'route', route, count(*) FROM prof2 WHERE candidate GROUP BY 2)"""
ORACLE = {
    "h01_quality_issues": _ISS + " SELECT row_no, severity, codes[1] AS code, array_to_string(codes, ',') AS codes FROM iss WHERE len(codes) > 0",
    "h02_mark_duplicates": _ROWS + " SELECT row_no, url FROM rows0 WHERE exclusion = 'duplicate'",
    "h03_profile_sentences": _PROF + rf""" SELECT row_no, sentence_idx, array_to_string(list_transform(ms, lambda m: {o.strip('m[1]')}), '|') AS quantities, numeric, period, period_class, claim_type, source_type, route,
      CASE WHEN candidate THEN CASE WHEN uq THEN 'NUMERIC_UNIT' WHEN num AND tr THEN 'NUMERIC_TREND' ELSE 'SUPERLATIVE' END WHEN noise THEN 'EXCLUDED_DATE_ONLY' WHEN chrome THEN 'EXCLUDED_SITE_CHROME'
        WHEN regexp_matches(sentence, '\d') AND NOT num THEN 'CONTEXTUAL_NUMBER_ONLY' WHEN num THEN 'NUMERIC_NO_CLAIM' ELSE 'NO_MATCH' END AS rule, candidate FROM prof2""",
    "h04_structure_stats": "WITH " + _STAT.format(v="n_chars", t="documents") + " SELECT n, minimum, maximum, round(mean, 6) AS mean, median, q1, q3, q1 - 1.5::DOUBLE * (q3 - q1) AS low, q3 + 1.5::DOUBLE * (q3 - q1) AS high FROM st",
    "h04_outliers": "WITH " + _STAT.format(v="n_chars", t="documents") + " SELECT doc_id, n_chars FROM documents, st WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)",
    "h05_eda_counts": _CNT + " SELECT * FROM cnt",
    "h06_histogram": """WITH a AS (SELECT count(*) AS n, min(n_chars) AS lo, max(n_chars) AS hi FROM documents), b AS (SELECT *, CAST(greatest(1, ceil((hi - lo + 1) / least(10, hi - lo + 1, ceil(sqrt(n))))) AS BIGINT) AS w FROM a),
      g AS (SELECT *, unnest(range(0, CAST(ceil((hi - lo + 1) / w) AS BIGINT))) AS bin FROM b) SELECT bin, lo + bin * w AS start, least(hi, lo + (bin + 1) * w - 1) AS "end", (SELECT count(*) FROM documents WHERE (n_chars - g.lo) // g.w = g.bin) AS n FROM g""",
    "h07_issue_view": _ISS + f", c AS (SELECT unnest(codes) AS code FROM iss) SELECT code, count(*) AS n, list_position({op.ISSUE_ORDER!r}, code) - 1 AS position FROM c GROUP BY code",
    "h07_problem_rows": _ISS + ", p AS (SELECT row_no, codes[1] AS code, title FROM iss WHERE len(codes) > 0) SELECT *, (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM p) > 100 AS truncated FROM p ORDER BY row_no, code LIMIT 100",
    "h08_kpi_view": _CNT + f""" SELECT 'quality' AS grp, 'source_rows' AS key, count(*) AS value FROM rows0 UNION ALL SELECT 'quality', 'valid_articles', count(*) FROM rows0 WHERE exclusion IS NULL UNION ALL SELECT 'quality', 'excluded_articles', count(exclusion) FROM rows0
      UNION ALL SELECT 'quality', 'warning_articles', count(*) FROM rows0 WHERE exclusion IS NULL AND len(warnings) > 0 UNION ALL SELECT 'claims', key, n FROM cnt WHERE kind = 'total'
      UNION ALL SELECT w.k, w.c, coalesce((SELECT n FROM cnt WHERE kind = w.k AND key = w.c), 0) FROM (SELECT 'quantity' AS k, unnest({op.QUANTITY_TYPES!r}) AS c UNION ALL SELECT 'period', unnest({op.PERIOD_CLASSES!r})) w""",
    "h09_filter_articles": _PROF + ", pa AS (SELECT r.row_no, clean_length, warnings, count(p.sentence) AS ns, count(*) FILTER (p.candidate) AS n_candidates FROM rows0 r LEFT JOIN prof2 p ON p.row_no = r.row_no WHERE exclusion IS NULL GROUP BY ALL), "
    + _STAT.format(v="clean_length", t="pa") + ", " + _STAT.format(v="ns", t="pa").replace("st AS", "s2 AS", 1) + """ SELECT row_no, n_candidates, clean_length FROM pa, st, s2 WHERE len(warnings) = 0
      AND clean_length BETWEEN st.q1 - 1.5 * (st.q3 - st.q1) AND st.q3 + 1.5 * (st.q3 - st.q1) AND ns BETWEEN s2.q1 - 1.5 * (s2.q3 - s2.q1) AND s2.q3 + 1.5 * (s2.q3 - s2.q1) AND clean_length > st.q1 AND clean_length <= st.q3 AND n_candidates >= 1""",
}
