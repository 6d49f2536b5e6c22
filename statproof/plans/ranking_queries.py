"""Registered queries C01-C14 with their DuckDB oracles."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statproof.functions import lexicon as lx, text as tx
from statproof.functions.scale import shared_folder
from statproof.operators import crawl, extraction, ranking as op
from statproof.plans import oracle_parts as o
from statproof.plans.extraction_queries import _profile_ctes
from statproof.plans.fixtures import Tables, with_clause
from statproof.plans.oracle_parts import q


def _inputs(spark, d):
    t = Tables(spark, d)
    return t.part_queries, t.part_catalog.select("ord", F.concat_ws(" ", "tbl_nm", "survey").alias("doc"), F.col("tbl_nm").alias("keywords"))


def c01(spark, d):
    qs, cat = _inputs(spark, d)
    return op.search_overlap(qs, cat, 3)


def c02(spark, d):
    qs, cat = _inputs(spark, d)
    return op.search_tfidf(qs, cat, 3).select("qid", "rank", "ord", F.round("score", 6).alias("score"))


def _rankings(spark, d):
    qs, cat = _inputs(spark, d)
    a, b = op.search_overlap(qs, cat, 5), op.search_tfidf(qs, cat, 5)
    return a.select("qid", "rank", "ord", F.lit(0).alias("path_no")).unionByName(b.select("qid", "rank", "ord", F.lit(1).alias("path_no")))


def c03(spark, d):
    return op.rrf(_rankings(spark, d)).select("qid", "rank", "ord", F.round("score", 6).alias("score"))


def c04(spark, d):
    qs, cat = _inputs(spark, d)
    return op.search_substring(qs, cat, 3)


def _hits(t):
    return (t.table_hits.join(t.kr_tables, "tbl").join(t.order_sentences, "claim_id")
            .select("claim_id", "rank", "tbl", "tbl_id", "org_id", "tbl_nm", "survey", "path", "vw_cd", "start_prd", "end_prd", "sentence", "period"))


def c05(spark, d):
    t = Tables(spark, d)
    hits = t.table_hits.select("claim_id", (F.col("rank") % 2).alias("term_idx"), "rank", F.concat(F.lit("O"), F.col("tbl") % 3).alias("org_id"),
                               F.concat(F.lit("T"), F.col("tbl") % 10).alias("tbl_id"))
    return op.union_hits(hits).select("claim_id", "rank", "org_id", "tbl_id", "term_idx", "term_rank")


def c06(spark, d):
    return op.filter_coverage(_hits(Tables(spark, d))).select("claim_id", "rank", "orig_rank", "tbl", "score")


def c07(spark, d):
    t = Tables(spark, d)
    flags = t.order_sentences.select("claim_id", F.explode(F.array(op.claim_flags(F.col("sentence")))).alias("claim_flags"))
    return op.rerank(_hits(t).join(flags, "claim_id")).select("claim_id", "rank", "orig_rank", "tbl", "rerank_score", F.size("reasons").cast("long").alias("n_reasons"))


def _profiled(t):
    # One profile per claim, computed before its hits multiply it; the exploded struct keeps it from being re-run.
    profiles = t.order_sentences.select("claim_id", F.explode(F.array(tx.claim_profile(extraction.S()))).alias("profile"))
    return _hits(t).join(profiles, "claim_id")


def _with_items(t):
    items = t.kr_items.groupBy("tbl").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_no", "item"))), lambda x: x["item"]).alias("items"))
    return _profiled(t).join(items, "tbl")


def c08(spark, d):
    f = op.candidate_fit(_with_items(Tables(spark, d)))
    return f.select("claim_id", F.col("rank"), "tbl", "score", "max_score", "fit_score", F.size("reasons").cast("long").alias("n_reasons"),
                    F.size("penalties").cast("long").alias("n_penalties"))


def c09(spark, d):
    h = _with_items(Tables(spark, d))
    return h.groupBy(op.best_item(F.col("items"), F.col("profile")).alias("item"), F.col("profile.indicator").alias("indicator")).agg(F.count(F.lit(1)).alias("n"))


def c10(spark, d):
    t = Tables(spark, d)
    return op.suggest(_profiled(t), t.kr_items).select("claim_id", "rank", "hit_rank", "tbl", "score", "selected_item")


def c10_log(spark, d):
    t = Tables(spark, d)
    return op.candidate_log(op.suggest(_profiled(t), t.kr_items)).groupBy("selected_item", "rank").agg(F.count(F.lit(1)).alias("n"), F.sum("n_candidates").alias("total"))


def c10_composed(spark, d):
    t = Tables(spark, d)
    catalog = t.kr_tables.select("tbl", F.col("tbl").alias("ord"), F.concat_ws(" ", "tbl_nm", "survey").alias("doc"), "org_id", "tbl_id", "tbl_nm", "survey")
    found = op.suggest_for_claims(t.order_sentences, catalog, t.kr_items)
    return found.select("claim_id", "rank", "hit_rank", "tbl", "score", "max_score", "selected_item")


def c11(spark, d):
    t = Tables(spark, d)
    ev = t.evidence_objects.withColumn("selection", F.create_map(F.lit("지역"), "sel_region", F.lit("연령"), "sel_age"))
    m = op.match_score(t.table_hits.join(t.order_sentences, "claim_id").join(ev, "tbl"))
    return m.select("claim_id", F.col("rank"), "tbl", "score", "status", F.size("reasons").cast("long").alias("n_reasons"))


def c12(spark, d):
    return op.query_plan(extraction.counted_terms(Tables(spark, d).order_sentences), "n")


def c12_budget(spark, d):
    return op.query_budget(extraction.counted_terms(Tables(spark, d).order_sentences), 3, "n")


EDGES = """SELECT 'root' AS parent_id, concat('R', CAST(r_regionkey AS STRING)) AS child_id, FALSE AS is_table FROM region
  UNION ALL SELECT concat('R', CAST(n_regionkey AS STRING)), concat('N', CAST(n_nationkey AS STRING)), FALSE FROM nation
  UNION ALL SELECT concat('R', CAST((n_regionkey + 1) % 5 AS STRING)), concat('N', CAST(n_nationkey AS STRING)), FALSE FROM nation
  UNION ALL SELECT concat('N', CAST(s_nationkey AS STRING)), concat('S', CAST(s_suppkey AS STRING)), TRUE FROM supplier
  UNION ALL SELECT concat('R', CAST(s_nationkey % 5 AS STRING)), concat('S', CAST(s_suppkey AS STRING)), TRUE FROM supplier WHERE s_suppkey % 3 = 0"""


def _edges(spark, d):
    for name in ("region", "nation", "supplier"):
        getattr(Tables(spark, d), name).createOrReplaceTempView(name)
    return spark.sql(EDGES)


def c13(spark, d):
    return op.expand_catalog(_edges(spark, d), spark.sql("SELECT 'root' AS root_id"))


def c13_capped(spark, d):
    edges = _edges(spark, d)
    lists = edges.where("NOT is_table").groupBy(F.col("child_id").alias("list_id")).agg(F.when(F.min("parent_id") == "root", 1).otherwise(2).alias("depth"))
    return op.capped_visits(lists, 12)


def _crawled(spark, d):
    """Three capped runs; each resumes the queue of the one before."""
    edges = _edges(spark, d).withColumn("ord", F.col("child_id"))
    folder = f"{shared_folder(spark)}/crawl-{uuid.uuid4().hex}"
    for _ in range(3):
        seen = crawl.crawl(edges, spark.sql("SELECT 'root' AS root_id"), folder, 7)
    return edges, seen


def c13_resumed(spark, d):
    return _crawled(spark, d)[1].select("list_id", "position", "run", "state")


def c13_crawled(spark, d):
    return crawl.crawled_tables(*_crawled(spark, d))


def c13_merge(spark, d):
    t = Tables(spark, d)
    cols = ["k", "payload"]
    return op.merge_catalog(t.payload_a.select(*cols), t.payload_b.select(*cols), "k")


def c14(spark, d):
    t = Tables(spark, d)
    cards = op.semantic_cards(op.candidate_fit(_with_items(t)))
    return cards.groupBy("indicator", "time", F.col("field_status")["spatial"].alias("spatial_status"), "semantic_confidence").agg(F.count(F.lit(1)).alias("n"))


def c14_summary(spark, d):
    t = Tables(spark, d)
    a, b = t.payload_a.select(F.col("k").cast("string").alias("tbl_id")), t.payload_b.select(F.col("k").cast("string").alias("tbl_id"))
    return op.card_summary(a, b, a, t.part)


QUERIES = {
    "c01_search_overlap": c01, "c02_search_tfidf": c02, "c03_rrf": c03, "c04_search_substring": c04, "c05_union_hits": c05, "c06_filter_coverage": c06,
    "c07_rerank": c07, "c08_candidate_fit": c08, "c09_best_item": c09, "c10_suggest": c10, "c10_candidate_log": c10_log, "c10_composed_search": c10_composed, "c11_match_score": c11,
    "c12_query_plan": c12, "c12_query_budget": c12_budget, "c13_expand_catalog": c13, "c13_capped_visits": c13_capped, "c13_merge_catalog": c13_merge, "c13_resumed_crawl": c13_resumed, "c13_crawled_tables": c13_crawled, "c14_semantic_cards": c14,
    "c14_card_summary": c14_summary,
}

# Breadth-first order of a tree of three levels: the root, its lists, then theirs by first parent and id.
_CRAWL = f"""WITH e AS ({EDGES}), l1 AS (SELECT child_id AS list_id, 1 + row_number() OVER (ORDER BY child_id) AS position FROM (SELECT DISTINCT child_id FROM e WHERE parent_id = 'root' AND NOT is_table)),
  f2 AS (SELECT child_id AS list_id, min(position) AS parent FROM e JOIN l1 ON parent_id = l1.list_id WHERE NOT is_table GROUP BY 1),
  q AS (SELECT 'root' AS list_id, CAST(1 AS BIGINT) AS position, CAST(0 AS BIGINT) AS parent UNION ALL SELECT list_id, position, 1 FROM l1
    UNION ALL SELECT list_id, (SELECT max(position) FROM l1) + row_number() OVER (ORDER BY parent, list_id), parent FROM f2)"""
_GRAMS = ("list_distinct(flatten(list_transform(regexp_extract_all({0}, '[가-힣A-Za-z0-9]+'), lambda w: list_concat([w], "
          "list_transform(range(1, greatest(length(w), 1)), lambda i: substr(w, i, 2))))))")
_TGRAMS = ("flatten(list_transform(regexp_extract_all({0}, '[가-힣A-Za-z0-9]+'), lambda w: list_concat(list_concat([w], "
           "list_transform(range(1, greatest(length(w), 1)), lambda i: substr(w, i, 2))), list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: substr(w, i, 3)))))")
_IN = with_clause("part_queries", "part_catalog") + ", cat AS (SELECT ord, concat_ws(' ', tbl_nm, survey) AS doc, tbl_nm AS kw FROM part_catalog)"
_C01 = f""", qg AS (SELECT qid, {_GRAMS.format('query')} AS g FROM part_queries), dg AS (SELECT ord, {_GRAMS.format('doc')} AS g FROM cat),
  sc AS (SELECT qid, ord, len(list_intersect(qg.g, dg.g)) AS inter, len(qg.g) AS nq, len(dg.g) AS nd FROM qg, dg),
  s2 AS (SELECT qid, ord, round(inter / sqrt(nq + nd - inter), 4) AS score FROM sc WHERE inter > 0),
  ov AS (SELECT qid, ord, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM s2)"""
_C02 = f""", corp AS (SELECT doc AS t FROM cat UNION ALL SELECT kw FROM cat),
  idf AS (SELECT g, ln((2 * (SELECT count(*) FROM cat) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(list_distinct({_TGRAMS.format('t')})) AS g FROM corp) GROUP BY g),
  qv AS (SELECT qid, g, count(*) * any_value(idf) AS w FROM (SELECT qid, unnest({_TGRAMS.format('query')}) AS g FROM part_queries) JOIN idf USING (g) GROUP BY qid, g),
  dv AS (SELECT ord, g, count(*) * any_value(idf) AS w FROM (SELECT ord, unnest({_TGRAMS.format('doc')}) AS g FROM cat) JOIN idf USING (g) GROUP BY ord, g),
  qn AS (SELECT qid, sqrt(sum(w * w)) AS n FROM qv GROUP BY qid), dn AS (SELECT ord, sqrt(sum(w * w)) AS n FROM dv GROUP BY ord),
  dt AS (SELECT qid, ord, sum(qv.w * dv.w) AS dot FROM qv JOIN dv USING (g) GROUP BY qid, ord),
  tf AS (SELECT qid, ord, dot / (qn.n * dn.n) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(dot / (qn.n * dn.n), 9) DESC, ord) AS rank
    FROM dt JOIN qn USING (qid) JOIN dn USING (ord))"""
_HITS = with_clause("table_hits", "kr_tables", "order_sentences") + """, h AS (SELECT claim_id, rank, tbl, tbl_id, org_id, tbl_nm, survey, path, vw_cd, start_prd, end_prd, sentence, period
  FROM table_hits JOIN kr_tables USING (tbl) JOIN order_sentences USING (claim_id))"""
_COV = "CASE WHEN start_prd = '' THEN NULL ELSE start_prd <= period AND period <= end_prd END"


def _rx(c, p):
    return f"regexp_matches({c}, {q(p)})"


_MON = _rx("sentence", r"지난달|전월|이달|당월|전년\s*동월|작년\s*같은\s*달|\d{1,2}월(?:[^\p{L}\p{N}_]|$)|월간|월별")
_ANN, _REGION, _FC = _rx("sentence", lx.ANNUAL_CLAIM), _rx("sentence", lx.REGION_CLAIM), _rx("sentence", lx.FORECAST_CLAIM)
_DOC = "concat(tbl_nm, ' ', survey, ' ', path)"
_SIG = ([f"CASE WHEN contains(sentence, '{t}') AND contains({_DOC}, '{t}') THEN 2.5 END" for t in lx.CORE_TERMS] + [
    "CASE WHEN vw_cd = 'MT_RTITLE' OR contains(path, '국제기구별') THEN -5.0 WHEN vw_cd = 'MT_ZTITLE' THEN 2.0 END",
    f"CASE WHEN vw_cd = 'MT_GTITLE01' OR contains(tbl_nm, '(시도') OR contains(tbl_nm, '시도/시') THEN CASE WHEN {_REGION} THEN 2.0 ELSE -3.0 END END",
    f"CASE WHEN {_MON} THEN CASE WHEN contains(tbl_nm, '월별') THEN 4.0 WHEN contains(tbl_nm, '연도별') OR contains(tbl_nm, '연간') THEN -3.0 END "
    f"WHEN {_ANN} THEN CASE WHEN contains(tbl_nm, '연도별') OR contains(tbl_nm, '연간') THEN 3.0 WHEN contains(tbl_nm, '월별') THEN -1.0 END END",
    "CASE WHEN replace(survey, '조사', '') <> '' AND contains(sentence, replace(survey, '조사', '')) THEN 1.5 END",
    f"CASE {_COV} WHEN FALSE THEN -4.0 WHEN TRUE THEN 1.0 END",
    f"CASE WHEN {_rx(_DOC, lx.PROJECTION_TABLE)} THEN CASE WHEN {_FC} THEN 1.0 ELSE -4.0 END END",
    r"CASE WHEN regexp_extract(tbl_nm, '^([가-힣()·]+?)별\s', 1) <> '' AND NOT contains(sentence, regexp_extract(tbl_nm, '^([가-힣()·]+?)별\s', 1)) "
    r"AND NOT regexp_matches(regexp_extract(tbl_nm, '^([가-힣()·]+?)별\s', 1), '시도|지역|행정구역|시군구') THEN -3.0 END"])


def _ind_in(text):
    return f"(ind <> '' AND contains({text}, replace(ind, ' ', '')))"


def _cmp_in(text):
    return (f"CASE comparison WHEN '전년동월비' THEN contains({text}, '전년동월비') OR contains({text}, '전년비') WHEN '전월비' THEN contains({text}, '전월비') "
            f"WHEN '전년 대비' THEN contains({text}, '전년') ELSE FALSE END")


def _item(i):
    z = f"replace(lower({i}), ' ', '')"
    return f"(CASE WHEN {_ind_in(z)} THEN 100 ELSE 0 END + CASE WHEN {_cmp_in(z)} THEN 10 ELSE 0 END + CASE WHEN unit_kind IN ('%', '%p') AND contains({i}, '%') THEN 2 ELSE 0 END)"


_PROF = _profile_ctes("hs").replace("article_id", "claim_id").replace("ORDER BY sentence_idx", "ORDER BY sentence")
_FIT0 = (with_clause("table_hits", "kr_tables", "order_sentences", "kr_items") + ", hs AS (SELECT claim_id, sentence FROM order_sentences), " + _PROF + f""",
  pr AS (SELECT claim_id, t1 AS topic, i1 AS ind, period_kind, comparison, unit_kind, r0 AS region, o0 AS population, list_filter([prod, work], lambda x: x <> '') AS quals FROM p1),
  it AS (SELECT tbl, max(CASE WHEN item_no = 0 THEN item END) AS a, max(CASE WHEN item_no = 1 THEN item END) AS b FROM kr_items GROUP BY tbl),
  f0 AS (SELECT h.claim_id, h.rank, h.tbl, k.org_id, k.tbl_nm, k.survey, pr.* EXCLUDE (claim_id), {{items}} AS items FROM table_hits h JOIN kr_tables k USING (tbl) JOIN it USING (tbl) JOIN pr USING (claim_id)),
  f1 AS (SELECT *, replace(lower(tbl_nm), ' ', '') AS title, replace(lower(concat_ws(' ', tbl_nm, survey, array_to_string(items, ' '))), ' ', '') AS txt, array_to_string(items, ' ') AS off,
    CASE WHEN len(items) = 0 THEN '' WHEN len(items) = 1 OR {_item('items[1]')} >= {_item('items[2]')} THEN items[1] ELSE items[2] END AS sel FROM f0),
  f2 AS (SELECT *, ind <> '' AS a1, contains(title, replace(ind, ' ', '')) AS m1, period_kind <> '' AS a2,
    CASE period_kind WHEN '월' THEN regexp_matches(title, '월별|월간|전년동월비|전월비') WHEN '분기' THEN contains(title, '분기') WHEN '연' THEN regexp_matches(title, '연도별|연간|연별|년간') ELSE FALSE END AS m2,
    unit_kind IN ('%', '%p') AS a3, regexp_matches(title, '전년동월비|전월비|률') AS m3, comparison <> '' AS a4, {_cmp_in('title')} AS m4,
    topic = '물가' AND len(quals) > 0 AS a5, contains(tbl_nm, '품목별') AND contains(tbl_nm, '소비자물가') AS m5,
    len(quals) AS nq, len(list_filter(quals, lambda x: contains(txt, x))) AS mq, region <> '' AS a6, contains(txt, region) AS m6, population <> '' AS a7, contains(txt, population) AS m7,
    sel <> '' AND {_ind_in("replace(lower(sel), ' ', '')")} AS ih, comparison = '전년동월비' AS yo FROM f1),
  f3 AS (SELECT *, 50 * (a1 AND m1)::INT + 20 * (a2 AND m2)::INT + 20 * (a3 AND m3)::INT + 10 * (a4 AND m4)::INT + 50 * (a5 AND m5)::INT + 15 * mq + 10 * (a6 AND m6)::INT + 10 * (a7 AND m7)::INT + 20 * ih::INT AS base,
    50 * a1::INT + 20 * a2::INT + 20 * a3::INT + 10 * a4::INT + 50 * a5::INT + 15 * nq + 10 * a6::INT + 10 * a7::INT + 20 * ih::INT + 20 * yo::INT AS max_score,
    yo AND contains(off, '전월비') AND NOT contains(off, '전년') AS wb FROM f2),
  f4 AS (SELECT *, yo AND NOT wb AND (contains(off, '전년비') OR contains(off, '전년동월비')) AS rb FROM f3),
  fit AS (SELECT *, CAST(base - CASE WHEN wb THEN least(40, base) ELSE 0 END + CASE WHEN rb THEN 20 ELSE 0 END AS INT) AS score FROM f4),
  fits AS (SELECT *, CAST(CASE WHEN max_score <= 0 THEN 0 ELSE greatest(0, least(100, round_even(score * 100.0 / max_score, 0))) END AS INT) AS fit_score FROM fit)""")
_FIT = _FIT0.replace("{items}", "[it.a, it.b]")
_SUG = _FIT
# Terms of a profile, each term's tables by overlap, and every table where a claim sees it first.
_TERMS = f""",
  sq AS (SELECT claim_id, length(array_to_string(quals, '')) > 0 AS qualified, ts[i] AS term, i FROM (SELECT claim_id, quals, list_filter(list_concat(quals, [ind]), lambda x: x <> '') AS ts FROM pr), unnest(range(1, len(ts) + 1)) u(i)),
  tg AS (SELECT term, {_GRAMS.format('term')} AS g FROM (SELECT DISTINCT term FROM sq)), kg AS (SELECT tbl, {_GRAMS.format("concat_ws(' ', tbl_nm, survey)")} AS g FROM kr_tables),
  tk AS (SELECT term, tbl, len(list_intersect(tg.g, kg.g)) AS n, len(tg.g) + len(kg.g) AS total FROM tg, kg),
  tr AS (SELECT term, tbl, row_number() OVER (PARTITION BY term ORDER BY round(n / sqrt(total - n), 4) DESC, tbl) AS r FROM tk WHERE n > 0),
  su AS (SELECT claim_id, tbl, qualified, min(i * 1000 + r) AS place FROM sq JOIN tr USING (term) WHERE r <= CASE WHEN qualified THEN 100 ELSE 10 END GROUP BY 1, 2, 3),
  sh AS (SELECT claim_id, tbl, row_number() OVER (PARTITION BY claim_id ORDER BY place) AS rank, qualified FROM su QUALIFY rank <= CASE WHEN qualified THEN 100 ELSE 10 END),
  it AS ("""
_COMPOSED = (_FIT0.replace(",\n  it AS (", _TERMS).replace("FROM table_hits h JOIN", "FROM sh h JOIN")
             .replace("{items}", "CASE WHEN h.rank <= 3 THEN [it.a, it.b] ELSE [] END"))
_UNIT11 = "CASE " + " ".join(f"WHEN contains(sentence, '{u}') THEN '{u}'" for u in lx.MATCH_UNITS) + " ELSE '' END"
_SRC12 = with_clause("order_sentences") + ", " + o.source_cte("order_sentences", "o_src")

ORACLE = {
    "c01_search_overlap": _IN + _C01 + " SELECT qid, rank, ord, score FROM ov WHERE rank <= 3",
    "c02_search_tfidf": _IN + _C02 + " SELECT qid, rank, ord, round(score, 6) AS score FROM tf WHERE rank <= 3",
    "c03_rrf": _IN + _C01 + _C02 + """, u AS (SELECT qid, ord, rank, 0 AS p FROM ov WHERE rank <= 3 UNION ALL SELECT qid, ord, rank, 1 FROM tf WHERE rank <= 3),
      f AS (SELECT qid, ord, sum(1.0 / (60 + rank)) AS score, min(p * 10 + rank) AS fst FROM u GROUP BY qid, ord),
      r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, fst) AS rank FROM f) SELECT qid, rank, ord, round(score, 6) AS score FROM r WHERE rank <= 3""",
    "c04_search_substring": _IN + """, qw AS (SELECT qid, unnest(list_distinct(regexp_extract_all(query, '[가-힣A-Za-z0-9]+'))) AS w FROM part_queries),
      dw AS (SELECT ord, unnest(list_distinct(regexp_extract_all(doc, '[가-힣A-Za-z0-9]+'))) AS w FROM cat),
      vp AS (SELECT a.w AS qw, b.w AS dw FROM (SELECT DISTINCT w FROM qw) a, (SELECT DISTINCT w FROM dw) b WHERE contains(a.w, b.w) OR contains(b.w, a.w)),
      s AS (SELECT qid, ord, count(*) AS score FROM qw JOIN vp ON qw.w = vp.qw JOIN dw ON dw.w = vp.dw GROUP BY qid, ord),
      r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS rank FROM s) SELECT qid, rank, ord, score FROM r WHERE rank <= 3""",
    "c05_union_hits": with_clause("table_hits") + """, h AS (SELECT claim_id, rank % 2 AS term_idx, rank, concat('O', tbl % 3) AS org_id, concat('T', tbl % 10) AS tbl_id FROM table_hits),
      f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY claim_id, org_id, tbl_id ORDER BY term_idx, rank) = 1)
      SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY term_idx, rank) AS rank, org_id, tbl_id, term_idx, rank AS term_rank FROM f""",
    "c06_filter_coverage": _HITS + f""" SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY rank) AS rank, rank AS orig_rank, tbl, round(1.0 / rank, 4) AS score
      FROM h WHERE coalesce({_COV}, TRUE)""",
    "c07_rerank": _HITS + f""", s AS (SELECT claim_id, rank AS orig_rank, tbl, [{', '.join(_SIG)}] AS sig FROM h),
      t AS (SELECT *, CAST(round(coalesce(list_sum(sig), 0), 2) AS DOUBLE) AS rerank_score, len(list_filter(sig, lambda x: x IS NOT NULL)) AS n_reasons FROM s)
      SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY rerank_score DESC, orig_rank) AS rank, orig_rank, tbl, rerank_score, n_reasons FROM t""",
    "c08_candidate_fit": _FIT + """ SELECT claim_id, rank, tbl, score, CAST(max_score AS INT) AS max_score, fit_score,
      CAST((a1 AND m1)::INT + (a2 AND m2)::INT + (a3 AND m3)::INT + (a4 AND m4)::INT + (a5 AND m5)::INT + mq + (a6 AND m6)::INT + (a7 AND m7)::INT + ih::INT + rb::INT AS BIGINT) AS n_reasons,
      CAST((a1 AND NOT m1)::INT + (a2 AND NOT m2)::INT + (a3 AND NOT m3)::INT + (a4 AND NOT m4)::INT + (a5 AND NOT m5)::INT + nq - mq + (a6 AND NOT m6)::INT + (a7 AND NOT m7)::INT
        + (sel <> '' AND NOT ih AND ind = '수출액' AND contains(sel, '수출물량'))::INT + wb::INT AS BIGINT) AS n_penalties FROM fits""",
    "c09_best_item": _FIT + " SELECT sel AS item, ind AS indicator, count(*) AS n FROM fits GROUP BY 1, 2",
    "c10_suggest": _SUG + """, r AS (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, rank) AS rk, rank AS hit_rank, tbl, score, sel FROM fits)
      SELECT claim_id, rk AS rank, hit_rank, tbl, score, sel AS selected_item FROM r WHERE rk <= 3""",
    "c10_composed_search": _COMPOSED + """, r AS (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, rank) AS rk, rank AS hit_rank, tbl, score, max_score, sel FROM fits)
      SELECT claim_id, rk AS rank, hit_rank, tbl, score, CAST(max_score AS INT) AS max_score, sel AS selected_item FROM r WHERE rk <= 3""",
    "c10_candidate_log": _SUG + """, r AS (SELECT claim_id, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, rank) AS rk, sel FROM fits),
      g AS (SELECT *, count(*) OVER (PARTITION BY claim_id) AS n FROM r WHERE rk <= 3) SELECT sel AS selected_item, rk AS rank, count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM g GROUP BY 1, 2""",
    "c11_match_score": with_clause("table_hits", "order_sentences", "evidence_objects") + f""", j AS (SELECT *, replace(sentence, ' ', '') AS z, replace(indicator, ' ', '') AS ind, {_UNIT11} AS su,
        CASE WHEN regexp_matches(sentence, '\\d{{4}}년') THEN '연' WHEN regexp_matches(sentence, '\\d{{1,2}}월|지난달|이번달') THEN '월' WHEN contains(sentence, '분기') THEN '분기' ELSE '-' END AS kind,
        list_filter([sel_region, sel_age], lambda v: v NOT IN ('', '계', '전체')) AS ch FROM table_hits JOIN order_sentences USING (claim_id) JOIN evidence_objects USING (tbl)),
      m AS (SELECT *, contains(z, ind) OR (contains(ind, '전년동월') AND regexp_matches(z, '지난해같은달|전년동월')) AS im, su <> '' AND su = unit AS um, kind = time_dimension AS tm,
        len(ch) > 0 AND len(list_filter(ch, lambda v: NOT contains(sentence, v))) = 0 AS sm FROM j)
      SELECT claim_id, rank, tbl, 40 * im::INT + 25 * um::INT + 20 * tm::INT + 15 * sm::INT AS score,
        CASE WHEN 40 * im::INT + 25 * um::INT + 20 * tm::INT + 15 * sm::INT >= 80 AND NOT (su <> '' AND su <> unit) THEN 'high' ELSE 'needs_review' END AS status, CAST(4 AS BIGINT) AS n_reasons FROM m""",
    "c12_query_plan": _SRC12 + """, p AS (SELECT matched_keyword AS query, domain, count(*) AS n FROM o_src WHERE matched_keyword <> '' GROUP BY 1, 2)
      SELECT query, CAST(sum(n) AS BIGINT) AS n_claims, max_by(domain, n) AS domain FROM p GROUP BY query""",
    "c12_query_budget": _SRC12 + """, p AS (SELECT matched_keyword AS query, count(*) AS n FROM o_src WHERE matched_keyword <> '' GROUP BY 1)
      SELECT count(*) AS needed, CAST(sum(n) AS BIGINT) AS claims, round(sum(n) / count(*), 1) AS claims_per_query, CAST(ceil(count(*) / 3) AS BIGINT) AS batches FROM p""",
    "c13_expand_catalog": f"""WITH RECURSIVE e AS ({EDGES}), w AS (SELECT 'root' AS node, 0 AS depth UNION SELECT e.child_id, w.depth + 1 FROM w JOIN e ON e.parent_id = w.node AND NOT e.is_table)
      SELECT child_id AS tbl_id, min(depth) AS depth, arg_min(parent_id, (depth, parent_id)) AS list_id FROM w JOIN e ON e.parent_id = w.node AND e.is_table GROUP BY 1""",
    "c13_capped_visits": f"""WITH e AS ({EDGES}), l AS (SELECT child_id AS list_id, CASE WHEN min(parent_id) = 'root' THEN 1 ELSE 2 END AS depth FROM e WHERE NOT is_table GROUP BY 1)
      SELECT list_id, depth, CASE WHEN row_number() OVER (ORDER BY depth, list_id) <= 12 THEN 'visited' ELSE 'pending' END AS state FROM l""",
    "c13_resumed_crawl": _CRAWL + """ SELECT list_id, position, CAST(CASE WHEN position = 1 THEN 1 ELSE ceil(parent / 7) END AS INT) AS run, CASE WHEN position <= 21 THEN 'visited' ELSE 'pending' END AS state
      FROM q WHERE position = 1 OR parent <= 21""",
    "c13_crawled_tables": _CRAWL + " SELECT child_id AS tbl_id, arg_min(parent_id, position) AS list_id FROM e JOIN q ON parent_id = q.list_id WHERE is_table AND position <= 21 GROUP BY 1",
    "c13_merge_catalog": with_clause("payload_a", "payload_b") + " SELECT k, payload FROM payload_b UNION ALL SELECT k, payload FROM payload_a WHERE k NOT IN (SELECT k FROM payload_b)",
    "c14_semantic_cards": _FIT + """ SELECT CASE WHEN sel <> '' THEN sel ELSE ind END AS indicator, period_kind AS time, CASE WHEN region <> '' THEN 'inferred' ELSE 'unconfirmed' END AS spatial_status,
      round(fit_score / 100, 2) AS semantic_confidence, count(*) AS n FROM fits GROUP BY 1, 2, 3, 4""",
    "c14_card_summary": with_clause("payload_a", "payload_b") + """ SELECT (SELECT count(*) FROM payload_a) AS catalog_card_count, (SELECT count(*) FROM payload_b WHERE k NOT IN (SELECT k FROM payload_a)) AS current_run_new_card_count,
      (SELECT count(*) FROM payload_b WHERE k IN (SELECT k FROM payload_a)) AS current_run_reused_card_count, (SELECT count(*) FROM part) AS pending_card_count""",
}
