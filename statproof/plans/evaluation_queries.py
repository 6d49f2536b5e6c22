"""Registered queries F01-F19 with their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from statproof.operators import evaluation as op
from statproof.plans import ranking_queries as rq
from statproof.plans.fixtures import Tables, with_clause

REQUIRED = ["claim_id", "domain", "sentence", "review_status", "claim_value"]
VOCAB = {"domain": ["고용", "물가", "인구", "무역"], "review_status": ["approved", "draft", "rejected"], "gold_label": ["match", "mismatch", "unverifiable"]}
TARGETS = {"고용": 30, "물가": 100000, "인구": 40, "무역": 20}


def _det(t):
    return t.detector_rows.withColumn("truth", F.col("review") == "true_candidate")


def f01(spark, d):
    return op.eval_detection(_det(Tables(spark, d)), "truth", "rule_candidate")


def f01_misses(spark, d):
    return op.detection_misses(_det(Tables(spark, d)), "truth", "rule_candidate").groupBy("kind", "lang").agg(F.count(F.lit(1)).alias("n"))


def _gold(t):
    k = F.col("l_partkey") % 7
    return t.lineitem.select(F.col("l_quantity").alias("claimed_value"), F.lit("건").alias("claimed_unit"), F.when(k == 0, F.lit(None)).when(k == 1, F.col("l_quantity") * 1.2).otherwise(F.col("l_quantity")).alias("evidence_value"),
                             F.lit("건").alias("evidence_unit"), F.lit(None).cast("string").alias("claimed_op"), F.when(F.col("l_suppkey") % 5 == 0, "mismatch").when(k == 0, "unverifiable").otherwise("match").alias("gold_label"))


def f02(spark, d):
    p = op.predict_verdicts(_gold(Tables(spark, d)))
    return p.groupBy(F.col("gold_label").alias("gold"), "pred").agg(F.count(F.lit(1)).alias("n"))


def f03(spark, d):
    return op.classification_report(Tables(spark, d).label_pairs)


def f03_classes(spark, d):
    return op.class_metrics(Tables(spark, d).label_pairs)


def f04(spark, d):
    return op.fallback_metrics(Tables(spark, d).label_pairs)


def f05(spark, d):
    t = Tables(spark, d)
    runs = t.detector_rows.groupBy("run_id").agg(F.round(F.avg(F.col("rule_candidate").cast("int")), 4).alias("rule_rate"), F.round(F.avg("n_chars"), 2).alias("chars"))
    return op.diff_runs(runs.unpivot("run_id", ["rule_rate", "chars"], "metric", "value").withColumnRenamed("run_id", "run_no"))


def _fails(t):
    return op.failure_records(op.detection_misses(_det(t), "truth", "rule_candidate"), "doc_id")


def f06(spark, d):
    f = _fails(Tables(spark, d)).withColumn("resolved", F.col("doc_id") % 3 == 0).withColumn("derived_assets", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("A2"))).otherwise(F.col("derived_assets")))
    return op.failure_stats(f.withColumn("type", F.when(F.col("doc_id") % 4 == 0, "mapping").otherwise(F.col("type")))).withColumn("asset_conversion_rate", F.round("asset_conversion_rate", 6))


def f06_refused(spark, d):
    f = _fails(Tables(spark, d))
    f = f.withColumn("stage", F.when(F.col("doc_id") % 7 == 1, "cooking").otherwise(F.col("stage"))).withColumn("type", F.when(F.col("doc_id") % 5 == 2, F.lit(None)).otherwise(F.col("type")))
    return op.with_vocabulary_check(f).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def f06_resolve(spark, d):
    f = _fails(Tables(spark, d))
    r = f.where("doc_id % 2 = 0").select("fail_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("A1"))).otherwise(F.array().cast("array<string>")).alias("assets"))
    return op.resolve(f, r).groupBy("outcome", "resolved").agg(F.count(F.lit(1)).alias("n"))


def f07(spark, d):
    src = ["KOSIS_DOMESTIC", "UNKNOWN", "PRIVATE_SOURCE"]

    def name(k):
        return F.when(k == 0, src[0]).when(k == 1, src[1]).otherwise(src[2])
    p = Tables(spark, d).documents.select(name(F.col("doc_id") % 3).alias("gold"), name(F.col("n_chars") % 3).alias("pred"))
    return op.routing_metrics(p)


def f08(spark, d):
    t = Tables(spark, d)
    gold = t.orders.select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 10 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.col("o_custkey").cast("string"), (F.col("o_custkey") % 7).cast("string"))).alias("gold_ids"))
    hits = t.table_hits.select(F.col("claim_id").alias("case_id"), "rank", (F.col("tbl") % 20).cast("string").alias("tbl_id"))
    return op.eval_mapping(gold, hits, 3)


def f09(spark, d):
    """Four paths over raw and generated queries.  Both modes are searched together (even and odd ids), so every path
    runs once; the hybrid path fuses the lists of the first two."""
    qs, cat = rq._inputs(spark, d)
    from statproof.operators import ranking
    both = qs.select(F.col("qid"), F.explode(F.array(
        F.struct(F.lit(0).alias("m"), F.col("query").alias("q")), F.struct(F.lit(1).alias("m"), F.regexp_replace("query", r"brand\d+", "").alias("q")))).alias("x"))
    both = both.select((F.col("qid") * 2 + F.col("x.m")).alias("qid"), F.col("x.q").alias("query"))
    cols = ["qid", "rank", "ord"]
    overlap, tfidf = ranking.search_overlap(both, cat, 5).select(cols), ranking.search_tfidf(both, cat, 5).select(cols)
    lists = overlap.withColumn("path_no", F.lit(0)).unionByName(tfidf.withColumn("path_no", F.lit(1)))
    paths = {"overlap": overlap, "tfidf": tfidf, "hybrid": ranking.rrf(lists).select(cols), "substring": ranking.search_substring(both, cat, 3).select(cols)}
    found = None
    for name, hits in paths.items():
        hits = hits.select(F.lit(name).alias("path"), F.when(F.col("qid") % 2 == 0, "raw").otherwise("gen").alias("mode"), F.floor(F.col("qid") / 2).alias("qid"), "rank", "ord")
        found = hits if found is None else found.unionByName(hits)
    return op.eval_paths(qs.select("qid", F.col("qid").alias("gold_ord")), found)


def f10(spark, d):
    t = Tables(spark, d)
    cases = t.lineitem.select(F.col("l_orderkey").alias("candidate_id"), F.when(F.col("l_orderkey") % 9 != 0, F.col("l_partkey")).alias("tbl_id"))
    return op.e2e_progress(cases, t.part.where("p_size <> 7").select(F.col("p_partkey").alias("tbl_id")), t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("candidate_id")))


def f11(spark, d):
    v = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("case_id"), F.when(F.col("l_returnflag") == "A", "match").when(F.col("l_returnflag") == "R", "unverifiable").when(F.col("l_linenumber") > 5, "mismatch").alias("verdict"),
                                         F.when(F.col("l_linestatus") == "O", F.col("l_partkey").cast("string")).alias("snapshot_id"))
    return op.e2e_summary(v)


def f12(spark, d):
    t = Tables(spark, d)
    det = op.eval_detection(_det(t), "truth", "rule_candidate").select(F.lit("detection_f1").alias("metric"), F.col("f1").alias("value"))
    acc = op.classification_report(t.label_pairs).select(F.lit("verdict_accuracy").alias("metric"), F.col("accuracy").alias("value"))
    fb = op.fallback_metrics(t.label_pairs).select(F.lit("fallback_f1").alias("metric"), F.col("f1").alias("value"))
    return op.metric_gate(det.unionByName(acc).unionByName(fb))


FIELDS = ["is_claim", "gold_label"]


def f13(spark, d):
    t = Tables(spark, d)
    return op.agreement(t.annotator_a, t.annotator_b, FIELDS)


def f14(spark, d):
    t = Tables(spark, d)
    m = op.merge_labels(t.annotator_a, t.annotator_b, FIELDS, t.annotator_a.where("row_id % 11 = 0").select("row_id"))
    return m.select("row_id", "outcome", F.array_join("differences", ";").alias("differences"))


def f15(spark, d):
    x = Tables(spark, d).documents.select("doc_id", F.col("lang").alias("domain"), F.col("source").alias("claim_type"), F.col("source").alias("source_type"), (F.col("doc_id") % 5 != 0).alias("is_positive"))
    s = op.stratified_sample(x, 60, {"en": 0.38, "fr": 0.31, "de": 0.19, "es": 0.12}, "doc_id")
    return s.groupBy("kind", F.when(F.col("kind") == "positive", F.col("domain")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_distinct"))


def _issues(t):
    return op.validate_gold(t.gold_rows, REQUIRED, VOCAB, ["claim_value"])


def f16(spark, d):
    return _issues(Tables(spark, d))


def f17(spark, d):
    t = Tables(spark, d)
    return op.parity(t.gold_rows, t.gold_rows_b, ["sentence", "domain", "claim_value", "gold_label"])


def f18(spark, d):
    t = Tables(spark, d)
    return op.gold_progress(t.gold_rows, TARGETS, _issues(t))


def f19(spark, d):
    t = Tables(spark, d)
    new = t.gold_rows_b.withColumn("sentence", F.when(F.col("row_no") % 2 == 0, F.concat("sentence", F.lit(" new"))).otherwise(F.col("sentence")))
    return op.append_gold(t.gold_rows, new, ["match", "mismatch"]).select("row_no", "gold_no", "sentence")


def f19_rules(spark, d):
    """Part types as rule cards: the first word is their type, large parts have a pattern."""
    p = Tables(spark, d).part
    rules = p.select(F.col("p_partkey").alias("rule_id"), F.when(F.col("p_size") % 9 > 0, F.split("p_type", " ")[0]).alias("type"), F.when(F.col("p_size") > 20, F.col("p_name")).alias("pattern"))
    return op.rule_stats(rules)


def f19_aliases(spark, d):
    p = Tables(spark, d).part
    return op.alias_stats(p.select(F.col("p_name").alias("alias"), F.col("p_brand").alias("canonical"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("F"), F.col("p_partkey"))).when(F.col("p_size") % 3 == 1, "user").alias("origin")))


def f19_stats(spark, d):
    return op.asset_stats(Tables(spark, d).gold_rows)


QUERIES = {"f01_eval_detection": f01, "f01_detection_misses": f01_misses, "f02_eval_verdict": f02, "f03_classification_report": f03, "f03_class_metrics": f03_classes, "f04_fallback_metrics": f04,
           "f05_diff_runs": f05, "f06_failure_stats": f06, "f06_refused_failures": f06_refused, "f06_resolve_failures": f06_resolve, "f07_routing_metrics": f07, "f08_eval_mapping": f08, "f09_eval_paths": f09, "f10_e2e_progress": f10, "f11_e2e_summary": f11,
           "f12_metric_gate": f12, "f13_agreement": f13, "f14_merge_labels": f14, "f15_stratified_sample": f15, "f16_validate_gold": f16, "f17_parity": f17, "f18_gold_progress": f18, "f19_append_gold": f19, "f19_asset_stats": f19_stats, "f19_rule_stats": f19_rules, "f19_alias_stats": f19_aliases}


def _prf(tp="tp", fp="fp", fn="fn"):
    p, r = f"CASE WHEN {tp} + {fp} = 0 THEN 0 ELSE {tp} / ({tp} + {fp}) END", f"CASE WHEN {tp} + {fn} = 0 THEN 0 ELSE {tp} / ({tp} + {fn}) END"
    return f"CAST(round({p}, 4) AS DOUBLE) AS precision, CAST(round({r}, 4) AS DOUBLE) AS recall, CAST(round(CASE WHEN {tp} = 0 THEN 0 ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END, 4) AS DOUBLE) AS f1"


_D = with_clause("detector_rows") + ", t AS (SELECT *, review = 'true_candidate' AS g FROM detector_rows)"
_CM = "count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn"
_DET = _D + f", c AS (SELECT {_CM} FROM (SELECT g, rule_candidate AS p FROM t))"
_LP = with_clause("label_pairs") + """, lb AS (SELECT gold AS label FROM label_pairs UNION SELECT pred FROM label_pairs),
  cl AS (SELECT label, (SELECT count(*) FROM label_pairs WHERE gold = label AND pred = label) AS tp, (SELECT count(*) FROM label_pairs WHERE gold <> label AND pred = label) AS fp,
    (SELECT count(*) FROM label_pairs WHERE gold = label AND pred <> label) AS fn FROM lb),""" + f" cp AS (SELECT *, {_prf()} FROM cl)"
_G = with_clause("gold_rows")
_ISS = _G + """, z AS (SELECT *, min(row_no) OVER (PARTITION BY claim_id) AS fid, min(row_no) OVER (PARTITION BY lower(sentence)) AS fs FROM gold_rows),
  iss AS (SELECT row_no, claim_id, 'required_field' AS code, 'sentence' AS field FROM z WHERE sentence = '' UNION ALL SELECT row_no, claim_id, 'required_field', 'claim_value' FROM z WHERE claim_value = ''
    UNION ALL SELECT row_no, claim_id, 'invalid_domain', 'domain' FROM z WHERE domain = 'other' UNION ALL SELECT row_no, claim_id, 'invalid_review_status', 'review_status' FROM z WHERE review_status = 'pending'
    UNION ALL SELECT row_no, claim_id, 'invalid_gold_label', 'gold_label' FROM z WHERE gold_label = 'maybe' UNION ALL SELECT row_no, claim_id, 'duplicate_claim_id', 'claim_id' FROM z WHERE fid < row_no
    UNION ALL SELECT row_no, claim_id, 'duplicate_sentence', 'sentence' FROM z WHERE sentence <> '' AND fs < row_no UNION ALL SELECT row_no, claim_id, 'approved_required', 'claim_value' FROM z WHERE review_status = 'approved' AND claim_value = '')"""
_BOTH = r", pq AS (SELECT qid * 2 AS qid, query FROM part_queries UNION ALL SELECT qid * 2 + 1, regexp_replace(query, 'brand\d+', '', 'g') FROM part_queries)"
_SUBSTRING = rq.ORACLE["c04_search_substring"].removeprefix(rq._IN).rsplit(" SELECT qid, rank, ord, score FROM r", 1)[0]
_PATHS = rq._IN + _BOTH + (rq._C01 + rq._C02 + _SUBSTRING).replace("FROM part_queries", "FROM pq") + """,
  u3 AS (SELECT qid, ord, rank, 0 AS p FROM ov WHERE rank <= 3 UNION ALL SELECT qid, ord, rank, 1 FROM tf WHERE rank <= 3),
  f3 AS (SELECT qid, ord, sum(1.0 / (60 + rank)) AS score, min(p * 10 + rank) AS fst FROM u3 GROUP BY qid, ord),
  hy AS (SELECT qid, ord, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, fst) AS rank FROM f3),
  al AS (SELECT 'overlap' AS path, qid, ord, rank FROM ov UNION ALL SELECT 'tfidf', qid, ord, rank FROM tf UNION ALL SELECT 'hybrid', qid, ord, rank FROM hy UNION ALL SELECT 'substring', qid, ord, rank FROM r),
  pm AS (SELECT DISTINCT path, qid % 2 AS odd FROM al WHERE rank <= 3),
  ht AS (SELECT path, qid % 2 AS odd, count(*) FILTER (rank = 1) AS h1, count(*) AS h3, sum(1.0 / rank) AS t FROM al WHERE rank <= 3 AND ord = qid // 2 GROUP BY 1, 2),
  m AS (SELECT path, odd, coalesce(h1, 0) AS h1, coalesce(h3, 0) AS h3, round(coalesce(t, 0) / (SELECT count(*) FROM part_queries), 6) AS mrr FROM pm LEFT JOIN ht USING (path, odd))
  SELECT m.path, CASE WHEN odd = 0 THEN 'raw' ELSE 'gen' END AS mode, h1, h3, mrr, CASE WHEN odd = 1 THEN h3 - (SELECT z.h3 FROM m z WHERE z.path = m.path AND z.odd = 0) END AS gain,
    odd = 1 AND path = (SELECT arg_max(path, (h3, mrr)) FROM m WHERE odd = 1) AS best FROM m"""

ORACLE = {
    "f01_eval_detection": _DET + f" SELECT *, {_prf()} FROM c",
    "f01_detection_misses": _D + " SELECT CASE WHEN rule_candidate THEN 'detect_fp' ELSE 'detect_fn' END AS kind, lang, count(*) AS n FROM t WHERE g <> rule_candidate GROUP BY 1, 2",
    "f02_eval_verdict": """SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'mismatch' WHEN l_partkey % 7 = 0 THEN 'unverifiable' ELSE 'match' END AS gold,
      CASE l_partkey % 7 WHEN 0 THEN 'unverifiable' WHEN 1 THEN 'mismatch' ELSE 'match' END AS pred, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "f03_classification_report": _LP + " SELECT (SELECT count(*) FROM label_pairs) AS n, round((SELECT count(*) FROM label_pairs WHERE gold = pred) / (SELECT count(*) FROM label_pairs), 4) AS accuracy, round(avg(f1), 4) AS macro_f1 FROM cp",
    "f03_class_metrics": _LP + " SELECT * FROM cp",
    "f04_fallback_metrics": _LP + " SELECT * EXCLUDE (label) FROM cp WHERE label = 'unverifiable'",
    "f05_diff_runs": with_clause("detector_rows") + """, r AS (SELECT run_id, round(avg(CASE WHEN rule_candidate THEN 1 ELSE 0 END), 4) AS rule_rate, round(avg(n_chars), 2) AS chars FROM detector_rows GROUP BY 1),
      u AS (SELECT 'rule_rate' AS metric, run_id AS run_no, rule_rate AS value FROM r UNION ALL SELECT 'chars', run_id, chars FROM r), l AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY run_no) AS prev FROM u)
      SELECT metric, run_no, prev, value AS now, round(value - prev, 4) AS delta FROM l WHERE prev IS NOT NULL""",
    "f06_failure_stats": _D + """, m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'mapping' ELSE 'detection' END AS type FROM t WHERE g <> rule_candidate)
      SELECT type, count(*) AS n, count(*) FILTER (doc_id % 3 = 0) AS resolved, round(count(*) FILTER (doc_id % 6 = 0) / count(*) FILTER (doc_id % 3 = 0), 6) AS asset_conversion_rate FROM m GROUP BY 1""",
    "f06_refused_failures": _D + " SELECT CASE WHEN doc_id % 7 = 1 THEN 'unknown_stage' WHEN doc_id % 5 = 2 THEN 'unknown_type' END AS problem, count(*) AS n FROM t WHERE g <> rule_candidate GROUP BY 1",
    "f06_resolve_failures": _D + """, m AS (SELECT CASE WHEN doc_id % 2 <> 0 THEN 'open' WHEN doc_id % 3 = 0 THEN 'resolved' ELSE 'rejected_no_asset' END AS outcome FROM t WHERE g <> rule_candidate)
      SELECT outcome, outcome = 'resolved' AS resolved, count(*) AS n FROM m GROUP BY 1""",
    "f07_routing_metrics": """WITH a AS (SELECT doc_id % 3 AS g, n_chars % 3 AS p FROM documents), c AS (SELECT count(*) AS n, count(*) FILTER (g = p) AS hit, count(*) FILTER (p = 1) AS unk, count(*) FILTER (g = 0 AND p = 0) AS tp, count(*) FILTER (p = 0) AS pp, count(*) FILTER (g = 0) AS gp FROM a)
      SELECT n, round(hit / n, 4) AS source_type_accuracy, round(tp / pp, 4) AS official_precision, round(tp / gp, 4) AS official_recall, round(unk / n, 4) AS unknown_rate FROM c""",
    "f08_eval_mapping": with_clause("table_hits") + """, g AS (SELECT o_orderkey AS c, CASE WHEN o_orderkey % 10 = 0 THEN [] ELSE list_distinct([CAST(o_custkey AS STRING), CAST(o_custkey % 7 AS STRING)]) END AS ids FROM orders),
      h AS (SELECT claim_id AS c, list(DISTINCT CAST(tbl % 20 AS STRING)) FILTER (rank = 1) AS t1, list(DISTINCT CAST(tbl % 20 AS STRING)) FILTER (rank <= 3) AS tk FROM table_hits GROUP BY 1),
      j AS (SELECT g.c, ids, len(list_intersect(ids, coalesce(t1, []))) AS i1, len(list_intersect(ids, coalesce(tk, []))) AS ik FROM g LEFT JOIN h ON h.c = g.c)
      SELECT count(*) FILTER (len(ids) > 0) AS evaluated, count(*) FILTER (len(ids) = 0) AS skipped, count(*) FILTER (len(ids) > 0 AND i1 > 0) AS hit_any_at_1, count(*) FILTER (len(ids) > 0 AND i1 = len(ids)) AS hit_all_at_1,
        count(*) FILTER (len(ids) > 0 AND ik > 0) AS hit_any_at_k, count(*) FILTER (len(ids) > 0 AND ik = len(ids)) AS hit_all_at_k FROM j""",
    "f10_e2e_progress": """WITH l AS (SELECT l_orderkey AS c, CASE WHEN l_orderkey % 9 <> 0 THEN l_partkey END AS t FROM lineitem), a AS (SELECT c, count(t) AS n, count(t) FILTER (t IN (SELECT p_partkey FROM part WHERE p_size <> 7)) AS k FROM l GROUP BY c)
      SELECT CASE WHEN c IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') THEN 'verdict_verified' WHEN n = 0 THEN 'no_table_mapping' WHEN k < n THEN 'needs_catalog' ELSE 'needs_coordinates_and_snapshot' END AS status, count(*) AS n FROM a GROUP BY 1""",
    "f11_e2e_summary": """WITH v AS (SELECT l_orderkey AS c, bool_or(l_returnflag NOT IN ('A', 'R') AND l_linenumber > 5) AS mm, bool_or(l_returnflag = 'A') AS m, bool_or(l_returnflag = 'R') AS u, bool_or(l_linestatus = 'O') AS b FROM lineitem GROUP BY 1)
      SELECT count(*) AS candidate_count, count(*) FILTER (mm OR m OR u) AS final_count, count(*) FILTER (mm) AS mismatch_count, count(*) FILTER (NOT mm AND m) AS match_count, count(*) FILTER (NOT mm AND NOT m AND u) AS unverifiable_count, count(*) FILTER (b) AS evidence_backed_count FROM v""",
    "f12_metric_gate": _LP.replace("WITH ", _DET + ", ", 1) + f""", m AS (SELECT 'detection_f1' AS metric, (SELECT f1 FROM (SELECT {_prf()} FROM c)) AS value, 0.8::DOUBLE AS threshold
      UNION ALL SELECT 'verdict_accuracy', round((SELECT count(*) FROM label_pairs WHERE gold = pred) / (SELECT count(*) FROM label_pairs), 4), 0.75::DOUBLE UNION ALL SELECT 'fallback_f1', (SELECT f1 FROM cp WHERE label = 'unverifiable'), 0.8::DOUBLE) SELECT *, value >= threshold AS passed FROM m""",
    "f13_agreement": """WITH p AS (SELECT 'is_claim' AS field, quality AS a, CASE WHEN doc_id % 6 = 0 THEN 1 - quality ELSE quality END AS b FROM labels UNION ALL SELECT 'gold_label', toxic, CASE WHEN doc_id % 9 = 0 THEN 1 - toxic ELSE toxic END FROM labels),
      s AS (SELECT field, count(*) AS n, count(*) FILTER (a = b) AS hit, (avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b))) AS pe FROM p GROUP BY 1) SELECT field, n, hit, round(hit / n, 6) AS rate, round(CASE WHEN pe = 1 THEN 1 ELSE (hit / n - pe) / (1 - pe) END, 6) AS kappa FROM s""",
    "f14_merge_labels": """SELECT doc_id AS row_id, CASE WHEN doc_id % 6 = 0 OR doc_id % 9 = 0 THEN 'disagree' WHEN quality = 0 THEN 'negative' WHEN doc_id % 11 = 0 THEN 'already_gold' ELSE 'merged' END AS outcome,
      array_to_string(list_filter([CASE WHEN doc_id % 6 = 0 THEN concat('is_claim:', quality, '|', 1 - quality) END, CASE WHEN doc_id % 9 = 0 THEN concat('gold_label:', toxic, '|', 1 - toxic) END], lambda x: x IS NOT NULL), ';') AS differences FROM labels""",
    "f09_eval_paths": _PATHS,
    "f15_stratified_sample": """WITH q(domain, quota) AS (VALUES ('en', 19), ('fr', 16), ('de', 10), ('es', 6))
      SELECT 'positive' AS kind, domain, least(quota, count(*)) AS n, least(quota, count(*)) AS n_distinct FROM q JOIN documents ON lang = domain AND doc_id % 5 <> 0 GROUP BY domain, quota
      UNION ALL SELECT 'negative', NULL, least(9, count(*)), least(9, count(*)) FROM documents WHERE doc_id % 5 = 0""",
    "f16_validate_gold": _ISS + " SELECT * FROM iss",
    "f17_parity": with_clause("gold_rows", "gold_rows_b") + """, a AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY row_no) AS occ FROM gold_rows), b AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY row_no) AS occ FROM gold_rows_b),
      n AS (SELECT claim_id, na, nb FROM (SELECT claim_id, count(*) AS na FROM a GROUP BY 1) FULL JOIN (SELECT claim_id, count(*) AS nb FROM b GROUP BY 1) USING (claim_id)), j AS (SELECT a.claim_id, a.domain <> b.domain AS x, a.sentence <> b.sentence AS y, a.claim_value <> b.claim_value AS z, a.gold_label <> b.gold_label AS w FROM a JOIN b USING (claim_id, occ))
      SELECT claim_id, 'duplicate_in_a' AS code, 'claim_id' AS field FROM n WHERE na > 1 UNION ALL SELECT claim_id, 'duplicate_in_b', 'claim_id' FROM n WHERE nb > 1 UNION ALL SELECT claim_id, 'missing_in_b', 'claim_id' FROM n WHERE nb IS NULL UNION ALL SELECT claim_id, 'missing_in_a', 'claim_id' FROM n WHERE na IS NULL
      UNION ALL SELECT claim_id, 'multiplicity_mismatch', 'claim_id' FROM n WHERE na <> nb UNION ALL SELECT claim_id, 'field_mismatch', 'domain' FROM j WHERE x UNION ALL SELECT claim_id, 'field_mismatch', 'sentence' FROM j WHERE y UNION ALL SELECT claim_id, 'field_mismatch', 'claim_value' FROM j WHERE z UNION ALL SELECT claim_id, 'field_mismatch', 'gold_label' FROM j WHERE w""",
    "f18_gold_progress": _ISS + """, tg AS (SELECT * FROM (VALUES ('고용', 30), ('물가', 100000), ('인구', 40), ('무역', 20)) v(name, target)), r AS (SELECT 'domain' AS kind, name, CAST(target AS BIGINT) AS target, (SELECT count(*) FROM gold_rows WHERE domain = name) AS current FROM tg
      UNION ALL SELECT 'review', review_status, NULL, count(*) FROM gold_rows GROUP BY review_status UNION ALL SELECT 'valid', 'evaluation_rows', NULL, count(*) FROM gold_rows WHERE review_status = 'approved' AND claim_id NOT IN (SELECT claim_id FROM iss))
      SELECT *, CASE WHEN target IS NULL THEN 0 ELSE greatest(0, target - current) END AS gap, CASE WHEN current < target THEN 'domain_target_under' WHEN current > target THEN 'domain_target_over' END AS issue FROM r""",
    "f19_append_gold": with_clause("gold_rows", "gold_rows_b") + """, n AS (SELECT row_no, CASE WHEN row_no % 2 = 0 THEN concat(sentence, ' new') ELSE sentence END AS sentence, gold_label FROM gold_rows_b),
      k AS (SELECT row_no, sentence FROM n WHERE gold_label IN ('match', 'mismatch') AND trim(sentence) <> '' AND trim(sentence) NOT IN (SELECT trim(sentence) FROM gold_rows) QUALIFY row_number() OVER (PARTITION BY trim(sentence) ORDER BY row_no) = 1)
      SELECT row_no, row_number() OVER (ORDER BY row_no) + (SELECT max(row_no) FROM gold_rows) AS gold_no, sentence FROM k""",
    "f19_rule_stats": """SELECT coalesce(CASE WHEN p_size % 9 > 0 THEN split_part(p_type, ' ', 1) END, '?') AS type, count(*) AS total, count(*) FILTER (p_size > 20) AS executable FROM part GROUP BY 1""",
    "f19_alias_stats": "SELECT count(*) AS total, count(*) FILTER (p_size % 3 = 0) AS from_failure FROM part",
    "f19_asset_stats": _G + " SELECT gold_label, count(*) AS n, count(*) FILTER (review_status = 'approved') AS approved FROM gold_rows GROUP BY 1",
}
