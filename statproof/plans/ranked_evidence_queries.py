"""D01-D07, D09, D20 and D24 on every table that a claim's own search finds, with their DuckDB oracles.

The claims name orders, rates, indexes and monthly counts, so that the ranked hits reach all tables of the cube."""
from __future__ import annotations

from pyspark.sql import functions as F

from statproof.functions.scale import stable
from statproof.operators import evidence as op, snapshots as snap
from statproof.plans.fixtures import Tables, with_clause
from statproof.plans.ranking_queries import _GRAMS
from statproof.plans.snapshot_queries import _stats

PAIR = ["claim_id.claim_id", "claim_id.tbl_id"]


def _catalog(t):
    c = t.catalog_tables
    return c.select(F.col("tbl_id").alias("ord"), "tbl_id", "org_id", "tbl_nm", F.col("first_prd").alias("start_prd"),
                    F.col("last_prd").alias("end_prd"), F.concat_ws(" ", "tbl_nm", "survey").alias("doc"))


def ranked(t):
    """One row per claim and candidate table; written once, because evidence operators read it several times."""
    parsed = op.parse_for_verdict(t.cube_claims.select("claim_id", "sentence", "article_date"))
    claims = stable(parsed.select("claim_id", "sentence", "article_date", "period", "q", "trend"))
    return stable(op.candidate_tables(claims, _catalog(t)))


def d01(spark, d):
    t = Tables(spark, d)
    ev = op.fetch_evidence(ranked(t).select("claim_id", "tbl_id", "rank", "period"), t.official_stats)
    return ev.groupBy("claim_id", "tbl_id", "rank", "prd_se").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def d02(spark, d):
    t = Tables(spark, d)
    return op.pick_category(op.per_table(ranked(t)), t.official_stats).select(*PAIR, "c1_pick")


def d03(spark, d):
    t = Tables(spark, d)
    ev = op.match_basis(op.category_evidence(op.per_table(ranked(t)), t.official_stats))
    return ev.groupBy("claim_id", "basis", "basis_missing", "basis_used").agg(F.count(F.lit(1)).alias("n")).select(
        *PAIR, "basis", "basis_missing", "basis_used", "n")


def d04(spark, d):
    """Every row of the cube again under a second item, so that a total can win over another item where there is one."""
    t = Tables(spark, d)
    both = t.official_stats.unionByName(t.official_stats.withColumn("itm_nm", F.lit("생활지수")))
    ev = op.prefer_total(op.category_evidence(op.per_table(ranked(t)), both))
    return ev.groupBy("claim_id", "itm_nm").agg(F.count(F.lit(1)).alias("n")).select(*PAIR, "itm_nm", "n")


def d05(spark, d):
    """The guards D05, D06 and D07 of every pair."""
    t = Tables(spark, d)
    pairs = op.per_table(ranked(t))
    ev = stable(op.category_evidence(pairs, t.official_stats))
    risk = op.guard_base_year(pairs).select("claim_id", F.coalesce("base_year_risk", F.lit(False)).alias("base_year_risk"))
    return op.guard_granularity(ev).join(op.guard_revision(ev), "claim_id").join(risk, "claim_id").select(
        *PAIR, "granularity_mismatch", "latest", "stale", "base_year_risk")


def d09(spark, d):
    t = Tables(spark, d)
    current = stable(op.per_table(ranked(t)).where("trend IN ('up', 'down')"))
    earlier = current.withColumn("period", op.year_before(F.col("period")))
    rates = op.change_rate(op.category_evidence(current, t.official_stats), op.category_evidence(earlier, t.official_stats))
    return rates.select(*PAIR, F.round("rate", 6).alias("rate"), "direction")


def _subjects(t):
    """Pairs with the cube's name of the claim's nation."""
    subject = F.when(F.col("c1") == "전국", F.col("c1")).otherwise(F.concat(F.lit("국가 : "), "c1"))
    return op.per_table(ranked(t).join(t.cube_claims.select("claim_id", subject.alias("subject")), "claim_id"))


def d20(spark, d):
    """Every pair against the stored records of the table's first indicator."""
    t = Tables(spark, d)
    records = snap.snapshot_records(t.official_stats)
    first = records.groupBy("tbl_id").agg(F.min("indicator").alias("evidence_indicator"))
    claims = _subjects(t).join(first, "tbl_id").select("claim_id", "sentence", F.col("article_date").alias("date"), "tbl_id", "evidence_indicator",
                                                       F.create_map(F.lit("국가"), "subject").alias("evidence_selection"))
    return snap.compare_snapshot(claims, records).select(*PAIR, "status", "gate")


def d24(spark, d):
    t = Tables(spark, d)
    claims = _subjects(t).select("claim_id", "tbl_id", "subject", "period", F.lit("건").alias("unit"), F.lit("").alias("comparison"))
    return snap.recommend_coords(snap.coordinate_axes(_stats(t)), claims).select(*PAIR, "label", "value")


QUERIES = {"d01_ranked_evidence": d01, "d02_ranked_category": d02, "d03_ranked_basis": d03, "d04_ranked_totals": d04,
           "d05_ranked_guards": d05, "d09_ranked_rates": d09, "d20_ranked_snapshot": d20, "d24_ranked_coords": d24}

_CAND = with_clause("cube_claims", "official_stats", "catalog_tables") + f""",
  dg AS (SELECT tbl_id, tbl_nm, CAST(substr(first_prd, 1, 4) AS INT) AS lo, CAST(substr(last_prd, 1, 4) AS INT) AS hi,
    {_GRAMS.format("concat_ws(' ', tbl_nm, survey)")} AS dgr FROM catalog_tables),
  pc AS (SELECT *, CASE k WHEN 7 THEN y + 2 ELSE y END AS yy,
    CASE WHEN k = 12 THEN concat(y, lpad(CAST(m AS STRING), 2, '0')) WHEN k = 7 THEN CAST(y + 2 AS STRING) ELSE CAST(y AS STRING) END AS p,
    {_GRAMS.format('sentence')} AS qgr FROM cube_claims),
  sc AS (SELECT pc.* EXCLUDE (qgr), dg.* EXCLUDE (dgr), len(list_intersect(qgr, dgr)) AS inter, len(qgr) + len(dgr) AS both_n FROM pc, dg),
  hit AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY round(inter / sqrt(both_n - inter), 4) DESC, tbl_id) AS r FROM sc WHERE inter > 0),
  cand AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY r) AS rank FROM hit WHERE r <= 10 AND yy BETWEEN lo AND hi),
  num AS (SELECT tbl_id, c1_nm, c2_nm, itm_nm, prd_de, lst_chn_de, TRY_CAST(replace(dt, ',', '') AS DOUBLE) AS value FROM official_stats
    WHERE TRY_CAST(replace(dt, ',', '') AS DOUBLE) IS NOT NULL),
  cube AS (SELECT *, prd_de AS p FROM num UNION ALL SELECT *, substr(prd_de, 1, 4) FROM num WHERE length(prd_de) > 4),
  cats AS (SELECT DISTINCT tbl_id, p, c1_nm, trim(regexp_extract(c1_nm, '[^:]*$')) AS tail FROM cube)"""
_PICK = _CAND + """,
  named AS (SELECT claim_id, tbl_id, first(c1_nm ORDER BY length(tail) DESC, c1_nm) AS c1_named FROM cand JOIN cats USING (tbl_id, p)
    WHERE contains(sentence, tail) GROUP BY claim_id, tbl_id),
  pick AS (SELECT cand.*, coalesce(c1_named, whole.c1_nm) AS c1_pick FROM cand LEFT JOIN named USING (claim_id, tbl_id)
    LEFT JOIN (SELECT tbl_id, p, c1_nm FROM cats WHERE c1_nm = '전국') whole USING (tbl_id, p)),
  ev AS (SELECT pick.*, c1_nm, c2_nm, itm_nm, prd_de, lst_chn_de, value FROM pick JOIN cube ON cube.tbl_id = pick.tbl_id AND cube.p = pick.p AND c1_nm = c1_pick
    UNION ALL SELECT pick.*, c1_nm, c2_nm, itm_nm, prd_de, lst_chn_de, value FROM pick JOIN cube ON cube.tbl_id = pick.tbl_id AND cube.p = pick.p WHERE c1_pick IS NULL)"""
_NATION = "CASE WHEN c1 = '전국' THEN c1 ELSE concat('국가 : ', c1) END"

ORACLE = {
    "d01_ranked_evidence": _CAND + """ SELECT claim_id, tbl_id, rank, CASE WHEN k = 12 THEN 'M' ELSE 'Y' END AS prd_se, count(*) AS n, round(sum(value), 3) AS total
      FROM cand JOIN cube USING (tbl_id, p) GROUP BY ALL""",
    "d02_ranked_category": _PICK + " SELECT claim_id, tbl_id, c1_pick FROM pick",
    "d03_ranked_basis": _PICK + """, b AS (SELECT *, CASE WHEN k = 6 THEN '전년' ELSE '' END AS basis, contains(replace(itm_nm, ' ', ''), '전년') AND k = 6 AS fit FROM ev),
      a AS (SELECT claim_id, tbl_id, bool_or(fit) AS held, count(DISTINCT itm_nm) > 1 AS multi FROM b GROUP BY ALL)
      SELECT claim_id, tbl_id, basis, basis <> '' AND NOT held AND multi AS basis_missing, basis <> '' AND (held OR multi) AS basis_used, count(*) AS n
      FROM b JOIN a USING (claim_id, tbl_id) WHERE basis = '' OR fit OR NOT held GROUP BY ALL""",
    "d04_ranked_totals": _PICK + """, b AS (SELECT claim_id, tbl_id, itm_nm FROM ev UNION ALL SELECT claim_id, tbl_id, '생활지수' FROM ev),
      a AS (SELECT claim_id, tbl_id, bool_or(contains(itm_nm, '총지수')) AS held FROM b GROUP BY ALL)
      SELECT claim_id, tbl_id, itm_nm, count(*) AS n FROM b JOIN a USING (claim_id, tbl_id) WHERE NOT held OR contains(itm_nm, '총지수') GROUP BY ALL""",
    "d05_ranked_guards": _PICK + """ SELECT claim_id, tbl_id, any_value(k) IN (11, 12) AND NOT bool_or(length(prd_de) = 6) AS granularity_mismatch, max(lst_chn_de) AS latest,
      max(lst_chn_de) > any_value(article_date) AS stale, any_value(k) = 8 AND regexp_matches(any_value(tbl_nm), '지수.*[0-9]{4}=100') AS base_year_risk FROM ev GROUP BY claim_id, tbl_id""",
    "d09_ranked_rates": _PICK + """, z AS (SELECT c.claim_id, c.tbl_id, 100.0 * (a.value - b.value) / b.value AS rate FROM pick c
        JOIN cube a ON a.tbl_id = c.tbl_id AND a.p = c.p AND a.c1_nm = c1_pick AND a.c2_nm = '계'
        JOIN cube b ON b.tbl_id = c.tbl_id AND b.p = CAST(c.yy - 1 AS STRING) AND b.c1_nm = c1_pick AND b.c2_nm = '계' WHERE k IN (5, 10))
      SELECT claim_id, tbl_id, round(rate, 6) AS rate, CASE WHEN rate > 0 THEN 'up' ELSE 'down' END AS direction FROM z""",
    "d20_ranked_snapshot": _CAND + f""", q AS (SELECT *, {_NATION} AS subject, CASE WHEN k IN (5, 6) THEN '%' WHEN k = 10 THEN '명' WHEN k = 8 THEN '' ELSE '건' END AS qu,
        CASE k WHEN 1 THEN n + 7 + n // 5 WHEN 2 THEN n - 1 WHEN 3 THEN n - 5 WHEN 8 THEN (1000 + coalesce(tenths, 15)) / 10 WHEN 10 THEN n * 10000 ELSE n END AS qv FROM cand),
      ind AS (SELECT tbl_id, min(itm_nm) AS itm_nm FROM official_stats GROUP BY 1),
      own AS (SELECT o.* FROM official_stats o JOIN ind USING (tbl_id, itm_nm)),
      slices AS (SELECT DISTINCT tbl_id, prd_de AS p, TRUE AS here FROM own),
      rec AS (SELECT tbl_id, prd_de AS p, c1_nm AS subject, first(unit_nm ORDER BY c2_nm, dt) AS ru, first(TRY_CAST(replace(dt, ',', '') AS DOUBLE) ORDER BY c2_nm, dt) AS rv, TRUE AS held FROM own GROUP BY ALL),
      g AS (SELECT claim_id, tbl_id, qv, rv, CASE WHEN k = 9 THEN 'no_quantity' WHEN here IS NULL THEN 'period' WHEN held IS NULL THEN 'selection' WHEN qu = '%' THEN 'value_kind'
        WHEN qu <> ru THEN 'unit' WHEN rv IS NULL THEN 'unreadable_value' END AS gate FROM q LEFT JOIN slices USING (tbl_id, p) LEFT JOIN rec USING (tbl_id, p, subject))
      SELECT claim_id, tbl_id, CASE WHEN gate IS NOT NULL THEN 'not_comparable' WHEN abs(qv - rv) <= 0 THEN 'match' ELSE 'mismatch' END AS status, coalesce(gate, 'compared') AS gate FROM g""",
    "d24_ranked_coords": _CAND + f""", q AS (SELECT claim_id, tbl_id, p, {_NATION} AS subject FROM cand)
      SELECT claim_id, tbl_id, '시점' AS label, p AS value FROM q WHERE EXISTS (SELECT 1 FROM official_stats o WHERE o.tbl_id = q.tbl_id AND o.prd_de = q.p)
      UNION ALL SELECT claim_id, tbl_id, '단위', '건' FROM q WHERE EXISTS (SELECT 1 FROM official_stats o WHERE o.tbl_id = q.tbl_id AND o.unit_nm = '건')
      UNION ALL SELECT claim_id, tbl_id, '국가', subject FROM q WHERE EXISTS (SELECT 1 FROM official_stats o WHERE o.tbl_id = q.tbl_id AND o.c1_nm = q.subject)""",
}
