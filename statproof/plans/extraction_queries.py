"""Registered queries B01-B18 with their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from statproof.functions import lexicon as lx, text as tx
from statproof.operators import corpus, dictionaries, extraction as op
from statproof.plans import oracle_parts as o
from statproof.plans.fixtures import Tables, with_clause

RULES = [("R-01", "유학생"), ("R-02", r"\b[Tt]he\s+\w+ing\b"), ("R-03", r"역대\s*최고")]
ALIASES = [("취업자 수", "취업자 통계"), ("소비자물가", "소비자물가지수 등락률"), ("출생아", "출생아 인구동향"), ("서울 출생아", "서울시 출생 통계")]
KEYS = ["row_no", "sentence_idx"]


def sentences(spark, d):
    return corpus.split_sentences(corpus.prepare_articles(Tables(spark, d).news))


def b01(spark, d):
    return (op.extract_quantities(sentences(spark, d), KEYS)
            .select(*KEYS, F.col("q_idx").cast("long").alias("q_idx"), "value", "scale", "unit", "composed_unit", "normalized_value", "raw", "decimals"))


def b01_spans(spark, d):
    """Spans must cut the raw text back out of the sentence."""
    q = sentences(spark, d).select(*KEYS, "sentence", F.posexplode(tx.quantities(op.S())).alias("i", "q"))
    cut = tx.strip(F.substring("sentence", F.col("q.span_start") + 1, F.col("q.span_end") - F.col("q.span_start")))
    return q.select(*KEYS, F.col("i").cast("long").alias("q_idx"), cut.alias("cut"))


def b02(spark, d):
    return op.resolve_period(sentences(spark, d)).select(*KEYS, F.coalesce("period", F.lit("")).alias("period"))


def b03(spark, d):
    return op.claim_op(sentences(spark, d)).groupBy("op", "trend").agg(F.count(F.lit(1)).alias("n"))


def b04(spark, d):
    p = op.parse_claims(Tables(spark, d).claims.withColumnRenamed("article_date", "date"))
    return p.select("claim_id", F.size("quantities").cast("long").alias("n_quantities"), "period", "op", "trend", F.array_join("notes", ",").alias("notes"),
                    "parse_complete", F.col("primary.value").alias("primary_value"), F.col("primary.composed_unit").alias("primary_unit"))


def b05(spark, d):
    return op.detect_candidates(sentences(spark, d)).select(*KEYS, F.length("sentence").alias("n"))


def b06(spark, d):
    return op.apply_rules(sentences(spark, d), RULES).where("rule_id IS NOT NULL").select(*KEYS, "rule_id")


def b07(spark, d):
    return op.rule_evidence(sentences(spark, d), RULES).select(*KEYS, "candidate", "rule_label")


def b08(spark, d):
    return op.mixed_fragments(sentences(spark, d)).groupBy("mixed").agg(F.count(F.lit(1)).alias("n"))


def b09(spark, d):
    c = op.classify_source(sentences(spark, d))
    return c.select(*KEYS, "source.source_type", "source.domain", "source.claim_type", "source.route", "source.confidence", "source.matched_keyword")


def b10(spark, d):
    return op.search_terms(sentences(spark, d)).where(F.size("terms") > 0).select(*KEYS, F.array_join("terms", "|").alias("terms"))


def b11(spark, d):
    q = op.make_queries(Tables(spark, d).claims, ALIASES + [("주문 건수", "주문량 통계")])
    return q.select("claim_id", "query", F.size("variants").cast("long").alias("n_variants"))


def b11_news(spark, d):
    q = op.make_queries(sentences(spark, d), ALIASES)
    return q.select(*KEYS, F.md5("query").alias("h"), F.size("variants").cast("long").alias("n_variants"))


def b12(spark, d):
    return op.apply_aliases(sentences(spark, d), "sentence", ALIASES).select(*KEYS, F.md5("sentence").alias("h"))


def _nation_aliases(t):
    """A dictionary from the delivered nations: two aliases of a nation, one inside the other, and one that all claims share."""
    n = t.nation.selectExpr("CAST(n_nationkey AS INT) AS ord", "inline(array(struct(n_name AS alias, concat('국가 ', n_name) AS canonical), struct(concat(n_name, ' 주문') AS alias, concat(n_name, ' 발주') AS canonical)))")
    return n.unionByName(t.spark.sql("SELECT 1000 AS ord, '주문 건수' AS alias, '주문량 통계' AS canonical"))


def b12_table(spark, d):
    t = Tables(spark, d)
    return dictionaries.apply_alias_table(t.claims.select("claim_id", "sentence"), "sentence", _nation_aliases(t))


def b11_table(spark, d):
    t = Tables(spark, d)
    q = dictionaries.make_queries_from(t.claims, _nation_aliases(t))
    return q.select("claim_id", "query", F.size("variants").cast("long").alias("n_variants"))


def b06_table(spark, d):
    t = Tables(spark, d)
    rules = t.nation.selectExpr("CAST(n_nationkey AS INT) AS ord", "n_name AS rule_id", "concat(n_name, ' 주문 (?:건수|증감률)는') AS pattern", "n_name AS literal").unionByName(
        spark.sql(r"SELECT 10 AS ord, 'shared' AS rule_id, r'\d건에\s' AS pattern, '건에' AS literal UNION ALL SELECT -1, 'open', r'역대\s*최대', ''"))
    return dictionaries.apply_rule_table(t.claims.select("claim_id", "sentence"), rules).select("claim_id", "rule_id")


def b13(spark, d):
    p = op.claim_profiles(sentences(spark, d))
    return p.select(*KEYS, "profile.topic", "profile.indicator", "profile.period", "profile.comparison", "profile.unit", "profile.region",
                    "profile.population", F.array_join("profile.qualifiers", "|").alias("qualifiers"), "profile.context_inherited", "search_query")


def b14(spark, d):
    return op.article_period(sentences(spark, d)).select("article_id", "period", F.col("row_index").cast("long").alias("row_index"))


def b15(spark, d):
    a = op.atomic_claims(sentences(spark, d), KEYS)
    return a.select(*KEYS, F.col("claim_index").cast("long").alias("claim_index"), "subject", "value_raw", "unit")


def b16(spark, d):
    c = op.claim_cards(sentences(spark, d))
    return c.select(*KEYS, "indicator", "claim_value_raw", "unit", "period", "route", F.col("quantity_count").cast("long").alias("quantity_count"),
                    "readiness", F.array_join("readiness_reasons", ",").alias("reasons"))


def b16_reviewed(spark, d):
    cards = op.claim_cards(sentences(spark, d))
    edits = Tables(spark, d).documents.select(F.col("doc_id").alias("row_no"), F.when(F.col("doc_id") % 2 == 0, F.lit(" 2020 ")).alias("period"),
                                              F.when(F.col("doc_id") % 3 == 0, F.lit("고용률")).alias("indicator"))
    edits = edits.join(cards.select("row_no"), "row_no", "left_semi").where(F.col("indicator").isNotNull() | F.col("period").isNotNull())
    out = op.review_cards(cards, edits, "row_no")
    return out.groupBy("reviewed", "readiness", F.array_join("readiness_reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def b17(spark, d):
    j = op.judge_decisions(Tables(spark, d).judge_responses)
    return j.select("doc_id", "candidate", "judge_status", "candidate_reason", "evidence_status", F.array_join("quoted_spans", "|").alias("spans"))


def b18_capped(spark, d):
    return op.expand_periods(Tables(spark, d).period_memos, ["plan_id"], "memo", maximum=50).select("plan_id", F.col("request_idx").cast("long").alias("request_idx"), "period")


def b18(spark, d):
    e = op.expand_periods(Tables(spark, d).period_memos, ["plan_id"], "memo")
    return e.select("plan_id", F.col("request_idx").cast("long").alias("request_idx"), "period", "prd_se")


QUERIES = {
    "b01_extract_quantities": b01, "b01_quantity_spans": b01_spans, "b02_resolve_period": b02, "b03_claim_op": b03, "b04_parse_claims": b04,
    "b05_detect_candidates": b05, "b06_apply_rules": b06, "b06_rule_table": b06_table, "b07_rule_evidence": b07, "b08_mixed_fragments": b08, "b09_classify_source": b09,
    "b10_search_terms": b10, "b11_make_query": b11, "b11_make_query_news": b11_news, "b12_apply_aliases": b12, "b12_alias_table": b12_table, "b11_make_query_table": b11_table, "b13_claim_profile": b13,
    "b14_article_period": b14, "b15_atomic_claims": b15, "b16_claim_cards": b16, "b16_reviewed_cards": b16_reviewed, "b17_judge_decisions": b17,
    "b18_expand_periods": b18, "b18_capped_periods": b18_capped,
}

q = o.q
_SCALE = "CASE coalesce(m[4], '') WHEN '천' THEN 1e3 WHEN '만' THEN 1e4 WHEN '억' THEN 1e8 WHEN '조' THEN 1e12 ELSE 1 END"
_VALUE = "CAST(replace(m[3], ',', '') AS DOUBLE) * (CASE WHEN coalesce(m[2], '') IN ('-', '−') THEN -1 ELSE 1 END)"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _quantities(base, keys, s="sentence"):
    return f"""q0 AS (SELECT {keys}, {o.quantity_list(s)} AS ms FROM {base}),
      q1 AS (SELECT {keys}, i - 1 AS q_idx, ms[i] AS m FROM q0, unnest(range(1, len(ms) + 1)) u(i)),
      q2 AS (SELECT {keys}, q_idx, {_VALUE} AS value, coalesce(m[4], '') AS scale, coalesce(m[6], '') AS unit, {_SCALE} AS factor,
        {_TRIM.format('m[1]')} AS raw, CAST(greatest(1, CASE WHEN contains(m[3], '.') THEN length(m[3]) - strpos(m[3], '.') ELSE 0 END) AS INT) AS decimals FROM q1)"""


_NOISE = ["전년\\s*동월\\s*대비|전년\\s*동기\\s*대비|전년\\s*대비|작년\\s*같은\\s*달(보다)?|지난해\\s*같은\\s*(달|기간|분기)(보다)?|작년\\s*동월(보다)?|작년보다|지난해보다",
          "\\d{4}\\s*년(?:\\s*을\\s*100\\s*(?:으로|으로\\s*본)?|\\s*=\\s*100)"]


def _cleaned(s):
    for n in _NOISE:
        s = f"regexp_replace({s}, {q(n)}, ' ', 'g')"
    return s


_Y = "year(try_strptime(replace(replace(substr(trim(date), 1, 10), '.', '-'), '/', '-'), '%Y-%m-%d'))"
_SHIFT = "CASE regexp_extract(ps, {0}, 1) WHEN '올해' THEN 0 WHEN '금년' THEN 0 WHEN '지난해' THEN -1 WHEN '작년' THEN -1 WHEN '전년' THEN -1 WHEN '재작년' THEN -2 WHEN '내년' THEN 1 END"


def _period():
    """Period of `ps` (noise removed, '전년 동기' masked) for article year `ay` / month `am`."""
    def m(p, g=1):
        return f"regexp_extract(ps, {q(p)}, {g})"

    def mm(p, g=1):
        return f"lpad(CAST(CAST({m(p, g)} AS INT) AS STRING), 2, '0')"
    rel = "(올해|금년|지난해|작년|전년|재작년|내년)"
    cases = [(r"(\d{4})년\s*(\d{1,2})월", f"concat({m(lx.ABS_MONTH)}, '-', {mm(lx.ABS_MONTH, 2)})"),
             (lx.MONTH_RANGE, f"ay || '-' || {mm(lx.MONTH_RANGE)}"),
             (lx.ABS_QUARTER, f"concat({m(lx.ABS_QUARTER)}, '-Q', {m(lx.ABS_QUARTER, 2)})"),
             (lx.REL_QUARTER, f"(ay + {_SHIFT.format(q(lx.REL_QUARTER))}) || '-Q' || {m(lx.REL_QUARTER, 2)}"),
             (lx.REL_MONTH, f"(ay + {_SHIFT.format(q(lx.REL_MONTH))}) || '-' || {mm(lx.REL_MONTH, 2)}"),
             (lx.ABS_YEAR, m(lx.ABS_YEAR)),
             (rel, f"CAST(ay + {_SHIFT.format(q(rel))} AS STRING)"),
             (lx.LAST_MONTH, "CASE WHEN am = 1 THEN (ay - 1) || '-12' ELSE ay || '-' || lpad(CAST(am - 1 AS STRING), 2, '0') END"),
             (lx.QUARTER_ONLY, f"ay || '-Q' || {m(lx.QUARTER_ONLY)}"), (lx.MONTH_ONLY, f"ay || '-' || {mm(lx.MONTH_ONLY)}")]
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(ps, {q(p)}) THEN {v} END" for p, v in cases) + ", '')"


def period_cte(base, name, s="sentence"):
    return f"""{name} AS (SELECT *, {_period()} AS period FROM (SELECT *, regexp_replace({_cleaned(s)}, '전년\\s*동기', '##', 'g') AS ps,
      {_Y} AS ay, {_Y.replace('year(', 'month(')} AS am FROM {base}))"""


def _op(s="sentence"):
    return f"CASE WHEN regexp_matches({s}, {q(lx.OP_GTE)}) THEN 'gte' WHEN regexp_matches({s}, {q(lx.OP_LTE)}) THEN 'lte' ELSE 'eq' END"


def _trend(s="sentence"):
    return f"CASE WHEN regexp_matches({s}, {q(lx.TREND_UP)}) THEN 'up' WHEN regexp_matches({s}, {q(lx.TREND_DOWN)}) THEN 'down' ELSE '' END"


_RULE = "CASE " + " ".join(f"WHEN regexp_matches(sentence, {q(p)}) THEN {q(r)}" for r, p in RULES) + " END"
_LABEL = f"""CASE WHEN sentence <> '' AND NOT regexp_matches(sentence, {q(lx.NOISE_ONLY)}) AND NOT regexp_matches(sentence, {q(lx.SITE_CHROME)}) AND (
   {o.has_unit_quantity('sentence')} OR ({o.has_number('sentence')} AND regexp_matches(sentence, {q(lx.TREND_HINT)})) OR regexp_matches(sentence, {q(lx.SUPERLATIVE)}) OR {_RULE} IS NOT NULL)
   THEN CASE WHEN {o.has_unit_quantity('sentence')} THEN 'NUMERIC_UNIT' WHEN {o.has_number('sentence')} AND regexp_matches(sentence, {q(lx.TREND_HINT)}) THEN 'NUMERIC_TREND'
        WHEN regexp_matches(sentence, {q(lx.SUPERLATIVE)}) THEN 'SUPERLATIVE' ELSE {_RULE} END
   WHEN regexp_matches(sentence, {q(lx.NOISE_ONLY)}) THEN 'EXCLUDED_DATE_ONLY' WHEN regexp_matches(sentence, {q(lx.SITE_CHROME)}) THEN 'EXCLUDED_SITE_CHROME'
   WHEN regexp_matches(sentence, '\\d') AND NOT {o.has_number('sentence')} THEN 'CONTEXTUAL_NUMBER_ONLY' WHEN {o.has_number('sentence')} THEN 'NUMERIC_NO_CLAIM' ELSE 'NO_MATCH' END"""
_SRC = o.ARTICLES + ", " + o.source_cte("o_sents", "o_src")
_CONF = "CASE source_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.CONFIDENCE_OF.items()) + " END"
_HINT = "CASE domain " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.QUERY_HINTS.items()) + " ELSE '' END"


def _aliases(s, aliases):
    out = s
    for a, c in sorted(aliases, key=lambda x: -len(x[0])):
        out = f"CASE WHEN contains({s}, {q(a)}) THEN replace({out}, {q(a)}, {q(c)}) ELSE {out} END"
    return out


def _particle(t):
    return "CASE " + " ".join(f"WHEN ends_with({t}, '{p}') AND length({t}) >= {len(p) + 2} THEN substr({t}, 1, length({t}) - {len(p)})"
                              for p in sorted(lx.PARTICLES, key=len, reverse=True)) + f" ELSE {t} END"


def _tokens(x):
    noise = "^(?:" + "|".join(lx.STOP_PREFIX) + ")"
    return (f"list_filter(list_transform(regexp_extract_all({x}, '[가-힣A-Za-z]{{2,}}'), lambda t: {_particle('t')}), lambda t: length(t) >= 2 "
            f"AND t NOT IN ({', '.join(map(q, lx.STOP_TIME))}) AND NOT regexp_matches(t, {q(noise)}))")


# first occurrence keeps its place: DuckDB's list_distinct does not keep order
def _ordered_distinct(x):
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def _query_ctes(base, keys, aliases):
    # counters like 개월 are kept out of the quantity span: RE2 has no look-ahead, so they are shielded first
    qty = r"\d[\d,.]*\s*[천만억조]?\s*(?:%p|%|퍼센트|포인트|명|가구|건|개|원|배|위|톤|호|인|세대|세)?"
    return f"""k0 AS (SELECT {keys}, sentence, {_aliases('sentence', aliases)} AS t FROM {base}),
      k1 AS (SELECT *, list_transform(regexp_extract_all(t, '(\\d+)\\s*인\\s*가구', 1), lambda n: n || '인가구') AS hh,
        CASE WHEN regexp_matches(t, '\\d+\\s*인\\s*가구') THEN regexp_extract(t, '^(?s:(.*?))\\d+\\s*인\\s*가구', 1) ELSE '' END AS lead,
        replace(regexp_replace(replace(replace(regexp_replace(t, {q(lx.QUERY_DATE)}, ' ', 'g'), '개월', chr(1) || '월'), '개년', chr(1) || '년'), {q(qty)}, ' ', 'g'), chr(1), '개') AS bare FROM k0),
      k2 AS (SELECT *, {_tokens('lead')} AS lead_tok, {_tokens('bare')} AS tok FROM k1),
      k3 AS (SELECT *, {_ordered_distinct('tok')} AS dtok FROM k2),
      k4 AS (SELECT {keys}, t, CASE WHEN len(hh) > 0 THEN array_to_string(list_concat(lead_tok, hh), ' ') WHEN len(dtok) > 0 THEN array_to_string(dtok, ' ') ELSE trim(sentence) END AS query FROM k3)"""


def _alias_case(s, table):
    return "CASE " + " ".join(f"WHEN {o.any_of(o.compact(s), [a.replace(' ', '') for a in al])} THEN {q(n)}" for n, al in table) + " ELSE '' END"


def _profile_ctes(base):
    s = "sentence"
    topic = "CASE " + " ".join(f"WHEN {o.any_of(o.compact(s), [a.replace(' ', '') for a in al])} THEN {q(t)}" for t, _, al in lx.INDICATORS) + " ELSE '' END"
    ind = "CASE " + " ".join(f"WHEN {o.any_of(o.compact(s), [a.replace(' ', '') for a in al])} THEN {q(i)}" for _, i, al in lx.INDICATORS) + " ELSE '' END"
    return f"""p0 AS (SELECT *, {topic} AS t0, {ind} AS i0, {_alias_case(s, lx.PRICE_PRODUCTS)} AS prod, {_alias_case(s, lx.WORK_QUALIFIERS)} AS work,
        {_alias_case(s, lx.REGIONS)} AS r0, {_alias_case(s, lx.POPULATIONS)} AS o0,
        CASE WHEN regexp_matches(sentence, '\\d{{1,2}}월|지난달|이번달|전년동월') THEN '월' WHEN contains(sentence, '분기') THEN '분기'
             WHEN {o.any_of(s, ['지난해', '올해', '전년', '연간'])} THEN '연' ELSE '' END AS period_kind,
        CASE WHEN {o.any_of(s, ['전년동월', '지난해 같은 달', '지난해같은달'])} THEN '전년동월비' WHEN contains(sentence, '전월') THEN '전월비'
             WHEN {o.any_of(s, ['전년보다', '전년 대비', '지난해보다'])} THEN '전년 대비' ELSE '' END AS comparison,
        CASE WHEN {o.any_of(s, ['%p', '퍼센트포인트'])} THEN '%p' WHEN {o.any_of(s, ['%', '퍼센트'])} THEN '%' WHEN contains(sentence, '명') THEN '명'
             WHEN contains(sentence, '건') THEN '건' ELSE '' END AS unit_kind FROM {base}),
      p1 AS (SELECT *, CASE WHEN prod <> '' AND i0 IN ('', '물가') AND {o.any_of(s, ['가격', '물가'])} THEN '물가' ELSE t0 END AS t1,
        CASE WHEN prod <> '' AND i0 IN ('', '물가') AND {o.any_of(s, ['가격', '물가'])} THEN '소비자물가' ELSE i0 END AS i1 FROM p0),
      p2 AS (SELECT *, last_value(CASE WHEN i1 <> '' THEN {{'t': t1, 'i': i1, 'r': r0, 'o': o0}} END IGNORE NULLS) OVER (PARTITION BY article_id ORDER BY sentence_idx
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pr FROM p1),
      p3 AS (SELECT *, pr IS NOT NULL AND i1 IN ('', '물가', '인구', '고용') AND regexp_matches(sentence, {q(lx.ANAPHOR)}) AS inh FROM p2),
      prof AS (SELECT *, CASE WHEN inh THEN pr.t ELSE t1 END AS topic, CASE WHEN inh THEN pr.i ELSE i1 END AS indicator,
        CASE WHEN inh AND r0 = '' THEN pr.r ELSE r0 END AS region, CASE WHEN inh AND o0 = '' THEN pr.o ELSE o0 END AS population,
        array_to_string(list_filter([prod, work], lambda x: x <> ''), '|') AS qualifiers FROM p3)"""


_CARDS = (o.ARTICLES + ", " + o.source_cte("o_sents", "c_src") + ", " + period_cte("c_src", "c_per").replace("SELECT *, CASE", "SELECT *, CASE")
          + ", " + _profile_ctes("c_per") + f""", card0 AS (SELECT *, {o.quantity_list('sentence')} AS ms FROM prof),
  card AS (SELECT row_no, sentence_idx, indicator, CASE WHEN len(ms) = 1 THEN {_TRIM.format('ms[1][1]')} ELSE '' END AS claim_value_raw,
    CASE WHEN len(ms) = 1 AND coalesce(ms[1][6], '') <> '' THEN ms[1][6] ELSE unit_kind END AS unit, period, route, CAST(len(ms) AS BIGINT) AS quantity_count FROM card0)""")


def _ready(reviewed):
    rs = (f"list_filter([CASE WHEN indicator = '' THEN 'indicator_missing' END, CASE WHEN claim_value_raw = '' THEN 'value_missing' END, "
          f"CASE WHEN period = '' THEN 'period_missing' END, CASE WHEN quantity_count > 1 AND NOT {reviewed} THEN 'several_quantities' END], lambda x: x IS NOT NULL)")
    return (f"CASE WHEN route <> 'KOSIS_RETRIEVAL' THEN 'out_of_scope' WHEN len({rs}) > 0 THEN 'needs_review' ELSE 'ready' END AS readiness, "
            f"CASE WHEN route <> 'KOSIS_RETRIEVAL' THEN 'route_out_of_scope' ELSE array_to_string({rs}, ',') END AS reasons")


_ITEM = r"([가-힣][가-힣·\s]{0,30}?)\s*\(([^()]+)\)"
_NATIONS = """, al AS (SELECT list(concat(alias, '>', canonical) ORDER BY -length(alias), ord) AS pairs FROM (SELECT n_nationkey AS ord, n_name AS alias, '국가 ' || n_name AS canonical FROM nation
  UNION ALL SELECT n_nationkey, n_name || ' 주문', n_name || ' 발주' FROM nation UNION ALL SELECT 1000, '주문 건수', '주문량 통계'))"""
_REPLACED = ("list_reduce(pairs, lambda acc, x: CASE WHEN contains(sentence, split_part(x, '>', 1)) THEN replace(acc, split_part(x, '>', 1), split_part(x, '>', 2)) ELSE acc END, sentence)")
ORACLE = {
    "b06_rule_table": with_clause("claims") + """, ru AS (SELECT n_nationkey AS ord, n_name AS rule_id, n_name || ' 주문 (?:건수|증감률)는' AS pattern FROM nation UNION ALL SELECT 10, 'shared', '\\d건에\\s' UNION ALL SELECT -1, 'open', '역대\\s*최대')
      SELECT claim_id, arg_min(rule_id, (ord, rule_id)) AS rule_id FROM claims LEFT JOIN ru ON regexp_matches(sentence, pattern) GROUP BY claim_id""",
    "b12_alias_table": with_clause("claims") + _NATIONS + f" SELECT claim_id, {_REPLACED} AS sentence FROM claims, al",
    "b11_make_query_table": with_clause("claims") + _NATIONS + ", " + _query_ctes("claims", "claim_id", []).replace("sentence AS t FROM claims", f"{_REPLACED} AS t FROM claims, al")
    + " SELECT claim_id, query, CAST(CASE WHEN trim(query) = trim(t) THEN 1 ELSE 2 END AS BIGINT) AS n_variants FROM k4",
    "b01_extract_quantities": o.ARTICLES + ", " + _quantities("o_sents", "row_no, sentence_idx") + """ SELECT row_no, sentence_idx, q_idx, value, scale, unit,
      concat(scale, unit) AS composed_unit, value * factor AS normalized_value, raw, decimals FROM q2""",
    "b01_quantity_spans": o.ARTICLES + ", " + _quantities("o_sents", "row_no, sentence_idx") + " SELECT row_no, sentence_idx, q_idx, raw AS cut FROM q2",
    "b02_resolve_period": o.ARTICLES + ", " + period_cte("o_sents", "per") + " SELECT row_no, sentence_idx, period FROM per",
    "b03_claim_op": o.ARTICLES + f" SELECT {_op()} AS op, {_trend()} AS trend, count(*) AS n FROM o_sents GROUP BY 1, 2",
    # round trip: expected fields come from the numbers the sentence was rendered from
    "b04_parse_claims": with_clause("claims") + """ SELECT claim_id, CAST(CASE WHEN k = 9 THEN 0 ELSE 1 END AS BIGINT) AS n_quantities,
      CASE k WHEN 4 THEN CAST(y AS STRING) WHEN 7 THEN CAST(y + 2 AS STRING) ELSE CAST(y AS STRING) END AS period,
      CASE k WHEN 2 THEN 'gte' WHEN 3 THEN 'lte' ELSE 'eq' END AS op, CASE WHEN k = 5 OR k = 10 THEN 'up' ELSE '' END AS trend,
      CASE WHEN k = 9 THEN 'no_quantity' ELSE '' END AS notes, k <> 9 AS parse_complete,
      CASE k WHEN 0 THEN n WHEN 1 THEN n + 7 + n // 5 WHEN 2 THEN n - 1 WHEN 3 THEN n - 5 WHEN 5 THEN abs(coalesce(tenths, 15)) / 10.0
        WHEN 6 THEN coalesce(tenths, 15) / 10.0 WHEN 8 THEN (1000 + coalesce(tenths, 15)) / 10.0 WHEN 9 THEN NULL ELSE n END::DOUBLE AS primary_value,
      CASE k WHEN 5 THEN '%' WHEN 6 THEN '%' WHEN 8 THEN '' WHEN 9 THEN NULL WHEN 10 THEN '만명' ELSE '건' END AS primary_unit FROM claims""",
    "b05_detect_candidates": o.ARTICLES + f" SELECT row_no, sentence_idx, length(sentence) AS n FROM o_sents WHERE {o.candidate('sentence')}",
    "b06_apply_rules": o.ARTICLES + f" SELECT row_no, sentence_idx, {_RULE} AS rule_id FROM o_sents WHERE {_RULE} IS NOT NULL",
    "b07_rule_evidence": o.ARTICLES + f", z AS (SELECT row_no, sentence_idx, {_LABEL} AS rule_label FROM o_sents) SELECT row_no, sentence_idx, rule_label, rule_label IN ('NUMERIC_UNIT', 'NUMERIC_TREND', 'SUPERLATIVE', 'R-01', 'R-02', 'R-03') AS candidate FROM z",
    "b08_mixed_fragments": o.ARTICLES + f" SELECT len(regexp_extract_all(sentence, {q(lx.ELLIPSIS)})) >= 2 AND len(regexp_extract_all(sentence, {q(lx.NUMBER_WITH_UNIT)})) >= 2 AS mixed, count(*) AS n FROM o_sents GROUP BY 1",
    "b09_classify_source": _SRC + f" SELECT row_no, sentence_idx, source_type, domain, claim_type, route, CAST({_CONF} AS DOUBLE) AS confidence, matched_keyword FROM o_src",
    "b10_search_terms": _SRC + f" SELECT row_no, sentence_idx, CASE WHEN {_HINT} IN ('', matched_keyword) THEN matched_keyword ELSE matched_keyword || '|' || {_HINT} END AS terms FROM o_src WHERE matched_keyword <> ''",
    "b11_make_query": with_clause("claims") + ", " + _query_ctes("claims", "claim_id", ALIASES + [("주문 건수", "주문량 통계")])
    + " SELECT claim_id, query, CAST(CASE WHEN trim(query) = trim(t) THEN 1 ELSE 2 END AS BIGINT) AS n_variants FROM k4",
    "b11_make_query_news": o.ARTICLES + ", " + _query_ctes("o_sents", "row_no, sentence_idx", ALIASES)
    + " SELECT row_no, sentence_idx, md5(query) AS h, CAST(CASE WHEN trim(query) = trim(t) THEN 1 ELSE 2 END AS BIGINT) AS n_variants FROM k4",
    "b12_apply_aliases": o.ARTICLES + f" SELECT row_no, sentence_idx, md5({_aliases('sentence', ALIASES)}) AS h FROM o_sents",
    "b13_claim_profile": o.ARTICLES + ", " + _profile_ctes("o_sents") + """ SELECT row_no, sentence_idx, topic, indicator, period_kind AS period, comparison, unit_kind AS unit, region, population,
      qualifiers, inh AS context_inherited, trim(concat(replace(qualifiers, '|', ' '), ' ', indicator)) AS search_query FROM prof""",
    "b14_article_period": o.ARTICLES + ", " + period_cte("o_sents", "per") + f""" SELECT article_id, min(period) AS period, CAST(min(sentence_idx) + 1 AS BIGINT) AS row_index FROM per
      WHERE regexp_matches(sentence, {q(lx.STRONG_PERIOD)}) AND period <> '' GROUP BY article_id HAVING count(DISTINCT period) = 1""",
    "b15_atomic_claims": o.ARTICLES + f""", a0 AS (SELECT row_no, sentence_idx, list_zip(regexp_extract_all(sentence, {q(_ITEM)}, 1), regexp_extract_all(sentence, {q(_ITEM)}, 2)) AS ps FROM o_sents),
      a1 AS (SELECT row_no, sentence_idx, i, ps[i][1] AS subj, {o.quantity_list('ps[i][2]')} AS ms FROM a0, unnest(range(1, len(ps) + 1)) u(i)),
      a2 AS (SELECT *, row_number() OVER (PARTITION BY row_no, sentence_idx ORDER BY i) AS claim_index, count(*) OVER (PARTITION BY row_no, sentence_idx) AS n FROM a1 WHERE len(ms) = 1 AND coalesce(ms[1][6], '') <> '')
      SELECT row_no, sentence_idx, claim_index, {_TRIM.format(o.compact('subj').replace("''", "' '"))} AS subject, {_TRIM.format('ms[1][1]')} AS value_raw, ms[1][6] AS unit FROM a2 WHERE n >= 2""",
    "b16_claim_cards": _CARDS + f" SELECT *, {_ready('FALSE')} FROM card",
    "b16_reviewed_cards": _CARDS + f""", ed AS (SELECT * REPLACE (CASE WHEN row_no % 3 = 0 THEN '고용률' ELSE indicator END AS indicator, CASE WHEN row_no % 2 = 0 THEN '2020' ELSE period END AS period),
      row_no % 2 = 0 OR row_no % 3 = 0 AS reviewed FROM card), z AS (SELECT reviewed, {_ready('reviewed')} FROM ed) SELECT reviewed, readiness, reasons, count(*) AS n FROM z GROUP BY 1, 2, 3""",
    "b17_judge_decisions": """SELECT doc_id, CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 6 THEN TRUE END AS candidate,
      CASE CAST(doc_id % 7 AS INT) WHEN 3 THEN 'invalid_response' WHEN 4 THEN 'parse_error' WHEN 5 THEN 'parse_error' ELSE 'success' END AS judge_status,
      CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN 'has {number}' WHEN 1 THEN 'no_reason' WHEN 2 THEN 'old form' WHEN 3 THEN 'candidate_incomplete' WHEN 6 THEN 'older form' ELSE 'json_parse_failed' END AS candidate_reason,
      CASE WHEN doc_id % 7 = 0 THEN 'sufficient' ELSE 'unknown' END AS evidence_status,
      CASE WHEN doc_id % 7 = 0 THEN array_to_string(list_filter([lang, 'no such words here', 'e'], lambda w: contains(text, w)), '|') ELSE '' END AS spans FROM documents""",
    "b18_expand_periods": with_clause("period_memos") + r""", m0 AS (SELECT plan_id, memo, regexp_extract_all(memo, '\b(\d{4}-\d{2})\b', 1) AS raw, regexp_extract_all(memo, '\b(\d{4})\b', 1) AS rawy FROM period_memos),
      m1 AS (SELECT *, list_filter(raw, lambda t, i: list_position(raw, t) = i) AS ms, list_filter(rawy, lambda t, i: list_position(rawy, t) = i) AS ys FROM m0),
      m2 AS (SELECT plan_id, CASE WHEN len(ms) > 0 THEN 'M' ELSE 'Y' END AS prd_se, CASE WHEN contains(memo, '~') AND len(ms) >= 2 AND right(ms[1], 2) = right(ms[2], 2) AND CAST(left(ms[1], 4) AS INT) <= CAST(left(ms[2], 4) AS INT)
        THEN list_transform(range(CAST(left(ms[1], 4) AS INT), CAST(left(ms[2], 4) AS INT) + 1), lambda y: y || '-' || right(ms[1], 2)) WHEN len(ms) > 0 THEN ms ELSE ys END AS ps FROM m1)
      SELECT plan_id, i - 1 AS request_idx, ps[i] AS period, prd_se FROM m2, unnest(range(1, len(ps) + 1)) u(i)""",
    "b18_capped_periods": with_clause("period_memos") + r""", m0 AS (SELECT plan_id, memo, regexp_extract_all(memo, '\b(\d{4}-\d{2})\b', 1) AS raw, regexp_extract_all(memo, '\b(\d{4})\b', 1) AS rawy FROM period_memos),
      m1 AS (SELECT *, list_filter(raw, lambda t, i: list_position(raw, t) = i) AS ms, list_filter(rawy, lambda t, i: list_position(rawy, t) = i) AS ys FROM m0),
      m2 AS (SELECT plan_id, CASE WHEN len(ms) > 0 THEN 'M' ELSE 'Y' END AS prd_se, CASE WHEN contains(memo, '~') AND len(ms) >= 2 AND right(ms[1], 2) = right(ms[2], 2) AND CAST(left(ms[1], 4) AS INT) <= CAST(left(ms[2], 4) AS INT)
        THEN list_transform(range(CAST(left(ms[1], 4) AS INT), CAST(left(ms[2], 4) AS INT) + 1), lambda y: y || '-' || right(ms[1], 2)) WHEN len(ms) > 0 THEN ms ELSE ys END AS ps FROM m1)
      SELECT plan_id, i - 1 AS request_idx, ps[i] AS period FROM m2, unnest(range(1, len(ps) + 1)) u(i) ORDER BY plan_id, request_idx LIMIT 50""",
}
