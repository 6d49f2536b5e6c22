"""DuckDB building blocks for the oracle side: text steps written in RE2 (no look-around)."""
from __future__ import annotations

from statproof.functions import lexicon as lx
from statproof.plans.fixtures import with_clause


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


_A = q(lx.BYLINE_ANCHOR)
_M = "[" + ", ".join(f"strpos(t, {q(m)})" for m in lx.FOOTER_MARKERS) + "]"
_LINE = strip("regexp_replace(" + strip(f"regexp_replace(l, {q(lx.EMAIL)}, '', 'g')") + f", {q(lx.REPORTER_TAIL)}, '')")

# raw news -> chrome cut -> clean -> unique -> sentences
ARTICLES = with_clause("news") + rf""",
o_cut0 AS (SELECT *, regexp_matches(body, {_A}) AS anchored,
  CASE WHEN regexp_matches(body, {_A}) THEN regexp_replace(substr(body, strpos(body, regexp_extract(body, {_A})) + length(regexp_extract(body, {_A}))), {q(lx.UPDATE_STAMP)}, '')
       ELSE body END AS t FROM news),
o_chrome AS (SELECT row_no, title, date, section, url, label, body AS raw_body, anchored,
  {strip(f"CASE WHEN len(list_filter({_M}, lambda x: x > 0)) = 0 THEN t ELSE substr(t, 1, list_min(list_filter({_M}, lambda x: x > 0)) - 1) END")} AS body FROM o_cut0),
o_clean AS (SELECT * REPLACE ({strip(rf"regexp_replace(array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda l: {_LINE}), lambda s: s <> '' AND NOT regexp_matches(s, {q(lx.COPYRIGHT)}) AND NOT regexp_matches(s, {q(lx.REPORTER_LINE)})), ' '), '[ \t ]+', ' ', 'g')")} AS body) FROM o_chrome),
o_section AS (SELECT * REPLACE (CASE WHEN section <> '' THEN section ELSE regexp_extract(url, {q(lx.SECTION_URL)}, 1) END AS section) FROM o_clean),
o_unique AS (SELECT * FROM o_section WHERE body <> '' QUALIFY url = '' OR row_number() OVER (PARTITION BY url ORDER BY row_no) = 1),
o_ids AS (SELECT *, concat('art_', substr(sha1(CASE WHEN trim(url) <> '' THEN trim(url) ELSE concat(trim(title), '|', trim(date)) END), 1, 12)) AS article_id FROM o_unique),
o_arrays AS (SELECT * EXCLUDE (body), body, list_filter(list_transform(string_split(regexp_replace(body, '([다요임음됨함까죠네]\.|[?!])\s+', concat('\1', chr(1)), 'g'), chr(1)),
  lambda s: {strip('s')}), lambda s: s <> '') AS sents FROM o_ids),
o_sents AS (SELECT row_no, article_id, title, date, section, url, label, CAST(i AS INT) - 1 AS sentence_idx, sents[i] AS sentence
  FROM o_arrays, unnest(range(1, len(sents) + 1)) u(i))"""

_UNITS = "%p|%|퍼센트|포인트|명|가구|건|개|원|배|위|톤|ha|㎢|호|인|세대"
_TAILS = "개년|년|월|일|분기|개월|차|시|분|초"
_HOUSE = "가구|가족|가정|체제|기업|승|실"
# groups: 1 core, 2 sign, 3 number, 4 scale, 5 month/year counter, 6 unit, 7 date tail, 8 household tail
QTY = (rf"(([+\-−])?\s*(\d{{1,3}}(?:,\d{{3}})+|\d+(?:\.\d+)?)\s*([천만억조])?\s*(?:(개월|개년)|({_UNITS}))?)"
       rf"(?:(\s*(?:{_TAILS}))|(\s*(?:{_HOUSE})))?")


def number_list(s: str) -> str:
    """List of [core, sign, number, scale, counter, unit, date tail, household tail] that are real numbers."""
    zipped = "list_zip(" + ", ".join(f"regexp_extract_all({s}, {q(QTY)}, {g})" for g in range(1, 9)) + ")"
    return (f"list_filter({zipped}, lambda m: NOT ((coalesce(m[5], '') <> '') OR (coalesce(m[6], '') = '' AND coalesce(m[7], '') <> '') "
            f"OR (coalesce(m[6], '') IN ('인', '명') AND coalesce(m[8], '') <> '')))")


def quantity_list(s: str) -> str:
    return f"list_filter({number_list(s)}, lambda m: coalesce(m[6], '') <> '' OR coalesce(m[4], '') <> '' OR contains(m[3], '.'))"


def has_number(s: str) -> str:
    return f"(len({number_list(s)}) > 0)"


def has_unit_quantity(s: str) -> str:
    return f"(len(list_filter({number_list(s)}, lambda m: coalesce(m[6], '') <> '' OR coalesce(m[4], '') <> '')) > 0)"


def candidate(s: str) -> str:
    return (f"(NOT ({s} = '' OR regexp_matches({s}, {q(lx.NOISE_ONLY)}) OR regexp_matches({s}, {q(lx.SITE_CHROME)})) AND "
            f"({has_unit_quantity(s)} OR ({has_number(s)} AND regexp_matches({s}, {q(lx.TREND_HINT)})) OR regexp_matches({s}, {q(lx.SUPERLATIVE)})))")


def compact(s: str) -> str:
    return rf"regexp_replace({s}, '\s+', '', 'g')"


def claim_type(s: str) -> str:
    return ("CASE " + " ".join(f"WHEN regexp_matches({s}, {q(p)}) THEN {q(n)}" for n, p in lx.CLAIM_TYPE_PATTERNS)
            + f" ELSE {q(lx.DEFAULT_CLAIM_TYPE)} END")


def best_keyword(s: str, group: str, what: str) -> str:
    """Longest keyword of a routing group in the text, via a sorted list scan: 'keyword', 'domain' or 'len'."""
    words = [(d, k) for d, ks in lx.DEFAULT_ROUTING[group].items() for k in ks]
    order = sorted(range(len(words)), key=lambda i: (-len(words[i][1]), i))
    value = {"keyword": lambda d, k: q(k), "domain": lambda d, k: q(d), "len": lambda d, k: str(len(k))}[what]
    return "CASE " + " ".join(
        f"WHEN contains({compact(s)}, {q(words[i][1].replace(' ', ''))}) THEN {value(*words[i])}" for i in order) + " END"


def source_cte(base: str, name: str, s: str = "sentence") -> str:
    """CTEs adding claim_type, source_type, domain, matched_keyword, route to every row of `base`."""
    r = lx.DEFAULT_ROUTING
    cols = ", ".join(f"{best_keyword(s, g, w)} AS {g}_{w}" for g in ("kosis_domestic", "other_official", "private_source", "platform_source")
                     for w in ("domain", "keyword", "len"))

    def wins(g):
        return f"{g}_len IS NOT NULL AND coalesce(kosis_domestic_len, 0) <= {g}_len"
    pick = (f"CASE WHEN claim_type = '전망형' THEN 'FORECAST_OR_OPINION' WHEN {any_of(s, r['overseas_markers'])} THEN 'OVERSEAS_SOURCE' "
            f"WHEN contains({s}, '해외') AND NOT {any_of(compact(s), r['domestic_overseas_activity'])} THEN 'OVERSEAS_SOURCE' "
            f"WHEN regexp_matches({s}, {q(lx.SURVEY_NAME)}) AND regexp_matches({s}, {q(lx.SURVEY_SCHEDULE)}) THEN 'OFFICIAL_ANNOUNCEMENT' "
            f"WHEN {wins('platform_source')} THEN 'PLATFORM_SOURCE' WHEN {wins('private_source')} THEN 'PRIVATE_SOURCE' "
            f"WHEN {wins('other_official')} THEN 'OTHER_OFFICIAL' "
            f"WHEN kosis_domestic_len IS NOT NULL AND (kosis_domestic_domain IN ({', '.join(map(q, r['complex_domains']))}) "
            f"OR claim_type IN ({', '.join(map(q, r['complex_claim_types']))})) THEN 'KOSIS_BUT_COMPLEX' "
            f"WHEN kosis_domestic_len IS NOT NULL THEN 'KOSIS_DOMESTIC' ELSE 'UNKNOWN' END")
    group = ("CASE source_type WHEN 'PLATFORM_SOURCE' THEN platform_source_{0} WHEN 'PRIVATE_SOURCE' THEN private_source_{0} "
             "WHEN 'OTHER_OFFICIAL' THEN other_official_{0} WHEN 'KOSIS_BUT_COMPLEX' THEN kosis_domestic_{0} "
             "WHEN 'KOSIS_DOMESTIC' THEN kosis_domestic_{0} ELSE {1} END")
    route = "CASE source_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.ROUTE_OF.items()) + " END"
    return (f"{name}_a AS (SELECT *, {claim_type(s)} AS claim_type, {cols} FROM {base}), "
            f"{name}_b AS (SELECT *, {pick} AS source_type FROM {name}_a), "
            f"{name} AS (SELECT *, {group.format('domain', q('-'))} AS domain, {group.format('keyword', q(''))} AS matched_keyword, "
            f"{route} AS route FROM {name}_b)")
