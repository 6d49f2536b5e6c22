"""Input tables derived from the delivered parquet tables, in SQL that Spark and DuckDB both accept.

The delivered tables hold no news text and no statistics cube, so each operator family gets a table rendered from
them.  Values are perturbed by key so that every branch of an operator occurs; no row is left out.
"""
from __future__ import annotations

from statproof.functions.scale import stable

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
               "labels conversations").split()


def _int(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _str(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _div(x: str, n: int) -> str:
    return f"CAST(floor(({x}) / {n}) AS BIGINT)"


def _thousands(x: str) -> str:
    """Integer with thousands commas."""
    low = f"lpad({_str(f'({x}) % 1000')}, 3, '0')"
    mid = f"lpad({_str(f'({_div(x, 1000)}) % 1000')}, 3, '0')"
    return (f"CASE WHEN ({x}) < 1000 THEN {_str(x)} WHEN ({x}) < 1000000 THEN concat({_str(_div(x, 1000))}, ',', {low}) "
            f"ELSE concat({_str(_div(x, 1000000))}, ',', {mid}, ',', {low}) END")


def _tenths(x: str) -> str:
    """Integer number of tenths as a decimal text with one digit."""
    return (f"concat(CASE WHEN ({x}) < 0 THEN '-' ELSE '' END, {_str(_div(f'abs({x})', 10))}, '.', "
            f"{_str(f'abs({x}) % 10')})")


_LEAD = f"""CASE CAST(doc_id % 8 AS INT)
  WHEN 0 THEN concat('2023년 ', {_str('doc_id % 12 + 1')}, '월 취업자 수는 ', {_str('n_chars % 900 + 100')}, '만 명으로 집계됐다.')
  WHEN 1 THEN concat('지난달 소비자물가는 전년 동월 대비 ', {_tenths('n_chars % 90 + 11')}, '% 올랐다.')
  WHEN 2 THEN concat('작년 ', {_str('doc_id % 4 + 1')}, '분기 코스피 상장사 영업이익은 ', {_thousands('n_chars % 9000 + 1000')}, '억 원으로 줄었다.')
  WHEN 3 THEN concat('일본 수출은 내년 ', {_tenths('n_chars % 90 + 11')}, '% 증가할 전망이다.')
  WHEN 4 THEN concat('올해 서울 출생아는 ', {_thousands('n_chars % 90000 + 1000')}, '명을 넘어섰다. 역대 최고 기록이다.')
  WHEN 5 THEN concat('이 같은 1인 가구 비율이 ', {_tenths('n_chars % 90 + 11')}, '%p 늘었다. 해당 인구는 ', {_str('doc_id % 28 + 1')}, '일 발표됐다.')
  WHEN 6 THEN concat('배추(', {_tenths('n_chars % 90 + 11')}, '%), 사과(', {_tenths('doc_id % 90 + 11')}, '%) 물가가 올랐다. ... 실업률 3.1% ... 고용률 61.2%였다.')
  ELSE concat('미국 유학생은 12월 3일 로그인 안내를 받았다. 경기 아파트값은 ', {_tenths('n_chars % 90 + 11')}, '% 하락했다!') END"""

_BODY = f"""CASE WHEN doc_id % 29 = 5 THEN '' WHEN doc_id % 31 = 6 THEN '   '
  WHEN doc_id % 37 = 7 THEN concat('머리 입력 2024.05.06. 07:08 구독수 1', chr(10), text)
  ELSE concat(
    CASE WHEN doc_id % 3 = 0 THEN '메뉴 로그인 입력 2024.05.06. 07:08 업데이트 2024.05.06. 09:10 ' ELSE '' END,
    CASE WHEN doc_id % 5 = 0 THEN concat('홍길동 기자 = ', chr(10)) ELSE '' END,
    {_LEAD}, CASE WHEN doc_id % 7 = 0 THEN concat(' 홍길동 기자 hong.gd@news.co.kr', chr(10)) ELSE ' ' END, text,
    CASE WHEN doc_id % 4 = 0 THEN concat(chr(10), '저작권자 ⓒ 뉴스', chr(10), '끝 문장이다. 구독수 1,234 무단 전재 및 재배포 금지') ELSE '' END) END"""

SQL: dict[str, tuple[list[str], str]] = {}


def _define(name: str, deps: str, sql: str) -> None:
    SQL[name] = (deps.split(), sql)


# --- corpus -------------------------------------------------------------------------------------------------
_define("news", "", f"""
SELECT doc_id AS row_no,
  CASE WHEN doc_id % 17 = 3 THEN '' ELSE concat('Report ', {_str('doc_id % 50')}) END AS title,
  CASE WHEN doc_id % 23 = 4 THEN '' WHEN doc_id % 19 = 2 THEN 'someday'
       ELSE concat('2024.', lpad({_str('doc_id % 12 + 1')}, 2, '0'), '.', lpad({_str('doc_id % 28 + 1')}, 2, '0')) END AS date,
  CASE WHEN doc_id % 3 = 1 THEN '' ELSE 'economy' END AS section,
  CASE WHEN doc_id % 11 = 8 THEN '' ELSE concat('https://www.chosun.com/', lang, '/', {_str(_div('doc_id', 3))}) END AS url,
  {_BODY} AS body, source AS label
FROM documents""")

_define("described_pages", "", """
SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN html
  WHEN page_id % 3 = 1 THEN replace(replace(html, '<title>', '<meta name="description" content="'), '</title>', '">')
  ELSE replace(replace(html, '<title>', '<META content="'), '</title>', '" property="og:description">') END AS html
FROM pages""")
_define("risky_cells", "", f"""
SELECT doc_id, concat(CASE CAST(doc_id % 7 AS INT) WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '@' WHEN 3 THEN chr(9) WHEN 4 THEN '-' ELSE '' END,
  {_str('n_chars')}) AS cell, lang FROM documents""")

_define("judge_responses", "", """
SELECT doc_id, text AS sentence, CASE CAST(doc_id % 7 AS INT)
  WHEN 0 THEN concat('Answer {so}: {"candidate": true, "candidate_reason": "has {number}", "evidence_status": "sufficient", "quoted_spans": ["', lang, '", "no such words here", "e"]} done')
  WHEN 1 THEN '{"candidate": false, "evidence_status": "maybe", "quoted_spans": "e"}'
  WHEN 2 THEN '{"verifiable": false, "reason": "old form"}'
  WHEN 3 THEN '{"candidate": "yes"}'
  WHEN 4 THEN 'no json at all'
  WHEN 5 THEN '{broken {"candidate": true, "evidence_status": "needs_retrieval"'
  ELSE '{"reason": "older form"} {"candidate": false}' END AS response
FROM documents""")
_define("period_memos", "", f"""
SELECT p_partkey AS plan_id, CASE CAST(p_partkey % 4 AS INT)
  WHEN 0 THEN concat({_str('1990 + p_size % 10')}, '-03 ~ ', {_str('1995 + p_size')}, '-03')
  WHEN 1 THEN concat({_str('1990 + p_size')}, '-01, ', {_str('1991 + p_size')}, '-02, ', {_str('1990 + p_size')}, '-01')
  WHEN 2 THEN concat({_str('1990 + p_size')}, ', ', {_str('1985 + p_size')}, ' and 20200')
  ELSE concat({_str('2005 + p_size % 3')}, '-03 ~ ', {_str('1999')}, '-04') END AS memo
FROM part""")

# --- statistics cube ----------------------------------------------------------------------------------------
_define("order_counts", "", """
SELECT nat, pri, y, m, CAST(n AS BIGINT) AS n FROM (
  SELECT n_name AS nat, o_orderpriority AS pri, year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY n_name, o_orderpriority, year(o_orderdate), month(o_orderdate)) t""")
_define("annual_counts", "order_counts", """
SELECT coalesce(nat, '전국') AS c1, coalesce(pri, '계') AS c2, y, CAST(sum(n) AS BIGINT) AS n FROM order_counts
GROUP BY GROUPING SETS ((nat, pri, y), (nat, y), (pri, y), (y))""")
_define("monthly_counts", "order_counts", """
SELECT coalesce(nat, '전국') AS c1, y, m, CAST(sum(n) AS BIGINT) AS n FROM order_counts
GROUP BY GROUPING SETS ((nat, y, m), (y, m))""")
_define("annual_rates", "annual_counts", """
SELECT a.c1, a.y, a.n, b.n AS prev_n, CAST(round(1000.0 * (a.n - b.n) / b.n) AS BIGINT) AS tenths
FROM annual_counts a JOIN annual_counts b ON a.c1 = b.c1 AND a.c2 = b.c2 AND a.y = b.y + 1
WHERE a.c2 = '계'""")
_C1 = "CASE WHEN c1 = '전국' THEN c1 ELSE concat('국가 : ', c1) END"
_define("official_stats", "annual_counts monthly_counts annual_rates", f"""
SELECT '101' AS org_id, 'DT_ORD_Y' AS tbl_id, '국가별 주문 건수' AS tbl_nm, '건수는 건수가 주문통계' AS survey, '국가' AS c1_obj_nm,
  {_C1} AS c1_nm, '우선순위' AS c2_obj_nm, c2 AS c2_nm, '주문 건수' AS itm_nm, '건' AS unit_nm, {_str('y')} AS prd_de,
  CASE WHEN y = 1999 AND c2 = '5-LOW' THEN '-' ELSE {_thousands('n')} END AS dt,
  concat({_str('y + 1')}, CASE WHEN c1 = 'NATION_7' THEN '-12-20' ELSE '-01-15' END) AS lst_chn_de
FROM annual_counts
UNION ALL
SELECT '101', 'DT_ORD_M', '월간 발주량', '발주통계', '국가', {_C1}, '', '', '월 발주량', '건',
  concat({_str('y')}, lpad({_str('m')}, 2, '0')), {_thousands('n')}, concat({_str('y')}, '-', lpad({_str('m')}, 2, '0'), '-28')
FROM monthly_counts
UNION ALL
SELECT '101', 'DT_RATE_Y', '주문 증감률', '주문동향', '국가', {_C1}, '', '', '전년비(%)', '', {_str('y')}, {_tenths('tenths')},
  concat({_str('y + 1')}, '-01-15')
FROM annual_rates
UNION ALL
SELECT '101', 'DT_RATE_Y', '주문 증감률', '주문동향', '국가', {_C1}, '', '', '전년비누계(%)', '', {_str('y')}, {_tenths('tenths + 3')},
  concat({_str('y + 1')}, '-01-15')
FROM annual_rates
UNION ALL
SELECT '102', 'DT_IDX_Y', '거래량지수(8888=100)', '거래지수', '국가', {_C1}, '', '', '총지수', '', {_str('y')},
  {_tenths('1000 + tenths')}, concat({_str('y + 1')}, '-01-15')
FROM annual_rates""")
_define("catalog_tables", "official_stats", """
SELECT org_id, tbl_id, tbl_nm, survey, min(prd_de) AS first_prd, max(prd_de) AS last_prd, count(*) AS n_rows
FROM official_stats GROUP BY org_id, tbl_id, tbl_nm, survey""")

# --- claims rendered from the cube --------------------------------------------------------------------------
_define("claim_seeds", "annual_counts", """
SELECT t.claim_id, t.c1, t.y, t.k, a.n, b.n AS prev_n,
  CASE WHEN b.n IS NULL THEN NULL ELSE CAST(round(1000.0 * (a.n - b.n) / b.n) AS BIGINT) END AS tenths
FROM (SELECT c_custkey AS claim_id, CASE WHEN c_custkey % 10 = 9 THEN '전국' ELSE n_name END AS c1,
        1995 + c_custkey % 7 AS y, CAST(c_custkey % 12 AS INT) AS k
      FROM customer JOIN nation ON c_nationkey = n_nationkey) t
JOIN annual_counts a ON a.c1 = t.c1 AND a.y = t.y AND a.c2 = '계'
LEFT JOIN annual_counts b ON b.c1 = t.c1 AND b.y = t.y - 1 AND b.c2 = '계'""")
_define("claims", "claim_seeds", f"""
SELECT claim_id, c1, y, n, prev_n, tenths, k,
  concat({_str('y + 1')}, '-06-15') AS article_date,
  CASE k
    WHEN 0 THEN concat({_str('y')}, '년 ', c1, ' 주문 건수는 ', {_thousands('n')}, '건으로 집계됐다.')
    WHEN 1 THEN concat({_str('y')}, '년 ', c1, ' 주문 건수는 ', {_thousands('n + 7 + ' + _div('n', 5))}, '건으로 집계됐다.')
    WHEN 2 THEN concat({_str('y')}, '년 ', c1, ' 주문 건수는 ', {_thousands('n - 1')}, '건을 넘어섰다.')
    WHEN 3 THEN concat({_str('y')}, '년 ', c1, ' 주문 건수는 ', {_thousands('n - 5')}, '건에 그쳤다.')
    WHEN 4 THEN concat('작년 ', c1, ' 주문 건수는 ', {_thousands('n')}, '건이다.')
    WHEN 5 THEN concat({_str('y')}, '년 ', c1, ' 주문 건수는 전년보다 ', {_tenths('abs(coalesce(tenths, 15))')}, '% 증가했다.')
    WHEN 6 THEN concat({_str('y')}, '년 ', c1, ' 주문 증감률은 전년 대비 ', {_tenths('coalesce(tenths, 15)')}, '% 였다.')
    WHEN 7 THEN concat('내년 ', c1, ' 주문 건수는 ', {_thousands('n')}, '건에 이를 전망이다.')
    WHEN 8 THEN concat({_str('y')}, '년 ', c1, ' 거래량지수 총지수는 ', {_tenths('1000 + coalesce(tenths, 15)')}, '를 기록했다.')
    WHEN 9 THEN concat({_str('y')}, '년 ', c1, ' 주문 건수는 역대 최대였다.')
    WHEN 10 THEN concat({_str('y')}, '년 ', c1, ' 주문 건수는 ', {_str('n')}, '만 명으로 늘었다.')
    ELSE concat({_str('y')}, '년 ', c1, ' 주문 건수는 지난달 ', {_thousands('n')}, '건으로 집계됐다.') END AS sentence
FROM claim_seeds""")

_define("cube_claims", "claims monthly_counts", f"""
SELECT claim_id, c1, y, 0 AS m, k, n, tenths, article_date, sentence FROM claims
UNION ALL
SELECT 1000000000 + t.claim_id, t.c1, t.y, t.m, 12, a.n, NULL, concat({_str('t.y + 1')}, '-06-15'),
  concat({_str('t.y')}, '년 ', {_str('t.m')}, '월 ', t.c1, ' 월간 발주량은 ', {_thousands('a.n')}, '건이다.')
FROM (SELECT c_custkey AS claim_id, CASE WHEN c_custkey % 10 = 9 THEN '전국' ELSE n_name END AS c1,
        1995 + c_custkey % 7 AS y, 1 + c_custkey % 12 AS m
      FROM customer JOIN nation ON c_nationkey = n_nationkey) t
JOIN monthly_counts a ON a.c1 = t.c1 AND a.y = t.y AND a.m = t.m""")

# --- ranking ------------------------------------------------------------------------------------------------
_define("part_catalog", "", f"""
SELECT p_partkey AS ord, concat('T', {_str('p_partkey')}) AS tbl_id, concat('O', {_str('p_size % 7')}) AS org_id,
  concat(p_name, ' ', lower(p_type), ' ', lower(replace(p_brand, '#', ''))) AS tbl_nm, concat('survey', {_str('p_size')}) AS survey,
  {_str('1990 + p_size % 10')} AS start_prd, {_str('1996 + p_size % 9')} AS end_prd,
  CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'MT_RTITLE' WHEN 1 THEN 'MT_GTITLE01' ELSE 'MT_ZTITLE' END AS vw_cd
FROM part""")
_define("part_queries", "", f"""
SELECT qid, {_str('1995 + qid % 8')} AS period, CASE CAST(qid % 3 AS INT) WHEN 0 THEN concat(a, ' ', t) WHEN 1 THEN concat(substr(a, 2), ' brand', {_str('qid % 25')})
  ELSE a END AS query
FROM (SELECT CAST(min(p_partkey) AS BIGINT) AS qid, p_name AS a, lower(p_type) AS t FROM part GROUP BY p_name, lower(p_type)) q""")
_define("kr_tables", "", f"""
SELECT p_partkey AS tbl, concat('K', {_str('p_partkey')}) AS tbl_id, concat('O', {_str('p_size % 7')}) AS org_id,
  concat(CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN '월별 소비자물가 등락률' WHEN 1 THEN '연도별 취업자 수' WHEN 2 THEN '취업시간별 취업자' WHEN 3 THEN '장래인구추계'
    WHEN 4 THEN '실업률(시도)' WHEN 5 THEN '월간 출생아 수 전년동월비' WHEN 6 THEN '품목별 소비자물가지수' ELSE '분기 수출액' END, ' ', p_name) AS tbl_nm,
  CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '소비자물가조사' WHEN 1 THEN '취업자조사' ELSE '' END AS survey,
  CASE CAST(p_size % 3 AS INT) WHEN 0 THEN 'MT_ZTITLE' WHEN 1 THEN 'MT_RTITLE' ELSE 'MT_GTITLE01' END AS vw_cd,
  CASE WHEN p_size % 5 = 0 THEN '국제기구별 통계 > IMF' ELSE '청년 인구' END AS path,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE {_str('1996 + p_size % 6')} END AS start_prd, {_str('2000 + p_size % 4')} AS end_prd
FROM part""")
_define("kr_items", "", """
SELECT p_partkey AS tbl, 0 AS item_no, CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '소비자물가 전월비(%)' WHEN 1 THEN '취업자 수' ELSE '출생아 수' END AS item FROM part
UNION ALL SELECT p_partkey, 1, CASE CAST(p_size % 3 AS INT) WHEN 0 THEN '전년동월비(%)' WHEN 1 THEN '수출물량' ELSE '실업률(%)' END FROM part""")
_define("order_sentences", "", f"""
SELECT o_orderkey AS claim_id, {_str('year(o_orderdate)')} AS period, o_orderdate, CASE CAST(o_orderkey % 9 AS INT)
  WHEN 0 THEN concat('지난달 소비자물가가 전년동월 대비 ', {_str('o_orderkey % 9 + 1')}, '.1% 올랐다.') WHEN 1 THEN concat({_str('year(o_orderdate)')}, '년 취업자는 ', {_str('o_custkey + 1')}, '만 명이다.')
  WHEN 2 THEN '서울 청년 실업률은 올해 6.1%다.' WHEN 3 THEN '출생아 수는 12월 전월 대비 줄었다.' WHEN 4 THEN '수출액은 연간 3.1% 늘 전망이다.'
  WHEN 5 THEN '지난해 연간 배추 물가가 5.2%p 올랐다.' WHEN 6 THEN '여성 취업자와 산업별 고용률 61.0%' WHEN 7 THEN '인구 1분기 5건' ELSE '아무 관련 없는 문장' END AS sentence
FROM orders""")
_define("table_hits", "", """
SELECT l_orderkey AS claim_id, CAST(l_linenumber AS BIGINT) AS rank, min(l_partkey) AS tbl FROM lineitem GROUP BY l_orderkey, l_linenumber""")
_define("evidence_objects", "", """
SELECT p_partkey AS tbl, CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '소비자 물가' WHEN 1 THEN '취업자' WHEN 2 THEN '전년동월비' ELSE '출생아 수' END AS indicator,
  CASE CAST(p_size % 3 AS INT) WHEN 0 THEN '%' WHEN 1 THEN '명' ELSE '건' END AS unit, CASE CAST(p_size % 3 AS INT) WHEN 0 THEN '월' WHEN 1 THEN '연' ELSE '분기' END AS time_dimension,
  CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '계' WHEN 1 THEN '서울' ELSE '' END AS sel_region, CASE CAST(p_size % 2 AS INT) WHEN 0 THEN '청년' ELSE '전체' END AS sel_age
FROM part""")

# --- snapshots ----------------------------------------------------------------------------------------------
_define("ship_months", "", """
SELECT year(l_shipdate) AS y, month(l_shipdate) AS m, l_returnflag AS flag, l_linestatus AS status,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem
GROUP BY year(l_shipdate), month(l_shipdate), l_returnflag, l_linestatus""")
_KEYED = f"concat({_str('y')}, '-', lpad({_str('m')}, 2, '0'))"
_define("snapshot_before", "ship_months", f"""
SELECT 'DT_SHIP' AS tbl_id, {_KEYED} AS period, '출하 수량' AS indicator, flag, status, {_str('qty')} AS value, '건' AS unit,
  concat({_str('y + 1')}, '-01-01') AS last_changed FROM ship_months WHERE NOT (y % 3 = 0 AND m = 2)""")
_define("snapshot_after", "ship_months", f"""
SELECT 'DT_SHIP' AS tbl_id, {_KEYED} AS period, '출하 수량' AS indicator, flag, status,
  CASE WHEN (y + m) % 5 = 0 THEN {_str('qty + 3')} ELSE {_str('qty')} END AS value, '건' AS unit,
  CASE WHEN (y + m) % 7 = 0 THEN '2002-02-02' ELSE concat({_str('y + 1')}, '-01-01') END AS last_changed
FROM ship_months WHERE NOT (y % 4 = 0 AND m = 5)""")
_define("ship_mappings", "snapshot_before", """
SELECT concat('M|', flag, '|', status, '|', period) AS mapping_id, concat('ev|', flag, status) AS evidence_id, period,
  CASE WHEN substr(period, 7, 1) IN ('1', '5') THEN '' ELSE flag END AS sel_flag,
  CASE WHEN substr(period, 7, 1) IN ('1', '2') THEN '' ELSE status END AS sel_status
FROM snapshot_before""")

# --- labels and detectors -----------------------------------------------------------------------------------
_define("detector_rows", "", f"""
SELECT d.doc_id, concat('run', {_str('d.doc_id % 7')}) AS run_id, d.lang, d.source,
  CASE WHEN l.quality IS NULL THEN 'unreviewed' WHEN l.quality = 1 THEN 'true_candidate' WHEN d.doc_id % 13 = 0 THEN 'unclear'
       ELSE 'false_positive' END AS review,
  CASE WHEN d.n_chars % 3 < 2 THEN TRUE ELSE FALSE END AS rule_candidate,
  CASE WHEN d.doc_id % 10 = 9 THEN 'failed' WHEN d.doc_id % 10 = 8 THEN 'not_called' ELSE 'success' END AS judge_status,
  CASE WHEN d.doc_id % 10 < 8 THEN (CASE WHEN (d.doc_id + d.n_chars) % 4 < 2 THEN TRUE ELSE FALSE END) END AS judge_candidate,
  d.text AS sentence, d.n_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
_define("label_pairs", "", """
SELECT d.doc_id, CASE CAST(d.doc_id % 3 AS INT) WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' ELSE 'unverifiable' END AS gold,
  CASE WHEN l.toxic = 1 OR d.n_chars % 5 = 0 THEN 'unverifiable'
       ELSE CASE CAST(d.doc_id % 3 AS INT) WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' ELSE 'unverifiable' END END AS pred
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
_define("annotator_a", "", "SELECT doc_id AS row_id, CAST(quality AS STRING) AS is_claim, CAST(toxic AS STRING) AS gold_label FROM labels")
_define("annotator_b", "", """
SELECT doc_id AS row_id, CAST(CASE WHEN doc_id % 6 = 0 THEN 1 - quality ELSE quality END AS STRING) AS is_claim,
  CAST(CASE WHEN doc_id % 9 = 0 THEN 1 - toxic ELSE toxic END AS STRING) AS gold_label FROM labels""")
_define("gold_rows", "", f"""
SELECT doc_id AS row_no, concat('G', {_str('CASE WHEN doc_id % 41 = 7 THEN doc_id - 1 ELSE doc_id END')}) AS claim_id,
  CASE WHEN doc_id % 37 = 5 THEN '' ELSE concat(lang, ' ', source, ' ', {_str(f"CASE WHEN doc_id % 43 = 9 THEN doc_id - 2 ELSE doc_id END")}) END AS sentence,
  CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '고용' WHEN 1 THEN '물가' WHEN 2 THEN '인구' WHEN 3 THEN '무역' ELSE 'other' END AS domain,
  CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'approved' WHEN 1 THEN 'draft' WHEN 2 THEN 'rejected' ELSE 'pending' END AS review_status,
  CASE WHEN doc_id % 8 = 4 THEN '' ELSE {_str('n_chars')} END AS claim_value,
  CASE WHEN doc_id % 3 = 0 THEN 'match' WHEN doc_id % 3 = 1 THEN 'mismatch' ELSE 'maybe' END AS gold_label
FROM documents""")
_define("gold_rows_b", "gold_rows", f"""
SELECT row_no, claim_id, sentence, CASE WHEN row_no % 47 = 3 THEN '고용' ELSE domain END AS domain, review_status,
  CASE WHEN row_no % 53 = 2 THEN concat(claim_value, '0') ELSE claim_value END AS claim_value, gold_label
FROM gold_rows WHERE row_no % 59 <> 11
UNION ALL SELECT row_no + 100000000, claim_id, sentence, domain, review_status, claim_value, gold_label FROM gold_rows WHERE row_no % 61 = 12""")

# --- queue, lifecycle, call log -----------------------------------------------------------------------------
_define("queue_articles", "", f"""
SELECT c_custkey AS article_id, concat('title ', {_str('c_custkey')}) AS title, concat('2024-', lpad({_str('c_custkey % 12 + 1')}, 2, '0'), '-10') AS article_date
FROM customer""")
_define("queue_claims", "", f"""
SELECT o_orderkey AS claim_id, o_custkey AS article_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'F' THEN 'DONE' ELSE 'NEEDS_REVIEW' END AS status,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'NON_KOSIS_QUEUE' WHEN 1 THEN 'HUMAN_REVIEW' ELSE 'KOSIS_RETRIEVAL' END AS route,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'KOSIS_BUT_COMPLEX' ELSE 'KOSIS_DOMESTIC' END AS source_type,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'unverifiable' WHEN 3 THEN 'match' ELSE 'not_claim' END AS label,
  CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'calc' END AS calculation,
  CAST(o_orderkey % 3 AS INT) AS retry_count,
  CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate END AS retry_at,
  CASE WHEN o_orderkey % 9 = 4 THEN TRUE ELSE FALSE END AS reviewed, o_totalprice AS amount
FROM orders""")
_define("reviews", "", """
SELECT event_id AS review_id, user_id AS claim_id, ts,
  CASE event_type WHEN 'signup' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'hold' WHEN 'view' THEN 'correct' ELSE 'approve' END AS action
FROM events""")
_define("state_log", "", """
SELECT event_id, user_id AS claim_id, ts,
  CASE event_type WHEN 'signup' THEN 'DETECTED' WHEN 'view' THEN 'PARSED' WHEN 'click' THEN 'VERDICTED' WHEN 'purchase' THEN 'EXPLAINED' ELSE 'UNVERIFIABLE' END AS state,
  CASE WHEN value > 10 THEN 'reason' ELSE '' END AS reason
FROM events""")
_define("call_log", "", "SELECT event_id AS call_id, event_type AS api_key, ts FROM events")
_define("payload_a", "", f"SELECT o_orderkey AS k, concat(o_orderstatus, {_str('o_custkey')}) AS payload, o_orderdate AS ts FROM orders WHERE o_orderkey % 10 < 7")
_define("payload_b", "", f"""
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 = 1 THEN 'altered' ELSE concat(o_orderstatus, {_str('o_custkey')}) END AS payload,
  o_orderdate AS ts FROM orders WHERE o_orderkey % 10 > 2""")


def closure(name: str) -> list[str]:
    """Names needed for a fixture, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in SQL[n][0]:
            visit(d)
        if n not in order:
            order.append(n)
    visit(name)
    return order


def with_clause(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` text that makes the named fixtures available to a query."""
    order: list[str] = []
    for name in names:
        order += [n for n in closure(name) if n not in order]
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n][1]})" for n in order)


# Derived inputs that several steps of one query read again: computed once and cut from the plan.
REUSED = ("official_stats", "claims", "cube_claims")
_CACHE: dict = {}


class Tables:
    """Delivered and derived tables of one data folder as lazy DataFrames."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in SQL:
            for base in BASE_TABLES:
                text = " ".join(SQL[n][1] for n in closure(name))
                if base in text:
                    self.spark.read.parquet(f"{self.folder}/{base}.parquet").createOrReplaceTempView(base)
            df = self.spark.sql(f"{with_clause(name)} SELECT * FROM {name}")
            if name not in REUSED:
                return df
            key = (self.spark.sparkContext.applicationId, self.folder, name)
            if key not in _CACHE:
                _CACHE[key] = stable(df)
            return _CACHE[key]
        raise AttributeError(name)
