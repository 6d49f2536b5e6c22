from pyspark.sql import functions as F

from statproof.functions import text as tx, verdict as vd


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


def raws(spark, s):
    return [(q["value"], q["composed_unit"], q["raw"]) for q in one(spark, tx.quantities(F.col("s")), s=s)]


def test_quantities(spark):
    assert raws(spark, "출생아는 23만 명, 0.3%p 늘었다") == [(23.0, "만명", "23만 명"), (0.3, "%p", "0.3%p")]
    assert raws(spark, "2024년 3월 12일 1인 가구") == []
    assert raws(spark, "1,234가구가 -7.2% 줄었다") == [(1234.0, "가구", "1,234가구"), (-7.2, "%", "-7.2%")]
    assert raws(spark, "1,234.5%") == [(5.0, "%", "5%")]
    assert raws(spark, "3개월 동안 5개") == [(5.0, "개", "5개")]


def period(spark, s, date="2025-03-10"):
    return one(spark, tx.period(F.col("s"), F.col("d")), s=s, d=date)


def test_period(spark):
    assert period(spark, "2024년 3월 물가") == "2024-03"
    assert period(spark, "지난달 물가가 작년 같은 달보다 2.2% 올랐다") == "2025-02"
    assert period(spark, "작년 3분기") == "2024-Q3"
    assert period(spark, "재작년 실적") == "2023"
    assert period(spark, "지난달 115.71(2020년=100)", "2025-01-10") == "2024-12"
    assert period(spark, "2023년 12월(4.2%) 이후 최대치, 지난달") == "2025-02"  # a record anchor is not the observed period
    assert period(spark, "1~9월 누계") == "2025-09"
    assert period(spark, "아무 말") == ""


def test_detection_and_wording(spark):
    def path(s):
        return one(spark, tx.detection_path(F.col("s")), s=s)
    assert path("7월 3일") == "noise" and path("구독하기 3건") == "site_chrome" and path("역대 최대 규모") == "superlative"
    assert path("지수가 5 증가") == "number_trend" and path("12월 3일 회의") == "none" and path("3건") == "number_unit"
    assert one(spark, tx.comparison_op(F.col("s")), s="150만을 넘어섰다") == "gte"
    assert one(spark, tx.trend(F.col("s")), s="급감했다") == "down"


def source(spark, s):
    r = one(spark, tx.source_label(F.col("s")), s=s)
    return r["source_type"], r["matched_keyword"]


def test_source_precedence(spark):
    assert source(spark, "일본 소비자물가가 3% 올랐다") == ("OVERSEAS_SOURCE", "")
    assert source(spark, "해외 건설 누적 수주액 1조") == ("KOSIS_DOMESTIC", "해외건설")
    assert source(spark, "코스피 상장사 영업이익") == ("PRIVATE_SOURCE", "영업이익")
    assert source(spark, "실업률이 3.1%였다") == ("KOSIS_DOMESTIC", "실업률")
    assert source(spark, "취업자가 늘 전망이다") == ("FORECAST_OR_OPINION", "")


def judged(spark, c, cu, o, ou, op="eq", digits=1):
    r = one(spark, vd.compare(F.col("c"), F.col("cu"), F.lit(digits), F.col("o"), F.col("ou"), F.col("op")), c=c, cu=cu, o=o, ou=ou, op=op)
    return r["label"], r["confidence"]


def test_verdict(spark):
    assert judged(spark, 64.2, "%", 64.168, "%") == ("match", "high")
    assert judged(spark, 23.0, "만명", 230028.0, "명") == ("match", "medium")
    assert judged(spark, 2.0, "%", 2.0, "%p") == ("mismatch", "medium")
    assert judged(spark, 2.0, "%", 2.0, "명") == ("unverifiable", None)
    assert judged(spark, 100.0, "건", 100.5, "건", "gte") == ("match", "low")
    assert judged(spark, 100.0, "건", 80.0, "건") == ("mismatch", "high")


def test_chrome_and_clean(spark):
    body = "메뉴 입력 2024.01.02. 03:04 업데이트 2024.01.02. 05:06 본문이다. 구독수 12 댓글"
    assert one(spark, tx.strip_chrome(F.col("s")), s=body) == "본문이다."
    assert one(spark, tx.clean_body(F.col("s")), s="홍길동 기자 = \n첫 문장 a@b.co 김철수 기자\n무단 전재 금지\n끝") == "첫 문장 끝"


def test_atomic_and_query(spark):
    a = one(spark, tx.atomic_claims(F.col("s")), s="배추(3.1%), 사과(4.2%) 올랐다")
    assert [(x["subject"], x["value_raw"]) for x in a] == [("배추", "3.1%"), ("사과", "4.2%")]
    assert one(spark, tx.atomic_claims(F.col("s")), s="배추(3.1%)만") == []
    assert one(spark, tx.make_query(F.col("s")), s="올해 서울의 1인 가구는 150만 가구") == "서울 1인가구"
