"""Search queries are made once per sentence; previews are found once and then sorted."""
from pyspark.sql import functions as F

from statproof.functions import text as tx
from statproof.operators import corpus, extraction


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_variants_read_the_query(spark):
    aliases = [("주문 건수", "주문량 통계")]
    sent = spark.createDataFrame([("작년 1인 가구 비율은 30%다.",), ("2023년 서울의 주문 건수는 5건으로 늘었다.",), ("The cat sat at 5%.",), ("5%",), ("GDP는 증가",), (None,)], "sentence string")
    got = extraction.make_queries(sent, aliases)
    assert {r.sentence: (r["query"], r["variants"]) for r in got.collect()} == {
        "작년 1인 가구 비율은 30%다.": ("1인가구", ["1인가구", "작년 1인 가구 비율은 30%다."]),
        "2023년 서울의 주문 건수는 5건으로 늘었다.": ("서울 주문량 통계 으로", ["서울 주문량 통계 으로", "2023년 서울의 주문량 통계는 5건으로 늘었다."]),
        "The cat sat at 5%.": ("The cat sat at", ["The cat sat at", "The cat sat at 5%."]), "5%": ("5%", ["5%"]), "GDP는 증가": ("GDP", ["GDP", "GDP는 증가"]), None: (None, [])}
    assert _plan(got).count("regexp_extract_all") == _plan(sent.select(tx.make_query(F.col("sentence"), aliases).alias("query"))).count("regexp_extract_all")


def test_previews_are_stored_before_the_sort(spark):
    raw = spark.createDataFrame([(1, "a", "2024.01.02", "", "u1", "서울 실업률은 3.1%다."), (2, "b", "2024.03.02", "", "u2", "서울 실업률은 4.1%다."),
                                 (3, "c", "someday", "", "u3", "서울 실업률은 5.1%다.")], "row_no long, title string, date string, section string, url string, body string")
    found = corpus.import_previews(raw)
    assert "regexp" not in _plan(found).split("Sort", 1)[1].split("\n", 1)[1]
    assert [(r.title, r.quantity_display) for r in found.collect()] == [("b", "4.1%"), ("a", "3.1%"), ("c", "5.1%")]
