"""Context of a sentence among articles that share an id."""
from statproof.operators import extraction


def test_sentences_of_rows_with_one_article_id_stand_in_row_order(spark):
    rows = [(2, "a", 0, "이 같은 인구 비율이 늘었다."), (1, "a", 0, "취업자 수는 12만 명이다."), (3, "a", 1, "이 같은 고용이 줄었다."), (4, "b", 0, "이 같은 인구 비율이 늘었다.")]
    want = {1: ("취업자 수", False), 2: ("취업자 수", True), 3: ("인구", True), 4: ("인구", False)}
    for given in (rows, rows[::-1]):
        sent = spark.createDataFrame(given, "row_no long, article_id string, sentence_idx int, sentence string").coalesce(1)
        got = extraction.claim_profiles(sent).select("row_no", "profile.indicator", "profile.context_inherited").collect()
        assert {r["row_no"]: (r["indicator"], r["context_inherited"]) for r in got} == want
