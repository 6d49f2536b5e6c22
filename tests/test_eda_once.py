"""Row quality is computed once and stored; only texts that NFKC may change reach Python; guards skip no match."""
import re
import unicodedata

from pyspark.sql import functions as F

from statproof.functions import text as tx
from statproof.operators import eda


def news(spark, rows):
    return spark.createDataFrame(rows, "row_no long, title string, date string, url string, body string")


def test_rows_are_cleaned_once(spark):
    raw = news(spark, [(1, "Ａ", "2024.01.02", "", "본문 ﬁ"), (2, "A", "2024.01.02", None, "본문 fi"), (3, "", "", "u", "text"), (4, "x", "2024.01.02", "u", "other")])
    rows = eda.quality_rows(raw)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "regexp_replace" not in plan
    assert {(r.row_no, r.exclusion) for r in rows.collect()} == {(1, None), (2, "duplicate"), (3, None), (4, "duplicate")}
    counts = eda.eda_counts(eda.profile_sentences(eda.valid_articles(rows)))
    assert "regexp" not in counts._jdf.queryExecution().executedPlan().toString()
    none = eda.eda_counts(eda.profile_sentences(eda.valid_articles(rows.where("false"))))
    assert [r.n for r in none.collect()] == [0] * 6


def test_folded_characters_stay():
    kept = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and re.match(f"[{eda.FOLDED}]", c)]
    assert all(unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) for c in kept)
    assert all(unicodedata.normalize("NFKC", "a가한e" + c) == "a가한e" + c for c in kept)


def test_guards_skip_no_match(spark):
    df = spark.createDataFrame([("G D P grew",), ("5%p",), ("plain",), ("지난 달 3건",), ("지난해 대비",), (None,)], "s string")
    got = [(r.label and r.label.source_type, r.label and r.label.domain, r.label and r.label.claim_type, r.p, r.q) for r in df.select(
        tx.source_label(F.col("s")).alias("label"), tx.period(F.col("s"), F.lit("2025-03-10")).alias("p"), F.size(tx.quantities(F.col("s"))).alias("q")).collect()]
    assert got[0][:3] == ("KOSIS_BUT_COMPLEX", "national_accounts_macro", "규모형") and got[1] == ("UNKNOWN", "-", "증감형", "", 1)
    assert got[2] == ("UNKNOWN", "-", "규모형", "", 0) and got[3][3:] == ("2025-02", 1) and got[4][3] == "2024" and got[5][0] == "UNKNOWN" and got[5][3] == ""
    lines = df.select(tx.clean_body(F.lit("a@b.co x\nCOPYRIGHT y\n홍길동 기자\n저작권자 z\n본문 홍길동 기자"))).first()[0]
    assert lines == "x 본문"
