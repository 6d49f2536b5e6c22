"""Order of stored records beside a decided comparison."""
import pytest

from statproof.operators import snapshots

TOTAL = {"지수종류": "총지수"}


def record(value="2.4", period="2025-10", unit="%", indicator="전년동월비(%)", selection=TOTAL):
    return ("T1", period, indicator, selection, value, unit)


def ranked(spark, records, status="match", official="2.4%", period="2025.10", wanted=TOTAL):
    c = spark.createDataFrame([("c", "T1", period, "퍼센트", "전년동월비(%)", wanted, status, official)],
                              "claim_id string, tbl_id string, claim_period string, claim_unit string, evidence_indicator string, evidence_selection map<string,string>, status string, official_value string")
    r = spark.createDataFrame(records, "tbl_id string, period string, indicator string, selection map<string,string>, value string, unit string")
    return snapshots.rank_records(c, r.repartition(3)).orderBy("position").collect()


def test_compared_record_comes_first_among_fitting_ones(spark):
    got = ranked(spark, [record("1.1"), record("9.9", indicator="전월비(%)"), record(), record("2.4", period="2025.09"), record("3.0")])
    assert [(r["value"], r["is_primary"]) for r in got][:3] == [("2.4", True), ("1.1", False), ("3.0", False)]
    assert [r["position"] for r in got] == [1, 2, 3, 4, 5] and sum(r["is_primary"] for r in got) == 1


def test_alternatives_follow_the_gates(spark):
    got = ranked(spark, [record("1.0", period="2025.09"), record("1.0", indicator="전월비(%)"), record("1.0", selection={"지수종류": "다른지수"}), record("1.0", unit="명"), record()])
    assert [r["unit"] for r in got] == ["%", "명", "%", "%", "%"]
    assert [r["rsel"]["지수종류"] for r in got][2] == "다른지수" and got[3]["indicator"] == "전월비(%)" and got[4]["period"] == "2025.09"
    assert [r["match_score"] for r in got] == [4, 3, 3, 3, 3]


@pytest.mark.parametrize("status, official", [("not_comparable", "2.4%"), ("match", "7.7%"), ("match", ""), ("match", None), (None, "2.4%")])
def test_no_false_primary(spark, status, official):
    got = ranked(spark, [record(), record("1.0")], status, official)
    assert [r["is_primary"] for r in got] == [False, False] and [r["value"] for r in got] == ["1.0", "2.4"]


def test_nulls_repeats_and_empty_tables(spark):
    got = ranked(spark, [record(), record(), record(selection=None), record(period=None), record(unit=None), record(value=None), record(indicator=None)])
    assert [r["position"] for r in got] == list(range(1, 8)) and [r["is_primary"] for r in got] == [True] + [False] * 6
    assert [(r["value"], r["match_score"]) for r in got[:3]] == [("2.4", 4), (None, 4), ("2.4", 4)]  # no value sorts as an empty one
    assert ranked(spark, []) == []
