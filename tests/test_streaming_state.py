"""Compacted state of the micro-batches: same rows, bounded reading."""
from datetime import datetime, timedelta

from statproof.streaming import jobs

SCHEMA = "k int, v string"


def write(spark, target, batch, last):
    rows = [(k, f"{k}-{batch}") for k in range(batch % 3, last, 2)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{target}/batch_id={batch}")
    jobs.compact(spark, target, batch, SCHEMA, "k")
    return rows


def newest(spark, target, batch):
    rows = sorted(jobs.earlier(spark, target, batch, SCHEMA).collect(), key=lambda r: r["batch_id"])
    return {r["k"]: r["v"] for r in rows}


def test_state_is_the_same_and_reading_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "COMPACT", 4)
    target, want, files = str(tmp_path / "state"), {}, []
    for batch in range(22):
        assert newest(spark, target, batch) == want
        files.append(len(jobs.earlier(spark, target, batch, SCHEMA).inputFiles()))
        want |= dict(write(spark, target, batch, 6))
        if batch in (3, 4, 11):  # the batch is delivered again
            write(spark, target, batch, 6)
    base = max(files[4:12])
    assert max(files[4:]) == base and files[21] == files[5]


def test_a_missing_compacted_table_falls_back_to_all_folders(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "state")
    monkeypatch.setattr(jobs, "COMPACT", 100)
    want = {}
    for batch in range(5):
        want |= dict(write(spark, target, batch, 5))
    monkeypatch.setattr(jobs, "COMPACT", 2)
    assert newest(spark, target, 5) == want


def test_lifecycle_over_several_compactions(spark, tmp_path, monkeypatch):
    """One event a batch: each claim runs through its states across compacted tables, and nothing is processed twice."""
    monkeypatch.setattr(jobs, "COMPACT", 2)
    start = datetime(2024, 1, 1)
    steps = ["DETECTED", "PARSED", "DETECTED", "PARSED", "DETECTED"]
    events = [(i, i % 2, start + timedelta(hours=i), s, "") for i, s in enumerate(steps)] + [(0, 0, start, "DETECTED", "")]
    source, schema = tmp_path / "events", "event_id int, claim_id int, ts timestamp, state string, reason string"
    out = str(tmp_path / "out")
    for i, e in enumerate(events):
        spark.createDataFrame([e], schema).coalesce(1).write.mode("append").parquet(str(source))
        jobs.stream_lifecycle(spark.readStream.schema(schema).parquet(str(source)), out, str(tmp_path / "check"))
    got = {r["event_id"]: (r["claim_id"], r["from_state"], r["check"]) for r in spark.read.parquet(out).collect()}
    assert spark.read.parquet(out).count() == 5
    assert got == {0: (0, None, "ok"), 1: (1, None, "illegal_start"), 2: (0, "DETECTED", "illegal"), 3: (1, "PARSED", "illegal"), 4: (0, "DETECTED", "illegal")}
