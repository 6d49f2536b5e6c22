"""Registered queries S01-S03 (file source, everything available now) with their DuckDB oracles."""
from __future__ import annotations

from pyspark.sql import functions as F

from statproof.plans import evidence_queries as ev, oracle_parts as o
from statproof.plans.fixtures import SQL, Tables, with_clause
from statproof.streaming import jobs


def _rendered(stream, base, fixture):
    """The fixture's own SQL over a streaming table."""
    return stream.sparkSession.sql(SQL[fixture][1].replace(f"FROM {base}", "FROM {src}"), src=stream)


def _delivered_twice(spark, rows, run):
    """Run a job on all rows, then deliver the same rows again under the same checkpoint."""
    folder, out, checkpoint = (jobs.scratch(spark, n) for n in ("in", "out", "ck"))
    for mode in ("errorifexists", "append"):
        rows.write.mode(mode).parquet(folder)
        run(spark.readStream.schema(rows.schema).parquet(folder), out, checkpoint)
    return spark.read.parquet(out)


def s01(spark, d):
    docs = Tables(spark, d).documents
    out = _delivered_twice(spark, docs, lambda s, out, ck: jobs.stream_ingest(_rendered(s, "documents", "news"), out, ck))
    return out.select("article_id", "row_no", "section", F.length("body").alias("n"))


def s02(spark, d):
    t = Tables(spark, d)
    claims = t.claims.select("claim_id", "sentence", "article_date")
    out = _delivered_twice(spark, claims, lambda s, out, ck: jobs.stream_verify(s, ev._catalog(t), t.official_stats, out, ck, ev._registry(spark)))
    return out.select("claim_id", "label", "reason")


def s03(spark, d):
    def run(stream, out, ck):
        jobs.stream_lifecycle(_rendered(stream, "events", "state_log").withColumn("ts", F.col("ts").cast("timestamp")), out, ck)
    return _delivered_twice(spark, Tables(spark, d).events, run).select("event_id", "from_state", "state", "check")


QUERIES = {"s01_stream_ingest": s01, "s02_stream_verify": s02, "s03_stream_lifecycle": s03}
from statproof.plans.queue_queries import ORACLE as _E  # noqa: E402

ORACLE = {
    "s01_stream_ingest": o.ARTICLES + " SELECT article_id, row_no, section, length(body) AS n FROM o_ids QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY row_no) = 1",
    "s02_stream_verify": ev._D13 + " SELECT claim_id, label, reason FROM v",
    "s03_stream_lifecycle": _E["e11_validate_transitions"],
}
