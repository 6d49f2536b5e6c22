"""Structured Streaming versions of ingest, verification and lifecycle tracking.

Each job is a micro-batch body that reads what earlier batches wrote and writes its own result into a folder named by
the batch id.  Re-running a batch overwrites its own folder only, so re-delivery and executor loss leave one result."""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from statproof.functions.scale import first_per_key, lag_by_bucket, shared_folder
from statproof.operators import corpus, evidence
from statproof.operators.queue import TERMINAL, TRANSITIONS


COMPACT = 16  # batches from one compacted state table to the next


def scratch(spark: SparkSession, name: str) -> str:
    """New folder in the shared checkpoint folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    path = f"{folder}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def _read(spark: SparkSession, base: str, pattern: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{schema}, batch_id long").option("basePath", base).parquet(f"{base}/{pattern}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _rows(spark: SparkSession, target: str, base: int, batch_id: int, schema: str) -> DataFrame:
    """The compacted rows up to batch `base` (-1: none) and those of the batches between it and `batch_id`."""
    old = _read(spark, f"{target}-base", f"batch_id={base}", schema) if base >= 0 else None
    if old is None:
        new = _read(spark, target, "batch_id=*", schema)
        new = None if new is None else new.where(F.col("batch_id") < batch_id)
    else:
        wanted = ",".join(str(i) for i in range(base + 1, batch_id))
        new = _read(spark, target, f"batch_id={{{wanted}}}", schema) if wanted else None
    found = [df for df in (old, new) if df is not None]
    if not found:
        return spark.createDataFrame([], f"{schema}, batch_id long")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def earlier(spark: SparkSession, target: str, batch_id: int, schema: str) -> DataFrame:
    """Rows of earlier batches (an empty table before the first one): the newest compacted table and at most
    `COMPACT` - 1 folders after it, however many batches ran.  Without that table all folders are read."""
    return _rows(spark, target, batch_id // COMPACT * COMPACT - 1, batch_id, schema)


def compact(spark: SparkSession, target: str, batch_id: int, schema: str, key: str) -> None:
    """Every `COMPACT` batches: one row per key, its newest, of all batches so far as the next compacted table.

    It is written inside its batch, so no later batch sees half of it; a batch that runs again writes it anew from the same
    folders.  Older folders stay; they are not read any more."""
    if (batch_id + 1) % COMPACT == 0:
        rows = _rows(spark, target, batch_id - COMPACT, batch_id + 1, schema)
        first_per_key(rows, [key], [F.desc("batch_id")]).drop("batch_id").write.mode("overwrite").parquet(f"{target}-base/batch_id={batch_id}")


def _write(df: DataFrame, target: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")


def run_available(stream: DataFrame, body, checkpoint: str) -> None:
    """Process everything that is available now, batch by batch."""
    stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_ingest(source: DataFrame, target: str, checkpoint: str) -> None:
    """Raw article rows -> prepared articles, one per full article key over all batches.

    The keys of earlier batches are a table of their own (`<target>-keys`), so a batch never reads old bodies again."""
    def body(batch: DataFrame, batch_id: int) -> None:
        spark, keys = batch.sparkSession, f"{target}-keys"
        old = earlier(spark, keys, batch_id, "article_key string").select("article_key")
        new = first_per_key(corpus.prepare_articles(batch).withColumn("article_key", corpus.article_key()), ["article_key"], ["row_no"])
        _write(new.join(old, "article_key", "left_anti").drop("anchored"), target, batch_id)
        _write(spark.read.parquet(f"{target}/batch_id={batch_id}").select("article_key"), keys, batch_id)
        compact(spark, keys, batch_id, "article_key string", "article_key")
    run_available(source, body, checkpoint)


def stream_verify(claims: DataFrame, catalog: DataFrame, stats: DataFrame, target: str, checkpoint: str, registry: DataFrame | None = None) -> None:
    """Pending claims against the static catalog and cube: exactly one verdict per claim id."""
    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        todo = first_per_key(batch, ["claim_id"], ["article_date"])
        keys = f"{target}-keys"
        name = batch.schema["claim_id"].dataType.simpleString()
        todo = todo.join(earlier(spark, keys, batch_id, f"claim_id {name}").select("claim_id"), "claim_id", "left_anti")
        _write(evidence.verify_claims(todo, catalog, stats, registry), target, batch_id)
        _write(spark.read.parquet(f"{target}/batch_id={batch_id}").select("claim_id"), keys, batch_id)
        compact(spark, keys, batch_id, f"claim_id {name}", "claim_id")
    run_available(claims, body, checkpoint)


def stream_lifecycle(events: DataFrame, target: str, checkpoint: str) -> None:
    """events(event_id, claim_id, ts, state, reason) -> each step checked against the claim's state before it.

    Two small tables carry what earlier batches leave behind: the ids of processed events, so a re-delivered event is
    dropped, and the last state of each claim a batch touched, which stands before the claim's first event of this
    batch.  Events that do not come after that state in (ts, event_id) order are late: they are flagged and do not move
    the state.  A claim with very many events is split by day inside the batch, so no task holds its whole history."""
    cols = ["event_id", "claim_id", "ts", "state", "reason"]

    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kind = {f.name: f.dataType.simpleString() for f in batch.schema.fields}
        ids, states = f"{target}-ids", f"{target}-states"
        id_schema, state_schema = f"event_id {kind['event_id']}", f"claim_id {kind['claim_id']}, last_ts {kind['ts']}, last_event {kind['event_id']}, last_state string"
        done = earlier(spark, ids, batch_id, id_schema).select("event_id")
        known = earlier(spark, states, batch_id, state_schema)
        last = first_per_key(known, ["claim_id"], [F.desc("batch_id")]).drop("batch_id")
        new = batch.select(*cols).dropDuplicates(["event_id"]).join(done, "event_id", "left_anti")
        j = new.join(last, "claim_id", "left")
        late = F.coalesce(F.struct("ts", "event_id") <= F.struct(F.col("last_ts").alias("ts"), F.col("last_event").alias("event_id")), F.lit(False)) & F.col("last_ts").isNotNull()
        steps = lag_by_bucket(j.where(~late), ["claim_id"], F.date_trunc("day", "ts"), ["ts", "event_id"], "state", "_lag").withColumn("from_state", F.coalesce("_lag", "last_state"))
        frm, to = F.col("from_state"), F.col("state")
        allowed = F.concat_ws(">", frm, to).isin([f"{a}>{b}" for a, b in TRANSITIONS])
        check = (F.when((to == "UNVERIFIABLE") & (F.col("reason") == ""), "reason_required").when(to == "UNVERIFIABLE", "ok")
                  .when(frm.isNull(), F.when(to == "DETECTED", "ok").otherwise("illegal_start")).when(frm.isin(TERMINAL), "from_terminal").when(allowed, "ok").otherwise("illegal"))
        out = steps.withColumn("check", check).select(*cols, "from_state", "check").unionByName(
            j.where(late).select(*cols, F.col("last_state").alias("from_state"), F.lit("late").alias("check")))
        _write(out, target, batch_id)
        written = spark.read.parquet(f"{target}/batch_id={batch_id}")
        _write(written.select("event_id"), ids, batch_id)
        order = F.struct("ts", "event_id")
        _write(written.where("check <> 'late'").groupBy("claim_id").agg(
            F.max(order)["ts"].alias("last_ts"), F.max(order)["event_id"].alias("last_event"), F.max_by("state", order).alias("last_state")), states, batch_id)
        compact(spark, ids, batch_id, id_schema, "event_id")
        compact(spark, states, batch_id, state_schema, "claim_id")
    run_available(events, body, checkpoint)
