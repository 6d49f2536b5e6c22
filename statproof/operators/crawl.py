"""A catalog crawl that stops after a number of list calls and resumes where it stopped.

The queue is a durable table: every list that was ever seen has one position in breadth-first order, and the lists up to a
cursor are visited.  A run reads the entries of the lists it visits and no others.  Lists that a visited list names first
are put behind all known ones, in the order of their parents and inside a list in its own order.  A list that
cannot be read ends the run and stays first in the queue.

A run adds one folder of new positions, then one row with its cursor; a run that breaks off in between leaves no cursor,
so it has not happened, and the next run writes the same folder anew.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from statproof.functions.scale import first_per_key, running_sum_by_bucket, stable

POSITIONS = "list_id string, position long, run int"
CURSORS = "run int, visited long, interrupted string"
BUCKET = 4096


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _last_run(spark: SparkSession, folder: str):
    return _read(spark, f"{folder}/cursors/*", CURSORS).orderBy(F.desc("run")).first()


def _children(edges: DataFrame, batch: DataFrame, seen: DataFrame, after: int) -> DataFrame:
    """(list_id, position) of the lists that `batch` (list_id, position) names first, numbered from `after` + 1."""
    named = (edges.where(~F.col("is_table")).join(batch.select(F.col("list_id").alias("parent_id"), F.col("position").alias("_parent")), "parent_id")
             .select(F.col("child_id").alias("list_id"), "_parent", "ord").join(seen.select("list_id"), "list_id", "left_anti"))
    first = stable(first_per_key(named, ["list_id"], ["_parent", "ord", "list_id"]))
    sizes = first.groupBy("_parent").agg(F.count(F.lit(1)).alias("_size")).withColumn("_all", F.lit(0))
    ends = running_sum_by_bucket(sizes, ["_all"], F.floor(F.col("_parent") / BUCKET), ["_parent"], F.col("_size"), "_end")
    inside = F.row_number().over(Window.partitionBy("_parent").orderBy("ord", "list_id"))
    return (first.withColumn("_at", inside).join(ends.select("_parent", (F.col("_end") - F.col("_size")).alias("_before")), "_parent")
            .select("list_id", (F.lit(after) + F.col("_before") + F.col("_at")).cast("long").alias("position")))


def crawl(edges: DataFrame, roots: DataFrame, folder: str, max_lists: int, unreadable: DataFrame | None = None) -> DataFrame:
    """One run over edges(parent_id, child_id, is_table, ord): at most `max_lists` more lists are visited.  Gives the queue.

    roots(root_id) are the first lists of a new crawl, by id; a crawl that was begun keeps its queue.  unreadable(list_id)
    are lists whose entries cannot be read now.  Lists that several parents name, or that name themselves, are visited
    once; equal edges count once; `ord` may tie, then the id decides."""
    if max_lists < 1:
        raise ValueError("a run visits at least one list")
    spark = edges.sparkSession
    last = _last_run(spark, folder)
    run, visited = (last["run"] + 1, last["visited"]) if last else (1, 0)
    if last:
        seen = queue(spark, folder).select("list_id", "position")
        new = None
    else:
        start = Window.orderBy("list_id")  # the roots of a catalog are a few
        seen = new = stable(roots.select(F.col("root_id").cast("string").alias("list_id")).distinct().withColumn("position", F.row_number().over(start).cast("long")))
    known = seen.agg(F.max("position")).first()[0] or 0
    goal, interrupted = visited + max_lists, None
    while visited < min(goal, known):
        end = min(goal, known)
        batch = seen.where((F.col("position") > visited) & (F.col("position") <= end))
        if unreadable is not None:
            bad = batch.join(unreadable.select("list_id").distinct(), "list_id").orderBy("position").first()
            if bad:
                interrupted, end = bad["list_id"], bad["position"] - 1
                batch = batch.where(F.col("position") <= end)
        found = stable(_children(edges, batch, seen, known))
        visited, known = end, known + found.count()
        seen, new = seen.unionByName(found), found if new is None else new.unionByName(found)
        if interrupted:
            break
    if new is not None:
        new.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{folder}/positions/{run}")
    spark.createDataFrame([(run, visited, interrupted)], CURSORS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/cursors/{run}")
    return queue(spark, folder)


def queue(spark: SparkSession, folder: str) -> DataFrame:
    """list_id, position, run (that saw it first), state of every list that was seen: visited, interrupted, or pending."""
    last = _last_run(spark, folder)
    runs, visited, interrupted = (last["run"], last["visited"], last["interrupted"]) if last else (0, 0, None)
    at = F.col("position")
    state = F.when(at <= visited, "visited").when((at == visited + 1) & F.lit(interrupted is not None), "interrupted").otherwise("pending")
    return _read(spark, f"{folder}/positions/*", POSITIONS).where(F.col("run") <= runs).withColumn("state", state)


def crawled_tables(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """tbl_id, list_id of the tables of visited lists, each with the list that named it first."""
    named = edges.where("is_table").join(seen.where("state = 'visited'").select(F.col("list_id").alias("parent_id"), "position"), "parent_id")
    return first_per_key(named, ["child_id"], ["position", "ord"]).select(F.col("child_id").alias("tbl_id"), F.col("parent_id").alias("list_id"))
