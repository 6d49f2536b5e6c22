"""Building blocks that keep ordered logic distributed when one key, or no key at all, holds most rows."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BUCKETS = 256
SALTS = 16
BITMAP_WORDS = 1 << 14  # 64-bit words of a bitmap (128 KB); more values only let more through to the join


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`.  Where it is unset, a local session gets a temporary folder (tests); on a
    cluster that is an error, because other executors do not see a machine-local folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not folder:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="statproof-shared-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def stable(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative result with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, computed once for all that read it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_number(df: DataFrame, key: str, name: str = "row_number", buckets: int = BUCKETS) -> DataFrame:
    """Exact global 1-based position by a unique orderable key, without a single-task window.

    Quantile bounds (a mergeable sketch) split the key range; any bounds give exact numbers because each bucket's
    offset is the true count before it.  Only the bucket counts (<= buckets + 1 rows) are summed in one place.
    """
    steps = F.array(*[F.lit((i + 1) / (buckets + 1)) for i in range(buckets)])
    bounds = df.agg(F.percentile_approx(key, steps, 10 * buckets).alias("b")).scalar()
    marked = (df.withColumn("_bounds", bounds)
              .withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col(key)))).drop("_bounds"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
               .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    inner = Window.partitionBy("_bucket").orderBy(key)
    return (marked.join(F.broadcast(offsets), "_bucket")
            .withColumn(name, F.row_number().over(inner) + F.col("_offset")).drop("_bucket", "_offset"))


def value_positions(df: DataFrame, value: str, buckets: int = BUCKETS) -> DataFrame:
    """(value, lo, hi, total): a value of the sorted column stands at the 0-based positions lo..hi-1 of `total`.

    Works on the histogram of values: each bucket of the value range sums its own counts and starts after the exact count
    of the buckets before it, so no task orders all values.  Nulls have no position."""
    hist = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    steps = F.array(*[F.lit((i + 1) / (buckets + 1)) for i in range(buckets)])
    bounds = hist.agg(F.percentile_approx("value", steps, 10 * buckets).alias("b")).scalar()
    marked = (hist.withColumn("_bounds", bounds)
              .withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b < F.col("value")))).drop("_bounds"))
    order = Window.orderBy("_bucket")
    starts = (marked.groupBy("_bucket").agg(F.sum("_n").alias("_sum"))
              .select("_bucket", F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
                      F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total")))
    hi = F.sum("_n").over(Window.partitionBy("_bucket").orderBy("value")) + F.col("_start")
    return marked.join(F.broadcast(starts), "_bucket").withColumn("hi", hi).select("value", (F.col("hi") - F.col("_n")).alias("lo"), "hi", "total")


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row per key.  `row_number() = 1` lets Spark drop losers map-side (window group limit), so a hot key sends
    at most one row per map task through the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def ranked_per_key(df: DataFrame, keys: list, order: list, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_key(df: DataFrame, keys: list, order: list, k: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def lag_by_bucket(df: DataFrame, keys: list, bucket: Column, order: list, value: str, name: str) -> DataFrame:
    """`lag(value)` per key over a long log: windows run inside (key, time bucket); the first row of a bucket takes
    the last value of the key's previous non-empty bucket from a small per-bucket summary."""
    part = df.withColumn("_tb", bucket)
    seq = F.struct(*[F.col(c) for c in order])
    w = Window.partitionBy(*keys, "_tb").orderBy(*order)
    tails = part.groupBy(*keys, "_tb").agg(F.max_by(F.struct(F.col(value).alias("v")), seq)["v"].alias("_last"))
    carried = tails.select(*keys, "_tb", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_tb")).alias("_carry"))
    return (part.withColumn("_in", F.lag(F.struct(F.col(value).alias("v"))).over(w)).join(carried, [*keys, "_tb"])
            .withColumn(name, F.when(F.col("_in").isNull(), F.col("_carry")).otherwise(F.col("_in")["v"]))
            .drop("_tb", "_in", "_carry"))


def running_sum_by_bucket(df: DataFrame, keys: list, bucket: Column, order: list, value: Column, name: str) -> DataFrame:
    """Running total per key in the same two levels: inside the bucket, plus the total of all earlier buckets."""
    part = df.withColumn("_tb", bucket).withColumn("_v", value)
    w = Window.partitionBy(*keys, "_tb").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (part.groupBy(*keys, "_tb").agg(F.sum("_v").alias("_n"))
               .select(*keys, "_tb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")))
    return (part.withColumn("_in", F.sum("_v").over(w)).join(offsets, [*keys, "_tb"])
            .withColumn(name, F.col("_in") + F.col("_offset")).drop("_tb", "_v", "_in", "_offset"))


def last_known_by_bucket(df: DataFrame, keys: list, bucket: Column, order: list, value: Column, name: str) -> DataFrame:
    """Latest non-null `value` of strictly earlier rows per key, in the same two levels."""
    part = df.withColumn("_tb", bucket).withColumn("_v", value)
    seq = F.struct(*[F.col(c) for c in order])
    w = Window.partitionBy(*keys, "_tb").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    tails = part.groupBy(*keys, "_tb").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), seq)).alias("_last"))
    carried = tails.select(*keys, "_tb", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    return (part.withColumn("_in", F.last("_v", ignorenulls=True).over(w)).join(carried, [*keys, "_tb"])
            .withColumn(name, F.coalesce("_in", "_carry")).drop("_tb", "_v", "_in", "_carry"))


def _slot(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(64 * BITMAP_WORDS))


def bitmap_of(values: DataFrame, value: str) -> Column:
    """Bitmap of fixed size (128 KB) over the hashes of a column, as a scalar."""
    slots = values.select(_slot(F.col(value)).alias("s")).groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 AS int))")).alias("w"))
    every = values.sparkSession.range(BITMAP_WORDS).select(F.col("id").alias("at")).join(slots, "at", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("w", F.lit(0).cast("long")).alias("w")))), lambda x: x["w"])).scalar()


def likely_in(bits: str, value: Column) -> Column:
    """False only if `value` is none of the values of the bitmap in column `bits`."""
    found = F.transform(F.array(_slot(value)), lambda s: F.getbit(F.element_at(F.col(bits), (F.shiftright(s, 6) + 1).cast("int")), (s % 64).cast("int")) == 1)
    return F.get(found, F.lit(0))


def salted_join(big: DataFrame, small: DataFrame, keys: list, spread: list, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join many rows with a small table on keys of few values.  The rows of one key are dealt to `salts` groups by a hash of
    the `spread` columns and the small table is copied to each group; neither side is broadcast, whatever its estimate."""
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts))).join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def anchored_contains(texts: DataFrame, text: str, needles: DataFrame, needle: str, on: list | None = None,
                      gram: int = 2, salts: int = 1) -> DataFrame:
    """Pairs where the needle occurs in the text, as an equi-join: each needle is filed under its first `gram`
    characters and each text under those of its distinct grams that may begin a needle, then the hit is confirmed.  Shorter
    needles are filed under their own full length, so the join is exact for any length.  `on` adds equality keys.

    Sizes are estimated before texts are cut into grams, so the join is sorted rather than broadcast on such an estimate.
    With few needles for many texts, `salts` deals the texts of one gram to so many groups and copies the needles to each."""
    on = on or []
    filed = (needles.where(F.length(needle) > 0)
             .withColumn("_gram", F.substring(needle, F.lit(1), F.least(F.length(needle), F.lit(gram)))))
    def windows(g: int) -> Column:
        last = F.greatest(F.length(text) - g + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col(text), i, F.lit(g)))
    grams = F.filter(F.array_distinct(F.flatten(F.array(*[windows(g) for g in range(1, gram + 1)]))), lambda w: likely_in("_bits", w))
    cut = texts.withColumn("_bits", bitmap_of(filed.select("_gram").distinct(), "_gram")).withColumn("_gram", F.explode(grams)).drop("_bits")
    return (salted_join(cut, filed, [*on, "_gram"], texts.columns, salts=salts)
            .where(F.col(text).contains(F.col(needle))).drop("_gram"))


def contained_maps(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """(w, o) where the non-empty map of wanted(w, wmap) is part of the map of offered(o, omap); ids are unique.

    Each wanted map is filed under its rarest pair among the offered maps, meets only the maps that hold this pair and is
    confirmed on the maps.  A pair that most maps share makes no meetings unless a wanted map has nothing rarer."""
    pairs = offered.select("o", F.explode("omap").alias("_k", "_v"))
    often = pairs.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_n"))
    filed = (wanted.select("w", F.explode("wmap").alias("_k", "_v")).join(often, ["_k", "_v"], "left").groupBy("w")
             .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_k").alias("k"), F.col("_v").alias("v"))).alias("_rare")))
    near = filed.select("w", F.col("_rare.k").alias("_k"), F.col("_rare.v").alias("_v")).join(pairs, ["_k", "_v"]).select("w", "o")
    holds = F.forall(F.map_entries("wmap"), lambda e: F.coalesce(F.try_element_at("omap", e["key"]) == e["value"], F.lit(False)))
    return near.join(wanted, "w").join(offered, "o").where(holds).select("w", "o")
