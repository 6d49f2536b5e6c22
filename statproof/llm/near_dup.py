"""Near duplicates: Jaccard join on word n-grams through MinHash banding.

1. Equal n-gram sets form classes (128-bit set hash), so copies meet once.
2. `bands_for` picks band and row counts for the target recall at the threshold.  Classes shuffle on band hashes; each
   class is tied to the smallest class of every band bucket it shares (no pairs), and ties form candidate clusters.
3. Inside a cluster only sizes that allow the threshold meet: classes are filed by size (each also visits the next
   larger file) and files are cut into blocks; a task compares two blocks on the full n-gram sets by sparse counting.
   Only sums and one tree of links leave it, so a group of k near copies gives O(k) rows.
4. Verified links form the groups; the smallest key of a group stays.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .shared import numbered, partitions, slices, written

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
HASHES = 144
BLOCK = 512
COLUMNS = 4096


def bands_for(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most selective choice that finds a pair at the threshold with the wanted probability."""
    fitting = [(b, r) for r in range(1, hashes + 1) if (b := math.ceil(math.log(1 - recall) / math.log1p(-threshold ** r))) * r <= hashes]
    if not fitting:
        raise ValueError("too few hashes for this recall")
    return max(fitting, key=lambda x: x[1])


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text: lower case, words between white space.  A text with fewer
    words than n has one n-gram of all its words; a text without words has none."""
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in (text or "").lower().split()], np.uint64)
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    grams = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        grams = (grams ^ hashes[i:len(hashes) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    return np.unique(grams)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.masks = rng.integers(0, 1 << 32, bands * rows, np.uint32)
        self.factors = rng.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
        self.salts = rng.integers(0, 1 << 63, bands, np.uint64)

    def sign(self, grams: np.ndarray) -> np.ndarray:
        low = (_mix(grams) >> np.uint64(32)).astype(np.uint32)
        lowest = np.full(len(self.masks), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(low), 512):
            lowest = np.minimum(lowest, ((low[at:at + 512, None] ^ self.masks) * self.factors).min(0))
        out = self.salts.copy()
        for part in lowest.reshape(self.bands, self.rows).T.astype(np.uint64):
            out = _mix(out ^ part * np.uint64(0x9E3779B97F4A7C15))
        return out.view(np.int64)


def _signatures(words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            out = []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = shingles(text, words)
                if len(grams):
                    a, b = (int(np.bitwise_xor.reduce(_mix(grams * np.uint64(f))).view(np.int64)) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
                    out.append((row, a, b, len(grams), signer.sign(grams)))
                else:
                    out.append((row, row, -1, 0, []))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names=["_row", "_a", "_b", "_n", "_bands"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            texts = [shingles(t, words).tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=[*batch.schema.names[:-1], "_set"])
    return run


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: only n-grams on both sides count, a strip of them at a time."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.int64)

    def cells(sets, flat):
        at = np.searchsorted(shared, flat)
        at[at == len(shared)] = 0
        keep = shared[at] == flat
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[keep], at[keep]
    if not len(shared):
        return out
    (ra, ca), (rb, cb) = cells(left, a), cells(right, b)
    for start in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - start)
        strips = []
        for rows, columns, n in ((ra, ca, len(left)), (rb, cb, len(right))):
            inside = (columns >= start) & (columns < start + width)
            strip = np.zeros((n, width), np.float32)
            strip[rows[inside], columns[inside] - start] = 1
            strips.append(strip)
        out += (strips[0] @ strips[1].T).astype(np.int64)
    return out


def _verify(threshold: float):
    share = Fraction(str(threshold))
    over, under = share.numerator, share.numerator + share.denominator

    def compare(members: list[tuple]) -> list[tuple]:
        """Members: (class, copies, visitor, block, set).  Gives (class, links, root) of linked classes."""
        first = min(m[3] for m in members)
        left = [m for m in members if m[3] == first]
        right = [m for m in members if m[3] != first] or left
        found = common([m[4] for m in left], [m[4] for m in right])
        size = [np.array([len(m[4]) for m in side]) for side in (left, right)]
        linked = found * under >= over * (size[0][:, None] + size[1])
        visitor = [np.array([m[2] for m in side]) for side in (left, right)]
        linked &= ~(visitor[0][:, None] & visitor[1])
        if left is right:
            linked = np.triu(linked, 1)
        links: dict[int, int] = {}
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(linked))):
            a, b = left[i], right[j]
            links[a[0]] = links.get(a[0], 0) + b[1]
            links[b[0]] = links.get(b[0], 0) + a[1]
            x, y = sorted((top(a[0]), top(b[0])))
            root[y] = x
        return [(c, n, top(c)) for c, n in links.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members, out = None, [], []
        for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1)):
            for cluster, level, i, j, c, copies, visitor, block, grams in zip(*(col.to_pylist() for col in batch.columns)):
                if (cluster, level, i, j) != current:
                    out += compare(members) if len(members) > 1 else []
                    current, members = (cluster, level, i, j), []
                members.append((c, copies, visitor, block, np.frombuffer(grams, np.uint64)))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["c", "links", "root"])
                out = []
        out += compare(members) if len(members) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 3)], names=["c", "links", "root"])
    return run


def groups(rows: DataFrame, key: str = "_key", text: str = "_text", words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """For a stored table with unique `_row`: _row, class_id, class_size, n_links, group_id, kept."""
    bands, per_band = bands_for(threshold, recall, hashes)
    signed = written(rows.select("_row", F.col(text)).mapInArrow(_signatures(words, bands, per_band), "_row long, _a long, _b long, _n int, _bands array<long>"), "signatures")
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("_row").alias("row"))
    classes = (rows.select("_row", F.col(key)).join(signed.drop("_bands"), "_row").groupBy("_a", "_b", "_n")
               .agg(F.min(order).alias("_rep"), F.count(F.lit(1)).alias("_copies")).withColumn("c", F.col("_rep.row")))
    classes = written(classes, "classes")
    filed = classes.select("c").join(signed.select(F.col("_row").alias("c"), "_bands"), "c").select("c", F.explode("_bands").alias("_band"))
    buckets = filed.groupBy("_band").agg(F.min("c").alias("m"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    ties = filed.join(buckets, "_band").select(F.col("c").alias("u"), F.col("m").alias("v"))
    clusters = components(ties).withColumnsRenamed({"node": "c", "label": "_cluster"})

    level = F.floor(F.log(F.col("_n").cast("double")) / (math.log(1 / threshold) * 1.0001)).cast("int")
    members = clusters.join(classes.select("c", "_n", "_copies"), "c").withColumn("_level", level)
    members = members.join(rows.select(F.col("_row").alias("c"), F.col(text).alias("_body")), "c").select("c", "_cluster", "_level", "_copies", "_body")
    members = written(members.mapInArrow(_sets(words), "c long, _cluster long, _level int, _copies long, _set binary"), "sets")
    seats = members.select("c", "_cluster", F.explode(F.array(F.struct(F.col("_level").alias("level"), F.lit(False).alias("visitor")), F.struct((F.col("_level") + 1).alias("level"), F.lit(True).alias("visitor")))).alias("s")).select("c", "_cluster", "s.*")
    sizes = (seats.groupBy("_cluster", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("visitor")).alias("own")).where("own > 0 and n > 1")
             .select("_cluster", "level", F.ceil(F.col("n") / BLOCK).cast("int").alias("_blocks")))
    block = F.pmod(F.xxhash64("c"), F.col("_blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda other: F.struct(F.least("_block", other).alias("i"), F.greatest("_block", other).alias("j")))
    seated = (seats.join(sizes, ["_cluster", "level"]).withColumn("_block", block).withColumn("p", F.explode(pairs))
              .select("c", "_cluster", "level", "visitor", "_block", "p.i", "p.j"))
    cells = (seated.join(members.select("c", "_copies", "_set"), "c").repartition(partitions(rows.sparkSession), "_cluster", "level", "i", "j")
             .sortWithinPartitions("_cluster", "level", "i", "j")
             .select("_cluster", "level", "i", "j", "c", "_copies", "visitor", "_block", "_set"))
    links = written(cells.mapInArrow(_verify(threshold), "c long, links long, root long"), "links")
    linked = links.groupBy("c").agg(F.sum("links").alias("_links"))
    labels = components(links.select(F.col("c").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"node": "c"})
    known = classes.join(linked, "c", "left").join(labels, "c", "left").withColumn("label", F.coalesce("label", "c"))
    first = known.groupBy("label").agg(F.min("_rep").alias("_first"))
    known = known.join(first, "label").select("_a", "_b", "_n", F.col("_rep.key").alias("class_id"), F.col("_copies").alias("class_size"),
                                              (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), F.col("_first.key").alias("group_id"), F.col("_first.row").alias("_stays"))
    return (signed.select("_row", "_a", "_b", "_n").join(known, ["_a", "_b", "_n"])
            .select("_row", "class_id", "class_size", "n_links", "group_id", (F.col("_row") == F.col("_stays")).alias("kept")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: key, class_id (smallest key with the same n-gram set), class_size, n_links (rows linked
    to it, copies included), group_id (smallest key of its group), kept (one row of each group).

    Null, empty and blank texts have no n-grams and stay alone.  Null keys come last; of repeated rows one is kept.
    Texts are read whole; an empty table gives no rows; other columns are not read."""
    rows = numbered(df.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text")), "near-rows")
    found = groups(rows, **options)
    return rows.select("_row", F.col("_key").alias(key)).join(found, "_row").drop("_row")


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that stay, with the columns of the input."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in (key, text)] or [F.lit(0).alias("none")]
    rows = numbered(df.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"), F.struct(*others).alias("_rest")), "near-rows")
    kept = groups(rows.drop("_rest"), **options).where("kept").select("_row")
    named = {key: F.col("_key").alias(key), text: F.col("_text").alias(text)}
    return rows.join(kept, "_row").select(*[named.get(c, F.col("_rest").getField(c).alias(c)) for c in df.columns])
