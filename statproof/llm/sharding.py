"""Sharding by a hierarchical weighted hash tree (region, rack, shard), in DataFrame functions only.

At each level every child draws -ln(u)/weight, with u a uniform hash of (row key, child name); the smallest draw wins.
A child's weight is the sum of its shards.  A draw depends on the row key and that child alone, so a changed weight
moves rows only into or out of the subtrees whose weights change.  `grow` hangs a new shard into a region of its own:
no other subtree changes its weight, hence every row that moves goes to the new shard.  `tree_of` grows a tree shard by
shard; a shard added to a region that has others would pull rows into those as well.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import numbered

CHUNK_BITS = 16

Tree = dict[str, dict[str, dict[int, float]]]


def uniform_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> Tree:
    """Shards of weight 1, filled into racks and regions in order."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def grow(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region and rack of its own."""
    return tree | {f"region+{shard}": {f"rack+{shard}": {shard: weight}}}


def tree_of(shards: int) -> Tree:
    """The tree that a number of shards decides: `tree_of(n + 1)` is `tree_of(n)`, grown, so one more shard takes rows only
    into itself, at every n."""
    tree: Tree = {}
    for s in range(shards):
        tree = grow(tree, s)
    return tree


def levelled_tree(shards: int, first: int = 8) -> Tree:
    """The tree of a layout that began with `first` shards in regions and racks: every level draws among them, and each
    shard beyond hangs in a region of its own.  `levelled_tree(n + 1)` is `levelled_tree(n)`, grown, for every n >= first, so
    one more shard takes rows only into itself.  `first` belongs to the layout and stays when it grows."""
    if shards < first:
        raise ValueError("a layout has at least the shards it began with")
    tree = uniform_tree(first)
    for s in range(first, shards):
        tree = grow(tree, s)
    return tree


def _weight(node) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def _descend(key: Column, path: str, node) -> Column:
    if not isinstance(node, dict):
        return F.lit(int(path.rpartition("/")[2]))
    children = [(f"{path}/{name}", child) for name, child in node.items() if _weight(child) > 0]
    if len(children) == 1:
        return _descend(key, *children[0])
    won = F.array_min(F.array(*[F.struct(_draw(key, name, _weight(child)).alias("d"), F.lit(i).alias("i"))
                                for i, (name, child) in enumerate(children)]))["i"]
    out = F.when(won == 0, _descend(key, *children[0]))
    for i, child in enumerate(children[1:], 1):
        out = out.when(won == i, _descend(key, *child))
    return out


def shard_of(key: str, tree: Tree) -> Column:
    """Shard of a row by its key alone.  A null key is a key like any other: all its rows share one shard."""
    return _descend(F.col(key), "", tree)


def place(df: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", new_shard: int | None = None) -> DataFrame:
    """One row per input row: key, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard.

    Null and empty texts have size 1 and the checksum of no bytes.  Repeated rows each get a slot.  An empty table
    gives no rows.  Extra columns are not read.  Slots count the rows of a shard without gaps: rows are numbered inside
    chunks of 65,536 stored rows and a chunk starts at the summed counts of the chunks before, so no task sorts a whole
    shard and a key that holds a third of the rows is spread over chunks.
    """
    new_shard = 1 + max(s for racks in tree.values() for rack in racks.values() for s in rack) if new_shard is None else new_shard
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
                     shard_of(key, tree).alias("shard"), shard_of(key, grow(tree, new_shard)).alias("grown_shard"))
    rows = numbered(rows, "shards").withColumn("_chunk", F.shiftright("_row", CHUNK_BITS))
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("shard", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
              .select("shard", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("_row"))
    return (rows.withColumn("_at", inside).join(starts, ["shard", "_chunk"])
            .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("_start") + F.col("_at") - 1).cast("long").alias("slot"), "grown_shard"))
