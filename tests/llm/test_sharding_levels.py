"""op9 draws at all three levels, and from 8 shards on one more shard takes rows only into itself."""
import math

import xxhash

from statproof.llm import queries, sharding


def draw(key, name, weight):
    h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42))
    return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight


def plain(key, n):
    """Region, rack and shard by plain draws."""
    regions = {"/region0": 4, "/region1": 4} | {f"/region+{s}": 1 for s in range(8, n)}
    region = min(regions, key=lambda r: draw(key, r, regions[r]))
    if "+" in region:
        return int(region.split("+")[1])
    at = int(region[-1])
    rack = min((2 * at, 2 * at + 1), key=lambda r: draw(key, f"{region}/rack{r}", 2))
    return min((2 * rack, 2 * rack + 1), key=lambda s: draw(key, f"{region}/rack{rack}/{s}", 1))


def test_query_draws_at_every_level(spark, tmp_path):
    spark.range(-20, 600).selectExpr("id AS doc_id", "'x' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op9_sharding(spark, str(tmp_path)).collect()
    assert len(rows) == 620 and {r.shard for r in rows} == set(range(8))
    assert all((r.shard, r.grown_shard) == (plain(r.doc_id, 8), plain(r.doc_id, 9)) for r in rows)


def test_law_from_eight_shards_on(spark):
    found = spark.range(400).select("id", *[sharding.shard_of("id", sharding.levelled_tree(n)).alias(f"n{n}") for n in range(8, 14)]).collect()
    assert all(r[f"n{n}"] in (r[f"n{n - 1}"], n - 1) for r in found for n in range(9, 14))
    assert all(r.n13 == plain(r.id, 13) for r in found)
