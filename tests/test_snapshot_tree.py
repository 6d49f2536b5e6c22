"""The hash tree of a snapshot, and the first object of a judge's reply."""
import hashlib
import random

from pyspark.sql import functions as F

from statproof.functions.text import first_json_object
from statproof.operators import snapshots as op


def _stats(spark, n, tables=1):
    rows = [("1", f"T{i % tables}", f"{1990 + i % 30}", str(i // 3), "건", "수", "2020-01-01", "지역", f"r{i % 7}") for i in range(n)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows + rows[:3], "org_id string, tbl_id string, prd_de string, dt string, unit_nm string, itm_nm string, lst_chn_de string, c1_obj_nm string, c1_nm string")


def _plain(digests: dict, prefix: str = "") -> str:
    """The definition, by recursion: {digest: count} -> hash of the node."""
    if len(digests) <= op.LEAF:
        text = ";".join(sorted(f"{h}*{c}" for h, c in digests.items()))
    else:
        below = {}
        for h, c in digests.items():
            below.setdefault(h[len(prefix)], {})[h] = c
        text = ";".join(d + _plain(part, prefix + d) for d, part in sorted(below.items()))
    return hashlib.sha256(text.encode()).hexdigest()


def test_tree_follows_its_definition_for_any_partitioning(spark):
    stats = _stats(spark, 3000, 2).unionByName(_stats(spark, 40).withColumn("tbl_id", F.lit("small")))
    digests: dict = {}
    for r in stats.collect():
        line = "|".join([r.prd_de, r.itm_nm, f"{r.c1_obj_nm}={r.c1_nm}", r.dt, r.unit_nm, r.lst_chn_de])
        h = hashlib.sha256(line.encode()).hexdigest()
        digests.setdefault(r.tbl_id, {}).setdefault(h, 0)
        digests[r.tbl_id][h] += 1
    want = {t: (sum(d.values()), _plain(d)) for t, d in digests.items()}
    for parts in (1, 7):
        got = {r.tbl_id: (r.n_records, r.content_hash) for r in op.snapshot_tree(stats.repartition(parts)).collect()}
        assert got == want


def test_tree_tells_counts_of_equal_records_apart_and_takes_an_empty_table(spark):
    one, two = _stats(spark, 10), _stats(spark, 10).union(_stats(spark, 10).limit(1))
    assert op.snapshot_tree(one).first().content_hash != op.snapshot_tree(two).first().content_hash
    assert op.snapshot_tree(one.where("false")).count() == 0


def test_first_object_of_a_reply(spark):
    cases = [('says {"a": 1} then {"b": 2}', '{"a":1}'), ('{broken {"a": {"b": [1, 2]}} tail', '{"a":{"b":[1,2]}}'), ("{{{{", None), ("no braces", None),
             ("", None), (None, None), ("{" * 3000 + '{"z": "{"}', '{"z":"{"}')]
    df = spark.createDataFrame([c[:1] for c in cases], "r string")
    got = [r[0] for r in df.select(first_json_object(F.col("r"))).collect()]
    assert [g and g.replace(" ", "") for g in got] == [w for _, w in cases]
