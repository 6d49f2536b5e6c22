"""Details of equal order in the flat export."""
from statproof.plans import lab_queries


def test_lines_of_equal_order_stand_as_in_their_file(spark, tmp_path):
    lines = [(1, 1_100_000, 1, "A"), (1, 100_000, 2, "R"), (1, 5, 1, "A"), (2, 100_000, 2, "R"), (2, 1_100_000, 1, "A"), (2, 7, 3, "N"), (3, 9, 1, "N")]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, "O") for i in (1, 2, 3, 4)], "o_orderkey long, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in lab_queries.g10(spark, str(tmp_path)).collect())
    assert got == [(1, "O", "5 | 1100000 | 100000", 3, "", 0), (2, "O", "100000 | 1100000", 2, "N", 1), (3, "O", "", 0, "N", 1), (4, "O", "", 0, "", 0)]
