"""No join of a search rests on a size estimate: the driver gathers none of its sides."""
from pyspark.sql import functions as F

from statproof.operators import ranking


def test_searches_broadcast_nothing_but_scalars(spark):
    catalog = spark.range(40).select(F.col("id").alias("ord"), F.concat(F.lit("table number "), F.col("id") % 7).alias("doc"), F.lit("kw").alias("keywords"))
    queries = spark.range(9).select(F.col("id").alias("qid"), F.concat(F.lit("number "), F.col("id")).alias("query"))
    for search in (ranking.search_overlap, ranking.search_tfidf, ranking.search_substring):
        found = search(queries, catalog, 3)
        assert found.count() and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
