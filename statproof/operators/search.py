"""Exact top-k over an inverted index without scoring every pair of a shared gram.

A gram's upper bound is the most it can add to a score.  Each query opens its rarest grams first.  The k best scores that
these alone give are a floor; a gram stays closed if a document that shares only it and the grams behind it cannot reach
the floor.  So the postings of a gram that most documents hold are met only by queries that have nothing rarer to tell
documents apart.  Documents whose seen score plus the bound of the closed grams reaches the floor are completed by an
equality on (document, gram).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from statproof.functions.scale import stable, top_per_key

OPENED = 64  # postings per wanted document that the first round may read beyond those of the rarest gram
SLACK = 1e-8  # sums of one pair may differ in their last bits by order; no bound is taken closer than this


def opened_grams(asked: DataFrame, postings: DataFrame, k: int, final: Callable, unseen: Callable) -> DataFrame:
    """asked(qg, g, wq, aq) and postings(dg, g, wd, ad) -> qg, g, wq, aq, floor, closed, early, opened.

    early: the rarest gram, and those that follow within `OPENED` postings a wanted document; floor: a score that at
    least k documents reach by early grams (null if these give fewer than k); closed: the most that all closed grams can
    add.  `final(dot, aq, ad)` grows with dot; `unseen(rest, aq)` is the best score of a document that shares only grams
    adding up to `rest`."""
    stats = postings.groupBy("g").agg(F.count(F.lit(1)).alias("df"), F.max("wd").alias("top"))
    rarest = Window.partitionBy("qg").orderBy("df", "g")
    ahead = rarest.rowsBetween(Window.unboundedPreceding, -1)
    behind = rarest.rowsBetween(0, Window.unboundedFollowing)
    ranked = stable(asked.join(stats.hint("merge"), "g").select(
        "qg", "g", "wq", "aq", F.coalesce((F.sum("df").over(ahead) + F.col("df")) <= OPENED * k, F.lit(True)).alias("early"), F.sum(F.col("wq") * F.col("top")).over(behind).alias("rest")))
    first = ranked.where("early").join(postings.hint("merge"), "g").groupBy("qg", "dg").agg(
        F.sum(F.col("wq") * F.col("wd")).alias("dot"), F.first("aq").alias("aq"), F.first("ad").alias("ad"))
    scored = first.select("qg", "dg", final(F.col("dot"), F.col("aq"), F.col("ad")).alias("s"))
    floors = top_per_key(scored, ["qg"], [F.desc("s"), "dg"], k, "_r").where(F.col("_r") == k).select("qg", F.col("s").alias("floor"))
    known = ranked.join(floors.hint("merge"), "qg", "left").withColumn("opened", F.col("floor").isNull() | (unseen(F.col("rest"), F.col("aq")) >= F.col("floor") - SLACK))
    closed = F.coalesce(F.max(F.when(~F.col("opened"), F.col("rest"))).over(Window.partitionBy("qg")), F.lit(0.0))
    return known.withColumn("closed", closed).select("qg", "g", "wq", "aq", "floor", "closed", "early", "opened")


def top_candidates(asked: DataFrame, postings: DataFrame, k: int, final: Callable, unseen: Callable) -> DataFrame:
    """qg, dg, dot, aq, ad of every pair that can be among the k best of its query, ties included, with the whole dot.

    A query text whose k best cannot be told from its rare grams opens all of them.  Queries or documents without grams,
    and grams that no document holds, give nothing."""
    postings = stable(postings)
    plan = stable(opened_grams(asked, postings, k, final, unseen))
    seen = plan.where("opened").join(postings.hint("merge"), "g").groupBy("qg", "dg").agg(
        F.sum(F.col("wq") * F.col("wd")).alias("seen"), F.first("aq").alias("aq"), F.first("ad").alias("ad"), F.first("floor").alias("floor"), F.first("closed").alias("closed"))
    best = final(F.col("seen") + F.col("closed"), F.col("aq"), F.col("ad"))
    left = stable(seen.where(F.col("floor").isNull() | (best >= F.col("floor") - SLACK)))
    rest = (left.where("closed > 0").select("qg", "dg").join(plan.where("NOT opened").select("qg", "g", "wq").hint("merge"), "qg")
            .join(postings.select("dg", "g", "wd").hint("merge"), ["dg", "g"]).groupBy("qg", "dg").agg(F.sum(F.col("wq") * F.col("wd")).alias("more")))
    return left.join(rest.hint("merge"), ["qg", "dg"], "left").select("qg", "dg", (F.col("seen") + F.coalesce("more", F.lit(0.0))).alias("dot"), "aq", "ad")
