"""License scan by diagonal voting, in DataFrame functions only.

All rolling word 2-grams of the documents are joined, by hash and then by their text, to the positions of the same
2-gram in short templates (a broadcast table of fixed size).  A hit votes for the diagonal word position - template
position; a copy of a template puts its votes on one diagonal, edits move them to neighbouring ones.  Diagonals at most
`GAP` apart merge into a span, which is verified by its share of the template, its length and the 2-grams that the
template demands.  Base phrases and notices demand every 2-gram, on the same diagonal.  A wording inside a longer one
that was found does not count: 'CC BY-NC' inside 'CC BY-NC-SA'.  2-grams of two common words vote only where demanded.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .license_table import wordings

GAP = 2
SHARE = 0.8
STRETCH = 1.25
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases and labels of the base scan.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
COMMON = set("a all and any are as at be by for from if in is it its may not of on or other such that the this to under was with you your".split())
DEMANDED = 60  # 2-grams that a template may demand: one bit each


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(gram, template, at, grams, words, label, base, bit, demand, exact); one row for each 2-gram that votes, and one
    that every document meets.  Words in brackets are demanded."""
    rows = [("", -1, 0, 1, 1, "", False, 0, 0, True)]
    all_ = [(f"[{p}]", label, True) for p, label in BASE.items()] + [(p, label, False) for p, label in (wordings() if templates is None else templates).items()]
    for n, (phrase, label, base) in enumerate(all_):
        words, inside, demanded = [], False, []
        for word in phrase.split():
            inside |= word.startswith("[")
            words.append(word.strip("[]"))
            demanded.append(inside)
            inside &= not word.endswith("]")
        pairs = [(i, f"{a} {b}", demanded[i] and demanded[i + 1]) for i, (a, b) in enumerate(zip(words, words[1:]))]
        pairs = [(i, gram, must) for i, gram, must in pairs if must or not COMMON.issuperset(gram.split())]
        bits = {i: 1 << at for at, i in enumerate(i for i, _, must in pairs if must)}
        if not pairs or len(bits) > DEMANDED:
            raise ValueError(f"a template needs a 2-gram that votes and may demand {DEMANDED}: {phrase}")
        rows += [(gram, n, i, len(pairs), len(words), label, base, bits.get(i, 0), sum(bits.values()), len(bits) == len(words) - 1) for i, gram, _ in pairs]
    table = spark.createDataFrame(rows, "gram string, template int, at int, grams int, words int, label string, base boolean, bit long, demand long, exact boolean")
    return table.withColumn("hash", F.xxhash64("gram"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words, no labels, null positions and score 0.  Repeated rows and null keys give a row
    each; an empty table gives no rows; other columns are not read.  score is the largest verified share of a template
    (1 for a base phrase or a notice).  labels holds the base labels and those of `templates` (phrase to label, demanded
    words in brackets; by default the wordings of `license_table`)."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), words.alias("_words"))

    def gram(word, i):
        joined = F.concat_ws(" ", word, F.get("_words", i + 1))
        return F.struct(i.alias("pos"), F.xxhash64(joined).alias("hash"), joined.alias("gram"))
    marker = F.array(F.struct(F.lit(-1).alias("pos"), F.xxhash64(F.lit("")).alias("hash"), F.lit("").alias("gram")))
    table = template_table(df.sparkSession, templates)  # some thousand rows, whatever the data
    hits = (rows.select("_row", "_key", F.size("_words").cast("long").alias("n_words"), F.explode(F.concat(marker, F.transform("_words", gram))).alias("g"))
            .select("_row", "_key", "n_words", "g.*")
            .join(F.broadcast(table.select("hash", "gram", "template", "at", "bit")), ["hash", "gram"])
            .select("_row", "_key", "n_words", "template", "bit", "pos", (F.col("pos") - F.col("at")).alias("diagonal")))
    of_template = ["grams", "words", "label", "base", "demand", "exact"]
    of_span = ["_row", "_key", "n_words", "template", *of_template]
    diagonals = (hits.repartition("_row").groupBy("_row", "_key", "n_words", "template", "diagonal")
                 .agg(F.count(F.lit(1)).alias("votes"), F.bit_or("bit").alias("bits"), F.min("pos").alias("start"), F.max("pos").alias("end"))
                 .join(F.broadcast(table.select("template", *of_template).distinct()), "template")
                 .where(~F.col("exact") | (F.col("votes") == F.col("grams"))))  # a part of a notice tells nothing
    near = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = (F.col("exact") | (F.col("diagonal") - F.lag("diagonal", 1).over(near) > GAP)).cast("int")
    spans = (diagonals.withColumn("span", F.coalesce(apart, F.lit(1))).withColumn("span", F.sum("span").over(near))
             .groupBy(*of_span, "span").agg(F.sum("votes").alias("votes"), F.bit_or("bits").alias("bits"), F.min("start").alias("start"), F.max("end").alias("end")))
    share = F.least(F.lit(1.0), F.col("votes") / F.col("grams"))
    verified = (F.col("bits") == F.col("demand")) & (share >= SHARE) & (F.col("end") - F.col("start") + 2 <= F.col("words") * STRETCH) & (F.col("template") >= 0)
    # Wordings with the same words of the text are one place; a place inside a longer one is dropped.
    places = spans.withColumn("share", share).withColumn("good", verified).groupBy("_row", "_key", "n_words", F.col("base") | ~F.col("good"), "start", "end")
    places = places.agg(F.collect_set(F.when(F.col("good"), F.col("label"))).alias("found"), F.max(F.when(F.col("good"), F.col("share"))).alias("share"))
    places = places.toDF("_row", "_key", "n_words", "apart", "start", "end", "found", "share")
    before = Window.partitionBy("_row", "apart").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("reach", F.max("end").over(before)).where(F.col("apart") | F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    base = F.col("apart") & (F.size("found") > 0)

    def joined(condition):
        return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(condition, F.col("found")))))), ",")
    return (places.groupBy("_row", "_key", "n_words")
            .agg(F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
                 F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"), joined(base).alias("base_labels"), joined(F.size("found") > 0).alias("labels"),
                 F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
            .withColumnRenamed("_key", key).drop("_row"))
