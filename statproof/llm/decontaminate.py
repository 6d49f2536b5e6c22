"""Benchmark decontamination with a positional inverted index, in DataFrame functions only.

1. `postings` tokenises the training documents once and stores (document, term, position) of every token that may be a
   benchmark term; a bitmap of fixed size, not a list, tells which may.  No shuffle: each task writes its documents.
2. Terms are counted over the whole index.  Item windows of equal words are one phrase; a phrase with a term that the
   index does not hold cannot occur.
3. `phrases` intersects offset-adjusted lists from the rarest term of a phrase: its list gives (document, start), the
   list of the second rarest term keeps some, and what is left is confirmed term by term on the index.  Terms are
   compared as text, so no hash decides.  Joins on a term are salted, as one term may fill a third of the index.
4. `proximity` finds items whose rarest words stand close together in any order.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import bitmap, in_bitmap, numbered, written

WINDOW = 10
NEAR = 20     # words: the stretch of a proximity match
RAREST = 3    # words of an item that a proximity match holds
SALTS = 16
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SEPARATORS, -1), "")


def _fold(word: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def _salt(row: Column) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int")


def _on_every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """A stored table (item, item_id, n, pos, term); `item` tells rows with the same id apart."""
    rows = numbered(items.select(F.col(key).alias("item_id"), _words(text).alias("words")), "items")
    return written(rows.select(F.col("_row").alias("item"), "item_id", F.size("words").alias("n"), F.posexplode("words").alias("pos", "term"))
                   .withColumn("term", _fold(F.col("term"))), "item-terms")


def postings(df: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """The stored index: (row, _key, term, pos) of the tokens whose term may be one of `terms`, and for every document one
    line with an empty term, its key, and its number of words as position."""
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("_key"), F.concat(_words(text), F.array(F.lit(""))).alias("words"))
    tokens = docs.select("row", "_key", F.posexplode("words").alias("pos", "word")).withColumn("term", _fold(F.col("word")))
    marker = F.col("term") == ""
    kept = tokens.where(marker | in_bitmap(bitmap(terms, "term"), F.col("term")))
    return written(kept.select("row", F.when(marker, F.col("_key")).alias("_key"), "term", "pos"), "postings")


def counted(index: DataFrame, terms: DataFrame) -> DataFrame:
    """`terms` with the number of their postings, `often`."""
    often = index.where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    return written(terms.join(often, "term", "left").na.fill(0, ["often"]), "counted-terms")


def windows(terms: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Stored tables of the phrases that can occur, (phrase, terms, first, second), and of (phrase, item_id).

    `first` and `second` are the offset and term of the two rarest words; a phrase of one word has no second."""
    order = Window.partitionBy("item").orderBy("pos").rowsBetween(0, width - 1)
    found = (terms.withColumn("w", F.collect_list(F.struct("often", "term")).over(order)).where(F.col("pos") <= F.greatest(F.col("n") - width, F.lit(0)))
             .where(~F.exists("w", lambda x: x["often"] == 0)))
    found = written(found.select("item_id", F.transform("w", lambda x: x["term"]).alias("terms"), F.transform("w", lambda x: x["often"]).alias("often")).distinct(), "windows")
    ranked = F.array_sort(F.transform("often", lambda n, i: F.struct(n.alias("n"), i.alias("at"))))

    def probe(k: int) -> Column:
        at = F.get("ranked", F.lit(k))["at"]
        return F.when(F.size("terms") > k, F.struct(at.alias("at"), F.get("terms", at).alias("term")))
    phrases = numbered(found.select("terms", "often").distinct().withColumn("ranked", ranked).select("terms", probe(0).alias("first"), probe(1).alias("second")), "phrases")
    phrases = phrases.withColumnRenamed("_row", "phrase")
    return phrases, written(found.join(phrases.select("phrase", "terms"), "terms").select("phrase", "item_id"), "phrase-items")


def phrases(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(row, phrase, start, n): every occurrence in the index of the phrases of `windows`."""
    rarest = wanted.select("phrase", F.col("first.term").alias("term"), F.col("first.at").alias("at"), "second")
    lists = index.where(in_bitmap(bitmap(rarest, "term"), F.col("term"))).withColumn("salt", _salt(F.col("row")))
    begun = (lists.join(_on_every_salt(rarest), ["term", "salt"]).select("row", "phrase", (F.col("pos") - F.col("at")).alias("start"), "second").where("start >= 0"))
    begun = written(begun, "rarest-lists")
    seconds = wanted.where("second is not null").select(F.col("second.term").alias("term"))
    lists = index.where(in_bitmap(bitmap(seconds, "term"), F.col("term"))).select("row", "pos", "term")
    both = (begun.where("second is not null").select("row", "phrase", "start", (F.col("start") + F.col("second.at")).alias("pos"), F.col("second.term").alias("term"))
            .join(lists, ["row", "pos", "term"]).select("row", "phrase", "start"))
    left = written(both.unionByName(begun.where("second is null").select("row", "phrase", "start")), "second-lists")
    needed = (left.withColumn("salt", _salt(F.col("row"))).join(_on_every_salt(wanted.select("phrase", "terms")), ["phrase", "salt"])
              .select("row", "phrase", "start", F.size("terms").alias("n"), F.posexplode("terms").alias("i", "term")).withColumn("pos", F.col("start") + F.col("i")))
    near = index.where(in_bitmap(bitmap(left, "row"), F.col("row")) & (F.col("term") != "")).select("row", "pos", "term")
    return needed.join(near, ["row", "pos", "term"]).groupBy("row", "phrase", "start", "n").agg(F.count(F.lit(1)).alias("same")).where("same = n").drop("same")


def proximity(index: DataFrame, terms: DataFrame, near: int = NEAR, rarest: int = RAREST) -> DataFrame:
    """(row, item, item_id): the `rarest` rarest different words of the item (all, if it has fewer, and two at least) stand
    within `near` consecutive words of the document, in any order.  Words outside the index have no part."""
    each = terms.where("often > 0").select("item", "item_id", "term", "often").distinct()
    place = Window.partitionBy("item").orderBy("often", "term")
    each = each.withColumn("k", F.row_number().over(place)).where(F.col("k") <= rarest)
    each = written(each.withColumn("size", F.max("k").over(Window.partitionBy("item"))).where("size > 1"), "item-probes")
    lists = index.where(in_bitmap(bitmap(each, "term"), F.col("term"))).withColumn("salt", _salt(F.col("row")))
    met = lists.join(_on_every_salt(each), ["term", "salt"]).select("row", "item", "item_id", "size", "k", "pos")
    so_far = Window.partitionBy("row", "item").orderBy("pos", "k").rowsBetween(Window.unboundedPreceding, 0)
    last = F.array_compact(F.array(*[F.last(F.when(F.col("k") == k, F.col("pos")), ignorenulls=True).over(so_far) for k in range(1, rarest + 1)]))
    met = met.withColumn("last", last).where((F.size("last") == F.col("size")) & (F.col("pos") - F.array_min("last") < near))
    return met.select("row", "item", "item_id").distinct()


def decontaminate(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                  width: int = WINDOW, near: int = NEAR) -> DataFrame:
    """One row per document: key, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_hit counts the words inside any occurrence of a window of `width` consecutive item words (an item of fewer words is
    one window); n_items and items_sha256 tell the ids of items with such windows, n_near the items of which `proximity`
    finds the rarest words.  Null and empty texts have no words; an item without words has no window; an item without
    an id marks words but is not counted.  Repeated rows and null keys give a row each, items with the same id count once;
    an empty table of documents gives no rows, one of items marks nothing; other columns are not read."""
    terms = item_terms(items, item_key, item_text)
    index = postings(df, key, text, terms)
    terms = counted(index, terms)
    wanted, of_items = windows(terms, width)
    hits = written(phrases(index, wanted), "hits")
    before = Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    covered = hits.select("row", "start", (F.col("start") + F.col("n")).alias("end"), "n").distinct().withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = covered.groupBy("row").agg(F.sum(F.greatest(F.col("end") - F.greatest("start", "done"), F.lit(0))).alias("n_hit"))
    found = (hits.select("row", "phrase").distinct().withColumn("salt", _salt(F.col("row"))).join(_on_every_salt(of_items), ["phrase", "salt"])
             .where("item_id is not null").select("row", F.col("item_id").cast("string").alias("id")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    close = proximity(index, terms, near).where("item_id is not null").groupBy("row").agg(F.count_distinct("item_id").alias("n_near"))
    rows = index.where("term = ''").select("row", F.col("_key").alias(key), F.col("pos").cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (rows.join(covered, "row", "left").join(found, "row", "left").join(close, "row", "left")
            .select(key, "n_words", hit.alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")))
