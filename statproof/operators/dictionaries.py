"""Dictionaries as tables: aliases and detection rules of any number applied to text without pairing texts and entries.

A literal is found by equality.  A text is cut into windows of the lengths that the literals have; a bitmap of fixed size
lets through the windows that may be a literal, and a join on the literal decides.  So neither the texts nor the
dictionary are copied, and only texts with a likely hit leave their task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from statproof.functions import text as tx

WORDS = 1 << 14  # 64-bit words of the bitmap (128 KB); more literals only let more windows through to the join


def _slot(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(64 * WORDS))


def literal_hits(texts: DataFrame, text: str, literals: DataFrame, literal: str) -> DataFrame:
    """Distinct (text, literal) of the texts that hold a literal; null and empty texts and literals hold nothing."""
    known = literals.where(F.col(literal) != "").select(literal).distinct()
    slots = known.select(_slot(F.col(literal)).alias("s")).groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 AS int))")).alias("w"))
    every = texts.sparkSession.range(WORDS).select(F.col("id").alias("at")).join(slots, "at", "left")
    bitmap = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("w", F.lit(0).cast("long")).alias("w")))), lambda x: x["w"])).scalar()
    lengths = known.agg(F.coalesce(F.array_sort(F.collect_set(F.length(literal))), F.array().cast("array<int>"))).scalar()
    body = F.col(text)

    def windows(n: Column) -> Column:
        starts = F.when(F.length(body) >= n, F.sequence(F.lit(1), F.length(body) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(body, i, n))

    def likely(w: Column) -> Column:
        return tx.let(_slot(w), lambda s: F.getbit(F.element_at("_bits", (F.shiftright(s, 6) + 1).cast("int")), (s % 64).cast("int")) == 1)
    cut = texts.select(text).where(body != "").distinct().withColumn("_bits", bitmap).withColumn("_lengths", lengths)
    found = cut.select(text, F.explode(F.flatten(F.transform("_lengths", lambda n: F.array_distinct(F.filter(windows(n), likely))))).alias(literal))
    return found.join(known, literal).select(text, literal)


def apply_alias_table(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """aliases(ord, alias, canonical): `column` in the wording of the statistics, like `apply_aliases` with a list in
    `ord` order.  The aliases of the input text are replaced one after the other, longest first, equal lengths in `ord`
    order.  Null texts stay null; empty or null aliases do nothing; a null canonical counts as empty."""
    entry = F.struct((-F.length("alias")).alias("n"), "ord", "alias", F.coalesce("canonical", F.lit("")).alias("canonical"))
    hits = (literal_hits(df, column, aliases, "alias").join(aliases, "alias").groupBy(column)
            .agg(F.array_sort(F.collect_list(entry)).alias("_aliases")))
    done = F.aggregate("_aliases", F.col(column), lambda out, a: F.replace(out, a["alias"], a["canonical"]))
    changed = hits.select(F.col(column).alias("_before"), done.alias("_after"))
    joined = df.join(changed, F.col(column) == F.col("_before"), "left")
    return joined.withColumn(column, F.coalesce("_after", column)).drop("_before", "_after")


def make_queries_from(sent: DataFrame, aliases: DataFrame) -> DataFrame:
    """`make_queries` with aliases(ord, alias, canonical) as a table: adds query and variants."""
    said = apply_alias_table(sent.withColumn("_said", F.col("sentence")), "_said", aliases)
    with_query = said.withColumn("query", tx.query_of(F.col("_said"), F.col("sentence")))
    return with_query.withColumn("variants", tx.variants_of(F.col("query"), F.col("_said"))).drop("_said")


def apply_rule_table(sent: DataFrame, rules: DataFrame) -> DataFrame:
    """rules(ord, rule_id, pattern, literal): adds rule_id, the first rule in `ord` order whose pattern occurs in the stripped sentence.

    `literal` is a text that every match of the pattern holds (a promise of the table): only sentences with it meet the
    pattern.  Rules with an empty or null literal have none such and are tried on every sentence, so they should be few."""
    plain = sent.select("sentence").distinct().withColumn("_s", tx.strip(F.col("sentence")))
    near = literal_hits(plain, "_s", rules, "literal").join(rules, "literal").select("_s", "ord", "rule_id", "pattern")
    first = near.where(F.expr("_s rlike pattern")).groupBy("_s").agg(F.min(F.struct("ord", "rule_id")).alias("_near"))
    rule = F.struct("ord", "rule_id", "pattern")
    open_rules = rules.where(F.coalesce("literal", F.lit("")) == "").agg(F.array_sort(F.collect_list(rule)).alias("r")).scalar()
    tried = F.filter("_open", lambda r: F.regexp_like("_s", r["pattern"]))
    best = (plain.join(first, "_s", "left").withColumn("_open", open_rules)
            .withColumn("_other", F.transform(F.slice(tried, 1, 1), lambda r: F.struct(r["ord"].alias("ord"), r["rule_id"].alias("rule_id"))))
            .select(F.col("sentence").alias("_of"), F.array_min(F.array_compact(F.concat(F.array("_near"), "_other")))["rule_id"].alias("rule_id")))
    return sent.drop("rule_id").join(best, F.col("sentence").eqNullSafe(F.col("_of")), "left").drop("_of")
