"""Dictionaries as tables against the list forms and against plain Python."""
import random

import pytest

from statproof.operators import dictionaries, extraction

ALIASES = [("취업자", "취업자 수"), ("취업", "고용"), ("물가", "소비자물가"), ("소비자물가", "물가지수"), ("a", "b"), ("b", "a"), ("취업", "노동"), ("", "x"), ("없다", ""), ("만 명", "명")]
TEXTS = ["취업자와 취업 물가", "소비자물가가 올랐다", "ab ba", "", None, "아무것도 없다", "취업자 3만 명", "취업자와 취업 물가", " 물가 ", "b"]
SCHEMA = "ord int, alias string, canonical string"


def plain(text, aliases):
    out = text
    for alias, canonical in sorted(aliases, key=lambda a: -len(a[0])):
        out = out.replace(alias, canonical) if alias and alias in text else out
    return out


@pytest.fixture(scope="module")
def sentences(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, sentence string").repartition(3)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *a) for i, a in enumerate(ALIASES)], SCHEMA).repartition(2)


def values(df, *cols):
    return {r["id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_alias_table_equals_alias_list(sentences, table):
    got = values(dictionaries.apply_alias_table(sentences, "sentence", table), "sentence")
    assert got == values(extraction.apply_aliases(sentences, "sentence", ALIASES), "sentence")
    assert got == {i: (None if t is None else plain(t, ALIASES),) for i, t in enumerate(TEXTS)}


def test_queries_equal_those_of_the_list(sentences, table):
    some = sentences.where("sentence IS NOT NULL")
    assert values(dictionaries.make_queries_from(some, table), "sentence", "query", "variants") == values(extraction.make_queries(some, ALIASES), "sentence", "query", "variants")


def test_fifty_thousand_aliases(spark):
    rng = random.Random(3)
    aliases = {"".join(rng.choices("가나다라마바사아자차카타파하", k=rng.choice((4, 5, 6, 9)))): f"<{i}>" for i in range(50_000)}
    names = list(aliases)
    texts = ["".join(rng.choice((rng.choice(names), "통계", " ", "가나다")) for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, sentence string")
    entries = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(aliases.items())], SCHEMA)
    got = values(dictionaries.apply_alias_table(df, "sentence", entries), "sentence")

    def inside(text):
        return [(text[i:i + n], aliases[text[i:i + n]]) for n in (4, 5, 6, 9) for i in range(len(text) - n + 1) if text[i:i + n] in aliases]
    order = {a: i for i, a in enumerate(aliases)}
    assert got == {i: (plain(t, sorted(set(inside(t)), key=lambda a: order[a[0]])),) for i, t in enumerate(texts)}


def test_rule_table_equals_rule_list(spark, sentences):
    rules = [("R1", r"취업자?\s*\d"), ("R2", r"물가가?"), ("R3", r"^b"), ("R4", r"취업"), ("R5", r"없다$")]
    literals = {"R1": "취업", "R2": "물가", "R4": "취업", "R5": "", "R3": None}
    entries = spark.createDataFrame([(i, r, p, literals[r]) for i, (r, p) in enumerate(rules)], "ord int, rule_id string, pattern string, literal string")
    assert values(dictionaries.apply_rule_table(sentences, entries), "rule_id") == values(extraction.apply_rules(sentences, rules), "rule_id")
    closed = entries.where("literal <> ''")
    assert values(dictionaries.apply_rule_table(sentences, closed), "rule_id") == values(extraction.apply_rules(sentences, [r for r in rules if literals[r[0]]]), "rule_id")


def test_empty_tables(spark, sentences, table):
    assert values(dictionaries.apply_alias_table(sentences, "sentence", table.limit(0)), "sentence") == {i: (t,) for i, t in enumerate(TEXTS)}
    assert dictionaries.apply_alias_table(sentences.limit(0), "sentence", table).isEmpty()
    none = spark.createDataFrame([], "ord int, rule_id string, pattern string, literal string")
    assert values(dictionaries.apply_rule_table(sentences, none), "rule_id") == {i: (None,) for i in range(len(TEXTS))}
