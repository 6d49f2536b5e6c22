"""Stages of the pipeline against plain versions."""
from __future__ import annotations

import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, awkward_texts


def test_stages(spark, tmp_path):
    data = [(i, t, "en" if i % 2 else None, "src", len(t or ""), "r", "k", 1) for i, t in enumerate(awkward_texts())]
    # The unlabelled half of the letters is enough to learn from.
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sequences":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before.collect(), docs.collect())
    before, after = seen["language"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} >= {0, 1, 2, 3, 5} and {7, 10, 16} <= {r.doc_id for r in after}
    before, after = seen["exact_copies"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {8, 9}
    before, after = seen["near_copies"]
    groups = brute.near([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after} == {d for d, g in groups.items() if g[3] == d} and 10 not in {r.doc_id for r in after}
    before, after = seen["personal_data"]
    assert {r.doc_id: len(r.text) for r in after} == {r.doc_id: r.n_chars for r in after} and len(before) == len(after)
    assert {r.doc_id for r in seen["sequences"][0]} == {r.doc_id for r in seen["sequences"][1]}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_language_that_was_not_learned_is_rejected(spark):
    rng = random.Random(5)

    def texts(letters):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60)]
        return [" ".join(rng.choice(words) for _ in range(80)) for _ in range(40)]
    learned, other = {"aa": "abcdefgh", "bb": "ghijklmno"}, texts("pqrstuvw")
    data = [(i, t, lang, 1.0) for i, (lang, t) in enumerate((lang, t) for lang, letters in learned.items() for t in texts(letters))]
    data += [(1000 + i, t, None, 1.0) for i, t in enumerate(other)] + [(2000, "dach", None, 1.0), (2001, None, "aa", 1.0), (2002, "...", "aa", 1.0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, score double")
    kept = corpus_pipeline.language(spark, docs, "").collect()
    assert kept[0].asDict().keys() == set(docs.columns)
    assert {r.doc_id: r.lang for r in kept if r.doc_id < 1000} == {i: lang for i, _, lang, _ in data if i < 1000}
    assert {r.doc_id for r in kept if r.doc_id >= 1000} == {2000}
