"""Training-data pipeline over `documents`: language, exact copies, near copies, personal data, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next one.  All but the last return the columns of `documents`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from statproof.llm import exact_dedup, language_id, near_dup, packing, pii
from statproof.llm.shared import documents, written

# Bits a byte of the best language model.  On 10,000 labelled documents, texts of 256 bytes or more of learned languages that were
# not learned from stay below 4.5, and the first percentile of such texts of a language that was left out lies at 5.68 or
# more; shorter texts tell less, so they are rejected only where the model does not beat the uniform byte code.
FOREIGN_BITS = 5.6
FOREIGN_BYTES = 256
UNIFORM_BITS = 8.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no learned language: null or letterless ones (`und`), texts of at least `FOREIGN_BYTES` that the best
    model codes at `FOREIGN_BITS` or more, shorter ones at `UNIFORM_BITS` or more.  The label of the others becomes the
    predicted language."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no column of the table clashes with the prediction's
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    found = language_id.identify(plain, plain.columns, names["doc_id"], names["text"], names["lang"])
    bound = F.when(F.octet_length(names["text"]) >= FOREIGN_BYTES, FOREIGN_BITS).otherwise(UNIFORM_BITS)
    kept = found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") < bound))
    return kept.select(*[F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in names.items()])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts."""
    return exact_dedup.distinct_texts(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies (5-word n-grams, Jaccard 0.8)."""
    return near_dup.without_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by its kind; n_chars follows the text."""
    redacted = pii.redact(docs)
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document that is left into sequences of at most 4,096 tokens."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("personal_data", personal_data), ("sequences", sequences)]
# Tokenizers and trained models have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
