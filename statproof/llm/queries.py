"""Registered queries of the subpackage; each applies an operator to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, exact_dedup, language_id, licenses, metric_tree, near_dup, packing, piece_codec, pii, rtree, sharding, spelling, suffix_dedup
from .shared import documents


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.encode_table(documents(spark, folder), _tokenizer("piece_bpe_32k.model"))


def op2_topk_mtree(spark: SparkSession, folder: str) -> DataFrame:
    return metric_tree.top_k(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return (language_id.identify(documents(spark, folder), ["doc_id"])
            .select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, folder))


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(documents(spark, folder), _tokenizer("word_bpe_49k.json"))


def op6_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, folder))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, folder)).drop("kept")


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(documents(spark, folder))


def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(documents(spark, folder), sharding.levelled_tree(8))


def op10_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(documents(spark, folder))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(documents(spark, folder), every=97)


def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree.mine(spark.read.parquet(f"{folder}/embeddings.parquet").withColumn("label", label))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_topk_mtree, op3_language_id, op4_exact_dedup, op5_packing, op6_ngram_jaccard, op7_suffix_dedup,
                                   op8_license_scan, op9_sharding, op10_personal_data, op11_spelling_variants, op12_decontamination, op13_hard_negatives)}

ORACLE = {
    "op2_topk_mtree": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op12_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                   FROM documents),
        b AS (SELECT row_number() OVER () AS item, item_id,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
              FROM benchmark),
        bw AS (SELECT item, item_id, w, least(10, len(w)) AS l, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS t FROM bw),
        dw AS (SELECT r, l, s, array_to_string(w[s:s + l - 1], ' ') AS t
               FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l)),
        h AS (SELECT r, s, dw.l, item_id FROM dw JOIN win ON dw.t = win.t AND dw.l = win.l),
        n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM h) GROUP BY r),
        i AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r),
        -- near: the three rarest words of an item (those that documents hold) within 20 words, in any order
        t AS (SELECT r, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
        f AS (SELECT term, count(*) AS often FROM t GROUP BY term),
        e AS (SELECT *, max(k) OVER (PARTITION BY item) AS size
              FROM (SELECT item, item_id, term, row_number() OVER (PARTITION BY item ORDER BY often, term) AS k
                    FROM (SELECT DISTINCT item, item_id, unnest(w) AS term FROM b) JOIN f USING (term)) WHERE k <= 3),
        m AS (SELECT r, item, item_id, size, pos, max(CASE WHEN k = 1 THEN pos END) OVER o AS a, max(CASE WHEN k = 2 THEN pos END) OVER o AS b, max(CASE WHEN k = 3 THEN pos END) OVER o AS c
              FROM t JOIN e USING (term) WHERE size > 1 WINDOW o AS (PARTITION BY r, item ORDER BY pos ROWS UNBOUNDED PRECEDING)),
        c AS (SELECT r, count(DISTINCT item_id) AS n_near FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND (c IS NOT NULL OR size = 2) AND pos - least(a, b, coalesce(c, a)) < 20 GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
        FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r) LEFT JOIN c USING (r)""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
              FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
        p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
        n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
                     row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
              FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
