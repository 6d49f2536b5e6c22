"""Deterministic comparison of a claimed and an official number, as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from statproof.functions import lexicon as lx, text as tx


def compare(claimed: Column, claimed_unit: Column, decimals: Column, official: Column, official_unit: Column, op: Column,
            rel_tol: float = lx.REL_TOL) -> Column:
    """struct(label, mismatch_type, path, confidence): unit family, threshold wording, rounding, relative error."""
    def trimmed(u):
        return F.trim(F.coalesce(u, F.lit("")))
    bound = F.struct(claimed.cast("double").alias("c"), official.cast("double").alias("o"), tx.unit_family(claimed_unit).alias("cu"),
                     tx.unit_family(official_unit).alias("ou"), (trimmed(claimed_unit) == trimmed(official_unit)).alias("same"))
    return tx.let(bound, lambda v: _decide(v, decimals, op, rel_tol))


def _decide(v: Column, decimals: Column, op: Column, tol: float) -> Column:
    cf, of = v["cu"]["factor"], v["ou"]["factor"]
    cv, ov = v["c"] * cf, v["o"] * of
    converted = (cf != 1.0) | (of != 1.0) | (op != "eq") | ~v["same"]
    families = F.array_sort(F.array(v["cu"]["family"], v["ou"]["family"]))
    other_family = v["cu"]["family"] != v["ou"]["family"]
    tiny = F.lit(1e-12)
    margin = F.abs(ov - cv) / F.greatest(F.abs(cv), tiny)
    rel = F.abs(cv - ov) / F.greatest(F.abs(ov), tiny)
    reached = F.when(op == "gte", ov >= cv).otherwise(ov <= cv)
    rounded = tx.round_half_even(ov / cf, decimals) == tx.round_half_even(v["c"], decimals)
    plain = F.when(converted, "medium").otherwise("high")

    def out(label, path, confidence):
        label = F.lit(label) if isinstance(label, str) else label
        return F.struct(label.alias("label"), F.when(label == "mismatch", "value").alias("mismatch_type"), F.lit(path).alias("path"),
                        (confidence if isinstance(confidence, Column) else F.lit(confidence).cast("string")).alias("confidence"))
    return (F.when(v["o"].isNull() | v["c"].isNull(), out("unverifiable", "no_value", None))
             .when(other_family & (families == F.array(F.lit("percent"), F.lit("percent_point"))), out("mismatch", "percent_point_confusion", "medium"))
             .when(other_family, out("unverifiable", "unit_family", None))
             .when(op.isin("gte", "lte"), out(F.when(reached, "match").otherwise("mismatch"), "threshold",
                                              F.when(margin <= tol * 2, "low").otherwise("medium")))
             .when(rounded, out("match", "rounded", plain))
             .when(rel <= tol, out("match", "relative", F.when(rel > tol * 0.5, "low").otherwise(plain)))
             .otherwise(out("mismatch", "relative", F.when(rel <= tol * 3, "low").otherwise(plain))))


def infer_unit(unit: Column, item: Column, table: Column) -> Column:
    named = F.concat_ws(" ", item, table).rlike(lx.PERCENT_NAME) | item.rlike("[비률율]$")
    return F.when(F.coalesce(unit, F.lit("")) != "", unit).when(named, "%").otherwise("")


def claim_basis(sentence: Column, period: Column) -> Column:
    explicit = F.coalesce(*[F.when(sentence.rlike(p), F.lit(b)) for p, b in lx.BASIS_PATTERNS])
    usual = F.when(sentence.rlike(lx.RATE_CLAIM), F.when(F.length(F.replace(period, F.lit("-"), F.lit(""))) >= 6, "전년동월").otherwise("전년"))
    return F.coalesce(explicit, usual, F.lit(""))


def index_base_year(table: Column) -> Column:
    return F.when(table.contains("지수"), F.nullif(F.regexp_extract(table, lx.INDEX_BASE, 1), F.lit("")))


def is_index_level(sentence: Column, unit: Column) -> Column:
    return ~(unit.isin("%", "%p", "퍼센트") & sentence.rlike(lx.RATE_WORD)) & sentence.contains("지수")


def metric_guard(sentence: Column, unit: Column) -> Column:
    out = (unit != "") & sentence.contains(unit)
    for name, words in lx.METRIC_TOKENS.items():
        out = F.when(unit == name, tx.contains_any(sentence, words)).otherwise(out)
    return out


def triage(label: Column, confidence: Column, calculation: Column, source_type: Column) -> Column:
    """Publish tier; only a high-confidence direct match of a simple source is confirmed automatically."""
    direct = (confidence == "high") & (F.coalesce(calculation, F.lit("")) == "") & (F.coalesce(source_type, F.lit("")) != "KOSIS_BUT_COMPLEX")
    return (F.when(label == "not_claim", "SKIPPED").when(label == "unverifiable", "UNVERIFIABLE").when(label == "mismatch", "NEEDS_REVIEW")
             .when(direct, "AUTO_CONFIRMED").otherwise("NEEDS_REVIEW"))
