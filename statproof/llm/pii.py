"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from one pass of regular expressions: the base kinds with their validity rules, and looser forms.
Four labelers vote on each candidate (rule, gazetteer, context, borders: for, against or no vote).  The driver sees only
the number of candidates per vote pattern (at most 5 * 3^4 rows): expectation-maximisation estimates how reliable each
labeler is and the chance that a pattern is personal data; a logistic span classifier is trained on these soft labels
and applied to every candidate.  Base spans stay whatever it says; other spans need a probability of one half.

Patterns begin where the run of their first characters begins (or where the last match ended) and take runs whole:
the same matches as the plain forms, in linear time on long texts.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

LOCAL = "A-Za-z0-9._%+-"
KINDS = ("email", "ip", "card", "phone", "ssn")
# Candidate forms: base ones first, each with its kind.
FORMS = (
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", True),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", True),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", True),
    ("phone", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", False),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False),
)
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
LABELERS = ("rule", "gazetteer", "context", "border")
CUES = {"email": r"mail|contact|write|@", "ip": r"\bip\b|address|host|server", "card": r"card|visa|credit|pay", "phone": r"phone|call|tel|fax|mobile", "ssn": r"ssn|social|security"}
AGAINST = r"(?:version|release|section|isbn|order|page|fig|no)\W{0,3}$"
# Endings of the most used mail domains; first digits of card issuers; codes of the largest numbering zones.
KNOWN = {"email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk)$", "ip": r"^(?!0|127\.|255\.)", "card": r"^(?:4|5[1-5]|3[47]|6011|2[2-7])", "phone": r"^\+(?:1|33|34|44|49)\D|^\(", "ssn": r"^(?!000|666|9)"}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _rule(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    size = F.length(digits)
    return (F.when(kind == "email", F.lit(True)).when(kind == "ip", match.rlike(OCTETS))
            .when(kind == "card", F.when(size.between(14, 19), F.expr("luhn_check(regexp_replace(match, '[^0-9]', ''))")).otherwise(False))
            .when(kind == "phone", match.startswith("+") & size.between(10, 15))
            .otherwise(~match.rlike(r"^(?:000|666|9)|-00-|-0000$")))


def _by_kind(kind: Column, patterns: dict[str, str], value: Column) -> Column:
    out = F.lit(False)
    for name, pattern in patterns.items():
        out = F.when(kind == name, value.rlike(pattern)).otherwise(out)
    return out


def _vote(for_: Column, against: Column | None = None) -> Column:
    return F.when(for_, 1).when(F.lit(True) if against is None else against, -1).otherwise(0)


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """A stored table of (_row, _key, _hash) and the matches of every form in each row's text; a row without matches
    has one line of nulls.  `_row` is unique and stored with the matches; texts are read once and not copied."""
    body = F.col(text).cast("string")
    found = df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.xxhash64(body).alias("_hash"), body.alias("body"))
    for n, (_, pattern, _) in enumerate(FORMS):
        found = found.withColumn(f"m{n}", F.regexp_extract_all("body", F.lit(pattern), F.lit(0)))

    def located(n: int, pattern: str) -> Column:
        """What stands before match i: its length, its last characters, and its first one (it follows match i - 1)."""
        gaps = F.transform(F.split("body", pattern, -1), lambda p: F.struct(F.length(p).alias("gap"), F.lower(F.substring(p, -24, 24)).alias("before"), F.substring(p, 1, 1).alias("first")))
        return F.transform(F.arrays_zip(F.col(f"m{n}").alias("m"), gaps.alias("p")), lambda z, i: F.struct(
            F.lit(n).alias("form"), i.alias("i"), z["m"].alias("match"), z["p"]["gap"].alias("gap"), z["p"]["before"].alias("before"), z["p"]["first"].alias("first")))
    parts = [F.when(F.size(f"m{n}") > 0, located(n, pattern)) for n, (_, pattern, _) in enumerate(FORMS)]
    empty = F.array().cast("array<struct<form:int,i:int,match:string,gap:int,before:string,first:string>>")
    every = F.explode_outer(F.concat(*[F.coalesce(p, empty) for p in parts])).alias("x")
    return written(found.select("_row", "_key", "_hash", every).select("_row", "_key", "_hash", "x.*"), "candidates")


def _voted(raw: DataFrame) -> DataFrame:
    """_row, kind, base, start, end (code points) and the votes of every candidate."""
    order = Window.partitionBy("_row", "form").orderBy("i")
    ended = F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = (raw.where("form is not null").withColumn("end", ended).withColumn("after", F.lead("first").over(order)).where("match is not null")
              .withColumn("start", F.col("end") - F.length("match")))
    kind = F.lit(None).cast("string")
    for n, (name, _, _) in enumerate(FORMS):
        kind = F.when(F.col("form") == n, F.lit(name)).otherwise(kind)
    strict = F.col("form").isin([n for n, f in enumerate(FORMS) if f[2]])
    placed = placed.withColumn("kind", kind)
    ok = _rule(F.col("kind"), F.col("match"))
    clear = ~F.coalesce(F.substring("before", -1, 1).rlike(r"[\p{L}\p{N}_]"), F.lit(False)) & ~F.coalesce(F.col("after").rlike(r"[\p{L}\p{N}_]"), F.lit(False))
    return placed.select("_row", "kind", "start", "end", (strict & ok).alias("base"), _vote(ok).alias("rule"),
                         _vote(_by_kind(F.col("kind"), KNOWN, F.col("match"))).alias("gazetteer"),
                         _vote(_by_kind(F.col("kind"), CUES, F.col("before")), F.col("before").rlike(AGAINST)).alias("context"), _vote(clear).alias("border"))


def estimate(patterns: list[tuple], rounds: int = 200) -> np.ndarray:
    """Expectation-maximisation over (kind, votes ..., n): the chance of each pattern to be personal data.

    Labelers are independent given the truth; each kind has its own share of true candidates, each labeler its own
    table of votes.  It starts from the share of votes for."""
    kinds = np.array([KINDS.index(p[0]) for p in patterns])
    votes = np.array([p[1:-1] for p in patterns]).reshape(len(patterns), -1) + 1
    n = np.array([p[-1] for p in patterns], float)
    chance = (votes - 1).clip(0).mean(1) * 0.8 + 0.1
    for _ in range(rounds):
        log = np.zeros((2, len(patterns)))
        for truth, weight in enumerate((n * (1 - chance), n * chance)):
            share = np.bincount(kinds, weight, len(KINDS)) + 1
            log[truth] += np.log(share / (np.bincount(kinds, n, len(KINDS)) + 2))[kinds]
            for labeler in votes.T:
                table = np.bincount(labeler, weight, 3) + 1
                log[truth] += np.log(table / table.sum())[labeler]
        chance, before = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50))), chance
        if np.abs(chance - before).max() < 1e-9:
            break
    return chance


def train(patterns: list[tuple], steps: int = 2000) -> dict[str, float]:
    """Weights of a logistic classifier over kinds and votes, fitted to the estimated chances."""
    names = [*(f"kind:{k}" for k in KINDS), *(f"{name}:{v}" for name in LABELERS for v in (-1, 1))]
    if not patterns:
        return dict.fromkeys(names, 0.0)
    features = np.array([[float(p[0] == k) for k in KINDS] + [float(p[1 + i] == v) for i in range(len(LABELERS)) for v in (-1, 1)] for p in patterns])
    target, n = estimate(patterns), np.array([p[-1] for p in patterns], float)
    n, weights = n / n.sum(), np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-features @ weights))
        weights += 4.0 * (features.T @ (n * (target - p)) - 1e-4 * weights)
    return dict(zip(names, map(float, weights)))


def spans(raw: DataFrame) -> DataFrame:
    """_row, kind, start, end, base of the spans that stay, from stored candidates."""
    voted = written(_voted(raw), "voted")
    patterns = [tuple(r) for r in voted.groupBy("kind", *LABELERS).agg(F.count(F.lit(1)).alias("n")).orderBy("kind", *LABELERS).collect()]  # at most 405 rows
    weights = train(patterns)
    logit = F.lit(0.0)
    for k in KINDS:
        logit = logit + F.when(F.col("kind") == k, weights[f"kind:{k}"]).otherwise(0.0)
    for name in LABELERS:
        logit = logit + F.when(F.col(name) == 1, weights[f"{name}:1"]).when(F.col(name) == -1, weights[f"{name}:-1"]).otherwise(0.0)
    order = Window.partitionBy("_row").orderBy("start", "end")
    base_end, base_start = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    kept = voted.withColumn("p", 1 / (1 + F.exp(-logit))).where("base or p >= 0.5")
    before = F.max(base_end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(base_start).over(order.rowsBetween(1, Window.unboundedFollowing))
    return (kept.withColumn("clash", (F.coalesce(before, F.col("start")) > F.col("start")) | (F.coalesce(after, F.col("end")) < F.col("end")))
            .where("base or not clash").select("_row", "kind", "start", "end", "base", "p"))


def _listed(condition: Column) -> Column:
    number = F.lit(0)
    for i, k in enumerate(KINDS):
        number = F.when(F.col("kind") == k, i).otherwise(number)
    item = F.struct(F.col("start"), number.alias("k"), F.col("end"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(condition, item))), lambda x: x["s"]), ",")


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts hold no span (empty lists).  Repeated rows and null keys give a row each; an empty table gives
    no rows; other columns are not read."""
    raw = candidates(df, key, text)
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in KINDS[:4]]
    found = spans(raw).groupBy("_row").agg(*counts, _listed(F.col("base")).alias("_base"), _listed(F.lit(True)).alias("spans"))
    return (raw.select("_row", F.col("_key").alias(key)).distinct().join(found, "_row", "left")
            .select(key, *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS[:4]],
                    F.sha2(F.coalesce("_base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")))


def redact(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with every span replaced by its kind in brackets; overlapping spans by one bracket each.

    Cuts find their rows by key and text hash: rows equal in both have the same text, and so the same cuts."""
    raw = candidates(df, key, text)
    order = Window.partitionBy("_row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans(raw).withColumn("done", F.coalesce(F.max("end").over(order), F.lit(0)))
    cut = cut.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "done"))).alias("_cut"), F.max("end").alias("_last"))
    cut = raw.select("_row", "_key", "_hash").distinct().join(cut, "_row").groupBy("_key", "_hash").agg(F.min(F.struct("_cut", "_last")).alias("_c"))
    body = F.col("_text")
    pieces = F.transform("_c._cut", lambda s: F.concat(F.substring(body, s["done"] + 1, F.greatest(s["start"] - s["done"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    shown = F.when(F.col("_c").isNull(), body).otherwise(F.concat(F.array_join(pieces, ""), F.substring(body, F.col("_c._last") + 1, F.length(body))))
    others = [F.col(f"`{c}`") for c in df.columns if c not in (key, text)] or [F.lit(0).alias("none")]
    rows = df.select(F.col(key).alias("_own"), F.col(text).cast("string").alias("_text"), F.struct(*others).alias("_rest"))
    met = rows.join(cut, F.col("_own").eqNullSafe(F.col("_key")) & (F.xxhash64("_text") == F.col("_hash")), "left")
    named = {key: F.col("_own").alias(key), text: shown.alias(text)}
    return met.select(*[named.get(c, F.col("_rest").getField(c).alias(c)) for c in df.columns])
