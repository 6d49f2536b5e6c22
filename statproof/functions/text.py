"""Column expressions for claim text: Column in, Column out, evaluated inside the JVM."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from statproof.functions import lexicon as lx

_MARK, _SEP = "\x01", "\x02"


# --- small helpers ------------------------------------------------------------------------------------------
def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def compact(c: Column) -> Column:
    """Drop all whitespace: keyword matching ignores spacing."""
    return F.regexp_replace(c, r"\s+", "")


def has(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def contains_any(c: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


def first_alias(c: Column, table) -> Column:
    """Canonical name of the first table row with an alias inside the (compacted) text, else ''."""
    return let(compact(c), lambda z: first_alias_in(z, table))


def first_alias_in(squeezed: Column, table) -> Column:
    cases = [F.when(contains_any(squeezed, ["".join(a.split()) for a in aliases]), F.lit(name))
             for name, aliases in table]
    return F.coalesce(*cases, F.lit(""))


def _replaced(c: Column, pattern: str, needed) -> Column:
    """`pattern` removed; a text without any of the `needed` words, one of which every match holds, is not scanned for it."""
    return F.when(contains_any(c, needed), F.regexp_replace(c, pattern, "")).otherwise(c)


def present(*flagged) -> Column:
    """array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, label if isinstance(label, Column) else F.lit(label))
                                     for cond, label in flagged]))


# --- article body -------------------------------------------------------------------------------------------
_HEAD = rf"(?s)^.*?{lx.BYLINE_ANCHOR}(?:{lx.UPDATE_STAMP[1:]})?"
_FOOT = r"(?s)(?:" + "|".join(r"\Q" + m + r"\E" for m in lx.FOOTER_MARKERS) + r").*$"


def strip_chrome(body: Column) -> Column:
    """Body after the first byline stamp and before the earliest footer marker: two linear passes."""
    headless = let(F.coalesce(body, F.lit("")), lambda b: _replaced(b, _HEAD, ["입력"]))
    return strip(let(headless, lambda b: _replaced(b, _FOOT, lx.FOOTER_MARKERS)))


def anchored(body: Column) -> Column:
    return F.coalesce(body, F.lit("")).rlike(lx.BYLINE_ANCHOR)


def clean_body(body: Column) -> Column:
    lines = F.split(body, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]")
    bare = F.transform(lines, lambda l: strip(_replaced(l, lx.EMAIL, ["@"])))
    tidy = F.transform(bare, lambda l: F.when(l.contains("기자"), strip(F.regexp_replace(l, lx.REPORTER_TAIL, ""))).otherwise(l))
    notice = ["무단", "재배포", "저작권자", "ⓒ", "©"]
    kept = F.filter(tidy, lambda s: (s != "") & ~((contains_any(s, notice) | F.lower(s).contains("copyright")) & s.rlike(lx.COPYRIGHT))
                    & ~(s.contains("기자") & s.rlike(lx.REPORTER_LINE)))
    return strip(F.regexp_replace(F.array_join(kept, " "), "[ \t ]+", " "))


def sentence_array(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, lx.SENTENCE_BREAK), strip), lambda s: s != "")


def section_from_url(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), lx.SECTION_URL, 1)


# --- quantities ---------------------------------------------------------------------------------------------
# One regex pass marks every number with its parts; look-ahead groups record whether a date part or a household
# noun follows, so no second scan over the text is needed.
_QTY = (rf"([+\-−])?\s*({lx.NUMBER})\s*([천만억조])?\s*({lx.UNIT_WORDS})?"
        rf"(?=({lx.DATE_TAIL})?)(?=({lx.HOUSEHOLD_TAIL})?)")


def marked_pieces(text: Column, pattern: str, groups: int) -> Column:
    """Alternating plain / match pieces of a text; odd positions hold \\x02-separated groups 0..n of one match."""
    safe = F.translate(text, _MARK + _SEP, "  ")
    shape = _MARK + _SEP.join(f"${g}" for g in range(groups + 1)) + _MARK
    return F.split(F.regexp_replace(safe, pattern, shape), _MARK)


def located_matches(pieces: Column) -> Column:
    """array<struct(f: groups, start: 0-based position)> of the matches in `marked_pieces`."""
    indexed = F.transform(pieces, lambda p, i: F.struct(F.split(p, _SEP).alias("f"), i.alias("i")))
    empty = F.array().cast("array<struct<f:array<string>,start:int>>")
    walked = F.aggregate(
        indexed, F.struct(F.lit(0).alias("pos"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["pos"] + F.length(F.element_at(x["f"], 1))).cast("int").alias("pos"),
            F.when(x["i"] % 2 == 1,
                   F.concat(acc["out"], F.array(F.struct(x["f"].alias("f"), acc["pos"].cast("int").alias("start")))))
             .otherwise(acc["out"]).alias("out")))
    return walked["out"]


def _number_pieces(sentence: Column) -> Column:
    return marked_pieces(sentence, _QTY, 6)


def _identifier(p: Column) -> Column:
    """True for date parts and household nouns: the number is not a quantity."""
    unit = p[4]
    return ((unit == "") & (p[5] != "")) | (unit.isin("인", "명") & (p[6] != ""))


def number_parts(sentence: Column) -> Column:
    """array<struct(parts, start)> of real numeric expressions (identifiers removed)."""
    return F.filter(located_matches(_number_pieces(sentence)), lambda q: ~_identifier(q["f"]))


def _scale_factor(scale: Column) -> Column:
    factor = F.lit(1.0)
    for name, value in lx.SCALES.items():
        factor = F.when(scale == name, F.lit(value)).otherwise(factor)
    return factor


def quantities(sentence: Column) -> Column:
    """array<struct> of quantities: a unit, a scale word or a decimal point is required."""
    empty = F.array().cast("array<struct<value:double,scale:string,unit:string,composed_unit:string,normalized_value:double,"
                           "span_start:int,span_end:int,raw:string,decimals:int>>")
    useful = F.filter(number_parts(sentence), lambda q: (q["f"][4] != "") | (q["f"][3] != "")
                      | q["f"][2].contains("."))

    def shape(q: Column) -> Column:
        f = q["f"]
        magnitude = F.replace(f[2], F.lit(","), F.lit("")).cast("double")
        value = F.when(f[1].isin("-", "−"), -magnitude).otherwise(magnitude)
        digits = F.length(F.regexp_extract(f[2], r"\.(\d+)$", 1))
        return F.struct(
            value.alias("value"), f[3].alias("scale"), f[4].alias("unit"), F.concat(f[3], f[4]).alias("composed_unit"),
            (value * _scale_factor(f[3])).alias("normalized_value"), q["start"].alias("span_start"),
            (q["start"] + F.length(f[0])).cast("int").alias("span_end"), strip(f[0]).alias("raw"),
            # a whole number prints as "23.0" in the original value type, so it still counts one decimal
            F.greatest(digits, F.lit(1)).cast("int").alias("decimals"))
    return F.when(~sentence.rlike(r"\d"), empty).otherwise(F.transform(useful, shape))



def _parts_only(sentence: Column) -> Column:
    """Parts of real numeric expressions without positions (cheaper: no running length)."""
    odd = F.filter(_number_pieces(sentence), lambda p, i: i % 2 == 1)
    return F.filter(F.transform(odd, lambda p: F.split(p, _SEP)), lambda f: ~_identifier(f))


def has_number(sentence: Column) -> Column:
    return sentence.rlike(r"\d") & (F.size(_parts_only(sentence)) > 0)


def has_unit_quantity(sentence: Column) -> Column:
    return sentence.rlike(r"\d") & F.exists(_parts_only(sentence), lambda f: (f[4] != "") | (f[3] != ""))


def primary_quantity(qs: Column) -> Column:
    """First level percentage, else the first quantity."""
    level = F.filter(qs, lambda q: q["unit"].isin("%", "퍼센트"))
    return F.coalesce(F.try_element_at(level, F.lit(1)), F.try_element_at(qs, F.lit(1)))


# --- periods ------------------------------------------------------------------------------------------------
def article_day(date_text: Column) -> Column:
    """First ten characters as a date; '.' and '/' count as '-'; null when unreadable."""
    head = F.substring(strip(date_text.cast("string")), 1, 10)
    iso = F.translate(head, "./", "--")
    return F.when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(iso, "yyyy-M-d"))


def _month(year: Column, month_text: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month_text.cast("int").cast("string"), 2, "0"))


def _relative_year(base: Column, word: Column) -> Column:
    shift = F.lit(None).cast("int")
    for name, delta in lx.RELATIVE_YEAR.items():
        shift = F.when(word == name, F.lit(delta)).otherwise(shift)
    return base + shift


def period(sentence: Column, date_text: Column) -> Column:
    """'YYYY' | 'YYYY-MM' | 'YYYY-Qn' | ''.  Comparison bases are removed before anything is read.  Every pattern and every
    base holds one of `PERIOD_WORDS`; sentences without any are not read further."""
    s = sentence
    for noise in lx.PERIOD_NOISE:
        s = F.regexp_replace(s, noise, " ")
    return F.when(contains_any(sentence, lx.PERIOD_WORDS), let(s, lambda clean: _period_of(clean, article_day(date_text)))).otherwise("")


def _period_of(s: Column, day: Column) -> Column:
    year, prev = F.year(day), F.add_months(day, -1)

    def g(pattern, i):
        return F.regexp_extract(s, pattern, i)

    def found(pattern, value):
        return F.when(s.rlike(pattern), value)
    return F.coalesce(
        found(lx.ABS_MONTH, _month(g(lx.ABS_MONTH, 1), g(lx.ABS_MONTH, 2))),
        found(lx.MONTH_RANGE, _month(year, g(lx.MONTH_RANGE, 1))),
        found(lx.ABS_QUARTER, F.concat(g(lx.ABS_QUARTER, 1), F.lit("-Q"), g(lx.ABS_QUARTER, 2))),
        found(lx.REL_QUARTER, F.concat(_relative_year(year, g(lx.REL_QUARTER, 1)).cast("string"), F.lit("-Q"),
                                       g(lx.REL_QUARTER, 2))),
        found(lx.REL_MONTH, _month(_relative_year(year, g(lx.REL_MONTH, 1)), g(lx.REL_MONTH, 2))),
        found(lx.ABS_YEAR, g(lx.ABS_YEAR, 1)),
        found(lx.REL_YEAR, _relative_year(year, g(lx.REL_YEAR, 1)).cast("string")),
        found(lx.LAST_MONTH, _month(F.year(prev), F.month(prev))),
        found(lx.QUARTER_ONLY, F.concat(year.cast("string"), F.lit("-Q"), g(lx.QUARTER_ONLY, 1))),
        found(lx.MONTH_ONLY, _month(year, g(lx.MONTH_ONLY, 1))),
        F.lit(""))


# --- wording ------------------------------------------------------------------------------------------------
def comparison_op(s: Column) -> Column:
    return F.when(has(s, lx.OP_GTE), "gte").when(has(s, lx.OP_LTE), "lte").otherwise("eq")


def trend(s: Column) -> Column:
    return F.when(has(s, lx.TREND_UP), "up").when(has(s, lx.TREND_DOWN), "down").otherwise("")


def rule_hit(sentence: Column, rules) -> Column:
    """First rule id whose pattern occurs; rules = ordered [(rule_id, pattern)], compiled once each."""
    s = strip(sentence)
    return F.coalesce(*[F.when(s.rlike(p), F.lit(rid)) for rid, p in rules], F.lit(None).cast("string"))


def detection_path(sentence: Column, rules=()) -> Column:
    """Why a sentence is (not) a candidate: empty, noise, site_chrome, number_unit, number_trend, superlative,
    rule:<id> or none.  Cheap tests come first; the number scan runs only on lines with a digit."""
    s = strip(sentence)
    digit = s.rlike(r"\d")
    rule = rule_hit(s, rules) if rules else F.lit(None).cast("string")
    return (F.when(s == "", "empty").when(has(s, lx.NOISE_ONLY), "noise").when(has(s, lx.SITE_CHROME), "site_chrome")
             .when(digit & has_unit_quantity(s), "number_unit")
             .when(digit & has(s, lx.TREND_HINT) & has_number(s), "number_trend")
             .when(has(s, lx.SUPERLATIVE), "superlative")
             .when(rule.isNotNull(), F.concat(F.lit("rule:"), rule)).otherwise("none"))


def is_candidate(sentence: Column, rules=()) -> Column:
    return ~detection_path(sentence, rules).isin("empty", "noise", "site_chrome", "none")


def mixed_fragments(s: Column) -> Column:
    return (F.regexp_count(s, F.lit(lx.ELLIPSIS)) >= 2) & (F.regexp_count(s, F.lit(lx.NUMBER_WITH_UNIT)) >= 2)


# --- source routing -----------------------------------------------------------------------------------------
def claim_type(s: Column) -> Column:
    return F.coalesce(*[F.when(s.rlike(p), F.lit(n)) for n, p in lx.CLAIM_TYPE_PATTERNS], F.lit(lx.DEFAULT_CLAIM_TYPE))


def _longest_keyword(squeezed: Column, group: dict) -> Column:
    """struct(domain, keyword, len) of the longest keyword present (dictionary order breaks ties)."""
    words = [(d, k) for d, ks in group.items() for k in ks]
    words.sort(key=lambda dk: -len(dk[1]))
    return F.coalesce(*[F.when(squeezed.contains("".join(k.split())), F.struct(
        F.lit(d).alias("domain"), F.lit(k).alias("keyword"), F.lit(len(k)).alias("len"))) for d, k in words])


def source_label(s: Column, routing: dict = lx.DEFAULT_ROUTING) -> Column:
    """struct(source_type, domain, claim_type, route, confidence, reason, matched_keyword)."""
    groups = ["kosis_domestic", "platform_source", "private_source", "other_official"]
    label = let(compact(s), lambda z: let(
        F.struct(claim_type(s).alias("kind"), *[_longest_keyword(z, routing[g]).alias(g) for g in groups]),
        lambda found: _label_of(s, z, found, routing)))
    plain = _source_struct("UNKNOWN", F.lit(lx.DEFAULT_CLAIM_TYPE), F.lit("-"), F.lit(""))
    return F.when(~s.rlike(_source_hint(routing, groups)), plain).otherwise(label)


def _source_hint(routing: dict, groups: list) -> str:
    """A pattern that every text with a routing word, marker or claim wording matches: a Hangul syllable, `%p`, or one of
    the words that hold no syllable (keywords ignore white space)."""
    words = [k for g in groups for ks in routing[g].values() for k in ks] + list(routing["overseas_markers"])
    foreign = sorted({w for w in words if not re.search("[가-힣]", w)})
    return "|".join(["[가-힣]", "%p", *[r"\s*".join(re.escape(ch) for ch in "".join(w.split())) for w in foreign]])


def _source_struct(name: str, kind: Column, domain: Column, keyword: Column) -> Column:
    return F.struct(
        F.lit(name).alias("source_type"), domain.alias("domain"), kind.alias("claim_type"),
        F.lit(lx.ROUTE_OF[name]).alias("route"), F.lit(lx.CONFIDENCE_OF[name]).alias("confidence"),
        F.lit(lx.REASON_OF[name]).alias("reason"), keyword.alias("matched_keyword"))


def _label_of(s: Column, squeezed: Column, found: Column, routing: dict) -> Column:
    kind, official = found["kind"], found["kosis_domestic"]
    official_len = F.coalesce(official["len"], F.lit(0))
    home_activity = contains_any(squeezed, ["".join(k.split()) for k in routing["domestic_overseas_activity"]])
    none = F.struct(F.lit("-").alias("domain"), F.lit("").alias("keyword"), F.lit(0).alias("len"))

    def label(name, match=none):
        return _source_struct(name, kind, match["domain"], match["keyword"])
    out = (F.when(kind == "전망형", label("FORECAST_OR_OPINION"))
            .when(contains_any(s, routing["overseas_markers"]), label("OVERSEAS_SOURCE"))
            .when(s.contains("해외") & ~home_activity, label("OVERSEAS_SOURCE"))
            .when(has(s, lx.SURVEY_NAME) & has(s, lx.SURVEY_SCHEDULE), label("OFFICIAL_ANNOUNCEMENT")))
    for name, group in (("PLATFORM_SOURCE", "platform_source"), ("PRIVATE_SOURCE", "private_source"),
                        ("OTHER_OFFICIAL", "other_official")):
        m = found[group]
        out = out.when(m.isNotNull() & (official_len <= m["len"]), label(name, m))
    derived = official["domain"].isin(routing["complex_domains"]) | kind.isin(routing["complex_claim_types"])
    return (out.when(official.isNotNull() & derived, label("KOSIS_BUT_COMPLEX", official))
               .when(official.isNotNull(), label("KOSIS_DOMESTIC", official)).otherwise(label("UNKNOWN")))


def search_terms(label: Column) -> Column:
    hint = F.lit("")
    for domain, term in lx.QUERY_HINTS.items():
        hint = F.when(label["domain"] == domain, F.lit(term)).otherwise(hint)
    keyword = label["matched_keyword"]
    return F.when(keyword == "", F.array().cast("array<string>")).otherwise(
        F.filter(F.array_distinct(F.array(keyword, hint)), lambda t: t != ""))


# --- search query -------------------------------------------------------------------------------------------
def substitute_aliases(text: Column, aliases) -> Column:
    """Replace article wording by statistics wording, longest alias first; only aliases present in the input
    text count.  aliases = [(alias, canonical)] (a reviewed dictionary, applied as literals)."""
    out = text
    for alias, canonical in sorted(aliases, key=lambda a: -len(a[0])):
        out = F.when(text.contains(alias), F.replace(out, F.lit(alias), F.lit(canonical))).otherwise(out)
    return out


def _strip_particle(tok: Column) -> Column:
    out = F.lit(None).cast("string")
    for p in sorted(lx.PARTICLES, key=len, reverse=True):
        hit = tok.endswith(p) & (F.length(tok) - len(p) >= 2)
        out = F.coalesce(out, F.when(hit, F.substring(tok, F.lit(1), F.length(tok) - len(p))))
    return F.coalesce(out, tok)


def _useful_tokens(text: Column) -> Column:
    """Tokens without particles and noise words.  Both are Hangul, so a token that does not end or begin with a syllable is
    not searched for them."""
    tokens = F.transform(F.regexp_extract_all(text, F.lit(f"({lx.QUERY_TOKEN})"), F.lit(1)),
                         lambda t: F.when(F.substring(t, -1, 1) >= "가", _strip_particle(t)).otherwise(t))
    noise = "^(?:" + "|".join(lx.STOP_PREFIX) + ")"
    return F.filter(tokens, lambda t: (F.length(t) >= 2) & ((F.substring(t, 1, 1) < "가") | (~t.isin(lx.STOP_TIME) & ~t.rlike(noise))))


def make_query(sentence: Column, aliases=()) -> Column:
    return let(substitute_aliases(sentence, aliases), lambda text: query_of(text, sentence))


def query_of(text: Column, sentence: Column) -> Column:
    """Search words of a sentence whose aliases were replaced in `text`."""
    lead = F.substring(text, F.lit(1), F.regexp_instr(text, F.lit(lx.QUERY_HOUSEHOLD)) - 1)
    households = F.transform(F.regexp_extract_all(text, F.lit(lx.QUERY_HOUSEHOLD), F.lit(1)),
                             lambda n: F.concat(n, F.lit("인가구")))
    dateless = F.when(contains_any(text, ["년", "월", "일", "분기"]), F.regexp_replace(text, lx.QUERY_DATE, " ")).otherwise(text)
    bare = F.regexp_replace(dateless, lx.QUERY_QUANTITY, " ")
    plain = let(F.array_join(F.array_distinct(_useful_tokens(bare)), " "),
                lambda p: F.when(p == "", strip(sentence)).otherwise(p))
    return F.when(text.contains("가구") & text.rlike(lx.QUERY_HOUSEHOLD), F.array_join(F.concat(_useful_tokens(lead), households), " ")).otherwise(plain)


def query_variants(sentence: Column, aliases=()) -> Column:
    return variants_of(make_query(sentence, aliases), substitute_aliases(sentence, aliases))


def variants_of(query: Column, text: Column) -> Column:
    both = F.array(strip(query), strip(text))
    return F.filter(F.array_distinct(both), lambda q: q != "")


# --- claim profile ------------------------------------------------------------------------------------------
def claim_profile(s: Column) -> Column:
    """struct(topic, indicator, period, comparison, unit, region, population, qualifiers) without inheritance."""
    return let(compact(s), lambda z: _profile_of(s, z))


def _profile_of(s: Column, squeezed: Column) -> Column:
    hit = F.coalesce(*[F.when(contains_any(squeezed, ["".join(a.split()) for a in aliases]),
                              F.struct(F.lit(t).alias("topic"), F.lit(i).alias("indicator")))
                       for t, i, aliases in lx.INDICATORS],
                     F.struct(F.lit("").alias("topic"), F.lit("").alias("indicator")))
    product, work = first_alias_in(squeezed, lx.PRICE_PRODUCTS), first_alias_in(squeezed, lx.WORK_QUALIFIERS)
    priced = (product != "") & hit["indicator"].isin("", "물가") & contains_any(s, ["가격", "물가"])
    period_kind = (F.when(has(s, r"\d{1,2}월|지난달|이번달|전년동월"), "월").when(s.contains("분기"), "분기")
                    .when(contains_any(s, ["지난해", "올해", "전년", "연간"]), "연").otherwise(""))
    basis = (F.when(contains_any(s, ["전년동월", "지난해 같은 달", "지난해같은달"]), "전년동월비")
              .when(s.contains("전월"), "전월비")
              .when(contains_any(s, ["전년보다", "전년 대비", "지난해보다"]), "전년 대비").otherwise(""))
    unit = (F.when(contains_any(s, ["%p", "퍼센트포인트"]), "%p").when(contains_any(s, ["%", "퍼센트"]), "%")
             .when(s.contains("명"), "명").when(s.contains("건"), "건").otherwise(""))
    return F.struct(
        F.when(priced, "물가").otherwise(hit["topic"]).alias("topic"),
        F.when(priced, "소비자물가").otherwise(hit["indicator"]).alias("indicator"),
        period_kind.alias("period"), basis.alias("comparison"), unit.alias("unit"),
        first_alias_in(squeezed, lx.REGIONS).alias("region"), first_alias_in(squeezed, lx.POPULATIONS).alias("population"),
        F.filter(F.array_distinct(F.array(product, work)), lambda q: q != "").alias("qualifiers"))


# --- numbers and units --------------------------------------------------------------------------------------

def official_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def unit_family(unit: Column) -> Column:
    """struct(factor, family); unknown units keep factor 1."""
    u = F.trim(F.coalesce(unit, F.lit("")))
    out = F.struct(F.lit(1.0).alias("factor"), F.when(u == "", "unitless").otherwise("unknown").alias("family"))
    for name, (factor, family) in lx.UNIT_TABLE.items():
        out = F.when(u == name, F.struct(F.lit(factor).alias("factor"), F.lit(family).alias("family"))).otherwise(out)
    return out


def round_half_even(value: Column, decimals: Column) -> Column:
    """Rounding scale must be a literal in Spark, so all scales at which a double has digits are spelled out; beyond
    17 decimals rounding cannot change it."""
    out = value
    for k in range(17, -1, -1):
        out = F.when(decimals == k, F.bround(value, k)).otherwise(out)
    return out


# --- atomic claims ------------------------------------------------------------------------------------------
def atomic_claims(sentence: Column) -> Column:
    """array<struct> of `item(quantity)` pairs, empty unless the sentence holds at least two."""
    matches = located_matches(marked_pieces(sentence, lx.ITEM_WITH_VALUE, 2))
    parsed = F.transform(matches, lambda m: F.struct(m["f"].alias("f"), m["start"].alias("start"), quantities(m["f"][2]).alias("q")))
    good = F.filter(parsed, lambda m: (F.size(m["q"]) == 1) & (F.get(m["q"], F.lit(0))["unit"] != ""))
    shaped = F.transform(good, lambda m, i: F.struct(
        (i + 1).alias("claim_index"), strip(F.regexp_replace(m["f"][1], r"\s+", " ")).alias("subject"),
        F.get(m["q"], F.lit(0))["raw"].alias("value_raw"), F.get(m["q"], F.lit(0))["unit"].alias("unit"),
        m["start"].alias("span_start"), (m["start"] + F.length(m["f"][0])).cast("int").alias("span_end")))
    return F.when(F.size(good) >= 2, shaped).otherwise(F.slice(shaped, 1, 0))


# --- judge responses ----------------------------------------------------------------------------------------
def first_json_object(response: Column) -> Column:
    """Text of the first valid JSON object in a reply that may carry words around it; null when there is none.  Braces
    are tried in order until one begins a valid object; the later ones are not parsed."""
    parts = F.split(F.coalesce(response, F.lit("")), r"\{", -1)

    def parsed(i: Column) -> Column:
        return F.get_json_object(F.concat(F.lit("{"), F.array_join(F.slice(parts, i, F.size(parts)), "{")), "$")
    found = F.aggregate(F.sequence(F.lit(2), F.size(parts)), F.lit(None).cast("string"), lambda done, i: F.coalesce(done, parsed(i)))
    return F.when(F.size(parts) > 1, found)
