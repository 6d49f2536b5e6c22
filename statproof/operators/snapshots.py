"""Evidence snapshots, their differences and revisions, coordinates, gated comparison and completions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from statproof.functions import lexicon as lx, text as tx
from statproof.functions.scale import anchored_contains, contained_maps, first_per_key, stable

LEVELS = range(1, 9)
CURRENT_AGENCY = "국가데이터처"
FORMER_AGENCY_NAMES = ["통계청", "statistics korea", "kostat"]
PERIOD_LABELS = {"Y": "연", "M": "월", "Q": "분기"}


def _levels(df: DataFrame) -> list:
    return [i for i in LEVELS if f"c{i}_nm" in df.columns]


def _clean(c) -> Column:
    return tx.strip(F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"\s+", " "))


def selection_map(df: DataFrame) -> Column:
    """Map dimension label -> value of one cube row; empty labels and values are left out."""
    pairs = F.array(*[F.struct(_clean(f"c{i}_obj_nm").alias("k"), _clean(f"c{i}_nm").alias("v")) for i in _levels(df)])
    return F.map_from_entries(F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "")))


def canonical_map(m: Column) -> Column:
    """Sorted `key=value` text of a map: an order-free identity for joins and hashes."""
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(_clean(e["key"]).alias("k"), _clean(e["value"]).alias("v"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), e["v"])), ";")


def snapshot_records(stats: DataFrame) -> DataFrame:
    return stats.select("org_id", F.col("tbl_id"), F.col("prd_de").alias("period"), F.col("dt").alias("value"), F.col("unit_nm").alias("unit"), F.col("itm_nm").alias("indicator"),
                        F.col("lst_chn_de").alias("last_changed"), selection_map(stats).alias("selection"))


def build_snapshots(stats: DataFrame) -> DataFrame:
    """Snapshot header per table: record count, content hash, id.

    Rows are hashed one by one and the digests of 4,096 hash ranges are combined, so a huge table is never gathered
    whole into one row while the result stays independent of row order."""
    r = snapshot_records(stats)
    line = F.sha2(F.concat_ws("|", "period", "indicator", canonical_map(F.col("selection")), "value", "unit", "last_changed"), 256)
    part = r.withColumn("_h", line).groupBy("org_id", "tbl_id", F.substring("_h", 1, 3).alias("_p")).agg(
        F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("d"))
    head = part.groupBy("org_id", "tbl_id").agg(F.sum("n").alias("n_records"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "d"))), lambda x: x["d"]), ""), 256).alias("content_hash"))
    return head.withColumn("snapshot_id", F.concat(F.lit("snap-"), F.substring("content_hash", 1, 16)))


LEAF = 64


def snapshot_tree(stats: DataFrame) -> DataFrame:
    """Snapshot header per table like `build_snapshots`, with a hash tree that has as many levels as the table needs.

    A record's digest is the hash of its text; equal records make one entry with their count.  A node of the tree holds the
    entries whose digests share a prefix: up to `LEAF` entries hash as their sorted list, more hash as the hashes of the
    sixteen nodes below, each with its digit.  So the hash depends on the records alone, not on partitions, order or depth
    of the computation, and no group gathers more than sixteen leaves.  The levels follow the largest table: at the deepest
    one a node is expected to hold 1/16 of an entry, so more than `LEAF` there would need colliding digests."""
    r = snapshot_records(stats)
    line = F.sha2(F.concat_ws("|", "period", "indicator", canonical_map(F.col("selection")), "value", "unit", "last_changed"), 256)
    entries = r.select("org_id", "tbl_id", line.alias("h")).groupBy("org_id", "tbl_id", "h").agg(F.count(F.lit(1)).alias("c"))
    entries = stable(entries)
    largest = entries.groupBy("org_id", "tbl_id").count().agg(F.max("count")).first()[0] or 0
    depth = len(f"{largest:x}") + 1
    nodes = entries.select("org_id", "tbl_id", F.substring("h", 1, depth).alias("at"), F.col("c").alias("n"),
                           F.array(F.concat_ws("*", "h", "c")).alias("few"), F.lit("").alias("d"))
    for level in range(depth, -1, -1):
        child = F.struct(F.substring("at", -1, 1).alias("digit"), "n", "few", "d")
        merged = nodes.groupBy("org_id", "tbl_id", F.substring("at", 1, level).alias("at")).agg(F.collect_list(child).alias("below"))
        # A level adds nothing where every node below is still a list that fits here as well.
        lists = F.sort_array(F.flatten("below.few"))
        small = F.forall("below", lambda x: F.size(x["few"]) > 0) & (F.size(lists) <= LEAF)
        closed = F.transform(F.sort_array("below"), lambda x: F.concat(x["digit"], F.when(F.size(x["few"]) > 0, F.sha2(F.array_join(x["few"], ";"), 256)).otherwise(x["d"])))
        total = F.aggregate("below", F.lit(0).cast("long"), lambda s, x: s + x["n"])
        nodes = merged.select("org_id", "tbl_id", "at", total.alias("n"), F.when(small, lists).otherwise(F.array().cast("array<string>")).alias("few"),
                              F.when(~small, F.sha2(F.array_join(closed, ";"), 256)).otherwise(F.lit("")).alias("d"))
    root = F.when(F.size("few") > 0, F.sha2(F.array_join("few", ";"), 256)).otherwise(F.col("d"))
    return nodes.select("org_id", "tbl_id", F.col("n").alias("n_records"), root.alias("content_hash")).withColumn(
        "snapshot_id", F.concat(F.lit("snap-"), F.substring("content_hash", 1, 16)))


def evidence_id(table: Column, indicator: Column, selection: Column) -> Column:
    t = _clean(table)
    return F.concat(t, F.lit(":"), F.substring(F.sha2(F.concat_ws("|", t, _clean(indicator), canonical_map(selection)), 256), 1, 16))


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """added / changed / removed records by (table, period, indicator, selection)."""
    def side(df, tag):
        return df.select("tbl_id", "period", "indicator", canonical_map(F.col("selection")).alias("sel"), F.struct("value", "last_changed", "selection").alias(tag))
    j = side(before, "b").join(side(after, "a"), ["tbl_id", "period", "indicator", "sel"], "full")
    kind = (F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed")
             .when((F.col("b.value") != F.col("a.value")) | (F.col("b.last_changed") != F.col("a.last_changed")), "changed"))
    return (j.withColumn("change_type", kind).where("change_type IS NOT NULL")
            .select("tbl_id", "period", "indicator", "sel", "change_type", F.coalesce("a.selection", "b.selection").alias("selection"), F.coalesce("b.value", F.lit("")).alias("value_before"), F.coalesce("a.value", F.lit("")).alias("value_after")))


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def revision_impact(diff: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings whose whole (non-empty) selection occurs in a changed or removed record.

    Containment on distinct selections, filed under their rarest (key, value) pair."""
    d = diff.where(F.col("change_type").isin("changed", "removed"))
    m = mappings.withColumn("msel", canonical_map(F.col("selection")))
    wanted = first_per_key(m.where(F.size("selection") > 0).select(F.col("msel").alias("w"), F.col("selection").alias("wmap")), ["w"], [F.lit(1)])
    offered = first_per_key(d.select(F.col("sel").alias("o"), F.col("selection").alias("omap")), ["o"], [F.lit(1)])
    pairs = contained_maps(wanted, offered).select(F.col("w").alias("msel"), F.col("o").alias("sel"))
    return m.drop("selection").join(pairs, "msel").join(d.drop("selection", "change_type"), "sel")


def review_id(impacts: DataFrame, before_id: str, after_id: str) -> Column:
    return F.concat(F.lit("revision-"), F.substring(F.sha2(F.concat_ws("|", "tbl_id", "mapping_id", "period", "indicator", F.lit(before_id), F.lit(after_id)), 256), 1, 16))


def revision_queue(impacts: DataFrame, existing: DataFrame, decisions: DataFrame, before_id: str, after_id: str) -> DataFrame:
    """Reviews with a deterministic id, inserted once, with the latest decision laid over."""
    new = first_per_key(impacts.withColumn("review_id", review_id(impacts, before_id, after_id)), ["review_id"], ["mapping_id"]).select("review_id", "tbl_id")
    queue = existing.select("review_id", "tbl_id").unionByName(new.join(existing.select("review_id"), "review_id", "left_anti"))
    last = decisions.where(F.col("action").isin("approved", "hold", "ignored")).groupBy("review_id").agg(F.max_by("action", "decided_at").alias("action"))
    return queue.join(last, "review_id", "left").select("review_id", "tbl_id", F.coalesce("action", F.lit("pending")).alias("status"))


# --- gated comparison ---------------------------------------------------------------------------------------
def _norm_period(c: Column) -> Column:
    p = F.trim(c)
    ym = r"^(\d{4})[.-](\d{1,2})$"
    return (F.when(p.rlike(ym), F.concat(F.regexp_extract(p, ym, 1), F.lit("-"), F.lpad(F.regexp_extract(p, ym, 2), 2, "0")))
             .when(p.rlike(r"^\d{6}$"), F.concat(F.substring(p, 1, 4), F.lit("-"), F.substring(p, 5, 2))).otherwise(F.replace(p, F.lit("."), F.lit("-"))))


def _key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s()_%]", ""))


def _unit(c: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(u == "퍼센트", "%").when(u == "퍼센트포인트", "%p").otherwise(u)


def _kind(c: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(u.isin("%p", "퍼센트포인트"), "point").when(u.isin("%", "퍼센트"), "rate").otherwise("absolute")


def _selected(record: Column, wanted: Column) -> Column:
    return F.forall(F.map_entries(wanted), lambda e: (e["value"] == "") | (F.trim(F.coalesce(F.try_element_at(record, e["key"]), F.lit(""))) == F.trim(e["value"])))


GATES = ("period", "indicator", "selection", "value_kind", "unit")


def compare_snapshot(claims: DataFrame, records: DataFrame) -> DataFrame:
    """claims(claim_id, sentence, date, tbl_id, evidence_indicator, evidence_selection) against stored records.

    Gates run in a fixed order.  The first ones ask for distinct keys of the records (table; table and period; those and
    the indicator), so a claim meets only the records of its own indicator, never its whole (table, period) slice; the
    first record that fits its selection is a mergeable minimum."""
    s = F.col("sentence")
    c = claims.withColumn("c", F.explode(F.array(F.struct(tx.primary_quantity(tx.quantities(s)).alias("q"), tx.period(s, F.col("date")).alias("p")))))
    c = c.select("claim_id", "tbl_id", "evidence_selection", _key(F.col("evidence_indicator")).alias("_ind"), "c.q", "c.p")
    r = records.select("tbl_id", _norm_period(F.col("period")).alias("p"), _key(F.col("indicator")).alias("_ind"), F.col("selection").alias("rsel"), "value", "unit")
    for keys, name in ((["tbl_id"], "stored"), (["tbl_id", "p"], "has_period"), (["tbl_id", "p", "_ind"], "has_ind")):
        c = c.join(r.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left")
    fits = r.join(c.where("has_ind").select("claim_id", "tbl_id", "p", "_ind", "evidence_selection"), ["tbl_id", "p", "_ind"]).where(_selected(F.col("rsel"), F.col("evidence_selection")))
    order = F.struct(canonical_map(F.col("rsel")), F.col("value"))
    found = fits.groupBy("claim_id").agg(F.min_by(F.struct("value", "unit"), order).alias("rec"), F.lit(True).alias("has_sel"))
    g = c.withColumnRenamed("p", "claim_period").join(found, "claim_id", "left")
    q, no = F.col("q"), lambda c: ~F.coalesce(F.col(c), F.lit(False))
    official = tx.official_number(F.col("rec.value"))
    gap = F.abs(q["normalized_value"] - official)
    tol = F.when(q["unit"].isin("%", "퍼센트"), lx.PERCENT_TOLERANCE).otherwise(0.0)
    gate = (F.when(q.isNull(), "no_quantity").when(F.col("claim_period") == "", "no_period").when(no("stored"), "no_snapshot").when(no("has_period"), "period")
             .when(no("has_ind"), "indicator").when(no("has_sel"), "selection").when(_kind(q["unit"]) != _kind(F.col("rec.unit")), "value_kind")
             .when(_unit(q["unit"]) != _unit(F.col("rec.unit")), "unit").when(official.isNull(), "unreadable_value"))
    passed = F.lit(len(GATES))
    for i, name in enumerate(GATES):
        passed = F.when(gate == name, i).otherwise(passed)
    passed = F.when(gate.isin("no_quantity", "no_period", "no_snapshot"), 0).otherwise(passed)
    trail = F.slice(F.array(*[F.lit(n) for n in GATES]), F.lit(1), passed)
    return g.select("claim_id", F.when(gate.isNotNull(), "not_comparable").when(gap <= tol, "match").otherwise("mismatch").alias("status"), F.coalesce(gate, F.lit("compared")).alias("gate"),
                    q["raw"].alias("claim_value"), F.concat("rec.value", "rec.unit").alias("official_value"), "claim_period", trail.alias("gates_passed"), F.when(gate.isNull(), tol).alias("tolerance"))


def rank_records(comparisons: DataFrame, records: DataFrame) -> DataFrame:
    """Every stored record of the claim's table with four gate flags and its position: the primary record, then the
    alternatives by gates, normalised period, indicator key, selection, value and unit.

    comparisons(claim_id, tbl_id, claim_period, claim_unit, evidence_indicator, evidence_selection, status, official_value;
    official_period if known): the primary record is the first in that order that passes all gates and holds the period
    and value of a decided comparison; there is none otherwise.  Equal records keep any order among themselves, and one of
    them is primary.  A record without selection, period, indicator or unit passes the gates that ask for none."""
    c = F.col
    j = comparisons.join(records.withColumnRenamed("selection", "rsel"), "tbl_id").withColumn("rsel", F.coalesce("rsel", F.create_map().cast("map<string,string>")))
    period, unit, value = (F.coalesce(x, F.lit("")) for x in (_norm_period(c("period")), _unit(c("unit")), F.trim("value")))
    official_period = F.coalesce("official_period", "claim_period") if "official_period" in comparisons.columns else c("claim_period")
    flags = {"g_period": period == _norm_period(c("claim_period")), "g_indicator": _key(c("indicator")) == _key(c("evidence_indicator")),
             "g_selection": _selected(c("rsel"), c("evidence_selection")), "g_unit": unit == _unit(c("claim_unit"))}
    for n, f in flags.items():
        j = j.withColumn(n, F.coalesce(f, F.lit(False)))
    used = (c("status").isin("match", "mismatch") & (F.concat(value, F.trim(F.coalesce("unit", F.lit("")))) == c("official_value"))
            & (period == _norm_period(official_period)))
    j = j.withColumn("match_score", sum((c(n).cast("int") for n in flags), F.lit(0)))
    selection = F.array_sort(F.map_entries("rsel"))
    w = Window.partitionBy("claim_id").orderBy(*[F.desc(n) for n in flags], period, _key(c("indicator")), selection, value, unit)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    j = j.withColumn("_at", F.row_number().over(w)).withColumn("_used", F.coalesce((c("match_score") == 4) & used, F.lit(False)))
    j = j.withColumn("_first", F.min(F.when(c("_used"), c("_at"))).over(whole))
    return (j.withColumn("is_primary", F.coalesce(c("_at") == c("_first"), F.lit(False)))
            .withColumn("position", F.when(c("is_primary"), 1).when(c("_at") < c("_first"), c("_at") + 1).otherwise(c("_at"))).drop("_at", "_used", "_first"))


# --- table structure and coordinates ------------------------------------------------------------------------
def _coordinates(stats: DataFrame) -> DataFrame:
    """Long form (tbl_id, row_no, label, value) of every coordinate of a row."""
    pairs = [F.struct(_clean(f"c{i}_obj_nm").alias("label"), _clean(f"c{i}_nm").alias("value")) for i in _levels(stats)]
    pairs += [F.struct(F.lit(n).alias("label"), _clean(c).alias("value")) for n, c in (("항목", "itm_nm"), ("시점", "prd_de"), ("단위", "unit_nm"))]
    kept = F.filter(F.array(*pairs), lambda p: (p["label"] != "") & (p["value"] != ""))
    return stats.select("tbl_id", "row_no", F.explode(kept).alias("p")).select("tbl_id", "row_no", "p.*")


def table_structure(stats: DataFrame) -> DataFrame:
    long = _coordinates(stats)
    dims = long.groupBy("tbl_id", "label").agg(F.countDistinct("value").alias("n"))
    dim = ~F.col("label").isin("항목", "시점", "단위")
    varying = dim & (F.col("n") > 1)
    a = dims.groupBy("tbl_id").agg(F.count_if(varying).alias("varying"), F.max(varying & tx.contains_any(F.col("label"), lx.REGION_DIMENSION_TOKENS)).alias("regional"),
                                   F.max(F.when(F.col("label") == "시점", F.col("n"))).alias("periods"), F.max(F.when(F.col("label") == "항목", F.col("n"))).alias("items"))
    p, i = F.coalesce("periods", F.lit(0)), F.coalesce("items", F.lit(0))
    return a.select("tbl_id", "varying", F.when(F.col("regional"), "regional_comparison").when(F.col("varying") >= 2, "crosstab").when((p > 1) & (i <= 1), "time_series")
                    .when(i > 1, "indicator_bundle").otherwise("unknown").alias("structure"))


def coordinate_axes(stats: DataFrame) -> DataFrame:
    """Distinct values per table and label with the position of their first row (kept long: an axis can be large)."""
    return _coordinates(stats).groupBy("tbl_id", "label", "value").agg(F.min("row_no").alias("first_row"))


def recommend_coords(axes: DataFrame, claims: DataFrame) -> DataFrame:
    """claims(claim_id, tbl_id, subject, period, unit, comparison) -> one existing value per label where a cue fits.

    One equality join per cue: the period with its hyphens removed, the unit, the subject on every label without a cue
    of its own, and the comparison by containment on the distinct items of a table."""
    c = F.col
    def bare(x):
        return F.replace(x, F.lit("-"), F.lit(""))
    own = ((c("label") == "시점") & (c("period") != "")) | ((c("label") == "단위") & (c("unit") != "")) | ((c("label") == "항목") & (c("comparison") != ""))
    cols = ["claim_id", "tbl_id", "label", "value", "first_row"]
    period = axes.where("label = '시점'").withColumn("cue", bare(c("value"))).join(claims.where("period <> ''").withColumn("cue", bare(c("period"))), ["tbl_id", "cue"])
    unit = axes.where("label = '단위'").withColumn("cue", c("value")).join(claims.where("unit <> ''").withColumn("cue", _clean("unit")), ["tbl_id", "cue"])
    subject = axes.withColumn("cue", c("value")).join(claims.where("subject <> ''").withColumn("cue", _clean("subject")), ["tbl_id", "cue"]).where(~own)
    asked = claims.where("comparison <> ''").withColumn("cue", _clean("comparison"))
    items = axes.where("label = '항목'")
    named = anchored_contains(items.select("tbl_id", "value"), "value", asked.select("tbl_id", "cue").distinct(), "cue", on=["tbl_id"])
    item = named.join(asked, ["tbl_id", "cue"]).join(items, ["tbl_id", "value"])
    hits = period.select(cols).unionByName(unit.select(cols)).unionByName(subject.select(cols)).unionByName(item.select(cols))
    return hits.groupBy("claim_id", "tbl_id", "label").agg(F.min_by("value", F.struct("first_row", "value")).alias("value"))


def rows_at(stats: DataFrame, coords: DataFrame) -> DataFrame:
    """(claim_id, row_no) of rows matching every selected coordinate.

    A claim is filed under its rarest coordinate and meets only the rows there; the others are confirmed on the row.  A
    coordinate that most rows share (a unit) pairs nothing unless it is all a claim has."""
    long = _coordinates(stats).distinct()
    often = long.groupBy("tbl_id", "label", "value").agg(F.count(F.lit(1)).alias("n"))
    filed = coords.join(often, ["tbl_id", "label", "value"], "left").groupBy("claim_id", "tbl_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)), "label", "value")).alias("_rare"), F.collect_list(F.struct("label", "value")).alias("_all"))
    filed = filed.select("claim_id", "tbl_id", "_all", F.col("_rare.label"), F.col("_rare.value"))
    held = long.groupBy("tbl_id", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("_at"))
    near = filed.join(long, ["tbl_id", "label", "value"]).select("claim_id", "tbl_id", "row_no", "_all").join(held, ["tbl_id", "row_no"])
    return near.where(F.forall("_all", lambda x: F.try_element_at("_at", x["label"]) == x["value"])).select("claim_id", "tbl_id", "row_no")


def organization(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.lower(t).isin(FORMER_AGENCY_NAMES), CURRENT_AGENCY).otherwise(t)


def evidence_draft(stats: DataFrame) -> DataFrame:
    """Draft per table from its first row: title, indicator, dimensions, unit, organization (`org_nm`), time dimension
    (`prd_se`), `k=v;k=v` selection."""
    first = stats.groupBy("tbl_id").agg(F.min_by(F.struct(*[c for c in stats.columns if c != "tbl_id"]), "row_no").alias("r")).select("tbl_id", "r.*")
    labels = F.filter(F.array(*[_clean(f"c{i}_obj_nm") for i in _levels(stats)]), lambda x: x != "")
    pairs = F.array(*[F.when((_clean(f"c{i}_obj_nm") != "") & (_clean(f"c{i}_nm") != ""), F.concat(_clean(f"c{i}_obj_nm"), F.lit("="), _clean(f"c{i}_nm"))) for i in _levels(stats)])
    time = F.lit("")
    for code, label in PERIOD_LABELS.items():
        time = F.when(F.upper(F.trim("prd_se")) == code, label).otherwise(time)
    return first.select("tbl_id", F.col("tbl_nm").alias("title"), F.col("itm_nm").alias("indicator"), F.array_join(labels, ", ").alias("dimensions"), F.col("unit_nm").alias("unit"),
                        organization(F.col("org_nm")).alias("organization"), time.alias("time_dimension"), F.array_join(F.array_compact(pairs), ";").alias("source_selection"))


def parse_selection(c: Column) -> Column:
    """`k=v;k=v` text -> map; null when a part is not key=value."""
    parts = F.filter(F.transform(F.split(c, ";"), F.trim), lambda p: p != "")
    bad = F.exists(parts, lambda p: ~p.rlike(r"^\s*[^=\s][^=]*=\s*\S"))
    return F.when(~bad, F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.trim(F.substring(p, F.locate("=", p) + 1, F.length(p)))))))


def complete_claims(claims: DataFrame, records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Claim + evidence identity + snapshot + gated comparison in one record; anything undecided is `hold`."""
    verdict = compare_snapshot(claims, records)
    ids = claims.select("claim_id", "tbl_id", evidence_id(F.col("tbl_id"), F.col("evidence_indicator"), F.col("evidence_selection")).alias("evidence_id"))
    j = ids.join(snapshots.select("tbl_id", "snapshot_id"), "tbl_id", "left").join(verdict, "claim_id")
    return j.withColumn("verdict", F.when(F.col("status").isin("match", "mismatch"), F.col("status")).otherwise("hold"))


def freeze_completions(selected: DataFrame) -> DataFrame:
    """selected(evidence_id, tbl_id, snapshot_id, comparison_snapshot_id, snapshot_tbl_id, sentence, status): consistency
    checks as an error column; rows without error carry the frozen verdict."""
    def blank(c):
        return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    error = (F.when(blank("sentence"), "sentence_required").when((blank("evidence_id") & blank("tbl_id")) | blank("tbl_id"), "evidence_required").when(blank("snapshot_id"), "snapshot_required")
              .when(~blank("comparison_snapshot_id") & (F.col("comparison_snapshot_id") != F.col("snapshot_id")), "comparison_snapshot_differs")
              .when(~blank("snapshot_tbl_id") & (F.col("snapshot_tbl_id") != F.col("tbl_id")), "snapshot_table_differs"))
    return selected.withColumn("error", error).withColumn("verdict", F.when(error.isNull(), F.when(F.col("status").isin("match", "mismatch"), F.col("status")).otherwise("hold")))


# --- formulas and request planning --------------------------------------------------------------------------
def evaluate_formulas(cases: DataFrame) -> DataFrame:
    """cases(mode, claimed, tolerance, a, b, series): the official value is recomputed per mode, then compared.
    a/b are value | current/base | left/right | numerator/denominator | target."""
    m, a, b, s = F.col("mode"), F.col("a"), F.col("b"), F.col("series")
    extreme = F.when(m == "historical_maximum", F.array_max(s)).when(m == "historical_minimum", F.array_min(s))
    beaten = m.startswith("historical") & (F.abs(a - extreme) > F.col("tolerance"))
    filled = F.coalesce(F.size(s), F.lit(0)) > 0
    official = (F.when(m == "direct", a).when((m == "change_rate") & (b != 0), (a / b - 1) * 100).when(m == "difference", a - b).when((m == "ratio") & (b != 0), a / b)
                 .when(m.startswith("historical") & filled, F.when(beaten, extreme).otherwise(a)).when((m == "count_lt_zero") & filled, F.size(F.filter(s, lambda x: x < 0)).cast("double")))
    status = (F.when(official.isNull(), "not_comparable").when(beaten, "mismatch").when(F.abs(F.col("claimed") - official) <= F.col("tolerance"), "match").otherwise("mismatch"))
    return cases.withColumn("official", official).withColumn("status", status)


def expand_coords(plans: DataFrame) -> DataFrame:
    """plans(plan_id, item, shared map, components array<map>) -> one request map per component (at least one)."""
    def codes(m):
        return F.transform_keys(F.map_filter(m, lambda k, v: k.rlike(r"^C\d+$")), lambda k, v: F.concat(F.lit("obj_l"), F.regexp_replace(k, "^C", "")))
    base = F.when(F.coalesce("item", F.lit("")) != "", F.map_concat(F.create_map(F.lit("itm_id"), "item"), codes(F.col("shared")))).otherwise(codes(F.col("shared")))
    one = plans.select("plan_id", base.alias("base"), F.posexplode_outer("components").alias("i", "c"))
    own = F.when(F.col("c").isNull(), F.map_filter(F.col("base"), lambda k, v: F.lit(False))).otherwise(codes(F.col("c")))
    merged = F.map_concat(F.map_filter(F.col("base"), lambda k, v: ~F.map_contains_key(F.col("own"), k)), F.col("own"))
    return one.withColumn("own", own).select("plan_id", F.coalesce("i", F.lit(0)).alias("component"), merged.alias("request"))


def pending_requests(requests: DataFrame, done: DataFrame) -> DataFrame:
    """requests(request_id, params map) not covered by a completed params map, i.e. no completed map is a subset.

    Containment on distinct maps; an empty completed map covers everything, as a subset does."""
    r, d = requests.withColumn("_r", canonical_map(F.col("params"))), done.withColumn("_d", canonical_map(F.col("params")))
    offered = first_per_key(r.select(F.col("_r").alias("o"), F.col("params").alias("omap")), ["o"], [F.lit(1)])
    wanted = first_per_key(d.select(F.col("_d").alias("w"), F.col("params").alias("wmap")), ["w"], [F.lit(1)])
    covered = contained_maps(wanted, offered).select(F.col("o").alias("_r")).distinct()
    everything = d.where(F.size("params") == 0).agg(F.count(F.lit(1)).alias("n")).scalar()
    return r.join(covered, "_r", "left_anti").where(everything == 0).drop("_r")
