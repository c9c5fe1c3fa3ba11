"""Leak-free splits, hash-ranked selections and the audits of a membership table.

Draws are replaced by salted-hash order: the same rows whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import Checked, all_violations, known, violation
from ..functions.names import HASH_SEED, salted_hash
from ..session import cut_lineage
from .components import adjacent_pairs, with_grid_neighbors
from .ranking import first_per_group, global_rank, rank_by_text, running_totals
from .support import CLASS_COLUMNS, CRITERIA, group_support, qualifies

SPLITS = ("train", "validation", "test")
ROUND_ROBIN_SALT = "phase3a3-split-v1"  # fixed value: salt of the three-way rotation
ROUND_ROBIN_NAMES = ("Training", "Validation", "Confirmation")


def _ranked(df: DataFrame, key: str, seed: str, strata: list[str] | None = None) -> DataFrame:
    return global_rank(df.withColumn("_hash", salted_hash(F.col(key), seed)), "_hash", strata, "rank", "total", [key]).drop("_hash")


def random_split(rows: DataFrame, key: str = "sample_id", seed: str = HASH_SEED) -> DataFrame:
    """Exact 80/10/10 by hash rank: the first floor(0.8 n) rows train, up to floor(0.9 n) validate."""
    n = F.col("total")
    split = F.when(F.col("rank") < F.floor(n * 0.8), "train").when(F.col("rank") < F.floor(n * 0.9), "validation").otherwise("test")
    return _ranked(rows, key, seed).withColumn("split", split).drop("rank", "total")


def stratified_split(rows: DataFrame, stratum: str, key: str = "sample_id", seed: str = HASH_SEED, minimum: int = 10) -> Checked:
    """80/10/10 inside every class with truncated counts; small classes are violations."""
    n = F.col("total")
    a = F.floor(n * 0.8)
    split = F.when(F.col("rank") < a, "train").when(F.col("rank") < a + F.floor(n * 0.1), "validation").otherwise("test")
    out = _ranked(rows, key, seed, [stratum]).withColumn("split", split).drop("rank", "total")
    small = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    return Checked(out, violation(small, "small_class", F.col("n") < minimum, stratum, F.col("n").cast("string")))


def component_split(rows: DataFrame, group: str, seed: str = HASH_SEED) -> Checked:
    """Whole components: the last two in hash order are test and validation, the rest train."""
    groups = rows.select(group).distinct().withColumn("_h", salted_hash(F.col(group), seed))
    last = groups.orderBy(F.desc("_h")).limit(2)  # two rows
    top = last.agg(F.max("_h").alias("_top"))
    held = last.join(F.broadcast(top)).select(group, F.when(F.col("_h") == F.col("_top"), "test").otherwise("validation").alias("_held"))
    out = rows.join(F.broadcast(held), group, "left").withColumn("split", F.coalesce("_held", F.lit("train"))).drop("_held")
    count = groups.agg(F.count(F.lit(1)).alias("n"))
    return Checked(out, violation(count, "too_few_components", F.col("n") < 3, F.col("n")))


def coin_split(rows: DataFrame, group: str, probability: float = 0.7, seed: str = HASH_SEED) -> DataFrame:
    """Independent coin per component; all-train outcomes are allowed."""
    if not 0 <= probability <= 1:
        raise ValueError("Probability must lie in [0, 1]")
    share = F.conv(F.substring(salted_hash(F.col(group), seed), 1, 8), 16, 10).cast("double") / 4294967296.0
    return rows.withColumn("split", F.when(share <= probability, "train").otherwise("test"))


def rotation_split(ids: DataFrame, key: str) -> DataFrame:
    """Distinct ids in salted-hash order, dealt to three names in turn."""
    dealt = global_rank(ids.select(key).distinct().withColumn("_h", salted_hash(F.col(key), ROUND_ROBIN_SALT, "|")), "_h", tie=[key])
    names = F.array(*[F.lit(n) for n in ROUND_ROBIN_NAMES])
    return dealt.select(key, F.get(names, (F.col("rank") % 3).cast("int")).alias("split"))


def declared_split(rows: DataFrame, group: str, declared: DataFrame) -> Checked:
    """Apply a declared group -> split table that must name exactly the eligible groups."""
    groups = rows.select(group).distinct()
    problems = all_violations(
        violation(groups.join(declared, group, "left_anti"), "undeclared_group", F.lit(True), group),
        violation(declared.join(groups, group, "left_anti"), "unknown_group", F.lit(True), group))
    return Checked(rows.join(declared.select(group, "split"), group), problems)


def exposure(rows: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Per key: test rows whose value also occurs in train, their share and the shared values.

    One aggregate per (key, value) with counts combined map-side; NULL values never match.
    """
    folded = rows.groupBy(split, *keys).agg(F.count(F.lit(1)).alias("n"))
    long = folded.unpivot([split, "n"], keys, "key", "value")
    test = F.when(F.col(split) == "test", F.col("n")).otherwise(0)
    per_value = long.groupBy("key", "value").agg(
        F.sum(test).alias("test"), (F.max((F.col(split) == "train").cast("int")) == 1).alias("in_train"))
    hit = F.col("value").isNotNull() & F.col("in_train")
    out = per_value.groupBy("key").agg(
        F.sum("test").alias("test_rows"), F.sum(F.when(hit, F.col("test")).otherwise(0)).alias("exposed_rows"),
        F.count_if(hit & (F.col("test") > 0)).alias("shared_values"))
    return out.withColumn("fraction", F.try_divide(F.col("exposed_rows"), F.col("test_rows")))


# Identity definitions of the cross-split audit.
IDENTITIES = (
    ("sample_id", "sample_id", "VERIFIED"), ("geographic_component", "spatial_group_id", "CANDIDATE"),
    ("source_subtile", "source_subtile", "CANDIDATE"), ("patch_position", "patch_position", "CANDIDATE"),
    ("sentinel_array_hash", "sen2_sha256", "VERIFIED_CONTENT"), ("cyan_array_hash", "cyan_sha256", "VERIFIED_CONTENT"),
    ("acquisition_date", "date", "DATE_ONLY"))
UNVERIFIABLE = ("lake_waterbody_id", "sentinel_scene_id", "footprint_geometry", "physical_footprint_overlap", "bloom_event_id")
PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))


def _value_splits(rows: DataFrame, keys: list[str], split: str) -> DataFrame:
    """Which splits each (key, value) occurs in, as one flag per split."""
    texts = rows.select(split, *[F.col(k).cast("string").alias(k) for k in keys])
    long = texts.unpivot([split], keys, "key", "value").where(known(F.col("value")).isNotNull())
    return long.groupBy("key", "value").agg(*[
        (F.max((F.col(split) == s).cast("int")) == 1).alias(s) for s in SPLITS])


def overlap_audit(rows: DataFrame, identities=IDENTITIES, split: str = "split") -> DataFrame:
    """Overlap count of every identity for every pair of splits, plus the identities that cannot be tested."""
    flags = _value_splits(rows, [k for _, k, _ in identities], split)
    counts = flags.groupBy("key").agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}") for a, b in PAIRS])
    long = counts.unpivot(["key"], [f"{a}|{b}" for a, b in PAIRS], "pair", "overlap_count")
    spark = rows.sparkSession
    grid = [(label, key, level, f"{a}|{b}") for a, b in PAIRS
            for label, key, level in (*identities, *[(u, None, "UNKNOWN") for u in UNVERIFIABLE])]
    fixed = spark.createDataFrame(grid, "identity_type string, key string, evidence_level string, pair string")
    out = fixed.join(F.broadcast(long), ["key", "pair"], "left")  # one row per identity and pair on both sides
    count = F.when(F.col("key").isNotNull(), F.coalesce("overlap_count", F.lit(0)))
    return out.select(
        F.split("pair", r"\|")[0].alias("left_split"), F.split("pair", r"\|")[1].alias("right_split"), "identity_type",
        "evidence_level", count.alias("overlap_count"),
        F.when(count.isNull(), "UNKNOWN").when(count == 0, "NO_OVERLAP").otherwise("OVERLAP_OBSERVED").alias("status"))


def isolation_violations(rows: DataFrame, fields: list[str], split: str = "split", sealed: str = "CONFIRMATION",
                         accessed: str | None = None) -> DataFrame:
    """Values of a protected field that occur in more than one split, and opened sealed labels.

    Every shared value that isn't empty is a leak, an unknown marker too: what is unknown isn't isolated.
    """
    long = rows.select(split, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([split], fields, "field", "value")
    spans = long.withColumn("value", F.trim("value")).where("value <> ''").groupBy("field", "value").agg(
        F.min(split).alias("a"), F.max(split).alias("b"))
    leaks = spans.where(F.col("a") != F.col("b")).select(
        F.lit("cross_partition").alias("rule"), F.concat_ws("=", "field", "value").alias("key"), F.lit("").alias("detail"))
    if accessed is None:
        return leaks
    opened = (F.col(split) == sealed) & (F.lower(F.col(accessed).cast("string")) == "true")
    return leaks.unionByName(violation(rows, "sealed_label_access", F.coalesce(opened, F.lit(False)), F.lit(sealed)))


def validate_partition(rows: DataFrame, membership: DataFrame, list_key: str = "waterbody_ids",
                       keys=("spatial_group_id", "footprint_id"), classes=(0, 1, 2)) -> DataFrame:
    """Violations of a partition: coverage, empty splits, geographic leakage, missing classes."""
    joined = rows.join(membership, "sample_id", "left")
    extra = membership.join(rows.select("sample_id"), "sample_id", "left_anti")
    long = joined.select("split", F.explode(F.concat(
        *[F.array(F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("value"))) for k in keys],
        F.transform(F.col(list_key), lambda w: F.struct(F.lit(list_key).alias("field"), w.alias("value"))))).alias("e"))
    spans = long.where(F.col("split").isNotNull()).groupBy("e.field", "e.value").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    absent = rows.sparkSession.createDataFrame([(s, c) for s in SPLITS for c in classes], "split string, class_id int")
    have = joined.select("split", F.col("class_id").cast("int").alias("class_id")).distinct()
    bad_class = ~F.coalesce(F.col("class_id").isin(*classes), F.lit(False))
    return all_violations(
        violation(joined, "unassigned_sample", F.col("split").isNull(), "sample_id"),
        violation(extra, "unknown_sample", F.lit(True), "sample_id"),
        violation(joined, "invalid_split", ~F.col("split").isin(*SPLITS), "sample_id"),
        violation(joined, "invalid_class", bad_class, "sample_id"),
        violation(spans, "geographic_leakage", F.col("a") != F.col("b"), F.concat_ws("=", "field", "value")),
        violation(absent.join(have, ["split", "class_id"], "left_anti"), "missing_class", F.lit(True), F.concat_ws("=", "split", "class_id")))


def validate_support(rows: DataFrame, criteria: dict = CRITERIA, context: DataFrame | None = None, size: int = 50) -> Checked:
    """Support table per split with every gate of a frozen split checked.

    ``rows``: census rows with split, spatial_group_id, subtile_id, tile, x, y. ``context`` is the
    component table of the full grid: a retained row must carry the same component.
    """
    spans = isolation_violations(rows, ["spatial_group_id", "subtile_id"])
    cells = rows.groupBy(F.col("subtile_id").alias("key"), "tile", "x", "y").agg(F.min("split").alias("split"))
    owner = cells.select(F.col("key").alias("a"), F.col("split").alias("sa"))
    touching = adjacent_pairs(cells.drop("split"), size).join(owner, "a").join(
        owner.select(F.col("a").alias("b"), F.col("sa").alias("sb")), "b")
    groups = group_support(rows.withColumn("_key", F.concat_ws("\x1f", "split", "spatial_group_id")), "_key")
    groups = groups.withColumn("split", F.substring_index("_key", "\x1f", 1)).withColumn("qualified", qualifies(criteria))
    tiles = F.when(F.col("qualified"), F.col("source_tiles"))
    table = groups.groupBy("split").agg(
        F.sum("patches").alias("patches"), F.count(F.lit(1)).alias("geographic_groups"),
        F.count_if("qualified").alias("qualified_high_groups"), F.sum("valid_pixels").alias("valid_pixels"),
        *[F.sum(c).alias(c) for c in CLASS_COLUMNS],
        F.size(F.array_distinct(F.flatten(F.collect_set(tiles)))).alias("qualified_tiles"))
    needed = F.when(F.col("split") == "test", criteria["test_high_components"]).when(
        F.col("split") == "validation", criteria["validation_high_components"]).otherwise(criteria["train_high_components"])
    problems = [
        spans, violation(touching, "adjacent_across_splits", F.col("sa") != F.col("sb"), F.concat_ws("|", "a", "b")),
        violation(rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")), "duplicate_sample", F.col("n") > 1, "sample_id"),
        violation(table, "missing_class", F.least(*CLASS_COLUMNS) <= 0, "split"),
        violation(table, "too_few_qualified", F.col("qualified_high_groups") < needed, "split"),
        violation(table, "tile_diversity", (F.col("split") == "test") & (F.col("qualified_tiles") < criteria["test_source_tiles"]), "split")]
    if context is not None:
        full = context.select("subtile_id", F.col("spatial_group_id").alias("_full"))
        named = rows.select("subtile_id", "spatial_group_id").distinct().join(full, "subtile_id", "left")
        problems.append(violation(named, "component_identity", F.coalesce(F.col("_full") != F.col("spatial_group_id"), F.lit(True)), "subtile_id"))
    return Checked(table, all_violations(*problems))


def capped_per_group(rows: DataFrame, group: list[str], key: str, limit: int, seed: str = HASH_SEED) -> DataFrame:
    """First ``limit`` rows of each group by salted hash."""
    return first_per_group(rows.withColumn("_h", salted_hash(F.col(key), seed)), group, [F.asc("_h"), F.asc(key)], limit).drop("_h")


def screening_plan(entries: DataFrame, whole: Column, dates: int = 16, per_date: int = 4, seed: str = HASH_SEED) -> DataFrame:
    """Whole archives as they are; elsewhere hash-picked dates per subtile and the largest members per date."""
    rest = entries.where(~whole)
    days = rest.select("subtile_id", "day").distinct().withColumn("_h", salted_hash(F.col("day").cast("string"), seed))
    picked = first_per_group(days, ["subtile_id"], [F.asc("_h")], dates).select("subtile_id", "day")
    ranked = rest.join(picked, ["subtile_id", "day"], "left_semi").withColumn("_h", salted_hash(F.col("sample_id"), seed))
    chosen = first_per_group(ranked, ["subtile_id", "day"], [F.desc("compressed_bytes"), F.asc("_h")], per_date).drop("_h")
    return entries.where(whole).withColumn("reason", F.lit("whole_archive")).unionByName(chosen.withColumn("reason", F.lit("screened")))


def followup_plan(candidates: DataFrame, observed: DataFrame, group: str, criteria: dict = CRITERIA,
                  limit: int = 1024, seed: str = HASH_SEED, far_days: int = 30) -> DataFrame:
    """Unseen candidates of components with some but too little High, by distance to known High in time and space."""
    support = group_support(observed, group).where((F.col("high_pixels") > 0) & ~qualifies(criteria))
    targets = support.select(group, F.get("high_dates", F.lit(0)).alias("_first"), F.try_element_at("high_dates", F.lit(-1)).alias("_last"))
    fresh = candidates.join(observed.select("sample_id"), "sample_id", "left_anti").join(targets, group)
    high = observed.where(F.col("high_pixels") > 0).select(group, "subtile_id", "patch_row", "patch_col").distinct()
    near = with_grid_neighbors(fresh, high, [group, "subtile_id"])
    same = near.join(high.withColumn("_same", F.lit(True)), [group, "subtile_id", "patch_row", "patch_col"], "left")
    far = (F.datediff("day", "_first") >= far_days) | (F.datediff("_last", "day") >= far_days)
    ranked = same.withColumns({
        "near_in_time": ~far, "distance": F.when(F.col("_same"), 0).when(F.col("has_neighbor"), 1).otherwise(2),
        "_hd": salted_hash(F.col("day").cast("string"), seed), "_hs": salted_hash(F.col("sample_id"), seed)})
    keyed = ranked.withColumn("_key", F.struct("near_in_time", "distance", "_hd", "_hs"))
    coarse = F.struct("near_in_time", "distance", F.substring("_hd", 1, 2).alias("h"))
    placed = running_totals(keyed, [group], ["_key"], {"_place": F.lit(1)}, coarse)
    return placed.where(F.col("_place") <= limit).drop("_first", "_last", "_same", "has_neighbor", "_hd", "_hs", "_key", "_place")


def anchored_selection(pool: DataFrame, group: str, criteria: dict = CRITERIA, fill: int = 48, cap: int = 64,
                       seed: str = HASH_SEED) -> Checked:
    """Per component: anchors on its first and last High date, more High until it qualifies, then hash fill.

    Adding rows in a fixed order until a monotone rule holds equals keeping the rows whose
    preceding prefix does not satisfy it yet: running totals over (anchor first, then High
    pixels, then hash), with a first-occurrence flag for distinct dates and positions.
    """
    hashed = pool.withColumn("_h", salted_hash(F.col("sample_id"), seed))
    high = hashed.where(F.col("high_pixels") > 0)
    bounds = high.groupBy(group).agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    ends = high.join(bounds, group).where((F.col("day") == F.col("_first")) | (F.col("day") == F.col("_last")))
    best = [F.desc("high_pixels"), F.asc("_h")]
    anchors = first_per_group(ends, [group, "day"], best, 2).select(group, "sample_id", F.lit(0).alias("_turn"))
    queue = high.join(anchors, [group, "sample_id"], "left").withColumn("_turn", F.coalesce("_turn", F.lit(1)))
    queue = cut_lineage(queue.select(group, "sample_id", "day", "subtile_id", "patch_row", "patch_col", "high_pixels", "_turn", "_h"))
    queue = queue.withColumn("_key", F.struct("_turn", (-F.col("high_pixels")).alias("hp"), F.col("_h").alias("h")))
    for flag, cols in (("_new_day", ["day"]), ("_new_position", ["subtile_id", "patch_row", "patch_col"])):
        firsts = queue.groupBy(group, *cols).agg(F.min("_key").alias("_min"))
        queue = queue.join(firsts, [group, *cols]).withColumn(flag, (F.col("_key") == F.col("_min")).cast("bigint")).drop("_min")
    coarse = F.struct("_turn", (-F.col("high_pixels")).alias("hp"), F.substring("_h", 1, 2).alias("h"))
    amounts = {f"_run_{n}": F.col(c) for n, c in (("day", "_new_day"), ("position", "_new_position"), ("high", "high_pixels"))}
    limits = running_totals(queue, [group], ["_key"], amounts, coarse).join(bounds, group)
    span_ok = F.datediff("_last", "_first") >= criteria["minimum_date_span_days"]
    before_ok = (span_ok & (F.col("_run_day") - F.col("_new_day") >= criteria["high_dates_per_component"])
                 & (F.col("_run_position") - F.col("_new_position") >= criteria["high_patch_positions_per_component"])
                 & (F.col("_run_high") - F.col("high_pixels") >= criteria["minimum_high_pixels_per_component"]))
    kept = cut_lineage(limits.where((F.col("_turn") == 0) | ~before_ok).select(group, "sample_id"))
    counts = kept.groupBy(group).agg(F.count(F.lit(1)).alias("_kept"))
    rest = first_per_group(hashed.join(kept, [group, "sample_id"], "left_anti"), [group], [F.asc("_h")], fill)
    rest = rest.join(counts, group, "left").withColumn("_place", F.row_number().over(_per(group)))
    background = rest.where(F.col("_place") <= fill - F.coalesce("_kept", F.lit(0))).select(group, "sample_id")
    out = kept.withColumn("inclusion_reason", F.lit("support_anchor")).unionByName(
        background.withColumn("inclusion_reason", F.lit("hash_background")))
    return Checked(out, violation(counts, "anchors_exceed_cap", F.col("_kept") > cap, group))


def _per(group: str):
    return Window.partitionBy(group).orderBy("_h")  # at most ``fill`` rows per group are left here


def evenly_spaced(rows: DataFrame, key: str, count: int) -> DataFrame:
    """``count`` rows at evenly spaced ranks of the sorted key."""
    ranked = rank_by_text(rows, key, "rank", "total")
    if count == 1:
        return ranked.where(F.col("rank") == 0).drop("rank", "total")
    steps = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("total") - 1) / (count - 1)))
    return ranked.where(F.array_contains(steps, F.col("rank"))).drop("rank", "total")


def pixel_sample(pixels: DataFrame, sample: str, pixel: str, per_patch: int = 256, cap: int = 32768, seed: str = HASH_SEED) -> DataFrame:
    """At most ``per_patch`` pixels of each patch, then at most ``cap`` in all, both by hash."""
    keyed = pixels.withColumn("_id", F.concat_ws("|", F.col(sample).cast("string"), F.col(pixel).cast("string")))
    trimmed = capped_per_group(keyed, [sample], "_id", per_patch, seed)
    return _ranked(trimmed, "_id", f"{seed}-cap").where(F.col("rank") < cap).drop("rank", "total", "_id")


def balanced_sample(rows: DataFrame, label: str, key: str, classes: int = 3, seed: str = HASH_SEED) -> DataFrame:
    """n/classes rows of each class: the first by hash, repeated draws only where a class is short.

    A short class draws with replacement: draw k takes member ``hash(k) mod size``. The draws are
    numbered by a range that Spark deals out evenly, then meet the members by rank; the label has few values.
    """
    ranked = _ranked(rows, key, seed, [label])
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    wanted = rows.agg(F.floor(F.count(F.lit(1)) / classes).alias("_want"))  # one row
    members = ranked.drop("total").join(F.broadcast(sizes), label).join(F.broadcast(wanted))
    enough = members.where(F.col("_size") >= F.col("_want")).where(F.col("rank") < F.col("_want")).withColumn("draw", F.col("rank"))
    short = members.where(F.col("_size") < F.col("_want"))
    want = wanted.first()["_want"] or 0
    lacking = sizes.where(F.col("_size") < want).select(label, "_size")  # at most one row per class
    draws = rows.sparkSession.range(want).withColumnRenamed("id", "draw").join(F.broadcast(lacking))
    token = F.sha2(F.concat_ws(":", F.lit(seed), F.col(label).cast("string"), F.col("draw").cast("string")), 256)
    picks = draws.select(label, "draw", (F.conv(F.substring(token, 1, 8), 16, 10).cast("bigint") % F.col("_size")).alias("rank"))
    repeated = short.join(picks, [label, "rank"])
    return enough.unionByName(repeated).drop("_size", "_want", "rank")


def balanced_weights(rows: DataFrame, label: str, classes: int = 3) -> Checked:
    """Inverse-frequency weights N/(classes * n_c); a class without rows is a violation."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.sparkSession.createDataFrame([(c,) for c in range(classes)], f"{label} int")
    full = grid.join(F.broadcast(counts), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.sum("n").alias("_all"))
    out = full.join(F.broadcast(total)).select(label, "n", F.try_divide(F.col("_all"), classes * F.col("n")).alias("weight"))
    return Checked(out, violation(out, "empty_class", F.col("n") == 0, label))


def set_differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys on one side only; empty means the sets are equal."""
    e, a = expected.select(key).distinct(), actual.select(key).distinct()
    return e.join(a, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        a.join(e, key, "left_anti").withColumn("side", F.lit("unexpected")))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)

