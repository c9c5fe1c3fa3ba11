"""High-class support of components and splits, and the tables derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import violation
from .profiles import r6
from .ranking import first_per_group

CLASS_COLUMNS = ("low_pixels", "moderate_pixels", "high_pixels")

# The support criteria of a qualifying component and of the allocation.
CRITERIA = {
    "high_dates_per_component": 2, "minimum_date_span_days": 30,
    "high_patch_positions_per_component": 2, "minimum_high_pixels_per_component": 100,
    "test_high_components": 3, "validation_high_components": 1, "train_high_components": 2,
    "test_source_tiles": 2,
}


def _class_sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in CLASS_COLUMNS]


def position_cells(census: DataFrame, keys: list[str]) -> DataFrame:
    """Census folded to one row per key, grid position and date: the map-side combine of every support table."""
    return census.groupBy(*dict.fromkeys([*keys, "tile", "subtile_id", "patch_row", "patch_col", "day"])).agg(
        F.count(F.lit(1)).alias("_patches"), F.count_if(F.col("high_pixels") > 0).alias("_high_patches"), *_class_sums())


def group_support(census: DataFrame, group: str = "spatial_group_id") -> DataFrame:
    """Support of each component: patches, class pixels, High dates, span, positions, tiles and subtiles.

    The sets are bounded by the calendar and by the cells of a tile; positions are counted, so
    the plan carries a single distinct aggregate.
    """
    high = F.col("high_pixels") > 0
    day = F.when(high, F.col("day"))
    support = position_cells(census, [group]).groupBy(group).agg(
        F.sort_array(F.collect_set("tile")).alias("source_tiles"),
        F.sort_array(F.collect_set("subtile_id")).alias("subtiles"),
        F.sum("_patches").alias("patches"), *_class_sums(),
        F.sum("_high_patches").alias("high_patches"),
        F.size(F.collect_set(F.when(high, F.col("subtile_id")))).alias("high_subtiles"),
        F.sort_array(F.collect_set(day)).alias("high_dates"),
        F.count_distinct(F.when(high, F.struct("subtile_id", "patch_row", "patch_col"))).alias("high_patch_positions"))
    valid = sum((F.col(c) for c in CLASS_COLUMNS[1:]), F.col(CLASS_COLUMNS[0]))
    dates = F.col("high_dates")
    return support.withColumns({
        "valid_pixels": valid,
        "high_percent": F.when(valid > 0, 100 * F.col("high_pixels") / valid).otherwise(0.0),
        "high_date_count": F.size(dates),
        "high_date_span_days": F.coalesce(F.datediff(F.try_element_at(dates, F.lit(-1)), F.try_element_at(dates, F.lit(1))), F.lit(0)),
    })


def qualifies(criteria: dict = CRITERIA) -> Column:
    return ((F.col("high_date_count") >= criteria["high_dates_per_component"])
            & (F.col("high_date_span_days") >= criteria["minimum_date_span_days"])
            & (F.col("high_patch_positions") >= criteria["high_patch_positions_per_component"])
            & (F.col("high_pixels") >= criteria["minimum_high_pixels_per_component"]))


def pool_summary(census: DataFrame, sets: list[list[str]], group: str = "spatial_group_id") -> DataFrame:
    """Counts and High support for several groupings of the same scan (GROUPING SETS)."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    high = F.col("high_pixels") > 0
    copies = {f"_{c}": F.col(c) for c in (group, "tile", "subtile_id", "day")}
    cells = position_cells(census, list(dict.fromkeys([*keys, group]))).withColumns(copies)
    grouped = cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(
        F.sum("_patches").alias("decoded_pairs"), *_class_sums(), F.sum("_high_patches").alias("high_pairs"),
        F.count_distinct(F.when(high, F.col(f"_{group}"))).alias("high_components"),
        F.count_distinct(F.when(high, F.col("_subtile_id"))).alias("high_subtiles"),
        F.count_distinct(F.when(high, F.col("_day"))).alias("high_dates"),
        F.sort_array(F.collect_set(F.when(high, F.col("_tile")))).alias("high_source_tiles"))
    valid = sum((F.col(c) for c in CLASS_COLUMNS[1:]), F.col(CLASS_COLUMNS[0]))
    return grouped.withColumns({"valid_pixels": valid, "high_percent_valid": F.try_divide(100 * F.col("high_pixels"), valid)})


def split_support(census: DataFrame, split: str = "split", group: str = "spatial_group_id") -> DataFrame:
    """Patches, shares and class balance per split and for all rows together."""
    cells = census.groupBy(split, group, "subtile_id").agg(F.count(F.lit(1)).alias("_n"), *_class_sums())
    out = cells.withColumns({"_split": F.col(split), "_g": F.col(group), "_s": F.col("subtile_id")}).groupingSets(
        [[F.col("_split")], []], F.col("_split")).agg(
        F.sum("_n").alias("patches"), F.count_distinct("_s").alias("subtiles"),
        F.count_distinct("_g").alias("components"), *_class_sums())
    total = F.max("patches").over(Window.partitionBy())  # one row per split
    valid = sum((F.col(c) for c in CLASS_COLUMNS[1:]), F.col(CLASS_COLUMNS[0]))
    out = out.withColumns({"split": F.coalesce("_split", F.lit("all")), "fraction": r6(F.col("patches") / total), "valid_pixels": valid})
    return out.select("split", "patches", "fraction", "subtiles", "components", *CLASS_COLUMNS, "valid_pixels", *[
        r6(F.try_divide(100 * F.col(c), F.col("valid_pixels"))).alias(c.replace("pixels", "percent")) for c in CLASS_COLUMNS])


ALLOCATION_ORDER = ("high_date_count", "high_patch_positions", "high_subtiles")


def allocate_components(support: DataFrame, criteria: dict = CRITERIA, seed: str = "35042",
                        group: str = "spatial_group_id") -> tuple[DataFrame, DataFrame]:
    """Assign qualifying components to test, validation and train; scores never enter.

    A component lies in one tile, so the greedy tile-diversity pass equals "best component of
    each tile, then the best of those". Only the few chosen rows are ever ranked together.
    """
    order = [F.desc(c) for c in ALLOCATION_ORDER] + [F.asc("_rank")]
    eligible = support.where(qualifies(criteria)).select(
        group, *ALLOCATION_ORDER, F.col("source_tiles")[0].alias("_tile"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.col(group)), 256).alias("_rank"))
    tiles, n_test = criteria["test_source_tiles"], criteria["test_high_components"]
    n_val, n_train = criteria["validation_high_components"], criteria["train_high_components"]
    diverse = first_per_group(eligible, ["_tile"], order).orderBy(*order).limit(tiles)
    wanted = n_test - tiles + n_val + n_train
    others = eligible.join(diverse.select(group), group, "left_anti").orderBy(*order).limit(wanted)
    place = F.row_number().over(Window.partitionBy().orderBy(*order))  # at most ``wanted`` rows
    filled = others.withColumn("_place", place).withColumn(
        "split", F.when(F.col("_place") <= n_test - tiles, "test")
        .when(F.col("_place") <= n_test - tiles + n_val, "validation").otherwise("train"))
    allocation = diverse.select(group, F.lit("test").alias("split")).unionByName(filled.select(group, "split"))
    counts = eligible.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_tile").alias("tiles"))
    required = n_test + n_val + n_train
    problems = violation(counts, "allocation", F.col("n") < required, F.lit("components"),
                         F.concat(F.lit(f"need {required}, found "), F.col("n").cast("string"))).unionByName(
        violation(counts, "allocation", F.col("tiles") < tiles, F.lit("tiles"), "insufficient tile diversity"))
    if tiles > n_test:
        raise ValueError("Tile diversity exceeds the number of test components")
    return allocation, problems


def inventory_summary(rows: DataFrame, region: str, group: str, day: str) -> DataFrame:
    """Counts, distinct groups, regions and date range of paired samples."""
    folded = rows.groupBy(region, group).agg(F.count(F.lit(1)).alias("n"), F.min(day).alias("lo"), F.max(day).alias("hi"))
    return folded.agg(
        F.sum("n").alias("paired_samples"), F.sort_array(F.collect_set(region)).alias("regions"),
        F.count_distinct(group).alias("groups"), F.min("lo").alias("date_min"), F.max("hi").alias("date_max"))


def date_summary(days: DataFrame, keys: list[str]) -> DataFrame:
    """High days, their span, and totals at the three thresholds."""
    high_day = F.when(F.col("high") > 0, F.col("day"))
    return days.groupBy(*keys).agg(
        F.count(high_day).alias("dates_with_high"),
        F.coalesce(F.datediff(F.max(high_day), F.min(high_day)), F.lit(0)).alias("high_date_span_days"),
        F.sum("high").alias("high_total"), F.sum("high_199").alias("high_total_199"),
        F.sum("high_201").alias("high_total_201"), F.sum("valid").alias("valid_total"))


def waterbody_rollup(members: DataFrame, keys: list[str]) -> DataFrame:
    """Group totals with the qualified flag and the list of failed floors."""
    from ..checks import failing
    g = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_scenes"),
        F.datediff(F.max("day"), F.min("day")).alias("date_span_days"),
        F.count_if(F.col("native_high") > 0).alias("high_patch_count"),
        F.sum("native_high").alias("native_high_pixels"),
        F.sum("native_high_min").alias("native_high_min"), F.sum("native_high_max").alias("native_high_max"))
    failures = failing((F.col("candidate_scenes") < 2, "fewer_than_2_dates"),
                       (F.col("date_span_days") < 30, "date_span_below_30_days"),
                       (F.col("high_patch_count") < 3, "fewer_than_3_high_patches"),
                       (F.col("native_high_pixels") < 100, "fewer_than_100_native_high_pixels"))
    return g.withColumn("qualification_failure", F.concat_ws(";", failures)).withColumn(
        "qualified", F.col("qualification_failure") == "")


def duplicate_groups(rows: DataFrame, content: str, keys: list[str] | None = None) -> DataFrame:
    """Contents that occur more than once, with copies and extra copies."""
    counted = rows.groupBy(*(keys or []), content).agg(F.count(F.lit(1)).alias("copies"))
    return counted.where(F.col("copies") > 1).withColumn("extra_copies", F.col("copies") - 1)


def shared_across(rows: DataFrame, value: str, part: str) -> DataFrame:
    """Values present in more than one partition: one combined aggregate, no self-join."""
    flags = rows.where(F.col(value).isNotNull()).groupBy(value).agg(
        F.sort_array(F.collect_set(part)).alias("parts"), F.count(F.lit(1)).alias("rows"))
    return flags.where(F.size("parts") > 1)
