"""Inventories, pool comparisons and calendar tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import Checked, all_violations, violation
from ..functions import labels as L
from ..functions import names as N
from .components import with_grid_neighbors
from .intervals import position_repeats
from .profiles import r6
from .support import CLASS_COLUMNS, duplicate_groups

SEASONS = ("DJF", "MAM", "JJA", "SON")


@dataclass(frozen=True)
class Inventory:
    strict_rows: DataFrame
    violations: DataFrame


def pair_inventory(members: DataFrame) -> Inventory:
    """Samples with both kinds, from one aggregate over the member names; everything else is reported."""
    parsed = N.with_member(members).select("member", "parsed.sample_id", "parsed.kind", "parsed.reject")
    good = parsed.where(F.col("reject").isNull())
    per = good.groupBy("sample_id").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("member"))).alias(f"{k}_member") for k in N.KINDS],
        *[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in N.KINDS])
    one_each = (F.col("_sen2") == 1) & (F.col("_cyan") == 1)
    names = members.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    bad = parsed.where(F.col("reject").isNotNull()).select(F.col("reject").alias("rule"), F.col("member").alias("key"), F.lit("").alias("detail"))
    problems = all_violations(
        bad, violation(names, "duplicate_name", F.col("n") > 1, "member"),
        violation(per, "unpaired", (F.col("_sen2") == 0) | (F.col("_cyan") == 0), "sample_id"),
        violation(per, "ambiguous_kind", (F.col("_sen2") > 1) | (F.col("_cyan") > 1), "sample_id"))
    return Inventory(per.where(one_each).select("sample_id", "sen2_member", "cyan_member"), problems)


def _valid(prefix: str = "") -> Column:
    return sum((F.col(prefix + c) for c in CLASS_COLUMNS[1:]), F.col(prefix + CLASS_COLUMNS[0]))


def identity_table(split_rows: DataFrame, census: DataFrame) -> Checked:
    """Split rows with parsed identity and census support; gaps and conflicts are violations."""
    parsed = N.with_sample(split_rows).select(
        *split_rows.columns, F.col("parsed.region").alias("source_tile"), "parsed.patch_row", "parsed.patch_col",
        F.col("parsed.acquisition_date").alias("_day"), F.col("parsed.subtile_id").alias("_subtile"), F.col("parsed.reject").alias("_reject"))
    joined = parsed.join(census.withColumn("_found", F.lit(True)), "sample_id", "left")
    conflict = (F.col("_day") != F.col("date")) | (F.col("_subtile") != F.col("source_subtile"))
    problems = all_violations(
        violation(joined, "unrecognized_id", F.col("_reject").isNotNull(), "sample_id"),
        violation(joined, "missing_census_row", F.col("_found").isNull(), "sample_id"),
        violation(joined, "identity_conflict", conflict, "sample_id"))
    rows = joined.where(F.col("_found") & F.col("_reject").isNull() & ~conflict).select(
        "sample_id", "split", "spatial_group_id", "source_tile", F.col("date").cast("string").alias("acquisition_date"),
        "patch_row", "patch_col", _valid().alias("valid_pixels"), "high_pixels",
        r6(F.when(_valid() > 0, 100 * F.col("high_pixels") / _valid()).otherwise(0.0)).alias("high_percent"))
    return Checked(rows, problems)


def selected_support(selected: DataFrame, group: str = "spatial_group_id") -> DataFrame:
    """High support of the selected patches of each component."""
    cells = selected.groupBy(group, "split", "tile", "day").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("high_pixels") > 0).alias("_h"), *[F.sum(c).alias(c) for c in CLASS_COLUMNS])
    out = cells.groupBy(group).agg(
        F.min("split").alias("split"), F.sum("_n").alias("selected_patches"), F.sum("_h").alias("high_patches"),
        F.sum("high_pixels").alias("high_pixels"), F.sum(_valid()).alias("valid_pixels"),
        F.count_distinct("day").alias("distinct_dates"), F.count_distinct(F.when(F.col("_h") > 0, F.col("day"))).alias("high_dates"),
        F.array_join(F.sort_array(F.collect_set("tile")), "|").alias("source_tiles"))
    return out.withColumn("high_percent_valid", r6(F.coalesce(F.try_divide(100 * F.col("high_pixels"), F.col("valid_pixels")), F.lit(0.0))))


def screened_vs_selected(support: DataFrame, selected: DataFrame, group: str = "spatial_group_id") -> DataFrame:
    """Screened support next to what was selected, with explicit defaults where nothing was."""
    chosen = selected.groupBy(group).agg(
        F.min("split").alias("_split"), F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("high_pixels") > 0).alias("_hp"), F.sum("high_pixels").alias("_h"))
    zero = F.lit(0)
    return support.join(chosen, group, "left").select(
        group, F.col("patches").alias("screened_patches"), F.col("high_pixels").alias("screened_high_pixels"),
        F.coalesce("_split", F.lit("NOT_SELECTED")).alias("selected_split"), F.coalesce("_n", zero).alias("selected_patches"),
        F.coalesce("_hp", zero).alias("selected_high_patches"), F.coalesce("_h", zero).alias("selected_high_pixels"))


def daily_counts(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Class counts per key and day, with High at thresholds 199, 200 and 201."""
    dn, ok = F.col("dn"), L.is_valid_dn(F.col("dn"))
    return pixels.groupBy(*keys, "day").agg(
        F.count_if(L.dn_bin(dn) == 0).alias("low"), F.count_if(L.dn_bin(dn) == 1).alias("moderate"),
        F.count_if(ok & (dn >= 200)).alias("high"), F.count_if(ok & (dn >= 199)).alias("high_199"),
        F.count_if(ok & (dn >= 201)).alias("high_201"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


def counter_tables(rows: DataFrame, dims: list[str]) -> DataFrame:
    """One count table per dimension from a single scan."""
    folded = rows.groupBy(*dims).agg(F.count(F.lit(1)).alias("_n"))
    return folded.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.sum("_n").alias("n"))


def _calendar_values(day: Column) -> Column:
    pair = [F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value"))
            for d, v in (("month", F.month(day)), ("season", N.season(day)), ("year", F.year(day)))]
    return F.explode(F.array(*pair))


def calendar_grid(rows: DataFrame) -> DataFrame:
    """Counts and shares per pool, unit and calendar value, zero where nothing was observed.

    Months and seasons are a short literal list; the years run from the first to the last of all pools.
    """
    per_day = rows.groupBy("pool", "day").agg(F.count(F.lit(1)).alias("patch"), F.lit(1).cast("bigint").alias("unique_date"))
    units = per_day.unpivot(["pool", "day"], ["patch", "unique_date"], "unit", "n")
    seen = units.select("pool", "unit", "n", _calendar_values(F.col("day")).alias("c")).groupBy(
        "pool", "unit", "c.dimension", "c.value").agg(F.sum("n").alias("n"))
    totals = units.groupBy("pool", "unit").agg(F.sum("n").alias("total"))
    span = per_day.agg(F.min(F.year("day")).alias("_from"), F.max(F.year("day")).alias("_to"))  # one row
    fixed = [("month", str(m)) for m in range(1, 13)] + [("season", s) for s in SEASONS]
    entry = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.alias("value"))
    years = F.transform(F.sequence("_from", "_to"), lambda y: entry("year", y.cast("string")))
    grid = totals.join(F.broadcast(span)).withColumn("c", F.explode(F.concat(F.array(*[entry(d, F.lit(v)) for d, v in fixed]), years))).select(
        "pool", "unit", "total", "c.*")
    out = grid.join(seen, ["pool", "unit", "dimension", "value"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("pool", "unit", "dimension", "value", n.alias("n"), r6(n / F.col("total")).alias("proportion"), "total")


def temporal_shift(rows: DataFrame, base: str) -> DataFrame:
    """Total variation of each pool's month shares from the base pool, dates and months observed."""
    per_day = rows.groupBy("pool", "day").agg(F.count(F.lit(1)).alias("n"))
    months = [F.sum(F.when(F.month("day") == m, F.col("n")).otherwise(0)).alias(f"m{m}") for m in range(1, 13)]
    wide = per_day.groupBy("pool").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("unique_dates"), *months)
    shares = wide.select("pool", "unique_dates", *[(F.col(f"m{m}") / F.col("t")).alias(f"p{m}") for m in range(1, 13)])
    ref = shares.where(F.col("pool") == base).select(*[F.col(f"p{m}").alias(f"q{m}") for m in range(1, 13)])  # one row
    gap = sum((F.abs(F.col(f"p{m}") - F.col(f"q{m}")) for m in range(2, 13)), F.abs(F.col("p1") - F.col("q1")))
    observed = sum(((F.col(f"p{m}") > 0).cast("bigint") for m in range(2, 13)), (F.col("p1") > 0).cast("bigint"))
    return shares.where(F.col("pool") != base).join(F.broadcast(ref)).select(
        "pool", r6(gap / 2).alias("total_variation"), "unique_dates", observed.alias("months_observed"))


def independence(high: DataFrame, group: str, content: str, place: str = "subtile_id") -> DataFrame:
    """Per component: positions, repeats, patches with a neighbour of the same date, and identical extra masks."""
    repeats = position_repeats(high, [group], [place, "patch_row", "patch_col"], "day")
    neighbors = with_grid_neighbors(high, high, [place, "day"]).groupBy(group).agg(
        F.count(F.lit(1)).alias("high_patches"), F.count_if("has_neighbor").alias("high_patches_with_neighbor"))
    copies = duplicate_groups(high, content, [group]).groupBy(group).agg(F.sum("extra_copies").alias("_extra"))
    return neighbors.join(repeats, group).join(copies, group, "left").select(
        group, "high_patches", "positions", "positions_repeated", "positions_repeated_within", "high_patches_with_neighbor",
        F.coalesce("_extra", F.lit(0)).alias("identical_extra_patches"))
