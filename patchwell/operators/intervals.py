"""Ordered-interval operators on hot keys: next-row spans, coalescing, running budgets, date gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import Checked, violation
from .ranking import range_bucket, running_total, with_next


def span_to_next(entries: DataFrame, archive: str, offset: str, ends: DataFrame, end: str) -> DataFrame:
    """Bytes from each entry to the next one of its archive; the last runs to the archive end."""
    ahead = with_next(entries, [archive], offset, range_bucket(entries, offset), "_next")
    return ahead.join(ends, archive, "left").withColumn(
        "span_bytes", F.coalesce("_next", end) - F.col(offset)).drop("_next", end)


def coalesce_intervals(ranges: DataFrame, keys: list[str], start: str, end: str, bucket: Column | None = None, gap: int = 1) -> DataFrame:
    """Merge ranges that overlap or touch (start <= furthest end so far + ``gap``); adds ``island`` and its bounds.

    ``bucket`` is a coarse, order-preserving function of ``start`` (a bounded number of ranges by default):
    the furthest end of the earlier buckets is one number per bucket, so no key is scanned by one task.
    """
    staged = ranges.withColumn("_b", range_bucket(ranges, start) if bucket is None else bucket)
    tops = staged.groupBy(*keys, "_b").agg(F.max(end).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_before", F.max("_top").over(earlier)).drop("_top")
    inner = Window.partitionBy(*keys, "_b").orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.max(end).over(inner), F.col("_before"))  # NULL-skipping
    flagged = staged.join(tops, [*keys, "_b"]).withColumn("_reach", reach).withColumn(
        "_opens", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + gap), 1).otherwise(0))
    return running_total(flagged.drop("_before", "_reach"), keys, [start, end], F.col("_opens"), F.col("_b"), "island").drop("_opens", "_b")


def islands(owned: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Bounds of each island of ``coalesce_intervals``."""
    return owned.groupBy(*keys, "island").agg(
        F.min(start).alias("range_start"), F.max(end).alias("range_end"), F.count(F.lit(1)).alias("members"))


def charge_ledger(events: DataFrame, log: str, seq: str, charged: str, limit: Column, bucket: Column | None = None) -> Checked:
    """Running charge per log up to the first request that would pass the limit (or is negative).

    That request is refused and ends the log: it is not charged, and what follows is not attempted. ``used`` is what
    had been charged after each row. The refusal is a violation.
    """
    ledger = running_total(events, [log], [seq], F.col(charged), range_bucket(events, seq) if bucket is None else bucket, "_sum").withColumn("limit", limit)
    bad = (F.col("_sum") > F.col("limit")) | (F.col(charged) < 0)
    ends = ledger.where(bad).groupBy(log).agg(F.min(seq).alias("_end"), F.min_by(F.col("_sum") - F.col(charged), seq).alias("_kept"))
    ledger = ledger.join(ends, log, "left")
    before = F.col("_end").isNull() | (F.col(seq) < F.col("_end"))
    ledger = ledger.withColumns({"used": F.when(before, F.col("_sum")).otherwise(F.col("_kept")), "status": F.when(before, "ACCEPTED").when(
        F.col(seq) == F.col("_end"), "REFUSED").otherwise("NOT_ATTEMPTED")}).drop("_sum", "_end", "_kept")
    problems = violation(ledger, "byte_budget", F.col("status") == "REFUSED", F.col(seq), F.col("used").cast("string"))
    return Checked(ledger, problems)


def temporal_density(rows: DataFrame, group: str, day: str) -> Checked:
    """Dates, gaps and density per group; a row without a known group is a violation.

    Days are made distinct first: a group holds at most one row per calendar day afterwards.
    """
    from ..checks import known
    known_rows = rows.withColumn(group, known(F.col(group)))
    per_day = known_rows.where(F.col(group).isNotNull()).groupBy(group, day).agg(F.count(F.lit(1)).alias("n"))
    gap = F.datediff(day, F.lag(day).over(Window.partitionBy(group).orderBy(day)))
    out = per_day.withColumn("gap", gap).groupBy(group).agg(
        F.sum("n").alias("sample_count"), F.count(F.lit(1)).alias("unique_dates"),
        F.min(day).alias("first_date"), F.max(day).alias("last_date"),
        F.min("gap").alias("min_gap_days"), F.percentile("gap", F.lit(0.5)).alias("median_gap_days"))
    span = F.datediff("last_date", "first_date")
    out = out.withColumns({
        "span_days": span, "same_date_extra_samples": F.col("sample_count") - F.col("unique_dates"),
        "dates_per_30_days": 30 * F.col("unique_dates") / (span + 1)})
    return Checked(out, violation(known_rows, "unknown_group", F.col(group).isNull(), F.col(day)))


def position_repeats(rows: DataFrame, keys: list[str], position: list[str], day: str, within: int = 30) -> DataFrame:
    """Positions seen on several dates, and those with a consecutive gap of at most ``within`` days."""
    dates = rows.select(*keys, *position, day).distinct()
    gap = F.datediff(day, F.lag(day).over(Window.partitionBy(*keys, *position).orderBy(day)))
    per_position = dates.withColumn("gap", gap).groupBy(*keys, *position).agg(
        F.count(F.lit(1)).alias("dates"), F.coalesce(F.bool_or(F.col("gap").between(1, within)), F.lit(False)).alias("close"))
    return per_position.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("positions"), F.count_if(F.col("dates") > 1).alias("positions_repeated"),
        F.count_if("close").alias("positions_repeated_within"))


def near_in_time(rows: DataFrame, group: str, day: str, tolerance: int) -> DataFrame:
    """Pairs of days of one group at most ``tolerance`` days apart, with the rows on each side.

    Rows of one group and day are folded first, so a hot group costs its calendar length, not
    its size squared. ``same_day_pairs`` counts the pairs inside one day.
    """
    if tolerance < 0:
        raise ValueError("Negative temporal tolerance")
    width = max(tolerance, 1)
    days = rows.where(F.col(group).isNotNull()).groupBy(group, day).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "_d", F.unix_date(day)).withColumn("_b", F.floor(F.col("_d") / width))
    left = days.withColumn("_b", F.explode(F.array(F.col("_b"), F.col("_b") + 1))).select(
        group, "_b", F.col(day).alias("left_day"), F.col("n").alias("left_rows"), F.col("_d").alias("_l"))
    right = days.select(group, "_b", F.col(day).alias("right_day"), F.col("n").alias("right_rows"), F.col("_d").alias("_r"))
    delta = F.col("_r") - F.col("_l")
    return left.join(right, [group, "_b"]).where(delta.between(0, tolerance)).select(
        group, "left_day", "right_day", delta.alias("days"), "left_rows", "right_rows",
        F.when(delta == 0, F.expr("left_rows * (left_rows - 1) div 2")).otherwise(F.col("left_rows") * F.col("right_rows")).alias("pairs"))
