"""Patch-level profiles and pool tables built from the pixel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L


def r6(col: Column) -> Column:
    """Rounded to six digits, without negative zero."""
    return F.round(col, 6) + F.lit(0.0)


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def _histogram(pixels: DataFrame, keys: list[str], extra: list[Column] = ()) -> DataFrame:
    """DN counts per key: at most a few hundred rows per patch, combined map-side."""
    return pixels.groupBy(*keys, "dn", *extra).agg(F.count(F.lit(1)).alias("n"))


def _disc(q: float) -> Column:
    """Inverted-CDF quantile over the histogram rows of one patch (bounded by the DN domain)."""
    return F.expr(f"percentile_disc({q}) within group (order by cast(dn as double))")


def reference_profile(pixels: DataFrame, keys: list[str], height: int = 64, width: int = 64,
                      edges=L.BIN_EDGES, quantile: float = 0.9) -> DataFrame:
    """Counts, order statistics, bins, majority and centre consensus of each patch.

    Means of encoded DN carry no physical unit; NULL marks a statistic without valid pixels.
    """
    if not 0 <= quantile <= 1:
        raise ValueError("Quantile must lie in [0, 1]")
    low, high = L.check_edges(edges)
    dn, valid = F.col("dn"), L.is_valid_dn(F.col("dn"))
    x, b = F.when(valid, dn.cast("double")), L.dn_bin(dn, edges)
    center = (F.col("row").between((height - 1) // 2, height // 2)
              & F.col("col").between((width - 1) // 2, width // 2))

    def ordered(q):
        return F.expr(f"percentile_disc({q}) within group (order by _x) filter (where _x is not null)")

    stats = pixels.withColumn("_x", x).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_pixels"), count_if(valid).alias("valid_pixels"),
        count_if(valid & (dn == 0)).alias("below_detection_pixels"),
        count_if(L.is_flag(dn, L.LAND)).alias("land_pixels"), count_if(L.is_flag(dn, L.MASKED)).alias("masked_pixels"),
        count_if(L.dn_status(dn) == "invalid").alias("invalid_pixels"),
        *[count_if(b == i).alias(f"bin_{i}_pixels") for i in range(3)],
        ordered(0.5).alias("median_dn"), F.avg("_x").alias("mean_dn"), F.max("_x").alias("max_dn"),
        ordered(quantile).alias("upper_quantile_dn"),
        count_if(F.col("_x") >= low).alias("_ge_low"), count_if(F.col("_x") >= high).alias("_ge_high"),
        F.min(F.when(center, b)).alias("_c_min"), F.max(F.when(center, b)).alias("_c_max"),
        count_if(center & b.isNull()).alias("_c_bad"))
    bins = [F.col(f"bin_{i}_pixels") for i in range(3)]
    majority = F.when(F.col("valid_pixels") > 0, F.when((bins[0] > bins[1]) & (bins[0] > bins[2]), 0)
                      .when((bins[1] > bins[0]) & (bins[1] > bins[2]), 1)
                      .when((bins[2] > bins[0]) & (bins[2] > bins[1]), 2))
    n = F.col("valid_pixels")
    return stats.select(
        *keys, "total_pixels", "valid_pixels", "below_detection_pixels", "land_pixels", "masked_pixels", "invalid_pixels",
        "bin_0_pixels", "bin_1_pixels", "bin_2_pixels", r6(n / F.col("total_pixels")).alias("valid_fraction"),
        "median_dn", r6(F.col("mean_dn")).alias("mean_dn"), "max_dn", "upper_quantile_dn",
        *[L.bin_of(F.col(f"{s}_dn"), edges).alias(f"{s}_bin") for s in ("median", "mean", "max", "upper_quantile")],
        majority.alias("majority_bin"),
        r6(F.try_divide(F.col("_ge_low"), n)).alias(f"fraction_ge_{low}"),
        r6(F.try_divide(F.col("_ge_high"), n)).alias(f"fraction_ge_{high}"),
        F.when((F.col("_c_bad") == 0) & (F.col("_c_min") == F.col("_c_max")), F.col("_c_min")).alias("center_bin"))


BIN_FIELDS = ("median_bin", "mean_bin", "max_bin", "upper_quantile_bin", "majority_bin", "center_bin")


def aggregation_disagreement(profile: DataFrame) -> DataFrame:
    """Patches whose label summaries do not agree; undefined summaries do not count."""
    distinct = F.size(F.array_distinct(F.array_compact(F.array(*BIN_FIELDS))))
    return profile.withColumn("distinct_bins", distinct).where(F.col("distinct_bins") > 1)


def dn_histogram(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Map DN -> pixels per patch."""
    counted = _histogram(pixels, keys)
    return counted.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("dn", "n")))).alias("histogram"))


def patch_band_statistics(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Range, moments and linear percentiles per patch (and band): groups of one patch are bounded."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = pixels.groupBy(*keys).agg(
        F.min(v).cast("bigint").alias("min"), F.max(v).cast("bigint").alias("max"), F.avg(v).alias("_mean"),
        F.stddev_pop(v).alias("_std"), q.alias("_q"), F.avg((v == 0).cast("double")).alias("_zero"))
    return out.select(*keys, "min", "max", r6(F.col("_mean")).alias("mean"), r6(F.col("_std")).alias("std"),
                      *[r6(F.col("_q")[i]).alias(n) for i, n in enumerate(("p05", "p50", "p95"))],
                      r6(F.col("_zero")).alias("zero_fraction"))


def block_thumbnails(pixels: DataFrame, keys: list[str], value: str, block: int = 8, scale: float = 10000.0) -> DataFrame:
    """Means of block x block windows as one array per patch, in row-major block order."""
    means = pixels.groupBy(*keys, F.floor(F.col("row") / block).alias("br"), F.floor(F.col("col") / block).alias("bc")).agg(
        (F.avg(value) / scale).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("br", "bc", "m")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda s: s["m"]).alias("thumbnail"))


def reference_bin_table(pixels: DataFrame, sample: str) -> DataFrame:
    """Pixels, share, patches and observed range of each bin over the whole table."""
    per_patch = pixels.where(L.is_valid_dn(F.col("dn"))).groupBy(L.dn_bin(F.col("dn")).alias("bin"), sample).agg(
        F.count(F.lit(1)).alias("n"), F.min("dn").alias("lo"), F.max("dn").alias("hi"))
    per_bin = per_patch.groupBy("bin").agg(
        F.sum("n").alias("pixels"), F.count(F.lit(1)).alias("patches_with_bin"),
        F.min("lo").alias("observed_min"), F.max("hi").alias("observed_max"))
    total = per_bin.agg(F.sum("pixels").alias("_all"))  # three rows at most
    return per_bin.join(F.broadcast(total)).select(
        "bin", "pixels", r6(100 * F.col("pixels") / F.col("_all")).alias("percent_of_valid"),
        "patches_with_bin", "observed_min", "observed_max")


def coverage_scenarios(pixels: DataFrame, keys: list[str], thresholds) -> DataFrame:
    """Every patch against every coverage threshold: a fixed list exploded per patch row."""
    share = pixels.groupBy(*keys).agg(F.avg(L.is_valid_dn(F.col("dn")).cast("int")).alias("_share"))
    return share.withColumn("minimum_valid_fraction", F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))).select(
        *keys, "minimum_valid_fraction", (F.col("_share") >= F.col("minimum_valid_fraction")).alias("passes"))
