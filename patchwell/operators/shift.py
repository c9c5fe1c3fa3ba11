"""Distribution shift between pools: summaries, standardised differences, Wasserstein, look-alikes."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import exact_quantiles, ordered_rank, running_totals, value_bucket, with_next

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # its functions travel to the executors

MIN_SD = 1e-8  # fixed value: floor of a standard deviation used as divisor
VALUES, NEAREST_ROWS, PAIR_ROWS = 1 << 20, 4096, 1024  # fixed values: numbers and rows of a block of vectors at most


def long_features(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """One row per key and feature; NaN becomes NULL."""
    clean = df.select(*keys, *[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features])
    return clean.unpivot(keys, features, "feature", "value")


def feature_summaries(long: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Counts, mean, population standard deviation and exact quantiles per key and feature."""
    k = [*keys, "feature"]
    counts = long.groupBy(*k).agg(F.count("value").alias("n_finite"), F.count_if(F.col("value").isNull()).alias("n_undefined"),
                                  F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    q = exact_quantiles(long, k, "value", probs).drop("n")
    return counts.join(q, k, "left")


def standardized_differences(long: DataFrame, pool: str, base: str, keys: list[str] | None = None) -> DataFrame:
    """(mean - base mean) / max(base sd, floor) per pool and feature, also within further keys."""
    k = [*(keys or []), "feature"]
    stats = long.groupBy(pool, *k).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    ref = stats.where(F.col(pool) == base).select(*k, F.col("n").alias("base_n"), F.col("mean").alias("_m"), F.col("std").alias("_s"))
    return stats.where(F.col(pool) != base).join(F.broadcast(ref), k, "left").select(
        pool, *k, "n", "base_n", ((F.col("mean") - F.col("_m")) / F.greatest("_s", F.lit(MIN_SD))).alias("standardized_difference"))


def wasserstein(long: DataFrame, pool: str, base: str, per_octave: int = 64) -> DataFrame:
    """1-D Wasserstein distance of every pool from the base pool, in base standard deviations.

    Values are folded to counts first and that histogram is written once. The base counts are repeated per pool (a handful), then
    both cumulative shares come from one pair of running totals.
    """
    known = long.where(F.col("value").isNotNull())
    hist = known.groupBy(pool, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    pools = hist.where(F.col(pool) != base).groupBy("feature").agg(F.collect_set(pool).alias("_pools"))
    zero = F.lit(0).cast("bigint")
    reference = hist.where(F.col(pool) == base).join(F.broadcast(pools), "feature").select(
        F.explode("_pools").alias(pool), "feature", "value", F.col("n").alias("b"), zero.alias("a"))
    other = hist.where(F.col(pool) != base).select(pool, "feature", "value", zero.alias("b"), F.col("n").alias("a"))
    both = cut_lineage(reference.unionByName(other).groupBy(pool, "feature", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    k, bucket = [pool, "feature"], value_bucket(F.col("value"), per_octave)
    cumulative = running_totals(both, k, ["value"], {"ca": F.col("a"), "cb": F.col("b")}, bucket, {"ca": "ta", "cb": "tb"})
    stepped = with_next(cumulative, k, "value", bucket)
    gap = F.abs(F.col("ca") / F.col("ta") - F.col("cb") / F.col("tb")) * (F.col("next") - F.col("value"))
    sd = known.where(F.col(pool) == base).groupBy("feature").agg(F.greatest(F.stddev_pop("value"), F.lit(MIN_SD)).alias("_sd"))
    return stepped.groupBy(*k).agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("_w")).join(F.broadcast(sd), "feature").select(
        pool, "feature", (F.col("_w") / F.col("_sd")).alias("wasserstein_base_sd"))


def _blocks(vectors: DataFrame, vec: str, rows: int) -> DataFrame:
    """Vectors numbered (``_id``) by length and mean, in blocks of at most ``rows`` neighbours and ``VALUES`` numbers."""
    size = F.size(vec)
    mean = F.aggregate(vec, F.lit(0.0), lambda a, v: a + v) / size
    placed = ordered_rank(vectors.withColumns({"_len": size, "_mean": mean}), ["_len", "_mean"], "_id")
    return placed.withColumn("_block", F.expr(f"_id div greatest(1, least({rows}, {VALUES} div _len))"))


def _spans(blocks: DataFrame) -> DataFrame:
    """Range of the means of each block (one row a block), and from where on a mean belongs to it."""
    spans = blocks.groupBy("_len", F.col("_block").alias("_rb")).agg(F.min("_mean").alias("_lo"), F.max("_mean").alias("_hi"))
    order = Window.partitionBy("_len").orderBy("_rb")
    return cut_lineage(spans.withColumns({"_first": F.lag("_lo").over(order).isNull(), "_next": F.lead("_lo").over(order)}))


def _reaching(vectors: DataFrame, spans: DataFrame, vec: str, reach: Column) -> DataFrame:
    """Vectors with each block that may hold one within ``reach``: means differ by no more than the distance (and their rounding)."""
    rounding = 1e-9 * (reach + F.array_max(F.transform(vec, F.abs)))
    return vectors.withColumn("_reach", reach + rounding).join(F.broadcast(spans), "_len").where(
        (F.col("_hi") >= F.col("_mean") - F.col("_reach")) & (F.col("_lo") <= F.col("_mean") + F.col("_reach")))


def _meet(left: DataFrame, right: DataFrame, run, schema) -> DataFrame:
    """``run(left rows, right rows)`` for each block of ``left`` (``_block``) and block ``_rb`` of ``right`` that one of its rows asks for."""
    keys, n = ["_len", "_block", "_rb"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = right.withColumnRenamed("_block", "_rb").join(left.select(*keys).distinct(), ["_len", "_rb"])
    asked, held = (df.toDF(*df.columns).repartition(n, *keys).groupBy(*keys) for df in (left, held))  # few bytes, much work: not to be coalesced
    return asked.cogroup(held).applyInPandas(run, schema)


def _distances(left, right) -> Iterator[np.ndarray]:
    """Mean absolute differences of all rows of two columns of vectors, some rows of ``left`` at a time."""
    a, columns = np.stack(left.to_numpy()), np.ascontiguousarray(np.stack(right.to_numpy()).T)
    step = max(1, (1 << 17) // columns.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(a), step):
            part = a[at:at + step]
            total, gap = np.zeros((len(part), columns.shape[1])), np.empty((len(part), columns.shape[1]))
            for k, column in enumerate(columns):
                total += np.abs(np.subtract(part[:, k, None], column, out=gap), out=gap)
            yield total / len(columns)


def comparable(vec: str) -> Column:
    """Vectors of at least two components, all finite."""
    fine = F.forall(vec, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # NaN is larger than all numbers
    return F.coalesce((F.size(vec) > 1) & fine, F.lit(False))


def appearance_exposure(rows: DataFrame, sample: str, vec: str, split: str = "split", radius: float = 0.001) -> DataFrame:
    """Per test sample: exact distance to its nearest train sample, and whether that is within the radius.

    Distinct vectors lie in blocks by their mean. A test is compared with the block its mean falls in, then with each other
    block whose means come closer than the best found: pairs of blocks are dealt to the tasks, each a fixed number of rows. So
    memory is bounded whatever the vectors; the comparisons are as many as test times train where means tell nothing.
    NULL where there is no train sample of the same length, and for vectors that are null, shorter than two components or
    hold one that is null or not finite; these take no part.
    """
    vectors = cut_lineage(rows.where(comparable(vec)).groupBy(split, F.col(vec).cast("array<double>").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    test, train = (_blocks(vectors.where(F.col(split) == name).select("_v"), "_v", n) for name, n in (("test", NEAREST_ROWS // 2), ("train", NEAREST_ROWS)))
    spans = _spans(train)

    def run(tests, trains):
        best = [d.min(axis=1) for d in _distances(tests["_v"], trains["_v"])] if len(trains) else []
        return pd.DataFrame({"_id": tests["_id"], "distance": np.concatenate(best)} if best else {"_id": [], "distance": []})

    def nearest(asked: DataFrame) -> DataFrame:
        return _meet(asked.select("_id", "_v", "_len", "_block", "_rb"), train.select("_v", "_len", "_block"), run, "_id bigint, distance double")

    own = (F.col("_first") | (F.col("_mean") >= F.col("_lo"))) & F.coalesce(F.col("_mean") < F.col("_next"), F.lit(True))
    home = test.join(F.broadcast(spans), "_len").where(own)
    near = cut_lineage(nearest(home))
    left = home.select("_id", "_v", "_len", "_mean", "_block", F.col("_rb").alias("_home")).join(near, "_id")
    rest = nearest(_reaching(left, spans, "_v", F.col("distance")).where(F.col("_rb") != F.col("_home")))
    best = near.unionByName(rest).groupBy("_id").agg(F.min("distance").alias("distance"))
    found = test.select("_id", F.col("_v").alias("_t")).join(best, "_id").drop("_id")
    tests = rows.where(F.col(split) == "test").select(sample, F.col(vec).cast("array<double>").alias("_t"))
    return tests.join(found, "_t", "left").select(sample, F.col("distance").alias("nearest_distance"), F.coalesce(F.col("distance") <= radius, F.lit(False)).alias("exposed"))


def _within(left, right, radius: float, leading: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and RMSE of the pairs of two columns of vectors within a radius; the leading components tell most others apart."""
    a, b = np.stack(left.to_numpy()), np.stack(right.to_numpy())
    size, step = a.shape[1], max(1, (1 << 17) // len(b))
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(a), step):
            part = a[at:at + step]
            i, j = np.nonzero(sum(np.subtract.outer(part[:, k], b[:, k]) ** 2 for k in range(min(leading, size))) <= size * radius * radius * (1 + 1e-9))
            total = np.zeros(len(i))
            for k in range(size):
                total += (part[i, k] - b[j, k]) ** 2
            rmse = np.sqrt(total / size)
            here = rmse <= radius
            yield at + i[here], j[here], rmse[here]


def close_pairs(rows: DataFrame, sample: str, vec: str, radius: float) -> DataFrame:
    """Pairs of samples by RMSE, up to a radius; equal vectors count once under their smallest id.

    Vectors meet block by block where their means differ by no more than the radius; a vector that holds a null or a number
    that is not finite has no pairs.
    """
    distinct = rows.where(F.forall(vec, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & (F.size(vec) > 0)).groupBy(
        F.col(vec).cast("array<double>").alias("_v")).agg(F.min(sample).alias("id"), F.count(F.lit(1)).alias("copies")).where("id is not null")
    placed = _blocks(cut_lineage(distinct), "_v", PAIR_ROWS).select("_v", "_len", "_mean", "_block", "_id", "id", "copies")

    def run(left, right):
        found = []
        for i, j, rmse in _within(left["_v"], right["_v"], radius) if len(right) else ():
            once = left["_id"].to_numpy()[i] < right["_id"].to_numpy()[j]
            x, y = left[["id", "copies"]].iloc[i[once]], right[["id", "copies"]].iloc[j[once]]
            found.append(pd.DataFrame({"x": x["id"].to_numpy(), "y": y["id"].to_numpy(), "copies_x": x["copies"].to_numpy(), "copies_y": y["copies"].to_numpy(), "rmse": rmse[once]}))
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("x", "y", "copies_x", "copies_y", "rmse")})

    asked = _reaching(placed, _spans(placed), "_v", F.lit(radius)).where(F.col("_rb") >= F.col("_block"))
    kind = dict(placed.dtypes)["id"]
    pairs = _meet(asked.select("_v", "_len", "_block", "_rb", "_id", "id", "copies"), placed.drop("_mean"), run, f"x {kind}, y {kind}, copies_x bigint, copies_y bigint, rmse double")
    first = F.col("x") < F.col("y")
    return pairs.select(F.least("x", "y").alias("sample_a"), F.greatest("x", "y").alias("sample_b"), F.when(first, F.col("copies_x")).otherwise(F.col("copies_y")).alias("copies_a"),
                        F.when(first, F.col("copies_y")).otherwise(F.col("copies_x")).alias("copies_b"), "rmse")
