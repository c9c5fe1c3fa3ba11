"""Calibration, ranking curves, temperature and losses of probability tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import Checked, violation
from ..functions.probability import clip, cross_entropy, focal, is_normalized
from .ranking import exact_quantiles, running_totals, share_bucket

QUANTILES = {"q0": 0.0, "q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q100": 1.0}


def _sets(df: DataFrame, sets: list[list[str]], keys: list[str]) -> DataFrame:
    """Rows of a small aggregate repeated per grouping set with NULL for rolled-up keys."""
    missing = [[k for k in keys if k not in s] for s in sets]
    parts = [df.withColumns({k: F.lit(None).cast("string") for k in m}) if m else df for m in missing]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reliability_bins(rows: DataFrame, keys: list[str], sets: list[list[str]], confidence: Column, correct: Column,
                     bins: int = 15) -> DataFrame:
    """Equal-width bins with counts, mean confidence and frequency; empty bins stay with NULL means."""
    index = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
    fine = rows.groupBy(*keys, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(confidence).alias("_c"), F.sum(correct.cast("double")).alias("_k"))
    slots = [F.struct(F.lit(b).alias("bin"), *[
        F.sum(F.when(F.col("bin") == b, F.col(c))).alias(c) for c in ("_n", "_c", "_k")]) for b in range(bins)]
    wide = _sets(fine, sets, keys).groupBy(*keys).agg(F.array(*slots).alias("_slots"))
    one = wide.select(*keys, F.explode("_slots").alias("_s")).select(*keys, "_s.*").withColumn("count", F.coalesce("_n", F.lit(0)))
    return one.select(*keys, "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), "count",
                      F.try_divide("_c", "count").alias("confidence"), F.try_divide("_k", "count").alias("frequency"))


def expected_error(bins: DataFrame, keys: list[str], out: str = "ece") -> DataFrame:
    gap = F.coalesce(F.col("count") * F.abs(F.col("confidence") - F.col("frequency")), F.lit(0.0))
    return bins.groupBy(*keys).agg((F.sum(gap) / F.sum("count")).alias(out))


def calibration(rows: DataFrame, keys: list[str], sets: list[list[str]], bins: int = 15, strong: float = 0.8) -> Checked:
    """The calibration record per grouping: accuracy, ECE, Brier, NLL and the High one-versus-rest part."""
    y, p = F.col("y"), F.col("prob")
    known = rows.where(y.isNotNull())
    top, high, high_y = F.array_max(p), p[2], (y == 2).cast("double")
    brier = sum(((p[i] - (y == i).cast("double")) * (p[i] - (y == i).cast("double")) for i in (1, 2)),
                (p[0] - (y == 0).cast("double")) * (p[0] - (y == 0).cast("double")))
    sure = (F.col("pred") == 2) & (top >= strong)
    fine = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == y).alias("right"), F.sum(brier).alias("brier"),
        F.sum(-F.log(clip(F.element_at(p, y + 1)))).alias("nll"),
        F.sum((high - high_y) * (high - high_y)).alias("high_brier"),
        F.sum(-(high_y * F.log(clip(high)) + (1 - high_y) * F.log(1 - clip(high)))).alias("high_nll"),
        F.count_if(y == 2).alias("high_support"), F.count_if(sure).alias("sure"), F.count_if(sure & (y == 2)).alias("sure_right"))
    total = _sets(fine, sets, keys).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in fine.columns if c not in keys])
    n = F.col("n")
    record = total.select(
        *keys, "n", (F.col("right") / n).alias("accuracy"), (F.col("brier") / n).alias("brier"), (F.col("nll") / n).alias("nll"),
        (F.col("high_brier") / n).alias("high_brier"), (F.col("high_nll") / n).alias("high_nll"), "high_support",
        F.col("sure").alias("high_confidence_predictions"), F.try_divide("sure_right", "sure").alias("high_confidence_precision"))
    for out, conf, hit in (("ece", top, F.col("pred") == y), ("high_ece", high, y == 2)):
        ece = expected_error(reliability_bins(known, keys, sets, conf, hit, bins), keys, out)
        record = _null_safe_join(record, ece, keys, [out])
    return Checked(record, violation(known, "unnormalized_probability", ~is_normalized(p), F.col("pixel")))


def _null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Join of two small per-group tables whose rolled-up keys are NULL."""
    right = b.select(*[F.coalesce(F.col(k), F.lit("\x00")).alias(f"_{k}") for k in keys], *cols)
    left = a.withColumns({f"_{k}": F.coalesce(F.col(k), F.lit("\x00")) for k in keys})
    return left.join(right, [f"_{k}" for k in keys]).drop(*[f"_{k}" for k in keys])


def confidence_quantiles(rows: DataFrame, keys: list[str], probs=QUANTILES) -> DataFrame:
    known = rows.where(F.col("y").isNotNull()).withColumn("_c", F.array_max("prob"))
    return exact_quantiles(known, keys, "_c", probs)


def ranking_curves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """ROC-AUC and average precision per class, one against the rest.

    Scores are folded into (score, positives, negatives) first; with running totals in
    descending score order both areas are plain sums over the folded rows.
    """
    known = rows.where(F.col("y").isNotNull())
    score = F.col("p")
    long = known.select(*keys, "y", F.posexplode("prob").alias("class", "p"))
    folded = long.groupBy(*keys, "class", score.alias("score")).agg(
        F.count_if(F.col("y") == F.col("class")).alias("pos"), F.count_if(F.col("y") != F.col("class")).alias("neg"))
    ranked = running_totals(folded, [*keys, "class"], ["score"], {"tp": F.col("pos"), "fp": F.col("neg")},
                            share_bucket(F.col("score")), {"tp": "P", "fp": "N"}, descending=True)
    pos, tp = F.col("pos").cast("double"), F.col("tp").cast("double")
    return ranked.groupBy(*keys, "class").agg(
        F.max("P").alias("support"), F.sum(F.col("neg") * (tp - pos / 2)).alias("_area"), F.max("N").alias("_n"),
        F.sum(pos * F.try_divide(tp, tp + F.col("fp"))).alias("_ap")).select(
        *keys, "class", "support", F.try_divide(F.col("_area"), F.col("support") * F.col("_n").cast("double")).alias("roc_auc"),
        F.try_divide("_ap", "support").alias("average_precision"))


def high_probability_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """P(High) by true class: mean, quantiles and share predicted High."""
    known = rows.where(F.col("y").isNotNull()).withColumn("_p", F.col("prob")[2])
    q = exact_quantiles(known, [*keys, "y"], "_p", {"q10": 0.1, "median": 0.5, "q90": 0.9})
    m = known.groupBy(*keys, "y").agg(F.avg("_p").alias("mean_high"), F.avg((F.col("pred") == 2).cast("double")).alias("share_predicted_high"))
    return q.join(m, [*keys, "y"])


def fit_temperature(rows: DataFrame, keys: list[str], bounds: tuple[float, float] = (0.05, 20.0), points: int = 17,
                    passes: int = 4) -> DataFrame:
    """Temperature with the smallest mean NLL per key: a few aggregates over log-spaced grids.

    Every pass evaluates the whole grid in one scan and narrows it around the best point of each
    key; T = 1 and both bounds always compete, and the smaller (loss, T) wins.
    """
    z, y = F.col("logits"), F.col("y")
    top = F.array_max(z)
    base = rows.where(y.isNotNull()).select(
        *keys, *[(z[i] - top).alias(f"_d{i}") for i in range(3)], (top - F.element_at(z, y + 1)).alias("_gap"))

    def nll(t: Column) -> Column:
        spread = F.exp(F.col("_d0") / t) + F.exp(F.col("_d1") / t) + F.exp(F.col("_d2") / t)
        return F.col("_gap") / t + F.log(spread)

    lo, hi = math.log(bounds[0]), math.log(bounds[1])
    fixed = [1.0, bounds[0], bounds[1]]
    best: DataFrame | None = None
    state = base.select(*keys).distinct().withColumns({"_lo": F.lit(lo), "_hi": F.lit(hi)})
    for _ in range(passes):
        step = (F.col("_hi") - F.col("_lo")) / (points - 1)
        joined = base.join(F.broadcast(state), keys)  # one row per model
        aggs = [F.struct(F.avg(nll(F.lit(t))).alias("loss"), F.lit(t).alias("t")) for t in fixed]
        grid = [F.struct(F.avg(nll(F.exp(F.col("_lo") + step * i))).alias("loss"), F.exp(F.first("_lo") + F.first(step) * i).alias("t"))
                for i in range(points)]
        scored = joined.groupBy(*keys).agg(F.array(*aggs, *grid).alias("all"), F.first(step).alias("_step"))
        picked = scored.select(*keys, "_step", F.array_min("all").alias("best"), F.col("all")[0]["loss"].alias("loss_before"))
        best = rows.sparkSession.createDataFrame(picked.collect(), picked.schema)  # one row per model
        state = best.select(*keys, F.greatest(F.lit(lo), F.log("best.t") - F.col("_step")).alias("_lo"),
                            F.least(F.lit(hi), F.log("best.t") + F.col("_step")).alias("_hi"))
    t = F.col("best.t")
    at_bound = (F.abs(t - bounds[0]) <= 1e-5 * bounds[0]) | (F.abs(t - bounds[1]) <= 1e-5 * bounds[1])
    return best.select(*keys, t.alias("temperature"), F.col("loss_before").alias("nll_before"),
                       F.col("best.loss").alias("nll_after"), at_bound.alias("at_bound"))


def masked_losses(rows: DataFrame, keys: list[str], kinds: dict[str, dict]) -> DataFrame:
    """Mean cross entropies of the valid pixels, 0 without any, from one aggregate.

    ``kinds`` maps an out name to ``weights`` (one per class) and ``gamma`` (focal), both optional.
    """
    y, plain = F.col("y"), F.col("_plain")

    def mean(weights: tuple[float, float, float] | None = None, gamma: float | None = None) -> Column:
        loss = plain if gamma is None else focal(plain, gamma)
        w = F.when(y.isNotNull(), F.element_at(F.array(*[F.lit(float(v)) for v in weights]), y + 1) if weights else F.lit(1.0))
        return F.coalesce(F.try_divide(F.sum(loss * w), F.greatest(F.sum(w), F.lit(1e-12))), F.lit(0.0))

    return rows.withColumn("_plain", cross_entropy(F.col("logits"), y)).groupBy(*keys).agg(*[mean(**kind).alias(name) for name, kind in kinds.items()])


def masked_loss(rows: DataFrame, keys: list[str], weights: tuple[float, float, float] | None = None, gamma: float | None = None) -> DataFrame:
    """Mean cross entropy of the valid pixels, optionally focal and class-weighted; 0 without any."""
    return masked_losses(rows, keys, {"loss": {"weights": weights, "gamma": gamma}})
