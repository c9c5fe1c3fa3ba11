"""Confusion counts and what is derived from them: metrics, rankings, differences, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checks import Checked, violation

CLASSES = ("low", "moderate", "high")
CELLS = [(i, j) for i in range(3) for j in range(3)]


def confusion(predictions: DataFrame, keys: list[str], y: str = "y", pred: str = "pred") -> Checked:
    """Nine counts per key in long form, zeros included; pixels without a reference are ignored."""
    known = predictions.where(F.col(y).isNotNull())
    counted = known.groupBy(*keys, y, pred).agg(F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(i).alias("y"), F.lit(j).alias("pred"),
                               F.sum(F.when((F.col(y) == i) & (F.col(pred) == j), F.col("n")).otherwise(0)).alias("n")) for i, j in CELLS])
    wide = counted.groupBy(*keys).agg(cells.alias("cells"))
    out = wide.select(*keys, F.explode("cells").alias("c")).select(
        *keys, F.col("c.y").alias("true_class"), F.col("c.pred").alias("pred_class"), F.col("c.n").alias("n"))
    bad = ~F.col(y).between(0, 2) | ~F.coalesce(F.col(pred).between(0, 2), F.lit(False))
    return Checked(out, violation(counted, "non_class_value", bad, F.concat_ws("/", y, pred)))


def metrics(matrix: DataFrame, keys: list[str], sets: list[list[str]] | None = None, n: str = "n") -> DataFrame:
    """Every metric of each matrix, for one or several groupings of the long counts.

    Precision is NULL without predictions, recall and F1 are NULL without support; the fixed
    macro mean counts an undefined class as zero.
    """
    cell = {(i, j): F.sum(F.when((F.col("true_class") == i) & (F.col("pred_class") == j), F.col(n)).otherwise(0)).alias(f"n{i}{j}")
            for i, j in CELLS}
    grouped = (matrix.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]) if sets
               else matrix.groupBy(*keys))
    return metrics_from_cells(grouped.agg(*cell.values()), keys)


def metrics_from_cells(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics from the nine columns n00..n22."""
    def c(i, j):
        return F.col(f"n{i}{j}")

    cols: dict[str, Column] = {}
    total = sum((c(i, j) for i, j in CELLS[1:]), c(0, 0))
    zero = F.lit(0.0)
    f1s, seen = [], []
    for k, name in enumerate(CLASSES):
        support = c(k, 0) + c(k, 1) + c(k, 2)
        predicted = c(0, k) + c(1, k) + c(2, k)
        f1 = F.coalesce(F.try_divide(2 * c(k, k), support + predicted), zero)
        cols |= {
            f"{name}_support": support, f"{name}_predicted": predicted,
            f"{name}_precision": F.try_divide(c(k, k), predicted), f"{name}_recall": F.try_divide(c(k, k), support),
            f"{name}_f1": F.when(support > 0, f1), f"{name}_tp": c(k, k), f"{name}_fp": predicted - c(k, k),
            f"{name}_fn": support - c(k, k), f"{name}_true_share": F.try_divide(support, total),
            f"{name}_predicted_share": F.try_divide(predicted, total)}
        f1s.append(f1)
        seen.append(support)
    some = total > 0
    present = sum(((s > 0).cast("int") for s in seen[1:]), (seen[0] > 0).cast("int"))
    supported = sum((F.when(s > 0, f).otherwise(0.0) for s, f in zip(seen[1:], f1s[1:])), F.when(seen[0] > 0, f1s[0]).otherwise(0.0))
    weighted = sum((s * f for s, f in zip(seen[1:], f1s[1:])), seen[0] * f1s[0])
    cols |= {
        "valid_pixels": total, "accuracy": F.try_divide(c(0, 0) + c(1, 1) + c(2, 2), total),
        "macro_f1": F.when(some, (f1s[0] + f1s[1] + f1s[2]) / 3), "macro_f1_supported": F.try_divide(supported, present),
        "weighted_f1": F.try_divide(weighted, total), "all_classes_present": present == 3}
    return wide.select(*keys, *[f"n{i}{j}" for i, j in CELLS], *[v.alias(k) for k, v in cols.items()])


def leave_one_out(matrix: DataFrame, keys: list[str], region: str) -> DataFrame:
    """Metrics of the pooled matrix without each region (the counts are nine per region)."""
    pooled = matrix.groupBy(*keys, "true_class", "pred_class").agg(F.sum("n").alias("_all"))
    rest = matrix.join(pooled, [*keys, "true_class", "pred_class"]).withColumn("rest", F.col("_all") - F.col("n"))
    return metrics(rest, [*keys, region], n="rest").withColumnRenamed(region, "omitted_region")


def pooled_differences(matrix: DataFrame, pooled: DataFrame, keys: list[str]) -> DataFrame:
    """Cells where the regional sums and the pooled counts differ."""
    on = [*keys, "true_class", "pred_class"]
    sums = matrix.groupBy(*on).agg(F.sum("n").alias("region_sum"))
    both = sums.join(pooled.withColumnRenamed("n", "pooled"), on, "full")
    return both.withColumn("differs", ~F.col("region_sum").eqNullSafe(F.col("pooled")))


def metric_deltas(rows: DataFrame, base: DataFrame, on: list[str], names: list[str]) -> DataFrame:
    """Row metrics next to the baseline's with the difference of each."""
    renamed = base.select(*on, *[F.col(n).alias(f"original_{n}") for n in names])
    return rows.join(renamed, on, "left").withColumns({f"delta_{n}": F.col(n) - F.col(f"original_{n}") for n in names})


def rank_models(table: DataFrame, slices: list[str], model: str, subset: Column, low_floor: float = 0.5,
                moderate_floor: float = 0.25) -> DataFrame:
    """Best guarded model overall and inside a subset, per slice, as one aggregate.

    Order: macro F1, then High F1 (NULL as zero), then the smaller id. The subset falls back to
    its own best when none of its models passes the guard.
    """
    key = F.struct((-F.col("macro_f1")).alias("a"), (-F.coalesce("high_f1", F.lit(0.0))).alias("b"), F.col(model).alias("id"))
    ok = (F.coalesce("low_f1", F.lit(0.0)) >= low_floor) & (F.coalesce("moderate_f1", F.lit(0.0)) >= moderate_floor)
    out = table.groupBy(*slices).agg(
        F.min(F.when(ok, key)).alias("_all"), F.min(F.when(ok & subset, key)).alias("_sub"),
        F.min(F.when(subset, key)).alias("_any"), F.sort_array(F.collect_set(F.when(ok, F.col(model)))).alias("eligible"))
    return out.select(*slices, F.col("_all.id").alias("overall"), F.coalesce("_sub.id", "_any.id").alias("subset_best"),
                      F.col("_sub").isNotNull().alias("subset_eligible"), "eligible")


EXAMPLES = ("correct_Low", "correct_Moderate", "correct_High", "High_to_Moderate", "High_to_Low", "false_High", "high_confidence_error")


def pick_examples(predictions: DataFrame, keys: list[str], sample: str, confident: float = 0.8) -> DataFrame:
    """Per group and error category the patch with the highest mean confidence; NULL when none qualifies."""
    y, p, conf = F.col("y"), F.col("pred"), F.array_max("prob")
    rules = dict(zip(EXAMPLES, ((y == 0) & (p == 0), (y == 1) & (p == 1), (y == 2) & (p == 2), (y == 2) & (p == 1),
                                (y == 2) & (p == 0), (y != 2) & (p == 2), (y != p) & (conf >= confident))))
    known = predictions.where(y.isNotNull())
    tagged = known.select(*keys, sample, conf.alias("_conf"), F.explode(F.array_compact(F.array(
        *[F.when(cond, name) for name, cond in rules.items()]))).alias("category"))
    per_patch = tagged.groupBy(*keys, "category", sample).agg(F.count(F.lit(1)).alias("count"), F.avg("_conf").alias("confidence"))
    key = F.struct((-F.round("confidence", 12)).alias("c"), F.col(sample).alias("id"), F.col("count").alias("n"))
    best = per_patch.groupBy(*keys, "category").agg(F.min(key).alias("b"))
    grid = known.select(*keys).distinct().withColumn("category", F.explode(F.array(*[F.lit(e) for e in EXAMPLES])))
    return grid.join(best, [*keys, "category"], "left").select(
        *keys, "category", F.col("b.id").alias(sample), F.col("b.n").alias("count"), (-F.col("b.c")).alias("confidence"))


def error_similarity(predictions: DataFrame, models: list[str], pixel: str = "pixel") -> DataFrame:
    """Agreement and error overlap of every model pair from one row per pixel.

    Predictions are pivoted by the given model names and all pairs are summed in one pass.
    """
    wide = predictions.where(F.col("y").isNotNull()).groupBy(pixel).agg(
        F.max("y").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("pred"))).alias(f"p{i}") for i, m in enumerate(models)])
    aggs = []
    for i in range(len(models)):
        for j in range(i + 1, len(models)):
            a, b, y = F.col(f"p{i}"), F.col(f"p{j}"), F.col("y")
            wrong_a, wrong_b = a != y, b != y
            miss_a, miss_b = (y == 2) & (a != 2), (y == 2) & (b != 2)
            aggs.append(F.struct(
                F.lit(models[i]).alias("left_model"), F.lit(models[j]).alias("right_model"),
                F.avg((a == b).cast("double")).alias("agreement"),
                F.try_divide(F.count_if(wrong_a & wrong_b), F.count_if(wrong_a | wrong_b)).alias("error_jaccard"),
                F.try_divide(F.count_if(miss_a & miss_b), F.count_if(miss_a | miss_b)).alias("high_miss_jaccard")))
    return wide.agg(F.array(*aggs).alias("pairs")).select(F.explode("pairs").alias("p")).select("p.*")


def reproduction_diff(first: DataFrame, second: DataFrame, on: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Classes that differ, rows on one side only and the largest probability gap, per model."""
    a = first.select(*on, F.col("pred").alias("_p1"), F.col("prob").alias("_q1"), F.lit(1).alias("_a"))
    b = second.select(*on, F.col("pred").alias("_p2"), F.col("prob").alias("_q2"), F.lit(1).alias("_b"))
    both = a.join(b, on, "full")
    gaps = F.zip_with("_q1", "_q2", lambda x, y: F.abs(x - y))
    gap = F.array_max(gaps)
    return both.withColumn("_gap", gap).groupBy(*[k for k in on if k == "model"]).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
        F.count_if(F.col("_p1") != F.col("_p2")).alias("class_differences"),
        F.count_if(F.col("_gap") > tolerance).alias("beyond_tolerance"), F.max("_gap").alias("max_difference"))


def extremes(table: DataFrame, keys: list[str], item: str, value: str) -> DataFrame:
    """Items with the smallest and the largest value per group; the smaller item wins a tie."""
    low = F.min(F.struct(F.col(value), F.col(item)))
    high = F.min(F.struct((-F.col(value)).alias("v"), F.col(item)))
    return table.where(F.col(value).isNotNull()).groupBy(*keys).agg(low.alias("_l"), high.alias("_h")).select(
        *keys, F.col(f"_l.{item}").alias("lowest"), F.col(f"_l.{value}").alias("lowest_value"),
        F.col(f"_h.{item}").alias("highest"), (-F.col("_h.v")).alias("highest_value"))


def spearman(table: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; NULL when a side is constant (a group is one model's regions)."""
    w = Window.partitionBy(*keys)

    def mean_rank(c):
        same = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        return F.rank().over(w.orderBy(c)) + (same - 1) / 2.0

    ranked = table.withColumns({"_ra": mean_rank(a), "_rb": mean_rank(b)})
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return ranked.groupBy(*keys).agg(F.when(~constant, F.corr("_ra", "_rb")).alias("spearman"))
