"""Pixel models: exact threshold rules, and Spark ML fits on the feature table."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probability import argmax, softmax
from ..functions.spectral import BANDS, FEATURES, INDEX_NAMES, SCALE, with_indices
from ..session import cut_lineage
from .ranking import exact_quantiles

# Settings of the two classifiers.
LOGISTIC_ITERATIONS, FOREST_TREES, FOREST_DEPTH, FOREST_LEAF, MODEL_SEED = 400, 64, 12, 2, 42
CANDIDATE_QUANTILES = {f"q{10 * i}": i / 10 for i in range(11)}


def training_normalization(rows: DataFrame) -> DataFrame:
    """Mean and floored standard deviation of every band's reflectance in one pass (one row per band)."""
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[s for b in BANDS for s in (
        F.sum(F.col(b) / SCALE).alias(f"{b}_s"), F.sum((F.col(b) / SCALE) * (F.col(b) / SCALE)).alias(f"{b}_q"))])
    cells = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"{b}_s").alias("s"), F.col(f"{b}_q").alias("q")) for b in BANDS])
    mean = F.col("c.s") / F.col("n")
    return sums.select("n", F.explode(cells).alias("c")).select(
        "c.band", mean.alias("mean"),
        F.greatest(F.sqrt(F.greatest(F.col("c.q") / F.col("n") - mean * mean, F.lit(0.0))), F.lit(1e-6)).alias("std"))


def standardize(rows: DataFrame, norm: DataFrame) -> DataFrame:
    """Bands as (reflectance - mean) / std with the given parameters (12 rows, broadcast)."""
    params = norm.groupBy().pivot("band", list(BANDS)).agg(F.first("mean").alias("m"), F.first("std").alias("s"))
    wide = rows.join(F.broadcast(params))
    return wide.withColumns({b: (F.col(b) / SCALE - F.col(f"{b}_m")) / F.col(f"{b}_s") for b in BANDS}).drop(
        *[f"{b}_{k}" for b in BANDS for k in ("m", "s")])


def fit_thresholds(rows: DataFrame, label: str = "y", indices=INDEX_NAMES) -> DataFrame:
    """Best two-threshold rule of every spectral index by fixed-three macro F1.

    Undefined values take the median of the defined ones; thresholds come from the unique
    deciles. All rules are scored from one (bucket, class) histogram of at most 12 x 3 counts
    per index; the first best rule in (lower, upper, direction) order wins.
    """
    long = with_indices(rows).select(label, *indices).unpivot([label], list(indices), "feature", "value")
    median = exact_quantiles(long, ["feature"], "value", {"median": 0.5}).select("feature", "median")
    filled = long.join(F.broadcast(median), "feature", "left").select(
        "feature", label, F.coalesce("value", "median", F.lit(0.0)).alias("value"), F.coalesce("median", F.lit(0.0)).alias("imputation"))
    deciles = exact_quantiles(filled, ["feature"], "value", CANDIDATE_QUANTILES).select(
        "feature", F.array_distinct(F.array(*CANDIDATE_QUANTILES)).alias("candidates"))
    placed = filled.join(F.broadcast(deciles), "feature")
    bucket = F.size(F.filter("candidates", lambda c: c <= F.col("value")))
    hist = placed.groupBy("feature", "imputation", "candidates", bucket.alias("bucket"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.flatten(F.transform(F.sequence(F.lit(0), F.size("candidates") - 1), lambda i: F.flatten(F.transform(
        F.sequence(i, F.size("candidates") - 1), lambda j: F.array(
            F.struct(i.alias("i"), j.alias("j"), F.lit(1).alias("direction")), F.struct(i.alias("i"), j.alias("j"), F.lit(-1).alias("direction")))))))
    scored = hist.withColumn("r", F.explode(rules))
    up = (F.col("bucket") > F.col("r.i")).cast("int") + (F.col("bucket") > F.col("r.j")).cast("int")
    pred = F.when(F.col("r.direction") == 1, up).otherwise(2 - up)
    cells = scored.withColumn("pred", pred).groupBy("feature", "imputation", "candidates", "r").agg(
        *[F.sum(F.when((F.col("y") == k) & (F.col("pred") == k), F.col("n")).otherwise(0)).alias(f"t{k}") for k in range(3)],
        *[(F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)) + F.sum(F.when(F.col("pred") == k, F.col("n")).otherwise(0))).alias(f"d{k}") for k in range(3)])
    f1 = [F.coalesce(F.try_divide(2 * F.col(f"t{k}"), F.col(f"d{k}")), F.lit(0.0)) for k in range(3)]
    ranked = cells.withColumn("score", (f1[0] + f1[1] + f1[2]) / 3)
    order = F.struct((-F.col("score")).alias("s"), F.col("r.i").alias("i"), F.col("r.j").alias("j"), (-F.col("r.direction")).alias("d"))
    best = ranked.groupBy("feature", "imputation", "candidates").agg(F.min(order).alias("b"))
    return best.select("feature", F.get("candidates", F.col("b.i")).alias("lower"), F.get("candidates", F.col("b.j")).alias("upper"),
                       (-F.col("b.d")).alias("direction"), (-F.col("b.s")).alias("training_macro_f1"), "imputation")


def apply_thresholds(rows: DataFrame, rules: DataFrame, keep: list[str], indices=INDEX_NAMES) -> DataFrame:
    """Predicted class of every row under each index's fitted rule (five rows, broadcast)."""
    long = with_indices(rows).select(*keep, *indices).unpivot(keep, list(indices), "feature", "value")
    v = F.coalesce("value", "imputation")
    p = (v >= F.col("lower")).cast("int") + (v >= F.col("upper")).cast("int")
    return long.join(F.broadcast(rules), "feature").select(
        *keep, "feature", F.when(F.col("direction") == -1, 2 - p).otherwise(p).alias("pred"), F.col("value").isNull().alias("undefined"))


def logistic(features=FEATURES, label: str = "y", weight: str | None = None, rows: int | None = None, iterations: int = LOGISTIC_ITERATIONS) -> Pipeline:
    """Standardised multinomial regression with unit inverse regularisation (penalty 1/rows)."""
    lr = LogisticRegression(featuresCol="scaled", labelCol=label, maxIter=iterations, family="multinomial",
                            regParam=1.0 / rows if rows else 0.0, standardization=False, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"),
                            StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), lr])


def forest(features=FEATURES, label: str = "y", weight: str | None = None, trees: int = FOREST_TREES) -> Pipeline:
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=FOREST_DEPTH, minInstancesPerNode=FOREST_LEAF,
                                seed=MODEL_SEED, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred", cacheNodeIds=True)
    if weight:
        rf = rf.setWeightCol(weight)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), rf])


def dealt_once(rows: DataFrame) -> DataFrame:
    """``rows`` made once, in no more partitions than the session has cores.

    Each step of a fit is a job whose every task reports to the driver, so what the driver gets follows the partitions times
    the steps (at most the iterations, or levels); this way it does not grow with the table.
    """
    return cut_lineage(rows).coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def score(model, rows: DataFrame) -> DataFrame:
    """Probabilities as an array and the class with the largest one (lowest class on a tie)."""
    out = model.transform(rows).withColumn("prob", vector_to_array("_prob"))
    return out.withColumn("pred", argmax(F.col("prob"))).drop("_prob", "_raw", "_pred", "features", "scaled")


def linear_scores(rows: DataFrame, weights: dict[str, tuple[float, ...]], intercepts: tuple[float, ...]) -> DataFrame:
    """Probabilities and class of a multinomial linear model given as a coefficient table (feature -> weight of each class)."""
    logits = F.array(*[sum((F.col(f) * float(w[k]) for f, w in weights.items()), F.lit(float(b))) for k, b in enumerate(intercepts)])
    return rows.withColumn("prob", softmax(logits)).withColumn("pred", argmax(F.col("prob")))


def gradient(model, rows: DataFrame, label: str = "y") -> DataFrame:
    """Gradient of the fitted regression's penalised objective: ``class, feature, gradient`` (zero at the optimum)."""
    lr, names = model.stages[-1], model.stages[0].getInputCols()
    penalty, w = lr.getRegParam(), lr.coefficientMatrix.toArray()
    scored = model.transform(rows).select(F.col(label).alias("y"), vector_to_array("scaled").alias("x"), vector_to_array("_prob").alias("p"))
    gaps = [F.col("p")[k] - (F.col("y") == k).cast("double") for k in range(len(w))]
    means = scored.agg(*[F.avg(g * F.col("x")[i]).alias(f"g{k}_{i}") for k, g in enumerate(gaps) for i in range(len(names))])
    cells = [F.struct(F.lit(k).alias("class"), F.lit(f).alias("feature"), (F.col(f"g{k}_{i}") + penalty * float(w[k][i])).alias("gradient"))
             for k in range(len(w)) for i, f in enumerate(names)]
    return means.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def leaf_places(model, rows: DataFrame, label: str = "y") -> DataFrame:
    """``y, tree, leaf`` of every row in every tree of a fitted forest."""
    model.stages[-1].setLeafCol("_leaf")
    return model.transform(rows).select(F.col(label).alias("y"), F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))


def leaf_composition(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class fractions of every tree leaf over placed rows (``y, tree, leaf``), and per-tree totals."""
    leaves = placed.groupBy("tree", F.col("leaf").cast("int").alias("leaf")).agg(
        F.count(F.lit(1)).alias("rows"), *[F.avg((F.col("y") == k).cast("double")).alias(f"{c}_fraction") for k, c in enumerate(("low", "moderate", "high"))],
        F.count_if(F.col("y") == 2).alias("high_rows"))
    majority = (F.col("high_fraction") > F.col("low_fraction")) & (F.col("high_fraction") > F.col("moderate_fraction"))
    leaves = leaves.withColumn("high_majority", majority)
    trees = leaves.groupBy("tree").agg(
        F.count(F.lit(1)).alias("leaves"), F.count_if("high_majority").alias("high_majority_leaves"),
        F.count_if(F.col("high_rows") > 0).alias("leaves_with_high"), F.max("high_fraction").alias("max_high_fraction"),
        F.sum(F.when(F.col("high_majority"), F.col("high_rows")).otherwise(0)).alias("high_rows_in_high_majority"))
    return leaves, trees


def with_class_weights(rows: DataFrame, label: str, weights: DataFrame) -> DataFrame:
    """Attach the inverse-frequency weight of each row's class (three rows, broadcast)."""
    return rows.join(F.broadcast(weights.select(label, "weight")), label)


