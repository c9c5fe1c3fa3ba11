"""Newton regression against Spark ML, histogram forests against plain loops, and vectors that cannot be compared."""

import math

import numpy as np
import pytest
from patchwell.operators import fits, models, ranking, shift
from pyspark.sql import functions as F

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3)) * [1, 5, 0] + [0, 2, 7]
    y = np.clip(np.round(x[:, 0] + 0.2 * x[:, 1] + rng.normal(size=600)), 0, 2).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i]), float(1 + i % 3)) for i in range(600)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, w double").repartition(5)


@pytest.mark.parametrize("weight", [None, "w"])
def test_newton_is_the_optimum_that_spark_ml_finds(points, weight):
    model = fits.newton_regression(points, NAMES, weight=weight, steps=8)
    other = models.logistic(NAMES, weight=weight, rows=points.count()).fit(points).stages[-1]
    assert np.allclose(model.weights[:, :-1], other.coefficientMatrix.toArray(), atol=2e-3)
    assert np.allclose(model.weights[:, -1] - model.weights[:, -1].mean(), np.array(other.interceptVector) - np.mean(other.interceptVector), atol=2e-3)
    assert np.allclose(model.weights[:, 2], 0)  # a constant feature
    scored = model.score(points).toPandas()
    z = (scored[NAMES].to_numpy() - model.mean) * model.scale @ model.weights[:, :-1].T + model.weights[:, -1]
    assert (scored["pred"].to_numpy() == z.argmax(1)).all()
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    assert np.allclose(np.stack(scored["prob"]), p)


def test_rows_that_cannot_be_used_take_no_part(spark, points):
    odd = spark.createDataFrame([(900, None, 1.0, 1.0, 1, 1.0), (901, 1.0, 1.0, 1.0, None, 1.0), (902, 1.0, 1.0, 1.0, 7, 1.0)], points.schema)
    a, b = (fits.newton_regression(p, NAMES, steps=3) for p in (points, points.unionByName(odd)))
    assert np.allclose(a.weights, b.weights)
    fa, fb = (fits.histogram_forest(p, "id", NAMES, trees=2, depth=2) for p in (points, points.unionByName(odd)))
    assert fa.splits() == fb.splits() and fa.leaf_rows() == fb.leaf_rows()
    none = points.where("false")
    assert not fits.newton_regression(none, NAMES).weights.any()
    empty = fits.histogram_forest(none, "id", NAMES, trees=2, depth=2)
    assert empty.splits() == empty.leaf_rows() == [] and set(empty.score(points).select("pred").distinct().toPandas()["pred"]) == {0}


def plain_tree(rows, tree, depth, bins, leaf, share, low, high):
    """One tree by loops: {node: (feature, bin)} and {leaf: counts}."""
    splits, leaves = {}, {}
    count = lambda key: sum(fits.token(42, tree, key) >= int(2 ** 32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8))
    held = [(x, y, w * count(key)) for key, x, y, w in rows if count(key)]
    cell = lambda v, f: 0 if high[f] == low[f] else min(bins - 1, max(0, math.floor((v - low[f]) / (high[f] - low[f]) * bins)))

    def sums(part):
        return [sum(n for _, y, n in part if y == k) for k in range(3)]

    def grow(part, node, level):
        total, best = sums(part), None
        if level < depth and sum(total):
            for f in range(len(low)):
                if fits.token(42, tree, node, f) % 100 >= share:
                    continue
                for b in sorted({cell(x[f], f) for x, _, _ in part}):
                    left = sums([r for r in part if cell(r[0][f], f) <= b])
                    right = [t - v for t, v in zip(total, left, strict=True)]
                    if sum(left) >= leaf and sum(right) >= leaf:
                        purity = sum(v * v for v in left) / sum(left) + sum(v * v for v in right) / sum(right)
                        if purity > sum(v * v for v in total) / sum(total) + 1e-6 and (best is None or (-round(purity, 6), f, b) < best):
                            best = (-round(purity, 6), f, b)
        if best is None:
            leaves[node] = total
            return
        splits[node] = best[1:]
        grow([r for r in part if cell(r[0][best[1]], best[1]) <= best[2]], 2 * node, level + 1)
        grow([r for r in part if cell(r[0][best[1]], best[1]) > best[2]], 2 * node + 1, level + 1)

    grow(held, 1, 0)
    return splits, leaves


@pytest.mark.parametrize("cells", [4_000_000, 1])
def test_forest_is_plain_trees(points, cells):
    forest = fits.histogram_forest(points, "id", NAMES, weight="w", trees=3, depth=3, bins=8, leaf=5, share=70, cells_at_once=cells)
    rows = [(r["id"], (r["a"], r["b"], r["c"]), r["y"], r["w"]) for r in points.collect()]
    low, high = [[f(r[1][i] for r in rows) for i in range(3)] for f in (min, max)]
    for t in range(3):
        splits, leaves = plain_tree(rows, t, 3, 8, 5, 70, low, high)
        assert {n: (NAMES.index(f), b) for tree, n, f, b in forest.splits() if tree == t} == splits
        assert {n: list(c) for tree, n, *c in forest.leaf_rows() if tree == t} == leaves
    good = forest.score(points).where("pred = y").count()
    assert good > 0.6 * points.count()


def test_ordered_rank_is_the_sorted_place(spark):
    rng = np.random.default_rng(2)
    data = [(None if v == 0 else int(v), str(w)) for v, w in rng.integers(0, 6, (500, 2))]
    df = spark.createDataFrame(data, "v long, s string").repartition(7)
    got = sorted((r["rank"], r["v"], r["s"]) for r in ranking.ordered_rank(df, ["v", "s"]).fillna(-1).collect())
    want = sorted((-1 if v is None else v, s) for v, s in data)
    assert got == [(i, *w) for i, w in enumerate(want)]
    assert ranking.ordered_rank(df.where("false"), ["v"]).count() == 0


def test_vectors_that_cannot_be_compared_get_null(spark):
    rows = [(1, "test", [1.0, None]), (2, "test", [1.0, 2.0]), (3, "test", [float("nan"), 1.0]), (4, "test", None), (5, "test", [1.0, 2.0, 3.0]), (6, "test", [float("inf"), 1.0]),
            (7, "test", []), (8, "train", [1.0, 2.5]), (9, "train", [None, 2.5]), (10, "train", [900.0, 1e6])]
    df = spark.createDataFrame(rows, "id int, split string, vec array<double>")
    got = {r["id"]: (r["nearest_distance"], r["exposed"]) for r in shift.appearance_exposure(df, "id", "vec").collect()}
    assert got == {2: (0.25, False), **{i: (None, False) for i in (1, 3, 4, 5, 6, 7)}}
    assert shift.appearance_exposure(df.where(F.col("split") == "test"), "id", "vec").where("nearest_distance is not null").count() == 0


def test_fits_take_rows_dealt_once(spark, monkeypatch):
    """What a fit repeats over is made beforehand, in no more partitions than cores, so its reports do not grow with the table."""
    from patchwell.operators import models
    from patchwell.plans import models as plans
    seen = []

    class Fit:
        def fit(self, train):
            seen.append(train)

    monkeypatch.setattr(models, "logistic", lambda *a, **k: Fit())
    rows = spark.range(0, 1000, 1, 40).selectExpr("id as x", "id % 3 as y", "id % 2 as other", "1.5 as w").repartition(30, "x")
    plans._fit("logistic", rows, ["x"], weight="w")
    assert seen[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and seen[0].columns == ["x", "y", "w"]
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString() and seen[0].agg({"x": "sum"}).first()[0] == 499500
