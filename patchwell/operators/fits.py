"""Fits whose every step is one aggregate: Newton's method for multinomial regression, histogram trees for forests.

Both read a narrow table that is written once. A pass adds up small arrays in each task with numpy and Spark sums these;
only sums whose size the model gives (features, classes, nodes, bins) reach the driver, never rows. Draws are hashes of
(seed, tree, key), so a fit is the same for any partitioning and can be repeated in SQL.

Rows with a null feature, a null weight or a label other than 0, 1, 2 take no part. Without rows the regression has
coefficients of zero and each tree is one leaf without rows; both then give every class the same probability.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .models import linear_scores

CLASSES = 3
INTERCEPT = "intercept"
EASE = 1e-6  # ridge of the intercepts, which softmax leaves open by a constant
#: Bootstrap counts: how many of the first Poisson(1) cumulative shares, on 32 bits, a hash reaches.
POISSON = [int(2 ** 32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray  # 1 / standard deviation; 0 for a constant feature
    weights: np.ndarray  # (classes, features + 1) on standardised features, the intercept last

    def rows(self) -> list[tuple[int, str, float]]:
        return [(k, f, float(w)) for k, row in enumerate(self.weights) for f, w in zip((*self.features, INTERCEPT), row, strict=True)]

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prob`` and ``pred``, as column expressions."""
        raw = self.weights[:, :-1] * self.scale
        start = self.weights[:, -1] - raw @ self.mean
        return linear_scores(rows, {f: tuple(raw[:, i]) for i, f in enumerate(self.features)}, tuple(start))


def _usable(rows: DataFrame, features, label: str, weight: str | None, key: str | None = None) -> DataFrame:
    """(key, f0.., y, w) of the rows that take part, written once."""
    cols = [F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    narrow = rows.select(*([F.col(key).cast("string").alias("key")] if key else []), *cols, F.col(label).cast("int").alias("y"),
                         (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    return cut_lineage(narrow.where(F.col("y").isin(0, 1, 2)).dropna())


def newton_regression(rows: DataFrame, features, label: str = "y", weight: str | None = None, penalty: float | None = None, steps: int = 6) -> LinearModel:
    """Multinomial regression on standardised features: mean weighted loss plus ``penalty`` / 2 times the squared weights (1 / rows by default).

    A step takes one pass: gradient and full Hessian, (3 x (features + 1)) squared sums whatever the number of rows.
    """
    features = tuple(features)
    d, used = len(features), _usable(rows, features, label, weight)
    cols = [f"f{i}" for i in range(d)]
    stats = used.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), *[F.avg(c).alias(f"m_{c}") for c in cols],
                     *[F.stddev_samp(c).alias(f"s_{c}") for c in cols]).first()
    mean = np.array([stats[f"m_{c}"] or 0.0 for c in cols])
    std = np.array([stats[f"s_{c}"] or 0.0 for c in cols])
    scale = np.where(std > 0, 1 / np.where(std > 0, std, 1), 0.0)
    size = CLASSES * (d + 1)
    at = np.zeros((CLASSES, d + 1))
    if not stats["n"] or not stats["w"]:
        return LinearModel(features, mean, scale, at)
    penalty = 1.0 / stats["n"] if penalty is None else penalty
    ridge = np.tile(np.r_[np.full(d, penalty), EASE], CLASSES)
    for _ in range(steps):
        def sums(frames: Iterator[pd.DataFrame], at=at) -> Iterator[pd.DataFrame]:
            hessian, gradient = np.zeros((CLASSES, d + 1, CLASSES, d + 1)), np.zeros((CLASSES, d + 1))
            for f in frames:
                x = np.c_[(f[cols].to_numpy(float) - mean) * scale, np.ones(len(f))]
                y, w, z = f["y"].to_numpy(), f["w"].to_numpy(), x @ at.T
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                gradient += ((p - np.eye(CLASSES)[y]) * w[:, None]).T @ x
                for k in range(CLASSES):
                    for j in range(k, CLASSES):
                        part = (x * (w * p[:, k] * ((k == j) - p[:, j]))[:, None]).T @ x
                        hessian[k, :, j] += part
                        if j > k:
                            hessian[j, :, k] += part
            yield pd.DataFrame({"cell": np.arange(size * size + size), "value": np.r_[hessian.ravel(), gradient.ravel()]})

        cells = used.mapInPandas(sums, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(size * size + size)
        for r in cells:
            total[r["cell"]] = r["value"] / stats["w"]
        hessian, gradient = total[:size * size].reshape(size, size), total[size * size:]
        at = at - np.linalg.solve(hessian + np.diag(ridge), gradient + ridge * at.ravel()).reshape(CLASSES, d + 1)
    return LinearModel(features, mean, scale, at)


def token(*parts) -> int:
    """The first 32 bits of the hash of the parts, joined by colons."""
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@dataclass(frozen=True)
class Forest:
    """Trees in heap order (children of n are 2 n and 2 n + 1): per tree the split feature (-1 for a leaf) and bin of each node, and leaf fractions."""

    features: tuple[str, ...]
    low: np.ndarray
    high: np.ndarray
    bins: int
    feature: np.ndarray  # (trees, nodes)
    bin: np.ndarray
    fractions: np.ndarray  # (trees, nodes, classes)
    counts: np.ndarray  # (trees, nodes, classes): weighted in-bag rows of each leaf

    def binned(self, values: np.ndarray) -> np.ndarray:
        return binned(values, self.low, self.high, self.bins)

    def leaves(self, cells: np.ndarray, tree: int) -> np.ndarray:
        return routed(cells, self.feature[tree], self.bin[tree])

    def splits(self) -> list[tuple[int, int, str, int]]:
        return [(t, n, self.features[self.feature[t, n]], int(self.bin[t, n])) for t, n in zip(*np.nonzero(self.feature >= 0), strict=True)]

    def leaf_rows(self) -> list[tuple[int, int, float, float, float]]:
        return [(int(t), int(n), *map(float, self.counts[t, n])) for t, n in zip(*np.nonzero(self.counts.sum(2) > 0), strict=True)]

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``prob`` (mean of the trees' leaf fractions) and ``pred`` (lowest class on a tie)."""
        names, model = list(self.features), self

        @F.pandas_udf("array<double>")
        def mean(*columns: pd.Series) -> pd.Series:
            cells = model.binned(np.stack([c.to_numpy(float) for c in columns], 1))
            return pd.Series(list(sum(model.fractions[t, model.leaves(cells, t)] for t in range(len(model.feature))) / len(model.feature)))

        scored = rows.withColumn("prob", mean(*[F.col(f).cast("double") for f in names]))
        p = F.transform("prob", lambda v: F.round(v, 9))
        return scored.withColumn("pred", (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def binned(values: np.ndarray, low: np.ndarray, high: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each value in ``bins`` even steps of the training range; null and constant features are in the first one."""
    width = high - low
    with np.errstate(invalid="ignore"):
        at = np.floor((values - low) / np.where(width > 0, width, 1.0) * bins)
    return np.clip(np.nan_to_num(at), 0, bins - 1).astype(np.uint8)


def routed(cells: np.ndarray, feature: np.ndarray, split: np.ndarray, levels: int = 64) -> np.ndarray:
    """The node that each row ends in, after at most ``levels`` splits."""
    node, rows = np.ones(len(cells), np.int64), np.arange(len(cells))
    for _ in range(levels):
        f = feature[node]
        going = f >= 0
        if not going.any():
            break
        node = np.where(going, 2 * node + (cells[rows, np.maximum(f, 0)] > split[node]), node)
    return node


def histogram_forest(rows: DataFrame, key: str, features, label: str = "y", weight: str | None = None, trees: int = 64, depth: int = 8, bins: int = 32,
                     leaf: int = 2, share: int = 40, seed: int = 42, cells_at_once: int = 4_000_000) -> Forest:
    """Random forest, level by level. Each tree draws its rows (Poisson counts) and each node its features (``share`` percent) by hash.

    A level takes one pass for as many trees as ``cells_at_once`` sums allow: class counts by (tree, node, feature, bin).
    Windows over the bins give the purity of every split; the best (largest, then first feature, then first bin) of each
    node reaches the driver.
    """
    features = tuple(features)
    d, used = len(features), _usable(rows, features, label, weight, key)
    cols = [f"f{i}" for i in range(d)]
    ends = used.agg(*[g(c) for c in cols for g in (F.min, F.max)]).first()
    low, high = (np.array([0.0 if v is None else v for v in ends[i::2]], float) for i in (0, 1))

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = np.array(POISSON)
        for f in frames:
            draws = np.array([[token(seed, t, k) for t in range(trees)] for k in f["key"]], np.int64).reshape(len(f), trees)
            counts = (draws[:, :, None] >= steps).sum(2).astype(np.uint8)
            cells = binned(f[cols].to_numpy(float), low, high, bins)
            yield pd.DataFrame({"cells": [c.tobytes() for c in cells], "counts": [c.tobytes() for c in counts], "y": f["y"], "w": f["w"]})

    ready = cut_lineage(used.mapInPandas(prepare, "cells binary, counts binary, y int, w double"))
    feature, split = np.full((trees, 1 << depth + 1), -1), np.zeros((trees, 1 << depth + 1), int)

    def arrays(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cells = np.frombuffer(b"".join(f["cells"]), np.uint8).reshape(len(f), d)
        return cells, np.frombuffer(b"".join(f["counts"]), np.uint8).reshape(len(f), trees), f["y"].to_numpy(np.int64), f["w"].to_numpy()

    for level in range(depth):
        first, best = 1 << level, []
        wide = first * d * bins * CLASSES
        for start in range(0, trees, group := max(1, min(trees, cells_at_once // wide))):
            some = range(start, min(trees, start + group))

            def count(frames: Iterator[pd.DataFrame], some=some, first=first, wide=wide, level=level) -> Iterator[pd.DataFrame]:
                total = np.zeros((len(some), wide))
                for f in frames:
                    cells, counts, y, w = arrays(f)
                    for i, t in enumerate(some):
                        node = routed(cells, feature[t], split[t], level)
                        inside = np.flatnonzero((node >= first) & (counts[:, t] > 0))
                        base = (node[inside] - first) * d
                        for j in range(d):
                            at = ((base + j) * bins + cells[inside, j]) * CLASSES + y[inside]
                            total[i] += np.bincount(at, w[inside] * counts[inside, t], wide)
                tree, at = np.nonzero(total)
                yield pd.DataFrame({"tree": tree + some.start, "node": at // (d * bins * CLASSES) + first, "feature": at // (bins * CLASSES) % d,
                                    "bin": at // CLASSES % bins, "y": at % CLASSES, "n": total[tree, at]})

            cells = ready.mapInPandas(count, "tree int, node int, feature int, bin int, y int, n double")
            drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "tree", "node", "feature"), 256), 1, 8), 16, 10).cast("long") % 100 < share
            best += best_splits(cells.where(drawn), leaf).collect()
        if not best:
            break
        for r in best:
            feature[r["tree"], r["node"]], split[r["tree"], r["node"]] = r["feature"], r["bin"]

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((trees, feature.shape[1] * CLASSES))
        for f in frames:
            cells, counts, y, w = arrays(f)
            for t in range(trees):
                total[t] += np.bincount(routed(cells, feature[t], split[t]) * CLASSES + y, w * counts[:, t], total.shape[1])
        tree, at = np.nonzero(total)
        yield pd.DataFrame({"tree": tree, "node": at // CLASSES, "y": at % CLASSES, "n": total[tree, at]})

    counts = np.zeros((*feature.shape, CLASSES))
    for r in ready.mapInPandas(compose, "tree int, node int, y int, n double").groupBy("tree", "node", "y").agg(F.sum("n").alias("n")).collect():
        counts[r["tree"], r["node"], r["y"]] = r["n"]
    total = counts.sum(2, keepdims=True)
    return Forest(features, low, high, bins, feature, split, np.where(total > 0, counts / np.where(total > 0, total, 1), 1 / CLASSES), counts)


def best_splits(cells: DataFrame, leaf: int) -> DataFrame:
    """(tree, node, feature, bin) of the purest split of each node from ``tree, node, feature, bin, y, n``; rows up to ``bin`` go left."""
    from pyspark.sql import Window

    per_bin = cells.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0.0)).alias(f"n{k}") for k in range(CLASSES)])
    whole = Window.partitionBy("tree", "node", "feature")
    upto = whole.orderBy("bin")
    sides = per_bin.select("tree", "node", "feature", "bin", *[F.sum(f"n{k}").over(upto).alias(f"l{k}") for k in range(CLASSES)],
                           *[F.sum(f"n{k}").over(whole).alias(f"t{k}") for k in range(CLASSES)])

    def purity(of) -> tuple:
        n = of[0] + of[1] + of[2]
        return n, F.try_divide(of[0] * of[0] + of[1] * of[1] + of[2] * of[2], n)

    (nl, left), (nr, right) = purity([F.col(f"l{k}") for k in range(CLASSES)]), purity([F.col(f"t{k}") - F.col(f"l{k}") for k in range(CLASSES)])
    _, parent = purity([F.col(f"t{k}") for k in range(CLASSES)])
    scored = sides.where((nl >= leaf) & (nr >= leaf)).withColumns({"purity": left + right, "parent": parent}).where(F.col("purity") > F.col("parent") + 1e-6)
    order = F.struct((-F.round("purity", 6)).alias("p"), "feature", "bin")
    return scored.groupBy("tree", "node").agg(F.min(order).alias("s")).select("tree", "node", "s.feature", "s.bin")
