"""Perturbations of reflectance pixels with labels kept, and their effect on the metrics.

All results are clamped to [0, 1.5]; the share of clamped values is reported per patch.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER = 1.5  # fixed value: largest reflectance kept
LEVELS = {  # fixed values: mild and moderate severities
    "brightness": (1.05, 1.15), "contrast": (1.05, 1.15), "noise": (0.002, 0.005),
    "blur": (0.5, 1.0), "resolution": (48, 32), "mask": (0.05, 0.15)}
TRUNCATE = 4.0  # fixed value: blur radius in standard deviations


def clamp(df: DataFrame, value: str = "x") -> DataFrame:
    v = F.col(value)
    return df.withColumns({"clipped": (v < 0) | (v > UPPER), value: F.least(F.greatest(v, F.lit(0.0)), F.lit(UPPER))})


def brightness(df: DataFrame, gain: float, value: str = "x") -> DataFrame:
    return clamp(df.withColumn(value, F.col(value) * gain), value)


def contrast(df: DataFrame, keys: list[str], gain: float, value: str = "x") -> DataFrame:
    """Gain around the mean of each patch and band (a patch is a bounded group)."""
    mean = F.avg(value).over(Window.partitionBy(*keys))
    return clamp(df.withColumn(value, mean + gain * (F.col(value) - mean)), value)


def hashed_normal(seed: Column) -> Column:
    """Standard normal number of a text by Box-Muller over two halves of its SHA-256."""
    digest = F.sha2(seed, 256)

    def uniform(start: int) -> Column:
        return (F.conv(F.substring(digest, start, 8), 16, 10).cast("double") + 1) / 4294967297.0

    return F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(9))


def noise(df: DataFrame, sample: str, scale: float, value: str = "x") -> DataFrame:
    """One field per patch shared by its bands, seeded by the sample id."""
    field = hashed_normal(F.concat_ws(":", F.col(sample).cast("string"), F.col("row").cast("string"), F.col("col").cast("string")))
    return clamp(df.withColumn(value, F.col(value) + scale * field), value)


def mask_bounds(height: int, width: int, area: float) -> tuple[int, int, int]:
    size = max(1, int(round(math.sqrt(area * height * width))))
    return (height - size) // 2, (width - size) // 2, size


def center_mask(df: DataFrame, height: int, width: int, area: float, fill: Column, value: str = "x") -> DataFrame:
    """Replace a centred square of the given area share by the training mean."""
    top, left, size = mask_bounds(height, width, area)
    hit = F.col("row").between(top, top + size - 1) & F.col("col").between(left, left + size - 1)
    return clamp(df.withColumn(value, F.when(hit, fill).otherwise(F.col(value))), value)


def blur_matrix(n: int, sigma: float) -> np.ndarray:
    """Row weights of a normalised Gaussian with mirrored edges (the edge pixel is repeated)."""
    radius = int(TRUNCATE * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    out = np.zeros((n, n))
    for i in range(n):
        for offset, w in zip(range(-radius, radius + 1), kernel):
            k = (i + offset) % (2 * n)
            out[i, k if k < n else 2 * n - 1 - k] += w
    return out


def resize_matrix(source: int, target: int) -> np.ndarray:
    """Row weights of antialiased bilinear resampling with half-pixel centres."""
    scale = source / target
    support = max(scale, 1.0)
    centers = (np.arange(target) + 0.5) * scale
    distance = np.abs(np.arange(source)[None, :] + 0.5 - centers[:, None]) / support
    weights = np.maximum(0.0, 1.0 - distance)
    return weights / weights.sum(axis=1, keepdims=True)


def resolution_matrix(n: int, small: int) -> np.ndarray:
    return resize_matrix(small, n) @ resize_matrix(n, small)


def separable_filter(df: DataFrame, keys: list[str], rows: np.ndarray, cols: np.ndarray, value: str = "x") -> DataFrame:
    """Apply one weight matrix down the columns and one along the rows of every patch.

    A patch is gathered into an array of height x width values (bounded), filtered batch-wise
    inside the task, and spread back to pixels.
    """
    height, width = rows.shape[0], cols.shape[0]

    @F.pandas_udf("array<double>")
    def apply(batch: pd.Series) -> pd.Series:
        stack = np.stack([np.asarray(v, dtype=float) for v in batch]).reshape(len(batch), height, width)
        return pd.Series(list((rows @ stack @ cols.T).reshape(len(batch), -1)))

    gathered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).alias("v")))).alias("_p"))
    filtered = gathered.select(*keys, apply(F.transform("_p", lambda s: s["v"])).alias("_f"))
    spread = filtered.select(*keys, F.posexplode("_f").alias("_i", value))
    return clamp(spread.select(*keys, F.floor(F.col("_i") / width).cast("int").alias("row"), (F.col("_i") % width).alias("col"), value), value)


def blur(df: DataFrame, keys: list[str], height: int, width: int, sigma: float, value: str = "x") -> DataFrame:
    return separable_filter(df, keys, blur_matrix(height, sigma), blur_matrix(width, sigma), value)


def resample(df: DataFrame, keys: list[str], height: int, width: int, small: int, value: str = "x") -> DataFrame:
    """Down to ``small`` x ``small`` pixels and back."""
    return separable_filter(df, keys, resolution_matrix(height, small), resolution_matrix(width, small), value)


def clipped_share(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col("clipped").cast("double")).alias("clipped_fraction"))
