"""Grid geometry and the UTM -> geographic -> Albers chain as column expressions.

Formulas follow Snyder, Map Projections: A Working Manual (USGS PP 1395).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labels import VALID_MAX

# Ellipsoids and projection parameters.
WGS84_A, WGS84_E2, UTM_K0 = 6378137.0, 0.0066943799901413165, 0.9996
GRS80_A, GRS80_INV_F = 6378137.0, 298.257222101
ALBERS_PARALLELS, ALBERS_LAT0, ALBERS_LON0 = (29.5, 45.5), 23.0, -96.0


def affine_xy(t: dict[str, Column], row: Column, col: Column) -> tuple[Column, Column]:
    """Map coordinates of a pixel corner under a six-term affine a..f."""
    return t["a"] * col + t["b"] * row + t["c"], t["d"] * col + t["e"] * row + t["f"]


def pixel_center(t: dict[str, Column], row: Column, col: Column) -> tuple[Column, Column]:
    return affine_xy(t, row + 0.5, col + 0.5)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def patch_ring(t: dict[str, Column], row: Column, col: Column, size: Column) -> Column:
    """Closed ring of a square pixel window."""
    corners = [(row, col), (row, col + size), (row + size, col + size), (row + size, col), (row, col)]
    return F.array(*[point(*affine_xy(t, r, c)) for r, c in corners])


def ring_bounds(ring: Column) -> dict[str, Column]:
    xs, ys = ring.getField("x"), ring.getField("y")
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def utm_zone(crs: Column) -> tuple[Column, Column]:
    """Zone number and northern flag of an EPSG:326zz / EPSG:327zz code, else NULL."""
    pattern = r"^EPSG:(326|327)(\d{2})\z"
    zone = F.regexp_extract(crs, pattern, 2).try_cast("int")
    zone = F.when(zone.between(1, 60), zone)
    return zone, F.when(zone.isNotNull(), F.regexp_extract(crs, pattern, 1) == "326")


def with_lonlat(df: DataFrame, x: str, y: str, crs: str) -> DataFrame:
    """Adds ``lon, lat``: inverse transverse Mercator on WGS84 (series to the sixth power of D).

    The series is staged over helper columns, so that each trigonometric term is computed once.
    """
    e2, ep2 = WGS84_E2, WGS84_E2 / (1 - WGS84_E2)
    rectifying = WGS84_A * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    zone, northern = utm_zone(F.col(crs))
    staged = df.withColumns({"_zone": zone, "_mu": (F.col(y) - F.when(northern, 0.0).when(~northern, 10000000.0)) / UTM_K0 / rectifying})
    series = {2: 3 * e1 / 2 - 27 * e1**3 / 32, 4: 21 * e1**2 / 16 - 55 * e1**4 / 32,
              6: 151 * e1**3 / 96, 8: 1097 * e1**4 / 512}
    phi = F.col("_mu")
    for k, c in series.items():
        phi = phi + c * F.sin(k * F.col("_mu"))
    staged = staged.withColumn("_phi", phi)
    staged = staged.withColumns({"_sin": F.sin("_phi"), "_cos": F.cos("_phi"), "_tan": F.tan("_phi")})
    staged = staged.withColumns({"_w": 1 - e2 * F.col("_sin") * F.col("_sin"), "_t": F.col("_tan") * F.col("_tan"),
                                 "_c": ep2 * F.col("_cos") * F.col("_cos")})
    staged = staged.withColumn("_n", WGS84_A / F.sqrt("_w"))
    staged = staged.withColumn("_d", (F.col(x) - 500000.0) / (F.col("_n") * UTM_K0))
    staged = staged.withColumn("_d2", F.col("_d") * F.col("_d"))
    t, c, d, d2 = (F.col(n) for n in ("_t", "_c", "_d", "_d2"))
    radius = WGS84_A * (1 - e2) / F.pow("_w", F.lit(1.5))
    lat = F.col("_phi") - (F.col("_n") * F.col("_tan") / radius) * d2 * (
        0.5 - d2 * ((5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) / 24
                    - d2 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) / 720))
    lon = d * (1 - d2 * ((1 + 2 * t + c) / 6 - d2 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) / 120)) / F.col("_cos")
    meridian = (F.col("_zone") - 1) * 6 - 177
    helpers = ("_zone", "_mu", "_phi", "_sin", "_cos", "_tan", "_w", "_t", "_c", "_n", "_d", "_d2")
    return staged.withColumns({"lon": meridian + F.degrees(lon), "lat": F.degrees(lat)}).drop(*helpers)


def _albers_constants() -> tuple[float, float, float, float]:
    f = 1 / GRS80_INV_F
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def m(phi):
        return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)

    def q(phi):
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    first, second = map(math.radians, ALBERS_PARALLELS)
    n = (m(first) ** 2 - m(second) ** 2) / (q(second) - q(first))
    c = m(first) ** 2 + n * q(first)
    rho0 = GRS80_A * math.sqrt(c - n * q(math.radians(ALBERS_LAT0))) / n
    return e, n, c, rho0


def with_albers(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Adds ``x, y``: forward Albers equal-area conic on GRS80 with the fixed continental parameters.

    The pair is emitted through a one-element explode: filters on it are not copied into the chain.
    """
    e, n, c, rho0 = _albers_constants()
    staged = df.withColumn("_s", F.sin(F.radians(lat)))
    s = F.col("_s")
    q = (1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    staged = staged.withColumns({"_rho": GRS80_A * F.sqrt(c - n * q) / n, "_theta": n * F.radians(F.col(lon) - ALBERS_LON0)})
    pair = F.struct((F.col("_rho") * F.sin("_theta")).alias("x"), (rho0 - F.col("_rho") * F.cos("_theta")).alias("y"))
    out = staged.withColumn("_xy", F.explode(F.array(pair)))
    return out.withColumns({"x": F.col("_xy.x"), "y": F.col("_xy.y")}).drop("_s", "_rho", "_theta", "_xy")


def utm_to_albers(df: DataFrame, x: str, y: str, crs: str) -> DataFrame:
    """Whole chain; NULL coordinates when the CRS is not a WGS84 UTM code."""
    return with_albers(with_lonlat(df, x, y, crs), "lon", "lat").drop("lon", "lat")


def bilinear_dn(corners: tuple[Column, Column, Column, Column], row_weight: Column, col_weight: Column) -> Column:
    """Bilinear DN, NULL as soon as one neighbour is missing or outside 0..253."""
    usable = F.lit(True)
    for v in corners:
        x = v.cast("double")
        usable = usable & F.coalesce(~F.isnan(x) & x.between(0, VALID_MAX), F.lit(False))
    a, b, c, d = (v.cast("double") for v in corners)
    top = a * (1 - col_weight) + b * col_weight
    bottom = c * (1 - col_weight) + d * col_weight
    inside = row_weight.between(0, 1) & col_weight.between(0, 1)
    return F.when(usable & inside, top * (1 - row_weight) + bottom * row_weight)
