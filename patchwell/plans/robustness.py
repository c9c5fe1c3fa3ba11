"""Perturbations of image pixels: R1-R7."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import BANDS, SCALE, pixel_features
from ..operators import metrics as ME
from ..operators import models as MO
from ..operators import robustness as R
from ..operators.profiles import r6
from .registry import Book
from .views import bands, image, table, with_views

BOOK = Book()
_X = with_views("v_img").rstrip() + """,
px as (select sample_id, "row" as r, col as c, dn/5000.0::double as x from v_img)
"""
_OUT = 'sample_id, r as "row", c as col, round(least(greatest({x},0),1.5)+1e-9,6) as x, ({x})<0 or ({x})>1.5 as clipped'


def reflect(spark, sf):
    return image(spark, sf).select("sample_id", "row", "col", (F.col("dn") / 5000.0).alias("x"))


def _show(df):
    return df.select("sample_id", "row", "col", r6(F.col("x") + 1e-9).alias("x"), "clipped")


@BOOK.add("r01_brightness", _X + "select " + _OUT.format(x="x*1.15::double") + " from px")
def brightness(spark, sf):
    return _show(R.brightness(reflect(spark, sf), 1.15))


@BOOK.add("r02_contrast", _X + ", m as (select *, avg(x) over (partition by sample_id) as mu from px) select " + _OUT.format(x="mu+1.15::double*(x-mu)") + " from m")
def contrast(spark, sf):
    return _show(R.contrast(reflect(spark, sf), ["sample_id"], 1.15))


@BOOK.add("r03_spatial_noise", _X + """, h as (select *, sha256(sample_id||':'||r||':'||c) as d from px),
n as (select *, x+0.005::double*sqrt(-2*ln((('0x'||substr(d,1,8))::bigint+1)/4294967297.0::double))*cos(2*pi()*((('0x'||substr(d,9,8))::bigint+1)/4294967297.0::double)) as z from h) select """ + _OUT.format(x="z") + " from n")
def noise(spark, sf):
    return _show(R.noise(reflect(spark, sf), "sample_id", 0.005))


def _linear_sql(weights: str) -> str:
    """``weights``: CTEs that end in ``w`` (i, k, w), the weight of place k in place i."""
    return _X + f""", {weights},
a as (select sample_id, i as r, c, sum(w*x) as x from px join w on k=r group by 1,2,3), b as (select sample_id, r, i as c, sum(w*x) as x from a join w on k=c group by 1,2,3)
select """ + _OUT.format(x="x") + " from b"


# the weights in SQL, from the formulas: a Gaussian of 4 deviations with mirrored edges; triangles as wide as the larger pixel, down to 4 places and up to 8
_BLUR = """g as (select i, ((i+o)%16+16)%16 as q, exp(-0.5*o*o)/sum(exp(-0.5*o*o)) over (partition by i) as v from range(0,8) a(i), range(-4,5) b(o)),
w as materialized (select i, case when q<8 then q else 15-q end as k, sum(v) as w from g group by 1,2)"""
_DOWN_UP = """dn as (select j, k, v/sum(v) over (partition by j) as v from (select j, k, greatest(0,1-abs(k+0.5-(j+0.5)*2)/2)::double as v from range(0,4) a(j), range(0,8) b(k))),
up as (select i, j, v/sum(v) over (partition by i) as v from (select i, j, greatest(0,1-abs(j+0.5-(i+0.5)*0.5))::double as v from range(0,8) a(i), range(0,4) b(j))),
w as materialized (select i, k, sum(up.v*dn.v) as w from up join dn using (j) group by 1,2)"""


@BOOK.add("r04_gaussian_blur", _linear_sql(_BLUR))
def blur(spark, sf):
    return _show(R.blur(reflect(spark, sf), ["sample_id"], 8, 8, 1.0))


@BOOK.add("r05_down_up_resample", _linear_sql(_DOWN_UP))
def resample(spark, sf):
    return _show(R.resample(reflect(spark, sf), ["sample_id"], 8, 8, 4))


@BOOK.add("r06_center_mask", _X.replace("px as (", "px as materialized (") + ", one as materialized (select avg(x) as mu from px), m as (select px.*, mu from px cross join one), z as (select *, case when r between 2 and 4 and c between 2 and 4 then mu else x end as v from m) select " + _OUT.format(x="v") + " from z")
def center_mask(spark, sf):
    x = reflect(spark, sf)
    mean = x.agg(F.avg("x").alias("_mean"))  # one row
    return _show(R.center_mask(x.join(F.broadcast(mean)), 8, 8, 0.15, F.col("_mean")))


SIDE = 8


def patch_bands(spark, sf):
    """Long reflectances of the 8 x 8 patches: ``patch, row, col, band, x`` with label, region and split of the pixel."""
    pixels = bands(spark, sf)
    values = F.array(*[F.struct(F.lit(b).alias("band"), (F.col(b) / SCALE).alias("x")) for b in BANDS])
    return pixels.select("patch", "row", "col", "y", "region", "split", F.explode(values).alias("p")).select("patch", "row", "col", "y", "region", "split", "p.*")


def _wide(long: DataFrame) -> DataFrame:
    cols = [F.max(F.when(F.col("band") == b, F.col("x") * SCALE)).alias(b) for b in BANDS]
    return pixel_features(long.groupBy("patch", "row", "col", "y", "region", "split").agg(*cols))


@BOOK.add("r07_robustness_table")
def robustness(spark, sf):
    """One fitted model, every perturbation and level, compared with the unperturbed test pixels."""
    long = patch_bands(spark, sf)
    train, test = long.where(F.col("split") == "train"), long.where(F.col("split") == "test")
    wide = _wide(train)
    model = MO.logistic(rows=wide.count()).fit(wide)
    mean = train.groupBy("band").agg(F.avg("x").alias("_fill"))  # twelve rows
    keys, keep = ["patch", "band"], ["patch", "row", "col", "band", "x", "clipped"]
    info = test.select("patch", "row", "col", "y", "region").distinct()
    runs = [("none", 0.0, test.withColumn("clipped", F.lit(False)).select(*keep))]
    for level in (0, 1):
        s = {k: v[level] for k, v in R.LEVELS.items()}
        runs += [("brightness", s["brightness"], R.brightness(test, s["brightness"])), ("contrast", s["contrast"], R.contrast(test, keys, s["contrast"])),
                 ("noise", s["noise"], R.noise(test, "patch", s["noise"])), ("blur", s["blur"], R.blur(test, keys, SIDE, SIDE, s["blur"])),
                 ("resolution", s["resolution"] / 64, R.resample(test, keys, SIDE, SIDE, max(1, round(SIDE * s["resolution"] / 64)))),
                 ("mask", s["mask"], R.center_mask(test.join(F.broadcast(mean), "band"), SIDE, SIDE, s["mask"], F.col("_fill")))]
    tagged = reduce(DataFrame.unionByName, [
        df.select(*keep).withColumns({"kind": F.lit(k), "severity": F.lit(float(v))}) for k, v, df in runs]).join(info, ["patch", "row", "col"])
    share = R.clipped_share(tagged, ["kind", "severity"])
    cols = [F.max(F.when(F.col("band") == b, F.col("x") * SCALE)).alias(b) for b in BANDS]
    pixels = pixel_features(tagged.groupBy("kind", "severity", "patch", "row", "col", "y", "region").agg(*cols))
    matrix = ME.confusion(MO.score(model, pixels), ["kind", "severity", "region"]).rows
    m = ME.metrics(matrix, ["kind", "severity", "region"], [["kind", "severity"], ["kind", "severity", "region"]]).withColumn("region", F.coalesce("region", F.lit("pooled")))
    base = m.where(F.col("kind") == "none").select("region", "macro_f1", "high_f1")
    out = ME.metric_deltas(m.where(F.col("kind") != "none"), base, ["region"], ["macro_f1", "high_f1"]).join(share, ["kind", "severity"])
    return out.select("kind", "severity", "region", *[r6(F.col(c)).alias(c) for c in (
        "macro_f1", "original_macro_f1", "delta_macro_f1", "high_f1", "original_high_f1", "delta_high_f1", "clipped_fraction")])
