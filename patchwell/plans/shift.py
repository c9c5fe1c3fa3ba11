"""Feature shift between pools and look-alikes: A18, E11, E12, J12, J13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.spectral import BANDS, INDEX_NAMES, SCALE, with_indices
from ..operators import metrics as ME
from ..operators import profiles, shift
from ..operators.profiles import r6
from .registry import Book
from .views import bands, image, predictions, split_of, with_views

BOOK = Book()
NAMES = [*BANDS, *INDEX_NAMES]


def _nd(a, b):
    return f"case when abs({a}+{b})/10000.0::double>1e-8 then ({a}-{b})::double/({a}+{b}) end"


INDEX_SQL = {"NDCI": _nd("B05", "B04"), "NDVI": _nd("B08", "B04"), "FAI": "B8A/10000.0::double-(B04/10000.0::double+(B11-B04)/10000.0::double*(200.0::double/945))",
             "B8AB4": _nd("B8A", "B04"), "B3B2": _nd("B03", "B02")}
FEATURED = with_views("v_band").rstrip() + f""",
v_feat as (select pixel_id, y, split, region, case when split='train' then 'Train' when split='validation' then 'Validation' else region end as pool,
  {', '.join(f'{b}/10000.0::double as {b}' for b in BANDS)}, {', '.join(f'{q} as {n}' for n, q in INDEX_SQL.items())} from v_band),
v_long as (unpivot (select pixel_id, pool, y, {', '.join(NAMES)} from v_feat) on {', '.join(NAMES)} into name feature value "value"),
v_all as (select pool, feature, n from (select pool, count(*) as n from v_feat group by 1), unnest([{', '.join(repr(n) for n in NAMES)}]) u(feature))
"""


def pooled(spark, sf):
    rows = with_indices(bands(spark, sf)).withColumns({b: F.col(b) / SCALE for b in BANDS})
    return rows.withColumn("pool", F.when(F.col("split") == "train", "Train").when(F.col("split") == "validation", "Validation").otherwise(F.col("region")))


def long(spark, sf, keys=("pool",)):
    return shift.long_features(pooled(spark, sf), list(keys), NAMES)


_Q = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


@BOOK.add("a18_pool_feature_summaries", FEATURED + "select l.pool, l.feature, count(*) as n_finite, any_value(a.n)-count(*) as n_undefined, round(avg(value)+1e-9,6) as mean, round(stddev_pop(value),6) as std, "
          + ", ".join(f"round(quantile_cont(value,{q}),6) as {n}" for n, q in _Q.items()) + " from v_long l join v_all a on a.pool=l.pool and a.feature=l.feature group by 1,2")
def summaries(spark, sf):
    out = shift.feature_summaries(long(spark, sf), ["pool"], _Q)
    return out.select("pool", "feature", "n_finite", "n_undefined", r6(F.col("mean") + 1e-9).alias("mean"), *[r6(F.col(c)).alias(c) for c in ("std", *_Q)])


_QC = {"q10": 0.1, "q50": 0.5, "q90": 0.9}


@BOOK.add("a18_training_class_summaries", FEATURED + "select y, feature, count(*) as n_finite, " + ", ".join(f"round(quantile_cont(value,{q}),6) as {n}" for n, q in _QC.items()) + " from v_long where pool='Train' group by 1,2")
def class_summaries(spark, sf):
    """Quantiles of every feature per class in the training sample."""
    train = shift.long_features(pooled(spark, sf).where(F.col("pool") == "Train"), ["y"], NAMES)
    return shift.feature_summaries(train, ["y"], _QC).select("y", "feature", "n_finite", *[r6(F.col(c)).alias(c) for c in _QC])


@BOOK.add("e13_shift_against_high_f1", FEATURED.rstrip() + """, st as (select pool, feature, avg(value) as m, stddev_pop(value) as s from v_long group by 1,2),
sc as (select p.pool as region, round(avg(abs((p.m-t.m)/greatest(t.s,1e-8))),6) as shift from st p join st t on t.pool='Train' and t.feature=p.feature where p.pool not in ('Train','Validation') group by 1),
""" + with_views("v_pred").strip().removeprefix("with ") + """, f as (select model, region, round(coalesce(2.0::double*count(*) filter (y=2 and pred=2)/nullif(count(*) filter (y=2)+count(*) filter (pred=2),0),0),6) as high_f1 from v_pred where y is not null group by 1,2),
rk as (select model, rank() over (partition by model order by shift) + (count(*) over (partition by model, shift)-1)/2.0::double as ra, rank() over (partition by model order by high_f1) + (count(*) over (partition by model, high_f1)-1)/2.0::double as rb from f join sc using (region))
select model, round(corr(ra, rb),6) as spearman from rk group by 1""")
def shift_against_f1(spark, sf):
    """Rank correlation over the regions between the mean absolute shift of their features and High F1."""
    apart = shift.standardized_differences(long(spark, sf), "pool", "Train").where("pool != 'Validation'")
    score = apart.groupBy(F.col("pool").alias("region")).agg(r6(F.avg(F.abs("standardized_difference"))).alias("shift"))
    keys = ["model", "region"]
    f1 = ME.metrics(ME.confusion(predictions(spark, sf), keys).rows, keys).select(*keys, r6(F.col("high_f1")).alias("high_f1"))
    return ME.spearman(f1.join(score, "region"), ["model"], "shift", "high_f1").withColumn("spearman", r6(F.col("spearman")))


_SMD = "select p.pool, p.feature, p.n, t.n as base_n, round((p.m-t.m)/greatest(t.s,1e-8),6) as standardized_difference"


@BOOK.add("e11_standardized_differences", FEATURED + ", st as (select pool, feature, count(*) as n, avg(value) as m, stddev_pop(value) as s from v_long group by 1,2) "
          + _SMD + " from st p join st t on t.pool='Train' and t.feature=p.feature where p.pool<>'Train'")
def differences(spark, sf):
    return shift.standardized_differences(long(spark, sf), "pool", "Train").withColumn("standardized_difference", r6(F.col("standardized_difference")))


@BOOK.add("e11_within_class_differences", FEATURED + ", st as (select pool, y, feature, count(*) as n, avg(value) as m, stddev_pop(value) as s from v_long group by 1,2,3) "
          + _SMD + ", p.y from st p join st t on t.pool='Train' and t.feature=p.feature and t.y=p.y where p.pool<>'Train'")
def class_differences(spark, sf):
    out = shift.standardized_differences(long(spark, sf, ("pool", "y")), "pool", "Train", ["y"])
    return out.withColumn("standardized_difference", r6(F.col("standardized_difference")))


@BOOK.add("e12_wasserstein", FEATURED + """, po as (select distinct pool from v_long where pool<>'Train'),
h as (select po.pool, feature, value, 0 as a, count(*) as b from v_long l, po where l.pool='Train' group by 1,2,3 union all select pool, feature, value, count(*), 0 from v_long where pool<>'Train' group by 1,2,3),
g as (select pool, feature, value, sum(a) as a, sum(b) as b from h group by 1,2,3),
c as (select *, sum(a) over w as ca, sum(b) over w as cb, sum(a) over k as ta, sum(b) over k as tb, lead(value) over w2 as nx from g window w as (partition by pool, feature order by value rows unbounded preceding), k as (partition by pool, feature), w2 as (partition by pool, feature order by value)),
sd as (select feature, greatest(stddev_pop(value),1e-8) as sd from v_long where pool='Train' group by 1)
select pool, c.feature, round(coalesce(sum(abs(ca::double/ta-cb::double/tb)*(nx-value)),0)/any_value(sd),6) as wasserstein_base_sd from c join sd using (feature) group by 1,2""")
def wasserstein(spark, sf):
    return shift.wasserstein(long(spark, sf), "pool", "Train").withColumn("wasserstein_base_sd", r6(F.col("wasserstein_base_sd")))


_THUMB = with_views("v_img").rstrip() + """,
th0 as (select sample_id, "row"//2*4+col//2 as k, avg(dn)/10000 as m from v_img group by 1,2),
th as (select * from th0 union all select sample_id+1000000, k, m+0.0004::double from th0 where sample_id%10=0),
sp as (select sample_id, case when substr(sha256('35042:'||sample_id),1,1) in ('0','1','2') then 'test' when substr(sha256('35042:'||sample_id),1,1) in ('3','4') then 'validation' else 'train' end as split from th group by 1)
"""


def thumbnails(spark, sf):
    """Block means of every image, and a slightly brighter copy of every tenth."""
    t = profiles.block_thumbnails(image(spark, sf), ["sample_id"], "dn", block=2)
    copies = t.where("sample_id % 10 = 0").select((F.col("sample_id") + 1_000_000).alias("sample_id"), F.transform("thumbnail", lambda m: m + 0.0004).alias("thumbnail"))
    return t.select("sample_id", "thumbnail").unionByName(copies).withColumn("split", split_of(F.col("sample_id").cast("string")))


@BOOK.add("j12_appearance_exposure", _THUMB + """, d as (select t.sample_id, r.sample_id as r, avg(abs(t.m-r.m)) as d from th t join sp a on a.sample_id=t.sample_id and a.split='test' join th r on r.k=t.k join sp b on b.sample_id=r.sample_id and b.split='train' group by 1,2)
select sample_id, round(min(d),6) as nearest_distance, min(d)<=0.001 as exposed from d group by 1""")
def exposure(spark, sf):
    out = shift.appearance_exposure(thumbnails(spark, sf), "sample_id", "thumbnail", radius=0.001)
    return out.withColumn("nearest_distance", r6(F.col("nearest_distance")))


@BOOK.add("j13_close_pairs_rmse", _THUMB + """, v as (select sample_id, list(m order by k) as v from th group by 1), u as (select v, min(sample_id) as id, count(*) as n from v group by 1), w as (select id, n, unnest(v) as m, generate_subscripts(v,1) as k from u)
select a.id as sample_a, b.id as sample_b, any_value(a.n) as copies_a, any_value(b.n) as copies_b, round(sqrt(avg((a.m-b.m)**2)),6) as rmse from w a join w b on a.k=b.k and a.id<b.id group by 1,2 having sqrt(avg((a.m-b.m)**2))<=0.001""")
def close_pairs(spark, sf):
    out = shift.close_pairs(thumbnails(spark, sf), "sample_id", "thumbnail", 0.001)
    return out.withColumn("rmse", r6(F.col("rmse")))
