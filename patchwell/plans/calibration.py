"""Probability quality: E7-E10, E14, M5."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.probability import argmax, softmax
from ..operators import calibration as C
from ..operators.profiles import r6
from .metrics import _KNOWN
from .registry import Book
from .views import logits, predictions

BOOK = Book()
_KEYS, _SETS = ["model", "region"], [["model"], ["model", "region"]]
_GROUPS = _KNOWN.rstrip() + """,
g as (select model, region, y, pred, p0, p1, p2, greatest(p0,p1,p2) as conf from k union all select model, 'pooled', y, pred, p0, p1, p2, greatest(p0,p1,p2) from k)
"""


def _named(df):
    return df.withColumn("region", F.coalesce("region", F.lit("pooled")))


def _rounded(df, skip=()):
    return df.select(*[(r6(F.col(c)).alias(c) if t == "double" and c not in skip else F.col(c)) for c, t in df.dtypes])


@BOOK.add("e07_reliability_bins", _GROUPS + """, b as (select model, region, least(floor(conf*15),14)::int as bin, count(*) as n, avg(conf) as c, avg((pred=y)::int) as f from g group by 1,2,3),
dom as (select distinct model, region, i as bin from g, range(0,15) t(i))
select dom.model, dom.region, dom.bin::int as bin, round(dom.bin/15,6) as lower, round((dom.bin+1)/15,6) as upper, coalesce(n,0) as "count", round(c,6) as confidence, round(f,6) as frequency
  from dom left join b on b.model=dom.model and b.region=dom.region and b.bin=dom.bin""")
def bins(spark, sf):
    known = predictions(spark, sf).where(F.col("y").isNotNull())
    return _rounded(_named(C.reliability_bins(known, _KEYS, _SETS, F.array_max("prob"), F.col("pred") == F.col("y"))))


_CALIBRATION = _GROUPS + """, e as (select model, region, sum(n*abs(c-f))/sum(n) as ece from (select model, region, least(floor(conf*15),14) as bin, count(*) as n, avg(conf) as c, avg((pred=y)::int) as f from g group by 1,2,3) group by 1,2),
h as (select model, region, sum(n*abs(c-f))/sum(n) as high_ece from (select model, region, least(floor(p2*15),14) as bin, count(*) as n, avg(p2) as c, avg((y=2)::int) as f from g group by 1,2,3) group by 1,2)
select model, region, count(*) as n, round(avg((pred=y)::int),6) as accuracy, round(avg((p0-(y=0)::int)**2+(p1-(y=1)::int)**2+(p2-(y=2)::int)**2),6) as brier,
  round(avg(-ln(least(greatest(case y when 0 then p0 when 1 then p1 else p2 end,1e-12),1-1e-12))),6) as nll, round(avg((p2-(y=2)::int)**2),6) as high_brier,
  round(avg(-case when y=2 then ln(least(greatest(p2,1e-12),1-1e-12)) else ln(1-least(greatest(p2,1e-12),1-1e-12)) end),6) as high_nll, count(*) filter (y=2) as high_support,
  count(*) filter (pred=2 and conf>=0.8) as high_confidence_predictions, round(count(*) filter (pred=2 and conf>=0.8 and y=2)/nullif(count(*) filter (pred=2 and conf>=0.8),0),6) as high_confidence_precision,
  round(any_value(ece),6) as ece, round(any_value(high_ece),6) as high_ece from g join e using (model, region) join h using (model, region) group by 1,2"""


@BOOK.add("e08_calibration", _CALIBRATION)
def calibration(spark, sf):
    return _rounded(_named(C.calibration(predictions(spark, sf), _KEYS, _SETS).rows))


TEMPERATURES = {"A": 1.5, "B": 0.8}  # fixed values: as fitted temperatures would be given
_SCALED = _CALIBRATION.replace("from v_logit)", "from (select pixel, sample_id, region, partition, y, model, a/t as a, b/t as b, c/t as c from v_logit join (values " + ", ".join(
    f"('{m}', {t}::double)" for m, t in TEMPERATURES.items()) + ") given(name, t) on name=model))")


@BOOK.add("e08_calibration_modes", f"select 'raw' as mode, * from ({_CALIBRATION}) union all select 'temperature', * from ({_SCALED})")
def calibration_modes(spark, sf):
    """Raw and temperature-scaled records of every model side by side."""
    known = logits(spark, sf)
    t = reduce(lambda rest, m: F.when(F.col("model") == m, F.lit(TEMPERATURES[m])).otherwise(rest), TEMPERATURES, F.lit(1.0))
    parts = []
    for mode, by in (("raw", F.lit(1.0)), ("temperature", t)):
        scaled = known.withColumn("prob", softmax(F.col("logits"), by)).withColumn("pred", argmax(F.col("prob")))
        parts.append(_rounded(_named(C.calibration(scaled, _KEYS, _SETS).rows)).select(F.lit(mode).alias("mode"), "*"))
    return parts[0].unionByName(parts[1])


@BOOK.add("e08_confidence_quantiles", _GROUPS + "select model, region, count(*) as n, " + ", ".join(
    f"round(quantile_cont(conf,{q}),6) as {n}" for n, q in C.QUANTILES.items()) + " from g where region<>'pooled' group by 1,2")
def quantiles(spark, sf):
    return _rounded(C.confidence_quantiles(predictions(spark, sf), _KEYS))


@BOOK.add("e09_roc_auc_average_precision", _KNOWN + """, l as (select model, t.i as class, (y=t.i)::int as pos, case t.i when 0 then a/8 when 1 then b/8 else c/8 end as score from k, range(0,3) t(i)),
f as (select model, class, score, sum(pos) as p, sum(1-pos) as n from l group by 1,2,3),
r as (select *, sum(p) over w as tp, sum(n) over w as fp from f window w as (partition by model, class order by score desc rows unbounded preceding))
select model, class, sum(p)::bigint as support, round(sum(n*(tp-p/2.0::double))/(sum(p)::double*sum(n)::double),6) as roc_auc, round(sum(p*tp::double/(tp+fp))/sum(p),6) as average_precision from r group by 1,2""")
def curves(spark, sf):
    """Scores are exact fractions (an eighth of each logit), so that ties are those of the data."""
    exact = logits(spark, sf).withColumn("prob", F.transform("logits", lambda z: z / 8))
    return _rounded(C.ranking_curves(exact, ["model"]))


@BOOK.add("e10_high_probability_summary", _KNOWN + """select model, y, count(*) as n, round(quantile_cont(p2,0.1),6) as q10, round(quantile_cont(p2,0.5),6) as median, round(quantile_cont(p2,0.9),6) as q90,
  round(avg(p2),6) as mean_high, round(avg((pred=2)::int),6) as share_predicted_high from k group by 1,2""")
def high_summary(spark, sf):
    return _rounded(C.high_probability_summary(predictions(spark, sf), ["model"]))


_LOSS = _KNOWN.rstrip() + """, ce as (select model, region, y, -ln(case y when 0 then p0 when 1 then p1 else p2 end) as l, [0.5::double,1.0,3.0][y+1] as w from k)
"""


@BOOK.add("e14_masked_loss", _LOSS + """select model, region, round(avg(l),6) as plain, round(sum(l*w)/sum(w),6) as weighted, round(avg(l*pow(1-exp(-l),2)),6) as focal from ce group by 1,2""")
def loss(spark, sf):
    return _rounded(C.masked_losses(logits(spark, sf), _KEYS, {"plain": {}, "weighted": {"weights": (0.5, 1.0, 3.0)}, "focal": {"gamma": 2.0}}))


@BOOK.add("m05_temperature", _KNOWN + """, v as (select model, a-m as d0, b-m as d1, c-m as d2, m-case y when 0 then a when 1 then b else c end as gap from k where partition='validation'),
tt as (select exp(ln(0.05)+i*(ln(20.0)-ln(0.05))/500) as t from range(0,501) r(i)),
l as (select model, t, avg(gap/t+ln(exp(d0/t)+exp(d1/t)+exp(d2/t))) as loss from v, tt group by 1,2),
o as (select model, avg(gap+ln(exp(d0)+exp(d1)+exp(d2))) as nll_before from v group by 1)
select model, round(any_value(nll_before),6) as nll_before, round(min(loss),3) as nll_after, min(t) filter (loss<=ml+1e-15) > 19.99 as at_bound from (select *, min(loss) over (partition by model) as ml from l) join o using (model) group by 1""")
def temperature(spark, sf):
    val = logits(spark, sf).where(F.col("partition") == "validation")
    out = C.fit_temperature(val, ["model"])
    return out.select("model", r6(F.col("nll_before")).alias("nll_before"), F.round("nll_after", 3).alias("nll_after"), "at_bound")


def _zoom_sql(passes: int = 4, points: int = 17) -> str:
    """The passes over log-spaced grids, each around the best temperature of the one before."""
    parts = ["s0 as (select distinct model, rows, ln(0.05::double) as lo, ln(20.0::double) as hi from v)"]
    for i in range(passes):
        parts.append(f"""g{i} as (select model, rows, (hi-lo)/{points - 1} as step, unnest(list_concat([1.0::double, 0.05::double, 20.0::double], list_transform(range(0,{points}), lambda n: exp(lo+(hi-lo)/{points - 1}*n)))) as t from s{i}),
l{i} as (select model, rows, t, any_value(step) as step, avg(gap/t+ln(exp(d0/t)+exp(d1/t)+exp(d2/t))) as loss from v join g{i} using (model, rows) group by 1,2,3),
b{i} as (select model, rows, arg_min(t, (loss, t)) as t, min(loss) as loss, any_value(step) as step from l{i} group by 1,2)""")
        parts.append(f"s{i + 1} as (select model, rows, greatest(ln(0.05::double), ln(t)-step) as lo, least(ln(20.0::double), ln(t)+step) as hi from b{i})")
    return ",\n".join(parts) + f"\nselect model, rows, round(b.t,4) as temperature, round(l0.loss,6) as nll_before, round(b.loss,6) as nll_after, b.t<0.0500005 or b.t>19.9998 as at_bound from b{passes - 1} b join l0 using (model, rows) where l0.t=1.0"


_GAP = "a-m as d0, b-m as d1, c-m as d2, m-case y when 0 then a when 1 then b else c end as gap from k where partition='validation'"


@BOOK.add("m05_fitted_temperature", _KNOWN.rstrip() + f""", v as materialized (select model, 'all' as rows, {_GAP} union all select model, 'right', {_GAP} and pred=y union all select model, 'wrong', {_GAP} and pred<>y union all select model, 'mostly', {_GAP} and (pred=y or pixel%7=0)),
""" + _zoom_sql())
def fitted_temperature(spark, sf):
    """The temperature itself: of all rows, of those that are always right (lower bound), always wrong (upper bound) and mostly right."""
    right = F.col("pred") == F.col("y")
    val = logits(spark, sf).where(F.col("partition") == "validation").where(F.col("y").isNotNull()).withColumn("pred", argmax(F.col("logits")))
    kinds = F.array_compact(F.array(F.lit("all"), F.when(right, "right"), F.when(~right, "wrong"), F.when(right | (F.col("pixel") % 7 == 0), "mostly")))
    out = C.fit_temperature(val.withColumn("rows", F.explode(kinds)), ["model", "rows"])
    return out.select("model", "rows", F.round("temperature", 4).alias("temperature"), *[r6(F.col(c)).alias(c) for c in ("nll_before", "nll_after")], "at_bound")
