"""Evaluation of class predictions: P22, E1-E6, E13, E15, E16, W12-W14, J14, J18."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as EV
from ..operators import metrics as M
from ..operators.profiles import r6
from .registry import Book
from .views import census, logits, predictions, with_views

BOOK = Book()
_PRED = with_views("v_pred")
_KNOWN = _PRED.rstrip() + ",\nk as (select * from v_pred where y is not null)\n"
MODELS = ["A", "B"]


def _cells(keys):
    return ", ".join([*keys, *[f"count(*) filter (y={i} and pred={j}) as n{i}{j}" for i in range(3) for j in range(3)]])


def _metric_sql(keys, source="cm"):
    """Metrics of the nine count columns, written as plain SQL."""
    total = "(" + "+".join(f"n{i}{j}" for i in range(3) for j in range(3)) + ")"
    cols, f1, sup = [], [], []
    for k, name in enumerate(M.CLASSES):
        s, p, t = f"(n{k}0+n{k}1+n{k}2)", f"(n0{k}+n1{k}+n2{k})", f"n{k}{k}"
        f = f"(case when {s}+{p}>0 then 2.0::double*{t}/({s}+{p}) else 0 end)"
        cols += [f"{s} as {name}_support", f"{p} as {name}_predicted", f"round({t}/nullif({p},0),6) as {name}_precision",
                 f"round({t}/nullif({s},0),6) as {name}_recall", f"round(case when {s}>0 then {f} end,6) as {name}_f1"]
        f1.append(f)
        sup.append(s)
    cols += [f"{total} as valid_pixels", f"round((n00+n11+n22)/nullif({total},0),6) as accuracy",
             f"round(case when {total}>0 then ({'+'.join(f1)})/3 end,6) as macro_f1",
             "round((" + "+".join(f"case when {s}>0 then {f} else 0 end" for s, f in zip(sup, f1)) + ")/nullif("
             + "+".join(f"({s}>0)::int" for s in sup) + ",0),6) as macro_f1_supported",
             "round((" + "+".join(f"{s}*{f}" for s, f in zip(sup, f1)) + f")/nullif({total},0),6) as weighted_f1",
             "(" + " and ".join(f"{s}>0" for s in sup) + ") as all_classes_present"]
    return f"select {', '.join([*keys, *cols])} from {source}"


BASIC = [f"{c}_{m}" for c in M.CLASSES for m in ("support", "predicted", "precision", "recall", "f1")] + [
    "valid_pixels", "accuracy", "macro_f1", "macro_f1_supported", "weighted_f1", "all_classes_present"]
ROUNDED = {c for c in BASIC if c.split("_")[-1] in ("precision", "recall", "f1")} | {"accuracy", "macro_f1_supported"}


def basic(df, keys):
    return df.select(*keys, *[(r6(F.col(c)) if c in ROUNDED else F.col(c)).alias(c) for c in BASIC])


def regional_matrix(spark, sf):
    return M.confusion(predictions(spark, sf), ["model", "partition", "region"]).rows


@BOOK.add("p22_softmax_argmax", _PRED + "select pixel, model, round(p0,6) as p0, round(p1,6) as p1, round(p2,6) as p2, pred from v_pred")
def softmax(spark, sf):
    p = F.col("prob")
    return predictions(spark, sf).select("pixel", "model", *[r6(p[i]).alias(f"p{i}") for i in range(3)], "pred")


@BOOK.add("e01_confusion", _KNOWN + """select model, region, i as true_class, j as pred_class, count(*) filter (y=i and pred=j) as n from k, range(0,3) a(i), range(0,3) b(j) group by 1,2,3,4""")
def confusion(spark, sf):
    return M.confusion(predictions(spark, sf), ["model", "region"]).rows


@BOOK.add("e02_metrics", _KNOWN + f", cm as (select {_cells(['model', 'region'])} from k group by 1,2)\n" + _metric_sql(["model", "region"]))
def metrics(spark, sf):
    return basic(M.metrics(M.confusion(predictions(spark, sf), ["model", "region"]).rows, ["model", "region"]), ["model", "region"])


_REGION_SETS = [["model", "partition"], ["model", "partition", "region"]]


@BOOK.add("e03_region_metrics", _KNOWN + f""", cm as (select model, "partition", coalesce(region,'pooled') as region, {_cells([])} from k group by grouping sets ((model,"partition"),(model,"partition",region)))
select model, "partition", region, n22 as high_tp, n02+n12 as high_fp, n20+n21 as high_fn, round((n20+n21+n22)/(n00+n01+n02+n10+n11+n12+n20+n21+n22),6) as high_true_share,
  round((n02+n12+n22)/(n00+n01+n02+n10+n11+n12+n20+n21+n22),6) as high_predicted_share, n00 as low_tp, n11 as moderate_tp from cm""")
def region_metrics(spark, sf):
    out = M.metrics(regional_matrix(spark, sf), ["model", "partition", "region"], _REGION_SETS)
    return out.select("model", "partition", F.coalesce("region", F.lit("pooled")).alias("region"), "high_tp", "high_fp", "high_fn",
                      r6(F.col("high_true_share")).alias("high_true_share"), r6(F.col("high_predicted_share")).alias("high_predicted_share"), "low_tp", "moderate_tp")


_TRUTH = """with t as (select source as region, quality as y, toxic*2 as pred from labels join documents using (doc_id)), k as (select * from t)
"""


@BOOK.add("e04_weighted_f1", _TRUTH + f", cm as (select {_cells(['region'])} from k group by 1)\n" + _metric_sql(["region"]).replace("select region", "select region", 1))
def weighted(spark, sf):
    from .views import table
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("region"), F.col("quality").alias("y"), (F.col("toxic") * 2).alias("pred"))
    return basic(M.metrics(M.confusion(rows, ["region"]).rows, ["region"]), ["region"])


@BOOK.add("e05_leave_one_region_out", _KNOWN + f""", r as (select {_cells(['model', 'partition', 'region'])} from k group by 1,2,3),
cm as (select model, partition, region as omitted_region, {', '.join(f'sum(n{i}{j}) over (partition by model, partition)-n{i}{j} as n{i}{j}' for i in range(3) for j in range(3))} from r)
select model, partition, omitted_region, macro_f1, high_f1, valid_pixels::bigint as valid_pixels from ({_metric_sql(['model', 'partition', 'omitted_region'])})""".replace("::double*", "::double*"))
def leave_one_out(spark, sf):
    out = M.leave_one_out(regional_matrix(spark, sf), ["model", "partition"], "region")
    return out.select("model", "partition", "omitted_region", r6(F.col("macro_f1")).alias("macro_f1"), r6(F.col("high_f1")).alias("high_f1"), "valid_pixels")


@BOOK.add("e06_region_sums_equal_pooled", _KNOWN.rstrip() + """, al as (select model, "partition", t.i as y, u.j as pred, count(*) filter (y=i and pred=j) as n, count(*) filter (y=i and pred=j and not (model='B' and region='R3')) as r from k, range(0,3) t(i), range(0,3) u(j) group by 1,2,3,4)
select model, "partition", count(*) as cells, count(*) filter (n<>r) as differences, sum(n)::bigint as pixels from al group by 1,2""")
def region_sums(spark, sf):
    """One model's regional matrices lack a region, so that its sums must differ from the pooled counts."""
    pooled = M.confusion(predictions(spark, sf), ["model", "partition"]).rows
    some = regional_matrix(spark, sf).where("not (model = 'B' and region = 'R3')")
    diff = M.pooled_differences(some, pooled, ["model", "partition"])
    return diff.groupBy("model", "partition").agg(F.count(F.lit(1)).alias("cells"), F.count_if("differs").alias("differences"), F.sum("pooled").alias("pixels"))


_SLICED = _KNOWN + f", cm as (select {_cells(['partition', 'region', 'model'])} from k group by 1,2,3), mt as ({_metric_sql(['partition', 'region', 'model'])})\n"


def sliced(spark, sf):
    return M.metrics(regional_matrix(spark, sf), ["partition", "region", "model"])


@BOOK.add("w12_model_ranking", _SLICED + """, e as (select *, low_f1>=0.3 and moderate_f1>=0.25 as ok from mt)
select partition, region, (select model from e x where x.partition=e.partition and x.region=e.region and ok order by -macro_f1, -coalesce(high_f1,0), model limit 1) as overall,
  'B' as subset_best, bool_or(ok) filter (model='B') as subset_eligible, array_to_string(list_sort(list(model) filter (ok)),',') as eligible from e group by 1,2""".replace(
    "array_to_string(list_sort(list(model) filter (ok)),',')", "coalesce(string_agg(case when ok then model end, ',' order by model),'')"))
def model_ranking(spark, sf):
    out = M.rank_models(sliced(spark, sf), ["partition", "region"], "model", F.col("model") == "B", low_floor=0.3)
    return out.withColumn("eligible", F.concat_ws(",", "eligible"))


@BOOK.add("w13_error_examples", _KNOWN + """, tg as (select model, region, sample_id, greatest(p0,p1,p2) as conf, unnest(list_filter([case when y=0 and pred=0 then 'correct_Low' end, case when y=1 and pred=1 then 'correct_Moderate' end,
  case when y=2 and pred=2 then 'correct_High' end, case when y=2 and pred=1 then 'High_to_Moderate' end, case when y=2 and pred=0 then 'High_to_Low' end, case when y<>2 and pred=2 then 'false_High' end,
  case when y<>pred and greatest(p0,p1,p2)>=0.8 then 'high_confidence_error' end], lambda v: v is not null)) as category from k),
pp as (select model, region, category, sample_id, count(*) as "count", avg(conf) as confidence from tg group by 1,2,3,4),
rk as (select *, row_number() over (partition by model, region, category order by round(confidence,12) desc, sample_id) as rn from pp),
dom as (select distinct model, region, u.c as category from k, unnest(['correct_Low','correct_Moderate','correct_High','High_to_Moderate','High_to_Low','false_High','high_confidence_error']) u(c))
select dom.model, dom.region, dom.category, sample_id, "count", round(confidence,6) as confidence from dom left join rk on rk.rn=1 and rk.model=dom.model and rk.region=dom.region and rk.category=dom.category""")
def examples(spark, sf):
    out = M.pick_examples(predictions(spark, sf), ["model", "region"], "sample_id")
    return out.withColumn("confidence", r6(F.col("confidence")))


@BOOK.add("w14_hardest_regions", _SLICED + """select model, partition, arg_min(region, (macro_f1, region)) as lowest, min(macro_f1) as lowest_value, arg_min(region, (-macro_f1, region)) as highest, max(macro_f1) as highest_value from mt group by 1,2""")
def hardest(spark, sf):
    table = sliced(spark, sf).withColumn("macro_f1", r6(F.col("macro_f1")))
    return M.extremes(table, ["model", "partition"], "region", "macro_f1")


@BOOK.add("j14_error_similarity", _KNOWN + """, w as (select pixel, max(y) as y, max(case when model='A' then pred end) as a, max(case when model='B' then pred end) as b from k group by 1)
select 'A' as left_model, 'B' as right_model, round(avg((a=b)::int),6) as agreement, round(count(*) filter (a<>y and b<>y)/count(*) filter (a<>y or b<>y),6) as error_jaccard,
  round(count(*) filter (y=2 and a<>2 and b<>2)/count(*) filter (y=2 and (a<>2 or b<>2)),6) as high_miss_jaccard from w""")
def similarity(spark, sf):
    out = M.error_similarity(predictions(spark, sf), MODELS)
    return out.select("left_model", "right_model", *[r6(F.col(c)).alias(c) for c in ("agreement", "error_jaccard", "high_miss_jaccard")])


@BOOK.add("j18_metric_comparison", _SLICED + """select v.region, v.model, v.macro_f1, t.macro_f1 as original_macro_f1, round(v.m-t.m,6) as delta_macro_f1 from (select *, macro_f1 as m from mt where partition='test') v
  left join (select *, macro_f1 as m from mt where partition='validation') t using (region, model)""".replace("v.m-t.m", "v.macro_f1-t.macro_f1"))
def comparison(spark, sf):
    s = sliced(spark, sf).withColumn("macro_f1", r6(F.col("macro_f1")))
    out = M.metric_deltas(s.where(F.col("partition") == "test"), s.where(F.col("partition") == "validation"), ["region", "model"], ["macro_f1"])
    return out.select("region", "model", "macro_f1", "original_macro_f1", r6(F.col("delta_macro_f1")).alias("delta_macro_f1"))


@BOOK.add("e13_spearman", _SLICED + """, sc as (select partition, model, region, macro_f1, accuracy from mt),
rk as (select *, rank() over (partition by partition, model order by macro_f1) + (count(*) over (partition by partition, model, macro_f1)-1)/2.0::double as ra,
  rank() over (partition by partition, model order by accuracy) + (count(*) over (partition by partition, model, accuracy)-1)/2.0::double as rb from sc)
select partition, model, round(corr(ra, rb),6) as spearman from rk group by 1,2""")
def spearman(spark, sf):
    s = sliced(spark, sf).withColumns({"macro_f1": r6(F.col("macro_f1")), "accuracy": r6(F.col("accuracy"))})
    return M.spearman(s, ["partition", "model"], "macro_f1", "accuracy").withColumn("spearman", r6(F.col("spearman")))


@BOOK.add("e15_reproduction_diff", _PRED.rstrip() + """, b as (select pixel, model, case when pixel%13=0 then (pred+1)%3 else pred end as pred, p0+case when pixel%17=0 then 0.001::double else 0 end as p0, p1, p2 from v_pred where pixel%11<>0),
j as (select a.model, a.pred as x, b.pred as y, b.pixel as bp, greatest(abs(a.p0-b.p0), abs(a.p1-b.p1), abs(a.p2-b.p2)) as gap from v_pred a left join b using (pixel, model))
select model, count(*) as "rows", count(*) filter (bp is null) as unmatched, count(*) filter (x<>y) as class_differences, count(*) filter (gap>1e-12) as beyond_tolerance, round(max(gap),6) as max_difference from j group by 1""")
def reproduction(spark, sf):
    """Against a second run in which some pixels are absent, some classes differ and some probabilities are off."""
    p = predictions(spark, sf)
    off = F.when(F.col("pixel") % 17 == 0, F.lit(0.001)).otherwise(F.lit(0.0))
    again = predictions(spark, sf).where(F.col("pixel") % 11 != 0).withColumns({
        "pred": F.when(F.col("pixel") % 13 == 0, (F.col("pred") + 1) % 3).otherwise(F.col("pred")),
        "prob": F.transform("prob", lambda q, i: q + F.when(i == 0, off).otherwise(F.lit(0.0)))})
    return M.reproduction_diff(p, again, ["model", "pixel"]).withColumn("max_difference", r6(F.col("max_difference")))


@BOOK.add("e16_qualification_decision", _SLICED + f""", pooled as (select {_cells(['partition', 'model'])} from k group by 1,2), pm as ({_metric_sql(['partition', 'model'], 'pooled')}),
rc as (select partition, model, count(*) filter (high_support>0) as hc, count(*) filter (high_support>0 and high_recall<=0) as z from mt group by 1,2)
select partition, model, array_to_string(list_filter([case when high_recall<0.5 then 'high_recall<0.50' end, case when high_f1<0.5 then 'high_f1<0.50' end, case when low_f1<0.5 then 'low_f1<0.50' end,
  case when moderate_f1<0.4 then 'moderate_f1<0.40' end, case when macro_f1<0.5 then 'macro_f1<0.50' end, case when hc<3 then 'high_components<3' end, case when z>0 then 'component_high_recall=ZERO' end], lambda v: v is not null),';') as reasons
  from pm join rc using (partition, model)""")
def decision(spark, sf):
    matrix = regional_matrix(spark, sf)
    pooled = M.metrics(matrix, ["partition", "model"])
    per_region = M.metrics(matrix, ["partition", "model", "region"]).where(F.col("high_support") > 0)
    recalls = per_region.groupBy("partition", "model").agg(
        F.count(F.lit(1)).alias("high_components"), F.collect_list("high_recall").alias("component_high_recalls"))
    return pooled.join(recalls, ["partition", "model"]).select("partition", "model", F.concat_ws(";", EV.metric_gate_reasons()).alias("reasons"))


@BOOK.add("w14_highest_patches", with_views("v_census") + """select tile, arg_min(sample_id, (high_pixels, sample_id)) as lowest, min(high_pixels) as lowest_value, arg_min(sample_id, (-high_pixels, sample_id)) as highest, max(high_pixels) as highest_value from v_census group by 1""")
def highest_patches(spark, sf):
    """The patch with the most High pixels of each region, and the one with the fewest."""
    return M.extremes(census(spark, sf), ["tile"], "sample_id", "high_pixels")


@BOOK.add("w14_false_negatives", _KNOWN + """, fn as (select model, region, y, count(*) filter (pred<>y) as n from k group by 1,2,3)
select model, region, arg_min(y, (n, y)) as lowest, min(n) as lowest_value, arg_min(y, (-n, y)) as highest, max(n) as highest_value from fn group by 1,2""")
def false_negatives(spark, sf):
    """The class that most of its own pixels miss, per model and region."""
    known = predictions(spark, sf).where(F.col("y").isNotNull())
    missed = known.groupBy("model", "region", "y").agg(F.count_if(F.col("pred") != F.col("y")).alias("n"))
    return M.extremes(missed, ["model", "region"], "y", "n")
