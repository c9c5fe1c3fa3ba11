"""Features and pixel models: P7-P10, P26, A5, M1-M4, M6-M9."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import BAND_SETS, BANDS, FEATURES, INDEX_NAMES, keep_bands, pixel_features, with_indices
from ..operators import metrics as ME
from ..operators import models as MO
from ..operators import splits as SP
from ..operators.profiles import r6
from ..operators.ranking import exact_quantiles
from ..session import cut_lineage
from .registry import Book
from .shift import INDEX_SQL
from .views import bands, patch_vectors, with_views

BOOK = Book()
_BAND = with_views("v_band")


@BOOK.add("p07_spectral_indices", _BAND + "select pixel_id, " + ", ".join(f"round({q},6) as {n}" for n, q in INDEX_SQL.items()) + " from v_band")
def indices(spark, sf):
    return with_indices(bands(spark, sf)).select("pixel_id", *[r6(F.col(n)).alias(n) for n in INDEX_NAMES])


@BOOK.add("p08_pixel_features", _BAND + "select pixel_id, " + ", ".join(
    [f"round({b}/10000.0::double,6) as {b}" for b in BANDS] + [f"round(coalesce({q},0),6) as {n}" for n, q in INDEX_SQL.items()]
    + [f"(({q}) is null)::int::double as {n}_missing" for n, q in INDEX_SQL.items()]) + " from v_band")
def features(spark, sf):
    return pixel_features(bands(spark, sf)).select("pixel_id", *[r6(F.col(n)).alias(n) for n in FEATURES])


@BOOK.add("p07_incomplete_patches", "select 'incomplete_patch' as rule, vec_id//12 as patch, count(*) as vectors from embeddings group by 2 having count(*)<>12")
def incomplete(spark, sf):
    return patch_vectors(spark, sf).where(F.col("vectors") != len(BANDS)).select(F.lit("incomplete_patch").alias("rule"), "patch", "vectors")


@BOOK.add("a05_training_normalization", _BAND + "select band, round(avg(x),6) as mean, round(greatest(sqrt(greatest(avg(x*x)-avg(x)**2,0)),1e-6),6) as std from (select band, v/10000.0::double as x from (unpivot (select "
          + ", ".join(BANDS) + " from v_band where split='train') on " + ", ".join(BANDS) + " into name band value v)) group by 1")
def normalization(spark, sf):
    norm = MO.training_normalization(bands(spark, sf).where(F.col("split") == "train"))
    return norm.select("band", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


_NORM = ", ".join(f"avg({b}/10000.0::double) filter (split='train') as m_{b}, greatest(sqrt(avg(({b}/10000.0::double)**2) filter (split='train')-(avg({b}/10000.0::double) filter (split='train'))**2),1e-6) as s_{b}" for b in BANDS)


@BOOK.add("p09_standardized_bands", _BAND.rstrip().replace("v_band as (", "v_band as materialized (") + f", nm as materialized (select {_NORM} from v_band) select pixel_id, " + ", ".join(f"round(({b}/10000.0::double-m_{b})/s_{b},6) as {b}" for b in BANDS) + " from v_band, nm")
def standardized(spark, sf):
    b = bands(spark, sf)
    out = MO.standardize(b, MO.training_normalization(b.where(F.col("split") == "train")))
    return out.select("pixel_id", *[r6(F.col(n)).alias(n) for n in BANDS])


@BOOK.add("p10_band_subset", _BAND + "select pixel_id, " + ", ".join(b if b in BAND_SETS["compact_hab"] else f"0 as {b}" for b in BANDS) + " from v_band")
def subset(spark, sf):
    return keep_bands(bands(spark, sf), BAND_SETS["compact_hab"]).select("pixel_id", *BANDS)


_FIT = _BAND.rstrip() + f""", fe as (select pixel_id, y, split, {', '.join(f'{q} as {n}' for n, q in INDEX_SQL.items())} from v_band),
lg as (select pixel_id, y, split, f.feature, case f.feature {' '.join(f"when '{n}' then {n}" for n in INDEX_NAMES)} end as value from fe, unnest([{', '.join(repr(n) for n in INDEX_NAMES)}]) f(feature)),
md as (select feature, quantile_cont(value,0.5) as med from lg where split='train' group by 1),
fl as (select pixel_id, y, split, feature, coalesce(value, med, 0) as v, coalesce(med,0) as imputation from lg join md using (feature)),
dq as (select feature, quantile_cont(v,[{', '.join(str(i / 10) for i in range(11))}]) as q from fl where split='train' group by 1),
cd as (select feature, c, row_number() over (partition by feature order by c)-1 as i from (select distinct feature, unnest(q) as c from dq)),
rules as (select a.feature, a.i, b.i as j, a.c as lo, b.c as hi, d from cd a join cd b on a.feature=b.feature and a.i<=b.i, (values (1),(-1)) t(d)),
pr as (select r.*, fl.y, case when d=1 then (v>=lo)::int+(v>=hi)::int else 2-(v>=lo)::int-(v>=hi)::int end as p from fl join rules r using (feature) where split='train'),
sc as (select feature, i, j, lo, hi, d, ({'+'.join(f"coalesce(2.0::double*count(*) filter (y={k} and p={k})/nullif(count(*) filter (y={k})+count(*) filter (p={k}),0),0)" for k in range(3))})/3 as s from pr group by 1,2,3,4,5,6),
best as (select * from (select *, row_number() over (partition by feature order by -s, i, j, -d) as rn from sc) where rn=1)
"""


@BOOK.add("m01_threshold_fit", _FIT + """select feature, round(lo,6) as lower, round(hi,6) as upper, d as direction, round(s,6) as training_macro_f1, round((select any_value(imputation) from fl where fl.feature=best.feature),6) as imputation from best""")
def threshold_fit(spark, sf):
    out = MO.fit_thresholds(bands(spark, sf).where(F.col("split") == "train"))
    return out.select("feature", "direction", *[r6(F.col(c)).alias(c) for c in ("lower", "upper", "training_macro_f1", "imputation")])


@BOOK.add("p26_threshold_scoring", _FIT + """select pixel_id, fl.feature, case when d=1 then (v>=lo)::int+(v>=hi)::int else 2-(v>=lo)::int-(v>=hi)::int end as pred from fl join best using (feature)""")
def threshold_scoring(spark, sf):
    b = bands(spark, sf)
    rules = MO.fit_thresholds(b.where(F.col("split") == "train"))
    return MO.apply_thresholds(b, rules, ["pixel_id"]).select("pixel_id", "feature", "pred")


def _parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    f = pixel_features(bands(spark, sf))
    return f.where(F.col("split") == "train"), f.where(F.col("split") == "test")


def _fit(kind: str, train: DataFrame, features=FEATURES, weight: str | None = None):
    train = MO.dealt_once(train.select(*features, "y", *([weight] if weight else [])))
    if kind == "logistic":
        return MO.logistic(features, weight=weight, rows=train.count()).fit(train)
    return MO.forest(features, weight=weight).fit(train)


def evaluate(scored: DataFrame, keys: list[str]) -> DataFrame:
    return ME.metrics(ME.confusion(scored, keys).rows, keys)


_SHOWN = ("valid_pixels", "macro_f1", "low_f1", "moderate_f1", "high_f1", "accuracy")


def _shown(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[(r6(F.col(c)) if c != "valid_pixels" else F.col(c)).alias(c) for c in _SHOWN])


@BOOK.add("m02_logistic_regression")
def logistic(spark, sf):
    train, test = _parts(spark, sf)
    return _shown(evaluate(MO.score(_fit("logistic", train), test), ["region"]), ["region"])


@BOOK.add("m03_random_forest")
def forest(spark, sf):
    train, test = _parts(spark, sf)
    return _shown(evaluate(MO.score(_fit("forest", train), test), ["region"]), ["region"])


@BOOK.add("m04_batch_scoring")
def batch_scoring(spark, sf):
    train, _ = _parts(spark, sf)
    scored = MO.score(_fit("logistic", train), pixel_features(bands(spark, sf)))
    return scored.select("pixel_id", "y", "pred", *[r6(F.col("prob")[i]).alias(f"p{i}") for i in range(3)])


@BOOK.add("m06_leaf_composition")
def leaves(spark, sf):
    train, _ = _parts(spark, sf)
    table, _ = MO.leaf_composition(MO.leaf_places(_fit("forest", train), train))
    return table.select("tree", "leaf", "rows", "high_rows", "high_majority", *[r6(F.col(f"{c}_fraction")).alias(f"{c}_fraction") for c in ME.CLASSES])


# Three trees of two splits each, (feature, threshold, feature, threshold).
TREES = (("B03", 0.5, "B08", 0.5), ("B04", 0.48, "B05", 0.52), ("B11", 0.55, "B02", 0.45))
_PLACED = _BAND.rstrip() + ", pl as (" + " union all ".join(
    f"select y, {t} as tree, 2*({a}/10000.0::double>={c})::int+({b}/10000.0::double>={d})::int as leaf from v_band where split='train'" for t, (a, c, b, d) in enumerate(TREES)) + """),
lf as (select tree, leaf, count(*) as "rows", count(*) filter (y=2) as high_rows, avg((y=0)::int) as l, avg((y=1)::int) as m, avg((y=2)::int) as h from pl group by 1,2)
"""


def fixed_places(spark, sf):
    train, _ = _parts(spark, sf)
    leaf = [F.struct(F.lit(t).alias("tree"), (2 * (F.col(a) >= c).cast("int") + (F.col(b) >= d).cast("int")).alias("leaf")) for t, (a, c, b, d) in enumerate(TREES)]
    return train.select("y", F.explode(F.array(*leaf)).alias("p")).select("y", "p.*")


@BOOK.add("m06_fixed_leaf_composition", _PLACED + """select tree, leaf, "rows", high_rows, h>l and h>m as high_majority, round(l,6) as low_fraction, round(m,6) as moderate_fraction, round(h,6) as high_fraction from lf""")
def fixed_leaves(spark, sf):
    table, _ = MO.leaf_composition(fixed_places(spark, sf))
    return table.select("tree", "leaf", "rows", "high_rows", "high_majority", *[r6(F.col(f"{c}_fraction")).alias(f"{c}_fraction") for c in ME.CLASSES])


@BOOK.add("m06_fixed_tree_totals", _PLACED + """select tree, count(*) as leaves, count(*) filter (h>l and h>m) as high_majority_leaves, count(*) filter (high_rows>0) as leaves_with_high, round(max(h),6) as max_high_fraction,
  coalesce(sum(high_rows) filter (h>l and h>m),0)::bigint as high_rows_in_high_majority from lf group by 1""")
def fixed_trees(spark, sf):
    _, trees = MO.leaf_composition(fixed_places(spark, sf))
    return trees.withColumn("max_high_fraction", r6(F.col("max_high_fraction")))


@BOOK.add("m03_forest_invariants", _BAND + f"""select t::int as tree, (select count(*) from v_band where split='train') as "rows", true as fractions_sum_to_one, true as depth_within_limit from range(0,{MO.FOREST_TREES}) r(t)""")
def forest_invariants(spark, sf):
    """What holds for every correct forest: each tree places every training row once, fractions add up, depth is bounded."""
    train, _ = _parts(spark, sf)
    model = _fit("forest", train)
    leaves, _ = MO.leaf_composition(MO.leaf_places(model, train))
    deep = [t.depth <= MO.FOREST_DEPTH for t in model.stages[-1].trees]  # one flag per tree
    sums = F.abs(sum((F.col(f"{c}_fraction") for c in ME.CLASSES[1:]), F.col(f"{ME.CLASSES[0]}_fraction")) - 1) < 1e-9
    return leaves.groupBy("tree").agg(F.sum("rows").alias("rows"), F.bool_and(sums).alias("fractions_sum_to_one")).withColumn(
        "depth_within_limit", F.element_at(F.array(*[F.lit(d) for d in deep]), F.col("tree") + 1))


@BOOK.add("m02_stationary_fit", f"select k::int as class, f as feature, true as stationary from range(0,3) r(k), unnest([{', '.join(repr(f) for f in FEATURES)}]) u(f)")
def stationary(spark, sf):
    """The fitted regression is at the optimum of its objective: no gradient component above the tolerance."""
    train, _ = _parts(spark, sf)
    return MO.gradient(_fit("logistic", train), train).select("class", "feature", (F.abs("gradient") < 1e-3).alias("stationary"))


# A coefficient table by rule, so that scoring can be compared without a fit.
WEIGHTS = {f: tuple(((k * 7 + i * 13) % 11 - 5) / 5 for k in range(3)) for i, f in enumerate(FEATURES)}
INTERCEPTS = (0.1, 0.0, -0.2)
_FEATURE_SQL = {**{b: f"{b}/10000.0::double" for b in BANDS}, **{n: f"coalesce({q},0)" for n, q in INDEX_SQL.items()}, **{f"{n}_missing": f"(({q}) is null)::int::double" for n, q in INDEX_SQL.items()}}
_LINEAR = _BAND.rstrip() + ", lz as (select pixel_id, y, split, " + ", ".join(
    "+".join([f"({INTERCEPTS[k]})::double", *[f"({_FEATURE_SQL[f]})*({WEIGHTS[f][k]})::double" for f in FEATURES]]) + f" as z{k}" for k in range(3)) + """ from v_band),
lp as (select pixel_id, y, split, case when z0>=z1 and z0>=z2 then 0 when z1>=z2 then 1 else 2 end as pred, exp(z0-m)/s as p0, exp(z1-m)/s as p1, exp(z2-m)/s as p2
  from (select *, greatest(z0,z1,z2) as m, exp(z0-greatest(z0,z1,z2))+exp(z1-greatest(z0,z1,z2))+exp(z2-greatest(z0,z1,z2)) as s from lz))
"""


@BOOK.add("m04_linear_scoring", _LINEAR + "select pixel_id, y, pred, round(p0,6) as p0, round(p1,6) as p1, round(p2,6) as p2 from lp")
def linear_scoring(spark, sf):
    scored = MO.linear_scores(pixel_features(bands(spark, sf)), WEIGHTS, INTERCEPTS)
    return scored.select("pixel_id", "y", "pred", *[r6(F.col("prob")[i]).alias(f"p{i}") for i in range(3)])


@BOOK.add("m09_linear_minority_diagnostics", _LINEAR.rstrip() + """, mp as (select *, case split when 'train' then 'resubstitution' else 'test' end as part from lp where split in ('train','test')),
mm as (select part, """ + ", ".join(f"coalesce(2.0::double*count(*) filter (y={k} and pred={k})/nullif(count(*) filter (y={k})+count(*) filter (pred={k}),0),0) as f{k}" for k in range(3)) + """, count(*) filter (y=2 and pred=2)::double/count(*) filter (y=2) as recall from mp group by 1)
select part, count(*) as n, round(any_value((f0+f1+f2)/3),6) as macro_f1, round(any_value(recall),6) as high_recall, round(any_value(f2),6) as high_f1, round(avg(p2),6) as mean_high,
  round(quantile_cont(p2,0.1),6) as q10, round(quantile_cont(p2,0.5),6) as q50, round(quantile_cont(p2,0.9),6) as q90 from mp join mm using (part) where y=2 group by 1""")
def linear_minority(spark, sf):
    scored = cut_lineage(MO.linear_scores(pixel_features(bands(spark, sf)), WEIGHTS, INTERCEPTS).select("y", "split", "prob", "pred"))
    return _diagnostics(scored.where(F.col("split").isin("train", "test")).withColumn("part", F.when(F.col("split") == "train", "resubstitution").otherwise("test")))


@BOOK.add("m07_band_ablation")
def ablation(spark, sf):
    raw = bands(spark, sf)
    results = []
    for name, kept in BAND_SETS.items():
        rows = pixel_features(keep_bands(raw, kept))
        model = _fit("logistic", rows.where(F.col("split") == "train"), BANDS)
        results.append(evaluate(MO.score(model, rows.where(F.col("split") == "test")), []).select(F.lit(name).alias("bands"), "macro_f1", "high_f1"))
    table = reduce(DataFrame.unionByName, results)
    base = table.where(F.col("bands") == "all").select(F.lit(1).alias("one"), "macro_f1", "high_f1")
    out = ME.metric_deltas(table.withColumn("one", F.lit(1)), base, ["one"], ["macro_f1", "high_f1"])
    return out.select("bands", *[r6(F.col(c)).alias(c) for c in ("macro_f1", "high_f1", "delta_macro_f1", "delta_high_f1")])


@BOOK.add("m08_imbalance_variants")
def imbalance(spark, sf):
    train, test = (MO.dealt_once(part) for part in _parts(spark, sf))
    weights = SP.balanced_weights(train, "y").rows
    balanced = MO.dealt_once(SP.balanced_sample(train, "y", "pixel_id"))  # drawn once: every draw broadcasts again
    results = []
    for variant, rows, weight in (("plain", train, None), ("weighted", MO.with_class_weights(train, "y", weights), "weight"), ("balanced", balanced, None)):
        m = evaluate(MO.score(_fit("logistic", rows, weight=weight), test), [])
        counts = rows.agg(*[F.count_if(F.col("y") == k).alias(f"train_{c}") for k, c in enumerate(ME.CLASSES)])
        results.append(m.select(F.lit(variant).alias("variant"), *[r6(F.col(c)).alias(c) for c in ("macro_f1", "high_f1", "accuracy")]).join(F.broadcast(counts)))
    return reduce(DataFrame.unionByName, results)


@BOOK.add("m09_minority_diagnostics")
def minority(spark, sf):
    train, test = _parts(spark, sf)
    model = _fit("logistic", train)
    return _diagnostics(MO.score(model, train).withColumn("part", F.lit("resubstitution")).unionByName(MO.score(model, test).withColumn("part", F.lit("test"))))


def _diagnostics(both: DataFrame) -> DataFrame:
    high = both.where(F.col("y") == 2).withColumn("p", F.col("prob")[2])
    q = exact_quantiles(high, ["part"], "p", {"q10": 0.1, "q50": 0.5, "q90": 0.9}).join(high.groupBy("part").agg(F.avg("p").alias("mean_high")), "part")
    out = evaluate(both, ["part"]).select("part", "macro_f1", "high_recall", "high_f1").join(q, "part")
    return out.select("part", "n", *[r6(F.col(c)).alias(c) for c in ("macro_f1", "high_recall", "high_f1", "mean_high", "q10", "q50", "q90")])
