"""Regression by Newton steps and histogram forests, with SQL that repeats every step: M2, M3, M6-M9."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import BAND_SETS, BANDS, pixel_features
from ..operators import fits as FT
from ..operators import metrics as ME
from ..operators import models as MO
from ..operators import splits as SP
from ..operators.profiles import r6
from .models import _FEATURE_SQL
from .registry import Book
from .views import bands, with_views

BOOK = Book()
STEPS, SMALL = 5, ("B03", "B04", "B05", "B08", "B11", "NDCI")
F1 = [f"coalesce(2.0::double*count(*) filter (y={k} and pred={k})/nullif(count(*) filter (y={k})+count(*) filter (pred={k}),0),0)" for k in range(3)]
MACRO = f"round(({'+'.join(F1)})/3,6) as macro_f1, round({F1[2]},6) as high_f1"


def _values(features) -> str:
    """``px``: every pixel with the features f0.. in order."""
    return "px as materialized (select pixel_id, y, split, region, " + ", ".join(f"({_FEATURE_SQL[f]})::double as f{i}" for i, f in enumerate(features)) + " from v_band)"


def newton_sql(tag: str, d: int, source: str = "px", weight: str = "1.0::double", steps: int = STEPS) -> str:
    """CTEs that end in ``{tag}_w`` (k, i, v: class, feature or d for the intercept, coefficient) and ``{tag}_x`` (pixel_id, i, v: standardised features of all pixels)."""
    cols = ", ".join(f"f{i}" for i in range(d))
    t = tag
    out = [f"""{t}_tr as materialized (select *, {weight} as w from {source} where split='train')""",
           f"""{t}_l as materialized (select pixel_id, substr(name,2)::int as i, v from (unpivot (select pixel_id, {cols} from {source}) on {cols} into name name value v))""",
           f"""{t}_lt as materialized (select substr(name,2)::int as i, v from (unpivot (select {cols} from {t}_tr) on {cols} into name name value v))""",
           f"""{t}_s as materialized (select i, avg(v) as m, coalesce(stddev_samp(v),0) as s from {t}_lt group by 1)""",
           f"""{t}_x as materialized (select pixel_id, i, case when s>0 then (v-m)/s else 0 end as v from {t}_l join {t}_s using (i) union all select pixel_id, {d}, 1.0::double from {source})""",
           f"""{t}_y as materialized (select row_number() over () as r, pixel_id, y, w, sum(w) over () as sw, count(*) over () as n from {t}_tr)""",
           f"""{t}_w0 as materialized (select k::int as k, i::int as i, 0.0::double as v from range(0,3) a(k), range(0,{d + 1}) b(i))"""]
    for s in range(steps):
        w, o = f"{t}_w{s}", f"{t}_w{s + 1}"
        size = 3 * (d + 1)
        out += [f"""{t}_z{s} as (select r, y, w, sw, n, pixel_id, k, sum(x.v*c.v) as z from {t}_y join {t}_x x using (pixel_id) join {w} c on c.i=x.i group by all)""",
                f"""{t}_p{s} as materialized (select r, y, w, sw, n, pixel_id, k, exp(z-max(z) over (partition by r))/sum(exp(z)) over (partition by r)*exp(max(z) over (partition by r)) as p from {t}_z{s})""",
                f"""{t}_g{s} as (select k, x.i, sum(w*(p-(y=k)::int)*x.v)/any_value(sw) + any_value(case when x.i<{d} then 1.0::double/n else {FT.EASE} end)*any_value(c.v) as g
                    from {t}_p{s} join {t}_x x using (pixel_id) join {w} c using (k) where c.i=x.i group by 1,2)""",
                f"""{t}_h{s} as (select a.k as k, xa.i as i, b.k as l, xb.i as j, sum(a.w*a.p*((a.k=b.k)::int-b.p)*xa.v*xb.v)/any_value(a.sw)
                      + case when a.k=b.k and xa.i=xb.i then any_value(case when xa.i<{d} then 1.0::double/a.n else {FT.EASE} end) else 0 end as h
                    from {t}_p{s} a join {t}_p{s} b using (r) join {t}_x xa on xa.pixel_id=a.pixel_id join {t}_x xb on xb.pixel_id=a.pixel_id group by 1,2,3,4)""",
                f"""{t}_m{s} as materialized (select list(row_ order by pos) as m from (select h.k*{d + 1}+h.i as pos, list_concat(list(h order by h.l*{d + 1}+h.j), [any_value(g)]) as row_
                    from {t}_h{s} h join {t}_g{s} g using (k, i) group by 1))""",
                f"""{t}_e{s} as (select 1 as st, m from {t}_m{s} union all
                    select st+1, list_transform(range(1,{size + 1}), lambda q: case when q=st then list_transform(m[st], lambda v: v/m[st][st])
                      else list_transform(range(1,{size + 2}), lambda c: m[q][c]-m[q][st]*(m[st][c]/m[st][st])) end) from {t}_e{s} where st<={size})""",
                f"""{o} as materialized (select c.k, c.i, c.v-m[c.k*{d + 1}+c.i+1][{size + 1}] as v from {w} c, (select m from {t}_e{s} where st={size + 1}))"""]
    out += [f"{t}_w as materialized (select * from {t}_w{steps})",
            f"""{t}_pr as materialized (select pixel_id, any_value(y) as y, any_value(split) as split, any_value(region) as region, arg_min(k, (-round(z,9), k)) as pred,
                  max(exp(z)) filter (k=2)/sum(exp(z)) as p2 from (select x.pixel_id, c.k, sum(x.v*c.v) as z from {t}_x x join {t}_w c using (i) group by 1,2) join {source} using (pixel_id) group by 1)"""]
    return ",\n".join(out)


def _parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    f = pixel_features(bands(spark, sf))
    return f.where(F.col("split") == "train"), f.where(F.col("split") == "test")


def _measured(scored: DataFrame, keys: list[str]) -> DataFrame:
    m = ME.metrics(ME.confusion(scored, keys).rows, keys)
    return m.select(*keys, r6(F.coalesce("macro_f1", F.lit(0.0))).alias("macro_f1"), r6(F.coalesce("high_f1", F.lit(0.0))).alias("high_f1"))


_REG = with_views("v_band", recursive=True).rstrip() + ", " + _values(SMALL) + ", " + newton_sql("n", len(SMALL))


@BOOK.add("m02_newton_coefficients", _REG + " select k as class, case i " + " ".join(f"when {i} then '{f}'" for i, f in enumerate((*SMALL, FT.INTERCEPT))) + " end as feature, round(v,5) as coefficient from n_w")
def newton_coefficients(spark, sf):
    train, _ = _parts(spark, sf)
    rows = FT.newton_regression(train, SMALL, steps=STEPS).rows()
    return spark.createDataFrame(rows, "class int, feature string, coefficient double").withColumn("coefficient", F.round("coefficient", 5))


@BOOK.add("m02_newton_regions", _REG + f" select region, count(*) as n, {MACRO} from n_pr where split='test' group by 1")
def newton_regions(spark, sf):
    train, test = _parts(spark, sf)
    scored = FT.newton_regression(train, SMALL, steps=STEPS).score(test)
    return _measured(scored, ["region"]).join(scored.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region").select("region", "n", "macro_f1", "high_f1")


@BOOK.add("m09_newton_minority", _REG + """, mm as (select split as part, """ + MACRO + """ from n_pr where split in ('train','test') group by 1)
select part, any_value(macro_f1) as macro_f1, any_value(high_f1) as high_f1, count(*) as n, round(avg((pred=2)::int),6) as high_recall, round(avg(p2),5) as mean_high, round(quantile_cont(p2,0.5),5) as median_high
from n_pr join mm on mm.part=n_pr.split where y=2 group by 1""")
def newton_minority(spark, sf):
    train, test = _parts(spark, sf)
    scored = FT.newton_regression(train, SMALL, steps=STEPS).score(train.unionByName(test)).withColumn("part", F.col("split"))
    high = scored.where("y = 2").groupBy("part").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("pred") == 2).cast("double"))).alias("high_recall"),
                                                     F.round(F.avg(F.col("prob")[2]), 5).alias("mean_high"), F.round(F.percentile(F.col("prob")[2], F.lit(0.5)), 5).alias("median_high"))
    return _measured(scored, ["part"]).join(high, "part")


_ABLATION = ("rgb", "compact_hab")


def _subsets(sets) -> str:
    """``px0``, ``px1``, ..: the pixels with the bands of each set."""
    return ", ".join(f"px{n} as materialized (select pixel_id, y, split, region, {', '.join(f'f{BANDS.index(b)} as f{i}' for i, b in enumerate(BAND_SETS[s]))} from px)" for n, s in enumerate(sets))


@BOOK.add("m07_newton_ablation", with_views("v_band", recursive=True).rstrip() + ", " + _values(BANDS) + ", " + _subsets(_ABLATION) + ", " + ", ".join(
    newton_sql(f"a{n}", len(BAND_SETS[s]), f"px{n}") for n, s in enumerate(_ABLATION)) + " " + " union all ".join(f"select '{s}' as bands, {MACRO} from a{n}_pr where split='test'" for n, s in enumerate(_ABLATION)))
def newton_ablation(spark, sf):
    """Fits on two band sets alone; zeroed bands would be constants and add nothing."""
    train, test = _parts(spark, sf)
    return reduce(DataFrame.unionByName, [_measured(FT.newton_regression(train, BAND_SETS[s], steps=STEPS).score(test), []).select(F.lit(s).alias("bands"), "macro_f1", "high_f1") for s in _ABLATION])


@BOOK.add("m08_newton_imbalance", with_views("v_band", recursive=True).rstrip() + ", " + _values(SMALL) + """, cw as materialized (select y as cy, (select count(*) from px where split='train')/(3.0::double*count(*)) as cw from px where split='train' group by 1),
""" + newton_sql("p", len(SMALL)) + ", " + newton_sql("q", len(SMALL), weight="(select cw from cw where cy=y)") + f" select 'plain' as variant, {MACRO} from p_pr where split='test' union all select 'weighted', {MACRO} from q_pr where split='test'")
def newton_imbalance(spark, sf):
    train, test = _parts(spark, sf)
    weighted = MO.with_class_weights(train, "y", SP.balanced_weights(train, "y").rows)
    fits = (("plain", FT.newton_regression(train, SMALL, steps=STEPS)), ("weighted", FT.newton_regression(weighted, SMALL, weight="weight", steps=STEPS)))
    return reduce(DataFrame.unionByName, [_measured(m.score(test), []).select(F.lit(v).alias("variant"), "macro_f1", "high_f1") for v, m in fits])


# A small forest that SQL can repeat.
TREES, DEPTH, BINS, SHARE, LEAF = 4, 3, 16, 60, 2


def forest_sql(tag: str, d: int, source: str = "px", weight: str = "1.0::double") -> str:
    """CTEs that end in ``{tag}_best`` (tree, node, f, bin), ``{tag}_leaf`` (tree, node, c0, c1, c2) and ``{tag}_pr`` (pixel_id, y, split, region, pred)."""
    t, cols, h32 = tag, ", ".join(f"f{i}" for i in range(d)), "('0x'||substr(sha256({0}),1,8))::bigint"
    draw = h32.format("'42:'||tree||':'||pixel_id")
    out = [f"{t}_l as materialized (select pixel_id, split, substr(name,2)::int as f, v from (unpivot (select pixel_id, split, {cols} from {source}) on {cols} into name name value v))",
           f"{t}_r as materialized (select f, min(v) filter (split='train') as mn, max(v) filter (split='train') as mx from {t}_l group by 1)",
           f"{t}_b as materialized (select pixel_id, f, least({BINS - 1}, greatest(0, case when mx>mn then floor((v-mn)/(mx-mn)*{BINS}) else 0 end))::int as bin from {t}_l join {t}_r using (f))",
           f"{t}_d as materialized (select pixel_id, tree, h, y, {weight} as w from (select pixel_id, y, tree::int as tree, {draw} as h from {source}, range(0,{TREES}) r(tree) where split='train'))",
           f"{t}_c as materialized (select pixel_id, tree, y, w*({'+'.join(f'(h>={s})::int' for s in FT.POISSON)}) as n from {t}_d where h>={FT.POISSON[0]})",
           f"{t}_n0 as materialized (select pixel_id, tree::int as tree, 1 as node from {source}, range(0,{TREES}) r(tree))"]
    sq = lambda a, b, c: f"(({a})*({a})+({b})*({b})+({c})*({c}))/(({a})+({b})+({c}))"
    for s in range(DEPTH):
        drawn = h32.format("'42:'||tree||':'||node||':'||f")
        out += [f"""{t}_h{s} as (select tree, node, f, bin, {', '.join(f'coalesce(sum(n) filter (y={k}),0) as n{k}' for k in range(3))}
                    from {t}_n{s} join {t}_c using (pixel_id, tree) join {t}_b using (pixel_id) where node>={1 << s} and {drawn}%100<{SHARE} group by 1,2,3,4)""",
                f"""{t}_s{s} as (select tree, node, f, bin, {', '.join(f'sum(n{k}) over (partition by tree, node, f order by bin) as l{k}, sum(n{k}) over (partition by tree, node, f) as t{k}' for k in range(3))} from {t}_h{s})""",
                f"""{t}_best{s} as materialized (select tree, node, f, bin from (select *, row_number() over (partition by tree, node order by -round(pu,6), f, bin) as rn from (
                      select *, {sq('l0', 'l1', 'l2')}+{sq('t0-l0', 't1-l1', 't2-l2')} as pu, {sq('t0', 't1', 't2')} as pa from {t}_s{s} where l0+l1+l2>={LEAF} and t0+t1+t2-l0-l1-l2>={LEAF}) where pu>pa+1e-6) where rn=1)""",
                f"""{t}_n{s + 1} as materialized (select n.pixel_id, n.tree, case when x.f is null then n.node else 2*n.node+(b.bin>x.bin)::int end as node
                    from {t}_n{s} n left join {t}_best{s} x using (tree, node) left join {t}_b b on b.pixel_id=n.pixel_id and b.f=x.f)"""]
    out += [f"{t}_best as (" + " union all ".join(f"select * from {t}_best{s}" for s in range(DEPTH)) + ")",
            f"{t}_leaf as materialized (select tree, node, {', '.join(f'coalesce(sum(n) filter (y={k}),0)::double as c{k}' for k in range(3))} from {t}_n{DEPTH} join {t}_c using (pixel_id, tree) group by 1,2)",
            f"""{t}_pr as materialized (select pixel_id, y, split, region, case when p0>=p1 and p0>=p2 then 0 when p1>=p2 then 1 else 2 end as pred from (
                  select pixel_id, any_value(y) as y, any_value(split) as split, any_value(region) as region, {', '.join(f'round(sum(c{k}/(c0+c1+c2))/{TREES},9) as p{k}' for k in range(3))}
                  from {t}_n{DEPTH} join {t}_leaf using (tree, node) join {source} s using (pixel_id) group by 1))"""]
    return ",\n".join(out)


_FOREST = with_views("v_band").rstrip() + ", " + _values(SMALL) + ", " + forest_sql("f", len(SMALL))


def _forest(train, features=SMALL, weight=None) -> FT.Forest:
    return FT.histogram_forest(train, "pixel_id", features, weight=weight, trees=TREES, depth=DEPTH, bins=BINS, leaf=LEAF, share=SHARE)


@BOOK.add("m03_histogram_splits", _FOREST + " select tree, node, case f " + " ".join(f"when {i} then '{f}'" for i, f in enumerate(SMALL)) + " end as feature, bin from f_best")
def histogram_splits(spark, sf):
    return spark.createDataFrame([(int(t), int(n), f, b) for t, n, f, b in _forest(_parts(spark, sf)[0]).splits()], "tree int, node int, feature string, bin int")


@BOOK.add("m03_histogram_regions", _FOREST + f" select region, {MACRO} from f_pr where split='test' group by 1")
def histogram_regions(spark, sf):
    train, test = _parts(spark, sf)
    return _measured(_forest(train).score(test), ["region"])


@BOOK.add("m06_histogram_leaves", _FOREST + """ select tree, node as leaf, c0+c1+c2 as "rows", c2 as high_rows, round(c0/(c0+c1+c2),6) as low_fraction, round(c1/(c0+c1+c2),6) as moderate_fraction, round(c2/(c0+c1+c2),6) as high_fraction from f_leaf""")
def histogram_leaves(spark, sf):
    rows = spark.createDataFrame(_forest(_parts(spark, sf)[0]).leaf_rows(), "tree int, leaf int, c0 double, c1 double, c2 double")
    n = F.col("c0") + F.col("c1") + F.col("c2")
    return rows.select("tree", "leaf", n.alias("rows"), F.col("c2").alias("high_rows"), *[r6(F.col(f"c{k}") / n).alias(f"{c}_fraction") for k, c in enumerate(ME.CLASSES)])


@BOOK.add("m07_histogram_ablation", with_views("v_band").rstrip() + ", " + _values(BANDS) + ", " + _subsets(BAND_SETS) + ", " + ", ".join(
    forest_sql(f"a{n}", len(kept), f"px{n}") for n, kept in enumerate(BAND_SETS.values())) + " " + " union all ".join(f"select '{s}' as bands, {MACRO} from a{n}_pr where split='test'" for n, s in enumerate(BAND_SETS)))
def histogram_ablation(spark, sf):
    train, test = _parts(spark, sf)
    return reduce(DataFrame.unionByName, [_measured(_forest(train, kept).score(test), []).select(F.lit(s).alias("bands"), "macro_f1", "high_f1") for s, kept in BAND_SETS.items()])


@BOOK.add("m08_histogram_imbalance", with_views("v_band").rstrip() + ", " + _values(SMALL) + ", cw as materialized (select y as cy, (select count(*) from px where split='train')/(3.0::double*count(*)) as cw from px where split='train' group by 1), "
          + forest_sql("p", len(SMALL)) + ", " + forest_sql("q", len(SMALL), weight="(select cw from cw where cy=y)") + f" select 'plain' as variant, {MACRO} from p_pr where split='test' union all select 'weighted', {MACRO} from q_pr where split='test'")
def histogram_imbalance(spark, sf):
    train, test = _parts(spark, sf)
    weighted = MO.with_class_weights(train, "y", SP.balanced_weights(train, "y").rows)
    return reduce(DataFrame.unionByName, [_measured(m.score(test), []).select(F.lit(v).alias("variant"), "macro_f1", "high_f1")
                                          for v, m in (("plain", _forest(train)), ("weighted", _forest(weighted, weight="weight")))])


@BOOK.add("m09_histogram_minority", _FOREST + ", mm as (select split as part, " + MACRO + """ from f_pr where split in ('train','test') group by 1)
select part, any_value(macro_f1) as macro_f1, any_value(high_f1) as high_f1, count(*) as n, round(avg((pred=2)::int),6) as high_recall from f_pr join mm on mm.part=f_pr.split where y=2 group by 1""")
def histogram_minority(spark, sf):
    train, test = _parts(spark, sf)
    scored = _forest(train).score(train.unionByName(test)).withColumn("part", F.col("split"))
    high = scored.where("y = 2").groupBy("part").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("pred") == 2).cast("double"))).alias("high_recall"))
    return _measured(scored, ["part"]).join(high, "part")
