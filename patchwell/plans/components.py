"""Grid adjacency and components: J4, J5, G9 and the splits that need them: D3, D4, D9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import components as C
from ..operators import splits as SP
from ..operators.support import CLASS_COLUMNS, CRITERIA
from .registry import Book
from .views import census, patches, with_views

BOOK = Book()

_CELLS = with_views("v_patch", recursive=True).rstrip() + """,
cell as (select distinct subtile_id as k, tile, x, y from v_patch),
adj as (select a.tile, a.k as a, b.k as b from cell a join cell b on a.tile=b.tile and abs(a.x-b.x)<=50 and abs(a.y-b.y)<=50 and a.k<b.k),
e as (select a, b from adj union all select b, a from adj),
reach(k, l) as (select k, k from cell union select e.b, r.l from reach r join e on r.k=e.a),
comp as (select k as subtile_id, 'component:'||min(l) as spatial_group_id from reach group by 1)
"""


def cells(spark, sf):
    return patches(spark, sf).select(F.col("subtile_id").alias("key"), "tile", "x", "y").distinct()


@BOOK.add("j04_adjacent_cells", _CELLS + "select tile, a, b from adj")
def adjacent(spark, sf):
    return C.adjacent_pairs(cells(spark, sf), 50)


@BOOK.add("j05_connected_components", _CELLS + "select subtile_id, spatial_group_id from comp")
def components(spark, sf):
    return C.grid_components(patches(spark, sf))


def labelled(spark, sf):
    return patches(spark, sf).join(C.grid_components(patches(spark, sf)), "subtile_id")


@BOOK.add("g09_grid_validation", with_views("v_patch") + """select 'off_grid' as rule, count(*) as n from v_patch where seq%41=3 union all select 'identity_mismatch', count(*) from v_patch where seq%41=4""")
def grid_validation(spark, sf):
    s = F.col("seq") % 41
    rows = N.with_sample(patches(spark, sf)).select(
        "tile", "subtile_id", "parsed.subtile_size", F.when(s == 3, F.col("x") + 7).otherwise(F.col("x")).alias("x"), "y",
        F.col("sample_id").alias("named_sample_id"), F.when(s == 4, F.concat("sample_id", F.lit("b"))).otherwise(F.col("sample_id")).alias("sample_id"))
    return C.validate_grid(rows).violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("d03_component_split", _CELLS + """, h as (select spatial_group_id, row_number() over (order by sha256('35042:'||spatial_group_id) desc) as r from (select distinct spatial_group_id from comp))
select sample_id, spatial_group_id, case r when 1 then 'test' when 2 then 'validation' else 'train' end as split from v_patch join comp using (subtile_id) join h using (spatial_group_id)""")
def component_split(spark, sf):
    return SP.component_split(labelled(spark, sf), "spatial_group_id").rows.select("sample_id", "spatial_group_id", "split")


@BOOK.add("d04_component_coin", _CELLS + """select sample_id, case when ('0x'||substr(sha256('35042:'||spatial_group_id),1,8))::bigint/4294967296.0::double <= 0.7 then 'train' else 'test' end as split
  from v_patch join comp using (subtile_id)""")
def component_coin(spark, sf):
    return SP.coin_split(labelled(spark, sf), "spatial_group_id").select("sample_id", "split")


_LOOSE = CRITERIA | {"minimum_high_pixels_per_component": 50, "test_high_components": 5}


def _supported(spark, sf):
    rows = census(spark, sf).join(C.grid_components(patches(spark, sf)), "subtile_id")
    return SP.coin_split(rows, "spatial_group_id", 0.6)


_SUPPORTED = with_views("v_census", recursive=True).rstrip() + _CELLS[_CELLS.index(",\ncell as"):].rstrip() + """,
g as (select c.*, spatial_group_id, case when ('0x'||substr(sha256('35042:'||spatial_group_id),1,8))::bigint/4294967296.0::double <= 0.6 then 'train' else 'test' end as split from v_census c join comp using (subtile_id)),
s as (select split, spatial_group_id, count(*) as n, min(tile) as tile, sum(low_pixels) as l, sum(moderate_pixels) as m, sum(high_pixels) as h,
  count(distinct day) filter (high_pixels>0)>=2 and coalesce(date_diff('day', min(day) filter (high_pixels>0), max(day) filter (high_pixels>0)),0)>=30
  and count(distinct subtile_id||'|'||patch_row||'|'||patch_col) filter (high_pixels>0)>=2 and sum(high_pixels)>=50 as q from g group by 1,2)
"""


@BOOK.add("d09_support_validation", _SUPPORTED + """select split, sum(n)::bigint as patches, count(*) as geographic_groups, count(*) filter (q) as qualified_high_groups, sum(l+m+h)::bigint as valid_pixels,
  sum(l)::bigint as low_pixels, sum(m)::bigint as moderate_pixels, sum(h)::bigint as high_pixels, count(distinct case when q then tile end) as qualified_tiles from s group by 1""")
def support_validation(spark, sf):
    table = SP.validate_support(_supported(spark, sf), _LOOSE).rows
    return table.select("split", "patches", "geographic_groups", "qualified_high_groups", "valid_pixels", *CLASS_COLUMNS,
                        F.col("qualified_tiles").cast("bigint").alias("qualified_tiles"))
