"""Support tables, inventories and qualification of components: A1, A6-A8, A11-A15, J1, J15, J17, J18, A20, Q1, Q9, Q13, W4, W5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import intervals as IV
from ..operators import pools
from ..operators import support as S
from ..operators.profiles import r6
from .names import _MEMBERS, members
from .registry import Book
from .views import census, patches, pixels, split_of, table, with_views

BOOK = Book()
CRITERIA = S.CRITERIA | {"minimum_high_pixels_per_component": 400}


def grouped_census(spark, sf):
    """Census with a spatial group made of whole subtiles of one tile, and a split per group."""
    group = F.concat("tile", F.lit("_Q"), F.floor(F.col("x") / 500).cast("string"), F.lit("_"), F.floor(F.col("y") / 500).cast("string"))
    return census(spark, sf).withColumn("spatial_group_id", group).withColumn("split", split_of(F.col("spatial_group_id")))


_SPLIT_SQL = "case when substr(sha256('35042:'||spatial_group_id),1,1) in ('0','1','2') then 'test' when substr(sha256('35042:'||spatial_group_id),1,1) in ('3','4') then 'validation' else 'train' end"
_GROUPED = with_views("v_census").rstrip() + f""",
v_gc0 as (select *, tile||'_Q'||(x//500)||'_'||(y//500) as spatial_group_id from v_census),
v_gc as (select *, {_SPLIT_SQL} as split from v_gc0)"""
_SUPPORT = _GROUPED + """,
v_sup as (select spatial_group_id, string_agg(distinct tile, ',' order by tile) as source_tiles, min(tile) as tile, count(distinct subtile_id) as subtiles, count(*) as patches,
  sum(low_pixels)::bigint as low_pixels, sum(moderate_pixels)::bigint as moderate_pixels, sum(high_pixels)::bigint as high_pixels,
  count(*) filter (high_pixels>0) as high_patches, count(distinct subtile_id) filter (high_pixels>0) as high_subtiles,
  count(distinct day) filter (high_pixels>0) as high_date_count,
  coalesce(date_diff('day', min(day) filter (high_pixels>0), max(day) filter (high_pixels>0)),0) as high_date_span_days,
  count(distinct subtile_id||'|'||patch_row||'|'||patch_col) filter (high_pixels>0) as high_patch_positions from v_gc group by 1)
"""
_QUALIFIES = "(high_date_count>=2 and high_date_span_days>=30 and high_patch_positions>=2 and high_pixels>=400)"


def flat_support(spark, sf):
    s = S.group_support(grouped_census(spark, sf))
    return s.select("spatial_group_id", F.concat_ws(",", "source_tiles").alias("source_tiles"), F.size("subtiles").alias("subtiles"),
                    "patches", *S.CLASS_COLUMNS, "high_patches", "high_subtiles", "high_date_count", "high_date_span_days",
                    "high_patch_positions", r6(F.col("high_percent")).alias("high_percent"))


@BOOK.add("a01_inventory_summary", with_views("v_patch") + """select count(*) as paired_samples, string_agg(distinct tile, ',' order by tile) as regions,
  count(distinct subtile_id) as groups, strftime(min(day),'%Y-%m-%d') as date_min, strftime(max(day),'%Y-%m-%d') as date_max from v_patch""")
def inventory_summary(spark, sf):
    out = S.inventory_summary(patches(spark, sf), "tile", "subtile_id", "day")
    return out.select("paired_samples", F.concat_ws(",", "regions").alias("regions"), "groups",
                      F.col("date_min").cast("string").alias("date_min"), F.col("date_max").cast("string").alias("date_max"))


@BOOK.add("a06_group_support", _SUPPORT + """select spatial_group_id, source_tiles, subtiles, patches, low_pixels, moderate_pixels, high_pixels, high_patches, high_subtiles,
  high_date_count, high_date_span_days, high_patch_positions, round(case when low_pixels+moderate_pixels+high_pixels>0 then 100.0::double*high_pixels/(low_pixels+moderate_pixels+high_pixels) else 0 end,6) as high_percent from v_sup""")
def group_support(spark, sf):
    return flat_support(spark, sf)


@BOOK.add("q01_component_qualifies", _SUPPORT + f"select spatial_group_id, {_QUALIFIES} as qualifies from v_sup")
def qualifies(spark, sf):
    return S.group_support(grouped_census(spark, sf)).select("spatial_group_id", S.qualifies(CRITERIA).alias("qualifies"))


@BOOK.add("a07_split_support", _GROUPED + """
select coalesce(split,'all') as split, count(*) as patches, round(count(*)/(select count(*) from v_gc),6) as fraction, count(distinct subtile_id) as subtiles, count(distinct spatial_group_id) as components,
  sum(low_pixels)::bigint as low_pixels, sum(moderate_pixels)::bigint as moderate_pixels, sum(high_pixels)::bigint as high_pixels, sum(low_pixels+moderate_pixels+high_pixels)::bigint as valid_pixels,
  round(100.0::double*sum(low_pixels)/sum(low_pixels+moderate_pixels+high_pixels),6) as low_percent, round(100.0::double*sum(moderate_pixels)/sum(low_pixels+moderate_pixels+high_pixels),6) as moderate_percent,
  round(100.0::double*sum(high_pixels)/sum(low_pixels+moderate_pixels+high_pixels),6) as high_percent from v_gc group by grouping sets ((split),())""")
def split_support(spark, sf):
    return S.split_support(grouped_census(spark, sf))


@BOOK.add("a08_pool_summary", _GROUPED + """
select coalesce(tile,'all') as tile, coalesce(archive,'all') as archive, count(*) as decoded_pairs, sum(low_pixels)::bigint as low_pixels, sum(moderate_pixels)::bigint as moderate_pixels, sum(high_pixels)::bigint as high_pixels,
  count(*) filter (high_pixels>0) as high_pairs, count(distinct spatial_group_id) filter (high_pixels>0) as high_components, count(distinct subtile_id) filter (high_pixels>0) as high_subtiles,
  count(distinct day) filter (high_pixels>0) as high_dates, round(100.0::double*sum(high_pixels)/sum(low_pixels+moderate_pixels+high_pixels),6) as high_percent_valid,
  coalesce(string_agg(distinct case when high_pixels>0 then tile end, ',' order by case when high_pixels>0 then tile end),'') as high_source_tiles
  from v_gc group by grouping sets ((tile),(archive),())""")
def pool_summary(spark, sf):
    out = S.pool_summary(grouped_census(spark, sf), [["tile"], ["archive"], []])
    return out.select(F.coalesce("tile", F.lit("all")).alias("tile"), F.coalesce("archive", F.lit("all")).alias("archive"),
                      "decoded_pairs", *S.CLASS_COLUMNS, "high_pairs", "high_components", "high_subtiles", "high_dates",
                      r6(F.col("high_percent_valid")).alias("high_percent_valid"), F.concat_ws(",", "high_source_tiles").alias("high_source_tiles"))


@BOOK.add("a12_date_summary", with_views("v_px").rstrip() + """,
d as (select sample_id, day, count(*) filter (dn between 200 and 253) as high, count(*) filter (dn between 199 and 253) as h199, count(*) filter (dn between 201 and 253) as h201,
  count(*) filter (dn<=253) as valid from v_px group by 1,2)
select sample_id, count(*) filter (high>0) as dates_with_high, coalesce(date_diff('day', min(day) filter (high>0), max(day) filter (high>0)),0) as high_date_span_days,
  sum(high)::bigint as high_total, sum(h199)::bigint as high_total_199, sum(h201)::bigint as high_total_201, sum(valid)::bigint as valid_total from d group by 1""")
def date_summary(spark, sf):
    return S.date_summary(pools.daily_counts(pixels(spark, sf), ["sample_id"]), ["sample_id"])


@BOOK.add("a11_waterbody_rollup", with_views("v_px").rstrip() + """,
m as (select sample_id, tile, day, count(*) filter (dn between 200 and 253) as h, count(*) filter (dn between 201 and 253) as hmin, count(*) filter (dn between 199 and 253) as hmax from v_px group by 1,2,3),
g as (select sample_id, count(*) as candidate_scenes, date_diff('day', min(day), max(day)) as date_span_days, count(*) filter (h>0) as high_patch_count, sum(h)::bigint as native_high_pixels,
  sum(hmin)::bigint as native_high_min, sum(hmax)::bigint as native_high_max from m group by 1)
select *, qualification_failure='' as qualified from (select *, array_to_string(list_filter([case when candidate_scenes<2 then 'fewer_than_2_dates' end, case when date_span_days<30 then 'date_span_below_30_days' end,
  case when high_patch_count<3 then 'fewer_than_3_high_patches' end, case when native_high_pixels<100 then 'fewer_than_100_native_high_pixels' end], lambda v: v is not null),';') as qualification_failure from g)""")
def waterbody_rollup(spark, sf):
    d = pools.daily_counts(pixels(spark, sf), ["sample_id"]).select(
        "sample_id", "day", F.col("high").alias("native_high"), F.col("high_201").alias("native_high_min"), F.col("high_199").alias("native_high_max"))
    return S.waterbody_rollup(d, ["sample_id"])


@BOOK.add("a13_duplicate_contents", """select sha256(text) as content, count(*) as copies, count(*)-1 as extra_copies from documents group by 1 having count(*)>1""")
def duplicate_contents(spark, sf):
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("content"))
    return S.duplicate_groups(docs, "content")


@BOOK.add("a14_content_across_partitions", """select * from (select sha256(text) as content, string_agg(distinct source, ',' order by source) as parts, count(*) as "rows", count(distinct source) as n from documents group by 1)
  where n>1""".replace("select *", "select content, parts, \"rows\"", 1))
def across_partitions(spark, sf):
    docs = table(spark, sf, "documents").select(F.sha2("text", 256).alias("content"), "source")
    return S.shared_across(docs, "content", "source").select("content", F.concat_ws(",", "parts").alias("parts"), "rows")


@BOOK.add("a15_counter_tables", with_views("v_patch") + """select coalesce(tile,'all') as region, coalesce(year(day),-1) as year, coalesce(month(day),-1) as month, coalesce(status,'all') as status, count(*) as n
  from v_patch group by grouping sets ((tile),(year(day)),(month(day)),(status))""")
def counters(spark, sf):
    rows = patches(spark, sf).select(F.col("tile").alias("region"), F.year("day").alias("year"), F.month("day").alias("month"), "status")
    out = pools.counter_tables(rows, ["region", "year", "month", "status"])
    return out.select(F.coalesce("region", F.lit("all")).alias("region"), F.coalesce("year", F.lit(-1)).alias("year"),
                      F.coalesce("month", F.lit(-1)).alias("month"), F.coalesce("status", F.lit("all")).alias("status"), "n")


@BOOK.add("a20_temporal_total_variation", _GROUPED + """,
c as (select split as pool, month(day) as m, count(*) as n from v_gc group by 1,2), t as (select pool, sum(n) as t from c group by 1),
p as (select t.pool, m.m, coalesce(c.n,0)/t.t as p from t cross join range(1,13) m(m) left join c on c.pool=t.pool and c.m=m.m)
select a.pool, round(sum(abs(a.p-b.p))/2,6) as total_variation, (select count(distinct day) from v_gc where split=a.pool) as unique_dates,
  count(*) filter (a.p>0) as months_observed from p a join p b on b.pool='train' and a.m=b.m where a.pool<>'train' group by 1""")
def total_variation(spark, sf):
    return pools.temporal_shift(grouped_census(spark, sf).select(F.col("split").alias("pool"), "day"), base="train")


@BOOK.add("j15_zero_filled_calendar", _GROUPED + """,
u as (select split as pool, 'patch' as unit, day from v_gc union all select distinct split, 'unique_date', day from v_gc),
c as (select pool, unit, 'month' as dimension, month(day)::varchar as value, count(*) as n from u group by 1,2,4
 union all select pool, unit, 'season', case when month(day) in (12,1,2) then 'DJF' when month(day) in (3,4,5) then 'MAM' when month(day) in (6,7,8) then 'JJA' else 'SON' end, count(*) from u group by 1,2,4
 union all select pool, unit, 'year', year(day)::varchar, count(*) from u group by 1,2,4),
dom as (select 'month' as dimension, m::varchar as value from range(1,13) t(m) union all select 'season', unnest(['DJF','MAM','JJA','SON']) union all select 'year', y::varchar from (select unnest(range(min(year(day)), max(year(day))+1)) as y from v_gc)),
t as (select pool, unit, count(*) as total from u group by 1,2)
select t.pool, t.unit, dom.dimension, dom.value, coalesce(c.n,0) as n, round(coalesce(c.n,0)/t.total,6) as proportion, t.total from t cross join dom left join c on c.pool=t.pool and c.unit=t.unit and c.dimension=dom.dimension and c.value=dom.value""")
def calendar_grid(spark, sf):
    rows = grouped_census(spark, sf).select(F.col("split").alias("pool"), "day")
    return pools.calendar_grid(rows)


@BOOK.add("j01_pair_inventory", _MEMBERS + """, ok as (select m.*, p.sample_id from v_member m join v_patch p using (seq) where seq%50 not in (7,9,11,13) and not (kind='cyan' and seq%50=17))
select sample_id, max(member) filter (kind='sen2') as sen2_member, max(member) filter (kind='cyan') as cyan_member from ok group by 1 having count(*)=2""")
def pair_inventory(spark, sf):
    return pools.pair_inventory(_inventory_members(spark, sf)).strict_rows


def _inventory_members(spark, sf):
    lost = (F.col("kind") == "cyan") & (F.col("seq") % 50 == 17)
    return members(spark, sf).where(~lost).select("member")


@BOOK.add("j01_inventory_violations", _MEMBERS + """, ok as (select m.*, p.sample_id from v_member m join v_patch p using (seq) where not (kind='cyan' and seq%50=17))
select 'unpaired' as rule, count(*) as n from (select sample_id from ok where seq%50 not in (7,9,11,13) group by 1 having count(*)<2)
union all select 'unsafe_path', count(*) from ok where seq%50 in (7,13) union all select 'unrecognized', count(*) from ok where seq%50=9 union all select 'impossible_date', count(*) from ok where seq%50=11""")
def inventory_violations(spark, sf):
    return pools.pair_inventory(_inventory_members(spark, sf)).violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("j02_identity_table", _GROUPED + """
select p.sample_id, c.split, c.spatial_group_id, p.tile as source_tile, strftime(p.day,'%Y-%m-%d') as acquisition_date, p.patch_row, p.patch_col, c.low_pixels+c.moderate_pixels+c.high_pixels as valid_pixels, c.high_pixels,
  round(case when c.low_pixels+c.moderate_pixels+c.high_pixels>0 then 100.0::double*c.high_pixels/(c.low_pixels+c.moderate_pixels+c.high_pixels) else 0 end,6) as high_percent
  from v_patch p join v_gc c on p.sample_id=c.sample_id where c.seq%23<>0""")
def identity_table(spark, sf):
    return pools.identity_table(*_split_and_census(spark, sf)).rows


def _split_and_census(spark, sf):
    g = grouped_census(spark, sf)
    split_rows = patches(spark, sf).select("sample_id", F.col("day").alias("date"), F.col("subtile_id").alias("source_subtile"))
    rows = g.where(F.col("seq") % 23 != 0).select("sample_id", "split", "spatial_group_id", *S.CLASS_COLUMNS)
    return split_rows, rows


@BOOK.add("j02_identity_violations", with_views("v_patch") + "select 'missing_census_row' as rule, count(*) as n from v_patch where seq%23=0 having count(*)>0")
def identity_violations(spark, sf):
    return pools.identity_table(*_split_and_census(spark, sf)).violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("j17_screened_vs_selected", _SUPPORT + """, sel as (select spatial_group_id, min(split) as split, count(*) as n, count(*) filter (high_pixels>0) as hp, sum(high_pixels)::bigint as h from v_gc where status='P' group by 1)
select s.spatial_group_id, s.patches as screened_patches, s.high_pixels as screened_high_pixels, coalesce(sel.split,'NOT_SELECTED') as selected_split, coalesce(sel.n,0) as selected_patches,
  coalesce(sel.hp,0) as selected_high_patches, coalesce(sel.h,0) as selected_high_pixels from v_sup s left join sel using (spatial_group_id)""")
def screened_vs_selected(spark, sf):
    g = grouped_census(spark, sf)
    return pools.screened_vs_selected(S.group_support(g), g.where(F.col("status") == "P"))


@BOOK.add("q09_high_support_selected", _GROUPED + """
select spatial_group_id, min(split) as split, count(*) as selected_patches, count(*) filter (high_pixels>0) as high_patches, sum(high_pixels)::bigint as high_pixels,
  sum(low_pixels+moderate_pixels+high_pixels)::bigint as valid_pixels, round(coalesce(100.0::double*sum(high_pixels)/nullif(sum(low_pixels+moderate_pixels+high_pixels),0),0),6) as high_percent_valid,
  count(distinct day) as distinct_dates, count(distinct day) filter (high_pixels>0) as high_dates, string_agg(distinct tile,'|' order by tile) as source_tiles from v_gc where status='P' group by 1""")
def high_support_selected(spark, sf):
    return pools.selected_support(grouped_census(spark, sf).where(F.col("status") == "P"))


@BOOK.add("w04_temporal_density", with_views("v_patch") + """select g as "group", sample_count, unique_dates, span_days, sample_count-unique_dates as same_date_extra_samples, min_gap_days, median_gap_days,
  round(30*unique_dates/(span_days+1),6) as dates_per_30_days from (select subtile_id as g, sum(n)::bigint as sample_count, count(*) as unique_dates, date_diff('day',min(day),max(day)) as span_days,
  min(gap) as min_gap_days, quantile_cont(gap,0.5) as median_gap_days from (select *, date_diff('day', lag(day) over (partition by subtile_id order by day), day) as gap from
  (select subtile_id, day, count(*) as n from v_patch group by 1,2)) group by 1)""")
def temporal_density(spark, sf):
    out = IV.temporal_density(patches(spark, sf), "subtile_id", "day").rows
    return out.select(F.col("subtile_id").alias("group"), "sample_count", "unique_dates", "span_days", "same_date_extra_samples",
                      "min_gap_days", "median_gap_days", r6(F.col("dates_per_30_days")).alias("dates_per_30_days"))


@BOOK.add("w05_position_repeats", _GROUPED + """, d as (select distinct spatial_group_id, subtile_id, patch_row, patch_col, day from v_gc where high_pixels>0),
g as (select *, date_diff('day', lag(day) over (partition by spatial_group_id, subtile_id, patch_row, patch_col order by day), day) as gap from d),
p as (select spatial_group_id, subtile_id, patch_row, patch_col, count(*) as n, coalesce(bool_or(gap between 1 and 30),false) as close from g group by 1,2,3,4)
select spatial_group_id, count(*) as positions, count(*) filter (n>1) as positions_repeated, count(*) filter (close) as positions_repeated_within from p group by 1""")
def position_repeats(spark, sf):
    high = grouped_census(spark, sf).where(F.col("high_pixels") > 0)
    return IV.position_repeats(high, ["spatial_group_id"], ["subtile_id", "patch_row", "patch_col"], "day")


# Scenes of the fixture lie two years apart, so that patches of one subtile share dates and some stand side by side.
_INDEP = _GROUPED + """, h as (select * replace (make_date(cast(year(day)//2*2 as int),1,1) as day), sha256(low_pixels||'|'||moderate_pixels||'|'||high_pixels) as sha from v_gc where high_pixels>0),
nb as (select distinct subtile_id, day, patch_row+dr as patch_row, patch_col+dc as patch_col from h, (values (-64),(0),(64)) a(dr), (values (-64),(0),(64)) b(dc) where not (dr=0 and dc=0)),
d as (select distinct spatial_group_id, subtile_id, patch_row, patch_col, day from h),
g as (select *, date_diff('day', lag(day) over (partition by spatial_group_id, subtile_id, patch_row, patch_col order by day), day) as gap from d),
p as (select spatial_group_id, subtile_id, patch_row, patch_col, count(*) as n, coalesce(bool_or(gap between 1 and 30),false) as close from g group by 1,2,3,4),
pp as (select spatial_group_id, count(*) as positions, count(*) filter (n>1) as positions_repeated, count(*) filter (close) as positions_repeated_within from p group by 1),
dup as (select spatial_group_id, sum(n-1)::bigint as extra from (select spatial_group_id, sha, count(*) as n from h group by 1,2) group by 1),
ne as (select h.spatial_group_id, count(*) as high_patches, count(nb.day) as with_neighbor from h left join nb on nb.subtile_id=h.subtile_id and nb.day=h.day and nb.patch_row=h.patch_row and nb.patch_col=h.patch_col group by 1)
"""


@BOOK.add("q13_component_independence", _INDEP + "select spatial_group_id, high_patches, positions, positions_repeated, positions_repeated_within, with_neighbor as high_patches_with_neighbor, extra as identical_extra_patches from ne join pp using (spatial_group_id) join dup using (spatial_group_id)")
def independence(spark, sf):
    return pools.independence(_biennial(spark, sf).withColumn("content", F.sha2(F.concat_ws("|", *S.CLASS_COLUMNS), 256)), "spatial_group_id", "content")


def _biennial(spark, sf):
    """High patches with their dates moved to the start of each second year."""
    day = F.make_date((F.floor(F.year("day") / 2) * 2).cast("int"), F.lit(1), F.lit(1))
    return grouped_census(spark, sf).where(F.col("high_pixels") > 0).withColumn("day", day)


@BOOK.add("j06_grid_neighbors", _INDEP + "select h.sample_id, nb.day is not null as has_neighbor from h left join nb on nb.subtile_id=h.subtile_id and nb.day=h.day and nb.patch_row=h.patch_row and nb.patch_col=h.patch_col")
def grid_neighbors(spark, sf):
    high = _biennial(spark, sf)
    return C.with_grid_neighbors(high, high, ["subtile_id", "day"]).select("sample_id", "has_neighbor")


_RANDOM = _SPLIT_SQL.replace("spatial_group_id", "sample_id")


@BOOK.add("j06_train_test_neighbors", _INDEP + f""", r as (select * replace ({_RANDOM} as split) from h) select t.sample_id, bool_or(n.sample_id is not null) as has_neighbor from (select * from r where split='test') t left join (select * from r where split='train') n
  on n.subtile_id=t.subtile_id and n.day=t.day and abs(n.patch_row-t.patch_row) in (0,64) and abs(n.patch_col-t.patch_col) in (0,64) and (n.patch_row<>t.patch_row or n.patch_col<>t.patch_col) group by 1""")
def train_test_neighbors(spark, sf):
    """Test patches of a random split with a train patch beside them on the same subtile and date."""
    rows = _biennial(spark, sf).withColumn("split", split_of(F.col("sample_id")))
    return C.with_grid_neighbors(rows.where("split = 'test'"), rows.where("split = 'train'"), ["subtile_id", "day"]).select("sample_id", "has_neighbor")
