"""Splits, hash-ranked selections and membership audits: D0-D2, D5-D8, D10-D12, W6-W10, J7-J9, J19, J20, X1-X4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import splits as SP
from ..operators import support as S
from ..operators.profiles import r6
from ..operators.ranking import global_rank
from .registry import Book
from .support import _GROUPED, _QUALIFIES, _SUPPORT, CRITERIA, grouped_census
from .views import logits, patches, pixels, table, with_views

BOOK = Book()
_PATCH = with_views("v_patch")


@BOOK.add("d00_global_rank", _PATCH + """select sample_id, row_number() over (order by sha256('35042:'||sample_id))-1 as rank, count(*) over () as total from v_patch""")
def rank(spark, sf):
    rows = patches(spark, sf).select("sample_id", N.salted_hash(F.col("sample_id")).alias("h"))
    return global_rank(rows, "h", total="total").select("sample_id", "rank", "total")


@BOOK.add("d01_random_split", _PATCH + """select sample_id, case when r<floor(n*0.8) then 'train' when r<floor(n*0.9) then 'validation' else 'test' end as split
  from (select sample_id, row_number() over (order by sha256('35042:'||sample_id))-1 as r, count(*) over () as n from v_patch)""")
def random_split(spark, sf):
    return SP.random_split(patches(spark, sf).select("sample_id"))


@BOOK.add("d02_stratified_split", _PATCH + """select sample_id, status, case when r<floor(n*0.8) then 'train' when r<floor(n*0.8)+floor(n*0.1) then 'validation' else 'test' end as split
  from (select sample_id, status, row_number() over (partition by status order by sha256('35042:'||sample_id))-1 as r, count(*) over (partition by status) as n from v_patch)""")
def stratified_split(spark, sf):
    return SP.stratified_split(patches(spark, sf).select("sample_id", "status"), "status").rows


@BOOK.add("d05_rotation_split", """select c_custkey::varchar as id, (['Training','Validation','Confirmation'])[(row_number() over (order by sha256('phase3a3-split-v1|'||c_custkey))-1)%3+1] as split from customer""")
def rotation(spark, sf):
    return SP.rotation_split(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id")), "id")


@BOOK.add("d06_declared_split", """select c_custkey, n_regionkey as "group", case when n_regionkey<3 then 'train' when n_regionkey=3 then 'validation' else 'test' end as split from customer join nation on c_nationkey=n_nationkey""")
def declared(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("group"))
    rows = table(spark, sf, "customer").join(nation, "c_nationkey").select("c_custkey", "group")
    k = F.col("r_regionkey")
    plan = table(spark, sf, "region").select(k.alias("group"), F.when(k < 3, "train").when(k == 3, "validation").otherwise("test").alias("split"))
    return SP.declared_split(rows, "group", plan).rows


_SAMPLES = _PATCH.rstrip() + """,
m as (select *, case when substr(sha256('35042:'||subtile_id),1,1) in ('0','1','2') then 'test' when substr(sha256('35042:'||subtile_id),1,1) in ('3','4') then 'validation' else 'train' end as split from v_patch)
"""


def membership(spark, sf):
    from .views import split_of
    return patches(spark, sf).withColumn("split", split_of(F.col("subtile_id")))


@BOOK.add("d08_partition_validation", _SAMPLES + """, f as (select split, 'spatial_group_id' as field, tile as value from m union all select split, 'footprint_id', sample_id from m
  union all select split, 'waterbody_ids', subtile_id from m union all select split, 'waterbody_ids', 'W'||(seq%500) from m)
select 'geographic_leakage' as rule, count(*) as n from (select field, value from f group by 1,2 having count(distinct split)>1)""")
def partition_validation(spark, sf):
    m = membership(spark, sf)
    rows = m.select("sample_id", F.col("tile").alias("spatial_group_id"), F.col("sample_id").alias("footprint_id"),
                    F.array("subtile_id", F.concat(F.lit("W"), (F.col("seq") % 500).cast("string"))).alias("waterbody_ids"),
                    F.when(F.col("status") == "F", 0).when(F.col("status") == "O", 1).otherwise(2).alias("class_id"))
    return SP.validate_partition(rows, m.select("sample_id", "split")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("d07_support_allocation", _SUPPORT + f""", el as (select *, sha256('35042:'||spatial_group_id) as h from v_sup where {_QUALIFIES}),
o as (select *, row_number() over (order by high_date_count desc, high_patch_positions desc, high_subtiles desc, h) as r,
  row_number() over (partition by tile order by high_date_count desc, high_patch_positions desc, high_subtiles desc, h) as rt from el),
t as (select spatial_group_id from o where rt=1 order by r limit 2), rest as (select spatial_group_id, row_number() over (order by r) as q from o where spatial_group_id not in (select * from t))
select spatial_group_id, 'test' as split from t union all select spatial_group_id, case when q<=1 then 'test' when q<=2 then 'validation' else 'train' end from rest where q<=4""")
def allocation(spark, sf):
    return S.allocate_components(S.group_support(grouped_census(spark, sf)), CRITERIA)[0]


@BOOK.add("d10_pixel_sample", with_views("v_px") + """, a as (select sample_id, pixel, sample_id||'|'||pixel as id, row_number() over (partition by sample_id order by sha256('35042:'||sample_id||'|'||pixel), sample_id||'|'||pixel) as rn from v_px where dn<=253)
select sample_id, pixel from (select *, row_number() over (order by sha256('35042-cap:'||id)) as g from a where rn<=40) where g<=3000""")
def pixel_sample(spark, sf):
    valid = pixels(spark, sf).where(F.col("dn") <= 253).select("sample_id", "pixel")
    return SP.pixel_sample(valid, "sample_id", "pixel", per_patch=40, cap=3000)


_LABELLED = with_views("v_logit").rstrip() + """, rows0 as (select pixel, y from v_logit where model='A' and y is not null), n as (select count(*)//3 as want from rows0),
sz as (select y, count(*) as size from rows0 group by 1), rk as (select *, row_number() over (partition by y order by sha256('35042:'||pixel))-1 as r from rows0)
"""


@BOOK.add("d11_balanced_sample", _LABELLED + """, d as (select sz.y, k as draw, ('0x'||substr(sha256('35042:'||sz.y||':'||k),1,8))::bigint % size as r from sz, n, range(0, want) t(k) where size<want)
select pixel, y, draw from rk join d using (y, r) union all select pixel, y, r from rk join sz using (y), n where size>=want and r<want""")
def balanced_sample(spark, sf):
    rows = logits(spark, sf).where((F.col("model") == "A") & F.col("y").isNotNull()).select("pixel", "y")
    return SP.balanced_sample(rows, "y", "pixel").select("pixel", "y", "draw")


@BOOK.add("d12_balanced_weights", _LABELLED + "select y, size as n, round((select count(*) from rows0)/(3.0::double*size),6) as weight from sz")
def balanced_weights(spark, sf):
    rows = logits(spark, sf).where((F.col("model") == "A") & F.col("y").isNotNull()).select("pixel", "y")
    return SP.balanced_weights(rows, "y").rows.withColumn("weight", r6(F.col("weight")))


@BOOK.add("w06_hash_capped", _PATCH + "select sample_id, subtile_id from (select *, row_number() over (partition by subtile_id order by sha256('35042:'||sample_id)) as rn from v_patch) where rn<=3")
def hash_capped(spark, sf):
    return SP.capped_per_group(patches(spark, sf).select("sample_id", "subtile_id"), ["subtile_id"], "sample_id", 3)


@BOOK.add("w07_screening_plan", _PATCH + """, rest as (select * from v_patch where archive<>'archive_1'),
d as (select subtile_id, day from (select subtile_id, day, row_number() over (partition by subtile_id order by sha256('35042:'||strftime(day,'%Y-%m-%d'))) as rn from (select distinct subtile_id, day from rest)) where rn<=3)
select sample_id, 'whole_archive' as reason from v_patch where archive='archive_1' union all select sample_id, 'screened' from
  (select sample_id, row_number() over (partition by subtile_id, day order by compressed_bytes desc, sha256('35042:'||sample_id)) as rn from rest join d using (subtile_id, day)) where rn<=2""")
def screening(spark, sf):
    entries = patches(spark, sf).select("sample_id", "subtile_id", "day", "compressed_bytes", "archive")
    return SP.screening_plan(entries, F.col("archive") == "archive_1", dates=3, per_date=2).select("sample_id", "reason")


_FOLLOW = _GROUPED + """, obs as (select * from v_gc where status<>'P'), cand as (select * from v_gc),
sup as (select spatial_group_id as g, sum(high_pixels) as h, count(distinct day) filter (high_pixels>0) as dc, min(day) filter (high_pixels>0) as d0, max(day) filter (high_pixels>0) as d1,
  count(distinct subtile_id||'|'||patch_row||'|'||patch_col) filter (high_pixels>0) as pos from obs group by 1),
tg as (select * from sup where h>0 and not (dc>=2 and date_diff('day',d0,d1)>=30 and pos>=2 and h>=2500)),
hp as (select distinct spatial_group_id as g, subtile_id, patch_row, patch_col from obs where high_pixels>0),
nb as (select distinct g, subtile_id, patch_row+dr as patch_row, patch_col+dc as patch_col from hp, (values (-64),(0),(64)) a(dr), (values (-64),(0),(64)) b(dc) where not (dr=0 and dc=0)),
pr as (select c.sample_id, tg.g, c.spatial_group_id, not (date_diff('day',d0,c.day)>=30 or date_diff('day',c.day,d1)>=30) as near_in_time,
  case when hp.g is not null then 0 when nb.g is not null then 1 else 2 end as distance, sha256('35042:'||strftime(c.day,'%Y-%m-%d')) as hd, sha256('35042:'||c.sample_id) as hs
  from cand c join tg on c.spatial_group_id=tg.g left join hp on hp.g=tg.g and hp.subtile_id=c.subtile_id and hp.patch_row=c.patch_row and hp.patch_col=c.patch_col
  left join nb on nb.g=tg.g and nb.subtile_id=c.subtile_id and nb.patch_row=c.patch_row and nb.patch_col=c.patch_col where c.sample_id not in (select sample_id from obs))
"""


@BOOK.add("w08_followup_priority", _FOLLOW + """select sample_id, spatial_group_id, near_in_time, distance from (select *, row_number() over (partition by g order by near_in_time, distance, hd, hs) as rn from pr) where rn<=20""")
def followup(spark, sf):
    g = grouped_census(spark, sf)
    out = SP.followup_plan(g, g.where(F.col("status") != "P"), "spatial_group_id", CRITERIA | {"minimum_high_pixels_per_component": 2500}, limit=20)
    return out.select("sample_id", "spatial_group_id", "near_in_time", "distance")


_ANCHOR = _GROUPED + """, h as (select *, sha256('35042:'||sample_id) as hs, min(day) over (partition by spatial_group_id) as d0, max(day) over (partition by spatial_group_id) as d1 from v_gc where high_pixels>0),
an as (select sample_id from (select sample_id, row_number() over (partition by spatial_group_id, day order by high_pixels desc, hs) as rn from h where day in (d0,d1)) where rn<=2),
q as (select *, row_number() over (partition by spatial_group_id order by case when sample_id in (select * from an) then 0 else 1 end, high_pixels desc, hs) as k, case when sample_id in (select * from an) then 0 else 1 end as turn from h),
f as (select *, (row_number() over (partition by spatial_group_id, day order by k)=1)::int as nd, (row_number() over (partition by spatial_group_id, subtile_id, patch_row, patch_col order by k)=1)::int as np from q),
r as (select *, coalesce(sum(nd) over w,0) as pd, coalesce(sum(np) over w,0) as pp, coalesce(sum(high_pixels) over w,0) as ph from f window w as (partition by spatial_group_id order by k rows between unbounded preceding and 1 preceding)),
kept as (select spatial_group_id, sample_id from r where turn=0 or not (date_diff('day',d0,d1)>=30 and pd>=2 and pp>=2 and ph>=400)),
cnt as (select spatial_group_id, count(*) as n from kept group by 1),
bg as (select v.spatial_group_id, v.sample_id, row_number() over (partition by v.spatial_group_id order by sha256('35042:'||v.sample_id)) as rn from v_gc v where v.sample_id not in (select sample_id from kept))
select spatial_group_id, sample_id, 'support_anchor' as inclusion_reason from kept union all
select bg.spatial_group_id, sample_id, 'hash_background' from bg left join cnt using (spatial_group_id) where rn <= 48-coalesce(n,0)"""


@BOOK.add("w09_anchored_selection", _ANCHOR)
def anchored(spark, sf):
    return SP.anchored_selection(grouped_census(spark, sf), "spatial_group_id", CRITERIA).rows


@BOOK.add("w10_evenly_spaced", _PATCH + """select sample_id from (select sample_id, row_number() over (order by sample_id)-1 as r, count(*) over () as n from v_patch) where r in (select i*(n-1)//7 from range(0,8) t(i))""")
def evenly(spark, sf):
    return SP.evenly_spaced(patches(spark, sf).select("sample_id"), "sample_id", 8)


@BOOK.add("j07_split_exposure", _SAMPLES + """, k as (select split, 'tile' as key, tile as value from m union all select split, 'day', strftime(day,'%Y-%m-%d') from m union all select split, 'subtile_id', subtile_id from m
  union all select split, 'status', case when status<>'P' then status end from m)
select key, count(*) filter (split='test') as test_rows, count(*) filter (split='test' and (key,value) in (select key,value from k where split='train' and value is not null)) as exposed_rows,
  count(distinct case when split='test' and (key,value) in (select key,value from k where split='train' and value is not null) then value end) as shared_values,
  round(count(*) filter (split='test' and (key,value) in (select key,value from k where split='train' and value is not null))/count(*) filter (split='test'),6) as fraction from k group by 1""")
def exposure(spark, sf):
    m = membership(spark, sf).select("split", "tile", F.col("day").cast("string").alias("day"), "subtile_id",
                                     F.when(F.col("status") != "P", F.col("status")).alias("status"))
    return SP.exposure(m, ["tile", "day", "subtile_id", "status"]).withColumn("fraction", r6(F.col("fraction")))


_IDS = _SAMPLES + """, ids as (select split, sample_id, tile as spatial_group_id, subtile_id as source_subtile, subtile_id||'_'||patch_row||'_'||patch_col as patch_position,
  sha256(compressed_bytes::varchar) as sen2_sha256, sha256(x||'|'||y) as cyan_sha256, strftime(day,'%Y-%m-%d') as date from m),
l as (select split, k, v from (unpivot ids on sample_id, spatial_group_id, source_subtile, patch_position, sen2_sha256, cyan_sha256, date into name k value v)),
fl as (select k, v, bool_or(split='train') as tr, bool_or(split='validation') as va, bool_or(split='test') as te from l group by 1,2),
c as (select k, count(*) filter (tr and va) as a, count(*) filter (tr and te) as b, count(*) filter (va and te) as c from fl group by 1),
def as (select * from (values ('sample_id','sample_id','VERIFIED'),('geographic_component','spatial_group_id','CANDIDATE'),('source_subtile','source_subtile','CANDIDATE'),('patch_position','patch_position','CANDIDATE'),
 ('sentinel_array_hash','sen2_sha256','VERIFIED_CONTENT'),('cyan_array_hash','cyan_sha256','VERIFIED_CONTENT'),('acquisition_date','date','DATE_ONLY'),('lake_waterbody_id',null,'UNKNOWN'),('sentinel_scene_id',null,'UNKNOWN'),
 ('footprint_geometry',null,'UNKNOWN'),('physical_footprint_overlap',null,'UNKNOWN'),('bloom_event_id',null,'UNKNOWN')) d(identity_type,k,evidence_level))
select *, case when overlap_count is null then 'UNKNOWN' when overlap_count=0 then 'NO_OVERLAP' else 'OVERLAP_OBSERVED' end as status from (
 select ls as left_split, rs as right_split, identity_type, evidence_level, case when def.k is null then null when ls='validation' then coalesce(c.c,0) when rs='test' then coalesce(c.b,0) else coalesce(c.a,0) end as overlap_count
 from def left join c using (k), (values ('train','validation'),('train','test'),('validation','test')) p(ls,rs))"""


@BOOK.add("j08_overlap_audit", _IDS)
def overlap_audit(spark, sf):
    m = membership(spark, sf)
    return SP.overlap_audit(m.select(
        "split", "sample_id", F.col("tile").alias("spatial_group_id"), F.col("subtile_id").alias("source_subtile"),
        F.concat_ws("_", "subtile_id", "patch_row", "patch_col").alias("patch_position"),
        F.sha2(F.col("compressed_bytes").cast("string"), 256).alias("sen2_sha256"), F.sha2(F.concat_ws("|", "x", "y"), 256).alias("cyan_sha256"),
        F.col("day").cast("string").alias("date")))


@BOOK.add("j09_partition_isolation", _SAMPLES + """, f as (select split, 'waterbody_id' as field, tile as value from m union all select split, 'scene_id', strftime(day,'%Y-%m-%d') from m union all select split, 'patch_identity', subtile_id from m union all select split, 'bloom_episode', case when month(day)<7 then 'UNKNOWN' else '' end from m)
select 'cross_partition' as rule, field||'='||value as key, '' as detail from f where trim(value)<>'' group by field, value having count(distinct split)>1""")
def isolation(spark, sf):
    m = membership(spark, sf).select("split", F.col("tile").alias("waterbody_id"), F.col("day").cast("string").alias("scene_id"), F.col("subtile_id").alias("patch_identity"),
                                    F.when(F.month("day") < 7, "UNKNOWN").otherwise("").alias("bloom_episode"))
    return SP.isolation_violations(m, ["waterbody_id", "scene_id", "patch_identity", "bloom_episode"])


@BOOK.add("j19_unseen_candidates", _PATCH + "select sample_id from v_patch where seq not in (select l_orderkey from lineitem where l_returnflag='R')")
def unseen(spark, sf):
    seen = table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("seq"))
    return patches(spark, sf).join(seen, "seq", "left_anti").select("sample_id")


_PRODUCTS = """, prod as (select distinct cast(l_shipdate as date) as day from lineitem where l_linestatus='F')
"""


@BOOK.add("j20_product_matching", _PATCH + _PRODUCTS + "select sample_id, strftime(p.day,'L%Y%j')||'.L3m_DAY_CYAN_CI_cyano_CYAN_CONUS_300m.tif' as product_id from v_patch p join prod using (day)")
def product_matching(spark, sf):
    return _matched(spark, sf)


def _products(spark, sf):
    day = F.col("l_shipdate").cast("date")
    return table(spark, sf, "lineitem").where(F.col("l_linestatus") == "F").select(day.alias("day")).distinct().select(
        N.product_name(F.col("day")).alias("product_id"))


def _matched(spark, sf):
    products = _products(spark, sf).withColumn("day", N.product_date(F.col("product_id")))
    return patches(spark, sf).select("sample_id", "day").join(products, "day").select("sample_id", "product_id")


@BOOK.add("x02_set_differences", _PATCH + _PRODUCTS + """, e as (select distinct day from v_patch) select strftime(day,'L%Y%j')||'.L3m_DAY_CYAN_CI_cyano_CYAN_CONUS_300m.tif' as product_id, side from
  (select day, 'missing' as side from e where day not in (select day from prod) union all select day, 'unexpected' from prod where day not in (select day from e))""")
def differences(spark, sf):
    return SP.set_differences(patches(spark, sf).select(N.product_name(F.col("day")).alias("product_id")), _products(spark, sf), "product_id")


@BOOK.add("x01_union_pools", """select 'pilot' as stage, o_orderkey as id, o_orderstatus as status, null::double as value from orders union all select 'pool', event_id, null, value from events where event_type<>'error'""")
def union_pools(spark, sf):
    pilot = table(spark, sf, "orders").select(F.lit("pilot").alias("stage"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    pool = table(spark, sf, "events").where(F.col("event_type") != "error").select(F.lit("pool").alias("stage"), F.col("event_id").alias("id"), "value")
    return pilot.unionByName(pool, allowMissingColumns=True)


@BOOK.add("x03_key_intersection", """select l_partkey as key from lineitem where l_returnflag='A' intersect select l_partkey from lineitem where l_returnflag='R'""")
def intersection(spark, sf):
    li = table(spark, sf, "lineitem")
    part = F.col("l_partkey").alias("key")
    return li.where(F.col("l_returnflag") == "A").select(part).intersect(li.where(F.col("l_returnflag") == "R").select(part))


@BOOK.add("x04_duplicate_keys", """select l_orderkey||'-'||l_linenumber as key, count(*) as n from lineitem group by 1 having count(*)>1""")
def duplicate_keys(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"))
    return SP.duplicates(li, "key")


@BOOK.add("d08_partition_faults", _SAMPLES.rstrip() + """, r as (select *, case when seq%17=3 then 7 when status='F' then 0 when status='O' and split<>'test' then 1 when status='O' then 0 else 2 end as class_id,
  case when seq%11=1 then null when seq%13=2 then 'holdout' else split end as part from m),
f as (select part, 'spatial_group_id' as field, tile as value from r union all select part, 'footprint_id', sample_id from r union all select part, 'waterbody_ids', subtile_id from r union all select part, 'waterbody_ids', 'W'||(seq%500) from r)
select 'unassigned_sample' as rule, sample_id as key from r where part is null
union all select 'unknown_sample', 'X'||sample_id from r where seq%19=4
union all select 'invalid_split', sample_id from r where part='holdout'
union all select 'invalid_class', sample_id from r where class_id=7
union all select 'geographic_leakage', field||'='||value from f where part is not null group by field, value having count(distinct part)>1
union all select 'missing_class', s||'='||c from (values ('train'),('validation'),('test')) t(s), (values (0),(1),(2)) u(c) where not exists (select 1 from r where part=s and class_id=c)""")
def partition_faults(spark, sf):
    """A membership with every fault: each of the six rules fires, row by row."""
    m = membership(spark, sf)
    seq = F.col("seq")
    kind = F.when(seq % 17 == 3, 7).when(F.col("status") == "F", 0).when((F.col("status") == "O") & (F.col("split") != "test"), 1).when(F.col("status") == "O", 0).otherwise(2)
    rows = m.select("sample_id", F.col("tile").alias("spatial_group_id"), F.col("sample_id").alias("footprint_id"),
                    F.array("subtile_id", F.concat(F.lit("W"), (seq % 500).cast("string"))).alias("waterbody_ids"), kind.alias("class_id"))
    given = m.where(seq % 11 != 1).select("sample_id", F.when(seq % 13 == 2, "holdout").otherwise(F.col("split")).alias("split"))
    strange = m.where(seq % 19 == 4).select(F.concat(F.lit("X"), "sample_id").alias("sample_id"), "split")
    return SP.validate_partition(rows, given.unionByName(strange)).select("rule", "key")
