"""Identity parsing, hashes, calendar and evidence predicates: P1, P2, P11-P21."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checks import missing_fields
from ..functions import evidence as EV
from ..functions import names as N
from .registry import Book
from .views import patches, table, with_views

BOOK = Book()

_MEMBERS = with_views("v_patch").rstrip() + """,
v_member as (select seq, kind, case when seq%50=7 then '../' when seq%50=13 then '/' else '' end || archive || '/' ||
  case when seq%50=11 then regexp_replace(sample_id, '_\\d{4}_\\d{2}_\\d{2}_', '_2019_02_30_') else sample_id end || '_' || kind ||
  case when seq%50=9 then '.txt' else '.npy' end as member from v_patch, (values ('sen2'),('cyan')) k(kind))
"""


def members(spark, sf):
    """Archive member names of every patch; a few positions are spoiled to show each rejection."""
    p = patches(spark, sf).withColumn("kind", F.explode(F.array(F.lit("sen2"), F.lit("cyan"))))
    s = F.col("seq") % 50
    prefix = F.when(s == 7, "../").when(s == 13, "/").otherwise("")
    body = F.when(s == 11, F.regexp_replace("sample_id", r"_\d{4}_\d{2}_\d{2}_", "_2019_02_30_")).otherwise(F.col("sample_id"))
    suffix = F.when(s == 9, ".txt").otherwise(".npy")
    return p.select("seq", "kind", F.concat(prefix, "archive", F.lit("/"), body, F.lit("_"), "kind", suffix).alias("member"))


@BOOK.add("p01_parse_member", _MEMBERS + """select member, case when seq%50 in (7,13) then 'unsafe_path' when seq%50=9 then 'unrecognized'
  when seq%50=11 then 'impossible_date' end as reject, case when seq%50<>9 then tile end as region, case when seq%50<>9 then x end as subtile_x,
  case when seq%50<>9 then y end as subtile_y, case when seq%50 not in (9,11) then strftime(day,'%Y-%m-%d') end as acquisition_date,
  case when seq%50=11 then regexp_replace(sample_id, '_\\d{4}_\\d{2}_\\d{2}_', '_2019_02_30_') when seq%50<>9 then sample_id end as sample_id,
  case when seq%50<>9 then subtile_id||'_x'||patch_row||'_y'||patch_col end as grid_position, case when seq%50<>9 then m.kind end as kind
  from v_member m join v_patch using (seq)""")
def parse_member(spark, sf):
    fields = ("reject", "region", "subtile_x", "subtile_y", "sample_id", "grid_position", "kind")
    return N.with_member(members(spark, sf)).select(
        "member", *[f"parsed.{n}" for n in fields],
        F.date_format("parsed.acquisition_date", "yyyy-MM-dd").alias("acquisition_date"))


@BOOK.add("p02_sample_id_cross_check", with_views("v_patch") + """select sample_id, subtile_id||'_x'||patch_row||'_y'||patch_col||'_64x64' as patch_position,
  case when seq%37=5 then 'date_conflict' when seq%37=6 then 'subtile_conflict' end as conflict from v_patch""")
def cross_check(spark, sf):
    s = F.col("seq") % 37
    rows = patches(spark, sf).select(
        "sample_id", F.when(s == 5, F.date_add("day", 1)).otherwise(F.col("day")).alias("manifest_day"),
        F.when(s == 6, F.lit("elsewhere")).otherwise(F.col("subtile_id")).alias("manifest_subtile"))
    p = N.with_sample(rows)
    return p.select("sample_id", "parsed.patch_position", F.when(F.col("parsed.reject").isNotNull(), F.col("parsed.reject"))
                    .when(F.col("parsed.acquisition_date") != F.col("manifest_day"), "date_conflict")
                    .when(F.col("parsed.subtile_id") != F.col("manifest_subtile"), "subtile_conflict").alias("conflict"))


@BOOK.add("p11_product_names", """select o_orderkey as k, printf('L%s.L3m_DAY_CYAN_CI_cyano_CYAN_CONUS_300m.tif', strftime(o_orderdate,'%Y%j')) as product,
  strftime(o_orderdate,'%Y-%m-%d') as product_day, case when year(o_orderdate)%4=0 then printf('%d-12-31', year(o_orderdate)) end as day_366 from orders""")
def product_names(spark, sf):
    day = F.col("o_orderdate").cast("date")
    leap = F.concat(F.lit("L"), F.year(day).cast("string"), F.lit("366" + N.PRODUCT_SUFFIX))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), N.product_name(day).alias("product"),
        N.product_date(N.product_name(day)).cast("string").alias("product_day"), N.product_date(leap).cast("string").alias("day_366"))


@BOOK.add("p12_temporal_match", """select event_id, abs(date_diff('day', cast(ts as date), cast(ts as date) + cast(user_id%9-4 as int))) as days from events""")
def temporal_match(spark, sf):
    e = table(spark, sf, "events")
    product = N.product_name(F.date_add(F.col("ts").cast("date"), (F.col("user_id") % 9 - 4).cast("int")))
    return e.select("event_id", N.temporal_match_days(F.col("ts"), product).alias("days"))


_WORDS = ("true", " Yes", "PASS", "passed", "1", "false", "no", "Failed", "0", "maybe", "", "UNKNOWN")


@BOOK.add("p13_tristate", """select event_id, case when w in ('true','1','yes','pass','passed') then true when w in ('false','0','no','fail','failed') then false end as flag,
  cast(trunc(value) as bigint) as whole from (select event_id, value, lower(trim((['true',' Yes','PASS','passed','1','false','no','Failed','0','maybe','','UNKNOWN'])[event_id%12+1])) as w from events)""")
def tristate(spark, sf):
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("event_id") % 12 + 1).cast("int"))
    return table(spark, sf, "events").select(
        "event_id", EV.tristate(word).alias("flag"), EV.lenient_int(F.concat(F.lit(" "), F.col("value").cast("string"))).alias("whole"))


@BOOK.add("p14_canonical_unit_key", """select c_custkey, case when c_custkey%3=0 then 'id:'||c_custkey else 'name:'||lower(c_mktsegment)||' '||lower(c_name) end as unit_key from customer""")
def unit_key(spark, sf):
    k = F.col("c_custkey")
    unit = F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit(" "))).when(k % 3 == 1, "NaN")
    return table(spark, sf, "customer").select(
        "c_custkey", EV.canonical_unit_key(unit, F.concat(F.lit(" "), "c_mktsegment", F.lit("   "), "c_name")).alias("unit_key"))


@BOOK.add("p15_calendar_buckets", """select year(o_orderdate) as year, month(o_orderdate) as month, case when month(o_orderdate) in (12,1,2) then 'DJF' when month(o_orderdate) in (3,4,5) then 'MAM'
  when month(o_orderdate) in (6,7,8) then 'JJA' else 'SON' end as season, count(*) as n from orders group by 1,2,3""")
def calendar(spark, sf):
    day = F.col("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.year(day).alias("year"), F.month(day).alias("month"), N.season(day).alias("season")).agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("p16_scene_identity", """select c_custkey, case when c_nationkey%4=0 then 'CONFIRMED' when c_custkey%3>0 then 'CANDIDATE' else 'UNVERIFIED' end as status,
  case when c_nationkey%4=0 then c_name when c_custkey%3=1 then 'S'||c_custkey end as scene_id from customer""")
def scene_identity(spark, sf):
    k = F.col("c_custkey")
    hit = F.concat(F.lit("S"), k.cast("string"))
    hits = F.slice(F.array(hit, F.concat(hit, F.lit("b"))), F.lit(1), (k % 3).cast("int"))
    status, scene = EV.scene_identity(F.when(F.col("c_nationkey") % 4 == 0, F.col("c_name")), hits)
    return table(spark, sf, "customer").select("c_custkey", EV.require_level(status).alias("status"), scene.alias("scene_id"))


@BOOK.add("p17_identity_strings", with_views("v_patch") + """select seq, printf('row[%d:%d),col[%d:%d)', patch_row, patch_row+64, patch_col, patch_col+64) as window_text,
  subtile_id||'::B04::r'||patch_row||'::c'||patch_col as patch_identity, 'prod|r'||patch_row||'|c'||patch_col as native_identity,
  case when status<>'P' then status||'|'||subtile_id||'|'||sample_id end as group_identity,
  printf('POLYGON ((%.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f))', x::double, y::double, x::double, y+50.0::double, x+50.0::double, y+50.0::double, x+50.0::double, y::double, x::double, y::double) as wkt from v_patch""")
def identity_strings(spark, sf):
    x, y, r, c = F.col("x").cast("double"), F.col("y").cast("double"), F.col("patch_row"), F.col("patch_col")
    status = F.when(F.col("status") != "P", F.col("status")).otherwise("")
    return patches(spark, sf).select(
        "seq", N.window_text(r, c, F.lit(64)).alias("window_text"),
        N.patch_identity(F.col("subtile_id"), F.lit("B04"), r, c).alias("patch_identity"),
        N.native_identity(F.lit("prod"), r, c).alias("native_identity"),
        N.conservative_group(status, F.col("subtile_id"), F.col("sample_id")).alias("group_identity"),
        N.box_wkt(x, y, x + 50, y + 50).alias("wkt"))


@BOOK.add("p18_verified_geography", """select c_custkey, array_to_string(list_filter([case when c_custkey%7=0 then 'geography_status' end, case when c_nationkey=3 then 'spatial_group_id' end,
  case when c_mktsegment='BUILDING' then 'footprint_id' end, case when c_custkey%11=0 then 'waterbody_ids' end, case when c_acctbal/100>90 then 'latitude' end,
  case when c_acctbal/50>180 then 'longitude' end], lambda v: v is not null), ',') as failures from customer""")
def verified_geography(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.when(k % 7 == 0, "PENDING").otherwise("VERIFIED").alias("geography_status"),
        F.when(F.col("c_nationkey") == 3, "candidate_group").otherwise(F.col("c_name")).alias("spatial_group_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise("fp").alias("footprint_id"), F.lit("survey").alias("geography_evidence"),
        F.when(k % 11 == 0, F.array(F.lit("w1"), F.lit("UNKNOWN"))).otherwise(F.array(F.lit("w1"))).alias("waterbody_ids"),
        (F.col("c_acctbal") / 100).alias("latitude"), (F.col("c_acctbal") / 50).alias("longitude"))
    return rows.select("c_custkey", F.concat_ws(",", EV.geography_failures()).alias("failures"))


@BOOK.add("p19_required_fields", """select o_orderkey, array_to_string(list_filter([case when o_orderstatus='P' then 'scene_id' end, case when o_orderkey%5=0 then 'footprint_id' end], lambda v: v is not null), ',') as missing from orders""")
def required(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "UNKNOWN").otherwise(F.col("o_orderstatus")).alias("scene_id"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("footprint_id"), F.col("o_orderpriority").alias("waterbody_id"))
    return rows.select("o_orderkey", F.concat_ws(",", missing_fields("scene_id", "footprint_id", "waterbody_id")).alias("missing"))


@BOOK.add("p20_row_hash", """select c_custkey, sha256('{"c_custkey":'||c_custkey||',"c_mktsegment":"'||c_mktsegment||'","c_name":"'||c_name||'","c_nationkey":'||c_nationkey||'}') as row_hash from customer""")
def row_hash(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", N.row_hash("c_nationkey", "c_name", "c_mktsegment", "c_custkey").alias("row_hash"))


@BOOK.add("p21_salted_hash", with_views("v_patch") + """select sample_id, sha256('35042:'||sample_id) as rank_key,
  xor(('0x'||substr(sha256(sample_id),1,8))::bigint, 42) as seed from v_patch""")
def salted_hash(spark, sf):
    s = F.col("sample_id")
    return patches(spark, sf).select("sample_id", N.salted_hash(s).alias("rank_key"), N.sample_seed(s).alias("seed"))
