"""Evidence and text audits: Q2-Q8, Q10-Q12, Q14, J3, P27, P28, S4, S5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import evidence as EV
from ..functions import names as N
from ..operators import audit as A
from ..operators import pools, profiles
from ..operators import support as S
from ..sources import features as FT
from .labels import _PROFILE_CTE, profile_frame
from .registry import Book
from .support import _GROUPED, _SUPPORT, grouped_census
from .views import patches, pixels, table, with_views

BOOK = Book()

_UNITS = """with rec as (select l_suppkey as s, l_returnflag as ord, count(*) as n, count(distinct l_shipdate) as dates, date_diff('day', min(l_shipdate), max(l_shipdate)) as span,
  count(*) filter (l_quantity>30) as hp, cast(sum(l_quantity) as bigint) as nat from lineitem group by 1,2),
unit as (select s, ord, case when s%4=0 then null else (s//2)::varchar end as waterbody_id, 'Lake  '||(s//3) as waterbody_name, (['true','yes','pass','no',''])[s%5+1] as identity_complete,
  case when s%2=0 then '7' else dates::varchar end as dates_with_high, case when s%7=0 then '12' when s%2=0 then '99' else span::varchar end as high_date_span_days,
  case when s%11=0 then '' else '5' end as verified_high_patches, case when s%3=0 then '250.0' else nat::varchar end as distinct_native_high_support,
  (['true','1','maybe'])[s%3+1] as provenance_complete_for_qualification, 'passed' as registration_mask_product_checks_pass, 'yes' as independence_resolved from rec)
"""


def unit_records(spark, sf):
    """Evidence records, three per supplier, with text fields of every kind."""
    rec = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("ord")).agg(
        F.count_distinct("l_shipdate").alias("dates"), F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).alias("span"), F.sum("l_quantity").cast("bigint").alias("nat"))
    s = F.col("s")

    def pick(*words):
        return F.get(F.array(*[F.lit(w) for w in words]), (s % len(words)).cast("int"))

    return rec.select(
        "ord", F.when(s % 4 != 0, F.expr("cast(s div 2 as string)")).alias("waterbody_id"), F.concat(F.lit("Lake  "), F.expr("cast(s div 3 as string)")).alias("waterbody_name"),
        pick("true", "yes", "pass", "no", "").alias("identity_complete"), F.when(s % 2 == 0, "7").otherwise(F.col("dates").cast("string")).alias("dates_with_high"),
        F.when(s % 7 == 0, "12").when(s % 2 == 0, "99").otherwise(F.col("span").cast("string")).alias("high_date_span_days"),
        F.when(s % 11 == 0, "").otherwise("5").alias("verified_high_patches"), F.when(s % 3 == 0, "250.0").otherwise(F.col("nat").cast("string")).alias("distinct_native_high_support"),
        pick("true", "1", "maybe").alias("provenance_complete_for_qualification"), F.lit("passed").alias("registration_mask_product_checks_pass"),
        F.lit("yes").alias("independence_resolved"), F.concat_ws("|", F.lpad(s.cast("string"), 12, "0"), "ord").alias("source_order"))


_GATE = """, ev as (select *, {conflict} as conflict, lower(trim(identity_complete)) as ic, lower(trim(provenance_complete_for_qualification)) as pc, trunc(try_cast(dates_with_high as double)) as d,
  trunc(try_cast(high_date_span_days as double)) as sp, trunc(try_cast(verified_high_patches as double)) as p, trunc(try_cast(distinct_native_high_support as double)) as nh from {src}),
gt as (select *, list_filter([case when ic in ('no','false','0') then 'verified_waterbody_identity_or_geometry' end, case when pc in ('no','false','0') then 'complete_sentinel_cyan_provenance' end, case when d<2 then 'at_least_2_high_dates' end,
  case when sp<30 then 'high_dates_separated_at_least_30_days' end, case when p<3 then 'at_least_3_nonoverlapping_high_patches' end, case when nh<100 then 'at_least_100_unique_dated_native_high_identities' end], lambda v: v is not null) as fl,
  list_filter([case when ic not in ('true','yes','pass','no','1') then 'missing_evidence:verified_waterbody_identity_or_geometry' end, case when pc not in ('true','1') then 'missing_evidence:complete_sentinel_cyan_provenance' end,
  case when d is null then 'missing_evidence:at_least_2_high_dates' end, case when sp is null then 'missing_evidence:high_dates_separated_at_least_30_days' end, case when p is null then 'missing_evidence:at_least_3_nonoverlapping_high_patches' end,
  case when nh is null then 'missing_evidence:at_least_100_unique_dated_native_high_identities' end], lambda v: v is not null) as ms from ev),
res as (select *, case when conflict then 'BLOCKED_CONFLICTING_EVIDENCE' when len(fl)>0 then 'EXCLUDED_NOT_QUALIFIED' when len(ms)>0 then 'BLOCKED_MISSING_EVIDENCE' else 'QUALIFIED' end as qualification_status,
  case when conflict then 'conflicting_evidence' else array_to_string(list_concat(fl, ms),';') end as exclusion_reason from gt)
"""


@BOOK.add("q05_unit_evaluation", _UNITS + _GATE.format(conflict="false", src="unit") + "select lpad(s::varchar,12,'0')||'|'||ord as source_order, qualification_status, exclusion_reason from res")
def unit_evaluation(spark, sf):
    return A.evaluate_units(unit_records(spark, sf).withColumn("evidence_conflict", F.lit("false"))).select("source_order", "qualification_status", "exclusion_reason")


_NORMAL = _UNITS + """, kd as (select *, lpad(s::varchar,12,'0')||'|'||ord as so, case when waterbody_id is not null then 'id:'||waterbody_id else 'name:'||regexp_replace(lower(waterbody_name),'\\s+',' ','g') end as k from unit),
un as (select * from (select *, row_number() over (partition by k order by so) as rn, count(*) over (partition by k) as dup from kd) where rn=1),
cf as (select k, """ + " or ".join(f"min(coalesce({f},''))<>max(coalesce({f},''))" for f in A.EVIDENCE_FIELDS) + """ as x from kd group by 1), uc as (select un.*, cf.x from un join cf using (k))
""" + _GATE.format(conflict="x", src="uc")


@BOOK.add("q06_unit_normalization", _NORMAL + "select k as canonical_unit_key, dup as duplicate_source_records, qualification_status, exclusion_reason from res")
def unit_normalization(spark, sf):
    return A.normalize_units(unit_records(spark, sf), "source_order").select("canonical_unit_key", "duplicate_source_records", "qualification_status", "exclusion_reason")


@BOOK.add("q11_readiness", _NORMAL + "select count(*) filter (qualification_status='QUALIFIED') as qualified_units, count(*) as units, case when count(*) filter (qualification_status='QUALIFIED')<9 then 'NOT READY' else 'READY FOR SPLIT REVIEW' end as readiness from res")
def readiness(spark, sf):
    return A.readiness(A.normalize_units(unit_records(spark, sf), "source_order"))


@BOOK.add("q02_high_unit_gate", """with u as (select o_custkey as k, count(distinct cast(o_orderdate as date)) as d, date_diff('day', min(o_orderdate), max(o_orderdate)) as sp, count(*) filter (o_orderstatus='F') as p, cast(sum(floor(o_totalprice/10000)) as bigint) as n from orders group by 1)
select k, array_to_string(list_filter([case when d<2 then 'insufficient_high_dates' when sp<30 then 'insufficient_date_separation' end, case when p<3 then 'insufficient_high_patches' end,
  case when n<100 then 'insufficient_unique_dated_native_high_pixels' end, case when k%3=0 then 'incomplete_provenance_or_independence_evidence' end], lambda v: v is not null),';') as failures from u""")
def high_unit_gate(spark, sf):
    u = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.collect_set(F.col("o_orderdate").cast("date")).alias("dates"), F.count_if(F.col("o_orderstatus") == "F").alias("p"),
        F.sum(F.floor(F.col("o_totalprice") / 10000)).alias("n"))
    return u.select("k", F.concat_ws(";", EV.high_unit_failures(F.col("dates"), F.col("p"), F.col("n"), F.col("k") % 3 != 0)).alias("failures"))


@BOOK.add("q03_status_gate", "select c_custkey, array_to_string(list_filter([" + ", ".join(
    f"case when (c_custkey+{i}*{i})%{i + 4}=0 then '{n}' end" for i, n in enumerate(EV.HIGH_UNIT_STATUSES)) + "], lambda v: v is not null),';') as failing from customer")
def status_gate(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", *[F.when((k + i * i) % (i + 4) == 0, EV.CANDIDATE).otherwise(EV.CONFIRMED).alias(n) for i, n in enumerate(EV.HIGH_UNIT_STATUSES)])
    return rows.select("c_custkey", F.concat_ws(";", EV.status_failures()).alias("failing"))


@BOOK.add("q04_candidate_gate", """with c as (select o_custkey as k, count(*) as patches, cast(sum(floor(o_totalprice/20000)) as bigint) as px from orders group by 1)
select k, array_to_string(list_filter([case when k%5=0 then 'waterbody_status!=CONFIRMED' end, case when k%6=0 then 'scene_status!=CONFIRMED' end, case when k%7=0 then 'footprint_status!=CONFIRMED' end,
  case when k%8=0 then 'cyan_version_status!=CONFIRMED' end, case when k%9=0 then 'historical_overlap_status!=NO_OVERLAP_CONFIRMED' end, case when px<100 then 'high_pixels<100' end, case when patches<3 then 'high_patches<3' end], lambda v: v is not null),';') as reasons from c""")
def candidate_gate(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("high_patches"), F.sum(F.floor(F.col("o_totalprice") / 20000)).alias("high_pixels"))
    rows = c.withColumns({n: F.when(F.col("k") % (i + 5) != 0, want) for i, (n, want) in enumerate(EV.CANDIDATE_STATUSES.items())})
    return rows.select("k", F.concat_ws(";", EV.candidate_reasons()).alias("reasons"))


@BOOK.add("q04_overlap_decision", "select c_nationkey as nation, case when count(*) filter (c_mktsegment='BUILDING' and c_acctbal>9900)=0 then 'CHECKABLE' else 'UNVERIFIED' end as decision from customer group by 1")
def overlap_decision(spark, sf):
    bad = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9900)
    rows = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.when(~bad, EV.CONFIRMED).alias("footprint_status"))
    return A.overlap_decision(rows, ["nation"])


@BOOK.add("j03_manifest_diff", """select o_orderkey as key, case when o_orderkey%13=1 then 'MISSING' when o_orderkey%13=2 then 'SANITIZED' when o_orderkey%13=3 then 'REGISTERED' when o_orderkey%13 in (4,5) then 'CHANGED' else 'MATCH' end as status from orders""")
def manifest_diff(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k, F.sha2(k.cast("string"), 256).alias("h"), F.sha2(F.concat(k.cast("string"), F.lit("x")), 256).alias("h2"), k.cast("string").alias("path"))
    m = k % 13
    observed = rows.where(m != 1).select("path", F.when(m.isin(2, 3, 4, 5), F.col("h2")).otherwise(F.col("h")).alias("sha256"))
    change = [F.col("path"), F.col("h").alias("before_sha256"), F.col("h2").alias("after_sha256")]
    amended = rows.where(m.isin(3, 4)).select(*change, F.when(m == 3, A.REGISTERED[0]).otherwise("unreviewed").alias("classification"))
    out = A.manifest_diff(rows.select("path", F.col("h").alias("expected_sha256")), observed, rows.where(m == 2).select(*change), amended).rows
    return out.select(F.col("path").cast("bigint").alias("key"), "status")


_PHRASES = r"licen[sc]e|copyright|and the|une? les"
_HITS = r"""with ln as (select doc_id, source, generate_subscripts(string_split(text, chr(10)),1) as line, regexp_replace(unnest(string_split(text, chr(10))), '\s+$', '') as l from documents),
m as (select *, regexp_extract_all(l, '(?i)(?:PAT)') as hits, string_split_regex(l, '(?i)(?:PAT)') as bt from ln where regexp_matches(l, '(?i)(?:PAT)')),
h as (select *, generate_subscripts(hits,1) as k, unnest(hits) as term from m)
""".replace("PAT", _PHRASES)


@BOOK.add("p27_phrase_hits", _HITS + """select doc_id, line, term, (coalesce(list_sum(list_transform(bt[1:k], lambda x: strlen(x))),0)+coalesce(list_sum(list_transform(hits[1:k-1], lambda x: strlen(x))),0))::bigint as start_byte, sha256(l) as line_sha256 from h""")
def phrase_hits(spark, sf):
    hits = A.phrase_hits(table(spark, sf, "documents"), "text", ["doc_id"], _PHRASES)
    return hits.select("doc_id", "line", "term", "start_byte", "line_sha256")


@BOOK.add("p27_scope_counts", _HITS + """select case when source like 'src1%' then 'source snapshot' when source like 'src0%' then 'historical' else 'current' end as scope, count(*) as hits, count(distinct doc_id||'|'||line) as "lines" from h group by 1""")
def scope_counts(spark, sf):
    hits = A.phrase_hits(table(spark, sf, "documents"), "text", ["doc_id", "source"], _PHRASES)
    scoped = hits.withColumn("scope", A.scope_of(F.col("source"), [("src1", "source snapshot"), ("src0", "historical")], "current"))
    per_line = scoped.groupBy("scope", "doc_id", "line").agg(F.count(F.lit(1)).alias("n"))
    return per_line.groupBy("scope").agg(F.sum("n").alias("hits"), F.count(F.lit(1)).alias("lines"))


@BOOK.add("p28_provenance_lookup", """select event_id, case when user_id%10=0 then 'LOCATOR_MISSING' when json_extract_string(props,'$.k')=(event_id%100)::varchar then 'VERIFIED' else 'DIFFERS' end as status from events""")
def provenance(spark, sf):
    e = table(spark, sf, "events").withColumn("source", F.col("event_id").cast("string"))
    claims = e.select("source", F.when(F.col("user_id") % 10 == 0, "a/0/b").otherwise("k").alias("locator"), (F.col("event_id") % 100).cast("string").alias("recorded"))
    out = A.provenance_check(claims, e.select("source", F.col("props").alias("document")))
    return out.select(F.col("source").cast("bigint").alias("event_id"), "status")


@BOOK.add("q07_qualification_catalog", with_views("v_px").rstrip() + """, d as (select sample_id, day, count(*) filter (dn between 200 and 253) as high, count(*) filter (dn between 199 and 253) as h199, count(*) filter (dn between 201 and 253) as h201, count(*) filter (dn<=253) as valid from v_px group by 1,2),
t as (select sample_id, max(cast(substr(sample_id,2) as bigint)) as u, count(*) filter (high>0) as hd, coalesce(date_diff('day', min(day) filter (high>0), max(day) filter (high>0)),0) as sp, sum(high)::bigint as ht, sum(h199)::bigint as h199, sum(h201)::bigint as h201, sum(valid)::bigint as v from d group by 1),
r as (select *, u%3=1 as scr, u%3=2 as hist, u%6=2 as ver from t)
select sample_id as name, case when scr then 'CONFIRMED_CURRENT_QUERY' when hist then 'CONFIRMED_HISTORICALLY_CURRENT_QUERY_FAILED' else 'UNVERIFIED' end as identity_status,
  case when scr then 'IDENTITY_AND_CYAN_SCREEN_COMPLETE_SENTINEL_NOT_ACQUIRED' when hist then 'EXISTING_PILOT_REAUDITED' else 'REJECTED_IDENTITY_UNAVAILABLE' end as catalog_disposition, hd as dates_with_high, sp as high_date_span_days, ht as high_total,
  array_to_string(list_filter([case when not (scr or hist) then 'authoritative_identity_or_geometry_unavailable' end, case when (case when ver then least(hd,1) else hd end)<2 then 'insufficient_high_dates' when sp<30 then 'insufficient_date_separation' end,
  case when not ver then 'insufficient_high_patches' end, case when not ver or ht<100 then 'insufficient_unique_dated_native_high_pixels' end, 'incomplete_provenance_or_independence_evidence'], lambda v: v is not null),';') as qualification_failure from r""")
def qualification_catalog(spark, sf):
    days = pools.daily_counts(pixels(spark, sf), ["sample_id"]).withColumnRenamed("sample_id", "name")
    u = F.substring("name", 2, 20).cast("bigint")
    names = days.select("name").distinct()
    records = names.select("name", F.when(u % 3 == 1, "SCREENED").otherwise("IDENTITY_UNAVAILABLE").alias("screening_status"), (u % 3 == 2).alias("historical"))
    verified = days.where(u % 6 == 2).groupBy("name").agg(F.lit(3).alias("high_patch_count"), F.sum("high").alias("native_high_pixels"),
                                                          F.array_compact(F.array(F.min(F.when(F.col("high") > 0, F.col("day"))))).alias("dates"))
    out = A.qualification_catalog(records, days.select("name", "day", "high", "high_199", "high_201", "valid"), verified)
    return out.select("name", "identity_status", "catalog_disposition", "dates_with_high", "high_date_span_days", "high_total", "qualification_failure")


@BOOK.add("q08_patch_catalog", with_views("v_patch") + """select sample_id, status as split, subtile_id, strftime(day,'%Y-%m-%d') as acquisition_date, printf('row[%d:%d),col[%d:%d)', patch_row, patch_row+64, patch_col, patch_col+64) as relative_window,
  'CANDIDATE' as cyan_product_status, 'UNVERIFIED' as scene_status, 'UNVERIFIED' as crs_status, 'UNVERIFIED' as footprint_status, 'UNVERIFIED' as waterbody_status, 'UNVERIFIED' as cyan_version_status,
  case when seq%3=0 then 'MISSING' else 'VERIFIED' end as artifact_status from v_patch""")
def patch_catalog(spark, sf):
    p = patches(spark, sf)
    rows = p.select("sample_id", F.col("status").alias("split"))
    return A.patch_catalog(rows, p.where(F.col("seq") % 3 != 0).select("sample_id", F.lit("VERIFIED").alias("status")))


@BOOK.add("q08_scene_catalog", with_views("v_patch") + """select sample_id, status as split, subtile_id||'|'||strftime(day,'%Y-%m-%d') as candidate_processing_run_group, 'CANDIDATE' as processing_run_group_status, 'BLOCKED_MISSING_CONFIRMED_GEOMETRY' as query_status, 'UNVERIFIED' as scene_status from v_patch""")
def scene_catalog(spark, sf):
    return A.scene_catalog(patches(spark, sf).select("sample_id", F.col("status").alias("split")))


@BOOK.add("q08_candidate_list", _SUPPORT + """, dt as (select spatial_group_id, string_agg(distinct strftime(day,'%Y-%m-%d'),'|' order by strftime(day,'%Y-%m-%d')) as dates from v_gc where high_pixels>0 group by 1), sel as (select distinct spatial_group_id from v_gc where split='test')
select spatial_group_id, dates as acquisition_dates, high_date_count, high_pixels, high_patches, high_date_span_days, case when spatial_group_id in (select * from sel) then 'LEGACY_SELECTED' else 'LEGACY_SCREENED_NOT_BLIND' end as historical_overlap_status,
  array_to_string(list_filter(['waterbody_status!=CONFIRMED','scene_status!=CONFIRMED','footprint_status!=CONFIRMED','cyan_version_status!=CONFIRMED','historical_overlap_status!=NO_OVERLAP_CONFIRMED',
  case when high_pixels<100 then 'high_pixels<100' end, case when high_patches<3 then 'high_patches<3' end], lambda v: v is not null),';') as rejection_reason from v_sup join dt using (spatial_group_id) where high_pixels>0""")
def candidate_list(spark, sf):
    g = grouped_census(spark, sf)
    return A.candidate_list(S.group_support(g), g.where(F.col("split") == "test"))


@BOOK.add("q10_identity_audit", """select 'verified_pilot' as stage, o_custkey::varchar as waterbody_id, o_orderkey::varchar as scene_id, 'PASS_NATIVE_CENTER_INTERSECTION' as overlap_check, o_orderkey as valid_support, 'EXCLUDED_NOT_QUALIFIED' as qualification_status from orders
union all select 'candidate_pool', c_custkey::varchar, null, case when c_nationkey%2=0 then 'NOT_RUN_NO_SENTINEL_PATCH' else 'NOT_RUN_IDENTITY_UNAVAILABLE' end, c_custkey, 'EXCLUDED_INCOMPLETE_UNIT' from customer where c_mktsegment<>'BUILDING'""")
def identity_audit(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    pilot = o.select(F.col("o_custkey").cast("string").alias("waterbody_id"), F.col("o_orderkey").cast("string").alias("scene_id"), F.col("o_orderkey").alias("valid_support"), F.lit(0).alias("high_support"))
    pool = c.select(F.col("c_custkey").cast("string").alias("waterbody_id"), F.when(F.col("c_nationkey") % 2 == 0, "CONFIRMED_CURRENT").otherwise("UNVERIFIED").alias("identity_status"),
                    F.when(F.col("c_mktsegment") == "BUILDING", "existing_pilot").otherwise("new_pool").alias("origin"), F.col("c_custkey").alias("valid_support"), F.lit(0).alias("high_support"))
    return A.identity_audit(pilot, pool).drop("high_support")


@BOOK.add("q12_array_provenance", with_views("v_patch") + """select rebuild_status, status, count(*) as n from (select case when seq%5=0 then 'MISSING_LOCAL' else 'VERIFIED' end as status, case when seq%5=0 and kind='sen2' then 'NOT_RECOVERED_REQUIRES_DIRECTORY_ENTRY' when seq%5=0 then 'NOT_RECOVERED'
  when kind='cyan' and seq%7=0 then 'RECOVERED_AND_VERIFIED' else 'LOCAL_FILE_VERIFIED' end as rebuild_status from v_patch, (values ('sen2'),('cyan')) k(kind)) group by 1,2""")
def array_provenance(spark, sf):
    p = patches(spark, sf)
    arrays = p.select("sample_id", "archive", "seq", F.explode(F.array(F.lit("sen2"), F.lit("cyan"))).alias("kind"))
    verified = arrays.where(F.col("seq") % 5 != 0).select("sample_id", "kind", F.lit("VERIFIED").alias("status"))
    sources = p.select("archive").distinct().withColumn("checksum", F.md5("archive"))  # one row per archive
    out = A.array_provenance(arrays.drop("seq"), sources, verified, p.where(F.col("seq") % 7 == 0))
    return out.groupBy("rebuild_status", "status").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("q14_sample_label_audit", _PROFILE_CTE.rstrip() + """, hg as (select sample_id, string_agg(dn||':'||n, ',' order by dn) as histogram from (select sample_id, dn, count(*) as n from v_px group by 1,2) group by 1), cp as (select sample_id, 'component:'||min(tile) as component from v_px group by 1)
select sample_id, valid_pixels, median_bin, majority_bin, histogram, component, 'UNKNOWN' as coordinate_status, 'UNVERIFIED' as geography_status, 'UNVERIFIED' as label_status from profile join hg using (sample_id) join cp using (sample_id)""")
def label_audit(spark, sf):
    px = pixels(spark, sf)
    hist = profiles.dn_histogram(px, ["sample_id"])
    text = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("histogram")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))))
    groups = px.groupBy("sample_id").agg(F.concat(F.lit("component:"), F.min("tile")).alias("component"))
    out = A.label_audit(profile_frame(spark, sf), hist.select("sample_id", text.alias("histogram")), groups)
    return out.select("sample_id", "valid_pixels", "median_bin", "majority_bin", "histogram", "component", "coordinate_status", "geography_status", "label_status")


def scene_items(spark, sf):
    """Catalog items as JSON texts, one per order, parsed with the fixed schema."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    ident = F.concat(F.lit("S2A_MSIL2A_"), day, F.lit("T101010_N0500_R"), F.lpad((k % 143).cast("string"), 3, "0"), F.lit("_T"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("ABC_"), day, F.when(k % 17 == 0, "").otherwise("T121212"))
    level = F.when(k % 19 == 0, "L1").otherwise("L2")
    rot = F.when(k % 23 == 0, "0.5").otherwise("0")
    check = F.when(k % 29 == 0, "").otherwise("1220ab")
    text = F.concat(F.lit('{"id":"'), ident, F.lit('","properties":{"datetime":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T10:10:10Z","processing:level":"'), level,
                    F.lit('","eo:cloud_cover":'), (k % 100).cast("string"), F.lit('},"assets":{"B04":{"proj:code":"EPSG:32617","proj:transform":[10,'), rot, F.lit(",399960,0,-10,"), (k % 1000 * 10).cast("string"),
                    F.lit('],"proj:shape":[10980,10980],"file:checksum":"'), check, F.lit('"}}}'))
    return table(spark, sf, "orders").select(F.from_json(text, FT.SCENE_SCHEMA).alias("j")).select("j.*")


@BOOK.add("s04_scene_catalog", """select o_orderkey%60 as tile, count(*) as scenes, sum(o_orderkey%100)::double as cloud, sum(o_orderkey%1000*10)::double as origin_y, count(*) filter (year(o_orderdate)>1995) as recent from orders where o_orderkey%17<>0 and o_orderkey%19<>0 and o_orderkey%23<>0 and o_orderkey%29<>0 group by 1""")
def scene_catalog_scan(spark, sf):
    good = FT.scene_grids(scene_items(spark, sf), "B04").rows
    tile = F.regexp_extract("id", r"_T(\d{2})ABC_", 1).cast("bigint")
    return good.groupBy(tile.alias("tile")).agg(F.count(F.lit(1)).alias("scenes"), F.sum("cloud_cover").alias("cloud"), F.sum("origin_y").alias("origin_y"),
                                                F.count_if(F.year("observed_at") > 1995).alias("recent"))


@BOOK.add("s04_scene_rejects", """select rule, count(*) as n from (select case when o_orderkey%17=0 then 'invalid_scene_id' when o_orderkey%19=0 then 'not_level_2' when o_orderkey%23=0 then 'rotated_grid' when o_orderkey%29=0 then 'missing_checksum' end as rule from orders) where rule is not null group by 1""")
def scene_rejects(spark, sf):
    return FT.scene_grids(scene_items(spark, sf), "B04").violations.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("s05_listing_links", r"""select l as file, count(*) as pages from (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"?]+)"', 1))) as l from pages) group by 1""")
def listing_links(spark, sf):
    return FT.listing_links(table(spark, sf, "pages"), "html", r'href="([^"?]+)"')


@BOOK.add("p28_range_locators", """with d as (select l_orderkey as seq, count(*) as n, '['||min(l_discount)||','||max(l_discount)||']' as span from lineitem group by 1),
c as (select *, 'len(samples)' as locator, case when seq%7=0 then null else n::varchar end as found, (n+case when seq%5=0 then 1 else 0 end)::varchar as recorded from d
  union all select *, 'regional_high_range:best', case when seq%11=0 then null else span end, case when seq%3=0 then '[0.0,1.0]' else span end from d)
select seq, locator, found, case when seq%13=0 then 'SOURCE_MISSING' when found is null then 'LOCATOR_MISSING' when found=recorded then 'VERIFIED' else 'DIFFERS' end as status from (select * replace (case when seq%13=0 then null else found end as found) from c)""")
def range_locators(spark, sf):
    """Lengths and ranges looked up in one JSON document per order; one in thirteen orders has none."""
    key = F.col("l_orderkey").alias("seq")
    lines = table(spark, sf, "lineitem").groupBy(key).agg(F.collect_list(F.struct("l_linenumber", "l_discount")).alias("lines"), F.count(F.lit(1)).alias("n"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))
    score = F.transform("lines", lambda x: F.array(*[F.struct(v.alias("f1")) for v in (F.lit(0.5), F.lit(0.25), x["l_discount"])]))
    groups = F.map_from_entries(F.zip_with(F.sequence(F.lit(1), F.size("lines")), score, lambda i, s: F.struct(F.concat(F.lit("g"), i.cast("string")), F.struct(s.alias("per_class")))))
    seq = F.col("seq")
    record = F.struct(F.when(seq % 7 != 0, F.transform("lines", lambda x: x["l_linenumber"])).alias("samples"), F.when(seq % 11 != 0, F.struct(groups.alias("test_groups"))).alias("best"))
    source = seq.cast("string").alias("source")
    claims = lines.select(source, F.explode(F.array(
        F.struct(F.lit("len(samples)").alias("locator"), (F.col("n") + F.when(seq % 5 == 0, 1).otherwise(0)).cast("string").alias("recorded")),
        F.struct(F.lit("regional_high_range:best").alias("locator"), F.when(seq % 3 == 0, "[0.0,1.0]").otherwise(
            F.concat(F.lit("["), F.col("low").cast("string"), F.lit(","), F.col("high").cast("string"), F.lit("]"))).alias("recorded")))).alias("c")).select("source", "c.*")
    out = A.provenance_check(claims, lines.where(seq % 13 != 0).select(source, F.to_json(record).alias("document")))
    return out.select(F.col("source").cast("bigint").alias("seq"), "locator", "found", "status")
