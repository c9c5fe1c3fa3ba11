"""Ordered intervals: W1-W3, S6, J11, W11."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as IV
from ..operators.ranking import first_per_group
from .registry import Book
from .views import patches, table, with_views

BOOK = Book()
_ENTRIES = with_views("v_patch").rstrip() + """,
en as (select sample_id, archive, seq*400000 + compressed_bytes as header_offset from v_patch), ends as (select archive, max(header_offset)+777 as directory_start from en group by 1)
"""


def entries(spark, sf):
    return patches(spark, sf).select("sample_id", "archive", (F.col("seq") * 400000 + F.col("compressed_bytes")).alias("header_offset"))


@BOOK.add("w01_span_to_next", _ENTRIES + "select sample_id, coalesce(lead(header_offset) over (partition by archive order by header_offset), directory_start) - header_offset as span_bytes from en join ends using (archive)")
def spans(spark, sf):
    e = entries(spark, sf)
    ends = e.groupBy("archive").agg((F.max("header_offset") + 777).alias("directory_start"))
    return IV.span_to_next(e, "archive", "header_offset", ends, "directory_start").select("sample_id", "span_bytes")


_RANGES = """with iv as (select o_orderkey as id, o_custkey%7 as archive, o_orderkey*100 + o_custkey%90 as a, o_orderkey*100 + o_custkey%90 + cast(floor(o_totalprice) as bigint)%140 as b from orders),
fl as (select *, case when max(b) over (partition by archive order by a, b rows between unbounded preceding and 1 preceding) >= a-601 then 0 else 1 end as opens from iv),
isl as (select *, sum(opens) over (partition by archive order by a, b rows unbounded preceding) as island from fl)
"""


def ranges(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start = k * 100 + c % 90
    return table(spark, sf, "orders").select(k.alias("id"), (c % 7).alias("archive"), start.alias("a"),
                                             (start + F.floor("o_totalprice").cast("bigint") % 140).alias("b"))


def _owned(spark, sf):
    return IV.coalesce_intervals(ranges(spark, sf), ["archive"], "a", "b", gap=601)


@BOOK.add("w02_coalesced_ranges", _RANGES + "select archive, min(a) as range_start, max(b) as range_end, count(*) as members from isl group by archive, island")
def coalesced(spark, sf):
    return IV.islands(_owned(spark, sf), ["archive"], "a", "b").drop("island")


@BOOK.add("w03_interval_owner", _RANGES + "select id, archive, island::bigint as island from isl")
def owner(spark, sf):
    return _owned(spark, sf).select("id", "archive", "island")


@BOOK.add("s06_charge_ledger", """with r as (select event_id, event_type as log, cast(floor(value) as bigint) as n, sum(cast(floor(value) as bigint)) over (partition by event_type order by event_id rows unbounded preceding)::bigint as s from events),
m as (select *, bool_or(s>60000 or n<0) over w as stopped, bool_or(s>60000 or n<0) over (partition by log order by event_id rows between unbounded preceding and 1 preceding) as earlier from r window w as (partition by log order by event_id rows unbounded preceding))
select event_id, log, max(case when not stopped then s else 0 end) over (partition by log order by event_id rows unbounded preceding) as used,
  case when coalesce(earlier,false) then 'NOT_ATTEMPTED' when stopped then 'REFUSED' else 'ACCEPTED' end as status from m""")
def ledger(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.col("event_type").alias("log"), F.floor("value").cast("bigint").alias("bytes"))
    out = IV.charge_ledger(events, "log", "event_id", "bytes", F.lit(60000))
    return out.rows.select("event_id", "log", "used", "status")


@BOOK.add("j11_near_temporal_duplicates", """with d as (select c_nationkey as waterbody, cast(o_orderdate as date) as day, count(*) as n from orders join customer on o_custkey=c_custkey group by 1,2)
select l.waterbody, strftime(l.day,'%Y-%m-%d') as left_day, strftime(r.day,'%Y-%m-%d') as right_day, date_diff('day',l.day,r.day) as days, case when l.day=r.day then l.n*(l.n-1)//2 else l.n*r.n end as pairs
  from d l join d r on l.waterbody=r.waterbody and date_diff('day',l.day,r.day) between 0 and 5""")
def near_duplicates(spark, sf):
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("waterbody"))
    rows = table(spark, sf, "orders").join(who, "o_custkey").select("waterbody", F.col("o_orderdate").cast("date").alias("day"))
    out = IV.near_in_time(rows, "waterbody", "day", 5)
    return out.select("waterbody", F.col("left_day").cast("string").alias("left_day"), F.col("right_day").cast("string").alias("right_day"), "days", "pairs")


@BOOK.add("w11_best_scene", """select window_id, scene, cloud from (select o_custkey as window_id, o_orderkey as scene, floor(o_totalprice/10000) as cloud,
  row_number() over (partition by o_custkey order by floor(o_totalprice/10000), o_orderdate, o_orderkey) as rn from orders where floor(o_totalprice/10000)<=20 and o_orderstatus<>'P') where rn=1""")
def best_scene(spark, sf):
    scenes = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("window_id"), F.col("o_orderkey").alias("scene"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("cloud"),
        F.col("o_orderdate").alias("at"), "o_orderstatus")
    eligible = scenes.where((F.col("cloud") <= 20) & (F.col("o_orderstatus") != "P"))
    return first_per_group(eligible, ["window_id"], [F.asc("cloud"), F.asc("at"), F.asc("scene")]).select("window_id", "scene", "cloud")
