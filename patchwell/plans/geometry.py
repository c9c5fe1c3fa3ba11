"""Polygons, masks, projections and raster alignment: P23-P25, S7, G1-G8, A9, A10, J10."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geodesy as GD
from ..operators import geometry as G
from ..operators import raster as R
from ..operators.profiles import r6
from ..sources import features as FT
from .registry import Book
from .views import patches, table, with_views

BOOK = Book()

# Offsets of the rings drawn around each supplier: outer ring, hole, second part.
OUTER = ((-40, -30), (40, -30), (50, 10), (0, 45), (-50, 10))
HOLE = ((-10, -10), (10, -10), (10, 10), (-10, 10))
SECOND = ((90, -20), (130, -20), (130, 20), (90, 20))
GRID = {"width": 120, "height": 110, "origin_x": 0.0, "origin_y": 1100.0, "pixel_size": 10.0}


def feature_texts(spark, sf):
    """One GeoJSON text per supplier: a polygon, with a hole for every third, two parts for every fifth."""
    s = F.col("s_suppkey")
    cx, cy = s * 37 % 900 + 60, s * 91 % 900 + 60

    def ring(points):
        return F.concat(F.lit("["), F.concat_ws(",", *[F.format_string("[%d,%d]", cx + dx, cy + dy) for dx, dy in points]), F.lit("]"))

    holed = F.when(s % 3 == 0, F.concat(ring(OUTER), F.lit(","), ring(HOLE))).otherwise(ring(OUTER))
    coords = F.when(s % 5 == 0, F.concat(F.lit("[["), holed, F.lit("],["), ring(SECOND), F.lit("]]"))).otherwise(F.concat(F.lit("["), holed, F.lit("]")))
    kind = F.when(s % 5 == 0, "MultiPolygon").otherwise("Polygon")
    text = F.concat(F.lit('{"type":"Feature","properties":{"GNIS_Name":"'), F.col("s_name"), F.lit('","OBJECTID":'), s.cast("string"),
                    F.lit('},"geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit("}}"))
    return table(spark, sf, "supplier").select(s.alias("key"), text.alias("text"))


def shapes(spark, sf):
    return FT.features(feature_texts(spark, sf), "key", "text").rows


def edges(spark, sf):
    return G.polygon_edges(shapes(spark, sf))


def _ring_values():
    rows = [(0, 0, i, p) for i, p in enumerate(OUTER)] + [(0, 1, i, p) for i, p in enumerate(HOLE)] + [(1, 0, i, p) for i, p in enumerate(SECOND)]
    return ",".join(f"({a},{b},{i},{x},{y})" for a, b, i, (x, y) in rows)


_EDGES = f"""with vert as (select s_suppkey as geom, part, ring, i, s_suppkey*37%900+60+dx as x, s_suppkey*91%900+60+dy as y
  from supplier, (values {_ring_values()}) o(part, ring, i, dx, dy) where (ring=0 or s_suppkey%3=0) and (part=0 or s_suppkey%5=0)),
edge as (select geom, part, ring, i+1 as seq, x::double as x0, y::double as y0, coalesce(lead(x) over w, first_value(x) over w)::double as x1, coalesce(lead(y) over w, first_value(y) over w)::double as y1
  from vert window w as (partition by geom, part, ring order by i)),
rings as (select geom, part, ring, sum(x0*y1-x1*y0)/2 as area, sum((x0+x1)*(x0*y1-x1*y0))/(3*sum(x0*y1-x1*y0)) as cx, sum((y0+y1)*(x0*y1-x1*y0))/(3*sum(x0*y1-x1*y0)) as cy,
  min(x0) as xmin, max(x0) as xmax, min(y0) as ymin, max(y0) as ymax from edge group by 1,2,3),
prim as (select * from (select *, row_number() over (partition by geom order by -abs(area), part) as rn from rings where ring=0) where rn=1)
"""


def _inside_sql(points, keys, boundary=True, extra=""):
    """CTE text: keys and geom of the points of ``points`` inside their geometry."""
    k = ", ".join(f"p.{c}" for c in keys)
    on = """bool_or(abs((x-x0)*(y1-y0)-(y-y0)*(x1-x0))<=1e-9 and x between least(x0,x1)-1e-9 and greatest(x0,x1)+1e-9 and y between least(y0,y1)-1e-9 and greatest(y0,y1)+1e-9)"""
    rule = f"(odd or {'onb' if boundary else 'false'})"
    return f"""pr as (select {k}, p.geom, part, ring, (count(*) filter (((y0>y)<>(y1>y)) and x < (x1-x0)*(y-y0)/(case when y1=y0 then null else y1-y0 end)+x0))%2=1 as odd, {on} as onb
  from {points} p join edge e on e.geom=p.geom {extra} group by {k}, p.geom, part, ring),
pp as (select {', '.join(keys)}, geom, part, coalesce(bool_or({rule}) filter (ring=0),false) as o, coalesce(bool_or({rule}) filter (ring>0),false) as h from pr group by all),
ins as (select distinct {', '.join(keys)}, geom from pp where o and not h)"""


def customer_points(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(c.alias("pid"), (c * 17 % 1000 + 20).cast("double").alias("x"), (c * 53 % 1000 + 20 + (c % 2) * 0.25).cast("double").alias("y"))


_POINTS = _EDGES + """, pts as (select c_custkey as pid, (c_custkey*17%1000+20)::double as x, (c_custkey*53%1000+20+(c_custkey%2)*0.25::double) as y from customer),
cand as (select pid, x, y, b.geom from pts join (select geom, min(x0) as a, max(x0) as b, min(y0) as c, max(y0) as d from edge group by 1) b on x between a and b and y between c and d)
"""


@BOOK.add("s07_feature_scan", _EDGES + """select r.geom, s_name as name, count(*) as rings, sum(n)::bigint as points from (select geom, part, ring, count(*)+1 as n from edge group by 1,2,3) r join supplier on geom=s_suppkey group by 1,2""")
def feature_scan(spark, sf):
    rows = shapes(spark, sf)
    rings = F.flatten("parts")
    return rows.select("geom", F.col("properties")["gnis_name"].alias("name"), F.size(rings).cast("bigint").alias("rings"),
                       F.aggregate(rings, F.lit(0).cast("bigint"), lambda a, r: a + F.size(r)).alias("points"))


@BOOK.add("g01_ring_measures", _EDGES + "select geom, part, ring, round(area,6) as area, round(cx,6) as cx, round(cy,6) as cy from rings")
def ring_measures(spark, sf):
    return G.ring_measures(edges(spark, sf)).select("geom", "part", "ring", *[r6(F.col(c)).alias(c) for c in ("area", "cx", "cy")])


@BOOK.add("g02_point_in_polygon", _POINTS + ", " + _inside_sql("cand", ["pid"]) + " select pid, geom from ins")
def point_in_polygon(spark, sf):
    return G.points_in_shapes(customer_points(spark, sf), shapes(spark, sf), "pid", 50.0, 25.0)


@BOOK.add("g03_half_open_test", _POINTS + ", " + _inside_sql("cand", ["pid"], boundary=False) + " select pid, geom from ins")
def half_open(spark, sf):
    return G.points_in_shapes(customer_points(spark, sf), shapes(spark, sf), "pid", 50.0, 25.0, boundary=False)


_MASK = _EDGES + """, box as (select geom, min(x0) as xmin, max(x0) as xmax, min(y0) as ymin, max(y0) as ymax from edge group by 1),
cells as (select geom, r as "row", c as col, (c+0.5)*10.0::double as x, 1100-(r+0.5)*10.0::double as y from box, range(0,110) a(r), range(0,120) b(c)
  where (c+0.5)*10 between xmin-10 and xmax+10 and 1100-(r+0.5)*10 between ymin-10 and ymax+10), """ + _inside_sql("cells", ['"row"', "col"], boundary=False)


@BOOK.add("g04_center_mask", _MASK + ' select geom, "row", col from ins')
def center_mask(spark, sf):
    return G.center_mask(edges(spark, sf), GRID).rows


_CELLS = """, dncell as (select distinct event_type as product, (event_id*7%110) as "row", (event_id*13+event_id//110)%120 as col, cast(floor(value) as int)*5%258 as dn from events),
dnc as (select product, "row", col, max(dn) as dn from dncell group by 1,2,3)"""


def dn_cells(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("product"), (e * 7 % 110).cast("int").alias("row"), F.expr("cast((event_id * 13 + event_id div 110) % 120 as int)").alias("col"),
        (F.floor("value").cast("int") * 5 % 258).alias("dn")).groupBy("product", "row", "col").agg(F.max("dn").alias("dn"))


@BOOK.add("a09_zonal_class_counts", _MASK + _CELLS + """ , listed as (select distinct event_type as product from events)
select geom, l.product, count(*) filter (dn<100) as low, count(*) filter (dn between 100 and 199) as moderate, count(*) filter (dn between 200 and 253) as high,
  count(*) filter (dn<=253) as valid, count(*) filter (dn is null or dn>253) as invalid, count(*) as mask_pixels, count(*) filter (dn between 199 and 253) as high_199, count(*) filter (dn between 201 and 253) as high_201
  from ins cross join listed l left join dnc on dnc.product=l.product and dnc."row"=ins."row" and dnc.col=ins.col group by 1,2""")
def zonal(spark, sf):
    runs, cells = G.center_runs(edges(spark, sf), GRID), dn_cells(spark, sf)
    products = cells.agg(F.collect_set("product").alias("all"))  # one row: the product list of every geometry
    pairs = shapes(spark, sf).select("geom").join(F.broadcast(products)).select("geom", F.explode("all").alias("product"))
    return G.zonal_counts(runs, cells, pairs)


@BOOK.add("a09_mask_runs", _MASK + """, st as (select geom, "row", col, col-row_number() over (partition by geom, "row" order by col) as island from ins)
select geom, "row", min(col) as col_from, max(col) as col_to from st group by geom, "row", island""")
def mask_runs(spark, sf):
    return G.center_runs(edges(spark, sf), GRID)


@BOOK.add("a10_distinct_native_cells", """select event_type as product, count(*) as observations, count(distinct ((event_id*7%110)*1000+(event_id*13+event_id//110)%120)) as distinct_cells from events group by 1""")
def native_cells(spark, sf):
    from ..functions.names import native_identity
    e = F.col("event_id")
    ident = native_identity(F.col("event_type"), e * 7 % 110, F.expr("(event_id * 13 + event_id div 110) % 120"))
    folded = table(spark, sf, "events").groupBy(F.col("event_type").alias("product"), ident.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    return folded.groupBy("product").agg(F.sum("n").alias("observations"), F.count(F.lit(1)).alias("distinct_cells"))


@BOOK.add("g05_patch_window", _POINTS + """select pid, floor(x/10)::bigint-4 as col_offset, floor((1100-y)/10)::bigint-4 as row_offset, (floor(x/10)-4)*10 as "left", 1100-(floor((1100-y)/10)-4)*10 as top,
  floor((1100-y)/10)-4>=0 and floor(x/10)-4>=0 and floor((1100-y)/10)+4<=110 and floor(x/10)+4<=120 as fits from pts""")
def window(spark, sf):
    w = G.patch_window(F.col("x"), F.col("y"), GRID, 8)
    return customer_points(spark, sf).select("pid", *[w[n].alias(n) for n in ("col_offset", "row_offset", "left", "top", "fits")])


_LATTICE = _EDGES + """, cand as (select geom, -1 as ord, cx as x, cy as y from prim union all select geom, i*10000+r*100+c, xmin+(xmax-xmin)*(c/d::double), ymin+(ymax-ymin)*(r/d::double) from prim,
  (values (0,8),(1,16),(2,32),(3,64)) v(i,d), range(1,64) a(r), range(1,64) b(c) where r<d and c<d), """ + _inside_sql("cand", ["ord"])


@BOOK.add("g06_representative_point", _LATTICE + " select geom, ord, round(x,6) as x, round(y,6) as y from (select c.*, row_number() over (partition by geom order by ord) as rn from cand c join ins using (geom, ord)) where rn=1")
def representative(spark, sf):
    out = G.representative_points(edges(spark, sf), 25.0).rows
    return out.select("geom", "ord", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


_FINE = {"width": 1200, "height": 1100, "origin_x": 0.0, "origin_y": 1100.0, "pixel_size": 1.0}


@BOOK.add("g06_contained_patch", _LATTICE.replace("pr as", "pr1 as").replace("from pr ", "from pr1 ").replace("pp as", "pp1 as").replace("from pp ", "from pp1 ").replace("ins as", "ins1 as")
          + """, win as (select c.*, floor(x)-8 as l, 1100-(floor(1100-y)-8) as t from cand c join ins1 using (geom, ord)), cor as (select geom, ord, k as corner, l+dx as x, t-16+dy as y from win,
  (values (0,0,0),(1,0,16),(2,16,16),(3,16,0)) v(k,dx,dy)), """ + _inside_sql("cor", ["ord", "corner"])
          + """, ok as (select geom, min(ord) as ord from (select geom, ord from ins group by 1,2 having count(*)=4) group by 1)
select geom, ord, l as "left", t-16 as bottom from win join ok using (geom, ord)""")
def contained(spark, sf):
    return G.contained_patches(edges(spark, sf), _FINE, 16, 25.0).rows.select("geom", "ord", "left", "bottom")


@BOOK.add("j10_box_overlaps", """with b as (select o_orderkey as id, 'C'||(o_custkey%3) as crs, (o_custkey*37%4000)::double as xmin, (o_custkey*91%4000)::double as ymin, (o_custkey*37%4000+10+o_custkey%30)::double as xmax, (o_custkey*91%4000+10+o_custkey%20)::double as ymax from orders),
d as (select crs, xmin, ymin, xmax, ymax, min(id) as id, count(*) as n from b group by all)
select l.crs, l.id as left_id, r.id as right_id, l.n*r.n as pairs from d l join d r on l.crs=r.crs and l.id<r.id and l.xmin<r.xmax and r.xmin<l.xmax and l.ymin<r.ymax and r.ymin<l.ymax
union all select crs, id, id, n*(n-1)//2 from d where n>1""")
def overlaps(spark, sf):
    c = F.col("o_custkey")
    x, y = c * 37 % 4000, c * 91 % 4000
    boxes = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("C"), (c % 3).cast("string")).alias("crs"), x.cast("double").alias("xmin"), y.cast("double").alias("ymin"),
        (x + 10 + c % 30).cast("double").alias("xmax"), (y + 10 + c % 20).cast("double").alias("ymax"))
    return G.box_overlaps(boxes, 40.0).rows


@BOOK.add("p23_affine_polygon", with_views("v_patch") + """select seq, (x+10*patch_col)::double as xmin, (x+10*(patch_col+64))::double as xmax, (9000-10*(patch_row+64))::double as ymin, (9000-10*patch_row)::double as ymax,
  x+10*(patch_col+0.5::double) as center_x, 9000-10*(patch_row+0.5::double) as center_y from v_patch""")
def affine(spark, sf):
    t = {"a": F.lit(10.0), "b": F.lit(0.0), "c": F.col("x").cast("double"), "d": F.lit(0.0), "e": F.lit(-10.0), "f": F.lit(9000.0)}
    b = GD.ring_bounds(F.col("outline"))
    cx, cy = GD.pixel_center(t, F.col("patch_row"), F.col("patch_col"))
    rows = patches(spark, sf).withColumn("outline", GD.patch_ring(t, F.col("patch_row"), F.col("patch_col"), F.lit(64)))
    return rows.select("seq", *[v.alias(k) for k, v in b.items()], cx.alias("center_x"), cy.alias("center_y"))


def _utm_sql(source, keep):
    """SQL for inverse UTM zone 17 north followed by forward Albers, from columns ux, uy."""
    e2, a, k0 = GD.WGS84_E2, GD.WGS84_A, GD.UTM_K0
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    rect = a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
    e, n, c, rho0 = GD._albers_constants()
    d = "::double"
    return f"""u1 as (select {keep}, ux, uy/{k0!r}{d}/{rect!r}{d} as mu from {source}),
u2 as (select *, mu+{3 * e1 / 2 - 27 * e1**3 / 32!r}{d}*sin(2*mu)+{21 * e1**2 / 16 - 55 * e1**4 / 32!r}{d}*sin(4*mu)+{151 * e1**3 / 96!r}{d}*sin(6*mu)+{1097 * e1**4 / 512!r}{d}*sin(8*mu) as phi from u1),
u3 as (select *, {a!r}{d}/sqrt(1-{e2!r}{d}*sin(phi)**2) as n1, tan(phi)**2 as t, {ep2!r}{d}*cos(phi)**2 as c, {a * (1 - e2)!r}{d}/pow(1-{e2!r}{d}*sin(phi)**2,1.5) as r1 from u2),
u4 as (select *, (ux-500000)/(n1*{k0!r}{d}) as dd from u3),
u5 as (select {keep}, degrees(phi-(n1*tan(phi)/r1)*(dd**2/2-(5+3*t+10*c-4*c*c-9*{ep2!r}{d})*dd**4/24+(61+90*t+298*c+45*t*t-252*{ep2!r}{d}-3*c*c)*dd**6/720)) as lat,
  -81+degrees((dd-(1+2*t+c)*dd**3/6+(5-2*c+28*t-3*c*c+8*{ep2!r}{d}+24*t*t)*dd**5/120)/cos(phi)) as lon from u4),
u6 as (select *, sin(radians(lat)) as s from u5),
u7 as (select *, {GD.GRS80_A!r}{d}*sqrt({c!r}{d}-{n!r}{d}*({1 - e * e!r}{d}*(s/(1-{e * e!r}{d}*s*s)-ln((1-{e!r}{d}*s)/(1+{e!r}{d}*s))/{2 * e!r}{d})))/{n!r}{d} as rho, {n!r}{d}*radians(lon+96) as theta from u6),
albers as (select {keep}, lon, lat, rho*sin(theta) as x, {rho0!r}{d}-rho*cos(theta) as y from u7)"""


@BOOK.add("p24_projection_chain", "with src as (select c_custkey as k, (400000+c_custkey*131%200000)::double as ux, (3500000+c_custkey*977%900000)::double as uy from customer),\n"
          + _utm_sql("src", "k") + "\nselect k, round(lon,6) as lon, round(lat,6) as lat, round(x,3) as x, round(y,3) as y from albers")
def projection(spark, sf):
    k = F.col("c_custkey")
    p = table(spark, sf, "customer").select(k.alias("k"), (k * 131 % 200000 + 400000).cast("double").alias("ux"), (k * 977 % 900000 + 3500000).cast("double").alias("uy"), F.lit("EPSG:32617").alias("crs"))
    out = GD.with_albers(GD.with_lonlat(p, "ux", "uy", "crs"), "lon", "lat")
    return out.select("k", r6(F.col("lon")).alias("lon"), r6(F.col("lat")).alias("lat"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@BOOK.add("p25_bilinear_dn", """select event_id, case when greatest(a,b,c,d)<=253 then round((a*(1-wc)+b*wc)*(1-wr)+(c*(1-wc)+d*wc)*wr,6) end as dn from
  (select event_id, event_id%256 as a, event_id*7%256 as b, event_id*11%256 as c, event_id*13%256 as d, (user_id%8)/8.0::double as wr, (event_id%4)/4.0::double as wc from events)""")
def bilinear(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", r6(GD.bilinear_dn(
        (e % 256, e * 7 % 256, e * 11 % 256, e * 13 % 256), (F.col("user_id") % 8) / 8.0, (e % 4) / 4.0)).alias("dn"))


# Raster of 300 m cells that covers the patches placed around 81 W, 36 N.
RASTER = {"width": 60, "height": 60, "origin_x": 1330000.0, "origin_y": 1572100.0, "pixel_size": 300.0}


def raster_cells(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        (k % 4).alias("product"), F.expr("cast(o_orderkey div 4 % 60 as int)").alias("row"), F.expr("cast(o_orderkey div 240 % 60 as int)").alias("col"),
        (F.floor("o_totalprice").cast("int") % 260).alias("v")).groupBy("product", "row", "col").agg(F.least(F.max("v"), F.lit(255)).alias("dn"))


def raster_patches(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("patch_id"), (k % 4).alias("product"), F.lit("EPSG:32617").alias("crs"), F.lit(60.0).alias("a"), F.lit(0.0).alias("b"),
        (k * 37 % 70 * 100 + 501000).cast("double").alias("c"), F.lit(0.0).alias("d"), F.lit(-60.0).alias("e"), (k * 53 % 60 * 100 + 4002500).cast("double").alias("f"))


_RASTER = """with rc as (select o_orderkey%4 as product, o_orderkey//4%60 as "row", o_orderkey//240%60 as col, least(max(cast(floor(o_totalprice) as int)%260),255) as dn from orders group by 1,2,3),
rp as (select s_suppkey as patch_id, s_suppkey%4 as product, (s_suppkey*37%70*100+501000)::double as c, (s_suppkey*53%60*100+4002500)::double as f from supplier)
"""


@BOOK.add("g07_raster_alignment", _RASTER + """, src as (select patch_id, product, i as r, j as cc, 60*(j+0.5::double)+c as ux, -60*(i+0.5::double)+f as uy from rp, range(0,16) a(i), range(0,16) b(j)),
""" + _utm_sql("src", "patch_id, product, r, cc") + """, fr as (select *, (x-1330000)/300-0.5 as fc, (1572100-y)/300-0.5 as fw from albers),
b as (select *, floor(fw)::bigint as br, floor(fc)::bigint as bc, round_even(fw,0)::bigint as nr, round_even(fc,0)::bigint as nc from fr),
v as (select b.*, n.dn as v0, v1.dn as v1, v2.dn as v2, v3.dn as v3, v4.dn as v4, fw-br as wr, fc-bc as wc from b left join rc n on n.product=b.product and n."row"=nr and n.col=nc
 left join rc v1 on v1.product=b.product and v1."row"=br and v1.col=bc left join rc v2 on v2.product=b.product and v2."row"=br and v2.col=bc+1
 left join rc v3 on v3.product=b.product and v3."row"=br+1 and v3.col=bc left join rc v4 on v4.product=b.product and v4."row"=br+1 and v4.col=bc+1),
bl as (select *, case when v1<=253 and v2<=253 and v3<=253 and v4<=253 then (v1*(1-wc)+v2*wc)*(1-wr)+(v3*(1-wc)+v4*wc)*wr end as s from v),
cl as (select *, case when v0 is null then -1 when v0<100 then 0 when v0<200 then 1 when v0<=253 then 2 else -1 end as n, case when s is null then -1 when s<100 then 0 when s<200 then 1 when s<=253 then 2 else -1 end as m from bl)
select patch_id, count(*) as target_pixels, count(*) filter (n=0) as nearest_low, count(*) filter (n=1) as nearest_moderate, count(*) filter (n=2) as nearest_high, count(*) filter (n<0) as nearest_invalid,
  count(*) filter (m>=0) as bilinear_valid, count(*) filter (n>=0 and m>=0) as comparable, count(*) filter (n>=0 and m>=0 and n<>m) as disagreements from cl group by 1""")
def alignment(spark, sf):
    return R.alignment_summary(R.align(raster_patches(spark, sf), raster_cells(spark, sf), RASTER, 16, 16).rows)


@BOOK.add("g08_native_support_shifts", _RASTER + """, src as (select patch_id, product, k, 60*dx*16+c as ux, -60*dy*16+f as uy from rp, (values (0,0,0),(1,1,0),(2,1,1),(3,0,1)) v(k,dx,dy)),
""" + _utm_sql("src", "patch_id, product, k") + """, sh as (select patch_id*10+s as geom, k, x+dx as x, y+dy as y from albers, (values (0,0,0),(1,-10,0),(2,10,0),(3,0,-10),(4,0,10),(5,-10,-10),(6,10,10)) v(s,dx,dy)),
edge as (select geom, 0 as part, 0 as ring, x as x0, y as y0, coalesce(lead(x) over w, first_value(x) over w) as x1, coalesce(lead(y) over w, first_value(y) over w) as y1 from sh window w as (partition by geom order by k)),
box as (select geom, min(x0) as xmin, max(x0) as xmax, min(y0) as ymin, max(y0) as ymax from edge group by 1),
cells as (select geom, r as "row", c as col, 1330000+(c+0.5)*300.0::double as x, 1572100-(r+0.5)*300.0::double as y from box, range(0,60) a(r), range(0,60) b(c)
  where 1330000+(c+0.5)*300 between xmin and xmax and 1572100-(r+0.5)*300 between ymin and ymax), """ + _inside_sql("cells", ['"row"', "col"], boundary=False) + """,
per as (select patch_id, s, count(ins."row") as total, count(*) filter (dn<=253) as valid, count(*) filter (dn between 200 and 253) as high
  from (select distinct patch_id from rp) p cross join range(0,7) t(s) left join ins on ins.geom=patch_id*10+s left join rc on rc.product=patch_id%4 and rc."row"=ins."row" and rc.col=ins.col group by 1,2)
select patch_id, max(total) filter (s=0) as native_total, max(valid) filter (s=0) as native_valid, max(high) filter (s=0) as native_high, min(total) as total_min, max(total) as total_max, min(high) as high_min, max(high) as high_max,
  (min(high)>0)=(max(high)>0) as high_status_stable from per group by 1""")
def support_shifts(spark, sf):
    return R.native_support(raster_patches(spark, sf), raster_cells(spark, sf), RASTER, 16, 16).rows
