"""Label rules and per-patch profiles: P3-P6, P15, A1-A4, A12, A15-A17, A19 and J16."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import profiles
from .registry import Book
from .views import image, pixels, with_views

BOOK = Book()
_PX = with_views("v_px")


@BOOK.add("p03_dn_flags", _PX + """select pixel, case when dn<=253 then 'valid' when dn=254 then 'land' when dn=255 then 'masked' else 'invalid' end as status,
  dn=0 as no_detection, case when dn<=253 then (dn>=100)::int+(dn>=200)::int end as bin from v_px""")
def dn_flags(spark, sf):
    dn = F.col("dn")
    return pixels(spark, sf).select("pixel", L.dn_status(dn).alias("status"),
                                    (dn == 0).alias("no_detection"), L.dn_bin(dn).alias("bin"))


@BOOK.add("p04_segmentation_target", _PX + """select pixel, case when dn<=253 then (dn>=100)::int+(dn>=200)::int else -100 end as target from v_px""")
def target(spark, sf):
    return pixels(spark, sf).select("pixel", L.export_target(L.segmentation_target(F.col("dn"))).alias("target"))


@BOOK.add("p05_strict_dn_class", _PX + """select class_name, count(*) as pixels from (select case when dn<=99 then 'Low' when dn<=199 then 'Moderate'
  when dn<=253 then 'High' else 'IGNORE' end as class_name from v_px where dn<=255) group by 1""")
def strict_class(spark, sf):
    byte = pixels(spark, sf).where(F.col("dn").between(0, 255))
    return byte.groupBy(L.strict_dn_class(F.col("dn")).alias("class_name")).agg(F.count(F.lit(1)).alias("pixels"))


@BOOK.add("p05_strict_violations", _PX + "select 'dn_outside_byte' as rule, dn, count(*) as pixels from v_px where dn not between 0 and 255 group by 2")
def strict_violations(spark, sf):
    """Pixels that the strict rule refuses, by value."""
    bad = pixels(spark, sf).where(~F.coalesce(F.col("dn").between(0, 255), F.lit(False)))
    return bad.groupBy("dn").agg(F.count(F.lit(1)).alias("pixels")).select(F.lit("dn_outside_byte").alias("rule"), "dn", "pixels")


@BOOK.add("p06_continuous_dn_class", _PX + """select pixel,
  case when v<100 then 0 when v<200 then 1 when v<=253 then 2 else -1 end as continuous_class,
  case when v<=99 then 0 when v<=199 and v>99 then 1 when v>=200 and v<=253 then 2 else -1 end as gapped_class
  from (select pixel, dn + col/8.0::double as v from v_px)""")
def continuous(spark, sf):
    v = F.col("dn") + F.col("col") / 8.0
    return pixels(spark, sf).select("pixel", L.continuous_dn_class(v).alias("continuous_class"),
                                    L.gapped_dn_class(v).alias("gapped_class"))


_PROFILE = """prof0 as (select sample_id, dn, "row" as r, col as c, dn<=253 as ok, case when dn<=253 then (dn>=100)::int+(dn>=200)::int end as b from v_px),
prof as (select sample_id, count(*) as total_pixels, count(*) filter (ok) as valid_pixels, count(*) filter (dn=0) as below_detection_pixels,
  count(*) filter (dn=254) as land_pixels, count(*) filter (dn=255) as masked_pixels, count(*) filter (dn>255) as invalid_pixels,
  count(*) filter (b=0) as bin_0_pixels, count(*) filter (b=1) as bin_1_pixels, count(*) filter (b=2) as bin_2_pixels,
  quantile_disc(dn,0.5) filter (ok) as median_dn, avg(dn) filter (ok) as mean_dn, max(dn) filter (ok) as max_dn,
  quantile_disc(dn,0.9) filter (ok) as upper_quantile_dn, count(*) filter (ok and dn>=100) as ge1, count(*) filter (ok and dn>=200) as ge2,
  min(b) filter (r in (3,4) and c in (3,4)) as cmin, max(b) filter (r in (3,4) and c in (3,4)) as cmax,
  count(*) filter (r in (3,4) and c in (3,4) and b is null) as cbad from prof0 group by 1),
profile as (select sample_id, total_pixels, valid_pixels, below_detection_pixels, land_pixels, masked_pixels, invalid_pixels,
  bin_0_pixels, bin_1_pixels, bin_2_pixels, round(valid_pixels/total_pixels,6) as valid_fraction,
  median_dn::double as median_dn, round(mean_dn,6) as mean_dn, max_dn::double as max_dn, upper_quantile_dn::double as upper_quantile_dn,
  (median_dn>=100)::int+(median_dn>=200)::int as median_bin, (mean_dn>=100)::int+(mean_dn>=200)::int as mean_bin,
  (max_dn>=100)::int+(max_dn>=200)::int as max_bin, (upper_quantile_dn>=100)::int+(upper_quantile_dn>=200)::int as upper_quantile_bin,
  case when valid_pixels=0 then null when bin_0_pixels>bin_1_pixels and bin_0_pixels>bin_2_pixels then 0
    when bin_1_pixels>bin_0_pixels and bin_1_pixels>bin_2_pixels then 1 when bin_2_pixels>bin_0_pixels and bin_2_pixels>bin_1_pixels then 2 end as majority_bin,
  round(ge1/nullif(valid_pixels,0),6) as fraction_ge_100, round(ge2/nullif(valid_pixels,0),6) as fraction_ge_200,
  case when cbad=0 and cmin=cmax then cmin end as center_bin from prof)"""
_PROFILE_CTE = _PX.rstrip() + ",\n" + _PROFILE + "\n"


def profile_frame(spark, sf):
    return profiles.reference_profile(pixels(spark, sf), ["sample_id"], height=8, width=8)


@BOOK.add("a02_reference_profile", _PROFILE_CTE + "select * from profile")
def reference_profile(spark, sf):
    return profile_frame(spark, sf)


@BOOK.add("a03_dn_histogram", _PX + """select sample_id, string_agg(dn||':'||n, ',' order by dn) as histogram from
  (select sample_id, dn, count(*) as n from v_px group by 1,2) group by 1""")
def histogram(spark, sf):
    h = profiles.dn_histogram(pixels(spark, sf), ["sample_id"])
    entries = F.array_sort(F.map_entries("histogram"))
    return h.select("sample_id", F.concat_ws(",", F.transform(entries, lambda e: F.concat(
        e["key"].cast("string"), F.lit(":"), e["value"].cast("string")))).alias("histogram"))


@BOOK.add("a04_band_statistics", with_views("v_img") + """select sample_id, min(dn)::bigint as min, max(dn)::bigint as max, round(avg(dn),6) as mean, round(stddev_pop(dn),6) as std,
  round(quantile_cont(dn,0.05),6) as p05, round(quantile_cont(dn,0.5),6) as p50, round(quantile_cont(dn,0.95),6) as p95,
  round(count(*) filter (dn=0)/count(*),6) as zero_fraction from v_img group by 1""")
def band_statistics(spark, sf):
    return profiles.patch_band_statistics(image(spark, sf), ["sample_id"], "dn")


@BOOK.add("a16_aggregation_disagreement", _PROFILE_CTE + """select sample_id, count(distinct v) as distinct_bins from (select sample_id,
  unnest([median_bin, mean_bin, max_bin, upper_quantile_bin, majority_bin, center_bin]) as v from profile) where v is not null group by 1 having count(distinct v)>1""")
def disagreement(spark, sf):
    return profiles.aggregation_disagreement(profile_frame(spark, sf)).select("sample_id", F.col("distinct_bins").cast("bigint").alias("distinct_bins"))


@BOOK.add("a17_block_thumbnails", with_views("v_img") + """select sample_id, string_agg(printf('%.6f', m), ',' order by br, bc) as thumbnail from
  (select sample_id, "row"//2 as br, col//2 as bc, avg(dn)/10000 as m from v_img group by 1,2,3) group by 1""")
def thumbnails(spark, sf):
    t = profiles.block_thumbnails(image(spark, sf), ["sample_id"], "dn", block=2)
    return t.select("sample_id", F.concat_ws(",", F.transform("thumbnail", lambda v: F.format_string("%.6f", v))).alias("thumbnail"))


@BOOK.add("a19_reference_bin_table", _PX + """select b as bin, count(*) as pixels, round(100*count(*)/(select count(*) from v_px where dn<=253),6) as percent_of_valid,
  count(distinct sample_id) as patches_with_bin, min(dn) as observed_min, max(dn) as observed_max
  from (select *, (dn>=100)::int+(dn>=200)::int as b from v_px where dn<=253) group by 1""")
def bin_table(spark, sf):
    return profiles.reference_bin_table(pixels(spark, sf), "sample_id")


@BOOK.add("j16_coverage_scenarios", _PROFILE_CTE + """select sample_id, t as minimum_valid_fraction, valid_pixels/total_pixels >= t as passes
  from profile, (values (0.25::double),(0.5),(0.75),(0.97),(0.99)) v(t)""")
def coverage(spark, sf):
    return profiles.coverage_scenarios(pixels(spark, sf), ["sample_id"], (0.25, 0.5, 0.75, 0.97, 0.99))
