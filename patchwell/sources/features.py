"""Scans of nested JSON: polygon features, scene catalogs, access logs, HTML listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import Checked, all_violations, violation

POLYGON = "array<array<array<double>>>"
MULTIPOLYGON = f"array<{POLYGON}>"

# Formats of scene ids, projection codes and listing links.
SCENE_PATTERN = r"^S2[ABC]_MSIL2A_\d{8}T\d{6}_N\d{4}_R\d{3}_T[A-Z0-9]{5}_\d{8}T\d{6}\z"
EPSG_PATTERN = r"^EPSG:(\d{4,6})\z"
LINK_PATTERN = r'href="https?://[^"]*/getfile/([^"?]+)"'
SCENE_SCHEMA = ("id string, properties struct<datetime: string, `processing:level`: string, `eo:cloud_cover`: double>, "
                "assets map<string, struct<`proj:code`: string, `proj:transform`: array<double>, `proj:shape`: array<int>, `file:checksum`: string>>")


def _closed(ring: Column) -> Column:
    points = F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    return F.when(first == last, points).otherwise(F.concat(points, F.array(first)))


def features(df: DataFrame, key: str, text: str) -> Checked:
    """GeoJSON features: lower-case property map and ``parts`` of closed rings of points."""
    shape = F.get_json_object(text, "$.geometry.coordinates")
    kind = F.get_json_object(text, "$.geometry.type")
    parts = (F.when(kind == "Polygon", F.array(F.from_json(shape, POLYGON)))
             .when(kind == "MultiPolygon", F.from_json(shape, MULTIPOLYGON)))
    props = F.transform_keys(F.from_json(F.get_json_object(text, "$.properties"), "map<string,string>"), lambda k, v: F.lower(k))
    # explode keeps the JSON parsing out of the filters below
    parsed = df.select(F.col(key).alias("geom"), kind.alias("_kind"), F.explode(F.array(F.struct(props.alias("props"), parts.alias("raw")))).alias("f"))
    raw = F.col("f.raw")
    empty = F.coalesce(F.size(raw), F.lit(0)) <= 0
    short = F.exists(raw, lambda part: F.exists(part, lambda ring: F.size(ring) < 4))
    problems = all_violations(
        violation(parsed, "unsupported_geometry", ~F.coalesce(F.col("_kind").isin("Polygon", "MultiPolygon"), F.lit(False)), "geom"),
        violation(parsed, "empty_geometry", empty, "geom"),
        violation(parsed, "short_ring", F.coalesce(short, F.lit(False)), "geom"))
    good = parsed.where(~empty & ~F.coalesce(short, F.lit(True)))
    return Checked(good.select("geom", F.col("f.props").alias("properties"), F.transform(raw, lambda part: F.transform(part, _closed)).alias("parts")), problems)


def scene_grids(items: DataFrame, asset: str) -> Checked:
    """Scene rows of a catalog with the grid of one asset; unusable items name their reason."""
    a = F.try_element_at(F.col("assets"), F.lit(asset))
    t, shape = a["proj:transform"], a["proj:shape"]
    rows = items.select("id", F.col("properties.datetime").alias("datetime"), F.col("properties")["eo:cloud_cover"].alias("cloud_cover"),
                        F.col("properties")["processing:level"].alias("_level"), a["proj:code"].alias("crs"), t.alias("transform"),
                        shape.alias("shape"), a["file:checksum"].alias("checksum"), a.isNull().alias("_no_asset"))
    g = F.col("transform")
    zoned = F.col("datetime").rlike(r"(Z|[+-]\d{2}:\d{2})\z")
    reject = (F.when(~F.coalesce(F.col("id").rlike(SCENE_PATTERN), F.lit(False)), "invalid_scene_id")
              .when(~F.coalesce(zoned, F.lit(False)), "timestamp_without_zone")
              .when(~F.coalesce(F.col("_level") == "L2", F.lit(False)), "not_level_2").when(F.col("_no_asset"), "missing_asset")
              .when(~F.coalesce(F.col("crs").rlike(EPSG_PATTERN), F.lit(False)), "invalid_crs")
              .when(F.coalesce(F.size(g), F.lit(0)) != 6, "missing_transform").when(F.coalesce(F.size("shape"), F.lit(0)) != 2, "missing_shape")
              .when((g[1] != 0) | (g[3] != 0), "rotated_grid").when((g[0] <= 0) | (g[4] >= 0), "not_north_up")
              .when(F.coalesce(F.col("checksum"), F.lit("")) == "", "missing_checksum"))
    tagged = rows.withColumn("reject", F.explode(F.array(reject)))
    good = tagged.where(F.col("reject").isNull()).select(
        "id", F.to_timestamp("datetime").alias("observed_at"), "cloud_cover", "crs", g[0].alias("pixel_x"), g[2].alias("origin_x"),
        g[4].alias("pixel_y"), g[5].alias("origin_y"), F.col("shape")[0].alias("height"), F.col("shape")[1].alias("width"), "checksum")
    bad = tagged.where(F.col("reject").isNotNull()).select(F.col("reject").alias("rule"), F.col("id").alias("key"), F.lit("").alias("detail"))
    return Checked(good, bad)


def listing_links(pages: DataFrame, text: str, pattern: str = LINK_PATTERN) -> DataFrame:
    """Distinct linked file names of HTML listings with the number of pages that carry them."""
    links = pages.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))).alias("file"))
    return links.groupBy("file").agg(F.count(F.lit(1)).alias("pages"))


def expected_links(links: DataFrame, expected: DataFrame) -> Checked:
    """Links that were expected; expected files that no page carries are violations."""
    want = expected.select("file").distinct()
    return Checked(links.join(want, "file", "left_semi"), violation(want.join(links, "file", "left_anti"), "product_absent", F.lit(True), "file"))
