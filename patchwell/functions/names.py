"""Identity strings: archive member names, sample ids, product names, hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The file-name format of image and mask members, and of daily products.
SAMPLE_PATTERN = (r"(\d+_\d+)_X(\d+)_Y(\d+)_S(\d+)_(\d{4})_(\d{2})_(\d{2})"
                  r"_x(\d+)_y(\d+)_(\d+)x(\d+)_(\d+)")
KINDS = ("sen2", "cyan")
PRODUCT_SUFFIX = ".L3m_DAY_CYAN_CI_cyano_CYAN_CONUS_300m.tif"
HASH_SEED = "35042"
_FIELDS = ("region", "subtile_x", "subtile_y", "subtile_size", "year", "month", "day",
           "patch_row", "patch_col", "height", "width", "sequence")


def _grouped(df: DataFrame, text: str, pattern: str, count: int) -> DataFrame:
    """Adds ``_g``: the capture groups of one regex pass, NULL where the text does not match.

    The one-element explode keeps the optimizer from copying the match into every filter and
    field that reads it: each name is matched once.
    """
    joined = "|".join(f"${i}" for i in range(1, count + 1))
    groups = F.when(F.col(text).rlike(pattern), F.split(F.regexp_replace(text, pattern, joined), r"\|"))
    return df.withColumn("_g", F.explode(F.array(groups)))


def _identity() -> dict[str, Column]:
    groups = [F.get("_g", F.lit(i)) for i in range(len(_FIELDS))]
    cols = {n: g if n == "region" else g.try_cast("int") for n, g in zip(_FIELDS, groups)}
    subtile = F.concat(groups[0], F.lit("_X"), groups[1], F.lit("_Y"), groups[2], F.lit("_S"), groups[3])
    return cols | {
        "acquisition_date": F.try_to_date(F.concat(groups[4], F.lit("-"), groups[5], F.lit("-"), groups[6]), "yyyy-MM-dd"),
        "subtile_id": subtile,
        "grid_position": F.concat(subtile, F.lit("_x"), groups[7], F.lit("_y"), groups[8]),
    }


def _as_struct(cols: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in cols.items()])


def with_member(df: DataFrame, column: str = "member", out: str = "parsed") -> DataFrame:
    """Adds a struct with the fields of an archive member path; ``reject`` names the reason or is NULL."""
    pieces = F.split(column, "/")
    staged = _grouped(df.withColumn("_base", F.element_at(pieces, -1)), "_base",
                      rf"^{SAMPLE_PATTERN}_({'|'.join(KINDS)})\.npy\z", 13)
    cols = _identity()
    cols["kind"] = F.get("_g", F.lit(12))
    cols["sample_id"] = F.when(F.col("_g").isNotNull(), F.regexp_replace("_base", r"_[^_]*\z", ""))
    member = F.col(column)
    unsafe = member.startswith("/") | member.contains("\\") | F.array_contains(pieces, "..")
    cols["reject"] = (F.when(member.isNull(), "unrecognized").when(unsafe, "unsafe_path")
                      .when(F.col("_g").isNull(), "unrecognized").when(cols["acquisition_date"].isNull(), "impossible_date"))
    return staged.withColumn(out, _as_struct(cols)).drop("_base", "_g")


def with_sample(df: DataFrame, column: str = "sample_id", out: str = "parsed") -> DataFrame:
    """Adds the same struct parsed from a bare sample id, plus ``patch_position``."""
    staged = _grouped(df, column, rf"^{SAMPLE_PATTERN}\z", 12)
    cols = _identity()
    cols["patch_position"] = F.concat(cols["grid_position"], F.lit("_"), F.get("_g", F.lit(9)), F.lit("x"), F.get("_g", F.lit(10)))
    cols["reject"] = F.when(F.col("_g").isNull(), "unrecognized").when(cols["acquisition_date"].isNull(), "impossible_date")
    return staged.withColumn(out, _as_struct(cols)).drop("_g")


def product_name(day: Column) -> Column:
    """Daily product file name of a date."""
    return F.concat(F.lit("L"), F.date_format(day, "yyyyDDD"), F.lit(PRODUCT_SUFFIX))


def product_date(product_id: Column) -> Column:
    """Date in a product name; NULL for another format or a day of year that does not exist."""
    pattern = r"^L(\d{4})(\d{3})" + PRODUCT_SUFFIX.replace(".", r"\.") + r"\z"
    year = F.regexp_extract(product_id, pattern, 1).try_cast("int")
    doy = F.regexp_extract(product_id, pattern, 2).try_cast("int")
    day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy - 1)
    return F.when((doy >= 1) & (F.year(day) == year), day)


def temporal_match_days(scene_time: Column, product_id: Column) -> Column:
    """Whole days between the UTC date of a scene and its product."""
    return F.abs(F.datediff(F.to_date(scene_time), product_date(product_id)))


def salted_hash(value: Column, seed: str = HASH_SEED, sep: str = ":") -> Column:
    """Rank key: hex SHA-256 of ``<seed><sep><value>``."""
    return F.sha2(F.concat(F.lit(f"{seed}{sep}"), value.cast("string")), 256)


def sample_seed(sample_id: Column, xor: int = 42) -> Column:
    """Per-sample seed: first 32 bits of the SHA-256 of the id, xor-ed with a constant."""
    head = F.conv(F.substring(F.sha2(sample_id.cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    return head.bitwiseXOR(F.lit(xor).cast("bigint"))


def row_hash(*names: str) -> Column:
    """SHA-256 of the row as compact JSON with keys in sorted order."""
    return F.sha2(F.to_json(F.struct(*[F.col(n) for n in sorted(names)])), 256)


def native_identity(product_id: Column, row: Column, col: Column) -> Column:
    """``product|r<row>|c<col>``; NULL for an empty product or a negative cell."""
    ok = (F.length(product_id) > 0) & (row >= 0) & (col >= 0)
    return F.when(ok, F.concat(product_id, F.lit("|r"), row.cast("string"), F.lit("|c"), col.cast("string")))


def conservative_group(waterbody: Column, scene: Column, footprint: Column) -> Column:
    """Group key that exists only when all three parts are known."""
    parts = [F.nullif(p, F.lit("")) for p in (waterbody, scene, footprint)]
    return F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2])


def window_text(row: Column, col: Column, size: Column) -> Column:
    """Half-open pixel window, e.g. ``row[0:64),col[512:576)``."""
    return F.format_string("row[%d:%d),col[%d:%d)", row, row + size, col, col + size)


def patch_identity(scene: Column, asset: Column, row: Column, col: Column) -> Column:
    return F.concat_ws("::", scene, asset, F.concat(F.lit("r"), row.cast("string")), F.concat(F.lit("c"), col.cast("string")))


def box_wkt(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Closed WKT polygon of a box, two decimals, starting at the lower left corner."""
    corners = ((left, bottom), (left, top), (right, top), (right, bottom), (left, bottom))
    points = [F.format_string("%.2f %.2f", x, y) for x, y in corners]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *points), F.lit("))"))


def season(day: Column) -> Column:
    m = F.month(day)
    return (F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM")
            .when(m.isin(6, 7, 8), "JJA").otherwise("SON"))
