"""Column rules for stored digital numbers (DN) of the reference masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the label encoding.
VALID_MAX = 253
LAND = 254
MASKED = 255
BIN_EDGES = (100, 200)
CLASS_NAMES = ("Low", "Moderate", "High")
IGNORE_INDEX = -100


def check_edges(edges) -> tuple[int, int]:
    edges = tuple(edges)
    if len(edges) != 2 or any(type(e) is not int for e in edges) or not 0 < edges[0] < edges[1] < LAND:
        raise ValueError("Two increasing integer edges inside (0, 254) are required")
    return edges


def is_valid_dn(dn: Column) -> Column:
    """Finite, integral and within 0..253; NULL and NaN are not valid."""
    x = dn.cast("double")
    return F.coalesce((~F.isnan(x)) & (F.rint(x) == x) & x.between(0, VALID_MAX), F.lit(False))


def is_flag(dn: Column, flag: int) -> Column:
    return F.coalesce(dn.cast("double") == flag, F.lit(False))


def dn_bin(dn: Column, edges=BIN_EDGES) -> Column:
    """Number of edges at or below a valid DN (0, 1 or 2); NULL otherwise."""
    low, high = check_edges(edges)
    x = dn.cast("double")
    return F.when(is_valid_dn(dn), (x >= low).cast("int") + (x >= high).cast("int"))


def bin_of(value: Column, edges=BIN_EDGES) -> Column:
    """Bin of an already aggregated statistic; NULL stays NULL."""
    low, high = check_edges(edges)
    return (value >= low).cast("int") + (value >= high).cast("int")


def dn_status(dn: Column) -> Column:
    """valid | land | masked | invalid, exactly one per pixel."""
    return (F.when(is_valid_dn(dn), "valid").when(is_flag(dn, LAND), "land")
            .when(is_flag(dn, MASKED), "masked").otherwise("invalid"))


def segmentation_target(dn: Column) -> Column:
    """Class 0/1/2, NULL where the pixel must be ignored."""
    return dn_bin(dn)


def export_target(target: Column) -> Column:
    """The integer written to files: ignored pixels become the ignore index."""
    return F.coalesce(target, F.lit(IGNORE_INDEX))


def strict_dn_class(dn: Column) -> Column:
    """Class name or IGNORE for a byte; anything else fails the query."""
    return (F.when(dn.between(0, 99), "Low").when(dn.between(100, 199), "Moderate")
            .when(dn.between(200, VALID_MAX), "High").when(dn.isin(LAND, MASKED), "IGNORE")
            .otherwise(F.raise_error(F.concat(F.lit("DN outside 0..255: "), F.coalesce(dn.cast("string"), F.lit("NULL"))))))


def continuous_dn_class(value: Column) -> Column:
    """Class of an interpolated DN: [0,100) [100,200) [200,253], everything else -1."""
    x = value.cast("double")
    return (F.when(x.isNull() | F.isnan(x), -1).when((x >= 0) & (x < 100), 0)
            .when((x >= 100) & (x < 200), 1).when((x >= 200) & (x <= VALID_MAX), 2).otherwise(-1))


def gapped_dn_class(value: Column) -> Column:
    """The screening variant: values strictly between 199 and 200 belong to no class."""
    x = value.cast("double")
    return (F.when(x.isNull() | F.isnan(x), -1).when((x >= 0) & (x <= 99), 0)
            .when((x > 99) & (x <= 199), 1).when((x >= 200) & (x <= VALID_MAX), 2).otherwise(-1))


def class_name(code: Column) -> Column:
    return F.when(code == 0, CLASS_NAMES[0]).when(code == 1, CLASS_NAMES[1]).when(code == 2, CLASS_NAMES[2])
