"""Reflectance scaling, spectral indices and the 22-feature projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Band order of the image arrays and nominal wavelengths (nm).
BANDS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12")
INDEX_NAMES = ("NDCI", "NDVI", "FAI", "B8AB4", "B3B2")
RED_NM, NARROW_NIR_NM, SWIR_NM = 665, 865, 1610
SCALE = 10000.0
MIN_DENOMINATOR = 1e-8
BAND_SETS = {
    "rgb": ("B02", "B03", "B04"),
    "visible_rededge_nir": ("B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A"),
    "compact_hab": ("B04", "B05", "B8A", "B11"),
    "all": BANDS,
}
FEATURES = BANDS + INDEX_NAMES + tuple(f"{n}_missing" for n in INDEX_NAMES)


def reflectance(band: str) -> Column:
    return F.col(band).cast("double") / SCALE


def normalized_difference(a: Column, b: Column) -> Column:
    """(a-b)/(a+b), NULL where the denominator is too small to mean anything."""
    return F.when(F.abs(a + b) > MIN_DENOMINATOR, (a - b) / (a + b))


def spectral_indices() -> dict[str, Column]:
    """The five indices as expressions over the stored band columns."""
    x = {b: reflectance(b) for b in BANDS}
    slope = (NARROW_NIR_NM - RED_NM) / (SWIR_NM - RED_NM)
    return {
        "NDCI": normalized_difference(x["B05"], x["B04"]),
        "NDVI": normalized_difference(x["B08"], x["B04"]),
        "FAI": x["B8A"] - (x["B04"] + (x["B11"] - x["B04"]) * slope),
        "B8AB4": normalized_difference(x["B8A"], x["B04"]),
        "B3B2": normalized_difference(x["B03"], x["B02"]),
    }


def with_indices(df: DataFrame) -> DataFrame:
    return df.withColumns(spectral_indices())


def pixel_features(df: DataFrame) -> DataFrame:
    """Replace bands by 12 reflectances, 5 zero-filled indices and 5 missing flags."""
    indices = spectral_indices()
    cols = {b: reflectance(b) for b in BANDS}
    cols |= {n: F.coalesce(c, F.lit(0.0)) for n, c in indices.items()}
    cols |= {f"{n}_missing": c.isNull().cast("double") for n, c in indices.items()}
    return df.withColumns(cols)


def check_bands(names) -> tuple[str, ...]:
    names = tuple(names)
    if not names or len(set(names)) != len(names) or any(n not in BANDS for n in names):
        raise ValueError("Band selection must be non-empty, unique and known")
    return names


def keep_bands(df: DataFrame, names) -> DataFrame:
    """Zero every band outside the selection; the schema stays the same."""
    kept = check_bands(names)
    return df.withColumns({b: F.lit(0).cast(df.schema[b].dataType) for b in BANDS if b not in kept})
