"""Tri-state evidence, unit keys and the gates that combine them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..checks import failing

# Accepted spellings, evidence levels, gate labels and floors.
TRUE_WORDS = ("true", "1", "yes", "pass", "passed")
FALSE_WORDS = ("false", "0", "no", "fail", "failed")
CONFIRMED, CANDIDATE, UNVERIFIED = "CONFIRMED", "CANDIDATE", "UNVERIFIED"
EVIDENCE_LEVELS = (CONFIRMED, CANDIDATE, UNVERIFIED)
BOOLEAN_GATES = {
    "identity_complete": "verified_waterbody_identity_or_geometry",
    "provenance_complete_for_qualification": "complete_sentinel_cyan_provenance",
    "registration_mask_product_checks_pass": "registration_mask_product_version_checks",
    "independence_resolved": "spatial_event_independence",
}
NUMERIC_GATES = {
    "dates_with_high": (2, "at_least_2_high_dates"),
    "high_date_span_days": (30, "high_dates_separated_at_least_30_days"),
    "verified_high_patches": (3, "at_least_3_nonoverlapping_high_patches"),
    "distinct_native_high_support": (100, "at_least_100_unique_dated_native_high_identities"),
}
HIGH_UNIT_STATUSES = (
    "waterbody_status", "scene_status", "patch_geometry_status", "cyan_product_status",
    "cyan_version_status", "source_label_hash_status", "high_support_status")
CANDIDATE_STATUSES = {
    "waterbody_status": CONFIRMED, "scene_status": CONFIRMED, "footprint_status": CONFIRMED,
    "cyan_version_status": CONFIRMED, "historical_overlap_status": "NO_OVERLAP_CONFIRMED"}


def tristate(text: Column) -> Column:
    word = F.lower(F.trim(text.cast("string")))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def lenient_int(text: Column) -> Column:
    """Integer part of the text; NULL when it is blank or not a finite number."""
    number = F.trim(text.cast("string")).try_cast("double")
    usable = (~F.isnan(number)) & (F.abs(number) < 9e18)
    return F.when(usable, number).try_cast("bigint")


def canonical_unit_key(unit_id: Column, name: Column) -> Column:
    """``id:<id>`` when an id is present, else ``name:<lower, single spaced>``."""
    trimmed = F.trim(F.coalesce(unit_id.cast("string"), F.lit("")))
    usable = (trimmed != "") & ~F.lower(trimmed).isin("nan", "none")
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s+", " "))
    return F.when(usable, F.concat(F.lit("id:"), trimmed)).otherwise(F.concat(F.lit("name:"), words))


def scene_identity(stored_id: Column, candidates: Column) -> tuple[Column, Column]:
    """Status and id: a stored id is confirmed, one search hit is a candidate, more are ambiguous."""
    stored = F.nullif(stored_id, F.lit(""))
    hits = F.coalesce(F.size(candidates), F.lit(0))
    status = F.when(stored.isNotNull(), CONFIRMED).when(hits > 0, CANDIDATE).otherwise(UNVERIFIED)
    return status, F.when(stored.isNotNull(), stored).when(hits == 1, F.try_element_at(candidates, F.lit(1)))


def require_level(level: Column) -> Column:
    return F.when(level.isin(*EVIDENCE_LEVELS), level).otherwise(
        F.raise_error(F.concat(F.lit("Unknown evidence level: "), F.coalesce(level, F.lit("NULL")))))


def geography_failures() -> Column:
    """Names of the keys that keep a row from counting as verified geography."""
    def unusable(name):
        text = F.trim(F.col(name))
        return F.coalesce((text == "") | (text == "UNKNOWN") | text.startswith("candidate_"), F.lit(True))

    def out_of_range(name, low, high):
        x = F.col(name).cast("double")
        return F.coalesce(F.isnan(x) | (x < low) | (x > high), F.lit(True))

    bodies = F.col("waterbody_ids")
    bad_bodies = F.coalesce(
        (F.size(bodies) <= 0) | F.exists(bodies, lambda b: F.coalesce(F.trim(b).isin("", "UNKNOWN"), F.lit(True))), F.lit(True))
    return failing(
        (F.coalesce(F.col("geography_status") != "VERIFIED", F.lit(True)), "geography_status"),
        (unusable("spatial_group_id"), "spatial_group_id"), (unusable("footprint_id"), "footprint_id"),
        (unusable("geography_evidence"), "geography_evidence"), (bad_bodies, "waterbody_ids"),
        (out_of_range("latitude", -90, 90), "latitude"), (out_of_range("longitude", -180, 180), "longitude"))


def status_failures(names=HIGH_UNIT_STATUSES) -> Column:
    """Status keys that are not CONFIRMED."""
    return failing(*[(F.coalesce(F.col(n) != CONFIRMED, F.lit(True)), n) for n in names])


def candidate_reasons(min_pixels: int = 100, min_patches: int = 3) -> Column:
    """Reasons against a candidate: five statuses, High pixels and High patches."""
    rules = [(F.coalesce(F.col(n) != want, F.lit(True)), f"{n}!={want}") for n, want in CANDIDATE_STATUSES.items()]
    pixels = F.coalesce(F.col("high_pixels"), F.lit(0))
    patches = F.coalesce(F.col("high_patches"), F.lit(0))
    return failing(*rules, (pixels < min_pixels, f"high_pixels<{min_pixels}"),
                   (patches < min_patches, f"high_patches<{min_patches}"))


def unit_gate() -> dict[str, Column]:
    """Status, flag and reason of one evidence unit; missing evidence never passes.

    Precedence: conflict, then any failed gate, then any missing gate, then qualified.
    """
    failed, missing = [], []
    for field, label in BOOLEAN_GATES.items():
        value = tristate(F.col(field))
        failed.append((F.coalesce(~value, F.lit(False)), label))
        missing.append((value.isNull(), label))
    for field, (floor, label) in NUMERIC_GATES.items():
        value = lenient_int(F.col(field))
        failed.append((F.coalesce(value < floor, F.lit(False)), label))
        missing.append((value.isNull(), label))
    conflict = F.coalesce(tristate(F.col("evidence_conflict")), F.lit(False))
    failures = failing(*failed)
    gaps = F.transform(failing(*missing), lambda g: F.concat(F.lit("missing_evidence:"), g))
    status = (F.when(conflict, "BLOCKED_CONFLICTING_EVIDENCE")
              .when(F.size(failures) > 0, "EXCLUDED_NOT_QUALIFIED")
              .when(F.size(gaps) > 0, "BLOCKED_MISSING_EVIDENCE").otherwise("QUALIFIED"))
    return {
        "qualification_status": status,
        "qualified": status == "QUALIFIED",
        "exclusion_reason": F.when(conflict, "conflicting_evidence").otherwise(
            F.concat_ws(";", F.concat(failures, gaps))),
    }


def high_unit_failures(dates: Column, patches: Column, native_high: Column, complete: Column,
                       min_dates=2, min_days=30, min_patches=3, min_native=100) -> Column:
    """Named failures of a High unit from its dates, patches and native support."""
    days = F.array_sort(F.array_distinct(dates))
    few = F.size(days) < min_dates
    close = F.coalesce(F.datediff(F.try_element_at(days, F.lit(-1)), F.try_element_at(days, F.lit(1))) < min_days, F.lit(True))
    return failing(
        (few, "insufficient_high_dates"), (~few & close, "insufficient_date_separation"),
        (patches < min_patches, "insufficient_high_patches"),
        (native_high < min_native, "insufficient_unique_dated_native_high_pixels"),
        (~F.coalesce(complete, F.lit(False)), "incomplete_provenance_or_independence_evidence"))


# Floors of the exploratory metric gate.
METRIC_FLOORS = {"high_recall": 0.50, "high_f1": 0.50, "low_f1": 0.50, "moderate_f1": 0.40, "macro_f1": 0.50}
MIN_HIGH_COMPONENTS = 3


def metric_gate_reasons(floors=None, min_components: int = MIN_HIGH_COMPONENTS) -> Column:
    """Reasons a metrics row fails: floors, component count and per-component recalls."""
    rules = []
    for name, floor in (floors or METRIC_FLOORS).items():
        rules += [(F.col(name).isNull(), f"{name}=UNDEFINED"),
                  (F.coalesce(F.col(name) < floor, F.lit(False)), f"{name}<{floor:.2f}")]
    count, recalls = F.col("high_components"), F.col("component_high_recalls")
    rules += [(count.isNull(), "high_components=INVALID"),
              (F.coalesce(count < min_components, F.lit(False)), f"high_components<{min_components}")]
    mismatch = F.coalesce(F.size(recalls) != count, F.lit(True))
    undefined = F.exists(recalls, lambda r: r.isNull())
    zero = F.exists(recalls, lambda r: F.coalesce(r <= 0, F.lit(False)))
    rules += [(recalls.isNull(), "component_high_recalls=MISSING"),
              (recalls.isNotNull() & mismatch, "component_high_recalls=COUNT_MISMATCH"),
              (recalls.isNotNull() & ~mismatch & undefined, "component_high_recall=UNDEFINED"),
              (recalls.isNotNull() & ~mismatch & ~undefined & zero, "component_high_recall=ZERO")]
    return failing(*rules)


