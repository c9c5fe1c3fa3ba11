"""Evidence units, manifests, catalogs and text audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import Checked, violation
from ..functions import evidence as EV
from ..functions import names as N
from .support import date_summary

EVIDENCE_FIELDS = (*EV.BOOLEAN_GATES, *EV.NUMERIC_GATES)
READY_UNITS = 9  # fixed value: qualified units needed before a split is reviewed
REGISTERED = ("regenerated_packaging_metadata", "tracked_test_update")  # fixed values: accepted amendment classes

# Fixed value: phrases whose use is reviewed.
CLAIM_PATTERN = (r"ground[ -]truth|pollution detection|accurately generalizes|"
                 r"reliable (?:three.class geographic )?generalization|cells\s*/\s*ml|best model|state.of.the.art")


def normalize_units(records: DataFrame, order: str) -> DataFrame:
    """One row per canonical unit: the first record's fields, a conflict flag and the gate result.

    Fields conflict when their smallest and largest text differ, so a unit with very many
    duplicate records is one combined aggregate.
    """
    keyed = records.withColumn("canonical_unit_key", EV.canonical_unit_key(F.col("waterbody_id"), F.col("waterbody_name")))
    text = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in EVIDENCE_FIELDS}
    kept = [c for c in records.columns if c != order]
    grouped = keyed.groupBy("canonical_unit_key").agg(
        F.min_by(F.struct(*kept), order).alias("_first"), F.count(F.lit(1)).alias("duplicate_source_records"),
        *[(F.min(t) != F.max(t)).alias(f"_x_{f}") for f, t in text.items()])
    conflict = F.array_contains(F.array(*[F.col(f"_x_{f}") for f in EVIDENCE_FIELDS]), True)
    flat = grouped.withColumn("evidence_conflict", conflict.cast("string")).select(
        "canonical_unit_key", "duplicate_source_records", "evidence_conflict", "_first.*")
    return evaluate_units(flat)


def evaluate_units(units: DataFrame) -> DataFrame:
    """Gate every unit; membership stays unassigned."""
    return units.withColumns(EV.unit_gate()).withColumn("split_membership", F.lit("UNASSIGNED"))


def readiness(units: DataFrame, needed: int = READY_UNITS) -> DataFrame:
    counted = units.agg(F.count_if("qualified").alias("qualified_units"), F.count(F.lit(1)).alias("units"))
    return counted.withColumn("readiness", F.when(F.col("qualified_units") < needed, "NOT READY").otherwise("READY FOR SPLIT REVIEW"))


def manifest_diff(expected: DataFrame, observed: DataFrame, sanitized: DataFrame, amended: DataFrame) -> Checked:
    """Each expected path: match, documented sanitisation, registered change, changed or missing.

    All four tables are keyed by path, so the joins share one partitioning.
    """
    s = sanitized.select("path", F.col("before_sha256").alias("_sb"), F.col("after_sha256").alias("_sa"))
    a = amended.select("path", F.col("before_sha256").alias("_ab"), F.col("after_sha256").alias("_aa"), F.col("classification").alias("_class"))
    joined = expected.join(observed.select("path", F.col("sha256").alias("_seen")), "path", "left").join(s, "path", "left").join(a, "path", "left")
    want, seen = F.col("expected_sha256"), F.col("_seen")
    status = (F.when(seen.isNull(), "MISSING").when(seen == want, "MATCH")
              .when((F.col("_sb") == want) & (F.col("_sa") == seen), "SANITIZED")
              .when((F.col("_ab") == want) & (F.col("_aa") == seen) & F.col("_class").isin(*REGISTERED), "REGISTERED")
              .otherwise("CHANGED"))
    out = joined.select("path", status.alias("status"))
    return Checked(out, violation(out, "unregistered_change", F.col("status") == "CHANGED", "path"))


def phrase_hits(documents: DataFrame, text: str, keep: list[str], pattern: str = CLAIM_PATTERN, context: int = 160) -> DataFrame:
    """Every hit of every line of the whole text: term, byte offsets, context, line hash.

    The pieces between hits give the byte offset of each hit, so no per-row code is needed.
    """
    rule = F.lit(f"(?i)(?:{pattern})")
    lines = documents.select(*keep, F.posexplode(F.split(text, "\n")).alias("_i", "_raw"))
    matched = lines.withColumn("_line", F.regexp_replace("_raw", r"\s+\z", "")).where(F.col("_line").rlike(f"(?i)(?:{pattern})"))
    cut = matched.withColumns({"_hits": F.regexp_extract_all("_line", rule, F.lit(0)), "_between": F.split("_line", f"(?i)(?:{pattern})")})
    hits = cut.select(*keep, (F.col("_i") + 1).alias("line"), "_line", "_between", "_hits", F.posexplode("_hits").alias("_k", "term"))

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda n, p: n + F.octet_length(p))

    start = total(F.slice("_between", F.lit(1), F.col("_k") + 1)) + total(F.slice("_hits", F.lit(1), F.col("_k")))
    staged = hits.withColumn("start_byte", start).withColumn("end_byte", F.col("start_byte") + F.octet_length("term"))
    left = F.greatest(F.lit(0), F.col("start_byte") - context)
    window = F.substring(F.encode("_line", "UTF-8"), left + 1, F.col("end_byte") + context - left)
    return staged.select(*keep, "line", "term", "start_byte", "end_byte", F.octet_length("_line").alias("line_bytes"),
                         F.sha2("_line", 256).alias("line_sha256"), F.trim(F.make_valid_utf8(window.cast("string"))).alias("context"))


def scope_of(path: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """First rule whose prefix starts the path."""
    out = None
    for prefix, scope in rules:
        out = F.when(path.startswith(prefix), scope) if out is None else out.when(path.startswith(prefix), scope)
    return out.otherwise(default) if out is not None else F.lit(default)


def json_locator(locator: Column) -> Column:
    """``a/0/b`` as a JSON path."""
    steps = F.transform(F.split(locator, "/"), lambda s: F.when(s.rlike(r"^\d+\z"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(
        F.concat(F.lit("."), s)))
    return F.concat(F.lit("$"), F.array_join(steps, ""))


def provenance_check(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims (source, locator, recorded value) against the JSON documents they cite.

    Besides paths: ``len(samples)``, and ``regional_high_range:<name>``, the lowest and highest High F1 of the named
    record's test groups as ``[low, high]``. A document's groups are parsed once, in a column of their own, and only for such claims.
    """
    ranged = F.startswith("locator", F.lit("regional_high_range:"))
    counted = F.json_array_length(F.get_json_object("document", "$.samples")).cast("string")
    record = F.call_function("get_json_object", F.col("document"), F.concat(F.lit("$."), F.substring_index("locator", ":", -1), F.lit(".test_groups")))
    scores = F.transform(F.map_values(F.from_json(record, "map<string, struct<per_class: array<struct<f1: double>>>>")), lambda g: F.get(g["per_class"], F.lit(2))["f1"])
    joined = claims.join(sources, "source", "left").withColumn("_scores", F.when(ranged, scores))
    span = F.when(F.size("_scores") > 0, F.concat(F.lit("["), F.array_min("_scores").cast("string"), F.lit(","), F.array_max("_scores").cast("string"), F.lit("]")))
    found = F.when(F.col("locator") == "len(samples)", counted).when(ranged, span).otherwise(
        F.call_function("get_json_object", F.col("document"), json_locator(F.col("locator"))))
    status = (F.when(F.col("document").isNull(), "SOURCE_MISSING").when(F.col("found").isNull(), "LOCATOR_MISSING")
              .when(F.col("found") == F.col("recorded"), "VERIFIED").otherwise("DIFFERS"))
    return joined.withColumn("found", found).withColumn("status", status).drop("document", "_scores")


def qualification_catalog(records: DataFrame, days: DataFrame, patches: DataFrame) -> DataFrame:
    """Catalog row and qualification of every screened candidate, evidence never assumed complete.

    ``records``: name, screening_status, historical; ``days``: name, day, high, high_199, high_201,
    valid; ``patches``: name, high_patch_count, native_high_pixels, dates.
    """
    totals = date_summary(days, ["name"])
    dates = days.where(F.col("high") > 0).groupBy("name").agg(F.sort_array(F.collect_set("day")).alias("_days"))
    joined = records.join(totals, "name", "left").join(dates, "name", "left").join(patches.withColumn("_verified", F.lit(True)), "name", "left")
    screened = F.col("screening_status") == "SCREENED"
    historical = F.col("historical")
    none = F.array().cast("array<date>")
    use = F.when(F.col("_verified"), F.coalesce("dates", none)).otherwise(F.coalesce("_days", none))
    zero = F.lit(0)
    failures = EV.high_unit_failures(use, F.coalesce("high_patch_count", zero), F.coalesce("native_high_pixels", zero), F.lit(False))
    identified = screened | historical
    reasons = F.when(identified, failures).otherwise(F.concat(F.array(F.lit("authoritative_identity_or_geometry_unavailable")), failures))
    return joined.select(
        "name", F.when(screened, "CONFIRMED_CURRENT_QUERY").when(historical, "CONFIRMED_HISTORICALLY_CURRENT_QUERY_FAILED").otherwise("UNVERIFIED").alias("identity_status"),
        F.when(screened & ~historical, "IDENTITY_AND_CYAN_SCREEN_COMPLETE_SENTINEL_NOT_ACQUIRED").when(historical, "EXISTING_PILOT_REAUDITED")
        .otherwise("REJECTED_IDENTITY_UNAVAILABLE").alias("catalog_disposition"), identified.alias("identity_complete"),
        *[F.coalesce(c, zero).alias(c) for c in ("dates_with_high", "high_date_span_days", "high_total", "high_total_199", "high_total_201", "valid_total")],
        F.coalesce("high_patch_count", zero).alias("verified_high_patches"), F.coalesce("native_high_pixels", zero).alias("verified_native_high"),
        (F.size(reasons) == 0).alias("qualified"), F.lit("UNASSIGNED").alias("split_membership"), F.concat_ws(";", reasons).alias("qualification_failure"))


def patch_catalog(split_rows: DataFrame, verified: DataFrame) -> DataFrame:
    """Identity of every patch with what is verified, what is a candidate and what is unknown."""
    p = N.with_sample(split_rows)
    seen = verified.select("sample_id", F.col("status").alias("artifact_status"))
    window = N.window_text(F.col("parsed.patch_row"), F.col("parsed.patch_col"), F.col("parsed.height"))
    unknown = [F.lit(EV.UNVERIFIED).alias(f"{c}_status") for c in ("scene", "crs", "footprint", "waterbody", "cyan_version")]
    rows = p.select("sample_id", "split", "parsed.subtile_id", F.col("parsed.acquisition_date").cast("string").alias("acquisition_date"),
                    window.alias("relative_window"), F.lit(EV.CANDIDATE).alias("cyan_product_status"), *unknown)
    return rows.join(seen, "sample_id", "left").withColumn("artifact_status", F.coalesce("artifact_status", F.lit("MISSING")))


def scene_catalog(split_rows: DataFrame) -> DataFrame:
    """Candidate processing-run group of every patch; a date alone never identifies a scene."""
    p = N.with_sample(split_rows)
    group = F.concat_ws("|", F.col("parsed.subtile_id"), F.col("parsed.acquisition_date").cast("string"))
    return p.select("sample_id", "split", group.alias("candidate_processing_run_group"), F.lit(EV.CANDIDATE).alias("processing_run_group_status"),
                    F.lit("BLOCKED_MISSING_CONFIRMED_GEOMETRY").alias("query_status"), F.lit(EV.UNVERIFIED).alias("scene_status"))


def candidate_list(support: DataFrame, selected: DataFrame, group: str = "spatial_group_id") -> DataFrame:
    """Components with any High: dates, totals, overlap with the selected ones and why they are not eligible."""
    chosen = selected.select(group).distinct().withColumn("_in", F.lit(True))
    high = support.where(F.col("high_pixels") > 0).join(chosen, group, "left")
    statuses = {"waterbody_status": F.lit(EV.UNVERIFIED), "scene_status": F.lit(EV.UNVERIFIED), "footprint_status": F.lit(EV.UNVERIFIED),
                "cyan_version_status": F.lit(EV.UNVERIFIED),
                "historical_overlap_status": F.when(F.col("_in"), "LEGACY_SELECTED").otherwise("LEGACY_SCREENED_NOT_BLIND")}
    return high.withColumns(statuses).select(
        group, F.array_join(F.transform("high_dates", lambda d: d.cast("string")), "|").alias("acquisition_dates"), "high_date_count", "high_pixels",
        "high_patches", "high_date_span_days", "historical_overlap_status", F.concat_ws(";", EV.candidate_reasons()).alias("rejection_reason"))


def overlap_decision(rows: DataFrame, keys: list[str]) -> DataFrame:
    """CHECKABLE only where every footprint of the group is confirmed."""
    ok = F.coalesce(F.col("footprint_status") == EV.CONFIRMED, F.lit(False))
    return rows.groupBy(*keys).agg(F.when(F.bool_and(ok), "CHECKABLE").otherwise(EV.UNVERIFIED).alias("decision"))


def identity_audit(pilot: DataFrame, pool: DataFrame, origin: str = "existing_pilot") -> DataFrame:
    """Verified pilot rows together with pool candidates that are not pilot duplicates."""
    confirmed = F.col("identity_status").startswith("CONFIRMED")
    left = pilot.select(F.lit("verified_pilot").alias("stage"), "waterbody_id", "scene_id", F.lit("PASS_NATIVE_CENTER_INTERSECTION").alias("overlap_check"),
                        "valid_support", "high_support", F.lit("EXCLUDED_NOT_QUALIFIED").alias("qualification_status"))
    right = pool.where(F.col("origin") != origin).select(
        F.lit("candidate_pool").alias("stage"), "waterbody_id",
        F.when(confirmed, "NOT_RUN_NO_SENTINEL_PATCH").otherwise("NOT_RUN_IDENTITY_UNAVAILABLE").alias("overlap_check"),
        "valid_support", "high_support", F.lit("EXCLUDED_INCOMPLETE_UNIT").alias("qualification_status"))
    return left.unionByName(right, allowMissingColumns=True)


def array_provenance(arrays: DataFrame, sources: DataFrame, verified: DataFrame, recovered: DataFrame) -> DataFrame:
    """Rebuild status of every array from its file check, its archive and the recovery log."""
    r = recovered.select("sample_id").distinct().withColumn("_recovered", F.lit(True))
    joined = arrays.join(sources, "archive", "left").join(verified, ["sample_id", "kind"], "left").join(r, "sample_id", "left")
    ok = F.col("status") == "VERIFIED"
    rebuild = (F.when(ok & (F.col("kind") == "cyan") & F.col("_recovered"), "RECOVERED_AND_VERIFIED").when(ok, "LOCAL_FILE_VERIFIED")
               .when(F.col("kind") == "sen2", "NOT_RECOVERED_REQUIRES_DIRECTORY_ENTRY").otherwise("NOT_RECOVERED"))
    return joined.select("sample_id", "kind", "archive", "checksum", F.coalesce("status", F.lit("MISSING_LOCAL")).alias("status"), rebuild.alias("rebuild_status"))


def label_audit(profile: DataFrame, histogram: DataFrame, groups: DataFrame) -> DataFrame:
    """Per patch: profile, DN histogram, component and the statuses that stay open."""
    return profile.join(histogram, "sample_id").join(groups, "sample_id", "left").withColumns({
        "coordinate_status": F.lit("UNKNOWN"), "geography_status": F.lit("UNVERIFIED"), "label_status": F.lit("UNVERIFIED")})


