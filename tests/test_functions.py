"""Column rules against known answers."""

import math

import pytest
from pyspark.sql import functions as F

from patchwell.functions import evidence as EV
from patchwell.functions import geodesy as GD
from patchwell.functions import labels as L
from patchwell.functions import names as N
from patchwell.functions import spectral as SP


def test_every_byte_has_its_class(spark):
    out = spark.range(256).select(L.segmentation_target(F.col("id")).alias("t")).groupBy("t").count()
    assert {r.t: r["count"] for r in out.collect()} == {0: 100, 1: 100, 2: 54, None: 2}


def test_invalid_values_are_ignored(rows):
    df = rows([(math.nan,), (math.inf,), (-1.0,), (256.0,), (1.5,), (None,)], "v double")
    assert [r[0] for r in df.select(L.export_target(L.segmentation_target(F.col("v")))).collect()] == [-100] * 6


def test_continuous_rule_keeps_fractions(rows):
    values = [-1.0, 0.0, 99.0, 99.9, 100.0, 199.0, 199.9, 200.0, 253.0, 254.0, 255.0, math.nan]
    df = rows([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(L.continuous_dn_class(F.col("v"))).collect()] == [-1, 0, 0, 0, 1, 1, 1, 2, 2, -1, -1, -1]
    gap = rows([(99.5,), (199.5,), (150.0,)], "v double").select(L.gapped_dn_class(F.col("v"))).collect()
    assert [r[0] for r in gap] == [1, -1, 1]


def test_strict_rule_refuses_other_values(rows):
    with pytest.raises(Exception, match="outside 0..255"):
        rows([(256,)], "v int").select(L.strict_dn_class(F.col("v"))).collect()


@pytest.mark.parametrize("edges", [(100,), (200, 100), (0, 100), (100, 254), (100.0, 200)])
def test_edges_are_checked(edges):
    with pytest.raises(ValueError):
        L.check_edges(edges)


def test_spectral_known_pixel(rows):
    values = dict.fromkeys(SP.BANDS, 1000) | {"B05": 3000, "B08": 5000, "B8A": 4000, "B11": 6000}
    one = SP.with_indices(rows([tuple(values.values()), (0,) * 12], ", ".join(f"{b} int" for b in SP.BANDS))).collect()
    first = one[0]
    assert first.NDCI == pytest.approx(0.5) and first.NDVI == pytest.approx(2 / 3) and first.B8AB4 == pytest.approx(0.6)
    assert first.B3B2 == 0 and first.FAI == pytest.approx(0.4 - (0.1 + 0.5 * 200 / 945))
    assert one[1].NDCI is None and one[1].NDVI is None and one[1].FAI == 0


def test_band_selection_is_checked(rows):
    for bad in ((), ("B02", "B02"), ("B99",)):
        with pytest.raises(ValueError):
            SP.check_bands(bad)


def test_member_names(rows):
    good = "6_2/6_2_X0650_Y0900_S050_2019_04_19_x0_y512_64x64_5_sen2.npy"
    bad = ["../" + good, "/" + good, "unknown.npy", good.replace("04_19", "02_30"), good + "\n", None]
    out = N.with_member(rows([(m,) for m in [good, *bad]], "member string")).collect()
    p = out[0].parsed
    assert (str(p.acquisition_date), p.subtile_id, p.patch_row, p.patch_col, p.kind) == ("2019-04-19", "6_2_X0650_Y0900_S050", 0, 512, "sen2")
    assert p.sample_id == "6_2_X0650_Y0900_S050_2019_04_19_x0_y512_64x64_5" and p.reject is None
    assert [r.parsed.reject for r in out[1:]] == ["unsafe_path", "unsafe_path", "unrecognized", "impossible_date", "unrecognized", "unrecognized"]


def test_product_dates(rows):
    suffix = N.PRODUCT_SUFFIX
    df = rows([("L2020366" + suffix,), ("L2019366" + suffix,), ("L2019000" + suffix,), ("L2019001.tif",)], "p string")
    assert [str(r[0]) for r in df.select(N.product_date(F.col("p"))).collect()] == ["2020-12-31", "None", "None", "None"]


def test_projection_chain(rows):
    one = GD.with_lonlat(rows([(500000.0, 0.0, "EPSG:32617"), (500000.0, 1.0, "EPSG:4326")], "x double, y double, crs string"), "x", "y", "crs").collect()
    assert one[0].lon == pytest.approx(-81) and one[0].lat == pytest.approx(0, abs=1e-9) and one[1].lon is None
    xy = GD.with_albers(rows([(-96.0, 23.0)], "lon double, lat double"), "lon", "lat").first()
    assert xy.x == pytest.approx(0, abs=1e-6) and xy.y == pytest.approx(0, abs=1e-6)


def test_bilinear_fails_closed(rows):
    df = rows([(0, 100, 200, 252), (0, 254, 200, 252), (0, None, 200, 252)], "a int, b int, c int, d int")
    out = df.select(GD.bilinear_dn(tuple(F.col(c) for c in "abcd"), F.lit(0.5), F.lit(0.5))).collect()
    assert [r[0] for r in out] == [138.0, None, None]


UNIT = {"waterbody_id": "w", "waterbody_name": "Lake", "identity_complete": "true", "dates_with_high": "2", "high_date_span_days": "30",
        "verified_high_patches": "3", "distinct_native_high_support": "100", "provenance_complete_for_qualification": "yes",
        "registration_mask_product_checks_pass": "1", "independence_resolved": "passed"}


def _status(rows, **change):
    unit = UNIT | {"evidence_conflict": "false"} | change
    schema = ", ".join(f"{k} string" for k in unit)
    return rows([tuple(unit.values())], schema).select(*[c.alias(n) for n, c in EV.unit_gate().items()]).first()


def test_units_fail_closed(rows):
    assert _status(rows).qualification_status == "QUALIFIED"
    for field in EV.BOOLEAN_GATES:
        assert _status(rows, **{field: "no"}).qualification_status == "EXCLUDED_NOT_QUALIFIED"
        assert _status(rows, **{field: "maybe"}).qualification_status == "BLOCKED_MISSING_EVIDENCE"
    for field in EV.NUMERIC_GATES:
        assert _status(rows, **{field: "1"}).qualification_status == "EXCLUDED_NOT_QUALIFIED"
        for gap in (None, " ", "many", "NaN", "inf"):
            assert _status(rows, **{field: gap}).qualification_status == "BLOCKED_MISSING_EVIDENCE"
    assert _status(rows, evidence_conflict="true", identity_complete="no").qualification_status == "BLOCKED_CONFLICTING_EVIDENCE"


def test_metric_gate(rows):
    schema = "high_recall double, high_f1 double, low_f1 double, moderate_f1 double, macro_f1 double, high_components int, component_high_recalls array<double>"
    cases = [(0.6, 0.6, 0.6, 0.6, 0.6, 3, [0.1, 0.2, 0.3]), (None, 0.6, 0.6, 0.3, 0.6, 2, [0.1, 0.2]),
             (0.6, 0.6, 0.6, 0.6, 0.6, 3, [0.1, 0.2]), (0.6, 0.6, 0.6, 0.6, 0.6, 3, [0.1, None, 0.3]),
             (0.6, 0.6, 0.6, 0.6, 0.6, 3, [0.1, 0.0, 0.3]), (0.6, 0.6, 0.6, 0.6, 0.6, 3, None)]
    got = [r[0] for r in rows(cases, schema).select(EV.metric_gate_reasons()).collect()]
    assert got == [[], ["high_recall=UNDEFINED", "moderate_f1<0.40", "high_components<3"], ["component_high_recalls=COUNT_MISMATCH"],
                   ["component_high_recall=UNDEFINED"], ["component_high_recall=ZERO"], ["component_high_recalls=MISSING"]]
