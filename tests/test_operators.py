"""Operators against brute force and hand-made tables, including skew and partition invariance."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patchwell.checks import RuleViolation
from patchwell.functions.spectral import BANDS
from patchwell.operators import audit, calibration, components, geometry, intervals, metrics, models, profiles, ranking, raster, robustness, shift, splits, support


def test_profile_examples(rows):
    grids = {"a": [[0, 0, 0], [0, 0, 0], [0, 100, 200]], "b": [[0, 100, 200], [254, 255, math.nan], [math.inf, -1, 0.5]]}
    data = [(k, r, c, float(v)) for k, g in grids.items() for r, line in enumerate(g) for c, v in enumerate(line)]
    out = {r.id: r for r in profiles.reference_profile(rows(data, "id string, row int, col int, dn double"), ["id"], 3, 3).collect()}
    a, b = out["a"], out["b"]
    assert (a.median_bin, a.majority_bin, a.max_bin, a.upper_quantile_bin, a.center_bin) == (0, 0, 2, 2, 0)
    assert a.fraction_ge_100 == pytest.approx(2 / 9, abs=1e-6) and a.fraction_ge_200 == pytest.approx(1 / 9, abs=1e-6)
    assert (b.valid_pixels, b.land_pixels, b.masked_pixels, b.invalid_pixels, b.mean_dn, b.majority_bin, b.center_bin) == (3, 1, 1, 4, 100.0, None, None)


def test_quantiles_and_running_totals_with_a_hot_key(spark):
    rng = np.random.default_rng(1)
    hot, cold = np.round(rng.normal(size=4000), 2), rng.normal(size=37)
    df = spark.createDataFrame([("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold] + [("hot", None), ("hot", math.nan)], "k string, v double")
    got = {r.k: r for r in ranking.exact_quantiles(df, ["k"], "v", {"q05": 0.05, "q50": 0.5, "q99": 0.99}).collect()}
    for k, v in (("hot", hot), ("cold", cold)):
        assert [got[k].q05, got[k].q50, got[k].q99] == pytest.approx(list(np.quantile(v, [0.05, 0.5, 0.99])))
    runs = ranking.running_totals(df.where("v is not null and not isnan(v)").withColumn("i", F.monotonically_increasing_id()), ["k"], ["v", "i"],
                                  {"n": F.lit(1)}, ranking.value_bucket(F.col("v"))).orderBy("k", "n").collect()
    assert [r.n for r in runs if r.k == "hot"] == list(range(1, 4001)) and [r.v for r in runs if r.k == "hot"] == sorted(hot)


def test_global_rank_ignores_partitioning(spark):
    df = spark.range(500).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    a = {r.id: r["rank"] for r in ranking.global_rank(df, "h").collect()}
    b = {r.id: r["rank"] for r in ranking.global_rank(df.repartition(7, "id"), "h").collect()}
    assert a == b and sorted(a.values()) == list(range(500))


def test_components_match_union_find(rows):
    rng = random.Random(3)
    cells = sorted({(f"t{rng.randrange(2)}", rng.randrange(20) * 50, rng.randrange(20) * 50) for _ in range(170)})
    cells += [("t9", 50 * i, 0) for i in range(40)]
    keyed = [(f"{t}_{x}_{y}", t, x, y) for t, x, y in cells]
    df = rows(keyed, "key string, tile string, x int, y int")
    got = {r.key: r.label for r in components.connected_components(df, components.adjacent_pairs(df, 50)).collect()}
    parent = {k: k for k, *_ in keyed}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k, t, x, y in keyed:
        for j, u, v, w in keyed:
            if t == u and abs(x - v) <= 50 and abs(y - w) <= 50:
                lo, hi = sorted((find(k), find(j)))
                parent[hi] = lo
    roots = {}
    for k, *_ in keyed:
        roots.setdefault(find(k), []).append(k)
    assert got == {k: min(m) for m in roots.values() for k in m}


def test_intervals(rows):
    df = rows([("a", 8, 9), ("a", 0, 3), ("a", 4, 6), ("b", 0, 100), ("b", 5, 6), ("b", 101, 102), ("b", 200, 201)], "k string, s long, e long")
    for width in (1, 1000):
        owned = intervals.coalesce_intervals(df, ["k"], "s", "e", F.floor(F.col("s") / width))
        got = sorted((r.k, r.range_start, r.range_end, r.members) for r in intervals.islands(owned, ["k"], "s", "e").collect())
        assert got == [("a", 0, 6, 2), ("a", 8, 9, 1), ("b", 0, 102, 3), ("b", 200, 201, 1)]
    ledger = intervals.charge_ledger(rows([("l", 1, 60), ("l", 2, 30), ("l", 3, 20)], "log string, seq long, b long"), "log", "seq", "b", F.lit(100), F.lit(0))
    with pytest.raises(RuleViolation):
        ledger.strict()
    assert [(r.used, r.status) for r in ledger.rows.orderBy("seq").collect()] == [(60, "ACCEPTED"), (90, "ACCEPTED"), (90, "REFUSED")]
    more = intervals.charge_ledger(rows([("l", 1, 60), ("l", 2, 50), ("l", 3, 5), ("m", 1, -1), ("m", 2, 1)], "log string, seq long, b long"), "log", "seq", "b", F.lit(100), F.lit(0))
    assert sorted((r.log, r.used, r.status) for r in more.rows.collect()) == [
        ("l", 60, "ACCEPTED"), ("l", 60, "NOT_ATTEMPTED"), ("l", 60, "REFUSED"), ("m", 0, "NOT_ATTEMPTED"), ("m", 0, "REFUSED")]


def test_temporal_density(rows):
    d = dt.date
    data = [("x", d(2019, 1, 1)), ("x", d(2019, 1, 1)), ("x", d(2019, 1, 11)), ("UNKNOWN", d(2019, 1, 1))]
    out = intervals.temporal_density(rows(data, "g string, day date"), "g", "day")
    r = out.rows.first()
    assert (r.sample_count, r.unique_dates, r.same_date_extra_samples, r.min_gap_days, r.median_gap_days) == (3, 2, 1, 10, 10.0)
    assert r.dates_per_30_days == pytest.approx(60 / 11) and out.violations.count() == 1


def test_near_in_time_counts_pairs(rows):
    days = [dt.date(2020, 1, i) for i in (1, 1, 1, 3, 9)]
    out = intervals.near_in_time(rows([("w", x) for x in days], "g string, day date"), "g", "day", 2).collect()
    assert sum(r.pairs for r in out) == sum(abs((a - b).days) <= 2 for i, a in enumerate(days) for b in days[i + 1:])


def census_rows(change=None):
    data = []
    for i in range(6):
        tile, x = f"t{i % 2}", 300 * (i // 2)
        for j, day in enumerate((dt.date(2020, 1, 1), dt.date(2020, 3, 1))):
            for pos in (0, 64):
                row = {"sample_id": f"s{i}_{j}_{pos}", "spatial_group_id": f"g{i}", "subtile_id": f"{tile}_{x}", "tile": tile, "x": x, "y": 0,
                       "day": day, "patch_row": pos, "patch_col": 0, "low_pixels": 100, "moderate_pixels": 100, "high_pixels": 100}
                data.append(row | (change(i, j, pos) if change else {}))
    return data


CENSUS = ("sample_id string, spatial_group_id string, subtile_id string, tile string, x int, y int, day date, patch_row int, patch_col int, "
          "low_pixels long, moderate_pixels long, high_pixels long")


def allocate(spark, data):
    df = spark.createDataFrame([tuple(r.values()) for r in data], CENSUS)
    return df, *support.allocate_components(support.group_support(df))


def test_allocation_is_order_independent(spark):
    data = census_rows()
    _, first, problems = allocate(spark, data)
    _, second, _ = allocate(spark, data[::-1])
    a, b = ({r.spatial_group_id: r.split for r in x.collect()} for x in (first, second))
    assert a == b and sorted(a.values()) == ["test"] * 3 + ["train"] * 2 + ["validation"] and problems.count() == 0


@pytest.mark.parametrize("change", [lambda i, j, p: {"day": dt.date(2020, 1, 1)}, lambda i, j, p: {"day": dt.date(2020, 1, 1 + 29 * j)},
                                    lambda i, j, p: {"patch_row": 0}, lambda i, j, p: {"high_pixels": 1}])
def test_thin_components_are_refused(spark, change):
    _, _, problems = allocate(spark, census_rows(change))
    assert problems.count() > 0


def test_support_validation_finds_breaches(spark):
    df, allocation, _ = allocate(spark, census_rows())
    rows = df.join(allocation, "spatial_group_id")
    good = splits.validate_support(rows)
    assert good.violations.count() == 0 and {r.split: r.patches for r in good.rows.collect()} == {"test": 12, "train": 8, "validation": 4}
    torn = rows.withColumn("split", F.when(F.col("sample_id") == "s0_0_0", "train").when(F.col("spatial_group_id") == "g0", "test").otherwise(F.col("split")))
    assert {"cross_partition"} <= {r.rule for r in splits.validate_support(torn).violations.collect()}
    empty = rows.withColumn("high_pixels", F.when(F.col("split") == "test", F.lit(0).cast("long")).otherwise(F.col("high_pixels")))
    assert {"missing_class", "too_few_qualified", "tile_diversity"} <= {r.rule for r in splits.validate_support(empty).violations.collect()}


def test_stratified_split_and_partition_rules(spark):
    df = spark.range(90).select(F.col("id").cast("string").alias("sample_id"), (F.col("id") % 3).alias("c"))
    out = splits.stratified_split(df, "c").rows.groupBy("c", "split").count().collect()
    assert {(r.c, r.split): r["count"] for r in out} == {(c, s): n for c in range(3) for s, n in (("train", 24), ("validation", 3), ("test", 3))}
    small = splits.stratified_split(df.where("id < 12"), "c")
    assert small.violations.count() == 3


def test_balanced_sample_repeats_only_short_classes(spark):
    df = spark.range(30).select("id", F.when(F.col("id") < 20, 0).when(F.col("id") < 28, 1).otherwise(2).alias("y"))
    out = splits.balanced_sample(df, "y", "id")
    got = {r.y: (r.n, r.u) for r in out.groupBy("y").agg(F.count("id").alias("n"), F.count_distinct("id").alias("u")).collect()}
    assert got[0] == (10, 10) and got[1][0] == 10 and got[2][0] == 10 and got[2][1] <= 2
    weights = {r.y: r.weight * r.n for r in splits.balanced_weights(df, "y").rows.collect()}
    assert len(set(round(v, 9) for v in weights.values())) == 1
    assert splits.balanced_weights(df.where("y < 2"), "y").violations.count() == 1


def test_anchored_selection_matches_the_loop(spark):
    rng = random.Random(5)
    data = [(f"s{g}_{i}", f"g{g}", f"sub{rng.randrange(3)}", "t", 0, 0, dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(90)), 64 * rng.randrange(3), 0,
             1, 1, rng.choice([0, 0, 5, 20, 40, 80])) for g in range(4) for i in range(70)]
    df = spark.createDataFrame(data, CENSUS)
    criteria = support.CRITERIA | {"minimum_high_pixels_per_component": 500, "high_dates_per_component": 4, "high_patch_positions_per_component": 5}
    got = {}
    for r in splits.anchored_selection(df, "spatial_group_id", criteria).rows.collect():
        got.setdefault(r.spatial_group_id, set()).add((r.sample_id, r.inclusion_reason))
    import hashlib

    def rank(s):
        return hashlib.sha256(("35042:" + s).encode()).hexdigest()

    for g in ("g0", "g1", "g2", "g3"):
        pool = [r for r in data if r[1] == g]
        high = sorted((r for r in pool if r[11] > 0), key=lambda r: (-r[11], rank(r[0])))
        chosen = {}
        for d in (min(r[6] for r in high), max(r[6] for r in high)):
            for r in [r for r in high if r[6] == d][:2]:
                chosen[r[0]] = r
        for r in high:
            c = list(chosen.values())
            days = [x[6] for x in c]
            if (len(set(days)) >= 4 and (max(days) - min(days)).days >= 30 and len({(x[2], x[7], x[8]) for x in c}) >= 5 and sum(x[11] for x in c) >= 500):
                break
            chosen[r[0]] = r
        want = {(k, "support_anchor") for k in chosen}
        for r in sorted(pool, key=lambda r: rank(r[0])):
            if len(want) >= 48:
                break
            if r[0] not in chosen:
                want.add((r[0], "hash_background"))
        assert got[g] == want


def test_metrics_examples(rows):
    def one(pairs):
        m = metrics.confusion(rows([(y, p) for y, p in pairs], "y int, pred int"), [])
        return metrics.metrics(m.rows, []).first()

    a = one([(0, 0), (1, 0), (None, 2)])
    assert a.high_recall is None and a.high_f1 is None and a.macro_f1 == pytest.approx(2 / 9)
    b = one([(0, 0), (1, 2), (2, 1), (2, 2), (None, 0)])
    assert (b.high_tp, b.high_fp, b.high_fn, b.high_true_share) == (1, 1, 1, 0.5)
    c = one([(0, 0), (0, 0), (1, 0), (2, 2)])
    assert c.macro_f1 == pytest.approx(0.6) and c.weighted_f1 == pytest.approx(0.65)
    assert metrics.confusion(rows([(0, 3)], "y int, pred int"), []).violations.count() == 1


def test_calibration_examples(rows):
    schema = "pixel long, k string, y int, pred int, prob array<double>"
    eye = [(i, "a", i % 3, i % 3, [1.0 if j == i % 3 else 0.0 for j in range(3)]) for i in range(6)]
    r = calibration.calibration(rows(eye, schema), ["k"], [["k"]]).rows.first()
    assert r.ece == pytest.approx(0) and r.brier == pytest.approx(0)
    flat = [(i, "a", i % 3, 0, [1 / 3] * 3) for i in range(6)]
    f = calibration.calibration(rows(flat, schema), ["k"], [["k"]]).rows.first()
    assert f.nll == pytest.approx(math.log(3)) and f.brier == pytest.approx(2 / 3) and f.ece == pytest.approx(0) and f.high_confidence_precision is None
    assert calibration.calibration(rows([(0, "a", 0, 0, [0.5, 0.1, 0.1])], schema), ["k"], [["k"]]).violations.count() == 1


def test_temperature_and_curves(rows):
    data = [("m", 0, [8.0, 0.0, 0.0]), ("m", 1, [8.0, 0.0, 0.0]), ("m", 1, [0.0, 8.0, 0.0]), ("m", 2, [0.0, 0.0, 8.0])]
    r = calibration.fit_temperature(rows(data, "model string, y int, logits array<double>"), ["model"]).first()
    assert r.nll_after < r.nll_before and r.temperature > 1 and not r.at_bound
    scores = [("m", int(i % 3 == 2), [0.0, i / 10, 1 - i / 10]) for i in range(10)]
    c = {x["class"]: x for x in calibration.ranking_curves(rows(scores, "model string, y int, prob array<double>"), ["model"]).collect()}[1]
    pos, neg = [i for i in range(10) if i % 3 == 2], [i for i in range(10) if i % 3 != 2]
    assert c.roc_auc == pytest.approx(sum((p > n) for p in pos for n in neg) / (len(pos) * len(neg)))


SQUARE = {"width": 4, "height": 4, "origin_x": 0.0, "origin_y": 1200.0, "pixel_size": 300.0}


def ring(*pts):
    return [(float(x), float(y)) for x, y in (*pts, pts[0])]


def edges_of(spark, *geoms):
    schema = "geom long, parts array<array<array<struct<x double, y double>>>>"
    return geometry.polygon_edges(spark.createDataFrame([(i, g) for i, g in enumerate(geoms)], schema))


def test_center_mask_and_holes(spark):
    e = edges_of(spark, [[ring((0, 1200), (600, 1200), (600, 600), (0, 600))]])
    assert sorted((r.row, r.col) for r in geometry.center_mask(e, SQUARE).rows.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    holed = edges_of(spark, [[ring((0, 0), (70, 0), (70, 70), (0, 70)), ring((20, 20), (50, 20), (50, 50), (20, 50))]])
    grid = {"width": 7, "height": 7, "origin_x": 0.0, "origin_y": 70.0, "pixel_size": 10.0}
    assert 0 < geometry.center_mask(holed, grid).rows.count() < 49
    off = edges_of(spark, [[ring((9000, 9000), (9010, 9000), (9010, 9010))]])
    assert geometry.center_mask(off, SQUARE).violations.count() == 1


def star(rng, cx, cy, radius, corners):
    angles = sorted(rng.random() * 2 * math.pi for _ in range(corners))
    return ring(*[(cx + radius * (0.3 + 0.7 * rng.random()) * math.cos(a), cy + radius * (0.3 + 0.7 * rng.random()) * math.sin(a)) for a in angles])


def test_mask_runs_equal_the_point_test(spark):
    rng = random.Random(5)
    grid = {"width": 40, "height": 30, "origin_x": 0.0, "origin_y": 300.0, "pixel_size": 10.0}
    geoms = [[star(rng, rng.uniform(-20, 420), rng.uniform(-20, 320), rng.choice((8, 60, 400)), rng.choice((3, 7, 40)))] +
             [star(rng, 200, 150, 90, 9) for _ in range(rng.choice((0, 2)))] for _ in range(24)]
    parts = [[geoms[i], geoms[i + 1]] for i in range(0, 24, 2)]  # overlapping parts, overlapping holes
    parts.append([[ring((5, 295), (25, 295), (25, 275), (5, 275))]])  # corners on centres
    parts.append([[ring((50, 50), (50, 50), (50, 50))]])  # a point
    schema = "geom long, parts array<array<array<struct<x double, y double>>>>"
    e = geometry.polygon_edges(spark.createDataFrame(list(enumerate(parts)), schema)).cache()
    bounds = e.select("geom").distinct().selectExpr("geom", "0D xmin", "400D xmax", "0D ymin", "300D ymax")
    every = geometry.grid_cells(bounds, ["geom"], grid)
    want = sorted(tuple(r) for r in geometry.inside(every, e, ["row", "col"], 40.0, boundary=False).select("geom", "row", "col").collect())
    runs = geometry.center_runs(e, grid)
    got = sorted((r.geom, r.row, c) for r in runs.collect() for c in range(r.col_from, r.col_to + 1))
    assert got == want and len(set(got)) == len(got) > 500
    assert sorted((r.row, r.col) for r in geometry.center_mask(e, grid).rows.where("geom = 12").collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]  # half-open: low ends belong, high ends do not
    cells = every.where("geom = 0").selectExpr("'a' product", "row", "col", "(row * 40 + col) % 256 dn")
    pairs = e.select("geom").distinct().withColumn("product", F.lit("a"))
    mask = geometry.center_mask(e, grid).rows
    assert sorted(map(tuple, geometry.zonal_counts(runs, cells, pairs, block=8).collect())) == sorted(map(tuple, geometry.zonal_counts(mask, cells, pairs).collect()))
    assert geometry.center_runs(e.limit(0), grid).count() == 0


def test_boxes_of_mixed_size_meet_once(spark):
    rng = random.Random(6)
    boxes = [(i, "C", x, y, x + w, y + w * rng.uniform(0.2, 1.0)) for i in range(150) for x, y, w in [(rng.uniform(-500, 500), rng.uniform(-500, 500), rng.choice((3.0, 17.0, 64.0, 300.0)))]]
    boxes += [(900, "C", -1e7, -1e7, 1e7, 1e7), (901, "C", -4e6, -1.0, 4e6, 1.0), (902, "C", 0.0, 0.0, math.inf, 1.0), (903, "C", None, 0.0, 1.0, 1.0)]
    out = geometry.box_overlaps(spark.createDataFrame(boxes, "id long, crs string, xmin double, ymin double, xmax double, ymax double"), 10.0)
    good = boxes[:-2]
    want = sorted((a[0], b[0], 1) for n, a in enumerate(good) for b in good[n + 1:] if a[2] < b[4] and b[2] < a[4] and a[3] < b[5] and b[3] < a[5])
    assert sorted((r.left_id, r.right_id, r.pairs) for r in out.rows.collect()) == want
    assert out.violations.count() == 2  # no length, no number
    held = geometry._on_cells(spark.createDataFrame(boxes[-4:-2], "id long, crs string, xmin double, ymin double, xmax double, ymax double").withColumn("_level", geometry.box_level(10.0)), F.lit(10.0) * F.pow(F.lit(2.0), F.col("_level")))
    assert held.count() <= 8  # a box of 20,000 km on a grid of 10 m


def test_points_meet_boxes_of_every_size(spark):
    rng = random.Random(7)
    geoms = [[[star(rng, rng.uniform(0, 900), rng.uniform(0, 900), r, 6)]] for r in (4, 30, 30, 200, 5000)]
    e = edges_of(spark, *geoms)
    pts = spark.createDataFrame([(i, rng.uniform(-100, 1000), rng.uniform(-100, 1000)) for i in range(400)] + [(400, None, 1.0)], "pid int, x double, y double")
    boxes = [(n, [p[0] for p in g[0][0]], [p[1] for p in g[0][0]]) for n, g in enumerate(geoms)]
    want = sorted((p.pid, n) for p in pts.collect() if p.x is not None for n, xs, ys in boxes if min(xs) <= p.x <= max(xs) and min(ys) <= p.y <= max(ys))
    assert sorted((r.pid, r.geom) for r in geometry.candidate_pairs(pts, e, 20.0).collect()) == want


def test_equal_points_and_shapes_are_tested_once(spark, monkeypatch):
    rng = random.Random(8)
    shapes = [[[star(rng, rng.uniform(0, 100), rng.uniform(0, 100), 40, 7)]] for _ in range(5)]
    places = [(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(12)] + [(None, 1.0)]
    rings = spark.createDataFrame([(n, shapes[n % 5]) for n in range(60)], "geom long, parts array<array<array<struct<x double, y double>>>>")
    pts = spark.createDataFrame([(i, *places[i % 13]) for i in range(130)], "pid int, x double, y double")
    e = geometry.polygon_edges(rings)
    want = sorted(map(tuple, geometry.inside(geometry.candidate_pairs(pts, e, 20.0), e, ["pid"], 10.0).collect()))
    asked, whole = [], geometry.inside
    monkeypatch.setattr(geometry, "inside", lambda points, *a: asked.append(points.count()) or whole(points, *a))
    assert sorted(map(tuple, geometry.points_in_shapes(pts, rings, "pid", 20.0, 10.0).collect())) == want and len(want) > 500
    assert asked[0] <= 12 * 5


def test_lattices_are_searched_in_stages(spark, monkeypatch):
    thin = [[ring((0, 0), (100, 0), (100, 100), (0, 100)), ring((2, 2), (98, 2), (98, 98), (2, 98))]]  # only the finest lattice meets the frame
    e = edges_of(spark, [[ring((0, 0), (10, 0), (10, 10), (0, 10))]], thin)
    asked = []
    whole = geometry.lattice_points
    monkeypatch.setattr(geometry, "lattice_points", lambda left, stage, d: asked.append((d, sorted(r.geom for r in left.collect()))) or whole(left, stage, d))
    out = {r.geom: r.ord for r in geometry.representative_points(e, 25.0).rows.collect()}
    assert out == {0: -1, 1: 30101} and asked == [(8, [1]), (16, [1]), (32, [1]), (64, [1])]


def test_boundary_rules_differ(spark):
    e = edges_of(spark, [[ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (2, 1), (2, 2), (1, 2))], [ring((10, 0), (12, 0), (12, 2), (10, 2))]])
    pts = spark.createDataFrame([(0, 4.0, 2.0), (1, 0.5, 0.5), (2, 1.5, 1.5), (3, 11.0, 1.0), (4, 5.0, 5.0), (5, 1.0, 1.5)], "pid int, x double, y double").withColumn("geom", F.lit(0).cast("long"))
    assert sorted(r.pid for r in geometry.inside(pts, e, ["pid"], 1.0).collect()) == [0, 1, 3]
    assert sorted(r.pid for r in geometry.inside(pts, e, ["pid"], 1.0, boundary=False).collect()) == [1, 3]


def test_box_overlap_rules(rows):
    data = [(1, "C", 0.0, 0.0, 2.0, 2.0), (2, "C", 1.0, 1.0, 3.0, 3.0), (3, "C", 2.0, 0.0, 4.0, 1.0), (4, "D", 0.0, 0.0, 2.0, 2.0), (5, "UNKNOWN", 0.0, 0.0, 1.0, 1.0), (6, "C", 0.0, 0.0, 2.0, 2.0)]
    out = geometry.box_overlaps(rows(data, "id long, crs string, xmin double, ymin double, xmax double, ymax double"), 1.0)
    assert sorted((r.left_id, r.right_id, r.pairs) for r in out.rows.collect()) == [(1, 1, 1), (1, 2, 2)] and out.violations.count() == 1


def test_filters_keep_constants_and_match_numpy(spark):
    for m in (robustness.blur_matrix(64, 1.0), robustness.resolution_matrix(64, 48), robustness.resolution_matrix(64, 32)):
        assert np.allclose(m.sum(axis=1), 1)
    x = np.random.default_rng(2).random((3, 8, 8))
    df = spark.createDataFrame([(int(i), r, c, float(x[i, r, c])) for i in range(3) for r in range(8) for c in range(8)], "id int, row int, col int, x double")
    w = robustness.blur_matrix(8, 0.5)
    got = robustness.blur(df.repartition(5), ["id"], 8, 8, 0.5).orderBy("id", "row", "col").collect()
    assert np.allclose([r.x for r in got], np.stack([w @ p @ w.T for p in x]).ravel())


def test_threshold_fit_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    bands = rng.integers(0, 3000, size=(200, 12))
    bands[:5] = 0
    y = rng.integers(0, 3, size=200)
    df = spark.createDataFrame([(*map(int, b), int(t)) for b, t in zip(bands, y)], ", ".join(f"{b} int" for b in BANDS) + ", y int")
    got = {r.feature: r for r in models.fit_thresholds(df).collect()}["NDCI"]
    a, b = bands[:, 4] / 10000, bands[:, 3] / 10000
    v = np.divide(a - b, a + b, out=np.full(200, np.nan), where=np.abs(a + b) > 1e-8)
    v = np.where(np.isnan(v), np.nanmedian(v), v)
    cands, best = np.unique(np.quantile(v, np.linspace(0, 1, 11))), None
    for lo in cands:
        for hi in cands[cands >= lo]:
            for d in (1, -1):
                p = np.searchsorted([lo, hi], v, side="right")
                p = p if d == 1 else 2 - p
                f = [2 * ((p == k) & (y == k)).sum() / max(1, (p == k).sum() + (y == k).sum()) for k in range(3)]
                if best is None or sum(f) / 3 > best[0] + 1e-12:
                    best = (sum(f) / 3, lo, hi, d)
    assert (got.training_macro_f1, got.lower, got.upper, got.direction) == pytest.approx(best)


def test_wasserstein_and_look_alikes(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=300), rng.normal(0.4, 2, size=200)
    long = spark.createDataFrame([("Train", "f", float(v)) for v in a] + [("R", "f", float(v)) for v in b], "pool string, feature string, value double")
    grid = np.sort(np.concatenate([a, b]))
    cdf = [np.searchsorted(np.sort(x), grid[:-1], side="right") / len(x) for x in (a, b)]
    want = np.sum(np.abs(cdf[0] - cdf[1]) * np.diff(grid)) / a.std()
    assert shift.wasserstein(long, "pool", "Train").first().wasserstein_base_sd == pytest.approx(want)
    vecs = np.round(rng.random((80, 6)), 3)
    vecs[1] = vecs[0]
    rows = spark.createDataFrame([(i, "train" if i % 2 else "test", list(map(float, v))) for i, v in enumerate(vecs)], "id int, split string, v array<double>")
    got = {r.id: r.nearest_distance for r in shift.appearance_exposure(rows, "id", "v", radius=0.2).collect()}
    for i in range(0, 80, 2):
        d = min(np.abs(vecs[i] - vecs[j]).mean() for j in range(1, 80, 2))
        assert got[i] == pytest.approx(d)


def test_phrase_offsets_are_bytes(rows):
    text = "é Best  model, best model\nnothing\n12 cells / mL state of the art  "
    out = audit.phrase_hits(rows([(1, text)], "id int, text string"), "text", ["id"], context=4).orderBy("line", "start_byte").collect()
    assert [(r.line, r.term, r.start_byte) for r in out] == [(1, "best model", 16), (3, "cells / mL", 3), (3, "state of the art", 14)]
    assert out[0].context == "el, best model" and out[1].context == "12 cells / mL sta"


def test_unit_normalization_conflicts(rows):
    from test_functions import UNIT
    cols = list(UNIT)
    base = tuple(UNIT.values())
    other = tuple((UNIT | {"dates_with_high": "9", "waterbody_id": "v"}).values())
    clash = tuple((UNIT | {"waterbody_id": "v"}).values())
    df = rows([(1, *base), (2, *base), (3, *other), (4, *clash)], "ord int, " + ", ".join(f"{c} string" for c in cols))
    out = {r.canonical_unit_key: r for r in audit.normalize_units(df, "ord").collect()}
    assert out["id:w"].qualification_status == "QUALIFIED" and out["id:w"].duplicate_source_records == 2
    assert out["id:v"].qualification_status == "BLOCKED_CONFLICTING_EVIDENCE"


def test_zonal_counts_cover_the_whole_mask(rows):
    mask = rows([(1, 0, 0), (1, 0, 1), (2, 5, 5)], "geom int, row int, col int")
    cells = rows([("a", 0, 0, 210), ("a", 9, 9, 10)], "product string, row int, col int, dn int")
    pairs = rows([(1, "a"), (1, "b"), (2, "a")], "geom int, product string")
    out = geometry.zonal_counts(mask, cells, pairs).collect()
    assert sorted((r.geom, r["product"], r.high, r.valid, r.invalid, r.mask_pixels) for r in out) == [(1, "a", 1, 1, 1, 2), (1, "b", 0, 0, 2, 2), (2, "a", 0, 0, 1, 1)]


def test_unknown_values_shared_by_splits_are_leaks(rows):
    from patchwell.operators import splits
    data = rows([("train", "UNKNOWN", ""), ("test", "UNKNOWN", ""), ("test", "b", " ")], "split string, bloom string, scene string")
    assert [r.key for r in splits.isolation_violations(data, ["bloom", "scene"]).collect()] == ["bloom=UNKNOWN"]


def test_positions_and_neighbours_belong_to_a_subtile_and_date(rows):
    from patchwell.operators import pools
    d = dt.date
    data = [("g", "s1", 0, 0, d(2020, 1, 1), "x"), ("g", "s1", 0, 64, d(2020, 1, 1), "y"), ("g", "s2", 0, 0, d(2020, 1, 9), "x"), ("g", "s2", 64, 64, d(2020, 2, 9), "z")]
    out = pools.independence(rows(data, "g string, subtile_id string, patch_row int, patch_col int, day date, content string"), "g", "content").first()
    assert (out.high_patches, out.positions, out.positions_repeated, out.high_patches_with_neighbor, out.identical_extra_patches) == (4, 4, 0, 2, 1)


def test_range_locator(rows):
    doc = '{"run": {"test_groups": {"r1": {"per_class": [{"f1": 0.1}, {"f1": 0.2}, {"f1": 0.75}]}, "r2": {"per_class": [{"f1": 0.1}, {"f1": 0.2}, {"f1": 0.25}]}}}, "samples": [1, 2]}'
    claims = rows([("d", "regional_high_range:run", "[0.25,0.75]"), ("d", "regional_high_range:none", "[0.25,0.75]"), ("d", "len(samples)", "2"), ("x", "len(samples)", "2")], "source string, locator string, recorded string")
    out = audit.provenance_check(claims, rows([("d", doc)], "source string, document string")).collect()
    assert sorted((r.locator, r.status) for r in out) == [("len(samples)", "SOURCE_MISSING"), ("len(samples)", "VERIFIED"), ("regional_high_range:none", "LOCATOR_MISSING"), ("regional_high_range:run", "VERIFIED")]


def test_nearest_train_meets_only_blocks_in_reach(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(12)
    base = np.repeat(rng.normal(size=8) * 50, 60)[:, None] + rng.normal(size=(480, 6))  # eight far clusters, nearest distances far above the radius
    vecs = np.vstack([base, rng.normal(size=(2, 6)) * 1e6])
    data = [(i, "test" if i % 3 == 0 else "train", list(map(float, v))) for i, v in enumerate(vecs)]
    rows = spark.createDataFrame(data + [(900, "test", [1.0, 2.0]), (901, "train", [1.0, 4.0]), (902, "test", [1.0, 2.0, 3.0])], "id int, split string, v array<double>")
    monkeypatch.setattr(shift, "NEAREST_ROWS", 16)
    asked, whole = [], shift._meet
    monkeypatch.setattr(shift, "_meet", lambda left, right, *a: asked.append(left.count()) or whole(left, right, *a))
    got = {r.id: r.nearest_distance for r in shift.appearance_exposure(rows, "id", "v").collect()}
    trains = vecs[[i for i in range(482) if i % 3]]
    assert {i: got[i] for i in range(0, 482, 3)} == pytest.approx({i: np.abs(trains - vecs[i]).mean(axis=1).min() for i in range(0, 482, 3)})
    assert got[900] == 1.0 and got[902] is None and len(got) == 163
    assert asked[0] == 162 and asked[1] < 162 * 20 * 0.4  # a test meets its own cluster, not all blocks


def test_close_pairs_meet_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(13)
    vecs = np.round(rng.random((150, 1)) + rng.normal(size=(150, 5)) * 0.01, 3)
    vecs[7] = vecs[3]
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vecs)] + [(200, [0.5]), (201, [0.505]), (202, [None, 1.0]), (203, None)], "id int, v array<double>")
    monkeypatch.setattr(shift, "PAIR_ROWS", 8)
    got = {(r.sample_a, r.sample_b): (r.copies_a, r.copies_b, r.rmse) for r in shift.close_pairs(rows, "id", "v", 0.012).collect()}
    d = {(i, j): math.sqrt(((vecs[i] - vecs[j]) ** 2).mean()) for i in range(150) for j in range(i + 1, 150) if 7 not in (i, j)}
    want = {k: (1 + (k[0] == 3), 1 + (k[1] == 3), pytest.approx(v)) for k, v in d.items() if v <= 0.012}
    assert got == {**want, (200, 201): (1, 1, pytest.approx(0.005))} and len(want) > 60


RASTER = {"width": 60, "height": 60, "origin_x": 1330000.0, "origin_y": 1572100.0, "pixel_size": 300.0}


def raster_inputs(spark):
    rng = random.Random(14)
    cells = [(p, r, c, rng.choice((50, 150, 220, 253, 255, rng.randrange(256)))) for p in (0, 1) for r in range(60) for c in range(60) if rng.random() > 0.03]
    patches = [(n, n % 3, "EPSG:32617", 60.0, 0.0, 501000.0 + 700 * n, 0.0, -60.0, 4002500.0 + 300 * n) for n in range(6)]  # no raster for product 2
    return (spark.createDataFrame(patches, "patch_id long, product long, crs string, a double, b double, c double, d double, e double, f double"),
            spark.createDataFrame(cells, "product long, row int, col int, dn int"), {x[:3]: x[3] for x in cells})


def test_targets_find_their_cells_in_one_join(spark):
    patches, cells, dn = raster_inputs(spark)
    rows = raster.align(patches, cells, RASTER, 8, 8).rows
    got = {(r.patch_id, r.row, r.col): (r.nearest_dn, r.bilinear_dn) for r in rows.collect()}
    want = {}
    for t in raster.patch_targets(patches, 8, 8).collect():
        fc, fr = (t.x - 1330000.0) / 300 - 0.5, (1572100.0 - t.y) / 300 - 0.5
        r, c = math.floor(fr), math.floor(fc)
        if 0 <= r <= 58 and 0 <= c <= 58:
            four = [dn.get((t.product, r + i, c + j)) for i in (0, 1) for j in (0, 1)]
            fine = all(v is not None and v <= 253 for v in four)
            smooth = (four[0] * (1 - fc + c) + four[1] * (fc - c)) * (1 - fr + r) + (four[2] * (1 - fc + c) + four[3] * (fc - c)) * (fr - r) if fine else None
            want[t.patch_id, t.row, t.col] = (dn.get((t.product, round(fr), round(fc))), smooth and pytest.approx(smooth))
    assert got == want and len(want) > 100 and any(b is None for _, b in want.values()) and any(b is not None for _, b in want.values())
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate [patch_id" not in plan  # no rows to be put back together


def test_support_under_outlines_follows_runs(spark, monkeypatch):
    patches, cells, dn = raster_inputs(spark)
    e = raster.patch_outline_edges(patches, 16, 16)
    bounds = e.select("geom").distinct().selectExpr("geom", "1330000D xmin", "1348000D xmax", "1554100D ymin", "1572100D ymax")
    under = geometry.inside(geometry.grid_cells(bounds, ["geom"], RASTER), e, ["row", "col"], 1200.0, boundary=False).collect()
    asked, whole = [], raster.center_runs
    monkeypatch.setattr(raster, "center_runs", lambda *a: asked.append(whole(*a).count()) or whole(*a))
    got = {r.patch_id: (r.native_total, r.native_valid, r.native_high) for r in raster.native_support(patches, cells, RASTER, 16, 16).rows.collect()}
    values = {n: [dn.get((n % 3, u.row, u.col)) for u in under if u.geom == n] for n in range(6)}
    assert got == {n: (len(v), sum(x is not None and x <= 253 for x in v), sum(x is not None and 200 <= x <= 253 for x in v)) for n, v in values.items()}
    assert sum(map(len, values.values())) > 20 and asked[0] < 7 * sum(map(len, values.values()))  # runs, not cells


def test_cited_groups_are_parsed_once(spark, rows):
    doc = '{"samples":[1,2],"best":{"test_groups":{"g1":{"per_class":[{"f1":0.1},{"f1":0.2},{"f1":0.7}]},"g2":{"per_class":[{"f1":0.1},{"f1":0.2},{"f1":0.3}]},"g3":{"per_class":[]}}},"bare":{"test_groups":{}}}'
    claims = rows([("d", "regional_high_range:best", "[0.3,0.7]"), ("d", "regional_high_range:bare", "[0.3,0.7]"), ("d", "len(samples)", "3"), ("e", "regional_high_range:best", "[]")],
                  "source string, locator string, recorded string")
    out = audit.provenance_check(claims, rows([("d", doc)], "source string, document string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert out.columns == ["source", "locator", "recorded", "found", "status"]
    assert {(r["source"], r["locator"]): (r["found"], r["status"]) for r in out.collect()} == {
        ("d", "regional_high_range:best"): ("[0.3,0.7]", "VERIFIED"), ("d", "regional_high_range:bare"): (None, "LOCATOR_MISSING"),
        ("d", "len(samples)"): ("2", "DIFFERS"), ("e", "regional_high_range:best"): (None, "SOURCE_MISSING")}
