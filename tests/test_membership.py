"""Membership audits: every rule has a case that breaks it."""

import pytest
from pyspark.sql import functions as F

from patchwell.checks import RuleViolation
from patchwell.operators import audit, pools, ranking, splits


def verified(spark):
    """Three groups of three classes with ten samples each, one group per split."""
    data = [(f"s{g}_{c}_{i}", c, f"g{g}", f"f{g}", [f"w{g}"], s) for g, s in enumerate(("train", "validation", "test")) for c in range(3) for i in range(10)]
    df = spark.createDataFrame(data, "sample_id string, class_id int, spatial_group_id string, footprint_id string, waterbody_ids array<string>, split string")
    return df.drop("split"), df.select("sample_id", "split")


def rules(df):
    return {r.rule for r in df.collect()}


def test_partition_rules(spark):
    rows, membership = verified(spark)
    assert rules(splits.validate_partition(rows, membership)) == set()
    assert rules(splits.validate_partition(rows, membership.where("sample_id <> 's0_0_0'"))) == {"unassigned_sample"}
    extra = membership.union(spark.createDataFrame([("zz", "train")], membership.schema))
    assert rules(splits.validate_partition(rows, extra)) == {"unknown_sample"}
    moved = membership.withColumn("split", F.when(F.col("sample_id") == "s0_0_0", "test").otherwise(F.col("split")))
    assert rules(splits.validate_partition(rows, moved)) == {"geographic_leakage"}
    shared = rows.withColumn("waterbody_ids", F.when(F.col("sample_id") == "s0_0_0", F.array(F.lit("w0"), F.lit("w2"))).otherwise(F.col("waterbody_ids")))
    assert rules(splits.validate_partition(shared, membership)) == {"geographic_leakage"}
    poor = rows.where("not (class_id = 2 and spatial_group_id = 'g2')")
    assert rules(splits.validate_partition(poor, membership.join(poor, "sample_id", "left_semi"))) == {"missing_class"}


def test_declared_groups_must_match(spark):
    rows, _ = verified(spark)
    plan = spark.createDataFrame([("g0", "train"), ("g1", "validation"), ("g2", "test")], "spatial_group_id string, split string")
    assert splits.declared_split(rows, "spatial_group_id", plan).strict().count() == 90
    with pytest.raises(RuleViolation):
        splits.declared_split(rows, "spatial_group_id", plan.where("spatial_group_id <> 'g2'")).strict()
    more = plan.union(spark.createDataFrame([("g9", "test")], plan.schema))
    assert rules(splits.declared_split(rows, "spatial_group_id", more).violations) == {"unknown_group"}


def test_isolation_and_sealed_labels(spark):
    data = [("TRAIN", "w1", "s1", "false"), ("CONFIRMATION", "w2", "s1", "false"), ("CONFIRMATION", "w3", "", "TRUE"), ("TRAIN", "w4", "", None)]
    df = spark.createDataFrame(data, "split string, waterbody_id string, scene_id string, label_accessed string")
    out = splits.isolation_violations(df, ["waterbody_id", "scene_id"], accessed="label_accessed").collect()
    assert sorted((r.rule, r.key) for r in out) == [("cross_partition", "scene_id=s1"), ("sealed_label_access", "CONFIRMATION")]


def test_exposure_ignores_unknown_values(spark):
    data = [("train", "a"), ("train", None), ("test", "a"), ("test", "a"), ("test", "b"), ("test", None)]
    r = splits.exposure(spark.createDataFrame(data, "split string, k string"), ["k"]).first()
    assert (r.test_rows, r.exposed_rows, r.shared_values, r.fraction) == (4, 2, 1, 0.5)


def test_rotation_and_spacing_do_not_depend_on_order(spark):
    ids = [f"id{i:02d}" for i in range(12)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    a, b = ({r.id: r.split for r in splits.rotation_split(x, "id").collect()} for x in (df, df.orderBy(F.desc("id")).repartition(3)))
    assert a == b and sorted(list(a.values()).count(n) for n in splits.ROUND_ROBIN_NAMES) == [4, 4, 4]
    assert sorted(r.id for r in splits.evenly_spaced(df, "id", 4).collect()) == [ids[i] for i in (0, 3, 7, 11)]
    for n in (500, 5000):  # the number of ranges does not grow with the rows
        numbers = spark.range(n).selectExpr("id * id as v")
        found = numbers.groupBy(ranking.range_bucket(numbers, "v", 16, 1000).alias("b")).agg(F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
        assert len(found) <= 16 and all(x.high < y.low for x, y in zip(found, found[1:], strict=False))
    assert [r.id for r in splits.evenly_spaced(df, "id", 1).collect()] == ["id00"]
    many = spark.range(3000).selectExpr("id % 2 as g", "id")
    assert ranking.first_per_group(many, ["g"], [F.asc("id")], 1200).groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("m")).orderBy("g").collect() == [(0, 1200, 2398), (1, 1200, 2399)]


def test_followup_takes_long_prefixes_of_a_hot_component(spark):
    import datetime as dt
    from test_operators import CENSUS
    seen = [("seen", "g", "s", "t", 0, 0, dt.date(2020, 1, 1), 0, 0, 1, 1, 5)]
    fresh = [(f"c{i}", "g", "s", "t", 0, 0, dt.date(2020, 1, 1) + dt.timedelta(days=i % 60), 64 * (i % 4), 0, 1, 1, 0) for i in range(3000)]
    observed, candidates = (spark.createDataFrame(x, CENSUS) for x in (seen, fresh))
    out = splits.followup_plan(candidates, observed, "spatial_group_id", limit=1024).collect()
    assert len(out) == 1024 and not any(r.near_in_time for r in out)
    wanted = sorted(min(i % 4, 2) for i in range(3000) if i % 60 >= 30)[:1024]
    assert sorted(r.distance for r in out) == wanted


def test_manifest_layers(spark):
    schema = "path string, before_sha256 string, after_sha256 string"
    expected = spark.createDataFrame([(p, "h") for p in "abcde"], "path string, expected_sha256 string")
    observed = spark.createDataFrame([("a", "h"), ("b", "x"), ("c", "y"), ("d", "z")], "path string, sha256 string")
    sanitized = spark.createDataFrame([("b", "h", "x")], schema)
    amended = spark.createDataFrame([("c", "h", "y", "tracked_test_update"), ("d", "h", "z", "other")], schema + ", classification string")
    out = audit.manifest_diff(expected, observed, sanitized, amended)
    assert {r.path: r.status for r in out.rows.collect()} == {"a": "MATCH", "b": "SANITIZED", "c": "REGISTERED", "d": "CHANGED", "e": "MISSING"}
    assert [r.key for r in out.violations.collect()] == ["d"]


def test_inventory_reports_every_problem(spark):
    base = "6_2_X0650_Y0900_S050_2019_04_19_x0_y{}_64x64_5_{}.npy"
    names = [base.format(0, "sen2"), base.format(0, "cyan"), base.format(64, "sen2"), "a/" + base.format(128, "sen2"), "b/" + base.format(128, "sen2"), base.format(128, "cyan"),
             "note.txt", "note.txt"]
    out = pools.pair_inventory(spark.createDataFrame([(n,) for n in names], "member string"))
    assert out.strict_rows.count() == 1
    assert sorted(r.rule for r in out.violations.collect()) == ["ambiguous_kind", "duplicate_name", "unpaired", "unrecognized", "unrecognized"]
