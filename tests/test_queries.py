"""A spread of registered queries against their SQL on the smallest data."""

import importlib.util
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = ("p01_parse_member", "a02_reference_profile", "a06_group_support", "d07_support_allocation", "d11_balanced_sample", "w09_anchored_selection",
         "w02_coalesced_ranges", "j08_overlap_audit", "j05_connected_components", "e03_region_metrics", "e08_calibration", "g02_point_in_polygon", "q06_unit_normalization")


def load(name, *parts):
    spec = importlib.util.spec_from_file_location(name, os.path.join(ROOT, *parts))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_every_query_is_registered_once():
    entry = load("entry", "__spark_entry__.py")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    tool, entry = load("check", "tools", "check_queries.py"), load("entry", "__spark_entry__.py")
    con = duckdb.connect()
    for t in tool.TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert tool.canonical(df.columns, [tuple(r) for r in df.collect()]) == tool.canonical([d[0] for d in cur.description], cur.fetchall())
