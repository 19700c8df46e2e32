"""Registered queries against their SQL twins, and the shape of their plans."""

import contextlib
import io
import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from stormframe.plans.all import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
# A cross-section by default; STORMFRAME_ALL_QUERIES=1 runs every query.
CHOSEN = (
    "calibration_matrix", "calibration_series", "calibration_reliability", "headline_score", "sample_points", "sample_points_asof",
    "reduce_polygons", "resample_bilinear", "smooth_grid", "tile_pyramid", "evaluate_rules", "rule_transitions", "verify_persistence",
    "verify_lagged_ensemble", "reliability_bins", "verify_advection", "points_in_polygons", "alert_features", "station_records",
    "upsert_files", "prune_files_cascade", "fan_out", "stream_first_seen", "stream_verify_pairs",
)
NAMES = sorted(QUERIES) if os.environ.get("STORMFRAME_ALL_QUERIES") else CHOSEN


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_agrees_with_sql(spark, con, name):
    ok, note = compare(spark, con, name, SMALL)
    assert ok, note


def test_entry(spark):
    assert entry(spark).count() == 9


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(oracle_sql()) <= set(queries())


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize(
    "name", ["sample_points", "reduce_polygons", "match_forecasts", "points_in_polygons", "asof_join", "verify_lagged_ensemble", "fan_out", "upsert_files"]
)
def test_no_nested_loops(spark, name):
    plan = plan_of(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(queries()["lookup_by_key"](spark, SMALL))
    assert "o_totalprice" not in plan
    calibration = plan_of(queries()["calibration_matrix"](spark, SMALL))
    assert "l_extendedprice" not in calibration and "GreaterThanOrEqual(l_shipdate" in calibration
