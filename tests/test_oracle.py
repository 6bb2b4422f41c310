"""Every registered query against its SQL equivalent on the smallest tables."""

from pathlib import Path

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

# the queries of the training-text part have tests of their own
QUERIES = {k: f for k, f in entry.queries().items() if f.__module__.startswith("rangelake.plans")}
SQL = {k: s for k, s in entry.oracle_sql().items() if k in QUERIES}

# where the values of a query without SQL are compared
BY_VALUE = {
    "allocated_groups": "test_allocated_groups_values", "tracked_recording": "test_tracked_recording_values",
    "capon_peaks": "test_capon_peaks", "music_peaks": "test_music_peaks",
    "root_music_angles": "test_root_music_and_esprit_angles", "esprit_angles": "test_root_music_and_esprit_angles", "adaptive_beams": "test_adaptive_beams",
    "filter_size_sweep": "test_filter_sweep_energy", "mixed_positions_bartlett": "test_mixed_positions_bartlett", "mixed_positions_capon": "test_mixed_positions_bartlett",
    "capon_point_cloud": "test_capon_recipe_finds_moving_target_only",
}
# run, but with values that nothing compares: only the operators they are made of are
NOT_COMPARED = {"doppler_point_cloud", "raw_scorecard"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    rows, problem = compare(spark, con, name, QUERIES[name], SQL.get(name), sf)
    assert problem is None, problem
    assert rows >= 0


def test_sql_only_for_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_is_compared():
    assert set(BY_VALUE) | NOT_COMPARED == set(QUERIES) - set(SQL)
    tests = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    assert all(f"def {t}(" in tests for t in BY_VALUE.values())


def test_entry(spark, sf):
    assert entry.entry(spark).columns
