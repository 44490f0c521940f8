"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import TABLES, compare, connect

SF = "/root/testdata/sf0.001"
# One query per area; set RANGEBREAK_ALL=1 to run every one of them.
SAMPLE = (
    "is_trading_day sessionize opening_range rvol_at_time atr_wilder index_breakout_state label_sessions "
    "base_rates feature_table session_verdicts symbol_outcomes scan_bars upsert_sessions eligible_pool "
    "bust_rate_by_third exit_partial_1r results_table matched_random poison_future frame_diff"
).split()
ALL = os.environ.get("RANGEBREAK_ALL") == "1"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", list(QUERIES) if ALL else SAMPLE)
def test_query_agrees_with_sql(spark, con, key):
    problems, _, _ = compare(spark, con, SF, key, QUERIES[key], SQL.get(key))
    assert not problems


@pytest.mark.parametrize("price", ["1000", "day(l_shipdate)"], ids=["no_setup_signals", "only_orb_signals"])
def test_setup_without_signals_is_counted_by_query_and_sql(spark, con, tmp_path, price):
    for table in TABLES:
        if table != "lineitem":
            (tmp_path / f"{table}.parquet").symlink_to(f"{SF}/{table}.parquet")
    con.execute(
        f"copy (select * replace (l_quantity * {price} as l_extendedprice) from lineitem) to '{tmp_path}/lineitem.parquet'"
    )
    problems, rows, _ = compare(
        spark, connect(tmp_path), str(tmp_path), "setup_run_counts", QUERIES["setup_run_counts"], SQL["setup_run_counts"]
    )
    assert not problems and rows == 2


def test_entry_has_rows_and_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema and first.count() > 0
