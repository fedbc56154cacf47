"""Registered queries against their SQL at the smallest scale; ``check.py`` runs them all."""

import shutil

import pytest

import __spark_entry__ as entry
import check
from catalog import load

SF = "/root/testdata/sf0.001"
SAMPLE = ["flagship_momentum_quintiles", "w1_forward_returns_timestamps", "w4_trailing_zscore_timestamps",
          "w6_rolling_mean_timestamps", "w9_quantile_bucket_lopsided_group", "s2_validate_report", "c1_clean_ohlcv",
          "c3_align_to_calendar", "j1_asof_join", "j3_asof_timestamps", "j7_align_events", "i3_rsi", "i5_macd",
          "i7_hysteresis_signals", "e3_realized_pnl", "e5_equity_curve", "e13_performance_summary", "a3_quantile_returns",
          "a5_ic_by_period", "r1_award_velocity", "r7_fama_macbeth_two", "r9_event_cars", "r10_caar", "r13_large_events",
          "t1_filing_diff", "t4_skill_acceleration", "t6_contract_surprise_by_symbol", "s1_read_bars_csv",
          "s17_revenue_rows", "s22_chart_bars"]


@pytest.fixture(scope="module")
def con():
    return check.oracle_connection(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    problem, rows = check.compare(spark, con, SF, name)
    assert problem is None, problem
    assert rows > 0


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    names, sql = map(set, load())
    assert sql <= names and len(names) >= 140 and len(sql) >= len(names) - 3


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """The smallest tables with every event three times over: fills of one symbol share their instants."""
    folder = tmp_path_factory.mktemp("tied")
    for t in set(check.TABLES) - {"events"}:
        shutil.copy(f"{SF}/{t}.parquet", folder)
    check.duckdb.sql(f"copy (select event_id+1000000*i event_id, ts, user_id+1000000*i user_id, event_type, value, props "
                     f"from '{SF}/events.parquet', range(3) t(i)) to '{folder}/events.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["i2_ema_gaps_timestamps", "i3_rsi_gaps_timestamps", "i5_macd_gaps_timestamps"])
def test_fills_of_one_instant(spark, tied, name):
    problem, rows = check.compare(spark, check.oracle_connection(tied), tied, name)
    assert problem is None, problem
    assert rows > 3000
