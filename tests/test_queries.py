"""Registered queries beside their SQL on the smallest tables; ORACLE_ALL=1 runs every one."""

import os
import re

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "daily_bars", "previous_bar", "channel_partial", "exponential_average", "relative_strength", "missing_bars", "gate_reasons", "candle_fit",
    "latest_signals", "volatility_regimes", "regime_runs", "transition_matrix", "replay_two_sided_trades", "replay_intrabar_equity",
    "replay_ratchet_trades", "replay_filtered_trades", "replay_selective_equity", "trade_stats", "trade_breakdowns", "worst_losing_streak",
    "deep_drawdowns", "stalling_periods", "trades_in_stalls", "equity_stats", "period_returns", "parse_ohlc_envelope", "live_log_stats",
    "manual_fills_two_sided", "parameter_sweep", "robustness_scores", "nearest_quote_at_entry", "regime_statistics", "profit_sweeps",
    "permutation_paths", "cost_comparison", "stream_trade_events",
)
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(SQL) if os.environ.get("ORACLE_ALL") else SAMPLE)
def test_query_equals_sql(spark, con, name):
    text, good = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert good, text


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
    own = {name for name in QUERIES if not re.fullmatch(r"op\d+_\w+|pipeline", name)}  # corpus queries have tests of their own
    assert own - set(SQL) == {"parameter_sweep_full_grid"}
