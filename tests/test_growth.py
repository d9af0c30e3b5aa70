"""Steps that many queries share: rows move once, and work follows the size of a group."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.functions.frame import indicator_frame, sweep_frame
from tidebar.functions.rules import breakout_rules
from tidebar.operators import percentiles as pc
from tidebar.operators import replay as stepping
from tidebar.operators.replay import replay
from tidebar.operators.windows import row_slice, running_stages
from tidebar.plans import calendar as cal
from tidebar.plans import resample as rs
from tidebar.plans.equity import underwater


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


@pytest.fixture(scope="module")
def bars(spark):
    rng, rows = random.Random(8), []
    for symbol in ("a", "b"):
        price = 100.0
        for i in range(300):
            price *= math.exp(rng.gauss(0, 0.03))
            rows.append((symbol, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), price, price * 1.02, price * 0.97, price, 1.0, i + 1))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, rn long")


def test_a_replay_moves_its_bars_once(bars):
    frame = indicator_frame(bars, slow=False, placed=True)
    assert plan(replay(frame, [breakout_rules()], placed=True)).count("Exchange") == 1


def test_a_placed_replay_equals_the_one_that_moves_its_frame(bars):
    frame, moved = sweep_frame(bars, [40, 16], 20, placed=True), sweep_frame(bars, [40, 16], 20)
    rules = [breakout_rules()]
    got, expected = ([tuple(r) for r in f.sort("symbol", "kind", "rn", "trade_id").collect()] for f in (replay(frame, rules, placed=True), replay(moved, rules)))
    assert got == expected and len(got) > 600


def test_a_frame_without_the_slow_average_computes_what_is_read(bars):
    assert "ema200" not in indicator_frame(bars, slow=False).columns
    assert plan(indicator_frame(bars, slow=False).select("symbol", "ts", "slope20")).count("Exchange") == 1


def test_stages_share_one_move_of_the_rows(spark):
    rows = [(k, i + 1, float((7 * i) % 11 + 1)) for k in ("a", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "key string, rn long, x double")
    stages = [(lambda d: d, {"top": ("max", F.col("x"))}), (lambda d: d.withColumn("at", F.col("x") == F.col("top")), {"hits": ("count", F.when(F.col("at"), 1))})]
    found = running_stages(df, ["key"], ["rn"], row_slice(rows_per_slice=7), stages)
    for key in ("a", "b"):
        top, hits = 0.0, 0
        for r in found.where(F.col("key") == key).orderBy("rn").collect():
            top = max(top, r["x"])
            hits += r["x"] == top
            assert (r["top"], r["hits"]) == (top, hits)


def test_an_equity_curve_moves_once(spark):
    equity = spark.range(10).select(F.lit("a").alias("symbol"), (F.col("id") + 1).alias("rn"), (F.col("id") + 1.0).alias("equity"))
    text = underwater(equity, ["symbol"])._jdf.queryExecution().optimizedPlan().toString()
    moves = [re.sub(r"#\d+L?|^\W+", "", line) for line in text.splitlines() if "RepartitionByExpression" in line]
    assert moves and len(set(moves)) == 1  # one move of the rows, read by every stage


@pytest.mark.parametrize("trades, slices", [(30, 1), (9000, 3)])
def test_slices_of_a_shuffled_path_follow_its_trades(spark, trades, slices):
    returns = spark.range(trades).select(F.lit("s").alias("symbol"), F.col("id").alias("trade_id"), (F.col("id") % 7 / 1000).alias("ret"))
    steps = rs.permutation_steps(returns, ["symbol"], "trade_id", 2, noise=0.0, slippage=0.0)
    seen = [r["step"] for r in steps.where("path = 1").select("step").orderBy("step").collect()]
    assert seen == list(range(1, trades + 1)) and math.ceil(trades / 4096) == slices
    ends = {round(r["final_equity"], 2) for r in rs.path_results(steps, ["symbol"]).collect()}
    assert ends == {round(100_000 * math.prod(1 + i % 7 / 1000 for i in range(trades)), 2)} or trades > 30


def test_small_and_large_groups_and_nan(spark, monkeypatch):
    monkeypatch.setattr(pc, "FULL", 64)
    rng = np.random.default_rng(5)
    groups = {"small": rng.normal(size=40), "edge": rng.normal(size=64), "large": rng.normal(size=500), "nan": np.array([1.0, 2.0, float("nan")])}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "key string, v double")
    got = {r["key"]: r for r in pc.percentiles(df, ["key"], "v", {"p10": 0.1, "p50": 0.5}).collect()}
    assert set(got) == set(groups) and got["nan"]["p50"] == 2.0
    for key in ("small", "edge", "large"):
        assert [got[key]["p10"], got[key]["p50"]] == pytest.approx(list(np.quantile(groups[key], [0.1, 0.5])))


def test_summaries_of_running_rows_merge_before_they_move(spark):
    rows = [(k, i + 1, float((7 * i) % 11 + 1)) for k in ("a", "b") for i in range(50)]
    df = spark.createDataFrame(rows, "key string, rn long, x double").withColumn("y", F.col("x") + 1)
    found = running_stages(df, ["key"], ["rn"], row_slice(rows_per_slice=7), [(lambda d: d, {"top": ("max", F.col("x"))})])
    text = found._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RepartitionByExpression") == 1  # the rows themselves; the summaries lie where the rows came from


def test_volatility_labels_move_without_their_averages(spark):
    from tidebar.catalog import regime_queries as rq
    from tidebar.functions import regimes as reg

    base = "sf string, sma50 double, sma200 double, ret180 double, vol_ann double, cut double"
    cases = [("a", 1.0, 2.0, -0.05, 1.0, 2.0), ("b", 1.0, 2.0, -0.2, 1.0, 2.0), ("c", 2.0, 1.0, 0.05, None, 2.0), ("d", 2.0, 1.0, 0.2, 3.0, 2.0), ("e", None, 1.0, 0.2, 1.0, None)]
    df = spark.createDataFrame(cases, base).withColumn("crossing", reg.crossing_regime())
    got = {r["sf"]: (r["one"], r["two"]) for r in df.select("sf", reg.volatility_regime(F.col("cut")).alias("one"), reg.volatility_regime(F.col("cut"), F.col("crossing")).alias("two")).collect()}
    want = {"a": "Mild Bear", "b": "Strong Bear", "c": "Mild Bull", "d": "High Volatility", "e": "Neutral"}
    assert got == {k: (v, v) for k, v in want.items()}
    assert rq._volatility(spark, "/root/testdata/sf0.001").columns == ["symbol", "ts", "regime"]


def test_bars_move_before_regimes_repeat_them(spark, bars):
    calendar = cal.calendar_frame(spark, [("all", "2020-01-01", "2020-12-31", "bull"), ("late", "2020-03-01", "2020-10-15", "bear"), ("never", "2030-01-01", "2030-02-01", "chop")])
    placed = cal.regime_bars(bars, calendar, placed=True)
    found = {(r["symbol"], r["regime"], r["ts"]): r["rn"] for r in placed.collect()}
    want, first = {}, dt.datetime(2020, 1, 1)
    for symbol in ("a", "b"):
        want |= {(symbol, "all", first + dt.timedelta(days=i)): i + 1 for i in range(300)}
        want |= {(symbol, "late", first + dt.timedelta(days=i)): i - 59 for i in range(60, 289)}
    assert found == want
    text = plan(cal.replay_by_regime(placed, breakout_rules(entry_len=5, exit_len=3, atr_len=5)))
    assert len(re.findall(r"Exchange hashpartitioning\(symbol#\d+, \d+\), REPARTITION", text)) == 1
    assert not re.findall(r"Exchange hashpartitioning\([^)]*(_slice|_chunk)", text)


def test_a_replay_steps_only_where_a_book_can_change(bars, monkeypatch):
    import pyarrow as pa

    rules = breakout_rules("x", entry_len=20, exit_len=10, long_only=False, short_needs_downtrend=False).with_(warmup=30)
    rows = bars.where("symbol = 'a'").orderBy("rn").toPandas()
    levels = {"atr_20": 3.0, "hi_20": rows["high"].shift(1).rolling(20).max(), "lo_20": rows["low"].shift(1).rolling(20).min(), "hi_10": rows["high"].shift(1).rolling(10).max(), "lo_10": rows["low"].shift(1).rolling(10).min()}
    part = pa.RecordBatch.from_pandas(rows[["rn", "ts", "open", "high", "low", "close"]].assign(**levels), preserve_index=False)
    step, seen = stepping.advance, []

    def counted(book, rules, bar):
        had = len(book.units)
        seen.append((had, len(step_of(book, rules, bar)), len(book.units)))
        return []

    def step_of(book, rules, bar):
        closed.extend(step(book, rules, bar))
        return closed

    closed = []
    monkeypatch.setattr(stepping, "advance", counted)
    whole = stepping._Series([rules])
    blocks = [b for cut in (part[:100], part[100:]) for b in whole.advance(cut)] + list(whole.finish())
    fields = zip(stepping.micros(part, "ts"), *[stepping.floats(part, c) for c in (*stepping.PRICES, *stepping._level_columns(rules))])
    book, total = stepping.opening_book(rules), []
    for rn, values in enumerate(fields, 1):
        bar = stepping.Bar(*values, True, True)
        if rn > rules.warmup:
            step(book, rules, bar)
        total.append(stepping.marked(book, rules, bar)[0] if rn > rules.warmup else book.cash)
    found = [float(x) for b in blocks if "equity" in b for x in b["equity"]]
    assert found[:-1] == total[:-1] and len(found) == 300
    assert all(before or after for before, _, after in seen)  # a book without a position is stepped only to take one
    assert closed and len(seen) < 270
