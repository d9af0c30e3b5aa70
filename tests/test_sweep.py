"""Grids, lanes against single books, and the sweep job."""

import datetime as dt
import math
import random
from dataclasses import replace

import numpy as np
import pytest

from tidebar.functions.frame import sweep_frame
from tidebar.functions.lanes import CurveMoments, Lanes, supported
from tidebar.functions.rules import breakout_rules, live_rules, ratchet_rules
from tidebar.functions.step import Bar, advance, liquidate, marked, opening_book
from tidebar.operators.replay import equity_of, replay, trades_of
from tidebar.plans import sweep as sw


@pytest.mark.parametrize(
    "profile, count",
    [("breakout", 2800), ("intrabar", 195), ("band", 1200), ("band_wide", 3360), ("ratchet", 5184), ("ratchet_wide", 2450), ("selective", 27)],
)
def test_grid_sizes(profile, count):
    assert len(sw.grid_points(profile)) == count


def test_grid_frame_agrees_with_points(spark):
    from pyspark.sql import functions as F

    axes = {k: sw.GRIDS["breakout"][k] for k in ("entry_len", "exit_len", "trail_mult")}
    frame = sw.grid_frame(spark, axes, F.col("exit_len") < F.col("entry_len"))
    assert sorted(tuple(r) for r in frame.collect()) == sorted(tuple(p.values()) for p in sw.grid_points("breakout", axes))


def walk(seed, count=600):
    rng, price, bars = random.Random(seed), 100.0, []
    for i in range(count):
        price *= math.exp(rng.gauss(0, 0.03))
        levels = [price * rng.uniform(a, b) for a, b in ((0.97, 1.05), (0.95, 1.03), (1.0, 1.1), (0.9, 1.0))]
        atr = price * 0.03 if rng.random() > 0.02 else rng.choice([0.0, float("nan")])
        bars.append(Bar(i, price, price * 1.02, price * 0.98, price, atr, *levels, rng.random() > 0.1, rng.random() > 0.5))
    return bars


@pytest.mark.parametrize(
    "rule_list",
    [
        [breakout_rules(str(i), trail_mult=2 + i, spacing=0.5 + 0.5 * i, risk_pct=0.5 * (i + 1)) for i in range(4)],
        [breakout_rules(str(i), long_only=False, trail_mult=2 + i, stop_mult=1.5) for i in range(3)],
        [ratchet_rules(str(i), trail_mult=2 + i, stop_mult=2 + i, risk_pct=1 + i) for i in range(4)],
    ],
)
def test_lanes_equal_single_books(rule_list):
    bars, lanes = walk(11), Lanes(rule_list)
    blocks = []
    for rn, b in enumerate(bars, 1):
        each = [np.full(len(rule_list), x) for x in (b.atr, b.top, b.bottom, b.cap, b.floor)]
        lanes.advance(rn, b.high, b.low, b.close, *each, np.full(len(rule_list), b.allowed), b.short_allowed)
        blocks.append(lanes.mark(b.close))
    final = lanes.finish(bars[-1].close).copy()
    for i, rules in enumerate(rule_list):
        book, closed = opening_book(rules), []
        for rn, b in enumerate(bars, 1):
            if rn > rules.warmup:
                closed += advance(book, rules, b)
                if not (b.atr != b.atr or (rules.stop == "close" and b.atr <= 0)):
                    assert blocks[rn - 1][i] == pytest.approx(marked(book, rules, b)[0])
        closed += liquidate(book, rules, bars[-1])
        assert len(closed) > 10
        assert lanes.trades[i] == len(closed) and lanes.wins[i] == sum(c.pnl > 0 for c in closed)
        assert final[i] == pytest.approx(book.cash)
        assert lanes.gain[i] - lanes.loss[i] == pytest.approx(sum(c.pnl for c in closed))


def test_lanes_refuse_families_they_do_not_cover():
    assert not supported(live_rules()) and not supported(breakout_rules(gap_fill=True))


def test_curve_moments_in_blocks():
    rng = np.random.default_rng(2)
    curve = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, (500, 3)), axis=0))
    moments = CurveMoments(curve[0] * 0)
    for block in np.array_split(curve, [1, 7, 8, 300]):
        moments.add(block)
    change = curve[1:] / curve[:-1] - 1
    assert moments.n == 499 and moments.mean == pytest.approx(change.mean(axis=0))
    assert np.sqrt(moments.m2 / 498) == pytest.approx(change.std(axis=0, ddof=1))
    peaks = np.maximum.accumulate(curve, axis=0)
    assert moments.deepest == pytest.approx(((curve - peaks) / peaks).min(axis=0))


@pytest.fixture(scope="module")
def bars(spark):
    rows, rng = [], random.Random(4)
    for symbol in ("a", "b", "c"):
        price = 100.0
        for i in range(420):
            price *= math.exp(rng.gauss(0, 0.03))
            rows.append((symbol, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), price, price * 1.02, price * 0.97, price * rng.uniform(0.98, 1.01), 1.0, i + 1))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, rn long")


def test_sweep_metrics_equal_the_replayed_tables(spark, bars):
    rule_list = [breakout_rules("0", trail_mult=3.0), breakout_rules("1", entry_len=20, exit_len=10)]
    frame = sweep_frame(bars, [40, 16, 20, 10], 20).cache()
    swept = {(r["symbol"], r["param_id"]): r for r in sw.sweep(frame, rule_list, lanes_per_chunk=1).collect()}
    result = replay(frame, rule_list, rules_per_chunk=1).cache()
    curves = equity_of(result).toPandas().sort_values("rn")
    ledger = trades_of(result).toPandas()
    assert len(swept) == 6
    for (symbol, param), part in curves.groupby(["symbol", "param_id"]):
        row, deals = swept[symbol, param], ledger[(ledger["symbol"] == symbol) & (ledger["param_id"] == param)]
        assert row["error"] is None and row["trades"] == len(deals)
        assert row["return_pct"] == pytest.approx((part["equity"].iloc[-1] / 100_000 - 1) * 100)
        peak = part["equity"].cummax()
        assert row["max_dd_pct"] == pytest.approx(((part["equity"] - peak) / peak).min() * 100)
        change = part["equity"].pct_change().dropna()
        assert row["sharpe"] == pytest.approx(change.mean() / change.std() * math.sqrt(365))


def test_replay_does_not_depend_on_batches_or_order(spark, bars):
    frame = sweep_frame(bars, [40, 16], 20).cache()
    rules = [breakout_rules()]

    def rows(df):
        return sorted((r["symbol"], r["rn"], r["kind"], r["trade_id"] or 0, round(r["equity"] or r["pnl"], 6)) for r in df.collect() if r["kind"] != "open")

    before = rows(replay(frame, rules))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(replay(frame.orderBy("close"), rules)) == before
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_robustness_labels(spark):
    rows = [("s", 10, 1.0, 150.0), ("s", 20, 1.0, 140.0), ("s", 30, 2.0, 160.0), ("s", 40, 2.0, -5.0)]
    df = spark.createDataFrame(rows, "symbol string, entry_len int, trail_mult double, return_pct double")
    found = {r["axis"]: r for r in sw.sensitivity(df, ["symbol"], ["entry_len", "trail_mult"]).collect()}
    assert found["entry_len"]["max_cliff"] == pytest.approx(165.0)
    assert found["trail_mult"]["is_plateau"] is False or found["trail_mult"]["std_return"] < found["trail_mult"]["mean_return"] * 0.5
    score = sw.robustness(df, ["symbol"], ["entry_len", "trail_mult"]).collect()[0]
    assert score["pct_profitable"] == 75 and score["verdict"] in ("ROBUST", "MARGINAL", "FRAGILE")


def test_selective_grid_makes_distinct_inputs():
    from tidebar.functions.rules import selective_rules

    points = sw.grid_points("selective")
    made = sw.rules_of("selective", points)
    assert len({x.gate_column for x in made}) == len({x.scale_column for x in made}) == 27
    assert made[0].severe_ratio == points[0]["severe_ratio"] and selective_rules().severe_ratio == 0.9


def mixed_rules(seed):
    rng, out = random.Random(seed), []
    for i in range(24):
        if rng.random() < 0.7:
            fields = {"long_only": rng.random() < 0.5, "max_units": rng.choice([2, 4]), "cost_pct": rng.choice([0.0, 0.05]), "anchor": rng.choice(["close", "fill"]), "end_cost": rng.random() < 0.5}
            out.append(replace(breakout_rules(str(i), trail_mult=rng.uniform(2, 5), spacing=rng.uniform(0.5, 2)), **fields))
        else:
            out.append(ratchet_rules(str(i), trail_mult=rng.uniform(2, 5), stop_mult=rng.uniform(2, 4), max_units=rng.choice([2, 4])))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mixed_rule_lists_are_cut_into_chunks_that_equal_single_books(seed):
    rule_list, bars = mixed_rules(seed), walk(20 + seed, 400)
    assert all(supported(x) for x in rule_list)
    chunks = sw._chunks(rule_list, 8)
    assert sorted(x.name for c in chunks for x in c) == sorted(x.name for x in rule_list)
    for chunk in chunks:
        lanes = Lanes(chunk)
        for rn, b in enumerate(bars, 1):
            each = [np.full(len(chunk), x) for x in (b.atr, b.top, b.bottom, b.cap, b.floor)]
            lanes.advance(rn, b.high, b.low, b.close, *each, np.full(len(chunk), b.allowed), b.short_allowed)
        final = lanes.finish(bars[-1].close)
        for i, rules in enumerate(chunk):
            book = opening_book(rules)
            closed = [c for rn, b in enumerate(bars, 1) if rn > rules.warmup for c in advance(book, rules, b)]
            closed += liquidate(book, rules, bars[-1])
            assert lanes.trades[i] == len(closed) and final[i] == pytest.approx(book.cash)


def test_lanes_refuse_what_they_do_in_one_way_only():
    for other in (breakout_rules("x", entry_test="high", entry_fill="channel"), replace(ratchet_rules("x"), cost_pct=0.05), breakout_rules("x", add_test="breakout")):
        assert not supported(other)
    with pytest.raises(ValueError):
        Lanes([breakout_rules("a"), breakout_rules("b", long_only=False)])


def test_a_failed_step_gives_no_metrics(monkeypatch):
    run, calls = sw._Sweep([breakout_rules("a"), breakout_rules("b")], 365.0), []

    def fails(part):
        calls.append(part)
        raise ValueError("bad batch")

    monkeypatch.setattr(run, "_advance", fails)
    run.advance("one")
    run.advance("two")
    block = run.finish()[0]
    assert calls == ["one"] and block["final_equity"] == [None, None] and block["error"] == ["ValueError: bad batch"] * 2


def _part(bars):
    import pyarrow as pa

    names = {"hi_40": "top", "lo_40": "bottom", "hi_16": "cap", "lo_16": "floor", "atr_20": "atr", "high": "high", "low": "low", "close": "close"}
    columns = {c: [getattr(b, f) for b in bars] for c, f in names.items()}
    return pa.RecordBatch.from_pydict({"rn": list(range(1, len(bars) + 1)), **columns, "downtrend": [bool(b.short_allowed) for b in bars]})


def test_short_series_step_together_and_equal_their_own_sweeps(monkeypatch):
    """Many series share the steps of one lane pass; a series too long for that streams by itself; results are those of each alone."""
    rule_list = [breakout_rules(str(i), long_only=False, trail_mult=2 + i) for i in range(3)]
    series = [(("s", i, 0), _part(walk(40 + i, n))) for i, n in enumerate((300, 420, 1, 250, 900, 600))]
    passes, made = [], sw._stepped
    monkeypatch.setattr(sw, "_stepped", lambda sweep, parts: passes.append(len(parts)) or made(sweep, parts))
    monkeypatch.setattr(sw, "SIDE_BY_SIDE_CELLS", 3 * 700)

    def start(_):
        return sw._Sweep(rule_list, 365.0)

    cut = [(key, part.slice(at, 128)) for key, part in series for at in range(0, part.num_rows, 128)]
    together = dict(sw._side_by_side(iter(cut), start))
    assert sum(passes) == 5 and max(passes) > 1  # the series of 900 bars streams
    for key, part in series:
        alone = start(key)
        alone._advance(part)
        for name, values in alone.finish()[0].items():
            found = together[key][name]
            assert list(found) == list(values) if name in ("param_id", "error") else found == pytest.approx(values, nan_ok=True)


def test_a_bad_series_does_not_fail_those_beside_it():
    rule_list = [breakout_rules("a"), breakout_rules("b")]
    good, bad = _part(walk(3, 300)), _part(walk(4, 300)).drop_columns(["close"])
    bad = bad.append_column("close", __import__("pyarrow").array(["x"] * 300))
    parts = [((n, 0), p) for n, p in (("good", good), ("bad", bad))]
    found = dict(sw._side_by_side(iter(parts), lambda _: sw._Sweep(rule_list, 365.0)))
    assert found["good", 0]["error"] == [None, None] and found["bad", 0]["error"][0].startswith("ValueError")
