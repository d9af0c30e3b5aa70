"""Rule replay: indicator frame in, trade ledger and equity curve out, in one pass.

Spark shuffles each series (key x rule chunk) to one place and sorts it; the step
then streams over Arrow batches holding one book per rule, so a series is never
gathered in memory however long it is.  The shuffle spills to disk.  Many rules
over one long series spread over tasks by chunk.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions import regimes as reg
from tidebar.functions import signals as sig
from tidebar.functions.regimes import known
from tidebar.functions.rules import Rules
from tidebar.functions.step import Bar, Closed, advance, liquidate, marked, opening_book
from tidebar.operators.fold import floats, fold_series, micros, numeric, truths

PRICES = ("open", "high", "low", "close")
RESULT = (
    "param_id string, rn long, ts timestamp_ntz, entry_time timestamp_ntz, direction string, entry_price double, exit_price double, "
    "quantity double, pnl double, exit_reason string, unit_number int, position_id long, trade_id long, tag string, "
    "equity double, position_value double, close double, level double, best double, kind string"
)
TRADE_COLUMNS = (
    "param_id trade_id position_id entry_time exit_time direction entry_price exit_price quantity pnl exit_reason unit_number tag"
).split()


def atr_column(rules: Rules) -> str:
    return f"atrp_{rules.atr_len}" if rules.atr_prior else f"atr_{rules.atr_len}"


def gate_columns(rule_list: Sequence[Rules]) -> dict:
    """Per-bar inputs that depend on no position, computed in the JVM once per kind."""
    def sized(rules: Rules) -> Column:
        return reg.mode_size(reg.market_mode(rules.severe_ratio), rules.mild_size, rules.severe_size)

    gates = {
        "ema": lambda: ~known(F.col("close") < F.col("ema200")),
        "trend": lambda: known(F.col("close") > F.col(rules.trend_column)),
        "band": lambda: known(
            (F.col("close") > F.col(rules.trend_column)) & (F.col(atr_column(rules)) / F.col("close") * 100).between(*rules.band)
        ),
        "filters": lambda: F.size(sig.gate_reasons(regime=reg.trend_regime())) == 0,
        "mode": lambda: sized(rules) > 0,
    }
    scales = {
        "volatility": lambda: sig.volatility_scale(F.col("vol50")),
        "mode": lambda: sized(rules),
    }
    tags = {"filters": lambda: reg.trend_regime(), "mode": lambda: reg.market_mode(rules.severe_ratio)}
    columns = {}
    for rules in rule_list:
        if rules.gate_column:
            columns[rules.gate_column] = gates[rules.gate]()
        if rules.scale_column:
            columns[rules.scale_column] = scales[rules.scale]()
        if rules.tag_column:
            columns[rules.tag_column] = tags[rules.gate]()
        if not rules.long_only and rules.short_needs_downtrend:
            columns["downtrend"] = known(F.col("close") < F.col("ema200"))
    return columns


def reads_slow_average(rule_list: Sequence[Rules]) -> bool:
    return any(x.gate == "ema" or (not x.long_only and x.short_needs_downtrend) for x in rule_list)


def input_columns(rule_list: Sequence[Rules]) -> list[str]:
    needed = {atr_column(x) for x in rule_list}
    for rules in rule_list:
        needed |= {f"hi_{rules.entry_len}", f"lo_{rules.entry_len}", f"hi_{rules.exit_len}", f"lo_{rules.exit_len}"}
    return sorted(needed)


def replay(frame: DataFrame, rule_list: Sequence[Rules], keys: Sequence[str] = ("symbol",), rules_per_chunk: int = 64, placed: bool = False) -> DataFrame:
    """Rows of every rule set over every series: kind 'trade' (ledger), 'bar' (equity) and 'open' (state before liquidation).

    ``placed`` rows already lie by key; several chunks of rules are spread again all the same.
    """
    keys, rule_list = list(keys), list(rule_list)
    chunks = [rule_list[i : i + rules_per_chunk] for i in range(0, len(rule_list), rules_per_chunk)]
    gates = gate_columns(rule_list)
    inputs = frame.withColumns(gates).select(*keys, "rn", "ts", *PRICES, *input_columns(rule_list), *gates)
    if len(chunks) > 1:
        spread = F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1)))
    else:
        spread = F.lit(0)
    def start(key: tuple) -> _Series:
        return _Series(chunks[key[-1]])

    return fold_series(inputs.withColumn("_chunk", spread), [*keys, "_chunk"], ["rn"], start, RESULT, keep=keys, placed=placed and len(chunks) == 1)


def _level_columns(rules: Rules) -> tuple:
    return (
        atr_column(rules), f"hi_{rules.entry_len}", f"lo_{rules.entry_len}", f"hi_{rules.exit_len}", f"lo_{rules.exit_len}",
    )


class _Lane:
    """One rule set over one series: its book and the last equity row, held until the next bar is seen."""

    def __init__(self, rules: Rules):
        self.rules, self.book, self.trades = rules, opening_book(rules), 0
        self.held: tuple | None = None


def _opening(rules: Rules, bars: dict[str, np.ndarray], levels: list[np.ndarray], allowed: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Bars on which a book without a position may get one; on all others the step leaves such a book as it is."""
    atr, top, bottom = levels[:3]
    usable = ~np.isnan(atr)
    if rules.stop != "low":
        usable &= ~np.isnan(top)
    if rules.stop != "peak":
        usable &= atr > 0
    tested = bars["close" if rules.entry_test == "close" else "high"]
    broke = tested >= top if rules.entry_test == "touch" else tested > top
    opens = broke & allowed
    if rules.add_test == "reach" and not rules.long_only:
        opens |= ~broke & short & (bars["close"] < bottom)
    return usable & opens


class _Series:
    """The books of one rule chunk over one series, fed part by part."""

    def __init__(self, rule_list: list[Rules]):
        self.lanes = [_Lane(x) for x in rule_list]
        self.last: Bar | None = None

    def advance(self, part: pa.RecordBatch) -> Iterator[dict]:
        numbers, stamps = part.column("rn"), part.column("ts")
        rows = numbers.to_numpy(zero_copy_only=False)
        bars = {c: numeric(part, c) for c in PRICES}
        for lane in self.lanes:
            total, worth, trades = self._step(lane, part, rows, bars)
            first = 0 if lane.rules.full_curve else int(rows.searchsorted(lane.rules.warmup, "right"))
            curve = []
            if first < len(rows):
                curve = [(numbers[first:], stamps[first:], total[first:], worth[first:], bars["close"][first:])]
            if lane.held:
                curve.insert(0, lane.held)
            if curve:
                lane.held = tuple(x[-1:] for x in curve[-1])
                curve[-1] = tuple(x[:-1] for x in curve[-1])
            yield from self._rows(lane.rules.name, curve, trades)
        self.last = Bar(micros(part[-1:], "ts")[0], *[float(bars[c][-1]) for c in PRICES], *[float("nan")] * 5)

    def _step(self, lane: _Lane, part: pa.RecordBatch, rows: np.ndarray, bars: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list]:
        """Equity and position value of each bar and the units closed; bars that can't change the book are passed over."""
        rules, book, count = lane.rules, lane.book, len(rows)
        total, worth, trades = np.full(count, float(book.cash)), np.zeros(count), []
        first = int(rows.searchsorted(rules.warmup, "right"))
        if first == count:
            return total, worth, trades
        part, rows, bars = part[first:], rows[first:].tolist(), {c: x[first:] for c, x in bars.items()}
        levels = [numeric(part, c) for c in _level_columns(rules)]
        always, never = np.ones(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
        allowed = truths(part, rules.gate_column) if rules.gate_column else always
        short = never
        if not rules.long_only:
            short = truths(part, "downtrend") if rules.short_needs_downtrend else always
        opening = np.flatnonzero(_opening(rules, bars, levels, allowed, short)).tolist()
        if not opening and not book.units:
            return total, worth, trades
        columns = [x.tolist() for x in (*bars.values(), *levels, allowed, short)]
        scale = floats(part, rules.scale_column) if rules.scale_column else [1.0] * len(rows)
        tag = part.column(rules.tag_column).to_pylist() if rules.tag_column else [None] * len(rows)
        fields = list(zip(micros(part, "ts"), *columns, scale, tag))
        i = 0
        while i < len(rows):
            if not book.units:
                at = bisect_left(opening, i)
                total[first + i :] = book.cash
                if at == len(opening):
                    break
                i = opening[at]
            bar = Bar._make(fields[i])
            for closed in advance(book, rules, bar):
                lane.trades += 1
                trades.append((rows[i], lane.trades, closed))
            total[first + i], worth[first + i] = marked(book, rules, bar)
            i += 1
        return total, worth, trades

    def finish(self) -> Iterator[dict]:
        for lane in self.lanes:
            trades, curve, book = [], [], lane.book
            if lane.held:
                rn, ts, total, worth, close = lane.held
                if book.units:
                    yield {
                        "param_id": [lane.rules.name], "kind": ["open"], "rn": rn, "ts": ts, "direction": ["long" if book.side > 0 else "short"],
                        "quantity": [book.size], "unit_number": [len(book.units)], "position_id": [book.position_id], "level": [book.level],
                        "best": [book.best],
                    }
                for closed in liquidate(lane.book, lane.rules, self.last):
                    lane.trades += 1
                    trades.append((rn[0].as_py(), lane.trades, closed))
                curve = [(rn, ts, np.array([float(lane.book.cash)]) if lane.rules.closing_row else total, worth, close)]
            yield from self._rows(lane.rules.name, curve, trades)

    def _rows(self, name: str, curve: list[tuple], trades: list[tuple]) -> Iterator[dict]:
        """curve holds stretches of the equity curve: row numbers and times as read, values as arrays."""
        curve = [x for x in curve if len(x[0])]
        if curve:
            rn, ts, total, worth, close = zip(*curve)
            block = {"rn": pa.concat_arrays(rn), "ts": pa.concat_arrays(ts), "equity": np.concatenate(total), "position_value": np.concatenate(worth), "close": np.concatenate(close)}
            count = len(block["rn"])
            yield block | {"param_id": pa.repeat(name, count), "kind": pa.repeat("bar", count)}
        if trades:
            rn, ids, closed = zip(*trades)
            columns = dict(zip(Closed._fields, zip(*closed)))
            columns |= {"rn": rn, "trade_id": ids, "ts": columns.pop("exit_time")}
            yield columns | {"param_id": [name] * len(trades), "kind": ["trade"] * len(trades)}


def trades_of(result: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    ledger = result.where(F.col("kind") == "trade").withColumnRenamed("ts", "exit_time")
    return ledger.select(*keys, *TRADE_COLUMNS)


def equity_of(result: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    return result.where(F.col("kind") == "bar").select(*keys, "param_id", "rn", "ts", "equity", "position_value", "close")


def open_positions(result: DataFrame, frame: DataFrame, rules: Rules, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Positions open at the last bar: trailing stop of the whole position and level of the next unit."""
    keys = list(keys)
    held = result.where((F.col("kind") == "open") & (F.col("param_id") == rules.name))
    bars = frame.select(*keys, "rn", F.col(atr_column(rules)).alias("atr"))
    side = F.when(F.col("direction") == "long", 1).otherwise(-1)
    trigger = F.when(F.col("unit_number") < rules.max_units, F.col("level") + side * rules.spacing * F.col("atr"))
    return held.join(bars, [*keys, "rn"]).select(
        *keys, "ts", "direction", F.col("unit_number").alias("units"), F.col("quantity").alias("size"),
        (F.col("best") - side * rules.trail_mult * F.col("atr")).alias("trail_stop"), trigger.alias("pyramid_trigger"),
    )
