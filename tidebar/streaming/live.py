"""The live position step as a stateful stream operator.

State per symbol: the few latest bars, the book and the last bar time.  Every bar
goes through the same step as a batch replay.  A bar at or before the last one is a
repeat and is skipped.  A stop row closes what is open at the last close.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidebar.functions.rules import Rules
from tidebar.functions.times import epoch_micros, from_epoch_micros
from tidebar.functions.step import Bar, Book, Closed, Unit, advance, liquidate, opening_book
from tidebar.session import carry_code

STATE = (
    "seen long, last_ts long, cash double, side int, level double, best double, peak_cash double, position_id long, "
    "units array<struct<entry_time: long, price: double, quantity: double, number: int, stop: double>>, "
    "bars array<struct<high: double, low: double, close: double>>"
)
OUTPUT = (
    "symbol string, kind string, ts long, type string, reason string, price double, size double, pnl double, equity double, "
    "top double, floor double, atr double, close double, breakout boolean, leaving boolean, stop_reached boolean, distance_pct double, units int"
)
INPUT = ("kind", "ts", "open", "high", "low", "close")
BAR, STOP = "bar", "stop"


class LiveStep(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.rules = rules
        self.keep = max(rules.entry_len, rules.exit_len, rules.atr_len) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("book", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Start from a stored document: its equity and units, with no bars seen yet."""
        row = initialState.iloc[0]
        units = [(int(u["time"]), u["entry_price"], u["size"], i + 1, u["trailing_stop"]) for i, u in enumerate(row["units"])]
        level = units[-1][1] if units else 0.0
        cash = float(row["equity"])
        self.state.update((0, -1, cash, 1 if units else 0, level, 0.0, cash, len(units[:1]), units, []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        book, recent, seen, last_ts = self._load()
        symbol, out = key[0], []
        batch = pd.concat(list(rows)).sort_values(["ts", "kind"])
        for kind, ts, open_, high, low, close in batch[list(INPUT)].itertuples(index=False):
            if kind == STOP:
                out += self._stop(symbol, book, recent, int(ts))
            elif ts > last_ts:
                seen, last_ts = seen + 1, int(ts)
                out += self._bar(symbol, book, recent, seen, last_ts, open_, high, low, close)
        self._save(book, recent, seen, last_ts)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass

    def _load(self) -> tuple[Book, list, int, int]:
        if not self.state.exists():
            return opening_book(self.rules), [], 0, -1
        seen, last_ts, cash, side, level, best, peak, position, units, bars = self.state.get()
        book = Book(cash, side, [Unit(*u, tag=None) for u in units or []], level, best, peak, position)
        return book, [tuple(b) for b in bars or []], seen, last_ts

    def _save(self, book: Book, recent: list, seen: int, last_ts: int) -> None:
        units = [(u.entry_time, float(u.price), float(u.quantity), u.number, float(u.stop)) for u in book.units]
        self.state.update(
            (seen, last_ts, float(book.cash), book.side, float(book.level), float(book.best), float(book.peak_cash), book.position_id, units, recent)
        )

    def _levels(self, recent: list, high: float, low: float, close: float) -> tuple[float, float, float, float, float]:
        """Channels of the bars before this one, and the mean true range of the last bars with it."""
        rules, nan = self.rules, float("nan")

        def over(values, n, pick):
            return pick(values[-n:]) if len(values) >= n else nan

        highs, lows = [b[0] for b in recent], [b[1] for b in recent]
        last = [*recent, (high, low, close)]
        ranges = [max(h - lo, abs(h - c), abs(lo - c)) for (h, lo, _), (_, _, c) in zip(last[1:], last)]
        atr = sum(ranges[-rules.atr_len :]) / rules.atr_len if len(ranges) >= rules.atr_len else nan
        return (
            over(highs, rules.entry_len, max), over(lows, rules.entry_len, min), over(highs, rules.exit_len, max), over(lows, rules.exit_len, min), atr,
        )

    def _bar(self, symbol, book, recent, seen, ts, open_, high, low, close) -> list[tuple]:
        top, bottom, cap, floor, atr = self._levels(recent, high, low, close)
        recent.append((float(high), float(low), float(close)))
        del recent[: -self.keep]
        stopped = any(close <= u.stop for u in book.units)
        signal = (top, floor, atr, close, high > top, bool(book.units) and low < floor, stopped, (close - top) / top * 100)
        out = []
        if seen > self.rules.warmup:
            held, cash = len(book.units), book.cash
            closed = advance(book, self.rules, Bar(ts, open_, high, low, close, atr, top, bottom, cap, floor))
            out += _exit_rows(symbol, ts, cash, closed, held)
            fresh = [u for u in book.units if u.entry_time == ts]
            out += [
                (symbol, "event", ts, "ENTRY", "Breakout" if u.number == 1 else "Pyramid", u.price, u.quantity, None, book.cash, *[None] * 9) for u in fresh
            ]
        out.append((symbol, "signal", ts, None, None, None, None, None, book.cash, *signal, len(book.units)))
        return out

    def _stop(self, symbol, book, recent, ts) -> list[tuple]:
        if not book.units or not recent:
            return []
        nan, close = float("nan"), recent[-1][2]
        cash = book.cash
        closed = liquidate(book, self.rules, Bar(ts, close, close, close, close, nan, nan, nan, nan, nan))
        return _exit_rows(symbol, ts, cash, [c._replace(exit_reason="Stop Flag") for c in closed], len(closed))


def _exit_rows(symbol: str, ts: int, cash: float, closed: list[Closed], held: int) -> list[tuple]:
    """One exit per position: its units close together."""
    if not closed:
        return []
    size, pnl = sum(c.quantity for c in closed), sum(c.pnl for c in closed)
    return [(symbol, "event", ts, "EXIT", closed[0].exit_reason, closed[0].exit_price, size, pnl, cash + pnl, *[None] * 9)]


def bar_rows(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", F.lit(BAR).alias("kind"), epoch_micros("ts").alias("ts"), "open", "high", "low", "close")


def stop_rows(flags: DataFrame) -> DataFrame:
    """Control rows (symbol, ts) for the same stream."""
    nothing = F.lit(None).cast("double")
    return flags.select("symbol", F.lit(STOP).alias("kind"), epoch_micros("ts").alias("ts"), *[nothing.alias(c) for c in ("open", "high", "low", "close")])


def live_stream(rows: DataFrame, rules: Rules, initial: DataFrame | None = None) -> DataFrame:
    """Events and signals of the live profile over a stream of bar and stop rows.

    ``initial`` (symbol, equity, units) seeds the books.  Needs the RocksDB state store.
    """
    carry_code()
    seed = initial.groupBy("symbol") if initial is not None else None
    found = rows.groupBy("symbol").transformWithStateInPandas(
        LiveStep(rules), outputStructType=OUTPUT, outputMode="Append", timeMode="None", initialState=seed
    )
    return found.withColumn("ts", from_epoch_micros("ts"))


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
