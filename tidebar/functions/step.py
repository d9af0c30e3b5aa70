"""One bar of position bookkeeping.  Free of Spark: batch and stream jobs both call it.

Order inside a bar: exits, entries, added units, stop moves, equity mark.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, NamedTuple

from tidebar.functions.rules import Rules


class Bar(NamedTuple):
    ts: Any
    open: float
    high: float
    low: float
    close: float
    atr: float
    top: float  # entry channel
    bottom: float
    cap: float  # exit channel
    floor: float
    allowed: bool = True
    short_allowed: bool = False
    scale: float = 1.0
    tag: str | None = None


class Closed(NamedTuple):
    entry_time: Any
    exit_time: Any
    direction: str
    entry_price: float
    exit_price: float
    quantity: float
    pnl: float
    exit_reason: str
    unit_number: int
    position_id: int
    tag: str | None


@dataclass
class Unit:
    entry_time: Any
    price: float
    quantity: float
    number: int
    stop: float
    tag: str | None


@dataclass
class Book:
    cash: float
    side: int = 0
    units: list[Unit] = field(default_factory=list)
    level: float = 0.0  # price the next unit's distance counts from
    best: float = 0.0  # best price since entry
    peak_cash: float = 0.0
    position_id: int = 0

    @property
    def size(self) -> float:
        return sum(u.quantity for u in self.units)


def opening_book(rules: Rules) -> Book:
    return Book(cash=rules.capital, peak_cash=rules.capital)


def _settle(book: Book, rules: Rules, unit: Unit, ts: Any, price: float, reason: str) -> Closed:
    fees = (unit.price + price) * unit.quantity * rules.commission_pct / 100
    pnl = book.side * unit.quantity * (price - unit.price) - fees
    book.cash += pnl
    return Closed(
        unit.entry_time, ts, "long" if book.side > 0 else "short", unit.price, price, unit.quantity, pnl, reason,
        unit.number, book.position_id, unit.tag,
    )


def _close_all(book: Book, rules: Rules, ts: Any, raw: float, reason: str, cost: bool = True) -> list[Closed]:
    price = raw * (1 - book.side * rules.cost_pct / 100) if cost else raw
    closed = [_settle(book, rules, u, ts, price, reason) for u in book.units]
    book.units, book.side = [], 0
    return closed


def _exits(book: Book, rules: Rules, bar: Bar) -> list[Closed]:
    side = book.side
    if rules.stop == "low":
        return _unit_exits(book, rules, bar)
    if rules.exit_test == "close":
        left_channel = bar.close < bar.floor if side > 0 else bar.close > bar.cap
    elif rules.exit_test == "touch":
        left_channel = bar.low <= bar.floor
    else:
        left_channel = bar.low < bar.floor
    if rules.stop == "peak":
        book.best = max(book.best, bar.high) if side > 0 else min(book.best, bar.low)
        stop = book.best - side * rules.trail_mult * bar.atr
        stopped = bar.low <= stop if side > 0 else bar.high >= stop
        if rules.gap_fill and side * (bar.open - stop) < 0:
            stop = bar.open
    else:
        stop = bar.close
        stopped = any(bar.close <= u.stop for u in book.units)
    if left_channel and (rules.channel_first or not stopped):
        raw = bar.floor if rules.exit_fill == "channel" else bar.close
        return _close_all(book, rules, bar.ts, raw, rules.exit_reason)
    if stopped:
        return _close_all(book, rules, bar.ts, stop, rules.stop_reason)
    if rules.stop == "close" and not rules.ratchet_late:
        _ratchet(book, rules, bar)
    return []


def _ratchet(book: Book, rules: Rules, bar: Bar) -> None:
    trail = bar.close - rules.trail_mult * bar.atr
    for unit in book.units:
        if trail > unit.stop:
            unit.stop = trail


def _unit_exits(book: Book, rules: Rules, bar: Bar) -> list[Closed]:
    """Each unit on its own stop, moved before it is tested; only hit units close."""
    _ratchet(book, rules, bar)
    closed, kept = [], []
    for unit in book.units:
        if bar.low <= unit.stop:
            raw, reason = min(bar.close, unit.stop), rules.stop_reason
        elif bar.low <= bar.floor:
            raw, reason = bar.close, rules.exit_reason
        else:
            kept.append(unit)
            continue
        closed.append(_settle(book, rules, unit, bar.ts, raw * (1 - rules.cost_pct / 100), reason))
    book.units = kept
    if not kept:
        book.side = 0
    return closed


def _sized(book: Book, rules: Rules, bar: Bar, price: float) -> float:
    """Units to buy; zero when a cap forbids the fill."""
    stop = rules.stop_mult * bar.atr
    if stop <= 0:
        return 0.0
    wanted = book.cash * (rules.risk_pct / 100) / stop * bar.scale
    if rules.drawdown_cut:
        book.peak_cash = max(book.peak_cash, book.cash)
        if (book.peak_cash - book.cash) / book.peak_cash > 0.15:
            wanted *= rules.drawdown_cut
    if rules.sizing == "capped":
        size = min(wanted, book.cash * 0.25 / bar.close)
        return size if size * bar.close > 10 else 0.0
    if rules.sizing == "clamped":
        return max(0.0001, min(wanted, 0.1))
    size = max(rules.min_size, round(wanted / rules.lot) * rules.lot)
    if rules.max_notional:
        held = sum(u.quantity * u.price for u in book.units)
        if held + size * price > book.cash * rules.max_notional:
            return 0.0
    return size


def _buy(book: Book, rules: Rules, bar: Bar, side: int, fill: str) -> None:
    raw = bar.top if fill == "channel" else bar.close
    price = raw * (1 + side * rules.cost_pct / 100)
    size = _sized(book, rules, bar, price)
    if size <= 0:
        return
    if not book.units:
        book.position_id += 1
        book.side = side
        book.best = bar.high if side > 0 else bar.low
    elif rules.add_test == "breakout" and rules.stop == "peak":
        book.best = bar.high
    stop = price - rules.stop_mult * bar.atr
    book.units.append(Unit(bar.ts, price, size, len(book.units) + 1, stop, bar.tag))
    book.level = price if rules.anchor == "fill" else bar.close


def _entries(book: Book, rules: Rules, bar: Bar) -> list[Closed]:
    closed: list[Closed] = []
    if rules.entry_test == "close":
        broke = bar.close > bar.top
    elif rules.entry_test == "high":
        broke = bar.high > bar.top
    else:
        broke = bar.high >= bar.top
    if rules.add_test == "reach":
        if broke and bar.allowed and book.side <= 0:
            want = 1
        elif not rules.long_only and not broke and bar.short_allowed and bar.close < bar.bottom and book.side >= 0:
            want = -1
        else:
            want = 0
        if want:
            if book.side:
                closed = _close_all(book, rules, bar.ts, bar.close, "Reversal")
            _buy(book, rules, bar, want, rules.entry_fill)
        side = book.side
        if side and len(book.units) < rules.max_units:
            level = book.level + side * rules.spacing * bar.atr
            if bar.high >= level if side > 0 else bar.low <= level:
                _buy(book, rules, bar, side, rules.add_fill)
    elif broke and bar.allowed and len(book.units) < rules.max_units:
        if not book.units:
            _buy(book, rules, bar, 1, rules.entry_fill)
        elif bar.close >= book.level + rules.spacing * bar.atr:
            _buy(book, rules, bar, 1, rules.add_fill)
    return closed


def usable(rules: Rules, bar: Bar) -> bool:
    """Missing values arrive as NaN; unit-stop profiles also skip an ATR of zero."""
    if bar.atr != bar.atr or (rules.stop != "low" and bar.top != bar.top):
        return False
    return rules.stop == "peak" or bar.atr > 0


def advance(book: Book, rules: Rules, bar: Bar) -> list[Closed]:
    """Apply one bar; returns the units closed in it."""
    if not usable(rules, bar):
        return []
    closed = _exits(book, rules, bar) if book.units else []
    closed += _entries(book, rules, bar)
    if rules.ratchet_late and book.units:
        _ratchet(book, rules, bar)
    return closed


def marked(book: Book, rules: Rules, bar: Bar) -> tuple[float, float]:
    """Equity and signed position value at the close of the bar."""
    if not book.units:
        return book.cash, 0.0
    held = book.size * bar.close
    if not usable(rules, bar):
        return book.cash, book.side * held
    if rules.notional_equity:
        return book.cash + held, book.side * held
    gain = book.side * sum(u.quantity * (bar.close - u.price) for u in book.units)
    return book.cash + gain, book.side * held


def liquidate(book: Book, rules: Rules, bar: Bar) -> list[Closed]:
    return _close_all(book, rules, bar.ts, bar.close, "End of Backtest", rules.end_cost) if book.units else []
