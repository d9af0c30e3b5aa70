"""The position step for many rule sets at once: one numpy lane per set.

Used by sweeps, which need metrics and no ledger.  Covers the rule families whose
stop follows the best price ("peak") and whose unit stops are tested on the close
("close"); tests hold it to the one-book step.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from tidebar.functions.rules import Rules, breakout_rules, ratchet_rules


#: What the lanes do in just one way: any other value of these fields needs replay().
FORM = (
    "entry_test", "entry_fill", "add_test", "add_fill", "exit_test", "exit_fill", "channel_first", "ratchet_late", "sizing", "max_notional", "drawdown_cut",
    "commission_pct", "notional_equity", "gap_fill", "scale", "short_needs_downtrend",
)
#: What all sets of one chunk have in common.
SHARED = ("stop", "long_only", "max_units", "lot", "min_size", "cost_pct", "anchor", "end_cost", "closing_row", "full_curve")


def supported(rules: Rules) -> bool:
    family = {"peak": breakout_rules, "close": ratchet_rules}.get(rules.stop)
    if family is None or any(getattr(rules, f) != getattr(family("form"), f) for f in FORM):
        return False
    return rules.stop == "peak" or (rules.long_only and not rules.cost_pct)


class Lanes:
    """Books of L rule sets over one series, or over ``copies`` series side by side.  All sets agree on the fields in SHARED."""

    def __init__(self, rule_list: Sequence[Rules], copies: int = 1):
        first = rule_list[0]
        if any(getattr(x, f) != getattr(first, f) for x in rule_list for f in SHARED):
            raise ValueError("the sets of a chunk differ in a field they have to share")
        self.rules, count = first, len(rule_list) * copies

        def of(name):
            return np.tile([float(getattr(x, name)) for x in rule_list], copies)

        self.trail, self.stop_mult, self.risk, self.spacing = of("trail_mult"), of("stop_mult"), of("risk_pct") / 100, of("spacing")
        self.warmup = of("warmup")
        self.cash = of("capital")
        self.side = np.zeros(count)
        self.held = np.zeros(count, dtype=int)
        self.price = np.zeros((count, first.max_units))
        self.quantity = np.zeros((count, first.max_units))
        self.stops = np.zeros((count, first.max_units))
        self.level, self.best = np.zeros(count), np.zeros(count)
        self.size, self.paid = np.zeros(count), np.zeros(count)
        self.trades, self.wins = np.zeros(count, dtype=int), np.zeros(count, dtype=int)
        self.gain, self.loss = np.zeros(count), np.zeros(count)
        self.cost = first.cost_pct / 100

    def _settle(self, lanes: np.ndarray, price: np.ndarray) -> None:
        pnl = self.side[lanes, None] * self.quantity[lanes] * (price[:, None] - self.price[lanes])
        self.cash[lanes] += pnl.sum(axis=1)
        self.trades[lanes] += self.held[lanes]
        self.wins[lanes] += (pnl > 0).sum(axis=1)
        self.gain[lanes] += np.where(pnl > 0, pnl, 0).sum(axis=1)
        self.loss[lanes] += np.where(pnl < 0, -pnl, 0).sum(axis=1)
        self.quantity[lanes] = 0
        self.held[lanes] = 0
        self.side[lanes] = self.size[lanes] = self.paid[lanes] = 0

    def _add(self, lanes: np.ndarray, side: np.ndarray, close: np.ndarray, atr: np.ndarray) -> np.ndarray:
        """Buy one unit in each lane; returns the lanes whose size was not zero."""
        stop = self.stop_mult[lanes] * atr
        with np.errstate(divide="ignore", invalid="ignore"):
            wanted = self.cash[lanes] * self.risk[lanes] / stop
        if self.rules.sizing == "lots":
            size = np.maximum(self.rules.min_size, np.rint(wanted / self.rules.lot) * self.rules.lot)
        else:
            size = np.minimum(wanted, self.cash[lanes] * 0.25 / close)
            size = np.where(size * close > 10, size, 0.0)
        bought = (stop > 0) & (size > 0)
        lanes, side, size, stop, close = lanes[bought], side[bought], size[bought], stop[bought], close[bought]
        fill = close * (1 + side * self.cost)
        slot = self.held[lanes]
        self.price[lanes, slot], self.quantity[lanes, slot] = fill, size
        self.stops[lanes, slot] = fill - stop
        self.held[lanes] += 1
        self.side[lanes] = side
        self.size[lanes] += size
        self.paid[lanes] += fill * size
        self.level[lanes] = fill if self.rules.anchor == "fill" else close
        return lanes

    def advance(self, rn, high, low, close, atr, top, bottom, cap, floor, allowed, downtrend) -> None:
        """One bar; atr, the channel levels and the gate come per lane (a plain True gates nothing), rn, prices and downtrend per lane or once."""
        live = (rn > self.warmup) & (atr == atr) & (top == top)
        if not live.any():
            return
        high, low, close, downtrend = (np.broadcast_to(x, live.shape) for x in (high, low, close, downtrend))
        if self.rules.stop == "peak":
            self._advance_peak(live, high, low, close, atr, top, bottom, cap, floor, allowed, downtrend)
        else:
            self._advance_close(live & (atr > 0), high, low, close, atr, top, floor, allowed)

    def _advance_peak(self, live, high, low, close, atr, top, bottom, cap, floor, allowed, downtrend) -> None:
        in_long, in_short = live & (self.side > 0), live & (self.side < 0)
        if in_long.any() or in_short.any():
            self.best = np.where(in_long, np.maximum(self.best, high), np.where(in_short, np.minimum(self.best, low), self.best))
            stop = self.best - self.side * self.trail * atr
            hit = (in_long & (low <= stop)) | (in_short & (high >= stop))
            leaves = (in_long & (close < floor)) | (in_short & (close > cap))
            shut = np.flatnonzero(hit | leaves)
            if shut.size:
                raw = np.where(hit[shut], stop[shut], close[shut])
                self._settle(shut, raw * (1 - self.side[shut] * self.cost))
        broke = live & (close > top)
        goes_long = broke & (self.side <= 0) & allowed
        opens = goes_long
        if not self.rules.long_only:
            goes_short = live & downtrend & ~goes_long & ~broke & (close < bottom) & (self.side >= 0)
            opens = goes_long | goes_short
        at = np.flatnonzero(opens)
        if at.size:
            turning = at[self.side[at] != 0]
            if turning.size:
                self._settle(turning, close[turning] * (1 - self.side[turning] * self.cost))
            side = np.where(goes_long[at], 1.0, -1.0)
            bought = self._add(at, side, close[at], atr[at])
            self.best[bought] = np.where(self.side[bought] > 0, high[bought], low[bought])
        reach = np.where(self.side > 0, high >= self.level + self.spacing * atr, low <= self.level - self.spacing * atr)
        adds = np.flatnonzero(live & (self.side != 0) & (self.held < self.rules.max_units) & reach)
        if adds.size:
            self._add(adds, self.side[adds], close[adds], atr[adds])

    def _advance_close(self, live, high, low, close, atr, top, floor, allowed) -> None:
        holding = live & (self.held > 0)
        if holding.any():
            stopped = ((self.quantity > 0) & (close[:, None] <= self.stops)).any(axis=1)
            shut = np.flatnonzero(holding & ((low < floor) | stopped))
            kept = holding.copy()
            kept[shut] = False
            if shut.size:
                self._settle(shut, close[shut])
            trail = (close - self.trail * atr)[kept, None]
            self.stops[kept] = np.maximum(self.stops[kept], trail)
        room = live & allowed & (high > top) & (self.held < self.rules.max_units)
        adds = np.flatnonzero(room & ((self.held == 0) | (close >= self.level + self.spacing * atr)))
        if adds.size:
            self._add(adds, np.ones(adds.size), close[adds], atr[adds])

    def mark(self, close: float | np.ndarray) -> np.ndarray:
        return self.cash + self.side * (self.size * close - self.paid)

    def finish(self, close: float | np.ndarray) -> np.ndarray:
        """Liquidate what is open and return the final equity."""
        rest = np.flatnonzero(self.held)
        if rest.size:
            cost = self.side[rest] * self.cost if self.rules.end_cost else 0.0
            self._settle(rest, np.broadcast_to(close, self.held.shape)[rest] * (1 - cost))
        return self.cash


class CurveMoments:
    """Running drawdown and return moments of L equity curves, fed in blocks of rows."""

    def __init__(self, start: np.ndarray):
        self.peak = np.full_like(start, -np.inf)
        self.deepest = np.zeros_like(start)
        self.last: np.ndarray | None = None
        self.rows = 0
        self.n = 0
        self.mean, self.m2 = np.zeros_like(start), np.zeros_like(start)

    def add(self, block: np.ndarray) -> None:
        if not len(block):
            return
        self.rows += len(block)
        peaks = np.maximum(np.maximum.accumulate(block, axis=0), self.peak)
        self.deepest = np.minimum(self.deepest, ((block - peaks) / peaks).min(axis=0))
        self.peak = peaks[-1]
        before = block[:-1] if self.last is None else np.vstack([self.last, block[:-1]])
        after = block[1:] if self.last is None else block
        self.last = block[-1]
        if not len(after):
            return
        change = after / before - 1
        n, mean = len(change), change.mean(axis=0)
        m2 = ((change - mean) ** 2).sum(axis=0)
        total, shift = self.n + n, mean - self.mean
        self.m2 += m2 + shift**2 * self.n * n / total
        self.mean += shift * n / total
        self.n = total
