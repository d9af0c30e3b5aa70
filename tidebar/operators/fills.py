"""Replay of hand-entered fills: position, average price, realised profit and capital after each."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from tidebar.operators.fold import floats, fold_series, micros

RESULT = (
    "seq long, ts timestamp_ntz, action string, price double, quantity double, position double, avg_price double, units int, pnl double, capital double"
)


class _Account:
    def __init__(self, capital: float, long_only: bool):
        self.capital, self.long_only = capital, long_only
        self.position, self.average, self.units, self.seq = 0.0, 0.0, 0, 0

    def fill(self, action: str, price: float, quantity: float) -> float | None:
        """Apply one fill; returns realised profit, null when the fill only opens or adds."""
        if action == "CLOSE":
            realised = self.position * (price - self.average)
            self.position, self.units = 0.0, 0
        else:
            side = 1 if action == "BUY" else -1
            if side * self.position > 0:
                held = abs(self.position)
                self.average = (self.average * held + price * quantity) / (held + quantity)
                self.position += side * quantity
                self.units += 1
                return None
            realised = self.position * (price - self.average) if self.position else None
            if side > 0 or not self.long_only:
                self.position, self.average, self.units = side * quantity, price, 1
            else:
                self.position = 0.0
        self.capital += realised or 0.0
        return realised

    def advance(self, part: pa.RecordBatch) -> Iterator[dict]:
        actions = part.column("action").to_pylist()
        prices, quantities = floats(part, "price"), floats(part, "quantity")
        rows = []
        for action, price, quantity in zip(actions, prices, quantities):
            pnl = self.fill(action, price, quantity)
            self.seq += 1
            rows.append((self.seq, self.position, self.average, self.units, pnl, self.capital))
        seq, position, average, units, pnl, capital = zip(*rows)
        yield {
            "seq": seq, "ts": micros(part, "ts"), "action": actions, "price": prices, "quantity": quantities, "position": position,
            "avg_price": average, "units": units, "pnl": pnl, "capital": capital,
        }

    def finish(self) -> list[dict]:
        return []


def replay_fills(fills: DataFrame, keys: Sequence[str], order: Sequence[str], capital: float, long_only: bool = True) -> DataFrame:
    """fills: keys, ts, action (BUY, SELL, CLOSE), price, quantity and the columns of ``order``."""
    return fold_series(fills, keys, order, lambda key: _Account(capital, long_only), RESULT)
