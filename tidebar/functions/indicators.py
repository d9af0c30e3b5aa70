"""Rolling indicators as column builders over one window of a series.

Each takes the window ordered by time and returns a Column.  A rolling value is
null until its frame holds ``n`` non-null inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _full(value: Column, frame: WindowSpec, n: int, result: Column) -> Column:
    return F.when(F.count(value).over(frame) == n, result)


def rolling(fn: str, value: Column, w: WindowSpec, n: int, shift: int = 0) -> Column:
    """fn over the n rows ending ``shift`` rows before the current one."""
    frame = w.rowsBetween(-n + 1 - shift, -shift)
    return _full(value, frame, n, getattr(F, fn)(value).over(frame))


def rolling_partial(fn: str, value: Column, w: WindowSpec, n: int, shift: int = 0) -> Column:
    return getattr(F, fn)(value).over(w.rowsBetween(-n + 1 - shift, -shift))


def channel_prior(w: WindowSpec, n: int) -> tuple[Column, Column]:
    return rolling("max", F.col("high"), w, n, 1), rolling("min", F.col("low"), w, n, 1)


def channel_inclusive(w: WindowSpec, n: int) -> tuple[Column, Column]:
    return rolling("max", F.col("high"), w, n), rolling("min", F.col("low"), w, n)


def channel_partial(w: WindowSpec, n: int) -> tuple[Column, Column]:
    """Warm-up allowed: earlier rows as far as they exist, a first bar stands for itself."""
    upper = F.coalesce(rolling_partial("max", F.col("high"), w, n, 1), F.col("high"))
    lower = F.coalesce(rolling_partial("min", F.col("low"), w, n, 1), F.col("low"))
    return upper, lower


def true_range(w: WindowSpec, first_null: bool = False) -> Column:
    before = F.lag("close").over(w)
    spread = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return F.when(before.isNotNull(), spread) if first_null else spread


def pct_change(value: Column, w: WindowSpec, k: int = 1) -> Column:
    before = F.lag(value, k).over(w)
    return F.when(before != 0, value / before - 1)


def gain_and_loss(change: Column) -> tuple[Column, Column]:
    """A missing change counts as no move."""
    return F.when(change > 0, change).otherwise(0.0), F.when(change < 0, -change).otherwise(0.0)


def rsi(up: Column, down: Column) -> Column:
    """Relative strength from the simple means of gains and losses; zero loss as 1e-10."""
    strength = up / F.when(down == 0, F.lit(1e-10)).otherwise(down)
    return 100 - 100 / (1 + strength)
