"""Market regime labels as CASE expressions over the indicator frame.

A comparison with a missing value counts as false, also under negation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def volatility_regime(volatility_cut: Column, crossing: Column | None = None) -> Column:
    """Six labels; top-fifth volatility overrides the SMA-cross labels, here or beforehand taken by crossing_regime."""
    return F.when(F.col("vol_ann") > volatility_cut, "High Volatility").otherwise(crossing_regime() if crossing is None else crossing)


def crossing_regime() -> Column:
    """Five labels from the SMA cross and the last 180 bars; they read one row, so they stand in for its averages where rows move."""
    up, down = F.col("sma50") > F.col("sma200"), F.col("sma50") < F.col("sma200")
    month = F.col("ret180")
    return (
        F.when(down & (month >= -0.1) & (month < 0), "Mild Bear")
        .when(down & (month < -0.1), "Strong Bear")
        .when(up & (month <= 0.1) & (month > 0), "Mild Bull")
        .when(up & (month > 0.1), "Strong Bull")
        .otherwise("Neutral")
    )


def cycle_regime(fall: Column) -> Column:
    """Nine labels; ``fall`` is the drawdown from the running high. Extremes override the rest."""
    close, sma, month = F.col("close"), F.col("sma200"), F.col("ret180")
    above, below = close > sma, close < sma
    return (
        F.when((month < -0.30) & (fall < -0.50), "Capitulation")
        .when((month > 0.40) & (close > sma * 1.5), "Euphoria")
        .when(above & (month > 0.15) & (fall > -0.10), "Strong Bull")
        .when(above & (month > 0) & (month <= 0.15), "Mild Bull")
        .when(below & (month < -0.15) & (fall < -0.30), "Strong Bear")
        .when(below & (month < 0) & (month >= -0.15), "Mild Bear")
        .when(below & (month > 0.05), "Recovery")
        .when((F.abs(close / sma - 1) < 0.10) & (F.abs(month) < 0.10), "Consolidation")
        .otherwise("Neutral")
    )


def trend_regime() -> Column:
    """Four labels from price above its SMA and SMA rising; warm-up rows fall to Bear."""
    above, rising = known(F.col("close") > F.col("sma200")), known(F.col("slope20") > 0)
    return (
        F.when(above & rising, "Bull")
        .when(~above & ~rising, "Bear")
        .when(above, "Bull Weakening")
        .otherwise("Bear Recovering")
    )


def market_mode(severe_ratio: float = 0.90, severe_slope: float = -0.02) -> Column:
    ratio = F.col("ratio200")
    return (
        F.when(ratio > 1.05, "Bull")
        .when((ratio < severe_ratio) & (F.col("slope30") < severe_slope), "Severe Bear")
        .when(ratio < 1.0, "Mild Bear")
        .otherwise("Normal")
    )


def mode_size(mode: Column, mild: float = 0.5, severe: float = 0.0) -> Column:
    return F.when(mode == "Severe Bear", severe).when(mode == "Mild Bear", mild).otherwise(1.0)
