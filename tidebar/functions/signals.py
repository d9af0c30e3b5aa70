"""Entry, exit and gate predicates, position sizes, costs and candle scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebar.functions.regimes import known


def long_breakout(upper: Column) -> Column:
    return known(F.col("close") > upper)


def short_breakout(lower: Column, long_only: Column, use_regime: Column, slow: Column) -> Column:
    return known(~long_only & (F.col("close") < lower) & (~use_regime | (F.col("close") < slow)))


def gate_reasons(rsi_threshold: float = 45.0, regime: Column | None = None) -> Column:
    """Why new positions are barred; empty when trading is allowed."""
    regime = F.col("regime") if regime is None else regime
    return F.array_compact(
        F.array(
            F.when(~known(F.col("close") > F.col("sma200")), F.lit("Below 200 SMA")),
            F.when(F.col("rsi14") < rsi_threshold, F.lit("RSI below threshold")),
            F.when(regime == "Bear", F.lit("Bear market regime")),
        )
    )


def unit_size(equity: Column, atr: Column, risk_pct: Column, stop_mult: Column, lot: Column) -> Column:
    """Risk-based size in whole lots, at least one lot; half lots round to even."""
    stop = atr * stop_mult
    lots = F.rint(equity * (risk_pct / 100) / stop / lot)
    return F.when(stop <= 0, F.lit(0.0)).otherwise(F.greatest(lot, lots * lot))


def capped_size(equity: Column, atr: Column, risk_pct: Column, stop_mult: Column, price: Column) -> Column:
    """Size limited to a quarter of equity; nothing when the notional is 10 or less."""
    size = F.least(equity * (risk_pct / 100) / (stop_mult * atr), equity * 0.25 / price)
    return F.when(size * price > 10, size).otherwise(F.lit(0.0))


def volatility_scale(volatility: Column, target: float = 0.02) -> Column:
    scaled = F.least(F.greatest(F.lit(target) / volatility, F.lit(0.5)), F.lit(2.0))
    return F.when(volatility > 0, scaled).otherwise(F.lit(1.0))


def drawdown_scale(equity: Column, peak: Column, threshold: float = 0.15, cut: float = 0.5) -> Column:
    return F.when((peak - equity) / peak > threshold, F.lit(cut)).otherwise(F.lit(1.0))


def fill_price(price: Column, direction: Column, entering: Column, cost_pct: Column) -> Column:
    """Price after costs: buyers pay more, sellers get less."""
    buying = (direction == "long") == entering
    return price * F.when(buying, 1 + cost_pct / 100).otherwise(1 - cost_pct / 100)


def distance_pct(level: Column) -> Column:
    return (F.col("close") - level) / level * 100


def _whole(value: Column) -> Column:
    return value.cast("int")


def candle_fit(level: Column, trend: Column) -> Column:
    """Fit of a bar with a long breakout, 0 to 100; parts are truncated to whole points."""
    gap = distance_pct(level)
    near = (
        F.when(gap > 0, 40)
        .when(gap > -2, _whole(35 + gap * 2.5))
        .when(gap > -5, _whole(20 + gap * 3))
        .otherwise(F.greatest(F.lit(0), _whole(5 + gap)))
    )
    span = F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low")).otherwise(F.lit(1.0))
    body, place = (F.col("close") - F.col("open")) / span, (F.col("close") - F.col("low")) / span
    strength = (
        F.when(body > 0.6, 20).when(body > 0.3, _whole(10 + body * 16)).when(body > 0, _whole(body * 33)).otherwise(0)
    )
    closing = F.when(place > 0.8, 20).when(place > 0.5, _whole(place * 20)).otherwise(_whole(place * 10))
    rising = (
        F.when(trend > 5, 20).when(trend > 0, _whole(10 + trend * 2)).when(trend > -5, _whole(5 + trend)).otherwise(0)
    )
    near = F.when(level > 0, near).otherwise(0)
    return near + strength + closing + F.when(trend.isNotNull(), rising).otherwise(0)


def fit_rating(score: Column) -> Column:
    return (
        F.when(score >= 80, "EXCELLENT")
        .when(score >= 60, "GOOD")
        .when(score >= 40, "MODERATE")
        .when(score >= 20, "WEAK")
        .otherwise("POOR")
    )
