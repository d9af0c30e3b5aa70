"""Questions over the trade ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.times import seconds_between
from tidebar.operators.windows import row_slice, running


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def won() -> Column:
    return F.col("pnl") > 0


def lost() -> Column:
    return F.col("pnl") < 0


def when_won(c) -> Column:
    return F.when(won(), _col(c))


def when_lost(c) -> Column:
    return F.when(lost(), _col(c))


def ratio(top: Column, bottom: Column) -> Column:
    """Division whose zero denominator gives null; the one rule for all ratios."""
    return F.when(bottom != 0, top / bottom)


def profit_factor() -> Column:
    return ratio(F.sum(when_won("pnl")), F.abs(F.sum(when_lost("pnl"))))


def measured(trades: DataFrame, bar_seconds: int) -> DataFrame:
    """Ledger with notional, percentage profit and holding times."""
    held = seconds_between("entry_time", "exit_time")
    value = F.col("quantity") * F.col("entry_price")
    return (
        trades.withColumn("trade_value", value)
        .withColumn("pnl_pct", ratio(F.col("pnl"), value) * 100)
        .withColumn("holding_hours", held / 3600)
        .withColumn("bars_held", (held / bar_seconds).cast("int"))
    )


def trade_returns(trades: DataFrame) -> DataFrame:
    """Return on notional and plain price return of every trade with a positive notional."""
    value = F.col("quantity") * F.col("entry_price")
    return trades.where(value > 0).withColumns(
        {"ret": F.col("pnl") / value, "price_ret": F.col("exit_price") / F.col("entry_price") - 1}
    )


def trade_stats(trades: DataFrame, keys: Sequence[str], bar_seconds: int) -> DataFrame:
    """Counts, win rate, averages, extremes and profit factor in one aggregate."""
    count, wins = F.count(F.lit(1)), F.count_if(won())
    return measured(trades, bar_seconds).groupBy(*keys).agg(
        count.alias("total_trades"),
        wins.alias("winning_trades"),
        F.count_if(lost()).alias("losing_trades"),
        (wins / count * 100).alias("win_rate"),
        F.sum("pnl").alias("total_pnl"),
        F.avg("pnl").alias("avg_pnl"),
        F.avg(when_won("pnl")).alias("avg_win"),
        F.avg(when_lost("pnl")).alias("avg_loss"),
        F.max("pnl").alias("largest_win"),
        F.min("pnl").alias("largest_loss"),
        profit_factor().alias("profit_factor"),
        F.avg("holding_hours").alias("avg_holding_hours"),
        F.sum(F.when(F.col("direction") == "long", F.col("pnl"))).alias("long_pnl"),
        F.sum(F.when(F.col("direction") == "short", F.col("pnl"))).alias("short_pnl"),
    )


def pnl_maps(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Profit by direction and by exit reason as maps; groups of groups stay tiny."""
    by_reason = trades.groupBy(*keys, "direction", "exit_reason").agg(F.sum("pnl").alias("pnl"))
    reason = by_reason.groupBy(*keys, "exit_reason").agg(F.sum("pnl").alias("pnl"))
    direction = by_reason.groupBy(*keys, "direction").agg(F.sum("pnl").alias("pnl"))

    def packed(df, label, name):
        entries = F.array_sort(F.collect_list(F.struct(F.col(label), F.col("pnl"))))
        return df.groupBy(*keys).agg(F.map_from_entries(entries).alias(name))

    return packed(direction, "direction", "by_direction").join(packed(reason, "exit_reason", "by_reason"), list(keys))


def detailed_stats(trades: DataFrame, keys: Sequence[str], bar_seconds: int, capital: float, commission_pct: float) -> DataFrame:
    """The long list of ledger figures in one conditional aggregate."""
    base = measured(trades, bar_seconds)
    gross_profit, gross_loss = F.sum(when_won("pnl")), F.abs(F.sum(when_lost("pnl")))
    return base.groupBy(*keys).agg(
        F.sum("pnl").alias("net_profit"),
        gross_profit.alias("gross_profit"),
        (gross_profit / capital * 100).alias("gross_profit_pct"),
        gross_loss.alias("gross_loss"),
        (gross_loss / capital * 100).alias("gross_loss_pct"),
        (F.sum("trade_value") * 2 * commission_pct / 100).alias("commission_paid"),
        F.avg("pnl_pct").alias("avg_pnl_pct"),
        F.avg(when_won("pnl_pct")).alias("avg_win_pct"),
        F.abs(F.avg(when_lost("pnl_pct"))).alias("avg_loss_pct"),
        ratio(F.avg(when_won("pnl")), F.abs(F.avg(when_lost("pnl")))).alias("ratio_avg_win_loss"),
        F.max(when_won("pnl")).alias("largest_win"),
        F.max(when_won("pnl_pct")).alias("largest_win_pct"),
        F.abs(F.min(when_lost("pnl"))).alias("largest_loss"),
        F.abs(F.min(when_lost("pnl_pct"))).alias("largest_loss_pct"),
        F.avg("bars_held").alias("avg_bars_all"),
        F.avg(when_won("bars_held")).alias("avg_bars_winners"),
        F.avg(when_lost("bars_held")).alias("avg_bars_losers"),
        F.max("trade_value").alias("max_position_value"),
    )


def expectancy(stats: DataFrame) -> DataFrame:
    share = F.col("win_rate") / 100
    value = share * F.coalesce("avg_win", F.lit(0.0)) - (F.col("losing_trades") / F.col("total_trades")) * F.abs(
        F.coalesce("avg_loss", F.lit(0.0))
    )
    return stats.withColumn("expectancy", value)


def losing_streak(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Longest run of losing trades in closing order, the first of equals, with its profit."""
    counted = running(
        trades, keys, ["trade_id"], row_slice("trade_id"), {"streak": ("count", F.when(~F.coalesce(lost(), F.lit(False)), 1))}
    )
    streaks = counted.where(lost()).groupBy(*keys, "streak").agg(
        F.count(F.lit(1)).alias("length"), F.sum("pnl").alias("pnl"), F.min("trade_id").alias("start")
    )
    best = streaks.groupBy(*keys).agg(F.max_by(F.struct("length", "pnl"), F.struct(F.col("length"), -F.col("start"))).alias("b"))
    everyone = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return everyone.join(best, list(keys), "left").select(
        *keys, F.coalesce("b.length", F.lit(0)).alias("worst_streak"), F.coalesce("b.pnl", F.lit(0.0)).alias("streak_pnl")
    )
