"""Named calendar regimes: membership, independent replay per regime and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.functions.frame import sweep_frame
from tidebar.functions.rules import Rules
from tidebar.operators.fold import placed_by
from tidebar.operators.replay import equity_of, replay, trades_of
from tidebar.plans.equity import buy_and_hold, equity_stats, underwater
from tidebar.plans.ledger import trade_stats

# Name, first day, last day, type.
CALENDAR = [
    ("2017 Bull", "2017-01-01", "2017-12-31", "bull"),
    ("2018 Bear", "2018-01-01", "2018-12-31", "bear"),
    ("2019 Chop", "2019-01-01", "2019-12-31", "chop"),
    ("2020-2021 Bull", "2020-01-01", "2021-12-31", "bull"),
    ("2022 Bear", "2022-01-01", "2022-12-31", "bear"),
    ("2023-2025 Recovery", "2023-01-01", "2025-12-31", "recovery"),
]
MIN_BARS = 50


def calendar_frame(spark: SparkSession, rows: Sequence[tuple] = CALENDAR) -> DataFrame:
    frame = spark.createDataFrame([tuple(x) for x in rows], "regime string, start string, end string, type string")
    return frame.withColumn("start", F.to_date("start")).withColumn("end", F.to_date("end"))


def in_calendar(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars with every regime that covers them.

    The spans are expanded to days, so this is an equi-join on the day, and the days of a configured calendar are few, so they go to
    the bars; overlapping regimes repeat a bar.  The last day ends at midnight.
    """
    days = F.broadcast(calendar.withColumn("_day", F.explode(F.sequence("start", "end"))))
    joined = bars.withColumn("_day", F.to_date("ts")).join(days, "_day").drop("_day")
    return joined.where(F.col("ts") <= F.col("end").cast("timestamp_ntz"))


def regime_bars(bars: DataFrame, calendar: DataFrame, placed: bool = False) -> DataFrame:
    """Numbered bars, numbered anew inside each (symbol, regime); with ``placed`` they lie by symbol, ready for a replay.

    A regime is one span of days, so its bars count on from the first of them: bars move before they are repeated, if at all.
    """
    first = in_calendar(bars.select("symbol", "ts", "rn"), calendar).groupBy("symbol", "regime").agg(F.min("rn").alias("first"))
    firsts = first.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("regime", "first"))).alias("_first"))
    where = placed_by(bars, ["symbol"]) if placed else bars
    member = in_calendar(where.join(firsts, "symbol"), calendar).withColumn("rn", F.col("rn") - F.col("_first")[F.col("regime")] + 1)
    return member.drop("start", "end", "type", "_first")


def replay_by_regime(numbered: DataFrame, rules: Rules) -> DataFrame:
    """The rules over each (symbol, regime) of bars that lie by symbol."""
    keys = ("symbol", "regime")
    frame = sweep_frame(numbered, [rules.entry_len, rules.exit_len], rules.atr_len, keys)
    return replay(frame, [rules], keys, placed=True)


def regime_stats(members: DataFrame, result: DataFrame, rules: Rules, bars_per_year: float, bar_seconds: int) -> DataFrame:
    """One row per (symbol, regime) of the bars in regimes; fewer than 50 bars count as untested and survived."""
    keys = ["symbol", "regime"]
    hold = buy_and_hold(members, keys, rules.capital).select(*keys, "hold_pct", F.col("bars").alias("n"))
    curve = equity_stats(underwater(equity_of(result, keys), keys), keys, rules.capital, bars_per_year)
    deals = trade_stats(trades_of(result, keys), keys, bar_seconds)
    joined = hold.join(curve.drop("bars"), keys).join(deals, keys, "left")
    tested = F.col("n") >= MIN_BARS

    def when_tested(value: Column, other=0.0) -> Column:
        return F.when(tested, F.coalesce(value, F.lit(other))).otherwise(F.lit(other))

    return joined.select(
        *keys,
        when_tested(F.col("hold_pct")).alias("hold_pct"),
        when_tested(F.col("total_return_pct")).alias("return_pct"),
        when_tested(F.abs("max_drawdown_pct")).alias("max_dd_pct"),
        when_tested(F.col("total_trades"), 0).alias("trades"),
        when_tested(F.col("win_rate")).alias("win_rate"),
        F.when(tested, F.col("profit_factor")).otherwise(0.0).alias("profit_factor"),
        when_tested(F.col("avg_recovery_days")).alias("recovery_days"),
        when_tested(F.col("sharpe")).alias("sharpe"),
        when_tested(F.col("final_equity") > rules.capital * 0.1, True).alias("survived"),
    )


def by_type(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per regime type: mean return, survival, and the label it earns."""
    found = stats.groupBy(*keys, "type").agg(
        F.avg("return_pct").alias("mean_return"), F.bool_and("survived").alias("all_survived"), F.bool_or("survived").alias("any_survived")
    )
    label = (
        F.when(F.col("type") == "bull", F.when(F.col("mean_return") > 50, "pass").otherwise("warning"))
        .when(F.col("type") == "bear", F.when(F.col("all_survived") & (F.col("mean_return") > -30), "pass").otherwise("fail"))
        .when(F.col("type") == "chop", F.when(F.col("mean_return") > -20, "pass").otherwise("warning"))
    )
    return found.withColumn("label", label)


def viability(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overall verdict; the sum of percentages decides it, the compounded return stands beside it."""
    found = stats.groupBy(*keys).agg(
        F.bool_and("survived").alias("all_survived"), F.max("max_dd_pct").alias("max_dd_pct"), F.sum("return_pct").alias("return_sum"),
        ((F.exp(F.sum(F.log1p(F.col("return_pct") / 100))) - 1) * 100).alias("return_compounded"),
    )
    good = F.col("all_survived") & (F.col("max_dd_pct") < 60) & (F.col("return_sum") > 0)
    return found.withColumn("verdict", F.when(good, "VIABLE").when(F.col("all_survived"), "MARGINAL").otherwise("NOT VIABLE"))
