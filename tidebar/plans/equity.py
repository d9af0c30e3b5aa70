"""Questions over equity curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions.times import days_between, seconds_between
from tidebar.operators.episodes import episodes
from tidebar.operators.windows import row_slice, running_stages
from tidebar.plans.ledger import ratio, won

DEEP = -5.0  # percent below the peak that counts as a significant drawdown


def underwater(equity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equity with its peak, drawdown, bar return and the running counts episodes group by."""
    keys = list(keys)
    value = F.col("equity")
    highest = {"peak": ("max", value), "peak_before": ("max_before", value), "previous": ("lag", value)}

    def shaped(first: DataFrame) -> DataFrame:
        return (
            first.withColumn("dd", (value - F.col("peak")) / F.col("peak"))
            .withColumn("ret", ratio(value - F.col("previous"), F.col("previous")))
            .withColumn("new_high", F.coalesce(value > F.col("peak_before"), F.lit(False)))
        )

    counts = {
        "peaks": ("count", F.when(F.col("dd") >= 0, 1)),
        "shallow": ("count", F.when(F.col("dd") * 100 >= DEEP, 1)),
        "highs": ("count", F.when(F.col("new_high"), 1)),
    }
    return running_stages(
        equity, keys, ["rn"], row_slice(), [(lambda rows: rows, highest), (shaped, counts)]
    ).drop("peak_before", "previous")


def drawdown_episodes(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every stretch below the peak: start, recovery (null while open), rows and days."""
    found = episodes(
        curve, keys, "peaks", F.col("dd") >= 0, False,
        {"start": F.min("ts"), "depth": F.min("dd"), "bars": F.count("ts")}, {"recovery": F.max("end_ts")},
    )
    return found.withColumn("days", seconds_between("start", "recovery") / 86400).drop("rows")


def deep_drawdowns(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stretches more than five percent below the peak; one still open keeps a null recovery."""
    found = episodes(
        curve, keys, "shallow", F.col("dd") * 100 >= DEEP, False,
        {
            "start": F.min("ts"),
            "last": F.max("ts"),
            "max_drawdown": F.min("dd") * 100,
            "bottom": F.min_by("ts", F.when(F.col("ts").isNotNull(), F.struct("dd", "ts"))),
            "equity_at_start": F.min_by("equity", "ts"),
            "equity_at_bottom": F.min_by("equity", F.when(F.col("ts").isNotNull(), F.struct("dd", "ts"))),
        },
        {"recovery": F.max("end_ts")},
    )
    end = F.coalesce("recovery", "last")
    return found.withColumn("end", end).withColumn("days", days_between(F.col("start"), end)).drop("last", "rows")


def stalls(curve: DataFrame, keys: Sequence[str], threshold_days: int = 60) -> DataFrame:
    """Periods of at least threshold_days without a new high, from the last high to the next one."""
    quiet = F.when(~F.col("new_high"), 1)
    found = episodes(
        curve, keys, "highs", F.col("new_high"), True,
        {
            "start": F.min("ts"),
            "last": F.max("ts"),
            "quiet_bars": F.count(quiet),
            "equity_at_start": F.min_by("equity", "ts"),
            "last_equity": F.max_by("equity", "ts"),
            "min_equity": F.min("equity"),
        },
        {"next": F.max("end_ts"), "next_equity": F.max("end_equity")},
    )
    end = F.coalesce("next", "last")
    return (
        found.where(F.col("quiet_bars") > 0)
        .withColumn("end", end)
        .withColumn("days", days_between(F.col("start"), end))
        .withColumn("equity_at_end", F.coalesce("next_equity", "last_equity"))
        .withColumn("max_drawdown_pct", (F.col("min_equity") / F.col("equity_at_start") - 1) * 100)
        .where(F.col("days") >= threshold_days)
        .select(*keys, "start", "end", "days", "equity_at_start", "equity_at_end", "min_equity", "max_drawdown_pct")
    )


def equity_stats(curve: DataFrame, keys: Sequence[str], capital: float, bars_per_year: float) -> DataFrame:
    """Return, growth, drawdown, Sharpe, Sortino, Calmar, volatility and recovery times."""
    keys = list(keys)
    year = F.lit(float(bars_per_year))
    mean, spread = F.avg("ret"), F.stddev_samp("ret")
    down = F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret")))
    base = curve.groupBy(*keys).agg(
        F.max_by("equity", "rn").alias("final_equity"),
        F.count(F.lit(1)).alias("bars"),
        F.min("dd").alias("dd"),
        F.coalesce(ratio(mean, spread) * F.sqrt(year), F.lit(0.0)).alias("sharpe"),
        F.coalesce(ratio(mean, down) * F.sqrt(year), F.lit(0.0)).alias("sortino"),
        (spread * F.sqrt(year) * 100).alias("volatility_pct"),
    )
    recoveries = drawdown_episodes(curve, keys).groupBy(*keys).agg(
        F.avg("days").alias("avg_recovery_days"), F.max("days").alias("max_recovery_days")
    )
    total = F.col("final_equity") / capital - 1
    growth = F.pow(1 + total, year / F.col("bars")) - 1
    return (
        base.join(recoveries, keys, "left")
        .withColumn("total_return_pct", total * 100)
        .withColumn("cagr_pct", growth * 100)
        .withColumn("max_drawdown_pct", F.col("dd") * 100)
        .withColumn("calmar", F.coalesce(ratio(growth, F.abs("dd")), F.lit(0.0)))
        .withColumn("avg_recovery_days", F.coalesce("avg_recovery_days", F.lit(0.0)))
        .withColumn("max_recovery_days", F.coalesce("max_recovery_days", F.lit(0.0)))
        .drop("dd")
    )


def period_equity(curve: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """Last equity of every period that has a bar, with change and return on the period before it.

    The window runs over one row per period, not over bars.
    """
    day = F.to_date("ts")
    period = day if unit == "day" else F.trunc(day, unit)
    last = curve.groupBy(*keys, period.cast("timestamp_ntz").alias("period")).agg(
        F.max_by("equity", "ts").alias("equity")
    )
    before = F.lag("equity").over(Window.partitionBy(*keys).orderBy("period"))
    return last.withColumn("diff", F.col("equity") - before).withColumn("ret", ratio(F.col("equity") - before, before))


def drawdown_indices(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    below = F.col("dd") < 0
    return curve.groupBy(*keys).agg(
        (F.avg(F.when(below, 1.0).otherwise(0.0)) * 100).alias("time_underwater_pct"),
        (F.sqrt(F.avg(F.col("dd") * F.col("dd"))) * 100).alias("ulcer_index"),
        (F.abs(F.avg("dd")) * 100).alias("pain_index"),
    )


def drawdown_values(curve: DataFrame, keys: Sequence[str], capital: float) -> DataFrame:
    deepest = F.min_by(F.struct("dd", "peak"), F.struct("dd", "rn"))
    return curve.groupBy(*keys).agg(
        F.abs(F.min("dd") * deepest["peak"]).alias("max_drawdown_value"),
        (F.abs(F.avg(F.when(F.col("dd") < 0, F.col("dd")))) * 100).alias("avg_drawdown_pct"),
        (F.max("equity") - capital).alias("max_runup"),
        ((F.max("equity") / capital - 1) * 100).alias("max_runup_pct"),
    )


def compare_variants(variants: Sequence[tuple[str, DataFrame, DataFrame, float]], keys: Sequence[str], bars_per_year: float) -> DataFrame:
    """(name, curve, ledger, starting capital) of several variants side by side for each key.

    The best one of a key has the highest return over drawdown, which is 0 without a drawdown; the first named wins a tie.
    """
    keys, parts = list(keys), []
    sharpe = ratio(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(float(bars_per_year)))
    for place, (name, curve, ledger, capital) in enumerate(variants):
        ends = curve.groupBy(*keys).agg(
            F.max_by("equity", "rn").alias("final_equity"), (F.min("dd") * 100).alias("max_drawdown_pct"), F.coalesce(sharpe, F.lit(0.0)).alias("sharpe")
        )
        count = F.count(F.lit(1))
        made = ledger.groupBy(*keys).agg(count.alias("trades"), (F.count_if(won()) * 100.0 / count).alias("win_rate"), F.sum("pnl").alias("total_pnl"))
        both = ends.join(made, keys, "left").na.fill(0, ["trades"]).na.fill(0.0, ["win_rate", "total_pnl"])
        grown = (F.col("final_equity") / capital - 1) * 100
        parts.append(both.withColumns({"variant": F.lit(name), "_place": F.lit(place), "total_return_pct": grown}))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    score = F.coalesce(ratio(F.col("total_return_pct"), F.abs("max_drawdown_pct")), F.lit(0.0))
    order = Window.partitionBy(*keys).orderBy(score.desc(), "_place")  # a key has one row for each variant
    return every.withColumn("best", F.row_number().over(order) == 1).drop("_place")


def stress(stats: DataFrame, capital: float) -> DataFrame:
    """Half the return and half as much drawdown again; survives above half the capital and below 80 %."""
    equity = capital * (1 + F.col("total_return_pct") * 0.5 / 100)
    drawdown = F.abs("max_drawdown_pct") * 1.5
    survives = (equity > capital * 0.5) & (drawdown < 80)
    return stats.withColumns({"stress_equity": equity, "stress_drawdown_pct": drawdown, "survives": survives})


def buy_and_hold(bars: DataFrame, keys: Sequence[str], capital: float) -> DataFrame:
    growth = F.max_by("close", "ts") / F.min_by("close", "ts") - 1
    return bars.groupBy(*keys).agg((growth * capital).alias("hold_value"), (growth * 100).alias("hold_pct"), F.count(F.lit(1)).alias("bars"))


def benchmark_curve(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Price scaled to start at the first equity."""
    first = curve.groupBy(*keys).agg(F.min_by("close", "rn").alias("_close"), F.min_by("equity", "rn").alias("_equity"))
    joined = curve.join(first, list(keys))
    return joined.withColumn("benchmark", F.col("close") / F.col("_close") * F.col("_equity")).drop("_close", "_equity")


