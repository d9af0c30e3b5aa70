"""Sweeping monthly profits of one curve into a second asset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.joins import asof
from tidebar.plans.equity import period_equity
from tidebar.plans.ledger import ratio


def profit_sweeps(curve: DataFrame, prices: DataFrame, keys: Sequence[str], share: float = 0.30) -> DataFrame:
    """Each month's profit or loss, what was moved at the as-of price, and running holdings.

    Windows here run over one row per month.
    """
    keys = list(keys)
    months = period_equity(curve, keys, "month").where(F.col("diff").isNotNull())
    months = months.withColumn("month_end", F.last_day("period").cast("timestamp_ntz")).withColumn("_market", F.lit(1))
    quotes = prices.select(F.lit(1).alias("_market"), F.col("date").alias("quote_ts"), "close")
    priced = asof(months, quotes, ["_market"], "month_end", "quote_ts", ["close"], tie=keys, spread=16)
    priced = priced.where(F.col("matched").isNotNull()).withColumn("price", F.col("matched.close"))
    moved = F.when(F.col("diff") > 0, F.col("diff") * share).otherwise(F.lit(0.0))
    upto = Window.partitionBy(*keys).orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0)
    units = priced.withColumn("moved", moved).withColumn("bought", F.col("moved") / F.col("price"))
    held = units.withColumn("holdings", F.sum("bought").over(upto)).withColumn("invested", F.sum("moved").over(upto))
    return held.withColumn("value", F.col("holdings") * F.col("price")).select(
        *keys, "month_end", F.col("equity"), F.col("diff").alias("profit"), "price", "moved", "bought", "holdings", "invested", "value"
    )


def combined(sweeps: DataFrame, keys: Sequence[str], capital: float) -> DataFrame:
    """Final totals.  Moved cash is deducted from the curve; the undeducted total is kept beside it."""
    last = sweeps.groupBy(*keys).agg(F.max_by(F.struct("equity", "holdings", "invested", "value"), "month_end").alias("l"))
    final = last.select(*keys, "l.*")
    total = F.col("equity") - F.col("invested") + F.col("value")
    gross = F.col("equity") + F.col("value")
    return final.withColumns(
        {
            "total": total,
            "total_return_pct": (total / capital - 1) * 100,
            "undeducted_total": gross,
            "undeducted_return_pct": (gross / capital - 1) * 100,
            "asset_return_pct": (ratio(F.col("value"), F.col("invested")) - 1) * 100,
        }
    )
