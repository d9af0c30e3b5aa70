"""Data checks over marts, as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.plans.ledger import lost, won


def ledger_checks(trades: DataFrame, curve: DataFrame, keys: Sequence[str], capital: float, tolerance: float = 1e-4) -> DataFrame:
    """Wins and losses within the total, profit equal to the change of equity, no missing exit."""
    keys = list(keys)
    ledger = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), (F.count_if(won()) + F.count_if(lost()) <= F.count(F.lit(1))).alias("counts_ok"),
        F.count_if(F.col("exit_time").isNull()).alias("open_rows"), F.sum("pnl").alias("pnl"), F.count_distinct("entry_time").alias("entry_times"),
    )
    final = curve.groupBy(*keys).agg(F.max_by("equity", "rn").alias("final"))
    joined = final.join(ledger, keys, "left")
    gap = F.abs(F.coalesce("pnl", F.lit(0.0)) - (F.col("final") - capital))
    return joined.select(
        *keys, F.coalesce("trades", F.lit(0)).alias("trades"), F.coalesce("entry_times", F.lit(0)).alias("entry_times"),
        F.coalesce("counts_ok", F.lit(True)).alias("counts_ok"), (gap < tolerance).alias("pnl_ok"), (F.coalesce("open_rows", F.lit(0)) == 0).alias("exits_ok"),
    )


def expectations(stats: DataFrame, keys: Sequence[str], limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Each measured value against its limit: rows of name, value, limit and outcome."""
    long = stats.select(*keys, *[F.col(c).cast("double").alias(c) for c in limits]).unpivot(list(keys), list(limits), "measure", "value")
    bound = F.create_map(*[F.lit(x) for name, (_, v) in limits.items() for x in (name, float(v))])
    above = [n for n, (sign, _) in limits.items() if sign == ">"]
    limit = F.element_at(bound, F.col("measure"))
    passed = F.when(F.col("measure").isin(above), F.col("value") > limit).otherwise(F.col("value") < limit)
    return long.withColumn("limit", limit).withColumn("passed", F.coalesce(passed, F.lit(False)))
