"""The live log and state documents: derived from a ledger, and the questions dashboards ask."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions.times import time_text
from tidebar.operators.windows import running, time_slice
from tidebar.plans.ledger import profit_factor, ratio, won

STILL_OPEN = "End of Backtest"
DAY = 86_400


def events_of(trades: DataFrame, keys: Sequence[str], capital: float) -> DataFrame:
    """Entry and exit events of a ledger with the realised equity after each.

    A position's units closed together make one exit; exits precede entries of their bar.
    """
    keys = list(keys)
    entries = trades.select(
        *keys, F.lit("ENTRY").alias("type"), F.when(F.col("unit_number") == 1, "Breakout").otherwise("Pyramid").alias("reason"),
        F.col("entry_time").alias("ts"), F.col("entry_price").alias("price"), F.col("quantity").alias("size"), F.lit(None).cast("double").alias("pnl"),
        F.lit(1).alias("side"), F.col("unit_number").alias("place"),
    )
    closed = trades.where(F.col("exit_reason") != STILL_OPEN)
    exits = closed.groupBy(*keys, "position_id", "exit_time", "exit_reason", "exit_price").agg(F.sum("quantity").alias("size"), F.sum("pnl").alias("pnl"))
    exits = exits.select(
        *keys, F.lit("EXIT").alias("type"), F.col("exit_reason").alias("reason"), F.col("exit_time").alias("ts"), F.col("exit_price").alias("price"),
        "size", "pnl", F.lit(0).alias("side"), F.col("position_id").cast("int").alias("place"),
    )
    both = entries.unionByName(exits)
    summed = running(both, keys, ["ts", "side", "place"], time_slice("ts", DAY), {"_made": ("sum", F.col("pnl"))})
    return summed.withColumn("equity", F.lit(capital) + F.col("_made")).drop("_made", "side")


def log_documents(events: DataFrame, keys: Sequence[str], strategy: str) -> DataFrame:
    """JSON documents, one per key and month: arrays of events, each with only the keys it has."""
    event = F.struct(
        "type", "reason", time_text("ts").alias("time"), "price", "size", "equity", F.lit(strategy).alias("strategy"), "pnl"
    )
    month = F.date_format("ts", "yyyy-MM").alias("month")
    rows = events.select(*keys, month, F.struct("ts", event.alias("e")).alias("r"))
    listed = rows.groupBy(*keys, "month").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return listed.select(*keys, F.to_json(F.transform("rows", lambda x: x["e"])).alias("payload"))


def live_stats(log: DataFrame, keys: Sequence[str], capital: float) -> DataFrame:
    """Entries, exits, win rate, averages, profit factor, total and deepest fall of the logged equity."""
    keys = list(keys)
    peaked = running(log, keys, ["ts", "rank", "price", "size"], time_slice("ts", DAY), {"top": ("max", F.col("equity"))})
    peak = F.greatest(F.col("top"), F.lit(capital))
    exits, entries = F.col("type") == "EXIT", F.col("type") == "ENTRY"
    wins = F.count_if(exits & won())
    return peaked.groupBy(*keys).agg(
        F.count_if(entries).alias("entries"),
        F.count_if(exits).alias("exits"),
        ratio(wins * 100.0, F.count_if(exits)).alias("win_rate"),
        F.avg(F.when(won(), F.col("pnl"))).alias("avg_win"),
        F.avg(F.when(F.col("pnl") < 0, F.col("pnl"))).alias("avg_loss"),
        profit_factor().alias("profit_factor"),
        F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"),
        F.max((peak - F.col("equity")) / peak * 100).alias("max_dd_pct"),
    )


def state_documents(trades: DataFrame, keys: Sequence[str], capital: float) -> DataFrame:
    """JSON state per key from a ledger.  A key without open units writes no size or unit list."""
    open_ = F.col("exit_reason") == STILL_OPEN
    unit = F.struct(F.col("entry_price"), F.col("quantity").alias("size"), time_text("entry_time").alias("time"))
    grouped = trades.groupBy(*keys).agg(
        (F.lit(capital) + F.coalesce(F.sum(F.when(~open_, F.col("pnl"))), F.lit(0.0))).alias("equity"),
        F.sum(F.when(open_, F.col("quantity"))).alias("position_size"),
        F.array_sort(F.collect_list(F.when(open_, unit))).alias("units"),  # at most the unit limit of a profile
        F.count(F.lit(1)).alias("trade_count"),
    )
    listed = F.when(F.size("units") > 0, F.col("units"))
    document = F.struct("equity", "position_size", listed.alias("position_units"), "trade_count")
    return grouped.select(*keys, F.to_json(document).alias("payload"))


def marked_units(units: DataFrame, prices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Open units against the latest price: gain and gain in percent of each."""
    latest = prices.groupBy(*keys).agg(F.max_by("close", "ts").alias("price"))
    joined = units.where(F.col("entry_price").isNotNull()).join(latest, list(keys))
    gain = (F.col("price") - F.col("entry_price")) * F.col("size")
    return joined.withColumn("gain", gain).withColumn("gain_pct", (F.col("price") / F.col("entry_price") - 1) * 100)


def marked_positions(units: DataFrame, keys: Sequence[str]) -> DataFrame:
    paid = F.sum(F.col("entry_price") * F.col("size"))
    return units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), F.sum("gain").alias("gain"), ratio(F.sum("gain") * 100, paid).alias("gain_pct")
    )


def drift(live: DataFrame, reference: DataFrame, keys: Sequence[str], tolerance: float = 10.0) -> DataFrame:
    """Live figures against the replay: win rate within tolerance, and limits broken."""
    joined = live.alias("l").join(reference.select(*keys, F.col("win_rate").alias("expected")), list(keys))
    gap = F.abs(F.col("win_rate") - F.col("expected"))
    status = (
        F.when((F.col("max_dd_pct") > 50) | (F.col("profit_factor") < 1.0), "stop")
        .when((F.col("win_rate") < 35) | (F.col("win_rate") > 55), "investigate")
        .otherwise("ready")
    )
    return joined.withColumn("gap", gap).withColumn("within", gap <= tolerance).withColumn("status", status)

