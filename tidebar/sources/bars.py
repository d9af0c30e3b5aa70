"""Bars: aggregation from ticks, de-duplication, upsert, gaps and densifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.times import epoch_seconds, floor_time, from_epoch_seconds
from tidebar.operators.windows import framed, running, time_slice

PRICES = ("open", "high", "low", "close")


def tick_order(high: Column, low: Column) -> Column:
    """Two whole numbers, the second below 10**18, as one fixed-width sort key.

    First and last price then aggregate by hash; a struct key would force a sort of all ticks.
    """
    return high.cast("decimal(20,0)") * F.lit(10**18).cast("decimal(19,0)") + low.cast("decimal(18,0)")


def build_bars(ticks: DataFrame, width_seconds: int, price: Column, volume: Column, order: Column, symbol: str, ts: str = "ts") -> DataFrame:
    """OHLCV bars of ``width_seconds``.

    Every aggregate merges partial results before the shuffle, so a symbol holding
    most ticks costs one small row per bar and task.  ``order`` must be of fixed
    width and unique within a bar.  Bars are grouped by the symbol as it is and named after that:
    a number is a narrower key than its text.
    """
    rank = order
    return (
        ticks.withColumn("_price", price)
        .groupBy(F.col(symbol).alias("_symbol"), floor_time(ts, width_seconds).alias("ts"))
        .agg(
            F.min_by("_price", rank).alias("open"),
            F.max("_price").alias("high"),
            F.min("_price").alias("low"),
            F.max_by("_price", rank).alias("close"),
            F.sum(volume).cast("double").alias("volume"),
        )
        .select(F.col("_symbol").cast("string").alias("symbol"), "ts", *PRICES, "volume")
    )


def dedup_bars(bars: DataFrame, keep: str = "last", load_seq: str = "load_seq") -> DataFrame:
    """One row per (symbol, ts): the first or the last loaded, by a load_seq unique among its copies.

    Copies merge before the shuffle, by hash, however many a bar has.
    """
    rest = [c for c in bars.columns if c not in ("symbol", "ts")]
    pick = F.min_by if keep == "first" else F.max_by
    return bars.groupBy("symbol", "ts").agg(*[pick(c, load_seq).alias(c) for c in rest]).select(bars.columns)


def upsert_bars(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored bars with fresh ones added; for a bar present in both the fresh one wins."""
    both = stored.withColumn("load_seq", F.lit(0)).unionByName(fresh.withColumn("load_seq", F.lit(1)))
    return dedup_bars(both, "last").drop("load_seq")


def filter_range(bars: DataFrame, start: str, end: str) -> DataFrame:
    """Bars from start to end, both inclusive; a plain predicate, so it reaches the scan."""
    low, high = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    return bars.where(F.col("ts").between(low, high))


def missing_bars(numbered: DataFrame, width_seconds: int) -> DataFrame:
    """Grid times between the first and last bar of a symbol that have no bar.

    Needs the row number: each gap is found from its two neighbours and expanded
    in place, so no grid of all times is built or joined.
    """
    step = F.lit(width_seconds).cast("long")
    gaps = framed(
        numbered.select("symbol", "ts", "rn"),
        ["symbol"],
        lambda w: {"_prev": F.lag("ts").over(w)},
        back=1,
    ).where(epoch_seconds("ts") - epoch_seconds("_prev") > step)
    first, last = epoch_seconds("_prev") + step, epoch_seconds("ts") - step
    return gaps.select("symbol", F.explode(F.sequence(first, last, step)).alias("_s")).select(
        "symbol", from_epoch_seconds("_s").alias("ts")
    )


def densify_linear(points: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Daily rows between consecutive anchors, linear in days; the last anchor is kept as it is."""
    decades = F.floor(F.year(date) / 10)
    descending = -F.unix_date(date)
    following = running(
        points.withColumn("_back", descending),
        [key],
        ["_back"],
        -decades,
        {"_next": ("lag", F.struct(F.col(date).alias("d"), F.col(value).alias("v")))},
    )
    stop = F.coalesce(F.date_sub("_next.d", 1), F.col(date))
    days = following.withColumn("_day", F.explode(F.sequence(F.col(date), stop)))
    share = F.datediff("_day", date) / F.datediff("_next.d", date)
    filled = F.when(F.col("_next").isNull(), F.col(value)).otherwise(
        F.col(value) + (F.col("_next.v") - F.col(value)) * share
    )
    return days.select(key, F.col("_day").alias(date), filled.alias(value))


def bar_slice(width_seconds: int) -> Column:
    return time_slice("ts", width_seconds)
