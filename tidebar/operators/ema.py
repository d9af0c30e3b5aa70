"""Exponential moving average over long series, slice by slice.

e(0) = x(0), e(t) = a*x(t) + (1-a)*e(t-1).  A slice of m rows maps the value
entering it to decay^m * entering + own, so slices fold over one small row each
and no task sees more than a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ema(df: DataFrame, keys: Sequence[str], value: str, span: int, name: str, rn: str = "rn", block: int = 256) -> DataFrame:
    """Blocks of ``block`` rows keep decay^-k far from overflow for any span from 2 up."""
    keys = list(keys)
    alpha = 2.0 / (span + 1.0)
    decay = 1.0 - alpha
    block = max(1, min(block, int(600 / max(1e-9, -_log(decay)))))
    place = (F.col(rn) - 1) % F.lit(block)
    weight = F.when(F.col(rn) == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    base = df.withColumn("_block", F.floor((F.col(rn) - 1) / F.lit(block)).cast("long")).withColumn(
        "_scaled", weight * F.col(value) * F.pow(F.lit(decay), -place)
    )
    totals = base.groupBy(*keys, "_block").agg(
        F.count(F.lit(1)).alias("_m"), F.sum("_scaled").alias("_sum")
    )
    totals = totals.withColumn("_own", F.col("_sum") * F.pow(F.lit(decay), F.col("_m") - 1)).withColumn(
        "_keep", F.pow(F.lit(decay), F.col("_m").cast("double"))
    )
    entering = _fold_blocks(totals, keys)
    inside = Window.partitionBy(*keys, "_block").orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum("_scaled").over(inside) * F.pow(F.lit(decay), place)
    joined = base.join(entering, [*keys, "_block"])
    return joined.select(*df.columns, (own + F.col("_enter") * F.pow(F.lit(decay), place + 1)).alias(name))


def _fold_blocks(totals: DataFrame, keys: list[str], group: int = 1024) -> DataFrame:
    """Value entering each block.  Blocks fold in groups, groups fold over their totals."""
    grouped = totals.withColumn("_group", F.floor(F.col("_block") / group))
    lists = grouped.groupBy(*keys, "_group").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_keep", "_own"))).alias("_blocks")
    )

    def step(acc: Column, item: Column) -> Column:
        return F.struct(
            (acc["keep"] * item["_keep"]).alias("keep"),
            (acc["own"] * item["_keep"] + item["_own"]).alias("own"),
        )

    start = F.struct(F.lit(1.0).alias("keep"), F.lit(0.0).alias("own"))
    folded = lists.withColumn("_total", F.aggregate("_blocks", start, step))
    order = Window.partitionBy(*keys).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    folded = folded.withColumn("_before", F.collect_list("_total").over(order))

    def chain(acc: Column, item: Column) -> Column:
        return acc * item["keep"] + item["own"]

    folded = folded.withColumn("_in", F.aggregate("_before", F.lit(0.0), chain))

    def walk(acc: Column, item: Column) -> Column:
        entry = F.struct(item["_block"].alias("_block"), acc["now"].alias("_enter"))
        return F.struct(
            (acc["now"] * item["_keep"] + item["_own"]).alias("now"),
            F.concat(acc["out"], F.array(entry)).alias("out"),
        )

    empty = F.expr("CAST(array() AS ARRAY<STRUCT<_block: BIGINT, _enter: DOUBLE>>)")
    seed = F.struct(F.col("_in").alias("now"), empty.alias("out"))
    walked = folded.select(*keys, F.explode(F.aggregate("_blocks", seed, walk)["out"]).alias("_e"))
    return walked.select(*keys, "_e._block", "_e._enter")


def _log(x: float) -> float:
    import math

    return math.log(x) if x > 0 else -1e9
