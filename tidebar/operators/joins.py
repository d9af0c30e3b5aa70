"""Time joins: as-of, nearest and interval membership, without a condition-only join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.times import epoch_micros, epoch_seconds
from tidebar.operators.windows import running

QUARTER = 90 * 86_400


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
    direction: str = "backward",
    slice_seconds: int = QUARTER,
    spread: int = 1,
) -> DataFrame:
    """Each left row with the latest right row at or before it (or the first at or after it).

    Both sides are unioned and the latest right payload is carried along time in
    slices, so a hot key spreads over its slices.  Right rows must be unique per
    key and time.  With few right rows and many left rows per key and slice, such as
    one market price for every symbol, ``spread`` divides the left rows by a hash of
    ``tie`` and repeats the right rows.  Adds struct column ``matched`` holding right_ts and ``columns``.
    """
    keys, sign = list(keys), 1 if direction == "backward" else -1
    copies = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    payload = F.struct(*[F.col(c) for c in dict.fromkeys([right_ts, *columns])])
    facts = right.select(*keys, F.col(right_ts).alias("_at"), payload.alias("_payload"), F.lit(0).alias("_side"))
    facts = facts.withColumn("_part", copies if spread > 1 else F.lit(0))
    part = F.pmod(F.xxhash64(*tie), F.lit(spread)).cast("int") if spread > 1 else F.lit(0)
    probes = left.withColumn("_at", F.col(left_ts)).withColumn("_side", F.lit(1)).withColumn("_part", part)
    both = probes.unionByName(facts, allowMissingColumns=True)
    both = both.withColumn("_t", epoch_micros("_at") * sign)
    slices = F.floor(epoch_seconds("_at") / slice_seconds) * sign
    carried = running(both, [*keys, "_part"], ["_t", "_side", *tie], slices, {"matched": ("last", F.col("_payload"))})
    return carried.where(F.col("_side") == 1).select(*left.columns, "matched")


def nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, columns: Sequence[str], tie: Sequence[str] = (), spread: int = 1
) -> DataFrame:
    """Each left row with the right row closest in time; the earlier one when both are equally close."""
    back = asof(left, right, keys, left_ts, right_ts, columns, tie, spread=spread).withColumnRenamed("matched", "_back")
    both = asof(back, right, keys, left_ts, right_ts, columns, tie, "forward", spread=spread).withColumnRenamed("matched", "_ahead")
    before = epoch_micros(left_ts) - epoch_micros(F.col("_back")[right_ts])
    after = epoch_micros(F.col("_ahead")[right_ts]) - epoch_micros(left_ts)
    closer = F.when(F.col("_ahead").isNull() | (before <= after), F.col("_back")).otherwise(F.col("_ahead"))
    return both.withColumn("matched", closer).drop("_back", "_ahead")


def _buckets(start: Column, end: Column, seconds: int) -> Column:
    low, high = F.floor(epoch_seconds(start) / seconds), F.floor(epoch_seconds(end) / seconds)
    return F.explode(F.sequence(low, high))


def within(points: DataFrame, spans: DataFrame, keys: Sequence[str], ts: str, start: str, end: str, seconds: int = QUARTER) -> DataFrame:
    """Every (point, span) pair of equal keys with start <= ts <= end; overlapping spans repeat the point.

    Spans are cut into time buckets, which turns the range condition into an equi-join
    and splits a hot key by time.
    """
    cut = spans.withColumn("_bucket", _buckets(F.col(start), F.col(end), seconds))
    placed = points.withColumn("_bucket", F.floor(epoch_seconds(ts) / seconds))
    joined = placed.join(cut, [*keys, "_bucket"])
    return joined.where(F.col(ts).between(F.col(start), F.col(end))).drop("_bucket")
