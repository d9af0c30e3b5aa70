"""Exact percentiles per group without holding a group in one task.

Values collapse to counts, counts run in value order over buckets, and the order
statistics around each target rank are picked by a partial aggregate.  Buckets follow
the values: first the octaves of the number, cut in STEPS, then every bucket with too many
values is cut again ZOOMS times, in turn by the octave of the distance from its own least
value (for tails behind a plateau) and in equal parts.  No step needs the range of a whole
group, so one group with all rows spreads over its buckets; one still too full is only larger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.operators.windows import running

#: Steps of the first cut in one octave (from a power of two to the next).
STEPS = 16
#: Distinct values a bucket should hold; one with more is cut again.
FULL = 4096
#: How often over-full buckets are cut again.
ZOOMS = 2
#: Exponents of doubles lie between -1074 and 1023, so a shift by this makes them positive.
SHIFT = 1100


def octave_code(value: Column) -> Column:
    """A double that never decreases with value: its binary exponent plus the part of the octave below it, mirrored for negative values.

    Infinite values lie beyond all finite ones, NaN beyond those, as Spark orders them.
    """
    v = value.cast("double")
    size = F.abs(v)
    exponent = F.floor(F.log2(size)).cast("double")
    part = F.least(F.greatest(size / F.pow(F.lit(2.0), exponent) - 1, F.lit(0.0)), F.lit(1.0))
    finite = F.signum(v) * (exponent + part + SHIFT)
    return F.when(F.isnan(v), F.lit(4.0 * SHIFT)).when(size == float("inf"), F.signum(v) * 3.0 * SHIFT).when(v == 0, F.lit(0.0)).otherwise(finite)


def _cut_again(placed: DataFrame, group: list[str], full: int, by_octave: bool) -> DataFrame:
    """Buckets with more than ``full`` rows cut by the octave of the distance from their least value, or in equal parts up to the greatest one.

    Buckets are numbered anew in value order; adds the _total of each group.
    """
    number = F.col("_v").cast("double")
    spans = placed.groupBy(*group, "_bucket").agg(F.min(number).alias("_low"), F.max(number).alias("_high"), F.count(F.lit(1)).alias("_rows"), F.sum("_n").alias("_all_n"))
    wanted = F.lit(2 * SHIFT * STEPS) if by_octave else F.ceil(F.col("_rows") / F.lit(full))
    parts = F.when((F.col("_high") > F.col("_low")) & (F.col("_rows") > full), wanted).otherwise(F.lit(1)).cast("long")
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_total", F.sum("_all_n").over(Window.partitionBy(*group)))
    spans = spans.withColumn("_parts", parts).withColumn("_first", F.coalesce(F.sum("_parts").over(before), F.lit(0)).cast("long"))
    above = number - F.col("_low")
    inside = F.floor(octave_code(above) * STEPS if by_octave else above / (F.col("_high") - F.col("_low")) * F.col("_parts")).cast("long")
    place = F.when(F.col("_parts") > 1, F.least(inside, F.col("_parts") - 1)).otherwise(F.lit(0))
    joined = placed.drop("_total").join(spans.drop("_rows", "_all_n"), [*group, "_bucket"])
    return joined.select(*group, "_v", "_n", "_total", (F.col("_first") + place).cast("long").alias("_bucket"))


def value_buckets(df: DataFrame, keys: Sequence[str], value: str, full: int = FULL, zooms: int = ZOOMS) -> DataFrame:
    """Distinct values (_v) per key with their count (_n), the group's _total and a _bucket that never decreases with the value."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = counted.withColumn("_bucket", F.floor(octave_code(F.col("_v")) * STEPS).cast("long"))
    for turn in range(max(1, zooms)):
        placed = _cut_again(placed, list(keys), full, by_octave=turn % 2 == 0)
    return placed


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key with their count, running count and the group's total."""
    keyed = df if keys else df.withColumn("_all", F.lit(0))
    group = list(keys) or ["_all"]
    placed = value_buckets(keyed, group, value)
    return running(placed, group, ["_v"], F.col("_bucket"), {"_upto": ("sum", F.col("_n"))})


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key with a column per entry of ``probs``, interpolated linearly between ranks.

    A group of at most FULL values sorts them in one row; only larger ones go through buckets.
    """
    keys = list(keys)
    if not keys:
        return _by_buckets(df, keys, value, probs)
    known = df.select(*keys, value)
    for name in dict.fromkeys([*keys, value]):  # a null key is no group, as in the joins on buckets
        known = known.where(F.col(name).isNotNull())
    # At most one row for FULL values: the keys of groups that need buckets.
    large = F.broadcast(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > FULL).drop("_rows"))
    listed = known.join(large, keys, "left_anti").groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_sorted"))
    picks = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.size("_sorted") - 1)
        low, high = (F.get("_sorted", rank(position).cast("int")) for rank in (F.floor, F.ceil))
        picks.append((low + (high - low) * (position - F.floor(position))).alias(name))
    many = _by_buckets(known.join(large, keys, "left_semi"), keys, value, probs)
    return listed.select(*keys, *picks).unionByName(many)


def _by_buckets(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    ranked = value_ranks(df, keys, value)
    picks = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{name}_{side}"))
        picks.append(F.max(position - F.floor(position)).alias(f"_{name}_part"))
    found = ranked.groupBy(*keys).agg(*picks)
    out = [
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n) for n in probs
    ]
    return found.select(*keys, *out)


def cumulative_share(df: DataFrame, keys: Sequence[str], value: str, name: str = "cdf") -> DataFrame:
    """Share of rows at or below each distinct value."""
    ranked = value_ranks(df, keys, value)
    return ranked.select(*keys, F.col("_v").alias(value), (F.col("_upto") / F.col("_total")).alias(name))
