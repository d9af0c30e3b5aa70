"""Window primitives that never put one whole series into one task.

Bounded row frames run over fixed-size chunks of a series with a halo of the
preceding rows.  Running aggregates run in two levels: inside a slice, then over
one summary row per slice.  Both give the value the plain window would give.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions.times import epoch_seconds

CHUNK_ROWS = 4096


def time_slice(ts: str | Column, width_seconds: int, rows_per_slice: int = CHUNK_ROWS) -> Column:
    """Slice number of a bar; a grid of one bar per width bounds the rows in a slice."""
    return F.floor(epoch_seconds(ts) / F.lit(width_seconds * rows_per_slice)).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    outputs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Running aggregates from the start of each key up to the current row.

    outputs maps a column name to (kind, expression); kind is sum, count, max, min,
    max_before (largest on earlier rows), first, last (latest non-null so far), before (latest non-null on an earlier row)
    or lag.  slice_by must not decrease along ``order``.
    """
    return running_stages(df, keys, order, slice_by, [(lambda rows: rows, outputs)])


def running_stages(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    stages: Sequence[tuple[Callable[[DataFrame], DataFrame], dict[str, tuple[str, Column]]]],
) -> DataFrame:
    """Running aggregates one after the other: each stage adds columns to its rows, then runs its outputs over them.

    Rows move once, to their slice; the joins and windows of all stages and the summaries of later ones read them there.
    The first summaries are of the rows where they lie, so they merge before they move: a row for each slice and task.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", slice_by)
    placed, source = sliced.repartition(*keys, "_slice"), sliced
    for shape, outputs in stages:
        rows = shape(placed)
        placed = _run(rows, keys, order, outputs, rows if source is None else shape(source))
        source = None
    return placed.drop("_slice")


def _run(df: DataFrame, keys: list[str], order: Sequence[str], outputs: dict[str, tuple[str, Column]], source: DataFrame) -> DataFrame:
    """The outputs over the placed rows of df; source has the same rows, wherever they lie."""
    base, summed = df, source
    position = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])
    for name, (_, expression) in outputs.items():
        base, summed = base.withColumn(f"_in_{name}", expression), summed.withColumn(f"_in_{name}", expression)

    totals, carries = [], []
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    previous = Window.partitionBy(*keys).orderBy("_slice")
    for name, (kind, _) in outputs.items():
        value, total = F.col(f"_in_{name}"), F.col(f"_t_{name}")
        if kind in ("sum", "count"):
            summary = F.sum(value) if kind == "sum" else F.count(value)
            carry = F.sum(total).over(earlier)
        elif kind in ("max", "min", "max_before"):
            pick = getattr(F, kind[:3])
            summary, carry = pick(value), pick(total).over(earlier)
        elif kind == "first":
            summary = F.min_by(value, F.when(value.isNotNull(), position))
            carry = F.first(total, ignorenulls=True).over(earlier)
        elif kind in ("last", "before"):
            summary = F.max_by(value, F.when(value.isNotNull(), position))
            carry = F.last(total, ignorenulls=True).over(earlier)
        elif kind == "lag":
            summary, carry = F.max_by(value, position), F.lag(total).over(previous)
        else:
            raise ValueError(f"unknown running aggregate {kind!r}")
        totals.append(summary.alias(f"_t_{name}"))
        carries.append(carry.alias(f"_c_{name}"))

    carried = summed.groupBy(*keys, "_slice").agg(*totals).select(*keys, "_slice", *carries)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    above = inside.rowsBetween(Window.unboundedPreceding, -1)

    out = base.join(carried, [*keys, "_slice"])
    finished = []
    for name, (kind, _) in outputs.items():
        value, carry = F.col(f"_in_{name}"), F.col(f"_c_{name}")
        if kind == "sum":
            result = F.coalesce(carry, F.lit(0)) + F.coalesce(F.sum(value).over(upto), F.lit(0))
        elif kind == "count":
            result = F.coalesce(carry, F.lit(0)) + F.count(value).over(upto)
        elif kind == "max":
            result = F.greatest(carry, F.max(value).over(upto))
        elif kind == "max_before":
            result = F.greatest(carry, F.max(value).over(above))
        elif kind == "min":
            result = F.least(carry, F.min(value).over(upto))
        elif kind == "first":
            result = F.coalesce(carry, F.first(value, ignorenulls=True).over(upto))
        elif kind == "last":
            result = F.coalesce(F.last(value, ignorenulls=True).over(upto), carry)
        elif kind == "before":
            result = F.coalesce(F.last(value, ignorenulls=True).over(above), carry)
        else:
            result = F.when(F.row_number().over(inside) == 1, carry).otherwise(F.lag(value).over(inside))
        finished.append(result.alias(name))
    return out.select(*df.columns, *finished)


def row_slice(rn: str = "rn", rows_per_slice: int = CHUNK_ROWS) -> Column:
    """Slice number of a row that carries its position in the series."""
    return F.floor((F.col(rn) - 1) / F.lit(rows_per_slice)).cast("long")


def with_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, name: str = "rn"
) -> DataFrame:
    """Position of each row in its series, counted from 1, without a whole-series sort."""
    numbered = running(df, keys, order, slice_by, {name: ("count", F.lit(1))})
    return numbered.withColumn(name, F.col(name).cast("long"))


def framed(
    df: DataFrame,
    keys: Sequence[str],
    build: Callable[[WindowSpec], dict[str, Column]] | Sequence[Callable[[WindowSpec], dict[str, Column]]],
    back: int,
    ahead: int = 0,
    rn: str = "rn",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Columns over frames of at most ``back`` rows before and ``ahead`` rows after.

    ``build`` receives the window of a chunk; several builders run one after the
    other, so a later one may look back over columns of an earlier one.  All share
    a single exchange and sort on (keys, chunk).  Columns named with two leading
    underscores serve later builders only.
    """
    chunk_rows = max(chunk_rows, back, ahead, 1)
    builders = list(build) if isinstance(build, (list, tuple)) else [build]
    home = F.floor((F.col(rn) - 1) / F.lit(chunk_rows)).cast("long")
    place = (F.col(rn) - 1) % F.lit(chunk_rows)
    copies = [home]
    if back:
        copies.append(F.when(place >= chunk_rows - back, home + 1))
    if ahead:
        copies.append(F.when((place < ahead) & (home > 0), home - 1))
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(F.array_compact(F.array(*copies))))
    window = Window.partitionBy(*keys, "_chunk").orderBy(rn)
    added: list[str] = []
    for builder in builders:
        columns = builder(window)
        spread = spread.withColumns(columns)
        added += [c for c in columns if c not in added and not c.startswith("__")]
    kept = [c for c in df.columns if c not in added]
    return spread.where(F.col("_home") == F.col("_chunk")).select(*kept, *added)


def runs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    value: Column,
    name: str = "run_id",
) -> DataFrame:
    """Number maximal runs of equal ``value`` (null-safe) along each series, from 1."""
    seen = df.withColumn("_value", F.struct(value.alias("v")))
    before = running(seen, keys, order, slice_by, {"_prior": ("lag", F.col("_value"))})
    change = F.col("_prior").isNull() | ~F.col("_prior").eqNullSafe(F.col("_value"))
    marked = before.withColumn("_change", change.cast("long"))
    out = running(marked, keys, order, slice_by, {name: ("sum", F.col("_change"))})
    return out.select(*df.columns, F.col(name).cast("long").alias(name))
