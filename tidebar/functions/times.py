"""Time arithmetic on TIMESTAMP_NTZ columns that no session zone can shift."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def origin() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def _fraction(ts: Column) -> Column:
    second = F.extract(F.lit("SECOND"), ts)
    return ((second - F.floor(second)) * 1_000_000).cast("long")


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970, floored; on a zone-free time this reads the stored value."""
    column = _column(ts)
    cut = F.unix_timestamp(column)  # cut towards zero, so times before 1970 with a fraction need one less
    return F.when((column < origin()) & (_fraction(column) > 0), cut - 1).otherwise(cut)


def epoch_micros(ts: str | Column) -> Column:
    return epoch_seconds(ts) * 1_000_000 + _fraction(_column(ts))


def from_epoch_seconds(seconds: str | Column) -> Column:
    return F.timestamp_add("SECOND", _column(seconds).cast("long"), origin())


def from_epoch_micros(micros: str | Column) -> Column:
    return F.timestamp_add("MICROSECOND", _column(micros).cast("long"), origin())


def from_epoch_millis(millis: str | Column) -> Column:
    return from_epoch_micros(_column(millis).cast("long") * 1000)


def floor_time(ts: str | Column, width_seconds: int) -> Column:
    seconds = epoch_seconds(ts)
    return from_epoch_seconds(seconds - F.pmod(seconds, F.lit(width_seconds)))


def days_between(start: str | Column, end: str | Column) -> Column:
    """Whole elapsed days, truncated."""
    return ((epoch_micros(end) - epoch_micros(start)) / 86_400_000_000).cast("long")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(1_000_000)


def time_text(ts: str | Column) -> Column:
    """ISO text in UTC of a zone-free time."""
    return F.concat(F.date_format(_column(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def age_text(seconds: Column) -> Column:
    """Bucketed age wording for a non-negative number of seconds."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 60, F.lit("Just now"))
        .when(seconds < 3600, F.concat(F.floor(whole / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(whole / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(whole / 86400).cast("string"), F.lit("d ago")))
    )
