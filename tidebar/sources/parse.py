"""Parsers for landed raw documents: bar pages, envelopes, trade logs and state documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions.times import from_epoch_micros, from_epoch_millis, from_epoch_seconds

PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
LOG_EVENT = (
    "type string, reason string, time string, price double, size double, equity double, strategy string, trailing_stop double, pnl double"
)
STATE = (
    "strategy string, initial_capital double, equity double, position_size double, "
    "position_units array<struct<entry_price: double, size: double, trailing_stop: double, time: string>>, trade_count bigint, last_run string"
)
# What a state document means when a key is missing.
STATE_DEFAULTS = {"strategy": "V4", "initial_capital": 1000.0, "equity": 1000.0, "position_size": 0.0, "trade_count": 0}


def _at(row: str, index: int) -> Column:
    return F.element_at(row, index + 1)


def parse_klines(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Bars from pages of 12-field arrays (epoch milliseconds, prices as text)."""
    rows = pages.withColumn("_row", F.explode(F.from_json(payload, "array<array<string>>")))
    kept = [c for c in pages.columns if c != payload]
    prices = [_at("_row", i + 1).cast("double").alias(c) for i, c in enumerate(PRICE_COLUMNS)]
    return rows.select(*kept, from_epoch_millis(_at("_row", 0)).alias("ts"), *prices)


def parse_ohlc_envelope(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Bars from enveloped pages: the pair is the one key that is not ``last``; error envelopes drop out."""
    opened = pages.withColumn("_doc", F.from_json(payload, "error array<string>, result map<string, string>"))
    good = opened.where(F.size("_doc.error") == 0)
    pairs = good.withColumn("_pairs", F.map_filter("_doc.result", lambda k, v: k != "last"))
    rows = pairs.select(
        *[c for c in pages.columns if c != payload], F.explode("_pairs").alias("pair", "_text")
    ).withColumn("_row", F.explode(F.from_json("_text", "array<array<string>>")))
    at = dict(zip(("open", "high", "low", "close", "volume"), (1, 2, 3, 4, 6)))
    prices = [_at("_row", i).cast("double").alias(c) for c, i in at.items()]
    return rows.drop("_text").select(*[c for c in rows.columns if not c.startswith("_")], from_epoch_seconds(_at("_row", 0)).alias("ts"), *prices)


def event_time(text: Column) -> Column:
    """Instant of an ISO text with zone as zone-free UTC; null when it does not parse."""
    return from_epoch_micros(F.unix_micros(F.try_to_timestamp(text)))


def parse_trade_log(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per logged event under the superset schema; keys an event lacks are null."""
    rows = docs.withColumn("_event", F.explode(F.from_json(payload, f"array<struct<{_nested(LOG_EVENT)}>>")))
    kept = [c for c in docs.columns if c != payload]
    return rows.select(*kept, "_event.*").withColumn("ts", event_time(F.col("time")))


def _nested(ddl: str) -> str:
    return ", ".join(part.replace(" ", ": ", 1) for part in ddl.split(", "))


def parse_state(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """State documents with defaults for missing keys and an empty list for missing units."""
    opened = docs.withColumn("_state", F.from_json(payload, STATE))
    kept = [c for c in docs.columns if c != payload]
    units = F.coalesce("_state.position_units", F.expr("CAST(array() AS array<struct<entry_price: double, size: double, trailing_stop: double, time: string>>)"))
    filled = [F.coalesce(F.col(f"_state.{c}"), F.lit(v)).alias(c) for c, v in STATE_DEFAULTS.items()]
    return opened.select(*kept, *filled, units.alias("position_units"), F.col("_state.last_run").alias("last_run"))


def open_units(states: DataFrame) -> DataFrame:
    """One row per open unit; documents without units keep one row with nulls."""
    rest = [c for c in states.columns if c != "position_units"]
    return states.select(*rest, F.posexplode_outer("position_units").alias("unit", "_u")).select(*rest, "unit", "_u.*")
