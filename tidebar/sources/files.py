"""File sources and sinks for bars, logs, states and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.sources.parse import parse_state, parse_trade_log

BARS = "symbol string, timeframe string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
NTZ = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", header: bool = True) -> DataFrame:
    """Bars with the declared schema; nothing is inferred, so CSV is read once."""
    if fmt == "parquet":
        return spark.read.schema(BARS).parquet(path)
    return spark.read.schema(BARS).option("timestampNTZFormat", NTZ).csv(path, header=header)


def write_bars(bars: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Bars by symbol folder (parquet) or as plain CSV.

    Rows of one symbol are spread over files by year, so a hot symbol is not one file.
    """
    if fmt == "parquet":
        spread = bars.repartition("symbol", F.year("ts"))
        spread.write.mode(mode).partitionBy("symbol").parquet(path)
    else:
        bars.write.mode(mode).option("timestampNTZFormat", NTZ).csv(path, header=True)


def write_result(table: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = ()) -> None:
    """A result table, replaced as a whole."""
    writer = table.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(path)


def append_bars(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Add fresh bars to a stored table: only the symbol folders they touch are rewritten."""
    from tidebar.session import scratch_path
    from tidebar.sources.bars import upsert_bars

    touched = fresh.select("symbol").distinct()
    stored = spark.read.schema(BARS).parquet(path).join(touched, "symbol", "left_semi")
    staged = scratch_path(spark, "append")
    upsert_bars(stored, fresh.select(stored.columns)).write.parquet(staged)
    merged = spark.read.schema(BARS).parquet(staged).repartition("symbol", F.year("ts"))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def read_trade_log(spark: SparkSession, path: str) -> DataFrame:
    """Logged events of JSON files, as parse_trade_log gives them."""
    return parse_trade_log(spark.read.text(path, wholetext=True), "value")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """State document(s) with defaults for missing keys, as parse_state gives them."""
    return parse_state(spark.read.text(path, wholetext=True), "value")
