"""Ticks to bars on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidebar.functions.times import epoch_micros, from_epoch_micros


def file_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder, or one file, as a stream; the file count bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    plain = path.rstrip("/")
    return reader.parquet(f"{plain[:-1]}[{plain[-1]}]")  # as a pattern, a path may name a file or a folder


def with_event_time(rows: DataFrame, ts: str) -> DataFrame:
    """Zone-free times as instants in UTC, which watermarks need."""
    return rows.withColumn("event_time", F.timestamp_micros(epoch_micros(ts)))


def zone_free(instant: str | Column) -> Column:
    return from_epoch_micros(F.unix_micros(instant))


def stream_bars(ticks: DataFrame, width: str, delay: str, price: Column, volume: Column, order: Column, symbol: str, ts: str) -> DataFrame:
    """Closed bars only: append mode emits a window once the watermark has passed its end."""
    timed = with_event_time(ticks, ts).withColumns({"_price": price, "_volume": volume, "_rank": order})
    bars = timed.withWatermark("event_time", delay).groupBy(F.col(symbol).cast("string").alias("symbol"), F.window("event_time", width).alias("w")).agg(
        F.min_by("_price", "_rank").alias("open"), F.max("_price").alias("high"), F.min("_price").alias("low"), F.max_by("_price", "_rank").alias("close"),
        F.sum("_volume").cast("double").alias("volume"),
    )
    return bars.select("symbol", zone_free("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def without_repeats(bars: DataFrame, delay: str) -> DataFrame:
    """Bars fetched again within the delay are dropped; the first copy to arrive stays."""
    timed = with_event_time(bars, "ts").withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(["symbol", "event_time"]).drop("event_time")


def drain(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Process everything available into parquet and stop; the checkpoint resumes exactly where it ended."""
    query = start_sink(stream, output, checkpoint, once=True)
    query.awaitTermination()


def start_sink(stream: DataFrame, output: str, checkpoint: str, once: bool = False, interval: str = "1 minute") -> StreamingQuery:
    """Append results to a parquet folder, exactly once per micro-batch."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
    return writer.start()
