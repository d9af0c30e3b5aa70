"""Streaming jobs run to the end of their input, against the batch answer in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.inputs import HOURLY, frame_ctes, hourly, read
from tidebar.catalog.registry import _CTES, cte, query, r, rcols, rs
from tidebar.catalog.replay_queries import END_COST, FIRST_ROW, ledger_ctes
from tidebar.catalog.source_queries import LIVE
from tidebar.functions.times import epoch_micros
from tidebar.session import Marts, scratch_path
from tidebar.sources.bars import tick_order
from tidebar.streaming import bars as sb
from tidebar.streaming import live as sl

OHLCV = "open high low close volume"


def _drained(spark, stream, label):
    output = scratch_path(spark, label)
    sb.drain(stream, output, scratch_path(spark, f"{label}-checkpoint"))
    return spark.read.parquet(output)


@query("stream_hourly_bars", HOURLY, f"""
SELECT symbol, ts, {rs(OHLCV)} FROM hourly_raw WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_hourly_bars(spark, sf_dir):
    """Bars whose window the watermark (two hours behind the newest tick) has passed."""
    schema = read(spark, sf_dir, "events").schema
    ticks = sb.file_stream(spark, f"{sf_dir}/events.parquet", schema)
    bars = sb.stream_bars(ticks, "1 hour", "2 hours", F.col("value"), F.lit(1), tick_order(epoch_micros("ts"), F.col("event_id")), "event_type", "ts")
    return _drained(spark, bars, "stream-bars").select("symbol", "ts", *rcols(OHLCV))


@query("stream_without_repeats", HOURLY, f"SELECT symbol, ts, {rs(OHLCV)} FROM hourly_raw")
def stream_without_repeats(spark, sf_dir):
    """Every bar arrives three times and passes once."""
    bars = hourly(spark, sf_dir).select("symbol", "ts", *OHLCV.split())
    folder = scratch_path(spark, "repeats")
    bars.unionByName(bars).unionByName(bars).write.parquet(folder)
    stream = sb.without_repeats(sb.file_stream(spark, folder, bars.schema), "40 days")
    return _drained(spark, stream, "stream-repeats").select("symbol", "ts", *rcols(OHLCV))


frame_ctes("hourly", "_h")
cte("live_h_state", _CTES["live_state"][1].replace("FROM frame", "FROM frame_h").replace("JOIN frame b", "JOIN frame_h b").replace("live_state", "live_h_state"),
    "symbol, rn, cash, side, units, level, best, peak, pid, closed, equity, value")
END_COST["live_h"], FIRST_ROW["live_h"] = END_COST["live"], FIRST_ROW["live"]
ledger_ctes("live_h", "frame_h", "symbol", "live_h")
cte("live_h_event", _CTES["live_event"][1].replace("live_trades", "live_h_trades"))
FRAME_H = f"{HOURLY} moves_h ema_h rolls_h frame_h"


def _stream(spark, sf_dir):
    def build():
        sl.use_rocksdb(spark)
        bars = hourly(spark, sf_dir).select("symbol", "ts", *OHLCV.split())
        folder = scratch_path(spark, "live-bars")
        bars.write.parquet(folder)
        rows = sl.bar_rows(sb.file_stream(spark, folder, bars.schema))
        return _drained(spark, sl.live_stream(rows, LIVE), "stream-live")

    return Marts.table(spark, sf_dir, "stream_live", build)


@query("stream_trade_events", f"{FRAME_H} live_h_state live_h_last live_h_trades live_h_event", f"""
SELECT symbol, type, reason, ts, {rs('price size pnl equity')} FROM live_h_event""")
def stream_trade_events(spark, sf_dir):
    return _stream(spark, sf_dir).where(F.col("kind") == "event").select("symbol", "type", "reason", "ts", *rcols("price size pnl equity"))


@query("stream_signals", FRAME_H, f"""
SELECT symbol, ts, {r('hi_8', 'top')}, {r('lo_16', 'floor')}, {r('CASE WHEN rn >= 15 THEN atr_14 END', 'atr')}, coalesce(high > hi_8, false) AS breakout, {r('(close - hi_8) / hi_8 * 100', 'distance_pct')} FROM frame_h""")
def stream_signals(spark, sf_dir):
    """Levels from the bars held in state; a true range needs a bar before, so the ATR starts one bar later."""
    signals = _stream(spark, sf_dir).where(F.col("kind") == "signal")
    return signals.select("symbol", "ts", *rcols("top floor atr"), "breakout", *rcols("distance_pct"))
