"""Input tables and the bar marts every query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.catalog.registry import cte
from tidebar.operators.windows import time_slice, with_row_number
from tidebar.session import Marts
from tidebar.functions.times import epoch_micros
from tidebar.sources.bars import build_bars, tick_order

DAY, HOUR = 86_400, 3_600

cte(
    "daily_raw",
    """
SELECT symbol, ts, first(px ORDER BY o, n, p, px) AS open, max(px) AS high, min(px) AS low,
       first(px ORDER BY o DESC, n DESC, p DESC, px DESC) AS close, sum(q) AS volume
FROM (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, date_trunc('day', l_shipdate) AS ts, l_orderkey AS o, l_linenumber AS n,
             l_partkey AS p, l_extendedprice / l_quantity AS px, l_quantity AS q FROM lineitem)
GROUP BY symbol, ts
""",
)
cte("daily", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM daily_raw")
cte(
    "hourly_raw",
    """
SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, first(value ORDER BY ts, event_id) AS open,
       max(value) AS high, min(value) AS low, first(value ORDER BY ts DESC, event_id DESC) AS close,
       CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY event_type, time_bucket(INTERVAL 1 HOUR, ts)
""",
)
cte("hourly", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM hourly_raw")
DAILY, HOURLY = "daily_raw daily", "hourly_raw hourly"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def daily_from_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = read(spark, sf_dir, "lineitem")
    return build_bars(
        ticks,
        DAY,
        F.col("l_extendedprice") / F.col("l_quantity"),
        F.col("l_quantity"),
        tick_order(F.col("l_orderkey") * 100 + F.col("l_linenumber"), F.col("l_partkey") * 10**8 + F.floor(F.col("l_extendedprice") / F.col("l_quantity"))),
        "l_suppkey",
        "l_shipdate",
    )


def hourly_from_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = read(spark, sf_dir, "events").withColumnRenamed("ts", "tick_ts")
    order = tick_order(epoch_micros("tick_ts"), F.col("event_id"))
    return build_bars(ticks, HOUR, F.col("value"), F.lit(1), order, "event_type", "tick_ts")


def _numbered(spark: SparkSession, sf_dir: str, name: str, raw, width: int) -> DataFrame:
    return Marts.table(
        spark, sf_dir, name, lambda: with_row_number(raw(spark, sf_dir), ["symbol"], ["ts"], time_slice("ts", width))
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir, "daily", daily_from_ticks, DAY)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir, "hourly", hourly_from_ticks, HOUR)


def _roll(fn: str, value: str, n: int, shift: int = 0) -> str:
    frame = f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)"
    return f"CASE WHEN count({value}) OVER {frame} = {n} THEN {fn}({value}) OVER {frame} END"


def frame_ctes(source: str, suffix: str = "", keys: str = "symbol") -> None:
    """SQL twin of the indicator frame over a numbered bar table."""
    by = f"PARTITION BY {keys}"

    def roll(fn: str, value: str, n: int, shift: int = 0) -> str:
        return _roll(fn, value, n, shift).replace("PARTITION BY symbol", by)

    cte(
        f"moves{suffix}",
        f"""
SELECT *, lag(close) OVER w AS prev_close, close - lag(close) OVER w AS change, close / lag(close) OVER w - 1 AS ret1,
       greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
FROM {source} WINDOW w AS ({by} ORDER BY rn)""",
    )
    cte(
        f"ema{suffix}",
        f"""
SELECT {keys}, rn, close AS ema200 FROM {source} WHERE rn = 1
UNION ALL
SELECT {", ".join("b." + k.strip() for k in keys.split(","))}, b.rn, b.close * (2.0::DOUBLE / 201) + (1 - 2.0::DOUBLE / 201) * e.ema200
FROM ema{suffix} e JOIN {source} b ON {" AND ".join(f"b.{k.strip()} = e.{k.strip()}" for k in keys.split(","))} AND b.rn = e.rn + 1""",
        f"{keys}, rn, ema200",
    )
    columns = ", ".join(f"{roll('max', 'high', n, 1)} AS hi_{n}, {roll('min', 'low', n, 1)} AS lo_{n}" for n in (6, 8, 12, 16, 40))
    gain, loss = "CASE WHEN change > 0 THEN change ELSE 0 END", "CASE WHEN change < 0 THEN -change ELSE 0 END"
    down = roll("avg", loss, 14)
    cte(
        f"rolls{suffix}",
        f"""
SELECT *, {columns}, {roll('avg', 'tr', 14)} AS atr_14, {roll('avg', 'tr', 20)} AS atr_20, {roll('avg', 'tr', 14, 1)} AS atrp_14,
       {roll('avg', 'close', 50)} AS sma50, {roll('avg', 'close', 200)} AS sma200, {roll('stddev_samp', 'ret1', 50)} AS vol50,
       100 - 100 / (1 + ({roll('avg', gain, 14)}) / CASE WHEN ({down}) = 0 THEN 1e-10 ELSE ({down}) END) AS rsi14,
       close / lag(close, 180) OVER w - 1 AS ret180, close / lag(close, 540) OVER w - 1 AS ret540,
       (close / lag(close, 10) OVER w - 1) * 100 AS trend10
FROM moves{suffix} WINDOW w AS ({by} ORDER BY rn)""",
    )
    cte(
        f"frame{suffix}",
        f"""
SELECT r.*, sma200 - lag(sma200, 20) OVER w AS slope20, sma200 / lag(sma200, 30) OVER w - 1 AS slope30, close / sma200 AS ratio200,
       vol50 * sqrt(1512::DOUBLE) AS vol_ann, e.ema200
FROM rolls{suffix} r JOIN ema{suffix} e USING ({keys}, rn) WINDOW w AS ({by} ORDER BY rn)""",
    )


frame_ctes("daily")
FRAME = f"{DAILY} moves ema rolls frame"


def frame(spark: SparkSession, sf_dir: str, ema: bool = True, placed: bool = False) -> DataFrame:
    """The indicator frame, computed where it is read: of its columns only those a query reads.

    Without ``ema`` the slow average and its exchange stay away; ``placed`` rows lie by symbol, ready for a replay.
    """
    from tidebar.functions.frame import indicator_frame

    return indicator_frame(daily(spark, sf_dir), slow=ema, placed=placed)
