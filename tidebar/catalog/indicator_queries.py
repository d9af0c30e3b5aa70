"""Indicator columns (rolling, lag and running windows) over the bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.inputs import DAILY, DAY, FRAME, HOUR, HOURLY, daily, frame, hourly
from tidebar.catalog.registry import query, r, rcols, rs
from tidebar.functions import indicators as ind
from tidebar.operators.ema import ema
from tidebar.operators.sliding import Slide, sliding
from tidebar.operators.windows import framed, running, time_slice

KEY = ["symbol"]


@query("previous_bar", DAILY, f"""
SELECT symbol, ts, {r('lag(high) OVER w', 'prev_high')}, {r('lag(low) OVER w', 'prev_low')}, {r('lag(close) OVER w', 'prev_close')}
FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def previous_bar(spark, sf_dir):
    bars = framed(daily(spark, sf_dir), KEY, lambda w: {f"prev_{c}": F.lag(c).over(w) for c in ("high", "low", "close")}, 1)
    return bars.select("symbol", "ts", *rcols("prev_high prev_low prev_close"))


def _full_sql(fn: str, value: str, n: int, shift: int = 0) -> str:
    frame = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} PRECEDING)"
    return f"CASE WHEN count({value}) OVER {frame} = {n} THEN {fn}({value}) OVER {frame} END"


def _channel_sql(shift: int) -> str:
    return f"""SELECT symbol, ts, {r(_full_sql('max', 'high', 40, shift), 'upper_entry')}, {r(_full_sql('min', 'low', 40, shift), 'lower_entry')},
       {r(_full_sql('max', 'high', 16, shift), 'upper_exit')}, {r(_full_sql('min', 'low', 16, shift), 'lower_exit')} FROM daily"""


def _channels(spark, sf_dir, rule, entry=40, exit_=16):
    def build(w):
        (ue, le), (ux, lx) = rule(w, entry), rule(w, exit_)
        return {"upper_entry": ue, "lower_entry": le, "upper_exit": ux, "lower_exit": lx}

    bars = framed(daily(spark, sf_dir).select("symbol", "ts", "high", "low", "rn"), KEY, build, max(entry, exit_))
    return bars.select("symbol", "ts", *rcols("upper_entry lower_entry upper_exit lower_exit"))


@query("channel_prior_bars", DAILY, _channel_sql(1))
def channel_prior_bars(spark, sf_dir):
    return _channels(spark, sf_dir, ind.channel_prior)


@query("channel_inclusive", DAILY, _channel_sql(0))
def channel_inclusive(spark, sf_dir):
    return _channels(spark, sf_dir, ind.channel_inclusive)


@query("channel_partial", DAILY, f"""
SELECT symbol, ts, {r('coalesce(max(high) OVER e, high)', 'upper_entry')}, {r('coalesce(min(low) OVER e, low)', 'lower_entry')},
       {r('coalesce(max(high) OVER x, high)', 'upper_exit')}, {r('coalesce(min(low) OVER x, low)', 'lower_exit')}
FROM daily WINDOW e AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING),
                  x AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)""")
def channel_partial(spark, sf_dir):
    return _channels(spark, sf_dir, ind.channel_partial)


def _frame_columns(name, columns):
    @query(name, FRAME, f"SELECT symbol, ts, {rs(columns)} FROM frame")
    def run(spark, sf_dir):
        return frame(spark, sf_dir).select("symbol", "ts", *rcols(columns))

    return run


def _single(name, columns, sql, build, back, inputs=("high", "low", "close")):
    @query(name, DAILY, sql)
    def run(spark, sf_dir):
        bars = daily(spark, sf_dir).select("symbol", "ts", "rn", *inputs)
        return framed(bars, KEY, build, back).select("symbol", "ts", *rcols(columns))

    return run


_TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
_WITH_TR = f"(SELECT *, {_TR} AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM daily))"

_single(
    "true_range",
    "tr tr_strict",
    f"SELECT symbol, ts, {r('tr')}, {r('CASE WHEN pc IS NOT NULL THEN tr END', 'tr_strict')} FROM {_WITH_TR}",
    lambda w: {"tr": ind.true_range(w), "tr_strict": ind.true_range(w, first_null=True)},
    1,
)
_single(
    "average_true_range",
    "atr_20 atr_14",
    f"SELECT symbol, ts, {r(_full_sql('avg', 'tr', 20), 'atr_20')}, {r(_full_sql('avg', 'tr', 14), 'atr_14')} FROM {_WITH_TR}",
    [
        lambda w: {"tr": ind.true_range(w)},
        lambda w: {f"atr_{n}": ind.rolling("avg", F.col("tr"), w, n) for n in (20, 14)},
    ],
    21,
)
_single(
    "average_true_range_prior",
    "atr_prior",
    f"SELECT symbol, ts, {r(_full_sql('avg', 'tr', 14, 1), 'atr_prior')} FROM {_WITH_TR}",
    [lambda w: {"tr": ind.true_range(w)}, lambda w: {"atr_prior": ind.rolling("avg", F.col("tr"), w, 14, 1)}],
    15,
)


@query("atr_latest_partial", DAILY, f"""
SELECT symbol, max(ts) AS ts, {r('max_by(atr, ts)', 'atr')} FROM (
  SELECT symbol, ts, avg(CASE WHEN pc IS NOT NULL THEN tr END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS atr
  FROM {_WITH_TR}) GROUP BY symbol""")
def atr_latest_partial(spark, sf_dir):
    bars = framed(
        daily(spark, sf_dir).drop("open", "volume"),
        KEY,
        [
            lambda w: {"tr": ind.true_range(w, first_null=True)},
            lambda w: {"atr": ind.rolling_partial("avg", F.col("tr"), w, 20)},
        ],
        21,
    )
    latest = bars.groupBy("symbol").agg(F.max_by("atr", "ts").alias("atr"), F.max("ts").alias("ts"))
    return latest.select("symbol", "ts", *rcols("atr"))


@query("atr_percent", DAILY, f"""
SELECT symbol, ts, {r('(' + _full_sql('avg', 'tr', 14) + ') / close * 100', 'atr_pct')} FROM {_WITH_TR}""")
def atr_percent(spark, sf_dir):
    bars = framed(
        daily(spark, sf_dir).drop("open", "volume"),
        KEY,
        [
            lambda w: {"tr": ind.true_range(w)},
            lambda w: {"atr_pct": ind.rolling("avg", F.col("tr"), w, 14) / F.col("close") * 100},
        ],
        15,
    )
    return bars.select("symbol", "ts", *rcols("atr_pct"))


_single(
    "simple_averages",
    "sma50 sma100 sma200 sma50_prior",
    "SELECT symbol, ts, "
    + ", ".join(r(_full_sql("avg", "close", n), f"sma{n}") for n in (50, 100, 200))
    + f", {r(_full_sql('avg', 'close', 50, 1), 'sma50_prior')} FROM daily",
    sliding({f"sma{n}": Slide("avg", "close", n) for n in (50, 100, 200)} | {"sma50_prior": Slide("avg", "close", 50, 1)}),
    201,
    ("close",),
)

EMA_SQL = f"SELECT symbol, b.ts, {r('e.ema200', 'ema200')} FROM ema e JOIN daily b USING (symbol, rn)"


@query("exponential_average", f"{DAILY} ema", EMA_SQL)
def exponential_average(spark, sf_dir):
    bars = daily(spark, sf_dir).select("symbol", "ts", "rn", "close")
    return ema(bars, KEY, "close", 200, "ema200").select("symbol", "ts", *rcols("ema200"))


_frame_columns("relative_strength", "rsi14")
_single(
    "percent_changes",
    "ret1 ret20 ret180 ret540",
    "SELECT symbol, ts, "
    + ", ".join(r(f"close / lag(close, {k}) OVER w - 1", f"ret{k}") for k in (1, 20, 180, 540))
    + " FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts)",
    lambda w: {f"ret{k}": ind.pct_change(F.col("close"), w, k) for k in (1, 20, 180, 540)},
    540,
    ("close",),
)
_frame_columns("rolling_volatility", "vol50 vol_ann")
_frame_columns("average_slope", "slope20 slope30")
_frame_columns("price_to_average", "ratio200")


@query("running_high_drawdown", DAILY, f"""
SELECT symbol, ts, {r('ath')}, {r('(close - ath) / ath', 'fall')}
FROM (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS ath FROM daily)""")
def running_high_drawdown(spark, sf_dir):
    bars = daily(spark, sf_dir).select("symbol", "ts", "close")
    high = running(bars, KEY, ["ts"], time_slice("ts", DAY), {"ath": ("max", F.col("close"))})
    return high.withColumn("fall", (F.col("close") - F.col("ath")) / F.col("ath")).select("symbol", "ts", *rcols("ath fall"))


_single(
    "bar_trend",
    "trend10 trend9",
    f"""SELECT symbol, ts, {r('(close - lag(close, 10) OVER w) / lag(close, 10) OVER w * 100', 'trend10')},
        {r('(close - lag(close, 9) OVER w) / lag(close, 9) OVER w * 100', 'trend9')} FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    lambda w: {
        f"trend{k}": (F.col("close") - F.lag("close", k).over(w)) / F.lag("close", k).over(w) * 100 for k in (10, 9)
    },
    10,
    ("close",),
)


@query("up_day_streaks", DAILY, """
SELECT symbol, ts, up, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS place FROM (
  SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM (
    SELECT *, CASE WHEN up = lag(up) OVER (PARTITION BY symbol ORDER BY ts) THEN 0 ELSE 1 END AS step FROM (
      SELECT symbol, ts, close > open AS up FROM daily)))""")
def up_day_streaks(spark, sf_dir):
    """Place of each bar in its run of equal direction: its number less that of the run's first bar."""
    bars = daily(spark, sf_dir).select("symbol", "ts", "rn", (F.col("close") > F.col("open")).alias("up"))
    turned = framed(bars, KEY, lambda w: {"turn": ~F.lag("up").over(w).eqNullSafe(F.col("up"))}, 1)
    starts = running(
        turned, KEY, ["ts"], time_slice("ts", DAY), {"start": ("max", F.when(F.col("turn"), F.col("rn")))}
    )
    return starts.select("symbol", "ts", "up", (F.col("rn") - F.col("start") + 1).alias("place"))


@query("missing_bars", HOURLY, """
SELECT symbol, unnest(generate_series(prev + INTERVAL 1 HOUR, ts - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ts
FROM (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM hourly)
WHERE ts > prev + INTERVAL 1 HOUR""")
def missing_bars(spark, sf_dir):
    from tidebar.sources.bars import missing_bars as find

    return find(hourly(spark, sf_dir), HOUR)
