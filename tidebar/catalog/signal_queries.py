"""Signals, gates, sizes, costs and scores over the indicator frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.inputs import DAILY, FRAME, daily, frame
from tidebar.catalog.registry import query, r, rcols, rounded
from tidebar.functions import regimes as reg
from tidebar.functions import signals as sig
from tidebar.functions.regimes import known
from tidebar.operators.windows import framed

KEY = ["symbol"]


def no():
    return F.lit(False)


def yes():
    return F.lit(True)


def _yes(condition: str, name: str) -> str:
    return f"coalesce({condition}, false) AS {name}"


@query("breakout_summary", FRAME, """
SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE close > hi_40) AS breakouts, min(ts) FILTER (WHERE close > hi_40) AS first_breakout
FROM frame GROUP BY symbol""")
def breakout_summary(spark, sf_dir):
    from tidebar.functions.indicators import channel_prior

    bars = framed(
        daily(spark, sf_dir).select("symbol", "ts", "rn", "high", "low", "close"),
        KEY,
        lambda w: {"hi_40": channel_prior(w, 40)[0]},
        41,
    )
    hit = sig.long_breakout(F.col("hi_40"))
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.count_if(hit).alias("breakouts"),
        F.min(F.when(hit, F.col("ts"))).alias("first_breakout"),
    )


@query("close_breakouts", FRAME, f"SELECT symbol, ts, {_yes('close > hi_40', 'long_entry')} FROM frame")
def close_breakouts(spark, sf_dir):
    return frame(spark, sf_dir).select("symbol", "ts", sig.long_breakout(F.col("hi_40")).alias("long_entry"))


@query("short_breakouts", FRAME, f"""
SELECT symbol, ts, {_yes('close < lo_40 AND close < ema200', 'short_gated')}, {_yes('close < lo_40', 'short_free')} FROM frame""")
def short_breakouts(spark, sf_dir):
    low, slow = F.col("lo_40"), F.col("ema200")
    return frame(spark, sf_dir).select(
        "symbol",
        "ts",
        sig.short_breakout(low, no(), yes(), slow).alias("short_gated"),
        sig.short_breakout(low, no(), no(), slow).alias("short_free"),
    )


@query("channel_exits", FRAME, f"""
SELECT symbol, ts, {_yes('close < lo_16', 'long_exit')}, {_yes('close > hi_16', 'short_exit')} FROM frame""")
def channel_exits(spark, sf_dir):
    return frame(spark, sf_dir).select(
        "symbol", "ts", known(F.col("close") < F.col("lo_16")).alias("long_exit"),
        known(F.col("close") > F.col("hi_16")).alias("short_exit"),
    )


@query("intrabar_breakouts", FRAME, f"""
SELECT symbol, ts, {_yes('high > hi_8', 'entry')}, {_yes('low <= lo_6', 'exit_touch')}, {_yes('low < lo_16', 'exit_cross')} FROM frame""")
def intrabar_breakouts(spark, sf_dir):
    return frame(spark, sf_dir).select(
        "symbol", "ts", known(F.col("high") > F.col("hi_8")).alias("entry"),
        known(F.col("low") <= F.col("lo_6")).alias("exit_touch"),
        known(F.col("low") < F.col("lo_16")).alias("exit_cross"),
    )


@query("inclusive_channel_breakouts", DAILY, f"""
SELECT symbol, ts, {_yes('high >= lag(top) OVER w', 'entry')}, {_yes('low <= lag(floor) OVER w', 'exit')} FROM (
  SELECT *, CASE WHEN rn >= 40 THEN max(high) OVER (PARTITION BY symbol ORDER BY rn ROWS 39 PRECEDING) END AS top,
         CASE WHEN rn >= 16 THEN min(low) OVER (PARTITION BY symbol ORDER BY rn ROWS 15 PRECEDING) END AS floor FROM daily)
WINDOW w AS (PARTITION BY symbol ORDER BY rn)""")
def inclusive_channel_breakouts(spark, sf_dir):
    from tidebar.functions.indicators import channel_inclusive

    bars = framed(
        daily(spark, sf_dir).select("symbol", "ts", "rn", "high", "low"),
        KEY,
        [
            lambda w: {"top": channel_inclusive(w, 40)[0], "bottom": channel_inclusive(w, 16)[1]},
            lambda w: {
                "entry": known(F.col("high") >= F.lag("top").over(w)),
                "exit": known(F.col("low") <= F.lag("bottom").over(w)),
            },
        ],
        41,
    )
    return bars.select("symbol", "ts", "entry", "exit")


@query("previous_bar_signal_never_fires", FRAME, """
SELECT symbol, count(*) AS bars, count(*) FILTER (WHERE prev_high > hi_40) AS breakouts, count(*) FILTER (WHERE prev_low < lo_16) AS exits
FROM (SELECT *, lag(high) OVER w AS prev_high, lag(low) OVER w AS prev_low FROM frame WINDOW w AS (PARTITION BY symbol ORDER BY rn))
GROUP BY symbol""")
def previous_bar_signal_never_fires(spark, sf_dir):
    """A prior-bar channel already holds the previous bar, so this signal is always 0: a data check."""
    bars = framed(
        frame(spark, sf_dir).select("symbol", "rn", "high", "low", "hi_40", "lo_16"),
        KEY,
        lambda w: {"prev_high": F.lag("high").over(w), "prev_low": F.lag("low").over(w)},
        1,
    )
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.count_if(F.col("prev_high") > F.col("hi_40")).alias("breakouts"),
        F.count_if(F.col("prev_low") < F.col("lo_16")).alias("exits"),
    )


@query("gates", FRAME, f"""
SELECT symbol, ts, {_yes('atr_14 / close * 100 BETWEEN 1.0 AND 60.0', 'volatility_ok')}, {_yes('close > sma200', 'trend_ok')},
       NOT coalesce(close < ema200, false) AS ema_ok, {_yes('rsi14 >= 45', 'momentum_ok')} FROM frame""")
def gates(spark, sf_dir):
    return frame(spark, sf_dir).select(
        "symbol", "ts", known((F.col("atr_14") / F.col("close") * 100).between(1.0, 60.0)).alias("volatility_ok"),
        known(F.col("close") > F.col("sma200")).alias("trend_ok"),
        (~known(F.col("close") < F.col("ema200"))).alias("ema_ok"),
        known(F.col("rsi14") >= 45).alias("momentum_ok"),
    )


TREND_REGIME_SQL = """CASE WHEN coalesce(close > sma200, false) AND coalesce(slope20 > 0, false) THEN 'Bull'
     WHEN NOT coalesce(close > sma200, false) AND NOT coalesce(slope20 > 0, false) THEN 'Bear'
     WHEN coalesce(close > sma200, false) THEN 'Bull Weakening' ELSE 'Bear Recovering' END"""


@query("gate_reasons", FRAME, f"""
SELECT symbol, ts, can_trade, reasons FROM (
SELECT symbol, ts, coalesce(close > sma200, false) AND NOT coalesce(rsi14 < 45, false) AND ({TREND_REGIME_SQL}) <> 'Bear' AS can_trade,
  concat_ws('; ', CASE WHEN NOT coalesce(close > sma200, false) THEN 'Below 200 SMA' END,
            CASE WHEN rsi14 < 45 THEN 'RSI below threshold' END,
            CASE WHEN ({TREND_REGIME_SQL}) = 'Bear' THEN 'Bear market regime' END) AS reasons FROM frame)""")
def gate_reasons(spark, sf_dir):
    barred = frame(spark, sf_dir).withColumn("regime", reg.trend_regime()).withColumn("why", sig.gate_reasons())
    return barred.select("symbol", "ts", (F.size("why") == 0).alias("can_trade"), F.array_join("why", "; ").alias("reasons"))


@query("latest_signals", FRAME, f"""
SELECT symbol, ts, {r('close')}, {r('hi_40', 'upper_entry')}, {r('lo_16', 'lower_exit')}, {r('atr_20', 'atr')}, {r('ema200')},
  {_yes('close > hi_40', 'long_entry')}, {_yes('close < lo_40 AND close < ema200', 'short_entry')}, {_yes('close < lo_16', 'long_exit')},
  {_yes('close > hi_16', 'short_exit')},
  {r('CASE WHEN atr_20 * 2 <= 0 THEN 0 ELSE greatest(0.001, round_even(100000 * 0.01 / (atr_20 * 2) / 0.001, 0) * 0.001) END', 'size')},
  {r('high - 4.0 * atr_20', 'stop_from_high')}, {r('(close - hi_40) / hi_40 * 100', 'distance_pct')}
FROM frame QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1""")
def latest_signals(spark, sf_dir):
    columns = ("high", "close", "hi_40", "lo_40", "hi_16", "lo_16", "atr_20", "ema200")
    latest = [F.max_by(c, "ts").alias(c) for c in columns]  # column by column, so the aggregate is by hash
    last = frame(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("ts"), *latest)
    return last.select(
        "symbol", "ts", *rcols("close"), rounded("hi_40", "upper_entry"), rounded("lo_16", "lower_exit"),
        rounded("atr_20", "atr"), *rcols("ema200"),
        sig.long_breakout(F.col("hi_40")).alias("long_entry"),
        sig.short_breakout(F.col("lo_40"), no(), yes(), F.col("ema200")).alias("short_entry"),
        known(F.col("close") < F.col("lo_16")).alias("long_exit"),
        known(F.col("close") > F.col("hi_16")).alias("short_exit"),
        rounded(sig.unit_size(F.lit(100000.0), F.col("atr_20"), F.lit(1.0), F.lit(2.0), F.lit(0.001)), "size"),
        rounded(F.col("high") - 4.0 * F.col("atr_20"), "stop_from_high"),
        rounded(sig.distance_pct(F.col("hi_40")), "distance_pct"),
    )


@query("distance_to_breakout", FRAME, f"SELECT symbol, ts, {r('(close - hi_40) / hi_40 * 100', 'distance_pct')} FROM frame")
def distance_to_breakout(spark, sf_dir):
    return frame(spark, sf_dir).select("symbol", "ts", rounded(sig.distance_pct(F.col("hi_40")), "distance_pct"))


FIT_SQL = """
SELECT *, CASE WHEN hi_40 > 0 THEN CASE WHEN gap > 0 THEN 40 WHEN gap > -2 THEN trunc(35 + gap * 2.5) WHEN gap > -5 THEN trunc(20 + gap * 3)
              ELSE greatest(0, trunc(5 + gap)) END ELSE 0 END
  + CASE WHEN body > 0.6 THEN 20 WHEN body > 0.3 THEN trunc(10 + body * 16) WHEN body > 0 THEN trunc(body * 33) ELSE 0 END
  + CASE WHEN place > 0.8 THEN 20 WHEN place > 0.5 THEN trunc(place * 20) ELSE trunc(place * 10) END
  + CASE WHEN trend10 IS NULL THEN 0 WHEN trend10 > 5 THEN 20 WHEN trend10 > 0 THEN trunc(10 + trend10 * 2)
         WHEN trend10 > -5 THEN trunc(5 + trend10) ELSE 0 END AS fit
FROM (SELECT *, (close - hi_40) / hi_40 * 100 AS gap, (close - open) / span AS body, (close - low) / span AS place
      FROM (SELECT *, CASE WHEN high <> low THEN high - low ELSE 1 END AS span FROM frame))"""
RATING_SQL = "CASE WHEN fit >= 80 THEN 'EXCELLENT' WHEN fit >= 60 THEN 'GOOD' WHEN fit >= 40 THEN 'MODERATE' WHEN fit >= 20 THEN 'WEAK' ELSE 'POOR' END"


def fitted(spark, sf_dir):
    bars = frame(spark, sf_dir).select("symbol", "ts", "rn", "open", "high", "low", "close", "hi_40", "lo_16", "trend10")
    return bars.withColumn("fit", sig.candle_fit(F.col("hi_40"), F.col("trend10")))


@query("candle_fit", FRAME, f"SELECT symbol, ts, CAST(fit AS INT) AS fit, {RATING_SQL} AS rating FROM ({FIT_SQL})")
def candle_fit(spark, sf_dir):
    return fitted(spark, sf_dir).select("symbol", "ts", "fit", sig.fit_rating(F.col("fit")).alias("rating"))


@query("recent_signal_summary", FRAME, f"""
SELECT symbol, count(*) FILTER (WHERE high > hi_40) AS breakouts, count(*) FILTER (WHERE low < lo_16) AS exits,
  {r('avg(fit)', 'avg_fit')}, CAST(max_by(fit, rn) AS INT) AS current_fit
FROM (SELECT * FROM ({FIT_SQL}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) <= 100) GROUP BY symbol""")
def recent_signal_summary(spark, sf_dir):
    """Counts and mean score over the latest 100 bars of each symbol."""
    bars = fitted(spark, sf_dir)
    last = bars.groupBy("symbol").agg(F.max("rn").alias("top"))
    recent = bars.join(last, "symbol").where(F.col("rn") > F.col("top") - 100)
    return recent.groupBy("symbol").agg(
        F.count_if(F.col("high") > F.col("hi_40")).alias("breakouts"),
        F.count_if(F.col("low") < F.col("lo_16")).alias("exits"),
        rounded(F.avg("fit"), "avg_fit"),
        F.max_by("fit", "rn").alias("current_fit"),
    )


@query("unit_sizes", FRAME, f"""
SELECT symbol, ts, {r('CASE WHEN atr_20 * 2 <= 0 THEN 0 ELSE greatest(0.001, round_even(100000 * 0.01 / (atr_20 * 2) / 0.001, 0) * 0.001) END', 'lots')},
  {r('CASE WHEN capped * close > 10 THEN capped ELSE 0 END', 'capped')}, {r('least(greatest(capped, 0.0001), 0.1)', 'clamped')}
FROM (SELECT *, least(100000 * 0.01 / (3.5 * atr_14), 100000 * 0.25 / close) AS capped FROM frame WHERE atr_20 IS NOT NULL)""")
def unit_sizes(spark, sf_dir):
    equity, risk = F.lit(100000.0), F.lit(1.0)
    bars = frame(spark, sf_dir).where(F.col("atr_20").isNotNull())
    raw = F.least(equity * 0.01 / (3.5 * F.col("atr_14")), equity * 0.25 / F.col("close"))
    return bars.select(
        "symbol", "ts",
        rounded(sig.unit_size(equity, F.col("atr_20"), risk, F.lit(2.0), F.lit(0.001)), "lots"),
        rounded(sig.capped_size(equity, F.col("atr_14"), risk, F.lit(3.5), F.col("close")), "capped"),
        rounded(F.least(F.greatest(raw, F.lit(0.0001)), F.lit(0.1)), "clamped"),
    )


@query("volatility_scale", FRAME, f"""
SELECT symbol, ts, {r('CASE WHEN vol50 > 0 THEN least(greatest(0.02 / vol50, 0.5), 2.0) ELSE 1 END', 'scale')} FROM frame""")
def volatility_scale(spark, sf_dir):
    return frame(spark, sf_dir).select("symbol", "ts", rounded(sig.volatility_scale(F.col("vol50")), "scale"))


MODE_SQL = """CASE WHEN ratio200 > 1.05 THEN 'Bull' WHEN ratio200 < 0.9 AND slope30 < -0.02 THEN 'Severe Bear'
     WHEN ratio200 < 1 THEN 'Mild Bear' ELSE 'Normal' END"""


@query("mode_sizes", FRAME, f"""
SELECT symbol, ts, mode, {r("CASE mode WHEN 'Severe Bear' THEN 0 WHEN 'Mild Bear' THEN 0.5 ELSE 1 END", 'size')}
FROM (SELECT *, {MODE_SQL} AS mode FROM frame)""")
def mode_sizes(spark, sf_dir):
    bars = frame(spark, sf_dir).withColumn("mode", reg.market_mode())
    return bars.select("symbol", "ts", "mode", rounded(reg.mode_size(F.col("mode")), "size"))


@query("execution_costs", DAILY, f"""
SELECT symbol, ts, {r('close * 1.0013', 'buy_long')}, {r('close * 0.9987', 'sell_long')}, {r('close * 0.9987', 'sell_short')},
       {r('close * 1.0013', 'cover_short')}, {r('close * 1.0005', 'slipped_buy')} FROM daily""")
def execution_costs(spark, sf_dir):
    cost, long, short = F.lit(0.13), F.lit("long"), F.lit("short")
    close = F.col("close")
    return daily(spark, sf_dir).select(
        "symbol", "ts", rounded(sig.fill_price(close, long, yes(), cost), "buy_long"),
        rounded(sig.fill_price(close, long, no(), cost), "sell_long"),
        rounded(sig.fill_price(close, short, yes(), cost), "sell_short"),
        rounded(sig.fill_price(close, short, no(), cost), "cover_short"),
        rounded(sig.fill_price(close, long, yes(), F.lit(0.05)), "slipped_buy"),
    )
