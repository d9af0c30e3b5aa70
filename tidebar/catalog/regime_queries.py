"""Regime labels and the statistics of their sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.inputs import DAY, FRAME, frame
from tidebar.catalog.registry import cte, query, r, rcols, rounded
from tidebar.catalog.signal_queries import MODE_SQL, TREND_REGIME_SQL
from tidebar.functions import regimes as reg
from tidebar.operators.percentiles import percentiles
from tidebar.operators.windows import framed, running, runs, time_slice
from tidebar.session import Marts

KEY = ["symbol"]


@query("volatility_regimes", FRAME, """
SELECT symbol, ts, CASE WHEN vol_ann > cut THEN 'High Volatility' WHEN sma50 < sma200 AND ret180 >= -0.1 AND ret180 < 0 THEN 'Mild Bear'
  WHEN sma50 < sma200 AND ret180 < -0.1 THEN 'Strong Bear' WHEN sma50 > sma200 AND ret180 <= 0.1 AND ret180 > 0 THEN 'Mild Bull'
  WHEN sma50 > sma200 AND ret180 > 0.1 THEN 'Strong Bull' ELSE 'Neutral' END AS regime
FROM frame JOIN (SELECT symbol, quantile_cont(vol_ann, 0.8) AS cut FROM frame GROUP BY symbol) USING (symbol)""")
def volatility_regimes(spark, sf_dir):
    return _volatility(spark, sf_dir)


def _volatility(spark, sf_dir):
    """Volatility labels of all bars, written once: joins over time read them more than once."""

    def crossed():
        return frame(spark, sf_dir, ema=False).select("symbol", "ts", "vol_ann", reg.crossing_regime().alias("crossing"))

    def build():
        bars = Marts.table(spark, sf_dir, "volatility", crossed)
        cut = percentiles(bars, KEY, "vol_ann", {"cut": 0.8})
        return bars.join(cut, "symbol", "left").select("symbol", "ts", reg.volatility_regime(F.col("cut"), F.col("crossing")).alias("regime"))

    return Marts.table(spark, sf_dir, "volatility_regime", build)


cte("cycle", """
SELECT symbol, ts, rn, close, CASE WHEN ret180 < -0.3 AND fall < -0.5 THEN 'Capitulation' WHEN ret180 > 0.4 AND close > sma200 * 1.5 THEN 'Euphoria'
  WHEN close > sma200 AND ret180 > 0.15 AND fall > -0.1 THEN 'Strong Bull' WHEN close > sma200 AND ret180 > 0 AND ret180 <= 0.15 THEN 'Mild Bull'
  WHEN close < sma200 AND ret180 < -0.15 AND fall < -0.3 THEN 'Strong Bear' WHEN close < sma200 AND ret180 < 0 AND ret180 >= -0.15 THEN 'Mild Bear'
  WHEN close < sma200 AND ret180 > 0.05 THEN 'Recovery' WHEN abs(close / sma200 - 1) < 0.1 AND abs(ret180) < 0.1 THEN 'Consolidation'
  ELSE 'Neutral' END AS regime
FROM (SELECT *, close / max(close) OVER (PARTITION BY symbol ORDER BY rn) - 1 AS fall FROM frame)""")
CYCLE = f"{FRAME} cycle"


def cycle(spark, sf_dir):
    """Cycle labels of all bars, written once: runs, shares and transitions all read it."""

    def build():
        bars = frame(spark, sf_dir, ema=False).select("symbol", "ts", "rn", "close", "sma200", "ret180")
        high = running(bars, KEY, ["ts"], time_slice("ts", DAY), {"ath": ("max", F.col("close"))})
        return high.select("symbol", "ts", "rn", "close", reg.cycle_regime(F.col("close") / F.col("ath") - 1).alias("regime"))

    return Marts.table(spark, sf_dir, "cycle", build)


@query("cycle_regimes", CYCLE, "SELECT symbol, ts, regime FROM cycle")
def cycle_regimes(spark, sf_dir):
    return cycle(spark, sf_dir).select("symbol", "ts", "regime")


@query("trend_regimes", FRAME, f"SELECT symbol, ts, {TREND_REGIME_SQL} AS regime FROM frame")
def trend_regimes(spark, sf_dir):
    return frame(spark, sf_dir, ema=False).select("symbol", "ts", reg.trend_regime().alias("regime"))


@query("market_modes", FRAME, f"SELECT symbol, ts, {MODE_SQL} AS mode FROM frame")
def market_modes(spark, sf_dir):
    return frame(spark, sf_dir, ema=False).select("symbol", "ts", reg.market_mode().alias("mode"))


def regime_runs(spark, sf_dir):
    numbered = runs(cycle(spark, sf_dir), KEY, ["ts"], time_slice("ts", DAY), F.col("regime"))
    return numbered.groupBy("symbol", "run_id", "regime").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("start"), F.max("ts").alias("end")
    )


cte("regime_run", """
SELECT symbol, run_id, regime, count(*) AS bars, min(ts) AS start, max(ts) AS "end" FROM (
  SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY rn) AS run_id FROM (
    SELECT *, CASE WHEN regime = lag(regime) OVER (PARTITION BY symbol ORDER BY rn) THEN 0 ELSE 1 END AS step FROM cycle))
GROUP BY symbol, run_id, regime""")


@query("regime_runs", f"{CYCLE} regime_run", """SELECT symbol, CAST(run_id AS BIGINT) AS run_id, regime, bars, start, "end" FROM regime_run""")
def regime_run_rows(spark, sf_dir):
    return regime_runs(spark, sf_dir)


@query("regime_durations", f"{CYCLE} regime_run", f"""
SELECT regime, {r('avg(bars / 6.0)', 'mean_days')}, {r('stddev_samp(bars / 6.0)', 'std_days')}, {r('min(bars / 6.0)', 'min_days')},
       {r('max(bars / 6.0)', 'max_days')}, count(*) AS runs FROM regime_run GROUP BY regime""")
def regime_durations(spark, sf_dir):
    days = F.col("bars") / 6
    stats = regime_runs(spark, sf_dir).groupBy("regime").agg(
        F.avg(days).alias("mean_days"), F.stddev_samp(days).alias("std_days"), F.min(days).alias("min_days"),
        F.max(days).alias("max_days"), F.count(F.lit(1)).alias("runs"),
    )
    return stats.select("regime", *rcols("mean_days std_days min_days max_days"), "runs")


@query("regime_shares", CYCLE, f"""
SELECT symbol, regime, count(*) AS bars, {r('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY symbol)', 'share_pct')}, {r('count(*) / 6.0', 'days')}
FROM cycle GROUP BY symbol, regime""")
def regime_shares(spark, sf_dir):
    from pyspark.sql import Window

    counted = cycle(spark, sf_dir).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("bars"))
    total = F.sum("bars").over(Window.partitionBy("symbol"))
    return counted.select(
        "symbol", "regime", "bars", rounded(F.col("bars") * 100.0 / total, "share_pct"), rounded(F.col("bars") / 6, "days")
    )


def transitions(spark, sf_dir):
    """Counts of label changes from bar to bar, self-loops included; at most 81 rows."""
    steps = framed(cycle(spark, sf_dir), KEY, lambda w: {"next": F.lead("regime").over(w)}, 0, ahead=1)
    return steps.where(F.col("next").isNotNull()).groupBy(F.col("regime").alias("source"), F.col("next").alias("target")).agg(
        F.count(F.lit(1)).alias("steps")
    )


cte("transition", """
SELECT regime AS source, next AS target, count(*) AS steps
FROM (SELECT regime, lead(regime) OVER (PARTITION BY symbol ORDER BY rn) AS next FROM cycle) WHERE next IS NOT NULL GROUP BY 1, 2""")


@query("regime_transitions", f"{CYCLE} transition", f"""
SELECT source, target, steps, {r('steps / sum(steps) OVER (PARTITION BY source)', 'share')} FROM transition""")
def regime_transitions(spark, sf_dir):
    from pyspark.sql import Window

    counted = transitions(spark, sf_dir)
    return counted.select("source", "target", "steps", rounded(F.col("steps") / F.sum("steps").over(Window.partitionBy("source")), "share"))


LABELS = ["Strong Bull", "Mild Bull", "Euphoria", "Consolidation", "Neutral", "Recovery", "Mild Bear", "Strong Bear", "Capitulation"]  # fixed values


@query("transition_matrix", f"{CYCLE} transition", "SELECT source, " + ", ".join(
    f"coalesce(max(steps) FILTER (WHERE target = '{x}'), 0) AS {x.lower().replace(' ', '_')}" for x in LABELS) + " FROM transition GROUP BY source")
def transition_matrix(spark, sf_dir):
    wide = transitions(spark, sf_dir).groupBy("source").pivot("target", LABELS).agg(F.first("steps")).na.fill(0)
    return wide.select("source", *[F.col(f"`{x}`").alias(x.lower().replace(" ", "_")) for x in LABELS])


@query("transition_rows_sum_to_one", f"{CYCLE} transition", """
SELECT source, abs(sum(share) - 1) < 1e-9 AS sums_to_one, max(regimes) >= 5 AS enough_regimes FROM (
  SELECT source, steps / sum(steps) OVER (PARTITION BY source) AS share, (SELECT count(DISTINCT source) FROM transition) AS regimes FROM transition)
GROUP BY source""")
def transition_rows_sum_to_one(spark, sf_dir):
    from pyspark.sql import Window

    counted = transitions(spark, sf_dir)
    shares = counted.withColumn("share", F.col("steps") / F.sum("steps").over(Window.partitionBy("source")))
    sums = shares.groupBy("source").agg((F.abs(F.sum("share") - 1) < 1e-9).alias("sums_to_one"))
    total = sums.agg(F.count(F.lit(1)).alias("regimes")).withColumn("k", F.lit(1))
    return sums.withColumn("k", F.lit(1)).join(total, "k").select("source", "sums_to_one", (F.col("regimes") >= 5).alias("enough_regimes"))
