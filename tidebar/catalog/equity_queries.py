"""Equity curve statistics, drawdown episodes, stalls and period returns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.inputs import DAILY, FRAME, daily
from tidebar.catalog.ledger_queries import LEDGER
from tidebar.catalog.registry import cte, query, r, rcols, rounded, rs
from tidebar.catalog.replay_queries import RULES, equity, trades
from tidebar.operators.joins import within
from tidebar.operators.sliding import Slide, sliding
from tidebar.operators.windows import framed
from tidebar.plans import equity as eq
from tidebar.plans import ledger as led
from tidebar.session import Marts

KEY = ["symbol"]
BARS = 365.0  # daily bars in a year

for _name in RULES:
    cte(f"{_name}_curve", f"""
SELECT *, (equity - peak) / peak AS dd, (equity - previous) / nullif(previous, 0) AS ret, coalesce(equity > peak_before, false) AS new_high
FROM (SELECT *, max(equity) OVER w AS peak, lag(equity) OVER w AS previous,
             max(equity) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak_before
      FROM {_name}_equity WINDOW w AS (PARTITION BY symbol ORDER BY rn))""")
CURVE = f"{FRAME} breakout_state breakout_last breakout_equity breakout_curve"


def curve(spark, sf_dir, name="breakout"):
    return Marts.table(spark, sf_dir, f"curve_{name}", lambda: eq.underwater(equity(spark, sf_dir, name), KEY))


@query("underwater_curve", CURVE, f"SELECT symbol, ts, {r('peak', digits=4)}, {rs('dd ret', 8)}, new_high FROM breakout_curve")
def underwater_curve(spark, sf_dir):
    return curve(spark, sf_dir).select("symbol", "ts", rounded("peak", digits=4), *rcols("dd ret", 8), "new_high")


cte("episode", """
SELECT symbol, g, min(ts) FILTER (WHERE dd < 0) AS start, max(ts) FILTER (WHERE dd >= 0) AS recovery, count(*) FILTER (WHERE dd < 0) AS bars, min(dd) AS depth FROM (
  SELECT symbol, ts, dd, count(*) FILTER (WHERE dd >= 0) OVER (PARTITION BY symbol ORDER BY rn) - CASE WHEN dd >= 0 THEN 1 ELSE 0 END AS g FROM breakout_curve)
GROUP BY 1, 2 HAVING count(*) FILTER (WHERE dd < 0) > 0""")


@query("drawdown_episodes", f"{CURVE} episode", f"""
SELECT symbol, start, recovery, bars, {r('depth', digits=8)}, {r('epoch(recovery - start) / 86400', 'days')} FROM episode""")
def drawdown_episodes(spark, sf_dir):
    return eq.drawdown_episodes(curve(spark, sf_dir), KEY).select("symbol", "start", "recovery", "bars", rounded("depth", digits=8), *rcols("days"))


@query("recovery_times", f"{CURVE} episode", f"""
SELECT symbol, {r('coalesce(avg(epoch(recovery - start) / 86400), 0)', 'avg_days')}, {r('coalesce(max(epoch(recovery - start) / 86400), 0)', 'max_days')} FROM episode GROUP BY symbol""")
def recovery_times(spark, sf_dir):
    times = eq.drawdown_episodes(curve(spark, sf_dir), KEY).groupBy("symbol").agg(
        F.coalesce(F.avg("days"), F.lit(0.0)).alias("avg_days"), F.coalesce(F.max("days"), F.lit(0.0)).alias("max_days")
    )
    return times.select("symbol", *rcols("avg_days max_days"))


@query("longest_drawdown", f"{CURVE} episode", f"SELECT symbol, max(bars) AS bars, {r('max(bars) / 6.0', 'days')} FROM episode GROUP BY symbol")
def longest_drawdown(spark, sf_dir):
    longest = eq.drawdown_episodes(curve(spark, sf_dir), KEY).groupBy("symbol").agg(F.max("bars").alias("bars"))
    return longest.select("symbol", "bars", rounded(F.col("bars") / 6, "days"))


@query("deep_drawdowns", CURVE, f"""
SELECT symbol, start, coalesce(recovery, last) AS "end", recovery, {r('depth', 'max_drawdown')}, bottom, CAST(date_diff('day', start, coalesce(recovery, last)) AS BIGINT) AS days,
  {rs('equity_at_start equity_at_bottom', 4)} FROM (
  SELECT symbol, g, min(ts) FILTER (WHERE deep) AS start, max(ts) FILTER (WHERE deep) AS last, max(ts) FILTER (WHERE NOT deep) AS recovery, min(dd) FILTER (WHERE deep) * 100 AS depth,
    first(ts ORDER BY dd, ts) FILTER (WHERE deep) AS bottom, first(equity ORDER BY ts) FILTER (WHERE deep) AS equity_at_start, first(equity ORDER BY dd, ts) FILTER (WHERE deep) AS equity_at_bottom
  FROM (SELECT *, count(*) FILTER (WHERE NOT deep) OVER (PARTITION BY symbol ORDER BY rn) - CASE WHEN deep THEN 0 ELSE 1 END AS g FROM (
    SELECT *, dd * 100 < -5 AS deep FROM breakout_curve)) GROUP BY 1, 2 HAVING count(*) FILTER (WHERE deep) > 0)""")
def deep_drawdowns(spark, sf_dir):
    found = eq.deep_drawdowns(curve(spark, sf_dir), KEY)
    return found.select("symbol", "start", "end", "recovery", *rcols("max_drawdown"), "bottom", "days", *rcols("equity_at_start equity_at_bottom", 4))


cte("stall", """
SELECT symbol, start, coalesce(next, last) AS "end", CAST(date_diff('day', start, coalesce(next, last)) AS BIGINT) AS days, equity_at_start,
  coalesce(next_equity, last_equity) AS equity_at_end, min_equity, (min_equity / equity_at_start - 1) * 100 AS max_drawdown_pct FROM (
  SELECT *, lead(start) OVER (PARTITION BY symbol ORDER BY g) AS next, lead(equity_at_start) OVER (PARTITION BY symbol ORDER BY g) AS next_equity FROM (
    SELECT symbol, g, min(ts) AS start, max(ts) AS last, count(*) FILTER (WHERE NOT new_high) AS quiet, first(equity ORDER BY rn) AS equity_at_start,
           first(equity ORDER BY rn DESC) AS last_equity, min(equity) AS min_equity
    FROM (SELECT *, count(*) FILTER (WHERE new_high) OVER (PARTITION BY symbol ORDER BY rn) AS g FROM breakout_curve) GROUP BY 1, 2))
WHERE quiet > 0 AND date_diff('day', start, coalesce(next, last)) >= 60""")
STALL = f"{CURVE} stall"


@query("stalling_periods", STALL, f"""SELECT symbol, start, "end", days, {rs('equity_at_start equity_at_end min_equity', 4)}, {r('max_drawdown_pct')} FROM stall""")
def stalling_periods(spark, sf_dir):
    found = eq.stalls(curve(spark, sf_dir), KEY)
    return found.select("symbol", "start", "end", "days", *rcols("equity_at_start equity_at_end min_equity", 4), *rcols("max_drawdown_pct"))


STALL_TRADES = f"{LEDGER} breakout_equity breakout_curve stall"


@query("trades_in_stalls", STALL_TRADES, f"""
SELECT l.symbol, trade_id, start AS stall_start, entry_time, {r('pnl', digits=4)} FROM breakout_ledger l JOIN stall s ON l.symbol = s.symbol AND entry_time BETWEEN start AND "end" """)
def trades_in_stalls(spark, sf_dir):
    pairs = _stalled(spark, sf_dir)
    return pairs.select("symbol", "trade_id", F.col("start").alias("stall_start"), "entry_time", rounded("pnl", digits=4))


def _stalled(spark, sf_dir):
    spans = eq.stalls(curve(spark, sf_dir), KEY).select("symbol", "start", "end")
    return within(trades(spark, sf_dir), spans, KEY, "entry_time", "start", "end")


@query("stall_trade_stats", STALL_TRADES, f"""
SELECT count(*) AS trades, {r('count(*) FILTER (WHERE pnl > 0) * 100.0 / count(*)', 'win_rate')}, {r('sum(pnl)', 'total_pnl', 4)}, {r('avg(pnl)', 'avg_pnl', 4)}
FROM breakout_ledger l JOIN stall s ON l.symbol = s.symbol AND entry_time BETWEEN start AND "end" """)
def stall_trade_stats(spark, sf_dir):
    count = F.count(F.lit(1))
    stats = _stalled(spark, sf_dir).agg(
        count.alias("trades"), (F.count_if(led.won()) * 100.0 / count).alias("win_rate"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl")
    )
    return stats.select("trades", *rcols("win_rate"), *rcols("total_pnl avg_pnl", 4))


@query("stall_share", STALL, f"""
SELECT symbol, CAST(coalesce(sum(s.days), 0) AS BIGINT) AS stall_days, {r('coalesce(sum(s.days), 0) * 100.0 / max(total)', 'share_pct')}
FROM (SELECT symbol, date_diff('day', min(ts), max(ts)) AS total FROM breakout_curve GROUP BY symbol) LEFT JOIN stall s USING (symbol) GROUP BY symbol""")
def stall_share(spark, sf_dir):
    found = curve(spark, sf_dir)
    total = found.groupBy("symbol").agg(F.timestamp_diff("DAY", F.min("ts"), F.max("ts")).alias("total"))
    stalled = eq.stalls(found, KEY).groupBy("symbol").agg(F.sum("days").alias("stall_days"))
    both = total.join(stalled, "symbol", "left").na.fill(0, ["stall_days"])
    return both.select("symbol", "stall_days", rounded(F.col("stall_days") * 100.0 / F.col("total"), "share_pct"))


STATS = "total_return_pct cagr_pct max_drawdown_pct sharpe sortino calmar volatility_pct avg_recovery_days max_recovery_days"


def stats_cte(name: str, keys: str = "symbol", curve_name: str = "breakout_curve", episode: str = "episode", capital: int = 100000) -> None:
    """SQL twin of equity_stats."""
    cte(name, f"""
SELECT *, coalesce(growth / nullif(abs(depth), 0), 0) AS calmar, growth * 100 AS cagr_pct, depth * 100 AS max_drawdown_pct, total * 100 AS total_return_pct FROM (
  SELECT *, pow(1 + total, 365.0::DOUBLE / bars) - 1 AS growth FROM (
    SELECT {keys}, arg_max(equity, rn) AS final_equity, arg_max(equity, rn) / {capital} - 1 AS total, count(*) AS bars, min(dd) AS depth,
      coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365), 0) AS sharpe,
      coalesce(avg(ret) / nullif(stddev_samp(ret) FILTER (WHERE ret < 0), 0) * sqrt(365), 0) AS sortino, stddev_samp(ret) * sqrt(365) * 100 AS volatility_pct
    FROM {curve_name} GROUP BY {keys}))
LEFT JOIN (SELECT {keys}, avg(epoch(recovery - start) / 86400) AS avg_r, max(epoch(recovery - start) / 86400) AS max_r FROM {episode} GROUP BY {keys}) USING ({keys})""")


stats_cte("equity_stat")
STATS_SQL = ", ".join(
    [r(c) for c in "total_return_pct cagr_pct max_drawdown_pct sharpe sortino calmar volatility_pct".split()]
    + [r("coalesce(avg_r, 0)", "avg_recovery_days"), r("coalesce(max_r, 0)", "max_recovery_days")]
)
EQUITY_STATS = f"{CURVE} episode equity_stat"


def stats(spark, sf_dir):
    return eq.equity_stats(curve(spark, sf_dir), KEY, 100_000.0, BARS)


@query("equity_stats", EQUITY_STATS, f"SELECT symbol, {r('final_equity', digits=4)}, bars, {STATS_SQL} FROM equity_stat")
def equity_stats(spark, sf_dir):
    return stats(spark, sf_dir).select("symbol", rounded("final_equity", digits=4), "bars", *rcols(STATS))


@query("return_moments", CURVE, f"""
SELECT symbol, {r('avg(ret)', 'mean', 8)}, {r('stddev_samp(ret)', 'std', 8)}, {r('stddev_samp(ret) FILTER (WHERE ret < 0)', 'down_std', 8)},
  {', '.join(r(f'coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt({n}), 0)', f'sharpe_{n}') for n in (8760, 2190, 1512))} FROM breakout_curve GROUP BY symbol""")
def return_moments(spark, sf_dir):
    spread = F.stddev_samp("ret")
    down = F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret")))
    sharpe = [
        rounded(F.coalesce(led.ratio(F.avg("ret"), spread) * F.sqrt(F.lit(float(n))), F.lit(0.0)), f"sharpe_{n}") for n in (8760, 2190, 1512)
    ]
    return curve(spark, sf_dir).groupBy("symbol").agg(
        rounded(F.avg("ret"), "mean", 8), rounded(spread, "std", 8), rounded(down, "down_std", 8), *sharpe
    )


@query("rolling_sharpe", CURVE, f"""
SELECT symbol, ts, {r('CASE WHEN count(ret) OVER w = 252 AND stddev_samp(ret) OVER w > 1e-12 THEN avg(ret) OVER w / stddev_samp(ret) OVER w * sqrt(252) END', 'sharpe')}
FROM breakout_curve WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS 251 PRECEDING)""")
def rolling_sharpe(spark, sf_dir):
    def build(_):
        return {"sharpe": F.when(F.col("__spread") > 1e-12, F.col("__mean") / F.col("__spread") * F.sqrt(F.lit(252.0)))}

    moments = sliding({"__mean": Slide("avg", "ret", 252), "__spread": Slide("stddev_samp", "ret", 252)})
    bars = framed(curve(spark, sf_dir).select("symbol", "ts", "rn", "ret"), KEY, [*moments, build], 252)
    return bars.select("symbol", "ts", *rcols("sharpe"))


@query("benchmark_curve", CURVE, f"""
SELECT symbol, ts, {r('close / first_value(close) OVER w * first_value(equity) OVER w', 'benchmark', 4)} FROM breakout_curve WINDOW w AS (PARTITION BY symbol ORDER BY rn)""")
def benchmark_curve(spark, sf_dir):
    return eq.benchmark_curve(curve(spark, sf_dir), KEY).select("symbol", "ts", rounded("benchmark", digits=4))


def _period(unit: str) -> str:
    return f"""SELECT symbol, period, equity, equity - lag(equity) OVER (PARTITION BY symbol ORDER BY period) AS diff,
  equity / nullif(lag(equity) OVER (PARTITION BY symbol ORDER BY period), 0) - 1 AS ret FROM (
  SELECT symbol, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS period, arg_max(equity, ts) AS equity FROM breakout_curve GROUP BY 1, 2)"""


UNITS = ("day", "month", "quarter", "year")


@query("period_returns", CURVE, " UNION ALL ".join(
    f"SELECT symbol, '{u}' AS unit, period, {r('equity', digits=4)}, {r('diff', digits=4)}, {r('ret')} FROM ({_period(u)})" for u in UNITS))
def period_returns(spark, sf_dir):
    parts = [
        eq.period_equity(curve(spark, sf_dir), KEY, u).select(
            "symbol", F.lit(u).alias("unit"), "period", *rcols("equity diff", 4), *rcols("ret")
        )
        for u in UNITS
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("worst_periods", CURVE, "SELECT symbol, " + ", ".join(r(f"worst_{u}") for u in UNITS[1:]) + " FROM " + " JOIN ".join(
    f"(SELECT symbol, min(ret) * 100 AS worst_{u} FROM ({_period(u)}) GROUP BY symbol)" + (" USING (symbol)" if u != "month" else "") for u in UNITS[1:]))
def worst_periods(spark, sf_dir):
    worst = None
    for u in UNITS[1:]:
        part = eq.period_equity(curve(spark, sf_dir), KEY, u).groupBy("symbol").agg(rounded(F.min("ret") * 100, f"worst_{u}"))
        worst = part if worst is None else worst.join(part, "symbol")
    return worst


@query("daily_volatility", CURVE, f"SELECT symbol, {r('stddev_samp(ret) * sqrt(365) * 100', 'volatility_pct')} FROM ({_period('day')}) GROUP BY symbol")
def daily_volatility(spark, sf_dir):
    days = eq.period_equity(curve(spark, sf_dir), KEY, "day")
    return days.groupBy("symbol").agg(rounded(F.stddev_samp("ret") * F.sqrt(F.lit(365.0)) * 100, "volatility_pct"))


@query("drawdown_indices", CURVE, f"""
SELECT symbol, {r('avg(CASE WHEN dd < 0 THEN 1.0 ELSE 0 END) * 100', 'time_underwater_pct')}, {r('sqrt(avg(dd * dd)) * 100', 'ulcer_index')}, {r('abs(avg(dd)) * 100', 'pain_index')}
FROM breakout_curve GROUP BY symbol""")
def drawdown_indices(spark, sf_dir):
    return eq.drawdown_indices(curve(spark, sf_dir), KEY).select("symbol", *rcols("time_underwater_pct ulcer_index pain_index"))


@query("drawdown_values", CURVE, f"""
SELECT symbol, {r('abs(min(dd) * first(peak ORDER BY dd, rn))', 'max_drawdown_value', 4)}, {r('abs(avg(dd) FILTER (WHERE dd < 0)) * 100', 'avg_drawdown_pct')},
  {r('max(equity) - 100000', 'max_runup', 4)}, {r('(max(equity) / 100000 - 1) * 100', 'max_runup_pct')} FROM breakout_curve GROUP BY symbol""")
def drawdown_values(spark, sf_dir):
    values = eq.drawdown_values(curve(spark, sf_dir), KEY, 100_000.0)
    return values.select("symbol", *rcols("max_drawdown_value max_runup", 4), *rcols("avg_drawdown_pct max_runup_pct"))


@query("stress_test", EQUITY_STATS, f"""
SELECT symbol, {r('100000 * (1 + total_return_pct * 0.5 / 100)', 'stress_equity', 4)}, {r('abs(max_drawdown_pct) * 1.5', 'stress_drawdown_pct')},
  100000 * (1 + total_return_pct * 0.5 / 100) > 50000 AND abs(max_drawdown_pct) * 1.5 < 80 AS survives FROM equity_stat""")
def stress_test(spark, sf_dir):
    tested = eq.stress(stats(spark, sf_dir), 100_000.0)
    return tested.select("symbol", rounded("stress_equity", digits=4), *rcols("stress_drawdown_pct"), "survives")


@query("buy_and_hold", DAILY, f"""
SELECT symbol, {r('(arg_max(close, ts) / arg_min(close, ts) - 1) * 100000', 'hold_value', 4)}, {r('(arg_max(close, ts) / arg_min(close, ts) - 1) * 100', 'hold_pct')} FROM daily GROUP BY symbol""")
def buy_and_hold(spark, sf_dir):
    held = eq.buy_and_hold(daily(spark, sf_dir), KEY, 100_000.0)
    return held.select("symbol", rounded("hold_value", digits=4), *rcols("hold_pct"))


@query("trades_per_day", f"{LEDGER} breakout_equity breakout_curve", f"""
SELECT symbol, {r('coalesce(n, 0) * 1.0 / days', 'trades_per_day')} FROM (SELECT symbol, date_diff('day', min(ts), max(ts)) AS days FROM breakout_curve GROUP BY symbol)
LEFT JOIN (SELECT symbol, count(*) AS n FROM breakout_ledger GROUP BY symbol) USING (symbol)""")
def trades_per_day(spark, sf_dir):
    span = curve(spark, sf_dir).groupBy("symbol").agg(F.timestamp_diff("DAY", F.min("ts"), F.max("ts")).alias("days"))
    made = trades(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    both = span.join(made, "symbol", "left").na.fill(0, ["n"])
    return both.select("symbol", rounded(F.col("n") / F.col("days"), "trades_per_day"))


@query("annual_summary", CURVE, f"""
SELECT symbol, {r('avg(ret) * 100', 'avg_annual_pct')}, count(*) FILTER (WHERE ret > 0) AS winning_years, count(*) FILTER (WHERE ret < 0) AS losing_years
FROM ({_period('year')}) WHERE ret IS NOT NULL GROUP BY symbol""")
def annual_summary(spark, sf_dir):
    years = eq.period_equity(curve(spark, sf_dir), KEY, "year").where(F.col("ret").isNotNull())
    return years.groupBy("symbol").agg(
        rounded(F.avg("ret") * 100, "avg_annual_pct"), F.count_if(F.col("ret") > 0).alias("winning_years"), F.count_if(F.col("ret") < 0).alias("losing_years")
    )


@query("drawdown_size_cut", CURVE, f"SELECT symbol, ts, {r('CASE WHEN (peak - equity) / peak > 0.15 THEN 0.5 ELSE 1 END', 'scale')} FROM breakout_curve")
def drawdown_size_cut(spark, sf_dir):
    from tidebar.functions.signals import drawdown_scale

    return curve(spark, sf_dir).select("symbol", "ts", rounded(drawdown_scale(F.col("equity"), F.col("peak")), "scale"))


@query("loss_limits", CURVE, f"""
SELECT symbol, period, {r('ret')}, {r('dd')}, CASE WHEN dd < -0.3 THEN 'stop' WHEN dd < -0.2 THEN 'halve' WHEN week_ret < -0.1 THEN 'pause week' WHEN ret < -0.05 THEN 'pause day' ELSE 'trade' END AS action
FROM (SELECT p.*, c.dd, p.equity / nullif(lag(p.equity, 7) OVER (PARTITION BY p.symbol ORDER BY p.period), 0) - 1 AS week_ret FROM ({_period('day')}) p
  JOIN (SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, arg_max(dd, ts) AS dd FROM breakout_curve GROUP BY 1, 2) c USING (symbol, period))""")
def loss_limits(spark, sf_dir):
    """Daily -5 %, weekly -10 %, drawdown -20 % and -30 % limits on the last equity of each day."""
    bars = framed(
        curve(spark, sf_dir).select("symbol", "ts", "rn", "equity", "dd", "ret"),
        KEY,
        lambda w: {"week_ret": led.ratio(F.col("equity") - F.lag("equity", 7).over(w), F.lag("equity", 7).over(w))},
        7,
    )
    action = (
        F.when(F.col("dd") < -0.3, "stop").when(F.col("dd") < -0.2, "halve").when(F.col("week_ret") < -0.1, "pause week")
        .when(F.col("ret") < -0.05, "pause day").otherwise("trade")
    )
    return bars.select("symbol", F.col("ts").alias("period"), *rcols("ret dd"), action.alias("action"))
