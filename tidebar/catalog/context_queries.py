"""Time joins, regimes at entry, calendar regimes, resampling and the second asset."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.equity_queries import CURVE, curve, stats, stats_cte
from tidebar.catalog.inputs import DAILY, DAY, _roll, daily, read
from tidebar.catalog.ledger_queries import LEDGER
from tidebar.catalog.regime_queries import _volatility, cycle
from tidebar.catalog.registry import cte, query, r, rcols, rounded, rs
from tidebar.catalog.replay_queries import breakout_body, ledger_ctes, state_cte, trades
from tidebar.functions.rules import breakout_rules
from tidebar.operators.joins import asof, nearest
from tidebar.operators.replay import trades_of
from tidebar.plans import calendar as cal
from tidebar.plans import crossasset as cross
from tidebar.plans import equity as eq
from tidebar.plans import ledger as led
from tidebar.plans import resample as rs_
from tidebar.session import Marts
from tidebar.sources.bars import densify_linear

KEY = ["symbol"]

# ---- second asset: average order value per order date; it has gaps

cte("quotes", "SELECT CAST(o_orderdate AS TIMESTAMP) AS quote_ts, avg(o_totalprice) AS price FROM orders GROUP BY 1")


def quotes(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("date")).agg(F.avg("o_totalprice").alias("close"))


def _market(spark, sf_dir):
    return quotes(spark, sf_dir).select(F.lit(1).alias("market"), F.col("date").alias("quote_ts"), "close")


@query("asof_quote_at_entry", f"{LEDGER} quotes", f"""
SELECT l.symbol, l.trade_id, l.exit_time, q.quote_ts, {r('q.price', 'price', 4)} FROM breakout_ledger l ASOF LEFT JOIN quotes q ON l.exit_time + INTERVAL 10 HOUR >= q.quote_ts""")
def asof_quote_at_entry(spark, sf_dir):
    """Latest quote at or before ten hours after the exit day's start."""
    probes = trades(spark, sf_dir).withColumn("market", F.lit(1)).withColumn("at", F.col("exit_time") + F.expr("INTERVAL 10 HOUR"))
    found = asof(probes, _market(spark, sf_dir), ["market"], "at", "quote_ts", ["close"], tie=["symbol", "trade_id"], spread=16)
    return found.select("symbol", "trade_id", "exit_time", F.col("matched.quote_ts").alias("quote_ts"), rounded("matched.close", "price", 4))


@query("nearest_quote_at_entry", f"{LEDGER} quotes", """
SELECT symbol, trade_id, CASE WHEN after IS NULL OR (before IS NOT NULL AND probe - before <= after - probe) THEN before ELSE after END AS quote_ts FROM (
  SELECT l.symbol, l.trade_id, l.probe, b.quote_ts AS before, a.quote_ts AS after
  FROM (SELECT symbol, trade_id, entry_time + INTERVAL 13 HOUR AS probe FROM breakout_ledger) l
  ASOF LEFT JOIN quotes b ON l.probe >= b.quote_ts ASOF LEFT JOIN quotes a ON l.probe <= a.quote_ts)""")
def nearest_quote_at_entry(spark, sf_dir):
    probes = trades(spark, sf_dir).select("symbol", "trade_id", F.lit(1).alias("market"), (F.col("entry_time") + F.expr("INTERVAL 13 HOUR")).alias("at"))
    found = nearest(probes, _market(spark, sf_dir), ["market"], "at", "quote_ts", ["close"], tie=["symbol", "trade_id"], spread=16)
    return found.select("symbol", "trade_id", F.col("matched.quote_ts").alias("quote_ts"))


# ---- performance by regime at entry

VOLATILITY_SQL = """
SELECT symbol, ts, CASE WHEN vol_ann > cut THEN 'High Volatility' WHEN sma50 < sma200 AND ret180 >= -0.1 AND ret180 < 0 THEN 'Mild Bear'
  WHEN sma50 < sma200 AND ret180 < -0.1 THEN 'Strong Bear' WHEN sma50 > sma200 AND ret180 <= 0.1 AND ret180 > 0 THEN 'Mild Bull'
  WHEN sma50 > sma200 AND ret180 > 0.1 THEN 'Strong Bull' ELSE 'Neutral' END AS regime
FROM frame JOIN (SELECT symbol, quantile_cont(vol_ann, 0.8) AS cut FROM frame GROUP BY symbol) USING (symbol)"""
cte("volatility", VOLATILITY_SQL)


@query("performance_by_entry_regime", f"{LEDGER} volatility", f"""
SELECT coalesce(v.regime, 'Unknown') AS regime, count(*) AS trades, {r('sum(pnl)', 'total_pnl', 2)}, {r('avg(pnl)', 'avg_pnl', 2)}, {r('count(*) FILTER (WHERE pnl > 0) * 100.0 / count(*)', 'win_rate')}
FROM breakout_ledger l ASOF LEFT JOIN volatility v ON l.symbol = v.symbol AND l.entry_time >= v.ts GROUP BY 1""")
def performance_by_entry_regime(spark, sf_dir):
    labels = _volatility(spark, sf_dir).select("symbol", F.col("ts").alias("regime_ts"), "regime")
    found = asof(trades(spark, sf_dir), labels, KEY, "entry_time", "regime_ts", ["regime"], tie=["trade_id"])
    count = F.count(F.lit(1))
    by = found.groupBy(F.coalesce("matched.regime", F.lit("Unknown")).alias("regime")).agg(
        count.alias("trades"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl"), (F.count_if(led.won()) * 100.0 / count).alias("win_rate")
    )
    return by.select("regime", "trades", *rcols("total_pnl avg_pnl", 2), *rcols("win_rate"))


@query("performance_by_nearest_cycle", f"{LEDGER} cycle", f"""
SELECT c.regime, count(*) AS trades, {r('count(*) FILTER (WHERE pnl > 0) * 1.0 / count(*)', 'win_rate')}, {r('avg((exit_price - entry_price) / entry_price * 100)', 'avg_pnl_pct')},
  {r('sum(pnl)', 'total_pnl', 2)}, {r('stddev_samp((exit_price - entry_price) / entry_price * 100)', 'std_pnl_pct')}
FROM breakout_ledger l JOIN cycle c ON l.symbol = c.symbol AND l.entry_time = c.ts GROUP BY 1""")
def performance_by_nearest_cycle(spark, sf_dir):
    """Exact bar, else the nearest one; every entry here is a bar time, so the SQL joins exactly."""
    labels = cycle(spark, sf_dir).select("symbol", F.col("ts").alias("regime_ts"), "regime")
    found = nearest(trades(spark, sf_dir), labels, KEY, "entry_time", "regime_ts", ["regime"], tie=["trade_id"])
    move = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * 100
    count = F.count(F.lit(1))
    by = found.groupBy(F.col("matched.regime").alias("regime")).agg(
        count.alias("trades"), (F.count_if(led.won()) / count).alias("win_rate"), F.avg(move).alias("avg_pnl_pct"), F.sum("pnl").alias("total_pnl"),
        F.stddev_samp(move).alias("std_pnl_pct"),
    )
    return by.select("regime", "trades", *rcols("win_rate avg_pnl_pct std_pnl_pct"), rounded("total_pnl", digits=2))


# ---- calendar regimes over the years of the data, overlapping and short ones included

CALENDAR = [
    ("whole", "1995-01-01", "2002-12-31", "recovery"), ("early", "1995-01-01", "1998-06-30", "bull"), ("middle", "1996-06-01", "1999-12-31", "chop"),
    ("late", "1998-07-01", "2002-12-31", "bear"), ("short", "1997-03-01", "1997-04-30", "chop"),
]
REGIME_RULES = breakout_rules("breakout", entry_len=20, exit_len=10)
cte("calendar", " UNION ALL ".join(f"SELECT '{n}' AS regime, TIMESTAMP '{s}' AS start, TIMESTAMP '{e}' AS stop, '{t}' AS type" for n, s, e, t in CALENDAR))
_TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
_BY = "PARTITION BY symbol, regime"


def _r(fn, value, n, shift=0):
    return _roll(fn, value, n, shift).replace("PARTITION BY symbol", _BY)


cte("regime_bar", f"""SELECT symbol, regime, ts, open, high, low, close, row_number() OVER ({_BY} ORDER BY ts) AS rn FROM daily JOIN calendar ON ts >= start AND ts <= stop""")
cte("regime_frame", f"""
SELECT *, {_r('max', 'high', 20, 1)} AS hi_40, {_r('min', 'low', 10, 1)} AS lo_16, {_r('avg', 'tr', 20)} AS atr_20, NULL::DOUBLE AS hi_16, NULL::DOUBLE AS lo_40, NULL::DOUBLE AS ema200
FROM (SELECT *, {_TR} AS tr FROM (SELECT *, lag(close) OVER ({_BY} ORDER BY rn) AS pc FROM regime_bar))""")
state_cte("rg", "100000", breakout_body(True, "symbol, regime"), "regime_frame", "symbol, regime")
ledger_ctes("rg", "regime_frame", "symbol, regime", "breakout")
cte("rg_curve", """
SELECT *, (equity - peak) / peak AS dd, equity / lag(equity) OVER (PARTITION BY symbol, regime ORDER BY rn) - 1 AS ret
FROM (SELECT *, max(equity) OVER (PARTITION BY symbol, regime ORDER BY rn) AS peak FROM rg_equity)""")
cte("rg_episode", """
SELECT symbol, regime, g, min(ts) FILTER (WHERE dd < 0) AS start, max(ts) FILTER (WHERE dd >= 0) AS recovery FROM (
  SELECT symbol, regime, ts, dd, count(*) FILTER (WHERE dd >= 0) OVER (PARTITION BY symbol, regime ORDER BY rn) - CASE WHEN dd >= 0 THEN 1 ELSE 0 END AS g FROM rg_curve)
GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE dd < 0) > 0""")
stats_cte("rg_stat", "symbol, regime", "rg_curve", "rg_episode")
cte("rg_result", """
SELECT symbol, regime, type, CASE WHEN ok THEN (lastc / firstc - 1) * 100 ELSE 0 END AS hold_pct, CASE WHEN ok THEN total_return_pct ELSE 0 END AS return_pct,
  CASE WHEN ok THEN abs(max_drawdown_pct) ELSE 0 END AS max_dd_pct, CASE WHEN ok THEN coalesce(n, 0) ELSE 0 END AS trades, CASE WHEN ok THEN coalesce(win_rate, 0) ELSE 0 END AS win_rate,
  CASE WHEN ok THEN pf ELSE 0 END AS profit_factor, CASE WHEN ok THEN coalesce(avg_r, 0) ELSE 0 END AS recovery_days, CASE WHEN ok THEN sharpe ELSE 0 END AS sharpe,
  CASE WHEN ok THEN final_equity > 10000 ELSE true END AS survived
FROM (SELECT symbol, regime, count(*) >= 50 AS ok, arg_max(close, ts) AS lastc, arg_min(close, ts) AS firstc FROM regime_bar GROUP BY 1, 2)
JOIN rg_stat USING (symbol, regime) JOIN calendar USING (regime)
LEFT JOIN (SELECT symbol, regime, count(*) AS n, count(*) FILTER (WHERE pnl > 0) * 100.0 / count(*) AS win_rate, sum(pnl) FILTER (WHERE pnl > 0) / nullif(abs(sum(pnl) FILTER (WHERE pnl < 0)), 0) AS pf
  FROM rg_trades GROUP BY 1, 2) USING (symbol, regime)""")
REGIMES = f"{DAILY} calendar regime_bar regime_frame rg_state rg_last rg_trades rg_equity rg_curve rg_episode rg_stat rg_result"


def _regime_bars(spark, sf_dir, placed=False):
    return cal.regime_bars(daily(spark, sf_dir), cal.calendar_frame(spark, CALENDAR), placed)


def _regime_result(spark, sf_dir):
    return Marts.table(spark, sf_dir, "regime_replay", lambda: cal.replay_by_regime(_regime_bars(spark, sf_dir, placed=True), REGIME_RULES), ("kind",))


def _regime_stats(spark, sf_dir):
    members = cal.in_calendar(daily(spark, sf_dir), cal.calendar_frame(spark, CALENDAR))
    found = cal.regime_stats(members, _regime_result(spark, sf_dir), REGIME_RULES, 365.0, DAY)
    return found.join(cal.calendar_frame(spark, CALENDAR).select("regime", "type"), "regime")


@query("bars_in_calendar_regimes", f"{DAILY} calendar regime_bar", "SELECT symbol, regime, ts, rn FROM regime_bar")
def bars_in_calendar_regimes(spark, sf_dir):
    return _regime_bars(spark, sf_dir).select("symbol", "regime", "ts", "rn")


@query("regime_replay_trades", f"{DAILY} calendar regime_bar regime_frame rg_state rg_last rg_trades", f"""
SELECT symbol, regime, entry_time, exit_time, {r('pnl', digits=4)}, exit_reason, unit_number FROM rg_trades""")
def regime_replay_trades(spark, sf_dir):
    ledger = trades_of(_regime_result(spark, sf_dir), ("symbol", "regime"))
    return ledger.select("symbol", "regime", "entry_time", "exit_time", rounded("pnl", digits=4), "exit_reason", "unit_number")


REGIME_VALUES = "hold_pct return_pct max_dd_pct win_rate profit_factor recovery_days sharpe"


@query("regime_statistics", REGIMES, f"SELECT symbol, regime, type, trades, survived, {rs(REGIME_VALUES)} FROM rg_result")
def regime_statistics(spark, sf_dir):
    return _regime_stats(spark, sf_dir).select("symbol", "regime", "type", F.col("trades").cast("long").alias("trades"), "survived", *rcols(REGIME_VALUES))


@query("regime_types", REGIMES, f"""
SELECT symbol, type, {r('mean_return')}, all_survived, any_survived, CASE type WHEN 'bull' THEN CASE WHEN mean_return > 50 THEN 'pass' ELSE 'warning' END
  WHEN 'bear' THEN CASE WHEN all_survived AND mean_return > -30 THEN 'pass' ELSE 'fail' END WHEN 'chop' THEN CASE WHEN mean_return > -20 THEN 'pass' ELSE 'warning' END END AS label
FROM (SELECT symbol, type, avg(return_pct) AS mean_return, bool_and(survived) AS all_survived, bool_or(survived) AS any_survived FROM rg_result GROUP BY 1, 2)""")
def regime_types(spark, sf_dir):
    found = cal.by_type(_regime_stats(spark, sf_dir), KEY)
    return found.select("symbol", "type", *rcols("mean_return"), "all_survived", "any_survived", "label")


@query("regime_viability", REGIMES, f"""
SELECT symbol, {r('dd', 'max_dd_pct')}, {r('total', 'return_sum')}, {r('(compound - 1) * 100', 'return_compounded', 4)},
  CASE WHEN alive AND dd < 60 AND total > 0 THEN 'VIABLE' WHEN alive THEN 'MARGINAL' ELSE 'NOT VIABLE' END AS verdict
FROM (SELECT symbol, bool_and(survived) AS alive, max(max_dd_pct) AS dd, sum(return_pct) AS total, exp(sum(ln(1 + return_pct / 100))) AS compound FROM rg_result GROUP BY symbol)""")
def regime_viability(spark, sf_dir):
    found = cal.viability(_regime_stats(spark, sf_dir), KEY)
    return found.select("symbol", *rcols("max_dd_pct return_sum"), rounded("return_compounded", digits=4), "verdict")


# ---- survivability verdicts

SURVIVAL = f"{LEDGER} breakout_equity breakout_curve episode equity_stat"


@query("survivability_report", SURVIVAL, f"""
SELECT symbol, {r('abs(max_drawdown_pct)', 'worst_drawdown_pct')}, {r('coalesce(longest, 0) / 6.0', 'longest_days')}, {r('under', 'time_underwater_pct')},
  CASE WHEN 100000 * (1 + total_return_pct * 0.5 / 100) > 50000 AND abs(max_drawdown_pct) * 1.5 < 80 THEN 'SURVIVES' ELSE 'FAILS' END AS verdict,
  concat_ws('; ', CASE WHEN abs(max_drawdown_pct) > 40 THEN 'lower risk' END, CASE WHEN coalesce(longest, 0) / 6.0 > 30 THEN 'long drawdowns' END, CASE WHEN under > 50 THEN 'mostly in drawdown' END,
    CASE WHEN abs(max_drawdown_pct) > 50 THEN 'half the account at risk' END) AS flags
FROM equity_stat LEFT JOIN (SELECT symbol, max(bars) AS longest FROM episode GROUP BY 1) USING (symbol)
JOIN (SELECT symbol, avg(CASE WHEN dd < 0 THEN 100.0 ELSE 0 END) AS under FROM breakout_curve GROUP BY 1) USING (symbol)""")
def survivability_report(spark, sf_dir):
    base = eq.stress(stats(spark, sf_dir), 100_000.0).join(eq.drawdown_indices(curve(spark, sf_dir), KEY), "symbol")
    longest = eq.drawdown_episodes(curve(spark, sf_dir), KEY).groupBy("symbol").agg((F.max("bars") / 6).alias("longest_days"))
    full = base.join(longest, "symbol", "left").na.fill(0.0, ["longest_days"]).withColumn("worst_drawdown_pct", F.abs("max_drawdown_pct"))
    flags = F.array(
        F.when(F.col("worst_drawdown_pct") > 40, "lower risk"),
        F.when(F.col("longest_days") > 30, "long drawdowns"),
        F.when(F.col("time_underwater_pct") > 50, "mostly in drawdown"),
        F.when(F.col("worst_drawdown_pct") > 50, "half the account at risk"),
    )
    return full.select(
        "symbol", *rcols("worst_drawdown_pct longest_days time_underwater_pct"), F.when(F.col("survives"), "SURVIVES").otherwise("FAILS").alias("verdict"),
        F.array_join(F.array_compact(flags), "; ").alias("flags"),
    )


VARIANTS = {"breakout": 100_000.0, "two_sided": 100_000.0, "selective": 1_000.0}  # capital each starts with
VARIANT_SQL = "\nUNION ALL\n".join(f"""
SELECT symbol, '{_v}' AS variant, {_i} AS place, final_equity, (final_equity / {_c} - 1) * 100 AS total_return_pct, depth * 100 AS max_drawdown_pct, sharpe, coalesce(n, 0) AS trades,
  coalesce(wins * 100.0 / n, 0) AS win_rate, coalesce(pnl, 0) AS total_pnl
FROM (SELECT symbol, arg_max(equity, rn) AS final_equity, min(dd) AS depth, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365), 0) AS sharpe FROM {_v}_curve GROUP BY symbol)
LEFT JOIN (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS wins, sum(pnl) AS pnl FROM {_v}_ledger GROUP BY symbol) USING (symbol)"""
    for _i, (_v, _c) in enumerate(VARIANTS.items()))
cte("compared", VARIANT_SQL)
COMPARED = f"{LEDGER} gated " + " ".join(f"{_v}_{_t}" for _v in VARIANTS for _t in "state last trades ledger equity curve".split() if f"{_v}_{_t}" not in LEDGER.split()) + " compared"


@query("strategy_comparison", COMPARED, f"""
SELECT symbol, variant, {r('final_equity', digits=4)}, {rs('total_return_pct max_drawdown_pct sharpe')}, trades, {r('win_rate')}, {r('total_pnl', digits=2)},
  row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN max_drawdown_pct <> 0 THEN total_return_pct / abs(max_drawdown_pct) ELSE 0 END DESC, place) = 1 AS best FROM compared""")
def strategy_comparison(spark, sf_dir):
    variants = [(name, curve(spark, sf_dir, name), trades(spark, sf_dir, name), capital) for name, capital in VARIANTS.items()]
    found = eq.compare_variants(variants, KEY, 365.0)
    return found.select(
        "symbol", "variant", rounded("final_equity", digits=4), *rcols("total_return_pct max_drawdown_pct sharpe"), "trades", *rcols("win_rate"), rounded("total_pnl", digits=2), "best"
    )


# ---- profits moved into the second asset

MONTHS_SQL = """
SELECT symbol, CAST(last_day(period) AS TIMESTAMP) AS month_end, equity, equity - lag(equity) OVER (PARTITION BY symbol ORDER BY period) AS profit FROM (
  SELECT symbol, CAST(date_trunc('month', ts) AS TIMESTAMP) AS period, arg_max(equity, ts) AS equity FROM breakout_curve GROUP BY 1, 2)"""
cte("moved", f"""
SELECT symbol, month_end, equity, profit, price, moved, moved / price AS bought, sum(moved / price) OVER w AS holdings, sum(moved) OVER w AS invested
FROM (SELECT m.*, q.price, CASE WHEN profit > 0 THEN profit * 0.3 ELSE 0 END AS moved FROM ({MONTHS_SQL}) m ASOF JOIN quotes q ON m.month_end >= q.quote_ts WHERE profit IS NOT NULL)
WINDOW w AS (PARTITION BY symbol ORDER BY month_end)""")
MOVED = f"{CURVE} quotes moved"


def _moved(spark, sf_dir):
    return cross.profit_sweeps(curve(spark, sf_dir), quotes(spark, sf_dir), KEY)


@query("profit_sweeps", MOVED, f"SELECT symbol, month_end, {rs('profit price moved invested', 4)}, {rs('bought holdings', 8)}, {r('holdings * price', 'value', 4)} FROM moved")
def profit_sweeps(spark, sf_dir):
    return _moved(spark, sf_dir).select("symbol", "month_end", *rcols("profit price moved invested", 4), *rcols("bought holdings", 8), rounded("value", digits=4))


@query("combined_portfolio", MOVED, f"""
SELECT symbol, {r('e', 'equity', 4)}, {r('i', 'invested', 4)}, {r('v', 'value', 4)}, {r('e - i + v', 'total', 4)}, {r('((e - i + v) / 100000 - 1) * 100', 'total_return_pct')},
  {r('e + v', 'undeducted_total', 4)}, {r('(v / nullif(i, 0) - 1) * 100', 'asset_return_pct')}
FROM (SELECT symbol, arg_max(equity, month_end) AS e, arg_max(invested, month_end) AS i, arg_max(holdings * price, month_end) AS v FROM moved GROUP BY symbol)""")
def combined_portfolio(spark, sf_dir):
    final = cross.combined(_moved(spark, sf_dir), KEY, 100_000.0)
    return final.select("symbol", *rcols("equity invested value total undeducted_total", 4), *rcols("total_return_pct asset_return_pct"))


@query("densified_prices", "", f"""
WITH a AS (SELECT o_orderpriority AS asset, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, avg(o_totalprice) AS price FROM orders GROUP BY 1, 2),
n AS (SELECT *, lead(day) OVER w AS nd, lead(price) OVER w AS np FROM a WINDOW w AS (PARTITION BY asset ORDER BY day)),
d AS (SELECT *, CAST(unnest(generate_series(CAST(day AS TIMESTAMP), CAST(coalesce(nd - 1, day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS x FROM n)
SELECT asset, x AS day, {r('CASE WHEN nd IS NULL THEN price ELSE price + (np - price) * (date_diff(\'day\', day, x) * 1.0::DOUBLE / date_diff(\'day\', day, nd)) END', 'price', 4)} FROM d""")
def densified_prices(spark, sf_dir):
    """Monthly anchors per order priority, daily rows between them."""
    anchors = read(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("asset"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("day")
    ).agg(F.avg("o_totalprice").alias("price"))
    return densify_linear(anchors, "asset", "day", "price").select("asset", "day", rounded("price", digits=4))


# ---- resampling

PATHS = 50


def _hex(label: str, *parts: str, seed: int = 42) -> str:
    return f"md5(concat_ws('-', '{label}', '{seed}', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def _u(digest: str) -> str:
    return f"((CAST('0x' || substr({digest}, 1, 13) AS BIGINT) + 0.5::DOUBLE) / {rs_.UNIFORM_SPAN}::DOUBLE)"


def _n(first: str, second: str) -> str:
    return f"(sqrt(-2 * ln({_u(first)})) * cos(2 * pi() * {_u(second)}))"


_ID = ("symbol", "path", "trade_id")
cte("shaken", f"""
SELECT symbol, path, trade_id, ret + 0.001::DOUBLE * {_n(_hex('n1', *_ID), _hex('n2', *_ID))} - 0.02::DOUBLE * abs({_n(_hex('s1', *_ID), _hex('s2', *_ID))}) AS ret, {_hex('order', *_ID)} AS place
FROM (SELECT symbol, trade_id, pnl / trade_value AS ret FROM breakout_ledger WHERE trade_value > 0), (SELECT unnest(generate_series(0, {PATHS - 1})) AS path)""")
cte("shuffled", """
SELECT symbol, path, step, equity, greatest(max(equity) OVER (PARTITION BY symbol, path ORDER BY step), 100000) AS peak FROM (
  SELECT symbol, path, row_number() OVER w AS step, CASE WHEN max(CASE WHEN ret <= -1 THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE 100000 * exp(sum(ln(1 + greatest(ret, -0.999999999999::DOUBLE))) OVER w) END AS equity
  FROM shaken WINDOW w AS (PARTITION BY symbol, path ORDER BY place, trade_id))""")
cte("outcome", "SELECT symbol, path, arg_max(equity, step) AS final_equity, max((peak - equity) / peak) AS max_dd FROM shuffled GROUP BY 1, 2")
SHUFFLED = f"{LEDGER} shaken shuffled"
OUTCOME = f"{SHUFFLED} outcome"


def _steps(spark, sf_dir):
    def build():
        return rs_.permutation_steps(led.trade_returns(trades(spark, sf_dir)), KEY, "trade_id", PATHS)

    return Marts.table(spark, sf_dir, "permutation_steps", build)


def _outcomes(spark, sf_dir):
    return rs_.path_results(_steps(spark, sf_dir), KEY)


@query("permutation_paths", OUTCOME, f"SELECT symbol, path, {r('final_equity', digits=3)}, {r('max_dd')} FROM outcome")
def permutation_paths(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("symbol", F.col("path").cast("long").alias("path"), rounded("final_equity", digits=3), *rcols("max_dd"))


@query("permutation_without_noise", LEDGER, f"""
SELECT symbol, path, {r('100000 * exp(sum(ln(1 + pnl / trade_value)))', 'final_equity', 3)} FROM breakout_ledger, (SELECT unnest(generate_series(0, 4)) AS path) WHERE trade_value > 0 GROUP BY 1, 2""")
def permutation_without_noise(spark, sf_dir):
    """Without noise the order cannot matter: every path ends at the compounded product."""
    steps = rs_.permutation_steps(led.trade_returns(trades(spark, sf_dir)), KEY, "trade_id", 5, noise=0.0, slippage=0.0)
    return rs_.path_results(steps, KEY).select("symbol", F.col("path").cast("long").alias("path"), rounded("final_equity", digits=3))


P = {"p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
_PCT_SQL = ", ".join(r(f"quantile_cont(final_equity, {p})", n, 3) for n, p in P.items())


@query("path_summary", OUTCOME, f"""
SELECT symbol, count(*) AS paths, {r('avg(final_equity)', 'mean', 3)}, {r('stddev_pop(final_equity)', 'std', 3)}, {r('min(final_equity)', 'min', 3)}, {r('max(final_equity)', 'max', 3)}, {_PCT_SQL}
FROM outcome GROUP BY symbol""")
def path_summary(spark, sf_dir):
    return rs_.summary(_outcomes(spark, sf_dir), KEY).select("symbol", "paths", *rcols("mean std min max", 3), *rcols(" ".join(P), 3))


@query("path_outcome_shares", OUTCOME, f"""
SELECT symbol, {r('avg(CASE WHEN final_equity < 20000 THEN 100.0 ELSE 0 END)', 'prob_ruin')}, {r('avg(CASE WHEN max_dd >= 0.5 THEN 100.0 ELSE 0 END)', 'prob_half_drawdown')},
  {r('avg(CASE WHEN final_equity > 100000 THEN 100.0 ELSE 0 END)', 'prob_profit')}, {r('avg(CASE WHEN final_equity >= 200000 THEN 100.0 ELSE 0 END)', 'prob_double')} FROM outcome GROUP BY symbol""")
def path_outcome_shares(spark, sf_dir):
    shares = rs_.outcome_shares(_outcomes(spark, sf_dir), KEY, 100_000.0)
    return shares.select("symbol", *rcols("prob_ruin prob_half_drawdown prob_profit prob_double"))


LEVELS = (10_000, 50_000, 100_000, 500_000, 1_000_000)


@query("path_threshold_shares", OUTCOME, f"""
SELECT symbol, t AS threshold, {r('avg(CASE WHEN final_equity >= t THEN 100.0 ELSE 0 END)', 'share_pct')} FROM outcome, (SELECT unnest({list(map(float, LEVELS))}::DOUBLE[]) AS t) GROUP BY 1, 2""")
def path_threshold_shares(spark, sf_dir):
    return rs_.threshold_shares(_outcomes(spark, sf_dir), KEY, LEVELS).select("symbol", "threshold", *rcols("share_pct"))


@query("path_distribution", OUTCOME, f"SELECT DISTINCT symbol, {r('final_equity', digits=3)}, {r('cume_dist() OVER (PARTITION BY symbol ORDER BY final_equity)', 'cdf')} FROM outcome")
def path_distribution(spark, sf_dir):
    return rs_.distribution(_outcomes(spark, sf_dir), KEY).select("symbol", rounded("final_equity", digits=3), *rcols("cdf"))


@query("path_log_histogram", OUTCOME, "SELECT symbol, CAST(floor(log10(final_equity) / 0.1::DOUBLE) AS BIGINT) AS bin, count(*) AS paths FROM outcome WHERE final_equity > 0 GROUP BY 1, 2")
def path_log_histogram(spark, sf_dir):
    return rs_.log_histogram(_outcomes(spark, sf_dir), KEY)


@query("deployable_verdict", OUTCOME, f"""
SELECT symbol, {r('median_cagr')}, {r('p95_max_dd')}, issues, issues = '' AS deployable FROM (
  SELECT *, concat_ws('; ', CASE WHEN median_cagr <= 0 THEN 'negative median' END, CASE WHEN ruin >= 10 THEN 'ruin likely' END, CASE WHEN profit <= 60 THEN 'profit unlikely' END,
    CASE WHEN p95_max_dd >= 80 THEN 'extreme drawdown' END) AS issues FROM (
    SELECT symbol, (pow(quantile_cont(final_equity, 0.5) / 100000, 0.125) - 1) * 100 AS median_cagr, quantile_cont(max_dd, 0.95) * 100 AS p95_max_dd,
      avg(CASE WHEN final_equity < 20000 THEN 100.0 ELSE 0 END) AS ruin, avg(CASE WHEN final_equity > 100000 THEN 100.0 ELSE 0 END) AS profit FROM outcome GROUP BY symbol))""")
def deployable_verdict(spark, sf_dir):
    from tidebar.operators.percentiles import percentiles

    found = _outcomes(spark, sf_dir)
    middle = percentiles(found, KEY, "final_equity", {"median": 0.5})
    deep = percentiles(found, KEY, "max_dd", {"deep": 0.95})
    growth = rs_.growth_rate(F.col("median"), 100_000.0, F.lit(8.0)) * 100
    sums = middle.join(deep, "symbol").select("symbol", growth.alias("median_cagr"), (F.col("deep") * 100).alias("p95_max_dd"))
    verdict = rs_.deployable(sums, rs_.outcome_shares(found, KEY, 100_000.0), KEY)
    return verdict.select("symbol", *rcols("median_cagr p95_max_dd"), "issues", "deployable")


OVERALL = OUTCOME + "".join(f" {_n}" for _n in SURVIVAL.split() if _n not in OUTCOME.split())


@query("overall_verdict", OVERALL, f"""
SELECT symbol, {r('prob_ruin')}, {r('median_cagr')}, survives, concerns, strengths, CASE len(string_split(concerns, '; ')) * CAST(concerns <> '' AS INTEGER)
    WHEN 0 THEN 'DEPLOYABLE' WHEN 1 THEN 'MARGINAL' WHEN 2 THEN 'MARGINAL' ELSE 'NEEDS WORK' END AS verdict
FROM (SELECT *, concat_ws('; ', CASE WHEN prob_ruin > 10 THEN 'ruin likely' END, CASE WHEN median_cagr < 0 THEN 'negative median' END, CASE WHEN NOT survives THEN 'fails stress' END) AS concerns,
    concat_ws('; ', CASE WHEN prob_ruin <= 10 THEN 'ruin unlikely' END, CASE WHEN median_cagr > 10 THEN 'strong median' END, CASE WHEN survives THEN 'passes stress' END) AS strengths
  FROM (SELECT symbol, avg(CASE WHEN final_equity < 20000 THEN 100.0 ELSE 0 END) AS prob_ruin, (pow(quantile_cont(final_equity, 0.5) / 100000, 0.125) - 1) * 100 AS median_cagr
    FROM outcome GROUP BY symbol)
  JOIN (SELECT symbol, 100000 * (1 + total_return_pct * 0.5 / 100) > 50000 AND abs(max_drawdown_pct) * 1.5 < 80 AS survives FROM equity_stat) USING (symbol))""")
def overall_verdict(spark, sf_dir):
    from tidebar.operators.percentiles import percentiles

    found = _outcomes(spark, sf_dir)
    growth = rs_.growth_rate(F.col("median"), 100_000.0, F.lit(8.0)) * 100
    middle = percentiles(found, KEY, "final_equity", {"median": 0.5}).select("symbol", growth.alias("median_cagr"))
    verdict = rs_.overall_verdict(middle, rs_.outcome_shares(found, KEY, 100_000.0), eq.stress(stats(spark, sf_dir), 100_000.0), KEY)
    return verdict.select("symbol", *rcols("prob_ruin median_cagr"), "survives", "concerns", "strengths", "verdict")


COSTS = dict(trade_cost=0.005, error_rate=0.01)
YEARS = 20


def _rates(spark, sf_dir):
    span = F.timestamp_diff("DAY", F.min("ts"), F.max("ts")) / 365.25
    years = curve(spark, sf_dir).groupBy("symbol").agg(span.alias("years"))
    counts = trades(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return years.join(counts, "symbol").select("symbol", "n", (F.col("n") / F.col("years")).alias("rate"))


def _bootstrap(spark, sf_dir, label, **costs):
    def build():
        returns = led.trade_returns(trades(spark, sf_dir)).select("symbol", (F.col("trade_id") - 1).alias("item"), F.col("price_ret").alias("ret"))
        return rs_.bootstrap_steps(returns, KEY, _rates(spark, sf_dir), 20, YEARS, **costs)

    return Marts.table(spark, sf_dir, f"bootstrap_{label}", build)


cte("rate", """SELECT symbol, n, n / (date_diff('day', a, b) / 365.25::DOUBLE) AS rate FROM (SELECT symbol, min(ts) AS a, max(ts) AS b FROM breakout_equity GROUP BY 1)
JOIN (SELECT symbol, count(*) AS n FROM breakout_ledger GROUP BY 1) USING (symbol)""")
cte("drawn", f"""
SELECT symbol, path, draw, year, l.exit_price / l.entry_price - 1 AS ret FROM (
  SELECT symbol, path, draw, n, rate, CAST(floor({_u(_hex('pick', 'symbol', 'path', 'draw'))} * n) AS BIGINT) AS item, len(list_filter(generate_series(1, {YEARS}), lambda y: floor(y * rate) <= draw)) AS year
  FROM (SELECT *, unnest(generate_series(0, CAST(floor({YEARS} * rate) AS BIGINT) - 1)) AS draw FROM rate, (SELECT unnest(generate_series(0, 19)) AS path)))
JOIN breakout_ledger l USING (symbol) WHERE l.trade_id = item + 1""")
cte("yearly_draws", f"""
SELECT symbol, path, step, coalesce(rets, []) AS rets FROM (SELECT symbol, path, unnest(generate_series(1, {YEARS})) AS step FROM rate, (SELECT unnest(generate_series(0, 19)) AS path))
LEFT JOIN (SELECT symbol, path, year + 1 AS step, list(ret ORDER BY draw) AS rets FROM drawn GROUP BY 1, 2, 3) USING (symbol, path, step)""")
for _label, _cost, _err in (("plain", "0", "0"), ("costed", "0.005", "0.01")):
    _run = f"list_reduce(list_prepend(p.equity, rets), lambda c, x: greatest(c * (1 + 0.25::DOUBLE * (x - {_cost})), 10))"
    cte(f"boot_{_label}", f"""
SELECT DISTINCT symbol, path, CAST(0 AS BIGINT), 1000::DOUBLE FROM yearly_draws
UNION ALL SELECT symbol, path, step, c - CASE WHEN c > before THEN (c - before) * {_err} ELSE 0 END FROM (
  SELECT d.symbol, d.path, d.step, p.equity AS before, {_run} AS c FROM boot_{_label} p JOIN yearly_draws d ON d.symbol = p.symbol AND d.path = p.path AND d.step = p.step + 1)""", "symbol, path, step, equity")
BOOT = f"{LEDGER} breakout_equity rate drawn yearly_draws"


@query("bootstrap_paths", f"{BOOT} boot_costed", f"SELECT symbol, path, CAST(step AS INT) AS step, {r('equity', digits=4)} FROM boot_costed WHERE step > 0")
def bootstrap_paths(spark, sf_dir):
    steps = _bootstrap(spark, sf_dir, "costed", **COSTS)
    return steps.select("symbol", F.col("path").cast("long").alias("path"), "step", rounded("equity", digits=4))


@query("bootstrap_fan", f"{BOOT} boot_costed", f"""
SELECT symbol, CAST(step AS INT) AS step, {', '.join(r(f'quantile_cont(equity, {p})', n, 4) for n, p in P.items() if n not in ('p10', 'p90'))} FROM boot_costed WHERE step > 0 GROUP BY 1, 2""")
def bootstrap_fan(spark, sf_dir):
    return rs_.fan(_bootstrap(spark, sf_dir, "costed", **COSTS), KEY).select("symbol", "step", *rcols("p5 p25 p50 p75 p95", 4))


@query("bootstrap_threshold_by_step", f"{BOOT} boot_costed", f"""
SELECT symbol, CAST(step AS INT) AS step, t AS threshold, {r('avg(CASE WHEN equity >= t THEN 100.0 ELSE 0 END)', 'share_pct')}
FROM boot_costed, (SELECT unnest([1000.0, 2000.0]::DOUBLE[]) AS t) WHERE step > 0 GROUP BY 1, 2, 3""")
def bootstrap_threshold_by_step(spark, sf_dir):
    found = rs_.threshold_shares(_bootstrap(spark, sf_dir, "costed", **COSTS), ["symbol", "step"], (1000, 2000), "equity")
    return found.select("symbol", "step", "threshold", *rcols("share_pct"))


def _finals(spark, sf_dir, label, **costs):
    return _bootstrap(spark, sf_dir, label, **costs).where(F.col("step") == YEARS).withColumnRenamed("equity", "final_equity")


_COST_LEVELS = " UNION ALL ".join(
    f"SELECT symbol, '{n}' AS level, quantile_cont(a.equity, {p}) AS without_costs, quantile_cont(b.equity, {p}) AS with_costs FROM boot_plain a JOIN boot_costed b USING (symbol, path, step) WHERE step = {YEARS} GROUP BY symbol"
    for n, p in P.items() if n not in ("p10", "p90"))


@query("cost_comparison", f"{BOOT} boot_plain boot_costed", f"SELECT symbol, level, {rs('without_costs with_costs', 4)}, {r('(with_costs - without_costs) / without_costs * 100', 'change_pct')} FROM ({_COST_LEVELS})")
def cost_comparison(spark, sf_dir):
    found = rs_.cost_comparison(_finals(spark, sf_dir, "plain"), _finals(spark, sf_dir, "costed", **COSTS), KEY)
    return found.select("symbol", "level", *rcols("without_costs with_costs", 4), *rcols("change_pct"))


@query("costs_lower_the_median", f"{BOOT} boot_plain boot_costed", f"""
SELECT symbol, quantile_cont(b.equity, 0.5) < quantile_cont(a.equity, 0.5) AS lower FROM boot_plain a JOIN boot_costed b USING (symbol, path, step) WHERE step = {YEARS} GROUP BY symbol""")
def costs_lower_the_median(spark, sf_dir):
    found = rs_.cost_comparison(_finals(spark, sf_dir, "plain"), _finals(spark, sf_dir, "costed", **COSTS), KEY)
    return found.where(F.col("level") == "p50").select("symbol", (F.col("with_costs") < F.col("without_costs")).alias("lower"))


# ---- in-sample and out-of-sample

@query("in_and_out_of_sample", REGIMES, f"""
SELECT symbol, {r("max(return_pct) FILTER (WHERE regime = 'early')", 'in_sample_pct')}, {r("max(return_pct) FILTER (WHERE regime = 'late')", 'out_of_sample_pct')},
  abs(max(return_pct) FILTER (WHERE regime = 'late') - max(return_pct) FILTER (WHERE regime = 'early')) < 200 AS generalises FROM rg_result GROUP BY symbol""")
def in_and_out_of_sample(spark, sf_dir):
    """The same rules replayed on the early and the late part, each from its own first bar."""
    wide = _regime_stats(spark, sf_dir).groupBy("symbol").pivot("regime", ["early", "late"]).agg(F.first("return_pct"))
    gap = F.abs(F.col("late") - F.col("early"))
    return wide.select("symbol", rounded("early", "in_sample_pct"), rounded("late", "out_of_sample_pct"), (gap < 200).alias("generalises"))
