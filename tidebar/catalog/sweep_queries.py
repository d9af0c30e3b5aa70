"""Parameter sweeps over every series, robustness of their results and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebar.catalog.inputs import DAILY, _roll, daily
from tidebar.catalog.registry import cte, query, r, rcols, rounded, rs
from tidebar.catalog.replay_queries import breakout_body, ledger_ctes, ratchet_body, state_cte
from tidebar.functions.frame import sweep_frame
from tidebar.plans import sweep as sw
from tidebar.session import Marts

KEY = ["symbol"]
SMALL = {"entry_len": [15, 40], "exit_len": [10, 16], "trail_mult": [3.0, 4.0], "risk_pct": [1.0], "spacing": [1.0, 1.5]}
POINTS = sw.grid_points("breakout", SMALL)


def full_frame(spark, sf_dir):
    lens = [n for axis in ("entry_len", "exit_len") for n in sw.GRIDS["breakout"][axis]]
    return Marts.table(spark, sf_dir, "sweep_frame", lambda: sweep_frame(daily(spark, sf_dir), [*lens, 16], 20))


def small(spark, sf_dir):
    """Twelve valid sets over every series."""

    def build():
        found = sw.sweep(full_frame(spark, sf_dir), sw.rules_of("breakout", POINTS))
        return sw.with_points(found, POINTS, spark)

    return Marts.table(spark, sf_dir, "sweep_small", build)


cte("point", " UNION ALL ".join(
    f"SELECT '{i}' AS param_id, {p['entry_len']} AS entry_len, {p['exit_len']} AS exit_len, {p['trail_mult']}::DOUBLE AS trail_mult, {p['risk_pct']}::DOUBLE AS risk_pct, {p['spacing']}::DOUBLE AS spacing"
    for i, p in enumerate(POINTS)))
_TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
cte("sweep_bars", f"SELECT *, {_roll('max', 'high', 15, 1)} AS h15, {_roll('max', 'high', 40, 1)} AS h40, {_roll('min', 'low', 10, 1)} AS l10, {_roll('min', 'low', 16, 1)} AS l16, "
    f"{_roll('avg', 'tr', 20)} AS atr_20 FROM (SELECT *, {_TR} AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS pc FROM daily))")
cte("sweep_input", """
SELECT symbol, param_id, rn, ts, high, low, close, atr_20, CASE entry_len WHEN 15 THEN h15 ELSE h40 END AS hi_40, CASE exit_len WHEN 10 THEN l10 ELSE l16 END AS lo_16,
  NULL::DOUBLE AS hi_16, NULL::DOUBLE AS lo_40, NULL::DOUBLE AS ema200, trail_mult AS k, spacing AS sp FROM sweep_bars CROSS JOIN point""")
state_cte("swept", "100000", breakout_body(True, "symbol, param_id").replace("4.0 * atr_20", "k * atr_20").replace("1.5 * atr_20", "sp * atr_20"), "sweep_input", "symbol, param_id")
ledger_ctes("swept", "sweep_input", "symbol, param_id", "breakout")
cte("swept_curve", """
SELECT *, (equity - peak) / peak AS dd, equity / lag(equity) OVER (PARTITION BY symbol, param_id ORDER BY rn) - 1 AS ret
FROM (SELECT *, max(equity) OVER (PARTITION BY symbol, param_id ORDER BY rn) AS peak FROM swept_equity)""")
cte("swept_stat", """
SELECT *, (final_equity / 100000 - 1) * 100 AS return_pct, (pow(final_equity / 100000, 365.0::DOUBLE / bars) - 1) * 100 AS cagr_pct FROM (
  SELECT symbol, param_id, arg_max(equity, rn) AS final_equity, count(*) AS bars, min(dd) * 100 AS max_dd_pct, coalesce(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(365), 0) AS sharpe
  FROM swept_curve GROUP BY 1, 2)""")
cte("swept_result", """
SELECT *, coalesce(n, 0) AS trades, w * 100.0 / nullif(n, 0) AS win_rate, gain / nullif(loss, 0) AS profit_factor, coalesce(cagr_pct / nullif(abs(max_dd_pct), 0), 0) AS calmar
FROM swept_stat LEFT JOIN (SELECT symbol, param_id, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS w, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gain,
  coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS loss FROM swept_trades GROUP BY 1, 2) USING (symbol, param_id) JOIN point USING (param_id)""")
SWEPT = f"{DAILY} point sweep_bars sweep_input swept_state swept_last swept_trades swept_equity swept_curve swept_stat swept_result"
VALUES = "return_pct max_dd_pct sharpe win_rate profit_factor cagr_pct calmar"
POINT = "entry_len, exit_len, trail_mult, risk_pct, spacing"


@query("parameter_sweep", SWEPT, f"SELECT symbol, {POINT}, trades, {rs(VALUES)} FROM swept_result")
def parameter_sweep(spark, sf_dir):
    return small(spark, sf_dir).select("symbol", *POINT.split(", "), "trades", *rcols(VALUES))


@query("parameter_sweep_full_grid")
def parameter_sweep_full_grid(spark, sf_dir):
    """All 2,800 valid sets of the breakout grid over every series."""
    points = sw.grid_points("breakout")
    found = sw.sweep(full_frame(spark, sf_dir), sw.rules_of("breakout", points))
    return sw.with_points(found, points, spark)


@query("sweep_scores", SWEPT, f"""
SELECT symbol, {POINT}, {r('return_pct - 0.5 * abs(max_dd_pct)', 'balance')}, {r('coalesce(return_pct / nullif(abs(max_dd_pct), 0), 0)', 'return_per_dd')},
  {r('return_pct / 100 * 0.3 + (100 + max_dd_pct) / 100 * 0.3 + sharpe * 0.2 + CASE WHEN trades * 1.0 / bars BETWEEN 0.5 AND 1.5 THEN 0.2 ELSE 0.1 END', 'weighted')}
FROM swept_result""")
def sweep_scores(spark, sf_dir):
    bars = daily(spark, sf_dir).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    found = small(spark, sf_dir).join(bars, "symbol")
    return found.select(
        "symbol", *POINT.split(", "), rounded(sw.balance_score(), "balance"), rounded(sw.return_per_drawdown(), "return_per_dd"),
        rounded(sw.frequency_score(F.col("trades") / F.col("bars")), "weighted"),
    )


@query("profitable_shares", SWEPT, f"""
SELECT symbol, {r('avg(CASE WHEN return_pct > 0 THEN 1.0 ELSE 0 END) * 100', 'pct_profitable')}, {r('avg(CASE WHEN return_pct > 100 THEN 1.0 ELSE 0 END) * 100', 'pct_strong')}
FROM swept_result GROUP BY symbol""")
def profitable_shares(spark, sf_dir):
    return sw.profitable_shares(small(spark, sf_dir), KEY).select("symbol", *rcols("pct_profitable pct_strong"))


cte("axis_mean", " UNION ALL ".join(
    f"SELECT symbol, '{a}' AS axis, {a}::DOUBLE AS value, avg(return_pct) AS mean, stddev_samp(return_pct) AS std, min(return_pct) AS min, max(return_pct) AS max FROM swept_result GROUP BY symbol, {a}" for a in sw.AXES))
cte("axis_sense", """
SELECT symbol, axis, avg(mean) AS mean_return, stddev_samp(mean) AS std_return, max(step) AS max_cliff, coalesce(stddev_samp(mean) < avg(mean) * 0.5, false) AS is_plateau
FROM (SELECT *, abs(mean - lag(mean) OVER (PARTITION BY symbol, axis ORDER BY value)) AS step FROM axis_mean) GROUP BY 1, 2""")


@query("returns_by_axis", f"{SWEPT} axis_mean", f"SELECT symbol, axis, value, {rs('mean std min max')} FROM axis_mean")
def returns_by_axis(spark, sf_dir):
    return sw.by_axis(small(spark, sf_dir), KEY, sw.AXES).select("symbol", "axis", "value", *rcols("mean std min max"))


@query("axis_sensitivity", f"{SWEPT} axis_mean axis_sense", f"SELECT symbol, axis, {rs('mean_return std_return max_cliff')}, is_plateau FROM axis_sense")
def axis_sensitivity(spark, sf_dir):
    return sw.sensitivity(small(spark, sf_dir), KEY, sw.AXES).select("symbol", "axis", *rcols("mean_return std_return max_cliff"), "is_plateau")


@query("robustness_scores", f"{SWEPT} axis_mean axis_sense", f"""
SELECT symbol, plateaus, {r('score')}, CASE WHEN score >= 50 THEN 'ROBUST' WHEN score >= 30 THEN 'MARGINAL' ELSE 'FRAGILE' END AS verdict FROM (
  SELECT symbol, plateaus, profitable * 0.3 + strong * 0.3 + plateaus * 10 AS score
  FROM (SELECT symbol, avg(CASE WHEN return_pct > 0 THEN 100.0 ELSE 0 END) AS profitable, avg(CASE WHEN return_pct > 100 THEN 100.0 ELSE 0 END) AS strong FROM swept_result GROUP BY symbol)
  JOIN (SELECT symbol, count(*) FILTER (WHERE is_plateau) AS plateaus FROM axis_sense GROUP BY symbol) USING (symbol))""")
def robustness_scores(spark, sf_dir):
    return sw.robustness(small(spark, sf_dir), KEY, sw.AXES).select("symbol", "plateaus", *rcols("score"), "verdict")


def _pivot(name: str, row: str, column: str, metric: str) -> None:
    values = SMALL[column]

    def label(v):
        return f"{column}_{str(v).replace('.', '_')}"

    columns = ", ".join(r(f"avg({metric}) FILTER (WHERE {column} = {v})", label(v)) for v in values)

    @query(name, SWEPT, f"SELECT symbol, {row}, {columns} FROM swept_result GROUP BY symbol, {row}")
    def run(spark, sf_dir):
        wide = sw.pivot_mean(small(spark, sf_dir), KEY, row, column, values, metric, label)
        return wide.select("symbol", row, *[rounded(label(v)) for v in values])


_pivot("pivot_entry_exit_return", "entry_len", "exit_len", "return_pct")
_pivot("pivot_trail_risk_return", "trail_mult", "risk_pct", "return_pct")
_pivot("pivot_entry_spacing_sharpe", "entry_len", "spacing", "sharpe")
_pivot("pivot_entry_risk_drawdown", "entry_len", "risk_pct", "max_dd_pct")

ORDER = "symbol, entry_len, exit_len, trail_mult, spacing"


def _top(frame, column, n, descending=True):
    """Global top n; equal values rank by symbol and parameters."""
    by = F.round(column, 6)
    return frame.orderBy(by.desc() if descending else by.asc(), *ORDER.split(", ")).limit(n)


@query("top_by_sharpe", SWEPT, f"SELECT {ORDER}, {r('sharpe')} FROM swept_result ORDER BY round(sharpe, 6) DESC, {ORDER} LIMIT 10")
def top_by_sharpe(spark, sf_dir):
    return _top(small(spark, sf_dir), F.col("sharpe"), 10).select(*ORDER.split(", "), *rcols("sharpe"))


_RPD = "coalesce(return_pct / nullif(abs(max_dd_pct), 0), 0)"


@query("top_and_bottom_sets", SWEPT, f"""
(SELECT 'return' AS ranking, {ORDER}, {r('return_pct', 'value')} FROM swept_result ORDER BY round(return_pct, 6) DESC, {ORDER} LIMIT 5)
UNION ALL (SELECT 'return_per_dd', {ORDER}, {r(_RPD, 'value')} FROM swept_result ORDER BY round({_RPD}, 6) DESC, {ORDER} LIMIT 5)
UNION ALL (SELECT 'low_dd', {ORDER}, {r('abs(max_dd_pct)', 'value')} FROM swept_result ORDER BY round(abs(max_dd_pct), 6), {ORDER} LIMIT 5)""")
def top_and_bottom_sets(spark, sf_dir):
    found = small(spark, sf_dir)

    def part(name, column, descending):
        return _top(found, column, 5, descending).select(F.lit(name).alias("ranking"), *ORDER.split(", "), rounded(column, "value"))

    high = part("return", F.col("return_pct"), True).unionByName(part("return_per_dd", sw.return_per_drawdown(), True))
    return high.unionByName(part("low_dd", F.abs("max_dd_pct"), False))


@query("best_return_with_low_drawdown", SWEPT, f"""
SELECT {ORDER}, {rs('return_pct max_dd_pct')} FROM swept_result WHERE abs(max_dd_pct) < 35 ORDER BY round(return_pct, 6) DESC, {ORDER} LIMIT 1""")
def best_return_with_low_drawdown(spark, sf_dir):
    calm = small(spark, sf_dir).where(F.abs("max_dd_pct") < 35)
    return _top(calm, F.col("return_pct"), 1).select(*ORDER.split(", "), *rcols("return_pct max_dd_pct"))


@query("best_set_per_symbol", SWEPT, f"""
SELECT {ORDER}, {r('return_pct - 0.5 * abs(max_dd_pct)', 'score')} FROM swept_result
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(return_pct - 0.5 * abs(max_dd_pct), 6) DESC, {ORDER}) = 1""")
def best_set_per_symbol(spark, sf_dir):
    ranked = Window.partitionBy("symbol").orderBy(F.round(sw.balance_score(), 6).desc(), *ORDER.split(", "))
    best = small(spark, sf_dir).withColumn("place", F.row_number().over(ranked)).where(F.col("place") == 1)
    return best.select(*ORDER.split(", "), rounded(sw.balance_score(), "score"))


# ---- the ratchet profile with and without its trend gate

GATED = {"entry_len": [8, 12], "exit_len": [6, 16], "trail_mult": [2.5, 3.5], "risk_pct": [1.0], "use_trend": [False, True], "trend_len": [50]}
GATED_POINTS = sw.grid_points("ratchet", GATED)
cte("gated_point", " UNION ALL ".join(
    f"SELECT '{i}' AS param_id, {p['entry_len']} AS entry_len, {p['exit_len']} AS exit_len, {p['trail_mult']}::DOUBLE AS trail_mult, {str(p['use_trend']).lower()} AS use_trend" for i, p in enumerate(GATED_POINTS)))
cte("gated_bars", f"SELECT *, {_roll('max', 'high', 8, 1)} AS h8, {_roll('max', 'high', 12, 1)} AS h12, {_roll('min', 'low', 6, 1)} AS l6, {_roll('min', 'low', 16, 1)} AS l16, "
    f"{_roll('avg', 'tr', 14, 1)} AS atrp_14, {_roll('avg', 'close', 50, 1)} AS smap FROM (SELECT *, {_TR} AS tr FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY rn) AS pc FROM daily))")
cte("gated_input", """
SELECT symbol, param_id, rn, ts, close, high, low, atrp_14, CASE entry_len WHEN 8 THEN h8 ELSE h12 END AS hi_8, CASE exit_len WHEN 6 THEN l6 ELSE l16 END AS lo_16, trail_mult AS k,
  NOT use_trend OR coalesce(close > smap, false) AS may FROM gated_bars CROSS JOIN gated_point""")
state_cte("gswept", "10000", ratchet_body("symbol, param_id").replace("3.5 *", "k *").replace("rn > 110", "rn > 60").replace("live AND len(units1) < 4", "live AND may AND len(units1) < 4"),
          "gated_input", "symbol, param_id")
ledger_ctes("gswept", "gated_input", "symbol, param_id", "ratchet")
GSWEPT = f"{DAILY} gated_point gated_bars gated_input gswept_state gswept_last gswept_trades"


@query("ratchet_sweep", GSWEPT, f"""
SELECT symbol, entry_len, exit_len, trail_mult, use_trend, coalesce(n, 0) AS trades, {r('coalesce(total, 0) / 10000 * 100', 'return_pct')}, {r('w * 100.0 / nullif(n, 0)', 'win_rate')}
FROM (SELECT DISTINCT symbol FROM daily) CROSS JOIN gated_point LEFT JOIN (SELECT symbol, param_id, count(*) AS n, count(*) FILTER (WHERE pnl > 0) AS w, sum(pnl) AS total FROM gswept_trades GROUP BY 1, 2) USING (symbol, param_id)""")
def ratchet_sweep(spark, sf_dir):
    frame = sweep_frame(daily(spark, sf_dir), [8, 12, 6, 16], 14, trend_lens=[50])
    found = sw.sweep(frame, sw.rules_of("ratchet", GATED_POINTS))
    named = sw.with_points(found, GATED_POINTS, spark)
    return named.select("symbol", "entry_len", "exit_len", "trail_mult", "use_trend", "trades", *rcols("return_pct win_rate"))
