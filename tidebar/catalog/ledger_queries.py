"""Trade statistics, groupings, streaks and rankings over the ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidebar.catalog.inputs import DAY, FRAME
from tidebar.catalog.registry import cte, query, r, rcols, rounded, rs
from tidebar.catalog.replay_queries import RULES, trades
from tidebar.operators.percentiles import percentiles
from tidebar.operators.windows import row_slice, running, runs, time_slice
from tidebar.plans import ledger as led

KEY = ["symbol"]
for _name in RULES:
    cte(f"{_name}_ledger", f"""
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rn, position_id, unit_number) AS trade_id, quantity * entry_price AS trade_value,
  pnl / (quantity * entry_price) * 100 AS pnl_pct, epoch(exit_time - entry_time) / 3600 AS holding_hours,
  CAST(trunc(epoch(exit_time - entry_time) / 86400) AS INT) AS bars_held FROM {_name}_trades""")


def ledger_of(name="breakout"):
    gated = " gated" if name in ("filtered", "selective") else ""
    return f"{FRAME}{gated} {name}_state {name}_last {name}_trades {name}_ledger"


LEDGER = ledger_of()
WIN, LOSS = "FILTER (WHERE pnl > 0)", "FILTER (WHERE pnl < 0)"
STATS_SQL = f"""count(*) AS total_trades, count(*) {WIN} AS winning_trades, count(*) {LOSS} AS losing_trades, {r(f'count(*) {WIN} * 100.0 / count(*)', 'win_rate')},
  {r('sum(pnl)', 'total_pnl', 4)}, {r('avg(pnl)', 'avg_pnl', 4)}, {r(f'avg(pnl) {WIN}', 'avg_win', 4)}, {r(f'avg(pnl) {LOSS}', 'avg_loss', 4)},
  {r('max(pnl)', 'largest_win', 4)}, {r('min(pnl)', 'largest_loss', 4)}, {r(f'sum(pnl) {WIN} / nullif(abs(sum(pnl) {LOSS}), 0)', 'profit_factor')},
  {r('avg(holding_hours)', 'avg_holding_hours')}, {r("sum(pnl) FILTER (WHERE direction = 'long')", 'long_pnl', 4)}, {r("sum(pnl) FILTER (WHERE direction = 'short')", 'short_pnl', 4)}"""
MONEY = "total_pnl avg_pnl avg_win avg_loss largest_win largest_loss long_pnl short_pnl"


def _stats_columns():
    return [
        "total_trades", "winning_trades", "losing_trades", *rcols("win_rate profit_factor avg_holding_hours"), *rcols(MONEY, 4)
    ]


@query("trade_stats", ledger_of("two_sided"), f"SELECT symbol, {STATS_SQL} FROM two_sided_ledger GROUP BY symbol")
def trade_stats(spark, sf_dir):
    return led.trade_stats(trades(spark, sf_dir, "two_sided"), KEY, DAY).select("symbol", *_stats_columns())


@query("pnl_by_direction_and_reason", ledger_of("two_sided"), f"""
SELECT d.symbol, direction, {r('dp', 'direction_pnl', 4)}, exit_reason, {r('rp', 'reason_pnl', 4)}
FROM (SELECT symbol, direction, sum(pnl) AS dp FROM two_sided_ledger GROUP BY 1, 2) d
JOIN (SELECT symbol, exit_reason, sum(pnl) AS rp FROM two_sided_ledger GROUP BY 1, 2) x USING (symbol)""")
def pnl_by_direction_and_reason(spark, sf_dir):
    """Two maps per symbol, opened again into rows so they can be compared."""
    maps = led.pnl_maps(trades(spark, sf_dir, "two_sided"), KEY)
    one = maps.select("symbol", F.explode("by_direction").alias("direction", "dp"), "by_reason")
    two = one.select("symbol", "direction", "dp", F.explode("by_reason").alias("exit_reason", "rp"))
    return two.select("symbol", "direction", rounded("dp", "direction_pnl", 4), "exit_reason", rounded("rp", "reason_pnl", 4))


DETAIL = {
    "net_profit": "sum(pnl)", "gross_profit": f"sum(pnl) {WIN}", "gross_profit_pct": f"sum(pnl) {WIN} / 100000 * 100",
    "gross_loss": f"abs(sum(pnl) {LOSS})", "gross_loss_pct": f"abs(sum(pnl) {LOSS}) / 100000 * 100", "commission_paid": "sum(trade_value) * 2 * 0.0008",
    "avg_pnl_pct": "avg(pnl_pct)", "avg_win_pct": f"avg(pnl_pct) {WIN}", "avg_loss_pct": f"abs(avg(pnl_pct) {LOSS})",
    "ratio_avg_win_loss": f"avg(pnl) {WIN} / nullif(abs(avg(pnl) {LOSS}), 0)", "largest_win": f"max(pnl) {WIN}", "largest_win_pct": f"max(pnl_pct) {WIN}",
    "largest_loss": f"abs(min(pnl) {LOSS})", "largest_loss_pct": f"abs(min(pnl_pct) {LOSS})", "avg_bars_all": "avg(bars_held)",
    "avg_bars_winners": f"avg(bars_held) {WIN}", "avg_bars_losers": f"avg(bars_held) {LOSS}", "max_position_value": "max(trade_value)",
}


@query("detailed_trade_stats", LEDGER, "SELECT symbol, " + ", ".join(r(e, n, 4) for n, e in DETAIL.items()) + " FROM breakout_ledger GROUP BY symbol")
def detailed_trade_stats(spark, sf_dir):
    stats = led.detailed_stats(trades(spark, sf_dir), KEY, DAY, 100_000.0, 0.08)
    return stats.select("symbol", *[rounded(n, digits=4) for n in DETAIL])


GROUPED = f"count(*) AS trades, {r('sum(pnl)', 'total_pnl', 2)}, {r('avg(pnl)', 'avg_pnl', 2)}"


@query("trade_breakdowns", ledger_of("two_sided"), " UNION ALL ".join(
    f"SELECT '{level}' AS level, CAST({col} AS VARCHAR) AS value, {GROUPED} FROM two_sided_ledger GROUP BY {col}"
    for level, col in (("reason", "exit_reason"), ("direction", "direction"), ("unit", "unit_number"), ("year", "year(exit_time)"))))
def trade_breakdowns(spark, sf_dir):
    """Four groupings in one pass with grouping sets."""
    ledger = trades(spark, sf_dir, "two_sided").withColumn("year", F.year("exit_time"))
    names = {"exit_reason": "reason", "direction": "direction", "unit_number": "unit", "year": "year"}
    sets = ledger.groupingSets([[F.col(c)] for c in names], *names).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl"),
        *[F.grouping(c).alias(f"_{c}") for c in names],
    )
    level = F.coalesce(*[F.when(F.col(f"_{c}") == 0, n) for c, n in names.items()])
    value = F.coalesce(*[F.when(F.col(f"_{c}") == 0, F.col(c).cast("string")) for c in names])
    return sets.select(level.alias("level"), value.alias("value"), "trades", *rcols("total_pnl avg_pnl", 2))


@query("trades_by_entry_year", LEDGER, f"""
SELECT year(entry_time) AS year, {GROUPED}, {r(f'count(*) {WIN} * 100.0 / count(*)', 'win_rate')} FROM breakout_ledger GROUP BY 1""")
def trades_by_entry_year(spark, sf_dir):
    return _yearly(trades(spark, sf_dir))


def _yearly(ledger):
    count = F.count(F.lit(1))
    stats = ledger.groupBy(F.year("entry_time").cast("long").alias("year")).agg(
        count.alias("trades"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl"),
        (F.count_if(led.won()) / count * 100).alias("win_rate"),
    )
    return stats.select("year", "trades", *rcols("total_pnl avg_pnl", 2), *rcols("win_rate"))


@query("losing_years", LEDGER, f"""
SELECT * FROM (SELECT year(entry_time) AS year, {GROUPED}, {r(f'count(*) {WIN} * 100.0 / count(*)', 'win_rate')} FROM breakout_ledger GROUP BY 1)
WHERE total_pnl < 0 ORDER BY total_pnl""")
def losing_years(spark, sf_dir):
    return _yearly(trades(spark, sf_dir)).where(F.col("total_pnl") < 0).orderBy("total_pnl", "year")


PERCENT = (5, 10, 25, 50, 75, 90, 95)


@query("pnl_percentiles", LEDGER, "SELECT " + ", ".join(r(f"quantile_cont(pnl, {p / 100})", f"p{p}", 4) for p in PERCENT) + " FROM breakout_ledger")
def pnl_percentiles(spark, sf_dir):
    found = percentiles(trades(spark, sf_dir), [], "pnl", {f"p{p}": p / 100 for p in PERCENT})
    return found.select(*[rounded(f"p{p}", digits=4) for p in PERCENT])


@query("exit_reason_counts", LEDGER, "SELECT exit_reason, count(*) AS trades FROM breakout_ledger GROUP BY 1")
def exit_reason_counts(spark, sf_dir):
    return trades(spark, sf_dir).groupBy("exit_reason").agg(F.count(F.lit(1)).alias("trades"))


@query("worst_losing_streak", LEDGER, f"""
SELECT symbol, coalesce(max(n), 0) AS worst_streak, {r('coalesce(arg_max(p, n * 100000 - s), 0)', 'streak_pnl', 4)} FROM (SELECT DISTINCT symbol FROM breakout_ledger) LEFT JOIN (
  SELECT symbol, g, count(*) AS n, sum(pnl) AS p, min(trade_id) AS s FROM (
    SELECT *, count(*) FILTER (WHERE NOT pnl < 0) OVER (PARTITION BY symbol ORDER BY trade_id) AS g FROM breakout_ledger) WHERE pnl < 0 GROUP BY 1, 2) USING (symbol)
GROUP BY symbol""")
def worst_losing_streak(spark, sf_dir):
    return led.losing_streak(trades(spark, sf_dir), KEY).select("symbol", "worst_streak", rounded("streak_pnl", digits=4))


@query("streak_lengths", LEDGER, """
SELECT win, length, count(*) AS streaks FROM (SELECT symbol, g, win, count(*) AS length FROM (
  SELECT *, sum(step) OVER (PARTITION BY symbol ORDER BY entry_time, unit_number) AS g FROM (
    SELECT *, CASE WHEN win = lag(win) OVER (PARTITION BY symbol ORDER BY entry_time, unit_number) THEN 0 ELSE 1 END AS step FROM (
      SELECT *, pnl > 0 AS win FROM breakout_ledger))) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def streak_lengths(spark, sf_dir):
    ledger = trades(spark, sf_dir).withColumn("win", led.won())
    numbered = runs(ledger, KEY, ["entry_time", "unit_number"], time_slice("entry_time", DAY), F.col("win"))
    lengths = numbered.groupBy("symbol", "run_id", "win").agg(F.count(F.lit(1)).alias("length"))
    return lengths.groupBy("win", "length").agg(F.count(F.lit(1)).alias("streaks"))


@query("cumulative_pnl", LEDGER, f"SELECT symbol, trade_id, {r('sum(pnl) OVER (PARTITION BY symbol ORDER BY trade_id)', 'cumulative', 4)} FROM breakout_ledger")
def cumulative_pnl(spark, sf_dir):
    summed = running(trades(spark, sf_dir), KEY, ["trade_id"], row_slice("trade_id"), {"cumulative": ("sum", F.col("pnl"))})
    return summed.select("symbol", "trade_id", rounded("cumulative", digits=4))


@query("trade_measures", LEDGER, f"SELECT symbol, trade_id, {rs('trade_value pnl_pct holding_hours', 4)}, bars_held FROM breakout_ledger")
def trade_measures(spark, sf_dir):
    return led.measured(trades(spark, sf_dir), DAY).select("symbol", "trade_id", *rcols("trade_value pnl_pct holding_hours", 4), "bars_held")


@query("trade_returns", LEDGER, f"""SELECT symbol, trade_id, {r('pnl / trade_value', 'ret')}, {r('exit_price / entry_price - 1', 'price_ret')}
FROM breakout_ledger WHERE trade_value > 0""")
def trade_returns(spark, sf_dir):
    return led.trade_returns(trades(spark, sf_dir)).select("symbol", "trade_id", *rcols("ret price_ret"))


@query("expectancy", LEDGER, f"""
SELECT symbol, {r(f'''count(*) {WIN} / count(*) * coalesce(avg(pnl) {WIN}, 0) - count(*) {LOSS} / count(*) * abs(coalesce(avg(pnl) {LOSS}, 0))''', 'expectancy', 4)}
FROM breakout_ledger GROUP BY symbol""")
def expectancy(spark, sf_dir):
    return led.expectancy(led.trade_stats(trades(spark, sf_dir), KEY, DAY)).select("symbol", rounded("expectancy", digits=4))


@query("one_and_two_sided_by_direction", f"{LEDGER} two_sided_state two_sided_last two_sided_trades two_sided_ledger", f"""
SELECT variant, direction, count(*) AS trades, {r('sum(pnl)', 'total_pnl', 2)}, {r(f'count(*) {WIN} * 100.0 / count(*)', 'win_rate')}
FROM (SELECT 'breakout' AS variant, direction, pnl FROM breakout_ledger UNION ALL SELECT 'two_sided', direction, pnl FROM two_sided_ledger) GROUP BY 1, 2""")
def one_and_two_sided_by_direction(spark, sf_dir):
    both = trades(spark, sf_dir).unionByName(trades(spark, sf_dir, "two_sided"))
    count = F.count(F.lit(1))
    stats = both.groupBy(F.col("param_id").alias("variant"), "direction").agg(
        count.alias("trades"), F.sum("pnl").alias("total_pnl"), (F.count_if(led.won()) / count * 100).alias("win_rate")
    )
    return stats.select("variant", "direction", "trades", rounded("total_pnl", digits=2), *rcols("win_rate"))


YEARS = f"{LEDGER} gated filtered_state filtered_last filtered_trades filtered_ledger"
_BY_YEAR = "SELECT year(exit_time) AS year, sum(pnl) AS pnl FROM {}_ledger GROUP BY 1"


def _by_year(ledger, name):
    return ledger.groupBy(F.year("exit_time").cast("long").alias("year")).agg(F.sum("pnl").alias(name))


@query("yearly_comparison", YEARS, f"""
SELECT year, {r('coalesce(a.pnl, 0)', 'plain_pnl', 2)}, {r('coalesce(b.pnl, 0)', 'filtered_pnl', 2)}, {r('coalesce(b.pnl, 0) - coalesce(a.pnl, 0)', 'gain', 2)}
FROM ({_BY_YEAR.format('breakout')}) a FULL JOIN ({_BY_YEAR.format('filtered')}) b USING (year)""")
def yearly_comparison(spark, sf_dir):
    plain = _by_year(trades(spark, sf_dir), "plain_pnl")
    other = _by_year(trades(spark, sf_dir, "filtered"), "filtered_pnl")
    both = plain.join(other, "year", "full_outer").na.fill(0.0, ["plain_pnl", "filtered_pnl"])
    return both.select("year", *rcols("plain_pnl filtered_pnl", 2), rounded(F.col("filtered_pnl") - F.col("plain_pnl"), "gain", 2))


@query("yearly_aligned", YEARS, f"""
SELECT year, {r('a.pnl', 'plain_pnl', 2)}, {r('coalesce(b.pnl, 0)', 'filtered_pnl', 2)} FROM ({_BY_YEAR.format('breakout')}) a
LEFT JOIN ({_BY_YEAR.format('filtered')}) b USING (year)""")
def yearly_aligned(spark, sf_dir):
    plain = _by_year(trades(spark, sf_dir), "plain_pnl")
    other = _by_year(trades(spark, sf_dir, "filtered"), "filtered_pnl")
    return plain.join(other, "year", "left").na.fill(0.0, ["filtered_pnl"]).select("year", *rcols("plain_pnl filtered_pnl", 2))


@query("trading_years", YEARS, "SELECT year(exit_time) AS year FROM breakout_ledger UNION SELECT year(exit_time) FROM filtered_ledger")
def trading_years(spark, sf_dir):
    def of(name):
        return trades(spark, sf_dir, name).select(F.year("exit_time").cast("long").alias("year"))

    return of("breakout").union(of("filtered")).distinct()


@query("winners_on_yearly_totals", LEDGER, f"""
SELECT year(exit_time) AS year, count(*) AS trades, count(*) {WIN} AS winners, {r(f'count(*) {WIN} * 100.0 / count(*)', 'win_rate', 1)} FROM breakout_ledger GROUP BY 1""")
def winners_on_yearly_totals(spark, sf_dir):
    """The join of two groupings is a conditional count."""
    stats = trades(spark, sf_dir).groupBy(F.year("exit_time").cast("long").alias("year")).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(led.won()).alias("winners")
    )
    return stats.withColumn("win_rate", rounded(F.col("winners") * 100.0 / F.col("trades"), digits=1, name="win_rate"))


@query("latest_trades", LEDGER, f"""
SELECT symbol, trade_id, entry_time, {r('pnl', digits=4)} FROM breakout_ledger QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_id DESC) <= 5""")
def latest_trades(spark, sf_dir):
    """Newest five per symbol; Spark keeps only each task's candidates before the shuffle."""
    newest = Window.partitionBy("symbol").orderBy(F.col("trade_id").desc())
    ranked = trades(spark, sf_dir).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= 5)
    return ranked.select("symbol", "trade_id", "entry_time", rounded("pnl", digits=4))


@query("first_and_last_trades", LEDGER, f"""
SELECT symbol, trade_id, part, {r('pnl', digits=4)} FROM (
  SELECT *, 'first' AS part FROM breakout_ledger QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_id) <= 10
  UNION ALL SELECT *, 'last' FROM breakout_ledger QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_id DESC) <= 5)""")
def first_and_last_trades(spark, sf_dir):
    def part(label, order, n):
        ranked = trades(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy(order)))
        return ranked.where(F.col("place") <= n).select("symbol", "trade_id", F.lit(label).alias("part"), "pnl")

    both = part("first", F.col("trade_id").asc(), 10).unionByName(part("last", F.col("trade_id").desc(), 5))
    return both.select("symbol", "trade_id", "part", rounded("pnl", digits=4))


@query("position_wins", ledger_of("ratchet"), f"""
SELECT symbol, count(*) AS positions, count(*) FILTER (WHERE pnl > 0) AS wins, {r('sum(pnl)', 'total_pnl', 4)}, {r('count(*) FILTER (WHERE pnl > 0) * 100.0 / count(*)', 'win_rate')}
FROM (SELECT symbol, position_id, sum(pnl) AS pnl FROM ratchet_ledger GROUP BY 1, 2) GROUP BY symbol""")
def position_wins(spark, sf_dir):
    """Win rate per closed position, whatever the number of units it held."""
    positions = trades(spark, sf_dir, "ratchet").groupBy("symbol", "position_id").agg(F.sum("pnl").alias("pnl"))
    stats = positions.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("positions"), F.count_if(led.won()).alias("wins"), F.sum("pnl").alias("total_pnl")
    )
    return stats.select("symbol", "positions", "wins", rounded("total_pnl", digits=4), rounded(F.col("wins") * 100.0 / F.col("positions"), "win_rate"))


@query("performance_by_market_mode", ledger_of("selective"), f"""
SELECT tag AS mode, count(*) AS trades, {r('sum(pnl)', 'total_pnl', 2)}, {r('avg(pnl)', 'avg_pnl', 2)} FROM selective_ledger GROUP BY 1""")
def performance_by_market_mode(spark, sf_dir):
    stats = trades(spark, sf_dir, "selective").groupBy(F.col("tag").alias("mode")).agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl")
    )
    return stats.select("mode", "trades", *rcols("total_pnl avg_pnl", 2))
