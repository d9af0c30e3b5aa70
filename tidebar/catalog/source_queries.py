"""Raw pages, upserts, logs, states, manual fills and data checks, all derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.equity_queries import EQUITY_STATS, curve, stats
from tidebar.catalog.inputs import DAILY, DAY, FRAME, HOUR, HOURLY, daily, frame, hourly, read
from tidebar.catalog.ledger_queries import LEDGER
from tidebar.catalog.registry import cte, query, r, rcols, rounded, rs
from tidebar.catalog.replay_queries import END_COST, FIRST_ROW, NO_CLOSED, NO_UNITS, UNIT, _profit, _shut, _unit, ledger_ctes, replayed, state_cte, trades
from tidebar.functions.rules import live_rules
from tidebar.functions.times import age_text, epoch_micros, seconds_between
from tidebar.operators.fills import replay_fills
from tidebar.operators.replay import equity_of, trades_of
from tidebar.plans import checks
from tidebar.plans import ledger as led
from tidebar.plans import live
from tidebar.session import Marts, scratch_path
from tidebar.sources import bars as src
from tidebar.sources import files, parse

KEY = ["symbol"]
OHLCV = "open high low close volume"
PAGE = 500


def _pages(bars, fields):
    """Pages of at most 500 bars as JSON arrays of texts."""
    row = F.array(*[f.cast("string") for f in fields])
    page = F.floor((F.col("rn") - 1) / PAGE)
    listed = bars.groupBy("symbol", page.alias("page")).agg(F.array_sort(F.collect_list(F.struct("rn", row.alias("r")))).alias("rows"))
    return listed.select("symbol", "page", F.transform("rows", lambda x: x["r"]).alias("rows"))


@query("parse_klines", HOURLY, f"SELECT symbol, ts, {rs(OHLCV)} FROM hourly")
def parse_klines(spark, sf_dir):
    """Bars written as 12-field pages and parsed back."""
    ms = (epoch_micros("ts") / 1000).cast("long")
    zero = F.lit("0")
    fields = [ms, F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume"), ms + 3_599_999, zero, zero, zero, zero, zero]
    pages = _pages(hourly(spark, sf_dir), fields).select("symbol", F.to_json("rows").alias("payload"))
    return parse.parse_klines(pages).select("symbol", "ts", *rcols(OHLCV))


@query("parse_ohlc_envelope", HOURLY, f"SELECT symbol, 'PAIR' || upper(symbol) AS pair, ts, {rs(OHLCV)} FROM hourly")
def parse_ohlc_envelope(spark, sf_dir):
    """Enveloped pages under a dynamic key, with an error envelope per symbol that must drop out."""
    s = (epoch_micros("ts") / 1_000_000).cast("long")
    fields = [s, F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.lit("0"), F.col("volume"), F.lit("1")]
    pages = _pages(hourly(spark, sf_dir), fields)
    pair = F.concat(F.lit("PAIR"), F.upper("symbol"))
    good = F.concat(F.lit('{"error":[],"result":{"'), pair, F.lit('":'), F.to_json("rows"), F.lit(',"last":1}}'))
    bad = F.lit('{"error":["EGeneral:Busy"],"result":{}}')
    docs = pages.select("symbol", F.explode(F.array(good, bad)).alias("payload"))
    return parse.parse_ohlc_envelope(docs).select("symbol", "pair", "ts", *rcols(OHLCV))


_DUP = """
SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS ts, value AS close, event_id AS load_seq FROM events"""


@query("dedup_bars", "", f"""
SELECT symbol, ts, {r('first(close ORDER BY load_seq)', 'first_close')}, {r('first(close ORDER BY load_seq DESC)', 'last_close')} FROM ({_DUP}) GROUP BY 1, 2""")
def dedup_bars(spark, sf_dir):
    """Many copies per hour: the first and the last loaded survive."""
    copies = read(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), src.floor_time("ts", HOUR).alias("ts"), F.col("value").alias("close"), F.col("event_id").alias("load_seq")
    )
    first = src.dedup_bars(copies, "first").select("symbol", "ts", rounded("close", "first_close"))
    last = src.dedup_bars(copies, "last").select("symbol", "ts", rounded("close", "last_close"))
    return first.join(last, ["symbol", "ts"])


@query("upsert_bars", HOURLY, f"""
SELECT symbol, ts, {r("CASE WHEN ts >= TIMESTAMP '2024-01-10' THEN close * 2 ELSE close END", 'close')} FROM hourly_raw""")
def upsert_bars(spark, sf_dir):
    """Stored bars up to mid-month, fresh bars overlapping them with doubled closes."""
    every = hourly(spark, sf_dir).select("symbol", "ts", "close")
    stored = every.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    fresh = every.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).withColumn("close", F.col("close") * 2)
    return src.upsert_bars(stored, fresh).select("symbol", "ts", *rcols("close"))


@query("bars_in_range", HOURLY, f"SELECT symbol, ts, {rs(OHLCV)} FROM hourly_raw WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def bars_in_range(spark, sf_dir):
    return src.filter_range(hourly(spark, sf_dir), "2024-01-05", "2024-01-20").select("symbol", "ts", *rcols(OHLCV))


@query("daily_bars", DAILY, f"SELECT symbol, ts, {rs(OHLCV)} FROM daily_raw")
def daily_bars(spark, sf_dir):
    from tidebar.catalog.inputs import daily_from_ticks

    return daily_from_ticks(spark, sf_dir).select("symbol", "ts", *rcols(OHLCV))


@query("hourly_bars", HOURLY, f"SELECT symbol, ts, {rs(OHLCV)} FROM hourly_raw")
def hourly_bars(spark, sf_dir):
    from tidebar.catalog.inputs import hourly_from_ticks

    return hourly_from_ticks(spark, sf_dir).select("symbol", "ts", *rcols(OHLCV))


@query("bars_written_and_read", HOURLY, f"SELECT 'csv' AS fmt, symbol, ts, {rs(OHLCV)} FROM hourly_raw UNION ALL SELECT 'parquet', symbol, ts, {rs(OHLCV)} FROM hourly_raw")
def bars_written_and_read(spark, sf_dir):
    """Both sinks and both sources: what was written comes back."""
    bars = hourly(spark, sf_dir).withColumn("timeframe", F.lit("1h")).select("symbol", "timeframe", "ts", *OHLCV.split())
    parts = []
    for fmt in ("csv", "parquet"):
        path = scratch_path(spark, f"bars-{fmt}")
        files.write_bars(bars, path, fmt)
        parts.append(files.read_bars(spark, path, fmt).select(F.lit(fmt).alias("fmt"), "symbol", "ts", *rcols(OHLCV)))
    return parts[0].unionByName(parts[1])


# ---- the live profile: log, state and dashboards

LIVE = live_rules("live")
state_cte("live", "1000", f"""
SELECT symbol, rn, cash1, CASE WHEN len(units3) > 0 THEN 1 ELSE 0 END, units3, CASE WHEN adds THEN close * 1.0005 ELSE level END, 0::DOUBLE, 0::DOUBLE,
  CASE WHEN adds AND len(units1) = 0 THEN pid + 1 ELSE pid END, closed1,
  cash1 + {_profit('units3', '1', 'close')}, coalesce(list_sum(list_transform(units3, lambda z: z.q)), 0) * close
FROM (SELECT *, CASE WHEN live THEN list_transform(units2, lambda z: CAST(struct_pack(t := z.t, px := z.px, q := z.q, n := z.n, stop := greatest(z.stop, close - 3.5 * atr_14), tag := z.tag) AS {UNIT})) ELSE units2 END AS units3
FROM (SELECT *, CASE WHEN adds THEN list_append(units1, {_unit('close * 1.0005', 'size', 'len(units1) + 1', 'close * 1.0005 - 3.5 * atr_14')}) ELSE units1 END AS units2
FROM (SELECT *, live AND len(units1) < 4 AND high > hi_8 AND (len(units1) = 0 OR close >= level + atr_14) AS adds
FROM (SELECT *, greatest(0.0001, least(cash1 * 0.01 / (3.5 * atr_14), 0.1)) AS size
FROM (SELECT *, CASE WHEN why IS NOT NULL THEN {_shut('units', '1', 'close * 0.9995', 'why')} ELSE {NO_CLOSED} END AS closed1,
             CASE WHEN why IS NOT NULL THEN cash + {_profit('units', '1', 'close * 0.9995')} ELSE cash END AS cash1, CASE WHEN why IS NOT NULL THEN {NO_UNITS} ELSE units END AS units1
FROM (SELECT *, CASE WHEN NOT live OR len(units) = 0 THEN NULL WHEN low < lo_16 THEN 'Donchian Exit'
                     WHEN len(list_filter(units, lambda z: close <= z.stop)) > 0 THEN 'Trailing Stop' END AS why
FROM (SELECT *, rn > 20 AND atr_14 > 0 AND hi_8 IS NOT NULL AS live FROM @STEP)))))))""")
END_COST["live"] = "side * 0.0005"
FIRST_ROW["live"] = 21
ledger_ctes("live", "frame", "symbol", "live")
LIVE_CTES = f"{FRAME} live_state live_last live_trades"


def _live(spark, sf_dir):
    return Marts.table(spark, sf_dir, "replay_live", lambda: replayed(spark, sf_dir, LIVE), ("kind",))


def live_trades(spark, sf_dir):
    return trades_of(_live(spark, sf_dir))


@query("replay_live_trades", LIVE_CTES, f"""
SELECT symbol, entry_time, exit_time, {rs('entry_price exit_price quantity pnl')}, exit_reason, unit_number, position_id FROM live_trades""")
def replay_live_trades(spark, sf_dir):
    return live_trades(spark, sf_dir).select(
        "symbol", "entry_time", "exit_time", *rcols("entry_price exit_price quantity pnl"), "exit_reason", "unit_number", F.col("position_id").cast("int").alias("position_id")
    )


cte("live_event", """
SELECT *, 1000 + coalesce(sum(pnl) OVER (PARTITION BY symbol ORDER BY ts, side, place), 0) AS equity FROM (
  SELECT symbol, 'ENTRY' AS type, CASE WHEN unit_number = 1 THEN 'Breakout' ELSE 'Pyramid' END AS reason, entry_time AS ts, entry_price AS price, quantity AS size, NULL::DOUBLE AS pnl, 1 AS side, unit_number AS place FROM live_trades
  UNION ALL SELECT symbol, 'EXIT', exit_reason, exit_time, exit_price, sum(quantity), sum(pnl), 0, position_id FROM live_trades WHERE exit_reason <> 'End of Backtest' GROUP BY symbol, position_id, exit_time, exit_reason, exit_price)""")


def _log(spark, sf_dir):
    """Events written as monthly JSON documents and parsed back."""

    def build():
        events = live.events_of(live_trades(spark, sf_dir), KEY, LIVE.capital)
        return parse.parse_trade_log(live.log_documents(events, KEY, "V4"))

    return Marts.table(spark, sf_dir, "live_log", build)


@query("read_trade_log", f"{LIVE_CTES} live_event", f"""
SELECT symbol, type, reason, ts, strftime(ts, '%Y-%m-%dT%H:%M') AS minute, 'V4' AS strategy, {rs('price size equity pnl')} FROM live_event""")
def read_trade_log(spark, sf_dir):
    return _log(spark, sf_dir).select("symbol", "type", "reason", "ts", F.substring("time", 1, 16).alias("minute"), "strategy", *rcols("price size equity pnl"))


LIVE_VALUES = "win_rate avg_win avg_loss profit_factor total_pnl max_dd_pct"
cte("live_stat", """
SELECT symbol, count(*) FILTER (WHERE type = 'ENTRY') AS entries, count(*) FILTER (WHERE type = 'EXIT') AS exits, count(*) FILTER (WHERE pnl > 0) * 100.0 / nullif(count(*) FILTER (WHERE type = 'EXIT'), 0) AS win_rate,
  avg(pnl) FILTER (WHERE pnl > 0) AS avg_win, avg(pnl) FILTER (WHERE pnl < 0) AS avg_loss, sum(pnl) FILTER (WHERE pnl > 0) / nullif(abs(sum(pnl) FILTER (WHERE pnl < 0)), 0) AS profit_factor,
  coalesce(sum(pnl), 0) AS total_pnl, max((peak - equity) / peak * 100) AS max_dd_pct
FROM (SELECT *, greatest(max(equity) OVER (PARTITION BY symbol ORDER BY ts, side, place), 1000) AS peak FROM live_event) GROUP BY symbol""")


def _live_stats(spark, sf_dir):
    ranked = _log(spark, sf_dir).withColumn("rank", F.when(F.col("type") == "EXIT", 0).otherwise(1))
    return live.live_stats(ranked, KEY, LIVE.capital)


@query("live_log_stats", f"{LIVE_CTES} live_event live_stat", f"SELECT symbol, entries, exits, {rs(LIVE_VALUES)} FROM live_stat")
def live_log_stats(spark, sf_dir):
    return _live_stats(spark, sf_dir).select("symbol", "entries", "exits", *rcols(LIVE_VALUES))


@query("paper_drift", f"{LIVE_CTES} live_event live_stat breakout_state breakout_last breakout_trades breakout_ledger", f"""
SELECT symbol, {r('abs(win_rate - expected)', 'gap')}, abs(win_rate - expected) <= 10 AS within, CASE WHEN max_dd_pct > 50 OR profit_factor < 1 THEN 'stop' WHEN win_rate < 35 OR win_rate > 55 THEN 'investigate' ELSE 'ready' END AS status
FROM live_stat JOIN (SELECT symbol, count(*) FILTER (WHERE pnl > 0) * 100.0 / count(*) AS expected FROM breakout_ledger GROUP BY 1) USING (symbol)""")
def paper_drift(spark, sf_dir):
    found = live.drift(_live_stats(spark, sf_dir), led.trade_stats(trades(spark, sf_dir), KEY, DAY), KEY)
    return found.select("symbol", rounded("gap"), "within", "status")


def _states(spark, sf_dir):
    return parse.parse_state(live.state_documents(live_trades(spark, sf_dir), KEY, LIVE.capital))


cte("live_doc", """
SELECT symbol, 1000 + coalesce(sum(pnl) FILTER (WHERE exit_reason <> 'End of Backtest'), 0) AS equity, coalesce(sum(quantity) FILTER (WHERE exit_reason = 'End of Backtest'), 0) AS position_size,
  count(*) FILTER (WHERE exit_reason = 'End of Backtest') AS units, count(*) AS trade_count FROM live_trades GROUP BY symbol""")


@query("read_state", f"{LIVE_CTES} live_doc", f"SELECT symbol, 'V4' AS strategy, 1000.0::DOUBLE AS initial_capital, {r('equity')}, {r('position_size', digits=8)}, units, trade_count FROM live_doc")
def read_state(spark, sf_dir):
    """Documents without a strategy, capital or position come back with the defaults."""
    return _states(spark, sf_dir).select(
        "symbol", "strategy", "initial_capital", *rcols("equity"), rounded("position_size", digits=8), F.size("position_units").cast("long").alias("units"), "trade_count"
    )


cte("open_unit", """
SELECT t.symbol, unit_number, entry_price, quantity, (price - entry_price) * quantity AS gain, (price / entry_price - 1) * 100 AS gain_pct
FROM live_trades t JOIN (SELECT symbol, arg_max(close, ts) AS price FROM daily GROUP BY 1) p ON p.symbol = t.symbol WHERE exit_reason = 'End of Backtest'""")


def _open_units(spark, sf_dir):
    return live.marked_units(parse.open_units(_states(spark, sf_dir)), daily(spark, sf_dir), KEY)


@query("open_units", f"{LIVE_CTES} open_unit", f"SELECT symbol, {rs('entry_price gain gain_pct')}, {r('quantity', 'size', 8)} FROM open_unit")
def open_units(spark, sf_dir):
    return _open_units(spark, sf_dir).select("symbol", *rcols("entry_price gain gain_pct"), rounded("size", digits=8))


@query("open_positions", f"{LIVE_CTES} open_unit", f"SELECT symbol, count(*) AS units, {r('sum(gain)', 'gain')}, {r('sum(gain) * 100 / nullif(sum(entry_price * quantity), 0)', 'gain_pct')} FROM open_unit GROUP BY symbol")
def open_positions(spark, sf_dir):
    return live.marked_positions(_open_units(spark, sf_dir), KEY).select("symbol", "units", *rcols("gain gain_pct"))


@query("combined_equity", f"{LIVE_CTES} live_doc breakout_state breakout_last breakout_equity", f"""
SELECT symbol, {r('equity + e', 'equity', 4)}, {r('((equity + e) / 101000 - 1) * 100', 'return_pct')} FROM live_doc JOIN (SELECT symbol, arg_max(equity, rn) AS e FROM breakout_equity GROUP BY 1) USING (symbol)""")
def combined_equity(spark, sf_dir):
    """Two strategies per symbol summed against their joint start."""
    one = _states(spark, sf_dir).select("symbol", "equity", F.lit(LIVE.capital).alias("start"))
    two = curve(spark, sf_dir).groupBy("symbol").agg(F.max_by("equity", "rn").alias("equity")).withColumn("start", F.lit(100_000.0))
    total = one.unionByName(two).groupBy("symbol").agg(F.sum("equity").alias("equity"), F.sum("start").alias("start"))
    return total.select("symbol", rounded("equity", digits=4), rounded((F.col("equity") / F.col("start") - 1) * 100, "return_pct"))


@query("log_age", f"{LIVE_CTES} live_event", """
SELECT symbol, CASE WHEN s < 60 THEN 'Just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm ago' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || 'h ago' ELSE floor(s / 86400)::BIGINT || 'd ago' END AS age
FROM (SELECT symbol, epoch(TIMESTAMP '2002-01-01' - max(ts)) AS s FROM live_event GROUP BY symbol)""")
def log_age(spark, sf_dir):
    last = _log(spark, sf_dir).groupBy("symbol").agg(F.max("ts").alias("ts"))
    return last.select("symbol", age_text(seconds_between("ts", F.lit("2002-01-01").cast("timestamp_ntz"))).alias("age"))


# ---- hand-entered fills, one account per customer

cte("fill", """
SELECT CAST(o_custkey AS VARCHAR) AS account, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderdate AS ts,
  CASE o_orderstatus WHEN 'O' THEN 'BUY' WHEN 'F' THEN 'SELL' ELSE 'CLOSE' END AS action, o_totalprice / 1000 AS price, 1.0::DOUBLE + o_orderkey % 5 AS quantity FROM orders""")


def fill_state(name: str, long_only: bool) -> None:
    opens = "false" if long_only else "true"
    cte(name, f"""
SELECT account, CAST(0 AS BIGINT), 0::DOUBLE, 0::DOUBLE, 0, NULL::DOUBLE, 100000::DOUBLE FROM fill WHERE seq = 1
UNION ALL
SELECT account, seq,
  CASE WHEN action = 'CLOSE' THEN 0 WHEN side * pos > 0 THEN pos + side * quantity WHEN side > 0 OR {opens} THEN side * quantity ELSE 0 END,
  CASE WHEN action = 'CLOSE' THEN average WHEN side * pos > 0 THEN (average * abs(pos) + price * quantity) / (abs(pos) + quantity) WHEN side > 0 OR {opens} THEN price ELSE average END,
  CASE WHEN action = 'CLOSE' THEN 0 WHEN side * pos > 0 THEN units + 1 WHEN side > 0 OR {opens} THEN 1 ELSE units END,
  CASE WHEN action = 'CLOSE' THEN pos * (price - average) WHEN side * pos > 0 OR pos = 0 THEN NULL ELSE pos * (price - average) END,
  capital + CASE WHEN action = 'CLOSE' OR side * pos < 0 THEN pos * (price - average) ELSE 0 END
FROM (SELECT f.*, s.pos, s.average, s.units, s.capital, CASE f.action WHEN 'BUY' THEN 1 ELSE -1 END AS side FROM {name} s JOIN fill f ON f.account = s.account AND f.seq = s.seq + 1)""",
        "account, seq, pos, average, units, pnl, capital")


def _register_fills(name: str, long_only: bool) -> None:
    fill_state(name, long_only)

    @query(f"manual_{name}", f"fill {name}", f"SELECT account, seq, {r('pos', 'position')}, {r('average', 'avg_price')}, units, {r('pnl')}, {r('capital')} FROM {name} WHERE seq > 0")
    def run(spark, sf_dir):
        orders = read(spark, sf_dir, "orders")
        action = F.when(F.col("o_orderstatus") == "O", "BUY").when(F.col("o_orderstatus") == "F", "SELL").otherwise("CLOSE")
        made = orders.select(
            F.col("o_custkey").cast("string").alias("account"), F.col("o_orderdate").alias("ts"), "o_orderkey", action.alias("action"),
            (F.col("o_totalprice") / 1000).alias("price"), (F.lit(1.0) + F.col("o_orderkey") % 5).alias("quantity"),
        )
        done = replay_fills(made, ["account"], ["ts", "o_orderkey"], 100_000.0, long_only)
        return done.select("account", "seq", rounded("position"), rounded("avg_price"), "units", *rcols("pnl capital"))


_register_fills("fills_long_only", True)
_register_fills("fills_two_sided", False)


# ---- forward-test snapshots and checks

@query("daily_equity_snapshots", f"{LIVE_CTES} live_equity", f"SELECT symbol, CAST(ts AS DATE) AS date, {r('equity')}, {r('position_value')}, {r('close', 'price')} FROM live_equity")
def daily_equity_snapshots(spark, sf_dir):
    last = equity_of(_live(spark, sf_dir)).groupBy("symbol", F.to_date("ts").alias("date")).agg(
        *[F.max_by(c, "ts").alias(c) for c in ("equity", "position_value", "close")]
    )
    return last.select("symbol", "date", *rcols("equity position_value"), rounded("close", "price"))


@query("forward_summary", f"{LIVE_CTES} live_equity", f"""
SELECT symbol, count(*) AS days, {r('(arg_max(equity, rn) / 1000 - 1) * 100', 'return_pct')}, {r('min((equity - peak) / peak) * 100', 'max_dd_pct')}, any_value(wins) AS wins, any_value(losses) AS losses
FROM (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY rn) AS peak FROM live_equity)
JOIN (SELECT symbol, count(*) FILTER (WHERE pnl > 0) AS wins, count(*) FILTER (WHERE pnl < 0) AS losses FROM live_trades GROUP BY 1) USING (symbol) GROUP BY symbol""")
def forward_summary(spark, sf_dir):
    from tidebar.operators.windows import row_slice, running

    peaked = running(equity_of(_live(spark, sf_dir)), KEY, ["rn"], row_slice(), {"peak": ("max", F.col("equity"))})
    deals = live_trades(spark, sf_dir).groupBy("symbol").agg(F.count_if(led.won()).alias("wins"), F.count_if(led.lost()).alias("losses"))
    by = peaked.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), F.max_by("equity", "rn").alias("final"), F.min((F.col("equity") - F.col("peak")) / F.col("peak")).alias("dd")
    )
    return by.join(deals, "symbol").select(
        "symbol", "days", rounded((F.col("final") / LIVE.capital - 1) * 100, "return_pct"), rounded(F.col("dd") * 100, "max_dd_pct"), "wins", "losses"
    )


@query("ledger_checks", f"{LEDGER} breakout_equity", """
SELECT symbol, count(l.trade_id) AS trades, count(DISTINCT l.entry_time) AS entry_times,
       count(*) FILTER (pnl > 0) + count(*) FILTER (pnl < 0) <= count(l.trade_id) AS counts_ok, abs(coalesce(sum(pnl), 0) - (any_value(e) - 100000)) < 1e-4 AS pnl_ok,
       count(*) FILTER (l.trade_id IS NOT NULL AND l.exit_time IS NULL) = 0 AS exits_ok
FROM (SELECT symbol, arg_max(equity, rn) AS e FROM breakout_equity GROUP BY symbol) LEFT JOIN breakout_ledger l USING (symbol) GROUP BY symbol""")
def ledger_checks(spark, sf_dir):
    return checks.ledger_checks(trades(spark, sf_dir), curve(spark, sf_dir), KEY, 100_000.0)


@query("expectations", EQUITY_STATS, f"""
SELECT symbol, measure, {r('value')}, bound AS "limit", coalesce(value > bound, false) AS passed FROM (
  SELECT symbol, 'total_return_pct' AS measure, total_return_pct AS value, 0::DOUBLE AS bound FROM equity_stat UNION ALL
  SELECT symbol, 'max_drawdown_pct', max_drawdown_pct, -45 FROM equity_stat UNION ALL SELECT symbol, 'sharpe', sharpe, 0.5 FROM equity_stat)""")
def expectations(spark, sf_dir):
    found = checks.expectations(stats(spark, sf_dir), KEY, {"total_return_pct": (">", 0), "max_drawdown_pct": (">", -45), "sharpe": (">", 0.5)})
    return found.select("symbol", "measure", rounded("value"), "limit", "passed")
