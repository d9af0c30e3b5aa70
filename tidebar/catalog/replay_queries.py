"""Rule replay: ledgers and equity curves of every profile, against recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.catalog.inputs import FRAME, frame
from tidebar.catalog.registry import cte, query, r, rcols, rs
from tidebar.catalog.signal_queries import MODE_SQL, TREND_REGIME_SQL
from tidebar.functions.rules import PROFILES, band_rules, breakout_rules
from tidebar.operators.replay import equity_of, open_positions, reads_slow_average, replay, trades_of
from tidebar.session import Marts

RULES = {name: make(name) for name, make in PROFILES.items() if name not in ("live", "band")}
RULES["two_sided"] = breakout_rules("two_sided", long_only=False)
RULES["band"] = band_rules("band", entry_len=12, exit_len=6, trend_len=50, band=(0.5, 60.0))


def result(spark, sf_dir, name):
    return Marts.table(spark, sf_dir, f"replay_{name}", lambda: replayed(spark, sf_dir, RULES[name]), partition_by=("kind",))


def replayed(spark, sf_dir, rules):
    bars = frame(spark, sf_dir, ema=reads_slow_average([rules]), placed=True)
    return replay(bars, [rules], placed=True)


def trades(spark, sf_dir, name="breakout"):
    return trades_of(result(spark, sf_dir, name))


def equity(spark, sf_dir, name="breakout"):
    return equity_of(result(spark, sf_dir, name))


UNIT = "STRUCT(t TIMESTAMP, px DOUBLE, q DOUBLE, n INTEGER, stop DOUBLE, tag VARCHAR)"
CLOSED = "STRUCT(t TIMESTAMP, px DOUBLE, q DOUBLE, n INTEGER, tag VARCHAR, side INTEGER, xpx DOUBLE, why VARCHAR)"


def _unit(px: str, q: str, n: str, stop: str = "NULL", tag: str = "NULL") -> str:
    return f"CAST(struct_pack(t := ts, px := {px}, q := {q}, n := {n}, stop := {stop}, tag := {tag}) AS {UNIT})"


def _shut(units: str, side: str, xpx: str, why: str) -> str:
    return (
        f"list_transform({units}, lambda z: CAST(struct_pack(t := z.t, px := z.px, q := z.q, n := z.n, tag := z.tag, "
        f"side := {side}, xpx := {xpx}, why := {why}) AS {CLOSED}))"
    )


def _profit(units: str, side: str, price: str) -> str:
    return f"coalesce(list_sum(list_transform({units}, lambda z: {side} * z.q * ({price} - z.px))), 0)"


NO_UNITS, NO_CLOSED = f"CAST([] AS {UNIT}[])", f"CAST([] AS {CLOSED}[])"


def _lots(cash: str, risk: str, stop: str, lot: str, least: str, scale: str = "1") -> str:
    return f"greatest({least}, round_even({cash} * ({risk}) / ({stop}) * ({scale}) / {lot}, 0) * {lot})"


def state_cte(name: str, seed: str, body: str, source: str = "frame", keys: str = "symbol") -> None:
    """Fold over bars: ``body`` turns the previous state joined with the next bar into the next state."""
    shape = f"{keys}, rn, cash, side, units, level, best, peak, pid, closed, equity, value"
    join = " AND ".join(f"b.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    start = (
        f"SELECT {keys}, rn, {seed}::DOUBLE, 0, {NO_UNITS}, 0::DOUBLE, 0::DOUBLE, {seed}::DOUBLE, 0, {NO_CLOSED}, {seed}::DOUBLE, 0::DOUBLE "
        f"FROM {source} WHERE rn = 1"
    )
    step = f"(SELECT b.*, s.cash, s.side, s.units, s.level, s.best, s.peak, s.pid FROM {name}_state s JOIN {source} b ON {join} AND b.rn = s.rn + 1)"
    cte(f"{name}_state", f"{start}\nUNION ALL\n{body.replace('@STEP', step)}", shape)


def breakout_body(long_only: bool, keys: str = "symbol") -> str:
    short = "false" if long_only else "close < lo_40 AND close < ema200"
    return f"""
SELECT {keys}, rn, cash2, side3, units4, level4, best3, 0::DOUBLE, pid3, closed2,
  cash2 + {_profit('units4', 'side3', 'close')}, side3 * coalesce(list_sum(list_transform(units4, lambda z: z.q)), 0) * close
FROM (SELECT *, CASE WHEN adds THEN list_append(units3, {_unit('close * (1 + side3 * 0.0013)', 'size', 'len(units3) + 1')}) ELSE units3 END AS units4,
             CASE WHEN adds THEN close ELSE level3 END AS level4
FROM (SELECT *, live AND side3 <> 0 AND len(units3) < 4 AND CASE WHEN side3 > 0 THEN high >= level3 + 1.5 * atr_20 ELSE low <= level3 - 1.5 * atr_20 END AS adds
FROM (SELECT *, CASE WHEN opens THEN CASE WHEN goes_long THEN 1 ELSE -1 END ELSE side1 END AS side3,
             CASE WHEN opens THEN [{_unit('close * (1 + CASE WHEN goes_long THEN 1 ELSE -1 END * 0.0013)', 'size', '1')}] ELSE units1 END AS units3,
             CASE WHEN opens THEN close ELSE level END AS level3,
             CASE WHEN opens THEN CASE WHEN goes_long THEN high ELSE low END ELSE best1 END AS best3, CASE WHEN opens THEN pid + 1 ELSE pid END AS pid3
FROM (SELECT *, {_lots('cash2', '0.01', 'atr_20 * 2', '0.001', '0.001')} AS size
FROM (SELECT *, opens AND side1 <> 0 AS flips,
             CASE WHEN opens AND side1 <> 0 THEN list_concat(closed1, {_shut('units1', 'side1', 'close * (1 - side1 * 0.0013)', "'Reversal'")}) ELSE closed1 END AS closed2,
             CASE WHEN opens AND side1 <> 0 THEN cash1 + {_profit('units1', 'side1', 'close * (1 - side1 * 0.0013)')} ELSE cash1 END AS cash2
FROM (SELECT *, (goes_long OR goes_short) AS opens
FROM (SELECT *, live AND close > hi_40 AND side1 <= 0 AS goes_long, live AND NOT coalesce(close > hi_40, false) AND ({short}) AND side1 >= 0 AS goes_short
FROM (SELECT *, CASE WHEN hit OR leaves THEN {_shut('units', 'side', 'xpx', 'why')} ELSE {NO_CLOSED} END AS closed1,
             CASE WHEN hit OR leaves THEN cash + {_profit('units', 'side', 'xpx')} ELSE cash END AS cash1,
             CASE WHEN hit OR leaves THEN 0 ELSE side END AS side1, CASE WHEN hit OR leaves THEN {NO_UNITS} ELSE units END AS units1
FROM (SELECT *, (CASE WHEN hit THEN stop ELSE close END) * (1 - side * 0.0013) AS xpx, CASE WHEN hit THEN 'Trailing Stop' ELSE 'Donchian Exit' END AS why
FROM (SELECT *, live AND side <> 0 AND NOT hit AND CASE WHEN side > 0 THEN close < lo_16 ELSE close > hi_16 END AS leaves
FROM (SELECT *, live AND CASE WHEN side > 0 THEN low <= stop WHEN side < 0 THEN high >= stop ELSE false END AS hit
FROM (SELECT *, best1 - side * 4.0 * atr_20 AS stop
FROM (SELECT *, rn > 201 AND atr_20 IS NOT NULL AND hi_40 IS NOT NULL AS live,
             CASE WHEN rn > 201 AND side > 0 THEN greatest(best, high) WHEN rn > 201 AND side < 0 THEN least(best, low) ELSE best END AS best1
FROM @STEP)))))))))))))"""


state_cte("breakout", "100000", breakout_body(True))
state_cte("two_sided", "100000", breakout_body(False))
state_cte("intrabar", "100000", f"""
SELECT symbol, rn, cash1, CASE WHEN len(units2) > 0 THEN 1 ELSE 0 END, units2, CASE WHEN adds THEN hi_12 * 1.0013 ELSE level END,
  CASE WHEN adds THEN high ELSE best1 END, 0::DOUBLE, CASE WHEN adds AND len(units1) = 0 THEN pid + 1 ELSE pid END, closed1,
  cash1 + {_profit('units2', '1', 'close')}, coalesce(list_sum(list_transform(units2, lambda z: z.q)), 0) * close
FROM (SELECT *, CASE WHEN adds THEN list_append(units1, {_unit('hi_12 * 1.0013', _lots('cash1', '0.005', '2 * atr_14', '0.0001', '0.001'), 'len(units1) + 1')}) ELSE units1 END AS units2
FROM (SELECT *, live AND len(units1) < 3 AND NOT coalesce(close < ema200, false) AND high > hi_12 AND (len(units1) = 0 OR close >= level + atr_14) AS adds
FROM (SELECT *, CASE WHEN why IS NOT NULL THEN {_shut('units', '1', 'xpx', 'why')} ELSE {NO_CLOSED} END AS closed1,
             CASE WHEN why IS NOT NULL THEN cash + {_profit('units', '1', 'xpx')} ELSE cash END AS cash1, CASE WHEN why IS NOT NULL THEN {NO_UNITS} ELSE units END AS units1
FROM (SELECT *, (CASE WHEN why = 'Trail Stop' THEN best1 - 2.5 * atr_14 ELSE lo_6 END) * 0.9987 AS xpx
FROM (SELECT *, CASE WHEN NOT live OR side = 0 THEN NULL WHEN low <= best1 - 2.5 * atr_14 THEN 'Trail Stop' WHEN low <= lo_6 THEN 'Donchian Exit' END AS why
FROM (SELECT *, rn > 201 AND atr_14 IS NOT NULL AND hi_12 IS NOT NULL AS live, CASE WHEN rn > 201 AND side > 0 THEN greatest(best, high) ELSE best END AS best1
FROM @STEP))))))""")
def ratchet_body(keys: str = "symbol") -> str:
    return f"""
SELECT {keys}, rn, cash1, CASE WHEN len(units2) > 0 THEN 1 ELSE 0 END, units2, CASE WHEN adds THEN close ELSE level END, 0::DOUBLE, 0::DOUBLE,
  CASE WHEN adds AND len(units1) = 0 THEN pid + 1 ELSE pid END, closed1,
  cash1 + {_profit('units2', '1', 'close')}, coalesce(list_sum(list_transform(units2, lambda z: z.q)), 0) * close
FROM (SELECT *, CASE WHEN adds THEN list_append(units1, {_unit('close', 'size', 'len(units1) + 1', 'close - 3.5 * atrp_14')}) ELSE units1 END AS units2
FROM (SELECT *, live AND len(units1) < 4 AND high > hi_8 AND (len(units1) = 0 OR close >= level + atrp_14) AND size * close > 10 AS adds
FROM (SELECT *, least(cash1 * 0.01 / (3.5 * atrp_14), cash1 * 0.25 / close) AS size
FROM (SELECT *, CASE WHEN why IS NOT NULL THEN {_shut('units', '1', 'close', 'why')} ELSE {NO_CLOSED} END AS closed1,
             CASE WHEN why IS NOT NULL THEN cash + {_profit('units', '1', 'close')} ELSE cash END AS cash1,
             CASE WHEN why IS NOT NULL THEN {NO_UNITS} WHEN live THEN list_transform(units, lambda z: CAST(struct_pack(t := z.t, px := z.px, q := z.q, n := z.n,
                  stop := greatest(z.stop, close - 3.5 * atrp_14), tag := z.tag) AS {UNIT})) ELSE units END AS units1
FROM (SELECT *, CASE WHEN NOT live OR len(units) = 0 THEN NULL WHEN low < lo_16 THEN 'Donchian'
                     WHEN len(list_filter(units, lambda z: close <= z.stop)) > 0 THEN 'Stop' END AS why
FROM (SELECT *, rn > 110 AND atrp_14 > 0 AND hi_8 IS NOT NULL AS live FROM @STEP))))))"""


state_cte("ratchet", "10000", ratchet_body())
_BAND = ratchet_body().replace("hi_8", "hi_12").replace("lo_16", "lo_6").replace("atrp_14", "atr_14").replace("3.5 *", "3.0 *").replace("rn > 110", "rn > 60")
_BAND = _BAND.replace("'Donchian'", "'Donchian Exit'").replace("'Stop'", "'Trailing Stop'")
state_cte("band", "10000", _BAND.replace("live AND len(units1) < 4", "live AND coalesce(close > sma50 AND atr_14 / close * 100 BETWEEN 0.5 AND 60.0, false) AND len(units1) < 4"))


def _filtered_body(gate: str, scale: str, tag: str, cut: bool) -> str:
    dd = "CASE WHEN (peak1 - cash1) / peak1 > 0.15 THEN 0.5 ELSE 1 END" if cut else "1"
    shut = (
        "list_transform(list_filter(moved, lambda z: low <= z.stop OR low <= lo_16), lambda z: CAST(struct_pack(t := z.t, px := z.px, q := z.q, n := z.n, "
        "tag := z.tag, side := 1, xpx := (CASE WHEN low <= z.stop THEN least(close, z.stop) ELSE close END) * 0.9995, "
        f"why := CASE WHEN low <= z.stop THEN 'Trailing Stop' ELSE 'Donchian Exit' END) AS {CLOSED}))"
    )
    net = "coalesce(list_sum(list_transform({}, lambda z: z.q * (z.xpx - z.px) - (z.px + z.xpx) * z.q * 0.0008)), 0)"
    return f"""
SELECT symbol, rn, cash1, CASE WHEN len(units2) > 0 THEN 1 ELSE 0 END, units2, CASE WHEN adds THEN price ELSE level END, 0::DOUBLE, peak1,
  CASE WHEN adds AND len(units1) = 0 THEN pid + 1 ELSE pid END, closed1,
  cash1 + CASE WHEN live THEN {_profit('units2', '1', 'close')} ELSE 0 END, coalesce(list_sum(list_transform(units2, lambda z: z.q)), 0) * close
FROM (SELECT *, CASE WHEN adds THEN list_append(units1, {_unit('price', 'size', 'len(units1) + 1', 'price - 2 * atr_20', tag)}) ELSE units1 END AS units2
FROM (SELECT *, wants AND coalesce(list_sum(list_transform(units1, lambda z: z.q * z.px)), 0) + size * price <= cash1 * 0.95 AS adds
FROM (SELECT *, {_lots('cash1', '0.01', '2 * atr_20', '0.001', '0.001', f'({scale}) * ({dd})')} AS size
FROM (SELECT *, CASE WHEN wants THEN greatest(peak, cash1) ELSE peak END AS peak1, (CASE WHEN len(units1) = 0 THEN hi_40 ELSE close END) * 1.0005 AS price
FROM (SELECT *, live AND ({gate}) AND len(units1) < 4 AND coalesce(high >= hi_40, false) AND (len(units1) = 0 OR close >= level + 1.5 * atr_20) AS wants
FROM (SELECT *, cash + {net.format('closed1')} AS cash1, CASE WHEN live THEN list_filter(moved, lambda z: NOT (low <= z.stop OR coalesce(low <= lo_16, false))) ELSE units END AS units1
FROM (SELECT *, CASE WHEN live THEN {shut} ELSE {NO_CLOSED} END AS closed1
FROM (SELECT *, list_transform(units, lambda z: CAST(struct_pack(t := z.t, px := z.px, q := z.q, n := z.n, stop := greatest(z.stop, close - 4.0 * atr_20), tag := z.tag) AS {UNIT})) AS moved
FROM (SELECT *, rn > 210 AND atr_20 > 0 AS live FROM @STEP)))))))))"""


cte("gated", f"""
SELECT *, coalesce(close > sma200, false) AND NOT coalesce(rsi14 < 45, false) AND trend_label <> 'Bear' AS may, mode_label <> 'Severe Bear' AS may_mode,
  CASE WHEN vol50 > 0 THEN least(greatest(0.02 / vol50, 0.5), 2.0) ELSE 1 END AS vol_scale, CASE mode_label WHEN 'Mild Bear' THEN 0.5 WHEN 'Severe Bear' THEN 0 ELSE 1 END AS mode_scale
FROM (SELECT *, {TREND_REGIME_SQL} AS trend_label, {MODE_SQL} AS mode_label FROM frame)""")
state_cte("filtered", "1000", _filtered_body("may", "vol_scale", "trend_label", True), "gated")
state_cte("selective", "1000", _filtered_body("may_mode", "mode_scale", "mode_label", False), "gated")

END_COST = {"breakout": "side * 0.0013", "two_sided": "side * 0.0013", "intrabar": "0", "ratchet": "0", "band": "0", "filtered": "0", "selective": "0"}
FEES = {"filtered": "(px + xpx) * q * 0.0008", "selective": "(px + xpx) * q * 0.0008"}
FIRST_ROW = {"ratchet": 111, "band": 61, "filtered": 211, "selective": 211}


def ledger_ctes(name: str, source: str = "frame", keys: str = "symbol", rules: str | None = None) -> None:
    rules = rules or name
    on = " AND ".join(f"b.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    cost = END_COST[rules]
    cte(f"{name}_last", f"SELECT {keys}, max(rn) AS rn FROM {source} GROUP BY {keys}")
    cte(
        f"{name}_trades",
        f"""
SELECT {keys}, rn, t AS entry_time, exit_time, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS direction, px AS entry_price, xpx AS exit_price, q AS quantity,
  side * q * (xpx - px) - {FEES.get(rules, '0')} AS pnl, why AS exit_reason, n AS unit_number, tag, pid AS position_id
FROM (SELECT {keys}, rn, ts AS exit_time, pid, c.t, c.px, c.q, c.n, c.tag, c.side, c.xpx, c.why FROM (
        SELECT s.{keys.replace(', ', ', s.')}, s.rn, b.ts, s.pid - CASE WHEN len(s.closed) > 0 AND len(s.units) > 0 AND s.units[1].t = b.ts THEN 1 ELSE 0 END AS pid,
               unnest(s.closed) AS c FROM {name}_state s JOIN {source} b ON {on} AND b.rn = s.rn)
      UNION ALL
      SELECT {keys}, rn, ts, pid, u.t, u.px, u.q, u.n, u.tag, side, close * (1 - {cost}), 'End of Backtest' FROM (
        SELECT s.{keys.replace(', ', ', s.')}, s.rn, b.ts, b.close, s.pid, s.side, unnest(s.units) AS u
        FROM {name}_state s JOIN {source} b ON {on} AND b.rn = s.rn JOIN {name}_last l ON {on.replace('b.', 'l.')} AND l.rn = s.rn))""",
    )
    closing = "" if rules in ("filtered", "selective") else f"CASE WHEN s.rn = l.rn THEN s.cash + {_profit('s.units', 's.side', f'b.close * (1 - s.{cost})' if cost.startswith('side') else 'b.close')} ELSE s.equity END"
    cte(
        f"{name}_equity",
        f"""
SELECT s.{keys.replace(', ', ', s.')}, s.rn, b.ts, {closing or 's.equity'} AS equity, s.value AS position_value, b.close
FROM {name}_state s JOIN {source} b ON {on} AND b.rn = s.rn JOIN {name}_last l ON {on.replace('b.', 'l.')}
WHERE s.rn >= {FIRST_ROW.get(rules, 1)}""",
    )


TRADE_SQL = f"""SELECT symbol, entry_time, exit_time, direction, {rs('entry_price exit_price quantity')}, {r('pnl', digits=4)}, exit_reason, unit_number, tag, position_id FROM """
EQUITY_SQL = f"SELECT symbol, ts, {rs('equity position_value', 4)} FROM "


def ctes_of(name: str, table: str) -> str:
    gated = " gated" if name in ("filtered", "selective") else ""
    return f"{FRAME}{gated} {name}_state {name}_last {name}_{table}"


def _register(name: str) -> None:
    ledger_ctes(name, "gated" if name in ("filtered", "selective") else "frame")

    @query(f"replay_{name}_trades", ctes_of(name, "trades"), f"{TRADE_SQL} {name}_trades")
    def ledger(spark, sf_dir):
        return trades(spark, sf_dir, name).select(
            "symbol", "entry_time", "exit_time", "direction", *rcols("entry_price exit_price quantity"), *rcols("pnl", 4),
            "exit_reason", "unit_number", "tag", F.col("position_id").cast("int").alias("position_id"),
        )

    @query(f"replay_{name}_equity", ctes_of(name, "equity"), f"{EQUITY_SQL} {name}_equity")
    def curve(spark, sf_dir):
        return equity(spark, sf_dir, name).select("symbol", "ts", *rcols("equity position_value", 4))


for _name in RULES:
    _register(_name)


@query("open_position_levels", f"{FRAME} two_sided_state two_sided_last", f"""
SELECT s.symbol, b.ts, CASE WHEN side > 0 THEN 'long' ELSE 'short' END AS direction, CAST(len(units) AS INT) AS units, {r('list_sum(list_transform(units, lambda z: z.q))', 'size')},
  {r('best - side * 4.0 * atr_20', 'trail_stop')}, {r('CASE WHEN len(units) < 4 THEN level + side * 1.5 * atr_20 END', 'pyramid_trigger')}
FROM two_sided_state s JOIN two_sided_last l ON l.symbol = s.symbol AND l.rn = s.rn JOIN frame b ON b.symbol = s.symbol AND b.rn = s.rn WHERE side <> 0""")
def open_position_levels(spark, sf_dir):
    """Trailing stop and next pyramid level of the positions open at the last bar."""
    held = open_positions(result(spark, sf_dir, "two_sided"), frame(spark, sf_dir, ema=False), RULES["two_sided"])
    return held.select("symbol", "ts", "direction", "units", *rcols("size trail_stop pyramid_trigger"))
