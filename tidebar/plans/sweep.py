"""Parameter grids, sweeps over many series and robustness of their results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.functions.lanes import SHARED, CurveMoments, Lanes, supported
from tidebar.functions.rules import Rules, band_rules, breakout_rules, filtered_rules, intrabar_rules, ratchet_rules, selective_rules
from tidebar.operators.fold import fold_series
from tidebar.operators.replay import atr_column, gate_columns, input_columns
from tidebar.plans.ledger import ratio

AXES = ("entry_len", "exit_len", "trail_mult", "risk_pct", "spacing")
METRICS = "final_equity double, max_dd_pct double, sharpe double, trades long, wins long, gain double, loss double, bars long, error string"


def steps(low: float, high: float, step: float) -> list[float]:
    """Inclusive range; float steps count in whole multiples so they do not drift."""
    return [low + i * step for i in range(int((high - low) / step + 1e-9) + 1)]


# The ranges each profile is swept over.
GRIDS: dict[str, dict[str, list]] = {
    "breakout": {
        "entry_len": list(range(15, 41, 5)), "exit_len": list(range(7, 21, 3)), "trail_mult": steps(2.0, 4.0, 0.5),
        "risk_pct": steps(0.25, 1.0, 0.25), "spacing": steps(0.5, 1.5, 0.25),
    },
    "intrabar": {"entry_len": list(range(8, 25, 2)), "exit_len": list(range(4, 13, 2)), "trail_mult": steps(1.5, 3.5, 0.5)},
    "band": {
        "entry_len": [16, 20, 24, 30, 36], "exit_len": [6, 8, 10, 12], "trail_mult": steps(2.0, 4.0, 0.5),
        "trend_len": [50, 100, 150, 200], "risk_pct": [0.5, 1.0, 1.5],
    },
    "band_wide": {
        "entry_len": [12, 16, 20, 24, 30, 36, 48], "exit_len": [4, 6, 8, 10, 12], "trail_mult": [2.0, 2.5, 3.0, 3.5, 4.0, 5.0],
        "trend_len": [50, 100, 150, 200], "risk_pct": [0.5, 1.0, 1.5, 2.0],
    },
    "ratchet": {
        "entry_len": [8, 12, 16, 20, 24, 30, 40, 48, 60], "exit_len": [4, 6, 8, 10, 12, 16], "trail_mult": [2.0, 2.5, 3.0, 3.5, 4.0, 5.0],
        "risk_pct": [0.5, 1.0, 1.5, 2.0], "use_trend": [False, True], "trend_len": [50, 100, 150],
    },
    "ratchet_wide": {
        "entry_len": [8, 12, 16, 20, 24, 30, 40, 48, 60, 80], "exit_len": [4, 6, 8, 10, 12, 16, 20],
        "trail_mult": [1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0], "risk_pct": [0.5, 1.0, 1.5, 2.0, 2.5],
    },
    "selective": {"severe_size": [0.0, 0.25, 0.5], "mild_size": [0.5, 0.75, 1.0], "severe_ratio": [0.85, 0.90, 0.95]},
}


def valid(profile: str, point: dict) -> bool:
    """Exit shorter than entry where the profile asks for it; one trend length when the trend is off."""
    if profile in ("breakout", "intrabar") and point["exit_len"] >= point["entry_len"]:
        return False
    return not (point.get("use_trend") is False and point.get("trend_len", 50) != 50)


def grid_points(profile: str, axes: dict[str, list] | None = None) -> list[dict]:
    axes = axes or GRIDS[profile]
    points = [dict(zip(axes, values)) for values in product(*axes.values())]
    return [p for p in points if valid(profile, p)]


def grid_frame(spark: SparkSession, axes: dict[str, list], condition: Column | None = None) -> DataFrame:
    """The grid as a small DataFrame: one exploded array per axis, invalid points filtered."""
    frame = spark.range(1)
    for name, values in axes.items():
        frame = frame.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    frame = frame.drop("id")
    return frame if condition is None else frame.where(condition)


def rules_of(profile: str, points: Sequence[dict], **fixed) -> list[Rules]:
    make = {"breakout": breakout_rules, "intrabar": intrabar_rules, "ratchet": ratchet_rules, "band": band_rules, "filtered": filtered_rules, "selective": selective_rules}[profile]
    return [make(str(i), **(fixed | p | ({"stop_mult": p["trail_mult"]} if profile in ("ratchet", "band") else {}))) for i, p in enumerate(points)]


def sweep(
    frame: DataFrame, rule_list: Sequence[Rules], keys: Sequence[str] = ("symbol",), bars_per_year: float = 365.0, lanes_per_chunk: int = 4096
) -> DataFrame:
    """One metrics row per series and rule set.

    Bars are copied once per chunk of rule sets, never per set; a chunk advances all
    its sets together over the sorted bars of a series.  Short series advance side by side,
    bar number by bar number; a long one by itself, batch by batch.  A series whose
    step fails gives a row with the error text for each of its sets.
    """
    keys, rule_list = list(keys), list(rule_list)
    if not all(supported(x) for x in rule_list):
        raise ValueError("lanes cover the peak and close stop families only; use replay() and equity_stats() for others")
    if len({x.capital for x in rule_list}) > 1:
        raise ValueError("all sets of a sweep start with the same capital")
    chunks = _chunks(rule_list, lanes_per_chunk)
    gates = gate_columns(rule_list)
    inputs = frame.withColumns(gates).select(*keys, "rn", "high", "low", "close", *input_columns(rule_list), *gates)
    spread = F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1))) if len(chunks) > 1 else F.lit(0)

    def start(key: tuple) -> _Sweep:
        return _Sweep(chunks[key[-1]], bars_per_year)

    def together(parts: Iterator[tuple[tuple, pa.RecordBatch]]) -> Iterator[tuple[tuple, dict]]:
        return _side_by_side(parts, start)

    raw = fold_series(inputs.withColumn("_chunk", spread), [*keys, "_chunk"], ["rn"], start, f"param_id string, {METRICS}", keep=keys, together=together)
    return _finished(raw, rule_list[0].capital, bars_per_year)


def _chunks(rule_list: list[Rules], size: int) -> list[list[Rules]]:
    """Sets of one chunk start their equity curve on the same row and agree on what lanes share."""
    alike: dict[tuple, list[Rules]] = {}
    for rules in rule_list:
        start = 0 if rules.full_curve else rules.warmup
        alike.setdefault((start, *(getattr(rules, f) for f in SHARED)), []).append(rules)
    return [group[i : i + size] for group in alike.values() for i in range(0, len(group), size)]


def _finished(raw: DataFrame, capital: float, bars_per_year: float) -> DataFrame:
    total = F.col("final_equity") / capital - 1
    growth = F.pow(1 + total, F.lit(float(bars_per_year)) / F.col("bars")) - 1
    return raw.withColumns(
        {
            "return_pct": total * 100,
            "win_rate": ratio(F.col("wins") * 100.0, F.col("trades")),
            "profit_factor": ratio(F.col("gain"), F.col("loss")),
            "cagr_pct": growth * 100,
            "calmar": F.coalesce(ratio(growth * 100, F.abs("max_dd_pct")), F.lit(0.0)),
        }
    ).drop("wins", "gain", "loss", "bars")


#: Lanes that step together, and equity values they may hold at once: bounds the memory of a task.
SIDE_BY_SIDE_LANES, SIDE_BY_SIDE_CELLS = 8192, 4_000_000


def _side_by_side(parts: Iterator[tuple[tuple, pa.RecordBatch]], start: Callable[[tuple], _Sweep]) -> Iterator[tuple[tuple, dict]]:
    """Series whose rows are few wait for each other and step together; one too long for that streams through its own sweep."""
    waiting: list[tuple[tuple, _Sweep, list[pa.RecordBatch]]] = []
    streaming, current, cells, lanes = None, None, 0, 0

    def run() -> Iterator[tuple[tuple, dict]]:
        chunks: dict[int, list] = {}
        for entry in waiting:
            chunks.setdefault(entry[0][-1], []).append(entry)
        for group in chunks.values():
            _step_together([x[1] for x in group], [x[2] for x in group])
            for key, sweep, _ in group:
                yield from ((key, block) for block in sweep.finish())

    for key, part in parts:
        if current is None or key != current:
            if streaming is not None:
                yield from ((current, block) for block in streaming.finish())
                streaming = None
            if cells >= SIDE_BY_SIDE_CELLS or lanes >= SIDE_BY_SIDE_LANES:
                yield from run()
                waiting, cells, lanes = [], 0, 0
            current = key
            waiting.append((key, start(key), []))
            lanes += len(waiting[-1][1].rules)
        if streaming is not None:
            streaming.advance(part)
            continue
        waiting[-1][2].append(part)
        cells += part.num_rows * len(waiting[-1][1].rules)
        if sum(x.num_rows for x in waiting[-1][2]) * len(waiting[-1][1].rules) > SIDE_BY_SIDE_CELLS:
            _, streaming, early = waiting.pop()
            yield from run()
            waiting, cells, lanes = [], 0, 0
            for x in early:
                streaming.advance(x)
    if streaming is not None:
        yield from ((current, block) for block in streaming.finish())
    yield from run()


def _step_together(sweeps: list[_Sweep], series: list[list[pa.RecordBatch]]) -> None:
    """Advance the same chunk of rule sets over several series; if that fails each series runs by itself, so an error stays with its own."""
    try:
        results = _stepped(sweeps[0], [pa.concat_batches(parts) for parts in series])
    except MemoryError:
        raise
    except Exception:
        for sweep, parts in zip(sweeps, series):
            for part in parts:
                sweep.advance(part)
        return
    for sweep, (lanes, curve, rows, close) in zip(sweeps, results):
        sweep.stepped = lanes
        sweep.follow(curve, rows)
        sweep.close = close


def _stepped(sweep: _Sweep, series: list[pa.RecordBatch]) -> list[tuple[dict, np.ndarray, int, float]]:
    """Trade sums, equity curve, first row number and last close of each series, all stepped by the number of the bar in its series."""
    sizes = [x.num_rows for x in series]
    count, longest, sets = len(series), max(sizes), len(sweep.rules)
    read = [sweep.read(x) for x in series]

    def grid(name: str, blank) -> np.ndarray:
        values = [r[name] for r in read]
        out = np.full((longest, count, *values[0].shape[1:]), blank, dtype=values[0].dtype)
        for i, v in enumerate(values):
            out[: sizes[i], i] = v
        return out

    levels, atrs, gates = grid("levels", np.nan), grid("atrs", np.nan), grid("gates", False)
    rows, down = grid("rn", -1.0), grid("down", False)
    high, low, close = grid("high", np.nan), grid("low", np.nan), grid("close", np.nan)
    lanes, first = Lanes(sweep.rules, copies=count), min(x.warmup for x in sweep.rules)
    curve = np.empty((longest, count, sets))
    top, bottom, cap, floor = sweep.pick
    for i in range(longest):
        if (rows[i] > first).any():
            at = levels[i]
            picked = (at[:, k].ravel() for k in (top, bottom, cap, floor))
            prices = (np.repeat(x[i], sets) for x in (rows, high, low, close))
            lanes.advance(*prices, atrs[i][:, sweep.pick_atr].ravel(), *picked, gates[i][:, sweep.pick_gate].ravel(), np.repeat(down[i], sets))
        curve[i] = lanes.mark(np.repeat(close[i], sets)).reshape(count, sets)
    last = np.array([close[n - 1, i] for i, n in enumerate(sizes)])
    sums = {"final_equity": lanes.finish(np.repeat(last, sets)), "trades": lanes.trades, "wins": lanes.wins, "gain": lanes.gain, "loss": lanes.loss}
    own = [{name: x[i * sets : (i + 1) * sets] for name, x in sums.items()} for i in range(count)]
    return [(own[i], curve[: sizes[i], i], read[i]["rn"][0], last[i]) for i in range(count)]


class _Sweep:
    """A chunk of rule sets over one series."""

    def __init__(self, rule_list: list[Rules], bars_per_year: float):
        self.rules, self.bars_per_year = rule_list, bars_per_year
        self._lanes: Lanes | None = None
        self.stepped: dict | None = None
        self.curve = CurveMoments(np.array([float(x.capital) for x in rule_list]))
        self.tail: np.ndarray | None = None
        self.error: str | None = None
        self.close = 0.0
        self.columns = sorted({c for x in rule_list for c in _channel_names(x)})
        at = {c: i for i, c in enumerate(self.columns)}
        self.pick = [np.array([at[_channel_names(x)[k]] for x in rule_list]) for k in range(4)]
        self.atrs = sorted({atr_column(x) for x in rule_list})
        self.gates = sorted({x.gate_column for x in rule_list if x.gate_column})
        self.pick_gate = np.array([self.gates.index(x.gate_column) + 1 if x.gate_column else 0 for x in rule_list])
        self.pick_atr = np.array([self.atrs.index(atr_column(x)) for x in rule_list])

    @property
    def lanes(self) -> Lanes:
        if self._lanes is None:
            self._lanes = Lanes(self.rules)
        return self._lanes

    def advance(self, part: pa.RecordBatch) -> list[dict]:
        if self.error:
            return []
        try:
            self._advance(part)
        except MemoryError:
            raise
        except Exception as problem:  # reported in the result, as one bad series must not end the sweep
            self.error = f"{type(problem).__name__}: {problem}"
        return []

    def read(self, part: pa.RecordBatch) -> dict[str, np.ndarray]:
        def of(name):
            return part.column(name).to_numpy(zero_copy_only=False).astype(float)

        count = part.num_rows
        down = part.column("downtrend").to_numpy(zero_copy_only=False).astype(bool) if "downtrend" in part.schema.names else np.ones(count, dtype=bool)
        return {
            "levels": np.column_stack([of(c) for c in self.columns]), "atrs": np.column_stack([of(c) for c in self.atrs]),
            "gates": np.column_stack([np.ones(count, dtype=bool), *[of(c).astype(bool) for c in self.gates]]), "down": down,
            **{c: of(c) for c in ("rn", "high", "low", "close")},
        }

    def _advance(self, part: pa.RecordBatch) -> None:
        read = self.read(part)
        levels, atrs, gates, down = (read[x] for x in ("levels", "atrs", "gates", "down"))
        rows, high, low, close = (read[x].tolist() for x in ("rn", "high", "low", "close"))
        count = len(rows)
        block = np.empty((count, len(self.rules)))
        top, bottom, cap, floor = self.pick
        for i in range(count):
            at = levels[i]
            self.lanes.advance(
                rows[i], high[i], low[i], close[i], atrs[i][self.pick_atr], at[top], at[bottom], at[cap], at[floor], gates[i][self.pick_gate], down[i]
            )
            block[i] = self.lanes.mark(close[i])
        self.follow(block, rows[0])
        self.close = close[-1]

    def follow(self, block: np.ndarray, row: float) -> None:
        """Equity of the next bars, the first of them with number ``row``."""
        first = self.rules[0]
        if not first.full_curve:
            block = block[max(0, int(first.warmup - row + 1)) :]
        if self.tail is not None and len(block):
            self.curve.add(self.tail[None, :])
        if len(block):
            self.curve.add(block[:-1])
            self.tail = block[-1]

    def finish(self) -> list[dict]:
        if self.error:  # what was summed up before the error is no result
            count = len(self.rules)
            empty = dict.fromkeys(("final_equity", "max_dd_pct", "sharpe", "trades", "wins", "gain", "loss", "bars"), [None] * count)
            return [{"param_id": [x.name for x in self.rules], **empty, "error": [self.error] * count}]
        done = self.stepped
        if done is None:
            done = {"final_equity": self.lanes.finish(self.close), "trades": self.lanes.trades, "wins": self.lanes.wins, "gain": self.lanes.gain, "loss": self.lanes.loss}
        final = done["final_equity"]
        if self.tail is not None:
            last = final if self.rules[0].closing_row else self.tail
            self.curve.add(np.array(last, dtype=float)[None, :])
        spread = np.sqrt(self.curve.m2 / max(self.curve.n - 1, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            sharpe = np.where(spread > 0, self.curve.mean / spread * np.sqrt(self.bars_per_year), 0.0)
        count = len(self.rules)
        block = {
            "param_id": [x.name for x in self.rules], "final_equity": final, "max_dd_pct": self.curve.deepest * 100, "sharpe": sharpe,
            "trades": done["trades"], "wins": done["wins"], "gain": done["gain"], "loss": done["loss"],
            "bars": [self.curve.rows] * count, "error": [self.error] * count,
        }
        return [block]


def _channel_names(rules: Rules) -> tuple[str, str, str, str]:
    return f"hi_{rules.entry_len}", f"lo_{rules.entry_len}", f"hi_{rules.exit_len}", f"lo_{rules.exit_len}"


def with_points(results: DataFrame, points: Sequence[dict], spark: SparkSession) -> DataFrame:
    """Metrics with the parameter values of each set; the grid is the small configured side."""
    rows = [(str(i), *p.values()) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, ["param_id", *points[0]])
    table = table.select(*[F.col(c).cast("int").alias(c) if t == "bigint" else F.col(c) for c, t in table.dtypes])
    return results.join(table, "param_id")


def balance_score() -> Column:
    return F.col("return_pct") - 0.5 * F.abs("max_dd_pct")


def frequency_score(trades_per_day: Column) -> Column:
    frequent = F.when(trades_per_day.between(0.5, 1.5), 1.0).otherwise(0.5)
    return F.col("return_pct") / 100 * 0.3 + (100 + F.col("max_dd_pct")) / 100 * 0.3 + F.col("sharpe") * 0.2 + frequent * 0.2


def return_per_drawdown() -> Column:
    return F.coalesce(ratio(F.col("return_pct"), F.abs("max_dd_pct")), F.lit(0.0))


def profitable_shares(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    def share(condition):
        return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100

    # A set whose step failed has no return and counts nowhere.
    return results.where(F.col("return_pct").isNotNull()).groupBy(*keys).agg(
        share(F.col("return_pct") > 0).alias("pct_profitable"), share(F.col("return_pct") > 100).alias("pct_strong")
    )


def by_axis(results: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Return statistics per value of each axis, all axes in one grouping."""
    cast = results.select(*keys, "return_pct", *[F.col(a).cast("double").alias(a) for a in axes])
    long = cast.unpivot([*keys, "return_pct"], list(axes), "axis", "value")
    value = "return_pct"
    return long.groupBy(*keys, "axis", "value").agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def sensitivity(results: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """Mean and spread of the per-value means, the largest step between neighbours, and whether it is a plateau."""
    means = by_axis(results, keys, axes)
    before = F.lag("mean").over(Window.partitionBy(*keys, "axis").orderBy("value"))  # one row per axis value
    stepped = means.withColumn("step", F.abs(F.col("mean") - before))
    found = stepped.groupBy(*keys, "axis").agg(
        F.avg("mean").alias("mean_return"), F.stddev_samp("mean").alias("std_return"), F.max("step").alias("max_cliff")
    )
    flat = F.coalesce(F.col("std_return") < F.col("mean_return") * 0.5, F.lit(False))
    return found.withColumn("is_plateau", flat)


def robustness(results: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    plateaus = sensitivity(results, keys, axes).groupBy(*keys).agg(F.count_if("is_plateau").alias("plateaus"))
    both = profitable_shares(results, keys).join(plateaus, list(keys))
    score = F.col("pct_profitable") * 0.3 + F.col("pct_strong") * 0.3 + F.col("plateaus") * 10
    return both.withColumn("score", score).withColumn(
        "verdict", F.when(score >= 50, "ROBUST").when(score >= 30, "MARGINAL").otherwise("FRAGILE")
    )


def pivot_mean(results: DataFrame, keys: Sequence[str], row: str, column: str, values: Sequence, metric: str, label: Callable) -> DataFrame:
    wide = results.groupBy(*keys, row).pivot(column, list(values)).agg(F.avg(metric))
    return wide.select(*keys, row, *[F.col(f"`{v}`").alias(label(v)) for v in values])
