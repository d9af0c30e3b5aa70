"""Resampling of trade returns: permutation and bootstrap paths, and what they say.

Draws come from a hash of (seed, series, path, position), so they do not depend on
partitioning, retries or row order.  Paths spread a series with many trades over
(series, path) and, within a path, over slices of the hash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.operators.fold import floats, fold_series
from tidebar.operators.percentiles import cumulative_share, percentiles
from tidebar.operators.windows import CHUNK_ROWS, running_stages
from tidebar.plans.ledger import ratio

UNIFORM_DIGITS = 13
UNIFORM_SPAN = float(16**UNIFORM_DIGITS)


def draw(label: str, seed: int, *parts: str | Column) -> Column:
    """Hex digest standing for one random draw."""
    fields = [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws("-", F.lit(label), F.lit(str(seed)), *fields))


def uniform(digest: Column) -> Column:
    """Number in (0, 1) from a digest."""
    return (F.conv(F.substring(digest, 1, UNIFORM_DIGITS), 16, 10).cast("double") + 0.5) / UNIFORM_SPAN


def normal(first: Column, second: Column) -> Column:
    """Standard normal from two digests (Box-Muller)."""
    return F.sqrt(-2 * F.log(uniform(first))) * F.cos(F.lit(2 * math.pi) * uniform(second))


def permutation_steps(
    returns: DataFrame, keys: Sequence[str], item: str, paths: int, seed: int = 42, capital: float = 100_000.0, noise: float = 0.001, slippage: float = 0.02
) -> DataFrame:
    """Equity after every trade of every shuffled path; execution noise added, slippage taken off."""
    keys = list(keys)
    slices = returns.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS).alias("_slices"))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    sized = returns.alias("r").join(slices.alias("s"), same).select("r.*", "_slices")
    many = sized.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    ident = [*keys, "path", item]
    shaken = F.col("ret")
    if noise:
        shaken = shaken + noise * normal(draw("n1", seed, *ident), draw("n2", seed, *ident))
    if slippage:
        shaken = shaken - slippage * F.abs(normal(draw("s1", seed, *ident), draw("s2", seed, *ident)))
    placed = many.select(*keys, "path", item, shaken.alias("ret"), draw("order", seed, *ident).alias("place"), "_slices")
    growth = F.log1p(F.greatest("ret", F.lit(-0.999999999999)))
    # A path has as many slices as its trades fill, so short paths are one slice.
    by_hash = F.floor(uniform(F.col("place")) * F.col("_slices")).cast("long")
    order, group = ["place", item], [*keys, "path"]
    sums = {"logs": ("sum", growth), "dead": ("max", (F.col("ret") <= -1).cast("int")), "step": ("count", F.lit(1))}
    equity = F.when(F.col("dead") == 1, F.lit(0.0)).otherwise(capital * F.exp("logs"))
    peaked = running_stages(
        placed, group, order, by_hash,
        [(lambda rows: rows.drop("_slices"), sums), (lambda rows: rows.withColumn("equity", equity), {"top": ("max", F.col("equity"))})],
    )
    peak = F.greatest(F.col("top"), F.lit(capital))
    return peaked.withColumn("dd", (peak - F.col("equity")) / peak).select(*group, "step", "equity", "dd")


def path_results(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return steps.groupBy(*keys, "path").agg(F.max_by("equity", "step").alias("final_equity"), F.max("dd").alias("max_dd"))


class _YearlyPath:
    """Capital along one bootstrap path: trade by trade, haircut at each year's end."""

    def __init__(self, capital: float, weight: float, floor: float, error_rate: float, tax_rate: float):
        self.capital, self.weight, self.floor = capital, weight, floor
        self.error_rate, self.tax_rate = error_rate, tax_rate
        self.year, self.start = 0, capital

    def _close_year(self) -> tuple[int, float]:
        gain = self.capital - self.start
        if gain > 0:
            self.capital -= gain * self.error_rate
            self.capital -= (self.capital - self.start) * self.tax_rate
        closed = (self.year + 1, self.capital)
        self.year, self.start = self.year + 1, self.capital
        return closed

    def _emit(self, rows: list[tuple[int, float]]) -> list[dict]:
        return [{"step": [x[0] for x in rows], "equity": [x[1] for x in rows]}] if rows else []

    def advance(self, part: pa.RecordBatch) -> list[dict]:
        rows = []
        for year, ret in zip(part.column("year").to_pylist(), floats(part, "ret")):
            while self.year < year:
                rows.append(self._close_year())
            if ret == ret:
                self.capital = max(self.capital * (1 + self.weight * ret), self.floor)
        return self._emit(rows)

    def finish(self) -> list[dict]:
        return self._emit([self._close_year()])


def bootstrap_steps(
    returns: DataFrame, keys: Sequence[str], per_year: DataFrame, paths: int, years: int = 20, seed: int = 42, capital: float = 1_000.0,
    trade_cost: float = 0.0, weight: float = 0.25, floor: float = 10.0, error_rate: float = 0.0, tax_rate: float = 0.0,
) -> DataFrame:
    """Year-end capital of paths drawn with replacement.

    returns: keys, item (0..n-1) and ret; per_year: keys, n and rate (trades a year).
    Draws join the returns on (key, item), which spreads evenly whatever the key.
    """
    keys = list(keys)
    year = F.explode(F.sequence(F.lit(0), F.lit(years - 1)))
    path = F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))
    spans = per_year.withColumn("path", path).withColumn("year", year)
    first, last = F.floor(F.col("year") * F.col("rate")), F.floor((F.col("year") + 1) * F.col("rate")) - 1
    drawn = spans.withColumn("draw", F.explode_outer(F.when(first <= last, F.sequence(first, last))))
    item = F.floor(uniform(draw("pick", seed, *keys, "path", "draw")) * F.col("n"))
    drawn = drawn.withColumn("item", F.when(F.col("draw").isNotNull(), item)).drop("n", "rate")
    costed = returns.select(*keys, "item", (F.col("ret") - trade_cost).alias("ret"))
    joined = drawn.join(costed, [*keys, "item"], "left")
    start = lambda key: _YearlyPath(capital, weight, floor, error_rate, tax_rate)
    return fold_series(joined, [*keys, "path"], ["year", "draw"], start, "step int, equity double")


SUMMARY = {"p5": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


def summary(results: DataFrame, keys: Sequence[str], value: str = "final_equity") -> DataFrame:
    """Mean, population spread, extremes and percentiles of a result over its paths."""
    moments = results.groupBy(*keys).agg(
        F.count(value).alias("paths"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return moments.join(percentiles(results, keys, value, SUMMARY), list(keys))


def growth_rate(final: Column, capital: float, years: Column) -> Column:
    return F.pow(final / capital, 1 / years) - 1


def outcome_shares(results: DataFrame, keys: Sequence[str], capital: float) -> DataFrame:
    def share(condition):
        return F.avg(F.when(condition, 1.0).otherwise(0.0)) * 100

    final = F.col("final_equity")
    return results.groupBy(*keys).agg(
        share(final < capital * 0.2).alias("prob_ruin"), share(F.col("max_dd") >= 0.5).alias("prob_half_drawdown"),
        share(final > capital).alias("prob_profit"), share(final >= capital * 2).alias("prob_double"),
    )


def threshold_shares(results: DataFrame, keys: Sequence[str], thresholds: Sequence[float], value: str = "final_equity") -> DataFrame:
    """Share of rows at or above each threshold."""
    levels = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    spread = results.withColumn("threshold", levels)
    return spread.groupBy(*keys, "threshold").agg((F.avg(F.when(F.col(value) >= F.col("threshold"), 1.0).otherwise(0.0)) * 100).alias("share_pct"))


def fan(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    return percentiles(steps, [*keys, "step"], "equity", {k: SUMMARY[k] for k in ("p5", "p25", "p50", "p75", "p95")})


def distribution(results: DataFrame, keys: Sequence[str], value: str = "final_equity") -> DataFrame:
    return cumulative_share(results, keys, value)


def log_histogram(results: DataFrame, keys: Sequence[str], width: float = 0.1, value: str = "final_equity") -> DataFrame:
    bin_ = F.floor(F.log10(value) / width).cast("long")
    return results.where(F.col(value) > 0).groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("paths"))


def cost_comparison(plain: DataFrame, costed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Percentile by percentile, what costs take away."""
    names = ["p5", "p25", "p50", "p75", "p95"]

    def long(results, label):
        return summary(results, keys).unpivot(list(keys), names, "level", label)

    both = long(plain, "without_costs").join(long(costed, "with_costs"), [*keys, "level"])
    change = ratio(F.col("with_costs") - F.col("without_costs"), F.col("without_costs")) * 100
    return both.withColumn("change_pct", change)


def overall_verdict(middle: DataFrame, shares: DataFrame, stressed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strengths, concerns and a verdict from the median growth, the share of ruined paths and the stress test.

    Without concerns DEPLOYABLE, with up to two MARGINAL, else NEEDS WORK.  Growth between the two limits counts for neither side.
    """
    keys = list(keys)
    joined = middle.join(shares, keys).join(stressed.select(*keys, "survives"), keys)
    ruin, growth, survives = F.col("prob_ruin"), F.col("median_cagr"), F.col("survives")
    concerns = F.array_compact(F.array(F.when(ruin > 10, "ruin likely"), F.when(growth < 0, "negative median"), F.when(~survives, "fails stress")))
    strengths = F.array_compact(F.array(F.when(ruin <= 10, "ruin unlikely"), F.when(growth > 10, "strong median"), F.when(survives, "passes stress")))
    verdict = F.when(F.size(concerns) == 0, "DEPLOYABLE").when(F.size(concerns) <= 2, "MARGINAL").otherwise("NEEDS WORK")
    return joined.withColumns({"concerns": F.array_join(concerns, "; "), "strengths": F.array_join(strengths, "; "), "verdict": verdict})


def deployable(summaries: DataFrame, shares: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Go or no-go with the reasons against; expects median_cagr and p95_max_dd in percent."""
    joined = summaries.join(shares, list(keys))
    issues = F.array_compact(
        F.array(
            F.when(F.col("median_cagr") <= 0, "negative median"),
            F.when(F.col("prob_ruin") >= 10, "ruin likely"),
            F.when(F.col("prob_profit") <= 60, "profit unlikely"),
            F.when(F.col("p95_max_dd") >= 80, "extreme drawdown"),
        )
    )
    return joined.withColumn("issues", F.array_join(issues, "; ")).withColumn("deployable", F.size(issues) == 0)
