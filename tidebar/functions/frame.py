"""The indicator frame: bars with every column that signals, regimes and rules read."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidebar.functions import indicators as ind
from tidebar.operators.ema import ema
from tidebar.operators.fold import placed_by
from tidebar.operators.sliding import Slide, sliding
from tidebar.operators.windows import framed

BARS_PER_YEAR_VOL = 252 * 6  # fixed value: annualisation of rolling volatility


def moves(w: WindowSpec) -> dict:
    before = F.lag("close").over(w)
    return {
        "prev_close": before,
        "change": F.col("close") - before,
        "ret1": ind.pct_change(F.col("close"), w),
        "tr": ind.true_range(w),
    }


def gains(w: WindowSpec) -> dict:
    up, down = ind.gain_and_loss(F.col("change"))
    return {"__gain": up, "__loss": down}


def channels(lengths: Iterable[int]) -> dict[str, Slide]:
    out = {}
    for n in sorted(set(lengths)):
        out[f"hi_{n}"], out[f"lo_{n}"] = Slide("max", "high", n, 1), Slide("min", "low", n, 1)
    return out


def averages(lengths: Iterable[int]) -> dict[str, Slide]:
    out = {}
    for n in sorted(set(lengths)):
        out[f"atr_{n}"], out[f"atrp_{n}"] = Slide("avg", "tr", n), Slide("avg", "tr", n, 1)
    return out


TREND = {
    "sma50": Slide("avg", "close", 50),
    "sma200": Slide("avg", "close", 200),
    "vol50": Slide("stddev_samp", "ret1", 50),
    "__up": Slide("avg", "__gain", 14),
    "__down": Slide("avg", "__loss", 14),
}


def trend(w: WindowSpec) -> dict:
    return {
        "rsi14": ind.rsi(F.col("__up"), F.col("__down")),
        "ret180": ind.pct_change(F.col("close"), w, 180),
        "ret540": ind.pct_change(F.col("close"), w, 540),
        "trend10": ind.pct_change(F.col("close"), w, 10) * 100,
    }


def slopes(w: WindowSpec) -> dict:
    sma = F.col("sma200")
    return {
        "slope20": sma - F.lag(sma, 20).over(w),
        "slope30": ind.pct_change(sma, w, 30),
        "ratio200": F.col("close") / sma,
        "vol_ann": F.col("vol50") * math.sqrt(BARS_PER_YEAR_VOL),
    }


def indicator_frame(
    bars: DataFrame,
    channel_lens: Iterable[int] = (6, 8, 12, 16, 40),
    atr_lens: Iterable[int] = (14, 20),
    keys: tuple[str, ...] = ("symbol",),
    slow: bool = True,
    placed: bool = False,
) -> DataFrame:
    """One exchange and sort carries all windows; the slow EMA folds over the plain bars before, so no wide row moves for it."""
    channel_lens, atr_lens = sorted(set(channel_lens)), sorted(set(atr_lens))
    back = max([541, *(n + 1 for n in channel_lens), *(n + 1 for n in atr_lens)])
    if slow:
        bars = ema(bars, keys, "close", 200, "ema200")
    return framed(
        placed_by(bars, keys) if placed else bars,
        list(keys),
        [moves, gains, *sliding(channels(channel_lens) | averages(atr_lens) | TREND), trend, slopes],
        back=back,
    )


def sweep_frame(
    bars: DataFrame, channel_lens: Iterable[int], atr_len: int, keys: tuple[str, ...] = ("symbol",), trend_lens: Iterable[int] = (), placed: bool = False
) -> DataFrame:
    """Only what a parameter sweep reads: one channel pair per distinct length, one ATR, the trend averages."""
    lens, trends = sorted(set(channel_lens)), sorted(set(trend_lens))

    smooth = {f"sma{n}": Slide("avg", "close", n) for n in trends} | {f"smap{n}": Slide("avg", "close", n, 1) for n in trends}
    return framed(
        placed_by(bars.drop("volume"), keys) if placed else bars.drop("volume"),
        list(keys),
        [lambda w: {"tr": ind.true_range(w)}, *sliding(channels(lens) | averages([atr_len]) | smooth)],
        back=max([lens[-1], atr_len, *trends]) + 1,
    ).drop("tr")
