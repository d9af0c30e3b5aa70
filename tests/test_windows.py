"""Chunked frames, two-level running aggregates and islands against brute force."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators.ema import ema
from tidebar.operators.episodes import episodes
from tidebar.operators.windows import framed, row_slice, running, runs, time_slice, with_row_number
from tidebar.sources.bars import missing_bars

DAY = 86_400
START = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def series():
    """One key holds most rows; days have gaps; some values are missing."""
    rng = random.Random(7)
    rows = []
    for key, count in (("hot", 900), ("b", 60), ("c", 1)):
        day = 0
        for rn in range(1, count + 1):
            day += rng.choice([1, 1, 1, 2, 9])
            rows.append((key, START + dt.timedelta(days=day), rn, None if rng.random() < 0.1 else round(rng.uniform(-5, 5), 3)))
    return pd.DataFrame(rows, columns=["key", "ts", "rn", "x"])


def frame(spark, pdf):
    rows = [(k, t.to_pydatetime(), int(n), None if pd.isna(x) else float(x)) for k, t, n, x in pdf.sample(frac=1, random_state=1).itertuples(index=False)]
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, rn long, x double")


def collected(df, *columns):
    return {(r["key"], r["rn"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_running_kinds_match_plain_loops(spark, series):
    kinds = ("sum", "count", "max", "min", "max_before", "first", "last", "before", "lag")
    df = running(frame(spark, series), ["key"], ["rn"], row_slice(rows_per_slice=37), {k: (k, F.col("x")) for k in kinds})
    got = collected(df, *kinds)
    for key, part in series.groupby("key"):
        seen = []
        for rn, x in zip(part["rn"], part["x"]):
            x = None if pd.isna(x) else x
            known = [v for v in seen if v is not None]
            full = known + ([x] if x is not None else [])
            want = {
                "sum": sum(full), "count": len(full), "max": max(full, default=None), "min": min(full, default=None),
                "max_before": max(known, default=None), "first": full[0] if full else None, "last": full[-1] if full else None,
                "before": known[-1] if known else None, "lag": seen[-1] if seen else None,
            }
            row = dict(zip(kinds, got[key, rn]))
            assert row["sum"] == pytest.approx(want.pop("sum"))
            row.pop("sum")
            assert row == want, (key, rn)
            seen.append(x)


def test_row_numbers_across_time_slices(spark, series):
    df = with_row_number(frame(spark, series).drop("rn"), ["key"], ["ts"], time_slice("ts", DAY, 20))
    got = {(r["key"], r["ts"]): r["rn"] for r in df.collect()}
    assert got == {(k, t.to_pydatetime()): n for k, t, n in series[["key", "ts", "rn"]].itertuples(index=False)}


@pytest.mark.parametrize("chunk", [8, 50, 5000])
def test_frames_do_not_depend_on_chunks(spark, series, chunk):
    def build(w):
        return {"m": F.max("x").over(w.rowsBetween(-7, -1)), "nxt": F.lead("x", 2).over(w)}

    df = framed(frame(spark, series), ["key"], build, back=7, ahead=2, chunk_rows=chunk)
    got = collected(df, "m", "nxt")
    assert len(got) == len(series)
    for key, part in series.groupby("key"):
        xs = [None if pd.isna(x) else x for x in part["x"]]
        for i, rn in enumerate(part["rn"]):
            before = [v for v in xs[max(0, i - 7) : i] if v is not None]
            assert got[key, rn] == (max(before, default=None), xs[i + 2] if i + 2 < len(xs) else None)


def test_later_builder_sees_earlier_columns_across_chunks(spark, series):
    df = framed(
        frame(spark, series), ["key"],
        [lambda w: {"p": F.lag("rn").over(w)}, lambda w: {"q": F.sum("p").over(w.rowsBetween(-2, 0))}], back=3, chunk_rows=10,
    )
    for (key, rn), (q,) in collected(df, "q").items():
        want = [v - 1 for v in range(max(1, rn - 2), rn + 1) if v > 1]
        assert q == (sum(want) if want else None)


def test_ema_equals_recursion(spark, series):
    filled = series.assign(x=series["x"].fillna(1.0))
    got = collected(ema(frame(spark, filled), ["key"], "x", 20, "e", block=16), "e")
    for key, part in filled.groupby("key"):
        e = None
        for rn, x in zip(part["rn"], part["x"]):
            e = x if e is None else e + 2 / 21 * (x - e)
            assert got[key, rn][0] == pytest.approx(e, abs=1e-9)


def test_runs_number_equal_neighbours(spark, series):
    sign = F.when(F.col("x").isNull(), None).otherwise(F.col("x") > 0)
    got = collected(runs(frame(spark, series), ["key"], ["rn"], row_slice(rows_per_slice=11), sign, "run"), "run")
    for key, part in series.groupby("key"):
        run, last = 0, object()
        for rn, x in zip(part["rn"], part["x"]):
            value = None if pd.isna(x) else x > 0
            run, last = run + (value != last), value
            assert got[key, rn][0] == run


def test_episode_still_open_has_no_end(spark):
    levels = [0, -1, -2, 0, 0, -3]
    rows = [("a", START + dt.timedelta(days=i), i + 1, float(v)) for i, v in enumerate(levels)]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, rn long, x double")
    counted = running(df, ["key"], ["rn"], row_slice(rows_per_slice=2), {"g": ("count", F.when(F.col("x") >= 0, 1))})
    found = episodes(counted, ["key"], "g", F.col("x") >= 0, False, {"start": F.min("ts"), "low": F.min("x")}, {"stop": F.max("end_ts")})
    got = sorted((r["start"].day, r["low"], r["stop"] and r["stop"].day) for r in found.collect())
    assert got == [(2, -2.0, 4), (6, -3.0, None)]


def test_missing_bars(spark):
    rows = [("a", START + dt.timedelta(days=d), i + 1) for i, d in enumerate([0, 1, 4, 5])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, rn long")
    assert sorted(r["ts"].day for r in missing_bars(df, DAY).collect()) == [3, 4]


def test_results_do_not_depend_on_partitions(spark, series):
    def total():
        df = running(frame(spark, series), ["key"], ["rn"], row_slice(rows_per_slice=37), {"s": ("sum", F.col("x"))})
        return {k: round(v[0], 9) for k, v in collected(df, "s").items()}

    before = total()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert total() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
