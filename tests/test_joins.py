"""As-of, nearest, interval membership and percentiles against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators.joins import asof, nearest, within
from tidebar.operators.percentiles import cumulative_share, percentiles
from tidebar.plans.calendar import calendar_frame, in_calendar

START = dt.datetime(2021, 1, 1)


def minutes(n):
    return START + dt.timedelta(minutes=n)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    left = [("hot" if rng.random() < 0.8 else "b", i, minutes(rng.randrange(0, 20_000))) for i in range(300)]
    right = sorted({("hot" if rng.random() < 0.5 else "b", rng.randrange(500, 19_000)) for _ in range(80)})
    right = [(k, minutes(m), float(i)) for i, (k, m) in enumerate(right)]
    return (
        left, right, spark.createDataFrame(left, "key string, id int, at timestamp_ntz"),
        spark.createDataFrame(right, "key string, seen timestamp_ntz, v double"),
    )


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("spread", [1, 5])
def test_asof(sides, direction, spread):
    left, right, ldf, rdf = sides
    found = asof(ldf, rdf, ["key"], "at", "seen", ["v"], tie=["id"], direction=direction, slice_seconds=3600, spread=spread)
    got = {r["id"]: r["matched"]["v"] if r["matched"] else None for r in found.collect()}
    assert len(got) == len(left)
    for key, i, at in left:
        if direction == "backward":
            best = max(((t, v) for k, t, v in right if k == key and t <= at), default=None)
        else:
            best = min(((t, v) for k, t, v in right if k == key and t >= at), default=None)
        assert got[i] == (best[1] if best else None)


def test_nearest(sides):
    left, right, ldf, rdf = sides
    got = {r["id"]: r["matched"]["v"] for r in nearest(ldf, rdf, ["key"], "at", "seen", ["v"], tie=["id"]).collect()}
    for key, i, at in left:
        best = min(((abs(t - at), t, v) for k, t, v in right if k == key))
        assert got[i] == best[2]


def test_within_keeps_overlaps_and_both_bounds(spark):
    points = spark.createDataFrame([("a", 1, minutes(10)), ("a", 2, minutes(20)), ("b", 3, minutes(10))], "key string, id int, at timestamp_ntz")
    spans = spark.createDataFrame(
        [("a", "x", minutes(0), minutes(10)), ("a", "y", minutes(10), minutes(99_999)), ("b", "z", minutes(11), minutes(12))],
        "key string, name string, low timestamp_ntz, high timestamp_ntz",
    )
    got = sorted((r["id"], r["name"]) for r in within(points, spans, ["key"], "at", "low", "high", 3600).collect())
    assert got == [(1, "x"), (1, "y"), (2, "y")]


def test_calendar_overlap_and_last_day_at_midnight(spark):
    bars = spark.createDataFrame([("a", dt.datetime(2020, 1, 2, h)) for h in (0, 5)], "symbol string, ts timestamp_ntz")
    calendar = calendar_frame(spark, [("one", "2020-01-01", "2020-01-02", "bull"), ("two", "2020-01-02", "2020-01-03", "bear")])
    got = sorted((r["regime"], r["ts"].hour) for r in in_calendar(bars, calendar).collect())
    assert got == [("one", 0), ("two", 0), ("two", 5)]


def test_percentiles_equal_numpy_with_heavy_repeats(spark):
    rng = random.Random(5)
    values = {"hot": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(500)], "b": [rng.gauss(0, 1) for _ in range(77)], "c": [4.0]}
    rows = [(k, v) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "key string, v double")
    probs = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    got = {r["key"]: [r[p] for p in probs] for r in percentiles(df, ["key"], "v", probs).collect()}
    for key, vs in values.items():
        assert got[key] == pytest.approx(list(np.percentile(vs, [5, 50, 95])))
    everything = percentiles(df, [], "v", {"m": 0.5}).collect()[0]["m"]
    assert everything == pytest.approx(float(np.median([v for _, v in rows])))


def test_cumulative_share(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (9.0,)], "v double")
    got = sorted((r["v"], r["cdf"]) for r in cumulative_share(df, [], "v").collect())
    assert got == [(1.0, 0.5), (3.0, 0.75), (9.0, 1.0)]


def test_missing_values_never_count(spark):
    df = spark.createDataFrame([("a", None), ("a", 2.0)], "key string, v double")
    assert percentiles(df, ["key"], "v", {"m": 0.5}).collect()[0]["m"] == 2.0
    assert df.where(F.col("v").isNull()).count() == 1
