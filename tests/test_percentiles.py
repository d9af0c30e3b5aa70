"""Bucketed exact percentiles: buckets follow the values and the ranks stay exact, whatever the shape of the values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators.percentiles import cumulative_share, octave_code, percentiles, value_buckets

PROBS = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def shapes():
    draw = np.random.default_rng(7)
    tail = draw.lognormal(0.0, 3.0, 60_000)
    return {
        "log-normal": tail,
        "log-normal on a plateau": 1e6 + tail * 1e-3,
        "mirrored": np.concatenate([-tail, tail]),
        "one far value": np.append(draw.random(60_000), 1e300),
    }


@pytest.mark.parametrize("shape", list(shapes()))
def test_one_group_spreads_over_its_buckets(spark, shape):
    values = shapes()[shape]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("key", F.lit("hot"))
    placed = value_buckets(df, ["key"], "v", full=512)
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).orderBy("_bucket").collect()
    distinct = len(np.unique(values))
    assert sum(r["n"] for r in sizes) == distinct
    assert max(r["n"] for r in sizes) <= 0.03 * distinct
    assert all(a["high"] < b["low"] for a, b in zip(sizes, sizes[1:]))
    got = percentiles(df, ["key"], "v", PROBS).first()
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_codes_never_decrease(spark):
    values = [0.0, 5e-324, 1e-310, math.inf, 1.7e308]
    for k in (-1074, -1022, -3, 0, 1, 2, 29, 52, 100, 1000, 1023):
        power = 2.0**k
        values += [power, math.nextafter(power, 0.0), math.nextafter(power, math.inf), power * 1.5]
    values = sorted({s * v for v in values for s in (-1.0, 1.0)})
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, math.nan])], "i int, v double")
    codes = [r["c"] for r in df.select("i", octave_code(F.col("v")).alias("c")).orderBy("i").collect()]
    assert all(a <= b for a, b in zip(codes, codes[1:]))


def test_infinite_values_nulls_ties_and_empty(spark):
    df = spark.createDataFrame([("a", -math.inf), ("a", 1.0), ("a", 1.0), ("a", None), ("a", math.inf), ("b", 0.0), ("c", None)], "key string, v double")
    shares = {(r["key"], r["v"]): r["cdf"] for r in cumulative_share(df, ["key"], "v").collect()}
    assert shares == {("a", -math.inf): 0.25, ("a", 1.0): 0.75, ("a", math.inf): 1.0, ("b", 0.0): 1.0}
    assert percentiles(df.where("false"), ["key"], "v", PROBS).count() == 0
    whole = spark.createDataFrame([(3,), (1,), (2,)], "v int")
    assert percentiles(whole, [], "v", {"m": 0.5}).first()["m"] == 2.0
