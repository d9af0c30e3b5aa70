"""Sliding aggregates against the same frame in pandas: odd lengths, gaps, chunk borders, values far from zero."""

import math

import numpy as np
import pandas as pd
import pytest

from tidebar.operators.sliding import Slide, sliding
from tidebar.operators.windows import framed

PLAIN = {"avg": "mean", "sum": "sum", "max": "max", "min": "min", "stddev_samp": "std"}


def table(rows, seed=0):
    rng = np.random.default_rng(seed)
    value = 1e6 + np.cumsum(rng.normal(size=rows))
    value[rng.random(rows) < 0.05] = np.nan
    return pd.DataFrame({"symbol": "A", "rn": np.arange(1, rows + 1), "x": value, "flat": 0.0})


def given(spark, *frames):
    rows = [(r.symbol, int(r.rn), None if math.isnan(r.x) else float(r.x), r.flat) for f in frames for r in f.itertuples()]
    return spark.createDataFrame(rows, "symbol string, rn long, x double, flat double")


def result(df, slides, chunk_rows=4096, plain_rows=0):
    back = max(s.back for s in slides.values())
    return framed(df, ["symbol"], sliding(slides, plain_rows), back, chunk_rows=chunk_rows)


@pytest.mark.parametrize("chunk_rows,plain_rows", [(64, 0), (4096, 0), (4096, 64)])
def test_equals_plain_frames(spark, chunk_rows, plain_rows):
    frame = table(700)
    other = frame.assign(symbol="B", x=-frame["x"]).head(3)
    slides = {
        f"{kind}_{n}_{shift}_{int(partial)}": Slide(kind, "x", n, shift, partial)
        for kind in PLAIN for n in (1, 2, 3, 4, 5, 16, 63, 252) for shift in (0, 1, 7) for partial in (False, True) if shift != 7 or n in (5, 63)
    }
    got = result(given(spark, frame, other), slides, chunk_rows, plain_rows).toPandas().sort_values(["symbol", "rn"])
    assert set(got.columns) == {"symbol", "rn", "x", "flat", *slides}
    for symbol, source in (("A", frame), ("B", other)):
        mine = got[got["symbol"] == symbol]
        for name, s in slides.items():
            least = (2 if s.kind == "stddev_samp" else 1) if s.partial else s.n
            if s.kind == "stddev_samp" and s.n < 2:
                assert mine[name].isna().all()
                continue
            want = getattr(source["x"].rolling(s.n, min_periods=min(least, s.n)), PLAIN[s.kind])().shift(s.shift).to_numpy()
            exact = [np.nan if np.isnan(w) else _one(source["x"].to_numpy(), i - s.shift, s) for i, w in enumerate(want)]
            np.testing.assert_allclose(mine[name].to_numpy(float), exact, rtol=1e-12, atol=1e-9, err_msg=name)


def _one(values, i, s):
    part = values[max(0, i - s.n + 1) : i + 1]
    part = part[~np.isnan(part)]
    return {"avg": np.mean, "sum": np.sum, "max": np.max, "min": np.min, "stddev_samp": lambda v: np.std(v, ddof=1)}[s.kind](part)


def test_a_jump_outside_the_frame_leaves_no_trace(spark):
    rows = [("A", i, 1e15 if i == 5 else 0.25, 0.0) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "symbol string, rn long, x double, flat double")
    found = result(df, {"s": Slide("sum", "x", 20), "d": Slide("stddev_samp", "x", 20), "z": Slide("stddev_samp", "flat", 20)}).where("rn >= 25").collect()
    assert {(r["s"], r["d"], r["z"]) for r in found} == {(5.0, 0.0, 0.0)}


def test_one_exchange_and_few_windows(spark):
    plan = lambda n: result(given(spark, table(5)), {"m": Slide("max", "x", n), "d": Slide("stddev_samp", "x", n)})._jdf.queryExecution().executedPlan().toString()
    for n in (25, 1000):
        assert plan(n).count("Exchange hashpartitioning") == 1
        assert plan(n).count("Sort [") == 1
    assert sum(line.strip(" :+-*()0123456789").startswith("Window [") for line in plan(1000).splitlines()) <= 6


def test_empty_table_and_refused_slides(spark):
    assert result(given(spark), {"m": Slide("max", "x", 9)}).collect() == []
    for wrong in (("median", "x", 3), ("max", "x", 0), ("max", "x", 3, -1)):
        with pytest.raises(ValueError):
            Slide(*wrong)
