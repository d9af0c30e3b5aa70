"""Streams against the batch answer: several batches, a restart, repeats, stop flags and stored state."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidebar.functions.frame import moves, averages, channels
from tidebar.functions.rules import live_rules
from tidebar.operators.replay import replay, trades_of
from tidebar.operators.sliding import sliding
from tidebar.operators.windows import framed
from tidebar.streaming import bars as sb
from tidebar.streaming import live as sl

RULES = live_rules("live")
BAR = "symbol string, ts timestamp_ntz, open double, high double, low double, close double"


@pytest.fixture(scope="module")
def walk():
    rng, rows = random.Random(8), []
    for symbol in ("a", "b"):
        price = 100.0
        for i in range(160):
            price *= math.exp(rng.gauss(0, 0.03))
            rows.append((symbol, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), price, price * 1.02, price * 0.97, price * rng.uniform(0.98, 1.01)))
    return rows


def put(spark, folder, rows):
    spark.createDataFrame(rows, BAR).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, output, checkpoint, flags=None, initial=None):
    rows = sl.bar_rows(sb.file_stream(spark, folder, BAR))
    if flags is not None:
        rows = rows.unionByName(flags)
    sb.drain(sl.live_stream(rows, RULES, initial), output, checkpoint)


def events(spark, output):
    found = spark.read.parquet(output).where(F.col("kind") == "event").collect()
    return sorted((r["symbol"], r["ts"], r["type"], r["reason"], round(r["size"], 9), round(r["equity"], 6)) for r in found)


def test_batches_restart_and_repeats_equal_the_replay(spark, tmp_path, walk):
    sl.use_rocksdb(spark)
    folder, output, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    for first, last in ((0, 50), (40, 110), (110, 160)):  # the second batch fetches ten bars again
        part = [r for s in ("a", "b") for r in [x for x in walk if x[0] == s][first:last]]
        random.Random(1).shuffle(part)
        put(spark, folder, part)
        run(spark, folder, output, checkpoint)
    numbered = [(*r, i % 160 + 1) for i, r in enumerate(walk)]
    bars = spark.createDataFrame(numbered, BAR + ", rn long")
    frame = framed(bars, ["symbol"], [moves, *sliding(channels((8, 16)) | averages((14,)))], back=20)
    ledger = trades_of(replay(frame, [RULES])).where(F.col("exit_reason") != "End of Backtest").collect()
    got = events(spark, output)
    exits = [(s, t, why) for s, t, kind, why, _, _ in got if kind == "EXIT"]
    assert len(got) > 10 and len(exits) == len(set(exits))
    assert set(exits) == {(r["symbol"], r["exit_time"], r["exit_reason"]) for r in ledger}
    sizes = {}
    for r in ledger:
        sizes[r["symbol"], r["exit_time"]] = sizes.get((r["symbol"], r["exit_time"]), 0) + r["quantity"]
    for symbol, ts, kind, _, size, _ in got:
        if kind == "EXIT":
            assert size == pytest.approx(sizes[symbol, ts])


def test_stop_flag_closes_and_stored_state_opens(spark, tmp_path, walk):
    sl.use_rocksdb(spark)
    folder, output, flags = (str(tmp_path / x) for x in ("in", "out", "flags"))
    put(spark, folder, [r for r in walk if r[0] == "a"][:5])
    spark.createDataFrame([("a", dt.datetime(2024, 2, 1))], "symbol string, ts timestamp_ntz").write.parquet(flags)
    stops = sl.stop_rows(sb.file_stream(spark, flags, "symbol string, ts timestamp_ntz"))
    unit = {"entry_price": 90.0, "size": 2.0, "trailing_stop": 10.0, "time": 0}
    initial = spark.createDataFrame(
        [("a", 500.0, [unit])], "symbol string, equity double, units array<struct<entry_price: double, size: double, trailing_stop: double, time: long>>"
    )
    run(spark, folder, output, str(tmp_path / "check"), stops, initial)
    got = events(spark, output)
    assert [(e[2], e[3], e[4]) for e in got] == [("EXIT", "Stop Flag", 2.0)]
    close = [r for r in walk if r[0] == "a"][4][5]
    assert got[0][5] == pytest.approx(500 + 2 * (close * 0.9995 - 90), abs=1e-5)


def test_only_closed_bars_are_emitted(spark, tmp_path):
    schema = "id long, ts timestamp_ntz, s string, p double"
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * i), "a", float(i)) for i in range(10)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    from tidebar.functions.times import epoch_micros
    from tidebar.sources.bars import tick_order

    ticks = sb.file_stream(spark, str(tmp_path / "in"), schema)
    bars = sb.stream_bars(ticks, "1 hour", "30 minutes", F.col("p"), F.lit(1), tick_order(epoch_micros("ts"), F.col("id")), "s", "ts")
    sb.drain(bars, str(tmp_path / "out"), str(tmp_path / "check"))
    got = sorted((r["ts"].hour, r["open"], r["close"], r["volume"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 0.0, 2.0, 3.0), (1, 3.0, 5.0, 3.0)]  # the newest tick is at 03:00, so 02:00-03:00 is still open
