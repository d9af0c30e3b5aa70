"""Parsers, file sources and sinks, bar upkeep."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidebar.functions.times import age_text, days_between, epoch_micros, floor_time, from_epoch_micros
from tidebar.session import TASK_BYTES, small_tasks
from tidebar.sources import bars as src
from tidebar.sources import files, parse


def at(*args):
    return dt.datetime(*args)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_ignore_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        stamps = [at(2024, 7, 1, 13, 5, 6, 789), at(2024, 1, 1, 0, 59, 59), at(1969, 12, 31, 23, 0, 1, 5)]
        df = spark.createDataFrame([(t,) for t in stamps], "ts timestamp_ntz")
        rows = df.select("ts", epoch_micros("ts").alias("m"), floor_time("ts", 3600).alias("h"), from_epoch_micros(epoch_micros("ts")).alias("back")).collect()
        for r in rows:
            assert r["m"] == (r["ts"] - at(1970, 1, 1)) // dt.timedelta(microseconds=1)
            assert r["h"] == r["ts"].replace(minute=0, second=0, microsecond=0) and r["back"] == r["ts"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_age_and_days(spark):
    df = spark.createDataFrame([(5.0,), (61.0,), (7300.0,), (200_000.0,)], "s double")
    assert [r[0] for r in df.select(age_text(F.col("s"))).collect()] == ["Just now", "1m ago", "2h ago", "2d ago"]
    two = spark.createDataFrame([(at(2024, 1, 1, 12), at(2024, 1, 3, 11))], "a timestamp_ntz, b timestamp_ntz")
    assert two.select(days_between("a", "b")).collect()[0][0] == 1


def test_klines_and_envelopes(spark):
    row = [1_704_067_200_000, "1.5", "2", "1", "1.75", "10", 1, "0", 3, "0", "0", "0"]
    docs = spark.createDataFrame([("a", json.dumps([row])), ("a", "[]")], "symbol string, payload string")
    got = parse.parse_klines(docs).collect()
    assert [(r["ts"], r["open"], r["volume"]) for r in got] == [(at(2024, 1, 1), 1.5, 10.0)]
    good = {"error": [], "result": {"XX": [[1_704_067_200, "1", "2", "0.5", "1.5", "1", "9", 4]], "last": 7}}
    bad = {"error": ["busy"], "result": {}}
    docs = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),)], "payload string")
    got = parse.parse_ohlc_envelope(docs).collect()
    assert [(r["pair"], r["ts"], r["close"], r["volume"]) for r in got] == [("XX", at(2024, 1, 1), 1.5, 9.0)]


def test_state_defaults_and_log_files(spark, tmp_path):
    (tmp_path / "state.json").write_text(json.dumps({"equity": 5.0, "position_units": [{"entry_price": 2.0, "size": 1.0}]}, indent=2))
    state = files.read_state(spark, str(tmp_path / "state.json"))
    row = state.collect()[0]
    assert (row["equity"], row["initial_capital"], row["strategy"], row["trade_count"]) == (5.0, 1000.0, "V4", 0)
    units = parse.open_units(state).collect()
    assert [(u["unit"], u["entry_price"], u["trailing_stop"]) for u in units] == [(0, 2.0, None)]
    empty = parse.open_units(parse.parse_state(spark.createDataFrame([("{}",)], "payload string"))).collect()
    assert len(empty) == 1 and empty[0]["entry_price"] is None
    events = [
        {"type": "ENTRY", "time": "2025-12-27T07:22:34.373457+00:00", "price": 1.0, "size": 2.0, "trailing_stop": 0.5, "equity": 9.0},
        {"type": "EXIT", "time": "2025-12-28T01:00:00+02:00", "price": 1.5, "pnl": 1.0},
    ]
    (tmp_path / "trades.json").write_text(json.dumps(events, indent=2))
    log = files.read_trade_log(spark, str(tmp_path / "trades.json")).collect()
    assert [(e["pnl"], e["trailing_stop"]) for e in log] == [(None, 0.5), (1.0, None)]
    parsed = parse.parse_trade_log(spark.createDataFrame([(json.dumps(events),)], "payload string")).collect()
    assert [e["ts"] for e in parsed] == [at(2025, 12, 27, 7, 22, 34, 373457), at(2025, 12, 27, 23)]


def test_unreadable_event_time_is_null(spark):
    docs = spark.createDataFrame([(json.dumps([{"type": "EXIT", "time": "soon"}]),)], "payload string")
    assert parse.parse_trade_log(docs).collect()[0]["ts"] is None


BARS = [("a", "1d", at(2024, 1, d), 1.0 * d, 2.0 * d, 0.5 * d, 1.5 * d, 10.0) for d in (1, 2, 3)]


def test_append_rewrites_only_touched_symbols(spark, tmp_path):
    path = str(tmp_path / "bars")
    stored = spark.createDataFrame(BARS + [("b", *BARS[0][1:])], files.BARS)
    files.write_bars(stored, path)
    untouched = {p.name for p in (tmp_path / "bars" / "symbol=b").iterdir()}
    fresh = spark.createDataFrame([("a", "1d", at(2024, 1, 3), 9.0, 9.0, 9.0, 9.0, 9.0), ("a", "1d", at(2024, 1, 4), 4.0, 4.0, 4.0, 4.0, 4.0)], files.BARS)
    files.append_bars(spark, path, fresh)
    got = sorted((r["symbol"], r["ts"].day, r["close"]) for r in files.read_bars(spark, path).collect())
    assert got == [("a", 1, 1.5), ("a", 2, 3.0), ("a", 3, 9.0), ("a", 4, 4.0), ("b", 1, 1.5)]
    assert {p.name for p in (tmp_path / "bars" / "symbol=b").iterdir()} == untouched


def test_csv_without_header_uses_the_declared_columns(spark, tmp_path):
    (tmp_path / "bars.csv").write_text("a,1d,2024-01-01 00:00:00.000000,1,2,0.5,1.5,10\n")
    got = files.read_bars(spark, str(tmp_path / "bars.csv"), "csv", header=False).collect()
    assert (got[0]["symbol"], got[0]["ts"], got[0]["close"]) == ("a", at(2024, 1, 1), 1.5)


def test_dedup_first_and_last(spark):
    rows = [("a", at(2024, 1, 1), float(i), i) for i in (2, 0, 1)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, load_seq int")
    assert src.dedup_bars(df, "first").collect()[0]["close"] == 0.0
    assert src.dedup_bars(df, "last").collect()[0]["close"] == 2.0


def test_result_sink_replaces(spark, tmp_path):
    path = str(tmp_path / "result")
    files.write_result(spark.range(5), path)
    files.write_result(spark.range(2), path)
    assert spark.read.csv(path, header=True).count() == 2


def test_bars_aggregate_by_hash(spark):
    ticks = spark.createDataFrame([(1, at(2024, 1, 1, 5), 3.0, 2), (1, at(2024, 1, 1, 4), 5.0, 1)], "s int, at timestamp_ntz, p double, n long")
    bars = src.build_bars(ticks, 86_400, F.col("p"), F.lit(1), src.tick_order(epoch_micros("at"), F.col("n")), "s", "at")
    row = bars.collect()[0]
    assert (row["open"], row["high"], row["low"], row["close"], row["volume"]) == (5.0, 5.0, 3.0, 3.0, 2.0)
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_bars_are_grouped_by_the_symbol_as_it_is(spark):
    ticks = spark.createDataFrame([(7, at(2024, 1, 1, 5), 3.0, 2), (None, at(2024, 1, 1, 4), 5.0, 1)], "s long, at timestamp_ntz, p double, n long")
    bars = src.build_bars(ticks, 86_400, F.col("p"), F.lit(1), src.tick_order(epoch_micros("at"), F.col("n")), "s", "at")
    assert sorted((r["symbol"] or "", r["open"]) for r in bars.collect()) == [("", 5.0), ("7", 3.0)]
    moved = [line for line in bars._jdf.queryExecution().executedPlan().toString().splitlines() if "partial_min" in line]
    assert moved and not any("as string" in line for line in moved)


def test_tasks_grow_in_number_not_in_size(spark, tmp_path):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    path = str(tmp_path / "ticks")
    spark.range(0, 8_000_000, 1, 1).selectExpr("xxhash64(id) AS x").write.option("parquet.block.size", 1 << 20).parquet(path)
    try:
        small_tasks(spark)
        assert spark.read.parquet(path).rdd.getNumPartitions() >= 7  # 64 MB: 4 tasks before
        assert int(spark.conf.get(keys[2]).rstrip("b")) == 2 * TASK_BYTES
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_registered_query_runs_in_small_tasks(spark):
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.files.maxPartitionBytes", "128MB")
    with pytest.raises(Exception):
        entry.queries()["market_modes"](spark, "/no/such/tables")
    assert spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b") == str(TASK_BYTES)
