"""Journals that survive a crash, orders in any order of arrival, sessions that late rows merge."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators, trades
from barloom.streaming import journals as j
from barloom.streaming.online import use_rocksdb

H, DAY = 3_600_000, 86_400_000
SCHEMA = "`k` bigint, `t` bigint, `v` string"


def frame(spark, *rows):
    return spark.createDataFrame([(k, t, f"v{k}") for k, t in rows], "k long, t long, v string")


def held(spark, path, keys=None):
    return sorted(tuple(r) for r in j.journal_rows(spark, path, SCHEMA, keys).select("k", "t").collect())


def test_a_batch_that_crashed_adds_its_rows_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "j")
    write = j.exactly_once(path, ["k"], "t", "q")
    write(frame(spark, (1, 5), (2, DAY), (2, DAY)), 0)
    assert held(spark, path) == [(1, 5), (2, DAY)]
    mark = j.marked

    def crash(*_):
        raise RuntimeError("crash between append and commit")

    monkeypatch.setattr(j, "marked", crash)
    with pytest.raises(RuntimeError):
        write(frame(spark, (2, DAY), (3, 2 * DAY)), 1)
    assert held(spark, path) == [(1, 5), (2, DAY)]  # what was written isn't seen
    monkeypatch.setattr(j, "marked", mark)
    for _ in range(2):
        write(frame(spark, (2, DAY), (3, 2 * DAY)), 1)
    write(frame(spark, (3, 2 * DAY), (4, 3)), 2)
    write(frame(spark), 3)
    assert held(spark, path) == [(1, 5), (2, DAY), (3, 2 * DAY), (4, 3)]
    other = j.exactly_once(path, ["k"], "t", "other")
    other(frame(spark, (4, 3), (9, 9)), 0)
    assert held(spark, path) == held(spark, path, ["k"]) == [(1, 5), (2, DAY), (3, 2 * DAY), (4, 3), (9, 9)]
    plan = j.held_keys(spark, path, SCHEMA, ["k"], 1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "__span" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert sorted(r["k"] for r in j.held_keys(spark, path, SCHEMA, ["k"], 1, 2).collect()) == [2, 3]


def test_journal_as_a_stream_across_restarts(spark, tmp_path):
    path, source = str(tmp_path / "j"), str(tmp_path / "in")
    for i in range(2):
        frame(spark, *((k, k * H) for k in range(i * 50, i * 50 + 80))).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema("k long, t long, v string").parquet(source)
        q = read.writeStream.foreachBatch(j.exactly_once(path, ["k"], "t", "q")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert held(spark, path) == [(k, k * H) for k in range(130)]


def test_orders_in_any_order_of_arrival(spark, tmp_path):
    use_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a time to live asks for one more batch without end
    rng = random.Random(1)
    events = [(i, rng.randrange(40), rng.choice(("order_placed", "order_placed", "order_filled", "order_cancelled")), 1000 + i) for i in range(150)]
    schema = "seq long, order_id long, kind string, at long"
    want = sorted(tuple(r) for r in trades.order_projection(spark.createDataFrame(events, schema)).select("order_id", "placed_at", "last_at", "status").collect())
    for run in range(2):
        rng.shuffle(events)
        source, name = str(tmp_path / f"in{run}"), f"orders{run}"
        for part in (events[:60], events[60:90], events[90:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = j.orders_as_they_stand(read).writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
        assert q.awaitTermination(150)
        assert sorted(tuple(r) for r in j.latest_orders(spark.table(name)).collect()) == want
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_sessions(spark, tmp_path):
    times = [0, 1, 2, 9, 10, 17, 18, 40]
    rows = [("a", "H1", t * H, 1.0, 2.0 + t, 1.0, 1.5 + t / 2, float(1 + t % 3)) for t in times] + [("b", "H1", 0, 1.0, 2.0, 1.0, 1.5, 0.0)]
    bars = spark.createDataFrame(rows, "symbol string, tf string, t long, o double, h double, l double, c double, v double")
    by = indicators.with_indicator(bars, "vwap", session_gap_mins=390)
    at = {(r["symbol"], r["t"]): r["value"] for r in by.collect()}
    want = {("a", 0, 2 * H, 3), ("a", 9 * H, 10 * H, 2), ("a", 17 * H, 18 * H, 2), ("a", 40 * H, 40 * H, 1), ("b", 0, 0, 1)}
    got = j.sessions(bars).collect()
    assert {(r["symbol"], r["start"], r["t"], r["bars"]) for r in got} == want and all(abs(r["vwap"] - at[r["symbol"], r["t"]]) < 1e-9 for r in got)
    # A late bar bridges two sessions of a stream before the watermark passes them.
    source = str(tmp_path / "in")
    more = [("a", "H1", t * H, 1.0, 2.0, 1.0, 1.5, 1.0) for t in (100,)]
    for part in (rows, [("a", "H1", int(5.5 * H), 1.0, 2.0, 1.0, 1.5, 1.0)], more, [("a", "H1", 200 * H, 1.0, 2.0, 1.0, 1.5, 1.0)]):
        spark.createDataFrame(part, bars.schema).coalesce(1).write.mode("append").parquet(source)
    read = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = j.sessions(read, late="30 hours").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    seen = {(r["symbol"], r["start"], r["t"], r["bars"]) for r in spark.table("sessions").where(F.col("t") < 60 * H).collect()}
    assert seen == {("a", 0, 10 * H, 6), ("a", 17 * H, 18 * H, 2), ("a", 40 * H, 40 * H, 1), ("b", 0, 0, 1)}
