"""Live bars as file streams, and what users bring along, against plain loops."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.calls import pct_change
from barloom.operators import custom, resample, rules
from barloom.operators import indicators as I
from barloom.streaming import live

H = 3_600_000


@pytest.fixture(scope="module")
def bars(spark):
    x = spark.range(400).selectExpr("explode(array('a', 'b')) symbol", "'H1' tf", "id * 3600000 t", "100 + 10 * sin(id / 5) + 3 * sin(id * 1.7) c")
    return x.selectExpr("symbol", "tf", "t", "c o", "c + 1 h", "c - 1 l", "c", "1D v").cache()


def streamed(spark, rows, path, f, name, mode="append", files=3):
    """``f`` over ``rows`` as a stream of several batches."""
    parts = rows.toPandas()
    size = -(-len(parts) // files)
    for i in range(files):
        spark.createDataFrame(parts.iloc[i * size : (i + 1) * size], rows.schema).coalesce(1).write.mode("append").parquet(str(path))
    read = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    q = f(read).writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_inferred_closes(spark, tmp_path):
    rows = [(0, 1.0, False), (0, 2.0, False), (H, 5.0, False), (0, 2.5, True), (H, 6.0, True), (2 * H, 7.0, False), (H, 9.0, False), (3 * H, 8.0, True)]
    df = spark.createDataFrame([("a", "H1", t, c, c, c, c, 1.0, closed, i) for i, (t, c, closed) in enumerate(rows)], live._BAR_SCHEMA + ", closed boolean, received long")
    got = [(r["t"], r["c"]) for r in streamed(spark, df, tmp_path / "in", live.inferred_closes, "closes", files=1).orderBy("t").collect()]
    assert got == [(0, 2.0), (H, 6.0), (2 * H, 7.0), (3 * H, 8.0)]
    assert {tuple(r) for r in streamed(spark, df, tmp_path / "in2", live.inferred_closes, "closes2").select("t", "c").collect()} <= {(0, 2.0), (0, 2.5), (H, 6.0), (H, 5.0), (2 * H, 7.0), (3 * H, 8.0)}


def test_online_equals_batch(spark, bars, tmp_path):
    ordered = bars.orderBy("t")
    mean = lambda x: pd.DataFrame({"value": x["c"].rolling(20).mean()})
    got = {(r["symbol"], r["t"]): r["value"] for r in streamed(spark, ordered, tmp_path / "in", lambda s: live.online(s, 20, mean, "value double"), "online").collect() if r["value"] is not None and r["value"] == r["value"]}
    want = {(r["symbol"], r["t"]): r["value"] for r in I.with_indicator(bars, "sma").where("value IS NOT NULL").collect()}
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_last_bars_seam_and_routes(spark, bars, tmp_path):
    history = bars.where("symbol = 'a'").where(F.col("t") < 50 * H)
    ends = streamed(spark, bars.orderBy("t"), tmp_path / "in", lambda s: live.after_history(s, history), "seam", files=1)
    assert {r["symbol"]: (r["n"], r["low"]) for r in ends.groupBy("symbol").agg(F.count("*").alias("n"), F.min("t").alias("low")).collect()} == {"a": (350, 50 * H), "b": (400, 0)}
    held = streamed(spark, bars.where("t < 10 * 3600000").orderBy("t"), tmp_path / "few", lambda s: live.last_bars(s, 3), "held", files=1).where("symbol = 'a'").orderBy("t").collect()
    assert [len(r["closes"]) for r in held] == [1, 2] + [3] * 8 and all(r["closes"][-1] == r["c"] for r in held)
    watchers = spark.createDataFrame([("x", "a", "H1"), ("y", "a", "H1"), ("x", "a", "H1"), ("z", "b", "H4")], "rule string, symbol string, tf string")
    assert live.routed(bars, watchers).count() == 800


def test_forming_candles_and_delivery(spark, bars, tmp_path):
    got = streamed(spark, bars.orderBy("t"), tmp_path / "in", lambda s: live.forming_candles(s, "H1", "H4", "30 days"), "forming", "complete", 1)
    want = {(r["symbol"], r["t"]): (r["o"], r["h"], r["l"], r["c"]) for r in resample.resample(bars, "H4").collect()}
    assert {(r["symbol"], r["t"]): (r["o"], r["h"], r["l"], r["c"]) for r in got.collect()} == want and {r["fill"] for r in got.collect()} == {1.0}
    late = live.delivery(bars.withColumn("received", F.col("t") + H + 250))
    assert {r["ms"] for r in late.collect()} == {250}


def test_routes_closed_bars_and_updates_on_a_stream(spark, bars, tmp_path):
    watchers = spark.createDataFrame([("x", "a", "H1"), ("y", "a", "H1"), ("z", "b", "H4")], "rule string, symbol string, tf string")
    updates = bars.where("t < 20 * 3600000").withColumn("closed", F.expr("if(t % 7200000 = 0, true, if(t % 10800000 = 0, null, false))")).orderBy("t")
    got = streamed(spark, updates, tmp_path / "in", lambda s: live.routed(live.closed_only(s), watchers), "routes")
    assert {(r["rule"], r["t"]) for r in got.collect()} == {(k, t * H) for k in "xy" for t in range(0, 20, 2)} and "closed" not in got.columns
    some = bars.where("symbol = 'a' AND t < 20 * 3600000").orderBy("t")
    seen = streamed(spark, some, tmp_path / "in2", lambda s: live.forming_candles(s, "H1", "H4", "30 days"), "grown", "update", 5).collect()
    last = {t: max((r for r in seen if r["t"] == t), key=lambda r: r["fill"]) for t in {r["t"] for r in seen}}
    want = {r["t"]: (r["o"], r["h"], r["l"], r["c"]) for r in resample.resample(some, "H4").collect()}
    assert {t: (r["o"], r["h"], r["l"], r["c"]) for t, r in last.items()} == want and all(r["fill"] == 1.0 for r in last.values())


def _cross(s, fast=20, slow=50):
    a, b = s.smooth((s.c, 2 / (fast + 1), fast), (s.c, 2 / (slow + 1), slow))
    return rules.crossed_up(s, a, b), rules.crossed_down(s, a, b)


def test_rules_of_users(bars):
    plain = {tuple(r) for r in rules.signals(bars, "ma_crossover").select("symbol", "t", "direction").collect()}
    assert {tuple(r) for r in custom.custom_signals(bars, "mine", _cross).select("symbol", "t", "direction").collect()} == plain and plain
    sets = custom.signals_by_set(bars, "mine", _cross, {"20/50": {}, "5/10": {"fast": 5, "slow": 10}})
    assert {tuple(r) for r in sets.where("parameters = '20/50'").select("symbol", "t", "direction").collect()} == plain
    assert sets.where("parameters = '5/10'").count() > len(plain)


def test_regimes_detectors_and_configuration(bars):
    jump = lambda s: (F.abs(pct_change(s, s.c, 1)) > 0.02, F.abs(pct_change(s, s.c, 1)) * 10)
    found = custom.detected(bars, {"jump": (30, jump), "any": (399, lambda s: (F.lit(True), F.lit(2.0)))})
    got = {(r["detector"], r["symbol"], r["t"] // H) for r in found.collect()}
    closes = [r["c"] for r in bars.where("symbol = 'a'").orderBy("t").collect()]
    want = {("jump", s, i) for s in "ab" for i in range(29, 400) if abs(closes[i] / closes[i - 1] - 1) > 0.02} | {("any", s, i) for s in "ab" for i in (398, 399)}
    assert got == want and all(r["confidence"] == 1.0 for r in found.where("detector = 'any'").collect())
    made = custom.custom_regime(bars, lambda s: (s.sma(s.c, 5), F.when(s.c > s.sma(s.c, 5), "up").otherwise("down"), s.deviation(s.c, 5), F.lit("normal")))
    assert made.where("trend.status = 'up'").count() > 0 and made.where("volatility.value IS NULL").count() == 8
    both = custom.with_indicators(bars, [{"type": "sma", "n": 5}, {"type": "sma", "n": 9, "as": "slow"}])
    assert {"sma_value", "slow_value"} <= set(both.columns) and both.count() == 800
    assert custom.detected(bars.limit(0), {"jump": (30, jump)}).count() == 0
