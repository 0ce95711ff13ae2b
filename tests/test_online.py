"""Indicators and rules bar by bar on a stream equal the columns over the whole table, across restarts, seams, gaps and repeats."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from barloom.operators import indicators as I
from barloom.operators import rules
from barloom.streaming import online as on

H = 3_600_000


@pytest.fixture(scope="module")
def bars(spark):
    on.use_rocksdb(spark)
    x = spark.range(400).selectExpr("explode(array('a', 'b')) symbol", "'H1' tf", "id * 3600000 t", "100 + 10 * sin(id / 5) + 3 * sin(id * 1.7) + if(symbol = 'a', 0, cos(id / 9)) c")
    return x.selectExpr("symbol", "tf", "t", "c o", "c + 1 h", "c - 1 l", "c", "1D v").cache()


def outputs():
    line, signal = on.macd()
    fast, slow, x, strength = on.ema(20), on.ema(50), on.Price(), on.rsi()
    return {
        "ema": on.ema(20), "rsi": strength, "line": line, "signal": signal, "mean": on.Mean(x, 20), "up": on.Crossed(fast, slow, 1), "down": on.Crossed(fast, slow, -1),
        "rsi_up": on.Crossed(strength, on.Level(50.0), 1), "rsi_down": on.Crossed(strength, on.Level(50.0), -1),
    }


def put(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, path, out, check, schema, made, initial=None):
    """One start of the query: it takes what files there are and stops."""
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    q = on.online(read, made, initial).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(check)).trigger(availableNow=True).start()
    q.awaitTermination(240)


def close(got, want):
    assert len(got) == len(want) and set(got) == set(want)
    for k, a in got.items():
        for x, y in zip(a, want[k], strict=True):
            assert (x is None or x != x) == (y is None) and (y is None or abs(x - y) < 1e-9), (k, a, want[k])


def table(df, names):
    return {(r["symbol"], r["t"]): tuple(r[n] for n in names) for r in df.collect()}


def test_columns_are_the_indicators(bars):
    made = on.with_nodes(bars, outputs())
    assert {k: v[0] for k, v in table(made, ["ema"]).items()} == pytest.approx({k: v[0] for k, v in table(I.with_indicator(bars, "ema"), ["value"]).items()}, nan_ok=True)
    for name, theirs, field in (("rsi", "rsi", "value"), ("signal", "macd", "signal")):
        close(table(made, [name]), table(I.with_indicator(bars, theirs), [field]))
    plain = {tuple(r) for r in rules.signals(bars, "ma_crossover").select("symbol", "t", "direction").collect()}
    assert {tuple(r) for r in on.crossing_signals(made, "mine").select("symbol", "t", "direction").collect()} == plain and plain


def test_stream_with_a_restart_equals_the_table(spark, bars, tmp_path):
    names = list(outputs())
    rows = sorted(bars.collect(), key=lambda r: r["t"])
    for part in (rows[:130], rows[100:300]):  # the second file repeats bars of the first
        put(spark, part, tmp_path / "in", bars.schema)
        run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check", bars.schema, outputs())
    put(spark, rows[300:], tmp_path / "in", bars.schema)
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check", bars.schema, outputs())
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 800
    whole = on.with_nodes(bars, outputs()).cache()
    close(table(got, names), table(whole, names))
    signals = lambda df: {tuple(r) for r in on.crossing_signals(df, "rsi", "rsi_up", "rsi_down").select("symbol", "t", "direction").collect()}
    assert signals(got) == signals(whole) != set()


@pytest.mark.parametrize("cut", [7, 150])
def test_history_then_live(spark, bars, tmp_path, cut):
    names, made = list(outputs()), outputs()
    history = bars.where(f"t < {cut * H} AND symbol = 'a'")  # b has no history
    live = bars.where(f"(t >= {(cut - 3) * H} AND (t < 300 * {H} OR t >= 305 * {H})) OR symbol = 'b'")
    put(spark, sorted(live.collect(), key=lambda r: r["t"]), tmp_path / "in", bars.schema)
    initial = on.final_state(history, made, rows=None if cut == 7 else 120)
    run(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check", bars.schema, made, initial)
    both = history.unionByName(live.join(history, ["symbol", "tf", "t"], "left_anti").select(*bars.columns))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = {k: v for k, v in table(on.with_nodes(both, made), names).items() if k[0] == "b" or k[1] >= cut * H}
    close(table(got, names), want)
    assert [tuple(r) for r in on.gaps_of(got, H).select("symbol", "after", "before", "missing").collect()] == [("a", 299 * H, 305 * H, 5)]
    assert got.where(F.col("step").isNull()).count() == 1


def test_projection_of_a_forming_bar(spark, bars):
    made, names = outputs(), list(outputs())
    states = on.final_state(bars.where(f"t < 100 * {H}"), made)
    forming = bars.where(f"t = 100 * {H}").withColumn("c", F.col("c") + 3).unionByName(bars.where(f"t IN (99 * {H}, 100 * {H})"))
    got = on.projected(forming, states, made).collect()
    assert len(got) == 4
    own = lambda i: F.concat(F.col("symbol"), F.lit(str(i)))
    again = [bars.where(f"t < 100 * {H} AND symbol = '{r['symbol']}'").unionByName(spark.createDataFrame([tuple(r[c] for c in bars.columns)], bars.schema)).withColumn("symbol", own(i)) for i, r in enumerate(got)]
    want = table(on.with_nodes(reduce(lambda x, y: x.unionByName(y), again), made), names)
    key = lambda i, r: (f"{r['symbol']}{i}", r["t"])
    close({key(i, r): tuple(r[n] for n in names) for i, r in enumerate(got)}, {key(i, r): want[key(i, r)] for i, r in enumerate(got)})
    fresh = on.projected(forming, states.limit(0), {"ema": on.ema(1), "rsi": on.rsi()}).collect()
    assert len(fresh) == 6 and all(r["ema"] == r["c"] for r in fresh)
