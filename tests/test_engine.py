"""Recurrences against plain loops, resampling rules, pairing, streams, sources."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.sheet import Sheet
from barloom.operators import book, indicators, patterns, resample, rules, trades
from barloom.sources import bars as source
from barloom.streaming import bars as streams

SCHEMA = "symbol string, tf string, t long, o double, h double, l double, c double, v double"


@pytest.fixture(scope="module")
def rows():
    out = []
    for k, s in enumerate("ab"):
        p = 100.0
        rng = np.random.default_rng(k)
        for i in range(400):
            c = p + rng.normal()
            out.append((s, "H1", i * 3_600_000, p, max(p, c) + 0.3, min(p, c) - 0.2, c, float(rng.integers(1, 9))))
            p = c
    return out


@pytest.fixture(scope="module")
def bars(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def plain_ema(x, n, alpha):
    y, out, seen = None, [], []
    for v in x:
        if v is None:
            out.append(y)
            continue
        if y is None:
            seen.append(v)
            y = sum(seen) / n if len(seen) == n else None
        else:
            y = alpha * v + (1 - alpha) * y
        out.append(y)
    return out


def of(df, symbol, *names):
    got = df.where(F.col("symbol") == symbol).orderBy("t").collect()
    return [[r[n] for r in got] for n in names]


def same(a, b):
    assert [x is None for x in a] == [x is None for x in b]
    assert np.allclose([x for x in a if x is not None], [x for x in b if x is not None], rtol=1e-9, atol=1e-9)


def test_linear_recurrences(bars, rows):
    for s in "ab":
        c = [r[6] for r in rows if r[0] == s]
        e = plain_ema(c, 20, 2 / 21)
        same(of(indicators.with_indicator(bars, "ema"), s, "value")[0], e)
        same(of(indicators.with_indicator(bars, "smma", n=14), s, "value")[0], plain_ema(c, 14, 1 / 14))
        twice = plain_ema(e, 20, 2 / 21)
        same(of(indicators.with_indicator(bars, "dema"), s, "value")[0], [None if b is None else 2 * a - b for a, b in zip(e, twice, strict=True)])


def test_rsi_and_kama(bars, rows):
    c = [r[6] for r in rows if r[0] == "a"]
    d = [None] + [b - a for a, b in zip(c, c[1:], strict=False)]
    up, down = (plain_ema([None if x is None else max(s * x, 0) for x in d], 14, 1 / 14) for s in (1, -1))
    same(of(indicators.with_indicator(bars, "rsi"), "a", "value")[0], [None if u is None else 100.0 if w < 1e-15 else 100 - 100 / (1 + u / w) for u, w in zip(up, down, strict=True)])
    y, want = None, []
    for i, x in enumerate(c):
        if i >= 10:
            path = sum(abs(c[j] - c[j - 1]) for j in range(i - 9, i + 1))
            sc = (abs(x - c[i - 10]) / path * (2 / 3 - 2 / 31) + 2 / 31) ** 2
            y = sum(c[:11]) / 11 if y is None else y
            y += sc * (x - y)
        want.append(y)
    same(of(indicators.with_indicator(bars, "kama"), "a", "value")[0], want)


def test_heiken_ashi(bars, rows):
    want, o = [], None
    for r in (r for r in rows if r[0] == "b"):
        o = (r[3] + r[6]) / 2 if o is None else (o + last) / 2
        last = sum(r[3:7]) / 4
        want.append(o)
    same(of(indicators.with_indicator(bars, "heiken_ashi"), "b", "open")[0], want)


def test_scan_from_the_first_value(bars, rows):
    s = Sheet(bars)
    y = s.smooth((s.c, 0.3, 1), seed="first")[0]
    want, state = [], None
    for r in (r for r in rows if r[0] == "a"):
        state = r[6] if state is None else 0.3 * r[6] + 0.7 * state
        want.append(state)
    same(of(s.done(y=y), "a", "y")[0], want)


def loop_supertrend(rows, n=10, mult=3.0):
    """Bands by true-range arrays: the trailing band holds while its side lasts, the other one is the basic band."""
    h, low, c = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    tr = np.maximum(h - low, np.maximum(abs(h - np.r_[np.nan, c[:-1]]), abs(low - np.r_[np.nan, c[:-1]])))
    tr[0] = h[0] - low[0]
    atr = plain_ema(tr.tolist(), n, 1 / n)
    upper, lower, side, out = None, None, None, []
    for i, a in enumerate(atr):
        if a is None:
            out.append((None, None))
            continue
        basic = ((h[i] + low[i]) / 2 - mult * a, (h[i] + low[i]) / 2 + mult * a)
        if side is None:
            side, (lower, upper) = c[i] > basic[0], basic
        elif side and c[i] >= lower:
            lower, upper = max(lower, basic[0]), basic[1]
        elif not side and c[i] <= upper:
            lower, upper = basic[0], min(upper, basic[1])
        else:
            side, (lower, upper) = not side, basic
        out.append((lower if side else upper, side))
    return out


def loop_sar(rows, step=0.02, most=0.2):
    h, low = [r[1] for r in rows], [r[2] for r in rows]
    out = [(None, None), (min(low[0], low[1]), True)]
    sar, best, pace, up = out[1][0], h[1], step, True
    for i in range(2, len(rows)):
        sar += pace * (best - sar)
        sar = min(sar, low[i - 1], low[i - 2]) if up else max(sar, h[i - 1], h[i - 2])
        if (up and low[i] < sar) or (not up and h[i] > sar):
            up, sar, pace, best = not up, best, step, low[i] if up else h[i]
        elif (up and h[i] > best) or (not up and low[i] < best):
            best, pace = h[i] if up else low[i], min(most, pace + step)
        out.append((sar, up))
    return out


def test_grouped_kernels_against_other_loops(bars, rows):
    own = [r[3:7] for r in rows if r[0] == "a"]
    for name, columns, loop in (("supertrend", ("value", "bullish"), loop_supertrend), ("parabolic_sar", ("sar", "bullish"), loop_sar)):
        got = of(indicators.with_indicator(bars, name), "a", *columns)
        for a, b in zip(got, zip(*loop(own), strict=True), strict=True):
            same([None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x) for x in a], [None if x is None else float(x) for x in b])


def test_a_long_decay_does_not_underflow(spark):
    one = spark.createDataFrame([("a", "H1", i, 0.0, 0.0, 0.0, float(i % 7), 1.0) for i in range(400)], SCHEMA)
    for alpha in (0.999, 0.9999999):
        s = Sheet(one)
        y = s.smooth((s.c, alpha, 1), seed="first")[0]
        state, want = None, []
        for i in range(400):
            state = float(i % 7) if state is None else alpha * (i % 7) + (1 - alpha) * state
            want.append(state)
        same(of(s.done(y=y), "a", "y")[0], want)


def test_engulfing_covers_a_flat_bar(spark):
    flat = [("a", "H1", 0, 5.0, 6.0, 4.0, 5.0, 1.0), ("a", "H1", 3_600_000, 5.5, 6.0, 4.0, 4.5, 1.0)]
    assert [r["engulfing_bear"] for r in patterns.candlesticks(spark.createDataFrame(flat, SCHEMA)).orderBy("t").collect()][1] is True


def fills_of(spark, *rows):
    return spark.createDataFrame([("X", i, *r) for i, r in enumerate(rows, 1)], "symbol string, t long, side string, qty double, price double, commission double")


def test_fills_to_trades(spark):
    run = lambda *rows: [r.asDict() for r in book.trades_of_fills(fills_of(spark, *rows), ["symbol"], ["t"]).orderBy("exit_t").collect()]
    (one,) = run(("buy", 2.0, 100.0, 1.0), ("sell", 2.0, 110.0, 1.5))
    assert abs(one["pnl"] - 17.5) < 1e-9 and one["commission"] == 2.5 and one["side"] == "long" and (one["entry_t"], one["exit_t"]) == (1, 2)
    (part,) = run(("buy", 4.0, 100.0, 4.0), ("sell", 1.0, 110.0, 1.0))
    assert abs(part["pnl"] - 8.0) < 1e-9
    (cover,) = run(("sell", 2.0, 100.0, 0.0), ("buy", 5.0, 90.0, 0.0))
    assert abs(cover["pnl"] - 20) < 1e-9 and cover["side"] == "short"
    both = run(("sell", 2.0, 100.0, 1.0), ("buy", 5.0, 90.0, 5.0), ("sell", 3.0, 95.0, 0.0))
    assert [round(x["pnl"], 9) for x in both] == [20 - 1 - 2, 15 - 3] and both[1]["entry_t"] == 2
    added = run(("buy", 1.0, 100.0, 0.0), ("buy", 3.0, 120.0, 0.0), ("sell", 2.0, 130.0, 0.0), ("buy", 2.0, 140.0, 0.0), ("sell", 4.0, 100.0, 0.0))
    assert [round(x["entry_price"], 9) for x in added] == [115.0, 127.5] and [round(x["pnl"], 9) for x in added] == [30.0, -110.0]
    assert run() == [] and run(("buy", 1.0, 1.0, 0.0)) == []


def test_next_open_and_equity(spark, bars):
    marks = spark.createDataFrame([("r", "a", "H1", i * 3_600_000, d) for i, d in ((5, "long"), (6, "long"), (9, "exit"), (399, "long"))], "rule string, symbol string, tf string, t long, direction string")
    fills = book.next_open_fills(bars, marks, commission=0.0, slippage=0.0)
    got = [(r["t"] // 3_600_000, r["side"]) for r in fills.orderBy("t").collect()]
    assert got == [(6, "buy"), (10, "sell")]
    one = bars.where("symbol = 'a'")
    curve = {r["t"] // 3_600_000: r["equity"] for r in book.marked_equity(one, fills, 1000.0, span=7 * 3_600_000).collect()}
    price = {r["t"] // 3_600_000: r for r in one.collect()}
    assert curve[5] == 1000 and abs(curve[8] - (1000 - price[6]["o"] + price[8]["c"])) < 1e-9 and abs(curve[399] - (1000 - price[6]["o"] + price[10]["o"])) < 1e-9
    wide = book.last_prices(bars.where("symbol = 'a' OR t % 7200000 = 0"), ["a", "b"], span=5 * 3_600_000)
    closes = {(r["symbol"], r["t"]): r["c"] for r in bars.collect()}
    assert all(r["b"] == closes["b", r["t"] // 7_200_000 * 7_200_000] and r["a"] == closes["a", r["t"]] for r in wide.collect())


def test_as_of_by_buckets(bars):
    high = resample.resample(bars, "H4")
    few, many = (sorted(map(tuple, resample.as_of(bars, high, "H1", "H4", ["t", "c"], buckets=n).collect())) for n in (3, 512))
    assert few == many and len(few) == 800


def test_constant_market(spark):
    flat = spark.createDataFrame([("a", "H1", i * 3_600_000, 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(120)], SCHEMA)
    last = lambda name, col="value": indicators.with_indicator(flat, name).orderBy(F.desc("t")).first()[col]
    assert last("rsi") == 100 and last("williams_r") == -50 and last("stochastic", "k") == 50 and last("cci") == 0 and last("bop") is None
    assert last("chop") == 100 and last("sma") == 5 and last("mfi") == 100 and last("bbands", "percent_b") == 0.5 and last("uo") == 50


def test_pairing(bars):
    for r in rules.paired(bars, "ma_crossover").collect():
        assert r["exit_t"] >= r["entry_t"] and abs(r["ret"] - (r["exit_price"] / r["entry_price"] - 1)) < 1e-12
    marks = rules.signals(bars, "macd_ma").where("symbol = 'a'").orderBy("t").collect()
    kinds = [m["direction"] for m in marks]
    assert kinds == ["long", "exit"] * (len(kinds) // 2) + ["long"] * (len(kinds) % 2)


def test_as_of_shows_a_higher_bar_that_closes_together(spark, bars):
    high = resample.resample(bars, "H4")
    got = {r["t"]: r["htf_t"] for r in resample.as_of(bars, high, "H1", "H4", ["t"]).where("symbol = 'a'").collect()}
    assert got[0] is None and got[2 * 3_600_000] is None and got[3 * 3_600_000] == 0 and got[6 * 3_600_000] == 0 and got[7 * 3_600_000] == 4 * 3_600_000


def test_timeframe_and_hours(spark, bars):
    assert {r["tf"] for r in resample.detect_timeframe(bars).collect()} == {"H1"}
    assert resample.detect_timeframe(bars.where("t = 0")).first()["tf"] == "M1"
    assert source.market_hours(bars, None).count() == bars.count() and source.market_hours(bars, "HOSE").count() < bars.count()


def test_files(spark, bars, tmp_path):
    path = str(tmp_path / "bars")
    for symbol in "ab":
        source.write_bars(bars.where(F.col("symbol") == symbol), path)
    back = source.scan_bars(spark, path, 0, 9 * 3_600_000)
    assert back.count() == 20 and {r["symbol"] for r in back.collect()} == {"a", "b"} and {r["month"] for r in back.collect()} == {"1970-01"}
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0]
    source.write_bars(bars.where("symbol = 'a'").withColumn("c", F.lit(1.0)), path)
    assert source.scan_bars(spark, path, mixed=True).where("symbol = 'b'").count() == 400
    (tmp_path / "x.csv").write_text("Time,Open,High,Low,Close\n1700000000,1,2,0.5,1.5\n2023-11-15T00:00:00Z,1,2,0.5,1.5\nbad,1,2,3,4\n")
    assert sorted(r["t"] for r in source.scan_csv(spark, str(tmp_path / "x.csv")).collect()) == [1_700_000_000_000, 1_700_006_400_000]
    (tmp_path / "k.csv").write_text("open_time,o,h,l,c,v,x\n1700000000000000,1,2,0.5,1.5,7,0\n1700000060000,1,2,0.5,1.6,8,0\n")
    assert sorted((r["t"], r["c"]) for r in source.scan_kline_csv(spark, str(tmp_path / "k.csv")).collect()) == [(1_700_000_000_000, 1.5), (1_700_000_060_000, 1.6)]
    frames = ['{"k":{"t":5,"s":"btc-usdt","i":"1m","o":"1","h":"2","l":"0","c":"1.5","v":"3","x":true}}', '{"arg":{"channel":"candle1H","instId":"OKX:ETH-USDT"},"data":[["7","1","2","0","1.5","3","0","0","1"]]}']
    got = sorted((r["symbol"], r["tf"], r["t"], r["closed"]) for r in source.parse_kline_json(spark.createDataFrame([(f,) for f in frames], "value string")).collect())
    assert got == [("BTCUSDT", "1m", 5, True), ("ETHUSDT", "1H", 7, True)]


def test_order_projection(spark):
    events = [(1, 1, "order_filled", 5), (2, 1, "order_placed", 3), (3, 2, "order_placed", 1), (4, 2, "order_cancelled", 2), (5, 3, "order_filled", 9), (6, 4, "order_placed", 1)]
    got = {r["order_id"]: r["status"] for r in trades.order_projection(spark.createDataFrame(events, "seq long, order_id long, kind string, at long")).collect()}
    assert got == {1: "filled", 2: "cancelled", 4: "placed"}


def test_streams(spark, bars, tmp_path):
    bars.coalesce(1).sortWithinPartitions("t").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(bars.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    ticks = read().select("symbol", F.timestamp_millis("t").alias("ts"), F.col("t").alias("event_id"), F.col("c").alias("price"), F.col("v").alias("volume"))
    got = {(r["symbol"], r["t"]): r["c"] for r in run(streams.tumbling_bars(ticks, "4 hours"), "tumbling").collect()}
    want = {(r["symbol"], r["t"]): r["c"] for r in resample.resample(bars, "H4").collect()}
    assert got and got.items() <= want.items() and len(got) >= len(want) - 4
    assert run(streams.in_order(read()), "ordered").count() == bars.count()
    sink = streams.journal(str(tmp_path / "journal"), ["symbol", "t"])
    sink(bars, 0)
    sink(bars, 0)
    assert spark.read.parquet(str(tmp_path / "journal")).count() == bars.count()


def plain_trades(fills):
    """(qty, entry price, exit price, pnl) of each close, by a mutable position."""
    held, cost, fees, out = 0.0, 0.0, 0.0, []
    for side, qty, price, commission in fills:
        d = qty if side == "buy" else -qty
        if held * d < 0:
            closed = min(abs(held), qty)
            average, fee = cost / abs(held), fees * closed / abs(held) + commission * closed / qty
            out.append((closed, average, price, (price - average) * closed * (1 if held > 0 else -1) - fee))
            cost, fees = cost - average * closed, fees - fees * closed / abs(held)
            held = held - closed if held > 0 else held + closed
            held = 0.0 if abs(held) < 1e-9 else held
            if not held:
                cost = fees = 0.0
            d, commission = (qty - closed) * (1 if d > 0 else -1), commission * (qty - closed) / qty
        if abs(d) >= 1e-9:
            held, cost, fees = held + d, cost + price * abs(d), fees + commission
    return out


@pytest.mark.parametrize("kind", ["halved", "random"])
def test_positions_that_are_part_closed_often(spark, kind):
    rng = random.Random(kind)
    if kind == "halved":
        rows = [("buy", 1.0, 100.0, 0.1)] + [x for _ in range(5000) for x in (("buy", 1.0, 100 + rng.random(), 0.1), ("sell", 1.0, 100 + rng.random(), 0.1))]
    else:
        rows = [(rng.choice(("buy", "buy", "sell")), rng.randint(1, 64) / 16, 100 + rng.random(), 0.1) for _ in range(4000)]
        rows += [(rng.choice(("buy", "sell")), rng.randint(1, 64) / 16, 100 + rng.random(), 0.1) for _ in range(4000)]
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "symbol string, t long, side string, qty double, price double, commission double")
    got = book.trades_of_fills(df, ["symbol"], ["t"]).orderBy("exit_t").collect()
    want = plain_trades(rows)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert [g["qty"], g["entry_price"], g["exit_price"], g["pnl"]] == pytest.approx(list(w), rel=1e-9, abs=1e-9)
