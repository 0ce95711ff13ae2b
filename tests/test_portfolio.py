"""Prices of many symbols, baskets, exposure, guards, payloads and resolved sources against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import custom, indicators, journals, portfolio, resample, risk, rules
from barloom.sources import bars as source

H = 3_600_000
BAR = "symbol string, tf string, t long, o double, h double, l double, c double, v double"


@pytest.fixture(scope="module")
def bars(spark):
    rng = random.Random(2)
    rows = []
    for k, s in enumerate("abcde"):
        p = 100.0
        for i in range(k * 20, 300):
            if rng.random() < 0.6 and not (s == "c" and 80 < i < 200):
                p += rng.gauss(0, 1)
                rows.append((s, "H1", i * H, p, p + 1, p - 1, p, 1.0))
    return spark.createDataFrame(rows, BAR).repartition(4).cache()


def test_last_known_prices(spark, bars):
    rows = sorted(bars.collect(), key=lambda r: r["t"])
    want, seen = {}, {}
    for t in sorted({r["t"] for r in rows}):
        seen |= {r["symbol"]: r["c"] for r in rows if r["t"] == t}
        want |= {(t, s): c for s, c in seen.items()}
    for span in (7 * H, 1000 * H):
        assert {(r["t"], r["symbol"]): r["c"] for r in portfolio.last_known(bars, span).collect()} == want
    assert portfolio.last_known(bars.limit(0)).count() == 0
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") or df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans(portfolio.basket(bars, list("ab"))) == scans(portfolio.basket(bars, list("abcde"))) > 0
    both = portfolio.basket(bars, ["a", "c"]).orderBy("t").collect()
    of = {t: {s: want.get((t, s)) for s in "ac"} for t in {r["t"] for r in rows if r["symbol"] in "ac"}}
    assert {r["t"]: {"a": r["a"], "c": r["c"]} for r in both} == of
    apart = portfolio.basket_signals(bars, "spread", ["a", "c"], lambda s, p: (p["a"] - p["c"] > 1, p["a"] - p["c"] < -1))
    assert {(r["t"], r["direction"]) for r in apart.collect()} == {(t, "long" if x["a"] - x["c"] > 1 else "exit") for t, x in of.items() if None not in x.values() and abs(x["a"] - x["c"]) > 1}


def test_exposure_and_guard(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        a = rng.randrange(300)
        rows.append((rng.choice("xy"), i, a * H, (a + rng.randrange(40)) * H, float(rng.randint(1, 9)), float(rng.randint(1, 20)), rng.gauss(0, 60)))
    df = spark.createDataFrame(rows, "hand string, trade long, entry_at long, exit_at long, qty double, entry_price double, net_pnl double")
    for span in (11 * H, 9999 * H):
        got = {r["trade"]: (r["gross"], r["open"], r["limit"], r["blocked"]) for r in portfolio.exposure_guard(df, ["hand"], ["trade"], 0.5, 1000.0, span).collect()}
        for hand, trade, entry, _, *_rest in rows:
            held = [r for r in rows if r[0] == hand and (r[2], r[1]) <= (entry, trade) and r[3] >= entry]
            gross, limit = sum(r[4] * r[5] for r in held), max(0.0, 1000 + sum(r[6] for r in rows if r[0] == hand and r[3] <= entry)) * 0.5
            assert got[trade] == (pytest.approx(gross), len(held), pytest.approx(limit, abs=1e-6), gross > limit)
    assert {x[3] for x in got.values()} == {True, False}


def test_summary_reads_trades_once(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("xyz"), rng.choice(["A", "B", None]), rng.choice(["long", "short"]), float(rng.randint(1, 9)), i, rng.randrange(60) * H, rng.choice([None, 50.0, 70.0]), rng.randrange(60, 200) * H, rng.randint(-99, 99) / 8) for i in range(300)]
    spark.createDataFrame(rows, "hand string, symbol string, side string, qty double, trade long, entry_at long, entry_price double, exit_at long, net_pnl double").write.parquet(str(tmp_path / "t"))
    df, at = spark.read.parquet(str(tmp_path / "t")), 100 * H
    made = portfolio.portfolio_summary(df, None, at, order=("trade",))
    assert scans(made.drop("drawdown")) == 1
    last = {s: max((r for r in rows if r[1] == s and r[5] <= at), key=lambda r: (r[5], r[4]))[6] for s in "AB"}
    given = portfolio.portfolio_summary(df, spark.createDataFrame(list(last.items()), "symbol string, c double"), at)
    got = {r["hand"]: r for r in made.collect()}
    assert got.keys() == set("xyz")
    for other in given.collect():
        hand, own = other["hand"], [r for r in rows if r[0] == other["hand"] and r[5] <= at]
        held = [r for r in own if r[7] > at]
        gain = sum((1 if r[2] == "long" else -1) * r[3] * (last[r[1]] - r[6]) for r in held if r[1] and r[6] and last[r[1]])
        want = (len(held), sum(r[3] * r[6] for r in held if r[6]), sum(r[8] for r in own if r[7] <= at), gain)
        for r in (got[hand], other):
            assert (r["open"], r["gross"], r["realised"], r["unrealised"]) == pytest.approx(want) and r["equity"] == pytest.approx(100_000 + want[2] + gain)


def test_payloads(spark):
    good = '{"symbol":"X","side":"SHORT","qty":2,"entryPrice":10,"exitPrice":8,"entryTime":1,"exitTime":5,"commission":0.5,"more":[1]}'
    rows = [
        ("position_closed", "a", 1, good), ("position_closed", "a", 2, good.replace("8", "7")), ("position_closed", "b", 1, good[:-9]), ("position_closed", "c", 1, None), ("position_closed", "d", 1, "[]"),
        ("position_closed", "e", 1, good.replace('"qty":2', '"qty":"many"')), ("position_closed", "f", 1, good.replace('"qty":2', '"qty":0')), ("position_closed", "g", 1, '{"symbol":"X"}'), ("position_opened", "h", 1, "{"),
    ]
    made, bad = portfolio.closed_trades(spark.createDataFrame(rows, "kind string, trade_id string, at long, payload string"))
    (one,) = made.collect()
    assert (one["trade_id"], one["side"], one["exit_price"], one["pnl"], one["net_pnl"], one["reason"]) == ("a", "short", 7.0, 6.0, 5.5, "unknown")
    assert {(r["trade_id"], r["why"]) for r in bad.collect()} == {("b", "malformed"), ("c", "missing"), ("d", "malformed"), ("e", "malformed"), ("f", "impossible"), ("g", "incomplete")}


def test_resolved_sources(spark, bars, tmp_path):
    one = bars.where("symbol = 'a'").drop("symbol", "tf")
    fine = spark.range(0, 1200).selectExpr("id * 900000 t", "1D * id o", "id + 2D h", "id - 1D l", "id + 1D c", "1D v")
    put = lambda df, *parts: df.coalesce(1).write.parquet(str(tmp_path.joinpath(*parts)))
    put(fine, "slow", "M15", "A")
    put(one, "fast", "H1", "A")
    put(fine, "fast", "M15", "B")
    put(fine.withColumn("c", F.lit(0.0)), "fast", "M30", "B")
    files = journals.catalog(spark, str(tmp_path))
    key = lambda df: sorted((r["t"], r["c"]) for r in df.collect())
    assert key(journals.load_resolved(spark, files, "a", "H1", ["fast", "slow"])) == key(one)
    quarters = journals.load_resolved(spark, files, "A", "H1", ["slow", "fast"])
    assert quarters.count() == 300 and quarters.where("t = 3600000").select("tf", "o", "h", "l", "c", "v").first() == ("H1", 4.0, 9.0, 3.0, 8.0, 4.0)
    assert key(journals.load_resolved(spark, files, "B", "H1", ["fast"])) == key(quarters)  # the finest lower one, not the nearest
    assert key(journals.load_resolved(spark, files, "B", "M15", ["fast"])) == key(fine)
    assert journals.load_resolved(spark, files, "C", "H1", ["fast"]).count() == 0
    assert key(journals.held_before(spark, files, "B", "H1", ["fast"], 10 * H, 3)) == [(t * H, 4.0 * t + 4) for t in (7, 8, 9)]
    assert key(journals.held_range(spark, files, "B", "H1", ["fast"], 2 * H, 4 * H)) == [(2 * H, 12.0), (3 * H, 16.0)]


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Relation ") + plan.count("Relation[")


def test_plans_do_not_grow_with_what_is_asked_for(spark, bars, tmp_path):
    source.write_bars(bars, str(tmp_path / "bars"))
    stored = spark.read.schema(bars.schema).parquet(str(tmp_path / "bars"))
    specs = [{"type": t, "n": n, "as": f"{t}{n}"} for t in ("sma", "ema", "rsi", "cci") for n in (5, 9)] + [{"type": "obv"}, {"type": "vwap"}]
    assert scans(custom.with_indicators(stored, specs[:2])) == scans(custom.with_indicators(stored, specs[:8])) == scans(custom.with_indicators(stored, specs)) - 0 > 0
    both = custom.with_indicators(bars, specs)
    for spec in ({"type": "ema", "n": 9}, {"type": "obv"}):
        name = {"ema": "ema9", "obv": "obv"}[spec["type"]]
        field = {"ema": "value", "obv": "value"}[spec["type"]]
        one = indicators.with_indicator(bars, spec["type"], **{k: v for k, v in spec.items() if k == "n"})
        a = {(r["symbol"], r["t"]): r[f"{name}_{field}"] for r in both.collect()}
        b = {(r["symbol"], r["t"]): r[field] for r in one.collect()}
        assert a.keys() == b.keys() and all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-9 for k in a)
    few, many = ("ma_crossover", "roc"), ("ma_crossover", "roc", "ao", "dual_momentum", "donchian_breakout", "rsi_ma_cross", "cci_reversal", "tsi")
    assert scans(rules.leaderboard(stored, few)) == scans(rules.leaderboard(stored, many)) > 0


def test_candles_and_ladder(spark, bars, tmp_path):
    plain = {}
    for s in "ab":
        o = c = None
        for r in sorted((r for r in bars.collect() if r["symbol"] == s), key=lambda r: r["t"]):
            close = (r["o"] + r["h"] + r["l"] + r["c"]) / 4
            o = (r["o"] + r["c"]) / 2 if o is None else (o + c) / 2
            c = close
            plain[s, r["t"]] = (o, max(r["h"], o, c), min(r["l"], o, c), c)
    made = indicators.candles(bars, "heiken_ashi")
    got = {(r["symbol"], r["t"]): (r["o"], r["h"], r["l"], r["c"]) for r in made.collect()}
    assert made.columns == bars.columns and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in plain.items())
    means = {(r["symbol"], r["t"]): r["value"] for r in indicators.with_indicator(made, "sma", n=3).collect()}
    times = sorted(t for s, t in plain if s == "a")
    assert means["a", times[5]] == pytest.approx(sum(plain["a", t][3] for t in times[3:6]) / 3)
    resample.write_ladder(bars, ["H1", "H4", "D1"], str(tmp_path / "ladder"))
    back = spark.read.parquet(str(tmp_path / "ladder"))
    for tf in ("H4", "D1"):
        assert back.where(F.col("tf") == tf).count() == resample.resample(bars, tf).count() > 0


def test_bootstrap_bands(spark):
    returns = spark.createDataFrame([(s, i, ((i * 7 + k) % 11 - 5) / 100) for k, s in enumerate("xy") for i in range(40)], "symbol string, i long, ret double")
    paths = risk._resampled(returns, 50, 3).collect()
    bands = {(r["symbol"], r["k"]): r for r in risk.bootstrap_bands(returns, 50, 3).collect()}
    assert len(bands) == 80
    for s, k in (("x", 0), ("y", 17), ("x", 39)):
        import math

        values = sorted(math.exp(r["x"]) for r in paths if (r["symbol"], r["k"]) == (s, k))
        at = lambda q: (lambda p: values[int(p)] + (values[min(int(p) + 1, 49)] - values[int(p)]) * (p - int(p)))(q * 49)  # noqa: B023, E731
        assert [bands[s, k][f"p{q}"] for q in (5, 50, 95)] == pytest.approx([at(0.05), at(0.5), at(0.95)])
    final = {r["symbol"]: r["p50"] for r in risk.bootstrap(returns, 50, 3).collect()}
    assert final["x"] == pytest.approx(bands["x", 39]["p50"])


@pytest.mark.parametrize("width", [2, 64])
def test_correlations_by_tiles(bars, width):
    from barloom.operators import series

    rows = {}
    for r in bars.collect():
        rows.setdefault(r["symbol"], {})[r["t"]] = r["c"] + 50_000
    got = {(r["a"], r["b"]): r["r"] for r in series.correlations(bars.withColumn("c", F.col("c") + 50_000), width).collect()}
    assert len(got) == 25
    for (a, b), r in got.items():
        both = sorted(rows[a].keys() & rows[b].keys())
        x, y = [rows[a][t] for t in both], [rows[b][t] for t in both]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        cov = sum((p - mx) * (q - my) for p, q in zip(x, y, strict=True))
        want = 1.0 if a == b else cov / (sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y)) ** 0.5
        assert r == pytest.approx(want, abs=1e-9)


def test_payloads_are_made_and_read_once(spark):
    from barloom.plans import queries

    sf = "/root/testdata/sf0.001"
    for name in ("closed_trades", "closed_trade_rejects"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == 1 and scans(queries.QUERIES[name](spark, sf)) == 3, name  # lineitem, orders and part


def exchanges(spark, df):
    """Shuffles of a plan that joins by sorting, those that it reads again left out."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(set(re.findall(r"Exchange hashpartitioning.*plan_id=(\d+)", plan)))


@pytest.fixture
def plain_plans(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_exposure_is_dealt_once(spark, plain_plans):
    from barloom.plans import queries

    # lineitem, orders, their join, part, points by span; one row a span by hand and back
    for name in ("open_exposure", "exposure_guard"):
        assert exchanges(spark, queries.QUERIES[name](spark, "/root/testdata/sf0.001")) == 7, name


def test_trades_without_an_end_are_held(spark):
    rows = [("x", 1, 0, None, 2.0, 10.0, None), ("x", 2, 5 * H, 6 * H, 1.0, 5.0, 50.0), ("x", 3, 6 * H, 9 * H, 1.0, 7.0, 1.0)]
    df = spark.createDataFrame(rows, "hand string, trade long, entry_at long, exit_at long, qty double, entry_price double, net_pnl double")
    for span in (H, 100 * H):
        got = [(r["gross"], r["open"], r["equity"]) for r in portfolio.exposure_guard(df, ["hand"], ["trade"], 1.0, 100.0, span).orderBy("trade").collect()]
        assert got == [(20.0, 1, 100.0), (25.0, 2, 100.0), (32.0, 3, 150.0)]
