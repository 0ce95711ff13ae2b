"""Exits, guards, sizing, resampling and replayed positions, held against plain loops."""

import itertools
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from barloom.functions import stats
from barloom.operators import risk

BARS = "symbol string, tf string, t long, o double, h double, l double, c double, v double"


def some_bars(n, seed):
    rng, c, out = random.Random(seed), 100.0, []
    for i in range(n):
        o, c = c, max(1.0, c + rng.gauss(0, 2))
        out.append(("a", "H1", i, o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, 1.0))
    return out


def outcome(rows, i, side, stop, target, most, trailing, heuristic):
    """reason, t, price, bars held, worst and best move."""
    entry = rows[i][6]
    sign = 1 if side == "long" else -1
    best = worst = 0.0
    price, held, at = None, 0, None
    for held, (_, _, at, o, h, lo, c, _) in enumerate(rows[i + 1 : i + 1 + most], 1):
        good, bad = (h, lo) if sign > 0 else (lo, h)
        best, worst = max(best, sign * (good - entry)), max(worst, sign * (entry - bad))
        stops = [(entry + sign * best, trailing), (stop, None)]
        levels = [(level * (1 - sign * share) if share is not None else level, name) for (level, share), name in zip(stops, ("trailing_stop", "stop_loss"), strict=True) if level is not None and (name == "stop_loss" or share is not None)]
        down = next(((p, n) for p, n in levels if sign * (bad - p) <= 0), None)
        up = (target, "take_profit") if target is not None and sign * (good - target) >= 0 else None
        first = (up or down) if heuristic and sign * (c - o) < 0 else (down or up)
        first = first or ((c, "max_bars_held") if held == most else None)
        price = c
        if first:
            return first[1], at, first[0], held, worst / entry, best / entry
    return None, at, price, held, worst / entry, best / entry


@pytest.mark.parametrize(("trailing", "heuristic"), [(None, False), (0.07, False), (0.07, True), (None, True)])
def test_barriers(spark, trailing, heuristic):
    rows = some_bars(150, 7)
    entries = []
    for i, side in itertools.product(range(0, 150, 3), ("long", "short")):
        c, sign = rows[i][6], 1 if side == "long" else -1
        entries.append(("a", "H1", i, side, c, None if i % 5 == 0 else c * (1 - 0.03 * sign), None if i % 7 == 0 else c * (1 + 0.05 * sign)))
    df = spark.createDataFrame(entries, "symbol string, tf string, t long, side string, entry_price double, stop double, target double")
    got = {(r["t"], r["side"]): r for r in risk.barriers(spark.createDataFrame(rows, BARS), df, 12, trailing, heuristic).collect()}
    assert len(got) == len(entries)
    reasons = set()
    for e in entries:
        r = got[e[2], e[3]]
        want = outcome(rows, e[2], e[3], e[5], e[6], 12, trailing, heuristic)
        reasons.add(want[0])
        assert (r["reason"], r["exit_t"], r["bars_held"]) == (want[0], want[1], want[3])
        assert all(x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in ((r["exit_price"], want[2]), (r["mae"], want[4]), (r["mfe"], want[5])))
    assert {None, "take_profit", "max_bars_held"} <= reasons


def test_kelly(spark):
    rng = random.Random(3)
    rows = [(s, i, 10.0 + i, rng.gauss(0.002, 0.02)) for s in "ab" for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, entry_t long, entry_price double, ret double")
    got = {(r["symbol"], r["entry_t"]): (r["kelly"], r["qty"]) for r in risk.kelly_sized(df).collect()}
    for s in "ab":
        past = []
        for _, i, price, ret in (r for r in rows if r[0] == s):
            wins, losses = [x for x in past if x > 0], [-x for x in past if x <= 0]
            p = len(wins) / len(past) if past else 0.5
            up, down = sum(wins) / len(wins) if wins else 0.02, sum(losses) / len(losses) if losses else 0.01
            f = p - (1 - p) * down / up
            assert math.isclose(got[s, i][0], f, rel_tol=1e-9, abs_tol=1e-12)
            assert math.isclose(got[s, i][1], max(0.0, min(1.0, f / 2)) * 100_000 / price, rel_tol=1e-9, abs_tol=1e-9)
            past.append(ret)
    none = spark.createDataFrame([("a", 0, 0.0, None)], df.schema)
    assert risk.kelly_sized(none).collect()[0]["qty"] == 0


def test_normal(spark):
    xs = [-6.0, -2.5, -0.3, 0.0, 0.7, 3.1]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", stats.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - NormalDist().cdf(r["x"])) < 1e-7 for r in got)
    ps = [1e-6, 0.01, 0.024, 0.3, 0.5, 0.9, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", stats.probit(F.col("p")).alias("x")).collect()
    assert all(abs(r["x"] - NormalDist().inv_cdf(r["p"])) < 1e-7 for r in got)
    ends = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(stats.probit(F.col("p")).alias("x")).collect()
    assert [r["x"] for r in ends] == [-math.inf, math.inf]


def test_skill(spark):
    rng = random.Random(1)
    xs = [rng.gauss(0.1, 1) for _ in range(200)]
    df = spark.createDataFrame([("a", x) for x in xs] + [("b", 1.0), ("b", 2.0)], "k string, ret double")
    got = {r["k"]: r for r in risk.skill(df, "k", trials=10).collect()}
    n, m = len(xs), sum(xs) / len(xs)
    moment = lambda k: sum((x - m) ** k for x in xs) / n
    sr, skew, kurt = m / math.sqrt(moment(2) * n / (n - 1)), moment(3) / moment(2) ** 1.5, moment(4) / moment(2) ** 2
    sd, normal = math.sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1)), NormalDist()
    best = (1 - risk.EULER) * normal.inv_cdf(0.9) + risk.EULER * normal.inv_cdf(1 - 1 / (10 * math.e))
    assert abs(got["a"]["psr"] - normal.cdf(sr / sd)) < 1e-6 and abs(got["a"]["dsr"] - normal.cdf(sr / sd - best)) < 1e-6
    assert got["b"]["psr"] == 0 == got["b"]["dsr"]


def test_bootstrap(spark):
    same = spark.createDataFrame([("a", i, 0.01) for i in range(30)] + [("b", i, -0.05) for i in range(20)], "symbol string, i int, ret double")
    got = {r["symbol"]: r for r in risk.bootstrap(same, paths=50).collect()}
    assert all(math.isclose(got["a"][p], 1.01**30, rel_tol=1e-9) for p in ("p5", "p50", "p95")) and got["a"]["ruin"] == 0 and got["a"]["paths"] == 50
    assert math.isclose(got["b"]["p50"], 0.95**20, rel_tol=1e-9) and got["b"]["ruin"] == 1
    rng = random.Random(2)
    mixed = spark.createDataFrame([("a", i, rng.gauss(0, 0.03)) for i in range(60)], same.schema)
    one, two = risk.bootstrap(mixed).collect(), risk.bootstrap(mixed.repartition(5)).collect()
    assert one == two and one[0]["p5"] < one[0]["p50"] < one[0]["p95"]
    assert risk.bootstrap(mixed.where("i < 0")).count() == 0


def test_lttb(spark):
    rng = random.Random(4)
    points = [("a", i * i + i, rng.gauss(0, 1)) for i in range(237)] + [("b", i, 1.0) for i in range(5)]
    got = [(r["t"], r["c"]) for r in risk.lttb(spark.createDataFrame(points, "symbol string, t long, c double"), 20).orderBy("symbol", "t").collect()]
    pts = [p[1:] for p in points if p[0] == "a"]
    n, size, at, want = len(pts), (len(pts) - 2) / 18, 0, [pts[0]]
    for b in range(18):
        lo, hi, nxt = math.floor(b * size + 1), min(math.floor((b + 1) * size + 1), n - 1), min(math.floor((b + 2) * size + 1), n)
        far = pts[hi:nxt] or pts[-1:]
        mt, mv = sum(p[0] for p in far) / len(far), sum(p[1] for p in far) / len(far)
        ax, ay = pts[at]
        at = max(range(lo, hi), key=lambda k: (abs((ax - mt) * (pts[k][1] - ay) - (ax - pts[k][0]) * (mv - ay)), k))  # noqa: B023
        want.append(pts[at])
    want.append(pts[-1])
    assert got == want + [p[1:] for p in points if p[0] == "b"] and len(want) == 20


def test_stitched(spark):
    rows = [("a", 0, 0, 10.0), ("a", 0, 1, 12.0), ("a", 1, 2, 50.0), ("a", 1, 3, 25.0), ("a", 2, 4, 8.0), ("a", 2, 5, 16.0)]
    got = [r["equity"] for r in risk.stitched(spark.createDataFrame(rows, "symbol string, fold int, t long, equity double")).orderBy("t").collect()]
    assert all(math.isclose(a, b) for a, b in zip(got, [10, 12, 12, 6, 6, 12], strict=True))


def test_summaries(spark):
    curves = spark.createDataFrame([("a", 0, 0, 10.0), ("a", 0, 1, 12.0), ("a", 1, 2, 50.0), ("a", 1, 3, 25.0)], "symbol string, fold int, t long, equity double")
    (r,) = risk.walk_forward_summary(curves).collect()
    assert (r["folds"], r["profitable"]) == (2, 0.5) and math.isclose(r["mean_return"], -0.15)
    rows = [(1, 1, "open", "buy", 2.0, 10.0, 0, 1.5), (1, 2, "idle", None, 0.0, 0.0, 0, -4.0), (2, 3, "idle", None, 0.0, 0.0, 0, 0.0)]
    positions = spark.createDataFrame(rows, "hand long, trade long, phase string, side string, qty double, entry_price double, adds int, pnl double")
    assert sorted(map(tuple, risk.holdings(positions).collect())) == [(1, 1, 20.0, -2.5), (2, 0, 0.0, 0.0)]
    rets = [(s, t, x) for t in range(20) for s, x in (("a", 0.01 * (-1) ** t), ("b", 0.03 * (-1) ** t))] + [("a", -1, None)]
    got = {r["symbol"]: r for r in risk.beta(spark.createDataFrame(rets, "symbol string, t long, ret double"), 252.0).collect()}
    assert math.isclose(got["a"]["beta"], 0.5) and math.isclose(got["b"]["beta"], 1.5) and abs(got["b"]["alpha"]) < 1e-9


def test_diversification_and_turnover(spark):
    schema = "symbol string, t long, ret double"
    mirrored = [(s, t, sign * 0.01 * (-1) ** t) for t in range(10) for s, sign in (("a", 1), ("b", -1))]
    (none,) = risk.diversification(spark.createDataFrame(mirrored, schema)).collect()
    assert none["ratio"] == 1.0 and none["portfolio_vol"] == 0.0
    (same,) = risk.diversification(spark.createDataFrame([(s, t, 0.01 * t) for t in range(10) for s in "ab"] + [("a", 10, None)], schema)).collect()
    assert math.isclose(same["ratio"], 1.0) and math.isclose(same["mean_vol"], same["portfolio_vol"])
    (half,) = risk.diversification(spark.createDataFrame([("a", t, 0.02 * (-1) ** t) for t in range(10)] + [("b", t, 0.0) for t in range(10)], schema)).collect()
    assert math.isclose(half["ratio"], 1.0)
    bars = spark.createDataFrame([("a", t) for t in range(50)] + [("b", t) for t in range(4)], "symbol string, t long")
    got = {r["symbol"]: r["turnover_pct"] for r in risk.turnover(bars.where("symbol = 'a' AND t < 5"), bars).collect()}
    assert got == {"a": 10.0, "b": 0.0}


def test_guards(spark):
    schema = "hand long, exit_at long, entry_at long, trade long, line int, part long, net_pnl double"
    pnl = [-500.0, -1800.0, 100.0, -9000.0, 50.0, 20.0]
    rows = [(1, i * risk.DAY // 2, 0, i, 1, 1, p) for i, p in enumerate(pnl)]
    df = spark.createDataFrame(rows, schema)
    got = risk.account_guards(df).orderBy("exit_at").collect()
    assert [r["halted"] for r in got] == [None, "daily_loss", None, "max_drawdown", "max_drawdown", "max_drawdown"]
    edge = risk.edge_guard(df, n=2, total=0.05, mean=0.04, single=0.03, losses=2).orderBy("exit_at").collect()
    assert [r["breach"] for r in edge] == [None, "consecutive_losses", None, "total_loss", "total_loss", None]
    assert [r["losing_run"] for r in edge] == [1, 2, 0, 1, 0, 0]


def test_replay(spark):
    e = lambda seq, kind, action="open", n=1, price=0.0, qty=0.0, side="buy": (1, 1, seq, kind, f"c{n}", f"o{n}", action, side, price, qty)
    schema = "hand long, trade long, seq long, kind string, client_id string, order_id string, action string, side string, price double, qty double"

    def last(*events):
        r = risk.replayed(spark.createDataFrame(list(events), schema)).collect()[0]
        return r["phase"], r["side"], r["qty"], r["entry_price"], r["adds"], r["pnl"]

    opened = [e(1, "order_place"), e(2, "order_placed"), e(3, "order_filled", price=10.0, qty=2.0)]
    added = [e(4, "order_place", "add", 2), e(5, "order_placed", "add", 2), e(6, "order_filled", "add", 2, 16.0, 1.0)]
    closed = [e(7, "order_place", "close", 3), e(8, "order_placed", "close", 3), e(9, "order_filled", "close", 3, 15.0, 3.0)]
    assert last(*opened) == ("open", "buy", 2.0, 10.0, 0, 0.0)
    assert last(*opened, *added) == ("open", "buy", 3.0, 12.0, 1, 0.0)
    assert last(*reversed([*opened, *added, *closed])) == ("idle", None, 0.0, 0.0, 0, 9.0)
    assert last(*opened, e(4, "order_place", "add", 2), e(5, "order_cancelled", "add", 2)) == ("open", "buy", 2.0, 10.0, 0, 0.0)
    assert last(e(1, "order_place"), e(2, "order_cancelled")) == ("idle", None, 0.0, 0.0, 0, 0.0)
    assert last(e(1, "order_filled", price=1.0, qty=1.0)) == ("idle", None, 0.0, 0.0, 0, 0.0)
    assert last(e(1, "order_place"), e(2, "order_placed", n=9)) == ("entering", "buy", 0.0, 0.0, 0, 0.0)
    sold = [e(1, "order_place", side="sell"), e(2, "order_placed", side="sell"), e(3, "order_filled", price=10.0, qty=2.0)]
    assert last(*sold, *closed)[-1] == -10.0


def test_periods_and_catalog(spark, tmp_path):
    from barloom.operators import journals

    now = 1_706_500_000_000  # 2024-01-29
    assert journals.period("mtd", now) == journals.period("ytd", now) == (1_704_067_200_000, now) and journals.period("24h", now) == (now - 86_400_000, now)
    one = spark.range(1).selectExpr("id AS t", "1.0 AS c")
    for place in ("okx/M1/btc/2024-01.parquet", "okx/M1/btc/2024-02.parquet", "okx/M5/BTC/2024-01-03_to_2024-01-09.parquet", "nyse/H1/BTC/all.parquet", "old_eod/H1/BTC/2024-01.parquet"):
        one.coalesce(1).write.parquet(str(tmp_path / "made" / place))
        (tmp_path / "root" / place).parent.mkdir(parents=True, exist_ok=True)
        next((tmp_path / "made" / place).glob("part-*")).rename(tmp_path / "root" / place)
    files = journals.catalog(spark, str(tmp_path / "root"))
    got = {(r["source"], r["tf"], r["symbol"], str(r["first"]), str(r["last"])) for r in files.collect()}
    assert got == {("okx", "M1", "BTC", "2024-01-01", "2024-01-31"), ("okx", "M1", "BTC", "2024-02-01", "2024-02-29"), ("okx", "M5", "BTC", "2024-01-03", "2024-01-09"), ("nyse", "H1", "BTC", "None", "None")}
    february = 1_706_918_400_000  # 2024-02-03: January's last day, a day wider, ends before it
    assert sorted((r["source"], str(r["first"])) for r in journals.pruned(files, february, None).collect()) == [("nyse", "None"), ("okx", "2024-02-01")]
    pick = lambda tf, *sources: {(r["source"], r["tf"]) for r in journals.resolved(files, "btc", tf, list(sources)).collect()}
    assert pick("H1", "okx", "nyse") == {("okx", "M1")} and pick("M5", "okx", "nyse") == {("okx", "M5")} and pick("H1", "nyse") == {("nyse", "H1")} and pick("M1", "nyse") == set()
    specs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "n int, rule string")
    assert specs.select(journals.spec_hash(F.struct("n", "rule")).alias("h")).distinct().count() == 2 and journals.bars_per_year("D1") == 365.25


def test_guards_sort_once(spark):
    schema = "hand long, exit_at long, entry_at long, trade long, line int, part long, net_pnl double"
    plan = risk.account_guards(spark.createDataFrame([(1, 5, 1, 1, 1, 1, 2.0)], schema))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") == 1


def test_fills_and_positions_sort_little(spark):
    from barloom.plans import queries

    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sorts = lambda name: queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count(" Sort [")
    try:
        assert sorts("fill_trades") == 3  # fills, parts by position, parts by block
        assert sorts("position_replay") == sorts("holdings") == 2  # lines as they are numbered, orders
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
