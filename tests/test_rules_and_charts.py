"""Chart patterns and the rules that keep state, held against plain loops over random walks."""

import math
import random

import pytest

from barloom.operators import charts, frames, indicators, resample, rules

SCHEMA = "symbol string, tf string, t long, o double, h double, l double, c double, v double"
HOUR, QUARTER = 3_600_000, 900_000


def walk(symbol, n, seed, tf="H1", step=HOUR, jump=1.5):
    rng, c, out = random.Random(seed), 100.0, []
    for i in range(n):
        o = c
        c = max(5.0, c + rng.gauss(0, jump) + 1.2 * math.sin(i / 17))
        wick = abs(rng.gauss(0, 0.6))
        t = i * step + (i // 50) * 3 * step  # a gap every 50 bars
        out.append((symbol, tf, t, o, max(o, c) + wick, min(o, c) - wick * rng.random(), c, float(rng.randint(1, 9))))
    return out


@pytest.fixture(scope="module")
def rows():
    return walk("a", 400, 1) + walk("b", 260, 2, jump=0.4) + walk("c", 12, 3)


@pytest.fixture(scope="module")
def bars(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).cache()


def series(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: r[2]) for k, v in out.items()}


def turning(part, size=3):
    """Pivots of a slice: two lists of (place, price, t)."""
    tops, dips = [], []
    for i in range(size, len(part) - size):
        near = part[i - size : i + size + 1]
        if part[i][4] == max(r[4] for r in near):
            tops.append((i, part[i][4], part[i][2]))
        if part[i][5] == min(r[5] for r in near):
            dips.append((i, part[i][5], part[i][2]))
    return tops, dips


def expected(rows, window=60):
    """(symbol, t, kind, pivots) of the patterns, and their targets, from each slice anew."""
    out = {}
    for symbol, all_ in series(rows).items():
        for end in range(1, len(all_) + 1):
            part = all_[max(0, end - window) : end]
            now, close, last = part[-1][2], part[-1][6], len(part) - 1
            tops, dips = turning(part)
            for name, long_name, mine, other, sign in (("double_top", "head_and_shoulders", tops, dips, 1), ("double_bottom", "inverse_head_and_shoulders", dips, tops, -1)):
                pick = lambda a, b: min((p for p in other if a < p[0] < b), key=lambda p: (sign * p[1], sign * p[0]), default=None)  # noqa: E731, B023
                for x, y in zip(mine, mine[1:], strict=False):
                    neck = pick(x[0], y[0])
                    if neck and abs(x[1] - y[1]) <= 0.03 * (x[1] + y[1]) / 2 and sign * (neck[1] - close) > 0:
                        out[symbol, now, name, (x[2], neck[2], y[2])] = 2 * neck[1] - (x[1] + y[1]) / 2
                for x, y, z in zip(mine, mine[1:], mine[2:], strict=False):
                    left, right = pick(x[0], y[0]), pick(y[0], z[0])
                    if left and right and sign * (y[1] - x[1]) > 0 and sign * (y[1] - z[1]) > 0 and abs(x[1] - z[1]) <= 0.05 * (x[1] + z[1]) / 2:
                        level = (left[1] + right[1]) / 2
                        if sign * (level - close) > 0:
                            out[symbol, now, long_name, (x[2], left[2], y[2], right[2], z[2])] = 2 * level - y[1]
            if len(tops) > 1 and len(dips) > 1:
                (a, b), (c, d) = tops[-2:], dips[-2:]
                at = lambda p, q: p[1] + (q[1] - p[1]) * (last - p[0]) / (q[0] - p[0])  # noqa: E731, B023
                up, low, key = at(a, b), at(c, d), (a[2], c[2], b[2], d[2])
                rise, climb = (b[1] - a[1]) / (b[0] - a[0]), (d[1] - c[1]) / (d[0] - c[0])
                flat = lambda p, q: abs(p[1] - q[1]) <= 0.02 * (p[1] + q[1]) / 2
                if flat(a, b) and climb > 0 and close > (a[1] + b[1]) / 2:
                    out[symbol, now, "ascending_triangle", key] = a[1] + b[1] - c[1]
                if flat(c, d) and rise < 0 and close < (c[1] + d[1]) / 2:
                    out[symbol, now, "descending_triangle", key] = c[1] + d[1] - a[1]
                if rise < 0 < climb and up > low and close > up:
                    out[symbol, now, "symmetric_triangle", key] = up + a[1] - c[1]
                if 0 < rise < climb and close < low:
                    out[symbol, now, "rising_wedge", key] = low - max(0.0, up - low)
                if rise < climb < 0 and close > up:
                    out[symbol, now, "falling_wedge", key] = up + max(0.0, up - low)
            if len(part) >= 30:
                pole, flag = part[-30:-18], part[-18:]
                top, base, low, high = max(r[4] for r in pole), min(r[5] for r in pole), min(r[5] for r in flag), max(r[4] for r in flag)
                if top / base - 1 >= 0.04 and top - low <= (top - base) / 2 and close > top:
                    out[symbol, now, "bull_flag", None] = 2 * top - base
                if 1 - base / top >= 0.04 and high - base <= (top - base) / 2 and close < base:
                    out[symbol, now, "bear_flag", None] = 2 * base - top
    return out


def test_chart_patterns(bars, rows):
    got = {(r["symbol"], r["t"], r["kind"], tuple(r["pivots"]) if r["pivots"] else None): r for r in charts.chart_patterns(bars).collect()}
    want = expected(rows)
    assert set(got) == set(want) and len({k[2] for k in want}) >= 9
    assert all(math.isclose(got[k]["target"], v, rel_tol=1e-9) and 0 <= got[k]["confidence"] <= 1 for k, v in want.items())
    assert charts.chart_patterns(bars.where("symbol = 'none'")).count() == 0


def emits(df):
    return [(r["symbol"], r["t"], r["direction"], round(r["strength"], 9)) for r in df.orderBy("symbol", "t").collect()]


def columns(bars, symbol, *wanted):
    """Values of indicators of one series, in order."""
    out = []
    for name, parameters, key in wanted:
        got = indicators.with_indicator(bars.where(f"symbol = '{symbol}'"), name, **parameters).orderBy("t").collect()
        out.append([r[key] for r in got])
    return list(zip(*out, strict=True))


def test_pullback_and_reversion(bars, rows):
    pull, revert = [], []
    for symbol, all_ in series(rows).items():
        x = columns(bars, symbol, ("sma", {"n": 50}, "value"), ("bbands", {}, "upper"), ("bbands", {}, "lower"), ("rsi", {}, "value"))
        near = inside = held = False
        count = 0
        for r, (m, up, low, rsi) in zip(all_, x, strict=True):
            t, c = r[2], r[6]
            if m is not None:
                if inside:
                    if c < m:
                        inside = near = False
                        pull.append((symbol, t, "exit", 1.0))
                elif c < m:
                    near = False
                elif (c - m) / m <= 0.02:
                    near = True
                elif near:
                    near, inside = False, True
                    pull.append((symbol, t, "long", 1.0))
            if up is None or rsi is None:
                continue
            if held:
                if c >= up or rsi > 70:
                    held, count = False, 0
                    revert.append((symbol, t, "exit", 1.0))
            elif c < low:
                count += 1
            else:
                if c > low and count >= 4:
                    held = True
                    revert.append((symbol, t, "long", round(min(1.0, max(0.0, (50 - rsi) / 50)), 9)))
                count = 0
    assert pull and emits(rules.signals(bars, "ma_pullback")) == pull
    assert revert and emits(rules.signals(bars, "mean_reversion")) == revert


def test_opening_range(bars, rows):
    want = []
    for symbol, all_ in series(rows).items():
        last, n, top, low = None, 0, 0.0, 0.0
        for _, _, t, _, h, lo, c, _ in all_:
            if last is None or t - last > HOUR:
                n, top, low = 0, -math.inf, math.inf
            last = t
            if n < 30:
                n, top, low = n + 1, max(top, h), min(low, lo)
            elif c > top:
                want.append((symbol, t, "long", round(min(1.0, (c - top) / top), 9)))
            elif c < low:
                want.append((symbol, t, "exit", 1.0))
    assert want and emits(rules.signals(bars, "orb_breakout")) == want


def test_trailing_and_swings(bars, rows):
    trail, swing = [], []
    for symbol, all_ in series(rows).items():
        x = columns(bars, symbol, ("ema", {"n": 20}, "value"), ("atr", {}, "atr"), ("ema", {"n": 50}, "value"))
        top = stop = high = low = hold = None
        for i, (r, (e, a, slow)) in enumerate(zip(all_, x, strict=True)):
            t, o, h, lo, c = r[2:7]
            if e is not None and a is not None:
                if top is None and c > e:
                    top, stop = c, c - 2 * a
                    trail.append((symbol, t, "long", 1.0))
                elif top is not None:
                    if c > top:
                        top, stop = c, c - 2 * a
                    if c < stop:
                        top = None
                        trail.append((symbol, t, "exit", 1.0))
            if slow is None or a is None:
                continue
            if i >= 10:
                part = all_[i - 10 : i + 1]
                rest = part[:5] + part[6:]
                high = part[5][4] if all(y[4] < part[5][4] for y in rest) else high
                low = part[5][5] if all(y[5] > part[5][5] for y in rest) else low
            if high is None or low is None:
                continue
            if hold is None:
                body = abs(c - o)
                pin = body > 0 and min(o, c) - lo > 2 * body and h - max(o, c) < body
                if c > high and c > slow:
                    hold = low
                    swing.append((symbol, t, "long", 1.0))
                elif pin and abs(c - low) < a / 2 and c > slow:
                    hold = lo - a / 2
                    swing.append((symbol, t, "long", 0.8))
            elif c < hold:
                hold = None
                swing.append((symbol, t, "exit", 1.0))
            else:
                hold = max(hold, low)
    assert trail and emits(rules.signals(bars, "atr_trailing")) == trail
    assert swing and emits(rules.signals(bars, "price_action_swing")) == swing


def test_latch_turns_over(spark):
    """A bar where entry and exit both hold leaves while in and enters while out."""
    from pyspark.sql import functions as F

    from barloom.functions.sheet import Sheet

    marks = "ebb.xbbeb"  # entry, both, exit
    df = spark.createDataFrame([("a", "H1", i, 1.0, 1.0, 1.0, 1.0, 1.0, m) for i, m in enumerate(marks)], SCHEMA + ", m string")
    s = Sheet(df)
    a, b = rules.latched(s, s.put(F.col("m").isin("e", "b")), s.put(F.col("m").isin("x", "b")))
    got = [(r["a"], r["b"]) for r in s.done(a=a, b=b).orderBy("t").collect()]
    held, want = False, []
    for m in marks:
        enter, leave = m in "eb" and not held, m in "xb" and held
        want.append((enter, leave))
        held = (held or enter) and not leave
    assert got == want


def test_two_frames(spark):
    quarter = walk("a", 1600, 5, "M15", QUARTER, 0.5)
    base = spark.createDataFrame(quarter, SCHEMA).cache()
    high = resample.resample(base, "H1").cache()
    r = columns(base, "a", ("rsi", {}, "value"), ("ema", {"n": 9}, "value"), ("ema", {"n": 21}, "value"), ("macd", {}, "histogram"))
    hours = [x["t"] for x in high.orderBy("t").collect()]
    h = columns(high, "a", ("ema", {"n": 20}, "value"), ("ema", {"n": 50}, "value"), ("adx", {}, "adx"), ("bbands", {}, "upper"), ("bbands", {}, "middle"))
    want = {k: [] for k in ("mtf_ema_rsi", "mtf_ma_cross", "mtf_adx_pullback", "mtf_bb_macd")}
    before = None
    for row, (rsi, fast, slow, hist) in zip(quarter, r, strict=True):
        t, c = row[2], row[6]
        seen = [x for at, x in zip(hours, h, strict=True) if at + HOUR <= t + QUARTER]
        known = lambda *ks: [x for x in seen if all(x[k] is not None for k in ks)]  # noqa: E731, B023

        def put(name, enter, leave):
            if enter or leave:
                want[name].append(("a", t, "long" if enter else "exit", 1.0))  # noqa: B023

        if len(e := known(0)) > 1:
            put("mtf_ema_rsi", e[-1][0] > e[-2][0] and (rsi or 0) < 40, e[-1][0] < e[-2][0] or (rsi or 0) > 70)
        if len(e := known(1)) > 1 and before and None not in (*before, fast, slow):
            put("mtf_ma_cross", c > e[-1][1] and before[0] <= before[1] and fast > slow, c < e[-1][1] or (before[0] >= before[1] and fast < slow))
        if len(e := known(1, 2)) > 1:
            put("mtf_adx_pullback", e[-1][2] > 25 and c > e[-1][1] and (rsi or 0) < 40, e[-1][2] < 20 or c < e[-1][1] or (rsi or 0) > 70)
        if len(e := known(3, 4)) > 1 and hist is not None:
            put("mtf_bb_macd", c > e[-1][3] and hist > 0 and (50 if rsi is None else rsi) < 55, c < e[-1][4] or hist < 0)
        before = (fast, slow)
    for name, rows_ in want.items():
        assert rows_ and emits(frames.two_frame_signals(base, high, name, "M15", "H1")) == rows_, name
    got = frames.two_frame_signals(base, high, "kitchen_sink", "M15", "H1").collect()
    assert got and all((r["target"] is not None) == (r["direction"] == "long") for r in got)
