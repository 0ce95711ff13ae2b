"""Indicators whose next value is not a linear function of the last: one sorted series per task, in grouped maps.

Each kernel is a generator of rows; the same kernels can run bar by bar in a stateful stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

EPS = 2.220446049250313e-16
Bar = tuple[float, float, float, float]  # o, h, l, c


def mcginley(bars: Iterator[Bar], n: int = 14) -> Iterator[tuple]:
    first: list[float] = []
    y = None
    for *_, c in bars:
        if y is None:
            first.append(c)
            y = sum(first) / n if len(first) == n else None
        elif abs(y) < EPS:
            y = c
        else:
            below = n * (c / y) ** 4
            y += (c - y) / below if below else 0.0  # a price of nothing would send y to infinity; it stays instead
        yield (y,)


def fisher(bars: Iterator[Bar], n: int = 9) -> Iterator[tuple]:
    mids: list[float] = []
    v = f = 0.0
    warm = False
    for _, h, low, _ in bars:
        mids = [*mids, (h + low) / 2][-n:]
        if len(mids) < n:
            yield None, None
            continue
        lo, hi = min(mids), max(mids)
        raw = 2 * ((mids[-1] - lo) / (hi - lo) - 0.5) if hi - lo >= EPS else 0.0
        v = min(0.999, max(-0.999, 0.33 * raw + 0.67 * v))
        before, f = f, 0.5 * math.log((1 + v) / (1 - v)) + 0.5 * f
        yield f, before if warm else 0.0
        warm = True


def kalman(bars: Iterator[Bar], q_pos: float = 0.001, q_vel: float = 0.001, r: float = 1.0) -> Iterator[tuple]:
    x = None
    v, a, b, d = 0.0, 1.0, 0.0, 1.0  # velocity; covariance [[a, b], [b, d]]
    for *_, z in bars:
        if x is None:
            x = z
        else:
            x += v
            a, b, d = a + 2 * b + d + q_pos, b + d, d + q_vel
            k0, k1, e = a / (a + r), b / (a + r), z - x
            x, v = x + k0 * e, v + k1 * e
            a, b, d = (1 - k0) * a, (1 - k0) * b, d - k1 * b
        yield x, v


def supertrend(bars: Iterator[Bar], n: int = 10, mult: float = 3.0) -> Iterator[tuple]:
    seeds: list[float] = []
    atr = before = up = down = None
    bull = True
    for _, h, low, c in bars:
        tr = h - low if before is None else max(h - low, abs(h - before), abs(low - before))
        if atr is None:
            seeds.append(tr)
            atr = sum(seeds) / n if len(seeds) == n else None
        else:
            atr += (tr - atr) / n
        if atr is None:
            before = c
            yield None, None, None
            continue
        mid = (h + low) / 2
        top, floor = mid + mult * atr, mid - mult * atr
        if up is None:
            bull = c > floor
        elif bull:
            bull = c >= down
            floor = max(floor, down) if bull else floor
        else:
            bull = c > up
            top = top if bull else min(top, up)
        up, down, before = top, floor, c
        yield (floor if bull else top), bull, not bull


def parabolic_sar(bars: Iterator[Bar], step: float = 0.02, most: float = 0.2) -> Iterator[tuple]:
    past: list[tuple[float, float]] = []
    sar = None
    ep, af, bull = 0.0, step, True
    for _, h, low, _ in bars:
        if not past:
            past = [(h, low)]
            yield None, None
            continue
        if sar is None:
            sar, ep = min(past[0][1], low), h
        else:
            sar += af * (ep - sar)
            sar = min(sar, *(x[1] for x in past)) if bull else max(sar, *(x[0] for x in past))
            if (low < sar) if bull else (h > sar):
                sar, bull, af = ep, not bull, step
                ep = h if bull else low
            elif (h > ep) if bull else (low < ep):
                ep, af = (h if bull else low), min(most, af + step)
        past = [*past, (h, low)][-2:]
        yield sar, bull


_OUTPUTS = {
    "mcginley": (mcginley, "value double"), "fisher": (fisher, "fisher double, signal double"), "kalman": (kalman, "value double, velocity double"),
    "supertrend": (supertrend, "value double, bullish boolean, bearish boolean"), "parabolic_sar": (parabolic_sar, "sar double, bullish boolean"),
}


def _kernel(kernel: Callable, outputs: str) -> Callable[..., DataFrame]:
    names = [x.split()[0] for x in outputs.split(", ")]

    def run(bars: DataFrame, **parameters) -> DataFrame:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t")
            rows = kernel(zip(pdf["o"], pdf["h"], pdf["l"], pdf["c"], strict=True), **parameters)
            return pdf.assign(**dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

        schema = ", ".join(f"{c} {k}" for c, k in bars.dtypes)
        return bars.groupBy("symbol", "tf").applyInPandas(one, f"{schema}, {outputs}")

    return run


KERNELS = {name: _kernel(*x) for name, x in _OUTPUTS.items()}
