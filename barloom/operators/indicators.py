"""Technical indicators over bars: ``with_indicator(bars, name, **parameters)`` adds the outputs of one indicator.

Bounded and cumulative frames and linear recurrences are columns (see ``Sheet``); the few non-linear
recurrences run per series in grouped maps (``operators.recurrences``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sheet import SPAN, Sheet, near_zero, sheet_for
from . import recurrences

INDICATORS: dict[str, Callable[..., DataFrame]] = {}
#: Those that are columns of a sheet: outputs by name.
COLUMNS: dict[str, Callable[..., dict[str, Column]]] = {}


def indicator(f: Callable) -> Callable:
    def run(bars: DataFrame, rows: int | None = SPAN, **parameters) -> DataFrame:
        s = sheet_for(bars, lambda dry: f(dry, **parameters), rows)
        return s.done(**f(s, **parameters))

    INDICATORS[f.__name__.rstrip("_")] = run
    COLUMNS[f.__name__.rstrip("_")] = f
    return f


def with_indicator(bars: DataFrame, name: str, **parameters) -> DataFrame:
    """``rows`` among the parameters is the size of a span of a series (see ``sheet_for``); None keeps series whole."""
    return INDICATORS[name](bars, **parameters)


def _ratio(a: Column, b: Column, flat: float = 0.0) -> Column:
    return F.when(near_zero(b), F.lit(flat)).otherwise(a / b)


def _true_range(s: Sheet, first: bool = True) -> Column:
    p = s.lag(s.c)
    tr = F.greatest(s.h - s.l, F.abs(s.h - p), F.abs(s.l - p))
    return s.put(F.when(p.isNull(), s.h - s.l if first else F.lit(None)).otherwise(tr))


def _atr(s: Sheet, n: int) -> Column:
    return s.smma(_true_range(s), n)


def _delta(s: Sheet, x: Column | None = None) -> Column:
    x = s.c if x is None else x
    return s.put(x - s.lag(x))


def _rsi(s: Sheet, x: Column, n: int) -> Column:
    d = _delta(s, x)
    up, down = s.put(F.greatest(d, F.lit(0.0))), s.put(F.greatest(-d, F.lit(0.0)))
    up = F.when(d.isNotNull(), up)
    down = F.when(d.isNotNull(), down)
    gain, loss = s.smooth((s.put(up), 1 / n, n), (s.put(down), 1 / n, n))
    return s.put(F.when(loss.isNull(), None).when(near_zero(loss), 100.0).otherwise(100 - 100 / (1 + gain / loss)))


def _percent(s: Sheet, n: int, flat: float = 50.0) -> Column:
    hh, ll = s.high(s.h, n), s.low(s.l, n)
    return s.put(F.when(hh.isNull(), None).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), _ratio((s.c - ll) * 100, hh - ll, flat)))))


def _roc(s: Sheet, n: int) -> Column:
    x = s.c
    p = s.lag(x, n)
    return s.put(F.when(p.isNull(), None).when(p == 0, 0.0).otherwise((x - p) / p * 100))


@indicator
def sma(s, n=20):
    return {"value": s.sma(s.c, n)}


@indicator
def ema(s, n=20):
    return {"value": s.ema(s.c, n)}


@indicator
def smma(s, n=20):
    return {"value": s.smma(s.c, n)}


@indicator
def wma(s, n=20):
    return {"value": s.wma(s.c, n)}


@indicator
def hma(s, n=20):
    n = max(4, n)
    raw = s.put(2 * s.wma(s.c, n // 2) - s.wma(s.c, n))
    return {"value": s.wma(raw, round(math.sqrt(n)))}


@indicator
def dema(s, n=20):
    a = s.ema(s.c, n)
    return {"value": 2 * a - s.ema(a, n)}


@indicator
def tema(s, n=20):
    a = s.ema(s.c, n)
    b = s.ema(a, n)
    return {"value": 3 * a - 3 * b + s.ema(b, n)}


@indicator
def alma(s, n=9, offset=0.85, sigma=6.0):
    m, spread = math.floor(offset * (n - 1)), n / sigma
    w = [math.exp(-((i - m) ** 2) / (2 * spread * spread)) for i in range(n)]
    return {"value": s.weighted(s.c, [x / sum(w) for x in w])}


@indicator
def lsma(s, n=25):
    mean = (n - 1) / 2
    below = sum((i - mean) ** 2 for i in range(n))
    slope = s.weighted(s.c, [(i - mean) / below for i in range(n)])
    return {"value": s.sma(s.c, n) + slope * mean, "slope": slope}


@indicator
def vwma(s, n=20):
    v = F.greatest(s.v, F.lit(0.0))
    pv, vv = s.total(s.c * v, n), s.total(v, n)
    return {"value": F.when(near_zero(vv), s.sma(s.c, n)).otherwise(pv / vv)}


@indicator
def kama(s, er=10, fast=2, slow=30):
    move = s.put(F.abs(s.c - s.lag(s.c, er)))
    path = s.total(s.put(F.abs(_delta(s))), er)
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), _ratio(move, path)))
    f, g = 2 / (fast + 1), 2 / (slow + 1)
    sc = s.put(F.when(path.isNull(), None).otherwise(F.pow(ratio * (f - g) + g, F.lit(2.0))))
    seen, start = s.seen(sc), s.sma(s.c, er + 1)
    q = s.put(F.when(seen < 2, 0.0).when(sc.isNull(), 1.0).otherwise(1 - sc))
    b = s.put(F.when(seen == 0, 0.0).when(seen == 1, sc * s.c + (1 - sc) * start).otherwise(F.coalesce(sc * s.c, F.lit(0.0))))
    return {"value": F.when(seen > 0, s.scan((q, b), most=1 - min(f, g) ** 2)[0])}


def _macd(s, x, fast, slow, signal):
    a, b = s.smooth((x, 2 / (fast + 1), fast), (x, 2 / (slow + 1), slow))
    line = s.put(a - b)
    sig = s.ema(line, signal)
    return F.when(sig.isNotNull(), line), sig, line - sig


@indicator
def macd(s, fast=12, slow=26, signal=9):
    return dict(zip(("macd", "signal", "histogram"), _macd(s, s.c, fast, slow, signal), strict=True))


@indicator
def trix(s, n=18, signal=9):
    e = s.ema(s.ema(s.ema(s.c, n), n), n)
    p = s.lag(e)
    line = s.put(F.when(p.isNull(), None).when(p == 0, 0.0).otherwise((e - p) / p * 100))
    sig = s.ema(line, signal)
    return {"trix": F.when(sig.isNotNull(), line), "signal": sig, "histogram": line - sig}


def _di(s, n):
    up, down = s.put(s.h - s.lag(s.h)), s.put(s.lag(s.l) - s.l)
    plus = s.put(F.when(up.isNull(), None).when((up > down) & (up > 0), up).otherwise(0.0))
    minus = s.put(F.when(up.isNull(), None).when((down > up) & (down > 0), down).otherwise(0.0))
    a, b, tr = s.smooth(*((x, 1 / n, n) for x in (plus, minus, _true_range(s, first=False))))
    return s.put(F.when(tr.isNotNull(), _ratio(100 * a, tr))), s.put(F.when(tr.isNotNull(), _ratio(100 * b, tr)))


@indicator
def dmi(s, n=14):
    return dict(zip(("plus_di", "minus_di"), _di(s, n), strict=True))


def _adx(s, n):
    p, m = _di(s, n)
    return s.smma(s.put(F.when(p.isNotNull(), _ratio(100 * F.abs(p - m), p + m))), n), p, m


@indicator
def adx(s, n=14):
    a, p, m = _adx(s, n)
    return {"adx": a, "plus_di": F.when(a.isNotNull(), p), "minus_di": F.when(a.isNotNull(), m)}


def _aroon(s, n):
    row, w = s.row(), s.rows(-n)
    since = lambda x: row - s.put(F.max(F.struct(x, row.alias("i"))).over(w))["i"]
    full = row > n
    return F.when(full, (n - since(s.h)) / n * 100), F.when(full, (n - since(-s.l)) / n * 100)


@indicator
def aroon(s, n=25):
    return dict(zip(("up", "down"), _aroon(s, n), strict=True))


@indicator
def aroon_osc(s, n=25):
    up, down = _aroon(s, n)
    return {"value": up - down}


@indicator
def vortex(s, n=14):
    tr = s.total(_true_range(s, first=False), n)
    a, b = s.total(s.put(F.abs(s.h - s.lag(s.l))), n), s.total(s.put(F.abs(s.l - s.lag(s.h))), n)
    return {"plus_vi": _ratio(a, tr), "minus_vi": _ratio(b, tr)}


@indicator
def kdj(s, n=9, k=3, d=3):
    kk = s.sma(_percent(s, n), k)
    dd = s.sma(kk, d)
    return {"k": F.when(dd.isNotNull(), kk), "d": dd, "j": 3 * kk - 2 * dd}


@indicator
def alligator(s, jaw=13, teeth=8, lips=5):
    mid = s.put((s.h + s.l) / 2)
    j, t, x = (s.lag(y, k) for y, k in zip(s.smooth(*((mid, 1 / n, n) for n in (jaw, teeth, lips))), (8, 5, 3), strict=True))
    return {"jaw": j, "teeth": t, "lips": x, "bullish": (x > t) & (t > j), "bearish": (x < t) & (t < j)}


@indicator
def gmma(s):
    short, long = (3, 5, 8, 10, 12, 15), (30, 35, 40, 45, 50, 60)
    all_ = s.smooth(*((s.c, 2 / (n + 1), n) for n in short + long))
    a, b = all_[:6], all_[6:]
    warm = b[-1].isNotNull()
    out = {"spread": F.when(warm, sum(a[1:], a[0]) / 6 - sum(b[1:], b[0]) / 6), "bullish": F.when(warm, F.least(*a) > F.greatest(*b)), "bearish": F.when(warm, F.greatest(*a) < F.least(*b))}
    return out | {f"short_{i}": x for i, x in enumerate(a)} | {f"long_{i}": x for i, x in enumerate(b)}


@indicator
def heiken_ashi(s, smooth=1):
    o, h, low, c = s.smooth(*((x, 2 / (smooth + 1), smooth) for x in (s.o, s.h, s.l, s.c))) if smooth > 1 else (s.o, s.h, s.l, s.c)
    close = s.put((o + h + low + c) / 4)
    seen, before = s.seen(close), s.lag(close)
    b = F.when(seen == 0, 0.0).when(seen == 1, (o + c) / 2).otherwise(before / 2)
    open_ = s.put(F.when(seen > 0, s.scan((F.when(seen < 2, 0.0).otherwise(0.5), b), most=0.5)[0]))
    return {"open": open_, "high": F.when(seen > 0, F.greatest(h, open_, close)), "low": F.when(seen > 0, F.least(low, open_, close)), "close": close, "is_bullish": close >= open_}


def candles(bars: DataFrame, kind: str = "raw", smooth: int = 1, rows: int | None = SPAN) -> DataFrame:
    """The bars as another candle type (``raw`` or ``heiken_ashi``, with ``smooth`` bars of smoothing), with the same columns, so any indicator
    or rule may stand on them. Bars before the smoothing is warm are left out; time, symbol and volume stay."""
    if kind == "raw":
        return bars
    if kind != "heiken_ashi":
        raise ValueError(f"unknown candle type {kind}")
    made = with_indicator(bars, "heiken_ashi", smooth=smooth, rows=rows).where("close IS NOT NULL")
    price = {"o": "open", "h": "high", "l": "low", "c": "close"}
    return made.select(*(F.col(price[c]).alias(c) if c in price else F.col(c) for c in bars.columns))


@indicator
def rsi(s, n=14):
    return {"value": _rsi(s, s.c, n)}


@indicator
def cci(s, n=20):
    tp = s.put((s.h + s.l + s.c) / 3)
    mean, values = s.sma(tp, n), s.items(tp, n)
    dev = s.put(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n)
    return {"value": F.when(mean.isNull(), None).when(dev == 0, 0.0).otherwise((tp - mean) / (0.015 * dev))}


@indicator
def roc(s, n=10):
    return {"value": _roc(s, n)}


@indicator
def mom(s, n=10):
    return {"value": s.c - s.lag(s.c, n)}


@indicator
def cmo(s, n=14):
    d = _delta(s)
    up, down = s.total(s.put(F.when(d > 0, d).when(d.isNotNull(), 0.0)), n), s.total(s.put(F.when(d < 0, -d).when(d.isNotNull(), 0.0)), n)
    return {"value": F.when(up.isNotNull(), _ratio((up - down) * 100, up + down))}


@indicator
def dpo(s, n=20):
    warm = s.row() >= n + n // 2 + 1
    return {"value": F.when(warm, s.lag(s.c, n // 2 + 1) - s.sma(s.c, n))}


@indicator
def mfi(s, n=14):
    tp = s.put((s.h + s.l + s.c) / 3)
    p = s.lag(tp)
    up, down = s.total(s.put(F.when(tp > p, tp * s.v).otherwise(0.0)), n), s.total(s.put(F.when(tp < p, tp * s.v).otherwise(0.0)), n)
    return {"value": F.when(up.isNull(), None).when(near_zero(down), 100.0).otherwise(100 - 100 / (1 + up / down))}


@indicator
def bop(s):
    return {"value": F.when(near_zero(s.h - s.l), None).otherwise((s.c - s.o) / (s.h - s.l))}


@indicator
def williams_r(s, n=14):
    hh, ll = s.high(s.h, n), s.low(s.l, n)
    return {"value": F.when(hh.isNotNull(), _ratio((hh - s.c) * -100, hh - ll, -50.0))}


@indicator
def stochastic(s, n=14, smooth_k=1, d=3):
    k = s.sma(_percent(s, n), smooth_k)
    dd = s.sma(k, d)
    return {"k": F.when(dd.isNotNull(), k), "d": dd}


@indicator
def stoch_rsi(s, n=14, k=3, d=3):
    r = _rsi(s, s.c, n)
    hh, ll = s.high(r, n), s.low(r, n)
    kk = s.sma(s.put(F.when(hh.isNotNull(), _ratio(r - ll, hh - ll))), k)
    dd = s.sma(kk, d)
    return {"k": F.when(dd.isNotNull(), kk), "d": dd}


@indicator
def tsi(s, long=25, short=13):
    d = _delta(s)
    a, b = s.smooth((d, 2 / (long + 1), long), (s.put(F.abs(d)), 2 / (long + 1), long))
    a, b = s.smooth((a, 2 / (short + 1), short), (b, 2 / (short + 1), short))
    return {"value": F.when(b.isNotNull(), _ratio(100 * a, b))}


def _rci(s, n):
    values = s.items(s.c, n)
    # Rank of each value, equal values in their order; d is rank minus position.
    ranks = F.transform(values, lambda x, i: F.size(F.filter(values, lambda y, j: (y < x) | ((y == x) & (j < i)))))
    square = F.aggregate(F.transform(ranks, lambda r, i: (r - i) * (r - i)), F.lit(0), lambda a, x: a + x)
    return s.put(F.when(values.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(-100.0), (1 - 6 * square / F.lit(n * (n * n - 1.0))) * 100))))


@indicator
def rci(s, n=9):
    return {"value": _rci(s, n)}


@indicator
def rci_ribbon(s, short=9, medium=26, long=52):
    a, b, c = (_rci(s, n) for n in (short, medium, long))
    return {"short": F.when(c.isNotNull(), a), "medium": F.when(c.isNotNull(), b), "long": c}


@indicator
def bull_bear(s, n=13):
    e = s.ema(s.c, n)
    return {"bull": s.h - e, "bear": s.l - e, "ema": e}


@indicator
def elder_ray(s, n=13):
    e = s.ema(s.c, n)
    return {"ema": e, "bull_power": s.h - e, "bear_power": s.l - e}


@indicator
def kst(s, periods=(10, 13, 14, 15), means=(10, 13, 14, 15), signal=9):
    parts = [(i + 1) * s.sma(_roc(s, p), m) for i, (p, m) in enumerate(zip(periods, means, strict=True))]
    line = s.put(sum(parts[1:], parts[0]))
    sig = s.sma(line, signal)
    return {"kst": F.when(sig.isNotNull(), line), "signal": sig, "histogram": line - sig}


@indicator
def pmo(s, first=35, second=20, signal=10):
    p = s.lag(s.c)
    change = s.put(F.when(p.isNull(), None).when(p == 0, 0.0).otherwise(1000 * (s.c / p - 1)))
    line = s.ema(s.put(s.ema(change, first)), second)
    sig = s.ema(line, signal)
    return {"pmo": F.when(sig.isNotNull(), line), "signal": sig, "histogram": line - sig}


@indicator
def ppo(s, fast=12, slow=26, signal=9):
    a, b = s.smooth((s.c, 2 / (fast + 1), fast), (s.c, 2 / (slow + 1), slow))
    line = s.put(F.when(b.isNotNull(), _ratio((a - b) * 100, b)))
    sig = s.ema(line, signal)
    return {"ppo": F.when(sig.isNotNull(), line), "signal": sig, "histogram": line - sig}


@indicator
def rvi(s, n=10):
    four = lambda x: s.put((x + 2 * s.lag(x, 1) + 2 * s.lag(x, 2) + s.lag(x, 3)) / 6)
    up, down = s.total(four(s.put(s.c - s.o)), n), s.total(four(s.put(s.h - s.l)), n)
    line = s.put(F.when(down.isNotNull(), _ratio(up, down)))
    sig = four(line)
    return {"rvi": F.when(sig.isNotNull(), line), "signal": sig}


@indicator
def smi(s, n=13, first=25, second=2, signal=9):
    hh, ll = s.high(s.h, n), s.low(s.l, n)
    a, b = s.smooth((s.put(s.c - (hh + ll) / 2), 2 / (first + 1), first), (s.put(hh - ll), 2 / (first + 1), first))
    a, b = s.smooth((a, 2 / (second + 1), second), (b, 2 / (second + 1), second))
    line = s.put(F.when(b.isNotNull(), _ratio(100 * a, b / 2)))
    sig = s.ema(line, signal)
    return {"smi": F.when(sig.isNotNull(), line), "signal": sig}


@indicator
def uo(s, a=7, b=14, c=28):
    p = s.put(F.coalesce(s.lag(s.c), s.c))
    bp, tr = s.put(s.c - F.least(s.l, p)), s.put(F.greatest(s.h, p) - F.least(s.l, p))
    x, y = [s.total(bp, n) for n in (a, b, c)], [s.total(tr, n) for n in (a, b, c)]
    flat = near_zero(y[0]) | near_zero(y[1]) | near_zero(y[2])
    return {"value": F.when(y[2].isNull(), None).when(flat, 50.0).otherwise(100 * (4 * x[0] / y[0] + 2 * x[1] / y[1] + x[2] / y[2]) / 7)}


@indicator
def connors_rsi(s, n=3, streak=2, rank=100):
    d = s.put(F.signum(F.coalesce(_delta(s), F.lit(0.0))))
    turned = s.put((d != s.put(F.coalesce(s.lag(d), F.lit(0.0)))).cast("int"))
    run = s.put(F.sum(turned).over(s.w))
    length = s.put(d * F.count(F.lit(1)).over(Window.partitionBy("symbol", "tf", run).orderBy("t")))
    change = _roc(s, 1)
    before = s.items(s.lag(change), rank)
    below = F.size(F.filter(before, lambda x: x < change)) / F.lit(float(rank)) * 100
    return {"value": F.when(before.isNotNull(), (_rsi(s, s.c, n) + _rsi(s, length, streak) + below) / 3)}


@indicator
def ao(s, fast=5, slow=34):
    mid = s.put((s.h + s.l) / 2)
    return {"value": s.sma(mid, fast) - s.sma(mid, slow)}


@indicator
def coppock(s, short=11, long=14, n=10):
    return {"value": s.wma(s.put(_roc(s, short) + _roc(s, long)), n)}


@indicator
def atr(s, n=14):
    tr = _true_range(s)
    return {"tr": tr, "atr": s.smma(tr, n)}


def _bands(s, n, k):
    mean, dev = s.sma(s.c, n), s.deviation(s.c, n)
    return mean + k * dev, mean, mean - k * dev


@indicator
def bbands(s, n=20, k=2.0):
    u, m, low = _bands(s, n, k)
    return {"upper": u, "middle": m, "lower": low, "bandwidth": F.when(m.isNotNull(), _ratio(u - low, m)), "percent_b": F.when(m.isNotNull(), _ratio(s.c - low, u - low, 0.5))}


@indicator
def keltner(s, n=20, atr=10, mult=2.0):
    e, a = s.smooth((s.c, 2 / (n + 1), n), (_true_range(s), 1 / atr, atr))
    return {"upper": e + mult * a, "middle": F.when(a.isNotNull(), e), "lower": e - mult * a}


@indicator
def donchian(s, n=20):
    hh, ll = s.high(s.h, n), s.low(s.l, n)
    return {"upper": hh, "middle": (hh + ll) / 2, "lower": ll}


@indicator
def chandelier_exit(s, n=22, mult=3.0):
    a = _atr(s, n)
    return {"long_stop": s.high(s.h, n) - mult * a, "short_stop": s.low(s.l, n) + mult * a, "atr": a}


@indicator
def chande_kroll(s, n=10, mult=1.5, q=9):
    a = _atr(s, n)
    return {"stop_long": s.high(s.put(s.high(s.h, n) - mult * a), q), "stop_short": s.low(s.put(s.low(s.l, n) + mult * a), q)}


def _chop(s, n):
    tr, hh, ll = s.total(_true_range(s), n), s.high(s.h, n), s.low(s.l, n)
    raw = 100 * F.log10(tr / (hh - ll)) / math.log10(n)
    return s.put(F.when(tr.isNull(), None).when(near_zero(hh - ll), 100.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw))))


@indicator
def chop(s, n=14):
    return {"value": _chop(s, n)}


@indicator
def chop_zone(s, n=34, threshold=5.0):
    e, tr = s.ema(s.c, n), _true_range(s)
    p = s.lag(e)
    angle = s.put(F.when(p.isNotNull(), F.when(near_zero(tr), 0.0).otherwise(F.degrees(F.atan((e - p) / tr)))))
    return {"angle": angle, "zone": F.when(angle > threshold, "up").when(angle < -threshold, "down").when(angle.isNotNull(), "choppy")}


@indicator
def volatility_ratio(s, n=14):
    return {"value": F.when((hh := s.high(s.h, n)).isNotNull(), _ratio(_true_range(s), hh - s.low(s.l, n)))}


@indicator
def regime(s, n=14, trend=25.0, range_=61.8, short=14, long=50, high=1.3, low=0.7):
    a, ch = _adx(s, n)[0], _chop(s, n)
    tr = _true_range(s)
    x, y = s.smooth((tr, 1 / short, short), (tr, 1 / long, long))
    ratio = F.coalesce(F.when(near_zero(y), 1.0).otherwise(x / y), F.lit(1.0))
    kind = F.when(a > trend, F.struct(a.alias("value"), F.lit("trending").alias("status"))).when(ch > range_, F.struct(ch.alias("value"), F.lit("ranging").alias("status")))
    vol = F.when(ratio > high, "high").when(ratio < low, "low").otherwise("normal")
    return {"trend": kind.otherwise(F.struct(a.alias("value"), F.lit("neutral").alias("status"))), "volatility": F.struct(ratio.alias("value"), vol.alias("status"))}


@indicator
def obv(s):
    d = _delta(s)
    return {"value": F.sum(F.when(d > 0, s.v).when(d < 0, -s.v).otherwise(0.0)).over(s.w)}


@indicator
def cmf(s, n=20):
    flow = F.when(near_zero(s.h - s.l), 0.0).otherwise(((s.c - s.l) - (s.h - s.c)) / (s.h - s.l) * s.v)
    a, b = s.total(s.put(flow), n), s.total(s.v, n)
    return {"value": F.when(near_zero(b), None).otherwise(a / b)}


def _session(s, gap_minutes):
    return s.put(F.sum((F.col("t") - s.lag(F.col("t")) > gap_minutes * 60_000).cast("int")).over(s.w))


@indicator
def vwap(s, session_gap_mins=390):
    session = s.put(F.coalesce(_session(s, session_gap_mins), F.lit(0)))
    w = Window.partitionBy("symbol", "tf", session).orderBy("t")
    pv, vv = s.put(F.sum((s.h + s.l + s.c) / 3 * s.v).over(w)), s.put(F.sum(s.v).over(w))
    return {"value": F.when(vv == 0, s.c).otherwise(pv / vv)}


@indicator
def ichimoku(s, tenkan=9, kijun=26, senkou=52):
    mid = lambda n: s.put((s.high(s.h, n) + s.low(s.l, n)) / 2)
    t, k, b = mid(tenkan), mid(kijun), mid(senkou)
    a = s.put((t + k) / 2)
    ca, cb, past = s.lag(a, kijun), s.lag(b, kijun), s.lag(s.c, kijun)
    return {
        "tenkan": t, "kijun": k, "senkou_a": a, "senkou_b": b, "chikou": s.c, "above_cloud": s.c > F.greatest(ca, cb), "below_cloud": s.c < F.least(ca, cb),
        "chikou_above": s.c > past, "chikou_below": s.c < past,
    }


@indicator
def rwi(s, n=14):
    tr = _true_range(s)
    up, down = [], []
    for k in range(2, n + 1):
        a = s.sma(tr, k) * math.sqrt(k)
        up.append(_ratio(s.h - s.lag(s.l, k), a))
        down.append(_ratio(s.lag(s.h, k) - s.l, a))
    full = s.lag(s.l, n).isNotNull()
    return {"rwi_high": F.when(full, F.greatest(F.lit(0.0), *up)), "rwi_low": F.when(full, F.greatest(F.lit(0.0), *down))}


@indicator
def fractal(s):
    hs, ls = [s.h] + [s.lag(s.h, k) for k in range(1, 5)], [s.l] + [s.lag(s.l, k) for k in range(1, 5)]
    top = (hs[2] > hs[0]) & (hs[2] > hs[1]) & (hs[2] > hs[3]) & (hs[2] > hs[4])
    bottom = (ls[2] < ls[0]) & (ls[2] < ls[1]) & (ls[2] < ls[3]) & (ls[2] < ls[4])
    return {"bullish": bottom, "bearish": top, "fractal_high": F.when(top, hs[2]), "fractal_low": F.when(bottom, ls[2])}


@indicator
def rolling_max(s, n=20):
    return {"value": s.high(s.c, n)}


@indicator
def rolling_min(s, n=20):
    return {"value": s.low(s.c, n)}


for _name, _run in recurrences.KERNELS.items():
    INDICATORS[_name] = _run
