"""Signal rules over bars: ``signals(bars, rule)`` gives symbol, tf, t, rule, direction, strength.

A rule is an entry and an exit condition over indicator columns. Entry is tested first and one signal leaves
per bar. Latched rules enter only while out and leave only while in. Rules whose exit depends on what they saw since
their entry fold over each series (``FOLDED``). Conditions are null, and so false, until all inputs are warm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sheet import SPAN, Sheet, sheet_for
from . import charts
from . import indicators as I

Rule = Callable[[Sheet], tuple]
RULES: dict[str, Rule] = {}
#: Rules as folds: the columns of a bar that they need, and the fold that yields a direction and a strength, or nothing.
FOLDED: dict[str, tuple[Callable[[Sheet], list[Column]], Callable[[Iterator], Iterator]]] = {}
#: Rules over an indicator with a non-linear recurrence: it is added to the bars first.
PREPARED = {
    "supertrend": ("supertrend", {}), "supertrend_macd": ("supertrend", {}), "parabolic_sar": ("parabolic_sar", {}), "fisher_crossover": ("fisher", {"n": 10}),
}
LATCHED = {"trend_follower", "macd_ma", "kdj", "bb_keltner_squeeze", "vwap_trend", "obv_ema_trend", "oscillator_overlord", "bb_squeeze", "chandelier_exit", "ma_pullback", "mean_reversion"}


def rule(f: Rule) -> Rule:
    RULES[f.__name__] = f
    return f


def crossed_up(s: Sheet, a: Column, b: Column) -> Column:
    a, b = s.put(a), s.put(b)
    return s.put((s.lag(a) <= s.lag(b)) & (a > b))


def crossed_down(s: Sheet, a: Column, b: Column) -> Column:
    a, b = s.put(a), s.put(b)
    return s.put((s.lag(a) >= s.lag(b)) & (a < b))


def turned(s: Sheet, flag: Column) -> tuple[Column, Column]:
    """On and off edges of a condition."""
    flag = s.put(flag)
    before = s.lag(flag)
    return flag & ~before, ~flag & before


def latched(s: Sheet, entry: Column, leave: Column) -> tuple[Column, Column]:
    """Entries while out and exits while in. A bar where both conditions hold turns the state over, so the state is
    the last bar where one alone held, turned over once for each bar since where both did."""
    past = s.w.rowsBetween(Window.unboundedPreceding, -1)
    turns = s.put(F.sum((entry & leave).cast("int")).over(s.w.rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.struct(entry.cast("int").alias("state"), turns.alias("turns"))
    base = s.put(F.last(F.when(entry != leave, alone), ignorenulls=True).over(past))
    held = s.put((F.coalesce(base["state"], F.lit(0)) + F.coalesce(s.lag(turns), F.lit(0)) - F.coalesce(base["turns"], F.lit(0))) % 2)
    return entry & (held == 0), leave & (held == 1)


def emitted(s: Sheet, name: str, entry: Column, leave: Column, strength: Column | None = None, **more: Column) -> DataFrame:
    """One signal a bar, entries first; ``more`` are columns of entries."""
    entry, leave = s.put(F.coalesce(entry, F.lit(False))), s.put(F.coalesce(leave, F.lit(False)))
    if name in LATCHED:
        entry, leave = latched(s, entry, leave)
    power = F.lit(1.0) if strength is None else F.least(F.lit(1.0), F.greatest(F.lit(0.0), strength))
    side = F.when(entry, "long").when(leave, "exit").alias("direction")
    extra = (F.when(entry, x).alias(k) for k, x in more.items())
    return s.kept().select("symbol", "tf", "t", F.lit(name).alias("rule"), side, F.when(entry, power).otherwise(1.0).alias("strength"), *extra).where("direction IS NOT NULL")


def signals(bars: DataFrame, name: str, rows: int | None = SPAN) -> DataFrame:
    """Rules that read only so many rows back work in spans of ``rows`` rows of a series; latched ones look at all of it."""
    if name in FOLDED:
        return _folded(bars, name)
    kernel, parameters = PREPARED.get(name, (None, {}))
    s = sheet_for(I.with_indicator(bars, kernel, **parameters) if kernel else bars, RULES[name], None if name in LATCHED else rows)
    return emitted(s, name, *RULES[name](s))


def cross_rule(name: str, pair: Callable[[Sheet], tuple[Column, Column]], *, up: Callable | None = None) -> None:
    def run(s: Sheet) -> tuple:
        a, b = pair(s)
        entry = crossed_up(s, a, b)
        return (entry & up(s) if up else entry), crossed_down(s, a, b)

    RULES[name] = run


def _emas(s: Sheet, *ns: int) -> list[Column]:
    return s.smooth(*((s.c, 2 / (n + 1), n) for n in ns))


def _out(s: Sheet, name: str, *keys: str, **parameters) -> list[Column]:
    """Outputs of an indicator as columns of the sheet."""
    got = getattr(I, name)(s, **parameters)
    return [s.put(got[k]) for k in keys]


def _zero() -> Column:
    return F.lit(0.0)


cross_rule("ma_crossover", lambda s: _emas(s, 20, 50))
cross_rule("hma_crossover", lambda s: (_out(s, "hma", "value", n=16)[0], _out(s, "hma", "value", n=49)[0]))
cross_rule("dema_crossover", lambda s: (_out(s, "dema", "value", n=12)[0], _out(s, "dema", "value", n=26)[0]))
cross_rule("tema_crossover", lambda s: (_out(s, "tema", "value", n=8)[0], _out(s, "tema", "value", n=21)[0]))
cross_rule("alma_cross", lambda s: (_out(s, "alma", "value", n=9)[0], _out(s, "alma", "value", n=21)[0]))
cross_rule("lsma_cross", lambda s: (_out(s, "lsma", "value", n=20)[0], _out(s, "lsma", "value", n=50)[0]))
cross_rule("adx_ema_cross", lambda s: _emas(s, 20, 50), up=lambda s: _out(s, "adx", "adx")[0] > 25)
cross_rule("trend_transition", lambda s: _emas(s, 50, 200), up=lambda s: _out(s, "adx", "adx")[0] > 25)
cross_rule("vortex_trend", lambda s: _out(s, "vortex", "plus_vi", "minus_vi"))
cross_rule("ichimoku_cross", lambda s: _out(s, "ichimoku", "tenkan", "kijun"), up=lambda s: _out(s, "ichimoku", "above_cloud")[0])
cross_rule("macd_crossover", lambda s: (_out(s, "macd", "histogram")[0], _zero()))
cross_rule("ppo_histogram", lambda s: (_out(s, "ppo", "histogram")[0], _zero()))
cross_rule("trix", lambda s: (_out(s, "trix", "histogram")[0], _zero()))
cross_rule("roc", lambda s: (_out(s, "roc", "value")[0], _zero()))
cross_rule("ao", lambda s: (_out(s, "ao", "value")[0], _zero()))
cross_rule("stochastic_dk", lambda s: _out(s, "stochastic", "k", "d"))


@rule
def triple_ema(s):
    a, b, c = _emas(s, 10, 20, 50)
    return turned(s, (a > b) & (b > c))


@rule
def kama(s):
    (k,) = _out(s, "kama", "value")
    return crossed_up(s, s.c, k), crossed_down(s, s.c, k), (s.c - k) / k


@rule
def dmi_adx(s):
    a, p, m = _out(s, "adx", "adx", "plus_di", "minus_di")
    return crossed_up(s, p, m) & (a > 25), crossed_down(s, p, m), a / 100


@rule
def aroon_trend(s):
    up, down = _out(s, "aroon", "up", "down")
    return (up > 70) & (down < 30), up < down, (up - down) / 200 + 0.5


@rule
def gmma_crossover(s):
    return turned(s, _out(s, "gmma", "bullish")[0])


@rule
def ichimoku_cloud(s):
    return tuple(_out(s, "ichimoku", "above_cloud", "below_cloud"))


@rule
def scalping_ema(s):
    a, b = _emas(s, 8, 21)
    (atr,) = _out(s, "atr", "atr")
    return crossed_up(s, a, b) & (atr > s.ema(atr, 20)), crossed_down(s, a, b), (a - b) / b


@rule
def trend_follower(s):
    a, b = s.sma(s.c, 50), s.sma(s.c, 200)
    (h,) = _out(s, "macd", "histogram")
    return (a > b) & (h > 0), (a < b) | (h < 0)


@rule
def rsi_mean_rev(s):
    (r,) = _out(s, "rsi", "value")
    return r < 30, r > 70, (30 - r) / 30


@rule
def rsi_ma_cross(s):
    a, b = _emas(s, 20, 50)
    (r,) = _out(s, "rsi", "value")
    return crossed_up(s, a, b) & (r > 50), crossed_down(s, a, b) | (r < 45)


@rule
def macd_ma(s):
    (h,) = _out(s, "macd", "histogram")
    return (h > 0) & (s.c > s.sma(s.c, 50)), h < 0


@rule
def momentum_roc(s):
    (r,), (e,) = _out(s, "roc", "value"), _emas(s, 50)
    return (r > 2) & (s.c > e), (r < 0) | (s.c < e), r / 6


@rule
def dual_momentum(s):
    (a,), (b,) = _out(s, "roc", "value"), _out(s, "roc", "value", n=30)
    return (a > 0) & (b > 0), (a < 0) | (b < 0)


@rule
def stochastic_crossover(s):
    k, d = _out(s, "stochastic", "k", "d")
    return crossed_up(s, k, d) & (d < 20), crossed_down(s, k, d) & (d > 80), k / 100


@rule
def stoch_rsi(s):
    (k,) = _out(s, "stoch_rsi", "k")
    return crossed_down(s, k, F.lit(0.2)), crossed_up(s, k, F.lit(0.8)), (0.2 - k) / 0.2


@rule
def cci_reversal(s):
    (x,) = _out(s, "cci", "value")
    return crossed_up(s, x, F.lit(-100.0)), crossed_up(s, x, F.lit(100.0))


@rule
def cmo_zero_cross(s):
    (x,), (e,) = _out(s, "cmo", "value"), _emas(s, 50)
    return crossed_up(s, x, _zero()) & (s.c > e), crossed_down(s, x, _zero()) | (s.c < e)


@rule
def connors_rsi(s):
    (x,) = _out(s, "connors_rsi", "value")
    return x < 10, x > 70, (10 - x) / 10


@rule
def kdj(s):
    k, d, j = _out(s, "kdj", "k", "d", "j")
    return (k < 20) & (d < 20) & (k > s.lag(k)), (k > 80) | (j > 100)


@rule
def tsi(s):
    (x,) = _out(s, "tsi", "value")
    return crossed_up(s, x, F.lit(-25.0)), crossed_down(s, x, F.lit(25.0)), (x + 25) / 125


@rule
def smi_reversal(s):
    x, y = _out(s, "smi", "smi", "signal")
    return crossed_up(s, x, y) & (s.lag(x) < -40), (x > 40) | crossed_down(s, x, y)


@rule
def uo_reversal(s):
    (x,) = _out(s, "uo", "value")
    return crossed_up(s, x, F.lit(30.0)), x > 70


@rule
def williams_r_ma(s):
    (x,), (e,) = _out(s, "williams_r", "value"), _emas(s, 50)
    return crossed_up(s, x, F.lit(-80.0)) & (s.c > e), crossed_down(s, x, F.lit(-20.0))


@rule
def bb_squeeze(s):
    up, mid, width = _out(s, "bbands", "upper", "middle", "bandwidth")
    out = s.c < mid
    seen = s.put(F.last(F.when(out, 0).when(width < 0.04, 1), ignorenulls=True).over(s.w.rowsBetween(Window.unboundedPreceding, -1)))
    return (seen == 1) & (s.c > up), out


@rule
def bb_keltner_squeeze(s):
    up, mid, low = _out(s, "bbands", "upper", "middle", "lower")
    ku, kl = _out(s, "keltner", "upper", "lower", mult=1.5)
    inside = s.put((up < ku) & (low > kl))
    return s.lag(inside) & ~inside & (s.c > mid), s.c < mid


@rule
def bb_rsi_reversal(s):
    mid, low = _out(s, "bbands", "middle", "lower")
    (r,) = _out(s, "rsi", "value")
    return (s.c < low) & (r < 35), (s.c > mid) | (r > 65)


@rule
def bollinger_macd(s):
    up, mid = _out(s, "bbands", "upper", "middle")
    (h,) = _out(s, "macd", "histogram")
    return (s.c > up) & (h > 0), (s.c < mid) | (h < 0)


@rule
def donchian_breakout(s):
    return s.c > s.lag(s.high(s.h, 20)), s.c < s.lag(s.low(s.l, 10))


@rule
def highest_breakout(s):
    top, bottom = s.lag(s.high(s.c, 20)), s.lag(s.low(s.c, 20))
    return s.c > top, s.c < bottom


@rule
def keltner_breakout(s):
    up, low = _out(s, "keltner", "upper", "lower")
    return s.c > up, s.c < low


@rule
def chandelier_exit(s):
    (stop,) = _out(s, "chandelier_exit", "long_stop")
    return turned(s, s.c > stop)


@rule
def range_rover(s):
    (k,) = _out(s, "stochastic", "k")
    return (k < 20) & (s.c > s.sma(s.c, 50)), k > 80


@rule
def volatility_squeezer(s):
    (a,) = _out(s, "atr", "atr")
    m = s.sma(s.c, 50)
    return (a > s.lag(a)) & (s.c > m), s.c < m


@rule
def volatility_vanguard(s):
    up, mid = _out(s, "bbands", "upper", "middle")
    (a,) = _out(s, "atr", "atr")
    return (s.c > up) & (a > s.lag(a)), s.c < mid


@rule
def volatility_ratio(s):
    (x,) = _out(s, "volatility_ratio", "value", n=10)
    return (x > 0.5) & (s.c > s.lag(s.c)), x <= 0.5, x


@rule
def mfi_revert(s):
    (x,) = _out(s, "mfi", "value")
    return crossed_up(s, x, F.lit(20.0)), crossed_up(s, x, F.lit(80.0))


@rule
def mfi_trend(s):
    (x,) = _out(s, "mfi", "value")
    return crossed_up(s, x, F.lit(50.0)), x < 40


@rule
def vwap_bounce(s):
    (w,), (r,) = _out(s, "vwap", "value", session_gap_mins=60), _out(s, "rsi", "value")
    return crossed_up(s, s.c, w) & (r < 50), crossed_down(s, s.c, w) | (r > 65), F.lit(0.8)


@rule
def vwap_trend(s):
    (w,) = _out(s, "vwap", "value", session_gap_mins=60)
    return (s.c > w) & (w > s.lag(w)), s.c <= w


@rule
def vwma_rsi(s):
    (w,), (r,) = _out(s, "vwma", "value"), _out(s, "rsi", "value")
    return (s.c > w) & (r > 50), r < 45


@rule
def cmf_ema_trend(s):
    (x,), (e,) = _out(s, "cmf", "value"), _emas(s, 50)
    return (x > 0.1) & (s.c > e), x < -0.1


@rule
def obv_ema_trend(s):
    (x,), (e,) = _out(s, "obv", "value"), _emas(s, 50)
    m = s.ema(x, 20)
    return (x > m) & (s.c > e), (x <= m) | (s.c <= e)


@rule
def heiken_ashi_color(s):
    return turned(s, _out(s, "heiken_ashi", "is_bullish")[0])


@rule
def heiken_ashi_breakout(s):
    (b,) = _out(s, "heiken_ashi", "is_bullish")
    return b & s.lag(b), ~b & ~s.lag(b)


@rule
def heiken_ashi_harmonizer(s):
    (b,), (e,) = _out(s, "heiken_ashi", "is_bullish"), _emas(s, 50)
    return b & (s.c > e), ~b | (s.c < e)


@rule
def alligator(s):
    return turned(s, _out(s, "alligator", "bullish")[0])


@rule
def elder_ray(s):
    e, bull, bear = _out(s, "elder_ray", "ema", "bull_power", "bear_power")
    return (e > s.lag(e)) & (bear < 0) & (bear > s.lag(bear)), crossed_down(s, bull, _zero())


@rule
def rwi(s):
    hi, low = _out(s, "rwi", "rwi_high", "rwi_low")
    return hi > 1, low > 1, hi - 1


@rule
def chop_filter(s):
    a, b = _emas(s, 8, 21)
    (x,) = _out(s, "chop", "value")
    return crossed_up(s, a, b) & (x < 61.8), crossed_down(s, a, b), F.abs(a - b) / b


@rule
def equilibrium_explorer(s):
    (e,), (k,), (h,) = _emas(s, 200), _out(s, "stochastic", "k"), _out(s, "macd", "histogram")
    return (s.c > e) & (k < 20) & (h > 0), (k > 80) | (h < 0)


@rule
def oscillator_overlord(s):
    (r,), (k,), (x,) = _out(s, "rsi", "value"), _out(s, "stochastic", "k"), _out(s, "cci", "value")
    count = lambda *tests: sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    return count(r < 30, k < 20, x < -100) >= 2, count(r > 70, k > 80, x > 100) >= 2


@rule
def pixel_3(s):
    mids = [s.put((s.high(s.h, n) + s.low(s.l, n)) / 2) for n in (5, 20, 60)]
    n = s.put(sum(((s.c > m).cast("int") for m in mids[1:]), (s.c > mids[0]).cast("int")))
    return n >= 2, n == 0, n / 3


@rule
def reversal_catcher(s):
    k, d = _out(s, "stochastic", "k", "d")
    (r,) = _out(s, "rsi", "value")
    return crossed_up(s, k, d) & (r < 50), crossed_down(s, k, d) | (r > 70)


@rule
def swing_trader(s):
    (x,), (a,) = _out(s, "cci", "value"), _out(s, "adx", "adx")
    return crossed_up(s, x, F.lit(100.0)) & (a > 25), crossed_down(s, x, F.lit(-100.0))


@rule
def wolfstein(s):
    a, p, m = _out(s, "adx", "adx", "plus_di", "minus_di")
    return (a > 27.5) & (p > m), a < 20.5, a / 100


@rule
def supertrend(s):
    return turned(s, F.col("bullish"))


@rule
def supertrend_macd(s):
    (h,) = _out(s, "macd", "histogram")
    return F.col("bullish") & (h > 0), F.col("bearish")


@rule
def parabolic_sar(s):
    return turned(s, F.col("bullish"))


@rule
def fisher_crossover(s):
    a, b = F.col("fisher"), F.col("signal")
    return crossed_up(s, a, b), crossed_down(s, a, b)


@rule
def ma_pullback(s):
    m = s.sma(s.c, 50)
    away = s.put((s.c - m) / m)
    close_by = s.put((away >= 0) & (away <= 0.02))
    return s.lag(close_by) & (away > 0.02), s.c < m


@rule
def mean_reversion(s):
    """Four closes in a row below the lower band while out, then one above it. A bar that leaves starts the row anew."""
    up, low = _out(s, "bbands", "upper", "lower")
    (r,) = _out(s, "rsi", "value")
    leave = s.put((s.c >= up) | (r > 70))
    below = s.put(((s.c < low) & r.isNotNull() & ~leave).cast("int"))
    before = F.min(below).over(s.w.rowsBetween(-4, -1))
    return (s.put(before) == 1) & s.lag(below, 4).isNotNull() & (s.c > low), leave, (50 - r) / 50


@rule
def orb_breakout(s, bars=30, gap=60):
    """Breakouts of the range of a session's first bars; a session ends where bars are further apart than the gap."""
    session = s.put(F.coalesce(I._session(s, gap), F.lit(0)))
    w = Window.partitionBy("symbol", "tf", session).orderBy("t")
    place = s.put(F.row_number().over(w))
    opening = lambda f, x: s.put(f(F.when(place <= bars, x)).over(w))
    top, bottom = opening(F.max, s.h), opening(F.min, s.l)
    ready = place > bars
    return ready & (s.c > top), ready & (s.c < bottom), (s.c - top) / top


@rule
def waddah_attar(s):
    line, _ = _out(s, "macd", "macd", "signal", fast=20, slow=40, signal=9)
    up, low = _out(s, "bbands", "upper", "lower")
    (a,) = _out(s, "atr", "atr", n=100)
    line = s.put(F.when(a.isNotNull() & up.isNotNull(), line))
    push = s.put((line - s.lag(line)) * 150)
    sure = s.put((F.abs(push) > up - low) & (F.abs(push) > a * 3.7) & (push > 0))
    return sure, ~sure


@rule
def pattern_breakout(s):
    kinds = (
        "double_bottom", "double_top", "inverse_head_and_shoulders", "head_and_shoulders", "ascending_triangle", "descending_triangle", "symmetric_triangle", "bull_flag", "falling_wedge",
    )
    best = charts.best_pattern(s, kinds)
    warm = s.put(s.row() >= 20)
    return warm & best["kind"].isin(*charts.BULLISH), warm & best["kind"].isin(*charts.BEARISH), best["confidence"]


def _folded(bars: DataFrame, name: str) -> DataFrame:
    inputs, fold = FOLDED[name]
    s = Sheet(bars)
    columns = [x.alias(f"x{i}") for i, x in enumerate(inputs(s))]
    rows = s.df.select("symbol", "tf", "t", *columns)
    names = [f"x{i}" for i in range(len(columns))]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        seen = list(fold(zip(*(pdf[x] for x in names), strict=True)))
        out = pdf[["symbol", "tf", "t"]].assign(rule=name, direction=[x[0] if x else None for x in seen], strength=[x[1] if x else 1.0 for x in seen])
        return out[out["direction"].notna()]

    return rows.groupBy("symbol", "tf").applyInPandas(one, "symbol string, tf string, t long, rule string, direction string, strength double")


def _trailing(bars: Iterator[tuple]) -> Iterator[tuple | None]:
    top = stop = None
    for c, average, width in bars:
        signal = None
        if average == average and width == width:  # both known
            if top is None:
                if c > average:
                    top, stop, signal = c, c - width, ("long", 1.0)
            else:
                if c > top:
                    top, stop = c, c - width
                if c < stop:
                    top, signal = None, ("exit", 1.0)
        yield signal


def _swings(bars: Iterator[tuple]) -> Iterator[tuple | None]:
    stop = None
    for c, breaks, bounces, floor, tight in bars:
        signal = None
        if floor == floor:
            if stop is None:
                if breaks:
                    stop, signal = floor, ("long", 1.0)
                elif bounces:
                    stop, signal = tight, ("long", 0.8)
            elif c < stop:
                stop, signal = None, ("exit", 1.0)
            else:
                stop = max(stop, floor)
        yield signal


def _trailing_inputs(s: Sheet) -> list[Column]:
    return [s.c, _emas(s, 20)[0], s.put(_out(s, "atr", "atr")[0] * 2)]


def _swing_inputs(s: Sheet, n: int = 5) -> list[Column]:
    """Close, breakout above the last swing high, pin bar near the last swing low, that low, and the pin bar's own stop."""
    (e,), (a,) = _emas(s, 50), _out(s, "atr", "atr")
    warm = e.isNotNull() & a.isNotNull()
    around = lambda f, x: [f(x).over(s.w.rowsBetween(*r)) for r in ((-2 * n, -n - 1), (1 - n, 0))]
    full = F.count(F.lit(1)).over(s.w.rowsBetween(-2 * n, 0)) == 2 * n + 1
    mid_h, mid_l = s.lag(s.h, n), s.lag(s.l, n)
    peak = s.put(warm & full & (mid_h > F.greatest(*around(F.max, "h"))))
    dip = s.put(warm & full & (mid_l < F.least(*around(F.min, "l"))))
    top, floor = (s.put(F.last(F.when(flag, x), ignorenulls=True).over(s.w)) for flag, x in ((peak, mid_h), (dip, mid_l)))
    body, lower, upper = F.abs(s.c - s.o), F.least(s.o, s.c) - s.l, s.h - F.greatest(s.o, s.c)
    pin = (body > 0) & (lower > body * 2) & (upper < body) & (F.abs(s.c - floor) < a * 0.5)
    known, yes = top.isNotNull() & floor.isNotNull(), lambda x: s.put(F.coalesce(x & (s.c > e), F.lit(False)))
    return [s.c, yes(s.c > top), yes(pin), s.put(F.when(known, floor)), s.put(s.l - a * 0.5)]


FOLDED |= {"atr_trailing": (_trailing_inputs, _trailing), "price_action_swing": (_swing_inputs, _swings)}


def trades_of(bars: DataFrame, marks: DataFrame) -> DataFrame:
    """Trades of rules' signals: a long while out enters, an exit while in leaves, the last bar closes; return on close.

    Only signals meet their bars; a signal that repeats the one before changes nothing."""
    closes = bars.select("symbol", "tf", "t", "c")
    w = Window.partitionBy("rule", "symbol", "tf").orderBy("t")
    x = marks.select("rule", "symbol", "tf", "t", "direction").join(closes, ["symbol", "tf", "t"])
    x = x.withColumn("was", F.coalesce(F.lag("direction").over(w), F.lit("exit"))).where("direction <> was")
    x = x.withColumns({"exit_t": F.lead("t").over(w), "exit_price": F.lead("c").over(w)}).where("direction = 'long'")
    last = closes.groupBy("symbol", "tf").agg(F.max("t").alias("last_t"), F.max_by("c", "t").alias("last_c"))
    x = x.join(last, ["symbol", "tf"])
    out = x.select("rule", "symbol", "tf", F.col("t").alias("entry_t"), F.col("c").alias("entry_price"), F.coalesce("exit_t", "last_t").alias("exit_t"), F.coalesce("exit_price", "last_c").alias("exit_price"))
    return out.withColumn("ret", F.col("exit_price") / F.col("entry_price") - 1)


def paired(bars: DataFrame, name: str) -> DataFrame:
    return trades_of(bars, signals(bars, name))


def every_signal(bars: DataFrame, names: tuple[str, ...], rows: int | None = SPAN) -> DataFrame:
    """symbol, tf, t, c, rule, direction of several rules' signals: rules that read only so many rows back fill one sheet in spans,
    the others one over whole series, so bars are read, dealt and sorted as often for all of them as for one."""
    near, whole, apart = [], [], []
    for n in names:
        if n in FOLDED or n in PREPARED:
            apart.append(n)
            continue
        dry = Sheet(None)
        RULES[n](dry)
        (whole if dry.whole or n in LATCHED or not rows else near).append(n)
    out = []
    for some, span in ((near, rows), (whole, None)):
        if some:
            s = sheet_for(bars, lambda dry, some=some: [RULES[n](dry) for n in some], span)
            marks = []
            for n in some:
                entry, leave = (s.put(F.coalesce(x, F.lit(False))) for x in RULES[n](s)[:2])
                entry, leave = latched(s, entry, leave) if n in LATCHED else (entry, leave)
                marks.append(F.when(entry | leave, F.struct(F.lit(n).alias("rule"), F.when(entry, "long").otherwise("exit").alias("direction"))))
            found = F.explode(F.array_compact(F.array(*(s.put(m) for m in marks))))
            out.append(s.kept().select("symbol", "tf", "t", "c", found.alias("x")).select("symbol", "tf", "t", "c", "x.*"))
    closes = bars.select("symbol", "tf", "t", "c")
    out += [closes.join(signals(bars, n, None).select("symbol", "tf", "t", "rule", "direction"), ["symbol", "tf", "t"]) for n in apart]
    return reduce(DataFrame.unionByName, out)


def leaderboard(bars: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Each rule on each series: signals, trades, wins and its compounded return in percent, best first.

    Signals are made once and counted and paired in one window: a long while out enters, the next change leaves, else the last bar."""
    keys = ["rule", "symbol", "tf"]
    x = every_signal(bars, names).withColumn("was", F.coalesce(F.lag("direction").over(Window.partitionBy(*keys).orderBy("t")), F.lit("exit")))
    x = x.withColumn("next", F.expr("lead(if(direction <> was, c, null), 1) IGNORE NULLS OVER (PARTITION BY rule, symbol, tf ORDER BY t)"))
    last = bars.groupBy("symbol", "tf").agg(F.max_by("c", "t").alias("last_c"))
    entered = (F.col("direction") == "long") & (F.col("was") == "exit")
    ret = F.when(entered, F.coalesce("next", "last_c") / F.col("c") - 1)
    x = x.join(last, ["symbol", "tf"]).withColumn("ret", ret).groupBy(*keys)
    out = x.agg(F.count(F.lit(1)).alias("signals"), F.count("ret").alias("trades"), F.count_if(F.col("ret") > 0).alias("wins"), F.product(F.col("ret") + 1).alias("grown"))
    return out.select(*keys, "signals", "trades", "wins", ((F.coalesce("grown", F.lit(1.0)) - 1) * 100).alias("return_pct")).orderBy(F.desc("return_pct"), *keys)
