"""Candlestick patterns as lag expressions, pivots as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sheet import Sheet, near_zero


def candlesticks(bars: DataFrame) -> DataFrame:
    """The bars with one boolean column per pattern; patterns that look back are null until they can. A bar that closes where it opened counts as rising."""
    s = Sheet(bars)
    o, h, low, c = s.o, s.h, s.l, s.c
    size = s.put(h - low)
    share = lambda x: F.when(near_zero(size), 0.0).otherwise(x / size)
    body, upper, lower = s.put(share(F.abs(c - o))), s.put(share(h - F.greatest(o, c))), s.put(share(F.greatest(F.lit(0.0), F.least(o, c) - low)))
    span, past = s.put(F.abs(c - o)), s.put(F.coalesce(s.lag(c, 4), F.first("c").over(s.w)))
    (po, pc), (qo, qc) = ((s.lag(o, k), s.lag(c, k)) for k in (1, 2))
    b1, b2 = s.lag(body, 1), s.lag(body, 2)
    s2 = s.lag(span, 2)
    mean = s.put(F.avg(span).over(s.w.rowsBetween(-9, -3)))
    first = s.put(F.first(span).over(s.w.rowsBetween(Window.unboundedPreceding, 0)))
    warm = s.lag(c, 9).isNotNull()
    hammer, star = (upper < 0.2) & (lower > 0.6) & (body < 0.35), (lower < 0.2) & (upper > 0.6) & (body < 0.35)
    return s.done(
        doji=body < 0.1, hammer=hammer & (c < past), hanging_man=hammer & (c >= past), shooting_star=star & (c > past), inverted_hammer=star & (c <= past),
        marubozu_bull=(body > 0.95) & (c >= o), marubozu_bear=(body > 0.95) & (c < o),
        engulfing_bull=(pc < po) & (c > o) & (o < pc) & (c > po), engulfing_bear=(pc >= po) & (c < o) & (o > pc) & (c < po),
        morning_star=F.when(warm, (qc < qo) & (s2 > mean * 0.5) & (b1 < 0.4) & (s.lag(h) < F.least(qc, o) + mean * 0.3) & (c >= o) & (c > (qo + qc) / 2)),
        evening_star=(qc >= qo) & (s2 > first * 0.5) & (b1 < 0.4) & (c < o) & (c < (qo + qc) / 2),
        three_white_soldiers=(c > pc) & (pc > qc) & (c > o) & (pc > po) & (qc > qo) & (body > 0.5) & (b1 > 0.5) & (b2 > 0.5) & (o > po) & (o < pc) & (po > qo) & (po < qc),
        three_black_crows=(c < pc) & (pc < qc) & (c < o) & (pc < po) & (qc < qo) & (body > 0.5) & (b1 > 0.5) & (b2 > 0.5) & (o < po) & (o > pc) & (po < qo) & (po > qc),
    )


def pivots(bars: DataFrame, left: int = 3, right: int = 3) -> DataFrame:
    """Bars whose high (low) is at least (at most) that of all neighbours; ties count, full neighbourhoods only."""
    s = Sheet(bars)
    w = s.w.rowsBetween(-left, right)
    full = F.count(F.lit(1)).over(w) == left + right + 1
    return s.done(pivot_high=full & (s.h >= F.max("h").over(w)), pivot_low=full & (s.l <= F.min("l").over(w)))
