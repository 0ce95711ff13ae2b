"""Chart patterns: each bar pairs the pivots that its last ``window`` bars confirm, as array expressions over two frames.

The arrays hold pivots of one window only, so their size is bounded by ``window`` and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sheet import EPS, Sheet

SIGNAL = "struct<kind:string,confidence:double,target:double,stop:double,pivots:array<bigint>>"
BULLISH = ("double_bottom", "inverse_head_and_shoulders", "ascending_triangle", "bull_flag", "falling_wedge")
BEARISH = ("double_top", "head_and_shoulders", "descending_triangle", "bear_flag", "rising_wedge")


def _signal(kind: str, confidence: Column, target: Column, stop: Column, *points: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.least(F.lit(1.0), confidence).alias("confidence"), target.alias("target"), stop.alias("stop"),
        (F.array(*(p["t"] for p in points)) if points else F.lit(None)).cast("array<bigint>").alias("pivots"),
    ).cast(SIGNAL)


def _level(a: Column, b: Column) -> Column:
    return (a["p"] + b["p"]) / 2


def _near(a: Column, b: Column, tolerance: float) -> Column:
    """Relative distance from their mean is within the tolerance."""
    mean = _level(a, b)
    return (mean < EPS) | (F.abs(a["p"] - b["p"]) <= mean * tolerance)


def _between(points: Column, a: Column, b: Column, highest: bool) -> Column:
    """The extreme pivot strictly between two others: of equal lows the first, of equal highs the last."""
    inside = F.filter(points, lambda p: (p["i"] > a["i"]) & (p["i"] < b["i"]))
    return F.array_max(inside) if highest else F.array_min(inside)


def _one(holds: Column, signal: Column) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), F.array(signal)).otherwise(F.array().cast(f"array<{SIGNAL}>"))


class Slices:
    """The pivots of each bar's trailing slice: ``tops`` and ``bottoms`` as arrays of (p, i, t), oldest first."""

    def __init__(self, s: Sheet, window: int, size: int):
        self.s, self.window = s, window
        self.row = s.put(F.row_number().over(s.w))
        around, w = s.w.rowsBetween(-size, size), s.w.rowsBetween(size - window + 1, -size)
        full = F.count(F.lit(1)).over(around) == 2 * size + 1
        point = lambda x: F.struct(x.alias("p"), self.row.alias("i"), F.col("t"))
        high, low = s.put(F.when(full & (s.h >= F.max("h").over(around)), point(s.h))), s.put(F.when(full & (s.l <= F.min("l").over(around)), point(s.l)))
        self.tops, self.bottoms = s.put(F.collect_list(high).over(w)), s.put(F.collect_list(low).over(w))

    def sides(self, top: bool) -> tuple[Column, Column]:
        return (self.tops, self.bottoms) if top else (self.bottoms, self.tops)

    def past(self, x: Column, top: bool) -> Column:
        """The close is through a level: below it after tops, above it after bottoms."""
        return self.s.c < x if top else self.s.c > x

    def last(self, points: Column) -> tuple[Column, Column]:
        n = F.size(points)
        return F.get(points, n - 2), F.get(points, n - 1)

    def line(self, a: Column, b: Column) -> Column:
        """The line through two pivots at the current bar."""
        return a["p"] + (b["p"] - a["p"]) / (b["i"] - a["i"]) * (self.row - a["i"])

    def double(self, kind: str, top: bool, tolerance: float = 0.03) -> Column:
        points, others = self.sides(top)
        made = F.zip_with(points, F.slice(points, 2, self.window), lambda a, b: F.struct(a.alias("a"), b.alias("b"), _between(others, a, b, not top).alias("m")))
        found = F.filter(made, lambda x: F.coalesce(_near(x["a"], x["b"], tolerance) & self.past(x["m"]["p"], top), F.lit(False)))
        like = lambda x: 1 - F.abs(x["a"]["p"] - x["b"]["p"]) / _level(x["a"], x["b"])
        return F.transform(found, lambda x: _signal(kind, like(x) * 0.7 + 0.3, 2 * x["m"]["p"] - _level(x["a"], x["b"]), x["b"]["p"] * (1.005 if top else 0.995), x["a"], x["m"], x["b"]))

    def shoulders(self, kind: str, top: bool, tolerance: float = 0.05) -> Column:
        points, others = self.sides(top)
        pairs = F.zip_with(points, F.slice(points, 2, self.window), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        made = F.zip_with(pairs, F.slice(points, 3, self.window), lambda x, c: F.struct(
            x["a"].alias("a"), x["b"].alias("b"), c.alias("c"), _between(others, x["a"], x["b"], not top).alias("l"), _between(others, x["b"], c, not top).alias("r"),
        ))
        neck = lambda x: _level(x["l"], x["r"])
        above = lambda x, y: x["p"] > y["p"] if top else x["p"] < y["p"]
        found = F.filter(made, lambda x: F.coalesce(above(x["b"], x["a"]) & above(x["b"], x["c"]) & _near(x["a"], x["c"], tolerance) & self.past(neck(x), top), F.lit(False)))
        like = lambda x: 1 - F.abs(x["a"]["p"] - x["c"]["p"]) / (x["b"]["p"] if top else neck(x))
        return F.transform(found, lambda x: _signal(kind, like(x) * 0.7 + 0.3, 2 * neck(x) - x["b"]["p"], x["c"]["p"] * (1.005 if top else 0.995), x["a"], x["l"], x["b"], x["r"], x["c"]))

    def triangle(self, kind: str) -> Column:
        (a, b), (c, d) = self.last(self.tops), self.last(self.bottoms)
        if kind == "ascending_triangle":
            level = _level(a, b)
            holds = _near(a, b, 0.02) & (d["p"] > c["p"]) & (self.s.c > level)
            return _one(holds, _signal(kind, (1 - F.abs(a["p"] - b["p"]) / level) * 0.8 + 0.2, 2 * level - c["p"], d["p"] * 0.995, a, c, b, d))
        if kind == "descending_triangle":
            level = _level(c, d)
            holds = _near(c, d, 0.02) & (b["p"] < a["p"]) & (self.s.c < level)
            return _one(holds, _signal(kind, (1 - F.abs(c["p"] - d["p"]) / level) * 0.8 + 0.2, 2 * level - a["p"], b["p"] * 1.005, a, c, b, d))
        up, down, height = self.line(a, b), self.line(c, d), a["p"] - c["p"]
        holds = (b["p"] < a["p"]) & (d["p"] > c["p"]) & (up > down) & (self.s.c > up)
        converged = 1 - (up - down) / F.greatest(height, F.lit(EPS))
        return _one(holds, _signal(kind, F.greatest(F.lit(0.0), converged * 0.6 + 0.4), up + height, down * 0.995, a, c, b, d))

    def flag(self, kind: str, n: int = 30, pole: float = 0.4, move: float = 0.04, retrace: float = 0.5) -> Column:
        s, first = self.s, max(2, int(n * pole))
        over = lambda f, x, a, b: f(x).over(s.w.rowsBetween(a, b))
        top, base = over(F.max, "h", 1 - n, first - n), over(F.min, "l", 1 - n, first - n)
        low, high = over(F.min, "l", first - n + 1, 0), over(F.max, "h", first - n + 1, 0)
        full = s.put(over(F.count, "c", 1 - n, 0) == n)
        top, base, low, high = s.put(top), s.put(base), s.put(low), s.put(high)
        size, bull = F.greatest(top - base, F.lit(EPS)), kind == "bull_flag"
        back = (top - low) / size if bull else (high - base) / size
        holds = full & ((top - base) / F.nullif(base if bull else top, F.lit(0.0)) >= move) & (back <= retrace) & (s.c > top if bull else s.c < base)
        target = top + (top - base) if bull else base - (top - base)
        return _one(holds, _signal(kind, (1 - back / retrace) * 0.6 + 0.4, target, low * 0.995 if bull else high * 1.005))

    def wedge(self, kind: str) -> Column:
        (a, b), (c, d) = self.last(self.tops), self.last(self.bottoms)
        high, low = (b["p"] - a["p"]) / (b["i"] - a["i"]), (d["p"] - c["p"]) / (d["i"] - c["i"])
        up, down = self.line(a, b), self.line(c, d)
        height, sure = F.greatest(up - down, F.lit(0.0)), F.greatest(F.lit(0.3), 0.4 + (low - high) * 5)
        if kind == "rising_wedge":
            return _one((high > 0) & (low > high) & (self.s.c < down), _signal(kind, sure, down - height, up * 1.005, a, c, b, d))
        return _one((low < 0) & (high < low) & (self.s.c > up), _signal(kind, sure, up + height, down * 0.995, a, c, b, d))

    def found(self, kinds: tuple[str, ...], flag: int = 30) -> Column:
        """All signals of a bar, in the order of ``kinds``."""
        how = {
            "double_top": lambda k: self.double(k, True), "double_bottom": lambda k: self.double(k, False),
            "head_and_shoulders": lambda k: self.shoulders(k, True), "inverse_head_and_shoulders": lambda k: self.shoulders(k, False),
            "bull_flag": lambda k: self.flag(k, flag), "bear_flag": lambda k: self.flag(k, flag), "rising_wedge": self.wedge, "falling_wedge": self.wedge,
        }
        return self.s.put(F.concat(*(how.get(k, self.triangle)(k) for k in kinds)))


KINDS = (
    "double_top", "double_bottom", "head_and_shoulders", "inverse_head_and_shoulders", "ascending_triangle", "descending_triangle",
    "symmetric_triangle", "bull_flag", "bear_flag", "rising_wedge", "falling_wedge",
)


def chart_patterns(bars: DataFrame, kinds: tuple[str, ...] = KINDS, window: int = 60, size: int = 3) -> DataFrame:
    """symbol, tf, t, kind, confidence, entry, target, stop, pivots (their times): one row per pattern that a close confirms.

    A pattern stays confirmed for as long as the close stays through its level and its pivots are in the window."""
    s = Sheet(bars)
    found = Slices(s, window, size).found(kinds)
    return s.df.select("symbol", "tf", "t", F.col("c").alias("entry"), F.explode(found).alias("x")).select("symbol", "tf", "t", "x.kind", "x.confidence", "entry", "x.target", "x.stop", "x.pivots")


def best_pattern(s: Sheet, kinds: tuple[str, ...], window: int = 60, least: float = 0.6) -> Column:
    """(confidence, place, kind) of the surest pattern of a bar, the last of equals; null where none is sure enough."""
    found = Slices(s, window, 3).found(kinds, flag=window)
    ranked = F.transform(found, lambda x, i: F.struct(x["confidence"].alias("confidence"), i.alias("place"), x["kind"].alias("kind")))
    return s.put(F.array_max(F.filter(ranked, lambda x: x["confidence"] >= least)))
