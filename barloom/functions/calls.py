"""Series functions over a ``Sheet``: each takes columns and gives a column; what isn't known is null, tests on it are false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sheet import Sheet


def _sure(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def cross_above(s: Sheet, a: Column, b: Column) -> Column:
    a, b = s.put(a), s.put(b)
    return _sure((s.lag(a) <= s.lag(b)) & (a > b))


def cross_below(s: Sheet, a: Column, b: Column) -> Column:
    a, b = s.put(a), s.put(b)
    return _sure((s.lag(a) >= s.lag(b)) & (a < b))


def crossed(s: Sheet, a: Column, b: Column) -> Column:
    return cross_above(s, a, b) | cross_below(s, a, b)


def above(a: Column, b: Column) -> Column:
    return _sure(a > b)


def below(a: Column, b: Column) -> Column:
    return _sure(a < b)


def rising(s: Sheet, x: Column, n: int = 1) -> Column:
    """n strict steps up; fewer rows are false."""
    step = s.put((x > s.lag(x)).cast("int"))
    w = s.w.rowsBetween(1 - n, 0)
    return _sure((F.min(step).over(w) == 1) & (F.count(step).over(w) == n))


def falling(s: Sheet, x: Column, n: int = 1) -> Column:
    return rising(s, s.put(-x), n)


def in_range(x: Column, low: Column | float, high: Column | float) -> Column:
    return _sure((x >= low) & (x <= high))


def within(a: Column, b: Column, tolerance: float) -> Column:
    return _sure(F.abs(a - b) <= tolerance)


def flag(x: Column) -> Column:
    return _sure(x > 0.5)


def slope(s: Sheet, x: Column, n: int = 2) -> Column:
    return (x - s.lag(x, n - 1)) / (n - 1)


def momentum(s: Sheet, x: Column, n: int) -> Column:
    return x - s.lag(x, n)


def pct_change(s: Sheet, x: Column, n: int) -> Column:
    p = s.lag(x, n)
    return F.when(p == 0, 0.0).otherwise((x - p) / p)


def highest(s: Sheet, x: Column, n: int) -> Column:
    return s.high(x, n)


def lowest(s: Sheet, x: Column, n: int) -> Column:
    return s.low(x, n)


def _zeroed(s: Sheet, x: Column) -> Column:
    return s.put(F.coalesce(x, F.lit(0.0)))


def avg(s: Sheet, x: Column, n: int) -> Column:
    """The mean over n rows, missing values as 0; null until there are n rows."""
    return s.sma(_zeroed(s, x), n)


def total(s: Sheet, x: Column, n: int) -> Column:
    return s.total(_zeroed(s, x), n)


def stdev(s: Sheet, x: Column, n: int) -> Column:
    return s.deviation(_zeroed(s, x), n)


def zscore(s: Sheet, x: Column, n: int) -> Column:
    """Distance from the mean in deviations of the population; 0 without deviation."""
    x = _zeroed(s, x)
    dev = s.deviation(x, n)
    return F.when(dev == 0, 0.0).otherwise((x - s.sma(x, n)) / dev)


def running_sum(s: Sheet, x: Column, n: int) -> Column:
    """The sum over up to n rows, from the first row on."""
    return s.put(F.sum(x).over(s.w.rowsBetween(1 - n, 0)))
