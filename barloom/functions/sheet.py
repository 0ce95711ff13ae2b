"""Column building over bars: windows over (symbol, tf), cut into spans of time where no column reads further back than a
known number of rows, and linear recurrences by doubling."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

KEYS = ("symbol", "tf")
#: Rows of a span: what one task sorts and holds of a series.
SPAN = 65_536
#: Milliseconds within which the rows of a series are numbered by one task.
BUCKET = 45 * 86_400_000
#: A state that has shrunk to this share is gone: it is below half of the last bit of what replaced it.
FADED = 1e-17
EPS = 2.220446049250313e-16
_HELPER = re.compile(r"\b__\d+\b")


def near_zero(x: Column) -> Column:
    return F.abs(x) < EPS


def numbered(df: DataFrame, keys: list[str], order: str, span: int, name: str = "i") -> DataFrame:
    """Rows numbered from 0 within ``keys`` by ``order`` (milliseconds): within buckets of ``span``, then shifted by the counts of the buckets before."""
    df = df.withColumn("__bucket", F.floor(F.col(order) / span))
    counts = df.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*keys, "__bucket", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(order)) - 1
    return df.withColumn("__in", inside).join(shifts, [*keys, "__bucket"]).withColumn(name, F.col("__before") + F.col("__in")).drop("__bucket", "__in", "__before")


def spread(df: DataFrame, reach: int, rows: int) -> DataFrame:
    """``df`` in spans of ``rows`` rows of a series (``__span``), each with the ``reach`` rows before it (``__own`` is false
    there). Rows without symbol, tf or t take no part."""
    rows = max(rows, reach)
    row = F.col("__row")
    span = F.floor(row / rows)
    spans = F.when((span + 1) * rows - row <= reach, F.array(span, span + 1)).otherwise(F.array(span))
    cut = numbered(df, list(KEYS), "t", BUCKET, "__row").withColumns({"__at": span, "__span": F.explode(spans)})
    return cut.withColumn("__own", F.col("__at") == F.col("__span")).drop("__row", "__at")


class Sheet:
    """A bars DataFrame that grows by helper columns. Every step is a named column, so steps may nest.

    Columns wait in layers, each over those it reads from, until the rows are asked for: the plan is as deep as the longest chain of
    columns, not as their number. All frames share one window: Spark plans one exchange and one sort for them. Rows before a
    frame is full are null.
    ``w`` is a window over the whole series; ``rows`` gives bounded ones. ``reach`` adds up how far back the columns read.
    """

    def __init__(self, df: DataFrame | None, *more_keys: str):
        self._df, self.own, self.n = df, [c for c in df.columns if not c.startswith("__")] if df is not None else [], 0
        self._layers: list[dict[str, Column]] = []
        self._layer: dict[str, int] = {}
        self.o, self.h, self.l, self.c, self.v = (F.col(x) for x in "ohlcv")
        self._w = Window.partitionBy(*KEYS, *more_keys).orderBy("t")
        self.reach, self.whole, self.cut = 0, False, bool(more_keys)

    @property
    def df(self) -> DataFrame | None:
        for layer in self._layers:
            self._df = self._df.withColumns(layer)
        self._layers, self._layer = [], {}
        return self._df

    @property
    def w(self) -> WindowSpec:
        self.whole = True
        return self._w

    def rows(self, first: int, last: int = 0) -> WindowSpec:
        self.reach += max(0, -first)
        self.whole |= last > 0
        return self._w.rowsBetween(first, last)

    def row(self) -> Column:
        """How many rows there are up to this one; in a span after the first, some number above the rows before the span."""
        return self.put(F.row_number().over(self._w))

    def put(self, expr: Column) -> Column:
        self.n += 1
        name = f"__{self.n}"
        if self._df is not None:
            layer = max((self._layer[x] + 1 for x in _HELPER.findall(str(expr)) if x in self._layer), default=0)
            self._layers += [{} for _ in range(layer + 1 - len(self._layers))]
            self._layers[layer][name] = expr
            self._layer[name] = layer
        return F.col(name)

    def frame(self, agg: Column, x: Column, n: int) -> Column:
        """``agg`` over the last n rows, null until n rows of x are not null."""
        w = self.rows(1 - n)
        return self.put(F.when(F.count(x).over(w) == n, agg.over(w)))

    def lag(self, x: Column, k: int = 1) -> Column:
        self.reach += k
        return self.put(F.lag(x, k).over(self._w)) if k else x

    def sma(self, x: Column, n: int) -> Column:
        return self.frame(F.avg(x), x, n)

    def total(self, x: Column, n: int) -> Column:
        return self.frame(F.sum(x), x, n)

    def high(self, x: Column, n: int) -> Column:
        return self.frame(F.max(x), x, n)

    def low(self, x: Column, n: int) -> Column:
        return self.frame(F.min(x), x, n)

    def deviation(self, x: Column, n: int) -> Column:
        return self.frame(F.stddev_pop(x), x, n)

    def items(self, x: Column, n: int) -> Column:
        """The last n values, oldest first."""
        return self.frame(F.collect_list(x), x, n)

    def weighted(self, x: Column, weights: list[float]) -> Column:
        """Σ weight·value over the frame, oldest first."""
        values = self.items(x, len(weights))
        products = F.zip_with(values, F.array(*(F.lit(float(w)) for w in weights)), lambda a, b: a * b)
        return self.put(F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p))

    def wma(self, x: Column, n: int) -> Column:
        return self.weighted(x, [2 * k / (n * (n + 1)) for k in range(1, n + 1)])

    def seen(self, x: Column) -> Column:
        """How many values there are up to this row; in a span after the first, from somewhere before the span."""
        return self.put(F.count(x).over(self._w.rowsBetween(Window.unboundedPreceding, 0)))

    def scan(self, *steps: tuple[Column, Column], most: float) -> list[Column]:
        """y_t = q_t·y_{t-1} + b_t for each (q, b) with q from 0 to ``most``, or 1 where the state stays as it is.

        Steps are composed by doubling twice a round: a row's step over 4^k rows is made of four over 4^(k-1), met by lags
        in one window. Rounds end where ``most`` has faded what came before; where q of 1 kept that from fading, y is
        null. All rounds share one exchange and one sort, and nothing is joined."""
        rounds = max(1, math.ceil(math.log(math.log(FADED) / math.log(most), 4) - 1e-9))
        self.reach += 4**rounds
        done = []
        for q, b in steps:
            q, b = self.put(q), self.put(b)
            for k in range(rounds):
                qs = [q, *(F.lag(q, i * 4**k, 0.0).over(self._w) for i in (1, 2, 3))]
                bs = [b, *(F.lag(b, i * 4**k, 0.0).over(self._w) for i in (1, 2, 3))]
                q, b = self.put(qs[0] * qs[1] * qs[2] * qs[3]), self.put(bs[0] + qs[0] * (bs[1] + qs[1] * (bs[2] + qs[2] * bs[3])))
            done.append(self.put(F.when(q < 1e-12, b)))
        return done

    def smooth(self, *steps: tuple[Column, float, int], seed: str = "mean") -> list[Column]:
        """Exponential smoothing of each (x, alpha, n): seeded with the mean of its first n values, or with the first
        value (seed="first", n is 1 then); null until seeded. Null inputs leave the state as it is; after more of them in a
        row than a state takes to fade, the result is null until as many values have come."""
        ready, todo, reach = [], [], self.reach
        for x, alpha, n in steps:
            n = 1 if seed == "first" else n
            seen = self.seen(x)
            start = self.sma(x, n)
            b = F.when(x.isNull(), 0.0).when(seen < n, 0.0).when(seen == n, start).otherwise(alpha * x)
            if alpha >= 1:
                ready.append((x, None))
                continue
            q = F.when(x.isNull(), F.when(seen < n, 0.0).otherwise(1.0)).when(seen <= n, 0.0).otherwise(1.0 - alpha)
            todo.append((q, b))
            ready.append((seen, n))
        self.reach = reach + max((n for _, _, n in steps), default=0)
        done = iter(self.scan(*todo, most=max(1.0 - alpha for _, alpha, _ in steps if alpha < 1))) if todo else iter(())
        return [s if n is None else self.put(F.when(s >= n, next(done))) for s, n in ready]

    def ema(self, x: Column, n: int) -> Column:
        return self.smooth((x, 2 / (n + 1), n))[0]

    def smma(self, x: Column, n: int) -> Column:
        return self.smooth((x, 1 / n, n))[0]

    def kept(self) -> DataFrame:
        """The rows of the sheet, those before each span left out."""
        return self.df.where("__own") if self.cut else self.df

    def done(self, **outputs: Column) -> DataFrame:
        """The bars with the outputs, without the helper columns."""
        rows = self.df.select(*self.own, *(["__own"] if self.cut else []), *(v.alias(k) for k, v in outputs.items()))
        return rows.where("__own").drop("__own") if self.cut else rows


def sheet_for(bars: DataFrame, columns: Callable[[Sheet], object], rows: int | None = SPAN) -> Sheet:
    """A sheet that ``columns`` may fill. Where they read only so many rows back, found by a first run without rows, the
    series is cut into spans of ``rows`` rows, each a task of its own; elsewhere, or without ``rows``, it stays whole."""
    if rows:
        dry = Sheet(None)
        columns(dry)
        if not dry.whole:
            return Sheet(spread(bars, dry.reach, rows), "__span")
    return Sheet(bars)
