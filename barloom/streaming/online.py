"""Indicators and rules bar by bar: each is defined once, as columns of a ``Sheet`` and as a step on a stream.

A node holds a fixed number of doubles. ``column`` and ``state`` give its value and those doubles for every row of a table, ``step``
takes them from one bar to the next. So a stream may start from the state in which a table ends, and what it gives
afterwards equals the columns over both.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.sheet import SPAN, Sheet, sheet_for

PRICES = ("o", "h", "l", "c", "v")
_STATE = "t long, numbers array<double>"
_NONE = math.nan


class Node:
    """A value of a bar. ``inputs`` are other nodes; ``width`` is the number of doubles that it keeps between bars."""

    width = 0
    inputs: tuple[Node, ...] = ()

    def column(self, s: Sheet, x: list[Column]) -> Column:
        raise NotImplementedError

    def state(self, s: Sheet, x: list[Column], value: Column) -> list[Column]:
        return []

    def start(self) -> list[float]:
        return [_NONE] * self.width

    def step(self, bar: dict, x: list, held: list[float]) -> float | None:
        raise NotImplementedError

    def __sub__(self, other: Node) -> Node:
        return Minus(self, other)


class Price(Node):
    def __init__(self, name: str = "c"):
        self.name = name

    def column(self, s, x):
        return F.col(self.name)

    def step(self, bar, x, held):
        return bar[self.name]


class Minus(Node):
    def __init__(self, a: Node, b: Node):
        self.inputs = (a, b)

    def column(self, s, x):
        return s.put(x[0] - x[1])

    def step(self, bar, x, held):
        return None if None in x else x[0] - x[1]


class Before(Node):
    """The value of the bar before."""

    width = 1

    def __init__(self, a: Node):
        self.inputs = (a,)

    def column(self, s, x):
        return s.lag(x[0])

    def state(self, s, x, value):
        return [x[0]]

    def step(self, bar, x, held):
        out = None if math.isnan(held[0]) else held[0]
        held[0] = _NONE if x[0] is None else x[0]
        return out


class Mean(Node):
    """Mean of the last n values, null until there are n."""

    def __init__(self, a: Node, n: int):
        self.inputs, self.width, self.n = (a,), n - 1, n

    def column(self, s, x):
        return s.sma(x[0], self.n)

    def state(self, s, x, value):
        return [s.lag(x[0], k) for k in range(self.n - 2, -1, -1)]

    def step(self, bar, x, held):
        last = [*held, _NONE if x[0] is None else x[0]]
        held[:] = last[1:]
        total = sum(last)
        return None if math.isnan(total) else total / self.n


class Smooth(Node):
    """Exponential smoothing seeded with the mean of the first n values: a linear recurrence, y = q y + b."""

    width = 3  # values seen (n at most), their sum until n are seen, y

    def __init__(self, a: Node, alpha: float, n: int):
        self.inputs, self.alpha, self.n = (a,), alpha, n

    def column(self, s, x):
        return s.smooth((x[0], self.alpha, self.n))[0]

    def state(self, s, x, value):
        seen = s.put(F.least(s.seen(x[0]), F.lit(self.n)).cast("double"))
        return [seen, s.put(F.sum(x[0]).over(s.rows(1 - self.n))), value]

    def start(self):
        return [0.0, 0.0, _NONE]

    def step(self, bar, x, held):
        v = x[0]
        if v is not None and held[0] < self.n:
            before = 0.0 if math.isnan(held[1]) else held[1]
            held[0], held[1] = held[0] + 1, before + v
            if held[0] == self.n:
                held[2] = held[1] / self.n
        elif v is not None:
            held[2] = self.alpha * v + (1 - self.alpha) * held[2]
        return None if math.isnan(held[2]) else held[2]


class Strength(Node):
    """100 - 100 / (1 + gain / loss)."""

    def __init__(self, gain: Node, loss: Node):
        self.inputs = (gain, loss)

    def column(self, s, x):
        return s.put(F.when(x[1].isNull(), None).when(F.abs(x[1]) < 2.220446049250313e-16, 100.0).otherwise(100 - 100 / (1 + x[0] / x[1])))

    def step(self, bar, x, held):
        gain, loss = x
        return None if loss is None else 100.0 if abs(loss) < 2.220446049250313e-16 else 100 - 100 / (1 + gain / loss)


class Part(Node):
    """The positive part of a change, or of its opposite."""

    def __init__(self, a: Node, sign: int):
        self.inputs, self.sign = (a,), sign

    def column(self, s, x):
        return s.put(F.when(x[0].isNotNull(), F.greatest(x[0] * self.sign, F.lit(0.0))))

    def step(self, bar, x, held):
        return None if x[0] is None else max(x[0] * self.sign, 0.0)


class Crossed(Node):
    """1 where a rises above b (sign 1) or falls below it (sign -1), else 0."""

    width = 2

    def __init__(self, a: Node, b: Node, sign: int):
        self.inputs, self.sign = (a, b), sign

    def column(self, s, x):
        a, b = x[0] * self.sign, x[1] * self.sign
        return s.put(F.coalesce((s.lag(x[0]) * self.sign <= s.lag(x[1]) * self.sign) & (a > b), F.lit(False)).cast("double"))

    def state(self, s, x, value):
        return list(x)

    def step(self, bar, x, held):
        now = [_NONE if v is None else v for v in x]
        hit = held[0] * self.sign <= held[1] * self.sign and now[0] * self.sign > now[1] * self.sign
        held[:] = now
        return float(hit)


class Level(Node):
    """A number."""

    def __init__(self, value: float):
        self.value = value

    def column(self, s, x):
        return F.lit(self.value)

    def step(self, bar, x, held):
        return self.value


def ema(n: int, x: Node | None = None) -> Node:
    return Smooth(x or Price(), 2 / (n + 1), n)


def rsi(n: int = 14, x: Node | None = None) -> Node:
    x = x or Price()
    change = x - Before(x)
    return Strength(Smooth(Part(change, 1), 1 / n, n), Smooth(Part(change, -1), 1 / n, n))


def macd(fast: int = 12, slow: int = 26, signal: int = 9, x: Node | None = None) -> tuple[Node, Node]:
    """The line and its signal."""
    line = ema(fast, x) - ema(slow, x)
    return line, ema(signal, line)


def _ordered(outputs: dict[str, Node]) -> list[Node]:
    """All nodes, each once and after its inputs."""
    out: list[Node] = []

    def add(node: Node) -> None:
        if all(node is not x for x in out):
            for x in node.inputs:
                add(x)
            out.append(node)

    for node in outputs.values():
        add(node)
    return out


def _filled(s: Sheet, outputs: dict[str, Node]) -> tuple[dict[str, Column], list[Column]]:
    """Outputs and the whole state of each row, as columns."""
    columns: dict[int, Column] = {}
    state: list[Column] = []
    for node in _ordered(outputs):
        x = [columns[id(i)] for i in node.inputs]
        columns[id(node)] = node.column(s, x)
        state += node.state(s, x, columns[id(node)])
    return {k: columns[id(v)] for k, v in outputs.items()}, state


def with_nodes(bars: DataFrame, outputs: dict[str, Node], rows: int | None = SPAN) -> DataFrame:
    """The bars of a table with each output, in spans of a series."""
    s = sheet_for(bars, lambda s: _filled(s, outputs), rows)
    return s.done(**_filled(s, outputs)[0])


def final_state(history: DataFrame, outputs: dict[str, Node], rows: int | None = SPAN) -> DataFrame:
    """symbol, tf, t, numbers: the state in which each series of a table ends; ``initial`` of ``online``."""
    s = sheet_for(history, lambda s: _filled(s, outputs), rows)
    numbers = F.array(*(F.coalesce(x.cast("double"), F.lit(_NONE)) for x in _filled(s, outputs)[1]))
    kept = s.done(numbers=numbers)
    return kept.groupBy("symbol", "tf").agg(F.max("t").alias("t"), F.max_by("numbers", "t").alias("numbers"))


class _Online(StatefulProcessor):
    def __init__(self, outputs: dict[str, Node]):
        self.outputs = outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("series", _STATE)
        self.nodes = _ordered(self.outputs)
        place = {id(n): i for i, n in enumerate(self.nodes)}
        self.inputs = [[place[id(i)] for i in n.inputs] for n in self.nodes]
        self.asked = {k: place[id(n)] for k, n in self.outputs.items()}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, states = None, [n.start() for n in self.nodes]
        if self.held.exists():
            last, numbers = self.held.get()
            at = 0
            for i, n in enumerate(self.nodes):
                states[i] = list(numbers[at : at + n.width])
                at += n.width
        new = pd.concat(list(rows)).sort_values("t", kind="stable")
        out = []
        for t, *prices in new[["t", *PRICES]].itertuples(index=False, name=None):
            if last is not None and t <= last:
                continue
            bar, values = dict(zip(PRICES, prices, strict=True)), []
            for n, own, held in zip(self.nodes, self.inputs, states, strict=True):
                values.append(n.step(bar, [values[i] for i in own], held))
            out.append((*key, t, *prices, *(values[i] for i in self.asked.values()), None if last is None else t - last))
            last = t
        if out:
            self.held.update((int(last), [float(x) for held in states for x in held]))
            frame = pd.DataFrame(out, columns=["symbol", "tf", "t", *PRICES, *self.asked, "step"])
            yield frame.astype({**dict.fromkeys(self.asked, "float64"), "step": "Int64"})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.held.update((int(row["t"]), [float(x) for x in row["numbers"]]))

    def close(self) -> None:
        pass


def online(bars: DataFrame, outputs: dict[str, Node], initial: DataFrame | None = None) -> DataFrame:
    """New bars of a stream with each output, as ``with_nodes`` gives them over the whole series, and ``step``, the milliseconds since
    the bar before (null for the first): more than a timeframe is a gap.

    State per (symbol, tf): the last t and some doubles. Bars at or below the last t, repeats among them, are dropped. initial:
    ``final_state`` of a history table with the same outputs; then the stream goes on where the history ends. Needs the
    RocksDB state store (``use_rocksdb``)."""
    schema = "symbol string, tf string, t long, " + ", ".join(f"{x} double" for x in (*PRICES, *outputs)) + ", step long"
    keyed = initial.groupBy("symbol", "tf") if initial is not None else None
    return bars.groupBy("symbol", "tf").transformWithStateInPandas(_Online(outputs), schema, "Append", "None", keyed)


def projected(forming: DataFrame, states: DataFrame, outputs: dict[str, Node]) -> DataFrame:
    """Each forming bar with the outputs as they would be if it closed as it is: the confirmed state (``final_state``) taken one step and
    thrown away, so any number of forming bars may follow one state. Bars that aren't above their series' last t are left out;
    a series without a state starts anew."""
    schema = "symbol string, tf string, t long, " + ", ".join(f"{x} double" for x in (*PRICES, *outputs))
    met = forming.select("symbol", "tf", "t", *PRICES).join(states.select("symbol", "tf", F.col("t").alias("last"), "numbers"), ["symbol", "tf"], "left").where("last IS NULL OR t > last")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes = _ordered(outputs)
        place = {id(n): i for i, n in enumerate(nodes)}
        for b in batches:
            rows = []
            for symbol, tf, t, *prices, _, numbers in b.itertuples(index=False, name=None):
                values, at = [], 0
                for n in nodes:
                    held = n.start() if numbers is None else list(numbers[at : at + n.width])
                    at += n.width
                    values.append(n.step(dict(zip(PRICES, prices, strict=True)), [values[place[id(i)]] for i in n.inputs], held))
                rows.append((symbol, tf, t, *prices, *(values[place[id(n)]] for n in outputs.values())))
            yield pd.DataFrame(rows, columns=["symbol", "tf", "t", *PRICES, *outputs]).astype(dict.fromkeys(outputs, "float64"))

    return met.mapInPandas(run, schema)


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def gaps_of(made: DataFrame, tf_ms: int) -> DataFrame:
    """Bars of ``online`` that come more than one timeframe after the bar before: symbol, tf, after, before, missing."""
    late = made.where(F.col("step") > tf_ms)
    return late.select("symbol", "tf", (F.col("t") - F.col("step")).alias("after"), F.col("t").alias("before"), (F.floor(F.col("step") / tf_ms) - 1).alias("missing"))


def crossing_signals(made: DataFrame, name: str, up: str = "up", down: str = "down") -> DataFrame:
    """Signals of a rule whose entry and exit are outputs of ``online`` or ``with_nodes``: entries first, one signal a bar."""
    side = F.when(F.col(up) > 0, "long").when(F.col(down) > 0, "exit")
    return made.select("symbol", "tf", "t", F.lit(name).alias("rule"), side.alias("direction")).where("direction IS NOT NULL")
