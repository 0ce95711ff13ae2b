"""Live bars: closes that a newer bar implies, windows of the last bars, indicators and rules over them, the seam between
history and stream, forming candles, routing to rules, delivery times.

Stateful steps keep a bounded state per (symbol, tf), however long the stream runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.series import checkpoint_dir
from ..sources.bars import TIMEFRAMES

_BAR = ["t", "o", "h", "l", "c", "v"]
_BAR_SCHEMA = "symbol string, tf string, t long, o double, h double, l double, c double, v double"


def inferred_closes(updates: DataFrame) -> DataFrame:
    """Each bar once, as it closed, from updates (symbol, tf, t, o, h, l, c, v, closed, received).

    A confirmed bar closes; a forming bar closes the one before it, and that one's confirmation is a repeat then. What comes
    at or below the last closed t is dropped. State: the last closed t and the forming bar."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, *forming = state.get if state.exists else (None,) * 7
        out = []
        rows = pd.concat(list(parts)).sort_values(["received", "t"], kind="stable")
        for *bar, closed in rows[[*_BAR, "closed"]].itertuples(index=False, name=None):
            if last is not None and bar[0] <= last:
                continue
            if forming[0] is not None and bar[0] > forming[0]:
                out.append(forming)
                last, forming = forming[0], [None] * 6
            if closed:
                out.append(bar)
                last, forming = bar[0], [None] * 6
            elif forming[0] is None or bar[0] >= forming[0]:
                forming = bar
        state.update((last, *forming))
        if out:
            yield pd.DataFrame(out, columns=_BAR).assign(symbol=key[0], tf=key[1])[["symbol", "tf", *_BAR]]

    kept = "last long, t long, o double, h double, l double, c double, v double"
    return updates.groupBy("symbol", "tf").applyInPandasWithState(step, _BAR_SCHEMA, kept, "append", "NoTimeout")


def online(bars: DataFrame, capacity: int, f: Callable[[pd.DataFrame], pd.DataFrame], outputs: str) -> DataFrame:
    """New bars with what ``f`` makes of the last ``capacity`` bars up to each: indicators and rules over a stream.

    ``f`` takes a series' bars in time order and returns ``outputs`` (a schema) row by row; it sees the new bars of a batch
    and the capacity - 1 before the first of them, so it must look back no further. Bars at or below the last t are dropped."""
    names = [x.split()[0] for x in outputs.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(_BAR, state.get, strict=True))) if state.exists else pd.DataFrame(columns=_BAR)
        new = pd.concat(list(parts))[_BAR].sort_values("t", kind="stable").drop_duplicates("t")
        new = new[new["t"] > held["t"].iloc[-1]] if len(held) else new
        if not len(new):
            return
        both = pd.concat([held, new], ignore_index=True) if len(held) else new.reset_index(drop=True)
        both = both.astype({"t": "int64", **dict.fromkeys(_BAR[1:], "float64")})
        made = both.assign(**{k: f(both)[k] for k in names}, symbol=key[0], tf=key[1])
        tail = both.tail(capacity - 1) if capacity > 1 else both.tail(1)
        state.update(tuple(tail[x].tolist() for x in _BAR))
        yield made[["symbol", "tf", *_BAR, *names]].tail(len(new))

    kept = "t array<long>, " + ", ".join(f"{x} array<double>" for x in _BAR[1:])
    return bars.groupBy("symbol", "tf").applyInPandasWithState(step, f"{_BAR_SCHEMA}, {outputs}", kept, "append", "NoTimeout")


def last_bars(bars: DataFrame, capacity: int) -> DataFrame:
    """Each new bar with the closes of the last ``capacity`` bars, its own last."""
    window = lambda x: pd.DataFrame({"closes": [x["c"].iloc[max(0, i + 1 - capacity) : i + 1].tolist() for i in range(len(x))]})
    return online(bars, capacity, window, "closes array<double>")


def closed_only(updates: DataFrame) -> DataFrame:
    """Updates (…, closed) of bars that are final; what is forming goes."""
    return updates.where(F.coalesce(F.col("closed"), F.lit(False))).drop("closed")


def after_history(live: DataFrame, history: DataFrame) -> DataFrame:
    """Live bars above the last t that the history holds of their series: what follows the history without a gap or a repeat.
    Series without history pass whole. The ends are worked out once and stored, not in every batch."""
    checkpoint_dir(history.sparkSession)
    ends = history.groupBy("symbol", "tf").agg(F.max("t").alias("__end")).checkpoint()
    return live.join(ends, ["symbol", "tf"], "left").where("__end IS NULL OR t > __end").select(*live.columns)


def routed(bars: DataFrame, watchers: DataFrame) -> DataFrame:
    """Each closed bar once per rule of ``watchers(rule, symbol, tf)`` that watches its series; a stream meets them as they are stored."""
    return bars.join(watchers.select("rule", "symbol", "tf").distinct(), ["symbol", "tf"])


def forming_candles(bars: DataFrame, base_tf: str, tf: str, late: str = "10 minutes") -> DataFrame:
    """The higher bar of each window as far as its bars have come, and how full it is; for the update output mode."""
    ms = TIMEFRAMES[tf]
    at = bars.withColumn("__at", F.timestamp_millis("t")).withWatermark("__at", late)
    out = at.groupBy(F.window("__at", f"{ms // 1000} seconds"), "symbol").agg(
        F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("v").alias("v"), F.count(F.lit(1)).alias("__n")
    )
    return out.select("symbol", F.lit(tf).alias("tf"), F.unix_millis("window.start").alias("t"), "o", "h", "l", "c", "v", (F.col("__n") * TIMEFRAMES[base_tf] / F.lit(float(ms))).alias("fill"))


def delivery(bars: DataFrame, received: str = "received") -> DataFrame:
    """(source, at, ms): how long after its end each bar arrived; input of ``series.latency_stats``."""
    length = F.create_map(*(F.lit(x) for pair in TIMEFRAMES.items() for x in pair))[F.col("tf")]
    return bars.select(F.col("symbol").alias("source"), F.col(received).alias("at"), (F.col(received) - F.col("t") - length).alias("ms"))
