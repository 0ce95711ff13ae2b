"""What users bring along: rules, parameter sets, regimes and detectors over a sheet, and indicators by configuration.

A user's function takes a ``Sheet`` and returns Columns, so it stays in the plan like the built-in rules and works in
spans of a series wherever it reads only so many rows back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sheet import SPAN, Sheet, sheet_for
from .indicators import COLUMNS, with_indicator
from .rules import emitted

#: (entry, exit) or (entry, exit, strength) of each bar.
Rule = Callable[..., tuple]


def custom_signals(bars: DataFrame, name: str, rule: Rule, rows: int | None = SPAN) -> DataFrame:
    """Signals of a user's rule, like ``rules.signals``: null conditions are false, entries come first, one signal a bar."""
    s = sheet_for(bars, rule, rows)
    return emitted(s, name, *rule(s))


def signals_by_set(bars: DataFrame, name: str, rule: Rule, sets: dict[str, dict], rows: int | None = SPAN) -> DataFrame:
    """A rule's signals under each of several parameter sets, with the set's name as ``parameters``. All sets fill one sheet:
    bars are dealt and sorted once, however many there are."""
    every = lambda s: [(k, [s.put(F.coalesce(x, F.lit(False))) for x in rule(s, **p)[:2]]) for k, p in sets.items()]
    s = sheet_for(bars, every, rows)
    marks = [F.when(a | b, F.struct(F.lit(k).alias("parameters"), F.when(a, "long").otherwise("exit").alias("direction"))) for k, (a, b) in every(s)]
    found = s.kept().select("symbol", "tf", "t", F.explode(F.array_compact(F.array(*marks))).alias("x"))
    return found.select("symbol", "tf", "t", F.lit(name).alias("rule"), "x.parameters", "x.direction")


def custom_regime(bars: DataFrame, regime: Callable[[Sheet], tuple[Column, Column, Column, Column]], rows: int | None = SPAN) -> DataFrame:
    """The bars with ``trend`` and ``volatility`` (value, status) from a user's (trend, its label, volatility, its label)."""
    s = sheet_for(bars, regime, rows)
    a, a_is, b, b_is = regime(s)
    both = lambda x, label: F.struct(x.cast("double").alias("value"), label.alias("status"))
    return s.done(trend=both(a, a_is), volatility=both(b, b_is))


def detected(bars: DataFrame, detectors: dict[str, tuple[int, Callable[[Sheet], tuple[Column, Column]]]], rows: int | None = SPAN) -> DataFrame:
    """What several detectors find: detector, confidence (0 to 1). Each is (bars it looks back on, f) with f giving (found,
    confidence); it is silent until a series has that many bars. One row a detector and bar."""
    def every(s: Sheet) -> list:
        row = s.row()
        s.reach += max((n for n, _ in detectors.values()), default=0)
        return [(k, (row >= n) & found, sure) for k, (n, f) in detectors.items() for found, sure in [f(s)]]

    s = sheet_for(bars, every, rows)
    marks = [F.when(found, F.struct(F.lit(k).alias("detector"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), sure)).alias("confidence"))) for k, found, sure in every(s)]
    return s.kept().select("symbol", "tf", "t", F.explode(F.array_compact(F.array(*marks))).alias("x")).select("symbol", "tf", "t", "x.*")


def with_indicators(bars: DataFrame, specs: list[dict], rows: int | None = SPAN) -> DataFrame:
    """The bars with the outputs of each {type, as, …parameters}; outputs are called as_output, ``as`` is the type if not given.

    Indicators that read only so many rows back fill one sheet in spans, those that look at a whole series another one, so
    bars are read, dealt and sorted as often for twenty indicators as for one. Those with a non-linear recurrence fold series."""
    near, whole, folded = [], [], []
    for spec in specs:
        kind, name = spec["type"], spec.get("as", spec["type"])
        parameters = {k: v for k, v in spec.items() if k not in ("type", "as")}
        if kind not in COLUMNS:
            folded.append((kind, name, parameters))
            continue
        dry = Sheet(None)
        COLUMNS[kind](dry, **parameters)
        (whole if dry.whole or not rows else near).append((kind, name, parameters))
    for some, span in ((near, rows), (whole, None)):
        if some:
            every = lambda s, some=some: {f"{name}_{k}": x for kind, name, p in some for k, x in COLUMNS[kind](s, **p).items()}
            s = sheet_for(bars, every, span)
            bars = s.done(**every(s))
    for kind, name, parameters in folded:
        made = with_indicator(bars, kind, **parameters)
        bars = made.withColumnsRenamed({c: f"{name}_{c}" for c in made.columns if c not in bars.columns})
    return bars
