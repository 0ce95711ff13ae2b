"""Series cut into spans give what whole series give, and the plan of nested smoothing stays short."""

import pytest
from pyspark.sql import functions as F

from barloom.functions.sheet import Sheet, spread
from barloom.operators import indicators as I
from barloom.operators import rules

NAMES = ("sma", "tema", "kama", "heiken_ashi", "aroon", "dpo", "adx", "ichimoku", "stoch_rsi", "tsi", "rwi", "fractal", "uo", "regime", "obv", "connors_rsi")


@pytest.fixture(scope="module")
def long_bars(spark):
    x = spark.range(9_000).selectExpr(
        "'s' symbol", "'H1' tf", "id * 3600000 t", "100 + 10 * sin(id / 50) + 3 * sin(id * 1.7) + (xxhash64(id) % 1000) / 400.0 c", "(xxhash64(id, 1) % 1000) / 1000.0 u",
        "10 + abs(xxhash64(id, 2) % 1000) / 100.0 v",
    )
    return x.selectExpr("symbol", "tf", "t", "c + u o", "c + 1.5 + abs(u) h", "c - 1.5 - abs(u) l", "c", "v").cache()


@pytest.mark.parametrize("name", NAMES)
def test_spans_change_nothing(long_bars, name):
    whole, cut = (I.with_indicator(long_bars, name, rows=rows) for rows in (None, 512))
    out = [(c, k) for c, k in whole.dtypes if c not in long_bars.columns]
    both = whole.select("t", *(F.col(c).alias(f"a_{c}") for c, _ in out)).join(cut.select("t", *(F.col(c).alias(f"b_{c}") for c, _ in out)), "t", "full")
    equal = lambda c, k: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col(f"a_{c}"))) if k == "double" else F.lit(False)
    differ = [F.count_if(~(F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) | F.coalesce(equal(c, k), F.lit(False)))).alias(c) for c, k in out if not k.startswith("struct")]
    got = both.agg(F.count(F.lit(1)).alias("rows"), *differ).first().asDict()
    assert got.pop("rows") == 9_000 and not any(got.values()), got


@pytest.mark.parametrize("name", ("hma_crossover", "dmi_adx", "stochastic_crossover"))
def test_rules_in_spans(long_bars, name):
    whole, cut = ({tuple(r) for r in rules.signals(long_bars, name, rows=rows).select("t", "direction").collect()} for rows in (None, 512))
    assert whole == cut and whole


def test_rows_before_a_span(spark):
    bars = spark.range(25).selectExpr("'s' symbol", "'H1' tf", "id * 3600000 t", "id c")
    rows = spread(bars, 3, 10).select("__span", "__own", "c").collect()
    at = lambda span, own: sorted(r["c"] for r in rows if (r["__span"], r["__own"]) == (span, own))
    assert at(0, True) == list(range(10)) and at(1, False) == [7, 8, 9] and at(2, True) == list(range(20, 25)) and at(0, False) == []


def test_nulls_in_a_smoothed_column(spark):
    """The state survives a few nulls; after more than it takes to fade, nothing is made up."""
    values = [1.0, 2.0, None, 3.0] + [None] * 100 + [5.0, 6.0]
    df = spark.createDataFrame([("s", "H1", i, x) for i, x in enumerate(values)], "symbol string, tf string, t long, c double")
    s = Sheet(df)
    y = s.smooth((s.c, 0.5, 1), seed="first")[0]
    got = [r["y"] for r in s.done(y=y).orderBy("t").collect()]
    assert got[:5] == [1.0, 1.5, 1.5, 2.25, 2.25] and all(x is None or x == 2.25 for x in got[5:104]) and got[104] in (None, 3.625)


def test_plan_of_nested_smoothing(long_bars):
    plan = I.with_indicator(long_bars, "trix")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") <= 5 and plan.count("Sort [") <= 5


def test_empty_bars(long_bars):
    assert I.with_indicator(long_bars.limit(0), "adx").count() == 0
