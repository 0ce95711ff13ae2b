"""Candlestick patterns on hand-made bars."""

from barloom.operators import patterns

SCHEMA = "symbol string, tf string, t long, o double, h double, l double, c double, v double"


def last(spark, *bars):
    rows = [("a", "H1", i, *map(float, b), 1.0) for i, b in enumerate(bars)]
    return max(patterns.candlesticks(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r["t"])


def test_single_bars(spark):
    assert last(spark, (5, 6, 4, 5.05))["doji"] and last(spark, (5, 5, 5, 5))["doji"]
    assert last(spark, (5, 9, 5, 9))["marubozu_bull"] and last(spark, (9, 9, 5, 5))["marubozu_bear"]
    falling = [(20 - i, 20.5 - i, 18.5 - i, 19 - i) for i in range(5)]
    assert last(spark, *falling, (10, 10.4, 7, 10.3))["hammer"]
    assert last(spark, *[(1, 2, 1, 2)] * 5, (10, 10.4, 7, 10.3))["hanging_man"]


def test_several_bars(spark):
    assert last(spark, (9, 9.2, 7.8, 8), (7.9, 9.6, 7.8, 9.5))["engulfing_bull"]
    assert last(spark, (8, 9.2, 7.8, 9), (9.1, 9.2, 7, 7.5))["engulfing_bear"]
    up = [(1, 3.1, 0.9, 3), (2, 4.1, 1.9, 4), (3, 5.1, 2.9, 5)]
    assert last(spark, *up)["three_white_soldiers"] and not last(spark, *up)["three_black_crows"]
    down = [(5, 5.1, 2.9, 3), (4, 4.1, 1.9, 2), (3, 3.1, 0.9, 1)]
    assert last(spark, *down)["three_black_crows"]
    assert last(spark, (5, 8.1, 4.9, 8), (8.1, 8.6, 8, 8.2), (8, 8.1, 5.9, 6))["evening_star"]
    calm = [(10, 11.2, 9.8, 11)] * 8
    assert last(spark, *calm, (11, 11.1, 7.9, 8), (7.5, 7.7, 7.2, 7.6), (7.8, 10.6, 7.7, 10.5))["morning_star"]
