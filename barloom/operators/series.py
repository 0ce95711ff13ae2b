"""Windows over bars, orders and returns: returns, correlations, downsampling, rate limits, lineage, ranges in trades."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sheet import numbered

_BY_TIME = ("symbol", "t")
#: Milliseconds of bars that one tile of a correlation matrix multiplies.
TILE_MS = 7 * 86_400_000


def checkpoint_dir(spark) -> str:
    """The folder that driver and executors share, for checkpoints; a local run without one gets a temporary one, a cluster an error."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="barloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def _w(*keys: str, order: str = "t"):
    return Window.partitionBy(*keys).orderBy(order)


def bar_returns(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "t", "c", (F.col("c") / F.lag("c").over(_w("symbol")) - 1).alias("ret"))


def correlations(bars: DataFrame, width: int = 64) -> DataFrame:
    """Pearson correlation of closes of each two symbols at equal times; 1 on the diagonal, 0 without variance.

    Symbols are dealt into blocks of about ``width``; a tile of two blocks and one span of time is a product of two matrices, which
    leaves five sums a pair. So a pair of symbols is one row a tile, not one a time, and a row of bars goes to as many tiles
    as there are blocks."""
    n = bars.agg(F.approx_count_distinct("symbol")).first()[0] or 0
    blocks = max(1, -(-n // width))
    # Sums of squares cancel: closes count from their symbol's first one.
    base = bars.groupBy("symbol").agg(F.min_by("c", "t").alias("base"))
    rows = bars.where("c IS NOT NULL").join(base, "symbol").select("symbol", "t", (F.col("c") - F.col("base")).alias("c"), F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("x"), F.floor(F.col("t") / TILE_MS).alias("span"))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    tiled = rows.withColumn("y", each).select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"), "span", (F.col("x") <= F.col("y")).alias("low"), (F.col("x") >= F.col("y")).alias("high"), "symbol", "t", "c")
    kept = "a string, b string, n double, sa double, sb double, saa double, sbb double, sab double"
    sums = tiled.groupBy("p", "q", "span").applyInPandas(_tile_sums, kept).groupBy("a", "b").agg(*(F.sum(x).alias(x) for x in ("n", "sa", "sb", "saa", "sbb", "sab")))
    va, vb = (F.col(f"s{x}{x}") - F.col(f"s{x}") * F.col(f"s{x}") / F.col("n") for x in "ab")
    r = F.when((va <= 0) | (vb <= 0), 0.0).otherwise((F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(va * vb))
    one = sums.select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0))).alias("r"))
    return one.unionByName(one.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def _tile_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    wide = pdf.pivot_table(index="t", columns="symbol", values="c", aggfunc="first", sort=True)
    names, x = wide.columns.to_numpy(), wide.to_numpy(np.float64)
    seen, x = ~np.isnan(x), np.nan_to_num(x)
    side = pdf.groupby("symbol")[["low", "high"]].first().loc[names]
    i, j = np.flatnonzero(side["low"].to_numpy()), np.flatnonzero(side["high"].to_numpy())
    a, b, sa, sb = x[:, i], x[:, j], seen[:, i].astype(float), seen[:, j].astype(float)
    parts = {"n": sa.T @ sb, "sa": a.T @ sb, "sb": sa.T @ b, "saa": (a * a).T @ sb, "sbb": sa.T @ (b * b), "sab": a.T @ b}
    u, v = np.meshgrid(names[i], names[j], indexing="ij")
    # In a tile of one block with itself every pair is met twice.
    own = bool((side["low"] & side["high"]).all())
    take = (parts["n"] > 0) & ((u <= v) if own else True)
    return pd.DataFrame({"a": u[take], "b": v[take], **{k: m[take] for k, m in parts.items()}})


def rolling_sharpe(bars: DataFrame, n: int = 30, annual: float = 8766.0) -> DataFrame:
    w = _w("symbol").rowsBetween(1 - n, 0)
    x = bar_returns(bars)
    mean, dev, full = F.avg("ret").over(w), F.stddev_samp("ret").over(w), F.count("ret").over(w) == n
    return x.select("symbol", "t", F.when(full & (dev > 1e-12), mean / dev * F.sqrt(F.lit(annual))).otherwise(0.0).alias("sharpe"))


def dedup_flat(bars: DataFrame) -> DataFrame:
    """Both ends of each run of equal closes."""
    w = _w("symbol")
    a, b = F.lag("c").over(w), F.lead("c").over(w)
    return bars.select("symbol", "t", "c", (a.isNull() | b.isNull() | (a != F.col("c")) | (b != F.col("c"))).alias("keep")).where("keep").drop("keep")


def change_only(bars: DataFrame) -> DataFrame:
    """First, changed and last points."""
    w = _w("symbol")
    a, b = F.lag("c").over(w), F.lead("t").over(w)
    return bars.select("symbol", "t", "c", (a.isNull() | b.isNull() | (a != F.col("c"))).alias("keep")).where("keep").drop("keep")


def time_bucket(bars: DataFrame, buckets: int) -> DataFrame:
    """The lowest and highest close of each bucket of equally many rows; ties to the earlier."""
    w = _w("symbol")
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    x = bars.select("symbol", "t", "c", F.floor((F.row_number().over(w) - 1) * buckets / n).alias("bucket"))
    g = x.groupBy("symbol", "bucket").agg(F.min(F.struct("c", "t")).alias("low"), F.max(F.struct(F.col("c"), (-F.col("t")).alias("t"))).alias("high"))
    return g.select("symbol", "bucket", F.col("low.t").alias("low_t"), F.col("low.c").alias("low"), (-F.col("high.t")).alias("high_t"), F.col("high.c").alias("high"))


def order_rate(ticks: DataFrame, seconds: int = 60) -> DataFrame:
    """How many ticks of a symbol fall in the trailing seconds, own included."""
    w = _w("symbol").rangeBetween(-seconds * 1000, 0)
    return ticks.select("symbol", "t", "event_id", F.count(F.lit(1)).over(w).alias("n"))


def latency_stats(samples: DataFrame, last: int = 1000) -> DataFrame:
    """Per source the mean (whole), p50, p95, p99 at index floor(n·p/100) and max of its last samples (source, at, ms)."""
    w = Window.partitionBy("source").orderBy(F.desc("at"), F.desc("ms"))
    g = samples.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last).groupBy("source").agg(F.sort_array(F.collect_list("ms")).alias("x"), F.sum("ms").alias("s"))
    n = F.size("x")
    at = lambda p: F.element_at("x", F.least(n, F.floor(n * p / 100).cast("int") + 1))
    return g.select("source", n.alias("n"), F.floor(F.col("s") / n).alias("mean"), at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"), F.element_at("x", -1).alias("max"))


def _folds(size: Column, train: int, test: int, embargo: int, step: int) -> Column:
    return F.floor((size - (train + embargo + test)) / step) + 1


def walk_forward_splits(bars: DataFrame, train: int = 200, test: int = 50, embargo: int = 5, step: int | None = None, anchored: bool = False) -> DataFrame:
    """Windows over each symbol's bars: fold, times of the first and last training and test bar. Windows move by ``step``
    (``test`` rows if not given); anchored ones train from the first bar on. The four ends of a fold are row numbers, so
    they meet their bars in one equi join."""
    step = step or test
    x = numbered(bars.select("symbol", "t"), ["symbol"], "t", 500 * 86_400_000)
    size = x.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= train + embargo + test)
    folds = size.select("symbol", F.explode(F.sequence(F.lit(0), _folds(F.col("n"), train, test, embargo, step) - 1)).alias("fold"))
    start = F.col("fold") * step
    ends = {"train_from": F.lit(0) if anchored else start, "train_to": start + train - 1, "test_from": start + train + embargo, "test_to": start + train + embargo + test - 1}
    asked = folds.select("symbol", F.col("fold").cast("int").alias("fold"), F.explode(F.array(*(F.struct(F.lit(k).alias("k"), v.cast("long").alias("i")) for k, v in ends.items()))).alias("e")).select("symbol", "fold", "e.k", "e.i")
    met = asked.join(x, ["symbol", "i"])
    return met.groupBy("symbol", "fold").agg(*(F.max(F.when(F.col("k") == k, F.col("t"))).alias(k) for k in ends))


def _in_folds(bars: DataFrame, offset: int, length: int, train: int, test: int, embargo: int, step: int) -> DataFrame:
    """The bars of ``length`` rows from ``offset`` after each fold's start: all columns and fold. A bar's folds follow from its row number."""
    x = numbered(bars, ["symbol"], "t", 500 * 86_400_000)
    size = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("__n"))
    place = F.col("i") - offset
    low, high = F.greatest(F.lit(0), F.ceil((place - length + 1) / step)), F.least(F.floor(place / step), _folds(F.col("__n"), train, test, embargo, step) - 1)
    met = x.join(size, "symbol").where(F.col("__n") >= train + embargo + test).withColumns({"__low": low, "__high": high}).where("__high >= __low")
    return met.select(*bars.columns, F.explode(F.sequence(F.col("__low").cast("int"), F.col("__high").cast("int"))).alias("fold"))


def in_tests(bars: DataFrame, train: int = 200, test: int = 50, embargo: int = 5, step: int | None = None) -> DataFrame:
    """The bars of each fold's test window: all columns and fold."""
    return _in_folds(bars, train + embargo, test, train, test, embargo, step or test)


def in_training(bars: DataFrame, train: int = 200, test: int = 50, embargo: int = 5, step: int | None = None) -> DataFrame:
    """The bars of each fold's training window: all columns and fold."""
    return _in_folds(bars, 0, train, train, test, embargo, step or test)


def fold_sharpe(folds: DataFrame, annual: float = 8766.0) -> DataFrame:
    """symbol, fold, sharpe of holding the close within each fold; 0 without deviation."""
    x = folds.select("symbol", "fold", (F.col("c") / F.nullif(F.lag("c").over(_w("symbol", "fold")), F.lit(0.0)) - 1).alias("ret"))
    dev = F.stddev_samp("ret")
    return x.groupBy("symbol", "fold").agg(F.coalesce(F.when(dev > 1e-12, F.avg("ret") / dev * annual**0.5), F.lit(0.0)).alias("sharpe"))


def walk_forward_efficiency(tests: DataFrame, training: DataFrame) -> DataFrame:
    """Per symbol: folds, mean Sharpe ratio of test and of training windows, percent of tests above 0, and the first mean over
    the second (0 where that is 0)."""
    both = fold_sharpe(tests).join(fold_sharpe(training).withColumnRenamed("sharpe", "trained"), ["symbol", "fold"])
    g = both.groupBy("symbol").agg(F.count(F.lit(1)).alias("folds"), F.avg("sharpe").alias("oos_sharpe"), F.avg("trained").alias("is_sharpe"), (F.avg((F.col("sharpe") > 0).cast("double")) * 100).alias("profitable_pct"))
    return g.withColumn("efficiency", F.when(F.abs("is_sharpe") > 2.220446049250313e-16, F.col("oos_sharpe") / F.col("is_sharpe")).otherwise(0.0))


def excursions(trades: DataFrame, bars: DataFrame, bucket_ms: int = 86_400_000) -> DataFrame:
    """Bars within each trade (trade, symbol, entry_t, exit_t, entry_price) → worst and best move and bars held; the range
    join meets on (symbol, day)."""
    day = lambda x: F.floor(F.col(x) / bucket_ms)
    spread = trades.withColumn("day", F.explode(F.sequence(day("entry_t"), day("exit_t"))))
    met = spread.join(bars.select("symbol", "t", "h", "l", day("t").alias("day")), ["symbol", "day"]).where("t >= entry_t AND t <= exit_t")
    g = met.groupBy("symbol", "entry_t", "exit_t", "entry_price").agg(F.min("l").alias("low"), F.max("h").alias("high"), F.count(F.lit(1)).alias("bars_held"))
    p = F.col("entry_price")
    return g.select("symbol", "entry_t", "exit_t", ((F.col("low") - p) / p).alias("mae"), ((F.col("high") - p) / p).alias("mfe"), "bars_held")


def lineage(strategies: DataFrame) -> DataFrame:
    """id, root, depth: each version's first ancestor, by pointer doubling over (id, previous_id).

    A round joins each open row with its ancestor's row and so doubles how far it looks back: log2 of the longest chain
    rounds. Rows that have met their root leave the rounds. A version that no root reaches (its ancestor is missing or in
    a ring) gives no row; ids are distinct."""
    checkpoint_dir(strategies.sparkSession)
    rows = strategies.where("id IS NOT NULL").select("id", F.coalesce("previous_id", "id").alias("root"), F.when(F.col("previous_id").isNull(), 0).otherwise(1).alias("depth"), F.col("previous_id").isNull().alias("done"))
    rows = rows.checkpoint()
    n = rows.count()
    for _ in range(max(1, n).bit_length() + 1):
        if not rows.where("NOT done").head(1):
            break
        up = rows.select(F.col("id").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"), F.col("done").alias("met"))
        met = rows.where("NOT done").join(up, "root").select("id", F.col("up").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), F.col("met").alias("done"))
        rows = rows.where("done").unionByName(met).checkpoint()
    return rows.where("done").select("id", "root", "depth")


def sized_positions(signals: DataFrame, mode: str, *, cash: float = 100_000.0, share: float = 0.1, amount: float = 1_000.0, qty: float = 1.0, slots: int = 10, risk: float = 0.01, mult: float = 2.0) -> DataFrame:
    """qty of each signal (price, strength, and atr or stop where the mode asks) with its equity column, or ``cash`` without one."""
    money = F.coalesce("equity", F.lit(cash)) if "equity" in signals.columns else F.lit(cash)
    price, strength = F.nullif(F.col("price"), F.lit(0.0)), F.col("strength")
    stop = F.abs(F.col("price") - F.col("stop")) if "stop" in signals.columns else F.lit(None).cast("double")
    atr = F.col("atr") if "atr" in signals.columns else F.lit(None).cast("double")
    modes = {
        "percent_equity": money * share * strength / price, "fixed_usd": F.when(money >= amount, amount / price), "fixed_qty": F.lit(qty),
        "equal_weight": money / slots * strength / price, "fixed_fractional": money * risk / F.nullif(stop, F.lit(0.0)), "atr": money * risk / F.nullif(atr * mult, F.lit(0.0)),
    }
    return signals.withColumn("qty", F.coalesce(modes[mode], F.lit(0.0)))
