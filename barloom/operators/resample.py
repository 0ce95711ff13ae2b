"""Resampling, timeframe detection, gaps, as-of and forming-bar joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import TIMEFRAMES, write_bars


def bars_from_ticks(ticks: DataFrame, tf: str) -> DataFrame:
    """Ticks to bars; ties in time are ordered by event_id. Aggregates partially before its one shuffle."""
    ms = TIMEFRAMES[tf]
    order = F.struct("t", "event_id")
    out = ticks.groupBy("symbol", (F.floor(F.col("t") / ms) * ms).alias("bucket")).agg(
        F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.sum("volume").alias("v"), F.count(F.lit(1)).alias("n")
    )
    return out.select("symbol", F.lit(tf).alias("tf"), F.col("bucket").alias("t"), "o", "h", "l", "c", "v", "n")


def resample(bars: DataFrame, tf: str, label: str = "start") -> DataFrame:
    """Bars to a higher timeframe; label "start" is the bucket's start, "first" the time of its first bar."""
    ms = TIMEFRAMES[tf]
    out = bars.groupBy("symbol", (F.floor(F.col("t") / ms) * ms).alias("bucket")).agg(
        F.min("t").alias("first"), F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("v").alias("v")
    )
    return out.select("symbol", F.lit(tf).alias("tf"), F.col("bucket" if label == "start" else "first").alias("t"), "o", "h", "l", "c", "v")


def ladder(bars: DataFrame, tfs: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [resample(bars, tf) for tf in tfs])


def write_ladder(bars: DataFrame, tfs: list[str], path: str) -> None:
    """The bars in every timeframe as files by tf, symbol and month; only the partitions of these bars are replaced."""
    write_bars(ladder(bars, tfs), path)


def detect_timeframe(bars: DataFrame) -> DataFrame:
    """symbol, tf: the timeframe nearest to the gap at index floor(0.1·n) of the sorted positive gaps; fewer than two rows give M1.

    Gaps are counted by value first, so the index is found in a running count over distinct gaps."""
    w = Window.partitionBy("symbol").orderBy("t")
    gaps = bars.select("symbol", (F.col("t") - F.lag("t").over(w)).alias("gap"))
    counts = gaps.where("gap > 0").groupBy("symbol", "gap").count()
    up = Window.partitionBy("symbol").orderBy("gap")
    run = counts.select("symbol", "gap", F.sum("count").over(up).alias("upto"), F.sum("count").over(Window.partitionBy("symbol")).alias("n"))
    chosen = run.where(F.col("upto") > F.floor(F.col("n") * 0.1)).groupBy("symbol").agg(F.min("gap").alias("gap"))
    near = F.array_min(F.array(*(F.struct(F.abs(F.col("gap") - ms).alias("d"), F.lit(ms).alias("ms"), F.lit(tf).alias("tf")) for tf, ms in TIMEFRAMES.items())))["tf"]
    return bars.select("symbol").distinct().join(chosen.select("symbol", near.alias("tf")), "symbol", "left").select("symbol", F.coalesce("tf", F.lit("M1")).alias("tf"))


def gaps(bars: DataFrame, tf: str) -> DataFrame:
    """Neighbouring bars more than two intervals apart: symbol, after, before, missing."""
    ms = TIMEFRAMES[tf]
    w = Window.partitionBy("symbol").orderBy("t")
    pairs = bars.select("symbol", F.lag("t").over(w).alias("after"), F.col("t").alias("before"))
    return pairs.where(F.col("before") - F.col("after") > 2 * ms).withColumn("missing", (F.col("before") - F.col("after")).cast("long") / ms - 1).withColumn("missing", F.col("missing").cast("long"))


def filled(df: DataFrame, value: str, at: str, order: list[str], keys: list[str], span: int) -> DataFrame:
    """``df`` with each null of ``value`` replaced by the last one before it within ``keys``, in time order.

    Rows are dealt by key and bucket of ``span`` milliseconds, so a long series is many tasks; one row a bucket carries what
    the buckets before end with."""
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__bucket", F.floor(F.col(at) / span))
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys, "__bucket").agg(F.max_by(value, F.struct(*order)).alias("__end"))
    buckets = df.select(*keys, "__bucket").distinct().join(ends, [*keys, "__bucket"], "left")
    before = F.last("__end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    carry = buckets.select(*keys, "__bucket", before.alias("__carry"))
    seen = df.withColumn(value, F.last(value, ignorenulls=True).over(inside))
    return seen.join(carry, [*keys, "__bucket"], "left").withColumn(value, F.coalesce(value, "__carry")).drop("__bucket", "__carry")


def as_of(base: DataFrame, high: DataFrame, base_tf: str, high_tf: str, columns: list[str], prefix: str = "htf_", buckets: int = 512) -> DataFrame:
    """Each base bar with the latest higher bar that closed by its own close; the series is cut into spans of ``buckets`` higher bars."""
    a = base.withColumns({"__at": F.col("t") + TIMEFRAMES[base_tf], "__side": F.lit(1), "__r": F.lit(None).cast(high.select(F.struct(*columns)).schema[0].dataType)})
    b = high.select("symbol", (F.col("t") + TIMEFRAMES[high_tf]).alias("__at"), F.lit(0).alias("__side"), F.struct(*columns).alias("__r"))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = filled(both, "__r", "__at", ["__at", "__side"], ["symbol"], buckets * TIMEFRAMES[high_tf]).where("__side = 1")
    return seen.select(*base.columns, *(F.col(f"__r.{c}").alias(prefix + c) for c in columns))


def forming_bar(base: DataFrame, base_tf: str, high_tf: str) -> DataFrame:
    """Each base bar with the part of its higher bar so far, and how full that is."""
    ms = TIMEFRAMES[high_tf]
    bucket = F.floor(F.col("t") / ms) * ms
    w = Window.partitionBy("symbol", "bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumn("bucket", bucket)
    return rows.select(
        *base.columns, "bucket", F.first("o").over(w).alias("live_o"), F.max("h").over(w).alias("live_h"), F.min("l").over(w).alias("live_l"), F.col("c").alias("live_c"),
        F.sum("v").over(w).alias("live_v"), (F.count(F.lit(1)).over(w) * TIMEFRAMES[base_tf] / F.lit(float(ms))).alias("fill"),
    )
