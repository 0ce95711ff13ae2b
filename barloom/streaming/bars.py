"""Streams of ticks and bars: tumbling bars, repeats, late bars, journals written once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_bars(ticks: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    """Ticks (symbol, ts, event_id, price, volume) to bars by event time; ticks later than ``late`` are dropped."""
    order = F.struct("ts", "event_id")
    out = ticks.withWatermark("ts", late).groupBy(F.window("ts", size), "symbol").agg(
        F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.sum("volume").alias("v")
    )
    return out.select("symbol", F.unix_millis("window.start").alias("t"), "o", "h", "l", "c", "v")


def once(rows: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """Repeats of a key within the watermark are dropped."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def journal(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows whose key the journal holds already are ignored, so a repeated batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(*keys), keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(path)

    return write


def in_order(bars: DataFrame) -> DataFrame:
    """Drops every bar whose t isn't above the last one of its (symbol, tf); the last t is the stream's state."""
    names = bars.columns

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in parts:
            keep = []
            for t in pdf["t"]:
                keep.append(last is None or t > last)
                last = t if keep[-1] else last
            yield pdf[keep][names]
        if last is not None:
            state.update((int(last),))

    schema = ", ".join(f"{c} {k}" for c, k in bars.dtypes)
    return bars.groupBy("symbol", "tf").applyInPandasWithState(step, schema, "last long", "append", "NoTimeout")
