"""Journals from streams: rows written exactly once, orders as they stand, sessions with late rows.

A journal folder holds rows by span of time and attempt, and one small marker per committed batch that names its attempt. Rows of
an attempt without a marker don't exist for readers, so a batch that crashed and runs again adds its rows once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
_OWN = ("__span", "__attempt")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty table where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """query, batch, attempt of each batch that ended."""
    return _read(spark, f"{path}/done", "attempt string, query string, batch long")


def journal_rows(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None) -> DataFrame:
    """The rows of all committed batches. Two queries that write one journal at the same time may both add a key; with ``keys``, the
    row of the first query by name stays."""
    rows = _read(spark, f"{path}/rows", f"{schema}, __span long, __attempt string")
    done = committed(spark, path).select(F.col("attempt").alias("__attempt"), F.col("query").alias("__query"))
    out = rows.join(F.broadcast(done), "__attempt")  # one narrow row a batch, and partitions of other attempts are pruned
    if keys:
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("__query", "__attempt"))).where("__n = 1").drop("__n")
    return out.drop(*_OWN, "__query")


def exactly_once(path: str, keys: list[str], time: str, query: str, span: int = DAY) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of the query called ``query``: each key once, however often a batch is tried.

    A batch that is committed is left alone. Keys are looked up in the spans of ``time`` (milliseconds, a key's time never
    changes) between the batch's first and last only, so the partitions of other spans aren't read."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if committed(spark, path).where((F.col("query") == query) & (F.col("batch") == number)).take(1):
            return
        schema = ", ".join(f"`{c}` {k}" for c, k in batch.dtypes)
        new = batch.dropDuplicates(keys).withColumn("__span", F.floor(F.col(time) / span))
        first, last = new.agg(F.min("__span"), F.max("__span")).first()
        attempt = uuid.uuid4().hex
        if first is not None:
            new.join(held_keys(spark, path, schema, keys, first, last), keys, "left_anti").withColumn("__attempt", F.lit(attempt)).write.mode("append").partitionBy(*_OWN).parquet(f"{path}/rows")
        marked(spark, path, query, number, attempt)

    return write


def held_keys(spark: SparkSession, path: str, schema: str, keys: list[str], first: int, last: int) -> DataFrame:
    """Keys of committed rows in the spans from ``first`` to ``last``."""
    rows = _read(spark, f"{path}/rows", f"{schema}, __span long, __attempt string").where(F.col("__span").between(first, last))
    return rows.join(F.broadcast(committed(spark, path).select(F.col("attempt").alias("__attempt"))), "__attempt").select(*keys)


def marked(spark: SparkSession, path: str, query: str, number: int, attempt: str) -> None:
    """The commit: one row in a folder of its own, which a reader sees whole or not at all."""
    spark.createDataFrame([(attempt,)], "attempt string").coalesce(1).write.mode("overwrite").parquet(f"{path}/done/query={query}/batch={number}")


_ORDER = "order_id long, placed_at long, last_at long, status string, version long"


class _Orders(StatefulProcessor):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # An order that hears nothing for so long is forgotten; each event starts the time anew.
        self.held = handle.getValueState("order", "placed_at long, last_at long, rank int, version long", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        placed, last, rank, version = self.held.get() if self.held.exists() else (None, None, 0, 0)
        ranks = {"order_placed": 0, "order_cancelled": 1, "order_filled": 2}
        for part in rows:
            for kind, at in part[["kind", "at"]].itertuples(index=False, name=None):
                last = at if last is None else max(last, at)
                rank = max(rank, ranks.get(kind, 0))
                if kind == "order_placed":
                    placed = at if placed is None else min(placed, at)
        self.held.update((None if placed is None else int(placed), int(last), int(rank), int(version) + 1))
        if placed is not None:
            yield pd.DataFrame({"order_id": [key[0]], "placed_at": [int(placed)], "last_at": [int(last)], "status": [("placed", "cancelled", "filled")[rank]], "version": [int(version) + 1]})

    def close(self) -> None:
        pass


def orders_as_they_stand(events: DataFrame, keep_ms: int = 7 * DAY) -> DataFrame:
    """Each order that a batch of events (order_id, kind, at) changes, as it stands: a fill wins over all, a cancellation over a
    placement, in whatever order they arrive; for the update output mode. Orders not placed yet stay silent.

    ``version`` grows with each change, so a consumer keeps the row of the highest one (``latest_orders``). State: four numbers an
    order, dropped when nothing came for ``keep_ms`` of processing time. Needs the RocksDB state store. A time to live makes Spark run
    batches without data for ever: a query that should end when its source does needs
    spark.sql.streaming.noDataMicroBatches.enabled set to false."""
    rows = events.select(F.col("order_id").cast("long"), "kind", F.col("at").cast("long"))
    return rows.groupBy("order_id").transformWithStateInPandas(_Orders(keep_ms), _ORDER, "Update", "ProcessingTime")


def latest_orders(updates: DataFrame) -> DataFrame:
    """The last row of each order: one aggregate with a partial one before its shuffle."""
    last = updates.groupBy("order_id").agg(F.max_by(F.struct("placed_at", "last_at", "status"), "version").alias("x"))
    return last.select("order_id", "x.placed_at", "x.last_at", "x.status")


def sessions(bars: DataFrame, gap_minutes: int = 390, late: str = "1 day") -> DataFrame:
    """symbol, tf, start, t (its last bar's), bars, vwap of each session: bars no more than ``gap_minutes`` apart. Late bars within the
    watermark merge the sessions that they bridge. On a table it gives every session."""
    at = bars.withColumn("__at", F.timestamp_millis("t")).withWatermark("__at", late)
    typical = (F.col("h") + F.col("l") + F.col("c")) / 3 * F.col("v")
    g = at.groupBy(F.session_window("__at", f"{gap_minutes} minutes"), "symbol", "tf").agg(
        F.min("t").alias("start"), F.max("t").alias("t"), F.count(F.lit(1)).alias("bars"), F.sum(typical).alias("pv"), F.sum("v").alias("vv"), F.max_by("c", "t").alias("c")
    )
    return g.select("symbol", "tf", "start", "t", "bars", F.when(F.col("vv") == 0, F.col("c")).otherwise(F.col("pv") / F.nullif("vv", F.lit(0.0))).alias("vwap"))
