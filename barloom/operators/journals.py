"""Journals of signals, orders, books and rule versions: filters, pages, latest rows; small projections over them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import TIMEFRAMES, bars_before, bars_range, scan_bars
from .resample import resample

DAY = 86_400_000


def matching(rows: DataFrame, time: str | None = None, after: int | None = None, before: int | None = None, **equal) -> DataFrame:
    """Rows whose columns equal the given values (None asks nothing) and whose time lies in [after, before)."""
    for name, value in equal.items():
        rows = rows if value is None else rows.where(F.col(name) == value)
    rows = rows if after is None else rows.where(F.col(time) >= after)
    return rows if before is None else rows.where(F.col(time) < before)


def period(preset: str, now: int) -> tuple[int, int]:
    """[after, before) in milliseconds of 24h, 7d, 30d, mtd or ytd at ``now``."""
    days = {"24h": 1, "7d": 7, "30d": 30}
    if preset in days:
        return now - days[preset] * DAY, now
    at = datetime.fromtimestamp(now / 1000, UTC).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    start = at if preset == "mtd" else at.replace(month=1)
    return int(start.timestamp() * 1000), now


def page(rows: DataFrame, order: list[str], limit: int, before: int | None = None) -> DataFrame:
    """The newest ``limit`` rows below a cursor on the first of ``order``, newest first, and whether there are more. One row more
    than asked decides that; only these rows meet in one task."""
    asked = rows if before is None else rows.where(F.col(order[0]) < before)
    down = [F.desc(c) for c in order]
    some = asked.orderBy(*down).limit(limit + 1).withColumn("place", F.row_number().over(Window.orderBy(*down)))
    return some.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > limit).where(F.col("place") <= limit)


def newest_orders(orders: DataFrame, limit: int) -> DataFrame:
    """Orders by time of placement, newest first, those without one last."""
    return orders.orderBy(F.col("placed_at").desc_nulls_last(), F.desc("order_id")).limit(limit)


def events_from(rows: DataFrame, kind: str, cursor: int, limit: int) -> DataFrame:
    """The first ``limit`` events of a kind from a sequence number on."""
    return rows.where((F.col("seq") >= cursor) & (F.col("kind") == kind)).orderBy("seq").limit(limit)


def last_rows(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The last n rows of each key, newest first as rn."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def exchange_symbols(**symbols: DataFrame) -> DataFrame:
    """Symbols of several exchanges as EXCHANGE:SYMBOL, without repeats."""
    out = None
    for exchange, df in symbols.items():
        own = df.select(F.concat(F.lit(f"{exchange}:"), F.upper("symbol")).alias("symbol"))
        out = own if out is None else out.union(own)
    return out.distinct()


def with_timeframes(symbols: DataFrame) -> DataFrame:
    """One row per symbol and timeframe of ``symbols(symbol, tfs)``; null timeframes mean all."""
    return symbols.select("symbol", F.explode(F.coalesce("tfs", F.array(*(F.lit(tf) for tf in TIMEFRAMES)))).alias("tf"))


def fresh(signals: DataFrame, generated: str, received: str, ttl: int = 0) -> DataFrame:
    """Signals received within ``ttl`` milliseconds of their making; 0 means ten seconds, less keeps all."""
    return signals if ttl < 0 else signals.where(F.col(received) - F.col(generated) <= (ttl or 10_000))


def level(price: Column, side: Column, value: Column, offset: Column, target: bool) -> Column:
    """A target or stop as a price: offsets go with the side for targets, against it for stops."""
    ahead = (side == "long") if target else (side != "long")
    return F.when(offset, F.when(ahead, price + value).otherwise(price - value)).otherwise(value)


def bars_per_year(tf: str) -> float:
    return 365.25 * DAY / TIMEFRAMES[tf]


def spec_hash(spec: Column) -> Column:
    """SHA-256 of a rule's settings (a struct or map) written as JSON: equal settings have equal hashes."""
    return F.sha2(F.to_json(spec), 256)


def warmed(bars: DataFrame, tf: str, start: int, period: int, run: Callable[[DataFrame], DataFrame], recursive: bool = False) -> DataFrame:
    """``run`` over the bars from ``start`` on and enough before it: the longest period, two and a half times that for recursive
    indicators, 5 000 bars at most; what it gives before ``start`` is cut off."""
    rows = min(5000, -(-period * 5 // 2) if recursive else period)
    return run(bars.where(F.col("t") >= start - rows * TIMEFRAMES[tf])).where(F.col("t") >= start)


def catalog(spark, root: str) -> DataFrame:
    """source, tf, symbol, path, first and last day of every Parquet file under ``root``/source/tf/symbol; days from a month, a day or a
    range in the file's name, null without. Folders ending in _eod are left out; names are compared in upper case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")
    part = F.split("path", "/")
    name, folder = F.element_at(part, -1), lambda k: F.element_at(part, -k)
    days = F.regexp_extract_all(name, F.lit(r"\d{4}-\d{2}(?:-\d{2})?"), F.lit(0))
    start = lambda d: F.try_to_timestamp(F.when(F.length(d) == 7, F.concat(d, F.lit("-01"))).otherwise(d), F.lit("yyyy-MM-dd")).cast("date")
    last = F.get(days, F.size(days) - 1)
    end = F.when(F.length(last) == 7, F.last_day(start(last))).otherwise(start(last))
    out = files.select(folder(4).alias("source"), F.upper(folder(3)).alias("tf"), F.upper(folder(2)).alias("symbol"), "path", start(F.get(days, 0)).alias("first"), end.alias("last"))
    return out.where(~F.lower("source").endswith("_eod") & ~F.lower("symbol").endswith("_eod"))


def pruned(files: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Files whose days, a day wider on both sides, meet the span; files without days stay."""
    day = lambda ms: F.timestamp_millis(F.lit(ms)).cast("date")
    files = files if start is None else files.where(F.col("last").isNull() | (F.date_add("last", 1) >= day(start)))
    return files if end is None else files.where(F.col("first").isNull() | (F.date_sub("first", 1) <= day(end)))


def resolved(files: DataFrame, symbol: str, tf: str, sources: list[str]) -> DataFrame:
    """The files of the first source that holds the symbol: of the timeframe itself, else of the finest one below it (to resample)."""
    ms = F.create_map(*(x for k, v in TIMEFRAMES.items() for x in (F.lit(k), F.lit(v))))
    place = F.array_position(F.array(*(F.lit(s.lower()) for s in sources)), F.lower("source"))
    held = files.where((F.col("symbol") == symbol.upper()) & (place > 0)).withColumns({"place": place, "ms": ms[F.col("tf")]}).where(F.col("ms") <= TIMEFRAMES[tf])
    best = held.groupBy("place").agg(F.max("ms").alias("most"), F.min("ms").alias("least")).orderBy("place").limit(1)
    chosen = best.select("place", F.when(F.col("most") == TIMEFRAMES[tf], F.col("most")).otherwise(F.col("least")).alias("ms"))
    return held.join(F.broadcast(chosen), ["place", "ms"], "left_semi").drop("place", "ms")


#: Fixed: the resolutions of a report; an empty or unknown one is a minute.
RESOLUTIONS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}


def by_resolution(rows: DataFrame, time: str, resolution: str, *keys: str, **sums: str) -> DataFrame:
    """Journal rows counted, and columns summed (name=column), per ``keys`` and bucket of a resolution."""
    ms = RESOLUTIONS.get(resolution, RESOLUTIONS["1m"])
    return rows.groupBy(*keys, (F.floor(F.col(time) / ms) * ms).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))


def load_resolved(spark, files: DataFrame, symbol: str, tf: str, sources: list[str], start: int | None = None, end: int | None = None) -> DataFrame:
    """symbol, tf and the bars of what ``resolved`` finds, brought up to ``tf`` where only a finer timeframe is held; no rows where
    no source has the symbol. Files outside the span aren't opened; their names, one per file, pass the driver."""
    chosen = pruned(resolved(files, symbol, tf, sources), start, end).select("path", "tf").collect()
    if not chosen:
        return spark.createDataFrame([], "symbol string, tf string, t long, o double, h double, l double, c double, v double")
    # A finer bar belongs to a bucket that may begin before the span and end after it.
    ms = TIMEFRAMES[tf]
    low, high = None if start is None else start // ms * ms, None if end is None else end // ms * ms + ms - 1
    bars = scan_bars(spark, [r["path"] for r in chosen], low, high).select(F.lit(symbol.upper()).alias("symbol"), F.lit(chosen[0]["tf"]).alias("tf"), "t", "o", "h", "l", "c", "v")
    bars = bars if chosen[0]["tf"] == tf else resample(bars, tf)
    keep = F.lit(True) if start is None else F.col("t") >= start
    return bars.where(keep if end is None else keep & (F.col("t") <= end))


def held_before(spark, files: DataFrame, symbol: str, tf: str, sources: list[str], cursor: int, limit: int) -> DataFrame:
    """The newest ``limit`` bars before a cursor, ascending, from whatever timeframe is held (see ``load_resolved``)."""
    return bars_before(load_resolved(spark, files, symbol, tf, sources, None, cursor), cursor, limit)


def held_range(spark, files: DataFrame, symbol: str, tf: str, sources: list[str], start: int, end: int) -> DataFrame:
    """Bars with start <= t < end from whatever timeframe is held."""
    return bars_range(load_resolved(spark, files, symbol, tf, sources, start, end), start, end)
