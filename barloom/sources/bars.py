"""Bars and ticks: scans, writers, catalog, pages. Schemas are explicit; null prices become NaN, rows without time go."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: milliseconds of each timeframe; MN is 30 days.
TIMEFRAMES = {
    "M1": 60_000, "M3": 180_000, "M5": 300_000, "M15": 900_000, "M30": 1_800_000, "H1": 3_600_000, "H2": 7_200_000, "H4": 14_400_000,
    "H6": 21_600_000, "H8": 28_800_000, "H12": 43_200_000, "D1": 86_400_000, "W1": 604_800_000, "MN": 2_592_000_000,
}
BAR_SCHEMA = "t long, o double, h double, l double, c double, v double"


def scan_bars(spark: SparkSession, path: str | list[str], start: int | None = None, end: int | None = None, mixed: bool = False) -> DataFrame:
    """Bars of files or directories with start <= t <= end. The schema is fixed, so no footer is read for it; with ``mixed``,
    files where ``v`` is a long or missing are merged. Where files lie by month, only the months of the span are listed."""
    paths = [path] if isinstance(path, str) else path
    df = spark.read.option("mergeSchema", "true").parquet(*paths) if mixed else spark.read.schema(BAR_SCHEMA).parquet(*paths)
    if "month" in df.columns:
        df = df.withColumn("month", F.substring(F.col("month").cast("string"), 1, 7))
        months = [None if t is None else datetime.fromtimestamp(t / 1000, UTC).strftime("%Y-%m") for t in (start, end)]
        df = df if months[0] is None else df.where(F.col("month") >= months[0])
        df = df if months[1] is None else df.where(F.col("month") <= months[1])
    v = F.coalesce(F.col("v").cast("double"), F.lit(0.0)) if "v" in df.columns else F.lit(0.0)
    keep = F.col("t").isNotNull()
    keep = keep if start is None else keep & (F.col("t") >= start)
    keep = keep if end is None else keep & (F.col("t") <= end)
    rest = [c for c in df.columns if c in ("source", "tf", "symbol", "month")]
    return df.where(keep).select(*rest, "t", *(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in "ohlc"), v.alias("v"))


def millis(time: Column) -> Column:
    """Seconds, milliseconds, microseconds, RFC 3339 or a date, as text, to milliseconds."""
    n = time.try_cast("double")
    number = F.when(n > 1e14, n / 1000).when(n < 1e11, n * 1000).otherwise(n).cast("long")
    return F.coalesce(number, F.unix_millis(F.try_to_timestamp(time)))


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; time/timestamp/date/t, o/open and so on; volume may be missing."""
    df = spark.read.csv(path, header=True)
    names = {c.strip().lower(): c for c in df.columns}
    pick = lambda *options: next((F.col(names[x]) for x in options if x in names), None)
    volume = pick("v", "vol", "volume")
    time = pick("t", "time", "timestamp", "date", "datetime")
    prices = [pick(c, full).cast("double").alias(c) for c, full in zip("ohlc", ("open", "high", "low", "close"), strict=True)]
    return df.select(millis(time).alias("t"), *prices, (F.lit(0.0) if volume is None else F.coalesce(volume.cast("double"), F.lit(0.0))).alias("v")).where("t IS NOT NULL")


def scan_kline_csv(spark: SparkSession, path: str) -> DataFrame:
    """An exchange's kline dump: header optional, first six fields, microseconds allowed; lines that aren't bars go."""
    cols = [F.col(f"_c{i}") for i in range(6)]
    df = spark.read.csv(path, schema=", ".join(f"_c{i} string" for i in range(12)))
    return df.select(millis(cols[0].try_cast("long").cast("string")).alias("t"), *(c.try_cast("double").alias(n) for c, n in zip(cols[1:], "ohlcv", strict=True))).where("t IS NOT NULL AND c IS NOT NULL")


def parse_kline_json(frames: DataFrame, column: str = "value") -> DataFrame:
    """Websocket frames, batch or stream: a kline object ``k`` or nine-element arrays in ``data`` with a confirm flag."""
    schema = "k struct<t:long,s:string,i:string,o:string,h:string,l:string,c:string,v:string,x:boolean>, arg struct<channel:string,instId:string>, data array<array<string>>"
    j = frames.select(F.from_json(column, schema).alias("j")).select("j.*")
    one = F.array(F.struct(F.col("k.s").alias("symbol"), F.col("k.i").alias("tf"), F.col("k.t").alias("t"), *(F.col(f"k.{c}").cast("double").alias(c) for c in "ohlcv"), F.col("k.x").alias("closed")))
    many = F.transform(
        "data",
        lambda a: F.struct(
            F.col("arg.instId").alias("symbol"), F.regexp_replace("arg.channel", "^candle", "").alias("tf"), a[0].cast("long").alias("t"),
            *(a[i].cast("double").alias(c) for i, c in enumerate("ohlcv", 1)), (a[8] == "1").alias("closed"),
        ),
    )
    return j.select(F.explode(F.when(F.col("k").isNotNull(), one).otherwise(many)).alias("b")).select("b.*").withColumn("symbol", symbol_normalised(F.col("symbol")))


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by tf, symbol and month; only the partitions of these bars are replaced. One task writes one partition's file, in order."""
    rows = bars.withColumn("month", F.date_format(F.timestamp_millis("t"), "yyyy-MM")).repartition("tf", "symbol", "month").sortWithinPartitions("tf", "symbol", "month", "t")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tf", "symbol", "month").parquet(path)


def latest_month(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol", "tf").agg(F.max(F.date_format(F.timestamp_millis("t"), "yyyy-MM")).alias("month"))


def data_catalog(bars: DataFrame) -> DataFrame:
    """Files and rows per (symbol, tf)."""
    return bars.groupBy("symbol", "tf").agg(F.countDistinct(F.col("_metadata.file_path")).alias("files"), F.count(F.lit(1)).alias("rows"))


def symbol_normalised(symbol: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(symbol, "^[^:]*:", ""), "-", ""))


def bars_before(bars: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The newest ``limit`` bars before a cursor, ascending."""
    return bars.where(F.col("t") < cursor).orderBy(F.desc("t"), "symbol").limit(limit).orderBy("t", "symbol")


def bars_after(bars: DataFrame, cursor: int, limit: int) -> DataFrame:
    return bars.where(F.col("t") > cursor).orderBy("t", "symbol").limit(limit)


def bars_range(bars: DataFrame, start: int, end: int) -> DataFrame:
    return bars.where((F.col("t") >= start) & (F.col("t") < end)).orderBy("symbol", "t")


def market_hours(bars: DataFrame, source: str | None) -> DataFrame:
    """Keeps bars that open in the source's session; an unknown source keeps all."""
    sessions = {"NYSE": ("America/New_York", ((570, 960),)), "HOSE": ("Asia/Ho_Chi_Minh", ((540, 690), (780, 885)))}
    if (source or "").upper() not in sessions:
        return bars
    zone, spans = sessions[source.upper()]
    local = F.from_utc_timestamp(F.timestamp_millis("t"), zone)
    minute = F.hour(local) * 60 + F.minute(local)
    inside = F.lit(False)
    for a, b in spans:
        inside = inside | ((minute >= a) & (minute < b))
    return bars.where(inside)


def ticks_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's ``events`` as ticks: symbol, t, event_id, price, volume."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("symbol"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), "event_id", F.col("value").alias("price"), F.lit(1.0).alias("volume"))
