"""Trade and equity reports: journal KPIs, breakdowns, performance metrics, windows over trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def trades_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's order lines as closed trades."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    li, o, p = read("lineitem"), read("orders"), read("part")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    a, b = F.col("o_orderdate").cast("timestamp"), F.col("l_shipdate").cast("timestamp")
    pnl = F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_quantity") * F.col("p_retailprice")
    fee = F.col("l_extendedprice") * F.col("l_tax")
    risk = F.col("l_quantity") * F.col("p_retailprice") * 0.1
    seconds = lambda x: F.unix_millis(x) / 1000
    return rows.select(
        F.col("l_suppkey").cast("long").alias("hand"), F.col("p_brand").alias("symbol"), F.when(F.col("l_linestatus") == "O", "long").otherwise("short").alias("side"), F.col("l_returnflag").alias("source"),
        F.unix_millis(F.least(a, b)).alias("entry_at"), F.unix_millis(F.greatest(a, b)).alias("exit_at"), F.col("l_quantity").alias("qty"),
        pnl.alias("pnl"), fee.alias("commission"), (pnl - fee).alias("net_pnl"), risk.alias("planned_risk"), ((pnl - fee) / F.nullif(risk, F.lit(0.0))).alias("r_multiple"),
        F.abs(seconds(a) - seconds(b)).alias("holding_seconds"), F.col("l_orderkey").alias("trade"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )


def _r(x: Column) -> Column:
    return F.round(F.coalesce(x, F.lit(0.0)), 4)


def kpis(trades: DataFrame, *keys: str) -> DataFrame:
    """Counts, sums and means on net profit in one pass; what nothing is known of is 0."""
    win, loss = F.col("net_pnl") > 0, F.col("net_pnl") < 0
    net = F.col("net_pnl")
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses"), _r(F.sum(F.when(win, net))).alias("gross_profit"), _r(F.sum(F.when(loss, net))).alias("gross_loss"),
        _r(F.sum(net)).alias("net"), _r(F.sum("commission")).alias("commission"), _r(F.avg(F.when(win, net))).alias("avg_win"), _r(F.avg(F.when(loss, net))).alias("avg_loss"),
        _r(F.max(net)).alias("largest_win"), _r(F.min(net)).alias("largest_loss"), _r(F.avg("r_multiple")).alias("avg_r"), _r(F.avg("holding_seconds")).alias("avg_holding"),
    )


def equity(trades: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """hand, t (day), equity: initial capital and all net profit up to the day."""
    day = 86_400_000
    daily = trades.groupBy("hand", (F.floor(F.col("exit_at") / day) * day).alias("t")).agg(F.sum("net_pnl").alias("net"))
    return daily.select("hand", "t", (F.sum("net").over(Window.partitionBy("hand").orderBy("t")) + initial).alias("equity"))


def drawdowns(curve: DataFrame) -> DataFrame:
    """hand, t, equity, drawdown in percent below the running peak."""
    peak = F.max("equity").over(Window.partitionBy("hand").orderBy("t"))
    return curve.withColumn("drawdown", (peak - F.col("equity")) / peak * 100)


def performance(curve: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """Per hand: return, volatility, Sharpe, Sortino, drawdown and ulcer figures of its daily equity."""
    w = Window.partitionBy("hand").orderBy("t")
    x = drawdowns(curve).withColumn("ret", F.col("equity") / F.coalesce(F.lag("equity").over(w), F.lit(initial)) - 1)
    day = 86_400_000.0
    years = (F.max("t") - F.min("t")) / F.lit(day * 365.25)
    g = x.groupBy("hand").agg(
        F.max_by("equity", "t").alias("final"), years.alias("years"), F.count(F.lit(1)).alias("days"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("dev"),
        F.sqrt(F.avg(F.pow(F.least("ret", F.lit(0.0)), 2))).alias("down"), F.max("drawdown").alias("max_drawdown"), F.sqrt(F.avg(F.pow("drawdown", 2))).alias("ulcer"),
        F.percentile("ret", F.lit(0.05)).alias("var_95"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"),
        (F.sum(F.greatest("ret", F.lit(0.0))) / F.nullif(-F.sum(F.least("ret", F.lit(0.0))), F.lit(0.0))).alias("omega"),
    )
    year = F.col("days") / F.nullif(F.col("years"), F.lit(0.0))
    small = lambda x: F.coalesce(x, F.lit(0.0)) < 1e-12
    six = lambda x, name: F.round(x, 6).alias(name)
    total = F.col("final") / initial - 1
    return g.select(
        "hand", six(total, "total_return"), six(F.when(F.col("final") > 0, F.pow(F.col("final") / initial, 1 / F.nullif(F.col("years"), F.lit(0.0))) - 1), "cagr"),
        six(F.col("dev") * F.sqrt(year), "volatility"), six(F.when(small(F.col("dev")), 0.0).otherwise(F.col("mean") / F.col("dev") * F.sqrt(year)), "sharpe"),
        six(F.when(small(F.col("down")), F.lit(float("inf"))).otherwise(F.col("mean") / F.col("down") * F.sqrt(year)), "sortino"),
        six(F.col("max_drawdown"), "max_drawdown"), six(F.col("ulcer"), "ulcer"), six(F.col("var_95"), "var_95"), six(F.col("skew"), "skew"), six(F.col("kurt"), "kurt"), six(F.coalesce(F.col("omega"), F.lit(float("inf"))), "omega"),
    )


def risk_metrics(curve: DataFrame, initial: float = 100_000.0) -> DataFrame:
    """Per hand: mean depth of points under water, longest run of points below the peak, Calmar, recovery factor, serenity, value at
    risk and the mean beyond it (positive, 5 %), tail ratio. Ratios without a drawdown are 0."""
    w = Window.partitionBy("hand").orderBy("t")
    row, depth = F.row_number().over(w), F.col("drawdown") / 100
    x = drawdowns(curve).withColumns({"ret": F.col("equity") / F.coalesce(F.lag("equity").over(w), F.lit(initial)) - 1, "i": row})
    x = x.withColumn("under", F.col("i") - F.max(F.when(F.col("drawdown") <= 0, F.col("i"))).over(w))
    years = (F.max("t") - F.min("t")) / F.lit(86_400_000.0 * 365.25)
    g = x.groupBy("hand").agg(
        F.max_by("equity", "t").alias("final"), years.alias("years"), F.max(depth).alias("deep"), F.coalesce(F.avg(F.when(depth > 0, depth)), F.lit(0.0)).alias("avg_drawdown"), F.max("under").alias("longest"),
        F.sqrt(F.avg(F.pow("drawdown", 2))).alias("ulcer"), F.percentile("ret", F.lit(0.05)).alias("low"), F.percentile("ret", F.lit(0.95)).alias("high"),
    )
    tail = x.join(g.select("hand", "low"), "hand").where("ret <= low").groupBy("hand").agg(F.avg("ret").alias("tail"))
    grown = F.when(F.col("final") > 0, (F.pow(F.col("final") / initial, 1 / F.nullif(F.col("years"), F.lit(0.0))) - 1) * 100)
    per = lambda a, b: F.when(F.abs(b) < 2.3e-16, 0.0).otherwise(a / b)
    loss = lambda name: F.greatest(F.lit(0.0), -F.col(name))
    return g.join(tail, "hand").select(
        "hand", "avg_drawdown", F.col("longest").alias("longest_drawdown"), per(grown, F.col("deep") * 100).alias("calmar"), per(F.col("final") / initial - 1, F.col("deep")).alias("recovery"),
        per(grown, F.col("ulcer")).alias("serenity"), loss("low").alias("var_95"), loss("tail").alias("cvar_95"), per(F.abs("high"), F.abs("low")).alias("tail_ratio"),
    )


def outcomes(trades: DataFrame) -> DataFrame:
    """Per hand: expected net profit of a trade, trades a year, mean holding seconds of winners and of the others."""
    won = F.col("net_pnl") > 0
    span = (F.max("exit_at") - F.min("entry_at")) / F.lit(86_400_000.0 * 365.25)
    g = trades.groupBy("hand").agg(F.avg("net_pnl").alias("expectancy"), F.count(F.lit(1)).alias("n"), span.alias("years"), F.avg(F.when(won, F.col("holding_seconds"))).alias("held_won"), F.avg(F.when(~won, F.col("holding_seconds"))).alias("held_lost"))
    return g.select("hand", "expectancy", F.coalesce(F.col("n") / F.nullif("years", F.lit(0.0)), F.lit(0.0)).alias("trades_per_year"), F.coalesce("held_won", F.lit(0.0)).alias("held_won"), F.coalesce("held_lost", F.lit(0.0)).alias("held_lost"))


def streaks(trades: DataFrame) -> DataFrame:
    """hand, longest_win, longest_loss: runs of trades in order of exit; a trade without profit is a loss."""
    order = Window.partitionBy("hand").orderBy("exit_at", "entry_at", "trade", "line", "part")
    win = (F.col("pnl") > 0).cast("int")
    rows = trades.select("hand", "exit_at", "entry_at", "trade", "line", "part", win.alias("win"))
    rows = rows.withColumn("run", F.row_number().over(order) - F.row_number().over(Window.partitionBy("hand", "win").orderBy("exit_at", "entry_at", "trade", "line", "part")))
    runs = rows.groupBy("hand", "win", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("hand").agg(F.coalesce(F.max(F.when(F.col("win") == 1, F.col("n"))), F.lit(0)).alias("longest_win"), F.coalesce(F.max(F.when(F.col("win") == 0, F.col("n"))), F.lit(0)).alias("longest_loss"))


def recent_closed(trades: DataFrame, n: int) -> DataFrame:
    """The last n trades of each hand."""
    w = Window.partitionBy("hand").orderBy(F.desc("exit_at"), F.desc("trade"), F.desc("line"), F.desc("part"))
    return trades.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("hand", "trade", "line", "part", "exit_at", F.round("net_pnl", 4).alias("net_pnl"), "rn")


def order_projection(events: DataFrame) -> DataFrame:
    """Last state of each order from its events (seq, order_id, kind, at): a fill wins over all, a cancellation over a
    placement; orders that were never placed are left out. One aggregate; the order of arrival doesn't matter."""
    is_ = lambda k: F.col("kind") == k
    g = events.groupBy("order_id").agg(
        F.min(F.when(is_("order_placed"), F.col("at"))).alias("placed_at"), F.max(is_("order_filled")).alias("filled"), F.max(is_("order_cancelled")).alias("cancelled"), F.max("at").alias("last_at")
    )
    return g.where("placed_at IS NOT NULL").select("order_id", "placed_at", "last_at", F.when(F.col("filled"), "filled").when(F.col("cancelled"), "cancelled").otherwise("placed").alias("status"))
