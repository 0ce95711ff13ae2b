"""The engine's registered queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import calls
from ..functions.sheet import Sheet
from ..operators import book, charts, custom, frames, indicators, journals, patterns, resample, risk, rules, series, trades
from ..sources import bars as source
from . import portfolio_queries
from .indicator_sql import crossing_sets_sql, indicator_sql, rule_sql, two_frame_sql, walk_rule_sql
from .report_sql import report_sql

Query = Callable[[SparkSession, str], DataFrame]


def bars(spark: SparkSession, sf_dir: str, tf: str = "H1") -> DataFrame:
    return resample.bars_from_ticks(source.ticks_of_events(spark, sf_dir), tf).drop("n")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def off_ties(df: DataFrame, digits: int, shift: float) -> DataFrame:
    """Rounded after a shift smaller than any digit that matters: products and halves of decimals lie on ties, where the last bit decides."""
    return df.select(*(F.round(F.col(c) + shift, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def _indicator(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = bars(spark, sf_dir)
        out = indicators.with_indicator(b, name)
        return rounded(out.select("symbol", "tf", "t", *(c for c in out.columns if c not in b.columns)))

    return run


def _rule(name: str) -> Query:
    return lambda spark, sf_dir: rounded(rules.signals(bars(spark, sf_dir), name))


def _two_frames(name: str) -> Query:
    return lambda s, d: rounded(frames.two_frame_signals(bars(s, d, "M15"), bars(s, d), name, "M15", "H1"))


BOARD = ("ma_crossover", "donchian_breakout", "highest_breakout", "macd_crossover", "roc", "ao", "stochastic_dk", "dual_momentum", "bb_rsi_reversal", "supertrend", "parabolic_sar", "heiken_ashi_color")


def walk(spark: SparkSession, sf_dir: str, tf: str = "H1") -> DataFrame:
    """Bars of prices with a memory: closes are 500 and a tenth of the ticks' distance from 50, summed up to each bar; a bar opens where the last one closed."""
    b = bars(spark, sf_dir, tf)
    w = Window.partitionBy("symbol", "tf").orderBy("t")
    x = b.select("symbol", "tf", "t", (F.sum((F.col("c") - 50.0) / 10.0).over(w) + 500.0).alias("c"), "v")
    x = x.withColumn("o", F.coalesce(F.lag("c").over(w), F.col("c")))
    return x.select("symbol", "tf", "t", "o", F.greatest("o", "c").alias("h"), F.least("o", "c").alias("l"), "c", "v")


def _order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "view", "order_placed").when(F.col("event_type") == "click", "order_filled").when(F.col("event_type") == "error", "order_cancelled")
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") * 1000 + F.floor(F.col("event_id") / 5)).alias("order_id"), kind.alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at")).where("kind IS NOT NULL")


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.as_of(bars(spark, sf_dir, "H1"), bars(spark, sf_dir, "H4"), "H1", "H4", ["t", "c"]).select("symbol", "t", "c", "htf_t", "htf_c")


QUERIES: dict[str, Query] = {
    "resample": lambda s, d: rounded(resample.bars_from_ticks(source.ticks_of_events(s, d), "H1")),
    "resample_m15": lambda s, d: rounded(resample.bars_from_ticks(source.ticks_of_events(s, d), "M15")),
    "resample_feed": lambda s, d: rounded(resample.resample(bars(s, d, "M15"), "H4", label="first")),
    "ladder": lambda s, d: rounded(resample.ladder(bars(s, d, "M15"), ["H1", "H4", "D1"])),
    "detect_timeframe": lambda s, d: resample.detect_timeframe(bars(s, d, "H4")),
    "gap_detection": lambda s, d: resample.gaps(bars(s, d), "H1"),
    "as_of_join": lambda s, d: rounded(_as_of(s, d)),
    "forming_bar": lambda s, d: rounded(resample.forming_bar(bars(s, d), "H1", "H4")),
    "bars_before": lambda s, d: source.bars_before(bars(s, d), 1_705_000_000_000, 100),
    "bars_after": lambda s, d: source.bars_after(bars(s, d), 1_705_000_000_000, 100),
    "bars_range": lambda s, d: source.bars_range(bars(s, d), 1_705_000_000_000, 1_705_600_000_000),
    "market_hours": lambda s, d: source.market_hours(bars(s, d, "M15"), "NYSE"),
    "latest_month": lambda s, d: source.latest_month(bars(s, d)),
    "candlesticks": lambda s, d: patterns.candlesticks(bars(s, d, "H4")).drop("o", "h", "l", "c", "v"),
    "pivots": lambda s, d: patterns.pivots(bars(s, d)).drop("o", "h", "l", "c", "v"),
    "kpi_total": lambda s, d: trades.kpis(trades.trades_of(s, d)),
    "kpi_by_symbol": lambda s, d: trades.kpis(trades.trades_of(s, d), "symbol"),
    "kpi_by_source": lambda s, d: trades.kpis(trades.trades_of(s, d), "source"),
    "kpi_by_side": lambda s, d: trades.kpis(trades.trades_of(s, d), "side"),
    "hand_totals": lambda s, d: trades.kpis(trades.trades_of(s, d), "hand").select("hand", "trades", "wins", "losses", "net", "commission"),
    "equity_curve": lambda s, d: rounded(trades.equity(trades.trades_of(s, d)), 3),
    "rolling_drawdown": lambda s, d: rounded(trades.drawdowns(trades.equity(trades.trades_of(s, d))), 3),
    "performance": lambda s, d: trades.performance(trades.equity(trades.trades_of(s, d))),
    "streaks": lambda s, d: trades.streaks(trades.trades_of(s, d)),
    "recent_closed_pnl": lambda s, d: trades.recent_closed(trades.trades_of(s, d), 3),
    "order_projection": lambda s, d: trades.order_projection(_order_events(s, d)),
    "leaderboard": lambda s, d: rounded(rules.leaderboard(bars(s, d), BOARD)),
}


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), "o_custkey").distinct()
    return o.select("id", F.lag("id").over(Window.partitionBy("o_custkey").orderBy("id")).alias("previous_id"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.ticks_of_events(spark, sf_dir).select(F.col("symbol").alias("source"), F.col("t").alias("at"), F.floor("price").alias("ms"))


def _sized(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = indicators.with_indicator(bars(spark, sf_dir), "atr")
        x = b.join(rules.signals(bars(spark, sf_dir), "donchian_breakout"), ["symbol", "tf", "t"]).where("direction = 'long'")
        return rounded(series.sized_positions(x.withColumns({"price": F.col("c"), "stop": F.col("c") - F.col("atr")}), mode).select("symbol", "t", "qty"), 4)

    return run


QUERIES |= {
    "bar_returns": lambda s, d: rounded(series.bar_returns(bars(s, d))),
    "correlation_matrix": lambda s, d: rounded(series.correlations(bars(s, d))),
    "rolling_sharpe": lambda s, d: rounded(series.rolling_sharpe(bars(s, d)), 4),
    "dedup_flat": lambda s, d: series.dedup_flat(bars(s, d)),
    "change_only": lambda s, d: series.change_only(bars(s, d)),
    "time_bucket": lambda s, d: series.time_bucket(bars(s, d), 50),
    "order_rate_limit": lambda s, d: series.order_rate(source.ticks_of_events(s, d)),
    "feed_latency_stats": lambda s, d: series.latency_stats(_samples(s, d)),
    "walk_forward_splits": lambda s, d: series.walk_forward_splits(bars(s, d)),
    "bars_in_trade": lambda s, d: rounded(series.excursions(rules.paired(bars(s, d), "donchian_breakout"), bars(s, d))),
    "strategy_lineage": lambda s, d: series.lineage(_strategies(s, d)),
}


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breakouts as entries at their close, with a stop at half and a target at one and a half times it."""
    b = bars(spark, sf_dir)
    at = b.join(rules.signals(b, "donchian_breakout").where("direction = 'long'").select("symbol", "tf", "t"), ["symbol", "tf", "t"])
    return at.select("symbol", "tf", "t", F.lit("long").alias("side"), F.col("c").alias("entry_price"), (F.col("c") * 0.5).alias("stop"), (F.col("c") * 1.5).alias("target"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.barriers(bars(spark, sf_dir), _entries(spark, sf_dir), 24, trailing=0.6)


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.paired(bars(spark, sf_dir), "donchian_breakout")


def _regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = indicators.with_indicator(bars(spark, sf_dir), "regime")
    return x.select("symbol", "tf", "t", F.concat_ws("/", "trend.status", "volatility.status").alias("label"))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("entry_t")
    return _trades(spark, sf_dir).select("symbol", (F.row_number().over(w) - 1).alias("i"), "ret")


def _curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes of each walk-forward test window as curves."""
    return series.in_tests(bars(spark, sf_dir)).select("symbol", "fold", "t", F.col("c").alias("equity"))


def _fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fills of their supplier in five made symbols: returned ones sell, accepted ones buy, others by their number."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = F.when(F.col("l_returnflag") == "R", "sell").when(F.col("l_returnflag") == "A", "buy").when(F.col("l_linenumber") % 2 == 1, "buy").otherwise("sell")
    q = F.col("l_quantity").cast("double")
    return li.where(q > 0).select(
        F.col("l_suppkey").cast("long").alias("hand"), F.concat(F.lit("P"), (F.col("l_partkey") % 5).cast("string")).alias("symbol"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("t"), F.col("l_orderkey").alias("order"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), side.alias("side"), q.alias("qty"), (F.col("l_extendedprice") / q).alias("price"), (F.col("l_extendedprice") * F.col("l_tax")).alias("commission"),
    )


def _rule_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return book.next_open_fills(b, rules.signals(b, "donchian_breakout"))


def _series_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Sheet(bars(spark, sf_dir))
    c, o = s.c, s.o
    return s.done(
        crossed=calls.crossed(s, c, o), cross_above=calls.cross_above(s, c, o), cross_below=calls.cross_below(s, c, o), above=calls.above(c, o), below=calls.below(c, o), rising=calls.rising(s, c), falling_3=calls.falling(s, c, 3),
        in_range=calls.in_range(c, 20.0, 80.0), within=calls.within(c, o, 5.0), flag=calls.flag(c / 100), slope=calls.slope(s, c, 5), momentum=calls.momentum(s, c, 3), pct_change=calls.pct_change(s, c, 2), highest=calls.highest(s, c, 7),
        lowest=calls.lowest(s, c, 7), avg=calls.avg(s, s.lag(c), 6), total=calls.total(s, s.lag(c), 6), stdev=calls.stdev(s, c, 10), zscore=calls.zscore(s, c, 10), running_sum=calls.running_sum(s, c, 4),
    ).drop("o", "h", "l", "c", "v")


def _regime_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = indicators.with_indicator(bars(spark, sf_dir), "regime")
    names = [(k, f) for k in ("trend", "volatility") for f in ("value", "status")]
    return rounded(x.select("symbol", "tf", "t", *(F.col(f"{k}.{f}").alias(f"{k}_{f}") for k, f in names)))


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a position of its customer: its lines open, add and, the last of several, close; returned lines are cancelled."""
    li, o = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("lineitem", "orders"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    k, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))
    x = li.withColumns({"k": k, "n": n}).join(o, F.col("l_orderkey") == F.col("o_orderkey"))  # numbered first: the join needs no other sort
    action = F.when(F.col("k") == 1, "open").when(F.col("k") == F.col("n"), "close").otherwise("add")
    price = F.col("l_extendedprice") / F.nullif("l_quantity", F.lit(0.0))
    done = F.when(F.col("l_returnflag") == "R", "order_cancelled").otherwise("order_filled")
    kinds = F.array(F.lit("order_place"), F.lit("order_placed"), done)
    name = lambda prefix: F.concat(F.lit(prefix), F.col("k").cast("string"))
    rows = x.select(F.col("o_custkey").alias("hand"), F.col("l_orderkey").alias("trade"), "k", action.alias("action"), name("c").alias("client_id"), name("o").alias("order_id"),
                    F.when(F.col("l_linestatus") == "O", "buy").otherwise("sell").alias("side"), price.alias("price"), F.col("l_quantity").cast("double").alias("qty"), F.posexplode(kinds).alias("j", "kind"))
    return risk.replayed(rows.withColumn("seq", F.col("k") * 3 + F.col("j")))


QUERIES |= {
    "exit_barriers": lambda s, d: rounded(_labelled(s, d)),
    "exit_reasons": lambda s, d: risk.exit_reasons(_labelled(s, d), "symbol"),
    "edge_guard": lambda s, d: rounded(risk.edge_guard(trades.trades_of(s, d)), 3),
    "account_guards": lambda s, d: rounded(risk.account_guards(trades.trades_of(s, d)), 3),
    "monthly_returns": lambda s, d: rounded(risk.monthly_returns(trades.equity(trades.trades_of(s, d))), 4),
    "trade_quality": lambda s, d: rounded(risk.trade_quality(trades.trades_of(s, d), "hand")),
    "trade_quality_by_side": lambda s, d: rounded(risk.trade_quality(trades.trades_of(s, d), "side")),
    "buy_and_hold": lambda s, d: rounded(risk.buy_and_hold(walk(s, d)), 4),
    "sharpe_skill": lambda s, d: rounded(risk.skill(series.bar_returns(bars(s, d)), "symbol", trials=20)),
    "sizing_kelly": lambda s, d: rounded(risk.kelly_sized(_trades(s, d))),
    "sizing_capped": lambda s, d: rounded(risk.capped(_sized("fixed_qty")(s, d).join(bars(s, d).select("symbol", "t", F.col("c").alias("price")), ["symbol", "t"]), share=0.001)),
    "regime_breakdown": lambda s, d: rounded(risk.by_regime(_trades(s, d), _regimes(s, d))),
    "regime_changes": lambda s, d: risk.changes(_regimes(s, d)),
    "bootstrap": lambda s, d: rounded(risk.bootstrap(_returns(s, d))),
    "lttb": lambda s, d: risk.lttb(bars(s, d), 100),
    "stitch_oos": lambda s, d: rounded(risk.stitched(_curves(s, d))),
    "beta": lambda s, d: rounded(risk.beta(series.bar_returns(bars(s, d)), 8766.0), 4),
    "diversification": lambda s, d: rounded(risk.diversification(series.bar_returns(bars(s, d)))),
    "turnover": lambda s, d: rounded(risk.turnover(rules.paired(bars(s, d), "donchian_breakout"), bars(s, d))),
    "exposure": lambda s, d: rounded(risk.exposure(trades.trades_of(s, d))),
    "holdings": lambda s, d: rounded(risk.holdings(_positions(s, d)), 4),
    "walk_forward_efficiency": lambda s, d: (lambda b: rounded(series.walk_forward_efficiency(series.in_tests(b), series.in_training(b))).withColumn("efficiency", F.round("efficiency", 4)))(bars(s, d)),
    "walk_forward_summary": lambda s, d: rounded(risk.walk_forward_summary(_curves(s, d))),
    "position_replay": lambda s, d: rounded(_positions(s, d)),
    "event_counts": lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("hand"), F.col("event_type").alias("code")).agg(F.count(F.lit(1)).alias("n")),
}
QUERIES |= {f"sizing_{m}": _sized(m) for m in ("percent_equity", "fixed_usd", "fixed_qty", "equal_weight", "fixed_fractional", "atr")}
QUERIES |= {name: _indicator(name) for name in indicators.INDICATORS}
QUERIES["regime"] = _regime_columns
QUERIES["heiken_ashi"] = lambda s, d: off_ties(indicators.with_indicator(bars(s, d), "heiken_ashi").drop("o", "h", "l", "c", "v"), 6, 1e-9)
QUERIES["mcginley"] = lambda s, d: rounded(indicators.with_indicator(walk(s, d), "mcginley").drop("o", "h", "l", "c", "v"))
QUERIES |= {f"rule_{name}": _rule(name) for name in (*rules.RULES, *rules.FOLDED)}
QUERIES |= {f"rule_{name}": _two_frames(name) for name in frames.BASE}
QUERIES |= {f"rule_{name}": (lambda name: lambda s, d: rounded(rules.signals(walk(s, d), name)))(name) for name in ("tsi", "bb_squeeze", "mean_reversion", "rsi_mean_rev")}
QUERIES |= {
    "series_functions": lambda s, d: rounded(_series_functions(s, d)),
    "next_open_fills": lambda s, d: rounded(_rule_fills(s, d)),
    "fill_trades": lambda s, d: off_ties(book.trades_of_fills(_fills(s, d), ["hand", "symbol"], ["t", "order", "line", "part"]), 3, 1e-7),
    "rule_trades": lambda s, d: rounded(book.trades_of_fills(_rule_fills(s, d), ["rule", "symbol", "tf"], ["t", "side"])),
    "marked_equity": lambda s, d: rounded(book.marked_equity(bars(s, d), _rule_fills(s, d)), 4),
    "signal_pairs": lambda s, d: rounded(rules.paired(bars(s, d), "donchian_breakout")),
    "walk_forward_anchored": lambda s, d: series.walk_forward_splits(bars(s, d), step=40, anchored=True),
}
def _tick_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as signals that arrive a fifth of a second for every unit of price after their making."""
    return source.ticks_of_events(spark, sf_dir).select("symbol", "event_id", F.col("t").alias("generated"), (F.col("t") + F.floor("price") * 200).alias("received"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir).withColumn("side", F.when(F.col("t") % 7_200_000 == 0, "long").otherwise("short"))
    p, side, yes, no = F.col("entry_price"), F.col("side"), F.lit(True), F.lit(False)
    return e.select("symbol", "t", "side", journals.level(p, side, F.lit(5.0), yes, True).alias("target"), journals.level(p, side, F.lit(3.0), yes, False).alias("stop"), journals.level(p, side, F.col("stop"), no, False).alias("fixed_stop"))


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.ticks_of_events(spark, sf_dir).select("symbol").distinct()


_NOW = 1_706_500_000_000
QUERIES |= {
    "signal_page": lambda s, d: journals.page(source.ticks_of_events(s, d).select("t", "event_id", "symbol"), ["t", "event_id"], 50, _NOW),
    "newest_orders": lambda s, d: journals.newest_orders(trades.order_projection(_order_events(s, d)), 40),
    "events_from": lambda s, d: journals.events_from(_order_events(s, d), "order_filled", 100, 60),
    "last_books": lambda s, d: journals.last_rows(source.ticks_of_events(s, d).select("symbol", "t", "event_id", "price"), ["symbol"], ["t", "event_id"], 3),
    "latest_book": lambda s, d: journals.latest(source.ticks_of_events(s, d).select("symbol", "t", "event_id", "price"), ["symbol"], ["t", "event_id"]),
    "latest_versions": lambda s, d: journals.latest(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version")).distinct(), ["name"], ["version"]),
    "exchange_symbols": lambda s, d: journals.exchange_symbols(A=_symbols(s, d), B=_symbols(s, d).where("symbol <> 'view'"), C=_symbols(s, d).union(_symbols(s, d))),
    "symbol_timeframes": lambda s, d: journals.with_timeframes(_symbols(s, d).withColumn("tfs", F.when(F.col("symbol") == "view", F.array(F.lit("H1"), F.lit("D1"))))),
    "fresh_signals": lambda s, d: journals.fresh(_tick_signals(s, d), "generated", "received"),
    "month_to_date": lambda s, d: journals.matching(_tick_signals(s, d), "generated", *journals.period("mtd", _NOW), symbol="click"),
    "last_week": lambda s, d: journals.matching(_tick_signals(s, d), "generated", *journals.period("7d", _NOW)),
    "price_levels": lambda s, d: rounded(_levels(s, d)),
    "warmup_window": lambda s, d: rounded(journals.warmed(bars(s, d), "H1", 1_705_000_000_000, 20, lambda b: indicators.with_indicator(b, "sma")).select("symbol", "tf", "t", "value")),
    "cash_impacts": lambda s, d: rounded(_fills(s, d).groupBy("hand").agg(F.sum(book.cash_impact(F.col("side"), F.col("qty"), F.col("price"), F.col("commission"))).alias("cash")), 2),
    "risk_metrics": lambda s, d: rounded(trades.risk_metrics(trades.equity(trades.trades_of(s, d))), 5),
    "trade_outcomes": lambda s, d: rounded(trades.outcomes(trades.trades_of(s, d)), 4),
    "yearly_returns": lambda s, d: rounded(risk.yearly_returns(risk.monthly_returns(trades.equity(trades.trades_of(s, d)))), 4),
    "excursion_means": lambda s, d: rounded(risk.excursion_means(_labelled(s, d))),
    "rolling_sharpe_std": lambda s, d: rounded(series.rolling_sharpe(bars(s, d)).groupBy("symbol").agg(F.stddev_samp("sharpe").alias("dev"))),
    "row_estimate": lambda s, d: bars(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), (F.count(F.lit(1)) / 500_000.0).alias("seconds")),
}
QUERIES["chart_patterns"] = lambda s, d: rounded(charts.chart_patterns(bars(s, d)))


def _bars_sql(tf: str = "H1", name: str = "bars") -> str:
    ms = source.TIMEFRAMES[tf]
    return f"""{name} AS (
  SELECT event_type AS symbol, '{tf}' AS tf, (epoch_us(ts) // 1000) // {ms} * {ms} AS t, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l,
         arg_max(value, (ts, event_id)) AS c, count(*)::DOUBLE AS v, count(*) AS n
  FROM events GROUP BY ALL)"""


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol, tf ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_BY = "(PARTITION BY symbol, tf ORDER BY t)"


def _full(agg: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER {_frame(n)} = {n} THEN {agg} OVER {_frame(n)} END"


def _of_bars(*columns: str, tf: str = "H1", before: str = "", table: str = "bars") -> str:
    return f"WITH {_bars_sql(tf)}{before} SELECT symbol, tf, t, {', '.join(columns)} FROM {table}"


def _smooth(n: int, alpha: float, name: str, x: str = "c") -> str:
    """A recursive table: the mean of the first n, then y += alpha·(x - y)."""
    return f""", {name}_r AS (SELECT symbol, tf, t, {x} AS x, row_number() OVER {_BY} AS rn, avg({x}) OVER {_frame(n)} AS m FROM bars),
{name} AS (SELECT symbol, tf, t, rn, m AS y FROM {name}_r WHERE rn = {n}
  UNION ALL SELECT r.symbol, r.tf, r.t, r.rn, {alpha!r} * r.x + {1 - alpha!r} * e.y FROM {name} e JOIN {name}_r r ON r.symbol = e.symbol AND r.tf = e.tf AND r.rn = e.rn + 1)"""


def _ema_sql(n: int, alpha: float) -> str:
    return f"WITH RECURSIVE {_bars_sql()}{_smooth(n, alpha, 'e')} SELECT b.symbol, b.tf, b.t, round(y, 6) AS value FROM bars b LEFT JOIN e ON b.symbol = e.symbol AND b.t = e.t"


_TRADES = """trades AS (
  SELECT l_suppkey::BIGINT AS hand, p_brand AS symbol, CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS side, l_returnflag AS source,
         epoch_ms(least(o_orderdate, l_shipdate)::TIMESTAMP) AS entry_at, epoch_ms(greatest(o_orderdate, l_shipdate)::TIMESTAMP) AS exit_at,
         l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice AS pnl, l_extendedprice * l_tax AS commission,
         l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice - l_extendedprice * l_tax AS net_pnl,
         (l_extendedprice * (1 - l_discount) - l_quantity * p_retailprice - l_extendedprice * l_tax) / nullif(l_quantity * p_retailprice * 0.1, 0) AS r_multiple,
         abs(epoch_ms(o_orderdate::TIMESTAMP) - epoch_ms(l_shipdate::TIMESTAMP)) / 1000 AS holding_seconds, l_orderkey AS trade, l_linenumber AS line, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
_EQUITY = """daily AS (SELECT hand, exit_at // 86400000 * 86400000 AS t, sum(net_pnl) AS net FROM trades GROUP BY ALL),
equity AS (SELECT hand, t, sum(net) OVER (PARTITION BY hand ORDER BY t) + 100000 AS equity FROM daily)"""


def _kpi_sql(key: str = "", columns: str = "") -> str:
    r = lambda x, name: f"round(coalesce({x}, 0), 4) AS {name}"
    all_ = ", ".join(
        ["count(*) AS trades", "count(*) FILTER (net_pnl > 0) AS wins", "count(*) FILTER (net_pnl < 0) AS losses", r("sum(net_pnl) FILTER (net_pnl > 0)", "gross_profit"), r("sum(net_pnl) FILTER (net_pnl < 0)", "gross_loss"),
         r("sum(net_pnl)", "net"), r("sum(commission)", "commission"), r("avg(net_pnl) FILTER (net_pnl > 0)", "avg_win"), r("avg(net_pnl) FILTER (net_pnl < 0)", "avg_loss"), r("max(net_pnl)", "largest_win"),
         r("min(net_pnl)", "largest_loss"), r("avg(r_multiple)", "avg_r"), r("avg(holding_seconds)", "avg_holding")]
    )
    inner = f"SELECT {key + ', ' if key else ''}{all_} FROM trades {'GROUP BY ' + key if key else ''}"
    return f"WITH {_TRADES} SELECT {columns or '*'} FROM ({inner})"


_D = "c - lag(c) OVER " + _BY
_TR = f"CASE WHEN lag(c) OVER {_BY} IS NULL THEN h - l ELSE greatest(h - l, abs(h - lag(c) OVER {_BY}), abs(l - lag(c) OVER {_BY})) END"


def _r6(x: str, name: str) -> str:
    return f"round({x}, 6) AS {name}"


def _prior(expr: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY symbol, tf ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) = {n} THEN {expr} OVER (PARTITION BY symbol, tf ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"


def _break_sql(name: str, top: str, bottom: str) -> str:
    return f"""WITH {_bars_sql()}, x AS (SELECT *, {top} AS top, {bottom} AS bottom FROM bars)
SELECT symbol, tf, t, '{name}' AS rule, CASE WHEN c > top THEN 'long' ELSE 'exit' END AS direction, 1.0::DOUBLE AS strength FROM x WHERE c > top OR c < bottom"""


def crossing(s: Sheet, fast: int = 20, slow: int = 50) -> tuple:
    """A user's rule: two EMAs cross."""
    a, b = s.smooth((s.c, 2 / (fast + 1), fast), (s.c, 2 / (slow + 1), slow))
    return rules.crossed_up(s, a, b), rules.crossed_down(s, a, b)


_SETS = [(5, 20), (9, 21), (12, 26), (20, 50)]


def jumps(s: Sheet) -> tuple:
    """A user's detector: a close that moves by over a half."""
    move = s.put(F.abs(calls.pct_change(s, s.c, 1)))
    return move > 0.5, move


def bulges(s: Sheet) -> tuple:
    """Another one: a bar whose range is over twice the mean of the last twenty."""
    size = s.put(s.h - s.l)
    return size > 2 * s.sma(size, 20), F.lit(0.5)


def band_regime(s: Sheet) -> tuple:
    """A user's regime: above or below the mean of fifty closes; wide where they deviate by over 30."""
    m, dev = s.sma(s.c, 50), s.deviation(s.c, 50)
    return m, F.when(s.c > m, "up").when(s.c <= m, "down"), dev, F.when(dev > 30, "wide").when(dev <= 30, "narrow")


def _band_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = custom.custom_regime(bars(spark, sf_dir), band_regime)
    return rounded(x.select("symbol", "tf", "t", F.col("trend.value").alias("trend"), F.col("trend.status").alias("trend_is"), F.col("volatility.value").alias("volatility"), F.col("volatility.status").alias("volatility_is")))


QUERIES |= {
    "rule_sets": lambda s, d: custom.signals_by_set(bars(s, d), "crossing", crossing, {f"{a}/{b}": {"fast": a, "slow": b} for a, b in _SETS}),
    "custom_detectors": lambda s, d: rounded(custom.detected(bars(s, d), {"jump": (5, jumps), "bulge": (20, bulges)})),
    "custom_regime": _band_regime,
    "indicators_by_config": lambda s, d: rounded(custom.with_indicators(bars(s, d), [{"type": "sma", "n": 20, "as": "fast"}, {"type": "sma", "n": 50, "as": "slow"}]).select("symbol", "tf", "t", "fast_value", "slow_value")),
}

ORACLE_SQL: dict[str, str] = {
    "resample": f"WITH {_bars_sql()} SELECT symbol, tf, t, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, v, n FROM bars",
    "resample_m15": f"WITH {_bars_sql('M15')} SELECT symbol, tf, t, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, v, n FROM bars",
    "resample_feed": f"WITH {_bars_sql('M15')} SELECT symbol, 'H4' AS tf, min(t) AS t, round(arg_min(o, t), 6) AS o, round(max(h), 6) AS h, round(min(l), 6) AS l, round(arg_max(c, t), 6) AS c, sum(v) AS v FROM bars GROUP BY symbol, t // 14400000",
    "ladder": " UNION ALL ".join(f"SELECT * FROM (WITH {_bars_sql(tf)} SELECT symbol, tf, t, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, v FROM bars)" for tf in ("H1", "H4", "D1")),
    "gap_detection": f"WITH {_bars_sql()}, p AS (SELECT symbol, lag(t) OVER {_BY} AS after, t AS before FROM bars) SELECT symbol, after, before, (before - after) // 3600000 - 1 AS missing FROM p WHERE before - after > 7200000",
    "as_of_join": f"""WITH {_bars_sql()}, {_bars_sql('H4', 'high')}
SELECT b.symbol, b.t, round(b.c, 6) AS c, x.t AS htf_t, round(x.c, 6) AS htf_c FROM bars b ASOF LEFT JOIN (SELECT symbol, t, c, t + 14400000 AS at FROM high) x ON b.symbol = x.symbol AND b.t + 3600000 >= x.at""",
    "forming_bar": f"""WITH {_bars_sql()}, x AS (SELECT *, t // 14400000 * 14400000 AS bucket FROM bars)
SELECT symbol, tf, t, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, v, bucket, round(first(o) OVER w, 6) AS live_o, round(max(h) OVER w, 6) AS live_h, round(min(l) OVER w, 6) AS live_l,
       round(c, 6) AS live_c, sum(v) OVER w AS live_v, round(count(*) OVER w * 3600000 / 14400000.0, 6)::DOUBLE AS fill FROM x WINDOW w AS (PARTITION BY symbol, bucket ORDER BY t)""",
    "bars_before": f"WITH {_bars_sql()} SELECT * EXCLUDE n FROM bars WHERE t < 1705000000000 ORDER BY t DESC, symbol LIMIT 100",
    "bars_after": f"WITH {_bars_sql()} SELECT * EXCLUDE n FROM bars WHERE t > 1705000000000 ORDER BY t, symbol LIMIT 100",
    "bars_range": f"WITH {_bars_sql()} SELECT * EXCLUDE n FROM bars WHERE t >= 1705000000000 AND t < 1705600000000",
    "latest_month": f"WITH {_bars_sql()} SELECT symbol, tf, max(strftime(make_timestamp(t * 1000), '%Y-%m')) AS month FROM bars GROUP BY ALL",
    "pivots": f"""WITH {_bars_sql()} SELECT symbol, tf, t, count(*) OVER w = 7 AND h >= max(h) OVER w AS pivot_high, count(*) OVER w = 7 AND l <= min(l) OVER w AS pivot_low
FROM bars WINDOW w AS (PARTITION BY symbol, tf ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
    "kpi_total": _kpi_sql(), "kpi_by_symbol": _kpi_sql("symbol"), "kpi_by_source": _kpi_sql("source"), "kpi_by_side": _kpi_sql("side"),
    "hand_totals": _kpi_sql("hand", "hand, trades, wins, losses, net, commission"),
    "equity_curve": f"WITH {_TRADES}, {_EQUITY} SELECT hand, t, round(equity, 3) AS equity FROM equity",
    "rolling_drawdown": f"WITH {_TRADES}, {_EQUITY} SELECT hand, t, round(equity, 3) AS equity, round((max(equity) OVER w - equity) / max(equity) OVER w * 100, 3) AS drawdown FROM equity WINDOW w AS (PARTITION BY hand ORDER BY t)",
    "streaks": f"""WITH {_TRADES}, r AS (SELECT hand, pnl > 0 AS win, row_number() OVER (PARTITION BY hand ORDER BY exit_at, entry_at, trade, line, part) - row_number() OVER (PARTITION BY hand, pnl > 0 ORDER BY exit_at, entry_at, trade, line, part) AS run FROM trades),
g AS (SELECT hand, win, run, count(*) AS n FROM r GROUP BY ALL) SELECT hand, coalesce(max(n) FILTER (win), 0) AS longest_win, coalesce(max(n) FILTER (NOT win), 0) AS longest_loss FROM g GROUP BY hand""",
    "recent_closed_pnl": f"WITH {_TRADES} SELECT hand, trade, line, part, exit_at, round(net_pnl, 4) AS net_pnl, row_number() OVER (PARTITION BY hand ORDER BY exit_at DESC, trade DESC, line DESC, part DESC)::INTEGER AS rn FROM trades QUALIFY rn <= 3",
    "order_projection": """WITH e AS (SELECT user_id * 1000 + event_id // 5 AS order_id, event_type AS k, (epoch_us(ts) // 1000) AS ms FROM events WHERE event_type IN ('view', 'click', 'error'))
SELECT order_id, min(ms) FILTER (k = 'view') AS placed_at, max(ms) AS last_at, CASE WHEN bool_or(k = 'click') THEN 'filled' WHEN bool_or(k = 'error') THEN 'cancelled' ELSE 'placed' END AS status FROM e GROUP BY order_id HAVING bool_or(k = 'view')""",
    "sma": _of_bars(_r6(_full("avg(c)", 20), "value")),
    "ema": _ema_sql(20, 2 / 21),
    "smma": _ema_sql(20, 1 / 20),
    "wma": _of_bars(_r6("CASE WHEN lag(c, 19) OVER " + _BY + " IS NOT NULL THEN (" + " + ".join(f"{20 - k} * lag(c, {k}) OVER {_BY}" for k in range(20)) + ") / 210.0 END", "value")),
    "mom": _of_bars(_r6(f"c - lag(c, 10) OVER {_BY}", "value")),
    "roc": _of_bars(_r6(f"CASE WHEN lag(c, 10) OVER {_BY} = 0 THEN 0 ELSE (c - lag(c, 10) OVER {_BY}) / lag(c, 10) OVER {_BY} * 100 END", "value")),
    "bop": _of_bars(_r6("CASE WHEN abs(h - l) < 2.220446049250313e-16 THEN NULL ELSE (c - o) / (h - l) END", "value")),
    "donchian": _of_bars(_r6(_full("max(h)", 20), "upper"), _r6(f"({_full('max(h)', 20)} + {_full('min(l)', 20)}) / 2", "middle"), _r6(_full("min(l)", 20), "lower")),
    "rolling_max": _of_bars(_r6(_full("max(c)", 20), "value")),
    "rolling_min": _of_bars(_r6(_full("min(c)", 20), "value")),
    "williams_r": _of_bars(_r6("CASE WHEN abs(hh - ll) < 2.220446049250313e-16 THEN -50 ELSE (hh - c) * -100 / (hh - ll) END", "value"), before=f", x AS (SELECT *, {_full('max(h)', 14)} AS hh, {_full('min(l)', 14)} AS ll FROM bars)", table="x"),
    "ao": _of_bars(_r6("a - b", "value"), before=f", m AS (SELECT *, (h + l) / 2 AS m FROM bars), x AS (SELECT *, {_full('avg(m)', 5)} AS a, {_full('avg(m)', 34)} AS b FROM m)", table="x"),
    "bbands": _of_bars(
        _r6("m + 2 * d", "upper"), _r6("m", "middle"), _r6("m - 2 * d", "lower"), _r6("CASE WHEN abs(m) < 2.220446049250313e-16 THEN 0 ELSE (m + 2 * d - (m - 2 * d)) / m END", "bandwidth"),
        _r6("CASE WHEN abs(4 * d) < 2.220446049250313e-16 THEN 0.5 ELSE (c - (m - 2 * d)) / (m + 2 * d - (m - 2 * d)) END", "percent_b"),
        before=f", x AS (SELECT *, {_full('avg(c)', 20)} AS m, {_full('stddev_pop(c)', 20)} AS d FROM bars)", table="x",
    ),
    "obv": _of_bars("coalesce(sum(CASE WHEN d > 0 THEN v WHEN d < 0 THEN -v ELSE 0 END) OVER " + _BY + ", 0) AS value", before=f", x AS (SELECT *, {_D} AS d FROM bars)", table="x"),
    "cmo": _of_bars(
        _r6("CASE WHEN abs(u + w) < 2.220446049250313e-16 THEN 0 ELSE (u - w) * 100 / (u + w) END", "value"),
        before=f", y AS (SELECT *, {_D} AS d FROM bars), x AS (SELECT *, CASE WHEN count(d) OVER {_frame(14)} = 14 THEN sum(greatest(d, 0)) OVER {_frame(14)} END AS u, CASE WHEN count(d) OVER {_frame(14)} = 14 THEN sum(greatest(-d, 0)) OVER {_frame(14)} END AS w FROM y)", table="x",
    ),
    "volatility_ratio": _of_bars(
        _r6("CASE WHEN hh IS NULL THEN NULL WHEN abs(hh - ll) < 2.220446049250313e-16 THEN 0 ELSE tr / (hh - ll) END", "value"),
        before=f", x AS (SELECT *, {_TR} AS tr, {_full('max(h)', 14)} AS hh, {_full('min(l)', 14)} AS ll FROM bars)", table="x",
    ),
    "rule_donchian_breakout": _break_sql("donchian_breakout", _prior("max(h)", 20), _prior("min(l)", 10)),
    "rule_highest_breakout": _break_sql("highest_breakout", _prior("max(c)", 20), _prior("min(c)", 20)),
    "rule_ma_crossover": f"""WITH RECURSIVE {_bars_sql()}{_smooth(20, 2 / 21, 'e')}{_smooth(50, 2 / 51, 'g')},
x AS (SELECT e.symbol, e.tf, e.t, e.y AS a, g.y AS b, lag(e.y) OVER (PARTITION BY e.symbol ORDER BY e.t) AS pa, lag(g.y) OVER (PARTITION BY e.symbol ORDER BY e.t) AS pb FROM e JOIN g ON e.symbol = g.symbol AND e.t = g.t)
SELECT symbol, tf, t, 'ma_crossover' AS rule, CASE WHEN a > b THEN 'long' ELSE 'exit' END AS direction, 1.0::DOUBLE AS strength FROM x WHERE (pa <= pb AND a > b) OR (pa >= pb AND a < b)""",
}

ORACLE_SQL |= {
    "rule_orb_breakout": f"""WITH {_bars_sql()}, g AS (SELECT *, coalesce((t - lag(t) OVER {_BY} > 3600000)::INT, 0) AS new FROM bars), s AS (SELECT *, sum(new) OVER {_BY} AS session FROM g),
x AS (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY t) AS place FROM s), y AS (SELECT *, max(h) FILTER (place <= 30) OVER w AS top, min(l) FILTER (place <= 30) OVER w AS bottom FROM x WINDOW w AS (PARTITION BY symbol, session))
SELECT symbol, tf, t, 'orb_breakout' AS rule, CASE WHEN c > top THEN 'long' ELSE 'exit' END AS direction, CASE WHEN c > top THEN round(least(1, (c - top) / top), 6) ELSE 1.0 END::DOUBLE AS strength FROM y WHERE place > 30 AND (c > top OR c < bottom)""",
    "rule_ma_pullback": f"""WITH {_bars_sql()}, m AS (SELECT *, {_full('avg(c)', 50)} AS m FROM bars), n AS (SELECT *, c >= m AND (c - m) / m <= 0.02 AS near FROM m),
e AS (SELECT *, CASE WHEN lag(near) OVER {_BY} AND (c - m) / m > 0.02 THEN 'long' WHEN c < m THEN 'exit' END AS mark FROM n),
d AS (SELECT symbol, tf, t, mark, coalesce(lag(mark) OVER {_BY}, 'exit') AS before FROM e WHERE mark IS NOT NULL)
SELECT symbol, tf, t, 'ma_pullback' AS rule, mark AS direction, 1.0::DOUBLE AS strength FROM d WHERE mark <> before""",
    "bar_returns": f"WITH {_bars_sql()} SELECT symbol, t, round(c, 6) AS c, round(c / lag(c) OVER {_BY} - 1, 6) AS ret FROM bars",
    "correlation_matrix": f"WITH {_bars_sql()} SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE round(coalesce(r, 0), 6) END AS r FROM (SELECT p.symbol AS a, q.symbol AS b, corr(p.c, q.c) AS r FROM bars p JOIN bars q ON p.t = q.t GROUP BY p.symbol, q.symbol)",
    "dedup_flat": f"WITH {_bars_sql()}, x AS (SELECT symbol, t, c, lag(c) OVER {_BY} AS a, lead(c) OVER {_BY} AS b FROM bars) SELECT symbol, t, c FROM x WHERE a IS NULL OR b IS NULL OR a <> c OR b <> c",
    "change_only": f"WITH {_bars_sql()}, x AS (SELECT symbol, t, c, lag(c) OVER {_BY} AS a, lead(c) OVER {_BY} AS b FROM bars) SELECT symbol, t, c FROM x WHERE a IS NULL OR b IS NULL OR a <> c",
    "time_bucket": f"""WITH {_bars_sql()}, x AS (SELECT symbol, t, c, (row_number() OVER {_BY} - 1) * 50 // count(*) OVER (PARTITION BY symbol) AS bucket FROM bars)
SELECT symbol, bucket, arg_min(t, (c, t)) AS low_t, min(c) AS low, arg_max(t, (c, -t)) AS high_t, max(c) AS high FROM x GROUP BY ALL""",
    "order_rate_limit": """SELECT event_type AS symbol, epoch_us(ts) // 1000 AS t, event_id,
  count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS n FROM events""",
    "feed_latency_stats": """WITH r AS (SELECT event_type AS source, floor(value)::BIGINT AS ms, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 DESC, floor(value) DESC) AS rn FROM events),
g AS (SELECT source, list_sort(list(ms)) AS x, sum(ms) AS s FROM r WHERE rn <= 1000 GROUP BY source)
SELECT source, len(x)::INTEGER AS n, floor(s / len(x))::BIGINT AS mean, x[len(x) * 50 // 100 + 1] AS p50, x[len(x) * 95 // 100 + 1] AS p95, x[len(x) * 99 // 100 + 1] AS p99, x[-1] AS max FROM g""",
    "strategy_lineage": """WITH RECURSIVE o AS (SELECT DISTINCT o_orderkey AS id, o_custkey FROM orders), s AS (SELECT id, lag(id) OVER (PARTITION BY o_custkey ORDER BY id) AS previous_id FROM o),
r AS (SELECT id, id AS root, 0 AS depth FROM s WHERE previous_id IS NULL UNION ALL SELECT s.id, r.root, r.depth + 1 FROM s JOIN r ON s.previous_id = r.id) SELECT * FROM r""",
}

_ORDER = "PARTITION BY hand ORDER BY exit_at, entry_at, trade, line, part"
_LABELS = f"""{_bars_sql()}, i AS (SELECT *, row_number() OVER {_BY} AS rn, {_prior('max(h)', 20)} AS top FROM bars), e AS (SELECT * FROM i WHERE c > top),
j AS (SELECT e.symbol, e.tf, e.t, e.c AS entry_price, i.t AS at, i.rn - e.rn AS held, i.h, i.l, i.c AS x, greatest(e.c, max(i.h) OVER w) AS far, least(e.c, min(i.l) OVER w) AS worst
  FROM e JOIN i ON i.symbol = e.symbol AND i.rn BETWEEN e.rn + 1 AND e.rn + 24 WINDOW w AS (PARTITION BY e.symbol, e.t ORDER BY i.rn)),
k AS (SELECT *, CASE WHEN l <= far * (1 - 0.6) THEN 'trailing_stop' WHEN l <= entry_price * 0.5 THEN 'stop_loss' WHEN h >= entry_price * 1.5 THEN 'take_profit' WHEN held = 24 THEN 'max_bars_held' END AS reason FROM j),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY symbol, t ORDER BY reason IS NULL, CASE WHEN reason IS NULL THEN -held ELSE held END) = 1),
labels AS (SELECT e.symbol, e.tf, e.t, 'long' AS side, e.c AS entry_price, e.c * 0.5 AS stop, e.c * 1.5 AS target, f.reason, f.at AS exit_t,
  CASE f.reason WHEN 'trailing_stop' THEN f.far * (1 - 0.6) WHEN 'stop_loss' THEN e.c * 0.5 WHEN 'take_profit' THEN e.c * 1.5 ELSE f.x END AS exit_price,
  coalesce(f.held, 0)::INTEGER AS bars_held, abs(coalesce(f.worst, e.c) - e.c) / e.c AS mae, abs(coalesce(f.far, e.c) - e.c) / e.c AS mfe FROM e LEFT JOIN f ON e.symbol = f.symbol AND e.t = f.t)"""


def _quality_sql(key: str) -> str:
    return f"""WITH {_TRADES}, g AS (SELECT {key}, count(*) AS n, count(*) FILTER (pnl > 0) / count(*)::DOUBLE AS rate, avg(pnl / 100000) FILTER (pnl > 0) AS up, avg(-pnl / 100000) FILTER (pnl <= 0) AS down,
  coalesce(sum(pnl / 100000) FILTER (pnl > 0), 0) AS gain, coalesce(sum(-pnl / 100000) FILTER (pnl <= 0), 0) AS pain, avg(pnl / 100000) AS m, stddev_samp(pnl / 100000) AS s FROM trades GROUP BY ALL),
p AS (SELECT *, coalesce(up / nullif(down, 0), 0) AS pay FROM g)
SELECT {key}, n, round(rate * 100, 6) AS win_rate, round(pay, 6) AS payoff, round(CASE WHEN pay = 0 THEN 0 ELSE 100 / (1 + pay) END, 6) AS breakeven,
  round(CASE WHEN pay = 0 THEN 0 ELSE greatest(-1, least(1, rate - (1 - rate) / pay)) END, 6) AS kelly, round(CASE WHEN pain > 0 THEN gain / pain WHEN gain > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS profit_factor,
  round(CASE WHEN n > 1 AND s > 1e-15 THEN sqrt(n) * m / s ELSE 0 END, 6) AS sqn FROM p"""


ORACLE_SQL |= {
    "exit_barriers": f"""WITH {_LABELS} SELECT symbol, tf, t, side, round(entry_price, 6) AS entry_price, round(stop, 6) AS stop, round(target, 6) AS target, reason, exit_t, round(exit_price, 6) AS exit_price, bars_held,
  round(mae, 6) AS mae, round(mfe, 6) AS mfe FROM labels""",
    "exit_reasons": f"WITH {_LABELS} SELECT symbol, coalesce(reason, 'end_of_data') AS reason, count(*) AS n FROM labels GROUP BY ALL",
    "edge_guard": f"""WITH {_TRADES}, i AS (SELECT hand, exit_at, entry_at, trade, line, part, net_pnl, row_number() OVER o AS i, sum(net_pnl) OVER l AS window_sum, avg(net_pnl) OVER l AS window_avg, min(net_pnl) OVER l AS window_min,
  sum(net_pnl) OVER u + 100000 AS equity FROM trades WINDOW o AS ({_ORDER}), l AS ({_ORDER} ROWS 19 PRECEDING), u AS ({_ORDER} ROWS UNBOUNDED PRECEDING)),
r AS (SELECT *, i - coalesce(max(i) FILTER (net_pnl >= 0) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING), 0) AS losing_run FROM i)
SELECT * EXCLUDE (i) REPLACE (round(net_pnl, 3) AS net_pnl, round(window_sum, 3) AS window_sum, round(window_avg, 3) AS window_avg, round(window_min, 3) AS window_min, round(equity, 3) AS equity),
  CASE WHEN equity > 0 THEN CASE WHEN window_sum < equity * -0.1 THEN 'total_loss' WHEN window_avg < equity * -0.02 THEN 'average_loss' WHEN window_min < equity * -0.05 THEN 'single_loss' WHEN losing_run >= 8 THEN 'consecutive_losses' END END AS breach FROM r""",
    "account_guards": f"""WITH {_TRADES}, e AS (SELECT hand, exit_at, entry_at, trade, line, part, net_pnl, exit_at // 86400000 AS day, sum(net_pnl) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) + 100000 AS equity FROM trades),
d AS (SELECT *, sum(net_pnl) OVER w AS day_pnl, greatest(100000, max(equity) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING)) AS peak FROM e WINDOW w AS (PARTITION BY hand, day ORDER BY exit_at, entry_at, trade, line, part ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, (peak - equity) / peak AS drawdown, equity > 0 AND day_pnl < 0 AND -day_pnl >= equity * 0.02 AS bad, equity > 0 AND (peak - equity) / peak >= 0.1 AS deep FROM d)
SELECT hand, exit_at, entry_at, trade, line, part, round(net_pnl, 3) AS net_pnl, day, round(equity, 3) AS equity, round(day_pnl, 3) AS day_pnl, round(drawdown, 3) AS drawdown,
  CASE WHEN bool_or(deep) OVER ({_ORDER} ROWS UNBOUNDED PRECEDING) THEN 'max_drawdown' WHEN bool_or(bad) OVER (PARTITION BY hand, day ORDER BY exit_at, entry_at, trade, line, part ROWS UNBOUNDED PRECEDING) THEN 'daily_loss' END AS halted FROM f""",
    "monthly_returns": f"""WITH {_TRADES}, {_EQUITY}, m AS (SELECT hand, strftime(make_timestamp(t * 1000), '%Y-%m') AS month, arg_max(equity, t) AS equity FROM equity GROUP BY ALL),
l AS (SELECT *, lag(equity) OVER (PARTITION BY hand ORDER BY month) AS before FROM m) SELECT hand, month, round((equity - before) / before * 100, 4) AS ret FROM l WHERE before <> 0""",
    "trade_quality": _quality_sql("hand"), "trade_quality_by_side": _quality_sql("side"),
    "buy_and_hold": f"""WITH {_bars_sql()}, r AS (SELECT symbol, tf, t, c, c / nullif(lag(c) OVER {_BY}, 0) - 1 AS r, max(c) OVER {_BY} AS peak FROM bars),
g AS (SELECT symbol, tf, arg_max(c, t) / arg_min(c, t) AS whole, (max(t) - min(t)) / (365.25 * 86400000) AS years, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s, sqrt(avg(pow(least(r, 0), 2))) AS down, max((peak - c) / peak) AS dd FROM r GROUP BY ALL)
SELECT symbol, tf, round((whole - 1) * 100, 4) AS total_return_pct, round(ln(whole) / years, 4) AS log_growth, round(s * sqrt(n / years) * 100, 4) AS volatility_pct, round(m / s * sqrt(n / years), 4) AS sharpe,
  round(m / down * sqrt(n / years), 4) AS sortino, round(dd * 100, 4) AS max_drawdown_pct FROM g""",
    "beta": f"""WITH {_bars_sql()}, r AS (SELECT symbol, t, c / lag(c) OVER {_BY} - 1 AS ret FROM bars), m AS (SELECT t, avg(ret) AS market FROM r WHERE ret IS NOT NULL GROUP BY t),
g AS (SELECT symbol, covar_samp(ret, market) AS cov, var_samp(market) AS var, avg(ret) AS r, avg(market) AS m FROM r JOIN m USING (t) WHERE ret IS NOT NULL GROUP BY symbol)
SELECT symbol, round(cov / var, 4) AS beta, round((r - cov / var * m) * 8766, 4) AS alpha FROM g""",
    "diversification": f"""WITH {_bars_sql()}, r AS (SELECT symbol, t, c / lag(c) OVER {_BY} - 1 AS ret FROM bars),
a AS (SELECT avg(vol) AS mean_vol, count(*) AS n FROM (SELECT coalesce(stddev_samp(ret), 0) AS vol FROM r WHERE ret IS NOT NULL GROUP BY symbol)),
p AS (SELECT coalesce(stddev_samp(total), 0) AS vol FROM (SELECT sum(ret) AS total FROM r WHERE ret IS NOT NULL GROUP BY t))
SELECT round(mean_vol, 6) AS mean_vol, round(vol / n, 6) AS portfolio_vol, round(CASE WHEN vol / n < 2.220446049250313e-16 THEN 1.0::DOUBLE ELSE mean_vol / (vol / n) END, 6) AS ratio FROM a, p""",
    "exposure": f"WITH {_TRADES} SELECT hand, round(coalesce(sum(exit_at - entry_at) / nullif((max(exit_at) - min(entry_at))::DOUBLE, 0), 0), 6) AS exposure FROM trades GROUP BY hand",
    "event_counts": "SELECT user_id AS hand, event_type AS code, count(*) AS n FROM events GROUP BY ALL",
}

_WALK_SQL = f"""{_bars_sql(name='ticked')}, closes AS (SELECT symbol, tf, t, sum((c - 50.0) / 10.0) OVER {_BY} + 500.0 AS c, v FROM ticked),
opened AS (SELECT symbol, tf, t, coalesce(lag(c) OVER {_BY}, c) AS o, c, v FROM closes), bars AS (SELECT symbol, tf, t, o, greatest(o, c) AS h, least(o, c) AS l, c, v FROM opened)"""
ORACLE_SQL["buy_and_hold"] = ORACLE_SQL["buy_and_hold"].replace(_bars_sql(), _WALK_SQL, 1).replace("SELECT symbol, tf, round((whole", "SELECT symbol, tf, round((pow(whole, 1 / years) - 1) * 100, 4) AS cagr_pct, round((whole", 1)
ORACLE_SQL |= indicator_sql(_bars_sql()) | rule_sql(_bars_sql()) | walk_rule_sql(_WALK_SQL)
ORACLE_SQL["mcginley"] = indicator_sql(_WALK_SQL)["mcginley"]
ORACLE_SQL |= two_frame_sql(_bars_sql("M15"), _bars_sql("H1", "high_bars"), source.TIMEFRAMES["H1"], source.TIMEFRAMES["M15"])
ORACLE_SQL |= report_sql(_bars_sql, _prior, _TRADES, _EQUITY, {name: ORACLE_SQL[f"rule_{name}"] for name in BOARD}, indicator_sql(_bars_sql()))
_MONTHLY = ORACLE_SQL["monthly_returns"].replace("round((equity - before) / before * 100, 4)", "(equity - before) / before * 100")
ORACLE_SQL |= {
    "signal_page": f"""SELECT t, event_id, symbol, row_number() OVER (ORDER BY t DESC, event_id DESC)::INTEGER AS place, (SELECT count(*) > 50 FROM events WHERE epoch_us(ts) // 1000 < {_NOW}) AS has_more
FROM (SELECT epoch_us(ts) // 1000 AS t, event_id, event_type AS symbol FROM events) WHERE t < {_NOW} ORDER BY t DESC, event_id DESC LIMIT 50""",
    "newest_orders": f"SELECT * FROM ({ORACLE_SQL['order_projection']}) ORDER BY placed_at DESC NULLS LAST, order_id DESC LIMIT 40",
    "events_from": "SELECT event_id AS seq, user_id * 1000 + event_id // 5 AS order_id, 'order_filled' AS kind, epoch_us(ts) // 1000 AS at FROM events WHERE event_type = 'click' AND event_id >= 100 ORDER BY event_id LIMIT 60",
    "last_books": "SELECT event_type AS symbol, epoch_us(ts) // 1000 AS t, event_id, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC)::INTEGER AS rn FROM events QUALIFY rn <= 3",
    "latest_book": "SELECT event_type AS symbol, epoch_us(ts) // 1000 AS t, event_id, value AS price FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) = 1",
    "latest_versions": "SELECT o_custkey AS name, max(o_orderkey) AS version FROM orders GROUP BY o_custkey",
    "exchange_symbols": "SELECT DISTINCT x || ':' || upper(event_type) AS symbol FROM events, (VALUES ('A'), ('B'), ('C')) v(x) WHERE NOT (x = 'B' AND event_type = 'view')",
    "symbol_timeframes": "SELECT symbol, unnest(CASE WHEN symbol = 'view' THEN ['H1', 'D1'] ELSE [" + ", ".join(f"'{tf}'" for tf in source.TIMEFRAMES) + "] END) AS tf FROM (SELECT DISTINCT event_type AS symbol FROM events)",
    "fresh_signals": "SELECT event_type AS symbol, event_id, epoch_us(ts) // 1000 AS generated, epoch_us(ts) // 1000 + floor(value)::BIGINT * 200 AS received FROM events WHERE floor(value) * 200 <= 10000",
    "month_to_date": f"SELECT event_type AS symbol, event_id, epoch_us(ts) // 1000 AS generated, epoch_us(ts) // 1000 + floor(value)::BIGINT * 200 AS received FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-01' AND epoch_us(ts) // 1000 < {_NOW}",
    "last_week": f"SELECT event_type AS symbol, event_id, epoch_us(ts) // 1000 AS generated, epoch_us(ts) // 1000 + floor(value)::BIGINT * 200 AS received FROM events WHERE epoch_us(ts) // 1000 >= {_NOW} - 7 * 86400000 AND epoch_us(ts) // 1000 < {_NOW}",
    "price_levels": f"""WITH {_bars_sql()}, i AS (SELECT *, {_prior('max(h)', 20)} AS top FROM bars), e AS (SELECT symbol, t, c, CASE WHEN t % 7200000 = 0 THEN 'long' ELSE 'short' END AS side FROM i WHERE c > top)
SELECT symbol, t, side, round(CASE WHEN side = 'long' THEN c + 5 ELSE c - 5 END, 6) AS target, round(CASE WHEN side = 'long' THEN c - 3 ELSE c + 3 END, 6) AS stop, round(c * 0.5, 6) AS fixed_stop FROM e""",
    "warmup_window": f"WITH {_bars_sql()}, b AS (SELECT * FROM bars WHERE t >= 1705000000000 - 20 * 3600000), x AS (SELECT symbol, tf, t, {_full('avg(c)', 20)} AS value FROM b) SELECT symbol, tf, t, round(value, 6) AS value FROM x WHERE t >= 1705000000000",
    "cash_impacts": """SELECT l_suppkey::BIGINT AS hand, round(sum(CASE WHEN l_returnflag = 'A' OR (l_returnflag <> 'R' AND l_linenumber % 2 = 1) THEN -l_extendedprice ELSE l_extendedprice END - l_extendedprice * l_tax), 2) AS cash FROM lineitem WHERE l_quantity > 0 GROUP BY l_suppkey""",
    "risk_metrics": f"""WITH {_TRADES}, {_EQUITY}, d AS (SELECT hand, t, equity, (max(equity) OVER w - equity) / max(equity) OVER w AS dd, equity / coalesce(lag(equity) OVER w, 100000) - 1 AS x, row_number() OVER w AS i FROM equity WINDOW w AS (PARTITION BY hand ORDER BY t)),
u AS (SELECT *, i - max(i) FILTER (dd <= 0) OVER (PARTITION BY hand ORDER BY t) AS under FROM d), q AS (SELECT hand, quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM d GROUP BY hand),
g AS (SELECT hand, arg_max(equity, t) AS final, (max(t) - min(t)) / (86400000 * 365.25) AS years, max(dd) AS deep, coalesce(avg(dd) FILTER (dd > 0), 0) AS shallow, max(under) AS longest, sqrt(avg(pow(dd * 100, 2))) AS ulcer, any_value(lo) AS lo, any_value(hi) AS hi, avg(x) FILTER (x <= lo) AS tail FROM u JOIN q USING (hand) GROUP BY hand),
y AS (SELECT *, CASE WHEN final > 0 THEN (pow(final / 100000, 1 / nullif(years, 0)) - 1) * 100 END AS grown FROM g)
SELECT hand, round(shallow, 5) AS avg_drawdown, longest AS longest_drawdown, round(CASE WHEN deep < 2.3e-16 THEN 0 ELSE grown / (deep * 100) END, 5) AS calmar, round(CASE WHEN deep < 2.3e-16 THEN 0 ELSE (final / 100000 - 1) / deep END, 5) AS recovery,
  round(CASE WHEN ulcer < 2.3e-16 THEN 0 ELSE grown / ulcer END, 5) AS serenity, round(greatest(0, -lo), 5) AS var_95, round(greatest(0, -tail), 5) AS cvar_95, round(CASE WHEN abs(lo) < 2.3e-16 THEN 0 ELSE abs(hi) / abs(lo) END, 5) AS tail_ratio FROM y""",
    "trade_outcomes": f"""WITH {_TRADES} SELECT hand, round(avg(net_pnl), 4) AS expectancy, round(count(*) / nullif((max(exit_at) - min(entry_at)) / (86400000 * 365.25), 0), 4) AS trades_per_year,
  round(coalesce(avg(holding_seconds) FILTER (net_pnl > 0), 0), 4) AS held_won, round(coalesce(avg(holding_seconds) FILTER (NOT net_pnl > 0), 0), 4) AS held_lost FROM trades GROUP BY hand""",
    "yearly_returns": f"SELECT hand, month[1:4]::INTEGER AS year, round((product(1 + ret / 100) - 1) * 100, 4) AS ret FROM ({_MONTHLY}) GROUP BY ALL",
    "excursion_means": f"""WITH {_LABELS}, p AS (SELECT *, (exit_price - entry_price) / entry_price AS gain FROM labels)
SELECT symbol, round(avg(mae), 6) AS mae, round(avg(mfe), 6) AS mfe, round(coalesce(avg(greatest(0, least(1, gain / mfe))) FILTER (gain > 0 AND mfe > 0), 0), 6) AS capture FROM p GROUP BY symbol""",
    "rolling_sharpe_std": f"SELECT symbol, round(stddev_samp(sharpe), 6) AS dev FROM ({ORACLE_SQL['rolling_sharpe'].replace(', 4) AS sharpe', ', 15) AS sharpe')}) GROUP BY symbol",
    "row_estimate": f"WITH {_bars_sql()} SELECT symbol, count(*) AS bars, count(*) / 500000.0::DOUBLE AS seconds FROM bars GROUP BY symbol",
}

_MEAN50, _DEV50 = _full("avg(c)", 50), _full("stddev_pop(c)", 50)
ORACLE_SQL |= {
    "rule_sets": crossing_sets_sql(_bars_sql(), "crossing", _SETS),
    "custom_detectors": f"""WITH {_bars_sql()}, p AS (SELECT *, lag(c) OVER {_BY} AS p, h - l AS size, row_number() OVER {_BY} AS rn FROM bars),
m AS (SELECT *, abs(CASE WHEN p = 0 THEN 0 ELSE (c - p) / p END) AS move, {_full('avg(size)', 20)} AS mean FROM p)
SELECT symbol, tf, t, 'jump' AS detector, round(least(1, move), 6)::DOUBLE AS confidence FROM m WHERE rn >= 5 AND move > 0.5 UNION ALL SELECT symbol, tf, t, 'bulge', 0.5::DOUBLE FROM m WHERE rn >= 20 AND size > 2 * mean""",
    "custom_regime": f"""WITH {_bars_sql()}, m AS (SELECT *, {_MEAN50} AS m, {_DEV50} AS dev FROM bars)
SELECT symbol, tf, t, round(m, 6) AS trend, CASE WHEN c > m THEN 'up' WHEN c <= m THEN 'down' END AS trend_is, round(dev, 6) AS volatility, CASE WHEN dev > 30 THEN 'wide' WHEN dev <= 30 THEN 'narrow' END AS volatility_is FROM m""",
    "indicators_by_config": f"WITH {_bars_sql()} SELECT symbol, tf, t, round({_full('avg(c)', 20)}, 6) AS fast_value, round({_full('avg(c)', 50)}, 6) AS slow_value FROM bars",
}
QUERIES |= portfolio_queries.queries(bars, rounded)
ORACLE_SQL |= portfolio_queries.oracle_sql(_bars_sql, _TRADES.replace("SELECT l_suppkey", "SELECT l_quantity AS qty, l_quantity * p_retailprice * 0.1 AS planned_risk, l_suppkey", 1))
