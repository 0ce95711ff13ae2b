"""Exits by barriers, guards over trades and accounts, Kelly sizing, resampled outcomes, positions from their events."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf, probit
from ..functions.sheet import numbered

DAY = 86_400_000
_TRADE_ORDER = ("exit_at", "entry_at", "trade", "line", "part")
EULER = 0.5772156649


def barriers(bars: DataFrame, entries: DataFrame, most: int, trailing: float | None = None, heuristic: bool = False) -> DataFrame:
    """Labels entries (symbol, tf, t, side, entry_price, stop, target) with the barrier that the bars after them touch first.

    A bar tests the trailing stop (a share off the best price since entry, its own included), the stop and then the
    target; with ``heuristic``, the target comes first in a bar that runs against the side. After ``most`` bars the close
    ends it. Adds reason, exit_t, exit_price, bars_held, mae and mfe; reason is null where the bars end first. Null stops
    and targets never fire. Bars are numbered and cut into blocks of ``most`` rows; an entry meets its own block and the next
    in an equi join, and the at most ``most`` bars after it fold as one array. Entries of equal columns count once.
    """
    rows = numbered(bars.select("symbol", "tf", "t", "o", "h", "l", "c"), ["symbol", "tf"], "t", 500 * DAY)
    block = F.floor(F.col("i") / most)
    at = entries.join(rows.select("symbol", "tf", "t", "i"), ["symbol", "tf", "t"]).withColumn("block", F.explode(F.array(block, block + 1)))
    later = rows.select("symbol", "tf", F.col("i").alias("j"), F.floor(F.col("i") / most).alias("block"), F.struct("i", "t", "o", "h", "l", "c").alias("bar"))
    near = F.when((F.col("j") > F.col("i")) & (F.col("j") <= F.col("i") + most), F.col("bar"))
    ahead = at.join(later, ["symbol", "tf", "block"], "left").groupBy(*entries.columns).agg(F.sort_array(F.collect_list(near)).alias("ahead"))
    long, p = F.col("side") == "long", F.col("entry_price")
    event = lambda price, reason: F.struct(price.cast("double").alias("price"), F.lit(reason).alias("reason"))
    state = "struct<best:double,worst:double,far:double,held:int,t:bigint,price:double,reason:string>"
    null = F.lit(None)

    def step(acc: Column, b: Column) -> Column:
        best = F.when(long, F.greatest(acc["best"], b["h"])).otherwise(F.least(acc["best"], b["l"]))
        reach = lambda level: F.when(long, b["l"] <= level).otherwise(b["h"] >= level)
        trail = F.when(long, best * (1 - trailing)).otherwise(best * (1 + trailing)) if trailing is not None else null.cast("double")
        down = F.when(reach(trail), event(trail, "trailing_stop")).when(reach(F.col("stop")), event(F.col("stop"), "stop_loss"))
        up = F.when(F.when(long, b["h"] >= F.col("target")).otherwise(b["l"] <= F.col("target")), event(F.col("target"), "take_profit"))
        against = F.when(long, b["c"] < b["o"]).otherwise(b["c"] > b["o"])
        fired = F.when(against, F.coalesce(up, down)).otherwise(F.coalesce(down, up)) if heuristic else F.coalesce(down, up)
        fired = F.coalesce(fired, F.when(acc["held"] + 1 >= most, event(b["c"], "max_bars_held")))
        lows = F.when(long, F.least(acc["worst"], b["l"])).otherwise(F.greatest(acc["worst"], b["h"]))
        new = F.struct(best, lows, F.when(long, F.greatest(acc["far"], b["h"])).otherwise(F.least(acc["far"], b["l"])), acc["held"] + 1, b["t"], F.coalesce(fired["price"], b["c"]), fired["reason"]).cast(state)
        return F.when(acc["reason"].isNotNull(), acc).otherwise(new)

    start = F.struct(p, p, p, F.lit(0), null, null, null).cast(state)
    met = ahead.withColumn("__x", F.aggregate("ahead", start, step))
    x = F.col("__x")
    adverse, favourable = F.abs(x["worst"] - p) / p, F.abs(x["far"] - p) / p
    return met.select(*entries.columns, x["reason"].alias("reason"), x["t"].alias("exit_t"), x["price"].alias("exit_price"), x["held"].alias("bars_held"), adverse.alias("mae"), favourable.alias("mfe"))


def exit_reasons(labelled: DataFrame, *keys: str) -> DataFrame:
    """How many entries end by each reason."""
    return labelled.groupBy(*keys, F.coalesce("reason", F.lit("end_of_data")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def edge_guard(trades: DataFrame, n: int = 20, total: float = 0.1, mean: float = 0.02, single: float = 0.05, losses: int = 8, initial: float = 100_000.0) -> DataFrame:
    """Each trade of a hand with sum, mean and least profit of the last n, its run of losses, and the first limit broken.

    Limits are shares of the equity realised so far and tested in this order; without positive equity none is tested."""
    order = Window.partitionBy("hand").orderBy(*_TRADE_ORDER)
    last = order.rowsBetween(1 - n, 0)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    net, i = F.col("net_pnl"), F.col("i")
    x = trades.select("hand", *_TRADE_ORDER, "net_pnl", F.row_number().over(order).alias("i"))
    x = x.withColumns({
        "window_sum": F.sum(net).over(last), "window_avg": F.avg(net).over(last), "window_min": F.min(net).over(last),
        "losing_run": i - F.coalesce(F.max(F.when(net >= 0, i)).over(upto), F.lit(0)), "equity": F.sum(net).over(upto) + initial,
    })
    e = F.col("equity")
    reason = F.when(F.col("window_sum") < e * -total, "total_loss").when(F.col("window_avg") < e * -mean, "average_loss").when(F.col("window_min") < e * -single, "single_loss").when(F.col("losing_run") >= losses, "consecutive_losses")
    return x.withColumn("breach", F.when(e > 0, reason)).drop("i")


def account_guards(trades: DataFrame, daily: float = 0.02, drawdown: float = 0.1, initial: float = 100_000.0) -> DataFrame:
    """Each trade with its account's (hand's) equity, profit of the day and drawdown after it, and what blocks the next entry:
    a drawdown at the limit blocks for good, a loss of the day for the rest of that UTC day."""
    # Days go with exit times, so with the day first all windows ask for one and the same sort.
    upto = Window.partitionBy("hand").orderBy("day", *_TRADE_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    day = F.floor(F.col("exit_at") / DAY)
    within = Window.partitionBy("hand", "day").orderBy(*_TRADE_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    x = trades.select("hand", *_TRADE_ORDER, "net_pnl", day.alias("day")).withColumns({"equity": F.sum("net_pnl").over(upto) + initial, "day_pnl": F.sum("net_pnl").over(within)})
    peak = F.greatest(F.lit(initial), F.max("equity").over(upto))
    x = x.withColumn("drawdown", (peak - F.col("equity")) / peak)
    e = F.col("equity")
    x = x.withColumns({"bad_day": F.coalesce((e > 0) & (F.col("day_pnl") < 0) & (-F.col("day_pnl") >= e * daily), F.lit(False)), "deep": (e > 0) & (F.col("drawdown") >= drawdown)})
    halted = F.when(F.max("deep").over(upto), "max_drawdown").when(F.max("bad_day").over(within), "daily_loss")
    return x.withColumn("halted", halted).drop("bad_day", "deep")


def kelly_sized(trades: DataFrame, fraction: float = 0.5, equity: float = 100_000.0, rate: float = 0.5, win: float = 0.02, loss: float = 0.01) -> DataFrame:
    """Trades (symbol, entry_t, entry_price, ret), one at a time a symbol, with the Kelly share of the trades before and the
    quantity that it buys; figures unknown so far take the given ones."""
    before = Window.partitionBy("symbol").orderBy("entry_t").rowsBetween(Window.unboundedPreceding, -1)
    won, r = F.col("ret") > 0, F.col("ret")
    n = F.count(F.lit(1)).over(before)
    share = F.when(n > 0, F.count(F.when(won, 1)).over(before) / n).otherwise(rate)
    up = F.coalesce(F.avg(F.when(won, r)).over(before), F.lit(win))
    down = F.coalesce(F.avg(F.when(~won, F.abs(r))).over(before), F.lit(loss))
    x = trades.select("symbol", "entry_t", "entry_price", share.alias("p"), up.alias("up"), down.alias("down"))
    small = (F.col("up") < 1e-16) | (F.col("down") < 1e-16)
    f = F.when(small, 0.0).otherwise(F.col("p") - (1 - F.col("p")) / (F.col("up") / F.nullif("down", F.lit(0.0))))
    x = x.withColumn("kelly", f)
    stake = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("kelly") * fraction))
    return x.select("symbol", "entry_t", "kelly", F.coalesce(stake * equity / F.nullif("entry_price", F.lit(0.0)), F.lit(0.0)).alias("qty"))


def capped(sized: DataFrame, share: float = 0.2, lot: float = 0.01, equity: float = 100_000.0, budget: float | None = None) -> DataFrame:
    """Quantities (price, qty) held to a share of equity and a budget, then down to whole lots."""
    money = F.least(F.lit(share * equity), F.lit(budget)) if budget is not None else F.lit(share * equity)
    most = money / F.nullif("price", F.lit(0.0))
    return sized.withColumn("qty", F.floor(F.least(F.col("qty"), F.coalesce(most, F.lit(0.0))) / lot) * lot)


def buy_and_hold(bars: DataFrame) -> DataFrame:
    """Per symbol and timeframe: return, growth a year (and its logarithm) and volatility in percent, Sharpe, Sortino and deepest drawdown of holding the close."""
    w = Window.partitionBy("symbol", "tf").orderBy("t")
    peak = F.max("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = bars.select("symbol", "tf", "t", "c", (F.col("c") / F.nullif(F.lag("c").over(w), F.lit(0.0)) - 1).alias("r"), ((peak - F.col("c")) / F.nullif(peak, F.lit(0.0))).alias("dd"))
    g = x.groupBy("symbol", "tf").agg(
        F.min_by("c", "t").alias("first"), F.max_by("c", "t").alias("last"), ((F.max("t") - F.min("t")) / F.lit(365.25 * DAY)).alias("years"), F.count("r").alias("n"), F.avg("r").alias("m"),
        F.stddev_samp("r").alias("s"), F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2))).alias("down"), F.max("dd").alias("dd"),
    )
    whole = F.col("last") / F.nullif("first", F.lit(0.0))
    year = F.sqrt(F.when(F.col("years") > 1e-9, F.col("n") / F.col("years")).otherwise(252.0))
    ratio = lambda below, flat: F.when(F.coalesce(below, F.lit(0.0)) < 1e-15, flat).otherwise(F.col("m") / below * year)
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return g.select(
        "symbol", "tf", z((whole - 1) * 100).alias("total_return_pct"), z(F.when(F.col("years") > 0, (F.pow(whole, 1 / F.nullif("years", F.lit(0.0))) - 1) * 100)).alias("cagr_pct"),
        z(F.when(whole > 0, F.log(whole) / F.nullif("years", F.lit(0.0)))).alias("log_growth"),
        z(F.col("s") * year * 100).alias("volatility_pct"), ratio(F.col("s"), 0.0).alias("sharpe"), ratio(F.col("down"), F.lit(float("inf"))).alias("sortino"), z(F.col("dd") * 100).alias("max_drawdown_pct"),
    )


def skill(returns: DataFrame, *keys: str, trials: int = 1) -> DataFrame:
    """Probabilistic Sharpe ratio of ``ret`` against 0, and deflated by the best of ``trials`` without skill; 0 below four returns."""
    g = returns.groupBy(*keys).agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    ratio = F.col("m") / F.nullif("s", F.lit(0.0))
    g = g.withColumn("sr", ratio).withColumn("var", (1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")) / (F.col("n") - 1))
    best = (1 - EULER) * probit(F.lit(1 - 1 / trials)) + EULER * probit(F.lit(1 - 1 / (trials * math.e))) if trials > 1 else F.lit(0.0)
    ok = (F.col("n") >= 4) & (F.col("s") >= 1e-15) & (F.col("var") > 0)
    at = lambda bar: F.when(ok, normal_cdf((F.col("sr") - bar) / F.sqrt("var"))).otherwise(0.0)
    return g.select(*keys, "n", at(F.lit(0.0)).alias("psr"), at(F.sqrt("var") * best).alias("dsr"))


def monthly_returns(curve: DataFrame) -> DataFrame:
    """Per hand and month after its first: percent change of the last equity of the month on that of the month before."""
    month = F.date_format(F.timestamp_millis("t"), "yyyy-MM")
    ends = curve.groupBy("hand", month.alias("month")).agg(F.max_by("equity", "t").alias("equity"))
    before = F.lag("equity").over(Window.partitionBy("hand").orderBy("month"))
    out = ends.select("hand", "month", ((F.col("equity") - before) / F.nullif(before, F.lit(0.0)) * 100).alias("ret"))
    return out.where("ret IS NOT NULL")


def yearly_returns(monthly: DataFrame) -> DataFrame:
    """Per hand and year: the compounded percent changes of its months."""
    return monthly.groupBy("hand", F.substring("month", 1, 4).cast("int").alias("year")).agg(((F.product(F.col("ret") / 100 + 1) - 1) * 100).alias("ret"))


def excursion_means(labelled: DataFrame) -> DataFrame:
    """Per symbol: mean worst and best move, and the mean share of the best move that winners kept (0 to 1)."""
    gain = (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price") * F.when(F.col("side") == "long", 1).otherwise(-1)
    kept = F.when((gain > 0) & (F.col("mfe") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), gain / F.col("mfe"))))
    return labelled.groupBy("symbol").agg(F.avg("mae").alias("mae"), F.avg("mfe").alias("mfe"), F.coalesce(F.avg(kept), F.lit(0.0)).alias("capture"))


def trade_quality(trades: DataFrame, *keys: str, initial: float = 100_000.0) -> DataFrame:
    """Win rate, payoff, break-even rate, Kelly share (within ±1), profit factor and SQN of gross profits; profit 0 is a loss."""
    r = F.col("pnl") / initial
    won = F.col("pnl") > 0
    g = trades.groupBy(*keys).agg(
        F.count("pnl").alias("n"), F.count_if(won).alias("wins"), F.avg(F.when(won, r)).alias("up"), F.avg(F.when(~won, -r)).alias("down"),
        F.sum(F.when(won, r)).alias("gain"), F.sum(F.when(~won, -r)).alias("pain"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"),
    )
    rate, pay = F.col("wins") / F.col("n"), F.coalesce(F.col("up") / F.nullif("down", F.lit(0.0)), F.lit(0.0))
    nothing = pay == 0
    kelly = F.when(nothing, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rate - (1 - rate) / F.nullif(pay, F.lit(0.0)))))
    factor = F.when(F.coalesce("pain", F.lit(0.0)) > 0, F.coalesce("gain", F.lit(0.0)) / F.nullif("pain", F.lit(0.0))).when(F.col("gain") > 0, F.lit(float("inf"))).otherwise(0.0)
    sqn = F.when((F.col("n") > 1) & (F.col("s") > 1e-15), F.sqrt("n") * F.col("m") / F.col("s")).otherwise(0.0)
    return g.select(*keys, "n", (rate * 100).alias("win_rate"), pay.alias("payoff"), F.when(nothing, 0.0).otherwise(100 / (1 + pay)).alias("breakeven"), kelly.alias("kelly"), factor.alias("profit_factor"), sqn.alias("sqn"))


def by_regime(trades: DataFrame, regimes: DataFrame) -> DataFrame:
    """Trades (symbol, tf, entry_t, ret) by the label (symbol, tf, t, label) of their entry bar."""
    x = trades.join(regimes.withColumnRenamed("t", "entry_t"), ["symbol", "tf", "entry_t"]).where("label IS NOT NULL")
    r = F.col("ret")
    g = x.groupBy("label").agg(F.count(F.lit(1)).alias("trades"), (F.avg(F.when(r > 0, 100.0).otherwise(0.0))).alias("win_rate"), (F.avg(r) * 100).alias("avg_return"), F.sum(F.greatest(r, F.lit(0.0))).alias("gain"), F.sum(F.greatest(-r, F.lit(0.0))).alias("pain"))
    factor = F.when(F.col("pain") > 0, F.col("gain") / F.nullif("pain", F.lit(0.0))).when(F.col("gain") > 0, F.lit(float("inf"))).otherwise(0.0)
    return g.select("label", "trades", "win_rate", "avg_return", factor.alias("profit_factor")).orderBy(F.desc("trades"), "label")


def changes(labels: DataFrame) -> DataFrame:
    """Rows (symbol, tf, t, label) whose label differs from the one before; a series' first row counts."""
    before = F.lag("label").over(Window.partitionBy("symbol", "tf").orderBy("t"))
    return labels.select("symbol", "tf", "t", before.alias("was"), "label").where("NOT (was <=> label)")


def _resampled(returns: DataFrame, paths: int, seed: int) -> DataFrame:
    """symbol, path, k, x: the log growth of each path up to its step k."""
    sizes = returns.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    steps = returns.select("symbol", F.col("i").alias("k")).join(sizes, "symbol").select("symbol", "k", "n", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))).alias("path"))
    picks = steps.select("symbol", "path", "k", F.pmod(F.xxhash64(F.lit(seed), "symbol", "path", "k"), F.col("n")).alias("i"))
    w = Window.partitionBy("symbol", "path").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return picks.join(returns, ["symbol", "i"]).select("symbol", "path", "k", F.sum(F.log1p(F.greatest("ret", F.lit(-1 + 1e-12)))).over(w).alias("x"))


def bootstrap_bands(returns: DataFrame, paths: int = 200, seed: int = 42, percents: tuple[int, ...] = (5, 25, 50, 75, 95)) -> DataFrame:
    """symbol, k and the percentiles over all paths of the growth up to each step, of the same paths as ``bootstrap``. A step's
    values are counted before they meet; only the paths of one step do."""
    grown = _resampled(returns, paths, seed).select("symbol", "k", F.exp("x").alias("growth"))
    return grown.groupBy("symbol", "k").agg(*(F.percentile("growth", F.lit(q / 100)).alias(f"p{q}") for q in percents))


def bootstrap(returns: DataFrame, paths: int = 200, seed: int = 42, ruin: float = 0.5) -> DataFrame:
    """Resamples each symbol's returns (symbol, i from 0, ret) with replacement into ``paths`` paths of as many steps.

    A step's pick is a hash of seed, symbol, path and step, so any executor can draw it again. Per symbol: percentiles of
    the final growth and the share of paths that ever fall to ``ruin`` of the start."""
    grown = _resampled(returns, paths, seed)
    ends = grown.groupBy("symbol", "path").agg(F.exp(F.max_by("x", "k")).alias("final"), F.exp(F.min("x")).alias("lowest"))
    cuts = {f"p{q}": F.percentile("final", F.lit(q / 100)) for q in (5, 10, 25, 50, 75, 90, 95)}
    return ends.groupBy("symbol").agg(F.count(F.lit(1)).alias("paths"), *(v.alias(k) for k, v in cuts.items()), F.avg((F.col("lowest") <= ruin).cast("double")).alias("ruin"))


def lttb(points: DataFrame, target: int) -> DataFrame:
    """Largest-triangle downsampling of each symbol's (t, c) to ``target`` points, its ends included; ties to the later point.

    Each choice depends on the one before, so a series is one task; its buckets are numpy slices."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        n = len(pdf)
        if n <= target or target < 3:
            return pdf
        t, v = pdf["t"].to_numpy(float), pdf["c"].to_numpy(float)
        edges = np.minimum(np.floor(np.arange(target) * ((n - 2) / (target - 2)) + 1).astype(int), n)
        kept = [0]
        for a, b, c in zip(edges, edges[1:], edges[2:].tolist() + [n], strict=False):
            b = min(b, n - 1)
            if a >= b:
                continue
            at, av = (t[b:c].mean(), v[b:c].mean()) if b < c else (t[-1], v[-1])
            area = np.abs((t[kept[-1]] - at) * (v[a:b] - v[kept[-1]]) - (t[kept[-1]] - t[a:b]) * (av - v[kept[-1]]))
            kept.append(b - 1 - int(np.argmax(area[::-1])))
        return pdf.iloc[[*kept, n - 1]]

    return points.select("symbol", "t", "c").groupBy("symbol").applyInPandas(one, "symbol string, t long, c double")


def stitched(curves: DataFrame) -> DataFrame:
    """Curves (symbol, fold, t, equity) laid end to end: each fold starts where the fold before ended."""
    ends = curves.groupBy("symbol", "fold").agg(F.min_by("equity", "t").alias("a"), F.max_by("equity", "t").alias("b"))
    w = Window.partitionBy("symbol").orderBy("fold")
    scale = F.exp(F.coalesce(F.sum(F.log(F.col("b") / F.col("a"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) * F.first("a").over(w) / F.col("a")
    return curves.join(ends.select("symbol", "fold", scale.alias("scale")), ["symbol", "fold"]).select("symbol", "fold", "t", (F.col("equity") * F.col("scale")).alias("equity"))


def replayed(events: DataFrame) -> DataFrame:
    """Positions from their events (hand, trade, seq, kind, client_id, order_id, action, side, price, qty): phase, side, qty,
    entry price, additions, realised profit.

    idle → entering → open → adding or exiting → open or idle. action is open, add or close; ``order_place`` names the order
    by client_id, ``order_placed`` gives its order_id, ``order_filled`` must name it, and ``order_cancelled`` ends whatever
    order waits. An event that doesn't fit is left out. One trade's few events fold as one sorted array.
    """
    state = "struct<phase:string,pending:string,side:string,qty:double,entry:double,adds:int,pnl:double>"
    row = F.struct("seq", "kind", "client_id", "order_id", "action", "side", "price", "qty")
    grouped = events.groupBy("hand", "trade").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def step(x: Column, e: Column) -> Column:
        to = lambda **new: F.struct(*(new.get(k, x[k]).alias(k) for k in ("phase", "pending", "side", "qty", "entry", "adds", "pnl"))).cast(state)
        phase, kind = x["phase"], e["kind"]
        waits = phase.isin("entering", "adding", "exiting")
        goal = F.when(e["action"] == "close", "exiting").when(e["action"] == "add", "adding").otherwise("entering")
        side = F.when(goal == "entering", e["side"]).otherwise(x["side"])
        fits = F.when(goal == "entering", phase == "idle").otherwise(phase == "open")
        ours = waits & (e["order_id"] == x["pending"])
        whole = x["qty"] + e["qty"]
        gain = F.when(x["side"] == "sell", x["entry"] - e["price"]).otherwise(e["price"] - x["entry"]) * x["qty"]
        none = F.lit(None).cast("string")
        return (
            F.when((kind == "order_place") & fits, to(phase=goal, pending=e["client_id"], side=side))
            .when((kind == "order_placed") & phase.isin("idle", "open"), to(phase=goal, pending=e["order_id"], side=side))
            .when((kind == "order_placed") & waits & (e["client_id"] == x["pending"]), to(pending=e["order_id"]))
            .when((kind == "order_filled") & ours & (phase == "entering"), to(phase=F.lit("open"), pending=none, qty=e["qty"], entry=e["price"]))
            .when((kind == "order_filled") & ours & (phase == "adding"), to(phase=F.lit("open"), pending=none, qty=whole, entry=(x["qty"] * x["entry"] + e["qty"] * e["price"]) / F.nullif(whole, F.lit(0.0)), adds=x["adds"] + 1))
            .when((kind == "order_filled") & ours, to(phase=F.lit("idle"), pending=none, side=none, qty=F.lit(0.0), entry=F.lit(0.0), adds=F.lit(0), pnl=x["pnl"] + gain))
            .when((kind == "order_cancelled") & (phase == "entering"), to(phase=F.lit("idle"), pending=none, side=none))
            .when((kind == "order_cancelled") & waits, to(phase=F.lit("open"), pending=none))
            .otherwise(x)
        )

    start = F.struct(F.lit("idle"), F.lit(None), F.lit(None), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(0.0)).cast(state)
    out = grouped.select("hand", "trade", F.aggregate("rows", start, step).alias("x"))
    return out.select("hand", "trade", "x.phase", "x.side", "x.qty", F.col("x.entry").alias("entry_price"), "x.adds", "x.pnl")


def beta(returns: DataFrame, annual: float) -> DataFrame:
    """Each symbol's beta to the mean return of all symbols at equal times, and its alpha a year; 0 without variance."""
    known = returns.where("ret IS NOT NULL")
    market = known.groupBy("t").agg(F.avg("ret").alias("market"))
    g = known.join(market, "t").groupBy("symbol").agg(F.covar_samp("ret", "market").alias("cov"), F.var_samp("market").alias("var"), F.avg("ret").alias("r"), F.avg("market").alias("m"))
    b = F.coalesce(F.col("cov") / F.nullif("var", F.lit(0.0)), F.lit(0.0))
    return g.select("symbol", b.alias("beta"), ((F.col("r") - b * F.col("m")) * annual).alias("alpha"))


def exposure(trades: DataFrame) -> DataFrame:
    """Per hand: time in trades as a share of the time from its first entry to its last exit; overlapping trades add up."""
    g = trades.groupBy("hand").agg(F.sum(F.col("exit_at") - F.col("entry_at")).alias("busy"), (F.max("exit_at") - F.min("entry_at")).alias("span"))
    return g.select("hand", F.coalesce(F.col("busy") / F.nullif(F.col("span").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("exposure"))


def holdings(positions: DataFrame) -> DataFrame:
    """Per hand of replayed positions: open ones, gross exposure at entry prices, realised profit."""
    opened = F.col("qty") > 0
    return positions.groupBy("hand").agg(F.count_if(opened).alias("open"), F.sum(F.when(opened, F.col("qty") * F.col("entry_price")).otherwise(0.0)).alias("gross"), F.sum("pnl").alias("realised"))


def walk_forward_summary(curves: DataFrame) -> DataFrame:
    """Curves (symbol, fold, t, equity) per symbol: folds, their mean return and the share of profitable ones."""
    folds = curves.groupBy("symbol", "fold").agg((F.max_by("equity", "t") / F.nullif(F.min_by("equity", "t"), F.lit(0.0)) - 1).alias("ret"))
    return folds.groupBy("symbol").agg(F.count(F.lit(1)).alias("folds"), F.avg("ret").alias("mean_return"), F.avg((F.col("ret") > 0).cast("double")).alias("profitable"))


def diversification(returns: DataFrame) -> DataFrame:
    """One row from (symbol, t, ret): mean volatility of the symbols, volatility of holding all of them in equal parts, and
    the first over the second (1 without volatility). A symbol without a return at a time adds 0 there."""
    known = returns.where("ret IS NOT NULL")
    alone = known.groupBy("symbol").agg(F.coalesce(F.stddev_samp("ret"), F.lit(0.0)).alias("vol")).select("vol", F.lit(None).cast("double").alias("total"))
    together = known.groupBy("t").agg(F.sum("ret").alias("total")).select(F.lit(None).cast("double").alias("vol"), "total")
    g = alone.unionByName(together).agg(F.avg("vol").alias("mean_vol"), F.coalesce(F.stddev_samp("total") / F.count("vol"), F.lit(0.0)).alias("portfolio_vol"))
    return g.withColumn("ratio", F.when(F.col("portfolio_vol") < 2.220446049250313e-16, 1.0).otherwise(F.col("mean_vol") / F.col("portfolio_vol")))


def turnover(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Per symbol: trades for every 100 bars; both sides are counted before they meet."""
    made = trades.groupBy("symbol").agg(F.count(F.lit(1)).alias("trades"))
    seen = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    n = F.coalesce("trades", F.lit(0))
    return seen.join(made, "symbol", "left").select("symbol", n.alias("trades"), "bars", (n / F.col("bars") * 100).alias("turnover_pct"))
