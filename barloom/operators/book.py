"""Fills at the next open, fills to trades, equity marked to market: windows only, one task per account and symbol at most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A position smaller than this is flat: sums of quantities aren't exact.
FLAT = 1e-9
#: Exponents that one block of a position's running cost spans; exp of twice as much is gone in doubles.
BLOCK = 500


def next_open_fills(bars: DataFrame, marks: DataFrame, qty: float = 1.0, commission: float = 0.001, slippage: float = 0.0005) -> DataFrame:
    """rule, symbol, tf, t, side, qty, price, commission: each signal that changes a position fills at the next bar's open, worse
    by the slippage; what is open at the end is sold at the last close. A signal on the last bar never fills.

    Commission and slippage are shares of the price. Only the bars after signals are looked up."""
    w = Window.partitionBy("symbol", "tf").orderBy("t")
    ahead = bars.select("symbol", "tf", "t", F.lead("t").over(w).alias("at"), F.lead("o").over(w).alias("open"))
    own = Window.partitionBy("rule", "symbol", "tf").orderBy("t")
    x = marks.select("rule", "symbol", "tf", "t", "direction").join(ahead, ["symbol", "tf", "t"]).where("at IS NOT NULL")
    x = x.withColumn("was", F.coalesce(F.lag("direction").over(own), F.lit("exit"))).where("direction <> was")
    buy = F.col("direction") == "long"
    fills = x.select("rule", "symbol", "tf", F.col("at").alias("t"), F.when(buy, "buy").otherwise("sell").alias("side"), (F.col("open") * F.when(buy, 1 + slippage).otherwise(1 - slippage)).alias("price"))
    last = bars.groupBy("symbol", "tf").agg(F.max("t").alias("t"), F.max_by("c", "t").alias("c"))
    held = fills.groupBy("rule", "symbol", "tf").agg(F.max_by("side", "t").alias("side")).where("side = 'buy'")
    closing = held.drop("side").join(last, ["symbol", "tf"]).select("rule", "symbol", "tf", "t", F.lit("sell").alias("side"), (F.col("c") * (1 - slippage)).alias("price"))
    both = fills.unionByName(closing)
    return both.select("rule", "symbol", "tf", "t", "side", F.lit(qty).alias("qty"), "price", (F.col("price") * qty * commission).alias("commission"))


def cash_impact(side: Column, qty: Column, price: Column, commission: Column) -> Column:
    """What a fill does to cash: a buy costs, a sale brings, commission goes either way."""
    return F.when(side == "buy", -qty * price).otherwise(qty * price) - commission


def trades_of_fills(fills: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Closed trades of ``fills`` (``keys``, ``order``, side, qty, price, commission): keys, side, qty, entry and exit price and time
    (``order``'s first column), pnl, pnl_pct, commission; one per fill that closes or part-closes a position.

    A fill through the position closes it and opens the rest the other way, its commission split by quantity. Additions move
    the average price; a part close leaves it and takes its share of the entry commission. The running cost of a position is a
    linear recurrence in its fills (an addition adds, a part close scales), so it is a sum of windows over each position, however
    often that is part-closed.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    signed = F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    flat = lambda x: F.when(F.abs(x) < FLAT, 0.0).otherwise(x)
    x = fills.withColumns({"__d": signed.cast("double")})
    x = x.withColumns({"__was": flat(F.coalesce(F.sum("__d").over(before), F.lit(0.0))), "__now": flat(F.sum("__d").over(upto))})
    against = F.signum("__was") * F.signum("__d") < 0
    turned = F.signum("__was") * F.signum("__now") < 0
    size, whole = lambda c: F.abs(F.col(c)), F.nullif(F.col("qty").cast("double"), F.lit(0.0))
    part = lambda kind, amount: F.struct(F.lit(kind).alias("kind"), amount.alias("amount"), (F.col("commission") * amount / whole).alias("fee"))
    closes = part("close", F.least(size("__was"), size("__d")))
    parts = F.when(turned, F.array(closes, part("open", size("__now")))).when(against, F.array(closes)).otherwise(F.array(part("open", size("__d"))))
    # A position begins with a fill while flat, or with the rest of one that turns it; its number counts the beginnings so far.
    begins = turned | ((F.col("__was") == 0) & (size("__d") > 0))
    x = x.withColumns({"__turned": turned, "__begun": F.sum(F.coalesce(begins.cast("int"), F.lit(0))).over(upto)})
    x = x.select(*keys, *order, "price", "__was", "__turned", "__begun", F.posexplode(parts).alias("__k", "p")).select(*keys, *order, "price", "__was", "__turned", "__begun", "__k", "p.*").where("amount > 0")
    x = x.withColumn("__episode", F.col("__begun") - (F.col("__turned") & (F.col("__k") == 0)).cast("int")).drop("__turned", "__begun")
    own = Window.partitionBy(*keys, "__episode").orderBy(*order, "__k")
    opened = F.col("kind") == "open"
    left = F.when(opened, 1.0).otherwise(1 - F.col("amount") / F.nullif(size("__was"), F.lit(0.0)))
    x = x.withColumn("__left", F.when(left < FLAT, 1.0).otherwise(left))  # a full close ends the position: nothing follows
    # What is left of an earlier addition is the product of all shares that stayed since: exp(-__l) of differences of __l. Sums of
    # additions are scaled within blocks of __l, so that nothing over- or underflows; two blocks back all has faded.
    x = x.withColumn("__l", -F.sum(F.log("__left")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("__block", F.floor(F.col("__l") / BLOCK))
    # __l never falls within a position, so its rows by block first are in the same order, and all windows from here share one sort.
    own = Window.partitionBy(*keys, "__episode").orderBy("__block", *order, "__k")
    inside = Window.partitionBy(*keys, "__episode", "__block").orderBy(*order, "__k").rowsBetween(Window.unboundedPreceding, 0)
    scale = F.col("__l") - F.col("__block") * BLOCK
    added = {"__cost": F.col("price") * F.col("amount"), "__fee": F.col("fee")}
    x = x.withColumns({f"{k}_sum": F.sum(F.when(opened, v).otherwise(0.0) * F.exp(scale)).over(inside) for k, v in added.items()})
    x = x.withColumns({f"{k}_past": F.lag(f"{k}_sum").over(own) for k in added})
    x = x.withColumns({f"{k}_past": F.coalesce(F.first(f"{k}_past").over(inside), F.lit(0.0)) for k in added})
    x = x.withColumns({f"{k}_now": F.exp(-scale) * F.col(f"{k}_sum") + F.exp(-scale - BLOCK) * F.col(f"{k}_past") for k in added})
    x = x.withColumns({k: F.coalesce(F.lag(f"{k}_now").over(own), F.lit(0.0)) for k in added})
    x = x.withColumns({"entry_t": F.first(order[0]).over(own), "__long": F.col("__was") > 0})
    held = F.nullif(size("__was"), F.lit(0.0))
    share = F.col("amount") / held
    average = F.col("__cost") / held
    fee = F.col("__fee") * share + F.col("fee")
    gain = F.when(F.col("__long"), F.col("price") - average).otherwise(average - F.col("price")) * F.col("amount") - fee
    out = x.where("kind = 'close'").select(
        *keys, F.when(F.col("__long"), "long").otherwise("short").alias("side"), F.col("amount").alias("qty"), average.alias("entry_price"), F.col("price").alias("exit_price"),
        "entry_t", F.col(order[0]).alias("exit_t"), gain.alias("pnl"), fee.alias("commission"),
    )
    base = F.col("entry_price") * F.col("qty")
    return out.withColumn("pnl_pct", F.when(F.abs(base) > 2.2e-16, F.col("pnl") / base).otherwise(0.0))


def marked_equity(bars: DataFrame, fills: DataFrame, initial: float = 100_000.0, span: int = 30 * 86_400_000) -> DataFrame:
    """t, equity: initial capital, cash of all fills and open positions at the last close of their symbol, at every bar time.

    Each symbol's bars give what its value changed by since its bar before; the changes of a time add up over all symbols, and
    their running sum is taken by spans of time. Fills count at the bar of their time."""
    cash, d = cash_impact(F.col("side"), F.col("qty"), F.col("price"), F.col("commission")), F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty"))
    at = fills.groupBy("symbol", "t").agg(F.sum(cash).alias("cash"), F.sum(d).alias("d"))
    w = Window.partitionBy("symbol").orderBy("t")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = bars.select("symbol", "t", "c").join(at, ["symbol", "t"], "left")
    x = x.withColumn("value", F.sum(F.coalesce("cash", F.lit(0.0))).over(upto) + F.sum(F.coalesce("d", F.lit(0.0))).over(upto) * F.col("c"))
    moves = x.withColumn("move", F.col("value") - F.coalesce(F.lag("value").over(w), F.lit(0.0))).groupBy("t").agg(F.sum("move").alias("move")).withColumn("bucket", F.floor(F.col("t") / span))
    ends = moves.groupBy("bucket").agg(F.sum("move").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inside = F.sum("move").over(Window.partitionBy("bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    return moves.withColumn("inside", inside).join(ends.select("bucket", before.alias("before")), "bucket").select("t", (F.col("before") + F.col("inside") + initial).alias("equity"))


def last_prices(bars: DataFrame, symbols: list[str], span: int = 30 * 86_400_000) -> DataFrame:
    """One row per bar time with a column of the last known close for each of ``symbols`` (null before its first bar)."""
    from .resample import filled

    wide = bars.groupBy("t").pivot("symbol", symbols).agg(F.first("c"))
    known = wide.withColumn("all", F.lit(1))
    for s in symbols:
        known = filled(known, s, "t", ["t"], ["all"], span)
    return known.select("t", *symbols)
