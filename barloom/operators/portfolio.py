"""Several symbols and trades at a time: last known prices, rules over a basket, exposure over time, KPI slices, trades
out of journal payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sheet import Sheet
from .rules import emitted

DAY = 86_400_000


def last_known(bars: DataFrame, span: int = 30 * DAY) -> DataFrame:
    """t, symbol, c: at each time of any bar, the last known close of every symbol that has had one.

    All symbols go in one pass: within spans of time by windows, across spans by one row a span and symbol that carries the close before it."""
    rows = bars.select("symbol", "t", "c", F.floor(F.col("t") / span).alias("span"))
    ends = rows.groupBy("span", "symbol").agg(F.max_by("c", "t").alias("end"))
    times = rows.select("span", "t").distinct()
    # A symbol is known in its own spans and in all that follow; spans without any bar don't count.
    spans = times.select("span").distinct()
    most = rows.agg(F.max("span")).first()[0] or 0
    until = F.coalesce(F.lead("span").over(Window.partitionBy("symbol").orderBy("span")), F.lit(most))
    carried = ends.select("symbol", "span", until.alias("until"), F.col("end").alias("carry")).where("until > span")
    carried = carried.select("symbol", "carry", F.explode(F.sequence(F.col("span") + 1, F.col("until"))).alias("span"))
    known = ends.select("span", "symbol").join(carried.join(spans, "span", "left_semi"), ["span", "symbol"], "full")
    grid = times.join(known, "span").join(rows.drop("span"), ["t", "symbol"], "left")
    w = Window.partitionBy("span", "symbol").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("t", "symbol", F.coalesce(F.last("c", ignorenulls=True).over(w), "carry").alias("c")).where("c IS NOT NULL")


def basket(bars: DataFrame, symbols: list[str], name: str = "basket", span: int = 30 * DAY) -> DataFrame:
    """One bar a time with a column of the last known close for each of ``symbols``; symbol is ``name``."""
    wide = last_known(bars.where(F.col("symbol").isin(symbols)), span).groupBy("t").pivot("symbol", symbols).agg(F.first("c"))
    return wide.select(F.lit(name).alias("symbol"), F.lit("any").alias("tf"), "t", *symbols)


def basket_signals(bars: DataFrame, name: str, symbols: list[str], rule: Callable[[Sheet, dict[str, Column]], tuple], span: int = 30 * DAY) -> DataFrame:
    """Signals of a user's rule over several symbols: it gets a sheet over the times of all their bars and each symbol's last
    known close, and returns (entry, exit)."""
    s = Sheet(basket(bars, symbols, name, span))
    return emitted(s, name, *rule(s, {x: F.col(x) for x in symbols}))


def _swept(trades: DataFrame, keys: list[str], order: list[str], span: int, held: list[str], totals: dict[str, Column]) -> DataFrame:
    """Entries of ``trades`` with ``held`` columns, entry_at, gross and open (see ``open_exposure``), and for each of ``totals`` its sum over the trades
    that ended by the time of the entry.

    One sweep: both points of a trade are dealt once by keys and span of time. What comes before a span is the last running sum of each
    earlier span, out of the same dealt rows."""
    value = F.col("qty").cast("double") * F.col("entry_price")
    point = lambda at, side, sign: F.struct(
        F.col(at).alias("__at"), F.lit(side).alias("__side"), (sign * value).alias("__d"), F.lit(sign).alias("__k"), *((v if side else F.lit(0.0)).alias(f"__{k}") for k, v in totals.items())
    )
    # Both readings of the dealt rows ask for the same rows and columns, so they are shuffled once: an entry's time is __at, and a
    # trade without an end (no span) is never given back.
    columns = [c for c in dict.fromkeys([*keys, *order, *held]) if c != "entry_at"]
    x = trades.withColumn("__x", F.explode(F.array(point("entry_at", 0, 1), point("exit_at", 1, -1)))).select(*columns, "__x.*").withColumn("__span", F.floor(F.col("__at") / span)).where("__span IS NOT NULL")
    inside = Window.partitionBy(*keys, "__span").orderBy("__at", "__side", *order).rowsBetween(Window.unboundedPreceding, 0)
    # Peers by time alone are a coarser order of the same sort: what ends at the time of an entry has ended.
    peers = Window.partitionBy(*keys, "__span").orderBy("__at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.repartition(*keys, "__span").withColumns({"__gross": F.sum("__d").over(inside), "__open": F.sum("__k").over(inside), "__row": F.row_number().over(inside)})
    x = x.withColumns({f"__{k}": F.sum(f"__{k}").over(peers) for k in totals})
    sums = ["__gross", "__open", *(f"__{k}" for k in totals)]
    ends = x.groupBy(*keys, "__span").agg(*(F.max_by(c, "__row").alias(c) for c in sums))
    earlier = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    past = ends.select(*keys, "__span", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_past") for c in sums))
    out = x.where("__side = 0").join(past, [*keys, "__span"])
    return out.select(*columns, F.col("__at").alias("entry_at"), *((F.col(c) + F.col(f"{c}_past")).alias(c[2:]) for c in sums))


def open_exposure(trades: DataFrame, keys: list[str], order: list[str], span: int = 30 * DAY) -> DataFrame:
    """Each trade (entry_at, exit_at, qty, entry_price) with ``gross``, the value at entry prices of what its ``keys`` hold right after
    its entry, itself included, and ``open``, how many trades that is. A trade that ends at another's entry time is still held.

    A sweep over entries and exits: running sums within spans of time, and one row a span with the sum of those before."""
    return _swept(trades, keys, order, span, trades.columns, {}).select(*trades.columns, "gross", "open")


def exposure_guard(trades: DataFrame, keys: list[str], order: list[str], most: float = 2.0, initial: float = 100_000.0, span: int = 30 * DAY) -> DataFrame:
    """``open_exposure`` with ``limit``, ``most`` times the equity realised before the entry, and whether the trade would break it."""
    x = _swept(trades, keys, order, span, trades.columns, {"equity": F.col("net_pnl").cast("double")})
    x = x.select(*trades.columns, "gross", "open", (F.col("equity") + initial).alias("equity")).withColumn("limit", F.greatest(F.col("equity"), F.lit(0.0)) * most)
    return x.withColumn("blocked", F.col("gross") > F.col("limit"))


def portfolio_summary(trades: DataFrame, prices: DataFrame | None, at: int, initial: float = 100_000.0, order: tuple[str, ...] = ()) -> DataFrame:
    """Per hand at the time ``at``: realised profit so far and of that UTC day, unrealised profit of open trades at the last known
    prices (symbol, c), their gross value at entry prices, equity, and the drawdown from the highest realised equity.

    Trades carry hand, symbol, side, qty, entry_at, entry_price, exit_at and net_pnl; a trade entered by ``at`` and not ended then is open.
    Without ``prices`` a symbol's price is that of its last entry by ``at``, the last of them by ``order`` and hand. All but the drawdown
    is made of sums by hand and symbol, so trades are read once for prices and figures: open trades meet a price as net quantity and cost.
    Profits are summed in the type that net_pnl has: as decimals their sums don't depend on the order of rows."""
    x = trades.where(F.col("entry_at") <= at)
    opened, qty = F.col("exit_at") > at, F.col("qty").cast("double")
    signed = F.when(F.col("side") == "long", qty).otherwise(-qty)
    today = F.floor(F.col("exit_at") / DAY) == F.floor(F.lit(at) / DAY)
    none = lambda c: F.coalesce(c, F.lit(0.0))
    total = lambda when, value, name: F.sum(F.when(when, value)).alias(name)
    net, known = F.col("net_pnl"), opened & F.col("entry_price").isNotNull()
    sums = [
        F.count_if(opened).alias("open"), total(opened, qty * F.col("entry_price"), "gross"), total(~opened, net, "realised"), total(~opened & today, net, "day_pnl"),
        total(known, signed, "__q"), total(opened, signed * F.col("entry_price"), "__cost"),
    ]
    if prices is None:
        last = F.struct("entry_at", *order, "hand")
        held = x.groupBy("hand", "symbol").agg(*sums, F.max(F.struct(last.alias("at"), F.col("entry_price").alias("c"))).alias("__last"))
        # A window over the sums, not a join with them: each side of a join would ask for other columns and read the trades again.
        held = held.withColumn("__c", F.when(F.col("symbol").isNotNull(), F.max("__last").over(Window.partitionBy("symbol"))["c"]))
    else:
        held = x.groupBy("hand", "symbol").agg(*sums).join(prices.select("symbol", F.col("c").alias("__c")), "symbol", "left")
    g = held.groupBy("hand").agg(
        F.sum("open").alias("open"), none(F.sum("gross")).alias("gross"), none(F.sum("realised").cast("double")).alias("realised"), none(F.sum("day_pnl").cast("double")).alias("day_pnl"),
        none(F.sum(F.col("__c") * F.col("__q") - F.col("__cost"))).alias("unrealised"),
    )
    daily = x.where(~opened).groupBy("hand", F.floor(F.col("exit_at") / DAY).alias("day")).agg(F.sum(net.cast("double")).alias("d"))
    top = daily.withColumn("e", F.sum("d").over(Window.partitionBy("hand").orderBy("day"))).groupBy("hand").agg(F.max("e").alias("top"))
    e = F.col("realised") + F.col("unrealised") + initial
    peak = F.greatest(F.lit(initial), none(F.col("top")) + initial, e)
    return g.join(top, "hand", "left").select("hand", "open", "gross", "realised", "day_pnl", "unrealised", e.alias("equity"), ((peak - e) / peak).alias("drawdown"))


def kpi_slices(trades: DataFrame, slices: list[str], most: int = 50) -> DataFrame:
    """slice, value, and the KPIs of the trades of each value of each of ``slices``: the ``most`` values with the most trades, by count and
    then by value. One pass over the trades for all slices; trades without a value have no row there."""
    net, win = F.col("net_pnl").cast("double"), F.col("net_pnl") > 0
    held = F.explode(F.array(*(F.struct(F.lit(k).alias("slice"), F.col(k).cast("string").alias("value")) for k in slices)))
    x = trades.select(held.alias("s"), "net_pnl", "commission").select("s.*", "net_pnl", "commission").where("value IS NOT NULL")
    g = x.groupBy("slice", "value").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(win).alias("wins"), F.sum(net).alias("net"), F.sum(F.col("commission").cast("double")).alias("commission"), F.max(net).alias("best"), F.min(net).alias("worst")
    )
    rank = F.row_number().over(Window.partitionBy("slice").orderBy(F.desc("trades"), "value"))
    return g.withColumn("rank", rank).where(F.col("rank") <= most).withColumn("win_rate", F.col("wins") / F.col("trades") * 100)


#: Fixed: the fields of a closed position's payload.
CLOSED = "symbol string, side string, qty double, entryPrice double, exitPrice double, entryTime long, exitTime long, pnl double, commission double, reason string"


def _once(x: Column) -> Column:
    """A value that filters above it don't work out again: they stay above the rows that it makes."""
    return F.explode(F.array(x))


def _read(events: DataFrame, schema: str, kind: str | None) -> DataFrame:
    """Events of the kind with __p, their payload, and ``why`` it isn't an object of that schema. Each payload is read once."""
    rows = events.where(F.col("kind") == kind) if kind else events
    read = rows.withColumn("__p", _once(F.from_json("payload", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})))
    return read.withColumn("why", F.when(F.col("payload").isNull(), "missing").when(F.col("__p").isNull() | F.col("__p.__bad").isNotNull(), "malformed"))


def decoded(events: DataFrame, schema: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Events (kind, payload, …) with the fields of their JSON payload, and the rejects: those of the kind whose payload isn't an
    object of that schema, with why."""
    read = _read(events, schema, kind)
    good = read.where("why IS NULL").select(*events.columns, "__p.*").drop("__bad")
    return good, read.where("why IS NOT NULL").select(*events.columns, "why")


def closed_trades(events: DataFrame, kind: str = "position_closed") -> tuple[DataFrame, DataFrame]:
    """Trades out of the payloads of closed positions, one a trade_id (the last by time), and the rejects: payloads that aren't
    such an object, or lack a quantity, a price or a time, or end before they begin. Either reads the events once."""
    needed = ["symbol", "qty", "entryPrice", "exitPrice", "entryTime", "exitTime"]
    p = lambda c: F.col(f"__p.{c}")
    lacking = F.when(F.concat(*(p(c).cast("string") for c in needed)).isNull(), "incomplete").when((p("qty") <= 0) | (p("exitTime") < p("entryTime")), "impossible")
    read = _read(events, CLOSED, kind).withColumn("why", F.coalesce("why", lacking))
    bad = read.where("why IS NOT NULL").select(*events.columns, "why")
    good = read.where("why IS NULL").select(*events.columns, "__p.*").drop("__bad")
    sign = F.when(F.lower("side").isin("short", "sell"), -1.0).otherwise(1.0)
    fee = F.coalesce("commission", F.lit(0.0))
    pnl = F.coalesce("pnl", sign * F.col("qty") * (F.col("exitPrice") - F.col("entryPrice")))
    rows = good.select(
        "trade_id", "at", "symbol", F.when(sign > 0, "long").otherwise("short").alias("side"), "qty", F.col("entryPrice").alias("entry_price"), F.col("exitPrice").alias("exit_price"),
        F.col("entryTime").alias("entry_at"), F.col("exitTime").alias("exit_at"), pnl.alias("pnl"), fee.alias("commission"), (pnl - fee).alias("net_pnl"), F.coalesce("reason", F.lit("unknown")).alias("reason"),
    )
    fields = [c for c in rows.columns if c != "trade_id"]
    last = rows.groupBy("trade_id").agg(F.max_by(F.struct(*fields), F.struct("at", "exit_at", "pnl")).alias("x"))
    return last.select("trade_id", "x.*"), bad
