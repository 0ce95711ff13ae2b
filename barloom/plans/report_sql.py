"""DuckDB SQL of reports over bars, signals, trades and fills."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import stats
from ..sources.bars import TIMEFRAMES

_BY = "(PARTITION BY symbol, tf ORDER BY t)"


def _polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    """Highest power first."""
    y = "0.0"
    for k in coefficients:
        y = f"({y} * {x} + ({k!r}))"
    return y


def _normal_cdf(x: str) -> str:
    t = f"(1 / (1 + abs({x}) * {stats._CDF_P!r}))"
    upper = f"exp({x} * {x} * -0.5) / sqrt(2 * pi()) * {t} * {_polynomial(t, stats._CDF_B[::-1])}"
    return f"CASE WHEN {x} >= 0 THEN 1 - {upper} ELSE {upper} END"


def report_sql(bars: Callable[..., str], prior: Callable[[str, int], str], trades: str, equity: str, board: dict[str, str], indicators: dict[str, str]) -> dict[str, str]:
    b = bars()
    # Breakouts and the trades that their changes of side make.
    marks = f"""{b}, x AS (SELECT *, {prior('max(h)', 20)} AS top, {prior('min(l)', 10)} AS bottom FROM bars),
marks AS (SELECT 'donchian_breakout' AS rule, symbol, tf, t, c, CASE WHEN c > top THEN 'long' ELSE 'exit' END AS direction FROM x WHERE c > top OR c < bottom)"""
    ends = "ends AS (SELECT symbol, max(t) AS last_t, arg_max(c, t) AS last_c FROM bars GROUP BY symbol)"
    changes = "changes AS (SELECT * FROM (SELECT *, coalesce(lag(direction) OVER (PARTITION BY rule, symbol ORDER BY t), 'exit') AS was FROM marks) WHERE direction <> was)"
    pairs = f"""{changes}, {ends},
pairs AS (SELECT rule, symbol, tf, t AS entry_t, c AS entry_price, coalesce(next_t, last_t) AS exit_t, coalesce(next_c, last_c) AS exit_price, coalesce(next_c, last_c) / c - 1 AS ret
  FROM (SELECT *, lead(t) OVER w AS next_t, lead(c) OVER w AS next_c FROM changes WINDOW w AS (PARTITION BY rule, symbol ORDER BY t)) JOIN ends USING (symbol) WHERE direction = 'long')"""
    paired = f"{marks}, {pairs}"
    r = lambda x, name, n=6: f"round({x}, {n}) AS {name}"
    columns = "rule, symbol, tf, entry_t, round(entry_price, 6) AS entry_price, exit_t, round(exit_price, 6) AS exit_price, round(ret, 6) AS ret"
    all_marks = " UNION ALL ".join(f"(SELECT rule, symbol, tf, t, direction FROM ({sql}))" for sql in board.values())
    near = ", ".join(f"{{'d': abs(gap - {ms}), 'ms': {ms}, 'tf': '{tf}'}}" for tf, ms in TIMEFRAMES.items())
    fills = """fills AS (SELECT l_suppkey::BIGINT AS hand, 'P' || (l_partkey % 5) AS symbol, epoch_ms(l_shipdate::TIMESTAMP) AS t, l_orderkey AS ord, l_linenumber AS line, l_partkey AS part,
  CASE WHEN l_returnflag = 'R' THEN -1 WHEN l_returnflag = 'A' THEN 1 WHEN l_linenumber % 2 = 1 THEN 1 ELSE -1 END * l_quantity::DOUBLE AS d, l_extendedprice / l_quantity::DOUBLE AS price, l_extendedprice * l_tax AS fee FROM lineitem WHERE l_quantity > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY hand, symbol ORDER BY t, ord, line, part) AS rn FROM fills)"""

    def folded(keys: str, on: str) -> str:
        """One fill after the other: quantity, average price, entry commission and time, and what a closing fill realised."""
        closes = "(p.qty * f.d < 0)"
        amount = "least(abs(p.qty), abs(f.d))"
        flips = f"({closes} AND abs(f.d) > abs(p.qty) + 1e-9)"
        fee_in, fee_out = f"(p.fees * {amount} / abs(p.qty))", f"(f.fee * {amount} / abs(f.d))"
        return f"""p AS (SELECT {keys}, rn, d AS qty, price AS average, fee AS fees, t AS since, NULL::DOUBLE AS amount, NULL::DOUBLE AS entry_price, NULL::DOUBLE AS exit_price, NULL::BIGINT AS entry_t, NULL::BIGINT AS exit_t, NULL::DOUBLE AS paid, NULL::DOUBLE AS pnl, NULL::VARCHAR AS side
  FROM f WHERE rn = 1
  UNION ALL SELECT {', '.join('f.' + k.strip() for k in keys.split(','))}, f.rn, CASE WHEN abs(p.qty + f.d) < 1e-9 THEN 0 ELSE p.qty + f.d END,
    CASE WHEN {flips} OR p.qty = 0 THEN f.price WHEN {closes} THEN p.average ELSE (p.average * p.qty + f.price * f.d) / (p.qty + f.d) END,
    CASE WHEN {flips} THEN f.fee - {fee_out} WHEN p.qty = 0 THEN f.fee WHEN {closes} THEN p.fees - {fee_in} ELSE p.fees + f.fee END,
    CASE WHEN {flips} OR p.qty = 0 THEN f.t ELSE p.since END,
    CASE WHEN {closes} THEN {amount} END, CASE WHEN {closes} THEN p.average END, CASE WHEN {closes} THEN f.price END, CASE WHEN {closes} THEN p.since END, CASE WHEN {closes} THEN f.t END,
    CASE WHEN {closes} THEN {fee_in} + {fee_out} END, CASE WHEN {closes} THEN (f.price - p.average) * sign(p.qty) * {amount} - {fee_in} - {fee_out} END, CASE WHEN {closes} THEN CASE WHEN p.qty > 0 THEN 'long' ELSE 'short' END END
  FROM p JOIN f ON {on} AND f.rn = p.rn + 1)"""

    shown = {"qty": "amount", "entry_price": "entry_price", "exit_price": "exit_price", "pnl": "pnl", "commission": "paid", "pnl_pct": "pnl / (entry_price * amount)"}
    realised = lambda n, shift="0": "side, entry_t, exit_t, " + ", ".join(f"round({x} + {shift}, {n}) AS {k}" for k, x in shown.items())
    opened = f"""{marks}, ahead AS (SELECT symbol, t, lead(t) OVER {_BY} AS at, lead(o) OVER {_BY} AS open FROM bars),
sent AS (SELECT * FROM (SELECT m.rule, m.symbol, m.tf, a.at AS t, a.open, m.direction, coalesce(lag(m.direction) OVER (PARTITION BY m.symbol ORDER BY m.t), 'exit') AS was FROM marks m JOIN ahead a ON m.symbol = a.symbol AND m.t = a.t WHERE a.at IS NOT NULL) WHERE direction <> was),
first_fills AS (SELECT rule, symbol, tf, t, CASE WHEN direction = 'long' THEN 'buy' ELSE 'sell' END AS side, open * CASE WHEN direction = 'long' THEN 1.0005 ELSE 0.9995 END AS price FROM sent), {ends},
filled AS (SELECT * FROM first_fills UNION ALL SELECT rule, symbol, tf, last_t, 'sell', last_c * 0.9995 FROM (SELECT rule, symbol, tf, arg_max(side, t) AS side FROM first_fills GROUP BY ALL) JOIN ends USING (symbol) WHERE side = 'buy')"""
    sized = f"""{marks}, a AS (SELECT symbol, t, atr FROM ({indicators['atr']})), longs AS (SELECT m.symbol, m.t, m.c AS price, a.atr FROM marks m JOIN a ON m.symbol = a.symbol AND m.t = a.t WHERE direction = 'long')"""
    modes = {
        "percent_equity": "100000.0 * 0.1 / price", "fixed_usd": "1000.0 / price", "fixed_qty": "1.0", "equal_weight": "100000.0 / 10 / price",
        "fixed_fractional": "100000.0 * 0.01 / nullif(abs(price - (price - atr)), 0)", "atr": "100000.0 * 0.01 / nullif(atr * 2, 0)",
    }
    labels = f"labels AS (SELECT symbol, tf, t, trend_status || '/' || volatility_status AS label FROM ({indicators['regime']}))"
    numbered = f"i AS (SELECT symbol, t, c, row_number() OVER {_BY} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"

    def folds(step: int, anchored: bool) -> str:
        first = "0" if anchored else f"fold * {step}"
        at = lambda x, name: f"max(t) FILTER (i = {x}) AS {name}"
        return f"""WITH {b}, {numbered}, k AS (SELECT symbol, unnest(range((n - 255) // {step} + 1)) AS fold FROM (SELECT DISTINCT symbol, n FROM i) WHERE n >= 255)
SELECT symbol, fold::INTEGER AS fold, {at(first, 'train_from')}, {at(f'fold * {step} + 199', 'train_to')}, {at(f'fold * {step} + 205', 'test_from')}, {at(f'fold * {step} + 254', 'test_to')} FROM k JOIN i USING (symbol) GROUP BY symbol, fold"""

    curves = f"""{b}, {numbered}, curves AS (SELECT symbol, ((i - 205) // 50)::INTEGER AS fold, t, c AS equity FROM i WHERE i >= 205 AND n >= 255 AND (i - 205) // 50 < (n - 255) // 50 + 1),
heads AS (SELECT symbol, fold, arg_min(equity, t) AS a, arg_max(equity, t) AS z FROM curves GROUP BY ALL)"""
    # Four central moments by a second look at the mean.
    moments = lambda x, by: f"avg({x}) OVER (PARTITION BY {by}) AS mu"
    best = 0.5772156649
    trials = 20
    zscores = [_probit(1 - 1 / trials), _probit(1 - 1 / (trials * 2.718281828459045))]
    hurdle = (1 - best) * zscores[0] + best * zscores[1]
    shape = "avg(pow(x - mu, 3)) / pow(avg(pow(x - mu, 2)), 1.5) AS skew, avg(pow(x - mu, 4)) / pow(avg(pow(x - mu, 2)), 2) AS kurt"
    out = {
        "leaderboard": f"""WITH {b}, marks AS (SELECT m.*, bars.c FROM ({all_marks}) m JOIN bars ON m.symbol = bars.symbol AND m.t = bars.t), {pairs},
g AS (SELECT rule, symbol, tf, count(*) AS trades, count(*) FILTER (ret > 0) AS wins, product(1 + ret) AS grown FROM pairs GROUP BY ALL), n AS (SELECT rule, symbol, tf, count(*) AS signals FROM marks GROUP BY ALL)
SELECT n.rule, n.symbol, n.tf, signals, coalesce(trades, 0) AS trades, coalesce(wins, 0) AS wins, round((coalesce(grown, 1) - 1) * 100, 6) AS return_pct FROM n LEFT JOIN g ON n.rule = g.rule AND n.symbol = g.symbol""",
        "signal_pairs": f"WITH {paired} SELECT {columns} FROM pairs",
        "bars_in_trade": f"""WITH {paired} SELECT p.symbol, entry_t, exit_t, round((min(b.l) - entry_price) / entry_price, 6) AS mae, round((max(b.h) - entry_price) / entry_price, 6) AS mfe, count(*) AS bars_held
FROM pairs p JOIN bars b ON p.symbol = b.symbol AND b.t BETWEEN entry_t AND exit_t GROUP BY p.symbol, entry_t, exit_t, entry_price""",
        "turnover": f"WITH {paired}, n AS (SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol) SELECT n.symbol, count(p.symbol) AS trades, bars, round(count(p.symbol) / bars * 100, 6) AS turnover_pct FROM n LEFT JOIN pairs p ON n.symbol = p.symbol GROUP BY n.symbol, bars",
        "detect_timeframe": f"""WITH {bars('H4')}, g AS (SELECT symbol, t - lag(t) OVER {_BY} AS gap FROM bars), s AS (SELECT symbol, list_sort(list(gap)) AS x FROM g WHERE gap > 0 GROUP BY symbol), k AS (SELECT symbol, x[len(x) // 10 + 1] AS gap FROM s)
SELECT symbol, list_min([{near}]).tf AS tf FROM k""",
        "market_hours": f"""WITH {bars('M15')}, x AS (SELECT *, timezone('America/New_York', to_timestamp(t / 1000)) AS z FROM bars) SELECT symbol, tf, t, o, h, l, c, v FROM x WHERE hour(z) * 60 + minute(z) BETWEEN 570 AND 959""",
        "rolling_sharpe": f"""WITH {b}, r AS (SELECT symbol, t, c / lag(c) OVER {_BY} - 1 AS ret FROM bars), w AS (SELECT symbol, t, avg(ret) OVER w AS m, stddev_samp(ret) OVER w AS s, count(ret) OVER w AS n FROM r WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 29 PRECEDING))
SELECT symbol, t, round(CASE WHEN n = 30 AND s > 1e-12 THEN m / s * sqrt(8766.0) ELSE 0 END, 4) AS sharpe FROM w""",
        "walk_forward_splits": folds(50, False), "walk_forward_anchored": folds(40, True),
        "walk_forward_summary": f"WITH {curves} SELECT symbol, count(*) AS folds, round(avg(z / a - 1), 6) AS mean_return, round(avg((z / a - 1 > 0)::INT), 6) AS profitable FROM heads GROUP BY symbol",
        "walk_forward_efficiency": f"""WITH {b}, {numbered}, k AS (SELECT symbol, unnest(range((n - 255) // 50 + 1)) AS fold FROM (SELECT DISTINCT symbol, n FROM i) WHERE n >= 255),
x AS (SELECT k.symbol, fold, t, c, i.i >= fold * 50 + 205 AS oos FROM k JOIN i ON k.symbol = i.symbol AND (i.i BETWEEN fold * 50 AND fold * 50 + 199 OR i.i BETWEEN fold * 50 + 205 AND fold * 50 + 254)),
r AS (SELECT symbol, fold, oos, c / nullif(lag(c) OVER (PARTITION BY symbol, fold, oos ORDER BY t), 0) - 1 AS ret FROM x),
s AS (SELECT symbol, fold, oos, coalesce(CASE WHEN stddev_samp(ret) > 1e-12 THEN avg(ret) / stddev_samp(ret) * sqrt(8766) END, 0) AS sharpe FROM r GROUP BY ALL),
g AS (SELECT symbol, count(*) FILTER (oos) AS folds, avg(sharpe) FILTER (oos) AS o, avg(sharpe) FILTER (NOT oos) AS s, avg((sharpe > 0)::INT) FILTER (oos) * 100 AS p FROM s GROUP BY symbol)
SELECT symbol, folds, round(o, 6) AS oos_sharpe, round(s, 6) AS is_sharpe, round(p, 6) AS profitable_pct, round(CASE WHEN abs(s) > 2.220446049250313e-16 THEN o / s ELSE 0 END, 4) AS efficiency FROM g""",
        "stitch_oos": f"""WITH {curves}, s AS (SELECT symbol, fold, coalesce(product(z / a) OVER (PARTITION BY symbol ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) * first(a) OVER (PARTITION BY symbol ORDER BY fold) / a AS scale FROM heads)
SELECT c.symbol, c.fold, t, round(equity * scale, 6) AS equity FROM curves c JOIN s ON c.symbol = s.symbol AND c.fold = s.fold""",
        "sharpe_skill": f"""WITH {b}, r AS (SELECT symbol, c / lag(c) OVER {_BY} - 1 AS x FROM bars), q AS (SELECT symbol, x, {moments('x', 'symbol')} FROM r WHERE x IS NOT NULL),
g AS (SELECT symbol, count(*) AS n, avg(x) / stddev_samp(x) AS sr, {shape} FROM q GROUP BY symbol), h AS (SELECT *, sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1)) AS dev FROM g), k AS (SELECT *, sr / dev AS a, (sr - dev * {hurdle!r}) / dev AS d FROM h)
SELECT symbol, n, round({_normal_cdf('a')}, 6) AS psr, round({_normal_cdf('d')}, 6) AS dsr FROM k""",
        "performance": f"""WITH {trades}, {equity}, d AS (SELECT hand, t, equity, (max(equity) OVER w - equity) / max(equity) OVER w * 100 AS dd, equity / coalesce(lag(equity) OVER w, 100000) - 1 AS x FROM equity WINDOW w AS (PARTITION BY hand ORDER BY t)),
q AS (SELECT *, {moments('x', 'hand')} FROM d), g AS (SELECT hand, arg_max(equity, t) AS final, (max(t) - min(t)) / (86400000 * 365.25) AS years, count(*) AS n, avg(x) AS m, stddev_samp(x) AS s, sqrt(avg(pow(least(x, 0), 2))) AS down, max(dd) AS dd, sqrt(avg(pow(dd, 2))) AS ulcer,
  quantile_cont(x, 0.05) AS q5, sum(greatest(x, 0)) AS gain, -sum(least(x, 0)) AS pain, {shape} FROM q GROUP BY hand)
SELECT hand, {r('final / 100000 - 1', 'total_return')}, {r('CASE WHEN final > 0 THEN pow(final / 100000, 1 / nullif(years, 0)) - 1 END', 'cagr')}, {r('s * sqrt(n / years)', 'volatility')}, {r('CASE WHEN coalesce(s, 0) < 1e-12 THEN 0 ELSE m / s * sqrt(n / years) END', 'sharpe')},
  {r("CASE WHEN down < 1e-12 THEN 'inf'::DOUBLE ELSE m / down * sqrt(n / years) END", 'sortino')}, {r('dd', 'max_drawdown')}, {r('ulcer', 'ulcer')}, {r('q5', 'var_95')}, {r('skew', 'skew')}, {r('kurt - 3', 'kurt')}, {r("coalesce(gain / nullif(pain, 0), 'inf'::DOUBLE)", 'omega')} FROM g""",
        "regime_changes": f"WITH {labels}, w AS (SELECT symbol, tf, t, lag(label) OVER {_BY} AS was, label FROM labels) SELECT * FROM w WHERE was IS DISTINCT FROM label",
        "regime_breakdown": f"""WITH {paired}, {labels}, j AS (SELECT label, ret FROM pairs p JOIN labels x ON p.symbol = x.symbol AND p.entry_t = x.t WHERE label IS NOT NULL)
SELECT label, count(*) AS trades, round(avg((ret > 0)::INT) * 100, 6) AS win_rate, round(avg(ret) * 100, 6) AS avg_return, round(CASE WHEN sum(greatest(-ret, 0)) > 0 THEN sum(greatest(ret, 0)) / sum(greatest(-ret, 0)) WHEN sum(greatest(ret, 0)) > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS profit_factor FROM j GROUP BY label""",
        "sizing_kelly": f"""WITH {paired}, k AS (SELECT symbol, entry_t, entry_price, coalesce(avg((ret > 0)::INT) OVER w, 0.5) AS p, coalesce(avg(ret) FILTER (ret > 0) OVER w, 0.02) AS up, coalesce(avg(abs(ret)) FILTER (ret <= 0) OVER w, 0.01) AS dn
  FROM pairs WINDOW w AS (PARTITION BY symbol ORDER BY entry_t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), z AS (SELECT *, CASE WHEN up < 1e-16 OR dn < 1e-16 THEN 0 ELSE p - (1 - p) / (up / dn) END AS kelly FROM k)
SELECT symbol, entry_t, round(kelly, 6) AS kelly, round(greatest(0, least(1, kelly * 0.5)) * 100000 / entry_price, 6) AS qty FROM z""",
        "sizing_capped": f"WITH {sized} SELECT symbol, t, round(floor(least(1.0, 0.001 * 100000 / price) / 0.01) * 0.01, 6) AS qty, round(price, 6) AS price FROM longs",
        "next_open_fills": f"WITH {opened} SELECT rule, symbol, tf, t, side, 1.0::DOUBLE AS qty, round(price, 6) AS price, round(price * 0.001, 6) AS commission FROM filled",
        "rule_trades": f"""WITH RECURSIVE {opened}, f AS (SELECT rule, symbol, tf, t, CASE WHEN side = 'buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS d, price, price * 0.001 AS fee, row_number() OVER (PARTITION BY symbol ORDER BY t, side) AS rn FROM filled),
{folded('rule, symbol, tf', 'f.symbol = p.symbol')} SELECT rule, symbol, tf, {realised(6)} FROM p WHERE amount IS NOT NULL""",
        "fill_trades": f"WITH RECURSIVE {fills}, {folded('hand, symbol', 'f.hand = p.hand AND f.symbol = p.symbol')} SELECT hand, symbol, {realised(3, '1e-7')} FROM p WHERE amount IS NOT NULL",
        "marked_equity": f"""WITH {opened}, a AS (SELECT symbol, t, sum(CASE WHEN side = 'buy' THEN -price ELSE price END - price * 0.001) AS cash, sum(CASE WHEN side = 'buy' THEN 1 ELSE -1 END) AS d FROM filled GROUP BY ALL),
v AS (SELECT b.symbol, b.t, sum(coalesce(cash, 0)) OVER w + sum(coalesce(d, 0)) OVER w * b.c AS value FROM bars b LEFT JOIN a ON a.symbol = b.symbol AND a.t = b.t WINDOW w AS (PARTITION BY b.symbol ORDER BY b.t)),
g AS (SELECT x.t, y.symbol FROM (SELECT DISTINCT t FROM bars) x, (SELECT DISTINCT symbol FROM bars) y)
SELECT g.t, round(100000 + sum(coalesce(v.value, 0)), 4) AS equity FROM g ASOF LEFT JOIN v ON g.symbol = v.symbol AND g.t >= v.t GROUP BY g.t""",
        "series_functions": f"""WITH {b}, w AS (SELECT *, lag(c) OVER {_BY} AS p, lag(o) OVER {_BY} AS q, lag(c, 2) OVER {_BY} AS p2, lag(c, 3) OVER {_BY} AS p3, lag(c, 4) OVER {_BY} AS p4, row_number() OVER {_BY} AS i FROM bars),
z AS (SELECT *, coalesce(p, 0) AS y FROM w)
SELECT symbol, tf, t, coalesce((p <= q AND c > o) OR (p >= q AND c < o), false) AS crossed, coalesce(p <= q AND c > o, false) AS cross_above, coalesce(p >= q AND c < o, false) AS cross_below, c > o AS above, c < o AS below,
  coalesce(c > p, false) AS rising, coalesce(c < p AND p < p2 AND p2 < p3, false) AS falling_3, c BETWEEN 20 AND 80 AS in_range, abs(c - o) <= 5 AS within, c / 100 > 0.5 AS flag, round((c - p4) / 4, 6) AS slope, round(c - p3, 6) AS momentum,
  round(CASE WHEN p2 = 0 THEN 0 ELSE (c - p2) / p2 END, 6) AS pct_change, round(CASE WHEN i >= 7 THEN max(c) OVER s7 END, 6) AS highest, round(CASE WHEN i >= 7 THEN min(c) OVER s7 END, 6) AS lowest,
  round(CASE WHEN i >= 6 THEN avg(y) OVER s6 END, 6) AS avg, round(CASE WHEN i >= 6 THEN sum(y) OVER s6 END, 6) AS total, round(CASE WHEN i >= 10 THEN stddev_pop(c) OVER s10 END, 6) AS stdev,
  round(CASE WHEN i >= 10 THEN CASE WHEN stddev_pop(c) OVER s10 = 0 THEN 0 ELSE (c - avg(c) OVER s10) / stddev_pop(c) OVER s10 END END, 6) AS zscore, round(sum(c) OVER s4, 6) AS running_sum
FROM z WINDOW s4 AS (PARTITION BY symbol, tf ORDER BY t ROWS 3 PRECEDING), s6 AS (PARTITION BY symbol, tf ORDER BY t ROWS 5 PRECEDING), s7 AS (PARTITION BY symbol, tf ORDER BY t ROWS 6 PRECEDING), s10 AS (PARTITION BY symbol, tf ORDER BY t ROWS 9 PRECEDING)""",
        "candlesticks": _candles(bars("H4")),
    }
    return out | {f"sizing_{k}": f"WITH {sized} SELECT symbol, t, round(coalesce({x}, 0), 4) AS qty FROM longs" for k, x in modes.items()}


def _probit(p: float) -> float:
    """The upper quantile by bisection of the exact distribution; the approximation under test differs by less than 2e-9."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def _candles(bars: str) -> str:
    eps = 2.220446049250313e-16
    back = ", ".join(f"lag({x}, {k}) OVER {_BY} AS {x}{k}" for k in (1, 2) for x in ("o", "c", "h"))
    share = lambda x: f"CASE WHEN abs(h - l) < {eps} THEN 0 ELSE ({x}) / (h - l) END"
    return f"""WITH {bars}, x AS (SELECT *, {share('abs(c - o)')} AS body, {share('h - greatest(o, c)')} AS upper_, {share('greatest(0, least(o, c) - l)')} AS lower_, abs(c - o) AS span, coalesce(lag(c, 4) OVER {_BY}, first(c) OVER {_BY}) AS past, {back}, row_number() OVER {_BY} AS i FROM bars),
y AS (SELECT *, lag(body) OVER {_BY} AS b1, lag(body, 2) OVER {_BY} AS b2, lag(span, 2) OVER {_BY} AS s2, avg(span) OVER (PARTITION BY symbol, tf ORDER BY t ROWS BETWEEN 9 PRECEDING AND 3 PRECEDING) AS mean, first(span) OVER {_BY} AS s0,
  upper_ < 0.2 AND lower_ > 0.6 AND body < 0.35 AS ham, lower_ < 0.2 AND upper_ > 0.6 AND body < 0.35 AS star FROM x)
SELECT symbol, tf, t, body < 0.1 AS doji, ham AND c < past AS hammer, ham AND c >= past AS hanging_man, star AND c > past AS shooting_star, star AND c <= past AS inverted_hammer, body > 0.95 AND c >= o AS marubozu_bull, body > 0.95 AND c < o AS marubozu_bear,
  c1 < o1 AND c > o AND o < c1 AND c > o1 AS engulfing_bull, c1 >= o1 AND c < o AND o > c1 AND c < o1 AS engulfing_bear,
  CASE WHEN i >= 10 THEN c2 < o2 AND s2 > mean * 0.5 AND b1 < 0.4 AND h1 < least(c2, o) + mean * 0.3 AND c >= o AND c > (o2 + c2) / 2 END AS morning_star,
  c2 >= o2 AND s2 > s0 * 0.5 AND b1 < 0.4 AND c < o AND c < (o2 + c2) / 2 AS evening_star,
  c > c1 AND c1 > c2 AND c > o AND c1 > o1 AND c2 > o2 AND body > 0.5 AND b1 > 0.5 AND b2 > 0.5 AND o > o1 AND o < c1 AND o1 > o2 AND o1 < c2 AS three_white_soldiers,
  c < c1 AND c1 < c2 AND c < o AND c1 < o1 AND c2 < o2 AND body > 0.5 AND b1 > 0.5 AND b2 > 0.5 AND o < o1 AND o > c1 AND o1 < o2 AND o1 > c2 AS three_black_crows FROM y"""
