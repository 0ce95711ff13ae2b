"""DuckDB SQL of indicators and rules, built as layers: each layer is a table expression with more columns over the one before."""

from __future__ import annotations

import math
from functools import reduce

_BY = "(PARTITION BY symbol, tf ORDER BY t)"
_EPS = 2.220446049250313e-16


def _over(n: int) -> str:
    return f"(PARTITION BY symbol, tf ORDER BY t ROWS {n - 1} PRECEDING)"


def roll(agg: str, x: str, n: int) -> str:
    """An aggregate of a column over n rows, null until all are known."""
    return f"CASE WHEN count({x}) OVER {_over(n)} = {n} THEN {agg}({x}) OVER {_over(n)} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER {_BY}" if k else x


def dot(x: str, weights: list[float]) -> str:
    """Σ weight·value, oldest first, null until all are known."""
    n = len(weights)
    return f"CASE WHEN count({x}) OVER {_over(n)} = {n} THEN " + " + ".join(f"{w!r} * {lag(x, n - 1 - i)}" for i, w in enumerate(weights)) + " END"


def wma(x: str, n: int) -> str:
    return dot(x, [2 * k / (n * (n + 1)) for k in range(1, n + 1)])


def ratio(a: str, b: str, flat: float = 0.0) -> str:
    return f"CASE WHEN abs({b}) < {_EPS} THEN {flat} ELSE ({a}) / ({b}) END"


def percent_k(hh: str, ll: str) -> str:
    return f"CASE WHEN {hh} IS NOT NULL THEN least(100, greatest(0, {ratio(f'(c - {ll}) * 100', f'({hh} - {ll})', 50.0)})) END"


class Layers:
    def __init__(self, bars: str):
        self.tables, self.at, self.n = [bars], "bars", 0

    def add(self, **columns: str) -> Layers:
        self.n += 1
        self.tables.append(f"s{self.n} AS (SELECT *, {', '.join(f'{x} AS {k}' for k, x in columns.items())} FROM {self.at})")
        self.at = f"s{self.n}"
        return self

    def smooth(self, name: str, x: str, n: int, alpha: float | None = None) -> Layers:
        """The mean of the first n known values, then y += alpha·(x - y); an EMA where no alpha is given."""
        self.n += 1
        a, i = 2 / (n + 1) if alpha is None else alpha, self.n
        self.tables.append(f"r{i} AS (SELECT symbol, tf, t, x, row_number() OVER {_BY} AS rn, avg(x) OVER {_over(n)} AS m FROM (SELECT symbol, tf, t, {x} AS x FROM {self.at}) WHERE x IS NOT NULL)")
        self.tables.append(f"""e{i} AS (SELECT symbol, tf, t, rn, m AS y FROM r{i} WHERE rn = {n}
  UNION ALL SELECT r.symbol, r.tf, r.t, r.rn, {a!r} * r.x + {1 - a!r} * e.y FROM e{i} e JOIN r{i} r ON r.symbol = e.symbol AND r.tf = e.tf AND r.rn = e.rn + 1)""")
        self.tables.append(f"s{i} AS (SELECT s.*, e.y AS {name} FROM {self.at} s LEFT JOIN e{i} e ON s.symbol = e.symbol AND s.tf = e.tf AND s.t = e.t)")
        self.at = f"s{i}"
        return self

    def fold(self, inputs: dict[str, str], first: dict[str, str], step: dict[str, str], where: str = "true") -> Layers:
        """Recursive columns: ``first`` on the first row of a series (of those ``where``), then ``step`` from the row before, e, and the row, r."""
        self.n += 1
        i = self.n
        given = "".join(f", {x} AS {k}" for k, x in inputs.items())
        self.tables.append(f"r{i} AS (SELECT *, row_number() OVER {_BY} AS rn FROM (SELECT symbol, tf, t{given} FROM {self.at} WHERE {where}))")
        self.tables.append(f"""e{i} AS (SELECT r.symbol, r.tf, r.t, r.rn, {', '.join(f'{x} AS {k}' for k, x in first.items())} FROM r{i} r WHERE r.rn = 1
  UNION ALL SELECT r.symbol, r.tf, r.t, r.rn, {', '.join(step.values())} FROM e{i} e JOIN r{i} r ON r.symbol = e.symbol AND r.tf = e.tf AND r.rn = e.rn + 1)""")
        self.tables.append(f"s{i} AS (SELECT s.*, {', '.join(f'e.{k}' for k in first)} FROM {self.at} s LEFT JOIN e{i} e ON s.symbol = e.symbol AND s.tf = e.tf AND s.t = e.t)")
        self.at = f"s{i}"
        return self

    def scan(self, name: str, q: str, b: str) -> Layers:
        """y = q·y + b from 0 on."""
        return self.fold({"q_": q, "b_": b}, {name: "r.b_"}, {name: f"r.q_ * e.{name} + r.b_"})

    def sql(self, plain: tuple[str, ...] = (), **columns: str) -> str:
        """``plain`` names the columns that aren't rounded."""
        out = ", ".join(f"{x} AS {k}" if k in plain else f"round({x}, 6) AS {k}" for k, x in columns.items())
        return f"WITH RECURSIVE {', '.join(self.tables)} SELECT symbol, tf, t, {out} FROM {self.at}"

    def rule(self, name: str, entry: str, leave: str, strength: str = "1.0", latched: bool = False, more: str = "") -> str:
        """One signal a bar, entries first; latched rules enter while out and leave while in."""
        power = f"round(least(1, greatest(0, {strength})), 6)"
        self.add(entry_=f"coalesce({entry}, false)", leave_=f"coalesce({leave}, false)")
        if latched:
            held = "CASE WHEN e.held_ THEN NOT r.b_ ELSE r.a_ END"
            self.fold({"a_": "entry_", "b_": "leave_"}, {"held_": "r.a_", "in_": "r.a_", "out_": "false"}, {"held_": held, "in_": "NOT e.held_ AND r.a_", "out_": "e.held_ AND r.b_"})
        a, b = ("in_", "out_") if latched else ("entry_", "leave_")
        return f"""WITH RECURSIVE {', '.join(self.tables)} SELECT symbol, tf, t, '{name}' AS rule, CASE WHEN {a} THEN 'long' ELSE 'exit' END AS direction,
  CASE WHEN {a} THEN {power} ELSE 1.0 END::DOUBLE AS strength{more} FROM {self.at} WHERE {a} OR {b}"""


# Layers that indicators and rules share.
_P = lag("c")
_TR = f"greatest(h - l, abs(h - {_P}), abs(l - {_P}))"
_TR_NEXT = f"CASE WHEN {_P} IS NOT NULL THEN {_TR} END"


def known(x: str, test: str) -> str:
    return f"CASE WHEN {test} IS NOT NULL THEN {x} END"


def change(n: int) -> str:
    return f"CASE WHEN {lag('c', n)} = 0 THEN 0 ELSE (c - {lag('c', n)}) / {lag('c', n)} * 100 END"


def with_rsi(s: Layers, x: str = "c", n: int = 14, name: str = "rsi") -> Layers:
    s.add(**{f"{name}_m": f"{x} - {lag(x)}"})
    for side, sign in (("g", ""), ("d", "-")):
        s.smooth(f"{name}_{side}", f"greatest({sign}{name}_m, 0) + 0 * {name}_m", n, 1 / n)
    return s.add(**{name: f"CASE WHEN abs({name}_d) < {_EPS} THEN 100 ELSE 100 - 100 / (1 + {name}_g / {name}_d) END"})


def with_adx(s: Layers) -> Layers:
    s.add(trn=_TR_NEXT, upm=f"h - {lag('h')}", dnm=f"{lag('l')} - l")
    s.add(pdm="CASE WHEN upm > dnm AND upm > 0 THEN upm WHEN upm IS NOT NULL THEN 0.0 END", mdm="CASE WHEN dnm > upm AND dnm > 0 THEN dnm WHEN upm IS NOT NULL THEN 0.0 END")
    for name, x in (("sa", "trn"), ("sx", "pdm"), ("sy", "mdm")):
        s.smooth(name, x, 14, 1 / 14)
    s.add(pd0=known(ratio("100 * sx", "sa"), "sa"), md0=known(ratio("100 * sy", "sa"), "sa")).add(dx=known(ratio("100 * abs(pd0 - md0)", "(pd0 + md0)"), "pd0")).smooth("adx", "dx", 14, 1 / 14)
    return s.add(pdi=known("pd0", "adx"), mdi=known("md0", "adx"))


def with_cci(s: Layers) -> Layers:
    items = f"CASE WHEN count(tp) OVER {_over(20)} = 20 THEN list(tp) OVER {_over(20)} END"
    return s.add(tp="(h + l + c) / 3").add(cm=roll("avg", "tp", 20), cx=items).add(cd="list_avg(list_transform(cx, lambda z: abs(z - cm)))").add(cci="CASE WHEN cm IS NULL THEN NULL WHEN cd = 0 THEN 0 ELSE (tp - cm) / (0.015 * cd) END")


def with_chop(s: Layers) -> Layers:
    inner = f"100 * log10(cs / (chh - cll)) / {math.log10(14)!r}"
    return s.add(ctr=_TR).add(cs=roll("sum", "ctr", 14), chh=roll("max", "h", 14), cll=roll("min", "l", 14)).add(chop=known(f"CASE WHEN abs(chh - cll) < {_EPS} THEN 100 ELSE least(100, greatest(0, {inner})) END", "cs"))


def with_vwap(s: Layers, gap_minutes: int) -> Layers:
    s.add(gap_=f"coalesce((t - {lag('t')} > {gap_minutes} * 60000)::INT, 0)").add(ses=f"sum(gap_) OVER {_BY}")
    by = "(PARTITION BY symbol, tf, ses ORDER BY t)"
    return s.add(pvs=f"sum((h + l + c) / 3 * v) OVER {by}", vvs=f"sum(v) OVER {by}").add(vwap="CASE WHEN vvs = 0 THEN c ELSE pvs / vvs END")


def with_kama(s: Layers) -> Layers:
    s.add(mv=f"abs(c - {lag('c', 10)})", stp=f"abs(c - {_P})").add(pth=roll("sum", "stp", 10), c11=roll("avg", "c", 11))
    s.add(sc=known(f"pow(least(1, greatest(0, {ratio('mv', 'pth')})) * (2 / 3.0::DOUBLE - 2 / 31.0::DOUBLE) + 2 / 31.0::DOUBLE, 2)", "pth")).add(sn=f"count(sc) OVER {_BY}")
    return s.scan("ky", "CASE WHEN sn = 0 THEN 1 ELSE 1 - sc END", "CASE WHEN sn = 0 THEN 0 WHEN sn = 1 THEN sc * c + (1 - sc) * c11 ELSE sc * c END").add(kama="CASE WHEN sn > 0 THEN ky END")


def with_heiken(s: Layers) -> Layers:
    s.add(hc="(o + h + l + c) / 4", hn=f"row_number() OVER {_BY}").add(hp=lag("hc"))
    return s.scan("ho", "CASE WHEN hn = 1 THEN 1 ELSE 0.5 END", "CASE WHEN hn = 1 THEN (o + c) / 2 ELSE hp / 2 END").add(hb="hc >= ho")


def with_supertrend(s: Layers, n: int = 10, mult: float = 3.0) -> Layers:
    s.add(str_=_TR).smooth("sta", "str_", n, 1 / n)
    keep = "CASE WHEN e.bull THEN NOT (r.x < e.dn) ELSE r.x > e.up END"
    s.fold(
        {"top": f"(h + l) / 2 + {mult} * sta", "bot": f"(h + l) / 2 - {mult} * sta", "x": "c"}, {"bull": "r.x > r.bot", "up": "r.top", "dn": "r.bot"},
        {"bull": keep, "up": f"CASE WHEN NOT e.bull AND NOT ({keep}) THEN least(r.top, e.up) ELSE r.top END", "dn": f"CASE WHEN e.bull AND {keep} THEN greatest(r.bot, e.dn) ELSE r.bot END"}, "sta IS NOT NULL",
    )
    return s.add(st="CASE WHEN bull THEN dn ELSE up END")


def with_sar(s: Layers, step: float = 0.02, most: float = 0.2) -> Layers:
    """One row holds the state after it; the second bar seeds it."""
    s.add(**{f"{x}{k}": lag(x, k) for x in "hl" for k in (1, 2)}, sn=f"row_number() OVER {_BY}")
    raw = "e.sar + e.af * (e.ep - e.sar)"
    bound = f"CASE WHEN e.rise THEN least({raw}, r.l1, r.l2) ELSE greatest({raw}, r.h1, r.h2) END"
    flips = f"CASE WHEN e.rise THEN r.low_ < {bound} ELSE r.high_ > {bound} END"
    best = "CASE WHEN e.rise THEN r.high_ > e.ep ELSE r.low_ < e.ep END"
    own = "CASE WHEN e.rise THEN r.high_ ELSE r.low_ END"
    s.fold(
        {"high_": "h", "low_": "l", "h1": "h1", "l1": "l1", "h2": "h2", "l2": "l2"}, {"sar": "least(r.l1, r.low_)", "ep": "r.high_", "af": f"{step}::DOUBLE", "rise": "true"},
        {"sar": f"CASE WHEN {flips} THEN e.ep ELSE {bound} END", "ep": f"CASE WHEN {flips} THEN CASE WHEN e.rise THEN r.low_ ELSE r.high_ END WHEN {best} THEN {own} ELSE e.ep END",
         "af": f"CASE WHEN {flips} THEN {step} WHEN {best} THEN least({most}, e.af + {step}) ELSE e.af END", "rise": f"e.rise <> ({flips})"}, "sn > 1",
    )
    return s


def with_fisher(s: Layers, n: int) -> Layers:
    s.add(fm="(h + l) / 2").add(fh=roll("max", "fm", n), fl=roll("min", "fm", n)).add(raw=known(f"CASE WHEN fh - fl >= {_EPS} THEN 2 * ((fm - fl) / (fh - fl) - 0.5) ELSE 0 END", "fh"))
    v = "least(0.999, greatest(-0.999, 0.33 * r.w + 0.67 * e.fv))"
    first = "least(0.999, greatest(-0.999, 0.33 * r.w))"
    return s.fold({"w": "raw"}, {"fv": first, "fisher": f"0.5 * ln((1 + {first}) / (1 - {first}))", "fsig": "0.0::DOUBLE"}, {"fv": v, "fisher": f"0.5 * ln((1 + {v}) / (1 - {v})) + 0.5 * e.fisher", "fsig": "e.fisher"}, "raw IS NOT NULL")


def with_connors(s: Layers) -> Layers:
    s.add(sg=f"coalesce(sign(c - {_P}), 0)").add(tn=f"(sg <> coalesce({lag('sg')}, 0))::INT").add(run=f"sum(tn) OVER {_BY}")
    s.add(len_="sg * count(*) OVER (PARTITION BY symbol, tf, run ORDER BY t)", chg=change(1)).add(pch=lag("chg"))
    s.add(past=f"CASE WHEN count(pch) OVER {_over(100)} = 100 THEN list(pch) OVER {_over(100)} END")
    return with_rsi(with_rsi(s, "c", 3, "ra"), "len_", 2, "rb").add(crsi="CASE WHEN past IS NOT NULL THEN (ra + rb + len(list_filter(past, lambda z: z < chg))) / 3 END")


def with_alligator(s: Layers) -> Layers:
    s.add(am="(h + l) / 2")
    for name, n in (("aj", 13), ("at_", 8), ("al", 5)):
        s.smooth(name, "am", n, 1 / n)
    return s.add(jaw=lag("aj", 8), teeth=lag("at_", 5), lips=lag("al", 3)).add(gator="lips > teeth AND teeth > jaw")


_SHORT, _LONG = (3, 5, 8, 10, 12, 15), (30, 35, 40, 45, 50, 60)


def with_gmma(s: Layers) -> Layers:
    for n in _SHORT + _LONG:
        s.smooth(f"g{n}", "c", n)
    names = lambda ns: ", ".join(f"g{n}" for n in ns)
    return s.add(gbull=known(f"least({names(_SHORT)}) > greatest({names(_LONG)})", "g60"), gbear=known(f"greatest({names(_SHORT)}) < least({names(_LONG)})", "g60"))


def with_regime(s: Layers) -> Layers:
    with_chop(with_adx(s)).smooth("v14", "ctr", 14, 1 / 14).smooth("v50", "ctr", 50, 1 / 50)
    s.add(vr=f"coalesce(CASE WHEN abs(v50) < {_EPS} THEN 1.0 ELSE v14 / v50 END, 1.0)", tv="CASE WHEN adx > 25 THEN adx WHEN chop > 61.8 THEN chop ELSE adx END", ts="CASE WHEN adx > 25 THEN 'trending' WHEN chop > 61.8 THEN 'ranging' ELSE 'neutral' END")
    return s.add(vs="CASE WHEN vr > 1.3 THEN 'high' WHEN vr < 0.7 THEN 'low' ELSE 'normal' END")


def kalman(s: Layers) -> Layers:
    """Position and velocity, and their covariance a, b, d, with process noise 0.001 and measurement noise 1."""
    a, b, d = "(e.a + 2 * e.b + e.d + 0.001)", "(e.b + e.d)", "(e.d + 0.001)"
    gap = "(r.z - (e.x + e.u))"
    k0, k1 = f"({a} / ({a} + 1))", f"({b} / ({a} + 1))"
    return s.fold({"z": "c"}, {"x": "r.z", "u": "0.0::DOUBLE", "a": "1.0::DOUBLE", "b": "0.0::DOUBLE", "d": "1.0::DOUBLE"}, {
        "x": f"e.x + e.u + {k0} * {gap}", "u": f"e.u + {k1} * {gap}", "a": f"(1 - {k0}) * {a}", "b": f"(1 - {k0}) * {b}", "d": f"{d} - {k1} * {b}",
    })


def rank_correlation(n: int) -> str:
    """100·(1 - 6·Σ(rank - place)² / (n·(n² - 1))) over the last n closes, equal ones ranked in their order; ``q{n}`` is their list."""
    rank = f"len(list_filter(q{n}, lambda y, j: y < x OR (y = x AND j < i)))"
    return f"CASE WHEN q{n} IS NOT NULL THEN least(100, greatest(-100, (1 - 6 * list_sum(list_transform(q{n}, lambda x, i: pow({rank} - (i - 1), 2))) / {n * (n * n - 1)}.0) * 100)) END"


def indicator_sql(bars: str) -> dict[str, str]:
    new = lambda: Layers(bars)
    p = lag("c")
    tr = f"greatest(h - l, abs(h - {p}), abs(l - {p}))"
    tr_next = f"CASE WHEN {p} IS NOT NULL THEN {tr} END"
    roc = lambda n: f"CASE WHEN {lag('c', n)} = 0 THEN 0 ELSE (c - {lag('c', n)}) / {lag('c', n)} * 100 END"
    mid = lambda n: f"({roll('max', 'h', n)} + {roll('min', 'l', n)}) / 2"
    four = lambda x: f"({x} + 2 * {lag(x, 1)} + 2 * {lag(x, 2)} + {lag(x, 3)}) / 6"
    gauss = [math.exp(-((i - 6) ** 2) / (2 * 1.5**2)) for i in range(9)]
    below = sum((i - 12) ** 2 for i in range(25))
    rsi = lambda x, n: new().add(move=f"{x} - {lag(x)}").smooth("gain", "greatest(move, 0) + 0 * move", n, 1 / n).smooth("loss", "greatest(-move, 0) + 0 * move", n, 1 / n).add(
        rsi=f"CASE WHEN abs(loss) < {_EPS} THEN 100 ELSE 100 - 100 / (1 + gain / loss) END"
    )
    macd = lambda fast, slow, sig, line: new().smooth("a", "c", fast).smooth("b", "c", slow).add(x=line).smooth("z", "x", sig)
    known = lambda x, test: f"CASE WHEN {test} IS NOT NULL THEN {x} END"
    directional = lambda: new().add(
        tr=tr_next, up=f"h - {lag('h')}", dn=f"{lag('l')} - l"
    ).add(pdm="CASE WHEN up > dn AND up > 0 THEN up WHEN up IS NOT NULL THEN 0.0 END", mdm="CASE WHEN dn > up AND dn > 0 THEN dn WHEN up IS NOT NULL THEN 0.0 END"
    ).smooth("a", "tr", 14, 1 / 14).smooth("x", "pdm", 14, 1 / 14).smooth("y", "mdm", 14, 1 / 14).add(pdi=known(ratio("100 * x", "a"), "a"), mdi=known(ratio("100 * y", "a"), "a"))
    rvi = new().add(a="c - o", b="h - l").add(a4=four("a"), b4=four("b")).add(u=roll("sum", "a4", 10), w=roll("sum", "b4", 10)).add(x=known(ratio("u", "w"), "w")).add(z=four("x"))
    osc = new().add(q=f"coalesce({p}, c)").add(bp="c - least(l, q)", r="greatest(h, q) - least(l, q)").add(**{f"{k}{n}": roll("sum", x, n) for k, x in (("b", "bp"), ("r", "r")) for n in (7, 14, 28)})
    kst = new().add(**{f"r{n}": roc(n) for n in (10, 13, 14, 15)}).add(x=" + ".join(f"{i} * ({roll('avg', f'r{n}', n)})" for i, n in enumerate((10, 13, 14, 15), 1))).add(z=roll("avg", "x", 9))
    cloud = new().add(te=mid(9), ki=mid(26), b=mid(52)).add(a="(te + ki) / 2").add(ca=lag("a", 26), cb=lag("b", 26), past=lag("c", 26))
    kd = new().add(hh=roll("max", "h", 9), ll=roll("min", "l", 9)).add(raw=percent_k("hh", "ll")).add(k=roll("avg", "raw", 3)).add(d=roll("avg", "k", 3))
    sto = new().add(hh=roll("max", "h", 14), ll=roll("min", "l", 14)).add(k=percent_k("hh", "ll")).add(d=roll("avg", "k", 3))
    srsi = rsi("c", 14).add(hh=roll("max", "rsi", 14), ll=roll("min", "rsi", 14)).add(raw=known(ratio("rsi - ll", "(hh - ll)"), "hh")).add(k=roll("avg", "raw", 3)).add(d=roll("avg", "k", 3))
    flow = new().add(tp="(h + l + c) / 3").add(q=lag("tp")).add(u="CASE WHEN tp > q THEN tp * v ELSE 0 END", w="CASE WHEN tp < q THEN tp * v ELSE 0 END").add(us=roll("sum", "u", 14), ws=roll("sum", "w", 14))
    back = {f"h{k}": lag("h", k) for k in range(1, 5)} | {f"l{k}": lag("l", k) for k in range(1, 5)}
    top, dip = "h2 > h AND h2 > h1 AND h2 > h3 AND h2 > h4", "l2 < l AND l2 < l1 AND l2 < l3 AND l2 < l4"
    last_high, last_low = (f"row_number() OVER {_BY} - arg_max(i, ({x}, i)) OVER {_over(26)}" for x in ("h", "-l"))
    aroon = new().add(i=f"row_number() OVER {_BY}").add(sh=last_high, sl=last_low).add(up="CASE WHEN i > 25 THEN (25 - sh) / 25.0 * 100 END", down="CASE WHEN i > 25 THEN (25 - sl) / 25.0 * 100 END")
    walk = new().add(tr=tr).add(**{f"a{k}": f"({roll('avg', 'tr', k)}) * {math.sqrt(k)!r}" for k in range(2, 15)}, **{f"x{k}": f"h - {lag('l', k)}" for k in range(2, 15)}, **{f"y{k}": f"{lag('h', k)} - l" for k in range(2, 15)})
    best = lambda x: known("greatest(0, " + ", ".join(ratio(f"{x}{k}", f"a{k}") for k in range(2, 15)) + ")", "x14")
    tsi = new().add(d=f"c - {p}").add(e="abs(d)").smooth("a", "d", 25).smooth("b", "e", 25).smooth("x", "a", 13).smooth("y", "b", 13)
    smi = new().add(hh=roll("max", "h", 13), ll=roll("min", "l", 13)).smooth("a", "c - (hh + ll) / 2", 25).smooth("b", "hh - ll", 25).smooth("u", "a", 2).smooth("w", "b", 2).add(x=known(ratio("100 * u", "(w / 2)"), "w")).smooth("z", "x", 9)
    trix = new().smooth("a", "c", 18).smooth("b", "a", 18).smooth("e", "b", 18).add(q=lag("e")).add(x=known("CASE WHEN q = 0 THEN 0 ELSE (e - q) / q * 100 END", "q")).smooth("z", "x", 9)
    kroll = new().add(tr=tr).smooth("a", "tr", 10, 1 / 10).add(x=f"({roll('max', 'h', 10)}) - 1.5 * a", y=f"({roll('min', 'l', 10)}) + 1.5 * a")
    zone = new().add(tr=tr).smooth("e", "c", 34).add(q=lag("e")).add(x=known(f"CASE WHEN abs(tr) < {_EPS} THEN 0 ELSE degrees(atan((e - q) / tr)) END", "q"))
    cmf = f"CASE WHEN abs(h - l) < {_EPS} THEN 0 ELSE ((c - l) - (h - c)) / (h - l) * v END"
    session = new().add(new=f"coalesce((t - {lag('t')} > 390 * 60000)::INT, 0)").add(k=f"sum(new) OVER {_BY}").add(pv="sum((h + l + c) / 3 * v) OVER (PARTITION BY symbol, tf, k ORDER BY t)", vv="sum(v) OVER (PARTITION BY symbol, tf, k ORDER BY t)")
    tp_list = f"CASE WHEN count(tp) OVER {_over(20)} = 20 THEN list(tp) OVER {_over(20)} END"
    power = lambda: new().smooth("e", "c", 13)
    line = lambda s, name: s.sql(**{name: known("x", "z"), "signal": "z", "histogram": "x - z"})
    return {
        "hma": new().add(x=f"2 * ({wma('c', 10)}) - ({wma('c', 20)})").sql(value=wma("x", 4)),
        "alma": new().sql(value=dot("c", [g / sum(gauss) for g in gauss])),
        "lsma": new().add(s=dot("c", [(i - 12) / below for i in range(25)])).sql(value=f"({roll('avg', 'c', 25)}) + s * 12", slope="s"),
        "vwma": new().add(pv="c * greatest(v, 0)", w="greatest(v, 0)").add(a=roll("sum", "pv", 20), b=roll("sum", "w", 20), m=roll("avg", "c", 20)).sql(value=f"CASE WHEN abs(b) < {_EPS} THEN m ELSE a / b END"),
        "dema": new().smooth("a", "c", 20).smooth("b", "a", 20).sql(value="2 * a - b"),
        "tema": new().smooth("a", "c", 20).smooth("b", "a", 20).smooth("e", "b", 20).sql(value="3 * a - 3 * b + e"),
        "macd": line(macd(12, 26, 9, "a - b"), "macd"),
        "ppo": line(macd(12, 26, 9, known(ratio("(a - b) * 100", "b"), "b")), "ppo"),
        "trix": line(trix, "trix"),
        "kst": line(kst, "kst"),
        "dmi": directional().sql(plus_di="pdi", minus_di="mdi"),
        "adx": directional().add(dx=known(ratio("100 * abs(pdi - mdi)", "(pdi + mdi)"), "pdi")).smooth("z", "dx", 14, 1 / 14).sql(adx="z", plus_di=known("pdi", "z"), minus_di=known("mdi", "z")),
        "aroon": aroon.sql(up="up", down="down"),
        "aroon_osc": aroon.sql(value="up - down"),
        "vortex": new().add(tr=tr_next, a=f"abs(h - {lag('l')})", b=f"abs(l - {lag('h')})").add(w=roll("sum", "tr", 14), x=roll("sum", "a", 14), y=roll("sum", "b", 14)).sql(plus_vi=known(ratio("x", "w"), "w"), minus_vi=known(ratio("y", "w"), "w")),
        "kdj": kd.sql(k=known("k", "d"), d="d", j="3 * k - 2 * d"),
        "stochastic": sto.sql(k=known("k", "d"), d="d"),
        "stoch_rsi": srsi.sql(k=known("k", "d"), d="d"),
        "rsi": rsi("c", 14).sql(value="rsi"),
        "cci": new().add(tp="(h + l + c) / 3").add(m=roll("avg", "tp", 20), x=tp_list).add(d="list_avg(list_transform(x, lambda z: abs(z - m)))").sql(value="CASE WHEN m IS NULL THEN NULL WHEN d = 0 THEN 0 ELSE (tp - m) / (0.015 * d) END"),
        "dpo": new().sql(value=f"CASE WHEN row_number() OVER {_BY} >= 31 THEN {lag('c', 11)} - ({roll('avg', 'c', 20)}) END"),
        "mfi": flow.sql(value=known(f"CASE WHEN abs(ws) < {_EPS} THEN 100 ELSE 100 - 100 / (1 + us / ws) END", "us")),
        "rvi": rvi.sql(rvi=known("x", "z"), signal="z"),
        "uo": osc.sql(value=known(f"CASE WHEN abs(r7) < {_EPS} OR abs(r14) < {_EPS} OR abs(r28) < {_EPS} THEN 50 ELSE 100 * (4 * b7 / r7 + 2 * b14 / r14 + b28 / r28) / 7 END", "r28")),
        "coppock": new().add(x=f"{roc(11)} + {roc(14)}").sql(value=wma("x", 10)),
        "tsi": tsi.sql(value=known(ratio("100 * x", "y"), "y")),
        "smi": smi.sql(smi=known("x", "z"), signal="z"),
        "bull_bear": power().sql(bull="h - e", bear="l - e", ema="e"),
        "elder_ray": power().sql(ema="e", bull_power="h - e", bear_power="l - e"),
        "atr": new().add(tr=tr).smooth("a", "tr", 14, 1 / 14).sql(tr="tr", atr="a"),
        "keltner": new().add(tr=tr).smooth("e", "c", 20).smooth("a", "tr", 10, 1 / 10).sql(upper="e + 2 * a", middle=known("e", "a"), lower="e - 2 * a"),
        "chandelier_exit": new().add(tr=tr).smooth("a", "tr", 22, 1 / 22).sql(long_stop=f"({roll('max', 'h', 22)}) - 3 * a", short_stop=f"({roll('min', 'l', 22)}) + 3 * a", atr="a"),
        "chande_kroll": kroll.sql(stop_long=roll("max", "x", 9), stop_short=roll("min", "y", 9)),
        "chop": new().add(tr=tr).add(s=roll("sum", "tr", 14), hh=roll("max", "h", 14), ll=roll("min", "l", 14)).sql(value=known(f"CASE WHEN abs(hh - ll) < {_EPS} THEN 100 ELSE least(100, greatest(0, 100 * log10(s / (hh - ll)) / {math.log10(14)!r})) END", "s")),
        "chop_zone": zone.sql(("zone",), angle="x", zone="CASE WHEN x > 5 THEN 'up' WHEN x < -5 THEN 'down' WHEN x IS NOT NULL THEN 'choppy' END"),
        "cmf": new().add(f=cmf).add(a=roll("sum", "f", 20), b=roll("sum", "v", 20)).sql(value=f"CASE WHEN abs(b) < {_EPS} THEN NULL ELSE a / b END"),
        "vwap": session.sql(value="CASE WHEN vv = 0 THEN c ELSE pv / vv END"),
        "ichimoku": cloud.sql(
            ("above_cloud", "below_cloud", "chikou_above", "chikou_below"), tenkan="te", kijun="ki", senkou_a="a", senkou_b="b", chikou="c", above_cloud="c > greatest(ca, cb)", below_cloud="c < least(ca, cb)", chikou_above="c > past", chikou_below="c < past",
        ),
        "fractal": new().add(**back).sql(("bullish", "bearish"), bullish=dip, bearish=top, fractal_high=f"CASE WHEN {top} THEN h2 END", fractal_low=f"CASE WHEN {dip} THEN l2 END"),
        "rwi": walk.sql(rwi_high=best("x"), rwi_low=best("y")),
        "kama": with_kama(new()).sql(value="kama"),
        "heiken_ashi": with_heiken(new()).sql(("is_bullish",), open="ho + 1e-9", high="greatest(h, ho, hc) + 1e-9", low="least(l, ho, hc) + 1e-9", close="hc + 1e-9", is_bullish="hb"),
        "supertrend": with_supertrend(new()).sql(("bullish", "bearish"), value="st", bullish="bull", bearish="NOT bull"),
        "parabolic_sar": with_sar(new()).sql(("bullish",), sar="sar", bullish="rise"),
        "fisher": with_fisher(new(), 9).sql(fisher="fisher", signal="fsig"),
        "mcginley": new().add(ms=roll("avg", "c", 14), mn=f"row_number() OVER {_BY}").fold({"x": "c", "m": "ms"}, {"y": "r.m"}, {"y": f"CASE WHEN abs(e.y) < {_EPS} THEN r.x WHEN r.x = 0 THEN e.y ELSE e.y + (r.x - e.y) / (14 * pow(r.x / e.y, 4)) END"}, "mn >= 14").sql(value="y"),
        "kalman": kalman(new()).sql(value="x", velocity="u"),
        "connors_rsi": with_connors(new()).sql(value="crsi"),
        "alligator": with_alligator(new()).sql(("bullish", "bearish"), jaw="jaw", teeth="teeth", lips="lips", bullish="gator", bearish="lips < teeth AND teeth < jaw"),
        "gmma": with_gmma(new()).sql(("bullish", "bearish"), spread=known(f"({' + '.join(f'g{n}' for n in _SHORT)}) / 6 - ({' + '.join(f'g{n}' for n in _LONG)}) / 6", "g60"), bullish="gbull", bearish="gbear", **{f"short_{i}": f"g{n}" for i, n in enumerate(_SHORT)}, **{f"long_{i}": f"g{n}" for i, n in enumerate(_LONG)}),
        "pmo": new().add(pc=f"CASE WHEN {p} = 0 THEN 0 ELSE 1000 * (c / {p} - 1) END").smooth("a", "pc", 35).smooth("x", "a", 20).smooth("z", "x", 10).sql(pmo=known("x", "z"), signal="z", histogram="x - z"),
        "rci": new().add(q9=f"CASE WHEN count(c) OVER {_over(9)} = 9 THEN list(c) OVER {_over(9)} END").sql(value=rank_correlation(9)),
        "rci_ribbon": new().add(**{f"q{n}": f"CASE WHEN count(c) OVER {_over(n)} = {n} THEN list(c) OVER {_over(n)} END" for n in (9, 26, 52)}).add(ra=rank_correlation(9), rb=rank_correlation(26), rc=rank_correlation(52)).sql(short=known("ra", "rc"), medium=known("rb", "rc"), long="rc"),
        "regime": with_regime(new()).sql(("trend_status", "volatility_status"), trend_value="tv", trend_status="ts", volatility_value="vr", volatility_status="vs"),
    }


#: The close falls through the trailing stop, which a new top moves first.
_FELL = "r.x < CASE WHEN r.x > e.top THEN r.x - r.w ELSE e.stp END"


def swings(s: Layers, n: int = 5) -> Layers:
    """Breakouts above the last swing high and pin bars at the last swing low, with a stop below; needs e50 and atr."""
    span = lambda f, x, a, b: f"{f}({x}) OVER (PARTITION BY symbol, tf ORDER BY t ROWS BETWEEN {a} PRECEDING AND {b} PRECEDING)"
    warm = f"e50 IS NOT NULL AND atr IS NOT NULL AND count(*) OVER {_over(2 * n + 1)} = {2 * n + 1}"
    s.add(mh=lag("h", n), ml=lag("l", n)).add(
        pk=f"CASE WHEN {warm} AND mh > greatest({span('max', 'h', 2 * n, n + 1)}, {span('max', 'h', n - 1, 0)}) THEN mh END",
        dp=f"CASE WHEN {warm} AND ml < least({span('min', 'l', 2 * n, n + 1)}, {span('min', 'l', n - 1, 0)}) THEN ml END",
    ).add(tp_=f"last_value(pk IGNORE NULLS) OVER {_BY}", fl_=f"last_value(dp IGNORE NULLS) OVER {_BY}")
    body = "abs(c - o)"
    s.add(brk="coalesce(c > tp_ AND c > e50, false)", pin=f"coalesce({body} > 0 AND least(o, c) - l > {body} * 2 AND h - greatest(o, c) < {body} AND abs(c - fl_) < atr * 0.5 AND c > e50, false)", tight="l - atr * 0.5")
    enters = "CASE WHEN r.a THEN 'long' WHEN r.b THEN 'pin' END"
    stop = "CASE WHEN r.a THEN r.f WHEN r.b THEN r.g END"
    return s.fold(
        {"x": "c", "a": "brk", "b": "pin", "f": "fl_", "g": "tight"}, {"stp": stop, "sig": enters},
        {"stp": f"CASE WHEN e.stp IS NULL THEN {stop} WHEN r.x < e.stp THEN NULL ELSE greatest(e.stp, r.f) END", "sig": f"CASE WHEN e.stp IS NULL THEN {enters} WHEN r.x < e.stp THEN 'exit' END"},
        "tp_ IS NOT NULL AND fl_ IS NOT NULL",
    )


def two_frame_sql(base: str, high: str, high_ms: int, base_ms: int) -> dict[str, str]:
    """Rules over two timeframes: layers over the higher bars (named ``high_bars``), joined as of their close to the base bars (``bars``)."""

    def joined(make, *columns: str) -> Layers:
        s = Layers(high)
        s.at = "high_bars"
        make(s)
        test = " AND ".join(f"{x} IS NOT NULL" for x in columns if x != "xp")
        s.add(known_=f"sum(({test})::INT) OVER {_BY}")
        s.n += 1
        s.tables.append(base)
        s.tables.append(f"j{s.n} AS (SELECT b.*, {', '.join(f'x.{k}' for k in (*columns, 'known_'))} FROM bars b ASOF LEFT JOIN (SELECT *, t + {high_ms} AS at_ FROM {s.at}) x ON b.symbol = x.symbol AND b.t + {base_ms} >= x.at_)")
        s.at = f"j{s.n}"
        return s

    def rule(s: Layers, name: str, entry: str, leave: str) -> str:
        return s.rule(name, f"known_ >= 2 AND ({entry})", f"known_ >= 2 AND ({leave})", more=", NULL::DOUBLE AS target, NULL::DOUBLE AS stop")

    def crossed(s: Layers) -> Layers:
        return s.smooth("f9", "c", 9).smooth("f21", "c", 21).add(p9=lag("f9"), p21=lag("f21"))

    def macd(s: Layers) -> Layers:
        return with_rsi(s.smooth("f12", "c", 12).smooth("f26", "c", 26).add(line="f12 - f26").smooth("sig", "line", 9).add(hist="line - sig"))

    bands = lambda s: s.add(xm=roll("avg", "c", 20), xd=roll("stddev_pop", "c", 20)).add(xu="xm + 2 * xd")
    return {
        "rule_mtf_ema_rsi": rule(with_rsi(joined(lambda s: s.smooth("xe", "c", 20).add(xp=lag("xe")), "xe", "xp")), "mtf_ema_rsi", "xe > xp AND coalesce(rsi, 0) < 40", "xe < xp OR coalesce(rsi, 0) > 70"),
        "rule_mtf_ma_cross": rule(crossed(joined(lambda s: s.smooth("xe", "c", 50), "xe")), "mtf_ma_cross", "p9 IS NOT NULL AND p21 IS NOT NULL AND c > xe AND p9 <= p21 AND f9 > f21", "p9 IS NOT NULL AND p21 IS NOT NULL AND (c < xe OR (p9 >= p21 AND f9 < f21))"),
        "rule_mtf_adx_pullback": rule(with_rsi(joined(lambda s: with_adx(s.smooth("xe", "c", 50)).add(xa="adx"), "xe", "xa")), "mtf_adx_pullback", "xa > 25 AND c > xe AND coalesce(rsi, 0) < 40", "xa < 20 OR c < xe OR coalesce(rsi, 0) > 70"),
        "rule_mtf_bb_macd": rule(macd(joined(bands, "xu", "xm")), "mtf_bb_macd", "c > xu AND hist > 0 AND coalesce(rsi, 50) < 55", "hist IS NOT NULL AND (c < xm OR hist < 0)"),
    }


def crossing_sets_sql(bars: str, name: str, sets: list[tuple[int, int]]) -> str:
    """Signals of EMA crossings under each pair of lengths, the pair as a column."""
    def one(fast: int, slow: int) -> str:
        s = Layers(bars).smooth("a", "c", fast).smooth("b", "c", slow).add(pa=lag("a"), pb=lag("b"))
        signals = s.rule(name, "pa <= pb AND a > b", "pa >= pb AND a < b")
        return f"SELECT symbol, tf, t, rule, '{fast}/{slow}' AS parameters, direction FROM ({signals})"

    return " UNION ALL ".join(one(*x) for x in sets)


def walk_rule_sql(bars: str) -> dict[str, str]:
    """Rules that need prices with a memory."""
    new = lambda: Layers(bars)
    bands = lambda s: s.add(m=roll("avg", "c", 20), dev=roll("stddev_pop", "c", 20)).add(bu="m + 2 * dev", bl="m - 2 * dev")
    tsi = new().add(dl=f"c - {_P}").add(da="abs(dl)").smooth("a1", "dl", 25).smooth("b1", "da", 25).smooth("a2", "a1", 13).smooth("b2", "b1", 13).add(x=known(ratio("100 * a2", "b2"), "b2")).add(x_p=lag("x"))
    squeeze = bands(new()).add(width=known(ratio("bu - bl", "m"), "m")).add(mark="CASE WHEN c < m THEN 0 WHEN width < 0.04 THEN 1 END").add(seen="last_value(mark IGNORE NULLS) OVER (PARTITION BY symbol, tf ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    back = with_rsi(bands(new())).add(lv="c >= bu OR rsi > 70").add(low_="(c < bl AND rsi IS NOT NULL AND NOT lv)::INT").add(low4=lag("low_", 4), least4="min(low_) OVER (PARTITION BY symbol, tf ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
    return {
        "rule_tsi": tsi.rule("tsi", "x_p <= -25 AND x > -25", "x_p >= 25 AND x < 25", "(x + 25) / 125"),
        "rule_bb_squeeze": squeeze.rule("bb_squeeze", "seen = 1 AND c > bu", "c < m", latched=True),
        "rule_mean_reversion": back.rule("mean_reversion", "least4 = 1 AND low4 IS NOT NULL AND c > bl", "lv", "(50 - rsi) / 50", latched=True),
        "rule_rsi_mean_rev": with_rsi(new()).rule("rsi_mean_rev", "rsi < 30", "rsi > 70", "(30 - rsi) / 30"),
    }


def rule_sql(bars: str) -> dict[str, str]:
    new = lambda: Layers(bars)
    tr = f"greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')}))"

    def before(s: Layers, *names: str) -> Layers:
        return s.add(**{f"{x}_p": lag(x) for x in names})

    up, down = (lambda a, b: f"({a}_p <= {b}_p AND {a} > {b})"), (lambda a, b: f"({a}_p >= {b}_p AND {a} < {b})")
    over, under = (lambda a, k: f"({a}_p <= {k} AND {a} > {k})"), (lambda a, k: f"({a}_p >= {k} AND {a} < {k})")
    gauss = lambda n: [math.exp(-((i - math.floor(0.85 * (n - 1))) ** 2) / (2 * (n / 6) ** 2)) for i in range(n)]
    even = lambda w: [x / sum(w) for x in w]
    roc = lambda n: f"CASE WHEN {lag('c', n)} = 0 THEN 0 ELSE (c - {lag('c', n)}) / {lag('c', n)} * 100 END"
    rsi = lambda s: s.add(move=f"c - {lag('c')}").smooth("gain", "greatest(move, 0) + 0 * move", 14, 1 / 14).smooth("loss", "greatest(-move, 0) + 0 * move", 14, 1 / 14).add(
        rsi=f"CASE WHEN abs(loss) < {_EPS} THEN 100 ELSE 100 - 100 / (1 + gain / loss) END"
    )
    macd = lambda s: s.smooth("f12", "c", 12).smooth("f26", "c", 26).add(line="f12 - f26").smooth("sig", "line", 9).add(hist="line - sig")
    bands = lambda s: s.add(m=roll("avg", "c", 20), dev=roll("stddev_pop", "c", 20)).add(bu="m + 2 * dev", bl="m - 2 * dev")
    stoch = lambda s: s.add(hh=roll("max", "h", 14), ll=roll("min", "l", 14)).add(k=percent_k("hh", "ll")).add(d=roll("avg", "k", 3))
    atr = lambda s: s.add(tr=tr).smooth("atr", "tr", 14, 1 / 14)
    crossing = lambda s, name, a="a", b="b", also="true": before(s, a, b).rule(name, f"{up(a, b)} AND {also}", down(a, b))
    zero = lambda s, name, x: before(s, x).rule(name, over(x, 0), under(x, 0))
    hull = lambda s, k, n: s.add(**{f"{k}x": f"2 * ({wma('c', n // 2)}) - ({wma('c', n)})"}).add(**{k: wma(f"{k}x", round(math.sqrt(n)))})
    double = lambda s, k, n: s.smooth(f"{k}1", "c", n).smooth(f"{k}2", f"{k}1", n).add(**{k: f"2 * {k}1 - {k}2"})
    triple = lambda s, k, n: s.smooth(f"{k}1", "c", n).smooth(f"{k}2", f"{k}1", n).smooth(f"{k}3", f"{k}2", n).add(**{k: f"3 * {k}1 - 3 * {k}2 + {k}3"})
    fitted = lambda n: f"({roll('avg', 'c', n)}) + ({dot('c', [(i - (n - 1) / 2) / sum((j - (n - 1) / 2) ** 2 for j in range(n)) for i in range(n)])}) * {(n - 1) / 2}"
    emas = lambda *ns: reduce(lambda s, n: s.smooth(f"e{n}", "c", n), ns, new())
    turning = lambda s, name, x, **options: before(s, x).rule(name, f"{x} AND NOT {x}_p", f"NOT {x} AND {x}_p", **options)
    mid = lambda n: f"({roll('max', 'h', n)} + {roll('min', 'l', n)}) / 2"
    cloud = lambda s: s.add(te=mid(9), ki=mid(26), sb=mid(52)).add(sa_="(te + ki) / 2").add(ca=lag("sa_", 26), cb=lag("sb", 26))
    flow = lambda s: s.add(tp="(h + l + c) / 3").add(q=lag("tp")).add(u="CASE WHEN tp > q THEN tp * v ELSE 0 END", w="CASE WHEN tp < q THEN tp * v ELSE 0 END").add(us=roll("sum", "u", 14), ws=roll("sum", "w", 14)).add(
        x=known(f"CASE WHEN abs(ws) < {_EPS} THEN 100 ELSE 100 - 100 / (1 + us / ws) END", "us"))
    return {f"rule_{k}": v for k, v in {
        "hma_crossover": crossing(hull(hull(new(), "a", 16), "b", 49), "hma_crossover"),
        "dema_crossover": crossing(double(double(new(), "a", 12), "b", 26), "dema_crossover"),
        "tema_crossover": crossing(triple(triple(new(), "a", 8), "b", 21), "tema_crossover"),
        "alma_cross": crossing(new().add(a=dot("c", even(gauss(9))), b=dot("c", even(gauss(21)))), "alma_cross"),
        "lsma_cross": crossing(new().add(a=fitted(20), b=fitted(50)), "lsma_cross"),
        "macd_crossover": zero(macd(new()), "macd_crossover", "hist"),
        "roc": zero(new().add(x=roc(10)), "roc", "x"),
        "ao": zero(new().add(mid="(h + l) / 2").add(x=f"({roll('avg', 'mid', 5)}) - ({roll('avg', 'mid', 34)})"), "ao", "x"),
        "stochastic_dk": crossing(stoch(new()), "stochastic_dk", "k", "d"),
        "stochastic_crossover": before(stoch(new()), "k", "d").rule("stochastic_crossover", f"{up('k', 'd')} AND d < 20", f"{down('k', 'd')} AND d > 80", "k / 100"),
        "triple_ema": before(emas(10, 20, 50).add(x="e10 > e20 AND e20 > e50"), "x").rule("triple_ema", "x AND NOT x_p", "NOT x AND x_p"),
        "scalping_ema": before(atr(emas(8, 21)).smooth("w", "atr", 20), "e8", "e21").rule("scalping_ema", f"{up('e8', 'e21')} AND atr > w", down("e8", "e21"), "(e8 - e21) / e21"),
        "rsi_mean_rev": rsi(new()).rule("rsi_mean_rev", "rsi < 30", "rsi > 70", "(30 - rsi) / 30"),
        "rsi_ma_cross": before(rsi(emas(20, 50)), "e20", "e50").rule("rsi_ma_cross", f"{up('e20', 'e50')} AND rsi > 50", f"{down('e20', 'e50')} OR rsi < 45"),
        "momentum_roc": emas(50).add(x=roc(10)).rule("momentum_roc", "x > 2 AND c > e50", "x < 0 OR c < e50", "x / 6"),
        "dual_momentum": new().add(a=roc(10), b=roc(30)).rule("dual_momentum", "a > 0 AND b > 0", "a < 0 OR b < 0"),
        "bb_rsi_reversal": rsi(bands(new())).rule("bb_rsi_reversal", "c < bl AND rsi < 35", "c > m OR rsi > 65"),
        "bollinger_macd": macd(bands(new())).rule("bollinger_macd", "c > bu AND hist > 0", "c < m OR hist < 0"),
        "range_rover": stoch(new()).add(m=roll("avg", "c", 50)).rule("range_rover", "d IS NOT NULL AND k < 20 AND c > m", "d IS NOT NULL AND k > 80"),
        "volatility_squeezer": before(atr(new()).add(m=roll("avg", "c", 50)), "atr").rule("volatility_squeezer", "atr > atr_p AND c > m", "c < m"),
        "volatility_vanguard": before(atr(bands(new())), "atr").rule("volatility_vanguard", "c > bu AND atr > atr_p", "c < m"),
        "waddah_attar": bands(new().smooth("a", "c", 20).smooth("b", "c", 40).add(x="a - b").smooth("z", "x", 9).add(tr=tr).smooth("w", "tr", 100, 1 / 100)).add(
            y="CASE WHEN z IS NOT NULL AND w IS NOT NULL AND bu IS NOT NULL THEN x END"
        ).add(p=f"(y - {lag('y')}) * 150").add(sure="abs(p) > bu - bl AND abs(p) > w * 3.7 AND p > 0").rule("waddah_attar", "sure", "NOT sure"),
        "keltner_breakout": new().add(tr=tr).smooth("e", "c", 20).smooth("a", "tr", 10, 1 / 10).rule("keltner_breakout", "c > e + 2 * a", "c < e - 2 * a"),
        "kama": before(with_kama(new()).add(cc="c"), "cc", "kama").rule("kama", up("cc", "kama"), down("cc", "kama"), "(c - kama) / kama"),
        "adx_ema_cross": before(with_adx(emas(20, 50)), "e20", "e50").rule("adx_ema_cross", f"{up('e20', 'e50')} AND adx > 25", down("e20", "e50")),
        "trend_transition": before(with_adx(emas(50, 200)), "e50", "e200").rule("trend_transition", f"{up('e50', 'e200')} AND adx > 25", down("e50", "e200")),
        "dmi_adx": before(with_adx(new()), "pdi", "mdi").rule("dmi_adx", f"{up('pdi', 'mdi')} AND adx > 25", down("pdi", "mdi"), "adx / 100"),
        "wolfstein": with_adx(new()).rule("wolfstein", "adx > 27.5 AND pdi > mdi", "adx < 20.5", "adx / 100"),
        "vortex_trend": crossing(new().add(trn=_TR_NEXT, va=f"abs(h - {lag('l')})", vb=f"abs(l - {lag('h')})").add(vw=roll("sum", "trn", 14), vx=roll("sum", "va", 14), vy=roll("sum", "vb", 14)).add(a=known(ratio("vx", "vw"), "vw"), b=known(ratio("vy", "vw"), "vw")), "vortex_trend"),
        "aroon_trend": new().add(i=f"row_number() OVER {_BY}").add(**{k: f"row_number() OVER {_BY} - arg_max(i, ({x}, i)) OVER {_over(26)}" for k, x in (("sh", "h"), ("sl", "-l"))}).add(
            au="CASE WHEN i > 25 THEN (25 - sh) / 25.0 * 100 END", ad="CASE WHEN i > 25 THEN (25 - sl) / 25.0 * 100 END").rule("aroon_trend", "au > 70 AND ad < 30", "au < ad", "(au - ad) / 200 + 0.5"),
        "gmma_crossover": turning(with_gmma(new()), "gmma_crossover", "gbull"),
        "ichimoku_cloud": cloud(new()).rule("ichimoku_cloud", "c > greatest(ca, cb)", "c < greatest(ca, cb) AND c < least(ca, cb)"),
        "ichimoku_cross": before(cloud(new()), "te", "ki").rule("ichimoku_cross", f"{up('te', 'ki')} AND c > greatest(ca, cb)", down("te", "ki")),
        "trend_follower": macd(new()).add(a50=roll("avg", "c", 50), a200=roll("avg", "c", 200)).rule("trend_follower", "a50 > a200 AND hist > 0", "a50 < a200 OR hist < 0", latched=True),
        "macd_ma": macd(new()).add(a50=roll("avg", "c", 50)).rule("macd_ma", "hist > 0 AND c > a50", "hist < 0", latched=True),
        "ppo_histogram": zero(new().smooth("f12", "c", 12).smooth("f26", "c", 26).add(x=known(ratio("(f12 - f26) * 100", "f26"), "f26")).smooth("z", "x", 9).add(hist="x - z"), "ppo_histogram", "hist"),
        "trix": zero(new().smooth("t1", "c", 18).smooth("t2", "t1", 18).smooth("t3", "t2", 18).add(q=lag("t3")).add(x=known("CASE WHEN q = 0 THEN 0 ELSE (t3 - q) / q * 100 END", "q")).smooth("z", "x", 9).add(hist="x - z"), "trix", "hist"),
        "stoch_rsi": before(with_rsi(new()).add(rh=roll("max", "rsi", 14), rl=roll("min", "rsi", 14)).add(raw=known(ratio("rsi - rl", "(rh - rl)"), "rh")).add(k3=roll("avg", "raw", 3)).add(d3=roll("avg", "k3", 3)).add(x=known("k3", "d3")), "x").rule("stoch_rsi", under("x", 0.2), over("x", 0.8), "(0.2 - x) / 0.2"),
        "cci_reversal": before(with_cci(new()), "cci").rule("cci_reversal", over("cci", -100), over("cci", 100)),
        "cmo_zero_cross": before(emas(50).add(dl=f"c - {lag('c')}").add(du="greatest(dl, 0) + 0 * dl", dd="greatest(-dl, 0) + 0 * dl").add(u=roll("sum", "du", 14), w=roll("sum", "dd", 14)).add(x=known(ratio("(u - w) * 100", "(u + w)"), "u")), "x").rule("cmo_zero_cross", f"{over('x', 0)} AND c > e50", f"{under('x', 0)} OR c < e50"),
        "connors_rsi": with_connors(new()).rule("connors_rsi", "crsi < 10", "crsi > 70", "(10 - crsi) / 10"),
        "fisher_crossover": before(with_fisher(new(), 10), "fisher", "fsig").rule("fisher_crossover", up("fisher", "fsig"), down("fisher", "fsig")),
        "kdj": before(new().add(hh=roll("max", "h", 9), ll=roll("min", "l", 9)).add(raw=percent_k("hh", "ll")).add(k0=roll("avg", "raw", 3)).add(d=roll("avg", "k0", 3)).add(k=known("k0", "d"), j="3 * k0 - 2 * d"), "k").rule("kdj", "k < 20 AND d < 20 AND k > k_p", "k > 80 OR j > 100", latched=True),
        "smi_reversal": before(new().add(hh=roll("max", "h", 13), ll=roll("min", "l", 13)).smooth("s1", "c - (hh + ll) / 2", 25).smooth("s2", "hh - ll", 25).smooth("s3", "s1", 2).smooth("s4", "s2", 2).add(y=known(ratio("100 * s3", "(s4 / 2)"), "s4")).smooth("z", "y", 9).add(x=known("y", "z")), "x", "z").rule(
            "smi_reversal", f"{up('x', 'z')} AND x_p < -40", f"x > 40 OR {down('x', 'z')}"),
        "uo_reversal": before(new().add(q=f"coalesce({lag('c')}, c)").add(bp="c - least(l, q)", r="greatest(h, q) - least(l, q)").add(**{f"{k}{n}": roll("sum", x, n) for k, x in (("b", "bp"), ("r", "r")) for n in (7, 14, 28)}).add(
            x=known(f"CASE WHEN abs(r7) < {_EPS} OR abs(r14) < {_EPS} OR abs(r28) < {_EPS} THEN 50 ELSE 100 * (4 * b7 / r7 + 2 * b14 / r14 + b28 / r28) / 7 END", "r28")), "x").rule("uo_reversal", over("x", 30), "x > 70"),
        "williams_r_ma": before(emas(50).add(hh=roll("max", "h", 14), ll=roll("min", "l", 14)).add(x=known(ratio("(hh - c) * -100", "(hh - ll)", -50.0), "hh")), "x").rule("williams_r_ma", f"{over('x', -80)} AND c > e50", under("x", -20)),
        "atr_trailing": atr(emas(20)).add(w="atr * 2").fold(
            {"x": "c", "m": "e20", "w": "w"}, {"top": "CASE WHEN r.x > r.m THEN r.x END", "stp": "CASE WHEN r.x > r.m THEN r.x - r.w END", "sig": "CASE WHEN r.x > r.m THEN 'long' END"},
            {"top": f"CASE WHEN e.top IS NULL THEN CASE WHEN r.x > r.m THEN r.x END WHEN {_FELL} THEN NULL ELSE greatest(e.top, r.x) END", "stp": "CASE WHEN e.top IS NULL OR r.x > e.top THEN r.x - r.w ELSE e.stp END",
             "sig": f"CASE WHEN e.top IS NULL THEN CASE WHEN r.x > r.m THEN 'long' END WHEN {_FELL} THEN 'exit' END"}, "e20 IS NOT NULL AND w IS NOT NULL").rule("atr_trailing", "sig = 'long'", "sig = 'exit'"),
        "bb_keltner_squeeze": before(bands(new()).add(tr=tr).smooth("ke", "c", 20).smooth("ka", "tr", 10, 1 / 10).add(x="bu < ke + 1.5 * ka AND bl > ke - 1.5 * ka"), "x").rule("bb_keltner_squeeze", "x_p AND NOT x AND c > m", "c < m", latched=True),
        "chandelier_exit": turning(new().add(tr=tr).smooth("a", "tr", 22, 1 / 22).add(x=f"c > ({roll('max', 'h', 22)}) - 3 * a"), "chandelier_exit", "x", latched=True),
        "volatility_ratio": new().add(tr=tr, hh=roll("max", "h", 10), ll=roll("min", "l", 10), cp=lag("c")).add(x=known(ratio("tr", "(hh - ll)"), "hh")).rule("volatility_ratio", "x > 0.5 AND c > cp", "x <= 0.5", "x"),
        "mfi_revert": before(flow(new()), "x").rule("mfi_revert", over("x", 20), over("x", 80)),
        "mfi_trend": before(flow(new()), "x").rule("mfi_trend", over("x", 50), "x < 40"),
        "vwap_bounce": before(with_rsi(with_vwap(new(), 60)).add(cc="c"), "cc", "vwap").rule("vwap_bounce", f"{up('cc', 'vwap')} AND rsi < 50", f"{down('cc', 'vwap')} OR rsi > 65", "0.8"),
        "vwap_trend": before(with_vwap(new(), 60), "vwap").rule("vwap_trend", "c > vwap AND vwap > vwap_p", "c <= vwap", latched=True),
        "vwma_rsi": with_rsi(new().add(pv="c * greatest(v, 0)", w="greatest(v, 0)").add(a=roll("sum", "pv", 20), b=roll("sum", "w", 20), mm=roll("avg", "c", 20)).add(x=f"CASE WHEN abs(b) < {_EPS} THEN mm ELSE a / b END")).rule("vwma_rsi", "c > x AND rsi > 50", "rsi < 45"),
        "cmf_ema_trend": emas(50).add(f=f"CASE WHEN abs(h - l) < {_EPS} THEN 0 ELSE ((c - l) - (h - c)) / (h - l) * v END").add(a=roll("sum", "f", 20), b=roll("sum", "v", 20)).add(x=f"CASE WHEN abs(b) < {_EPS} THEN NULL ELSE a / b END").rule("cmf_ema_trend", "x > 0.1 AND c > e50", "x < -0.1"),
        "obv_ema_trend": emas(50).add(dl=f"c - {lag('c')}").add(x=f"sum(CASE WHEN dl > 0 THEN v WHEN dl < 0 THEN -v ELSE 0 END) OVER {_BY}").smooth("mm", "x", 20).rule("obv_ema_trend", "x > mm AND c > e50", "x <= mm OR c <= e50", latched=True),
        "supertrend": turning(with_supertrend(new()), "supertrend", "bull"),
        "supertrend_macd": macd(with_supertrend(new())).rule("supertrend_macd", "bull AND hist > 0", "NOT bull"),
        "parabolic_sar": turning(with_sar(new()), "parabolic_sar", "rise"),
        "heiken_ashi_color": turning(with_heiken(new()), "heiken_ashi_color", "hb"),
        "heiken_ashi_breakout": before(with_heiken(new()), "hb").rule("heiken_ashi_breakout", "hb AND hb_p", "NOT hb AND NOT hb_p"),
        "heiken_ashi_harmonizer": with_heiken(emas(50)).rule("heiken_ashi_harmonizer", "hb AND c > e50", "NOT hb OR c < e50"),
        "alligator": turning(with_alligator(new()), "alligator", "gator"),
        "elder_ray": before(emas(13).add(bull="h - e13", bear="l - e13"), "e13", "bull", "bear").rule("elder_ray", "e13 > e13_p AND bear < 0 AND bear > bear_p", under("bull", 0)),
        "rwi": new().add(tr=tr).add(**{f"a{k}": f"({roll('avg', 'tr', k)}) * {math.sqrt(k)!r}" for k in range(2, 15)}, **{f"x{k}": f"h - {lag('l', k)}" for k in range(2, 15)}, **{f"y{k}": f"{lag('h', k)} - l" for k in range(2, 15)}).add(
            **{k: known("greatest(0, " + ", ".join(ratio(f"{z}{i}", f"a{i}") for i in range(2, 15)) + ")", "x14") for k, z in (("hi", "x"), ("lo", "y"))}).rule("rwi", "hi > 1", "lo > 1", "hi - 1"),
        "chop_filter": before(with_chop(emas(8, 21)), "e8", "e21").rule("chop_filter", f"{up('e8', 'e21')} AND chop < 61.8", down("e8", "e21"), "abs(e8 - e21) / e21"),
        "equilibrium_explorer": macd(stoch(emas(200))).add(kk=known("k", "d")).rule("equilibrium_explorer", "c > e200 AND kk < 20 AND hist > 0", "kk > 80 OR hist < 0"),
        "oscillator_overlord": with_cci(with_rsi(stoch(new()))).add(kk=known("k", "d")).rule("oscillator_overlord", "(rsi < 30)::INT + (kk < 20)::INT + (cci < -100)::INT >= 2", "(rsi > 70)::INT + (kk > 80)::INT + (cci > 100)::INT >= 2", latched=True),
        "pixel_3": new().add(**{f"m{k}": f"({roll('max', 'h', k)} + {roll('min', 'l', k)}) / 2" for k in (5, 20, 60)}).add(x="(c > m5)::INT + (c > m20)::INT + (c > m60)::INT").rule("pixel_3", "x >= 2", "x = 0", "x / 3.0"),
        "reversal_catcher": before(with_rsi(stoch(new())), "k", "d").rule("reversal_catcher", f"{up('k', 'd')} AND rsi < 50", f"{down('k', 'd')} OR rsi > 70"),
        "swing_trader": before(with_adx(with_cci(new())), "cci").rule("swing_trader", f"{over('cci', 100)} AND adx > 25", under("cci", -100)),
        "price_action_swing": swings(atr(emas(50))).rule("price_action_swing", "sig IS NOT NULL AND sig <> 'exit'", "sig = 'exit'", "CASE WHEN sig = 'pin' THEN 0.8 ELSE 1.0 END"),
    }.items()}
