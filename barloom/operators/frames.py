"""Rules over two timeframes: ``two_frame_signals(base, high, rule, base_tf, high_tf)``.

Each base bar sees the indicators of the last higher bar that closed by its own close; of the higher bars, at least
``NEEDED`` must have known values by then. An entry may carry a target and a stop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sheet import Sheet
from .resample import as_of
from .rules import _emas, _out, crossed_down, crossed_up, emitted

NEEDED = {"kitchen_sink": 3}
#: Indicators of the higher bars: each rule's columns by name.
HIGH: dict[str, Callable[[Sheet], dict[str, Column]]] = {
    "mtf_ema_rsi": lambda s: (lambda e: {"e": e, "p": s.lag(e)})(_emas(s, 20)[0]),
    "mtf_ma_cross": lambda s: {"e": _emas(s, 50)[0]},
    "mtf_adx_pullback": lambda s: {"e": _emas(s, 50)[0], "a": _out(s, "adx", "adx")[0]},
    "mtf_bb_macd": lambda s: dict(zip("um", _out(s, "bbands", "upper", "middle"), strict=True)),
    "kitchen_sink": lambda s: {"e": _emas(s, 20)[0]},
}


def _known(*xs: Column) -> Column:
    holds = F.lit(True)
    for x in xs:
        holds = holds & x.isNotNull()
    return holds


def _steps(s: Sheet, x: Column, n: int, up: bool) -> Column:
    """n strict steps in one direction."""
    back = [x, *(s.lag(x, k) for k in range(1, n + 1))]
    holds = F.lit(True)
    for new, old in zip(back, back[1:], strict=False):
        holds = holds & (new > old if up else new < old)
    return holds


def mtf_ema_rsi(s: Sheet, x: dict) -> tuple:
    r = F.coalesce(_out(s, "rsi", "value")[0], F.lit(0.0))
    return (x["e"] > x["p"]) & (r < 40), (x["e"] < x["p"]) | (r > 70)


def mtf_ma_cross(s: Sheet, x: dict) -> tuple:
    a, b = _emas(s, 9, 21)
    warm = s.lag(a).isNotNull() & s.lag(b).isNotNull()
    return warm & (s.c > x["e"]) & crossed_up(s, a, b), warm & ((s.c < x["e"]) | crossed_down(s, a, b))


def mtf_adx_pullback(s: Sheet, x: dict) -> tuple:
    r = F.coalesce(_out(s, "rsi", "value")[0], F.lit(0.0))
    return (x["a"] > 25) & (s.c > x["e"]) & (r < 40), (x["a"] < 20) | (s.c < x["e"]) | (r > 70)


def mtf_bb_macd(s: Sheet, x: dict) -> tuple:
    (h,) = _out(s, "macd", "histogram")
    r = F.coalesce(_out(s, "rsi", "value")[0], F.lit(50.0))
    return (s.c > x["u"]) & (h > 0) & (r < 55), h.isNotNull() & ((s.c < x["m"]) | (h < 0))


def kitchen_sink(s: Sheet, x: dict) -> tuple:
    fast, mid, slow = _emas(s, 9, 21, 50)
    (r,), (a,), (w,) = _out(s, "rsi", "value"), _out(s, "adx", "adx"), _out(s, "atr", "atr")
    up, low = _out(s, "bbands", "upper", "lower")
    warm = s.put(_known(fast, mid, slow, r, a, w, up))
    fast, mid, r, a = (s.put(F.when(warm, y)) for y in (fast, mid, r, a))  # what came before the last was known isn't seen
    top = F.max("c").over(s.w.rowsBetween(-19, 0))
    enter = crossed_up(s, fast, mid) & (mid > slow) & (r > 50) & (r < 70) & (a > 25) & _steps(s, a, 3, True) & (r > s.lag(r, 3)) & (up - low < w * 1.5) & (s.c == top) & (x["e"] > slow)
    return enter, crossed_down(s, fast, mid) | (r > 80) | _steps(s, a, 2, False), None, s.put(s.c + w * 2.5), s.put(s.c - w * 1.5)


BASE: dict[str, Callable[[Sheet, dict], tuple]] = {f.__name__: f for f in (mtf_ema_rsi, mtf_ma_cross, mtf_adx_pullback, mtf_bb_macd, kitchen_sink)}


def two_frame_signals(base: DataFrame, high: DataFrame, name: str, base_tf: str, high_tf: str) -> DataFrame:
    """symbol, tf, t, rule, direction, strength, target, stop."""
    return custom_two_frames(base, high, name, base_tf, high_tf, HIGH[name], BASE[name], NEEDED.get(name, 2), ("p",))


def custom_two_frames(
    base: DataFrame, high: DataFrame, name: str, base_tf: str, high_tf: str, above: Callable[[Sheet], dict[str, Column]], rule: Callable[[Sheet, dict], tuple], needed: int = 1, optional: tuple = ()
) -> DataFrame:
    """Signals of a user's rule over two timeframes: ``above`` gives the higher bars' columns by name, ``rule`` takes the base bars' sheet
    and those columns as of each base bar's close, and returns (entry, exit) or (entry, exit, strength, target, stop).

    It is silent until ``needed`` closed higher bars know all columns but the ``optional`` ones."""
    h = Sheet(high)
    made = {k: h.put(v) for k, v in above(h).items()}
    known = F.count(F.when(_known(*(v for k, v in made.items() if k not in optional)), 1)).over(h.w.rowsBetween(Window.unboundedPreceding, 0))
    right = h.done(**{f"x_{k}": v for k, v in made.items()}, x_known=known)
    s = Sheet(as_of(base, right, base_tf, high_tf, [f"x_{k}" for k in (*made, "known")], prefix="__"))
    s.own = base.columns
    entry, leave, *more = rule(s, {k: F.col(f"__x_{k}") for k in made})
    ready = F.col("__x_known") >= needed
    strength, target, stop = more or (None, F.lit(None).cast("double"), F.lit(None).cast("double"))
    return emitted(s, name, ready & entry, ready & leave, strength, target=target, stop=stop)
