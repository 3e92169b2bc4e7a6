"""Mathematics over binary floats."""

from __future__ import annotations

import ctypes
import ctypes.util
import math
import re
import sys
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal, localcontext

from docsluice.functions import values
from docsluice.functions.core import normal
from docsluice.lang.values import Raised, as_float, described, is_nan, kind


def tidy(x):
    """A float that is whole as an int, where that is exact."""
    return int(x) if isinstance(x, float) and x == x and abs(x) < 1e17 and x == int(x) and not (x == 0 and math.copysign(1, x) < 0) else x


def one(name, f, whole=True):
    @values(name)
    def run(v):
        if kind(v) != "number":
            raise Raised(f"{described(v)} number required")
        try:
            return tidy(f(as_float(v))) if whole else f(as_float(v))
        except ValueError:
            return math.nan
        except OverflowError:
            return math.inf


def two(name, f):
    @values(name, arity=2)
    def run(_, a, b):
        if kind(a) != "number" or kind(b) != "number":
            raise Raised(f"{described(a if kind(a) != 'number' else b)} number required")
        try:
            return tidy(f(as_float(a), as_float(b)))
        except ValueError:
            return math.nan
        except OverflowError:
            return math.inf


def half_away(x):
    return math.copysign(math.floor(abs(x) + 0.5), x) if math.isfinite(x) and abs(x) < 2**52 else x


def cut(f):
    return lambda x: float(f(x)) if math.isfinite(x) else x


def log_with(f):
    return lambda x: -math.inf if x == 0 else f(x)


def gamma(x):
    return math.inf if math.isinf(x) else math.lgamma(x)


def significand(x):
    return x if x == 0 or not math.isfinite(x) else math.frexp(x)[0] * 2


def logb(x):
    return -math.inf if x == 0 else math.inf if math.isinf(x) else float(math.frexp(x)[1] - 1)


def bessel(name, with_order=False):
    """A Bessel function of the C library, or None where that has none."""
    try:
        f = getattr(ctypes.CDLL(ctypes.util.find_library("m")), name)
    except (AttributeError, OSError, TypeError):
        return None
    f.restype, f.argtypes = ctypes.c_double, [*([ctypes.c_int] if with_order else []), ctypes.c_double]
    return f


def series(x, order, kind_):
    """Bessel functions by their integrals (Simpson's rule), good to about 1e-12 for moderate x."""
    if kind_ == "j":
        n = 400 + int(abs(x)) * 4
        h = math.pi / n
        f = lambda t: math.cos(order * t - x * math.sin(t))
        total = f(0) + f(math.pi) + 4 * math.fsum(f((k + 0.5) * h) for k in range(n)) * 1 + 2 * math.fsum(f(k * h) for k in range(1, n))
        return total * h / 6 / math.pi
    if x < 0:
        return math.nan
    if x == 0:
        return -math.inf
    n = 4000
    h = math.pi / n
    f = lambda t: math.sin(x * math.sin(t) - order * t)
    first = (f(0) + f(math.pi) + 4 * math.fsum(f((k + 0.5) * h) for k in range(n)) + 2 * math.fsum(f(k * h) for k in range(1, n))) * h / 6
    top = max(2.0, math.asinh((40 + 3 * order) / x) + 1)
    m = 20000
    h = top / m
    g = lambda t: (math.exp(order * t) + (-1) ** order * math.exp(-order * t)) * math.exp(-x * math.sinh(t))
    second = (g(0) + g(top) + 4 * math.fsum(g((k + 0.5) * h) for k in range(m)) + 2 * math.fsum(g(k * h) for k in range(1, m))) * h / 6
    return (first - second) / math.pi


def of_order(name, kind_):
    f = bessel(name, True)
    return (lambda a, b: f(int(a), b)) if f else lambda a, b: series(b, int(a), kind_)


for _name, _f in {
    "fabs": abs, "floor": cut(math.floor), "ceil": cut(math.ceil), "round": half_away, "trunc": cut(math.trunc), "rint": cut(round), "nearbyint": cut(round), "round_even": cut(round),
    "sqrt": math.sqrt, "cbrt": math.cbrt, "exp": math.exp, "expm1": math.expm1, "exp2": math.exp2, "exp10": lambda x: 10.0**x, "pow10": lambda x: 10.0**x,
    "log": log_with(math.log), "log1p": lambda x: -math.inf if x == -1 else math.log1p(x), "log2": log_with(math.log2), "log10": log_with(math.log10), "erf": math.erf, "erfc": math.erfc,
    "sin": math.sin, "cos": math.cos, "tan": math.tan, "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh, "asin": math.asin, "acos": math.acos, "atan": math.atan,
    "asinh": math.asinh, "acosh": math.acosh, "atanh": lambda x: math.copysign(math.inf, x) if abs(x) == 1 else math.atanh(x), "gamma": gamma, "lgamma": gamma, "tgamma": math.gamma,
    "significand": significand, "logb": logb, "degrees": math.degrees, "radians": math.radians, "j0": bessel("j0") or (lambda x: series(x, 0, "j")), "j1": bessel("j1") or (lambda x: series(x, 1, "j")),
    "y0": bessel("y0") or (lambda x: series(x, 0, "y")), "y1": bessel("y1") or (lambda x: series(x, 1, "y")), "fract": lambda x: x - math.trunc(x) if math.isfinite(x) else 0.0,
}.items():
    one(_name, _f)

for _name, _f in {
    "hypot": math.hypot, "pow": lambda a, b: math.pow(a, b) if not (a == 0 and b < 0) else math.inf, "atan2": math.atan2, "fmod": math.fmod, "copysign": math.copysign, "remainder": math.remainder, "drem": math.remainder,
    "fdim": lambda a, b: max(a - b, 0.0) if a == a and b == b else math.nan, "fmin": lambda a, b: b if a != a else a if b != b else min(a, b), "fmax": lambda a, b: b if a != a else a if b != b else max(a, b),
    "ldexp": lambda a, b: math.ldexp(a, int(b)), "scalbln": lambda a, b: math.ldexp(a, int(b)), "scalb": lambda a, b: math.ldexp(a, int(b)), "nexttoward": math.nextafter, "nextafter": math.nextafter,
    "jn": of_order("jn", "j"), "yn": of_order("yn", "y"),
}.items():
    two(_name, _f)


@values("abs")
def _(v):
    if kind(v) != "number":
        raise Raised(f"{described(v)} has no absolute value")
    return -v if v < 0 else v


@values("fma", arity=3)
def _(_, a, b, c):
    return tidy(math.fma(as_float(a), as_float(b), as_float(c)))


@values("lgamma_r")
def _(v):
    x = as_float(v)
    sign = -1 if x < 0 and math.floor(x) % 2 else 1
    return [tidy(gamma(x)), sign]


@values("frexp")
def _(v):
    m, e = math.frexp(as_float(v))
    return [tidy(m), e]


@values("modf")
def _(v):
    x = as_float(v)
    return [math.copysign(0.0, x), x] if math.isinf(x) else [tidy(p) for p in math.modf(x)]


values("nan")(lambda v: math.nan)
values("infinite")(lambda v: math.inf)
values("e")(lambda v: math.e)
values("pi")(lambda v: math.pi)
values("tau")(lambda v: math.tau)
values("recip")(lambda v: tidy(1 / as_float(v)) if v else math.inf)
values("signum")(lambda v: v if is_nan(v) else (v > 0) - (v < 0))


def _number(v):
    if kind(v) != "number":
        raise Raised(f"{described(v)} number required")
    return v


values("isnan")(lambda v: is_nan(_number(v)))
values("isinfinite")(lambda v: isinstance(_number(v), float) and math.isinf(v))
values("isfinite")(lambda v: not isinstance(_number(v), float) or math.isfinite(v))
values("isnormal")(lambda v: normal(_number(v)))


@values("_negate")
def _(v):
    return -_number(v) if v else 0


def logarithm(x, base):
    for v in (x, base):
        if kind(v) != "number":
            raise Raised(f"{described(v)} number required")
    x, base = as_float(x), as_float(base)
    if base in (2, 10):
        return tidy(log_with(math.log2 if base == 2 else math.log10)(x))
    up, down = log_with(math.log)(x), log_with(math.log)(base)
    return tidy(up / down) if down else math.nan if up == 0 or up != up else math.copysign(math.inf, up)


values("log", arity=1)(logarithm)
values("log", arity=2)(lambda _, x, base: logarithm(x, base))


def rounded(x, digits):
    for v in (x, digits):
        if kind(v) != "number":
            raise Raised(f"{described(v)} number required")
    if isinstance(x, float) and not math.isfinite(x):
        return x
    unit = Decimal(1).scaleb(-int(digits))
    d = Decimal(repr(x)) if isinstance(x, float) else Decimal(x)
    q = (d / unit).to_integral_value(rounding="ROUND_HALF_UP") * unit
    return tidy(float(q)) if isinstance(x, float) else int(q) if q == int(q) else q.normalize()


values("round", arity=1)(rounded)
values("round", arity=2)(lambda _, x, d: rounded(x, d))


DIRECTIVE = re.compile(r"([^%]*)%([,0]*)([1-9]\d*)?(?:\.(\d+))?([dfe])([^%]*)", re.S)


@values("numfmt", arity=1)
def _(v, pattern):
    """One directive of C's printf, of d, f and e, on a number's own digits; halves are rounded away from zero."""
    if not isinstance(pattern, str):
        raise Raised("numfmt requires a string format")
    if kind(v) != "number":
        raise Raised("numfmt requires a number input")
    found = DIRECTIVE.fullmatch(pattern)
    if not found:
        raise Raised(f'numfmt: invalid format "{pattern}"')
    ahead, flags, width, places, how, behind = found.groups()
    x = Decimal(repr(v)) if isinstance(v, float) else Decimal(v)
    if not x.is_finite():
        raise Raised("numfmt requires a finite number")
    places = 6 if places is None else int(places)
    with localcontext() as context:
        context.prec, context.rounding = max(60, len(x.as_tuple().digits) + places + 5), ROUND_HALF_UP
        if how == "d":
            whole_, rest = str(abs(int(x))), ""
        elif how == "f":
            whole_, _, rest = f"{abs(x).quantize(Decimal(1).scaleb(-places)):f}".partition(".")
        else:
            power = x.adjusted() if x else 0
            digits = abs(x).scaleb(-power).quantize(Decimal(1).scaleb(-places))
            if digits >= 10:
                power, digits = power + 1, (digits / 10).quantize(Decimal(1).scaleb(-places))
            whole_, _, rest = f"{digits:f}".partition(".")
            rest = rest + f"e{'-' if power < 0 else '+'}{abs(power):02d}"
    if "," in flags and how != "e":
        whole_ = f"{int(whole_):,}"
    text = whole_ + ("." + rest if rest and not rest.startswith("e") else rest)
    sign = "-" if x < 0 else ""
    text = sign + text.rjust(int(width or 0) - len(sign), "0") if "0" in flags else (sign + text).rjust(int(width or 0))
    return ahead + text + behind


__all__ = ["ROUND_HALF_EVEN", "sys"]
