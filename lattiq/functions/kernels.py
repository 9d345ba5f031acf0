"""Scalar kernels: Column in, Column out, with IEEE and wrap-around semantics.

Spark differs from IEEE arithmetic and from two's complement in a few places:
division by zero and overflow raise under ANSI, logarithms outside their domain
are null, NaN equals and exceeds everything, single precision widens.  The
kernels restore what a numerical library computes, in built-in expressions only,
so they run inside generated code on rows and inside lambdas on arrays alike.

``t`` is the element type: double, float, bigint, int or smallint.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Scalar = Column | float | int | bool
FLOATS = ("double", "float")
BITS = {"smallint": 16, "int": 32, "bigint": 64}
NAN, INF = float("nan"), float("inf")


def col(x: Scalar) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def narrow(x: Column, t: str) -> Column:
    """Back to the element type; integers wrap around."""
    if t in FLOATS:
        return x.cast(t)
    half, whole = 1 << (BITS[t] - 1), 1 << BITS[t]
    if t == "bigint":
        wide = x.cast("decimal(38,0)")
        limit = F.lit(str(half)).cast("decimal(38,0)")
        full = F.lit(str(whole)).cast("decimal(38,0)")
        return (F.pmod(wide + limit, full) - limit).cast("bigint")
    return (F.pmod(x.cast("bigint") + half, F.lit(whole)) - half).cast(t)


def widen(x: Scalar, t: str) -> Column:
    """The type in which one operation cannot overflow."""
    return col(x).cast({"double": "double", "float": "float", "bigint": "decimal(19,0)"}.get(t, "bigint"))


def neg(x: Scalar, t: str = "double") -> Column:
    return narrow(-widen(x, t), t)


def add(x: Scalar, y: Scalar, t: str = "double") -> Column:
    return narrow(widen(x, t) + widen(y, t), t)


def sub(x: Scalar, y: Scalar, t: str = "double") -> Column:
    return narrow(widen(x, t) - widen(y, t), t)


def mul(x: Scalar, y: Scalar, t: str = "double") -> Column:
    return narrow(widen(x, t) * widen(y, t), t)


def div(x: Scalar, y: Scalar, t: str = "double") -> Column:
    """IEEE division for floats (zero divisors give infinities or NaN); integers
    truncate toward zero and raise on a zero divisor."""
    x, y = col(x), col(y)
    if t not in FLOATS:
        if t == "bigint":
            return _quotient(x.cast("bigint"), y.cast("bigint"))
        return narrow(_quotient(x.cast("bigint"), y.cast("bigint")), t)
    x, y = x.cast("double"), y.cast("double")
    # 1 / -0 is told by its text, the only place where Spark keeps the sign of zero apart.
    below = y.cast("string").startswith("-")
    at_zero = (
        F.when(F.isnan(x) | (x == 0), F.lit(NAN)).when((x > 0) != below, F.lit(INF)).otherwise(F.lit(-INF))
    )
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, at_zero).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y)).cast(t)


def _quotient(x: Column, y: Column) -> Column:
    return F.call_function("div", x, y)


def mod(x: Scalar, y: Scalar, t: str = "double") -> Column:
    """Remainder with the sign of the dividend; NaN for a zero divisor, or an error on integers."""
    x, y = col(x), col(y)
    if t not in FLOATS:
        return narrow(x.cast("bigint") % y.cast("bigint"), t)
    x, y = x.cast(t), y.cast(t)
    one = F.lit(1.0).cast(t)
    # An infinite divisor leaves a finite dividend as it is.
    return F.when((y == 0) | (F.abs(x) == INF), F.lit(NAN).cast(t)).when(F.abs(y) == INF, x).otherwise(x % F.when(y == 0, one).otherwise(y))


def guard_zero(s: Scalar, what: str = "division by zero") -> Callable[[Column], Column]:
    """Raises if the scalar divisor is zero, else passes the value on."""
    return lambda x: F.when(col(s) == 0, F.raise_error(F.lit(what)).cast("double")).otherwise(x)


# Bitwise, on integers.

def invert(x: Scalar, t: str = "int") -> Column:
    return F.bitwise_not(col(x).cast(t)).cast(t)


def bit_and(x: Scalar, y: Scalar, t: str = "int") -> Column:
    return col(x).cast(t).bitwiseAND(col(y).cast(t)).cast(t)


def bit_or(x: Scalar, y: Scalar, t: str = "int") -> Column:
    return col(x).cast(t).bitwiseOR(col(y).cast(t)).cast(t)


def bit_xor(x: Scalar, y: Scalar, t: str = "int") -> Column:
    return col(x).cast(t).bitwiseXOR(col(y).cast(t)).cast(t)


def shift_left(x: Scalar, n: Scalar, t: str = "int") -> Column:
    """The count is taken modulo the width in which the shift is done (64 for bigint, else 32)."""
    wide = "bigint" if t == "bigint" else "int"
    return narrow(F.call_function("shiftleft", col(x).cast(wide), col(n).cast("int")), t)


def shift_right(x: Scalar, n: Scalar, t: str = "int") -> Column:
    """Arithmetic shift."""
    wide = "bigint" if t == "bigint" else "int"
    return narrow(F.call_function("shiftright", col(x).cast(wide), col(n).cast("int")), t)


# Comparison: NaN is unordered and differs from everything.

def _sound(x: Column, y: Column, t: str) -> Column:
    return ~(F.isnan(x) | F.isnan(y)) if t in FLOATS else F.lit(True)


def _compare(op: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    def run(x: Scalar, y: Scalar, t: str = "double") -> Column:
        x, y = col(x).cast(t), col(y).cast(t)
        return _sound(x, y, t) & op(x, y)

    return run


lt = _compare(lambda x, y: x < y)
gt = _compare(lambda x, y: x > y)
le = _compare(lambda x, y: x <= y)
ge = _compare(lambda x, y: x >= y)
eq = _compare(lambda x, y: x == y)


def ne(x: Scalar, y: Scalar, t: str = "double") -> Column:
    return ~eq(x, y, t)


# Boolean algebra.

def b_not(x: Scalar) -> Column:
    return ~col(x)


def b_or(x: Scalar, y: Scalar) -> Column:
    return col(x) | col(y)


def b_and(x: Scalar, y: Scalar) -> Column:
    return col(x) & col(y)


def b_xor(x: Scalar, y: Scalar) -> Column:
    return col(x) != col(y)


def b_eq(x: Scalar, y: Scalar) -> Column:
    return col(x) == col(y)


b_ne = b_xor


# Mathematics on floats.

def _domain(x: Column, inside: Column, value: Column, outside: Column) -> Column:
    return F.when(F.isnan(x), F.lit(NAN)).when(inside, value).otherwise(outside)


def log(x: Scalar) -> Column:
    x = col(x).cast("double")
    return _domain(x, x > 0, F.ln(x), F.when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN)))


def log2(x: Scalar) -> Column:
    x = col(x).cast("double")
    return _domain(x, x > 0, F.log2(x), F.when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN)))


def log10(x: Scalar) -> Column:
    x = col(x).cast("double")
    return _domain(x, x > 0, F.log10(x), F.when(x == 0, F.lit(-INF)).otherwise(F.lit(NAN)))


def floor(x: Scalar) -> Column:
    """Stays floating, also beyond the range of integers."""
    x = col(x).cast("double")
    whole = F.abs(x) < float(1 << 53)
    return F.when(whole, F.floor(F.when(whole, x)).cast("double")).otherwise(x)


def ceil(x: Scalar) -> Column:
    return -floor(-col(x).cast("double"))


def maximum(x: Scalar, y: Scalar, t: str = "double") -> Column:
    """The larger one; a NaN gives way to the other."""
    x, y = col(x).cast(t), col(y).cast(t)
    if t in FLOATS:
        return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.greatest(x, y))
    return F.greatest(x, y)


def minimum(x: Scalar, y: Scalar, t: str = "double") -> Column:
    x, y = col(x).cast(t), col(y).cast(t)
    if t in FLOATS:
        return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.least(x, y))
    return F.least(x, y)


def clamp(x: Scalar, lo: Scalar, hi: Scalar, t: str = "double") -> Column:
    return maximum(lo, minimum(hi, x, t), t)


def absolute(x: Scalar, t: str = "double") -> Column:
    """On integers the smallest value wraps to itself."""
    return F.abs(col(x).cast(t)) if t in FLOATS else narrow(F.abs(widen(x, t)), t)


def sign(x: Scalar) -> Column:
    x = col(x).cast("double")
    return F.when(x > 0, F.lit(1.0)).when(x < 0, F.lit(-1.0)).otherwise(F.lit(0.0))


def lerp(a: Scalar, b: Scalar, s: Scalar) -> Column:
    return col(a) + col(s) * (col(b) - col(a))


def unlerp(a: Scalar, b: Scalar, x: Scalar) -> Column:
    return div(col(x) - col(a), col(b) - col(a))


def saturate(x: Scalar) -> Column:
    return clamp(x, 0.0, 1.0)


def smoothstep(a: Scalar, b: Scalar, x: Scalar) -> Column:
    s = saturate(unlerp(a, b, x))
    return s * s * (F.lit(3.0) - 2.0 * s)


def remap(x: Scalar, a: Scalar, b: Scalar, c: Scalar, d: Scalar) -> Column:
    return lerp(c, d, unlerp(a, b, x))


def mad(a: Scalar, b: Scalar, c: Scalar, t: str = "double") -> Column:
    return add(mul(a, b, t), c, t)


def relu(x: Scalar, t: str = "double") -> Column:
    return maximum(x, 0, t)


def frac(x: Scalar) -> Column:
    return col(x) - floor(x)


def rcp(x: Scalar) -> Column:
    return div(1.0, x)


def rsqrt(x: Scalar) -> Column:
    return div(1.0, F.sqrt(col(x)))


def step(x: Scalar, y: Scalar) -> Column:
    return F.when(ge(x, y), F.lit(1.0)).otherwise(F.lit(0.0))


def power(x: Scalar, p: Scalar) -> Column:
    return F.pow(col(x).cast("double"), col(p).cast("double"))


#: Unary functions by name.
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": absolute, "sign": sign, "sqrt": F.sqrt, "acos": F.acos, "asin": F.asin, "atan": F.atan, "ceil": ceil, "cos": F.cos,
    "cosh": F.cosh, "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "exp10": lambda x: F.pow(F.lit(10.0), x), "floor": floor,
    "log": log, "log2": log2, "log10": log10, "round": F.rint, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh,
    "acosh": F.acosh, "degrees": lambda x: x * (180.0 / math.pi), "radians": lambda x: x * (math.pi / 180.0), "rcp": rcp,
    "relu": relu, "saturate": saturate, "frac": frac, "rsqrt": rsqrt,
}
#: Binary functions by name.
BINARY: dict[str, Callable[..., Column]] = {
    "max": maximum, "min": minimum, "atan2": F.atan2, "fmod": mod, "mod": mod, "pow": power, "step": step,
    "distance": lambda x, y: F.abs(col(x) - col(y)), "distancesq": lambda x, y: (col(x) - col(y)) * (col(x) - col(y)),
}
