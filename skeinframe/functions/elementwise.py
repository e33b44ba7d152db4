"""Elementwise functions as Column expressions: all inside whole-stage code generation.

Values follow IEEE arithmetic where Spark returns NULL or raises: division by zero
is infinite, log(0) is -inf, log of a negative number NaN, comparisons with NaN
are false. NULL stays NULL. Complex numbers are structs (re, im); functions named c* take them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def _number(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _known(*columns: Column) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & ~F.isnan(c.cast("double"))
    return out


# arithmetic -------------------------------------------------------------------

_LOW = (1 << 32) - 1


def wrapped_add(a, b) -> Column:
    """The sum of two 64-bit whole numbers modulo 2^64, in halves of 32 bits, which can't overflow."""
    a, b = _number(a).cast("long"), _number(b).cast("long")
    low = a.bitwiseAND(F.lit(_LOW)) + b.bitwiseAND(F.lit(_LOW))
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def wrapped_mul(a, b) -> Column:
    """The product of two 64-bit whole numbers modulo 2^64."""
    a, b = _number(a).cast("long"), _number(b).cast("long")
    low = lambda x: x.bitwiseAND(F.lit(_LOW))
    cross = low(F.shiftright(a, 32) * low(b)) + low(low(a) * F.shiftright(b, 32))
    # of the low halves' product the lower half's 16 bits come apart, so that both parts stay below 2^48
    first, second = low(a).bitwiseAND(F.lit(0xFFFF)) * low(b), F.shiftright(low(a), 16) * low(b)
    return wrapped_add(F.shiftleft(cross, 32), wrapped_add(first, F.shiftleft(second, 16)))


def _whole(wide: Column, dtype: str) -> Column:
    from skeinframe import dtypes

    return dtypes.cast(wide, "s64", dtype)


def add(a, b, dtype: str | None = None) -> Column:
    """With a whole dtype the result wraps around at its width; without, Spark's own sum, which raises an error on overflow."""
    return _whole(wrapped_add(a, b), dtype) if dtype else _number(a) + _number(b)


def sub(a, b, dtype: str | None = None) -> Column:
    """dtype: as of add()."""
    return _whole(wrapped_add(a, wrapped_add(F.bitwise_not(_number(b).cast("long")), F.lit(1))), dtype) if dtype else _number(a) - _number(b)


def mul(a, b, dtype: str | None = None) -> Column:
    """dtype: as of add()."""
    return _whole(wrapped_mul(a, b), dtype) if dtype else _number(a) * _number(b)


def div(a, b) -> Column:
    """Real division; x / 0 is infinite, 0 / 0 NaN."""
    a, b = _number(a).cast("double"), _number(b).cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when((a > 0) == ~signbit(b), INF).otherwise(F.lit(-INF))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def idiv(a, b) -> Column:
    """Integer division toward zero; by zero it is NULL, there being no integer for it."""
    q = F.try_divide(_number(a).cast("decimal(20,0)"), _number(b).cast("decimal(20,0)"))
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")


def mod(a, b) -> Column:
    """Sign of the dividend; x mod 0 is NaN for floats."""
    a, b = _number(a), _number(b)
    return F.when(b == 0, NAN).otherwise(a % F.when(b == 0, F.lit(None)).otherwise(b))


def rem(a, b) -> Column:
    """IEEE remainder: a - b * (a / b rounded to the nearest, ties to even)."""
    a, b = _number(a).cast("double"), _number(b).cast("double")
    return F.when(b == 0, NAN).otherwise(a - b * F.rint(F.try_divide(a, b)))


def neg(x) -> Column:
    return -_number(x)


def minof(a, b) -> Column:
    """The smaller; NaN gives way to a number."""
    a, b = _number(a), _number(b)
    return F.least(a, b)


def maxof(a, b) -> Column:
    """The larger; NaN gives way to a number."""
    a, b = _number(a), _number(b)
    return F.when(F.isnan(a.cast("double")), b).when(F.isnan(b.cast("double")), a).otherwise(F.greatest(a, b))


def clamp(x, lo, hi) -> Column:
    return minof(maxof(x, lo), hi)


# comparison and logic ------------------------------------------------------------

def lt(a, b) -> Column:
    a, b = _number(a), _number(b)
    return (a < b) & _known(a, b)


def gt(a, b) -> Column:
    a, b = _number(a), _number(b)
    return (a > b) & _known(a, b)


def le(a, b) -> Column:
    a, b = _number(a), _number(b)
    return (a <= b) & _known(a, b)


def ge(a, b) -> Column:
    a, b = _number(a), _number(b)
    return (a >= b) & _known(a, b)


def eq(a, b) -> Column:
    a, b = _number(a), _number(b)
    return (a == b) & _known(a, b)


def neq(a, b) -> Column:
    return ~eq(a, b)


def true(x) -> Column:
    """x != 0; NaN counts as true."""
    return _number(x).cast("double") != 0


def logical_and(a, b) -> Column:
    return true(a) & true(b)


def logical_or(a, b) -> Column:
    return true(a) | true(b)


def logical_not(x) -> Column:
    return ~true(x)


def select(cond, a, b) -> Column:
    return F.when(true(cond), _number(a)).otherwise(_number(b))


# bits ------------------------------------------------------------------------

def bitand(a, b) -> Column:
    return _number(a).bitwiseAND(_number(b))


def bitor(a, b) -> Column:
    return _number(a).bitwiseOR(_number(b))


def bitxor(a, b) -> Column:
    return _number(a).bitwiseXOR(_number(b))


def bitnot(x) -> Column:
    return F.bitwise_not(_number(x))


def shiftl(x, bits: int) -> Column:
    return F.shiftleft(_number(x), bits)


def shiftr(x, bits: int, unsigned: bool = False) -> Column:
    return (F.shiftrightunsigned if unsigned else F.shiftright)(_number(x), bits)


# rounding and signs -------------------------------------------------------------

def abs_(x) -> Column:
    return F.abs(_number(x))


def signbit(x) -> Column:
    """True for negative numbers and -0.0."""
    x = _number(x).cast("double")
    return (x < 0) | ((x == 0) & (x.cast("string") == "-0.0"))


def sign(x) -> Column:
    """1 for negative numbers, else 0."""
    return signbit(x).cast("int")


def round_(x) -> Column:
    """Half away from zero."""
    x = _number(x).cast("double")
    whole = F.floor(F.abs(x) + 0.5).cast("double")
    return F.when(_finite(x), F.when(x < 0, -whole).otherwise(whole)).otherwise(x)


def _finite(x: Column) -> Column:
    return F.abs(x) < float(1 << 62)


def trunc(x) -> Column:
    x = _number(x).cast("double")
    return F.when(_finite(x), F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")).otherwise(x)


def floor(x) -> Column:
    x = _number(x).cast("double")
    return F.when(_finite(x), F.floor(x).cast("double")).otherwise(x)


def ceil(x) -> Column:
    x = _number(x).cast("double")
    return F.when(_finite(x), F.ceil(x).cast("double")).otherwise(x)


# powers, exponentials, logarithms ----------------------------------------------------

def pow_(a, b) -> Column:
    return F.pow(_number(a), _number(b))


def root(order, x) -> Column:
    """x ^ (1 / order)."""
    return F.pow(_number(x), div(1.0, order))


def pow2(x) -> Column:
    """2 ^ x."""
    return F.pow(F.lit(2.0), _number(x))


def sqrt(x) -> Column:
    return F.sqrt(_number(x))


def rsqrt(x) -> Column:
    return div(1.0, F.sqrt(_number(x)))


def cbrt(x) -> Column:
    return F.cbrt(_number(x))


def exp(x) -> Column:
    return F.exp(_number(x))


def expm1(x) -> Column:
    return F.expm1(_number(x))


def sigmoid(x) -> Column:
    x = _number(x).cast("double")
    return 1.0 / (1.0 + F.exp(-x))


def _log(f, x, zero: float = 0.0) -> Column:
    x = _number(x).cast("double")
    return F.when(x > zero, f(x)).when(x == zero, -INF).when(x.isNotNull(), NAN)


def log(x) -> Column:
    return _log(F.log, x)


def log2(x) -> Column:
    return _log(F.log2, x)


def log10(x) -> Column:
    return _log(F.log10, x)


def log1p(x) -> Column:
    return _log(F.log1p, x, -1.0)


# trigonometry ----------------------------------------------------------------------

def sin(x) -> Column:
    return F.sin(_number(x))


def cos(x) -> Column:
    return F.cos(_number(x))


def tan(x) -> Column:
    return F.tan(_number(x))


def asin(x) -> Column:
    return F.asin(_number(x))


def acos(x) -> Column:
    return F.acos(_number(x))


def atan(x) -> Column:
    return F.atan(_number(x))


def atan2(a, b) -> Column:
    return F.atan2(_number(a), _number(b))


def sinh(x) -> Column:
    return F.sinh(_number(x))


def cosh(x) -> Column:
    return F.cosh(_number(x))


def tanh(x) -> Column:
    return F.tanh(_number(x))


def asinh(x) -> Column:
    return F.asinh(_number(x))


def acosh(x) -> Column:
    return F.acosh(_number(x))


def atanh(x) -> Column:
    return F.atanh(_number(x))


def hypot(a, b) -> Column:
    return F.hypot(_number(a), _number(b))


# predicates ------------------------------------------------------------------------

def iszero(x) -> Column:
    return _number(x) == 0


def isinf(x) -> Column:
    return F.abs(_number(x).cast("double")) == F.lit(INF)


def isnan(x) -> Column:
    return F.isnan(_number(x).cast("double"))


# gamma and error functions ----------------------------------------------------------

#: Lanczos approximation with g = 7 and 9 terms (published coefficients; relative error near 1e-15).
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x worked out once however often f uses it: long formulas would else outgrow a generated method."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _lanczos(x: Column) -> tuple[Column, Column]:
    """(t, series) of Gamma(x) for x >= 0.5; t - 7 is x - 0.5."""
    series = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        series = series + c / (x + float(i))
    return x + 6.5, series


def lgamma(x) -> Column:
    """Logarithm of the gamma function's absolute value; infinite at 0 and negative integers."""

    def direct(x: Column) -> Column:
        t, series = _lanczos(x)
        return 0.5 * math.log(2 * math.pi) + (t - 7.0) * F.log(t) - t + F.log(series)

    def value(x: Column) -> Column:
        # below 1/2 by reflection
        pole = (x <= 0) & (F.floor(x) == x)
        reflected = math.log(math.pi) - F.log(F.abs(F.sin(math.pi * x))) - _let(1.0 - x, direct)
        return F.when(pole | isinf(x), INF).when(isnan(x), x).when(x >= 0.5, direct(x)).otherwise(reflected)

    return _let(_number(x).cast("double"), value)


def tgamma(x) -> Column:
    """Gamma function; NaN at negative integers, infinite at 0."""

    def direct(x: Column) -> Column:
        t, series = _lanczos(x)
        # two powers, lest one overflow before the exponential brings it down
        return _let(F.pow(t, (t - 7.0) / 2), lambda half: math.sqrt(2 * math.pi) * half * F.exp(-t) * half * series)

    def value(x: Column) -> Column:
        whole = (F.floor(x) == x) & _finite(x)
        small = whole & (x >= 1) & (x <= 21)
        exact = F.factorial(F.when(small, x - 1).otherwise(0.0).cast("int")).cast("double")
        reflected = F.try_divide(F.lit(math.pi), F.sin(math.pi * x) * _let(1.0 - x, direct))
        edges = F.when(isnan(x), x).when(x == 0, F.when(signbit(x), -INF).otherwise(INF)).when(whole & (x < 0), NAN).when(x > 171.7, INF)
        return edges.when(small, exact).when(x >= 0.5, direct(x)).otherwise(reflected)

    return _let(_number(x).cast("double"), value)


def factorial(x) -> Column:
    """Gamma(x + 1), for any real x."""
    return tgamma(_number(x) + 1)


def _erf_series(x: Column, terms: int = 30) -> Column:
    """2/sqrt(pi) * x * exp(-x^2) * sum (2x^2)^n / (1*3*...*(2n+1)): all terms positive, so nothing cancels."""
    square, total = x * x, F.lit(1.0)
    for n in range(terms, 0, -1):
        total = 1.0 + total * square * (2.0 / (2 * n + 1))
    return 2 / math.sqrt(math.pi) * x * F.exp(-square) * total


def _erfc_fraction(x: Column, depth: int = 40) -> Column:
    """exp(-x^2)/sqrt(pi) / (x + (1/2)/(x + 1/(x + (3/2)/(x + ...)))), for x >= 2."""
    tail = x
    for n in range(depth, 0, -1):
        tail = x + (n / 2.0) / tail
    return F.exp(-x * x) / math.sqrt(math.pi) / tail


def erf(x) -> Column:
    """Error function."""
    x = _number(x).cast("double")
    size = F.abs(x)
    near, far = F.least(size, F.lit(2.0)), F.greatest(size, F.lit(2.0))
    out = F.when(isnan(x), x).when(size < 2, _erf_series(near)).when(size > 27, 1.0).otherwise(1.0 - _erfc_fraction(F.least(far, F.lit(27.0))))
    return F.when(x < 0, -out).otherwise(out)


def erfc(x) -> Column:
    """1 - erf(x), without cancellation for large x."""
    x = _number(x).cast("double")
    size = F.abs(x)
    near, far = F.least(size, F.lit(2.0)), F.greatest(size, F.lit(2.0))
    tail = F.when(isnan(x), x).when(size < 2, 1.0 - _erf_series(near)).when(size > 27, 0.0).otherwise(_erfc_fraction(F.least(far, F.lit(27.0))))
    return F.when(x < 0, 2.0 - tail).otherwise(tail)


# complex numbers --------------------------------------------------------------------

def cplx(re, im=0.0) -> Column:
    return F.struct(_number(re).cast("double").alias("re"), _number(im).cast("double").alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def conjg(z: Column) -> Column:
    return cplx(z["re"], -z["im"])


def cabs(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def arg(z: Column) -> Column:
    """Phase."""
    return F.atan2(z["im"], z["re"])


def arg_real(x) -> Column:
    """Phase of a real number: 0."""
    return F.when(_number(x).isNotNull(), F.lit(0.0))


def cadd(a: Column, b: Column) -> Column:
    return cplx(a["re"] + b["re"], a["im"] + b["im"])


def csub(a: Column, b: Column) -> Column:
    return cplx(a["re"] - b["re"], a["im"] - b["im"])


def cmul(a: Column, b: Column) -> Column:
    return cplx(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def cdiv(a: Column, b: Column) -> Column:
    size = b["re"] * b["re"] + b["im"] * b["im"]
    return cplx(div(a["re"] * b["re"] + a["im"] * b["im"], size), div(a["im"] * b["re"] - a["re"] * b["im"], size))


def cexp(z: Column) -> Column:
    size = F.exp(z["re"])
    return cplx(size * F.cos(z["im"]), size * F.sin(z["im"]))


def clog(z: Column) -> Column:
    return cplx(log(cabs(z)), arg(z))


def cpow(a: Column, b: Column) -> Column:
    """exp(b * log(a)); 0 to any power is 0."""
    raised = cexp(cmul(b, clog(a)))
    zero = cabs(a) == 0
    return cplx(F.when(zero, 0.0).otherwise(raised["re"]), F.when(zero, 0.0).otherwise(raised["im"]))


def csqrt(z: Column) -> Column:
    size, phase = F.sqrt(cabs(z)), arg(z) / 2
    return cplx(size * F.cos(phase), size * F.sin(phase))


def csin(z: Column) -> Column:
    return cplx(F.sin(z["re"]) * F.cosh(z["im"]), F.cos(z["re"]) * F.sinh(z["im"]))


def ccos(z: Column) -> Column:
    return cplx(F.cos(z["re"]) * F.cosh(z["im"]), -F.sin(z["re"]) * F.sinh(z["im"]))


def clt(a: Column, b: Column) -> Column:
    """Complex numbers are ordered by magnitude."""
    return lt(cabs(a), cabs(b))


def ceq(a: Column, b: Column) -> Column:
    return eq(a["re"], b["re"]) & eq(a["im"], b["im"])


def ciszero(z: Column) -> Column:
    return (z["re"] == 0) & (z["im"] == 0)


def cisnan(z: Column) -> Column:
    return isnan(z["re"]) | isnan(z["im"])


def cisinf(z: Column) -> Column:
    return isinf(z["re"]) | isinf(z["im"])
