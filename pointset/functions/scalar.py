"""Scalar expressions with the arithmetic of machine types where it differs from SQL's."""

import math
from functools import reduce as fold

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(a: Column, b: Column) -> Column:
    """Division of integers, towards zero and exact over all of 64 bits; null where b is 0."""
    return F.when(b != 0, F.call_function("div", a, b))


def max2(a: Column, b: Column) -> Column:
    """The larger number; NaN loses to any number."""
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b))


def min2(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b))


def equal(a: Column, b: Column) -> Column:
    """Equality of floats in which NaN equals nothing."""
    return (a == b) & ~F.isnan(a)


def compare(a: Column, b: Column) -> dict[str, Column]:
    """The six comparisons of floats as machines have them: with NaN all are false but ``ne``."""
    number = ~F.isnan(a) & ~F.isnan(b)
    return {"lt": number & (a < b), "gt": number & (a > b), "le": number & (a <= b), "ge": number & (a >= b), "eq": number & (a == b), "ne": ~(number & (a == b))}


def is_null(pointer: Column) -> Column:
    return pointer.isNull()


def null_pointer(kind: str = "bigint") -> Column:
    return F.lit(None).cast(kind)


def point_op(a: Column, b: Column, op: str, dims: tuple[str, ...] = ("x", "y")) -> Column:
    """Points (structs) element by element: + - * div max min, or one of < <= > >= == that must hold in every dimension."""
    each = {
        "+": lambda p, q: p + q, "-": lambda p, q: p - q, "*": lambda p, q: p * q, "div": int_div, "max": F.greatest, "min": F.least,
        "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q, "==": lambda p, q: p == q,
    }[op]
    parts = [each(a[d], b[d]) for d in dims]
    if op in ("<", "<=", ">", ">=", "=="):
        return fold(lambda p, q: p & q, parts)
    return F.struct(*[c.alias(d) for c, d in zip(parts, dims, strict=True)])


def point_wrap(p: Column, lo: Column, hi: Column, dims: tuple[str, ...] = ("x", "y")) -> Column:
    """A point moved round into a rect, dimension by dimension."""
    return F.struct(*[wrap(p[d], lo[d], hi[d]).alias(d) for d in dims])


def rect_volume(lo: Column, hi: Column, dims: tuple[str, ...] = ("x", "y")) -> Column:
    return fold(lambda p, q: p * q, [F.greatest(hi[d] - lo[d] + 1, F.lit(0)) for d in dims])


def clock(unit: str = "us") -> Column:
    """The time at which the query began, as a long of seconds, microseconds or nanoseconds: one value for all rows."""
    us = F.unix_micros(F.current_timestamp())
    return {"s": int_div(us, F.lit(1_000_000)), "us": us, "ns": us * 1000}[unit]


def wrap(x: Column, lo, hi) -> Column:
    """``x`` moved round into [lo, hi], as (x - lo + size) % size + lo with a remainder that keeps the sign."""
    size = hi - lo + 1
    return (x - lo + size) % size + lo


def affine(points: list[Column], matrix: list[list[int]], offset: list[int]) -> list[Column]:
    """matrix * point + offset."""
    rows = []
    for row, c in zip(matrix, offset, strict=True):
        y = F.lit(c).cast("long")
        for k, p in zip(row, points, strict=True):
            y = y + F.lit(k) * p
        rows.append(y)
    return rows


def rect_overlap(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> tuple[Column, Column]:
    """Inclusive intersection; empty where hi < lo."""
    return F.greatest(a_lo, b_lo), F.least(a_hi, b_hi)


def rect_hull(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> tuple[Column, Column]:
    return F.least(a_lo, b_lo), F.greatest(a_hi, b_hi)


def _frexp(x: Column) -> Column:
    """mantissa in [0.5, 1) with the sign of x, and exponent: x = mantissa * 2^exponent; (x, 0) for 0, NaN and infinities."""
    plain = (x == 0) | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    near = F.floor(F.log2(F.abs(F.when(~plain, x)))).cast("int") + 1
    # the logarithm may round across a power of two; the scaling goes by halves, whose powers do not overflow
    mantissa = x / F.pow(F.lit(2.0), F.floor(near / 2)) / F.pow(F.lit(2.0), near - F.floor(near / 2))
    size = F.abs(mantissa)
    return F.struct(
        F.when(plain, x).when(size >= 1, mantissa / 2).when(size < 0.5, mantissa * 2).otherwise(mantissa).alias("mantissa"),
        F.when(plain, F.lit(0)).when(size >= 1, near + 1).when(size < 0.5, near - 1).otherwise(near).cast("int").alias("exponent"),
    )


#: Mathematical functions that are compositions of built-in ones.
COMPOSED = {
    "exp2": lambda x: F.pow(F.lit(2.0), x),
    "fabs": F.abs,
    "finite": lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    "isinf": lambda x: F.abs(x) == F.lit(float("inf")),
    "trunc": lambda x: F.signum(x) * F.floor(F.abs(x)),
    "nearbyint": F.rint,
    "llrint": lambda x: F.rint(x).cast("long"),
    "llround": lambda x: F.round(x).cast("long"),
    "rsqrt": lambda x: F.pow(x, F.lit(-0.5)),
    "logb": lambda x: (_frexp(x)["exponent"] - 1).cast("double"),
    "ilogb": lambda x: _frexp(x)["exponent"] - 1,
    "fdim": lambda x, y: F.greatest(x - y, F.lit(0.0)),
    "fma": lambda x, y, z: x * y + z,
    "fmod": lambda x, y: x % y,
    "fmax": max2,
    "fmin": min2,
    "copysign": lambda x, y: F.abs(x) * F.when(y.cast("string").startswith("-"), -1.0).otherwise(1.0),  # the text shows the sign of -0.0
    "ldexp": lambda x, n: x * F.pow(F.lit(2.0), n),
    "scalbn": lambda x, n: x * F.pow(F.lit(2.0), n),
    "remainder": lambda x, y: x - F.rint(x / y) * y,
    "modf": lambda x: F.struct((x - F.signum(x) * F.floor(F.abs(x))).alias("fraction"), (F.signum(x) * F.floor(F.abs(x))).alias("whole")),
    "frexp": lambda x: _frexp(x),
}
BUILT_IN = tuple("acos acosh asin asinh atan atan2 atanh cbrt ceil cos cosh exp expm1 floor hypot log log10 log1p log2 pow rint round sin sinh sqrt tan tanh isnan".split())


def _bessel(n: int, x: np.ndarray, second: bool) -> np.ndarray:
    """By Bessel's integral, with Gauss-Legendre nodes (and the half-line part for the second kind, which is -inf at 0)."""
    node, weight = np.polynomial.legendre.leggauss(400)
    x = np.asarray(x, float)[:, None]
    t, w = (node + 1) * np.pi / 2, weight * np.pi / 2
    turn = x * np.sin(t) - n * t
    if not second:
        return (np.cos(turn) * w).sum(1) / np.pi
    value = (np.sin(turn) * w).sum(1)
    some = np.where(x > 0, x, 1.0)
    top = np.arcsinh((60 + 20 * n) / some)  # beyond it the integrand is nothing
    t, w = (node + 1) * top / 2, weight * top / 2
    value -= ((np.exp(n * t - some * np.sinh(t)) + (-1) ** n * np.exp(-n * t - some * np.sinh(t))) * w).sum(1)
    return np.where(x[:, 0] > 0, value / np.pi, np.where(x[:, 0] == 0, -np.inf, np.nan))


def _gamma(x: float) -> float:
    try:
        return math.gamma(x)
    except (ValueError, OverflowError):
        return math.inf if x >= 0 else math.nan


#: Functions that neither SQL nor a composition offers: one Arrow batch at a time.
SPECIAL = {"erf": math.erf, "erfc": math.erfc, "lgamma": math.lgamma, "tgamma": _gamma}


def special(name: str, x: Column) -> Column:
    if name in ("j0", "j1", "y0", "y1"):
        return bessel(int(name[1]), x, name[0] == "y")
    f = SPECIAL[name]

    @F.pandas_udf("double")
    def apply(v: pd.Series) -> pd.Series:
        return v.map(f, na_action="ignore").astype("float64")

    return apply(x)


def bessel(n: int, x: Column, second: bool = False) -> Column:
    """jn and yn."""

    @F.pandas_udf("double")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([np.zeros(0), *(_bessel(n, part, second) for part in np.array_split(v.to_numpy(float), 1 + len(v) // 1000))]))

    return apply(x)


def nextafter(x: Column, y: Column) -> Column:
    @F.pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([math.nextafter(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")

    return apply(x, y)
