"""The nine reduction operators as aggregates, with their identities and typed results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointset.functions.scalar import int_div, max2, min2

OPERATORS = ("sum", "diff", "prod", "div", "max", "min", "or", "and", "xor")
#: What a reduction over nothing gives.
IDENTITY = {"sum": 0, "diff": 0, "prod": 1, "div": 1, "max": -1.7976931348623157e308, "min": 1.7976931348623157e308, "or": 0, "and": -1, "xor": 0}


def reduce(op: str, x: Column, kind: str = "double", initial: Column | None = None) -> Column:
    """The aggregate ``op`` over ``x``; kind is one of double, long, boolean.

    NaN never wins max or min.  ``diff`` and ``div`` take everything off ``initial`` (0 and 1 where none is given).  A long
    division one after the other is the division by the product, which is exact up to 2^53 and beyond that nearly always
    larger than what is divided.  Long products run over the list of values, so reduce them by a key with few rows each, or
    by ``launch.reduce_by_task``, which keeps one partial product for each batch.
    """
    flag = kind == "boolean"
    if op == "sum":
        return F.bool_or(x) if flag else F.sum(x)
    if op == "diff":
        return (F.lit(0) if initial is None else initial) - F.coalesce(F.sum(x), F.lit(0))
    if op == "prod":
        if flag:
            return F.bool_and(x)
        return F.product(x) if kind == "double" else F.aggregate(F.collect_list(x), F.lit(1).cast("long"), lambda a, b: a * b)
    if op == "div":
        if kind == "double":
            return (F.lit(1.0) if initial is None else initial) / F.product(x)
        first = (F.lit(1) if initial is None else initial).cast("long")
        by = F.coalesce(F.product(x.cast("double")), F.lit(1.0))
        return F.when(F.abs(by) <= 2**53, int_div(first, by.cast("long"))).otherwise((first / by).cast("long"))
    if op in ("max", "min"):
        number = F.when(~F.isnan(x), x) if kind == "double" else x
        return F.max(number) if op == "max" else F.min(number)
    if op == "xor":
        return (F.sum(x.cast("int")) % 2 == 1) if flag else F.bit_xor(x)
    if op == "or":
        return F.bool_or(x) if flag else F.bit_or(x)
    if op == "and":
        return F.bool_and(x) if flag else F.bit_and(x)
    raise ValueError(f"no reduction {op}")


def combine(op: str, a: Column, b: Column, kind: str = "double") -> Column:
    """``a op b`` for two columns; a null side is no value, and NaN never wins max or min."""
    both = {
        "sum": lambda: a + b, "diff": lambda: a - b, "prod": lambda: a * b, "div": lambda: int_div(a, b) if kind == "long" else a / b,
        "max": lambda: max2(a, b) if kind == "double" else F.greatest(a, b), "min": lambda: min2(a, b) if kind == "double" else F.least(a, b),
        "or": lambda: a.bitwiseOR(b), "and": lambda: a.bitwiseAND(b), "xor": lambda: a.bitwiseXOR(b),
    }[op]()
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def complex_sum(re: Column, im: Column) -> tuple[Column, Column]:
    return F.sum(re), F.sum(im)


def complex_total(re: Column, im: Column) -> Column:
    """The product of all numbers of a group, as a struct (re, im): moduli multiply, angles add."""
    size, angle = F.product(F.hypot(re, im)), F.sum(F.atan2(im, re))
    return F.struct((size * F.cos(angle)).alias("re"), (size * F.sin(angle)).alias("im"))


def complex_product(a: Column, b: Column) -> Column:
    """The product of two structs (re, im)."""
    return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def reduce_fields(fields: dict[str, tuple[str, str]]) -> list[Column]:
    """One aggregate for each field, by field -> (operator, kind): fields of several types in one pass."""
    return [reduce(op, F.col(f), kind).alias(f) for f, (op, kind) in fields.items()]
