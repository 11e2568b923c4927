"""Joins on ranges and boxes as equi-joins on cells, so that they shuffle instead of comparing all pairs."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Names = str | list[str]


def listed(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def widths(width: int | list[int], dims: int) -> list[int]:
    return [width] * dims if isinstance(width, int) else list(width)


def _cells(lo: Column, hi: Column, width: int) -> Column:
    """Cells of [lo, hi]; none if it is empty."""
    return F.when(hi >= lo, F.sequence(F.floor(lo / width), F.floor(hi / width))).otherwise(F.array().cast("array<bigint>"))


def _in_cells(df: DataFrame, lo: list[str], hi: list[str], width: list[int], prefix: str) -> DataFrame:
    """A row for each cell that a box touches; an empty box has none."""
    for k, (a, b, w) in enumerate(zip(lo, hi, width, strict=True)):
        df = df.withColumn(f"{prefix}{k}", F.explode(_cells(F.col(a), F.col(b), w)))
    return df


def points_in_ranges(points: DataFrame, ranges: DataFrame, point: Names, lo: Names, hi: Names, width: int | list[int]) -> DataFrame:
    """Pairs of a point and a range or box that holds it (bounds inclusive).  A point has one cell, so a pair comes once.

    Choose ``width`` near the usual length of a range: a range has a row for each cell that it touches.
    """
    point, lo, hi = listed(point), listed(lo), listed(hi)
    width = widths(width, len(point))
    r = _in_cells(ranges, lo, hi, width, "__r")
    p = points
    for k, (c, w) in enumerate(zip(point, width, strict=True)):
        p = p.withColumn(f"__p{k}", F.floor(F.col(c) / w))
    dims = range(len(point))
    on = [(p[f"__p{k}"] == r[f"__r{k}"]) & (F.col(point[k]) >= F.col(lo[k])) & (F.col(point[k]) <= F.col(hi[k])) for k in dims]
    return p.join(r, fold(lambda a, b: a & b, on)).drop(*[f"__{c}{k}" for k in dims for c in "pr"])


def ranges_overlap(a: DataFrame, b: DataFrame, a_lo: Names, a_hi: Names, b_lo: Names, b_hi: Names, width: int | list[int]) -> DataFrame:
    """Pairs of ranges or boxes that share a point; a pair is kept in the first cell that both touch."""
    a_lo, a_hi, b_lo, b_hi = (listed(x) for x in (a_lo, a_hi, b_lo, b_hi))
    dims = range(len(a_lo))
    width = widths(width, len(a_lo))
    x, y = _in_cells(a, a_lo, a_hi, width, "__a"), _in_cells(b, b_lo, b_hi, width, "__b")
    on = []
    for k in dims:
        first = F.col(f"__a{k}") == F.floor(F.greatest(F.col(a_lo[k]), F.col(b_lo[k])) / width[k])
        on.append((F.col(f"__a{k}") == F.col(f"__b{k}")) & (F.col(a_lo[k]) <= F.col(b_hi[k])) & (F.col(b_lo[k]) <= F.col(a_hi[k])) & first)
    return x.join(y, fold(lambda p, q: p & q, on)).drop(*[f"__{c}{k}" for k in dims for c in "ab"])
