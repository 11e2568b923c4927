"""Partitions: rows (color, point) over the points of a region.

A partition knows whether it is declared disjoint, which saves a distinct where one is not needed.  All constructors are lazy
DataFrame plans.  Points, pointers and colors have one column or several: where a function takes a name, it takes a list of
names as well, one for each dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce as fold

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointset.operators.rangejoin import Names, listed, points_in_ranges, widths
from pointset.operators.scan import numbered

Fields = str | Column | list


def columns(fields: Fields) -> list[Column]:
    return [F.col(f) if isinstance(f, str) else f for f in (fields if isinstance(fields, list) else [fields])]


def _colors(n: int) -> list[str]:
    return ["color"] if n == 1 else [f"color{k}" for k in range(n)]


@dataclass(frozen=True)
class Partition:
    df: DataFrame
    color: list[str]
    point: list[str]
    disjoint: bool | None = None

    @property
    def keys(self) -> list[str]:
        return [*self.color, *self.point]

    # set algebra, color by color
    def union(self, other: Partition) -> Partition:
        return replace(self, df=self.df.select(self.keys).unionByName(other.df.select(self.keys)).distinct(), disjoint=None)

    def intersect(self, other: Partition) -> Partition:
        return replace(self, df=self.df.join(other.df, self.keys, "left_semi"))

    def minus(self, other: Partition) -> Partition:
        return replace(self, df=self.df.join(other.df, self.keys, "left_anti"))

    def mirror(self, space: DataFrame) -> Partition:
        """Every subspace cut with one space."""
        return replace(self, df=self.df.join(space.select(self.point), self.point, "left_semi"))

    def cross(self, *others: Partition, names: list[str] | None = None) -> Partition:
        """Subspaces of every combination of colors; ``names`` for the colors of the others, color2, color3, ... where none are given."""
        width = len(self.color) + sum(len(p.color) for p in others)
        names = names or [f"color{k}" for k in range(len(self.color) + 1, width + 1)]
        df, given = self.df.select(self.keys), iter(names)
        for p in others:
            df = df.join(p.df.select(*[F.col(c).alias(next(given)) for c in p.color], *p.point), self.point)
        return Partition(df.select(*self.color, *names, *self.point), [*self.color, *names], self.point, self.disjoint and all(p.disjoint for p in others))

    def cross_colorings(self, colorings: dict, names: Names = "color2") -> Partition:
        """Each subspace partitioned by a coloring of its own: color -> (names, point); points outside of the subspace drop out."""
        rows = [c.select(*[F.lit(v).alias(k) for k, v in zip(self.color, color if isinstance(color, tuple) else (color,), strict=True)], *listed(names), *self.point) for color, c in colorings.items()]
        df = self.df.select(self.keys).join(fold(DataFrame.unionByName, rows), self.keys)
        return Partition(df.select(*self.color, *listed(names), *self.point).distinct(), [*self.color, *listed(names)], self.point)

    # navigation and lists
    def sub(self, *color) -> DataFrame:
        return self.df.where(self._is(color)).select(self.point)

    def _is(self, color) -> Column:
        return fold(lambda a, b: a & b, [F.col(c) == v for c, v in zip(self.color, color, strict=True)])

    def slice(self, colors: list) -> Partition:
        """The subspaces of the listed colors (tuples where colors have several columns)."""
        chosen = [c if isinstance(c, tuple) else (c,) for c in colors]
        return replace(self, df=self.df.where(fold(lambda a, b: a | b, [self._is(c) for c in chosen], F.lit(False))))

    def duplicate(self, names: Names) -> Partition:
        """The same subspaces under other color columns."""
        return replace(self, df=self.df.withColumnsRenamed(dict(zip(self.color, listed(names), strict=True))), color=listed(names))

    def invert(self) -> Partition:
        """A cross product with its first color last."""
        color = [*self.color[1:], self.color[0]]
        return replace(self, df=self.df.select(*color, *self.point), color=color)

    def colors(self) -> DataFrame:
        return self.df.select(self.color).distinct()

    def colors_of(self, points: DataFrame) -> DataFrame:
        """The colors that hold some of the given points."""
        return self.df.join(points.select(self.point), self.point, "left_semi").select(self.color).distinct()

    def cross_list(self, other: Partition, names: list[str] | None = None) -> DataFrame:
        """The pairs of colors of two partitions whose subspaces share a point."""
        return self.cross(other, names=names).colors()

    def volumes(self) -> DataFrame:
        return self.df.groupBy(self.color).agg(F.count("*").alias("volume"))

    def interfering(self) -> DataFrame:
        """Pairs of different colors that share a point: color1 and color2, structs where colors have several columns."""
        whole = F.col(self.color[0]) if len(self.color) == 1 else F.struct(*self.color)
        a, b = self.df.select(*self.point, whole.alias("color1")), self.df.select(*self.point, whole.alias("color2"))
        return a.join(b, self.point).where("color1 < color2").select("color1", "color2").distinct()

    def kinds(self, parent: DataFrame) -> DataFrame:
        """One row: is no point in two colors, and is every point of the parent in some color."""
        most = self.df.groupBy(self.point).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
        missing = parent.select(self.point).join(self.df.select(self.point), self.point, "left_anti").agg(F.count("*").alias("missing"))
        return most.crossJoin(missing).select((F.col("most") <= 1).alias("disjoint"), (F.col("missing") == 0).alias("complete"))

    def of(self, region: DataFrame) -> DataFrame:
        """The region's rows by color."""
        return self.df.join(region, self.point)


def _bounds(parent: DataFrame, point: Names) -> DataFrame:
    ends = [f(p).alias(f"__{name}{k}") for k, p in enumerate(listed(point)) for name, f in (("lo", F.min), ("hi", F.max))]
    return F.broadcast(parent.agg(*ends))  # one row


def _delinear(linear: Column, extents: list[int]) -> list[Column]:
    """Color columns from a linear color, the first dimension fastest."""
    out, before = [], 1
    for n in extents:
        out.append(F.pmod(F.floor(linear / before), F.lit(n)).cast("long"))
        before *= n
    return out


def equal(parent: DataFrame, point: Names, n: int | list[int]) -> Partition:
    """n pieces of a dense space along its largest dimension (the first of several), piece i from floor(i * T / n) on.

    A list for ``n`` gives colors of several dimensions, numbered with the first dimension fastest.
    """
    point, extents = listed(point), [n] if isinstance(n, int) else n
    total = fold(lambda a, b: a * b, extents)
    size = [F.col(f"__hi{k}") - F.col(f"__lo{k}") + 1 for k in range(len(point))]
    piece = [F.floor(((F.col(p) - F.col(f"__lo{k}") + 1) * total - 1) / size[k]) for k, p in enumerate(point)]
    linear = piece[-1]
    for k in reversed(range(len(point) - 1)):
        linear = F.when(size[k] >= F.greatest(*size[k + 1 :], F.lit(0)), piece[k]).otherwise(linear)
    color = [c.alias(x) for c, x in zip(_delinear(linear, extents), _colors(len(extents)), strict=True)]
    return Partition(parent.select(point).crossJoin(_bounds(parent, point)).select(*color, *point), _colors(len(extents)), point, True)


def equal_sparse(parent: DataFrame, point: str, n: int) -> Partition:
    """n pieces of like volume of any space, in order."""
    ranked = numbered(parent.select(point), point, "__rank")
    total = F.broadcast(parent.agg(F.count("*").alias("__t")))  # one row
    return Partition(ranked.crossJoin(total).select(F.floor(((F.col("__rank") + 1) * n - 1) / F.col("__t")).cast("long").alias("color"), point), ["color"], [point], True)


def equal_blocks(parent: DataFrame, points: list[str], colors: list[int]) -> Partition:
    """Blocks of ceil(extent / colors) along each dimension."""
    out = [F.floor((F.col(p) - F.col(f"__lo{k}")) / F.ceil((F.col(f"__hi{k}") - F.col(f"__lo{k}") + 1) / n)).cast("long").alias(f"color{k}") for k, (p, n) in enumerate(zip(points, colors, strict=True))]
    return Partition(parent.select(points).crossJoin(_bounds(parent, points)).select(*out, *points), [f"color{k}" for k in range(len(points))], points, True)


def by_weights(parent: DataFrame, point: str, weights: DataFrame) -> Partition:
    """Pieces of a dense space in proportion to (color, weight), cut at lo + floor(total * cumulated / sum).

    Cuts and points meet in cells of a quarter of a mean piece, so the cuts are at most five rows a color and the points stay where they are or are dealt by cell.
    """
    running = F.sum("weight").over(Window.orderBy("color"))  # one row a color
    all_ = F.broadcast(weights.agg(F.sum("weight").alias("__all"), F.count("*").alias("__n")))  # one row
    w = weights.select("color", running.alias("__after"), (running - F.col("weight")).alias("__before")).crossJoin(all_).crossJoin(_bounds(parent, point))
    size = F.col("__hi0") - F.col("__lo0") + 1
    wide = F.greatest(F.floor(size / (4 * F.col("__n"))), F.lit(1))
    cut = w.select("color", "__lo0", wide.alias("__wide"), F.floor(size * F.col("__before") / F.col("__all")).alias("__a"), (F.floor(size * F.col("__after") / F.col("__all")) - 1).alias("__b"))
    cells = cut.where("__b >= __a").select("color", "__lo0", "__a", "__b", F.explode(F.sequence(F.floor(F.col("__a") / F.col("__wide")), F.floor(F.col("__b") / F.col("__wide")))).alias("__cell"))
    at = parent.select(point).crossJoin(F.broadcast(cut.select("__wide", F.col("__lo0").alias("__first")).limit(1)))  # one row
    at = at.select(point, (F.col(point) - F.col("__first")).alias("__off"), F.floor((F.col(point) - F.col("__first")) / F.col("__wide")).alias("__cell"))
    return Partition(at.join(cells, "__cell").where(F.col("__off").between(F.col("__a"), F.col("__b"))).select("color", point), ["color"], [point], True)


def by_field(region: DataFrame, point: list[str], field: Fields, colors: DataFrame | None = None) -> Partition:
    """Color is the value of a field, or of a function of fields (several of both for colors of several dimensions); values outside ``colors`` drop out."""
    value = columns(field)
    names = _colors(len(value))
    df = region.select(*[v.alias(c) for v, c in zip(value, names, strict=True)], *point)
    return Partition(df.join(colors.select(names), names, "left_semi") if colors is not None else df, names, point, True)


def image(parent: DataFrame, point: Names, source: Partition, region: DataFrame, pointer: Fields) -> Partition:
    """The points of ``parent`` to which the points of a color point."""
    point = listed(point)
    target = [c.alias(p) for c, p in zip(columns(pointer), point, strict=True)]
    reached = source.df.join(region, source.point).select(*source.color, *target).distinct()
    return Partition(reached.join(parent.select(point), point, "left_semi").select(*source.color, *point), source.color, point)


def image_by_task(parent: DataFrame, point: Names, source: Partition, region: DataFrame, task: Callable[[pd.DataFrame], pd.DataFrame]) -> Partition:
    """The image through a function of whole batches of rows, for pointers that no expression gives.

    task: rows of the region with their colors -> colors and points, as many rows of each as it likes.
    """
    point = listed(point)
    rows = source.df.join(region, source.point)
    kinds = ", ".join([f"`{c}` {source.df.schema[c].dataType.simpleString()}" for c in source.color] + [f"`{p}` {parent.schema[p].dataType.simpleString()}" for p in point])

    names = [*source.color, *point]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield task(batch)[names]

    reached = rows.mapInPandas(run, kinds).distinct()
    return Partition(reached.join(parent.select(point), point, "left_semi").select(*source.color, *point), source.color, point)


def _boxes(rows: DataFrame, keep: list[str], lo: Fields, hi: Fields) -> tuple[DataFrame, list[str], list[str]]:
    low, high = columns(lo), columns(hi)
    names = [f"__from{k}" for k in range(len(low))], [f"__to{k}" for k in range(len(high))]
    return rows.select(*keep, *[c.alias(x) for c, x in zip([*low, *high], [*names[0], *names[1]], strict=True)]), *names


def image_range(parent: DataFrame, point: Names, source: Partition, region: DataFrame, lo: Fields, hi: Fields, width: int | list[int]) -> Partition:
    """The points of ``parent`` in the ranges (boxes) that the points of a color hold; an empty range holds none."""
    point = listed(point)
    ranges, low, high = _boxes(source.df.join(region, source.point), source.color, lo, hi)
    return Partition(points_in_ranges(parent.select(point), ranges.distinct(), point, low, high, width).select(*source.color, *point).distinct(), source.color, point)


def image_with_difference(parent: DataFrame, point: Names, source: Partition, region: DataFrame, pointer: Fields, without: Partition) -> Partition:
    return image(parent, point, source, region, pointer).minus(without)


def preimage(target: Partition, region: DataFrame, point: list[str], pointer: Fields) -> Partition:
    """The points whose pointer lies in a color."""
    at = [f"__at{k}" for k in range(len(target.point))]
    df = region.select(*point, *[c.alias(a) for c, a in zip(columns(pointer), at, strict=True)]).join(target.df.withColumnsRenamed(dict(zip(target.point, at, strict=True))), at)
    return Partition(df.select(*target.color, *point), target.color, point, target.disjoint)


def preimage_range(target: Partition, region: DataFrame, point: list[str], lo: Fields, hi: Fields, width: int | list[int]) -> Partition:
    """The points whose range (box) touches a color."""
    ranges, low, high = _boxes(region, point, lo, hi)
    at = [f"__at{k}" for k in range(len(target.point))]
    held = target.df.withColumnsRenamed(dict(zip(target.point, at, strict=True)))
    return Partition(points_in_ranges(held, ranges, at, low, high, width).select(*target.color, *point).distinct(), target.color, point)


def of_regions(made: list[Partition]) -> Partition:
    """Images or preimages over several regions or fields as one partition."""
    return fold(Partition.union, made)


def by_ranges(parent: DataFrame, point: Names, ranges: DataFrame, width: int | list[int], color: Names = "color", lo: Names = "lo", hi: Names = "hi") -> Partition:
    """Explicit ranges or boxes (color, lo, hi), several to a color if wanted, cut with the parent."""
    point, color = listed(point), listed(color)
    return Partition(points_in_ranges(parent.select(point), ranges, point, lo, hi, width).select(*color, *point).distinct(), color, point)


def by_points(parent: DataFrame, point: Names, coloring: DataFrame, color: Names = "color") -> Partition:
    """Explicit points (color, point), cut with the parent."""
    point, color = listed(point), listed(color)
    return Partition(coloring.select(*color, *point).distinct().join(parent.select(point), point, "left_semi").select(*color, *point), color, point)


def restriction(parent: DataFrame, point: Names, colors: DataFrame, scale: int | list[list[int]], extent: tuple, color: Names = "color") -> Partition:
    """Color c holds the points of the parent in the box scale * c + [extent[0], extent[1]] (bounds inclusive).

    scale: a matrix with a row for each dimension of the points and a column for each of the colors; extent: bounds for each dimension.
    """
    point, color = listed(point), listed(color)
    matrix = [[scale]] if isinstance(scale, int) else scale
    low, high = (list(e) if isinstance(e, (list, tuple)) else [e] for e in extent)
    base = [fold(lambda a, b: a + b, [F.col(c).cast("long") * k for c, k in zip(color, row, strict=True)]) for row in matrix]
    names = [f"__lo{k}" for k in range(len(point))], [f"__hi{k}" for k in range(len(point))]
    boxes = colors.select(*color, *[(b + e).alias(x) for b, e, x in zip([*base, *base], [*low, *high], [*names[0], *names[1]], strict=True)])
    return by_ranges(parent, point, boxes, [max(1, b - a + 1) for a, b in zip(low, high, strict=True)], color, *names)


def blockify(parent: DataFrame, point: Names, size: int | list[int], origin: int | list[int] = 0) -> Partition:
    """Tiles of ``size``; a point's color is the number of its tile from the origin."""
    point = listed(point)
    sizes, origins = widths(size, len(point)), widths(origin, len(point))
    color = [F.floor((F.col(p) - o) / s).cast("long").alias(c) for p, s, o, c in zip(point, sizes, origins, _colors(len(point)), strict=True)]
    return Partition(parent.select(*color, *point), _colors(len(point)), point, True)


def pending(parts: dict, point: list[str]) -> Partition:
    """A partition filled color by color with spaces that set operations made."""
    rows = [space.select(F.lit(c).alias("color"), *point) for c, space in parts.items()]
    return Partition(fold(DataFrame.unionByName, rows).distinct(), ["color"], point)


def association(domain: DataFrame, point: str, range_: DataFrame, target: str, field: str, back: str | None = None) -> DataFrame:
    """A pointer field that sends the k-th point of one space to the k-th of another, in order; null where there is none.

    With ``back`` the rows of the other space as well: point, field, target, back.
    """
    a, b = numbered(domain.select(point), point, "__rank"), numbered(range_.select(target), target, "__rank")
    if back is None:
        return a.join(b, "__rank", "left").select(point, F.col(target).alias(field))
    both = a.join(b, "__rank", "full")
    return both.select(point, F.col(target).alias(field), target, F.col(point).alias(back))


def tighten(space: DataFrame, point: Names) -> DataFrame:
    """One row: the exact bounds lo0, hi0, lo1, ... of a space, and its volume."""
    ends = [f(p).alias(f"{name}{k}") for k, p in enumerate(listed(point)) for name, f in (("lo", F.min), ("hi", F.max))]
    return space.agg(*ends, F.count("*").alias("volume"))


def rects(space: DataFrame, point: str) -> DataFrame:
    """The maximal runs (lo, hi) of a one-dimensional space: points that follow each other have the same distance to their rank."""
    ranked = numbered(space.select(point).distinct(), point, "__rank")
    return ranked.groupBy((F.col(point) - F.col("__rank")).alias("__run")).agg(F.min(point).alias("lo"), F.max(point).alias("hi")).drop("__run")


def covering(space: DataFrame, point: str, most: int) -> DataFrame:
    """At most ``most`` ranges (lo, hi) that hold all points of a one-dimensional space with the least excess: the largest gaps stay open.

    The points' order is taken in blocks (``numbered``); only the ``most - 1`` largest gaps are looked at whole.
    """
    runs = rects(space, point)
    ranked = numbered(runs, "lo", "__rank")
    follower = ranked.select(F.col("lo").alias("__next"), (F.col("__rank") - 1).alias("__rank"))
    gaps = ranked.join(follower, "__rank").select("hi", F.col("__next").alias("lo"), (F.col("__next") - F.col("hi") - 1).alias("gap"))
    largest = gaps.orderBy(F.desc("gap"), "hi").limit(most - 1)
    ends = space.agg(F.min(point).alias("first"), F.max(point).alias("last")).where("first is not null")
    cuts = largest.select("hi", "lo").unionByName(ends.select(F.col("last").alias("hi"), F.lit(None).cast("long").alias("lo"))).unionByName(ends.select(F.lit(None).cast("long").alias("hi"), F.col("first").alias("lo")))
    numbered_lo = cuts.where("lo is not null").select("lo", F.row_number().over(Window.orderBy("lo")).alias("k"))  # at most ``most`` rows
    numbered_hi = cuts.where("hi is not null").select("hi", F.row_number().over(Window.orderBy("hi")).alias("k"))
    return numbered_lo.join(numbered_hi, "k").select("lo", "hi")


def covering_boxes(space: DataFrame, point: list[str], most: int, max_overhead: float | None = None) -> DataFrame:
    """At most ``most`` boxes that hold all points of a space of several dimensions: the bounds of the occupied tiles of the finest grid of powers of two with so few of them.

    Boxes: lo0, hi0, lo1, ..., volume (points held).  With ``max_overhead`` no rows if the boxes hold more than that share of other points.
    """
    bounds = _bounds(space, point)
    grids = []
    for depth in range(max(1, most.bit_length())):
        cells = [F.floor((F.col(p) - F.col(f"__lo{k}")) * (1 << depth) / (F.col(f"__hi{k}") - F.col(f"__lo{k}") + 1)) for k, p in enumerate(point)]
        grids.append(F.struct(F.lit(depth).alias("depth"), F.array(*cells).alias("cell")))
    tiled = space.select(point).distinct().crossJoin(bounds).select(*point, F.explode(F.array(*grids)).alias("g"))
    ends = [f(p).alias(f"{name}{k}") for k, p in enumerate(point) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = tiled.groupBy("g.depth", "g.cell").agg(*ends, F.count("*").alias("volume"))
    area = fold(lambda a, b: a * b, [F.col(f"hi{k}") - F.col(f"lo{k}") + 1 for k in range(len(point))])
    fine = boxes.groupBy("depth").agg(F.count("*").alias("n"), F.sum(area).alias("area"), F.sum("volume").alias("points")).where(F.col("n") <= most)
    best = fine.agg(F.max_by(F.struct("area", "points", "depth"), "depth").alias("b")).select("b.*")
    if max_overhead is not None:
        best = best.where(F.col("area") - F.col("points") <= max_overhead * F.col("points"))
    return boxes.join(F.broadcast(best.select("depth")), "depth").drop("depth", "cell")  # one row


def subset(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: is every point of ``a`` a point of ``b``."""
    return a.select(keys).join(b.select(keys), keys, "left_anti").agg((F.count("*") == 0).alias("holds"))


def apart(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: do two spaces share no point."""
    return a.select(keys).join(b.select(keys), keys, "left_semi").agg((F.count("*") == 0).alias("holds"))


def constrained(df: DataFrame, *holds: DataFrame) -> DataFrame:
    """``df``, or an error where a constraint (``subset``, ``apart``) does not hold."""
    for h in holds:
        checked = h.select(F.when(F.col("holds"), F.lit(True)).otherwise(F.raise_error(F.lit("a constraint on regions does not hold")).cast("boolean")).alias("__holds"))
        df = df.crossJoin(F.broadcast(checked)).where("__holds").drop("__holds")  # one row
    return df
