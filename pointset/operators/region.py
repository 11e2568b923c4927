"""Regions (typed columns keyed by points) and the copies between them."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointset.functions.reductions import combine, reduce
from pointset.functions.scalar import affine


def grid(spark: SparkSession, *extents: tuple[int, int]) -> DataFrame:
    """The points p0, p1, ... of a dense box with inclusive bounds."""
    out = None
    for k, (lo, hi) in enumerate(extents):
        one = spark.range(lo, hi + 1).withColumnRenamed("id", f"p{k}")
        out = one if out is None else out.crossJoin(one)  # a grid is the product of its dimensions
    return out


def region(space: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A region over a space: its points, and fields (name -> type) that hold nothing yet."""
    return space.select("*", *[F.lit(None).cast(kind).alias(f) for f, kind in fields.items()])


def space_of_rects(spark: SparkSession, rects: list[tuple], disjoint: bool = False) -> DataFrame:
    """The points p0, p1, ... of rects ((lo0, lo1, ...), (hi0, hi1, ...)) with inclusive bounds."""
    dims = len(rects[0][0])
    names = [f"lo{k}" for k in range(dims)] + [f"hi{k}" for k in range(dims)]
    rows = spark.createDataFrame([(*lo, *hi) for lo, hi in rects], ", ".join(f"{n} long" for n in names))
    for k in range(dims):
        rows = rows.where(f"hi{k} >= lo{k}").withColumn(f"p{k}", F.explode(F.sequence(f"lo{k}", f"hi{k}")))
    rows = rows.drop(*names)
    return rows if disjoint else rows.distinct()


def inline(region: DataFrame, keys: list[str], most: int = 1_000_000) -> dict:
    """A region's columns as arrays at the driver, in the order of the points; an error beyond ``most`` points."""
    rows = region.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} points do not belong at the driver")
    return {c: x.to_numpy() for c, x in rows.sort_values(keys).items()}


def space_of_ranges(spark: SparkSession, ranges: list[tuple[int, int]], disjoint: bool = False) -> DataFrame:
    """The points ``pt`` of inclusive ranges."""
    rows = spark.createDataFrame(ranges, "lo long, hi long").where("hi >= lo").select(F.explode(F.sequence("lo", "hi")).alias("pt"))
    return rows if disjoint else rows.distinct()


def fill(region: DataFrame, field: str, value: Column, keys: list[str] | None = None, subspace: DataFrame | None = None) -> DataFrame:
    """A field set to one value, everywhere or on a subspace."""
    if subspace is None:
        return region.withColumn(field, value)
    mark = subspace.select(*keys, F.lit(True).alias("__in")).distinct()
    return region.join(mark, keys, "left").withColumn(field, F.when(F.col("__in"), value).otherwise(F.col(field))).drop("__in")


def discard(region: DataFrame, *fields: str) -> DataFrame:
    for f in fields:
        region = region.withColumn(f, F.lit(None).cast(region.schema[f].dataType))
    return region


def copy(dst: DataFrame, src: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """dst.field = src.field where both have the point; fields: source name -> target name."""
    s = src.select(*keys, F.lit(True).alias("__hit"), *[F.col(a).alias(f"__{b}") for a, b in fields.items()])
    out = dst.join(s, keys, "left")
    for b in fields.values():
        out = out.withColumn(b, F.when(F.col("__hit"), F.col(f"__{b}")).otherwise(F.col(b)) if b in dst.columns else F.col(f"__{b}"))
    return out.drop("__hit", *[f"__{b}" for b in fields.values()])


def gather(dst: DataFrame, pointer: str, src: DataFrame, key: str, fields: dict[str, str], out_of_range: bool = False) -> DataFrame:
    """dst[i].field = src[pointer[i]].field.  Pointers that lead nowhere leave the field as it was if ``out_of_range``, and are an error else."""
    s = src.select(F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(a).alias(f"__{b}") for a, b in fields.items()])
    out = dst.join(s, F.col(pointer) == F.col("__key"), "left")
    for b in fields.values():
        missing = F.col(b) if b in dst.columns else F.lit(None)
        if not out_of_range:
            missing = F.raise_error(F.lit(f"a pointer in {pointer} leads nowhere"))
        out = out.withColumn(b, F.when(F.col("__hit"), F.col(f"__{b}")).otherwise(missing))
    return out.drop("__hit", "__key", *[f"__{b}" for b in fields.values()])


def scatter(dst: DataFrame, key: str, src: DataFrame, pointer: str, value: str, field: str, order: str) -> DataFrame:
    """dst[pointer[i]].field = src[i].value; of several writers of a point the one with the largest ``order`` stays."""
    last = src.groupBy(F.col(pointer).alias(key)).agg(F.max_by(value, order).alias("__v"))
    return copy(dst, last, [key], {"__v": field})


def reduction_copy(dst: DataFrame, src: DataFrame, keys: list[str], value: str, field: str, op: str, kind: str = "double") -> DataFrame:
    """dst.field op= the reduction of src.value at each point; aggregated before the join."""
    if op in ("diff", "div"):
        inner = "sum" if op == "diff" else "prod"
    else:
        inner = op
    part = src.groupBy(*keys).agg(reduce(inner, F.col(value), kind).alias("__r"))
    return dst.join(part, keys, "left").withColumn(field, combine(op, F.col(field), F.col("__r"), kind)).drop("__r")


def scatter_reduce(dst: DataFrame, key: str, src: DataFrame, pointer: str, value: str, field: str, op: str, kind: str = "double") -> DataFrame:
    return reduction_copy(dst, src.select(F.col(pointer).alias(key), value), [key], value, field, op, kind)


def gather_ranges(ranges: DataFrame, lo: str, hi: str, src: DataFrame, key: str) -> DataFrame:
    """Rows of ``src`` for every point of each range pointer."""
    at = ranges.withColumn(key, F.explode(F.when(F.col(hi) >= F.col(lo), F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))
    return at.join(src, key)


def gather_affine(dst: DataFrame, keys: list[str], matrix: list[list[int]], offset: list[int], src: DataFrame, src_keys: list[str], fields: dict[str, str]) -> DataFrame:
    """dst[i].field = src[matrix * i + offset].field: indirection without a pointer field; points that lead nowhere get null."""
    target = affine([F.col(k) for k in keys], matrix, offset)
    at = dst.select("*", *[c.alias(f"__k{k}") for k, c in enumerate(target)])
    s = src.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(src_keys)], *[F.col(a).alias(b) for a, b in fields.items()])
    return at.drop(*fields.values()).join(s, [f"__k{k}" for k in range(len(src_keys))], "left").drop(*[f"__k{k}" for k in range(len(src_keys))])


def transpose(region: DataFrame, a: str, b: str) -> DataFrame:
    return region.select([F.col(c).alias({a: b, b: a}.get(c, c)) for c in region.columns])


def union_of(spaces: list[DataFrame], keys: list[str]) -> DataFrame:
    return fold(DataFrame.unionByName, [x.select(keys) for x in spaces]).distinct()


def intersection_of(spaces: list[DataFrame], keys: list[str]) -> DataFrame:
    """The points that all spaces have: one count by point, however many spaces there are."""
    marked = [x.select(*keys, F.lit(k).alias("__k")).distinct() for k, x in enumerate(spaces)]
    return fold(DataFrame.unionByName, marked).groupBy(keys).agg(F.count("*").alias("__n")).where(F.col("__n") == len(spaces)).select(keys)


def subtraction_of(space: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    return space.select(keys).distinct().join(union_of(others, keys), keys, "left_anti")


def contains_any(space: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """One row: does a space hold some of the points (do two spaces overlap)."""
    return points.select(keys).join(space.select(keys), keys, "left_semi").agg((F.count("*") > 0).alias("contains_any"))


def contained(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: is every point of ``a`` in ``b``."""
    return a.select(keys).join(b.select(keys), keys, "left_anti").agg((F.count("*") == 0).alias("contained"))
