"""Prefix scans, global numbering and stencils that no single task has to see whole.

A scan is cut into blocks along the order column, at its approximate quantiles: a window inside each block, and one number
for each block from the blocks before it.  Only the table of blocks (``blocks`` for each group) is scanned in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointset.functions.reductions import combine, reduce


def _blocked(df: DataFrame, order: str, blocks: int | None) -> DataFrame:
    """``df`` with the number of each row's block; as many blocks as shuffle partitions, a power of two.

    The cuts are found once, as numbers, so that every use of the plan has the same blocks.
    """
    want = blocks or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    depth = min(12, max(1, (want - 1).bit_length()))
    cuts = df.agg(F.percentile_approx(order, [k / (1 << depth) for k in range(1, 1 << depth)], 8 << depth)).first()[0]
    out = df.withColumn("__block", F.lit(0))
    if cuts:
        known = F.lit(cuts)
        for k in reversed(range(depth)):  # a binary search for the number of cuts below the value
            out = out.withColumn("__block", F.col("__block") + F.when(F.get(known, F.col("__block") + (1 << k) - 1) < F.col(order), 1 << k).otherwise(0))
    return out


def prefix_scan(df: DataFrame, by: list[str], order: str, value: str, op: str, out: str, forward: bool = True, blocks: int | None = None) -> DataFrame:
    """``df`` with the running sum, prod, min or max of ``value`` along ``order`` (backward: from the end) within ``by``.

    ``order`` is an integer column without ties inside a group.
    """
    if op not in ("sum", "prod", "min", "max"):
        raise ValueError(f"no scan for {op}")
    kind = "double" if op == "prod" or df.schema[value].dataType.simpleString() in ("double", "float") else "long"
    way = F.col(order).asc() if forward else F.col(order).desc()
    cut = _blocked(df, order, blocks)
    inner = Window.partitionBy(*by, "__block").orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    total = cut.groupBy(*by, "__block").agg(reduce(op, F.col(value), kind).alias("__total"))
    outer = Window.partitionBy(*by).orderBy(F.col("__block").asc() if forward else F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = total.select(*by, "__block", reduce(op, F.col("__total"), kind).over(outer).alias("__before"))
    local = cut.withColumn("__local", reduce(op, F.col(value), kind).over(inner))
    return local.join(before, [*by, "__block"]).withColumn(out, combine(op, F.col("__before"), F.col("__local"), kind)).drop("__block", "__local", "__before")


def numbered(df: DataFrame, order: str, out: str = "rank", first: int = 0, blocks: int | None = None) -> DataFrame:
    """``df`` with the rank of each row along ``order`` (an integer column without ties), over the whole table."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    return prefix_scan(one, [], order, "__one", "sum", out, True, blocks).withColumn(out, F.col(out) - 1 + first).drop("__one")


def stencil_1d(df: DataFrame, key: str, value: str, weights: dict[int, float], out: str, periodic: bool = False) -> DataFrame:
    """sum(weights[d] * value at key + d) for keys that are dense; beyond the ends there is nothing, or the other end."""
    lo, hi = F.broadcast(df.agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))), F.lit(0)
    to = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(float(w)).alias("w")) for d, w in weights.items()])
    sent = df.crossJoin(lo).withColumn("__s", F.explode(to)) if periodic else df.withColumn("__s", F.explode(to))
    at = F.col(key) - F.col("__s.d")
    if periodic:
        at = F.pmod(at - F.col("__lo"), F.col("__hi") - F.col("__lo") + 1) + F.col("__lo")
    got = sent.groupBy(at.alias(key)).agg(F.sum(F.col(value) * F.col("__s.w")).alias(out), (F.count("*") + hi).alias("__n"))
    return df.join(got, key, "left").drop("__n")


def stencil_nd(df: DataFrame, keys: list[str], value: str, offsets: list[tuple[tuple[int, ...], float]], out: str) -> DataFrame:
    """Neighbour sums on a grid: each point sends its weighted value to the points that read it; then one sum by point."""
    to = F.array(*[F.struct(*[F.lit(-d).alias(f"d{k}") for k, d in enumerate(o)], F.lit(float(w)).alias("w")) for o, w in offsets])
    sent = df.select(*keys, value, F.explode(to).alias("__s"))
    got = sent.groupBy(*[(F.col(c) + F.col(f"__s.d{k}")).alias(c) for k, c in enumerate(keys)]).agg(F.sum(F.col(value) * F.col("__s.w")).alias(out))
    return df.join(got, keys, "left")


def running(df: DataFrame, by: list[str], order: str, value: Column, out: str, change: str = "__v") -> DataFrame:
    """Running sum after all rows with the same order value are added up: one row for each group and order value, with what it adds in ``change``."""
    sums = df.groupBy(*by, order).agg(F.sum(value).alias(change))
    scanned = prefix_scan(sums, by, order, change, "sum", out)
    return scanned.drop(change) if change == "__v" else scanned
