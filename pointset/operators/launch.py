"""Launches: a function for each color of a partition, futures by color, and their reductions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce as fold

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointset.functions.reductions import reduce
from pointset.operators.partition import Partition
from pointset.operators.region import reduction_copy
from pointset.operators.scan import prefix_scan


def index_launch(partition: Partition, region: DataFrame, *results: Column) -> DataFrame:
    """A future map (color, results): aggregate expressions over each color's rows.  This is the way that scales: map-side partial sums, nothing gathered."""
    return partition.of(region).groupBy(*partition.color).agg(*results)


def index_task(partition: Partition, region: DataFrame, task: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A pandas function over all rows of a color, for what expressions cannot say; a color must fit a task."""
    return partition.of(region).groupBy(*partition.color).applyInPandas(task, schema)


def reduce_futures(futures: DataFrame, value: str, op: str, kind: str = "double", out: str = "value") -> DataFrame:
    """One row: the reduction of a future map."""
    return futures.agg(reduce(op, F.col(value), kind).alias(out))


def launch_reduce(partition: Partition, region: DataFrame, result: Column, op: str, kind: str = "double", out: str = "value") -> DataFrame:
    """An index launch whose results are reduced to one row."""
    return reduce_futures(index_launch(partition, region, result.alias("__result")), "__result", op, kind, out)


def reduce_by_task(df: DataFrame, by: list[str], partial: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], state: str) -> DataFrame:
    """A reduction that the user defines, in two steps, so that no group has to be in memory as a whole.

    partial: a batch of rows -> one state for each key in it (columns ``by`` and the state); merge: states of some keys -> one
    state for each of them.  ``state`` is the schema of the state columns.  States come to the merge in the order of their
    keys, a batch at a time; the last key of a batch is carried on to the next.
    """
    kinds = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by] + [state])

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield partial(batch)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if len(batch):
                own = merge(batch if held is None else pd.concat([held, batch]))
                last = fold(lambda a, b: a & b, [(own[c] == batch[c].iloc[-1]) | (own[c].isna() & pd.isna(batch[c].iloc[-1])) for c in by])
                held = own[last]
                yield own[~last]
        if held is not None:
            yield held

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.mapInPandas(begin, kinds).repartition(n, *by).sortWithinPartitions(*by).mapInPandas(finish, kinds)


def single_task(spark: SparkSession, task: Callable[[SparkSession], DataFrame], out: str = "value") -> DataFrame:
    """One task whose future is a one-row frame: what ``task`` returns, evaluated with the query."""
    found = task(spark)
    return found.select(F.col(found.columns[0]).alias(out)).limit(1)


def collective(arrivals: DataFrame, generation: str, value: str, op: str, expected: int, kind: str = "double") -> DataFrame:
    """A barrier with a reduction: for each generation that has all its ``expected`` arrivals their reduction: generation, value; later arrivals count for nothing new."""
    got = arrivals.groupBy(generation).agg(F.count("*").alias("__n"), reduce(op, F.col(value), kind).alias("value"))
    return got.where(F.col("__n") >= expected).drop("__n")


def task_reduction(dst: DataFrame, keys: list[str], launches: list[DataFrame], field: str, op: str, kind: str = "double") -> DataFrame:
    """A field that many launches reduce into: each gives (keys, value); all are added up before they meet the region."""
    given = launches[0]
    for more in launches[1:]:
        given = given.unionByName(more)
    return reduction_copy(dst, given, keys, "value", field, op, kind)


def pickled(column: Column) -> Column:
    """Any value as bytes."""

    @F.pandas_udf("binary")
    def dump(v: pd.Series) -> pd.Series:
        return v.map(lambda x: pickle.dumps(x, protocol=4))

    return dump(column)


def reduce_pickled(df: DataFrame, by: list[str], value: str, merge: Callable[[object, object], object], out: str = "value") -> DataFrame:
    """The reduction of pickled values by key; merge must be associative, and is called in no promised order."""

    def fold_all(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for key, own in rows.groupby(by, sort=False):
            total = None
            for raw in own[value]:
                x = pickle.loads(raw)  # noqa: S301 - values that this program pickled
                total = x if total is None else merge(total, x)
            found.append((*(key if isinstance(key, tuple) else (key,)), pickle.dumps(total, protocol=4)))
        return pd.DataFrame(found, columns=[*by, value])

    return reduce_by_task(df.select(*by, value), by, fold_all, fold_all, f"`{value}` binary").withColumnRenamed(value, out)


def ordered_concat(futures: DataFrame, value: str, color: str = "color", out: str = "value") -> DataFrame:
    """A reduction whose order counts: values joined by color.  The result is one string, and so is one task's work; colors must be few enough for that."""
    return futures.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(color, F.col(value).alias("v")))), lambda x: x["v"]), "").alias(out))


def all_reduce(df: DataFrame, value: str, op: str, out: str, kind: str = "double") -> DataFrame:
    """Every row gets the reduction over all rows."""
    return df.crossJoin(F.broadcast(df.agg(reduce(op, F.col(value), kind).alias(out))))  # one row


def with_arguments(partition: Partition, arguments: DataFrame) -> DataFrame:
    """Each color's points beside its argument."""
    return partition.df.join(arguments, partition.color)


def predicated(df: DataFrame, predicate: DataFrame, condition: str, field: str, value: Column) -> DataFrame:
    """field = value where the one-row frame ``predicate`` says so, else as it was."""
    return df.crossJoin(F.broadcast(predicate.select(F.col(condition).alias("__p")))).withColumn(field, F.when(F.col("__p"), value).otherwise(F.col(field))).drop("__p")  # one row


def predicate(op: str, *predicates: DataFrame) -> DataFrame:
    """and, or, not of one-row predicates (their first columns): one row, holds."""
    out = None
    for k, p in enumerate(predicates):
        one = p.select(F.col(p.columns[0]).alias(f"__p{k}"))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    values = [F.col(f"__p{k}") for k in range(len(predicates))]
    whole = ~values[0] if op == "not" else fold((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), values)
    return out.select(whole.alias("holds"))


def output_region(rows: DataFrame, color: str, order: str, out: str = "pt") -> DataFrame:
    """Rows of different numbers for each color, numbered through all colors: by color, then by ``order``."""
    counts = rows.groupBy(color).agg(F.count("*").alias("__n"))
    before = prefix_scan(counts, [], color, "__n", "sum", "__upto").select(color, (F.col("__upto") - F.col("__n")).alias("__before"))
    one = rows.withColumn("__one", F.lit(1).cast("long"))
    inner = prefix_scan(one, [color], order, "__one", "sum", "__at")
    return inner.join(before, color).withColumn(out, F.col("__before") + F.col("__at") - 1).drop("__one", "__at", "__before")
