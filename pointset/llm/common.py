"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside the operators, so that ids fit a 64-bit integer array.
NO_ID = -(1 << 63)


def id_key(name: str) -> Column:
    """The id as a non-null long; null ids share ``NO_ID`` and sort first."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID).cast("long"))


def id_back(name: str) -> Column:
    return F.when(F.col(name) != F.lit(NO_ID), F.col(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes: texts are long, and a batch lies whole in a Python worker.  Shuffle files go with the query that wrote them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one only on a local master where none is set, as in tests."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pointset-"))
        found = sc.getCheckpointDir()
    return found


class Scratch:
    """Tables of one operator in the shared folder; those that are written in its ``with`` block go at its end.

    A table ends the lineage, and lost executors lose nothing.  What an operator returns is written outside of the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str, *observed: Column) -> DataFrame | tuple[DataFrame, dict]:
        """``df`` as a Parquet table; with ``observed`` aggregates also their values over its rows."""
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        seen = Observation() if observed else None
        (df.observe(seen, *observed) if observed else df).write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        return (table, seen.get) if observed else table

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder that stays."""
    return Scratch(df.sparkSession).written(df, name)


def own_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_key, text, row): rows of one id with unlike texts, and rows without id, get keys of their own above all others; equal rows share one.

    What is kept or cut is then decided for each text.  Where ids are unique, which one aggregation finds out, they are the keys.
    """
    digest = F.xxhash64(F.col("text"))
    rows = docs.select(id_key(id_col).alias("doc_key"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ids = rows.select("doc_key", digest.alias("digest")).groupBy("doc_key").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    odd = (F.col("least") != F.col("most")) | (F.col("doc_key") == NO_ID)
    top, some = ids.agg(F.max("doc_key"), F.coalesce(F.bool_or(odd), F.lit(False))).first()
    if not some:
        return rows
    if top > 1 << 61:
        raise ValueError("ids that repeat need free numbers above the largest id")
    pairs = rows.select("doc_key", digest.alias("digest")).join(ids.where(odd).select("doc_key"), "doc_key", "left_semi").distinct()
    named = written(pairs.withColumn("own", F.monotonically_increasing_id() + max(top, 0) + 1), "own-keys")
    return rows.withColumn("digest", digest).join(named, ["doc_key", "digest"], "left").select(F.coalesce("own", "doc_key").alias("doc_key"), "text", "row")


_MADE: dict[str, tuple] = {}


def once_a_worker(shared: Broadcast, make: Callable):
    """What a Python worker makes of a broadcast value; of each function the last one is remembered, with the value it was made of."""
    key, value = make.__qualname__, shared.value
    if key not in _MADE or _MADE[key][0] is not value:
        _MADE[key] = value, make(value)
    return _MADE[key][1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column in one array, and the offsets of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n at least; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[base] = (np.cumprod(up), np.cumprod(down))
    return have


class Prefix:
    """Polynomial fingerprints of any byte ranges of one array, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = powers(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal buckets together, and where each of the n buckets begins."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))
