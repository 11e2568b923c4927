"""Regions from and to files: Parquet tables with a field map, arrays, fixed-width binary files, partitioned attaches, log records, text sinks."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointset.operators.scan import numbered


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one only on a local master where none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pointset-"))
        found = sc.getCheckpointDir()
    return f"{found}/region-{uuid.uuid4().hex}"


def attach_table(spark: SparkSession, path: str, fields: dict[str, str] | None = None) -> DataFrame:
    """A Parquet table as a region; fields: column of the file -> field of the region (only those are read)."""
    df = spark.read.parquet(path)
    return df.select([F.col(a).alias(b) for a, b in fields.items()]) if fields else df


def attach_array(spark: SparkSession, arrays: dict[str, np.ndarray], order: str = "C") -> DataFrame:
    """Arrays of one shape in the driver's memory as a region p0, p1, ...; ``order``: which index runs fastest in memory (C: the last)."""
    shape = next(iter(arrays.values())).shape
    index = np.unravel_index(np.arange(int(np.prod(shape))), shape, order=order)
    return spark.createDataFrame(pd.DataFrame({f"p{k}": x for k, x in enumerate(index)} | {f: a.ravel(order=order) for f, a in arrays.items()}))


def attach_struct_array(spark: SparkSession, records: np.ndarray) -> DataFrame:
    """An array of structures as a region p0, p1, ... with a field for each member."""
    return attach_array(spark, {f: records[f] for f in records.dtype.names})


def attach_records(spark: SparkSession, paths: str | list[str], dtype: np.dtype, schema: str, rows: int = 1 << 14) -> DataFrame:
    """Fixed-width binary records as a region keyed by ``file`` and ``record``.

    Spark's own input format cuts a file into byte ranges of whole records, so no task sees a whole file; a file's length must be a multiple of the record's.
    """
    dtype = np.dtype(dtype)
    kinds = f"file string, record long, {schema}"
    length = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(dtype.itemsize)}
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        found = spark.sparkContext.newAPIHadoopFile(path, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=length)
        raw = spark.createDataFrame(found.map(lambda r: (r[0], bytes(r[1]))), "record long, raw binary")

        def decode(batches, path=path):
            for batch in batches:
                x = np.frombuffer(b"".join(batch["raw"]), dtype)
                yield pd.DataFrame({"file": path, "record": batch["record"].to_numpy()} | {f: x[f] for f in dtype.names})

        one = raw.mapInPandas(decode, kinds)
        out = one if out is None else out.unionByName(one)
    return out


def attach_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """One resource for each color: a table that was written by color."""
    return spark.read.parquet(path)


def attach_each(spark: SparkSession, resources: dict) -> DataFrame:
    """One Parquet table for each color, wherever it lies: color -> path."""
    out = None
    for color, path in resources.items():
        one = spark.read.parquet(path).withColumn("color", F.lit(color))
        out = one if out is None else out.unionByName(one)
    return out


def detach(region: DataFrame, path: str, color: str | None = None) -> None:
    """Writes a region back, by color if wanted."""
    (region.write.partitionBy(color) if color else region.write).parquet(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Log records of one kind, JSON lines (gz too)."""
    return spark.read.schema(schema).json(path)


def write_records(df: DataFrame, path: str) -> None:
    """Log records of one kind as gzipped JSON lines."""
    df.write.option("compression", "gzip").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def printed(template: str, *columns: Column) -> Column:
    return F.format_string(template, *columns)


def edges_from_offsets(offsets: DataFrame, targets: DataFrame) -> DataFrame:
    """CSR to an edge list.  offsets: src, first (place of its first edge); targets: place, dst.

    A node's edges end where the next node's begin, whatever ids lie between them; the last node's end with the table.
    """
    ranked = numbered(offsets.select("src", "first"), "src", "__rank")
    following = ranked.select((F.col("__rank") - 1).alias("__rank"), F.col("first").alias("__next"))
    last = F.broadcast(targets.agg((F.max("place") + 1).alias("__all")))  # one row
    full = ranked.join(following, "__rank", "left").crossJoin(last)
    stop = F.coalesce("__next", "__all")
    place = full.where(stop > F.col("first")).select("src", F.explode(F.sequence("first", stop - 1)).alias("place"))
    return place.join(targets, "place").select("src", "dst")
