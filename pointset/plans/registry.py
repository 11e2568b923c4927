"""The register of queries, and what their definitions share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointset.sources.tables import shared_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Where checkpoints go, if the session has no folder yet."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark).rsplit("/", 1)[0])


def micros(c: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


RECORDS = "records AS (SELECT event_id AS id, event_type AS kind, user_id % 8 AS proc, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + 1 + event_id * 7919 % 5000 AS stop FROM events) "


def records(spark: SparkSession, d: str) -> DataFrame:
    start = F.floor(micros("ts") / 1000000)
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), (F.col("user_id") % 8).alias("proc"), start.alias("start"), (start + 1 + F.col("event_id") * 7919 % 5000).alias("stop"))
