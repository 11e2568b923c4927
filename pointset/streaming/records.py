"""Log records as a stream: utilization changes by time bucket, with a watermark for late records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def record_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 16) -> DataFrame:
    """Parquet record files as they arrive; ``files_at_once`` bounds a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def counts_by_window(records: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return records.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("records"), F.sum("value").alias("total"))
