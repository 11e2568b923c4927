"""Queries on sources, sinks and streams: what is written is read back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pointset.plans.registry import query, table
from pointset.sources import tables as T
from pointset.streaming import records as ST


@query("s4_attach_array", "SELECT a AS p0, b AS p1, (a * 40 + b)::BIGINT AS x, (a * 40 + b) / 2.0::DOUBLE AS y FROM range(30) t(a), range(40) u(b)")
def s4(spark, d):
    x = np.arange(1200, dtype=np.int64).reshape(30, 40)
    return T.attach_array(spark, {"x": x, "y": x / 2.0})


@query("s4_fortran_order", "SELECT a AS p0, b AS p1, (a + b * 30)::BIGINT AS x FROM range(30) t(a), range(40) u(b)")
def s4_fortran(spark, d):
    return T.attach_array(spark, {"x": np.asfortranarray(np.arange(1200, dtype=np.int64).reshape((30, 40), order="F"))}, order="F")


@query("s4_structs", "SELECT a AS p0, a * 3 AS id, a / 4.0::DOUBLE AS weight FROM range(500) t(a)")
def s4_structs(spark, d):
    r = np.zeros(500, [("id", "i8"), ("weight", "f8")])
    r["id"], r["weight"] = np.arange(500) * 3, np.arange(500) / 4
    return T.attach_struct_array(spark, r)


def _bytes_to(spark, path: str, raw: bytes) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(raw))
    out.close()


@query("s5_attach_file", "SELECT a AS record, (a * a) % 97 AS k, a / 8.0::DOUBLE AS v FROM range(5000) t(a)")
def s5(spark, d):
    r = np.zeros(5000, [("k", "<i8"), ("v", "<f8")])
    r["k"], r["v"] = np.arange(5000) ** 2 % 97, np.arange(5000) / 8
    path = T.shared_folder(spark)
    _bytes_to(spark, path, r.tobytes())
    return T.attach_records(spark, path, r.dtype, "k long, v double").drop("file")


@query("s7_attach_by_color", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer")
def s7(spark, d):
    path = T.shared_folder(spark)
    T.detach(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), path, "c_nationkey")
    return T.attach_partitioned(spark, path)


@query("s7_attach_each", "SELECT 'c' AS color, c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def s7_each(spark, d):
    paths = {}
    for color, name in (("c", "customer"), ("s", "supplier")):
        paths[color] = T.shared_folder(spark)
        T.detach(table(spark, d, name).select(F.col("c_custkey" if color == "c" else "s_suppkey").alias("k"), F.col(f"{color}_acctbal").alias("v")), paths[color])
    return T.attach_each(spark, paths)


@query("s8_write_back", "SELECT s_suppkey, s_acctbal * 2 AS s_acctbal FROM supplier")
def s8(spark, d):
    path = T.shared_folder(spark)
    T.detach(table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") * 2).alias("s_acctbal")), path)
    return T.attach_table(spark, path)


@query("s14_log_records", "SELECT event_id, user_id, event_type, value FROM events")
def s14(spark, d):
    path = T.shared_folder(spark)
    T.write_records(table(spark, d, "events").select("event_id", "user_id", "event_type", "value"), path)
    return T.read_records(spark, path, "event_id long, user_id long, event_type string, value double")


@query("s15_record_sinks", "SELECT event_type AS kind, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
def s15(spark, d):
    path = T.shared_folder(spark)
    T.detach(table(spark, d, "events").select("event_id", F.col("event_type").alias("kind")), path, "kind")
    return T.attach_partitioned(spark, path).groupBy("kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("s16_gauges_csv", "SELECT user_id, count(*) AS samples, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def s16(spark, d):
    path = T.shared_folder(spark)
    T.write_csv(table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("samples"), F.round(F.avg("value"), 6).alias("mean")), path)
    return T.read_csv(spark, path, "user_id long, samples long, mean double")


@query("t5_record_stream", """WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type AS kind, ts, value FROM events)
SELECT epoch(hour)::BIGINT AS hour, kind, count(*) AS records, round(sum(value), 4) AS total FROM e WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE GROUP BY ALL""")
def t5(spark, d):
    """All files of a folder as a stream, until there are no more; windows that the watermark has closed are in the table that it writes."""
    folder, out = T.shared_folder(spark), T.shared_folder(spark)
    table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value").write.parquet(folder)
    stream = ST.counts_by_window(ST.record_stream(spark, folder, "ts timestamp, kind string, value double"), "ts", "kind")
    flat = stream.select(F.unix_seconds("w.start").alias("hour"), "kind", "records", F.round("total", 4).alias("total"))
    query_ = flat.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(flat.schema).parquet(f"{out}/rows")
