"""Queries on message streams; all read the events table as JSON messages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType, LongType, StringType, StructField, StructType, TimestampType)

from fiscora.session import scratch_path
from fiscora.sources.messages import publish, to_keyed_json
from fiscora.streaming import stream
from workload.registry import query, table

SCHEMA = StructType([
    StructField("event_id", LongType()), StructField("ts", TimestampType()),
    StructField("user_id", LongType()),
    StructField("event_type", StringType()), StructField("value", DoubleType()),
    StructField("props", StringType())])
COLUMNS = [f.name for f in SCHEMA.fields]


def _messages(spark, sf_dir):
    """Events as messages; those of type error are cut off and so malformed."""
    keyed = to_keyed_json(table(spark, sf_dir, "events").select(*COLUMNS), "user_id",
                          keep=["event_id", "event_type"])
    broken = F.when(F.col("event_type") == "error", F.left("value", F.lit(9)))
    return keyed.withColumn("value", F.coalesce(broken, "value"))


def _topic(spark, sf_dir, name):
    path = scratch_path(spark, name)
    publish(_messages(spark, sf_dir), "files", path, order=["event_id"])
    return path


def _source(spark, path, files=1):
    return stream.stream_source(spark, stream.StreamConfig(location=path, files=files))


def _drain(spark, rows, name):
    """Run a stream to its end into files and read them."""
    path = scratch_path(spark, name)
    stream.bounded_run(rows.writeStream.format("parquet").option("path", path)
                       .option("checkpointLocation", scratch_path(spark, f"{name}-progress")))
    return spark.read.schema(rows.schema).parquet(path)


@query("k1_stream_source", """
SELECT CAST(user_id AS VARCHAR) AS "key", CAST(count(*) AS BIGINT) AS messages FROM events GROUP BY 1""")
def stream_source(spark, sf_dir):
    read = _drain(spark, _source(spark, _topic(spark, sf_dir, "k1")), "k1-out")
    return read.groupBy("key").agg(F.count("*").alias("messages"))


@query("k2_decode_json", """
SELECT event_id, user_id, event_type, value, json_extract_string(props, '$.k') AS k, 'valid' AS outcome
FROM events WHERE event_type <> 'error'
UNION ALL SELECT NULL, user_id, NULL, NULL, NULL, 'rejected' FROM events WHERE event_type = 'error'""")
def decode_json(spark, sf_dir):
    path = _topic(spark, sf_dir, "k2")
    valid, rejected = stream.decode_json(_source(spark, path, files=100), SCHEMA)
    good = _drain(spark, valid, "k2-valid").select(
        "event_id", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").alias("k"), F.lit("valid").alias("outcome"))
    bad = _drain(spark, rejected, "k2-rejected").select(
        F.col("key").cast("bigint").alias("user_id"), F.lit("rejected").alias("outcome"))
    return good.unionByName(bad, allowMissingColumns=True)


@query("k3_bounded_run", "SELECT CAST(count(*) AS BIGINT) AS messages FROM events")
def bounded_run(spark, sf_dir):
    """Everything present is processed, then the stream ends by itself."""
    read = _drain(spark, _source(spark, _topic(spark, sf_dir, "k3"), files=100), "k3-out")
    return read.agg(F.count("*").alias("messages"))


@query("k4_micro_batch", """
SELECT 5 AS batches, CAST(count(*) AS BIGINT) AS messages FROM events""")
def micro_batch(spark, sf_dir):
    """Five files with one file per micro-batch."""
    path = scratch_path(spark, "k4")
    _messages(spark, sf_dir).select("key", "value").repartition(5).write.json(path)
    out = scratch_path(spark, "k4-out")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(
            f"{out}/part={number}")

    stream.bounded_run(_source(spark, path).writeStream.foreachBatch(keep).option(
        "checkpointLocation", scratch_path(spark, "k4-progress")))
    return spark.read.parquet(out).agg(
        F.count_distinct("batch").cast("int").alias("batches"), F.count("*").alias("messages"))


@query("k5_append_bronze_stream", """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, props,
       round(value, 6) AS value, epoch_us(ts) AS ts
FROM events WHERE event_type <> 'error'""")
def append_bronze(spark, sf_dir):
    valid, _ = stream.decode_json(_source(spark, _topic(spark, sf_dir, "k5")), SCHEMA)
    out = scratch_path(spark, "k5-out")
    stream.append_bronze_stream(valid, out, scratch_path(spark, "k5-progress"))
    return spark.read.parquet(out).withColumns({
        "value": F.round(F.col("value").cast("double"), 6),
        "ts": F.unix_micros(F.col("ts").cast("timestamp"))})


@query("k6_resume", """
SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(1 AS BIGINT) AS times FROM events
WHERE event_type <> 'error'""")
def resume(spark, sf_dir):
    """A second start with the same checkpoint reads only what arrived since."""
    path, out, progress = (scratch_path(spark, f"k6-{p}") for p in ("in", "out", "progress"))
    arrivals = _messages(spark, sf_dir)
    small = F.coalesce(F.get_json_object("value", "$.value").cast("double") < 10, F.lit(False))
    for part in (small, ~small):
        publish(arrivals.filter(part), "files", path, order=["event_id"])
        valid, _ = stream.decode_json(_source(spark, path, files=100), SCHEMA)
        stream.append_bronze_stream(valid, out, progress)
    return spark.read.parquet(out).groupBy("event_id").agg(F.count("*").alias("times"))


@query("k7_stream_counts", """
SELECT event_type, CAST(count(*) AS BIGINT) AS records FROM events
WHERE event_type <> 'error' GROUP BY 1""")
def stream_counts(spark, sf_dir):
    valid, _ = stream.decode_json(_source(spark, _topic(spark, sf_dir, "k7"), files=2), SCHEMA)
    out = scratch_path(spark, "k7-out")
    stream.stream_counts(valid, ["event_type"], out, scratch_path(spark, "k7-progress"))
    return stream.latest_counts(spark, out, ["event_type"])
