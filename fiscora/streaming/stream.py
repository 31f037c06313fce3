"""Ingestion of JSON messages as a structured stream."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from fiscora.operators.columns import sanitize_columns_basic
from fiscora.operators.windows import union_all

MESSAGE = StructType([StructField("key", StringType()), StructField("value", StringType())])
CORRUPT = "_corrupt_record"
BATCH = "micro_batch"
COMPACT_EVERY = 50          # micro-batches that are folded into a snapshot


@dataclass(frozen=True)
class StreamConfig:
    """Where messages come from and how many enter one micro-batch.

    ``files`` caps the files of a micro-batch of the files source, ``messages``
    the messages of one of the kafka source.
    """
    source: str = "files"
    location: str = ""
    files: int = 100
    messages: int = 1_000_000
    options: dict[str, str] = field(default_factory=dict)


def stream_source(spark: SparkSession, cfg: StreamConfig) -> DataFrame:
    """Stream of (key, value) texts from the earliest message on."""
    if cfg.source == "kafka":
        raw = (spark.readStream.format("kafka").option("subscribe", cfg.location)
               .option("startingOffsets", "earliest")
               .option("maxOffsetsPerTrigger", cfg.messages).options(**cfg.options).load())
        return raw.select(F.col("key").cast("string"), F.col("value").cast("string"))
    return (spark.readStream.format("json").schema(MESSAGE)
            .option("maxFilesPerTrigger", cfg.files).options(**cfg.options).load(cfg.location))


def decode_json(messages: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Split messages into (valid rows, rejected messages).

    Absent fields are NULL, extra fields are ignored, text that is no such
    object is rejected with its key.
    """
    return split_parsed(parse_json(messages, schema), schema)


def parse_json(messages: DataFrame, schema: StructType) -> DataFrame:
    """Add the parsed object as ``_row`` and whether the message is malformed as ``_bad``."""
    target = StructType(schema.fields + [StructField(CORRUPT, StringType())])
    parsed = messages.withColumn("_row", F.from_json(
        "value", target, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
                          "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]"}))
    return parsed.withColumn("_bad", F.col("_row").isNull() | F.col(f"_row.{CORRUPT}").isNotNull())


def split_parsed(parsed: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    valid = parsed.filter(~F.col("_bad")).select(*[F.col(f"_row.`{f.name}`").alias(f.name)
                                                   for f in schema.fields])
    return valid, parsed.filter("_bad").select("key", "value")


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text under a layer-safe name; missing stays NULL."""
    safe = sanitize_columns_basic(df)
    return safe.select(*[F.col(c).cast("string").alias(c) for c in safe.columns])


def bounded_run(writer: DataStreamWriter) -> StreamingQuery:
    """Process everything that is there in micro-batches, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_bronze_stream(rows: DataFrame, path: str, checkpoint: str,
                         fmt: str = "parquet") -> StreamingQuery:
    """Append decoded rows to the raw layer, exactly once across restarts.

    Progress lives in ``checkpoint`` (outside ``path``); starting again with
    the same folder continues after the last finished micro-batch.
    """
    if checkpoint.rstrip("/").startswith(path.rstrip("/") + "/"):
        raise ValueError("the checkpoint folder must be outside the output folder")
    return bounded_run(as_text(rows).writeStream.format(fmt).outputMode("append")
                       .option("path", path).option("checkpointLocation", checkpoint))


def batch_folder(path: str, number: int) -> str:
    """Where a micro-batch's rows live: writing it again replaces them."""
    return f"{path}/{BATCH}={number}"


def _numbers(spark: SparkSession, path: str, complete: bool = False) -> list[int]:
    """Numbers of the micro-batch folders right under ``path``, ascending; ``complete`` ones only."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    names = [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()]
    found = sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{BATCH}="))
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [n for n in found if not complete or files.exists(done(f"{batch_folder(path, n)}/_SUCCESS"))]


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _snapshots(path: str) -> str:
    """Beside the batches, under a name that readers of ``path`` skip."""
    return f"{path}/_snapshots"


def _after(spark: SparkSession, path: str, keys: Sequence[str], base: int | None,
           until: int | None = None) -> DataFrame:
    """Newest count of every key in snapshot ``base`` and the batches after it, up to ``until``."""
    last = [n for n in _numbers(spark, path)
            if (base is None or n > base) and (until is None or n <= until)]
    parts = [spark.read.parquet(batch_folder(path, n)).withColumn(BATCH, F.lit(n)) for n in last]
    if base is not None:
        parts.append(spark.read.parquet(batch_folder(_snapshots(path), base)).withColumn(BATCH, F.lit(base)))
    return union_all(parts).groupBy(*keys).agg(F.max_by("records", BATCH).alias("records"))


def compact_counts(spark: SparkSession, path: str, keys: Sequence[str], number: int) -> None:
    """Fold everything up to micro-batch ``number`` into one snapshot that is named by it.

    A snapshot counts once it is whole, and only what the one before it covers is removed
    then. So a reader that has begun keeps its files until the next compaction, and a
    crash at any point, or doing the same batch again, loses and doubles nothing.
    """
    place = _snapshots(path)
    before = [n for n in _numbers(spark, place, complete=True) if n < number]
    base = before[-1] if before else None
    _after(spark, path, keys, base, number).write.mode("overwrite").parquet(batch_folder(place, number))
    if base is None:
        return
    for old in before[:-1]:
        _remove(spark, batch_folder(place, old))
    for old in _numbers(spark, path):
        if old <= base:
            _remove(spark, batch_folder(path, old))


def stream_counts(rows: DataFrame, keys: Sequence[str], path: str, checkpoint: str,
                  compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Running count per key; each micro-batch adds the keys it changed.

    Read with ``latest_counts``. Every ``compact_every`` batches are folded into a
    snapshot, so a read opens a bounded number of folders however long the stream runs.
    """
    def add(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(path, number))
        if (number + 1) % compact_every == 0:
            compact_counts(batch.sparkSession, path, keys, number)

    return bounded_run(rows.groupBy(*keys).agg(F.count("*").alias("records"))
                       .writeStream.outputMode("update").foreachBatch(add)
                       .option("checkpointLocation", checkpoint))


def latest_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest count of every key written by ``stream_counts``."""
    whole = _numbers(spark, _snapshots(path), complete=True)
    return _after(spark, path, keys, whole[-1] if whole else None)
