"""Messages in, raw layer out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fiscora.sources.layers import read_layer
from fiscora.streaming.stream import (
    BATCH, MESSAGE, StreamConfig, as_text, batch_folder, bounded_run, parse_json, split_parsed,
    stream_source)


@dataclass(frozen=True)
class StreamPaths:
    bronze: str
    rejected: str
    counts: str
    checkpoint: str

    @staticmethod
    def under(root: str) -> StreamPaths:
        return StreamPaths(*(f"{root}/{p}" for p in ("bronze", "rejected", "counts", "checkpoint")))


def ingest(spark: SparkSession, cfg: StreamConfig, schema: StructType, out: StreamPaths,
           fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Drain the source into the raw layer; malformed messages go to their own table.

    One pass: every micro-batch is parsed once and written to folders named by
    its number, so a repeated one replaces its own output. Returns the raw layer
    and, for every micro-batch ever written, its number of valid and rejected
    messages.
    """
    def write(df: DataFrame, path: str, number: int) -> None:
        df.write.format(fmt).mode("overwrite").save(batch_folder(path, number))

    def store(batch: DataFrame, number: int) -> None:
        parsed = parse_json(batch, schema).persist()
        try:
            valid, rejected = split_parsed(parsed, schema)
            write(as_text(valid), out.bronze, number)
            write(rejected, out.rejected, number)
            write(parsed.agg(F.count_if(~F.col("_bad")).alias("valid"),
                             F.count_if("_bad").alias("rejected")), out.counts, number)
        finally:
            parsed.unpersist()

    # Empty tables first, so that a source without messages leaves readable ones.
    none = spark.createDataFrame([], MESSAGE)
    valid, rejected = split_parsed(parse_json(none, schema), schema)
    write(as_text(valid), out.bronze, -1)
    write(rejected, out.rejected, -1)
    write(spark.createDataFrame([], "valid long, rejected long"), out.counts, -1)
    bounded_run(stream_source(spark, cfg).writeStream.foreachBatch(store)
                .option("checkpointLocation", out.checkpoint))
    return (read_layer(spark, out.bronze, fmt).drop(BATCH), read_layer(spark, out.counts, fmt))
