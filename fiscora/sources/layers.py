"""Layer tables on disk; the format is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_layer(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_layer(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                overwrite_schema: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Full refresh of a layer table.

    With ``partition_by`` rows are first rebalanced on those columns: few
    well-filled files per folder, and a huge folder is written by many tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(fmt).mode(mode)
    if overwrite_schema and fmt == "delta":
        writer = writer.option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def append_layer(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Add rows; what is there stays."""
    df.write.format(fmt).mode("append").save(path)
