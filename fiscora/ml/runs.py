"""Parameters and metrics of training runs as an append-only table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

RUNS = "run_id string, name string, key string, value string, kind string, logged_at bigint"


def log_run(spark: SparkSession, path: str, name: str, params: Mapping[str, object] | None = None,
            metrics: Mapping[str, float] | None = None, run_id: str | None = None) -> str:
    """Append rows for a run; pass ``run_id`` to add to an earlier one."""
    run_id = run_id or uuid.uuid4().hex
    now = time.time_ns()
    rows = [(run_id, name, k, str(v), kind, now)
            for kind, entries in (("param", params or {}), ("metric", metrics or {}))
            for k, v in entries.items()]
    spark.createDataFrame(rows, RUNS).coalesce(1).write.mode("append").parquet(path)
    return run_id


def log_metrics(metrics: DataFrame, path: str, name: str, run_id: str) -> None:
    """Append every column of a one-row table of metrics."""
    text = metrics.select(*[F.col(c).cast("string").alias(c) for c in metrics.columns])
    (text.unpivot([], metrics.columns, "key", "value")
     .select(F.lit(run_id).alias("run_id"), F.lit(name).alias("name"), "key", "value",
             F.lit("metric").alias("kind"), F.lit(time.time_ns()).alias("logged_at"))
     .write.mode("append").parquet(path))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(path)


def latest_run(runs: DataFrame) -> DataFrame:
    """Most recently started run per name."""
    started = runs.groupBy("name", "run_id").agg(F.min("logged_at").alias("started"))
    return started.groupBy("name").agg(F.max_by("run_id", "started").alias("run_id"))


def latest_values(runs: DataFrame) -> DataFrame:
    """Newest value of each key in the latest run of each name."""
    return (runs.join(latest_run(runs), ["name", "run_id"], "left_semi")
            .groupBy("name", "run_id", "kind", "key")
            .agg(F.max_by("value", "logged_at").alias("value")))
