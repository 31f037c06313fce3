"""Session construction and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "fiscora", fmt: str = "parquet", master: str | None = None,
            conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or fetch) a session whose default table format is ``fmt``.

    Everything sized by data stays with adaptive execution: partition
    coalescing, skewed-join splitting and run-time broadcast decisions.
    """
    running = SparkSession.getActiveSession() is not None
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.sources.default": fmt,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    if fmt == "delta":
        # Needs the Delta jar on the classpath; the format is otherwise only a name.
        settings["spark.sql.extensions"] = "io.delta.sql.DeltaSparkSessionExtension"
        settings["spark.sql.catalog.spark_catalog"] = (
            "org.apache.spark.sql.delta.catalog.DeltaCatalog")
    for key, value in {**settings, **(conf or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if not running:
        spark.sparkContext.setLogLevel("WARN")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and hand-over tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a folder of this machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="fiscora-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


#: Paths given out inside each open scope, the innermost scope last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    path = f"{shared_dir(spark)}/fiscora/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the hand-over tables written inside the block when it ends.

    Results are lazy and read those tables: write or collect them inside the block.
    """
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.pop()
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def hand_over(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage in a place that outlives lost executors, and unlike a
    checkpoint it keeps column pruning and filter pushdown for later readers.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(rdd: RDD) -> None:
    """Write the parts of ``rdd`` to the shared folder with its next job: lost ones are read from there."""
    shared_dir(SparkSession.getActiveSession())
    rdd.checkpoint()
    if _SCOPES:
        _SCOPES[-1].append(f"{rdd.context.getCheckpointDir().rstrip('/')}/rdd-{rdd.id()}")
