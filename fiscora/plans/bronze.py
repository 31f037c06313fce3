"""Raw layer: files as they come, plus where each row came from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from fiscora.operators.columns import sanitize_columns_basic
from fiscora.sources.csv import read_csv, read_csv_many
from fiscora.sources.layers import read_layer, write_layer


@dataclass(frozen=True)
class BronzePaths:
    filings: str
    rurality: str
    closures: str

    @staticmethod
    def under(root: str) -> BronzePaths:
        return BronzePaths(*(f"{root}/{t}" for t in ("filings", "rurality", "closures")))


def ingest(spark: SparkSession, filings: Sequence[str], rurality: str, closures: str,
           out: BronzePaths, fmt: str = "parquet",
           schemas: dict[str, StructType] | None = None,
           multiline: bool = True) -> dict[str, DataFrame]:
    """Load the three raw sources and return the written tables.

    Undeclared columns stay text; keys with leading zeros survive. Files without
    quoted line breaks can be read with ``multiline`` off, many tasks to a file.
    """
    schemas = schemas or {}
    raw = {
        out.filings: sanitize_columns_basic(read_csv_many(
            spark, filings, schemas.get("filings"), multiline, lineage="source_file")),
        out.rurality: sanitize_columns_basic(read_csv(
            spark, rurality, schemas.get("rurality"), encoding="ISO-8859-1")),
        out.closures: sanitize_columns_basic(read_csv(
            spark, closures, schemas.get("closures"))),
    }
    for path, table in raw.items():
        write_layer(table, path, fmt)
    return {"filings": read_layer(spark, out.filings, fmt),
            "rurality": read_layer(spark, out.rurality, fmt),
            "closures": read_layer(spark, out.closures, fmt)}
