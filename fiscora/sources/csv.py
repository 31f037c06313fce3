"""CSV sources with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from fiscora.operators.windows import union_all
from fiscora.sources.records import BYTE_ENCODINGS, read_records


def with_lineage(df: DataFrame, out: str = "source_file") -> DataFrame:
    """Add the path of the file each row was read from (right after the read)."""
    return df.withColumn(out, F.col("_metadata.file_path"))


def _reader(spark: SparkSession, multiline: bool, encoding: str):
    return (spark.read.option("header", True).option("multiLine", multiline)
            .option("encoding", encoding))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | None = None,
             encoding: str = "UTF-8", multiline: bool = False, infer: bool = False) -> DataFrame:
    """One CSV with a header. Without ``schema`` all columns are text unless ``infer``.

    A header that differs from ``schema`` raises: columns are never taken by place.
    """
    reader = _reader(spark, multiline, encoding)
    if schema is None:
        return reader.option("inferSchema", infer).csv(path)
    return reader.option("enforceSchema", False).schema(schema).csv(path)


def _headers(spark: SparkSession, paths: Sequence[str], multiline: bool,
             encoding: str) -> dict[tuple[str, ...], list[str]]:
    """Files by header, also those inside folders; looks at the first record of each file only."""
    groups: dict[tuple[str, ...], list[str]] = {}
    # Without its content column this source only lists.
    files = [r.path for r in spark.read.format("binaryFile").load(list(paths)).select("path")
             .distinct().orderBy("path").collect()]
    for path in files:
        header = tuple(_reader(spark, multiline, encoding).csv(path).columns)
        groups.setdefault(header, []).append(path)
    return groups


def _ddl(columns: Sequence[str], types: dict[str, DataType]) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` {types.get(c, StringType()).simpleString()}" for c in columns)


def _from_records(spark: SparkSession, paths: Sequence[str], types: dict[str, DataType], encoding: str,
                  lineage: str | None) -> DataFrame | None:
    """Files whose records span lines: every column that some header has, from one scan."""
    records, heads = read_records(spark, paths)
    if not heads:
        return None
    kinds = sorted(set(heads.values()))
    names = [_reader(spark, True, encoding).csv(spark.sparkContext.parallelize([h.decode(encoding, "replace")], 1))
             .columns for h in kinds]
    kind = F.lit(0)
    if len(kinds) > 1:
        # One row per file.
        of = spark.createDataFrame([(p, kinds.index(h)) for p, h in heads.items()], "path string, _kind int")
        records, kind = records.join(of, "path"), F.col("_kind")
    text = F.col("value").cast("string") if encoding == "UTF-8" else F.decode("value", encoding)
    records = records.withColumn("_text", text)
    records = records.withColumn("_text", F.when(F.col("_text").endswith("\r"), F.expr(
        "left(_text, char_length(_text) - 1)")).otherwise(F.col("_text")))
    parsed = records.select("path", *[
        F.when(kind == i, F.from_csv("_text", _ddl(c, types), {"multiLine": "true"})).alias(f"_{i}")
        for i, c in enumerate(names)])
    columns = list(dict.fromkeys(c for header in names for c in header))
    out = [F.coalesce(*[F.col(f"_{i}")[c] for i, header in enumerate(names) if c in header]).alias(c)
           for c in columns]
    return parsed.select(*out, *([F.col("path").alias(lineage)] if lineage else []))


def read_csv_many(spark: SparkSession, paths: Sequence[str], schema: StructType | None = None,
                  multiline: bool = True, encoding: str = "UTF-8",
                  lineage: str | None = None) -> DataFrame:
    """Many CSVs as one table, matched by header name rather than by place.

    ``schema`` gives names and types of the result in the raw spelling; columns
    a file lacks are NULL. With ``multiline`` records may span lines, and a
    large file is still read by many tasks if its encoding is UTF-8 or
    ISO-8859-1; in others a file is read by one. Without, files that share a
    header are one scan.
    """
    types = {f.name: f.dataType for f in schema.fields} if schema else {}
    split = BYTE_ENCODINGS.get(encoding.lower()) if multiline else None
    table = _from_records(spark, paths, types, split, lineage) if split else None
    if table is None:
        parts = []
        for header, files in _headers(spark, paths, multiline, encoding).items():
            declared = StructType([StructField(c, types.get(c, StringType())) for c in header])
            part = read_csv(spark, files, declared, encoding, multiline)
            parts.append(with_lineage(part, lineage) if lineage else part)
        table = union_all(parts)
    if schema is None:
        return table
    absent = {f.name: F.lit(None).cast(f.dataType)
              for f in schema.fields if f.name not in table.columns}
    if absent:
        table = table.withColumns(absent)
    return table.select(*[f"`{f.name}`" for f in schema.fields], *([lineage] if lineage else []))
