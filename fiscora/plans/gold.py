"""Star schema: one fact row per filing year, four dimensions, ten ratios."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscora.functions import numeric, text
from fiscora.operators import aggregates, joins, ordered, windows
from fiscora.sources.layers import read_layer, write_layer

KEY = ("ccn_key", "fiscal_year")
SCORED = tuple(c for c in numeric.FINANCIAL_COLUMNS if c != "number_of_beds")


@dataclass(frozen=True)
class GoldPaths:
    fact: str
    dim_hospital: str
    dim_geography: str
    dim_time: str
    dim_payer: str
    filings: str

    @staticmethod
    def under(root: str) -> GoldPaths:
        return GoldPaths(f"{root}/fact", *(f"{root}/dims/{d}" for d in (
            "dim_hospital", "dim_geography", "dim_time", "dim_payer")), f"{root}/filings")


def dedup(silver: DataFrame, tie_breaks: Sequence[str | Column] | None = None) -> DataFrame:
    """One filing per key: most complete, then labelled, then a fixed total order.

    A ``completeness`` column scored before imputation takes precedence.
    """
    rest = [c for c in silver.columns if c not in (*KEY, "distress_label", "completeness")]
    ties = ["distress_label", *(tie_breaks if tie_breaks is not None else rest)]
    if "completeness" in silver.columns:
        return windows.dedup_best(silver, KEY, SCORED, ["completeness", *ties]).drop("completeness")
    return windows.dedup_best(silver, KEY, SCORED, ties)


def dim_time(filings: DataFrame) -> DataFrame:
    years = aggregates.distinct_rows(filings, ["fiscal_year"])
    return ordered.surrogate_key(years, ["fiscal_year"], "time_id").select(
        "fiscal_year", "time_id", text.fy_label("fiscal_year").alias("fy_label"))


def dim_geography(filings: DataFrame) -> DataFrame:
    keys = ["fips", "state_code", "rucc_2013"]
    places = aggregates.distinct_rows(filings, keys)
    return ordered.surrogate_key(places, keys, "geo_id").withColumn(
        "rural_level", numeric.rural_level("rucc_2013"))


def dim_hospital(filings: DataFrame) -> DataFrame:
    beds = aggregates.avg_by(filings, ["ccn_key"], "number_of_beds", "avg_beds")
    return ordered.surrogate_key(beds, ["ccn_key"], "hospital_id").withColumn(
        "bed_size_category", numeric.bed_size("avg_beds"))


def numbered(filings: DataFrame) -> DataFrame:
    """Filings with the ``payer_id`` that dimension and fact share: a filing has one payer row."""
    return ordered.surrogate_key(filings, KEY, "payer_id")


def dim_payer(filings: DataFrame) -> DataFrame:
    """From filings that have their ``payer_id``."""
    ratios = numeric.ratio_columns()
    return filings.select("payer_id", *KEY, *[ratios[c].alias(c) for c in numeric.PAYER_RATIOS])


def features(filings: DataFrame, require_gap: int | None = None) -> DataFrame:
    """All ten ratios next to the filing columns."""
    rated = filings.withColumns(dict(numeric.ratio_columns()))
    return windows.yoy_change(rated, "ccn_key", "fiscal_year", "net_patient_revenue",
                              "revenue_yoy_change", require_gap)


def build(spark: SparkSession, silver: DataFrame, out: GoldPaths, fmt: str = "parquet",
          require_gap: int | None = None) -> dict[str, DataFrame]:
    """Write and return dimensions and fact.

    Deduplicated filings and dimensions are written first and read back, so
    every consumer sees the same ids and reads only its own columns. Filings carry
    their payer id, so the fact is joined with small dimensions only.
    """
    write_layer(numbered(dedup(silver)), out.filings, fmt)
    filings = read_layer(spark, out.filings, fmt)
    tables = {}
    for name, make in (("dim_time", dim_time), ("dim_geography", dim_geography),
                       ("dim_hospital", dim_hospital), ("dim_payer", dim_payer)):
        path = getattr(out, name)
        write_layer(make(filings), path, fmt)
        tables[name] = read_layer(spark, path, fmt)
    keyed = joins.attach_keys(features(filings, require_gap), [
        (tables["dim_time"], ["fiscal_year"], "time_id"),
        (tables["dim_geography"], ["fips", "state_code", "rucc_2013"], "geo_id"),
        (tables["dim_hospital"], ["ccn_key"], "hospital_id"),
    ])
    fact = keyed.select("hospital_id", "time_id", "geo_id", "payer_id", *KEY,
                        *numeric.FEATURE_COLUMNS, "distress_label")
    # The temporal split later reads whole years.
    write_layer(fact, out.fact, fmt, overwrite_schema=True, partition_by=["fiscal_year"])
    tables["fact"] = read_layer(spark, out.fact, fmt).select(*fact.columns)
    return tables


def verify(tables: dict[str, DataFrame]) -> DataFrame:
    """Long report (section, item, value) on the written star schema.

    Schema items are "column type" with the place as value, feature items "column measure".
    """
    fact = tables["fact"]

    def section(name: str, frame: DataFrame, item: Column, value: Column) -> DataFrame:
        return frame.select(F.lit(name).alias("section"), item.cast("string").alias("item"),
                            value.cast("double").alias("value"))

    parts = [section("rows", table.agg(F.count("*").alias("n")), F.lit(name), F.col("n"))
             for name, table in sorted(tables.items())]
    ids = ["hospital_id", "time_id", "geo_id", "payer_id"]
    parts += [
        section("null_keys", aggregates.null_counts(fact, ids), F.col("column_name"), F.col("nulls")),
        section("labels", aggregates.count_by(fact, ["distress_label"], order=False),
                F.col("distress_label"), F.col("count")),
        section("label_rate", aggregates.rate(fact, "distress_label"), F.lit("rate"), F.col("rate")),
        section("years", aggregates.count_by(fact, ["fiscal_year"], order=False),
                F.col("fiscal_year"), F.col("count")),
        section("schema", fact.sparkSession.createDataFrame(
            [(f"{c} {t}", i) for i, (c, t) in enumerate(fact.dtypes, 1)], "item string, at int"),
            F.col("item"), F.col("at")),
    ]
    summary = aggregates.describe(fact, numeric.FEATURE_COLUMNS).unpivot(
        ["column_name"], [F.col(c).cast("double").alias(c) for c in ("count", "mean", "stddev", "min", "max")],
        "measure", "value")
    parts.append(section("features", summary, F.concat_ws(" ", "column_name", "measure"),
                         F.col("value")))
    return windows.union_all(parts)
