"""Queries on reading and writing files, layers and messages."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType, LongType, StringType, StructField, StructType)

from fiscora.session import scratch_path, session
from fiscora.sources import csv, layers, messages
from workload.registry import query, table

SPLIT_YEAR = 1998


@query("s1_read_csv_many", f"""
SELECT o_orderkey, o_totalprice,
       CASE WHEN year(o_orderdate) <= {SPLIT_YEAR} THEN o_orderstatus || chr(10) || o_orderpriority END AS note,
       CASE WHEN year(o_orderdate) > {SPLIT_YEAR} THEN o_custkey END AS o_custkey
FROM orders""")
def read_csv_many(spark, sf_dir):
    """Two sets of files whose headers differ in order and columns; a field holds a newline."""
    orders = table(spark, sf_dir, "orders")
    early, late = (scratch_path(spark, f"filings-{part}") for part in ("early", "late"))
    note = F.concat_ws("\n", "o_orderstatus", "o_orderpriority").alias("note")
    (orders.filter(F.year("o_orderdate") <= SPLIT_YEAR).select("o_orderkey", note, "o_totalprice")
     .write.option("header", True).csv(early))
    (orders.filter(F.year("o_orderdate") > SPLIT_YEAR)
     .select("o_totalprice", "o_custkey", "o_orderkey").write.option("header", True).csv(late))
    schema = StructType([
        StructField("o_orderkey", LongType()), StructField("o_totalprice", DoubleType()),
        StructField("note", StringType()), StructField("o_custkey", LongType())])
    return csv.read_csv_many(spark, [early, late], schema)


@query("s2_read_csv", """
SELECT 'Señor ' || c_name AS c_name, c_custkey, c_acctbal FROM customer""")
def read_csv(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    (table(spark, sf_dir, "customer")
     .select(F.concat(F.lit("Señor "), "c_name").alias("c_name"), "c_custkey", "c_acctbal")
     .write.option("header", True).option("encoding", "ISO-8859-1").csv(path))
    schema = StructType([StructField("c_name", StringType()), StructField("c_custkey", LongType()),
                         StructField("c_acctbal", DoubleType())])
    return csv.read_csv(spark, path, schema, encoding="ISO-8859-1")


@query("s3_with_lineage", """
SELECT 'early' AS source, CAST(count(*) AS BIGINT) AS filings FROM orders
WHERE year(o_orderdate) <= 1998
UNION ALL SELECT 'late', CAST(count(*) AS BIGINT) FROM orders WHERE year(o_orderdate) > 1998""")
def with_lineage(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    root = scratch_path(spark, "lineage")
    paths = []
    for part, keep in (("early", F.year("o_orderdate") <= SPLIT_YEAR),
                       ("late", F.year("o_orderdate") > SPLIT_YEAR)):
        paths.append(f"{root}/{part}")
        orders.filter(keep).write.option("header", True).csv(paths[-1])
    read = csv.with_lineage(csv.read_csv(spark, paths))
    folder = F.element_at(F.split("source_file", "/"), -2)
    return read.groupBy(folder.alias("source")).agg(F.count("*").alias("filings"))


@query("s4_read_layer", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_layer(spark, sf_dir):
    return layers.read_layer(spark, f"{sf_dir}/nation.parquet", "parquet")


@query("s5_write_layer", """
SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year FROM orders""")
def write_layer(spark, sf_dir):
    """A full refresh replaces earlier content; the new content is partitioned by year."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("fiscal_year"))
    path = scratch_path(spark, "layer")
    layers.write_layer(orders.select("o_orderkey"), path)
    layers.write_layer(orders, path, overwrite_schema=True, partition_by=["fiscal_year"])
    return layers.read_layer(spark, path)


@query("s6_append_layer", """
SELECT r_regionkey AS id, r_name AS name FROM region
UNION ALL SELECT n_nationkey, n_name FROM nation""")
def append_layer(spark, sf_dir):
    path = scratch_path(spark, "appended")
    for name, key in (("region", "r_regionkey"), ("nation", "n_nationkey")):
        df = table(spark, sf_dir, name)
        layers.append_layer(df.select(F.col(key).alias("id"), F.col(f"{name[0]}_name").alias("name")),
                            path)
    return layers.read_layer(spark, path)


@query("s7_session", "SELECT CAST(count(*) AS BIGINT) AS suppliers FROM supplier")
def session_read(spark, sf_dir):
    """The settings of the session at hand are put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in (
        "spark.app.name", "spark.sql.sources.default", "spark.sql.session.timeZone",
        "spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled",
        "spark.sql.adaptive.skewJoin.enabled")}
    found = session("fiscora-check").read.load(f"{sf_dir}/supplier.parquet").agg(
        F.count("*").alias("suppliers"))
    for key, value in before.items():
        if value is not None:
            spark.conf.set(key, value)
    return found


def _with_gaps(spark, sf_dir):
    """Orders where some keys are missing and some amounts are not a number."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("o_custkey"),
        F.when(F.col("o_orderpriority") == "5-LOW", float("nan"))
        .otherwise(F.col("o_totalprice")).alias("o_totalprice"))


_GAPS_SQL = """
SELECT CASE WHEN o_custkey = 7 THEN 'unknown' ELSE CAST(o_custkey AS VARCHAR) END AS "key",
       o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS o_totalprice,
       o_orderpriority = '5-LOW' AS explicit_null
FROM orders"""


def _parsed(messages_df):
    field = lambda name, dtype: F.get_json_object("value", f"$.{name}").cast(dtype).alias(name)
    return messages_df.select("key", field("o_orderkey", "bigint"), field("o_totalprice", "double"),
                              F.contains(F.col("value"), F.lit('"o_totalprice":null'))
                              .alias("explicit_null"))


@query("s8_to_keyed_json", _GAPS_SQL)
def to_keyed_json(spark, sf_dir):
    return _parsed(messages.to_keyed_json(_with_gaps(spark, sf_dir), "o_custkey"))


@query("s9_publish", _GAPS_SQL)
def publish(spark, sf_dir):
    path = scratch_path(spark, "topic")
    keyed = messages.to_keyed_json(_with_gaps(spark, sf_dir), "o_custkey", keep=["o_orderkey"])
    messages.publish(keyed, "files", path, order=["o_orderkey"])
    return _parsed(spark.read.schema("key string, value string").json(path))
