"""Queries on projections, renames and row predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscora.operators import columns
from workload.binding import HY, with_, yearly_accounts
from workload.registry import query, r, table


def _raw_headers(spark, sf_dir):
    """Customers under raw report headers."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Provider CCN"), F.col("c_name").alias("Hospital (Legal) Name"),
        F.col("c_acctbal").alias("FTE - Cash, on\tHand"), F.col("c_mktsegment").alias(" County "))


@query("p1_sanitize_columns_basic", """
SELECT c_custkey AS "Provider_CCN", c_name AS "Hospital_Legal_Name",
       c_acctbal AS "FTE_-_Cash_on_Hand", c_mktsegment AS "County" FROM customer""")
def sanitize_basic(spark, sf_dir):
    return columns.sanitize_columns_basic(_raw_headers(spark, sf_dir))


@query("p2_sanitize_columns_snake", """
SELECT c_custkey AS provider_ccn, c_name AS hospital_legal_name,
       c_acctbal AS fte_cash_on_hand, c_mktsegment AS county FROM customer""")
def sanitize_snake(spark, sf_dir):
    return columns.sanitize_columns_snake(_raw_headers(spark, sf_dir))


@query("p3_rename", "SELECT n_nationkey AS state_id, n_name AS state, n_regionkey FROM nation")
def rename(spark, sf_dir):
    return columns.rename(table(spark, sf_dir, "nation"),
                          {"n_nationkey": "state_id", "n_name": "state"})


@query("p4_project", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def project(spark, sf_dir):
    return columns.project(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_extendedprice"])


@query("p5_drop_helpers", "SELECT p_partkey, p_name, p_brand, p_type FROM part")
def drop_helpers(spark, sf_dir):
    helped = table(spark, sf_dir, "part").withColumn("_rank", F.col("p_size") * 2)
    return columns.drop_helpers(helped, "_rank", "p_size", "p_retailprice")


@query("p6_require_columns", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def require(spark, sf_dir):
    return columns.require_columns(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_acctbal"])


@query("p7_filter_at_least", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END >= 250000""")
def at_least(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn(
        "known", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return columns.filter_at_least(orders, "known", 250000).select("o_orderkey", "o_totalprice")


@query("p8_filter_positive_or_null", with_(HY, """
SELECT ccn_key, fiscal_year, round(net_income, 4) AS net_income,
       round(medicaid_charges, 4) AS medicaid_charges
FROM hy WHERE (net_income > 0 OR net_income IS NULL)
          AND (medicaid_charges > 0 OR medicaid_charges IS NULL)"""))
def positive_or_null(spark, sf_dir):
    kept = columns.filter_positive_or_null(
        yearly_accounts(spark, sf_dir), ["net_income", "medicaid_charges"])
    return kept.select("ccn_key", "fiscal_year", r("net_income", 4).alias("net_income"),
                       r("medicaid_charges", 4).alias("medicaid_charges"))


@query("p9_filter_sql", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity < 10""")
def by_sql(spark, sf_dir):
    return columns.filter_sql(
        table(spark, sf_dir, "lineitem"), "l_returnflag = 'R' AND l_quantity < 10"
    ).select("l_orderkey", "l_linenumber", "l_quantity")


@query("p10_filter_years", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year FROM orders
WHERE year(o_orderdate) <= 2000 AND year(o_orderdate) IN (1996, 1999, 2000, 2001)""")
def years(spark, sf_dir):
    dated = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("fiscal_year"))
    return columns.filter_isin(
        columns.filter_year_range(dated, "fiscal_year", last=2000), "fiscal_year",
        [1996, 1999, 2000, 2001])


@query("p11_cast_all", """
SELECT l_orderkey, l_linenumber,
       TRY_CAST(CASE WHEN l_returnflag = 'N' THEN 'n/a' ELSE CAST(l_quantity AS VARCHAR) END AS DOUBLE) AS l_quantity,
       TRY_CAST(CASE WHEN l_linestatus = 'F' THEN '' ELSE CAST(l_discount AS VARCHAR) END AS DOUBLE) AS l_discount
FROM lineitem""")
def cast_all(spark, sf_dir):
    texts = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "N", "n/a").otherwise(
            F.col("l_quantity").cast("string")).alias("l_quantity"),
        F.when(F.col("l_linestatus") == "F", "").otherwise(
            F.col("l_discount").cast("string")).alias("l_discount"))
    return columns.cast_all(texts, ["l_quantity", "l_discount"], "double")


@query("p12_coalesce_priority", """
SELECT l_orderkey, l_linenumber,
       coalesce(CASE WHEN l_returnflag = 'A' THEN l_tax END,
                CASE WHEN l_linestatus = 'F' THEN l_discount END) AS picked
FROM lineitem""")
def coalesce_priority(spark, sf_dir):
    given = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "A", F.col("l_tax")).alias("a"),
        F.when(F.col("l_linestatus") == "F", F.col("l_discount")).alias("b"))
    return columns.coalesce_priority(given, ["a", "b"], "picked").drop("a", "b")


@query("p13_inf_to_null", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_tax > 0 THEN round(l_extendedprice / l_tax, 4) END AS price_per_tax
FROM lineitem""")
def inf_to_null(spark, sf_dir):
    endless = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_tax") == 0, float("-inf")).otherwise(
            r(F.col("l_extendedprice") / F.col("l_tax"), 4)).alias("price_per_tax"))
    return columns.inf_to_null(endless, ["price_per_tax"])
