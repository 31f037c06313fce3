"""Queries on deduplication, prior values, order and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscora.functions import numeric
from fiscora.operators import windows
from fiscora.operators.ordered import lag_within
from workload.binding import AMOUNTS, HY, RAW, filings, with_, yearly_accounts
from workload.registry import query, r, table

_FILED = "lpad(provider_ccn, 6, '0') AS ccn_key, CAST(right(fiscal_year_end_date, 4) AS INTEGER) AS fiscal_year"
_FILLED = " + ".join(f"({c} IS NOT NULL)::INTEGER" for c in AMOUNTS)


def _filed(spark, sf_dir):
    return filings(spark, sf_dir).select(
        F.lpad("provider_ccn", 6, "0").alias("ccn_key"),
        F.right("fiscal_year_end_date", F.lit(4)).cast("int").alias("fiscal_year"),
        "filing_id", *AMOUNTS)


@query("w1_dedup_best", with_(RAW, f"""
SELECT ccn_key, fiscal_year, filing_id, completeness FROM (
  SELECT *, row_number() OVER (PARTITION BY ccn_key, fiscal_year
                               ORDER BY completeness DESC, filing_id DESC) AS nth
  FROM (SELECT {_FILED}, filing_id, CAST({_FILLED} AS INTEGER) AS completeness FROM filings))
WHERE nth = 1"""))
def dedup_best(spark, sf_dir):
    best = windows.dedup_best(_filed(spark, sf_dir), ["ccn_key", "fiscal_year"], AMOUNTS,
                              ["filing_id"])
    return best.select("ccn_key", "fiscal_year", "filing_id",
                       numeric.completeness(AMOUNTS).alias("completeness"))


@query("w2_lag_within", """
SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prior_value
FROM events""")
def lag_one(spark, sf_dir):
    return lag_within(table(spark, sf_dir, "events"), "user_id", "ts", "value", "prior_value",
                      tie_breaks=["event_id"]).select("event_id", "user_id", "value", "prior_value")


@query("w2_lag_within_3", """
SELECT event_id, event_type, lag(event_id, 3) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS third_prior
FROM events""")
def lag_three(spark, sf_dir):
    """Few keys, each with very many rows."""
    return lag_within(table(spark, sf_dir, "events"), "event_type", "ts", "event_id",
                      "third_prior", n=3, tie_breaks=["event_id"]).select(
        "event_id", "event_type", "third_prior")


@query("w3_yoy_change", with_(HY, """
SELECT ccn_key, fiscal_year, round(CASE WHEN fiscal_year - prior_year = 1 AND prior > 0
                                        THEN (total_costs - prior) / prior END, 6) AS cost_change
FROM (SELECT *, lag(total_costs) OVER w AS prior, lag(fiscal_year) OVER w AS prior_year
      FROM hy WINDOW w AS (PARTITION BY ccn_key ORDER BY fiscal_year))"""))
def yoy_change(spark, sf_dir):
    """Only against the directly preceding year."""
    changed = windows.yoy_change(yearly_accounts(spark, sf_dir), "ccn_key", "fiscal_year",
                                 "total_costs", "cost_change", require_gap=1)
    return changed.select("ccn_key", "fiscal_year", r("cost_change").alias("cost_change"))


@query("w4_top_1", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1""")
def top_1(spark, sf_dir):
    return windows.top_1(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderkey"]).select(
        "o_orderkey", "o_totalprice")


@query("w5_sort_by", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def sort_by(spark, sf_dir):
    return windows.sort_by(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"),
                           [F.desc("s_acctbal"), "s_suppkey"])


@query("w6_sample_head", """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10""")
def sample_head(spark, sf_dir):
    return windows.sample_head(
        table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), 10,
        [F.desc("p_retailprice"), "p_partkey"])


@query("w7_verify_unique", """
SELECT CAST(sum(n) AS BIGINT) AS "rows", CAST(count(*) AS BIGINT) AS distinct_keys,
       CAST(sum(n - 1) AS BIGINT) AS surplus_rows,
       CAST(sum((n > 1)::INTEGER) AS BIGINT) AS repeated_keys
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def verify_unique(spark, sf_dir):
    return windows.verify_unique(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("w8_union_files", """
SELECT c_custkey AS "key", c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def union_files(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"),
        F.col("s_name").alias("name"))
    return windows.union_all([customers, suppliers])


@query("w9_union_synthetic", """
SELECT l_orderkey, l_quantity, 0 AS generated FROM lineitem
UNION ALL SELECT l_orderkey, l_quantity / 2, 1 FROM lineitem WHERE l_returnflag = 'R'""")
def union_synthetic(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    real = lines.select("l_orderkey", "l_quantity", F.lit(0).alias("generated"))
    made = lines.filter("l_returnflag = 'R'").select(
        F.lit(1).alias("generated"), (F.col("l_quantity") / 2).alias("l_quantity"), "l_orderkey")
    return windows.union_synthetic(real, made)
