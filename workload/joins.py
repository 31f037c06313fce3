"""Queries on lookups and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscora.functions import text
from fiscora.operators import aggregates, columns, joins, ordered
from fiscora.plans import silver
from fiscora.session import hand_over
from workload.binding import (
    HY, LABELLED, RAW, closures, county_sql, event_sql, filings, name_sql, prefix_sql, rurality,
    with_, yearly_accounts)
from workload.registry import query, r, table


@query("j1_lookup_left", with_(RAW, f"""
SELECT filing_id, f.state_code, f.county, r.rucc_2013, r.fips
FROM filings f LEFT JOIN rurality r
  ON f.state_code = r.state AND {county_sql('f.county')} = {county_sql('r.county_name')}"""))
def lookup_left(spark, sf_dir):
    return silver.with_rurality(filings(spark, sf_dir), rurality(spark, sf_dir)).select(
        "filing_id", "state_code", "county", "rucc_2013", "fips")


def _keyed(spark, sf_dir):
    filed = silver.with_match_keys(filings(spark, sf_dir), "hospital_name", "state_code")
    filed = filed.select(
        "filing_id", "name_key", "name_prefix_key", "state_key",
        text.fiscal_year("fiscal_year_end_date").alias("fiscal_year"))
    events = silver.with_match_keys(closures(spark, sf_dir), "hospital_name", "state").withColumn(
        "closure_year", F.col("closure_year").try_cast("int"))
    return filed, events


_KEYED_SQL = LABELLED + f""",
keyed AS (
  SELECT filing_id, CAST(year(try_strptime(fiscal_year_end_date, '%m/%d/%Y')) AS INTEGER) AS fiscal_year,
         {name_sql('hospital_name')} AS name_key, upper(trim(state_code)) AS state_key,
         {prefix_sql('hospital_name')} AS name_prefix_key
  FROM filings)"""
_BY_NAME = event_sql("e.name_key = k.name_key AND e.state_key = k.state_key", "k.fiscal_year")
_BY_PREFIX = event_sql(
    "e.name_prefix_key = k.name_prefix_key AND e.state_key = k.state_key", "k.fiscal_year")


@query("j2_match_exact", with_(_KEYED_SQL, f"""
SELECT filing_id, name_key, CAST({_BY_NAME} AS INTEGER) AS closure_year FROM keyed k"""))
def match_exact(spark, sf_dir):
    filed, events = _keyed(spark, sf_dir)
    return joins.match_exact(filed, events, ["name_key", "state_key"], "closure_year",
                             "closure_year", "fiscal_year").select(
        "filing_id", "name_key", "closure_year")


@query("j3_match_prefix", with_(_KEYED_SQL, f"""
SELECT filing_id, name_prefix_key, CAST({_BY_PREFIX} AS INTEGER) AS closure_year FROM keyed k"""))
def match_prefix(spark, sf_dir):
    filed, events = _keyed(spark, sf_dir)
    return joins.match_prefix(filed, events, "name_prefix_key", "state_key", "closure_year",
                              "closure_year", "fiscal_year").select(
        "filing_id", "name_prefix_key", "closure_year")


@query("j4_match_two_pass", with_(_KEYED_SQL, f"""
SELECT filing_id, CAST(coalesce({_BY_NAME}, {_BY_PREFIX}) AS INTEGER) AS closure_year
FROM keyed k"""))
def match_two_pass(spark, sf_dir):
    filed, events = _keyed(spark, sf_dir)
    return joins.match_two_pass(filed, events, "name_key", "name_prefix_key", "state_key",
                                "closure_year", "closure_year", "fiscal_year").select(
        "filing_id", "closure_year")


@query("j5_attach_keys", with_(HY + """,
t AS (SELECT fiscal_year, row_number() OVER (ORDER BY fiscal_year) AS time_id
      FROM (SELECT DISTINCT fiscal_year FROM hy)),
h AS (SELECT ccn_key, row_number() OVER (ORDER BY ccn_key) AS hospital_id
      FROM (SELECT DISTINCT ccn_key FROM hy)),
p AS (SELECT ccn_key, fiscal_year, row_number() OVER (ORDER BY ccn_key, fiscal_year) AS payer_id FROM hy)""", """
SELECT ccn_key, fiscal_year, time_id, hospital_id, payer_id
FROM hy LEFT JOIN t USING (fiscal_year) LEFT JOIN h USING (ccn_key)
LEFT JOIN p USING (ccn_key, fiscal_year)"""))
def attach_keys(spark, sf_dir):
    """A row's own number needs no join: it is given once, to the written accounts."""
    accounts = hand_over(ordered.surrogate_key(
        yearly_accounts(spark, sf_dir).select("ccn_key", "fiscal_year"),
        ["ccn_key", "fiscal_year"], "payer_id"), "accounts")
    dims = [(ordered.surrogate_key(aggregates.distinct_rows(accounts, keys), keys, key_id),
             keys, key_id)
            for keys, key_id in ((["fiscal_year"], "time_id"), (["ccn_key"], "hospital_id"))]
    return joins.attach_keys(accounts, dims)


@query("j6_attach_dim", """
SELECT s_suppkey, s_nationkey AS n_nationkey, n_name, n_regionkey
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""")
def attach_dim(spark, sf_dir):
    facts = table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return joins.attach_dim(facts, table(spark, sf_dir, "nation"), "n_nationkey",
                            ["n_name", "n_regionkey"])


@query("j7_flag_membership", """
SELECT c_custkey, CAST(EXISTS (
  SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey
    AND floor(s_acctbal / 100) = floor(c_acctbal / 100)) AS INTEGER) AS listed
FROM customer""")
def flag_membership(spark, sf_dir):
    group = lambda prefix: F.floor(F.col(f"{prefix}_acctbal") / 100)
    left = table(spark, sf_dir, "customer").withColumn("c_group", group("c"))
    right = table(spark, sf_dir, "supplier").withColumn("s_group", group("s"))
    return joins.flag_membership(
        left, right, [("c_nationkey", "s_nationkey"), ("c_group", "s_group")], "listed"
    ).select("c_custkey", "listed")


@query("j8_match_rate", with_(RAW, f"""
SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(*) - count(rucc_2013) AS BIGINT) AS unmatched,
       round(avg((rucc_2013 IS NULL)::INTEGER), 6) AS unmatched_share
FROM filings f LEFT JOIN rurality r
  ON f.state_code = r.state AND {county_sql('f.county')} = {county_sql('r.county_name')}"""))
def match_rate(spark, sf_dir):
    located = silver.with_rurality(filings(spark, sf_dir), rurality(spark, sf_dir))
    return joins.match_rate(located, "rucc_2013").withColumn(
        "unmatched_share", r("unmatched_share"))


@query("j9_broadcast_params", """
SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 6) AS scaled
FROM lineitem CROSS JOIN (
  SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem WHERE year(l_shipdate) <= 1998)""")
def broadcast_params(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    fitted = lines.filter(F.year("l_shipdate") <= 1998).agg(
        F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    return columns.with_params(lines, fitted, lambda p: {
        "scaled": r((F.col("l_quantity") - p["lo"]) / (p["hi"] - p["lo"]))}).select(
        "l_orderkey", "l_linenumber", "scaled")
