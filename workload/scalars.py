"""Queries on column expressions and the ten ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscora.functions import numeric, text
from fiscora.operators import aggregates, columns
from fiscora.plans.gold import features
from workload.binding import (
    HY, RATIO_SQL, RAW, county_sql, filings, label_sql, name_sql, prefix_sql,
    rurality, with_,
    yearly_accounts)
from workload.registry import query, r, table


@query("f1_normalize_county", with_(RAW, f"""
SELECT fips, {county_sql('county_name')} AS county FROM rurality"""))
def normalize_county(spark, sf_dir):
    return rurality(spark, sf_dir).select(
        "fips", text.normalize_county("county_name").alias("county"))


@query("f2_normalize_county_simple", with_(RAW, """
SELECT filing_id, trim(replace(upper(county), ' COUNTY', '')) AS county FROM filings"""))
def normalize_county_simple(spark, sf_dir):
    return filings(spark, sf_dir).select(
        "filing_id", text.normalize_county_simple("county").alias("county"))


@query("f3_normalize_name", with_(RAW, f"""
SELECT filing_id, {name_sql('hospital_name')} AS name_key FROM filings"""))
def normalize_name(spark, sf_dir):
    return filings(spark, sf_dir).select(
        "filing_id", text.normalize_name("hospital_name").alias("name_key"))


# Spark's upper() spells out the sharp s, DuckDB's does not.
_PROSE = "replace(text, 'ß', 'ss')"


@query("f4_prefix_key", f"""
SELECT doc_id, {prefix_sql(_PROSE)} AS prefix,
       array_to_string(string_split(trim(regexp_replace(regexp_replace(
         upper(trim({_PROSE})), '[^A-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')), ' ')[1:4], ' ') AS collapsed
FROM documents""")
def prefix_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.prefix_key("text").alias("prefix"),
        text.prefix_key("text", collapse_blanks=True).alias("collapsed"))


@query("f5_upper_trim", "SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS name FROM part")
def upper_trim(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.upper_trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("name"))


@query("f6_fiscal_year", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS INTEGER) END AS fiscal_year
FROM orders""")
def fiscal_year(spark, sf_dir):
    """Orders of one status carry a text that is no date."""
    date = F.when(F.col("o_orderstatus") == "P", "31/31/1999").otherwise(
        F.date_format("o_orderdate", "MM/dd/yyyy"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.fiscal_year(date).alias("fiscal_year"))


@query("f7_zero_pad", """
SELECT o_orderkey, CASE WHEN o_orderkey >= 1000 THEN CAST(o_orderkey AS VARCHAR)
                        ELSE lpad(CAST(o_orderkey AS VARCHAR), 4, '0') END AS padded FROM orders""")
def zero_pad(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.zero_pad("o_orderkey", 4).alias("padded"))


@query("f8_fy_label", """
SELECT o_orderkey, 'FY' || CAST(year(o_orderdate) AS VARCHAR) AS fy_label FROM orders""")
def fy_label(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.fy_label(F.year("o_orderdate")).alias("fy_label"))


_EVENT = "CASE WHEN c_acctbal < 0 THEN 1995 + c_custkey % 7 END"


@query("f9_horizon_label", f"""
SELECT o_orderkey, {label_sql(f'({_EVENT})', 'year(o_orderdate)')} AS distress_label
FROM orders JOIN customer ON o_custkey = c_custkey""")
def horizon_label(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    event = F.when(F.col("c_acctbal") < 0, 1995 + F.col("c_custkey") % 7)
    return joined.select("o_orderkey", numeric.horizon_label(
        event, F.year("o_orderdate")).alias("distress_label"))


@query("f10_band", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN code <= 3 THEN 'Metro' WHEN code <= 5 THEN 'Micropolitan' WHEN code <= 7 THEN 'Small Town'
       WHEN code IS NOT NULL THEN 'Remote Rural' END AS rural_level,
  CASE WHEN beds < 25 THEN 'Critical Access' WHEN beds < 100 THEN 'Small Rural'
       WHEN beds < 250 THEN 'Medium Rural' ELSE 'Large Rural' END AS bed_size
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_suppkey % 9 + 1 END AS code,
             CASE WHEN l_returnflag <> 'A' THEN l_quantity * 6 END AS beds FROM lineitem)""")
def band(spark, sf_dir):
    code = F.when(F.col("l_returnflag") != "N", F.col("l_suppkey") % 9 + 1)
    beds = F.when(F.col("l_returnflag") != "A", F.col("l_quantity") * 6)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", numeric.rural_level(code).alias("rural_level"),
        numeric.bed_size(beds).alias("bed_size"))


@query("f11_safe_ratio", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_discount > 0 THEN round(l_tax / l_discount, 6) END AS ratio FROM lineitem""")
def safe_ratio(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", r(numeric.safe_ratio("l_tax", "l_discount")).alias("ratio"))


@query("f12_completeness", with_(HY, """
SELECT ccn_key, fiscal_year, CAST((medicaid_charges IS NOT NULL)::INTEGER
  + (total_current_assets IS NOT NULL)::INTEGER + (total_days_title_xix IS NOT NULL)::INTEGER
  AS INTEGER) AS completeness FROM hy"""))
def completeness(spark, sf_dir):
    return yearly_accounts(spark, sf_dir).select("ccn_key", "fiscal_year", numeric.completeness(
        ["medicaid_charges", "total_current_assets", "total_days_title_xix"]).alias("completeness"))


@query("f13_risk_tier", """
SELECT event_id, CASE WHEN value / 50 >= 0.6 THEN 'HIGH' WHEN value / 50 >= 0.35 THEN 'ELEVATED'
                      WHEN value IS NOT NULL THEN 'LOW' END AS risk_tier FROM events""")
def risk_tier(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", numeric.risk_tier(F.col("value") / 50).alias("risk_tier"))


@query("f14_round_score", """
SELECT event_id, round(value / 37, 4) AS score FROM events""")
def round_score(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", numeric.round_score(F.col("value") / 37).alias("score"))


@query("f15_apply_threshold", """
SELECT event_id, CAST(value / 50 >= 0.4 AS INTEGER) AS pred FROM events""")
def apply_threshold(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", numeric.apply_threshold(F.col("value") / 50).alias("pred"))


_CURRENT = "CASE WHEN l_returnflag <> 'N' THEN l_quantity END"


def _gappy_quantity(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("quantity"))


@query("f16_cap_upper", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN q > 40 THEN 40 ELSE q END AS capped
FROM (SELECT l_orderkey, l_linenumber, {_CURRENT} AS q FROM lineitem)""")
def cap_upper(spark, sf_dir):
    return _gappy_quantity(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", numeric.cap_upper("quantity", F.lit(40.0)).alias("capped"))


@query("f17_fill_with", f"""
SELECT l_orderkey, l_linenumber, round(coalesce({_CURRENT}, (SELECT avg({_CURRENT}) FROM lineitem)), 6) AS filled
FROM lineitem""")
def fill_with(spark, sf_dir):
    rows = _gappy_quantity(spark, sf_dir)
    fitted = rows.agg(F.avg("quantity").alias("q"))
    return columns.with_params(rows, fitted, lambda p: {
        "filled": r(numeric.fill_with("quantity", p["q"]))}).drop("quantity")


@query("f18_standardize", """
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS quantity_z,
       round(0.0::DOUBLE, 6) AS constant_z
FROM lineitem CROSS JOIN (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)""")
def standardize(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("constant", F.lit(3.0))
    fitted = aggregates.fit_standardize(rows, ["l_quantity", "constant"])
    return columns.with_params(rows, fitted, lambda p: {
        "quantity_z": r(numeric.standardize("l_quantity", p["l_quantity__mean"], p["l_quantity__std"])),
        "constant_z": r(numeric.standardize("constant", p["constant__mean"], p["constant__std"])),
    }).select("l_orderkey", "l_linenumber", "quantity_z", "constant_z")


def _ratio_query(name: str):
    def run(spark, sf_dir):
        return features(yearly_accounts(spark, sf_dir)).select(
            "ccn_key", "fiscal_year", r(name).alias(name))
    run.__doc__ = f"{name} of every customer-year."
    return run


for _i, _name in enumerate(numeric.FEATURE_COLUMNS, start=1):
    query(f"x{_i}_{_name}", with_(HY, f"""
SELECT ccn_key, fiscal_year, round({RATIO_SQL[_name]}, 6) AS {_name} FROM hy"""))(_ratio_query(_name))
