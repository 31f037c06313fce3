"""Queries on counts, rates, fitted statistics and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscora.operators import aggregates, ordered
from workload.binding import HY, RATED, rated_accounts, with_, yearly_accounts
from workload.registry import query, rounded, table

GAPPY = ("medicaid_charges", "total_days_title_xviii", "total_days_title_xix",
         "total_current_assets", "total_current_liabilities", "total_bad_debt_expense")


@query("a1_count_by", """
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2""")
def count_by(spark, sf_dir):
    return aggregates.count_by(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("a2_rate", with_(RATED, """
SELECT fiscal_year, CAST(count(*) AS BIGINT) AS "rows",
       CAST(sum(distress_label) AS BIGINT) AS positives, round(avg(distress_label), 6) AS rate
FROM rated GROUP BY 1"""))
def rate(spark, sf_dir):
    return rounded(aggregates.rate(
        rated_accounts(spark, sf_dir), "distress_label", ["fiscal_year"]), ["rate"])


@query("a3_null_counts", with_(HY, "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM hy"
    for c in GAPPY)))
def null_counts(spark, sf_dir):
    return aggregates.null_counts(yearly_accounts(spark, sf_dir), GAPPY)


@query("a3_null_rates", with_(HY, "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::INTEGER), 6) AS null_rate FROM hy"
    for c in GAPPY)))
def null_rates(spark, sf_dir):
    return rounded(aggregates.null_rates(yearly_accounts(spark, sf_dir), GAPPY), ["null_rate"])


@query("a4_distinct_count", """
SELECT CAST(count(*) AS BIGINT) AS entities FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""")
def distinct_count(spark, sf_dir):
    return aggregates.distinct_count(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("a5_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_tax FROM lineitem")
def distinct_rows(spark, sf_dir):
    return aggregates.distinct_rows(
        table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag", "l_tax"])


@query("a6_avg_by", with_(HY, """
SELECT ccn_key, round(avg(number_of_beds), 6) AS avg_beds FROM hy GROUP BY 1"""))
def avg_by(spark, sf_dir):
    return rounded(aggregates.avg_by(
        yearly_accounts(spark, sf_dir), ["ccn_key"], "number_of_beds", "avg_beds"), ["avg_beds"])


@query("a7_surrogate_key", """
SELECT l_partkey, l_suppkey, CAST(row_number() OVER (ORDER BY l_partkey, l_suppkey) AS BIGINT) AS pair_id
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)""")
def surrogate_key(spark, sf_dir):
    keys = ["l_partkey", "l_suppkey"]
    return ordered.surrogate_key(
        aggregates.distinct_rows(table(spark, sf_dir, "lineitem"), keys), keys, "pair_id")


@query("a8_median_by", """
SELECT l_suppkey, round(median(l_extendedprice), 6) AS median_l_extendedprice
FROM lineitem GROUP BY 1""")
def median_by(spark, sf_dir):
    return rounded(aggregates.median_by(
        table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice"),
        ["median_l_extendedprice"])


@query("a9_fit_median", with_(HY, f"""
SELECT {', '.join(f'round(median({c}), 4) AS {c}' for c in GAPPY)} FROM hy
WHERE fiscal_year <= 1998"""))
def fit_median(spark, sf_dir):
    """Fitted on the training years only."""
    return rounded(aggregates.fit_median(
        yearly_accounts(spark, sf_dir), GAPPY, where="fiscal_year <= 1998"), GAPPY, 4)


@query("a9_fit_median_by", with_(HY, "\nUNION ALL ".join(f"""
SELECT fiscal_year, '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS n,
       round(quantile_disc({c}, 0.5), 4) AS value FROM hy GROUP BY 1 HAVING count({c}) > 0"""
                                            for c in GAPPY)))
def fit_median_by(spark, sf_dir):
    """Per year, as an observed element."""
    return rounded(aggregates.fit_median(
        yearly_accounts(spark, sf_dir), GAPPY, by=["fiscal_year"], method="element"), ["value"], 4)


@query("a10_fit_quantile", """
SELECT round(quantile_cont(l_extendedprice, 0.99), 6) AS l_extendedprice,
       round(quantile_cont(l_discount, 0.99), 6) AS l_discount,
       round(quantile_cont(l_quantity, 0.99), 6) AS l_quantity FROM lineitem""")
def fit_quantile(spark, sf_dir):
    cols = ["l_extendedprice", "l_discount", "l_quantity"]
    return rounded(aggregates.fit_quantile(table(spark, sf_dir, "lineitem"), cols, 0.99), cols)


_DESCRIBED = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("a11_describe", "\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 4) AS mean,
       round(stddev_samp({c}), 4) AS stddev, min({c}) AS min, max({c}) AS max FROM lineitem"""
                                           for c in _DESCRIBED))
def describe(spark, sf_dir):
    return rounded(aggregates.describe(table(spark, sf_dir, "lineitem"), _DESCRIBED),
                   ["mean", "stddev"], 4)


_PROFILED = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
             ("o_totalprice", "double"), ("o_orderpriority", "string"))


@query("a12_profile", "\nUNION ALL ".join(f"""
SELECT '{c}' AS column_name, CAST({i} AS INTEGER) AS position, '{dtype}' AS dtype,
       CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) - count({c}) AS BIGINT) AS null_count
FROM orders""" for i, (c, dtype) in enumerate(_PROFILED)))
def profile(spark, sf_dir):
    """The example value is left out: engines print numbers differently."""
    return aggregates.profile(table(spark, sf_dir, "orders").select(
        *[c for c, _ in _PROFILED])).drop("example")


@query("a13_fit_standardize", f"""
SELECT {', '.join(f'round(avg({c}), 4) AS {c}__mean, round(stddev_pop({c}), 4) AS {c}__std' for c in _DESCRIBED)}
FROM lineitem WHERE year(l_shipdate) <= 1998""")
def fit_standardize(spark, sf_dir):
    train = table(spark, sf_dir, "lineitem").filter(F.year("l_shipdate") <= 1998)
    fitted = aggregates.fit_standardize(train, _DESCRIBED)
    return rounded(fitted, fitted.columns, 4)


@query("a14_class_weights", with_(RATED, """
SELECT ccn_key, fiscal_year, distress_label, round(
  CASE distress_label WHEN 1 THEN n / (2.0::DOUBLE * pos) ELSE n / (2.0::DOUBLE * (n - pos)) END, 6) AS weight
FROM rated CROSS JOIN (SELECT count(*) AS n, sum(distress_label) AS pos FROM rated)"""))
def class_weights(spark, sf_dir):
    rows = rated_accounts(spark, sf_dir).select("ccn_key", "fiscal_year", "distress_label")
    return rounded(aggregates.class_weights(rows, "distress_label"), ["weight"])
