"""The financial-filing concepts expressed on the given star-schema tables.

Every DataFrame here has a SQL twin (a chain of common table expressions)
that computes the same rows, used by the SQL counterparts of the queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscora.functions import numeric, text
from fiscora.functions.text import AREA_SUFFIXES, NAME_RULES
from fiscora.plans.gold import features
from workload.registry import table

AMOUNTS = numeric.FINANCIAL_COLUMNS
YEARS = {"train": (1995, 1998), "val": (1999, 1999), "test": (2000, 2001)}


def amount_columns() -> list[Column]:
    """Amounts of a group of order lines."""
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    qty, flag, status = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    expense = qty * F.col("p_retailprice")
    net, costs = F.sum(price * (1 - disc)), F.sum(expense + price * tax)
    columns = {
        "total_patient_revenue": F.sum(price),
        "net_patient_revenue": net,
        "total_costs": costs,
        "net_income": net - costs,
        "less_total_operating_expense": F.sum(expense),
        "number_of_beds": F.count_distinct("l_partkey").cast("double"),
        "inpatient_total_charges": F.sum(F.when(status == "F", price)),
        "medicaid_charges": F.sum(F.when(flag == "R", price)),
        "total_days_title_xviii": F.sum(F.when(flag == "A", qty)),
        "total_days_title_xix": F.sum(F.when(flag == "N", qty)),
        "depreciation_cost": F.sum(price * tax),
        "cost_of_charity_care": F.sum(price * disc),
        "total_bad_debt_expense": F.sum(F.when((flag == "R") & (status == "O"), price)),
    }
    return [c.alias(name) for name, c in columns.items()]


AMOUNT_SQL = """
  sum(l_extendedprice) AS total_patient_revenue,
  sum(l_extendedprice * (1 - l_discount)) AS net_patient_revenue,
  sum(l_quantity * p_retailprice + l_extendedprice * l_tax) AS total_costs,
  sum(l_extendedprice * (1 - l_discount))
    - sum(l_quantity * p_retailprice + l_extendedprice * l_tax) AS net_income,
  sum(l_quantity * p_retailprice) AS less_total_operating_expense,
  CAST(count(DISTINCT l_partkey) AS DOUBLE) AS number_of_beds,
  sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice END) AS inpatient_total_charges,
  sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS medicaid_charges,
  sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS total_days_title_xviii,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS total_days_title_xix,
  sum(l_extendedprice * l_tax) AS depreciation_cost,
  sum(l_extendedprice * l_discount) AS cost_of_charity_care,
  sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN l_extendedprice END)
    AS total_bad_debt_expense"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return table(spark, sf_dir, "lineitem").join(
        part, F.col("l_partkey") == F.col("p_partkey"))


def yearly_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and year: ``ccn_key``, ``fiscal_year`` and all amounts."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"),
        "o_orderstatus", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    key = ["o_custkey", "fiscal_year"]
    sums = (_lines(spark, sf_dir).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy(*key).agg(*amount_columns()))
    balances = orders.groupBy(*key).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")))
        .alias("total_current_assets"),
        F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")))
        .alias("total_current_liabilities"))
    return (sums.join(balances, key)
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .withColumns({"ccn_key": text.zero_pad("o_custkey", 6),
                          "cash_on_hand_and_in_banks": F.abs("c_acctbal")})
            .select("ccn_key", "o_custkey", "fiscal_year", *AMOUNTS))


HY = f"""
sums AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, {AMOUNT_SQL}
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2),
balances AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year,
         sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS total_current_assets,
         sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS total_current_liabilities
  FROM orders GROUP BY 1, 2),
hy AS (
  SELECT lpad(CAST(s.o_custkey AS VARCHAR), 6, '0') AS ccn_key, s.*,
         total_current_assets, total_current_liabilities,
         abs(c_acctbal) AS cash_on_hand_and_in_banks
  FROM sums s JOIN balances b ON s.o_custkey = b.o_custkey AND s.fiscal_year = b.fiscal_year
  JOIN customer ON s.o_custkey = c_custkey)"""

RATIO_SQL = {
    "operating_margin": "CASE WHEN net_patient_revenue > 0 THEN (net_patient_revenue - less_total_operating_expense) / net_patient_revenue END",
    "total_margin": "CASE WHEN net_patient_revenue > 0 THEN net_income / net_patient_revenue END",
    "cost_to_revenue": "CASE WHEN net_patient_revenue > 0 THEN total_costs / net_patient_revenue END",
    "medicaid_pct": "CASE WHEN total_patient_revenue > 0 THEN medicaid_charges / total_patient_revenue END",
    "medicare_day_pct": "CASE WHEN total_days_title_xviii + total_days_title_xix > 0 THEN total_days_title_xviii / (total_days_title_xviii + total_days_title_xix) END",
    "occupancy_proxy": "CASE WHEN number_of_beds > 0 THEN (total_days_title_xviii + total_days_title_xix) / (number_of_beds * 365.0::DOUBLE) END",
    "days_cash_on_hand": "CASE WHEN total_costs > 0 THEN cash_on_hand_and_in_banks / (total_costs / 365.0::DOUBLE) END",
    "current_ratio": "CASE WHEN total_current_liabilities > 0 THEN total_current_assets / total_current_liabilities END",
    "uncompensated_care_pct": "CASE WHEN total_patient_revenue > 0 THEN (cost_of_charity_care + total_bad_debt_expense) / total_patient_revenue END",
    "revenue_yoy_change": "CASE WHEN lag(net_patient_revenue) OVER (PARTITION BY ccn_key ORDER BY fiscal_year) > 0 THEN (net_patient_revenue - lag(net_patient_revenue) OVER (PARTITION BY ccn_key ORDER BY fiscal_year)) / lag(net_patient_revenue) OVER (PARTITION BY ccn_key ORDER BY fiscal_year) END",
}
ALL_RATIOS_SQL = ",\n  ".join(f"{sql} AS {name}" for name, sql in RATIO_SQL.items())

# Name endings by customer number, as filed and spelled out.
ENDINGS = (" Mem Hosp", " Regl Med Ctr", " Comm Hosp", " Gen Hosp & Clinic West",
           " County Hospital Campus East")
FULL_ENDINGS = (" Memorial Hospital", " Regional Medical Center", " Community Hospital",
                " General Hospital & Clinic West", " County Hospital Campus East")


def _ending(c: Column, endings: tuple[str, ...]) -> Column:
    out = F.when(F.lit(False), "")
    for i, e in enumerate(endings):
        out = out.when(c % 5 == i, e)
    return out


def _ending_sql(endings: tuple[str, ...]) -> str:
    return ("CASE c_custkey % 5 "
            + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(endings)) + " END")


def _name(first: str, endings: tuple[str, ...]) -> Column:
    key = F.col("c_custkey")
    return F.concat(F.lit(first), (key % 200).cast("string"), _ending(key, endings))


NAME_SQL = f"'St. N' || CAST(c_custkey % 200 AS VARCHAR) || {_ending_sql(ENDINGS)}"
FULL_NAME_SQL = f"'Saint N' || CAST(c_custkey % 200 AS VARCHAR) || {_ending_sql(FULL_ENDINGS)}"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw filing per order; a customer's orders of a year are amended filings."""
    per_order = _lines(spark, sf_dir).groupBy("l_orderkey").agg(*amount_columns())
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice")
    filed = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status, total = F.col("o_orderstatus"), F.col("o_totalprice")
    named = filed.join(_customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    return named.select(
        F.col("o_orderkey").alias("filing_id"),
        F.col("c_custkey").cast("string").alias("provider_ccn"),
        _name("St. N", ENDINGS).alias("hospital_name"),
        F.col("n_name").alias("state_code"),
        F.when(F.col("c_custkey") % 17 == 0, "Nowhere").otherwise(
            F.concat("c_mktsegment", F.lit(" county "))).alias("county"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("fiscal_year_end_date"),
        *[F.col(c) for c in AMOUNTS if c not in (
            "total_current_assets", "total_current_liabilities", "cash_on_hand_and_in_banks")],
        F.abs("c_acctbal").alias("cash_on_hand_and_in_banks"),
        F.when(status == "F", total).alias("total_current_assets"),
        F.when(status == "O", total).alias("total_current_liabilities"))


def rurality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nation and market segment, standing for a county."""
    initial = F.ascii(F.col("c_mktsegment"))
    return _customers(spark, sf_dir).select(
        (F.col("n_nationkey") * 100 + initial).cast("string").alias("fips"),
        F.col("n_name").alias("state"),
        F.concat(F.initcap("c_mktsegment"), F.when(F.col("n_nationkey") % 2 == 0, " County")
                 .otherwise(" Parish")).alias("county_name"),
        ((F.col("n_nationkey") + initial) % 9 + 1).cast("int").alias("rucc_2013")).distinct()


def closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closure events: customers with a negative balance, half of them under a changed name."""
    key = F.col("c_custkey")
    return _customers(spark, sf_dir).filter("c_acctbal < 0").select(
        F.when(key % 2 == 0, _name("Saint N", FULL_ENDINGS))
        .otherwise(F.concat(_name("St. N", ENDINGS), F.lit(" (old site)"))).alias("hospital_name"),
        F.lower("n_name").alias("state"),
        (F.lit(1995) + key % 7).cast("string").alias("closure_year"))


RAW = f"""
per_order AS (
  SELECT l_orderkey, {AMOUNT_SQL}
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
filings AS (
  SELECT o_orderkey AS filing_id, CAST(c_custkey AS VARCHAR) AS provider_ccn,
         {NAME_SQL} AS hospital_name, n_name AS state_code,
         CASE WHEN c_custkey % 17 = 0 THEN 'Nowhere' ELSE c_mktsegment || ' county ' END AS county,
         strftime(o_orderdate, '%m/%d/%Y') AS fiscal_year_end_date,
         p.* EXCLUDE (l_orderkey), abs(c_acctbal) AS cash_on_hand_and_in_banks,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS total_current_assets,
         CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS total_current_liabilities
  FROM orders LEFT JOIN per_order p ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
rurality AS (
  SELECT DISTINCT CAST(n_nationkey * 100 + ascii(c_mktsegment) AS VARCHAR) AS fips,
         n_name AS state,
         upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2))
           || CASE WHEN n_nationkey % 2 = 0 THEN ' County' ELSE ' Parish' END AS county_name,
         CAST((n_nationkey + ascii(c_mktsegment)) % 9 + 1 AS INTEGER) AS rucc_2013
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
closures AS (
  SELECT CASE WHEN c_custkey % 2 = 0 THEN {FULL_NAME_SQL}
              ELSE {NAME_SQL} || ' (old site)' END AS hospital_name,
         lower(n_name) AS state, CAST(1995 + c_custkey % 7 AS VARCHAR) AS closure_year
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0)"""


def county_sql(c: str) -> str:
    return (f"trim(regexp_replace(upper(trim({c})), "
            f"'\\s*({'|'.join(AREA_SUFFIXES)})\\s*$', ''))")


def name_sql(c: str) -> str:
    sql = f"upper(trim({c}))"
    for pattern, replacement in NAME_RULES:
        sql = f"regexp_replace({sql}, '{pattern}', '{replacement}', 'g')"
    return f"regexp_replace({sql}, '[^A-Z0-9\\s]', '', 'g')"


def prefix_sql(c: str) -> str:
    return (f"array_to_string(string_split(regexp_replace(upper(trim({c})), "
            f"'[^A-Z0-9\\s]', '', 'g'), ' ')[1:4], ' ')")


def label_sql(event: str, year: str) -> str:
    return f"CAST(CASE WHEN {event} > {year} AND {event} - {year} <= 3 THEN 1 ELSE 0 END AS INTEGER)"


def event_sql(keys: str, year: str) -> str:
    """Earliest matching event after ``year``, else the latest matching one."""
    return (f"coalesce((SELECT min(y) FROM events_keyed e WHERE {keys} AND y > {year}), "
            f"(SELECT max(y) FROM events_keyed e WHERE {keys}))")


LABELLED = RAW + f""",
events_keyed AS (
  SELECT {name_sql('hospital_name')} AS name_key, {prefix_sql('hospital_name')} AS name_prefix_key,
         upper(trim(state)) AS state_key, TRY_CAST(closure_year AS INTEGER) AS y FROM closures),
rural AS (
  SELECT f.*, r.rucc_2013, r.fips,
         CAST(year(try_strptime(fiscal_year_end_date, '%m/%d/%Y')) AS INTEGER) AS fiscal_year,
         {name_sql('f.hospital_name')} AS name_key, {prefix_sql('f.hospital_name')} AS name_prefix_key,
         upper(trim(f.state_code)) AS state_key
  FROM filings f LEFT JOIN rurality r
    ON f.state_code = r.state AND {county_sql('f.county')} = {county_sql('r.county_name')}
  WHERE r.rucc_2013 >= 4),
labelled AS (
  SELECT *, {label_sql('closure_year', 'fiscal_year')} AS distress_label FROM (
    SELECT r.*, coalesce(
      {event_sql('e.name_key = r.name_key AND e.state_key = r.state_key', 'r.fiscal_year')},
      {event_sql('e.name_prefix_key = r.name_prefix_key AND e.state_key = r.state_key', 'r.fiscal_year')}
      ) AS closure_year FROM rural r))"""

_SCORED = [c for c in AMOUNTS if c != "number_of_beds"]
_SILVER_KEYS = "lpad(provider_ccn, 6, '0') AS ccn_key, fiscal_year, lpad(fips, 5, '0') AS fips, state_code, rucc_2013"
SILVER = LABELLED + f""",
plausible AS (
  SELECT {_SILVER_KEYS}, {', '.join(AMOUNTS)}, distress_label,
         CAST({' + '.join(f'({c} IS NOT NULL)::INTEGER' for c in _SCORED)} AS INTEGER) AS completeness
  FROM labelled
  WHERE (total_patient_revenue > 0 OR total_patient_revenue IS NULL)
    AND (number_of_beds > 0 OR number_of_beds IS NULL)),
medians AS (
  SELECT {', '.join(f'quantile_disc({c}, 0.5) AS m_{c}' for c in AMOUNTS)} FROM plausible),
silver AS (
  SELECT ccn_key, fiscal_year, fips, state_code, rucc_2013, distress_label, completeness,
         {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in AMOUNTS)}
  FROM plausible CROSS JOIN medians)"""

_TIES = ["completeness", "distress_label", "fips", "state_code", "rucc_2013", "number_of_beds",
         "total_patient_revenue", "net_patient_revenue", "total_costs", "net_income",
         "less_total_operating_expense", "medicaid_charges", "inpatient_total_charges",
         "total_days_title_xviii", "total_days_title_xix", "cash_on_hand_and_in_banks",
         "total_current_assets", "total_current_liabilities", "depreciation_cost",
         "cost_of_charity_care", "total_bad_debt_expense"]
GOLD = SILVER + f""",
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ccn_key, fiscal_year ORDER BY
    {', '.join(f'{c} DESC NULLS LAST' for c in _TIES)}) AS nth FROM silver) WHERE nth = 1),
dim_time AS (
  SELECT fiscal_year, row_number() OVER (ORDER BY fiscal_year) AS time_id
  FROM (SELECT DISTINCT fiscal_year FROM best)),
dim_geography AS (
  SELECT *, row_number() OVER (ORDER BY fips, state_code, rucc_2013) AS geo_id,
    CASE WHEN rucc_2013 <= 3 THEN 'Metro' WHEN rucc_2013 <= 5 THEN 'Micropolitan'
         WHEN rucc_2013 <= 7 THEN 'Small Town' WHEN rucc_2013 IS NOT NULL THEN 'Remote Rural' END
      AS rural_level
  FROM (SELECT DISTINCT fips, state_code, rucc_2013 FROM best)),
dim_hospital AS (
  SELECT ccn_key, avg(number_of_beds) AS avg_beds,
         row_number() OVER (ORDER BY ccn_key) AS hospital_id FROM best GROUP BY ccn_key),
dim_payer AS (
  SELECT ccn_key, fiscal_year, row_number() OVER (ORDER BY ccn_key, fiscal_year) AS payer_id
  FROM best),
rated AS (SELECT *, {ALL_RATIOS_SQL} FROM best),
fact AS (
  SELECT hospital_id, time_id, geo_id, payer_id, ccn_key, fiscal_year,
         {', '.join(numeric.FEATURE_COLUMNS)}, distress_label
  FROM rated LEFT JOIN dim_time USING (fiscal_year)
  LEFT JOIN dim_geography USING (fips, state_code, rucc_2013)
  LEFT JOIN dim_hospital USING (ccn_key) LEFT JOIN dim_payer USING (ccn_key, fiscal_year))"""


def rated_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-years with the ten ratios, a closure label and a rurality tier."""
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey",
        F.when(F.col("c_acctbal") < 0, 1995 + F.col("c_custkey") % 7).alias("closure_year"))
    rated = features(yearly_accounts(spark, sf_dir))
    return rated.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "ccn_key", "fiscal_year", *numeric.FEATURE_COLUMNS,
        numeric.horizon_label("closure_year", "fiscal_year").alias("distress_label"),
        numeric.rural_level(F.col("c_nationkey") % 9 + 1).alias("rural_level"))


RATED = HY + f""",
rated AS (
  SELECT ccn_key, fiscal_year, {', '.join(numeric.FEATURE_COLUMNS)},
    {label_sql('closure_year', 'fiscal_year')} AS distress_label,
    CASE WHEN code <= 3 THEN 'Metro' WHEN code <= 5 THEN 'Micropolitan'
         WHEN code <= 7 THEN 'Small Town' ELSE 'Remote Rural' END AS rural_level
  FROM (SELECT hy.*, {ALL_RATIOS_SQL} FROM hy)
  JOIN (SELECT c_custkey, c_nationkey % 9 + 1 AS code,
               CASE WHEN c_acctbal < 0 THEN 1995 + c_custkey % 7 END AS closure_year
        FROM customer) ON o_custkey = c_custkey)"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def rounded_sql(cols, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
