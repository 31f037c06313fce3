"""Cleaned layer: rural filings with a closure label and complete amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fiscora.functions import numeric, text
from fiscora.ml.prep import impute_apply, impute_by_group, impute_fit
from fiscora.operators import columns, joins
from fiscora.operators.aggregates import require_no_nulls
from fiscora.session import hand_over

# Fixed value: lowest rurality code that counts as rural.
RURAL_FROM = 4

# Columns of the cleaned layer.
SILVER_COLUMNS = (
    "ccn_key", "fiscal_year", "fips", "state_code", "rucc_2013", "number_of_beds",
    "total_patient_revenue", "net_patient_revenue", "total_costs", "net_income",
    "less_total_operating_expense", "medicaid_charges", "inpatient_total_charges",
    "total_days_title_xviii", "total_days_title_xix", "cash_on_hand_and_in_banks",
    "total_current_assets", "total_current_liabilities", "depreciation_cost",
    "cost_of_charity_care", "total_bad_debt_expense", "distress_label",
)


def with_rurality(filings: DataFrame, rurality: DataFrame) -> DataFrame:
    """Add ``rucc_2013`` and ``fips`` by state and bare county name."""
    places = rurality.select(
        F.col("state").alias("rucc_state"),
        text.normalize_county("county_name").alias("county_normalized"),
        F.col("rucc_2013").try_cast("int").alias("rucc_2013"),
        F.col("fips").cast("string").alias("fips"))
    return joins.lookup_left(
        filings.withColumn("county_normalized", text.normalize_county("county")), places,
        [("state_code", "rucc_state"), ("county_normalized", "county_normalized")],
        ["rucc_2013", "fips"])


def with_match_keys(df: DataFrame, name: str, state: str) -> DataFrame:
    return df.withColumns({
        "name_key": text.normalize_name(name), "name_prefix_key": text.prefix_key(name),
        "state_key": text.upper_trim(state)})


def label_closures(filings: DataFrame, closures: DataFrame,
                   closure_filter: str | Column | None = None) -> DataFrame:
    """Add ``closure_year`` and ``distress_label`` by two-pass name matching.

    ``closure_filter`` can keep only certain events, such as full closures.
    """
    events = closures if closure_filter is None else closures.filter(closure_filter)
    events = with_match_keys(events, "hospital_name", "state").withColumn(
        "closure_year", F.col("closure_year").try_cast("int"))
    keyed = with_match_keys(filings, "hospital_name", "state_code")
    matched = joins.match_two_pass(keyed, events, "name_key", "name_prefix_key", "state_key",
                                   "closure_year", "closure_year", observed="fiscal_year")
    return matched.withColumn(
        "distress_label", numeric.horizon_label("closure_year", "fiscal_year"))


def clean(filings: DataFrame, rurality: DataFrame, closures: DataFrame,
          closure_filter: str | Column | None = None) -> DataFrame:
    """Rural, labelled, typed and plausible filings; amounts may still be missing."""
    columns.require_columns(filings, numeric.FINANCIAL_COLUMNS)
    rural = columns.filter_at_least(with_rurality(filings, rurality), "rucc_2013", RURAL_FROM)
    dated = rural.withColumn("fiscal_year", text.fiscal_year("fiscal_year_end_date"))
    labelled = label_closures(dated, closures, closure_filter)
    typed = columns.cast_all(labelled, numeric.FINANCIAL_COLUMNS)
    plausible = columns.filter_positive_or_null(
        typed, ["total_patient_revenue", "number_of_beds"])
    return (plausible
            .withColumn("ccn_key", text.zero_pad("provider_ccn", 6))
            .withColumn("fips", text.zero_pad("fips", 5))
            .select(*SILVER_COLUMNS))


def build(filings: DataFrame, rurality: DataFrame, closures: DataFrame,
          impute: str | None = "global", fit_where: str | Column | None = None,
          closure_filter: str | Column | None = None, score_completeness: bool = False,
          method: str = "element") -> DataFrame:
    """Cleaned layer from the raw one.

    ``impute`` is ``global``, ``state_year`` (global where a group has no
    value) or None. ``fit_where`` limits the rows medians are fitted on.
    ``score_completeness`` adds the number of amounts present before imputing,
    so that deduplication can still tell amended filings apart. Imputing fails
    where an amount has no value at all, because a gap would remain.
    """
    rows = clean(filings, rurality, closures, closure_filter)
    if score_completeness:
        rows = rows.withColumn("completeness", numeric.completeness(
            [c for c in numeric.FINANCIAL_COLUMNS if c != "number_of_beds"]))
    amounts = list(numeric.FINANCIAL_COLUMNS)
    if impute is not None:
        # Medians take several passes; the joins above should run once.
        rows = hand_over(rows, "clean")
    if impute == "global":
        return require_no_nulls(
            impute_apply(rows, impute_fit(rows, amounts, fit_where, method), amounts), amounts)
    if impute == "state_year":
        return require_no_nulls(impute_by_group(
            rows, amounts, ["state_code", "fiscal_year"], fit_where, method), amounts)
    if impute is not None:
        raise ValueError(f"unknown imputation {impute!r}")
    return rows
