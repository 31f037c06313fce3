"""First look at raw filings: gaps, rurality, closures and margins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fiscora.functions import text
from fiscora.operators import aggregates, columns, joins


def eda_margin(df: DataFrame, gross: str, expense: str, out: str) -> DataFrame:
    """Margin on gross revenue; a zero denominator gives NULL."""
    margin = F.try_divide(F.col(gross) - F.col(expense), F.col(gross))
    return columns.inf_to_null(df.withColumn(out, margin), [out])


def report(filings: DataFrame, rurality: DataFrame, closures: DataFrame, year: int,
           amounts: Sequence[str], gross: str = "total_patient_revenue",
           expense: str = "less_total_operating_expense") -> dict[str, DataFrame]:
    """Missing rates, rurality distribution and match rate, closures per year, median margins."""
    places = rurality.select(
        F.col("state").alias("_state"),
        text.normalize_county_simple("county_name").alias("_county"), "rucc_2013")
    located = joins.lookup_left(
        filings.withColumn("county_normalized", text.upper_trim("county")), places,
        [("state_code", "_state"), ("county_normalized", "_county")], ["rucc_2013"])
    events = closures.filter(F.col("closure_year") == year).select(
        text.upper_trim("hospital_name").alias("name_normalized"),
        text.upper_trim("state").alias("state_normalized"))
    named = filings.withColumns({
        "name_normalized": text.upper_trim("hospital_name"),
        "state_normalized": text.upper_trim("state_code")})
    flagged = joins.flag_membership(
        named, events, [("name_normalized",) * 2, ("state_normalized",) * 2], "is_closed")
    margins = eda_margin(flagged, gross, expense, "operating_margin")
    return {
        "missing": aggregates.null_rates(filings, amounts),
        "rurality": aggregates.count_by(located, ["rucc_2013"]),
        "match": joins.match_rate(located, "rucc_2013"),
        "rural": columns.filter_at_least(located, "rucc_2013", 4).agg(
            F.count("*").alias("rural")),
        "closures": aggregates.count_by(closures, ["closure_year"]),
        "closed": margins.agg(F.sum("is_closed").alias("closed")),
        "margin": aggregates.median_by(margins, ["is_closed"], "operating_margin"),
    }
