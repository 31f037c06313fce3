"""Column expressions on hand-made rows that reach every branch."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fiscora.functions import numeric, text
from fiscora.operators import aggregates, columns, windows


def values(spark, expr, inputs, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, c {dtype}")
    return [r[0] for r in df.select("i", expr("c").alias("o")).orderBy("i").select("o").collect()]


def test_normalize_county(spark):
    given = ["Los Angeles County", " travis ", "Acadia Parish", "Kenai Borough",
             "Anchorage Municipality", "Bethel Census Area", "County Line", None]
    assert values(spark, text.normalize_county, given) == [
        "LOS ANGELES", "TRAVIS", "ACADIA", "KENAI", "ANCHORAGE", "BETHEL", "COUNTY LINE", None]
    assert values(spark, text.normalize_county_simple, ["Travis County", "Acadia Parish"]) == [
        "TRAVIS", "ACADIA PARISH"]


def test_normalize_name(spark):
    given = ["St. Mary Hosp", "ST MARY REGL MED CTR", "Reg Mem Gen Comm Med", "A & B Hosp",
             "1 MAIN ST", "ST.MARY"]
    assert values(spark, text.normalize_name, given) == [
        "SAINT MARY HOSPITAL", "SAINT MARY REGIONAL MEDICAL CENTER",
        "REGIONAL MEMORIAL GENERAL COMMUNITY MEDICAL", "A  B HOSPITAL", "1 MAIN SAINT",
        "SAINTMARY"]


def test_prefix_key(spark):
    given = ["A & B Hosp of Town", "One", "a b c d e", None]
    assert values(spark, text.prefix_key, given) == ["A  B HOSP", "ONE", "A B C D", None]
    collapsed = lambda c: text.prefix_key(c, collapse_blanks=True)
    assert values(spark, collapsed, given)[0] == "A B HOSP OF"


def test_years_and_keys(spark):
    assert values(spark, text.fiscal_year, ["06/30/2018", "6/30/2018", "13/45/2018", "x", None]) == [
        2018, None, None, None, None]
    assert values(spark, lambda c: text.zero_pad(c, 6), ["10001", "123456", "1234567", None]) == [
        "010001", "123456", "1234567", None]
    assert values(spark, text.fy_label, [2018], "int") == ["FY2018"]


def test_horizon_label(spark):
    df = spark.createDataFrame(
        [(2018, 2018), (2019, 2018), (2021, 2018), (2022, 2018), (2017, 2018), (None, 2018),
         (2019, None)], "e int, o int")
    got = [r[0] for r in df.select(numeric.horizon_label("e", "o")).collect()]
    assert got == [0, 1, 1, 0, 0, 0, 0]


def test_bands(spark):
    assert values(spark, numeric.rural_level, [1, 3, 4, 5, 6, 7, 8, 9, None], "int") == [
        "Metro", "Metro", "Micropolitan", "Micropolitan", "Small Town", "Small Town",
        "Remote Rural", "Remote Rural", None]
    assert values(spark, numeric.bed_size, [24.9, 25.0, 99.9, 100.0, 250.0, None], "double") == [
        "Critical Access", "Small Rural", "Small Rural", "Medium Rural", "Large Rural", "Large Rural"]
    assert values(spark, numeric.risk_tier, [0.3499, 0.35, 0.5999, 0.6, None], "double") == [
        "LOW", "ELEVATED", "ELEVATED", "HIGH", None]
    assert values(spark, numeric.apply_threshold, [0.3999, 0.4], "double") == [0, 1]


def test_guarded_arithmetic(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, -2.0), (1.0, None), (None, 2.0)],
                               "a double, b double")
    assert [r[0] for r in df.select(numeric.safe_ratio("a", "b")).collect()] == [
        0.5, None, None, None, None]
    capped = values(spark, lambda c: numeric.cap_upper(c, F.lit(2.0)), [1.0, 3.0, None], "double")
    assert capped == [1.0, 2.0, None]
    z = values(spark, lambda c: numeric.standardize(c, F.lit(1.0), F.lit(0.0)), [3.0], "double")
    assert z == [2.0]
    inf = values(spark, numeric.inf_to_null, [math.inf, -math.inf, 1.0, None], "double")
    assert inf == [None, None, 1.0, None]


def test_ten_ratios_on_edges(spark):
    row = dict.fromkeys(numeric.FINANCIAL_COLUMNS, 10.0)
    rows = [row, {**row, "net_patient_revenue": 0.0, "number_of_beds": 0.0},
            {**row, "total_days_title_xviii": 0.0, "total_days_title_xix": 0.0,
             "total_current_liabilities": -1.0},
            {**row, "total_patient_revenue": None, "total_costs": 0.0}]
    schema = ", ".join(f"{c} double" for c in numeric.FINANCIAL_COLUMNS)
    df = spark.createDataFrame([tuple(x[c] for c in numeric.FINANCIAL_COLUMNS) for x in rows], schema)
    got = df.select(*[c.alias(n) for n, c in numeric.ratio_columns().items()]).collect()
    assert got[0].asDict() == pytest.approx({
        "operating_margin": 0.0, "total_margin": 1.0, "cost_to_revenue": 1.0, "medicaid_pct": 1.0,
        "medicare_day_pct": 0.5, "occupancy_proxy": 20 / 3650, "days_cash_on_hand": 365.0,
        "current_ratio": 1.0, "uncompensated_care_pct": 2.0})
    assert got[1]["operating_margin"] is None and got[1]["occupancy_proxy"] is None
    assert got[2]["medicare_day_pct"] is None and got[2]["current_ratio"] is None
    assert got[2]["occupancy_proxy"] == 0.0
    assert got[3]["medicaid_pct"] is None and got[3]["days_cash_on_hand"] is None


def test_sanitize(spark):
    df = spark.createDataFrame([(1, 2)], "`FTE - (Employees)\n` int, `A=B` int")
    assert columns.sanitize_columns_basic(df).columns == ["FTE_-_Employees", "A_B"]
    assert columns.sanitize_columns_snake(df).columns == ["fte_employees", "a_b"]
    twice = spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int")
    assert columns.sanitize_columns_basic(twice).columns == ["a_b", "a-b"]
    with pytest.raises(ValueError, match="both become"):
        columns.sanitize_columns_snake(twice)


def test_missing_columns_and_nulls_fail(spark):
    df = spark.createDataFrame([(1, None)], "a int, b int")
    with pytest.raises(ValueError, match="c"):
        columns.require_columns(df, ["a", "c"])
    with pytest.raises(ValueError, match="b"):
        aggregates.require_no_nulls(df, ["a", "b"])


def test_filters_and_casts(spark):
    df = spark.createDataFrame([(1, "1.5"), (-1, "x"), (0, None), (None, "2")], "a int, t string")
    assert columns.filter_positive_or_null(df, ["a"]).count() == 2
    assert columns.filter_at_least(df, "a", 0).count() == 2
    assert [r["t"] for r in columns.cast_all(df, ["t"]).collect()] == [1.5, None, None, 2.0]


def test_yoy_gap_option(spark):
    df = spark.createDataFrame([("a", 2010, 100.0), ("a", 2012, 150.0), ("a", 2013, 75.0),
                                ("b", 2010, 0.0), ("b", 2011, 5.0)], "k string, y int, v double")
    plain = windows.yoy_change(df, "k", "y", "v", "c").orderBy("k", "y")
    assert [r["c"] for r in plain.collect()] == [None, 0.5, -0.5, None, None]
    strict = windows.yoy_change(df, "k", "y", "v", "c", require_gap=1).orderBy("k", "y")
    assert [r["c"] for r in strict.collect()] == [None, None, -0.5, None, None]


def test_class_weights(spark):
    df = spark.createDataFrame([(1,)] + [(0,)] * 3, "y int")
    got = {r["y"]: r["weight"] for r in aggregates.class_weights(df, "y").collect()}
    assert got == pytest.approx({1: 2.0, 0: 4 / 6})
    assert aggregates.fit_class_weights(df, "y").first()["pos_weight"] == 3.0
