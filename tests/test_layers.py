"""Raw files to star schema on a hand-made set of filings."""

from __future__ import annotations

import csv

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fiscora.functions.numeric import FEATURE_COLUMNS, FINANCIAL_COLUMNS
from fiscora.operators.columns import sanitize_columns_snake
from fiscora.plans import bronze, eda, gold, silver
from fiscora.sources.csv import read_csv, read_csv_many
from workload import plans

HEAD = ["Provider CCN", "Hospital Name", "State Code", "County", "Fiscal Year End Date"]
AMOUNT_HEAD = [c.replace("_", " ").title() for c in FINANCIAL_COLUMNS]


def filing(ccn, name, state, county, date, **amounts):
    given = {**{c: "100" for c in FINANCIAL_COLUMNS}, **amounts}
    return [ccn, name, state, county, date] + [given[c] for c in FINANCIAL_COLUMNS]


FILINGS_A = [
    filing("10001", "St. Mary Hosp", "AL", "Dale County", "06/30/2017", net_patient_revenue="200"),
    # Amended: the same key and year, fewer amounts.
    filing("10001", "St. Mary Hosp", "AL", "Dale County", "12/31/2017", net_patient_revenue="",
           total_costs=""),
    filing("10001", "St. Mary Hosp", "AL", "Dale", "06/30/2019", net_patient_revenue="300"),
    filing("20002", "Valley Gen\nMed Ctr North", "LA", "Acadia Parish", "06/30/2018",
           number_of_beds="0"),
    filing("20003", "Metro Hospital", "AL", "Big City", "06/30/2018"),
    filing("20004", "Nowhere Hospital", "AL", "Atlantis", "06/30/2018"),
]
FILINGS_B = [
    filing("20005", "River Valley Community Hospital of Dale", "AL", "DALE COUNTY", "06/30/2018",
           total_patient_revenue="not known"),
    filing("1234567", "Peña Hospital", "AK", "Bethel", "bad date", number_of_beds=""),
    filing("20006", "Loss Hospital", "LA", "Acadia", "06/30/2018", total_patient_revenue="-5"),
    filing("20007", "Late Hosp", "LA", "Acadia", "06/30/2014"),
]
RURALITY = [["FIPS", "State", "County_Name", "RUCC_2013"],
            ["1045", "AL", "Dale County", "4"], ["1073", "AL", "Big City", "1"],
            ["22001", "LA", "Acadia Parish", "6"], ["2050", "AK", "Bethel Census Area", "9"],
            ["72001", "PR", "Añasco Municipio", "2"]]
CLOSURES = [["hospital_name", "state", "closure_year"],
            ["Saint Mary Hospital", "al", "2018"], ["Saint Mary Hospital", "al", "2018"],
            ["Saint Mary Hospital", "al", "2022"],
            ["River Valley Community Hospital (closed)", "AL", "2021"],
            ["Late Hospital", "LA", "2018"], ["Unknown", "LA", "soon"]]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")

    def write(name, rows, encoding="utf-8"):
        with open(root / name, "w", newline="", encoding=encoding) as f:
            csv.writer(f).writerows(rows)
        return str(root / name)

    head = HEAD + AMOUNT_HEAD
    a = write("a.csv", [head] + FILINGS_A)
    # The second file has its columns the other way round and one more.
    b = write("b.csv", [["Extra"] + head[::-1]] + [["x"] + r[::-1] for r in FILINGS_B])
    out = bronze.BronzePaths.under(str(root / "bronze"))
    return bronze.ingest(spark, [a, b], write("r.csv", RURALITY, "latin-1"),
                         write("c.csv", CLOSURES), out)


@pytest.fixture(scope="module")
def snake(raw):
    return {k: sanitize_columns_snake(v) for k, v in raw.items()}


def test_bronze(raw):
    filings = raw["filings"]
    assert filings.count() == 10
    assert "Provider_CCN" in filings.columns and "Less_Total_Operating_Expense" in filings.columns
    by_file = {r[0].rsplit("/", 1)[-1]: r[1] for r in
               filings.groupBy("source_file").count().collect()}
    assert by_file == {"a.csv": 6, "b.csv": 4}
    assert {r[0] for r in filings.select("Extra").collect()} == {None, "x"}
    assert filings.filter(F.contains("Hospital_Name", F.lit("\n"))).count() == 1
    assert "Añasco Municipio" in {r[0] for r in raw["rurality"].select("County_Name").collect()}


def test_declared_schema_fills_absent_columns(spark, tmp_path):
    for name, text in (("a", "x,y\n1,2\n"), ("b", "y,x\n4,3\n"), ("c", "x\n5\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    schema = StructType([StructField("y", DoubleType()), StructField("x", DoubleType()),
                         StructField("z", StringType())])
    got = read_csv_many(spark, [str(tmp_path / f"{n}.csv") for n in "abc"], schema)
    assert sorted(map(tuple, got.collect()), key=str) == [
        (2.0, 1.0, None), (4.0, 3.0, None), (None, 5.0, None)]


def test_silver_without_imputation(snake):
    got = {(r["ccn_key"], r["fiscal_year"], r["net_patient_revenue"]): r for r in silver.build(
        snake["filings"], snake["rurality"], snake["closures"], impute=None).collect()}
    # Metro, unmatched, zero-bed and negative-revenue filings are gone.
    assert {k[0] for k in got} == {"010001", "020005", "1234567", "020007"}
    assert len(got) == 6
    assert got[("010001", 2017, 200.0)]["distress_label"] == 1
    # The 2018 event is over by 2019; the 2022 one is three years away.
    assert got[("010001", 2019, 300.0)]["distress_label"] == 1
    # Found by the first four words only.
    prefix = got[("020005", 2018, 100.0)]
    assert prefix["distress_label"] == 1 and prefix["total_patient_revenue"] is None
    assert got[("1234567", None, 100.0)]["fips"] == "02050"
    # Four years are outside the horizon.
    assert got[("020007", 2014, 100.0)]["distress_label"] == 0


def test_silver_imputation(snake):
    rows = silver.build(snake["filings"], snake["rurality"], snake["closures"],
                        score_completeness=True).collect()
    assert all(r[c] is not None for r in rows for c in FINANCIAL_COLUMNS)
    amended = next(r for r in rows if r["completeness"] == 13)
    # Observed element below the middle of 100, 100, 100, 200, 300 without the two gaps.
    assert amended["net_patient_revenue"] == 100.0
    grouped = silver.build(snake["filings"], snake["rurality"], snake["closures"],
                           impute="state_year", method="interpolate").collect()
    assert {r["net_patient_revenue"] for r in grouped
            if r["ccn_key"] == "010001" and r["fiscal_year"] == 2017} == {200.0}
    fitted = silver.build(snake["filings"], snake["rurality"], snake["closures"],
                          fit_where="fiscal_year >= 2019").collect()
    assert {r["net_patient_revenue"] for r in fitted if r["fiscal_year"] == 2017} == {200.0, 300.0}
    with pytest.raises(ValueError):
        silver.build(snake["filings"], snake["rurality"], snake["closures"], impute="mean")


def test_silver_fails_on_a_gap_that_remains(snake):
    unknown = snake["filings"].withColumn("net_income", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="net_income"):
        silver.build(unknown, snake["rurality"], snake["closures"])


def test_closure_filter(snake):
    kept = silver.build(snake["filings"], snake["rurality"], snake["closures"], impute=None,
                        closure_filter="hospital_name NOT LIKE 'Saint%'")
    labels = {r["ccn_key"]: r["distress_label"] for r in kept.collect()}
    assert labels["010001"] == 0 and labels["020005"] == 1


def test_star_schema(spark, snake, tmp_path):
    rows = silver.build(snake["filings"], snake["rurality"], snake["closures"],
                        score_completeness=True).filter("fiscal_year IS NOT NULL")
    tables = gold.build(spark, rows, gold.GoldPaths.under(str(tmp_path)))
    fact = tables["fact"]
    assert fact.columns == ["hospital_id", "time_id", "geo_id", "payer_id", "ccn_key",
                            "fiscal_year", *FEATURE_COLUMNS, "distress_label"]
    got = {(r["ccn_key"], r["fiscal_year"]): r for r in fact.collect()}
    # The amended filing lost: its gaps were counted before they were filled.
    assert len(got) == 4 and got[("010001", 2017)]["total_margin"] == 0.5
    assert got[("010001", 2017)]["revenue_yoy_change"] is None
    assert got[("010001", 2019)]["revenue_yoy_change"] == 0.5
    for name, key in (("dim_time", "time_id"), ("dim_geography", "geo_id"),
                      ("dim_hospital", "hospital_id"), ("dim_payer", "payer_id")):
        ids = sorted(r[key] for r in tables[name].collect())
        assert ids == list(range(1, len(ids) + 1))
        assert all(r[key] in ids for r in got.values())
    report = {(r["section"], r["item"]): r["value"] for r in gold.verify(tables).collect()}
    assert report[("rows", "fact")] == 4 and report[("null_keys", "geo_id")] == 0
    assert report[("labels", "1")] == 3 and report[("label_rate", "rate")] == 0.75
    strict = gold.features(spark.read.parquet(f"{tmp_path}/filings"), require_gap=1)
    assert all(r["revenue_yoy_change"] is None for r in strict.collect())


def test_null_geography_keeps_the_row(spark, tmp_path):
    row = {"ccn_key": "1", "fiscal_year": 2018, "fips": None, "state_code": "AL", "rucc_2013": None,
           **{c: 1.0 for c in FINANCIAL_COLUMNS}, "distress_label": 0}
    schema = ", ".join(
        f"{k} {'int' if k in ('fiscal_year', 'rucc_2013', 'distress_label') else 'string' if k in ('ccn_key', 'fips', 'state_code') else 'double'}"
        for k in row)
    tables = gold.build(spark, spark.createDataFrame([tuple(row.values())], schema),
                        gold.GoldPaths.under(str(tmp_path)))
    assert tables["fact"].first()["geo_id"] is None
    assert tables["dim_geography"].first()["rural_level"] is None


def test_first_look(snake):
    filings = snake["filings"].withColumns(
        {c: F.col(c).try_cast("double") for c in FINANCIAL_COLUMNS})
    parts = eda.report(filings, snake["rurality"], snake["closures"].withColumn(
        "closure_year", F.col("closure_year").try_cast("int")), 2018,
        ["net_patient_revenue", "total_costs", "number_of_beds"])
    assert parts["missing"].first()["null_rate"] == 0.1
    assert parts["closed"].first()["closed"] == 0
    # Without suffix rules only "Dale", "DALE COUNTY" and "Big City" style names meet.
    assert parts["match"].first()["rows"] == 10
    margins = {r["is_closed"]: r["median_operating_margin"] for r in parts["margin"].collect()}
    assert margins == {0: 0.0}


def test_headers_of_files_in_a_folder_are_matched_by_name(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("id,amount,beds\n1,20,200\n")
    (folder / "b.csv").write_text("id,beds,amount\n2,300,30\n")
    schema = StructType([StructField("id", StringType()), StructField("amount", StringType()),
                         StructField("beds", StringType())])
    rows = {r["id"]: (r["amount"], r["beds"]) for r in read_csv_many(spark, [str(folder)], schema).collect()}
    assert rows == {"1": ("20", "200"), "2": ("30", "300")}
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(folder), schema).collect()


def test_filings_are_written_in_parts_from_one_evaluation(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    raw = spark.range(0, 30, 1, 2).mapInPandas(count, "id long")
    parts = plans._write_parts(spark, raw, F.when(F.col("id") < 10, "early").when(F.col("id") > 10, "late"),
                               ("early", "late", "never"), str(tmp_path / "filings"))
    assert seen.value == 30
    rows = [spark.read.option("header", True).csv(p) for p in parts]
    assert [r.columns for r in rows] == [["id"]] * 3 and [r.count() for r in rows] == [10, 19, 0]
