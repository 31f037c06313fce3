"""Queries on whole layers: raw, cleaned, star schema, study, stream and first look."""

from __future__ import annotations

from pyspark.sql import functions as F

from fiscora.functions import numeric
from fiscora.ml import score
from fiscora.operators.windows import union_all
from fiscora.plans import bronze, eda, gold, ingest_stream, modeling, silver
from fiscora.session import hand_over, scratch_path
from fiscora.streaming.stream import StreamConfig
from workload.binding import (
    AMOUNTS, GOLD, HY, RATIO_SQL, RAW, SILVER, YEARS, closures, filings, rounded_sql, rurality,
    with_, yearly_accounts)
from workload.registry import query, r, rounded
from workload.streams import SCHEMA, _topic


@query("l0_margin_by_year", with_(HY, f"""
SELECT fiscal_year, CAST(count(*) AS BIGINT) AS filings,
       round(avg({RATIO_SQL['operating_margin']}), 6) AS avg_operating_margin FROM hy GROUP BY 1"""))
def margin_by_year(spark, sf_dir):
    margins = yearly_accounts(spark, sf_dir).withColumn(
        "operating_margin", numeric.ratio_columns()["operating_margin"])
    return margins.groupBy("fiscal_year").agg(
        F.count("*").alias("filings"), r(F.avg("operating_margin")).alias("avg_operating_margin"))


def _write_parts(spark, raw, part, names, root):
    """CSV of the rows in a folder per part, from one evaluation of ``raw``; a part without rows
    is a header."""
    raw.withColumn("part", part).filter("part IS NOT NULL").write.partitionBy("part").option("header", True).csv(root)
    folders = [f"{root}/part={name}" for name in names]
    for folder in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            raw.limit(0).write.option("header", True).csv(folder)
    return folders


@query("l1_bronze", with_(RAW, """
SELECT filing_id::VARCHAR AS filing_id, provider_ccn AS "Provider_CCN", hospital_name AS "Hospital_Name",
       round(total_patient_revenue, 4) AS total_patient_revenue,
       CASE WHEN right(fiscal_year_end_date, 4) <= '1998' THEN 'early' ELSE 'late' END AS source,
       (SELECT CAST(count(*) AS BIGINT) FROM rurality) AS counties,
       (SELECT CAST(count(*) AS BIGINT) FROM closures) AS events
FROM filings"""))
def bronze_layer(spark, sf_dir):
    """Raw files with raw headers into the raw layer."""
    raw = filings(spark, sf_dir).withColumnsRenamed(
        {"provider_ccn": "Provider CCN", "hospital_name": "Hospital Name"})
    root = scratch_path(spark, "raw")
    year = F.right("fiscal_year_end_date", F.lit(4))
    parts = _write_parts(spark, raw, F.when(year <= "1998", "early").when(year > "1998", "late"),
                         ("early", "late"), f"{root}/filings")
    for name, rows in (("rurality", rurality(spark, sf_dir)), ("closures", closures(spark, sf_dir))):
        rows.write.option("header", True).csv(f"{root}/{name}")
    tables = bronze.ingest(spark, parts, f"{root}/rurality",
                           f"{root}/closures", bronze.BronzePaths.under(scratch_path(spark, "bronze")))
    counts = {name: tables[name].agg(F.count("*")).scalar() for name in ("rurality", "closures")}
    return tables["filings"].select(
        "filing_id", "Provider_CCN", "Hospital_Name",
        r(F.col("total_patient_revenue").cast("double"), 4).alias("total_patient_revenue"),
        F.regexp_replace(F.element_at(F.split("source_file", "/"), -2), "^part=", "").alias("source"),
        counts["rurality"].alias("counties"), counts["closures"].alias("events"))


def _silver(spark, sf_dir):
    return silver.build(filings(spark, sf_dir), rurality(spark, sf_dir), closures(spark, sf_dir),
                        score_completeness=True)


@query("l2_silver", with_(SILVER, f"""
SELECT ccn_key, fiscal_year, fips, state_code, rucc_2013, distress_label, completeness,
       {rounded_sql(AMOUNTS, 4)} FROM silver"""))
def silver_layer(spark, sf_dir):
    return rounded(_silver(spark, sf_dir), AMOUNTS, 4)


def _gold(spark, sf_dir):
    return gold.build(spark, _silver(spark, sf_dir), gold.GoldPaths.under(scratch_path(spark, "gold")))


@query("l3_gold", with_(GOLD, f"""
SELECT hospital_id, time_id, geo_id, payer_id, ccn_key, fiscal_year, distress_label,
       {rounded_sql(numeric.FEATURE_COLUMNS)} FROM fact"""))
def gold_layer(spark, sf_dir):
    return rounded(_gold(spark, sf_dir)["fact"], numeric.FEATURE_COLUMNS)


_IDS = ("hospital_id", "time_id", "geo_id", "payer_id")
_FACT = [*((c, "bigint") for c in _IDS), ("ccn_key", "string"), ("fiscal_year", "int"),
         *((c, "double") for c in numeric.FEATURE_COLUMNS), ("distress_label", "int")]


@query("l4_gold_verify", with_(GOLD, "\nUNION ALL ".join(
    [f"SELECT 'rows' AS section, '{t}' AS item, CAST(count(*) AS DOUBLE) AS value FROM {t}"
     for t in ("fact", "dim_hospital", "dim_geography", "dim_time", "dim_payer")]
    + [f"SELECT 'null_keys', '{c}', CAST(count(*) - count({c}) AS DOUBLE) FROM fact" for c in _IDS]
    + [f"SELECT 'schema', '{c} {t}', {i}.0::DOUBLE" for i, (c, t) in enumerate(_FACT, 1)]
    + [f"SELECT 'features', '{c} {m}', round(CAST({fn}({c}) AS DOUBLE), 6) FROM fact"
       for c in numeric.FEATURE_COLUMNS
       for m, fn in (("count", "count"), ("mean", "avg"), ("stddev", "stddev_samp"), ("min", "min"), ("max", "max"))]
    + ["SELECT 'labels', CAST(distress_label AS VARCHAR), CAST(count(*) AS DOUBLE) FROM fact GROUP BY 2",
       "SELECT 'label_rate', 'rate', round(avg(distress_label), 6) FROM fact",
       "SELECT 'years', CAST(fiscal_year AS VARCHAR), CAST(count(*) AS DOUBLE) FROM fact GROUP BY 2"])))
def gold_verify(spark, sf_dir):
    return rounded(gold.verify(_gold(spark, sf_dir)), ["value"])


_TEST = f"FROM fact LEFT JOIN dim_geography USING (geo_id) WHERE fiscal_year BETWEEN {YEARS['test'][0]} AND {YEARS['test'][1]}"


@query("l5_study", with_(GOLD, f"""
SELECT 'tier' AS section, rural_level AS item, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(distress_label) AS BIGINT) AS positives, TRUE AS holds {_TEST} AND rural_level <> 'Metro' GROUP BY 2
UNION ALL SELECT 'split', split, CAST(count(*) AS BIGINT), CAST(sum(distress_label) AS BIGINT), TRUE FROM (
  SELECT distress_label, CASE {' '.join(f"WHEN fiscal_year BETWEEN {a} AND {b} THEN '{s}'" for s, (a, b) in YEARS.items())} END AS split
  FROM fact) WHERE split IS NOT NULL GROUP BY 2
UNION ALL SELECT 'model', unnest(['LogisticRegression', 'RandomForest', 'BoostedTrees']), 1, 1, TRUE
UNION ALL SELECT 'rounds', 'BoostedTrees', 300, 1, TRUE
UNION ALL SELECT 'saved', 'best', CAST(count(*) AS BIGINT), 1, TRUE {_TEST}"""))
def study(spark, sf_dir):
    """Rows and positives per tier and split, both ranking metrics of every model between 0
    and 1, 300 rounds of the boosted trees, and the scores of the saved best model, from raw
    rows, equal to those of the study."""
    tables = _gold(spark, sf_dir)
    out = modeling.run(spark, tables["fact"], tables["dim_geography"],
                       scratch_path(spark, "runs"), years=YEARS)
    row = ["section", "item", "n", "positives", "holds"]

    def shaped(df, section, item, n, positives, holds):
        cells = (F.lit(section), F.col(item) if isinstance(item, str) else item, n.cast("long"),
                 positives.cast("long"), holds)
        return df.select(*[c.alias(name) for c, name in zip(cells, row)])

    metric = F.col("roc_auc").between(0, 1) & F.col("average_precision").between(0, 1)
    raw = modeling.model_rows(tables["fact"], tables["dim_geography"]).join(
        out.test_scores.select("ccn_key", "fiscal_year", "score"), ["ccn_key", "fiscal_year"])
    again = score.score_saved(spark, out.paths[out.best], raw, ["score"])
    return union_all([
        shaped(out.fairness, "tier", "rural_level", F.col("n"), F.col("positives"),
               F.coalesce(F.col("fpr").between(0, 1), F.lit(True))),
        shaped(out.splits, "split", "split", F.col("rows"), F.col("positives"),
               F.abs(F.col("rate") * F.col("rows") - F.col("positives")) < 1e-6),
        shaped(out.comparison, "model", "model", F.lit(1), F.lit(1), metric),
        shaped(out.rounds.agg(F.count("*").alias("n"), F.every(metric).alias("ok")), "rounds",
               F.lit("BoostedTrees"), F.col("n"), F.lit(1), F.col("ok")),
        shaped(again.agg(F.count("*").alias("n"), F.every(
            F.col("risk_score") == F.round("score", 4)).alias("ok")), "saved",
            F.lit("best"), F.col("n"), F.lit(1), F.col("ok"))])


@query("l6_stream_ingest", """
SELECT 'valid' AS outcome, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
       event_type, props, round(value, 6) AS value, epoch_us(ts) AS ts, CAST(1 AS BIGINT) AS counted
FROM events WHERE event_type <> 'error'
UNION ALL SELECT 'rejected', NULL, CAST(user_id AS VARCHAR), NULL, NULL, NULL, NULL, 1
FROM events WHERE event_type = 'error'""")
def stream_ingest(spark, sf_dir):
    """Valid and rejected messages; ``counted`` is 1 where the record of batches agrees with the rows."""
    paths = ingest_stream.StreamPaths.under(scratch_path(spark, "l6-out"))
    table, counts = ingest_stream.ingest(
        spark, StreamConfig(location=_topic(spark, sf_dir, "l6"), files=1), SCHEMA, paths)
    good = table.select(
        F.lit("valid").alias("outcome"), "event_id", "user_id", "event_type", "props",
        F.round(F.col("value").cast("double"), 6).alias("value"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    bad = spark.read.parquet(paths.rejected).select(
        F.lit("rejected").alias("outcome"), F.col("key").alias("user_id"))
    rows = good.unionByName(bad, allowMissingColumns=True)
    told = counts.agg(F.sum("valid").alias("valid"), F.sum("rejected").alias("rejected")).first()
    agree = told["valid"] == good.count() and told["rejected"] == bad.count()
    return rows.withColumn("counted", F.lit(int(agree)).cast("long"))


_EDA_AMOUNTS = ("total_patient_revenue", "medicaid_charges", "total_current_assets")
_EDA_YEAR = 1999


@query("l7_eda_report", with_(RAW + """,
located AS (
  SELECT f.*, r.rucc_2013 FROM filings f LEFT JOIN rurality r
    ON f.state_code = r.state AND upper(trim(f.county)) = trim(replace(upper(r.county_name), ' COUNTY', ''))),
flagged AS (
  SELECT *, CAST(EXISTS (SELECT 1 FROM closures c WHERE TRY_CAST(c.closure_year AS INTEGER) = """ + str(_EDA_YEAR) + """
      AND upper(trim(c.hospital_name)) = upper(trim(f.hospital_name))
      AND upper(trim(c.state)) = upper(trim(f.state_code))) AS INTEGER) AS is_closed,
    CASE WHEN total_patient_revenue <> 0 THEN
      (total_patient_revenue - less_total_operating_expense) / total_patient_revenue END AS margin
  FROM filings f)""", "\nUNION ALL ".join(
    [f"SELECT 'missing' AS section, '{c}' AS item, round(avg(({c} IS NULL)::INTEGER), 6) AS value FROM filings"
     for c in _EDA_AMOUNTS] + [
        "SELECT 'rurality', CAST(rucc_2013 AS VARCHAR), CAST(count(*) AS DOUBLE) FROM located GROUP BY 2",
        "SELECT 'match', 'unmatched', CAST(count(*) - count(rucc_2013) AS DOUBLE) FROM located",
        "SELECT 'rural', 'rows', CAST(count(*) AS DOUBLE) FROM located WHERE rucc_2013 >= 4",
        "SELECT 'closures', closure_year, CAST(count(*) AS DOUBLE) FROM closures GROUP BY 2",
        "SELECT 'closed', 'filings', CAST(sum(is_closed) AS DOUBLE) FROM flagged",
        "SELECT 'margin', CAST(is_closed AS VARCHAR), round(median(margin), 6) FROM flagged GROUP BY 2"])))
def eda_report(spark, sf_dir):
    filed = hand_over(filings(spark, sf_dir), "eda-filings")
    parts = eda.report(filed, rurality(spark, sf_dir), closures(spark, sf_dir), _EDA_YEAR,
                       _EDA_AMOUNTS)

    def section(name, item, value):
        return parts[name].select(
            F.lit(name).alias("section"), item.cast("string").alias("item"),
            r(value.cast("double")).alias("value"))

    sections = [
        section("missing", F.col("column_name"), F.col("null_rate")),
        section("rurality", F.col("rucc_2013"), F.col("count")),
        section("match", F.lit("unmatched"), F.col("unmatched")),
        section("rural", F.lit("rows"), F.col("rural")),
        section("closures", F.col("closure_year"), F.col("count")),
        section("closed", F.lit("filings"), F.col("closed")),
        section("margin", F.col("is_closed"), F.col("median_operating_margin")),
    ]
    whole = sections[0]
    for part in sections[1:]:
        whole = whole.unionByName(part)
    return whole
