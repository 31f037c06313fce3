"""Keys, running sums, quantiles and lags against brute force, with hot groups."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fiscora.operators import aggregates, ordered, windows
from fiscora.session import hand_over


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one key, another third one value."""
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        value = 1.0 if i % 3 == 1 else round(rng.lognormvariate(0, 3), 3)
        rows.append((i, key, value, rng.randrange(2)))
    rows += [(6000, None, 2.0, 1), (6001, None, None, 0), (6002, "k1", float("nan"), 1)]
    return spark.createDataFrame(rows, "id int, key string, value double, label int").repartition(7)


def test_surrogate_key_is_dense_over_many_partitions(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        keyed = ordered.surrogate_key(skewed.select("id", "key"), ["key", "id"], "sk")
        got = keyed.orderBy("sk").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r["sk"] for r in got] == list(range(1, 6004))
    want = sorted(((r["key"] is not None, r["key"] or "", r["id"]) for r in got))
    assert [(r["key"] is not None, r["key"] or "", r["id"]) for r in got] == want
    assert keyed.columns == ["id", "key", "sk"]


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(skewed, descending):
    rows = skewed.filter("value IS NOT NULL AND NOT isnan(value)")
    got = ordered.running_sums(rows, "value", {"n": F.count("*"), "s": F.sum("label")}, ["key"],
                               descending, bits=4).toPandas()
    pdf = rows.toPandas().fillna({"key": "<null>"})
    want = pdf.groupby(["key", "value"]).agg(n=("id", "size"), s=("label", "sum")).reset_index()
    want = want.sort_values("value", ascending=not descending)
    for c in ("n", "s"):
        want[f"{c}_before"] = want.groupby("key")[c].cumsum() - want[c]
    order = ["key", "value"]
    got = got.fillna({"key": "<null>"}).sort_values(order).reset_index(drop=True)
    want = want.sort_values(order).reset_index(drop=True)[got.columns]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.fixture
def many_ranges(spark):
    """Small partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.99, 1.0])
def test_exact_quantile(many_ranges, skewed, q):
    pdf = skewed.toPandas()
    whole = ordered.exact_quantile(skewed, ["value", "label"], q).collect()
    for r in whole:
        assert r["value"] == pytest.approx(np.nanquantile(pdf[r["column_name"]], q), rel=1e-12)
    assert {r["column_name"]: r["n"] for r in whole} == {"value": 6001, "label": 6003}
    grouped = ordered.exact_quantile(skewed, ["value"], q, by=["key"]).collect()
    want = pdf.fillna({"key": "<null>"}).dropna(subset=["value"]).groupby("key")["value"].quantile(q)
    assert len(grouped) == len(want)
    for r in grouped:
        assert r["value"] == pytest.approx(want[r["key"] or "<null>"], rel=1e-12)


def test_quantile_reads_its_input_once_and_splits_a_hot_group(spark, many_ranges, monkeypatch):
    """One group has nearly all rows: many tasks order it, and every input row is seen once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(0, 40_000, 1, 6).select(
        F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    written = []
    monkeypatch.setattr(ordered, "hand_over", lambda d, name: written.append(hand_over(d, name)) or written[-1])
    got = {r["k"]: r["value"] for r in ordered.exact_quantile(
        df.mapInPandas(count, df.schema), ["v"], 0.5, by=["k"]).collect()}
    assert seen.value == 40_000
    assert got == df.toPandas().groupby("k")["v"].median().to_dict()
    sizes = [r["count"] for r in written[0].groupBy("_range").count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * np.median(sizes)


def test_quantile_of_nothing(spark):
    none = spark.createDataFrame([], "k string, v double")
    assert ordered.exact_quantile(none, ["v"], 0.5, by=["k"], keep_empty=True).count() == 0
    assert aggregates.fit_median(none, ["v"]).first()["v"] is None
    gaps = spark.createDataFrame([(None, None), (None, float("nan")), ("a", -0.0), ("a", 0.0)], "k string, v double")
    kept = ordered.exact_quantile(gaps, ["v"], 0.5, by=["k"], keep_empty=True).collect()
    assert {r["k"]: (r["n"], r["value"]) for r in kept} == {None: (0, None), "a": (2, 0.0)}


def test_median_element_and_empty_groups(spark):
    df = spark.createDataFrame([("a", float(i)) for i in (1, 2, 3, 4)] + [("b", None)],
                               "k string, v double")
    fitted = aggregates.fit_median(df, ["v"], method="element").first()
    assert fitted["v"] == 2.0
    assert aggregates.fit_median(df, ["v"]).first()["v"] == 2.5
    assert aggregates.fit_median(df, ["v"], where="v > 2").first()["v"] == 3.5
    medians = {r["k"]: r["median_v"] for r in aggregates.median_by(df, ["k"], "v").collect()}
    assert medians == {"a": 2.5, "b": None}
    nothing = aggregates.fit_median(df.filter("k = 'b'"), ["v"]).first()
    assert nothing["v"] is None


@pytest.mark.parametrize("n", [1, 2, 3])
def test_lag_within_hot_key(skewed, n):
    got = ordered.lag_within(skewed.select("id", "key", "label"), "key", "id", "label", "before",
                             n=n, bits=3).toPandas().fillna({"key": "<null>"})
    pdf = skewed.select("id", "key", "label").toPandas().fillna({"key": "<null>"}).sort_values("id")
    pdf["before"] = pdf.groupby("key")["label"].shift(n)
    merged = got.merge(pdf, on="id")
    assert len(merged) == len(pdf)
    pd.testing.assert_series_equal(merged["before_x"], merged["before_y"], check_names=False,
                                   check_dtype=False)


@pytest.mark.parametrize("n", [1, 2])
def test_lag_within_one_time_of_a_hot_key(spark, monkeypatch, n):
    """A key with half of all rows has a third of them at one time, which only the tie-breaks order."""
    rng = random.Random(8)
    rows = [("hot" if i % 2 else f"k{rng.randrange(9)}", 500 if i % 3 == 0 else rng.randrange(1000),
             f"t{rng.randrange(50):02d}", i) for i in range(8000)]
    df = spark.createDataFrame(rows, "key string, at int, tie string, id int").repartition(5)
    written = []
    monkeypatch.setattr(ordered, "hand_over", lambda d, name: written.append(hand_over(d, name)) or written[-1])
    got = ordered.lag_within(df, "key", "at", "id", "before", n=n, tie_breaks=("tie", "id"), bits=4).toPandas()
    pdf = df.toPandas().sort_values(["at", "tie", "id"])
    pdf["before"] = pdf.groupby("key")["id"].shift(n)
    merged = got.merge(pdf, on="id")
    assert len(merged) == 8000
    pd.testing.assert_series_equal(merged["before_x"], merged["before_y"], check_names=False, check_dtype=False)
    sizes = [r["count"] for r in written[0].groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * np.median(sizes)


def test_dedup_prunes_before_the_shuffle(spark, skewed):
    best = windows.dedup_best(skewed, ["key"], ["value"], ["label", "id"])
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    pdf = skewed.toPandas().fillna({"key": "<null>"})
    # A NaN amount is a value like any other here, NULL is not.
    assert best.count() == pdf["key"].nunique()


def test_verify_unique(skewed):
    got = windows.verify_unique(skewed, ["key"]).first()
    assert got["rows"] == 6003 and got["distinct_keys"] + got["surplus_rows"] == 6003


def test_quantile_keeps_only_values_near_the_rank(spark, monkeypatch):
    """Values away from the rank are counted, not kept; a wrong guess does not change the result."""
    df = spark.range(0, 20_000, 1, 4).select(F.col("id").cast("double").alias("v"))
    near = ordered._near_rank(df, ["v"], 0.5)
    assert near.count() < 200 and near.agg(F.sum("_c")).first()[0] == 20_000
    monkeypatch.setattr(ordered, "GUESS_ROWS", 200)
    monkeypatch.setattr(ordered, "GUESS_SLACK", -33 / 20_000)     # no room at all
    assert ordered.exact_quantile(df, ["v"], 0.5).first()["value"] == pytest.approx(9999.5)
