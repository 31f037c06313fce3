"""Preparation, oversampling, neighbours, models, metrics and attributions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fiscora.functions.numeric import FEATURE_COLUMNS
from fiscora.ml import (
    boost, explain, forest, metrics, neighbors, oversample, prep, rounds, runs, score, train, trees)
from fiscora.plans import modeling
from fiscora.session import hand_over

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3)) * [1, 10, 0.1]
    y = (x[:, 0] + x[:, 1] / 10 + rng.normal(size=600) * 0.5 > 1.6).astype(int)
    return spark.createDataFrame(
        [(i, *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))],
        "id int, a double, b double, c double, y int").repartition(3).cache()


def test_temporal_split(spark):
    df = spark.createDataFrame([(y,) for y in (2010, 2011, 2018, 2019, 2020, 2021, 2022, 2023)], "y int")
    got = {r["y"]: r["split"] for r in prep.temporal_split(df, "y").collect()}
    assert got == {2011: "train", 2018: "train", 2019: "val", 2020: "val", 2021: "test", 2022: "test"}


def test_prepare_fits_on_train_only(spark):
    train_values = [float(i) for i in range(100)]
    data = [("train", v, v) for v in train_values] + [("train", None, None), ("test", 1e9, None)]
    df = spark.createDataFrame(data, "split string, current_ratio double, medicaid_pct double")
    got = prep.prepare(df, ["current_ratio", "medicaid_pct"]).collect()
    cap = np.quantile(train_values, 0.99)
    test = next(r for r in got if r["split"] == "test")
    assert test["current_ratio"] == pytest.approx(cap)
    assert test["medicaid_pct"] == pytest.approx(49.5)
    assert max(r["current_ratio"] for r in got) == pytest.approx(cap)
    assert all(r["medicaid_pct"] is not None for r in got)


def clumps():
    """A dense clump, far outliers and a grid with very many equal distances."""
    rng = np.random.default_rng(1)
    return np.vstack([rng.normal(size=(150, 3)) * 1e-3, rng.normal(size=(30, 3)) * 100,
                      np.array(list(itertools.product(range(5), repeat=3)), float)])


@pytest.mark.parametrize("cell_points,top,inner", [
    (8, 12, 11), (64, 12, 11), (10_000, 12, 11), (8, 2, 2), (4, 1, 3)])
def test_neighbors_match_brute_force(spark, monkeypatch, cell_points, top, inner):
    """Also with cells cut in many levels."""
    x = clumps()
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                   "id bigint, x array<double>")
    got = neighbors.nearest_neighbors(points, "id", "x", 3, 5, len(x), cell_points, visit_chunk=20,
                                      top_depth=top, inner_depth=inner)
    found = {}
    for r in got.collect():
        found.setdefault(r["id"], []).append((r["d2"], r["neighbor"]))
    for i, v in enumerate(x):
        d2 = sum((v[j] - x[:, j]) ** 2 for j in range(3))
        want = sorted((d2[j], j) for j in range(len(x)) if j != i)[:5]
        assert sorted(found[i]) == want


def test_cells_stay_small_and_few_pairs_are_compared(spark, monkeypatch):
    """A short top tree leaves crowded cells, which further levels cut."""
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(size=(3000, 4)) * 1e-3, rng.normal(size=(3000, 4))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    written = {}

    def keep(df, name):
        written.setdefault(name, []).append(hand_over(df, name))
        return written[name][-1]

    monkeypatch.setattr(neighbors, "hand_over", keep)
    near = neighbors.nearest_neighbors(points, "id", "x", 4, 5, len(x), cell_points=32,
                                       top_depth=3, inner_depth=3).toPandas()
    assert len(written["trees"]) >= 2
    sizes = written["cells"][-1].groupBy("cell").count().toPandas()
    assert sizes["count"].sum() == len(x) and sizes["count"].max() <= 64
    size_of = sizes.set_index("cell")["count"]
    visits = [v.select("cell").toPandas()["cell"] for v in written["visits"] if "first" not in v.columns]
    pairs = (size_of ** 2).sum() + sum(size_of.reindex(v).fillna(0).sum() for v in visits)
    assert pairs <= 0.1 * len(x) ** 2
    for i in range(0, len(x), 97):
        d2 = ((x[i] - x) ** 2).sum(axis=1)
        d2[i] = np.inf
        assert sorted(near[near["id"] == i]["neighbor"]) == sorted(np.argsort(d2)[:5])


def test_smote_balances_inside_the_class(rows):
    both = oversample.smote(rows, FEATURES, "y", cell_points=16).cache()
    counts = {r["y"]: r["count"] for r in both.groupBy("y").count().collect()}
    assert counts[0] == counts[1]
    minority = rows.filter("y = 1").toPandas()[FEATURES].to_numpy()
    made = oversample.synthetic_rows(rows, FEATURES, "y").toPandas()
    assert len(made) == counts[0] - len(minority)
    # Every new row lies on a segment between a real row and one of its 5 neighbours.
    d2 = ((minority[:, None] - minority[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    near = np.argsort(d2, axis=1)[:, :5]
    starts, ends = minority.repeat(5, axis=0), minority[near.ravel()]
    span = ends - starts
    for p in made[FEATURES].to_numpy():
        t = ((p - starts) * span).sum(axis=1) / (span ** 2).sum(axis=1)
        off = np.abs(starts + t[:, None] * span - p).max(axis=1)
        assert ((off < 1e-9) & (t >= -1e-9) & (t <= 1 + 1e-9)).any()
    again = oversample.synthetic_rows(rows.repartition(5), FEATURES, "y").toPandas()
    order = made.sort_values(FEATURES).reset_index(drop=True)
    assert order.equals(again.sort_values(FEATURES).reset_index(drop=True))


def test_smote_with_equal_rows_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(oversample, "DRAW_CHUNK", 7)
    # One vector holds most of the class: its rows are each other's neighbours.
    data = [(0.0, 0.0, 1)] * 20 + [(float(i), 1.0, 1) for i in range(1, 5)] + [
        (float(i), -1.0, 0) for i in range(200)]
    df = spark.createDataFrame(data, "a double, b double, y int")
    made = oversample.synthetic_rows(df, ["a", "b"], "y").toPandas()
    assert len(made) == 200 - 24
    from_clump = made[(made.a == 0) & (made.b == 0)]
    assert 20 * 7 <= len(from_clump) <= 20 * 8 + 30
    with pytest.raises(ValueError, match="too few"):
        oversample.synthetic_rows(df.filter("y = 0 OR b = 1"), ["a", "b"], "y")
    with pytest.raises(ValueError, match="missing"):
        oversample.synthetic_rows(df.withColumn("a", F.nullif("a", F.lit(3.0))), ["a", "b"], "y")


def ranking(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    ap, hits, seen, last = 0.0, 0, 0, 0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        hits += sum(y for t, y in pairs if t == s)
        seen += sum(1 for t, _ in pairs if t == s)
        ap += (hits - last) / len(pos) * hits / seen
        last = hits
    return auc, ap


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(2)
    pairs = [(round(float(s), 2), int(y)) for s, y in zip(rng.random(300), rng.random(300) < 0.3)]
    pairs += [(0.5, i % 2) for i in range(150)]
    df = spark.createDataFrame(pairs, "s double, y int")
    auc, ap = ranking(pairs)
    assert metrics.roc_auc(df, "s", "y").first()[0] == pytest.approx(auc, rel=1e-12)
    assert metrics.average_precision(df, "s", "y").first()[0] == pytest.approx(ap, rel=1e-12)
    one_class = df.filter("y = 0")
    assert metrics.roc_auc(one_class, "s", "y").first()[0] is None
    assert metrics.average_precision(one_class, "s", "y").first()[0] is None
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    check = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0)
    assert check.evaluate(df.withColumn("y", F.col("y").cast("double"))) == pytest.approx(auc)


def test_report_and_fairness(spark):
    data = ([("Micropolitan", 0.9, 1)] * 2 + [("Micropolitan", 0.1, 1), ("Micropolitan", 0.5, 0)]
            + [("Small Town", 0.2, 0)] * 3 + [("Remote Rural", 0.7, 1)] + [("Metro", 0.9, 1)])
    df = spark.createDataFrame(data, "tier string, s double, y int").withColumn(
        "p", (F.col("s") >= 0.4).cast("int"))
    fair = {r["tier"]: r for r in metrics.fairness_by_group(df, "tier", "s", "p", "y").collect()}
    assert set(fair) == {"Micropolitan", "Small Town", "Remote Rural"}
    assert fair["Micropolitan"]["recall"] == pytest.approx(2 / 3)
    assert fair["Micropolitan"]["fpr"] == 1.0
    assert fair["Micropolitan"]["average_precision"] == pytest.approx(2 / 3 + (1 / 3) * 3 / 4)
    assert fair["Small Town"]["recall"] is None and fair["Small Town"]["fpr"] == 0.0
    assert fair["Remote Rural"]["average_precision"] is None
    assert fair["Remote Rural"]["fpr"] is None
    report = {r["class_name"]: r for r in metrics.classification_report(df, "p", "y").collect()}
    assert report["Distress"]["precision"] == pytest.approx(0.8)
    assert report["Stable"]["recall"] == pytest.approx(0.75)
    assert report["accuracy"]["f1"] == pytest.approx(7 / 9)
    assert report["weighted avg"]["recall"] == pytest.approx(7 / 9)
    never = metrics.classification_report(df.withColumn("p", F.lit(0)), "p", "y")
    assert {r["class_name"]: r["precision"] for r in never.collect()}["Distress"] == 0.0


def subset_value(tree, x, known, node=0):
    """The tree's value if only the ``known`` features of a row are."""
    if tree.left[node] < 0:
        return tree.value[node]
    f, children = tree.feature[node], (tree.left[node], tree.right[node])
    if f in known:
        return subset_value(tree, x, known, children[int(x[f] > tree.threshold[node])])
    return sum(tree.cover[c] / tree.cover[node] * subset_value(tree, x, known, c) for c in children)


def shapley(tree, x):
    d = len(x)
    return [sum(math.factorial(n) * math.factorial(d - 1 - n) / math.factorial(d)
                * (subset_value(tree, x, {*s, i}) - subset_value(tree, x, set(s)))
                for n in range(d) for s in itertools.combinations([j for j in range(d) if j != i], n))
            for i in range(d)]


def random_tree(rng, depth, width, rows=300):
    """A tree that may split on a feature again and again along a path."""
    x = rng.normal(size=(rows, width))
    nodes = []

    def grow(own, left):
        at = len(nodes)
        nodes.append([0, np.nan, -1, -1, rng.normal(), len(own)])
        f = int(rng.integers(width))
        limit = float(rng.choice(own[:, f]))
        low = own[:, f] <= limit
        if left and 0 < low.sum() < len(own):
            nodes[at][:2] = f, limit
            nodes[at][2] = grow(own[low], left - 1)
            nodes[at][3] = grow(own[~low], left - 1)
        return at
    grow(x, depth)
    return trees.Tree(*map(np.array, zip(*nodes)))


@pytest.mark.parametrize("bits", [9, 3, 0])
@pytest.mark.parametrize("depth, width", [(0, 2), (1, 2), (4, 3), (7, 5)])
def test_tree_attributions_against_all_subsets(monkeypatch, bits, depth, width):
    monkeypatch.setattr(trees, "TABLE_BITS", bits)
    monkeypatch.setattr(trees, "TABLE_ENTRIES", 8)
    monkeypatch.setattr(trees, "ROWS", 5)
    rng = np.random.default_rng(depth)
    ensemble = [random_tree(rng, depth, width) for _ in range(2)]
    x = rng.normal(size=(12, width))
    got = trees.attributions(x, ensemble)
    want = np.sum([[shapley(t, row) for row in x] for t in ensemble], axis=0)
    assert np.allclose(got, want, atol=1e-9)
    assert np.allclose(got.sum(axis=1) + sum(t.mean() for t in ensemble), trees.margins(x, ensemble))


def test_boosted_attributions_add_up(rows):
    model = train.train_boosted(rows, FEATURES, "y", rounds=6, depth=4)
    phi = explain.shap_values(model, rows, FEATURES, ["id"]).toPandas().sort_values("id")
    raw = boost.boosted_margin(model, rows, ["id"]).toPandas().sort_values("id")
    total = phi["base_value"] + phi[[f"phi_{f}" for f in FEATURES]].sum(axis=1)
    assert np.allclose(total.to_numpy(), raw["margin"].to_numpy(), atol=1e-9)
    # The base value is the mean margin of the trained rows.
    assert phi["base_value"].iloc[0] == pytest.approx(raw["margin"].mean())
    with pytest.raises(ValueError):
        explain.shap_values(model, rows, FEATURES[::-1], ["id"])


def plain_boosting(x, y, weight, cuts, rounds, rate, depth):
    """Newton boosting by trying every limit on every node; the margins after each round."""
    margin, out = np.zeros(len(y)), []

    def grow(own, left):
        p = 1 / (1 + np.exp(-margin[own]))
        g, h = weight[own] * (p - y[own]), weight[own] * p * (1 - p)
        best, gain = None, 1e-9
        for f in range(x.shape[1]) if left else ():
            for limit in cuts[f]:
                low = x[own, f] <= limit
                if h[low].sum() < 1 or h[~low].sum() < 1:
                    continue
                got = (g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1)
                       - g.sum() ** 2 / (h.sum() + 1))
                if got > gain + 1e-12:
                    best, gain = low, got
        if best is None:
            step[own] = -rate * g.sum() / (h.sum() + 1)
        else:
            grow(own[best], left - 1)
            grow(own[~best], left - 1)
    for _ in range(rounds):
        step = np.zeros(len(y))
        grow(np.arange(len(y)), depth)
        margin = margin + step
        out.append(margin)
    return np.array(out).T


@pytest.mark.parametrize("task_rows, block_rows, every", [(1 << 17, 1 << 16, 20), (1 << 17, 50, 20), (50, 20, 2)])
def test_boosting_against_a_plain_version(rows, monkeypatch, task_rows, block_rows, every):
    for name, value in (("TASK_ROWS", task_rows), ("BLOCK_ROWS", block_rows), ("WRITE_EVERY", every)):
        monkeypatch.setattr(boost, name, value)
    model = train.train_boosted(rows, FEATURES, "y", rounds=5, depth=3, rate=0.3)
    pdf = rows.orderBy("id").toPandas()
    y = pdf["y"].to_numpy()
    weight = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    want = plain_boosting(pdf[FEATURES].to_numpy(), y, weight, boost._cuts(rows, FEATURES, 64), 5, 0.3, 3)
    got = boost.staged_margins(model, rows, ["id"]).orderBy("id").toPandas()["margins"]
    assert np.allclose(np.stack(got.to_list()), want, atol=1e-9)


def test_boosting_on_odd_tables(rows):
    none = boost.fit_boosted(rows.limit(0), FEATURES, "y", rounds=3)
    assert none.trees == () and score.probability(none, rows, ["id"]).filter("probability <> 0.5").count() == 0
    one = boost.fit_boosted(rows.filter("y = 1"), FEATURES, "y", rounds=3)
    assert score.probability(one, rows, ["id"]).filter("probability <= 0.5").count() == 0
    same = boost.fit_boosted(rows.withColumns({f: F.lit(1.0) for f in FEATURES}), FEATURES, "y", rounds=2)
    assert all(len(t.value) == 1 for t in same.trees)
    with pytest.raises(ValueError):
        boost.fit_boosted(rows.withColumn("a", F.when(F.col("id") > 3, F.col("a"))), FEATURES, "y", rounds=1)


def plain_tree(bins, y, weight, depth):
    """Leaf shares of positives of one Gini tree on all rows and columns."""
    p = np.average(y, weights=weight)
    best = (1e-12 * weight.sum(), None)
    if depth and 0 < p < 1:
        whole = weight.sum() * (p ** 2 + (1 - p) ** 2)
        for f in range(bins.shape[1]):
            for b in range(bins[:, f].max()):
                low = bins[:, f] <= b
                if low.any() and not low.all():
                    gain = -whole
                    for side in (low, ~low):
                        q = np.average(y[side], weights=weight[side])
                        gain += weight[side].sum() * (q ** 2 + (1 - q) ** 2)
                    if gain > best[0] + 1e-9:
                        best = (gain, low)
    out = np.full(len(y), p)
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = plain_tree(bins[side], y[side], weight[side], depth - 1)
    return out


def test_one_tree_of_a_forest_against_a_plain_version(rows):
    model = train.train_forest(rows, FEATURES, "y", trees=1, depth=3)
    pdf = rows.orderBy("id").toPandas()
    y = pdf["y"].to_numpy()
    cuts = boost._cuts(rows, FEATURES, 64)
    bins = np.stack([np.searchsorted(c, pdf[f]) for c, f in zip(cuts, FEATURES)], axis=1)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    got = score.probability(model, rows, ["id"]).orderBy("id").toPandas()["probability"]
    assert np.allclose(got, plain_tree(bins, y, weight, 3), atol=1e-9)


def test_forest_grows_in_groups_of_bounded_size(rows, monkeypatch, tmp_path):
    """Trees do not depend on which others are grown with them, and are kept as they are."""
    whole = train.train_forest(rows, FEATURES, "y", trees=4, depth=4)
    monkeypatch.setattr(forest, "GROUP_CELLS", 1)
    monkeypatch.setattr(forest, "STRETCH", 2)
    alone = train.train_forest(rows, FEATURES, "y", trees=4, depth=4)
    train.save_model(alone, str(tmp_path / "f"))
    again = train.load_model(str(tmp_path / "f"))
    assert len({t.value.tobytes() for t in whole.trees}) == 4
    for a, b, c in zip(whole.trees, alone.trees, again.trees):
        for name in ("feature", "threshold", "left", "right", "value", "cover"):
            assert np.array_equal(getattr(a, name), getattr(b, name), equal_nan=True)
            assert np.array_equal(getattr(a, name), getattr(c, name), equal_nan=True)


def test_forest_on_odd_tables(rows):
    none = train.train_forest(rows.limit(0), FEATURES, "y", trees=3)
    assert none.trees == ()
    one = train.train_forest(rows.filter("y = 1"), FEATURES, "y", trees=3)
    assert score.probability(one, rows, ["id"]).filter("abs(probability - 1) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        train.train_forest(rows.withColumn("y", F.when(F.col("id") > 3, F.col("y"))), FEATURES, "y", trees=1)


def test_forest_and_linear_attributions_add_up(rows):
    forest = train.train_forest(rows, FEATURES, "y", trees=5, depth=5)
    phi = explain.shap_values(forest, rows, FEATURES, ["id"]).toPandas().set_index("id")
    p = score.probability(forest, rows, ["id"]).toPandas().set_index("id")["probability"]
    total = phi["base_value"] + phi[[f"phi_{f}" for f in FEATURES]].sum(axis=1)
    assert np.allclose(total.sort_index(), p.sort_index(), atol=1e-9)
    linear = train.train_logistic(rows, FEATURES, "y")
    phi = explain.shap_values(linear, rows, FEATURES, ["id"], background=rows).toPandas().set_index("id")
    p = score.probability(linear, rows, ["id"]).toPandas().set_index("id")["probability"]
    total = phi["base_value"] + phi[[f"phi_{f}" for f in FEATURES]].sum(axis=1)
    assert np.allclose(total.sort_index(), np.log(p / (1 - p)).sort_index(), atol=1e-8)


def test_waterfall_ends_at_the_score(spark):
    wide = spark.createDataFrame([(1, 0.5, 0.1, -0.4, 0.2)],
                                 "id int, base_value double, phi_a double, phi_b double, phi_c double")
    long = explain.shap_long(wide, FEATURES, ["id"])
    steps = explain.shap_waterfall(long, ["id"]).orderBy("position").collect()
    assert [s["feature"] for s in steps] == ["b", "c", "a"]
    assert steps[0]["end_value"] == pytest.approx(0.4) and steps[-1]["start_value"] == 0.5
    assert [s["feature"] for s in explain.shap_summary(long).collect()] == ["b", "c", "a"]


def test_logistic_equals_penalised_optimum(rows):
    """At the optimum the gradient of the balanced, penalised loss vanishes."""
    model = train.train_logistic(rows, FEATURES, "y")
    pdf = rows.toPandas()
    x = pdf[FEATURES].to_numpy() / pdf[FEATURES].to_numpy().std(axis=0)
    y = pdf["y"].to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    beta = model.stages[-1].coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ beta + model.stages[-1].intercept)))
    gradient = x.T @ (w * (p - y)) + beta
    assert np.abs(gradient).max() < 0.05 and abs((w * (p - y)).sum()) < 0.05


def test_save_load_watch_and_score(rows, tmp_path):
    model = train.train_boosted(rows, FEATURES, "y", rounds=5, depth=2)
    train.save_model(model, str(tmp_path / "m"))
    again = train.load_model(str(tmp_path / "m"))
    first = score.score_batch(model, rows, ["id"]).orderBy("id").collect()
    assert first == score.score_batch(again, rows, ["id"]).orderBy("id").collect()
    assert all(round(r["risk_score"], 4) == r["risk_score"] for r in first)
    assert {r["risk_tier"] for r in first} <= {"HIGH", "ELEVATED", "LOW"}
    losses = train.watch_boosted(model, rows, "y")
    assert len(losses) == 5 and losses[-1] < losses[0]


def test_saved_scorer_treats_raw_rows_as_in_training(spark, rows, tmp_path):
    gaps = rows.withColumns({"b": F.when(F.col("id") % 7 != 0, F.col("b")),
                             "a": F.when(F.col("id") == 3, 1e9).otherwise(F.col("a"))})
    fitted = prep.Preparation.fit(gaps, FEATURES, ["a"], "id % 2 = 0")
    even = gaps.filter("id % 2 = 0").toPandas()
    assert fitted.caps["a"] == pytest.approx(np.quantile(even["a"], 0.99))
    assert fitted.medians["b"] == pytest.approx(even["b"].median())
    ready = fitted.apply(gaps)
    model = train.train_logistic(ready, FEATURES, "y")
    path = str(tmp_path / "scorer")
    score.save_scorer(spark, model, fitted, path)
    assert prep.Preparation.load(spark, path + "/preparation") == fitted
    got = score.score_saved(spark, path, gaps, ["id"]).orderBy("id").collect()
    assert got == score.score_batch(model, ready, ["id"]).orderBy("id").collect()
    assert len(got) == rows.count() and all(r["risk_score"] is not None for r in got)


def test_preparation_without_values(spark, tmp_path):
    """A column without any value has no median: rows stay as they are."""
    empty = spark.createDataFrame([(None, None)], "current_ratio double, a double")
    fitted = prep.Preparation.fit(empty, ["a"], ["current_ratio"])
    assert fitted.caps == {"current_ratio": None} and fitted.medians == {"a": None}
    assert fitted.apply(empty).collect() == empty.collect()
    fitted.save(spark, str(tmp_path / "p"))
    assert prep.Preparation.load(spark, str(tmp_path / "p")) == fitted


def test_metrics_per_round(spark, rows):
    """Each round ranks as a model of so many rounds does."""
    model = train.train_boosted(rows, FEATURES, "y", rounds=6, depth=2)
    got = {r["round"]: r for r in rounds.metrics_per_round(model, rows, "y").collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6]
    for n in (1, 3, 6):
        short = train.train_boosted(rows, FEATURES, "y", rounds=n, depth=2)
        want = metrics.ranking_metrics(
            score.probability(short, rows, ["y"]), "probability", "y").first()
        assert got[n]["average_precision"] == pytest.approx(want["average_precision"])
        assert got[n]["roc_auc"] == pytest.approx(want["roc_auc"])


def test_validate_input(spark):
    good = {f: "0.1" for f in FEATURE_COLUMNS}
    data = [good, {**good, "total_margin": None}, {**good, "current_ratio": "much"},
            {**good, "cost_to_revenue": "9"}]
    df = spark.createDataFrame([tuple(r[f] for f in FEATURE_COLUMNS) for r in data],
                               ", ".join(f"{f} string" for f in FEATURE_COLUMNS))
    valid, rejected = score.validate_input(df)
    assert valid.count() == 2 and dict(valid.dtypes)["total_margin"] == "double"
    assert {r["reasons"][0] for r in rejected.collect()} == {
        "total_margin: missing", "current_ratio: not a number"}
    strict, out = score.validate_input(df, domain=score.FEATURE_DOMAIN)
    assert strict.count() == 0 and out.count() == 4
    lacking, rejected = score.validate_input(df.drop("total_margin"))
    assert lacking.count() == 0 and rejected.count() == 4


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs.log_run(spark, path, "m", {"depth": 3}, {"auc": 0.5})
    run = runs.log_run(spark, path, "m", {"depth": 5}, {"auc": 0.7})
    runs.log_metrics(spark.createDataFrame([(0.9,)], "test_auc double"), path, "m", run)
    got = {r["key"]: r["value"] for r in runs.latest_values(runs.read_runs(spark, path)).collect()}
    assert got == {"depth": "5", "auc": "0.7", "test_auc": "0.9"}


def test_study_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = []
    for i in range(420):
        x = rng.normal(size=10)
        data.append((i // 12 % 9 + 1, f"h{i}", 2011 + i % 12, *map(float, x),
                     int(x[0] + rng.normal() * 0.4 > 1.1)))
    schema = "geo_id int, ccn_key string, fiscal_year int, " + ", ".join(
        f"{f} double" for f in FEATURE_COLUMNS) + ", distress_label int"
    fact = spark.createDataFrame(data, schema).withColumn(
        "current_ratio", F.when(F.col("geo_id") != 3, F.col("current_ratio")))
    geography = spark.createDataFrame(
        [(i, ["Micropolitan", "Small Town", "Remote Rural"][i % 3], "AL") for i in range(1, 10)],
        "geo_id int, rural_level string, state_code string")
    out = modeling.run(spark, fact, geography, str(tmp_path / "runs"), settings={
        "RandomForest": {"trees": 5, "depth": 3}, "BoostedTrees": {"rounds": 3, "depth": 2}})
    assert {r["model"] for r in out.comparison.collect()} == {
        "LogisticRegression", "RandomForest", "BoostedTrees"}
    assert out.test_metrics.first()["test_roc_auc"] > 0.6
    assert out.report.count() == 5 and out.fairness.count() == 3
    assert out.importance.first()["feature"] == "operating_margin"
    steps = out.waterfall.orderBy("position").collect()
    assert len(steps) == 10 and len({s["ccn_key"] for s in steps}) == 1
    assert {r["split"]: r["rows"] for r in out.splits.collect()} == {
        "train": 280, "val": 70, "test": 70}
    assert [r["round"] for r in out.rounds.orderBy("round").collect()] == [1, 2, 3]
    raw = modeling.model_rows(fact, geography)
    assert raw.filter("current_ratio IS NULL").count() > 0
    assert score.score_saved(spark, out.paths[out.best], raw, ["ccn_key"]).filter(
        "risk_score IS NULL").count() == 0
    logged = runs.latest_values(runs.read_runs(spark, str(tmp_path / "runs")))
    assert {"test_roc_auc", "val_pr_auc"} <= {
        r["key"] for r in logged.filter(F.col("name") == out.best).collect()}


def test_rows_go_on_from_the_level_before():
    """Nodes found level by level are those found from the root, also for rows in early leaves."""
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 4, (2, 200)).astype(np.uint8)
    block = boost._Block.at(bins, rng.integers(0, 2, 200).astype(np.uint8), np.ones(200), np.zeros(200))
    tree = boost._Growing.of(3)
    for node, f, b in ((0, 0, 1), (1, 1, 2), (4, 1, 0)):
        tree.feature[node], tree.bin[node] = f, b
        assert np.array_equal(block.placed(tree), tree.place(bins))
        assert np.array_equal(block.places["last"], tree.place(bins))
    assert set(block.places["last"]) <= {2, 3, 4, 9, 10}


def test_the_heavier_child_is_never_added_up():
    """Each split's lighter child is counted, its sibling is what the parent has besides."""
    rng = np.random.default_rng(2)
    bins, y = rng.integers(0, 8, (3, 3000)).astype(np.uint8), rng.integers(0, 2, 3000).astype(np.uint8)
    block = boost._Block.at(bins, y, np.where(y == 1, 1.5, 1.0), rng.normal(size=3000))
    seen, whole = [], []

    class Watched:
        def histograms(self, size, tree, nodes):
            seen.append(nodes.tolist())
            level = range((1 << len(seen) - 1) - 1, (1 << len(seen)) - 1)
            at, (g, h) = tree.place(bins), block.slopes(slice(None))
            whole.append(np.array([[[np.bincount(c[at == k], s[at == k], 8) for k in level] for c in bins] for s in (g, h)]))
            return block.histograms(size, tree, nodes)

    made = []
    split = boost._split
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(boost, "_split", lambda sums, *rest: (made.append(sums.copy()), split(sums, *rest)))
        boost._grow(lambda of: of(Watched()), 8, 3, 0.1)
    assert [len(nodes) for nodes in seen] == [1, 1, 2]
    for got, want, nodes in zip(made, whole, seen):
        assert np.allclose(got, want, atol=1e-9)
        for k in nodes[:len(nodes) * (len(seen) > 1)]:
            if k:
                first = want.shape[2] - 1
                hessian = want[1, 0].sum(axis=1)
                assert hessian[k - first] <= hessian[(k - 1 ^ 1) + 1 - first] + 1e-9


@pytest.mark.parametrize("depth, limits", [(3, 5), (9, 5), (3, 400), (9, 400)])
def test_leaves_by_limits_are_those_by_values(depth, limits):
    """Small and large trees, few and many limits, values at limits and gaps."""
    rng = np.random.default_rng(depth + limits)
    grid = np.sort(rng.normal(size=limits))

    def grow(nodes, level):
        k = len(nodes)
        nodes.append([-1, np.nan, -1, -1])
        if level and (level > 1 or rng.random() < 0.7):
            nodes[k][:2] = int(rng.integers(0, 3)), grid[rng.integers(0, limits)]
            nodes[k][2] = grow(nodes, level - 1)
            nodes[k][3] = grow(nodes, level - 1)
        return k

    made = []
    for _ in range(4):
        nodes: list = []
        grow(nodes, depth)
        f, limit, left, right = (np.array(c) for c in zip(*nodes))
        made.append(trees.Tree(f, limit, left, right, rng.random(len(f)), np.ones(len(f))))
    made.append(trees.Tree(*(np.array([v]) for v in (-1, np.nan, -1, -1, 2.0, 1.0))))
    x = np.where(rng.random((500, 3)) < 0.5, rng.choice(grid, (500, 3)), rng.normal(size=(500, 3)))
    x[::50, 1] = np.nan
    for tree, at in zip(made, trees.Places(made).leaves(x)):
        assert np.array_equal(at, tree.place(x))
    assert np.array_equal(trees.margins(x, made), sum(t.value[t.place(x)] for t in made))


def test_forest_shared_out_by_trees_is_the_one_grown_by_levels(rows, monkeypatch):
    alone = train.train_forest(rows, FEATURES, "y", trees=5, depth=4)
    monkeypatch.setattr(forest, "ALONE_ROWS", 0)
    monkeypatch.setattr(forest, "GROUP_CELLS", 1 << 12)
    together = train.train_forest(rows, FEATURES, "y", trees=5, depth=4)
    assert len(alone.trees) == 5
    for a, b in zip(alone.trees, together.trees):
        for name in ("feature", "threshold", "left", "right", "value", "cover"):
            assert np.array_equal(getattr(a, name), getattr(b, name), equal_nan=True)
