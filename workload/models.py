"""Queries on model preparation, training, metrics, explanation and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fiscora.functions import numeric
from fiscora.ml import explain, metrics, neighbors, oversample, prep, rounds, runs, score, train
from fiscora.ml.boost import BoostedModel
from fiscora.ml.trees import Tree
from fiscora.operators import aggregates, windows
from fiscora.session import hand_over, scratch_path
from workload.binding import RATED, YEARS, rated_accounts, rounded_sql, with_
from workload.registry import query, r, rounded, table

FEATURES = numeric.FEATURE_COLUMNS
LABEL = "distress_label"
KEY = ("ccn_key", "fiscal_year")

SPLIT_SQL = RATED + """,
split AS (
  SELECT *, CASE WHEN fiscal_year <= 1998 THEN 'train' WHEN fiscal_year = 1999 THEN 'val'
                 ELSE 'test' END AS split FROM rated)"""
CAPPED_SQL = SPLIT_SQL + """,
caps AS (SELECT quantile_cont(medicaid_pct, 0.99) AS c1, quantile_cont(current_ratio, 0.99) AS c2
         FROM split WHERE split = 'train'),
capped AS (
  SELECT * REPLACE (CASE WHEN medicaid_pct > c1 THEN c1 ELSE medicaid_pct END AS medicaid_pct,
                    CASE WHEN current_ratio > c2 THEN c2 ELSE current_ratio END AS current_ratio)
  FROM split CROSS JOIN caps)"""
READY_SQL = CAPPED_SQL + f""",
medians AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in FEATURES)} FROM capped WHERE split = 'train'),
ready AS (
  SELECT ccn_key, fiscal_year, distress_label, rural_level, split,
         {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in FEATURES)}
  FROM capped CROSS JOIN medians)"""


def split_rows(spark, sf_dir):
    return prep.temporal_split(rated_accounts(spark, sf_dir), "fiscal_year", **YEARS)


def ready_rows(spark, sf_dir):
    return prep.prepare(hand_over(split_rows(spark, sf_dir), "split"))


def train_rows(spark, sf_dir):
    return ready_rows(spark, sf_dir).filter(F.col("split") == "train")


@query("m1_temporal_split", with_(SPLIT_SQL, "SELECT ccn_key, fiscal_year, split FROM split"))
def temporal_split(spark, sf_dir):
    return split_rows(spark, sf_dir).select(*KEY, "split")


@query("m2_winsorize_fit_apply", with_(CAPPED_SQL, f"""
SELECT ccn_key, fiscal_year, {rounded_sql(prep.WINSORIZED)} FROM capped"""))
def winsorize(spark, sf_dir):
    rows = hand_over(split_rows(spark, sf_dir), "split")
    caps = prep.winsorize_fit(rows, prep.WINSORIZED, "split = 'train'")
    return rounded(prep.winsorize_apply(rows, caps, prep.WINSORIZED), prep.WINSORIZED).select(
        *KEY, *prep.WINSORIZED)


@query("m3_impute_fit_apply", with_(READY_SQL, f"""
SELECT ccn_key, fiscal_year, split, {rounded_sql(FEATURES)} FROM ready"""))
def impute(spark, sf_dir):
    return rounded(ready_rows(spark, sf_dir), FEATURES).select(*KEY, "split", *FEATURES)


@query("m3_impute_by_group", with_(SPLIT_SQL, """,
g AS (SELECT rural_level, median(current_ratio) AS mg FROM split WHERE split = 'train' GROUP BY 1)
SELECT ccn_key, fiscal_year, round(coalesce(current_ratio, mg,
  (SELECT median(current_ratio) FROM split WHERE split = 'train')), 6) AS current_ratio
FROM split LEFT JOIN g USING (rural_level)""").replace("\n,\ng AS", ",\ng AS"))
def impute_by_group(spark, sf_dir):
    rows = split_rows(spark, sf_dir).select(*KEY, "split", "rural_level", "current_ratio")
    return rounded(prep.impute_by_group(
        rows, ["current_ratio"], ["rural_level"], "split = 'train'"), ["current_ratio"]).select(
        *KEY, "current_ratio")


@query("m4_smote", with_(READY_SQL, """,
n AS (SELECT count(*) AS all_rows, sum(distress_label) AS pos FROM ready WHERE split = 'train')
SELECT distress_label, CAST(greatest(pos, all_rows - pos) AS BIGINT) AS "rows", TRUE AS inside
FROM n CROSS JOIN (SELECT CAST(unnest([0, 1]) AS INTEGER) AS distress_label)""").replace(
    "\n,\nn AS", ",\nn AS"))
def smote(spark, sf_dir):
    """Both classes as large as the larger one, every row inside its class's value range."""
    rows = hand_over(train_rows(spark, sf_dir).select(LABEL, *FEATURES), "smote-in")
    limits = rows.groupBy(F.col(LABEL).alias("_label")).agg(
        *[fn(c).alias(f"{c}_{name}") for c in FEATURES
          for name, fn in (("min", F.min), ("max", F.max))])
    inside = F.lit(True)
    for c in FEATURES:
        inside = inside & F.col(c).between(F.col(f"{c}_min") - 1e-9, F.col(f"{c}_max") + 1e-9)
    made = oversample.smote(rows, FEATURES, LABEL)
    return made.join(limits, F.col(LABEL) == F.col("_label")).groupBy(LABEL).agg(
        F.count("*").alias("rows"), F.every(inside).alias("inside"))


@query("m4_neighbors", """
WITH p AS (SELECT CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS DOUBLE) AS size,
             min(p_partkey) AS id FROM part GROUP BY ALL),
d AS (SELECT a.id, b.id AS neighbor,
        (a.price - b.price) * (a.price - b.price) + (a.size - b.size) * (a.size - b.size) AS d2
      FROM p a JOIN p b ON a.id <> b.id)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY d2, neighbor) AS INTEGER) AS nth, neighbor,
       round(d2, 6) AS d2
FROM d QUALIFY nth <= 5""")
def nearest_parts(spark, sf_dir):
    """The search under oversampling, on its own: nearest other points of every distinct point."""
    points = hand_over(
        table(spark, sf_dir, "part")
        .groupBy(F.col("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("double").alias("size"))
        .agg(F.min("p_partkey").alias("id")).select("id", F.array("price", "size").alias("x")), "points")
    near = neighbors.nearest_neighbors(points, "id", "x", 2, 5, points.count(), cell_points=128)
    return near.select("id", "nth", "neighbor", r("d2").alias("d2"))


#: Least ROC-AUC on the rows a model was trained on, in hundredths.
FLOORS = {"logistic": 50, "forest": 90, "boosted": 80}
_FACTS = """
SELECT ccn_key, fiscal_year, distress_label, TRUE AS in_range, TRUE AS fits FROM ready WHERE split <> 'train'"""


def study_rows(spark, sf_dir):
    """(prepared rows, training rows with both classes equally large), both written."""
    ready = hand_over(ready_rows(spark, sf_dir), "ready")
    balanced = oversample.smote(ready.filter("split = 'train'"), FEATURES, LABEL)
    return ready, hand_over(balanced, "balanced")


def _facts(model, ready, fits):
    """Held-out keys with the label; ``in_range`` if the row has a probability."""
    return score.probability(model, ready.filter("split <> 'train'"), [*KEY, LABEL], "_p").select(
        *KEY, LABEL, (F.col("_p").isNotNull() & F.col("_p").between(0, 1)).alias("in_range"),
        F.lit(bool(fits)).alias("fits"))


def _reaches(model, balanced, floor):
    """Whether the trained rows are ranked at least as well as the floor says."""
    ranked = score.probability(model, balanced, [LABEL], "_p")
    return metrics.roc_auc(ranked, "_p", LABEL).first()["roc_auc"] * 100 >= FLOORS[floor]


def _steepest(model, balanced):
    """Largest part of the gradient of the balanced, penalised mean loss."""
    rows = aggregates.class_weights(balanced, LABEL, "_w")
    n = rows.count()
    last, scale = model.stages[-1], model.stages[1].getScalingVec()
    error = F.col("_w") * (F.col("_p") - F.col(LABEL))
    sums = score.probability(model, rows, [LABEL, "_w", *FEATURES], "_p").agg(
        F.sum(error).alias("_intercept"), *[F.sum(error * F.col(f)).alias(f) for f in FEATURES]).first()
    slopes = [abs(sums[f] * scale[i] + last.coefficients[i]) / n for i, f in enumerate(FEATURES)]
    return max(slopes + [abs(sums["_intercept"]) / n])


@query("m5_train_logistic", with_(READY_SQL, _FACTS))
def train_logistic(spark, sf_dir):
    """``fits`` if the gradient of the loss vanishes at the fitted weights."""
    ready, balanced = study_rows(spark, sf_dir)
    model = train.train_logistic(balanced, FEATURES, LABEL)
    return _facts(model, ready, _steepest(model, balanced) < 1e-4)


@query("m6_train_forest", with_(READY_SQL, _FACTS))
def train_forest(spark, sf_dir):
    ready, balanced = study_rows(spark, sf_dir)
    model = train.train_forest(balanced, FEATURES, LABEL)
    return _facts(model, ready, _reaches(model, balanced, "forest"))


@query("m7_train_boosted", with_(READY_SQL, _FACTS + """
UNION ALL SELECT NULL, CAST(unnest(range(1, 301)) AS INTEGER), NULL, TRUE, TRUE"""))
def train_boosted(spark, sf_dir):
    """Also one row per round (as ``fiscal_year``) with the validation metrics in range; the
    last round's must be those of the model's own probabilities."""
    ready, balanced = study_rows(spark, sf_dir)
    model = train.train_boosted(balanced, FEATURES, LABEL)
    val = ready.filter("split = 'val'")
    whole = metrics.average_precision(score.probability(model, val, [LABEL], "_p"), "_p", LABEL).first()
    watched = rounds.metrics_per_round(model, val, LABEL)
    precision = F.col("average_precision")
    per_round = watched.select(
        F.lit(None).cast("string").alias(KEY[0]), F.col("round").alias(KEY[1]),
        F.lit(None).cast("int").alias(LABEL), precision.between(0, 1).alias("in_range"),
        ((F.col("round") < 300) | (F.abs(precision - whole["average_precision"]) < 1e-9)).alias("fits"))
    return _facts(model, ready, _reaches(model, balanced, "boosted")).unionByName(per_round)


def _returned(spark, sf_dir):
    """Order lines with a label and a heavily tied score."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").alias("score"))


def _ranking_sql(source: str, by: str = "") -> str:
    """Score groups with counts at, below and above the score."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""grouped AS (
  SELECT {keys}score, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY {keys}score),
ranked AS (
  SELECT *, sum(neg) OVER ({part} ORDER BY score) - neg AS below,
         sum(pos) OVER ({part} ORDER BY score DESC) AS hits,
         sum(pos + neg) OVER ({part} ORDER BY score DESC) AS seen FROM grouped)"""


_AUC_SQL = "sum(pos * (below + neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))"
_AP_SQL = "sum(pos * CAST(hits AS DOUBLE) / seen) / sum(pos)"
_RETURNED_SQL = """returned AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_discount AS score FROM lineitem)"""


@query("m8_roc_auc", with_(f"{_RETURNED_SQL}, {_ranking_sql('returned')}",
                           f"SELECT round({_AUC_SQL}, 9) AS roc_auc FROM ranked"))
def roc_auc(spark, sf_dir):
    return rounded(metrics.roc_auc(_returned(spark, sf_dir), "score", "label"), ["roc_auc"], 9)


@query("m9_average_precision", with_(f"{_RETURNED_SQL}, {_ranking_sql('returned')}",
                                     f"SELECT round({_AP_SQL}, 9) AS average_precision FROM ranked"))
def average_precision(spark, sf_dir):
    return rounded(metrics.average_precision(_returned(spark, sf_dir), "score", "label"),
                   ["average_precision"], 9)


def _judged(spark, sf_dir):
    """Labelled documents: toxicity against a score from the text length."""
    scored = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", "lang", F.col("toxic").cast("int").alias("label"),
        (F.lit(1.0) / (1 + F.col("n_chars") / 500.0)).alias("score"))
    return scored.withColumn("pred", numeric.apply_threshold("score"))


_JUDGED_SQL = """judged AS (
  SELECT doc_id, lang, label, score, CAST(score >= 0.4 AS INTEGER) AS pred FROM (
    SELECT doc_id, lang, CAST(toxic AS INTEGER) AS label,
           1.0::DOUBLE / (1 + n_chars / 500.0::DOUBLE) AS score
    FROM documents JOIN labels USING (doc_id)))"""
_COUNTS_SQL = """CAST(sum(pred * label) AS BIGINT) AS tp, CAST(sum(pred * (1 - label)) AS BIGINT) AS fp,
  CAST(sum((1 - pred) * (1 - label)) AS BIGINT) AS tn, CAST(sum((1 - pred) * label) AS BIGINT) AS fn"""


@query("m10_confusion", with_(_JUDGED_SQL, f"""
SELECT lang, {_COUNTS_SQL} FROM judged GROUP BY 1"""))
def confusion(spark, sf_dir):
    return metrics.confusion(_judged(spark, sf_dir), "pred", "label", ["lang"])


def _share_sql(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0 END"


@query("m11_classification_report", with_(_JUDGED_SQL + f""",
c AS (SELECT {_COUNTS_SQL} FROM judged),
s AS (SELECT 'Stable' AS class_name, {_share_sql('tn', 'tn + fn')} AS p, {_share_sql('tn', 'tn + fp')} AS r, tn + fp AS n FROM c
      UNION ALL SELECT 'Distress', {_share_sql('tp', 'tp + fp')}, {_share_sql('tp', 'tp + fn')}, tp + fn FROM c),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM s),
a AS (SELECT CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS acc, tp + fp + tn + fn AS n FROM c)""", """
SELECT class_name, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, CAST(n AS BIGINT) AS support FROM f
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), CAST(n AS BIGINT) FROM a
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(n) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 6), round(sum(r * n) / sum(n), 6),
  round(sum(f1 * n) / sum(n), 6), CAST(sum(n) AS BIGINT) FROM f"""))
def classification_report(spark, sf_dir):
    return rounded(metrics.classification_report(_judged(spark, sf_dir), "pred", "label"),
                   ["precision", "recall", "f1"])


@query("m12_fairness_by_group", with_(f"{_JUDGED_SQL}, {_ranking_sql('judged', 'lang')},\n"
                                      f"c AS (SELECT lang, {_COUNTS_SQL} FROM judged GROUP BY 1),\n"
                                      f"ap AS (SELECT lang, {_AP_SQL} AS ap FROM ranked GROUP BY 1)", """
SELECT lang, tp + fp + tn + fn AS n, tp + fn AS positives,
       CASE WHEN fp + tn > 0 THEN round(CAST(fp AS DOUBLE) / (fp + tn), 6) END AS fpr,
       CASE WHEN tp + fn > 0 THEN round(CAST(tp AS DOUBLE) / (tp + fn), 6) END AS recall,
       CASE WHEN tp + fn > 1 THEN round(ap, 6) END AS average_precision
FROM c JOIN ap USING (lang)"""))
def fairness_by_group(spark, sf_dir):
    return rounded(metrics.fairness_by_group(
        _judged(spark, sf_dir), "lang", "score", "pred", "label", tiers=None),
        ["fpr", "recall", "average_precision"])


_RIVALS = {"discount": "l_discount", "price": "l_extendedprice", "quantity": "l_quantity"}
_RIVALS_SQL = "rivals AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, CAST(l_returnflag = 'R' AS INTEGER) AS label, {c} AS score FROM lineitem"
    for m, c in _RIVALS.items()) + ")"


def _rivals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_returnflag") == "R").cast("int").alias("label"),
                        *[F.col(c).alias(m) for m, c in _RIVALS.items()]).unpivot(
        ["label"], list(_RIVALS), "model", "score")


@query("m13_compare_models", with_(f"{_RIVALS_SQL}, {_ranking_sql('rivals', 'model')}", f"""
SELECT model, round({_AUC_SQL}, 9) AS roc_auc, round({_AP_SQL}, 9) AS average_precision
FROM ranked GROUP BY 1"""))
def compare_models(spark, sf_dir):
    return rounded(metrics.compare_models(_rivals(spark, sf_dir), "model", "score", "label"),
                   ["roc_auc", "average_precision"], 9)


@query("m14_log_run", with_(f"{_RETURNED_SQL}, {_ranking_sql('returned')}", f"""
SELECT 'returned' AS name, 'param' AS kind, 'model_type' AS "key", 'score' AS value
UNION ALL SELECT 'returned', 'metric', 'roc_auc', CAST(CAST(floor(1000 * {_AUC_SQL}) AS BIGINT) AS VARCHAR) FROM ranked
UNION ALL SELECT 'returned', 'metric', 'average_precision', CAST(CAST(floor(1000 * {_AP_SQL}) AS BIGINT) AS VARCHAR) FROM ranked"""))
def log_run(spark, sf_dir):
    """The later of two runs counts; its metrics (per mille) are added to it afterwards."""
    path = scratch_path(spark, "runs")
    runs.log_run(spark, path, "returned", {"model_type": "old"})
    run_id = runs.log_run(spark, path, "returned", {"model_type": "score"})
    rows = _returned(spark, sf_dir)
    for fn, name in ((metrics.roc_auc, "roc_auc"), (metrics.average_precision, "average_precision")):
        value = fn(rows, "score", "label").select(
            F.floor(F.col(name) * 1000).cast("bigint").alias(name))
        runs.log_metrics(value, path, "returned", run_id)
    return runs.latest_values(runs.read_runs(spark, path)).drop("run_id")


@query("m15_shap_values", with_(READY_SQL, """
SELECT ccn_key, fiscal_year, TRUE AS adds_up, TRUE AS same_base FROM ready WHERE split <> 'train'"""))
def shap_values(spark, sf_dir):
    """Tree attributions of every held-out row; with the base value they add up to the margin,
    and the base value is the mean margin of the trained rows."""
    ready, balanced = study_rows(spark, sf_dir)
    model = train.train_boosted(balanced, FEATURES, LABEL)
    rows = score.probability(model, ready.filter("split <> 'train'"), [*KEY, *FEATURES], "_p")
    phi = explain.shap_values(model, rows, FEATURES, [*KEY, "_p"])
    total = F.col("base_value")
    for f in FEATURES:
        total = total + F.col(f"phi_{f}")
    off = F.abs(F.lit(1.0) / (1 + F.exp(-total)) - F.col("_p"))
    margin = F.ln(F.col("_p") / (1 - F.col("_p")))
    mean = score.probability(model, balanced, [], "_p").agg(F.avg(margin).alias("m")).first()["m"]
    return phi.select(*KEY, (off < 1e-9).alias("adds_up"),
                      (F.abs(F.col("base_value") - mean) < 1e-6).alias("same_base"))


#: Trees of two levels over order lines: root column and limit, second column and its limits left
#: and right, then values and training rows of the four leaves from left to right.
_PAIRS = (
    ("l_quantity", 24.0, "l_discount", 0.03, 0.07, (0.5, -0.25, 0.75, -1.0), (4000, 9000, 2000, 8000)),
    ("l_extendedprice", 30000.0, "l_tax", 0.02, 0.05, (-0.375, 0.125, 0.25, 1.5), (100, 700, 300, 50)),
    ("l_discount", 0.05, "l_quantity", 10.0, 40.0, (1.25, 0.0, -0.5, 0.625), (10, 20, 30, 40)),
)
_LINES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _pairs_model():
    made = []
    for first, limit, second, low, high, values, rows in _PAIRS:
        a, b = _LINES.index(first), _LINES.index(second)
        gap = float("nan")
        made.append(Tree(*map(np.array, (
            [a, b, b, -1, -1, -1, -1], [limit, low, high, gap, gap, gap, gap], [1, 3, 5, -1, -1, -1, -1],
            [2, 4, 6, -1, -1, -1, -1], [0.0, 0.0, 0.0, *values],
            [float(x) for x in (sum(rows), sum(rows[:2]), sum(rows[2:]), *rows)]))))
    return BoostedModel(_LINES, tuple(made))


def _pair_sql(pair, known):
    """A tree's value if ``known`` columns are ('', 'a' root's, 'b' second's or 'ab')."""
    first, limit, second, low, high, v, n = pair
    def side(k, at):
        if "b" in known:
            return f"CASE WHEN {second} <= {at} THEN {v[k]}::DOUBLE ELSE {v[k + 1]}::DOUBLE END"
        return f"{v[k] * n[k] + v[k + 1] * n[k + 1]}::DOUBLE / {n[k] + n[k + 1]}"
    left, right = side(0, low), side(2, high)
    if "a" in known:
        return f"(CASE WHEN {first} <= {limit} THEN {left} ELSE {right} END)"
    return f"(({sum(n[:2])} * ({left}) + {sum(n[2:])} * ({right})) / {sum(n)})"


def _pair_phi_sql(column):
    parts = ["0"]
    for pair in _PAIRS:
        for own, other, name in (("a", "b", pair[0]), ("b", "a", pair[2])):
            if name == column:
                parts.append(f"({_pair_sql(pair, own)} - {_pair_sql(pair, '')} + {_pair_sql(pair, 'ab')}"
                             f" - {_pair_sql(pair, other)}) / 2")
    return " + ".join(parts)


@query("m15_shap_trees", f"""
SELECT {', '.join(_LINE_KEY)}, round({' + '.join(_pair_sql(p, '') for p in _PAIRS)}, 9) AS base_value,
       {', '.join(f'round({_pair_phi_sql(c)}, 9) AS phi_{c}' for c in _LINES)}
FROM lineitem""")
def shap_trees(spark, sf_dir):
    """Attributions of given trees: SQL works out every subset of a tree's two columns."""
    phi = explain.shap_values(_pairs_model(), table(spark, sf_dir, "lineitem"), _LINES, _LINE_KEY)
    return rounded(phi, ["base_value", *[f"phi_{c}" for c in _LINES]], 9)


@query("m18_score_trees", f"""
SELECT {', '.join(_LINE_KEY)}, round(p, 4) AS risk_score,
       CASE WHEN p >= 0.6 THEN 'HIGH' WHEN p >= 0.35 THEN 'ELEVATED' ELSE 'LOW' END AS risk_tier
FROM (SELECT *, 1 / (1 + exp(-({' + '.join(_pair_sql(p, 'ab') for p in _PAIRS)}))) AS p FROM lineitem)""")
def score_trees(spark, sf_dir):
    """Scores and tiers of given trees, saved and loaded again."""
    path = scratch_path(spark, "given")
    train.save_model(_pairs_model(), path)
    return score.score_batch(train.load_model(path), table(spark, sf_dir, "lineitem"), _LINE_KEY)


_WEIGHTS = {"l_quantity": 0.5, "l_extendedprice": -0.001, "l_discount": 20.0, "l_tax": -30.0}


def _linear(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return explain.linear_attributions(
        lines, _WEIGHTS, 1.0, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
        background=lines)


@query("m16_shap_summary", "\nUNION ALL ".join(f"""
SELECT '{f}' AS feature, round(avg(abs(({f} - m) * {w}::DOUBLE)), 6) AS mean_abs_phi
FROM lineitem CROSS JOIN (SELECT avg({f}) AS m FROM lineitem)""" for f, w in _WEIGHTS.items()))
def shap_summary(spark, sf_dir):
    long = explain.shap_long(_linear(spark, sf_dir), list(_WEIGHTS), ["l_orderkey"])
    return rounded(explain.shap_summary(long), ["mean_abs_phi"])


_TOP_SQL = """means AS (SELECT """ + ", ".join(f"avg({f}) AS m_{f}" for f in _WEIGHTS) + """ FROM lineitem),
scored AS (SELECT *, 1.0::DOUBLE + """ + " + ".join(f"m_{f} * {w}::DOUBLE" for f, w in _WEIGHTS.items()) + """ AS base,
  """ + " + ".join(f"{f} * {w}::DOUBLE" for f, w in _WEIGHTS.items()) + """ AS total FROM lineitem CROSS JOIN means),
top AS (SELECT * FROM scored ORDER BY round(total, 6) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1),
phis AS (""" + " UNION ALL ".join(
    f"SELECT l_orderkey, base, '{f}' AS feature, ({f} - m_{f}) * {w}::DOUBLE AS phi FROM top"
    for f, w in _WEIGHTS.items()) + ")"


@query("m17_shap_waterfall", with_(_TOP_SQL, """
SELECT l_orderkey, CAST(row_number() OVER (ORDER BY abs(phi) DESC, feature) AS INTEGER) AS position, feature,
       round(phi, 4) AS phi,
       round(base + sum(phi) OVER (ORDER BY abs(phi), feature DESC) - phi, 4) AS start_value,
       round(base + sum(phi) OVER (ORDER BY abs(phi), feature DESC), 4) AS end_value
FROM phis"""))
def shap_waterfall(spark, sf_dir):
    """The line with the highest linear score, explained."""
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    total = F.lit(0.0)
    for f, w in _WEIGHTS.items():
        total = total + F.col(f) * w
    top = windows.top_1(table(spark, sf_dir, "lineitem").withColumn("score", F.round(total, 6)),
                        "score", key).select(*key)
    long = explain.shap_long(_linear(spark, sf_dir), list(_WEIGHTS), key).join(
        top, key, "left_semi")
    return rounded(explain.shap_waterfall(long, key).drop(*key[1:]),
                   ["phi", "start_value", "end_value"], 4)


@query("m18_score_batch", with_(SPLIT_SQL, """
SELECT ccn_key, fiscal_year, TRUE AS rounded, TRUE AS tiered, TRUE AS as_prepared FROM split"""))
def score_batch(spark, sf_dir):
    """Raw rows, gaps included, scored by a saved model with the caps and medians kept with it.

    ``rounded`` and ``tiered`` hold if score and tier follow from the probability that the
    model gives the prepared row.
    """
    raw = hand_over(split_rows(spark, sf_dir), "split")
    fitted = prep.Preparation.fit(raw, FEATURES, prep.WINSORIZED, "split = 'train'")
    ready = hand_over(fitted.apply(raw), "ready")
    balanced = hand_over(oversample.smote(ready.filter("split = 'train'"), FEATURES, LABEL), "balanced")
    model = train.train_logistic(balanced, FEATURES, LABEL)
    path = scratch_path(spark, "scorer")
    score.save_scorer(spark, model, fitted, path)
    given = score.score_saved(spark, path, raw, list(KEY))
    known = score.probability(model, ready, list(KEY), "_p")
    tier = F.when(F.col("_p") >= 0.6, "HIGH").when(F.col("_p") >= 0.35, "ELEVATED").otherwise("LOW")
    return given.join(known, list(KEY)).select(
        *KEY, (F.col("risk_score") == F.round("risk_score", 4)).alias("rounded"),
        (F.col("risk_tier") == tier).alias("tiered"),
        (F.col("risk_score") == F.round("_p", 4)).alias("as_prepared"))


_DOMAIN = {"l_quantity": (1.0, 45.0), "l_discount": (0.0, 0.08)}
_INPUT_SQL = """given AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
    CASE l_returnflag WHEN 'A' THEN CAST(l_quantity AS VARCHAR) WHEN 'N' THEN 'many'
                      ELSE CAST(l_quantity AS VARCHAR) END AS l_quantity,
    CASE WHEN l_linestatus = 'F' THEN l_discount END AS l_discount FROM lineitem)"""


@query("m19_validate_input", with_(_INPUT_SQL, """
SELECT l_orderkey, l_linenumber, l_partkey,
  concat_ws('; ',
    CASE WHEN l_quantity IS NULL THEN 'l_quantity: missing'
         WHEN TRY_CAST(l_quantity AS DOUBLE) IS NULL THEN 'l_quantity: not a number'
         WHEN NOT TRY_CAST(l_quantity AS DOUBLE) BETWEEN 1 AND 45 THEN 'l_quantity: out of range' END,
    CASE WHEN l_discount IS NULL THEN 'l_discount: missing'
         WHEN NOT l_discount BETWEEN 0 AND 0.08 THEN 'l_discount: out of range' END) AS reasons
FROM given"""))
def validate_input(spark, sf_dir):
    """Valid rows carry no reason, rejected ones all of theirs."""
    given = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_returnflag") == "N", "many").otherwise(
            F.col("l_quantity").cast("string")).alias("l_quantity"),
        F.when(F.col("l_linestatus") == "F", F.col("l_discount")).alias("l_discount"))
    valid, rejected = score.validate_input(given, list(_DOMAIN), _DOMAIN)
    key = ["l_orderkey", "l_linenumber", "l_partkey"]
    return valid.select(*key, F.lit("").alias("reasons")).unionByName(
        rejected.select(*key, F.array_join("reasons", "; ").alias("reasons")))


@query("m20_save_load_model", with_(READY_SQL, """
SELECT split, CAST(count(*) AS BIGINT) AS "rows", CAST(count(*) AS BIGINT) AS same FROM ready GROUP BY 1"""))
def save_load(spark, sf_dir):
    """A reloaded model gives every row the score the trained one gave."""
    ready = hand_over(ready_rows(spark, sf_dir), "ready")
    model = train.train_forest(ready.filter("split = 'train'"), FEATURES, LABEL)
    path = scratch_path(spark, "model")
    train.save_model(model, path)
    again = train.load_model(path)
    kept = [*KEY, "split"]
    before = score.probability(model, ready, [*kept, *FEATURES], "first")
    both = score.probability(again, before, [*kept, "first"], "second")
    return both.groupBy("split").agg(
        F.count("*").alias("rows"), F.count_if(F.col("first") == F.col("second")).alias("same"))
