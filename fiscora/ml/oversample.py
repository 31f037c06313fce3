"""Synthetic minority rows by interpolation between near neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fiscora.ml.neighbors import CELL_POINTS, nearest_neighbors
from fiscora.operators.aggregates import require_no_nulls
from fiscora.operators.ordered import running_sums, surrogate_key
from fiscora.operators.windows import union_synthetic

DRAW_CHUNK = 10_000


def synthetic_rows(df: DataFrame, features: Sequence[str], label: str, k: int = 5,
                   seed: int = 42, cell_points: int = CELL_POINTS) -> DataFrame:
    """Rows that bring the smaller class up to the size of the larger one.

    A synthetic row is x + u (neighbour - x) with the neighbour drawn from the
    k nearest rows of the class, in the given (unscaled) units. Every row of
    the class is a base equally often, give or take one. All draws are hashes
    of (base, draw number, seed), so repeating a task repeats its rows.
    """
    features = list(features)
    require_no_nulls(df, features + [label])
    counts = df.agg(F.count_if(F.col(label) == 1).alias("pos"),
                    F.count_if(F.col(label) == 0).alias("neg")).first()
    minority = 1 if counts["pos"] <= counts["neg"] else 0
    rows, wanted = min(counts), abs(counts["pos"] - counts["neg"])
    if rows < k + 1:
        raise ValueError(f"{rows} minority rows are too few for {k} neighbours")

    # Equal rows become one point with a multiplicity: a value that a third of
    # all rows share is one point, and cells of points can always be split.
    points = (df.filter(F.col(label) == minority)
              .select(*[F.col(c).cast("double").alias(c) for c in features])
              .groupBy(*features).agg(F.count("*").alias("copies"))
              .withColumn("_mix", F.xxhash64(*features, F.lit(seed))))
    points = surrogate_key(points, ["_mix", *features], "id").select(
        "id", F.array(*features).alias("x"), "copies")
    near = nearest_neighbors(points, "id", "x", len(features), k, points.count(), cell_points)
    other = points.select(F.col("id").alias("neighbor"), F.col("x").alias("near_x"),
                          F.least("copies", F.lit(k)).cast("int").alias("near_copies"))
    # At most k neighbours per point.
    partners = near.join(other, "neighbor").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("nth", "near_copies", "near_x"))).alias("near"))
    # Equal rows are each other's nearest neighbours and come first.
    repeated = F.flatten(F.transform("near", lambda n: F.array_repeat(
        n["near_x"], n["near_copies"])))
    own = F.array_repeat(F.col("x"), F.least(F.col("copies") - 1, F.lit(k)).cast("int"))
    choices = F.slice(F.concat(own, F.coalesce(repeated, F.array().cast("array<array<double>>"))),
                      1, k)

    each, extra = divmod(wanted, rows)
    before = running_sums(points, "id", {"copies": F.sum("copies")}).select("id", "copies_before")
    draws = F.col("copies") * each + F.greatest(
        F.lit(0), F.least(F.col("copies"), F.lit(extra) - F.col("copies_before")))
    bases = (points.join(partners, "id", "left").join(before, "id")
             .select("id", "x", choices.alias("choices"), draws.alias("draws"))
             .filter(F.col("draws") > 0))
    # A point with very many draws is spread over tasks before they are listed.
    chunks = bases.withColumn("chunk", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col("draws") - 1) / DRAW_CHUNK))))
    chunks = chunks.repartition("id", "chunk")
    first = F.col("chunk") * DRAW_CHUNK
    draw = chunks.withColumn("draw", F.explode(F.sequence(
        first, F.least(F.col("draws"), first + DRAW_CHUNK) - 1)))
    pick = F.pmod(F.xxhash64("id", "draw", F.lit(seed)), F.size("choices")).cast("int")
    u = F.shiftrightunsigned(F.xxhash64("id", "draw", F.lit(seed + 1)), 11) / float(1 << 53)
    mixed = draw.select(u.alias("u"), "x", F.get("choices", pick).alias("to"))
    made = mixed.select(*[
        (F.col("x")[i] + F.col("u") * (F.col("to")[i] - F.col("x")[i])).alias(c)
        for i, c in enumerate(features)])
    return made.withColumn(label, F.lit(minority).cast(dict(df.dtypes)[label]))


def smote(df: DataFrame, features: Sequence[str], label: str, k: int = 5, seed: int = 42,
          cell_points: int = CELL_POINTS) -> DataFrame:
    """Real rows followed by synthetic ones; both classes are equally large."""
    real = df.select(*[F.col(c).cast("double").alias(c) for c in features], label)
    return union_synthetic(real, synthetic_rows(real, features, label, k, seed, cell_points))
