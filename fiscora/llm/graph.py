"""Connected components by contraction, without collecting nodes or links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fiscora.session import hand_over


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their ends and contracts the graph to these ends; a round at least halves
    the nodes of every component, so rounds grow with the logarithm of the
    largest one. All joins are between written tables, so Spark can split the
    rows of a node with very many links. No links give no rows.
    """
    def normal(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.least("a", "b").alias("a"),
                                          F.greatest("a", "b").alias("b")).distinct()

    spark = links.sparkSession
    edges = hand_over(normal(links), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = hand_over(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
                          .select("node", F.least("node", "_least").alias("root")), "hooks")
        while True:
            further = hooks.select(F.col("node").alias("_at"), F.col("root").alias("_end"))
            jumped = hand_over(hooks.join(further, F.col("root") == F.col("_at")).select(
                "node", F.col("_end").alias("root"), (F.col("root") != F.col("_end")).alias("_moved")), "hooks")
            hooks = jumped.select("node", "root")
            if jumped.filter("_moved").isEmpty():
                break
        ends = hooks.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        if labels is None:
            labels = hooks
        else:
            labels = hand_over(labels.join(ends, F.col("root") == F.col("_node"), "left").select(
                "node", F.coalesce("_root", "root").alias("root")), "labels")
        half = hand_over(edges.join(ends, F.col("a") == F.col("_node")).select(
            F.col("_root").alias("a"), "b"), "links")
        edges = hand_over(normal(half.join(ends, F.col("b") == F.col("_node")).select(
            "a", F.col("_root").alias("b"))), "links")
    if labels is None:
        return spark.createDataFrame([], "node long, root long")
    return labels
