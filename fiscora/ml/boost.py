"""Second-order gradient boosting on binned columns.

Columns are cut once into bins at quantiles from a mergeable sketch and kept as
bytes, in blocks of rows. A level of a tree is one job: every task adds up the
gradients and Hessians of the log loss per node, column and bin over its blocks,
and the driver picks the splits from the sums of all. Of two children only the lighter
one is added up, the other is what its parent has besides. Leaves take Newton steps.
Margins move on with every tree and are written with the blocks every few rounds, so
a lost task repeats little.

What reaches the driver has a size of tasks x nodes x columns x bins, never of rows,
and the number of tasks is bounded: with more rows, each holds more blocks. Where the
rows are worth one task only, its sums are those of all, so it grows tree after tree
by the same steps without asking the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from fiscora.ml.trees import Places, Tree, margins
from fiscora.session import hand_over, keep

BLOCK_ROWS = 1 << 17
TASK_ROWS = 1 << 20         # rows that one task grows trees from alone in less time than jobs take to start
MOST_TASKS = 64             # tasks that send sums to the driver, some 5 MB at the deepest level
LOOPED_NODES = 128          # splits of a tree up to which all rows are compared at each
WRITE_EVERY = 20            # rounds after which margins are written
ACCURACY = 10_000           # of the sketch: ranks are off by at most rows / ACCURACY
RIDGE = 1.0                 # penalty on squared leaf values
LEAST_HESSIAN = 1.0         # of either side of a split


@dataclass(frozen=True)
class BoostedModel:
    """Trees whose values add up to the log-odds, over columns in the order of ``features``."""
    features: tuple[str, ...]
    trees: tuple[Tree, ...]


_BLOCK = pa.schema([(c, pa.binary()) for c in ("bins", "label")])
_BLOCK_DDL = "bins binary, label binary"


def _cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending bin limits per column; a value belongs to the first limit it does not exceed."""
    shares = [k / bins for k in range(1, bins)]
    row = df.agg(*[F.approx_percentile(F.col(f).cast("double"), shares, ACCURACY).alias(f"q{i}")
                   for i, f in enumerate(features)],
                 *[F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f"n{i}")
                   for i, f in enumerate(features)]).first()
    gaps = [f for i, f in enumerate(features) if row[f"n{i}"]]
    if gaps:
        raise ValueError(f"columns with missing values: {gaps}")
    return [np.unique(np.array(row[f"q{i}"] or [0.0], float)) for i in range(len(features))]


def _pack(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows, the label last: a byte per column and row."""
    held, size = [], 0

    def block() -> pa.RecordBatch:
        rows = np.concatenate(held, axis=1)
        bins = np.stack([np.searchsorted(c, x) for c, x in zip(cuts, rows)]).astype(np.uint8)
        parts = (bins, rows[-1].astype(np.uint8))
        return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], schema=_BLOCK)

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]))
            size += batch.num_rows
        if size >= (most or BLOCK_ROWS):
            yield block()
            held, size = [], 0
    if size:
        yield block()


@dataclass
class _Growing:
    """A tree over bins: node k's children are 2k + 1 and 2k + 2; ``feature`` is below 0 for leaves."""
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, depth: int) -> _Growing:
        n = (1 << depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n))

    def place(self, bins: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The last node of every row on its way down, from the root or from ``at``."""
        kind = np.min_scalar_type(len(self.value))
        at = np.zeros(bins.shape[1], kind) if at is None else at.copy()
        inner = np.flatnonzero(self.feature >= 0)
        if not len(inner) or not len(at):
            return at
        if len(inner) <= LOOPED_NODES:
            # Parents come before their children; comparing bytes is cheaper than looking up the row's split.
            for node in inner[inner >= at.min()].tolist():
                step = (bins[self.feature[node]] > int(self.bin[node])).astype(kind)
                step += kind.type(node + 1)
                step *= at == node
                at += step
            return at
        rows = np.arange(bins.shape[1])
        while True:
            feature = self.feature[at[rows]]
            if (feature < 0).any():
                rows, feature = rows[feature >= 0], feature[feature >= 0]
            if not len(rows):
                return at
            here = at[rows].astype(np.int64)
            low = bins[feature, rows] <= self.bin[here]
            at[rows] = 2 * here + 2 - low

    def freeze(self, cuts: list[np.ndarray], cover: np.ndarray) -> Tree:
        """The nodes that are in use, split at values."""
        kept, place = [0], {0: 0}
        for node in kept:
            if self.feature[node] >= 0:
                for child in (2 * node + 1, 2 * node + 2):
                    place[child] = len(kept)
                    kept.append(child)
        inner = [self.feature[k] >= 0 for k in kept]
        return Tree(
            np.array([self.feature[k] for k in kept]),
            np.array([cuts[self.feature[k]][self.bin[k]] if i else np.nan for k, i in zip(kept, inner)]),
            np.array([place[2 * k + 1] if i else -1 for k, i in zip(kept, inner)]),
            np.array([place[2 * k + 2] if i else -1 for k, i in zip(kept, inner)]),
            np.array([0.0 if i else self.value[k] for k, i in zip(kept, inner)]),
            np.array([cover[k] for k in kept], float))


@dataclass(frozen=True)
class _Block:
    """Rows at their present margin."""
    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    margin: np.ndarray
    places: dict = field(default_factory=dict)      # where the rows are in the tree that grows

    @classmethod
    def at(cls, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, margin: np.ndarray) -> _Block:
        return cls(bins, label, weight, margin)

    @classmethod
    def of(cls, row: Sequence[bytes], width: int, pos_weight: float) -> _Block:
        """From bins, label and, after the first tree, margin."""
        label = np.frombuffer(row[1], np.uint8)
        return cls(np.frombuffer(row[0], np.uint8).reshape(width, -1), label, np.where(label == 1, pos_weight, 1.0),
                   np.frombuffer(row[2]) if len(row) > 2 else np.zeros(len(label)))

    def row(self) -> tuple[bytes, ...]:
        return self.bins.tobytes(), self.label.tobytes(), self.margin.tobytes()

    def placed(self, tree: _Growing) -> np.ndarray:
        """Nodes of the rows; in a tree that has grown since, on from where they were."""
        self.places["last"] = tree.place(self.bins, self.places.get("last"))
        return self.places["last"]

    def after(self, tree: _Growing) -> _Block:
        return _Block.at(self.bins, self.label, self.weight, self.margin + tree.value.take(self.placed(tree)))

    def slopes(self, rows: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian of the loss."""
        p, weight = 1 / (1 + np.exp(-self.margin[rows])), self.weight[rows]
        return weight * (p - self.label[rows]), weight * p * (1 - p)

    def histograms(self, size: int, tree: _Growing, nodes: np.ndarray) -> np.ndarray:
        """Sums of gradients and Hessians by column, one of the nodes and bin."""
        width, rows, node = len(self.bins), slice(None), 0
        if len(tree.value) > 1 and tree.feature[0] >= 0:
            slot = np.full(len(tree.value), -1)
            slot[nodes] = np.arange(len(nodes))
            node = slot.take(self.placed(tree))
            rows = np.flatnonzero(node >= 0)
            node = node.take(rows)
        slopes = self.slopes(rows)
        out = np.empty((2, width, len(nodes), size))
        # With many rows, two columns are added up by both their bins in one go.
        paired = width - width % 2 if len(slopes[0]) >= len(nodes) * size * size else 0
        for f in range(0, paired, 2):
            key = (self.bins[f] * np.uint16(size) + self.bins[f + 1])[rows] + node * (size * size)
            for k, slope in enumerate(slopes):
                both = np.bincount(key, slope, len(nodes) * size * size).reshape(len(nodes), size, size)
                out[k, f], out[k, f + 1] = both.sum(axis=2), both.sum(axis=1)
        for f in range(paired, width):
            key = self.bins[f][rows] + node * size
            for k, slope in enumerate(slopes):
                out[k, f] = np.bincount(key, slope, len(nodes) * size).reshape(len(nodes), size)
        return out


def _split(sums: np.ndarray, tree: _Growing, level: int, rate: float) -> None:
    """Give every node of the level its best split, and values to what may stay a leaf."""
    g, h = sums
    low_g, low_h = g.cumsum(axis=2), h.cumsum(axis=2)
    all_g, all_h = low_g[:, :, -1:], low_h[:, :, -1:]
    high_g, high_h = all_g - low_g, all_h - low_h
    gain = (low_g ** 2 / (low_h + RIDGE) + high_g ** 2 / (high_h + RIDGE) - all_g ** 2 / (all_h + RIDGE))
    gain[(low_h < LEAST_HESSIAN) | (high_h < LEAST_HESSIAN)] = 0
    width, nodes, size = g.shape
    best = gain.transpose(1, 0, 2).reshape(nodes, -1)
    choice = best.argmax(axis=1)
    for k in range(nodes):
        node, (f, b) = (1 << level) - 1 + k, divmod(int(choice[k]), size)
        if all_h[0, k, 0] <= 0 or best[k, choice[k]] <= 1e-9:
            continue
        tree.feature[node], tree.bin[node] = f, b
        for child, cg, ch in ((2 * node + 1, low_g, low_h), (2 * node + 2, high_g, high_h)):
            tree.value[child] = -rate * cg[f, k, b] / (ch[f, k, b] + RIDGE)


def _lighter(sums: np.ndarray, tree: _Growing, level: int) -> np.ndarray:
    """Of the children of the level's splits, the ones with the smaller Hessian."""
    found = []
    for k, (f, b) in enumerate(zip(tree.feature[(1 << level) - 1:], tree.bin[(1 << level) - 1:(2 << level) - 1])):
        if f >= 0:
            h = sums[1, f, k]
            found.append(2 * ((1 << level) - 1 + k) + (1 if 2 * h[:b + 1].sum() <= h.sum() else 2))
    return np.array(found, np.int64)


def _grow(total, size: int, depth: int, rate: float) -> _Growing:
    """One tree; ``total`` sums a function of blocks over all of them."""
    tree, sums, nodes = _Growing.of(depth), None, np.array([0])
    for level in range(depth):
        added = total(lambda b, nodes=nodes: b.histograms(size, tree, nodes))
        if level == 0:
            sums = added
            g, h = sums[:, 0].sum(axis=(1, 2))
            tree.value[0] = -rate * g / (h + RIDGE)
        else:
            first = (1 << level) - 1
            above, sums = sums, np.zeros((*sums.shape[:2], 1 << level, size))
            sums[:, :, nodes - first] = added
            other = (nodes - 1 ^ 1) + 1         # the sibling
            sums[:, :, other - first] = above[:, :, (nodes - 1) // 2 - (first >> 1)] - added
        _split(sums, tree, level, rate)
        nodes = _lighter(sums, tree, level)
        if not len(nodes):
            break
    return tree


def _covers(block: _Block, grown: Sequence[_Growing]) -> np.ndarray:
    """Rows in every leaf of every tree."""
    return np.stack([np.bincount(t.place(block.bins), minlength=len(t.value)) for t in grown])


def _grow_alone(blocks: Iterator[_Block], rounds: int, size: int, depth: int, rate: float) -> list[tuple]:
    """All trees and their covers from a task that holds all rows."""
    first = list(blocks)
    held, grown = first, []
    for _ in range(rounds):
        tree = _grow(lambda of: sum(map(of, held)), size, depth, rate)
        held = [b.after(tree) for b in held]
        grown.append(tree)
    return list(zip(grown, sum(_covers(b, grown) for b in first)))


def blocks_of(ready: DataFrame, tasks: int, cuts: list[np.ndarray], rows: int, name: str) -> RDD:
    """(number, bins, label) of the blocks, written once, in as many parts as there are tasks."""
    packed = ready.repartition(tasks).mapInArrow(lambda it: _pack(it, cuts, rows), _BLOCK_DDL)
    written = hand_over(packed.select(F.monotonically_increasing_id().alias("block"), "bins", "label"), name).rdd
    if tasks == 1:
        return written.coalesce(1)
    # Readers cut and join files by their size; the upper bits of the number are the task that made the block.
    return written.map(lambda b: (b["block"] >> 33, tuple(b))).partitionBy(tasks, lambda task: task).values()


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, rounds: int = 300, rate: float = 0.05,
                depth: int = 5, bins: int = 64, pos_weight: float | None = None) -> BoostedModel:
    """Boosted trees on the log loss; positives weigh negatives / positives unless given.

    Missing values raise an error. An empty table gives a model without trees.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must fit in a byte")
    features, width = tuple(features), len(features)
    count = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos")).first()
    if not count["n"]:
        return BoostedModel(features, ())
    if pos_weight is None:
        pos_weight = (count["n"] - count["pos"]) / count["pos"] if 0 < count["pos"] < count["n"] else 1.0
    cuts = _cuts(df, features, bins)
    size = max(len(c) for c in cuts) + 1
    most = min(max(df.sparkSession.sparkContext.defaultParallelism, 2), MOST_TASKS)
    tasks = 1 if count["n"] <= TASK_ROWS else min(-(-count["n"] // BLOCK_ROWS), most)
    ready = df.select(*[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)],
                      F.col(label).cast("double").alias("_y"))
    blocks = blocks_of(ready, tasks, cuts, BLOCK_ROWS, "blocks")

    def block(row) -> _Block:
        return _Block.of(row, width, pos_weight)

    if not rounds:
        found = []
    elif tasks == 1:
        found = blocks.mapPartitions(
            lambda it: _grow_alone((block(row[1:]) for row in it), rounds, size, depth, rate)).collect()
    else:
        found = _grow_together(blocks.map(lambda row: tuple(row[1:])), block, rounds, size, depth, rate)
    out = []
    for tree, cover in found:
        for node in range(len(cover) // 2 - 1, -1, -1):
            cover[node] += cover[2 * node + 1] + cover[2 * node + 2]
        out.append(tree.freeze(cuts, cover))
    return BoostedModel(features, tuple(out))


def _grow_together(first: RDD, block, rounds: int, size: int, depth: int, rate: float) -> list[tuple]:
    """All trees and their covers: a job per level, margins moved on by the next tree's first job."""
    held, before, grown = first.persist(StorageLevel.MEMORY_AND_DISK_DESER), None, []

    def total(of) -> np.ndarray:
        """Sums over the blocks of each task, then over the tasks."""
        return sum(x for x in held.mapPartitions(lambda it: [sum(of(block(row)) for row in it)]).collect()
                   if not isinstance(x, int))

    for r in range(rounds):
        tree = _grow(total, size, depth, rate)
        grown.append(tree)
        old, held = held, held.map(lambda row, tree=tree: block(row).after(tree).row()).persist(
            StorageLevel.MEMORY_AND_DISK_DESER)
        if (r + 1) % WRITE_EVERY == 0:
            keep(held)
        # The last but one is let go: the margins made from it are there by now.
        if before is not None:
            before.unpersist()
        before = old
    cover = total(lambda b: _covers(b, grown))
    for rdd in (held, before):
        rdd.unpersist()
    return list(zip(grown, cover))


def _apply(model: BoostedModel, df: DataFrame, keep: Sequence[str], out: StructField, values) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model.trees)
    places = [f"_x{i}" for i in range(len(model.features))]
    inputs = df.select(*keep, *[F.col(f).cast("double").alias(p) for f, p in zip(model.features, places)])
    schema = StructType(df.select(*keep).schema.fields + [out])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ways = Places(shared.value)
        for batch in batches:
            made = batch.drop(columns=places)
            made[out.name] = values(batch[places].to_numpy(dtype=float), ways)
            yield made

    return inputs.mapInPandas(run, schema)


def boosted_margin(model: BoostedModel, df: DataFrame, keep: Sequence[str], out: str = "margin") -> DataFrame:
    """``keep`` columns and the log-odds."""
    return _apply(model, df, keep, StructField(out, DoubleType()), margins)


def _staged(x: np.ndarray, ways: Places) -> list[np.ndarray]:
    if not ways.trees:
        return [np.zeros(0)] * len(x)
    return list(np.cumsum([tree.value[at] for tree, at in zip(ways.trees, ways.leaves(x))], axis=0).T)


def staged_margins(model: BoostedModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and ``margins``, the log-odds after each round."""
    return _apply(model, df, keep, StructField("margins", ArrayType(DoubleType())), _staged)


_NODES = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()),
                    ("left", pa.int32()), ("right", pa.int32()), ("value", pa.float64()), ("cover", pa.float64())])


def nodes(spark: SparkSession, model: BoostedModel) -> DataFrame:
    """The trees as a table, one row per node; leaves have children below 0."""
    parts = [(np.full(len(t.value), k), np.arange(len(t.value)), t.feature, t.threshold, t.left, t.right, t.value, t.cover)
             for k, t in enumerate(model.trees)]
    columns = [np.concatenate(c) for c in zip(*parts)] or [np.zeros(0)] * len(_NODES)
    return spark.createDataFrame(pa.table([pa.array(c).cast(f.type) for c, f in zip(columns, _NODES)], schema=_NODES))


def save_boosted(spark: SparkSession, model: BoostedModel, path: str) -> None:
    nodes(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame(list(enumerate(model.features)), "position int, feature string").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/columns")


def load_boosted(spark: SparkSession, path: str) -> BoostedModel:
    names = spark.read.parquet(f"{path}/columns").orderBy("position").collect()
    rows = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toArrow().to_pandas()
    trees = [Tree(*(own[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value", "cover")))
             for _, own in rows.groupby("tree")]
    return BoostedModel(tuple(r["feature"] for r in names), tuple(trees))
