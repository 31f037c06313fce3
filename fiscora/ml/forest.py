"""Random forest on binned columns, grown level by level for a group of trees at once.

Columns are cut into bins and kept in blocks of rows, as in ``boost``, but row by row and each
bin with the row's class. Beside them a block keeps, for every tree of the group, how often each
row was drawn and which open node it is in. A level is one job: tasks count both classes per open
node, drawn column and bin over all their blocks, the counts meet by tree and stretch of nodes,
and the best split of every node goes to the driver.

Where the rows fit a task, tasks share out the trees instead and grow them by the same steps
without asking the driver.

Counts have a size of nodes x columns x bins, never of rows, and the size of a group bounds
them. What a row costs in a group is a few bytes per tree, held in memory or on disk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import ceil, sqrt

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField

from fiscora.ml import boost
from fiscora.ml.trees import Tree, margins

BLOCK_ROWS = 1 << 16
ALONE_ROWS = 1 << 20        # rows that tasks read whole, each for trees of its own
TASK_ROWS = 1 << 15         # rows that are worth a task
MOST_ROWS = 1 << 25         # rows of a task
GROUP_CELLS = 1 << 25       # counts that a task holds at the deepest level, 4 bytes each
STRETCH = 256               # nodes whose counts travel together


@dataclass(frozen=True)
class ForestModel:
    """Trees whose values add up to the probability, over columns in the order of ``features``."""
    features: tuple[str, ...]
    trees: tuple[Tree, ...]


@dataclass
class _Growing:
    """A tree so far, nodes in the order in which they were made; ``open`` ones may still be split."""
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    counts: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])
    open: list[int] = field(default_factory=lambda: [0])

    def split(self, found: np.ndarray, last: bool) -> np.ndarray:
        """Take the splits of the open nodes; returns column, bin and places of both children
        among the nodes that are open then, below 0 if they are not."""
        moves = np.full((4, len(self.open)), -1, np.int32)
        now_open = []
        for k, (node, row) in enumerate(zip(self.open, found.tolist())):
            f, b, *counts = row
            self.counts[node] = (counts[0] + counts[2], counts[1] + counts[3])
            if f < 0:
                continue
            self.feature[node], self.bin[node] = f, b
            moves[0, k], moves[1, k] = f, b
            for side, (neg, pos) in enumerate((counts[:2], counts[2:])):
                child = len(self.feature)
                for values, value in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1),
                                      (self.counts, (neg, pos))):
                    values.append(value)
                (self.right if side else self.left)[node] = child
                if neg and pos and not last:
                    moves[2 + side, k] = len(now_open)
                    now_open.append(child)
        self.open = now_open
        return moves

    def freeze(self, cuts: Sequence[np.ndarray], weights: np.ndarray, trees: int) -> Tree:
        counts = np.array(self.counts, float)
        held = counts * weights
        total = held.sum(axis=1)
        # A tree may have drawn no row at all.
        share = np.divide(held[:, 1], total, out=np.full(len(total), 0.5), where=total > 0)
        return Tree(
            np.array(self.feature), np.array([cuts[f][b] if f >= 0 else np.nan for f, b in zip(self.feature, self.bin)]),
            np.array(self.left), np.array(self.right), share / trees, counts.sum(axis=1))


def _drawn(seed: int, tree: int, level: int, nodes: int, width: int, most: int) -> np.ndarray:
    """Columns that the open nodes of a level may be split by."""
    if most >= width:
        return np.tile(np.arange(width), (nodes, 1))
    return np.random.default_rng([seed, 1, tree, level]).random((nodes, width)).argsort(axis=1)[:, :most]


def _cells(row: Sequence, width: int, size: int) -> tuple[int, np.ndarray]:
    """A block's number, and twice the bin and the class, row by row."""
    block, bins, label = row
    label = np.frombuffer(label, np.uint8)
    cells = np.frombuffer(bins, np.uint8).reshape(width, -1).T.astype(np.min_scalar_type(2 * size))
    return block, np.ascontiguousarray(cells * cells.dtype.type(2) + label[:, None])


def _bag(block: int, cells: np.ndarray, trees: Sequence[int], seed: int, once: bool, kind: type) -> tuple[np.ndarray, ...]:
    """A block's cells, and per tree the draws of every row and its node, the root."""
    n = len(cells)
    draws = np.ones((len(trees), n), np.uint8) if once else np.stack(
        [np.random.default_rng([seed, 0, t, block]).poisson(1.0, n).astype(np.uint8) for t in trees])
    return cells, draws, np.where(draws > 0, 0, -1).astype(kind)


def _inside(block: tuple) -> Iterator[tuple]:
    """(tree, rows with a node, their nodes)."""
    for t, nodes in enumerate(block[2]):
        rows = np.flatnonzero(nodes >= 0)
        if len(rows):
            yield t, rows, nodes.take(rows).astype(np.int64)


def _moved(block: tuple, moves: Sequence[np.ndarray]) -> tuple:
    """The block with every row in its child; rows of nodes that stay leaves are in none."""
    cells, draws, at = block
    out, width = np.full_like(at, -1), cells.shape[1]
    ways = [(np.maximum(f, 0).astype(np.int64), 2 * b.astype(np.int64) + 1,
             np.where(f < 0, -1, [low, high]).T.astype(at.dtype).ravel()) for f, b, low, high in moves]
    for t, rows, node in _inside(block):
        column, limit, child = ways[t]
        high = cells.take(rows * width + column.take(node)) > limit.take(node)
        out[t, rows] = child.take(2 * node + high)
    return cells, draws, out


def _counts(blocks: Iterator[tuple], drawn: Sequence[np.ndarray], size: int, stretch: int) -> Iterator[tuple]:
    """((tree, stretch), counts by node, drawn column, bin and class) of a task's rows."""
    sums: list = [None] * len(drawn)
    sides = [np.ascontiguousarray(columns.T) for columns in drawn]
    for block in blocks:
        cells, draws, _ = block
        for t, rows, node in _inside(block):
            most = len(sides[t])
            if sums[t] is None:
                sums[t] = np.zeros(len(drawn[t]) * most * size * 2, np.uint32)
            weight, first = draws[t].take(rows).astype(np.uint32), rows * cells.shape[1]
            for j, column in enumerate(sides[t]):
                key = (node * most + j) * (size * 2)
                key += cells.take(first + column.take(node))
                np.add.at(sums[t], key, weight)
    for t, found in enumerate(sums):
        if found is not None:
            found = found.reshape(len(drawn[t]), -1, size * 2)
            for start in range(0, len(found), stretch):
                part = found[start:start + stretch]
                yield (t, start), part.astype(np.min_scalar_type(part.max()))


def _best(counts: np.ndarray, columns: np.ndarray, size: int, weights: np.ndarray) -> np.ndarray:
    """Per node the column (below 0: no split), the bin and the counts of both classes left and
    right, by the largest fall of the Gini impurity of the weighted rows."""
    nodes, most = counts.shape[:2]
    low = counts.reshape(nodes, most, size, 2).cumsum(axis=2, dtype=np.int64)
    whole = low[:, :, -1:]
    high = whole - low

    def purity(rows: np.ndarray) -> np.ndarray:
        held = rows * weights
        return (held ** 2).sum(axis=-1) / np.maximum(held.sum(axis=-1), 1e-300)

    gain = purity(low) + purity(high) - purity(whole)
    gain[(low.sum(axis=-1) == 0) | (high.sum(axis=-1) == 0)] = 0
    gain = gain.reshape(nodes, -1)
    choice = gain.argmax(axis=1)
    at = np.arange(nodes)
    j, b = np.divmod(choice, size)
    floor = 1e-12 * (whole[:, 0, 0] * weights).sum(axis=-1)
    f = np.where(gain[at, choice] > floor, columns[at, j], -1)
    return np.column_stack([f, b, low[at, j, b], high[at, j, b]])


def _kind(depth: int) -> type:
    """Of open nodes, at most 2**(depth - 1) at once."""
    return np.int16 if depth < 16 else np.int32


def _grow_alone(rows: Sequence[Sequence], trees: Sequence[int], width: int, size: int, depth: int, most: int, seed: int,
                weights: np.ndarray, once: bool) -> Iterator[tuple[int, _Growing]]:
    """Trees one after the other, from a task that holds all rows."""
    held = [_cells(row, width, size) for row in rows]
    for t in trees:
        grown = _Growing()
        blocks = [_bag(block, cells, [t], seed, once, _kind(depth)) for block, cells in held]
        for level in range(depth):
            drawn = _drawn(seed, t, level, len(grown.open), width, most)
            found = [_best(counts, drawn[start:start + len(counts)], size, weights)
                     for (_, start), counts in _counts(iter(blocks), [drawn], size, STRETCH)]
            if not found:       # the tree drew no row
                break
            moves = [grown.split(np.concatenate(found), level + 1 == depth)]
            if not grown.open:
                break
            blocks = [_moved(block, moves) for block in blocks]
        yield t, grown


def _grow(blocks: RDD, trees: Sequence[int], width: int, size: int, depth: int, most: int, seed: int,
          weights: np.ndarray, once: bool) -> list[_Growing]:
    """The trees of one group, a job per level."""
    grown = [_Growing() for _ in trees]
    held = blocks.map(lambda row: _bag(*_cells(row, width, size), trees, seed, once, _kind(depth))).persist(
        StorageLevel.MEMORY_AND_DISK_DESER)
    before, stretch = None, STRETCH
    for level in range(depth):
        drawn = [_drawn(seed, t, level, len(g.open), width, most) for t, g in zip(trees, grown)]
        shared = blocks.context.broadcast(drawn)
        sums = held.mapPartitions(lambda it, shared=shared: _counts(it, shared.value, size, stretch)).reduceByKey(
            lambda a, b: np.add(a, b, dtype=np.int64), held.getNumPartitions())
        found: dict[int, list] = {}
        for (t, start), best in sums.map(lambda x, shared=shared: (
                x[0], _best(x[1], shared.value[x[0][0]][x[0][1]:x[0][1] + len(x[1])], size, weights))).collect():
            found.setdefault(t, []).append((start, best))
        if before is not None:
            before.unpersist()
        last = level + 1 == depth
        moves = [g.split(np.concatenate([b for _, b in sorted(found[t], key=lambda x: x[0])]), last)
                 if t in found else np.zeros((4, 0), np.int32) for t, g in enumerate(grown)]
        if not any(g.open for g in grown):
            break
        told = blocks.context.broadcast(moves)
        before, held = held, held.map(lambda b, told=told: _moved(b, told.value)).persist(
            StorageLevel.MEMORY_AND_DISK_DESER)
    for rdd in (held, before):
        if rdd is not None:
            rdd.unpersist()
    return grown


def fit_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 300, depth: int = 12,
               seed: int = 42, bins: int = 64) -> ForestModel:
    """Gini trees on rows drawn with repetition, a root's share of the columns drawn per node.

    Classes weigh the same in total. One tree alone sees every row once and every column. Missing
    values raise an error; an empty table gives a model without trees.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must fit in a byte")
    features, width = tuple(features), len(features)
    count = df.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"),
                   F.count_if(F.col(label) == 0).alias("neg")).first()
    n, pos = count["n"], count["pos"]
    if pos + count["neg"] < n:
        raise ValueError("labels must be 0 or 1")
    if not n:
        return ForestModel(features, ())
    cuts = boost._cuts(df, features, bins)
    size = max(len(c) for c in cuts) + 1
    most = width if trees == 1 else ceil(sqrt(width))
    weights = np.array([n / (2 * c) if c else 1.0 for c in (n - pos, pos)])
    context = df.sparkSession.sparkContext
    tasks = 1 if n <= ALONE_ROWS else min(
        -(-n // TASK_ROWS), max(context.defaultParallelism, -(-n // MOST_ROWS)))
    ready = df.select(*[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)],
                      (F.col(label) == 1).cast("double").alias("_y"))
    blocks = boost.blocks_of(ready, tasks, cuts, BLOCK_ROWS, "forest")
    if tasks == 1:
        parts = min(trees, 2 * context.defaultParallelism)

        def own(pairs: Iterator[tuple]) -> Iterator[tuple[int, _Growing]]:
            rows = list(pairs)
            return _grow_alone([row for _, row in rows], range(rows[0][0], trees, parts), width, size, depth, most,
                               seed, weights, trees == 1)

        grown = [g for _, g in sorted(context.parallelize(range(parts), parts).cartesian(blocks).mapPartitions(
            own).collect(), key=lambda x: x[0])]
        return ForestModel(features, tuple(g.freeze(cuts, weights, trees) for g in grown))
    cells = min(1 << depth - 1, n) * most * size * 2
    group = int(max(1, min(trees, GROUP_CELLS // cells)))
    grown = []
    for start in range(0, trees, group):
        grown += _grow(blocks, range(start, min(start + group, trees)), width, size, depth, most, seed,
                       weights, trees == 1)
    return ForestModel(features, tuple(g.freeze(cuts, weights, trees) for g in grown))


def forest_probability(model: ForestModel, df: DataFrame, keep: Sequence[str], out: str = "probability") -> DataFrame:
    """``keep`` columns and the mean share of positives over the trees."""
    return boost._apply(model, df, keep, StructField(out, DoubleType()), margins)
