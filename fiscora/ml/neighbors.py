"""Exact nearest neighbours among many points, without comparing all pairs.

Space is cut into cells by median splits: first by a sample of all points, then
every crowded cell by a sample of its own points, level by level, until each
cell is small. A point is compared inside its own cell, then in the few cells
nearest to it, and with the radius these leave in all others that can still
hold a closer point. Cells and visits are shuffled by Spark; a task sees one
cell and a bounded chunk of its visitors, whatever the number of points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fiscora.session import hand_over

CELL_POINTS = 2048
VISIT_CHUNK = 20_000
SPREAD_POINTS = 256
# Levels of cuts from the sample of all points, and from that of one crowded cell.
TOP_DEPTH = 12
INNER_DEPTH = 11
# Sampled points a cell needs so that cells come out similar in size.
SAMPLE_PER_CELL = 8
# Nearest cells of a tree that a point visits before its radius is tightened, its own included.
FIRST_CELLS = 3
# Relative slack of the cell test, so rounding never hides an equal distance.
SLACK = 1e-9
HASH_STEPS = 1 << 30


@dataclass(frozen=True)
class SpaceSplit:
    """Complete binary tree of cuts in heap order; x <= cut goes left."""
    dims: np.ndarray
    cuts: np.ndarray
    depth: int

    @staticmethod
    def fit(sample: np.ndarray, depth: int) -> SpaceSplit:
        inner = (1 << depth) - 1
        dims, cuts = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        rows = {0: sample}
        for node in range(inner):
            own = rows.pop(node)
            if len(own) > 1:
                spread = own.max(axis=0) - own.min(axis=0)
                dim = int(np.argmax(spread))
                values = own[:, dim]
                if spread[dim] > 0:
                    cut = np.median(values)
                    # Both sides get points, also when one value dominates.
                    if cut >= values.max():
                        cut = values[values < values.max()].max()
                    dims[node], cuts[node] = dim, cut
            left = own[:, dims[node]] <= cuts[node]
            rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return SpaceSplit(dims, cuts, depth)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        at = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[at, self.dims[node]] > self.cuts[node])
        return node - ((1 << self.depth) - 1)

    def boxes(self, n_dims: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corner of every cell."""
        low, high = np.full((1, n_dims), -np.inf), np.full((1, n_dims), np.inf)
        for level in range(self.depth):
            first = (1 << level) - 1
            d = self.dims[first:2 * first + 1]
            c = self.cuts[first:2 * first + 1]
            at = np.arange(len(d))
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            high[2 * at, d] = np.minimum(high[2 * at, d], c)
            low[2 * at + 1, d] = np.maximum(low[2 * at + 1, d], c)
        return low, high

    def cells_within(self, x: np.ndarray, r2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, cell, place) of cells that may hold a point within the radius.

        Places count a point's cells from the nearest. Distances to cells do not
        depend on the radius, so a smaller one keeps the places of what it keeps.
        """
        reach = np.sqrt(r2) * (1 + SLACK)
        point, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            gap = x[point, self.dims[node]] - self.cuts[node]
            left, right = gap <= reach[point], -gap <= reach[point]
            point = np.concatenate([point[left], point[right]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        cell = node - ((1 << self.depth) - 1)
        away = self.distances(x[point], cell)
        near = away <= reach[point] ** 2
        point, cell, away = point[near], cell[near], away[near]
        order = np.lexsort((cell, away, point))
        point, cell = point[order], cell[order]
        return point, cell, np.arange(len(point)) - np.searchsorted(point, point)

    def distances(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Squared distance of each row of ``x`` to the cell beside it."""
        low, high = self.boxes(x.shape[1])
        return (np.maximum(np.maximum(low[cell] - x, x - high[cell]), 0) ** 2).sum(axis=1)


def _closest(x: np.ndarray, x_id: np.ndarray, y: np.ndarray, y_id: np.ndarray, k: int,
             limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k pairs (row of x, id in y, squared distance) per row, nearest first."""
    found = []
    block = max(1, 4_000_000 // max(1, len(y)))
    for start in range(0, len(x), block):
        part = x[start:start + block]
        d2 = np.zeros((len(part), len(y)))
        for j in range(x.shape[1]):
            d2 += (part[:, j, None] - y[None, :, j]) ** 2
        d2[x_id[start:start + block, None] == y_id[None, :]] = np.inf
        bound = np.full(len(part), np.inf)
        if d2.shape[1] > k:
            bound = np.partition(d2, k - 1, axis=1)[:, k - 1]
        if limit is not None:
            bound = np.minimum(bound, limit[start:start + block])
        row, col = np.nonzero((d2 <= bound[:, None]) & np.isfinite(d2))
        dist, ids = d2[row, col], y_id[col]
        order = np.lexsort((ids, dist, row))
        row, dist, ids = row[order], dist[order], ids[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < k
        found.append((row[keep] + start, ids[keep], dist[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(part) for part in zip(*found))


def _matrix(column: pd.Series, n_dims: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), n_dims)


def _depth(points: float, cell_points: int, limit: int) -> int:
    return min(limit, max(0, ceil(log2(max(points, 1) / cell_points))))


def _meet(left: DataFrame, right: DataFrame, chunk: int, schema: str,
          meet: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``meet`` for rows of ``left`` and ``right`` in the same cell.

    Many rows of ``left`` in one cell are dealt out by id in chunks, and what
    ``right`` has for the cell (a tree, or a cell's points) is copied per chunk.
    ``left`` is read twice: hand it over before.
    """
    copies = left.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("copies"))
    dealt = left.join(copies, "cell").withColumn(
        "copy", F.pmod(F.xxhash64("id"), F.col("copies")).cast("int")).drop("copies")
    copied = right.join(copies, "cell").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return (dealt.groupBy("cell", "copy").cogroup(copied.groupBy("cell", "copy"))
            .applyInPandas(meet, schema))


@dataclass(frozen=True)
class Cells:
    """Points in cells, and the trees that lead to them.

    A cell is numbered by its path from the root: a leading one, then a bit per
    cut. ``levels`` are tables (cell, depth, dims, cuts): the tree inside a cell
    of the level above that held too many points.
    """
    placed: DataFrame
    top: SpaceSplit
    levels: tuple[DataFrame, ...]


def _tree_of(rows: pd.DataFrame) -> SpaceSplit:
    row = rows.iloc[0]
    return SpaceSplit(np.asarray(row["dims"], np.int64), np.asarray(row["cuts"], float), int(row["depth"]))


def _sampled(points: DataFrame, share, salt: int) -> DataFrame:
    """About ``share`` (0 to 1) of the points, by a hash of their id."""
    draw = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(HASH_STEPS))
    return points.filter(draw < share * HASH_STEPS)


def cut_cells(base: DataFrame, n_dims: int, n_points: int, cell_points: int,
              top_depth: int = TOP_DEPTH, inner_depth: int = INNER_DEPTH,
              chunk: int = VISIT_CHUNK) -> Cells:
    """Cut the points (id, x) into cells of at most twice ``cell_points``.

    The driver and any task see only samples of at most 8 points per cut cell;
    one level takes ``inner_depth`` cuts, and levels follow until no cell is crowded.
    """
    depth = _depth(n_points, cell_points, top_depth)
    top = SpaceSplit(np.zeros(0, np.int64), np.zeros(0), 0)
    if depth:
        share = min(1.0, SAMPLE_PER_CELL * 2 ** depth / n_points)
        top = SpaceSplit.fit(_matrix(_sampled(base, F.lit(share), 0).toPandas()["x"], n_dims), depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=(1 << depth) + top.cell_of(_matrix(batch["x"], n_dims)))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        cuts = int(rows["depth"].iloc[0])
        tree = SpaceSplit.fit(_matrix(rows["x"], n_dims), cuts)
        return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "depth": [cuts],
                             "dims": [tree.dims], "cuts": [tree.cuts]})

    def deeper(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        tree = _tree_of(trees)
        cell = (rows["cell"].to_numpy() << tree.depth) + tree.cell_of(_matrix(rows["x"], n_dims))
        return pd.DataFrame({"id": rows["id"], "x": rows["x"], "cell": cell})

    points = "id bigint, x array<double>, cell bigint"
    placed = hand_over(base.mapInPandas(place, points), "cells")
    levels: list[DataFrame] = []
    while True:
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))
        wanted = F.least(F.lit(inner_depth), F.ceil(F.log2(F.col("n") / cell_points))).cast("int")
        crowded = hand_over(sizes.filter(F.col("n") > 2 * cell_points)
                            .select("cell", "n", wanted.alias("depth")), "crowded")
        longest = crowded.agg(F.max(F.floor(F.log2("cell")) + F.col("depth"))).first()[0]
        if longest is None:
            return Cells(placed, top, tuple(levels))
        if longest > 61:
            raise ValueError("points lie too close together to be cut into cells")
        share = SAMPLE_PER_CELL * F.pow(F.lit(2.0), "depth") / F.col("n")
        sample = _sampled(placed.join(crowded, "cell"), share, len(levels) + 1)
        trees = hand_over(sample.select("cell", "depth", "x").groupBy("cell").applyInPandas(
            fit, "cell bigint, depth int, dims array<bigint>, cuts array<double>"), "trees")
        inside = trees.select("cell")
        placed = hand_over(
            placed.join(inside, "cell", "left_anti").select("id", "x", "cell").unionByName(
                _meet(placed.join(inside, "cell", "left_semi"), trees, chunk, points, deeper)), "cells")
        levels.append(trees)


_VISIT = "id bigint, x array<double>, r2 double, own bigint, cell bigint, first boolean"


def _visits(rows: DataFrame, cells: Cells, n_dims: int, first: bool, chunk: int,
            first_cells: int = FIRST_CELLS) -> DataFrame:
    """Cells other than its own in which each row (id, x, r2, own) has to look.

    ``first`` gives only the nearest cells of every tree, else all but these.
    """
    def reached(batch: pd.DataFrame, tree: SpaceSplit, roots: np.ndarray,
                before: np.ndarray) -> Iterator[pd.DataFrame]:
        # Some points visit very many cells; list a few points at a time.
        for start in range(0, len(batch), SPREAD_POINTS):
            part = batch.iloc[start:start + SPREAD_POINTS]
            point, cell, place = tree.cells_within(_matrix(part["x"], n_dims), part["r2"].to_numpy())
            near = (place < first_cells) & before[start:start + SPREAD_POINTS][point]
            if first:
                point, cell, near = point[near], cell[near], near[near]
            seen = part.iloc[point]
            yield pd.DataFrame({
                "id": seen["id"].to_numpy(), "x": seen["x"].to_numpy(), "r2": seen["r2"].to_numpy(),
                "own": seen["own"].to_numpy(), "first": near,
                "cell": (roots[start:start + SPREAD_POINTS][point] << tree.depth) + cell})

    top = cells.top

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from reached(batch, top, np.ones(len(batch), np.int64), np.ones(len(batch), bool))

    def deeper(batch: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(reached(batch, _tree_of(trees), batch["cell"].to_numpy(),
                                 batch["first"].to_numpy(bool)))

    visits = rows.select("id", "x", "r2", "own").mapInPandas(spread, _VISIT)
    for trees in cells.levels:
        visits = hand_over(visits, "visits")
        inside = trees.select("cell")
        visits = visits.join(inside, "cell", "left_anti").unionByName(
            _meet(visits.join(inside, "cell", "left_semi"), trees, chunk, _VISIT, deeper))
    return hand_over(visits.filter((F.col("cell") != F.col("own")) & (F.col("first") == F.lit(first)))
                     .select("id", "x", "r2", "cell"), "visits")


def nearest_neighbors(points: DataFrame, point_id: str, vector: str, n_dims: int, k: int,
                      n_points: int, cell_points: int = CELL_POINTS, visit_chunk: int = VISIT_CHUNK,
                      top_depth: int = TOP_DEPTH, inner_depth: int = INNER_DEPTH) -> DataFrame:
    """Rows (id, neighbor, d2, nth): the k nearest other points of each point.

    Exact under squared Euclidean distance, ties by neighbour id. ``points``
    needs unique ids and distinct vectors (merge equal ones first), otherwise
    a cell of equal points could not be split.
    """
    base = points.select(F.col(point_id).cast("bigint").alias("id"), F.col(vector).alias("x"))
    cells = cut_cells(base, n_dims, n_points, cell_points, top_depth, inner_depth, visit_chunk)

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(group["x"], n_dims), group["id"].to_numpy()
        row, near, d2 = _closest(x, ids, x, ids, k)
        return pd.DataFrame({"id": ids[row], "neighbor": near, "d2": d2})

    def compare(visit: pd.DataFrame, cell: pd.DataFrame) -> pd.DataFrame:
        if not len(visit) or not len(cell):
            return pd.DataFrame({"id": [], "neighbor": [], "d2": []})
        x, y, r2 = _matrix(visit["x"], n_dims), _matrix(cell["x"], n_dims), visit["r2"].to_numpy()
        # The cell's points may fill only a part of it.
        away = (np.maximum(np.maximum(y.min(axis=0) - x, x - y.max(axis=0)), 0) ** 2).sum(axis=1)
        near = away <= r2 * (1 + SLACK) ** 2
        x, ids, r2 = x[near], visit["id"].to_numpy()[near], r2[near]
        row, other, d2 = _closest(x, ids, y, cell["id"].to_numpy(), k, r2)
        return pd.DataFrame({"id": ids[row], "neighbor": other, "d2": d2})

    pair = "id bigint, neighbor bigint, d2 double"
    nearest = Window.partitionBy("id").orderBy("d2", "neighbor")

    def best(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= k)

    placed = cells.placed
    found = best(placed.groupBy("cell").applyInPandas(inside, pair))
    if not cells.top.depth:
        return found.select("id", "neighbor", "d2", "nth")
    for first in (True, False):
        found = hand_over(found.select("id", "neighbor", "d2"), "near")
        # With fewer than k neighbours so far, any cell may hold one.
        radius = found.groupBy("id").agg(F.when(F.count("*") == k, F.max("d2")).alias("r2"))
        rows = placed.join(radius, "id", "left").select(
            "id", "x", F.coalesce("r2", F.lit(float("inf"))).alias("r2"), F.col("cell").alias("own"))
        visits = _visits(rows, cells, n_dims, first, visit_chunk)
        found = best(found.unionByName(_meet(visits, placed, visit_chunk, pair, compare)))
    return found.select("id", "neighbor", "d2", "nth")
