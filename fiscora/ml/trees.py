"""Decision trees as flat node arrays, and the Shapley values of their features.

A feature outside the known set follows both branches of a split in proportion
to their training rows. Along a path, what matters about a row is only which of
the path's features agree with it: a code of one bit per feature, carried from
node to node for all rows at once. A leaf's effect on each feature is worked out
for all codes together and rows look theirs up.

For a leaf the value of a known set is a product over its features, so a
feature's Shapley value is an integral over [0, 1] of a polynomial whose degree is
the number of the other features. Gauss-Legendre points make it an exact sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Codes are tabulated completely up to this many bits; beyond, only those that occur.
TABLE_BITS = 9
TABLE_ENTRIES = 1 << 18
ROWS = 1 << 14
LOOPED_NODES = 128          # splits of a tree up to which all rows are compared at each


@dataclass(frozen=True)
class Tree:
    """Nodes in any order, the root first; ``left`` is below 0 for leaves."""
    feature: np.ndarray
    threshold: np.ndarray       # left takes values up to it
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray           # training rows, or their weight

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.left[at] >= 0)
            if not len(inner):
                return at
            here = at[inner]
            down = x[inner, self.feature[here]] <= self.threshold[here]
            at[inner] = np.where(down, self.left[here], self.right[here])

    def mean(self) -> float:
        """Mean value over the training rows."""
        leaf = self.left < 0
        return float((self.value[leaf] * self.cover[leaf]).sum() / self.cover[0])


@dataclass
class Path:
    """A node with the features of its path, each one's share of rows that agree, and row codes."""
    node: int
    features: tuple[int, ...]
    shares: tuple[float, ...]
    code: np.ndarray


def descend(tree: Tree, start: Path, low: Callable[[int], np.ndarray],
            stop: Callable[[Path], bool]) -> Iterator[Path]:
    """The nodes at which ``stop`` holds or that are leaves; ``low`` tells which rows go left."""
    stack = [start]
    while stack:
        at = stack.pop()
        node, features, shares, code = at.node, at.features, at.shares, at.code
        if tree.left[node] < 0 or stop(at):
            yield at
            continue
        f, total = int(tree.feature[node]), tree.cover[node]
        known = f in features
        bit = features.index(f) if known else len(features)
        mask = 1 << bit
        met = low(node).astype(np.int64) << bit
        for child, agree in ((int(tree.left[node]), met), (int(tree.right[node]), met ^ mask)):
            share = tree.cover[child] / total
            if known:
                own = (*shares[:bit], shares[bit] * share, *shares[bit + 1:])
                stack.append(Path(child, features, own, code & (agree | ~mask)))
            else:
                stack.append(Path(child, (*features, f), (*shares, share), code | agree))


def _splits_below(tree: Tree) -> list[list[int]]:
    """The splits of every node's subtree, itself included, of small subtrees; else more than fit."""
    below: list[list[int]] = [[] for _ in tree.left]
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        if tree.left[node] >= 0:
            order.append(node)
            stack += [int(tree.left[node]), int(tree.right[node])]
    for node in reversed(order):
        left, right = below[tree.left[node]], below[tree.right[node]]
        below[node] = [node, *left, *right][:TABLE_BITS + 1]
    return below


@lru_cache
def _points(degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in [0, 1] and weights that integrate polynomials of a degree exactly."""
    at, weight = np.polynomial.legendre.leggauss(degree // 2 + 1)
    return (at + 1) / 2, weight / 2


def effects(agree: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf of value 1 for patterns of agreement (n x d): n x d."""
    t, weight = _points(share.size - 1)
    met, missed = t + (1 - t) * share[:, None], (1 - t) * share[:, None]
    reach = np.where(agree[:, :, None], met, missed).prod(axis=1) * weight
    # A feature's own factor is divided out: (1 - s) / met if it agrees, else -s / missed.
    return np.where(agree, reach @ ((1 - share[:, None]) / met).T, -(reach @ (1 / (1 - t)))[:, None])


def tables(share: np.ndarray) -> np.ndarray:
    """``effects`` of all codes, for many leaves: share (leaves x d) -> leaves x 2**d x d."""
    n, d = share.shape
    t, weight = _points(d - 1)
    missed = (1 - t) * share[:, :, None]
    met = t + missed
    reach = np.broadcast_to(weight, (n, 1, len(t)))
    for j in range(d):
        reach = np.concatenate([reach * missed[:, None, j], reach * met[:, None, j]], axis=1)
    yes = reach @ ((1 - share[:, :, None]) / met).transpose(0, 2, 1)
    agree = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(bool)
    return np.where(agree, yes, -(reach @ (1 / (1 - t)))[:, :, None])


def _small(tree: Tree, group: Path, splits: list[int]) -> list[Path]:
    """The leaves of a small subtree, for every code of its path and its splits."""
    every = np.arange(1 << len(group.features) + len(splits))
    bit = {node: len(group.features) + k for k, node in enumerate(splits)}
    start = Path(group.node, group.features, group.shares, every & (1 << len(group.features)) - 1)
    return list(descend(tree, start, lambda node: every >> bit[node] & 1, lambda _: False))


def _add_tree(phi: np.ndarray, columns: np.ndarray, tree: Tree, buffer: np.ndarray) -> None:
    """Add the effects of a tree's leaves; those of a small subtree are added up before rows look."""
    below = _splits_below(tree)
    rows = Path(0, (), (), np.zeros(columns.shape[1], np.int64))

    def low(node: int) -> np.ndarray:
        return columns[tree.feature[node]] <= tree.threshold[node]

    groups, by_size = [], {}
    for group in descend(tree, rows, low, lambda p: len(p.features) + len(below[p.node]) <= TABLE_BITS):
        splits = below[group.node]
        d = len(group.features)
        if d + len(splits) > TABLE_BITS:        # a leaf with a long path
            seen, back = np.unique(group.code, return_inverse=True)
            agree = (seen[:, None] >> np.arange(d) & 1).astype(bool)
            found = effects(agree, np.array(group.shares)) * tree.value[group.node]
            phi[:, group.features] += found[back]
            continue
        code = group.code
        for k, node in enumerate(splits):
            code = code | low(node).astype(np.int64) << d + k
        table = np.zeros((1 << d + len(splits), phi.shape[1]))
        groups.append((code, table))
        for leaf in _small(tree, group, splits):
            if leaf.features:
                by_size.setdefault(len(leaf.features), []).append((leaf, table))
    for d, found in by_size.items():
        step = max(1, TABLE_ENTRIES >> d)
        for at in range(0, len(found), step):
            part = found[at:at + step]
            values = np.array([tree.value[leaf.node] for leaf, _ in part])
            own = tables(np.array([leaf.shares for leaf, _ in part])) * values[:, None, None]
            for (leaf, table), effect in zip(part, own):
                wide = np.zeros((1 << d, phi.shape[1]))
                wide[:, leaf.features] = effect
                table += wide.take(leaf.code, axis=0)
    for code, table in groups:
        np.take(table, code, axis=0, out=buffer, mode="clip")
        phi += buffer


def attributions(x: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    """rows x features Shapley values of the sum of the trees."""
    phi = np.zeros(x.shape)
    for at in range(0, len(x), ROWS):
        part, own = np.ascontiguousarray(x[at:at + ROWS].T), phi[at:at + ROWS]
        buffer = np.empty(own.shape)
        for tree in trees:
            _add_tree(own, part, tree, buffer)
    return phi


class Places:
    """The leaves of rows in many trees. Columns are cut once at all limits of the trees; from
    then on rows are compared by the number of limits below their value."""

    def __init__(self, trees: Sequence[Tree]) -> None:
        self.trees, self.cuts, self.ways = trees, {}, []
        for f in {int(f) for tree in trees for f in np.unique(tree.feature[tree.left >= 0])}:
            self.cuts[f] = np.unique(np.concatenate(
                [tree.threshold[(tree.feature == f) & (tree.left >= 0)] for tree in trees]))
        self.kind = np.min_scalar_type(max((len(c) for c in self.cuts.values()), default=0))
        for tree in trees:
            limit = np.zeros(len(tree.left), np.int64)
            for f, cut in self.cuts.items():
                own = np.flatnonzero((tree.feature == f) & (tree.left >= 0))
                limit[own] = np.searchsorted(cut, tree.threshold[own])
            self.ways.append(self._way(tree, limit))

    def _way(self, tree: Tree, limit: np.ndarray) -> tuple:
        order = [[0]]
        while order[-1]:
            order.append([int(c) for k in order[-1] if tree.left[k] >= 0 for c in (tree.left[k], tree.right[k])])
        inner = [k for level in order for k in level if tree.left[k] >= 0]
        if len(tree.left) <= 256 and len(inner) <= LOOPED_NODES:
            return None, [(k, int(tree.feature[k]), self.kind.type(limit[k]), np.uint8(int(tree.left[k] - k) & 255),
                           np.uint8(int(tree.right[k] - tree.left[k]) & 255)) for k in inner]
        depth = len(order) - 2
        leaf, own = tree.left < 0, np.arange(len(tree.left))
        return depth, (np.where(leaf, 0, tree.feature).astype(np.int64), limit,
                       np.column_stack([np.where(leaf, own, tree.left), np.where(leaf, own, tree.right)]).ravel())

    def leaves(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """For every tree, the leaf of every row."""
        codes = np.zeros((x.shape[1], len(x)), self.kind)
        for f, cut in self.cuts.items():
            codes[f] = np.searchsorted(cut, x[:, f])
        flat, rows = codes.ravel(), np.arange(len(x))
        for depth, way in self.ways:
            if depth is None:
                at = np.zeros(len(x), np.uint8)
                for node, f, limit, left, apart in way:     # parents come before their children
                    step = (codes[f] > limit).astype(np.uint8)
                    step *= apart
                    step += left
                    step *= at == node
                    at += step
            else:
                feature, limit, child = way
                at = np.zeros(len(x), np.int64)
                for _ in range(depth):                      # leaves lead to themselves
                    at = child.take(2 * at + (flat.take(feature.take(at) * len(x) + rows) > limit.take(at)))
            yield at


def margins(x: np.ndarray, trees: Sequence[Tree] | Places) -> np.ndarray:
    """Sum of the trees for every row."""
    ways = trees if isinstance(trees, Places) else Places(trees)
    total = np.zeros(len(x))
    for tree, at in zip(ways.trees, ways.leaves(x)):
        total += tree.value[at]
    return total
