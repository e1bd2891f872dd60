"""Quantile regression forest with exact cuts and exact leaves.

All trees of a model are grown in the task that holds its rows; columns are sorted once per
tree, and every depth cuts all its nodes together.  A leaf keeps the labels that fell into
it, however many there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.config import LEVELS
from panelcast.models.passes import fit
from panelcast.models.trees import NODE, uniform, walk

SMALLEST_GAIN = 1e-12  # of a node's squared labels


@dataclass(frozen=True)
class QuantileForest:
    """Quantile regression forest (Meinshausen 2006).

    The distribution at a point is the average, over the trees, of the labels in the leaf it
    falls into; a quantile is the smallest label with that share at or below it.  A tree sees
    a row as often as a Poisson draw says; nodes are cut by squared error until none gains or
    a side would weigh less than ``min_child``, with ``depth`` as a limit where it is set.

    A window must fit in a task: ``local_values`` doubles (0.5 GB by default), beyond which a
    fit raises an error.
    """

    names: tuple[str, ...]
    levels: tuple[float, ...] = LEVELS
    trees: int = 100
    depth: int | None = None
    min_child: int = 1
    seed: int = 0
    local_values: int = 64_000_000
    kind: str = "forest"
    keeps_rows: bool = False

    def fit(
        self, chunks: DataFrame, models: DataFrame, frame=None, target="y", local_values=None
    ) -> DataFrame:
        values = local_values or self.local_values
        limit = values // max(1, len(self.names))
        longest = models.agg(F.max(F.col("last") - F.col("first") + 1)).first()[0]
        if longest is not None and longest > limit:
            raise ValueError(f"a forest's window of {longest} rows is beyond its limit of {limit}")
        return fit(chunks, models, self, "forest", local_values=values)

    def states(self) -> tuple[type, ...]:
        return ()

    def constants(self, x, y) -> np.ndarray:
        return np.empty(0)

    def weights(self, to_end: np.ndarray, tree: int) -> np.ndarray:
        """Bootstrap counts: Poisson with mean one, by row and tree."""
        steps = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720)])
        return np.searchsorted(steps, uniform(to_end, self.seed * 1000 + tree)).astype(float)

    def fit_whole(self, x, y, to_end, aux) -> np.ndarray:
        """``trees, number of nodes, roots, nodes, labels, weights``.

        A node is (feature, largest value that goes left, left child, -); a leaf is (-1, number
        of its labels, -, place of the first).
        """
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        roots, nodes, labels, weights = [], [], [], []
        size = entries = 0
        for k in range(self.trees):
            table, held = self._tree(x, y, self.weights(to_end, k))
            inner = table[:, 0] >= 0
            table[inner, 2] += size
            table[~inner, 3] += entries
            roots.append(size)
            nodes.append(table)
            labels.append(held[0])
            weights.append(held[1])
            size, entries = size + len(table), entries + len(held[0])
        parts = [roots, np.concatenate(nodes).ravel(), *labels, *weights]
        return np.concatenate([[self.trees, size], *parts]).astype(float)

    def _tree(self, x, y, w):
        """Nodes, and the labels and weights of the leaves one after the other."""
        bag = np.flatnonzero(w > 0)
        if not len(bag):  # a draw without rows: one leaf of all rows
            bag, w = np.arange(len(y)), np.ones(len(y))
        x, y, w = x[bag], y[bag], w[bag]
        centred = w * (y - np.average(y, weights=w))
        nodes = [[-1.0, 0.0, 0.0, 0.0]]
        held: tuple[list, list] = ([], [])
        order = np.argsort(x, axis=0, kind="stable").T  # columns by open rows
        own = np.zeros(len(y), dtype=np.int64)  # open node of every row
        open_nodes = np.array([0])
        depth = 0
        while len(open_nodes):
            rows_node = own[order[0]]
            starts = np.searchsorted(rows_node, np.arange(len(open_nodes)))
            last = self.depth is not None and depth >= self.depth
            column, cut = self._cuts(x, order, rows_node, starts, w, centred, last)
            going = column >= 0
            ends = np.append(starts[1:], len(rows_node))
            for k in np.flatnonzero(~going):
                rows = order[0, starts[k] : ends[k]]
                node = nodes[open_nodes[k]]
                node[1], node[3] = len(rows), sum(map(len, held[0]))
                held[0].append(y[rows])
                held[1].append(w[rows])
            children = np.full(len(open_nodes), -1)
            for k in np.flatnonzero(going):
                nodes[open_nodes[k]][:3] = [column[k], cut[k], len(nodes)]
                children[k] = len(nodes)
                nodes += [[-1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0]]
            # rows of cut nodes go on, numbered by child; the order by value stays
            stays = order[:, going[own[order[0]]]] if going.all() else None
            keep = going[own]
            stays = order[keep[order]].reshape(len(order), -1) if stays is None else stays
            number = np.cumsum(going) - 1
            right = x[np.arange(len(y)), np.maximum(column[own], 0)] > cut[own]
            own = np.where(keep, 2 * number[own] + right, 0)
            by_child = np.argsort(own[stays], axis=1, kind="stable")
            order = np.take_along_axis(stays, by_child, axis=1)
            open_nodes = (children[going][:, None] + np.arange(2)).ravel()
            depth += 1
        return np.array(nodes), (np.concatenate(held[0]), np.concatenate(held[1]))

    def _cuts(self, x, order, node, starts, w, wy, last):
        """Column (-1 for a leaf) and value of the best cut of every open node."""
        none = np.full(len(starts), -1), np.zeros(len(starts))
        if last or order.shape[1] < 2:
            return none
        value = np.take_along_axis(x.T, order, axis=1)
        weight, total = np.cumsum(w[order], axis=1), np.cumsum(wy[order], axis=1)
        ends = np.append(starts[1:], order.shape[1]) - 1
        before_w = np.where(starts > 0, weight[:, starts - 1], 0.0)
        before_t = np.where(starts > 0, total[:, starts - 1], 0.0)
        n, g = weight[:, ends] - before_w, total[:, ends] - before_t
        nl, gl = weight - before_w[:, node], total - before_t[:, node]
        nr, gr = n[:, node] - nl, g[:, node] - gl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gl**2 / nl + gr**2 / nr - (g**2 / n)[:, node]
        good = np.zeros(gain.shape, dtype=bool)
        good[:, :-1] = (value[:, :-1] < value[:, 1:]) & (node[:-1] == node[1:])
        gain[~good | (nl < self.min_child) | (nr < self.min_child)] = -np.inf
        best = np.maximum.reduceat(gain, starts, axis=1)
        column = best.argmax(axis=0)
        top = best[column, np.arange(len(starts))]
        square = np.add.reduceat((wy**2 / w)[order[0]], starts)
        column = np.where(top > SMALLEST_GAIN * square, column, -1)
        place = np.arange(order.shape[1])
        hit = gain[np.maximum(column, 0)[node], place] == top[node]
        at = np.minimum.reduceat(np.where(hit, place, order.shape[1] - 2), starts)
        row = np.maximum(column, 0)
        low, high = value[row, at], value[row, np.minimum(at + 1, order.shape[1] - 1)]
        middle = low + (high - low) / 2
        return column, np.where(middle < high, middle, low)

    # --- the model -----------------------------------------------------------------------

    def _tables(self, params):
        params = np.asarray(params)
        trees, size = int(params[0]), int(params[1])
        roots = params[2 : 2 + trees].astype(np.int64)
        cut = 2 + trees + size * NODE
        nodes = params[2 + trees : cut].reshape(size, NODE)
        labels, weights = params[cut:].reshape(2, -1)
        return roots, nodes, labels, weights

    def predict(self, x: np.ndarray, params: np.ndarray, aux: np.ndarray) -> np.ndarray:
        roots, nodes, labels, weights = self._tables(params)
        leaves = walk(np.asarray(x, dtype=float), roots, nodes)
        out = np.empty((len(leaves), len(self.levels)))
        for i, leaf in enumerate(leaves):
            count, start = nodes[leaf, 1].astype(np.int64), nodes[leaf, 3].astype(np.int64)
            at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
            share = weights[at] / np.repeat(np.add.reduceat(weights[at], np.cumsum(count) - count), count)
            order = np.argsort(labels[at], kind="stable")
            cdf = np.cumsum(share[order]) / len(roots)
            k = np.searchsorted(cdf, np.asarray(self.levels) - 1e-12)
            out[i] = labels[at][order][np.minimum(k, len(order) - 1)]
        return out
