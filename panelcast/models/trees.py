"""Quantile boosting on binned features.

A tree grows from sums of gradients per (leaf, feature, bin).  Leaves wait with their
histograms: only the smaller child of a split is summed, its sibling is the difference.  All
quantile levels of a model grow their trees side by side.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.config import LEVELS
from panelcast.models.passes import PACK_ROWS, fit
from panelcast.operators.blocks import BLOCK, block_of
from panelcast.operators.panel import SERIES

LABEL_BINS = 256  # quantiles of the label that the first prediction is read from
RESIDUAL_BINS = 1024  # finer near zero, see residual_bin
NODE = 4  # feature (-1 in a leaf), largest value that goes left, left child, value
SMALLEST_GAIN = 1e-9
SKETCH_K = 800


# --- bins -----------------------------------------------------------------------------------


def exact_constants(x: np.ndarray, y: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of the inner bins per feature, then the label grid."""
    inner = np.arange(1, bins) / bins
    edges = np.quantile(x, inner, axis=0, method="inverted_cdf").T
    return np.concatenate([edges.ravel(), label_grid(y)])


def label_grid(y: np.ndarray) -> np.ndarray:
    return np.quantile(y, np.linspace(0, 1, LABEL_BINS + 1), method="inverted_cdf")


def sketched_constants(
    frame: DataFrame, models: DataFrame, names: tuple[str, ...], bins: int, target: str = "y"
) -> DataFrame:
    """``series_id, fold, aux`` as :func:`exact_constants`, from mergeable sketches.

    One sketch per (series, block) and column serves all folds that hold the whole block;
    only the blocks at a window's two ends are sketched for the fold itself.  No row is
    copied per fold.
    """
    columns = [*names, target]
    clean = frame.dropna("any", subset=columns).withColumn(BLOCK, block_of("idx", PACK_ROWS))
    cells = [F.col(c).cast("double") for c in columns]
    sketches = [F.kll_sketch_agg_double(c, SKETCH_K).alias(f"_s{i}") for i, c in enumerate(cells)]
    whole = clean.groupBy(SERIES, BLOCK).agg(*sketches)
    a, b = block_of("first", PACK_ROWS), block_of("last", PACK_ROWS)
    folds = models.select(SERIES, "fold", "first", "last", F.explode(F.sequence(a, b)).alias(BLOCK))
    start = F.col(BLOCK) * PACK_ROWS
    inside = (start >= F.col("first")) & (start + PACK_ROWS - 1 <= F.col("last"))
    full = whole.join(folds.filter(inside), [SERIES, BLOCK])
    part = clean.join(folds.filter(~inside), [SERIES, BLOCK])
    ends = (
        part.filter(F.col("idx").between(F.col("first"), F.col("last")))
        .groupBy(SERIES, "fold", BLOCK)
        .agg(*sketches)
    )
    kept = [SERIES, "fold", *(f"_s{i}" for i in range(len(columns)))]
    merged = (
        full.select(kept)
        .unionByName(ends.select(kept))
        .groupBy(SERIES, "fold")
        .agg(*(F.kll_merge_agg_double(f"_s{i}", SKETCH_K).alias(f"_s{i}") for i in range(len(columns))))
    )
    inner = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    grid = F.array(*[F.lit(i / LABEL_BINS) for i in range(LABEL_BINS + 1)])
    parts = [F.kll_sketch_get_quantile_double(f"_s{i}", inner) for i in range(len(names))]
    parts.append(F.kll_sketch_get_quantile_double(f"_s{len(names)}", grid))
    return merged.select(SERIES, "fold", F.concat(*parts).alias("aux"))


def split_aux(aux: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature edges (features by inner edges) and the label grid."""
    cut = len(aux) - (LABEL_BINS + 1)
    return aux[:cut].reshape(features, -1), aux[cut:]


def to_bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One byte per value, where there are no more than 256 bins."""
    out = np.empty(x.shape, dtype=np.uint8 if edges.shape[1] < 256 else np.uint16)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(edges[j], x[:, j], side="left")
    return out


def uniform(idx: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) per row that depends only on the row and the seed."""
    z = idx.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0**64


def residual_bin(r: np.ndarray, span: float) -> np.ndarray:
    """Bins finer near zero: square root of the residual over twice the label range."""
    u = np.sign(r) * np.sqrt(np.minimum(np.abs(r) / span, 1.0))
    return np.minimum(((u + 1) / 2 * RESIDUAL_BINS).astype(np.int64), RESIDUAL_BINS - 1)


def residual_quantiles(counts: np.ndarray, span: float, tau: float) -> np.ndarray:
    """Quantile of each row of residual counts; 0 where there are none."""
    cdf = np.cumsum(counts, axis=1)
    total = cdf[:, -1]
    k = (cdf < tau * total[:, None]).sum(axis=1).clip(max=RESIDUAL_BINS - 1)
    rows = np.arange(len(counts))
    inside = counts[rows, k]
    part = (tau * total - (cdf[rows, k] - inside)) / np.maximum(inside, 1e-12)
    u = 2 * (k + part.clip(0, 1)) / RESIDUAL_BINS - 1
    return np.where(total > 0, np.sign(u) * u * u * span, 0.0)


# --- rows and trees -------------------------------------------------------------------------


class Growing:
    """A tree: its nodes, the open leaves' histograms (counts and gradients up to each bin)
    and what is summed next.  Each level has its own, but for symmetric growth, where all
    levels share one and a histogram holds the gradients of each."""

    def __init__(self):
        self.nodes = [[-1, 0, 0, 0.0]]  # feature, last bin that goes left, left child, value
        self.depth = [0]
        self.hist: dict[int, np.ndarray] = {}
        self.best: dict[int, tuple[float, int, int]] = {}  # gain, column, bin of open leaves
        self.wanted = [0]  # leaves to be summed
        self.sibling: dict[int, tuple[int, np.ndarray]] = {}

    def split(self, leaf: int, column: int, feature: int, cut: int) -> None:
        """Children follow one another; the one with fewer rows is to be summed."""
        left = len(self.nodes)
        self.nodes[leaf][:3] = [feature, cut, left]
        for _ in (0, 1):
            self.nodes.append([-1, 0, 0, 0.0])
            self.depth.append(self.depth[leaf] + 1)
        hist = self.hist.pop(leaf)
        self.best.pop(leaf, None)
        small = left if 2 * hist[0, column, cut] <= hist[0, column, -1] else left + 1
        self.wanted.append(small)
        self.sibling[small] = (2 * left + 1 - small, hist)

    def take(self, sums: np.ndarray) -> list[int]:
        """Histograms of the wanted leaves, and of their siblings by difference; summed up
        along the bins, which leaves differences right."""
        new = []
        for leaf, hist in zip(self.wanted, sums, strict=True):
            self.hist[leaf] = hist = np.cumsum(hist, axis=2)
            new.append(leaf)
            if leaf in self.sibling:
                other, parent = self.sibling.pop(leaf)
                self.hist[other] = parent - hist
                new.append(other)
        self.wanted = []
        return new

    def close(self) -> None:
        """No more splits."""
        self.wanted, self.hist, self.best, self.sibling = [], {}, {}, {}

    @property
    def leaves(self) -> int:
        return (len(self.nodes) + 1) // 2


class Rows:
    """Binned rows with the running score of all finished trees."""

    def __init__(self, bins, y, to_end, base, structures: int):
        self.bins, self.y, self.to_end = bins, y, to_end
        self.score = np.tile(base, (len(y), 1))  # rows by levels
        self.rounds = 0  # in the score
        self.structures = structures  # trees with nodes of their own: one, or one per level
        self._new_round()

    def _new_round(self) -> None:
        self.node = np.zeros((self.structures, len(self.y)), np.int32)
        self.known = [1] * self.structures
        self.drawn = None  # what is the same in all passes of a round

    def __getstate__(self):
        return self.bins, self.y, self.to_end, self.score, self.rounds, self.structures

    def __setstate__(self, state):
        self.bins, self.y, self.to_end, self.score, self.rounds, self.structures = state
        self._new_round()

    def follow(self, level: int, nodes: list) -> np.ndarray:
        """The leaf of every row, moved on by the splits made since the last call."""
        level = min(level, self.structures - 1)
        node, known = self.node[level], self.known[level]
        if known < len(nodes):
            for parent, (feature, cut, left, _) in enumerate(nodes):
                if feature >= 0 and left >= known:
                    at = np.flatnonzero(node == parent)
                    node[at] = left + (self.bins[at, feature] > cut)
            self.known[level] = len(nodes)
        return node

    def absorb(self, trees: list) -> None:
        """Add a round of finished trees, one per level, to the score."""
        for t, nodes in enumerate(trees):
            leaf = self.follow(t, nodes)
            self.score[:, t] += np.array([n[3] for n in nodes])[leaf]
        self.rounds += 1
        self._new_round()


class Boosting:
    """State of a fit between passes; ``finished`` starts at round ``kept``."""

    def __init__(self, base: np.ndarray, span: float, structures: int):
        self.base, self.span, self.structures = base, span, structures
        self.phase, self.round, self.kept = "grow", 0, 0
        self.finished: list[list] = []  # per round and level: nodes
        self.growing = [Growing() for _ in range(structures)]
        self.fresh = True  # the round's first pass, which scores the held-out rows
        self.best_loss, self.best_round = np.inf, 0


@dataclass(frozen=True)
class BoostedQuantile:
    """Gradient boosting of the pinball loss.

    ``growth``: ``leaf`` splits the open leaf with the largest gain until there are
    ``max_leaves``, ``depth`` splits every leaf of a depth, ``symmetric`` takes one split per
    depth for all leaves and all levels of quantiles; none goes beyond ``depth``.  Columns
    are drawn per tree, or per depth with ``column_draw="depth"``.  ``patience`` turns early
    stopping on the last ``holdout`` rows on.  Bins are quantiles of the rows that a model
    trains on; leaf values are residual quantiles read from ``RESIDUAL_BINS`` bins.
    """

    names: tuple[str, ...]
    levels: tuple[float, ...] = LEVELS
    rounds: int = 20
    depth: int = 3
    learning_rate: float = 0.3
    growth: str = "depth"
    max_leaves: int = 8
    min_child: int = 20
    penalty: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    column_draw: str = "tree"
    patience: int = 0
    holdout: int = 0
    bins: int = 255
    seed: int = 0
    kind: str = "boosted"
    keeps_rows: bool = True

    def __post_init__(self) -> None:
        if self.growth not in ("leaf", "depth", "symmetric"):
            raise ValueError(f"unknown growth: {self.growth}")
        if self.column_draw not in ("tree", "depth"):
            raise ValueError(f"unknown column draw: {self.column_draw}")

    @property
    def _structures(self) -> int:
        return 1 if self.growth == "symmetric" else len(self.levels)

    @property
    def passes_a_round(self) -> int:
        return 1 + (self.max_leaves - 1 if self.growth == "leaf" else self.depth)

    def fit(
        self, chunks: DataFrame, models: DataFrame, frame=None, target="y", local_values=None
    ) -> DataFrame:
        """``frame`` holds the unpacked rows, for the bins of windows that no task holds."""

        def constants(large: DataFrame) -> DataFrame:
            return sketched_constants(frame, large, self.names, self.bins, target)

        return fit(chunks, models, self, "boosted", constants, local_values)

    # --- what the engine calls -----------------------------------------------------------

    def states(self) -> tuple[type, ...]:
        return Boosting, Growing, Rows

    def constants(self, x, y) -> np.ndarray:
        return exact_constants(x, y, self.bins)

    def _base(self, aux) -> tuple[np.ndarray, float]:
        _, grid = split_aux(aux, len(self.names))
        base = np.interp(self.levels, np.linspace(0, 1, len(grid)), grid)
        return base, max(2.0 * (grid[-1] - grid[0]), 1e-12)

    def start(self, aux) -> Boosting:
        # without rows there are no constants: the model stays empty
        base = self._base(aux) if len(aux) else (np.empty(0), 1.0)
        return Boosting(*base, self._structures)

    def rows(self, x, y, to_end, aux) -> Rows:
        edges, _ = split_aux(aux, len(self.names))
        return Rows(to_bins(x, edges), y, to_end, self._base(aux)[0], self._structures)

    def keep(self, rows: Rows, work: Boosting) -> None:
        """Put the finished rounds into the rows' scores."""
        for trees in work.finished[rows.rounds - work.kept :]:
            rows.absorb(trees)

    def kept(self, work: Boosting) -> tuple[Boosting, list]:
        """The state without its finished rounds, and these."""
        finished, work.finished = work.finished, []
        work.kept = work.round
        return work, finished

    def sums(self, rows: Rows, work: Boosting) -> np.ndarray:
        self.keep(rows, work)
        held = rows.to_end < (self.holdout if self.patience else 0)
        taus = np.asarray(self.levels)
        loss = np.zeros(2)
        if work.fresh and held.any():
            r = rows.y[held, None] - rows.score[held]
            loss = np.array([np.maximum(taus * r, (taus - 1) * r).sum(), held.sum()])
        if work.phase == "score":
            return loss
        out = [loss]
        if work.phase == "leaves":
            for t in range(len(taus)):
                tree = work.growing[min(t, work.structures - 1)]
                leaf = rows.follow(t, tree.nodes)[~held].astype(np.int64)
                r = (rows.y - rows.score[:, t])[~held]
                cell = leaf * RESIDUAL_BINS + residual_bin(r, work.span)
                size = len(tree.nodes) * RESIDUAL_BINS
                out.append(np.bincount(cell, minlength=size).astype(float))
            return np.concatenate(out)
        if rows.drawn is None:
            use = ~held
            if self.subsample < 1:
                use &= uniform(rows.to_end, self.seed * 1000 + work.round) < self.subsample
            columns = self._columns(work.round)
            cells = rows.bins[:, columns] + np.arange(len(columns)) * self.bins
            rows.drawn = use, cells, (rows.y[:, None] <= rows.score).T
        use, cells, below = rows.drawn
        for t, tree in enumerate(work.growing):
            leaf = rows.follow(t, tree.nodes)
            for wanted in tree.wanted:
                at = (leaf == wanted) & use
                own = range(len(taus)) if work.structures == 1 else [t]
                out += self._histogram(cells, at, [(taus[i], below[i]) for i in own])
        return np.concatenate(out)

    def _histogram(self, cells, at, levels) -> list[np.ndarray]:
        """Counts, then summed gradients by level, per (column, bin); a gradient is tau or
        tau - 1."""
        size = cells.shape[1] * self.bins
        count = np.bincount(cells[at].ravel(), minlength=size)
        out = [count]
        for tau, below in levels:
            under = np.bincount(cells[at & below].ravel(), minlength=size)
            out.append(tau * count - under)
        return out

    def update(self, sums, work: Boosting, aux) -> tuple[Boosting, bool]:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self._update(sums, work)

    def _update(self, sums, work: Boosting) -> tuple[Boosting, bool]:
        loss, body = sums[:2], sums[2:]
        if work.fresh and self.patience and self._stop(loss, work):
            return work, True
        work.fresh = False
        if work.phase == "score":
            return work, True
        if work.phase == "grow":
            columns = self._columns(work.round)
            values = 1 + len(self.levels) // work.structures  # count and gradients
            size, at = len(columns) * self.bins * values, 0
            for tree in work.growing:
                n = len(tree.wanted)
                part = body[at : at + n * size].reshape(n, values, len(columns), self.bins)
                at += n * size
                new = tree.take(part)
                if self.growth != "symmetric":
                    self._rate(tree, new, work.round)
            self._grow(work, columns)
            if not any(tree.wanted for tree in work.growing):
                work.phase = "leaves"
            return work, False
        at, done = 0, []
        for t, tau in enumerate(self.levels):
            nodes = work.growing[min(t, work.structures - 1)].nodes
            n = len(nodes)
            counts = body[at : at + n * RESIDUAL_BINS].reshape(n, RESIDUAL_BINS)
            at += n * RESIDUAL_BINS
            values = self.learning_rate * residual_quantiles(counts, work.span, tau)
            done.append(
                [[*node[:3], float(v) if node[0] < 0 else 0.0] for node, v in zip(nodes, values, strict=True)]
            )
        work.finished.append(done)
        work.round += 1
        work.growing = [Growing() for _ in range(work.structures)]
        work.phase, work.fresh = "grow", True
        if not self.patience:
            work.best_round = work.round
        if work.round == self.rounds:
            work.phase = "score"
        return work, work.round == self.rounds and not self.patience

    def _stop(self, loss, work: Boosting) -> bool:
        if not loss[1]:
            raise ValueError("no rows are held out for early stopping")
        mean = loss[0] / loss[1]
        if mean < work.best_loss:
            work.best_loss, work.best_round = mean, work.round
        return work.round - work.best_round >= self.patience

    # --- growth --------------------------------------------------------------------------

    def _columns(self, rnd: int) -> np.ndarray:
        """The columns that a round's trees may use."""
        p = len(self.names)
        if self.colsample >= 1 or self.column_draw == "depth":
            return np.arange(p)
        return np.sort(np.random.default_rng([self.seed, rnd]).permutation(p)[: self._drawn])

    @property
    def _drawn(self) -> int:
        return max(1, round(self.colsample * len(self.names)))

    def _allowed(self, rnd: int, depth: int) -> np.ndarray | slice:
        """Of a round's columns those that a depth may use."""
        if self.colsample >= 1 or self.column_draw == "tree":
            return slice(None)
        rng = np.random.default_rng([self.seed, rnd, depth])
        return np.sort(rng.permutation(len(self.names))[: self._drawn])

    def _gains(self, left: np.ndarray) -> np.ndarray:
        """Gain of every (column, bin) as a cut; -inf where it may not be made."""
        n, nl = left[0, 0, -1], left[0]
        nr = n - nl
        below = above = whole = 0.0
        for gl in left[1:]:  # one level, or all that share the tree
            g = gl[0, -1]
            gr = g - gl
            below, above, whole = below + gl * gl, above + gr * gr, whole + g * g
        gain = below / (nl + self.penalty) + above / (nr + self.penalty)
        gain -= whole / max(n + self.penalty, 1e-12)
        gain[(nl < self.min_child) | (nr < self.min_child)] = -np.inf
        return gain

    def _place(self, at: int, allowed: np.ndarray | slice) -> tuple[int, int]:
        """Column and bin of a place in the gains of the allowed columns."""
        column, cut = divmod(at, self.bins)
        return (column if isinstance(allowed, slice) else int(allowed[column])), cut

    def _rate(self, tree: Growing, leaves: list[int], rnd: int) -> None:
        for leaf in leaves:
            hist = tree.hist[leaf]
            if tree.depth[leaf] >= self.depth or hist[0, 0, -1] < 2 * self.min_child:
                continue
            allowed = self._allowed(rnd, tree.depth[leaf])
            gain = self._gains(hist[:, allowed])
            at = int(gain.argmax())
            top = float(gain.flat[at])
            if top > SMALLEST_GAIN:
                tree.best[leaf] = (top, *self._place(at, allowed))

    def _grow(self, work: Boosting, columns: np.ndarray) -> None:
        if self.growth == "symmetric":
            self._grow_together(work, columns)
            return
        for tree in work.growing:
            if self.growth == "leaf":
                chosen = sorted(tree.best, key=lambda leaf: -tree.best[leaf][0])[:1]
                if tree.leaves >= self.max_leaves:
                    chosen = []
            else:
                chosen = list(tree.best)
            for leaf in chosen:
                _, column, cut = tree.best[leaf]
                tree.split(leaf, column, int(columns[column]), cut)
            full = tree.leaves >= self.max_leaves and self.growth == "leaf"
            deep = self.growth == "depth" and max(tree.depth) >= self.depth
            if full or deep or not chosen:
                tree.close()

    def _grow_together(self, work: Boosting, columns: np.ndarray) -> None:
        """One cut for all open leaves; a leaf that cannot take it adds nothing to its gain."""
        tree = work.growing[0]
        depth = max(tree.depth)
        allowed = self._allowed(work.round, depth)
        joint = np.zeros(1)
        for hist in tree.hist.values():
            if hist[0, 0, -1] >= 2 * self.min_child:
                gain = self._gains(hist[:, allowed])
                joint = joint + np.where(np.isfinite(gain), gain, 0.0)
        at = int(np.argmax(joint))
        if np.ravel(joint)[at] > SMALLEST_GAIN:
            column, cut = self._place(at, allowed)
            for leaf in list(tree.hist):
                tree.split(leaf, column, int(columns[column]), cut)
            if depth + 1 < self.depth:
                return
        tree.close()

    # --- the model -----------------------------------------------------------------------

    def params(self, work: Boosting, aux, earlier: list = ()) -> np.ndarray:
        """``rounds used, base, roots (rounds by levels), nodes``; cuts as feature values."""
        if not len(work.base):
            return np.empty(0)
        edges, _ = split_aux(aux, len(self.names))
        edges = np.column_stack([edges, np.full(len(edges), np.inf)])
        trees = [nodes for rnd in [*earlier, *work.finished][: work.best_round] for nodes in rnd]
        sizes = [len(nodes) for nodes in trees]
        roots = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(float)
        table = np.array([n for nodes in trees for n in nodes], dtype=float).reshape(-1, NODE)
        inner = table[:, 0] >= 0
        table[inner, 2] += np.repeat(roots, sizes)[inner]
        table[inner, 1] = edges[table[inner, 0].astype(int), table[inner, 1].astype(int)]
        return np.concatenate([[work.best_round], work.base, roots, table.ravel()])

    def _tables(self, params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        params, t = np.asarray(params), len(self.levels)
        rounds = int(params[0])
        base, rest = params[1 : 1 + t], params[1 + t :]
        return base, rest[: rounds * t].astype(np.int64), rest[rounds * t :].reshape(-1, NODE)

    def predict(self, x: np.ndarray, params: np.ndarray, aux: np.ndarray) -> np.ndarray:
        base, roots, nodes = self._tables(params)
        leaf = walk(np.asarray(x, dtype=float), roots, nodes)
        values = nodes[leaf, 3].reshape(len(x), -1, len(self.levels))
        return base + values.sum(axis=1)

    def but_rounds(self) -> BoostedQuantile | None:
        """What a longer fit must share with this one to hold it as its beginning."""
        return self if self.patience else replace(self, rounds=0)

    def shortened(self, params: np.ndarray) -> np.ndarray:
        """The model after ``rounds`` rounds, from one of more rounds."""
        base, roots, nodes = self._tables(params)
        kept = min(self.rounds, int(params[0])) * len(self.levels)
        end = roots[kept] if kept < len(roots) else len(nodes)
        rounds = kept // len(self.levels)
        return np.concatenate([[rounds], base, roots[:kept], nodes[:end].ravel()])

    def importance(self, params) -> np.ndarray:
        """Splits per level and feature."""
        _, roots, nodes = self._tables(params)
        out = np.zeros((len(self.levels), len(self.names)))
        level = np.arange(len(roots)) % len(self.levels)
        own = np.searchsorted(roots, np.arange(len(nodes)), side="right") - 1
        inner = nodes[:, 0] >= 0
        np.add.at(out, (level[own[inner]], nodes[inner, 0].astype(int)), 1)
        return out


def walk(x: np.ndarray, roots: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The leaf of every row in every tree."""
    at = np.tile(roots, (len(x), 1))
    rows = np.arange(len(x))[:, None]
    while True:
        feature = nodes[at, 0].astype(np.int64)
        inner = feature >= 0
        if not inner.any():
            return at
        right = x[rows, np.maximum(feature, 0)] > nodes[at, 1]
        at = np.where(inner, nodes[at, 2].astype(np.int64) + right, at)
