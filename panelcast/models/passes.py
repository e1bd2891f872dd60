"""Fitting many models at once: in one task each where its rows fit, else pass by pass.

A learner states how statistics of rows add up and how a model changes with the sums.  The
same two functions run in a loop inside a task, for all models whose window fits there, or
as Spark jobs over blocks of rows, for those whose window does not.
"""

from __future__ import annotations

import io
import pickle
import time
from collections.abc import Iterator
from functools import reduce
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.blocks import BLOCK, block_of
from panelcast.operators.folds import Splitter, n_folds
from panelcast.operators.panel import SERIES
from panelcast.session import drop_stage, stage

PACK_ROWS = 512
LOCAL_VALUES = 8_000_000  # doubles of the rows that a task holds to fit models on them
FOLDS_PER_TASK = 16  # at most, so that a row is sent to few tasks
BUCKET, GROUP, SETTING = "bucket", "_group", "setting"
MODELS_PER_BUCKET = 16  # on average, updated in one call
FLUSH_VALUES = 8_000_000  # doubles held by a task before partial sums are handed on
KEEP_ROUNDS = 8  # finished trees sent along with a pass before they go into the rows

KEYS = f"{SERIES} string, fold long, first long, last long"
MODEL_SCHEMA = f"{KEYS}, done boolean, seconds double, aux array<double>, params array<double>"
WORK_SCHEMA = f"{KEYS}, done boolean, seconds double, aux array<double>, work binary"
STATS_SCHEMA = f"{SERIES} string, fold long, seconds double, stats array<double>"
ROWS_SCHEMA = f"{SERIES} string, fold long, {BLOCK} long, state binary"


class Learner(Protocol):
    """What a model must state to be fitted."""

    names: tuple[str, ...]
    keeps_rows: bool  # whether rows carry a state of their own from pass to pass

    def constants(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Constants of a fit, from all its rows; the ``aux`` of a model fitted in a task."""

    def start(self, aux: np.ndarray) -> Any:
        """What is known before the first pass."""

    def rows(self, x: np.ndarray, y: np.ndarray, to_end: np.ndarray, aux: np.ndarray) -> Any:
        """Rows made ready; ``to_end`` counts the steps to the window's last one."""

    def sums(self, rows: Any, work: Any) -> np.ndarray:
        """Statistics that add up over blocks of rows."""

    def update(self, sums: np.ndarray, work: Any, aux: np.ndarray) -> tuple[Any, bool]:
        """The next state, and whether the model is done."""

    def params(self, work: Any, aux: np.ndarray) -> np.ndarray:
        """The finished model."""

    def states(self) -> tuple[type, ...]:
        """The classes that states are made of."""


class _Pickler(pickle.Pickler):
    """Instances of a learner's state classes go by name: the package travels with the
    functions, so a task's classes are not those that an import would find."""

    def persistent_id(self, obj):
        name = type(obj).__name__
        if name not in self.names:
            return None
        own = getattr(obj, "__getstate__", None)
        return name, (own() if own else obj.__dict__)


def dumps(learner: Learner, state: Any) -> bytes:
    out = io.BytesIO()
    pickler = _Pickler(out, protocol=pickle.HIGHEST_PROTOCOL)
    pickler.names = {c.__name__ for c in learner.states()}
    pickler.dump(state)
    return out.getvalue()


class _Unpickler(pickle.Unpickler):
    def persistent_load(self, pid):
        name, state = pid
        obj = object.__new__(self.classes[name])
        if hasattr(obj, "__setstate__"):
            obj.__setstate__(state)
        else:
            obj.__dict__.update(state)
        return obj


def loads(learner: Learner, raw: bytes) -> Any:
    unpickler = _Unpickler(io.BytesIO(raw))
    unpickler.classes = {c.__name__: c for c in learner.states()}
    return unpickler.load()


def pack(
    frame: DataFrame, names: list[str], target: str = "y", incomplete: bool = False
) -> DataFrame:
    """Rows ``(series, idx, y, x...)`` to one row per block of ``PACK_ROWS`` positions.

    Rows with a missing feature or label are left out, as in training; ``incomplete`` keeps
    those that miss a feature, as NaN.
    """
    missing = F.lit(float("nan"))
    x = F.array(*[F.coalesce(F.col(n).cast("double"), missing) for n in names])
    needed = [target] if incomplete else [*names, target]
    rows = frame.dropna("any", subset=needed).select(
        SERIES,
        block_of("idx", PACK_ROWS).alias(BLOCK),
        F.struct(F.col("idx"), F.col(target).cast("double").alias("y"), x.alias("x")).alias("r"),
    )
    packed = rows.groupBy(SERIES, BLOCK).agg(F.sort_array(F.collect_list("r")).alias("r"))
    return packed.select(
        SERIES,
        BLOCK,
        F.col("r.idx").alias("idx"),
        F.col("r.y").alias("y"),
        F.flatten("r.x").alias("x"),
    )


def fold_models(grid: DataFrame, splitter: Splitter, reach: int) -> DataFrame:
    """An empty model per series and fold.

    A fold trains on the rows of its window whose whole look-back lies in it.
    """
    p = splitter.params
    sizes = [F.max(c).alias(c) for c in ("n_rows", *p.columns)]
    series = grid.groupBy(SERIES).agg(*sizes)
    folds = (
        series.withColumn("_k", n_folds(F.col("n_rows"), p))
        .filter("_k > 0")
        .withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    )
    start = F.col("fold") * p.step_length if splitter.kind == "sliding" else F.lit(0)
    last = (p.window - 1) + F.col("fold") * p.step_length
    return _empty(folds.withColumns({"first": start + reach, "last": last}))


def final_models(grid: DataFrame, reach: int, target: str = "y") -> DataFrame:
    """One empty model per series, for all rows up to its last target (fold 0)."""
    last = F.max(F.when(F.col(target).isNotNull(), F.col("idx")))
    series = grid.groupBy(SERIES).agg(last.alias("last"))
    return _empty(series.withColumns({"fold": F.lit(0).cast("long"), "first": F.lit(reach)}))


def _empty(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<double>")
    return df.select(
        F.col(SERIES).cast("string").alias(SERIES),
        "fold",
        F.col("first").cast("long").alias("first"),
        F.col("last").cast("long").alias("last"),
        F.lit(False).alias("done"),
        F.lit(0.0).alias("seconds"),
        none.alias("aux"),
        none.alias("params"),
    )


def require_fitted(models: DataFrame) -> None:
    """A model without parameters had no rows to train on: too short a series or window."""
    short = models.filter(F.size("params") == 0).select(SERIES, "fold").limit(5).collect()
    if short:
        which = ", ".join(f"{r[SERIES]} (fold {r['fold']})" for r in short)
        raise ValueError(f"too few rows to train on: {which}")


def fit(
    chunks: DataFrame,
    models: DataFrame,
    learner: Learner,
    label: str,
    constants: Any = None,
    local_values: int | None = None,
) -> DataFrame:
    """Fit every row of ``models`` on its window of ``chunks`` (both staged).

    Windows of up to ``local_values`` doubles are fitted in one job, each in the task that
    holds its rows; neighbouring folds of a series share a task and its rows.  Longer
    windows are fitted in passes over blocks, where no task holds a whole window;
    ``constants(models)`` gives their ``aux`` as ``(series_id, fold, aux)``.  ``seconds`` is
    the time spent on a model in Python, summed over tasks.
    """
    limit = max(1, (local_values or LOCAL_VALUES) // max(1, len(learner.names)))
    length = F.col("last") - F.col("first") + 1
    count, longest = models.agg(F.count(F.lit(1)), F.max(length)).first()
    if not count or longest is None:
        return models
    small = models.filter(length <= limit).withColumn(SETTING, F.lit(""))
    fitted = _in_tasks(chunks, small, {"": learner}, learner.names, count, limit).drop(SETTING)
    if longest > limit:
        large = models.filter(length > limit)
        if constants is not None:
            large = _with_aux(large, stage(constants(large), f"{label}-constants"))
        fitted = fitted.unionByName(_in_passes(chunks, large, learner, label))
    return stage(fitted, label)


def fit_settings(
    chunks: DataFrame,
    models: DataFrame,
    learners: dict[str, Learner],
    names: tuple[str, ...],
    frame: DataFrame,
    target: str,
    label: str,
    local_values: int | None = None,
) -> DataFrame:
    """As :func:`fit`, for rows of ``models`` with a ``setting`` that names their learner.

    All settings of all series and folds are fitted in one job.  ``chunks`` holds every
    column that a learner needs (``names``), rows without some of them included; a learner
    trains on the rows that have its own.  Settings that differ in the number of rounds
    alone are one fit, cut to each length.  Windows that no task holds go through passes,
    one setting after the other.
    """
    longest_of, cut_from = _longest_rounds(learners)
    limit = max(1, (local_values or LOCAL_VALUES) // max(1, len(names)))
    length = F.col("last") - F.col("first") + 1
    wanted = models.filter(F.col(SETTING).isin(*longest_of))
    count, longest = wanted.agg(F.count(F.lit(1)), F.max(length)).first()
    small = wanted.filter(length <= limit)
    parts = [stage(_in_tasks(chunks, small, learners, names, count, limit), label)]
    if longest is not None and longest > limit:
        for name in longest_of:
            one = wanted.filter((F.col(SETTING) == name) & (length > limit)).drop(SETTING)
            own = pack(frame, list(learners[name].names), target)
            fitted = learners[name].fit(stage(own, "chunks"), stage(one, "folds"), frame, target)
            parts.append(fitted.withColumn(SETTING, F.lit(name)))
    fitted = reduce(DataFrame.unionByName, parts)
    return stage(fitted.mapInPandas(_cutter(learners, cut_from), fitted.schema), label)


def _longest_rounds(learners: dict[str, Learner]) -> tuple[list[str], dict[str, list[str]]]:
    """The settings to fit, and for each of them those it stands for."""
    groups: dict[Any, list[str]] = {}
    for name, learner in learners.items():
        rest = getattr(learner, "but_rounds", None)
        groups.setdefault(rest() if rest else name, []).append(name)
    stands = {max(g, key=lambda n: getattr(learners[n], "rounds", 0)): g for g in groups.values()}
    return list(stands), stands


def _cutter(learners: dict[str, Learner], stands: dict[str, list[str]]):
    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for name in stands[row[SETTING]]:
                    params = row["params"]
                    if name != row[SETTING] and len(params):
                        params = learners[name].shortened(np.asarray(params))
                    out.append({**row, SETTING: name, "params": params})
            yield pd.DataFrame(out, columns=pdf.columns)

    return run


def _with_aux(models: DataFrame, aux: DataFrame) -> DataFrame:
    cols = models.columns
    none = F.array().cast("array<double>")
    joined = models.drop("aux").join(aux, [SERIES, "fold"], "left")
    return joined.withColumn("aux", F.coalesce("aux", none)).select(cols)


# --- in one task ----------------------------------------------------------------------------


def fit_here(learner: Learner, x: np.ndarray, y: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """``params`` of one model from all its rows."""
    aux = learner.constants(x, y)
    whole = getattr(learner, "fit_whole", None)
    if whole is not None:  # a learner that has no passes
        return whole(x, y, to_end, aux)
    rows, work, done = learner.rows(x, y, to_end, aux), learner.start(aux), False
    while not done:
        work, done = learner.update(learner.sums(rows, work), work, aux)
    polish = getattr(learner, "polish", None)
    return learner.params(polish(rows, work) if polish else work, aux)


def _in_tasks(
    chunks: DataFrame,
    models: DataFrame,
    learners: dict[str, Learner],
    names: tuple[str, ...],
    count: int,
    limit: int,
) -> DataFrame:
    spark = chunks.sparkSession
    parallel = spark.sparkContext.defaultParallelism
    share = max(1, min(FOLDS_PER_TASK, count // (4 * parallel)))
    keys = [SERIES, SETTING, GROUP]
    models = models.withColumn(GROUP, F.floor(F.col("fold") / share).cast("long"))
    # folds whose windows together would be too long stay apart
    ends = models.groupBy(*keys).agg(F.min("first").alias("_a"), F.max("last").alias("_b"))
    apart = F.col("_b") - F.col("_a") + 1 > limit
    grouped = (
        models.join(ends, keys)
        .withColumn(GROUP, F.when(apart, -1 - F.col("fold")).otherwise(F.col(GROUP)))
        .drop("_a", "_b")
    )
    wanted = grouped.groupBy(*keys).agg(F.min("first").alias("a"), F.max("last").alias("b"))
    span = F.sequence(block_of("a", PACK_ROWS), block_of("b", PACK_ROWS))
    blocks = wanted.filter("a <= b").select(
        SERIES,
        F.col(SETTING).alias("_setting"),
        F.col(GROUP).alias("_part"),
        F.explode(span).alias(BLOCK),
    )
    # the number of partitions is given, as a few small groups would else share one task
    parts = int(max(parallel, min(2000, 8 * -(-count // share))))
    rows = chunks.join(blocks, [SERIES, BLOCK]).repartition(parts, SERIES, "_setting", "_part")
    grouped = grouped.repartition(parts, *keys)
    return (
        rows.groupBy(SERIES, "_setting", "_part")
        .cogroup(grouped.groupBy(*keys))
        .applyInPandas(_fitter(learners, names), f"{MODEL_SCHEMA}, {SETTING} string")
    )


def _fitter(learners: dict[str, Learner], names: tuple[str, ...]):
    places = {n: i for i, n in enumerate(names)}

    def run(key, blocks: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        idx, y, x = _joined(blocks.sort_values(BLOCK), len(names))
        if len(models):
            learner = learners[models[SETTING].iloc[0]]
            x = x[:, [places[n] for n in learner.names]]
            whole = ~np.isnan(x).any(axis=1)
            idx, y, x = idx[whole], y[whole], x[whole]
        seconds, params = [], []
        for first, last in zip(models["first"], models["last"], strict=True):
            start = time.perf_counter()
            a, b = np.searchsorted(idx, (first, last + 1))
            fitted = fit_here(learner, x[a:b], y[a:b], last - idx[a:b]) if a < b else []
            seconds.append(time.perf_counter() - start)
            params.append(fitted)
        return models.drop(columns=[GROUP]).assign(done=True, seconds=seconds, params=params)

    return run


def _joined(blocks: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, labels and features of blocks in order."""
    idx = np.concatenate([np.empty(0, np.int64), *blocks["idx"]])
    y = np.concatenate([np.empty(0), *blocks["y"]])
    x = np.concatenate([np.empty(0), *blocks["x"]])
    return idx, y, x.reshape(len(y), width)


# --- in passes ------------------------------------------------------------------------------


def _in_passes(chunks: DataFrame, models: DataFrame, learner: Learner, label: str) -> DataFrame:
    """One pass is one job: sums per model and task, then an update per model.

    Blocks of rows stay in memory in the partitioning that the join needs; only the state of
    the models moves.  Where rows carry a state (scores of finished trees), it is written
    again every ``KEEP_ROUNDS`` rounds, and the finished trees go to a table of their own, so
    that a pass costs the same however many came before.
    """
    models = stage(models.drop("params").mapInPandas(_starter(learner), WORK_SCHEMA), label)
    buckets = max(1, -(-models.count() // MODELS_PER_BUCKET))
    bucket = F.pmod(F.xxhash64(SERIES, "fold"), F.lit(buckets))
    update = _updater(learner)
    held = _Held(_carried(chunks, models, learner) if learner.keeps_rows else chunks, learner, label)
    passes, finished = 0, []
    often = KEEP_ROUNDS * learner.passes_a_round if learner.keeps_rows else 0
    try:
        while True:
            stats = held.sums(models.filter("not done")).withColumn(BUCKET, bucket)
            updated = (
                stats.groupBy(BUCKET)
                .cogroup(models.withColumn(BUCKET, bucket).groupBy(BUCKET))
                .applyInPandas(update, WORK_SCHEMA)
            )
            before, models = models, stage(updated, label)
            drop_stage(before)
            passes += 1
            if models.filter("not done").isEmpty():
                break
            if often and passes % often == 0:
                held.keep(models)
                kept = models.mapInPandas(_forgetter(learner), f"{WORK_SCHEMA}, finished binary")
                before, kept = models, stage(kept, f"{label}-kept")
                finished.append(kept.select(SERIES, "fold", F.lit(passes).alias("at"), "finished"))
                models = stage(kept.drop("finished"), label)
                drop_stage(before)
    finally:
        held.drop()
    one = F.struct("at", "finished")
    none = models.select(SERIES, "fold", F.lit(-1).alias("at"), F.lit(b"").alias("finished"))
    earlier = (
        reduce(DataFrame.unionByName, finished, none)
        .groupBy(SERIES, "fold")
        .agg(F.sort_array(F.collect_list(one))["finished"].alias("earlier"))
    )
    return models.join(earlier, [SERIES, "fold"]).mapInPandas(_finisher(learner), MODEL_SCHEMA)


class _Held:
    """The rows of the passes, staged and in memory."""

    def __init__(self, rows: DataFrame, learner: Learner, label: str):
        self.learner, self.label = learner, label
        self.keys = [SERIES, "fold", BLOCK] if learner.keeps_rows else [SERIES, BLOCK]
        self.files, self.rows = None, None
        self._hold(stage(rows, f"{label}-rows"))

    def _hold(self, files: DataFrame) -> None:
        self.drop()
        self.files = files
        parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = files.repartition(max(parts, files.rdd.getNumPartitions()), *self.keys).persist()

    def sums(self, models: DataFrame) -> DataFrame:
        if self.learner.keeps_rows:
            pairs = self.rows.join(on_blocks(models, "work"), self.keys)
            return pairs.mapInPandas(_summer(self.learner, _own_rows), STATS_SCHEMA)
        # folds share the rows of a block: each block once, beside all models that want it
        one = F.struct("fold", "first", "last", "aux", "work")
        spread = on_blocks(models, "first", "last", "aux", "work")
        wanted = spread.groupBy(SERIES, BLOCK).agg(F.sort_array(F.collect_list(one)).alias("m"))
        pairs = self.rows.join(wanted, self.keys)
        return pairs.mapInPandas(_summer(self.learner, _shared_rows), STATS_SCHEMA)

    def keep(self, models: DataFrame) -> None:
        pairs = self.rows.join(on_blocks(models, "work"), self.keys)
        self._hold(stage(pairs.mapInPandas(_keeper(self.learner), ROWS_SCHEMA), f"{self.label}-rows"))

    def drop(self) -> None:
        if self.files is not None:
            self.rows.unpersist()
            drop_stage(self.files)


def on_blocks(models: DataFrame, *more: str | Column) -> DataFrame:
    """A model beside each block of its window, so that a long window is many keys."""
    blocks = F.sequence(block_of("first", PACK_ROWS), block_of("last", PACK_ROWS))
    return models.select(SERIES, "fold", F.explode(blocks).alias(BLOCK), *more)


def _carried(chunks: DataFrame, models: DataFrame, learner: Learner) -> DataFrame:
    """Rows of each (series, fold, block), made ready for the learner."""
    width = len(learner.names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for block, row in zip(pdf[BLOCK], pdf.itertuples(index=False), strict=True):
                idx, y = np.asarray(row.idx), np.asarray(row.y)
                x = np.asarray(row.x, dtype=np.float64).reshape(len(y), width)
                a, b = np.searchsorted(idx, (row.first, row.last + 1))
                if a < b:
                    aux = np.asarray(row.aux)
                    ready = learner.rows(x[a:b], y[a:b], row.last - idx[a:b], aux)
                    out.append((getattr(row, SERIES), row.fold, block, dumps(learner, ready)))
            yield pd.DataFrame(out, columns=[SERIES, "fold", BLOCK, "state"])

    spread = on_blocks(models, "first", "last", "aux")
    return chunks.join(spread, [SERIES, BLOCK]).mapInPandas(run, ROWS_SCHEMA)


def _starter(learner: Learner):
    def run(batches):
        for pdf in batches:
            work = [dumps(learner, learner.start(np.asarray(a))) for a in pdf["aux"]]
            yield pdf.assign(work=work)

    return run


def _own_rows(row, learner: Learner):
    """The one model of a row's state."""
    yield int(row.fold), row.work, loads(learner, row.state)


def _shared_rows(row, learner: Learner):
    """The models that train on a block."""
    idx, y = np.asarray(row.idx), np.asarray(row.y)
    x = np.asarray(row.x, dtype=np.float64).reshape(len(y), len(learner.names))
    for m in row.m:
        a, b = np.searchsorted(idx, (m["first"], m["last"] + 1))
        if a < b:
            aux = np.asarray(m["aux"], dtype=np.float64)
            yield int(m["fold"]), m["work"], learner.rows(x[a:b], y[a:b], m["last"] - idx[a:b], aux)


def _summer(learner: Learner, parts):
    """Sum the statistics of every model over the blocks of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[str, int], list] = {}
        held = 0
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                start = time.perf_counter()
                for fold, work, rows in parts(row, learner):
                    stats = learner.sums(rows, loads(learner, work))
                    took, start = time.perf_counter() - start, time.perf_counter()
                    key = (getattr(row, SERIES), fold)
                    if key in sums:
                        sums[key][0] += took
                        sums[key][1] = sums[key][1] + stats
                    else:
                        sums[key] = [took, stats]
                        held += len(stats)
                if held > FLUSH_VALUES:
                    yield _frame(sums)
                    sums, held = {}, 0
        if sums:
            yield _frame(sums)

    return run


def _frame(sums: dict[tuple[str, int], list]) -> pd.DataFrame:
    rows = [(s, f, took, stats) for (s, f), (took, stats) in sums.items()]
    return pd.DataFrame(rows, columns=[SERIES, "fold", "seconds", "stats"])


def _updater(learner: Learner):
    """Update the models of one bucket from their sums."""

    def run(key, stats: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        totals: dict[tuple[str, int], list] = {}
        for s, f, took, part in zip(*(stats[c] for c in (SERIES, "fold", "seconds", "stats")), strict=True):
            k = (s, int(f))
            if k in totals:
                totals[k][0] += took
                totals[k][1] = totals[k][1] + part
            else:
                totals[k] = [took, np.asarray(part)]
        done, seconds, works = [], [], []
        for row in models.itertuples(index=False):
            start = time.perf_counter()
            total = totals.get((getattr(row, SERIES), int(row.fold)))
            if total is None:  # finished, or nothing to train on
                work, over, spent = row.work, True, 0.0
            else:
                state, over = learner.update(total[1], loads(learner, row.work), np.asarray(row.aux))
                work, spent = dumps(learner, state), total[0]
            works.append(work)
            done.append(bool(over))
            seconds.append(row.seconds + spent + time.perf_counter() - start)
        return models.drop(columns=BUCKET).assign(work=works, done=done, seconds=seconds)

    return run


def _keeper(learner: Learner):
    def run(batches):
        for pdf in batches:
            states = []
            for state, work in zip(pdf["state"], pdf["work"], strict=True):
                rows = loads(learner, state)
                learner.keep(rows, loads(learner, work))
                states.append(dumps(learner, rows))
            yield pdf.drop(columns="work").assign(state=states)

    return run


def _forgetter(learner: Learner):
    def run(batches):
        for pdf in batches:
            pairs = [learner.kept(loads(learner, w)) for w in pdf["work"]]
            works, finished = ([dumps(learner, p[i]) for p in pairs] for i in (0, 1))
            yield pdf.assign(work=works, finished=finished)

    return run


def _finisher(learner: Learner):
    def run(batches):
        for pdf in batches:
            params = []
            for work, aux, earlier in zip(pdf["work"], pdf["aux"], pdf["earlier"], strict=True):
                before = [trees for part in earlier if part for trees in loads(learner, part)]
                more = (before,) if learner.keeps_rows else ()
                params.append(learner.params(loads(learner, work), np.asarray(aux), *more))
            none = [[]] * len(pdf)
            yield pdf.drop(columns=["work", "earlier"]).assign(aux=none, params=params)

    return run
