"""Scores of quantile forecasts, per fold and over folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.config import LEVELS, QCOLS
from panelcast.operators.panel import SERIES


def _lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def pinball(y: Column, q: Column, tau: float | Column) -> Column:
    tau = _lit(tau)
    return F.greatest(tau * (y - q), (tau - 1.0) * (y - q))


def interval_score(y: Column, lower: Column, upper: Column, alpha: float) -> Column:
    """Width plus a penalty for observations outside."""
    below = F.when(y < lower, lower - y).otherwise(F.lit(0.0))
    above = F.when(y > upper, y - upper).otherwise(F.lit(0.0))
    return (upper - lower) + (2.0 / alpha) * (below + above)


def interval_score_from_pinball(alpha: float, lower: Column, upper: Column) -> Column:
    return (lower + upper) / alpha


def covered(y: Column, lower: Column, upper: Column, closed: bool = True) -> Column:
    inside = (y >= lower) & (y <= upper) if closed else (y > lower) & (y < upper)
    return inside.cast("double")


def scored(predictions: DataFrame) -> DataFrame:
    """Rows that have an actual value."""
    return predictions.filter(F.col("y").isNotNull())


def fold_scores(predictions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """All losses of a fold in one aggregate over the predictions.

    ``pinball_loss`` is the sum over levels, the interval scores are derived
    from the losses.
    """
    keys = keys or [SERIES, "fold"]
    y = F.col("y")
    losses = [
        F.avg(pinball(y, F.col(c), q)).alias(f"loss_{c}")
        for c, q in zip(QCOLS, LEVELS, strict=True)
    ]
    hits = [F.avg((y <= F.col(c)).cast("double")).alias(f"hit_{c}") for c in QCOLS]
    base = (
        scored(predictions)
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            *losses,
            *hits,
            F.avg(covered(y, F.col("q25"), F.col("q75"))).alias("coverage_50"),
            F.avg(covered(y, F.col("q025"), F.col("q975"))).alias("coverage_95"),
        )
    )
    total = F.col("loss_q025")
    for c in QCOLS[1:]:
        total = total + F.col(f"loss_{c}")
    return base.withColumns(
        {
            "pinball_loss": total,
            "interval_score_50": interval_score_from_pinball(
                0.5, F.col("loss_q25"), F.col("loss_q75")
            ),
            "interval_score_95": interval_score_from_pinball(
                0.05, F.col("loss_q025"), F.col("loss_q975")
            ),
        }
    )


SAMPLE_METRICS = ("pinball_loss", "interval_score_50", "interval_score_95")
COVERAGE_METRICS = ("coverage_50", "coverage_95")


def _long(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide mean/std pairs to rows ``(metric, mean, std)``."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"{m}_mean").alias("mean"),
                F.col(f"{m}_std").alias("std"),
            )
            for m in metrics
        ]
    )
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def metrics_table(folds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and spread over folds: sample deviation for losses, population for coverage."""
    keys = [SERIES] if keys is None else keys
    aggs = []
    for m in SAMPLE_METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    for m in COVERAGE_METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    wide = folds.groupBy(*keys).agg(*aggs)
    return _long(wide, keys, [*SAMPLE_METRICS, *COVERAGE_METRICS])


def level_metrics(folds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean and sample deviation of the loss of every level."""
    keys = [SERIES] if keys is None else keys
    aggs = []
    for c in QCOLS:
        name = f"loss_{c}"
        aggs += [F.avg(name).alias(f"{name}_mean"), F.stddev_samp(name).alias(f"{name}_std")]
    return _long(folds.groupBy(*keys).agg(*aggs), keys, [f"loss_{c}" for c in QCOLS])


def calibration(
    folds: DataFrame, keys: list[str] | None = None, divisor: str = "folds"
) -> DataFrame:
    """Share of observations at or below each level: mean and deviation over folds."""
    if divisor not in ("folds", "samples"):
        raise ValueError("divisor must be 'folds' or 'samples'")
    keys = [SERIES] if keys is None else keys
    aggs = []
    for c in QCOLS:
        var = F.var_pop(f"hit_{c}")
        if divisor == "samples":
            var = var * F.count("*") / F.sum("n")
        aggs += [F.avg(f"hit_{c}").alias(f"{c}_mean"), F.sqrt(var).alias(f"{c}_std")]
    wide = folds.groupBy(*keys).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(q).alias("level"),
                F.col(f"{c}_mean").alias("mean"),
                F.col(f"{c}_std").alias("std"),
            )
            for c, q in zip(QCOLS, LEVELS, strict=True)
        ]
    )
    return wide.select(*keys, F.explode(rows).alias("p")).select(*keys, "p.*")


def losses_long(folds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Wide losses per level to rows ``(quantile, loss)``."""
    keys = keys or [SERIES, "fold"]
    cells = [F.col(f"loss_{c}").alias(c) for c in QCOLS]
    return folds.select(*keys, *cells).unpivot(keys, list(QCOLS), "quantile", "loss")


# --- reshape ---------------------------------------------------------------------


def predictions_long(predictions: DataFrame, ids: list[str]) -> DataFrame:
    """Wide quantile columns to rows ``(level, yhat)``."""
    long = predictions.unpivot(ids, list(QCOLS), "q", "yhat")
    level = F.create_map(*[F.lit(v) for pair in zip(QCOLS, LEVELS, strict=True) for v in pair])
    return long.withColumn("level", level[F.col("q")]).drop("q")


def predictions_wide(long: DataFrame, ids: list[str]) -> DataFrame:
    """Rows ``(level, yhat)`` to one column per level."""
    cells = [
        F.max(F.when(F.col("level") == q, F.col("yhat"))).alias(c)
        for c, q in zip(QCOLS, LEVELS, strict=True)
    ]
    return long.groupBy(*ids).agg(*cells)


def require_levels(levels) -> None:
    if tuple(levels) != LEVELS:
        raise ValueError(f"quantile levels must be {list(LEVELS)}")


def intervals(predictions: DataFrame, ids: list[str], levels=LEVELS) -> DataFrame:
    """Median and the central 50 % and 95 % intervals as rows."""
    require_levels(levels)
    rows = F.array(
        F.struct(F.lit(0.5).alias("coverage"), F.col("q25").alias("lower"), F.col("q75").alias("upper")),
        F.struct(F.lit(0.95).alias("coverage"), F.col("q025").alias("lower"), F.col("q975").alias("upper")),
    )
    return predictions.select(*ids, F.col("q50").alias("median"), F.explode(rows).alias("i")).select(
        *ids, "median", "i.*"
    )


def rearrange(predictions: DataFrame, cols: tuple[str, ...] = QCOLS) -> DataFrame:
    """Sort the quantiles of every row so that they do not cross."""
    return predictions.withColumn("_q", F.array_sort(F.array(*cols))).withColumns(
        {c: F.col("_q")[i] for i, c in enumerate(cols)}
    ).drop("_q")
