"""Descriptive statistics of a panel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.blocks import BLOCK, HOME, with_halo
from panelcast.operators.panel import SERIES, attach_series
from panelcast.operators.quantiles import Ranked, grouped_quantiles
from panelcast.session import stage

QUARTILES = ([0.0, 0.25, 0.5, 0.75, 1.0], ["min", "q25", "q50", "q75", "max"])


def describe(df: DataFrame, keys: list[str], col: str = "y") -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles."""
    moments = df.groupBy(*keys).agg(
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
    )
    return moments.join(grouped_quantiles(df, keys, col, *QUARTILES), keys)


def five_numbers(df: DataFrame, keys: list[str], col: str = "y") -> DataFrame:
    """Box-plot table: quartiles, whiskers within 1.5 IQR, and outliers beyond."""
    ranked = Ranked(df, keys, col)
    box = ranked.quantiles(*QUARTILES).drop("min", "max")
    reach = (F.col("q75") - F.col("q25")) * 1.5
    fences = box.withColumns({"_lo": F.col("q25") - reach, "_hi": F.col("q75") + reach})
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    return (
        ranked.beside(fences)
        .groupBy(*keys, "q25", "q50", "q75")
        .agg(
            F.sum("_n").alias("n"),
            F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers"),
        )
    )


def autocorrelation(grid: DataFrame, lags: int, col: str = "y") -> DataFrame:
    """``sum((y_t - m)(y_{t-k} - m)) / sum((y_t - m)^2)`` for ``k = 0 .. lags``.

    A block of positions and the ``lags`` before it give one product of vectors per lag;
    missing values count as 0 there.  What leaves a block is one row with ``lags + 1`` sums.
    """
    stats = grid.groupBy(SERIES).agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.avg(col).alias("_m")
    )
    centred = (
        attach_series(grid, stats)
        .withColumn("_d", F.col(col) - F.col("_m"))
        .filter(F.col("_d").isNotNull())
        .select(SERIES, "pos", "_d")
    )
    halo = with_halo(centred, "pos", back=lags)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[HOME].to_numpy()
        if not own.any():
            return pd.DataFrame({SERIES: [], "sums": []})
        pos, d = pdf["pos"].to_numpy(), pdf["_d"].to_numpy()
        start = pos[own].min()
        here = np.zeros(pos[own].max() - start + 1)
        here[pos[own] - start] = d[own]
        line = np.concatenate([np.zeros(lags), here])
        before = ~own & (pos < start) & (pos >= start - lags)
        line[pos[before] - start + lags] = d[before]
        n = len(here)
        sums = [float(here @ line[lags - k : lags - k + n]) for k in range(lags + 1)]
        return pd.DataFrame({SERIES: [pdf[SERIES].iloc[0]], "sums": [sums]})

    blocks = halo.groupBy(SERIES, BLOCK).applyInPandas(products, f"{SERIES} string, sums array<double>")
    each = blocks.select(SERIES, F.posexplode("sums").alias("lag", "_s"))
    sums = each.groupBy(SERIES, F.col("lag").cast("long").alias("lag")).agg(F.sum("_s").alias("_s"))
    sums = stage(sums, "autocorrelation")  # a row per series and lag, read twice
    zero = sums.filter("lag = 0").select(SERIES, F.col("_s").alias("_s0"))
    return sums.join(zero, SERIES).select(SERIES, "lag", (F.col("_s") / F.col("_s0")).alias("acf"))


def _durbin_levinson(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial autocorrelations of one series from its autocorrelations."""
    pdf = pdf.sort_values("lag")
    r = pdf["acf"].to_numpy()
    phi: list[float] = []
    out = [1.0]
    for k in range(1, len(r)):
        num = r[k] - sum(p * r[k - 1 - j] for j, p in enumerate(phi))
        den = 1.0 - sum(p * r[j + 1] for j, p in enumerate(phi))
        last = num / den if den else float("nan")
        phi = [p - last * phi[k - 2 - j] for j, p in enumerate(phi)] + [last]
        out.append(last)
    return pd.DataFrame({SERIES: pdf[SERIES], "lag": pdf["lag"], "pacf": out})


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """Durbin-Levinson over the few hundred lags of each series."""
    schema = f"{SERIES} string, lag long, pacf double"
    return acf.groupBy(SERIES).applyInPandas(_durbin_levinson, schema)


def extremes(df: DataFrame, keys: list[str], label: str, value: str, target: float) -> DataFrame:
    """Label of the smallest value, and of the value closest to a target."""
    return df.groupBy(*keys).agg(
        F.min_by(label, F.struct(value, label)).alias("argmin"),
        F.min_by(label, F.struct(F.abs(F.col(value) - target), F.col(label))).alias("closest"),
    )
