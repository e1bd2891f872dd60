"""Lag, calendar and rolling-quantile features on a regular grid."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.config import LEVELS, ROLLING_DAYS
from panelcast.functions.calendar import (
    Freq,
    is_weekend,
    part,
    seasonal_columns,
    seasonal_names,
    seasonal_parts,
)
from panelcast.operators.blocks import BLOCK, block_window, drop_halo, with_halo
from panelcast.operators.panel import SERIES

ROLLING_SUFFIXES = ("q025", "q25", "q50", "q75", "q975")


@dataclass(frozen=True)
class FeatureSpec:
    """What to build.  ``lag_cols=None`` lags every covariate and calendar column,
    ``()`` none of them."""

    freq: Freq
    lags: tuple[int, ...]
    x_cols: tuple[str, ...] = ()
    lag_cols: tuple[str, ...] | None = None
    seasonal: bool = True
    cyclical: bool = True
    rolling: bool = False
    target: str = "y"
    one_hot: bool = False

    def __post_init__(self) -> None:
        if not self.lags or min(self.lags) < 1:
            raise ValueError("lags must be positive")

    @property
    def seasonal_names(self) -> list[str]:
        if not self.seasonal:
            return []
        if self.one_hot:
            return [*one_hot_names(self.freq), "is_weekend"]
        return seasonal_names(self.freq, self.cyclical)

    @property
    def base_names(self) -> list[str]:
        return [*self.x_cols, *self.seasonal_names]

    @property
    def lagged(self) -> list[str]:
        return self.base_names if self.lag_cols is None else list(self.lag_cols)

    @property
    def covariate_lag_names(self) -> list[str]:
        # lag-major: a_lag_1, b_lag_1, a_lag_2, b_lag_2
        return [f"{c}_lag_{k}" for k in self.lags for c in self.lagged]

    @property
    def target_lag_names(self) -> list[str]:
        return [f"{self.target}_lag_{k}" for k in self.lags]

    @property
    def rolling_names(self) -> list[str]:
        return [f"{self.target}_{s}" for s in ROLLING_SUFFIXES] if self.rolling else []

    @property
    def static_names(self) -> list[str]:
        """Features that do not depend on the target."""
        return [*self.base_names, *self.covariate_lag_names]

    @property
    def names(self) -> list[str]:
        return [*self.static_names, *self.target_lag_names, *self.rolling_names]

    @property
    def reach(self) -> int:
        """How far back a feature looks, in steps."""
        rolling = ROLLING_DAYS * self.freq.per_day if self.rolling else 0
        return max(max(self.lags), rolling)


def seasonal_rolling_quantiles(
    df: DataFrame, freq: Freq, target: str = "y", days: int = ROLLING_DAYS
) -> dict[str, Column]:
    """Quantiles of the same phase over ``[t - days, t)``; needs halo blocks."""
    w = (
        Window.partitionBy(SERIES, BLOCK, freq.phase("pos"))
        .orderBy("pos")
        .rangeBetween(-days * freq.per_day, -1)
    )
    values = F.percentile(target, F.array(*[F.lit(q) for q in LEVELS])).over(w)
    return {f"{target}_{s}": values[i] for i, s in enumerate(ROLLING_SUFFIXES)}


def add_seasonal(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    if not spec.seasonal:
        return df
    if spec.one_hot:
        return df.withColumns(one_hot(spec.freq) | {"is_weekend": is_weekend("ts")})
    return df.withColumns(seasonal_columns("ts", spec.freq, spec.cyclical))


def build_features(grid: DataFrame, spec: FeatureSpec, target_features: bool = True) -> DataFrame:
    """Feature columns for every grid row, in the order of ``spec.names``.

    All lags share one exchange: rows are blocked with a halo of the longest look-back.
    """
    df = add_seasonal(grid, spec)
    halo = with_halo(df, "pos", back=spec.reach if target_features else max(spec.lags))
    w = block_window([SERIES], "pos")
    lags = {f"{c}_lag_{k}": F.lag(c, k).over(w) for k in spec.lags for c in spec.lagged}
    if target_features:
        lags |= {f"{spec.target}_lag_{k}": F.lag(spec.target, k).over(w) for k in spec.lags}
    out = halo.withColumns(lags)
    if target_features and spec.rolling:
        rolling = seasonal_rolling_quantiles(out, spec.freq, spec.target)
        out = out.withColumn("_rq", F.array(*rolling.values()))
        out = out.withColumns({n: F.col("_rq")[i] for i, n in enumerate(rolling)}).drop("_rq")
    return drop_halo(out)


def build_many(grid: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """Every feature of every spec, each made once; they share the frequency and the target.

    Rows are blocked once, with a halo of the longest look-back.
    """
    first = specs[0]
    if any((s.freq, s.target) != (first.freq, first.target) for s in specs):
        raise ValueError("specs must share frequency and target")
    df = grid
    for spec in specs:
        df = add_seasonal(df, spec)
    halo = with_halo(df, "pos", back=max(s.reach for s in specs))
    w = block_window([SERIES], "pos")
    pairs = {(c, k) for s in specs for k in s.lags for c in [*s.lagged, s.target]}
    out = halo.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c, k in sorted(pairs)})
    if any(s.rolling for s in specs):
        rolling = seasonal_rolling_quantiles(out, first.freq, first.target)
        out = out.withColumn("_rq", F.array(*rolling.values()))
        out = out.withColumns({n: F.col("_rq")[i] for i, n in enumerate(rolling)}).drop("_rq")
    return drop_halo(out)


def training_frame(features: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Rows with every feature and the label present."""
    return features.dropna("any", subset=[*spec.names, spec.target])


def offset_name(c: str, s: int) -> str:
    return f"{c}_lag_{-s}" if s < 0 else f"{c}_lead_{s}" if s > 0 else f"{c}_now"


def offsets(
    grid: DataFrame, cols: list[str], steps: list[int], keys: list[str] | None = None
) -> DataFrame:
    """Lags (negative steps) and leads (positive) of known-future columns."""
    halo = with_halo(
        grid, "pos", back=max([-s for s in steps] + [0]), ahead=max([s for s in steps] + [0])
    )
    w = block_window(keys or [SERIES], "pos")

    made = {
        offset_name(c, s): F.lag(c, -s).over(w) if s < 0 else F.lead(c, s).over(w) if s > 0 else F.col(c)
        for c in cols
        for s in steps
    }
    return drop_halo(halo.withColumns(made))


_FIRST_AND_LAST = {"dayofweek": (0, 6), "month": (1, 12), "hour": (0, 23)}


def _codes(freq: Freq) -> list[tuple[str, int]]:
    """Calendar codes, first category of each part dropped."""
    spans = [(p, *_FIRST_AND_LAST[p]) for p in seasonal_parts(freq)]
    return [(p, v) for p, low, high in spans for v in range(low + 1, high + 1)]


def one_hot_names(freq: Freq) -> list[str]:
    return [f"{p}_{v}" for p, v in _codes(freq)]


def one_hot(freq: Freq, ts: str = "ts") -> dict[str, Column]:
    """0/1 columns of the calendar codes."""
    return {f"{p}_{v}": (part(ts, p) == v).cast("int") for p, v in _codes(freq)}
