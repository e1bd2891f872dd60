"""Models by name, with the settings of the workload per frequency."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from panelcast import config as C
from panelcast.functions.calendar import PERIODS, Freq, cyclic_encoder
from panelcast.models.forecast import Model
from panelcast.models.forest import QuantileForest
from panelcast.models.linear import LinearQuantile
from panelcast.models.trees import BoostedQuantile
from panelcast.operators.features import FeatureSpec, offset_name, offsets


@dataclass(frozen=True)
class Baseline:
    """Seasonal baseline: quantiles of the last weeks of the same phase."""

    n_weeks: int = 100
    kind: str = "baseline"


@dataclass(frozen=True)
class Setup:
    """A model and the features it is fitted on; the baseline needs none.

    ``known_ahead`` are the covariates of a direct model, whose lags and leads
    :meth:`prepared` adds to a grid.
    """

    name: str
    model: Model | Baseline
    spec: FeatureSpec | None = None
    known_ahead: tuple[str, ...] | None = None

    def prepared(self, grid: DataFrame) -> DataFrame:
        """A grid with the columns that the features are made from."""
        if self.known_ahead is None:
            return grid
        freq, linear = self.spec.freq, self.name == "quantile-regressor"
        steps = direct_linear_steps(freq) if linear else C.DIRECT_COVARIATE_OFFSETS[freq.code]
        return direct_grid(grid, self.known_ahead, direct_parts(freq, quarter=not linear), steps)


# Hyper-parameters of the workload.
BOOSTING = {
    "lgbm": {
        "D": {"max_leaves": 15, "min_child": 50, "penalty": 1.0, "depth": 9, "subsample": 0.9},
        "h": {"max_leaves": 20, "min_child": 200, "penalty": 2.0, "depth": 12, "subsample": 0.8},
    },
    "xgb-custom": {
        "D": {"depth": 6, "penalty": 1e-3, "min_child": 1, "subsample": 0.9},
        "h": {"depth": 6, "penalty": 1e-3, "min_child": 1, "subsample": 0.8},
    },
    "catboost": {
        "D": {"depth": 6, "penalty": 1e-2, "min_child": 1, "subsample": 0.9},
        "h": {"depth": 6, "penalty": 1e-2, "min_child": 1, "subsample": 0.8},
    },
}
GROWTH = {"lgbm": "leaf", "xgb-custom": "depth", "catboost": "symmetric"}
COLUMN_DRAW = {"lgbm": "tree", "xgb-custom": "depth", "catboost": "depth"}
COMMON = {"rounds": 250, "learning_rate": 0.1, "colsample": 0.6}
HOLDOUT = {"D": 30, "h": 24 * 7}
NAMES = ("benchmark", "quantreg", "xgboost", "xgb-custom", "lgbm", "catboost", "qrf")


def get_model(
    name: str,
    freq: Freq,
    x_cols: tuple[str, ...] = (),
    levels: tuple[float, ...] = C.LEVELS,
    chunk: int | None = None,
    **overrides,
) -> Setup:
    """The named model; ``overrides`` replace settings of the features or the model."""
    daily = freq.code == "D"
    lags = C.DAILY_LAGS if daily else C.HOURLY_LAGS
    x_cols = tuple(x_cols)
    if name == "benchmark":
        return Setup(name, replace(Baseline(), **overrides))
    feature = {k: overrides.pop(k) for k in list(overrides) if k in FeatureSpec.__annotations__}
    if name == "quantreg":
        spec = FeatureSpec(
            freq,
            C.LINEAR_DAILY_LAGS if daily else C.LINEAR_HOURLY_LAGS,
            x_cols,
            lag_cols=(),
            cyclical=False,
            one_hot=True,
        )
        spec = replace(spec, **feature)
        raw = tuple(n for n in spec.names if n not in x_cols)
        return Setup(
            name, LinearQuantile(tuple(spec.names), raw=raw, levels=levels, **overrides), spec
        )
    if name in BOOSTING:
        spec = replace(FeatureSpec(freq, lags, x_cols), **feature)
        settings = COMMON | BOOSTING[name][freq.code] | overrides
        model = BoostedQuantile(
            tuple(spec.names),
            levels=levels,
            growth=GROWTH[name],
            column_draw=COLUMN_DRAW[name],
            holdout=HOLDOUT[freq.code],
            **settings,
        )
        return Setup(name, model, spec)
    if name == "qrf":
        forest_lags = C.FOREST_DAILY_LAGS if daily else lags
        spec = replace(FeatureSpec(freq, forest_lags, x_cols, lag_cols=()), **feature)
        settings = {"trees": 100, "min_child": 1} | overrides
        return Setup(name, QuantileForest(tuple(spec.names), levels=levels, **settings), spec)
    if name == "xgboost":
        return direct_trees(freq, x_cols, levels, chunk or (7 if daily else 24), **overrides)
    if name == "quantile-regressor":
        return direct_linear(freq, x_cols, levels, chunk or (7 if daily else 24), **overrides)
    raise ValueError(f"unsupported model: {name}")


# --- direct models -----------------------------------------------------------------------


def direct_parts(freq: Freq, quarter: bool = True) -> list[str]:
    parts = ["day", "month", "dayofweek", "quarter"] if quarter else ["dayofweek", "month"]
    return parts + (["hour"] if freq.code == "h" else [])


def _encoder_names(parts: list[str]) -> list[str]:
    return [f"{p}_{f}" for p in parts for f in ("sin", "cos")]


def direct_static(
    x_cols: tuple[str, ...], parts: list[str], steps: tuple[int, ...]
) -> tuple[str, ...]:
    """Offsets of covariates and calendar encodings."""
    cols = [*x_cols, *_encoder_names(parts)]
    return tuple(offset_name(c, s) for c in cols for s in steps)


def direct_grid(
    grid: DataFrame, x_cols: tuple[str, ...], parts: list[str], steps: tuple[int, ...]
) -> DataFrame:
    """Grid with calendar encodings and lags and leads of everything known ahead."""
    encoded = grid.withColumns(cyclic_encoder("ts", [(p, PERIODS[p]) for p in parts]))
    return offsets(encoded, [*x_cols, *_encoder_names(parts)], list(steps))


def _direct_spec(freq, static, lags, chunk) -> FeatureSpec:
    # one model for the whole chunk: it predicts the chunk's last step, so lags count
    # from the row before the chunk and nothing has to be fed back
    shifted = tuple(k + chunk - 1 for k in lags)
    return FeatureSpec(freq, shifted, static, lag_cols=(), seasonal=False)


def direct_trees(freq, x_cols, levels, chunk, **overrides) -> Setup:
    steps = C.DIRECT_COVARIATE_OFFSETS[freq.code]
    static = direct_static(x_cols, direct_parts(freq), steps)
    lags = range(1, C.DIRECT_TARGET_LAGS[freq.code] + 1)
    spec = _direct_spec(freq, static, lags, chunk)
    settings = {"rounds": 100, "learning_rate": 0.3, "depth": 6, "min_child": 1} | overrides
    model = BoostedQuantile(tuple(spec.names), levels=levels, **settings)
    return Setup("xgboost", model, spec, tuple(x_cols))


def direct_linear_steps(freq: Freq) -> tuple[int, ...]:
    return tuple(d * freq.per_day for d in C.DIRECT_LINEAR_OFFSET_DAYS)


def direct_linear(freq, x_cols, levels=C.LEVELS, chunk: int = 1, **overrides) -> Setup:
    static = direct_static(x_cols, direct_parts(freq, quarter=False), direct_linear_steps(freq))
    lags = [d * freq.per_day for d in C.DIRECT_LINEAR_DAYS]
    spec = _direct_spec(freq, static, lags, chunk)
    model = LinearQuantile(tuple(spec.names), raw=tuple(spec.names), levels=levels, **overrides)
    return Setup("quantile-regressor", model, spec, tuple(x_cols))
