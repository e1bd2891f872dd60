"""Parameters of the forecasting workload.

Fixed values: quantile levels, lags, history lengths and grids are plain
settings of the workload, kept equal so that results agree.
"""

from __future__ import annotations

LEVELS: tuple[float, ...] = (0.025, 0.25, 0.5, 0.75, 0.975)
QCOLS: tuple[str, ...] = ("q025", "q25", "q50", "q75", "q975")
SUBMISSION_QCOLS: tuple[str, ...] = ("q0.025", "q0.25", "q0.5", "q0.75", "q0.975")

ROLLING_DAYS = 90
LOCAL_ZONE = "Europe/Berlin"

# Submission contract: targets, horizons and plausible ranges.
HORIZONS: dict[str, tuple[str, ...]] = {
    "bikes": ("1 day", "2 day", "3 day", "4 day", "5 day", "6 day"),
    "energy": ("36 hour", "40 hour", "44 hour", "60 hour", "64 hour", "68 hour"),
    "no2": ("36 hour", "40 hour", "44 hour", "60 hour", "64 hour", "68 hour"),
}
PLAUSIBLE: dict[str, tuple[float, float]] = {
    "bikes": (0.0, 10000.0),
    "energy": (0.0, 200.0),
    "no2": (0.0, 300.0),
}
FORECAST_HOURS = (12, 16, 20)
FORECAST_WEEKDAYS = (4, 5)  # Friday and Saturday, Monday = 0

# Lags per frequency (daily counts, hourly load).
DAILY_LAGS = (1, 2, 6, 7, 14, 21, 28)
HOURLY_LAGS = (24, 48, 72, 96, 120, 144, 168, 336, 504, 672)
FOREST_DAILY_LAGS = (1, 2, 3, 7, 14, 21)
LINEAR_DAILY_LAGS = (7, 14)
LINEAR_HOURLY_LAGS = (168,)

# Direct (chunked) models: covariate offsets in steps, positive looks ahead.
DIRECT_TARGET_LAGS = {"D": 30, "h": 168}
DIRECT_COVARIATE_OFFSETS = {
    "D": (-28, -21, -14, -7, 0, 7, 14, 21, 28),
    "h": (-336, -168, -24, 0, 24, 168, 336),
}
DIRECT_LINEAR_DAYS = (1, 2, 3, 7)
DIRECT_LINEAR_OFFSET_DAYS = (-7, -2, -1, 0, 1, 2, 7)

# Sweeps.
WEEKS_GRID = (10, 25, 50, 75, 100, 125, 150, 200, 250, 300)
MODEL_GRID = ("benchmark", "xgb-custom", "lgbm", "catboost")
TREE_GRID = {
    "num_leaves": (6, 15, 31, 62, 90),
    "min_child_samples": (5, 25, 50),
    "max_depth": (-1,),
    "n_estimators": (100, 200, 300),
    "learning_rate": (0.1,),
    "colsample_bytree": (0.8,),
    "reg_lambda": (0.001,),
}
FEATURE_GRID = {
    "include_seasonal_dummies": (True, False),
    "cyclical_encodings": (True, False),
    "lag_covariates": (True, False),
    "include_rolling_stats": (True, False),
}
DISPLAY_NAMES = {
    "lgbm": "LightGBM",
    "xgb-custom": "XGBoost",
    "catboost": "CatBoost",
    "quantreg": "Quantile Regression",
    "benchmark": "Benchmark",
}
