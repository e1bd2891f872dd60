"""Forecast models."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.config import DAILY_LAGS, QCOLS
from panelcast.functions.calendar import DAILY, HOURLY
from panelcast.operators.baseline import baseline_forecast
from panelcast.operators.features import FeatureSpec, build_features, training_frame
from panelcast.operators.panel import SERIES, spine
from panelcast.plans import evaluate
from panelcast.plans import tables as T
from panelcast.plans.catalog.registry import LEVELS_SQL, q_columns, query, r, with_ctes


@query(
    "m1_baseline_backtest",
    with_ctes(
        f"SELECT series_id, fold, ts, h, round(y, 6) AS y, {q_columns()} FROM dpred", "dpred"
    ),
)
def m1(spark, sf_dir):
    rows = evaluate.daily_backtest(spark, sf_dir)
    return rows.select(SERIES, "fold", "ts", "h", r("y"), *[r(c) for c in QCOLS])


@query(
    "m1_baseline_hourly_clipped",
    with_ctes(f"SELECT series_id, fold, ts, h, {q_columns()} FROM hpred", "hpred"),
)
def m1_hourly(spark, sf_dir):
    rows = evaluate.hourly_backtest(spark, sf_dir)
    return rows.select(SERIES, "fold", "ts", "h", *[r(c) for c in QCOLS])


@query(
    "m1_baseline_three_weeks",
    with_ctes(f"SELECT series_id, fold, ts, h, {q_columns()} FROM dpred_long", "dpred_long"),
)
def m1_long(spark, sf_dir):
    rows = evaluate.long_backtest(spark, sf_dir)
    return rows.select(SERIES, "fold", "ts", "h", *[r(c) for c in QCOLS])


@query(
    "m1_baseline_forecast",
    with_ctes(
        f"""SELECT series_id, ts, {q_columns()} FROM (
            SELECT f.series_id, f.ts, quantile_cont(d.y, {LEVELS_SQL}) AS q FROM (
              SELECT series_id, unnest(generate_series(max(ts) + INTERVAL 1 DAY,
                max(ts) + INTERVAL 14 DAY, INTERVAL 1 DAY)) AS ts FROM dgrid GROUP BY 1) f
            JOIN (SELECT *, row_number() OVER (PARTITION BY series_id, isodow(ts)
                  ORDER BY ts DESC) AS rn FROM dgrid) d
              ON d.series_id = f.series_id AND isodow(d.ts) = isodow(f.ts) AND rn <= 100
            GROUP BY ALL)""",
        "dgrid",
    ),
)
def m1_forecast(spark, sf_dir):
    """Two weeks past the end of every series."""
    grid = T.daily_grid(spark, sf_dir)
    ends = grid.groupBy(SERIES).agg(
        (F.max("pos") + 1).alias("lo"), (F.max("pos") + 14).alias("hi")
    )
    horizon = spine(ends, DAILY).drop("lo", "hi")
    out = baseline_forecast(grid, horizon, DAILY, 100)
    return out.select(SERIES, "ts", *[r(c) for c in QCOLS])


@query(
    "m12_point_forecast",
    with_ctes(
        """SELECT series_id, ts, round(avg(q[3]), 6) AS yhat, count(*) AS folds
           FROM hpred GROUP BY ALL""",
        "hpred",
    ),
)
def m12(spark, sf_dir):
    """The median; overlapping folds are averaged."""
    rows = evaluate.hourly_backtest(spark, sf_dir)
    return rows.groupBy(SERIES, "ts").agg(
        F.round(F.avg("q50"), 6).alias("yhat"), F.count("*").alias("folds")
    )


@query(
    "m13_history_truncation",
    with_ctes(
        """SELECT series_id, ts, round(y, 6) AS y FROM dgrid
           WHERE idx >= n_rows - 90""",
        "dgrid",
    ),
)
def m13(spark, sf_dir):
    """What a forecast needs: the longest look-back of its features before the cutoff."""
    spec = FeatureSpec(DAILY, DAILY_LAGS, rolling=True)
    grid = T.daily_grid(spark, sf_dir)
    return grid.filter(F.col("pos") > F.col("hi") - spec.reach).select(SERIES, "ts", r("y"))


# --- feature frames --------------------------------------------------------------------


def _sql_feature(name: str) -> str:
    if "_lag_" in name:
        base, k = name.rsplit("_lag_", 1)
        return f"lag({base}, {k}) OVER (PARTITION BY series_id ORDER BY ts)"
    return name


_SEASONAL_SQL = {
    "dayofweek": ("(isodow(ts) - 1)", 7),
    "month": ("month(ts)", 12),
    "hour": ("hour(ts)", 24),
}


def _seasonal_sql(spec: FeatureSpec) -> str:
    cells = []
    for name in spec.seasonal_names:
        if name == "is_weekend":
            cells.append("(isodow(ts) > 5)::INT AS is_weekend")
            continue
        base, kind = name.rsplit("_", 1)
        expr, period = _SEASONAL_SQL[base]
        cells.append(f"{kind}(2 * pi() * {expr} / {period}) AS {name}")
    return ", ".join(cells)


DAILY_SPEC = FeatureSpec(DAILY, DAILY_LAGS, ("quantity", "discount"))
HOURLY_SPEC = FeatureSpec(HOURLY, (24, 168), lag_cols=(), rolling=True)


def _features_sql(grid: str, spec: FeatureSpec, phase: str) -> str:
    names = [n for n in spec.names if n not in spec.rolling_names]
    rolling = ""
    if spec.rolling:
        rolling = f""", quantile_cont(y, {LEVELS_SQL}) OVER (
            PARTITION BY series_id, {phase} ORDER BY ts
            RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS q"""
    feats = ", ".join(f"{_sql_feature(n)} AS {n}_f" for n in names)
    out = [f"round({n}_f, 6) AS {n}" for n in names]
    out += [f"round(q[{i}], 6) AS {n}" for i, n in enumerate(spec.rolling_names, 1)]
    present = [f"{n}_f IS NOT NULL" for n in names] + ["y IS NOT NULL"]
    if spec.rolling:
        present.append("q IS NOT NULL")
    return with_ctes(
        f"""SELECT series_id, ts, round(y, 6) AS y, {', '.join(out)}
            FROM feats WHERE {' AND '.join(present)}""",
        grid,
        base=f"SELECT *, {_seasonal_sql(spec)} FROM {grid}",
        feats=f"SELECT series_id, ts, y, {feats}{rolling} FROM base",
    )


@query("m11_features_daily", _features_sql("mfill", DAILY_SPEC, "isodow(ts)"))
def m11_daily(spark, sf_dir):
    frame = training_frame(build_features(T.covariate_panel(spark, sf_dir), DAILY_SPEC), DAILY_SPEC)
    return frame.select(SERIES, "ts", r("y"), *[r(c) for c in DAILY_SPEC.names])


@query("m11_features_hourly", _features_sql("hfill", HOURLY_SPEC, "isodow(ts), hour(ts)"))
def m11_hourly(spark, sf_dir):
    frame = training_frame(build_features(T.hourly_filled(spark, sf_dir), HOURLY_SPEC), HOURLY_SPEC)
    return frame.select(SERIES, "ts", r("y"), *[r(c) for c in HOURLY_SPEC.names])


