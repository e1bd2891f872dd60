"""Folds, backtests and sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.config import LEVELS, QCOLS, TREE_GRID, WEEKS_GRID
from panelcast.functions.calendar import DAILY, HOURLY
from panelcast.operators import folds as B
from panelcast.operators import scoring
from panelcast.operators.experiments import result_table, tree_grid, weeks_sweep
from panelcast.operators.folds import Splitter, WindowParams, window_params
from panelcast.operators.panel import SERIES, bounds
from panelcast.plans import evaluate
from panelcast.plans import tables as T
from panelcast.plans.catalog.registry import LEVELS_SQL, LOSSES_SQL, query, r, with_ctes

_YEARS = (0.5, 1.0, 2.5)


@query(
    "b1_window_params",
    with_ctes(
        """SELECT series_id, years, floor(365 * years)::BIGINT AS initial_window,
             7 AS step_length, 14 AS forecast_steps,
             CASE WHEN n < floor(365 * years) + 14 THEN 0
                  ELSE (n - floor(365 * years)::BIGINT - 14) // 7 + 1 END AS folds
           FROM (SELECT series_id, max(n_rows) AS n FROM dgrid GROUP BY 1),
                (VALUES (0.5::DOUBLE), (1.0), (2.5)) v(years)""",
        "dgrid",
    ),
)
def b1(spark, sf_dir):
    series = bounds(T.daily(spark, sf_dir), DAILY)
    n = F.col("hi") - F.col("lo") + 1
    rows = []
    for years in _YEARS:
        p = window_params(years, 7, 14, "D")
        rows.append(
            F.struct(
                F.lit(years).alias("years"),
                F.lit(p.initial_window).alias("initial_window"),
                F.lit(p.step_length).alias("step_length"),
                F.lit(p.forecast_steps).alias("forecast_steps"),
                B.n_folds(n, p).cast("long").alias("folds"),
            )
        )
    return series.select(SERIES, F.explode(F.array(*rows)).alias("p")).select(SERIES, "p.*")


def _fold_sql(grid: str, w: int, h: int, step: int, unit: str, sliding: bool) -> str:
    start = f"fold * {step}" if sliding else "0"
    return with_ctes(
        f"""SELECT f.series_id, f.fold, {w - 1} + f.fold * {step} AS cutoff_idx,
              {start} AS train_start_idx, {w} + f.fold * {step} - {start} AS len_train_window,
              lo + to_{unit}(({w - 1} + f.fold * {step})::INT) AS cutoff,
              lo + to_{unit}(({start})::INT) AS train_start,
              lo + to_{unit}(({w} + f.fold * {step})::INT) AS test_start,
              lo + to_{unit}(({w - 1 + h} + f.fold * {step})::INT) AS test_end
            FROM (SELECT series_id, lo, unnest(range(0, (n - {w + h}) // {step} + 1)) AS fold
                  FROM (SELECT series_id, min(ts) AS lo, max(n_rows) AS n FROM {grid} GROUP BY 1)
                  WHERE n >= {w + h}) f""",
        grid,
    )


@query("b2_sliding_folds", _fold_sql("hgrid", 336, 48, 24, "hours", True))
def b2(spark, sf_dir):
    return B.fold_table(bounds(T.hourly(spark, sf_dir), HOURLY), HOURLY, evaluate.HOURLY_SPLIT)


@query("b3_expanding_folds", _fold_sql("dgrid", 1400, 21, 70, "days", False))
def b3(spark, sf_dir):
    return B.fold_table(bounds(T.daily(spark, sf_dir), DAILY), DAILY, evaluate.LONG_SPLIT)


@query(
    "b5_initial_window",
    with_ctes(
        """SELECT series_id, count(*) FILTER (WHERE ts < TIMESTAMP '1998-10-24') AS initial_window
           FROM dgrid GROUP BY 1""",
        "dgrid",
    ),
)
def b5(spark, sf_dir):
    return B.initial_window(T.daily_grid(spark, sf_dir), DAILY, "1998-10-23")


@query(
    "b6_test_rows",
    with_ctes(
        "SELECT series_id, fold, ts, h, round(y, 6) AS y FROM hpred", "hpred"
    ),
)
def b6_test(spark, sf_dir):
    rows = B.test_rows(T.hourly_grid(spark, sf_dir), evaluate.HOURLY_SPLIT.params)
    return rows.select(SERIES, "fold", "ts", "h", r("y"))


def _train_sql(sliding: bool) -> str:
    start = "AND g.idx >= f.fold * 70" if sliding else ""
    return with_ctes(
        f"""SELECT g.series_id, f.fold, count(*) AS n, min(g.ts) AS first, max(g.ts) AS last,
              count(g.y) AS observed
            FROM dgrid g JOIN (
              SELECT series_id, unnest(range(0, (n_rows - 1421) // 70 + 1)) AS fold
              FROM (SELECT DISTINCT series_id, n_rows FROM dgrid) WHERE n_rows >= 1421) f
              ON f.series_id = g.series_id AND g.idx <= 1399 + f.fold * 70 {start}
            GROUP BY ALL""",
        "dgrid",
    )


def _train(spark, sf_dir, kind):
    rows = B.train_rows(T.daily_grid(spark, sf_dir), Splitter(WindowParams(1400, 70, 21), kind))
    return rows.groupBy(SERIES, "fold").agg(
        F.count("*").alias("n"),
        F.min("ts").alias("first"),
        F.max("ts").alias("last"),
        F.count("y").alias("observed"),
    )


@query("b6_train_rows_sliding", _train_sql(True))
def b6_sliding(spark, sf_dir):
    return _train(spark, sf_dir, "sliding")


@query("b6_train_rows_expanding", _train_sql(False))
def b6_expanding(spark, sf_dir):
    return _train(spark, sf_dir, "expanding")


_EVAL_COLS = ", ".join(
    f'round(loss_{c}, 6) AS "{q}"' for c, q in zip(QCOLS, LEVELS, strict=True)
)


@query(
    "b8_eval_results",
    with_ctes(
        f"""SELECT d.series_id, d.fold, lo + to_days((999 + d.fold * 7)::INT) AS cutoff,
              1000 AS len_train_window, {_EVAL_COLS},
              round(pinball_loss, 6) AS "test_PinballLoss"
            FROM dfold d JOIN (SELECT series_id, min(ts) AS lo FROM daily GROUP BY 1) USING (series_id)""",
        "dfold",
    ),
)
def b8(spark, sf_dir):
    grid = T.daily_grid(spark, sf_dir)
    scores = evaluate.daily_folds(spark, sf_dir)
    table = B.fold_table(
        grid.groupBy(SERIES).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")),
        DAILY,
        evaluate.DAILY_SPLIT,
    )
    return table.join(scores, [SERIES, "fold"]).select(
        SERIES,
        "fold",
        "cutoff",
        "len_train_window",
        *[r(f"loss_{c}", alias=str(q)) for c, q in zip(QCOLS, LEVELS, strict=True)],
        r("pinball_loss", alias="test_PinballLoss"),
    )


@query(
    "b8_level_metrics",
    with_ctes(
        " UNION ALL ".join(
            f"SELECT series_id, 'loss_{c}' AS metric, round(avg(loss_{c}), 6) AS mean, "
            f"round(stddev_samp(loss_{c}), 6) AS std FROM dfold GROUP BY 1"
            for c in QCOLS
        ),
        "dfold",
    ),
)
def b8_levels(spark, sf_dir):
    out = scoring.level_metrics(evaluate.daily_folds(spark, sf_dir))
    return out.select(SERIES, "metric", r("mean"), r("std"))


# A coarser backtest for the sweep: every history length in one plan.
_SWEEP = Splitter(WindowParams(2100, 70, 7), "sliding")
_SPANS = WEEKS_GRID


def _sweep_ctes() -> dict[str, str]:
    past = """SELECT t.series_id, t.fold, t.ts, t.y, p.y AS past, row_number() OVER (
                PARTITION BY t.series_id, t.fold, t.ts ORDER BY p.idx DESC) AS rn
              FROM (SELECT g.series_id, f.fold, g.ts, g.idx, g.y, 2099 + f.fold * 70 AS cut
                    FROM dgrid g JOIN (
                      SELECT series_id, unnest(range(0, (n_rows - 2107) // 70 + 1)) AS fold
                      FROM (SELECT DISTINCT series_id, n_rows FROM dgrid)
                      WHERE n_rows >= 2107) f USING (series_id)
                    WHERE g.idx BETWEEN 2100 + f.fold * 70 AND 2106 + f.fold * 70) t
              JOIN dgrid p ON p.series_id = t.series_id AND p.idx <= t.cut
                AND p.idx > t.cut - 2100 AND (t.idx - p.idx) % 7 = 0"""
    spans = ", ".join(f"({s})" for s in _SPANS)
    scored = f"""SELECT series_id, n_weeks, fold, y, q[1] AS q025, q[2] AS q25, q[3] AS q50,
                   q[4] AS q75, q[5] AS q975 FROM (
                   SELECT series_id, n_weeks, fold, ts, y, quantile_cont(past, {LEVELS_SQL}) AS q
                   FROM past JOIN (VALUES {spans}) v(n_weeks) ON rn <= n_weeks
                   GROUP BY ALL) WHERE y IS NOT NULL"""
    fold = f"""SELECT *, loss_q025 + loss_q25 + loss_q50 + loss_q75 + loss_q975 AS pinball_loss,
                 (loss_q25 + loss_q75) / 0.5::DOUBLE AS interval_score_50,
                 (loss_q025 + loss_q975) / 0.05::DOUBLE AS interval_score_95 FROM (
                 SELECT series_id, n_weeks, fold, {LOSSES_SQL},
                   avg((y >= q25 AND y <= q75)::INT::DOUBLE) AS coverage_50,
                   avg((y >= q025 AND y <= q975)::INT::DOUBLE) AS coverage_95
                 FROM scored GROUP BY ALL)"""
    metrics = " UNION ALL ".join(
        f"SELECT series_id, n_weeks, '{m}' AS metric, avg({m}) AS mean, {s}({m}) AS std "
        "FROM fold GROUP BY ALL"
        for m, s in (
            ("pinball_loss", "stddev_samp"),
            ("interval_score_50", "stddev_samp"),
            ("interval_score_95", "stddev_samp"),
            ("coverage_50", "stddev_pop"),
            ("coverage_95", "stddev_pop"),
        )
    )
    return {"past": past, "scored": scored, "fold": fold, "metrics": metrics}


def _sweep(spark, sf_dir):
    return weeks_sweep(T.daily_grid(spark, sf_dir), DAILY, _SWEEP, list(_SPANS))


@query(
    "b9_weeks_sweep",
    with_ctes(
        """SELECT series_id, n_weeks, metric, round(mean, 6) AS mean, round(std, 6) AS std
           FROM metrics""",
        "dgrid",
        **_sweep_ctes(),
    ),
)
def b9_weeks(spark, sf_dir):
    return _sweep(spark, sf_dir).select(SERIES, "n_weeks", "metric", r("mean"), r("std"))


@query(
    "b9_tree_grid",
    with_ctes(
        """SELECT series_id, rows, l.v AS num_leaves, c.v AS min_child_samples, -1 AS max_depth,
             n.v AS n_estimators, 0.1::DOUBLE AS learning_rate, 0.8::DOUBLE AS colsample_bytree,
             0.001::DOUBLE AS reg_lambda, l.v * c.v <= rows AS splittable
           FROM (SELECT series_id, count(*) AS rows FROM daily GROUP BY 1),
             (VALUES (6), (15), (31), (62), (90)) l(v), (VALUES (5), (25), (50)) c(v),
             (VALUES (100), (200), (300)) n(v)""",
        "daily",
    ),
)
def b9_trees(spark, sf_dir):
    """The 45 tree settings for every series, and whether its rows can fill the leaves."""
    runs = T.daily(spark, sf_dir).groupBy(SERIES).agg(F.count("*").alias("rows"))
    full = F.col("num_leaves") * F.col("min_child_samples") <= F.col("rows")
    return tree_grid(runs).withColumn("splittable", full).select(
        SERIES, "rows", *TREE_GRID, "splittable"
    )


def _result_sql() -> str:
    every = (
        ("pinball_loss", "w.pinball_loss"),
        ("interval_score_50", "w.interval_score_50"),
        ("interval_score_95", "w.interval_score_95"),
        ("coverage_50", "abs(w.coverage_50 - 0.5::DOUBLE)"),
        ("coverage_95", "abs(w.coverage_95 - 0.95::DOUBLE)"),
    )
    cells = ", ".join(
        f"max(mean) FILTER (WHERE metric = '{m}') AS {m}, "
        f"max(std) FILTER (WHERE metric = '{m}') AS {m}_std"
        for m, _ in every
    )
    out = ", ".join(
        f"printf('%.2f (± %.2f)', w.{m}, w.{m}_std) AS {m}, "
        f"row_number() OVER (PARTITION BY series_id ORDER BY round({rank}, 9), w.n_weeks::VARCHAR) = 1 "
        f"AS {m}_is_best"
        for m, rank in every
    )
    return with_ctes(
        f"""SELECT w.series_id, w.n_weeks::VARCHAR AS model,
              round(w.pinball_loss, 6) AS pinball_loss_value, {out} FROM wide w""",
        "dgrid",
        **_sweep_ctes(),
        wide=f"SELECT series_id, n_weeks, {cells} FROM metrics GROUP BY ALL",
    )


@query("b10_result_table", _result_sql())
def b10(spark, sf_dir):
    runs = _sweep(spark, sf_dir).withColumn("run", F.col("n_weeks"))
    runs = runs.withColumn("n_weeks", F.col("n_weeks").cast("string"))
    out = result_table(runs, [SERIES], "n_weeks", "run")
    return out.withColumn("pinball_loss_value", F.round("pinball_loss_value", 6)).orderBy(
        F.desc("pinball_loss_value")
    )


@query(
    "b11_history_by_model",
    with_ctes(
        """SELECT 'quantreg' AS model, series_id, ts, round(y, 6) AS y FROM daily
           WHERE ts >= TIMESTAMP '1999-01-01'
           UNION ALL SELECT 'lgbm', series_id, ts, round(y, 6) FROM daily""",
        "daily",
    ),
)
def b11(spark, sf_dir):
    """The slow model gets the years from 1999 on, the other all."""
    panel = T.daily(spark, sf_dir).select(SERIES, "ts", r("y"))
    short = T.daily(spark, sf_dir, "1999-01-01").select(SERIES, "ts", r("y"))
    short = short.withColumn("model", F.lit("quantreg"))
    return short.unionByName(panel.withColumn("model", F.lit("lgbm")))
