"""Window functions, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.config import DIRECT_COVARIATE_OFFSETS, DIRECT_TARGET_LAGS, QCOLS
from panelcast.functions.calendar import DAILY, HOURLY
from panelcast.operators import eda, scoring
from panelcast.operators import panel as P
from panelcast.operators.blocks import drop_halo, with_halo
from panelcast.operators.experiments import top_features
from panelcast.operators.features import (
    FeatureSpec,
    build_features,
    offsets,
    seasonal_rolling_quantiles,
)
from panelcast.operators.folds import n_folds
from panelcast.operators.panel import SERIES
from panelcast.plans import evaluate
from panelcast.plans import tables as T
from panelcast.plans.catalog.registry import LEVELS_SQL, q_columns, query, r, with_ctes

_COV_LAGS = (1, 2, 7)


@query(
    "w1_covariate_lags",
    with_ctes(
        "SELECT series_id, ts, "
        + ", ".join(
            f"round(lag({c}, {k}) OVER (PARTITION BY series_id ORDER BY ts), 6) AS {c}_lag_{k}"
            for k in _COV_LAGS
            for c in ("quantity", "discount")
        )
        + " FROM jgrid",
        "jgrid",
    ),
)
def w1(spark, sf_dir):
    spec = FeatureSpec(
        DAILY, _COV_LAGS, ("quantity", "discount"), lag_cols=None, seasonal=False
    )
    out = build_features(T.joined(spark, sf_dir), spec, target_features=False)
    return out.select(SERIES, "ts", *[r(c) for c in spec.covariate_lag_names])


@query(
    "w2_target_lags",
    with_ctes(
        "SELECT series_id, ts, "
        + ", ".join(
            f"round(lag(y, {k}) OVER (PARTITION BY series_id ORDER BY ts), 6) AS y_lag_{k}"
            for k in (24, 48, 72, 168)
        )
        + " FROM hgrid",
        "hgrid",
    ),
)
def w2(spark, sf_dir):
    spec = FeatureSpec(HOURLY, (24, 48, 72, 168), lag_cols=(), seasonal=False)
    out = build_features(T.hourly_grid(spark, sf_dir), spec)
    return out.select(SERIES, "ts", *[r(c) for c in spec.target_lag_names])


def _offset_sql(c: str, s: int) -> str:
    over = "OVER (PARTITION BY series_id ORDER BY ts)"
    if s < 0:
        return f"lag({c}, {-s}) {over} AS {c}_lag_{-s}"
    return f"lead({c}, {s}) {over} AS {c}_lead_{s}" if s else f"{c} AS {c}_now"


@query(
    "w3_lag_lead_offsets",
    with_ctes(
        "SELECT series_id, ts, "
        + ", ".join(_offset_sql("quantity", s) for s in DIRECT_COVARIATE_OFFSETS["D"])
        + ", "
        + ", ".join(
            f"round(lag(y, {k}) OVER (PARTITION BY series_id ORDER BY ts), 6) AS y_lag_{k}"
            for k in range(1, DIRECT_TARGET_LAGS["D"] + 1)
        )
        + " FROM jgrid",
        "jgrid",
    ),
)
def w3(spark, sf_dir):
    grid = T.joined(spark, sf_dir).select(SERIES, "ts", "pos", "quantity", F.round("y", 6).alias("y"))
    steps = DIRECT_COVARIATE_OFFSETS["D"]
    wide = offsets(grid, ["quantity"], list(steps))
    lags = tuple(range(1, DIRECT_TARGET_LAGS["D"] + 1))
    spec = FeatureSpec(DAILY, lags, lag_cols=(), seasonal=False)
    out = build_features(wide, spec)
    return out.drop("pos", "quantity", "y")


def _rolling_sql(grid: str, phase: str) -> str:
    return f"""SELECT series_id, ts, {q_columns()} FROM (
        SELECT series_id, ts, quantile_cont(y, {LEVELS_SQL}) OVER (
            PARTITION BY series_id, {phase} ORDER BY ts
            RANGE BETWEEN INTERVAL 90 DAYS PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS q
        FROM {grid})"""


def _rolling(grid, freq):
    halo = with_halo(grid, "pos", back=90 * freq.per_day)
    cols = seasonal_rolling_quantiles(halo, freq)
    out = drop_halo(halo.withColumn("_q", F.array(*cols.values())))
    return out.select(
        SERIES, "ts", *[F.round(F.col("_q")[i], 6).alias(c) for i, c in enumerate(QCOLS)]
    )


@query("w4_rolling_quantiles_daily", with_ctes(_rolling_sql("dgrid", "isodow(ts)"), "dgrid"))
def w4_daily(spark, sf_dir):
    return _rolling(T.daily_grid(spark, sf_dir), DAILY)


@query(
    "w4_rolling_quantiles_hourly",
    with_ctes(_rolling_sql("hgrid", "isodow(ts), hour(ts)"), "hgrid"),
)
def w4_hourly(spark, sf_dir):
    return _rolling(T.hourly_grid(spark, sf_dir), HOURLY)


@query(
    "w5_rolling_mean",
    with_ctes(
        """SELECT series_id, ts, round(CASE WHEN count(y) OVER w = 364 THEN avg(y) OVER w END, 6)
           AS mean_364 FROM dfill
           WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS 363 PRECEDING)""",
        "dfill",
    ),
)
def w5(spark, sf_dir):
    out = P.rolling_mean(T.daily_filled(spark, sf_dir), "y", 364, "mean_364")
    return out.select(SERIES, "ts", r("mean_364"))


@query(
    "w6_last_n_per_phase",
    with_ctes(
        """SELECT series_id, ts, (pos % 7)::BIGINT AS phase, round(y, 6) AS y FROM (
             SELECT *, row_number() OVER (PARTITION BY series_id, isodow(ts) ORDER BY ts DESC) AS rn
             FROM dgrid) WHERE rn <= 20""",
        "dgrid",
    ),
)
def w6(spark, sf_dir):
    return P.last_rows_per_phase(T.daily_grid(spark, sf_dir), DAILY, 20).select(
        SERIES, "ts", "phase", r("y")
    )


@query(
    "w7_quantile_diff",
    with_ctes(
        """SELECT series_id, fold, ts, round(q[2] - q[1], 6) AS d25, round(q[3] - q[2], 6) AS d50,
           round(q[4] - q[3], 6) AS d75, round(q[5] - q[4], 6) AS d975 FROM dpred""",
        "dpred",
    ),
)
def w7(spark, sf_dir):
    rows = evaluate.daily_backtest(spark, sf_dir)
    steps = zip(QCOLS, QCOLS[1:])
    return rows.select(
        SERIES,
        "fold",
        "ts",
        *[F.round(F.col(b) - F.col(a), 6).alias(b.replace("q", "d")) for a, b in steps],
    )


def _acf_sql(lags: int, digits: int) -> str:
    return f"""SELECT series_id, (a.pos - b.pos)::BIGINT AS lag,
          round(sum(a.d * b.d) / any_value(s.s0), {digits}) AS acf
        FROM c a JOIN c b USING (series_id)
        JOIN (SELECT series_id, sum(d * d) AS s0 FROM c GROUP BY 1) s USING (series_id)
        WHERE a.pos - b.pos BETWEEN 0 AND {lags} GROUP BY 1, 2"""


def _acf_query(grid: str, lags: int, digits: int = 8) -> str:
    select = _acf_sql(lags, digits)
    centred = f"SELECT series_id, pos, y - avg(y) OVER (PARTITION BY series_id) AS d FROM {grid}"
    return with_ctes(select, grid, c=centred)


@query("w8_autocorrelation_daily", _acf_query("dfill", 30))
def w8_daily(spark, sf_dir):
    out = eda.autocorrelation(T.daily_filled(spark, sf_dir), 30)
    return out.select(SERIES, "lag", r("acf", 8))


@query("w8_autocorrelation_hourly", _acf_query("hfill", 336))
def w8_hourly(spark, sf_dir):
    out = eda.autocorrelation(T.hourly_filled(spark, sf_dir), 336)
    return out.select(SERIES, "lag", r("acf", 8))


# Durbin-Levinson, one lag a step: r[k + 1] is the autocorrelation at lag k.
_PACF_STEP = """SELECT series_id, r, k + 1 AS k, last AS pacf,
      list_append(list_transform(range(1, k + 1), lambda j: phi[j] - last * phi[k + 1 - j]), last) AS phi
    FROM (SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0))
            / (1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1])), 0)) AS last
          FROM dl WHERE k < 30)"""


@query(
    "w8_partial_autocorrelation",
    f"""WITH RECURSIVE acf AS (SELECT * FROM ({_acf_query("dfill", 30, 17)})),
    dl AS (
      SELECT series_id, list(acf ORDER BY lag) AS r, 0 AS k, 1.0::DOUBLE AS pacf, []::DOUBLE[] AS phi
      FROM acf GROUP BY 1
      UNION ALL {_PACF_STEP})
    SELECT series_id, k AS lag, round(pacf, 6) AS pacf FROM dl""",
)
def w8_partial(spark, sf_dir):
    out = eda.partial_autocorrelation(eda.autocorrelation(T.daily_filled(spark, sf_dir), 30))
    return out.select(SERIES, "lag", r("pacf"))


@query(
    "w9_nearest_value",
    with_ctes(
        """SELECT series_id, ts,
             round(last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS ffill,
             round(first_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS bfill FROM dgrid""",
        "dgrid",
    ),
)
def w9(spark, sf_dir):
    return P.fill_nearest(T.daily_grid(spark, sf_dir), "y").select(
        SERIES, "ts", r("ffill"), r("bfill")
    )


# --- sorts, limits, top-k -----------------------------------------------------------


@query(
    "o1_sort_by_time",
    with_ctes("SELECT series_id, ts, round(y, 6) AS y FROM hourly ORDER BY 1, 2", "hourly"),
)
def o1(spark, sf_dir):
    return T.hourly(spark, sf_dir).select(SERIES, "ts", r("y")).orderBy(SERIES, "ts")


@query(
    "o2_sort_by_metric",
    with_ctes(
        """SELECT series_id, fold, round(pinball_loss, 6) AS pinball_loss FROM dfold
           ORDER BY pinball_loss DESC""",
        "dfold",
    ),
)
def o2(spark, sf_dir):
    folds = evaluate.daily_folds(spark, sf_dir)
    return folds.select(SERIES, "fold", r("pinball_loss")).orderBy(F.desc("pinball_loss"))


@query(
    "o3_top_k",
    with_ctes(
        """SELECT feature, round(importance, 6) AS importance FROM (
             SELECT strftime(ts, '%m-%d') AS feature, avg(abs(y - q50)) AS importance
             FROM dscored GROUP BY 1) ORDER BY importance DESC, feature LIMIT 55""",
        "dscored",
    ),
)
def o3(spark, sf_dir):
    """The 55 calendar days with the largest mean absolute error."""
    rows = scoring.scored(evaluate.daily_backtest(spark, sf_dir))
    by_day = rows.groupBy(F.date_format("ts", "MM-dd").alias("feature")).agg(
        F.avg(F.abs(F.col("y") - F.col("q50"))).alias("importance")
    )
    return top_features(by_day, 55).select("feature", r("importance"))


@query(
    "o4_rearrange",
    with_ctes(
        """SELECT series_id, fold, ts, round(s[1], 6) AS q025, round(s[2], 6) AS q25,
             round(s[3], 6) AS q50, round(s[4], 6) AS q75, round(s[5], 6) AS q975 FROM (
             SELECT series_id, fold, ts,
               list_sort([q[1] * 1.3::DOUBLE, q[2], q[3], q[4], q[5] * 0.7::DOUBLE]) AS s FROM dpred)""",
        "dpred",
    ),
)
def o4(spark, sf_dir):
    rows = evaluate.daily_backtest(spark, sf_dir)
    crossed = rows.withColumns({"q025": F.col("q025") * 1.3, "q975": F.col("q975") * 0.7})
    return scoring.rearrange(crossed).select(SERIES, "fold", "ts", *[r(c) for c in QCOLS])


@query(
    "o5_pick_folds",
    with_ctes(
        """SELECT series_id, fold, ts, h, round(y, 6) AS y, round(q[3], 6) AS q50 FROM (
             SELECT *, max(fold) OVER (PARTITION BY series_id) AS last FROM dpred)
           WHERE fold IN (0, 8, 10, 47) OR fold = last""",
        "dpred",
    ),
)
def o5(spark, sf_dir):
    """Folds by position; the last one follows from the series length."""


    rows = evaluate.daily_backtest(spark, sf_dir)
    last = n_folds(F.col("n_rows"), evaluate.DAILY_SPLIT.params) - 1
    picked = rows.filter(F.col("fold").isin(0, 8, 10, 47) | (F.col("fold") == last))
    return picked.select(SERIES, "fold", "ts", "h", r("y"), r("q50"))


@query(
    "o6_history_tail",
    with_ctes(
        """SELECT series_id, ts, round(y, 6) AS y FROM (
             SELECT *, max(CASE WHEN y IS NOT NULL THEN ts END) OVER (PARTITION BY series_id) AS hi
             FROM jgrid) WHERE ts >= hi - INTERVAL 14 DAY AND ts <= hi""",
        "jgrid",
    ),
)
def o6(spark, sf_dir):
    return P.tail_of_history(T.joined(spark, sf_dir), DAILY, 14).select(SERIES, "ts", r("y"))


# --- set operations ------------------------------------------------------------------


@query(
    "u1_union_all",
    """SELECT l_orderkey AS k, l_shipdate AS ts, 'ship' AS kind FROM lineitem
       UNION ALL SELECT o_orderkey, o_orderdate, 'order' FROM orders""",
)
def u1(spark, sf_dir):
    ships = T.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("ts"), F.lit("ship").alias("kind")
    )
    orders = T.table(spark, sf_dir, "orders").select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("ts")
    )
    return ships.unionByName(orders)


@query(
    "u2_union_distinct",
    with_ctes(
        "SELECT series_id, ts FROM daily UNION SELECT series_id, ts FROM cov", "daily", "cov"
    ),
)
def u2(spark, sf_dir):
    history = T.daily(spark, sf_dir).select(SERIES, "ts")
    horizon = T.covariates(spark, sf_dir).select(SERIES, "ts")
    return history.union(horizon).distinct()


@query(
    "u3_difference",
    with_ctes(
        """SELECT 'only history' AS side, series_id, ts FROM
             (SELECT series_id, ts FROM daily EXCEPT SELECT series_id, ts FROM cov)
           UNION ALL SELECT 'only covariates', series_id, ts FROM
             (SELECT series_id, ts FROM cov EXCEPT SELECT series_id, ts FROM daily)""",
        "daily",
        "cov",
    ),
)
def u3(spark, sf_dir):
    history = T.daily(spark, sf_dir).select(SERIES, "ts")
    horizon = T.covariates(spark, sf_dir).select(SERIES, "ts")
    a = history.exceptAll(horizon).select(F.lit("only history").alias("side"), SERIES, "ts")
    return a.union(
        horizon.exceptAll(history).select(F.lit("only covariates").alias("side"), SERIES, "ts")
    )
