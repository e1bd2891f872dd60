"""Submissions, and the stages end to end."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from panelcast.config import HORIZONS, LEVELS, QCOLS, SUBMISSION_QCOLS
from panelcast.functions.calendar import DAILY, HOURLY
from panelcast.models.registry import get_model
from panelcast.operators.folds import n_folds
from panelcast.operators.panel import SERIES, regularize, tail_of_history
from panelcast.operators.scoring import intervals
from panelcast.operators.submission import check_submission, verdict
from panelcast.plans import evaluate, submit
from panelcast.plans import tables as T
from panelcast.plans.catalog.cleaning import _prefix_sql
from panelcast.plans.catalog.joins import _EASTER_SQL
from panelcast.plans.catalog.registry import (
    LEVELS_SQL,
    LOSSES_SQL,
    filled_sql,
    query,
    r,
    with_ctes,
)
from panelcast.plans.prepare import Target, prepare, prepare_target, read_weather
from panelcast.session import scratch_dir, stage
from panelcast.sources import artifacts, landed, landing

_TODAY = "2024-02-01"

_SKELETON = " UNION ALL ".join(
    f"SELECT {i} AS row_id, '{t}' AS target, '{h}' AS horizon"
    for i, (t, h) in enumerate((t, h) for t, hs in HORIZONS.items() for h in hs)
)

_SUB = {
    "bgrid": """SELECT g.ts, b.y FROM (
          SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM braw) g
        LEFT JOIN braw b USING (ts)""",
    "egrid": """SELECT g.ts, e.y FROM (
          SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM eraw) g
        LEFT JOIN eraw e USING (ts)""",
    "latest": """SELECT greatest((SELECT max(ts) FROM bgrid)::DATE,
        (SELECT max(ts) FROM egrid)::DATE) AS t""",
    "bwed": "SELECT (t + ((9 - (isodow(t) - 1)) % 7)::INT)::TIMESTAMP AS w FROM latest",
    "ewed": "SELECT w AS s FROM bwed",
    "bfc": f"""SELECT 'bikes' AS target, k.d::VARCHAR || ' day' AS horizon,
          quantile_cont(h.y, {LEVELS_SQL}) AS q
        FROM bwed, (VALUES (1), (2), (3), (4), (5), (6)) k(d),
          (SELECT *, row_number() OVER (PARTITION BY isodow(ts) ORDER BY ts DESC) AS rn FROM bgrid) h
        WHERE isodow(h.ts) = isodow(w + to_days(k.d)) AND rn <= 4 GROUP BY ALL""",
    "efc": f"""SELECT 'energy' AS target,
          date_diff('hour', s::DATE::TIMESTAMP + INTERVAL 1 DAY, f.ts)::VARCHAR || ' hour' AS horizon,
          quantile_cont(h.y, {LEVELS_SQL}) AS q
        FROM (SELECT s, unnest(generate_series(s, s + INTERVAL 5 DAY, INTERVAL 1 HOUR)) AS ts
              FROM ewed) f,
          (SELECT *, row_number() OVER (PARTITION BY isodow(ts), hour(ts) ORDER BY ts DESC) AS rn
           FROM egrid) h
        WHERE hour(f.ts) IN (12, 16, 20) AND isodow(f.ts) IN (5, 6)
          AND isodow(h.ts) = isodow(f.ts) AND hour(h.ts) = hour(f.ts) AND rn <= 4 GROUP BY ALL""",
    "sub": f"""SELECT k.row_id, (SELECT strftime(greatest(w, s::DATE::TIMESTAMP), '%Y-%m-%d')
                          FROM bwed, ewed) AS forecast_date, k.target, k.horizon, {", ".join(
        f"CASE WHEN f.q[{i}] < 0 THEN 0 ELSE f.q[{i}] END AS {c}" for i, c in enumerate(QCOLS, 1)
    )} FROM ({_SKELETON}) k LEFT JOIN (SELECT * FROM bfc UNION ALL SELECT * FROM efc) f
        USING (target, horizon)""",
}
_RAW = {
    "braw": """SELECT date_trunc('day', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS y
        FROM events WHERE event_type = 'click' GROUP BY 1""",
    "eraw": """SELECT date_trunc('hour', ts)::TIMESTAMP AS ts,
          round(sum(value), 2) / (1.95583::DOUBLE * 10) AS y
        FROM events WHERE event_type = 'view' GROUP BY 1""",
}
_SUBMISSION_SQL = with_ctes(
    "SELECT row_id, forecast_date, target, horizon, "
    + ", ".join(f'round({c}, 6) AS "{s}"' for c, s in zip(QCOLS, SUBMISSION_QCOLS, strict=True))
    + " FROM sub",
    **_RAW,
    **_SUB,
)


def _rounded(df):
    return df.select(
        "row_id",
        "forecast_date",
        "target",
        "horizon",
        *[r(s) for s in SUBMISSION_QCOLS],
    )


@query("v1_build_submission", _SUBMISSION_SQL)
def v1(spark, sf_dir):
    return _rounded(submit.submission(spark, sf_dir))


@query(
    "v2_horizon_labels",
    with_ctes(
        """SELECT target, horizon FROM sub WHERE target <> 'no2'""",
        **_RAW,
        **_SUB,
    ),
)
def v2(spark, sf_dir):
    return submit.target_forecasts(spark, sf_dir).select("target", "horizon")


def _rules(df, names):
    return (
        check_submission(df, _TODAY)
        .filter(F.col("rule").isin(*names))
        .select("rule", "severity", "violations")
    )


def _q(name):
    return F.col(f"`{name}`")


@query(
    "v3_column_rules",
    with_ctes(
        """SELECT * FROM (VALUES ('column_count', 'fail', 1), ('column_names', 'fail', 1),
             ('column_order', 'fail', 7)) v(rule, severity, violations)
           WHERE (SELECT count(*) FROM sub) = 18""",
        **_RAW,
        **_SUB,
    ),
)
def v3(spark, sf_dir):
    """A surplus column in front of the others."""
    sub = submit.submission(spark, sf_dir)
    cols = [f"`{c}`" for c in sub.columns if c != "row_id"]
    bad = sub.select("row_id", cols[0], F.lit(1).alias("surplus"), *cols[1:])
    return _rules(bad, ["column_count", "column_names", "column_order"])


def _rule_sql(violations: str, rule: str, severity: str) -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, ({violations})::BIGINT AS violations"


_WANTED = ", ".join(
    f"('{t}', [" + ", ".join(f"'{h}'" for h in hs) + "])" for t, hs in HORIZONS.items()
)
_ANY_NULL = " OR ".join(f"{c} IS NULL" for c in QCOLS)


@query(
    "v4_type_rules",
    with_ctes(
        " UNION ALL ".join(
            [_rule_sql("SELECT count(*) FROM sub WHERE row_id % 4 = 1", "date_format", "fail")]
            + [
                _rule_sql(
                    f"SELECT count(*) FROM sub WHERE {c} IS NULL OR row_id = {i}",
                    f"numeric_{s}",
                    "warn",
                )
                for i, (c, s) in enumerate(zip(QCOLS, SUBMISSION_QCOLS, strict=True), 3)
            ]
        ),
        **_RAW,
        **_SUB,
    ),
)
def v4(spark, sf_dir):
    """Some dates in another format, one value of each quantile that is not a number."""
    sub = submit.submission(spark, sf_dir)
    bad = sub.withColumn(
        "forecast_date",
        F.when(F.col("row_id") % 4 == 1, "31/01/2024").otherwise(F.col("forecast_date")),
    )
    for i, s in enumerate(SUBMISSION_QCOLS, 3):
        bad = bad.withColumn(s, F.when(F.col("row_id") == i, "x").otherwise(_q(s).cast("string")))
    return _rules(bad, ["date_format", *[f"numeric_{s}" for s in SUBMISSION_QCOLS]])


@query(
    "v5_date_rules",
    with_ctes(
        " UNION ALL ".join(
            [
                _rule_sql("SELECT count(DISTINCT forecast_date) FROM sub", "single_date", "fail"),
                _rule_sql(
                    f"SELECT (max(forecast_date)::DATE + 1 < DATE '{_TODAY}')::INT FROM sub",
                    "date_not_past",
                    "warn",
                ),
                _rule_sql(
                    "SELECT (isodow(max(forecast_date)::DATE + 1) <> 3)::INT FROM sub",
                    "date_is_wednesday",
                    "warn",
                ),
            ]
        ),
        **_RAW,
        **_SUB,
    ),
)
def v5(spark, sf_dir):
    """The first rows a day late: two dates, the first a Thursday."""
    sub = submit.submission(spark, sf_dir)
    late = F.date_format(F.date_add(F.to_date("forecast_date"), 1), "yyyy-MM-dd")
    bad = sub.withColumn(
        "forecast_date", F.when(F.col("row_id") < 5, late).otherwise(F.col("forecast_date"))
    )
    return _rules(bad, ["single_date", "date_not_past", "date_is_wednesday"])


@query(
    "v6_target_rules",
    with_ctes(
        " UNION ALL ".join(
            [
                _rule_sql(
                    "SELECT count(*) FROM bad WHERE target NOT IN ('bikes', 'energy', 'no2')",
                    "known_targets",
                    "fail",
                ),
                _rule_sql(
                    """SELECT sum(abs(6 - (SELECT count(*) FROM bad b WHERE b.target = t.target)))
                       FROM (VALUES ('bikes'), ('energy'), ('no2')) t(target)""",
                    "rows_per_target",
                    "fail",
                ),
                _rule_sql(
                    f"""SELECT count(*) FROM (VALUES {_WANTED}) t(target, wanted)
                       WHERE (SELECT list(horizon ORDER BY row_id) FROM moved m
                              WHERE m.target = t.target) <> wanted""",
                    "horizon_order",
                    "fail",
                ),
                _rule_sql(
                    """SELECT count(*) FROM bad b JOIN (VALUES ('bikes', 10000), ('energy', 200),
                         ('no2', 300)) t(target, high) USING (target)
                       WHERE least(q025, q25, q50, q75, q975) < 0
                          OR greatest(q025, q25, q50, q75, q975) > high""",
                    "plausible_range",
                    "warn",
                ),
            ]
        ),
        **_RAW,
        **_SUB,
        bad="""SELECT row_id, CASE WHEN row_id = 17 THEN 'ozone' ELSE target END AS target,
                 horizon, q025, q25, q50, q75,
                 CASE WHEN target = 'energy' THEN q975 * 20 ELSE q975 END AS q975
               FROM sub""",
        moved="""SELECT CASE row_id WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE row_id END AS row_id,
                   target, horizon FROM bad""",
    ),
)
def v6(spark, sf_dir):
    """An unknown target, two horizons out of order, and implausible values."""
    sub = submit.submission(spark, sf_dir)
    rid = F.col("row_id")
    top = SUBMISSION_QCOLS[-1]
    bad = (
        sub.withColumn("target", F.when(rid == 17, "ozone").otherwise(F.col("target")))
        .withColumn("row_id", F.when(rid == 2, 3).when(rid == 3, 2).otherwise(rid))
        .withColumn(
            top,
            F.when(F.col("target") == "energy", _q(top) * 20).otherwise(_q(top)),
        )
    )
    return _rules(bad, ["known_targets", "rows_per_target", "horizon_order", "plausible_range"])


@query(
    "v7_null_rule",
    with_ctes(
        _rule_sql(
            f"SELECT count(*) - 6 FROM sub WHERE {_ANY_NULL} OR horizon = '1 day'",
            "one_null_target",
            "fail",
        ),
        **_RAW,
        **_SUB,
    ),
)
def v7(spark, sf_dir):
    """A missing value outside the missing target."""
    sub = submit.submission(spark, sf_dir)
    mid = SUBMISSION_QCOLS[2]
    hole = F.when(F.col("horizon") != "1 day", _q(mid))
    return _rules(sub.withColumn(mid, hole), ["one_null_target"])


@query(
    "v8_quantile_order",
    with_ctes(
        _rule_sql(
            """SELECT count(*) FROM (SELECT *, q025 + 1 AS lifted FROM sub) WHERE target <> 'no2'
               AND (lifted > q25 OR q25 > q50 OR q50 > q75 OR q75 > q975
                    OR lifted IS NULL OR q975 IS NULL)""",
            "quantile_order",
            "fail",
        ),
        **_RAW,
        **_SUB,
    ),
)
def v8(spark, sf_dir):
    """The lowest quantile lifted by one, above its neighbour in some rows."""
    sub = submit.submission(spark, sf_dir)
    low = SUBMISSION_QCOLS[0]
    return _rules(sub.withColumn(low, _q(low) + 1), ["quantile_order"])


@query(
    "v9_verdict",
    with_ctes(
        f"""SELECT 'as built' AS version, holes <= 6 AS ok,
              CASE WHEN holes > 6 THEN 'one_null_target' END AS first_failure,
              5 + (SELECT (max(forecast_date)::DATE < DATE '{_TODAY}')::INT FROM sub)
                + (SELECT (isodow(max(forecast_date)::DATE) <> 3)::INT FROM sub)
                + (SELECT (count(*) > 0)::INT FROM sub WHERE (target = 'energy' AND q975 > 200)
                     OR (target = 'bikes' AND q975 > 10000)) AS warnings
            FROM (SELECT count(*) FILTER (WHERE {_ANY_NULL}) AS holes FROM sub)
            UNION ALL
            SELECT 'renamed target', false, 'known_targets',
              5 + (SELECT (max(forecast_date)::DATE < DATE '{_TODAY}')::INT FROM sub)
                + (SELECT (isodow(max(forecast_date)::DATE) <> 3)::INT FROM sub)
                + (SELECT (count(*) > 0)::INT FROM sub WHERE target = 'energy' AND q975 > 200)""",
        **_RAW,
        **_SUB,
    ),
)
def v9(spark, sf_dir):
    sub = submit.submission(spark, sf_dir)
    renamed = sub.withColumn(
        "target", F.when(F.col("target") == "bikes", "bike").otherwise(F.col("target"))
    )
    versions = [("as built", sub), ("renamed target", renamed)]
    parts = [
        verdict(check_submission(df, _TODAY)).select(F.lit(name).alias("version"), "*")
        for name, df in versions
    ]
    return parts[0].unionByName(parts[1])


@query("v10_submit", _SUBMISSION_SQL)
def v10(spark, sf_dir):
    """Forecast, build, write the file, read it back and check what was read.

    A file that breaks a rule is reported and stays, for whoever has to look into it.
    """
    path = scratch_dir(spark, "submission")
    back = submit.write_submission(submit.submission(spark, sf_dir), path)
    result = verdict(check_submission(back, _TODAY)).first()
    if not result["ok"]:
        warnings.warn(f"submission breaks the rule {result['first_failure']}", stacklevel=1)
    return _rounded(back)


@query(
    "v10_submit_fitted",
    f"""SELECT s.row_id, s.target, s.horizon, s.target = 'no2' AS is_null, true AS is_ordered
        FROM ({_SKELETON}) s""",
)
def v10_fitted(spark, sf_dir):
    """The file from models that were fitted, saved and read back: which rows have values,
    and whether these do not decrease."""
    setups = {"bikes": get_model("quantreg", DAILY), "energy": get_model("quantreg", HOURLY)}
    root = scratch_dir(spark, "models")
    rows = submit.fitted_forecasts(spark, sf_dir, setups, root)
    back = submit.write_submission(
        submit.submission(spark, sf_dir, rows), scratch_dir(spark, "submission")
    )
    values = F.array(*[F.col(f"`{c}`") for c in SUBMISSION_QCOLS])
    known = F.filter(values, lambda v: v.isNotNull())
    return back.select(
        "row_id",
        "target",
        "horizon",
        (F.size(known) == 0).alias("is_null"),
        (F.array_sort(known) == known).alias("is_ordered"),
    )


def _prepare_sql() -> str:
    body = _prefix_sql()
    return f"""SELECT p.*, strftime(ts, '%m-%d') IN
          ('01-01','01-06','05-01','10-03','11-01','12-25','12-26')
        OR ts::DATE IN (SELECT (d + o)::DATE FROM (VALUES {_EASTER_SQL}) e(d),
          (VALUES (-2), (1), (39), (50), (60)) k(o)) AS is_holiday FROM ({body}) p"""


@query("v11_prepare", _prepare_sql())
def v11(spark, sf_dir):
    pairs, root = scratch_dir(spark, "pairs"), scratch_dir(spark, "stage")
    landing.land_pairs(T.daily(spark, sf_dir), pairs)
    out = prepare(spark, pairs, T.covariates(spark, sf_dir), DAILY, root)
    return out.select(
        F.col(SERIES).cast("string").alias(SERIES),
        "ts",
        r("y"),
        r("quantity"),
        r("discount"),
        "is_holiday",
    )


_HOLIDAY_SQL = f"""strftime(ts, '%m-%d') IN
          ('01-01','01-06','05-01','10-03','11-01','12-25','12-26')
        OR ts::DATE IN (SELECT (d + o)::DATE FROM (VALUES {_EASTER_SQL}) e(d),
          (VALUES (-2), (1), (39), (50), (60)) k(o))"""

# All hours of January 2024 are an hour later in local time.
_PREPARED_FEED = with_ctes(
    f"""SELECT series_id, ts, round(y::FLOAT::DOUBLE, 3) AS y, {_HOLIDAY_SQL} AS is_holiday FROM (
          SELECT series_id, ts + INTERVAL 1 HOUR AS ts, (y / 10) AS y FROM hfill)""",
    "hfill",
)


def _rows_of_panel(out, digits: int = 3):
    return out.select(
        F.col(SERIES).cast("string").alias(SERIES), "ts",
        F.round(F.col("y").cast("double"), digits).alias("y"), "is_holiday",
    )


@query("v11_prepare_feed", _PREPARED_FEED)
def v11_feed(spark, sf_dir):
    """An hourly target from its weekly feed, to local time, scaled, filled."""
    path, index, root = (scratch_dir(spark, n) for n in ("feed", "index", "stage"))
    landing.land_feed(T.hourly(spark, sf_dir), path, index)
    target = Target("feed", HOURLY, scale=10.0, max_lag=48)
    return _rows_of_panel(prepare_target(spark, target, path, root, index))


# An hour is labelled by its end, and 24:00 stays on its date.
_PREPARED_TEXT = with_ctes(
    f"""SELECT series_id, ts, round((CASE WHEN pos <= last THEN y END)::FLOAT::DOUBLE, 3) AS y,
          {_HOLIDAY_SQL} AS is_holiday
        FROM ({filled_sql("upto", ["y"], ", last")})""",
    "hgrid",
    labelled="""SELECT series_id, date_trunc('day', ts) + to_hours(((hour(ts) + 1) % 24)::INT) AS ts, y
        FROM hgrid""",
    backfilled="""SELECT series_id, ts, datediff('hour', TIMESTAMP '1970-01-01', ts) AS pos,
          first_value(CASE WHEN l.series_id IS NOT NULL THEN {'y': l.y} END IGNORE NULLS) OVER (
            PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING).y AS y
        FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
              FROM labelled GROUP BY 1) g LEFT JOIN labelled l USING (series_id, ts)""",
    upto="""SELECT *, max(pos) FILTER (WHERE y IS NOT NULL) OVER (PARTITION BY series_id) AS last
        FROM backfilled""",
)


@query("v11_prepare_text", _PREPARED_TEXT)
def v11_text(spark, sf_dir):
    """An hourly target from delimited text with a footer and quoted hours."""
    path, root = scratch_dir(spark, "delimited"), scratch_dir(spark, "stage")
    landing.land_delimited(T.hourly_grid(spark, sf_dir), path)
    return _rows_of_panel(prepare_target(spark, Target("text", HOURLY), path, root))


_NOW = "2001-08-01"


@query(
    "v11_prepare_stitched",
    with_ctes(
        f"""SELECT series_id, ts, round((CASE WHEN pos <= last THEN y END)::FLOAT::DOUBLE, 2) AS y,
              quantity, {_HOLIDAY_SQL} AS is_holiday
            FROM ({filled_sql("seen", ["y"], ", last, quantity")})""",
        "daily",
        "cov",
        seen="""SELECT g.series_id, g.ts, datediff('day', DATE '1970-01-01', g.ts::DATE) AS pos, d.y,
              coalesce(c.quantity, 0)::DOUBLE AS quantity,
              max(CASE WHEN d.y IS NOT NULL THEN datediff('day', DATE '1970-01-01', g.ts::DATE) END)
                OVER (PARTITION BY g.series_id) AS last
            FROM (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts
                  FROM cov GROUP BY 1) g
            LEFT JOIN cov c USING (series_id, ts) LEFT JOIN daily d USING (series_id, ts)""",
    ),
)
def v11_stitched(spark, sf_dir):
    """A daily target from JSON pairs, its weather stitched from history and a forecast feed
    (packed arrays) that knows sixty days back; one of two variables stays."""
    pairs, root = scratch_dir(spark, "pairs"), scratch_dir(spark, "stage")
    landing.land_pairs(T.daily(spark, sf_dir), pairs)
    names = ["quantity", "discount"]
    weather = stage(regularize(T.covariates(spark, sf_dir), DAILY, names).fillna(0.0), "weather")
    # history ends thirty days before now, and is wrong where the feed knows better
    now = F.lit(_NOW).cast("timestamp_ntz")
    recent = F.col("ts") >= now - F.expr("interval 60 days")
    history = weather.filter(F.col("ts") < now - F.expr("interval 30 days"))
    history = history.withColumn("quantity", F.when(recent, -1.0).otherwise(F.col("quantity")))
    feeds = []
    for frame in (history, weather):
        path = scratch_dir(spark, "packed")
        landing.land_packed(frame, names, path)
        schema = (
            "series_id string, start long, end long, interval_seconds long, "
            "quantity array<double>, discount array<double>"
        )
        feeds.append(landed.unpack_arrays(spark.read.schema(schema).json(path), names))
    stitched = stage(read_weather(*feeds, DAILY, now, 60, 120), "stitched")
    target = Target("pairs", DAILY, weather=("quantity",), max_lag=28)
    out = prepare_target(spark, target, pairs, root, weather=stitched)
    return _rows_of_panel(out, 2).join(
        out.select(F.col(SERIES).cast("string").alias(SERIES), "ts", "quantity"), [SERIES, "ts"]
    )


@query(
    "v12_plot_table",
    with_ctes(
        """SELECT coalesce(a.series_id, p.series_id) AS series_id, coalesce(a.ts, p.ts) AS ts,
             round(a.y, 6) AS actual, round(p.median, 6) AS median, p.coverage,
             round(p.lower, 6) AS lower, round(p.upper, 6) AS upper
           FROM (SELECT series_id, ts, y FROM (
                   SELECT *, max(ts) OVER (PARTITION BY series_id) AS hi FROM dgrid)
                 WHERE ts >= hi - INTERVAL 14 DAY) a
           FULL JOIN (
             SELECT series_id, ts, q[3] AS median, 0.5::DOUBLE AS coverage, q[2] AS lower,
                    q[4] AS upper FROM last
             UNION ALL SELECT series_id, ts, q[3], 0.95::DOUBLE, q[1], q[5] FROM last) p
             ON a.series_id = p.series_id AND a.ts = p.ts""",
        "dpred",
        last="""SELECT * FROM (SELECT *, max(fold) OVER (PARTITION BY series_id) AS top FROM dpred)
                WHERE fold = top""",
    ),
)
def v12(spark, sf_dir):
    """Last two weeks of history with the last fold's forecast bands."""
    rows = evaluate.daily_backtest(spark, sf_dir)
    last = n_folds(F.col("n_rows"), evaluate.DAILY_SPLIT.params) - 1
    bands = intervals(rows.filter(F.col("fold") == last), [SERIES, "ts"])
    actual = tail_of_history(T.daily_grid(spark, sf_dir), DAILY, 14).select(
        SERIES, "ts", F.col("y").alias("actual")
    )
    return actual.join(bands, [SERIES, "ts"], "full").select(
        SERIES, "ts", r("actual"), r("median"), "coverage", r("lower"), r("upper")
    )


@query(
    "v14_evaluate",
    with_ctes(
        """SELECT series_id, metric, round(mean, 6) AS mean, round(std, 6) AS std FROM dmetrics""",
        "dmetrics",
    ),
)
def v14(spark, sf_dir):
    """Panel, grid, folds, one-pass backtest, scores, metrics."""
    return evaluate.evaluate(spark, sf_dir).select(SERIES, "metric", r("mean"), r("std"))


# Two years of weekly folds from a day on, on data from another day on.
PERIOD = evaluate.Period("1998-10-23", "2000-10-23", "1996-03-01")


def _dated_ctes() -> dict[str, str]:
    """Every series has a window of its own: its rows up to the first day."""
    grid = f"""SELECT g.series_id, g.ts, d.y,
            row_number() OVER (PARTITION BY g.series_id ORDER BY g.ts) - 1 AS idx,
            count(*) OVER (PARTITION BY g.series_id) AS n_rows,
            count(*) FILTER (WHERE g.ts < TIMESTAMP '{PERIOD.first}' + INTERVAL 1 DAY)
              OVER (PARTITION BY g.series_id) AS w
          FROM (SELECT series_id, unnest(generate_series(
                  greatest(min(ts), TIMESTAMP '{PERIOD.cutoff}'),
                  least(max(ts), TIMESTAMP '{PERIOD.last}'), INTERVAL 1 DAY)) AS ts
                FROM daily GROUP BY series_id) g LEFT JOIN daily d USING (series_id, ts)"""
    pred = f"""SELECT series_id, fold, ts, y, quantile_cont(past, {LEVELS_SQL}) AS q FROM (
          SELECT t.*, p.y AS past, row_number() OVER (
            PARTITION BY t.series_id, t.fold, t.ts ORDER BY p.idx DESC) AS rn
          FROM (SELECT g.*, f.fold, g.w - 1 + f.fold * 7 AS cut
                FROM grid g JOIN (
                  SELECT series_id, unnest(range(0, (n_rows - w - 7) // 7 + 1)) AS fold
                  FROM (SELECT DISTINCT series_id, n_rows, w FROM grid) WHERE n_rows >= w + 7) f
                  USING (series_id)
                WHERE g.idx BETWEEN g.w + f.fold * 7 AND g.w + 6 + f.fold * 7) t
          JOIN grid p ON p.series_id = t.series_id AND p.idx <= t.cut AND p.idx > t.cut - t.w
            AND (t.idx - p.idx) % 7 = 0)
          WHERE rn <= 100 GROUP BY ALL"""
    scored = """SELECT series_id, fold, ts, y, q[1] AS q025, q[2] AS q25, q[3] AS q50, q[4] AS q75,
          q[5] AS q975 FROM pred WHERE y IS NOT NULL"""
    fold = f"SELECT series_id, fold, {LOSSES_SQL} FROM scored GROUP BY ALL"
    return {"grid": grid, "pred": pred, "scored": scored, "fold_scores": fold}


_DATED_COLS = ", ".join(
    f'round(loss_{c}, 6) AS "{q}"' for c, q in zip(QCOLS, LEVELS, strict=True)
)


@query(
    "v14_evaluate_period",
    with_ctes(
        f"""SELECT f.series_id, f.fold, lo + to_days((w - 1 + f.fold * 7)::INT) AS cutoff,
              w AS len_train_window, {_DATED_COLS},
              round(loss_q025 + loss_q25 + loss_q50 + loss_q75 + loss_q975, 6) AS "test_PinballLoss"
            FROM fold_scores f JOIN (SELECT series_id, min(ts) AS lo, any_value(w) AS w
                                     FROM grid GROUP BY 1) USING (series_id)""",
        "daily",
        **_dated_ctes(),
    ),
)
def v14_period(spark, sf_dir):
    """Dates give the folds; results as they are read back from the CSV sink."""
    root = scratch_dir(spark, "evaluation")
    setup = get_model("benchmark", DAILY)
    results, _ = evaluate.evaluate_period(T.daily_grid(spark, sf_dir), DAILY, setup, PERIOD, root)
    back = artifacts.read_csv(spark, f"{root}/eval_results", results.schema)
    losses = [*map(str, LEVELS), "test_PinballLoss"]
    return back.select(
        SERIES, "fold", "cutoff", "len_train_window",
        *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in losses],
    )
