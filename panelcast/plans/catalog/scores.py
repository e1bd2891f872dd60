"""Scores of probabilistic forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.config import LEVELS, QCOLS
from panelcast.operators import scoring
from panelcast.operators.panel import SERIES
from panelcast.plans import evaluate
from panelcast.plans.catalog.registry import query, r, with_ctes


@query(
    "e1_pinball_loss",
    with_ctes(
        "SELECT series_id, fold, "
        + ", ".join(f"round(loss_{c}, 6) AS {c}" for c in QCOLS)
        + " FROM dfold",
        "dfold",
    ),
)
def e1(spark, sf_dir):
    folds = evaluate.daily_folds(spark, sf_dir)
    return folds.select(SERIES, "fold", *[r(f"loss_{c}", alias=c) for c in QCOLS])


@query(
    "e2_total_pinball",
    with_ctes(
        """SELECT series_id, round(avg(pinball_loss), 6) AS mean,
             round(stddev_samp(pinball_loss), 6) AS std FROM dfold GROUP BY 1""",
        "dfold",
    ),
)
def e2(spark, sf_dir):
    return (
        evaluate.daily_folds(spark, sf_dir)
        .groupBy(SERIES)
        .agg(
            F.round(F.avg("pinball_loss"), 6).alias("mean"),
            F.round(F.stddev_samp("pinball_loss"), 6).alias("std"),
        )
    )


@query(
    "e3_interval_score",
    with_ctes(
        """SELECT series_id, fold, ts,
             round((q75 - q25) + (2 / 0.5::DOUBLE) * (CASE WHEN y < q25 THEN q25 - y ELSE 0 END
               + CASE WHEN y > q75 THEN y - q75 ELSE 0 END), 6) AS is50,
             round((q975 - q025) + (2 / 0.05::DOUBLE) * (CASE WHEN y < q025 THEN q025 - y ELSE 0 END
               + CASE WHEN y > q975 THEN y - q975 ELSE 0 END), 6) AS is95 FROM dscored""",
        "dscored",
    ),
)
def e3(spark, sf_dir):
    rows = scoring.scored(evaluate.daily_backtest(spark, sf_dir))
    y, c = F.col("y"), F.col
    is50 = scoring.interval_score(y, c("q25"), c("q75"), 0.5)
    is95 = scoring.interval_score(y, c("q025"), c("q975"), 0.05)
    return rows.select(
        SERIES, "fold", "ts", F.round(is50, 6).alias("is50"), F.round(is95, 6).alias("is95")
    )


@query(
    "e4_interval_score_from_pinball",
    with_ctes(
        """SELECT series_id, fold, round(interval_score_50, 6) AS is50,
             round(interval_score_95, 6) AS is95 FROM dfold""",
        "dfold",
    ),
)
def e4(spark, sf_dir):
    return evaluate.daily_folds(spark, sf_dir).select(
        SERIES,
        "fold",
        r("interval_score_50", alias="is50"),
        r("interval_score_95", alias="is95"),
    )


@query(
    "e5_coverage",
    with_ctes(
        """SELECT series_id, fold, round(avg((y >= q25 AND y <= q75)::INT), 8) AS closed_50,
             round(avg((y >= q025 AND y <= q975)::INT), 8) AS closed_95,
             round(avg((y > q25 AND y < q75)::INT), 8) AS open_50 FROM dscored GROUP BY ALL""",
        "dscored",
    ),
)
def e5(spark, sf_dir):
    rows = scoring.scored(evaluate.daily_backtest(spark, sf_dir))
    y, c = F.col("y"), F.col
    hits = {
        "closed_50": scoring.covered(y, c("q25"), c("q75")),
        "closed_95": scoring.covered(y, c("q025"), c("q975")),
        "open_50": scoring.covered(y, c("q25"), c("q75"), closed=False),
    }
    return rows.groupBy(SERIES, "fold").agg(
        *[F.round(F.avg(v), 8).alias(k) for k, v in hits.items()]
    )


_CALIBRATION = " UNION ALL ".join(
    f"SELECT series_id, {q}::DOUBLE AS level, round(avg(hit_{c}), 8) AS mean, "
    f"round(stddev_pop(hit_{c}), 8) AS std FROM dfold GROUP BY 1"
    for c, q in zip(QCOLS, LEVELS, strict=True)
)


@query("e6_calibration", with_ctes(_CALIBRATION, "dfold"))
def e6(spark, sf_dir):
    curve = scoring.calibration(evaluate.daily_folds(spark, sf_dir))
    return curve.select(SERIES, "level", r("mean", 8), r("std", 8))
