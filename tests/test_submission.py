import pytest
from pyspark.sql import functions as F

from panelcast.config import HORIZONS, QCOLS, SUBMISSION_QCOLS
from panelcast.operators.submission import build_submission, check_submission, verdict

# Own values: five rising quantiles per horizon, inside the plausible ranges.
BIKES = [[1000.0 + 100 * day + 700 * k for k in range(5)] for day in range(6)]
ENERGY = [[40.0 + hour + 6.5 * k for k in range(5)] for hour in range(6)]
WEDNESDAY = "2024-10-23"


def forecasts(spark, drop=None):
    rows = []
    for target, table in (("bikes", BIKES), ("energy", ENERGY)):
        for h, q in zip(HORIZONS[target], table, strict=True):
            if (target, h) != drop:
                rows.append((target, h, *map(float, q)))
    cols = ", ".join(f"{c} double" for c in QCOLS)
    return spark.createDataFrame(rows, f"target string, horizon string, {cols}")


@pytest.fixture
def sub(spark):
    return build_submission(forecasts(spark), F.lit(WEDNESDAY)).persist()


def q(name):
    return F.col(f"`{name}`")


def outcome(df, today="2024-10-23"):
    return verdict(check_submission(df, today)).first()


def test_golden_frame(sub):
    rows = sub.orderBy("row_id").collect()
    assert sub.columns == ["row_id", "forecast_date", "target", "horizon", *SUBMISSION_QCOLS]
    assert [r.target for r in rows] == ["bikes"] * 6 + ["energy"] * 6 + ["no2"] * 6
    assert [r.horizon for r in rows[6:12]] == list(HORIZONS["energy"])
    assert [[r[s] for s in SUBMISSION_QCOLS] for r in rows[:6]] == BIKES
    assert all(r[s] is None for r in rows[12:] for s in SUBMISSION_QCOLS)


def test_negative_values_are_cut(spark):
    low = forecasts(spark).withColumn("q025", F.lit(-5.0))
    rows = build_submission(low, F.lit(WEDNESDAY)).filter("target = 'bikes'").collect()
    assert {r["q0.025"] for r in rows} == {0.0}


def test_wrong_shape_raises(spark):
    partial = forecasts(spark, drop=("bikes", "2 day"))
    with pytest.raises(Exception, match="invalid shape"):
        build_submission(partial, F.lit(WEDNESDAY)).collect()


def test_unknown_label_raises(spark):
    extra = forecasts(spark).limit(1).withColumn("horizon", F.lit("7 day"))
    rows = build_submission(forecasts(spark).unionByName(extra), F.lit(WEDNESDAY))
    with pytest.raises(Exception, match="unknown target or horizon"):
        rows.select("target").collect()


def test_file_has_the_contract_columns(spark, sub, tmp_path):
    from panelcast.plans.submit import write_submission

    back = write_submission(sub, str(tmp_path / "file"))
    assert back.drop("row_id").columns == [c for c in sub.columns if c != "row_id"]
    header = next((tmp_path / "file").glob("part-*.csv")).read_text().splitlines()[0]
    assert header.split(",") == [c for c in sub.columns if c != "row_id"]
    assert outcome(back)["ok"]
    assert [tuple(r) for r in back.orderBy("row_id").collect()] == [
        tuple(r) for r in sub.orderBy("row_id").collect()
    ]


def test_valid_submission(sub):
    got = outcome(sub)
    assert got["ok"] and got["first_failure"] is None
    assert got["warnings"] == 5  # the empty target makes every quantile column warn


@pytest.mark.parametrize(
    "change, rule",
    [
        (lambda d: d.withColumn("extra", F.lit(1)), "column_count"),
        (lambda d: d.withColumnRenamed("horizon", "h"), "column_names"),
        (
            lambda d: d.select("row_id", "target", "forecast_date", *d.columns[3:4], *[q(s) for s in SUBMISSION_QCOLS]),
            "column_order",
        ),
        (lambda d: d.withColumn("forecast_date", F.lit("23.10.2024")), "date_format"),
        (
            lambda d: d.withColumn(
                "forecast_date", F.when(F.col("row_id") == 4, "2024-10-30").otherwise(WEDNESDAY)
            ),
            "single_date",
        ),
        (
            lambda d: d.withColumn(
                "target", F.when(F.col("row_id") == 0, "bicycles").otherwise(F.col("target"))
            ),
            "known_targets",
        ),
        (lambda d: d.filter("row_id <> 3"), "rows_per_target"),
        (
            lambda d: d.withColumn(
                "horizon", F.when(F.col("row_id") == 0, "9 day").otherwise(F.col("horizon"))
            ),
            "horizon_order",
        ),
        (
            lambda d: d.withColumn(
                "row_id", F.when(F.col("row_id") == 0, 1).when(F.col("row_id") == 1, 0).otherwise(F.col("row_id"))
            ),
            "horizon_order",
        ),
        (
            lambda d: d.withColumn("q0.5", F.when(F.col("target") == "bikes", q("q0.5"))),
            "one_null_target",
        ),
        (
            lambda d: d.withColumn("q0.25", F.when(F.col("row_id") == 7, 0.0).otherwise(q("q0.25"))),
            "quantile_order",
        ),
    ],
)
def test_violations(sub, change, rule):
    got = outcome(change(sub))
    assert not got["ok"] and got["first_failure"] == rule


def test_warnings_do_not_fail(sub):
    late = outcome(sub, today="2025-01-01")
    assert late["ok"] and late["warnings"] == 6
    odd = sub.withColumn("q0.975", F.when(F.col("target") == "energy", 500.0).otherwise(q("q0.975")))
    assert outcome(odd)["ok"] and outcome(odd)["warnings"] == 6
