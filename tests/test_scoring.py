from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.config import LEVELS, QCOLS
from panelcast.operators import scoring
from panelcast.operators.eda import autocorrelation, five_numbers, partial_autocorrelation
from panelcast.operators.panel import regularize
from panelcast.operators.quantiles import grouped_quantiles, sorted_quantile


def predictions(spark, rows=40, seed=0):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(rows):
        q = np.sort(rng.normal(size=5))
        data.append(("s", i % 4, float(rng.normal()), *map(float, q)))
    cols = ", ".join(f"{c} double" for c in QCOLS)
    return spark.createDataFrame(data, f"series_id string, fold int, y double, {cols}")


def test_interval_score_values(spark):
    df = spark.createDataFrame([(1.0, 3.0, y) for y in (0.0, 2.0, 4.0)], "a double, b double, y double")
    score = scoring.interval_score(F.col("y"), F.col("a"), F.col("b"), 0.1)
    assert [r[0] for r in df.select(score).collect()] == pytest.approx([22, 2, 22])


def test_interval_score_is_twice_the_one_from_pinball(spark):
    rows = predictions(spark)
    direct = rows.groupBy("series_id", "fold").agg(
        F.avg(scoring.interval_score(F.col("y"), F.col("q25"), F.col("q75"), 0.5)).alias("d50"),
        F.avg(scoring.interval_score(F.col("y"), F.col("q025"), F.col("q975"), 0.05)).alias("d95"),
    )
    both = scoring.fold_scores(rows).join(direct, ["series_id", "fold"]).collect()
    for r in both:
        assert r.d50 == pytest.approx(2 * r.interval_score_50)
        assert r.d95 == pytest.approx(2 * r.interval_score_95)
        assert 0 <= r.coverage_50 <= r.coverage_95 <= 1


def test_spread_of_losses_and_coverage(spark):
    folds = scoring.fold_scores(predictions(spark))
    pdf = folds.toPandas()
    table = {r.metric: r for r in scoring.metrics_table(folds, []).collect()}
    assert table["pinball_loss"]["std"] == pytest.approx(pdf.pinball_loss.std(ddof=1))
    assert table["coverage_50"]["std"] == pytest.approx(pdf.coverage_50.std(ddof=0))
    curve = {r.level: r for r in scoring.calibration(folds, [], "samples").collect()}
    want = np.sqrt(pdf.hit_q50.var(ddof=0) * len(pdf) / pdf.n.sum())
    assert curve[0.5]["std"] == pytest.approx(want)
    with pytest.raises(ValueError):
        scoring.calibration(folds, [], "rows")


def test_rearrange_and_reshape(spark):
    rows = predictions(spark).withColumn("id", F.monotonically_increasing_id())
    crossed = rows.withColumn("q025", F.col("q975") + 1)
    for r in scoring.rearrange(crossed).collect():
        values = [r[c] for c in QCOLS]
        assert values == sorted(values)
    ids = ["id", "y"]
    back = scoring.predictions_wide(scoring.predictions_long(rows, ids), ids)
    assert sorted(back.select("id", *QCOLS).collect()) == sorted(rows.select("id", *QCOLS).collect())
    with pytest.raises(ValueError):
        scoring.intervals(rows, ids, (0.1, 0.5, 0.9))


def test_exact_quantiles_with_a_hot_group_and_ties(spark):
    rng = np.random.default_rng(5)
    hot = np.round(rng.exponential(size=6000), 2)
    cold = rng.normal(size=7)
    data = [("hot", float(v)) for v in hot] + [("cold", float(v)) for v in cold]
    data += [("one", 4.0), ("hot", None)]
    df = spark.createDataFrame(data, "k string, v double")
    out = grouped_quantiles(df, ["k"], "v", list(LEVELS), list(QCOLS), partitions=16)
    got = {r.k: [r[c] for c in QCOLS] for r in out.collect()}
    assert got["hot"] == pytest.approx(list(np.quantile(hot, LEVELS)))
    assert got["cold"] == pytest.approx(list(np.quantile(cold, LEVELS)))
    assert got["one"] == [4.0] * 5
    whole = grouped_quantiles(df, [], "v", [0.5], ["m"]).first()["m"]
    assert whole == pytest.approx(np.median(np.concatenate([hot, cold, [4.0]])))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=30), st.sampled_from(LEVELS))
def test_sorted_quantile(spark, values, level):
    df = spark.createDataFrame([(sorted(values),)], "v array<double>")
    got = df.select(sorted_quantile(F.col("v"), level)).first()[0]
    assert got == pytest.approx(np.quantile(values, level), rel=1e-9, abs=1e-6)


def test_box_and_correlations(spark):
    values = [float(v) for v in range(1, 12)] + [100.0]
    df = spark.createDataFrame([("a", v) for v in values], "k string, y double")
    box = five_numbers(df, ["k"]).first()
    assert (box.whisker_low, box.whisker_high, box.outliers) == (1, 11, 1)

    rng = np.random.default_rng(2)
    y = np.zeros(500)
    for t in range(1, 500):
        y[t] = 0.7 * y[t - 1] + rng.normal()
    rows = [("s", datetime.fromordinal(738000 + i), float(v)) for i, v in enumerate(y)]
    from panelcast.functions.calendar import DAILY

    grid = regularize(
        spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double"), DAILY, ["y"]
    )
    acf = autocorrelation(grid, 5)
    got = [r.acf for r in acf.orderBy("lag").collect()]
    d = y - y.mean()
    assert got == pytest.approx([(d[k:] * d[: len(d) - k]).sum() / (d @ d) for k in range(6)])
    pacf = [r.pacf for r in partial_autocorrelation(acf).orderBy("lag").collect()]
    toeplitz = np.array([[got[abs(i - j)] for j in range(2)] for i in range(2)])
    assert pacf[1] == pytest.approx(got[1])
    assert pacf[2] == pytest.approx(np.linalg.solve(toeplitz, got[1:3])[1])
