from __future__ import annotations

import numpy as np
import pytest

from panelcast.llm.codeword_language import Sample, codewords, fit, held_out, identify, predict


@pytest.mark.parametrize("k", [2, 3, 4, 6, 9])
def test_codewords_differ(k):
    code = codewords(k)
    apart = (code.shape[1] - code @ code.T) / 2
    assert (apart + np.eye(k) * 9 >= (1 if k == 2 else 2)).all()
    assert (np.abs(code.sum(axis=0)) < k).all()


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = identify(docs, Sample(rows=100)).collect()
    assert len(out) == len(truth)
    tested = [r for r in out if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in tested) >= 0.97 * len(tested) > 100
    assert all(0 <= r["score"] <= 1 for r in out)


def test_label_is_no_input(spark, sf_dir):
    """Labels of held-out rows change nothing."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("qq")).otherwise(F.col("lang")))
    a, b = (identify(d).orderBy("doc_id").collect() for d in (docs, other))
    assert a == b


def test_odd(spark, odd, no_rows):
    out = identify(odd).collect()
    assert len(out) == odd.count()
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1]["lang_pred"] == by_id[7]["lang_pred"] == "und"  # null and empty
    assert by_id[46]["lang_pred"] == "und"  # digits alone
    assert identify(no_rows).count() == 0
    model = fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in predict(odd, model).collect()} == {"und"}
