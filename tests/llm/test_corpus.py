"""Registered queries against SQL, and the pipeline against a plain version of it."""

from __future__ import annotations

import random

import oracle
import pytest
from test_near_dedup import brute
from test_quality import plain

import corpus_pipeline
from panelcast.llm import ORACLES, QUERIES
from panelcast.llm.compression_bands import Bands, judge
from panelcast.llm.personal_data import masked, rule_spans
from panelcast.session import stage as staged

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    ok, text = oracle.compare(spark, con, name, SF_DIR, QUERIES, ORACLES)
    assert ok, text


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        # Each stage's result is written and read again, as run() does.
        at = staged(stage(spark, at, SF_DIR), name)
        seen[name] = at
        if name != "packing":
            assert at.columns == docs.columns

    def good(text):
        n, _, _, _, again = plain(text)
        return n >= 50 and 100 * again <= 50 * n and not judge(text.encode(), squeeze, Bands())[3]

    def texts(name):
        return {r["doc_id"]: r["text"] for r in seen[name].collect()}

    rows = {i: t for i, t in rows.items() if good(t)}
    assert texts("quality") == rows
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for i, t in rows.items() if last[t] == i}
    assert texts("exact_dedup") == rows
    rows = {i: rows[i] for i, _, least in brute(sorted(rows.items()), 5) if i == least}
    assert texts("near_dedup") == rows
    for i, t in texts("personal_data").items():
        # The tagger may add spans; what the rules find is always gone.
        assert i in rows and (t == masked(rows[i], rule_spans(rows[i])[0]) or "<" in t)
    assert len(texts("personal_data")) == len(rows)
    packed = seen["packing"]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(rows)


def test_pipeline_with_odd_rows(spark, odd, no_rows):
    """Null, empty, very long and repeated texts, null ids, columns with clashing names; and
    an empty table: each stage keeps the columns, no stage makes rows up."""
    long = " ".join(f"word{i} number{i % 97}" for i in range(3000))
    fields = {f.name: None for f in odd.schema}
    rng = random.Random(6)

    def prose():
        return " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(80))

    more = [{**fields, "doc_id": i, "text": t, "row": "r"} for i, t in (
        (900, long), (901, long), (902, long + " end"), (None, long), (903, f"mail anna@mail.org {long[::-1]}"),
        (904, prose()), (904, prose()),
    )]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema))
    kept = {}
    for at, left in ((docs, kept), (no_rows, {})):
        for name, stage in corpus_pipeline.STAGES:
            before, at = at, staged(stage(spark, at, SF_DIR), name)
            if name != "packing":
                assert at.columns == docs.columns
                ids = {r["doc_id"] for r in at.select("doc_id").collect()}
                assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()}
                left[name] = sorted((r["doc_id"], r["text"]) for r in at.filter("doc_id >= 900").collect())
        if at.count() == 0:
            assert left["quality"] == []
    assert [i for i, _ in kept["exact_dedup"]] == [901, 902, 903, 904, 904]
    assert [i for i, _ in kept["near_dedup"]] == [901, 903, 904, 904]
    texts = dict(kept["personal_data"])
    assert "anna@mail.org" not in texts[903] and texts[901] == long
