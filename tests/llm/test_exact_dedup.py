from __future__ import annotations

import hashlib

from panelcast.llm.digest_index import DigestIndex, digests, drop_copies, exact_dedup, groups, new_index


def test_odd(spark, odd, no_rows):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    out = exact_dedup(odd, new_index(spark, 4)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = next(t for _, t in rows if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        same = [i for i, t in rows if t == text]
        best = max((i for i in same if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(same))
        assert r["kept"] == (r["doc_id"] == best)
    assert exact_dedup(no_rows, new_index(spark, 4)).count() == 0


def test_index_outlives_its_maker(spark):
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    index = new_index(spark, 4)
    exact_dedup(first, index)
    index.close()
    index = DigestIndex.open(spark, index.path, 4)
    more = spark.createDataFrame([(7, "a"), (8, "c"), (9, "c")], "doc_id long, text string")
    fresh = index.fresh(groups(digests(more)))
    assert [r["keep_id"] for r in fresh.collect()] == [9]
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    out = {r["doc_id"]: r for r in exact_dedup(more, index).collect()}
    assert out[7]["keep_id"] == 3 and not out[7]["kept"]
    assert out[9]["kept"] and not out[8]["kept"]
    assert index.table.count() == 3


def test_hot_group(spark):
    rows = [(i, "hot" if i % 2 else f"t{i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = exact_dedup(docs, new_index(spark, 4))
    assert out.filter("kept").count() == 2001
    assert out.filter("group_size = 2000 AND keep_id = 3999").count() == 2000


def test_stage_keeps_columns(spark, odd):
    kept = drop_copies(odd, new_index(spark, 4))
    assert kept.columns == odd.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert set(texts) == {r["text"] or "" for r in odd.collect()}
