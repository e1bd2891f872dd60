from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np

from panelcast.llm import jump_shards
from panelcast.llm.jump_shards import assign_shards, jump


def plain_jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_equals_one_at_a_time():
    keys = np.array([0, 1, 2, 5, 10**9, 2**63 - 1, -1, -77], np.int64)
    for shards in (1, 2, 7, 24, 1000):
        assert jump(keys.view(np.uint64), shards).tolist() == [plain_jump(int(k), shards) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.arange(20000, dtype=np.uint64)
    for n in (1, 5, 24):
        a, b = jump(keys, n), jump(keys, n + 1)
        assert set(b[a != b]) <= {n}
        assert abs((a != b).mean() - 1 / (n + 1)) < 0.02


def test_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(jump_shards, "BLOCK_ROWS", 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    slots = defaultdict(list)
    for r in assign_shards(docs, 24).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert r["shard"] == plain_jump(r["doc_id"], 24) and r["law"] == "key"
        assert r["grown_shard"] == plain_jump(r["doc_id"], 25)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd(odd, no_rows):
    out = assign_shards(odd, 3).collect()
    assert len(out) == odd.count()
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r["size"], r["text_crc32"]) for r in out if r["doc_id"] == 1} == {(8, 0)}
    assert assign_shards(no_rows, 3).count() == 0
