from __future__ import annotations

import random
import re

import pytest

from panelcast.llm import bbit_minhash
from panelcast.llm.bbit_minhash import NearSettings, Shingler, keep_one, near_duplicates, packed
from panelcast.llm.components import components


def shingles(text, n=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(rows, n=4):
    sets = [shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        k = root(i)
        if doc_id is not None:
            least[k] = min(least.get(k, doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(root(i), doc_id)) for i, (doc_id, _) in enumerate(rows)]


def near_copies(count=60, seed=3):
    rng = random.Random(seed)
    rows = []
    for family in range(4):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(150)]
        for _ in range(count // 4):
            words = list(base)
            for _ in range(rng.randrange(0, 9)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(99)}"
            rows.append((len(rows) + 10, " ".join(words)))
    rng.shuffle(rows)
    return rows


def answer(df):
    return sorted((tuple(r)[:3] for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(near_duplicates(docs)) == sorted(brute(rows), key=str)


def test_blocks_find_links_between_components(spark, monkeypatch):
    """With tiny blocks, as a large bucket has, and a chain that the first round misses."""
    monkeypatch.setattr(bbit_minhash, "BLOCK", 3)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[: 100 - 0] [i * 4 :] + [f"z{k}" for k in range(i * 4)])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert answer(near_duplicates(docs)) == sorted(brute(rows), key=str)


def test_odd(odd, no_rows):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert answer(near_duplicates(odd)) == sorted(brute(rows), key=str)
    assert near_duplicates(no_rows).count() == 0
    assert keep_one(odd).columns == odd.columns


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    label = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r["node"], r["label"]) for r in got.collect()} == set(label.items())


@pytest.mark.parametrize("shared", [300, 700, 950])
def test_low_bits_estimate(shared):
    import numpy as np

    s = NearSettings(minima=1024)
    shingler = Shingler(s)
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 2000 - shared, dtype=np.uint64)
    a, b = pool[:1000], pool[1000 - shared :]
    x, y = (packed(shingler.minima(v), s.bits).view(np.uint64).reshape(s.bits, -1) for v in (a, b))
    same = s.minima - int(np.bitwise_count(np.bitwise_or.reduce(x ^ y)).sum())
    assert abs(s.estimate(np.array(same)) - shared / (2000 - shared)) < 0.07
