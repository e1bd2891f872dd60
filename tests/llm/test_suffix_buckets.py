from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelcast.llm.suffix_buckets import Repeats, anchors, refined, remove_repeats


def brute(rows, length):
    """Per distinct (id, text): bytes left and removed runs."""
    seen = Counter()
    texts = {(i, t or "") for i, t in rows}
    for _, t in texts:
        raw = t.encode()
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]] += 1
    out = {}
    for i, t in texts:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, np.int8)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = 1
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        spans = int((np.diff(gone, prepend=0) == 1).sum())
        out[i, t] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def some_rows(seed=1):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(10, 90))) for _ in range(6)]
    rows = []
    for i in range(60):
        own = ["".join(rng.choice("defgh ") for _ in range(rng.randrange(0, 60))) for _ in range(4)]
        rows.append((i, "".join(a + rng.choice(shared) for a in own)))
    return rows + [(60, rows[3][1]), (61, "a" * 300), (62, None), (63, ""), (64, "ab" * 100)]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_equals_brute_force(spark, hot):
    rows, rule = some_rows(), Repeats(length=24, anchor=8, hot=hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 24)
    got = {r["doc_id"]: tuple(r)[1:5] for r in remove_repeats(docs, rule).collect()}
    assert got == {i: want[i, t or ""] for i, t in rows}


def test_equal_strings_have_equal_anchors():
    rule, rng = Repeats(length=40, anchor=8), random.Random(2)
    same = bytes(rng.choice(b"ab c") for _ in range(70))
    a, b = b"x" * 13 + same + b"yy", b"uvw" * 5 + same
    found = []
    for raw, off in ((a, 13), (b, 15)):
        h, at, lo, hi = anchors(raw, rule)
        found.append({s - off: (int(x), int(p) - off) for x, p, f, l in zip(h, at, lo, hi, strict=True) for s in range(f, l + 1)})
    for k in range(70 - 40 + 1):
        assert found[0][k] == found[1][k]


def test_refinement_is_exact():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 60))) for _ in range(40)]
    starts = np.array([len(t) - 19 for t in texts])
    count = Counter(t[k : k + 20] for t, s in zip(texts, starts, strict=True) for k in range(s))
    for t, flags in zip(texts, refined(texts, starts, 20), strict=True):
        assert flags.tolist() == [count[t[k : k + 20]] > 1 for k in range(len(t) - 19)]


def test_odd(odd, no_rows):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 20000]
    want = brute(short, 200)
    for r in remove_repeats(odd).collect():
        fits = [w for (i, t), w in want.items() if i == r["doc_id"] and w[0] == r["n_bytes"]]
        assert not fits or tuple(r)[1:5] in fits
    assert remove_repeats(no_rows).count() == 0
