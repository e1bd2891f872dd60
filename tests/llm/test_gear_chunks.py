from __future__ import annotations

import random
from collections import Counter, defaultdict

from panelcast.llm.gear_chunks import Cuts, borders, repeated_chunks, without


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_chunks_cover_the_text_within_limits():
    rng, cuts = random.Random(1), Cuts()
    for raw in (b"", b"a", b"a" * 5000, prose(rng, 3000).encode()):
        ends = borders(raw, cuts)
        sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        assert sum(sizes) == len(raw)
        assert all(cuts.shortest <= s <= cuts.longest for s in sizes[:-1])


def test_insertion_moves_few_borders():
    text = prose(random.Random(2), 4000).encode()
    moved = text[:5000] + b"INSERTED" + text[5000:]
    parts = [
        Counter(raw[a:b] for a, b in zip([0, *borders(raw)], borders(raw), strict=False)) for raw in (text, moved)
    ]
    assert sum((parts[0] & parts[1]).values()) > 0.98 * sum(parts[0].values())


def test_equals_brute_force(spark, odd, no_rows):
    rng = random.Random(3)
    shared = [prose(rng, 60) for _ in range(3)]
    rows = [(i, prose(rng, 30) + rng.choice(shared) + prose(rng, 20)) for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, None), (41, "")], "doc_id long, text string")
    where = defaultdict(list)
    for i, t in rows:
        raw = t.encode()
        for a, b in zip([0, *borders(raw)], borders(raw), strict=False):
            where[raw[a:b]].append((i, a))
    again, lost = Counter(), Counter()
    for chunk, at in where.items():
        for place in at if len(at) > 1 else ():
            again[place[0]] += 1
            lost[place[0]] += len(chunk) if place != min(at) else 0
    out = {r["doc_id"]: r for r in repeated_chunks(docs).collect()}
    assert len(out) == 42 and out[40]["n_bytes"] == out[40]["n_chunks"] == 0
    for i, t in rows:
        raw = t.encode()
        assert (out[i]["n_repeated"], out[i]["n_removed"]) == (again[i], lost[i])
        assert len(without(raw, out[i]["removed"])) == len(raw) - lost[i]
    assert all(again[i] for i, _ in rows)
    assert repeated_chunks(odd).count() == odd.select("doc_id").distinct().count()
    assert repeated_chunks(no_rows).count() == 0


def test_short_tail_joins_the_chunk_before():
    rng, cuts = random.Random(6), Cuts()
    for _ in range(300):
        ends = borders(prose(rng, 40).encode(), cuts)
        sizes = [b - a for a, b in zip([0, *ends], ends, strict=False)]
        assert len(sizes) == 1 or sizes[-1] >= cuts.shortest


def test_common_endings_and_phrases_are_no_repeats(spark):
    rng = random.Random(7)
    passage, phrase = prose(rng, 60), "x" * 30  # a phrase is cut alike wherever it stands
    clean = [prose(rng, 60) + ending for ending in [" and so on.", "."] * 40]
    clean += [prose(rng, 40) + phrase + prose(rng, 40) for _ in range(40)]
    planted = [prose(rng, 40) + passage + prose(rng, 40) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(clean + planted)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in repeated_chunks(docs).collect()}
    for i in range(len(clean)):
        assert (out[i]["n_repeated"], out[i]["n_removed"], out[i]["removed"]) == (0, 0, "")
    for i in range(len(clean) + 1, len(clean) + len(planted)):
        assert out[i]["n_removed"] >= Cuts().least
    assert any(r["n_repeated"] for r in repeated_chunks(docs, Cuts(least=1)).collect()[: len(clean)])
