from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelcast.llm import bag_search
from panelcast.llm.bag_search import Ranking, search, split_terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_force(docs, items, top=10, b=75, k=8):
    """Every distinct item against every document, one pair at a time."""
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    bags = [(d, c, sum(c.values())) for d, c in bags if c]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, c, _ in bags for t in c)
    out = []
    distinct = {(i, tuple(sorted(Counter(terms_of(t)).items()))) for i, t in items}
    for item, bag in distinct:
        rows = []
        for d, c, n in bags:
            m = 100 - b + (b * n * n_docs) // n_terms
            score = 0
            for t, repeats in bag:
                if tf := c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += repeats * w * ((10**9 * tf) // (1000 * tf + k * m))
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        rows.sort()
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(rows[:top])]
    return sorted(out, key=repr)


def found(docs, items, **how):
    return sorted((tuple(r) for r in search(docs, items, **how).collect()), key=repr)


def pairs(frame, a, b="text"):
    return [tuple(r) for r in frame.select(a, b).collect()]


def made_up(spark, seed=0, docs=400, items=12):
    """Texts of few words, so that bags and scores repeat; large groups of copies."""
    rng = random.Random(seed)
    words = ["The", "the", "cat", "sat", "été", "中文", "x1", "dog's", "on", "mat", "a-b"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(docs // 4)]
    rows = [(rng.randint(-50, 9000), rng.choice(texts)) for _ in range(docs)]
    rows += [(20000 - i, "the cat sat on the mat") for i in range(docs // 3)]
    wanted = [(i, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(items)]
    wanted += [(3, wanted[3][1]), (3, "cat cat cat"), (77, "nowhere"), (78, None), (79, "")]
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(wanted, "item_id long, text string"),
    )


def test_terms():
    text = "The cat's\tÉTÉ, naïve\x00x_1-İ 中文。A😂b\x7f~Z"
    assert [t.decode() for t in split_terms(text.encode())] == terms_of(text)
    assert split_terms(None) == split_terms(b" .,") == []


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_brute_force(spark, seed):
    docs, items = made_up(spark, seed)
    assert found(docs, items) == brute_force(pairs(docs, "doc_id"), pairs(items, "item_id"))


def test_other_settings(spark):
    docs, items = made_up(spark, 2)
    want = brute_force(pairs(docs, "doc_id"), pairs(items, "item_id"), 3, 40, 20)
    assert found(docs, items, ranking=Ranking(3, 40, 20)) == want


def test_blocks_pieces_and_long_sums(spark, monkeypatch):
    """Many blocks of items, few cells at a time, sums beyond exact doubles."""
    docs, items = made_up(spark, 3)
    want = brute_force(pairs(docs, "doc_id"), pairs(items, "item_id"))
    monkeypatch.setattr(bag_search, "BLOCK_PAIRS", 7)
    monkeypatch.setattr(bag_search, "CELLS", 40)
    monkeypatch.setattr(bag_search, "EXACT", 1)
    assert found(docs, items) == want


def test_hash_collisions(spark, monkeypatch):
    docs, items = made_up(spark, 4, 60, 4)
    want = brute_force(pairs(docs, "doc_id"), pairs(items, "item_id"))
    sound, seeds = bag_search.bag_hash, []

    def weak(seed):
        seeds.append(seed)
        return sound(seed) if seed == 2 else F.pmod(sound(seed), F.lit(5))

    monkeypatch.setattr(bag_search, "bag_hash", weak)
    assert found(docs, items) == want
    assert max(seeds) == 2


def test_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert found(docs, items) == brute_force(pairs(docs, "doc_id"), pairs(items, "item_id"))


def test_classes_are_scored_once(spark):
    """Copies, and texts that differ only in words no item has, are one class."""
    rows = [(i, f"cat other{i % 3} words{i}") for i in range(30)] + [(99, "cat sat no more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = bag_search.Vocabulary.of(
        bag_search.item_bags(spark.createDataFrame([(1, "cat sat")], "i long, t string"), "i", "t").collect()
    )
    vectors = bag_search.bags(docs, words, "doc_id", "text").withColumn("m", F.lit(100))
    classes, _ = bag_search.classes_of(vectors)
    assert sorted(r["first_id"] for r in classes.collect()) == [0, 99]


def test_odd(spark, odd, no_rows):
    items = spark.createDataFrame(
        [(1, "one haus été", "t"), (None, "the of end", "t"), (2, None, "t"), (3, "w5 w17 w59999", "t")],
        "item_id long, text string, terms string",
    )
    assert found(odd, items) == brute_force(pairs(odd, "doc_id"), pairs(items, "item_id"))
    assert found(no_rows, items) == found(odd, items.limit(0)) == found(no_rows, items.limit(0)) == []
