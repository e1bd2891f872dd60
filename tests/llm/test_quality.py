from __future__ import annotations

import re
from collections import Counter

import pytest

from panelcast.llm.compression_bands import Bands, base_counts, judge, keep_good, quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(inside),
    )


@pytest.mark.parametrize(
    "text",
    ["", " ", "a b c a b c a b c", "a\n\n a\na\n a\x1c\n\x0b\n", "é#* $%&|<> é\x85ü\xa0z", "a a a a a a"],
)
def test_counts(text):
    assert base_counts(text.encode()) == plain(text)


def test_counts_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality(docs).collect():
        assert tuple(r)[1:6] == plain(texts[r["doc_id"]])
        n_words, again = r["n_words"], r["n_repeat_words"]
        assert r["base_failed"] == (n_words < 50 or 100 * again > 50 * n_words)
        assert not (r["base_failed"] and r["kept"])


def test_bands_reject_repetition_and_noise():
    import os

    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    bands = Bands()
    assert judge(b"again and " * 300, squeeze, bands)[3] == "whole ratio"
    assert judge(os.urandom(9000), squeeze, bands)[3] == "whole ratio"
    rows = b" ".join(str(i * i).encode() for i in range(3000))
    assert judge(rows, squeeze, bands)[3] == ""
    # Half prose, half one letter: the chunks tell.
    assert judge(rows[:8192] + b"a" * 12288, squeeze, Bands(limits=((float("inf"), 0.1, 0.9),)))[2] >= 3


def test_odd(odd, no_rows):
    out = quality(odd).collect()
    assert len(out) == odd.count()
    assert all(r["ratio"] is None and r["n_words"] == 0 for r in out if r["reason"] == "base" and not r["n_words"] and r["n_chunks"] == 0)
    assert quality(no_rows).count() == 0
    kept = keep_good(odd)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r["kept"] for r in out)


@pytest.mark.parametrize("size", [300, 600, 1000, 1023, 1024, 3000, 4095, 4096, 9000, 16383, 16384, 60000])
def test_bands_reject_wrapped_base64(size):
    import base64
    import random

    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3).compress
    raw = base64.encodebytes(random.Random(size).randbytes(size))[:size]
    assert judge(raw, squeeze, Bands())[3] == "whole ratio"


def test_wrapped_base64_is_not_kept(spark):
    import base64
    import random

    text = base64.encodebytes(random.Random(8).randbytes(4500)).decode()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r["base_failed"], r["kept"]) for r in quality(docs).collect()] == [(False, False)]
    assert keep_good(docs).count() == 0


def test_ordinary_text_stays(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    high = [r for r in quality(docs).collect() if not r["base_failed"] and not r["kept"] and r["ratio"] > 0.5]
    assert high == []
