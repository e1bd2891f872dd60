from __future__ import annotations

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from panelcast.llm import rotated_middle
from panelcast.llm.rotated_middle import (
    Middle,
    fill_in_middle,
    restore,
    restored,
    reverse,
    rotate,
    scan_cuts,
    transform,
)


def plainly(doc_id, text):
    """The contract, word for word, on strings."""
    text = text or ""
    own = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(("1:" + own).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.binary(max_size=300), st.data())
def test_rotation(raw, data):
    a = data.draw(st.integers(0, len(raw)))
    b = data.draw(st.integers(a, len(raw)))
    cut = data.draw(st.integers(a, b))
    buf = bytearray(raw)
    reverse(buf, a, b)
    assert bytes(buf) == raw[:a] + raw[a:b][::-1] + raw[b:]
    buf = bytearray(raw)
    rotate(buf, a, cut, b)
    assert bytes(buf) == raw[:a] + raw[cut:b] + raw[a:cut] + raw[b:]


def test_rotation_in_small_pieces(monkeypatch):
    monkeypatch.setattr(rotated_middle, "SWAP", 3)
    buf = bytearray(range(50))
    rotate(buf, 5, 12, 43)
    assert list(buf) == [*range(5), *range(12, 43), *range(5, 12), *range(43, 50)]


@given(st.text(max_size=80), st.data())
def test_cuts(text, data):
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    want = [len(text[:a].encode("utf-8", "surrogatepass")), len(text[:b].encode("utf-8", "surrogatepass"))]
    assert scan_cuts(text.encode("utf-8", "surrogatepass"), (a, b)) == want


# pieces of marks, so that text and marks run into one another
PARTS = st.lists(st.sampled_from(["<", "P", "S", "M", ">", "<P", "S>", "é", "中", "😂", " a"]), max_size=30)


@given(PARTS, st.integers(-5, 10**12))
def test_equals_the_plain_way_and_comes_back(parts, doc_id):
    text = "".join(parts)
    how = Middle()
    form, a, middle, output = transform(text.encode(), len(text), how.draws(doc_id), how)
    counts = (None, None) if form == "plain" else (a, middle)
    assert (len(text), form, *counts, output.decode()) == plainly(doc_id, text)
    assert restore(output, form, how) == text.encode()


def test_sentinels_must_be_told_apart():
    for marks in (("", "b", "c"), ("<", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("xy", "yz", "q")):
        with pytest.raises(ValueError):
            Middle(prefix=marks[0], suffix=marks[1], middle=marks[2])
    how = Middle()
    with pytest.raises(ValueError):
        restore(b"<P>a<S>b", "psm", how)
    with pytest.raises(ValueError):
        restore(b"<P>a<S>b<M>c", "other", how)


def test_other_settings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    how = Middle(seed=7, plain_percent=0, suffix_first_percent=100, prefix="[pre]", suffix="[suf]", middle="[mid]")
    rows = restored(fill_in_middle(docs, how), how).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert {r["form"] for r in rows if texts[r["doc_id"]]} == {"spm"}
    assert all(r["restored"] == texts[r["doc_id"]] for r in rows)


def _checked(docs):
    want = sorted(((r["doc_id"], *plainly(r["doc_id"], r["text"]), r["text"] or "") for r in docs.collect()), key=repr)
    got = sorted((tuple(r) for r in restored(fill_in_middle(docs)).collect()), key=repr)
    assert got == want


def test_rows(spark, sf_dir):
    _checked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_odd(odd, no_rows, monkeypatch):
    _checked(odd)
    assert restored(fill_in_middle(no_rows)).count() == 0
