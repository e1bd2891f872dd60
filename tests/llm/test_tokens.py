from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest

from panelcast.llm.queries import vocabulary
from panelcast.llm.residual_packing import UnitCoder, best_fit, cut_pieces, pack_documents
from panelcast.llm.trie_bpe import WordCoder, encode_documents, encode_words

SF_DIR = "/root/testdata/sf0.001"

ODD = [
    "", None, " lead", "trail ", "\n", "a\n\nb", "a\n\n\nb\n\n", "a \nb", "a\n b", "x\t\ty", "  ",
    "it's  we'LL \x1c z\x85q", "中文 한국 😂😂 a\xa0b", "a<|endoftext|>b <|startoftext|> <| c", "a" * 3000,
    "ΑΣ ΣΑΣ İstanbul ẞ é 12²½", "!!!...---===~~~~", "a  b   c \n \n d", "é ́x ﬁ",
    "https://x.org/?q=1&b=2", "\x00\x01 \x7f", "naïve　café x",
]


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()] + ODD


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary(name))


def test_words_equal_library(texts):
    tool, coder = library("word_bpe_49k.json"), WordCoder(vocabulary("word_bpe_49k.json"))
    for text, (ids, decoded) in zip(texts, coder.encode(texts), strict=True):
        want = tool.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == tool.decode(want, skip_special_tokens=False)


def test_units_equal_library(texts):
    tool, coder = library("byte_bpe_50k.json"), UnitCoder(vocabulary("byte_bpe_50k.json"))
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tool.encode(text or "", add_special_tokens=False).ids, text


def test_encoded_rows(odd, no_rows):
    voc = vocabulary("word_bpe_49k.json")
    tool = library("word_bpe_49k.json")
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"]}
    out = encode_documents(odd, voc).collect()
    assert len(out) == odd.count()
    for r in out:
        if r["doc_id"]:
            ids = tool.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            decoded = tool.decode(ids, skip_special_tokens=False)
            assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode_documents(no_rows, voc).count() == 0


def test_best_fit_chooses_the_least_room():
    place, at, used = best_fit(np.array([7, 5, 3, 3]), 10)
    assert place.tolist() == [0, 1, 0, 1] and at.tolist() == [0, 0, 7, 5] and used.tolist() == [10, 8]
    assert cut_pieces(3000, 1024) == [(0, 952), (952, 1024), (1976, 1024)]
    assert cut_pieces(1024, 1024) == [(0, 1024)]


def check_packing(out, texts, length=1024):
    tool = library("byte_bpe_50k.json")
    held = {}
    rows = out.toPandas()
    for r in rows.itertuples():
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    for doc_id, text in texts.items():
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, 2]
        mine = rows[rows.doc_id == doc_id].sort_values("piece")
        assert mine.length.sum() == len(ids)
        for r in mine.itertuples():
            raw = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
            assert r.length == length or r.piece == 0
    return len(held), -(-int(rows.length.sum()) // length)


@pytest.mark.parametrize("group", [50_000, 40])
def test_packed_documents(spark, sf_dir, group):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(6)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sequences, least = check_packing(pack_documents(docs, vocabulary("byte_bpe_50k.json"), group=group), texts)
    assert least <= sequences <= 1.05 * least + 2


def test_packs_odd_rows(odd, no_rows):
    texts = {r["doc_id"]: r["text"] for r in odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()}
    voc = vocabulary("byte_bpe_50k.json")
    check_packing(pack_documents(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), voc), texts)
    assert pack_documents(odd, voc).filter("piece = 0").count() == odd.count()
    assert pack_documents(no_rows, voc).count() == 0


SPACED = [
    " a\tb", "a  b\tc", "\n\na", " \na  \n b", "  ", " ", "\n", "a\n\nb \n", "\ta \tb", "one. two, 1x. .y! z",
    "w w\nw  w\tw", ".", " .", "A.", "a\x1cb", " a\x1cb", "É. é, ªº; ǅ: Ⱥ!", "it's. o'er, '", "ab1. 12, ½!", "x·y. x\u0307.",
]


def test_spaces_and_stops_equal_library():
    """Each alone, and all with units known from the others."""
    for name, make in (("byte_bpe_50k.json", UnitCoder), ("word_bpe_49k.json", WordCoder)):
        tool, kept = library(name), make(vocabulary(name))
        for text in SPACED + ODD + SPACED[::-1]:
            want = np.array(tool.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
            for coder in (kept, make(vocabulary(name))) if text in SPACED[:4] else (kept,):
                got = coder.encode([text])[0]
                assert (got if name[:1] == "b" else got[0]) == want, text


class Refuses:
    """In place of a pattern that plain texts need not be cut with."""

    def findall(self, text):
        raise AssertionError(f"cut by pattern: {text!r}")

    __call__ = findall


def test_plain_words_need_no_pattern():
    coder = WordCoder(vocabulary("word_bpe_49k.json"))
    coder.cut = Refuses()
    plain = "Plain words, naïve Ärger; and stops... here!"
    want = library("word_bpe_49k.json").encode(plain, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode([plain])[0][0], "<u4").tolist() == want


def test_units_known_by_words_alone():
    """A text of single blanks is cut by ``split``: no string is made anew for each word."""
    coder = UnitCoder(vocabulary("byte_bpe_50k.json"))
    text = "first word\nline two, last"
    assert coder._cut(text) == [" first", "word", "\nline", "two,", "last"]
    assert [coder._unit(k) for k in coder._cut(text)] == ["first", " word", "\nline", " two,", " last"]
    for unit in ("w", " w", "\nw", "  w", " \nw", "\tw", " \tw", " ", "\n", "\n\nw", "\u3000w"):
        assert coder._unit(coder._key(unit)) == unit


class Counted(dict):
    """Counts the look-ups that Python makes."""

    looks = 0

    def get(self, key, default=None):
        self.looks += 1
        return super().get(key, default)

    def __getitem__(self, key):
        self.looks += 1
        return super().__getitem__(key)


def test_known_ends_are_not_looked_up_again():
    """Each letter more is one step: the vocabulary is asked once for each end of a prefix."""
    merges = WordCoder(vocabulary("word_bpe_49k.json")).merges
    words = sorted(["qzxvoon", "qzxvoom", "unbelievablyzq", "unbelievably", "a", "z"])
    first = encode_words(words, merges)
    merges.whole = Counted(merges.whole)
    assert encode_words(words, merges) == first and merges.whole.looks == 0
    assert encode_words(words[::-1], merges) == first


@pytest.mark.parametrize("name, make", [("byte_bpe_50k.json", UnitCoder), ("word_bpe_49k.json", WordCoder)])
def test_repeated_units_are_looked_up_once_a_batch(name, make):
    coder = make(vocabulary(name))
    coder.memo = Counted()
    texts = ["Some words. Some more\nwords, " * 400, "", None, "é words"]
    got = coder.encode(texts)
    assert coder.memo.looks < 100
    want = np.array(library(name).encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()
    assert (got[0] if name[:1] == "b" else got[0][0]) == want
    nothing = b"" if name[:1] == "b" else (b"", "")
    assert got[1:3] == coder.encode([None, ""]) == [nothing, nothing] and coder.encode([]) == []
