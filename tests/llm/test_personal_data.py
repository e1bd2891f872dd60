from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from panelcast.llm.char_tagger import KINDS, TAGS, Tagger
from panelcast.llm.personal_data import (
    TaggerSettings,
    coded,
    find_personal_data,
    listed,
    luhn,
    mask_personal_data,
    masked,
    rule_spans,
    train,
    window_starts,
)

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = (
                True,
                kind != 1 or all(int(x) <= 255 for x in m[0].split(".")),
                13 <= len(digits) <= 19 and luhn(digits),
                9 <= len(digits) <= 15,
            )[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_rules_equal_plain_patterns():
    rng = random.Random(5)
    for _ in range(20000):
        text = "".join(rng.choice("a.@1-+ ()02%é") for _ in range(rng.randrange(40)))
        assert sorted(rule_spans(text)[0]) == plain(text), text


def test_gradient():
    tagger, rng = Tagger(3), np.random.default_rng(0)
    x, y = rng.integers(0, 98, (3, 6)), rng.integers(0, TAGS, (3, 6))
    _, grads = tagger.loss(x, y)
    for name, g in grads.items():
        at = (x[1, 2] if name[0] == "E" else 1, 2)[-g.ndim :]
        value = tagger.p[name][at]
        tagger.p[name][at] = value + 1e-5
        up = tagger.loss(x, y)[0]
        tagger.p[name][at] = value - 1e-5
        down = tagger.loss(x, y)[0]
        tagger.p[name][at] = value
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_masks():
    text = "mail a.b@c.org, card 4111 1111 1111 1111."
    assert masked(text, rule_spans(text)[0]) == "mail <EMAIL>, card <CARD>."


@pytest.fixture(scope="module")
def fitted(spark, sf_dir):
    settings = TaggerSettings(steps=120, labelled=300)
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    return docs, settings, train(docs, settings)


def test_learns_the_labelled_spans(fitted):
    from panelcast.llm.personal_data import Finder

    docs, settings, params = fitted
    finder = Finder(settings, params)
    texts = [r["text"] for r in docs.collect()]
    tagged = finder._tagged(texts)
    wanted = [(i, s) for i, t in enumerate(texts) for s in rule_spans(t)[0]]
    hit = sum(any(k == s[0] and a < s[2] and s[1] < b for k, a, b in tagged.get(i, ())) for i, s in wanted)
    assert hit > 0.6 * len(wanted) > 0
    assert sum(len(more) for _, more in finder.spans(texts)) < 0.05 * len(wanted)


def test_query_rows(fitted):
    docs, settings, params = fitted
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in find_personal_data(docs, settings, params).collect():
        want = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(listed(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in want) for k in range(4)]
        assert r["n_added"] or r["spans"] == listed(want)


def test_odd(fitted, odd, no_rows):
    _, settings, params = fitted
    assert find_personal_data(odd, settings, params).count() == odd.count()
    assert find_personal_data(no_rows, settings).count() == 0
    out = mask_personal_data(odd, settings, params)
    assert out.columns == odd.columns
    before = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"]}
    for r in out.collect():
        if r["doc_id"] and "0" not in (before[r["doc_id"]] or ""):
            assert r["text"] == before[r["doc_id"]]
            assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


BODY = "the road was long and they went on {} before the rain came over the hill"
LOOSENED = [
    "anna24 @ mail.org", "anna (at) mail.org", "anna[at]mail.org", "hein.19 (at) mail5.example.com",
    "10 . 0 . 0 . 1", "4111.1111.1111.1111", "1 (743) 555-3824", "(743) 555-3824", "555 123 4567",
    "001 (743) 555-3824", "0049 151 123456", "tel 1 (743) 555-3824",
]
OTHER = ["10 . 0 . 0 . 999", "4111.1111.1111.1112", "in 1999 there were 44 of 1200", "top (at least) 5 of", "anna (at) home"]


def test_a_match_of_another_kind_or_length_blocks_nothing():
    assert rule_spans("44 or 4111 or 555 123 4567")[1] == []
    assert [s[0] for s in rule_spans("4111 1111 1111 1112 and 10.0.0.999")[1]] == [1, 2]


def test_windows_with_a_spelled_out_at_are_run():
    settings = TaggerSettings()
    text = "x" * 200 + " anna (at) mail.org"
    assert window_starts(text, coded(text), settings).tolist() == [160, 192]


@pytest.mark.parametrize("body", [BODY, "{}", "write to {}, thanks"])
def test_loosened_forms_are_found_and_masked(spark, fitted, body):
    import corpus_pipeline

    _, settings, params = fitted
    texts = [body.format(w) for w in LOOSENED + OTHER]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = body.index("{")
    found = {r["doc_id"]: r for r in find_personal_data(docs, settings, params).collect()}
    for i, form in enumerate(LOOSENED):
        spans = [tuple(map(int, s.split(":")[1:])) for s in found[i]["spans"].split(",") if s]
        assert spans == [(start, start + len(form))], (form, spans)
    out = {r["doc_id"]: r["text"] for r in mask_personal_data(docs, settings, params).collect()}
    staged = dict(corpus_pipeline.STAGES)["personal_data"](spark, docs, "")
    for masks in (out, {r["doc_id"]: r["text"] for r in staged.collect()}):
        for i, form in enumerate(LOOSENED + OTHER):
            head, tail = body.split("{}")
            if i < len(LOOSENED):
                assert masks[i].startswith(f"{head}<") and masks[i].endswith(f">{tail}"), masks[i]
            else:
                assert masks[i] == texts[i]
