"""Language identification by error-correcting output codes.

Every language has a codeword.  One binary n-gram classifier per bit tells the languages
that have the bit set from the others; a text gets the language whose codeword has the
least loss against the classifiers' margins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import narrow, per_document
from panelcast.session import stage

BUCKET_BITS = 15
UNKNOWN = "und"
# Characters of ASCII that are no letters all count as a blank.
TO_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
SHARPNESS = 6.0


@dataclass(frozen=True)
class Sample:
    """Bound of the labelled rows that the classifiers are fitted on.

    At most about ``rows`` per language, drawn by a hash of the id, and the ``languages``
    most frequent labels.
    """

    rows: int = 4000
    languages: int = 200


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a lower-cased text with a blank at either end."""
    raw = b" " + text.lower().encode("utf-8", "replace").translate(TO_BLANK) + b" "
    a = np.frombuffer(raw, np.uint8).astype(np.uint32)
    code = a[:-2] | (a[1:-1] << 8) | (a[2:] << 16)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """``k`` rows of -1 and 1: all ways to part few languages, else the widest of 50 draws."""
    if k <= 6:
        bits = np.arange(1, 2 ** max(k - 1, 0))
        # The first language has every bit set, which leaves out complements.
        rest = (bits[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.vstack([np.ones(len(bits), int), 1 - 2 * rest]).astype(np.float64)
    rng = np.random.default_rng(seed)
    length = int(np.ceil(10 * np.log2(k)))
    draws = [rng.choice((-1.0, 1.0), (k, length)) for _ in range(50)]
    return max(draws, key=lambda c: (length - (c @ c.T - np.eye(k) * 9e9)).min())


@dataclass
class CodeModel:
    """``code``: languages x bits; ``weights``: buckets x bits; ``trust``: languages x bits."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        """Mean log odds per trigram, of each bit; a long text goes in parts."""
        found = grams(text)
        total = np.zeros(self.weights.shape[1])
        for i in range(0, len(found), 100_000):
            total += self.weights[found[i : i + 100_000]].sum(axis=0, dtype=np.float64)
        return total / len(found)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Logistic loss against each codeword, weighted by how far a bit can be trusted."""
        return (self.trust * np.logaddexp(0, -SHARPNESS * self.code * margins)).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float, bool, int]:
        """Language, score, whether it is ambiguous, and bits that differ from its codeword.

        Ambiguous: the runner-up's score comes close, or more bits differ than the code
        can correct.
        """
        if not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0, True, 0
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False, 0
        m = self.margins(text)
        loss = self.losses(m)
        share = np.exp(loss.min() - loss)
        share /= share.sum()
        best = int(loss.argmin())
        apart = (len(m) - (self.code @ self.code.T)) / 2
        np.fill_diagonal(apart, np.inf)
        wrong = int((np.sign(m) != self.code[best]).sum())
        second = np.partition(share, -2)[-2]
        unsure = share[best] < 1.5 * second or wrong > (apart.min() - 1) // 2
        return self.languages[best], float(share[best]), bool(unsure), wrong


def held_out(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def draw(labelled: DataFrame, sample: Sample) -> tuple[DataFrame, list[str]]:
    """A bounded part of ``doc_id, text, lang``, and its languages in order."""
    counted = (
        labelled.groupBy("lang")
        .count()
        .orderBy(F.desc("count"), "lang")
        .limit(sample.languages)
        .collect()
    )
    langs = sorted(r["lang"] for r in counted)
    span = 1 << 20
    cuts = [(r["lang"], langs.index(r["lang"]), int(span * sample.rows / r["count"])) for r in counted]
    spark = labelled.sparkSession
    table = spark.createDataFrame(cuts, "lang string, label int, cut long")
    drawn = labelled.join(F.broadcast(table), "lang").filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(span)) < F.col("cut")
    )
    return stage(drawn.select("doc_id", "text", "label"), "language-sample"), langs


def fit(labelled: DataFrame, sample: Sample = Sample()) -> CodeModel:
    """Classifiers from trigram counts per language, and each bit's hits per language.

    What comes to the driver has a fixed bound: languages x buckets counts.
    """
    drawn, langs = draw(labelled, sample)
    k, buckets = len(langs), 1 << BUCKET_BITS
    code = codewords(k) if k > 1 else np.ones((k, 0))
    if k < 2:
        return CodeModel(langs, code, np.zeros((buckets, 0), np.float32), code)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((k, buckets), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid:
                    table[label.as_py()] += np.bincount(grams(text.as_py()), minlength=buckets)
        label, bucket = table.nonzero()
        yield pa.RecordBatch.from_arrays(
            [pa.array(label), pa.array(bucket), pa.array(table[label, bucket])], ["label", "bucket", "n"]
        )

    counted = (
        drawn.select("text", "label")
        .mapInArrow(count, "label long, bucket long, n long")
        .groupBy("label", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    table = np.full((k, buckets), 0.5)
    table[counted["label"], counted["bucket"]] += counted["n"]
    shares = table / table.sum(axis=1, keepdims=True)
    sides = [[shares[code[:, j] == s].mean(axis=0) for s in (1, -1)] for j in range(code.shape[1])]
    weights = np.array([np.log(yes) - np.log(no) for yes, no in sides], np.float32).T
    model = CodeModel(langs, code, np.ascontiguousarray(weights), np.ones_like(code))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros((k, code.shape[1] + 1), np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                if text.is_valid and has_letter(text.as_py()):
                    c = label.as_py()
                    hits[c, :-1] += np.sign(model.margins(text.as_py())) == code[c]
                    hits[c, -1] += 1
        rows = [(c, j, int(hits[c, j])) for c in range(k) for j in range(hits.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["c", "j", "n"])

    hits = np.zeros((k, code.shape[1] + 1))
    tested = drawn.select("text", "label").mapInArrow(test, "c long, j long, n long")
    for r in tested.groupBy("c", "j").agg(F.sum("n").alias("n")).collect():
        hits[r["c"], r["j"]] = r["n"]
    trust = (hits[:, :-1] + 1) / (hits[:, -1:] + 2)
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


def predict(
    docs: DataFrame, model: CodeModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, lang_pred, score, ambiguous, bits_off`` per row, from whole texts alone.

    A null text, one without a letter and any text under a model without languages give
    ``und`` with score 0.  Repeated rows get a row each; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.code, model.weights, model.trust)
    )

    def make():
        known = CodeModel(*shared.value)
        return lambda texts: [known.predict(t) for t in texts]

    return per_document(
        narrow(docs, id_col, text_col),
        make,
        "lang_pred string,score double,ambiguous boolean,bits_off int",
    )


def identify(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """Fit on the labelled rows that are not held out, then predict every row.

    Rows without a label or a text are never learned from.
    """
    learned = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    learned = learned.filter(F.col("text").isNotNull())
    model = fit(learned.select("doc_id", "text", "lang"), sample)
    return predict(docs, model).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "ambiguous",
        "bits_off",
    )
