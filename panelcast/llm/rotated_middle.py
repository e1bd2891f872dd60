"""Fill-in-middle by rotating blocks of a text in place.

A text is laid out once in a ``bytearray`` with its sentinels, in reading order; the blocks
then change places by three reversals, which need no second copy of the text.  Undoing the
rotations and taking the sentinels out gives the text back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from panelcast.llm.common import bounded, narrow, pieces

SWAP = 1 << 16  # bytes exchanged at a time by a reversal
SCAN = 1 << 20  # bytes looked at together when code points are counted
TAILS = bytes(range(0x80, 0xC0))  # bytes that continue a code point


@dataclass(frozen=True)
class Middle:
    """``plain_percent`` of the texts stay as they are; ``suffix_first_percent`` of the others
    begin with the suffix (``spm``), the rest with the prefix (``psm``)."""

    seed: int = 1
    plain_percent: int = 10
    suffix_first_percent: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = self.marks
        if not all(marks) or any(a in b for a in marks for b in marks if a is not b):
            raise ValueError("sentinels must be non-empty and not contain one another")
        # else a mark could end inside the next one, and the first find be the wrong place
        if any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, len(a))):
            raise ValueError("no sentinel may begin as another one ends")

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()

    def draws(self, doc_id: int | None) -> list[int]:
        """Four unsigned numbers of a document; a null id counts as an empty one."""
        own = "" if doc_id is None else doc_id
        digest = hashlib.sha256(f"{self.seed}:{own}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def reverse(buf: bytearray, a: int, b: int) -> None:
    """Reverse ``buf[a:b]`` where it lies, exchanging the two ends a bounded piece at a time."""
    while b - a > 1:
        size = min(SWAP, (b - a) // 2)
        left = buf[a : a + size]
        buf[a : a + size] = buf[b - size : b][::-1]
        buf[b - size : b] = left[::-1]
        a, b = a + size, b - size


def rotate(buf: bytearray, a: int, cut: int, b: int) -> None:
    """Exchange the blocks ``[a, cut)`` and ``[cut, b)`` by three reversals."""
    reverse(buf, a, cut)
    reverse(buf, cut, b)
    reverse(buf, a, b)


def scan_cuts(raw: bytes, cuts: tuple[int, int]) -> list[int]:
    """Byte positions after as many code points as each of ``cuts`` (ascending) says.

    A stretch of as many bytes as code points are still wanted never goes too far, so the
    scan closes in on its place in ever shorter stretches.
    """
    places, seen, at = [], 0, 0
    for cut in cuts:
        while seen < cut:
            part = raw[at : at + min(SCAN, cut - seen)]
            seen += len(part.translate(None, TAILS))
            at += len(part)
        while at < len(raw) and raw[at] & 0xC0 == 0x80:  # rest of the last code point
            at += 1
        places.append(at)
    return places


def transform(raw: bytes, n: int, draws: list[int], how: Middle) -> tuple[str, int, int, bytes]:
    """``form, prefix_chars, middle_chars, output``; the counts are -1 for a plain text."""
    p, s, m = how.marks
    marked = any(mark in raw for mark in how.marks)
    if not raw or marked or draws[2] % 100 >= 100 - how.plain_percent:
        return "plain", -1, -1, raw
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    first, last = scan_cuts(raw, (low, high))
    # in reading order: prefix, middle, suffix, each behind its sentinel
    buf = bytearray(raw)
    buf[last:last] = s
    buf[first:first] = m
    buf[:0] = p
    middle_at = len(p) + first
    suffix_at = middle_at + len(m) + last - first
    rotate(buf, middle_at, suffix_at, len(buf))
    form = "psm"
    if draws[3] % 100 < how.suffix_first_percent:
        form = "spm"
        rotate(buf, 0, middle_at, middle_at + len(buf) - suffix_at)
    return form, low, high - low, bytes(buf)


def restore(output: bytes, form: str, how: Middle) -> bytes:
    """The text that :func:`transform` was given."""
    if form == "plain":
        return output
    p, s, m = how.marks
    buf = bytearray(output)
    if form == "spm":
        prefix_at = buf.index(p, len(s))
        middle_at = buf.index(m, prefix_at + len(p))
        rotate(buf, 0, prefix_at, middle_at)
    elif form != "psm":
        raise ValueError(f"unknown form: {form}")
    suffix_at = buf.index(s, len(p))
    middle_at = buf.index(m, suffix_at + len(s))
    rotate(buf, suffix_at, middle_at, len(buf))
    # prefix, middle and suffix again: take the sentinels out from the back
    middle_at, suffix_at = suffix_at, suffix_at + len(buf) - middle_at
    for at, mark in ((suffix_at, s), (middle_at, m), (0, p)):
        if buf[at : at + len(mark)] != mark:
            raise ValueError("the output does not have its sentinels")
        del buf[at : at + len(mark)]
    return bytes(buf)


def fill_in_middle(
    docs: DataFrame, how: Middle = Middle(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row of ``docs``.

    A document's cuts and form depend on its id, its length in code points and ``how`` alone,
    so rows that repeat an id are cut alike.  Null and empty texts, and texts that hold a
    sentinel, are plain; plain rows have null counts.  A null id draws as an empty one.  One
    pass without a shuffle, in batches of bounded size; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            rows = []
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                n = len(text or "")
                made = transform((text or "").encode(), n, how.draws(doc_id), how)
                rows.append((n, *made))
            n, form, first, middle, output = zip(*rows, strict=True)
            counts = [pa.array([c if c >= 0 else None for c in x], pa.int64()) for x in (first, middle)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(form), *counts, _text(output)],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    schema = (
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )
    return narrow(docs, id_col, text_col).mapInArrow(run, schema)


def restored(made: DataFrame, how: Middle = Middle()) -> DataFrame:
    """``made`` (with ``output`` and ``form``) with the text rebuilt from them as ``restored``.

    A row without output has none to restore.
    """
    schema = StructType([*made.schema, StructField("restored", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, batch.schema.get_field_index("output")):
                pairs = zip(part["output"].to_pylist(), part["form"].to_pylist(), strict=True)
                back = [None if o is None else restore(o.encode(), f, how) for o, f in pairs]
                yield pa.RecordBatch.from_arrays([*part.columns, _text(back)], schema.names)

    return made.mapInArrow(run, schema)


def _text(values: Iterable[bytes | None]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())
