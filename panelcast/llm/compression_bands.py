"""Quality rules: base counts of a text, and bands for its zstandard ratio.

Repetitive text compresses too well and noise too badly.  How well ordinary text
compresses depends on how much there is of it, so the limits go by length; they hold for
the whole document and for each fixed chunk of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import narrow, per_document, text_bytes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Bands:
    """Limits of compressed / raw bytes by length, and how a document is cut.

    ``limits``: (length in bytes below which it holds, lowest ratio, highest ratio); the
    last holds for all lengths.  The highest are between ordinary text (at most 0.745,
    0.592, 0.478 and 0.429 by class on the given tables) and base64 in lines (at least 0.797,
    0.76, 0.756 and 0.754); hex, at 0.50 to 0.55, is as dense as text.  Below 256 bytes the frame outweighs the content, so
    nothing is rejected there.  A document is rejected if its whole ratio is outside, or
    if chunks with more than ``bad_share`` of its bytes are.
    """

    limits: tuple[tuple[float, float, float], ...] = (
        (256, 0.0, float("inf")),
        (1024, 0.20, 0.78),
        (4096, 0.15, 0.70),
        (16384, 0.12, 0.70),
        (float("inf"), 0.10, 0.70),
    )
    chunk: int = 4096
    bad_share: float = 0.5
    level: int = 3

    def holds(self, size: int, ratio: float) -> bool:
        low, high = next((lo, hi) for below, lo, hi in self.limits if size < below)
        return low <= ratio <= high


# Bytes that continue a character: what is left after them are code points.
TAILS = bytes(range(0x80, 0xC0))


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 bytes."""
    words = raw.split()
    letters = b"".join(words)
    chars = len(letters.translate(None, TAILS))
    symbols = len(letters) - len(letters.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    once, more = set(), set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        (more if w in once else once).add(w)
    count, covered = 0, 0
    for i, w in enumerate(windows):
        if w in more:
            count += i + 3 - max(i, covered)
            covered = i + 3
    return count


def judge(raw: bytes, squeeze, bands: Bands) -> tuple[float | None, int, int, str]:
    """Whole ratio, chunks, chunks outside their band, and the verdict's reason."""
    if not raw:
        return None, 0, 0, "empty"
    whole = len(squeeze(raw)) / len(raw)
    cuts = range(0, len(raw), bands.chunk)
    bad = bad_bytes = 0
    if len(cuts) == 1:
        bad_bytes = 0 if bands.holds(len(raw), whole) else len(raw)
        bad = int(bad_bytes > 0)
    else:
        for at in cuts:
            part = raw[at : at + bands.chunk]
            if not bands.holds(len(part), len(squeeze(part)) / len(part)):
                bad, bad_bytes = bad + 1, bad_bytes + len(part)
    if not bands.holds(len(raw), whole):
        reason = "whole ratio"
    elif bad_bytes > bands.bad_share * len(raw):
        reason = "chunk ratios"
    else:
        reason = ""
    return whole, len(cuts), bad, reason


def quality(
    docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Counts and verdict per row; whole texts, in the partition that holds them.

    Words are runs of other than ASCII blanks, lines are cut at newlines.  ``base_failed``:
    fewer than 50 words, or over half of them in repeated three-word windows.  ``kept``:
    base rules and bands hold.  A null text counts as empty and fails with 0 words;
    ``ratio`` is null there.  Repeated rows get a row each; an empty table gives none;
    other columns are not read.
    """

    def make():
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=bands.level).compress

        def work(texts):
            out = []
            for text in texts:
                raw = text_bytes(text)
                counts = base_counts(raw)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                ratio, chunks, bad, reason = judge(raw, squeeze, bands)
                reason = "base" if failed else reason
                out.append((*counts, failed, not reason, ratio, chunks, bad, reason))
            return out

        return work

    return per_document(
        narrow(docs, id_col, text_col),
        make,
        "n_words long,word_chars long,n_symbols long,n_dup_lines long,n_repeat_words long,"
        "base_failed boolean,kept boolean,ratio double,n_chunks long,n_bad_chunks long,"
        "reason string",
    )


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``docs`` with all its columns, without rows that the rules reject.

    The verdict is a function of the row's text alone, so it needs no join.
    """

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=bands.level).compress

        def one(text):
            raw = text_bytes(text)
            n_words, _, _, _, again = base_counts(raw)
            if n_words < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n_words:
                return False
            return not judge(raw, squeeze, bands)[3]

        return pd.Series([one(t) for t in texts], dtype=bool)

    return docs.filter(good(F.col("text")))
