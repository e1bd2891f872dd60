"""Personal data: rules with checks, and a tagger that learns from labelled spans.

The rules' spans always stay.  Loose forms that a check or their shape speaks for (an "at"
in brackets, dots between the groups of a card) are added by pattern, what else is written
otherwise than the rules say by the tagger.  The tagger runs over overlapping windows; where two
windows overlap, each character takes the tag of the window in which it stands farther
from the edge, and the tags are then read off over the whole document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.char_tagger import KINDS, Tagger, classes
from panelcast.llm.common import narrow, per_document, pieces
from panelcast.session import stage

Span = tuple[int, int, int]  # kind, start, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits does: from inside a run nothing else can match.
ADDRESS = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# An "at" that is spelled out, in brackets.
AT = re.compile(r"[(\[{]\x20?at\x20?[)\]}]", re.IGNORECASE)
LOOSE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
MARK = re.compile(f"@|{AT.pattern}", re.IGNORECASE)
LOOSE = (
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20\.\x20[0-9]{1,3}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9.])[0-9]{4}\.(?:[0-9]{4}\.[0-9]{4}\.[0-9]{1,7}|[0-9]{6}\.[0-9]{4,5})(?![0-9])")),
    # With 00 or "tel", or ten digits as three, three and four.
    (3, re.compile(
        r"(?<![A-Za-z0-9+.-])(?:(?:00[1-9]|00\x20[1-9]|tel[.:]?\x20?[0-9(])[\x20().0-9-]+[0-9]"
        r"|(?:[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4})(?![A-Za-z0-9])",
        re.IGNORECASE,
    )),
)
CUE = re.compile(f"[0-9@]|{AT.pattern}", re.IGNORECASE)
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        n = int(ch) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def rule_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the four kinds in order, and matches that a check has rejected.

    Rejected are card numbers of 13 to 19 digits that fail their check sum and addresses
    with a part over 255.  A match that is too short or too long is none of its kind, so
    nothing is known of what it holds.
    """
    good: list[Span] = []
    bad: list[Span] = []
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            good.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", m.end() if m else at + 1)
    if not DIGIT.search(text):
        return good, bad
    for m in ADDRESS.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        fine = all(len(p) <= 3 and int(p) <= 255 for p in parts)
        (good if fine else bad).append((1, m.start(), m.end()))
    for kind, pattern, low, high, check in ((2, CARD, 13, 19, luhn), (3, PHONE, 9, 15, bool)):
        for m in pattern.finditer(text):
            digits = "".join(filter("0123456789".__contains__, m[0]))
            if low <= len(digits) <= high:
                (good if check(digits) else bad).append((kind, m.start(), m.end()))
    return good, bad


def refuted(kind: int, span: str) -> bool:
    """Whether the rules' checks speak against a span that is written loosely."""
    numbers = re.findall("[0-9]+", span)
    n_digits = len("".join(numbers))
    if kind == 1:
        return len(numbers) != 4 or any(int(n) > 255 for n in numbers)
    if kind == 2:
        return not 13 <= n_digits <= 19 or not luhn("".join(numbers))
    return kind == 3 and not 9 <= n_digits - 2 * (numbers[0].startswith("00")) <= 15


def loose_spans(text: str) -> list[Span]:
    """Spans that are not written as the rules say, but in a form that is hardly anything else."""
    out: list[Span] = []
    done = 0
    for mark in MARK.finditer(text):
        start, end = mark.span()
        end += text[end : end + 1] == " "
        start -= start > done and text[start - 1] == " "
        last = start
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = LOOSE_DOMAIN.match(text, end) if start < last else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
    if DIGIT.search(text):
        for kind, pattern in LOOSE:
            found = [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
            out += [s for s in found if not refuted(kind, text[s[1] : s[2]])]
    return out


def overlaps(span: Span, others: list[Span]) -> bool:
    return any(span[1] < b and a < span[2] for _, a, b in others)


def listed(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)])


@dataclass(frozen=True)
class TaggerSettings:
    """Windows of ``width`` characters every ``stride``; bounds of what is learned from.

    At most ``labelled`` windows with spans and as many without go to the driver, drawn by
    a hash of their text.  A span is added if its characters score at least ``margin``
    over being outside, on average.
    """

    width: int = 64
    stride: int = 32
    labelled: int = 1200
    hidden: int = 16
    steps: int = 200
    batch: int = 64
    rate: float = 0.02
    margin: float = 3.0
    seed: int = 17


def window_starts(text: str, codes: np.ndarray, settings: TaggerSettings) -> np.ndarray:
    """Starts of the windows that hold a digit, an ``@`` or a spelled-out "at".

    Every kind has one of them in each of its spans, so no other window can hold a span's
    core; what of a span reaches out is in the overlap.
    """
    cues = np.flatnonzero(((codes >= 48) & (codes <= 57)) | (codes == 64))
    spelled = np.array([m.start() for m in AT.finditer(text)], np.int64)
    last = np.concatenate([cues, spelled]) // settings.stride
    back = settings.width // settings.stride - 1
    found = np.unique(np.concatenate([np.maximum(last - k, 0) for k in range(back + 1)]))
    return found * settings.stride


def coded(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)


def added_spans(tags: np.ndarray, over: np.ndarray, margin: float) -> list[Span]:
    """Spans read off the tags of a whole document, where they score well."""
    out, start, kind = [], -1, -1
    for i, tag in enumerate([*tags.tolist(), 0]):
        here = (tag - 1) // 2 if tag else -1
        if start >= 0 and (here != kind or tag % 2 == 1):
            if over[start:i].mean() >= margin:
                out.append((kind, start, i))
            start = -1
        if start < 0 and here >= 0:
            start, kind = i, here
    return out


class Finder:
    """Rules and tagger for batches of whole texts."""

    BATCH = 512

    def __init__(self, settings: TaggerSettings, params: dict | None):
        self.settings = settings
        self.tagger = Tagger(settings.hidden, params=params) if params else None

    def spans(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """Per text the rules' spans and those that are added."""
        found = [rule_spans(t or "") for t in texts]
        added = self._tagged(texts) if self.tagger else {}
        out = []
        for i, (good, bad) in enumerate(found):
            text = texts[i] or ""
            more: list[Span] = []
            for span in loose_spans(text):
                if not overlaps(span, good) and not overlaps(span, more):
                    more.append(span)
            for kind, a, b in added.get(i, ()):
                while a < b and text[a].isspace():
                    a += 1
                while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
                    b -= 1
                fine = b - a >= 6 and CUE.search(text, a, b) and not refuted(kind, text[a:b])
                # What a rule rejected as a card may still be a phone.
                held = good + more + [s for s in bad if s[0] == kind]
                if fine and not overlaps((kind, a, b), held):
                    more.append((kind, a, b))
            out.append((good, more))
        return out

    def _tagged(self, texts: list[str | None]) -> dict[int, list[Span]]:
        width, queue, out = self.settings.width, [], {}
        for i, text in enumerate(texts):
            if text and CUE.search(text):
                codes = coded(text)
                for start in window_starts(text, codes, self.settings).tolist():
                    queue.append((i, start, classes(codes[start : start + width])))
        at = 0
        doc: list = []
        while at < len(queue):
            part = queue[at : at + self.BATCH]
            at += self.BATCH
            x = np.zeros((len(part), width), np.int64)
            for row, (_, _, ids) in zip(x, part, strict=True):
                row[: len(ids)] = ids
            tags, over = self.tagger.decode(x)
            for (i, start, ids), t, o in zip(part, tags, over, strict=True):
                if doc and doc[0][0] != i:
                    out[doc[0][0]] = self._reconciled(doc)
                    doc = []
                doc.append((i, start, t[: len(ids)], o[: len(ids)]))
        if doc:
            out[doc[0][0]] = self._reconciled(doc)
        return out

    def _reconciled(self, windows: list) -> list[Span]:
        """One tag per character: that of the window where it stands farthest inside."""
        spans: list[Span] = []
        i = 0
        while i < len(windows):
            j = i  # a stretch of windows that overlap
            while j + 1 < len(windows) and windows[j + 1][1] < windows[j][1] + self.settings.width:
                j += 1
            first, end = windows[i][1], windows[j][1] + len(windows[j][2])
            tags, over = np.zeros(end - first, np.int64), np.zeros(end - first)
            depth = np.full(end - first, -1)
            for _, start, t, o in windows[i : j + 1]:
                inside = np.minimum(np.arange(len(t)), self.settings.width - 1 - np.arange(len(t)))
                at = slice(start - first, start - first + len(t))
                deeper = inside > depth[at]
                tags[at][deeper], over[at][deeper], depth[at][deeper] = t[deeper], o[deeper], inside[deeper]
            found = added_spans(tags, over, self.settings.margin)
            spans += [(k, first + a, first + b) for k, a, b in found]
            i = j + 1
        return spans


def labelled_windows(docs: DataFrame, settings: TaggerSettings) -> list[tuple[str, str]]:
    """A bounded set of windows with a tag digit per character, drawn by hash of the window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            rows = []
            for text in texts:
                if not text or not CUE.search(text):
                    continue
                codes = coded(text)
                tags = np.zeros(len(codes), np.int64)
                for kind, a, b in reversed(rule_spans(text)[0]):
                    tags[a:b] = 2 * kind + 2
                    tags[a] = 2 * kind + 1
                for s in window_starts(text, codes, settings)[:: settings.width // settings.stride].tolist():
                    part = tags[s : s + settings.width]
                    rows.append((text[s : s + settings.width], "".join(map(str, part)), bool(part.any())))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            kinds = (pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "tags", "hit"]
            )

    rows = docs.mapInArrow(cut, "part string, tags string, hit boolean")
    order = [F.xxhash64("part"), F.col("part"), F.col("tags")]
    out = []
    rows = stage(rows, "labelled-windows")
    for hit in (True, False):
        some = rows.filter(F.col("hit") == hit).orderBy(*order).limit(settings.labelled)
        out += [(r["part"], r["tags"]) for r in some.collect()]
    return out


WAYS = 3


def _word(rng: np.random.Generator, low: int, high: int) -> str:
    return "".join(map(chr, rng.integers(97, 123, rng.integers(low, high))))


def _address(rng: np.random.Generator) -> str:
    """A made-up e-mail address: with or without digits, of two to four labels."""
    tail = ("", str(rng.integers(0, 100)), "." + _word(rng, 2, 8))[rng.integers(0, 3)]
    labels = [_word(rng, 2, 9) for _ in range(rng.integers(1, 4))]
    return _word(rng, 2, 9) + tail + "@" + ".".join([*labels, _word(rng, 2, 4)])


def _loose(kind: int, span: str, way: int, rng: np.random.Generator) -> str:
    """One span as people also write it."""
    other = rng.random() < 0.5
    if kind == 0 and "@" in span:
        return (_address(rng) if other else span).replace("@", (" @ ", " (at) ", "[at]")[way])
    if kind == 1:
        return span.replace(".", " . ")
    if kind == 2:
        digits = [ch for ch in span if ch.isdigit()]
        return ".".join("".join(digits[i : i + 4]) for i in range(0, len(digits), 4))
    if kind == 3 and span.startswith("+"):
        rest = span[1:]
        if other:  # groups parted by one sign, with or without those before the first
            groups = re.findall("[0-9]+", rest)
            first = int(rng.integers(0, 2)) if len(groups) > 3 and way != 1 else 0
            rest = " -."[rng.integers(0, 3)].join(groups[first:])
        return ("", "00", "tel ")[way] + rest
    return span


def loosened(part: str, tags: str, way: int, rng: np.random.Generator) -> tuple[str, str]:
    """The window as people also write it, so that spans the rules miss are learned.

    Blanks around ``@`` or dots, "at" in brackets, a phone without its plus, with 00 or
    "tel", cards with dots.  Half of the addresses are made up and half of the phones
    grouped anew, so that not one source's names are learned but the form.
    """
    out, marks, at = [], [], 0
    while at < len(part):
        end = at + 1
        if tags[at] == "0":
            out.append(part[at])
            marks.append("0")
        else:
            kind = (int(tags[at]) - 1) // 2
            while end < len(part) and tags[end] == str(2 * kind + 2):
                end += 1
            text = _loose(kind, part[at:end], way, rng)
            out.append(text)
            marks.append(tags[at] + str(2 * kind + 2) * (len(text) - 1))
        at = end
    return "".join(out), "".join(marks)


def train(docs: DataFrame, settings: TaggerSettings = TaggerSettings()) -> dict | None:
    """Parameters fitted on labelled windows of ``docs``; none where nothing is labelled."""
    windows = labelled_windows(narrow(docs), settings)
    hits = [w for w in windows if w[1].strip("0")]
    if not hits:
        return None
    rng = np.random.default_rng(settings.seed)
    windows += [loosened(*w, int(rng.integers(0, WAYS)), rng) for w in hits]
    x = np.zeros((len(windows), settings.width), np.int64)
    y = np.zeros_like(x)
    for i, (part, tags) in enumerate(windows):
        ids = classes(coded(part))[: settings.width]
        x[i, : len(ids)] = ids
        y[i, : len(ids)] = [int(t) for t in tags[: len(ids)]]
    for kind in range(len(KINDS)):  # a span that lost its first mark begins all the same
        on, begin = 2 * kind + 2, 2 * kind + 1
        follows = np.zeros_like(y, bool)
        follows[:, 1:] = (y[:, :-1] == on) | (y[:, :-1] == begin)
        follows[:, 0] = True
        y[(y == on) & ~follows] = begin
    tagger = Tagger(settings.hidden, settings.seed)
    tagger.fit(x, y, settings.steps, settings.batch, settings.rate, settings.seed)
    return tagger.p


def find_personal_data(
    docs: DataFrame,
    settings: TaggerSettings = TaggerSettings(),
    params: dict | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Spans in every whole text: the rules', loose forms, and those that the tagger adds.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (the rules' counts),
    ``base_sha256``, ``spans`` (all, ``kind:start:end`` in code points), ``n_added``.
    Without ``params`` the tagger is fitted on ``docs`` first.  An added span holds a
    digit, ``@`` or a spelled-out "at", passes the checks of its kind and overlaps neither
    a span of the rules nor a match that they rejected as one of its kind.  A null text counts as empty; repeated rows get a row each; an empty table gives none.
    """
    rows = narrow(docs, id_col, text_col)
    shared = _shared(rows, settings, params)

    def make() -> Callable:
        finder = Finder(settings, shared.value)

        def work(texts):
            out = []
            for good, more in finder.spans(texts):
                counts = [sum(s[0] == k for s in good) for k in range(len(KINDS))]
                base = hashlib.sha256(listed(good).encode()).hexdigest()
                out.append((*counts, base, listed(good + more), len(more)))
            return out

        return work

    return per_document(
        rows,
        make,
        "n_email long,n_ip long,n_card long,n_phone long,base_sha256 string,spans string,"
        "n_added long",
    )


def _shared(rows: DataFrame, settings: TaggerSettings, params: dict | None):
    params = params or train(rows, settings)
    return rows.sparkSession.sparkContext.broadcast(params)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or run of overlapping ones, as the mark of its first kind."""
    out, at, i = [], 0, 0
    spans = sorted(spans, key=lambda s: (s[1], -s[2]))
    while i < len(spans):
        kind, a, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][1] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def mask_personal_data(
    docs: DataFrame, settings: TaggerSettings = TaggerSettings(), params: dict | None = None
) -> DataFrame:
    """``docs`` with all its columns; personal data in ``text`` masked, ``n_chars`` renewed.

    A null text stays null, and a text without personal data stays as it is.
    """
    shared = _shared(narrow(docs), settings, params)

    @F.pandas_udf("string")
    def mask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(settings, shared.value)
        for texts in parts:
            found = finder.spans(list(texts))
            yield pd.Series(
                [
                    masked(t, good + more) if good or more else t
                    for t, (good, more) in zip(texts, found, strict=True)
                ],
                dtype=object,
            )

    out = docs.withColumn("text", mask(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return out
