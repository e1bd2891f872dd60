"""Removal of repeated byte strings by suffix buckets that later buckets refine.

A byte goes if a string of ``length`` bytes over it also starts elsewhere.  All starts of
a corpus are too many to shuffle, so they come in groups that can hold equal strings: the
least q-gram of a string, its anchor, is the same wherever the string stands.  Starts
whose anchor occurs once are done.  For the others the bytes around the anchor go to the
anchor's task, which sorts the starts into buckets by their first bytes and refines the
buckets by the identifiers of the buckets that stand 8, 16, 32 ... bytes later.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import narrow, pieces, text_bytes
from panelcast.session import stage

NO_ID = -(1 << 63)
# Bytes of context that a task sorts at a time.
BATCH_BYTES = 2_000_000
ROW_BYTES = 8_000_000
SECTION = 2_000_000


@dataclass(frozen=True)
class Repeats:
    """Bytes of a string and of an anchor; contexts above which an anchor is hot."""

    length: int = 200
    anchor: int = 64
    hot: int = 100_000


FACTOR = 0x9E3779B97F4A7C15  # an odd number: multiplying by it loses nothing
LETTERS = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def rolled(raw: bytes, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (a power of two) from each place on, by doubling."""
    h = LETTERS[np.frombuffer(raw, np.uint8)]
    step, factor = 1, FACTOR
    while step < width:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % (1 << 64)
        step *= 2
    return h


def anchors(raw: bytes, rule: Repeats) -> tuple[np.ndarray, ...]:
    """Anchor hash and place, and the first and last string start that it anchors."""
    n = len(raw) - rule.length + 1
    if n < 1:
        none = np.empty(0, np.int64)
        return none, none, none, none
    h = rolled(raw, rule.anchor)
    spread = (h ^ (h >> np.uint64(32))) * np.uint64(FACTOR)
    # High bits of the hash over the place: the least is the leftmost of equal hashes.
    least = (spread & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, have = rule.length - rule.anchor + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], n) - 1
    at = place[first]
    return h[at].view(np.int64), at, first, last


def refined(contexts: list[bytes], starts: np.ndarray, length: int) -> list[np.ndarray]:
    """Per context, which of its first ``starts`` strings of ``length`` bytes stand elsewhere.

    Bucket identifiers start as the first 8 bytes and are refined by the pair (own bucket,
    bucket ``depth`` bytes later), each pass using what the one before has found.  A start
    alone in its bucket is settled; pairs with a settled one are settled without sorting.
    """
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    room = np.repeat(begins + sizes, sizes) - np.arange(len(raw))  # bytes to the context's end
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    key = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(raw)]
    key = np.ascontiguousarray(key).view(np.uint64)[:, 0]
    open_at = np.flatnonzero(room >= 8)
    bucket = np.full(len(raw), -1, np.int64)  # -1: settled
    _bucket(bucket, open_at, key[open_at])
    depth = 8
    while depth < length:
        step = min(depth, length - depth)
        depth += step
        live = np.flatnonzero((bucket >= 0) & (room >= depth))
        live = live[bucket[live + step] >= 0]
        pair = (bucket[live].astype(np.uint64) << np.uint64(32)) | bucket[live + step].astype(np.uint64)
        bucket = np.full(len(raw), -1, np.int64)
        _bucket(bucket, live, pair)
    return [bucket[b : b + s] >= 0 for b, s in zip(begins.tolist(), starts.tolist(), strict=True)]


def _bucket(bucket: np.ndarray, places: np.ndarray, key: np.ndarray) -> None:
    """Number the buckets of equal keys; those with one member stay settled."""
    if not len(places):
        return
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.empty(len(ranked), bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    alone = new.copy()
    alone[:-1] &= new[1:]
    number = np.cumsum(new) - 1
    bucket[places[order[~alone]]] = number[~alone]


def runs(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes covered by the flagged starts, as (start, end)."""
    at = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [(int(a), int(b) - 1 + length) for a, b in at.reshape(-1, 2)]


def anchored(raw: bytes, rule: Repeats) -> Iterator[tuple[int, int, int]]:
    """(anchor, first start, last start) all over a text, a section at a time.

    A section's end may cut the starts of an anchor in two, which changes no anchor.
    """
    for s in range(0, len(raw) - rule.length + 1, SECTION):
        h, _, lo, hi = anchors(raw[s : s + SECTION + rule.length - 1], rule)
        yield from zip(h.tolist(), (lo + s).tolist(), (hi + s).tolist(), strict=True)


def context_rows(raw: bytes, rule: Repeats, wanted: dict[int, bool]) -> Iterator[tuple]:
    """(anchor, places, starts, bytes that these cover) of the wanted anchors.

    A text that repeats itself has the same context many times; it is one row here, but
    for texts whose contexts exceed ``ROW_BYTES``.
    """
    out: dict[tuple[int, int, bytes], list[int]] = {}
    size = 0
    for h, lo, hi in anchored(raw, rule):
        if h in wanted:
            key = (h, hi - lo + 1, raw[lo : hi + rule.length])
            places = out.setdefault(key, [])
            size += 0 if places else len(key[2])
            places.append(lo)
            if size > ROW_BYTES:
                yield from ((h, los, n, context) for (h, n, context), los in out.items())
                out, size = {}, 0
    yield from ((h, los, n, context) for (h, n, context), los in out.items())


SPANS = "id_key long, tag long, start int, end int"


def group_spans(contexts: DataFrame, rule: Repeats) -> DataFrame:
    """Repeated spans from rows ``h, id_key, tag, los, starts, context`` ordered by ``h``.

    Groups are taken whole; equal contexts of a group are sorted once.
    """

    def solve(groups: list[dict]) -> Iterator[tuple]:
        flat = [(g, c) for g, held in enumerate(groups) for c in held]
        found = refined(
            [c for _, (_, c) in flat], np.array([s for _, (s, _) in flat], np.int64), rule.length
        )
        for (g, held), flags in zip(flat, found, strict=True):
            owners = groups[g][held]
            if len(owners) > 1 or any(len(los) > 1 for los in owners.values()):
                flags = np.ones(held[0], bool)
            each = runs(flags, rule.length)
            if each:
                for (id_key, tag), los in owners.items():
                    for a, b in merged([(lo + a, lo + b) for lo in los for a, b in each]):
                        yield id_key, tag, a, b

    def batch_of(rows) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id_key", "tag", "start", "end"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict] = []
        held, last = 0, None
        for batch in batches:
            for h, id_key, tag, los, starts, context in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                if h != last:
                    if held >= BATCH_BYTES:
                        yield batch_of(solve(groups))
                        groups, held = [], 0
                    groups.append({})
                    last = h
                owners = groups[-1].setdefault((starts, context), {})
                held += 0 if owners else len(context)
                owners.setdefault((id_key, tag), set()).update(los)
        if groups:
            yield batch_of(solve(groups))

    return contexts.mapInArrow(run, SPANS)


def hot_spans(contexts: DataFrame, rule: Repeats) -> DataFrame:
    """The same for anchors of very many occurrences, which no task takes together.

    Equal contexts are counted by digest with a map-side combine: all strings of one that
    occurs twice are repeated.  Of each distinct context one row goes on, string by
    string, and the strings are counted likewise.
    """
    digest = F.unhex(F.sha2(F.concat("context", F.col("starts").cast("string").cast("binary")), 256))
    places = F.array_distinct(F.flatten(F.collect_list("los")))
    marked = contexts.withColumn("digest", digest).groupBy("id_key", "tag", "digest").agg(
        F.first("starts").alias("starts"), F.first("context").alias("context"), places.alias("los")
    )
    marked = stage(marked, "hot-contexts")
    seen = marked.groupBy("digest").agg(
        F.sum(F.size("los")).alias("n"), F.min(F.struct("id_key", "tag")).alias("first")
    )
    seen = stage(seen, "hot-digests")
    length = rule.length
    one = marked.join(
        seen.select("digest", "first.*"), ["digest", "id_key", "tag"], "left_semi"
    ).select("digest", "starts", "context")
    place = F.explode(F.sequence(F.lit(0), F.col("starts") - 1))
    strings = one.select("digest", "context", place.alias("at")).select(
        "digest", "at", F.unhex(F.sha2(F.substring("context", F.col("at") + 1, F.lit(length)), 256)).alias("s")
    )
    strings = stage(strings, "hot-strings")
    again = strings.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("s")
    single = strings.join(again.hint("merge"), "s", "left_semi").select("digest", "at")
    wanted = single.groupBy("digest").agg(F.collect_list("at").alias("ats"))
    known = seen.join(wanted.hint("merge"), "digest", "left").select("digest", "n", "ats")
    rows = marked.select("digest", "id_key", "tag", "los", "starts").join(known.hint("merge"), "digest")
    ats = F.when(F.col("n") > 1, F.sequence(F.lit(0), F.col("starts") - 1)).otherwise(F.col("ats"))
    start = F.col("lo") + F.col("at")
    placed = rows.select("id_key", "tag", F.explode("los").alias("lo"), ats.alias("ats"))
    return placed.select("id_key", "tag", "lo", F.explode("ats").alias("at")).select(
        "id_key", "tag", start.cast("int").alias("start"), (start + length).cast("int").alias("end")
    )


def remove_repeats(
    docs: DataFrame, rule: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` per row of ``docs``.

    A byte is removed if it lies in a string of ``length`` bytes that starts at another
    place of the corpus too, in the same text or another; strings are judged on the input.
    ``spans`` lists the maximal removed runs as ``start:end``.  A null or short text loses
    nothing.  Rows that repeat both id and text are one document and get its result each;
    rows that repeat an id alone, and null ids, are told apart by a checksum of the text.
    An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = narrow(docs, id_col, text_col).select(
        "doc_id",
        text.alias("text"),
        F.coalesce("doc_id", F.lit(NO_ID)).alias("id_key"),
        F.crc32(text.cast("binary")).alias("tag"),
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, hs, ns, ms = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                raw = t.as_buffer().to_pybytes()
                seen: dict[int, list[tuple[int, int]]] = {}
                for h, lo, hi in anchored(raw, rule):
                    seen.setdefault(h, []).append((lo, hi))
                owner += [i] * len(seen)
                hs += seen
                for at in seen.values():
                    ns.append(len(at))
                    one = len(at) == 1
                    ms.append(1 if one else len({hash(raw[a : b + rule.length]) for a, b in at}))
            take = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hs, pa.int64()),
                    batch.column(0).take(take),
                    batch.column(2).take(take),
                    pa.array(ns, pa.int32()),
                    pa.array(ms, pa.int32()),
                ],
                ["h", "id_key", "tag", "n", "m"],
            )

    found = rows.select("id_key", "text", "tag").mapInArrow(
        find, "h long, id_key long, tag long, n int, m int"
    )
    found = stage(found, "anchors")
    often = found.groupBy("h").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).filter("n > 1")
    # Written out, so that the join's two exchanges stand alone and a hot anchor is split.
    often = stage(often.select("h", (F.col("m") > rule.hot).alias("hot")), "often")
    listed = found.select("h", "id_key", "tag").join(often.hint("merge"), "h")
    listed = listed.groupBy("id_key", "tag").agg(F.collect_set(F.struct("h", "hot")).alias("found"))
    listed = stage(listed, "repeated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "id_key", "tag", "los", "starts", "context", "hot"]
        kinds = [
            pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.bool_()
        ]

        def made(out: list) -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            out, size = [], 0
            for id_key, tag, t, each in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw, id_key, tag = t.as_buffer().to_pybytes(), id_key.as_py(), tag.as_py()
                wanted = {f["h"]: f["hot"] for f in each.as_py()}
                for h, los, starts, context in context_rows(raw, rule, wanted):
                    out.append((h, id_key, tag, los, starts, context, wanted[h]))
                    size += len(context)
                    if size > ROW_BYTES:
                        yield made(out)
                        out, size = [], 0
            if out:
                yield made(out)

    joined = rows.join(listed.hint("merge"), ["id_key", "tag"])
    # The text's exchange below is the one that the last join reads again.
    contexts = joined.select("id_key", "tag", "text", "found", "doc_id").mapInArrow(
        cut,
        "h long, id_key long, tag long, los array<int>, starts int, context binary, hot boolean",
    )
    near = contexts.filter("NOT hot").drop("hot")
    spans = group_spans(near.repartition("h").sortWithinPartitions("h"), rule)
    if not often.filter("hot").isEmpty():
        spans = spans.unionByName(hot_spans(contexts.filter("hot").drop("hot"), rule))
    spans = spans.groupBy("id_key", "tag").agg(F.collect_list(F.array("start", "end")).alias("each"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, each in zip(batch.column(1), batch.column(2), strict=True):
                raw = t.as_buffer().to_pybytes()
                gone = merged(each.as_py() or [])
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                lost = sum(b - a for a, b in gone)
                shown = ",".join([f"{a}:{b}" for a, b in gone])
                out.append((len(raw), lost, len(gone), kept.hexdigest(), shown))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    return (
        rows.join(spans.hint("merge"), ["id_key", "tag"], "left")
        .select("doc_id", "text", "each")
        .mapInArrow(
            strip,
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string",
        )
    )


def merged(spans: list) -> list[tuple[int, int]]:
    """Spans in order, with those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
