"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes; a chunk ends where its high bits are zero.  The hash
sees 16 bytes, so an insertion moves the chunk borders near it and no others, and a
passage that occurs elsewhere is cut in the same places there.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import narrow, pieces, text_bytes
from panelcast.session import stage

WINDOW = 16
# One random word per byte value, from a seed: the rule is fixed, the values are not special.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 16, 256).astype(np.uint16)


@dataclass(frozen=True)
class Cuts:
    """Shortest and longest chunk in bytes; a border has ``zero_bits`` high bits zero.

    Chunks are about ``shortest + 2 ** zero_bits`` bytes, so a passage of 50 words holds
    several whole ones.  Single chunks are common phrases on a large corpus: only runs of
    neighbouring repeated chunks of ``least`` bytes or more count as repeats.
    """

    shortest: int = 24
    longest: int = 512
    zero_bits: int = 5
    least: int = 100


def borders(raw: bytes, cuts: Cuts = Cuts()) -> list[int]:
    """Ends of the chunks of ``raw``, in order; the last is its length.

    A tail shorter than ``shortest`` belongs to the chunk before it.
    """
    n = len(raw)
    if not n:
        return []
    h = GEAR[np.frombuffer(raw, np.uint8)]
    step = 1
    while step < WINDOW:
        # Twice the window: the older half has moved up by as many bits as it is old.
        h[step:] += h[:-step] << np.uint16(step)
        step *= 2
    marks = (np.flatnonzero(h < (1 << (16 - cuts.zero_bits))) + 1).tolist()
    ends, start = [], 0
    for mark in marks:
        while mark - start > cuts.longest:
            start += cuts.longest
            ends.append(start)
        if mark - start >= cuts.shortest:
            ends.append(mark)
            start = mark
    while n - start > cuts.longest:
        start += cuts.longest
        ends.append(start)
    if ends and n - start < cuts.shortest:
        ends[-1] = n
    else:
        ends.append(n)
    return ends


def chunks(docs: DataFrame, cuts: Cuts = Cuts()) -> DataFrame:
    """``doc_id, row, start, size, digest`` per chunk of the whole texts.

    ``row`` tells rows that share an id apart, by a checksum of their text.
    """
    names = ["doc_id", "row", "start", "size", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            owner, rows, starts, sizes, marks = [], [], [], [], []
            for i, text in enumerate(texts):
                raw, at = text_bytes(text), 0
                row = zlib.crc32(raw)
                for end in borders(raw, cuts):
                    owner.append(i)
                    rows.append(row)
                    starts.append(at)
                    sizes.append(end - at)
                    marks.append(hashlib.blake2b(raw[at:end], digest_size=16).digest())
                    at = end
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(owner, pa.int64())),
                    pa.array(rows, pa.int64()),
                    pa.array(starts, pa.int32()),
                    pa.array(sizes, pa.int32()),
                    pa.array(marks, pa.binary()),
                ],
                names,
            )

    return docs.mapInArrow(run, "doc_id long, row long, start int, size int, digest binary")


def repeated_chunks(
    docs: DataFrame, cuts: Cuts = Cuts(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """What repeats in each document: one row per id.

    Returns ``doc_id, n_bytes, n_chunks, n_repeated`` (chunks that occur elsewhere too and lie
    in a run of such chunks of ``cuts.least`` bytes or more), ``n_removed`` (bytes of those
    whose first occurrence, by id and place, is another),
    ``removed`` (their spans as ``start:end``, joined where they touch) and ``first_ids``
    (ids that hold the first occurrences).  A null or empty text has no chunks; rows that
    repeat an id are reported together, and their equal chunks count as repeats; a null
    id comes last among occurrences.  Digests are counted with a map-side combine and
    their rows joined back in a join that can be split, so a passage in a third of all
    documents is no single task's work.
    """
    rows = narrow(docs, id_col, text_col)
    cut = stage(chunks(rows, cuts), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "start")
    # Written out, so that the join's two exchanges stand alone and a hot digest is split.
    counted = stage(
        cut.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .filter("n > 1")
        .select("digest", "first.doc_id", "first.start")
        .toDF("digest", "first_id", "first_start"),
        "repeated-chunks",
    )
    found = cut.join(counted.hint("merge"), "digest")
    later = ~(
        F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("start") == F.col("first_start"))
    )
    one = F.struct("row", "start", "size", later.alias("later"), "first_id")
    per_doc = (
        found.groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(one)).alias("found"))
        .mapInArrow(
            _long_runs(cuts.least),
            "doc_id long, n_repeated long, n_removed long, removed string, first_ids array<bigint>",
        )
    )
    counts = cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    sizes = rows.groupBy("doc_id").agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("n_bytes")
    )
    zero = F.lit(0).cast("long")
    return (
        sizes.alias("s")
        .join(counts.alias("c"), _same("s", "c"), "left")
        .join(per_doc.alias("p"), _same("s", "p"), "left")
        .select(
            "s.doc_id",
            "s.n_bytes",
            F.coalesce("n_chunks", zero).alias("n_chunks"),
            F.coalesce("n_repeated", zero).alias("n_repeated"),
            F.coalesce("n_removed", zero).alias("n_removed"),
            F.coalesce("removed", F.lit("")).alias("removed"),
            F.coalesce("first_ids", F.array().cast("array<bigint>")).alias("first_ids"),
        )
    )


def long_enough(found: list[dict], least: int) -> list[dict]:
    """Chunks, sorted by row and start, that lie in runs of ``least`` bytes or more."""
    out: list[dict] = []
    run: list[dict] = []
    for c in [*found, None]:
        last = run[-1] if run else None
        if last and not (
            c and c["row"] == last["row"] and c["start"] in (last["start"], last["start"] + last["size"])
        ):
            if last["start"] + last["size"] - run[0]["start"] >= least:
                out += run
            run = []
        run.append(c)
    return out


def _long_runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeated, removed, spans, firsts = [], [], [], []
            for found in batch.column(1).to_pylist():
                found = long_enough(found, least)
                gone = [c for c in found if c["later"]]
                repeated.append(len(found))
                removed.append(sum(c["size"] for c in gone))
                spans.append(touching(sorted((c["start"], c["size"]) for c in gone)))
                firsts.append(sorted({c["first_id"] for c in gone if c["first_id"] is not None}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(repeated, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.string()),
                    pa.array(firsts, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_repeated", "n_removed", "removed", "first_ids"],
            )

    return run


def touching(pairs: list[tuple[int, int]]) -> str:
    """Sorted (start, size) pairs as ``start:end``; spans that touch become one."""
    out: list[list[int]] = []
    for start, size in pairs:
        if out and out[-1][1] == start:
            out[-1][1] += size
        else:
            out.append([start, start + size])
    return ",".join([f"{a}:{b}" for a, b in out])


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def without(raw: bytes, removed: str) -> bytes:
    """``raw`` without the spans that ``removed`` lists."""
    out, at = [], 0
    for span in filter(None, removed.split(",")):
        start, end = map(int, span.split(":"))
        out.append(raw[at:start])
        at = end
    return b"".join([*out, raw[at:]])
