"""Packing of token sequences by hierarchical best fit.

Each task packs the pieces it has cut, best fit in falling length.  Nearly full bins are
done; the others go on as items whose length is what they hold, are packed again in fewer
and fewer groups, and so merge up a tree until a round finds nothing to merge.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import distinct, joined, narrow, no_cycles, pieces
from panelcast.session import stage

LENGTH = 1024
END_ID = 2
FULL = 0.995
GROUP = 50_000
MEMO = 900_000
ROW_UNITS = 5000

# White space of the tokenizer's pattern.
SPACE = "\t-\r \x85\xa0  -     　"
BLANKS = frozenset("\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {
    chr(c) for c in range(0x2000, 0x200B)
}
STOPS = ".,;:!?"
STOP_SET = frozenset(STOPS)


class UnitCoder:
    """Ids of whole texts by the tokenizers library, each distinct unit encoded once.

    A unit is a stretch without white space together with the white space before it: the
    split pattern never looks past such a border.  Texts in which all white space is
    single blanks and newlines, as most are, are cut without a pattern.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary)
        self.marks = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.units = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        vocab = self.library.get_vocab()
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.sizes[i] = len(token)  # one letter per byte
        self.memo: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        """Keys of the text's units: a unit's one blank in front is left out, so that texts
        are cut by ``str.split``; one that starts with a newline is its own key, and any
        other has a blank put in front."""
        # Equal where all white space is single blanks and newlines between words.
        if len(text.split()) != text.count(" ") + text.count("\n") + 1:
            return list(map(self._key, self.units(text)))
        # A newline takes the place of the blank before what follows it.
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = " " + keys[0]
        return keys

    @staticmethod
    def _key(unit: str) -> str:
        if unit[:1] == "\n":
            return unit
        return unit[1:] if unit[:1] == " " and unit[1:2] not in (" ", "\n", "") else " " + unit

    @staticmethod
    def _unit(key: str) -> str:
        if key[:1] == " ":
            return key[1:]
        return key if key[:1] == "\n" else " " + key

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        with no_cycles():
            odd = {i for i, t in enumerate(texts) if t and any(m in t for m in self.marks)}
            cut = [[] if not t or i in odd else self._cut(t) for i, t in enumerate(texts)]
            keys, places, edges = distinct(cut)
            if len(self.memo) + len(keys) > MEMO:
                self.memo.clear()
            codes = list(map(self.memo.get, keys))
            new = [i for i, code in enumerate(codes) if code is None]
            self._learn([keys[i] for i in new])
            for i in new:
                codes[i] = self.memo[keys[i]]
            found = joined(codes, places, edges)
            for i in odd:
                found[i] = self._ids([texts[i]])[0]
            return found

    def _learn(self, keys) -> None:
        """Encode new units.

        Letters and the stops after them are two words to the split pattern, so a unit
        like that is put together from both.  Units that start with white space and end
        without are encoded in a row, the others one by one.
        """
        memo, made, new = self.memo, [], []
        for k in keys:
            if k[-1:] in STOP_SET:
                stem = k.rstrip(STOPS)
                if stem.isalpha() or stem[1:].isalpha():
                    made.append((k, stem, " " + k[len(stem) :]))
                    continue
            new.append(k)
        new += {p for _, *both in made for p in both} - memo.keys() - set(new)
        row = [k for k in new if k and k[-1] not in BLANKS and (k[0] != " " or k[1] in BLANKS)]
        alone = list(set(new).difference(row))
        memo.update(zip(alone, self._ids(list(map(self._unit, alone))), strict=True))
        for i in range(0, len(row), ROW_UNITS):
            part = row[i : i + ROW_UNITS]
            units = list(map(self._unit, part))
            joined = self._ids(["".join(units)])[0]
            ends = np.cumsum(self.sizes[np.frombuffer(joined, "<u4")])
            wanted = np.cumsum([len(u) if u.isascii() else len(u.encode("utf-8")) for u in units])
            cuts = np.searchsorted(ends, wanted)
            if (ends[cuts] != wanted).any():
                raise ValueError("a token spans two units")
            stops = (4 * cuts + 4).tolist()
            memo.update(
                zip(part, [joined[x:y] for x, y in zip([0, *stops], stops, strict=False)], strict=True)
            )
        for k, stem, tail in made:
            memo[k] = memo[stem] + memo[tail]

    def _ids(self, texts: list[str]) -> list[bytes]:
        got = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]


def cut_pieces(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first may be shorter."""
    first = n % length or length
    return [(0, min(first, n)), *((s, length) for s in range(first, n, length))]


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its place there, and what each bin holds; longest items first.

    The rooms that open bins have are bits of one number, so the least room that an item
    fits is its lowest bit from the item's size on.
    """
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms, used = 0, []
    place = np.zeros(len(sizes), np.int64)
    at = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = length, len(used)
            used.append(0)
        place[i], at[i] = b, length - room
        used[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return place, at, np.array(used, np.int64)


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, "
    "used long"
)


def tokenized_pieces(docs: DataFrame, vocabulary: str, length: int, end_id: int) -> DataFrame:
    """Pieces of all documents, packed within their task, ``GROUP`` pieces at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = UnitCoder(shared.value)
        base = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal base
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            place, at, used = best_fit(frame["length"].to_numpy(np.int64), length)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            frame["bin"], frame["at"], frame["used"] = base + place, at, used[place]
            base += len(used)
            rows.clear()
            return pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

        for ids, texts in pieces(batches):
            for doc_id, code in zip(ids.to_pylist(), coder.encode(texts), strict=True):
                code += end
                for k, (start, n) in enumerate(cut_pieces(len(code) // 4, length)):
                    crc = zlib.crc32(code[4 * start : 4 * (start + n)])
                    rows.append((doc_id, k, start, n, crc))
            if len(rows) >= GROUP:
                yield packed()
        if rows:
            yield packed()

    int64 = pa.int64()
    schema = pa.schema(
        [(c.split()[0], pa.int32() if c.split()[1] == "int" else int64) for c in PIECES.split(", ")]
    )
    return docs.mapInArrow(run, PIECES)


def merge_round(bins: DataFrame, groups: int, turn: int, length: int) -> DataFrame:
    """Pack bins as items within ``groups`` groups: ``bin, used, into, shift, held``.

    A merged bin takes the id of its first item.
    """

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin", ignore_index=True)
        place, at, used = best_fit(frame["used"].to_numpy(), length)
        ids = frame["bin"].to_numpy()
        head = np.zeros(len(used), np.int64)
        head[place[at == 0]] = ids[at == 0]
        return frame[["bin", "used"]].assign(into=head[place], shift=at, held=used[place])

    key = F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(groups))
    return (
        bins.withColumn("group", key)
        .groupBy("group")
        .applyInPandas(pack, "bin long, used long, into long, shift long, held long")
    )


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    full: float = FULL,
    group: int = GROUP,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    A document is its ids and then ``end_id``; one of more than ``length`` ids is cut into
    pieces of ``length``, the first of which may be shorter.  A null or empty text is one
    piece of one id; a repeated row is packed like any other; an empty table gives no
    rows.  Bins at least ``full`` full are done after any round.  A round packs groups of
    about ``group`` bins; it ends with one group, or when merging frees under one bin in
    a thousand, as where all items exceed half a sequence.
    """
    placed = stage(
        tokenized_pieces(narrow(docs, id_col, text_col), vocabulary, length, end_id), "pieces"
    )
    least = ceil(full * length)
    out = placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", F.col("bin").alias("home")
    )
    todo = stage(
        placed.filter(F.col("used") < least).groupBy("bin").agg(F.max("used").alias("used")), "bins"
    )
    count, moves, turn = todo.count(), None, 0
    while count > 1:
        groups = ceil(count / group)
        merged = stage(merge_round(todo, groups, turn, length), "merged")
        step = merged.select("bin", "into", "shift")
        if moves is None:
            moves = step
        else:
            later = step.select(
                F.col("bin").alias("into"), F.col("into").alias("next"), F.col("shift").alias("on")
            )
            moves = moves.join(later, "into", "left").select(
                "bin",
                F.coalesce("next", "into").alias("into"),
                (F.col("shift") + F.coalesce("on", F.lit(0))).alias("shift"),
            )
        todo = stage(
            merged.filter(F.col("held") < least)
            .groupBy(F.col("into").alias("bin"))
            .agg(F.max("held").alias("used")),
            "bins",
        )
        before, count, turn = merged.count(), todo.count(), turn + 1
        heads = merged.filter(F.col("bin") == F.col("into")).count()
        if groups == 1 or before - heads < before / 1000:
            break
    if moves is not None:
        out = out.join(moves, "bin", "left").select(
            *out.columns[:5],
            F.coalesce("into", "bin").alias("home"),
            (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"),
        )
    return out.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.col("home").alias("sequence_id"),
        F.col("at").alias("offset"),
    )
