"""Near-duplicate documents by b-bit MinHash.

Documents with equal shingle sets form a class.  Bands of minima bring classes into
buckets; the low bits of the minima, packed, estimate the similarity of two members of a
bucket by counting bits; what passes is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import narrow, pieces, text_bytes
from panelcast.llm.components import components
from panelcast.session import stage

WORD_MEMO = 400_000
BLOCK = 1000
BROADCAST_IDS = 500_000


@dataclass(frozen=True)
class NearSettings:
    """``words`` per shingle, ``percent`` of similarity, ``bands`` of ``rows`` minima.

    Two sets at the threshold of 80 % miss all 32 bands of 4 with a chance of 5e-8.  The
    estimate from the ``bits`` low bits of ``minima`` minima, the bands' among them, may
    fall ``sigmas`` deviations short.
    """

    words: int = 4
    percent: int = 80
    bands: int = 32
    rows: int = 4
    bits: int = 2
    minima: int = 512
    sigmas: float = 5.0
    seed: int = 11

    @property
    def least_matches(self) -> int:
        """Equal low-bit groups that a pair at the threshold falls below by chance alone."""
        j, c = self.percent / 100, 0.5**self.bits
        p = c + (1 - c) * j
        return int(self.minima * p - self.sigmas * (self.minima * p * (1 - p)) ** 0.5)

    def estimate(self, matches: np.ndarray) -> np.ndarray:
        """Similarity from matching groups, without those that match by chance."""
        c = 0.5**self.bits
        return (matches / self.minima - c) / (1 - c)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """Eight hash bytes per word, made when first asked for."""

    def __init__(self):
        from xxhash import xxh3_64_digest

        super().__init__()
        self.digest = xxh3_64_digest

    def __missing__(self, word: bytes) -> bytes:
        found = self[word] = self.digest(word)
        return found


class Shingler:
    """64-bit hashes of the distinct shingles of a text."""

    def __init__(self, settings: NearSettings):
        from xxhash import xxh3_64_intdigest

        self.hash, self.n = xxh3_64_intdigest, settings.words
        self.memo = WordHashes()
        rng = np.random.default_rng(settings.seed)
        self.factors = rng.integers(1, 1 << 63, self.n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.a = rng.integers(1, 1 << 63, settings.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, settings.minima, dtype=np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted; empty for a text without words."""
        words = text_bytes(text).lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.n:
            whole = self.hash(b" ".join(words), seed=len(words))
            return np.array([whole], np.uint64)
        if len(self.memo) > WORD_MEMO:
            self.memo.clear()
        h = np.frombuffer(b"".join(map(self.memo.__getitem__, words)), np.uint64)
        n = len(h) - self.n + 1
        code = h[:n] * self.factors[0]
        for k in range(1, self.n):
            code = mixed(code) + h[k : k + n] * self.factors[k]
        return np.unique(mixed(code))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """Least value of the set under each of the permutations."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 2048):
            part = shingles[i : i + 2048]
            for k in range(0, len(self.a), 32):
                code = part[None, :] * self.a[k : k + 32, None] + self.b[k : k + 32, None]
                # The high half of a product depends on all bits of the factor.
                np.minimum(least[k : k + 32], (code ^ (code >> np.uint64(32))).min(axis=1), out=least[k : k + 32])
        return least


def packed(minima: np.ndarray, bits: int) -> np.ndarray:
    """Low bits of the minima as 64-bit words, one plane of words per bit."""
    planes = [np.packbits(((minima >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)) for b in range(bits)]
    return np.concatenate([np.pad(p, (0, -len(p) % 8)) for p in planes]).view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, low array<long>"


def signatures(docs: DataFrame, settings: NearSettings) -> DataFrame:
    """Per document the size and digest of its set, its band keys and packed low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        powers = np.arange(settings.bands, dtype=np.uint64)
        for ids, texts in pieces(batches):
            sizes, keys, bands, low = [], [], [], []
            for text in texts:
                s = shingler.shingles(text)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), low.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = shingler.minima(s)
                code = mixed(powers + np.uint64(1))
                for row in m[: settings.bands * settings.rows].reshape(settings.bands, -1).T:
                    code = mixed(code * np.uint64(3) + row)
                bands.append(code.view(np.int64))
                low.append(packed(m, settings.bits))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(low, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "bands", "low"],
            )

    return docs.mapInArrow(run, SIGNED)


def matches(a: Column, b: Column, settings: NearSettings) -> Column:
    """Groups of low bits that agree: positions in which no plane differs."""
    words = -(-settings.minima // 64)
    total = F.lit(settings.minima)
    for w in range(words):
        off = F.lit(0).cast("long")
        for plane in range(settings.bits):
            k = plane * words + w
            off = off.bitwiseOR(a[k].bitwiseXOR(b[k]))
        total = total - F.bit_count(off)
    return total


def full_sets(ids: DataFrame, docs: DataFrame, settings: NearSettings) -> DataFrame:
    """``doc_id, shingles`` (sorted) of the documents with the given distinct ids.

    Their texts are shingled again.  The ids go to the texts by broadcast while there are
    at most ``BROADCAST_IDS``, else both sides are shuffled.
    """
    ids = stage(ids, "paired-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings)
        for part, texts in pieces(batches):
            sets = [shingler.shingles(t).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part, pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"]
            )

    chosen = docs.join(side, "doc_id", "left_semi")
    return stage(chosen.mapInArrow(run, "doc_id long, shingles array<long>"), "sets")


def confirm(pairs: DataFrame, docs: DataFrame, settings: NearSettings) -> DataFrame:
    """The ``pairs (a, b)`` whose full shingle sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = full_sets(ids, docs, settings)
    # Rows that repeat an id would repeat its pairs; any of them may stand for it.
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .filter(100 * common >= settings.percent * (F.size("of_a") + F.size("of_b") - common))
        .select("a", "b")
        .distinct()
    )


class Members:
    """Members of two blocks of a bucket, as arrays."""

    def __init__(self, rows: pa.StructArray, settings: NearSettings):
        def column(name):
            return rows.field(name)

        self.ids, self.part, self.own = (np.asarray(column(c)) for c in ("id", "part", "own"))
        words = -(-settings.minima // 64)
        low = np.asarray(column("low").flatten()).view(np.uint64)
        self.low = low.reshape(len(self.ids), settings.bits, words)
        self.bands = np.asarray(column("bands").flatten()).reshape(len(self.ids), -1)
        codes = [np.asarray(c) for c in (column("code").flatten(), column("code").offsets)]
        self.codes, self.ends = codes[0], codes[1] - codes[1][0]
        self.sizes = np.diff(self.ends)

    def code(self, i: int) -> np.ndarray:
        return self.codes[self.ends[i] : self.ends[i + 1]]

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """At least as many shingles as each of ``others`` shares with ``i``."""
        own = self.code(i)
        held = np.concatenate([self.code(j) for j in others])
        at = np.minimum(np.searchsorted(own, held), len(own) - 1)
        starts = np.concatenate([[0], np.cumsum(self.sizes[others])[:-1]])
        return np.add.reduceat((own[at] == held).astype(np.int64), starts)


def linked(members: Members, band: int, two: bool, settings: NearSettings, every: bool) -> list:
    """Pairs of different components that their sets let pass: one per pair of components
    that are not yet joined here, or ``every`` one."""
    joined: dict[int, int] = {}

    def head(part: int) -> int:
        while part in joined:
            part = joined[part]
        return part

    heads, found = members.part.copy(), []
    for i in range(len(members.ids) - 1):
        later = slice(i + 1, None)
        wanted = heads[later] != heads[i]
        if two:  # pairs within a block belong to the task that has it alone
            wanted &= members.own[later] != members.own[i]
        others = np.flatnonzero(wanted) + i + 1
        if not len(others):
            continue
        off = np.bitwise_or.reduce(members.low[others] ^ members.low[i], axis=1)
        same = settings.minima - np.bitwise_count(off).sum(axis=1, dtype=np.int64)
        others = others[same >= settings.least_matches]
        # a pair is looked at in the first band that it shares
        seen = (members.bands[others, :band] == members.bands[i, :band]).any(axis=1)
        others = others[~seen]
        if not len(others):
            continue
        common = members.common(i, others)
        union = members.sizes[others] + members.sizes[i] - common
        for j in others[100 * common >= settings.percent * union]:
            a, b = head(int(members.part[i])), head(int(members.part[j]))
            if every or a != b:
                found.append((min(members.ids[i], members.ids[j]), max(members.ids[i], members.ids[j])))
            if a != b and not every:
                joined[max(a, b)] = min(a, b)
                heads[heads == max(a, b)] = min(a, b)
    return found


def across(
    buckets: DataFrame, settings: NearSettings, every: bool = False
) -> DataFrame:
    """Links between components within buckets ``(key, band, size, id, part, low, bands, code)``.

    A bucket is cut into blocks of about ``BLOCK`` members; a task sees two blocks, compares
    their packed bits and then the sets (as 32-bit hashes, which can only let too much
    pass), and gives one pair per two components that it joins: rows grow with the members,
    not with their pairs.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = buckets.withColumn("n", blocks).withColumn(
        "own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")
    )
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    grouped = cut.groupBy(
        "key", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
    ).agg(F.collect_list(F.struct("id", "part", "own", "low", "bands", "code")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, two = batch["band"].to_pylist(), batch["two"].to_pylist()
            for k in range(batch.num_rows):
                members = Members(batch["members"][k].values, settings)
                found = linked(members, bands[k], two[k], settings, every)
                a, b = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]
                )

    tasks = grouped.select("band", (F.col("lo") != F.col("hi")).alias("two"), "members")
    return tasks.mapInArrow(run, "a long, b long").distinct()


def short_codes(sets: DataFrame) -> DataFrame:
    """``id, code``: the sets with 32 bits a shingle, none left out, sorted."""
    high = F.transform("shingles", lambda s: F.shiftright(s, 32).cast("int"))
    # rows that repeat an id: any of them may stand for it
    one = sets.groupBy("doc_id").agg(F.first("shingles").alias("shingles"))
    return one.select(F.col("doc_id").alias("id"), F.array_sort(high).alias("code"))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The ``pairs`` whose ends are in different components."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("part_a"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("part_b"))
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    other = F.coalesce("part_a", "a") != F.coalesce("part_b", "b")
    return both.filter(other).select("a", "b")


def grown(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what is labelled and of more links between them."""
    known = labels.filter("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    return stage(components(stage(known.unionByName(links), "links")), "labels")


def near_duplicates(
    docs: DataFrame,
    settings: NearSettings = NearSettings(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row, from whole texts.

    Words are runs of other than ASCII blanks with A-Z in lower case; a text with fewer
    words than a shingle is one shingle.  Linked: full sets with a similarity of at least
    ``percent``; ``component_id`` is the smallest id reachable over links.  Null, empty
    and blank texts have an empty set and are linked with nothing; rows that repeat an id
    share its links; a null id is no one's component but joins its set's.

    First every member of a bucket meets the bucket's smallest member, which joins large
    groups without their pairs.  Then those buckets that still hold several components are
    searched in blocks, so that no link between components is missed.
    """
    rows = narrow(docs, id_col, text_col)
    signed = stage(signatures(rows, settings), "signatures")
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key")
    classes = stage(
        classes.agg(
            F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("low").alias("low")
        ),
        "classes",
    )
    members = classes.select("id", F.explode("bands").alias("key"))
    lead = members.groupBy("key").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("size"))
    lead = stage(lead.filter("size > 1"), "buckets")
    low = classes.select("id", "low")
    near = members.withColumnRenamed("id", "b").join(lead.hint("merge"), "key")
    pairs = near.filter("a != b").select("a", "b").distinct()
    pairs = pairs.join(low.toDF("a", "low_a"), "a").join(low.toDF("b", "low_b"), "b")
    likely = pairs.filter(
        matches(F.col("low_a"), F.col("low_b"), settings) >= settings.least_matches
    )
    likely = stage(likely.select("a", "b"), "likely")
    # One link per member joins most of a large group; of the other pairs only those
    # between components are left to confirm.
    first = likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = stage(confirm(stage(first, "first"), rows, settings), "links")
    labels = stage(components(links), "labels")
    rest = stage(apart(likely.join(first, ["a", "b"], "left_anti"), labels), "rest")
    if not rest.isEmpty():
        labels = grown(labels, confirm(rest, rows, settings))

    part = F.coalesce("label", "id").alias("part")
    parted = classes.join(labels, F.col("id") == F.col("node"), "left").select("id", part, "bands")
    placed = parted.select("id", "part", F.posexplode("bands").alias("band", "key")).join(
        lead.filter("size > 2").select("key", "size").hint("merge"), "key"
    )
    mixed_keys = placed.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"))
    mixed_keys = mixed_keys.filter("x != y").select("key")
    placed = stage(placed.join(mixed_keys.hint("merge"), "key", "left_semi"), "open-buckets")
    if not placed.isEmpty():
        sets = full_sets(placed.select(F.col("id").alias("doc_id")).distinct(), rows, settings)
        known = classes.select("id", "low", "bands").join(short_codes(sets), "id")
        open_buckets = placed.join(known, "id")
        more = stage(across(open_buckets, settings), "links-across")
        links = stage(confirm(more, rows, settings), "links")
        if links.count() < more.count():
            # a pair that only its short hashes let pass may have stood for a true link
            links = confirm(stage(across(open_buckets, settings, every=True), "links-across"), rows, settings)
        labels = grown(labels, links)

    ids = classes.select("set_key", "id").join(labels, F.col("id") == F.col("node"), "left")
    ids = ids.select("set_key", F.coalesce("label", "id").alias("component"))
    found = signed.select("doc_id", "n_shingles", "set_key").join(ids.hint("merge"), "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def keep_one(docs: DataFrame, settings: NearSettings = NearSettings(words=5)) -> DataFrame:
    """``docs`` with all its columns, without all but the smallest id of each component."""
    kept = near_duplicates(docs, settings).filter("kept").select(F.col("doc_id").alias("id"))
    names = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("row"))
    return rows.join(kept, rows["row"]["doc_id"].eqNullSafe(kept["id"]), "left_semi").select("row.*")
