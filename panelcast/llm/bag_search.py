"""Ranked lexical search over classes of documents that no item can tell apart.

A document counts for the items only by the terms it shares with them and by its length
norm ``m``.  Documents are cut down to the items' vocabulary; those with equal term counts
and equal ``m`` form a class, found by hash and verified on the counts themselves.  Each
class is scored once, and only the classes that reach an item's list are expanded to their
members, by ascending id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import pieces
from panelcast.session import stage

# Letters and digits of ASCII and all bytes beyond it make up terms; only A-Z is lowered.
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
# (item, term) pairs whose vocabulary a task holds at once; more items go in further blocks.
BLOCK_PAIRS = 200_000
CELLS = 2_000_000  # scores, or products that add up to them, that a task holds at once
EXACT = 2**53  # sums of doubles are exact integers below


@dataclass(frozen=True)
class Ranking:
    """``top`` documents an item; ``length_percent`` of the norm follows the length, and
    ``saturation`` (in thousandths per percent of norm) dampens repeated terms."""

    top: int = 10
    length_percent: int = 75
    saturation: int = 8

    def norm(self, n: Column, documents: int, terms: int) -> Column:
        """``m`` of a document of ``n`` terms; in decimals, as the product outgrows 64 bits."""
        wide = "decimal(19,0)"
        length = (n * self.length_percent).cast(wide) * F.lit(documents).cast(wide)
        whole = F.call_function("div", length, F.lit(max(terms, 1)).cast(wide))
        return (whole + (100 - self.length_percent)).cast("long")

    def weight(self, documents: int, holding: int) -> int:
        return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))

    def share(self, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + self.saturation * m)


def split_terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def _raw(frame: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return frame.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"))


def item_bags(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, terms, repeats, digest``: one row per distinct item that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            bags = [sorted(Counter(split_terms(t)).items()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([[t for t, _ in b] for b in bags], pa.list_(pa.binary())),
                    pa.array([[n for _, n in b] for b in bags], pa.list_(pa.int64())),
                ],
                ["item_id", "terms", "repeats"],
            )

    bags = _raw(items, id_col, text_col).mapInArrow(
        run, "item_id long, terms array<binary>, repeats array<long>"
    )
    return bags.filter(F.size("terms") > 0).distinct()


@dataclass
class Vocabulary:
    """The terms of one block of items, and for each term the items that hold it."""

    item_ids: list[int | None]
    numbers: dict[bytes, int]
    starts: np.ndarray  # of a term's items in the two arrays below
    items: np.ndarray
    repeats: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Vocabulary:
        terms = sorted({t for r in rows for t in r["terms"]})
        numbers = {bytes(t): i for i, t in enumerate(terms)}
        pairs = sorted(
            (numbers[bytes(t)], i, n)
            for i, r in enumerate(rows)
            for t, n in zip(r["terms"], r["repeats"], strict=True)
        )
        term, item, repeats = np.array(pairs, np.int64).reshape(-1, 3).T
        starts = np.searchsorted(term, np.arange(len(terms) + 1))
        return cls([r["item_id"] for r in rows], numbers, starts, item, repeats)

    @property
    def longest(self) -> int:
        return int(np.bincount(self.items, self.repeats).max())


def bags(docs: DataFrame, words: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, terms, tfs`` per document with a term: its length, and its counts of the
    vocabulary's terms in ascending order."""
    numbers = words.numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in pieces(batches):
            lengths, sizes, found = [], [], []
            for text in texts:
                held = split_terms(text)
                counts = Counter(held)
                bag = sorted((numbers[t], counts[t]) for t in counts.keys() & numbers.keys())
                lengths.append(len(held))
                sizes.append(len(bag))
                found += bag
            flat = np.array(found, np.int32).reshape(-1, 2)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(flat[:, j])) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"]
            )

    made = _raw(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<int>"
    )
    return made.filter("n > 0")


def bag_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "m", "terms", "tfs")


def classes_of(normed: DataFrame) -> tuple[DataFrame, int]:
    """``h, m, terms, tfs, first_id`` per class of equal ``m`` and counts, and the hash's seed.

    Rows are combined before the shuffle.  The groups are those of the counts, not of the
    hash; should two of them share a hash, all are hashed anew, so that afterwards ``h``
    alone names a class.
    """
    for seed in count():
        hashed = normed.withColumn("h", bag_hash(seed))
        groups = stage(
            hashed.groupBy("h", "m", "terms", "tfs").agg(F.min("doc_id").alias("first_id")),
            "bag-classes",
        )
        if groups.groupBy("h").count().filter("count > 1").isEmpty():
            return groups, seed


def scored(
    classes: DataFrame, words: Vocabulary, weights: np.ndarray, ranking: Ranking
) -> DataFrame:
    """``item, score, first_id, h``: each task's best ``top`` classes per item."""
    items = len(words.item_ids)
    starts, held, repeats = words.starts, words.items, words.repeats
    exact = words.longest * int(weights.max(initial=0)) * 1_000_000 < EXACT

    def products(rows: np.ndarray, terms: np.ndarray, impact: np.ndarray, n_rows: int) -> np.ndarray:
        """Scores, rows by items."""
        fan = starts[terms + 1] - starts[terms]
        each = np.repeat(np.arange(len(terms)), fan)
        inside = np.arange(len(each)) - np.repeat(np.cumsum(fan) - fan, fan)
        at = starts[terms][each] + inside
        cell, value = rows[each] * items + held[at], impact[each] * repeats[at]
        if exact:
            total = np.bincount(cell, value, n_rows * items).astype(np.int64)
        else:
            total = np.zeros(n_rows * items, np.int64)
            np.add.at(total, cell, value)
        return total.reshape(n_rows, items)

    def best(pool: list[np.ndarray]) -> np.ndarray:
        """The leading ``top`` of every item: (item, score, no id, first id, hash)."""
        table = np.concatenate(pool, axis=1) if pool else np.empty((5, 0), np.int64)
        table = table[:, np.lexsort((table[4], table[3], table[2], -table[1], table[0]))]
        first = np.searchsorted(table[0], table[0])
        return table[:, np.arange(table.shape[1]) - first < ranking.top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool: list[np.ndarray] = []
        floor = np.ones(items, np.int64)  # what a score must reach to matter
        pending = 0
        for batch in batches:
            offsets = np.asarray(batch["terms"].offsets)
            terms = np.asarray(batch["terms"].values)
            tfs = np.asarray(batch["tfs"].values).astype(np.int64)
            m, h = np.asarray(batch["m"]), np.asarray(batch["h"])
            no_id = np.asarray(batch["first_id"].is_null()).astype(np.int64)
            first_id = np.asarray(batch["first_id"].fill_null(0))
            work = np.concatenate([[0], np.cumsum(starts[terms + 1] - starts[terms])])[offsets]
            work = work + np.arange(len(offsets)) * items  # products and cells up to a row
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(work, work[a] + CELLS, side="right")) - 1)
                part = slice(offsets[a], offsets[b])
                rows = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
                impact = weights[terms[part]] * ranking.share(tfs[part], m[a:b][rows])
                scores = products(rows, terms[part], impact, b - a)
                if b - a > ranking.top:
                    nth = np.partition(scores, b - a - ranking.top, axis=0)[b - a - ranking.top]
                    floor = np.maximum(floor, nth)
                row, item = np.nonzero(scores >= floor)
                at = row + a
                pool.append(np.stack([item, scores[row, item], no_id[at], first_id[at], h[at]]))
                pending += len(row)
                if pending > CELLS:
                    pool = [best(pool)]
                    pending = pool[0].shape[1]
                a = b
        item, score, no_id, first_id, h = best(pool)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(score), pa.array(first_id, mask=no_id == 1), pa.array(h)],
            ["item", "score", "first_id", "h"],
        )

    columns = classes.select("h", "m", "terms", "tfs", "first_id")
    return columns.mapInArrow(run, "item long, score long, first_id long, h long")


def _leading(rows: DataFrame, key: str, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each key, as ``rank``; each task cuts its own rows first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top)


def _search_block(
    docs: DataFrame, words: Vocabulary, ranking: Ranking, doc_id: str, doc_text: str
) -> DataFrame:
    spark = docs.sparkSession
    vectors = stage(bags(docs, words, doc_id, doc_text), "bags")
    documents, terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(
        vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    )  # at most one row a term of the block
    weights = np.array(
        [ranking.weight(documents, holding.get(i, 0)) for i in range(len(words.numbers))], np.int64
    )
    normed = vectors.filter(F.size("terms") > 0).select(
        "doc_id", ranking.norm(F.col("n"), documents, terms).alias("m"), "terms", "tfs"
    )
    classes, seed = classes_of(normed)
    # An item's best documents lie in its best classes, by score and then smallest id:
    # every class before one has at least one document before all of that one's.
    order = [F.desc("score"), F.asc_nulls_last("first_id"), F.asc("h")]
    chosen = stage(
        _leading(scored(classes, words, weights, ranking), "item", order, ranking.top), "bag-best"
    )
    # no more hashes than items times ``top``
    wanted = F.broadcast(chosen.select("h").distinct())
    members = normed.select("doc_id", bag_hash(seed).alias("h")).join(wanted, "h", "left_semi")
    first = _leading(members, "h", [F.asc_nulls_last("doc_id")], ranking.top).drop("rank")
    rows = chosen.select("item", "score", "h").join(first, "h")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("h")]
    names = spark.createDataFrame(list(enumerate(words.item_ids)), "item long, item_id long")
    return _leading(rows, "item", order, ranking.top).join(names, "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )


def search(
    docs: DataFrame,
    items: DataFrame,
    ranking: Ranking = Ranking(),
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` best of all documents.

    Only scores above 0 are listed, the highest first, equal ones by ascending id.  A null
    or empty text has no terms: such a document counts nowhere, such an item has no rows.
    Rows of ``docs`` that repeat an id are documents of their own, listed side by side; a
    null id comes after all others of its score.  Items that repeat id and text are one
    item; those that repeat an id alone are ranked apart.  Empty tables give no rows.

    Items are taken in blocks of about ``BLOCK_PAIRS`` (item, term) pairs, each block
    against all documents; a block's vocabulary is what the tasks and the driver hold.
    """
    spark = docs.sparkSession
    wanted = stage(item_bags(items, item_id, item_text), "item-bags")
    pairs = wanted.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = -(-pairs // BLOCK_PAIRS)
    block = F.pmod(F.xxhash64("item_id", "terms", "repeats"), F.lit(max(blocks, 1)))
    results = []
    for b in range(blocks):
        rows = wanted.filter(block == b).orderBy("item_id", "terms", "repeats").collect()
        if rows:
            words = Vocabulary.of(rows)
            results.append(_search_block(docs, words, ranking, doc_id, doc_text))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results)
