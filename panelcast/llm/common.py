"""What the corpus operators share: reading documents, word rules, staging."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are runs of anything but these; ``bytes.split()`` splits at exactly them.
BLANKS = " \t\n\v\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; a null text is empty."""
    return text.encode("utf-8") if text else b""


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text under fixed names: other columns, whatever their names, stay outside."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def per_document(docs: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """One output row per document, batch by batch in the partition that holds it.

    ``make`` runs once per task and gives a function from a list of texts to a list of
    rows (without ``doc_id``); the batch size in rows is Arrow's, and a batch of very
    long texts is cut to ``PIECE`` characters of text at a time.
    """
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [_KINDS[c.split()[1]] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for ids, texts in pieces(batches):
            cols = list(zip(*work(texts), strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", *names],
            )

    return docs.mapInArrow(run, f"doc_id long, {schema}")


_KINDS = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
}
PIECE = 8_000_000


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    """(ids, texts) of bounded size; a single text may be larger than the bound."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        first = size = 0
        for i in range(batch.num_rows):
            more = texts[i].as_buffer().size if texts[i].is_valid else 0
            if size and size + more > PIECE:
                yield ids.slice(first, i - first), texts.slice(first, i - first).to_pylist()
                first, size = i, 0
            size += more
        if first < batch.num_rows:
            yield ids.slice(first), texts.slice(first).to_pylist()


def distinct(lists: list[list[str]]) -> tuple[list[str], pa.Array, np.ndarray]:
    """The distinct strings of all lists, the place of every string among them, and where
    each list begins and ends in these places."""
    found = pa.array(list(chain.from_iterable(lists)), pa.large_string()).dictionary_encode()
    # by way of numpy, as to_pylist() makes a scalar of each
    keys = found.dictionary.to_numpy(zero_copy_only=False).tolist()
    return keys, found.indices, np.cumsum([0, *map(len, lists)])


def joined(values: list[bytes], places: pa.Array, edges: np.ndarray) -> list[bytes]:
    """For each list, the values at its places in a row."""
    taken = pa.array(values, pa.large_binary()).take(places)
    _, offsets, data = taken.buffers()
    if not len(taken) or data is None:
        return [b""] * (len(edges) - 1)
    ends, data = np.frombuffer(offsets, np.int64)[edges].tolist(), memoryview(data)
    return [bytes(data[a:b]) for a, b in pairwise(ends)]


@contextmanager
def no_cycles():
    """For code that makes many objects and no cycles: does not look for cycles meanwhile."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def bounded(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about ``PIECE`` bytes of one column; a single value may be larger."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes, dtype=np.int64) // PIECE
    edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in pairwise(edges):
        if a < b:
            yield batch.slice(a, b - a)
