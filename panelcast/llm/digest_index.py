"""Exact dedup on a persistent digest index.

The index is a Parquet table ``(digest, keep_id, group_size)``, bucketed and sorted by
``digest``.  New rows are reduced to one row per digest, matched with the index by a
sort-merge anti-join whose index side needs no exchange, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.common import narrow
from panelcast.session import scratch_dir, stage

# A digest with more than this share of the rows is joined by broadcast: there are
# fewer than 1 / HOT_SHARE such digests, whatever the input.
HOT_SHARE = 0.001


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest``: SHA-256 of the whole text; null counts as the empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return narrow(docs, id_col, text_col).select(
        "doc_id", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
    )


def groups(hashed: DataFrame) -> DataFrame:
    """One row per digest: the largest id and the number of rows, combined map-side.

    Written out, as the optimizer would else move the anti-join below the aggregate and
    shuffle every row of a large group of copies.
    """
    each = hashed.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    return stage(each, "digest-groups")


class DigestIndex:
    """The index in the folder ``path``; it outlives the session.

    ``open`` finds an index that an earlier session wrote: the number of buckets must be
    the one it was made with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{path}'"
        )

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int) -> DigestIndex:
        return cls(spark, path, buckets)

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def fresh(self, batch: DataFrame) -> DataFrame:
        """Rows of ``batch`` (unique digests) that the index lacks."""
        return batch.hint("merge").join(self.table.select("digest"), "digest", "left_anti")

    def append(self, batch: DataFrame) -> None:
        """Add what is new; a digest that is there keeps its ``keep_id``.

        The new rows are written to the scratch folder first: an append never reads the
        files that it adds to, and a lost executor repeats only its own task.
        """
        new = stage(self.fresh(batch), "fresh-digests")
        (
            new.select("digest", "keep_id", "group_size")
            .repartition(self.buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def keepers(hashed: DataFrame, index: DigestIndex) -> DataFrame:
    """Every row of ``hashed`` with ``keep_id`` and ``group_size`` of its digest.

    Digests with a large share of the rows, of bounded number, meet their rows by
    broadcast, so that no task takes a whole group; the others by sort-merge on buckets.
    """
    table = index.table
    total = table.agg(F.sum("group_size")).first()[0] or 0
    hot = table.filter(F.col("group_size") > max(1000, total * HOT_SHARE))
    cold = hashed.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    return hashed.join(F.broadcast(hot), "digest").unionByName(
        cold.hint("merge").join(table, "digest")
    )


def exact_dedup(
    docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Verdict per row of ``docs`` after adding it to ``index``.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``.  Of equal texts the row
    with the largest id stays; one in the index from an earlier call stays before any new
    row, and ``group_size`` is that of the batch that brought the digest.  Null and empty
    texts are one group.  Rows that repeat id and text share one verdict; a null id stays
    only where its group has no other.  An empty table gives no rows.
    """
    hashed = stage(digests(docs, id_col, text_col), "digests")
    index.append(groups(hashed))
    return keepers(hashed, index).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared scratch folder."""
    return DigestIndex(spark, scratch_dir(spark, "digest-index"), buckets)


def drop_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """``docs`` with all its columns, without rows that lose to an equal text.

    The join key is digest and id, so a large group of copies spreads over all tasks.
    """
    hashed = stage(digests(docs), "digests")
    index.append(groups(hashed))
    names = docs.columns
    key = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))
    marked = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), key.alias("digest"))
    kept = index.table.select("digest", F.col("keep_id").alias("id"))
    same = (marked["digest"] == kept["digest"]) & marked["row"]["doc_id"].eqNullSafe(kept["id"])
    return marked.join(kept, same, "left_semi").select("row.*")
