"""Connected components of an undirected graph that no task or driver holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.session import stage


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges (a, b)``: the smallest node it reaches.

    Every round links each node's larger neighbours, then its smaller ones, to the
    smallest of them; a node's neighbours are combined map-side, and what a round leaves
    is written to the shared folder.  It ends when all edges point at their label, after
    about log(n) rounds.
    """
    links = stage(_down(edges), "links")
    before = None
    while True:
        links = stage(_large(links), "links")
        links = stage(_small(links), "links")
        # Equal sums mean that a round has changed nothing.
        state = links.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
        ).first()
        if state == before:
            break
        before = state
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    heads = links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return stars.unionByName(heads)


def _down(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, once each."""
    return (
        edges.filter("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large(links: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest of it and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return (
        both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    ).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    near = links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
