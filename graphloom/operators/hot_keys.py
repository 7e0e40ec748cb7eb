"""Per-node results over edges of which a few nodes hold most entries.

Method: map-side combining. Every per-node state here (a count, a bounded chunk
of a sorted list) is mergeable, so Spark's own partial aggregation builds
bounded hash tables next to the data, spills them when full, and shuffles only
the compact partial states: a hot node costs one partial row per task. Lists
that cannot be combined (adjacency rows) are cut into chunks by a range
partitioning over node *and* neighbour, so that the entries of one node spread
over as many tasks as they need.

Rules shared by all functions: rows of the same ``edge_id`` are one edge, of
which the row with the latest ``loaded_at`` counts (ties: the largest src, dst,
type); rows without ``edge_id`` cannot be told apart and are left out; an entry
needs a node, so a null endpoint has no entry on its side but the edge still
counts; a null ``edge_type`` is a type of its own. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.durable import materialize, running_total


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row ``(edge_id, src, dst, edge_type)`` per edge."""
    newest = F.max(F.struct("loaded_at", "src", "dst", "edge_type")).alias("e")
    return (
        edges.where(F.col("edge_id").isNotNull())
        .groupBy("edge_id")
        .agg(newest)
        .select("edge_id", "e.src", "e.dst", "e.edge_type")
    )


def entries(edges: DataFrame) -> DataFrame:
    """Both adjacency entries of each distinct edge: ``(side, edge_type, node, other, edge_id)``."""
    ends = F.inline(
        F.array(
            F.struct(F.lit("out").alias("side"), F.col("src").alias("node"), F.col("dst").alias("other")),
            F.struct(F.lit("in").alias("side"), F.col("dst").alias("node"), F.col("src").alias("other")),
        )
    )
    return distinct_edges(edges).select("edge_id", "edge_type", ends).select("side", "edge_type", "node", "other", "edge_id")


def _counts(edges: DataFrame) -> DataFrame:
    return entries(edges).groupBy("side", "edge_type", "node").agg(F.count(F.lit(1)).alias("entries"))


def entry_counts(edges: DataFrame) -> DataFrame:
    """``(side, edge_type, node, entries)`` for every node with entries."""
    return _counts(edges).where(F.col("node").isNotNull())


def hot_nodes(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """``(side, edge_type, node, entries)`` of nodes whose entries are at least `share` of all distinct edges."""
    counts = _counts(edges)
    # Each edge has exactly one row on its out side, the null node included. The quotient is compared, since it is
    # rounded to the nearest double as the share is: 7 of 700 are exactly 0.01, but 0.01 * 700 is more than 7.
    total = counts.where(F.col("side") == "out").agg(F.sum("entries").alias("n"))
    return counts.where(F.col("node").isNotNull() & (F.col("entries") / total.scalar() >= F.lit(share)))


def sorted_adjacency(edges: DataFrame, chunk: int = 4096) -> DataFrame:
    """Typed sorted adjacency rows in chunks of at most `chunk` entries.

    ``(side, edge_type, node, chunk_no, adj array<struct<other, edge_id>>)``: the
    chunks of a node in order of `chunk_no` concatenate to its entries sorted by
    (other, edge_id), all but the last full; entries with a null other end come first.
    """
    key = ["side", "edge_type", "node"]
    all_entries = materialize(entries(edges).where(F.col("node").isNotNull()).withColumn("_one", F.lit(1)))
    placed = running_total(all_entries, key, ["other", "edge_id"], "_one", "_pos")
    return (
        placed.withColumn("chunk_no", F.floor((F.col("_pos") - 1) / chunk).cast("int"))
        .groupBy(*key, "chunk_no")
        .agg(F.array_sort(F.collect_list(F.struct("other", "edge_id"))).alias("adj"))
    )
