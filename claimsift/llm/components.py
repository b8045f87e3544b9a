"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step keeps the components and brings each node nearer to the smallest node it can reach. Steps are joins and
partial aggregates, so a node with very many neighbours is never gathered. Each step is checkpointed, in a number of files
that follows the number of edges, so that few edges are not dealt to as many tasks as the session has partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimsift.llm.common import cut

#: Edges that a step writes to a file.
EDGES_IN_FILE = 1 << 17


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come with u > v."""
    smallest = _smallest(edges)
    to_smallest = edges.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_smallest.unionByName(smallest.select("u", F.col("m").alias("v"))).filter("u <> v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges(u, v)`` that is not itself the smallest.

    Edges may repeat, stand in either direction, or join a node to itself; an empty table gives an empty table. Nulls
    are no nodes: edges with a null end are ignored.
    """
    now = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .distinct()
    )
    # greatest() and least() skip nulls, so an edge with a null end has become a loop and is gone
    before, state = None, _state(now)
    files = -(-state[0] // EDGES_IN_FILE) or 1  # no step adds edges
    now = now.coalesce(files)
    while state != before:
        now = cut(_large_star(now).distinct().coalesce(files))
        now = cut(_small_star(now).distinct().coalesce(files))
        before, state = state, _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
