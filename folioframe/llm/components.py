"""Connected components of a graph given as a table of edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash


def _ranked(col: str) -> Column:
    """A node with a random-like rank in front, so that chains of ascending nodes stay short."""
    return F.struct(F.xxhash64(F.col(col)).alias("rank"), F.col(col).alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``a, b``); equal roots mean connected.

    Each round sends every node to its lowest-ranked neighbour (or itself) and replaces the ends of
    each edge by where they went; the edge to that neighbour keeps the two connected. Edges, maps
    and answers stay in Spark, written to the shared folder after each round. Self-loops and repeated
    edges do no harm; no edges give no rows; edges with a null end are ignored.
    """
    spark = edges.sparkSession
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    maps = []
    while True:
        edges = stash(edges, "edges")
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        to = stash(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min(_ranked("b")).alias("low"))
            .select("node", F.least("low", _ranked("node"))["node"].alias("to")),
            "contraction",
        )
        maps.append(to)
        left, right = to.toDF("a", "a2"), to.toDF("b", "b2")
        edges = (
            edges.join(left, "a")
            .join(right, "b")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .where("a <> b")
            .distinct()
        )
    if not maps:
        return spark.createDataFrame([], "node long, root long")
    rooted = maps[-1].toDF("node", "root")
    for to in reversed(maps[:-1]):
        after = rooted.toDF("to", "root")
        rooted = to.join(after, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return rooted
