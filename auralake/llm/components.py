"""Connected components of a graph in a table, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.session import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node it is linked to through any path.

    Each step is two group-bys and joins of the edges, partially aggregated, and leaves a hub's edges spread over its
    neighbours; a few steps suffice for any graph, as trees halve in depth. Steps are checkpointed, nothing is collected.
    Edges from a node to itself keep the node; null ends are left out; no edges give no rows.
    """
    shared_dir(edges.sparkSession)
    ends = edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = ends.distinct().checkpoint()
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = links.filter("a > b")
    state = None
    while True:
        # Large star: of a node's neighbours, those above it go to the least of all.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        links = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the node and its neighbours below it go to the least of them.
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        links = links.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a > b").distinct().checkpoint()
        # Edges are unchanged when their number and the sums of both ends' hashes are.
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    return nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def spanning_forest(adjacent: np.ndarray) -> np.ndarray:
    """Each row's smallest linked row number, through any path, in a symmetric boolean matrix."""
    n = len(adjacent)
    root = np.full(n, -1, dtype=np.int64)
    for i in np.nonzero(adjacent.any(axis=1))[0]:
        if root[i] >= 0:
            continue
        member = np.zeros(n, dtype=bool)
        front = np.array([i])
        member[i] = True
        while len(front):
            new = adjacent[front].any(axis=0) & ~member
            member |= new
            front = np.nonzero(new)[0]
        root[member] = i
    return root
