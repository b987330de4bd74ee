"""Distributed connected components by alternating large-star and small-star steps.

Every step is one shuffle and keeps each edge list no longer than the input's,
whatever the shape of the graph; the number of steps grows with the logarithm
of the nodes.  Each step's edges are written to the shared folder, so lineage
doesn't grow and a lost executor costs one step's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleloom.llm.storage import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours to the least node of the neighbourhood (edges have u > v).

    Large star: the neighbours greater than the node.  Small star: those less
    than it, and the node itself.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select("u", "v")
    least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
    linked = both.withColumn("least", least)
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = linked.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
            linked.select("u", F.col("least").alias("v"))
        )
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component) of every node that some edge of ``edges`` (src, dst) joins to another.

    A component's name is its least node.  Nulls, loops, repeated edges and
    either direction are allowed; an empty table gives an empty one.  Nodes
    may be any ordered type.
    """
    e = (
        edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e = materialize(e, "edges")
    mark = None
    for _ in range(max_steps):
        e = materialize(_star(_star(e, True), False), "edges")
        # The edges are final when all are (node, least of component): a node then has one edge, and no root has any.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"connected components did not settle within {max_steps} steps")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
