"""Connected components of links between node numbers: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours to its least neighbour. Small: its smaller neighbours and itself to the least one.

    The least neighbours are written first, so a hub's rows are a plain join side that can be split.
    """
    arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = stored(arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    joined = arcs.join(least, "u")
    if large:
        return joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (u, v): root is the least node that links reach.

    Nulls and loops are left out; an empty table gives none. Ends when a round changes nothing.
    """
    edges = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = stored(edges, "edges"), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or not state[0]:
            break
        before = state
        turned = stored(_star(edges, large=True).where("u > v").distinct(), "edges")
        edges = stored(_star(turned, large=False).where("u > v").distinct(), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
