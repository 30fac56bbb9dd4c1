"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id in ``links`` (columns a, b); a component is its smallest id.

    Each round is two shuffles on ids with map-side minima; edges stay in the
    shared folder and the number of rounds grows with the logarithm of the
    number of ids.
    """
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    edges = _shared.store(links.select(hi.alias("u"), lo.alias("v")).where("u <> v").distinct(), "links")
    nodes = edges
    for _ in range(max_rounds):
        # large star: larger neighbours go to the smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _min_neighbour(both).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: smaller neighbours and the node itself go to the smallest one
        m = _min_neighbour(large)
        small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).distinct()
        edges = _shared.store(small, "links")
        # done when all edges lead to nodes that lead nowhere, one edge a node
        if edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and edges.groupBy("u").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = nodes.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return roots.join(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
