"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlinspike.plans.workspace import Workspace


def _mark(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges: rounds stop when it stays."""
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component) of every end of rows (u, v); the component is its least id.

    Edges have no direction; loops, repeats and null ends are left out (a node with
    only a loop is not listed).  Each round links nodes to the least neighbour they
    know, first from above, then from below, and needs one aggregation and one join
    on node; the number of rounds grows with the logarithm of the path lengths.
    No edges: no rows.
    """
    e = edges.filter(F.col("u") != F.col("v"))
    e = ws.write(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(e.join(low.select(F.col("u"), "m"), "u").filter("m <> u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u")
        down = star.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = ws.write(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        ws.drop(e)
        e, before = nxt, mark
        mark = _mark(e)
        if mark == before:
            break
    own = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own)
