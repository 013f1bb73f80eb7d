"""Pointer jumping over parent links: chains of any depth in logarithmic rounds.

Round k turns pointers over 2**k parents into pointers over 2**(k+1).  A node
whose chain ends runs out of pointers after log2(depth) rounds; a node on or
below a loop never does.  While any chain is still to end, some node of it loses
its pointer in the next round (the ancestor at depth 2**k); so the number of
pointers stays equal from one round to the next exactly when only loops are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlinspike.plans.workspace import Workspace


def known_parents(nodes: DataFrame) -> DataFrame:
    """From rows (k, p) with unique k: rows (k, a) where the parent p is a node."""
    keys = nodes.select(F.col("k").alias("a"))
    links = nodes.filter(F.col("p").isNotNull()).select("k", F.col("p").alias("a"))
    return links.join(keys, "a", "left_semi").select("k", "a")


def jump_tables(nodes: DataFrame, ws: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the 2**0-th, 2**1-th, ... ancestor, and the nodes that never end.

    ``nodes`` has unique k and the parent's key p (null or unknown: a root).  Table
    i holds (k, a) for every node that has a 2**i-th ancestor.
    """
    tables = [ws.write(known_parents(nodes))]
    count = tables[0].count()
    while count:
        last = tables[-1]
        up = last.select(F.col("k").alias("a"), F.col("a").alias("b"))
        step = ws.write(last.join(up, "a").select("k", F.col("b").alias("a")))
        now = step.count()
        if now == count:
            return tables, step.select("k")
        tables.append(step)
        count = now
    return tables[:-1], tables[-1].select("k")


def expand_chains(starts: DataFrame, tables: list[DataFrame], ws: Workspace | None = None) -> DataFrame:
    """From rows with a node n: a row for each node of the chain up from n.

    Adds ``d``, the number of steps from the start; ``n`` becomes the node there.
    Starts must end (none of the nodes that never do).  One row is one node of one
    chain, so a long chain is spread over tasks by its nodes.  With a workspace the
    rows are written after every third join, which keeps each plan small.
    """
    rows = starts.withColumn("d", F.lit(0).cast("long"))
    for i, table in enumerate(tables):
        up = table.select(F.col("k").alias("n"), F.col("a").alias("_a"))
        both = F.array(F.struct(F.col("n"), F.col("d")), F.struct(F.col("_a").alias("n"), (F.col("d") + F.lit(1 << i)).alias("d")))
        one = F.array(F.struct(F.col("n"), F.col("d")))
        rows = rows.join(up, "n", "left").withColumn("_s", F.explode(F.when(F.col("_a").isNull(), one).otherwise(both)))
        rows = rows.select(*[c for c in rows.columns if c not in ("n", "d", "_a", "_s")], "_s.n", "_s.d")
        if ws and i % 3 == 2:
            rows = ws.write(rows)
    return rows
