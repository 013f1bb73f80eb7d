"""Parent-child links of unknown depth as nested-set ranges.

Subtree sizes are computed upward, sibling ranges are allocated by prefix sums of
those sizes, and the ranges are summed downward.  Both directions double the
distance in every round (see ``plans.pointers``), so a chain of a million nodes
takes twenty rounds, not a million.  What is unprocessed at the end hangs on a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlinspike.plans.ordered import prefix_sum
from marlinspike.plans.pointers import known_parents
from marlinspike.plans.workspace import Workspace

#: Positions are expanded in blocks of this many, so no array grows with a subtree.
BLOCK = 4096


def prepare(rows: DataFrame, key: Sequence[str], parent: Sequence[str]) -> DataFrame:
    """One row (k, p) for each key: structs of the key and of the parent's key.

    Rows whose key has a null part are left out.  A parent with any null or ''
    part counts as none.  Repeated rows count once; of several rows of one key
    that name different parents the least parent is taken.
    """
    blank = F.lit(False)
    for c in parent:
        blank = blank | F.col(c).isNull() | (F.col(c).cast("string") == "")
    k = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)])
    p = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(parent)])
    there = F.lit(True)
    for c in key:
        there = there & F.col(c).isNotNull()
    return rows.filter(there).select(k.alias("k"), F.when(~blank, p).alias("p")).groupBy("k").agg(F.min("p").alias("p"))


def subtree_sizes(nodes: DataFrame, ws: Workspace) -> DataFrame:
    """(k, a, size, open) of rows (k, p): the known parent, nodes below and at k, and if its chain never ends.

    ``size`` means nothing where ``open``.  In round i every node still pointing
    adds its count to the node 2**i above it, then doubles its pointer.
    """
    links = known_parents(nodes)
    state = nodes.select("k").join(links, "k", "left").select("k", "a", F.col("a").alias("to"), F.lit(1).cast("long").alias("size"))
    state = ws.write(state)
    count = state.filter("to is not null").count()
    while count:
        add = state.filter("to is not null").groupBy(F.col("to").alias("k")).agg(F.sum("size").alias("more"))
        grown = state.join(add, "k", "left").select("k", "a", "to", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        up = state.filter("to is not null").select(F.col("k").alias("to"), F.col("to").alias("next"))
        step = ws.write(grown.join(up, "to", "left").select("k", "a", F.col("next").alias("to"), "size"))
        now = step.filter("to is not null").count()
        ws.drop(state)
        state = step
        if now == count:
            break
        count = now
    return state.select("k", "a", "size", F.col("to").isNotNull().alias("open"))


def nested_sets(nodes: DataFrame, ws: Workspace, with_path: bool = True, label: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Hierarchy of rows (k, p), and the nodes whose chain never ends.

    ``label``: what a path shows of a node, an expression over k (default: k).  The
    first table has k, parent, root, depth, ``lo`` (preorder position over the
    whole forest), ``hi`` (last position below k), size and, if asked for, ``path``
    from the root.  All descendants of a node are the nodes with lo in (lo, hi];
    all ancestors those whose range holds its lo.  Siblings come in key order.
    """
    sized = subtree_sizes(nodes, ws)
    loops = sized.filter("open").select("k")
    tree = sized.filter(~F.col("open")).select("k", "a", "size")
    placed = prefix_sum(tree, ["a"], ["k"], "size", "shift", ws)  # roots are the group of null
    step = F.when(F.col("a").isNull(), F.col("shift")).otherwise(F.col("shift") + 1)
    state = placed.select("k", "a", "size", F.col("a").alias("to"), step.alias("lo"), F.lit(0).cast("long").alias("depth"), F.col("k").alias("top"), *([F.array(F.col("k") if label is None else label).alias("path")] if with_path else []))
    state = ws.write(state.withColumn("depth", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long")))
    keep = ["k", "a", "size"]
    while state.filter("to is not null").limit(1).count():
        up = state.select(F.col("k").alias("to"), F.col("to").alias("_to"), F.col("lo").alias("_lo"), F.col("depth").alias("_depth"), F.col("top").alias("_top"), *([F.col("path").alias("_path")] if with_path else []))
        j = state.join(up, "to", "left")
        ends = F.col("_top").isNull()
        new = [
            F.col("_to").alias("to"),
            (F.col("lo") + F.coalesce("_lo", F.lit(0))).alias("lo"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.when(ends, F.col("top")).otherwise(F.col("_top")).alias("top"),
        ]
        if with_path:
            new.append(F.when(ends, F.col("path")).otherwise(F.concat("_path", "path")).alias("path"))
        nxt = ws.write(j.select(*keep, *new))
        ws.drop(state)
        state = nxt
    out = state.select("k", F.col("a").alias("parent"), F.col("top").alias("root"), "depth", "lo", (F.col("lo") + F.col("size") - 1).alias("hi"), "size", *(["path"] if with_path else []))
    return out, loops


def descendants(sets: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every pair of a hierarchy.

    A subtree is a contiguous range of positions, so its members are found by an
    equi-join on position; each position occurs once, so no key is hot.
    """
    wide = sets.filter("hi > lo").select(F.col("k").alias("ancestor"), F.col("depth").alias("_depth"), "lo", "hi")
    blocks = wide.withColumn("_b", F.explode(F.sequence(F.floor((F.col("lo") + 1) / BLOCK), F.floor(F.col("hi") / BLOCK))))
    first = F.greatest(F.col("lo") + 1, F.col("_b") * BLOCK)
    last = F.least(F.col("hi"), (F.col("_b") + 1) * BLOCK - 1)
    at = blocks.select("ancestor", "_depth", F.explode(F.sequence(first, last)).alias("lo"))
    own = sets.select("lo", F.col("k").alias("descendant"), "depth")
    return at.join(own, "lo").select("ancestor", "descendant", (F.col("depth") - F.col("_depth")).alias("distance"))
