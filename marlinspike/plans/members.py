"""Pairs of the members of groups, for results that are defined as pairs.

A group that holds a third of all rows is cut into blocks of bounded size; each pair
of blocks is one join key, so no task meets more than two blocks, and a member is
copied once for each block of its group.  Groups with the same members count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlinspike.plans.workspace import Workspace

#: Members of one block; large groups that are broadcast, beyond which their rows are dealt into SALTS parts.
BLOCK, BROADCAST_GROUPS, SALTS = 512, 100_000, 32


def distinct_groups(rows: DataFrame, group: Sequence[str], ws: Workspace, unique: bool = False) -> DataFrame:
    """(g, id, n) of rows (group columns, id): one group of each set of members with its size n, those of one member left out.

    Sets are told apart by their size and two exclusive-or sums of member hashes.
    ``unique``: no row stands twice.
    """
    key = F.col(group[0]) if len(group) == 1 else F.struct(*group)
    one = rows.select(key.alias("g"), "id").filter("id is not null")
    one = one if unique else one.distinct()
    marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("h2")]
    kept = ws.write(one.groupBy("g").agg(*marks).filter("n > 1").groupBy("n", "h1", "h2").agg(F.min("g").alias("g")).select("g", "n"))
    large = kept.filter(F.col("n") > BLOCK)
    many = large.limit(BROADCAST_GROUPS + 1).count()
    if not many:
        return one.join(kept, "g")
    if many <= BROADCAST_GROUPS:
        marked = one.join(F.broadcast(large), "g", "left")
    else:
        spread = large.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        marked = one.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).join(spread, ["g", "_salt"], "left").drop("_salt")
    small = marked.filter("n is null").drop("n").join(kept.filter(F.col("n") <= BLOCK), "g")
    return marked.filter("n is not null").select("g", "id", "n").unionByName(small.select("g", "id", "n"))


def member_pairs(rows: DataFrame, group: Sequence[str], ws: Workspace, unique: bool = False) -> DataFrame:
    """Distinct (a, b), a < b, of the ids that share a group; rows (group columns, id)."""
    sized = ws.write(distinct_groups(rows, group, ws, unique))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = sized.withColumn("b", F.pmod(F.xxhash64(F.lit(2), "id"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = dealt.select("g", "id", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    left = placed.filter("b = i").select("g", "i", "j", F.col("id").alias("a"))
    right = placed.filter("b = j").select("g", "i", "j", F.col("id").alias("b"))
    met = left.join(right, ["g", "i", "j"]).filter("a <> b and (i < j or a < b)")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
