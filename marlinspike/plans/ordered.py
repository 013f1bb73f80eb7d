"""Order-dependent computations that never put one group into one task.

Rows are range-partitioned by (group, order), so a group of any size is cut into
pieces of about equal size.  Each piece is scanned by itself; what a piece needs
from the pieces before or after it is one row a piece, of which there are at
most twice as many as partitions for groups that span several pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlinspike.plans.workspace import Workspace

PIECE = "_piece"


def in_pieces(df: DataFrame, group: Sequence[str], order: Sequence[str], ws: Workspace, partitions: int | None = None) -> DataFrame:
    """``df`` with the number of its range partition, written once so that it stays."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *group, *order)
    return ws.write(cut.withColumn(PIECE, F.spark_partition_id()))


def _spanning(pieces: DataFrame, group: Sequence[str]) -> DataFrame:
    """Of the pieces of each group, those of groups that have several."""
    return pieces.withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(*group))).filter("_of > 1").drop("_of")


def prefix_sum(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str, ws: Workspace) -> DataFrame:
    """Exclusive running sum of ``value`` inside each group, in the given order.

    ``order`` must be unique inside a group.  Null values count as 0; null group
    keys form a group of their own.
    """
    rows = in_pieces(df, group, order, ws)
    v = F.coalesce(F.col(value), F.lit(0))
    inside = Window.partitionBy(*group, PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn(out, F.coalesce(F.sum(v).over(inside), F.lit(0)))
    totals = _spanning(rows.groupBy(*group, PIECE).agg(F.sum(v).alias("_sum")), group)
    before = Window.partitionBy(*group).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.withColumn("_base", F.sum("_sum").over(before)).filter(F.col("_base").isNotNull()).drop("_sum")
    return _join_pieces(local, base, group).withColumn(out, F.col(out) + F.coalesce("_base", F.lit(0))).drop("_base", PIECE)


def next_value(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str, ws: Workspace) -> DataFrame:
    """``value`` of the following row of the group (null at its end).

    ``order`` must be unique inside a group.
    """
    rows = in_pieces(df.withColumn("_value", F.struct(value.alias("v"))), group, order, ws)
    local = rows.withColumn("_next", F.lead("_value").over(Window.partitionBy(*group, PIECE).orderBy(*order)))
    firsts = _spanning(rows.groupBy(*group, PIECE).agg(F.min_by("_value", F.struct(*order)).alias("_first")), group)
    base = firsts.withColumn("_base", F.lead("_first").over(Window.partitionBy(*group).orderBy(PIECE))).drop("_first")
    got = F.coalesce("_next", "_base")["v"]
    return _join_pieces(local, base, group).withColumn(out, got).drop("_base", "_next", "_value", PIECE)


def _join_pieces(rows: DataFrame, base: DataFrame, group: Sequence[str]) -> DataFrame:
    """Left join of the rows a piece gets from outside; at most two a partition, so broadcast."""
    right = base.select(*[F.col(c).alias(f"_r_{c}") for c in (*group, PIECE)], "_base")
    on = [rows[c].eqNullSafe(right[f"_r_{c}"]) for c in (*group, PIECE)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return rows.join(F.broadcast(right), cond, "left").drop(*[f"_r_{c}" for c in (*group, PIECE)])
