"""References to records that are absent, were removed, or came later.

Integer keys: the sorted parent keys are compressed into contiguous runs, every
referenced key is matched as-of to the preceding run start, and a key beyond the
run's end is an orphan.  A run also carries the latest arrival of its keys, so
only references seen before that need their parent's own arrival time.  Text
names have no order that runs could use; they are folded and matched by equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Runs and references are matched inside blocks of this many key values, so the
#: rows of one window are bounded by it whatever the tables hold.
KEY_BLOCK = 1 << 14
#: What a null arrival counts as.
ALWAYS = "0001-01-01"


def fold(name: Column) -> Column:
    """Case folding of the JVM: upper, then lower, so that one upper form is one name."""
    return F.lower(F.upper(name))


def key_runs(parents: DataFrame) -> DataFrame:
    """Runs (block, start, end, latest) of contiguous integer keys of rows (key, arrived).

    A run ends at a gap or at the end of its block.  Null keys are left out; a key
    that occurs several times counts from its first arrival; a null arrival counts
    as always there.
    """
    keys = parents.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.coalesce("arrived", F.lit(ALWAYS).cast("timestamp"))).alias("arrived"))
    keys = keys.withColumn("block", F.floor(F.col("key") / KEY_BLOCK))
    nth = F.row_number().over(Window.partitionBy("block").orderBy("key"))
    runs = keys.withColumn("island", F.col("key") - nth).groupBy("block", "island")
    return runs.agg(F.min("key").alias("start"), F.max("key").alias("end"), F.max("arrived").alias("latest")).drop("island")


def match_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """As-of match of rows with a unique ``key``: adds ``found`` and the run's ``latest``."""
    cols = [c for c in keys.columns if c != "key"]
    refs = keys.select("key", F.floor(F.col("key") / KEY_BLOCK).alias("block"), F.lit(1).alias("_ref"), F.lit(None).cast("struct<end:bigint,latest:timestamp>").alias("_run"), F.struct("key", *cols).alias("_row"))
    starts = runs.select(F.col("start").alias("key"), "block", F.lit(0).alias("_ref"), F.struct("end", "latest").alias("_run"), F.lit(None).cast(refs.schema["_row"].dataType).alias("_row"))
    asof = F.last("_run", ignorenulls=True).over(Window.partitionBy("block").orderBy("key", "_ref").rowsBetween(Window.unboundedPreceding, 0))
    got = starts.unionByName(refs).withColumn("_run", asof).filter("_ref = 1")
    found = F.coalesce(F.col("key") <= F.col("_run.end"), F.lit(False))
    return got.select("_row.*", found.alias("found"), F.when(found, F.col("_run.latest")).alias("latest"))


def orphan_keys(refs: DataFrame, parents: DataFrame, removed: DataFrame) -> DataFrame:
    """Faulty references by integer key.

    refs: (ref_id, key, seen); parents: (key, arrived); removed: (key).  Returns
    (ref_id, seen, fault), fault 'removed', 'absent' or 'later'.  References of a
    null key are left out; a null ``seen`` is never 'later'.  References are first
    reduced to one row a key, so a key that holds a third of them costs no more
    than any other until its faulty references are picked out, which is a join
    that sends only faulty keys.
    """
    keyed = refs.filter(F.col("key").isNotNull())
    keys = keyed.groupBy("key").agg(F.min("seen").alias("first_seen"))
    matched = match_runs(keys, key_runs(parents))
    gone = removed.filter(F.col("key").isNotNull()).select("key").distinct().withColumn("_gone", F.lit(True))
    missing = matched.filter(~F.col("found")).join(gone, "key", "left").select("key", F.when(F.col("_gone"), "removed").otherwise("absent").alias("fault"), F.lit(None).cast("timestamp").alias("arrived"))
    early = matched.filter(F.col("found") & (F.col("first_seen") < F.col("latest"))).select("key", "first_seen")
    arrived = parents.groupBy("key").agg(F.min(F.coalesce("arrived", F.lit(ALWAYS).cast("timestamp"))).alias("arrived"))
    late = early.join(arrived, "key").filter(F.col("first_seen") < F.col("arrived")).select("key", F.lit("later").alias("fault"), "arrived")
    bad = missing.unionByName(late)
    hit = keyed.join(bad, "key").filter(F.col("arrived").isNull() | (F.col("seen") < F.col("arrived")))
    return hit.select("ref_id", "seen", "fault")


def orphan_names(refs: DataFrame, claims: DataFrame, removed: DataFrame) -> DataFrame:
    """Faulty references by text name, ignoring case.

    refs: (ref_id, name, seen); claims: (name, arrived), several a record, several
    records a name; removed: (name).  A reference is at fault if nobody claims its
    name, or every claimant arrived after it was seen.  A null name is claimed by
    nobody.  Names are reduced to one row each on both sides before they meet.
    """
    named = refs.select("ref_id", fold(F.col("name")).alias("name"), "seen")
    names = named.groupBy("name").agg(F.min("seen").alias("first_seen"))
    first = claims.filter(F.col("name").isNotNull()).groupBy(fold(F.col("name")).alias("name")).agg(F.min(F.coalesce("arrived", F.lit(ALWAYS).cast("timestamp"))).alias("arrived"))
    gone = removed.filter(F.col("name").isNotNull()).select(fold(F.col("name")).alias("name")).distinct().withColumn("_gone", F.lit(True))
    met = names.join(first, "name", "left").join(gone, "name", "left")
    fault = F.when(F.col("arrived").isNull(), F.when(F.col("_gone"), "removed").otherwise("absent")).when(F.col("first_seen") < F.col("arrived"), "later")
    bad = met.withColumn("fault", fault).filter(F.col("fault").isNotNull()).select("name", "fault", "arrived")
    hit = named.join(bad, named["name"].eqNullSafe(bad["name"])).filter(F.col("arrived").isNull() | (F.col("seen") < F.col("arrived")))
    return hit.select("ref_id", "seen", "fault")


def report(faults: DataFrame) -> DataFrame:
    """Counts per kind of reference, fault and month of ``seen``."""
    month = F.date_format("seen", "yyyy-MM")
    return faults.groupBy("kind", "fault", month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
