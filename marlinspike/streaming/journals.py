"""Journals and note folders as streams. Windows and watermarks are extensions of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlinspike.sources.journal import stamped


def tail(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of a journal folder's rows with their time ``at``; broken lines and lines without a time are left out."""
    rows = spark.readStream.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.filter("_bad is null").drop("_bad").withColumn("at", stamped(F.col("ts"))).filter("at is not null")


def once(rows: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the time rows may be late."""
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def verdict_windows(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Verdicts a day over seven days: (start, end, verdict, n)."""
    out = rows.withWatermark("at", late).groupBy(F.window("at", "7 days", "1 day"), "verdict").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "verdict", "n")


def activity(rows: DataFrame, key: str, quiet: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stretches of activity of a key with gaps under ``quiet``: (key, start, end, n)."""
    out = rows.withWatermark("at", late).groupBy(F.session_window("at", quiet), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drain(rows: DataFrame, target: str, state: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there now to Parquet and stop; a second run goes on where the first ended."""
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert(rows: DataFrame, key: str, order: str, target: str, state: str) -> StreamingQuery:
    """Keep the latest row of each key in numbered tables under ``target``, one a batch that brought rows.

    A batch is merged with the table before it; a batch that runs twice writes the
    same table again.
    """
    spark = rows.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        old = latest(spark, target, below=number)
        new = batch if old is None else old.unionByName(batch)
        fields = [c for c in new.columns if c != key]
        kept = new.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *[c for c in fields if c != order])).alias("s"))
        kept.select(key, "s.*").select(*new.columns).write.mode("overwrite").parquet(f"{target}/batch={number:012d}")

    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def latest(spark: SparkSession, target: str, below: int | None = None) -> DataFrame | None:
    """The newest complete table of an upsert."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    done = sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(where) if s.getPath().getName().startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    done = [n for n in done if below is None or n < below]
    return spark.read.parquet(f"{target}/batch={done[-1]:012d}") if done else None
