"""Health of a note collection: totals, islands, stale notes, feedback."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlinspike.functions import text as T
from marlinspike.operators.components import components
from marlinspike.plans.workspace import Workspace

#: Verdicts a feedback row may have, types that can go stale, report sizes.
VERDICTS = ("saved-work", "noise", "false-note", "proven-miss", "rejected")
STALE_TYPES = ("atom", "molecule", "godnote", "source")
STALE_DAYS, LISTED = 60, 50


def by_type(notes: DataFrame) -> DataFrame:
    """(type, n), null as ''."""
    return notes.groupBy(F.coalesce("type", F.lit("")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def totals(notes: DataFrame, chunks: DataFrame, links: DataFrame) -> DataFrame:
    """One row: notes, chunks, links."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(notes, "notes").join(F.broadcast(n(chunks, "chunks"))).join(F.broadcast(n(links, "links")))


def component_sizes(notes: DataFrame, edges: DataFrame, ws: Workspace) -> DataFrame:
    """(component, size): connected parts of the notes (note_id) by the links (src, dst), the least note id naming each."""
    return _placed(notes, edges, ws).groupBy(F.col("island").alias("component")).agg(F.count(F.lit(1)).alias("size"))


def _placed(notes: DataFrame, edges: DataFrame, ws: Workspace) -> DataFrame:
    ids = notes.select("note_id")
    known = edges.join(ids.select(F.col("note_id").alias("src")), "src", "left_semi").join(ids.select(F.col("note_id").alias("dst")), "dst", "left_semi")
    part = components(known.select(F.col("src").alias("u"), F.col("dst").alias("v")), ws)
    return notes.join(part.withColumnRenamed("id", "note_id"), "note_id", "left").withColumn("island", F.coalesce("component", "note_id")).drop("component")


def islands(notes: DataFrame, edges: DataFrame, ws: Workspace) -> DataFrame:
    """(island, size, title, path, note_id): notes cut off from the largest component.

    notes: (note_id, title, path); edges: (src, dst).  A note without links is an
    island of one.  Of components of equal size the one with the least note id is
    home.  ``island`` is the least note id of the component.
    """
    placed = _placed(notes.select("note_id", "title", "path"), edges, ws)
    sizes = placed.groupBy("island").agg(F.count(F.lit(1)).alias("size"))
    home = sizes.orderBy(F.desc("size"), "island").limit(1).select("island")
    return placed.join(sizes, "island").join(F.broadcast(home), "island", "left_anti").select("island", "size", "title", "path", "note_id")


def stale(notes: DataFrame, today: datetime.date, days: int = STALE_DAYS) -> DataFrame:
    """(title, path, age_days) of the notes of dated types last touched more than ``days`` ago.

    The later of date and reviewed counts; a note without a valid date is never stale.
    """
    age = F.datediff(F.lit(today), T.last_touched(F.col("date"), F.col("reviewed")))
    return notes.filter(F.col("type").isin(*STALE_TYPES)).select("title", "path", age.alias("age_days")).filter(F.col("age_days") > days)


def feedback(rows: DataFrame, now: datetime.datetime, verdicts: tuple[str, ...] = VERDICTS) -> DataFrame:
    """(verdict, total, last_7_days) of rows (ts, verdict): every verdict, with 0 where it has none.

    Rows of a null time or an unknown verdict are left out.
    """
    spark = rows.sparkSession
    known = spark.createDataFrame([(v,) for v in verdicts], "verdict string")
    start = F.lit(now - datetime.timedelta(days=7))
    counts = rows.filter(F.col("ts").isNotNull() & F.col("verdict").isin(*verdicts)).groupBy("verdict").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ts") >= start).alias("last_7_days"))
    return F.broadcast(known).join(counts, "verdict", "left").select("verdict", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("last_7_days", F.lit(0)).alias("last_7_days"))


def misses_due(rows: DataFrame, least: int = 3) -> DataFrame:
    """One row (n, due): proven misses and whether there are enough for a review."""
    return rows.agg(F.count_if(F.col("verdict") == "proven-miss").alias("n")).withColumn("due", F.col("n") >= least)


def island_list(rows: DataFrame, limit: int = LISTED) -> DataFrame:
    """The largest islands of rows (island, size, title, path): (place, size, members, islands, notes).

    Largest first, then by the title of the first member; members by title and path.
    ``islands`` and ``notes`` count all there are.
    """
    first = rows.groupBy("island").agg(F.max("size").alias("size"), F.min(F.struct(F.coalesce("title", F.lit("")).alias("t"), "path")).alias("first"))
    every = first.agg(F.count(F.lit(1)).alias("islands"), F.coalesce(F.sum("size"), F.lit(0)).alias("notes"))
    top = first.orderBy(F.desc("size"), "first", "island").limit(limit)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "first", "island")))  # at most ``limit`` rows
    member = F.struct(F.coalesce("title", F.lit("")).alias("title"), "path")
    members = rows.join(F.broadcast(top.select("island")), "island", "left_semi").groupBy("island").agg(F.array_sort(F.collect_list(member)).alias("members"))
    return placed.join(members, "island").join(F.broadcast(every)).select("place", "size", "members", "islands", "notes")


def counted(rows: DataFrame, order: list, limit: int = LISTED) -> DataFrame:
    """The first rows of a report list with ``n_all``, how many there are."""
    every = rows.agg(F.count(F.lit(1)).alias("n_all"))
    return rows.orderBy(*order).limit(limit).join(F.broadcast(every))


def report(notes: DataFrame, chunks: DataFrame, links: DataFrame, verdicts: DataFrame, today: datetime.date, now: datetime.datetime, ws: Workspace) -> DataFrame:
    """(section, item, n): the numbers of a health report, of resolved links (src, dst_name, dst)."""
    row = lambda section, df, item, n: df.select(F.lit(section).alias("section"), item.alias("item"), n.cast("long").alias("n"))
    one = lambda section, name, df: row(section, df.agg(F.count(F.lit(1)).alias("n")), F.lit(name), F.col("n"))
    cut_off = ws.write(islands(notes, links.filter("dst is not null"), ws))
    out = row("type", by_type(notes), F.col("type"), F.col("n"))
    for part in (
        one("totals", "notes", notes), one("totals", "chunks", chunks), one("totals", "links", links), one("islands", "islands", cut_off.select("island").distinct()), one("islands", "notes", cut_off),
        one("broken_links", "links", links.filter("dst is null").join(notes.select(F.col("note_id").alias("src")), "src", "left_semi")), one("stale", "notes", stale(notes, today)),
        row("feedback", feedback(verdicts, now), F.col("verdict"), F.col("total")),
    ):
        out = out.unionByName(part)
    return out


def listed(rows: DataFrame, *order: str, limit: int = LISTED) -> DataFrame:
    """The first rows of a report list."""
    return rows.orderBy(*order).limit(limit)


def duplicates(chunks: DataFrame) -> DataFrame:
    """(hash, n, first_id): bodies that stand in several chunks (chunk_id, body)."""
    h = chunks.filter("body is not null").select("chunk_id", F.sha2("body", 256).alias("hash")).distinct()
    return h.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("first_id")).filter("n > 1")


def top_by(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group; the engine keeps n a task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)
