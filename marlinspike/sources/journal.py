"""Append-only JSON-lines journals; a broken line loses only itself."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.functions import text as T
from marlinspike.operators.health import VERDICTS

#: Where an audit candidate may go.
DESTINATIONS = ("vault", "repo rules", "runbook", "nowhere")
FEEDBACK = "ts string, verdict string, query string, notes array<string>, note string"
CANDIDATES = "ts string, session_id string, candidate string, destination string, kind string, outcome string"
CLOSED = "key string, thread string, reason string, closed string"
SESSIONS = "session_id string, path string, reason string, ts string"
QUERIES = "ts string, cwd string, raw string, query string, weak_match boolean, semantic string, top array<struct<path:string,found_by:string>>, n_fragments long"


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a journal, plain or compressed; lines that are no JSON object of the schema are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.filter("_bad is null").drop("_bad")


def stamped(ts) -> object:
    """Time of an ISO string column, UTC where it names no zone; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(ts, "Z$", "+00:00"))


def check_feedback(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid feedback rows, and the others with the first ``problem``."""
    problem = (
        F.when(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)), "verdict")
        .when(F.trim(F.coalesce("query", F.lit(""))) == "", "query").when(F.col("notes").isNull() | F.exists("notes", lambda x: x.isNull()), "notes")
        .when(F.col("note").isNull() | F.col("note").rlike(r"[\r\n]"), "note")
    )
    seen = rows.withColumn("problem", problem)
    return seen.filter("problem is null").drop("problem"), seen.filter("problem is not null")


def check_candidates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid audit candidates, trimmed, and the others with the first ``problem``."""
    problem = F.when(F.trim(F.coalesce("candidate", F.lit(""))) == "", "candidate").when(~F.coalesce(F.col("destination").isin(*DESTINATIONS), F.lit(False)), "destination")
    seen = rows.withColumn("problem", problem).withColumn("candidate", F.trim("candidate"))
    return seen.filter("problem is null").drop("problem"), seen.filter("problem is not null")


def append(rows: DataFrame, path: str, now: datetime.datetime) -> None:
    """Add rows with a UTC stamp."""
    rows.withColumn("ts", F.lit(now.astimezone(datetime.timezone.utc).isoformat())).write.mode("append").json(path)


def top_paths(fragments: DataFrame, n: int = 5) -> DataFrame:
    """(path, found_by) of the first n distinct notes of ranked fragments (rank, path, found_by)."""
    first = fragments.groupBy("path").agg(F.min("rank").alias("rank"), F.min_by("found_by", "rank").alias("found_by"))
    return first.orderBy("rank").limit(n)


def closures(lines: DataFrame) -> DataFrame:
    """Closed threads of a journal's lines (pos, line), the newest first; lines that are no object with a key are left out."""
    row = F.from_json("line", CLOSED)
    return lines.select("pos", row.alias("r")).filter("r.key is not null").select("pos", "r.*").orderBy(F.desc("pos"))


def closing_rows(threads: DataFrame, day: datetime.date) -> DataFrame:
    """Journal rows (key, thread, reason, closed) that close threads (line, reason); the shown line is squeezed and kept to 300 characters."""
    line = T.squeeze(F.col("line"))
    return threads.select(T.thread_key(F.col("line")).alias("key"), F.substring(line, 1, 300).alias("thread"), "reason", F.lit(day.isoformat()).alias("closed"))


def close_sessions(asked: DataFrame, pending: DataFrame, closed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What becomes of closing sessions (session_id): their states, the rows to add to the closed, and the pending that stay.

    closed: was pending and is closed now; already-closed; not-pending.  Of several
    pending rows of a session the first in time is taken over; running it twice adds
    nothing.
    """
    want = asked.filter("session_id is not null").select("session_id").distinct()
    done = closed.select("session_id").distinct().withColumn("_done", F.lit(True))
    waits = pending.groupBy("session_id").agg(F.min_by(F.struct("path", "ts"), "ts").alias("_p"))
    met = want.join(done, "session_id", "left").join(waits, "session_id", "left")
    state = F.when(F.col("_done"), "already-closed").when(F.col("_p").isNotNull(), "closed").otherwise("not-pending")
    states = met.select("session_id", state.alias("state"), "_p")
    new = states.filter("state = 'closed'").select("session_id", "_p.path", "_p.ts")
    return states.select("session_id", "state"), new, pending.join(want, "session_id", "left_anti")


def settled(closing: DataFrame, closed: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(session_id, state) of each session in the journals: closed, dismissed or pending, in this order of weight."""
    rows = closing.select("session_id", F.lit(2).alias("w")).unionByName(dismissed.select("session_id", F.lit(1).alias("w"))).unionByName(closed.select("session_id", F.lit(0).alias("w")))
    state = F.element_at(F.array(F.lit("closed"), F.lit("dismissed"), F.lit("pending")), F.min("w") + 1)
    return rows.filter("session_id is not null").groupBy("session_id").agg(state.alias("state"))
