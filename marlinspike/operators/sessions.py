"""Sessions: facts, split for readers, rendering, sessions nobody closed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlinspike.functions.markdown import arrow_map

#: Characters of one reader's piece; window of unclosed sessions.
SPLIT_ABOVE = 120_000
WINDOW_DAYS, QUIET_MINUTES, LEAST_TURNS = 14, 30, 3


def message_text(message: Column) -> Column:
    """Text of a message (a variant): its content if that is a string, the text of its parts of type text by lines if it is a list."""
    kind = F.coalesce(F.schema_of_variant(F.try_variant_get(message, "$.content", "variant")), F.lit("VOID"))
    parts = F.filter(F.try_variant_get(message, "$.content", "array<variant>"), lambda p: F.try_variant_get(p, "$.type", "string") == "text")
    joined = F.array_join(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), "\n")
    return F.when(kind == "STRING", F.try_variant_get(message, "$.content", "string")).when(kind.startswith("ARRAY"), joined)


def facts(turns: DataFrame) -> DataFrame:
    """(session_id, turns, user_turns, chars, first_message) of turns (session_id, pos, role, text).

    The first message is the first user turn that does not start with '<'.
    """
    said = (F.col("role") == "user") & ~F.coalesce(F.col("text").startswith("<"), F.lit(True))
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"),
        F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.min_by(F.when(said, F.col("text")), F.when(said, F.col("pos"))).alias("first_message"),
    )


def role_totals(turns: DataFrame) -> DataFrame:
    """(role, turns, chars)."""
    return turns.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


def pieces(sizes: list[int], marks: list[bool], limit: int = SPLIT_ABOVE) -> list[int]:
    """Piece number of each turn, given its size and whether it is a compaction mark.

    A conversation within the limit is one piece.  Else it is cut after each mark
    that closes something, and a stretch still over the limit into parts of about
    equal size; a part of nothing but marks joins the one before it.
    """
    if not sizes:
        return []
    if sum(sizes) <= limit:
        return [0] * len(sizes)
    stretches, start = [], 0
    for i, mark in enumerate(marks):
        if mark and i > start:
            stretches.append((start, i + 1))
            start = i + 1
    if start < len(sizes):
        stretches.append((start, len(sizes)))
    out, number = [0] * len(sizes), -1
    for a, b in stretches:
        whole = sum(sizes[a:b])
        parts = 1 if whole <= limit else max(2, -(-whole // limit))
        used, done, begin = 0, 0, a
        cuts = []
        for i in range(a, b):
            used += sizes[i]
            if used >= whole / parts and done < parts - 1 and parts > 1:
                cuts.append((begin, i + 1))
                begin, used, done = i + 1, 0, done + 1
        if begin < b:
            cuts.append((begin, b))
        for k, (p, q) in enumerate(cuts):
            if not (k and parts > 1 and all(marks[p:q])):
                number += 1
            out[p:q] = [number] * (q - p)
    return out


def split(turns: DataFrame, limit: int = SPLIT_ABOVE) -> DataFrame:
    """(session_id, pos, piece) of turns (session_id, pos, role, text).

    Greedy cutting is sequential, so one session's sizes (not its texts) meet in one
    row of a long each.
    """
    size = F.coalesce(F.length("text"), F.lit(0)).alias("n")
    rows = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pos", size, (F.col("role") == "compaction").alias("mark")))).alias("s"))

    def cut(session: str, s: list[dict]) -> list[tuple]:
        return [(session, x["pos"], p) for x, p in zip(s, pieces([x["n"] for x in s], [bool(x["mark"]) for x in s], limit))]

    return arrow_map(rows, ["session_id", "s"], cut, "session_id string, pos long, piece int", [pa.string(), pa.int64(), pa.int32()])


def render(turns: DataFrame, cut: DataFrame) -> DataFrame:
    """(session_id, piece, text): the pieces as readers get them."""
    row = F.struct("pos", F.concat(F.lit("["), F.col("role"), F.lit("]\n"), F.coalesce("text", F.lit(""))).alias("t"))
    met = turns.join(cut, ["session_id", "pos"]).groupBy("session_id", "piece").agg(F.array_sort(F.collect_list(row)).alias("s"))
    return met.select("session_id", "piece", F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("text"))


def unclosed(sessions: DataFrame, now, settled: DataFrame, current: str | None = None) -> DataFrame:
    """Sessions (session_id, last_activity, turns, interactive) that nobody closed.

    Last active within 14 days and quiet for 30 minutes, at least three turns,
    interactive, not the current one, and neither closed nor dismissed (settled:
    session_id).  Newest first.
    """
    at = F.col("last_activity")
    keep = (at >= F.lit(now) - F.expr(f"interval {WINDOW_DAYS} days")) & (at <= F.lit(now) - F.expr(f"interval {QUIET_MINUTES} minutes"))
    keep = keep & (F.col("turns") >= LEAST_TURNS) & F.col("interactive")
    if current is not None:
        keep = keep & (F.col("session_id") != current)
    return sessions.filter(keep).join(settled.select("session_id").distinct(), "session_id", "left_anti").orderBy(F.desc("last_activity"), F.desc("session_id"))
