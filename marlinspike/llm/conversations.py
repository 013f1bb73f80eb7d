"""Conversations from message rows.

Two shapes: a tree of nodes with parent pointers, of which the chain from a leaf to
its root is the conversation, and flat rows ordered by time.  Chains are resolved by
pointer-jumping joins (``plans.pointers``): log2(depth) rounds whatever the depth.
Sessions that are broken, empty or lack a reply are reported with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlinspike.plans.ordered import next_value, prefix_sum
from marlinspike.plans.pointers import expand_chains, jump_tables
from marlinspike.plans.workspace import Workspace

#: Roles whose messages with text are turns.
TURN_ROLES = ("user", "assistant")


def parsed(message: Column) -> Column:
    """struct(readable, role, text) of a message's JSON.

    Readable: parses as one object.  The text is ``content`` if that is a string, or
    the ``text`` of its parts of type "text" joined; null otherwise.  Null, empty and
    cut JSON, a list, and an object with a repeated key are unreadable.
    """
    v = F.try_parse_json(F.concat(F.lit("["), message, F.lit("]")))  # in brackets, what follows the object is an error too
    kind = lambda x: F.coalesce(F.schema_of_variant(x), F.lit("VOID"))
    one = F.try_variant_get(v, "$[0]", "variant")
    alone = F.try_variant_get(v, "$[1]", "variant").isNull()
    readable = F.coalesce(kind(one).startswith("OBJECT") & alone, F.lit(False))
    content = F.try_variant_get(v, "$[0].content", "variant")
    parts = F.filter(F.try_variant_get(v, "$[0].content", "array<variant>"), lambda p: F.try_variant_get(p, "$.type", "string") == "text")
    texts = F.transform(parts, lambda p: F.when(kind(F.try_variant_get(p, "$.text", "variant")) == "STRING", F.try_variant_get(p, "$.text", "string")))
    text = F.when(kind(content) == "STRING", F.try_variant_get(v, "$[0].content", "string")).when(kind(content).startswith("ARRAY"), F.array_join(texts, ""))
    role = F.when(kind(F.try_variant_get(v, "$[0].role", "variant")) == "STRING", F.try_variant_get(v, "$[0].role", "string"))
    return F.struct(readable.alias("readable"), F.when(readable, role).alias("role"), F.when(readable, text).alias("text"))


def _facts(message: Column, with_text: bool) -> Column:
    """What a conversation needs of a message: the text itself only where asked for."""
    m = parsed(message)
    turn = F.coalesce(m["readable"] & m["role"].isin(*TURN_ROLES) & F.coalesce(m["text"], F.lit("")).rlike(r"(?U)\S"), F.lit(False))
    fields = [m["readable"].alias("readable"), F.when(turn, m["role"]).alias("turn")]
    return F.struct(*fields, F.when(turn, m["text"]).alias("text")) if with_text else F.struct(*fields)


def tree_messages(nodes: DataFrame, leaves: DataFrame, ws: Workspace, with_text: bool) -> DataFrame:
    """Ordered messages of the chain above each session's leaf.

    nodes: (session, node, parent, message); leaves: (session, leaf).  Returns
    (session, o1, o2, readable, turn[, text], fault): o1 rises from root to leaf.
    Repeated node rows count once (of rows that differ, the least parent and
    message).  ``fault`` is 'orphan' on a row whose parent is not a node; a session
    whose chain meets a node twice has one row of fault 'loop', one whose leaf is
    null or unknown one row of fault 'no leaf'.
    """
    key = F.struct("session", "node")
    rows = nodes.filter(F.col("session").isNotNull() & F.col("node").isNotNull())
    one = rows.select(key.alias("k"), F.when(F.col("parent").isNotNull(), F.struct("session", F.col("parent").alias("node"))).alias("p"), _facts(F.col("message"), with_text).alias("m"))
    state = ws.write(one.groupBy("k").agg(F.min(F.struct("p", "m")).alias("s")).select("k", "s.p", "s.m"))
    tables, endless = jump_tables(state.select("k", "p"), ws)
    start = leaves.select("session", F.when(F.col("leaf").isNotNull(), F.struct("session", F.col("leaf").alias("node"))).alias("n"))
    start = start.join(state.select(F.col("k").alias("n"), F.lit(True).alias("known")), "n", "left").join(endless.select(F.col("k").alias("n"), F.lit(True).alias("endless")), "n", "left")
    start = ws.write(start)
    good = start.filter(F.col("known") & F.col("endless").isNull()).select("session", "n")
    chain = expand_chains(good, tables, ws)
    parents = tables[0].select("k", F.lit(True).alias("linked")) if tables else state.select("k", F.lit(True).alias("linked")).limit(0)
    info = state.join(parents, "k", "left").select(F.col("k").alias("n"), "m", F.when(F.col("p").isNotNull() & F.col("linked").isNull(), "orphan").alias("fault"))
    text = ["m.text"] if with_text else []
    found = chain.join(info, "n").select("session", (-F.col("d")).alias("o1"), F.lit("").alias("o2"), "m.readable", "m.turn", *text, "fault")
    bad = start.filter(F.col("known").isNull() | F.col("endless").isNotNull())
    none = F.lit(None).cast("string")
    why = F.when(F.col("known").isNull(), "no leaf").otherwise("loop")
    lost = bad.select("session", F.lit(0).cast("long").alias("o1"), F.lit("").alias("o2"), F.lit(True).alias("readable"), none.alias("turn"), *([none.alias("text")] if with_text else []), why.alias("fault"))
    return found.unionByName(lost)


def flat_messages(rows: DataFrame, with_text: bool) -> DataFrame:
    """Ordered messages of rows (id, session, time, message): by time, then id.

    Same columns as ``tree_messages``.  Repeated rows count once (of rows of an id
    that differ, the least); rows of a null id are told apart by time and message and
    come before the others of their time.  A null time is the fault 'no time'.  Rows
    of a null session are left out.
    """
    nameless = F.concat(F.lit("\u0000"), F.sha2(F.concat_ws("|", F.coalesce(F.col("time").cast("string"), F.lit("")), F.coalesce("message", F.lit("")), F.col("message").isNull().cast("string")), 256))
    kept = rows.filter(F.col("session").isNotNull()).select(F.coalesce("id", nameless).alias("id"), "session", "time", _facts(F.col("message"), with_text).alias("m"))
    one = kept.groupBy("session", "id").agg(F.min(F.struct("time", "m")).alias("s"))
    text = ["s.m.text"] if with_text else []
    late = F.when(F.col("s.time").isNull(), "no time").alias("fault")
    return one.select("session", F.coalesce(F.unix_micros(F.col("s.time").cast("timestamp")), F.lit(0)).alias("o1"), F.coalesce("id", F.lit("")).alias("o2"), "s.m.readable", "s.m.turn", *text, late)


def verdicts(messages: DataFrame, ws: Workspace) -> DataFrame:
    """(session, fault) of every session with a message row; fault null where the conversation is whole.

    The faults, the first that holds: that of a row, 'unreadable', 'empty' (no turn),
    'no reply' (a user turn without an assistant turn before the next or the end).
    Sessions of any length are scanned in pieces.
    """
    facts = messages.groupBy("session").agg(F.min("fault").alias("fault"), F.min("readable").alias("readable"), F.count("turn").alias("turns"))
    turns = messages.filter("turn is not null").select("session", "o1", "o2", "turn")
    after = next_value(turns, ["session"], ["o1", "o2"], F.col("turn"), "after", ws)
    mute = after.filter("turn = 'user' and (after is null or after = 'user')").select("session").distinct().withColumn("mute", F.lit(True))
    fault = F.coalesce("fault", F.when(~F.col("readable"), "unreadable").when(F.col("turns") == 0, "empty").when(F.col("mute"), "no reply"))
    return facts.join(mute, "session", "left").select("session", fault.alias("fault"))


def dropped(known: DataFrame, messages: DataFrame, all_ids: DataFrame, ws: Workspace) -> DataFrame:
    """(session, fault) of all sessions that must go; known: (session) with a row of their own."""
    have = known.filter("session is not null").distinct()
    judged = have.join(verdicts(messages, ws), "session", "left").join(messages.select("session").distinct().withColumn("any", F.lit(True)), "session", "left")
    bad = judged.select("session", F.when(F.col("any").isNull(), "empty").otherwise(F.col("fault")).alias("fault")).filter("fault is not null")
    return bad.unionByName(all_ids.filter("session is not null").distinct().join(have, "session", "left_anti").select("session", F.lit("no session").alias("fault")))


def turns(messages: DataFrame, bad: DataFrame, ws: Workspace) -> DataFrame:
    """(session, pos, role, text) of the whole conversations, pos from 0 in order."""
    kept = messages.filter("turn is not null").join(bad.select("session"), "session", "left_anti")
    placed = prefix_sum(kept.withColumn("one", F.lit(1).cast("long")), ["session"], ["o1", "o2"], "one", "pos", ws)
    return placed.select("session", "pos", F.col("turn").alias("role"), "text")
