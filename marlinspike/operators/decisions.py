"""Decisions on findings: what a page showed, what came back, and whether it still holds."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlinspike.functions import text as T
from marlinspike.operators.audit import DISPUTE, DOUBLE, OLD, REFINES, same_map

#: The answer field each kind of finding must have, verdict words, what is known of a rule's place.
SAME_VERDICTS = (OLD, DISPUTE, DOUBLE, REFINES, "мимо")
RULE_SCOPES = ("known", "unknown")
MARKS = ("yes", "no", None)


def fingerprint(snapshot: dict) -> str:
    """One name for a page: sha256 of its JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(snapshot, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def answer_fault(kind: Column, answer: Column) -> Column:
    """The first field of a reader's answer (JSON text) that is not as its kind asks, null where all are."""
    v = F.try_parse_json(answer)
    type_of = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))
    text = lambda name: F.when(type_of(name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
    wide = kind.isin("group", "cross")
    scoped = type_of("rule_scope") != "VOID"
    return (
        F.when(~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).startswith("OBJECT"), "not an object")
        .when(wide & (type_of("keep") != "BOOLEAN"), "keep").when((kind == "same") & ~F.coalesce(text("verdict").isin(*SAME_VERDICTS), F.lit(False)), "verdict")
        .when((kind == "stale") & (type_of("confirmed") != "BOOLEAN"), "confirmed")
        .when(wide & scoped & ~F.coalesce(text("rule_scope").isin(*RULE_SCOPES), F.lit(False)), "rule_scope").when(wide & scoped & (type_of("rule_scope_reason") != "STRING"), "rule_scope_reason")
    )


def strict(text: str) -> object:
    """JSON in which an object with a repeated key is an error."""

    def once(pairs: list[tuple]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a key stands twice")
        return out

    return json.loads(text, object_pairs_hook=once)


def marks(text: str, run: str, allowed: set[str]) -> tuple[dict[str, dict], list[str]]:
    """Marks of a page's export ({version, run_id, decisions}) and what is wrong with it; empty marks say nothing."""
    try:
        data = strict(text)
    except ValueError as e:
        return {}, [f"no strict JSON: {e}"]
    if not isinstance(data, dict) or data.get("version") != 1:
        return {}, ["not an export of version 1"]
    if data.get("run_id") != run:
        return {}, ["of another run"]
    given = data.get("decisions")
    if not isinstance(given, dict):
        return {}, ["decisions are no object"]
    fits = {k: isinstance(m, dict) and m.get("v") in MARKS and isinstance(m.get("c", ""), str) for k, m in given.items()}
    faults = [f"{k}: unknown finding" for k in given if k not in allowed] + [f"{k}: not a mark" for k, ok in fits.items() if k in allowed and not ok]
    said = {k: {"v": m.get("v"), "c": m.get("c", "").strip()} for k, m in given.items() if k in allowed and fits[k]}
    return {k: m for k, m in said.items() if m["v"] or m["c"]}, faults


def page_changes(shown: DataFrame, now: DataFrame) -> DataFrame:
    """(key, change) of findings (key, sha, verdict) that differ between a page and what holds now: gone, new, notes or verdict. No rows: the page holds."""
    old = shown.select("key", F.col("sha").alias("_sha"), F.col("verdict").alias("_v"), F.lit(True).alias("_was"))
    met = old.join(now.select("key", "sha", "verdict", F.lit(True).alias("_is")), "key", "full")
    change = F.when(F.col("_is").isNull(), "gone").when(F.col("_was").isNull(), "new").when(~same_map(F.col("sha"), F.col("_sha")), "notes").when(~F.col("verdict").eqNullSafe(F.col("_v")), "verdict")
    return met.select("key", change.alias("change")).filter("change is not null")


def named_godnotes(asked: DataFrame, nearest: DataFrame) -> DataFrame:
    """(key, god) for answers (key, extend): the first of a finding's godnotes (key, god, title, rank) with that title, genre prefix or not."""
    want = asked.filter(F.coalesce("extend", F.lit("")) != "").select("key", F.col("extend").alias("_e"), T.bare_title(F.col("extend")).alias("_b"))
    met = nearest.join(want, "key").filter((F.col("title") == F.col("_e")) | (T.bare_title(F.col("title")) == F.col("_b")))
    return met.groupBy("key").agg(F.min_by("god", F.struct("rank", "god")).alias("god"))


def linked_pairs(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, linked_pairs) of groups (id, label): pairs of members joined by an undirected edge (a, b), 0 where none is."""
    side = lambda c: members.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    met = edges.filter("a < b").select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").filter("la = lb")
    n = met.groupBy(F.col("la").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return members.select("label").distinct().join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("linked_pairs"))


def notes_of(finding: Column) -> Column:
    """Paths of the notes a finding (kind, members, old, new, a, b) is about."""
    f = lambda c: finding.getField(c)
    some = F.when(f("kind") == "group", f("members")).when(f("kind") == "stale", F.array(f("old"), f("new"))).otherwise(F.array(f("a"), f("b")))
    return F.filter(some, lambda x: x.isNotNull())
