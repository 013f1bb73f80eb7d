"""Audits by meaning: candidates, verdicts that still hold, triage, batches, answers, safe links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlinspike.functions import text as T
from marlinspike.operators import links as L
from marlinspike.operators import vectors as V
from marlinspike.plans.ordered import prefix_sum
from marlinspike.plans.workspace import Workspace

#: Note types compared, batch sizes, verdict words of a same-project pair, staleness marks.
POOL_TYPES = ("atom", "godnote", "source", "lead")
BATCH = {"group": 20, "cross": 20, "same": 40, "stale": 20}
OLD, DISPUTE, DOUBLE, REFINES = "устарело", "спор", "дубль", "уточняет"
REPLACES = r"(?iu)(supersedes|заменяет|отменяет|отменённое|отмененное|устарел[аио]?\s+из-за|corrects)(?U:\b)[^\n]*?\[\[([^\]|#]+)"
SELF_STALE = r"(?ium)^\s*>?\s*[⚠️\s]*\**\s*устарело(?U:\b)"
CORRECTION = r"(?m)^## (Поправка(?U:\b).*)$"


def pool(notes: DataFrame, leads: bool) -> DataFrame:
    """Live notes of the compared types; leads count towards the centre but are no candidates."""
    kind = F.lower(F.coalesce("type", F.lit("")))
    live = notes.filter(kind.isin(*POOL_TYPES) & (F.coalesce("died", F.lit("")) == ""))
    return live if leads else live.filter(kind != "lead")


def centred_pool(notes: DataFrame, note_vectors: DataFrame, dim: int) -> DataFrame:
    """(id, vector) of the candidates, centred on the mean of the live pool."""
    own = note_vectors.join(pool(notes, True).select("note_id"), "note_id", "left_semi")
    some = note_vectors.join(pool(notes, False).select("note_id"), "note_id", "left_semi")
    return V.centred(some.select(F.col("note_id").alias("id"), "vector"), own.select("vector"), dim)


def pairs(notes: DataFrame, similar: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, a, b, title_a, title_b, sim) of similar notes (a, b, sim) that no link joins.

    'cross': of two named projects and without a common neighbour; 'same': else, if
    the projects do not differ.  Sides in title order.
    """
    note = lambda c: notes.select(F.col("note_id").alias(c), F.coalesce("title", F.lit("")).alias(f"t{c}"), F.coalesce("project", F.lit("")).alias(f"p{c}"))
    free = L.without_links(similar, edges)
    met = free.join(note("a"), "a").join(note("b"), "b")
    cross = (F.col("pa") != "") & (F.col("pb") != "") & (F.col("pa") != F.col("pb"))
    far = L.without_common(met.filter(cross).select("a", "b"), edges)
    kept = met.filter(cross).join(far, ["a", "b"], "left_semi").withColumn("kind", F.lit("cross")).unionByName(met.filter(~cross).withColumn("kind", F.lit("same")))
    swap = (F.col("tb") < F.col("ta")) | ((F.col("tb") == F.col("ta")) & (F.col("b") < F.col("a")))
    pick = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    titles = F.array("ta", "tb")
    key = F.when(F.col("kind") == "cross", T.finding_key("cross", titles)).otherwise(T.finding_key("same", titles))
    return kept.select("kind", key.alias("key"), pick("a", "b", "a"), pick("b", "a", "b"), pick("ta", "tb", "title_a"), pick("tb", "ta", "title_b"), F.round("sim", 3).alias("sim"))


def group_facts(members: DataFrame, notes: DataFrame, vectors: DataFrame, edges: DataFrame, covered: float = 0.5, nearest: int = 3) -> tuple[DataFrame, DataFrame]:
    """Groups no godnote owns, and their nearest godnotes.

    members: (id, label); vectors: centred (id, vector).  A group is owned if a
    godnote links at least half of it.  Members are ranked by closeness to the
    group's mean; the three nearest godnotes come with the number of members linked.
    """
    gods = notes.filter(F.lower("type") == "godnote").select(F.col("note_id").alias("god"))
    size = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    linked = members.join(edges.select(F.col("a").alias("god"), F.col("b").alias("id")), "id").join(gods, "god", "left_semi").groupBy("label", "god").agg(F.count_distinct("id").alias("links"))
    owned = linked.join(size, "label").filter(F.col("links") / F.col("size") >= covered).select("label").distinct()
    free = members.join(owned, "label", "left_anti")
    flat = free.join(vectors, "id").select("label", F.posexplode("vector"))
    mean = flat.groupBy("label", "pos").agg(F.avg("col").alias("m")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")).select("label", F.transform("s", lambda x: x["m"]).alias("centre"))
    by = F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("close", 9)), "id"))
    ranked = free.join(vectors, "id").join(mean, "label").select("label", "id", V.dot(F.col("vector"), F.col("centre")).alias("close")).withColumn("rank", by)
    god_vec = vectors.join(gods.withColumnRenamed("god", "id"), "id", "left_semi").select(F.col("id").alias("god"), "vector")
    # the groups come from one pool of at most GROUP_ROWS notes, so their centres are few
    near = god_vec.join(F.broadcast(mean)).select("label", "god", V.dot(F.col("vector"), F.col("centre")).alias("close"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.round("close", 9)), "god"))).filter(F.col("rank") <= nearest)
    return ranked, near.join(linked, ["label", "god"], "left").select("label", "god", "rank", F.coalesce("links", F.lit(0)).alias("links_to_group"))


def stale(notes: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """(key, how, old, new, correction): notes another replaces, that call themselves old, or carry a correction.

    notes: (note_id, title, path, died); texts: (note_id, text); names: (name, dst),
    one note a folded name.  Session notes say nothing.  Of several signs with one
    key the first in that order counts.
    """
    live = F.coalesce("died", F.lit("")) == ""
    said = notes.filter(~F.concat(F.lit("/"), F.col("path")).contains("/sessions/")).join(texts, "note_id")
    verbs, olds = F.regexp_extract_all("text", F.lit(REPLACES), F.lit(1)), F.regexp_extract_all("text", F.lit(REPLACES), F.lit(2))
    hits = said.select(F.col("note_id").alias("new"), F.col("title").alias("new_title"), F.posexplode(F.arrays_zip(verbs.alias("v"), olds.alias("o"))).alias("pos", "m"))
    hits = hits.select("new", "new_title", "pos", F.lower("m.v").alias("how"), L.fold(F.trim("m.o")).alias("name")).join(names, "name")
    old = notes.filter(live).select(F.col("note_id").alias("dst"), F.col("title").alias("old_title"))
    none = F.lit(None).cast("string")
    replaced = hits.join(old, "dst").filter("dst <> new").select(F.lit(0).alias("sign"), F.col("new").alias("src"), "pos", "how", F.col("dst").alias("old"), "old_title", "new", "new_title", none.alias("correction"))
    own = said.filter(live)
    no_new = [F.lit(None).cast(dict(notes.dtypes)["note_id"]).alias("new"), none.alias("new_title")]
    base = [F.col("note_id").alias("src"), F.lit(0).alias("pos")]
    marked = own.filter(F.col("text").rlike(SELF_STALE)).select(F.lit(1).alias("sign"), *base, F.lit("self").alias("how"), F.col("note_id").alias("old"), F.col("title").alias("old_title"), *no_new, none.alias("correction"))
    head = F.trim(F.regexp_extract("text", CORRECTION, 1))
    fixed = own.filter(head != "").select(F.lit(2).alias("sign"), *base, F.lit("correction").alias("how"), F.col("note_id").alias("old"), F.col("title").alias("old_title"), *no_new, head.alias("correction"))
    both = replaced.unionByName(marked).unionByName(fixed)
    titles = F.filter(F.array("old_title", "new_title"), lambda x: x.isNotNull())
    keyed = both.withColumn("key", T.finding_key("stale", titles))
    first = F.row_number().over(Window.partitionBy("key").orderBy("sign", "src", "pos", "old"))
    return keyed.withColumn("n", first).filter("n = 1").select("key", "how", "old", "new", "correction")


def same_map(a: Column, b: Column) -> Column:
    """Equality of two maps, in whatever order; null equals null."""
    entries = lambda m: F.array_sort(F.map_entries(m))
    return entries(a).eqNullSafe(entries(b))


def standing(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates (key, sha) with the verdict that still holds, null where it must be read again.

    verdicts: (key, verdict, decided, sha).  A decision always holds, a verdict
    without hashes holds, another holds while the hashes of its notes are the same.
    """
    v = verdicts.select("key", "verdict", "decided", F.col("sha").alias("_sha"))
    met = candidates.join(v, "key", "left")
    holds = F.col("verdict").isNotNull() & (F.coalesce("decided", F.lit(False)) | F.col("_sha").isNull() | same_map(F.col("_sha"), F.col("sha")))
    return met.withColumn("verdict", F.when(holds, F.col("verdict"))).withColumn("decided", F.when(holds, F.coalesce("decided", F.lit(False)))).drop("_sha")


def triage(findings: DataFrame) -> DataFrame:
    """Adds ``place`` to findings (kind, key, old_path, keep, extend, verdict, confirmed, read, decided).

    unread, decided, safe (links only), page (goes to the user) or dropped.  A
    same-project pair called old whose old note a confirmed stale finding covers is
    dropped as told already.
    """
    told = findings.filter((F.col("kind") == "stale") & F.col("confirmed") & F.col("read")).select(F.col("old_path").alias("_told")).distinct()
    met = findings.join(told, findings["old_path"] == told["_told"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    kind = F.col("kind")
    again = (F.col("verdict") == OLD) & F.col("_told").isNotNull()
    place = (
        F.when(~yes("read"), "unread").when(yes("decided"), "decided")
        .when((kind == "group") & yes("keep") & F.col("extend").isNotNull(), "safe").when((kind == "group") & yes("keep"), "page")
        .when((kind == "cross") & yes("keep"), "safe").when((kind == "same") & (F.col("verdict") == REFINES), "safe")
        .when((kind == "same") & F.col("verdict").isin(OLD, DISPUTE, DOUBLE) & ~again, "page").when((kind == "stale") & yes("confirmed"), "page").otherwise("dropped")
    )
    return met.withColumn("place", place).drop("_told")


def batches(rows: DataFrame, kind: str, order: str, ws: Workspace) -> DataFrame:
    """``rows`` with the number of their batch, of 20 or 40 rows by kind, in the order of a unique column."""
    one = rows.withColumn("_all", F.lit(1)).withColumn("_one", F.lit(1).cast("long"))
    placed = prefix_sum(one, ["_all"], [order], "_one", "_before", ws)
    return placed.withColumn("batch", F.floor(F.col("_before") / BATCH[kind]).cast("int")).drop("_all", "_one", "_before")


def match_answers(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, fault) of a batch's answers that do not fit its questions: missing, unasked or repeated. No rows: all fit."""
    a = answers.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    met = asked.select("key", F.lit(True).alias("asked")).join(a, "key", "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unasked").when(F.col("n") > 1, "repeated")
    return met.select("key", fault.alias("fault")).filter("fault is not null")


def link_plan(findings: DataFrame) -> DataFrame:
    """Distinct (src, dst, why) of the links that safe findings (src, dst, why) ask for; the first reason in order counts."""
    return findings.filter("src <> dst").groupBy("src", "dst").agg(F.min("why").alias("why"))


def add_links(text: str, names: list[str], heading: str = "## Links") -> str:
    """A note's text with the missing links in its links section; line ends are kept, a second run changes nothing."""
    from marlinspike.functions.markdown import links

    end = "\r\n" if "\r\n" in text else "\n"
    have = {n.casefold() for n in links(text)}
    new = [n for n in dict.fromkeys(names) if n.casefold() not in have]
    if not new:
        return text
    rows = end.join(f"- [[{n}]]" for n in new)
    lines = text.split(end)
    at = next((i for i, line in enumerate(lines) if line.strip() == heading), None)
    if at is None:
        return f"{text.rstrip()}{end}{end}{heading}{end}{end}{rows}{end}"
    stop = next((i for i in range(at + 1, len(lines)) if lines[i].startswith("#")), len(lines))
    while stop > at + 1 and not lines[stop - 1].strip():
        stop -= 1
    return end.join([*lines[:stop], *([""] if stop == at + 1 else []), rows, *lines[stop:]])
