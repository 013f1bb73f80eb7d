"""Link resolution, broken links, demand and degrees of the note graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlinspike.functions import text as T
from marlinspike.operators.references import fold

DEMAND_FLOOR = 3


def alias_list(aliases: Column) -> Column:
    """Aliases stored as text: '', null, a bare name, or a JSON list."""
    t = F.trim(aliases)
    listed = F.from_json(t, "array<string>")
    none = F.array().cast("array<string>")
    return F.coalesce(F.when(t.startswith("["), F.coalesce(listed, F.array(aliases))).when(t != "", F.array(aliases)), none)


def own_names(title: Column, path: Column) -> Column:
    """The names a note answers to: title, stem, path without .md, file name, path; folded, distinct, not empty."""
    file = F.element_at(F.split(path, "/"), -1)
    names = F.array(title, T.file_stem(path), F.regexp_replace(path, r"\.md$", ""), file, path)
    return F.array_distinct(F.filter(F.transform(names, fold), lambda x: x.isNotNull() & (x != "")))


def name_map(notes: DataFrame) -> DataFrame:
    """(name, dst) of notes (note_id, title, path, aliases): who answers to a folded name.

    A name two notes have answers to nobody.  An alias answers where no note has the
    name as its own and only one note claims it.
    """
    own = notes.select(F.explode(own_names(F.col("title"), F.col("path"))).alias("name"), "note_id")
    owner = own.groupBy("name").agg(F.min("note_id").alias("dst"), (F.min("note_id") != F.max("note_id")).alias("shared"))
    claims = notes.select(F.explode(F.array_distinct(F.transform(alias_list(F.col("aliases")), lambda x: fold(F.trim(x))))).alias("name"), "note_id").filter("name <> ''")
    alias = claims.groupBy("name").agg(F.min("note_id").alias("dst"), (F.min("note_id") != F.max("note_id")).alias("shared"))
    alias = alias.join(owner.select("name"), "name", "left_anti")
    return owner.unionByName(alias).filter(~F.col("shared")).select("name", "dst")


def latest_name_map(notes: DataFrame) -> DataFrame:
    """(name, dst) of notes (note_id, title, path, aliases) as claims of staleness are resolved.

    Unlike ``name_map``, the greatest note id wins where several notes have a name, and
    the file name with its ending is no name.  An alias answers where no note has the
    name as its own, the greatest note id again.
    """
    names = F.array("title", T.file_stem(F.col("path")), F.regexp_replace("path", r"\.md$", ""), "path")
    last = lambda x: notes.select(F.explode(F.transform(x, fold)).alias("name"), "note_id").filter("name <> ''").groupBy("name").agg(F.max("note_id").alias("dst"))
    own, alias = last(names), last(F.transform(alias_list(F.col("aliases")), lambda x: F.trim(x)))
    return own.unionByName(alias.join(own.select("name"), "name", "left_anti"))


def resolve(links: DataFrame, names: DataFrame) -> DataFrame:
    """``links`` with ``dst`` (set anew if there): the note that answers to dst_name, null where broken.

    The distinct names meet the name map first; a name that holds a third of the
    links is one row of that join, and the small result goes back to the links.
    """
    wanted = links.select(F.col("dst_name").alias("_n")).filter("_n is not null").distinct()
    found = wanted.withColumn("name", fold(F.trim("_n"))).join(names, "name").select("_n", "dst")
    plain = links.drop("dst")
    return plain.join(found, plain["dst_name"] == found["_n"], "left").drop("_n")


def completed(links: DataFrame, names: DataFrame) -> DataFrame:
    """``links`` (src, dst_name, dst) with the note that answers to dst_name where no id is stored."""
    open_ = resolve(links.filter("dst is null"), names)
    return links.filter("dst is not null").unionByName(open_.select(*links.columns))


def broken(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(title, dst_name) of the links (src, dst_name, dst) without a target, one row each."""
    return links.filter("dst is null").join(notes.select(F.col("note_id").alias("src"), "title"), "src").select("title", "dst_name")


def demand(links: DataFrame, floor: int = DEMAND_FLOOR) -> DataFrame:
    """(spellings, demand) of the names asked for at least ``floor`` times that no note answers to.

    Spellings that differ by case, blanks or hyphens are one name; the most asked for
    stands first, ties by name.  Counted by spelling before they are gathered.
    """
    each = links.filter("dst is null and dst_name is not null").groupBy("dst_name").agg(F.count(F.lit(1)).alias("n"))
    spelled = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "dst_name")))
    out = each.groupBy(T.demand_fold(F.col("dst_name")).alias("key")).agg(F.sum("n").alias("demand"), spelled.alias("s"))
    return out.filter(F.col("demand") >= floor).select(F.transform("s", lambda x: x["dst_name"]).alias("spellings"), "demand")


def out_degrees(links: DataFrame) -> DataFrame:
    """(src, n_out, n_broken): links of each note, repeated and broken ones included."""
    return links.groupBy("src").agg(F.count(F.lit(1)).alias("n_out"), F.sum(F.col("dst").isNull().cast("int")).alias("n_broken"))


def undirected(links: DataFrame) -> DataFrame:
    """Distinct (a, b) in both directions of the resolved links, loops left out."""
    e = links.filter("src is not null and dst is not null and src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def without_links(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) that no link joins."""
    return pairs.join(edges.select("a", "b"), ["a", "b"], "left_anti")


def without_common(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) without a common neighbour.

    Only the neighbours of the notes in question are joined; a hub in common is one
    row of either side of each pair.
    """
    near = edges.select(F.col("a").alias("n"), F.col("b").alias("c"))
    left = pairs.select("a", "b").join(near.select(F.col("n").alias("a"), "c"), "a")
    common = left.join(near.select(F.col("n").alias("b"), "c"), ["b", "c"], "left_semi").select("a", "b").distinct()
    return pairs.join(common, ["a", "b"], "left_anti")
