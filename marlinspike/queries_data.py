"""Queries of the two general data problems: hierarchies (2) and orphan references (4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.operators import hierarchy, references
from marlinspike.plans.workspace import Workspace


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Both trees as rows (k, p); kind keeps equal ids of the two apart."""
    m = spark.read.parquet(f"{d}/message_nodes.parquet")
    m = m.select(F.lit(0).alias("kind"), "session_id", F.col("node_id").alias("node"), "parent_node_id").select(
        "kind", "session_id", "node", F.col("session_id").alias("up"), F.col("parent_node_id").alias("up_node")
    )
    s = spark.read.parquet(f"{d}/session_v2.parquet")
    zero = F.lit(0).cast("long")
    s = s.select(F.lit(1).alias("kind"), F.col("id").alias("session_id"), zero.alias("node"), F.col("parent_id").alias("up"), zero.alias("up_node"))
    return hierarchy.prepare(m.unionByName(s), ["kind", "session_id", "node"], ["kind", "up", "up_node"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    sized = hierarchy.subtree_sizes(_nodes(spark, d), Workspace(spark))
    return sized.filter("open").select(F.col("k.k1").alias("session_id"), F.col("k.k2").alias("node_id"))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("k.k0") == 0, F.col("k.k2").cast("string")).otherwise(F.col("k.k1"))
    sets, _ = hierarchy.nested_sets(_nodes(spark, d), Workspace(spark), label=label)
    root = F.when(F.col("k.k0") == 0, F.col("root.k2").cast("string")).otherwise(F.col("root.k1"))
    return sets.select(
        F.when(F.col("k.k0") == 0, "message_nodes").otherwise("session_v2").alias("tree"),
        F.col("k.k1").alias("session_id"), F.col("k.k2").alias("node_id"), root.alias("root"), "depth",
        (F.col("size") - 1).alias("n_descendants"), "lo", "hi", F.array_join("path", "/").alias("path"),
    )


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    sets, _ = hierarchy.nested_sets(_nodes(spark, d), Workspace(spark), with_path=False)
    pairs = hierarchy.descendants(sets)
    return pairs.select(
        F.col("ancestor.k1").alias("session_id"), F.col("ancestor.k2").alias("node_id"),
        F.col("descendant.k1").alias("below_session_id"), F.col("descendant.k2").alias("below_node_id"), "distance",
    )


def _claims(notes: DataFrame) -> DataFrame:
    """A row for each name a note goes by: title, path, file name (each with and without .md), aliases."""
    path = F.col("path")
    file = F.element_at(F.split(path, "/"), -1)
    bare = lambda c: F.regexp_replace(c, r"\.md$", "")
    alias = F.trim("aliases")
    listed = F.from_json(alias, "array<string>")
    aliases = F.when(alias.startswith("["), F.coalesce(listed, F.array("aliases"))).when(alias != "", F.array("aliases")).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.array(F.col("title"), path, bare(path), file, bare(file)), F.coalesce(aliases, F.array().cast("array<string>")))
    return notes.select(F.explode(F.array_distinct(F.filter(names, lambda x: x.isNotNull() & (x != "")))).alias("name"), F.col("indexed_at").alias("arrived"))


def link_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every link without a note at its time: (ref_id, seen, fault, kind); links delivered again repeat."""
    links = spark.read.parquet(f"{d}/links.parquet")
    notes = spark.read.parquet(f"{d}/notes.parquet")
    gone = spark.read.parquet(f"{d}/vanished_notes.parquet")
    by_id = links.filter("dst_note_id_or_null is not null").select(F.col("link_id").alias("ref_id"), F.col("dst_note_id_or_null").alias("key"), F.col("seen_at").alias("seen"))
    by_name = links.filter("dst_note_id_or_null is null").select(F.col("link_id").alias("ref_id"), F.col("dst_name").alias("name"), F.col("seen_at").alias("seen"))
    keys = notes.select(F.col("id").alias("key"), F.col("indexed_at").alias("arrived"))
    ids = references.orphan_keys(by_id, keys, gone.select(F.col("note_id").alias("key")))
    lost = _claims(gone.select("path", "title", F.lit(None).cast("string").alias("aliases"), F.col("gone_at").alias("indexed_at"))).select("name")
    names = references.orphan_names(by_name, _claims(notes), lost)
    return ids.withColumn("kind", F.lit("id")).unionByName(names.withColumn("kind", F.lit("name")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return link_faults(spark, d).select(F.col("ref_id").alias("link_id")).distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(link_faults(spark, d).dropDuplicates(["ref_id"]))


QUERIES = {f.__name__: f for f in (p2_found, p2_hierarchy, p2_descendants, p4_found, p4_report)}
