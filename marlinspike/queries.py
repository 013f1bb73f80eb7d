"""Queries of the note-memory operators over the project's tables.

Nothing depends on the day a query runs: TODAY is fixed.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlinspike.functions import text as T
from marlinspike.operators import audit, decisions, digest, health, links, search, sessions, vectors
from marlinspike.plans.ordered import prefix_sum
from marlinspike.plans.workspace import Workspace
from marlinspike.sources import journal, vault
from marlinspike.sources.store import Store, stamp
from marlinspike.streaming import guard

TODAY = datetime.date(2025, 7, 1)
NOW = datetime.datetime(2025, 6, 10, tzinfo=datetime.timezone.utc)
QUESTION = "Which session thread breaks the default journal query because of harbor-index"
PROJECT = "quill-board"
ALIASES = {"quill-board": ["Quill Board"]}


class Tables:
    """The driver's tables under the operators' column names; rows delivered again count once."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.notes = self.t("notes").withColumnRenamed("id", "note_id")
        # re-delivered rows are exact copies, so one key tells them; only queries that read bodies move them
        self.chunks = self.t("chunks").dropDuplicates(["id"]).withColumnRenamed("id", "chunk_id").withColumnRenamed("heading_path", "heading")
        self.links = self.t("links").dropDuplicates(["link_id"]).select("link_id", F.col("src_note_id").alias("src"), "dst_name", F.col("dst_note_id_or_null").alias("dst"))
        self.vectors = self.t("chunk_vectors")

    def resolved(self) -> DataFrame:
        """The links with a target wherever their name has one, as the index has them after each build."""
        return links.completed(self.links, links.name_map(self.notes))

    def stored(self) -> Tables:
        """The same with the chunks written once, for queries that read their bodies in several steps."""
        self.chunks = Workspace(self.spark).write(self.chunks)
        return self

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.d}/{name}.parquet")


# --- index and links -----------------------------------------------------------------


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    n = Tables(spark, d).notes
    return n.select(
        "note_id", T.normalize_project(F.col("project")).alias("project_norm"), T.canonical_project(F.col("project"), ALIASES).alias("project_canon"),
        T.thread_key(F.coalesce("title", F.lit(""))).alias("thread_key"), T.finding_key("cross", F.array(F.coalesce("title", F.lit("")), F.col("path"))).alias("finding_key"),
        T.shown(F.coalesce("title", F.lit("")), 40).alias("shown"), T.bare_title(F.coalesce("title", F.lit(""))).alias("bare"), T.demand_fold(F.coalesce("title", F.lit(""))).alias("fold"),
        T.iso_date(F.col("date")).cast("string").alias("day"), T.file_stem(F.col("path")).alias("stem"), T.clip_bytes(F.coalesce("title", F.lit("")), 21).alias("clipped"),
    )


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """The commonest tokens of the corpus: a top-k report."""
    return _words(Tables(spark, d))[0].groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).orderBy(F.desc("df"), "term").limit(50)


def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return links.resolve(t.links.drop("dst"), links.name_map(t.notes)).select("link_id", "dst")


def broken_links(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return links.broken(t.resolved(), t.notes).groupBy("title", "dst_name").agg(F.count(F.lit(1)).alias("n"))


def link_demand(spark: SparkSession, d: str) -> DataFrame:
    rows = links.demand(Tables(spark, d).resolved())
    return rows.select(F.array_join("spellings", "|").alias("spellings"), "demand")


def out_degrees(spark: SparkSession, d: str) -> DataFrame:
    return links.out_degrees(Tables(spark, d).resolved())


def hub_notes(spark: SparkSession, d: str) -> DataFrame:
    return links.out_degrees(Tables(spark, d).resolved()).filter(F.col("n_out") > search.HUB_CAP)


def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return vectors.missing_vectors(t.chunks, t.vectors)


def dead_vectors(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return vectors.dead_vectors(t.chunks, t.vectors)


def duplicate_chunks(spark: SparkSession, d: str) -> DataFrame:
    return health.duplicates(Tables(spark, d).chunks)


def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    """Names linked to from the documents, outside fences."""
    import pyarrow as pa

    from marlinspike.functions import markdown as M

    docs = Tables(spark, d).t("documents").filter("text is not null")
    return M.arrow_map(docs, ["doc_id", "text"], lambda i, x: [(i, k, n) for k, n in enumerate(M.links(x))], "doc_id long, pos int, name string", [pa.int64(), pa.int32(), pa.string()])


def markdown_notes(spark: SparkSession, d: str) -> DataFrame:
    """Every document parsed as a note: metadata and how many chunks and links it has."""
    docs = Tables(spark, d).t("documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return vault.parse(docs).select("path", "title", "type", "project", "date", F.size("chunks").alias("n_chunks"), F.size("names").alias("n_links"))


def shape_problems(spark: SparkSession, d: str) -> DataFrame:
    docs = Tables(spark, d).t("documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    return vault.shape_problems(docs).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


# --- search --------------------------------------------------------------------------


def _terms() -> list[search.Term]:
    return search.parse_terms(QUESTION, search.plain)


def _words(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Postings by term and lengths of all chunks, unstemmed, stored until the table changes."""
    put = Store(t.spark, "words", stamp(t.spark, f"{t.d}/chunks.parquet"))
    return put("posts", lambda: search.postings(t.chunks).sort("term")), put("lens", lambda: search.lengths(t.chunks))


def _found(t: Tables) -> DataFrame:
    return search.hits(_words(t)[0], _terms())


def term_df(spark: SparkSession, d: str) -> DataFrame:
    terms = _terms()
    names = F.array(*[F.lit(x.stem) for x in terms])
    return _found(Tables(spark, d)).groupBy("t").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")).select(F.element_at(names, F.col("t") + 1).alias("term"), "df", "tf")


def _stats(t: Tables) -> tuple[DataFrame, search.Stats]:
    found = _found(t)
    return found, search.term_stats(found, _words(t)[1].count(), len(_terms()))


def coverage_mass(spark: SparkSession, d: str) -> DataFrame:
    found, stats = _stats(Tables(spark, d))
    return search.coverage(found, stats).select("chunk_id", F.round("mass", 6).alias("mass"), "terms_matched", "content_matched")


def _ranked(t: Tables, n: int) -> DataFrame:
    """(chunk_id, bm25) of the n best chunks; the matches are written once and read by every step."""
    found = Workspace(t.spark).write(_found(t))
    lens = _words(t)[1]
    df = [0] * len(_terms())
    for r in found.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a term
        df[r.t] = r.n
    size = lens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg")).first()
    score = search.bm25(found, lens, df, size.n or 1, size.avg or 1.0)
    return score.select("chunk_id", F.round("bm25", 6).alias("bm25")).orderBy("bm25", "chunk_id").limit(n)


def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    """The best 50 chunks by BM25 over the whole table: a top-k report."""
    return _ranked(Tables(spark, d), 50)


def prefix_widening(spark: SparkSession, d: str) -> DataFrame:
    """What each word of the question is searched as, after widening."""
    t = Tables(spark, d)
    got = search.widen(_words(t)[0], search.parse_terms(QUESTION, search.plain))
    return spark.createDataFrame([(x.origin, x.stem, x.prefix) for x in got], "origin string, stem string, prefix boolean")


def _lanes(t: Tables) -> DataFrame:
    """The word pool and the meaning pool, fused."""
    words = _ranked(t, search.POOL).select(F.col("chunk_id").alias("id"), F.row_number().over(Window.orderBy("bm25", "chunk_id")).alias("rank"))
    near = t.spark.createDataFrame([], "id string, cosine double")
    for dim in _dims(t):  # a model for each length of vector, its first vector standing for the question
        own = t.vectors.filter(vectors.usable(F.col("vector"), F.col("dim")) & (F.col("dim") == dim)).select(F.col("hash").alias("id"), "vector")
        query = [float(x) for x in own.orderBy("id").limit(1).collect()[0].vector]
        near = near.unionByName(vectors.nearest_to(own, query, search.POOL))
    body = t.chunks.select(F.col("chunk_id"), F.sha2("body", 256).alias("hash"))
    best = near.join(body, near["id"] == body["hash"]).groupBy("chunk_id").agg(F.max("cosine").alias("cosine")).orderBy(F.desc("cosine"), "chunk_id").limit(search.POOL)
    ranked = best.select(F.col("chunk_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("cosine"), "chunk_id")).alias("rank"))
    return search.fuse(words, ranked)


def _dims(t: Tables) -> list[int]:
    """The lengths of the usable vectors, one for each model."""
    ok = t.vectors.filter(vectors.usable(F.col("vector"), F.col("dim")))
    return sorted(r.dim for r in ok.select("dim").distinct().collect())


def lane_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Word ranking of the question and meaning ranking of one vector a model, fused by reciprocal ranks."""
    return _lanes(Tables(spark, d)).select("id", F.round("fusion", 6).alias("fusion"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lexical_rank", "meaning_rank")])


def byte_budget(spark: SparkSession, d: str) -> DataFrame:
    """The first chunks of the fused order that fit into 8,000 bytes together, each with its title and heading path."""
    t = Tables(spark, d).stored()
    note = t.notes.select("note_id", "title")
    head = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit(" > "), "heading")).otherwise(F.lit(""))
    shown = F.trim(F.concat(F.coalesce("title", F.lit("")), head, F.lit("\n\n"), F.coalesce("body", F.lit(""))))
    sizes = t.chunks.join(note, "note_id", "left").select(F.col("chunk_id").alias("id"), F.octet_length(shown).alias("bytes"))
    top = _lanes(t).withColumn("fusion", F.round("fusion", 9)).join(sizes, "id")
    order = [F.desc("fusion"), F.coalesce("lexical_rank", F.lit(search.POOL + 1)), F.col("id")]
    return search.budget_prefix(top, order, 8000, F.col("bytes")).select(F.col("id").alias("chunk_id"), "bytes_so_far")


def _corpus(t: Tables, stem=None) -> search.Corpus:
    """The stored index of the tables, made anew when a file has changed; folded Porter stems unless another form is asked for."""
    mark = stamp(t.spark, *[f"{t.d}/{x}.parquet" for x in ("notes", "chunks", "links")])
    return search.Corpus(t.notes, t.chunks, t.resolved(), stem, Store(t.spark, "stemmed" if stem is None else "plain", mark))


def search_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole search, with stemmed words: fragments in order."""
    got = search.search(_corpus(Tables(spark, d)), QUESTION)
    rows = [(k, x["chunk_id"], x["path"], x["found_by"], float(x["score"]), x["terms_matched"], x["bytes"]) for k, x in enumerate(got["fragments"], 1)]
    return spark.createDataFrame(rows, "rank int, chunk_id long, path string, found_by string, score double, terms_matched int, bytes int")


def search_support(spark: SparkSession, d: str) -> DataFrame:
    """What the question's words find among own notes and among leads, and whether it counts as an answer; words unstemmed."""
    found = search.matches(_corpus(Tables(spark, d), search.plain), QUESTION, ("own", "lead"))
    rows = [(s, m.matched, len(m.terms), len(m.stats.content), int(m.best_content or 0), int(search.mass_share(m) * 1000), search.mass_share(m) >= search.WEAK_SHARE, len(m.pool)) for s, m in found.items()]
    return spark.createDataFrame(rows, "scope string, matched_chunks long, query_terms int, content_terms int, best_terms int, best_share int, supported boolean, pool int")


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """One hop from every godnote, hubs left out."""
    t = Tables(spark, d)
    seeds = t.notes.filter(F.lower("type") == "godnote").select(F.col("note_id").alias("note"), (1.0 / (F.pmod("note_id", F.lit(10)) + 1)).alias("score"))
    near, _ = search.neighbours(t.resolved(), seeds)
    return near.select("note", F.round("score", 6).alias("score"))


# --- vectors -------------------------------------------------------------------------


def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The 20 embeddings nearest to the first one."""
    e = Tables(spark, d).t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    query = [float(x) for x in e.orderBy("id").limit(1).collect()[0].vector]
    return vectors.nearest_to(e, query, 20)


def note_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Three coordinates of the normalised mean of every note, by model."""
    t = Tables(spark, d)
    out = [vectors.note_vectors(t.chunks, t.vectors, n).select("note_id", F.lit(n).alias("dim"), *[F.round(F.col("vector")[i], 6).alias(c) for i, c in ((0, "first"), (n // 2 - 1, "middle"), (n - 1, "last"))]) for n in _dims(t)]
    return _united(out, spark, "note_id long, dim int, first double, middle double, last double")


def _united(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def _centred(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = Tables(spark, d).t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return vectors.centred(e.select("id", "vector"), e.select("vector"), 64), e.select("id", "label")


def centred_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of centred embeddings over 0.3, within a label and across."""
    rows, label = _centred(spark, d)
    p = vectors.similar_pairs(rows, 0.3)
    p = p.join(label.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(label.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    return p.select("a", "b", F.round("sim", 6).alias("sim"), (F.col("la") != F.col("lb")).alias("across"))


def linkage_groups(spark: SparkSession, d: str) -> DataFrame:
    """Average-linkage groups of the embeddings, by their least member."""
    rows, _ = _centred(spark, d)
    g = vectors.groups_of_any(rows, 0.9)
    return g.groupBy("label").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size")).select("first_id", "size")


def plane_map(spark: SparkSession, d: str) -> DataFrame:
    """Two-dimensional map of the centred embeddings: principal directions, as the usual neighbour embedding is not portable."""
    return vectors.plane(_centred(spark, d)[0], 64)


# --- health and digest -----------------------------------------------------------------


def notes_by_type(spark: SparkSession, d: str) -> DataFrame:
    return health.by_type(Tables(spark, d).notes)


def totals(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    return health.totals(t.notes, t.chunks.select("chunk_id"), t.links.select("link_id"))


def islands(spark: SparkSession, d: str) -> DataFrame:
    """Notes cut off from the largest component of the graph of all resolved links."""
    t = Tables(spark, d)
    return health.islands(t.notes, t.resolved().filter("dst is not null"), Workspace(spark)).select("island", "size", "note_id")


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every connected part of the note graph with its size."""
    t = Tables(spark, d)
    return health.component_sizes(t.notes.select("note_id"), t.resolved().filter("dst is not null"), Workspace(spark))


def broken_list(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 broken links of the report, with how many there are."""
    t = Tables(spark, d)
    rows = links.broken(t.resolved(), t.notes).select(F.coalesce("title", F.lit("")).alias("title"), "dst_name")
    return health.counted(rows, ["title", "dst_name"])


def health_report(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of the whole report."""
    t = Tables(spark, d)
    ws = Workspace(spark)
    now = datetime.datetime(2024, 1, 29, tzinfo=datetime.timezone.utc)
    return health.report(t.notes, t.chunks.select("chunk_id"), ws.write(t.resolved()), _verdicts(spark, d), TODAY, now, ws)


def stale_notes(spark: SparkSession, d: str) -> DataFrame:
    return health.stale(Tables(spark, d).notes, TODAY)


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for p in zip(("click", "error", "purchase", "signup", "view"), health.VERDICTS) for x in p])
    return Tables(spark, d).t("events").select(F.col("ts").cast("timestamp").alias("ts"), kind[F.col("event_type")].alias("verdict"))


def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return health.feedback(_verdicts(spark, d), datetime.datetime(2024, 1, 29, tzinfo=datetime.timezone.utc))


def misses_due(spark: SparkSession, d: str) -> DataFrame:
    return health.misses_due(_verdicts(spark, d))


def fresh_gotchas(spark: SparkSession, d: str) -> DataFrame:
    return digest.gotchas(Tables(spark, d).notes, wanted=PROJECT, aliases=ALIASES)


def project_godnotes(spark: SparkSession, d: str) -> DataFrame:
    return digest.godnotes(Tables(spark, d).notes, PROJECT, ALIASES).withColumn("day", F.col("day").cast("string"))


def project_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The ten freshest session notes of every project."""
    n = Tables(spark, d).notes.filter(F.lower("type") == "session").withColumn("project", T.normalize_project(F.col("project"))).withColumn("day", T.iso_date(F.col("date")))
    return health.top_by(n, "project", [F.desc_nulls_last("day"), F.col("path")], 10).select("project", "path", "rank")


def open_threads(spark: SparkSession, d: str) -> DataFrame:
    """Open threads of the session notes. The bodies hold list items, so every second item stands for an open one."""
    t = Tables(spark, d)
    boxes = t.chunks.withColumn("body", F.regexp_replace("body", r"(?m)^- (?=[A-Z])", "- [ ] "))
    return digest.threads(t.notes, boxes, wanted=PROJECT, aliases=ALIASES).select("note_id", "pos", "item", "key")


def threads_by_project(spark: SparkSession, d: str) -> DataFrame:
    t = Tables(spark, d)
    boxes = t.chunks.withColumn("body", F.regexp_replace("body", r"(?m)^- (?=[A-Z])", "- [ ] "))
    return digest.by_project(digest.threads(t.notes, boxes), ALIASES)


# --- audit -----------------------------------------------------------------------------


def shared_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of notes of one project and day that no link joins and that share no neighbour."""
    t = Tables(spark, d)
    title = t.notes.filter("project <> ''").select("note_id", F.struct(T.normalize_project(F.col("project")).alias("p"), T.iso_date(F.col("date")).alias("d")).alias("k")).filter("k.d is not null")
    pairs = title.alias("x").join(title.alias("y"), "k").filter("x.note_id < y.note_id").select(F.col("x.note_id").alias("a"), F.col("y.note_id").alias("b")).distinct()
    edges = links.undirected(t.resolved())
    return links.without_common(links.without_links(pairs, edges), edges)


def meaning_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Similar live notes without a link, by model: across projects and inside one."""
    t = Tables(spark, d)
    ws = Workspace(spark)
    edges = ws.write(links.undirected(t.resolved()))
    out = []
    for n in _dims(t):
        centred = ws.write(audit.centred_pool(t.notes, vectors.note_vectors(t.chunks, t.vectors, n), n))
        out.append(audit.pairs(t.notes, vectors.similar_pairs(centred, 0.35), edges).select(F.lit(n).alias("dim"), "kind", "key", "a", "b", "sim"))
    return _united(out, spark, "dim int, kind string, key string, a long, b long, sim double")


def stale_signs(spark: SparkSession, d: str) -> DataFrame:
    """Notes that are no longer right, by all three signs.

    The bodies hold none, so signs stand in for them: every distinct link of a note is
    a claim to replace its target, each seventh note calls itself outdated and each
    eleventh carries a correction, a text each.
    """
    t = Tables(spark, d)
    own = t.t("links").select(F.col("src_note_id").alias("note_id"), "dst_name").distinct()  # takes out re-delivered rows too
    said = own.select("note_id", F.concat(F.lit("This supersedes [["), "dst_name", F.lit("]].")).alias("text"))
    marks = F.array(F.when(F.col("note_id") % 7 == 0, F.lit("Intro\n> **Устарело** с весны")), F.when(F.col("note_id") % 11 == 0, F.lit("Text\n## Поправка: not so\nmore")))
    more = t.notes.select("note_id", F.explode(marks).alias("text")).filter("text is not null")
    rows = audit.stale(t.notes, said.unionByName(more), links.latest_name_map(t.notes))
    return rows.select("key", "how", "old", F.coalesce("new", F.lit(0)).alias("new"), F.coalesce("correction", F.lit("")).alias("correction"))


def verdict_carry(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on notes that still hold: each third note has changed since, each fifth was decided by a user."""
    n = Tables(spark, d).notes.filter("path is not null")
    cand = n.select(F.col("note_id").cast("string").alias("key"), F.create_map("path", "sha256").alias("sha"))
    old = F.when(F.col("note_id") % 3 == 0, F.lit("changed")).otherwise(F.col("sha256"))
    verdicts = n.select(F.col("note_id").cast("string").alias("key"), F.lit("keep").alias("verdict"), (F.col("note_id") % 5 == 0).alias("decided"), F.create_map(F.col("path"), old).alias("sha"))
    return audit.standing(cand, verdicts).select("key", F.coalesce("verdict", F.lit("")).alias("verdict"), F.coalesce("decided", F.lit(False)).alias("decided"))


def finding_triage(spark: SparkSession, d: str) -> DataFrame:
    """Places of made-up findings, one a note."""
    i = F.col("note_id")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(i / 4) % len(xs) + 1).cast("int"))
    rows = Tables(spark, d).notes.select(
        F.element_at(F.array(*[F.lit(x) for x in ("group", "cross", "same", "stale")]), (i % 4 + 1).cast("int")).alias("kind"), i.cast("string").alias("key"), F.concat(F.lit("p"), (i % 50).cast("string")).alias("old_path"),
        (i % 8 < 5).alias("keep"), F.when(i % 3 == 0, F.lit("x")).alias("extend"), pick(audit.OLD, audit.REFINES, audit.DOUBLE, "мимо").alias("verdict"), (i % 7 < 3).alias("confirmed"), (i % 11 != 0).alias("read"), (i % 13 == 0).alias("decided"),
    )
    return audit.triage(rows).select("key", "place")


def reading_batches(spark: SparkSession, d: str) -> DataFrame:
    n = Tables(spark, d).notes.filter("died is null or died = ''").select("note_id")
    return audit.batches(n, "cross", "note_id", Workspace(spark)).groupBy("batch").agg(F.min("note_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def _projects(t: Tables) -> DataFrame:
    """Notes by project, standing in for groups of similar ones."""
    return t.notes.filter("project <> ''").select(F.col("note_id").alias("id"), T.normalize_project(F.col("project")).alias("label"))


def linked_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of notes of one project that a link joins, counted."""
    t = Tables(spark, d)
    return decisions.linked_pairs(_projects(t), links.undirected(t.resolved()))


def named_godnotes(spark: SparkSession, d: str) -> DataFrame:
    """The godnote a made-up reader names for every project: the title of its third godnote, without the genre prefix."""
    n = Tables(spark, d).notes.filter("lower(type) = 'godnote' and coalesce(title, '') <> ''")
    near = n.select(T.normalize_project(F.col("project")).alias("key"), F.col("note_id").alias("god"), "title")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("god")))
    return decisions.named_godnotes(near.filter("rank = 3").select("key", T.bare_title(F.col("title")).alias("extend")), near)


def page_changes(spark: SparkSession, d: str) -> DataFrame:
    """A made-up page against now: each third note was not shown, each fourth is gone, each fifth has changed, each seventh has another verdict."""
    n = Tables(spark, d).notes.filter("path is not null")
    i = F.col("note_id")
    row = lambda sha, verdict: [i.cast("string").alias("key"), F.create_map(F.col("path"), sha).alias("sha"), verdict.alias("verdict")]
    shown = n.filter(i % 3 != 0).select(*row(F.when(i % 5 == 0, F.lit("old")).otherwise(F.col("sha256")), F.lit("keep")))
    now = n.filter(i % 4 != 0).select(*row(F.col("sha256"), F.when(i % 7 == 0, F.lit("drop")).otherwise(F.lit("keep"))))
    return decisions.page_changes(shown, now)


def thread_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What threads name outside the vault, by kind; the tables name nothing, so a made-up line a note does."""
    n = Tables(spark, d).notes
    line = F.concat(F.lit("close team/"), T.normalize_project(F.col("project")), F.lit("#"), F.col("note_id").cast("string"), F.lit(" and #12, landed in "), F.substring("sha256", 1, 10))
    rows = n.select("note_id", F.explode(T.evidence(line)).alias("e"))
    return rows.groupBy("e.kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("e.reference").alias("n_distinct"), F.count_distinct("note_id").alias("n_notes"))


def thread_closures(spark: SparkSession, d: str) -> DataFrame:
    """Journal rows that close a thread a note: the titles stand in for the lines."""
    rows = Tables(spark, d).notes.select(F.coalesce("title", F.lit("")).alias("line"), F.lit("done").alias("reason"))
    return journal.closing_rows(rows, TODAY)


def packed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every usable vector as half floats and back: its bytes, and whether all numbers are within their rounding."""
    v = Tables(spark, d).vectors
    v = v.filter(vectors.usable(F.col("vector"), F.col("dim"))).select("hash", "dim", "vector", vectors.packed(F.col("vector")).alias("blob"))
    back = v.withColumn("back", vectors.unpacked(F.col("blob"), F.col("dim")))
    near = F.forall(F.zip_with("vector", "back", lambda a, b: F.abs(a - b) <= F.abs(a) * 0.0005 + 0.0000001), lambda x: x)
    return back.select("hash", F.octet_length("blob").alias("bytes"), near.alias("near"))


# --- sessions --------------------------------------------------------------------------


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the flat store as turns (session_id, pos, role, text); the role and text of well-formed ones.

    pos counts from 0 by (time_created, id), so messages of one time are turns of
    their own; those without a time come first, as where the store is read.
    """
    m = Tables(spark, d).t("message").select("id", "session_id", "time_created", "data").distinct().filter("session_id is not null")
    v = F.try_parse_json("data")
    at = [F.col("time_created").alias("_time"), F.coalesce("id", F.lit("")).alias("_id"), F.when(F.col("id").isNull(), F.col("data")).alias("_data")]  # unique in a session even without ids
    rows = m.select("session_id", *at, F.try_variant_get(v, "$.role", "string").alias("role"), sessions.message_text(v).alias("text"), F.lit(1).cast("long").alias("_one"))
    placed = prefix_sum(rows.filter("role is not null"), ["session_id"], ["_time", "_id", "_data"], "_one", "pos", Workspace(spark))
    return placed.select("session_id", "pos", "role", "text")


def session_facts(spark: SparkSession, d: str) -> DataFrame:
    f = sessions.facts(_turns(spark, d))
    return f.select("session_id", "turns", "user_turns", F.length("first_message").alias("first_length"))


def role_totals(spark: SparkSession, d: str) -> DataFrame:
    return sessions.role_totals(_turns(spark, d)).select("role", "turns")


def session_split(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at most 2,000 characters of every session, and how many turns each has."""
    return sessions.split(_turns(spark, d), 2000).groupBy("session_id", "piece").agg(F.count(F.lit(1)).alias("turns"))


def session_render(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    return sessions.render(t, sessions.split(t, 2000)).select("session_id", "piece", F.sha2("text", 256).alias("sha256"))


def unclosed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the tree store nobody closed; those of one directory count as dismissed."""
    t = Tables(spark, d)
    turns = t.t("message_nodes").select("session_id", "node_id").distinct().groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))
    s = t.t("sessions").withColumnRenamed("id", "session_id")
    rows = s.join(turns, "session_id", "left").select("session_id", F.col("last_activity_at").alias("last_activity"), F.coalesce("turns", F.lit(0)).alias("turns"), (F.coalesce("hidden", F.lit(0)) == 0).alias("interactive"))
    return sessions.unclosed(rows, NOW, s.filter("working_directory = '/work/Brindle'").select("session_id")).select("session_id", "turns")


def activity_windows(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a user's events with gaps under 30 minutes; the stream's form is in streaming.journals."""
    e = Tables(spark, d).t("events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    out = e.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "n")


def context_alarms(spark: SparkSession, d: str) -> DataFrame:
    """Marks the users' summed event values cross, each told once."""
    e = Tables(spark, d).t("events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("at"), "value")
    run = F.sum(F.round(F.col("value") * 5000).cast("long")).over(Window.partitionBy("session_id").orderBy("at").rowsBetween(-40, 0))
    rows = e.select("session_id", "at", run.alias("used"))
    return guard.batch_alarms(rows, 1_000_000).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


_ALL = (
    text_functions, token_counts, link_resolution, broken_links, link_demand, out_degrees, hub_notes, missing_vectors, dead_vectors, duplicate_chunks,
    markdown_links, markdown_notes, shape_problems, term_df, coverage_mass, bm25_top, prefix_widening, lane_fusion, byte_budget, search_report, search_support,
    graph_neighbours, knn_cosine, note_vectors, centred_pairs, linkage_groups, plane_map, notes_by_type, totals, islands, component_sizes, stale_notes, verdict_counts,
    misses_due, fresh_gotchas, project_godnotes, project_sessions, open_threads, threads_by_project, shared_neighbours, meaning_pairs, stale_signs,
    broken_list, health_report, linked_pairs, named_godnotes, page_changes, thread_evidence, thread_closures, packed_vectors, verdict_carry, finding_triage, reading_batches, session_facts, role_totals, session_split, session_render, unclosed_sessions, activity_windows, context_alarms,
)
QUERIES = {f.__name__: f for f in _ALL}
