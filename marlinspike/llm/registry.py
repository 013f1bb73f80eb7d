"""Queries of the text problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.llm import conversations, leakage, mixing, nearest, neardup, pieces, spans
from marlinspike.plans.workspace import Workspace


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), "text")


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 most similar of every vector whose hash, read as a number, is divisible by 100."""
    rows = _valid_vectors(spark, d)
    parts = [F.conv(F.substring("id", 8 * i + 1, 8), 16, 10).cast("long") * (pow(2, 32 * (7 - i)) % 100) for i in range(8)]
    asked = rows.filter(sum(parts[1:], parts[0]) % 100 == 0)
    best = nearest.most_similar(rows, 5, -1.0, Workspace(spark), asked=asked)
    return best.select(F.col("id").alias("hash"), F.col("other").alias("neighbour"), F.round("cosine", 6).alias("cosine"), "rank")


def _mix(spark: SparkSession, d: str, moving: bool = False) -> tuple[DataFrame, DataFrame]:
    """Demand and mixture; ``moving``: from equal weights at the start straight to the targets at half time."""
    ws = Workspace(spark)
    name = F.lower(F.trim("source"))
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("id"), name.alias("source"), "text")
    targets = spark.read.parquet(f"{d}/mix_targets.parquet").withColumn("source", name)
    sized = ws.write(mixing.sizes(docs))
    knots = targets.select("source", F.lit(0.0).alias("t"), "weight")
    if moving:
        total = targets.agg(F.sum("weight"), F.count(F.lit(1))).first()
        even = targets.select("source", F.lit(0.0).alias("t"), F.lit((total[0] or 0.0) / max(total[1], 1)).alias("weight"))
        knots = even.unionByName(knots.withColumn("t", F.lit(0.5))).unionByName(knots.withColumn("t", F.lit(1.0)))
    plan = ws.write(mixing.demand(sized, knots, targets))
    return plan, ws.write(mixing.mixture(sized, plan, ws)) if moving else mixing.mixture(sized, plan, ws)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1].select(F.col("id").alias("doc_id"), "source", "copy", "tokens", "position")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mix(spark, d))


def p8_curriculum(spark: SparkSession, d: str) -> DataFrame:
    """Shares by quarter of the training time of a mixture whose weights move."""
    return mixing.shares_by_time(*_mix(spark, d, moving=True))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark)
    pairs, same = spans.shared_pairs(_documents(spark, d), 200, ws)
    return spans.expand(pairs, same, ws).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    found, same = spans.shared_windows(docs, 200, Workspace(spark))
    out = spans.coverage(docs, found, same)
    return out.select(F.col("id").alias("doc_id"), "n_chars", "shared_chars", "shared_part", F.to_json("stretches").alias("stretches"))


def _sessions(spark: SparkSession, d: str, with_text: bool) -> tuple[DataFrame, DataFrame, Workspace]:
    """All ordered messages, and the sessions to drop."""
    ws = Workspace(spark)
    t = lambda name: spark.read.parquet(f"{d}/{name}.parquet")
    nodes = t("message_nodes").select(F.col("session_id").alias("session"), F.col("node_id").alias("node"), F.col("parent_node_id").alias("parent"), F.col("chat_message").alias("message"))
    heads = t("sessions").select(F.col("id").alias("session"), F.col("main_chain_id").alias("leaf"))
    flat = t("message").select("id", F.col("session_id").alias("session"), F.col("time_created").alias("time"), F.col("data").alias("message"))
    flat_heads = t("session_v2").select(F.col("id").alias("session"))
    tree = conversations.tree_messages(nodes, heads.filter("session is not null"), ws, with_text)
    both = tree.unionByName(conversations.flat_messages(flat, with_text))
    both = ws.write(both)
    known = heads.select("session").unionByName(flat_heads)
    ids = known.unionByName(nodes.select("session")).unionByName(flat.select("session"))
    return both, conversations.dropped(known, both, ids, ws), ws


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    _, bad, _ = _sessions(spark, d, with_text=False)
    return bad.select(F.col("session").alias("session_id"))


def p1_faults(spark: SparkSession, d: str) -> DataFrame:
    """Dropped sessions by reason."""
    _, bad, _ = _sessions(spark, d, with_text=False)
    return bad.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    messages, bad, ws = _sessions(spark, d, with_text=True)
    return conversations.turns(messages, bad, ws).withColumnRenamed("session", "session_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/chunks.parquet").select("id", F.col("body").alias("text"))
    return pieces.oversized(rows).select(F.col("id").alias("chunk_id")).distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.rechunk(spark.read.parquet(f"{d}/chunks.parquet"), Workspace(spark)).withColumnRenamed("id", "chunk_id")


def p5_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of a cut chunk give together: its bytes and digest, and whether all pieces keep the limits."""
    got = pieces.oversized(spark.read.parquet(f"{d}/chunks.parquet").select("id", F.col("body").alias("text"))).distinct()
    new = F.expr("decode(substring(encode(text, 'UTF-8'), repeated + 1), 'UTF-8')")
    kept = (F.octet_length("text") <= 1200) & (F.col("repeated") <= 120)
    each = got.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece", new.alias("t")))).alias("s"), F.min(kept).alias("within"))
    text = F.array_join(F.transform("s", lambda x: x["t"]), "")
    return each.select(F.col("id").alias("chunk_id"), F.octet_length(text).alias("bytes"), F.sha2(text, 256).alias("sha256"), "within")


def _edited(spark: SparkSession, d: str) -> list[tuple[str, DataFrame, neardup.Plan]]:
    """The two kinds of text, as (field, rows (id, text), plan)."""
    bodies = spark.read.parquet(f"{d}/chunks.parquet").select("id", F.col("body").alias("text"))
    titles = spark.read.parquet(f"{d}/notes.parquet").select("id", F.col("title").alias("text"))
    return [("chunks.body", bodies, neardup.BODIES), ("notes.title", titles, neardup.TITLES)]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark)
    out = [spans.expand(*neardup.near_duplicates(rows, plan, ws), ws).select(F.lit(f).alias("field"), F.col("a").alias("id_a"), F.col("b").alias("id_b")) for f, rows, plan in _edited(spark, d)]
    return out[0].unionByName(out[1])


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark)
    out = [neardup.groups(rows, plan, ws).select(F.lit(f).alias("field"), "id", F.col("group").alias("group_id")) for f, rows, plan in _edited(spark, d)]
    return out[0].unionByName(out[1])


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/eval_items.parquet").select(F.col("item_id").alias("id"), "text")
    return leakage.leaks(_documents(spark, d), items, Workspace(spark))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("id").alias("doc_id"), "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items: in how many documents, and the most runs of 12 words any holds."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("shared_runs").alias("most_runs"))


def _valid_vectors(spark: SparkSession, d: str) -> DataFrame:
    return nearest.valid(spark.read.parquet(f"{d}/chunk_vectors.parquet"), "hash", "vector", F.col("dim"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    best = nearest.most_similar(_valid_vectors(spark, d), 5, 0.90, Workspace(spark))
    return best.select(F.least("id", "other").alias("hash_a"), F.greatest("id", "other").alias("hash_b")).distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_faults, p1_conversations, p3_found, p3_groups, p5_found, p5_pieces, p5_roundtrip, p6_found, p6_neighbours, p7_found, p7_items, p8_mixture, p8_shares, p8_curriculum, p9_found, p9_shared)}

_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"

_NEAR = f"""
WITH RECURSIVE b AS (SELECT DISTINCT id, {_WORDS.replace("text", "body")} AS w FROM chunks WHERE body IS NOT NULL),
bs AS (SELECT DISTINCT id, array_to_string(w[k : k + 2], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS k FROM b WHERE len(w) >= 20)),
t AS (SELECT id, array_to_string({_WORDS.replace("text", "title")}, ' ') AS w FROM notes WHERE title IS NOT NULL),
ts AS (SELECT DISTINCT id, substr(w, k, 3) AS s FROM (SELECT id, w, unnest(range(1, length(w) - 1)) AS k FROM t)),
bn AS (SELECT id, count(*) AS n FROM bs GROUP BY 1), tn AS (SELECT id, count(*) AS n FROM ts GROUP BY 1),
bp AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM bs x JOIN bs y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
tp AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM ts x JOIN ts y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
p AS (SELECT 'chunks.body' AS field, a AS id_a, b AS id_b FROM bp JOIN bn x ON x.id = a JOIN bn y ON y.id = b WHERE bp.n / (x.n + y.n - bp.n) >= 0.5
  UNION ALL SELECT 'notes.title', a, b FROM tp JOIN tn x ON x.id = a JOIN tn y ON y.id = b WHERE tp.n / (x.n + y.n - tp.n) >= 0.6)
"""

_TALK = """
WITH RECURSIVE n AS (SELECT DISTINCT session_id AS s, node_id AS n, parent_node_id AS p, chat_message AS m FROM message_nodes),
c AS (SELECT h.id AS s, n.n, n.p, n.m, 0 AS d FROM sessions h JOIN n ON n.s = h.id AND n.n = h.main_chain_id
  UNION ALL SELECT c.s, n.n, n.p, n.m, d + 1 FROM c JOIN n ON n.s = c.s AND n.n = c.p WHERE d < 5000 AND d <= (SELECT count(*) FROM n x WHERE x.s = c.s)),
raw AS (SELECT s, CAST(-d AS BIGINT) AS o1, '' AS o2, m, (p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.s = c.s AND n.n = c.p)) OR d >= (SELECT count(*) FROM n x WHERE x.s = c.s) AS bad FROM c
  UNION ALL SELECT session_id, epoch_us(time_created), id, data, time_created IS NULL FROM (SELECT DISTINCT * FROM message) WHERE session_id IS NOT NULL),
j AS (SELECT s, o1, o2, bad, coalesce(json_valid(m) AND json_type(CASE WHEN json_valid(m) THEN m END) = 'OBJECT', false) AS ok, CASE WHEN json_valid(m) THEN CAST(m AS JSON) END AS m FROM raw),
t AS (SELECT s, o1, o2, bad, ok, CASE WHEN ok THEN m ->> '$.role' END AS role,
  CASE WHEN NOT ok THEN NULL WHEN json_type(m, '$.content') = 'VARCHAR' THEN m ->> '$.content'
    WHEN json_type(m, '$.content') = 'ARRAY' THEN array_to_string(list_transform(list_filter(CAST(m -> '$.content' AS JSON[]), lambda x: x ->> '$.type' = 'text'), lambda x: x ->> '$.text'), '') END AS text FROM j),
turns AS (SELECT s, o1, o2, role, text, lead(role) OVER (PARTITION BY s ORDER BY o1, o2) AS after FROM t WHERE role IN ('user', 'assistant') AND trim(text, E' \t\n\r\u00a0') <> ''),
good AS (SELECT s FROM t GROUP BY 1 HAVING NOT bool_or(bad) AND bool_and(ok)),
kept AS (SELECT s FROM turns GROUP BY 1 HAVING NOT bool_or(role = 'user' AND (after IS NULL OR after = 'user')) INTERSECT SELECT s FROM good
  INTERSECT (SELECT id FROM sessions UNION SELECT id FROM session_v2))
"""

SQL = {
    "p1_found": _TALK + "SELECT id AS session_id FROM sessions UNION SELECT id FROM session_v2 UNION SELECT session_id FROM message_nodes UNION SELECT session_id FROM message WHERE session_id IS NOT NULL EXCEPT SELECT s FROM kept",
    "p1_conversations": _TALK + "SELECT s AS session_id, row_number() OVER (PARTITION BY s ORDER BY o1, o2) - 1 AS pos, role, text FROM turns WHERE s IN (SELECT s FROM kept)",
    "p1_faults": _TALK
    + """, why AS (SELECT s, min(f) AS f FROM (
  SELECT s, CASE WHEN d >= (SELECT count(*) FROM n x WHERE x.s = c.s) THEN 'loop' WHEN p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n WHERE n.s = c.s AND n.n = c.p) THEN 'orphan' END AS f FROM c
  UNION ALL SELECT id, 'no leaf' FROM sessions h WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.s = h.id AND n.n = h.main_chain_id)
  UNION ALL SELECT session_id, 'no time' FROM message WHERE time_created IS NULL) GROUP BY 1),
k AS (SELECT id AS s FROM sessions UNION SELECT id FROM session_v2), g AS (SELECT s, bool_and(ok) AS ok FROM t GROUP BY 1),
u AS (SELECT s, bool_or(role = 'user' AND (after IS NULL OR after = 'user')) AS mute FROM turns GROUP BY 1),
f AS (SELECT k.s, coalesce(f, CASE WHEN NOT ok THEN 'unreadable' WHEN mute IS NULL THEN 'empty' WHEN mute THEN 'no reply' END) AS fault
  FROM k LEFT JOIN why USING (s) LEFT JOIN g USING (s) LEFT JOIN u USING (s)
  UNION ALL SELECT s, 'no session' FROM (SELECT session_id AS s FROM message_nodes UNION SELECT session_id FROM message) WHERE s NOT IN (SELECT s FROM k))
SELECT fault, count(*) AS n FROM f WHERE fault IS NOT NULL AND s IS NOT NULL GROUP BY 1""",
    "p5_roundtrip": "SELECT DISTINCT id AS chunk_id, strlen(body) AS bytes, sha256(body) AS sha256, true AS within FROM chunks WHERE strlen(body) > 1200",
    "p5_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE strlen(body) > 1200",
    "p3_found": _NEAR + "SELECT * FROM p",
    "p3_groups": _NEAR
    + """, l AS (SELECT field, id_a AS x, id_b AS y FROM p UNION SELECT field, id_b, id_a FROM p),
r AS (SELECT field, x, x AS y FROM l UNION SELECT r.field, r.x, l.y FROM r JOIN l ON l.field = r.field AND l.x = r.y)
SELECT field, x AS id, min(y) AS group_id FROM r GROUP BY 1, 2""",
    "p6_found": """
WITH v AS (SELECT hash, dim, CAST(vector AS DOUBLE[]) AS x FROM chunk_vectors
  WHERE len(vector) = dim AND list_bool_and(list_transform(vector, lambda y: isfinite(y))) AND list_bool_or(list_transform(vector, lambda y: y <> 0))),
c AS (SELECT a.hash AS h, b.hash AS o, list_cosine_similarity(a.x, b.x) AS c FROM v a JOIN v b ON a.dim = b.dim AND a.hash <> b.hash),
k AS (SELECT h, o, c FROM c QUALIFY row_number() OVER (PARTITION BY h ORDER BY c DESC, o) <= 5)
SELECT DISTINCT least(h, o) AS hash_a, greatest(h, o) AS hash_b FROM k WHERE c >= 0.90""",
    "p6_neighbours": f"""
WITH v AS (SELECT hash, dim, CAST(vector AS DOUBLE[]) AS x FROM chunk_vectors
  WHERE len(vector) = dim AND list_bool_and(list_transform(vector, lambda y: isfinite(y))) AND list_bool_or(list_transform(vector, lambda y: y <> 0))),
q AS (SELECT * FROM v WHERE ({" + ".join(f"('0x' || substr(hash, {8 * i + 1}, 8))::BIGINT * {pow(2, 32 * (7 - i)) % 100}" for i in range(8))}) % 100 = 0)
SELECT a.hash, b.hash AS neighbour, round(list_cosine_similarity(a.x, b.x), 6) AS cosine,
  row_number() OVER (PARTITION BY a.hash ORDER BY round(list_cosine_similarity(a.x, b.x), 9) DESC, b.hash) AS rank
FROM q a JOIN v b ON a.dim = b.dim AND a.hash <> b.hash QUALIFY rank <= 5""",
    "p7_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p7_items": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dg AS (SELECT doc_id, k, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
p AS (SELECT doc_id, item_id, count(*) AS n FROM dg JOIN ig USING (g) GROUP BY ALL)
SELECT item_id, count(*) AS n_docs, max(n) AS most_runs FROM p GROUP BY 1""",
    "p9_found": """
WITH g AS (SELECT DISTINCT doc_id, hash(substr(text, i, 200)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p9_shared": """
WITH g AS (SELECT doc_id, i, hash(substr(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 200)),
c AS (SELECT h FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT doc_id, i FROM g JOIN c USING (h))),
r AS (SELECT doc_id, min(i) - 1 AS lo, max(i) + 199 AS hi FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s) GROUP BY doc_id, k),
e AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n, CAST(to_json(list(struct_pack(lo := lo, hi := hi) ORDER BY lo)) AS VARCHAR) AS stretches FROM r GROUP BY 1)
SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n, 0) AS shared_chars, CASE WHEN length(text) > 0 THEN round(coalesce(n, 0) / length(text), 6) END AS shared_part,
  coalesce(stretches, '[]') AS stretches FROM (SELECT DISTINCT doc_id, text FROM documents) LEFT JOIN e USING (doc_id)""",
}
