"""DuckDB SQL for the queries of ``queries``."""

from marlinspike.operators.health import VERDICTS
from marlinspike.operators.search import parse_terms, plain
from marlinspike.queries import QUESTION

_C = "c AS (SELECT DISTINCT id AS chunk_id, note_id, body, ord FROM chunks)"
_RAW = "l0 AS (SELECT DISTINCT link_id, src_note_id AS src, dst_name, dst_note_id_or_null AS dst FROM links)"
_W = "regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')"
_P = "p AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(" + _W + ") AS term FROM c) GROUP BY 1, 2)"
_Q = "q(t, stem, prefix) AS (VALUES " + ", ".join(f"({i}, '{t.stem}', {str(t.prefix).lower()})" for i, t in enumerate(parse_terms(QUESTION, plain))) + ")"
_H = "h AS (SELECT t, chunk_id, sum(tf) AS tf FROM p JOIN q ON CASE WHEN prefix THEN starts_with(term, stem) ELSE term = stem END GROUP BY 1, 2)"
_HITS = f"WITH {_C}, {_P}, {_Q}, {_H}"
_STATS = f"""{_HITS}, n AS (SELECT count(*) AS n FROM c), d AS (SELECT t, count(*) AS df FROM h GROUP BY 1),
w AS (SELECT q.t, coalesce(df, 0) AS df, ln(1 + n / (1 + coalesce(df, 0))) AS idf, coalesce(df, 0) <= greatest(n * 0.05, 20) AS content FROM q LEFT JOIN d USING (t), n)"""
_BM25 = f"""{_STATS}, len AS (SELECT c.chunk_id, coalesce(sum(tf), 0) AS dl FROM c LEFT JOIN p USING (chunk_id) GROUP BY 1), a AS (SELECT avg(dl) AS avgdl FROM len),
s AS (SELECT h.chunk_id, round(-sum(CASE WHEN n - df + 0.5 > 0 THEN greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) ELSE 1e-6 END
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM h JOIN w USING (t) JOIN len ON len.chunk_id = h.chunk_id, n, a GROUP BY 1),
top AS (SELECT * FROM s ORDER BY bm25, chunk_id LIMIT 500)"""
_NORM = "trim(regexp_replace(lower(coalesce(project, '')), '[^a-z0-9]+', '-', 'g'), '-')"
_DAY = "CASE WHEN regexp_matches(left({0}, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(left({0}, 10) AS DATE) END"
_STEM = "regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1')"
_SHOWN = "CASE WHEN length({0}) > {1} THEN left({0}, {1} - 1) || '…' ELSE {0} END"
_BARE = "coalesce(nullif(trim(CASE WHEN strpos({0}, ' — ') > 0 THEN substr({0}, strpos({0}, ' — ') + 3) ELSE {0} END), ''), {0})"
_OK = "vector IS NOT NULL AND dim > 0 AND len(vector) = dim AND list_bool_and(list_transform(vector, lambda x: isfinite(x)))"
_ALIAS = "CASE WHEN trim(aliases) LIKE '[%' THEN coalesce(CAST(try_cast(aliases AS JSON) AS VARCHAR[]), [aliases]) WHEN trim(coalesce(aliases, '')) = '' THEN [] ELSE [aliases] END"
_NAMES = f"""own AS (SELECT DISTINCT id, lower(upper(x)) AS name FROM (SELECT id, unnest([title, {_STEM}, regexp_replace(path, '\\.md$', ''), split_part(path, '/', -1), path]) AS x FROM notes) WHERE x <> ''),
al AS (SELECT DISTINCT id, lower(upper(trim(x))) AS name FROM (SELECT id, unnest({_ALIAS}) AS x FROM notes) WHERE trim(x) <> ''),
nm AS (SELECT name, min(id) AS dst FROM own GROUP BY 1 HAVING count(DISTINCT id) = 1
  UNION ALL SELECT name, min(id) FROM al WHERE name NOT IN (SELECT name FROM own) GROUP BY 1 HAVING count(DISTINCT id) = 1)"""
_L = f"{_RAW}, {_NAMES}, l AS (SELECT link_id, src, dst_name, coalesce(l0.dst, nm.dst) AS dst FROM l0 LEFT JOIN nm ON nm.name = lower(upper(trim(dst_name))))"
_LATEST = f"""ow AS (SELECT name, max(id) AS dst FROM (SELECT id, lower(upper(unnest([title, {_STEM}, regexp_replace(path, '\\.md$', ''), path]))) AS name FROM notes) WHERE name <> '' GROUP BY 1),
la AS (SELECT * FROM ow UNION ALL SELECT name, max(id) FROM (SELECT id, lower(upper(trim(unnest({_ALIAS})))) AS name FROM notes) WHERE name <> '' AND name NOT IN (SELECT name FROM ow) GROUP BY 1)"""
_PARTS = """k AS (SELECT DISTINCT src AS u, dst AS v FROM l WHERE src IN (SELECT id FROM notes) AND dst IN (SELECT id FROM notes)),
e AS (SELECT u, v FROM k UNION SELECT v, u FROM k), r AS (SELECT id, id AS x FROM notes UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.x),
g AS (SELECT id, min(x) AS island FROM r GROUP BY 1), s AS (SELECT island, count(*) AS size FROM g GROUP BY 1)"""
_EDGES = f"e AS (SELECT DISTINCT src AS a, dst AS b FROM l WHERE dst IS NOT NULL AND src <> dst UNION SELECT DISTINCT dst, src FROM l WHERE dst IS NOT NULL AND src <> dst)"
_EMB = """v AS (SELECT vec_id AS id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT i, avg(x) AS m FROM v GROUP BY 1), z AS (SELECT id, label, list(x - m ORDER BY i) AS x FROM v JOIN m USING (i) GROUP BY 1, 2)"""
_NOTEV = f"""k AS (SELECT note_id, dim, CAST(vector AS DOUBLE[]) AS x FROM c JOIN chunk_vectors ON hash = sha256(body) WHERE {_OK}),
f AS (SELECT note_id, dim, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM k), ga AS (SELECT note_id, dim, i, avg(x) AS x FROM f GROUP BY 1, 2, 3),
nv AS (SELECT note_id, dim, list(x ORDER BY i) AS x FROM ga GROUP BY 1, 2), nu AS (SELECT note_id, dim, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x FROM nv WHERE list_dot_product(x, x) > 0)"""
_TURNS = """r AS (SELECT DISTINCT id, session_id, epoch_us(time_created) AS tm, data, m ->> '$.role' AS role,
    CASE json_type(m, '$.content') WHEN 'VARCHAR' THEN m ->> '$.content'
      WHEN 'ARRAY' THEN array_to_string(list_transform(list_filter(CAST(m -> '$.content' AS JSON[]), lambda x: x ->> '$.type' = 'text'), lambda x: x ->> '$.text'), chr(10)) END AS text
  FROM (SELECT *, CASE WHEN json_valid(data) THEN CAST(data AS JSON) END AS m FROM message) WHERE session_id IS NOT NULL),
t AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY tm NULLS FIRST, coalesce(id, ''), CASE WHEN id IS NULL THEN data END NULLS FIRST) - 1 AS pos, role, text FROM r WHERE role IS NOT NULL)"""
_SPLIT = f"""{_TURNS}, z AS (SELECT session_id, pos, coalesce(length(text), 0) AS n, sum(coalesce(length(text), 0)) OVER (PARTITION BY session_id) AS whole FROM t),
y AS (SELECT *, CASE WHEN whole <= 2000 THEN 1 ELSE greatest(2, ceil(whole / 2000)) END AS parts FROM z),
w AS (SELECT session_id, pos, n AS used, 0 AS piece FROM y WHERE pos = 0
  UNION ALL SELECT y.session_id, y.pos, CASE WHEN w.used >= whole / parts AND w.piece < parts - 1 THEN n ELSE w.used + n END,
    CASE WHEN w.used >= whole / parts AND w.piece < parts - 1 THEN w.piece + 1 ELSE w.piece END FROM w JOIN y ON y.session_id = w.session_id AND y.pos = w.pos + 1)"""
_LANES = f"""lex AS (SELECT chunk_id AS id, row_number() OVER (ORDER BY bm25, chunk_id) AS rank FROM top),
v AS (SELECT hash, dim, CAST(vector AS DOUBLE[]) AS x FROM chunk_vectors WHERE {_OK}), one AS (SELECT dim, min_by(x, hash) AS y FROM v GROUP BY 1),
nr AS (SELECT hash, round(coalesce(CASE WHEN list_dot_product(x, x) > 0 THEN list_cosine_similarity(x, y) END, 0), 6) AS cosine FROM v JOIN one USING (dim)
  QUALIFY row_number() OVER (PARTITION BY dim ORDER BY cosine DESC, hash) <= 500),
b AS (SELECT chunk_id, max(cosine) AS cosine FROM nr JOIN c ON sha256(body) = hash GROUP BY 1 ORDER BY cosine DESC, chunk_id LIMIT 500),
mn AS (SELECT chunk_id AS id, row_number() OVER (ORDER BY cosine DESC, chunk_id) AS rank FROM b),
fu AS (SELECT id, coalesce(1.0 / (10 + lex.rank), 0) + coalesce(1.2 / (10 + mn.rank), 0) AS fusion, lex.rank AS lexical_rank, mn.rank AS meaning_rank FROM lex FULL JOIN mn USING (id))"""


_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
#: Of numbered lines ``li`` (d, n, line): those outside fences, as ``see``.
_UNFENCED = """fe AS (SELECT d, n, row_number() OVER (PARTITION BY d ORDER BY n) AS k, regexp_extract(line, '^\\s*(`{3,}|~{3,})', 1) AS mark, trim(regexp_extract(line, '^\\s*(?:`{3,}|~{3,})(.*)$', 1), E' \\t\\r') AS rest
  FROM li WHERE regexp_matches(line, '^\\s*(`{3,}|~{3,})')),
st AS (SELECT d, n, k, mark AS opener FROM fe WHERE k = 1 UNION ALL SELECT fe.d, fe.n, fe.k, CASE WHEN opener = '' THEN mark WHEN starts_with(mark, opener) AND rest = '' THEN '' ELSE opener END FROM st JOIN fe ON fe.d = st.d AND fe.k = st.k + 1),
see AS (SELECT li.d, li.n, line FROM li ASOF LEFT JOIN st ON st.d = li.d AND st.n <= li.n WHERE coalesce(opener, '') = '' AND NOT regexp_matches(line, '^\\s*(`{3,}|~{3,})'))"""
_LINKS = f"""li AS (SELECT doc_id AS d, generate_subscripts(a, 1) AS n, unnest(a) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '{_BREAK}') AS a FROM documents WHERE text IS NOT NULL)), {_UNFENCED},
nl AS (SELECT d, generate_subscripts(x, 1) AS n, trim(split_part(split_part(unnest(x), '|', 1), '#', 1), E' \\t\\n\\r' || chr(160)) AS name FROM (SELECT d, regexp_extract_all(string_agg(line, chr(10) ORDER BY n), '!?\\[\\[([^\\]]+)\\]\\]', 1) AS x FROM see GROUP BY 1))"""
_THREADS = f"""ss AS (SELECT id, path, coalesce(project, '') AS project FROM notes WHERE lower(type) = 'session'),
bo AS (SELECT note_id AS d, ord, c.chunk_id, generate_subscripts(a, 1) AS i, unnest(a) AS raw FROM (SELECT note_id, ord, chunk_id, regexp_split_to_array(body, '{_BREAK}') AS a FROM c WHERE body IS NOT NULL AND note_id IN (SELECT id FROM ss)) c),
li AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY ord, chunk_id, i) AS n, CASE WHEN regexp_matches(raw, '^- [A-Z]') THEN '- [ ] ' || substr(raw, 3) ELSE raw END AS line FROM bo), {_UNFENCED},
it AS (SELECT d, row_number() OVER (PARTITION BY d ORDER BY n) - 1 AS pos, trim(regexp_replace(substr(line, 3), '[\\s\\x{{a0}}]+', ' ', 'g')) AS item FROM see WHERE regexp_matches(line, '^- \\[ \\](\\s.*)?$'))"""

SQL = {
    "text_functions": f"""SELECT id AS note_id, {_NORM} AS project_norm, {_NORM} AS project_canon,
  left(sha256(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))), 16) AS thread_key,
  'c-' || left(sha1(array_to_string(list_sort([coalesce(title, ''), path]), '|')), 16) AS finding_key,
  {_SHOWN.format("coalesce(title, '')", 40)} AS shown, {_BARE.format("coalesce(title, '')")} AS bare,
  replace(replace(lower(upper(coalesce(title, ''))), ' ', ''), '-', '') AS fold, CAST({_DAY.format("date")} AS VARCHAR) AS day, {_STEM} AS stem,
  left(coalesce(title, ''), list_max(list_filter(range(0, 22), lambda n: strlen(left(coalesce(title, ''), CAST(n AS INT))) <= 21))::INT) AS clipped FROM notes""",
    "token_counts": f"WITH {_C}, {_P} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY 1 ORDER BY df DESC, term LIMIT 50",
    "link_resolution": f"WITH {_RAW}, {_NAMES} SELECT link_id, nm.dst FROM l0 LEFT JOIN nm ON nm.name = lower(upper(trim(dst_name)))",
    "broken_links": f"WITH {_L} SELECT title, dst_name, count(*) AS n FROM l JOIN notes ON notes.id = src WHERE dst IS NULL GROUP BY 1, 2",
    "link_demand": f"""WITH {_L}, e AS (SELECT dst_name, count(*) AS n FROM l WHERE dst IS NULL AND dst_name IS NOT NULL GROUP BY 1)
SELECT string_agg(dst_name, '|' ORDER BY n DESC, dst_name) AS spellings, CAST(sum(n) AS BIGINT) AS demand FROM e GROUP BY replace(replace(lower(upper(dst_name)), ' ', ''), '-', '') HAVING sum(n) >= 3""",
    "out_degrees": f"WITH {_L} SELECT src, count(*) AS n_out, count(*) FILTER (dst IS NULL) AS n_broken FROM l GROUP BY 1",
    "hub_notes": f"WITH {_L} SELECT src, count(*) AS n_out, count(*) FILTER (dst IS NULL) AS n_broken FROM l GROUP BY 1 HAVING count(*) > 30",
    "missing_vectors": f"SELECT DISTINCT sha256(body) AS hash FROM chunks WHERE body IS NOT NULL AND sha256(body) NOT IN (SELECT hash FROM chunk_vectors WHERE {_OK})",
    "dead_vectors": "SELECT hash FROM chunk_vectors WHERE hash NOT IN (SELECT sha256(body) FROM chunks WHERE body IS NOT NULL)",
    "duplicate_chunks": f"WITH {_C} SELECT sha256(body) AS hash, count(*) AS n, min(chunk_id) AS first_id FROM c WHERE body IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "markdown_links": f"WITH RECURSIVE {_LINKS} SELECT d AS doc_id, row_number() OVER (PARTITION BY d ORDER BY n) - 1 AS pos, name FROM nl WHERE name <> ''",
    "shape_problems": "WITH RECURSIVE l0 AS (" + _LINKS.split("li AS (", 1)[1].split(f"), {_UNFENCED}", 1)[0] + f"""), fr AS (SELECT d, min(n) FILTER (n > 1 AND trim(line, E' \\t') = '---') AS shut FROM l0 GROUP BY 1 HAVING bool_or(n = 1 AND trim(line, E' \\t') = '---')),
li AS (SELECT l0.* FROM l0 LEFT JOIN fr USING (d) WHERE shut IS NULL OR n > shut), {_UNFENCED}, nl AS ({_LINKS.split("nl AS (", 1)[1]},
p AS (SELECT CASE WHEN doc_id IN (SELECT d FROM fr WHERE shut IS NULL) THEN 'frontmatter not closed' WHEN CASE WHEN doc_id IS NULL THEN NOT contains(coalesce(text, ''), '[[') ELSE doc_id NOT IN (SELECT d FROM nl WHERE name <> '' AND d IS NOT NULL) END THEN 'no link' END AS problem FROM documents)
SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1""",
    "open_threads": f"""WITH RECURSIVE {_C}, {_THREADS}, w AS (SELECT d, pos, item, {_STEM} AS stem, project FROM it JOIN ss ON ss.id = d WHERE project = '' OR {_NORM} = 'quill-board')
SELECT d AS note_id, pos, item, left(sha256(trim(regexp_replace({_SHOWN.format("item", 200)} || ' (Session — ' || regexp_replace(stem, '^Session — ', '') || CASE WHEN project = '' THEN ', no project' ELSE '' END || ')', '\\s+', ' ', 'g'))), 16) AS key FROM w""",
    "threads_by_project": f"WITH RECURSIVE {_C}, {_THREADS} SELECT {_NORM} AS project, count(*) AS n FROM it JOIN ss ON ss.id = d GROUP BY 1",
    "term_df": f"{_HITS} SELECT stem AS term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM h JOIN q USING (t) GROUP BY 1",
    "coverage_mass": f"""{_STATS}, x AS (SELECT t, idf, df, content OR NOT (SELECT bool_or(content) FROM w) AS content FROM w)
SELECT chunk_id, round(sum(CASE WHEN content THEN idf ELSE 0 END), 6) AS mass, count(*) AS terms_matched, count(*) FILTER (content) AS content_matched FROM h JOIN x USING (t) GROUP BY 1""",
    "bm25_top": f"{_BM25} SELECT chunk_id, bm25 FROM top ORDER BY bm25, chunk_id LIMIT 50",
    "byte_budget": f"""{_BM25}, {_LANES}, sz AS (SELECT chunk_id AS id, strlen(trim(coalesce(title, '') || CASE WHEN coalesce(heading, '') <> '' THEN ' > ' || heading ELSE '' END || chr(10) || chr(10) || coalesce(body, ''))) AS bytes
  FROM (SELECT DISTINCT id AS chunk_id, note_id, heading_path AS heading, body FROM chunks) h LEFT JOIN notes ON notes.id = note_id),
r AS (SELECT id AS chunk_id, CAST(sum(bytes) OVER (ORDER BY round(fusion, 9) DESC, coalesce(lexical_rank, 501), id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes_so_far FROM fu JOIN sz USING (id))
SELECT * FROM r WHERE bytes_so_far <= 8000""",
    "lane_fusion": f"{_BM25}, {_LANES} SELECT id, round(fusion, 6) AS fusion, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(meaning_rank, 0) AS meaning_rank FROM fu",
    "prefix_widening": f"""WITH RECURSIVE {_C}, {_P}, {_Q}, k AS (SELECT t, n, count(DISTINCT chunk_id) AS chunks FROM (SELECT t, stem, unnest(range(3, length(stem) + 1)) AS n FROM q WHERE prefix AND length(stem) > 3) JOIN p ON starts_with(term, left(stem, n::INT)) GROUP BY 1, 2),
have AS (SELECT t, stem, n, coalesce(chunks, 0) AS chunks FROM (SELECT t, stem, unnest(range(3, length(stem) + 1)) AS n FROM q WHERE prefix AND length(stem) > 3) LEFT JOIN k USING (t, n)),
w AS (SELECT t, length(stem) AS size, chunks, length(stem) AS whole FROM have WHERE n = length(stem)
  UNION ALL SELECT w.t, h.n, h.chunks, whole FROM w JOIN have h ON h.t = w.t AND h.n = w.size - 1
    WHERE NOT ((w.chunks = 0 AND h.n < greatest(3, (whole + 1) // 2)) OR (w.chunks > 0 AND (h.chunks + 1) / (w.chunks + 1) < 1.5))),
o AS (SELECT q.t, origin, left(q.stem, coalesce(min(size), length(q.stem))::INT) AS stem, prefix FROM q JOIN (VALUES {", ".join(f"({i}, '{t.origin}')" for i, t in enumerate(parse_terms(QUESTION, plain)))}) z(t, origin) USING (t) LEFT JOIN w ON w.t = q.t GROUP BY q.t, origin, q.stem, prefix)
SELECT min_by(origin, t) AS origin, stem, prefix FROM o GROUP BY stem, prefix""",
    "graph_neighbours": f"""WITH {_L}, s AS (SELECT id AS note, 1.0::DOUBLE / (id % 10 + 1) AS score FROM notes WHERE lower(type) = 'godnote'),
hub AS (SELECT src FROM l GROUP BY 1 HAVING count(*) > 30), st AS (SELECT * FROM s WHERE note NOT IN (SELECT src FROM hub)),
w AS (SELECT src AS a, dst AS b FROM l WHERE dst IS NOT NULL UNION ALL SELECT dst, src FROM l WHERE dst IS NOT NULL)
SELECT b AS note, round(max(score * 0.5), 6) AS score FROM w JOIN st ON a = note WHERE b <> a GROUP BY 1""",
    "knn_cosine": """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS y FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), y), 6) AS cosine FROM embeddings, q ORDER BY cosine DESC, id LIMIT 20""",
    "search_support": f"""WITH RECURSIVE {_C}, {_P}, {_Q}, sc(scope, lead) AS (VALUES ('own', false), ('lead', true)),
ck AS (SELECT c.chunk_id, lower(trim(coalesce(type, ''))) = 'lead' AS lead FROM c JOIN notes ON notes.id = note_id), pl AS (SELECT term, chunk_id, lead FROM p JOIN ck USING (chunk_id)),
ln AS (SELECT scope, lead, t, stem, unnest(range(3, length(stem) + 1)) AS n FROM q, sc WHERE prefix AND length(stem) > 3),
have AS (SELECT scope, t, ln.stem, n, count(DISTINCT chunk_id) AS chunks FROM ln LEFT JOIN pl ON pl.lead = ln.lead AND starts_with(term, left(ln.stem, n::INT)) GROUP BY 1, 2, 3, 4),
w AS (SELECT scope, t, length(stem) AS size, chunks, length(stem) AS whole FROM have WHERE n = length(stem)
  UNION ALL SELECT w.scope, w.t, h.n, h.chunks, whole FROM w JOIN have h ON h.scope = w.scope AND h.t = w.t AND h.n = w.size - 1
    WHERE NOT ((w.chunks = 0 AND h.n < greatest(3, (whole + 1) // 2)) OR (w.chunks > 0 AND (h.chunks + 1) / (w.chunks + 1) < 1.5))),
cut AS (SELECT sc.scope, sc.lead, q.t, left(q.stem, coalesce(min(size), length(q.stem))::INT) AS stem, prefix FROM q CROSS JOIN sc LEFT JOIN w ON w.t = q.t AND w.scope = sc.scope GROUP BY sc.scope, sc.lead, q.t, q.stem, prefix),
f AS (SELECT scope, lead, min(t) AS t, stem, prefix FROM cut GROUP BY 1, 2, 4, 5),
hit AS (SELECT DISTINCT scope, t, chunk_id FROM f JOIN pl ON pl.lead = f.lead AND CASE WHEN prefix THEN starts_with(term, stem) ELSE term = stem END),
n AS (SELECT scope, greatest(count(chunk_id), 1) AS n FROM sc LEFT JOIN ck USING (lead) GROUP BY 1), d AS (SELECT scope, t, count(*) AS df FROM hit GROUP BY 1, 2),
e AS (SELECT scope, t, ln(1 + n / (1 + coalesce(df, 0))) AS idf, coalesce(df, 0) <= greatest(n * 0.05, 20) AS rare FROM f LEFT JOIN d USING (scope, t) JOIN n USING (scope)),
g AS (SELECT *, rare OR NOT bool_or(rare) OVER (PARTITION BY scope) AS content FROM e),
x AS (SELECT scope, chunk_id, sum(CASE WHEN content THEN idf ELSE 0 END) AS mass, count(*) FILTER (content) AS held FROM hit JOIN g USING (scope, t) GROUP BY 1, 2),
a AS (SELECT scope, count(*) AS query_terms, count(*) FILTER (content) AS content_terms, sum(idf) FILTER (content) AS asked FROM g GROUP BY 1),
b AS (SELECT scope, count(*) AS matched, max(mass) AS mass, max(held) AS held, count(*) FILTER (held > 0) AS pool FROM x GROUP BY 1)
SELECT scope, coalesce(matched, 0) AS matched_chunks, query_terms, content_terms, coalesce(held, 0) AS best_terms, CAST(floor(coalesce(mass, 0) / asked * 1000) AS INT) AS best_share,
  coalesce(mass, 0) / asked >= 0.4 AS supported, least(coalesce(pool, 0), 500) AS pool FROM a LEFT JOIN b USING (scope)""",
    "note_vectors": f"WITH {_C}, {_NOTEV} SELECT note_id, dim, round(x[1], 6) AS first, round(x[dim // 2], 6) AS middle, round(x[dim], 6) AS last FROM nu",
    "centred_pairs": f"""WITH {_EMB} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.x, b.x), 6) AS sim, a.label <> b.label AS across
FROM z a JOIN z b ON a.id < b.id WHERE list_cosine_similarity(a.x, b.x) > 0.3""",
    "notes_by_type": "SELECT coalesce(type, '') AS type, count(*) AS n FROM notes GROUP BY 1",
    "totals": f"WITH {_C}, {_RAW} SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM l0) AS links",
    "islands": f"""WITH RECURSIVE {_L}, {_PARTS}, home AS (SELECT island FROM s ORDER BY size DESC, island LIMIT 1)
SELECT island, size, id AS note_id FROM g JOIN s USING (island) WHERE island NOT IN (SELECT island FROM home)""",
    "component_sizes": f"WITH RECURSIVE {_L}, {_PARTS} SELECT island AS component, size FROM s",
    "stale_notes": f"""SELECT title, path, date_diff('day', t, DATE '2025-07-01') AS age_days FROM (SELECT title, path, type, greatest({_DAY.format("date")}, {_DAY.format("reviewed")}) AS t FROM notes)
WHERE type IN ('atom', 'molecule', 'godnote', 'source') AND date_diff('day', t, DATE '2025-07-01') > 60""",
    "verdict_counts": f"""WITH m(e, verdict) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in zip(("click", "error", "purchase", "signup", "view"), VERDICTS))})
SELECT verdict, count(event_id) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-22') AS last_7_days FROM m LEFT JOIN events ON event_type = e GROUP BY 1""",
    "misses_due": "SELECT count(*) AS n, count(*) >= 3 AS due FROM events WHERE event_type = 'signup'",
    "fresh_gotchas": f"""SELECT path, {_SHOWN.format(_BARE.format("title"), 200)} || CASE WHEN coalesce(project, '') = '' THEN ' (no project)' ELSE '' END AS line FROM notes
WHERE lower(kind) = 'gotcha' AND lower(coalesce(type, '')) <> 'lead' AND (coalesce(project, '') = '' OR {_NORM} = 'quill-board')
ORDER BY CASE WHEN coalesce(project, '') = '' THEN 1 ELSE 0 END, {_DAY.format("date")} DESC NULLS LAST, path LIMIT 15""",
    "project_godnotes": f"""SELECT path, CAST({_DAY.format("date")} AS VARCHAR) AS day, {_SHOWN.format(_BARE.format("title"), 200)} AS line FROM notes WHERE lower(type) = 'godnote' AND {_NORM} = 'quill-board'""",
    "project_sessions": f"""SELECT {_NORM} AS project, path, row_number() OVER (PARTITION BY {_NORM} ORDER BY {_DAY.format("date")} DESC NULLS LAST, path) AS rank
FROM notes WHERE lower(type) = 'session' QUALIFY rank <= 10""",
    "shared_neighbours": f"""WITH {_L}, {_EDGES}, t AS (SELECT id, {_NORM} AS p, {_DAY.format("date")} AS d FROM notes WHERE project <> '')
SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.p = y.p AND x.d = y.d AND x.id < y.id
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = x.id AND e.b = y.id) AND NOT EXISTS (SELECT 1 FROM e f JOIN e g ON f.b = g.b WHERE f.a = x.id AND g.a = y.id)""",
    "meaning_pairs": f"""WITH {_C}, {_L}, {_EDGES}, {_NOTEV},
pool AS (SELECT note_id, dim, x, lower(type) AS type, coalesce(title, '') AS title, coalesce(project, '') AS project FROM nu JOIN notes ON id = note_id WHERE lower(type) IN ('atom', 'godnote', 'source', 'lead') AND coalesce(died, '') = ''),
ce AS (SELECT dim, list(m ORDER BY i) AS m FROM (SELECT dim, i, avg(x) AS m FROM (SELECT dim, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM pool) GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT note_id, dim, title, project, list_transform(list_zip(x, m), lambda y: y[1] - y[2]) AS x FROM pool JOIN ce USING (dim) WHERE type <> 'lead'),
s AS (SELECT a.dim, a.note_id AS ia, b.note_id AS ib, a.title AS ta, b.title AS tb, a.project <> '' AND b.project <> '' AND a.project <> b.project AS across, list_cosine_similarity(a.x, b.x) AS sim
  FROM z a JOIN z b ON a.dim = b.dim AND a.note_id < b.note_id WHERE list_dot_product(a.x, a.x) > 0 AND list_dot_product(b.x, b.x) > 0 AND list_cosine_similarity(a.x, b.x) > 0.35),
o AS (SELECT *, tb < ta AS swap FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = ia AND e.b = ib) AND NOT (across AND EXISTS (SELECT 1 FROM e f JOIN e g ON f.b = g.b WHERE f.a = ia AND g.a = ib)))
SELECT dim, CASE WHEN across THEN 'cross' ELSE 'same' END AS kind, CASE WHEN across THEN 'c-' ELSE 's-' END || left(sha1(least(ta, tb) || '|' || greatest(ta, tb)), 16) AS key,
  CASE WHEN swap THEN ib ELSE ia END AS a, CASE WHEN swap THEN ia ELSE ib END AS b, round(sim, 3) AS sim FROM o""",
    "stale_signs": f"""WITH {_LATEST}, said AS (SELECT DISTINCT src_note_id AS src, dst_name AS name FROM links WHERE dst_name IS NOT NULL),
h AS (SELECT 0 AS sign, n.id AS src, 'supersedes' AS how, la.dst AS old, o.title AS ot, n.id AS new, n.title AS nt, '' AS correction FROM said JOIN notes n ON n.id = src
    JOIN la ON la.name = lower(upper(trim(regexp_extract(said.name, '^[^\\]|#]+')))) JOIN notes o ON o.id = la.dst
    WHERE la.dst <> n.id AND coalesce(o.died, '') = '' AND NOT contains('/' || n.path, '/sessions/')
  UNION ALL SELECT 1, id, 'self', id, title, 0, NULL, '' FROM notes WHERE id % 7 = 0 AND coalesce(died, '') = '' AND NOT contains('/' || path, '/sessions/')
  UNION ALL SELECT 2, id, 'correction', id, title, 0, NULL, 'Поправка: not so' FROM notes WHERE id % 11 = 0 AND coalesce(died, '') = '' AND NOT contains('/' || path, '/sessions/')),
k AS (SELECT 'u-' || left(sha1(coalesce(array_to_string(list_sort(list_filter([ot, nt], lambda x: x IS NOT NULL)), '|'), '')), 16) AS key, sign, src, how, old, new, correction FROM h)
SELECT key, how, old, new, correction FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY sign, src, old) = 1""",
    "broken_list": f"WITH {_L} SELECT coalesce(title, '') AS title, dst_name, count(*) OVER () AS n_all FROM l JOIN notes ON notes.id = src WHERE dst IS NULL ORDER BY 1, 2 LIMIT 50",
    "health_report": f"""WITH RECURSIVE {_C}, {_L}, {_PARTS}, home AS (SELECT island FROM s ORDER BY size DESC, island LIMIT 1),
cut AS (SELECT island FROM g WHERE island NOT IN (SELECT island FROM home)), vm(e, verdict) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in zip(("click", "error", "purchase", "signup", "view"), VERDICTS))})
SELECT 'type' AS section, coalesce(type, '') AS item, count(*) AS n FROM notes GROUP BY 2 UNION ALL SELECT 'totals', 'notes', count(*) FROM notes UNION ALL SELECT 'totals', 'chunks', count(*) FROM c UNION ALL SELECT 'totals', 'links', count(*) FROM l
UNION ALL SELECT 'islands', 'islands', count(DISTINCT island) FROM cut UNION ALL SELECT 'islands', 'notes', count(*) FROM cut
UNION ALL SELECT 'broken_links', 'links', count(*) FROM l WHERE dst IS NULL AND src IN (SELECT id FROM notes)
UNION ALL SELECT 'stale', 'notes', count(*) FROM (SELECT greatest({_DAY.format("date")}, {_DAY.format("reviewed")}) AS t FROM notes WHERE type IN ('atom', 'molecule', 'godnote', 'source')) WHERE date_diff('day', t, DATE '2025-07-01') > 60
UNION ALL SELECT 'feedback', verdict, count(event_id) FROM vm LEFT JOIN events ON event_type = e GROUP BY 2""",
    "linked_pairs": f"""WITH {_L}, {_EDGES}, p AS (SELECT id, {_NORM} AS label FROM notes WHERE project <> ''), x AS (SELECT p.label, count(*) AS n FROM e JOIN p ON p.id = e.a JOIN p o ON o.id = e.b AND o.label = p.label WHERE e.a < e.b GROUP BY 1)
SELECT DISTINCT label, coalesce(n, 0) AS linked_pairs FROM p LEFT JOIN x USING (label)""",
    "named_godnotes": f"""WITH n AS (SELECT {_NORM} AS key, id AS god, title, {_BARE.format("title")} AS bare, row_number() OVER (PARTITION BY {_NORM} ORDER BY id) AS rank FROM notes WHERE lower(type) = 'godnote' AND coalesce(title, '') <> ''),
a AS (SELECT key, bare AS extend, {_BARE.format("bare")} AS barer FROM n WHERE rank = 3)
SELECT key, min_by(god, rank) AS god FROM n JOIN a USING (key) WHERE title = extend OR bare = barer GROUP BY 1""",
    "page_changes": """SELECT CAST(id AS VARCHAR) AS key, CASE WHEN id % 4 = 0 THEN 'gone' WHEN id % 3 = 0 THEN 'new' WHEN id % 5 = 0 THEN 'notes' ELSE 'verdict' END AS change FROM notes
WHERE path IS NOT NULL AND NOT (id % 3 = 0 AND id % 4 = 0) AND (id % 3 = 0 OR id % 4 = 0 OR id % 5 = 0 OR id % 7 = 0)""",
    "thread_evidence": f"""WITH t AS (SELECT id, 'close team/' || {_NORM} || '#' || id || ' and #12, landed in ' || left(sha256, 10) AS line FROM notes),
r AS (SELECT id, 'issue' AS kind, unnest(regexp_extract_all(line, '(?:[\\w.-]+/[\\w.-]+)?#\\d{{1,6}}\\b')) AS reference FROM t
  UNION ALL SELECT id, 'commit', unnest(regexp_extract_all(line, '\\b[0-9a-f]{{7,40}}\\b')) FROM t)
SELECT kind, count(*) AS n, count(DISTINCT reference) AS n_distinct, count(DISTINCT id) AS n_notes FROM r GROUP BY 1""",
    "thread_closures": """SELECT left(sha256(line), 16) AS key, left(line, 300) AS thread, 'done' AS reason, '2025-07-01' AS closed FROM (SELECT trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS line FROM notes)""",
    "packed_vectors": f"SELECT hash, dim * 2 AS bytes, true AS near FROM chunk_vectors WHERE {_OK}",
    "verdict_carry": "SELECT CAST(id AS VARCHAR) AS key, CASE WHEN id % 5 = 0 OR id % 3 <> 0 THEN 'keep' ELSE '' END AS verdict, id % 5 = 0 AS decided FROM notes",
    "finding_triage": """WITH f AS (SELECT id AS i, ['group', 'cross', 'same', 'stale'][id % 4 + 1] AS kind, id % 50 AS p, ['устарело', 'уточняет', 'дубль', 'мимо'][id // 4 % 4 + 1] AS v FROM notes),
told AS (SELECT DISTINCT p FROM f WHERE kind = 'stale' AND i % 7 < 3 AND i % 11 <> 0)
SELECT CAST(i AS VARCHAR) AS key, CASE WHEN i % 11 = 0 THEN 'unread' WHEN i % 13 = 0 THEN 'decided' WHEN kind = 'group' AND i % 8 < 5 AND i % 3 = 0 THEN 'safe' WHEN kind = 'group' AND i % 8 < 5 THEN 'page'
  WHEN kind = 'cross' AND i % 8 < 5 THEN 'safe' WHEN kind = 'same' AND v = 'уточняет' THEN 'safe'
  WHEN kind = 'same' AND v IN ('устарело', 'спор', 'дубль') AND NOT (v = 'устарело' AND p IN (SELECT p FROM told)) THEN 'page' WHEN kind = 'stale' AND i % 7 < 3 THEN 'page' ELSE 'dropped' END AS place FROM f""",
    "reading_batches": "SELECT b AS batch, min(id) AS first_id, count(*) AS n FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 20 AS b FROM notes WHERE coalesce(died, '') = '') GROUP BY 1",
    "session_facts": f"""WITH {_TURNS} SELECT session_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns,
  length(min_by(text, pos) FILTER (role = 'user' AND text NOT LIKE '<%')) AS first_length FROM t GROUP BY 1""",
    "role_totals": f"WITH {_TURNS} SELECT role, count(*) AS turns FROM t GROUP BY 1",
    "session_split": f"WITH RECURSIVE {_SPLIT} SELECT session_id, piece, count(*) AS turns FROM w GROUP BY 1, 2",
    "session_render": f"""WITH RECURSIVE {_SPLIT} SELECT session_id, piece, sha256(string_agg('[' || role || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY pos)) AS sha256
FROM w JOIN t USING (session_id, pos) GROUP BY 1, 2""",
    "context_alarms": """WITH e AS (SELECT user_id, event_id AS tm, CAST(sum(CAST(round(value * 5000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 40 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM events),
s AS (SELECT *, sum(CASE WHEN used < 500000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tm) AS k FROM e),
m AS (SELECT *, coalesce(max(used) OVER (PARTITION BY user_id, k ORDER BY tm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS most FROM s),
x AS (SELECT CASE WHEN used >= 917000 AND most < 917000 THEN 'compact-critical' WHEN used >= 900000 AND most < 900000 THEN 'rot-900000'
  WHEN used >= 887000 AND most < 887000 THEN 'compact-warn' WHEN used >= 500000 AND most < 500000 THEN 'rot-500000' END AS mark FROM m)
SELECT mark, count(*) AS n FROM x WHERE mark IS NOT NULL GROUP BY 1""",
    "unclosed_sessions": """WITH n AS (SELECT session_id, count(DISTINCT node_id) AS turns FROM message_nodes GROUP BY 1)
SELECT id AS session_id, turns FROM sessions JOIN n ON n.session_id = id WHERE last_activity_at >= TIMESTAMPTZ '2025-06-10 00:00:00+00' - INTERVAL 14 DAY
  AND last_activity_at <= TIMESTAMPTZ '2025-06-10 00:00:00+00' - INTERVAL 30 MINUTE AND turns >= 3 AND coalesce(hidden, 0) = 0 AND working_directory IS DISTINCT FROM '/work/Brindle'""",
    "activity_windows": """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM g GROUP BY user_id, k""",
}
