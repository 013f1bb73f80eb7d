"""DuckDB SQL for the queries of ``queries_data``."""

_WALK = """
WITH RECURSIVE n AS (
  SELECT DISTINCT 'm' AS kind, session_id, node_id, session_id AS up, parent_node_id AS up_node FROM message_nodes
  WHERE session_id IS NOT NULL AND node_id IS NOT NULL
  UNION SELECT DISTINCT 's', id, 0, nullif(parent_id, ''), 0 FROM session_v2 WHERE id IS NOT NULL),
e AS (SELECT c.kind, c.session_id, c.node_id, p.session_id AS up, p.node_id AS up_node FROM n c
  LEFT JOIN n p ON p.kind = c.kind AND p.session_id = c.up AND p.node_id = c.up_node),
down AS (
  SELECT kind, session_id, node_id, 0 AS depth,
    CASE kind WHEN 'm' THEN CAST(node_id AS VARCHAR) ELSE session_id END AS root,
    CASE kind WHEN 'm' THEN CAST(node_id AS VARCHAR) ELSE session_id END AS path,
    CASE kind WHEN 'm' THEN ['0', session_id, lpad(CAST(node_id AS VARCHAR), 20, '0')] ELSE ['1', session_id] END AS ord
  FROM e WHERE up IS NULL
  UNION ALL
  SELECT e.kind, e.session_id, e.node_id, d.depth + 1, d.root,
    d.path || '/' || CASE e.kind WHEN 'm' THEN CAST(e.node_id AS VARCHAR) ELSE e.session_id END,
    d.ord || [CASE e.kind WHEN 'm' THEN lpad(CAST(e.node_id AS VARCHAR), 20, '0') ELSE e.session_id END]
  FROM e JOIN down d ON e.kind = d.kind AND e.up = d.session_id AND e.up_node = d.node_id)
"""

_FAULTS = """
WITH names AS (
  SELECT lower(upper(x)) AS name, min(indexed_at) AS at FROM (
    SELECT indexed_at, unnest([title, path, regexp_replace(path, '\\.md$', ''), split_part(path, '/', -1), regexp_replace(split_part(path, '/', -1), '\\.md$', '')]
      || CASE WHEN trim(aliases) LIKE '[%' THEN coalesce(CAST(try_cast(aliases AS JSON) AS VARCHAR[]), [aliases]) WHEN trim(coalesce(aliases, '')) = '' THEN [] ELSE [aliases] END) AS x
    FROM notes) WHERE x <> '' GROUP BY 1),
lost AS (
  SELECT DISTINCT lower(upper(x)) AS name FROM (
    SELECT unnest([title, path, regexp_replace(path, '\\.md$', ''), split_part(path, '/', -1), regexp_replace(split_part(path, '/', -1), '\\.md$', '')]) AS x FROM vanished_notes) WHERE x <> ''),
faults AS (
  SELECT DISTINCT link_id, 'id' AS kind, seen_at,
    CASE WHEN n.id IS NULL THEN CASE WHEN v.note_id IS NULL THEN 'absent' ELSE 'removed' END ELSE 'later' END AS fault
  FROM links l LEFT JOIN notes n ON n.id = l.dst_note_id_or_null LEFT JOIN vanished_notes v ON v.note_id = l.dst_note_id_or_null
  WHERE l.dst_note_id_or_null IS NOT NULL AND (n.id IS NULL OR l.seen_at < n.indexed_at)
  UNION ALL
  SELECT DISTINCT link_id, 'name', seen_at,
    CASE WHEN n.name IS NULL THEN CASE WHEN v.name IS NULL THEN 'absent' ELSE 'removed' END ELSE 'later' END
  FROM links l LEFT JOIN names n ON n.name = lower(upper(l.dst_name)) LEFT JOIN lost v ON v.name = lower(upper(l.dst_name))
  WHERE l.dst_note_id_or_null IS NULL AND (n.name IS NULL OR l.seen_at < n.at))
"""

SQL = {
    "p2_found": _WALK + "SELECT session_id, node_id FROM n EXCEPT SELECT session_id, node_id FROM down",
    "p2_hierarchy": _WALK
    + """, size AS (SELECT kind, session_id, node_id, (SELECT count(*) FROM down x WHERE x.kind = d.kind AND (d.kind = 's' OR x.session_id = d.session_id)
      AND starts_with(x.path, d.path || '/')) AS n_descendants FROM down d)
    SELECT CASE kind WHEN 'm' THEN 'message_nodes' ELSE 'session_v2' END AS tree, session_id, node_id, root, depth, n_descendants, path,
      row_number() OVER (ORDER BY ord) - 1 AS lo, row_number() OVER (ORDER BY ord) - 1 + n_descendants AS hi
    FROM down JOIN size USING (kind, session_id, node_id)""",
    "p2_descendants": _WALK
    + """SELECT a.session_id, a.node_id, b.session_id AS below_session_id, b.node_id AS below_node_id, b.depth - a.depth AS distance
    FROM down a JOIN down b ON a.kind = b.kind AND (a.kind = 's' OR a.session_id = b.session_id) AND a.root = b.root AND starts_with(b.path, a.path || '/')""",
    "p4_found": _FAULTS + "SELECT DISTINCT link_id FROM faults",
    "p4_report": _FAULTS + "SELECT kind, fault, strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM faults GROUP BY ALL",
}
