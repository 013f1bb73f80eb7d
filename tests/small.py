"""Small made-up tables with nulls, repeats, ties, loops, empty and long texts."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq

TS = pa.timestamp("us", tz="UTC")
SCHEMAS = {
    "notes": [("id", pa.int64()), *[(c, pa.string()) for c in ("path", "title", "type", "kind", "source", "project", "date", "reviewed", "dies_when", "died", "aliases")], ("mtime", pa.int64()), ("sha256", pa.string()), ("indexed_at", TS)],
    "chunks": [("id", pa.int64()), ("note_id", pa.int64()), ("heading_path", pa.string()), ("body", pa.string()), ("ord", pa.int32())],
    "links": [("link_id", pa.int64()), ("src_note_id", pa.int64()), ("dst_name", pa.string()), ("dst_note_id_or_null", pa.int64()), ("seen_at", TS)],
    "chunk_vectors": [("hash", pa.string()), ("vector", pa.list_(pa.float32())), ("dim", pa.int32())],
    "sessions": [("id", pa.string()), ("working_directory", pa.string()), ("main_chain_id", pa.int64()), ("hidden", pa.int32()), ("last_activity_at", TS)],
    "message_nodes": [("session_id", pa.string()), ("node_id", pa.int64()), ("parent_node_id", pa.int64()), ("chat_message", pa.string()), ("metadata", pa.string())],
    "session_v2": [("id", pa.string()), ("directory", pa.string()), ("parent_id", pa.string()), ("time_updated", TS)],
    "message": [("id", pa.string()), ("session_id", pa.string()), ("time_created", TS), ("data", pa.string())],
    "documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("project", pa.string()), ("created_at", TS), ("ingested_at", TS)],
    "eval_items": [("item_id", pa.int64()), ("text", pa.string()), ("task", pa.string())],
    "mix_targets": [("source", pa.string()), ("weight", pa.float64()), ("max_repeats", pa.int32())],
    "vanished_notes": [("note_id", pa.int64()), ("path", pa.string()), ("title", pa.string()), ("gone_at", TS)],
    "embeddings": [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())],
    "events": [("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())],
}
#: Names an operator might use for its own columns.
CLASH = ("k", "p", "a", "b", "n", "key", "rep", "dst", "src", "name", "rank", "term", "session", "text_a", "_piece", "vector_", "size", "lo", "hi", "fault")
WORDS = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ano", "ire", "olu", "eska", "und", "äre", "ик")]


def _say(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def _day(k: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=k)


def rows() -> dict[str, list[tuple]]:
    rng = random.Random(5)
    out: dict[str, list[tuple]] = {}
    notes = []
    for i in range(1, 41):
        title = [_say(rng, 5), "", None, "Same title here now"][0 if i % 10 else i // 10 % 4]
        title = {30: "Same title here now", 31: "same TITLE here nows", 32: "Same title there now"}.get(i, title)
        alias = ["", None, "Nick", json.dumps([f"other {i}", "Nick"]), "[broken"][i % 5]
        notes.append((i, f"dir/{_say(rng, 3)} {i}.md", title, [" Lead", "atom", "session", "godnote", None][i % 5], ["gotcha", "", None][i % 3], None, ["Quill Board", "quill-board", "", None][i % 4], ["2024-05-06", "soon", None, "2024-13-40"][i % 4], "", "", ["", "2024-01-01"][i % 9 == 0], alias, i, f"sha{i}", _day(i)))
    notes.append((None,) * 15)
    out["notes"] = notes
    bodies = [_say(rng, rng.randint(20, 60)) for _ in range(25)]
    chunks = []
    for i in range(1, 61):
        body = rng.choice(bodies)
        if i % 4 == 0:
            w = body.split()
            w[len(w) // 2] = "edited"
            body = " ".join(w)
        body = {7: None, 8: "", 9: " \n ", 10: body.upper(), 11: "# H\n\n" + "x" * 5000, 12: "\r\n\r\n".join(_say(rng, 90) + "." for _ in range(6)), 13: "```\n" + "\n".join(_say(rng, 8) for _ in range(60)), 14: "[[a|b]] [[c#d]]\n- item one\n"}.get(i, body)
        chunks.append((i, 1 if i % 3 == 0 else i % 40 + 1, None if i % 6 == 0 else "A > B", body, i))
    out["chunks"] = [*chunks, chunks[4], chunks[11], (None,) * 5, (61, None, None, "short", None)]
    links = []
    for i in range(1, 201):
        n = notes[rng.randrange(40)]
        name = rng.choice([n[1], (n[2] or "x").upper(), "Nick", "gone title", "nowhere", "", None])
        links.append((i, rng.randint(1, 41), "hot name" if i % 3 == 0 else name, rng.choice([None, n[0], 999, 5001]), None if i % 50 == 0 else _day(rng.randint(0, 60))))
    out["links"] = [*links, links[0], links[7], (None,) * 5]
    out["vanished_notes"] = [(5001, "dir/gone.md", "gone title", _day(3)), (5002, None, None, None), (None,) * 4]
    vecs = []
    for i, b in enumerate(sorted({c[3] for c in chunks if c[3]})):
        v = [rng.gauss(0, 1) for _ in range(64)]
        if i % 4 == 1:
            v = [x + rng.gauss(0, 0.05) for x in vecs[-1][1]] if vecs[-1][1] and len(vecs[-1][1]) == 64 else v
        v = {3: None, 6: [0.0] * 64, 9: [float("nan")] * 64, 12: v[:63], 15: [x * 1e-6 for x in v]}.get(i, v)
        vecs.append((hashlib.sha256(b.encode()).hexdigest(), v, 64))
    same = [rng.gauss(0, 1) for _ in range(96)]
    vecs += [(hashlib.sha256(f"twin{i}".encode()).hexdigest(), same, 96) for i in range(12)] + [(None, same, 96), ("zz", same, None), ("zy", [], 0)]
    out["chunk_vectors"] = vecs

    def say(role: str, text: object) -> str:
        return json.dumps({"role": role, "content": text}, ensure_ascii=False)

    talk = [(say("user", "hi"), say("assistant", "yes"))[k % 2] for k in range(400)]
    nodes = [("long", k + 1, k or None, talk[k], None) for k in range(300)]
    nodes += [("noreply", 1, None, say("user", "a"), None), ("noreply", 2, 1, say("user", "b"), None), ("noreply", 3, 2, say("assistant", "c"), None)]
    nodes += [("loop", 1, 3, talk[0], None), ("loop", 2, 1, talk[1], None), ("loop", 3, 2, talk[0], None), ("loop", 4, 3, talk[1], None), ("loop", 9, None, talk[0], None)]
    nodes += [("orphan", 2, 1, talk[0], None), ("orphan", 3, 2, talk[1], None)]
    nodes += [("bad", 1, None, talk[0], None), ("bad", 2, 1, '{"role": "assistant", "content": "x"', None), ("fork", 1, None, talk[0], None), ("fork", 2, 1, talk[1], None), ("fork", 3, 1, "broken", None)]
    nodes += [("parts", 1, None, say("user", [{"type": "text", "text": "he"}, {"type": "image"}, {"type": "text", "text": "llo"}]), None), ("parts", 2, 1, say("system", None), None), ("parts", 3, 2, say("assistant", "ok"), None)]
    nodes += [("blank", 1, None, say("user", "  "), None), ("blank", 2, 1, say("tool", "x"), None), ("norow", 1, None, talk[0], None), ("norow", 2, 1, talk[1], None)]
    out["message_nodes"] = [*nodes, nodes[0], nodes[5], (None, 1, None, None, None), ("long", None, 1, None, None)]
    leaf = {"long": 300, "noreply": 3, "loop": 4, "orphan": 3, "bad": 2, "fork": 2, "parts": 3, "blank": 2, "nochain": None, "unknown": 7}
    out["sessions"] = [(s, "/work/x", n, 0, _day(500)) for s, n in leaf.items()] + [(None, None, None, None, None)]
    v2 = [("s0", "/d", None), ("s1", "/d", "s0"), ("s2", "/d", "s1"), ("s3", "/d", ""), ("s4", "/d", "unknown"), ("c1", "/d", "c2"), ("c2", "/d", "c1"), ("c3", "/d", "c2"), ("self", "/d", "self")]
    out["session_v2"] = [(i, d, p, _day(1)) for i, d, p in v2] + [(None,) * 4]
    msgs = [("m1", "s0", _day(1), talk[0]), ("m2", "s0", _day(1), talk[1]), ("m3", "s1", _day(2), talk[0]), ("m4", "s1", None, talk[1]), ("m5", "s2", _day(3), talk[1]), ("m6", "s3", _day(2), talk[1]), ("m7", "s3", _day(1), talk[0]), ("m8", "gone", _day(1), talk[0]), ("m9", None, _day(1), talk[0]), ("m10", "s4", _day(1), "[]")]
    out["message"] = [*msgs, msgs[0], (None,) * 4]
    long = _say(rng, 120)
    docs = []
    for i in range(60):
        text = _say(rng, rng.randint(5, 80))
        if i % 9 == 0:
            text = text + "\n\n" + long[50:310] + " " + _say(rng, 10)
        text = {3: None, 4: "", 5: "  \n", 6: "x" * 30000, 7: "- [[Link|a]] and [[Other]]\n```\n[[no]]\n```\n", 13: "---\ntype: atom\naliases: [a, b]\n---\n# T\n\nbody [[l]]\n"}.get(i, text)
        docs.append((i, text, "en", [" Alpha", "alpha", "BETA ", "gamma", None][i % 5], None, "p", _day(i), _day(i)))
    docs += [(100 + i, docs[10][1] + long, "en", "alpha", None, "p", _day(1), _day(1)) for i in range(4)]
    out["documents"] = [*docs, docs[0], (None, "no id", None, None, None, None, None, None)]
    items = [(i, " ".join(long.split()[i : i + 30]), None) for i in range(0, 60, 10)] + [(70, "too short", "t"), (71, None, None), (72, "", None), (None, long, None)]
    out["eval_items"] = [*items, (73, " ".join((docs[20][1] or "").upper().split()[:30]), None)]
    out["mix_targets"] = [("alpha", 0.5, 3), ("beta", 0.2, 2), ("gamma", 0.1, None), ("missing", 0.1, 1), (None, 0.3, 1), ("none", None, 1)]
    out["embeddings"] = [(i, [rng.gauss(0, 1) + (3 if j == i % 3 else 0) for j in range(64)], i % 3) for i in range(30)]
    out["events"] = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i % 5, ["click", "error", "purchase", "signup", "view", None][i % 6], float(i), "{}") for i in range(200)]
    return out


def write(folder: str, kind: str) -> None:
    data = rows()
    for name, fields in SCHEMAS.items():
        these = [] if kind == "empty" else data[name]
        cols = {c: pa.array([r[j] for r in these], t) for j, (c, t) in enumerate(fields)}
        if kind == "wide":
            cols |= {c: pa.array([f"extra {i % 3}" for i in range(len(these))], pa.string()) for c in CLASH if c not in cols}
        pq.write_table(pa.table(cols), f"{folder}/{name}.parquet")
