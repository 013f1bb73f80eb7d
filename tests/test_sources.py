"""Readers, the incremental index, journals and streams."""

from __future__ import annotations

import datetime
import json
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from marlinspike.sources import journal, transcripts, vault
from marlinspike.streaming import guard
from marlinspike.streaming import journals as streams


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_index_is_incremental(spark, tmp_path):
    v, store = tmp_path / "vault", str(tmp_path / "store")
    put(v, "a/one.md", "---\ntype: atom\naliases: [uno]\n---\n# H\n\nsee [[two]] and [[Nope]]\n")
    put(v, "two words+x.md", "body [[UNO]]")
    two = put(v, "b/two.md", "\n")
    put(v, "b/skip.txt", "no")
    assert vault.build(spark, str(v), store) == {"new": 3}
    read = lambda t: spark.read.parquet(f"{vault.current(spark, store)}/{t}")
    assert {r.path for r in read("notes").collect()} == {"a/one.md", "b/two.md", "two words+x.md"}
    path = {r.note_id: r.path for r in read("notes").collect()}
    assert {(path[r.src], r.dst_name, path.get(r.dst)) for r in read("links").collect()} == {("a/one.md", "two", "b/two.md"), ("a/one.md", "Nope", None), ("two words+x.md", "UNO", "a/one.md")}
    assert {r.body for r in read("chunks").collect()} == {"one > H\n\n# H\n\nsee [[two]] and [[Nope]]", "two words+x\n\nbody [[UNO]]", "two"}
    assert vault.build(spark, str(v), store) == {"same": 3}
    os.utime(two, (1, 1))
    put(v, "a/one.md", "changed [[nowhere]]")
    (v / "two words+x.md").unlink()
    put(v, "new.md", "x")
    assert vault.build(spark, str(v), store) == {"healed": 1, "changed": 1, "deleted": 1, "new": 1}
    assert {r.dst_name for r in read("links").collect()} == {"nowhere"} and read("notes").count() == 3
    assert not vault.schema_stale(read("notes"), "path string, mtime bigint") and vault.schema_stale(read("notes"), "gone string")


def test_shape_and_route(spark):
    notes = [("a", "---\nkind: gotcha\n---\n[[x]]\nBecause: y\n"), ("b", "---\nopen"), ("c", "---\nkind: gotcha\n---\n[[x]]\n**Because:** y\n- Fails-when: z"), ("d", None)]
    got = vault.shape_problems(spark.createDataFrame(notes, "path string, content string"))
    assert {(r.path, r.problem) for r in got.collect()} == {("a", "no Fails-when line"), ("b", "frontmatter not closed"), ("d", "no link")}
    rows = [("n.md", "session", "P", None), ("n.md", "atom", "'My  Project'", None), ("n.md", None, None, None), ("n.md", "atom", "p", "old/n.md")]
    got = [r.path for r in vault.route(spark.createDataFrame(rows, "filename string, type string, project string, existing string")).collect()]
    assert got == ["sessions/n.md", "my-project/n.md", "_unsorted/n.md", "old/n.md"]
    assert [x["path"] for x in vault.near_notes([{"path": "a"}, {"path": "b"}, {"path": "a"}, {"path": "c"}, {"path": "d"}])] == ["a", "b", "c"]


def lines_of(spark, tmp_path, name, rows):
    (tmp_path / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return transcripts.lines(spark, str(tmp_path / name))


def said(turns):
    return [(r.role, r.text) for r in turns.orderBy("session_id", "pos").collect()]


def test_line_hosts(spark, tmp_path):
    a = [{"type": "user", "message": {"content": "hi"}}, "{broken", {"type": "assistant", "message": {"content": [{"type": "text", "text": "yes"}, {"type": "tool_use", "name": "t", "input": {"a": 1}}]}}, {"subtype": "compact_boundary"}, {"type": "user", "message": {"content": "  "}}, {"type": "x"}]
    assert said(transcripts.host_a(lines_of(spark, tmp_path, "a.jsonl", a))) == [("user", "hi"), ("assistant", 'yes\n<used t: {"a": 1}>'), ("compaction", transcripts.COMPACTED)]
    f = [{"type": "USER_INPUT", "content": "x <USER_REQUEST> do\nit </USER_REQUEST> y"}, {"type": "PLANNER_RESPONSE", "content": "ok", "tool_calls": "[{'name': 'n', 'arguments': 'z'}]"}, {"type": "GENERIC", "content": "no"}, {"type": "AUTO_COMPACTION"}]
    assert said(transcripts.host_f(lines_of(spark, tmp_path, "f.jsonl", f))) == [("user", "do\nit"), ("assistant", "ok\n<used n: z>"), ("compaction", transcripts.COMPACTED)]
    (tmp_path / "z.jsonl.zst").write_bytes(zstandard.compress(json.dumps({"type": "user", "message": {"content": "packed"}}).encode()))
    assert said(transcripts.host_a(transcripts.lines(spark, str(tmp_path / "z.jsonl.zst")))) == [("user", "packed")]


def test_lineage(spark, tmp_path, ws):
    msg = lambda t: {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": t}]}}
    for name, texts in (("root", "abc"), ("mid", "de"), ("leaf", "f"), ("lost", "g"), ("l1", "h"), ("l2", "i")):
        lines_of(spark, tmp_path, f"{name}.jsonl", [msg(t) for t in texts])
    rows = transcripts.lines(spark, str(tmp_path))
    heads = [("root", None, None), ("mid", "root", 2), ("leaf", "mid", 1), ("lost", "gone", 1), ("l1", "l2", 1), ("l2", "l1", 1)]
    whole = transcripts.host_b_lineage(rows, spark.createDataFrame(heads, "session string, base string, end long"), ws)
    turns = transcripts.host_b(whole).orderBy("session_id", "pos").collect()
    assert "".join(r.text for r in turns if r.session_id == "leaf") == "abdf" and "".join(r.text for r in turns if r.session_id == "mid") == "abde"
    assert {r.session_id for r in turns} == {"root", "mid", "leaf"}


def test_tree_host(spark, tmp_path, ws):
    m = lambda i, p, role, t: {"type": "message", "id": i, "parentId": p, "message": {"role": role, "content": t}}
    lines_of(spark, tmp_path, "good.jsonl", [{"type": "title"}, {"type": "session", "id": "s"}, m("1", None, "user", "a"), m("2", "1", "assistant", "other branch"), {"type": "compaction", "id": "3", "parentId": "1", "summary": "sum"}, m("4", "3", "assistant", "b")])
    lines_of(spark, tmp_path, "loop.jsonl", [m("1", "2", "user", "a"), m("2", "1", "user", "b")])
    lines_of(spark, tmp_path, "hole.jsonl", [m("2", "1", "user", "a")])
    lines_of(spark, tmp_path, "twice.jsonl", [m("1", None, "user", "a"), m("1", None, "user", "b")])
    turns, faults = transcripts.host_d(transcripts.lines(spark, str(tmp_path)), ws)
    assert said(turns) == [("user", "a"), ("compaction", "sum"), ("assistant", "b")]
    assert {(r.session, r.fault) for r in faults.collect()} == {("loop", "loop"), ("hole", "missing parent"), ("twice", "duplicate id")}


def test_rerooted_tree(spark, ws):
    say = lambda role, t: json.dumps({"role": role, "content": t})
    nodes = [
        ("s", 1, None, say("user", "a"), None), ("s", 2, 1, say("assistant", "b"), None), ("s", 3, None, say("system", "summary"), json.dumps({"summarized_from": 2})),
        ("s", 4, 3, say("assistant", "b"), json.dumps({"extensions": {"compact/prior_node_ids": [2]}})), ("s", 5, 4, say("user", "c"), "{bad"), ("s", 9, 1, say("user", "side"), None),
        ("loop", 1, 2, say("user", "a"), None), ("loop", 2, 1, say("user", "b"), None), ("hole", 2, 1, say("user", "b"), None), ("s", 1, None, say("user", "a"), None),
        # two compactions: the leaf is unknown, so the greatest node ends the chain; a second summary of 3 and a replay are not told
        ("t", 1, None, say("user", "x"), None), ("t", 3, 1, say("tool", "z"), None), ("t", 4, None, say("system", "of 3"), json.dumps({"summarized_from": 3})), ("t", 5, 4, say("system", "again"), json.dumps({"summarized_from": 3})),
        ("t", 6, 5, say("assistant", "y"), json.dumps({"extensions": {"compact/prior_node_ids": [90]}})), ("t", 7, None, say("system", "of 6"), json.dumps({"summarized_from": 6})), ("t", 8, 7, say("assistant", "y"), json.dumps({"extensions": {"compact/prior_node_ids": [6, 90]}})),
        ("ring", 1, None, say("user", "p"), json.dumps({"summarized_from": 2})), ("ring", 2, None, say("user", "q"), json.dumps({"summarized_from": 1})),
    ]
    s = spark.createDataFrame([("s", 5), ("loop", 2), ("hole", 2), ("t", 77), ("ring", 1)], "id string, main_chain_id long")
    turns, faults = transcripts.host_e(s, spark.createDataFrame(nodes, "session_id string, node_id long, parent_node_id long, chat_message string, metadata string"), ws)
    assert said(turns) == [("user", "a"), ("assistant", "b"), ("compaction", "summary"), ("user", "c"), ("user", "x"), ("compaction", "of 3"), ("assistant", "y"), ("compaction", "of 6")]
    assert {r.session_id: r.fault for r in faults.collect()} == {"loop": "loop", "hole": "missing parent", "ring": "loop of summaries"}
    doc = json.dumps({"session_id": "x", "steps": [{"source": "user", "message": "q"}, {"source": "agent", "message": "", "tool_calls": [{"function": {"name": "f", "arguments": "1"}}]}, {"source": "system", "message": transcripts.RESUMED + " …"}, {"source": "system", "message": "prompt"}]})
    out = transcripts.host_e_export(spark.createDataFrame([("file", doc), ("bad", "[")], "session string, document string"))
    assert [r.role for r in out.orderBy("pos").collect()] == ["user", "assistant", "compaction"]


def test_flat_host(spark):
    t = datetime.datetime(2024, 1, 1)
    s = spark.createDataFrame([("a", None), ("child", "a"), ("moved", "")], "id string, parent_id string")
    m = [("1", "a", t, json.dumps({"role": "user", "content": "inline"})), ("2", "a", t + datetime.timedelta(1), json.dumps({"role": "assistant", "content": "old"})), ("3", "child", t, json.dumps({"role": "user", "content": "no"})), ("4", "moved", t, json.dumps({"role": "user", "content": "no"}))]
    parts = spark.createDataFrame([("2", 1, json.dumps({"type": "text", "text": "two"})), ("2", 0, json.dumps({"type": "text", "text": "one"})), ("2", 2, json.dumps({"type": "text", "text": "x", "synthetic": True}))], "message_id string, ordinal int, data string")
    got = transcripts.host_c(s, spark.createDataFrame(m, "id string, session_id string, time_created timestamp, data string"), parts, spark.createDataFrame([("moved",)], "id string"))
    assert said(got) == [("user", "inline"), ("assistant", "one\ntwo")]
    ties = [(i, "a", t, json.dumps({"role": "user", "content": i})) for i in ("2", "1", "3", "1")] + [("9", "a", None, json.dumps({"role": "assistant", "content": "untimed"}))]
    rows = transcripts.host_c(s, spark.createDataFrame(ties, "id string, session_id string, time_created timestamp, data string"), None)
    assert sorted((r.pos, r.text) for r in rows.collect()) == [(0, "untimed"), (1, "1"), (2, "2"), (3, "3")]


def test_shapes():
    shape = transcripts.shape_of
    assert shape(['{"type": "title"}', '{"type": "session"}']) == "host_d" and shape(['{"type": "session_meta"}']) == "host_b" and shape(['{"type": "user"}']) == "host_a"
    assert shape(['{"steps": []}'], ".json") == "host_e_export" and shape(['{"messages": []}'], ".json") == "host_c" and shape(['{"type": "USER_INPUT"}']) == "host_f"
    for bad in ([], [""]):
        with pytest.raises(ValueError):
            shape([x for x in bad if x])


def test_rollout_names_and_images(spark):
    a, b = transcripts.rollout_ids(F.col("n"))
    rows = spark.createDataFrame([("rollout-2024-01-01T00-00-00-abc_d.jsonl.zst",), ("rollout-2024-01-01T00-00-00-abc.jsonl",), ("x.jsonl",)], "n string").select(a, b).collect()
    assert [tuple(r) for r in rows] == [("abc", "d"), ("abc", "abc"), (None, None)]
    pics = transcripts.images(spark.createDataFrame([("data:image/png;base64,QUJD",), ("QUJD",), ("%%%",), (None,)], "data string"))
    assert [bytes(r.bytes) for r in pics.collect()] == [b"ABC"]


def test_journals(spark, tmp_path):
    path = str(tmp_path / "j.jsonl")
    (tmp_path / "j.jsonl").write_text('{"ts": "2024-01-01T00:00:00Z", "verdict": "noise", "query": "q", "notes": [], "note": ""}\n{"ts": "cut\n\n[1]\n{"verdict": "bad", "query": "q", "notes": [], "note": ""}\n')
    rows = journal.read(spark, path, journal.FEEDBACK)
    good, bad = journal.check_feedback(rows)
    assert [r.verdict for r in good.collect()] == ["noise"] and [r.problem for r in bad.collect()] == ["verdict"]
    c = spark.createDataFrame([("s", " x ", "vault"), ("s", " ", "vault"), ("s", "y", "moon")], "session_id string, candidate string, destination string")
    ok, no = journal.check_candidates(c)
    assert [r.candidate for r in ok.collect()] == ["x"] and {r.problem for r in no.collect()} == {"candidate", "destination"}
    journal.append(ok, str(tmp_path / "out"), datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc))
    assert journal.read(spark, str(tmp_path / "out"), journal.CANDIDATES).first().ts == "2024-01-01T00:00:00+00:00"
    one = lambda *s: spark.createDataFrame([(x,) for x in s], "session_id string")
    assert {(r.session_id, r.state) for r in journal.settled(one("a", "b", "c"), one("a"), one("a", "b")).collect()} == {("a", "closed"), ("b", "dismissed"), ("c", "pending")}
    top = journal.top_paths(spark.createDataFrame([(1, "a", "text"), (2, "b", "link"), (3, "a", "link")], "rank int, path string, found_by string"))
    assert [tuple(r)[0] for r in top.collect()] == ["a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    folder, rows = tmp_path / "in", [{"ts": f"2024-01-0{1 + i % 3}T0{i % 9}:00:00Z", "verdict": "noise" if i % 2 else "rejected", "query": f"q{i}", "notes": [], "note": ""} for i in range(30)]
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.jsonl").write_text("\n".join(map(json.dumps, rows[k * 10 : k * 10 + 10])) + "\nbroken\n")
    latest = lambda: streams.latest(spark, str(tmp_path / "up"))
    assert latest() is None
    run = lambda: streams.upsert(streams.tail(spark, str(folder), journal.FEEDBACK, 1), "verdict", "at", str(tmp_path / "up"), str(tmp_path / "state"))
    run()
    batch = journal.read(spark, str(folder), journal.FEEDBACK).groupBy("verdict").agg(F.max("ts").alias("ts"))
    assert {(r.verdict, r.ts) for r in latest().collect()} == {(r.verdict, r.ts) for r in batch.collect()}
    (folder / "4.jsonl").write_text(json.dumps({**rows[0], "ts": "2024-02-01T00:00:00Z"}) + "\n")
    run()
    assert latest().filter("verdict = 'rejected'").first().ts == "2024-02-01T00:00:00Z"
    streams.drain(streams.once(streams.tail(spark, str(folder), journal.FEEDBACK), "query", "90 days"), str(tmp_path / "once"), str(tmp_path / "state2"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 30
    windows = streams.verdict_windows(streams.tail(spark, str(folder), journal.FEEDBACK))
    streams.drain(windows, str(tmp_path / "win"), str(tmp_path / "state3"))
    assert spark.read.parquet(str(tmp_path / "win")).filter("verdict = 'noise' and start = timestamp'2023-12-31'").first().n == 15
    streams.drain(streams.activity(streams.tail(spark, str(folder), journal.FEEDBACK), "verdict"), str(tmp_path / "act"), str(tmp_path / "state4"))
    assert spark.read.parquet(str(tmp_path / "act")).count() > 5


def test_guard(spark, tmp_path):
    use = lambda n, **k: json.dumps({"message": {"role": "assistant", "model": "m", "usage": {"input_tokens": n, "output_tokens": 1}}, **k})
    rows = spark.createDataFrame([("s", 1, use(5)), ("s", 2, use(10)), ("s", 3, use(99, isSidechain=True)), ("s", 4, "{bad"), ("t", 1, "{}")], "session_id string, pos long, line string")
    assert [tuple(r) for r in guard.usage(rows).collect()] == [("s", 11, "m")]
    sizes = [(1, 100), (2, 520_000), (3, 530_000), (4, 950_000), (5, 20), (6, 910_000)]
    data = spark.createDataFrame([("s", datetime.datetime(2024, 1, d), n) for d, n in sizes], "session_id string, at timestamp, used long")
    want = [("s", 520_000, "rot-500000"), ("s", 950_000, "compact-critical"), ("s", 910_000, "rot-900000")]
    assert sorted(map(tuple, guard.batch_alarms(data, 1_000_000).collect())) == sorted(want)
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    streams.drain(guard.alarms(stream, 1_000_000), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(want)
