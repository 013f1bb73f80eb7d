"""Decisions, journals, digests, encoders and stores that no query can show whole."""

from __future__ import annotations

import datetime as dt
import json
import sqlite3
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlinspike.operators import decisions, digest, health, vectors
from marlinspike.sources import journal, sqlite, vault
from marlinspike.sources.store import Store, stamp


def test_marks():
    page = lambda **d: json.dumps({"version": 1, "run_id": "r", "decisions": d})
    good, bad = decisions.marks(page(a={"v": "yes", "c": " why "}, b={"v": None}, c={"v": "maybe"}, x={"v": "no"}), "r", {"a", "b", "c"})
    assert good == {"a": {"v": "yes", "c": "why"}} and sorted(b.split(":")[0] for b in bad) == ["c", "x"]
    for text in ('{"version": 1, "version": 1}', "[]", '{"version": 2}', "{", page().replace('"r"', '"other"'), '{"version": 1, "run_id": "r", "decisions": []}'):
        assert decisions.marks(text, "r", set())[0] == {} and decisions.marks(text, "r", set())[1]
    assert decisions.fingerprint({"b": 1, "a": "ж"}) == decisions.fingerprint({"a": "ж", "b": 1}) != decisions.fingerprint({"a": "ж", "b": 2})


def test_answer_faults(spark):
    rows = [
        ("group", '{"keep": true}', None), ("group", '{"keep": "yes"}', "keep"), ("cross", '{"keep": false, "rule_scope": "far", "rule_scope_reason": ""}', "rule_scope"), ("cross", '{"keep": false, "rule_scope": "known"}', "rule_scope_reason"),
        ("same", '{"verdict": "дубль"}', None), ("same", '{"verdict": 1}', "verdict"), ("stale", '{"confirmed": 1}', "confirmed"), ("stale", '{"confirmed": false}', None), ("stale", "[]", "not an object"), ("stale", None, "not an object"), ("same", "{", "not an object"),
    ]
    df = spark.createDataFrame(rows, "kind string, answer string, want string")
    assert [(r.want, r.got) for r in df.select("want", decisions.answer_fault(F.col("kind"), F.col("answer")).alias("got")).collect()] == [(w, w) for _, _, w in rows]


def test_notes_of_a_finding(spark):
    df = spark.createDataFrame([("group", ["x", "y"], None, None, None, None), ("stale", None, "o", None, None, None), ("same", None, None, None, "a", "b")], "kind string, members array<string>, old string, new string, a string, b string")
    assert [r.n for r in df.select(decisions.notes_of(F.struct(*df.columns)).alias("n")).collect()] == [["x", "y"], ["o"], ["a", "b"]]


def test_closing(spark):
    pending = spark.createDataFrame([("a", "p2", "2024-02"), ("a", "p1", "2024-01"), ("b", "q", "2024-01"), ("c", "r", "2024-01")], "session_id string, path string, ts string")
    closed = spark.createDataFrame([("b", "q", "2023")], "session_id string, path string, ts string")
    asked = spark.createDataFrame([("a",), ("b",), ("z",), (None,), ("a",)], "session_id string")
    states, new, rest = journal.close_sessions(asked, pending, closed)
    assert {r.session_id: r.state for r in states.collect()} == {"a": "closed", "b": "already-closed", "z": "not-pending"}
    assert [tuple(r) for r in new.collect()] == [("a", "p1", "2024-01")] and [r.session_id for r in rest.collect()] == ["c"]
    again, none, _ = journal.close_sessions(asked, rest, closed.unionByName(new))
    assert {r.state for r in again.filter("session_id = 'a'").collect()} == {"already-closed"} and none.count() == 0


def test_closures(spark):
    lines = [(0, '{"key": "k1", "thread": "t"}'), (1, "{cut"), (2, '{"key": "k2"}'), (3, "[]"), (4, '{"thread": "no key"}')]
    assert [r.key for r in journal.closures(spark.createDataFrame(lines, "pos long, line string")).collect()] == ["k2", "k1"]
    row = journal.closing_rows(spark.createDataFrame([("do  it \t now " + "x" * 400, "done")], "line string, reason string"), dt.date(2024, 5, 1)).first()
    assert row.thread.startswith("do it now x") and len(row.thread) == 300 and row.closed == "2024-05-01" and len(row.key) == 16


def test_islands_listed(spark):
    rows = spark.createDataFrame([(1, 2, "B", "b"), (1, 2, "C", "c"), (5, 1, None, "z"), (7, 2, "A", "a"), (7, 2, "Z", "y")], "island long, size long, title string, path string")
    got = health.island_list(rows, 2).orderBy("place").collect()
    assert [(r.size, [m.path for m in r.members], r.islands, r.notes) for r in got] == [(2, ["a", "y"], 3, 5), (2, ["b", "c"], 3, 5)]
    assert health.island_list(rows.limit(0)).count() == 0


def test_digest_text(spark):
    row = lambda *x: spark.createDataFrame([(v,) for v in x], "line string")
    open_ = spark.createDataFrame([("s1", dt.datetime(2024, 3, 2), "/w/deep", "hi", "p1"), ("s2", dt.datetime(2024, 3, 4), None, "", "p2"), ("s3", dt.datetime(2024, 3, 1), "C:\\x\\y\\", None, None)], "session_id string, last_activity timestamp, cwd string, first_message string, path string")
    lines, total = digest.unclosed_lines(open_, 2)
    assert lines == ['04.03 unknown — "(no message)" — p2', '02.03 deep — "hi" — p1'] and total == 3
    full = digest.assemble(row("t1", "t2"), row("g"), row(), (lines, total), 10_000, "proj", "index not refreshed")
    text = digest.text_of(full)
    assert "of proj" in text and "- t2" in text and "3 in all" in text and "Godnotes:" not in text and text.endswith("index not refreshed")
    cut = digest.assemble(row("t" * 60, "t2"), row("g"), row("n" * 60), ([], 0), 260)
    assert cut["budget_cut"] >= 1 and "more lines did not fit" in digest.text_of(cut)
    assert digest.text_of(digest.assemble(row(), row(), row(), ([], 0), 1000)) == ""


def test_encoder_fills_gaps(spark):
    chunks = spark.createDataFrame([(1, "bird"), (2, "bird"), (3, "other"), (4, None), (5, "known")], "chunk_id long, body string")
    have = chunks.filter("chunk_id = 5").select(F.sha2("body", 256).alias("hash"), F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float")).alias("vector"), F.lit(2).alias("dim"))
    got = vectors.encoded(chunks, have, lambda texts: np.array([[float("bird" in t), float("bird" not in t)] for t in texts]), 2, batch=1)
    assert sorted(tuple(r.vector) for r in got.collect()) == [(0.0, 1.0), (1.0, 0.0)]
    assert vectors.missing_vectors(chunks, have.unionByName(got)).count() == 0
    back = got.select(vectors.unpacked(vectors.packed(F.col("vector")), F.col("dim")).alias("v"), vectors.unpacked(vectors.packed(F.col("vector")), F.col("dim") + 1).alias("w")).collect()
    assert sorted(tuple(r.v) for r in back) == [(0.0, 1.0), (1.0, 0.0)] and {r.w for r in back} == {None}


def test_sqlite_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a b#.db")
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE "mess age" (id INTEGER PRIMARY KEY, data TEXT, n REAL, raw BLOB, day DATE)')
    con.executemany('INSERT INTO "mess age" VALUES (?, ?, ?, ?, ?)', [(i, f"t{i}", i / 2, b"\x00" if i % 2 else None, "2024") for i in range(1, 8)] + [(9, None, "odd", "text", None)])
    con.execute("CREATE TABLE empty (a INT)")
    con.commit()
    con.close()
    sqlite.register(spark)
    monkeypatch.setattr(sqlite, "RANGE_ROWS", 3)
    read = lambda table: spark.read.format("sqlite_table").option("path", path).option("table", table).load()
    got = read("mess age")
    assert dict(got.dtypes) == {"id": "bigint", "data": "string", "n": "double", "raw": "binary", "day": "string"}
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 8 and rows[3].n == 1.5 and bytes(rows[3].raw) == b"\x00" and rows[2].raw is None and (rows[9].n, bytes(rows[9].raw)) == (None, b"text")
    assert read("empty").count() == 0
    with pytest.raises(Exception, match="no table"):
        read("missing").count()


def test_index_reads_changed_files_only(spark, tmp_path):
    folder, store = tmp_path / "v", str(tmp_path / "s")
    folder.mkdir()
    for i in range(4):
        (folder / f"n [{i}].md").write_text(f"note {i} [[n [0]]]\n")
    assert vault.refresh(spark, str(folder), store) is None
    time.sleep(1.1)
    (folder / "n [1].md").write_text("changed text\n")
    (folder / "n [2].md").unlink()
    known = spark.read.parquet(f"{vault.current(spark, store)}/parsed")
    seen = {r.path: r.content for r in vault._touched(spark, str(folder), known).collect()}
    assert seen["n [1].md"] == "changed text\n" and seen["n [0].md"] is None and set(seen) == {f"n [{i}].md" for i in (0, 1, 3)}
    assert vault.build(spark, str(folder), store) == {"same": 2, "changed": 1, "deleted": 1}
    chunks = spark.read.parquet(f"{vault.current(spark, store)}/chunks")
    assert sorted(r.body.split("\n")[-1] for r in chunks.collect()) == ["changed text", "note 0 [[n [0]]]", "note 3 [[n [0]]]"]
    assert "not refreshed" in vault.refresh(spark, str(tmp_path / "gone"), store)
    assert vault.rows_or_empty(spark, str(tmp_path / "no"), "a int").count() == 0 and vault.rows_or_empty(spark, f"{vault.current(spark, store)}/notes", "title string").count() == 3


def test_store_follows_its_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    mark = stamp(spark, str(tmp_path / "t"))
    calls = []
    make = lambda: (calls.append(1), spark.range(5))[1]
    assert Store(spark, "x", mark)("a", make).count() == 5 and Store(spark, "x", mark)("a", make).count() == 5 and len(calls) == 1
    spark.range(1).write.mode("append").parquet(str(tmp_path / "t"))
    assert stamp(spark, str(tmp_path / "t")) != mark
