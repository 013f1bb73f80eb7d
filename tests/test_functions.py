"""Parsers, stems and other functions on single texts."""

from __future__ import annotations

import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlinspike.functions import markdown as M
from marlinspike.functions import stem
from marlinspike.functions import text as T
from marlinspike.operators import audit, digest, sessions
from marlinspike.sources import writer
from marlinspike.streaming import guard

WORDS = """relational conditional rational hesitanci digitizer radicalli analogousli vietnamization predication operator decisiveness hopefulness
formaliti sensibiliti triplicate formative electrical revival allowance airliner adjustable irritant replacement adoption communism angulariti
bowdlerize probate cease controll roll databases running runner caresses ponies ties agreed plastered bled motoring sing conflated troubled
sized hopping falling hissing fizzed filing happy sky straße café ёлка École naïve y by dying university possibly generally a1 2024""".split()


def test_stems_as_the_index():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(b, tokenize='porter unicode61 remove_diacritics 2')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    con.executemany("INSERT INTO f(rowid, b) VALUES (?, ?)", enumerate(WORDS))
    assert dict(con.execute("SELECT doc, term FROM v")) == {i: stem.tokens(w)[0] for i, w in enumerate(WORDS)}


def test_frontmatter():
    meta, body = M.frontmatter("---\ntitle: 'A b'\ntags: [one, \"two\"]\naliases:\n  - x\n  - y z\nempty:\n---\nBody\n")
    assert meta == {"title": "A b", "tags": ["one", "two"], "aliases": ["x", "y z"], "empty": ""} and body == "Body\n"
    assert M.frontmatter("---\nopen: yes\nno end") == ({}, "---\nopen: yes\nno end")
    assert M.frontmatter("text\n---\na: b\n---\n")[0] == {} and M.frontmatter("") == ({}, "")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("[[a|label]] [[b#part]] ![[c]] [[ ]] [[#x]]", ["a", "b", "c"]),
        ("```\n[[no]]\n```\n[[yes]]", ["yes"]),
        ("````\n```\n[[no]]\n```\n````\n[[yes]] [[yes]]", ["yes", "yes"]),
        ("~~~\n```\n[[no]]\n~~~\n[[yes]]", ["yes"]),
        ("```\n```python\n[[no]]\n```\n[[yes]]", ["yes"]),
        ("[[yes]]\n```\n[[no]]", ["yes"]),
    ],
)
def test_links_outside_fences(body, want):
    assert M.links(body) == want


def test_sections():
    got = M.sections("T", "pre\n# A\nx\n## B\ny\n# C\nz")
    assert got == [("", "T\n\npre", 0), ("A", "T > A\n\n# A\nx", 1), ("A > B", "T > A > B\n\n## B\ny", 2), ("C", "T > C\n\n# C\nz", 3)]
    assert M.sections("T", "") == [("", "T", 0)]
    big = M.sections("T", "Word word word. " * 300)
    assert len(big) > 3 and all(len(t.encode()) <= 1200 + 3 for _, t, _ in big)
    lines = M.sections("T", "\n".join(f"- [[note {i}]] — why" for i in range(400)))
    assert len(lines) > 5 and all(len(t.encode()) <= 1203 for _, t, _ in lines)
    assert len(M.sections("T", "x" * 5000)) == 1


def test_columns(spark):
    row = spark.range(1).select(
        T.normalize_project(F.lit("  Quill__Board! ")).alias("p"), T.normalize_project(F.lit("Проект")).alias("c"), T.canonical_project(F.lit("OLD name"), {"New": ["old-name"]}).alias("a"),
        T.bare_title(F.lit("Gotcha — one — two")).alias("b"), T.shown(F.lit("x" * 300)).alias("s"), T.tickets(F.lit("see BTS-226, PR #498 and #12")).alias("t"),
        T.iso_date(F.lit("2024-13-40")).alias("d"), T.iso_date(F.lit("2024-02-03T10")).alias("e"), T.clip_bytes(F.lit("aжж🙂b"), 7).alias("k"), T.file_stem(F.lit("a/b.c.md")).alias("f"),
        writer.secrets(F.lit("password: hunter2hunter2 and -----BEGIN RSA PRIVATE KEY-----")).alias("x"), audit.same_map(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("m"),
        writer.session_id_ok(F.lit("host_b:abc")).alias("i1"), writer.session_id_ok(F.lit("host_b:a:b")).alias("i2"), writer.session_id_ok(F.lit("a b")).alias("i3"), writer.session_id_ok(F.lit("raw")).alias("i4"),
    ).first()
    assert (row.p, row.c, row.a, row.b) == ("quill-board", "", "new", "one — two")
    assert len(row.s) == 200 and row.s.endswith("…") and row.t == ["bts226", "pr498"]
    assert row.d is None and str(row.e) == "2024-02-03" and row.k == "aжж" and row.f == "b.c"
    assert row.x == ["private key", "password"] and row.m and (row.i1, row.i2, row.i3, row.i4) == (True, False, False, True)


def test_split_pieces():
    assert sessions.pieces([], [], 10) == [] and sessions.pieces([3, 4], [False, False], 10) == [0, 0]
    assert sessions.pieces([8, 1, 8], [False, True, False], 10) == [0, 0, 1]
    assert sessions.pieces([1, 8, 8], [True, False, False], 16) == [0, 0, 1]
    got = sessions.pieces([5] * 10, [False] * 10, 10)
    assert got == sorted(got) and max(got) == 4
    assert sessions.pieces([30, 1], [False, True], 10)[1] == 0


def test_digest_budget():
    full = {"tails": ["t" * 40] * 3, "gotchas": ["g" * 40] * 3, "godnotes": ["n" * 40] * 2, "note": "", "unclosed": ["u" * 40] * 3, "unclosed_total": 9}
    got = digest.fit(full, 330)
    assert got["godnotes"] == [] and len(got["unclosed"]) == 1 and got["budget_cut"] > 4
    assert digest.fit(full, 10) == {"tails": [], "gotchas": [], "godnotes": [], "note": ""}
    assert digest.fit(full, 10_000) == full
    size = lambda x: len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode()) + 1
    seen = [digest.fit(full, n) for n in range(60, 600)]
    assert all(size(x) <= n for n, x in enumerate(seen, 60)) and {x.get("budget_cut", 0) for x in seen} >= set(range(12))
    assert all(a.get("budget_cut", 99) >= b.get("budget_cut", 0) for a, b in zip(seen, seen[1:]) if b != full)
    last = next(x for x in seen if x.get("budget_cut") == 10)
    assert (len(last["tails"]), len(last["gotchas"]), len(last["unclosed"]), last["unclosed_total"]) == (0, 0, 1, 9)
    assert digest.open_items("- [ ] do  x\n- [x] no\n```\n- [ ] hidden\n```\n - [ ] indented\n- [ ]") == ["[ ] do x", "[ ]"]


def test_marks():
    levels = guard.marks(1_000_000)
    assert [n for _, n in levels] == ["rot-500000", "compact-warn", "rot-900000", "compact-critical"]
    told = lambda used, most=-1: guard.crossed(np.array(used, np.int64), most, levels)
    assert told([100], 600_000) == ([None], 100) and told([910_000]) == (["rot-900000"], 910_000) and told([600_000], 550_000) == ([None], 600_000)
    assert told([600_000, 890_000, 100, 600_000, 700_000, 950_000]) == (["rot-500000", "compact-warn", None, "rot-500000", None, "compact-critical"], 950_000)
    assert told([], 7) == ([], 7) and guard.crossed(np.array([5]), -1, []) == ([None], -1)


def test_added_links():
    text = "# T\r\n\r\n## Links\r\n\r\n- [[a]]\r\n\r\n## End\r\n"
    once = audit.add_links(text, ["b", "A", "b"])
    assert once == "# T\r\n\r\n## Links\r\n\r\n- [[a]]\r\n- [[b]]\r\n\r\n## End\r\n" and audit.add_links(once, ["b"]) == once
    assert audit.add_links("body", ["x"]) == "body\n\n## Links\n\n- [[x]]\n"


def test_writer(tmp_path):
    import hashlib

    path = tmp_path / "d" / "n.md"
    assert writer.write(path, "one") == "created" and writer.write(path, "one") == "exists-same" and writer.write(path, "two") == "conflict"
    assert writer.write(path, "two", hashlib.sha256(b"one").hexdigest()) == "replaced" and path.read_text() == "two"
    assert writer.write(path, "three", "0") == "conflict" and len(list(path.parent.iterdir())) == 1
    for bad in ("", "a.txt", "a/b.md", "a#b.md", ".md", "con.md", "a:b.md", "a .md", None):
        with pytest.raises(ValueError, match="file name"):
            writer.check_name(bad)
    assert writer.check_name("Good name.md") and writer.portable("CON") == "CON note"
