"""Queries do the whole job: no row is lost to a tie, a cut or a bound."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from marlinspike import queries
from marlinspike.operators import vectors
from tests.small import SCHEMAS


@pytest.fixture()
def folder(tmp_path):
    """Writes tables (rows as dicts, missing columns null) and gives their folder."""

    def write(**tables: list[dict]) -> str:
        for name, fields in SCHEMAS.items():
            rows = tables.get(name, [])
            pq.write_table(pa.table({c: pa.array([r.get(c) for r in rows], t) for c, t in fields}), f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def _at(day: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=day)


def test_turns_of_one_time(spark, folder):
    say = lambda i, day, role, text: {"id": i, "session_id": "s", "time_created": None if day is None else _at(day), "data": json.dumps({"role": role, "content": text})}
    msgs = [say("m3", 2, "assistant", "yes"), say("m2", 2, "user", "z"), say("m4", 2, "user", "a"), say("m9", None, "user", "untimed"), say("m1", 3, "assistant", "end"), say("m5", 2, "user", "a")]
    d = folder(message=[*msgs, msgs[0]])
    turns = sorted(queries._turns(spark, d).collect(), key=lambda r: r.pos)
    assert [(r.pos, r.role, r.text) for r in turns] == [(0, "user", "untimed"), (1, "user", "z"), (2, "assistant", "yes"), (3, "user", "a"), (4, "user", "a"), (5, "assistant", "end")]
    assert [(r.turns, r.user_turns, r.first_length) for r in queries.session_facts(spark, d).collect()] == [(6, 4, 7)]
    assert {r.role: r.turns for r in queries.role_totals(spark, d).collect()} == {"user": 4, "assistant": 2}
    assert sum(r.turns for r in queries.session_split(spark, d).collect()) == 6
    text = "[user]\nuntimed\n\n[user]\nz\n\n[assistant]\nyes\n\n[user]\na\n\n[user]\na\n\n[assistant]\nend"
    assert [r.sha256 for r in queries.session_render(spark, d).collect()] == [hashlib.sha256(text.encode()).hexdigest()]


def test_islands_of_all_links(spark, folder, tables):
    link = lambda k, a, b, day: {"link_id": k, "src_note_id": a, "dst_note_id_or_null": b, "dst_name": "x", "seen_at": None if day is None else _at(day)}
    links = [link(1, 1, 2, 10), link(2, 2, 3, 400), link(3, 4, 3, None), link(4, 5, 6, 500), link(5, 7, None, 1), link(6, 8, 99, 1)]
    d = folder(notes=[{"id": i, "path": f"{i}.md"} for i in range(1, 9)], links=links)
    assert sorted(tuple(r) for r in queries.islands(spark, d).collect()) == [(5, 2, 5), (5, 2, 6), (7, 1, 7), (8, 1, 8)]
    rows = pq.read_table(f"{tables['full']}/links.parquet").to_pylist()
    ids = {i for i in pq.read_table(f"{tables['full']}/notes.parquet").column("id").to_pylist() if i is not None}
    named = {r.link_id: r.dst for r in queries.link_resolution(spark, tables["full"]).collect()}  # where no id is stored the name counts
    for r in rows:
        if r["dst_note_id_or_null"] is None:
            r["dst_note_id_or_null"] = named[r["link_id"]]
    least = {i: i for i in ids}
    for _ in ids:
        for r in rows:
            if {r["src_note_id"], r["dst_note_id_or_null"]} <= ids:
                least[r["src_note_id"]] = least[r["dst_note_id_or_null"]] = min(least[r["src_note_id"]], least[r["dst_note_id_or_null"]])
    size = {c: list(least.values()).count(c) for c in least.values()}
    home = min(size, key=lambda c: (-size[c], c))
    got = [tuple(r) for r in queries.islands(spark, tables["full"]).collect() if r.note_id is not None]
    assert sorted(got) == sorted((c, size[c], i) for i, c in least.items() if c != home)


def test_groups_beyond_the_bound(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((120, 6))
    x[100:] = x[:20]  # ties
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")

    def parts() -> set:
        got: dict = {}
        for r in vectors.groups_of_any(rows, 0.3, 3).collect():
            got.setdefault(r.label, set()).add(r.id)
        return {frozenset(g) for g in got.values()}

    few = parts()
    monkeypatch.setattr(vectors, "GROUP_ROWS", 50)
    assert parts() == few and len(few) > 3


def test_linkage_groups_beyond_the_bound(spark, tables, monkeypatch):
    few = sorted(map(tuple, queries.linkage_groups(spark, tables["full"]).collect()))
    monkeypatch.setattr(vectors, "GROUP_ROWS", 10)
    assert sorted(map(tuple, queries.linkage_groups(spark, tables["full"]).collect())) == few


def test_stale_signs_of_every_link(spark, folder):
    notes = [
        {"id": 1, "path": "a/one.md", "title": "Twin"}, {"id": 2, "path": "a/two.md", "title": "TWIN", "aliases": "nick"}, {"id": 3, "path": "a/three.md", "title": "Three", "aliases": '["nick", "two"]'},
        {"id": 4, "path": "a/four.md", "title": "Four"}, {"id": 5, "path": "a/sessions/five.md", "title": "Five"}, {"id": 6, "path": "a/six.md", "title": "Six", "died": "2024-01-01"},
    ]
    said = [(4, "twin"), (4, "Nick"), (4, "two"), (4, "a/one"), (4, "one.md"), (4, "Six"), (4, "Four"), (4, None), (5, "Three"), (2, "Twin"), (1, "Four|shown"), (1, "Four")]
    d = folder(notes=notes, links=[{"link_id": i, "src_note_id": s, "dst_name": n} for i, (s, n) in enumerate(said)])
    assert sorted((r.old, r.new, r.how) for r in queries.stale_signs(spark, d).collect()) == [(2, 4, "supersedes"), (3, 4, "supersedes"), (4, 1, "supersedes")]  # titles Twin and Four are one finding, the least source first
