"""Operators on skewed, deep and degenerate input, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlinspike.operators import audit, components, hierarchy, links, references, search, vectors
from marlinspike.plans import ordered


def test_prefix_sum_of_a_hot_group(spark, ws):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.7 else rng.choice(["a", None, "b"]), i, rng.choice([None, 1, 5])) for i in range(3000)]
    got = ordered.prefix_sum(spark.createDataFrame(data, "g string, o int, v long"), ["g"], ["o"], "v", "s", ws).collect()
    run: dict = {}
    want = {}
    for g, o, v in sorted(data, key=lambda r: r[1]):
        want[o] = run.get(g, 0)
        run[g] = run.get(g, 0) + (v or 0)
    assert {r.o: r.s for r in got} == want


def test_next_value(spark, ws):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.8 else "x", i, rng.choice(["u", None, "a"])) for i in range(1000)]
    got = ordered.next_value(spark.createDataFrame(data, "g string, o int, v string"), ["g"], ["o"], F.col("v"), "n", ws).collect()
    want, last = {}, {}
    for g, o, v in sorted(data, key=lambda r: -r[1]):
        want[o] = last.get(g)
        last[g] = v
    assert {r.o: r.n for r in got} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_brute(spark, ws, seed):
    """A deep chain, a star of a third of all nodes, random trees, loops with trees below them."""
    rng = random.Random(seed)
    up = {i: i - 1 if i else None for i in range(300)} | {1000 + i: 5 for i in range(400)}
    up |= {2000 + i: rng.choice([None, 99999, *range(2000, 2000 + i)]) for i in range(200)} | {3000: 3002, 3001: 3000, 3002: 3001, 3003: 3001, 3004: 3003, 3005: 3005}
    df = spark.createDataFrame([*up.items(), (0, None), (None, 5)], "id long, pid long")
    nodes = hierarchy.prepare(df, ["id"], ["pid"])
    sets, loops = hierarchy.nested_sets(nodes, ws)
    assert {r.k.k0 for r in loops.collect()} == {3000, 3001, 3002, 3003, 3004, 3005}
    path = {}
    for i in up:
        p, seen = [i], {i}
        while up.get(p[-1]) in up and up[p[-1]] not in seen:
            p.append(up[p[-1]])
            seen.add(p[-1])
        path[i] = p[::-1]
    rows = {r.k.k0: r for r in sets.collect()}
    assert set(rows) == {i for i in up if i < 3000}
    assert all([x.k0 for x in r.path] == path[i] and r.depth == len(path[i]) - 1 and r.root.k0 == path[i][0] for i, r in rows.items())
    assert sorted(r.lo for r in rows.values()) == list(range(len(rows)))
    pairs = {(r.ancestor.k0, r.descendant.k0, r.distance) for r in hierarchy.descendants(sets).collect()}
    assert pairs == {(a, i, len(path[i]) - 1 - d) for i in rows for d, a in enumerate(path[i][:-1])}


def test_orphan_keys_brute(spark):
    rng = random.Random(4)
    parents = {k: rng.randint(0, 50) for k in [*range(100), *range(150, 200), 16383, 16384, 16385, 99999, -5, -4]}
    refs = [(i, rng.choice([7, *range(-10, 210), 16382, 16384, 16386, 99999, 5001, None]), rng.choice([None, *range(60)])) for i in range(4000)]
    ts = lambda c: F.timestamp_seconds(F.col(c)).alias(c)
    r = spark.createDataFrame(refs, "ref_id long, key long, seen long").select("ref_id", "key", ts("seen"))
    p = spark.createDataFrame([*parents.items(), (7, 60), (None, 1), (8, None)], "key long, arrived long").select("key", ts("arrived"))
    got = {x.ref_id: x.fault for x in references.orphan_keys(r, p, spark.createDataFrame([(5001,), (None,)], "key long")).collect()}
    parents[8] = -1
    want = {}
    for i, k, s in refs:
        if k is not None and k not in parents:
            want[i] = "removed" if k == 5001 else "absent"
        elif k is not None and s is not None and s < parents[k]:
            want[i] = "later"
    assert got == want


def test_components(spark, ws):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 3), (7, 6)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long"), ws).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert got == {x: find(x) for x in list(root)}


def test_widening(spark):
    chunks = [(i, w) for i, w in enumerate(["texture", "textures", "textured", "texts", "text", "rare", "running", "runs", None, ""] * 3)]
    posts = search.postings(spark.createDataFrame(chunks, "chunk_id long, body string"))
    got = {t.origin: t.stem for t in search.widen(posts, search.parse_terms("texturing rarely xyzzyx", search.plain))}
    assert got == {"texturing": "textur", "rarely": "rare", "xyzzyx": "xyz"}


def test_bm25_as_the_index(spark):
    """Equal to a full-text index on a query of two words, in the stemmed mode."""
    import sqlite3

    rng = random.Random(6)
    vocab = ["run", "running", "runner", "café", "night", "nights", "lamp", "lamps", "paper"]
    data = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 40)))) for i in range(1, 60)]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(b, tokenize='porter unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO f(rowid, b) VALUES (?, ?)", data)
    want = dict(con.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH '\"cafe\"* OR \"lamps\"*'"))
    chunks = spark.createDataFrame(data, "chunk_id long, body string")
    posts = search.stemmed_postings(chunks).cache()
    terms = search.parse_terms("Cafe lamps")
    found = search.hits(posts, terms)
    lens = search.lengths(chunks)
    stats = search.term_stats(found, len(data), len(terms))
    got = {r.chunk_id: r.bm25 for r in search.bm25(found, lens, stats.df, len(data), lens.agg(F.avg("dl")).first()[0]).collect()}
    assert got == pytest.approx(want)


def _corpus(spark, notes, chunks, edges):
    return search.Corpus(
        spark.createDataFrame([(i, f"p/{i}.md", t, "", "", "", "", "", "", "") for i, t in notes], "note_id long, path string, type string, kind string, source string, project string, date string, reviewed string, dies_when string, died string"),
        spark.createDataFrame([(k, n, "", b, 0) for k, (n, b) in enumerate(chunks)], "chunk_id long, note_id long, heading string, body string, ord int"),
        spark.createDataFrame(edges, "src long, dst long"),
    )


def test_search_scenarios(spark):
    notes = [(i, "atom") for i in range(40)] + [(50, "lead"), (51, "atom")]
    chunks = [(i, f"filler noise number {i}") for i in range(40)] + [(50, "alphaword in a lead"), (0, "alphaword betaword"), (1, "alphaword"), (51, "nothing alike")]
    c = _corpus(spark, notes, chunks, [(0, 51), (0, None), (2, 3)])
    got = search.search(c, "alphaword betaword")
    paths = [x["path"] for x in got["fragments"]]
    assert paths[0] == "p/0.md" and "p/51.md" in paths and paths[-1] == "p/50.md"
    assert not got["coverage"]["weak_match"] and {x["found_by"] for x in got["fragments"]} == {"text", "link"}
    weak = search.search(c, "unknownword zzzz")["coverage"]
    assert weak["weak_match"] and weak["unmatched_terms"] == ["unknownword", "zzzz"]
    assert search.search(c, "!!")["fragments"] == []
    meaning = spark.createDataFrame([(5, 0.95), (6, 0.90)], "chunk_id long, cosine double")
    fused = search.search(c, "unknownword", meaning=meaning)
    assert [x["chunk_id"] for x in fused["fragments"] if x["found_by"] == "meaning"] == [5] and not fused["coverage"]["weak_match"]
    assert all(x["bytes"] <= 30 for x in search.search(c, "alphaword betaword", budget=30)["fragments"])


def test_hubs(spark):
    edges = spark.createDataFrame([(1, i) for i in range(100, 140)] + [(2, 5), (6, 2), (2, None)], "src long, dst long")
    near, hubs = search.neighbours(edges, spark.createDataFrame([(1, 1.0), (2, 0.8)], "note long, score double"))
    assert {(r.note, r.score) for r in near.collect()} == {(5, 0.4), (6, 0.4)} and [r.note for r in hubs.collect()] == [1]


def test_resolution(spark):
    notes = [(1, "Alpha", "d/alpha file.md", '["nick", "Beta"]'), (2, "Beta", "d/b.md", "nick"), (3, "Gamma", "d/g.md", "solo"), (4, "Gamma", "e/x.md", None)]
    names = links.name_map(spark.createDataFrame(notes, "note_id long, title string, path string, aliases string"))
    wanted = {"ALPHA": 1, "alpha file": 1, "d/alpha file": 1, "alpha file.md": 1, "d/alpha file.md": 1, "nick": None, "beta": 2, "gamma": None, "solo": 3, "none": None, None: None}
    got = links.resolve(spark.createDataFrame([(k,) for k in wanted], "dst_name string"), names)
    assert {r.dst_name: r.dst for r in got.collect()} == wanted


def test_average_linkage():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.3, (12, 8)) for c in np.eye(8)[:3] * 4])
    x /= np.linalg.norm(x, axis=1)[:, None]
    d = 1 - x @ x.T
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1:  # the definition
        mean, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if mean >= 0.05:
            break
        groups[i] += groups.pop(j)
    got = vectors.average_linkage(x, 0.05)
    assert {frozenset(np.flatnonzero(got == k)) for k in set(got)} == {frozenset(g) for g in groups} and len(groups) > 3


def test_groups_refuse_too_many(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_ROWS", 3)
    with pytest.raises(ValueError, match="average linkage"):
        vectors.groups(spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "id long, vector array<double>"))


def test_blocks_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((50, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = {(r.a, r.b) for r in vectors.similar_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>"), 0.4).collect()}
    assert got == {(i, j) for i in range(50) for j in range(i + 1, 50) if x[i] @ x[j] > 0.4}


def test_answers(spark):
    df = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    got = audit.match_answers(df("a", "b", "c"), df("a", "c", "c", "d"))
    assert {(r.key, r.fault) for r in got.collect()} == {("b", "missing"), ("c", "repeated"), ("d", "unasked")}
    assert audit.match_answers(df("a"), df("a")).count() == 0
    plan = audit.link_plan(spark.createDataFrame([(1, 2, "z"), (1, 2, "a"), (3, 3, "x")], "src long, dst long, why string"))
    assert [tuple(r) for r in plan.collect()] == [(1, 2, "a")]


def test_group_facts(spark):
    notes = spark.createDataFrame([(i, "atom") for i in range(4)] + [(10, "godnote"), (11, "godnote")], "note_id long, type string")
    vec = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(4)] + [(10, [1.0, 0.0]), (11, [0.0, 1.0])], "id long, vector array<double>")
    members = spark.createDataFrame([(i, 0) for i in range(4)], "id long, label long")
    edge = lambda *p: spark.createDataFrame([*p, *[(b, a) for a, b in p]], "a long, b long")
    ranked, near = audit.group_facts(members, notes, vec, edge((10, 1)))
    assert {(r.god, r["rank"], r.links_to_group) for r in near.collect()} == {(10, 1, 1), (11, 2, 0)} and ranked.count() == 4
    assert audit.group_facts(members, notes, vec, edge((11, 1), (11, 2)))[0].count() == 0


def test_threads_over_chunks(spark):
    from marlinspike.operators import digest

    notes = [(1, "s/Session — One.md", "session", "Quill Board", "2024-01-02"), (2, "s/two.md", "Session", "", "2024-01-03"), (3, "s/three.md", "session", "other", None), (4, "s/four.md", "atom", "", None)]
    n = spark.createDataFrame(notes, "note_id long, path string, type string, project string, date string")
    chunks = [(1, 1, "- [ ] first\n```\n- [ ] hidden", 0), (2, 1, "- [ ] still hidden\n```\n- [ ] second  one\n- [x] done", 1), (3, 2, "- [ ] third", 0), (4, 3, "- [ ] foreign", 0), (5, 4, "- [ ] no session", 0), (6, 1, None, 2)]
    c = spark.createDataFrame(chunks, "chunk_id long, note_id long, body string, ord int")
    rows = digest.threads(n, c, wanted="quill-board").orderBy("note_id", "pos").collect()
    assert [r.line for r in rows] == ["[ ] first (Session — One)", "[ ] second one (Session — One)", "[ ] third (Session — two, no project)"]
    closed = spark.createDataFrame([(rows[0].key,)], "key string")
    assert [r.line for r in digest.tails(n, c, closed, wanted="quill-board").collect()] == [rows[1].line, rows[2].line]
    assert digest.tails(n, c, limit=1).count() == 1 and digest.by_project(digest.threads(n, c)).count() == 3


def test_workspace_needs_a_shared_folder():
    from types import SimpleNamespace

    from marlinspike.plans.workspace import shared_dir

    away = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(away)
