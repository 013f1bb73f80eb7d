"""The text operators against brute force on small tables, and on skewed and degenerate input."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlinspike.llm import conversations, kernels, leakage, mixing, nearest, neardup, pieces, registry, spans
from tests.oracle import same
from tests.small import WORDS, rows

W = re.compile(r"[^\W_]+")
DATA = rows()


def words(t: str) -> list[str]:
    return W.findall(t.lower())


def runs(w: list[str], n: int) -> set[tuple]:
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


#: SQL forms that read null ids otherwise, or accept what the operators call unreadable.
NOT_SQL = {"p1_found", "p1_faults", "p1_conversations", "p6_found", "p6_neighbours", "p7_found", "p7_items"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    df = registry.QUERIES[name](spark, tables["full"])
    got = df.collect()
    if name in registry.SQL and name not in NOT_SQL:
        same(df.columns, got, registry.SQL[name], tables["full"])
    wide = registry.QUERIES[name](spark, tables["wide"])
    assert wide.columns == df.columns and wide.count() == len(got)
    assert registry.QUERIES[name](spark, tables["empty"]).count() <= 1


def test_p1_cases(spark, tables):
    got = {r.session_id: r.fault for r in _faults(spark, tables["full"])}
    want = {"noreply": "no reply", "loop": "loop", "orphan": "orphan", "bad": "unreadable", "blank": "empty", "nochain": "no leaf", "unknown": "no leaf", "norow": "no session"}
    want |= {"s1": "no time", "s4": "unreadable", "gone": "no session", "c1": "empty", "c2": "empty", "c3": "empty", "self": "empty", "s3": None, "s0": None}
    assert {k: got.get(k) for k in want} == want
    assert {"long", "fork", "parts"}.isdisjoint(got)
    talk = registry.p1_conversations(spark, tables["full"]).collect()
    long = sorted(r.pos for r in talk if r.session_id == "long")
    assert long == list(range(300))
    assert sorted((r.pos, r.role, r.text) for r in talk if r.session_id == "parts") == [(0, "user", "hello"), (1, "assistant", "ok")]


def _faults(spark, d):
    _, bad, _ = registry._sessions(spark, d, False)
    return bad.withColumnRenamed("session", "session_id").collect()


@pytest.mark.parametrize("text", ['{"role": "user", "content": "a"} x', "[]", "3", "", None, '{"role":', '{"a": 1, "a": 2}', '{}, {}'])
def test_unreadable(spark, text):
    m = spark.createDataFrame([(text,)], "c string").select(conversations.parsed(F.col("c")).alias("m")).first().m
    assert not m.readable and m.text is None


def test_p3_brute(spark, tables):
    got = {(r.field, r.id_a, r.id_b) for r in registry.p3_found(spark, tables["full"]).collect()}
    body = {c[0]: words(c[3]) for c in DATA["chunks"] if c[0] is not None and c[3]}
    body = {k: runs(w, 3) for k, w in body.items() if len(w) >= 20}
    title = {n[0]: runs(list(" ".join(words(n[2]))), 3) for n in DATA["notes"] if n[0] is not None and n[2]}
    want = set()
    for field, sets, least in (("chunks.body", body, 0.5), ("notes.title", {k: s for k, s in title.items() if s}, 0.6)):
        want |= {(field, a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
    assert got == want and len({f for f, _, _ in want}) == 2


def test_sketches_merge_and_estimate():
    rng = random.Random(1)
    plan = neardup.BODIES
    base = [rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(400)]
    for share in (0.9, 0.7, 0.5):
        other = base[: int(400 * share)] + [f"new{i}" for i in range(400 - int(400 * share))]
        _, n, reg, _ = neardup.sketches([" ".join(base), " ".join(other)], plan)
        exact = len(runs(base, 3) & runs(other, 3)) / len(runs(base, 3) | runs(other, 3))
        guess = neardup.estimate(reg[:1], reg[1:], n[:1].astype(float), n[1:].astype(float))[0]
        assert abs(guess - exact) < 0.2
        both = neardup.similarity([" ".join(base)], [" ".join(other)], plan)
        assert both[0][0] / both[1][0] == pytest.approx(exact)
    halves = neardup.sketches([" ".join(base[:201]), " ".join(base[199:]), " ".join(base)], plan)[2]
    assert (np.maximum(halves[0], halves[1]) == halves[2]).all()


def test_p3_hot_class(spark, ws):
    """A third of all rows are copies: one class, no pairs among them, and its near copy keeps its link."""
    rng = random.Random(2)
    text = [rng.choice(WORDS) for _ in range(80)]
    data = [(i, " ".join(text).upper() if i % 2 else " ".join(text)) for i in range(400)] + [(1000, " ".join([*text[:60], "other", *text[61:]]))]
    data += [(2000 + i, " ".join(rng.choice(WORDS) + str(i) for _ in range(40))) for i in range(800)]
    df = spark.createDataFrame(data, "id long, text string")
    pairs, _ = neardup.near_duplicates(df, neardup.BODIES, ws)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 1000)]
    group = {r.id: r.group for r in neardup.groups(df, neardup.BODIES, ws).collect()}
    assert group == {i: 0 for i in [*range(400), 1000]}


def test_p3_groups_of_near_copies(spark, ws, monkeypatch):
    """Groups by stars are the components of all similar pairs: a cluster of different near copies, and chains whose ends differ."""
    rng = random.Random(12)
    base = [rng.choice(WORDS) + str(rng.randrange(10**5)) for _ in range(120)]
    data = [(i, " ".join([*base[: i % 118], f"edit{i}", *base[i % 118 + 1 :]])) for i in range(300)]
    for k in range(12):  # each step changes a part, so the ends of a chain are no longer similar
        now = [f"c{k}x{j}" for j in range(100)]
        for step in range(6):
            now = now[:step * 15] + [f"n{k}s{step}w{j}" for j in range(15)] + now[step * 15 + 15 :]
            data.append((1000 + k * 10 + step, " ".join(now)))
    df = spark.createDataFrame(data, "id long, text string")
    compared = []
    real = neardup.Sketched.verify
    monkeypatch.setattr(neardup.Sketched, "verify", lambda self, pairs: (compared.append(pairs.count()), real(self, pairs))[1])
    got = {r.id: r.group for r in neardup.groups(df, neardup.BODIES, ws).collect()}
    assert got == {i: 0 for i in range(300)} | {1000 + k * 10 + s: 1000 + k * 10 for k in range(12) for s in range(6)}
    assert sum(compared) < 300 * 299 / 8


def test_p5_round_trip():
    rng = random.Random(3)
    for k in range(150):
        parts = [rng.choice(["word ", "Ende. ", "\n\n", "\r\n", "# Head\n", "```\n", "ж" * rng.randint(1, 900), "🙂", "x" * rng.randint(1, 3000), "- item\n"]) for _ in range(rng.randint(1, 120))]
        text = "".join(parts)
        limit, over = rng.choice([(1200, 120), (200, 50), (64, 0), (16, 8)])
        got = pieces.split(text, limit, over)
        assert "".join(t.encode()[n:].decode() for t, n in got) == text
        assert all(len(t.encode()) <= limit for t, _ in got)
        for (a, _), (b, n) in zip(got, got[1:]):
            assert n <= over and a.encode().endswith(b.encode()[:n])
            assert not (a.endswith("\r") and b.encode()[n:].startswith(b"\n"))


def test_p5_prefers_boundaries():
    text = "# A\n\n" + "One two three. " * 60 + "\n\n# B\n\n" + "Four five six. " * 60
    got = pieces.split(text, 1200, 0)
    assert got[1][0].startswith("# B")
    short = "# A\n\nOne line.\n\n# B\n\n" + "Four five six. " * 120  # the long section begins a piece although more would fit
    assert pieces.split(short, 1200, 0)[0][0] == "# A\n\nOne line.\n\n" and pieces.split(short, 1200, 0)[1][0].startswith("# B")
    fence = "```\n" + "code line\n\n" * 50 + "```\n\n" + "Text here. " * 80
    assert pieces.split(fence, 1200, 0)[0][0].rstrip().endswith("```")


def test_p5_orders(spark, tables):
    got = registry.p5_pieces(spark, tables["full"]).collect()
    for note in {r.note_id for r in got}:
        own = sorted((r.ord, r.chunk_id, r.piece) for r in got if r.note_id == note)
        assert [o for o, _, _ in own] == list(range(len(own)))
    ids = {c[0] for c in DATA["chunks"]} - {None}
    assert {r.chunk_id for r in got} == ids


def _valid() -> dict[str, np.ndarray]:
    out = {}
    for h, v, d in DATA["chunk_vectors"]:
        if h is not None and v is not None and d is not None and len(v) == d and d and np.isfinite(v).all() and any(v):
            x = np.array(v, np.float32).astype(float)
            out[h] = x / np.linalg.norm(x)
    return out


def test_p6_brute(spark, tables):
    v = _valid()
    best = set()
    twins = {h for h in v if len(v[h]) == 96}
    for h, x in v.items():
        near = sorted(((-(x @ y), o) for o, y in v.items() if o != h and len(y) == len(x)))[:5]
        best |= {tuple(sorted((h, o))) for s, o in near if -s >= 0.9 and not (h in twins)}
    got = {(r.hash_a, r.hash_b) for r in registry.p6_found(spark, tables["full"]).collect()}
    assert {p for p in got if p[0] not in twins} == best and best
    for h in twins:  # ties of equal vectors: each has five of them
        assert sum(h in p for p in got) >= 5


def test_p6_recall(spark, ws, monkeypatch):
    """At least 0.9 of the true pairs, neighbours of all grades above the bound, several cells."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.uniform(0.02, 0.062, 1500)[:, None]
    x[4500:] = x[:1500] + rng.standard_normal((1500, 64)) * noise
    x /= np.linalg.norm(x, axis=1)[:, None]
    sim = np.triu(x @ x.T, 1)
    want = {(f"{i:05d}", f"{j:05d}") for i, j in zip(*np.nonzero(sim >= 0.9))}
    df = spark.createDataFrame([(f"{i:05d}", v.astype(np.float32).tolist(), 64) for i, v in enumerate(x)], "id string, vector array<float>, dim int")
    monkeypatch.setattr(nearest, "LEAF_ROWS", 256)  # trees of five levels, bulk rounds and then the few that still ask
    monkeypatch.setattr(nearest, "SHARD", 300)
    got = {tuple(sorted((r.id, r.other))) for r in nearest.most_similar(df, 5, 0.9, ws).collect()}
    assert len(want) > 800 and len(got & want) / len(want) >= 0.99 and len(got - want) < 5
    # five nearest at any distance: where the test would read more than half, everything is compared
    monkeypatch.setattr(nearest, "LEAF_ROWS", 1024)
    asked = df.filter("id % 40 = 0").select("id")
    near: dict = {}
    for r in nearest.most_similar(df, 5, -1.0, ws, asked=asked).collect():
        near.setdefault(int(r.id), set()).add(int(r.other))
    full = x @ x.T
    np.fill_diagonal(full, -2)
    true = {i: set(np.argsort(-full[i])[:5].tolist()) for i in range(0, 6000, 40)}
    assert near.keys() == true.keys() and all(len(v) == 5 for v in near.values())
    assert sum(len(near[i] & true[i]) for i in true) / (5 * len(true)) >= 0.9


def test_chi_square():
    x = np.array([0.0, 0.0157908, 0.4549364, 1.0, 3.8414588, 6.6348966, 10.8275662])
    assert nearest.chi2_1(x) == pytest.approx(np.array([0, 0.1, 0.5, 0.6826895, 0.95, 0.99, 0.999]), abs=1e-5)


def test_stopping_test_is_calibrated():
    """The stated chance that a tree shows a neighbour is the share of trees that do."""
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x = unit(rng.standard_normal((3000, 64))).astype(np.float32)
    for c in (0.9, 0.5):
        side = rng.standard_normal((3000, 64))
        side = unit(side - (side * x).sum(1)[:, None] * x)
        y = (c * x + np.sqrt(1 - c * c) * side).astype(np.float32)
        trees = [nearest.Tree(x, 4, i) for i in range(12)]
        stated = np.mean([t.shows(x, np.full(3000, c)) for t in trees])
        seen = np.mean([t.leaf(x) == t.leaf(y) for t in trees])
        assert stated == pytest.approx(seen, abs=0.02)


def test_p7_brute(spark, tables):
    docs = {x[0]: runs(words(x[1]), 12) for x in DATA["documents"] if x[0] is not None and x[1]}
    items = {x[0]: runs(words(x[1]), 12) for x in DATA["eval_items"] if x[0] is not None and x[1]}
    want = {(a, b) for a, s in docs.items() for b, t in items.items() if s & t}
    got = {(r.doc_id, r.item_id) for r in registry.p7_found(spark, tables["full"]).collect()}
    assert got == want and len(want) > 10


def test_p7_bound_loses_nothing():
    """The threshold holds for any stretch of min_words words, at any place of a passage."""
    rng = random.Random(6)
    items = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60))) for _ in range(80)]
    ix = leakage.build_index(list(range(80)), items, 12)
    texts, want = [], set()
    for k in range(300):
        j = rng.randrange(80)
        w = items[j].split()
        s = rng.randrange(max(1, len(w) - 12))
        filler = [rng.choice(WORDS) for _ in range(rng.randint(0, 70))]
        at = rng.randint(0, len(filler))
        texts.append(" ".join(filler[:at] + w[s : s + 12] + filler[at:]))
    grams = [runs(t.split(), 12) for t in items]
    for k, t in enumerate(texts):
        want |= {(k, j) for j in range(80) if runs(t.split(), 12) & grams[j]}
    doc, item, _, seen = leakage.overlaps(ix, texts, 24)
    assert set(zip(doc.tolist(), item.tolist())) == want
    assert seen < len(texts) * len(items) / 10


def test_p7_shards(spark, ws, monkeypatch):
    monkeypatch.setattr(leakage, "SHARD_ITEMS", 3)
    rng = random.Random(7)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(20))) for i in range(10)]
    docs = [(i, "start " + t + " end") for i, t in items]
    got = leakage.leaks(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "id long, text string"), ws)
    assert {(r.id, r.item_id) for r in got.collect()} == {(i, i) for i in range(10)}


def test_p7_index_of_a_full_shard():
    """What is broadcast stays within 12 bytes a byte of text, at as many items and characters as a shard may have."""
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i:05d}" for i in range(50_000)])
    per = leakage.SHARD_CHARS // leakage.SHARD_ITEMS // 7
    texts = [" ".join(vocabulary[rng.zipf(1.3, per) % 50_000]) for _ in range(leakage.SHARD_ITEMS)]
    size = sum(map(len, texts))
    assert size > 0.9 * leakage.SHARD_CHARS
    ix = leakage.build_index(list(range(len(texts))), texts, 12)
    assert ix.nbytes() <= 12 * size


def test_p8_shares(spark, ws):
    rng = random.Random(8)
    sized = [(i, "big" if i % 3 else rng.choice(["mid", "small"]), rng.randint(50, 300)) for i in range(3000)] + [(9000, "big", 0), (9001, "other", 500)]
    df = spark.createDataFrame(sized, "id long, source string, tokens long")
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 4), ("small", 0.4, 2), ("absent", 0.1, 3)], "source string, weight double, max_repeats int")
    plan = mixing.demand(df, t.select("source", F.lit(0.0).alias("t"), "weight"), t)
    mixed = mixing.mixture(df, plan, ws).collect()
    total = sum(r.tokens for r in mixed)
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.4)):
        assert sum(r.tokens for r in mixed if r.source == s) / total == pytest.approx(w / 1.2, abs=0.002)
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)
    most = {s: max(r.copy for r in mixed if r.source == s) + 1 for s in ("big", "mid", "small")}
    assert most["big"] == 1 and most["mid"] <= 4 and most["small"] <= 2 and "other" not in {r.source for r in mixed}
    assert len({(r.id, r.copy) for r in mixed}) == len(mixed)
    # at any time the shares so far are near the target
    half = [r for r in mixed if r.position < 0.5]
    assert sum(r.tokens for r in half if r.source == "mid") / sum(r.tokens for r in half) == pytest.approx(0.25, abs=0.01)


def test_p8_schedule(spark, ws):
    """Weights that move: the shares of each quarter follow the integral."""
    df = spark.createDataFrame([(i, "ab"[i % 2], 10) for i in range(8000)], "id long, source string, tokens long")
    knots = spark.createDataFrame([("a", 0.0, 9.0), ("a", 1.0, 1.0), ("b", 0.0, 1.0), ("b", 1.0, 9.0)], "source string, t double, weight double")
    plan = mixing.demand(df, knots, spark.createDataFrame([("a", 1), ("b", 1)], "source string, max_repeats int"), total_tokens=40_000)
    mixed = mixing.mixture(df, plan, ws).collect()
    assert sum(r.tokens for r in mixed) == pytest.approx(40_000, abs=20)
    for q, want in enumerate((0.8, 0.6, 0.4, 0.2)):
        part = [r for r in mixed if q / 4 <= r.position < (q + 1) / 4]
        assert sum(r.source == "a" for r in part) / len(part) == pytest.approx(want, abs=0.02)
    quarters = {(r.part, r.source): r for r in mixing.shares_by_time(plan, spark.createDataFrame(mixed)).collect()}
    for q, want in enumerate((0.8, 0.6, 0.4, 0.2)):
        assert quarters[q, "a"].target_share == pytest.approx(want, abs=1e-6) and quarters[q, "a"].share == pytest.approx(want, abs=0.02)
        assert quarters[q, "a"].share + quarters[q, "b"].share == pytest.approx(1, abs=1e-5)
    used = {s: sum(r.tokens for r in mixed if r.source == s) for s in "ab"}
    assert {r.source: r.unused_tokens for r in mixing.shares(plan, spark.createDataFrame(mixed)).collect()} == {s: 40_000 - used[s] for s in "ab"}


def test_p8_tokens(spark):
    got = mixing.sizes(spark.createDataFrame([(1, "s", "hello world"), (2, "s", None), (3, "s", ""), (4, "s", "<|endoftext|>")], "id long, source string, text string")).collect()
    assert [r.tokens for r in got][:3] == [2, 0, 0] and got[3].tokens > 1


def grams(t: str, n: int) -> set[str]:
    return {t[i : i + n] for i in range(len(t) - n + 1)}


def test_p9_brute(spark, tables):
    docs = {x[0]: x[1] for x in DATA["documents"] if x[0] is not None and x[1]}
    g = {k: grams(t, 200) for k, t in docs.items()}
    want = {(a, b) for a, b in combinations(sorted(g), 2) if g[a] & g[b]}
    got = {(r.doc_id_a, r.doc_id_b) for r in registry.p9_found(spark, tables["full"]).collect()}
    assert got == want and len(want) > 20
    part = {r.doc_id: r.shared_chars for r in registry.p9_shared(spark, tables["full"]).collect() if r.doc_id is not None}
    for k, t in docs.items():
        others = set().union(*(s for o, s in g.items() if o != k))
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if t[i : i + 200] in others:
                cover[i : i + 200] = True
        assert part[k] == cover.sum()


@pytest.mark.parametrize("alphabet", ["ab", "aж🙂 ", "xyz\r\n .,"])
def test_p9_any_offset(spark, ws, alphabet):
    """Stretches of 195 to 205 characters at any place: found exactly from 200 on."""
    rng = random.Random(len(alphabet))
    rand = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) if alphabet == "aж🙂 " else rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    docs, want = [], set()
    for k in range(40):
        n = 195 + k % 11
        part = rand(n)
        a = rand(rng.randint(0, 300)) + "A" + part + "B" + rand(rng.randint(0, 300))
        b = rand(rng.randint(0, 300)) + "C" + part + "D" + rand(rng.randint(0, 300))
        docs += [(2 * k, a), (2 * k + 1, b)]
        if n >= 200:
            want.add((2 * k, 2 * k + 1))
    pairs, same_ = spans.shared_pairs(spark.createDataFrame(docs, "id long, text string"), 200, ws)
    assert {(r.a, r.b) for r in spans.expand(pairs, same_, ws).collect()} == want


def test_p9_hot_boilerplate(spark, ws):
    """Boilerplate under the length in every text pairs none; texts that do share more are found."""
    rng = random.Random(9)
    rand = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    plate = rand(150)
    docs = [(i, rand(100) + "|" + plate + "|" + rand(100)) for i in range(400)]
    more = rand(60)
    docs += [(1000 + i, rand(50) + plate + more + rand(50)) for i in range(3)]
    pairs, _ = spans.shared_pairs(spark.createDataFrame(docs, "id long, text string"), 200, ws)
    assert {(r.a, r.b) for r in pairs.collect()} == {(1000, 1001), (1000, 1002), (1001, 1002)}


def test_gear_is_the_loop():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(500)), np.uint8)
    h, table = 0, kernels.gear_table()
    fast = kernels.gear_hashes(data)
    for i, b in enumerate(data):
        h = ((h << 1) + int(table[b])) & 0xFFFFFFFFFFFFFFFF
        assert h == int(fast[i])


@pytest.mark.parametrize("text", ["", "  ", "a", "Straße_x 12½ ñandú", "ΑΣ ΑΣ", "İstanbul", "áb", "日本 語", "😀 x", "x" * 5000])
def test_words_as_the_pattern(text):
    h, off = kernels.word_hashes([text, "b " + text])
    assert off[1] == len(words(text)) and off[2] - off[1] == len(words("b " + text))
    assert len(set(h.tolist())) == len(set(words(text)) | {"b"}) if words(text) else True


def test_p9_coverage_without_pairs(spark, ws):
    """A passage of every text: coverage rows grow with the texts, and the pairs are the result's own."""
    rng = random.Random(10)
    rand = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    plate = rand(260)
    docs = spark.createDataFrame([(i, rand(30 + i % 7) + plate + rand(40)) for i in range(1500)], "id long, text string")
    found, same_ = spans.shared_windows(docs, 200, ws)
    assert found.count() < 1500 * 400
    got = {r.shared_chars for r in spans.coverage(docs, found, same_).collect()}
    assert min(got) >= 260 and max(got) < 275  # neighbours agree by chance in a few characters
    assert spans.shared_pairs(docs, 200, ws)[0].count() == 1500 * 1499 // 2
