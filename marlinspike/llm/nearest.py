"""Most similar vectors for every vector: stable projections, kd-trees and a chi-square stopping test.

Unit vectors are projected on a few Gaussian directions, one for each level of a
kd-tree that cuts the collection into leaves of bounded size.  A vector visits its
leaf in one tree after another; each leaf's vectors are verified by their cosine.
After every round of trees each vector takes the stopping test with its own k-th
cosine c: a neighbour at c lies on the same side of a split as the vector with the
chance the chi-square distribution of one degree gives for its squared projected
distance to the split, so the chance that no tree so far has shown it is a product
over splits and trees.  The vector stops when that falls to 1 - p.

One tree with the test on its whole ball does not prune here: at cosine 0.90 the
ball of probability 0.999 reaches over the median of nearly every direction.  Taken
split by split and tree by tree the same test leaves a leaf a tree to be read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlinspike.plans.shipping import ship
from marlinspike.plans.workspace import Workspace

#: Chance with which a neighbour at the k-th cosine must have been met.
P = 0.999
#: Rows of a leaf, levels of a tree at most, and rows a tree is fitted on for each leaf (FIT_LEAST in all at least).
LEAF_ROWS, MAX_LEVELS, FIT_PER_LEAF, FIT_LEAST = 4096, 12, 16, 8192
#: Trees of one round; trees after which the rest is compared with everything.
ROUND_TREES, MAX_TREES = 4, 96
#: Vectors that still ask are sent to all rows, instead of all rows to them, when so few are left.
SHARD = 32_768
#: Rows of a task that are dealt to the leaves together.
HELD_ROWS = 65_536
#: Vectors travel as 16-bit integers: cosines are off by less than this until they are verified.
SLACK = 5e-5


def chi2_1(x: np.ndarray) -> np.ndarray:
    """Chi-square distribution function of one degree of freedom: erf(sqrt(x / 2)), by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    z = np.sqrt(np.maximum(x, 0) / 2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return 1 - poly * np.exp(-z * z)


class Tree:
    """A kd-tree over ``levels`` Gaussian projections, a fresh one for each level, split at the medians of a sample."""

    def __init__(self, sample: np.ndarray, levels: int, number: int):
        dim = sample.shape[1]
        self.directions = np.random.default_rng([dim, number]).standard_normal((dim, levels)).astype(np.float32)
        self.split = np.zeros(2**levels - 1, np.float32)
        y = sample @ self.directions
        node = np.zeros(len(y), np.int64)
        for j in range(levels):
            order = np.lexsort((y[:, j], node))
            first = np.searchsorted(node[order], np.arange(2**j - 1, 2 ** (j + 1)))
            for i in range(2**j):
                a, b = first[i], first[i + 1]
                if b > a:
                    self.split[2**j - 1 + i] = y[order[(a + b) // 2], j]
            node = 2 * node + 1 + (y[:, j] > self.split[node])
        self.levels = levels

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row."""
        y, node = x @ self.directions, np.zeros(len(x), np.int64)
        for j in range(self.levels):
            node = 2 * node + 1 + (y[:, j] > self.split[node])
        return node - len(self.split)

    def shows(self, x: np.ndarray, cosine: np.ndarray) -> np.ndarray:
        """Chance that a unit vector at ``cosine`` to a unit row stands in its leaf.

        Its projection is the row's times the cosine plus a normal part of the sine;
        the squared distance of that centre to the split, over the squared sine, is
        what the chi-square distribution of one degree is asked for.
        """
        c = np.clip(cosine, -1, 1 - 1e-9)
        sine2 = 1 - c * c
        y, node, out = x @ self.directions, np.zeros(len(x), np.int64), np.ones(len(x))
        for j in range(self.levels):
            s = self.split[node]
            right = y[:, j] > s
            off = np.where(right, c * y[:, j] - s, s - c * y[:, j])
            half = chi2_1(off * off / sine2) / 2
            out *= np.where(off >= 0, 0.5 + half, 0.5 - half)
            node = 2 * node + 1 + right
        return out


def log_miss(trees: list[Tree], x: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """Logarithm of the chance that none of the trees has shown a neighbour at ``cosine``."""
    out = np.zeros(len(x))
    for t in trees:
        out += np.log(np.maximum(1 - t.shows(x, cosine), 1e-300))
    return out


def best(sim: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest values of each row from ``least`` on, with what is as good within the slack."""
    if least > -1:
        r, c = np.divmod(np.flatnonzero(sim >= least - SLACK), sim.shape[1])
    else:
        n = min(k, sim.shape[1])
        floor = np.partition(sim, sim.shape[1] - n, axis=1)[:, -n]
        r, c = np.divmod(np.flatnonzero(sim >= np.maximum(floor, -1.5)[:, None] - SLACK), sim.shape[1])
        keep = sim[r, c] > -1.5
        r, c = r[keep], c[keep]
    return _top(r, c, sim[r, c], k)[:2]


def _top(r: np.ndarray, c: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (row, column, value) the k largest of each row, with what is as good within the slack."""
    if not len(r):
        return r, c, v
    order = np.lexsort((-v, r))
    r, c, v = r[order], c[order], v[order]
    first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
    size = np.diff(np.append(first, len(r)))
    kth = np.where(size >= k, v[np.minimum(first + k - 1, len(v) - 1)], -2)
    keep = v >= np.repeat(kth, size) - SLACK
    return r[keep], c[keep], v[keep]


def valid(vectors: DataFrame, key: str, vector: str, dim: Column) -> DataFrame:
    """(id, vector, dim) of the usable rows: not null, of length dim, finite and not all zeros.

    Rows of a null key are left out; of several rows of a key the least vector counts.
    """
    ship(vectors.sparkSession)
    rows = vectors.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vector"), dim.cast("int").alias("dim"))
    return rows.mapInArrow(_usable, "id string, vector array<float>, dim int")


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map from (id, vector, dim) to the rows that are finite, of the stated length and not all zeros."""
    for batch in batches:
        col = batch.column(1)
        there = col.is_valid().to_numpy(zero_copy_only=False)
        off = col.offsets.to_numpy()
        x = col.values.to_numpy(zero_copy_only=False)  # null parts become NaN
        upto = lambda flags: np.concatenate(([0], np.cumsum(flags)))[off]  # noqa: B023, E731
        fine, some = np.diff(upto(np.isfinite(x))), np.diff(upto(x != 0))
        stated = batch.column(2).fill_null(-1).to_numpy()
        size = np.diff(off)
        yield batch.filter(pa.array(there & (size == stated) & (fine == size) & (some > 0)))


def _unit(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, unit vectors in double) of a batch, by length."""
    col = batch.column(column)
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        x = flat[off[rows][:, None] + np.arange(dim)].astype(np.float64)
        x /= np.abs(x).max(1)[:, None]
        yield int(dim), rows, x / np.sqrt((x * x).sum(1))[:, None]


def _whole(x: np.ndarray) -> np.ndarray:
    """Unit rows as 16-bit integers of their largest part."""
    return np.rint(x * (32767 / np.abs(x).max(1))[:, None]).astype(np.int16)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow map from (n, vector) to (n, dim, v): unit vectors as 16-bit integers."""
    for batch in batches:
        n = batch.column(0).to_numpy()
        for dim, rows, x in _unit(batch, 1):
            yield pa.RecordBatch.from_pydict({"n": pa.array(n[rows]), "dim": pa.array(np.full(len(rows), dim, np.int32)), "v": _blobs(_whole(x), np.arange(len(rows) + 1))})


def _opened(values: list[bytes]) -> np.ndarray:
    """Unit rows of packed ones of one length."""
    x = np.frombuffer(b"".join(values), np.int16).reshape(len(values), -1).astype(np.float32)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows, unit rows) of a batch (n, dim, v, ...)."""
    dims = batch.column(1).to_numpy()
    values = batch.column(2).to_pylist()
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        yield int(dim), rows, _opened([values[i] for i in rows] if len(rows) < len(values) else values)


def _blobs(rows: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of rows as binary values."""
    offsets = (cuts * (rows.nbytes // len(rows))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _place(trees: dict[int, list[Tree]], first: int):
    """Arrow map from (n, dim, v, asks): for each tree and leaf one row with all its members of up to HELD_ROWS rows of a task."""

    def flush(dim: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        n, asks, x = (np.concatenate([h[i] for h in held]) for i in range(3))
        v = _whole(x)
        for i, tree in enumerate(trees[dim], first):
            leaf = tree.leaf(x)
            order = np.argsort(leaf, kind="stable")
            name, start = np.unique(leaf[order], return_index=True)
            cuts = np.append(start, len(order))
            fixed = lambda a: pa.array(np.full(len(name), a, np.int32))  # noqa: B023, E731
            cols = {"dim": fixed(dim), "tree": fixed(i), "leaf": pa.array(name.astype(np.int32)), "n": _blobs(n[order], cuts), "asks": _blobs(asks[order], cuts), "v": _blobs(v[order], cuts)}
            yield pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            n, asks = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint8)
            for dim, rows, x in _by_dim(batch):
                held.setdefault(dim, []).append((n[rows], asks[rows], x))
                if sum(len(h[0]) for h in held[dim]) >= HELD_ROWS:
                    yield from flush(dim, held.pop(dim))
        for dim, rest in held.items():
            yield from flush(dim, rest)

    return run


def _meet(k: int, least: float):
    """Arrow group map over a leaf: (n, other, cosine) of the best of every row that asks."""

    def bounded(x: np.ndarray, asking: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each pair once: rows of a block against themselves and what follows; only the first ``asking`` rows ask."""
        out, size = [], 0
        for a in range(0, asking, 512):
            sim = x[a : a + 512] @ x[a:].T
            r, c = np.divmod(np.flatnonzero(sim >= least - SLACK), sim.shape[1])
            r, c = r[r < c], c[r < c]
            v = sim[r, c]
            r, c = r + a, c + a
            back = c < asking
            out.append((np.concatenate([r, c[back]]), np.concatenate([c, r[back]]), np.concatenate([v, v[back]])))
            size += len(out[-1][0])
            if size > 2_000_000:  # a leaf of near copies: only what can stay is held
                out = [_top(*(np.concatenate(z) for z in zip(*out)), k)]
                size = len(out[0][0])
        return _top(*(np.concatenate(z) for z in zip(*out)), k)

    def run(table: pa.Table) -> pa.Table:
        get = lambda c, t: np.frombuffer(b"".join(table.column(c).to_pylist()), t)
        n, asks = get("n", np.int64), get("asks", np.uint8)
        order = np.argsort(1 - asks.astype(np.int8), kind="stable")
        n, asking = n[order], int(asks.sum())
        x = get("v", np.int16).reshape(len(n), -1)[order].astype(np.float32)
        x /= np.sqrt((x * x).sum(1))[:, None]
        none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        if not asking:
            r, c, v = none
        elif least > -1:
            r, c, v = bounded(x, asking)
        else:
            out = []
            for a in range(0, asking, 512):
                part = np.arange(a, min(a + 512, asking))
                sim = x[part] @ x.T
                sim[np.arange(len(part)), part] = -2
                i, j = best(sim, k, least)
                out.append((part[i], j, sim[i, j]))
            r, c, v = (np.concatenate(z) for z in zip(*out))
        return pa.table({"n": n[r], "other": n[c], "cosine": v.astype(np.float64)})

    return run


def _asking(trees: dict[int, list[Tree]], p: float):
    """Arrow map from (n, dim, v, cosine, miss): the rows whose stopping test does not hold yet after these further trees.

    ``miss``: logarithm of the chance that the trees before have not shown the k-th
    neighbour, as it was then; a nearer one since would only make it less.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cosine, before = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for dim, rows, x in _by_dim(batch):
                miss = before[rows] + log_miss(trees[dim], x, cosine[rows])
                more = miss > math.log(1 - p)
                yield pa.RecordBatch.from_pydict({"n": pa.array(n[rows][more]), "miss": pa.array(miss[more])})

    return run


def _scan(sent, k: int, least: float):
    """Arrow map from (n, dim, v): (n, other, cosine), the best of each batch for every query it shares a leaf with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        for batch in batches:
            n = batch.column(0).to_numpy()
            for dim, rows, x in _by_dim(batch):
                if dim not in asked:
                    continue
                ids, q, trees = asked[dim]
                for tree in trees:
                    mine, theirs = tree.leaf(x), tree.leaf(q)
                    for leaf in np.intersect1d(mine, theirs):
                        i, j = np.flatnonzero(mine == leaf), np.flatnonzero(theirs == leaf)
                        for a in range(0, len(j), 512):
                            part = j[a : a + 512]
                            sim = q[part] @ x[i].T
                            sim[ids[part][:, None] == n[rows[i]][None, :]] = -2
                            r, c = best(sim, k, least)
                            yield pa.RecordBatch.from_pydict({"n": pa.array(ids[part][r]), "other": pa.array(n[rows[i]][c]), "cosine": pa.array(sim[r, c].astype(np.float64))})

    return run


def _product(x: Column, y: Column) -> Column:
    add = lambda s, v: s + v
    times = lambda p, q: p.cast("double") * q.cast("double")
    return F.aggregate(F.zip_with(x, y, times), F.lit(0.0), add)


def _kept(found: DataFrame, k: int) -> DataFrame:
    """The k best of each n and what is as good within the slack, with the k-th cosine (null where there are fewer)."""
    one = found.groupBy("n", "other").agg(F.max("cosine").alias("cosine"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(F.desc("cosine"))))
    ranked = ranked.withColumn("kth", F.max(F.when(F.col("rank") == k, F.col("cosine"))).over(Window.partitionBy("n")))
    return ranked.filter(F.col("kth").isNull() | (F.col("cosine") >= F.col("kth") - SLACK)).select("n", "other", "cosine", "kth")


class Forest:
    """The trees of each length of vector, made as they are needed from one bounded sample."""

    def __init__(self, rows: DataFrame):
        sizes = {r.dim: r.n for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.levels = {d: min(max(math.ceil(math.log2(n / LEAF_ROWS)), 0), MAX_LEVELS) for d, n in sizes.items()}
        self.sample: dict[int, np.ndarray] = {}
        for d, n in sizes.items():
            want = max(FIT_LEAST, FIT_PER_LEAF << self.levels[d])
            pick = rows.filter(F.col("dim") == d)
            pick = pick if n <= want else pick.filter(F.pmod(F.xxhash64("n"), F.lit(n)) < want)
            got = [bytes(r.v) for r in pick.select("v").toLocalIterator()] if self.levels[d] else [np.ones(d, np.int16).tobytes()]
            self.sample[d] = _opened(got)

    def trees(self, first: int, last: int) -> dict[int, list[Tree]]:
        return {d: [Tree(x, self.levels[d], i) for i in range(first, last)] for d, x in self.sample.items()}

    def whole(self) -> dict[int, list[Tree]]:
        """A tree of one leaf: everything is compared."""
        return {d: [Tree(x, 0, 0)] for d, x in self.sample.items()}


def _found(rows: DataFrame, asked: DataFrame, k: int, least: float, ws: Workspace, p: float) -> DataFrame:
    """(n, other) candidates of rows (n, dim, v) that hold the k best of every asking row with the stated chance."""
    spark = rows.sparkSession
    forest = Forest(rows)
    found = ws.write(spark.createDataFrame([], "n long, other long, cosine double, kth double"))
    asking, used = asked.select("n", F.lit(0.0).alias("miss")), 0
    left = asking.count()
    single = all(not v for v in forest.levels.values())
    while left > SHARD and used < MAX_TREES:
        trees = forest.trees(used, used + (1 if single else ROUND_TREES))
        flagged = rows.join(asking.select("n", F.lit(True).alias("asks")), "n", "left").select("n", "dim", "v", F.coalesce("asks", F.lit(False)).alias("asks"))
        placed = flagged.mapInArrow(_place(trees, used), "dim int, tree int, leaf int, n binary, asks binary, v binary")
        met = placed.groupBy("dim", "tree", "leaf").applyInArrow(_meet(k, least), "n long, other long, cosine double")
        found, before = ws.write(_kept(found.select("n", "other", "cosine").unionByName(met), k)), found
        ws.drop(before)
        if single:
            return found.select("n", "other")
        used += ROUND_TREES
        kth = F.greatest(F.coalesce("kth", F.lit(least)), F.lit(least)).alias("cosine")
        near = found.groupBy("n").agg(F.max("kth").alias("kth"))
        test = rows.join(asking, "n").join(near, "n", "left").select("n", "dim", "v", kth, "miss")
        asking = ws.write(test.mapInArrow(_asking(trees, p), "n long, miss double"))
        left = asking.count()
    if not left:
        return found.select("n", "other")
    parts = [found.select("n", "other")]
    shard: list = []
    for r in rows.join(asking, "n").select("n", "dim", "v").toLocalIterator():
        shard.append(r)
        if len(shard) == SHARD:
            parts.append(_scanned(rows, shard, forest, used, k, least, ws, p))
            shard = []
    if shard:
        parts.append(_scanned(rows, shard, forest, used, k, least, ws, p))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _scanned(rows: DataFrame, shard: list, forest: Forest, used: int, k: int, least: float, ws: Workspace, p: float) -> DataFrame:
    """(n, other) for a bounded set of queries, which go to the rows: rounds of trees while these read less than the whole."""
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in forest.sample:
        own = [r for r in shard if r.dim == d]
        if own:
            asked[d] = np.array([r.n for r in own], np.int64), _opened([bytes(r.v) for r in own])
    sc = rows.sparkSession.sparkContext
    out: list[DataFrame] = []

    def visit(queries: dict, trees: dict[int, list[Tree]]) -> DataFrame:
        sent = sc.broadcast({d: (*q, trees[d]) for d, q in queries.items()})
        got = ws.write(_kept(rows.select("n", "dim", "v").mapInArrow(_scan(sent, k, least), "n long, other long, cosine double"), k))
        sent.destroy()
        out.append(got.select("n", "other"))
        return got

    done, cosine = 0, {}
    while asked:
        count = 1 if done == 0 else done  # each round doubles the trees
        wide = {d: q for d, q in asked.items() if forest.levels[d]}
        if not wide or done >= MAX_TREES:
            visit(asked, forest.whole())
            break
        got = visit(wide, forest.trees(used + done, used + done + ROUND_TREES * count))
        done += ROUND_TREES * count
        for r in got.groupBy("n").agg(F.max("kth").alias("kth")).collect():  # at most SHARD rows
            cosine[r.n] = max(cosine.get(r.n, least), r.kth if r.kth is not None else least)
        rest: dict = {d: q for d, q in asked.items() if not forest.levels[d]}
        for d, (ids, x) in wide.items():
            miss = log_miss(forest.trees(0, used + done)[d], x, np.array([cosine.get(int(i), least) for i in ids]))
            more = miss > math.log(1 - p)
            # trees the test would still take, each reading one leaf: beyond half of all leaves the whole is read instead
            trees = math.log(1 - p) / np.minimum(miss / (used + done), -1e-12)
            far = more & (trees > 2 ** forest.levels[d] / 2)
            if far.any():
                visit({d: (ids[far], x[far])}, forest.whole())
            if (more & ~far).any():
                rest[d] = ids[more & ~far], x[more & ~far]
        asked = rest
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def most_similar(vectors: DataFrame, k: int, min_cosine: float, ws: Workspace, p: float = P, asked: DataFrame | None = None) -> DataFrame:
    """(id, other, cosine, rank): of every vector its k most similar of the same length, as far as they reach ``min_cosine``.

    vectors: (id string, vector array<float>, dim) as ``valid`` gives them, unique
    ids; asked: (id) of those whose neighbours are wanted, all if left out.  With
    ``min_cosine`` -1 neighbours count however far.  Cosines are exact; a neighbour
    at the k-th cosine (or the least, if that is more) is found with probability p at
    least, a closer one with more.  The trees are fitted on a bounded sample, every
    row is indexed.  Ties go to the lesser id.  No vectors: no rows.

    Of equal vectors k + 1 stand in the index; the others have the first k of them, at
    cosine 1, which is all that their k best can be.  So a group of copies of any size
    adds k rows a copy.
    """
    ship(vectors.sparkSession)
    twin = [F.xxhash64("vector").alias("c1"), F.xxhash64(F.lit(7), "vector").alias("c2")]
    rows = ws.write(vectors.select("id", "vector", "dim", *twin, F.monotonically_increasing_id().alias("n")))
    crowded = ws.write(rows.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > k + 1))
    members = rows.select("id", "c1", "c2").join(crowded, ["c1", "c2"])
    nth = F.row_number().over(Window.partitionBy("c1", "c2").orderBy("id"))
    heads = members.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    tail = members.join(heads.select("id"), "id", "left_anti")
    if crowded.count():
        rows = ws.write(rows.join(tail.select("id"), "id", "left_anti"))
    wanted = rows.select("n", "id") if asked is None else rows.select("n", "id").join(asked.select("id"), "id", "left_semi")
    packed = ws.write(rows.select("n", "vector").mapInArrow(_pack, "n long, dim int, v binary"))
    found = _found(packed, ws.write(wanted.select("n")), k, min_cosine, ws, p)
    side = rows.select("n", F.struct("id", "vector").alias("v"))
    both = found.distinct().join(side.select("n", F.col("v").alias("x")), "n").join(side.select(F.col("n").alias("other"), F.col("v").alias("y")), "other")
    x, y = F.col("x.vector"), F.col("y.vector")
    cosine = _product(x, y) / (F.sqrt(_product(x, x)) * F.sqrt(_product(y, y)))
    near = both.select(F.col("x.id").alias("id"), F.col("y.id").alias("other"), cosine.alias("cosine")).filter(F.col("cosine") >= min_cosine if min_cosine > -1 else F.lit(True))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("cosine", 9)), "other"))
    best_ = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    rest = tail if asked is None else tail.join(asked.select("id"), "id", "left_semi")
    rest = rest.join(heads.filter(F.col("nth") <= k).select("c1", "c2", F.col("id").alias("other"), "nth"), ["c1", "c2"])
    return best_.unionByName(rest.select("id", "other", F.lit(1.0).alias("cosine"), F.col("nth").alias("rank")))
