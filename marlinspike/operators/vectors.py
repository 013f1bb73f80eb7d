"""Vectors: cosine, nearest to a query, note vectors, centring, similar pairs, average-linkage groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlinspike.plans.shipping import ship

#: Rows of one block of an all-pairs comparison; rows one clustering task may hold.
BLOCK_ROWS = 8192
GROUP_ROWS = 5000
PAIR_COSINE, GROUP_DISTANCE, GROUP_LEAST = 0.6, 0.55, 4


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    times = lambda x, y: x.cast("double") * y.cast("double")
    return F.aggregate(F.zip_with(a, b, times), F.lit(0.0), lambda s, v: s + v)


def usable(vector: Column, dim: Column) -> Column:
    """Not null, of the stated length above 0, and finite throughout."""
    return F.coalesce(vector.isNotNull() & (dim > 0) & (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is all zeros."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def nearest_to(rows: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, cosine) of the k rows (id, vector) most similar to one query; rounded to 6 places, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select("id", F.round(cosine(F.col("vector"), q), 6).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(k)


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Distinct hashes of bodies without a usable vector: rows (hash) of chunks (body), vectors (hash, vector, dim)."""
    have = vectors.filter(usable(F.col("vector"), F.col("dim"))).select("hash")
    return chunks.filter("body is not null").select(F.sha2("body", 256).alias("hash")).distinct().join(have, "hash", "left_anti")


def dead_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Hashes of vectors whose body no chunk has any more; null hashes are left out."""
    live = chunks.filter("body is not null").select(F.sha2("body", 256).alias("hash"))
    return vectors.select("hash").filter("hash is not null").join(live, "hash", "left_anti")


def packed(vector: Column) -> Column:
    """A vector as half floats, two bytes a number."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else np.asarray(x, np.float16).tobytes())

    return run(vector)


def unpacked(blob: Column, dim: Column) -> Column:
    """The vector of half floats, null where the bytes are not ``dim`` of them."""

    @F.pandas_udf("array<float>")
    def run(rows: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or len(b) != 2 * n else np.frombuffer(b, np.float16).astype(np.float32) for b, n in zip(rows, sizes)])

    return run(blob, dim)


def encoded(chunks: DataFrame, vectors: DataFrame, encoder: Callable[[list[str]], np.ndarray], dim: int, batch: int = 64) -> DataFrame:
    """(hash, vector, dim) of the bodies without a usable vector, by an encoder from texts to unit rows.

    The encoder goes to the executors and is called with at most ``batch`` texts;
    each distinct body is encoded once.
    """
    ship(chunks.sparkSession)
    bodies = chunks.filter("body is not null").select(F.sha2("body", 256).alias("hash"), "body").groupBy("hash").agg(F.min("body").alias("body"))
    lacking = bodies.join(vectors.filter(usable(F.col("vector"), F.col("dim"))).select("hash"), "hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a in range(0, rows.num_rows, batch):
                part = rows.slice(a, batch)
                x = np.asarray(encoder(part.column(1).to_pylist()), np.float32)
                yield pa.RecordBatch.from_pydict({"hash": part.column(0), "vector": pa.array(list(x), pa.list_(pa.float32())), "dim": pa.array(np.full(len(x), dim, np.int32))})

    return lacking.mapInArrow(run, "hash string, vector array<float>, dim int")


def note_vectors(chunks: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(note_id, vector): normalised mean of the vectors of a note's chunks, by position.

    Partial sums are per task, so a note with a third of all chunks adds one row of
    ``dim`` sums a task.  Notes without a usable vector are left out.
    """
    own = vectors.filter(usable(F.col("vector"), F.col("dim")) & (F.col("dim") == dim)).select("hash", "vector")
    met = chunks.filter("body is not null").select("note_id", F.sha2("body", 256).alias("hash")).join(own, "hash")
    sums = met.groupBy("note_id").agg(*[F.avg(F.col("vector")[i].cast("double")).alias(f"v{i}") for i in range(dim)])
    mean = sums.select("note_id", F.array(*[f"v{i}" for i in range(dim)]).alias("m"))
    return unit(mean, "note_id", "m")


def unit(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) divided by its length; all-zero vectors are left out."""
    n = rows.withColumn("_n", F.sqrt(dot(F.col(vector), F.col(vector)))).filter("_n > 0")
    return n.select(key, F.transform(vector, lambda x: x.cast("double") / F.col("_n")).alias("vector"))


def centred(rows: DataFrame, centre_of: DataFrame, dim: int) -> DataFrame:
    """(id, vector) with the mean of ``centre_of`` taken out, of length 1 again. The mean is one row."""
    mean = centre_of.agg(*[F.avg(F.col("vector")[i].cast("double")).alias(f"m{i}") for i in range(dim)])
    mean = mean.select(F.array(*[f"m{i}" for i in range(dim)]).alias("mean"))
    moved = rows.join(F.broadcast(mean)).select("id", F.zip_with("vector", "mean", lambda x, m: x.cast("double") - m).alias("v"))
    return unit(moved, "id", "v")


def _pair_block(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        b = table.column("b").to_numpy()
        ids = np.array(table.column("id").to_pylist(), dtype=object)
        x = np.array(table.column("vector").to_pylist(), np.float64)
        left, right = np.flatnonzero(b == i), np.flatnonzero(b == j)
        out: list[tuple] = []
        for a in range(0, len(left), 1024):
            sim = x[left[a : a + 1024]] @ x[right].T
            p, q = np.nonzero(sim > threshold)
            for u, v, s in zip(left[a + p], right[q], sim[p, q]):
                if i != j or u < v:
                    out.append((min(ids[u], ids[v]), max(ids[u], ids[v]), float(s)))
        kind = table.schema.field("id").type
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({"a": pa.array(cols[0], kind), "b": pa.array(cols[1], kind), "sim": pa.array(cols[2], pa.float64())})

    return run


def similar_pairs(rows: DataFrame, threshold: float = PAIR_COSINE) -> DataFrame:
    """(a, b, sim), a < b, of unit vectors (id, vector) with an inner product over the threshold.

    Exact, by blocks: rows are dealt into blocks of a bounded size and each pair of
    blocks is one matrix product in its own task.  Meant for a pool of notes; for
    collections of millions an index is the way.
    """
    ship(rows.sparkSession)
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    kind = dict(rows.dtypes)["id"]
    dealt = rows.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    both = dealt.select("id", "vector", "b", other).select("id", "vector", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    return both.groupBy("i", "j").applyInArrow(_pair_block(threshold), f"a {kind}, b {kind}, sim double")


def average_linkage(x: np.ndarray, cut: float) -> np.ndarray:
    """Cluster label of each row: average linkage on cosine distance, merged while the mean distance is under the cut.

    Nearest-neighbour chains with the weighted-mean update; O(n**2) time and memory.
    """
    n = len(x)
    if not n:
        return np.empty(0, np.int64)
    d = np.clip(1 - x @ x.T, 0, None)
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    chain: list[int] = []
    merges: list[tuple[float, int, int]] = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((float(d[a, b]), a, b))
        mixed = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[b], d[:, b] = mixed, mixed
        d[b, b] = np.inf
        d[a], d[:, a] = np.inf, np.inf
        size[b] += size[a]
        alive[a] = False
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for h, a, b in sorted(merges):
        if h < cut:
            parent[root(a)] = root(b)
    label = np.array([root(i) for i in range(n)])
    return np.unique(label, return_inverse=True)[1]


def groups(rows: DataFrame, cut: float = GROUP_DISTANCE, least: int = GROUP_LEAST) -> DataFrame:
    """(id, label) of the groups of at least ``least`` unit vectors (id, vector).

    Average linkage needs all distances at once, so one task holds the pool; more
    than GROUP_ROWS rows are refused rather than sampled.
    """
    ship(rows.sparkSession)
    if (n := rows.limit(GROUP_ROWS + 1).count()) > GROUP_ROWS:
        raise ValueError(f"{n} or more rows: average linkage is for at most {GROUP_ROWS}")
    kind = dict(rows.dtypes)["id"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        label = average_linkage(np.array(table.column("vector").to_pylist(), np.float64), cut)
        keep = np.bincount(label)[label] >= least
        return pa.table({"id": table.column("id").filter(pa.array(keep)), "label": pa.array(label[keep])})

    return rows.groupBy(F.lit(1).alias("g")).applyInArrow(lambda t: run(t.drop_columns(["g"]) if "g" in t.column_names else t), f"id {kind}, label long")


def linkage_by_means(x: np.ndarray, cut: float) -> np.ndarray:
    """As ``average_linkage``, of unit rows, in memory that grows with the rows and not with their square.

    The mean distance of two clusters is 1 minus the product of their mean rows, so
    clusters are kept as means.  Each round merges all pairs under the cut that are
    each other's nearest; a merge brings no cluster nearer to another than the nearer
    of its parts was, so only those that lost their nearest look again, and one with
    none under the cut stays as it is.
    """
    mean, size = x.copy(), np.ones(len(x))
    parent, near, far = np.arange(len(x)), np.full(len(x), -1), np.full(len(x), np.inf)
    live = look = np.arange(len(x))
    while len(live):
        for k in range(0, len(look), 256):
            part = look[k : k + 256]
            d = np.clip(1 - mean[part] @ mean[live].T, 0, None)
            d[part[:, None] == live[None, :]] = np.inf
            best = d.argmin(1)
            near[part], far[part] = live[best], d[np.arange(len(part)), best]
        live = live[far[live] < cut]
        a = live[(near[near[live]] == live) & (live < near[live])]
        b = near[a]
        if len(live) and not len(a):  # rounding may break a tie differently on its two sides
            a = live[[far[live].argmin()]]
            b = near[a]
        whole = size[a] + size[b]
        mean[a] = (size[a, None] * mean[a] + size[b, None] * mean[b]) / whole[:, None]
        size[a], parent[b] = whole, a
        gone = np.isin(near[live], np.concatenate([a, b])) | np.isin(live, a)
        look, live = live[gone & ~np.isin(live, b)], live[~np.isin(live, b)]
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return np.unique(parent, return_inverse=True)[1]


def groups_of_any(rows: DataFrame, cut: float = GROUP_DISTANCE, least: int = GROUP_LEAST) -> DataFrame:
    """As ``groups``, for any number of rows: beyond GROUP_ROWS by ``linkage_by_means``.

    One task still holds all vectors, and its time grows with the square of the rows.
    """
    if rows.limit(GROUP_ROWS + 1).count() <= GROUP_ROWS:
        return groups(rows, cut, least)
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)["id"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        label = linkage_by_means(flat.reshape(len(table), -1).astype(np.float64), cut)
        keep = np.bincount(label)[label] >= least
        return pa.table({"id": table.column("id").filter(pa.array(keep)), "label": pa.array(label[keep])})

    return rows.groupBy(F.lit(1).alias("g")).applyInArrow(lambda t: run(t.select(["id", "vector"])), f"id {kind}, label long")


def plane(rows: DataFrame, dim: int) -> DataFrame:
    """(id, x, y): the two main directions of vectors (id, vector), found from a covariance of dim * dim sums."""
    ship(rows.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, c = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, dim)
            n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), "s": pa.array([s.tolist()]), "c": pa.array([c.ravel().tolist()])})

    parts = rows.select("vector").mapInArrow(partial, "n long, s array<double>, c array<double>").collect()  # one row a task
    n = max(sum(r.n for r in parts), 1)
    mean = np.sum([r.s for r in parts], axis=0) / n
    cov = np.sum([r.c for r in parts], axis=0).reshape(dim, dim) / n - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :2].T
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    at = lambda k: F.round(dot(F.zip_with("vector", F.array(*[F.lit(float(m)) for m in mean]), lambda v, m: v - m), F.array(*[F.lit(float(a)) for a in axes[k]])), 6)
    return rows.select("id", at(0).alias("x"), at(1).alias("y"))
