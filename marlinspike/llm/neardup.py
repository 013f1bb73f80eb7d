"""Near-duplicate records by SetSketch.

Every record is a set of shingles.  A sketch has registers
``floor(1 - log_b(h))`` of the least exponentially distributed hash h of the set:
truncated minima on an exponential scale, mergeable by maximum, equal in two
sketches with a probability that grows with the similarity.  Records that agree in
all registers of some band are candidates; their similarity is estimated from how
many registers are greater, less and equal by maximum likelihood; what may reach
the threshold is verified on the shingles themselves.

Records of equal words are one class from the start: only its least id goes on.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlinspike.llm.kernels import U64, odd_constants, shingle_hashes, slices, splitmix, word_hashes
from marlinspike.operators.components import components
from marlinspike.plans.members import member_pairs
from marlinspike.plans.shipping import ship
from marlinspike.plans.workspace import Workspace

#: Base of the register scale and rate of the hashes: 16 bits hold any set size.
BASE, RATE = 1.001, 20.0
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Plan:
    """How records are compared.

    unit: 'word' or 'char' (of the words written with one blank between); shingle:
    units of a shingle; least_units: records of fewer take no part; registers, bands
    and rows: sketch size, number of bands and registers of a band, which are drawn
    with a fixed seed; margin: how far under the threshold an estimate may stay.
    """

    unit: str
    threshold: float
    registers: int
    bands: int
    rows: int
    shingle: int = 3
    least_units: int = 1
    margin: float = 0.2

    def picks(self) -> np.ndarray:
        """Registers of each band."""
        rng = np.random.default_rng(17)
        return np.array([np.sort(rng.choice(self.registers, self.rows, replace=False)) for _ in range(self.bands)])


def units(texts: list[str], plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units of each text, and offsets."""
    if plan.unit == "word":
        return word_hashes(texts)
    plain = [" ".join(_WORD.findall(t.lower())) for t in texts]
    off = np.zeros(len(plain) + 1, np.int64)
    np.cumsum([len(p) for p in plain], out=off[1:])
    cps = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    return splitmix(cps.astype(U64)), off


def sketches(texts: list[str], plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of the texts that take part: index, number of distinct shingles, registers, and digest of the units."""
    u, off = units(texts, plan)
    sh, so = shingle_hashes(u, off, plan.shingle)
    size = np.diff(off)
    live = np.flatnonzero((size >= plan.least_units) & (np.diff(so) > 0))
    if not len(live):
        return live, live, np.empty((0, plan.registers), np.uint16), []
    owner = np.repeat(np.arange(len(texts)), np.diff(so))
    order = np.lexsort((sh, owner))
    a, b = sh[order], owner[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    count = np.bincount(b[new], minlength=len(texts))[live]
    starts = so[:-1][np.flatnonzero(np.diff(so) > 0)]
    rows = np.flatnonzero(np.diff(so) > 0)
    least = np.empty((plan.registers, len(rows)), U64)
    buf = np.empty_like(sh)
    for i, mult in enumerate(odd_constants(plan.registers, 23)):
        np.multiply(sh, mult, out=buf)
        np.minimum.reduceat(buf, starts, out=least[i])
    least = least[:, np.searchsorted(rows, live)]
    h = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 2.0**-53)) / RATE
    reg = np.clip(np.floor(1 - np.log(np.maximum(h, 1e-300)) / math.log(BASE)), 0, 65535).astype(np.uint16)
    digests = [xxhash.xxh3_128_digest(u[off[i] : off[i + 1]].tobytes()) for i in live]
    return live, count, np.ascontiguousarray(reg.T), digests


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity of rows of registers of sets of na and nb elements."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = na / (na + nb)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def loss(j: np.ndarray) -> np.ndarray:
        pm, pl = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return -(more * np.log(pm + tiny) + less * np.log(pl + tiny) + same * np.log(np.maximum(1 - pm - pl, 0) + tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        x, y = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = loss(x) < loss(y)
        hi = np.where(left, y, hi)
        lo = np.where(left, lo, x)
    return (lo + hi) / 2


def similarity(ta: list[str], tb: list[str], plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Exact numbers of common and of all distinct shingles of pairs of texts."""

    def tagged(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sh, so = shingle_hashes(*units(texts, plan), plan.shingle)
        owner = np.repeat(np.arange(len(texts)), np.diff(so))
        key, first = np.unique(splitmix(sh ^ (owner.astype(U64) * odd_constants(1, 31)[0])), return_index=True)
        return key, owner[first]

    (ka, oa), (kb, ob) = tagged(ta), tagged(tb)
    both = np.bincount(oa[np.isin(ka, kb)], minlength=len(ta))
    return both, np.bincount(oa, minlength=len(ta)) + np.bincount(ob, minlength=len(ta)) - both


def _sketch_rows(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                live, n, reg, digests = sketches(texts[a:b], plan)
                raw, size = reg.tobytes(), reg.shape[1] * 2
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": pa.array(ids[a:b][live], pa.int64()),
                        "class": pa.array(digests, pa.binary()),
                        "n": pa.array(n, pa.int64()),
                        "sketch": pa.array([raw[i * size : (i + 1) * size] for i in range(len(live))], pa.binary()),
                    }
                )

    return run


def _band_rows(plan: Plan):
    """Arrow map from (id, sketch): a row (id, key) for each band."""
    picks = plan.picks()
    weights = odd_constants(plan.rows, 41)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reg = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, -1).astype(U64)
            key = np.empty((len(reg), plan.bands), U64)
            for i, pick in enumerate(picks):
                key[:, i] = splitmix((splitmix(reg[:, pick]) * weights).sum(1) + U64(i))
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), plan.bands)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "key": pa.array(key.view(np.int64).ravel())})

    return run


def _estimated(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
            keep = pa.array(estimate(a, b, na, nb) >= plan.threshold - plan.margin)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _verified(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            ta, tb = (batch.column(c).to_pylist() for c in ("ta", "tb"))
            for i, j in slices(ta):
                both, either = similarity(ta[i:j], tb[i:j], plan)
                sim = both / np.maximum(either, 1)
                ok = sim >= plan.threshold
                yield pa.RecordBatch.from_pydict({"a": pa.array(a[i:j][ok]), "b": pa.array(b[i:j][ok]), "similarity": pa.array(sim[ok])})

    return run


class Sketched:
    """Records of one kind with their sketches: classes of equal ones, and band keys of the least id of each.

    rows: (id long, text string); null ids, null texts and texts without a shingle
    or of too few units take no part, repeated rows count once.  ``same`` is
    (id, rep) of the records whose units occur in several records.
    """

    def __init__(self, rows: DataFrame, plan: Plan, ws: Workspace):
        ship(rows.sparkSession)
        self.plan, self.ws = plan, ws
        self.rows = rows.select("id", "text").filter(F.col("id").isNotNull() & F.col("text").isNotNull())
        self.made = ws.write(self.rows.mapInArrow(_sketch_rows(plan), "id long, class binary, n long, sketch binary").dropDuplicates(["id", "class"]))
        classes = self.made.groupBy("class").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep <> last").select("class", "rep")
        self.same = ws.write(self.made.select("id", "class").join(classes, "class").select("id", "rep"))
        reps = self.made.join(self.same.filter("id <> rep").select("id"), "id", "left_anti").dropDuplicates(["id"])
        self.keyed = reps.select("id", "sketch").mapInArrow(_band_rows(plan), "id long, key long")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the candidate pairs (a, b) that reach the threshold: estimated on sketches, then exact."""
        side = lambda c: self.made.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
        likely = self.ws.write(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimated(self.plan), "a long, b long"))
        text = lambda c: self.rows.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
        near = likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb")
        found = self.ws.write(near.mapInArrow(_verified(self.plan), "a long, b long, similarity double").distinct())
        self.ws.drop(likely)
        return found


def near_duplicates(rows: DataFrame, plan: Plan, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """All pairs of different records that are similar, and the classes of equal ones.

    Returns (a, b, similarity), a < b the least ids of their classes, similarity
    exact; and (id, rep) of the records whose units occur in several records.
    """
    s = Sketched(rows, plan, ws)
    found = s.verify(member_pairs(s.keyed, ["key"], ws, unique=True))
    ws.drop(s.made)
    return found, s.same


def groups(rows: DataFrame, plan: Plan, ws: Workspace) -> DataFrame:
    """(id, group) of every record that is similar or equal to another; the group is its least id.

    Groups are the connected components of the similar pairs, found without listing
    them: every record of a bucket is compared with the bucket's least id first, which
    labels it with the least such id that is similar, and that one's own label in turn;
    only members of a bucket with different labels are compared with each other, so a
    bucket of n near copies costs n comparisons.  No link between components is lost.  Copies are joined to their class afterwards, one row each.
    """
    s = Sketched(rows, plan, ws)
    heads = s.keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a <> last").select("key", "a")
    live = ws.write(s.keyed.join(heads, "key"))
    star = live.filter("id <> a").select("a", F.col("id").alias("b")).distinct()
    first = s.verify(star)
    up = ws.write(first.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("c")))
    for _ in range(2):  # the least head of a head: records of one label are connected, which is all that is asked of it
        head = up.select(F.col("id").alias("c"), F.col("c").alias("_c"))
        up = ws.write(up.join(head, "c", "left").select("id", F.coalesce("_c", "c").alias("c")))
    placed = live.join(up, "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
    apart = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("key")
    rest = ws.write(placed.join(apart, "key", "left_semi"))
    cross = member_pairs(rest.select("key", "id"), ["key"], ws, unique=True)
    own = rest.select("id", "c").distinct()
    cross = cross.join(own.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(own.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").filter("ca <> cb").select("a", "b")
    links = first.unionByName(s.verify(cross.join(star, ["a", "b"], "left_anti"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    linked = components(links, ws)
    label = s.same.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("group"))
    alone = linked.join(s.same.select("id"), "id", "left_anti").select("id", F.col("component").alias("group"))
    return label.unionByName(alone)


#: Bodies: half of the three-word shingles; titles: 0.6 of the three-character ones.
#: A pair exactly at the threshold is missed with a probability of 0.0009 and 0.001 (simulated with these bands, which share registers).
BODIES = Plan("word", 0.5, registers=96, bands=80, rows=3, least_units=20)
TITLES = Plan("char", 0.6, registers=256, bands=200, rows=6)
