"""Long exact spans shared between records, by content-defined chunking.

Cut points are minima of a gear rolling hash (64 bytes) over windows of 68
positions.  Two disjoint windows fit into the 137 hash positions of any stretch of
200 bytes, so a shared stretch always holds two common cut points, and the chunk
between them (with the 64 bytes that decide its first cut) is the same in both
texts, whatever was inserted before.  Chunks are compared by digest; equal chunks
are widened to windows of nearly the asked length, and windows of equal digest are
classed by the characters beside them, which decides every stretch of the asked
length exactly.  Work grows with the shared text, not with the pairs that share it;
pairs are formed only where they are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlinspike.llm.kernels import GEAR_BYTES, U64, cut_points, slices
from marlinspike.plans.members import member_pairs
from marlinspike.plans.shipping import ship
from marlinspike.plans.workspace import Workspace

#: Windows of widened chunks start at multiples of this many characters from a chunk.
STEP = 16
#: Digests that occur in several texts are broadcast up to this many, joined by shuffle beyond.
BROADCAST_DIGESTS = 2_000_000


def window_size(min_chars: int) -> int:
    """Largest window for which every stretch of min_chars bytes holds a whole chunk."""
    return (min_chars - GEAR_BYTES + 1) // 2


def chunks_of(blobs: list[bytes], w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, first byte, end byte) of every chunk of the given texts."""
    size = np.fromiter(map(len, blobs), np.int64, len(blobs))
    starts = np.zeros(len(blobs) + 1, np.int64)
    np.cumsum(size, out=starts[1:])
    cuts = cut_points(np.frombuffer(b"".join(blobs), np.uint8), starts[:-1], w)
    doc = np.searchsorted(starts, cuts, side="right") - 1
    same = np.flatnonzero(doc[1:] == doc[:-1])
    doc = doc[same]
    return doc, cuts[same] - (GEAR_BYTES - 1) - starts[doc], cuts[same + 1] + 1 - starts[doc]


def _digests(blobs: list[bytes], doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    f = xxhash.xxh3_64_intdigest
    it = (f(blobs[d][a:b]) for d, a, b in zip(doc.tolist(), lo.tolist(), hi.tolist()))
    return np.fromiter(it, U64, len(doc)).view(np.int64)


def _chunk_rows(w: int, positions: bool):
    """Arrow map from (id, text): rows (digest, id, lo, hi) or (digest, text hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                blobs = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
                doc, lo, hi = chunks_of(blobs, w)
                digest = _digests(blobs, doc, lo, hi)
                if positions:
                    cols = {"digest": digest, "id": ids[a:b][doc], "lo": lo, "hi": hi}
                else:
                    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, blobs), U64, len(blobs)).view(np.int64)
                    cols = {"digest": digest, "text": whole[doc]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()})

    return run


def _windows(min_chars: int):
    """Arrow map from (id, text, spots): (key, id, pos, left, right) of the windows around shared chunks.

    A window has ``STEP`` characters less than a stretch; left and right are up to
    ``STEP`` characters beside it, so they tell every stretch the window is part of.
    """
    size = min_chars - STEP

    def starts(text: str, spots: list[dict]) -> list[int]:
        data = text.encode("utf-8", "surrogatepass")
        chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        out = set()
        for s in spots:
            lo, hi = int(chars[s["lo"]]) - 1, int(chars[s["hi"] - 1])
            least = max(lo - max(min_chars - (hi - lo), 0), 0)
            out.update(p for p in range(lo, least - 1, -STEP) if p + size <= len(text))
        return sorted(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = xxhash.xxh3_128_digest
        for batch in batches:
            for i, text, spots in zip(*(batch.column(c).to_pylist() for c in range(3))):
                at = starts(text, spots)
                cols = {
                    "key": pa.array([f(text[p : p + size].encode("utf-8", "surrogatepass")) for p in at], pa.binary()),
                    "id": pa.array(np.full(len(at), i)), "pos": pa.array(at, pa.int32()),
                    "left": pa.array([text[max(p - STEP, 0) : p] for p in at], pa.string()), "right": pa.array([text[p + size : p + size + STEP] for p in at], pa.string()),
                }
                yield pa.RecordBatch.from_pydict(cols)

    return run


def copies(docs: DataFrame) -> DataFrame:
    """(id, rep) of rows (id, text): the least id of those with the same text."""
    h = docs.select("id", F.unhex(F.sha2("text", 256)).alias("h"))
    reps = h.groupBy("h").agg(F.min("id").alias("rep"), F.max("id").alias("last")).filter("rep <> last").select("h", "rep")
    return h.join(reps, "h").select("id", "rep").distinct()


def shared_windows(docs: DataFrame, min_chars: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """The stretches that stand in several different texts, as groups, and the groups of equal texts.

    docs: (id long, text string), of which null ids, null texts and texts under
    ``min_chars`` characters take no part; repeated rows count once.  ``min_chars``
    must be at least 130, or chunks would be empty.  Returns

    (class, l, sub, id, lo, hi): the texts (least ids of equal ones) with equal
    (class, l, sub) share the characters from lo to hi of each, ``min_chars`` or more;
    and (id, rep) of the texts that occur several times.

    No pair is formed.  Windows around common chunks are classed by their characters
    and those beside them; all stretches through a window are common to the members
    of its class.  Classes of one window are compared by stretch: the characters
    beside them that a stretch holds are few, so each has ``STEP`` + 1 keys.
    """
    spark = docs.sparkSession
    ship(spark)
    w = window_size(min_chars)
    if w < 33:
        raise ValueError("min_chars must be at least 130")
    docs = docs.select("id", "text").filter(F.col("id").isNotNull() & (F.length("text") >= min_chars))
    same = ws.write(copies(docs))
    seen = docs.mapInArrow(_chunk_rows(w, False), "digest long, text long").groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
    shared = ws.write(seen.filter("lo <> hi").select("digest"))
    few = shared.count() <= BROADCAST_DIGESTS
    spots = docs.mapInArrow(_chunk_rows(w, True), "digest long, id long, lo long, hi long")
    spots = spots.join(F.broadcast(shared) if few else shared.hint("shuffle_hash"), "digest", "left_semi")
    spots = spots.join(same.filter("id <> rep").select("id"), "id", "left_anti")
    spots = spots.groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("spots"))
    made = ws.write(docs.join(spots, "id").select("id", "text", "spots").mapInArrow(_windows(min_chars), "key binary, id long, pos int, left string, right string"))
    often = made.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a <> b").select("key")
    live = ws.write(made.join(often, "key", "left_semi").withColumn("class", F.xxhash64("key", "left", F.lit("|"), "right")))
    ws.drop(made)
    side = ["key", "class", "left", "right"]
    classes = ws.write(live.groupBy(*side).agg(F.min("id").alias("id"), F.max("id").alias("last")))
    # the stretches through a window, by how many of the characters to its left they take
    most, least = F.length("left"), F.greatest(F.lit(STEP) - F.length("right"), F.lit(0))
    cut = F.explode(F.sequence(least, most)).alias("l")
    each = classes.select("key", "class", "id", "left", "right", cut)
    sub = F.concat(F.expr("right(left, l)"), F.lit("|"), F.expr(f"left(right, {STEP} - l)"))
    each = each.select("key", "class", "l", sub.alias("sub"))
    met = each.groupBy("key", "l", "sub").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    across = ws.write(each.join(met.select("key", "l", "sub"), ["key", "l", "sub"], "left_semi"))
    inside = live.join(classes.filter("id <> last").select("key", "class"), ["key", "class"], "left_semi")
    end = F.col("pos") + min_chars
    whole = inside.select("key", F.col("class"), F.lit(-1).alias("l"), F.lit("").alias("sub"), "id", (F.col("pos") - most).alias("lo"), (end - least).alias("hi"))
    partly = live.join(across, ["key", "class"]).select("key", F.lit(0).cast("long").alias("class"), "l", "sub", "id", (F.col("pos") - F.col("l")).alias("lo"), (end - F.col("l")).alias("hi"))
    found = ws.write(whole.unionByName(partly))
    ws.drop(live, classes, across)
    return found, same


def shared_pairs(docs: DataFrame, min_chars: int, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of different texts with a common stretch (least ids of equal texts), and (id, rep) of equal texts."""
    found, same = shared_windows(docs, min_chars, ws)
    return ws.write(member_pairs(found, ["key", "class", "l", "sub"], ws)), same


def expand(pairs: DataFrame, same: DataFrame, ws: Workspace) -> DataFrame:
    """All pairs of ids (a, b), copies included, of pairs of least ids."""
    p = pairs.select("a", "b")
    for c in ("a", "b"):
        more = same.select(F.col("rep").alias(c), F.col("id").alias("_id"))
        p = p.join(more, c, "left").select(*[x for x in p.columns if x != c], F.coalesce("_id", c).alias(c))
    twins = member_pairs(same, ["rep"], ws)
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(twins).distinct()


def coverage(docs: DataFrame, found: DataFrame, same: DataFrame) -> DataFrame:
    """For each record its characters, how many stand elsewhere too, and the stretches.

    One row for each id of ``docs`` (id, text); found and same as ``shared_windows``
    gives them; texts with copies are shared whole.  A null text counts 0 characters.
    """
    spans = found.groupBy("id", "lo").agg(F.max("hi").alias("hi"))
    before = Window.partitionBy("id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.coalesce(F.max("hi").over(before), F.lit(0)))
    joined = spans.withColumn("part", F.sum((F.col("lo") > F.col("reach")).cast("int")).over(Window.partitionBy("id").orderBy("lo", "hi")))
    runs = joined.groupBy("id", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    each = runs.groupBy("id").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("stretches"))
    twin = same.select("id", "rep")
    out = docs.select("id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")).distinct()
    out = out.join(twin, "id", "left").join(each, "id", "left")
    whole = F.col("rep").isNotNull()
    shared = F.when(whole, F.col("n_chars")).otherwise(F.coalesce("n", F.lit(0)))
    full = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_chars").alias("hi")))
    return out.select(
        "id", "n_chars", shared.alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).alias("shared_part"),
        F.when(whole, full).otherwise(F.coalesce("stretches", F.array().cast("array<struct<lo:bigint,hi:bigint>>"))).alias("stretches"),
    )
