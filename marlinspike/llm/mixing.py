"""Mixing sources to target weights along a time-varying schedule.

Each source has a weight schedule over the training time 0..1.  Its integral is the
tokens asked of the source up to a time; the copies of the source's documents, laid
end to end in a fixed random order, are its supply.  A copy's position is the time at
which the demand reaches the tokens before it, so at any time the tokens taken so far
have the shares of the integrated weights.  Documents are then range-sorted by position.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlinspike.plans.ordered import prefix_sum
from marlinspike.plans.shipping import ship
from marlinspike.plans.workspace import Workspace

#: Ranks of a public byte-level vocabulary, and how it cuts text before merging (fixed value).
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Target tables of up to this many rows are broadcast, larger ones joined by shuffle.
BROADCAST_TARGETS = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "source", "tokens"])

    return run


def sizes(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(id, source, tokens) of rows (id long, source string, text string); null and empty texts have 0."""
    ship(docs.sparkSession)
    return docs.select("id", "source", "text").mapInArrow(_count(ranks), "id long, source string, tokens long")


def schedule(targets: DataFrame) -> DataFrame:
    """(source, share, segments) of knots (source, t, weight).

    A null or negative weight is 0; weights are rescaled to sum 1 at every knot and
    run straight in between, so they sum to 1 throughout; before a source's first
    and after its last knot its weight stays.  All sources should have the same
    knots.  ``share`` is the integral over 0..1; a segment has its ends t0, t1, the
    weights there and the integral before and after it.
    """
    w = F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(0.0)).cast("double")
    knots = targets.filter("source is not null and t between 0 and 1").groupBy("source", "t").agg(F.max(w).alias("weight"))
    total = knots.groupBy("t").agg(F.sum("weight").alias("total"))
    knots = knots.join(total, "t").select("source", "t", F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(0.0).alias("w"))
    rows = knots.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("t", "w"))).alias("k"))
    first, last = F.col("k")[0], F.element_at("k", -1)
    whole = F.concat(F.array(F.struct(F.lit(0.0).alias("t"), first["w"].alias("w"))), F.col("k"), F.array(F.struct(F.lit(1.0).alias("t"), last["w"].alias("w"))))
    rows = rows.select("source", F.posexplode(F.arrays_zip(F.slice(whole, F.lit(1), F.size(whole) - 1).alias("a"), F.slice(whole, F.lit(2), F.size(whole) - 1).alias("b"))).alias("i", "s"))
    rows = rows.select("source", "i", F.col("s.a.t").alias("t0"), F.col("s.b.t").alias("t1"), F.col("s.a.w").alias("w0"), F.col("s.b.w").alias("w1")).filter("t1 > t0")
    area = (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0"))
    upto = F.sum(area).over(Window.partitionBy("source").orderBy("i"))
    rows = rows.withColumn("c1", upto).withColumn("c0", F.col("c1") - area)
    return rows.groupBy("source").agg(F.max("c1").alias("share"), F.array_sort(F.collect_list(F.struct("t0", "t1", "w0", "w1", "c0", "c1"))).alias("segments"))


def _time(asked: Column, segments: Column) -> Column:
    """The time at which the integral of the schedule reaches ``asked``."""
    s = F.coalesce(F.filter(segments, lambda x: x["c1"] > asked)[0], F.element_at(segments, -1))
    rest = F.greatest(asked - s["c0"], F.lit(0.0))
    slope = (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
    # w0 x + slope x**2 / 2 = rest, in the form that also holds for slope 0
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * slope * rest, F.lit(0.0)))
    return s["t0"] + F.when(s["w0"] + root > 0, 2 * rest / (s["w0"] + root)).otherwise(0.0)


def demand(sized: DataFrame, knots: DataFrame, repeats: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, share, segments, supply, repeats, total, asked) of every target source.

    supply: tokens of the source; total: size of the mixture, the most that every
    source with tokens can bear with its repeats, or less if asked for; asked: the
    source's part of it.  A null or too small max_repeats is 1.  A source without
    tokens or without weight is asked for nothing, and the others keep their
    proportions.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("supply"))
    times = repeats.groupBy("source").agg(F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("repeats"))
    plan = schedule(knots).join(have, "source", "left").join(times, "source", "left").withColumn("supply", F.coalesce("supply", F.lit(0))).withColumn("repeats", F.coalesce("repeats", F.lit(1)))
    usable = (F.col("supply") > 0) & (F.col("share") > 0)
    bear = F.min(F.when(usable, F.col("supply") * F.col("repeats") / F.col("share")))
    bound = plan.agg(bear.alias("total"), F.sum(F.when(usable, F.col("share"))).alias("usable")).first()
    total = bound.total
    if total is not None and total_tokens is not None:
        total = min(total, total_tokens / bound.usable)
    plan = plan.withColumn("total", F.lit(total).cast("double"))
    return plan.withColumn("asked", F.when(usable, F.col("share") * F.col("total")).otherwise(0.0))


def mixture(sized: DataFrame, plan: DataFrame, ws: Workspace, seed: int = 1) -> DataFrame:
    """(id, source, copy, tokens, position) in training order.

    sized: (id, source, tokens), one row an id; plan as ``demand`` gives it.
    Documents without tokens or of a source without target are left out.  The tokens
    of a source miss what is asked of it by half a document at most.
    """
    few = plan.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
    part = plan.filter("asked > 0").select("source", "segments", "supply", "total", "asked")
    docs = sized.filter("tokens > 0").join(F.broadcast(part.select("source")) if few else part.select("source"), "source", "left_semi")
    laid = prefix_sum(docs.withColumn("h", F.xxhash64("id", F.lit(seed))), ["source"], ["h", "id"], "tokens", "before", ws)
    met = laid.join(F.broadcast(part) if few else part, "source")
    middle = F.col("before") + F.col("tokens") / 2  # a copy counts if most of it is asked for
    copies = F.ceil((F.col("asked") - middle) / F.col("supply"))
    each = met.filter(middle < F.col("asked")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)).cast("int") - 1)))
    start = (F.col("before") + F.col("copy") * F.col("supply")) / F.col("total")
    return each.select("id", "source", "copy", "tokens", _time(start, F.col("segments")).alias("position")).orderBy("position", "source", "id", "copy")


def shares(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """For every target source the share asked, the share reached, how often documents repeat, and the tokens never drawn."""
    first = F.when(F.col("copy") == 0, F.col("tokens"))
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("copies"), F.max(F.col("copy") + 1).alias("most_copies"), F.sum(first).alias("drawn"))
    whole = mixed.agg(F.sum("tokens").alias("n")).first().n
    out = plan.select("source", "share", "supply", "repeats").join(got, "source", "left").withColumn("all", F.lit(whole))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    reached = F.round(F.coalesce(F.col("tokens"), F.lit(0)) / F.col("all"), 6).alias("share")
    return out.select("source", F.round("share", 6).alias("target_share"), reached, "supply", n("tokens"), n("copies"), n("most_copies"), F.col("repeats").alias("max_repeats"), (F.col("supply") - F.coalesce("drawn", F.lit(0))).alias("unused_tokens"))


def _asked_until(t: Column, segments: Column) -> Column:
    """The integral of the schedule up to a time."""
    x = lambda s: F.least(F.greatest(t, s["t0"]), s["t1"]) - s["t0"]
    area = lambda s: x(s) * (s["w0"] + (s["w1"] - s["w0"]) / (s["t1"] - s["t0"]) * x(s) / 2)
    return F.aggregate(segments, F.lit(0.0), lambda sum_, s: sum_ + area(s))


def shares_by_time(plan: DataFrame, mixed: DataFrame, parts: int = 4) -> DataFrame:
    """(part, source, target_share, share): shares inside each of ``parts`` equal stretches of the training time.

    The targets are those of the sources that are asked for something, rescaled to sum 1.
    """
    part = F.least(F.floor(F.col("position") * parts), F.lit(parts - 1)).cast("int")
    got = mixed.groupBy(part.alias("part"), "source").agg(F.sum("tokens").alias("tokens"))
    each = plan.filter("asked > 0").select("source", "segments", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    aim = _asked_until((F.col("part") + 1) / parts, F.col("segments")) - _asked_until(F.col("part") / parts, F.col("segments"))
    met = each.select("part", "source", aim.alias("aim")).join(got, ["part", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = Window.partitionBy("part")  # one row a source
    return met.select("part", "source", F.round(F.col("aim") / F.sum("aim").over(whole), 6).alias("target_share"), F.round(F.col("tokens") / F.sum("tokens").over(whole), 6).alias("share"))
