"""Evaluation items leaking into training text: a BM25 index of the items, queried with every passage.

The items are indexed; every passage of every document is a query.  All items
whose score reaches their own threshold are retrieved, then the word overlap is
checked.  The threshold of an item is the least BM25 score that any run of
``min_words`` consecutive words of it can get, so no passage that holds such a
run can score below it; scores are divided by it, and the retrieval asks for 1.

Terms are runs of ``TERM_WORDS`` consecutive words.  Single words do not separate
here: a passage of 24 words reaches the threshold of two hundred items by
function words alone, which makes retrieval as dear as comparing everything.

The index keeps, for each term, the blocks of items it stands in with its largest
impact there.  As in block-max WAND, a passage whose terms cannot reach the bound
together is passed over; of the others only the terms that are needed to reach it
open their blocks, the common ones being skipped; a block is read if the maxima of
all terms in it reach the bound, and only then its postings are scored.  A slice of
passages is evaluated at a time instead of one by cursors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlinspike.llm.kernels import U64, odd_constants, shingle_hashes, slices, splitmix, word_hashes
from marlinspike.plans.shipping import ship
from marlinspike.plans.workspace import Workspace

K1, B = 1.2, 0.75
#: Words of one index term.
TERM_WORDS = 2
#: Items of one block of the index.
BLOCK = 64
#: Items and characters of one shard of the index, which is what a broadcast holds: at most about 12 bytes of index a byte of text.
SHARD_ITEMS, SHARD_CHARS = 4096, 4 << 20


@dataclass
class Index:
    """One shard: terms sorted by hash, postings by (term, block, item) with impacts over the item's threshold."""

    items: np.ndarray  # item id of each position
    terms: np.ndarray  # sorted word hashes
    top: np.ndarray  # largest impact of each term
    ptr: np.ndarray  # first (term, block) entry of each term
    cell: np.ndarray  # term * blocks + block of each entry, sorted; an entry for each block a term stands in
    cell_top: np.ndarray  # largest impact of each entry
    post: np.ndarray  # first posting of each entry
    post_item: np.ndarray  # item position inside its block
    post_impact: np.ndarray
    grams: np.ndarray  # sorted hashes of (run of min_words words, item)
    blocks: int
    min_words: int
    term_words: int

    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values() if isinstance(v, np.ndarray))


def _tag(gram: np.ndarray, item: np.ndarray) -> np.ndarray:
    return splitmix(gram ^ (item.astype(U64) * odd_constants(1, 77)[0]))


def build_index(ids: list[int], texts: list[str], min_words: int, term_words: int = TERM_WORDS) -> Index | None:
    """Index of the given items; None if no item has ``min_words`` words."""
    plain, plain_off = word_hashes(texts)
    words, off = shingle_hashes(plain, plain_off, term_words)
    run = min_words - term_words + 1  # terms of a run of min_words words
    size = np.diff(off)
    owner = np.repeat(np.arange(len(ids)), size)
    terms, tix = np.unique(words, return_inverse=True)
    n, avg = max(len(ids), 1), max(float(size.mean()) if len(size) else 1.0, 1.0)
    pair, tf = np.unique(tix.astype(np.int64) * len(ids) + owner, return_counts=True)
    pt, pi = pair // len(ids), pair % len(ids)
    df = np.bincount(pt, minlength=len(terms))
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    impact = idf[pt] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[pi] / avg))
    # least score of any window: each distinct word of it counts once
    floor = np.full(len(ids), np.inf)
    of_word = impact[np.searchsorted(pair, tix.astype(np.int64) * len(ids) + owner)]
    for j in range(len(ids)):
        a, b = int(off[j]), int(off[j + 1])
        if b - a < run:
            continue
        w = np.lib.stride_tricks.sliding_window_view(tix[a:b], run)
        s = np.lib.stride_tricks.sliding_window_view(of_word[a:b], run)
        order = np.argsort(w, axis=1, kind="stable")
        ws, ss = np.take_along_axis(w, order, 1), np.take_along_axis(s, order, 1)
        first = np.ones(ws.shape, bool)
        first[:, 1:] = ws[:, 1:] != ws[:, :-1]
        floor[j] = (ss * first).sum(1).min()
    live = np.isfinite(floor[pi])
    pt, pi, impact = pt[live], pi[live], impact[live]
    if not len(pt):
        return None
    impact = impact / floor[pi] * (1 + 1e-6)  # float32 sums must not fall under the bound by rounding
    blocks = (len(ids) + BLOCK - 1) // BLOCK
    at = pt * blocks + pi // BLOCK  # rises, as the pairs are sorted by term and item
    cell, post = np.unique(at, return_index=True)
    cell_top = np.maximum.reduceat(impact, post)
    ptr = np.searchsorted(cell, np.arange(len(terms) + 1) * blocks)
    top = np.zeros(len(terms), np.float32)
    np.maximum.at(top, pt, impact.astype(np.float32))
    post = np.append(post, len(pt))
    gram, goff = shingle_hashes(plain, plain_off, min_words)
    tagged = np.unique(_tag(gram, np.repeat(np.arange(len(ids)), np.diff(goff))))
    return Index(
        np.array(ids, np.int64), terms, top, ptr.astype(np.int32), cell, cell_top.astype(np.float32), post.astype(np.int32),
        (pi % BLOCK).astype(np.uint8), impact.astype(np.float32), tagged, blocks, min_words, term_words,
    )


def passages(words: np.ndarray, off: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of overlapping passages that together hold every run of length - stride + 1 words."""
    size = np.diff(off)
    need = length - stride + 1
    n = np.where(size >= need, np.maximum(-(-(size - need + 1) // stride), 1), 0)
    doc = np.repeat(np.arange(len(size)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return off[:-1][doc] + nth * stride, doc


def retrieve(ix: Index, terms: np.ndarray, first: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(passage, item position) of every pair that reaches the item's threshold."""
    at = np.searchsorted(ix.terms, terms)
    at[at == len(ix.terms)] = 0
    term = np.where(ix.terms[at] == terms, at, -1)
    top = np.concatenate(([0], np.cumsum(np.where(term >= 0, ix.top[term], 0), dtype=np.float64)))
    last = np.minimum(first + length, end)
    keep = np.flatnonzero(top[last] - top[first] >= 1 - 1e-6)  # bound over all items, repeated terms included
    pos = first[keep, None] + np.arange(length)
    q = np.where(pos < last[keep, None], term[np.minimum(pos, len(terms) - 1)], -1)
    q.sort(axis=1)
    q[:, 1:][q[:, 1:] == q[:, :-1]] = -1  # a query term counts once
    out_p, out_i = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(0, len(keep), 4096):
        part = q[a : a + 4096]
        most = np.where(part >= 0, ix.top[part], 0)
        order = np.argsort(most, axis=1)
        reach = np.cumsum(np.take_along_axis(most, order, 1), axis=1, dtype=np.float64)
        # from the least up, as many terms as cannot reach the bound by themselves need not be opened at first
        needed = np.empty(part.shape, bool)
        np.put_along_axis(needed, order, reach >= 1 - 1e-6, 1)
        needed &= part >= 0
        spare = np.where(reach < 1 - 1e-6, reach, 0).max(1)
        key, entry = _entries(ix, part, needed)
        size = len(part) * ix.blocks
        bound = np.bincount(key, ix.cell_top[entry], minlength=size).reshape(len(part), -1)
        alive = ((bound > 0) & (bound + spare[:, None] >= 1 - 1e-6)).any(1)  # the other passages' common terms stay closed
        rest = _entries(ix, part, (part >= 0) & ~needed & alive[:, None])
        bound = bound.ravel() + np.bincount(rest[0], ix.cell_top[rest[1]], minlength=size)
        good = bound >= 1 - 1e-6  # bound by block
        key, entry = np.concatenate([key, rest[0]]), np.concatenate([entry, rest[1]])
        inside = good[key]
        if not inside.any():
            continue
        key, entry = key[inside], entry[inside]
        names = np.flatnonzero(good)
        lo = ix.post[entry].astype(np.int64)
        n = ix.post[entry + 1] - lo
        take = _ranges(lo, n)
        pair = np.repeat(np.searchsorted(names, key), n)
        score = np.bincount(pair * BLOCK + ix.post_item[take], ix.post_impact[take], minlength=len(names) * BLOCK)
        hit = np.flatnonzero(score >= 1)
        r, block = np.divmod(names[hit // BLOCK], ix.blocks)
        out_p.append(keep[a + r])
        out_i.append(block * BLOCK + hit % BLOCK)
    return np.concatenate(out_p), np.concatenate(out_i)


def _entries(ix: Index, part: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row * blocks + block, entry) of the blocks that the chosen terms of each row stand in."""
    row, col = np.nonzero(chosen)
    term = part[row, col]
    lo = ix.ptr[term].astype(np.int64)
    n = ix.ptr[term + 1] - lo
    entry = _ranges(lo, n)
    return np.repeat(row, n) * ix.blocks + ix.cell[entry] % ix.blocks, entry


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of n values each, one after another."""
    return np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


def overlaps(ix: Index, texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(text index, item position, shared runs) of verified pairs, and how many pairs were retrieved."""
    words, off = word_hashes(texts)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0
    m = ix.min_words
    stride = length - m + 1
    first, doc = passages(words, off, length, stride)
    terms, toff = shingle_hashes(words, off, ix.term_words)
    move = toff[:-1][doc] - off[:-1][doc]
    p, item = retrieve(ix, terms, first + move, toff[1:][doc], length - ix.term_words + 1)
    if not len(p):
        return p, item, p, 0
    gram, goff = shingle_hashes(words, off, m)
    start = first[p] - off[:-1][doc[p]] + goff[:-1][doc[p]]
    pos = start[:, None] + np.arange(stride)
    inside = pos < goff[1:][doc[p]][:, None]
    tagged = _tag(gram[np.minimum(pos, len(gram) - 1)].ravel(), np.repeat(item, stride)).reshape(pos.shape)
    at = np.minimum(np.searchsorted(ix.grams, tagged.ravel()), len(ix.grams) - 1).reshape(pos.shape)
    runs = ((ix.grams[at] == tagged) & inside).sum(1)
    ok = runs > 0
    return doc[p][ok], item[ok], runs[ok], len(p)


def shards(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The items in id order, as many at a time as one broadcast may hold.

    Items of a null id or text are left out; of several rows of an id the least text counts.
    """
    rows = items.filter("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text")).orderBy("id")
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        if ids and (len(ids) == SHARD_ITEMS or size + len(r.text) > SHARD_CHARS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield ids, texts


def leaks(docs: DataFrame, items: DataFrame, ws: Workspace, min_words: int = 12, length: int = 24) -> DataFrame:
    """(id, item_id, shared_runs): documents that share min_words consecutive words with an item.

    docs and items: (id long, text string).  Null and blank texts and texts of
    fewer than min_words words match nothing; repeated documents count once.
    ``shared_runs``: runs of min_words words of the document that stand in the item.
    The items are a query set taken in shards of bounded size, each broadcast as an
    index while the documents are read once for it, and then destroyed.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("id", "text").filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    out = spark.createDataFrame([], "id long, item_id long, shared_runs long")
    for ids, texts in shards(items):
        ix = build_index(ids, texts, min_words)
        if ix is None:
            continue
        sent = spark.sparkContext.broadcast(ix)
        out = out.unionByName(ws.write(docs.mapInArrow(_search(sent, length), "id long, item_id long, shared_runs long")))
        sent.destroy()
    return out.groupBy("id", "item_id").agg(F.max("shared_runs").alias("shared_runs"))


def _search(sent, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                doc, item, runs, _ = overlaps(ix, texts[a:b], length)
                if len(doc):
                    pair, back = np.unique(doc * len(ix.items) + item, return_inverse=True)
                    # passages overlap by min_words - 1 words, so no run is counted twice
                    total = np.bincount(back, runs).astype(np.int64)
                    yield pa.RecordBatch.from_pydict({"id": pa.array(ids[a:b][pair // len(ix.items)]), "item_id": pa.array(ix.items[pair % len(ix.items)]), "shared_runs": pa.array(total)})

    return run
