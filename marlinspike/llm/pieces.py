"""Cutting oversized texts at natural boundaries.

Boundaries form a hierarchy: section, paragraph, sentence or line, word, character.
A part over the room is cut by the next level; the parts are packed greedily, but a
section or paragraph that must be cut begins a piece of its own, so no piece runs
over its start and ends inside it.  Each piece starts with the end of the one before.  Inside a code fence only lines,
words and characters are cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlinspike.plans.ordered import prefix_sum
from marlinspike.plans.shipping import ship
from marlinspike.plans.workspace import Workspace

_LINE = re.compile(r"[^\n]*(?:\n|\Z)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_HEADING = re.compile(r" {0,3}#{1,6}(?:\s|$)")
_SENTENCE = re.compile(r"[.!?…]+[\"'»”)\]]*\s+|\n")
_SPACE = re.compile(r"\s+")


def boundaries(text: str) -> list[list[int]]:
    """Positions where a piece may begin, for each level from section to word; each level holds those above."""
    section, paragraph, fences = set(), set(), []
    opener, start, blank, pos = "", 0, False, 0
    for m in _LINE.finditer(text):
        line, pos = m.group(), m.start()
        if not line:
            continue
        f = _FENCE.match(line.rstrip("\r\n"))
        if opener:
            if f and f[1][0] == opener[0] and len(f[1]) >= len(opener) and not f[2].strip():
                fences.append((start, m.end()))
                paragraph.add(m.end())
                opener = ""
            blank = False
            continue
        if f and not (f[1][0] == "`" and "`" in f[2]):
            opener, start = f[1], pos
            paragraph.add(pos)
        elif _HEADING.match(line):
            section.add(pos)
        elif blank and line.strip():
            paragraph.add(pos)
        blank = not line.strip()
    if opener:
        fences.append((start, len(text)))  # an unclosed fence hides the rest
    lows, highs = [a for a, _ in fences], [b for _, b in fences]

    def fenced(p: int) -> bool:
        i = bisect_right(lows, p) - 1
        return i >= 0 and lows[i] < p < highs[i]

    sentence = {m.end() for m in _SENTENCE.finditer(text) if m.group() == "\n" or not fenced(m.end())}
    word = {m.end() for m in _SPACE.finditer(text)}
    out, held = [], set()
    for level in (section, paragraph, sentence, word):
        held |= level
        out.append(sorted(held))
    return out


def split(text: str, limit: int = 1200, overlap: int = 120) -> list[tuple[str, int]]:
    """Pieces of at most ``limit`` UTF-8 bytes, each with the number of its leading bytes that repeat the one before.

    Without those bytes the pieces put together are the text.  A text within the
    limit, the empty one too, is one piece.  The repeated end is at most ``overlap``
    bytes and begins at a word where it can.  CR LF is never cut apart.
    """
    if not 0 <= overlap <= limit // 2 or limit < 16:
        raise ValueError("overlap must be at most half of the limit, the limit at least 16")
    if len(text) * 4 <= limit or len(text.encode("utf-8", "surrogatepass")) <= limit:
        return [(text, 0)]
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = [0, *np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), dtype=np.int64).tolist()]
    levels = boundaries(text)
    room = limit - overlap
    atoms: list[int] = []  # where the parts end
    fresh: set[int] = set()  # where sections and paragraphs begin that must be cut
    todo = [(0, len(text), 0)]
    while todo:
        lo, hi, level = todo.pop()
        if size[hi] - size[lo] <= room:
            atoms.append(hi)
            continue
        if level in (1, 2):
            fresh.add(lo)
        if level < len(levels):
            at = levels[level]
            cuts = [lo, *at[bisect_right(at, lo) : bisect_left(at, hi)], hi]
            todo += [(a, b, level + 1) for a, b in reversed(list(zip(cuts, cuts[1:])))]
            continue
        cuts = [lo]
        while cuts[-1] < hi:
            nxt = min(bisect_right(size, size[cuts[-1]] + room) - 1, hi)
            if nxt < hi and text[nxt - 1] == "\r" and text[nxt] == "\n":
                nxt -= 1
            cuts.append(nxt)
        atoms += cuts[1:]
    out, begin, lead = [], 0, 0
    for i, end in enumerate(atoms):
        following = atoms[i + 1] if i + 1 < len(atoms) else None
        if following is not None and end not in fresh and size[following] - size[begin] + lead <= limit:
            continue
        out.append((text[_back(size, begin, lead) : end], lead))
        if following is not None:
            lead = _tail(text, size, levels[-1], end, overlap)
            begin = end
    return out


def _back(size: list[int], begin: int, lead: int) -> int:
    return bisect_left(size, size[begin] - lead)


def _tail(text: str, size: list[int], words: list[int], end: int, overlap: int) -> int:
    """Bytes of the longest end of text[:end] of at most ``overlap`` bytes, from a word start if there is one."""
    lo = bisect_left(size, size[end] - overlap)
    i = bisect_left(words, lo)
    if i < len(words) and words[i] < end:
        lo = words[i]
    elif 0 < lo < end and text[lo - 1] == "\r" and text[lo] == "\n":
        lo += 1
    return size[end] - size[lo]


def _split_rows(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                got = split(text, limit, overlap)
                cols = {"id": [i] * len(got), "piece": range(len(got)), "text": [t for t, _ in got], "repeated": [n for _, n in got]}
                types = [pa.int64(), pa.int32(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols.values(), types)], list(cols))

    return run


def oversized(rows: DataFrame, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """(id, piece, text, repeated) of the rows (id long, text string) over the limit; repeated rows repeat."""
    ship(rows.sparkSession)
    big = rows.select("id", "text").filter(F.octet_length("text") > limit)
    return big.mapInArrow(_split_rows(limit, overlap), "id long, piece int, text string, repeated int")


def rechunk(chunks: DataFrame, ws: Workspace, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """The chunk table with oversized bodies cut and ``ord`` renumbered inside each note.

    chunks: (id, note_id, heading_path, body, ord).  Chunks keep their order (ord,
    then id), pieces follow each other; null and short bodies stay one row.  Rows
    delivered again count once.  A note of any size is numbered in pieces.
    """
    one = chunks.filter("id is not null").groupBy("id").agg(F.min(F.struct("note_id", "ord", "heading_path", "body")).alias("s")).select("id", "s.*")
    one = ws.write(one)
    cut = ws.write(oversized(one.select("id", F.col("body").alias("text")), limit, overlap))
    n = cut.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    heads = one.select("id", "note_id", "ord").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    first = prefix_sum(heads, ["note_id"], ["ord", "id"], "n", "first", ws).select("id", "first")
    whole = one.filter(~F.coalesce(F.octet_length("body") > limit, F.lit(False))).select("id", F.lit(0).alias("piece"), F.col("body").alias("text"), F.lit(0).alias("repeated"))
    out = whole.unionByName(cut).join(first, "id").join(one.select("id", "note_id", "heading_path"), "id")
    return out.select("id", "note_id", "heading_path", F.col("text").alias("body"), (F.col("first") + F.col("piece")).cast("int").alias("ord"), "piece", "repeated")
