"""Vectorised text kernels (numpy over Arrow batches).

Everything here works on a *slice*: a list of whole texts whose total length is
bounded (``SLICE_CHARS``), so memory per Python worker does not grow with the
Arrow batch.  A text longer than the bound forms a slice of its own; texts are
never cut.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

SLICE_CHARS = 400_000
U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1  # odd base of the polynomial word hash
_P_INV = pow(_P, -1, 1 << 64)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place on a fresh array."""
    x = x + U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit multipliers."""
    return splitmix(np.arange(n, dtype=U64) + U64(seed * 1_000_003)) | U64(1)


@lru_cache(maxsize=1)
def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter or digit; its random 64-bit value."""
    is_word = np.zeros(0x110000, dtype=bool)
    is_word[[c for c in range(0x110000) if chr(c).isalnum()]] = True
    return is_word, splitmix(np.arange(0x110000, dtype=U64))


_pow_cache: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_pow_cache[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            p = np.full(n, base, U64)
            p[0] = 1
            _pow_cache[k] = np.multiply.accumulate(p)
    return _pow_cache[0][:n], _pow_cache[1][:n]


def slices(texts: Sequence[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` characters together (one at least)."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) + 1
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, and the word offset of each text.

    Words are maximal runs of Unicode letters and digits of the lower-cased text.
    The second array has ``len(texts) + 1`` entries.
    """
    low = [t.lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    starts = np.zeros(len(low) + 1, np.int64)
    np.cumsum(size + 1, out=starts[1:])
    cps = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    is_word, values = _char_tables()
    inside = is_word[cps]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate(([0], edge))
    first, last = edge[0::2], edge[1::2]
    up, down = _powers(len(cps))
    total = values[cps]
    total *= up
    np.cumsum(total, out=total)
    before = np.where(first > 0, total[first - 1], U64(0))
    h = total[last - 1] - before
    h *= down[first]
    return splitmix(h), np.searchsorted(first, starts)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k consecutive words inside one text, and its offsets."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    mult = odd_constants(k, 11)
    h = words[:n] * mult[0]
    for j in range(1, k):
        h += words[j : j + n] * mult[j]
    count = np.maximum(np.diff(offsets) - (k - 1), 0)
    out = np.zeros(len(offsets), np.int64)
    np.cumsum(count, out=out[1:])
    take = np.arange(out[-1]) + np.repeat(offsets[:-1] - out[:-1], count)
    return splitmix(h[take]), out


GEAR_BYTES = 64


@lru_cache(maxsize=1)
def gear_table() -> np.ndarray:
    """256 random 64-bit values, one per byte value."""
    return splitmix(np.arange(256, dtype=U64) + U64(0xC0FFEE))


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Gear rolling hash ``h = (h << 1) + G[byte]`` at every byte.

    Modulo 2**64 it depends on the last 64 bytes only, so it is built by six
    doublings of the window instead of a byte loop.
    """
    h = gear_table()[data]
    w = 1
    while w < GEAR_BYTES:
        old = h.copy()
        h[w:] += old[:-w] << U64(w)
        w *= 2
    return h


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values (len(h) - w + 1 results)."""
    return _window(h, w, np.minimum)


def _window(h: np.ndarray, w: int, op) -> np.ndarray:
    n = len(h) - w + 1
    out, span = h, 1
    while span * 2 <= w:
        out = op(out[: len(out) - span], out[span:])
        span *= 2
    rest = w - span
    return op(out[:n], out[rest : rest + n])


def cut_points(data: np.ndarray, starts: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the gear minimum of some window of w positions.

    ``starts``: where each text begins in ``data``.  Positions whose gear window
    would reach into the text before are never chosen.
    """
    if len(data) < w:
        return np.empty(0, np.int64)
    h = gear_hashes(data)
    top = U64(0xFFFFFFFFFFFFFFFF)
    for s in starts:
        h[s : s + GEAR_BYTES - 1] = top
    low = window_min(h, w)
    pad = np.zeros(w - 1, U64)
    best = _window(np.concatenate((pad, low, pad)), w, np.maximum)
    return np.flatnonzero((best == h) & (h != top))
