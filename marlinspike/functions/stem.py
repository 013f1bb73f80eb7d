"""Tokens as a full-text index of the ``porter unicode61`` kind makes them.

Lower case, diacritics removed from Latin letters, and the Porter stemmer (M. F.
Porter, "An algorithm for suffix stripping", 1980) on ASCII words of 3 to 64 letters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: The suffix tables of the published algorithm.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log bli:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"

_PAIRS2 = [tuple(x.split(":")) for x in STEP2.split()]
_PAIRS3 = [tuple(x.split(":")) for x in STEP3.split()]
_TOKEN = re.compile(r"[^\W_]+")


def _shape(word: str) -> str:
    """The word as c for consonants and v for vowels; y after a consonant is a vowel."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall(r"v+c", re.sub(r"c+", "c", _shape(stem))))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, pairs: list[tuple[str, str]], least: int) -> str:
    for suffix, new in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(suffix):
            stem = word[: len(word) - len(suffix)]
            return stem + new if _measure(stem) > least else word
    return word


@lru_cache(maxsize=100_000)
def porter(word: str) -> str:
    """The stem of a lower-case word; words of fewer than 3 or more than 64 UTF-8 bytes stay.

    Other bytes than ASCII letters count as consonants, as in a byte-wise index.
    """
    w = word.encode().decode("latin-1")
    if not 3 <= len(w) <= 64:
        return word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _shape(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif _double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _cvc(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, _PAIRS2, 0)
    w = _replace(w, _PAIRS3, 0)
    for suffix in sorted(STEP4.split(), key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w.encode("latin-1").decode()


def fold(token: str) -> str:
    """Lower case without the diacritics of Latin letters."""
    out = []
    for ch in token.lower():
        base = unicodedata.normalize("NFD", ch)
        out.append(base[0] if len(base) > 1 and base[0].isascii() else ch)
    return "".join(out)


def tokens(text: str) -> list[str]:
    """Stemmed index tokens of a text, in order."""
    return [porter(fold(t)) for t in _TOKEN.findall(text)]
