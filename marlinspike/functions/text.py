"""Scalar functions on columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of finding kinds, longest shown line, ticket and evidence patterns.
FINDING_LETTERS = {"group": "g", "cross": "c", "same": "s", "stale": "u"}
MAX_SHOWN = 200
TICKET = r"(?i)\b[A-Za-zА-Яа-я]{2,}-\d+\b|\b(?:PR|MR|issue)\s*#?\d+\b"
ISSUE = r"(?:[\w.-]+/[\w.-]+)?#\d{1,6}\b"
COMMIT = r"\b[0-9a-f]{7,40}\b"


def evidence(text: Column) -> Column:
    """(kind, reference) of what a text names outside: issues, with or without their repository, and commits."""
    kind = lambda name, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(name).alias("kind"), x.alias("reference")))
    return F.concat(kind("issue", ISSUE), kind("commit", rf"\b{COMMIT[2:]}"))


def words(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))


def normalize_project(name: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to single hyphens, none at the ends; null as ''."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def canonical_project(name: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """The normalised name, or the name it is declared an alias of. Empty stays empty."""
    import re

    norm = normalize_project(name)
    plain = lambda s: re.sub(r"[^a-z0-9]+", "-", s.lower()).strip("-")
    table = {plain(a): plain(canon) for canon, names in (aliases or {}).items() if plain(canon) for a in (canon, *names) if plain(a)}
    if not table:
        return norm
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[norm], norm)


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def thread_key(line: Column) -> Column:
    """First 16 hex digits of the sha256 of the squeezed line."""
    return F.substring(F.sha2(squeeze(line), 256), 1, 16)


def finding_key(kind: str, titles: Column) -> Column:
    """Letter of the kind and 16 hex digits of the sha1 of the sorted titles."""
    return F.concat(F.lit(FINDING_LETTERS[kind] + "-"), F.substring(F.sha1(F.array_join(F.array_sort(titles), "|")), 1, 16))


def shown(text: Column, limit: int = MAX_SHOWN) -> Column:
    """At most ``limit`` characters, the last an ellipsis where it was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def bare_title(title: Column) -> Column:
    """What follows the first ' — ' of a title, or the title if nothing does."""
    rest = F.trim(F.regexp_replace(title, r"(?s)^.*? — ", ""))
    return F.when(rest != "", rest).otherwise(title)


def tickets(text: Column) -> Column:
    """Ticket ids of a text, as letters and digits only."""
    return F.transform(F.regexp_extract_all(text, F.lit(TICKET), F.lit(0)), lambda t: F.regexp_replace(F.lower(t), r"[^0-9a-zа-я]", ""))


def demand_fold(name: Column) -> Column:
    """Spelling key of a wanted name: case, blanks and hyphens do not count."""
    return F.translate(F.lower(F.upper(name)), " -", "")


def iso_date(value: Column) -> Column:
    """The date of the first ten characters, null where they are none."""
    head = F.substring(value, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")).cast("date")


def last_touched(date: Column, reviewed: Column) -> Column:
    """The later of two dates given as text, of the valid ones."""
    return F.greatest(iso_date(date), iso_date(reviewed))


def file_stem(path: Column) -> Column:
    """Last part of a path without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def clip_bytes(text: Column, limit: int) -> Column:
    """The longest start of at most ``limit`` UTF-8 bytes that ends at a whole character."""
    b = F.encode(text, "UTF-8")
    over = F.octet_length(text) > limit
    # a byte of the form 10xxxxxx right after the cut says that a character was cut
    def cut(n: int) -> Column:
        nxt = F.conv(F.hex(F.substring(b, n + 1, 1)), 16, 10).cast("int")
        return F.decode(F.substring(b, 1, n), "UTF-8"), nxt.bitwiseAND(0xC0) != 0x80

    out = F.lit("")
    for n in range(max(limit - 3, 0), limit + 1):
        text_n, whole = cut(n)
        out = F.when(whole, text_n).otherwise(out)
    return F.when(over, out).otherwise(text)
