"""Writing one note: names, compare-and-swap, secrets. Plain driver code on single files."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters and device names that file systems refuse; shapes of secrets.
REFUSED = re.compile(r'[<>:"|?*\x00-\x1f\s]+')
DEVICE = re.compile(r"(?:con|prn|aux|nul|conin\$|conout\$|(?:com|lpt)[1-9¹²³])(?![^.])", re.I)
SECRETS = {
    "private key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "cloud key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "service token": r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,})\b",
    "web token": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    "password": r"(?i)\b(?:password|passwd|secret|api[_-]?key|token)\b\s*[:=]\s*[\"']?[^\s\"']{8,}",
}


def portable(stem: str) -> str:
    """The nearest name that every file system takes; may be empty."""
    name = REFUSED.sub(" ", stem).lstrip().rstrip(" .")
    return name + " note" * bool(DEVICE.match(name))


def check_name(filename: object) -> str:
    """The file name if it is a portable ``<stem>.md`` without '#' and path; ValueError otherwise."""
    if not isinstance(filename, str) or not filename.endswith(".md") or set(filename) & set("/\\#") or filename == ".md":
        raise ValueError("the file name must be <stem>.md without '#' or a path")
    if portable(filename[:-3]) != filename[:-3]:
        raise ValueError(f"the file name is not portable; use '{portable(filename[:-3])}.md'")
    return filename


def secrets(text: Column) -> Column:
    """Kinds of secrets a text seems to hold: a warning, never a refusal. A rule set of our own."""
    kinds = F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SECRETS.items()])
    return F.filter(kinds, lambda x: x.isNotNull())


def write(path: Path, content: str, replaces: str | None = None) -> str:
    """created, exists-same, replaced or conflict.

    An existing file is replaced only if ``replaces`` is the sha256 it has now; the
    new content appears at once, by a rename.
    """
    data = content.encode()
    if path.exists():
        now = path.read_bytes()
        if now == data:
            return "exists-same"
        if replaces is None or hashlib.sha256(now).hexdigest() != replaces:
            return "conflict"
    elif replaces is not None:
        return "conflict"
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "wb") as f:
        f.write(data)
    try:
        if replaces is None:
            os.link(temp, path)  # fails if another writer was first
        else:
            os.replace(temp, path)
    except FileExistsError:
        return "conflict"
    finally:
        Path(temp).unlink(missing_ok=True)
    return "created" if replaces is None else "replaced"


def session_id_ok(value: Column, hosts: tuple[str, ...] = ("host_b", "host_c", "host_d", "host_e", "host_f")) -> Column:
    """A raw id, or ``host:id`` of a known host; no white space, control characters or slashes."""
    clean = value.rlike(r"^[^\s/\\\x00-\x1f\x7f]+$")
    spaced = value.rlike(f"^(?:{'|'.join(map(re.escape, hosts))}):[^:]+$")
    return F.coalesce(clean & (~value.contains(":") | spaced), F.lit(False))
