"""Notes from a folder of Markdown files: scan, parse, incremental snapshot."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlinspike.functions import markdown as M
from marlinspike.functions import text as T
from marlinspike.operators import links as L

FIELDS = ("type", "kind", "source", "project", "date", "reviewed", "dies-when", "died")
_NOTE = ["note_id", "path", "title", "type", "kind", "source", "project", "date", "reviewed", "dies_when", "died"]


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, sha256, content) of every ``*.md`` below a folder; the path is relative to it.

    The engine's file source passes over files of zero bytes, so such a note is not
    there; one with only a line end is.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    return files.select(_short(folder).alias("path"), F.unix_micros("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"))


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, file) of the same files without reading any of them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    return files.select(_short(folder).alias("path"), F.unix_micros("modificationTime").alias("mtime"), F.col("path").alias("file"))


def _short(folder: str) -> Column:
    """The path below the folder of a file's address."""
    root = folder.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z0-9]+:/+", "/")
    return F.substring(path, F.lit(len(root) + 2), F.length(path))


def _parse(path: str, text: str) -> list[tuple]:
    meta, body = M.frontmatter(text or "")
    stem = path.rsplit("/", 1)[-1].removesuffix(".md")
    flat = lambda v: json.dumps(v, ensure_ascii=False) if isinstance(v, list) else (v or "")
    title = flat(meta.get("title")) or stem
    aliases = meta.get("aliases") or []
    names = [str(a) for a in aliases] if isinstance(aliases, list) else [aliases]
    chunks = [{"heading_path": h, "body": b, "ord": i} for h, b, i in M.sections(title, body)]
    return [(path, title, *[flat(meta.get(f)) for f in FIELDS], names, chunks, M.links(body))]


def parse(files: DataFrame) -> DataFrame:
    """One row a file (path, content): metadata ('' where missing), aliases, chunks and link names.

    A note with an empty body has one chunk that holds its title; rows without a path
    are left out, a null content is empty.
    """
    chunk = pa.list_(pa.struct([("heading_path", pa.string()), ("body", pa.string()), ("ord", pa.int32())]))
    text = ", ".join(f"{c} string" for c in ("path", "title", *(f.replace("-", "_") for f in FIELDS)))
    schema = f"{text}, aliases array<string>, chunks array<struct<heading_path:string,body:string,ord:int>>, names array<string>"
    return M.arrow_map(files.filter("path is not null"), ["path", "content"], _parse, schema, [pa.string()] * 10 + [pa.list_(pa.string()), chunk, pa.list_(pa.string())])


def diff(known: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change) of files (path, mtime, sha256) against an index of the same columns.

    deleted; same (equal time); healed (other time, equal content: only the time is
    written anew); changed; new.
    """
    k = known.select("path", F.col("mtime").alias("_m"), F.col("sha256").alias("_s"), F.lit(True).alias("_k"))
    f = found.select("path", "mtime", "sha256", F.lit(True).alias("_f"))
    change = F.when(F.col("_f").isNull(), "deleted").when(F.col("_k").isNull(), "new").when(F.col("_m") == F.col("mtime"), "same").when(F.col("_s") == F.col("sha256"), "healed").otherwise("changed")
    return k.join(f, "path", "full").select("path", change.alias("change"))


def tables(parsed: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """notes, chunks and links of parsed files; links resolved over all notes.

    Ids are hashes of the path, and of the path and number for chunks, so they do
    not depend on the order of insertion.
    """
    note_id = F.sha2("path", 256)
    meta = files.select("path", "mtime", "sha256")
    notes = parsed.join(meta, "path").select(note_id.alias("note_id"), *[c for c in _NOTE if c != "note_id"], F.to_json("aliases").alias("aliases"), "mtime", "sha256")
    chunk = parsed.select(note_id.alias("note_id"), F.explode("chunks").alias("c")).select(F.concat("note_id", F.lit(":"), "c.ord").alias("chunk_id"), "note_id", "c.heading_path", "c.body", "c.ord", F.sha2("c.body", 256).alias("sha256"), F.octet_length("c.body").alias("bytes"))
    link = parsed.select(note_id.alias("src"), F.posexplode("names").alias("pos", "dst_name"))
    return {"notes": notes, "chunks": chunk, "links": L.resolve(link, L.name_map(notes))}


def build(spark: SparkSession, folder: str, store: str, rebuild: bool = False) -> dict[str, int]:
    """Bring the snapshot in ``store`` up to the folder; counts of what happened.

    Times are compared first: only files that are new or have another time are read
    and hashed, and of those only new and changed ones are parsed; their parses are joined to the kept ones,
    all links are resolved again, and a new snapshot directory is published by
    writing its name last, so a reader never sees half of one.
    """
    now = current(spark, store)
    stale = now is None or rebuild
    old = None if stale else spark.read.parquet(f"{now}/parsed")
    if old is None:
        files = scan(spark, folder)
        change = files.select("path", F.lit("new").alias("change"))
        parsed, meta = parse(files), files.select("path", "mtime", "sha256")
    else:
        files = _touched(spark, folder, old)
        change = diff(old, files)
        fresh = files.join(change.filter("change in ('new', 'changed')").select("path"), "path", "left_semi")
        kept = old.join(change.filter("change in ('same', 'healed')").select("path"), "path", "left_semi").drop("mtime", "sha256")
        parsed, meta = kept.unionByName(parse(fresh)), files.select("path", "mtime", "sha256")
    counts = {r["change"]: r["n"] for r in change.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    number = 0 if now is None else int(now.rsplit("-", 1)[1]) + 1
    target = f"{store.rstrip('/')}/snapshot-{number}"
    parsed.join(meta, "path").write.mode("overwrite").parquet(f"{target}/parsed")
    again = spark.read.parquet(f"{target}/parsed")
    for name, df in tables(again.drop("mtime", "sha256"), again).items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")
    spark.createDataFrame([(target, number)], "path string, number long").coalesce(1).write.mode("append").json(f"{store.rstrip('/')}/published")
    return counts


#: Files that are read one by one by their names; if more have changed the folder is read as a whole.
NAMED_FILES = 5000


def _touched(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """What ``scan`` gives, without content for the files whose time is the indexed one."""
    seen = listing(spark, folder)
    old = known.select("path", F.col("mtime").alias("_m"), F.col("sha256").alias("_s"))
    met = seen.join(old, "path", "left")
    same = met.filter(F.col("_m") == F.col("mtime")).select("path", "mtime", F.col("_s").alias("sha256"), F.lit(None).cast("string").alias("content"))
    other = met.filter(F.col("_m").isNull() | (F.col("_m") != F.col("mtime")))
    names = [r.file for r in other.select("file").limit(NAMED_FILES + 1).collect()]
    if not names:
        return same
    if len(names) > NAMED_FILES:
        return same.unionByName(scan(spark, folder).join(other.select("path"), "path", "left_semi"))
    files = spark.read.format("binaryFile").load([_escaped(x) for x in names])
    read = files.select(_short(folder).alias("path"), F.unix_micros("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"))
    return same.unionByName(read)


def _escaped(address: str) -> str:
    """A file's address as a reader's path: decoded, glob signs taken literally."""
    from urllib.parse import unquote

    return "".join("\\" + ch if ch in "{}[]*?\\" else ch for ch in unquote(address))


def refresh(spark: SparkSession, folder: str, store: str) -> str | None:
    """Bring the snapshot up to the folder; a readable error instead of an exception, None if all went well."""
    try:
        build(spark, folder, store)
    except Exception as e:  # noqa: BLE001 - callers go on with the snapshot there is
        return f"index not refreshed ({type(e).__name__}: {str(e).splitlines()[0][:200]})"
    return None


def rows_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a stored table, none where it is missing or has other columns."""
    try:
        table = spark.read.parquet(path)
        if not schema_stale(table, schema):
            return table
    except Exception:  # noqa: BLE001 - no table is no rows
        pass
    return spark.createDataFrame([], schema)


def current(spark: SparkSession, store: str) -> str | None:
    """Directory of the published snapshot, None if there is none."""
    try:
        got = spark.read.schema("path string, number long").json(f"{store.rstrip('/')}/published").orderBy(F.desc("number")).first()
    except Exception:  # noqa: BLE001 - no store yet
        return None
    return got.path if got else None


def schema_stale(table: DataFrame, wanted: str) -> bool:
    """Whether a stored table lacks a column of the wanted schema or has another type for it."""
    from pyspark.sql.types import _parse_datatype_string

    have = {f.name: f.dataType for f in table.schema}
    return any(have.get(f.name) != f.dataType for f in _parse_datatype_string(wanted))


def shape_problems(notes: DataFrame) -> DataFrame:
    """(path, problem) of notes (path, content) that a writer should refuse."""

    def check(path: str, text: str) -> list[tuple]:
        lines = (text or "").splitlines()
        if lines and lines[0].strip() == "---" and not any(x.strip() == "---" for x in lines[1:]):
            return [(path, "frontmatter not closed")]
        meta, body = M.frontmatter(text or "")
        out = [] if M.links(body) else [(path, "no link")]
        kind = meta.get("kind", "")
        if isinstance(kind, str) and kind.strip().lower() in ("decision", "gotcha"):
            seen = M.unfenced(body)
            out += [(path, f"no {slot} line") for slot in ("Because", "Fails-when") if not M.re.search(rf"(?m)^[\s*_>-]*{slot}[\s*_]*:", seen)]
        return out

    return M.arrow_map(notes, ["path", "content"], check, "path string, problem string", [pa.string(), pa.string()])


def route(rows: DataFrame) -> DataFrame:
    """Rows (filename, type, project, existing) with ``path``: an existing note's own place, else sessions/, the project's folder, or _unsorted/."""
    name = F.trim(F.regexp_replace(F.coalesce("project", F.lit("")), "[\"']", ""))
    folder = F.when(F.col("type") == "session", "sessions").when(name != "", F.regexp_replace(F.lower(name), r"\s+", "-")).otherwise("_unsorted")
    return rows.withColumn("path", F.coalesce("existing", F.concat_ws("/", folder, F.col("filename"))))


def near_notes(found: list[dict], limit: int = 3) -> list[dict]:
    """The first ``limit`` notes of a search's fragments, each once, best first."""
    first: dict[str, dict] = {}
    for x in found:
        first.setdefault(x["path"], x)
    return list(first.values())[:limit]


def ticket_notes(notes: DataFrame) -> DataFrame:
    """(path, ticket) of the ticket ids in paths."""
    return notes.select("path", F.explode(F.array_distinct(T.tickets(F.col("path")))).alias("ticket"))
