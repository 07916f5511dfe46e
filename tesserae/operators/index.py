"""Files to chunks, and the chunk table's upkeep.  Writers return the whole new table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import text as X

#: Directories that are never indexed; fixed value.
DEFAULT_EXCLUDES = (".git", "node_modules", ".index_db", "vendor", "__pycache__", ".idea")


def glob_regex(glob: str) -> str:
    """A glob whose ``*`` and ``?`` don't cross ``/`` as an anchored regular expression."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            out += "[" + glob[i + 1 : j].replace("!", "^", 1) + "]" if glob[i + 1] == "!" else glob[i : j + 1]
            i = j
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def _matcher(pattern: str):
    return lambda part: part.rlike(pattern)


def excluded(path: Column, globs: list[str]) -> Column:
    """Whether a glob matches the whole path or any of its components."""
    hit = F.lit(False)
    for g in map(glob_regex, globs):
        hit = hit | path.rlike(g) | F.exists(F.split(path, "/"), _matcher(g))
    return hit


def default_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, DEFAULT_EXCLUDES)))


def is_binary(content: Column) -> Column:
    """A NUL in the first 512 bytes (of a BINARY column)."""
    return F.hex(F.substring(content, 1, 512)).rlike("^(?:..)*?00")


def sub_repos(paths: DataFrame) -> DataFrame:
    """Immediate child directories with a ``.git``: ``sub_repo``."""
    return paths.where(F.col("path").rlike(r"^[^/]+/\.git(?:/|$)")).select(F.split("path", "/")[0].alias("sub_repo")).distinct()


def tag_sub_project(files: DataFrame, repos: DataFrame) -> DataFrame:
    """``sub_project``: the first path segment if it is a sub-repo, else ''."""
    head = F.split("path", "/")[0]
    return files.join(repos, head == F.col("sub_repo"), "left").withColumn("sub_project", F.coalesce("sub_repo", F.lit(""))).drop("sub_repo")


def stale(files: DataFrame, facts: DataFrame) -> DataFrame:
    """``files`` (``path, mtime, hash``) with ``up_to_date`` against :func:`search.file_facts`.

    No rows, or rows without a time, are stale; else a time not older, or an equal hash, or (no hash stored) mere presence is enough.
    """
    both = files.join(facts.select(F.col("file_path").alias("path"), "max_mod_time", "content_hash"), "path", "left")
    stored = F.coalesce("content_hash", F.lit(""))
    fresh = F.when(F.coalesce("max_mod_time", F.lit(0)) == 0, False).when(F.col("max_mod_time") >= F.col("mtime"), True).when(stored != "", stored == F.col("hash")).otherwise(True)
    return both.withColumn("up_to_date", fresh).drop("max_mod_time", "content_hash")


def plan_run(files: DataFrame, globs: list[str], facts: DataFrame | None = None) -> DataFrame:
    """``files`` (``path, content, mtime, hash``) with ``reason``: why each is skipped, or ``index``."""
    done = stale(files, facts) if facts is not None else files.withColumn("up_to_date", F.lit(False))
    path = F.col("path")
    return done.withColumn("reason", F.when(default_excluded(path), "default").when(excluded(path, globs), "user").when(is_binary(F.col("content")), "binary").when(F.col("up_to_date"), "unchanged").otherwise("index"))


def run_counters(planned: DataFrame) -> DataFrame:
    return planned.groupBy("reason").agg(F.count("*").alias("n"))


def chunk_files(files: DataFrame, path: str = "path", text: str = "content", limit: int = X.CHUNK_BYTES) -> DataFrame:
    """One row per chunk: ``file_path, start_line, end_line, kind, content``; JVM only, no shuffle."""
    kind = F.when(F.octet_length(text) <= limit, "file").otherwise("paragraph")
    rows = files.select(F.col(path).alias("file_path"), kind.alias("kind"), F.explode(X.line_chunks(F.col(text), limit)).alias("c"))
    return rows.select("file_path", "c.start_line", "c.end_line", "kind", "c.content")


#: What a source name is made of, and the kinds of external texts; fixed values.
SOURCE = r"^[a-zA-Z0-9_.:#/@\-\s]+$"
SOURCE_TYPES = ("ticket", "doc", "pr", "message", "changelog", "note", "custom")
#: Most bytes of a source name, of a text, and of its metadata or its relationships; most relationships.
SOURCE_BYTES, TEXT_BYTES, FACT_BYTES, MOST_RELATED = 500, 100 * 1024, 10 * 1024, 50


def valid_source(source: Column) -> Column:
    fine = (F.octet_length(source) <= SOURCE_BYTES) & ~source.contains("..") & ~source.rlike(r"[\x00\n\r]") & source.rlike(SOURCE)
    return F.coalesce(fine, F.lit(False))


def source_type(kind: Column) -> Column:
    """The kind of an external text, ``custom`` where blank; null where it is none."""
    return F.when(F.coalesce(kind, F.lit("")) == "", "custom").when(kind.isin(*SOURCE_TYPES), kind)


def valid_metadata(facts: Column) -> Column:
    """Blank, or a JSON object of up to 10 KB."""
    is_object = F.trim(facts).eqNullSafe("null") | F.from_json(facts, "map<string,string>").isNotNull()
    return (F.coalesce(facts, F.lit("")) == "") | ((F.octet_length(facts) <= FACT_BYTES) & is_object)


def valid_relationships(facts: Column) -> Column:
    """Blank, or a JSON array of up to 50 ``{type, target}`` in up to 10 KB."""
    related = F.from_json(facts, "array<struct<type string, target string>>")
    fine = F.trim(facts).eqNullSafe("null") | (facts.rlike(r"^\s*\[") & F.coalesce(F.size(related) <= MOST_RELATED, F.lit(False)))
    return (F.coalesce(facts, F.lit("")) == "") | ((F.octet_length(facts) <= FACT_BYTES) & fine)


def index_text(docs: DataFrame, limit: int = X.CHUNK_BYTES) -> DataFrame:
    """External texts (``source, url, content, type``) as chunk rows with a source line and ids ``ext:<source>:<i>``.

    ``metadata`` and ``relationships`` may stand beside them.  A source, content,
    type or fact that is not valid fails the query.
    """
    for c in ("metadata", "relationships"):
        if c not in docs.columns:
            docs = docs.withColumn(c, F.lit(None).cast("string"))
    fine = valid_source(F.col("source")) & (F.octet_length("content") <= TEXT_BYTES) & source_type(F.col("type")).isNotNull() & valid_metadata(F.col("metadata")) & valid_relationships(F.col("relationships"))
    source = F.when(fine, F.col("source")).otherwise(F.raise_error("a source, content, type or fact is not valid").cast("string"))
    head = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("[Source: "), source, F.lit("]("), F.col("url"), F.lit(")\n\n"))).otherwise(F.concat(F.lit("[Source: "), source, F.lit("]\n\n")))
    filled = [F.when(F.coalesce(c, F.lit("")) == "", blank).otherwise(F.col(c)).alias(c) for c, blank in BLANKS.items() if c != "source_type"]
    rows = docs.select("source", "url", source_type(F.col("type")).alias("source_type"), *filled, head.alias("head"), F.posexplode(X.paragraph_chunks(F.col("content"), limit)).alias("i", "chunk"))
    return rows.select(F.concat(F.lit("ext:"), "source", F.lit(":"), "i").alias("id"), F.col("source").alias("file_path"), (F.col("i") + 1).alias("start_line"), F.concat("head", "chunk").alias("content"), F.lit("external").alias("kind"), "source_type", "metadata", "relationships")


#: What a chunk has where nothing is given; fixed values.
BLANKS = {"source_type": "code", "metadata": "{}", "relationships": "[]"}


def completed(new: DataFrame) -> DataFrame:
    """``new`` with what its chunks leave blank: defaults, and summary and context path from content and file path."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    filled = {c: F.when(blank(c), value).otherwise(F.col(c)) for c, value in BLANKS.items() if c in new.columns}
    if {"summary", "content", "kind", "identifier"} <= set(new.columns):
        filled["summary"] = F.when(blank("summary"), X.summary(F.col("content"), F.col("kind"), F.col("identifier"))).otherwise(F.col("summary"))
    if {"context_path", "file_path"} <= set(new.columns):
        filled["context_path"] = F.when(blank("context_path"), X.context_path(F.col("file_path"))).otherwise(F.col("context_path"))
    return new.withColumns(filled) if filled else new


def upsert(table: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the rows of ``new``, completed, in place of those of equal key; new chunks count as never accessed.

    Of several new rows of one key the last one in the order of ``new`` counts.
    """
    new = completed(new)
    if "content" in new.columns:
        new = new.withColumn("content", F.replace("content", F.lit("\0"), F.lit("")))
    if "last_accessed" in table.columns:
        new = new.withColumn("last_accessed", F.lit(0).cast(table.schema["last_accessed"].dataType))
    row = F.struct(F.monotonically_increasing_id().alias("_at"), F.struct(*new.columns).alias("_row"))
    last = new.select(F.col(key).alias("_key"), row.alias("r")).groupBy("_key").agg(F.max_by("r._row", "r._at").alias("_row")).select("_row.*")
    return table.join(new.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def remove_file(table: DataFrame, path: str) -> DataFrame:
    return table.where(F.col("file_path") != path)


def touch(table: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """``last_accessed`` set to ``now`` for the ids of ``ids``."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return table.join(hit, "id", "left").withColumn("last_accessed", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("last_accessed"))).drop("_hit").select(*table.columns)


def backfill_project(table: DataFrame, name: str) -> DataFrame:
    if not name:
        raise ValueError("a project needs a name")
    return table.withColumn("sub_project", F.when(F.coalesce("sub_project", F.lit("")) == "", name).otherwise(F.col("sub_project")))


def stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("file_path").alias("files"), F.coalesce(F.max("mod_time"), F.lit(0)).alias("newest"))


def listing(chunks: DataFrame, prefix: str = "", mode: str = "like") -> DataFrame:
    """Chunks under a context path by the next segment: ``entry, n``; rows at the path itself count as ''."""
    from tesserae.operators.search import in_scope

    rest = F.regexp_replace(F.substring("context_path", len(prefix) + 1, 1 << 20), "^/+", "") if prefix else F.col("context_path")
    per_path = in_scope(chunks, prefix, mode).groupBy("context_path").agg(F.count("*").alias("n"))
    return per_path.groupBy(F.split(rest, "/")[0].alias("entry")).agg(F.sum("n").alias("n")).orderBy("entry")
