"""Readers: file trees, git logs, skill files, length-prefixed buffers, labels, queries, embeddings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as X

COMMIT_END = "---COMMIT_END---"
BUFFER_MOST = 2 * 1024 * 1024
EMBED_BATCH = 32
#: Embedding models that are known, and their dimensions; fixed values.
MODELS = {"nomic-embed-text": 768, "mxbai-embed-large": 1024, "bge-m3": 1024, "all-minilm": 384, "snowflake-arctic-embed": 1024, "bge-large": 1024, "paraphrase-multilingual": 768, "granite-embedding": 384}


def file_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below ``root``), ``content`` (binary), ``mtime``, ``hash`` of all files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_replace("path", rf"^.*?{re.escape(root.rstrip('/'))}/", "")
    return raw.select(below.alias("path"), "content", F.unix_seconds("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"))


def commits(logs: DataFrame, now: int, column: str = "value") -> DataFrame:
    """Commits of git log texts (``hash, epoch, subject, body`` blocks); a zero time is ``now``; blocks without hash or subject go."""
    blocks = F.explode(F.split(column, COMMIT_END)).alias("b")
    parts = logs.select(*[c for c in logs.columns if c != column], blocks).withColumn("p", F.split(X.trim(F.col("b")), "\n", 4)).where(F.size("p") >= 3)
    at = F.coalesce(X.trim(F.col("p")[1]).try_cast("bigint"), F.lit(0))
    rows = parts.select(*[c for c in logs.columns if c != column], X.trim(F.col("p")[0]).alias("hash"), F.when(at == 0, F.lit(now)).otherwise(at).alias("ts"), X.trim(F.col("p")[2]).alias("subject"), F.coalesce(X.trim(F.get("p", F.lit(3))), F.lit("")).alias("body"))
    return rows.where("hash <> '' and subject <> ''")


def commit_chunks(found: DataFrame) -> DataFrame:
    """Commit rows of the chunk table, to be embedded; those without a vector are dropped then."""
    text = F.when(F.col("body") == "", F.col("subject")).otherwise(F.concat("subject", F.lit("\n\n"), "body"))
    return found.select(F.concat(F.lit("commit:"), F.substring("hash", 1, 12)).alias("id"), text.alias("content"), F.lit("commit").alias("kind"), F.lit("commit").alias("source_type"), F.col("ts").alias("mod_time"), F.to_json(F.struct("hash")).alias("metadata"))


def skill_files(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """``path, name, description, body, frontmatter`` of skill files; an open fence fails the query.

    Files lie one level deep; hidden directories are left out; a name that is missing is the directory's.
    """
    files = files.where(F.col(path).rlike(r"^(?!\.)[^/]+/[^/]+$"))
    t = F.regexp_replace(F.col(text), "\r\n", "\n")
    fenced = t.rlike(r"^[ \t]*---[ \t]*(?:\n|$)")
    both = r"(?s)^[ \t]*---[ \t]*\n(.*?\n)??[ \t]*---[ \t]*(?:\n(.*))?$"
    head = F.when(fenced & ~t.rlike(both), F.raise_error("a front matter has no end").cast("string")).when(fenced, F.regexp_extract(t, both, 1)).otherwise("")
    body = F.when(fenced, F.regexp_extract(t, both, 2)).otherwise(t)
    lines = F.filter(F.split("_head", "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+:"))
    key = lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_-]+):", 1)
    value = lambda x: F.regexp_replace(X.trim(F.regexp_extract(x, r"^[A-Za-z0-9_-]+:(.*)$", 1)), r"""^(["'])(.*)\1$""", "$2")
    pairs = F.transform(lines, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    out = files.select(F.col(path).alias("path"), head.alias("_head"), X.trim(body).alias("body")).withColumn("frontmatter", F.map_from_entries(last))
    fm = F.col("frontmatter")
    name = F.coalesce(F.when(fm["name"] != "", fm["name"]), F.split("path", "/")[0])
    return out.select("path", name.alias("name"), F.coalesce(fm["description"], F.lit("")).alias("description"), "body", "frontmatter")


def skill_count(paths: DataFrame, path: str = "path") -> DataFrame:
    """``n``: folders right under the root, hidden ones left out, that hold a skill file."""
    return paths.where(F.col(path).rlike(r"^[^./][^/]*/SKILL\.md$")).agg(F.countDistinct(path).alias("n"))


def split_skill(body: str, limit: int = X.SKILL_CHUNK) -> list[str]:
    """A skill's body in parts of ``limit`` characters: at headings, else at blank lines, else anywhere.

    The coarsest mark whose pieces all fit, packed greedily, is taken.
    """
    body = body.strip()
    if len(body) <= limit:
        return [body]
    for mark in ("\n## ", "\n### ", "\n\n"):
        first, *rest = body.split(mark)
        pieces = [x.rstrip("\n") for x in ([first] if first.strip() else []) + [mark.lstrip("\n") + x for x in rest]]
        pieces = [x for x in pieces if x]
        if len(pieces) < 2:
            continue
        packed: list[str] = []
        for x in pieces:
            if packed and len(packed[-1]) + 2 + len(x) <= limit:
                packed[-1] += "\n\n" + x
            else:
                packed.append(x)
        packed = [x.strip() for x in packed]
        if all(len(x) <= limit for x in packed):
            return packed
    return [body[i : i + limit] for i in range(0, len(body), limit)]


def skill_parts(body: str) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: split_skill(b or ""))

    return run(body)


def skill_chunks(skills: DataFrame) -> DataFrame:
    """``id, content, content_hash`` of each part: ``skill:<slug>`` for one part, ``...:part-N`` for more."""
    rows = skills.select("name", "description", skill_parts("body").alias("parts")).select("name", "description", F.posexplode("parts").alias("i", "part"), F.size("parts").alias("n"))
    base = F.concat(F.lit("skill:"), X.slug(F.col("name")))
    head = F.concat(F.when(F.col("name") != "", F.concat(F.lit("skill: "), X.trim(F.col("name")), F.lit("\n"))).otherwise(""), F.when(F.col("description") != "", F.concat(F.lit("description: "), X.trim(F.col("description")), F.lit("\n"))).otherwise(""))
    foot = F.when(F.col("n") > 1, F.concat(F.lit("\n\n(part "), F.col("i") + 1, F.lit(" of "), "n", F.lit(")"))).otherwise("")
    content = F.concat(head, F.lit("\n"), "part", foot)
    rows = rows.select(F.when(F.col("n") > 1, F.concat(base, F.lit(":part-"), F.col("i") + 1)).otherwise(base).alias("id"), content.alias("content"))
    return rows.withColumn("content_hash", X.content_hash(F.col("content")))


def frames(data: bytes, most: int = BUFFER_MOST) -> Iterator[bytes]:
    """Records behind 4-byte big-endian lengths; empty ones are skipped, long or cut-off ones are errors."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("a length is cut off")
        n = int.from_bytes(data[at : at + 4], "big")
        if n > most or at + 4 + n > len(data):
            raise ValueError("a record is too long or cut off")
        if n:
            yield data[at + 4 : at + 4 + n]
        at += 4 + n


def length_prefixed(files: DataFrame, column: str = "content") -> DataFrame:
    """``seq, value`` of the records of binary buffers."""

    def run(batches):
        for pdf in batches:
            for data in pdf[column]:
                rows = list(enumerate(frames(bytes(data))))
                yield pd.DataFrame({"seq": [i for i, _ in rows], "value": [x.decode("utf-8", "replace") for _, x in rows]})

    return files.select(column).mapInPandas(run, "seq bigint, value string")


def query_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Query lists: blank lines and ``#`` comments go."""
    q = X.trim(F.col(column))
    return lines.select(q.alias("query")).where((F.col("query") != "") & ~F.col("query").startswith("#"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """A label file (JSONL); malformed lines and unknown labels fail the query."""
    from tesserae.operators.drift import assert_labels

    kind = "session_id string, turn_idx int, prompt string, injected_hit_ids array<string>, search_queries array<string>, tools_used array<string>, flagged boolean, label string"
    return assert_labels(spark.read.schema(kind).option("mode", "FAILFAST").json(path))


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic, offline embedder: signed feature hashing of words, unit length.

    A text whose words cancel each other out, or that is white space of other scripts alone,
    counts as one word; only a blank one has the zero vector.
    """

    def embed(texts: list[str]) -> list[list[float]]:
        import numpy as np
        import xxhash

        def add(i: int, w: str) -> None:
            h = xxhash.xxh64_intdigest(w.encode())
            out[i, h % dim] += 1 if h >> 63 else -1

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                add(i, w)
            if not out[i].any() and t.strip(" \t\n\v\f\r"):
                add(i, t)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype("f4").tolist()

    return embed


#: Requests of a task that are under way at once; seconds that a request may take, and more for each of its texts.
EMBED_WORKERS, EMBED_SECONDS, EMBED_SECONDS_EACH = 4, 30.0, 2.0


def embed_column(
    df: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text: str = "content", to: str = "vector", batch: int = EMBED_BATCH, tries: int = 3,
    workers: int = EMBED_WORKERS, seconds: float = EMBED_SECONDS, seconds_each: float = EMBED_SECONDS_EACH,
) -> DataFrame:
    """``df`` with vectors of ``text``.

    A task gathers requests of ``batch`` texts, whatever the sizes of Spark's own
    batches, and has up to ``workers`` of them under way at once; rows keep their order, and memory
    holds the rows of these requests.  A request may take ``seconds`` and
    ``seconds_each`` for each text; one that is late, or times out by itself, is made
    again, up to ``tries`` times.  Any other failure, or a wrong number of vectors, is
    final for its batch and gives nulls.  A call that never comes back is left behind.
    """
    rest = [c for c in df.columns if c != to]
    narrow = df.select(*rest)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema), f"`{to}` array<float>"])
    at = rest.index(text)

    def run(batches):
        from collections import deque
        from concurrent.futures import ThreadPoolExecutor

        import pyarrow as pa

        def requests():
            held, n = [], 0
            for b in batches:
                lo = 0
                while lo < b.num_rows:
                    some = b.slice(lo, batch - n)
                    held.append(some)
                    lo, n = lo + some.num_rows, n + some.num_rows
                    if n == batch:
                        yield pa.Table.from_batches(held).combine_chunks()
                        held, n = [], 0
            if n:
                yield pa.Table.from_batches(held).combine_chunks()

        def done(table, future):
            vectors = future.result() or [None] * len(table)
            column = pa.array(vectors, pa.list_(pa.float32()))
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in table.columns), column], names=[*rest, to])

        under_way: deque = deque()
        with ThreadPoolExecutor(workers) as pool:
            for table in requests():
                texts = [x or "" for x in table.column(at).to_pylist()]
                under_way.append((table, pool.submit(_asked, embedder, texts, tries, seconds + seconds_each * len(texts))))
                if len(under_way) == workers:
                    yield done(*under_way.popleft())
            while under_way:
                yield done(*under_way.popleft())

    return narrow.mapInArrow(run, schema).select(*[c if c != to else F.col(to) for c in [*df.columns, *([] if to in df.columns else [to])]])


def _asked(embedder: Callable, texts: list[str], tries: int, limit: float) -> list | None:
    """The vectors of ``texts``, or None; no try takes longer than ``limit`` seconds."""
    import queue
    import threading

    def call(box: queue.Queue) -> None:
        try:
            box.put(list(embedder(texts)))
        except Exception as e:  # noqa: BLE001
            box.put(e)

    for _ in range(tries):
        box: queue.Queue = queue.Queue(1)
        threading.Thread(target=call, args=(box,), daemon=True).start()
        try:
            got = box.get(timeout=limit)
        except queue.Empty:
            continue
        if not isinstance(got, Exception):
            return got if len(got) == len(texts) else None
        if not isinstance(got, TimeoutError):
            return None
    return None


def lookup_embedder(df: DataFrame, known: DataFrame, dim: int, text: str = "content", to: str = "vector") -> DataFrame:
    """Vectors by text from a table (``text, v``); the zero vector for others."""
    k = known.select(F.col("text").alias("_t"), F.col("v").alias("_v")).dropDuplicates(["_t"])
    return df.join(k, F.col(text) == F.col("_t"), "left").withColumn(to, F.coalesce("_v", F.array_repeat(F.lit(0.0).cast("float"), dim))).drop("_t", "_v")


def model_dimension(name: str) -> int | None:
    """By the catalogue, the tag left out."""
    return MODELS.get(name.split(":")[0])


def usable_index(indexed: list[str], pulled: list[str], preferred: str = "") -> str | None:
    """The preferred model if it is indexed and pulled, else the first indexed one that is pulled."""
    have = {p.removesuffix(":latest") for p in pulled}
    fine = [m for m in indexed if m.removesuffix(":latest") in have]
    want = preferred.removesuffix(":latest")
    return next((m for m in fine if m.removesuffix(":latest") == want), fine[0] if fine else None)


def newer_directory(facts: DataFrame) -> Column:
    """Aggregate: of ``dir, max_mod_time, canonical`` the newest directory, the canonical one on a tie."""
    return F.max_by("dir", F.struct("max_mod_time", "canonical"))


def scope_of(cwd: Column, root: Column) -> Column:
    """``cwd`` below ``root`` ('' at the root or outside)."""
    return F.when(cwd.startswith(F.concat(root, F.lit("/"))), F.substring(cwd, F.length(root) + 2, F.length(cwd))).otherwise("")
