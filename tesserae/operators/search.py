"""Chunk search: filters, exact cosine with freshness, top-k, budgets, views.

A chunk row has ``id, file_path, content, kind, source_type, sub_project,
metadata, context_path, summary, vector, last_accessed`` and more; every
operator needs only the columns it names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.functions import vector as M


def source_is(df: DataFrame, source_type: str) -> DataFrame:
    return df.where(F.col("source_type") == source_type) if source_type else df


def project_is(df: DataFrame, sub_project: str) -> DataFrame:
    """``__root__`` stands for rows of no project; the empty string for all."""
    if not sub_project:
        return df
    if sub_project == "__root__":
        return df.where(F.col("sub_project").isNull() | (F.col("sub_project") == ""))
    return df.where(F.col("sub_project") == sub_project)


def in_scope(df: DataFrame, scope: str, mode: str = "like", column: str = "context_path") -> DataFrame:
    """Rows under a path: ``like`` is a raw, case-blind prefix with wildcards; ``path`` means whole segments (and prunes row groups)."""
    if not scope:
        return df
    if mode == "like":
        return df.where(F.col(column).ilike(scope + "%"))
    at = scope.rstrip("/")
    return df.where((F.col(column) == at) | F.col(column).startswith(at + "/"))


def metadata_is(df: DataFrame, wanted: dict) -> DataFrame:
    """All top-level keys equal as JSON (1 is 1.0, not "1"); empty metadata never matches."""
    for key, value in wanted.items():
        got = F.get_json_object("metadata", f"$.{key}")
        raw = F.get_json_object(F.concat(F.lit("["), F.coalesce("metadata", F.lit("null")), F.lit("]")), f"$[0].{key}")
        if isinstance(value, bool) or value is None:
            same = raw == json.dumps(value)
        elif isinstance(value, (int, float)):
            same = (got.try_cast("double") == float(value)) & ~F.col("metadata").rlike(rf'"{key}"\s*:\s*"')
        elif isinstance(value, str):
            same = (got == value) & F.col("metadata").rlike(rf'"{key}"\s*:\s*"')
        else:
            same = got == json.dumps(value, separators=(",", ":"))
        df = df.where(~F.coalesce("metadata", F.lit("")).isin("", "{}") & F.coalesce(same, F.lit(False)))
    return df


def detail(level: str) -> Column:
    """The text shown at a level: ``summary``, ``snippet`` or ``full``."""
    if level == "summary":
        return F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(X.clip(F.col("content"), 120))
    if level == "snippet":
        return X.clip(F.col("content"), 200)
    if level != "full":
        raise ValueError(f"no such level: {level}")
    return F.col("content")


def source_category(kind: Column) -> Column:
    return F.when(kind.isin("external", "memory", "commit"), kind).otherwise("code")


def assert_dimension(df: DataFrame, dim: int, column: str = "vector") -> DataFrame:
    """``df``; a row whose vector has another length fails the query when it is read."""
    bad = F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, found "), F.size(column).cast("string"))).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(F.size(column) == dim, F.col(column)).otherwise(bad))


def same_model(a: str, b: str) -> bool:
    """Model names without their ``:latest``."""
    return bool(a and b) and a.removesuffix(":latest") == b.removesuffix(":latest")


def score(chunks: DataFrame, query: list[float], now: int | None = None) -> DataFrame:
    """``chunks`` with ``score``: cosine, times freshness if ``now`` is given.  One pass, no shuffle."""
    s = M.cosine_to(F.col("vector"), [float(x) for x in query])
    return chunks.withColumn("score", s if now is None else s * M.freshness(F.col("last_accessed"), now))


def top(scored: DataFrame, k: int) -> DataFrame:
    """Best first, ties by id; all rows for k of 0 or less."""
    ordered = scored.orderBy(F.col("score").desc(), "id")
    return ordered.limit(k) if k > 0 else ordered


def search(chunks: DataFrame, query: list[float], k: int = 5, *, now: int | None = None, source_type: str = "", sub_project: str = "", metadata: dict | None = None, scope: str = "", scope_mode: str = "like", level: str = "full") -> DataFrame:
    """Filtered, scored and cut to ``k``; ``text`` is the content at ``level``."""
    df = metadata_is(in_scope(project_is(source_is(chunks, source_type), sub_project), scope, scope_mode), metadata or {})
    return top(score(df, query, now), k).withColumn("text", detail(level))


#: Queries of one search that go to every task with its code; more are rows of their own.
QUERY_ROUND = 1024
#: Queries and chunks of a group, where both are dealt into groups that meet pair by pair.
QUERY_GROUP, CHUNK_GROUP = 4096, 1 << 17
#: With more groups of chunks than this a part of them gives each query a score to reach first.
SAMPLED, SAMPLE = 16, 32


def _usable(vector) -> list[float]:
    """A query's components; none for one without a cosine."""
    return [] if vector is None or None in vector else list(vector)


def search_many(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top ``k`` for each of many queries (``query_id, qvec``): ``query_id, id, score, rank``.

    Up to ``QUERY_ROUND`` queries are matrices that go to every task: chunks are read
    once, in place, and only what can be among a task's best ``k`` leaves it.  More
    queries never come to the driver: they are dealt into groups, as chunks are, and each
    pair of groups is one product.  There a sample of the chunks first gives each query a score that ``k``
    chunks reach, below which nothing leaves a task.  Either way it is one job for all
    queries, of any length and id type; queries without a cosine (null ones, null
    components) score 0.
    """
    few = queries.select("query_id", F.col("qvec").cast("array<double>").alias("qvec")).limit(QUERY_ROUND + 1).collect()
    narrow = chunks.select("id", "vector")
    kinds = [queries.schema["query_id"].dataType.simpleString(), chunks.schema["id"].dataType.simpleString()]
    out = _few(narrow, few, k, kinds) if len(few) <= QUERY_ROUND else _grouped(narrow, queries, k, kinds)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _few(narrow: DataFrame, rows: list, k: int, kinds: list[str]) -> DataFrame:
    import pyarrow as pa

    by_length: dict[int, list] = {}
    for r in rows:
        v = _usable(r.qvec)
        by_length.setdefault(len(v), []).append((r.query_id, v))

    def run(batches):
        best = [M.BestCosines(pa.array([i for i, _ in some]), [v for _, v in some], k) for some in by_length.values()]
        for b in batches:
            for one in best:
                yield from one.feed(b)

    return narrow.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")


def _grouped(narrow: DataFrame, queries: DataFrame, k: int, kinds: list[str]) -> DataFrame:
    v = F.col("qvec").cast("array<double>")
    asked = queries.select("query_id", F.when(F.forall(v, lambda x: x.isNotNull()), v).otherwise(F.array().cast("array<double>")).alias("qvec"))
    asked = asked.withColumn("qvec", F.coalesce("qvec", F.array().cast("array<double>"))).withColumn("length", F.size("qvec"))
    sizes = {r.length: r["count"] for r in asked.groupBy("length").count().collect()}  # one number a length
    n_chunks = narrow.count()
    groups = -(-n_chunks // CHUNK_GROUP)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    split = F.element_at(F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, -(-n // QUERY_GROUP))]), F.col("length"))
    asked = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), split).cast("int"))
    every = F.array(*[F.struct(F.lit(d).alias("length"), F.lit(i).alias("q")) for d, n in sizes.items() for i in range(-(-n // QUERY_GROUP))])
    held = narrow.withColumn("c", part("id", max(1, groups)))

    def met(questions: DataFrame, rows: DataFrame, sampled: bool) -> DataFrame:
        left = questions.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(max(1, groups) - 1))))
        right = rows.withColumn("g", F.explode(every)).select("id", "vector", "c", F.col("g.length").alias("length"), F.col("g.q").alias("q"))

        def run(l, r):
            import pyarrow as pa

            none = pa.schema([("query_id", l.schema.field("query_id").type), ("id", r.schema.field("id").type), ("score", pa.float64())]).empty_table()
            if not l.num_rows:
                return none
            l, r = l.combine_chunks(), r.select(["id", "vector"])
            floor = l["floor"].to_numpy() if sampled else None
            best = M.BestCosines(l["query_id"].combine_chunks(), l["qvec"].combine_chunks().flatten().to_numpy(), k, floor)
            found = [x for b in r.to_batches() for x in best.feed(b)]
            return pa.Table.from_batches(found) if found else none

        keys = ["length", "q", "c"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, score double")

    if groups <= SAMPLED:
        return met(asked, held, False)
    some = met(asked, held.where(part("id", SAMPLE) == 0), False)
    kth = F.element_at(F.sort_array(F.collect_list("score"), False), k)  # at most k rows a group and query, and few others
    ranked = some.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc()))).where(F.col("r") <= k)
    floors = ranked.groupBy("query_id").agg(F.when(F.count("*") == k, kth).alias("floor"))
    return met(asked.join(floors, "query_id", "left"), held, True)


def budget(ranked: DataFrame, max_tokens: int, by: list[str] | None = None) -> DataFrame:
    """The prefix of a ranking that fits; the first row always stays.  ``ranked``: at most k rows a query."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("score").desc(), "id")
    cum = F.sum(X.tokens_floor(F.col("content"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumns({"_rn": F.row_number().over(w), "_cum": cum}).where((F.col("_rn") == 1) | (F.col("_cum") <= max_tokens)).drop("_rn", "_cum")


def retrieve(chunks: DataFrame, query: list[float], k: int = 10, max_tokens: int = 2000, now: int | None = None) -> DataFrame:
    """Search, then a token budget, then the block's projection."""
    kept = budget(search(chunks, query, k, now=now), max_tokens)
    return kept.select("id", "file_path", "start_line", "end_line", "content", "score", X.tokens_floor(F.col("content")).alias("tokens"))


def format_blocks(blocks: DataFrame) -> DataFrame:
    """One row ``text``: all blocks of a (bounded) retrieval, best first."""
    line = F.format_string("[%s:%d-%d] (score: %.2f)\n%s", "file_path", "start_line", "end_line", "score", "content")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", line.alias("t"))))
    return blocks.agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"))


def explain(chunks: DataFrame, query: list[float], now: int | None = None) -> DataFrame:
    """Histogram of the scores of all chunks, long: ``bucket, n``."""
    s = score(chunks, query, now)
    bucket = F.when(F.col("score") >= 0.9, ">=0.9").when(F.col("score") >= 0.7, ">=0.7").when(F.col("score") >= 0.5, ">=0.5").otherwise("<0.5")
    return s.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def source_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(source_category(F.col("kind")).alias("category")).agg(F.count("*").alias("n"))


def by_ids(df: DataFrame, ids: list[str] | DataFrame, column: str = "id") -> DataFrame:
    """Point lookups: a pushed-down IN for a list, a semi join for a table of ids."""
    return df.where(F.col(column).isin(ids)) if isinstance(ids, list) else df.join(ids, column, "left_semi")


def file_facts(chunks: DataFrame) -> DataFrame:
    """For each file: chunks, newest time, the hash and text of its first chunk (by id)."""
    first = F.min(F.struct("id", "content_hash", "content"))
    return chunks.groupBy("file_path").agg(F.count("*").alias("n_chunks"), F.max("mod_time").alias("max_mod_time"), first["content_hash"].alias("content_hash"), first["content"].alias("snippet"))


def first_files(ranked: DataFrame, n: int) -> DataFrame:
    """The first ``n`` distinct files of a ranking, in rank order."""
    return ranked.groupBy("file_path").agg(F.min("rank").alias("rank")).orderBy("rank", "file_path").limit(n)


def related(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` (``id, type, target``) with the target file's first text; a missing one is ''."""
    facts = file_facts(chunks).select(F.col("file_path").alias("target"), "snippet")
    return edges.join(facts, "target", "left").select("id", "type", "target", F.coalesce("snippet", F.lit("")).alias("snippet"))


def edges_of(chunks: DataFrame) -> DataFrame:
    """The JSON ``relationships`` of chunks as rows ``id, type, target``."""
    return chunks.select("id", F.explode(F.from_json("relationships", "array<struct<type:string,target:string>>")).alias("e")).select("id", "e.type", "e.target")
