"""Long-term memory: recall, exact and semantic deduplication, merge, statistics.

A memory row has ``id, content, type, tags, project, vector, created_at,
updated_at, source, content_hash, context_path``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.functions import vector as M
from tesserae.operators import ordered, pivots
from tesserae.operators.search import in_scope, score, top
from tesserae.sources.shared import cut

SIMILAR = 0.92
RECALL_DEFAULT, RECALL_MOST = 5, 100
#: Rows of a block of either side that looks for similar ones.
BLOCK = 4096
#: ``most`` of the store's contract: above so many memories no similar ones are looked for.
CACHE_MOST = 10_000


def filtered(memories: DataFrame, *, type: str = "", project: str = "", source: str = "", scope: str = "", tags: list[str] | None = None) -> DataFrame:
    """All given filters; any of ``tags`` is enough."""
    for column, value in (("type", type), ("project", project), ("source", source)):
        if value:
            memories = memories.where(F.col(column) == value)
    if tags:
        memories = memories.where(F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, tags))), F.lit(False)))
    return in_scope(memories, scope)


def recall(memories: DataFrame, query: str, qvec: list[float], limit: int = 0, **filters) -> DataFrame:
    """Best memories by cosine alone."""
    if not query.strip():
        raise ValueError("a query is needed")
    k = RECALL_DEFAULT if limit <= 0 else min(limit, RECALL_MOST)
    return top(score(filtered(memories, **filters), qvec), k)


def prepare(texts: DataFrame, content: str = "content") -> DataFrame:
    """``texts`` with ``content_hash``, ``tags`` and ``type`` of their content."""
    c = F.col(content)
    return texts.withColumns({"content_hash": X.content_hash(c), "tags": X.tags(c), "type": X.memory_type(c)})


def exact_duplicates(new: DataFrame, memories: DataFrame) -> DataFrame:
    return new.join(memories.select("content_hash"), "content_hash", "left_semi")


def not_stored(new: DataFrame, memories: DataFrame) -> DataFrame:
    return new.join(memories.select("content_hash"), "content_hash", "left_anti")


def similar(new: DataFrame, memories: DataFrame, threshold: float = SIMILAR, most: int | None = None, found_by: pivots.Pivots | None = None) -> DataFrame:
    """For each new row (``new_id, new_vector``) its most similar memory strictly above ``threshold``: ``new_id, id, score``.

    Exact over any number of memories: of equal vectors one on each side is compared,
    and of all others only those that pivots don't tell apart
    (:mod:`tesserae.operators.pivots`; ``found_by``: stored pivots, else some are chosen).
    ``most`` is the store's contract that turns this step off above so many
    memories.  Vectors without a finite cosine are similar to nothing.
    """
    import pyarrow as pa

    if threshold < 0:
        raise ValueError("a threshold of 0 or more is needed")
    id_type = memories.schema["id"].dataType.simpleString()
    if most is not None and memories.limit(most + 1).count() > most:
        return new.select("new_id", F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("double").alias("score")).limit(0)

    asked = new.where("new_id is not null and new_vector is not null").groupBy("new_vector").agg(F.min("new_id").alias("key"))
    known = memories.where("vector is not null").groupBy("vector").agg(F.min("id").alias("id"))

    def found(l, r):
        ids = r.schema.field("key").type
        out = list(M.nearest(l.to_batches(), r, threshold, ids)) if r.num_rows else []
        return pa.Table.from_batches([x.rename_columns(["key", "id", "score"]) for x in out], pa.schema([("key", l.schema.field("key").type), ("id", ids), ("score", pa.float64())]))

    by = pivots.choose(memories) if found_by is None else found_by
    angle = pivots.reach(threshold)
    sides = pivots.blocks(asked, "key", "new_vector", by, angle, BLOCK), pivots.blocks(known, "id", "vector", by, angle, BLOCK)
    best = F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b")
    kind = new.schema["new_id"].dataType.simpleString()
    top = pivots.join(*sides, by, threshold, found, f"key {kind}, id {id_type}, score double").groupBy("key").agg(best)
    hits = new.select("new_id", "new_vector").join(asked.join(top, "key"), "new_vector").select("new_id", "b.*")
    return hits.groupBy("new_id").agg(F.min(F.struct("s", "id")).alias("b")).select("new_id", "b.id", (-F.col("b.s")).alias("score"))


def linked(left: DataFrame, right: DataFrame, by: pivots.Pivots, threshold: float) -> DataFrame:
    """``a, b, score`` of all pairs strictly above ``threshold``, ``b`` of ``left`` and ``a`` of ``right`` (blocks of :func:`pivots.blocks`)."""
    import pyarrow as pa

    def found(l, r):
        import numpy as np

        out: list = []
        for dim in {len(v) for v in l["v"][:1].to_pylist()} & {len(v) for v in r["v"][:1].to_pylist()}:  # a block has one length
            (x, _), (y, _) = (M.as_matrix(t["v"].combine_chunks(), dim) for t in (l, r))
            n, m = np.sqrt(M.dots(x, x)), np.sqrt(M.dots(y, y))
            for lo in range(0, len(x), 512):
                i, j = np.nonzero((x[lo : lo + 512] / n[lo : lo + 512, None]) @ (y / m[:, None]).T > threshold - 1e-9)
                score = M.dots(x[lo + i], y[j]) / (n[lo + i] * m[j])
                fine = score > threshold
                out.append(pa.table({"a": r["key"].take(pa.array(j[fine])), "b": l["key"].take(pa.array(lo + i[fine])), "score": pa.array(score[fine])}))
        none = pa.schema([("a", r.schema.field("key").type), ("b", l.schema.field("key").type), ("score", pa.float64())])
        return pa.concat_tables(out) if out else none.empty_table()

    kinds = [t.schema["key"].dataType.simpleString() for t in (right, left)]
    return pivots.join(left, right, by, threshold, found, f"a {kinds[0]}, b {kinds[1]}, score double")


#: Links that one task settles in order at the end of the rounds.
FOLD = 1 << 18
#: The first batch of a greedy choice, and how much larger each next one is.
PREFIX, GROWTH = 4096, 4


def first_set(nodes: DataFrame, links: DataFrame, fold: int = FOLD) -> DataFrame:
    """The greedy independent set in the order of ``n``: a node is in it if no earlier node that it is linked with is.

    ``nodes``: ``n``; ``links``: ``a, b`` with ``a < b``.  Each round takes all nodes
    whose earlier neighbours are settled.  The rounds are as many as the longest chain of
    decisions that hang on each other; once no more than ``fold`` links are open, one
    task settles these in order.
    """
    open_, undecided, taken = cut(links.select("a", "b").distinct()), nodes.select("n"), nodes.select("n").limit(0)
    while left := open_.count():
        if left <= fold:
            ordered = open_.repartition(1).sortWithinPartitions("b", "a")
            lost = undecided.join(ordered.mapInArrow(_lost, "n bigint"), "n", "left_anti")
            return taken.unionByName(lost)
        roots = cut(undecided.join(open_.select(F.col("b").alias("n")), "n", "left_anti"))
        dead = cut(open_.join(roots.withColumnRenamed("n", "a"), "a", "left_semi").select(F.col("b").alias("n")).distinct())
        settled = roots.unionByName(dead)
        undecided = cut(undecided.join(settled, "n", "left_anti"))
        alive = open_.join(settled.withColumnRenamed("n", "a"), "a", "left_anti")
        open_ = cut(alive.join(dead.withColumnRenamed("n", "b"), "b", "left_anti").select("a", "b"))
        taken = cut(taken.unionByName(roots))
    return taken.unionByName(undecided)


def _lost(batches):
    """Links ``a, b`` by ``b`` -> the nodes that an earlier node of the set keeps out."""
    import pyarrow as pa

    lost: set[int] = set()
    for batch in batches:
        new = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a not in lost and b not in lost:
                lost.add(b)
                new.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(new, pa.int64())], names=["n"])


def leaders(rows: DataFrame, by: pivots.Pivots, threshold: float, prefix: int = PREFIX, fold: int = FOLD) -> DataFrame:
    """Of ``new_id, new_vector, place`` those that are similar to no earlier one of them, ``place`` telling rows apart.

    The order is taken in batches, each several times the one before.  What is similar to
    a leader found so far goes first, by a join; only what is left is linked
    with itself and settled by rounds.  So a large group of near copies is linked within the batch
    of its first ones alone.
    """
    angle = pivots.reach(threshold)
    alone = rows.withColumn("angles", pivots._angles("new_vector", by)).where("angles is null").select("new_id")
    if threshold < 1 - 1e-9:  # of equal vectors the later ones are similar to the first, or to what the first is similar to
        rows = rows.groupBy("new_vector").agg(F.min_by(F.struct("new_id", "place"), "place").alias("f")).select("f.*", "new_vector")
    placed = ordered.numbered(rows, "place")
    total, start = placed.count(), 0
    found, size = None, prefix
    while start < total:
        batch = pivots.blocks(placed.where((F.col("n") >= start) & (F.col("n") < start + size)), "n", "new_vector", by, angle, BLOCK)
        if found is not None:
            near = linked(batch, found, by, threshold).select(F.col("b").alias("key")).distinct()
            batch = cut(batch.join(near, "key", "left_anti"))
        pairs = linked(batch, batch, by, threshold).where("a < b")
        chosen = first_set(batch.select(F.col("key").alias("n")), pairs, fold)
        new = batch.join(chosen.withColumnRenamed("n", "key"), "key", "left_semi").select("key", "v", "angles", "block")
        found = cut(new if found is None else found.unionByName(new))
        start, size = start + size, size * GROWTH
    if found is None:
        return alone.distinct()
    return placed.join(found.select(F.col("key").alias("n")), "n", "left_semi").select("new_id").unionByName(alone).distinct()


def remember(memories: DataFrame, new: DataFrame, now: int, threshold: float = SIMILAR, most: int | None = None) -> DataFrame:
    """The table after explicit memories ``new`` (``content, tags, type, project, vector, context_path``), and ``status``.

    An equal hash merges tags, sets the type and touches; else the best similar
    memory (above ``threshold``) is updated: an explicit one keeps its content,
    a session one takes the new content, vector and hash and becomes explicit;
    else the row is inserted.  Blank context paths only are filled.

    Every row of ``new`` takes part, in the order of ``ordinal`` if there is such
    a column, then of the hash: of several that meet one memory (or one hash) all
    tags are merged in that order, the first gives content, the last the type.
    They are matched with the store as it was, not with each other.
    """
    place = F.col("ordinal") if "ordinal" in new.columns else F.lit(0)
    new = new.withColumn("content_hash", X.content_hash(F.col("content"))).withColumn("place", F.struct(place.alias("o"), "content_hash", F.xxhash64(*[F.col(c) for c in ("content", "type", "project", "context_path")]).alias("x")))
    tied = F.coalesce("tags", F.array().cast("array<string>"))
    rows = new.select("content_hash", "place", "type", tied.alias("tags"), "content", "project", "vector", F.nullif(F.col("context_path"), F.lit("")).alias("path"))
    exact = rows.join(memories.groupBy("content_hash").agg(F.min("id").alias("id")), "content_hash").withColumn("how", F.lit("exact"))
    open_ = rows.join(memories.select("content_hash"), "content_hash", "left_anti")
    one = open_.groupBy("content_hash").agg(F.min_by("vector", "place").alias("new_vector"))
    near = similar(one.select(F.col("content_hash").alias("new_id"), "new_vector"), memories, threshold, most).select(F.col("new_id").alias("content_hash"), "id")
    placed = open_.join(near, "content_hash", "left")
    close = placed.where("id is not null").withColumn("how", F.lit("similar"))
    fresh = placed.where("id is null").drop("id").withColumn("id", F.concat(F.lit("mem:explicit:"), "content_hash")).withColumn("how", F.lit("created"))
    hits = exact.unionByName(close).unionByName(fresh)
    first = lambda c: F.min_by(F.when(F.col("how") != "exact", F.col(c)), F.when((F.col("how") != "exact") & F.col(c).isNotNull(), F.col("place"))).alias(f"n_{c}")
    facts = hits.groupBy("id").agg(
        *[first(c) for c in ("content", "vector", "project", "content_hash")], F.max_by("type", "place").alias("n_type"), F.min_by("path", F.when(F.col("path").isNotNull(), F.col("place"))).alias("n_path"),
        F.max(F.col("how") == "similar").alias("near"), F.max(F.col("how") == "created").alias("created"),
    )
    tag = hits.select("id", "place", F.posexplode("tags").alias("i", "tag")).groupBy("id", "tag").agg(F.min(F.struct("place", "i")).alias("at"))
    ranked = tag.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("at"))).where(F.col("r") <= 2 * X.MOST_TAGS)  # old tags and as many new ones are all that can count
    tags = ranked.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]).alias("n_tags"))
    facts = facts.join(tags, "id", "left").withColumn("n_tags", F.coalesce("n_tags", F.array().cast("array<string>")))
    both = memories.join(facts.where(~F.col("created")), "id", "left")
    hit = F.col("near").isNotNull()
    over = F.coalesce("near", F.lit(False)) & (F.col("source") != "explicit")
    pick = lambda c, when, n=None: F.when(when, F.col(f"n_{n or c}")).otherwise(F.col(c)).alias(c)
    kept = both.select(
        "id", pick("content", over), pick("type", hit), F.when(hit, X.merge_tags(F.col("tags"), F.col("n_tags"))).otherwise(F.col("tags")).alias("tags"), "project", pick("vector", over), "created_at",
        F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"), F.when(F.coalesce("near", F.lit(False)), "explicit").otherwise(F.col("source")).alias("source"), pick("content_hash", over),
        F.when(hit & (F.coalesce("context_path", F.lit("")) == ""), F.coalesce("n_path", F.lit(""))).otherwise(F.col("context_path")).alias("context_path"), F.when(hit, "updated").otherwise("kept").alias("status"),
    )
    at = F.lit(now).cast("bigint")
    added = facts.where("created").select(
        "id", F.col("n_content").alias("content"), F.col("n_type").alias("type"), F.slice("n_tags", 1, X.MOST_TAGS).alias("tags"), F.col("n_project").alias("project"), F.col("n_vector").alias("vector"),
        at.alias("created_at"), at.alias("updated_at"), F.lit("explicit").alias("source"), F.col("n_content_hash").alias("content_hash"), F.coalesce("n_path", F.lit("")).alias("context_path"), F.lit("created").alias("status"),
    )
    return kept.unionByName(added)


def session_chunks(sessions: DataFrame, text: str = "summary", limit: int = X.SUMMARY_CHUNK) -> DataFrame:
    """One row per summary chunk (``project, ordinal, content`` and its hash, tags and type)."""
    rows = sessions.select("project", F.posexplode(X.summary_chunks(F.col(text), limit)).alias("ordinal", "content"))
    return prepare(rows)


def ingest_sessions(memories: DataFrame, chunks: DataFrame, now: int, threshold: float = SIMILAR, most: int | None = None, found_by: pivots.Pivots | None = None, prefix: int = PREFIX, fold: int = FOLD) -> DataFrame:
    """Ingest embedded session chunks (:func:`session_chunks` and ``vector``) in the order of ``ordinal``, then project.

    Returns ``project, ordinal, content_hash, action, id``: ``skipped`` (an equal
    hash in the whole store, whatever its project, or before in the call),
    ``updated`` (best match strictly above the threshold, in the store or among
    chunks that this call created before, whose vectors stay as they were) or
    ``created``.  A chunk that updated an explicit memory left no hash, so its
    equals update too.  Hashes are looked up in the store as it was.  ``most`` is
    the store's contract that has no semantic step above so many memories.

    Matching is greedy in the order of the chunks, and isn't transitive: which chunks are created is
    found in batches and rounds (:func:`leaders`), where no task sees all links; each chunk's best match
    is then a join with the store and one with what was created before it.
    """
    stored = memories.groupBy("content_hash").agg(F.min("id").alias("stored"))
    rows = chunks.select("project", "ordinal", "content_hash", "vector").join(stored, "content_hash", "left")
    first = W.partitionBy("content_hash").orderBy("ordinal", "project")
    rows = rows.withColumn("turn", F.when(F.col("stored").isNull(), F.row_number().over(first)))
    heads = cut(rows.where("turn = 1").select(F.col("content_hash").alias("new_id"), F.col("vector").alias("new_vector"), F.struct("ordinal", "project", "content_hash").alias("place")))
    if most is not None and memories.limit(most + 1).count() > most:
        fate = heads.select("new_id", F.lit(None).cast("string").alias("to"))
    else:
        by = pivots.choose(memories) if found_by is None else found_by
        best = cut(similar(heads, memories, threshold, None, by).select("new_id", F.col("id").alias("best"), F.col("score").alias("best_score")))
        own = pivots.choose(heads, "new_vector")
        made = leaders(heads.join(best, "new_id", "left_anti"), own, threshold, prefix, fold)
        made = cut(heads.join(made, "new_id", "left_semi"))
        angle = pivots.reach(threshold)
        links = linked(*(pivots.blocks(t, "new_id", "new_vector", own, angle, BLOCK) for t in (heads, made)), own, threshold)
        when = lambda c: heads.select(F.col("new_id").alias(c), F.col("place").alias(f"{c}_place"))
        earlier = links.join(when("b"), "b").join(when("a"), "a").where("a_place < b_place")
        new = earlier.groupBy("b").agg(F.min(F.struct((-F.col("score")).alias("s"), "a")).alias("m")).select(F.col("b").alias("new_id"), "m.a", (-F.col("m.s")).alias("score"))
        both = heads.select("new_id").join(best, "new_id", "left").join(new, "new_id", "left")
        newer = F.col("a").isNotNull() & (F.col("score") > F.coalesce("best_score", F.lit(-1.0)))
        fate = both.select("new_id", F.when(newer, F.concat(F.lit("mem:session:"), "a")).otherwise(F.col("best")).alias("to"))
    explicit = memories.where("source = 'explicit'").select(F.col("id").alias("to"), F.lit(True).alias("explicit"))
    fate = fate.join(explicit, "to", "left").select(F.col("new_id").alias("content_hash"), "to", F.coalesce("explicit", F.lit(False)).alias("explicit"))
    done = rows.join(fate, "content_hash", "left")
    action = F.when(F.col("stored").isNotNull() | ((F.col("turn") > 1) & ~F.col("explicit")), "skipped").when(F.col("to").isNotNull(), "updated").otherwise("created")
    return done.select("project", "ordinal", "content_hash", action.alias("action"), F.coalesce("stored", "to", F.concat(F.lit("mem:session:"), "content_hash")).alias("id"))


def ingested(memories: DataFrame, chunks: DataFrame, now: int, threshold: float = SIMILAR, most: int | None = None) -> DataFrame:
    """The table after :func:`ingest_sessions` of ``chunks`` (also ``content, tags, type``).

    A session memory takes the last update's content, vector and hash, and all
    their tags; an explicit one is only touched.
    """
    did = ingest_sessions(memories, chunks, now, threshold, most).where("action <> 'skipped'")
    rows = did.join(chunks, ["project", "ordinal", "content_hash"]).withColumn("place", F.struct("ordinal", "project"))
    last = lambda c, when: F.max_by(F.when(when, F.col(c)), F.when(when, F.col("place")))
    up, made = F.col("action") == "updated", F.col("action") == "created"
    tags = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "tags"))), lambda x: x["tags"])))
    facts = rows.groupBy("id").agg(*[last(c, up).alias(f"n_{c}") for c in ("content", "vector", "content_hash")], *[last(c, made).alias(f"c_{c}") for c in ("content", "vector", "content_hash", "project", "type", "tags")], F.max(made).alias("created"), tags.alias("n_tags"))
    both = memories.join(facts.where(~F.col("created")), "id", "left")
    hit = F.col("created").isNotNull()
    over = hit & (F.col("source") != "explicit")
    pick = lambda c: F.when(over, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    kept = both.select("id", pick("content"), "type", F.when(over, X.merge_tags(F.col("tags"), F.col("n_tags"))).otherwise(F.col("tags")).alias("tags"), "project", pick("vector"), "created_at", F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"), "source", pick("content_hash"), "context_path")
    at = F.lit(now).cast("bigint")
    newest = lambda c: F.coalesce(f"n_{c}", f"c_{c}").alias(c)
    added = facts.where("created").select("id", newest("content"), F.col("c_type").alias("type"), X.merge_tags(F.col("c_tags"), F.col("n_tags")).alias("tags"), F.col("c_project").alias("project"), newest("vector"), at.alias("created_at"), at.alias("updated_at"), F.lit("session").alias("source"), newest("content_hash"), F.lit("").alias("context_path"))
    return kept.unionByName(added)


def statistics(memories: DataFrame) -> DataFrame:
    """Counts by type, source and project and the total, in one pass: ``facet, value, n``."""
    rows = memories.select("type", "source", F.when(F.coalesce("project", F.lit("")) == "", "(global)").otherwise(F.col("project")).alias("project"))
    g = rows.groupingSets([["type"], ["source"], ["project"], []], "type", "source", "project").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    facet = F.when(F.col("g") == 3, "type").when(F.col("g") == 5, "source").when(F.col("g") == 6, "project").otherwise("total")
    value = F.when(F.col("g") == 3, F.col("type")).when(F.col("g") == 5, F.col("source")).when(F.col("g") == 6, F.col("project")).otherwise("")
    return g.select(facet.alias("facet"), value.alias("value"), "n")


def delete(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id"), "id", "left_anti")


def id_prefix(memories: DataFrame, prefix: str) -> DataFrame:
    """Ids with a prefix, in order; none for an empty one."""
    return memories.where(F.col("id").startswith(prefix) if prefix else F.lit(False)).select("id").orderBy("id")


def synced_skills(memories: DataFrame) -> DataFrame:
    """The number of skills: ids under ``skill:`` without parts."""
    return memories.where(F.col("id").startswith("skill:") & ~F.col("id").contains(":part-")).agg(F.count("*").alias("n"))


def skill_plan(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored and new skill chunks (``id, content_hash``) side by side: ``id, action``: created, updated, unchanged or pruned."""
    s, c = stored.select("id", F.col("content_hash").alias("old")), chunks.select("id", F.col("content_hash").alias("new"))
    action = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "pruned").when(F.col("old") == F.col("new"), "unchanged").otherwise("updated")
    return s.join(c, "id", "full").select("id", action.alias("action"))


def best_skills(scored: DataFrame, n: int = 3, by: list[str] | None = None, fetch: int = 5) -> DataFrame:
    """The best ``n`` skills of a ranking after its best part stands for each; of ``fetch * n`` rows read."""
    over = by or [F.lit(0)]
    order = [F.col("score").desc(), "id"]
    head = scored.withColumn("_r", F.row_number().over(W.partitionBy(*over).orderBy(*order))).where(F.col("_r") <= fetch * n)
    base = head.withColumn("base", X.base_id(F.col("id")))
    one = base.withColumn("_b", F.row_number().over(W.partitionBy(*over, "base").orderBy(*order))).where("_b = 1")
    return one.withColumn("rank", F.row_number().over(W.partitionBy(*over).orderBy(*order))).where(F.col("rank") <= n).drop("_r", "_b")
