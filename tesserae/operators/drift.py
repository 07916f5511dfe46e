"""Evaluation: semantic drift, threshold grids with confusion matrices, token savings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.functions import vector as M
from tesserae.operators.search import search_many
from tesserae.sources.shared import cut

LABELS = ("truly_redundant", "truly_missed", "neither", "unclear")


def hit_vectors(turns: DataFrame, chunks: DataFrame, ids: str = "hit_ids") -> DataFrame:
    """``turn_id, hit_id, hvec`` of the hits that are stored; others are dropped."""
    rows = turns.select("turn_id", F.explode(ids).alias("hit_id"))
    return rows.join(chunks.select(F.col("id").alias("hit_id"), F.col("vector").alias("hvec")), "hit_id").select("turn_id", "hit_id", "hvec")


def best_hit(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``turn_id, best_hit``: the largest cosine of a turn's queries (``turn_id, qvec``) and hits."""
    return queries.join(hits, "turn_id").groupBy("turn_id").agg(F.max(M.cosine(F.col("qvec"), F.col("hvec"))).alias("best_hit"))


#: Chunks that a replay with ``enough`` tries first, and how many times as many it has tried after each next round.
FIRST, GROWTH = 2048, 4


def replay(prompts: DataFrame, chunks: DataFrame, k: int = 10, enough: float | None = None) -> DataFrame:
    """``turn_id, best_chunk``: the best cosine of each prompt (``turn_id, pvec``) over all chunks.

    Who only asks whether it is above some thresholds names the greatest of them as ``enough``: then a prompt with a chunk above it
    gets that chunk's cosine and meets no more of them, while any other meets all chunks and gets its best.
    Chunks come in rounds of growing parts, so the work is that of all pairs only where no chunk is above.
    """
    asked = prompts.select(F.col("turn_id").alias("query_id"), F.col("pvec").alias("qvec"))
    if enough is None:
        got = search_many(chunks, asked, k)
        return got.where("rank = 1").select(F.col("query_id").alias("turn_id"), F.greatest("score", F.lit(0.0)).alias("best_chunk"))
    asked, some = cut(asked), cut(chunks.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("at")))
    total, tried, lo = some.count(), FIRST, 0
    found = asked.select("query_id", F.lit(0.0).alias("score")).limit(0)
    while lo < 1 << 30 and not asked.isEmpty():
        hi = 1 << 30 if tried * GROWTH > total else (tried << 30) // total
        part = some.where((F.col("at") >= lo) & (F.col("at") < hi))
        best = cut(search_many(part, asked, 1).select("query_id", "score"))
        found = found.unionByName(best)
        asked = cut(asked.join(best.where(F.col("score") > enough), "query_id", "left_anti"))
        lo, tried = hi, tried * GROWTH
    return found.groupBy(F.col("query_id").alias("turn_id")).agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best_chunk"))


def evidence(turns: DataFrame, prompts: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = 10, replayed: DataFrame | None = None) -> DataFrame:
    """All that a turn's verdict needs, once for every grid point.

    ``turns``: ``turn_id, hit_ids, n_queries, n_tools, label``; ``replayed``: a :func:`replay` of the prompts, else they are replayed against ``chunks``.
    """
    replayed = replay(prompts, chunks, k) if replayed is None else replayed
    hits = hit_vectors(turns, chunks)
    n_hits = hits.groupBy("turn_id").agg(F.count("*").alias("found"))
    has = prompts.select("turn_id", F.lit(True).alias("has_prompt"))
    embedded = queries.groupBy("turn_id").agg(F.count("*").alias("embedded"))
    out = turns.join(has, "turn_id", "left").join(n_hits, "turn_id", "left").join(embedded, "turn_id", "left").join(best_hit(queries, hits), "turn_id", "left").join(replayed, "turn_id", "left")
    return out.na.fill(0, ["found", "embedded"]).na.fill(False, ["has_prompt"])


def verdicts(seen: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """``t1, t2, turn_id, label, redundant, missed`` of the turns that can be scored, at each grid point.

    The grid is a literal array beside each turn: no join.
    """
    points = F.array(*[F.struct(F.lit(a).alias("t1"), F.lit(b).alias("t2")) for a, b in grid])
    used, tried = F.col("n_tools") > 0, (F.size("hit_ids") > 0) & (F.col("n_queries") > 0)
    skipped = ~F.col("has_prompt") | (used & tried & ((F.col("found") == 0) | (F.col("embedded") == 0)))
    rows = seen.where(~skipped).select("*", F.explode(points).alias("p"))
    redundant = used & tried & (F.coalesce("best_hit", F.lit(-1.0)) >= F.col("p.t1"))
    missed = ~used & (F.coalesce("best_chunk", F.lit(0.0)) >= F.col("p.t2"))
    return rows.select("p.t1", "p.t2", "turn_id", "label", redundant.alias("redundant"), missed.alias("missed"))


def confusion(found: DataFrame) -> DataFrame:
    """One row a grid point: counts and precision, recall, F1 for both verdicts; ``unclear`` is counted, not scored."""
    clear = F.col("label") != "unclear"
    aggs = []
    for name in ("redundant", "missed"):
        said, true = F.col(name), F.col("label") == f"truly_{name}"
        aggs += [F.count_if(clear & cond).alias(f"{k}_{name}") for k, cond in (("tp", said & true), ("fp", said & ~true), ("fn", ~said & true), ("tn", ~said & ~true))]
    out = found.groupBy("t1", "t2").agg(*aggs, F.count("*").alias("n_turns_scored"))
    for name in ("redundant", "missed"):
        tp, fp, fn = (F.col(f"{k}_{name}") for k in ("tp", "fp", "fn"))
        out = out.withColumns({f"precision_{name}": M.safe_div(tp, tp + fp), f"recall_{name}": M.safe_div(tp, tp + fn)})
        out = out.withColumn(f"f1_{name}", M.f1(F.col(f"precision_{name}"), F.col(f"recall_{name}")))
    return out


def best_points(grid: DataFrame, n: int = 10) -> DataFrame:
    return grid.orderBy((F.col("precision_redundant") + F.col("precision_missed")).desc(), (F.col("f1_redundant") + F.col("f1_missed")).desc(), "t1", "t2").limit(n)


def csv_rows(grid: DataFrame) -> DataFrame:
    """The grid in order, numbers as ``%.4f``, columns as the report has them."""
    real = ["t1", "t2", *[f"{k}_{n}" for n in ("redundant", "missed") for k in ("precision", "recall", "f1")]]
    whole = [*[f"{k}_{n}" for n in ("redundant", "missed") for k in ("tp", "fp", "fn", "tn")], "n_turns_scored"]
    return grid.orderBy("t1", "t2").select(*[F.format_string("%.4f", c).alias(c) for c in real], *[F.col(c).cast("string").alias(c) for c in whole])


def label_counts(turns: DataFrame) -> DataFrame:
    seeds = turns.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    return seeds.join(turns.groupBy("label").agg(F.count("*").alias("n")), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def assert_labels(turns: DataFrame) -> DataFrame:
    """``turns``; an unknown label or a blank session fails the query."""
    fine = F.col("label").isin(*LABELS) & (F.coalesce("session_id", F.lit("")) != "")
    return turns.withColumn("label", F.when(F.coalesce(fine, F.lit(False)), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("not a label: "), F.coalesce("label", F.lit("null")))).cast("string")))


def drift(turns: DataFrame, t1: float = 0.6, t2: float = 0.55, band: float = 0.05) -> DataFrame:
    """Counters of one report over per-turn evidence (``n_tools, n_queries, best_hit, best_chunk, has_prompt``): long ``counter, n``.

    Redundant looks at the best cosine from -1 up; only *missed* needs a prompt vector.
    """
    used = F.col("n_tools") > 0
    best = F.coalesce("best_hit", F.lit(-1.0))
    kind = (
        F.when(used & (F.col("n_queries") > 0) & (best >= t1), F.when(M.near(best, t1, band), "redundant_near").otherwise("redundant"))
        .when(used, "used")
        .when(~F.col("has_prompt"), "skipped_no_prompt")
        .when(F.col("best_chunk") >= t2, F.when(M.near(F.col("best_chunk"), t2, band), "missed_near").otherwise("missed"))
        .otherwise("quiet")
    )
    return turns.groupBy(kind.alias("counter")).agg(F.count("*").alias("n"))


def summarise(values: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Mean, nearest-rank p50 and p95, total: ``percentile_disc`` semantics."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {column})").cast("double")
    return values.groupBy(*by).agg(F.avg(column).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.sum(column).alias("total"), F.count("*").alias("n"))


def savings(per_level: DataFrame, expand_rate: float = 0.2) -> DataFrame:
    """One row: the cost of summaries with a share expanded in full, and what it saves over full texts in percent."""
    t = per_level.groupBy().pivot("level", ["summary", "full"]).agg(F.first("total"))
    blend = F.col("summary") + F.col("full") * expand_rate
    return t.select(blend.alias("blend"), F.when(F.col("full") > 0, (1 - blend / F.col("full")) * 100).otherwise(0.0).alias("saving_percent"))


def level_tokens(results: DataFrame) -> DataFrame:
    """``query_id, level, tokens`` of ranked results (``query_id, content, summary``) at the three levels."""
    from tesserae.operators.search import detail

    shown = [F.struct(F.lit(k).alias("level"), X.tokens_ceil(detail(k)).alias("tokens")) for k in ("summary", "snippet", "full")]
    rows = results.select("query_id", F.explode(F.array(*shown)).alias("x"))
    return rows.groupBy("query_id", "x.level").agg(F.sum("x.tokens").alias("tokens"))


def session_report(transcripts: DataFrame, hooks: DataFrame, drifts: DataFrame) -> DataFrame:
    """Everything known of each session: a full join of transcripts and hook counters, left with drift."""
    return transcripts.join(hooks, "session", "full").join(drifts, "session", "left")


def number_turns(df: DataFrame, by: str = "session", order: str = "ts") -> DataFrame:
    return df.withColumn("turn_idx", F.row_number().over(W.partitionBy(by).orderBy(order)) - 1)
