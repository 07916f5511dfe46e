"""Retention, the result cache, and suppression and reminder rules in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators.ordered import split
from tesserae.sources.shared import cut

DAY = 86_400
ACTIVE_DAYS, ARCHIVE_DAYS, MOST_CHUNKS = 30, 90, 10_000
STALE_SECONDS = 1800
MARK = "... [archived]"
CACHE_BYTES = 32 * 1024


def _subject() -> Column:
    """Neither code nor memory; an unknown kind or source is exempt (three-valued logic)."""
    return ~F.col("source_type").isin("code") & (F.col("kind") != "memory")


def archive(chunks: DataFrame, now: int, active: int = ACTIVE_DAYS, keep: int = ARCHIVE_DAYS) -> DataFrame:
    """Texts not read for ``active`` days but within ``keep`` are cut to 200 characters."""
    t = F.col("last_accessed")
    due = (t > 0) & (t < now - active * DAY) & (t >= now - keep * DAY) & _subject() & (F.length("content") > 200)
    return chunks.withColumn("content", F.when(due, F.concat(F.substring("content", 1, 200), F.lit(MARK))).otherwise(F.col("content")))


def prune(chunks: DataFrame, now: int, keep: int = ARCHIVE_DAYS) -> DataFrame:
    t = F.col("last_accessed")
    return chunks.where(~F.coalesce((t > 0) & (t < now - keep * DAY) & _subject(), F.lit(False)))


def cap(chunks: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """At most ``most`` rows: the ones read longest ago go, never-read ones first (ties by id); exempt ones stay.

    What goes lies before the key of the last one to go, found by counts
    (:func:`tesserae.operators.ordered.split`): no task sorts what goes.
    """
    if most <= 0:
        return chunks
    excess = chunks.count() - most
    if excess <= 0:
        return chunks
    subject = F.coalesce(_subject(), F.lit(False))
    return chunks.where(~subject).unionByName(split(chunks.where(subject), excess, "last_accessed", "id")[1])


def run(chunks: DataFrame, now: int, active: int = ACTIVE_DAYS, keep: int = ARCHIVE_DAYS, most: int = MOST_CHUNKS) -> DataFrame:
    """Archive, prune, cap, in this order."""
    return cap(prune(archive(chunks, now, active, keep), now, keep), most)


def cache_put(cache: DataFrame, new: DataFrame, now: int, ttl: int = 0, most: int = 0) -> DataFrame:
    """The cache after ``new`` (``key, stdout``): replaced rows start at 0 hits; over 32 KB is refused; the old and the oldest excess go.

    Of several new rows of one key the last counts, by ``ordinal`` if there is such a
    column, else the greatest text.
    """
    place = F.struct("ordinal", "stdout") if "ordinal" in new.columns else F.struct("stdout")
    fine = new.where(F.octet_length("stdout") <= CACHE_BYTES).groupBy("key").agg(F.max_by("stdout", place).alias("stdout"))
    fine = fine.select("key", "stdout", F.lit(now).cast("bigint").alias("created_at"), F.lit(0).cast("bigint").alias("hit_count"))
    all_ = cache.join(fine.select("key"), "key", "left_anti").unionByName(fine)
    if ttl > 0:
        all_ = all_.where(F.col("created_at") >= now - ttl)
    if most <= 0:
        return all_
    all_ = cut(all_)  # read several times below
    return split(all_, max(0, all_.count() - most), "created_at", "key")[1]


def cache_get(cache: DataFrame, keys: DataFrame, now: int, ttl: int = 0) -> DataFrame:
    """Rows of ``keys`` no older than ``ttl`` (0: any age)."""
    found = cache.join(keys.select("key").distinct(), "key", "left_semi")
    return found.where(F.lit(now) - F.col("created_at") <= ttl) if ttl > 0 else found


def cache_hit(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """``cache`` with its hit counters raised by the reads in ``keys``."""
    n = keys.groupBy("key").agg(F.count("*").alias("_n"))
    return cache.join(n, "key", "left").withColumn("hit_count", F.col("hit_count") + F.coalesce("_n", F.lit(0))).drop("_n").select(*cache.columns)


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("stdout")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("hits"))


def _last_emits(times, window: int):
    """For each of some ascending times: the last that emits if it is the first one to."""
    import numpy as np

    to = np.searchsorted(times, times + window)
    end = np.where(to < len(times), to, np.arange(len(times)))
    while (end[end] != end).any():  # pointers doubled: every round halves the way that is left
        end = end[end]
    return end


def _steps(times, window: int) -> list[tuple[int, int]]:
    """How a range goes on for a key that entered it: (``upto``, ``exit``), ascending.

    If the next to emit has to be at ``t`` or later, the first step with ``upto >= t``
    has the last time that emits here; beyond all steps none does.
    """
    import numpy as np

    end = _last_emits(times, window)
    most = min(len(times), int(np.searchsorted(times, times[0] + window)) + 1)  # what emitted before lies before the first time
    change = np.flatnonzero(np.append(np.diff(end[:most]) != 0, True))
    return [(int(times[i]), int(times[end[i]])) for i in change]


def suppress(events: DataFrame, window: int) -> DataFrame:
    """``project, code, ts, emit``: the first event of a key emits, and again each time ``window`` seconds have passed since the last that did.

    All events lie in one order by key and time, cut into ranges, so a key with any
    number of events spreads over tasks.  Only the key that a range begins with
    depends on the range before, and only by the last time that emitted there.  So a first pass
    tells for each range how its first key goes on from any such time, a few steps; these are
    chained key by key, which gives each range the time it is entered with; a second
    pass over the ranges gives the rows, with one number in memory.  The first pass holds the
    times of one key in one range.  Rows without a time are dropped; of rows of equal
    key and time one emits at most.
    """
    import pyarrow as pa

    if window <= 0:
        return events.where("ts is not null").select("project", "code", F.col("ts").cast("bigint").alias("ts"), F.lit(True).alias("emit"))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.where("ts is not null").select("project", "code", F.col("ts").cast("bigint").alias("ts"))
    rows = rows.repartitionByRange(parts, "project", "code", "ts").sortWithinPartitions("project", "code", "ts")
    rows = cut(rows.withColumn("part", F.spark_partition_id()))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("project", "code"))

    def keys(batch):
        """The keys of a batch, each with its times."""
        p, c = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        starts = [0, *(i for i in range(1, len(p)) if p[i] != p[i - 1] or c[i] != c[i - 1])]
        return [(p[i], c[i], batch.column(2)[i:j].to_numpy(zero_copy_only=False)) for i, j in zip(starts, [*starts[1:], len(p)], strict=True)] if p else []

    def told(batches):
        import numpy as np

        first = now = part = None
        held: list = []
        out: list = []
        steps = lambda key: [(*key, part, upto, end) for upto, end in _steps(np.concatenate(held), window)]
        for b in batches:
            for p, c, times in keys(b):
                part = b.column(3)[0].as_py()
                if (p, c) != now:
                    if now is not None and now == first:
                        out = steps(now)
                    first, now, held = first or (p, c), (p, c), []
                held.append(times)
        if now is not None:
            out += steps(now)  # of the last key, which may go on in the next range
            columns = zip(*out, strict=True)
            types = (b.schema.field(0).type, b.schema.field(1).type, pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["project", "code", "part", "upto", "exit"])

    def chained(batches):
        key = part = None
        last = entered = None
        settled = False
        for b in batches:
            out: list = []
            for p, c, k, upto, end in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (p, c) != key:
                    key, part, last = (p, c), None, None
                if k != part:
                    part, entered, settled = k, last, False
                    if entered is not None:
                        out.append((k, entered))
                if not settled and (entered is None or upto >= entered + window):
                    last, settled = end, True
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in ((0, pa.int32()), (1, pa.int64()))], names=["part", "entered"])

    steps = rows.mapInArrow(told, f"{kinds}, part int, upto bigint, exit bigint")
    ways = steps.repartition("project", "code").sortWithinPartitions("project", "code", "part", "upto").mapInArrow(chained, "part int, entered bigint")
    # a part is entered by the key that it begins with: one number a range
    begins = dict(map(tuple, ways.collect()))

    def judged(batches):
        now, last = None, None
        for b in batches:
            emit: list = []
            for p, c, times in keys(b):
                if (p, c) != now:
                    last = begins.get(b.column(3)[0].as_py()) if now is None else None
                    now = (p, c)
                for t in times.tolist():
                    emits = last is None or t - last >= window
                    last = t if emits else last
                    emit.append(emits)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(emit, pa.bool_())], names=["project", "code", "ts", "emit"])

    return rows.mapInArrow(judged, f"{kinds}, ts bigint, emit boolean")


def nag(turns: DataFrame, every: int = 5) -> DataFrame:
    """``turns`` (``session, turn, had_call``) with ``since`` (turns since the last direct call) and ``fires``: gaps and islands."""
    w = W.partitionBy("session").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    island = turns.withColumn("_i", F.sum(F.when(F.col("had_call"), 1).otherwise(0)).over(w))
    inside = W.partitionBy("session", "_i").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    since = F.sum(F.when(F.col("had_call"), 0).otherwise(1)).over(inside)
    return island.withColumn("since", since).withColumn("fires", (F.col("since") > 0) & (F.col("since") % every == 0)).drop("_i")


def pending(queue: DataFrame, most: int = 1000) -> DataFrame:
    """The last ``most`` queued edits (``seq, path``), each path once at its first place."""
    last = queue.orderBy(F.col("seq").desc()).limit(most)
    return last.groupBy("path").agg(F.min("seq").alias("seq")).orderBy("seq")


def dead_letters(current: DataFrame, snapshot: DataFrame, survivors: DataFrame) -> DataFrame:
    """Current entries less the snapshot, and the survivors of its retry."""
    return current.join(snapshot.select("file", "ts"), ["file", "ts"], "left_anti").unionByName(survivors)


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the speed so far; null before the first item."""
    return F.when((done > 0) & (elapsed > 0), (total - done) * elapsed / done)


def index_stale(last_modified: Column, now: int, after: int = STALE_SECONDS) -> Column:
    """Whether an index is due for another run; one that never was written isn't."""
    return (F.coalesce(last_modified, F.lit(0)) != 0) & (F.lit(now) - last_modified > after)
