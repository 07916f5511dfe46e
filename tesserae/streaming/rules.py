"""Stateful rules on streams: suppression, reminders, debounce, retries, buffers.

Each is a keyed state machine in ``applyInPandasWithState``: state is a few
numbers a key, kept in the session's state store, checkpointed by the query and
rebuilt where an executor is lost.  Batches of a key come in any order, so a rule
that needs order sorts its rows of the micro-batch first.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tesserae.sources import growing

IDLE_MS = 48 * 3600 * 1000
MOST_ATTEMPTS = 10
BUFFER_BYTES = 2 * 1024 * 1024


def suppress(events: DataFrame, window: int) -> DataFrame:
    """``project, code, ts, emit`` of a stream: see :func:`tesserae.operators.lifecycle.suppress`."""

    def step(key, batches, state):
        rows = sorted(t for pdf in batches for t in pdf["ts"].tolist())
        last = state.get[0] if state.exists else None
        out = []
        for t in rows:
            emit = last is None or t - last >= window
            last = t if emit else last
            out.append((*key, t, emit))
        state.update((last,))
        yield pd.DataFrame(out, columns=["project", "code", "ts", "emit"])

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.groupBy("project", "code").applyInPandasWithState(step, f"project {kinds['project']}, code {kinds['code']}, ts bigint, emit boolean", "last bigint", "append", GroupStateTimeout.NoTimeout)


def nag(turns: DataFrame, every: int = 5) -> DataFrame:
    """``session, turn, since, fires``: a reminder each ``every`` turns without a direct call."""

    def step(key, batches, state):
        rows = sorted((t, c) for pdf in batches for t, c in zip(pdf["turn"].tolist(), pdf["had_call"].tolist()))
        since = state.get[0] if state.exists else 0
        out = []
        for t, called in rows:
            since = 0 if called else since + 1
            out.append((*key, t, since, bool(since and since % every == 0)))
        state.update((since,))
        yield pd.DataFrame(out, columns=["session", "turn", "since", "fires"])

    kind = turns.schema["session"].dataType.simpleString()
    return turns.groupBy("session").applyInPandasWithState(step, f"session {kind}, turn bigint, since bigint, fires boolean", "since bigint", "append", GroupStateTimeout.NoTimeout)


def attempts(failures: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """``file, attempt, dropped``: failed files by their number of tries; at ``most`` a file is dropped and forgotten."""

    def step(key, batches, state):
        n = state.get[0] if state.exists else 0
        out = []
        for pdf in batches:
            for ok in pdf["ok"].tolist():
                n = 0 if ok else n + 1
                out.append((*key, n, n >= most))
                n = 0 if n >= most else n
        if n:
            state.update((n,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["file", "attempt", "dropped"])

    return failures.groupBy("file").applyInPandasWithState(step, "file string, attempt int, dropped boolean", "n int", "append", GroupStateTimeout.NoTimeout)


def buffers(lines: DataFrame, most: int = BUFFER_BYTES, idle_ms: int = IDLE_MS) -> DataFrame:
    """``session, text``: a session's lines (``session, ts, line, ended``), its last ``most`` bytes, given out at its end; idle ones are swept."""

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session": [], "text": []})
            return
        text, ended = state.get[0] if state.exists else "", False
        for pdf in batches:
            for line, end in zip(pdf.sort_values("ts")["line"].tolist(), pdf.sort_values("ts")["ended"].tolist()):
                text, ended = text + line + "\n", ended or bool(end)
        raw = text.encode()
        text = raw[-most:].decode("utf-8", "ignore") if len(raw) > most else text
        if ended:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"session": [key[0]], "text": [text]})
        else:
            state.update((text,))
            state.setTimeoutDuration(idle_ms)
            yield pd.DataFrame({"session": [], "text": []})

    return lines.groupBy("session").applyInPandasWithState(step, "session string, text string", "text string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def debounced(edits: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """``project, start, paths``: a project's edits (``project, path, ts``) until a pause of ``gap``, each path once.

    The pause counts from the last edit; :func:`debounced_from_first` waits a fixed time from the first one.
    """
    w = edits.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "project")
    return w.agg(F.array_sort(F.collect_set("path")).alias("paths")).select("project", F.col("session_window.start").alias("start"), "paths")


def debounced_from_first(edits: DataFrame, wait: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """``project, start, paths``: a project's edits (``project, path, ts``) within ``wait`` of the first one, each path once.

    The next edit after that is a first one again.  A key's state holds the edits
    that the watermark has not passed by ``wait`` yet, so the groups do not depend
    on the order in which edits within ``late`` come in.
    """
    wait_us = int(pd.Timedelta(wait) / pd.Timedelta(microseconds=1))

    def step(key, batches, state):
        held = [pd.DataFrame(dict(zip(["at", "path"], state.get)))] if state.exists else []
        if not state.hasTimedOut:
            held += [pdf[["at", "path"]] for pdf in batches]
        held = pd.concat(held).drop_duplicates().sort_values("at")
        at, path = held["at"].to_numpy(), held["path"].to_numpy()
        out, lo, passed = [], 0, state.getCurrentWatermarkMs() * 1000
        while lo < len(at) and at[lo] + wait_us <= passed:
            hi = int(at.searchsorted(at[lo] + wait_us))
            out.append((*key, int(at[lo]), sorted(set(path[lo:hi]))))
            lo = hi
        if lo < len(at):
            state.update((at[lo:].tolist(), path[lo:].tolist()))
            state.setTimeoutTimestamp((int(at[lo]) + wait_us) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["project", "start", "paths"])

    kind = edits.schema["project"].dataType.simpleString()
    rows = edits.withWatermark("ts", late).where("ts is not null").select("project", "path", "ts", F.unix_micros("ts").alias("at"))
    groups = rows.groupBy("project").applyInPandasWithState(step, f"project {kind}, start bigint, paths array<string>", "at array<bigint>, path array<string>", "append", GroupStateTimeout.EventTimeTimeout)
    return groups.withColumn("start", F.timestamp_micros("start"))


def reindex(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str):
    """Feed each micro-batch of edited files and its number to ``run``; the checkpoint takes the place of a resume marker.

    After an interruption a query with the same checkpoint gives the batch that was
    under way again, with its number and its rows, and then the rest; so what ``run`` leaves
    should be replaced by number.
    """
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(spark, folder: str, pattern: str = "*") -> DataFrame:
    """``value``: the lines of a folder of growing logs, through appends, truncation and rotation; see :mod:`tesserae.sources.growing`."""
    return growing.lines(spark, folder, pattern).select("value")


#: Rows of a part of a replay that goes by time.
PART = 1 << 20


def replay(spark, df: DataFrame, transform: Callable[[DataFrame], DataFrame], folder: str, files: int = 2, by: str | None = None) -> DataFrame:
    """Run ``transform`` as a stream over ``df`` (written to ``folder`` in ``files`` parts) to its end; the result as a table.

    The parts hold the rows in the order of ``df`` and come one after another in it: a part that was written
    late, or is read out of turn behind a row that moves the watermark on, would lose its rows as late ones.
    With ``by``, a time, they hold the rows in its order instead, rows of one time in one part: then none is late however soon the watermark
    follows, and state need only hold what it has not passed.
    """
    rows = df.repartitionByRange(files, by).sortWithinPartitions(by) if by else df.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(files, "__at").sortWithinPartitions("__at").drop("__at")
    rows.write.mode("overwrite").parquet(f"{folder}/in")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/in")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f for f in store.listStatus(path) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    first = max((f.getModificationTime() for f in parts), default=0) - 1000 * len(parts)
    for k, f in enumerate(parts):  # a stream of files goes by their times
        store.setTimes(f.getPath(), first + 1000 * k, -1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    q = transform(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")
