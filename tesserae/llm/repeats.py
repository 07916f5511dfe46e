"""Substring dedup: seed and extend.

A passage repeats where ``length`` consecutive words of one document also stand in a
document with a smaller id.  Such a word sequence is a window.

*Seeds.*  Of the ``length - seed + 1`` sequences of ``seed`` words in a window, the one
with the least hash is the window's anchor (winnowing): about one place in sixteen.
Equal windows choose equal anchors, so documents that share a window meet on one.
Anchors that occur in one document only go before anything else is shuffled.

*Extension.*  Around an anchor a document's context is all words that windows over
the anchor can hold.  Occurrences with equal contexts fall into one class, so a
thousand copies are one row; all but the class's least document have the whole context
removed.  For the least document, a seed extends ``o`` words to the left and
the rest of the window to the right: for each ``o`` the class states the window that
it then has, and the least document that states the same window, equal on both sides,
decides whether it is repeated.  The widest extension to either side, over
all ``o``, bounds a *maximal repeat*: all windows over one anchor hold the anchor, so
their union is one span.  Overlapping spans of a document are joined.  That takes
``length - seed + 1`` rows for a class, however many others share the anchor: no
pairs within an anchor's group, no cap on it.

Windows are told apart by two hashes of 64 bits (the anchor's and their own).

Edge cases: a null text has no words; a document shorter than a window loses
nothing; windows repeated within one document, or in documents of equal id, are no
repeats; a null id is neither smaller nor larger than any other, so such rows stay
whole; repeated rows repeat in the result, alike; an empty table gives no rows; texts
of any length are read whole; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, staged

LENGTH = 50
SEED = 20
#: Seeds of the hashes of anchors and windows, and the factor of the rolling hash (odd).
ANCHOR, WINDOW, FACTOR = 1, 2, 0x9E3779B97F4A7C15
#: Windows that are winnowed at a time.
SLICE = 1 << 15
#: Words whose hashes a task remembers.
REMEMBERED = 1 << 18


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only


class Words:
    """Hashes of words, remembered between texts."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]):
        import numpy as np
        import xxhash

        of, known = xxhash.xxh3_64_intdigest, self.known
        if len(known) > REMEMBERED:
            known.clear()
        out = [known.get(w) for w in words]
        for i, h in enumerate(out):
            if h is None:
                out[i] = known[words[i]] = of(words[i])
        return np.array(out, "u8")


def anchors(hashes, length: int = LENGTH, seed: int = SEED) -> list[int]:
    """Where the anchors of all windows begin, given the hashes of a text's words."""
    import numpy as np

    n, per = len(hashes), length - seed + 1
    if n < length:
        return []
    powers, back = _powers(n)
    sums = np.concatenate((np.zeros(1, "u8"), np.cumsum(hashes * powers[:n], dtype="u8")))
    grams = (sums[seed:] - sums[:-seed]) * back[: n - seed + 1]
    grams ^= grams >> np.uint64(32)  # the low bits of sums modulo 2**64 are weak
    grams *= np.uint64(FACTOR)
    grams ^= grams >> np.uint64(29)
    found = []
    for at in range(0, len(grams) - per + 1, SLICE):
        view = np.lib.stride_tricks.sliding_window_view(grams[at : at + SLICE + per - 1], per)
        found.append(np.unique(view.argmin(axis=1) + np.arange(at, at + len(view))))
    return np.unique(np.concatenate(found)).tolist()


_grown: list = []


def _powers(n: int):
    """Powers of the factor and of its inverse, modulo 2**64."""
    import numpy as np

    if not _grown or len(_grown[0]) < n:
        size = max(1 << 12, 1 << n.bit_length())
        one = lambda f: np.cumprod(np.full(size, f, "u8"), dtype="u8") * np.uint64(pow(f, -1, 1 << 64))
        _grown[:] = [one(FACTOR), one(pow(FACTOR, -1, 1 << 64))]
    return _grown


def _starts(words: list[bytes]) -> list[int]:
    """Where words begin in the line that joins them by one byte."""
    return [0, *accumulate(len(w) + 1 for w in words)]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def occurrences(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``id, h, text`` -> ``id, h, anchor, context, place, before, after``: an anchor's place, and the words around it."""
    arm = length - seed
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        import xxhash

        of, memory = xxhash.xxh3_64_intdigest, Words()
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for r, text in enumerate(b.column(2)):
                words = split(text.as_py())
                if len(words) < length:
                    continue
                line, starts = b" ".join(words), _starts(words)
                for p in anchors(memory.hashes(words), length, seed):
                    before, after = min(arm, p), min(arm, len(words) - p - seed)
                    context = of(line[starts[p - before] : starts[p + seed + after] - 1], before)
                    anchor = of(line[starts[p] : starts[p + seed] - 1], ANCHOR)
                    for to, x in zip(rows, (r, _signed(anchor), _signed(context), p, before, after), strict=True):
                        to.append(x)
            at = pa.array(rows[0], pa.int64())
            ids = [b.column(c).take(at) for c in (0, 1)]
            rest = [pa.array(x, t) for x, t in zip(rows[1:], (pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16()), strict=True)]
            yield pa.RecordBatch.from_arrays([*ids, *rest], names=["id", "h", "anchor", "context", "place", "before", "after"])

    return docs.select("id", "h", "text").mapInArrow(run, f"id {kind}, h bigint, anchor bigint, context bigint, place int, before smallint, after smallint")


def windows(rows: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``id, text, wanted`` -> ``id, anchor, context, shift, window``: all windows over the anchors of ``wanted``."""
    arm = length - seed
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import xxhash

        of = xxhash.xxh3_64_intdigest
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for r, (text, wanted) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                words = split(text.as_py())
                line, starts = b" ".join(words), _starts(words)
                for w in wanted.as_py():
                    p = w["place"]
                    for shift in range(max(0, arm - w["after"]), min(arm, w["before"]) + 1):
                        name = of(line[starts[p - shift] : starts[p - shift + length] - 1], WINDOW)
                        for to, x in zip(out, (r, w["anchor"], w["context"], shift, _signed(name)), strict=True):
                            to.append(x)
            rest = [pa.array(x, t) for x, t in zip(out[1:], (pa.int64(), pa.int64(), pa.int16(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out[0], pa.int64())), *rest], names=["id", "anchor", "context", "shift", "window"])

    return rows.select("id", "text", "wanted").mapInArrow(run, f"id {kind}, anchor bigint, context bigint, shift smallint, window bigint")


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Maximal repeats: ``id, h`` (the text's hash) ``, start, stop`` of words that a smaller document has as well, one row an anchor."""
    if not 0 < seed <= length:
        raise ValueError("a seed has a word at least, and fits into a window")
    arm = length - seed
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).where("id is not null")
    places = staged(occurrences(rows, length, seed), "repeats-places")
    ends = lambda of: [F.min(of).alias("least"), F.max(of).alias("most")]
    # what is joined below is written first: then both sides of a join are plain shuffles, of which Spark splits hot keys
    shared = cut(places.groupBy("anchor").agg(*ends("id")).where("least < most").select("anchor"))
    seeded = staged(places.join(shared, "anchor", "left_semi"), "repeats-seeded")
    classes = cut(seeded.groupBy("anchor", "context").agg(F.min(F.struct("id", "h", "place", "before", "after")).alias("first")))
    groups = cut(classes.groupBy("anchor").agg(*ends("first.id")).where("least < most").select("anchor"))
    several = classes.join(groups, "anchor", "left_semi").where(F.col("first.before") + F.col("first.after") >= arm)
    wanted = several.select("first.*", "anchor", "context").groupBy("id", "h").agg(F.collect_list(F.struct("anchor", "context", "place", "before", "after")).alias("wanted"))
    stated = staged(windows(rows.dropDuplicates(["id", "h"]).join(wanted, ["id", "h"]), length, seed), "repeats-windows")
    least = cut(stated.groupBy("anchor", "window").agg(*ends("id")).where("least < most").select("anchor", "window", "least"))
    wide = stated.join(least, ["anchor", "window"]).where("id > least").groupBy("anchor", "context").agg(F.min("shift").alias("low"), F.max("shift").alias("high"))
    fates = cut(classes.select("anchor", "context", F.col("first.id").alias("least")).join(wide, ["anchor", "context"], "left"))
    found = seeded.join(fates, ["anchor", "context"])
    whole = (F.col("id") > F.col("least")) & (F.col("before") + F.col("after") >= arm)
    left, right = F.when(whole, F.col("before")).otherwise(F.col("high")), F.when(whole, F.col("after")).otherwise(arm - F.col("low"))
    return found.where(whole | F.col("high").isNotNull()).select("id", "h", (F.col("place") - left).alias("start"), (F.col("place") + seed + right).alias("stop"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the other words, joined by one space) and ``repeats``, the spans taken out."""
    found = spans(docs, text, doc_id, length, seed).groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    joined = rows.join(found, ["id", "h"], "left").select("id", "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    list_of = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, found in zip(b.column(1), b.column(2), strict=True):
                words, merged = split(text.as_py()), []
                for s in found.as_py() or []:
                    if merged and s["start"] <= merged[-1]["stop"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], s["stop"])
                    else:
                        merged.append(s)
                kept, at = [], 0
                for s in merged:
                    kept += words[at : s["start"]]
                    at = s["stop"]
                kept += words[at:]
                for to, x in zip(out, (len(words), len(words) - len(kept), b" ".join(kept), merged), strict=True):
                    to.append(x)
            rest = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.string(), list_of), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *rest], names=["id", "n_words", "n_removed", "kept", "repeats"])

    done = joined.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept string, repeats array<struct<start:bigint,stop:bigint>>")
    return done.withColumnRenamed("id", doc_id)
