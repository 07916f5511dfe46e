"""Periodic runs of words: a Lyndon stack scanned right to left under both orders.

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are the
same) that no neighbouring word extends.  By the runs theorem its period is the
length of the longest Lyndon word that starts somewhere in it, under the order of
the words or under the reverse one.  For each order a text is read from right to
left with a stack of where the Lyndon words that follow begin: the word at ``i`` ends
where the first smaller suffix begins.  Suffixes are compared by their longest
common extension, found by words first, then by binary search over prefix hashes (a
polynomial modulo ``2**61 - 1``), and what the hashes say is verified on the words
themselves; so is how far a run reaches to both sides.  No suffix array is built.

Before the stack a text is cut at words that can't lie in a run that is asked for.
A run of ``least`` periods and of length ``L`` has each of its words again within
``L / least`` words, so a word without such a neighbour, ``L`` being what is left
between two cuts, is another cut.  This loses no run and leaves little of prose.

Each text is read by itself, in one row of one task; Spark spreads the rows, and
nothing is shuffled.  Memory is a few lists as long as the longest text.

Edge cases: a null text and one without words have no runs, and an empty rest;
texts of any length are read whole; ties between runs go to the smaller start, then
period; repeated rows repeat, a null id is an id like any other, an empty table
gives no rows, and other columns pass through by ``keep`` whatever their names.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 6
LEAST_PERIODS = 4
#: So many words are compared one by one before hashes are asked.
BY_WORD = 8
PRIME = (1 << 61) - 1
BASE = 0x1F3D5B79A8C6E4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(words: list[bytes]) -> list[int]:
    """A number for each word, equal for equal words."""
    known: dict[bytes, int] = {}
    return [known.setdefault(w, len(known)) for w in words]


def stretches(ids, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """Where runs can be: (start, end) of stretches, each run of the lengths asked for whole in one."""
    import numpy as np

    a = np.asarray(ids, "i8")
    n = len(a)
    if n < least_length:
        return []
    order = np.argsort(a, kind="stable")
    gap = np.diff(order)
    gap[a[order[1:]] != a[order[:-1]]] = n
    near = np.full(n, n)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    bounds = np.array([[0, n]])
    while len(bounds):
        sizes = bounds[:, 1] - bounds[:, 0]
        inside = np.repeat(sizes // least_periods, sizes)
        at = np.arange(sizes.sum()) + np.repeat(bounds[:, 0] - np.cumsum(sizes) + sizes, sizes)
        fine = near[at] <= inside
        if fine.all():
            break
        edge = np.ones(len(at) + 1, bool)  # between two places: not neighbours
        edge[1:-1] = np.diff(at) > 1
        edge[np.cumsum(sizes)[:-1]] = True
        left, right = fine & (edge[:-1] | ~np.concatenate(([False], fine[:-1]))), fine & (edge[1:] | ~np.concatenate((fine[1:], [False])))
        bounds = np.stack((at[left], at[right] + 1), axis=1)
        bounds = bounds[bounds[:, 1] - bounds[:, 0] >= least_length]
    return [tuple(x) for x in bounds.tolist()]


class Extensions:
    """Longest common extensions of a sequence of small numbers, by prefix hashes verified on the numbers."""

    _powers = [1]

    def __init__(self, ids: list[int]):
        self.ids, self.n = ids, len(ids)
        self.raw = memoryview(b"".join(x.to_bytes(4, "little") for x in ids))
        self.hashes: list[int] | None = None
        #: for each shift the last span [lo, hi) that is known to equal itself so far on
        self.known: dict[int, tuple[int, int]] = {}

    def _prepare(self) -> None:
        powers = Extensions._powers
        while len(powers) <= self.n:
            powers.append(powers[-1] * BASE % PRIME)
        self.hashes = list(accumulate(self.ids, lambda h, x: (h * BASE + x + 1) % PRIME, initial=0))

    def _same(self, i: int, j: int, size: int) -> bool:
        """By hash: do ``size`` words from ``i`` and from ``j`` agree?"""
        h, p = self.hashes, Extensions._powers[size]
        return (h[i + size] - h[i] * p - h[j + size] + h[j] * p) % PRIME == 0

    def _verified(self, i: int, j: int, size: int) -> bool:
        """By word; what a shift has shown before isn't read again."""
        d = j - i
        lo, hi = self.known.get(d, (0, 0))
        if lo <= i and i + size <= hi:
            return True
        a, b = i, i + size
        joined = lo < hi and a <= hi and lo <= b
        todo = [(a, min(b, lo)), (max(a, hi), b)] if joined else [(a, b)]
        for x, y in todo:
            if x < y and self.raw[4 * x : 4 * y] != self.raw[4 * (x + d) : 4 * (y + d)]:
                return False
        self.known[d] = (min(a, lo), max(b, hi)) if joined else (a, b)
        return True

    def _search(self, most: int, agree) -> int:
        """The largest size up to ``most`` that agrees; ``agree`` holds for all below it."""
        lo, hi = BY_WORD, most
        step = 2 * BY_WORD
        while lo + step < hi and agree(lo + step):  # gallop, then halve
            lo += step
            step *= 2
        hi = min(hi, lo + step)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if agree(mid):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def right(self, i: int, j: int) -> int:
        """How many words from ``i`` on equal those from ``j`` on (``i < j``)."""
        ids, most = self.ids, self.n - j
        for k in range(min(most, BY_WORD)):
            if ids[i + k] != ids[j + k]:
                return k
        if most <= BY_WORD:
            return most
        lo, hi = self.known.get(j - i, (0, 0))
        if lo <= i + BY_WORD <= hi and (hi + j - i == self.n or ids[hi] != ids[hi + j - i]):
            self.known[j - i] = (min(i, lo), hi)
            return hi - i
        if self.hashes is None:
            self._prepare()
        size = self._search(most, lambda s: self._same(i, j, s))
        if self._verified(i, j, size):
            return size
        return self._search(most, lambda s: self.raw[4 * i : 4 * (i + s)] == self.raw[4 * j : 4 * (j + s)])

    def left(self, i: int, j: int) -> int:
        """How many words before ``i`` equal those before ``j`` (``i < j``)."""
        ids, most = self.ids, i
        for k in range(min(most, BY_WORD)):
            if ids[i - 1 - k] != ids[j - 1 - k]:
                return k
        if most <= BY_WORD:
            return most
        if self.hashes is None:
            self._prepare()
        size = self._search(most, lambda s: self._same(i - s, j - s, s))
        if self._verified(i - size, j - size, size):
            return size
        return self._search(most, lambda s: self.raw[4 * (i - s) : 4 * i] == self.raw[4 * (j - s) : 4 * j])


def lyndon_runs(ids: list[int], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence that are long enough (``least_periods`` is 2 at least)."""
    n = len(ids)
    found: set[tuple[int, int, int]] = set()
    reach = Extensions(ids)
    for ascending in (True, False):
        follows = [n] * (n + 1)  # the stack, as links: where the first smaller suffix begins
        last: dict[int, tuple[int, int]] = {}  # the last run of a period: its start and end
        for i in range(n - 1, -1, -1):
            j, x = i + 1, ids[i]
            while j < n:
                y = ids[j]
                if x == y:
                    k = reach.right(i, j)
                    if j + k == n:  # what ends first is smaller, under both orders
                        break
                    smaller = (ids[i + k] < ids[j + k]) == ascending
                else:
                    smaller = (x < y) == ascending
                if not smaller:
                    break
                j = follows[j]
            follows[i] = j
            period = j - i
            if j == n or x != ids[j]:
                continue
            start, end = last.get(period, (0, 0))
            if start <= i and j < end:
                continue
            end, start = j + reach.right(i, j), i - reach.left(i, j)
            last[period] = (start, end)
            if end - start >= max(least_length, least_periods * period):
                found.add((start, end - start, period))
    return found


def runs_of(ids: list[int], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All runs of a whole text that are long enough, by start, then period."""
    found = []
    for a, b in stretches(ids, least_length, least_periods):
        found += [(a + s, length, p) for s, length, p in lyndon_runs(ids[a:b], least_length, least_periods)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    dropped = bytearray(len(words))
    for start, length, period in runs:
        dropped[start + period : start + length] = b"\x01" * (length - period)
    return b" ".join([w for w, gone in zip(words, dropped, strict=True) if not gone])


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """The columns of ``keep`` (``doc_id``), ``runs`` (by start, then period) and ``collapsed``, the text without repeated periods."""
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    keep = ["doc_id"] if keep is None else keep
    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            runs, rest = [], []
            for t in b.column(b.num_columns - 1):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space only
                found = runs_of(numbered(words), least_length, least_periods)
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                rest.append(collapsed(words, found))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(runs, kind), pa.array(rest, pa.string())], names=[*b.schema.names[:-1], "runs", "collapsed"])

    have = [f"k{i} {narrow.schema[i].dataType.simpleString()}" for i in range(len(keep))]
    found = narrow.mapInArrow(run, ", ".join([*have, f"runs {RUNS}", "collapsed string"]))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "runs", "collapsed")


def longest(runs):
    """Of a column ``runs`` the one with the greatest exact length/period (ties: smallest start, then period); null without runs."""
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda best, r: F.when(best.isNull() | more(r, best), r).otherwise(best))
