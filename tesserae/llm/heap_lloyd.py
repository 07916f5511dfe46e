"""Vector code compression: product codes whose codebooks are fitted by heap Lloyd.

Every component ``x`` becomes the integer ``floor(scale * x)`` and every vector is
cut into equal parts.  The codebook of a part position starts as that part of the
vectors with the smallest ids; each round assigns every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and moves each entry to the
componentwise ``floor(sum / count)`` of its parts.

The rows lie in blocks of a fixed size, one Parquet row each, made where the rows
are read: nothing is shuffled but sums.  A block holds a heap for each part
position and entry with the block's parts assigned there.  A part's key is the
lower bound of the distance to its second-nearest entry minus the upper bound of
the distance to its own, plus the drift that the entry had gathered by then.  When
entries move, an entry's drift grows by its own way plus the longest way of any
other.  As long as a key exceeds its entry's drift, the part can't have a nearer
entry; so a round pops keys off the top until one does, scans what it popped
exactly and pushes it where it belongs.  Parts further down aren't touched.

A round reads the blocks of the last one from the shared folder, and writes its own;
lost executors cost a task.  With the blocks goes one row a task: sums and counts of
what moved from entry to entry.  Spark adds these up; the driver gets an entry's sum
and count, ``entries x dimension`` numbers whatever the number of rows, and sends the
codebooks back with the next round's tasks.  All sums are of integers, so neither
partitioning nor reruns change a result.

Distances are exact: in 32 or 64 bit floating point where the largest component
shows that they fit, else in Python's integers (slow).

Edge cases: rows whose vector is null or has null or non-finite components are
dropped, and so are vectors whose length isn't that of the first kept vector (by id)
or no positive multiple of ``parts``, and those with a component whose integer is
beyond 62 bits.  A null id comes after all others; equal ids are ordered by their
vectors; repeated rows repeat in the result.  With fewer rows than ``entries`` the
codebook has as many entries as rows; without any there are no rows and no entries.
An error beyond 64 bits is null.  Other columns pass through by ``keep`` whatever
their names.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import cut, drop_staged, staged

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Rows of a block.
BLOCK = 4096
#: Relative part of a key that is given away for rounding.
SLACK = 1e-9
#: Largest absolute value of a component's integer.
LARGEST = 1 << 62


@dataclass
class Codebooks:
    """``entries``: for each part position a matrix of integers, one row an entry."""

    entries: list

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for book in self.entries for x in book.reshape(-1)).encode()).hexdigest()

    def decode(self, code: bytes) -> list[int]:
        """The integers that a code stands for."""
        return [int(x) for part, i in enumerate(code) for x in self.entries[part][i]]


def distances(x, book):
    """Exact squared distances (rows of ``x`` by entries of ``book``), both of one dtype."""
    return (x * x).sum(axis=1)[:, None] + (book * book).sum(axis=1)[None, :] - 2 * (x @ book.T)


def nearest(x, book):
    """For each row: its nearest entry (ties to the lower index), its distance and that of the second-nearest."""
    import numpy as np

    d = distances(x, book)
    at = np.asarray(d.argmin(axis=1))
    rows = np.arange(len(d))
    own = d[rows, at].astype("f8")
    if d.shape[1] == 1:
        return at, np.sqrt(own), np.full(len(d), np.inf)
    if d.dtype == object:
        d = d.astype("f8")
    d[rows, at] = np.inf
    return at, np.sqrt(own), np.sqrt(d.min(axis=1).astype("f8"))


class Heaps:
    """A block's heaps: for each part position and entry a heap of (key, row)."""

    def __init__(self, parts: int, entries: int):
        self.of = [[[] for _ in range(entries)] for _ in range(parts)]

    def settle(self, vectors, books, drift) -> list:
        """Pop what ``drift`` has violated, scan it exactly and push it again.

        Returns for each part position: rows popped, where they were and where they are now.
        """
        import numpy as np

        moved = []
        for part, (heaps, book) in enumerate(zip(self.of, books, strict=True)):
            popped, was = [], []
            for entry, heap in enumerate(heaps):
                while heap and heap[0][0] <= drift[part][entry]:
                    popped.append(heapq.heappop(heap)[1])
                    was.append(entry)
            now = self.push(part, np.array(popped, "i8"), vectors, book, drift)
            moved.append((np.array(popped, "i8"), np.array(was, "i8"), now))
        return moved

    def push(self, part: int, rows, vectors, book, drift):
        """Scan ``rows`` exactly and push them; returns their entries."""
        import numpy as np

        if not len(rows):
            return np.zeros(0, "i8")
        width = book.shape[1]
        at, own, second = nearest(vectors[rows, part * width : (part + 1) * width].astype(book.dtype), book)
        then = np.asarray(drift[part])[at]
        with np.errstate(invalid="ignore"):
            keys = np.where(np.isinf(second), np.inf, second - own + then - SLACK * (second + own + then + 1))
        heaps = self.of[part]
        for entry, key, row in zip(at.tolist(), keys.tolist(), rows.tolist(), strict=True):
            heapq.heappush(heaps[entry], (key, row))
        return at

    def entries_of(self, part: int, n: int):
        import numpy as np

        at = np.zeros(n, "i8")
        for entry, heap in enumerate(self.of[part]):
            at[[row for _, row in heap]] = entry
        return at

    def dump(self) -> tuple[bytes, bytes, bytes]:
        """Sizes, keys and rows, heap by heap in heap order."""
        import numpy as np

        flat = [x for heaps in self.of for heap in heaps for x in heap]
        sizes = [len(heap) for heaps in self.of for heap in heaps]
        return np.array(sizes, "<i4").tobytes(), np.array([k for k, _ in flat], "<f8").tobytes(), np.array([r for _, r in flat], "<i4").tobytes()

    @classmethod
    def load(cls, parts: int, entries: int, sizes: bytes, keys: bytes, rows: bytes) -> Heaps:
        import numpy as np

        self = cls(parts, entries)
        items = iter(zip(np.frombuffer(keys, "<f8").tolist(), np.frombuffer(rows, "<i4").tolist(), strict=True))
        for k, size in enumerate(np.frombuffer(sizes, "<i4").tolist()):
            self.of[k // entries][k % entries] = [next(items) for _ in range(size)]
        return self


class Moves:
    """Sums and counts that a task's parts have brought to entries, or taken from them."""

    def __init__(self, parts: int, entries: int, width: int, exact: bool):
        import numpy as np

        self.n = np.zeros((parts, entries), "i8")
        self.sums = np.zeros((parts, entries, width), object if exact else "i8")

    def add(self, part: int, entries, x, sign: int) -> None:
        import numpy as np

        np.add.at(self.n[part], entries, sign)
        np.add.at(self.sums[part], entries, sign * x)

    def rows(self) -> list[dict]:
        """A row for each entry that changed."""
        changed = zip(*((self.n != 0) | (self.sums != 0).any(axis=2)).nonzero(), strict=True)
        return [{"part": int(p), "entry": int(e), "n": int(self.n[p, e]), "sums": [int(x) for x in self.sums[p, e]]} for p, e in changed]


_MOVES = "moves array<struct<part:int,entry:int,n:bigint,sums:array<decimal(38,0)>>>"
_HEAPS = "n int, vectors binary, sizes binary, keys binary, rows binary"


def _moves_type():
    return pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))]))


def _numbers(books: list, largest: int, width: int):
    """The dtype in which all distances are exact."""
    top = max([largest, *(abs(int(x)) for b in books for x in b.reshape(-1))])
    bound = 4 * width * top * top
    return "f4" if bound < 1 << 24 else "f8" if bound < 1 << 53 else object


@dataclass
class _Fit:
    """What every task of a round gets."""

    parts: int
    width: int
    stored: str
    number: object
    books: list
    drift: list

    def typed(self) -> list:
        return [b.astype(self.number) for b in self.books]

    @property
    def entries(self) -> int:
        return len(self.books[0])

    def moves(self) -> Moves:
        return Moves(self.parts, self.entries, self.width, self.number is object)

    def matrix(self, raw: bytes):
        import numpy as np

        m = np.frombuffer(raw, self.stored).reshape(-1, self.parts * self.width)
        return m.astype(object) if self.number is object else m

    def part(self, m, part: int):
        x = m[:, part * self.width : (part + 1) * self.width]
        return x if self.number is object else x.astype("i8")


def _block_batch(keep, n, vectors: bytes, heaps: Heaps, moves=None):
    sizes, keys, rows = heaps.dump()
    one = lambda x, t: pa.array([x], t)
    return pa.RecordBatch.from_arrays([keep, one(n, pa.int32()), *[one(x, pa.binary()) for x in (vectors, sizes, keys, rows)], one(moves, _moves_type())], names=["kept", "n", "vectors", "sizes", "keys", "rows", "moves"])


def _moves_batch(kept_type, moves: Moves):
    nulls = [pa.nulls(1, t) for t in (kept_type, pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays([*nulls, pa.array([moves.rows()], _moves_type())], names=["kept", "n", "vectors", "sizes", "keys", "rows", "moves"])


def _first(fit: _Fit, block: int):
    """Rows (``kept`` struct, ``v`` array of integers) -> blocks, all parts scanned, and the task's sums."""

    def run(batches):
        import numpy as np

        moves, kind, books = fit.moves(), None, fit.typed()

        def blocks(table):
            for at in range(0, len(table), block):
                some = table.slice(at, block).combine_chunks()
                values = some["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(fit.stored)
                raw = values.tobytes()
                m, heaps = fit.matrix(raw), Heaps(fit.parts, fit.entries)
                for part, book in enumerate(books):
                    now = heaps.push(part, np.arange(len(m)), m, book, fit.drift)
                    moves.add(part, now, fit.part(m, part), 1)
                kept = some["kept"].combine_chunks()
                yield _block_batch(pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept), len(m), raw, heaps)

        held = []
        for b in batches:
            kind = pa.list_(b.schema.field("kept").type)
            held.append(b)
            if sum(x.num_rows for x in held) >= block:
                table = pa.Table.from_batches(held)
                whole = len(table) // block * block
                yield from blocks(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if kind is not None:
            if sum(x.num_rows for x in held):
                yield from blocks(pa.Table.from_batches(held))
            yield _moves_batch(kind, moves)

    return run


def _next(fit: _Fit):
    """Blocks -> blocks after another round, and the task's moves."""

    def run(batches):
        moves, kind, books = fit.moves(), None, fit.typed()
        for b in batches:
            kind = b.schema.field("kept").type
            for i in range(b.num_rows):
                n, raw, *heap = (b.column(c)[i].as_py() for c in ("n", "vectors", "sizes", "keys", "rows"))
                m, heaps = fit.matrix(raw), Heaps.load(fit.parts, fit.entries, *heap)
                for part, (rows, was, now) in enumerate(heaps.settle(m, books, fit.drift)):
                    left = was != now
                    x = fit.part(m[rows[left]], part)
                    moves.add(part, was[left], x, -1)
                    moves.add(part, now[left], x, 1)
                yield _block_batch(b.column("kept").slice(i, 1), n, raw, heaps)
        if kind is not None:
            yield _moves_batch(kind, moves)

    return run


def _last(fit: _Fit):
    """Blocks -> rows: ``kept``, ``code`` and ``error``."""

    def run(batches):
        import numpy as np

        books = fit.typed()
        whole = [b.astype(object if fit.number is object else "i8") for b in fit.books]
        for b in batches:
            for i in range(b.num_rows):
                n, raw, *heap = (b.column(c)[i].as_py() for c in ("n", "vectors", "sizes", "keys", "rows"))
                m, heaps = fit.matrix(raw), Heaps.load(fit.parts, fit.entries, *heap)
                heaps.settle(m, books, fit.drift)
                codes, errors = np.zeros((n, fit.parts), "u1"), np.zeros(n, object if fit.number is object else "i8")
                for part, book in enumerate(whole):
                    at = heaps.entries_of(part, n)
                    codes[:, part] = at
                    off = fit.part(m, part) - book[at]
                    errors += (off * off).sum(axis=1)
                error = pa.array([int(x) if x < 1 << 63 else None for x in errors.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("kept")[i].values, pa.array([c.tobytes() for c in codes], pa.binary()), error], names=["kept", "code", "error"])

    return run


def usable(vector):
    """Neither null nor with null or non-finite components."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def compress(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", keep: list[str] | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK) -> tuple[DataFrame, Codebooks]:
    """One row per kept row: the columns of ``keep``, ``code`` (a byte a part) and ``error`` (squared distance to what it stands for); and the codebooks.

    ``keep`` is ``[vec_id]`` by default.  ``entries`` is 256 at most.
    """
    import numpy as np

    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    keep = [vec_id] if keep is None else keep
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x))
    small = F.forall(F.col(vector).cast("array<double>"), lambda x: F.abs(x) * scale < float(LARGEST))
    fine = df.where(usable(F.col(vector)) & small & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    rows = fine.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"), F.col(vec_id).alias("id"), scaled.alias("v"))
    order = [F.col("id").asc_nulls_last(), F.col("v").asc()]
    names = [F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)]
    first = rows.orderBy(*order).select(F.size("v").alias("d")).first()
    if first is None:
        return rows.select(*names, F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error")), Codebooks([np.zeros((0, 0), object)] * parts)
    width = first.d // parts
    rows = rows.where(F.size("v") == first.d)
    seeds = [r.v for r in rows.orderBy(*order).limit(entries).select("v").collect()]
    largest = int(rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0])
    stored = next(t for t in ("<i2", "<i4", "<i8") if largest < 1 << (8 * int(t[2]) - 1))
    whole = np.array(seeds, object)
    books = [whole[:, p * width : (p + 1) * width] for p in range(parts)]
    if max(largest, 1) < 1 << 31:
        books = [b.astype("i8") for b in books]
    fit = _Fit(parts, width, stored, _numbers(books, largest, width), books, [np.zeros(len(whole)) for _ in range(parts)])
    kind = rows.schema["kept"].dataType.simpleString()
    schema = f"kept array<{kind}>, {_HEAPS}, {_MOVES}"
    state = staged(rows.select("kept", "v").mapInArrow(_first(fit, block), schema), "heap-lloyd")
    totals, counts = np.zeros((parts, len(whole), width), object), np.zeros((parts, len(whole)), object)
    for r in range(rounds):
        moved = state.select(F.explode("moves").alias("m")).select("m.part", "m.entry", "m.n", F.posexplode("m.sums").alias("at", "x"))
        # an entry's count comes with the sum of its first component
        for m in moved.groupBy("part", "entry", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
            totals[m.part, m.entry, m.at] += int(m.x)
            if m["at"] == 0:
                counts[m.part, m.entry] += m.n
        fit = _moved(fit, totals, counts)
        blocks = state.where("n is not null")
        if r + 1 < rounds:
            now = staged(blocks.mapInArrow(_next(fit), schema), "heap-lloyd")
            drop_staged(state)
            state = now
    if not rounds:
        blocks = state.where("n is not null")
    coded = cut(blocks.select("kept", "n", "vectors", "sizes", "keys", "rows").mapInArrow(_last(fit), f"kept {kind}, code binary, error bigint"))
    drop_staged(state)
    return coded.select(*names, "code", "error"), Codebooks(fit.books)


def _moved(fit: _Fit, totals, counts) -> _Fit:
    """The next codebooks, and how far all entries have drifted by then."""
    import numpy as np

    books, drift = [], []
    for part, book in enumerate(fit.books):
        new = book.copy()
        for entry in np.flatnonzero(counts[part] > 0):
            new[entry] = [int(s) // int(counts[part][entry]) for s in totals[part][entry]]
        off = (new - book).astype("f8")
        way = np.sqrt((off * off).sum(axis=1)) * (1 + SLACK)
        first = int(way.argmax())
        others = np.full(len(way), way[first])
        others[first] = np.delete(way, first).max(initial=0.0)
        books.append(new)
        drift.append(fit.drift[part] + way + others)
    return _Fit(fit.parts, fit.width, fit.stored, fit.number, books, drift)


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error") -> DataFrame:
    """``coded`` with ``label_error``: the errors summed over equal labels, nulls together."""
    sums = coded.groupBy(F.col(label).alias("__label")).agg(F.expr(f"try_sum(`{error}`)").alias("label_error"))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")
