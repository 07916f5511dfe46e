"""Verified near duplicates for :mod:`tesserae.llm.simhash`: candidates and exact Jaccard similarity of word shingles.

Candidates share a SimHash link (blocks, then Hamming distance) or a key of
MinHash bands.  SimHash blocks alone can't give right results here: at Jaccard
0.8 two fingerprints differ in about 9 of 64 bits, and keys selective enough for
a large corpus reach 4 at most.  A text's ``BANDS`` keys each hash ``ROWS``
minima of its shingles; two texts at Jaccard ``j`` share one with probability
``1 - (1 - j**ROWS) ** BANDS``: 0.99993 at 0.8, more above.  No pair is linked
by its keys alone: the shingle sets of both texts are compared whole.

A candidate pair is first judged by its signatures, a byte of each of the
``BANDS * ROWS`` minima: below ``LIKELY`` equal bytes, which two texts at 0.8 miss
with a probability of about 1e-6, it is none.  Only what is left moves sets.

Only *distinct* texts are nodes; a group of copies is one.  Each key first
compares its members with its least and its greatest one.  What these links
already connect needs no other pair.  In a key that still holds several
components, members of different ones are compared: as pairs where the key has
up to ``SMALL`` members, else in tiles, in which two slices of the key's members
meet in one task that emits links only.  A pair that shares several keys is
compared under the first of them.  So no candidate that could connect anything is
left out, a large group of near copies that its ends connect costs rows in
proportion, and one that they don't costs tiles: its members' square over
``SLICE`` in bytes moved, its square in comparisons.

Sets are of 32-bit hashes, made once and written with the keys, so texts don't
move here; two of a million shingles' hashes meet by chance in one pair of sets in
so few places that a similarity moves by 1e-4 at most.

Edge cases: texts without words (null too) are alike; repeated rows are one; an
empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import simhash
from tesserae.llm.common import components, cut, drop_staged, slices, staged

BANDS, ROWS = 24, 5
SEED = 42
#: Standard deviations of the count of equal signature bytes that a pair may lie under what ``least`` lets expect.
LIKELY = 4.7
#: A key with more members than this is compared in tiles.
SMALL = 24
#: Members and bytes of sets that a slice of a key holds on average.
SLICE, SLICE_BYTES = 2048, 8 << 20


def shingles(text: str | None, shingle: int = 5):
    """Hashes of the distinct shingles of a whole text, sorted; a shorter text is one shingle."""
    import numpy as np

    return np.unique(simhash.shingle_hashes(text, shingle))


def small_set(hashes):
    """The sorted set as it is compared: 32 bits a shingle."""
    import numpy as np

    return np.unique((hashes >> np.uint64(32)).astype("<u4"))


def band_keys(hashes):
    """The ``BANDS`` keys of a sorted set of shingles, and the signature: a byte of each minimum."""
    import numpy as np
    import xxhash

    r = np.random.default_rng(SEED)
    times = r.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype="u8") * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo("u8").max, "u8")
    for at in range(0, len(hashes), 4096):  # a book is taken in slices of fixed memory
        least = np.minimum(least, (times * hashes[None, at : at + 4096]).min(axis=1))
    bands = least.reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(bands[i].tobytes(), i) for i in range(BANDS)], "u8").view("i8")
    return keys, ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype("u1").tobytes()


def likely(least: float) -> float:
    """Fewest equal bytes of two signatures that are taken further."""
    n, p = BANDS * ROWS, least + (1 - least) / 256
    return n * p - LIKELY * (n * p * (1 - p)) ** 0.5


def jaccard(x, y) -> float:
    """Of two sorted sets of hashes."""
    import numpy as np

    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / n if (n := len(x) + len(y) - both) else 1.0


def compare_tile(hs, roots, keys, sets, sides, key: int, least: float):
    """Links ``(i, j)`` of a tile's rows: of different roots and (between two slices) of different sides, that share ``key`` first."""
    import numpy as np

    n = len(hs)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = np.concatenate(sets) if n else np.zeros(0, "<u4")
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]  # postings: the rows that hold each shingle
    sizes = np.array([len(s) for s in sets])
    two = len(set(sides)) > 1
    out: list[tuple[int, int]] = []
    for i in range(n):
        rest = np.arange(i + 1, n)
        rest = rest[(roots[rest] != roots[i]) & ((sides[rest] != sides[i]) | (not two))]
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[small >= least * large]
        if not len(rest):
            continue
        same = keys[rest] == keys[i]
        rest = rest[keys[i][same.argmax(axis=1)] == key]
        if not len(rest):
            continue
        both = np.zeros(n, "i8")
        for at in range(0, len(sets[i]), 4096):  # a book is taken in slices of fixed memory
            part = sets[i][at : at + 4096]
            low, high = np.searchsorted(flat, part, "left"), np.searchsorted(flat, part, "right")
            many = high - low
            ends = np.cumsum(many)
            both += np.bincount(of[np.arange(ends[-1]) + np.repeat(low - ends + many, many)], minlength=n)
        union = sizes[rest] + sizes[i] - both[rest]
        out += [(i, int(j)) for j in rest[both[rest] >= least * union]]
    return out


def links(texts: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Edges ``a``, ``b`` between the ``h`` of verified near duplicates; ``texts``: ``h, text``."""
    import numpy as np

    def keyed(batches):
        for b in slices(batches):
            hashes = [simhash.shingle_hashes(t.as_py(), shingle) for t in b.column(1)]
            fps = np.array([simhash.of_hashes(x) for x in hashes], "u8").view("i8")
            hashes = [np.unique(x) for x in hashes]
            keys, signs = zip(*map(band_keys, hashes), strict=True)
            sets = pa.array([small_set(x).tobytes() for x in hashes], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.binary()), pa.array(fps), sets], names=["h", "keys", "sign", "fp", "s"])

    def verified(batches):
        for b in slices(batches):
            x, y = ([np.frombuffer(v.as_py(), "<u4") for v in b.column(i)] for i in (2, 3))
            near = [min(len(p), len(q)) >= least * max(len(p), len(q)) and jaccard(p, q) >= least for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    def judged(batches):
        for b in slices(batches):
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), "u1").reshape(b.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= likely(least)))

    # sets lie where they were made until a candidate needs them; copies go by what is narrow
    made = staged(texts.mapInArrow(keyed, "h bigint, keys array<bigint>, sign binary, fp bigint, s binary"), "near-sets")
    nodes = cut(made.select("h", "keys", "sign", "fp").dropDuplicates(["h"]))
    bands = nodes.select("h", F.explode("keys").alias("key"))
    crowded = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).where("n > 1")
    members = cut(bands.join(crowded, "key"))
    by_print = nodes.groupBy("fp").agg(F.min("h").alias("rep"))
    reps = lambda end: by_print.select(F.col("fp").alias(end), F.col("rep").alias(f"rep_{end}"))
    near_prints = simhash.links(by_print.select("fp")).join(reps("a"), "a").join(reps("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    same_print = nodes.join(by_print, "fp").select(F.col("rep").alias("a"), F.col("h").alias("b"))
    of_prints = cut(near_prints.unionByName(same_print).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    signs = nodes.select("h", "sign")

    def likely_pairs(pairs: DataFrame) -> DataFrame:
        left, right = signs.select(F.col("h").alias("a"), F.col("sign").alias("x")), signs.select(F.col("h").alias("b"), F.col("sign").alias("y"))
        return cut(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(judged, "a bigint, b bigint"))

    def sets_of(hs: DataFrame) -> DataFrame:
        return made.select("h", "s").join(hs.distinct(), "h", "left_semi").dropDuplicates(["h"])

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = likely_pairs(pairs)
        known = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("h")))
        left, right = known.select(F.col("h").alias("a"), F.col("s").alias("x")), known.select(F.col("h").alias("b"), F.col("s").alias("y"))
        return cut(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(verified, "a bigint, b bigint"))

    ends = members.select("h", F.explode(F.array("low", "high")).alias("end")).where("h <> end")
    stars = verify(ends.select(F.least("h", "end").alias("a"), F.greatest("h", "end").alias("b")).unionByName(of_prints).distinct())
    roots = components(stars).withColumnRenamed("node", "h")
    placed = members.select("key", "h", "n").join(roots, "h", "left").select("key", "h", "n", F.coalesce("root", "h").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p < q").select("key")
    rest = cut(placed.join(mixed, "key"))
    l, r = rest.where(F.col("n") <= SMALL).alias("l"), rest.where(F.col("n") <= SMALL).alias("r")
    across = l.join(r, (F.col("l.key") == F.col("r.key")) & (F.col("l.root") < F.col("r.root")))
    others = across.select(F.least("l.h", "r.h").alias("a"), F.greatest("l.h", "r.h").alias("b")).distinct()

    many = rest.where(F.col("n") > SMALL).drop("n")
    bits = F.transform("keys", lambda k: F.shiftright(F.shiftleft(k, 32), 32).cast("int"))  # of a band's keys 32 bits are enough to tell which is shared first
    many = many.join(nodes.select("h", bits.alias("keys")), "h").join(sets_of(many.select("h")), "h")
    counted = many.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / SLICE), F.ceil(F.sum(F.octet_length("s")) / SLICE_BYTES)).cast("int").alias("slices"))
    side = F.pmod(F.xxhash64("h"), F.col("slices")).cast("int")
    cells = many.join(counted, "key").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cells = cells.select("key", F.least("side", "other").alias("s1"), F.greatest("side", "other").alias("s2"), "side", "h", "root", "keys", "s")

    def tile(key, table):
        table = table.combine_chunks()
        hs, root, side = (table[c].to_numpy() for c in ("h", "root", "side"))
        bands = np.array(table["keys"].to_pylist(), "i4").reshape(len(hs), BANDS)
        found = compare_tile(hs, root, bands, [np.frombuffer(x.as_py(), "<u4") for x in table["s"]], side, int(np.int64(key[0].as_py()).astype("i4")), least)
        a, b = ([int(hs[p[k]]) for p in found] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # dealt by tile: the join before leaves a key's rows together, which would do all its tiles in one task
    tiled = cells.repartition("key", "s1", "s2").groupBy("key", "s1", "s2").applyInArrow(tile, "a bigint, b bigint")
    found = cut(stars.unionByName(verify(others)).unionByName(tiled))
    drop_staged(made)
    return found
