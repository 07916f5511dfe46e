"""SimHash near-dedup: pigeonhole blocks, then verified Hamming distance.

A fingerprint's 64 bits are split into ``4`` blocks of 16.  Two fingerprints at
distance 2 or less differ in two blocks at most, so they share two whole blocks:
each of the 6 pairs of blocks is a join key of 32 bits.  Only *distinct*
fingerprints are joined; a group of copies is one row.

A key with up to ``SMALL`` fingerprints joins them with each other and verifies
each pair.  A key with more of them (near copies by the thousand) would emit all
its pairs; there each fingerprint instead names its 32 neighbours at distance 1
within the unshared blocks and itself.  Two fingerprints of one key share such a
name if and only if their distance is 2 or less, and every name links its
members to its least one, so the work is 33 rows a fingerprint and no link is
lost between components.

:func:`dedup` keeps one document of each class.  With ``least`` it takes what the
fingerprints link as candidates, adds those of MinHash bands
(:mod:`tesserae.llm.jaccard`, where it says why) and keeps only links whose
shingle sets have that Jaccard similarity.

Edge cases: a null text or a text without words has fingerprint zero and is
linked like any other; repeated rows repeat in the result; an empty table gives
no rows; a null ``doc_id`` keeps its row but never names a component; very long
texts are summed in slices; other columns, whatever their names, pass through
:func:`dedup` (``__key`` is refused) and aren't read by :func:`near_duplicates`.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import components, cut

SHINGLE = 3
SEED = 42
BITS = 64
BLOCK = 16
DISTANCE = 2
#: A key with more distinct fingerprints than this is linked by neighbour names.
SMALL = 24


def shingle_hashes(text: str | None, shingle: int = SHINGLE):
    """Hashes (uint64) of the shingles of one whole text, repeats included; none without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    k = min(shingle, len(words))
    of = xxhash.xxh64_intdigest
    return np.array([of(line[a : b - 1], SEED) for a, b in zip(starts, starts[k:])], "<u8")


def of_hashes(hashes) -> int:
    """The fingerprint, unsigned, of shingles given by their hashes."""
    import numpy as np

    counts = np.zeros(BITS, "int64")
    for at in range(0, len(hashes), 1 << 16):  # a book is summed in slices of fixed memory
        some = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(some.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int((2 * counts > len(hashes)).astype("u8") @ (np.uint64(1) << np.arange(BITS, dtype="u8")))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one whole text, unsigned."""
    return of_hashes(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """The columns of ``keep`` and ``fp`` (bigint, the fingerprint's bits)."""
    keep = ["doc_id"] if keep is None else keep
    narrow = docs.select(*keep, docs[text].alias("__text"))

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(b.num_columns - 1)]
            signed = pa.array([x - (1 << 64) if x >> 63 else x for x in fps], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], signed], names=[*keep, "fp"])

    have = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(run, ", ".join([*have, "fp bigint"]))


def links(fps: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` that connect exactly what links at distance 2 or less connect.

    ``fps``: distinct ``fp`` (bigint).
    """
    n = BITS // BLOCK
    block = (1 << BLOCK) - 1
    masks = [(block << (BLOCK * i)) | (block << (BLOCK * j)) for i in range(n) for j in range(i + 1, n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("v")) for k, m in enumerate(masks)])).alias("key"),
    ).select("fp", "key.k", "key.v")
    sizes = keys.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    keyed = cut(keys.join(sizes, ["k", "v"]))
    few, many = keyed.where(F.col("n") <= SMALL), keyed.where(F.col("n") > SMALL)
    l, r = few.alias("l"), few.alias("r")
    near = (F.col("l.fp") < F.col("r.fp")) & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= DISTANCE)
    pairs = l.join(r, (F.col("l.k") == F.col("r.k")) & (F.col("l.v") == F.col("r.v")) & near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    flips = F.array(*[F.array(*[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1], F.lit(0)) for m in masks])
    named = many.select("fp", "k", "v", F.explode(F.element_at(flips, F.col("k") + 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("name")).distinct()
    least = named.groupBy("name").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = named.join(least, "name").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id``, the smallest id reachable."""
    rows = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), shingle=shingle))
    return classes(rows).select("doc_id", "fp", "component_id")


def classes(rows: DataFrame) -> DataFrame:
    """``fp`` and other columns -> also ``root`` (its class's least fingerprint) and ``component_id``.

    ``rows`` has ``doc_id``; ``component_id`` is the smallest of the class.
    """
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = components(links(nodes.select("fp")))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = cut(labelled.join(named, "root").select("fp", "root", "component_id"))
    return rows.join(known, "fp")


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, least: float | None = None) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest ``doc_id``.

    ``least``: the Jaccard similarity of shingle sets that links have to reach;
    without it fingerprints at distance 2 or less link.  Among rows of one id the
    least hash of the text decides, rows equal in both are one; null ids come
    last.  Texts move once, in the join that keeps the chosen rows.
    """
    if "__key" in docs.columns:
        raise ValueError("the input already has '__key'")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    if least is None:
        placed = classes(cut(fingerprints(rows, keep=["doc_id", "h"], shingle=shingle)))
    else:
        from tesserae.llm import jaccard

        roots = components(jaccard.links(rows.select("h", "text"), shingle, least)).withColumnRenamed("node", "h")
        placed = rows.select("doc_id", "h").join(roots, "h", "left").select("doc_id", "h", F.coalesce("root", "h").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    key = lambda i, h: F.xxhash64(i.isNull(), i, h)
    kept = placed.groupBy("root").agg(first).select(key(F.col("first.doc_id"), F.col("first.h")).alias("__key"))
    keyed = docs.withColumn("__key", key(F.col(doc_id), F.xxhash64(text)))
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
