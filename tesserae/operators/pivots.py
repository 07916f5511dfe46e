"""A threshold join of vectors that prunes by the triangle inequality.

The angle between vectors is a metric.  If two vectors lie within an angle ``t``,
their angles to any third one, a pivot, differ by ``t`` at most.  Each side is cut
into blocks of vectors that are near one pivot and at about one angle from it; a
block keeps the range of its angles to all pivots.  Two blocks meet only if no
pivot tells their ranges more than ``t`` apart; so block pairs that can't hold a
pair above the threshold are never made, and no pair above it is lost, whatever the
pivots.  Blocks find each other by an equi-join on cells of their angles to the
first two pivots.

Pivots are a bounded sample's vectors that lie far from each other; they can be
stored beside the table that they were chosen for.  Without structure in the
vectors all blocks meet: then the work is that of all pairs, spread over tasks.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import vector as M
from tesserae.sources import tables
from tesserae.sources.shared import cut

PIVOTS = 12
#: Vectors that pivots are chosen from: these with the least hashes.
SAMPLE = 2048
#: More than angles are off by rounding.
SLACK = 1e-6

Pivots = dict  # length of the vectors -> list of unit vectors


def choose(vectors: DataFrame, column: str = "vector", n: int = PIVOTS, sample: int = SAMPLE) -> Pivots:
    """For each length among a sample: its first vector, then ``n - 1`` times the one farthest from those before."""
    import numpy as np

    v = F.col(column)
    some = vectors.where(v.isNotNull() & (F.size(v) > 0)).select(v.cast("array<double>").alias("v")).orderBy(F.xxhash64("v"), "v").limit(sample)
    out: Pivots = {}
    rows = [np.array(r.v, "f8") for r in some.collect() if None not in r.v]
    for dim in sorted({len(r) for r in rows}):
        with np.errstate(all="ignore"):
            m = np.array([r / np.linalg.norm(r) for r in rows if len(r) == dim])
        m = m[np.isfinite(m).all(axis=1)]
        if not len(m):
            continue
        at, far = [0], m @ m[0]
        while len(at) < n and far.min() < 1 - 1e-9:
            at.append(int(far.argmin()))
            far = np.maximum(far, m @ m[at[-1]])
        out[dim] = m[at].tolist()
    return out


def save(spark: SparkSession, root: str, pivots: Pivots) -> None:
    """Keep ``pivots`` beside the versioned table ``root``."""
    rows = [(dim, i, p) for dim, some in pivots.items() for i, p in enumerate(some)]
    tables.write(spark.createDataFrame(rows, "dim int, i int, pivot array<double>").coalesce(1), f"{root}/_pivots")


def load(spark: SparkSession, root: str) -> Pivots:
    out: Pivots = {}
    for r in tables.read(spark, f"{root}/_pivots").orderBy("dim", "i").collect():
        out.setdefault(r.dim, []).append(r.pivot)
    return out


def _angles(column: str, pivots: Pivots):
    """Angles to the pivots of a vector's length; empty where there are none; null without a finite direction."""

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        out: list = [None] * len(v)
        for dim in pc.unique(pc.list_value_length(v)).to_pylist():
            if not dim:
                continue
            m, fine = M.as_matrix(v, dim)
            with np.errstate(all="ignore"):
                norms = np.sqrt(M.dots(m, m))
                at = np.flatnonzero(fine & (norms > 0) & np.isfinite(norms))
                to = np.array(pivots.get(dim, np.zeros((0, dim))))
                angles = np.arccos(np.clip(m[at] / norms[at, None] @ to.T, -1, 1))
            for i, a in zip(at.tolist(), angles.tolist(), strict=True):
                out[i] = a
        return pa.array(out, pa.list_(pa.float64()))

    return run(column)


def blocks(rows: DataFrame, key: str, vector: str, pivots: Pivots, angle: float, rows_a_block: int = 4096) -> DataFrame:
    """``key, v, angles, block`` of the rows that have a direction; written once."""
    placed = rows.select(F.col(key).alias("key"), F.col(vector).alias("v"), _angles(vector, pivots).alias("angles")).where("angles is not null")
    least = F.array_min("angles")
    cell = placed.withColumns({"dim": F.size("v"), "cell": F.coalesce(F.array_position("angles", least), F.lit(0)), "ring": F.coalesce(F.floor(least / F.lit(angle)), F.lit(0))})
    cell = cut(cell)
    # a few numbers for each length: pivots times rings
    sizes = {(r.dim, r["cell"], r.ring): r["count"] for r in cell.groupBy("dim", "cell", "ring").count().collect()}
    of_dim: dict[int, int] = {}
    for (dim, _, _), n in sizes.items():
        of_dim[dim] = of_dim.get(dim, 0) + n
    # fewer rows than a block are one block; a cell with more is dealt out by key
    cuts = {f"{d},{c},{r}": -(-n // rows_a_block) for (d, c, r), n in sizes.items() if of_dim[d] > rows_a_block}
    parts = F.try_element_at(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]), F.concat_ws(",", "dim", "cell", "ring")) if cuts else F.lit(None).cast("int")
    part = lambda x: F.when(parts.isNull(), 0).otherwise(x).cast("bigint")
    name = F.struct("dim", part(F.col("cell")).alias("cell"), part(F.col("ring")).alias("ring"), part(F.pmod(F.xxhash64("key"), parts)).alias("sub"))
    return cell.select("key", "v", "angles", name.alias("block"))


def _boxes(placed: DataFrame, n: int) -> DataFrame:
    """Each block's rows and ranges of angles."""
    at = [F.get("angles", F.lit(i)) for i in range(n)]
    return placed.groupBy("block").agg(F.count("*").alias("n"), F.array(*map(F.min, at)).alias("lo"), F.array(*map(F.max, at)).alias("hi"))


def _apart(angle: float, lo, hi, lo2, hi2):
    """Does a pivot tell two boxes further apart than ``angle``?  Pivots that a box has no angles to (null) tell nothing."""
    gaps = F.zip_with(F.zip_with(lo, hi2, lambda x, y: x - y), F.zip_with(lo2, hi, lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return F.coalesce(F.array_max(gaps), F.lit(0.0)) > angle


def meetings(left: DataFrame, right: DataFrame, pivots: Pivots, threshold: float) -> DataFrame:
    """Pairs of blocks (``l, r``) that can hold a pair above ``threshold``, with their rows ``n, m`` and boxes."""
    angle = reach(threshold)
    n = max([1, *map(len, pivots.values())])
    a = _boxes(left, n).select(F.col("block").alias("l"), "n", "lo", "hi")
    b = _boxes(right, n).select(F.col("block").alias("r"), F.col("n").alias("m"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    cells = lambda lo, hi, i, wide: F.explode(F.sequence(F.coalesce(F.floor((F.get(lo, F.lit(i)) - wide) / angle), F.lit(0)), F.coalesce(F.floor((F.get(hi, F.lit(i)) + wide) / angle), F.lit(0))))
    one = a.withColumn("dim", F.col("l.dim")).withColumn("x", cells("lo", "hi", 0, angle)).withColumn("y", cells("lo", "hi", 1, angle))
    two = b.withColumn("dim", F.col("r.dim")).withColumn("x", cells("lo2", "hi2", 0, 0.0)).withColumn("y", cells("lo2", "hi2", 1, 0.0))
    near = one.join(two, ["dim", "x", "y"]).where(~_apart(angle, F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2")))
    return near.select("l", "r", "n", "m", "lo", "hi", "lo2", "hi2").dropDuplicates(["l", "r"])


def reach(threshold: float) -> float:
    """The angle of a cosine, and what rounding may add."""
    return max(math.acos(max(-1.0, min(1.0, threshold))), 1e-3) + SLACK


def join(left: DataFrame, right: DataFrame, pivots: Pivots, threshold: float, found, schema: str) -> DataFrame:
    """``found`` of two Arrow tables (``key, v`` each) for all pairs of blocks that can hold a pair above ``threshold``.

    ``left`` and ``right`` come from :func:`blocks`.  A row goes along only if it can
    reach the other block's box.
    """
    angle = reach(threshold)
    pairs = cut(meetings(left, right, pivots, threshold))
    own = lambda lo, hi: ~_apart(angle, F.col("angles"), F.col("angles"), F.col(lo), F.col(hi))
    a = left.withColumnRenamed("block", "l").join(pairs, "l").where(own("lo2", "hi2")).select("l", "r", "key", "v")
    b = right.withColumnRenamed("block", "r").join(pairs, "r").where(own("lo", "hi")).select(F.col("l").alias("l2"), F.col("r").alias("r2"), F.col("key").alias("key2"), F.col("v").alias("v2"))
    run = lambda x, y: found(x.select(["key", "v"]), y.select(["key2", "v2"]).rename_columns(["key", "v"]))
    return a.groupBy("l", "r").cogroup(b.groupBy("l2", "r2")).applyInArrow(run, schema)
