"""Embedding near-dedup by an epsilon grid order join.

For unit vectors cosine >= t means distance <= eps = sqrt(2 - 2 t).  Projections
to orthonormal principal axes never lengthen a distance, and neither does the
length of what they leave, taken as one axis more; so:

1. Equal vectors become one node with a multiplicity.
2. Principal axes come from the covariance of all nodes (a d x d sum a task).
3. Nodes are put in epsilon grid order: range-sorted by their eps-cells on the
   leading axes, first axis first, and cut into blocks of at most ``BLOCK`` nodes.
4. ``TILE`` neighbouring blocks are a tile.  Blocks and tiles whose boxes are
   within eps are paired by an equi-join on cells of the first two axes; only
   boxes move.  Then each block goes to the tiles it is paired with: a task holds
   one tile and the other blocks stream past it, so the shuffle is the vectors
   times the tiles that a block meets.
5. Each pair of blocks joins its two sequences recursively: both intervals are
   halved, and a pair of intervals whose boxes are farther apart than eps is
   skipped.  Leaves compare the leading axes in one matrix product and verify
   what is left as cosine in double precision over all components; whatever lies
   within 1e-9 of the threshold is decided by one sum of products, so a pair's
   fate never depends on its neighbours.
6. A pair of blocks returns sums of links a node and a spanning forest of its
   links, not the links, so a group of m near copies costs m rows a block.

Memory: a tile and a block a task.  On vectors without any structure in their
leading axes boxes overlap and all pairs of blocks are compared, exactly: time
grows with the square of the rows, the shuffle with rows times tiles.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length never link; rows with
equal vectors link with each other, repeated ids included; a null id keeps its
row, counts as a link, and never names a component; other columns, whatever their
names, aren't read; at a threshold of 1 rounding decides between equal directions; an empty table
gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import components, cut

AXES = 16  #: leading principal axes in boxes and in the first comparison
BLOCK = 4096  #: most nodes of a block
TILE = 8  #: blocks of a tile
LEAF = 512
#: More than any rounding error of the single-precision comparison.
SLACK = 1e-4


def usable(vec: Column) -> Column:
    """Whether a vector can link: not null, not zero, all components finite."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _matrices(column: pa.Array):
    """(row numbers, matrix) for each length of the vectors of a list column."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, flat[starts[at][:, None] + np.arange(d)[None, :]]


def _unit(m):
    import numpy as np

    m = m.astype("f8")
    m = m / np.abs(m).max(axis=1, keepdims=True)  # else the square of a tiny component is lost
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _axes(nodes: DataFrame) -> dict:
    """Leading principal axes (d x k) for each length d."""
    import numpy as np

    def sums(batches):
        total: dict = {}
        for b in batches:
            for _, m in _matrices(b.column(0)):
                u = _unit(m)
                n, s, q = total.get(u.shape[1], (0, 0.0, 0.0))
                total[u.shape[1]] = n + len(u), s + u.sum(axis=0), q + u.T @ u
        if total:
            d = list(total)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array([total[x][0] for x in d], pa.int64()), pa.array([total[x][1].tobytes() for x in d]), pa.array([total[x][2].tobytes() for x in d])], names=["d", "n", "s", "q"])

    def add(key, table):
        rows = table.to_pylist()
        s = sum(np.frombuffer(r["s"]) for r in rows)
        q = sum(np.frombuffer(r["q"]) for r in rows)
        return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([sum(r["n"] for r in rows)], pa.int64()), "s": [s.tobytes()], "q": [q.tobytes()]})

    ddl = "d int, n bigint, s binary, q binary"
    out = {}
    for r in nodes.select("vec").mapInArrow(sums, ddl).groupBy("d").applyInArrow(add, ddl).collect():
        mean = np.frombuffer(r["s"]) / r["n"]
        cov = np.frombuffer(r["q"]).reshape(r["d"], r["d"]) / r["n"] - np.outer(mean, mean)
        out[r["d"]] = np.ascontiguousarray(np.linalg.eigh(cov)[1][:, ::-1][:, :AXES])
    return out


def _project(unit, axes):
    """Leading coordinates and the length of the rest."""
    import numpy as np

    p = unit @ axes
    return np.column_stack((p, np.sqrt(np.maximum(0.0, 1 - (p * p).sum(axis=1)))))


def _apart(lo_a, hi_a, lo_b, hi_b) -> float:
    """Squared distance of two boxes."""
    import numpy as np

    gap = np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap)


class _Side:
    """A block's nodes: unit vectors, projections and boxes of its leaves."""

    def __init__(self, vectors, weights, axes):
        import numpy as np

        self.unit, self.weights = _unit(vectors), weights
        p = _project(self.unit, axes)
        half = (p * p).sum(axis=1) / 2
        one = np.ones(len(p))
        self.left = np.column_stack((p, -half, -one)).astype("f4")  # left . right = -distance^2 / 2
        self.right = np.column_stack((p, one, half)).astype("f4")
        cuts = np.arange(0, len(p), LEAF)
        self.lo, self.hi = np.minimum.reduceat(p, cuts), np.maximum.reduceat(p, cuts)
        self.n = len(p)


def join_blocks(a: _Side, b: _Side, same: bool, threshold: float):
    """Link sums of both sides and the forest of their links, as (i, j) of a's and b's nodes after each other."""
    import numpy as np

    eps2 = 2 - 2 * threshold
    floor = np.float32(-(eps2 + SLACK) / 2)
    counts = np.zeros(a.n + (0 if same else b.n))
    labels = np.arange(len(counts))
    shift = 0 if same else a.n

    def union(i, j):
        nonlocal labels
        while True:
            x, y = labels[i], labels[j]
            differ = x != y
            if not differ.any():
                return
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            least = np.minimum(x, y)
            np.minimum.at(labels, x, least)
            np.minimum.at(labels, y, least)
            while (labels != labels[labels]).any():
                labels = labels[labels]

    def leaf(x: int, y: int):
        s, t = slice(x * LEAF, (x + 1) * LEAF), slice(y * LEAF, (y + 1) * LEAF)
        near = a.left[s] @ b.right[t].T >= floor
        n = int(np.count_nonzero(near))
        if not n:
            return
        if n > near.size // 16:
            cosine = a.unit[s] @ b.unit[t].T
            i, j = np.nonzero(near & (cosine >= threshold - 1e-9))
            cosine = cosine[i, j]
            edge = np.flatnonzero(cosine < threshold + 1e-9)
            cosine[edge] = (a.unit[s][i[edge]] * b.unit[t][j[edge]]).sum(axis=1)
        else:
            i, j = np.nonzero(near)
            cosine = (a.unit[s][i] * b.unit[t][j]).sum(axis=1)
        fine = cosine >= threshold
        i, j = i[fine], j[fine]
        i, j = i + x * LEAF, j + y * LEAF
        if same and x == y:
            upper = i < j
            i, j = i[upper], j[upper]
        if len(i):
            np.add.at(counts, i, b.weights[j])
            np.add.at(counts, j + shift, a.weights[i])
            union(i, j + shift)

    def recurse(a0: int, a1: int, b0: int, b1: int):
        if _apart(a.lo[a0:a1].min(axis=0), a.hi[a0:a1].max(axis=0), b.lo[b0:b1].min(axis=0), b.hi[b0:b1].max(axis=0)) > eps2 + SLACK:
            return
        if a1 - a0 == 1 and b1 - b0 == 1:
            return leaf(a0, b0)
        if same and (a0, a1) == (b0, b1):
            m = (a0 + a1) // 2
            recurse(a0, m, a0, m)
            recurse(a0, m, m, a1)
            recurse(m, a1, m, a1)
        elif a1 - a0 >= b1 - b0:
            m = (a0 + a1) // 2
            recurse(a0, m, b0, b1)
            recurse(m, a1, b0, b1)
        else:
            m = (b0 + b1) // 2
            recurse(a0, a1, b0, m)
            recurse(a0, a1, m, b1)

    recurse(0, len(a.lo), 0, len(b.lo))
    return counts, labels


def near_duplicates(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", threshold: float = 0.95) -> DataFrame:
    """One row per row of ``df``: ``vec_id, n_links, component_id, kept``."""
    import numpy as np

    kind = df.schema[vector].dataType.elementType
    word = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    rows = df.select(F.col(vec_id).alias("vec_id"), (F.col(vector) if word == "<f4" else F.col(vector).cast("array<double>")).alias("vec"))
    fine, rest = rows.where(usable(F.col("vec"))), rows.where(~usable(F.col("vec")))
    alone = rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    nodes = cut(fine.groupBy("vec").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies")))
    axes = _axes(nodes)
    if not axes:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    eps = max(float(np.sqrt(max(0.0, 2 - 2 * threshold))), 1e-3)

    def order(batches):
        for b in batches:
            keys = [""] * b.num_rows
            for at, m in _matrices(b.column(0)):
                d = m.shape[1]
                cells = np.floor(_unit(m) @ axes[d] / eps).astype("i8") + 0x8000
                for i, k in zip(at, cells.astype(">u2"), strict=True):
                    keys[i] = f"{d:08x}{k.tobytes().hex()}"
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string())], names=[*b.schema.names, "cells"])

    have = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(nodes.mapInArrow(order, f"{have}, cells string").repartitionByRange(n_ranges, "cells", "vec").sortWithinPartitions("cells", "vec").drop("cells").withColumn("m", F.monotonically_increasing_id()))
    part = F.shiftright("m", 33)
    sizes = dict(ordered.groupBy(part.alias("p")).count().collect())  # one row a range
    base = np.cumsum([0, *[sizes.get(p, 0) for p in range(max(sizes) + 1)]])
    bases = F.array(*[F.lit(int(x)).cast("bigint") for x in base])
    placed = ordered.select("vec", "least_id", "copies", (F.element_at(bases, part.cast("int") + 1) + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("node"))
    widest = max(axes)
    per = max(LEAF, min(BLOCK, (1 << 19) // widest))

    def block(key, table):
        table = table.sort_by("node")
        ((_, m),) = _matrices(table["vec"].combine_chunks())
        p = _project(_unit(m), axes[m.shape[1]])
        one = lambda x: pa.array([x.tobytes()], pa.binary())
        floats = pa.list_(pa.float64())
        return pa.table({"d": pa.array([m.shape[1]], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "lo": pa.array([p.min(axis=0).tolist()], floats), "hi": pa.array([p.max(axis=0).tolist()], floats), "nodes": one(table["node"].to_numpy()), "copies": one(table["copies"].to_numpy()), "vectors": one(m.astype(word))})

    blocks = cut(placed.select("vec", "copies", "node", F.size("vec").alias("d"), F.expr(f"node div {per}").alias("block")).groupBy("d", "block").applyInArrow(block, "d int, block bigint, lo array<double>, hi array<double>, nodes binary, copies binary, vectors binary"))
    corner = lambda f, c: F.transform(F.sequence(F.lit(0), F.size(F.first(c)) - 1), lambda k: f(F.transform(F.collect_list(c), lambda x: x[k])))
    boxes = blocks.select("d", "block", "lo", "hi").withColumn("tile", F.expr(f"block div {TILE}"))
    tiles = boxes.groupBy("d", "tile").agg(corner(F.array_min, "lo").alias("lo2"), corner(F.array_max, "hi").alias("hi2"))
    cells = lambda lo, hi, k, wide: F.explode(F.sequence(F.floor(F.col(lo)[k] / eps) - wide, F.floor(F.col(hi)[k] / eps) + wide))
    one = boxes.select("d", "block", "tile", "lo", "hi").withColumn("x", cells("lo", "hi", 0, 1)).withColumn("y", cells("lo", "hi", 1, 1))
    two = tiles.select("d", F.col("tile").alias("to"), "lo2", "hi2").withColumn("x", cells("lo2", "hi2", 0, 0)).withColumn("y", cells("lo2", "hi2", 1, 0))
    gaps = F.zip_with(F.zip_with("lo", "hi2", lambda x, y: x - y), F.zip_with("lo2", "hi", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    # of two tiles the lower one holds where their sum is even, so that none holds for all others
    turn = F.when((F.col("tile") + F.col("to")) % 2 == 0, F.col("to") < F.col("tile")).otherwise(F.col("to") > F.col("tile"))
    meets = one.join(two, ["d", "x", "y"]).where((F.col("to") == F.col("tile")) | turn).where(apart <= 2 - 2 * threshold + SLACK).select("d", "block", "to").distinct()
    meets = meets.withColumn("rank", F.when(F.expr(f"block div {TILE}") == F.col("to"), 0).otherwise(1))
    sent = blocks.join(meets, ["d", "block"]).select("d", "to", "rank", "block", "nodes", "copies", "vectors")
    both = sent.repartition("d", "to").sortWithinPartitions("d", "to", "rank", "block")

    def compare(batches):
        held: list = []
        now = None

        def links(x, y, same):
            counts, labels = join_blocks(x[1], y[1], same, threshold)
            ids = x[0] if same else np.concatenate((x[0], y[0]))
            linked, moved = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(labels)))
            out = [np.concatenate(z) for z in ((ids[linked], ids[moved]), (np.full(len(linked), -1), ids[labels[moved]]), (counts[linked].astype("i8"), np.zeros(len(moved), "i8")))]
            for at in range(0, len(out[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(z[at : at + (1 << 16)]) for z in out], names=["a", "b", "n"])

        for b in batches:
            for r in range(b.num_rows):
                d, to, rank = (b.column(c)[r].as_py() for c in range(3))
                if now != (d, to):
                    now, held = (d, to), []
                v = [b.column(c)[r].as_buffer() for c in (4, 5, 6)]
                new = np.frombuffer(v[0], "<i8"), _Side(np.frombuffer(v[2], word).reshape(-1, d), np.frombuffer(v[1], "<i8"), axes[d])
                for x in held:
                    yield from links(x, new, False)
                if rank == 0:  # a block of the tile itself
                    yield from links(new, new, True)
                    held.append(new)

    found = cut(both.mapInArrow(compare, "a bigint, b bigint, n bigint"))
    roots = components(found.where("b >= 0").select("a", "b"))
    counts = found.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labelled = placed.select("node", "vec", "least_id", "copies").join(roots, "node", "left").join(counts, "node", "left").select("vec", "least_id", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    labelled = cut(labelled)
    names = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = cut(labelled.join(names, "root").select("vec", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id"))
    result = fine.join(known, "vec").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    return result.unionByName(alone.withColumn("kept", F.col("vec_id").isNotNull()))
