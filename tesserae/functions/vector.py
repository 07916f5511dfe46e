"""Vector and number expressions in the JVM; the byte codec and scans of many vectors run on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
DECAY_DAYS = 90


def dot(a: Column, b: Column) -> Column:
    """Dot product, summed in double from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in double; 0 for empty, zero or differently long vectors and nulls.

    Norms known beforehand save two of the three passes a pair.
    """
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 0) & (nb > 0)
    return F.when(fine, dot(a, b) / (na * nb)).otherwise(F.lit(0.0))


def freshness(last_accessed: Column, now: int) -> Column:
    """1 falling to 0.5 over 90 days; 1 for never accessed and for the future."""
    age = (F.lit(now) - last_accessed).cast("double") / F.lit(float(DECAY_DAYS * DAY))
    return F.when((last_accessed <= 0) | (age < 0), 1.0).when(age >= 1, 0.5).otherwise(1.0 - age * 0.5)


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a.cast("double") / F.when(b == 0, 1).otherwise(b))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / F.when(p + r == 0, 1.0).otherwise(p + r))


def round_to(x: Column, digits: int) -> Column:
    """Half away from zero, by whole numbers."""
    m = float(10**digits)
    return F.when(x >= 0, F.floor(x * m + 0.5)).otherwise(F.ceil(x * m - 0.5)).cast("double") / m


def float_range(low: float, high: float, step: float, digits: int = 4) -> list[float]:
    """``low, low + step ...`` up to ``high`` with a tolerance of 1e-9, rounded; a step of 0 or less gives one value."""
    if step <= 0:
        return [low]
    n = int((high + 1e-9 - low) / step)
    return [round(low + i * step, digits) for i in range(n + 1)] if n >= 0 else []


def near(score: Column, threshold: Column | float, band: float = 0.05) -> Column:
    return score <= threshold + F.lit(band)


def encode_f32(column: str) -> Column:
    """ARRAY<FLOAT> as little-endian bytes, Arrow batch by batch."""
    @F.pandas_udf("binary")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(column)


def decode_f32(column: str) -> Column:
    """Little-endian bytes as ARRAY<FLOAT>; up to three bytes that are left over go."""
    @F.pandas_udf("array<float>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // 4 * 4], "<f4"))

    return run(column)


def as_matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """A batch's vectors as doubles, and which of them have ``dim`` components, none null; the others are zeros."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()  # of the rows that are not null
    if dim and flat.null_count == 0 and (sizes == dim).all():
        return flat.to_numpy(zero_copy_only=False).reshape(-1, dim).astype("f8"), np.ones(len(sizes), bool)
    out, fine = np.zeros((len(sizes), dim)), np.zeros(len(sizes), bool)
    rows = np.flatnonzero(sizes == dim) if dim else np.zeros(0, "i8")
    if len(rows):
        starts = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])[rows]
        at = starts[:, None] + np.arange(dim)
        whole = flat.is_valid().to_numpy(zero_copy_only=False)[at].all(axis=1)
        out[rows[whole]] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)[at[whole]]
        fine[rows[whole]] = True
    return out, fine


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from left to right as :func:`dot` does, so equal rows have equal sums wherever they stand."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, np.broadcast_to(b, a.shape).T):
        out += x * y
    return out


def cosine_to(vector: Column, query: list[float]) -> Column:
    """:func:`cosine` with one vector, Arrow batch by batch: the same bits, without an expression step a component."""
    q = np.asarray(query, "f8")
    norm_q = np.sqrt(dots(q[None], q)[0])

    @F.arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        m, fine = as_matrix(v, len(q))
        with np.errstate(all="ignore"):
            n = np.sqrt(dots(m, m))
            fine &= ~(n <= 0) & ~(norm_q <= 0)
            return pa.array(np.where(fine, dots(m, q) / (n * norm_q), 0.0))

    return run(vector)


class BestCosines:
    """The best ``k`` of a task's rows for each of many queries of one length.

    A matrix product finds what can be among the best ``k`` of the rows seen so far
    and not below ``floor`` (a score that ``k`` rows anywhere are known to reach);
    only that is scored exactly.  Rows and queries without a cosine score 0.
    """

    SLACK = 1e-9  #: more than the rounding of a matrix product of unit vectors
    ROWS = 2048

    def __init__(self, ids: pa.Array, queries: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, np.asarray(queries, "f8").reshape(len(ids), -1), k
        with np.errstate(all="ignore"):
            self.norms = np.sqrt(dots(self.queries, self.queries))
            self.unit = np.where((self.norms > 0)[:, None], self.queries / self.norms[:, None], 0.0).T.copy()
        self.least = np.full(len(ids), -np.inf) if floor is None else np.where(np.isnan(floor), -np.inf, floor)
        self.seen = np.full((len(ids), k), -np.inf)

    def feed(self, batch):
        """From a batch of ``id, vector``: batches of ``query_id, id, score`` that hold each query's best ``k`` of all so far, and few others."""
        for at in range(0, batch.num_rows, self.ROWS):
            part = batch.slice(at, self.ROWS)
            m, fine = as_matrix(part.column(1), self.queries.shape[1])
            with np.errstate(all="ignore"):
                n = np.sqrt(dots(m, m))
                fine &= ~(n <= 0)
                rough = (m / np.where(fine, n, 1.0)[:, None]) @ self.unit
            if not fine.all():
                rough[~fine] = 0.0
            if np.isnan(rough.max(axis=0)).any():
                rough[np.isnan(rough)] = np.inf
            some = rough.T if len(rough) <= self.k else rough.max(axis=0)[:, None] if self.k == 1 else np.partition(rough, len(rough) - self.k, axis=0)[-self.k :].T
            both = np.concatenate([self.seen, some], axis=1)
            self.seen = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            r, q = np.nonzero(rough >= np.maximum(self.seen.min(axis=1), self.least) - self.SLACK)
            for lo in range(0, len(r), 1 << 14):
                i, j = r[lo : lo + (1 << 14)], q[lo : lo + (1 << 14)]
                with np.errstate(all="ignore"):
                    score = np.where(fine[i] & ~(self.norms[j] <= 0), dots(m[i], self.queries[j]) / (n[i] * self.norms[j]), 0.0)
                yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(j)), part.column(0).take(pa.array(i)), pa.array(score)], names=["query_id", "id", "score"])


def nearest(batches, known: pa.Table, threshold: float, kind: pa.DataType, rows: int = 256):
    """From batches of ``new_id, vector``: ``new_id, id, score`` of each row's most similar ``known`` (``id, vector``) above ``threshold``.

    Ties go to the smallest id.  ``threshold`` is 0 or more; vectors without a
    finite cosine are similar to nothing.
    """
    slack = 1e-9
    ids, vectors = known.column(0).to_numpy(zero_copy_only=False), known.column(1).combine_chunks()
    groups = []
    for dim in pc.unique(pc.list_value_length(vectors)).to_pylist():
        if dim:
            m, fine = as_matrix(vectors, dim)
            n = np.sqrt(dots(m, m))
            at = np.flatnonzero(fine & (n > 0) & np.isfinite(n))
            groups.append((dim, ids[at], m[at], n[at], (m[at] / n[at, None]).T))
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            for dim, names, m, n, unit in groups:
                mine, fine = as_matrix(part.column(1), dim)
                with np.errstate(all="ignore"):
                    norms = np.sqrt(dots(mine, mine))
                    at = np.flatnonzero(fine & (norms > 0) & np.isfinite(norms))
                if not len(at) or not len(names):
                    continue
                mine, norms = mine[at], norms[at]
                rough = (mine / norms[:, None]) @ unit
                r, q = np.nonzero(rough >= np.maximum(rough.max(axis=1, keepdims=True), threshold) - slack)
                score = dots(mine[r], m[q]) / (norms[r] * n[q])
                r, q, score = (x[score > threshold] for x in (r, q, score))
                order = np.lexsort((names[q].astype(str), -score, r))
                first = order[np.unique(r[order], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at[r[first]])), pa.array(names[q[first]], kind), pa.array(score[first])], names=["new_id", "id", "score"])
