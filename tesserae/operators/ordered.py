"""Global orders without a global window: ranges sorted by themselves, and sums carried from one to the next."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tesserae.sources.shared import cut


def numbered(df: DataFrame, *order: str | Column, to: str = "n") -> DataFrame:
    """``df`` with its place (from 0) in the whole order.

    The rows are dealt into ranges of the order and sorted there; the driver adds up
    one count a range.  ``order`` should tell all rows apart, or ties may be numbered
    otherwise by another run.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    ranges = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", at))
    part = F.shiftright("__at", 33).cast("int")
    sizes = {r.p: r["count"] for r in ranges.groupBy(part.alias("p")).count().collect()}
    before = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)), initial=0))
    base = F.element_at(F.lit(before), part + 1)
    return ranges.withColumn(to, base + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def split(df: DataFrame, k: int, *order: str, refine: int = 64) -> tuple[DataFrame, DataFrame]:
    """The ``k`` first rows of ``df`` in ``order`` (ascending, nulls first) and all others, by the k-th key: no task sorts them.

    Between the bounds left over, each round takes some values of the first column that
    are there and counts the rows up to each; the ``k``-th row lies between two of
    them, and the next round looks there.  Within the ties of what it finds, the next
    column goes on.  Both sides are then filters on ``df``, which is read once more for
    each round and should be a table.  Only where rows tie in all of ``order``, and not all of them
    belong to one side, these are numbered.
    """
    if k <= 0:
        return df.limit(0), df
    same, below, todo = F.lit(True), F.lit(False), k
    for name in order:
        rows = df.where(same)
        value = _kth(rows, name, todo, refine)
        if value is _ALL:
            break
        less = _less(name, value)
        todo -= rows.where(less).count()
        below, same = below | (same & less), same & F.col(name).eqNullSafe(F.lit(value))
    tied = df.where(same).count()
    if tied <= todo:
        taken = below | same
        return df.where(taken), df.where(~taken)
    ties = numbered(df.where(same), *order, to="__n")
    some = lambda c: ties.where(c).drop("__n")
    return df.where(below).unionByName(some(F.col("__n") < todo)), df.where(~below & ~same).unionByName(some(F.col("__n") >= todo))


_ALL = object()
#: So many values are looked at by the driver.
FEW = 4096


def _less(name: str, value) -> Column:
    """Before ``value``, nulls first; never null."""
    return F.lit(False) if value is None else F.coalesce(F.col(name) < F.lit(value), F.lit(True))


def _probe(rows: DataFrame, column: Column, refine: int) -> list:
    """Some values of a column, in order: quantiles of numbers, else those of the least hashes."""
    if isinstance(rows.select(column).schema[0].dataType, NumericType):
        at = [(i + 1) / (refine + 1) for i in range(refine)]
        return sorted(set(rows.agg(F.percentile_approx(column, at, 1000)).first()[0]))
    return sorted({r[0] for r in rows.select(column, F.xxhash64(column).alias("h")).orderBy("h").limit(refine).collect()})


def _kth(rows: DataFrame, name: str, k: int, refine: int):
    """The ``k``-th smallest value (from 1) of a column, nulls first; ``_ALL`` if there are fewer rows, or just as many."""
    column = F.col(name)
    n, nulls = rows.agg(F.count("*"), F.count_if(column.isNull())).first()
    if n <= k:
        return _ALL
    if k <= nulls:
        return None
    inside, k, n = column.isNotNull(), k - nulls, n - nulls
    while n > FEW:
        cuts = _probe(rows.where(inside), column, refine)
        aggregates = [F.count_if(column <= F.lit(v)) for v in cuts] + [F.count_if(column == F.lit(v)) for v in cuts]
        counts = rows.where(inside).agg(*aggregates).first()
        upto, equal = counts[: len(cuts)], counts[len(cuts) :]
        at = next((i for i, c in enumerate(upto) if c >= k), len(cuts))
        high, low = n, upto[at - 1] if at else 0
        if at < len(cuts):
            high = upto[at] - equal[at]
            if k > high:
                return cuts[at]
            inside = inside & (column < F.lit(cuts[at]))
        if at:
            inside = inside & (column > F.lit(cuts[at - 1]))
        k, n = k - low, high - low
    return sorted(r[0] for r in rows.where(inside).select(column).collect())[k - 1]
