"""Mixing sources to target weights: hash-random order, prefix sums, exact budgets.

Sizes are words (``[^\\x20\\x09-\\x0D]+``).  Each document gets a hash-random key;
the rows ``(source, key, doc_id, size)``, never the texts, are range-sorted by
source and key.  A running sum inside each range and the sum of the ranges
before it give every document its exact place in its source.  A source's budget
is whole passes over the source plus a rest; the rest is cut at the exact word.

A hot source spans many ranges, as the ranges follow the key too; no task gets
a whole source.  The driver sees one row per (range, source) and one per source.

Edge cases: null text: size 0; a null source is a source of its own, last in
order; repeated rows are mixed as rows of their own; a source without words has
target 0; a long text counts whole; other columns, whatever their names, aren't
read by :func:`mix`; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, cut

#: No document is used more often than this.
MOST = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` -> also ``target`` (double), one row a source.

    Water filling in closed form: with sources by rising cap / weight, a source
    is capped if its share of what the capped ones before it leave is above its
    cap.  Whole numbers up to the one division, so reruns agree to the bit.
    """
    by_code_point = W.orderBy(F.col("source").asc_nulls_last())  # one row a source
    s = sizes.withColumn("weight", ((F.row_number().over(by_code_point) - 1) % 3 + 1).cast("bigint"))
    dec = lambda c: F.col(c).cast("decimal(38,0)")
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    s = s.withColumn("cap", F.lit(most) * F.col("source_size")).withColumns(
        {
            "left": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weights": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    s = s.withColumn("capped", dec("weight") * dec("left") > dec("cap") * dec("weights"))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("left").alias("left"), F.col("weights").alias("weights")))).over(every)
    share = F.col("weight") * first["left"] / first["weights"]
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _key(doc_id: str, text: str) -> Column:
    """The hash-random key of a row."""
    body = F.md5(F.coalesce(F.col(text), F.lit("")))
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), body))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """``doc_id, source, key, size, source_size, target, taken``, one row per row of ``docs``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), _key(doc_id, text).alias("key"))
    spark = docs.sparkSession
    rows = cut(rows)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, F.col("source").asc_nulls_last(), "key").sortWithinPartitions(F.col("source").asc_nulls_last(), "key", "size")

    def running(batches):
        import numpy as np
        from pyspark import TaskContext

        part, last, total = TaskContext.get().partitionId(), (), 0
        for b in batches:
            names, sizes = b.column(1), np.asarray(b.column(2), "int64")
            if not len(sizes):
                continue
            codes = pa.compute.dictionary_encode(names, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(codes)) + 1
            before = np.cumsum(sizes) - sizes
            starts = np.concatenate(([0], cuts))
            base = np.repeat(before[starts], np.diff(np.concatenate((starts, [len(sizes)]))))
            before = before - base
            if last == (names[0].as_py(),):  # the source goes on from the batch before
                before[: cuts[0] if len(cuts) else len(sizes)] += total
            total, last = int(before[-1] + sizes[-1]), (names[len(sizes) - 1].as_py(),)
            yield pa.RecordBatch.from_arrays([b.column(0), names, b.column(2), pa.array(np.full(len(sizes), part, "int32")), pa.array(before), b.column(3)], names=["doc_id", "source", "size", "part", "before", "key"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    summed = cut(ranged.mapInArrow(running, f"doc_id {id_type}, source string, size bigint, part int, before bigint, key string"))
    parts = summed.groupBy("part", "source").agg(F.sum("size").alias("part_size"))
    along = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("part", "source", F.coalesce(F.sum("part_size").over(along), F.lit(0)).alias("offset"))
    goals = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), most)
    known = offsets.alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("part", F.col("o.source").alias("src"), "offset", "source_size", "target")
    placed = summed.join(known, (summed.part == known.part) & summed.source.eqNullSafe(known.src)).select(summed.doc_id, summed.source, "key", "size", "source_size", "target", (F.col("before") + F.col("offset")).alias("place"))
    budget = F.floor("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("bigint")
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("place")))
    return placed.select("doc_id", "source", "key", "size", "source_size", "target", taken.cast("bigint").alias("taken"))


def take(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """The mix itself: ``docs`` with a row for each time that the mix takes it.

    The document at a source's cut is taken up to the word where the budget
    ends.  Rows equal in id, source and text are copies of one row (their extra
    columns come from one of them); documents without words are in no mix.
    ``__key``, ``__whole``, ``__rest`` and ``__turn`` are refused as columns.
    """
    if clash := {"__key", "__whole", "__rest", "__turn"} & set(docs.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    plan = mix(docs, text, source, doc_id, most).where("taken > 0")
    named = lambda k, name: F.md5(F.concat(k, F.coalesce(F.concat(F.lit("="), name), F.lit("-"))))
    plan = plan.groupBy(named(F.col("key"), F.col("source")).alias("__key")).agg(F.sum(F.expr("taken div size")).alias("__whole"), F.sum(F.expr("taken % size")).cast("int").alias("__rest"))
    blank = r"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]+"
    both = docs.withColumn("__key", named(_key(doc_id, text), F.col(source))).dropDuplicates(["__key"]).join(plan, "__key")  # one exchange: texts move once
    every = both.withColumn("__turn", F.explode(F.sequence(F.lit(1), (F.col("__whole") + F.when(F.col("__rest") > 0, 1).otherwise(0)).cast("int"))))
    after = F.element_at(F.split(F.col(text), blank, F.col("__rest") + 1), -1)  # what follows the last word taken
    part = F.left(F.col(text), F.length(text) - F.length(after))
    return every.withColumn(text, F.when(F.col("__turn") > F.col("__whole"), part).otherwise(F.col(text))).select(*docs.columns)
