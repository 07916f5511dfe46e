"""What the operators of this subpackage share: checkpoints, tables, components."""

from __future__ import annotations

import uuid
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, and what parts words: ASCII white space only.  Fixed by contract.
WORD = r"[^\x20\x09-\x0D]+"


#: Session setting with the secret key of surrogates, and what stands for it in a demonstration.
PII_KEY, DEMONSTRATION = "spark.tesserae.pii.key", "not a secret"


def pii_key(spark: SparkSession) -> bytes:
    """The key that the session is configured with; without one a demonstration key, with a warning."""
    key = spark.conf.get(PII_KEY, None)
    if not key:
        warnings.warn(f"{PII_KEY} is not set: surrogates can be undone by anybody", stacklevel=2)
    return (key or DEMONSTRATION).encode()


#: Rows whose Python values a worker holds side by side: an Arrow batch may have 10 000 whole texts.
SLICE_ROWS = 512


def slices(batches, rows: int = SLICE_ROWS):
    """The rows of Arrow batches, ``rows`` at a time, so that a worker's memory doesn't grow with a batch's texts."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        pa.default_memory_pool().release_unused()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    (a local session, as in tests) a folder under the warehouse is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tesserae/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete what :func:`staged` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges``: two columns ``a``, ``b`` of one type, in any direction, repeats
    allowed.  Returns ``node``, ``root`` (the smallest node reachable) for each
    node with a link.  Every round is a pre-aggregated minimum and an equi-join,
    so a hub only makes a skewed join, which AQE splits; its result is
    checkpointed.  The driver sees two numbers a round, no edges.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        d = both(e)
        least = d.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        return d.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        d = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
        least = d.groupBy("a").agg(F.min("b").alias("m"))
        moved = d.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        e = cut(small(large(e)))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
