"""Versioned tables on plain Parquet: write a new version, then name it current.

Without a lakehouse format an upsert is a whole new table.  Readers of the old
version go on undisturbed; the version number is the index version that cache
keys hold.  All paths go through Hadoop's file systems.

A writer puts its rows into a folder of its own first, then renames it to the next
version.  The rename is one step that fails where the name is taken, so one writer gets each
number (POSIX and HDFS; object stores have no such operation).  Who comes second fails
if it was told which version it follows (:func:`write` with ``after``), else takes the
next number; :func:`update` applies its change to what the other one wrote and tries
again.  So of two concurrent merges both are kept.  A writer that is lost before its
commit leaves a folder that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def _commit(spark: SparkSession, root: str, n: int, folder: str) -> bool:
    """Make ``folder`` version ``n`` by one rename; false if there is one."""
    jvm = spark.sparkContext._jvm
    (fs, made), (_, target) = _fs(spark, f"{root}/{folder}"), _fs(spark, f"{root}/v{n}")
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.CopyOption, 1)
            options[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
            jvm.java.nio.file.Files.move(local(made), local(target), options)
        else:
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(made, target, none)
    except Exception:
        if fs.exists(target):
            return False
        raise
    return True


def _versions(spark: SparkSession, root: str) -> list[int]:
    fs, p = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def version(spark: SparkSession, root: str) -> int:
    """The current version, 0 for none."""
    return max(_versions(spark, root), default=0)


def read(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """The current version, or version ``at``."""
    found = _versions(spark, root)
    n = max(found, default=0) if at is None else at
    if n not in found:
        raise FileNotFoundError(f"{root} has no version {n}")
    return spark.read.parquet(f"{root}/v{n}")


def write(df: DataFrame, root: str, partition_by: list[str] | None = None, keep: int = 2, after: int | None = None) -> int:
    """Write ``df`` as the next version and return its number; versions before the last ``keep`` go.

    ``after``: the version that ``df`` was made of; if another one has been committed
    since, :class:`Conflict` is raised and nothing changes.
    """
    spark = df.sparkSession
    if after is not None and version(spark, root) != after:
        raise Conflict(f"{root} is past version {after}")
    folder = f".new-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(f"{root}/{folder}")
    n = version(spark, root) + 1 if after is None else after + 1
    while not _commit(spark, root, n, folder):
        if after is not None:
            _drop(spark, f"{root}/{folder}")
            raise Conflict(f"{root} is past version {after}")
        n += 1
    for old in _versions(spark, root):
        if old <= n - keep:
            _drop(spark, f"{root}/v{old}")
    return n


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def update(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], partition_by: list[str] | None = None, keep: int = 2, tries: int = 20) -> int:
    """Commit ``change`` of the current version as the next one; after a conflict once more, on what the other writer left."""
    for _ in range(tries):
        n = version(spark, root)
        try:
            return write(change(read(spark, root, n)), root, partition_by, keep, after=n)
        except Conflict:
            continue
        except Exception:
            if version(spark, root) == n:  # else what was read has been dropped meanwhile
                raise
    raise Conflict(f"{root}: {tries} tries, and each time another writer came first")


def write_properties(spark: SparkSession, root: str, values: dict[str, str]) -> None:
    """Store metadata (model, dimension); keys that are there are replaced, also those that another writer puts meanwhile."""
    at, kind = f"{root}/_properties", "key string, value string"
    new = spark.createDataFrame(list(values.items()), kind).coalesce(1)
    for _ in range(20):
        try:
            if version(spark, at) == 0:
                write(new, at, after=0)
            else:
                update(spark, at, lambda old: old.join(new, "key", "left_anti").unionByName(new).coalesce(1))
            return
        except Conflict:
            continue
    raise Conflict(at)


def properties(spark: SparkSession, root: str) -> dict[str, str]:
    try:
        return {r.key: r.value for r in read(spark, f"{root}/_properties").collect()}
    except FileNotFoundError:
        return {}


def verify(spark: SparkSession, root: str, model: str, dim: int) -> None:
    """The guard before scoring: the stored model (``:latest`` left out) and dimension are the asked ones."""
    stored = properties(spark, root)
    if "embedding_model" not in stored or "embedding_dim" not in stored:
        raise ValueError("the index has no model or dimension")
    if stored["embedding_model"].removesuffix(":latest") != model.removesuffix(":latest") or int(stored["embedding_dim"]) != dim:
        raise ValueError(f"the index is for {stored['embedding_model']} with {stored['embedding_dim']} dimensions")
