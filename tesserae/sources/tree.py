"""A batch source of the files of projects: listed in parallel, pruned before anything is opened.

A folder that is excluded, or is a repository of its own, is not listed, and nothing
below it is opened.  Of a file its first 512 bytes are read; one with a NUL among them is
binary and is read no further.  Every file and every pruned folder is one row that says why:

``index`` (with ``content`` and ``hash``), ``user`` (a glob of the user matches its path or
a component), ``default`` (a folder that is never indexed), ``sub_repo`` (a repository right
under the root), ``nested_repo`` (one deeper down), ``binary``, and ``error`` (what could not
be listed or read, with its message; the others go on).

The driver's worker lists the first folders until there are enough for all tasks; each
task walks its folders and gives its rows in batches of some megabytes, so memory holds a
batch and the largest file.  Roots are mounted on all executors.  Symbolic links to
folders aren't followed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserae.operators.index import DEFAULT_EXCLUDES, glob_regex
from tesserae.sources.growing import mounted

SNIFF = 512
BATCH_BYTES = 8 << 20
#: Work items that the first listing aims at, and files of one item.
ITEMS, ITEM_FILES = 256, 512
SCHEMA = "project string, path string, reason string, size bigint, mtime bigint, hash string, content binary, error string"


@dataclass
class Work(InputPartition):
    """Folders to walk, and files to judge, as (project, root, path below it)."""

    folders: list
    files: list


class Tree:
    """What becomes of each entry under a root."""

    def __init__(self, globs: list[str]):
        self.globs = [re.compile(glob_regex(g)) for g in globs]

    def pruned(self, path: str, name: str) -> str | None:
        """A path whose folders above are not excluded."""
        if any(g.match(path) or g.match(name) for g in self.globs):
            return "user"
        return "default" if name in DEFAULT_EXCLUDES else None

    def above(self, start: str) -> str | None:
        """What prunes a folder to begin with, or one above it."""
        parts = start.split("/") if start else []
        return next((r for i, name in enumerate(parts) if (r := self.pruned("/".join(parts[: i + 1]), name))), None)

    def entries(self, root: str, folder: str):
        """``path, reason`` of a folder's entries; reason ``walk`` for a folder to go on with, ``file`` for a file to look at."""
        with os.scandir(os.path.join(root, folder)) as found:
            for e in sorted(found, key=lambda e: e.name):
                path = f"{folder}/{e.name}" if folder else e.name
                if reason := self.pruned(path, e.name):
                    yield path, reason, None
                elif not e.is_dir(follow_symlinks=False):
                    yield path, "file", None
                elif os.path.lexists(os.path.join(e.path, ".git")):
                    yield path, "nested_repo" if folder else "sub_repo", None
                else:
                    yield path, "walk", None


def look(path: str) -> tuple:
    """``reason, size, mtime, hash, content`` of a file."""
    with open(path, "rb") as f:
        stat = os.fstat(f.fileno())
        head = f.read(SNIFF)
        if b"\0" in head:
            return "binary", stat.st_size, int(stat.st_mtime), None, None
        content = head + f.read()
    return "index", stat.st_size, int(stat.st_mtime), hashlib.sha256(content).hexdigest(), content


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [(p, mounted(r), start) for p, r, start in json.loads(options["roots"])]
        self.tree = Tree(json.loads(options.get("excludes", "[]")))
        self.items = int(options.get("items", ITEMS))

    def partitions(self):
        folders, files = [], []
        for project, root, start in self.roots:
            if reason := self.tree.above(start):
                files.append((project, root, start, reason))
            else:
                folders.append((project, root, start))
        at = 0
        while at < len(folders) and len(folders) - at + len(files) // ITEM_FILES < self.items:
            project, root, folder = folders[at]
            try:
                below = list(self.tree.entries(root, folder))
            except OSError:  # the task that gets it tells
                files.append((project, root, folder, "walk"))
                at += 1
                continue
            at += 1
            folders += [(project, root, path) for path, reason, _ in below if reason == "walk"]
            files += [(project, root, path, reason) for path, reason, _ in below if reason != "walk"]
        work = [Work([f], []) for f in folders[at:]]
        return work + [Work([], files[i : i + ITEM_FILES]) for i in range(0, len(files), ITEM_FILES)] or [Work([], [])]

    def _rows(self, work: Work):
        for project, root, path, reason in work.files:
            yield from self._one(project, root, path, reason)
        for project, root, folder in work.folders:
            yield from self._one(project, root, folder, "walk")

    def _one(self, project, root, path, reason):
        try:
            if reason == "walk":
                todo = [path]
                while todo:
                    folder = todo.pop()
                    try:
                        below = list(self.tree.entries(root, folder))
                    except OSError as e:
                        yield project, folder, "error", None, None, None, None, e.strerror
                        continue
                    for name, why, _ in below:
                        if why == "walk":
                            todo.append(name)
                        else:
                            yield from self._one(project, root, name, why)
            elif reason == "file":
                why, size, mtime, digest, content = look(os.path.join(root, path))
                yield project, path, why, size, mtime, digest, content, None
            else:
                yield project, path, reason, None, None, None, None, None
        except OSError as e:
            yield project, path, "error", None, None, None, None, e.strerror

    def read(self, work: Work):
        import pyarrow as pa

        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        held, size = [], 0
        for row in self._rows(work):
            held.append(row)
            size += len(row[6] or b"") + 256
            if size >= BATCH_BYTES:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, excludes: list[str] | None = None, include: list[str] | None = None, items: int = ITEMS) -> DataFrame:
    """``project, path, reason, size, mtime, hash, content, error`` of a root (project '').

    ``include``: folders below it to walk instead of all.
    """
    return _load(spark, [("", root, i) for i in include or [""]], excludes, items)


def scan_with_repos(spark: SparkSession, root: str, excludes: list[str] | None = None, items: int = ITEMS) -> DataFrame:
    """:func:`scan` of the root, and of each repository right under it as a project of its own.

    Repositories that the user excludes are not scanned; one that can't be listed is an
    ``error`` row of its project, and the others go on.
    """
    top, tree = mounted(root), Tree(excludes or [])
    repos = sorted(path for path, reason, _ in tree.entries(top, "") if reason == "sub_repo")
    return _load(spark, [("", root, ""), *((r, f"{root}/{r}", "") for r in repos)], excludes, items)


def _load(spark: SparkSession, roots: list, excludes: list[str] | None, items: int) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("project_tree").option("roots", json.dumps(roots)).option("excludes", json.dumps(excludes or [])).option("items", str(items)).load()


def counters(scanned: DataFrame) -> DataFrame:
    """``project, reason, n, bytes``: how many files and folders of each fate, and the bytes read as text."""
    return scanned.groupBy("project", "reason").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes"))
