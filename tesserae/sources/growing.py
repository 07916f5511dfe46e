"""A streaming source of the lines of growing files: byte offsets, truncation and rotation told apart.

Spark's own file source takes each file once, so what is appended to a log that was
read never comes.  Here a stream's offset holds, for each file of a folder, up to
which byte it has whole lines, and the first bytes of the file.  A batch reads from
the last offset to this one:

* a file that has grown goes on where it was;
* a file whose offset has shrunk, or that begins otherwise than before, was truncated
  or written anew, and is read from its start;
* a file is known by device and inode, so one that is renamed (rotation) goes on under
  its new name, and what takes its old name is a new file.

Offsets live in the query's checkpoint: a restarted query reads each batch again between
the same offsets, so no line is lost or doubled.  A last line without its end waits.
Ranges longer than ``split`` bytes are cut, so one large file spreads over tasks; a task
streams its range and holds a few thousand lines.

The folder is one that the driver and all executors have mounted.  Bytes that were
truncated away before a batch came to read them are gone, as for any reader; a file cut and
written anew with the same first ``HEAD`` bytes beyond the old offset between two batches
can't be told from one that has grown.  An offset has an entry a file that is in the folder.
"""

from __future__ import annotations

import fnmatch
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file's beginning that tell it from what replaces it.
HEAD = 64
SPLIT = 64 << 20
ROWS = 4096


def mounted(folder: str) -> str:
    """``folder`` as a path of the local file system, where it has to be mounted."""
    path = folder.removeprefix("file:")
    if ":" in path.split("/")[0]:
        raise ValueError(f"{folder} is not a mounted folder")
    return "/" + path.lstrip("/") if folder.startswith("file:") else path


def _key(stat: os.stat_result) -> str:
    return f"{stat.st_dev}-{stat.st_ino}"


def _last_line_end(f, size: int, block: int = 1 << 16) -> int:
    """The place behind the last line end below ``size``."""
    at = size
    while at > 0:
        start = max(0, at - block)
        f.seek(start)
        found = f.read(at - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        at = start
    return 0


def _look(folder: str, pattern: str) -> dict:
    """The files of ``folder`` by device and inode: name, place behind the last whole line, first bytes."""
    found = {}
    for entry in os.scandir(folder):
        if not fnmatch.fnmatch(entry.name, pattern) or not entry.is_file():
            continue
        try:
            with open(entry.path, "rb") as f:
                stat = os.fstat(f.fileno())
                end = _last_line_end(f, stat.st_size)
                f.seek(0)
                head = f.read(min(HEAD, end)).decode("latin-1")
        except FileNotFoundError:  # renamed or removed meanwhile: the next batch sees it
            continue
        found[_key(stat)] = {"name": entry.name, "end": end, "head": head}
    return found


@dataclass
class Span(InputPartition):
    """Lines that begin in ``[start, stop)`` of a file, whose ranges of this batch begin at ``first``."""

    key: str
    name: str
    head: str
    first: int
    start: int
    stop: int


def spans(start: dict, end: dict, split: int) -> list[Span]:
    """What came between two offsets."""
    out = []
    for key, now in sorted(end.items()):
        was = start.get(key)
        grown = was is not None and was["end"] <= now["end"] and now["head"].startswith(was["head"])
        first = was["end"] if grown else 0
        for at in range(first, now["end"], split):
            out.append(Span(key, now["name"], now["head"], first, at, min(at + split, now["end"])))
    return out


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.pattern = mounted(options["path"]), options.get("pattern", "*")
        self.split = int(options.get("split", SPLIT))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _look(self.folder, self.pattern)

    def partitions(self, start: dict, end: dict):
        return spans(start, end, self.split)

    def _open(self, span: Span):
        """The file by name, or wherever in the folder it has been moved."""
        names = [span.name, *sorted(n for n in os.listdir(self.folder) if n != span.name)]
        for name in names:
            try:
                f = open(os.path.join(self.folder, name), "rb")  # noqa: SIM115
            except (FileNotFoundError, IsADirectoryError):
                continue
            if _key(os.fstat(f.fileno())) == span.key:
                return f
            f.close()
        raise FileNotFoundError(f"{span.name} has left {self.folder} before it was read")

    def read(self, span: Span):
        import pyarrow as pa

        with self._open(span) as f:
            if f.read(len(span.head)).decode("latin-1") != span.head:
                return  # written anew since: the next batch reads it from its start
            at = span.start
            if at > span.first:  # the line that a range begins in is the one before's
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            rows: list = []
            while at < span.stop:
                line = f.readline()
                if not line:
                    break
                rows.append((span.name, at, line.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")))
                at += len(line)
                if len(rows) == ROWS or at >= span.stop:
                    names, places, values = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(places, pa.int64()), pa.array(values, pa.string())], names=["file", "at", "value"])
                    rows = []


class GrowingText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return "file string, at bigint, value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def lines(spark: SparkSession, folder: str, pattern: str = "*", split: int = SPLIT) -> DataFrame:
    """A stream ``file, at, value``: the lines of the files of ``folder`` that match, as they are appended."""
    spark.dataSource.register(GrowingText)
    return spark.readStream.format("growing_text").option("pattern", pattern).option("split", str(split)).load(folder)
