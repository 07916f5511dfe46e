import os

import pytest

from tesserae.sources import growing
from tesserae.streaming import rules


class Follower:
    """A followed folder; each step is a query of its own, so every step restarts from the checkpoint."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.tmp, self.options = spark, tmp_path, options
        self.folder = tmp_path / "logs"
        self.folder.mkdir()

    def step(self):
        stream = growing.lines(self.spark, str(self.folder), **self.options)
        stream.writeStream.format("parquet").option("path", str(self.tmp / "out")).option("checkpointLocation", str(self.tmp / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.value for r in self.spark.read.schema("file string, at bigint, value string").parquet(str(self.tmp / "out")).collect())

    def append(self, name, text):
        with open(self.folder / name, "a") as f:
            f.write(text)


def test_appends_truncation_rotation_and_restarts(spark, tmp_path):
    f = Follower(spark, tmp_path)
    f.append("a.log", "a1\na2\nhalf")
    f.append("b.log", "b1\n")
    assert f.step() == ["a1", "a2", "b1"]  # the open line waits
    assert f.step() == ["a1", "a2", "b1"]
    f.append("a.log", " done\na4\n")
    assert f.step() == ["a1", "a2", "a4", "b1", "half done"]
    f.append("a.log", "a5\n")
    os.rename(f.folder / "a.log", f.folder / "a.log.1")  # rotated with a line that nobody has read
    f.append("a.log", "c1\nc2\nc3\nc4\nc5\nc6\nc7\n")  # longer than what was there
    got = f.step()
    assert got == sorted(["a1", "a2", "a4", "a5", "b1", "half done", *[f"c{i}" for i in range(1, 8)]])
    (f.folder / "b.log").write_text("d1\n")  # truncated to the same size, in place
    os.truncate(f.folder / "a.log", 0)
    f.append("a.log", "e1\n")
    got2 = f.step()
    assert got2 == sorted([*got, "d1", "e1"])
    os.truncate(f.folder / "a.log", 0)
    assert f.step() == got2
    f.append("a.log", "f1\n")
    os.remove(f.folder / "b.log")
    assert f.step() == sorted([*got2, "f1"])


def test_ranges_split_within_lines(spark, tmp_path):
    f = Follower(spark, tmp_path, split=10, pattern="*.log")
    want = ["x" * n for n in (0, 3, 40, 9, 10, 11, 0, 0, 25, 1)]
    f.append("a.log", "\n".join(want) + "\r\n")
    f.append("a.txt", "not followed\n")
    (f.folder / "sub.log").mkdir()
    assert f.step() == sorted(want)
    f.append("a.log", "new\xe9\n")
    assert f.step() == sorted([*want, "new\xe9"])


def test_offsets_tell_growth_from_a_new_file():
    was = {"1-1": {"name": "a", "end": 20, "head": "0123456789"}}
    same = growing.spans(was, {"1-1": {"name": "b", "end": 50, "head": "0123456789abc"}}, 20)
    assert [(s.name, s.first, s.start, s.stop) for s in same] == [("b", 20, 20, 40), ("b", 20, 40, 50)]
    for now in ({"name": "a", "end": 10, "head": "0123456789"}, {"name": "a", "end": 50, "head": "x123456789"}):
        assert [(s.start, s.stop) for s in growing.spans(was, {"1-1": now}, 100)] == [(0, now["end"])]
    assert growing.spans(was, was, 10) == [] and growing.spans(was, {}, 10) == []


def test_a_file_that_is_gone_fails_and_one_written_anew_waits(tmp_path):
    reader = growing.GrowingReader({"path": f"file:{tmp_path}"})
    (tmp_path / "a").write_text("one\ntwo\n")
    (span,) = reader.partitions({}, reader.latestOffset())
    os.rename(tmp_path / "a", tmp_path / "z")
    assert [b.column(2).to_pylist() for b in reader.read(span)] == [["one", "two"]]
    (tmp_path / "z").write_text("other\n")
    assert list(reader.read(span)) == []
    os.remove(tmp_path / "z")
    with pytest.raises(FileNotFoundError):
        list(reader.read(span))
    with pytest.raises(ValueError, match="mounted"):
        growing.mounted("hdfs://x/y")


def test_follow_gives_values(spark, tmp_path):
    assert rules.follow(spark, str(tmp_path)).columns == ["value"]
