import threading

import pytest
from pyspark.sql import functions as F

from tesserae.sources import tables


def _rows(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _ids(df):
    return sorted(r.id for r in df.collect())


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.version(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        tables.read(spark, root)
    for n in range(1, 5):
        assert tables.write(_rows(spark, *"abcd"[:n]), root) == n
    assert _ids(tables.read(spark, root)) == ["a", "b", "c", "d"] and _ids(tables.read(spark, root, 3)) == ["a", "b", "c"]
    with pytest.raises(FileNotFoundError):
        tables.read(spark, root, 2)  # dropped
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v3", "v4"]


def test_the_second_of_two_writers_fails_or_goes_on(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write(_rows(spark, "a"), root)
    tables.write(_rows(spark, "b"), root, after=1)
    with pytest.raises(tables.Conflict):
        tables.write(_rows(spark, "c"), root, after=1)
    assert _ids(tables.read(spark, root)) == ["b"]
    for name in "xy":
        _rows(spark, name).write.parquet(f"{root}/.new-{name}")
    assert tables._commit(spark, root, 3, ".new-x") and not tables._commit(spark, root, 3, ".new-y")
    assert _ids(tables.read(spark, root)) == ["x"]


def test_a_writer_that_comes_between_read_and_commit(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write(_rows(spark, "a"), root)
    seen = []

    def change(old):
        seen.append(_ids(old))
        if len(seen) == 1:
            tables.update(spark, root, lambda x: x.unionByName(_rows(spark, "other")))
        return old.unionByName(_rows(spark, "mine"))

    assert tables.update(spark, root, change) == 3
    assert seen == [["a"], ["a", "other"]] and _ids(tables.read(spark, root)) == ["a", "mine", "other"]


def test_concurrent_merges_are_all_kept(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write(_rows(spark, "start"), root)
    failed = []

    def merge(i):
        try:
            tables.update(spark, root, lambda old: old.unionByName(spark.range(1).select(F.lit(f"w{i}").alias("id"))), keep=8)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=merge, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert _ids(tables.read(spark, root)) == ["start", "w0", "w1", "w2", "w3"] and tables.version(spark, root) == 5


def test_properties_of_two_writers(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write_properties(spark, root, {"a": "1", "b": "1"})
    tables.write_properties(spark, root, {"b": "2"})
    assert tables.properties(spark, root) == {"a": "1", "b": "2"}
    with pytest.raises(ValueError, match="no model"):
        tables.verify(spark, root, "m", 3)
    tables.write_properties(spark, root, {"embedding_model": "m:latest", "embedding_dim": "3"})
    tables.verify(spark, root, "m", 3)
    with pytest.raises(ValueError, match="dimensions"):
        tables.verify(spark, root, "m", 4)
