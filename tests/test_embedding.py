import threading
import time

import pytest

from tesserae.sources import readers


class Busy:
    """Tells how many calls were under way at once, and how many texts came."""

    now, lock = 0, threading.Lock()

    def __call__(self, texts):
        with Busy.lock:
            Busy.now += 1
        time.sleep(0.1)
        with Busy.lock:
            seen, Busy.now = Busy.now, Busy.now - 1
        return [[float(seen), float(len(texts)), float(len(t))] for t in texts]


@pytest.mark.parametrize("workers", [1, 4])
def test_requests_are_whole_bounded_and_in_order(spark, workers):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(0, 300, 1, 1).selectExpr("id", "repeat('x', cast(id % 50 as int)) content")
        rows = readers.embed_column(df, Busy(), batch=32, workers=workers).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.id for r in rows] == list(range(300)) and all(r.vector[2] == r.id % 50 for r in rows)
    assert {r.vector[1] for r in rows[:288]} == {32.0} and rows[-1].vector[1] == 12.0
    most = max(r.vector[0] for r in rows)
    assert most == 1 if workers == 1 else 1 < most <= workers


def test_late_requests_are_made_again_and_given_up(spark):
    calls = []

    def slow(texts):
        calls.append(len(texts))
        time.sleep(0.3 if len(calls) < 3 else 0)
        return [[1.0]] * len(texts)

    began = time.time()
    assert readers._asked(slow, ["a"], 5, 0.1) == [[1.0]] and len(calls) == 3
    assert readers._asked(lambda t: time.sleep(60), ["a"], 2, 0.1) is None and time.time() - began < 5

    def fails(texts):
        calls.append("f")
        raise ValueError

    calls.clear()
    assert readers._asked(fails, ["a"], 3, 1) is None and calls == ["f"]  # final
    assert readers._asked(lambda t: [[1.0]], ["a", "b"], 3, 1) is None  # a vector is missing
    df = spark.createDataFrame([("a", 1)], "content string, vector int")
    assert readers.embed_column(df, lambda t: time.sleep(9), tries=1, seconds=0.1, seconds_each=0.1).collect()[0].vector is None


def test_a_column_is_replaced_in_place(spark):
    df = spark.createDataFrame([(None, 1, "k"), ("ab", 2, "l")], "content string, vector int, z string")
    got = readers.embed_column(df, lambda t: [[float(len(x))] for x in t])
    assert got.columns == ["content", "vector", "z"] and [tuple(r) for r in got.collect()] == [(None, [0.0], "k"), ("ab", [2.0], "l")]
    assert readers.embed_column(df.limit(0), readers.hashing_embedder(4)).collect() == []


def test_texts_whose_words_cancel_have_unit_vectors(spark, tmp_path):
    import duckdb
    from tesserae.plans.inventory import ORACLE_SQL, QUERIES

    texts = ["Anouble thwh.", "two words", "\u00a0", "\x1c", "\x0b", " \t\n", "", None, "\x0b a"]
    assert [round(sum(x * x for x in v), 6) for v in readers.hashing_embedder(16)([t or "" for t in texts])] == [1, 1, 1, 1, 0, 0, 0, 0, 1]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["s23_embed_batches"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert got == sorted(db.execute(ORACLE_SQL["s23_embed_batches"]).fetchall()) and [i for i, *_ in got] == [0, 1, 2, 3, 8]
