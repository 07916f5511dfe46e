import random

import pytest

from tesserae.llm import periodic_runs, queries
from tests.conftest import SF
from tests.llm.brute import periodic, runs, words_of


def test_runs_against_every_period():
    rng = random.Random(7)
    for _ in range(1500):
        kinds, n = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 50)
        ids = [rng.randrange(kinds) for _ in range(n)]
        if n > 6 and rng.random() < 0.6:
            p, a = rng.randint(1, max(1, n // 4)), rng.randrange(n)
            for i in range(a + p, n):
                ids[i] = ids[i - p]
            ids += [rng.randrange(kinds) for _ in range(rng.randint(0, 8))] + ids[: rng.randint(0, 20)]
        for least in ((6, 4), (2, 2), (4, 3)):
            assert periodic_runs.runs_of(ids, *least) == runs(ids, *least), (ids, least)


def test_hashes_that_lie_are_found_out(monkeypatch):
    """With a hash of few values every comparison is settled by the words."""
    monkeypatch.setattr(periodic_runs, "PRIME", 3)
    monkeypatch.setattr(periodic_runs.Extensions, "_powers", [1])
    rng = random.Random(3)
    for _ in range(300):
        block = [rng.randrange(2) for _ in range(rng.randint(1, 14))]
        ids = (block * 6)[: rng.randint(6, 70)] + [rng.randrange(2) for _ in range(10)] + block * 5
        assert periodic_runs.runs_of(ids) == runs(ids)
        assert periodic_runs.lyndon_runs(ids) == set(runs(ids))


def test_hostile_texts_end_soon():
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    assert periodic_runs.runs_of(b) == []  # no fourth powers
    assert periodic_runs.runs_of([0] * 60_000) == [(0, 60_000, 1)]
    assert len(periodic_runs.runs_of(([0] * 300 + [1]) * 200)) == 201


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()}
    some = [r for r in docs if len(words_of(r.text)) < 900]
    assert len(got) == len(docs) and len(some) > 150
    for r in some:
        assert got[r.doc_id] == periodic(r.doc_id, r.text)


def test_odd_rows(spark, tmp_path):
    rows = [(None, "x " * 9, 1), (None, None, 2), (1, None, 1), (2, "", 1), (3, " \t\n\x0b\x0c\r", 1), (4, "a b a b " * 4, 1), (7, "Wort", 1), (7, "Wort", 1), (8, "ab " * 50_000 + "c", 1), (9, "p q r " * 4 + "s t " * 4 + "p q r p", 1)]
    rows += [(i, "one two three four five six seven eight nine ten", 1) for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, runs int").selectExpr("*", "1 as collapsed", "2 as k0", "3 as t", "4 as h", "5 as words", "6 as n", "7 as best")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, map(tuple, queries.op12_periodic_runs(spark, str(tmp_path)).collect())))
    assert got == sorted(str(periodic(i, t)) for i, t, _ in rows)
    assert any(r[1] for r in (periodic(i, t) for i, t, _ in rows if i and i >= 100))  # periods were planted
    kept = periodic_runs.find_runs(df.drop("runs", "collapsed"), keep=["doc_id", "n"])
    assert kept.columns == ["doc_id", "n", "runs", "collapsed"] and kept.count() == len(rows)


def test_empty_table_and_parameters(spark):
    df = spark.createDataFrame([], "doc_id string, text string")
    assert periodic_runs.find_runs(df).collect() == []
    with pytest.raises(ValueError, match="two periods"):
        periodic_runs.find_runs(df, least_periods=1)
    (row,) = periodic_runs.find_runs(spark.createDataFrame([("x", "a b a b c c c")], "doc_id string, text string"), least_length=3, least_periods=2).collect()
    assert [tuple(r) for r in row.runs] == [(0, 4, 2), (4, 3, 1)] and row.collapsed == "a b c"
