import random

import pytest

from tesserae.llm import queries, repeats
from tests.conftest import SF
from tests.llm.brute import sha, without_repeats


def _got(df, **kw):
    rows = repeats.remove_repeats(df, **kw).collect()
    assert all(r.n_removed == sum(s.stop - s.start for s in r.repeats) for r in rows)
    return sorted((str(r.doc_id), r.n_words, r.n_removed, sha(r.kept)) for r in rows)


def _want(rows, length=50):
    return sorted((str(i), *rest) for i, *rest in without_repeats(rows, length))


def test_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op13_substring_dedup(spark, SF).collect()]
    want = without_repeats(rows)
    assert sorted(got) == sorted(want) and sum(r[2] for r in want) > 1000


@pytest.mark.parametrize(("length", "seed"), [(50, 20), (12, 5), (6, 6), (9, 1)])
def test_passages_in_many_surroundings(spark, length, seed):
    rng = random.Random(length)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("xyz")
    text = lambda n: [word() for _ in range(n)]
    passages = [text(rng.randint(length - 2, 3 * length)) for _ in range(6)]
    rows = []
    for i in rng.sample(range(10_000), 150):
        words = text(rng.randint(0, 2 * length))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            some = p[a:] if rng.random() < 0.5 else p[: a + 1] if rng.random() < 0.5 else p
            if rng.random() < 0.3 and len(some) > 3:
                some = some[:2] + [word()] + some[3:]
            at = rng.randint(0, len(words))
            words[at:at] = some
        rows.append((i, " ".join(words)))
    rows += [(20_000 + i, rows[0][1]) for i in range(20)] + [(-5, " ".join(passages[0] * 3)), (30_000, None), (30_001, ""), (None, rows[0][1]), (None, None)]
    rows += rows[:5] + [(rows[7][0], rows[8][1])]  # repeated rows, an id with two texts
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).selectExpr("*", "1 as id", "2 as h", "3 as anchor", "4 as place", "5 as spans")
    assert _got(df, length=length, seed=seed) == _want(rows, length)


def test_one_word_and_string_ids(spark):
    rows = [("b", "x " * 200), ("a", "x\t" * 60), ("c", "x\n" * 49), ("d", "y " + "x " * 50)]
    assert _got(spark.createDataFrame(rows, "doc_id string, text string")) == _want(rows)


def test_empty_tables_and_parameters(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert _got(df) == []
    assert _got(spark.createDataFrame([(1, None), (2, "a")], "doc_id bigint, text string")) == _want([(1, None), (2, "a")])
    with pytest.raises(ValueError, match="seed"):
        repeats.spans(df, length=5, seed=6)


def test_every_window_holds_its_anchor():
    import numpy as np

    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 63, 700).astype("u8")
    for cut in (0, 3):  # anchors follow the words, not their places
        found = repeats.anchors(hashes[cut:])
        for at in range(700 - cut - 49):
            assert any(at <= p <= at + 30 for p in found)
    assert {p + 3 for p in repeats.anchors(hashes[3:])} <= set(repeats.anchors(hashes))
