import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import lifecycle, ordered, transcripts


def _fold(events, window):
    out, last = [], {}
    for p, c, t in sorted((e for e in events if e[2] is not None), key=lambda e: (e[0] or "", e[1] or "", e[2])):
        emit = (p, c) not in last or t - last[p, c] >= window
        if emit:
            last[p, c] = t
        out.append((p, c, t, emit))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_suppression_of_hot_keys_over_ranges(spark, parts):
    rng = random.Random(parts)
    for window, wide in ((10, 400), (100, 3000), (1000, 900), (0, 50), (7, 60)):
        events = [("p", "hot", rng.randrange(wide)) for _ in range(600)] + [(rng.choice("pqr"), rng.choice("abc"), rng.randrange(wide)) for _ in range(300)]
        events += [(None, "a", 3), (None, "a", 4), ("p", None, 5), ("p", "a", None), ("zz", "z", 1)]
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = lifecycle.suppress(spark.createDataFrame(events, "project string, code string, ts bigint"), window)
            assert sorted(map(tuple, got.collect()), key=str) == (_fold(events, window) if window else sorted(((*e, True) for e in events if e[2] is not None), key=str))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_suppression_of_nothing(spark):
    assert lifecycle.suppress(spark.createDataFrame([], "project string, code string, ts bigint"), 5).collect() == []


@pytest.mark.parametrize("few", [2, 4096])
def test_split_at_the_kth_row(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW", few)
    rng = random.Random(few)
    rows = [(rng.choice([None, 0, 0, 0, *range(40)]), rng.choice([None, *"abcdefgh"]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "t bigint, id string, n int").cache()
    key = lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, r[1] or ""))
    want = sorted(map(key, rows))
    for k in (0, 1, 7, 150, 299, 300, 1000):
        first, rest = ordered.split(df, k, "t", "id", refine=3)
        a, b = first.collect(), rest.collect()
        assert sorted(r.n for r in a + b) == list(range(300))  # each row on one side
        assert sorted(map(key, a)) == want[:k] and sorted(map(key, b)) == want[k:]


def test_numbered(spark):
    df = spark.range(500).withColumn("k", F.xxhash64("id"))
    got = ordered.numbered(df, "k").orderBy("k").collect()
    assert [r.n for r in got] == list(range(500))
    assert ordered.numbered(df.limit(0), "k").collect() == []


def test_cap_takes_ties_by_id_and_repeats_by_number(spark):
    rows = [(f"c{i:03}", "doc", "file", i // 50) for i in range(200)] + [("c500", "doc", "file", 0)] * 3 + [("c600", "code", "file", 0), ("c601", None, None, 0)]
    df = spark.createDataFrame(rows, "id string, source_type string, kind string, last_accessed bigint")
    left = sorted(r.id for r in lifecycle.cap(df, len(rows) - 52).collect())
    assert left == sorted([*[f"c{i:03}" for i in range(50, 200)], "c500", "c600", "c601"])
    assert lifecycle.cap(df, 10).count() == 10 and lifecycle.cap(df, 1).count() == 2  # exempt rows stay beyond the cap
    assert lifecycle.cap(df, 0).count() == lifecycle.cap(df, 1000).count() == len(rows)


def test_cache_takes_the_last_of_several_and_drops_the_oldest(spark):
    cache = spark.createDataFrame([(f"k{i}", "x", i, 3) for i in range(10)], "key string, stdout string, created_at bigint, hit_count bigint")
    new = spark.createDataFrame([("k3", "b", 1), ("k3", "a", 2), ("k99", "z" * 40_000, 1)], "key string, stdout string, ordinal int")
    got = {r.key: tuple(r)[1:] for r in lifecycle.cache_put(cache, new, 50, most=4).collect()}
    assert got == {"k3": ("a", 50, 0), "k7": ("x", 7, 3), "k8": ("x", 8, 3), "k9": ("x", 9, 3)}
    assert lifecycle.cache_put(cache, new, 50, ttl=45).count() == 6


def test_results_take_the_latest_earlier_call(spark):
    block = lambda kind, i, name=None: (kind, name, i if kind == "tool_use" else None, i if kind == "tool_result" else None, None, f"r{name}")
    kinds = f"session string, idx int, blocks array<{transcripts.BLOCK}>"
    rows = [("s", 0, [block("tool_result", "x")]), ("s", 1, [block("tool_use", "x", "A"), block("tool_use", "x", "B"), block("tool_result", "x")]), ("s", 2, [block("tool_result", "x"), block("tool_use", "x", "C"), block("tool_result", None)])]
    rows += [("s", 3, [block("tool_use", "x", None), block("tool_use", None, "N")]), ("s", 4, [block("tool_result", "x"), block("tool_result", None), block("tool_result", "y")]), ("t", 9, [block("tool_result", "x")]), ("t", 10, None)]
    got = sorted((r.session, r.idx, str(r.tool_use_id), r.name) for r in transcripts.result_names(spark.createDataFrame(rows, kinds)).collect())
    assert got == sorted([("s", 0, "x", None), ("s", 1, "x", None), ("s", 2, "x", "B"), ("s", 2, "None", None), ("s", 4, "x", None), ("s", 4, "None", None), ("s", 4, "y", None), ("t", 9, "x", None)])
    many = [("m", i, [block("tool_use" if i % 2 else "tool_result", "x", f"n{i}")]) for i in range(3000)]
    found = transcripts.result_names(spark.createDataFrame(many, kinds)).where("name is not null").collect()
    assert len(found) == 1499 and all(r.name == f"n{r.idx - 1}" for r in found)
