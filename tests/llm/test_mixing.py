import math
import re
from collections import defaultdict

from tesserae.llm import mixing
from tests.conftest import SF


def fill(sizes):
    """Targets by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, left, out = set(names), sum(sizes.values()), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)
        left -= sum(3 * sizes[s] for s in over)
    return out


def check(docs):
    rows = mixing.mix(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = fill(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
    assert all(taken[s] == math.floor(next(r.target for r in rows if r.source == s)) for s in sizes)
    whole = {s: want[s] // sizes[s] if sizes[s] else 0 for s in sizes}
    assert sum(r.size > 0 and r.taken % r.size > 0 for r in rows) <= len(sizes)
    assert all(r.taken in range(int(whole[r.source]) * r.size, (int(whole[r.source]) + 1) * r.size + 1) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    return rows


def test_table(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))


def test_hot_source_nulls_and_repeats(spark):
    rows = [(i, "w " * (i % 9), "hot" if i % 3 else "b", 1) for i in range(90)] + [(200, None, None, 1), (201, "a\x0bb c", None, 1), (5, "same text", "c", 1), (5, "same text", "c", 1), (None, "x y z", "d", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = check(docs)
    assert len(got) == len(rows) and {r.size for r in got if r.doc_id == 201} == {2}
    taken = mixing.take(docs).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    by = defaultdict(int)
    for r in taken:
        by[r.source] += words(r.text)
    assert dict(by) == {s: n for s in {r.source for r in got} if (n := sum(r.taken for r in got if r.source == s))}
    texts = {r[1] for r in rows}
    assert all(any((t or "").startswith(r.text) for t in texts) for r in taken)


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(docs).collect()} == {(0.0, 0)} and mixing.take(docs).count() == 0
    assert mixing.mix(docs.limit(0)).count() == 0
