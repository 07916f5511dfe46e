import random

import pytest

from tesserae.llm import simhash
from tests.conftest import SF
from tests.llm.brute import find_components


def plain(text, shingle=3):
    """The fingerprint by its definition."""
    import re

    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, fps, distance=2):
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance]
    roots = find_components(len(rows), pairs)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, rows[i]), rows[i])
    return {rows[i]: least[r] for i, r in enumerate(roots)}


@pytest.mark.parametrize("text", [None, "", " \n ", "One", "A b", "A B  c", "É É é e\x0bF  x y", "x " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text) and simhash.fingerprint(text, 5) == plain(text, 5)


def test_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    fps = [plain(r.text) for r in rows]
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp & ((1 << 64) - 1) for r in got} == {r.doc_id: f for r, f in zip(rows, fps)}
    assert {r.doc_id: r.component_id for r in got} == brute([r.doc_id for r in rows], fps)


@pytest.mark.parametrize("small", [24, 2])
def test_links_of_crowded_keys(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    r = random.Random(7)
    fps = set()
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(60):  # chains of near fingerprints around a few centres
            base ^= (1 << r.randrange(64)) | (1 << r.randrange(64)) if r.random() < 0.8 else r.getrandbits(64)
            fps.add(base)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame(list(zip(range(len(fps)), signed)), "doc_id bigint, fp bigint")
    got = {x.doc_id: x.component_id for x in simhash.classes(rows).collect()}
    assert got == brute(list(range(len(fps))), fps) and len(set(got.values())) < len(fps)


def test_edge_cases(spark):
    rows = [(3, "a b c d", 1), (1, "A  b\nC d", 2), (2, None, 3), (5, "", 4), (2, None, 5), (None, "other words here now", 6), (9, "other words here now", 7), (3, "a b c d", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted([("3", "1"), ("1", "1"), ("2", "2"), ("5", "2"), ("2", "2"), ("None", "9"), ("9", "9"), ("3", "1")])
    kept = simhash.dedup(docs, shingle=3)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == [1, 2, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.dedup(docs.limit(0)).count() == 0
