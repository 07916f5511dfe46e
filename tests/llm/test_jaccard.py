import random
import re
from itertools import combinations

import pytest

import corpus_pipeline
from tesserae.llm import jaccard, simhash
from tests.conftest import SF
from tests.llm.brute import find_components


def shingle_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    k = min(5, len(words))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def survivors(rows):
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    least = {}
    for (i, _), r in zip(rows, find_components(len(rows), pairs)):
        least[r] = min(least.get(r, i), i)
    return sorted(least.values())


def test_stage_on_a_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.schema == docs.schema
    assert sorted(r.doc_id for r in got.collect()) == survivors([(r.doc_id, r.text) for r in docs.collect()])


def test_edited_copies_chains_and_distinct_texts(spark):
    base = [f"w{i}" for i in range(200)]
    edit = lambda *at: " ".join(f"new{i}" if i in at else w for i, w in enumerate(base))
    texts = [edit(), edit(3), edit(3, 60), edit(3, 60, 90), edit(3, 60, 90, 120), edit(3, 60, 90, 120, 150), edit(*range(0, 200, 9)), edit().upper(), "a b c", "A  b\nc", "a b d", None, "", " "]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([*rows, *rows[:2]], "doc_id bigint, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == survivors(rows) == [0, 6, 8, 10, 11]


@pytest.mark.parametrize(("small", "slice_"), [(4, 16), (4, 512), (500, 512)])
def test_large_groups_of_near_copies(spark, monkeypatch, small, slice_):
    """Copies about as far from each other as a link allows, so that the ends of a key connect only some of them."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "SLICE", slice_)
    r = random.Random(4)
    rows = []
    for g in range(2):
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range(60):
            at = set(r.sample(range(150), r.choice([1, 2, 3])))
            rows.append((len(rows), " ".join(f"x{r.random()}" if i in at else w for i, w in enumerate(base))))
    rows += [(len(rows), rows[3][1]), (len(rows), " ".join(r.sample(rows[5][1].split(), 140)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(x.doc_id for x in simhash.dedup(docs, shingle=5, least=0.8).collect())
    assert got == survivors(rows) and 4 < len(got) < 100


def test_tile_against_all_pairs():
    import numpy as np

    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 60)).astype("u8")) for _ in range(40)]
    keys = r.integers(0, 3, (40, jaccard.BANDS))
    roots, sides = r.integers(0, 5, 40), r.integers(0, 2, 40)
    got = set(jaccard.compare_tile(np.arange(40), roots, keys, sets, sides, 1, 0.4))
    first = lambda i, j: next((keys[i][b] for b in range(jaccard.BANDS) if keys[i][b] == keys[j][b]), None)
    want = {(i, j) for i, j in combinations(range(40), 2) if roots[i] != roots[j] and sides[i] != sides[j] and first(i, j) == 1 and jaccard.jaccard(sets[i], sets[j]) >= 0.4}
    assert got == want and got
