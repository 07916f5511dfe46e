import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import memory, pivots

MEMORY = "id string, content string, type string, tags array<string>, project string, vector array<float>, created_at bigint, updated_at bigint, source string, content_hash string, context_path string"


def _cosines(x, y):
    x, y = (np.float32(m).astype("f8") for m in (x, y))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T


def _clustered(rng, n, dim, centres, noise):
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * noise


def _rows(m, letter):
    return [(f"{letter}{i:05}", [float(x) for x in v]) for i, v in enumerate(m)]


@pytest.mark.parametrize(("threshold", "noise"), [(0.92, 0.1), (0.5, 0.6), (0.0, 1.0)])
def test_similar_equals_all_pairs(spark, monkeypatch, threshold, noise):
    monkeypatch.setattr(memory, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x, y = _clustered(rng, 150, 12, 20, noise), _clustered(rng, 260, 12, 20, noise)
    y[:40] = x[:40] * 3  # ties of copies
    y[40:80] = x[:40]
    new, known = spark.createDataFrame(_rows(x, "n"), "new_id string, new_vector array<float>"), spark.createDataFrame(_rows(y, "m"), "id string, vector array<float>")
    got = {r.new_id: (r.id, r.score) for r in memory.similar(new, known, threshold).collect()}
    c = _cosines(x, y)
    for i in range(len(x)):
        j = int(c[i].argmax())
        if c[i, j] > threshold:
            assert got[f"n{i:05}"][1] == pytest.approx(c[i, j], abs=1e-6) and c[i, int(got[f"n{i:05}"][0][1:])] == pytest.approx(c[i, j], abs=1e-6)
        else:
            assert f"n{i:05}" not in got


def test_pairs_compared_fall_with_structure(spark):
    """The tighter the groups, the fewer pairs of blocks meet; whatever the pivots, none that counts is lost."""
    rng = np.random.default_rng(2)
    compared = []
    for noise in (1.0, 0.05):
        m = spark.createDataFrame(_rows(_clustered(rng, 1500, 16, 12, noise), "m"), "id string, vector array<float>")
        by = pivots.choose(m)
        placed = pivots.blocks(m, "id", "vector", by, pivots.reach(0.92), 32)
        compared.append(pivots.meetings(placed, placed, by, 0.92).agg(F.sum(F.col("n") * F.col("m"))).first()[0])
    assert compared[1] < compared[0] / 3 and compared[1] < 1500 * 1500 / 4


def test_pivots_are_kept_beside_a_table(spark, tmp_path):
    m = spark.createDataFrame([*_rows(np.random.default_rng(0).normal(size=(50, 5)), "m"), ("z", [0.0] * 5), ("y", None), ("x", [1.0, 2.0])], "id string, vector array<float>")
    by = pivots.choose(m)
    assert set(by) == {2, 5} and len(by[5]) == pivots.PIVOTS and len(by[2]) == 1
    pivots.save(spark, str(tmp_path / "t"), by)
    assert pivots.load(spark, str(tmp_path / "t")) == by
    new = m.select(F.col("id").alias("new_id"), F.col("vector").alias("new_vector"))
    for some in (by, {}, {5: by[5][:1]}):  # fewer or no pivots: the same result
        assert memory.similar(new, m, 0.92, None, some).where("id = new_id").count() == 51


def _greedy(n, pairs):
    taken = []
    near = {}
    for a, b in pairs:
        near.setdefault(max(a, b), set()).add(min(a, b))
    kept = set()
    for i in range(n):
        if not near.get(i, set()) & kept:
            kept.add(i)
            taken.append(i)
    return taken


@pytest.mark.parametrize("fold", [0, 40, 1 << 18])
def test_rounds_equal_the_fold(spark, fold):
    rng = np.random.default_rng(fold)
    graphs = [(60, [(int(a), int(b)) for a, b in rng.integers(0, 60, (120, 2)) if a != b]), (12, [(i, i + 1) for i in range(11)]), (30, [(0, i) for i in range(1, 30)]), (5, [])]
    for n, pairs in graphs:
        links = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a bigint, b bigint")
        got = sorted(r.n for r in memory.first_set(spark.range(n).withColumnRenamed("id", "n"), links, fold).collect())
        assert got == _greedy(n, pairs)


def _ingested(store, chunks, threshold):
    """The fold, chunk by chunk: (project, ordinal) -> action, id."""
    hashes = {}
    for i, h, _, _ in store:
        hashes[h] = min(i, hashes.get(h, i))
    vectors = [(i, v, source) for i, _, v, source in store]
    made, seen, out = [], {}, {}
    for project, ordinal, h, v in sorted(chunks, key=lambda c: (c[1], c[0], c[2])):
        if h in hashes:
            out[project, ordinal] = ("skipped", hashes[h])
            continue
        if h in seen:
            to, explicit = seen[h]
            out[project, ordinal] = ("updated" if explicit else "skipped", to)
            continue
        best = (threshold, None, False)
        for i, w, source in vectors:
            c = float(_cosines([v], [w])[0, 0])
            if c > best[0]:
                best = (c, i, source == "explicit")
        for i, w in made:
            c = float(_cosines([v], [w])[0, 0])
            if c > best[0] + 1e-9:
                best = (c, i, False)
        to = best[1] or f"mem:session:{h}"
        if best[1] is None:
            made.append((to, v))
        seen[h] = (to, best[2])
        out[project, ordinal] = ("updated" if best[1] else "created", to)
    return out


@pytest.mark.parametrize(("prefix", "fold"), [(4096, 1 << 18), (10, 0)])
def test_ingest_equals_the_fold(spark, prefix, fold):
    rng = np.random.default_rng(prefix)
    old, new = _clustered(rng, 15, 6, 5, 0.25), _clustered(rng, 140, 6, 14, 0.25)
    store = [(f"m{i:02}", f"h{i}", [float(x) for x in np.float32(v)], "explicit" if i % 2 else "session") for i, v in enumerate(old)]
    chunks = [(f"p{i % 3}", i // 3, f"h{rng.integers(0, 110)}", [float(x) for x in np.float32(v)]) for i, v in enumerate(new)]
    by_hash = {}
    chunks = [(p, o, h, by_hash.setdefault(h, v)) for p, o, h, v in chunks]
    a = spark.createDataFrame([(i, "c", "fact", [], "", v, 1, 1, s, h, "") for i, h, v, s in store], MEMORY)
    b = spark.createDataFrame(chunks, "project string, ordinal int, content_hash string, vector array<float>")
    got = {(r.project, r.ordinal): (r.action, r.id) for r in memory.ingest_sessions(a, b, 9, 0.9, prefix=prefix, fold=fold).collect()}
    want = _ingested(store, chunks, 0.9)
    assert got == want and {x for x, _ in want.values()} == {"created", "updated", "skipped"}


def test_leaders_of_vectors_without_direction_and_copies(spark):
    rows = [("a", None, 1), ("b", [0.0, 0.0], 2), ("c", [1.0, 0.0], 3), ("d", [1.0, 0.0], 4), ("e", [2.0, 0.0], 5), ("f", [0.0, 1.0], 6), ("g", [float("nan"), 1.0], 7)]
    df = spark.createDataFrame(rows, "new_id string, new_vector array<float>, place int")
    got = sorted(r.new_id for r in memory.leaders(df, pivots.choose(df, "new_vector"), 0.92).collect())
    assert got == ["a", "b", "c", "f", "g"]
    assert memory.leaders(df.limit(0), {}, 0.92).collect() == []
