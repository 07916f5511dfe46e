import numpy as np
import pytest

from tesserae.llm import grid_join
from tests.conftest import SF
from tests.llm.brute import cosine_links


def _check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, node string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in grid_join.near_duplicates(df, **kw).collect()}
    want = cosine_links([(i, v) for i, v, _ in rows])
    assert got == want
    return got


def test_table_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = cosine_links([(r.vec_id, r.embedding) for r in df.collect()])
    got = grid_join.near_duplicates(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("tile", [1, 2, 8])
def test_groups_over_many_blocks_and_bad_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(grid_join, "LEAF", 16)
    monkeypatch.setattr(grid_join, "BLOCK", 64)
    monkeypatch.setattr(grid_join, "TILE", tile)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    rows = []
    for i in range(400):  # one large group of near copies, one of equal ones, others small
        k = 0 if i % 3 == 0 else 1 if i % 5 == 0 else int(rng.integers(2, 40))
        v = base[k] + (0 if k == 1 else rng.normal(size=24) * rng.choice([0.05, 0.2]))
        rows.append((i, [float(x) for x in np.float32(v * rng.choice([1.0, 7.0]))], "x"))
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [float("inf")] + [0.0] * 23, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, v, None) for i, v in enumerate(bad)]
    got = _check(spark, rows)
    assert got[1006] == (1, 1006) and got[1000] == (0, 1000)


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)], "vec_id bigint, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in grid_join.near_duplicates(df).collect())
    assert got == [("1", 2, "1", True), ("1", 2, "1", True), ("None", 0, "None", False), ("None", 2, "1", False)]


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_nothing_to_join(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in grid_join.near_duplicates(df).collect()] == [(i, 0, i, True) for i, _ in rows]


def test_threshold_of_one_and_clashing_columns(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1.0, 2.1], 1), (4, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, block int").selectExpr("*", "1 as node", "2 as tile", "3 as copies", "4 as n_links", "5 as component_id")
    got = {r.vec_id: (r.n_links, r.component_id) for r in grid_join.near_duplicates(df, threshold=1 - 1e-12).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}
    assert grid_join.near_duplicates(df, threshold=1.0).count() == 4
    assert grid_join.near_duplicates(df).columns == ["vec_id", "n_links", "component_id", "kept"]


def test_pairs_on_the_edge_do_not_depend_on_their_neighbours():
    rng = np.random.default_rng(9)
    axes = np.linalg.qr(rng.normal(size=(32, 32)))[0][:, : grid_join.AXES]
    base = rng.normal(size=32)
    crowd = base + rng.normal(size=(400, 32)) * 0.15
    u = grid_join._unit(crowd)
    threshold = float((u[0] * u[1]).sum())  # exactly on the edge
    for rows in (crowd, crowd[:2], np.vstack((crowd[:2], rng.normal(size=(400, 32))))):
        side = grid_join._Side(rows, np.ones(len(rows), "i8"), axes)
        _, labels = grid_join.join_blocks(side, side, True, threshold)
        assert labels[1] == labels[0]
