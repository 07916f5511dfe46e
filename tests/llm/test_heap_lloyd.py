import numpy as np
import pytest

from tesserae.llm import heap_lloyd, queries
from tests.conftest import SF
from tests.llm.brute import product_codes

KEY = lambda r: tuple((x is not None, x) for x in r)


def _coded(df, **kw):
    coded, books = heap_lloyd.compress(df, keep=["vec_id", "label"], **kw)
    rows = heap_lloyd.with_label_error(coded).collect()
    return sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in rows), key=KEY), books


def _fine(rows):
    return [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]


def test_table_against_plain_lloyd(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, books = product_codes(_fine(rows))
    got = queries.op11_heap_lloyd_codes(spark, SF).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(want)
    assert {r.codebooks_sha256 for r in got} == {heap_lloyd.Codebooks([np.array(b, object) for b in books]).digest()}


@pytest.mark.parametrize("block", [7, 4096])
def test_ties_copies_bad_and_long_vectors(spark, block):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 3, 8)], int(i % 3) if i % 4 else None) for i in rng.permutation(300)]
    rows += rows[:20] + [(None, rows[0][1], 1), (None, [9.0] * 8, None)]
    bad = [(1000, None, 1), (1001, [], 1), (1002, [1.0] * 7 + [None], 1), (1003, [float("nan")] * 8, 1), (1004, [float("-inf")] + [0.0] * 7, 2), (1005, [1.0] * 4, 2), (1006, [1.0] * 7, 2), (1007, [2.0**60] * 8, 3)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>, label int").repartition(5).selectExpr("*", "1 as kept", "2 as moves", "3 as error_", "4 as id", "5 as v")
    want, books = product_codes(rows, entries=16)
    got, found = _coded(df, entries=16, block=block)
    assert got == sorted(want, key=KEY)
    assert [b.tolist() for b in found.entries] == books
    assert found.decode(bytes.fromhex(got[5][1])) == [x for p in range(4) for x in books[p][int(got[5][1][2 * p : 2 * p + 2], 16)]]


@pytest.mark.parametrize("scale", [1.0, 3e4, 1e10])
def test_every_arithmetic_is_exact(spark, scale):
    rng = np.random.default_rng(int(scale) % 97)
    centre = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in scale * (centre[i % 12] + rng.normal(size=16) * 0.3)], 0) for i in range(200)]
    want, books = product_codes(rows, entries=20)
    got, found = _coded(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), entries=20, block=64)
    if scale < 1e9:
        assert got == sorted(want, key=KEY)
    assert [r[:2] for r in got] == sorted(r[:2] for r in want) and [b.tolist() for b in found.entries] == books


def test_errors_beyond_a_long_are_null(spark):
    df = spark.createDataFrame([(1, [2.0**49] * 4, 1), (2, [-(2.0**49)] * 4, 1), (3, [0.0] * 4, 1)], "vec_id bigint, embedding array<double>, label int")
    got, _ = _coded(df, entries=1)
    assert [r[2] for r in got] == [None, None, got[2][2]] and all(r[1] == "00000000" for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [float("nan")] * 4, None)]])
def test_nothing_to_code(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert _coded(df)[0] == []


def test_fewer_rows_than_entries_and_no_rounds(spark):
    rows = [(2, [1.0, 2.0, 3.0, 4.0], 1), (1, [1.0, 2.0, 3.0, 4.0], 1), (3, [-1.0, 0.0, 0.5, 4.0], None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    for rounds in (0, 4):
        assert _coded(df, rounds=rounds)[0] == sorted(product_codes(rows, rounds=rounds)[0], key=KEY)


def test_only_violated_parts_are_scanned():
    rng = np.random.default_rng(1)
    x = np.rint(rng.normal(size=(40, 4))[rng.integers(0, 40, 2000)] * 900 + rng.normal(size=(2000, 4)) * 9)
    book = x[:40].astype("f8")
    heaps = heap_lloyd.Heaps(1, 40)
    first = heaps.push(0, np.arange(2000), x, book, [np.zeros(40)])
    moved = book + 3.0
    fit = heap_lloyd._Fit(1, 4, "<i8", "f8", [book.astype("i8")], [np.zeros(40)])
    counts = np.ones((1, 40), object)
    after = heap_lloyd._moved(fit, moved.astype("i8").astype(object)[None], counts)
    ((rows, _, _),) = heaps.settle(x, [moved], after.drift)
    assert len(rows) < 1000  # most bounds hold
    assert (heaps.entries_of(0, 2000) == heap_lloyd.nearest(x, moved)[0]).all() and len(first) == 2000
    again = heap_lloyd.Heaps.load(1, 40, *heaps.dump())
    assert again.of == heaps.of
