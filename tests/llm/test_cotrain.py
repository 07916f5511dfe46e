import pytest

from tesserae.llm import cotrain
from tests.conftest import SF


@pytest.fixture(scope="module")
def tables(spark):
    sf = SF.replace("0.001", "0.01")
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    held = labels.where("doc_id % 4 = 1")
    got = cotrain.classify(docs, labels.where("doc_id % 4 <> 1")).join(held, "doc_id").collect()
    good = [r for r in got if (r.score >= 0.5) == bool(r.quality)]
    assert len(got) > 60 and len(good) >= 0.96 * len(got)
    assert sum(r.score < 0.5 for r in got if r.quality) <= 1


def test_kept_rows_agree_with_scores(spark, tables):
    docs, labels = tables
    score = {r.doc_id: r.score for r in cotrain.classify(docs, labels).collect()}
    kept = cotrain.keep_good(docs, labels)
    assert kept.schema == docs.schema
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert set(rows) == {i for i, s in score.items() if s >= 0.5} and len(rows) < len(score)
    assert rows == {r.doc_id: r.text for r in docs.collect() if r.doc_id in rows}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, None, 3), (2, "", "en", "a", 4), (2, "", "en", "a", 4), (None, "word " * 30000, "en", "b", 5)], "doc_id bigint, text string, lang string, source string, y int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in cotrain.classify(docs, none).collect()] == [1.0] * 4
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (9, 0), (7, None)], "doc_id bigint, quality int")
    got = cotrain.classify(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    tie = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id bigint, quality int")
    assert cotrain.keep_good(docs, tie).count() == 4
    assert cotrain.classify(docs.limit(0), labels).count() == 0


def test_copies_teach_one_text_and_rounds_go_on(spark):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(1, r.normal(3, 0.1, cotrain.N_TEXT), 4.0)] * 1000 + [(k, r.normal(0, 1, cotrain.N_TEXT), r.normal()) for k in range(2, 1500)]
    made = [(i, h, [float(x) for x in t], [float(a)] * cotrain.N_META, None) for i, (h, t, a) in enumerate(rows)]
    marked = spark.createDataFrame(made, "doc_id bigint, h bigint, t array<float>, m array<float>, y boolean")
    views = []
    for k in (cotrain.N_TEXT, cotrain.N_META):
        v = cotrain.Logistic()
        v.mean, v.scale, v.beta = np.zeros(k), np.ones(k), np.array([8.0] + [0.0] * k)
        views.append(v)
    state, sizes = cotrain.distinct_pool(marked), []
    assert state.count() == 1499
    for _ in range(2):
        state, grown = cotrain.exchange(state, views)
        sizes.append((state.where("y0 = 1").count(), state.where("y0 = 0").count(), state.where("y1 = 1").count()))
        assert grown
    assert all(abs(x - cotrain.PER_ROUND) <= 1 for x in sizes[0]) and all(b > a + 100 for a, b in zip(*sizes))
    got = state.where("y0 is not null").collect()
    x, y, one = np.array([g.t for g in got], "f8"), np.array([g.y0 for g in got]), np.array([0.0, 1.0])
    start = np.vstack((np.zeros(cotrain.N_TEXT), np.ones(cotrain.N_TEXT)))
    apart = cotrain.Logistic().fit(start, one, None, cotrain.summing(state, 0))
    here = cotrain.Logistic().fit(np.vstack((start, x)), np.append(one, y), np.append(np.ones(2), np.full(len(y), cotrain.PSEUDO_WEIGHT)))
    assert np.allclose(apart.beta, here.beta, atol=1e-5)


def test_labelled_rows_are_bounded(spark):
    marked = spark.range(5000).selectExpr("id doc_id", "id h", "array(float(id)) t", "array(float(1)) m", "id % 7 <> 0 y").repartition(40)
    some = cotrain.labelled_rows(marked, 600)
    assert 500 < some.num_rows < 700 and some.equals(cotrain.labelled_rows(marked.coalesce(1), 600))
    assert cotrain.labelled_rows(marked).num_rows == 5000


def plain_fit(x, y, w):
    """Ridge logistic regression by plain Newton steps on all rows at once."""
    import numpy as np

    mean = w @ x / w.sum()
    scale = np.sqrt(w @ (x - mean) ** 2 / w.sum()) + cotrain.FLAT
    z = np.column_stack((np.clip((x - mean) / scale, -8, 8), np.ones(len(y))))
    beta, ridge = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        beta = beta + np.linalg.solve(z.T @ (z * (w * p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (w * (y - p)) - ridge @ beta)
    return lambda q: np.column_stack((np.clip((q - mean) / scale, -8, 8), np.ones(len(q)))) @ beta


def test_rounds_calibration_and_combination_against_brute_force(spark):
    """Few enough texts that every confident one is exchanged: the whole loop by hand, in one process."""
    import zlib

    import numpy as np

    r = np.random.default_rng(5)
    n = 240
    truth = r.random(n) < 0.5
    t = (r.normal(0, 1, (n, cotrain.N_TEXT)) + truth[:, None] * 0.6).astype("f4")
    m = (r.normal(0, 1, (n, cotrain.N_META)) + truth[:, None] * 0.5).astype("f4")
    features = spark.createDataFrame([(i, 1000 + i, t[i].tolist(), m[i].tolist()) for i in range(n)], "doc_id bigint, h bigint, t array<float>, m array<float>").repartition(3)
    labels = spark.createDataFrame([(i, int(truth[i])) for i in range(90)], "doc_id bigint, quality int")
    got = {x.doc_id: x.score for x in cotrain.score_features(features, cotrain.train(features, labels)).collect()}

    x, y, known = (t.astype("f8"), m.astype("f8")), truth.astype("f8"), np.arange(n) < 90
    held = known & np.array([zlib.crc32(str(i).encode()) % cotrain.HELD_OUT == 0 for i in range(n)])
    fit = known & ~held
    given = [np.full(n, np.nan), np.full(n, np.nan)]

    def views():
        out = []
        for side in (0, 1):
            more = ~np.isnan(given[side])
            w = np.concatenate((np.ones(fit.sum()), np.full(more.sum(), cotrain.PSEUDO_WEIGHT)))
            out.append(plain_fit(np.vstack((x[side][fit], x[side][more])), np.concatenate((y[fit], given[side][more])), w))
        return out

    now = views()
    for _ in range(cotrain.ROUNDS):
        margins = [v(q) for v, q in zip(now, x, strict=True)]
        new = [g.copy() for g in given]
        for teacher in (0, 1):
            sure = ~known & (np.abs(margins[teacher]) > 1) & np.isnan(given[1 - teacher])
            new[1 - teacher][sure] = margins[teacher][sure] > 0
        if all(np.array_equal(a, b, equal_nan=True) for a, b in zip(new, given)):
            break
        given = new
        now = views()
    one = lambda q: np.ones(q.sum())
    odds = [v(q)[:, None] for v, q in zip(now, x, strict=True)]
    calibrated = np.column_stack([plain_fit(o[held], y[held], one(held))(o) for o in odds])
    want = 1 / (1 + np.exp(-plain_fit(calibrated[held], y[held], one(held))(calibrated)))
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-4)


def test_equal_texts_and_very_long_ones(spark):
    text = "word other " * 200_000
    docs = spark.createDataFrame([(1, text, "en", "a"), (2, text, "en", "a"), (3, "x", "en", "a")], "doc_id bigint, text string, lang string, source string")
    score = {x.doc_id: x.score for x in cotrain.classify(docs, spark.createDataFrame([(1, 1), (3, 0)], "doc_id bigint, quality int")).collect()}
    assert score[1] == score[2]
    with pytest.raises(ValueError):
        cotrain.keep_good(docs.withColumnRenamed("source", "__t").withColumn("source", docs.lang), docs.limit(0), source="source")
