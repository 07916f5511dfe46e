import pytest
from pyspark.sql import functions as F

from tesserae.operators import index, search
from tesserae.sources import registry, tables

NOW = 1_700_000_000
COLUMNS = "id string, file_path string, start_line int, end_line int, content string, kind string, source_type string, sub_project string, metadata string, context_path string, summary string, vector array<float>, last_accessed bigint, mod_time bigint, content_hash string"


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [
        ("b", "x/a.go", 1, 9, "first text", "file", "code", None, '{"k": 1, "s": "1"}', "internal/cli", "", [1.0, 0.0, 0.0], 0, 5, "h1"),
        ("a", "x/a.go", 10, 12, "second", "memory", "web", "", "{}", "internal/client", "sum", [1.0, 0.0, 0.0], NOW - 200 * 86400, 6, "h2"),
        ("c", "y/b.go", 1, 2, "t" * 300, None, None, "app", '{"k": "1"}', "internal/cli/sub", "", [0.0, 1.0, 0.0], NOW, 7, ""),
        ("d", "z.go", 1, 2, "dim", "file", "doc", "app", "", "", "", [1.0, 1.0], 0, 0, "h4"),
    ]
    return spark.createDataFrame(rows, COLUMNS)


def ids(df):
    return [r.id for r in df.collect()]


def test_ranking_and_ties(chunks):
    assert ids(search.search(chunks, [1.0, 0.0, 0.0], 0)) == ["a", "b", "c", "d"]
    fresh = search.search(chunks, [1.0, 0.0, 0.0], 2, now=NOW).collect()
    assert [(r.id, round(r.score, 6)) for r in fresh] == [("b", 1.0), ("a", 0.5)]


def test_filters(chunks):
    assert ids(search.project_is(chunks, "__root__")) == ["b", "a"] and len(ids(search.project_is(chunks, ""))) == 4
    assert ids(search.in_scope(chunks, "internal/cli")) == ["b", "a", "c"]  # a raw prefix takes the sibling in
    assert ids(search.in_scope(chunks, "internal/cli", "path")) == ["b", "c"]
    assert ids(search.in_scope(chunks, "INTERNAL_cli")) == ["b", "a", "c"]  # case-blind, with wildcards
    assert ids(search.metadata_is(chunks, {"k": 1})) == ["b"] == ids(search.metadata_is(chunks, {"k": 1.0}))
    assert ids(search.metadata_is(chunks, {"k": "1"})) == ["c"] and ids(search.metadata_is(chunks, {"zz": None})) == []


def test_levels(chunks):
    got = {r.id: r for r in chunks.select("id", search.detail("summary").alias("s"), search.detail("snippet").alias("n")).collect()}
    assert got["a"].s == "sum" and got["c"].s == "t" * 120 + "..." and got["c"].n == "t" * 200 + "..." and got["b"].n == "first text"
    with pytest.raises(ValueError):
        search.detail("huge")


def test_budget_keeps_one_and_stops_at_the_first_overflow(chunks):
    ranked = search.search(chunks, [0.0, 1.0, 0.0], 4)
    assert ids(search.budget(ranked, 1)) == ["c"] and ids(search.budget(ranked, 77)) == ["c", "a"]


def test_dimension_guard(chunks):
    assert search.assert_dimension(chunks.where("id <> 'd'"), 3).count() == 3
    with pytest.raises(Exception, match="expected 3 dimensions"):
        search.assert_dimension(chunks, 3).collect()
    assert search.same_model("m:latest", "m") and not search.same_model("", "")


def test_many_queries_in_rounds(spark, chunks, monkeypatch):
    monkeypatch.setattr(search, "QUERY_ROUND", 2)
    qs = spark.createDataFrame([(i, [float(i == 0), float(i > 0), 0.0]) for i in range(5)], "query_id bigint, qvec array<double>")
    got = search.search_many(chunks, qs, 1).orderBy("query_id").collect()
    assert [(r.query_id, r.id) for r in got] == [(0, "a"), (1, "c"), (2, "c"), (3, "c"), (4, "c")]
    assert search.search_many(chunks, qs.limit(0), 1).count() == 0


def test_scans_agree_with_the_expression(spark, monkeypatch):
    import random

    from tesserae.functions import vector as M

    r = random.Random(3)
    vectors = [[r.choice([-1.0, 0.5, 2.0, 0.0]) for _ in range(4)] for _ in range(300)]
    odd = [None, [], [0.0] * 4, [1.0], [1.0, None, 2.0, 3.0], [1e-30, 0.0, 0.0, 0.0], [3e38, 3e38, 0.0, 0.0]]
    rows = [(f"v{i:03}", v) for i, v in enumerate(vectors * 2 + odd)]
    df = spark.createDataFrame(rows, "id string, vector array<float>").repartition(3).cache()
    asked = [(i, v) for i, v in enumerate([*vectors[:12], None, [], [0.0] * 4, [1.0], [1.0, None, 2.0, 3.0]])]
    queries = spark.createDataFrame(asked, "query_id bigint, qvec array<double>")
    want = {}
    for i, v in asked:
        plain = [0.0 if x is None else x for x in v or []] if v is None or None not in v else []
        q = F.lit(None).cast("array<double>") if v is None or None in v else F.array(*map(F.lit, plain)).cast("array<double>")
        scores = {x.id: x.s for x in df.select("id", F.coalesce(M.cosine(F.col("vector"), q), F.lit(0.0)).alias("s")).collect()}
        if plain:
            assert {x.id: x.score for x in search.score(df, plain).collect()} == scores
        want[i] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:9]
    for rounds in (1024, 3):
        monkeypatch.setattr(search, "QUERY_ROUND", rounds)
        got = {}
        for x in search.search_many(df, queries, 9).orderBy("query_id", "rank").collect():
            got.setdefault(x.query_id, []).append((x.id, x.score))
        assert got == want


def test_listing_has_the_prefix_quirk(chunks):
    assert [tuple(r) for r in index.listing(chunks, "internal/cli").collect()] == [("", 1), ("ent", 1), ("sub", 1)]
    assert [tuple(r) for r in index.listing(chunks, "internal/cli", "path").collect()] == [("", 1), ("sub", 1)]


def test_upsert_resets_access_and_strips_nul(spark, chunks):
    new = chunks.where("id = 'c'").withColumn("content", F.lit("n\0ew")).unionByName(chunks.where("id = 'd'").withColumn("id", F.lit("e")))
    got = {r.id: r for r in index.upsert(chunks, new).collect()}
    assert len(got) == 5 and got["c"].content == "new" and got["c"].last_accessed == 0 and got["a"].last_accessed > 0
    assert {r.id for r in index.touch(chunks, new, 9).where("last_accessed = 9").collect()} == {"c"}
    with pytest.raises(ValueError):
        index.backfill_project(chunks, "")


def test_up_to_date_cases(spark, chunks):
    files = spark.createDataFrame([("x/a.go", 6, "h"), ("x/a.go", 9, "h2"), ("y/b.go", 99, "q"), ("z.go", 0, "h4"), ("new", 1, "h")], "path string, mtime bigint, hash string")
    facts = search.file_facts(chunks)
    assert [(r.path, r.mtime, r.up_to_date) for r in index.stale(files, facts).orderBy("path", "mtime").collect()] == [("new", 1, False), ("x/a.go", 6, True), ("x/a.go", 9, True), ("y/b.go", 99, True), ("z.go", 0, False)]


def test_the_last_new_row_counts_and_blanks_are_filled(spark, chunks):
    kind = chunks.schema["id"].dataType.simpleString()
    new = spark.createDataFrame([("c", "old"), ("q", "only"), ("c", "mid"), ("c", "last")], f"id {kind}, content string").repartition(1)
    whole = chunks.select("id", "content")
    assert {r.id: r.content for r in index.upsert(whole, new).where("id in ('c', 'q')").collect()} == {"c": "last", "q": "only"}
    rows = [("a", "x/y.go", "# c\nfirst", "", "", None, "", "[]", "", None), ("b", "z.go", "t", "func", "F", "doc", '{"k":1}', "", "mine", "p")]
    got = index.completed(spark.createDataFrame(rows, "id string, file_path string, content string, kind string, identifier string, source_type string, metadata string, relationships string, summary string, context_path string"))
    assert [tuple(r)[5:] for r in got.orderBy("id").collect()] == [("code", "{}", "[]", "first", "x"), ("doc", '{"k":1}', "[]", "mine", "p")]


def test_external_text_is_checked(spark):
    docs = spark.createDataFrame([("s1", "", "body", "")], "source string, url string, content string, type string")
    assert tuple(index.index_text(docs).select("content", "source_type", "metadata", "relationships").first()) == ("[Source: s1]\n\nbody", "custom", "{}", "[]")
    related = lambda n: "[" + ",".join(['{"type":"t","target":"x"}'] * n) + "]"
    good = {"source": ["a/b c#1", "-x", " "], "type": ["ticket", "note"], "metadata": ["", "{}", '{"a":[1,{"b":2}]}'], "relationships": ["", "[]", related(50)]}
    bad = {
        "source": ["a/../b", "", "é", "x" * 501, "a?b", "a\nb", "a\n", "a\0"], "content": ["x" * (100 * 1024 + 1)], "type": ["web", "Ticket"],
        "metadata": ["[1]", "x", '"s"', '{"a":"' + "x" * 10 * 1024 + '"}'], "relationships": ["{}", "x", related(51)],
    }
    rows = [(c, v, fine) for values, fine in ((good, True), (bad, False)) for c, vs in values.items() for v in vs]
    for c, v, fine in rows:
        one = index.index_text(docs.withColumn(c, F.lit(v)))
        if fine:
            assert one.count() == 1 and one.collect(), (c, v)
        else:
            with pytest.raises(Exception, match="not valid"):
                one.collect()


def test_registry():
    ps = [("Alpha", "/a"), ("alphabet", "/a/b")]
    assert registry.find(ps, "alphabet")[1] == "/a/b" and registry.find(ps, "ALPHA")[1] == "/a" and registry.find(ps, "zz") is None


def test_versioned_tables(spark, tmp_path, chunks):
    root = str(tmp_path / "t")
    assert tables.version(spark, root) == 0
    for n in (1, 2, 3, 4):
        assert tables.write(chunks.limit(n), root) == n
    assert tables.read(spark, root).count() == 4 and not (tmp_path / "t/v1").exists() and (tmp_path / "t/v3").exists()
    tables.write_properties(spark, root, {"embedding_model": "m:latest", "embedding_dim": "3"})
    tables.write_properties(spark, root, {"x": "y"})
    tables.verify(spark, root, "m", 3)
    with pytest.raises(ValueError):
        tables.verify(spark, root, "m", 4)
    with pytest.raises(ValueError):
        tables.verify(spark, str(tmp_path / "none"), "m", 3)


@pytest.mark.parametrize("groups", [1, 3])
def test_queries_as_rows(spark, monkeypatch, groups):
    """More queries than a task's code may hold: groups of both sides, ids of any type, a floor from a sample."""
    import random

    r = random.Random(groups)
    vec = lambda n: [r.choice([-1.0, 0.5, 2.0, 0.0, 1.5]) for _ in range(n)]
    df = spark.createDataFrame([(i, vec(5)) for i in range(400)] + [(1000, None), (1001, [1.0])], "id bigint, vector array<float>")
    asked = [(f"q{i}", vec(5)) for i in range(60)] + [("none", None), ("empty", []), ("null", [1.0, None, 1.0, 1.0, 1.0]), ("one", [2.0]), ("zero", [0.0] * 5)]
    queries = spark.createDataFrame(asked, "query_id string, qvec array<double>")
    want = sorted((x.query_id, x.id, x.score, x["rank"]) for x in search.search_many(df, queries, 7).collect())
    for name, value in (("QUERY_ROUND", 4), ("QUERY_GROUP", 25), ("CHUNK_GROUP", 400 // groups), ("SAMPLED", 2), ("SAMPLE", 4)):
        monkeypatch.setattr(search, name, value)
    assert sorted((x.query_id, x.id, x.score, x["rank"]) for x in search.search_many(df, queries, 7).collect()) == want
    assert len(want) == 7 * len(asked)
