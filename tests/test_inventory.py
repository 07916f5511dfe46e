from pyspark.sql import functions as F

import __spark_entry__
from tesserae.functions import text as X
from tesserae.operators import lifecycle
from tesserae.sources import readers, registry


def test_refusals(spark):
    rows = [(None, None), ("", []), ("x" * 10240, ["t"] * 20), ("é" * 5121, ["t"] * 21), ("y", ["t" * 101])]
    got = spark.createDataFrame(rows, "s string, t array<string>").select(X.refusal("query", F.col("s")), X.refused_tags(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("query is required", None), ("query is required", None), (None, None), ("query exceeds maximum size of 10KB", "too many tags"), (None, "a tag is too long")]


def test_members(spark):
    rows = [("z", "/w/a/z"), ("a", "/w/a/"), ("b", "/w/a/q/b"), ("n", "/w/ab"), (None, None)]
    df = spark.createDataFrame(rows, "name string, path string")
    names = lambda *a: [r.name for r in registry.members(df, *a).collect()]
    assert names("/w/a") == ["a", "b", "z"] and names("/w/a/", "b") == ["b"] and names("/w/a", "n") == [] and names("/w/a", "__root__") == ["a"]
    assert registry.members(df.limit(0), "/w/a").count() == 0


def test_stale_index_and_skill_count(spark):
    times = spark.createDataFrame([(None,), (0,), (1000 - 1800,), (1000 - 1801,)], "t bigint")
    assert [r[0] for r in times.select(lifecycle.index_stale(F.col("t"), 1000)).collect()] == [False, False, False, True]
    paths = spark.createDataFrame([("a/SKILL.md",), ("a/SKILL.md",), (".b/SKILL.md",), ("c/x/SKILL.md",), (None,)], "path string")
    assert readers.skill_count(paths).first().n == 1


def test_one_line(spark):
    rows = [(' "a\n b" ',), ("'x",), ("plain",), (None,), ("",)]
    assert [r[0] for r in spark.createDataFrame(rows, "s string").select(X.one_line(F.col("s"))).collect()] == ["a b", "'x", "plain", None, ""]


def test_every_plan_query_has_sql():
    own = {n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"}
    assert own <= set(__spark_entry__.oracle_sql())


def test_tags_of_whole_texts(spark, tmp_path):
    from tesserae.plans.inventory import QUERIES

    rows = list(enumerate(["a" * 3000 + " b" * 30, "a" * 3000, "c d", " ".join(["e" * 100] * 20), "f " * 2000]))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.refused for r in QUERIES["f13_tag_limits"](spark, str(tmp_path)).collect()}
    want = {i: "too many tags" if len(p := t.split(" ")) > 20 else "a tag is too long" if max(len(x.encode()) for x in p) > 100 else None for i, t in rows}
    assert got == want
