import struct
import time

import pytest
from pyspark.sql import functions as F

from tesserae.operators import lifecycle
from tesserae.sources import readers
from tesserae.streaming import rules


def test_git_log(spark):
    text = "abc\n1700000000\nSubject\nBody one\n\nBody two\n---COMMIT_END---\n\n---COMMIT_END---\nonly\ntwo\n---COMMIT_END---\ndef\nbad\nS2\n---COMMIT_END---\nx\n1\n \nbody\n---COMMIT_END---"
    got = readers.commits(spark.createDataFrame([(text,), ("",)], "value string"), 42).collect()
    assert [tuple(r) for r in got] == [("abc", 1700000000, "Subject", "Body one\n\nBody two"), ("def", 42, "S2", "")]


def test_skill_files(spark):
    rows = [("a/SKILL.md", "---\nname: 'My Skill'\n# no\ndescription: does: things\nlist:\n  - x\n---\n\nBody\n"), ("b/SKILL.md", "just body"), (".h/SKILL.md", "x"), ("c/d/SKILL.md", "x")]
    got = {r.path: r for r in readers.skill_files(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert set(got) == {"a/SKILL.md", "b/SKILL.md"}
    assert (got["a/SKILL.md"].name, got["a/SKILL.md"].description, got["a/SKILL.md"].body) == ("My Skill", "does: things", "Body")
    assert (got["b/SKILL.md"].name, got["b/SKILL.md"].body) == ("b", "just body")
    with pytest.raises(Exception, match="no end"):
        readers.skill_files(spark.createDataFrame([("a/S.md", "---\nname: x\n")], "path string, content string")).collect()


def test_skill_parts():
    assert readers.split_skill("short", 10) == ["short"] and readers.split_skill("  ", 5) == [""]
    body = "intro\n## One\n" + "a" * 20 + "\n## Two\n" + "b" * 20
    assert readers.split_skill(body, 40) == ["intro\n\n## One\n" + "a" * 20, "## Two\n" + "b" * 20]
    assert readers.split_skill("é" * 25, 10) == ["é" * 10, "é" * 10, "é" * 5]


def test_skill_chunks(spark):
    df = spark.createDataFrame([("My Skill", "d", "x\n\n" * 1500)], "name string, description string, body string")
    ids = [r.id for r in readers.skill_chunks(df).collect()]
    assert ids[0] == "skill:my-skill:part-1" and len(ids) > 1


def test_frames():
    pack = lambda b: struct.pack(">I", len(b)) + b
    assert list(readers.frames(pack(b"ab") + pack(b"") + pack(b"c"))) == [b"ab", b"c"]
    for bad in (b"\0\0", pack(b"abc")[:-1], struct.pack(">I", 1 << 30)):
        with pytest.raises(ValueError):
            list(readers.frames(bad))


def test_embedders(spark):
    df = spark.createDataFrame([("a b c",), ("a b c",), ("",), (None,)], "content string")
    v = [r.vector for r in readers.embed_column(df, readers.hashing_embedder(16)).collect()]
    assert v[0] == v[1] and sum(x * x for x in v[0]) == pytest.approx(1) and set(v[2]) == {0.0}

    def late(texts):
        raise TimeoutError

    assert readers.embed_column(df, late).first().vector is None
    assert readers.usable_index(["a", "b:latest"], ["b"], "a") == "b:latest" and readers.usable_index(["a"], []) is None
    assert readers.model_dimension("bge-m3:567m") == 1024


def test_file_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_bytes(b"hi\0")
    got = readers.file_tree(spark, str(tmp_path)).collect()
    assert [(r.path, bytes(r.content)) for r in got] == [("a/x.txt", b"hi\0")]


@pytest.fixture(scope="module")
def events(spark):
    rows = [("p", "c", t) for t in (0, 5, 10, 11, 25, 26, 40)] + [("p", "d", 3)]
    return spark.createDataFrame(rows, "project string, code string, ts bigint")


def test_suppression_stream_equals_batch(spark, tmp_path, events):
    batch = {tuple(r) for r in lifecycle.suppress(events, 10).collect()}
    assert {(t, e) for p, c, t, e in batch if c == "c"} == {(0, True), (5, False), (10, True), (11, False), (25, True), (26, False), (40, True)}
    one = rules.replay(spark, events, lambda s: rules.suppress(s, 10), str(tmp_path / "a"), 1)
    assert {tuple(r) for r in one.collect()} == batch


def test_suppression_state_is_kept(spark, tmp_path):
    early = spark.createDataFrame([("p", "c", 0)], "project string, code string, ts bigint")
    (tmp_path / "in").mkdir()
    stream = lambda: rules.suppress(spark.readStream.schema(early.schema).parquet(str(tmp_path / "in")), 10)
    for t in (0, 5, 12):
        early.withColumn("ts", F.lit(t).cast("bigint")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {(r.ts, r.emit) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, True), (5, False), (12, True)}


def test_nag_stream_equals_batch(spark, tmp_path):
    turns = spark.createDataFrame([("s", i, i in (7, 8)) for i in range(20)], "session string, turn bigint, had_call boolean")
    batch = {(r.turn, r.since, r.fires) for r in lifecycle.nag(turns).collect()}
    assert {t for t, _, f in batch if f} == {4, 13, 18}
    got = rules.replay(spark, turns, rules.nag, str(tmp_path / "n"), 1)
    assert {(r.turn, r.since, r.fires) for r in got.collect()} == batch


def test_attempts_drop_at_ten(spark, tmp_path):
    df = spark.createDataFrame([("f", False)] * 11 + [("g", False), ("g", True)], "file string, ok boolean")
    got = rules.replay(spark, df.coalesce(1), rules.attempts, str(tmp_path / "d"), 1).collect()
    assert sorted(r.attempt for r in got if r.file == "f") == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10] and sum(r.dropped for r in got) == 1
    assert {r.attempt for r in got if r.file == "g"} <= {0, 1}


def test_buffers_end(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, "a", False), ("s", 2, "b", True), ("t", 1, "z", False)], "session string, ts bigint, line string, ended boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = rules.buffers(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 3)
    q = stream.writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:  # with a time-out in its state a query never runs dry, so it is watched and stopped
        for _ in range(200):
            if spark.table("ended").count():
                break
            time.sleep(0.3)
    finally:
        q.stop()
    assert [(r.session, r.text) for r in spark.table("ended").collect()] == [("s", "\nb\n")]


def test_debounce_shapes(spark, tmp_path):
    rows = [("p", "a", 0.0), ("p", "b", 1.5), ("p", "a", 3.0), ("p", "c", 9.0), ("p", "z", 60.0)]
    df = spark.createDataFrame(rows, "project string, path string, s double").select("project", "path", F.timestamp_micros((F.col("s") * 1e6).cast("bigint")).alias("ts"))
    late = rules.replay(spark, df, rules.debounced, str(tmp_path / "l"), 1)
    assert ["a", "b"] in [list(r.paths) for r in late.collect()]
    df = df.withColumn("ts", F.expr("ts + interval 1 day"))  # a stream begins with a watermark of 0, which an edit at 0 does not pass
    first = rules.replay(spark, df, rules.debounced_from_first, str(tmp_path / "f"), 1)
    assert [list(r.paths) for r in first.orderBy("start").collect()][:2] == [["a", "b"], ["a"]]


def test_debounce_counts_from_the_first_edit(spark, tmp_path):
    """Groups begin at an edit, not at a fixed clock, whatever the order and the micro-batch of the edits."""
    rows = [("p", "a", 1.9), ("p", "b", 2.1), ("p", "c", 3.899999), ("p", "d", 3.9), ("q", "x", 5.0), ("p", "e", 7.5), ("q", "y", 6.999999), ("q", "x", 7.0), ("end", "", 1010.0)]
    df = spark.createDataFrame(rows, "project string, path string, s double").select("project", "path", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("bigint")).alias("ts"))
    want = {("p", 1900000, ("a", "b", "c")), ("p", 3900000, ("d",)), ("p", 7500000, ("e",)), ("q", 5000000, ("x", "y")), ("q", 7000000, ("x",))}
    for parts in (1, 3):
        got = rules.replay(spark, df, lambda s: rules.debounced_from_first(s, "2 seconds", "1000 seconds"), str(tmp_path / str(parts)), parts)
        assert {(r.project, r.us, tuple(r.paths)) for r in got.withColumn("us", F.unix_micros("start")).collect()} == want


def test_a_replay_keeps_the_order_of_its_rows(spark, tmp_path):
    """However many parts there are, no row comes behind a later one: neither state nor the watermark runs ahead."""
    tries = [("f", ok) for ok in (False, False, False, True, False, False, True, False, False, False)]
    edits = [("p", "a", 2), ("q", "x", 5), ("p", "b", 3), ("p", "c", 8), ("q", "y", 6), ("p", "d", 4), ("r", "z", 9), ("end", "", 1020)]
    df = spark.createDataFrame(edits, "project string, path string, s bigint").select("project", "path", F.timestamp_seconds("s").alias("ts"))
    for parts in (2, 5, 8):
        got = rules.replay(spark, spark.createDataFrame(tries, "file string, ok boolean"), rules.attempts, str(tmp_path / f"a{parts}"), parts)
        assert sorted(r.attempt for r in got.collect()) == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
        groups = rules.replay(spark, df, lambda s: rules.debounced_from_first(s, "2 seconds", "1000 seconds"), str(tmp_path / f"d{parts}"), parts)
        assert {(r.project, tuple(r.paths)) for r in groups.collect()} == {("p", ("a", "b")), ("p", ("d",)), ("p", ("c",)), ("q", ("x", "y")), ("r", ("z",))}


def test_debounce_by_time_holds_a_part_of_the_edits(spark, tmp_path, monkeypatch):
    """Edits of 100 days out of order: the groups of the SQL, and no state with more than two parts of them."""
    import duckdb
    from tesserae.plans import inventory

    monkeypatch.setattr(rules, "PART", 200, raising=False)
    monkeypatch.setattr(inventory, "shared_folder", lambda spark: str(tmp_path / "run"))
    e = spark.range(2000).selectExpr("id event_id", "id % 7 user_id", "if(id = 99, null, timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 7919 % 2000 div 2 * 8641)) ts")
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = sorted((r.project, r.start, list(r.paths)) for r in inventory.QUERIES["r2_debounced_from_first"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        assert got == sorted(db.execute(inventory.ORACLE_SQL["r2_debounced_from_first"]).fetchall())
    batches = sorted(int(p.name) for p in (tmp_path / "run/check/commits").iterdir() if p.name.isdigit())
    held = []
    for b in batches:
        state = spark.read.format("statestore").option("batchId", b).load(str(tmp_path / "run/check"))
        held.append(state.select(F.sum(F.size("value.groupState.at"))).first()[0] or 0)
    assert 100 < max(held) <= 400
