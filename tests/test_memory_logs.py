import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as X
from tesserae.operators import lifecycle, logs, memory

MEMORY = "id string, content string, type string, tags array<string>, project string, vector array<float>, created_at bigint, updated_at bigint, source string, content_hash string, context_path string"


def near(c):
    return [c, (1 - c * c) ** 0.5, 0.0]


@pytest.fixture(scope="module")
def store(spark):
    rows = [("m1", "old one", "fact", ["a"], "p", [1.0, 0.0, 0.0], 1, 1, "explicit", "", ""), ("m2", "old two", "fact", ["b"], "", [0.0, 0.0, 1.0], 1, 1, "session", "", "ctx")]
    return spark.createDataFrame(rows, MEMORY).withColumn("content_hash", X.content_hash(F.col("content")))


def test_similarity_is_strict(spark, store):
    new = spark.createDataFrame([("n1", near(0.93)), ("n2", near(0.91)), ("n3", [0.0, 0.0, 2.0])], "new_id string, new_vector array<float>")
    assert {(r.new_id, r.id) for r in memory.similar(new, store).collect()} == {("n1", "m1"), ("n3", "m2")}


def test_similarity_edge_cases(spark):
    kinds = "id string, vector array<float>"
    known = spark.createDataFrame([("b", [2.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", []), ("e", [0.0, 0.0]), ("f", [None, 1.0]), ("g", [float("nan"), 1.0]), ("h", [1.0, 1.0, 1.0])], kinds)
    new = spark.createDataFrame([("1", [3.0, 0.0]), ("2", None), ("3", [0.0, 0.0]), ("4", [1.0, None]), ("5", [float("inf"), 1.0]), ("6", [2.0, 2.0, 2.0]), ("1", [3.0, 0.0]), ("7", [-1.0, 0.0])], "new_id string, new_vector array<float>")
    assert sorted((r.new_id, r.id, round(r.score, 9)) for r in memory.similar(new, known).collect()) == [("1", "a", 1.0), ("6", "h", 1.0)]
    assert memory.similar(new, known.limit(0)).count() == 0 and memory.similar(new.limit(0), known).count() == 0
    with pytest.raises(ValueError):
        memory.similar(new, known, -0.1)


def test_remember_rules(spark, store):
    rows = [("OLD  one", ["z"], "decision", "p", [0.0, 1.0, 0.0], "here"), ("brand new", ["q"], "fact", "p", [0.0, 1.0, 0.0], "there"), ("like two", ["c"], "context", "p", [0.0, 0.1, 1.0], "over")]
    new = spark.createDataFrame(rows, "content string, tags array<string>, type string, project string, vector array<float>, context_path string")
    got = {r.id: r for r in memory.remember(store, new, 9).collect()}
    assert len(got) == 3
    m1, m2 = got["m1"], got["m2"]
    assert (m1.content, m1.tags, m1.type, m1.updated_at, m1.context_path, m1.status) == ("old one", ["a", "z"], "decision", 9, "here", "updated")
    assert (m2.content, m2.source, m2.type, m2.context_path, m2.tags) == ("like two", "explicit", "context", "ctx", ["b", "c"])
    assert next(r for i, r in got.items() if i.startswith("mem:explicit:")).content == "brand new"
    keep = spark.createDataFrame([("like one", ["c"], "fact", "p", near(0.95), "")], new.schema)
    m1 = next(r for r in memory.remember(store, keep, 9).collect() if r.id == "m1")
    assert m1.content == "old one" and m1.source == "explicit" and m1.tags == ["a", "c"]  # an explicit one keeps its content


def test_ingest_is_sequential(spark, store):
    rows = [("p", 0, "h0", near(0.5)), ("p", 1, "h1", near(0.55)), ("p", 2, "h0", near(0.0)), ("p", 3, "h3", near(0.99)), ("q", 0, "h0", near(0.99))]
    chunks = spark.createDataFrame(rows, "project string, ordinal int, content_hash string, vector array<float>")
    got = {(r.project, r.ordinal): (r.action, r.id) for r in memory.ingest_sessions(store, chunks, 9).collect()}
    assert got == {("p", 0): ("created", "mem:session:h0"), ("p", 1): ("updated", "mem:session:h0"), ("p", 2): ("skipped", "mem:session:h0"), ("p", 3): ("updated", "m1"), ("q", 0): ("skipped", "mem:session:h0")}
    after = {r.id: r for r in memory.ingested(store, chunks.selectExpr("*", "concat('c', content_hash) content", "array('n') tags", "'fact' type"), 9).collect()}
    assert len(after) == store.count() + 1 and after["mem:session:h0"].content == "ch1" and after["m1"].updated_at == 9


def test_recall(store):
    assert [r.id for r in memory.recall(store, "x", [1.0, 0.0, 0.0], tags=["b", "zz"]).collect()] == ["m2"]
    with pytest.raises(ValueError):
        memory.recall(store, "  ", [1.0])


LINES = [
    "2026-04-18T10:00:00Z INFO event=user-prompt session=A stage=ok bytes=1000",
    "2026-04-18T10:00:01Z INFO event=user-prompt session=A stage=cache_hit bytes=1007",
    '2026-04-18T10:00:02Z INFO event=user-prompt session=A stage=skip why="too \\"short\\" a=b"',
    "2026-04-18T10:00:03Z INFO event=pre-tool-use session=A class=allow mode=shadow",
    "2026-04-18T10:00:04Z WARN event=pre-tool-use session=A class=block mode=shadow rule_id=R1 reason=bad",
    "2026-04-18T10:00:05Z INFO event=post-edit-actor session=A msg=reindex_ok",
    "2026-04-18T10:01:00Z INFO event=user-prompt session=B stage=ok bytes=x7",
    "2026-04-18T10:02:00Z INFO event=user-prompt session=B stage=ollama_ping",
    "2026-04-18T10:02:00Z INFO session=A no_event=1", "", "junk", "2026-99-18T10:00:00Z INFO event=stop session=A", "2026-04-18T11:00:00Z INFO event=doctor x=\"open",
]


def test_log_golden(spark):
    e = logs.parse(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert e.count() == 9
    rows = {r.session: r for r in logs.by_session(e).collect()}
    a, b = rows["A"], rows["B"]
    assert (a.prompts, a.cache_hits, a.skips, a.cache_total, a.prompt_bytes, a.tool_checks, a.reindexes) == (3, 1, 1, 2, 2007, 2, 1)
    assert (b.prompts, b.cache_total, b.prompt_bytes) == (2, 1, 0)
    assert {(r["class"], r.n) for r in logs.verdicts(e).collect()} == {("allow", 1), ("block", 1)}
    assert e.where("event = 'user-prompt' and fields['stage'] = 'skip'").first().fields["why"] == 'too "short" a=b'
    assert logs.latest(logs.by_session(e)).first().session == "B"
    audit = logs.audit(e)
    assert {r["class"]: r.n for r in audit["classes"].collect()} == {"allow": 1, "warn": 0, "block": 1, "unknown": 0}
    assert [tuple(r) for r in audit["rules"].collect()] == [("R1", 1, "bad")] and audit["candidates"].count() == 1
    assert logs.promotion(e).first().promote and not logs.promotion(e, 2 * 86400).first().promote
    assert [r.n for r in logs.nth_prompts(e, ok_only=False).where("session = 'A'").collect()] == [0, 1, 2]


def test_log_round_trip(spark):
    fields = {"k": "v", "q": 'a "b" c\\', "n": "line\nend", "e": ""}
    df = spark.createDataFrame([(fields,)], "f map<string,string>").withColumn("ts", F.lit("2026-04-18 10:00:00").cast("timestamp"))
    line = df.select(logs.format_line(F.col("ts"), F.lit("INFO"), F.lit("stop"), F.col("f")).alias("value"))
    assert logs.parse(line).first().fields == fields


def test_durations():
    assert [logs.seconds(x) for x in ("1h30m", "250ms", "7d")] == [5400, 0.25, 604800]
    with pytest.raises(ValueError):
        logs.seconds("soon")


def test_lifecycle(spark):
    now, day = 1_700_000_000, 86_400
    rows = [("never", "doc", "file", 0), ("fresh", "doc", "file", now - day), ("stale", "doc", "file", now - 40 * day), ("old", "doc", "file", now - 100 * day), ("code", "code", "file", now - 100 * day), ("mem", "doc", "memory", now - 100 * day), ("null", None, None, now - 100 * day)]
    df = spark.createDataFrame([(*r, "x" * 300) for r in rows], "id string, source_type string, kind string, last_accessed bigint, content string")
    got = {r.id: len(r.content) for r in lifecycle.run(df, now).collect()}
    assert got == {"never": 300, "fresh": 300, "stale": 214, "code": 300, "mem": 300, "null": 300}
    capped = {r.id for r in lifecycle.run(df, now, most=4).collect()}
    assert capped == {"fresh", "code", "mem", "null"}  # never-read rows go first


def test_cache(spark):
    kind = "key string, stdout binary, created_at bigint, hit_count bigint"
    cache = spark.createDataFrame([("a", bytearray(b"1"), 10, 3), ("b", bytearray(b"2"), 90, 1)], kind)
    new = spark.createDataFrame([("a", bytearray(b"xx")), ("c", bytearray(b"y" * 40_000))], "key string, stdout binary")
    after = lifecycle.cache_put(cache, new, 100)
    assert {(r.key, r.created_at, r.hit_count) for r in after.collect()} == {("a", 100, 0), ("b", 90, 1)}
    assert [r.key for r in lifecycle.cache_put(cache, new, 100, most=1).collect()] == ["a"]
    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    assert [r.key for r in lifecycle.cache_get(cache, keys, 100, 10).collect()] == ["b"]
    assert {(r.key, r.hit_count) for r in lifecycle.cache_hit(cache, keys).collect()} == {("a", 4), ("b", 3)}
    assert tuple(lifecycle.cache_stats(cache.limit(0)).first()) == (0, 0, 0)


def test_hashes_and_vectors_count_in_every_project(spark, store):
    stored = store.where("id = 'm1'").first()
    rows = [("zz", 0, stored.content_hash, [0.0, 0.0, 1.0]), ("yy", 1, "h9", list(stored.vector)), ("r", 2, "same", [0.0, -1.0, 0.0]), ("u", 3, "same", [0.0, -1.0, 0.0])]
    got = {r.ordinal: (r.action, r.id) for r in memory.ingest_sessions(store, spark.createDataFrame(rows, "project string, ordinal int, content_hash string, vector array<float>"), 9).collect()}
    assert got == {0: ("skipped", "m1"), 1: ("updated", "m1"), 2: ("created", "mem:session:same"), 3: ("skipped", "mem:session:same")}


def test_no_new_memory_is_lost(spark, store):
    m1 = store.where("id = 'm1'").first()
    new = spark.createDataFrame([("first near", ["x"], "fact", "p", list(m1.vector), "", 1), ("second near", ["y"], "decision", "p", list(m1.vector), "c", 2), ("far", ["t"], "fact", "p", [0.0, 0.0, -1.0], "", 3), ("far", ["u"], "fact", "p", [0.0, 0.0, -1.0], "", 4)], "content string, tags array<string>, type string, project string, vector array<float>, context_path string, ordinal int")
    got = {r.id: r for r in memory.remember(store, new, 9).collect()}
    assert {"x", "y"} <= set(got["m1"].tags) and got["m1"].type == "decision" and len(got) == store.count() + 1
    assert next(r for i, r in got.items() if i.startswith("mem:explicit:")).tags == ["t", "u"]


def test_similar_over_blocks(spark, monkeypatch):
    import random

    monkeypatch.setattr(memory, "BLOCK", 7)
    r = random.Random(1)
    vec = lambda: [r.gauss(0, 1) for _ in range(4)]
    known, new = [(f"m{i:03d}", vec()) for i in range(40)], [(f"n{i}", vec()) for i in range(20)]
    got = {x.new_id: (x.id, round(x.score, 9)) for x in memory.similar(spark.createDataFrame(new, "new_id string, new_vector array<double>"), spark.createDataFrame(known, "id string, vector array<double>"), 0.5, None).collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    want = {n: max(((round(cos(v, w), 9), i) for i, w in known)) for n, v in new}
    assert got == {n: (i, s) for n, (s, i) in want.items() if s > 0.5}
    assert memory.similar(spark.createDataFrame(new, "new_id string, new_vector array<double>"), spark.createDataFrame(known, "id string, vector array<double>"), 0.5, 39).count() == 0


def test_ingested_table_with_near_copies_among_new_chunks(spark, tmp_path):
    """Near, equal, scaled, zero and missing vectors: each chunk has the fate that the SQL names."""
    import duckdb
    from tesserae.plans.queries import ORACLE_SQL, QUERIES

    def vector(n):
        if n % 6 == 1:
            return [None, [0.0] * 4, [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0], [float("nan"), 1.0, 1.0, 1.0]][n // 6 % 5]
        return [1.0, 1.0, 1.0, 1.0 + n / 1e4] if n % 100 == 2 else [float(n % 7), 1.0, float(n % 3), -2.0]

    ids = range(310)
    spark.createDataFrame([(n, vector(n), n % 10) for n in ids], "vec_id bigint, embedding array<float>, label int").coalesce(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(n, f"text {n}", "en", "src1") for n in ids], "doc_id bigint, text string, lang string, source string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in QUERIES["k5_r5_ingested_table"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        for t in ("embeddings", "documents"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        want = sorted(db.execute(ORACLE_SQL["k5_r5_ingested_table"]).fetchall())
    assert got == want and sum(x[1].startswith("only") for x in got) == 4


def test_a_line_is_taken_apart_once(spark):
    """Conditions on an entry don't make its line and fields again; of a repeated key the last value counts."""
    from tesserae.plans.queries import QUERIES

    plan = QUERIES["s12_parse_log"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f"{f}(") for f in ("regexp_extract_all", "map_from_entries", "get_json_object")] == [1, 1, 1]
    tails = ['event=a k=1 k="2 \\"x\\" k=3" j= k=4', "event=a event=b", "event=", "", 'event="q r" session=s session="" x="', "event=a " + " ".join(f"k{i % 50}={i}" for i in range(2000))]
    lines = spark.createDataFrame([(f"2026-04-18T10:00:0{i}Z INFO {t}",) for i, t in enumerate(tails)] + [(None,)], "value string")
    got = {r.ts.second: (r.event, r.session, r.fields) for r in logs.parse(lines).collect()}
    assert got == {0: ("a", "", {"k": "4", "j": ""}), 1: ("b", "", {}), 4: ("q r", "", {"x": '"'}), 5: ("a", "", {f"k{i}": str(1950 + i) for i in range(50)})}
