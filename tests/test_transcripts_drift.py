import json

import pytest

from tesserae.operators import drift, transcripts
from tesserae.operators.logs import parse, prompt_vectors


def lines(spark, *objects, session="s"):
    rows = [(session, i, o if isinstance(o, str) else json.dumps(o)) for i, o in enumerate(objects)]
    return transcripts.parse(spark.createDataFrame(rows, "session string, idx int, value string"))


def use(name, id="t1"):
    return {"type": "tool_use", "name": name, "id": id}


def result(text, id="t1"):
    return {"type": "tool_result", "tool_use_id": id, "content": text}


def msg(role, content, **more):
    return {"type": role, "message": {"role": role, "content": content, **more}}


def test_totals(spark):
    p = lines(
        spark, {**msg("user", "hi"), "timestamp": "2026-01-01T00:00:00Z"}, {"type": "attachment", "attachment": {"type": "hook", "hookEvent": "SessionStart", "stdout": "abc"}},
        msg("assistant", [use("Read"), {"type": "text", "text": "x"}], usage={"input_tokens": 7, "cache_creation_input_tokens": 100, "output_tokens": 6}), "{bad", msg("user", "again"),
        {**msg("assistant", "ok", usage={"input_tokens": 7, "cache_read_input_tokens": 200, "output_tokens": 7}), "timestamp": "2026-01-01T00:01:40Z"},
    )
    t = transcripts.totals(p).first()
    assert (t.user_messages, t.assistant_messages, t.input_tokens, t.cache_creation_input_tokens, t.cache_read_input_tokens, t.output_tokens, t.malformed, t.duration_s) == (2, 2, 14, 100, 200, 13, 1, 100)
    assert [(r.turn, r.tool) for r in transcripts.tool_uses(p).collect()] == [(0, "Read")]
    assert [tuple(r) for r in transcripts.attachments(p).collect()] == [("s", "SessionStart", 1, 3)]


def test_redundant_calls(spark):
    hit = {"type": "attachment", "attachment": {"hookEvent": "UserPromptSubmit", "stdout": "found"}}
    call = msg("assistant", [use("mcp__memory__search"), use("mcp__memory__recall", "t2"), use("Read", "t3")])
    p = lines(spark, msg("user", "a"), hit, call, msg("user", "b"), call)
    assert [tuple(r) for r in transcripts.redundant_calls(p).collect()] == [("s", 2, 1)]


def test_both_shapes_and_meta_lines(spark):
    p = lines(spark, {"role": "user", "content": "short"}, msg("assistant", [{"type": "text", "text": "a"}, use("x"), {"type": "text", "text": "b"}]), {**msg("user", "meta"), "isMeta": True}, {"type": "summary", "message": {"role": None}})
    assert [(r.role, r.text) for r in transcripts.messages(p).orderBy("idx").collect()] == [("user", "short"), ("assistant", "a\nb")]


def test_rules(spark):
    big, page = "\n" * 201, "w" * 501
    p = lines(
        spark, msg("user", "see the architecture"), msg("assistant", [use("Read", "r1")]), msg("user", [result(big, "r1")]), msg("assistant", [use("mcp__memory__search", "q")]),
        msg("user", "no, wrong"), msg("assistant", [use("mcp__memory__remember", "m")]), msg("user", "stop that"), msg("assistant", [use("WebFetch", "w1"), use("Read", "r2")]),
        msg("user", [result(page, "w1"), result("small", "r2")]), msg("assistant", "fine"),
    )
    got = {(r.rule, r.idx): r.followed for r in transcripts.rule_checks(transcripts.messages(p)).collect()}
    assert got == {("read_large_file", 1): True, ("user_correction", 4): True, ("user_correction", 6): False, ("external_content", 8): False, ("task_start_recall", 0): False}
    t = transcripts.rule_totals(transcripts.rule_checks(transcripts.messages(p))).first()
    assert (t.triggers, t.followed, t.misses) == (5, 2, 3)
    w = transcripts.memory_writes(transcripts.messages(p)).first()
    assert w.writes == 1


def test_windows_and_fallback(spark):
    p = lines(spark, msg("assistant", "I did it"), msg("user", "no, don't"), msg("user", "no, don't"))
    m = transcripts.messages(p)
    assert transcripts.session_summary(m).first().summary == "assistant: I did it\n\nuser: no, don't\n\n---\n\nuser: no, don't"
    quiet = transcripts.messages(lines(spark, *[msg("assistant", f"r{i}") for i in range(5)], msg("user", "ok then")))
    assert transcripts.session_summary(quiet).first().summary == "r2\n\n---\n\nr3\n\n---\n\nr4"


VECTORS = {"qClose": [1.0, 0.0, 0.0], "qUnrelated": [0.0, 0.0, 1.0], "qNotClose": [0.0, 0.0, 1.0]}
TURNS = [("sA", 0, ["hit1", "hit2"], ["qClose"], "truly_redundant"), ("sA", 1, [], [], "truly_missed"), ("sA", 2, [], [], "neither"), ("sB", 0, ["hit2"], ["qUnrelated"], "neither"), ("sB", 1, ["hit1", "hit2"], ["qNotClose"], "truly_redundant")]
PROMPTS = [("sA", [1.0, 0.0, 0.0]), ("sA", [0.0, 1.0, 0.0]), ("sA", [0.0, 0.0, 1.0]), ("sB", [1.0, 0.0, 0.0]), ("sB", [1.0, 0.0, 0.0])]


def test_golden_grid(spark):
    import base64
    import struct

    text = [(f"2026-04-18T10:0{i}:00Z INFO event=user-prompt session={s} stage=ok prompt_embed_b64={base64.b64encode(struct.pack('<3f', *v)).decode()}",) for i, (s, v) in enumerate(PROMPTS)]
    vecs = prompt_vectors(parse(spark.createDataFrame(text, "value string")))
    rows = [(i, s, n, h, len(q), len(q), lab) for i, (s, n, h, q, lab) in enumerate(TURNS)]
    turns = spark.createDataFrame(rows, "turn_id bigint, session_id string, turn_idx int, hit_ids array<string>, n_queries int, n_tools int, label string")
    prompts = turns.join(vecs, (turns.session_id == vecs.session) & (turns.turn_idx == vecs.turn_idx)).select("turn_id", "pvec")
    queries = spark.createDataFrame([(i, VECTORS[q]) for i, t in enumerate(TURNS) for q in t[3]], "turn_id bigint, qvec array<float>")
    chunks = spark.createDataFrame([("hit1", [1.0, 0.0, 0.0]), ("hit2", [0.0, 1.0, 0.0]), ("chunkZ", [0.0, 1.0, 0.0])], "id string, vector array<float>")
    seen = drift.evidence(drift.assert_labels(turns), prompts, queries, chunks)
    grid = [(a, b) for a in drift.M.float_range(0.4, 0.7, 0.05) for b in drift.M.float_range(0.35, 0.55, 0.05)]
    out = drift.csv_rows(drift.confusion(drift.verdicts(seen, grid)))
    assert out.columns == "t1,t2,precision_redundant,recall_redundant,f1_redundant,precision_missed,recall_missed,f1_missed,tp_redundant,fp_redundant,fn_redundant,tn_redundant,tp_missed,fp_missed,fn_missed,tn_missed,n_turns_scored".split(",")
    got = [",".join(r) for r in out.collect()]
    assert len(got) == 35 and got[0] == "0.4000,0.3500,1.0000,0.5000,0.6667,1.0000,1.0000,1.0000,1,0,1,3,1,0,0,4,5"
    assert {g[14:] for g in got} == {got[0][14:]} and got == sorted(got)
    assert {r.label: r.n for r in drift.label_counts(turns).collect()} == {"truly_redundant": 2, "truly_missed": 1, "neither": 2, "unclear": 0}


def test_bad_labels_fail(spark):
    with pytest.raises(Exception, match="not a label"):
        drift.assert_labels(spark.createDataFrame([("s", "odd")], "session_id string, label string")).collect()


def test_skipped_turns(spark):
    kind = "turn_id bigint, hit_ids array<string>, n_queries int, n_tools int, label string, has_prompt boolean, found bigint, embedded bigint, best_hit double, best_chunk double"
    rows = [(1, ["x"], 1, 1, "neither", True, 0, 1, None, 0.9), (2, [], 0, 0, "neither", False, 0, 0, None, None), (3, [], 0, 0, "unclear", True, 0, 0, None, 0.9), (4, ["x"], 1, 1, "neither", True, 1, 0, None, 0.1)]
    r = drift.confusion(drift.verdicts(spark.createDataFrame(rows, kind), [(0.5, 0.5)])).first()
    assert r.n_turns_scored == 1 and r.fp_missed == 0 and r.precision_missed == 0


def test_a_replay_stops_at_enough(spark, monkeypatch):
    """Above ``enough`` any chunk's cosine does; at or below it the best of all counts."""
    chunks = spark.createDataFrame([(f"c{i}", [1.0, i / 40, 0.0]) for i in range(40)] + [("no", None), ("zero", [0.0, 0.0, 0.0])], "id string, vector array<float>")
    prompts = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [0.0, 1.0, 1.0]), (4, None), (5, [0.0, -1.0, 0.0]), (6, [-1.0, 0.0, 0.0])], "turn_id bigint, pvec array<float>")
    best = {r.turn_id: r.best_chunk for r in drift.replay(prompts, chunks, 1).collect()}
    for first in (1, 7, 2048):
        monkeypatch.setattr(drift, "FIRST", first)
        for enough in (0.3, 0.45, 0.6, best[3], 1.0):
            got = {r.turn_id: r.best_chunk for r in drift.replay(prompts, chunks, 1, enough).collect()}
            assert got.keys() == best.keys() and all(enough < got[i] <= x if x > enough else got[i] == x for i, x in best.items())
    assert drift.replay(prompts, chunks.limit(0), 1, 0.5).count() == 0 == drift.replay(prompts.limit(0), chunks, 1, 0.5).count()


@pytest.mark.parametrize("name", ["a19_drift_report", "o3_best_points", "j12_a15_grid"])
def test_reports_meet_each_chunk_once_at_most(spark, monkeypatch, name):
    """Prompts are replayed once, in rounds, against the chunks that count; the results are those of the SQL."""
    import duckdb
    from .conftest import SF
    from tesserae.plans.queries import ORACLE_SQL, QUERIES

    pairs, search = [], drift.search_many

    def counted(chunks, queries, k):
        pairs.append(chunks.count() * queries.count())
        return search(chunks, queries, k)

    monkeypatch.setattr(drift, "search_many", counted)
    monkeypatch.setattr(drift, "FIRST", 8, raising=False)
    got = QUERIES[name](spark, SF).collect()
    with duckdb.connect() as db:
        for t in ("embeddings", "documents"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = db.execute(ORACLE_SQL[name]).fetchall()
        names = [x[0] for x in db.description]
        all_pairs = db.execute("SELECT count(*) FILTER (vec_id % 11 <> 0) * count(*) FILTER (vec_id % 4 IN (1, 2)) FROM embeddings JOIN documents ON vec_id = doc_id").fetchone()[0]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(want) and sum(pairs) < all_pairs
