"""The rest of the inventory's queries: sources, host rules, streams; see :mod:`tesserae.plans.queries`."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import commands as C
from tesserae.functions import text as X
from tesserae.functions import vector as M
from tesserae.operators import drift, index, lifecycle, logs, memory, search, transcripts
from tesserae.plans import queries as Q
from tesserae.plans import stand_ins as S
from tesserae.plans.queries import NOW, ORACLE_SQL, QUERIES, query
from tesserae.sources import growing, readers, registry, tables, tree
from tesserae.streaming import rules

__all__ = ["ORACLE_SQL", "QUERIES"]


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{named.rstrip('/')}/streams/{uuid.uuid4().hex}"


# -- sources ----------------------------------------------------------------------


@query("SELECT source AS sub_project, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM (SELECT text, CASE WHEN source IN ('src1', 'src2') THEN source ELSE '' END AS source FROM documents WHERE source IS NOT NULL) GROUP BY 1")
def s7_sub_repo_index(spark, sf):
    d = S.table(spark, sf, "documents").where("source is not null").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text"))
    repos = index.sub_repos(spark.createDataFrame([("src1/.git/HEAD",), ("src2/.git/HEAD",), ("src3/sub/.git/HEAD",)], "path string"))
    return index.tag_sub_project(d, repos).groupBy("sub_project").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


_TREE = """d AS (SELECT *, CASE WHEN source IN ('src1', 'src2') THEN source ELSE '' END AS project,
  CASE WHEN doc_id % 11 = 0 THEN 'default' WHEN doc_id % 7 = 3 THEN 'user' WHEN doc_id % 13 = 5 AND text <> '' THEN 'binary' ELSE 'index' END AS reason FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)"""


@query(f"""WITH {_TREE}, r AS (
  SELECT project, reason, count(*) AS n, coalesce(sum(CASE WHEN reason = 'index' THEN strlen(coalesce(text, '')) END), 0)::BIGINT AS bytes FROM d WHERE reason <> 'default' GROUP BY ALL
  UNION ALL SELECT project, 'default', count(DISTINCT source || '/' || lang), 0 FROM d WHERE reason = 'default' GROUP BY ALL
  UNION ALL SELECT DISTINCT '', 'sub_repo', (SELECT count(DISTINCT source) FROM d WHERE project <> ''), 0 FROM d
  UNION ALL SELECT DISTINCT project, 'default', 1, 0 FROM d WHERE project <> '')
SELECT project, reason, sum(n)::BIGINT AS n, sum(bytes)::BIGINT AS bytes FROM r GROUP BY ALL""")
def s1_s7_a22_scan(spark, sf):
    """The documents as files of a project with two repositories in it, scanned with them."""
    top = growing.mounted(shared_folder(spark))
    d = S.table(spark, sf, "documents").where("source is not null and lang is not null")
    below = F.when(F.col("doc_id") % 11 == 0, F.concat_ws("/", "source", "lang", F.lit("node_modules"))).otherwise(F.concat_ws("/", "source", "lang"))
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 3, ".min.txt").otherwise(".txt"))
    body = F.when((F.col("doc_id") % 13 == 5) & (F.col("text") != ""), F.concat(F.lit("\0"), "text")).otherwise(F.coalesce("text", F.lit("")))

    def write(rows):
        for r in rows:
            os.makedirs(f"{top}/{r.folder}", exist_ok=True)
            if r.folder.split("/")[0] in ("src1", "src2"):
                os.makedirs(f"{top}/{r.folder.split('/')[0]}/.git", exist_ok=True)
            with open(f"{top}/{r.folder}/{r.name}", "wb") as f:
                f.write(r.body.encode())

    d.select(below.alias("folder"), name.alias("name"), body.alias("body")).foreachPartition(write)
    return tree.counters(tree.scan_with_repos(spark, top, ["*.min.txt"]))


_LINE = "concat(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), CASE WHEN k % 2 = 0 THEN ' INFO event=' ELSE ' WARN event=' END, event, ' project=p', k, ' session=', session)"


def _log_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = S.log(spark, sf)
    level = F.when(F.col("k") % 2 == 0, " INFO event=").otherwise(" WARN event=")
    return e.select(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), level, "event", F.lit(" project=p"), F.col("k").cast("string"), F.lit(" session="), "session").alias("value"))


@query(f"SELECT {_LINE} AS value FROM log WHERE k % 2 = 0 AND event LIKE 'post-edit%' AND k::VARCHAR LIKE '1%'", "log")
def s14_log_tail(spark, sf):
    return logs.tail(_log_lines(spark, sf), level="INFO", event="post-edit", project="p1")


@query(f"SELECT {_LINE} AS value FROM log WHERE k % 2 = 1 AND event = 'stop'", "log")
def r1_s14_follow(spark, sf):
    """Half of the lines are followed, then the files are appended to and one is rotated, then the query starts again."""
    folder = shared_folder(spark)
    logs_in = growing.mounted(f"{folder}/in")
    os.makedirs(logs_in, exist_ok=True)
    both = _log_lines(spark, sf).select("value", (F.xxhash64("value") % 2 == 0).cast("int").alias("late"))
    dealt = both.repartition(4, F.xxhash64("value")).sortWithinPartitions("late", "value").withColumn("file", F.spark_partition_id())

    def write(rows, late):
        # the early lines stand first, so a task that runs again writes the same bytes at the same place
        f = None
        for r in rows:
            if f is None:
                name = f"{logs_in}/{r.file}.log"
                f = open(name, "r+b" if late else "wb")  # noqa: SIM115
            line = r.value.encode() + b"\n"
            f.seek(len(line), 1) if late and not r.late else f.write(line)
        if f is not None:
            f.close()

    def run():
        stream = logs.tail(rules.follow(spark, f"{folder}/in"), level="WARN", event="stop")
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()

    dealt.where("late = 0").foreachPartition(lambda rows: write(rows, False))
    run()
    dealt.foreachPartition(lambda rows: write(rows, True))
    for name in os.listdir(logs_in)[:1]:
        os.rename(f"{logs_in}/{name}", f"{logs_in}/{name}.1")
    run()
    return spark.read.schema("value string").parquet(f"{folder}/out")


@query("SELECT * FROM (VALUES ('90m', 5400.0::DOUBLE), ('1h30m', 5400.0::DOUBLE), ('7d', 604800.0::DOUBLE), ('250ms', 0.25::DOUBLE), ('1.5h', 5400.0::DOUBLE)) t(text, seconds)")
def s15_durations(spark, sf):
    return spark.createDataFrame([(t, logs.seconds(t)) for t in ("90m", "1h30m", "7d", "250ms", "1.5h")], "text string, seconds double")


@query("SELECT conv_id::VARCHAR AS session_id, turn::INT AS turn_idx, CASE conv_id % 4 WHEN 0 THEN 'truly_redundant' WHEN 1 THEN 'truly_missed' WHEN 2 THEN 'neither' ELSE 'unclear' END AS label, text AS prompt FROM conversations WHERE role = 'user'")
def s20_label_source(spark, sf):
    c = S.table(spark, sf, "conversations").where("role = 'user'")
    label = F.element_at(F.array(*map(F.lit, drift.LABELS)), (F.col("conv_id") % 4 + 1).cast("int"))
    folder = shared_folder(spark)
    c.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("turn_idx"), F.col("text").alias("prompt"), label.alias("label"))).alias("value")).write.text(folder)
    return readers.labels(spark, folder).select("session_id", "turn_idx", "label", "prompt")


@query("SELECT g AS session, (row_number() OVER (PARTITION BY g ORDER BY n) - 1)::INT AS turn_idx, round(list_sum(list_transform(vector, lambda x: x)), 6) AS total FROM (SELECT 's' || (n % 7) AS g, n, vector FROM entries WHERE n % 3 <> 0)", "entries")
def s22_prompt_vectors(spark, sf):
    e = S.entries(spark, sf).withColumn("raw", F.base64(M.encode_f32("vector")))
    stage = F.when(F.col("n") % 3 == 0, "skip").otherwise("ok")
    entry = e.select(F.concat(F.lit("s"), F.col("n") % 7).alias("session"), F.timestamp_seconds("n").alias("ts"), F.lit("user-prompt").alias("event"), F.create_map(F.lit("stage"), stage, F.lit("prompt_embed_b64"), F.col("raw")).alias("fields"))
    total = F.aggregate(F.transform("pvec", lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return logs.prompt_vectors(entry).select("session", "turn_idx", F.round(total, 6).alias("total"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE 1 END AS norm, true AS repeatable FROM documents WHERE text IS NOT NULL AND trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def s23_embed_batches(spark, sf):
    d = S.table(spark, sf, "documents").where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).select("doc_id", F.col("text").alias("content"))
    embedder = readers.hashing_embedder(16)
    twice = readers.embed_column(readers.embed_column(d, embedder), embedder, to="again")
    square = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b * b)
    return twice.select("doc_id", F.round(square).cast("int").alias("norm"), (F.col("vector") == F.col("again")).alias("repeatable"))


@query("SELECT * FROM (VALUES ('nomic-embed-text:v1.5', 768), ('bge-m3', 1024), ('all-minilm:latest', 384), ('unknown', NULL)) t(name, dim)")
def s25_model_catalogue(spark, sf):
    return spark.createDataFrame([(n, readers.model_dimension(n)) for n in ("nomic-embed-text:v1.5", "bge-m3", "all-minilm:latest", "unknown")], "name string, dim int")


@query("SELECT * FROM (VALUES (1, 'b'), (2, 'a'), (3, 'c:latest'), (4, NULL)) t(k, model)")
def s26_usable_index(spark, sf):
    cases = [(["a", "b"], ["a:latest", "b"], "b"), (["a", "b"], ["a", "x"], "b"), (["b", "c:latest"], ["c"], ""), (["a"], ["z"], "a")]
    return spark.createDataFrame([(k, readers.usable_index(*c)) for k, c in enumerate(cases, 1)], "k int, model string")


@query("SELECT 'mem:' || id AS id, len(vector)::INT AS dim FROM entries", "entries")
def s27_memory_vectors(spark, sf):
    return S.memories(spark, sf).select("id", F.size("vector").alias("dim"))


@query("SELECT count(*) AS n, true AS same FROM entries", "entries")
def s28_dimension_guard(spark, sf):
    fine = search.assert_dimension(S.entries(spark, sf), 64)
    return fine.agg(F.count("vector").alias("n")).withColumn("same", F.lit(search.same_model("bge-m3:latest", "bge-m3")))


@query("SELECT event_id, 1 AS runs FROM events")
def r13_resume(spark, sf):
    """Edits are re-indexed batch by batch; the run is interrupted once and goes on at its checkpoint."""
    folder = shared_folder(spark)
    edits = S.table(spark, sf, "events").select("event_id")
    edits.repartition(4).write.parquet(f"{folder}/in")
    interrupted = []

    def run(batch, number):
        if number == 1 and not interrupted:
            interrupted.append(number)
            raise InterruptedError("the run is stopped in its second batch")
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")  # a batch that runs again replaces what it left

    for _ in range(2):
        stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        q = rules.reindex(stream, run, f"{folder}/check")
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if not interrupted:
                raise
    return spark.read.schema("event_id bigint").parquet(f"{folder}/out").groupBy("event_id").agg(F.count("*").cast("int").alias("runs"))


# -- sinks ------------------------------------------------------------------------


@query("SELECT printf('%.4f', t1) AS t1, printf('%.4f', t2) AS t2, printf('%.4f', precision_redundant) AS precision_redundant, printf('%.4f', f1_missed) AS f1_missed, tp_redundant::VARCHAR AS tp_redundant, n_turns_scored::VARCHAR AS n_turns_scored FROM (" + Q._GRID + ")", "entries")
def k7_csv_grid(spark, sf):
    return drift.csv_rows(Q.j12_a15_grid(spark, sf)).select("t1", "t2", "precision_redundant", "f1_missed", "tp_redundant", "n_turns_scored")


@query("SELECT * FROM (VALUES ('dim', '64'), ('index_version', '2'), ('model', 'bge-m3')) t(key, value)")
def k10_r5_properties(spark, sf):
    root = shared_folder(spark)
    rows = spark.createDataFrame([("x",)], "id string")
    for _ in range(2):  # each write is a new version, so keys made of it are new too
        version = tables.write(rows, root)
    tables.write_properties(spark, root, {"model": "bge-m3", "dim": "64", "index_version": str(version)})
    return spark.createDataFrame(sorted(tables.properties(spark, root).items()), "key string, value string")


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'content is required' WHEN strlen(text) > 102400 THEN 'content exceeds maximum size of 100KB' END AS content, CASE WHEN coalesce(text, '') = '' THEN 'query is required' WHEN strlen(text) > 10240 THEN 'query exceeds maximum size of 10KB' END AS query, CASE WHEN coalesce(text, '') = '' THEN 'summary is required' WHEN strlen(text) > 51200 THEN 'summary exceeds maximum size of 50KB' END AS summary FROM documents")
def f13_size_limits(spark, sf):
    t = F.col("text")
    return S.table(spark, sf, "documents").select("doc_id", *[X.refusal(k, t).alias(k) for k in ("content", "query", "summary")])


@query("SELECT doc_id, CASE WHEN len(string_split(text, ' ')) > 20 THEN 'too many tags' WHEN list_max(list_transform(string_split(text, ' '), lambda x: strlen(x))) > 100 THEN 'a tag is too long' END AS refused FROM documents")
def f13_tag_limits(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", X.refused_tags(F.split("text", " ")).alias("refused"))


_TOOLS = ["WebFetch", "mcp__github__get", "mcp__memory__recall", "Read", "mcp__", "memory", "mcp__web__x"]


@query("SELECT name, name = 'WebFetch' OR (starts_with(name, 'mcp__') AND NOT starts_with(name, 'mcp__memory__')) AS external FROM (VALUES " + ", ".join(f"('{t}')" for t in _TOOLS) + ") t(name)")
def f17_external_tools(spark, sf):
    return spark.createDataFrame([(t,) for t in _TOOLS], "name string").select("name", transcripts.external(F.col("name")).alias("external"))


# -- plans of a run, members ------------------------------------------------------


@query("SELECT CASE WHEN n % 7 = 0 THEN 'user' WHEN n % 5 = 0 THEN 'index' WHEN n % 5 = 4 THEN 'unchanged' ELSE 'index' END AS reason, count(*) AS n FROM entries GROUP BY 1", "entries")
def j4_r10_incremental_plan(spark, sf):
    e = S.entries(spark, sf).withColumn("file_path", F.concat("id", F.when(F.col("n") % 7 == 0, ".md").otherwise(".go")))
    files = e.select(F.col("file_path").alias("path"), F.col("content").cast("binary").alias("content"), F.when(F.col("n") % 5 == 4, F.col("mod_time")).otherwise(F.col("mod_time") + 1).alias("mtime"), F.lit("other").alias("hash"))
    return index.run_counters(index.plan_run(files, ["*.md"], search.file_facts(e.where("n % 5 <> 0"))))


_MEMBERS = [("root", "/w/app"), ("zeta", "/w/app/z"), ("alpha", "/w/app/a/b"), ("other", "/w/apple"), ("up", "/w")]


@query("SELECT name, path, path = '/w/app' AS is_anchor FROM (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in _MEMBERS) + ") t(name, path) WHERE path = '/w/app' OR starts_with(path, '/w/app/')")
def j10_o4_members(spark, sf):
    return registry.members(spark.createDataFrame(_MEMBERS, "name string, path string"), "/w/app")


@query(f"SELECT n, last IS NOT NULL AND last <> 0 AND {NOW} - last > 1800 AS stale FROM (SELECT n, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 THEN 0 ELSE {NOW} - n * 20 END AS last FROM entries)", "entries")
def r11_stale_index(spark, sf):
    last = F.when(F.col("n") % 5 == 0, None).when(F.col("n") % 5 == 1, 0).otherwise(NOW - F.col("n") * 20)
    return S.entries(spark, sf).select("n", lifecycle.index_stale(last, NOW).alias("stale"))


# -- transcripts ------------------------------------------------------------------


def _block(kind: str, **fields) -> F.Column:
    names = ("name", "id", "tool_use_id", "text", "content")
    return F.struct(F.lit(kind).alias("type"), *[fields.get(n, F.lit(None).cast("string")).alias(n) for n in names])


def _called(spark, sf) -> DataFrame:
    """Assistant turns call a tool (by id, used again and again); user turns bring results."""
    m = S.messages(spark, sf)
    name = F.when(F.col("idx") % 3 == 0, "mcp__memory__remember").when(F.col("idx") % 3 == 1, "WebFetch").otherwise("mcp__memory__search")
    use = F.array(_block("tool_use", name=name, id=(F.col("idx") % 2).cast("string")))
    result = F.array(_block("tool_result", tool_use_id=F.lit("1"), content=F.col("text")), _block("tool_result", tool_use_id=F.lit("0"), content=F.lit("x")))
    return m.withColumn("blocks", F.when(F.col("role") == "assistant", use).when(F.col("role") == "user", result))


_TOOL = "CASE idx % 3 WHEN 0 THEN 'mcp__memory__remember' WHEN 1 THEN 'WebFetch' ELSE 'mcp__memory__search' END"


@query(f"""WITH u AS (SELECT session, idx AS called, (idx % 2)::VARCHAR AS id, {_TOOL} AS name FROM messages WHERE role = 'assistant'), r AS (SELECT session, idx, unnest(['0', '1']) AS id FROM messages WHERE role = 'user')
SELECT r.session, r.idx, r.id AS tool_use_id, arg_max(name, called) AS name FROM r JOIN u ON u.session = r.session AND u.id = r.id AND called < idx GROUP BY ALL""", "messages")
def j8_result_names(spark, sf):
    return transcripts.result_names(_called(spark, sf)).where("name is not null").select("session", "idx", "tool_use_id", "name")


@query("SELECT session, count(*) FILTER (idx % 3 = 0) AS writes FROM messages WHERE role = 'assistant' GROUP BY session", "messages")
def a21_memory_writes(spark, sf):
    return transcripts.memory_writes(_called(spark, sf))


def _hooked(spark, sf) -> DataFrame:
    """Lines in which every user turn is followed by a hook's output (empty for every third) and assistants call tools."""
    c = _called(spark, sf)
    said = F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", F.to_json("blocks").alias("content")).alias("message")))
    hook = F.to_json(F.struct(F.lit("attachment").alias("type"), F.struct(F.when(F.col("idx") % 4 == 0, "SessionStart").otherwise("UserPromptSubmit").alias("hookEvent"), F.when(F.col("idx") % 3 == 0, "").otherwise(F.col("text")).alias("stdout")).alias("attachment")))
    lines = c.select("session", (F.col("idx") * 2).alias("idx"), said.alias("value")).unionByName(c.where("role = 'user'").select("session", (F.col("idx") * 2 + 1).alias("idx"), hook.alias("value")))
    return transcripts.parse(lines)


@query("SELECT session, CASE WHEN idx % 4 = 0 THEN 'SessionStart' ELSE 'UserPromptSubmit' END AS event, count(*) AS n, sum(CASE WHEN idx % 3 = 0 THEN 0 ELSE strlen(text) END)::BIGINT AS bytes FROM messages WHERE role = 'user' GROUP BY ALL", "messages")
def a10_attachments(spark, sf):
    return transcripts.attachments(_hooked(spark, sf))


@query("""WITH t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session ORDER BY idx) AS turn FROM messages),
h AS (SELECT DISTINCT session, turn FROM t WHERE role = 'user' AND idx % 4 <> 0 AND idx % 3 <> 0 AND text <> '')
SELECT session, count(*) AS calls, count(*) FILTER (idx % 3 = 0) AS non_search FROM t JOIN h USING (session, turn) WHERE role = 'assistant' AND idx % 3 <> 1 GROUP BY session""", "messages")
def a11_redundant_calls(spark, sf):
    return transcripts.redundant_calls(_hooked(spark, sf))


@query("SELECT doc_id, replace(source || '/' || lang || '/' || doc_id, '/', '-') AS slug FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def x26_transcript_slug(spark, sf):
    d = S.table(spark, sf, "documents").where("source is not null and lang is not null")
    return d.select("doc_id", X.transcript_slug(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))).alias("slug"))


# -- memory, skills, helpers ------------------------------------------------------


def _recalled(spark, sf, limit: int) -> DataFrame:
    return memory.recall(S.memories(spark, sf), "q", Q.first_vector(spark, sf), limit).select("id")


@query(f"SELECT 'mem:' || id AS id FROM entries ORDER BY {Q.COS} DESC, id LIMIT 100", "entries")
def o2_recall_clamp(spark, sf):
    return _recalled(spark, sf, 500)


@query(f"SELECT 'mem:' || id AS id FROM entries ORDER BY {Q.COS} DESC, id LIMIT 5", "entries")
def o2_recall_default(spark, sf):
    return _recalled(spark, sf, 0)


@query(f"SELECT id, round({Q.COS}, 9) AS score FROM entries", "entries")
def o1_all_scored(spark, sf):
    return Q.rounded(search.top(search.score(S.entries(spark, sf), Q.first_vector(spark, sf)), 0).select("id", "score"), "score")


_SKILL_PATHS = ["a/SKILL.md", "b/SKILL.md", ".hidden/SKILL.md", "c/d/SKILL.md", "SKILL.md", "e/README.md"]


@query("SELECT 2::BIGINT AS n")
def a29_skill_count(spark, sf):
    return readers.skill_count(spark.createDataFrame([(p,) for p in _SKILL_PATHS], "path string"))


@query("""WITH b AS (SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9]+', '-', 'g') AS t FROM documents WHERE text IS NOT NULL), n AS (SELECT *, greatest(1, ceil(length(t) / 8000.0))::INT AS parts FROM b)
SELECT concat('skill:d', doc_id, CASE WHEN parts > 1 THEN ':part-' || i ELSE '' END) AS id, sha256(concat('skill: d', doc_id, chr(10), 'description: about', chr(10), chr(10), substring(t, (i - 1) * 8000 + 1, 8000), CASE WHEN parts > 1 THEN concat(chr(10), chr(10), '(part ', i, ' of ', parts, ')') ELSE '' END)) AS sha
FROM (SELECT *, unnest(range(1, parts + 1)) AS i FROM n)""".replace("8000", str(X.SKILL_CHUNK)))
def x5_x15_skill_chunks(spark, sf):
    d = S.table(spark, sf, "documents").where("text is not null")
    skills = d.select(F.concat(F.lit("d"), "doc_id").alias("name"), F.lit("about").alias("description"), F.regexp_replace("text", "[^a-zA-Z0-9]+", "-").alias("body"))
    return readers.skill_chunks(skills).select("id", F.sha2("content", 256).alias("sha"))


@query(f"SELECT doc_id, regexp_replace(text, '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g') AS collapsed, {Q.prefix_sql('text', 100)} AS head, {Q.clip_sql('text', 80)} AS clipped, left(text, 50) AS capped FROM documents")
def x12_text_helpers(spark, sf):
    t = F.col("text")
    return S.table(spark, sf, "documents").select("doc_id", X.collapse(t).alias("collapsed"), X.byte_prefix(t, 100).alias("head"), X.clip(t, 80).alias("clipped"), F.substring(t, 1, 50).alias("capped"))


@query("SELECT doc_id, 'v' || doc_id || ' of it' AS value FROM documents")
def x16_scalars(spark, sf):
    raw = F.concat(F.lit(' "v'), F.col("doc_id").cast("string"), F.lit('\n  of\tit"\n'))
    return S.table(spark, sf, "documents").select("doc_id", X.one_line(raw).alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'block' WHEN event_id % 3 = 0 THEN 'warn' ELSE 'unknown' END AS class, CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN 'model' ELSE '' END AS rule FROM events")
def x19_model_fallback(spark, sf):
    def judge(commands):
        n = commands.str.extract(r"(\d+)$")[0].astype("int64")
        return ["block" if i % 2 == 0 else "warn" if i % 3 == 0 else "no such class" for i in n]

    e = S.table(spark, sf, "events").select("event_id", F.concat(F.lit("frobnicate "), F.col("event_id").cast("string")).alias("cmd"))
    got = C.upgrade(e, model=judge)
    return got.select("event_id", F.col("verdict.class").alias("class"), F.when(F.col("verdict.rule_id") == "model", "model").otherwise("").alias("rule"))


# -- streams ----------------------------------------------------------------------


def _edits(spark, sf) -> DataFrame:
    return S.table(spark, sf, "events").selectExpr("concat('p', cast(user_id % 5 as string)) project", "concat('f', cast(event_id % 10 as string)) path", "ts")


_EDITS = "(SELECT concat('p', (user_id % 5)::VARCHAR) AS project, concat('f', (event_id % 10)::VARCHAR) AS path, ts FROM events)"


@query(f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY project ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM {_EDITS}),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY project ORDER BY ts) AS run FROM g)
SELECT project, min(ts) AS start, list_sort(list_distinct(list(path))) AS paths FROM s GROUP BY project, run""")
def r2_debounced(spark, sf):
    return rules.debounced(_edits(spark, sf), "1 hour")


@query(f"""WITH RECURSIVE e AS {_EDITS},
g AS (SELECT project, min(ts) AS start FROM e GROUP BY project UNION ALL SELECT g.project, min(e.ts) FROM g JOIN e ON e.project = g.project AND e.ts >= g.start + INTERVAL 2 HOURS GROUP BY g.project, g.start)
SELECT g.project, g.start, list_sort(list_distinct(list(e.path))) AS paths FROM g JOIN e ON e.project = g.project AND e.ts >= g.start AND e.ts < g.start + INTERVAL 2 HOURS GROUP BY 1, 2""")
def r2_debounced_from_first(spark, sf):
    """As a stream in the order of time, so that state holds the edits of a part and those of the wait; an edit far ahead ends the groups."""
    e = _edits(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    ahead = e.agg(F.max("ts").alias("ts")).selectExpr("'end' project", "'' path", "ts + interval 30000 days ts")
    groups = rules.replay(spark, e.unionByName(ahead), lambda s: rules.debounced_from_first(s, "2 hours", "1 minute"), shared_folder(spark), max(2, -(-e.count() // rules.PART)), "ts")
    return groups.where("project <> 'end'").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT file, ((n - 1) % 10 + 1)::INT AS attempt, n % 10 = 0 AS dropped FROM (SELECT concat('f', (user_id % 50)::VARCHAR) AS file, row_number() OVER (PARTITION BY user_id % 50) AS n FROM events)")
def r3_attempts(spark, sf):
    failed = S.table(spark, sf, "events").selectExpr("concat('f', cast(user_id % 50 as string)) file", "false ok")
    return rules.replay(spark, failed, rules.attempts, shared_folder(spark))
