"""Transcript analytics.

``messages`` rows are ``session, idx, role, text`` and, where tools matter,
``blocks``: array<struct<type, name, id, tool_use_id, text>>.  Orders are within
a session, so a session is a window partition and sessions spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import text as X

BLOCK = "struct<type:string,name:string,id:string,tool_use_id:string,text:string,content:string>"
_MESSAGE = "struct<role:string,content:string,usage:struct<input_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,output_tokens:bigint>>"
_ENVELOPE = f"type string, role string, content string, sessionId string, timestamp string, isMeta boolean, message {_MESSAGE}, attachment struct<type:string,hookEvent:string,stdout:string>"
WINDOW_BYTES, SUMMARY_BYTES, EXCERPT = 800, 20 * 1024, 200
JOINT = "\n\n---\n\n"
#: The tools that rules expect, by rule; a deployment names its own.
EXPECTED = {"read_large_file": "search", "user_correction": "remember", "external_content": "index_text", "task_start_recall": "recall"}
READER, LARGE, EXTERNAL = "Read", 200, 500


def order() -> W:
    return W.partitionBy("session").orderBy("idx")


def parse(lines: DataFrame) -> DataFrame:
    """JSONL lines (``session, idx, value``) as ``session, idx, j`` (null for malformed ones)."""
    return lines.select("session", "idx", F.from_json("value", _ENVELOPE).alias("j"), F.try_parse_json("value").isNull().alias("malformed"))


def content_text(raw: Column) -> Column:
    """Text of a content that is a string or an array of blocks (text blocks joined by line ends)."""
    blocks = F.from_json(raw, f"array<{BLOCK}>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
    return F.when(raw.isNull(), "").when(raw.rlike(r"^\s*\["), F.coalesce(joined, F.lit(""))).otherwise(raw)


def messages(parsed: DataFrame) -> DataFrame:
    """``session, idx, role, text, blocks`` of both line shapes; meta lines and other types go."""
    j = F.col("j")
    raw = F.coalesce(j["content"], j["message"]["content"])
    role = F.coalesce(j["role"], j["message"]["role"], j["type"])
    rows = parsed.where(j.isNotNull() & ~F.coalesce(j["isMeta"], F.lit(False)) & role.isin("user", "assistant", "system"))
    blocks = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, f"array<{BLOCK}>"))
    return rows.select("session", "idx", role.alias("role"), content_text(raw).alias("text"), blocks.alias("blocks"))


def turns(rows: DataFrame) -> DataFrame:
    """``turn``: user messages so far less one; -1 before the first."""
    return rows.withColumn("turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(order()) - 1)


def totals(parsed: DataFrame) -> DataFrame:
    """One row a session: messages, token sums, malformed lines, first and last time."""
    j = F.col("j")
    u = lambda k: F.coalesce(F.sum(j["message"]["usage"][k]), F.lit(0)).alias(k)
    ts = F.try_to_timestamp(j["timestamp"])
    return parsed.groupBy("session").agg(
        F.count_if(j["type"] == "user").alias("user_messages"), F.count_if(j["type"] == "assistant").alias("assistant_messages"),
        u("input_tokens"), u("cache_creation_input_tokens"), u("cache_read_input_tokens"), u("output_tokens"),
        F.count_if("malformed").alias("malformed"), F.coalesce(F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts)), F.lit(0)).alias("duration_s"),
    )


def tool_uses(parsed: DataFrame) -> DataFrame:
    """``session, idx, turn, tool`` of each tool call; every user line begins a turn."""
    j = F.col("j")
    rows = parsed.withColumn("role", j["type"])
    rows = turns(rows).where(j["type"] == "assistant")
    blocks = F.from_json(j["message"]["content"], f"array<{BLOCK}>")
    return rows.select("session", "idx", "turn", F.explode(F.filter(blocks, lambda b: b["type"] == "tool_use")).alias("b")).select("session", "idx", "turn", F.col("b.name").alias("tool"))


def attachments(parsed: DataFrame) -> DataFrame:
    """``session, event, n, bytes`` of hook attachments."""
    a = F.col("j")["attachment"]
    rows = parsed.where(a.isNotNull() & (F.coalesce(a["hookEvent"], F.lit("")) != ""))
    return rows.groupBy("session", a["hookEvent"].alias("event")).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.coalesce(a["stdout"], F.lit("")))).alias("bytes"))


def redundant_calls(parsed: DataFrame, prefix: str = "mcp__memory__", search: str = "search") -> DataFrame:
    """``session, calls, non_search``: own tools called in a turn after the prompt hook had injected something."""
    j = F.col("j")
    hit = (j["attachment"]["hookEvent"] == "UserPromptSubmit") & (F.coalesce(j["attachment"]["stdout"], F.lit("")) != "")
    rows = turns(parsed.withColumn("role", j["type"]))
    before = F.max(F.coalesce(hit, F.lit(False))).over(W.partitionBy("session", "turn").orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("hit", before).where("hit and j.type = 'assistant'")
    calls = rows.select("session", F.explode(F.from_json(j["message"]["content"], f"array<{BLOCK}>")).alias("b")).where((F.col("b.type") == "tool_use") & F.col("b.name").startswith(prefix))
    return calls.groupBy("session").agg(F.count("*").alias("calls"), F.count_if(X.tool_name(F.col("b.name")) != search).alias("non_search"))


def marker_hits(rows: DataFrame) -> DataFrame:
    """User messages that show a marker, with the assistant message right before: ``session, idx, marker, excerpt, window``."""
    said = rows.withColumns({"prev_role": F.lag("role").over(order()), "prev_text": F.lag("text").over(order())})
    hits = said.where(F.col("role") == "user").withColumn("marker", X.marker(F.col("text"))).where("marker is not null")
    own = F.concat(F.lit("user: "), X.byte_prefix(F.col("text"), WINDOW_BYTES))
    before = F.concat(F.lit("assistant: "), X.byte_prefix(F.col("prev_text"), WINDOW_BYTES), F.lit("\n\n"))
    window = F.when((F.col("prev_role") == "assistant") & (F.col("prev_text") != ""), F.concat(before, own)).otherwise(own)
    return hits.select("session", "idx", "marker", X.byte_prefix(F.col("text"), EXCERPT).alias("excerpt"), window.alias("window"))


def distinct_windows(hits: DataFrame) -> DataFrame:
    """The first of equal windows of a session."""
    return hits.groupBy("session", "window").agg(F.min("idx").alias("idx"))


def last_replies(rows: DataFrame, n: int = 3) -> DataFrame:
    """The last ``n`` assistant messages of each session."""
    back = F.row_number().over(W.partitionBy("session").orderBy(F.col("idx").desc()))
    return rows.where(F.col("role") == "assistant").withColumn("back", back).where(F.col("back") <= n)


def session_summary(rows: DataFrame) -> DataFrame:
    """``session, summary``: distinct windows in order, else the last replies, joined and cut to 20 KB."""
    win = distinct_windows(marker_hits(rows)).withColumn("rank", F.lit(0))
    tail = last_replies(rows).where("text <> ''").select("session", X.byte_prefix(F.col("text"), WINDOW_BYTES).alias("window"), "idx").withColumn("rank", F.lit(1))
    both = win.select("session", "window", "idx", "rank").unionByName(tail)
    first = both.withColumn("least", F.min("rank").over(W.partitionBy("session"))).where("rank = least")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "window"))), lambda x: x["window"]), JOINT)
    return first.groupBy("session").agg(X.byte_prefix(joined, SUMMARY_BYTES).alias("summary"))


def has_tool(blocks: Column, tool: str) -> Column:
    return F.coalesce(F.exists(blocks, lambda b: (b["type"] == "tool_use") & (X.tool_name(b["name"]) == tool)), F.lit(False))


def result_names(rows: DataFrame) -> DataFrame:
    """Each tool result with the name of the latest earlier call of its id: ``session, idx, tool_use_id, name, content``.

    Calls and results of an id lie in one order, and each result takes the last name
    before it, so many calls and results of one id cost one sort and no pairs.  Of calls
    in one message the last counts; a result without an id has no name.
    """
    b = rows.select("session", "idx", F.posexplode("blocks").alias("pos", "b")).where("b.type in ('tool_use', 'tool_result')")
    use = F.col("b.type") == "tool_use"
    both = b.select(
        "session", "idx", "pos", use.alias("use"), F.when(use, F.col("b.id")).otherwise(F.col("b.tool_use_id")).alias("tool_use_id"),
        F.when(use, F.struct(F.col("b.name").alias("name"))).alias("call"), F.when(~use, content_text(F.col("b.content"))).alias("content"),
    )
    # a result stands before the calls of its own message
    before = W.partitionBy("session", "tool_use_id").orderBy("idx", "use", "pos").rowsBetween(W.unboundedPreceding, 0)
    name = F.when(F.col("tool_use_id").isNotNull(), F.last("call", ignorenulls=True).over(before)["name"])
    return both.withColumn("name", name).where(~F.col("use")).select("session", "idx", "tool_use_id", "content", "name")


def external(name: Column, own: str = "memory") -> Column:
    return (name == "WebFetch") | (name.startswith("mcp__") & ~name.startswith(f"mcp__{own}__"))


def rule_checks(rows: DataFrame, expected: dict[str, str] | None = None, own: str = "memory") -> DataFrame:
    """``session, rule, expected_tool, idx, followed, excerpt``: every trigger of the four rules."""
    tools = expected or EXPECTED
    w = order()
    numbered = rows.withColumn("at", F.row_number().over(w))
    for name, tool in tools.items():
        numbered = numbered.withColumn(f"has_{name}", (F.col("role") == "assistant") & has_tool(F.col("blocks"), tool))
    ahead = {f"{name}_{k}": F.coalesce(F.lead(f"has_{name}", k).over(w), F.lit(False)) for name in tools for k in (1, 2)}
    numbered = numbered.withColumns(ahead | {"next_blocks": F.lead("blocks").over(w)})
    out = lambda df, rule, followed, excerpt: df.select("session", F.lit(rule).alias("rule"), F.lit(tools[rule]).alias("expected_tool"), "idx", followed.alias("followed"), excerpt.alias("excerpt"))

    reads = numbered.where(F.col("role") == "assistant").withColumn("read_id", F.get(F.filter("blocks", lambda b: (b["type"] == "tool_use") & (b["name"] == READER)), F.lit(0))["id"]).where(F.coalesce("read_id", F.lit("")) != "")
    got = F.filter("next_blocks", lambda b: (b["type"] == "tool_result") & (b["tool_use_id"] == F.col("read_id")))
    reads = reads.withColumn("result", content_text(F.try_element_at(got, F.lit(1))["content"])).where(F.length("result") - F.length(F.replace("result", F.lit("\n"), F.lit(""))) > LARGE)
    first = out(reads, "read_large_file", F.col("has_read_large_file") | F.col("read_large_file_2"), F.concat(F.lit("Read result: "), X.byte_prefix(F.col("result"), 187)))

    fixes = numbered.where((F.col("role") == "user") & (F.col("text") != "") & F.col("text").rlike(X.word_pattern(X.MARKERS["correction"])))
    second = out(fixes, "user_correction", F.col("user_correction_1"), X.byte_prefix(F.col("text"), EXCERPT))

    named = result_names(rows.where("role = 'user'").select("session", "idx", "blocks").unionByName(rows.where("role <> 'user'").select("session", "idx", "blocks")))
    named = named.where(external(F.col("name"), own) & (F.octet_length("content") > EXTERNAL)).join(numbered.where("role = 'user'").select("session", "idx", "external_content_1"), ["session", "idx"])
    third = out(named, "external_content", F.col("external_content_1"), X.byte_prefix(F.concat(F.lit("External content from "), "name", F.lit(": "), "content"), EXCERPT))

    opener = numbered.where("role = 'user' and text <> ''").groupBy("session").agg(F.min_by(F.struct("idx", "text", "at"), "idx").alias("o")).select("session", "o.*").where(X.planning(F.col("text")))
    replies = numbered.where("role = 'assistant'").select("session", F.col("at").alias("reply_at"), "has_task_start_recall")
    after = opener.join(replies, "session", "left").where("reply_at is null or reply_at > at")
    ranked = after.withColumn("r", F.row_number().over(W.partitionBy("session").orderBy("reply_at"))).where("r <= 3")
    told = ranked.groupBy("session").agg(F.max("has_task_start_recall").alias("done"))
    fourth = out(opener.join(told, "session", "left"), "task_start_recall", F.coalesce("done", F.lit(False)), X.byte_prefix(F.col("text"), EXCERPT))
    return first.unionByName(second).unionByName(third).unionByName(fourth)


def rule_totals(checks: DataFrame) -> DataFrame:
    return checks.groupBy("session").agg(F.count("*").alias("triggers"), F.count_if("followed").alias("followed"), F.count_if(~F.col("followed")).alias("misses"))


def memory_writes(rows: DataFrame, tools: tuple[str, ...] = ("remember", "index_text", "ingest_session")) -> DataFrame:
    b = rows.where("role = 'assistant'").select("session", F.explode("blocks").alias("b")).where("b.type = 'tool_use'")
    return b.groupBy("session").agg(F.count_if(X.tool_name(F.col("b.name")).isin(*tools)).alias("writes"))


def review(hits: DataFrame, checks: DataFrame, writes: DataFrame) -> DataFrame:
    """The last-session review: up to 3 hits by marker priority and 5 misses a session; quiet sessions (<=2 hits, a write, no miss) go."""
    rank = F.array_position(F.array(*map(F.lit, X.MARKERS)), F.col("marker"))
    best = hits.withColumn("r", F.row_number().over(W.partitionBy("session").orderBy(rank, "idx"))).where("r <= 3").select("session", F.lit("candidate").alias("kind"), F.col("marker").alias("what"), "excerpt", "r")
    missed = checks.where("not followed").withColumn("r", F.row_number().over(W.partitionBy("session").orderBy("idx", "rule"))).where("r <= 5").select("session", F.lit("miss").alias("kind"), F.col("rule").alias("what"), "excerpt", "r")
    n = hits.groupBy("session").agg(F.count("*").alias("hits")).join(checks.where("not followed").groupBy("session").agg(F.count("*").alias("misses")), "session", "full").join(writes, "session", "full").na.fill(0, ["hits", "misses", "writes"])
    loud = n.where("not (hits <= 2 and writes >= 1 and misses = 0)").select("session")
    return best.unionByName(missed).join(loud, "session", "left_semi")


def review_block(hits: DataFrame, ended: DataFrame, now: int, max_days: int = 7) -> DataFrame:
    """``session, block``: marker counts in fixed order, for sessions (``session, ended_at``) of the last days."""
    counts = hits.join(ended.where(F.lit(now) - F.col("ended_at") <= max_days * 86_400), "session").groupBy("session").agg(*[F.count_if(F.col("marker") == m).alias(m) for m in X.MARKERS])
    parts = [F.when(F.col(m) > 0, F.concat(F.lit(f"{m}: "), F.col(m))) for m in X.MARKERS]
    return counts.select("session", F.concat_ws(", ", *parts).alias("block"))
