"""Event-log analytics.  An entry has ``ts, level, event, session, fields`` (a string map)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Timestamp, level, rest of a line.
_LINE = r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)) ([A-Z]+) (.*)$"
_PAIR = r'([A-Za-z0-9_.\-]+)=("(?:\\.|[^"\\])*"|[^ ]*)'
AUDIT_CLASSES = ("allow", "warn", "block", "unknown")
TOP_RULES, CANDIDATES = 10, 50


def unquote(value: Column) -> Column:
    """A quoted value's text; other values as they are."""
    inner = F.regexp_extract(value, r'(?s)^"(.*)"$', 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(inner, F.lit("\\\\"), F.lit("\0")), r'\\"', '"'), r"\\n", "\n"), r"\\t", "\t")
    return F.when(value.rlike(r'(?s)^".*"$') & (F.length(value) > 1), F.replace(plain, F.lit("\0"), F.lit("\\"))).otherwise(value)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of text lines; lines without a good time, level or event go.  A repeated key's last value counts.

    Each step is a generator of one row: conditions and lambdas after it read its columns, where after a plain projection they
    would make them again, with all that they are made of.
    """
    step = lambda df, **columns: df.select(F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))
    key = lambda p: F.substring_index(p, "=", 1)

    def pair(p):
        value = F.substr(p, F.length(key(p)) + 2)
        return F.struct(key(p).alias("k"), F.when(value.startswith('"'), unquote(value)).otherwise(value).alias("v"))

    rows = step(lines, line=F.col(column)).where(F.col("line").rlike(_LINE))
    at, level, rest = (F.regexp_extract("line", _LINE, i) for i in (1, 2, 3))
    rows = step(rows, ts=F.try_to_timestamp(at), level=level, pairs=F.regexp_extract_all(rest, F.lit(_PAIR), F.lit(0))).where("ts is not null")
    rows = step(rows, ts=F.col("ts"), level=F.col("level"), pairs=F.col("pairs"), keys=F.transform("pairs", key))
    last = F.filter("pairs", lambda p, i: ~F.array_contains(F.slice("keys", i + 2, F.size("keys")), key(p)))
    rows = step(rows, ts=F.col("ts"), level=F.col("level"), fields=F.map_from_entries(F.transform(last, pair)))
    rows = rows.where(F.coalesce(F.col("fields")["event"], F.lit("")) != "")
    return rows.select("ts", "level", F.col("fields")["event"].alias("event"), F.coalesce(F.col("fields")["session"], F.lit("")).alias("session"), F.map_filter("fields", lambda k, _: ~k.isin("event", "session")).alias("fields"))


def format_line(ts: Column, level: Column, event: Column, fields: Column, home: str = "") -> Column:
    """The line of an entry: keys in order, values quoted where needed, ``home`` shown as ``~``."""
    def value(v):
        v = F.replace(v, F.lit(home), F.lit("~")) if home else v
        escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
        return F.when(v.rlike(r'[\s"=]') | (v == ""), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(v)

    pairs = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"])))
    return F.concat_ws(" ", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), level, F.concat(F.lit("event="), event), F.array_join(pairs, " "))


def select(entries: DataFrame, session: str = "", event: str = "", since=None, until=None) -> DataFrame:
    """Filters; both ends of the time are inclusive."""
    for column, x in (("session", session), ("event", event)):
        if x:
            entries = entries.where(F.col(column) == x)
    if since is not None:
        entries = entries.where(F.col("ts") >= F.lit(since))
    return entries if until is None else entries.where(F.col("ts") <= F.lit(until))


def tail(lines: DataFrame, level: str = "", event: str = "", project: str = "", column: str = "value") -> DataFrame:
    """Raw lines: an equal level, and ``event=``/``project=`` as substrings.  Works on streams too."""
    c = F.col(column)
    if level:
        lines = lines.where(F.split(c, " ")[1] == level)
    for key, x in (("event", event), ("project", project)):
        if x:
            lines = lines.where(c.contains(f"{key}={x}"))
    return lines


def seconds(text: str) -> float:
    """A duration like ``1h30m``, ``250ms`` or ``7d``."""
    if m := re.fullmatch(r"(\d+)d", text.strip()):
        return int(m[1]) * 86_400.0
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|us|ns|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"no duration: {text!r}")
    unit = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
    return sum(float(a) * unit[b] for a, b in parts)


def _count(condition: Column) -> Column:
    return F.count_if(condition)


def whole_number(text: Column) -> Column:
    """The number of a string of digits, 0 for anything else."""
    return F.when(text.rlike(r"^[0-9]+$"), F.coalesce(text.try_cast("bigint"), F.lit(0))).otherwise(0).cast("bigint")


def by_session(entries: DataFrame) -> DataFrame:
    """One row a session with its counters; blank sessions go.  One shuffle, combined map-side."""
    e, f = F.col("event"), F.col("fields")
    prompt, stage = e == "user-prompt", F.coalesce(f["stage"], F.lit(""))
    return entries.where(F.coalesce("session", F.lit("")) != "").groupBy("session").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        _count(e == "session-start").alias("session_starts"), _count(e == "session-end").alias("session_ends"),
        _count(prompt).alias("prompts"), _count(prompt & (stage == "cache_hit")).alias("cache_hits"), _count(prompt & (stage == "skip")).alias("skips"),
        _count(prompt & stage.isin("ok", "cache_hit")).alias("cache_total"), F.sum(F.when(prompt, whole_number(f["bytes"])).otherwise(0)).alias("prompt_bytes"),
        _count(e == "pre-tool-use").alias("tool_checks"), _count(e == "post-edit").alias("edits"),
        _count((e == "post-edit-actor") & (F.coalesce(f["msg"], F.lit("")) == "reindex_ok")).alias("reindexes"),
        _count(e == "stop").alias("stops"), F.sum(F.when(e == "stop", whole_number(f["bytes"])).otherwise(0)).alias("stop_bytes"),
    )


def verdicts(entries: DataFrame) -> DataFrame:
    """``session, class, n`` of the guard's verdicts, the long form of a map."""
    rows = entries.where((F.col("event") == "pre-tool-use") & (F.coalesce("session", F.lit("")) != ""))
    return rows.select("session", F.col("fields")["class"].alias("class")).where(F.coalesce("class", F.lit("")) != "").groupBy("session", "class").agg(F.count("*").alias("n"))


def with_verdict_map(sessions: DataFrame, found: DataFrame) -> DataFrame:
    maps = found.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("verdicts"))
    return sessions.join(maps, "session", "left")


def latest(sessions: DataFrame) -> DataFrame:
    """The session seen last; the greater id of two."""
    return sessions.orderBy(F.col("last_seen").desc(), F.col("session").desc()).limit(1)


def audit(entries: DataFrame) -> dict[str, DataFrame]:
    """The guard's audit as tables: ``classes`` (zeros included), ``modes``, ``judged``, ``versions``, ``rules`` and ``candidates``."""
    f = F.col("fields")
    get = lambda k: F.coalesce(f[k], F.lit(""))
    checks = entries.where(F.col("event") == "pre-tool-use").select("ts", "session", get("stage").alias("stage"), get("class").alias("class"), get("mode").alias("mode"), get("rule_id").alias("rule"), get("reason").alias("reason"), get("prompt_version").alias("version"))
    judge = F.col("stage") == "llm.classifier.classify"
    counted = checks.where(~judge & (F.col("class") != ""))
    seeds = entries.sparkSession.createDataFrame([(c,) for c in AUDIT_CLASSES], "class string")
    found = counted.groupBy("class").agg(F.count("*").alias("n"))
    blocks = counted.where(F.col("class") == "block").withColumn("rule", F.when(F.col("rule") == "", "-").otherwise(F.col("rule")))
    return {
        "classes": seeds.join(found, "class", "full").select("class", F.coalesce("n", F.lit(0)).alias("n")),
        "modes": counted.where(F.col("mode") != "").groupBy("mode").agg(F.count("*").alias("n")),
        "judged": counted.where(F.col("rule").startswith("llm:")).groupBy("class").agg(F.count("*").alias("n")),
        "versions": checks.where(judge & (F.col("version") != "")).groupBy("version").agg(F.count("*").alias("n")),
        "rules": blocks.groupBy("rule").agg(F.count("*").alias("n"), F.min(F.when(F.col("reason") != "", F.struct("ts", "reason")))["reason"].alias("sample")).orderBy(F.col("n").desc(), "rule").limit(TOP_RULES),
        "candidates": blocks.where(F.col("mode") == "shadow").select("ts", "rule", "reason", "session").orderBy("ts", "session").limit(CANDIDATES),
    }


def promotion(entries: DataFrame, since_seconds: float | None = None) -> DataFrame:
    """One row: ``total, blocks, window_s, promote``: also true where blocks were seen in less than a day."""
    f = F.col("fields")
    checks = entries.where((F.col("event") == "pre-tool-use") & (F.coalesce(f["stage"], F.lit("")) != "llm.classifier.classify") & (F.coalesce(f["class"], F.lit("")) != ""))
    at = F.col("ts").cast("timestamp")
    spread = F.coalesce(F.unix_micros(F.max(at)) - F.unix_micros(F.min(at)), F.lit(0)) / 1e6
    out = checks.agg(F.count("*").alias("total"), F.count_if(f["class"] == "block").alias("blocks"), (F.lit(float(since_seconds)) if since_seconds else spread).alias("window_s"))
    return out.withColumn("promote", (F.col("blocks") == 0) | (F.col("window_s") < 86_400))


def nth_prompts(entries: DataFrame, ok_only: bool = True) -> DataFrame:
    """``session, n, ts, fields``: prompts numbered from 0; ``ok_only`` counts stage ok alone."""
    rows = entries.where((F.col("event") == "user-prompt") & (F.coalesce("session", F.lit("")) != ""))
    if ok_only:
        rows = rows.where(F.col("fields")["stage"] == "ok")
    return rows.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy("ts")) - 1).select("session", "n", "ts", "fields")


def prompt_vectors(entries: DataFrame) -> DataFrame:
    """``session, turn_idx, pvec``: the vectors that ok prompts carry as base64."""
    from tesserae.functions.vector import decode_f32

    rows = nth_prompts(entries).select("session", F.col("n").alias("turn_idx"), F.unbase64(F.col("fields")["prompt_embed_b64"]).alias("raw"))
    return rows.where("raw is not null").withColumn("pvec", decode_f32("raw")).drop("raw")
