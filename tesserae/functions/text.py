"""Text expressions.  Sizes are bytes where a name says so, else characters.

White space is ``[\\t\\n\\f\\r ]`` throughout and word boundaries are ASCII, so that
RE2-style engines agree on texts in any language.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\f\r ]"
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
CHUNK_BYTES = 1500
MOST_BYTES = {"content": 100 * 1024, "summary": 50 * 1024, "query": 10 * 1024}
MOST_TAGS, MOST_TAG_BYTES = 20, 100
SUMMARY_CHUNK = 500
SKILL_CHUNK = 1800

#: Topic tags and the words that stand for them; fixed values.
TOPICS = {
    "database": "sql|sqlite|postgres|mysql|mongodb|redis|database|db",
    "testing": "test|tdd|unit test|integration test|e2e",
    "api": "api|rest|grpc|graphql|endpoint|webhook",
    "deployment": "deploy|kubernetes|docker|ci/cd|pipeline|flux",
    "security": "auth|security|token|credential|encrypt|ssl|tls",
    "performance": "performance|latency|throughput|cache|optimization",
    "workflow": "workflow|process|pr|review|branch|commit|git",
    "architecture": "architecture|design|pattern|refactor|migration",
    "frontend": "frontend|react|vue|angular|css|html|ui|ux",
    "backend": "backend|server|microservice|queue|worker",
}
#: Memory types and the phrases that tell them, first match first; fixed values.
TYPE_PHRASES = {
    "decision": ("decided", "decision", "chose", "chosen", "we will", "agreed", "instead of"),
    "preference": ("prefers", "preference", "likes", "always use", "never use", "rather", "favorite"),
    "context": ("currently", "working on", "in progress", "context", "background", "situation"),
}
#: Marker classes by priority, and what tells them; fixed values.
MARKERS = {
    "correction": r"(?i)\bactually\b|\bno,?\s|\bdon['']?t\b|\bstop\b|\binstead\b|\bwrong\b",
    "workaround": r"(?i)\bworkaround\b|\bhack\b|\btrick\b|\bgotcha\b",
    "teaching": r"(?i)\bturns out\b|\bfyi\b|\bheads up\b|\bfor reference\b",
    "frustration": r"(?i)\bfuck\b|\bwhy\b|\bbroken\b",
}
#: Opening messages that look back; fixed value.
PLANNING = r"(?i)\bpast decisions?\b|\bplan(s|ning)?\b|\barchitecture\b|\bprior(\s+issues?)?\b"


def word_pattern(p: str) -> str:
    """``p`` for Spark's matcher: word boundaries and white space are ASCII."""
    inside = "[A-Za-z0-9_]"
    boundary = f"(?:(?<={inside})(?!{inside})|(?<!{inside})(?={inside}))"
    return p.replace(r"\b", boundary).replace(r"\s", SPACE)


def collapse(s: Column) -> Column:
    return F.regexp_replace(s, f"{SPACE}+", " ")


def trim(s: Column) -> Column:
    """Without white space at both ends (Spark's own ``trim`` knows blanks only)."""
    return F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+\z", "")


def content_hash(s: Column) -> Column:
    return F.sha2(collapse(F.lower(trim(s))), 256)


def byte_prefix(s: Column, n: int) -> Column:
    """The longest prefix of whole characters in ``n`` bytes."""
    raw = F.encode(s, "utf-8")
    cut = None
    for k in range(3):  # a character ends where no continuation byte follows
        following = F.hex(F.substring(raw, n - k + 1, 1))
        whole, part = (following < "80") | (following > "BF"), F.decode(F.substring(raw, 1, n - k), "utf-8")
        cut = F.when(whole, part) if cut is None else cut.when(whole, part)
    return F.when(F.octet_length(s) <= n, s).otherwise(cut.otherwise(F.decode(F.substring(raw, 1, n - 3), "utf-8")))


def clip(s: Column, n: int) -> Column:
    """A prefix of ``n`` bytes and ``...`` where something was cut."""
    return F.when(F.octet_length(s) <= n, s).otherwise(F.concat(byte_prefix(s, n), F.lit("...")))


def summary(content: Column, kind: Column, identifier: Column) -> Column:
    """``kind identifier``, else the first line that is no comment, else the content; 120 bytes."""
    ident = F.coalesce(identifier, F.lit(""))
    named = F.when(F.coalesce(kind, F.lit("")) == "", ident).otherwise(F.concat_ws(" ", kind, ident))
    lines = F.filter(F.transform(F.split(content, "\n"), trim), lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("#") & ~x.startswith("/*"))
    first = F.try_element_at(lines, F.lit(1))
    return F.when(ident != "", named).otherwise(clip(F.coalesce(first, content), 120))


def context_path(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def tokens_floor(s: Column) -> Column:
    return F.floor(F.octet_length(s) / 4).cast("bigint")


def tokens_ceil(s: Column) -> Column:
    return F.floor((F.octet_length(s) + 3) / 4).cast("bigint")


#: Words by which a topic's phrase is looked for at all.
_PHRASES = {"ci": "ci/cd"}


def tags(content: Column) -> Column:
    """Topics in order, then up to five CamelCase words in lower case, distinct.

    One pass over the words against the set of all topics' words; topics are then
    looked for among the few that were found.  A phrase that ends in a word of its own
    topic needs no look; others are matched only where their first word was found.
    """
    topics = {name: words.split("|") for name, words in TOPICS.items()}
    known = sorted({w for words in topics.values() for w in words if w.isalnum()} | set(_PHRASES))
    low = F.lower(content)
    found = F.array_intersect(F.split(low, "[^A-Za-z0-9_]+"), F.array(*map(F.lit, known)))
    camel = F.regexp_extract_all(content, F.lit(rf"{LEFT}([A-Z][a-z]+(?:[A-Z][a-z]+)+){RIGHT}"), F.lit(1))

    def named(found: Column) -> Column:
        out = []
        for name, words in topics.items():
            hit = F.arrays_overlap(found, F.array(*[F.lit(w) for w in words if w.isalnum()]))
            for first, phrase in _PHRASES.items():
                if phrase in words:
                    hit = hit | (F.array_contains(found, first) & low.rlike(f"{LEFT}{phrase}{RIGHT}"))
            out.append(F.when(hit, name))
        return F.array_compact(F.array(*out))

    # a lambda of one row, so that the words are looked up once
    by_topic = F.flatten(F.transform(F.array(found), named))
    return F.array_distinct(F.concat(by_topic, F.transform(F.slice(camel, 1, 5), F.lower)))


def memory_type(content: Column) -> Column:
    low = F.lower(content)
    out = None
    for name, phrases in TYPE_PHRASES.items():
        hit = reduce(lambda a, b: a | b, [low.contains(p) for p in phrases])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("fact")


def marker(content: Column) -> Column:
    """The first marker class that ``content`` shows, or null."""
    out = None
    for name, p in MARKERS.items():
        hit = content.rlike(word_pattern(p))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def planning(content: Column) -> Column:
    return content.rlike(word_pattern(PLANNING))


def merge_tags(old: Column, new: Column, most: int = 20) -> Column:
    """All old tags, then new ones up to ``most`` in all, distinct."""
    have = F.array_distinct(old)
    return F.concat(have, F.slice(F.array_except(new, have), F.lit(1), F.greatest(F.lit(most) - F.size(have), F.lit(0))))


def sentences(s: Column) -> Column:
    """Pieces that end at ``.``, ``!`` or ``?`` before white space; empty ones and bare marks go."""
    pieces = F.transform(F.split(s, rf"(?<=[.!?]){SPACE}+"), trim)
    return F.filter(pieces, lambda x: ~x.rlike(r"^[.!?]?$"))


def _fold(sizes: Column, limit: int, sep: int) -> Column:
    """Greedy packing of integer sizes: ``[(first, last)]`` spans, 1-based.

    An item goes to the open span while the span, a separator and the item fit.
    """
    start = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("spans"), F.lit(1).alias("a"), F.lit(0).cast("bigint").alias("len"), F.lit(0).alias("i"))

    def step(acc, n):
        i = acc["i"] + 1
        flush = (acc["len"] > 0) & (acc["len"] + n + sep > limit)
        return F.struct(
            F.when(flush, F.concat(acc["spans"], F.array(F.struct(acc["a"].alias("a"), acc["i"].alias("b"))))).otherwise(acc["spans"]).alias("spans"),
            F.when(flush, i).otherwise(acc["a"]).alias("a"),
            F.when(flush | (acc["len"] == 0), n).otherwise(acc["len"] + n + sep).cast("bigint").alias("len"),
            i.alias("i"),
        )

    def end(acc):
        return F.when(acc["len"] > 0, F.concat(acc["spans"], F.array(F.struct(acc["a"].alias("a"), acc["i"].alias("b"))))).otherwise(acc["spans"])

    return F.aggregate(sizes, start, step, end)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _joined(parts: Column, span: Column, sep: str) -> Column:
    return F.array_join(F.slice(parts, span["a"], span["b"] - span["a"] + 1), sep)


def paragraph_chunks(text: Column, limit: int = CHUNK_BYTES) -> Column:
    """Runs of paragraphs (between blank lines) of up to ``limit`` bytes, as strings."""
    lines = F.filter(F.transform(F.split(text, "\n\n+"), lambda x: F.regexp_replace(x, r"^\n+|\n+\z", "")), lambda x: x != "")
    packed = _let(lines, lambda ps: F.transform(_fold(F.transform(ps, lambda x: F.octet_length(x).cast("bigint")), limit, 2), lambda s: _joined(ps, s, "\n\n")))
    return F.when(F.octet_length(text) <= limit, F.array(text)).otherwise(packed)


def summary_chunks(text: Column, limit: int = SUMMARY_CHUNK) -> Column:
    """Sentences packed to chunks of up to ``limit`` bytes; blank text gives none."""
    packed = _let(sentences(text), lambda ps: F.transform(_fold(F.transform(ps, lambda x: F.octet_length(x).cast("bigint")), limit, 1), lambda s: _joined(ps, s, " ")))
    whole = trim(text)
    return F.when(whole == "", F.array().cast("array<string>")).when(F.octet_length(whole) <= limit, F.array(whole)).otherwise(packed)


def line_spans(text: Column, limit: int = CHUNK_BYTES) -> Column:
    """Line spans ``(a, b)`` of chunks: one for a short file, else greedy; a longer line stands alone."""
    sizes = F.transform(F.split(text, "\n"), lambda x: F.octet_length(x).cast("bigint"))
    whole = F.array(F.struct(F.lit(1).alias("a"), F.size(F.split(text, "\n")).alias("b")))
    return F.when(F.octet_length(text) <= limit, whole).otherwise(_fold(sizes, limit, 1))


def line_chunks(text: Column, limit: int = CHUNK_BYTES) -> Column:
    """``(start_line, end_line, content)`` of each chunk; blank lines at a chunk's start are in its span only."""
    short = F.octet_length(text) <= limit

    def chunk(lines, s):
        joined = _joined(lines, s, "\n")
        return F.struct(s["a"].alias("start_line"), s["b"].alias("end_line"), F.when(short, joined).otherwise(F.regexp_replace(joined, r"^\n+", "")).alias("content"))

    return _let(F.split(text, "\n"), lambda lines: F.transform(line_spans(text, limit), lambda s: chunk(lines, s)))


def slug(name: Column, fallback: str = "skill") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", fallback).otherwise(s)


def base_id(skill_id: Column) -> Column:
    return F.regexp_replace(skill_id, r":part-[0-9]+$", "")


def cache_key(prompt: Column, scope: Column, version: Column) -> Column:
    """SHA-256 of the normalised prompt's first 2048 bytes, the scope and the index version."""
    text = byte_prefix(collapse(F.lower(trim(prompt))), 2048)
    return F.sha2(F.concat(text, F.lit("\0"), scope, F.lit("\0v"), version.cast("string")), 256)


def suppress_key(project: Column, code: Column) -> Column:
    return F.substring(F.sha2(F.concat(project, F.lit("\0"), code), 256), 1, 32)


def memory_context(explicit: Column, scope: Column) -> Column:
    """An explicit path without ``./``, else the scope, else the empty string."""
    given = F.regexp_replace(trim(explicit), r"^\./", "")
    return F.coalesce(F.when(given != "", given), scope, F.lit(""))


def tool_name(name: Column) -> Column:
    return F.regexp_replace(name, "^mcp__.*?__", "")


def transcript_slug(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("-"))


def one_line(s: Column) -> Column:
    """A front-matter value on one line, without the quotes around it."""
    return F.regexp_replace(collapse(trim(s)), r"""^(["'])(.*)\1$""", "$2")


def refusal(kind: str, s: Column) -> Column:
    """Why a text of ``kind`` (content, summary, query) can't be taken, null if it can: it is missing, or over the kind's bytes."""
    most = MOST_BYTES[kind]
    return F.when(F.coalesce(s, F.lit("")) == "", f"{kind} is required").when(F.octet_length(s) > most, f"{kind} exceeds maximum size of {most // 1024}KB")


def refused_tags(tags_: Column) -> Column:
    """Why a list of tags can't be taken, null if it can: more than 20, or one over 100 bytes."""
    long = F.filter(tags_, lambda t: F.octet_length(t) > MOST_TAG_BYTES)
    return F.when(F.size(tags_) > MOST_TAGS, "too many tags").when(F.size(long) > 0, "a tag is too long")
