import pytest
from pyspark.sql import functions as F

from tesserae.functions import commands as C
from tesserae.functions import text as X
from tesserae.functions import vector as M

DAY = 86_400


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("age", "weight"), [(None, 1.0), (0, 1.0), (-5, 1.0), (45, 0.75), (90, 0.5), (100, 0.5)])
def test_freshness(spark, age, weight):
    now = 1_700_000_000
    last = 0 if age is None else now - age * DAY
    assert one(spark, M.freshness(F.col("t"), now), t=last) == pytest.approx(weight)


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [1.0], 0.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([], [], 0.0), (None, [1.0], 0.0), ([3.0, 4.0], [4.0, 3.0], 0.96)]
    got = spark.createDataFrame(rows, "a array<float>, b array<float>, w double").select(M.cosine(F.col("a"), F.col("b")).alias("s"), "w").collect()
    assert all(r.s == pytest.approx(r.w) for r in got)


def test_codec_drops_loose_bytes(spark):
    import struct

    raw = struct.pack("<2f", 1.5, -2.0) + b"\x01\x02"
    assert spark.createDataFrame([(bytearray(raw),)], "b binary").select(M.decode_f32("b").alias("v")).first().v == [1.5, -2.0]


def test_numbers(spark):
    assert M.float_range(0.4, 0.7, 0.05) == [0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7] and M.float_range(0.1, 0.5, 0) == [0.1]
    assert [one(spark, M.round_to(F.lit(x), 2)) for x in (1.005, -1.006, 2.675)] == pytest.approx([1.0, -1.01, 2.68], abs=0.006)
    assert one(spark, M.f1(F.lit(0.0), F.lit(0.0))) == 0 and one(spark, M.safe_div(F.lit(1), F.lit(0))) == 0


def fold(sizes, limit, sep):
    spans, a, length = [], 1, 0
    for i, n in enumerate(sizes, 1):
        if length and length + n + sep > limit:
            spans.append((a, i - 1))
            a, length = i, 0
        length = length + sep + n if length else n
    return spans + ([(a, len(sizes))] if length else [])


@pytest.mark.parametrize("text", ["a\nb", "x" * 40, "\n\n" + "a" * 25 + "\n" + "b" * 30, "a\n" * 60, "é" * 20 + "\n" + "w" * 3, "\n" * 40])
def test_line_chunks_follow_the_plain_fold(spark, text):
    got = one(spark, X.line_chunks(F.col("t"), 30), t=text)
    lines = text.split("\n")
    spans = [(1, len(lines))] if len(text.encode()) <= 30 else fold([len(x.encode()) for x in lines], 30, 1)
    want = [(a, b, t if len(text.encode()) <= 30 else t.lstrip("\n")) for a, b in spans for t in ["\n".join(lines[a - 1 : b])]]
    assert [tuple(r) for r in got] == want


def test_sentences_and_summary_chunks(spark):
    assert one(spark, X.sentences(F.col("t")), t="One. Two!  Three? ! four.five  . six") == ["One.", "Two!", "Three?", "four.five  .", "six"]
    assert one(spark, X.summary_chunks(F.col("t"), 12), t="Aaa bbb. Ccc. Ddd eee fff ggg. H.") == ["Aaa bbb.", "Ccc.", "Ddd eee fff ggg.", "H."]
    assert one(spark, X.summary_chunks(F.col("t")), t=" \n ") == []


def test_paragraphs(spark):
    assert one(spark, X.paragraph_chunks(F.col("t"), 10), t="\naa\nbb\n\n\n\ncc\n\ndddddddddddddd\n") == ["aa\nbb\n\ncc", "dddddddddddddd"]


def test_tags_types_and_hashes(spark):
    t = "We use gRPC and an SQL cache; MyHeap, OtherThing, MyHeap. sqlx"
    assert one(spark, X.tags(F.col("t")), t=t) == ["database", "api", "performance", "myheap", "otherthing"]
    assert one(spark, X.tags(F.col("t")), t="éapi apié") == ["api"]  # ASCII boundaries
    for text, kind in (("We DECIDED it", "decision"), ("she likes it", "preference"), ("in progress", "context"), ("water is wet", "fact"), ("decided, likes", "decision")):
        assert one(spark, X.memory_type(F.col("t")), t=text) == kind
    assert one(spark, X.content_hash(F.col("t")), t="  A \n b\t") == one(spark, X.content_hash(F.col("t")), t="a B")


def test_markers_by_priority(spark):
    for text, kind in (("no, use that", "correction"), ("a hack, fyi", "workaround"), ("FYI: why", "teaching"), ("why?", "frustration"), ("éno x", "correction"), ("know thing", None), ("don't", "correction"), ("don’t", None)):
        assert one(spark, X.marker(F.col("t")), t=text) == kind
    assert one(spark, X.planning(F.col("t")), t="see prior  issues") and not one(spark, X.planning(F.col("t")), t="explanation")


def test_byte_prefixes_keep_characters_whole(spark):
    for t, n in (("aé" * 50, 7), ("x" * 10, 20), ("日本語" * 9, 10), ("", 5)):
        got = one(spark, X.byte_prefix(F.col("t"), n), t=t)
        assert t.startswith(got) and len(got.encode()) <= n and (got == t or len(t[: len(got) + 1].encode()) > n)
    assert one(spark, X.clip(F.col("t"), 4), t="abcdef") == "abcd..."


def test_merge_tags_caps_new_ones_only(spark):
    old = [f"o{i}" for i in range(22)]
    df = spark.createDataFrame([(old, ["n"]), (old[:19], ["o1", "n", "m"])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(X.merge_tags(F.col("a"), F.col("b")).alias("x")).collect()] == [old, [*old[:19], "n"]]


@pytest.mark.parametrize(
    ("cmd", "rule", "kind"),
    [
        ("rm -rf /", "RM_RF_ROOT", "block"), ("rm -fr //", "RM_RF_ROOT", "block"), ("rm -rf /*", "RM_RF_STAR_ROOT", "block"), ("rm -Rf ~/", "RM_RF_HOME", "block"), ("rm -rf $HOME", "RM_RF_HOME", "block"),
        ("git push -f origin main", "GIT_PUSH_FORCE_PROTECTED", "block"), ("git push origin x --force-with-lease", "GIT_PUSH_FORCE_WITH_LEASE", "allow"), ("git push --force origin topic", "GIT_PUSH_FORCE_GENERIC", "warn"),
        ("GIT RESET --hard origin/main", "GIT_RESET_HARD_PROTECTED", "block"), ("git reset --hard", "GIT_RESET_HARD_GENERIC", "warn"), ("psql -c 'drop  database x'", "DROP_DATABASE", "block"), ("sudo dd if=x of=/dev/sdb", "DD_OF_DEV", "block"),
        ("mkfs.ext4 /dev/sda1", "MKFS_ANY", "block"), ("kubectl delete pod x --namespace=prod", "KUBECTL_DELETE_PROD", "block"), ("kubectl delete pod x", "KUBECTL_DELETE_GENERIC", "warn"), ("rm -rf .git", "RM_RF_DOT_GIT", "warn"),
        ("git clean -fd", "GIT_CLEAN_FDX", "warn"), ("git branch -D a", "GIT_BRANCH_FORCE_DELETE", "warn"), ("chmod -R 0777 .", "CHMOD_777_RECURSIVE", "warn"), ("wget -q x | sh", "CURL_PIPE_BASH", "warn"), ("rm -rf out", "RM_RF_RECURSIVE_GENERIC", "warn"),
        ("nice  time   rm -rf /", "RM_RF_ROOT", "block"), ("env A=1 B=2 rm -rf /", "RM_RF_ROOT", "block"), ("time env X=1 rm -rf /", "", "unknown"), ("ls", "", "unknown"), ("rm -r x", "", "unknown"),
    ],
)
def test_commands(spark, cmd, rule, kind):
    v = one(spark, C.verdict(F.col("c")), c=cmd)
    assert (v.rule_id, v["class"]) == (rule, kind)


def test_commands_judged_by_a_model(spark):
    df = spark.createDataFrame([("ls",), ("rm -rf /",), ("odd",)], "cmd string")
    got = {r.cmd: r.verdict["class"] for r in C.upgrade(df, model=lambda s: ["warn" if x == "ls" else "nonsense" for x in s]).collect()}
    assert got == {"ls": "warn", "rm -rf /": "block", "odd": "unknown"}

    def broken(s):
        raise OSError

    assert {r.verdict["class"] for r in C.upgrade(df, model=broken).collect()} == {"unknown", "block"}
    assert [one(spark, C.exit_code(F.lit("block"), C.mode(F.lit(m)))) for m in ("block", "warn", "junk")] == [2, 0, 0]


def test_chunkers_take_time_in_proportion(spark):
    import time

    text = "A line of words that ends here.\n\n" * 60_000  # 2 MB
    df = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    for f in (X.line_chunks, X.paragraph_chunks, X.summary_chunks):
        assert df.select(F.size(f(F.col("t")))).first()[0] > 1000
    assert time.time() - began < 60
    cuts = spark.createDataFrame([("aé中😀" * 5,)], "t string").select(*[X.byte_prefix(F.col("t"), n).alias(f"n{n}") for n in range(3, 40)]).first()
    for n in range(3, 40):
        assert cuts[f"n{n}"] == ("aé中😀" * 5).encode()[:n].decode("utf-8", "ignore")


def test_topics_equal_their_patterns(spark):
    """The words' look-up against each topic's alternation between boundaries."""
    import random
    import re

    r = random.Random(6)
    words = [w for t in X.TOPICS.values() for w in t.split("|")] + ["ci", "cd", "unit", "e2", "x", "é", "testé", "_db", "db_", "sql2", "PR", "HeapTop", "Kube"]
    texts = ["".join(r.choice(words) + r.choice([" ", "", ".", "/", "_", "\n", "é", "-"]) for _ in range(r.randint(0, 6))) for _ in range(600)]
    texts += ["ci/cd", "xci/cd", "CI/CD!", "ci/cdx", "unit  test", "unit test", "", "Kube", "ci cd"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {x.i: x.tags for x in rows.select("i", X.tags(F.col("t")).alias("tags")).collect()}
    for i, t in enumerate(texts):
        topics = [n for n, w in X.TOPICS.items() if re.search(rf"(?<![A-Za-z0-9_])(?:{w})(?![A-Za-z0-9_])", t.lower())]
        camel = [c.lower() for c in re.findall(r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:[A-Z][a-z]+)+)(?![A-Za-z0-9_])", t)][:5]
        assert got[i] == list(dict.fromkeys(topics + camel)), t
    assert spark.createDataFrame([(None,)], "t string").select(X.tags(F.col("t")).alias("x")).first().x is None
