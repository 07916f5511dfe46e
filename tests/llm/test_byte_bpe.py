import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import byte_bpe

FILE = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return byte_bpe.encoding(FILE, P.PATTERN)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \n\t'sab1.é中"), st.characters(exclude_categories=["Cs"])), max_size=60), st.integers(1, 9))
def test_safe_parts_keep_the_ids(text, part):
    enc = byte_bpe.encoding(FILE, P.PATTERN)
    pieces = list(byte_bpe.safe_parts(text, part))
    assert "".join(pieces) == text
    assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", "a" * 3000, " " * 3000 + "x", "ab 12 " * 2000, "\n\n x" * 900, "<|endoftext|>"])
def test_runs_without_boundaries(enc, monkeypatch, text):
    want = enc.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "LONGEST", 100)
    assert byte_bpe.encode(enc, P.PATTERN, text) == want and enc.decode_bytes(want) == text.encode()


def test_columns(spark, enc):
    rows = [(1, None, 0), (2, "", 0), (3, "Hello  wörld's 12", 0), (3, "Hello  wörld's 12", 0), (None, "word " * 40000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra int")
    got = sorted(map(tuple, byte_bpe.round_trip(docs, FILE, P.PATTERN, with_ids=True).collect()), key=str)
    want = []
    for i, t, x in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, x, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(want, key=str)
    both = byte_bpe.decode_column(byte_bpe.encode_column(docs, FILE, P.PATTERN), FILE, P.PATTERN).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.token_ids) for r in both)
    with pytest.raises(ValueError):
        byte_bpe.encode_column(docs.withColumn("n_tokens", docs.extra), FILE, P.PATTERN)
    assert byte_bpe.round_trip(docs.limit(0), FILE, P.PATTERN).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["  ", " ", "\n", "\r\n", "\t", "'s", "'LL", "a", "Bc", "12", "3456", "!?", "é", "中", "e\u0301", "\u2003", "\u0085", "\u200d", "<|endoftext|>"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_matches_one_by_one_give_the_ids_of_the_whole(text):
    """The path of parts without a boundary, at any length and over all of Unicode."""
    enc = byte_bpe.encoding(FILE, P.PATTERN)
    longest, byte_bpe.LONGEST = byte_bpe.LONGEST, 0
    try:
        assert byte_bpe.encode(enc, P.PATTERN, text) == enc.encode_ordinary(text)
    finally:
        byte_bpe.LONGEST = longest


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (2, None)], "doc_id bigint, text string")
    got = byte_bpe.round_trip(docs, FILE, P.PATTERN).collect()
    assert len(got) == 3 and len({tuple(r) for r in got}) == 2
    assert byte_bpe.round_trip(docs.limit(0), FILE, P.PATTERN).count() == 0
