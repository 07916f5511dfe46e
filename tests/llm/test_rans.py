import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import rans

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    """The tokenizer as the library loads it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def same(tok, library, text):
    return np.frombuffer(tok.encode([text])[0], tok.word).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tok():
    return rans.ChunkTokenizer(FILE)


@pytest.mark.parametrize("text", ["", " \n\t", "it's, Don't.'s !. a.'s", "\x0b\x1c x\u0085y ́e", "ÉCOLE Straße, ÿÀÖ. ÞþÐð Ñandú; naïve×÷ª İSTANBUL ΣΑΣ. 中文，字 12.5!?;'", "<|endoftext|> ...", "Hi<|endoftext|>there <|startoftext|>. <|EndOfText|>!", "a" * 5000])
def test_chunks_give_the_ids_of_the_whole(tok, library, text):
    assert same(tok, library, text) and not tok.plain


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*" \n.,'!?sSaZ09éÉßÿÞ×÷ñ́ΣIi", "<|endoftext|>"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_any_text(tok, library, text):
    assert same(tok, library, text)


def test_small_cache(monkeypatch, library):
    monkeypatch.setattr(rans, "CACHE_BYTES", 4000)
    t = rans.ChunkTokenizer(FILE)
    for r in range(4):
        texts = [" ".join(f"word{i % 17}x{j + r}" for j in range(9)) + " " + "ab1" * 50 for i in range(20)]
        assert all(np.frombuffer(x, t.word).tolist() == library.encode(y, add_special_tokens=False).ids for x, y in zip(t.encode(texts), texts))
        assert max(map(len, t.cache)) <= rans.CACHED_CHARS


def test_another_tokenizer_goes_whole_to_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"Ab c": 1, "Ab": 2, "c": 3, "?": 0}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
    other.save(str(tmp_path / "t.json"))
    t = rans.ChunkTokenizer(str(tmp_path / "t.json"))
    assert t.plain and np.frombuffer(t.encode(["Ab c\nAb"])[0], t.word).tolist() == [1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=400), max_size=6))
def test_file_round_trip(docs):
    every = [x for d in docs for x in d] or [0]
    table = rans.Table(np.bincount(every))
    assert rans.Table.load(table.dump()).id == table.id and int(table.freq.sum()) == 1 << rans.SCALE
    data = rans.write_file(range(len(docs)), [np.array(d, "u2") for d in docs], 7, table)
    ids, lengths, back, before = rans.read_file(data, table)
    assert ids.tolist() == list(range(len(docs))) and lengths.tolist() == list(map(len, docs)) and before == 7
    assert back.tolist() == [x for d in docs for x in d]


def test_damage_is_seen():
    table = rans.Table([5, 1, 9])
    data = bytearray(rans.write_file([1], [np.array([0, 1, 2, 2, 2, 0] * 50, "u2")], 0, table))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.read_file(bytes(data), table)


def test_table_of_documents(spark, tok, library, monkeypatch):
    monkeypatch.setattr(rans, "FILE_TOKENS", 40)
    rows = [(7, "The cat sat, on it's mat."), (3, None), (5, ""), (4, "long " * 300), (None, "x"), (7, "again!"), (8, "to the end<|endoftext|>")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, ids string")
    files, table = rans.write(docs, FILE, 1)
    got = [tuple(r) for r in rans.read_back(files, table).orderBy("start").collect()]
    word = tok.word
    want, at = [], 0
    for i, raw in sorted(((i, x + np.array([1], word).tobytes()) for (i, t) in rows for x in [np.asarray(library.encode(t or "", add_special_tokens=False).ids, word).tobytes()]), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = np.frombuffer(raw, word).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(str, [g[:1] + g[2:] for g in got])) == sorted(map(str, [w[:1] + w[2:] for w in want]))  # one id's two documents in either order
    assert [g for g in got if g[0] != 7] == [w for w in want if w[0] != 7]
    none = docs.limit(0)
    assert rans.read_back(*rans.write(none, FILE, 1)).count() == 0


def test_groups_meet_distinct_chunks_once(spark, library, monkeypatch):
    """Texts of a group that share chunks, begin or end in blanks or are null; groups by rows and by bytes."""
    t = rans.ChunkTokenizer(FILE)
    asked, fill = [], t._fill
    t._fill = lambda missing: (asked.extend(missing), fill(missing))
    texts = ["same words### here%%%", None, " \n", "same  words### \té here%%%\r", "", "x&&& $$$ É*** same"] * 40
    got = [np.frombuffer(x, t.word).tolist() for x in t.encode(texts)]
    assert got == [library.encode(x or "", add_special_tokens=False).ids for x in texts] and sorted(asked) == sorted({"same", "words###", "here%%%", "x&&&", "É***"})  # the probes had the rest
    assert t.encode([]) == []
    sent, encode = [], t._encode
    t._encode = lambda chunks: (sent.extend(chunks), encode(chunks))[1]
    t.encode([f"Tail{c}###" for c in "abcdefghij"] + ["Tail***", "tail&%$"])  # letters go to the model, tails to the library once
    assert not any(x.lower().startswith("tail") for x in sent)
    monkeypatch.setattr(rans, "GROUP_ROWS", 7)
    monkeypatch.setattr(rans, "GROUP_BYTES", 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = {r.doc_id: np.frombuffer(r.ids, t.word).tolist() for r in rans.tokenize(docs, FILE, 1).collect()}
    assert made == {i: [*x, 1] for i, x in enumerate(got)}


def test_a_mark_behind_a_word_is_no_new_word(library):
    """A single mark is a chunk of its own; words of letters go to the model in runs, the ids are the library's."""
    t = rans.ChunkTokenizer(FILE)
    asked, alone, fill, word = [], [], t._fill, t._word
    t._fill = lambda missing: (asked.extend(missing), fill(missing))
    t._word = lambda low: (alone.append(low), word(low))[1]
    texts = ["zyxab, Zyxab. zyxab; ñandúx: zyxab", None, ",", "é.", ",a", "", "×. ÷, ÿ;\tÞ!", "ñandúx? 7% x7% zyxab!? 文. ́a.", "a,\n"]
    assert [np.frombuffer(x, t.word).tolist() for x in t.encode(texts)] == [library.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert {"zyxab", "Zyxab", "ñandúx"} < set(asked) and not {"zyxab,", "Zyxab.", "ñandúx:", "x7%"} & set(asked) and not alone
    t = rans.ChunkTokenizer(FILE)
    t.runs = None  # as for a model that doesn't mark where a word ends
    assert [np.frombuffer(x, t.word).tolist() for x in t.encode(texts)] == [library.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_a_full_cache_keeps_the_words_of_the_last_group(monkeypatch):
    monkeypatch.setattr(rans, "CACHE_BYTES", 100_000)
    t = rans.ChunkTokenizer(FILE)
    asked, fill = [], t._fill
    t._fill = lambda missing: (asked.extend(missing), fill(missing))
    letters = "qzxkjvwbpg"
    first, group = (["".join(letters[int(c)] for c in str(i * 7919 + 10**8)) for i in some] for some in (range(300), range(300, 500)))
    t.encode([" ".join(first)])
    ids = t.encode([" ".join(group)])  # more than the cache may hold
    assert t.held < 100_000 and len(t.cache) < 300 and len(asked) == 500
    assert t.encode([" ".join(group)]) == ids and len(asked) == 500
