"""Token ids as binary files: a static range asymmetric numeral system (rANS).

Ids come from the tokenizers library.  One frequency table, counted over all
documents, is shared by all files.  A file holds consecutive documents in
ascending id order:

    magic "TRNS", version, table id, counts of documents, tokens and blocks,
    tokens before this file within its range,
    document ids (int64) and lengths (uint32),
    a checkpoint a block: tokens, lanes, bytes, CRC-32 of its tokens,
    the blocks, CRC-32 of everything before.

A block is independent: ``lanes`` 64-bit states are interleaved (token t belongs
to lane t mod lanes), so both directions are numpy steps over all lanes, and any
block can be decoded from its checkpoint alone, in parallel with the others.
Files are rows of a Parquet table in the shared folder: any file system Spark
reaches will do, and a lost executor's files are written again.

Edge cases: a null text is empty and holds the end id only; repeated ids are in
the order of a hash of their ids, then of these; null ids come first; a long
text is a document like any other; other columns, whatever their names, aren't
read; an empty table gives no files.
"""

from __future__ import annotations

import re
import struct
import zlib
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import drop_staged, slices, staged

SCALE = 20  #: the table's frequencies sum to 2**SCALE
LOW = 31  #: a state is at least 2**LOW between steps
BLOCK = 1 << 18
LANES = 1024
FILE_TOKENS = 1 << 20
CACHE_BYTES = 192 << 20  #: of the chunks that a worker remembers, with Python's own share
CACHED_CHARS = 64  #: longer chunks aren't remembered
RUN_WORDS = 128  #: words that the library's model gets in one call
GROUP_ROWS, GROUP_BYTES = 4096, 12 << 20  #: most texts, and bytes of texts before the last one, that are encoded at once
CHECKED = 256  #: one text of so many is compared with the library's ids
PROBES = (
    "The cat's sat, on It's mat. Don't!?;: x.y a.,b 12.5 3", "É école Straße ÿÀÖ. ÞþÐð Ñandú; naïve×÷ª e\u0301 \u0301x", "İSTANBUL ΣΑΣ. Σ 中文，字 привет, 😀👍🏽 \u200d\u0085\x0b\x1c\u00a0x",
    "a<|endoftext|>b <|startoftext|>. <|ENDOFTEXT|> < |x|>", "\t\r\n tabs\tand\nlines\r\n", "'S 'LL 'd'd ''s aaa'mbbb <b>&amp;</b> $%&*#@ __x__ CamelCaseWord " + "z" * 300,
    "so### É%%% x2&&& 'Tis$$$ it's*** a.## b#. c&amp; ÿ*!% 7&7# d<# Σ## <|endoftext|## e'## f#'s ǵ#",
)  #: texts on which the shortcut has to agree with the library before it is taken
MAGIC, VERSION = b"TRNS", 1
_HEAD = struct.Struct("<4sHIIQIQ")
_MARKS = ".,!?;:#%&$*"
_BLANKS = bytes(32 if c in b"\t\n\r" else c for c in range(256))
_ALNUM = "".join(chr(c) for c in (*range(48, 58), *range(65, 91), *range(97, 123)))
_LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_BEFORE_MARKS = frozenset(_ALNUM + _LATIN)
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_tokenizers: dict = {}


class ChunkTokenizer:
    """Whole texts to ids through the tokenizers library, each chunk of text once.

    The tokenizer drops white space and never joins what it parts, so the ids of
    a text are those of its chunks between ASCII blanks; and the ids of a chunk
    that ends in an ASCII letter or digit and a run of ``.,!?;:#%&$*`` are those of
    the two parts.  A chunk of Latin letters is one piece to the library's BPE model,
    which then gets it in lower case and in its byte alphabet, in runs of words where
    its tokens tell the end of a word.  A group of texts
    is one column of chunks, which Arrow encodes as a dictionary, so that Python sees
    each distinct chunk of a group once.  Chunks met before come from a cache of
    bounded bytes.  That holds for tokenizers that drop white
    space before they split and lower the case: where ``PROBES`` differ from the
    library's ids, whole texts go to the library instead (``plain``), and one text
    in ``CHECKED`` is compared with it as well, which raises where they differ.
    """

    def __init__(self, file: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(file)
        self.word = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.cache: dict[str, bytes] = {"": b""}
        self.held = 0
        from tokenizers.pre_tokenizers import ByteLevel

        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        small = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if c != 0xF7]
        self.letters = {ord(c): "".join(piece for piece, _ in alphabet.pre_tokenize_str(c)) for c in small}
        self.model = self.tok.model
        self.packed = {i: struct.pack("<H" if self.word == "<u2" else "<I", i) for i in self.tok.get_vocab().values()}
        self.marks, self.alnum, self.latin = (np.isin(np.arange(256), [*some]) for some in (_MARKS.encode(), _ALNUM.encode(), _LATIN.encode()[1::2]))  # by byte; Latin letters by their second one
        self.runs, self.last = self._runs()
        self.plain = False
        self.plain = not all(map(self.check, PROBES))

    def _runs(self):
        """The model on runs of words between blanks, and by id whether a token ends its word; nothing where the model doesn't mark ends."""
        import numpy as np
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        suffix = getattr(self.model, "end_of_word_suffix", None)
        if not suffix:
            return None, None
        runs = Tokenizer(self.model)
        runs.pre_tokenizer = CharDelimiterSplit(" ")
        last = np.zeros(max(self.packed) + 1, bool)
        last[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        return runs, last

    def _word(self, low: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(low if low.isascii() else low.translate(self.letters))])

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each word of small letters: the model gets many at once, and the ends of words part its ids."""
        if self.runs is None:
            return {w: self._word(w) for w in words}
        import numpy as np

        ascii_only = [w for w in words if w.isascii()]
        other = [w for w in words if not w.isascii()]
        runs = [" ".join(ascii_only[at : at + RUN_WORDS]) for at in range(0, len(ascii_only), RUN_WORDS)]
        runs += [" ".join(other[at : at + RUN_WORDS]).translate(self.letters) for at in range(0, len(other), RUN_WORDS)]
        found: list[int] = []
        for e in self.runs.encode_batch_fast(runs, add_special_tokens=False):
            found += e.ids
        ids = np.asarray(found, self.word)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words) or (len(ids) and ends[-1] != len(ids)):  # a letter that the model doesn't know
            return {w: self._word(w) for w in words}
        raw = ids.tobytes()
        return dict(zip(ascii_only + other, [raw[a:b] for a, b in pairwise([0, *(ends * ids.itemsize).tolist()])], strict=True))

    def _encode(self, chunks: list[str]) -> list[bytes]:
        import numpy as np

        return [np.asarray(e.ids, self.word).tobytes() for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def _fill(self, missing) -> None:
        cache = self.cache
        words: dict[str, None] = {}  # of letters, in lower case
        rest: dict[str, None] = {}
        cased: list[tuple[str, str]] = []
        later: list[tuple[str, str, str]] = []
        for c in missing:
            p = c.rstrip(_MARKS)
            if len(p) == len(c) or p[-1:] not in _BEFORE_MARKS:
                p = c
            else:
                later.append((c, p, tail := c[len(p) :]))
                if tail not in cache:
                    rest[tail] = None
                if p in cache:
                    continue
            if p.isalpha() if p.isascii() else _LETTERS.fullmatch(p):
                low = p.lower()
                if low not in cache:
                    words[low] = None
                if low != p:
                    cased.append((p, low))
            else:
                rest[p] = None
        cache.update(self._words(list(words)))
        cache.update(zip(rest, self._encode(list(rest)), strict=True))
        for p, low in cased:
            cache[p] = cache[low]
        for c, head, tail in later:
            cache[c] = cache[head] + cache[tail]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as bytes of ``self.word``."""
        if self.plain:
            return self._encode([t or "" for t in texts])
        import numpy as np

        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b" ".join([*raw, b""]).translate(_BLANKS), "u1")  # each text ends in a blank
        ends = np.flatnonzero(data == 32) + 1
        at = np.searchsorted(ends, np.cumsum([len(r) + 1 for r in raw]))  # each text's last chunk
        final, before, lead = (data.take(ends - k, mode="wrap") for k in (2, 3, 4))
        marked = self.marks[final] & (self.alnum[before] | (lead == 0xC3) & self.latin[before])
        data = np.insert(data, ends[marked] - 2, 32)  # one mark after a letter or digit is a chunk of its own
        ends, at = np.flatnonzero(data == 32) + 1, at + np.cumsum(marked)[at] if raw else at
        chunks = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate(([0], ends)).astype("i8")), pa.py_buffer(data)).dictionary_encode()
        distinct = chunks.dictionary  # its bytes, one after another: no chunk holds a blank but its last character
        words = distinct.buffers()[2].to_pybytes()[: np.frombuffer(distinct.buffers()[1], "<i8")[len(distinct)]].decode().split(" ")[:-1]
        cache = self.cache
        found = list(map(cache.get, words))
        if missing := [w for w, v in zip(words, found) if v is None]:
            had = len(cache)
            self._fill(missing)
            self.held += 200 * (len(cache) - had) + 2 * sum(map(len, missing))
            found = [cache[w] if v is None else v for w, v in zip(words, found)]
        ids = pa.array(found, pa.large_binary()).take(chunks.indices)
        cuts = [0, *np.frombuffer(ids.buffers()[1], "<i8")[at + 1].tolist()] if raw else [0]
        data = memoryview(ids.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in pairwise(cuts)]
        for w in missing:
            if len(w) > CACHED_CHARS:
                head = w.rstrip(_MARKS)
                for x in (w, w.lower(), head, head.lower(), w[len(head) :]):
                    if len(x) > CACHED_CHARS:
                        cache.pop(x, None)
        if self.held > CACHE_BYTES:  # what this group has is the likeliest in the next one, and chunks of few ids are the frequent ones
            kept = {w: v for w, v in zip(words, found) if len(w) <= CACHED_CHARS}
            short = {c: v for c, v in cache.items() if len(v) <= 4}
            for self.cache in (short | kept, kept, short, {}):
                self.held = sum(200 + 2 * len(c) for c in self.cache)
                if 2 * self.held < CACHE_BYTES:
                    break
            self.cache[""] = b""
        return out

    def check(self, text: str) -> bool:
        return self.encode([text]) == self._encode([text])


def tokenizer(file: str) -> ChunkTokenizer:
    """One per Python worker."""
    if file not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokenizers[file] = ChunkTokenizer(file)
    return _tokenizers[file]


class Table:
    """Shared frequencies: ``counts`` by id, scaled to sum to 2**SCALE, at least 1 for each id seen."""

    def __init__(self, counts):
        import numpy as np

        counts = np.asarray(counts, "f8")
        seen = counts > 0
        n = int(seen.sum())
        if not n or n > 1 << SCALE:
            raise ValueError("a table needs from 1 to 2**SCALE ids")
        free = (1 << SCALE) - n
        f = np.where(seen, 1 + np.floor(counts / counts.sum() * free), 0).astype("u8")
        f[int(np.argmax(counts))] += np.uint64((1 << SCALE) - int(f.sum()))
        self._set(f)

    def _set(self, f):
        import numpy as np

        self.freq, self.cum = f, np.concatenate(([0], np.cumsum(f)[:-1])).astype("u8")
        self.slot = np.repeat(np.arange(len(f), dtype="u2" if len(f) <= 1 << 16 else "u4"), f.astype("i8"))
        self.id = zlib.crc32(self.dump())

    def dump(self) -> bytes:
        return self.freq.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Table:
        import numpy as np

        self = cls.__new__(cls)
        self._set(np.frombuffer(data, "<u4").astype("u8"))
        return self


def encode_block(ids, table: Table) -> tuple[int, bytes]:
    """Lanes, and bytes: the lanes' final states, then the words to refill them with."""
    import numpy as np

    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    freq, cum = table.freq[ids], table.cum[ids]
    limit, rest = freq << np.uint64(LOW + 32 - SCALE), np.uint64(1 << SCALE) - freq
    x = np.full(lanes, 1 << LOW, "u8")
    words: list = [None] * steps
    for s in range(steps - 1, -1, -1):
        t = slice(s * lanes, min(n, (s + 1) * lanes))
        f = freq[t]
        y = x[: len(f)]
        over = np.flatnonzero(y >= limit[t])
        full = y[over]
        words[s] = full.astype("<u4")
        y[over] = full >> np.uint64(32)
        q = y // f  # the state is q * 2**SCALE + y % f + cum from here
        q *= rest[t]
        y += q
        y += cum[t]
    return lanes, x.astype("<u8").tobytes() + b"".join(w.tobytes() for w in words)


def decode_block(data, n: int, lanes: int, table: Table):
    """The block's ids (uint32)."""
    import numpy as np

    x = np.frombuffer(data, "<i8", lanes).copy()  # states are below 2**63
    words = np.frombuffer(data, "<u4", offset=8 * lanes).astype("i8")
    out, at = np.empty(n, "u4"), 0
    freq, cum = table.freq.view("i8"), table.cum.view("i8")
    for s in range(0, n, lanes):
        y = x[: min(lanes, n - s)]
        slot = y & ((1 << SCALE) - 1)
        ids = table.slot.take(slot)
        out[s : s + len(y)] = ids
        y >>= SCALE
        y *= freq.take(ids)
        y += slot
        y -= cum.take(ids)
        low = np.flatnonzero(y < (1 << LOW))
        if len(low):
            y[low] = (y[low] << 32) | words[at : at + len(low)]
            at += len(low)
    if at != len(words) or (x != 1 << LOW).any():
        raise ValueError("a block doesn't end where it should")
    return out


def write_file(doc_ids, docs: list, before: int, table: Table) -> bytes:
    """One file of documents' ids (arrays), ``before`` tokens into its range."""
    import numpy as np

    ids = np.concatenate(docs) if docs else np.empty(0, "u4")
    blocks, marks = [], []
    for at in range(0, len(ids), BLOCK):
        part = ids[at : at + BLOCK]
        lanes, data = encode_block(part, table)
        blocks.append(data)
        marks.append(struct.pack("<IIII", len(part), lanes, len(data), zlib.crc32(part.astype("<u4").tobytes())))
    head = _HEAD.pack(MAGIC, VERSION, table.id, len(docs), len(ids), len(blocks), before)
    body = b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), np.asarray([len(d) for d in docs], "<u4").tobytes(), *marks, *blocks])
    return body + struct.pack("<I", zlib.crc32(body))


def read_file(data: bytes, table: Table):
    """Document ids, lengths, all ids (uint32) and the tokens before; raises ``ValueError`` on any damage."""
    import numpy as np

    if len(data) < _HEAD.size + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("a file's checksum is wrong")
    magic, version, table_id, n_docs, n_tokens, n_blocks, before = _HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION or table_id != table.id:
        raise ValueError("another format or table")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u4", n_docs, at + 8 * n_docs)
    at += 12 * n_docs
    marks = np.frombuffer(data, "<u4", 4 * n_blocks, at).reshape(-1, 4)
    at += 16 * n_blocks
    parts = []
    for n, lanes, size, crc in marks.tolist():
        ids = decode_block(memoryview(data)[at : at + size], n, lanes, table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
        parts.append(ids)
        at += size
    ids = np.concatenate(parts) if parts else np.empty(0, "u4")
    if len(ids) != n_tokens or int(lengths.sum()) != n_tokens:
        raise ValueError("counts don't agree")
    return doc_ids, lengths, ids, before


def tokenize(docs: DataFrame, tokenizer_file: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``ids`` (binary, with the end id)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        tok = tokenizer(tokenizer_file)
        end = np.asarray([end_id], tok.word).tobytes()
        for b in batches:
            sizes, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False), dtype="i8"), 0
            while at < b.num_rows:
                before = sizes[at - 1] if at else 0
                n = min(GROUP_ROWS, 1 + int(np.searchsorted(sizes, before + GROUP_BYTES)) - at, b.num_rows - at)
                some = b.slice(at, n)
                texts = some.column(1).to_pylist()
                ids = tok.encode(texts)
                for k in {*range(CHECKED - 1, n, CHECKED), n - 1}:
                    if [ids[k]] != tok._encode([texts[k] or ""]):
                        raise RuntimeError("the ids of chunks differ from the library's")
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x + end for x in ids], pa.binary())], names=["doc_id", "ids"])
                at += n

    return rows.mapInArrow(run, "doc_id bigint, ids binary")


def count_table(ids: DataFrame, word: str) -> Table | None:
    """The shared table of all ids; the driver gets a row for each distinct id."""
    import numpy as np

    def run(batches):
        total = np.zeros(0, "i8")
        for b in slices(batches):
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), word), minlength=len(total))
            got[: len(total)] += total
            total = got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return None
    counts = np.zeros(max(r.id for r in rows) + 1)
    for r in rows:
        counts[r.id] = r.n
    return Table(counts)


def write(docs: DataFrame, tokenizer_file: str, end_id: int, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, bytes]:
    """Encode ``docs`` into files, and return them (``part, file, n_tokens, data``) and the table's bytes."""
    word = ChunkTokenizer(tokenizer_file).word
    ids = staged(tokenize(docs, tokenizer_file, end_id, text, doc_id), "token-ids")
    table = count_table(ids, word)
    dump = table.dump() if table else b""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = ids.withColumn("h", F.xxhash64("ids"))  # a narrow key: the bounds of ranges go through the driver
    ordered = hashed.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").drop("h")

    def run(batches):
        import numpy as np
        from pyspark import TaskContext

        part, table = TaskContext.get().partitionId(), None
        names, held, size, file, before = [], [], 0, 0, 0

        def flush():
            data = write_file(names, held, before, table)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "file", "n_tokens", "data"])

        for b in batches:
            table = table or Table.load(dump)
            for i, x in zip(b.column(0), b.column(1), strict=True):
                names.append(i.as_py() if i.is_valid else NULL_ID)
                held.append(np.frombuffer(x.as_buffer(), word))
                size += len(held[-1])
                if size >= FILE_TOKENS:
                    yield flush()
                    names, held, size, file, before = [], [], 0, file + 1, before + size
        if held:
            yield flush()

    files = staged(ordered.mapInArrow(run, "part int, file int, n_tokens bigint, data binary"), "rans-files")
    drop_staged(ids)
    return files, dump


#: Stands for a null document id inside a file.
NULL_ID = -(1 << 63)


def read_back(files: DataFrame, table: bytes) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files' bytes."""
    sizes = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a range
    bases, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        bases.append(total)
        total += sizes.get(p, 0)

    def run(batches):
        import numpy as np

        shared = None
        for b in batches:
            shared = shared or Table.load(table)
            for part, data in zip(b.column(0), b.column(1), strict=True):
                names, lengths, ids, before = read_file(data.as_py(), shared)
                ends = np.cumsum(lengths, dtype="i8")
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                start = ends - lengths + before + bases[part.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array(names, mask=names == NULL_ID), pa.array(start), pa.array(lengths.astype("i8")), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "data").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
