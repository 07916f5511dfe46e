"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text is split at *safe boundaries* first, so that one call never has to hold
the regular-expression state of a whole book: a boundary lies before a single
space that stands between two characters that are not white space.  No match of
the split pattern runs over such a place, and no match on either side looks past
it, so the ids of the parts, one after another, are the ids of the whole.

A part of ``LONGEST`` characters without a boundary is matched by the regex library
instead, a match at a time, so that no call's state grows with it; a property test
over Unicode holds that path to the ids of the whole.

Edge cases: a null text is an empty text (no ids, empty bytes); other columns
pass through untouched, and a clash with an output name is refused early; repeated
rows give equal rows; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters after which a part may end at the next safe boundary.
PART = 1 << 16
#: Parts without a safe boundary for so long are matched piece by piece.
LONGEST = 1 << 20
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_encodings: dict[tuple[str, str], object] = {}


def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file; one per Python worker."""
    import tiktoken

    key = (rank_file, pattern)
    if key not in _encodings:
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
        _encodings[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def safe_parts(text: str, part: int = PART) -> Iterator[str]:
    """``text`` in pieces of about ``part`` characters, cut at safe boundaries only."""
    at, n = 0, len(text)
    while n - at > part:
        found = _SAFE.search(text, at + max(1, part - 1))
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    if at < n:
        yield text[at:]


def encode(enc, pattern: str, text: str) -> list[int]:
    """Ids of a whole text, as ``enc.encode_ordinary(text)`` gives them."""
    ids: list[int] = []
    for piece in safe_parts(text):
        if len(piece) <= LONGEST:
            ids += enc.encode_ordinary(piece)
        else:  # a run of a million characters without a boundary: each match by itself
            import regex

            for m in regex.finditer(pattern, piece):
                ids += enc.encode_ordinary(m[0])
    return ids


def _clash(df: DataFrame, new: list[str]) -> None:
    lower = {c.lower() for c in df.columns}
    if both := [c for c in new if c.lower() in lower]:
        raise ValueError(f"the input already has {both}")


def _map(df: DataFrame, schema: pa.Schema, ddl: str, row) -> DataFrame:
    """One Arrow batch at a time; ``row`` makes the new columns' values of a text column."""

    def run(batches):
        for batch in batches:
            columns = row(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(v, f.type) for v, f in zip(columns, schema, strict=True)]], names=[*batch.schema.names, *schema.names])

    have = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{have}, {ddl}" if have else ddl)


def encode_column(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "token_ids", n: str = "n_tokens") -> DataFrame:
    """``df`` with the ids of ``text`` (array<int>) and their number."""
    _clash(df, [ids, n])

    def row(batch):
        enc = encoding(rank_file, pattern)
        out = [encode(enc, pattern, t or "") for t in batch.column(text).to_pylist()]
        return out, list(map(len, out))

    return _map(df, pa.schema([(ids, pa.list_(pa.int32())), (n, pa.int64())]), f"`{ids}` array<int>, `{n}` bigint", row)


def decode_column(df: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes (binary) that ``ids`` stand for; null ids: no bytes."""
    _clash(df, [to])

    def row(batch):
        enc = encoding(rank_file, pattern)
        return ([enc.decode_bytes(x or []) for x in batch.column(ids).to_pylist()],)

    return _map(df, pa.schema([(to, pa.binary())]), f"`{to}` binary", row)


def round_trip(df: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode its ids in one pass over the text.

    Returns the columns of ``keep`` and ``n_tokens``, ``ids_sha256`` (of the ids
    as little-endian unsigned 32-bit integers), ``decoded_sha256`` and, if asked
    for, ``token_ids`` (array<int>).
    """
    import numpy as np

    keep = [c for c in df.columns if c != text] if keep is None else keep
    new = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("token_ids", pa.list_(pa.int32()))] if with_ids else [])])
    _clash(df.select(*keep), new.names)

    def run(batches):
        enc = encoding(rank_file, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: tuple = tuple([] for _ in new)
                for t in batch.column(batch.num_columns - 1):
                    ids = encode(enc, pattern, t.as_py() or "")
                    raw = np.asarray(ids, "<u4")
                    row = (len(ids), hashlib.sha256(raw.tobytes()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest(), raw.astype("i4"))
                    for values, value in zip(out, row, strict=False):
                        values.append(value)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(v, f.type) for v, f in zip(out, new, strict=True)]], names=[*keep, *new.names])

    narrow = df.select(*keep, df[text].alias("__text"))
    have = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(run, ", ".join([*have, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", *(["token_ids array<int>"] if with_ids else [])]))
