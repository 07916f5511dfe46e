"""AVI motion-JPEG media columns: write, parse, decode, cut into shots.

Writing.  A payload is stored losslessly in the format's own unit, the quantised
DCT coefficient of baseline JPEG: 64 bytes are the 64 zigzag coefficients of one
8x8 block.  Magnitude category 8 holds exactly 256 values, and its 8 extra bits
are the byte; with the category's Huffman code one bit long, every coefficient
takes 9 bits and every block 72 whole bytes, so neither side needs a bit loop.
A restart marker after each block resets the DC prediction.  Frames are 8 blocks
wide; an AVI 1.0 file has ``hdrl``, an ``INFO`` comment with the payload's
length, ``movi`` with one ``00dc`` chunk a frame, and ``idx1``.

Reading.  The RIFF tree and ``idx1`` are parsed, each frame's scan is decoded to
coefficients and, by the inverse DCT, to pixels.  A shot begins where the
difference of neighbouring frames' grey histograms is above the mean and
``SPREAD`` standard deviations of the last ``WINDOW`` differences and above
``FLOOR``.  Clips are timed by the header's microseconds a frame.

Edge cases: a null or empty payload is one block of zeros, one frame; a file
that is cut short, has no index or has frames that are not intra-coded by this
profile raises ``ValueError`` in :func:`parse`/:func:`decode_frame`, and the
column function gives such a row null results; a long payload is more frames;
repeated rows give equal rows; other columns, whatever their names, aren't read by
:func:`media_digest`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 64
WIDE = 8  #: blocks in a row of a frame
HIGH = 8  #: most rows of blocks in a frame
US_PER_FRAME = 40_000
BINS = 32
WINDOW, SPREAD, FLOOR = 12, 3.0, 0.25


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % UNIT if payload else UNIT)


@cache
def _frame_header(rows: int) -> bytes:
    seg = lambda marker, body: b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body
    one_code = bytes([1, *[0] * 15, 8])  # a single code of one bit, for category 8 after no zeros
    return b"".join([
        b"\xff\xd8",
        seg(0xE0, b"AVI1" + bytes(10)),
        seg(0xDB, b"\0" + b"\1" * 64),
        seg(0xC0, struct.pack(">BHHB", 8, 8 * rows, 8 * WIDE, 1) + b"\1\x11\0"),
        seg(0xC4, b"\x00" + one_code),
        seg(0xC4, b"\x10" + one_code),
        seg(0xDD, struct.pack(">H", 1)),
        seg(0xDA, b"\1\1\0\0\x3f\0"),
    ])


def _scans(payload: bytes) -> list[bytes]:
    """The entropy-coded bytes of each block, before markers."""
    import numpy as np

    bits = np.zeros((len(payload), 9), "u1")
    bits[:, 1:] = np.unpackbits(np.frombuffer(payload, "u1")).reshape(-1, 8)
    packed = np.packbits(bits).tobytes()
    if b"\xff" in packed:
        return [packed[i : i + 72].replace(b"\xff", b"\xff\0") for i in range(0, len(packed), 72)]
    return [packed[i : i + 72] for i in range(0, len(packed), 72)]


_RST = [bytes([0xFF, 0xD0 + i]) for i in range(8)]


def write(payload: bytes) -> bytes:
    """An AVI file that holds ``payload`` (a positive multiple of 64 bytes)."""
    if not payload or len(payload) % UNIT:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    blocks = len(payload) // UNIT
    rows = min(HIGH, -(-blocks // WIDE))
    per = rows * WIDE
    scans = _scans(payload + bytes(-blocks % per * UNIT))
    head, frames = _frame_header(rows), []
    for at in range(0, len(scans), per):
        parts = [head]
        for i, s in enumerate(scans[at : at + per]):
            if i:
                parts.append(_RST[(i - 1) % 8])
            parts.append(s)
        frames.append(b"".join([*parts, b"\xff\xd9"]))
    return _avi(frames, 8 * WIDE, 8 * rows, str(len(payload)).encode())


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _avi(frames: list[bytes], width: int, height: int, comment: bytes) -> bytes:
    largest = max(map(len, frames))
    avih = struct.pack("<14I", US_PER_FRAME, largest * 1_000_000 // US_PER_FRAME, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, US_PER_FRAME, 1_000_000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(c := _chunk(b"00dc", f))
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def parse(data: bytes) -> dict:
    """The header fields, the comment and the frames that ``idx1`` lists."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI " or len(data) < 8 + struct.unpack_from("<I", data, 4)[0]:
        raise ValueError("not a whole RIFF AVI file")
    out: dict = {"frames": [], "comment": b""}
    movi = index = None
    stack = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, n = struct.unpack_from("<4sI", data, at)
            body = at + 8
            if body + n > end:
                raise ValueError("a chunk runs over its list")
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                else:
                    stack.append((body + 4, body + n))
            elif name == b"avih":
                out["us_per_frame"], out["n_frames"], out["width"], out["height"] = (struct.unpack_from("<I", data, body + k)[0] for k in (0, 16, 32, 36))
            elif name == b"ICMT":
                out["comment"] = data[body : body + n]
            elif name == b"idx1":
                index = (body, n)
            at = body + n + (n & 1)
    if movi is None or index is None or "width" not in out:
        raise ValueError("no header, movi list or index")
    for k in range(index[0], index[0] + index[1] - 15, 16):
        name, _, offset, n = struct.unpack_from("<4sIII", data, k)
        if name == b"00dc":
            place = movi + offset
            if data[place : place + 4] != b"00dc" or struct.unpack_from("<I", data, place + 4)[0] != n:
                raise ValueError("the index points to no frame")
            out["frames"].append(data[place + 8 : place + 8 + n])
    return out


_MARK = re.compile(rb"\xff[\xd0-\xd7]")


def decode_frame(jpeg: bytes) -> bytes:
    """The coefficient bytes of a frame, block after block."""
    import numpy as np

    if jpeg[:2] != b"\xff\xd8" or jpeg[-2:] != b"\xff\xd9":
        raise ValueError("not a whole JPEG frame")
    at, rows, wide = 2, 0, 0
    while jpeg[at + 1] != 0xDA:
        if jpeg[at + 1] == 0xC0:
            _, height, width, _ = struct.unpack_from(">BHHB", jpeg, at + 4)
            rows, wide = height // 8, width // 8
        elif 0xC1 <= jpeg[at + 1] <= 0xCF and jpeg[at + 1] not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    scan = _MARK.sub(b"", jpeg[at:-2]).replace(b"\xff\0", b"\xff")
    if not rows or len(scan) != 72 * rows * wide:
        raise ValueError("the scan does not have the frame's blocks")
    bits = np.unpackbits(np.frombuffer(scan, "u1")).reshape(-1, 9)
    if bits[:, 0].any():
        raise ValueError("a code outside this profile")
    return np.packbits(bits[:, 1:]).tobytes()


@cache
def _inverse():
    """Maps zigzag coefficients to an 8x8 block's pixels: a 64x64 matrix."""
    import numpy as np

    order = sorted(range(64), key=lambda i: ((i // 8 + i % 8), (i // 8) if (i // 8 + i % 8) % 2 else (i % 8)))
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16)
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.ascontiguousarray(full[order].astype("f4"))


def pixels(coefficients: bytes):
    """Blocks of grey pixels (n, 64), from the bytes that stand for category-8 coefficients."""
    import numpy as np

    b = np.frombuffer(coefficients, "u1").reshape(-1, 64).astype("f4")
    return np.clip(np.rint(np.where(b >= 128, b, b - 255) @ _inverse()) + 128, 0, 255).astype("u1")


def histograms(blocks, per: int):
    """Grey histograms, shares of ``BINS`` bins, of frames of ``per`` blocks."""
    import numpy as np

    n = len(blocks) // per
    binned = (blocks >> 3).reshape(n, -1).astype("int32") + (np.arange(n, dtype="int32") * BINS)[:, None]
    return np.bincount(binned.ravel(), minlength=n * BINS).reshape(n, BINS) / binned.shape[1]


def shots(h) -> list[int]:
    """First frames of the shots: an adaptive threshold on histogram differences."""
    import numpy as np

    d = np.abs(np.diff(h, axis=0)).sum(axis=1) / 2
    starts = [0]
    for i, x in enumerate(d):
        past = d[max(0, i - WINDOW) : i]
        if x > max(FLOOR, past.mean() + SPREAD * past.std() if len(past) else FLOOR):
            starts.append(i + 1)
    return starts


def clips(data: bytes) -> tuple[bytes, list[tuple[int, int, int, int]]]:
    """Payload and clips ``(first frame, frames, start ms, end ms)`` of a file by :func:`write`."""
    avi = parse(data)
    raw = b"".join(map(decode_frame, avi["frames"]))
    per = avi["width"] * avi["height"] // 64
    starts = shots(histograms(pixels(raw), per))
    ends = [*starts[1:], len(avi["frames"])]
    ms = avi["us_per_frame"] // 1000
    return raw[: int(avi["comment"] or len(raw))], [(a, b - a, a * ms, b * ms) for a, b in zip(starts, ends, strict=True)]


_DIGEST = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_digest(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Store each text's UTF-8 bytes as AVI, read the file back, and return its digest and clips.

    ``feature`` lists frames, and ``start-end`` in milliseconds of each clip.
    """
    keep = ["doc_id"] if keep is None else keep
    narrow = df.select(*keep, df[text].alias("__text"))
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(t: str | None) -> tuple:
        body = (t or "").encode("utf-8", "surrogatepass")
        media = write(padded(body))
        back, found = clips(media)
        last = found[-1]
        feature = f"frames={last[0] + last[1]};clips=" + ",".join(f"{a}-{b}" for _, _, a, b in found)
        return len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches):
        for b in batches:
            rows = [one(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(types)]], names=[*keep, *names])

    have = [f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep]
    return narrow.mapInArrow(run, ", ".join([*have, _DIGEST]))


def write_column(df: DataFrame, payload: str, media: str = "media") -> DataFrame:
    """``df`` with an AVI file (binary) of each padded ``payload`` (binary; null: empty)."""
    return _with(df, payload, [(media, pa.binary(), "binary")], lambda x: (write(padded(x or b"")),))


def clip_rows(df: DataFrame, media: str) -> DataFrame:
    """One row per clip: the columns of ``df`` but ``media``, and its place and times.

    A media value that can't be read gives one row with null clip columns.
    """
    from pyspark.sql import functions as F

    clip = pa.list_(pa.struct([("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64())]))

    def one(x):
        try:
            return ([dict(zip(("first_frame", "n_frames", "start_ms", "end_ms"), c, strict=True)) for c in clips(x)[1]],)
        except (ValueError, IndexError, TypeError, struct.error):
            return (None,)

    out = _with(df, media, [("__clips", clip, "array<struct<first_frame:int,n_frames:int,start_ms:bigint,end_ms:bigint>>")], one)
    return out.drop(media).select("*", F.explode_outer("__clips").alias("__clip")).select(*[c for c in df.columns if c != media], "__clip.*")


def _with(df: DataFrame, column: str, new: list, one) -> DataFrame:
    if both := {n for n, _, _ in new} & set(df.columns):
        raise ValueError(f"the input already has {sorted(both)}")

    def run(batches):
        for b in batches:
            rows = [one(x.as_py()) for x in b.column(b.schema.get_field_index(column))]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[i] for r in rows], k) for i, (_, k, _) in enumerate(new)]], names=[*b.schema.names, *[n for n, _, _ in new]])

    have = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return df.mapInArrow(run, ", ".join([*have, *[f"`{n}` {t}" for n, _, t in new]]))
