import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import mjpeg


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=9000))
def test_round_trip(body):
    payload = mjpeg.padded(body)
    assert len(payload) % 64 == 0 and payload and payload.startswith(body)
    assert mjpeg.clips(mjpeg.write(payload))[0] == payload


def test_stuffing_and_markers():
    for body in (b"\xff" * 640, bytes(range(256)) * 40, b"\x7f\xff\xd0" * 700):
        assert mjpeg.clips(mjpeg.write(mjpeg.padded(body)))[0] == mjpeg.padded(body)


def slow_coefficients(jpeg):
    """Bit by bit, as baseline JPEG says: a code, then its extra bits; DC from zero after each restart."""
    scan = jpeg[jpeg.index(b"\xff\xda") + 10 : -2]
    out, bits, i = [], [], 0
    while i < len(scan):
        if scan[i] == 0xFF:
            assert scan[i + 1] == 0 or 0xD0 <= scan[i + 1] <= 0xD7
            if scan[i + 1]:
                i += 2
                continue
        bits += [scan[i] >> k & 1 for k in range(7, -1, -1)]
        i += 2 if scan[i] == 0xFF else 1
    for k in range(0, len(bits), 9):
        assert bits[k] == 0
        v = int("".join(map(str, bits[k + 1 : k + 9])), 2)
        out.append(v if v >= 128 else v - 255)
    return out


def test_frames_are_baseline_scans():
    payload = random.Random(1).randbytes(64 * 64)
    frame = mjpeg.parse(mjpeg.write(payload))["frames"][0]
    assert slow_coefficients(frame) == [b if b >= 128 else b - 255 for b in payload]


def test_inverse_dct_by_definition():
    payload = random.Random(2).randbytes(64)
    zigzag = sorted(range(64), key=lambda i: ((i // 8 + i % 8), (i // 8) if (i // 8 + i % 8) % 2 else (i % 8)))
    f = np.zeros(64)
    f[zigzag] = [b if b >= 128 else b - 255 for b in payload]
    f = f.reshape(8, 8)
    c = lambda u: np.sqrt(0.5) if u == 0 else 1.0
    want = [[0.25 * sum(c(u) * c(v) * f[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) + 128 for y in range(8)] for x in range(8)]
    got = mjpeg.pixels(payload).reshape(8, 8)
    assert np.abs(np.clip(np.rint(want), 0, 255) - got).max() <= 1


def test_shots_at_a_change():
    h = np.zeros((40, 32))
    h[:20, 3] = 1
    h[20:, 9] = 1
    assert mjpeg.shots(h) == [0, 20] and mjpeg.shots(h[:1]) == [0]


def test_damage(spark):
    good = mjpeg.write(mjpeg.padded(b"abc" * 5000))
    for bad in (good[:-10], b"RIFF", b"", good[:8] + b"WAVE" + good[12:]):
        with pytest.raises(ValueError):
            mjpeg.parse(bad)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, None)], "id int, media binary")
    rows = mjpeg.clip_rows(df, "media").orderBy("id").collect()
    assert rows[0].first_frame == 0 and {r.id: r.start_ms for r in rows if r.id > 1} == {2: None, 3: None}


def test_table(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "abc", 3), (3, "abc", 3), (None, "é" * 20000, 4)]
    got = mjpeg.media_digest(spark.createDataFrame(rows, "doc_id bigint, text string, media_bytes int")).collect()
    assert len(got) == 5
    for r in got:
        body = next((t or "").encode() for i, t, _ in rows if i == r.doc_id)
        payload = body + bytes(-len(body) % 64 if body else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = mjpeg.write(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, media_bytes int")
    assert mjpeg.media_digest(none).count() == 0 and "feature" in mjpeg.media_digest(none).columns
