import hashlib
import zlib

import cases
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reminisce.llm import gif, media

#: A GIF of ten by ten pixels in four colours, known from descriptions of the format.
SAMPLE = bytes.fromhex("47494638396 10A000A00910000FFFFFFFF00000000FF00000021F904000000000 02C000000000A000A000002168C2D99872A1CDC33A00275EC95FAA8DE608C04914C01003B".replace(" ", ""))


def test_sample():
    (f,) = gif.decode(SAMPLE)
    assert f.indices[0].tolist() == [1] * 5 + [2] * 5 and f.indices[3].tolist() == [1] * 3 + [0] * 4 + [2] * 3 and f.indices[9].tolist() == [2] * 5 + [1] * 5
    assert f.canvas[0, 0].tolist() == [255, 0, 0, 255] and f.canvas[0, 9].tolist() == [0, 0, 255, 255]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(2, 8))
def test_lzw_round_trip(data, base):
    data = bytes(x & ((1 << base) - 1) for x in data)
    assert gif.lzw_decode(gif.lzw_encode(data, base), base) == data


@pytest.mark.parametrize("data", [b"\0" * 500_000, np.random.default_rng(0).integers(0, 256, 100_000, dtype=np.uint8).tobytes(), b"ab" * 40_000])
def test_lzw_long(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8) == data


def block(left, top, values, disposal=1, delay=5, clear=None, interlaced=False):
    v = np.array(values, np.uint8)
    flags = disposal << 2 | (clear is not None)
    rows = np.concatenate([np.arange(a, len(v), b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))]) if interlaced else np.arange(len(v))
    import struct

    return b"\x21\xf9\x04" + struct.pack("<BHB", flags, delay, clear or 0) + b"\0\x2c" + struct.pack("<HHHHB", left, top, v.shape[1], v.shape[0], 0x40 if interlaced else 0) + b"\x02" + gif._split(gif.lzw_encode(v[rows].tobytes(), 2)) 


def stream(*blocks):
    import struct

    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x81, 0, 0) + palette + b"\x21\xfe\x03abc\0" + b"".join(blocks) + b"\x3b"


def test_disposal_and_transparency():
    full = [[1] * 4] * 4
    frames = gif.decode(stream(block(0, 0, full, 1), block(1, 1, [[2, 0], [0, 2]], 3, clear=0), block(0, 0, [[3]], 2), block(3, 3, [[2]], 1)))
    colours = lambda f: [["-" if p[3] == 0 else "krgb"[[(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255)].index(tuple(p[:3].tolist()))] for p in row] for row in f.canvas]
    assert colours(frames[1]) == [list("rrrr"), list("rgrr"), list("rrgr"), list("rrrr")]
    assert colours(frames[2]) == [list("brrr"), list("rrrr"), list("rrrr"), list("rrrr")]
    assert colours(frames[3]) == [list("-rrr"), list("rrrr"), list("rrrr"), list("rrrg")]
    assert [f.delay_ms for f in frames] == [50] * 4


def test_interlaced():
    v = [[i % 4] * 4 for i in range(4)]
    assert gif.decode(stream(block(0, 0, v, interlaced=True)))[0].indices.tolist() == v


def test_media_columns(spark):
    made = stream(block(0, 0, [[1] * 4] * 4, delay=5), block(0, 0, [[2] * 4] * 4, delay=7))
    df = spark.createDataFrame([(1, made, 9), (2, None, 9), (3, b"no gif", 9), (4, made[:30], 9), (4, made[:30], 9)], "id long, media binary, frames int")
    out = {r.id: r for r in media.media_columns(df).collect()}
    assert [(f.start_ms, f.delay_ms) for f in out[1].frames] == [(0, 50), (50, 70)] and out[1].duration_ms == 120
    assert out[1].frames[0].histogram[48] == 16 and sum(out[1].frames[1].histogram) == 16
    assert out[2].frames is None and out[3].media_error == "not a GIF" and out[4].frames is None and out[4].media_error
    assert media.media_columns(df.limit(0)).count() == 0


def test_texts(spark):
    texts = [r[1] for r in cases.EDGES]
    df = cases.clashing(spark, "n_bytes", "media", "feature")
    got = cases.rows(media.media(df), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for i, t in [(r[0], r[1] or "") for r in cases.EDGES]:
        p = t.encode()
        p += b"\0" * (-len(p) % 64 if p else 64)
        want.append((i, len(t.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert got == sorted(want, key=repr) and len(got) == len(texts)
    assert media.media(df.limit(0)).count() == 0
    stored = media.store_texts(df.select("doc_id", "text")).collect()
    assert {r.doc_id: (r.media_bytes, r.media_sha256) for r in media.media(df).collect()} == {r.doc_id: (len(r.media), hashlib.sha256(r.media).hexdigest()) for r in stored}


def test_several_frames():
    p = bytes(64) * 70_000 + b"x" * 64
    frames = gif.decode(media.to_gif(p))
    assert len(frames) == 2 and b"".join(f.canvas[..., 0].tobytes() for f in frames)[: len(p)] == p
