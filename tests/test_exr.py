import struct
import zlib

import numpy as np
import pytest

from tesserae.operators import exr as X
from tesserae.operators.compressors import CodecError

RNG = np.random.default_rng(42)


@pytest.mark.parametrize("compression", X.COMPRESSIONS)
@pytest.mark.parametrize("dtype", ("f2", "f4", "u4"))
@pytest.mark.parametrize("shape", ((1, 1), (33, 31), (33, 31, 2), (33, 31, 3), (20, 7, 4), (5, 6, 9)))
def test_round_trip(compression, dtype, shape):
    for x in (RNG.random(shape) * 1000, np.zeros(shape), np.arange(np.prod(shape)).reshape(shape) // 5):
        x = x.astype(dtype)
        back = X.exr_decode(X.exr_encode(x, compression=compression))
        assert back.dtype == x.dtype and back.shape == x.shape and (back == x).all()


@pytest.mark.parametrize("shape", ((3, 20, 9), (3, 20, 9, 3)))
def test_parts(shape):
    x = RNG.random(shape).astype("f4")
    data = X.exr_encode(x, frames=True)
    assert (X.exr_decode(data, None) == x).all()
    assert all((X.exr_decode(data, k) == x[k]).all() for k in range(3)) and (X.exr_decode(data, -1) == x[2]).all()
    with pytest.raises(IndexError):
        X.exr_decode(data, 3)


def test_coding_by_its_definition():
    raw = RNG.integers(0, 256, 101, dtype=np.uint8).tobytes()
    order = raw[::2] + raw[1::2]
    assert X._spread(raw) == bytes([order[0], *[(b - a + 128) % 256 for a, b in zip(order, order[1:])]]) and X._gathered(X._spread(raw)) == raw
    assert X._unrle(b"\x03a" + b"\xfebc") == b"aaaabc"
    for s in (b"", b"abc" * 100 + b"x" * 1000 + b"yz", b"aab" * 90):
        assert X._unrle(X._rle(s)) == s


def test_tiles_and_mixed_types():
    """A tiled file put together by hand: half B, unsigned R."""
    h, w, tw, th = 10, 13, 8, 4
    b, r = RNG.random((h, w)).astype("f2"), RNG.integers(0, 900, (h, w)).astype("u4")
    put = lambda name, form, body: f"{name}\0{form}\0".encode() + struct.pack("<I", len(body)) + body
    head = put("channels", "chlist", b"B\0" + struct.pack("<IIII", 1, 0, 1, 1) + b"R\0" + struct.pack("<IIII", 0, 0, 1, 1) + b"\0") + put("compression", "compression", b"\3")
    head += put("dataWindow", "box2i", struct.pack("<4i", 5, -2, 5 + w - 1, -2 + h - 1)) + put("tiles", "tiledesc", struct.pack("<IIB", tw, th, 0)) + b"\0"
    chunks = []
    for y in range(0, h, th):
        for x in range(0, w, tw):
            raw = b"".join(b[k, x : x + tw].tobytes() + r[k, x : x + tw].tobytes() for k in range(y, min(y + th, h)))
            small = zlib.compress(X._spread(raw))
            body = small if len(small) < len(raw) else raw
            chunks.append(struct.pack("<5i", x // tw, y // th, 0, 0, len(body)) + body)
    start = 8 + len(head) + 8 * len(chunks)
    table = b"".join(struct.pack("<Q", start + sum(map(len, chunks[:k]))) for k in range(len(chunks)))
    data = struct.pack("<II", X.MAGIC, 2 | X.TILED) + head + table + b"".join(chunks)
    out = X.exr_decode(data)
    assert out.dtype == np.float16 and (out[..., 1] == b).all() and (out[..., 0] == r).all()


def test_errors():
    data = X.exr_encode(np.zeros((4, 4), "f4"))
    for broken in (b"", b"v/1\x01", data[:20], data[:-1], data.replace(b"compression\0\x01\0\0\0\x03", b"compression\0\x01\0\0\0\x04")):
        with pytest.raises((CodecError, struct.error, zlib.error)):
            X.exr_decode(broken)
    for bad in (np.zeros((2, 2)), np.zeros((0, 2), "f4"), np.zeros((1, 2, 2, 3, 3), "f4")):
        with pytest.raises(ValueError):
            X.exr_encode(bad)
