import struct

import numpy as np
import pytest

from tesserae.operators import blosc, cms
from tesserae.operators.compressors import CodecError


@pytest.mark.parametrize("compressor", ("lz4", "lz4hc", "snappy", "zlib", "zstd"))
@pytest.mark.parametrize("shuffle", ("noshuffle", "shuffle", "bitshuffle"))
@pytest.mark.parametrize("typesize", (1, 2, 4, 8, 3))
def test_blosc_round_trip(compressor, shuffle, typesize):
    own = np.random.default_rng(1)
    for data in (b"", b"x", own.integers(0, 255, 2021, "u1").tobytes(), np.arange(3000, dtype="i4").tobytes(), b"abc" * 1001):
        for level, block in ((0, 0), (1, 1000), (9, 0)):
            made = blosc.blosc_encode(data, level, compressor, shuffle, typesize, block)
            assert made[:2] == b"\2\1" and struct.unpack_from("<II", made, 4)[0] == len(data) and struct.unpack_from("<I", made, 12)[0] == len(made)
            assert blosc.blosc_decode(made) == data
    assert len(blosc.blosc_encode(np.arange(30000, dtype="i4").tobytes(), 9, compressor, "shuffle", 4)) < 30000


@pytest.mark.parametrize("compressor", ("lz4", "snappy", "zlib", "zstd"))
@pytest.mark.parametrize("shuffle", ("noshuffle", "shuffle", "bitshuffle"))
@pytest.mark.parametrize("typesize", (1, 2, 8, 3))
def test_blosc2_round_trip(compressor, shuffle, typesize):
    own = np.random.default_rng(1)
    for data in (b"", b"x", own.integers(0, 255, 2021, "u1").tobytes(), np.arange(3000, dtype="i4").tobytes(), bytes(5000), bytes(4000) + b"abc" * 1000):
        for level, block in ((0, 0), (1, 1000), (9, 0)):
            made = blosc.blosc2_encode(data, level, compressor, shuffle, typesize, block)
            assert made[2] & 5 == 5 and struct.unpack_from("<I", made, 12)[0] == len(made) and blosc.blosc2_decode(made) == data
    assert len(blosc.blosc2_encode(bytes(5000))) == 32
    assert blosc.blosc2_decode(blosc.blosc_encode(b"of the first format " * 50)) == b"of the first format " * 50


def test_blosc2_special_chunks():
    head = lambda special: struct.pack("<BBBBIII", 5, 1, 5, 4, 40, 40, 36) + bytes(15) + bytes((special << 4,))
    assert np.isnan(np.frombuffer(blosc.blosc2_decode(head(2) + b"1234"), "f4")).all()
    assert blosc.blosc2_decode(head(3) + b"1234") == b"1234" * 10 and blosc.blosc2_decode(head(4) + b"1234") == bytes(40)


def test_blosc_split_blocks_and_blosclz():
    x = np.arange(2048, dtype="<u2")
    low, high = x.astype("u1").tobytes(), (x >> 8).astype("u1").tobytes()
    body = b"".join(struct.pack("<I", len(p)) + p for p in (low, high))  # two streams, stored as they are
    frame = struct.pack("<BBBBIII", 2, 1, 1, 2, 4096, 4096, 20 + len(body)) + struct.pack("<I", 20) + body
    assert blosc.blosc_decode(frame) == x.tobytes()
    # literals "abc", then a match of 9 bytes at distance 3, then a literal
    coded = bytes([2]) + b"abc" + bytes([(7 << 5) | 0, 0, 2]) + bytes([0]) + b"z"
    assert blosc._blosclz(coded, 13) == b"abcabcabcabcz"
    with pytest.raises(CodecError):
        blosc.blosc_decode(b"short")
    with pytest.raises(NotImplementedError):
        blosc.blosc_encode(b"x", compressor="blosclz")


@pytest.mark.parametrize("name", (None, "null", "gray", "rgb", "srgb", "xyz", "lab2", "lab4", "adobergb", "linearrgb"))
def test_profiles_are_valid(name):
    p = cms.cms_profile(name)
    cms.cms_profile_validate(p)
    assert p[36:40] == b"acsp" and int.from_bytes(p[:4], "big") == len(p)


def test_profiles_of_own_make():
    whole = 4294967295
    red, green, blue, white = (2748779008, 1417339264), (1288490240, 2576980480), (644245120, 257698032), (1343036288, 1413044224)
    xyy = [v for x, y in (red, green, blue) for v in (x / whole, y / whole, 1.0)]
    xy = [v / whole for c in (red, green, blue) for v in c]
    rational = [v for c in (red, green, blue) for x in c for v in (x, whole)]
    one = cms.cms_profile("rgb", [white[0] / whole, white[1] / whole, 1.0], xyy, gamma=2.19921875)
    assert one == cms.cms_profile("rgb", [white[0] / whole, white[1] / whole], xy, gamma=2.19921875)
    assert one == cms.cms_profile("rgb", [white[0], whole, white[1], whole], rational, gamma=2.19921875)
    table = np.arange(1024, dtype=np.uint16)
    for p in (cms.cms_profile("gray", transferfunction=table), cms.cms_profile("rgb", transferfunction=(table / 1024).astype("f4")), cms.cms_profile("rgb", transferfunction=np.stack([table] * 3))):
        cms.cms_profile_validate(p)
    for bad in ({"gamma": 2.0, "transferfunction": table}, {"whitepoint": [1, 2, 3, 4, 5]}):
        with pytest.raises(ValueError):
            cms.cms_profile("rgb", **bad)
    with pytest.raises(ValueError):
        cms.cms_profile("srgb", gamma=2.0)
    with pytest.raises(CodecError):
        cms.cms_profile_validate(b"12345")


def test_transforms():
    v = np.arange(256, dtype="u1")
    rgb = np.stack([v, v[::-1], np.roll(v, 99)], -1)[None]
    light = cms.cms_transform(rgb, "srgb", "linearrgb", outdtype="f8")
    s = rgb / 255
    assert np.allclose(light, np.where(s <= 0.04045, s / 12.92, ((s + 0.055) / 1.055) ** 2.4), atol=1e-4)
    assert (cms.cms_transform(light, "linearrgb", "srgb", outdtype="u1") == rgb).all()
    assert (cms.cms_transform(cms.cms_transform(rgb, "srgb", "lab4", outdtype="f8"), "lab4", "srgb", outdtype="u1") == rgb).all()
    white = cms.cms_transform(np.full((1, 1, 3), 255, "u1"), "srgb", "xyz", outdtype="f8")
    assert np.allclose(white, cms.D50, atol=2e-4)
    lab = cms.cms_transform(np.array([[[255, 0, 0]]], "u1"), "srgb", "lab4", outdtype="f8")
    assert np.allclose(lab, [54.29, 80.80, 69.89], atol=0.05)  # Fixed values: sRGB's red at the connection white
    gray = cms.cms_transform(np.stack([v, v, v], -1)[None], "srgb", cms.cms_profile("gray", gamma=2.2))
    assert gray.shape == (1, 256) and (np.diff(gray.astype(int)) >= 0).all() and gray[0, 255] == 255
    assert cms.cms_transform(rgb, "srgb", "adobergb", outcolorspace="rgba", outplanar=True).shape == (4, 1, 256)
    assert (cms.cms_transform(np.moveaxis(rgb, -1, 0), "srgb", "srgb", planar=True) == rgb).all()
    with pytest.raises(ValueError):
        cms.cms_transform(rgb, "gray", "srgb", colorspace="rgb")
