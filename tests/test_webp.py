import base64

import numpy as np
import pytest

from tesserae.operators import webp
from tesserae.operators.compressors import CodecError

OWN = np.random.default_rng(1)


@pytest.mark.parametrize("x", (OWN.integers(0, 256, (7, 9, 3), "u1"), OWN.integers(0, 256, (5, 300, 4), "u1"), np.zeros((1, 1, 3), "u1"), np.full((40, 3, 3), 200, "u1"), np.tile(np.arange(64, dtype="u1")[:, None, None], (1, 64, 3)), OWN.integers(0, 2, (20, 20, 4), "u1") * 255))
def test_webp_round_trip(x):
    made = webp.webp_encode(x)
    assert made[:4] == b"RIFF" and int.from_bytes(made[4:8], "little") == len(made) - 8 and (webp.webp_decode(made) == x).all()
    assert webp.webp_decode(made, hasalpha=True).shape[-1] == 4 and webp.webp_decode(made, hasalpha=False).shape[-1] == 3


def test_webp_known():
    # A well-known image of one transparent pixel.
    data = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.webp_decode(data).shape == (1, 1, 4) and webp.webp_decode(data)[0, 0, 3] == 0
    gray = np.arange(12, dtype="u1").reshape(3, 4)
    assert (webp.webp_decode(webp.webp_encode(gray)) == gray[..., None]).all()


def test_transforms_are_undone():
    width, height = 9, 7
    argb = [int(v) for v in OWN.integers(0, 2**32, width * height)]
    minus = lambda p, q: webp._join(*(x - y for x, y in zip(webp._split(p), webp._split(q), strict=True)))
    for mode in range(14):
        table = [mode << 8] * 6
        coded = []
        for i, p in enumerate(argb):
            y, x = divmod(i, width)
            guess = 0xFF000000 if i == 0 else argb[i - 1] if y == 0 else argb[i - width] if x == 0 else webp._predicted(mode, argb[i - 1], argb[i - width], argb[i - width + 1], argb[i - width - 1])
            coded.append(minus(p, guess))
        assert webp._undo(0, (2, 3, table), coded, width, height) == argb
    assert webp._undo(2, None, [webp._join(a, r - g, g, b - g) for a, r, g, b in map(webp._split, argb)], width, height) == argb
    colors = [0xFF000000, 0xFF112233, 0x80FFFFFF]
    index = [int(v) for v in OWN.integers(0, 3, width * height)]
    packed = [sum(index[y * width + x + k] << 2 * k for k in range(min(4, width - x))) << 8 for y in range(height) for x in range(0, width, 4)]
    assert webp._undo(3, (colors, 4), packed, width, height) == [colors[i] for i in index]


def test_copies_and_a_cache_of_colors():
    out = webp._Writer()
    for value, n in ((0x2F, 8), (5, 14), (0, 14), (0, 1), (0, 3), (0, 1), (1, 1), (1, 4), (0, 1)):  # 6 x 1, no transform, a cache of 2
        out.put(value, n)
    counts = np.zeros(256 + 24 + 2, np.int64)
    cached = 280 + ((0xFF050709 * webp.HASH & 0xFFFFFFFF) >> 31)
    counts[[7, 258, cached]] = 1  # a literal, a copy of 3, and a color of the cache
    green = out.code(counts)
    for value in (5, 9, 255):
        one = np.zeros(256, np.int64)
        one[value] = 1
        out.code(one)
    far = np.zeros(40, np.int64)
    far[1] = 1  # the place to the left
    out.code(far)
    for s in (7, 258, cached, 7):
        out.put(*green[s])
    body = out.done()
    data = b"RIFF" + (12 + len(body) + len(body) % 2).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    assert (webp.webp_decode(data) == [5, 7, 9]).all()


def test_webp_refuses():
    for bad in (b"RIFF", b"RIFF\4\0\0\0WEBP", webp.webp_encode(np.zeros((4, 4, 3), "u1"))[:24]):
        with pytest.raises(CodecError):
            webp.webp_decode(bad)
    with pytest.raises(NotImplementedError):
        webp.webp_encode(np.zeros((4, 4, 3), "u1"), level=80)
