import struct

import numpy as np
import pytest

from tesserae.operators import bilevel as B
from tesserae.operators import compressors as C
from tesserae.operators import images as I
from tesserae.operators import lossless as L

RNG = np.random.default_rng(42)
EOL = "000000000001"


def patterns(h, w):
    y, x = np.mgrid[:h, :w]
    center = (y == h // 2) & (x == w // 2)
    blocks = np.kron(RNG.random((-(-h // 4), -(-w // 4))) < 0.4, np.ones((4, 4), bool))[:h, :w]
    return {
        "white": y < 0,
        "black": y >= 0,
        "h_stripes": y % 2 == 1,
        "v_stripes": x % 2 == 0,
        "checkerboard": (x + y) % 2 == 0,
        "random": RNG.random((h, w)) < 0.5,
        "center": center,
        "border": (y == 0) | (x == 0) | (y == h - 1) | (x == w - 1),
        "blocks": blocks,
        "slant": (x + y) % 9 < 4,
    }


def run_word(n, color):
    words = B.BLACK if color else B.WHITE
    out = ""
    while n >= 2560 + 64:
        out += B.LONG[-1]
        n -= 2560
    if n >= 64:
        out += [*words, *B.LONG][63 + n // 64]
    return out + words[n % 64]


def plain_row(row):
    out, color, k = "", 0, 0
    while k < len(row):
        n = 0
        while k + n < len(row) and row[k + n] == color:
            n += 1
        out += run_word(n, color)
        k += n
        color ^= 1
    return out


def changes(row, start, color):
    """The first pixel from start on that differs from the one before it and has another colour than color."""
    for i in range(start, len(row)):
        if row[i] != (row[i - 1] if i else 0) and row[i] != color:
            return i
    return len(row)


def next_change(row, start):
    for i in range(start, len(row)):
        if row[i] != (row[i - 1] if i else 0):
            return i
    return len(row)


def referring_row(row, above):
    """T.4 two-dimensional coding, pixel by pixel."""
    words = {v: k for k, v in B.MODES.items()}
    out, a0, color, w = "", -1, 0, len(row)
    while a0 < w:
        a1 = next((i for i in range(max(a0, 0), w) if row[i] != color), w)
        b1 = changes(above, a0 + 1, color)
        b2 = next_change(above, b1 + 1)
        if b2 < a1:
            out += words["pass"]
            a0 = b2
        elif abs(a1 - b1) <= 3:
            out += words[a1 - b1]
            a0, color = a1, color ^ 1
        else:
            a2 = next((i for i in range(a1, w) if row[i] == color), w)
            out += words["horizontal"] + run_word(a1 - max(a0, 0), color) + run_word(a2 - a1, color ^ 1)
            a0 = a2
    return out


def packed(bits):
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def encoded(x, form):
    rows = x.astype(int).tolist()
    above = [0] * x.shape[1]
    if form == "rle":
        return b"".join(packed(plain_row(r)) for r in rows)
    out = ""
    for k, r in enumerate(rows):
        if form == "fax4":
            out += referring_row(r, above)
        elif form == "fax3":
            out += EOL + plain_row(r)
        elif form == "fax3 filled":
            out += "0" * ((4 - len(out)) % 8) + EOL + plain_row(r)
        else:
            out += EOL + ("1" + plain_row(r) if k % 4 == 0 else "0" + referring_row(r, above))
        above = r
    return packed(out + {"fax4": EOL * 2, "fax3 2d": (EOL + "1") * 6}.get(form, EOL * 6))


def decoded(data, form, w):
    if form == "rle":
        return B.ccittrle_decode(data, w)
    if form == "fax4":
        return B.ccittfax4_decode(data, w)
    return B.ccittfax3_decode(data, w, t4options={"fax3": 0, "fax3 filled": 4, "fax3 2d": 1}[form])


@pytest.mark.parametrize("words", (B.WHITE, B.BLACK, list(B.MODES)))
def test_code_words_are_free_of_prefixes(words):
    every = sorted([*words, EOL[:11], *(B.LONG if len(words) == 91 else [])])
    assert len(words) in (91, 9)
    assert not any(b.startswith(a) for a, b in zip(every, every[1:]))


@pytest.mark.parametrize("form", ("rle", "fax3", "fax3 filled", "fax3 2d", "fax4"))
@pytest.mark.parametrize("shape", ((1, 1), (7, 13), (16, 64), (9, 200), (3, 5300)))
def test_ccitt(form, shape):
    for name, x in patterns(*shape).items():
        data = encoded(x, form)
        assert (decoded(data, form, shape[1]) == x).all(), name
        assert decoded(data, form, shape[1]).shape == shape, name


def test_ccitt_errors_and_sizes():
    with pytest.raises(ValueError):
        B.ccittfax4_decode(b"\0")
    with pytest.raises(C.CodecError):
        B.ccittrle_decode(b"\x00\x01\x80", 10)
    assert B.ccittrle_decode(b"", 10).shape == (0, 10)
    assert B.ccittfax3_decode(b"", 4, 2).tolist() == [[0] * 4] * 2


@pytest.mark.parametrize("form, code, options", (("rle", 2, 0), ("fax3 2d", 3, 1), ("fax4", 4, 0)))
@pytest.mark.parametrize("order", (1, 2))
def test_tiff_of_two_colors(form, code, options, order):
    x = patterns(20, 37)["blocks"]
    strip = encoded(x, form)
    if order == 2:
        strip = bytes(int(f"{c:08b}"[::-1], 2) for c in strip)
    tags = [(256, 37), (257, 20), (258, 1), (259, code), (262, 0), (266, order), (273, 8), (277, 1), (278, 20), (279, len(strip)), (292, options)]
    strip_end = 8 + len(strip)
    data = b"II*\0" + struct.pack("<I", strip_end) + strip + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)
    assert (I.tiff_decode(data) == x).all()


@pytest.mark.parametrize("bits, dtype", ((8, "u1"), (12, "u2"), (16, "u2")))
@pytest.mark.parametrize("shape", ((1, 1), (31, 17), (64, 100), (5, 6, 1)))
def test_ljpeg(bits, dtype, shape):
    for x in (RNG.integers(0, 1 << bits, shape), np.full(shape, 3), np.arange(np.prod(shape)).reshape(shape) % (1 << bits)):
        x = x.astype(dtype)
        back = L.ljpeg_decode(L.ljpeg_encode(x, bits))
        assert back.dtype == x.dtype and (back == x.reshape(shape[:2])).all()
    table = (np.arange(1 << bits) // 2).astype(np.uint16)
    assert (L.ljpeg_decode(L.ljpeg_encode(x, bits, delinearize=table)) == x.reshape(shape[:2]) // 2).all()
    assert (L.ljpeg_decode(L.ljpeg_encode(x, bits), linearize=table) == x.reshape(shape[:2]) // 2).all()


def test_ljpeg_of_skewed_counts():
    """Counts like Fibonacci's would need words of more than 16 bits."""
    a, b, d = 1, 1, []
    for size in range(16):
        d += [1 << size] * a
        a, b = b, a + b
    x = (np.cumsum(d) & 0xFFFF).astype(np.uint16)[None]
    assert (L.ljpeg_decode(L.ljpeg_encode(x)) == x).all()
    with pytest.raises(ValueError):
        L.ljpeg_encode(np.zeros((2, 2), np.float32))


def predicted(x, y, k, predictor, start):
    if y == 0 or k == 0:
        return start if y == k == 0 else int(x[y, k - 1]) if y == 0 else int(x[y - 1, 0])
    a, b, c = int(x[y, k - 1]), int(x[y - 1, k]), int(x[y - 1, k - 1])
    return [a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1][predictor - 1]


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize("n, every", ((1, 0), (3, 0), (1, 2)))
def test_sof3_predictors_components_and_restarts(predictor, n, every):
    """Codes of 8 bits for every size, in a scan written bit by bit."""
    h, w = 7, 5
    x = RNG.integers(0, 4096, (h, w, n))
    scan, bits = b"", ""

    def flushed(bits):
        bits += "1" * (-len(bits) % 8)
        return packed(bits).replace(b"\xff", b"\xff\0")

    for y in range(h):
        if every and y and y % every == 0:
            scan += flushed(bits) + bytes([0xFF, 0xD0 + (y // every - 1) % 8])
            bits = ""
        first = y % every == 0 if every else y == 0
        for k in range(w):
            for c in range(n):
                own = x[y if first else 0 : y + 1, :, c] if not every else x[y - y % every : y + 1, :, c]
                d = int(x[y, k, c]) - predicted(own, len(own) - 1, k, predictor, 2048)
                size = abs(d).bit_length()
                bits += f"{size:08b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
    scan += flushed(bits)
    part = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    data = b"\xff\xd8" + part(0xC4, b"\0" + bytes([0] * 7 + [17] + [0] * 8) + bytes(range(17)))
    data += part(0xDD, struct.pack(">H", every * w)) + part(0xC3, struct.pack(">BHHB", 12, h, w, n) + b"".join(bytes([c + 1, 0x11, 0]) for c in range(n)))
    data += part(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0]) for c in range(n)) + bytes([predictor, 0, 0])) + scan + b"\xff\xd9"
    out = L.jpegsof3_decode(data)
    assert (out.reshape(h, w, n) == x).all() and out.dtype == np.uint16
    for broken in (data[:40], b"", data.replace(b"\xff\xc3", b"\xff\xc0")):
        with pytest.raises((C.CodecError, struct.error)):
            L.jpegsof3_decode(broken)


PLIO = [np.zeros(1), np.zeros(100), np.ones(100), np.full(100, 4095), np.full(100, 4096), np.full(1, 16777215), np.arange(100), np.array([0, 1, 0, 0, 255, 0, 65535, 0, 16777215, 0])]
PLIO += [RNG.integers(0, 256, 992), np.repeat([0, 7, 0, 3], [4095, 1, 9000, 8191]), np.repeat([5, 0], [1, 4096])]


@pytest.mark.parametrize("x", PLIO)
def test_plio(x):
    data = L.plio_encode(x)
    assert struct.unpack_from("<7h", data)[2] == -100 and struct.unpack_from("<h", data, 6)[0] == len(data) // 2
    back = L.plio_decode(data, len(x))
    assert back.dtype == np.int32 and (back == x).all()


def test_plio_errors():
    assert L.plio_decode(L.plio_encode(np.array([1.9, 2.5, 3.7], np.float32)), 3).tolist() == [1, 2, 3]
    for f in (lambda: L.plio_encode(np.zeros((4, 4))), lambda: L.plio_encode(np.zeros(0)), lambda: L.plio_decode(b"\0\0", 10), lambda: L.plio_decode(L.plio_encode(np.zeros(3)), -1)):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(TypeError):
        L.plio_decode(L.plio_encode(np.zeros(3)))


@pytest.mark.parametrize("dtype, most", (("u1", 255), ("u2", 65535), ("f4", 1.0)))
@pytest.mark.parametrize("shape", ((31, 33), (31, 33, 3)))
@pytest.mark.parametrize("deflate", (True, False))
def test_pixarlog(dtype, most, shape, deflate):
    """The codes are a factor of exp(1/250) apart, or 1/250 of e ** -4 and below in the linear part."""
    x = (RNG.random(shape) * most).astype(dtype)
    back = L.pixarlog_decode(L.pixarlog_encode(x, deflate=deflate), shape, dtype, deflate)
    assert back.dtype == x.dtype and back.shape == shape
    a, b = x.astype(float) / most, back.astype(float) / most
    assert (np.abs(a - b) <= 0.004 * a + 2e-4 + (0.51 / most if dtype != "f4" else 0)).all()
    if dtype == "f4":
        assert L.pixarlog_decode(L.pixarlog_encode(np.array([[-1, np.nan, 3, 99]], "f4")), (1, 4), "f4")[0] == pytest.approx([0, 0, 3, 24.2], rel=0.01)


def test_h5crc():
    """The table's rule bit by bit; it differs from the usual CRC, which reflects the polynomial."""
    data, crc = b"Four score and seven years ago", 0xFFFFFFFF
    for c in data:
        crc ^= c
        for _ in range(8):
            crc = crc >> 1 ^ (0x04C11DB7 if crc & 1 else 0)
    assert C.h5crc(data) == crc ^ 0xFFFFFFFF != C.crc32(data)
    assert C.checksum_decode(C.checksum_encode(data, "h5crc"), "h5crc") == data
