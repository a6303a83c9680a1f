import struct

import numpy as np
import pytest

from tesserae.operators import compressors as C
from tesserae.operators import filters as A
from tesserae.operators import images as I
from tesserae.plans.layout import CAPS, image_layout

RNG = np.random.default_rng(42)


def test_delta_and_xor_of_bytes():
    x = np.frombuffer(b"0123456789", np.uint8)
    assert A.delta_encode(x).tobytes() == bytes([0x30, *[1] * 9])
    assert A.xor_encode(x).tobytes().hex() == "3001030107010301" + "0f01"


@pytest.mark.parametrize("dtype", "u1 u2 u4 u8 i1 i2 i4 i8 f4 f8".split())
@pytest.mark.parametrize("axis", (-1, -2, 0))
def test_filters_round_trip(dtype, axis):
    x = (RNG.random((33, 31, 3)) * 200).astype(dtype)
    for name in ("delta", "xor"):
        f, g = getattr(A, f"{name}_encode"), getattr(A, f"{name}_decode")
        assert (g(f(x, axis=axis), axis=axis).view(np.uint8) == x.view(np.uint8)).all()
    assert (A.byteshuffle_decode(A.byteshuffle_encode(x, axis), axis) == x).all()
    assert (A.floatpred_decode(A.floatpred_encode(x, axis, 1), axis, 1) == x).all()
    assert (A.bitorder(A.bitorder(x)) == x).all()
    raw = x.tobytes() + b"odd"
    assert A.bitshuffle_decode(A.bitshuffle_encode(raw, x.itemsize), x.itemsize) == raw


def test_bitorder():
    assert A.bitorder(b"\x01\x00\x9a\x02") == b"\x80\x00\x59\x40"
    assert A.bitorder(np.array([1, 666], np.uint16)).tolist() == [128, 16473]


def test_packints():
    assert A.packints_decode(b"a", "u1", 1).tolist() == [0, 1, 1, 0, 0, 0, 0, 1]
    assert A.packints_decode(b"ab", "u1", 2).tolist() == [1, 2, 0, 1, 1, 2, 0, 2]
    assert A.packints_decode(b"abcd", "u1", 3).tolist() == [3, 0, 2, 6, 1, 1, 4, 3, 3, 1]
    assert A.packints_decode(bytes.fromhex("a55a5a"), "u2", 12, bitorder=">").tolist() == [0xA5A, 0x5A5]
    assert A.packints_decode(bytes.fromhex("aa1255"), "u2", 10, bitorder=">").tolist() == [0x2AA, 0x155]
    assert A.packints_decode(bytes.fromhex("5a5a5a"), "u2", 12, bitorder="<").tolist() == [0xA5A, 0x5A5]
    for bits in (1, 2, 3, 4, 7, 8, 9, 10, 12, 15, 16, 24, 31, 32):
        x = RNG.integers(0, 1 << bits, 40).astype(np.uint32)
        assert (A.packints_decode(A.packints_encode(x, bits, 10), "u4", bits, 10) == x).all()


def test_bfloat16():
    assert A.bfloat16_encode(np.array([1 / 3], np.float32)) == b"\xab\x3e"
    assert A.bfloat16_encode(np.array([1.2], np.float32)) == b"\x9a\x3f"
    assert np.isinf(A.bfloat16_decode(A.bfloat16_encode(np.array([3.40e38], np.float32)))[0])
    assert A.bfloat16_encode(np.array([np.nan], np.float32)) == b"\xc0\x7f"
    every = np.arange(1 << 16, dtype="<u2")
    x = A.bfloat16_decode(every.tobytes())
    ok = ~np.isnan(x)
    assert (np.frombuffer(A.bfloat16_encode(x), "<u2")[ok] == every[ok]).all()


def test_float24():
    assert A.float24_encode(np.array([np.pi], np.float32), ">") == bytes.fromhex("409220")
    every = np.arange(1 << 24, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, :3].copy()
    x = A.float24_decode(every.tobytes())
    ok = ~np.isnan(x)
    back = np.frombuffer(A.float24_encode(x), np.uint8).reshape(-1, 3)
    assert (back[ok] == every[ok]).all()


def test_quantize():
    x = np.linspace(-2.1, 31.4, 51).reshape(3, 17)
    for dtype in ("f4", "f8"):
        y = x.astype(dtype)
        assert np.abs(A.quantize_encode(y, "scale", 2) - y).max() <= 0.005
        assert np.allclose(A.quantize_encode(y, "bitround", 10), y, rtol=2**-10)
        assert np.allclose(A.quantize_encode(y, "bitgroom", 3), y, rtol=1e-3)


def test_eer():
    out = A.eer_decode(bytes.fromhex("031bfcb135fb"), (1, 312), 7, 1, 1)
    assert np.flatnonzero(out[0]).tolist() == [3, 17, 233, 311]


def test_packbits():
    for raw, coded in ((b"", b""), (b"\x01", b"\x00\x01"), (b"X" * 10, b"\xf7X"), (b"X" * 128, b"\x81X"), (b"abc", b"\x02abc")):
        assert C.packbits_encode(raw) == coded and C.packbits_decode(coded) == raw
    assert C.packbits_decode(b"\x80\x00a\x00") == b"a"


@pytest.mark.parametrize("name", "zlib deflate gzip bz2 lzma zstd brotli lz4 lz4f lz4h5 snappy packbits lzw lzf pglz".split())
@pytest.mark.parametrize("n", (0, 2, 31 * 33 * 3, 70_000))
def test_compressors_round_trip(name, n):
    f, g = getattr(C, f"{name}_encode"), getattr(C, f"{name}_decode")
    for raw in (RNG.integers(0, 256, n).astype(np.uint8).tobytes(), (b"abcabcabd" * n)[:n], b"\0" * n):
        assert g(f(raw)) == raw


def test_lz_headers_and_blocks():
    raw = b"hello hello hello hello"
    assert C.lz4_decode(C.lz4_encode(raw, header=True), header=True) == raw
    assert C.lz4h5_decode(C.lz4h5_encode(raw * 9, blocksize=50)) == raw * 9
    assert C.lzf_decode(C.lzf_encode(raw, True), True) == raw and C.pglz_decode(C.pglz_encode(raw, True), True) == raw
    assert C.lzo_decode(bytes.fromhex("f100000040" "1561010c61201b0c00110000")) == bytes.fromhex("61010c61") * 16


def test_lzw_negative():
    assert C.lzw_decode(bytes.fromhex("804040")) == b""
    with pytest.raises(C.CodecError):
        C.lzw_decode(b"abc")


def test_dicomrle():
    head = struct.pack("<16I", 2, 64, 68, *[0] * 13)
    body = C.packbits_encode(b"\x01\x02").ljust(4, b"\0") + C.packbits_encode(b"\x03\x04")
    assert np.frombuffer(C.dicomrle_decode(head + body), "<u2").tolist() == [0x0103, 0x0204]
    with pytest.raises(C.CodecError):
        C.dicomrle_decode(b"\0" * 64)


def test_checksums():
    words = [1911, -2427, 1897, -2412, 2440, 873, -621, -829, 551, -2118]
    assert C.fletcher32(np.array(words, np.int64).tobytes()) == 1686513149
    text = b"Four score and seven years ago"
    assert C.lookup3(text) == 0x17770551 and C.lookup3(text, 1) == 0xCD628161 and C.lookup3(text, 1230) == 0x0EE25AD7
    assert C.lookup3(b"") == 0xDEADBEEF
    assert C.hash_string(b"") == 5381 and C.hash_string(text) == 316074956
    with pytest.raises(C.CodecError):
        C.checksum_decode(b"x" + C.checksum_encode(text))


@pytest.mark.parametrize("dtype", ("u1", "i1", "u2", "i2", "i4", "u4"))
def test_rcomp(dtype):
    for x in (RNG.integers(0, 100, (7, 31)), np.zeros((3, 5)), np.cumsum(RNG.integers(-3, 4, 100))):
        x = x.astype(dtype)
        assert (C.rcomp_decode(C.rcomp_encode(x), x.shape, dtype) == x).all()


@pytest.mark.parametrize("samples", (1, 2, 3, 4))
@pytest.mark.parametrize("dtype", ("u1", "u2"))
def test_png(samples, dtype):
    x = RNG.integers(0, 255, (17, 19, samples)).astype(dtype)
    x = x[..., 0] if samples == 1 else x
    assert (I.png_decode(I.png_encode(x)) == x).all()
    frames = np.stack([x, x[::-1]])
    assert (I.apng_decode(I.apng_encode(frames)) == frames).all() and (I.apng_decode(I.apng_encode(frames), 1) == x[::-1]).all()


def test_png_filters():
    import zlib

    x = RNG.integers(0, 255, (5, 4, 3)).astype(np.uint8)
    out, above = bytearray(), np.zeros(12, int)
    for y in range(5):
        row = x[y].ravel().astype(int)
        a = np.r_[[0] * 3, row[:-3]]
        c = np.r_[[0] * 3, above[:-3]]
        p = a + above - c
        d = np.abs(np.stack([p - a, p - above, p - c]))
        guess = np.where((d[0] <= d[1]) & (d[0] <= d[2]), a, np.where(d[1] <= d[2], above, c))
        line = [row, row - a, row - above, row - (a + above) // 2, row - guess][y]
        out += bytes([y]) + (line % 256).astype(np.uint8).tobytes()
        above = row
    made = I.PNG_SIGNATURE + I._png_head(x) + I._png_chunk(b"IDAT", zlib.compress(bytes(out))) + I._png_chunk(b"IEND", b"")
    assert (I.png_decode(made) == x).all()


def test_other_images():
    rgb, rgba, gray = (RNG.integers(0, 4, s).astype(np.uint8) * 60 for s in ((12, 15, 3), (12, 15, 4), (12, 15)))
    for x in (rgb, rgba):
        assert (I.qoi_decode(I.qoi_encode(x)) == x).all()
    for x in (rgb, rgba, gray):
        assert (I.bmp_decode(I.bmp_encode(x)) == x).all()
        for rle in (False, True):
            assert (I.tga_decode(I.tga_encode(x, rle)) == x).all()
    for x in (rgb, gray):
        assert (I.pcx_decode(I.pcx_encode(x)) == x).all()
    big = RNG.integers(0, 256, (90, 100)).astype(np.uint8)
    assert (I.gif_decode(I.gif_encode(big), asrgb=False) == big).all()
    assert (I.gif_decode(I.gif_encode(np.stack([gray, gray.T.reshape(12, 15)])), 1, False) == gray.T.reshape(12, 15)).all()
    hdr = RNG.random((6, 7, 3)).astype(np.float32) * 10
    assert np.abs(I.rgbe_decode(I.rgbe_encode(hdr)) - hdr).max() < 0.1
    for level in (0, 1):
        assert (I.numpy_decode(I.numpy_encode(hdr, level)) == hdr).all()
    for how in ("none", "lzw", "deflate", "packbits"):
        for x in (rgb, gray, np.stack([gray] * 5), hdr[..., 0], rgb.astype(np.uint16) * 99):
            assert (I.tiff_decode(I.tiff_encode(x, how, 5), None) == x).all()


def test_block_textures():
    red = struct.pack("<HHI", 0xF800, 0, 0)
    assert (I.bcn_decode(red, 1, (4, 4)) == [255, 0, 0, 255]).all()
    head = bytearray(b"DDS ".ljust(128, b"\0"))
    head[12:20] = struct.pack("<II", 4, 4)
    head[84:88] = b"DXT1"
    assert I.dds_decode(bytes(head) + red).shape == (4, 4, 4)


def test_layout():
    assert image_layout((48, 64, 3), "u1").photometric == "rgb"
    a = image_layout((10, 48, 64), "u1")
    assert (a.frames, a.photometric, a.samples) == (10, "gray", 1)
    b = image_layout((10, 48, 64), "u1", caps=CAPS["uint"] | CAPS["sz1"] | CAPS["gray"] | CAPS["extra"])
    assert b.samples == 64
    with pytest.raises(ValueError):
        image_layout((), "u1")
    with pytest.raises(ValueError):
        image_layout((4, 4, 2), "u1", photometric="rgb")


@pytest.mark.parametrize("compression", ("none", "lzw", "deflate", "packbits", "lzma", "zstd"))
@pytest.mark.parametrize("dtype", ("u1", "u2", "i4", "f4", "f8"))
@pytest.mark.parametrize("shape", ((31, 17), (31, 17, 3), (2, 5, 6)))
def test_tiff_predictors(compression, dtype, shape):
    x = (RNG.random(shape) * 250 - (dtype in ("i4", "f4", "f8")) * 100).astype(dtype)
    for rows in (0, 4):
        plain, coded = (I.tiff_encode(x, compression, rows, p) for p in (False, True))
        for data in (plain, coded):
            back = I.tiff_decode(data, None)
            assert back.dtype == x.dtype and (back == x).all()
        assert plain != coded


def test_float_predictor_by_its_definition():
    """Bytes of the floats, the highest of all first, then differences of neighbouring bytes."""
    x = np.array([[1.5, -2.25, 3e7, 0.0]], "f4")
    planes = x.astype(">f4").view(np.uint8).reshape(4, 4).T.ravel()
    assert A.floatpred_encode(x).tobytes() == np.diff(planes, prepend=np.uint8(0)).astype(np.uint8).tobytes()


def test_apng_of_one_image():
    for shape in ((5, 7), (5, 7, 3), (5, 7, 4)):
        x = RNG.integers(0, 256, shape, dtype=np.uint8)
        assert (I.apng_decode(I.apng_encode(x)).reshape(shape) == x).all()


def test_packints_in_other_bit_orders():
    # Two published packings of pairs.
    assert A.packints_encode(np.array([0xA5A, 0x5A5], "u2"), 12, bitorder=">") == b"\xa5\x5a\x5a"
    assert A.packints_encode(np.array([0x2AA, 0x155], "u2"), 10, bitorder=">") == b"\xaa\x12\x55"
    for order, bits in (("<", 9), ("<", 10), ("<", 12), ("<", 14), (">", 10), (">", 12)):
        for n in (2, 8, 100):
            x = (np.arange(n) * 37 & (1 << bits) - 1).astype("u2")
            made = A.packints_encode(x, bits, bitorder=order)
            assert len(made) == ((n * bits + 7) // 8 if order == "<" else n // 2 * 3)
            assert (A.packints_decode(made, "u2", bits, bitorder=order)[:n] == x).all()
        with pytest.raises(ValueError):
            A.packints_encode(x, bits, runlen=8, bitorder=order)
    for bad in ({"bitorder": "x", "bitspersample": 12}, {"bitorder": ">", "bitspersample": 14}, {"bitorder": "<", "bitspersample": 8}):
        with pytest.raises(ValueError):
            A.packints_encode(np.zeros(2, "u2"), **bad)
    with pytest.raises(ValueError):
        A.packints_encode(np.zeros(3, "u2"), 12, bitorder=">")


def test_pages_are_added_to_a_tiff():
    a, b = np.arange(15, dtype="u1").reshape(3, 5), np.arange(20, dtype="u2").reshape(4, 5)
    one = I.tiff_encode(a)
    two = I.tiff_encode(b, compression="lzw", appendto=one)
    three = I.tiff_encode(np.stack([a + 1, a + 2]), appendto=two)
    assert len(I.tiff_pages(three)) == 4
    for i, want in enumerate((a, b, a + 1, a + 2)):
        assert (I.tiff_decode(three, i) == want).all()
    with pytest.raises(Exception):
        I.tiff_encode(a, appendto=b"MM\0*" + bytes(8))


def test_interlaced_png():
    import zlib

    own = np.random.default_rng(9)
    for shape in ((9, 11, 3), (1, 1, 3), (5, 2), (8, 8), (16, 3, 4)):
        x = own.integers(0, 256, shape, "u1")
        h, w = shape[:2]
        color = {2: 0, 3: {3: 2, 4: 6}.get(shape[-1])}[x.ndim]
        rows = b""
        for y, a, down, across in I.PASSES:
            part = x[y::down, a::across]
            rows += b"".join(b"\0" + line.tobytes() for line in part) if part.size else b""
        piece = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        data = I.PNG_SIGNATURE + piece(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 1)) + piece(b"IDAT", zlib.compress(rows)) + piece(b"IEND", b"")
        assert (I.png_decode(data) == x).all()
