"""H-compress images: the two-dimensional H-transform, bit planes by quadtrees, and signs."""

from __future__ import annotations

import struct

import numpy as np

from tesserae.operators.compressors import CodecError

# The magic number, and the codes of the sixteen patterns of a quad (value and bits).
MAGIC = b"\xdd\x99"
VALUES = (0x3E, 0x00, 0x01, 0x08, 0x02, 0x09, 0x1A, 0x1B, 0x03, 0x1C, 0x0A, 0x1D, 0x0B, 0x1E, 0x3F, 0x0C)
LENGTHS = (6, 3, 3, 4, 3, 4, 5, 5, 3, 5, 4, 5, 4, 5, 6, 4)
WORDS = [format(v, f"0{n}b") for v, n in zip(VALUES, LENGTHS, strict=True)]
READ = {w: i for i, w in enumerate(WORDS)}
TREE, PLAIN = "1111", "0000"


def _levels(height: int, width: int) -> list[tuple[int, int]]:
    """The sizes that halve to one, the whole first."""
    out = []
    while height > 1 or width > 1:
        out.append((height, width))
        height, width = (height + 1) // 2, (width + 1) // 2
    return out


def _up(v: np.ndarray, bit: int) -> np.ndarray:
    """To a multiple of 2 * bit: halves away from zero, as the inverse expects them."""
    return v + np.where(v >= 0, bit, bit - 1) & -2 * bit


def _transformed(x: np.ndarray) -> np.ndarray:
    """Sums and differences of two by two, of their sums again, and so on."""
    a = x.astype(np.int64)
    for k, (h, w) in enumerate(_levels(*x.shape)):
        p = np.pad(a[:h, :w], ((0, h % 2), (0, w % 2)), "edge")
        p00, p01, p10, p11 = p[::2, ::2], p[::2, 1::2], p[1::2, ::2], p[1::2, 1::2]
        shift, bit = min(k, 1), 1 << k
        h0, hx, hy, hc = (v >> shift for v in (p11 + p10 + p01 + p00, p11 + p10 - p01 - p00, p11 - p10 + p01 - p00, p11 - p10 - p01 + p00))
        hx, hy = (np.where(v >= 0, v + bit, v) & -2 * bit for v in (hx, hy))  # away from zero
        h0 = _up(h0, 2 * bit)
        up, left = (h + 1) // 2, (w + 1) // 2
        a[:up, :left], a[:up, left:w], a[up:h, :left], a[up:h, left:w] = h0, hy[:, : w - left], hx[: h - up], hc[: h - up, : w - left]
    return a


def _restored(a: np.ndarray) -> np.ndarray:
    a = a.copy()
    sizes = _levels(*a.shape)
    n = len(sizes)
    if not n:
        return a
    bit0 = 1 << n - 1
    a[:1, :1] = _up(a[:1, :1], 2 * bit0)
    for k in range(n - 1, -1, -1):
        h, w = sizes[k]
        up, left = (h + 1) // 2, (w + 1) // 2
        pad = lambda v: np.pad(v, ((0, up - v.shape[0]), (0, left - v.shape[1])))  # noqa: B023, E731
        h0, hy, hx, hc = a[:up, :left], pad(a[:up, left:w]), pad(a[up:h, :left]), pad(a[up:h, left:w])
        bit0 = 1 << k
        bit1 = 2 * bit0
        hx, hy = _up(hx, bit0), _up(hy, bit0)
        hc = hc + np.where(hc >= 0, bit0 >> 1, max((bit0 >> 1) - 1, 0)) & -bit0
        low0 = hc & bit0
        hx, hy = np.where(hx >= 0, hx - low0, hx + low0), np.where(hy >= 0, hy - low0, hy + low0)
        low1 = (hc ^ hx ^ hy) & bit1
        h0 = np.where(h0 >= 0, h0 + low0 - low1, h0 + np.where(low0 == 0, low1, low0 - low1))
        shift = 2 if k == 0 else 1
        out = np.empty((2 * up, 2 * left), np.int64)
        out[1::2, 1::2], out[1::2, ::2] = (h0 + hx + hy + hc) >> shift, (h0 + hx - hy - hc) >> shift
        out[::2, 1::2], out[::2, ::2] = (h0 - hx + hy - hc) >> shift, (h0 - hx - hy + hc) >> shift
        a[:h, :w] = out[:h, :w]
    return a


def _quads(bits: np.ndarray) -> np.ndarray:
    """The patterns of two by two bits."""
    p = np.pad(bits, ((0, bits.shape[0] % 2), (0, bits.shape[1] % 2)))
    return p[::2, ::2] << 3 | p[::2, 1::2] << 2 | p[1::2, ::2] << 1 | p[1::2, 1::2]


def _spread(codes: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.empty((2 * codes.shape[0], 2 * codes.shape[1]), np.int64)
    for i, (y, x) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        out[y::2, x::2] = codes >> 3 - i & 1
    return out[:height, :width]


def _quadrants(a: np.ndarray) -> list[tuple[np.ndarray, int]]:
    up, left = (a.shape[0] + 1) // 2, (a.shape[1] + 1) // 2
    return [(a[:up, :left], 0), (a[:up, left:], 1), (a[up:, :left], 1), (a[up:, left:], 2)]


def _planes(part: np.ndarray, count: int) -> list[str]:
    out = []
    for bit in range(count - 1, -1, -1):
        first = codes = _quads(part >> bit & 1)
        words: list[str] = []
        while True:
            words += [WORDS[c] for c in codes.ravel().tolist() if c]
            if codes.size <= 1:
                break
            codes = _quads((codes > 0).astype(np.int64))
        tree = "".join(reversed(words)) or WORDS[0]
        if len(tree) // 8 >= (first.size + 1) // 2:
            out.append(PLAIN + "".join(format(c, "04b") for c in first.ravel().tolist()))
        else:
            out.append(TREE + tree)
    return out


def hcomp_encode(x: np.ndarray, level: int = 0) -> bytes:
    """Rows of integers of up to 32 bits, of four by four at least; level: the scale, without loss up to 1."""
    x = np.asarray(x)
    if x.ndim != 2 or x.dtype.kind not in "iu" or x.dtype.itemsize > 4 or min(x.shape) < 4 or level < 0:
        raise ValueError("rows of integers of up to 32 bits, four by four at least")
    a = _transformed(x)
    if level > 1:
        half = (level + 1) // 2 - 1
        a = np.where(a > 0, a + half, half - a) // level * np.where(a > 0, 1, -1)
    total = int(a[0, 0])
    a[0, 0] = 0
    signs = "".join("1" if v < 0 else "0" for v in a.ravel().tolist() if v)
    a = np.abs(a)
    counts = [0, 0, 0]
    for part, q in _quadrants(a):
        counts[q] = max(counts[q], int(part.max(initial=0)).bit_length())
    text = "".join(w for part, q in _quadrants(a) for w in (_planes(part, counts[q]) if part.size else ())) + "0000"
    pack = lambda t: np.packbits(np.frombuffer(t.encode(), np.uint8) - 48).tobytes() if t else b""
    return MAGIC + struct.pack(">iiiq3B", *x.shape, level, total, *counts) + pack(text) + pack(signs)


def hcomp_decode(data: bytes, dtype: str = "i4") -> np.ndarray:
    data = bytes(data)
    if data[:2] != MAGIC or len(data) < 25:
        raise CodecError("not an H-compressed image")
    height, width, scale, total, *counts = struct.unpack_from(">iiiq3B", data, 2)
    if not 0 < height * width <= 1 << 31 or max(counts) > 62:
        raise CodecError("a damaged header")
    text = "".join(format(b, "08b") for b in data[25:])
    at = 0
    a = np.zeros((height, width), np.int64)

    def word() -> int:
        nonlocal at
        for n in (3, 4, 5, 6):
            c = READ.get(text[at : at + n])
            if c is not None:
                at += n
                return c
        raise CodecError("the data end early")

    for part, q in _quadrants(a):
        if not part.size:
            continue
        sizes = [((part.shape[0] + 1) // 2, (part.shape[1] + 1) // 2)]
        while sizes[-1] != (1, 1):
            sizes.append(((sizes[-1][0] + 1) // 2, (sizes[-1][1] + 1) // 2))
        for bit in range(counts[q] - 1, -1, -1):
            kind, at = text[at : at + 4], at + 4
            if kind == PLAIN:
                n = sizes[0][0] * sizes[0][1]
                if at + 4 * n > len(text):
                    raise CodecError("the data end early")
                codes = np.array([int(text[i : i + 4], 2) for i in range(at, at + 4 * n, 4)], np.int64).reshape(sizes[0])
                at += 4 * n
            elif kind == TREE:
                codes = np.array([[word()]], np.int64)
                for size in reversed(sizes[:-1]):
                    codes = _spread(codes, *size)
                    flat = codes.ravel()
                    for i in np.flatnonzero(flat)[::-1].tolist():
                        flat[i] = word()
                    codes = flat.reshape(size)
            else:
                raise CodecError("no bit plane")
            part |= _spread(codes, *part.shape) << bit
    if text[at : at + 4] != "0000":
        raise CodecError("no end of the planes")
    at = -(-(at + 4) // 8) * 8
    some = np.flatnonzero(a.ravel())
    signs = text[at : at + len(some)]
    if len(signs) < len(some):
        raise CodecError("signs are missing")
    flat = a.ravel()
    flat[some[np.frombuffer(signs.encode(), np.uint8) == 49] if len(some) else some] *= -1
    a = flat.reshape(height, width)
    a[0, 0] = total
    return _restored(a * max(scale, 1)).astype(dtype)
