"""Lossless WebP images (VP8L): all of decoding; encoding by prefix codes of the pixels less their green."""

from __future__ import annotations

import heapq
import struct

import numpy as np

from tesserae.operators.compressors import CodecError

# Fixed values of the format: the order of the lengths of length codes, and the near places (across, down) that short
# distances stand for.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    "0,1 1,0 1,1 -1,1 0,2 2,0 1,2 -1,2 2,1 -2,1 2,2 -2,2 0,3 3,0 1,3 -1,3 3,1 -3,1 2,3 -2,3 3,2 -3,2 0,4 4,0 1,4 -1,4 4,1 -4,1 3,3 -3,3 2,4 -2,4 4,2 -4,2 0,5 3,4 -3,4 4,3 -4,3 5,0 "
    "1,5 -1,5 5,1 -5,1 2,5 -2,5 5,2 -5,2 4,4 -4,4 3,5 -3,5 5,3 -5,3 0,6 6,0 1,6 -1,6 6,1 -6,1 2,6 -2,6 6,2 -6,2 4,5 -4,5 5,4 -5,4 3,6 -3,6 6,3 -6,3 0,7 7,0 1,7 -1,7 5,5 -5,5 7,1 -7,1 4,6 -4,6 "
    "6,4 -6,4 2,7 -2,7 7,2 -7,2 3,7 -3,7 7,3 -7,3 5,6 -5,6 6,5 -6,5 8,0 4,7 -4,7 7,4 -7,4 8,1 8,2 6,6 -6,6 8,3 5,7 -5,7 7,5 -7,5 8,4 6,7 -6,7 7,6 -7,6 8,5 7,7 -7,7 8,6 8,7"
)
PLACES = [tuple(map(int, p.split(","))) for p in NEAR.split()]
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
HASH = 0x1E35A7BD


class Bits:
    """Bits of bytes, the lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.held, self.n = 0, 0

    def read(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.data):
                raise CodecError("the data end early")
            self.held |= self.data[self.at] << self.n
            self.at += 1
            self.n += 8
        out = self.held & (1 << n) - 1
        self.held >>= n
        self.n -= n
        return out


class Code:
    """A prefix code from the lengths of its symbols."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.only = used[0][1] if len(used) == 1 else None
        self.table: dict[tuple[int, int], int] = {}
        if not used:
            self.only = 0
        if self.only is None:
            code, last = 0, 0
            for n, s in sorted(used):
                code <<= n - last
                last = n
                self.table[n, code] = s
                code += 1
            if code != 1 << last:
                raise CodecError("a prefix code with gaps")

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        code = 0
        for n in range(1, 16):
            code = code << 1 | bits.read(1)
            s = self.table.get((n, code))
            if s is not None:
                return s
        raise CodecError("no symbol")


def _code(bits: Bits, symbols: int) -> Code:
    lengths = [0] * symbols
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = [0] * 19
    for i in range(4 + bits.read(4)):
        own[ORDER[i]] = bits.read(3)
    coder = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else symbols
    at, before = 0, 8
    while at < symbols and left:
        left -= 1
        s = coder.read(bits)
        if s < 16:
            lengths[at] = s
            at += 1
            before = s or before
        else:
            n = 3 + bits.read(2) if s == 16 else 3 + bits.read(3) if s == 17 else 11 + bits.read(7)
            if at + n > symbols:
                raise CodecError("lengths of too many symbols")
            lengths[at : at + n] = [before if s == 16 else 0] * n
            at += n
    return Code(lengths)


def _number(bits: Bits, s: int) -> int:
    if s < 4:
        return s + 1
    extra = s - 2 >> 1
    return ((2 + (s & 1)) << extra) + bits.read(extra) + 1


def _pixels(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """An image of ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, block, across = None, 0, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = (width + (1 << block) - 1) >> block
        groups = [p >> 8 & 0xFFFF for p in _pixels(bits, across, (height + (1 << block) - 1) >> block, False)]
    codes = [[_code(bits, n) for n in (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)] for _ in range(max(groups) + 1 if groups else 1)]
    cache = [0] * (1 << cache_bits) if cache_bits else []
    out: list[int] = []
    total = width * height

    def put(p: int) -> None:
        out.append(p)
        if cache_bits:
            cache[(p * HASH & 0xFFFFFFFF) >> 32 - cache_bits] = p

    while len(out) < total:
        y, x = divmod(len(out), width)
        own = codes[groups[(y >> block) * across + (x >> block)] if groups else 0]
        s = own[0].read(bits)
        if s < LITERALS:
            red, blue, alpha = (own[k].read(bits) for k in (1, 2, 3))
            put(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < LITERALS + LENGTHS:
            n = _number(bits, s - LITERALS)
            far = _number(bits, own[4].read(bits))
            if far > len(PLACES):
                far -= len(PLACES)
            else:
                dx, dy = PLACES[far - 1]
                far = max(1, dx + dy * width)
            if far > len(out) or len(out) + n > total:
                raise CodecError("a copy from outside")
            for _ in range(n):
                put(out[-far])
        else:
            put(cache[s - LITERALS - LENGTHS])
    return out


def _split(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(a: int, r: int, g: int, b: int) -> int:
    return (a & 255) << 24 | (r & 255) << 16 | (g & 255) << 8 | b & 255


def _mean(p: int, q: int) -> int:
    return _join(*((x + y) // 2 for x, y in zip(_split(p), _split(q), strict=True)))


def _select(left: int, top: int, corner: int) -> int:
    a, b, c = _split(left), _split(top), _split(corner)
    to_left = sum(abs(y - z) for y, z in zip(b, c, strict=True))
    to_top = sum(abs(x - z) for x, z in zip(a, c, strict=True))
    return left if to_left < to_top else top


def _clamped(values) -> int:
    return _join(*(min(255, max(0, v)) for v in values))


def _predicted(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """What the neighbours say of a pixel; right is the top right one, corner the top left."""
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode < 11:
        return {5: lambda: _mean(_mean(left, right), top), 6: lambda: _mean(left, corner), 7: lambda: _mean(left, top), 8: lambda: _mean(corner, top), 9: lambda: _mean(top, right), 10: lambda: _mean(_mean(left, corner), _mean(top, right))}[mode]()
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _clamped(x + y - z for x, y, z in zip(_split(left), _split(top), _split(corner), strict=True))
    return _clamped(x + int((x - z) / 2) for x, z in zip(_split(_mean(left, top)), _split(corner), strict=True))


def _plus(p: int, q: int) -> int:
    return _join(*(x + y for x, y in zip(_split(p), _split(q), strict=True)))


def _signed(v: int) -> int:
    return v - 256 if v > 127 else v


def _undo(kind: int, side, pixels: list[int], width: int, height: int) -> list[int]:
    if kind == 2:
        return [_join(a, r + g, g, b + g) for a, r, g, b in map(_split, pixels)]
    if kind == 1:
        bits, across, table = side
        out = []
        for i, p in enumerate(pixels):
            y, x = divmod(i, width)
            _, red_blue, green_blue, green_red = _split(table[(y >> bits) * across + (x >> bits)])
            a, r, g, b = _split(p)
            r = r + (_signed(green_red) * _signed(g) >> 5) & 255
            b = b + (_signed(green_blue) * _signed(g) >> 5) + (_signed(red_blue) * _signed(r) >> 5)
            out.append(_join(a, r, g, b))
        return out
    if kind == 0:
        bits, across, table = side
        out = []
        for i, p in enumerate(pixels):
            y, x = divmod(i, width)
            if i == 0:
                guess = 0xFF000000
            elif y == 0:
                guess = out[-1]
            elif x == 0:
                guess = out[i - width]
            else:
                guess = _predicted(table[(y >> bits) * across + (x >> bits)] >> 8 & 15, out[-1], out[i - width], out[i - width + 1], out[i - width - 1])
            out.append(_plus(p, guess))
        return out
    table, per = side  # colours by number, `per` to a pixel
    packed = -(-width // per)
    step = 8 // per
    out = []
    for y in range(height):
        for x in range(width):
            index = pixels[y * packed + x // per] >> 8 & 255
            index = index >> step * (x % per) & (1 << step) - 1
            out.append(table[index] if index < len(table) else 0)
    return out


def _payload(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise CodecError("not a WebP image")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"VP8L":
            return data[at + 8 : at + 8 + size]
        if name in (b"VP8 ", b"ANMF"):
            raise NotImplementedError("only still lossless images are decoded")
        at += 8 + size + size % 2
    raise CodecError("no image")


def webp_decode(data: bytes, index: int | None = None, hasalpha: bool | None = None) -> np.ndarray:
    """Rows of RGB, or of RGBA where the image says that it has alpha, or hasalpha does."""
    if index:
        raise IndexError("a still image")
    bits = Bits(_payload(bytes(data)))
    if bits.read(8) != 0x2F:
        raise CodecError("no lossless image")
    width, height, alpha, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise CodecError("another version")
    steps, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (0, 1):
            block = bits.read(3) + 2
            across = (now + (1 << block) - 1) >> block
            steps.append((kind, (block, across, _pixels(bits, across, (height + (1 << block) - 1) >> block, False)), now))
        elif kind == 2:
            steps.append((kind, None, now))
        else:
            n = bits.read(8) + 1
            table, before = [], 0
            for p in _pixels(bits, n, 1, False):
                before = _plus(p, before)
                table.append(before)
            per = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1
            steps.append((kind, (table, per), now))
            now = -(-now // per)
    pixels = _pixels(bits, now, height, True)
    for kind, side, now in reversed(steps):
        pixels = _undo(kind, side, pixels, now, height)
    argb = np.array(pixels, np.uint32).reshape(height, width)
    rgba = np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255, argb >> 24], -1).astype(np.uint8)
    return rgba if (alpha if hasalpha is None else hasalpha) else np.ascontiguousarray(rgba[..., :3])


# ---- encoding ----


def _lengths(counts: np.ndarray, most: int) -> list[int]:
    """Lengths of a prefix code by Huffman, of at most so many bits: counts are made evener until it fits."""
    used = np.flatnonzero(counts)
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
    weights = counts.astype(np.int64)
    while len(used) > 1:
        heap = [(int(weights[s]), int(s), (int(s),)) for s in used]
        heapq.heapify(heap)
        depth = dict.fromkeys(map(int, used), 0)
        while len(heap) > 1:
            (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                depth[s] += 1
            heapq.heappush(heap, (a + b, min(i, j), x + y))
        if max(depth.values()) <= most:
            for s, n in depth.items():
                out[s] = n
            return out
        weights = np.where(weights > 0, weights // 2 + 1, 0)
    return out


def _words(lengths: list[int]) -> list[tuple[int, int]]:
    """The bits of every symbol, the first of them lowest, and their number; none for a code of one symbol."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    out = [(0, 0)] * len(lengths)
    code, last = 0, 0
    for n, s in used if len(used) > 1 else ():
        code <<= n - last
        last = n
        out[s] = int(format(code, f"0{n}b")[::-1], 2), n
        code += 1
    return out


class _Writer:
    def __init__(self):
        self.parts: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append((value, n))

    def done(self) -> bytes:
        text = "".join(format(v, f"0{n}b")[::-1] for v, n in self.parts)
        text += "0" * (-len(text) % 8)
        return np.packbits(np.frombuffer(text.encode(), np.uint8) - 48, bitorder="little").tobytes()

    def code(self, counts: np.ndarray) -> list[tuple[int, int]]:
        used = np.flatnonzero(counts)
        if len(used) <= 1:
            s = int(used[0]) if len(used) else 0
            if s < 256:
                self.put(1, 1)
                self.put(0, 1)
                self.put(1, 1)
                self.put(s, 8)
                return [(0, 0)] * len(counts)
        lengths = _lengths(counts, 15)
        runs: list[tuple[int, int, int]] = []  # symbol, extra bits and their number
        at = 0
        while at < len(lengths):
            n = 1
            while at + n < len(lengths) and lengths[at + n] == lengths[at] == 0 and n < 138:
                n += 1
            if lengths[at] == 0 and n >= 3:
                runs.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            else:
                n = 1
                runs.append((lengths[at], 0, 0))
            at += n
        own = _lengths(np.bincount([s for s, _, _ in runs], minlength=19), 7)
        last = max(i for i, s in enumerate(ORDER) if own[s])
        self.put(0, 1)
        self.put(max(last - 3, 0), 4)
        for s in ORDER[: max(last + 1, 4)]:
            self.put(own[s], 3)
        self.put(0, 1)
        words = _words(own)
        for s, extra, n in runs:
            self.put(*words[s])
            self.put(extra, n)
        return _words(lengths)


def webp_encode(x: np.ndarray, level: int | None = None, lossless: bool | None = None) -> bytes:
    """RGB or RGBA rows of bytes, or gray ones, without loss."""
    if lossless is False or level is not None and lossless is None:
        raise NotImplementedError("only lossless images are written")
    x = np.asarray(x)
    x = np.repeat(x[..., None], 3, -1) if x.ndim == 2 else x
    if x.dtype != np.uint8 or x.ndim != 3 or x.shape[-1] not in (3, 4) or not 0 < x.shape[0] <= 16384 or not 0 < x.shape[1] <= 16384:
        raise ValueError("rows of up to 16,384 RGB or RGBA pixels of bytes")
    height, width, n = x.shape
    flat = x.reshape(-1, n)
    green = flat[:, 1]
    planes = [green, flat[:, 0] - green, flat[:, 2] - green, flat[:, 3] if n == 4 else np.full(len(flat), 255, np.uint8)]
    out = _Writer()
    for value, size in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (n == 4, 1), (0, 3), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1)):
        out.put(int(value), size)
    codes = [out.code(np.bincount(p, minlength=256 + (LENGTHS if k == 0 else 0))) for k, p in enumerate(planes)]
    out.code(np.zeros(DISTANCES, np.int64))
    columns = [[words[v] for v in p.tolist()] for words, p in zip(codes, planes, strict=True)]
    for pixel in zip(*columns, strict=True):
        out.parts += [w for w in pixel if w[1]]
    body = out.done()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
