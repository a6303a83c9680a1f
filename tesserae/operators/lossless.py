"""Lossless JPEG (process 14), PLIO line lists and PixarLog."""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from functools import cache, lru_cache

import numpy as np

from tesserae.operators.compressors import CodecError

# ---- lossless JPEG ----


def _restored(d: np.ndarray, predictor: int, start: int) -> np.ndarray:
    """Samples from differences [rows, columns], modulo 2 ** 16. The first row is predicted from the left, the first
    column from above."""
    d = d.astype(np.int64)
    out = np.empty_like(d)
    out[0] = (start + np.cumsum(d[0])) & 0xFFFF
    first = (out[0, 0] + np.cumsum(np.r_[0, d[1:, 0]])) & 0xFFFF
    out[:, 0] = first
    for y in range(1, len(d)):
        up, diff, here = out[y - 1], d[y, 1:], out[y]
        b, c = up[1:], up[:-1]
        if predictor in (1, 4, 5):
            step = diff + (0 if predictor == 1 else b - c if predictor == 4 else (b - c) >> 1)
            here[1:] = (first[y] + np.cumsum(step)) & 0xFFFF
        elif predictor in (2, 3):
            here[1:] = ((b if predictor == 2 else c) + diff) & 0xFFFF
        else:
            left, made = int(first[y]), []
            for bb, cc, dd in zip(b.tolist(), c.tolist(), diff.tolist()):
                left = ((bb + (left - cc >> 1) if predictor == 6 else left + bb >> 1) + dd) & 0xFFFF
                made.append(left)
            here[1:] = made
    return out


@lru_cache(64)
def huffman_table(counts: bytes, symbols: bytes) -> tuple[list, int]:
    """(symbol, code length) for every value of the next bits, as many as the longest code word has, and that number."""
    longest = max((k for k in range(1, 17) if counts[k - 1]), default=1)
    table: list = [None] * (1 << longest)
    code, k = 0, 0
    for size in range(1, longest + 1):
        width = 1 << longest - size
        for _ in range(counts[size - 1]):
            at = code * width
            if at + width > len(table) or k >= len(symbols):
                raise CodecError("Huffman table overflows")
            table[at : at + width] = [(symbols[k], size)] * width
            code, k = code + 1, k + 1
        code <<= 1
    return table, longest


def _differences(scan: bytes, tables: list[tuple[list, int]], n: int) -> np.ndarray:
    """n differences, of the components in turn."""
    raw = np.frombuffer(scan.replace(b"\xff\x00", b"\xff") + bytes(8), np.uint8).astype(np.int64)
    words = (raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]).tolist()
    out = [0] * n
    at, turns, end = 0, len(tables), 8 * (len(words) - 5)
    for i in range(n):
        if at > end:
            raise CodecError("scan is too short")
        table, longest = tables[i % turns]
        found = table[words[at >> 3] >> 32 - longest - (at & 7) & (1 << longest) - 1]
        if found is None:
            raise CodecError("no such Huffman code")
        size, length = found
        at += length
        if not size:
            continue
        if size >= 16:
            out[i] = 32768
            continue
        if at > end:
            raise CodecError("scan is too short")
        v = words[at >> 3] >> 32 - size - (at & 7) & (1 << size) - 1
        out[i] = v if v >> size - 1 else v - (1 << size) + 1
        at += size
    return np.array(out, np.int64)


def scan_parts(data: bytes, i: int) -> tuple[list[bytes], int]:
    """The entropy-coded stretches between restart marks, and the place of the next other marker."""
    parts, start = [], i
    while True:
        i = data.find(b"\xff", i)
        if i < 0 or i + 1 >= len(data):
            parts.append(data[start:])
            return parts, len(data)
        mark = data[i + 1]
        if mark == 0 or mark == 0xFF:
            i += 1 + (mark == 0)
        elif 0xD0 <= mark <= 0xD7:
            parts.append(data[start:i])
            i = start = i + 2
        else:
            parts.append(data[start:i])
            return parts, i


def jpegsof3_decode(data: bytes) -> np.ndarray:
    """[rows, columns] or [rows, columns, components] of unsigned bytes, or of 16 bits above a precision of 8."""
    data = bytes(data)
    if data[:2] != b"\xff\xd8":
        raise CodecError("no start of image")
    i, tables, every, out, bits, order = 2, {}, 0, None, 0, []
    while i + 4 <= len(data):
        if data[i] != 0xFF:
            raise CodecError(f"no marker at byte {i}")
        mark = data[i + 1]
        if mark == 0xFF:
            i += 1
            continue
        if mark == 0xD9:
            break
        size = struct.unpack_from(">H", data, i + 2)[0]
        body = data[i + 4 : i + 2 + size]
        i += 2 + size
        if mark == 0xC4:
            k = 0
            while k + 17 <= len(body):
                counts = body[k + 1 : k + 17]
                tables[body[k]] = huffman_table(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif mark == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif mark == 0xC3:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if not (2 <= bits <= 16 and height and width and n):
                raise CodecError("frame header has no valid size")
            order = [body[6 + 3 * j] for j in range(n)]
            if any(body[7 + 3 * j] != 0x11 for j in range(n)) and n > 1:
                raise CodecError("subsampled components are not available")
            out = np.zeros((height, width, n), np.uint16)
        elif 0xC0 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise CodecError("not a lossless Huffman-coded JPEG")
        elif mark == 0xDA:
            if out is None:
                raise CodecError("a scan comes before its frame")
            n = body[0]
            own = [(order.index(body[1 + 2 * j]), tables.get(body[2 + 2 * j] >> 4)) for j in range(n)]
            predictor, shift = body[1 + 2 * n], body[3 + 2 * n] & 15
            if not 1 <= predictor <= 7 or any(t is None for _, t in own):
                raise CodecError("scan header has no valid predictor or tables")
            if every % width:
                raise CodecError("restart intervals of broken rows are not available")
            parts, i = scan_parts(data, i)
            step = every // width or height
            for part, y in zip(parts, range(0, height, step)):
                rows = min(step, height - y)
                d = _differences(part, [t for _, t in own], rows * width * n).reshape(rows, width, n)
                for j, (c, _) in enumerate(own):
                    out[y : y + rows, :, c] = _restored(d[:, :, j], predictor, 1 << bits - shift - 1) << shift
    if out is None:
        raise CodecError("no frame")
    if bits <= 8:
        out = out.astype(np.uint8)
    return out[:, :, 0] if out.shape[2] == 1 else out


def ljpeg_decode(data: bytes, linearize: np.ndarray | None = None) -> np.ndarray:
    """linearize, a table of 16-bit values, is applied to the samples."""
    out = jpegsof3_decode(data)
    if linearize is None:
        return out
    table = np.asarray(linearize)
    if table.ndim != 1 or table.dtype != np.uint16:
        raise ValueError("linearize is not a row of 16-bit values")
    if out.max() >= len(table):
        raise CodecError("a sample lies beyond the table")
    return table[out].astype(out.dtype)


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Lengths of at most 16 bits that leave the word of ones free."""
    while True:
        heap = [(n, s, (s,)) for s, n in [*counts.items(), (-1, 0)]]
        heapq.heapify(heap)
        lengths = dict.fromkeys([*counts, -1], 0)
        while len(heap) > 1:
            (n, s, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            for x in (*a, *b):
                lengths[x] += 1
            heapq.heappush(heap, (n + m, s, (*a, *b)))
        # the spare word must be a longest one: it is the rarest
        if max(lengths.values()) <= 16:
            del lengths[-1]
            return lengths
        counts = {s: n + 1 >> 1 for s, n in counts.items()}


def code_words(lengths: dict[int, int]) -> tuple[list[int], np.ndarray]:
    """The symbols in the order of their code words, and the words by symbol."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    words, code, last = np.zeros(256, np.int64), -1, 0
    for s in symbols:
        code = code + 1 << lengths[s] - last
        words[s], last = code, lengths[s]
    return symbols, words


def packed_words(value: np.ndarray, total: np.ndarray) -> bytes:
    """The lowest total bits of every value end to end, filled with ones; bytes of ones are stuffed."""
    ends = np.cumsum(total)
    which = np.repeat(np.arange(len(total)), total)
    bit = value[which] >> ends[which] - 1 - np.arange(ends[-1]) & 1
    pad = np.ones(-len(bit) % 8, np.int64)
    return np.packbits(np.r_[bit, pad].astype(np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def ljpeg_encode(x: np.ndarray, bitspersample: int | None = None, delinearize: np.ndarray | None = None) -> bytes:
    """One component, predicted from the left, with a Huffman table of its own."""
    if x.dtype not in (np.uint8, np.uint16) or x.ndim not in (2, 3) or x.ndim == 3 and x.shape[2] != 1 or not x.size or max(x.shape) > 0xFFFF:
        raise ValueError("invalid data shape or dtype")
    bits = x.dtype.itemsize * 8
    if bitspersample is not None and bits == 16:
        if not 8 <= bitspersample <= 16:
            raise ValueError("invalid bitspersample")
        bits = bitspersample
    v = x.reshape(x.shape[:2]).astype(np.int64)
    if delinearize is not None:
        table = np.asarray(delinearize)
        if table.ndim != 1 or table.dtype != np.uint16:
            raise ValueError("delinearize is not a row of 16-bit values")
        if v.max() >= len(table):
            raise CodecError("a sample lies beyond the table")
        v = table[v].astype(np.int64)
    if v.max() >> bits:
        raise CodecError("a sample has more bits than bitspersample")
    predicted = np.empty_like(v)
    predicted[:, 1:] = v[:, :-1]
    predicted[1:, 0] = v[:-1, 0]
    predicted[0, 0] = 1 << bits - 1
    d = ((v - predicted + 0x8000 & 0xFFFF) - 0x8000).ravel()
    size = np.frexp(np.abs(d).astype(float))[1].astype(np.int64)
    seen, n = np.unique(size, return_counts=True)
    lengths = code_lengths(dict(zip(seen.tolist(), n.tolist())))
    symbols, words = code_words(lengths)
    length = np.array([lengths.get(s, 0) for s in range(17)])[size]
    extra = np.where(size == 16, 0, size)
    tail = np.where(d < 0, d + (1 << extra) - 1, d) & (1 << extra) - 1
    total = length + extra
    value = words[size] << extra | tail
    scan = packed_words(value, total)
    counts = bytes(sum(k == i for k in lengths.values()) for i in range(1, 17))
    part = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    return (
        b"\xff\xd8"
        + part(0xC3, struct.pack(">BHHB", bits, *v.shape, 1) + b"\x00\x11\x00")
        + part(0xC4, b"\x00" + counts + bytes(symbols))
        + part(0xDA, b"\x01\x00\x00\x01\x00\x00")
        + scan
        + b"\xff\xd9"
    )


# ---- line lists ----

HEADER = 7
ZEROS, SET, UP, DOWN, RUN, LAST, UP_ONE, DOWN_ONE = range(8)
MOST = 4095


def plio_encode(x: np.ndarray) -> bytes:
    """A row of integers, negative ones as 0, as 16-bit instructions: 4 bits say what, 12 bits how much."""
    x = np.asarray(x).astype(np.int32)
    if x.ndim != 1:
        raise ValueError("data must be 1-dimensional")
    if not x.size:
        raise ValueError("invalid data size")
    x = np.maximum(x, 0)
    if x.max() >> 27:
        raise CodecError("a value has more than 27 bits")
    starts = np.r_[0, np.flatnonzero(np.diff(x)) + 1]
    out: list[int] = []
    put = lambda what, n: out.append(what << 12 | n)
    parts = lambda n: [MOST] * (n // MOST) + [n % MOST] * (n % MOST > 0)
    high, zeros = 1, 0
    for value, n in zip(x[starts].tolist(), np.diff(np.r_[starts, len(x)]).tolist()):
        if value == 0:
            zeros = n
            continue
        step, high = value - high, value
        if abs(step) > MOST:
            put(SET, value & MOST)
            out.append(value >> 12)
        elif step:
            if n == 1 and not zeros:
                put(UP_ONE if step > 0 else DOWN_ONE, abs(step))
                continue
            put(UP if step > 0 else DOWN, abs(step))
        gaps = parts(zeros)
        zeros = 0
        if n == 1 and gaps and gaps[-1] < MOST:
            for k in gaps[:-1]:
                put(ZEROS, k)
            put(LAST, gaps[-1] + 1)
            continue
        for k in gaps:
            put(ZEROS, k)
        for k in parts(n):
            put(RUN, k)
    for k in parts(zeros):
        put(ZEROS, k)
    size = HEADER + len(out)
    return np.array([0, HEADER, -100, size % 32768, size // 32768, 0, 0], "<i2").tobytes() + np.array(out, "<u2").tobytes()


def plio_decode(data: bytes, npix: int | None = None) -> np.ndarray:
    if len(data) < 2 * HEADER:
        raise ValueError("data too short")
    if npix is None:
        raise TypeError("npix is required")
    if npix <= 0:
        raise ValueError(f"invalid npix={npix}")
    words = np.frombuffer(data, "<i2", len(data) // 2).astype(np.int64).tolist()
    if words[2] > 0:
        # the older form: its length in the third word, its instructions right after
        size, i = words[2], 3
    else:
        size, i = words[3] + (words[4] << 15), words[1]
    if size > len(words):
        raise CodecError("data end before the list")
    out, at, high = np.zeros(npix, np.int32), 0, 1
    while i < size and at < npix:
        what, n = (words[i] & 0xFFFF) >> 12, words[i] & MOST
        i += 1
        if what == SET:
            if i >= size:
                raise CodecError("data end within an instruction")
            high = (words[i] << 12) + n
            i += 1
        elif what in (UP, DOWN, UP_ONE, DOWN_ONE):
            high += n if what in (UP, UP_ONE) else -n
            if what in (UP_ONE, DOWN_ONE):
                out[at] = high
                at += 1
        elif what in (ZEROS, RUN, LAST):
            if what == RUN:
                out[at : at + n] = high
            elif what == LAST and 0 < n <= npix - at:
                out[at + n - 1] = high
            at += n
        else:
            raise CodecError(f"no such instruction: {what}")
    return out


# ---- logarithmic samples ----


@cache
def _pixarlog() -> tuple[np.ndarray, dict[str, np.ndarray], float, float]:
    """Linear values of the 2,048 codes, the codes of linear samples by type, and the curve's two parameters.
    250 codes are linear; the others grow by a factor of exp(1 / 250), and code 1250 is 1."""
    linear, one, codes = 250, 1250, 2048
    c = 1 / linear
    b = math.exp(-c * one)
    step = b * c * math.e
    k = np.arange(codes)
    value = np.where(k < linear, k * step, b * np.exp(c * k))
    # a sample takes the code below the first geometric mean of neighbours that it does not pass
    means = value[:-1] * value[1:]
    code = lambda v: np.searchsorted(means, v * v, "left").astype(np.uint16)
    few = int(2 / step) + 1
    return value, {"u1": code(np.arange(256) / 255), "u2": code(np.arange(16384) / 16383), "f4": code(np.arange(few) * step)}, c, b


def pixarlog_encode(x: np.ndarray, level: int | None = None, deflate: bool = True) -> bytes:
    """11-bit codes, differences along rows in 16 bits, then zlib. The last of three dimensions holds the samples."""
    kind = x.dtype.str[1:]
    if kind not in ("u1", "u2", "f4") or x.ndim not in (2, 3):
        raise ValueError("invalid data shape or dtype")
    value, codes, c, b = _pixarlog()
    if kind == "u1":
        k = codes[kind][x]
    elif kind == "u2":
        k = codes[kind][x >> 2]
    else:
        v = np.nan_to_num(x.astype(np.float64), nan=0.0)
        scale = len(codes[kind]) // 2
        low = codes[kind][np.clip(v * scale, 0, len(codes[kind]) - 1).astype(np.int64)]
        high = np.log(np.clip(v, 2, 24.2) / b) / c + 0.5
        k = np.where(v < 2, low, np.where(v > 24.2, len(value) - 1, high.astype(np.int64))).astype(np.uint16)
    k = k.astype(np.int32)
    d = k.copy()
    d[:, 1:] -= k[:, :-1]
    raw = (d & 0x7FF).astype("<u2").tobytes()
    return zlib.compress(raw, 6 if level is None else min(max(level, 0), 9)) if deflate else raw


def pixarlog_decode(data: bytes, shape: tuple = (), dtype: str = "u1", deflate: bool = True) -> np.ndarray:
    kind = np.dtype(dtype).str[1:]
    if kind not in ("u1", "u2", "f4") or len(shape) not in (2, 3):
        raise ValueError("invalid data shape or dtype")
    raw = np.frombuffer(zlib.decompress(data) if deflate else data, "<u2")
    if raw.size != math.prod(shape):
        raise CodecError("data do not fill the shape")
    k = np.cumsum(raw.reshape(shape).astype(np.int64), axis=1) & 0x7FF
    value = _pixarlog()[0]
    if kind == "f4":
        return value[k].astype(np.float32)
    most = 255 if kind == "u1" else 65535
    return np.minimum(value * most + 0.5, most).astype(kind)[k]
