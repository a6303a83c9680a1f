"""Blosc buffers, of the first format and chunks of the second: blocks, shuffled and compressed one by one."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

from tesserae.operators.compressors import CodecError
from tesserae.operators.filters import bitshuffle_decode, bitshuffle_encode

# Shuffles, compressors by the number of their format, flags and limits of the format.
SHUFFLES = {"noshuffle": 0, "shuffle": 1, "bitshuffle": 2}
FORMATS = {"blosclz": 0, "lz4": 1, "lz4hc": 1, "snappy": 2, "zlib": 3, "zstd": 4}
BYTES, COPIED, BITS, WHOLE = 1, 2, 4, 16
MOST_SPLITS, LEAST_SPLIT = 16, 128
BLOCK = 1 << 18


def _pack(name: str, data: bytes, level: int) -> bytes:
    if name == "zlib":
        return zlib.compress(data, min(level, 9))
    if name == "zstd":
        return bytes(pa.Codec("zstd", compression_level=max(1, 2 * level - 1)).compress(data))
    return bytes(pa.Codec({"lz4": "lz4_raw", "lz4hc": "lz4_raw", "snappy": "snappy"}[name]).compress(data))


def _unpack(code: int, data: bytes, size: int) -> bytes:
    if code == 0:
        return _blosclz(data, size)
    if code == 3:
        return zlib.decompress(data)
    return bytes(pa.Codec({1: "lz4_raw", 2: "snappy", 4: "zstd"}[code]).decompress(data, size))


def _blosclz(data: bytes, size: int) -> bytes:
    """Literals and matches of three bytes or more; distances from 8191 on take two bytes of their own."""
    out, at = bytearray(), 1
    control = data[0] & 31
    while True:
        if control < 32:
            out += data[at : at + control + 1]
            at += control + 1
        else:
            length, far = (control >> 5) - 1, (control & 31) << 8
            if length == 6:
                while True:
                    length += data[at]
                    at += 1
                    if data[at - 1] != 255:
                        break
            near = data[at]
            at += 1
            distance = far + near + 1
            if near == 255 and far == 31 << 8:
                distance = (data[at] << 8 | data[at + 1]) + 8192
                at += 2
            if distance > len(out):
                raise CodecError("a match before the start")
            for _ in range(length + 3):
                out.append(out[-distance])
        if at >= len(data):
            break
        control = data[at]
        at += 1
    if len(out) != size:
        raise CodecError("a block of another size")
    return bytes(out)


def _shuffled(data: bytes, size: int) -> bytes:
    n = len(data) // size
    return np.frombuffer(data, np.uint8, n * size).reshape(n, size).T.tobytes() + data[n * size :]


def _ordered(data: bytes, size: int) -> bytes:
    n = len(data) // size
    return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.tobytes() + data[n * size :]


def _bits(data: bytes, size: int, turn) -> bytes:
    """Bit planes of a block whose elements come in eights; others are left as they are."""
    n = len(data) // size
    return turn(data[: n * size], size, n) + data[n * size :] if n and n % 8 == 0 else data


def blosc_encode(data: bytes, level: int = 9, compressor: str = "lz4", shuffle: str = "shuffle", typesize: int = 1, blocksize: int = 0) -> bytes:
    """Every block is one stream (none is split); what does not get smaller is stored. blosclz is only read."""
    if compressor not in FORMATS or compressor == "blosclz":
        raise NotImplementedError(f"compressor {compressor!r}")
    if not 1 <= typesize <= 255 or not 0 <= level <= 9:
        raise ValueError("typesize or level out of range")
    data = bytes(data)
    kind = SHUFFLES[shuffle]
    block = min(max(blocksize or BLOCK, typesize) // typesize * typesize, max(len(data), 1))
    flags = WHOLE | FORMATS[compressor] << 5 | (BYTES if kind == 1 else BITS if kind == 2 else 0)
    head = lambda flags, size: struct.pack("<BBBBIII", 2, 1, flags, typesize, len(data), block, size)
    parts = []
    for a in range(0, len(data), block) if level else ():
        raw = data[a : a + block]
        raw = _shuffled(raw, typesize) if kind == 1 and typesize > 1 else _bits(raw, typesize, bitshuffle_encode) if kind == 2 else raw
        made = _pack(compressor, raw, level)
        made = made if len(made) < len(raw) else raw
        parts.append(struct.pack("<I", len(made)) + made)
    starts = 16 + 4 * len(parts) + np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)
    if not parts or starts[-1] >= 16 + len(data):
        return head(flags | COPIED, 16 + len(data)) + data
    return head(flags, int(starts[-1])) + starts[:-1].astype("<u4").tobytes() + b"".join(parts)


def blosc_decode(data: bytes) -> bytes:
    data = bytes(data)
    if len(data) < 16:
        raise CodecError("no header")
    _, _, flags, size, total, block, coded = struct.unpack_from("<BBBBIII", data)
    if coded > len(data) or total and not block:
        raise CodecError("a damaged header")
    if flags & COPIED:
        return data[16 : 16 + total]
    out = []
    n = -(-total // block) if total else 0
    for i, at in enumerate(struct.unpack_from(f"<{n}I", data, 16)):
        length = min(block, total - i * block)
        split = not flags & WHOLE and size <= MOST_SPLITS and block // size >= LEAST_SPLIT and length == block
        streams = size if split else 1
        parts = []
        for _ in range(streams):
            (packed,) = struct.unpack_from("<I", data, at)
            raw = data[at + 4 : at + 4 + packed]
            parts.append(raw if packed == length // streams else _unpack(flags >> 5, raw, length // streams))
            at += 4 + packed
        raw = b"".join(parts)
        out.append(_ordered(raw, size) if flags & BYTES and size > 1 else _bits(raw, size, bitshuffle_decode) if flags & BITS else raw)
    return b"".join(out)


# ---- the second format: 32 bytes of header, with a row of filters ----

#: The version written, the flags that tell the long header, filters by their numbers, and what a chunk
#: without data may stand for (all zeros, not-a-numbers, one value).
SECOND, LONG = 5, BYTES | BITS
FILTERS = {"nofilter": 0, "noshuffle": 0, "shuffle": 1, "bitshuffle": 2, "delta": 3}
ZEROS, NANS, VALUE, NOTHING = 1, 2, 3, 4


def blosc2_encode(data: bytes, level: int = 5, compressor: str = "zstd", shuffle: str = "shuffle", typesize: int = 1, blocksize: int = 0) -> bytes:
    """As blosc_encode; all zeros take no room but the header."""
    if compressor not in FORMATS or compressor == "blosclz":
        raise NotImplementedError(f"compressor {compressor!r}")
    if not 1 <= typesize <= 255 or not 0 <= level <= 9:
        raise ValueError("typesize or level out of range")
    data, kind = bytes(data), FILTERS[shuffle]
    if kind > 2:
        raise NotImplementedError(f"filter {shuffle!r}")
    block = min(max(blocksize or BLOCK, typesize) // typesize * typesize, max(len(data), 1))
    flags = LONG | WHOLE | FORMATS[compressor] << 5

    def head(flags: int, size: int, special: int = 0) -> bytes:
        return struct.pack("<BBBBIII", SECOND, 1, flags, typesize, len(data), block, size) + bytes((0, 0, 0, 0, 0, kind)) + bytes(9) + bytes((special << 4,))

    if data and not data.strip(b"\0"):
        return head(flags, 32, ZEROS)
    parts = []
    for a in range(0, len(data), block) if level else ():
        raw = data[a : a + block]
        raw = _shuffled(raw, typesize) if kind == 1 and typesize > 1 else _bits(raw, typesize, bitshuffle_encode) if kind == 2 else raw
        made = _pack(compressor, raw, level)
        made = b"" if not raw.strip(b"\0") else made if len(made) < len(raw) else raw  # a stream of zeros has no bytes
        parts.append(struct.pack("<I", len(made)) + made)
    starts = 32 + 4 * len(parts) + np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int64)
    if not parts or starts[-1] >= 32 + len(data):
        return head(flags | COPIED, 32 + len(data)) + data
    return head(flags, int(starts[-1])) + starts[:-1].astype("<u4").tobytes() + b"".join(parts)


def blosc2_decode(data: bytes) -> bytes:
    """Chunks of either format."""
    data = bytes(data)
    if len(data) < 16:
        raise CodecError("no header")
    _, _, flags, size, total, block, coded = struct.unpack_from("<BBBBIII", data)
    if flags & LONG != LONG:
        return blosc_decode(data)
    if len(data) < 32 or coded > len(data) or total and not block:
        raise CodecError("a damaged header")
    special = data[31] >> 4 & 7
    if special in (ZEROS, NOTHING):
        return bytes(total)
    if special == NANS:
        return np.full(total // size, np.nan, f"<f{size}").tobytes()
    if special == VALUE:
        return data[32 : 32 + size] * (total // size)
    if flags & COPIED:
        return data[32 : 32 + total]
    filters = [f for f in data[16:22] if f]
    if any(f > 2 for f in filters):
        raise NotImplementedError("filters beside shuffles")
    out = []
    for i, at in enumerate(struct.unpack_from(f"<{-(-total // block)}I", data, 32)):
        length = min(block, total - i * block)
        streams = size if not flags & WHOLE and size <= MOST_SPLITS and block // size >= LEAST_SPLIT and length == block else 1
        parts = []
        for _ in range(streams):
            (packed,) = struct.unpack_from("<i", data, at)
            at += 4
            if packed == 0:  # zeros
                parts.append(bytes(length // streams))
                continue
            if packed < 0:  # a byte that repeats, and a token in front of it
                if packed < -255:
                    raise CodecError("a run of another kind")
                parts.append(bytes((-packed,)) * (length // streams))
                at += 1
                continue
            raw = data[at : at + packed]
            parts.append(raw if packed == length // streams else _unpack(flags >> 5, raw, length // streams))
            at += packed
        raw = b"".join(parts)
        for f in reversed(filters):
            raw = _ordered(raw, size) if f == 1 and size > 1 else _bits(raw, size, bitshuffle_decode) if f == 2 else raw
        out.append(raw)
    return b"".join(out)
