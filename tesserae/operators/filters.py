"""Array filters as numpy kernels. Inputs are arrays, outputs arrays or bytes; nothing here knows Spark."""

from __future__ import annotations

import numpy as np


def _unsigned(x: np.ndarray) -> np.ndarray:
    return x if x.dtype.kind == "u" else x.view(f"u{x.dtype.itemsize}")


def delta_encode(x: np.ndarray, axis: int = -1, dist: int = 1) -> np.ndarray:
    """First differences with wrap-around; floats by their bit patterns."""
    if dist != 1:
        raise NotImplementedError("dist must be 1")
    u = _unsigned(np.ascontiguousarray(x))
    return np.diff(u, axis=axis, prepend=np.zeros_like(u.take([0], axis))).view(x.dtype) if u.size else x.copy()


def delta_decode(x: np.ndarray, axis: int = -1, dist: int = 1) -> np.ndarray:
    if dist != 1:
        raise NotImplementedError("dist must be 1")
    u = _unsigned(np.ascontiguousarray(x))
    return np.cumsum(u, axis=axis, dtype=u.dtype).view(x.dtype)


def xor_encode(x: np.ndarray, axis: int = -1) -> np.ndarray:
    u = np.moveaxis(_unsigned(np.ascontiguousarray(x)), axis, -1)
    out = u.copy()
    out[..., 1:] ^= u[..., :-1]
    return np.ascontiguousarray(np.moveaxis(out, -1, axis)).view(x.dtype)


def xor_decode(x: np.ndarray, axis: int = -1) -> np.ndarray:
    u = _unsigned(np.ascontiguousarray(x))
    return np.bitwise_xor.accumulate(u, axis=axis).view(x.dtype)


def bitorder(x):
    """Every byte with its bits reversed; bytes or an array."""
    raw = np.frombuffer(x, np.uint8) if isinstance(x, (bytes, bytearray)) else np.ascontiguousarray(x).view(np.uint8)
    out = np.packbits(np.unpackbits(raw), bitorder="little")
    return out.tobytes() if isinstance(x, (bytes, bytearray)) else out.view(x.dtype).reshape(x.shape)


def bitshuffle_encode(data: bytes, itemsize: int = 1, blocksize: int = 0) -> bytes:
    """Bit planes of blocks of elements, a multiple of 8 elements each; what is left over is copied."""
    block = blocksize or max(8, 8192 // itemsize // 8 * 8)
    raw, out = np.frombuffer(data, np.uint8), []
    n = len(raw) // itemsize
    at = 0
    while at < n // 8 * 8:
        m = min(block, (n - at) // 8 * 8)
        part = raw[at * itemsize : (at + m) * itemsize].reshape(m, itemsize)
        bits = np.unpackbits(part, axis=1, bitorder="little").T  # [bit of element, element]
        out.append(np.packbits(bits, axis=1, bitorder="little").tobytes())
        at += m
    return b"".join(out) + data[at * itemsize :]


def bitshuffle_decode(data: bytes, itemsize: int = 1, blocksize: int = 0) -> bytes:
    block = blocksize or max(8, 8192 // itemsize // 8 * 8)
    raw, out = np.frombuffer(data, np.uint8), []
    n = len(raw) // itemsize
    at = 0
    while at < n // 8 * 8:
        m = min(block, (n - at) // 8 * 8)
        planes = raw[at * itemsize : (at + m) * itemsize].reshape(itemsize * 8, m // 8)
        bits = np.unpackbits(planes, axis=1, bitorder="little").T
        out.append(np.packbits(bits, axis=1, bitorder="little").tobytes())
        at += m
    return b"".join(out) + data[at * itemsize :]


def byteshuffle_encode(x: np.ndarray, axis: int = -1, dist: int = 1, delta: bool = False, reorder: bool = False) -> np.ndarray:
    """Byte planes along the last axis; optionally big end first and then byte differences `dist` apart."""
    x = np.moveaxis(np.ascontiguousarray(x), axis, -1)
    size, n = x.dtype.itemsize, x.shape[-1]
    b = np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, size)
    if reorder and x.dtype.newbyteorder("=") == x.dtype and np.little_endian:
        b = b[..., ::-1]
    planes = np.ascontiguousarray(np.swapaxes(b, -1, -2)).reshape(*x.shape[:-1], n * size)
    if delta:
        planes = planes.copy()
        planes[..., dist:] -= planes[..., :-dist].copy()
    return np.ascontiguousarray(np.moveaxis(planes.view(x.dtype), -1, axis))


def byteshuffle_decode(x: np.ndarray, axis: int = -1, dist: int = 1, delta: bool = False, reorder: bool = False) -> np.ndarray:
    x = np.ascontiguousarray(np.moveaxis(x, axis, -1))
    size, n = x.dtype.itemsize, x.shape[-1]
    planes = x.view(np.uint8).reshape(*x.shape[:-1], n * size)
    if delta:
        planes = planes.copy()
        for k in range(dist):
            planes[..., k::dist] = np.cumsum(planes[..., k::dist], axis=-1, dtype=np.uint8)
    b = np.swapaxes(planes.reshape(*x.shape[:-1], size, n), -1, -2)
    if reorder and np.little_endian:
        b = b[..., ::-1]
    return np.ascontiguousarray(np.moveaxis(np.ascontiguousarray(b).view(x.dtype)[..., 0], -1, axis))


def floatpred_encode(x: np.ndarray, axis: int = -1, dist: int = 1) -> np.ndarray:
    """TIFF predictor 3."""
    return byteshuffle_encode(x, axis, dist, True, True)


def floatpred_decode(x: np.ndarray, axis: int = -1, dist: int = 1) -> np.ndarray:
    return byteshuffle_decode(x, axis, dist, True, True)


def packints_encode(x: np.ndarray, bitspersample: int, runlen: int = 0, bitorder: str | None = None) -> bytes:
    """Bits of unsigned integers: an MSB-first stream (None) whose runs of `runlen` end on a byte, GenICam's LSB-first one
    of 9 to 14 bits ("<"), or GigE's pairs of 10 or 12 bits in three bytes (">")."""
    _packing(bitspersample, runlen, bitorder)
    if bitorder == ">":
        if x.size % 2:
            raise ValueError("pairs take an even number of items")
        low = bitspersample - 8
        even, odd = x.ravel().astype(np.uint16).reshape(-1, 2).T
        mask = (1 << low) - 1
        return np.stack([even >> low, even & mask | (odd & mask) << 4, odd >> low], 1).astype(np.uint8).tobytes()
    if bitorder == "<":
        bits = np.unpackbits(x.ravel().astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :bitspersample]
        return np.packbits(bits.ravel(), bitorder="little").tobytes()
    rows = x.reshape(-1, runlen or max(x.size, 1)) if x.size else x.reshape(1, 0)
    width = x.dtype.itemsize * 8
    bits = np.unpackbits(rows.astype(x.dtype.newbyteorder(">")).view(np.uint8).reshape(*rows.shape, -1), axis=-1)[..., width - bitspersample :]
    return np.packbits(bits.reshape(len(rows), -1), axis=1).tobytes()


def _packing(bitspersample: int, runlen: int, bitorder: str | None) -> None:
    if bitorder not in (None, "<", ">"):
        raise ValueError(f"no bitorder {bitorder!r}")
    if bitorder and runlen:
        raise ValueError("runlen goes without bitorder")
    if bitorder == "<" and not 9 <= bitspersample <= 14 or bitorder == ">" and bitspersample not in (10, 12):
        raise ValueError(f"bitspersample {bitspersample} with bitorder {bitorder!r}")


def packints_decode(data: bytes, dtype: str = "u1", bitspersample: int = 8, runlen: int = 0, bitorder: str | None = None) -> np.ndarray:
    """Unpacks n-bit integers: an MSB-first stream (None), GenICam's LSB-first one ("<"), or GigE's pairs (">")."""
    _packing(bitspersample, runlen, bitorder)
    dtype = np.dtype(dtype)
    raw = np.frombuffer(data, np.uint8)
    if bitorder == ">":
        t = raw[: len(raw) // 3 * 3].reshape(-1, 3).astype(np.uint16)
        low = bitspersample - 8
        mask = (1 << low) - 1
        return np.stack([t[:, 0] << low | t[:, 1] & mask, t[:, 2] << low | t[:, 1] >> 4 & mask], 1).ravel().astype(dtype)
    bits = np.unpackbits(raw, bitorder="little" if bitorder == "<" else "big")
    per = runlen * bitspersample
    if runlen:
        row = -(-per // 8) * 8
        bits = bits[: len(bits) // row * row].reshape(-1, row)[:, :per].ravel()
    n = len(bits) // bitspersample
    cells = bits[: n * bitspersample].reshape(n, bitspersample)
    weights = np.left_shift(np.uint64(1), np.arange(bitspersample, dtype=np.uint64))
    weights = weights if bitorder == "<" else weights[::-1]
    return (cells.astype(np.uint64) * weights).sum(1, dtype=np.uint64).astype(dtype)


#: Rounding modes of the float encoders.
ROUNDING = ("tonearest", "upward", "downward", "towardzero")


def _narrow(u: np.ndarray, drop: int, rounding: str) -> np.ndarray:
    """Bit patterns without their `drop` lowest bits, rounded."""
    low = u & ((1 << drop) - 1)
    out = u >> drop
    top = u >> 31 & 1
    if rounding == "tonearest":
        half = 1 << (drop - 1)
        return out + ((low > half) | ((low == half) & (out & 1 == 1)))
    up = {"towardzero": np.zeros_like(low, bool), "upward": (low > 0) & (top == 0), "downward": (low > 0) & (top == 1)}[rounding]
    return out + up


def bfloat16_encode(x: np.ndarray, byteorder: str = "<", rounding: str = "tonearest") -> bytes:
    u = np.ascontiguousarray(x, np.float32).view(np.uint32).astype(np.int64)
    out = _narrow(u, 16, rounding)
    out = np.where(np.isnan(x), np.where(u >> 31, 0xFFC0, 0x7FC0), out)
    return out.astype(f"{byteorder}u2").tobytes()


def bfloat16_decode(data: bytes, byteorder: str = "<") -> np.ndarray:
    return (np.frombuffer(data, f"{byteorder}u2").astype(np.uint32) << 16).view(np.float32)


def float24_encode(x: np.ndarray, byteorder: str = "<", rounding: str = "tonearest") -> bytes:
    """1 sign, 7 exponent (bias 63) and 16 fraction bits."""
    flat = np.ascontiguousarray(x, np.float32).ravel()
    u = flat.view(np.uint32).astype(np.int64)
    sign, exponent, fraction = u >> 31, (u >> 23) & 0xFF, u & 0x7FFFFF
    e = exponent - 127 + 63
    whole = np.where(exponent > 0, fraction | 0x800000, fraction)
    shift = np.clip(np.where(e > 0, 7, 7 + 1 - e), 7, 40)
    low = whole & ((np.int64(1) << shift) - 1)
    out = whole >> shift
    half = np.int64(1) << (shift - 1)
    up = {"tonearest": (low > half) | ((low == half) & (out & 1 == 1)), "towardzero": np.zeros(len(u), bool), "upward": (low > 0) & (sign == 0), "downward": (low > 0) & (sign == 1)}[rounding]
    out = out + up
    bits = np.where(e > 0, (np.maximum(e, 1) - 1 << 16) + out, out)
    over = bits >= 0x7F0000
    most = np.where({"tonearest": np.ones(len(u), bool), "towardzero": np.zeros(len(u), bool), "upward": sign == 0, "downward": sign == 1}[rounding], 0x7F0000, 0x7EFFFF)
    bits = np.where(over, most, bits)
    bits = np.where(np.isinf(flat), 0x7F0000, np.where(np.isnan(flat), 0x7F8000, bits)) | sign << 23
    b = bits.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return (b if byteorder == "<" else b[:, ::-1]).tobytes()


def float24_decode(data: bytes, byteorder: str = "<") -> np.ndarray:
    b = np.frombuffer(data, np.uint8).reshape(-1, 3)
    b = b if byteorder == "<" else b[:, ::-1]
    u = b[:, 0].astype(np.int64) | b[:, 1].astype(np.int64) << 8 | b[:, 2].astype(np.int64) << 16
    sign, e, f = u >> 23, (u >> 16) & 0x7F, u & 0xFFFF
    value = np.where(e > 0, np.ldexp(1 + f / 65536, e - 63), np.ldexp(f / 65536, -62))
    value = np.where(e == 0x7F, np.where(f > 0, np.nan, np.inf), value)
    return np.where(sign == 1, -value, value).astype(np.float32)


def quantize_encode(x: np.ndarray, mode: str = "bitround", nsd: int = 3) -> np.ndarray:
    """Lossy rounding of floats: to `nsd` bits (bitround), to the bits that nsd decimal digits need (bitgroom, shaved
    and set in turn; granularbr, for each value's own magnitude), or to decimals behind the point (scale)."""
    kind, mantissa = (np.uint32, 23) if x.dtype.itemsize == 4 else (np.uint64, 52)
    if not 0 <= nsd < x.dtype.itemsize * 8:
        raise ValueError("nsd out of range")
    if mode == "scale":
        scale = 2.0 ** np.ceil(np.log2(10.0**nsd))
        return (np.rint(x * scale) / scale).astype(x.dtype)
    u = np.ascontiguousarray(x).view(kind)
    if mode == "bitround":
        keep = np.full(x.shape, nsd)
    elif mode == "bitgroom":
        keep = np.full(x.shape, int(np.ceil(nsd * np.log2(10))) + 1)
    elif mode == "granularbr":
        size = np.where(x == 0, 1, np.abs(x)).astype(np.float64)
        m, e = np.frexp(size)
        digits = np.floor(np.log10(size)) + 1
        keep = np.abs(np.floor((e - 1) * 1.0) - np.floor(np.log2(10) * (digits - nsd))).astype(int) + 1
        del m
    else:
        raise ValueError(mode)
    drop = np.clip(mantissa - keep, 0, mantissa).astype(kind)
    one = kind(1)
    mask = ~((one << drop) - one)
    if mode == "bitgroom":
        turn = np.arange(x.size).reshape(x.shape) % 2 == 1
        out = np.where(turn & (x != 0), u | ~mask, u & mask)
    else:
        half = np.where(drop > 0, one << np.maximum(drop, 1).astype(kind) - one, kind(0))
        odd = (u >> drop) & one
        out = np.where(drop > 0, (u + half - one + odd) & mask, u)
    return out.astype(kind).view(x.dtype)


def eer_decode(data: bytes, shape: tuple[int, int], skipbits: int, horzbits: int, vertbits: int, superres: int = 0, dtype: str = "u2") -> np.ndarray:
    """Electron events to counts: each code skips so many pixels; a full skip code holds no event."""
    height, width = shape
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").astype(np.int64)
    out = np.zeros((height << superres, width << superres), np.int64)
    at, place, full, total = 0, 0, (1 << skipbits) - 1, height * width
    read = lambda p, n: int((bits[p : p + n] << np.arange(n)).sum())
    while at + skipbits <= len(bits):
        skip = read(at, skipbits)
        at += skipbits
        place += skip
        if place >= total:
            break
        if skip == full:
            continue
        if at + horzbits + vertbits > len(bits):
            break
        sub = read(at, horzbits + vertbits)
        at += horzbits + vertbits
        y, x = divmod(place, width)
        if superres:
            h, v = sub & ((1 << horzbits) - 1), sub >> horzbits
            x = (x << superres) + ((h ^ (1 << horzbits - 1)) >> max(horzbits - superres, 0))
            y = (y << superres) + ((v ^ (1 << vertbits - 1)) >> max(vertbits - superres, 0))
        out[y, x] += 1
        place += 1
    return (out > 0) if dtype == "?" else out.astype(dtype)
