"""Compressors and checksums as plain functions of bytes; nothing here knows Spark."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa


class CodecError(ValueError):
    pass


# ---- libraries of the platform ----


def zlib_encode(data: bytes, level: int = 6) -> bytes:
    return zlib.compress(data, min(level, 9))


def zlib_decode(data: bytes) -> bytes:
    return zlib.decompress(data)


def deflate_encode(data: bytes, level: int = 6, raw: bool = False) -> bytes:
    c = zlib.compressobj(min(level, 9), zlib.DEFLATED, -15 if raw else 15)
    return c.compress(data) + c.flush()


def deflate_decode(data: bytes, raw: bool = False) -> bytes:
    return zlib.decompress(data, -15 if raw else 15)


def gzip_encode(data: bytes, level: int = 6) -> bytes:
    return gzip.compress(data, min(level, 9), mtime=0)


def gzip_decode(data: bytes) -> bytes:
    return gzip.decompress(data)


def zopfli_encode(data: bytes, format: str = "zlib") -> bytes:
    """The container asked for, at the highest level of zlib."""
    return {"zlib": zlib_encode, "gzip": gzip_encode, "deflate": lambda d, n: deflate_encode(d, n, True)}[format](data, 9)


def bz2_encode(data: bytes, level: int = 9) -> bytes:
    return bz2.compress(data, level)


def bz2_decode(data: bytes) -> bytes:
    return bz2.decompress(data)


def lzma_encode(data: bytes, level: int = 6, check: int = -1) -> bytes:
    return lzma.compress(data, check=check, preset=level)


def lzma_decode(data: bytes) -> bytes:
    return lzma.decompress(data)


def _stream(name: str, data: bytes) -> bytes:
    return pa.CompressedInputStream(pa.BufferReader(data), name).read()


def zstd_encode(data: bytes, level: int = 3) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def zstd_decode(data: bytes) -> bytes:
    return _stream("zstd", data)


def brotli_encode(data: bytes, level: int = 4) -> bytes:
    return pa.Codec("brotli", compression_level=level).compress(data, asbytes=True)


def brotli_decode(data: bytes) -> bytes:
    return _stream("brotli", data)


def lz4f_encode(data: bytes, level: int | None = None) -> bytes:
    return pa.Codec("lz4").compress(data, asbytes=True)


def lz4f_decode(data: bytes) -> bytes:
    return _stream("lz4", data)


def snappy_encode(data: bytes) -> bytes:
    return pa.Codec("snappy").compress(data, asbytes=True)


def snappy_decode(data: bytes) -> bytes:
    size = shift = 0
    for b in data[:5]:  # the length, seven bits a byte
        size |= (b & 127) << shift
        shift += 7
        if b < 128:
            return pa.Codec("snappy").decompress(data, decompressed_size=size, asbytes=True)
    raise CodecError("no length")


def _lz4_raw(data: bytes) -> bytes:
    return pa.Codec("lz4_raw").compress(data, asbytes=True)


def _unlz4(data: bytes, size: int) -> bytes:
    return pa.Codec("lz4_raw").decompress(data, decompressed_size=size, asbytes=True) if size else b""


def lz4_encode(data: bytes, level: int | None = None, hc: bool = False, header: bool = False) -> bytes:
    return (struct.pack("<I", len(data)) if header else b"") + _lz4_raw(data)


def lz4_decode(data: bytes, header: bool = False, out_size: int | None = None) -> bytes:
    if header:
        return _unlz4(data[4:], struct.unpack_from("<I", data)[0])
    if out_size is not None:
        return _unlz4(data, out_size)
    return lz_blocks(data)


def lz_blocks(data: bytes) -> bytes:
    """An LZ4 block whose size is unknown, sequence by sequence."""
    out, i, n = bytearray(), 0, len(data)

    def more(value: int) -> int:
        nonlocal i
        if value == 15:
            while True:
                b = data[i]
                i += 1
                value += b
                if b < 255:
                    break
        return value

    while i < n:
        token = data[i]
        i += 1
        literals = more(token >> 4)
        out += data[i : i + literals]
        i += literals
        if i >= n:
            break
        back = data[i] | data[i + 1] << 8
        i += 2
        _copy(out, back, more(token & 15) + 4)
    return bytes(out)


def _copy(out: bytearray, back: int, n: int) -> None:
    start = len(out) - back
    if back <= 0 or start < 0:
        raise CodecError("distance beyond the output")
    if back >= n:
        out += out[start : start + n]
    else:
        out += (bytes(out[start:]) * (n // back + 1))[:n]


def lz4h5_encode(data: bytes, level: int | None = None, blocksize: int | None = None) -> bytes:
    size = blocksize or max(min(len(data), 1 << 30), 1)
    out = [struct.pack(">QI", len(data), size)]
    for k in range(0, len(data), size):
        part = data[k : k + size]
        packed = _lz4_raw(part)
        packed = packed if len(packed) < len(part) else part
        out += [struct.pack(">I", len(packed)), packed]
    return b"".join(out)


def lz4h5_decode(data: bytes) -> bytes:
    if len(data) < 12:
        raise CodecError("header missing")
    total, size = struct.unpack_from(">QI", data)
    out, at = bytearray(), 12
    while len(out) < total:
        n = struct.unpack_from(">I", data, at)[0]
        want = min(size, total - len(out))
        part = data[at + 4 : at + 4 + n]
        out += part if n == want else _unlz4(part, want)
        at += 4 + n
    return bytes(out)


# ---- own kernels ----


def packbits_encode(data: bytes, axis: int | None = None, width: int = 0) -> bytes:
    """Byte runs: n + 1 literals (0..127), or 257 - n copies. width > 0 starts anew on every row."""
    if width:
        return b"".join(packbits_encode(data[k : k + width]) for k in range(0, len(data), width))
    out, i, n = bytearray(), 0, len(data)
    x = np.frombuffer(data, np.uint8)
    edge = np.r_[np.flatnonzero(x[1:] != x[:-1]) + 1, n].tolist() if n else []
    begin, literal = 0, bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for e in edge:
        run = e - begin
        if run >= 3 or run == 2 and not literal:
            flush()
            while run > 1:
                m = min(run, 128)
                out.extend((257 - m, data[begin]))
                run -= m
            if run:
                literal.append(data[begin])
        else:
            literal.extend(data[begin:e])
        begin = e
    flush()
    del i
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i + 1 < n:
        b = data[i]
        i += 1
        if b < 128:
            out += data[i : i + b + 1]
            i += b + 1
        elif b > 128:
            out += data[i : i + 1] * (257 - b)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: MSB first, widths 9 to 12 that grow one code early."""
    value = bits = 0
    out = bytearray()

    def put(code: int) -> None:
        nonlocal value, bits
        value = value << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(value >> bits & 255)
        value &= (1 << bits) - 1

    known: dict = {}
    width, following = 9, 258
    put(256)
    word = b""
    for i in range(len(data)):
        longer = data[i : i + 1] if not word else word + data[i : i + 1]
        if len(longer) == 1 or longer in known:
            word = longer
            continue
        put(known[word] if len(word) > 1 else word[0])
        known[longer] = following
        following += 1
        if following == 4095:
            put(256)
            known, width, following = {}, 9, 258
        elif following in (512, 1024, 2048):
            width += 1
        word = data[i : i + 1]
    if word:
        put(known[word] if len(word) > 1 else word[0])
        following += 1
        if following in (512, 1024, 2048):
            width += 1
    put(257)
    if bits:
        out.append(value << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Either order of bits: a stream starts with the clear code in one of them."""
    if not data:
        return b""
    lsb = data[0] == 0 and len(data) > 1 and data[1] & 1
    if not lsb and data[0] != 0x80:
        raise CodecError("no clear code")
    early = 0 if lsb else 1
    out, i, value, bits, width = bytearray(), 0, 0, 0, 9
    table: list[bytes] = []
    last = b""
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    while True:
        while bits < width:
            if i >= len(data):
                return bytes(out)
            value = value | data[i] << bits if lsb else value << 8 | data[i]
            bits += 8
            i += 1
        bits -= width
        if lsb:
            code = value & (1 << width) - 1
            value >>= width
        else:
            code = value >> bits
            value &= (1 << bits) - 1
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if not last:
            if code > 255:
                raise CodecError("corrupt stream")
            word = table[code]
        elif code < len(table):
            word = table[code]
            table.append(last + word[:1])
        elif code == len(table):
            word = last + last[:1]
            table.append(word)
        else:
            raise CodecError("corrupt stream")
        out += word
        last = word
        if len(table) + early >= 1 << width and width < 12:
            width += 1


def dicomrle_decode(data: bytes) -> bytes:
    """Byte planes, each in byte runs, most significant first; little-endian samples come back."""
    if len(data) < 64:
        raise CodecError("header missing")
    head = struct.unpack_from("<16I", data)
    n = head[0]
    if not 1 <= n <= 15 or head[1] != 64 or any(not 0 < o < len(data) for o in head[1 : n + 1]):
        raise CodecError("corrupt header")
    ends = [*head[2 : n + 1], len(data)]
    planes = [np.frombuffer(packbits_decode(data[a:b]), np.uint8) for a, b in zip(head[1 : n + 1], ends, strict=True)]
    size = min(map(len, planes))
    return np.stack([p[:size] for p in planes[::-1]], 1).tobytes()


def lzf_decode(data: bytes, header: bool = False) -> bytes:
    out, i = bytearray(), 4 if header else 0
    while i < len(data):
        c = data[i]
        i += 1
        if c < 32:
            out += data[i : i + c + 1]
            i += c + 1
            continue
        n = c >> 5
        if n == 7:
            n += data[i]
            i += 1
        back = (c & 31) << 8 | data[i]
        i += 1
        _copy(out, back + 1, n + 2)
    return bytes(out)


def _matches(data: bytes, least: int, longest: int, reach: int):
    """Greedy parse: (position, distance, length) with length 0 for a literal; the latest place of every triple."""
    seen: dict[bytes, int] = {}
    i, n = 0, len(data)
    while i < n:
        key = data[i : i + 3]
        j = seen.get(key, -1) if len(key) == 3 else -1
        size = 0
        if j >= 0 and i - j <= reach:
            most = min(longest, n - i)
            size = 3
            while size < most and data[j + size] == data[i + size]:
                size += 1
        if len(key) == 3:
            seen[key] = i
        if size >= least:
            yield i, i - j, size
            i += size
        else:
            yield i, 0, 0
            i += 1


def lzf_encode(data: bytes, header: bool = False) -> bytes:
    out = bytearray(struct.pack("<I", len(data)) if header else b"")
    literal = bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 32):
            out.append(len(literal[k : k + 32]) - 1)
            out.extend(literal[k : k + 32])
        literal.clear()

    for at, back, size in _matches(data, 3, 264, 8192):
        if not size:
            literal.append(data[at])
            continue
        flush()
        n, d = size - 2, back - 1
        out.extend((min(n, 7) << 5 | d >> 8, *((n - 7,) if n >= 7 else ()), d & 255))
    flush()
    return bytes(out)


def pglz_encode(data: bytes, header: bool = False) -> bytes:
    out = bytearray(struct.pack("<I", len(data)) if header else b"")
    items: list[bytes | None] = []
    for at, back, size in _matches(data, 3, 273, 4095):
        if size:
            n = size - 3
            items.append(bytes([back >> 4 & 0xF0 | min(n, 15), back & 255, *((n - 15,) if n >= 15 else ())]))
        else:
            items.append(data[at : at + 1])
    for k in range(0, len(items), 8):
        part = items[k : k + 8]
        out.append(sum(1 << j for j, x in enumerate(part) if len(x) > 1))
        out += b"".join(part)
    return bytes(out)


def pglz_decode(data: bytes, header: bool = False, out_size: int | None = None) -> bytes:
    i = 4 if header else 0
    size = struct.unpack_from("<I", data)[0] if header else out_size
    out = bytearray()
    while i < len(data):
        flags = data[i]
        i += 1
        for k in range(8):
            if i >= len(data) or size is not None and len(out) >= size:
                break
            if flags >> k & 1:
                n = (data[i] & 15) + 3
                back = (data[i] & 0xF0) << 4 | data[i + 1]
                i += 2
                if n == 18:
                    n += data[i]
                    i += 1
                _copy(out, back, n)
            else:
                out.append(data[i])
                i += 1
    return bytes(out)


def lzo_decode(data: bytes, header: bool = True) -> bytes:
    """LZO1X, after a five-byte header if there is one."""
    i = 5 if header else 0
    out = bytearray()

    def far(n: int, base: int) -> int:
        nonlocal i
        if n == 0:
            while data[i] == 0:
                n += 255
                i += 1
            n += base + data[i]
            i += 1
        return n

    state = 0
    if data[i] > 17:
        n = data[i] - 17
        i += 1
        out += data[i : i + n]
        i += n
        state = min(n, 4)
    while True:
        t = data[i]
        i += 1
        if t < 16:
            if state == 0:
                n = far(t, 15) + 3
                out += data[i : i + n]
                i += n
                state = 4
                continue
            back = (t >> 2) + (data[i] << 2) + (2049 if state == 4 else 1)
            n = 3 if state == 4 else 2
            i += 1
            low = t & 3
        elif t < 32:
            n = far(t & 7, 7) + 2
            pair = data[i] | data[i + 1] << 8
            i += 2
            back = ((t & 8) << 11) + (pair >> 2)
            if back == 0:
                return bytes(out)
            back += 16384
            low = pair & 3
        elif t < 64:
            n = far(t & 31, 31) + 2
            pair = data[i] | data[i + 1] << 8
            i += 2
            back, low = (pair >> 2) + 1, pair & 3
        else:
            n = (t >> 5) + 1
            back = (t >> 2 & 7) + (data[i] << 3) + 1
            i += 1
            low = t & 3
        _copy(out, back, n)
        out += data[i : i + low]
        i += low
        state = low


def rcomp_encode(x: np.ndarray, nblock: int = 32) -> bytes:
    """FITS Rice coding of the differences of 1, 2 or 4-byte integers."""
    size = x.dtype.itemsize
    fsbits, fsmax = {1: (3, 6), 2: (4, 14), 4: (5, 25)}[size]
    wide = size * 8
    flat = x.ravel().view(f"i{size}").astype(np.int64)
    bits: list[str] = [format(int(flat[0]) & (1 << wide) - 1, f"0{wide}b")] if len(flat) else []
    d = np.diff(flat, prepend=flat[:1])
    d = (d + (1 << wide - 1)) % (1 << wide) - (1 << wide - 1)
    folded = np.where(d < 0, -2 * d - 1, 2 * d)
    for k in range(0, len(folded), nblock):
        part = folded[k : k + nblock]
        mean = max(0.0, (float(part.sum()) - len(part) // 2 - 1) / len(part))
        fs = int(mean / 2).bit_length() if mean else 0
        if not part.any():
            bits.append("0" * fsbits)
        elif fs >= fsmax:
            bits.append(format(fsmax + 1, f"0{fsbits}b"))
            bits += [format(int(v), f"0{wide}b") for v in part]
        else:
            bits.append(format(fs + 1, f"0{fsbits}b"))
            bits += ["0" * (int(v) >> fs) + "1" + (format(int(v) & (1 << fs) - 1, f"0{fs}b") if fs else "") for v in part]
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def rcomp_decode(data: bytes, shape: tuple, dtype: str, nblock: int = 32) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    fsbits, fsmax = {1: (3, 6), 2: (4, 14), 4: (5, 25)}[size]
    wide, n = size * 8, int(np.prod(shape))
    text = "".join(format(b, "08b") for b in data)
    at, out = wide, np.zeros(n, np.int64)
    value = int(text[:wide], 2) if n else 0
    for k in range(0, n, nblock):
        fs = int(text[at : at + fsbits], 2) - 1
        at += fsbits
        for j in range(k, min(k + nblock, n)):
            if fs < 0:
                v = 0
            elif fs == fsmax:
                v = int(text[at : at + wide], 2)
                at += wide
            else:
                one = text.index("1", at)
                v = one - at << fs | (int(text[one + 1 : one + 1 + fs], 2) if fs else 0)
                at = one + 1 + fs
            value += -(v + 1 >> 1) if v & 1 else v >> 1
            out[j] = value
    return out.astype(f"u{size}").view(dtype).reshape(shape)


# ---- checksums ----


def lookup3(data: bytes, value: int = 0) -> int:
    """Jenkins' hash of bytes, read in little-endian words."""
    m = 0xFFFFFFFF
    rot = lambda x, k: (x << k | x >> 32 - k) & m
    a = b = c = 0xDEADBEEF + len(data) + value & m
    if not data:
        return c
    whole = (len(data) - 1) // 12 * 12
    for i in range(0, whole, 12):
        x, y, z = struct.unpack_from("<3I", data, i)
        a, b, c = a + x & m, b + y & m, c + z & m
        for k1, k2, k3 in ((4, 6, 8), (16, 19, 4)):
            a = (a - c & m) ^ rot(c, k1)
            c = c + b & m
            b = (b - a & m) ^ rot(a, k2)
            a = a + c & m
            c = (c - b & m) ^ rot(b, k3)
            b = b + a & m
    x, y, z = struct.unpack("<3I", data[whole:].ljust(12, b"\0"))
    a, b, c = a + x & m, b + y & m, c + z & m
    c = (c ^ b) - rot(b, 14) & m
    a = (a ^ c) - rot(c, 11) & m
    b = (b ^ a) - rot(a, 25) & m
    c = (c ^ b) - rot(b, 16) & m
    a = (a ^ c) - rot(c, 4) & m
    b = (b ^ a) - rot(a, 14) & m
    return (c ^ b) - rot(b, 24) & m


def fletcher32(data: bytes, value: int = 0) -> int:
    w = np.frombuffer(data + b"\0" * (len(data) % 2), ">u2").astype(np.int64)
    a = b = 0
    for k in range(0, len(w), 360):
        for v in w[k : k + 360].tolist():
            a += v
            b += a
        a, b = (a & 0xFFFF) + (a >> 16), (b & 0xFFFF) + (b >> 16)
    a, b = (a & 0xFFFF) + (a >> 16), (b & 0xFFFF) + (b >> 16)
    return b << 16 | a


def hash_string(data: bytes, value: int = 5381) -> int:
    h = 5381
    for c in data.split(b"\0")[0]:
        h = h * 33 + c & 0xFFFFFFFF
    return h


def adler32(data: bytes, value: int = 1) -> int:
    return zlib.adler32(data, value)


def crc32(data: bytes, value: int = 0) -> int:
    return zlib.crc32(data, value)


@cache
def _h5crc_table() -> list[int]:
    """The polynomial 0x04C11DB7 used unreflected with right shifts, as HDF5 does."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ 0x04C11DB7, table >> 1).astype(np.uint32)
    return table.tolist()


def h5crc(data: bytes, value: int = 0) -> int:
    table, crc = _h5crc_table(), 0xFFFFFFFF
    for c in data:
        crc = table[(crc ^ c) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


CHECKSUMS = {"crc32": crc32, "adler32": adler32, "fletcher32": fletcher32, "lookup3": lookup3, "hash_string": hash_string, "h5crc": h5crc}


def checksum_encode(data: bytes, kind: str = "crc32", value: int | None = None, prepend: bool = False) -> bytes:
    """Data framed with their checksum, little-endian."""
    code = struct.pack("<I", CHECKSUMS[kind](data, *([] if value is None else [value])))
    return code + data if prepend else data + code


def checksum_decode(data: bytes, kind: str = "crc32", value: int | None = None, prepend: bool = False) -> bytes:
    code, body = (data[:4], data[4:]) if prepend else (data[-4:], data[:-4])
    if struct.pack("<I", CHECKSUMS[kind](body, *([] if value is None else [value]))) != code:
        raise CodecError("checksum differs")
    return body
