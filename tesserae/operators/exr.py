"""OpenEXR: scanline and one-level tiled images of half, float or unsigned samples, uncompressed, RLE, ZIPS or ZIP."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tesserae.operators.compressors import CodecError

MAGIC = 20000630
TYPES = {0: "u4", 1: "f2", 2: "f4"}
#: Codes of the compressions and their lines in a chunk.
COMPRESSIONS = {"none": (0, 1), "rle": (1, 1), "zips": (2, 1), "zip": (3, 16)}
TILED, MULTIPART = 0x200, 0x1000


def _spread(raw: bytes) -> bytes:
    """Even bytes, then odd ones, each as its difference from the last, off by 128."""
    x = np.frombuffer(raw, np.uint8)
    x = np.concatenate([x[::2], x[1::2]])
    x[1:] = np.diff(x) + np.uint8(128)
    return x.tobytes()


def _gathered(raw: bytes) -> bytes:
    x = np.frombuffer(raw, np.uint8).copy()
    x[1:] -= np.uint8(128)
    x = np.cumsum(x, dtype=np.uint8)
    out = np.empty_like(x)
    half = -(-len(x) // 2)
    out[::2], out[1::2] = x[:half], x[half:]
    return out.tobytes()


def _rle(raw: bytes) -> bytes:
    """Runs of 3 to 128 as length - 1 and the byte; other bytes after their negative number, 127 at most."""
    x = np.frombuffer(raw, np.uint8)
    starts = np.r_[0, np.flatnonzero(np.diff(x)) + 1] if len(x) else np.zeros(0, int)
    out, plain = bytearray(), bytearray()

    def flush():
        for k in range(0, len(plain), 127):
            part = plain[k : k + 127]
            out.extend(bytes([256 - len(part)]) + part)
        plain.clear()

    for value, n in zip(x[starts].tolist(), np.diff(np.r_[starts, len(x)]).tolist()):
        if n < 3:
            plain.extend([value] * n)
            continue
        flush()
        while n > 0:
            out.extend((min(n, 128) - 1, value))
            n -= 128
    flush()
    return bytes(out)


def _unrle(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n > 127:
            out += raw[i + 1 : i + 257 - n]
            i += 257 - n
        else:
            out += raw[i + 1 : i + 2] * (n + 1)
            i += 2
    return bytes(out)


def _pack(raw: bytes, code: int, level: int) -> bytes:
    if not code:
        return raw
    made = _rle(_spread(raw)) if code == 1 else zlib.compress(_spread(raw), level)
    return made if len(made) < len(raw) else raw


def _unpack(raw: bytes, code: int, size: int) -> bytes:
    if code and len(raw) < size:
        raw = _gathered(_unrle(raw) if code == 1 else zlib.decompress(raw))
    if len(raw) != size:
        raise CodecError("a chunk has the wrong size")
    return raw


def _names(samples: int) -> list[str]:
    return list("YA" if samples <= 2 else "RGBA")[:samples] if samples <= 4 else [f"ch{i:02d}" for i in range(samples)]


def exr_encode(x: np.ndarray, level: int | None = None, compression: str = "zip", frames: bool = False) -> bytes:
    """[rows, columns], [rows, columns, samples], or with frames, one part for each along the first axis."""
    if x.dtype.str[1:] not in TYPES.values() or not x.size:
        raise ValueError("invalid data shape or dtype")
    code, lines = COMPRESSIONS[compression]
    images = x if frames else x[None]
    images = images[..., None] if images.ndim == 3 else images
    if images.ndim != 4 or images.shape[3] > 100:
        raise ValueError("invalid data shape or dtype")
    n, h, w, samples = images.shape
    names = _names(samples)
    order = sorted(range(samples), key=lambda c: names[c])
    kind = {v: k for k, v in TYPES.items()}[x.dtype.str[1:]]
    attribute = lambda name, form, body: f"{name}\0{form}\0".encode() + struct.pack("<I", len(body)) + body
    box = struct.pack("<4i", 0, 0, w - 1, h - 1)
    chunks = -(-h // lines)
    heads = b""
    for k in range(n):
        heads += attribute("channels", "chlist", b"".join(names[c].encode() + struct.pack("<xIB3x2I", kind, 0, 1, 1) for c in order) + b"\0")
        heads += attribute("compression", "compression", bytes([code])) + attribute("dataWindow", "box2i", box) + attribute("displayWindow", "box2i", box)
        heads += attribute("lineOrder", "lineOrder", b"\0") + attribute("pixelAspectRatio", "float", struct.pack("<f", 1))
        heads += attribute("screenWindowCenter", "v2f", bytes(8)) + attribute("screenWindowWidth", "float", struct.pack("<f", 1))
        if n > 1:
            heads += attribute("name", "string", f"frame{k}".encode()) + attribute("type", "string", b"scanlineimage") + attribute("chunkCount", "int", struct.pack("<i", chunks))
        heads += b"\0"
    out = bytearray(struct.pack("<II", MAGIC, 2 | MULTIPART * (n > 1)) + heads + b"\0" * (n > 1))
    table, at = len(out), 0
    out += bytes(8 * chunks * n)
    for k, image in enumerate(images):
        planes = image[:, :, order].swapaxes(1, 2).astype(x.dtype.newbyteorder("<"))
        for y in range(0, h, lines):
            body = _pack(planes[y : y + lines].tobytes(), code, 4 if level is None else level)
            struct.pack_into("<Q", out, table + 8 * at, len(out))
            at += 1
            out += (struct.pack("<i", k) if n > 1 else b"") + struct.pack("<ii", y, len(body)) + body
    return bytes(out)


def _headers(data: bytes) -> tuple[list[dict], int, int]:
    """The attributes of every part, the flags, and where the tables of chunks begin."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != MAGIC:
        raise CodecError("not an OpenEXR file")
    flags = struct.unpack_from("<I", data, 4)[0]
    at, parts = 8, []

    def word():
        nonlocal at
        end = data.find(b"\0", at)
        if end < 0:
            raise CodecError("header is too short")
        text, at = data[at:end].decode("latin-1"), end + 1
        return text

    while True:
        part: dict = {}
        while name := word():
            form = word()
            size = struct.unpack_from("<I", data, at)[0]
            part[name] = form, data[at + 4 : at + 4 + size]
            at += 4 + size
        if part:
            parts.append(part)
        if not part or not flags & MULTIPART:
            return parts, flags, at


def _channels(body: bytes) -> list[tuple[str, int]]:
    out, at = [], 0
    while body[at]:
        end = body.index(b"\0", at)
        kind, _, xs, ys = struct.unpack_from("<IB3x2I", body, end + 1)
        if (xs, ys) != (1, 1):
            raise ValueError("sub-sampled channels are not supported")
        out.append((body[at:end].decode("latin-1"), kind))
        at = end + 17
    if not out:
        raise ValueError("no channels found")
    return out


def exr_decode(data: bytes, index: int | None = 0) -> np.ndarray:
    """[rows, columns] or [rows, columns, samples] of one part, or of all with index None. Up to four samples come in
    reverse order of their names, so Y, YA, RGB or RGBA; more in order of names. Channels of different types become
    float if one is, else half."""
    data = bytes(data)
    parts, flags, at = _headers(data)
    if flags & 0x800:
        raise CodecError("deep images are not available")
    tables = []
    for p in parts:
        x0, y0, x1, y1 = struct.unpack("<4i", p["dataWindow"][1])
        w, h, code = x1 - x0 + 1, y1 - y0 + 1, p["compression"][1][0]
        lines = {c: n for c, n in COMPRESSIONS.values()}.get(code)
        if lines is None:
            raise CodecError(f"compression {code} is not available")
        tiled = bool(flags & TILED) or p.get("type", ("", b""))[1].rstrip(b"\0") == b"tiledimage"
        tile = struct.unpack("<IIB", p["tiles"][1]) if tiled else None
        if tile and tile[2] & 15:
            raise CodecError("images of several levels are not available")
        n = -(-w // tile[0]) * -(-h // tile[1]) if tile else -(-h // lines)
        tables.append((w, h, y0, code, lines, tile, struct.unpack_from(f"<{n}Q", data, at)))
        at += 8 * n
    made = []
    for p, (w, h, y0, code, lines, tile, places) in list(zip(parts, tables))[slice(None) if index is None else slice(index, index + 1 or None)]:
        channels = _channels(p["channels"][1])
        kinds = [TYPES[k] for _, k in channels]
        out = np.zeros((h, w, len(channels)), "f4" if "f4" in kinds else "f2" if "f2" in kinds else "u4")
        size = sum(np.dtype(k).itemsize for k in kinds)
        for place in places:
            place += 4 * bool(flags & MULTIPART)
            if tile:
                tx, ty = struct.unpack_from("<ii", data, place)
                place += 16
                y, x = ty * tile[1], tx * tile[0]
                rows, columns = min(tile[1], h - y), min(tile[0], w - x)
            else:
                y, x, columns = struct.unpack_from("<i", data, place)[0] - y0, 0, w
                place += 4
                rows = min(lines, h - y)
            if y < 0 or x < 0 or rows <= 0 or columns <= 0:
                raise CodecError("a chunk lies outside the image")
            n = struct.unpack_from("<i", data, place)[0]
            raw = np.frombuffer(_unpack(data[place + 4 : place + 4 + n], code, rows * columns * size), np.uint8).reshape(rows, -1)
            k = 0
            for c, kind in enumerate(kinds):
                step = columns * np.dtype(kind).itemsize
                out[y : y + rows, x : x + columns, c] = np.ascontiguousarray(raw[:, k : k + step]).view("<" + kind)
                k += step
        if len(channels) <= 4:
            out = out[..., ::-1]
        made.append(np.ascontiguousarray(out[..., 0] if len(channels) == 1 else out))
    if not made:
        raise IndexError("no such part")
    return made[0] if len(made) == 1 else np.stack(made)
