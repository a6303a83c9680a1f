"""Image and array containers as numpy kernels."""

from __future__ import annotations

import io
import struct
import zlib
from functools import partial

import numpy as np

from tesserae.operators.bilevel import ccittfax3_decode, ccittfax4_decode, ccittrle_decode
from tesserae.operators.compressors import CodecError, lzma_decode, lzma_encode, lzw_decode, lzw_encode, packbits_decode, packbits_encode, zstd_decode, zstd_encode
from tesserae.operators.filters import bitorder, delta_encode, floatpred_decode, floatpred_encode
from tesserae.operators.jpeg import jpeg_decode

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def numpy_encode(x: np.ndarray, level: int = 0) -> bytes:
    out = io.BytesIO()
    if level:
        np.savez_compressed(out, x)
    else:
        np.save(out, x, allow_pickle=False)
    return out.getvalue()


def numpy_decode(data: bytes, index: int = 0) -> np.ndarray:
    found = np.load(io.BytesIO(data), allow_pickle=False)
    return found if isinstance(found, np.ndarray) else found[found.files[index]]


def numpy_arrays(data: bytes) -> list[np.ndarray]:
    """All arrays of a file."""
    found = np.load(io.BytesIO(data), allow_pickle=False)
    return [found] if isinstance(found, np.ndarray) else [found[name] for name in found.files]


# ---- PNG ----


def _png_chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _png_rows(x: np.ndarray, level: int) -> bytes:
    rows = x.astype(x.dtype.newbyteorder(">")).reshape(x.shape[0], -1).view(np.uint8)
    return zlib.compress(np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes(), level)


def _png_head(x: np.ndarray) -> bytes:
    samples = 1 if x.ndim == 2 else x.shape[2]
    if x.dtype.str[1:] not in ("u1", "u2") or not 1 <= samples <= 4:
        raise CodecError("unsupported dtype or samples")
    return _png_chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], x.dtype.itemsize * 8, (0, 4, 2, 6)[samples - 1], 0, 0, 0))


def png_encode(x: np.ndarray, level: int = 6) -> bytes:
    return PNG_SIGNATURE + _png_head(x) + _png_chunk(b"IDAT", _png_rows(x, level)) + _png_chunk(b"IEND", b"")


def apng_encode(x: np.ndarray, level: int = 6, delay: int = 100) -> bytes:
    """Frames along the first axis, unless the array is one image: of two dimensions, or with 3 or 4 samples last; delay
    in milliseconds."""
    if x.ndim == 2 or x.ndim == 3 and x.shape[2] in (3, 4):
        x = x[None]
    out = [PNG_SIGNATURE, _png_head(x[0]), _png_chunk(b"acTL", struct.pack(">II", len(x), 0))]
    turn = 0
    for i, frame in enumerate(x):
        out.append(_png_chunk(b"fcTL", struct.pack(">IIIIIHHBB", turn, frame.shape[1], frame.shape[0], 0, 0, delay, 1000, 0, 0)))
        turn += 1
        body = _png_rows(frame, level)
        if i:
            body = struct.pack(">I", turn) + body
            turn += 1
        out.append(_png_chunk(b"fdAT" if i else b"IDAT", body))
    return b"".join([*out, _png_chunk(b"IEND", b"")])


def _unfilter(raw: bytes, height: int, row: int, step: int) -> np.ndarray:
    lines = np.frombuffer(raw, np.uint8)[: height * (row + 1)].reshape(height, row + 1)
    out = np.zeros((height, row), np.uint8)
    above = np.zeros(row, np.uint8)
    for y in range(height):
        kind, line = lines[y, 0], lines[y, 1:]
        if kind == 0:
            now = line.copy()
        elif kind == 1:
            pad = np.r_[line, np.zeros(-row % step, np.uint8)].reshape(-1, step)
            now = np.cumsum(pad, 0, dtype=np.uint8).ravel()[:row]
        elif kind == 2:
            now = line + above
        else:
            now = np.zeros(row, np.int64)
            up, cells = above.astype(np.int64), line.tolist()
            for i in range(row):
                a = int(now[i - step]) if i >= step else 0
                b = int(up[i])
                if kind == 3:
                    guess = a + b >> 1
                else:
                    c = int(up[i - step]) if i >= step else 0
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                now[i] = cells[i] + guess & 255
            now = now.astype(np.uint8)
        out[y] = above = now
    return out


def _png_parts(data: bytes):
    if data[:8] != PNG_SIGNATURE:
        raise CodecError("not a PNG")
    at = 8
    while at + 8 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


#: The seven passes of an interlaced image: first row and column, and steps down and across.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def _png_image(raw: bytes, width: int, height: int, depth: int, color: int, palette: bytes, interlaced: bool = False) -> np.ndarray:
    data = zlib.decompress(raw)
    if not interlaced:
        return _png_pass(data, width, height, depth, color, palette)
    samples, out, at = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color], None, 0
    for y, x, down, across in PASSES:
        w, h = len(range(x, width, across)), len(range(y, height, down))
        if not w or not h:
            continue
        part = _png_pass(data[at:], w, h, depth, color, palette)
        at += h * ((w * samples * depth + 7) // 8 + 1)
        if out is None:
            out = np.zeros((height, width, *part.shape[2:]), part.dtype)
        out[y::down, x::across] = part
    return out


def _png_pass(data: bytes, width: int, height: int, depth: int, color: int, palette: bytes) -> np.ndarray:
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    row = (width * samples * depth + 7) // 8
    rows = _unfilter(data, height, row, max(1, samples * depth // 8))
    if depth == 16:
        x = rows.view(">u2").astype(np.uint16)
    elif depth == 8:
        x = rows
    else:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        x = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)
        if color == 0:
            x = (x * (255 // ((1 << depth) - 1))).astype(np.uint8)
    x = x[:, : width * samples].reshape(height, width, samples)
    if color == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3)[x[..., 0]]
    return x[..., 0] if samples == 1 else x


def apng_decode(data: bytes, index: int | None = None) -> np.ndarray:
    """All frames (each must fill the image), or one."""
    head, palette, frames, now = None, b"", [], []
    for kind, body in _png_parts(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"fcTL" and now:
            frames.append(b"".join(now))
            now = []
        elif kind == b"IDAT":
            now.append(body)
        elif kind == b"fdAT":
            now.append(body[4:])
    if head is None or not now:
        raise CodecError("image missing")
    frames.append(b"".join(now))
    images = [_png_image(f, *head[:4], palette, bool(head[6])) for f in (frames if index is None else frames[index : index + 1])]
    return images[0] if len(frames) == 1 or index is not None else np.stack(images)


def png_decode(data: bytes) -> np.ndarray:
    return apng_decode(data, 0)


# ---- QOI ----


def qoi_encode(x: np.ndarray) -> bytes:
    h, w, c = x.shape
    out = bytearray(struct.pack(">4sIIBB", b"qoif", w, h, c, 0))
    index: list = [(0, 0, 0, 0)] * 64
    last, run = (0, 0, 0, 255), 0
    flat = x.reshape(-1, c)
    for cell in (flat if c == 4 else np.hstack([flat, np.full((len(flat), 1), 255, np.uint8)])).tolist():
        p = tuple(cell)
        if p == last:
            run += 1
            if run == 62:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        r, g, b, a = p
        slot = (r * 3 + g * 5 + b * 7 + a * 11) % 64
        if index[slot] == p:
            out.append(slot)
        else:
            index[slot] = p
            if a == last[3]:
                dr, dg, db = ((v - u + 128) % 256 - 128 for v, u in zip(p[:3], last[:3], strict=True))
                if all(-2 <= d <= 1 for d in (dr, dg, db)):
                    out.append(0x40 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
                elif -32 <= dg <= 31 and -8 <= dr - dg <= 7 and -8 <= db - dg <= 7:
                    out += bytes((0x80 | dg + 32, dr - dg + 8 << 4 | db - dg + 8))
                else:
                    out += bytes((0xFE, r, g, b))
            else:
                out += bytes((0xFF, r, g, b, a))
        last = p
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out) + b"\0\0\0\0\0\0\0\1"


def qoi_decode(data: bytes) -> np.ndarray:
    magic, w, h, c, _ = struct.unpack_from(">4sIIBB", data)
    if magic != b"qoif":
        raise CodecError("not a QOI")
    out = np.empty((w * h, 4), np.uint8)
    index: list = [(0, 0, 0, 0)] * 64
    p, i, n = (0, 0, 0, 255), 14, 0
    while n < w * h:
        t = data[i]
        i += 1
        run = 1
        r, g, b, a = p
        if t == 0xFE:
            p = (*data[i : i + 3], a)
            i += 3
        elif t == 0xFF:
            p = tuple(data[i : i + 4])
            i += 4
        elif t < 64:
            p = index[t]
        elif t < 128:
            p = ((r + (t >> 4 & 3) - 2) & 255, (g + (t >> 2 & 3) - 2) & 255, (b + (t & 3) - 2) & 255, a)
        elif t < 192:
            dg, u = (t & 63) - 32, data[i]
            i += 1
            p = ((r + dg + (u >> 4) - 8) & 255, (g + dg) & 255, (b + dg + (u & 15) - 8) & 255, a)
        else:
            run = (t & 63) + 1
        index[(p[0] * 3 + p[1] * 5 + p[2] * 7 + p[3] * 11) % 64] = p
        out[n : n + run] = p
        n += run
    return out[:, :c].reshape(h, w, c)


# ---- BMP, TGA, PCX ----


def bmp_encode(x: np.ndarray, ppm: int = 3780) -> bytes:
    gray = x.ndim == 2
    h, w = x.shape[:2]
    bpp = 8 if gray else 8 * x.shape[2]
    rows = x.reshape(h, -1) if gray else np.dstack([x[..., 2], x[..., 1], x[..., 0], *([x[..., 3]] if bpp == 32 else [])]).reshape(h, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if gray else b""
    start = 54 + len(palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + rows.size, 0, 0, start, 40, w, h, 1, bpp, 0, rows.size, ppm, ppm, 256 if gray else 0, 0) + palette + rows.tobytes()


def bmp_decode(data: bytes, asrgb: bool = True) -> np.ndarray:
    if data[:2] != b"BM":
        raise CodecError("not a BMP")
    start, size, w, h, _, bpp, packing, _, _, _, colors = struct.unpack_from("<IIiiHHIIiiI", data, 10)
    up, h = h > 0, abs(h)
    if packing not in (0, 1, 2, 3):
        raise NotImplementedError("embedded image")
    if packing in (1, 2):
        x = _bmp_runs(data, start, w, h, packing)
        up = True
    else:
        row = (w * bpp + 31) // 32 * 4
        rows = np.frombuffer(data, np.uint8, h * row, start).reshape(h, row)
        if bpp <= 8:
            x = np.unpackbits(rows, axis=1).reshape(h, -1, bpp)
            x = (x << np.arange(bpp - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, :w]
        elif bpp in (24, 32) and packing == 0:
            x = rows[:, : w * bpp // 8].reshape(h, w, bpp // 8)[..., [2, 1, 0, 3][: bpp // 8]]
        else:
            masks = struct.unpack_from("<3I", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F) if bpp == 16 else (0xFF0000, 0xFF00, 0xFF)
            cells = rows[:, : w * bpp // 8].copy().view(f"<u{bpp // 8}").astype(np.int64)
            planes = []
            for m in masks:
                low = (m & -m).bit_length() - 1
                top = m >> low
                planes.append((cells & m) >> low if top == 255 else ((cells & m) >> low) * 255 // max(top, 1))
            x = np.dstack(planes).astype(np.uint8)
    if up:
        x = x[::-1]
    if bpp <= 8:
        palette = np.frombuffer(data, np.uint8, (colors or 1 << bpp) * 4, 14 + size).reshape(-1, 4)[:, [2, 1, 0]]
        gray = (palette == palette[:, :1]).all()
        if asrgb and not gray:
            return palette[x]
        return palette[:, 0][x] if gray else np.ascontiguousarray(x)
    return np.ascontiguousarray(x)


def _bmp_runs(data: bytes, i: int, w: int, h: int, packing: int) -> np.ndarray:
    """RLE8 and RLE4, bottom row first."""
    out = np.zeros((h, w), np.uint8)
    x = y = 0
    while i + 1 < len(data):
        n, v = data[i], data[i + 1]
        i += 2
        if n:
            cells = [v] * n if packing == 1 else [v >> 4, v & 15] * (n // 2 + 1)
            m = max(0, min(n, w - x))
            out[y, x : x + m] = cells[:m]
            x += n
        elif v == 0:
            x, y = 0, y + 1
        elif v == 1:
            break
        elif v == 2:
            x, y = x + data[i], y + data[i + 1]
            i += 2
        else:
            size = v if packing == 1 else (v + 1) // 2
            raw = data[i : i + size]
            cells = list(raw) if packing == 1 else [k for b in raw for k in (b >> 4, b & 15)]
            m = max(0, min(v, w - x))
            out[y, x : x + m] = cells[:m]
            x += v
            i += size + size % 2
        if y >= h:
            break
    return out


def tga_encode(x: np.ndarray, rle: bool = False) -> bytes:
    gray = x.ndim == 2
    h, w = x.shape[:2]
    step = 1 if gray else x.shape[2]
    cells = x.reshape(-1, 1) if gray else x.reshape(-1, step)[:, [2, 1, 0, 3][:step]]
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, (3 if gray else 2) + 8 * rle, 0, 0, 0, 0, 0, w, h, 8 * step, 0x20 | (8 if step == 4 else 0))
    body = cells.tobytes()
    if rle:
        out, raw = bytearray(), [bytes(c) for c in cells]
        for y in range(h):
            line, i = raw[y * w : (y + 1) * w], 0
            while i < w:
                n = 1
                while i + n < w and n < 128 and line[i + n] == line[i]:
                    n += 1
                if n > 1:
                    out += bytes((127 + n,)) + line[i]
                else:
                    while i + n < w and n < 128 and (i + n + 1 >= w or line[i + n] != line[i + n + 1]):
                        n += 1
                    out += bytes((n - 1,)) + b"".join(line[i : i + n])
                i += n
        body = bytes(out)
    return head + body + b"\0" * 8 + b"TRUEVISION-XFILE.\0"


def tga_decode(data: bytes) -> np.ndarray:
    idlen, cmap, kind, first, count, depth, _, _, w, h, bpp, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    at = 18 + idlen
    step = (bpp + 7) // 8
    palette = None
    if cmap:
        palette = np.frombuffer(data, np.uint8, count * depth // 8, at).reshape(count, -1)
        at += count * depth // 8
    if kind & 8:
        out, n = bytearray(), w * h * step
        while len(out) < n:
            c = data[at]
            if c > 127:
                out += data[at + 1 : at + 1 + step] * (c - 127)
                at += 1 + step
            else:
                out += data[at + 1 : at + 1 + (c + 1) * step]
                at += 1 + (c + 1) * step
        cells = np.frombuffer(bytes(out[:n]), np.uint8)
    else:
        cells = np.frombuffer(data, np.uint8, w * h * step, at)
    x = cells.reshape(h, w, step)
    if kind & 7 == 1:
        x = palette[x[..., 0].astype(int) - first]
    if x.shape[2] == 2:
        v = np.ascontiguousarray(x).view("<u2")[..., 0]
        x = np.dstack([(v >> s & 31) * 255 // 31 for s in (10, 5, 0)]).astype(np.uint8)
    elif x.shape[2] >= 3:
        x = x[..., [2, 1, 0, 3][: x.shape[2]]]
    x = x if flags & 0x20 else x[::-1]
    x = x[:, ::-1] if flags & 0x10 else x
    return np.ascontiguousarray(x[..., 0] if x.shape[2] == 1 else x)


def pcx_encode(x: np.ndarray) -> bytes:
    gray = x.ndim == 2
    h, w = x.shape[:2]
    planes = 1 if gray else x.shape[2]
    row = w + w % 2
    head = struct.pack("<BBBBHHHHHH48sBBHHHH54s", 10, 5, 1, 8, 0, 0, w - 1, h - 1, 72, 72, b"", 0, planes, row, 1, 0, 0, b"")
    out = bytearray(head)
    for y in range(h):
        for p in range(planes):
            line = bytes(x[y] if gray else x[y, :, p]) + b"\0" * (row - w)
            i = 0
            while i < row:
                n = 1
                while i + n < row and n < 63 and line[i + n] == line[i]:
                    n += 1
                out += bytes((0xC0 | n, line[i])) if n > 1 or line[i] >= 0xC0 else line[i : i + 1]
                i += n
    if gray:
        out += b"\x0c" + bytes(v for i in range(256) for v in (i, i, i))
    return bytes(out)


def pcx_decode(data: bytes, index: int | None = None) -> np.ndarray:
    if data[:4] == b"\xb1\x68\xde\x3a":
        offsets = [o for o in struct.unpack_from("<1024I", data.ljust(4100, b"\0"), 4) if o]
        pages = [pcx_decode(data[o:]) for o in (offsets if index is None else offsets[index : index + 1])]
        return np.stack(pages) if index is None else pages[0]
    if data[:1] != b"\x0a":
        raise CodecError("not a PCX")
    depth, x0, y0, x1, y1 = struct.unpack_from("<BHHHH", data, 3)
    planes, row = struct.unpack_from("<BH", data, 65)
    w, h = x1 - x0 + 1, y1 - y0 + 1
    need, out, i = h * planes * row, bytearray(), 128
    while len(out) < need and i < len(data):
        b = data[i]
        i += 1
        if data[2] and b >= 0xC0:
            out += data[i : i + 1] * (b & 63)
            i += 1
        else:
            out.append(b)
    rows = np.frombuffer(bytes(out[:need]), np.uint8).reshape(h, planes, row)
    if depth == 8:
        x = rows[:, :, :w]
        if planes >= 3:
            return np.ascontiguousarray(np.moveaxis(x, 1, 2))
        if len(data) >= 769 and data[-769] == 12:
            palette = np.frombuffer(data, np.uint8, 768, len(data) - 768).reshape(256, 3)
            x = palette[x[:, 0]]
            return x[..., 0] if (palette == palette[:, :1]).all() else x
        return x[:, 0]
    bits = np.unpackbits(rows, axis=2).reshape(h, planes, -1, depth)
    v = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(3, dtype=np.uint8)[:, :, :w]
    v = (v << (np.arange(planes, dtype=np.uint8) * depth)[:, None]).sum(1, dtype=np.uint8)
    if planes * depth == 1:
        return v * np.uint8(255)
    return np.frombuffer(data, np.uint8, 48, 16).reshape(16, 3)[v & 15]


# ---- GIF ----


def gif_encode(x: np.ndarray, colormap: np.ndarray | None = None) -> bytes:
    frames = x if x.ndim == 3 else x[None]
    h, w = frames.shape[1:]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1) if colormap is None else np.resize(colormap, (256, 3)).astype(np.uint8)
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), palette.tobytes()]
    for f in frames:
        bits, width, table, following, word = [], 9, {}, 258, b""
        codes = [(256, 9)]
        for i in f.tobytes():
            longer = word + bytes((i,))
            if len(longer) == 1 or longer in table:
                word = longer
                continue
            codes.append((table[word] if len(word) > 1 else word[0], width))
            if following < 4096:
                table[longer] = following
                following += 1
                if following - 1 == 1 << width and width < 12:
                    width += 1
            else:
                codes.append((256, width))
                table, following, width = {}, 258, 9
            word = bytes((i,))
        codes.append((table[word] if len(word) > 1 else word[0], width))
        if following == 1 << width and width < 12:
            width += 1
        codes.append((257, width))
        value = n = 0
        raw = bytearray()
        for code, size in codes:
            value |= code << n
            n += size
            while n >= 8:
                raw.append(value & 255)
                value >>= 8
                n -= 8
        if n:
            raw.append(value & 255)
        del bits
        out += [b"\x2c", struct.pack("<HHHHB", 0, 0, w, h, 0), b"\x08", *(bytes((len(raw[k : k + 255]),)) + raw[k : k + 255] for k in range(0, len(raw), 255)), b"\0"]
    return b"".join([*out, b"\x3b"])


def gif_decode(data: bytes, index: int | None = None, asrgb: bool = True) -> np.ndarray:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise CodecError("not a GIF")
    w, h, flags = struct.unpack_from("<HHB", data, 6)
    at, palette = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    frames, canvas = [], np.zeros((h, w), np.uint8)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            at += 2
            while data[at]:
                at += data[at] + 1
            at += 1
            continue
        x, y, fw, fh, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        own = palette
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            own = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        least, raw = data[at], bytearray()
        at += 1
        while data[at]:
            raw += data[at + 1 : at + 1 + data[at]]
            at += data[at] + 1
        at += 1
        cells = np.frombuffer(_gif_codes(bytes(raw), least, fw * fh), np.uint8).reshape(fh, fw)
        if flags & 0x40:
            rows = [*range(0, fh, 8), *range(4, fh, 8), *range(2, fh, 4), *range(1, fh, 2)]
            cells = cells[np.argsort(rows)]
        canvas = canvas.copy()
        canvas[y : y + fh, x : x + fw] = cells
        frames.append(own[canvas] if asrgb else canvas)
    if not frames:
        raise CodecError("no frame")
    return frames[index] if index is not None else frames[0] if len(frames) == 1 else np.stack(frames)


def _gif_codes(raw: bytes, least: int, size: int) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    table, width, last = [], least + 1, b""
    out, value, bits = bytearray(), 0, 0
    for b in raw:
        value |= b << bits
        bits += 8
        while bits >= width:
            code = value & (1 << width) - 1
            value >>= width
            bits -= width
            if code == clear:
                table, width, last = [bytes((k,)) for k in range(clear)] + [b"", b""], least + 1, b""
                continue
            if code == end or len(out) >= size:
                return bytes(out[:size].ljust(size, b"\0"))
            word = table[code] if code < len(table) else last + last[:1]
            if last and len(table) < 4096:
                table.append(last + word[:1])
            out += word
            last = word
            if len(table) == 1 << width and width < 12:
                width += 1
    return bytes(out[:size].ljust(size, b"\0"))


# ---- Radiance RGBE ----


def rgbe_encode(x: np.ndarray, header: bool = True) -> bytes:
    top = x.max(-1)
    m, e = np.frexp(np.maximum(top, 1e-38))
    scale = np.where(top > 1e-32, m * 256 / np.maximum(top, 1e-38), 0)
    cells = np.dstack([np.floor(x * scale[..., None]).astype(np.uint8).reshape(*top.shape, 3), np.where(top > 1e-32, e + 128, 0).astype(np.uint8)])
    head = f"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y {x.shape[0]} +X {x.shape[1]}\n".encode() if header else b""
    return head + cells.tobytes()


def rgbe_decode(data: bytes, shape: tuple | None = None) -> np.ndarray:
    at = 0
    if data[:2] == b"#?":
        end = data.index(b"\n\n") + 2
        stop = data.index(b"\n", end)
        parts = data[end:stop].split()
        shape, at = (int(parts[1]), int(parts[3])), stop + 1
    h, w = shape[:2]
    out = np.zeros((h, w, 4), np.uint8)
    for y in range(h):
        if 8 <= w < 32768 and data[at : at + 2] == b"\2\2" and data[at + 2] << 8 | data[at + 3] == w:
            at += 4
            for c in range(4):
                line = bytearray()
                while len(line) < w:
                    n = data[at]
                    if n > 128:
                        line += data[at + 1 : at + 2] * (n - 128)
                        at += 2
                    else:
                        line += data[at + 1 : at + 1 + n]
                        at += 1 + n
                out[y, :, c] = np.frombuffer(bytes(line[:w]), np.uint8)
        else:
            out[y] = np.frombuffer(data, np.uint8, w * 4, at).reshape(w, 4)
            at += w * 4
    f = np.where(out[..., 3] > 0, np.ldexp(1.0, out[..., 3].astype(int) - 136), 0)
    return (out[..., :3] * f[..., None]).astype(np.float32)


# ---- block textures ----


def bcn_decode(data: bytes, format: int, shape: tuple) -> np.ndarray:
    """BC1 to BC5, blocks of 4 x 4."""
    h, w = shape[:2]
    if h % 4 or w % 4:
        raise CodecError("width and height must be multiples of 4")
    size = 8 if format in (1, 4) else 16
    b = np.frombuffer(data, np.uint8, h // 4 * (w // 4) * size).reshape(-1, size)

    def ramp(part: np.ndarray) -> np.ndarray:
        a, z = part[:, 0].astype(int), part[:, 1].astype(int)
        steps = np.zeros((len(part), 8), int)
        steps[:, 0], steps[:, 1] = a, z
        more = a > z
        for i in range(1, 7):
            steps[more, i + 1] = (((7 - i) * a + i * z) // 7)[more]
        for i in range(1, 5):
            steps[~more, i + 1] = (((5 - i) * a + i * z) // 5)[~more]
        steps[~more, 7] = 255
        bits = np.unpackbits(part[:, 2:8], axis=1, bitorder="little").reshape(-1, 16, 3)
        return np.take_along_axis(steps, bits @ np.array([1, 2, 4]), 1)

    def colors(part: np.ndarray, always: bool) -> np.ndarray:
        c = np.ascontiguousarray(part[:, :4]).view("<u2").astype(int)
        rgb = np.stack([(c >> 11) * 255 // 31, (c >> 5 & 63) * 255 // 63, (c & 31) * 255 // 31], -1)
        four = always | (c[:, 0] > c[:, 1])
        table = np.zeros((len(part), 4, 4), int)
        table[..., 3] = 255
        table[:, :2, :3] = rgb
        table[:, 2, :3] = np.where(four[:, None], (2 * rgb[:, 0] + rgb[:, 1]) // 3, (rgb[:, 0] + rgb[:, 1]) // 2)
        table[:, 3, :3] = np.where(four[:, None], (rgb[:, 0] + 2 * rgb[:, 1]) // 3, 0)
        table[:, 3, 3] = np.where(four, 255, 0)
        bits = np.unpackbits(part[:, 4:8], axis=1, bitorder="little").reshape(-1, 16, 2)
        return np.take_along_axis(table, (bits @ np.array([1, 2]))[..., None], 1)

    if format == 1:
        x = colors(b, False)
    elif format in (2, 3):
        x = colors(b[:, 8:], True)
        x[..., 3] = ramp(b[:, :8]) if format == 3 else np.stack([b[:, :8] & 15, b[:, :8] >> 4], 2).reshape(-1, 16) * 17
    elif format == 4:
        x = ramp(b)[..., None]
    elif format == 5:
        x = np.stack([ramp(b[:, :8]), ramp(b[:, 8:])], -1)
    else:
        raise NotImplementedError(f"BC{format}")
    c = x.shape[-1]
    out = x.reshape(h // 4, w // 4, 4, 4, c).swapaxes(1, 2).reshape(h, w, c).astype(np.uint8)
    return out[..., 0] if c == 1 else out


def dds_decode(data: bytes) -> np.ndarray:
    if data[:4] != b"DDS ":
        raise CodecError("not a DDS")
    h, w = struct.unpack_from("<II", data, 12)
    code, at = data[84:88], 128
    kinds = {b"DXT1": 1, b"DXT3": 2, b"DXT5": 3, b"ATI1": 4, b"BC4U": 4, b"ATI2": 5, b"BC5U": 5}
    if code == b"DX10":
        at = 148
        kind = {70: 1, 71: 1, 72: 1, 73: 2, 74: 2, 75: 2, 76: 3, 77: 3, 78: 3, 79: 4, 80: 4, 82: 5, 83: 5}.get(struct.unpack_from("<I", data, 128)[0])
    else:
        kind = kinds.get(code)
    if kind is None:
        raise NotImplementedError("pixel format")
    return bcn_decode(data[at:], kind, (h, w))


# ---- TIFF ----

TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "s", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}


def _last_link(data: bytes) -> int:
    """Where a little-endian TIFF keeps the place of the page after its last."""
    if data[:4] != b"II*\0":
        raise CodecError("only little-endian classic TIFF takes more pages")
    link = 4
    for _ in range(len(data)):
        at = struct.unpack_from("<I", data, link)[0]
        if not at:
            return link
        link = at + 2 + 12 * struct.unpack_from("<H", data, at)[0]
    raise CodecError("pages in a circle")


def tiff_encode(x: np.ndarray, compression: str = "none", rowsperstrip: int = 0, predictor: bool = False, appendto: bytes | None = None) -> bytes:
    """Pages along the first axis of 3-D gray or 4-D RGB arrays; little-endian, contiguous strips. The predictor takes
    differences along rows, or of the bytes of floats by their place. appendto: a file to which the pages are added."""
    pages = x if x.ndim == 4 or x.ndim == 3 and x.shape[-1] not in (3, 4) else x[None]
    code, pack = {"none": (1, bytes), "lzw": (5, lzw_encode), "deflate": (8, lambda b: zlib.compress(b)), "packbits": (32773, packbits_encode), "lzma": (34925, lzma_encode), "zstd": (50000, zstd_encode)}[compression]
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    if appendto is not None:
        out, link = bytearray(appendto + b"\0" * (len(appendto) % 2)), _last_link(appendto)
    for page in pages:
        h, w = page.shape[:2]
        s = 1 if page.ndim == 2 else page.shape[2]
        rows = rowsperstrip or h
        coded = np.ascontiguousarray(page)
        if predictor and page.dtype.kind == "f":
            coded = floatpred_encode(coded.reshape(h, -1), -1, s)
        elif predictor:
            coded = delta_encode(coded, 1)
        strips = [pack(coded[k : k + rows].tobytes()) for k in range(0, h, rows)]
        places = []
        for strip in strips:
            places.append(len(out))
            out += strip + b"\0" * (len(strip) % 2)
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [page.dtype.itemsize * 8] * s), (259, 3, [code]), (262, 3, [2 if s >= 3 else 1]), (273, 4, places), (277, 3, [s]), (278, 4, [rows]), (279, 4, [len(t) for t in strips]), *([(338, 3, [2])] if s in (2, 4) else []), *([(317, 3, [3 if kind == 3 else 2])] if predictor else []), (339, 3, [kind] * s)]
        tags.sort(key=lambda t: t[0])
        extra = {}
        for tag, t, values in tags:
            raw = struct.pack(f"<{len(values)}{TIFF_TYPES[t]}", *values)
            if len(raw) > 4:
                extra[tag] = len(out)
                out += raw + b"\0" * (len(raw) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for tag, t, values in tags:
            raw = struct.pack(f"<{len(values)}{TIFF_TYPES[t]}", *values)
            out += struct.pack("<HHI", tag, t, len(values)) + (struct.pack("<I", extra[tag]) if tag in extra else raw.ljust(4, b"\0"))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def tiff_pages(data: bytes) -> list[dict]:
    """The tags of every page, of classic TIFF and BigTIFF."""
    e = "<" if data[:2] in (b"II", b"EP") else ">"
    if data[:2] not in (b"II", b"MM", b"EP", b"PE"):
        raise CodecError("not a TIFF")
    e = ">" if data[:2] == b"PE" else e
    big = struct.unpack_from(e + "H", data, 2)[0] == 43
    at = struct.unpack_from(e + ("Q" if big else "I"), data, 8 if big else 4)[0]
    pages, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(e + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        tags: dict = {"byteorder": e}
        for _ in range(n):
            tag, t, count = struct.unpack_from(e + ("HHQ" if big else "HHI"), data, at)
            form = TIFF_TYPES.get(t)
            if form:
                size = struct.calcsize("<" + form) * count
                room = 8 if big else 4
                place = at + (12 if big else 8)
                if size > room:
                    place = struct.unpack_from(e + ("Q" if big else "I"), data, place)[0]
                tags[tag] = data[place : place + count] if t in (2, 7) else struct.unpack_from(f"{e}{count}{form}", data, place)
            at += 20 if big else 12
        pages.append(tags)
        at = struct.unpack_from(e + ("Q" if big else "I"), data, at)[0]
    return pages


def _tiff_page(data: bytes, t: dict) -> np.ndarray:
    w, h = t[256][0], t[257][0]
    s, bits = t.get(277, (1,))[0], t.get(258, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f", 4: "u"}[t.get(339, (1,))[0]]
    unpack = {1: bytes, 5: lzw_decode, 8: zlib.decompress, 32946: zlib.decompress, 32773: packbits_decode, 34925: lzma_decode, 50000: zstd_decode}.get(t.get(259, (1,))[0])
    fax = {2: ccittrle_decode, 3: partial(ccittfax3_decode, t4options=t.get(292, (0,))[0]), 4: ccittfax4_decode}.get(t.get(259, (1,))[0]) if bits == s == 1 else None
    if fax:
        flip = bitorder if t.get(266, (1,))[0] == 2 else bytes
        unpack = lambda raw: np.packbits(fax(flip(raw), tw), axis=1).tobytes()
    if t.get(259, (1,))[0] == 7 and bits == 8:
        stored = {2: "RGB", 6: "YCBCR", 5: "CMYK"}.get(t[262][0], None) if s > 1 and t.get(284, (1,))[0] == 1 else None
        shared = bytes(t[347]) if 347 in t else None
        unpack = lambda raw: jpeg_decode(raw, shared, colorspace=stored).tobytes()
    if unpack is None or bits not in (1, 8, 16, 32, 64):
        raise NotImplementedError("compression or depth")
    planar = t.get(284, (1,))[0] == 2 and s > 1
    tiled = 322 in t
    tw, th = (t[322][0], t[323][0]) if tiled else (w, min(t.get(278, (h,))[0], h))
    places, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    dtype = np.dtype(f"{t['byteorder']}{kind}{bits // 8}") if bits > 1 else np.dtype("u1")
    per = 1 if planar else s
    out = np.zeros((s if planar else 1, -(-h // th) * th, -(-w // tw) * tw, per), dtype.newbyteorder("="))
    across, down = -(-w // tw), -(-h // th)
    for i, (a, n) in enumerate(zip(places, sizes, strict=True)):
        raw = unpack(data[a : a + n])
        if bits == 1:
            row = (tw * per + 7) // 8
            cells = np.unpackbits(np.frombuffer(raw, np.uint8)[: len(raw) // row * row].reshape(-1, row), axis=1)[:, : tw * per]
        else:
            cells = np.frombuffer(raw, dtype)
        if t.get(317, (1,))[0] == 3:
            rows = cells.reshape(-1, tw * per).view(dtype.newbyteorder("="))
            cells = floatpred_decode(rows, -1, per)
        cells = cells.ravel()[: cells.size // (tw * per) * tw * per].reshape(-1, tw, per)
        if t.get(317, (1,))[0] == 2:
            cells = np.cumsum(cells, 1, dtype=dtype.newbyteorder("="))
        p, rest = divmod(i, across * down)
        y, x = divmod(rest, across)
        out[p, y * th : y * th + len(cells), x * tw : (x + 1) * tw] = cells
    out = out[:, :h, :w]
    return out[..., 0] if planar else out[0, ..., 0] if s == 1 else out[0]


def tiff_decode(data: bytes, index: int | None = 0) -> np.ndarray:
    pages = tiff_pages(data)
    if index is not None:
        return _tiff_page(data, pages[index])
    found = [_tiff_page(data, p) for p in pages]
    return found[0] if len(found) == 1 else np.stack(found)
