"""Adaptive entropy coding after CCSDS 121.0-B, and the SZIP form of it."""

from __future__ import annotations

import numpy as np

from tesserae.operators.compressors import CodecError

# Flags of the coder, and of SZIP's options.
SIGNED, THREE_BYTES, MSB, PREPROCESS, RESTRICTED, PAD_RSI = 1, 2, 4, 8, 16, 32
SZIP = {"ALLOW_K13": 1, "CHIP": 2, "EC": 4, "LSB": 8, "MSB": 16, "NN": 32, "RAW": 128}
#: Blocks that a run of zero blocks may reach over, and the run length that stands for the rest of them.
SEGMENT, REST = 64, 4


def _width(bits: int, flags: int) -> int:
    return 1 if bits <= 8 else 2 if bits <= 16 else 3 if bits <= 24 and flags & THREE_BYTES else 4


def _id_bits(bits: int, flags: int) -> int:
    if flags & RESTRICTED and bits <= 4:
        return 1 if bits <= 2 else 2
    return 3 if bits <= 8 else 4 if bits <= 16 else 5


def _samples(data: bytes, bits: int, flags: int) -> np.ndarray:
    width = _width(bits, flags)
    raw = np.frombuffer(data, np.uint8)[: len(data) // width * width].reshape(-1, width).astype(np.int64)
    weights = 1 << 8 * np.arange(width)
    x = raw @ (weights[::-1] if flags & MSB else weights)
    x &= (1 << bits) - 1
    return np.where(x >> bits - 1, x - (1 << bits), x) if flags & SIGNED else x


def _bytes(x: np.ndarray, bits: int, flags: int) -> bytes:
    width = _width(bits, flags)
    shifts = 8 * np.arange(width)
    return (x[:, None] >> (shifts[::-1] if flags & MSB else shifts) & 255).astype(np.uint8).tobytes()


def _range(bits: int, flags: int) -> tuple[int, int]:
    return (-(1 << bits - 1), (1 << bits - 1) - 1) if flags & SIGNED else (0, (1 << bits) - 1)


def _residuals(x: np.ndarray, bits: int, flags: int) -> np.ndarray:
    """Differences from the sample before, folded to what the range lets through; the first is 0."""
    low, high = _range(bits, flags)
    before, now = x[:-1], x[1:]
    room = np.minimum(before - low, high - before)
    d = now - before
    folded = np.where(np.abs(d) <= room, np.where(d >= 0, 2 * d, -2 * d - 1), room + np.abs(d))
    return np.r_[0, folded]


def _options(bitspersample: int, blocksize: int, rsi: int) -> None:
    if not 1 <= bitspersample <= 32 or blocksize not in (8, 16, 32, 64) and not 0 < blocksize <= 64 or blocksize % 2 or not 1 <= rsi <= 4096:
        raise ValueError("bitspersample, blocksize or rsi out of range")


def aec_encode(data: bytes, bitspersample: int = 8, flags: int = PREPROCESS, blocksize: int = 8, rsi: int = 16) -> bytes:
    """Each block by the shortest of: a run of zero blocks, pairs, split samples, or as it is. The last block is filled up
    with its last sample."""
    _options(bitspersample, blocksize, rsi)
    bits, x = bitspersample, _samples(data, bitspersample, flags)
    if not len(x):
        return b""
    x = np.r_[x, np.full(-len(x) % blocksize, x[-1])]
    name, mask = _id_bits(bits, flags), (1 << bits) - 1
    most = (1 << name) - 3
    form = lambda v, n: format(v, f"0{n}b") if n else ""
    out: list[str] = []
    size = 0
    for a in range(0, len(x), blocksize * rsi):
        part = x[a : a + blocksize * rsi]
        coded = _residuals(part, bits, flags) if flags & PREPROCESS else part & mask
        blocks = coded.reshape(-1, blocksize)
        begin, run, run_ref = len(out), 0, ""
        for b, block in enumerate(blocks):
            ref = form(int(part[0]) & mask, bits) if flags & PREPROCESS and b == 0 else ""
            if not block.any():
                run_ref = ref if run == 0 else run_ref
                run += 1
                if (b + 1) % SEGMENT == 0 or b + 1 == len(blocks):
                    full = (b + 1) % SEGMENT == 0 or b + 1 == rsi
                    out.append("0" * (name + 1) + run_ref + "0" * (REST if run > 4 and full else run if run > 4 else run - 1) + "1")
                    run = 0
                continue
            if run:
                out.append("0" * (name + 1) + run_ref + "0" * (run if run > 4 else run - 1) + "1")
                run = 0
            skip = 1 if ref else 0
            own = block[skip:]
            k = np.arange(max(most, 0) + 1)
            split = (own[None] >> k[:, None]).sum(1) + len(own) * (k + 1)
            best = int(split.argmin())
            sums = np.minimum(block[::2] + block[1::2], 1 << 20)  # larger ones never pay
            pairs = sums * (sums + 1) // 2 + block[1::2]
            as_is, second = len(own) * bits, int(pairs.sum()) + len(pairs) + 1
            split_bits = int(split[best]) if most >= 0 else 1 << 62
            if split_bits < as_is and split_bits < second:
                high = own >> best
                low = "".join(form(int(v), best) for v in own & (1 << best) - 1) if best else ""
                out.append(form(best + 1, name) + ref + "".join("0" * int(v) + "1" for v in high) + low)
            elif as_is <= second:
                out.append("1" * name + ref + "".join(form(int(v), bits) for v in own))
            else:
                out.append("0" * name + "1" + ref + "".join("0" * int(v) + "1" for v in pairs))
        if flags & PAD_RSI:
            size += sum(map(len, out[begin:]))
            out.append("0" * (-size % 8))
            size += len(out[-1])
    made = "".join(out)
    made += "0" * (-len(made) % 8)
    return int(made, 2).to_bytes(len(made) // 8, "big")


def aec_decode(data: bytes, bitspersample: int = 8, flags: int = PREPROCESS, blocksize: int = 8, rsi: int = 16, size: int | None = None) -> bytes:
    """size: bytes to give; without it, all blocks (the last may be filled up)."""
    _options(bitspersample, blocksize, rsi)
    bits, name = bitspersample, _id_bits(bitspersample, flags)
    wanted = None if size is None else -(-size // _width(bits, flags))
    text = format(int.from_bytes(data, "big"), f"0{8 * len(data)}b") if data else ""
    low, high = _range(bits, flags)
    parts: list[np.ndarray] = []
    at, done, ended = 0, 0, False

    def number(n: int) -> int:
        nonlocal at
        if at + n > len(text):
            raise EOFError
        at += n
        return int(text[at - n : at], 2) if n else 0

    def unary() -> int:
        nonlocal at
        one = text.find("1", at)
        if one < 0:
            raise EOFError
        n, at = one - at, one + 1
        return n

    while not ended and (wanted is None or done < wanted):
        values: list[int] = []
        reference = None
        blocks = 0
        try:
            while blocks < rsi and (wanted is None or done + len(values) < wanted):
                kind = number(name)
                second = kind == 0 and number(1)
                first = flags & PREPROCESS and blocks == 0
                if first:
                    reference = number(bits)
                if kind == 0 and not second:
                    run = unary()
                    n = min(rsi - blocks, SEGMENT - blocks % SEGMENT) if run == REST else run if run > REST else run + 1
                    if n > rsi - blocks:
                        raise CodecError("a run of zero blocks goes on too far")
                    values += [0] * (n * blocksize)
                    blocks += n
                    continue
                own = [0] if first else []
                if kind == 0:
                    own = []
                    for _ in range(blocksize // 2):
                        m = unary()
                        s = int(((8 * m + 1) ** 0.5 - 1) / 2)
                        while s * (s + 1) // 2 > m:
                            s -= 1
                        while (s + 1) * (s + 2) // 2 <= m:
                            s += 1
                        b = m - s * (s + 1) // 2
                        own += [s - b, b]
                elif kind == (1 << name) - 1:
                    own += [number(bits) for _ in range(blocksize - len(own))]
                else:
                    k = kind - 1
                    top = [unary() for _ in range(blocksize - len(own))]
                    own += [t << k | number(k) for t in top]
                values += own
                blocks += 1
        except EOFError:
            if size is not None:
                raise CodecError("the data end early") from None
            ended = True
        if not values:
            break
        if flags & PREPROCESS:
            x = reference - (1 << bits) if flags & SIGNED and reference >> bits - 1 else reference
            whole = [x]
            for d in values[1:]:
                room = min(x - low, high - x)
                if d <= 2 * room:
                    x += d >> 1 if d % 2 == 0 else -(d + 1 >> 1)
                else:
                    x += d - room if room == x - low else room - d
                whole.append(x)
            values = whole
        parts.append(np.array(values, np.int64))
        done += len(values)
        if flags & PAD_RSI:
            at += -at % 8
    out = _bytes(np.concatenate(parts) & (1 << bits) - 1 if parts else np.zeros(0, np.int64), bits, flags)
    return out if size is None else out[:size]


# ---- SZIP ----


def _szip(options_mask: int, pixels_per_block: int, bits_per_pixel: int, pixels_per_scanline: int) -> tuple[int, int, int, int]:
    """Bits, flags, interval and bytes of a pixel that the coder sees."""
    if not 0 < pixels_per_block <= 32 or pixels_per_block % 2 or not 0 < bits_per_pixel <= 64 or not 0 < pixels_per_scanline <= 4096:
        raise ValueError("SZIP parameters out of range")
    wide = bits_per_pixel in (32, 64)
    bits = 8 if wide else bits_per_pixel
    flags = (MSB if options_mask & SZIP["MSB"] else 0) | (PREPROCESS if options_mask & SZIP["NN"] else 0)
    return bits, flags, -(-pixels_per_scanline // pixels_per_block), bits_per_pixel // 8 if wide else _width(bits, flags)


def szip_encode(data: bytes, options_mask: int = 141, pixels_per_block: int = 32, bits_per_pixel: int = 8, pixels_per_scanline: int = 256, header: bool = True) -> bytes:
    """Pixels of 32 and 64 bits are coded by the planes of their bytes; lines are filled up to whole blocks. The header
    holds the size of the data."""
    data = bytes(data)
    bits, flags, interval, size = _szip(options_mask, pixels_per_block, bits_per_pixel, pixels_per_scanline)
    raw = np.frombuffer(data, np.uint8)
    if bits_per_pixel in (32, 64):
        n = len(raw) // size
        raw = np.r_[raw[: n * size].reshape(n, size).T.ravel(), raw[n * size :]]
        size = 1
    rest = -pixels_per_scanline % pixels_per_block
    if rest and len(raw):
        x = raw[: len(raw) // size * size].reshape(-1, size)
        lines = [x[a : a + pixels_per_scanline] for a in range(0, len(x), pixels_per_scanline)]
        fill = pixels_per_scanline + rest
        raw = np.concatenate([np.r_[line, np.repeat(line[-1:] if flags & PREPROCESS else line[-1:] * 0, fill - len(line), 0)] for line in lines]).ravel()
    made = aec_encode(raw.tobytes(), bits, flags, pixels_per_block, interval)
    return (len(data).to_bytes(4, "little") if header else b"") + made


def szip_decode(data: bytes, options_mask: int = 141, pixels_per_block: int = 32, bits_per_pixel: int = 8, pixels_per_scanline: int = 256, header: bool = True, size: int | None = None) -> bytes:
    bits, flags, interval, width = _szip(options_mask, pixels_per_block, bits_per_pixel, pixels_per_scanline)
    if header:
        size, data = int.from_bytes(data[:4], "little"), data[4:]
    wide = bits_per_pixel in (32, 64)
    one = 1 if wide else width
    rest = -pixels_per_scanline % pixels_per_block
    if not rest:
        out = aec_decode(data, bits, flags, pixels_per_block, interval, size)
    else:
        line = (pixels_per_scanline + rest) * one
        lines = None if size is None else -(-size // (pixels_per_scanline * one))
        raw = aec_decode(data, bits, flags, pixels_per_block, interval, None if lines is None else lines * line)
        out = b"".join(raw[a : a + pixels_per_scanline * one] for a in range(0, len(raw), line))
        out = out if size is None else out[:size]
    if wide:
        raw = np.frombuffer(out, np.uint8)
        n = len(raw) // width
        out = raw[: n * width].reshape(width, n).T.tobytes() + out[n * width :]
    return out


def szip_params(x: np.ndarray, options_mask: int = 4, pixels_per_block: int = 32) -> dict[str, int]:
    """Parameters that suit an array: short last axes of 4 or 8 bytes count as one pixel."""
    if not 2 <= pixels_per_block <= 32 or pixels_per_block % 2:
        raise ValueError(f"pixels_per_block {pixels_per_block}")
    pixels, bits, line = x.size, x.itemsize * 8, x.shape[-1] if x.ndim else 1
    if x.ndim > 1 and x.shape[-1] * x.itemsize in (4, 8):
        pixels, bits, line = pixels // x.shape[-1], bits * x.shape[-1], x.shape[-2]
    if line < pixels_per_block:
        pixels_per_block = min(pixels_per_block, max(2, pixels // 2 * 2)) if pixels < pixels_per_block else pixels_per_block
        line = pixels_per_block
    order = SZIP["MSB"] if x.dtype.str[0] == ">" else SZIP["LSB"]
    mask = options_mask & ~(SZIP["LSB"] | SZIP["MSB"]) | order
    return {"options_mask": mask, "pixels_per_block": pixels_per_block, "bits_per_pixel": bits, "pixels_per_scanline": min(line, pixels_per_block * 128)}
