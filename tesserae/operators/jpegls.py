"""JPEG-LS (ITU-T T.87): lossless and near-lossless images. One model serves both ways: a coder writes the numbers it is
given, or reads them."""

from __future__ import annotations

import struct

import numpy as np

from tesserae.operators.compressors import CodecError

# Run lengths by order (powers of two), the interval of halving, and the basic thresholds.
RUNS = [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4 + [4, 4, 5, 5, 6, 6, 7, 7, 8, 9, 10, 11, 12, 13, 14, 15]
RESET = 64
BASIC = (3, 7, 21)


def thresholds(top: int, near: int) -> tuple[int, int, int]:
    """Where gradients change their class, for samples up to `top`."""
    keep = lambda v, low: low if v > top or v < low else v
    out, low = [], near + 1
    for i, basic in enumerate(BASIC):
        if top >= 128:
            v = (min(top, 4095) + 128) // 256 * (basic - 2 - i) + 2 + i + (3 + 2 * i) * near
        else:
            v = max(2 + i, basic // (256 // (top + 1)) + (3 + 2 * i) * near)
        low = keep(v, low)
        out.append(low)
    return tuple(out)


class Writer:
    """Bits, the highest first; the byte after 255 has seven."""

    def __init__(self):
        self.out, self.held, self.room = bytearray(), 0, 8

    def bits(self, n: int, value: int = 0) -> int:
        for i in range(n - 1, -1, -1):
            self.held = self.held << 1 | value >> i & 1
            self.room -= 1
            if not self.room:
                self._byte()
        return value

    def _byte(self) -> None:
        self.out.append(self.held)
        self.room = 7 if self.held == 255 else 8
        self.held = 0

    def zeros(self, n: int = 0) -> int:
        self.bits(n)
        self.bits(1, 1)
        return n

    def done(self) -> bytes:
        if self.room != (7 if self.out and self.out[-1] == 255 else 8):
            self.held <<= self.room
            self._byte()
        if self.out and self.out[-1] == 255:
            self.out.append(0)
        return bytes(self.out)


class Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.held, self.left = data, at, 0, 0

    def bits(self, n: int, value: int = 0) -> int:
        out = 0
        for _ in range(n):
            if not self.left:
                if self.at >= len(self.data) or self.at and self.data[self.at - 1] == 255 and self.held == 255 and self.data[self.at] > 127:
                    raise CodecError("the data end early")
                self.left = 7 if self.held == 255 and self.at and self.data[self.at - 1] == 255 else 8
                self.held = self.data[self.at]
                self.at += 1
            self.left -= 1
            out = out << 1 | self.held >> self.left & 1
        return out

    def zeros(self, n: int = 0) -> int:
        count = 0
        while not self.bits(1):
            count += 1
            if count > 1 << 16:
                raise CodecError("a number without an end")
        return count


class Model:
    """What one scan of planes shares: parameters, and the counts of the contexts."""

    def __init__(self, top: int, near: int, limits: tuple[int, int, int] | None = None, reset: int = RESET):
        self.top, self.near, self.step, self.reset = top, near, 2 * near + 1, reset
        self.limits = limits or thresholds(top, near)
        self.range = (top + 2 * near) // self.step + 1
        self.wide = (self.range - 1).bit_length()
        bits = max(2, top.bit_length())
        self.longest = 2 * (bits + max(8, bits))
        first = max(2, (self.range + 32) // 64)
        self.a, self.b, self.c, self.n = [first] * 367, [0] * 365, [0] * 365, [1] * 367
        self.under = [0, 0]

    def kind(self, d: int) -> int:
        t1, t2, t3 = self.limits
        m = abs(d)
        q = 0 if m <= self.near else 1 if m < t1 else 2 if m < t2 else 3 if m < t3 else 4
        return q if d > 0 else -q

    def number(self, coder, k: int, longest: int, value: int) -> int:
        """A number, by its high part in zeros and k low bits; or as it is, if that is too long."""
        most = longest - self.wide - 1
        high = value >> k
        high = coder.zeros(high if high < most else most)
        if high < most:
            return high << k | coder.bits(k, value & (1 << k) - 1)
        return coder.bits(self.wide, value - 1) + 1

    def folded(self, error: int) -> int:
        """An error in steps, within the range."""
        if self.near:
            error = (error + self.near) // self.step if error > 0 else -((self.near - error) // self.step)
        error = error + self.range if error < 0 else error
        return error - self.range if error >= (self.range + 1) // 2 else error

    def sample(self, guess: int, error: int) -> int:
        v = guess + error * self.step
        if v < -self.near:
            v += self.range * self.step
        elif v > self.top + self.near:
            v -= self.range * self.step
        return min(max(v, 0), self.top)

    def halved(self, q: int) -> bool:
        if self.n[q] != self.reset:
            self.n[q] += 1
            return False
        self.a[q] >>= 1
        self.n[q] = (self.n[q] >> 1) + 1
        return True

    def regular(self, coder, q: int, sign: int, guess: int, x: int) -> int:
        guess = min(max(guess + sign * self.c[q], 0), self.top)
        error = self.folded(sign * (x - guess))
        k = 0
        while self.n[q] << k < self.a[q]:
            k += 1
        turned = not self.near and k == 0 and 2 * self.b[q] <= -self.n[q]
        value = (2 * error + 1 if error >= 0 else -2 * (error + 1)) if turned else (2 * error if error >= 0 else -2 * error - 1)
        value = self.number(coder, k, self.longest, value)
        if turned:
            error = value // 2 if value % 2 else -(value // 2) - 1
        else:
            error = value // 2 if value % 2 == 0 else -(value + 1) // 2
        b = self.b[q] + error * self.step
        self.a[q] += abs(error)
        if self.halved(q):
            b = b >> 1 if b >= 0 else -(1 - b >> 1)
        n = self.n[q]
        if b <= -n:
            b = max(b + n, 1 - n)
            self.c[q] = max(self.c[q] - 1, -128)
        elif b > 0:
            b = min(b - n, 0)
            self.c[q] = min(self.c[q] + 1, 127)
        self.b[q] = b
        return self.sample(guess, sign * error)

    def interruption(self, coder, left: int, above: int, run: int, x: int) -> int:
        same = int(abs(left - above) <= self.near)
        guess, sign = (left, 1) if same else (above, -1 if left > above else 1)
        error = self.folded(sign * (x - guess))
        q = 365 + same
        size = self.a[q] + (self.n[q] >> 1 if same else 0)
        k = 0
        while self.n[q] << k < size:
            k += 1
        many = 2 * self.under[same] >= self.n[q]
        mark = int(k == 0 and error > 0 and not many or error < 0 and (many or k != 0))
        value = self.number(coder, k, self.longest - RUNS[run] - 1, 2 * abs(error) - same - mark)
        mark, size = value + same & 1, value + same + 1 >> 1
        error = -size if (k != 0 or many) == bool(mark) else size
        self.under[same] += error < 0
        self.a[q] += value + 1 - same >> 1
        if self.halved(q):
            self.under[same] >>= 1
        return self.sample(guess, sign * error)


def _line(model: Model, coder, line, above: list[int], before: int, run: int) -> tuple[list[int], int]:
    """One line (None: to be read) below `above`; before is what stands left of `above`. Gives the line and the run order."""
    width = len(above)
    out: list[int] = []
    at = 0
    while at < width:
        left = out[at - 1] if at else above[0]
        b = above[at]
        c = above[at - 1] if at else before
        d = above[at + 1] if at + 1 < width else b
        q1, q2, q3 = model.kind(d - b), model.kind(b - c), model.kind(c - left)
        if q1 or q2 or q3:
            q = 81 * q1 + 9 * q2 + q3
            sign = 1 if q > 0 else -1
            guess = min(left, b) if c >= max(left, b) else max(left, b) if c <= min(left, b) else left + b - c
            out.append(model.regular(coder, abs(q), sign, guess, line[at] if line is not None else 0))
            at += 1
            continue
        n = 0
        if line is not None:
            while at + n < width and abs(line[at + n] - left) <= model.near:
                n += 1
        rest, gone = n, 0
        while True:
            block = 1 << RUNS[run]
            more = coder.bits(1, int(rest >= block or line is not None and at + n == width and rest > 0))
            if more:
                taken = min(block, width - at - gone)
                gone += taken
                rest -= taken
                if taken == block:
                    run = min(run + 1, 31)
                if at + gone == width:
                    break
                continue
            gone += coder.bits(RUNS[run], rest)
            break
        if at + gone > width:
            raise CodecError("a run beyond the line")
        out += [left] * gone
        at += gone
        if at < width:
            out.append(model.interruption(coder, left, above[at], run, line[at] if line is not None else 0))
            at += 1
            run = max(run - 1, 0)
    return out, run


def jpegls_encode(x: np.ndarray, level: int | None = None) -> bytes:
    """Gray rows, or rows of up to 255 samples a pixel, of 8 or 16 bits; level: the largest error of a sample. Each
    sample is a scan of its own."""
    x = np.asarray(x)
    if x.dtype not in (np.uint8, np.uint16) or x.ndim not in (2, 3) or not x.size or max(x.shape[:2]) > 65535:
        raise ValueError("rows of 8 or 16 bits")
    near = level or 0
    planes = [x] if x.ndim == 2 else [x[..., i] for i in range(x.shape[-1])]
    top = 255 if x.dtype == np.uint8 else 65535
    out = bytearray(b"\xff\xd8\xff\xf7" + struct.pack(">HBHHB", 8 + 3 * len(planes), x.dtype.itemsize * 8, *x.shape[:2], len(planes)))
    out += b"".join(bytes((i + 1, 0x11, 0)) for i in range(len(planes)))
    for i, plane in enumerate(planes):
        out += b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, i + 1, 0, near, 0, 0)
        coder, model = Writer(), Model(top, near)
        above, before, run = [0] * x.shape[1], 0, 0
        for line in plane.tolist():
            made, run = _line(model, coder, line, above, before, run)
            before, above = above[0], made
        out += coder.done()
    return bytes(out + b"\xff\xd9")


def jpegls_decode(data: bytes) -> np.ndarray:
    data = bytes(data)
    if data[:2] != b"\xff\xd8":
        raise CodecError("not a JPEG-LS image")
    at, shape, planes, limits, reset = 2, None, {}, None, RESET
    names: list[int] = []
    while at + 4 <= len(data) and data[at : at + 2] != b"\xff\xd9":
        if data[at] != 255:
            raise CodecError("no marker")
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xF7:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            shape, names, top = (height, width), [body[6 + 3 * i] for i in range(n)], (1 << bits) - 1
        elif mark == 0xF8 and body[0] == 1:
            own, *three, new = struct.unpack_from(">5H", body, 1)
            top, reset = own or top, new or RESET
            limits = tuple(three) if all(three) else None
        elif mark == 0xDA:
            if shape is None:
                raise CodecError("a scan before the frame")
            n = body[0]
            near, mode = body[1 + 2 * n], body[2 + 2 * n]
            if mode == 2 and n > 1:
                raise NotImplementedError("samples that take turns")
            coder, model = Reader(data, at), Model(top, near, limits, reset)
            state = {body[1 + 2 * i]: [[0] * shape[1], 0, 0, []] for i in range(n)}
            for _ in range(shape[0]):
                for s in state.values():
                    made, s[2] = _line(model, coder, None, s[0], s[1], s[2])
                    s[1], s[0] = s[0][0], made
                    s[3].append(made)
            planes |= {k: s[3] for k, s in state.items()}
            at = coder.at + (coder.held == 255 and data[coder.at - 1] == 255 and coder.at < len(data) and data[coder.at] < 128)
    if not planes or set(planes) != set(names):
        raise CodecError("no image")
    out = [np.array(planes[k], np.uint8 if top < 256 else np.uint16) for k in names]
    return out[0] if len(out) == 1 else np.stack(out, -1)
