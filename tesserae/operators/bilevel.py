"""Decoders of the two-colour facsimile codings; a pixel is one byte, 0 white and 1 black."""

from __future__ import annotations

import numpy as np

from tesserae.operators.compressors import CodecError

# The code words of ITU-T T.4, for runs of 0 to 63, then 64, 128, ... 1728, then 1792 ... 2560 (both colours).
WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 "
    "0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 "
    "00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 "
    "01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 "
    "011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011"
).split()
BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 "
    "00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 "
    "000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 "
    "000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 "
    "000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 "
    "000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 "
    "0000001001100 0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 "
    "0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: Two-dimensional modes: vertical by their distance, pass and horizontal.
MODES = {"1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "0001": "pass", "001": "horizontal"}
PEEK = 13


def run_codes(words: list[str]) -> dict[str, int]:
    return {w: i if i < 64 else 64 * (i - 63) for i, w in enumerate([*words, *LONG])}


def _lookup(codes: dict) -> list:
    """For every value of the next PEEK bits, (what the code word says, its length), or None."""
    out: list = [None] * (1 << PEEK)
    for word, what in codes.items():
        first = int(word, 2) << PEEK - len(word)
        for i in range(first, first + (1 << PEEK - len(word))):
            out[i] = what, len(word)
    return out


_RUNS = _lookup(run_codes(WHITE)), _lookup(run_codes(BLACK))
_MODES = _lookup(MODES)


class _Bits:
    def __init__(self, data: bytes) -> None:
        bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.size = len(bits)
        self.ones = np.flatnonzero(bits)
        padded = np.concatenate([bits, np.zeros(PEEK, np.uint8)]).astype(np.uint16)
        ahead = np.zeros(self.size + 1, np.uint16)
        for i in range(PEEK):
            ahead = ahead << 1 | padded[i : i + self.size + 1]
        self.ahead = ahead.tolist()
        self.at = 0

    def read(self, table: list):
        found = table[self.ahead[self.at]] if self.at < self.size else None
        if found is None or self.at + found[1] > self.size:
            raise CodecError(f"no code word at bit {self.at}")
        self.at += found[1]
        return found[0]

    def run(self, color: int) -> int:
        total = 0
        while True:
            n = self.read(_RUNS[color])
            total += n
            if n < 64:
                return total

    @property
    def done(self) -> bool:
        """Whether only zeros are left: every code word has a one."""
        return not len(self.ones) or self.at > self.ones[-1]

    def end_of_line(self) -> bool:
        """Whether 11 zeros or more and a one come next; they are then passed."""
        if self.done:
            return False
        one = int(self.ones[np.searchsorted(self.ones, self.at)])
        if one - self.at < 11:
            return False
        self.at = one + 1
        return True


def _change(row: list[int], at: int) -> None:
    """Adds a change of colour; two at one place are none."""
    if row and row[-1] == at:
        row.pop()
    else:
        row.append(at)


def _one_dimensional(bits: _Bits, width: int) -> list[int]:
    row: list[int] = []
    at = color = 0
    while at < width:
        at += bits.run(color)
        if at > width:
            raise CodecError("a run passes the end of its row")
        _change(row, at)
        color ^= 1
    return row


def _two_dimensional(bits: _Bits, width: int, above: list[int]) -> list[int]:
    row: list[int] = []
    at, color, k = -1, 0, 0
    above = [*above, width, width, width]
    while at < width:
        mode = bits.read(_MODES)
        if mode == "horizontal":
            at = max(at, 0)
            for c in (color, color ^ 1):
                at += bits.run(c)
                _change(row, at)
        else:
            # the first change above, right of here, away from this colour
            while k and above[k - 1] > at:
                k -= 1
            while above[k] <= at and above[k] < width or k % 2 != color and above[k] < width:
                k += 1
            if mode == "pass":
                at = above[k + 1]
                continue
            if not max(at, 0) <= above[k] + mode <= width:
                raise CodecError("a change lies outside its row")
            at = above[k] + mode
            _change(row, at)
            color ^= 1
        if at > width:
            raise CodecError("a run passes the end of its row")
    return row


def _image(rows: list[list[int]], height: int, width: int) -> np.ndarray:
    """Rows that are not there stay white."""
    out = np.zeros((height or len(rows), width), np.uint8)
    for line, row in zip(out, rows):
        for start, stop in zip(row[::2], [*row[1::2], width]):
            line[start:stop] = 1
    return out


def _sized(width: int) -> None:
    if width <= 0:
        raise ValueError("width is required")


def ccittrle_decode(data: bytes, width: int = 0, height: int = 0) -> np.ndarray:
    """Modified Huffman rows, each from a whole byte."""
    _sized(width)
    bits, rows = _Bits(data), []
    while not bits.done and (not height or len(rows) < height):
        rows.append(_one_dimensional(bits, width))
        bits.at = -(-bits.at // 8) * 8
    return _image(rows, height, width)


def ccittfax3_decode(data: bytes, width: int = 0, height: int = 0, t4options: int = 0) -> np.ndarray:
    """T.4 rows; bit 0 of t4options says that rows may refer to the one above. Two ends of line together end the image."""
    _sized(width)
    bits, rows = _Bits(data), []
    above: list[int] = []
    while not height or len(rows) < height:
        marked, plain = bits.end_of_line(), True
        if bits.done:
            break
        if marked:
            if t4options & 1:
                plain = bits.ahead[bits.at] >> PEEK - 1 == 1
                bits.at += 1
            if bits.end_of_line():
                break
        above = _one_dimensional(bits, width) if plain else _two_dimensional(bits, width, above)
        rows.append(above)
    return _image(rows, height, width)


def ccittfax4_decode(data: bytes, width: int = 0, height: int = 0) -> np.ndarray:
    """T.6 rows, to the end-of-block mark or the end of the data."""
    _sized(width)
    bits, rows = _Bits(data), []
    above: list[int] = []
    while not (bits.done or bits.end_of_line()) and (not height or len(rows) < height):
        above = _two_dimensional(bits, width, above)
        rows.append(above)
    return _image(rows, height, width)
