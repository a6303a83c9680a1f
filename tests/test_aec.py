import numpy as np
import pytest

from tesserae.operators import aec


@pytest.mark.parametrize("bits", (1, 2, 3, 5, 8, 12, 16, 20, 24, 32))
@pytest.mark.parametrize("flags", (0, aec.PREPROCESS, aec.PREPROCESS | aec.SIGNED, aec.PREPROCESS | aec.MSB | aec.PAD_RSI, aec.PREPROCESS | aec.RESTRICTED | aec.THREE_BYTES))
def test_aec_round_trip(bits, flags):
    own = np.random.default_rng(bits)
    width = aec._width(bits, flags)
    walk = np.cumsum(own.integers(-2, 3, 600)) + (1 << bits) // 2
    for x in (walk, own.integers(0, 1 << bits, 177), np.zeros(2500, int), np.r_[np.zeros(1000, int), own.integers(0, 1 << bits, 100), np.zeros(300, int)], own.integers(0, 2, 1), own.integers(0, 2, 0)):
        data = aec._bytes(x & (1 << bits) - 1, bits, flags)
        for blocksize, rsi in ((8, 16), (16, 128), (64, 1)):
            made = aec.aec_encode(data, bits, flags, blocksize, rsi)
            assert aec.aec_decode(made, bits, flags, blocksize, rsi, len(data)) == data
            if len(x) % blocksize == 0 and not flags & aec.PAD_RSI:
                assert aec.aec_decode(made, bits, flags, blocksize, rsi) == data
    assert width * 5000 > 20 * len(aec.aec_encode(bytes(width * 5000), bits, flags, 16, 128))


def test_szip_known():
    # A published frame of 256 ones.
    data = b"\x00\x02\x00\x00" + (b"\x15" + b"U" * 7 + b"Q" + b"U" * 8) * 4
    ones = np.ones(256, "u2").tobytes()
    own = {"options_mask": 141, "pixels_per_block": 32, "bits_per_pixel": 16, "pixels_per_scanline": 256, "header": True}
    assert aec.szip_encode(ones, **own) == data and aec.szip_decode(data, **own) == ones
    own.pop("header")
    assert aec.szip_params(np.ones(256, "u2"), 1 | 4 | 128, 32) == own


def test_szip_params():
    assert aec.szip_params(np.empty((2, 8192, 4), "u1")) == {"options_mask": 12, "pixels_per_block": 32, "bits_per_pixel": 32, "pixels_per_scanline": 4096}
    assert aec.szip_params(np.empty(4, "f8")) == {"options_mask": 12, "pixels_per_block": 4, "bits_per_pixel": 64, "pixels_per_scanline": 4}
    assert aec.szip_params(np.empty((256, 256), "u2"), 1 | 4 | 128, 16) == {"options_mask": 141, "pixels_per_block": 16, "bits_per_pixel": 16, "pixels_per_scanline": 256}
    with pytest.raises(ValueError):
        aec.szip_params(np.empty(4), pixels_per_block=3)


@pytest.mark.parametrize("bits", (8, 16, 32, 64))
@pytest.mark.parametrize("mask", (141, 12 | 32, 16 | 4 | 32))
def test_szip_round_trip(bits, mask):
    own = np.random.default_rng(3)
    for n in (0, bits // 8, 4000, 4096):
        data = own.integers(0, 255, n // (bits // 8) * (bits // 8), "u1").tobytes()
        for block, line in ((8, 64), (32, 100), (2, 7), (32, 4096)):
            made = aec.szip_encode(data, mask, block, bits, line)
            assert aec.szip_decode(made, mask, block, bits, line) == data
