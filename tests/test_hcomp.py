import numpy as np
import pytest

from tesserae.operators import hcomp
from tesserae.operators.compressors import CodecError

OWN = np.random.default_rng(1)
SMOOTH = (np.cumsum(np.cumsum(OWN.integers(-2, 3, (64, 80)), 0), 1)).astype("i4")


@pytest.mark.parametrize("x", (SMOOTH, OWN.integers(-1000, 1000, (17, 23)).astype("i2"), OWN.integers(0, 256, (4, 4), "u1"), OWN.integers(0, 256, (5, 64), "u1"), OWN.integers(-(2**31), 2**31, (9, 8)).astype("i4"), np.zeros((6, 7), "i4"), np.full((33, 4), -5, "i2")))
def test_hcomp_round_trip(x):
    for level in (0, 1):
        made = hcomp.hcomp_encode(x, level)
        assert made[:2] == b"\xdd\x99" and (hcomp.hcomp_decode(made, x.dtype.str) == x).all()


def test_hcomp_with_loss():
    sizes = [len(hcomp.hcomp_encode(SMOOTH, s)) for s in (0, 4, 16)]
    assert sizes[0] > sizes[1] > sizes[2]
    for s in (4, 16):
        assert np.abs(hcomp.hcomp_decode(hcomp.hcomp_encode(SMOOTH, s)) - SMOOTH).max() <= 4 * s


def test_hcomp_refuses():
    for bad in (np.zeros((3, 9), "i4"), np.zeros((9, 9), "f4"), np.zeros((9, 9), "i8"), np.zeros(9, "i4")):
        with pytest.raises(ValueError):
            hcomp.hcomp_encode(bad)
    made = hcomp.hcomp_encode(SMOOTH)
    for bad in (b"", b"xx" + made[2:], made[:40]):
        with pytest.raises(CodecError):
            hcomp.hcomp_decode(bad)
