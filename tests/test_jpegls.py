import numpy as np
import pytest

from tesserae.operators import jpegls
from tesserae.operators.compressors import CodecError

OWN = np.random.default_rng(1)
WALK = (np.cumsum(OWN.integers(-3, 4, (40, 50)), 1) + 128).clip(0, 255).astype("u1")


def test_thresholds():
    # The defaults for 8 bits, and the limits of the rule.
    assert jpegls.thresholds(255, 0) == (3, 7, 21) and jpegls.thresholds(65535, 0) == (18, 67, 276) and jpegls.thresholds(255, 2) == (9, 17, 35)


@pytest.mark.parametrize("near", (0, 1, 3))
@pytest.mark.parametrize(
    "x",
    (
        WALK,
        OWN.integers(0, 256, (17, 23), "u1"),
        np.zeros((9, 30), "u1"),
        np.repeat(OWN.integers(0, 256, (10, 5), "u1"), 20, 1),
        OWN.integers(0, 65536, (13, 11), "u2"),
        np.stack([WALK, 255 - WALK, WALK // 2], -1),
        OWN.integers(0, 2, (30, 64), "u1") * 255,
        np.full((3, 1), 255, "u1"),
        (OWN.integers(0, 40, (30, 64)) == 0).astype("u1") * 7,
        (np.add.outer(np.arange(90), np.arange(130)) * 37 % 4096).astype("u2"),
    ),
)
def test_jpegls_round_trip(x, near):
    made = jpegls.jpegls_encode(x, near)
    back = jpegls.jpegls_decode(made)
    assert made[:4] == b"\xff\xd8\xff\xf7" and made[-2:] == b"\xff\xd9"
    assert back.shape == x.shape and back.dtype == x.dtype and np.abs(back.astype(int) - x).max() <= near


def test_no_marker_within_the_data():
    made = jpegls.jpegls_encode(OWN.integers(0, 256, (60, 60), "u1"))
    body = made[made.index(b"\xff\xda") + 10 : -2]
    assert all(body[i + 1] < 128 for i in range(len(body) - 1) if body[i] == 255) and body[-1] != 255


def test_jpegls_shrinks_and_refuses():
    assert len(jpegls.jpegls_encode(WALK)) < WALK.nbytes / 2 and len(jpegls.jpegls_encode(WALK, 2)) < len(jpegls.jpegls_encode(WALK))
    for bad in (b"", b"\xff\xd8\xff\xd9", jpegls.jpegls_encode(WALK)[:40]):
        with pytest.raises(CodecError):
            jpegls.jpegls_decode(bad)
    with pytest.raises(ValueError):
        jpegls.jpegls_encode(np.zeros((3, 3), "f4"))
