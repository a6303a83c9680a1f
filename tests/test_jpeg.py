import numpy as np
import pytest

from tesserae.operators import jpeg as J
from tesserae.operators import lossless as L
from tesserae.operators.compressors import CodecError


def picture(h, w, n=3):
    y, x = np.mgrid[:h, :w]
    bands = [128 + 100 * np.sin(x / 17 + k) * np.cos(y / 23 - k) + 20 * ((x // 16 + y // 16) % 2) for k in range(n)]
    return np.clip(np.stack(bands, -1), 0, 255).astype(np.uint8)


def close(a, b, mean, most=255):
    d = np.abs(a.astype(int) - b.astype(int))
    return a.shape == b.shape and d.mean() <= mean and d.max() <= most


def test_zigzag():
    assert J.ZIGZAG[:11] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32] and sorted(J.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("shape", ((1, 1), (8, 8), (33, 47), (64, 80)))
@pytest.mark.parametrize("subsampling", (None, "444", "422", "420", "411", "440", (2, 1)))
def test_rgb_round_trip(shape, subsampling):
    x = picture(*shape)
    assert close(J.jpeg8_decode(J.jpeg8_encode(x, 98, subsampling=subsampling)), x, 4)


@pytest.mark.parametrize("level, mean", ((100, 0.6), (90, 3), (20, 12)))
def test_gray_rgb_and_cmyk(level, mean):
    x = picture(40, 50, 4)
    assert close(J.jpeg8_decode(J.jpeg8_encode(x[..., 0], level)), x[..., 0], mean)
    assert close(J.jpeg8_decode(J.jpeg8_encode(x, level)), x, mean)
    assert close(J.jpeg8_decode(J.jpeg8_encode(x[..., :3], level, outcolorspace="RGB")), x[..., :3], mean)
    assert close(J.jpeg8_decode(J.jpeg8_encode(x[..., :3], level), outcolorspace="YCBCR")[..., 0], (x[..., :3] @ [0.299, 0.587, 0.114]).astype(int), mean + 1)


def test_noise():
    x = np.random.default_rng(1).integers(0, 256, (48, 64, 3), dtype=np.uint8)
    assert close(J.jpeg8_decode(J.jpeg8_encode(x, 100, subsampling="444")), x, 1.2)


def test_facade_tables_and_errors():
    x = picture(24, 24)[..., 0]
    assert (J.jpeg_decode(L.ljpeg_encode(x)) == x).all() and (J.jpeg_decode(J.jpeg_encode(x, lossless=True)) == x).all()
    whole = J.jpeg_encode(x, 90)
    at = whole.index(b"\xff\xda")
    assert (J.jpeg_decode(whole[at:-2], header=whole[:at]) == J.jpeg_decode(whole)).all()
    at = whole.index(b"\xff\xdb")
    cut = whole.index(b"\xff\xc0")
    assert (J.jpeg_decode(b"\xff\xd8" + whole[cut:], tables=b"\xff\xd8" + whole[at:cut] + b"\xff\xd9") == J.jpeg_decode(whole)).all()
    for broken in (b"", whole[:100], whole[: len(whole) // 2]):
        with pytest.raises((CodecError, IndexError)):
            J.jpeg_decode(broken)
    for bad in (x.astype(float), x[:0], np.zeros((4, 4, 2), np.uint8)):
        with pytest.raises(ValueError):
            J.jpeg8_encode(bad)


@pytest.mark.parametrize("progressive", (False, True))
@pytest.mark.parametrize("gray", (False, True))
def test_against_the_java_platform(spark, progressive, gray):
    """Both ways: its reader of our files, and our reader of its files, baseline and progressive."""
    jvm = spark._jvm
    h, w = 53, 71
    x = picture(h, w, 1).repeat(3, -1) if gray else picture(h, w)
    argb = (x[..., 0].astype(np.int64) << 16 | x[..., 1].astype(np.int64) << 8 | x[..., 2]).tolist()
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 1)
    for y in range(h):
        for k in range(w):
            if gray:
                image.getRaster().setSample(k, y, 0, int(x[y, k, 0]))
            else:
                image.setRGB(k, y, argb[y][k])
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionQuality(0.9)
    param.setProgressiveMode(1 if progressive else 0)
    raw = jvm.java.io.ByteArrayOutputStream()
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(raw)
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    out.flush()
    pixels = lambda data: read(jvm, data, gray)
    theirs = bytes(raw.toByteArray())
    assert (b"\xff\xc2" in theirs) == progressive
    assert close(J.jpeg8_decode(theirs), pixels(theirs), 0.5, 3)
    own = J.jpeg8_encode(x[..., 0] if gray else x, 90)
    assert close(J.jpeg8_decode(own), pixels(own), 0.5, 3)


def read(jvm, data, gray):
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    raster = image.getRaster()
    raw = np.frombuffer(bytes(raster.getDataBuffer().getData()), np.uint8)
    x = raw.reshape(image.getHeight(), image.getWidth(), -1)
    return x[..., 0] if gray else x[..., ::-1]
