import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import registry
from tesserae.functions import native
from tesserae.operators import images
from tesserae.plans.pipeline import Chain
from tesserae.schema import CHUNK, chunk, from_array, to_array
from tesserae.sources import files
from tesserae.sources.files import imagefileext, read_images


def test_native_checksums(spark):
    import zlib

    rows = [(b"",), (b"Four score and seven years ago",), (bytes(range(256)),), (None,)]
    df = spark.createDataFrame(rows, "b binary")
    out = df.select("b", native.adler32(F.col("b")), native.crc32(F.col("b")), native.djb2(F.col("b")), native.binary_of(native.bytes_of(F.col("b")))).collect()
    for b, adler, crc, _, back in out[:3]:
        assert adler == zlib.adler32(bytes(b)) and crc == zlib.crc32(bytes(b)) and back == b
    assert out[1][3] == 316074956 and tuple(out[3]) == (None,) * 5


def test_native_arrays(spark):
    df = spark.createDataFrame([([5, 3, 250],), ([],), (None,)], "x array<bigint>")
    d = native.delta_encode(F.col("x"), bits=8)
    got = [tuple(r) for r in df.select(d, native.delta_decode(d, 8), native.xor_decode(native.xor_encode(F.col("x")))).collect()]
    assert got[0] == ([5, 254, 247], [5, 3, 250], [5, 3, 250]) and got[1][1] == []


def test_checks_are_three_valued(spark):
    png = images.png_encode(np.zeros((3, 3), np.uint8))
    r = spark.createDataFrame([(png,), (b"x" * 60,), (None,)], "b binary")
    out = r.select(*[native.check(n, F.col("b")).alias(n) for n in ("png", "zlib", "lzw", "cms", "dicomrle", "avif")], registry.sniff(F.col("b")).alias("s")).collect()
    assert out[0]["png"] is True and out[1]["png"] is False and out[2]["png"] is None
    assert out[1]["zlib"] is None and out[0]["s"] == "png"


def test_every_catalog_codec_has_a_check(spark):
    df = spark.createDataFrame([(b"abcdefgh" * 20,)], "b binary")
    df.select(*[native.check(n, F.col("b")).alias(n) for n in registry.CODECS if n not in ("checksum", "ccittrle")]).collect()


def test_errors_become_null(spark):
    df = spark.createDataFrame([(b"nonsense",), (None,)], "b binary")
    assert [r[0] for r in df.select(registry.decode("zlib", F.col("b"), on_error="null")).collect()] == [None, None]
    with pytest.raises(NotImplementedError):
        registry.encode("jpegxl", F.col("b"))


@pytest.mark.parametrize("steps", (["delta", "lzw"], ["bitshuffle", "zstd"], ["floatpred", "deflate"], ["xor", "lzma"], ["bitorder", "bitorder", "zlib"]))
def test_chains(spark, steps):
    x = np.arange(300, dtype=np.float32).reshape(10, 30)
    df = spark.createDataFrame([(x.tobytes(),), (None,)], "b binary").select(chunk(F.col("b"), "f4", (10, 30)).alias("c"))
    made = Chain.from_json(Chain([(s, {"itemsize": 4} if s == "bitshuffle" else {}) for s in steps]).to_json())
    out = df.select(made.decode(made.encode(F.col("c"))).alias("c")).collect()
    assert bytes(out[0]["c"]["data"]) == x.tobytes() and out[0]["c"]["shape"] == [10, 30] and out[1]["c"] is None


def test_images_from_files(spark, tmp_path):
    x = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    (tmp_path / "a.png").write_bytes(images.png_encode(x))
    (tmp_path / "b.tif").write_bytes(images.tiff_encode(np.stack([x, x])))
    (tmp_path / "c.tga").write_bytes(images.tga_encode(x))
    (tmp_path / "d.png").write_bytes(images.PNG_SIGNATURE + b"broken")
    rows = read_images(spark, str(tmp_path)).collect()
    assert sorted((r["path"][-5:], r["page"]) for r in rows if r["chunk"]) == [("a.png", 0), ("b.tif", 0), ("b.tif", 1), ("c.tga", 0)]
    assert all(bytes(r["chunk"]["data"]) == x.tobytes() for r in rows if r["chunk"])
    assert [r["path"][-5:] for r in rows if r["error"]] == ["d.png"]
    assert "png" in imagefileext()


def test_sql_functions(spark):
    registry.register_sql(spark)
    assert spark.sql("SELECT zstd_decode(zstd_encode(CAST('abc' AS BINARY)))").first()[0] == b"abc"
    assert spark.sql("SELECT lookup3_of(CAST('' AS BINARY))").first()[0] == 0xDEADBEEF


def test_stream(spark, tmp_path):
    from tesserae.streaming.streams import encoded_stream, read_chunk_stream

    src = str(tmp_path / "in")
    spark.range(5).select(chunk(F.encode(F.col("id").cast("string"), "utf-8"), "u1").alias("chunk")).write.parquet(src)
    schema = "chunk struct<dtype: string, shape: array<int>, data: binary>"
    out = encoded_stream(read_chunk_stream(spark, src, schema), Chain([("delta", {}), ("zstd", {})]))
    q = out.writeStream.format("memory").queryName("coded").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM coded").count() == 5


def test_queries_match_sql(spark, sf):
    import duckdb

    from tesserae import queries

    con = duckdb.connect()
    for t in ("events", "pages", "documents", "part", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("delta_encode_events", "xor_encode_events", "run_lengths_events", "adler32_pages", "djb2_pages", "byteshuffle_part", "checks_pages", "chain_delta_lzw"):
        mine = queries.QUERIES[name](spark, sf).toPandas()
        theirs = con.execute(queries.SQL[name]).df()
        cols = sorted(mine.columns)
        assert cols == sorted(theirs.columns)
        assert sorted(map(tuple, mine[cols].astype(str).values)) == sorted(map(tuple, theirs[cols].astype(str).values)), name


@pytest.mark.parametrize("form", ("CCITT RLE", "CCITT T.4", "CCITT T.6", "LZW", "PackBits", "Deflate"))
def test_two_color_tiff_of_another_writer(spark, form):
    """Pages written by the Java platform's TIFF writer."""
    jvm = spark._jvm
    h, w = 40, 3000
    rng = np.random.default_rng(1)
    # runs of all lengths, in both colours
    x = np.zeros((h, w), np.uint8)
    for row in x:
        at = np.cumsum(np.r_[rng.integers(0, 70, 12), rng.integers(0, 1900, 3)])
        for a, b in zip(at[::2], at[1::2]):
            row[a:b] = 1
    x[20:30] = x[19]
    x[25:30, 1:] = x[25:30, :-1]
    data = jvm.java.awt.image.DataBufferByte(bytearray(np.packbits(x, axis=1).tobytes()), -(-w // 8) * h)
    image = jvm.java.awt.image.BufferedImage(w, h, 12)
    image.setData(jvm.java.awt.image.Raster.createPackedRaster(data, w, h, 1, None))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionType(form)
    raw = jvm.java.io.ByteArrayOutputStream()
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(raw)
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    out.flush()
    back = images.tiff_decode(bytes(raw.toByteArray()))
    assert back.shape == x.shape
    assert (back == x).all() or (back == 1 - x).all()


def test_jpeg_tiff_of_another_writer(spark):
    jvm = spark._jvm
    h, w = 40, 48
    x = np.clip(np.add.outer(np.arange(h) * 3, np.arange(w) * 2), 0, 255).astype(np.uint8)
    image = jvm.java.awt.image.BufferedImage(w, h, 10)
    data = jvm.java.awt.image.DataBufferByte(bytearray(x.tobytes()), w * h)
    image.setData(jvm.java.awt.image.Raster.createInterleavedRaster(data, w, h, w, 1, spark.sparkContext._gateway.new_array(jvm.int, 1), None))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionType("JPEG")
    param.setCompressionQuality(0.95)
    raw = jvm.java.io.ByteArrayOutputStream()
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(raw)
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    out.flush()
    back = images.tiff_decode(bytes(raw.toByteArray()))
    assert back.shape == x.shape and np.abs(back.astype(int) - x).max() <= 8


def test_new_codecs_as_expressions(spark):
    """Kernels of this catalog over rows: a chunk in, bytes out, and back; nulls stay, broken bytes give null."""
    rows = [(bytes(range(240)),), (bytes(240),), (None,)]
    df = spark.createDataFrame(rows, "b binary").select(chunk(F.col("b"), "u1", (12, 20)).alias("c"))
    for name, options in (("ljpeg", {}), ("pixarlog", {"shape": (12, 20)})):
        out = df.select("c", registry.decode(name, registry.encode(name, F.col("c")), **options).alias("d")).collect()
        assert out[2].d is None and all(list(r.d.shape) == [12, 20] for r in out[:2])
        if name == "ljpeg":
            assert all(r.c == r.d for r in out)
    bad = df.select(registry.decode("jpeg", F.lit(b"abc"), on_error="null").alias("d")).collect()
    assert all(r.d is None for r in bad)
    known = {r.name: (r.can_encode, r.can_decode) for r in registry.catalog(spark).collect()}
    assert known["ccittfax4"] == (False, True) and known["jpeg8"] == (True, True) and known["avif"] == (False, False)


def test_images_written_are_read_again(spark, tmp_path):
    x = [np.arange(12, dtype="u1").reshape(3, 4) + i for i in range(5)]
    rows = [(f"a/{i}.png", from_array(a)) for i, a in enumerate(x)] + [("none.png", None)]
    df = spark.createDataFrame(rows, f"path string, chunk {CHUNK}")
    made = files.write_images(df, str(tmp_path / "out"), "png").collect()
    assert sorted(r["path"] for r in made) == [f"a/{i}.png" for i in range(5)] and all(r["length"] > 50 for r in made)
    back = files.read_images(spark, f"file://{tmp_path}/out/a").collect()
    assert sorted(r["path"][-5:] for r in back) == [f"{i}.png" for i in range(5)]
    for r in back:
        assert (to_array(r["chunk"]) == x[int(r["path"][-5])]).all()


def test_chunk_store_keeps_its_chain(spark, tmp_path):
    x = np.arange(64, dtype="u2").reshape(8, 8)
    blocks = [(i, j, from_array(x[4 * i : 4 * i + 4, 4 * j : 4 * j + 4])) for i in range(2) for j in range(2)]
    df = spark.createDataFrame(blocks, f"row int, col int, chunk {CHUNK}")
    path = str(tmp_path / "store")
    files.write_chunks(df, path, ["row"], chain=Chain([("delta", {}), ("zlib", {})]))
    back = np.zeros_like(x)
    for r in files.read_chunks(spark, path).collect():
        back[4 * r["row"] : 4 * r["row"] + 4, 4 * r["col"] : 4 * r["col"] + 4] = to_array(r["chunk"])
    assert (back == x).all()
    part = files.read_chunks(spark, path, "row = 1 and col = 0").collect()
    assert len(part) == 1 and (to_array(part[0]["chunk"]) == x[4:, :4]).all()


def test_row_filters_over_ranges_of_the_order(spark):
    """Keys with many and few rows, nulls, and order columns without ranges."""
    own = np.random.default_rng(4)
    rows = [(None if i % 50 == 3 else int(own.integers(0, 3)), int(k), f"k{k:05d}", int(own.integers(-9, 9))) for i, k in enumerate(own.permutation(3000))]
    df = spark.createDataFrame(rows, "g int, k int, name string, v long")
    by: dict = {}
    for g, k, _, v in sorted(rows, key=lambda r: r[1]):
        by.setdefault(g, []).append((k, v))
    for order in ("k", "name"):
        coded = native.delta_rows(df, "v", [order], ["g"])
        got = {r["k"]: r["delta"] for r in coded.collect()}
        want = {k: v - (rows_[i - 1][1] if i else 0) for rows_ in by.values() for i, (k, v) in enumerate(rows_)}
        assert got == want
        assert all(r["v"] == r["value"] for r in native.undelta_rows(coded, "delta", [order], ["g"]).collect())
        assert all(r["v"] == r["value"] for r in native.unxor_rows(native.xor_rows(df, "v", [order], ["g"]), "xored", [order], ["g"]).collect())
        runs = {(r["g"], r["run"]): (r["v"], r["length"]) for r in native.runs(df, "v", [order], ["g"]).collect()}
        for g, rows_ in by.items():
            want_runs = [(v, len(list(x))) for v, x in itertools.groupby(v for _, v in rows_)]
            assert [runs[g, i] for i in range(len(want_runs))] == want_runs


def test_running_totals_and_words_of_long_values(spark):
    x = [int(v) for v in np.random.default_rng(1).integers(0, 256, 5000)]
    df = spark.createDataFrame([(x, [], "é" * 3001), ([5], [1, 2], ""), (None, [3], None)], "x array<int>, y array<int>, t string")
    got = df.select(native.delta_decode(F.col("x"), 8).alias("a"), native.xor_decode(F.col("x")).alias("b"), native.delta_decode(F.col("y")).alias("c"), native.fletcher32(F.col("t")).alias("d"), native.bytes_of(F.col("t")).alias("e")).collect()
    assert got[0]["a"] == [v % 256 for v in itertools.accumulate(x)] and got[0]["b"] == list(itertools.accumulate(x, lambda a, b: a ^ b))
    assert [r["c"] for r in got] == [[], [1.0, 3.0], [3.0]] and got[2]["a"] is None and got[2]["d"] is None
    assert got[0]["e"] == list(("é" * 3001).encode()) and got[1]["e"] == [] and got[1]["d"] == 0


def test_users_codecs_have_checks_and_sql(spark):
    registry.register("turned", lambda d: d[::-1], lambda d: d[::-1], check=lambda c: F.substr(c, F.lit(1), F.lit(1)) == F.lit(b"t"), spark=spark)
    try:
        df = spark.createDataFrame([(b"ab",), (b"ta",), (None,)], "b binary")
        got = df.select(registry.encode("turned", F.col("b")).alias("e"), registry.check("turned", F.col("b")).alias("c"), F.expr("turned_decode(turned_encode(b))").alias("d")).collect()
        assert [bytes(r["e"]) if r["e"] else None for r in got] == [b"ba", b"at", None] and [r["c"] for r in got] == [False, True, None]
        assert [bytes(r["d"]) if r["d"] else None for r in got] == [b"ab", b"ta", None]
        with pytest.raises(ValueError):
            registry.register("bad", None, None, kind="other")
    finally:
        registry.CODECS.pop("turned")


def test_checksums_of_ordered_chunks(spark):
    import zlib

    own = np.random.default_rng(6)
    chunks = {k: [own.integers(0, 256, int(own.integers(0, 400)), "u1").tobytes() for _ in range(k + 1)] for k in range(6)}
    rows = [(k, i, c) for k, cs in chunks.items() for i, c in enumerate(cs)] + [(2, 9, None)]
    got = {r["k"]: r["adler"] for r in native.adler32_of_chunks(spark.createDataFrame(rows, "k int, i int, c binary"), "c", ["i"], ["k"]).collect()}
    assert got == {k: zlib.adler32(b"".join(cs)) for k, cs in chunks.items()}


def test_every_frame_of_a_file_is_a_row(spark, tmp_path):
    import io

    from tesserae.operators import images as I

    x = np.random.default_rng(2).integers(0, 256, (3, 6, 5), "u1")
    npz = io.BytesIO()
    np.savez(npz, x[0], x[1, :2])
    for name, data in (("a.png", I.apng_encode(x)), ("b.png", I.png_encode(x[0])), ("c.npz", npz.getvalue()), ("d.gif", I.gif_encode(x)), ("e.tif", I.tiff_encode(x))):
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in files.read_images(spark, f"file://{tmp_path}").collect():
        assert r["error"] is None, r
        got.setdefault(r["path"][-5:], {})[r["page"]] = to_array(r["chunk"])
    assert {k: len(v) for k, v in got.items()} == {"a.png": 3, "b.png": 1, "c.npz": 2, "d.gif": 3, "e.tif": 3}
    assert all((got["a.png"][i] == x[i]).all() and (got["e.tif"][i] == x[i]).all() for i in range(3)) and (got["c.npz"][1] == x[1, :2]).all()
