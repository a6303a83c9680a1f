"""The catalog of codecs, and codecs as Spark expressions.

encode() and decode() give Arrow-batched expressions: NULL in, NULL out; an error fails the job, or is NULL with
on_error="null". Codecs of arrays take and give chunks (schema.CHUNK), the others binary columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import native
from tesserae.operators import aec as Z
from tesserae.operators import bilevel as B
from tesserae.operators import blosc, cms, hcomp, jpegls, webp
from tesserae.operators import compressors as C
from tesserae.operators import exr as E
from tesserae.operators import filters as A
from tesserae.operators import images as I
from tesserae.operators import jpeg as J
from tesserae.operators import lossless as L
from tesserae.schema import CHUNK, from_array, to_array

#: Kinds: what encode takes and gives.
BYTES, FILTER, SERIALIZER = "bytes->bytes", "array->array", "array->bytes"


@dataclass(frozen=True)
class Codec:
    name: str
    kind: str
    encode: Callable | None
    decode: Callable | None
    extensions: tuple[str, ...] = ()
    #: Of a user's codec: from a column of bytes to true, false or NULL.
    check: Callable[[Column], Column] | None = None

    @property
    def available(self) -> bool:
        return bool(self.encode or self.decode)


def _codecs() -> dict[str, Codec]:
    rows = [
        *[Codec(n, BYTES, getattr(C, f"{n}_encode"), getattr(C, f"{n}_decode")) for n in ("zlib", "deflate", "gzip", "bz2", "lzma", "zstd", "brotli", "lz4", "lz4f", "lz4h5", "snappy", "packbits", "lzw", "lzf", "pglz", "checksum")],
        Codec("zlibng", BYTES, C.zlib_encode, C.zlib_decode),
        Codec("zopfli", BYTES, C.zopfli_encode, C.zlib_decode),
        Codec("lzo", BYTES, None, C.lzo_decode),
        *[Codec(n, BYTES, getattr(Z, f"{n}_encode"), getattr(Z, f"{n}_decode")) for n in ("aec", "szip")],
        Codec("blosc", BYTES, blosc.blosc_encode, blosc.blosc_decode),
        Codec("blosc2", BYTES, blosc.blosc2_encode, blosc.blosc2_decode),
        Codec("cms", FILTER, cms.cms_transform, cms.cms_decode),
        Codec("none", BYTES, lambda d: d, lambda d: d),
        Codec("bitshuffle", BYTES, A.bitshuffle_encode, A.bitshuffle_decode),
        Codec("dicomrle", BYTES, None, C.dicomrle_decode),
        *[Codec(n, FILTER, getattr(A, f"{n}_encode"), getattr(A, f"{n}_decode")) for n in ("delta", "xor", "byteshuffle", "floatpred")],
        Codec("bitorder", FILTER, A.bitorder, A.bitorder),
        Codec("quantize", FILTER, A.quantize_encode, None),
        *[Codec(n, SERIALIZER, getattr(A, f"{n}_encode"), getattr(A, f"{n}_decode")) for n in ("bfloat16", "float24", "packints")],
        Codec("eer", SERIALIZER, None, A.eer_decode),
        Codec("rcomp", SERIALIZER, C.rcomp_encode, C.rcomp_decode),
        Codec("numpy", SERIALIZER, I.numpy_encode, I.numpy_decode, ("npy", "npz")),
        Codec("png", SERIALIZER, I.png_encode, I.png_decode, ("png",)),
        Codec("spng", SERIALIZER, I.png_encode, I.png_decode),
        Codec("apng", SERIALIZER, I.apng_encode, I.apng_decode, ("apng",)),
        Codec("qoi", SERIALIZER, I.qoi_encode, I.qoi_decode, ("qoi",)),
        Codec("bmp", SERIALIZER, I.bmp_encode, I.bmp_decode, ("bmp", "dib")),
        Codec("tga", SERIALIZER, I.tga_encode, I.tga_decode, ("tga",)),
        Codec("pcx", SERIALIZER, I.pcx_encode, I.pcx_decode, ("pcx", "dcx")),
        Codec("gif", SERIALIZER, I.gif_encode, I.gif_decode, ("gif",)),
        Codec("rgbe", SERIALIZER, I.rgbe_encode, I.rgbe_decode, ("hdr", "rgbe", "pic")),
        Codec("tiff", SERIALIZER, I.tiff_encode, I.tiff_decode, ("tif", "tiff", "ome.tif", "lsm", "btf")),
        Codec("bcn", SERIALIZER, None, I.bcn_decode),
        Codec("dds", SERIALIZER, None, I.dds_decode, ("dds",)),
        *[Codec(n, SERIALIZER, None, getattr(B, f"{n}_decode")) for n in ("ccittrle", "ccittfax3", "ccittfax4")],
        *[Codec(n, SERIALIZER, getattr(L, f"{n}_encode"), getattr(L, f"{n}_decode")) for n in ("plio", "pixarlog")],
        Codec("ljpeg", SERIALIZER, L.ljpeg_encode, L.ljpeg_decode, ("ljp", "ljpg", "ljpeg")),
        Codec("exr", SERIALIZER, E.exr_encode, E.exr_decode, ("exr",)),
        Codec("jpeg", SERIALIZER, J.jpeg_encode, J.jpeg_decode, ("jpg", "jpeg", "jpe", "jfif", "jif")),
        *[Codec(n, SERIALIZER, J.jpeg8_encode, J.jpeg8_decode) for n in ("jpeg8", "mozjpeg")],
        Codec("hcomp", SERIALIZER, hcomp.hcomp_encode, hcomp.hcomp_decode),
        Codec("jpegls", SERIALIZER, jpegls.jpegls_encode, jpegls.jpegls_decode, ("jls",)),
        Codec("webp", SERIALIZER, webp.webp_encode, webp.webp_decode, ("webp",)),
        Codec("jpegsof3", SERIALIZER, None, L.jpegsof3_decode),
    ]
    # listed as unavailable: their libraries are not here, or no kernel is written yet
    absent = {
        BYTES: "lzfse lzham",
        SERIALIZER: (
            "avif brunsli heif htj2k jetraw jpeg2k jpegxl jpegxr jpegxs lerc meshopt "
            "pcodec sperr sz3 ultrahdr wavpack wic zfp"
        ),
    }
    rows += [Codec(n, kind, None, None) for kind, names in absent.items() for n in names.split()]
    return {c.name: c for c in sorted(rows, key=lambda c: c.name)}


CODECS = _codecs()


def register(name: str, encode: Callable | None, decode: Callable | None, kind: str = BYTES, extensions: tuple[str, ...] = (), check: Callable[[Column], Column] | None = None, spark: SparkSession | None = None) -> None:
    """Adds a user's codec; with a session, also its SQL functions."""
    if kind not in (BYTES, FILTER, SERIALIZER):
        raise ValueError(f"no kind {kind!r}")
    CODECS[name] = Codec(name, kind, encode, decode, extensions, check)
    if spark and kind == BYTES:
        _register_sql(spark, CODECS[name])


def version(name: str) -> str:
    c = CODECS[name]
    if not c.available:
        return f"{name} n/a"
    return f"{name} tesserae 0.1.0"


def catalog(spark: SparkSession) -> DataFrame:
    rows = [(c.name, c.kind, c.available, bool(c.encode), bool(c.decode), version(c.name), list(c.extensions)) for c in CODECS.values()]
    return spark.createDataFrame(rows, "name string, kind string, available boolean, can_encode boolean, can_decode boolean, version string, extensions array<string>")


def _wanted(name: str, what: str) -> tuple[Codec, Callable]:
    c = CODECS[name]
    f = getattr(c, what)
    if f is None:
        raise NotImplementedError(f"{name}_{what} is not available")
    return c, f


def _expression(function: Callable, chunk_in: bool, chunk_out: bool, on_error: str) -> Callable[[Column], Column]:
    kind = CHUNK if chunk_out else "binary"
    arrow = pa.struct([("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.binary())]) if chunk_out else pa.binary()

    def batch(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            if v is None:
                out.append(None)
                continue
            try:
                made = function(to_array(v) if chunk_in else v)
                out.append(from_array(made) if chunk_out else bytes(made))
            except Exception:
                if on_error == "raise":
                    raise
                out.append(None)
        return pa.array(out, arrow)

    return F.arrow_udf(batch, kind)


def encode(name: str, column: Column, on_error: str = "raise", **options) -> Column:
    c, f = _wanted(name, "encode")
    return _expression(lambda v: f(v, **options), c.kind != BYTES, c.kind == FILTER, on_error)(column)


def decode(name: str, column: Column, on_error: str = "raise", **options) -> Column:
    c, f = _wanted(name, "decode")
    return _expression(lambda v: f(v, **options), c.kind == FILTER, c.kind != BYTES, on_error)(column)


def check(name: str, column: Column) -> Column:
    """Whether bytes have the signature of a codec; NULL where they do not tell, or the codec has none."""
    own = CODECS.get(name)
    if own and own.check:
        return own.check(column)
    try:
        return native.check(name, column)
    except KeyError:
        if own is None:
            raise
        return F.lit(None).cast("boolean")


def sniff(column: Column, names: list[str] | None = None) -> Column:
    """The first of the codecs whose signature the bytes have, in the catalog's order; NULL if none has."""
    known = names or [n for n in ("png", *native.PREFIXES, "webp", "jpeg8", "avif", "numpy", "cms") if n in CODECS]
    return F.coalesce(*[F.when(native.check(n, column), n) for n in known])


def register_sql(spark: SparkSession) -> None:
    """SQL functions <codec>_encode and <codec>_decode for the codecs of bytes, and seeded checksums."""
    for c in CODECS.values():
        if c.kind == BYTES:
            _register_sql(spark, c)
    for name, f in C.CHECKSUMS.items():
        spark.udf.register(f"{name}_of", F.arrow_udf(_checksum(f), "long"))


def _register_sql(spark: SparkSession, c: Codec) -> None:
    for what in ("encode", "decode"):
        if f := getattr(c, what):
            spark.udf.register(f"{c.name}_{what}", _expression(lambda v, f=f: f(v), False, False, "raise"))


def _checksum(f: Callable) -> Callable:
    def batch(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], pa.int64())

    return batch


def checksum(name: str, column: Column) -> Column:
    return F.arrow_udf(_checksum(C.CHECKSUMS[name]), "long")(column)
