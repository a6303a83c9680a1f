"""Codec functions as Catalyst expressions: nothing here leaves the JVM.

Bytes are arrays of ints in 0..255. NULL gives NULL everywhere. Wrap-around arithmetic is widened, then reduced, since
ANSI mode refuses overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bytes_of(data: Column) -> Column:
    """The bytes of a string or binary column."""
    return F.transform(F.regexp_extract_all(F.hex(data.cast("binary")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def words_of(data: Column) -> Column:
    """Its 16-bit big-endian words, an odd last byte as the high one."""
    text = F.hex(data.cast("binary"))
    return F.transform(F.regexp_extract_all(text, F.lit(".{2,4}"), F.lit(0)), lambda x: F.conv(F.rpad(x, 4, "0"), 16, 10).cast("long"))


def binary_of(ints: Column) -> Column:
    """Bytes back to binary."""
    return F.when(ints.isNotNull(), F.unhex(F.array_join(F.transform(ints, lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), "")))


# ---- filters over arrays ----


def _back(x: Column, zero: Column) -> Column:
    """The element before each one."""
    return F.concat(F.array(zero), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))


def delta_encode(x: Column, dist: int = 1, bits: int = 0) -> Column:
    """First differences along an array; bits > 0 wraps them to so many bits."""
    if dist != 1:
        raise NotImplementedError("dist must be 1")
    zero = F.lit(0).cast("long") if bits else F.get(x, F.lit(0)) * 0
    d = F.zip_with(x, _back(x, zero), lambda a, b: a - b)
    d = F.transform(d, lambda v: F.pmod(v.cast("long"), F.lit(1 << bits))) if bits else d
    return F.when(F.size(x) == 0, x.cast("array<long>") if bits else x).otherwise(d)


def _running(x: Column, zero: Column, add) -> Column:
    """Running totals along an array: within blocks of about the root of its length, then of the blocks' totals, so an
    array of n elements is copied in n ** 1.5 steps and not in n squared."""

    def scan(values: Column) -> Column:  # the totals before and after each element
        return F.aggregate(values, F.array(zero), lambda a, v: F.concat(a, F.array(add(F.element_at(a, -1), v))))

    def blocked(x: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x))).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / width).cast("int") - 1, F.lit(0))), lambda k: scan(F.slice(x, k * width + 1, width)))

        def shifted(parts: Column) -> Column:
            before = scan(F.transform(parts, lambda p: F.element_at(p, -1)))
            return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, t: F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda v: add(t, v))))

        return _once(parts, shifted)

    return F.when(F.size(x) == 0, F.slice(F.array(zero), 1, 0)).otherwise(_once(x, blocked))


def _once(x: Column, f) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def delta_decode(x: Column, bits: int = 0) -> Column:
    """Running sums along an array."""
    zero = F.lit(0).cast("long" if bits else "double")
    kind = "array<long>" if bits else "array<double>"
    add = (lambda a, b: F.pmod(a + b, F.lit(1 << bits))) if bits else (lambda a, b: a + b)
    return _running(x.cast(kind), zero, add)


def xor_encode(x: Column) -> Column:
    """Every element XOR the one before."""
    return F.when(F.size(x) == 0, x).otherwise(F.zip_with(x, _back(x, F.get(x, F.lit(0)) * 0), lambda a, b: a.bitwiseXOR(b)))


def xor_decode(x: Column) -> Column:
    """Running XOR."""
    return _running(x.cast("array<long>"), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def bitorder(ints: Column) -> Column:
    """Bytes with their bits in reverse order; its own inverse."""
    def turned(b: Column) -> Column:
        out = F.lit(0)
        for i in range(8):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(b, i).bitwiseAND(F.lit(1)), 7 - i))
        return out

    return F.transform(ints, turned)


def byteshuffle_ints(x: Column, size: int) -> Column:
    """The byte planes of an array of integers, least significant first."""
    def plane(j: int) -> Column:
        return F.transform(x, lambda v: F.shiftright(v.cast("long"), 8 * j).bitwiseAND(F.lit(255)).cast("int"))

    return F.flatten(F.array(*[plane(j) for j in range(size)]))


def packints_decode(ints: Column, bits: int) -> Column:
    """MSB-first unpacking of bytes into integers of 1, 2, 4 or 8 bits."""
    shifts = list(range(8 - bits, -1, -bits))
    return F.flatten(F.transform(ints, lambda b: F.array(*[F.shiftright(b, s).bitwiseAND(F.lit((1 << bits) - 1)) for s in shifts])))


def quantize_scale(x: Column, nsd: int) -> Column:
    """Values rounded to nsd decimal digits behind the point, by a power of two as fine."""
    import math

    scale = 2.0 ** math.ceil(math.log2(10.0**nsd))
    return F.rint(x * F.lit(scale)) / F.lit(scale)


# ---- checksums ----


def adler32(data: Column, value: int = 1) -> Column:
    a0, b0 = value & 0xFFFF, value >> 16
    step = lambda s, b: F.struct(((s["a"] + b) % 65521).alias("a"), ((s["b"] + s["a"] + b) % 65521).alias("b"))
    start = F.struct(F.lit(a0).cast("long").alias("a"), F.lit(b0).cast("long").alias("b"))
    return F.aggregate(F.transform(bytes_of(data), lambda b: b.cast("long")), start, step, lambda s: s["b"] * 65536 + s["a"])


def crc32(data: Column) -> Column:
    return F.crc32(data.cast("binary"))


def fletcher32(data: Column) -> Column:
    """Sums of 16-bit big-endian words, an odd last byte as the high one."""
    fold = lambda v: F.when(v > 65535, v - 65535).otherwise(v)
    step = lambda s, w: F.struct(fold(s["a"] + w).alias("a"), fold(s["b"] + fold(s["a"] + w)).alias("b"))
    zero = F.lit(0).cast("long")
    return F.aggregate(words_of(data), F.struct(zero.alias("a"), zero.alias("b")), step, lambda s: s["b"] * 65536 + s["a"])


def djb2(data: Column) -> Column:
    """h = 33 h + c from 5381, modulo 2 ** 32."""
    return F.aggregate(F.transform(bytes_of(data), lambda b: b.cast("long")), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c) % 4294967296)


# ---- row filters: the same codecs over the rows of a table ----
#
# A key with many rows is cut into ranges of the first order column, so it has many tasks; each range is coded by itself
# and takes up what the ranges before it leave (a table of one row for each key and range).

#: Ranges that the order is cut into.
RANGES = 64
_RANGED = ("tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")


def order_bounds(df: DataFrame, order: str) -> list:
    """Where the ranges of an order column begin: quantiles, from one pass over that column alone."""
    if dict(df.dtypes)[order] not in _RANGED:
        return []
    return sorted(set(df.agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)])).first()[0] or []))


def _ranged(df: DataFrame, order: list[str], bounds: list | None) -> DataFrame:
    """df with _range: the range of the first order column; equal values share one."""
    edges = order_bounds(df, order[0]) if bounds is None else bounds

    def place(a: int, b: int) -> Column:  # by halves
        if a == b:
            return F.lit(a)
        middle = (a + b) // 2
        return F.when(F.col(order[0]) < F.lit(edges[middle]), place(a, middle)).otherwise(place(middle + 1, b))

    return df.withColumn("_range", F.when(F.col(order[0]).isNull(), -1).otherwise(place(0, len(edges))))


def _carried(df: DataFrame, by: list[str], leaves: dict[str, Column], carries) -> DataFrame:
    """df, which has _range, with what the ranges before each row's own leave: `leaves` aggregates a range, and
    carries(window over the ranges before) names the columns to join."""
    ends = df.groupBy(*by, "_range").agg(*[x.alias(n) for n, x in leaves.items()])
    w = Window.partitionBy(*by).orderBy("_range")
    ends = ends.select(*by, "_range", *[x.alias(n) for n, x in carries(w).items()])
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_range")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    return df.alias("a").join(ends.alias("b"), on).select("a.*", *[f"b.{n}" for n in carries(w)])


def _previous(df: DataFrame, value: str, order: list[str], by: list[str], bounds: list | None) -> DataFrame:
    """df with _before, the value of the row before (null for a key's first), and _start, whether it is a key's first."""
    df = _ranged(df, order, bounds)
    last = F.max_by(value, order[0] if len(order) == 1 else F.struct(*order))
    df = _carried(df, by, {"_last": last}, lambda w: {"_left": F.lag("_last").over(w), "_first": F.row_number().over(w) == 1})
    w = Window.partitionBy(*by, "_range").orderBy(*order)
    turn = F.row_number().over(w)
    df = df.withColumn("_turn", turn).withColumn("_before", F.when(F.col("_turn") == 1, F.col("_left")).otherwise(F.lag(value).over(w)))
    return df.withColumn("_start", F.col("_first") & (F.col("_turn") == 1)).drop("_left", "_first", "_turn")


def delta_rows(df: DataFrame, value: str, order: list[str], by: list[str], out: str = "delta", bounds: list | None = None) -> DataFrame:
    return _previous(df, value, order, by, bounds).withColumn(out, F.col(value) - F.coalesce("_before", F.lit(0))).drop("_before", "_start", "_range")


def undelta_rows(df: DataFrame, delta: str, order: list[str], by: list[str], out: str = "value", bounds: list | None = None) -> DataFrame:
    return _accumulated(df, delta, order, by, out, bounds, F.sum, lambda a, b: a + b)


def xor_rows(df: DataFrame, value: str, order: list[str], by: list[str], out: str = "xored", bounds: list | None = None) -> DataFrame:
    return _previous(df, value, order, by, bounds).withColumn(out, F.col(value).bitwiseXOR(F.coalesce("_before", F.lit(0)))).drop("_before", "_start", "_range")


def unxor_rows(df: DataFrame, xored: str, order: list[str], by: list[str], out: str = "value", bounds: list | None = None) -> DataFrame:
    return _accumulated(df, xored, order, by, out, bounds, F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def _accumulated(df: DataFrame, column: str, order: list[str], by: list[str], out: str, bounds: list | None, total, add) -> DataFrame:
    df = _carried(_ranged(df, order, bounds), by, {"_sum": total(column)}, lambda w: {"_carry": total("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    w = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = total(column).over(w)
    return df.withColumn("_own", own).withColumn(out, F.when(F.col("_own").isNull(), F.col("_carry")).when(F.col("_carry").isNull(), F.col("_own")).otherwise(add(F.col("_carry"), F.col("_own")))).drop("_own", "_carry", "_range")


def runs(df: DataFrame, value: str, order: list[str], by: list[str], bounds: list | None = None) -> DataFrame:
    """Run-length coding: by, run (from 0), value and length of every run of equal values."""
    marked = _previous(df, value, order, by, bounds).withColumn("_turn", (~F.col(value).eqNullSafe(F.col("_before")) & ~F.col("_start")).cast("int"))
    marked = marked.select(*dict.fromkeys([*by, value, *order, "_range", "_turn"]))
    marked = _carried(marked, by, {"_turns": F.sum("_turn")}, lambda w: {"_carry": F.sum("_turns").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    w = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("run", F.sum("_turn").over(w) + F.coalesce("_carry", F.lit(0)))
    return marked.groupBy(*by, "run", value).agg(F.count("*").alias("length"))


def adler32_of_chunks(df: DataFrame, data: str, order: list[str], by: list[str], out: str = "adler") -> DataFrame:
    """by, and Adler's checksum of each key's chunks as if laid end to end in order: those of the chunks, weighted by the
    bytes behind each. No chunk is held together with another."""
    base = F.lit(65521)
    own = df.withColumns({"_own": adler32(F.col(data), 0), "_n": F.octet_length(F.col(data).cast("binary")).cast("long")})
    own = own.where(F.col("_n").isNotNull()).select(*by, *order, F.pmod(F.col("_own"), F.lit(65536)).alias("_a"), F.shiftright("_own", 16).alias("_b"), "_n")
    after = F.sum("_n").over(Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_w", (F.col("_b") + F.col("_a") * (F.coalesce(after, F.lit(0)) % base)) % base)
    total = own.groupBy(*by).agg(((F.sum("_n") + F.sum("_w")) % base * 65536 + (F.sum("_a") + 1) % base).cast("long").alias(out))
    return total


# ---- signatures: true, false, or NULL where the bytes do not tell ----

#: Prefixes (hex) that settle a format. A second list holds what is false without them; the others are NULL.
PREFIXES = {
    "apng": ["89504E470D0A1A0A"], "bmp": ["424D"], "dds": ["44445320"], "exr": ["762F3101"],
    "gif": ["474946383761", "474946383961"], "gzip": ["1F8B"], "htj2k": ["0000000C6A502020", "FF4FFF51"],
    "jpeg2k": ["0000000C6A502020", "FF4FFF51", "0D0A870A"], "jpegxr": ["4949BC"], "jpegxs": ["0000000C4A585320", "FF10FF50"],
    "lerc": ["4C6572633220", "436E745A496D616765"], "lz4f": ["04224D18"], "lzfse": ["627678"], "png": ["89504E470D0A1A0A"],
    "qoi": ["716F6966"], "rgbe": ["233F"], "spng": ["89504E470D0A1A0A"], "tiff": ["49492A00", "4D4D002A", "49492B00", "4D4D002B", "45502A00", "5045002A"],
    "wavpack": ["7776706B"], "zfp": ["7A6670"], "zstd": ["28B52FFD"], "hcomp": ["DD99"], "jpegxl": ["FF0A", "0000000C4A584C20"],
}
MAYBE = {"deflate": ["789C", "785E", "7801", "78DA"], "zlib": ["789C", "785E", "7801", "78DA"], "zlibng": ["789C", "785E", "7801", "78DA"]}
UNKNOWN = (
    "aec bcn bitshuffle blosc blosc2 brotli brunsli bz2 ccitt ccittrle ccittfax3 ccittfax4 imcd delta xor bitorder byteshuffle floatpred packints packbits float24 "
    "bfloat16 eer zopfli jetraw jpegsof3 ljpeg lz4 lzf lzham lzma meshopt pcodec pglz pixarlog quantize rcomp sperr sz3 szip none"
).split()


def check(name: str, data: Column) -> Column:
    """Whether binary data have the signature of a format: three-valued."""
    head = lambda a, n: F.hex(F.substr(data, F.lit(a + 1), F.lit(n)))
    size = F.octet_length(data)
    starts = lambda hexes: F.coalesce(*[F.when(head(0, len(x) // 2) == x, True) for x in hexes], F.lit(False))
    none = F.lit(None).cast("boolean")
    if name in ("bmp", "hcomp"):
        out = starts(PREFIXES[name]) & (size > {"bmp": 54, "hcomp": 24}[name])
    elif name in PREFIXES:
        out = starts(PREFIXES[name])
    elif name in MAYBE:
        out = F.when(starts(MAYBE[name]), True)
    elif name in UNKNOWN:
        out = none
    elif name in ("avif", "heif"):
        kinds = ["61766966"] if name == "avif" else ["68656963", "68656978", "6865766D", "6D696631"]
        out = F.when((head(4, 4) == "66747970") & head(8, 4).isin(kinds), True).when(head(4, 4) == "66747970", none).otherwise(False)
    elif name == "cms":
        out = F.when(size < 40, False).when(head(36, 4) == "61637370", True)
    elif name in ("jpeg8", "mozjpeg", "jpeg"):
        out = starts(["FFD8FFDB", "FFD8FFEE", "FFD8FFC3", "FFD8FFC4"]) | (starts(["FFD8FF"]) & head(6, 4).isin("4A464946", "45786966"))
    elif name == "ultrahdr":
        out = F.when(starts(["FFD8FF"]), none).otherwise(False)
    elif name == "jpegls":
        out = F.when(starts(["FFD8FFF7"]) | (starts(["FFD8FFE8"]) & (head(6, 6) == "535049464600")), True)
    elif name == "lz4h5":
        out = F.when(size < 12, False)
    elif name == "lzo":
        out = F.when((size > 5) & head(0, 1).isin("F0", "F1"), True)
    elif name == "plio":
        out = head(4, 2) == "9CFF"
    elif name == "webp":
        out = (head(0, 4) == "52494646") & (head(8, 4) == "57454250")
    elif name == "tga":
        foot = F.hex(F.substr(data, F.greatest(size - 17, F.lit(1)), F.lit(18)))
        out = (foot == "54525545564953494F4E2D5846494C452E00") | ((size >= 18) & head(1, 1).isin("00", "01") & head(2, 1).isin("01", "02", "03", "09", "0A", "0B"))
    elif name == "pcx":
        out = starts(["B168DE3A"]) | ((size >= 128) & (head(0, 1) == "0A") & head(1, 1).isin("00", "02", "03", "04", "05") & head(2, 1).isin("00", "01") & head(3, 1).isin("01", "02", "04", "08"))
    elif name == "lzw":
        out = starts(["80"]) | (starts(["00"]) & (head(1, 1).substr(2, 1).isin("1", "3", "5", "7", "9", "B", "D", "F")))
    elif name == "numpy":
        out = starts(["934E554D5059"]) | (starts(["504B"]) & (F.instr(head(0, 64), "4E554D5059") > 0))
    elif name == "dicomrle":
        turned = lambda x: F.concat(*[F.substr(x, F.lit(k), F.lit(2)) for k in (7, 5, 3, 1)])
        words = F.transform(F.regexp_extract_all(head(0, 64), F.lit(".{8}"), F.lit(0)), lambda x: F.conv(turned(x), 16, 10).cast("long"))

        def sound(w: Column) -> Column:  # the number of segments, the first at 64, all of them within the data
            places = F.slice(w, 2, F.greatest(F.least(F.get(w, F.lit(0)), F.lit(15)).cast("int"), F.lit(0)))
            return F.get(w, F.lit(0)).between(1, 15) & (F.get(w, F.lit(1)) == 64) & F.forall(places, lambda v: (v > 0) & (v < size))

        out = F.when(size < 64, False).otherwise(_once(words, sound))
    elif name == "snappy":
        out = F.when(size == 0, False)
    elif name == "wic":
        out = F.lit(False)
    else:
        raise KeyError(name)
    return F.when(data.isNull(), none).otherwise(out)
