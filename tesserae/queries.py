"""The registered queries for the codec operators, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import registry
from tesserae.functions import native
from tesserae.plans.pipeline import Chain
from tesserae.schema import chunk


def _table(name: str):
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    read.__name__ = name
    return read


events, pages, lineitem, part, documents, embeddings, benchmark, conversations = map(_table, ("events", "pages", "lineitem", "part", "documents", "embeddings", "benchmark", "conversations"))
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_BYTES = "list_transform(range(1, octet_length(b) + 1), lambda i: ('0x' || hex(b[i:i]))::INT)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_encode_events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("delta").alias("total"))


@query("SELECT event_id, event_type, user_id - coalesce(lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id), 0) AS delta FROM events")
def delta_encode_events(spark, sf_dir):
    return native.delta_rows(events(spark, sf_dir), "user_id", ["event_id"], ["event_type"]).select("event_id", "event_type", "delta")


@query("SELECT event_id, user_id AS value FROM events")
def delta_decode_events(spark, sf_dir):
    rows = events(spark, sf_dir)
    bounds = native.order_bounds(rows, "event_id")
    coded = native.delta_rows(rows, "user_id", ["event_id"], ["event_type"], bounds=bounds)
    return native.undelta_rows(coded, "delta", ["event_id"], ["event_type"], bounds=bounds).select("event_id", "value")


@query("SELECT event_id, xor(user_id, coalesce(lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id), 0)) AS xored FROM events")
def xor_encode_events(spark, sf_dir):
    return native.xor_rows(events(spark, sf_dir), "user_id", ["event_id"], ["event_type"]).select("event_id", "xored")


@query("SELECT event_id, user_id AS value FROM events")
def xor_decode_events(spark, sf_dir):
    rows = events(spark, sf_dir)
    bounds = native.order_bounds(rows, "event_id")
    coded = native.xor_rows(rows, "user_id", ["event_id"], ["event_type"], bounds=bounds)
    return native.unxor_rows(coded, "xored", ["event_id"], ["event_type"], bounds=bounds).select("event_id", "value")


@query("""
WITH turns AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS t
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
runs AS (SELECT *, sum(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM turns)
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS length FROM runs GROUP BY ALL""")
def run_lengths_events(spark, sf_dir):
    return native.runs(events(spark, sf_dir), "event_type", ["event_id"], ["user_id"])


@query(f"SELECT page_id, list_sum(x)::BIGINT AS total FROM (SELECT page_id, {_BYTES} AS x FROM (SELECT page_id, encode(url) AS b FROM pages))")
def byte_sums_pages(spark, sf_dir):
    x = native.bytes_of(F.col("url"))
    return pages(spark, sf_dir).select("page_id", F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query(f"""
SELECT page_id, ((n + list_sum(list_transform(range(1, n + 1), lambda i: x[i] * (n - i + 1)))) % 65521 * 65536 + (1 + list_sum(x)) % 65521)::BIGINT AS adler
FROM (SELECT page_id, {_BYTES} AS x, octet_length(b) AS n FROM (SELECT page_id, encode(url) AS b FROM pages))""")
def adler32_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", native.adler32(F.col("url")).alias("adler"))


@query(f"""
SELECT conv_id, ((n + coalesce(list_sum(list_transform(range(1, n + 1), lambda i: x[i] * (n - i + 1))), 0)) % 65521 * 65536 + (1 + coalesce(list_sum(x), 0)) % 65521)::BIGINT AS adler
FROM (SELECT conv_id, {_BYTES} AS x, octet_length(b) AS n FROM (SELECT conv_id, encode(string_agg(text, '' ORDER BY turn)) AS b FROM conversations WHERE text IS NOT NULL GROUP BY conv_id))""")
def adler32_of_conversations(spark, sf_dir):
    return native.adler32_of_chunks(conversations(spark, sf_dir), "text", ["turn"], ["conv_id"])


@query(f"SELECT page_id, list_reduce(x, lambda h, c: (h * 33 + c) % 4294967296, 5381::BIGINT) AS hash FROM (SELECT page_id, list_transform({_BYTES}, lambda v: v::BIGINT) AS x FROM (SELECT page_id, encode(url) AS b FROM pages))")
def djb2_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", native.djb2(F.col("url")).alias("hash"))


@query("SELECT event_id, round_even(value * 128, 0) / 128 AS q FROM events")
def quantize_scale_events(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", native.quantize_scale(F.col("value"), 2).alias("q"))


@query("SELECT vec_id, i, d FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE - CASE WHEN i > 1 THEN embedding[i - 1]::DOUBLE ELSE 0 END)) AS d FROM embeddings)")
def delta_encode_embeddings(spark, sf_dir):
    x = native.delta_encode(F.col("embedding").cast("array<double>"))
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(x).alias("i", "d")).withColumn("i", F.col("i").cast("long"))


@query("SELECT p_partkey, (p_partkey & 255)::INT AS b0, ((p_partkey >> 8) & 255)::INT AS b1, ((p_partkey >> 16) & 255)::INT AS b2, ((p_partkey >> 24) & 255)::INT AS b3 FROM part")
def byteshuffle_part(spark, sf_dir):
    x = native.byteshuffle_ints(F.array("p_partkey"), 4)
    return part(spark, sf_dir).select("p_partkey", *[x[i].alias(f"b{i}") for i in range(4)])


@query("SELECT p_partkey, " + ", ".join(f"(((p_size & 255) >> {7 - i}) & 1)::INT AS bit{i}" for i in range(8)) + " FROM part")
def packints_decode_part(spark, sf_dir):
    x = native.packints_decode(F.array(F.col("p_size").bitwiseAND(F.lit(255))), 1)
    return part(spark, sf_dir).select("p_partkey", *[x[i].alias(f"bit{i}") for i in range(8)])


@query("SELECT p_partkey, (" + " + ".join(f"(((p_size & 255) >> {i}) & 1) * {1 << 7 - i}" for i in range(8)) + ")::INT AS turned FROM part")
def bitorder_part(spark, sf_dir):
    return part(spark, sf_dir).select("p_partkey", native.bitorder(F.array(F.col("p_size").bitwiseAND(F.lit(255))))[0].alias("turned"))


@query("SELECT page_id, starts_with(html, 'BM') AND octet_length(encode(html)) > 54 AS bmp, starts_with(html, 'GIF87a') OR starts_with(html, 'GIF89a') AS gif, starts_with(html, '#?') AS rgbe FROM pages")
def checks_pages(spark, sf_dir):
    data = F.col("html").cast("binary")
    return pages(spark, sf_dir).select("page_id", *[native.check(n, data).alias(n) for n in ("bmp", "gif", "rgbe")])


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark, sf_dir):
    return documents(spark, sf_dir).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def _round_trip(name: str, sql: str = "SELECT page_id, sha256(html) AS digest FROM pages"):
    def run(spark, sf_dir):
        # one small file, much work for each row: dealt out first
        rows = pages(spark, sf_dir).select("page_id", "html").repartition("page_id")
        return rows.select("page_id", F.sha2(registry.decode(name, registry.encode(name, F.col("html").cast("binary"))), 256).alias("digest"))

    run.__name__ = f"roundtrip_{name}"
    return query(sql)(run)


for _name in ("zlib", "zlibng", "zopfli", "deflate", "gzip", "bz2", "lzma", "zstd", "brotli", "lz4", "lz4f", "lz4h5", "snappy", "packbits", "lzw", "lzf", "pglz", "checksum", "bitshuffle", "blosc", "blosc2", "none"):
    _round_trip(_name)


def _chain_trip(name: str, steps: list, column: str, table, key: str, sql: str):
    def run(spark, sf_dir):
        data = chunk(F.col(column).cast("string").cast("binary"), "u1")
        made = Chain(steps)
        return table(spark, sf_dir).select(key, F.sha2(made.decode(made.encode(data))["data"], 256).alias("digest"))

    run.__name__ = name
    return query(sql)(run)


_DOCS = "SELECT doc_id, sha256(text) AS digest FROM documents"
_chain_trip("chain_delta_lzw", [("delta", {}), ("lzw", {})], "html", pages, "page_id", "SELECT page_id, sha256(html) AS digest FROM pages")
_chain_trip("chain_bitshuffle_zstd", [("bitshuffle", {"itemsize": 1}), ("zstd", {})], "text", documents, "doc_id", _DOCS)
_chain_trip("chain_delta_bitshuffle_zstd", [("delta", {}), ("bitshuffle", {"itemsize": 1}), ("zstd", {})], "text", documents, "doc_id", _DOCS)
_chain_trip("chain_xor_lzma", [("xor", {}), ("lzma", {"level": 0})], "html", pages, "page_id", "SELECT page_id, sha256(html) AS digest FROM pages")


def lines_of(text: Column, width: int = 64, *channels: int) -> Column:
    """A text's bytes as an array of rows of `width` cells (of the channels given), filled up with zeros."""
    data, cells = text.cast("binary"), width * math.prod(channels)
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / cells)).cast("int")
    filled = F.rpad(data, rows * cells, F.lit(b"\0"))
    return F.when(data.isNotNull(), F.struct(F.lit("u1").alias("dtype"), F.array(rows, *[F.lit(n) for n in (width, *channels)]).alias("shape"), filled.alias("data")))


def text_digest(chunk: Column, text: Column) -> Column:
    """SHA-256 of the bytes of a chunk that lines_of made of the text."""
    return F.sha2(F.substr(chunk["data"], F.lit(1), F.octet_length(text.cast("binary"))), 256)


def _array_trip(name: str, table, key: str, column: str, *channels: int, decoder: str = "", width: int = 64, **options):
    """Whole texts as arrays, encoded and decoded."""

    def run(spark, sf_dir):
        rows = table(spark, sf_dir).select(key, column).repartition(key)
        made = registry.encode(name, lines_of(F.col(column), width, *channels))
        return rows.select(key, text_digest(registry.decode(decoder or name, made, **options), F.col(column)).alias("digest"))

    run.__name__ = f"{decoder}_decode_benchmark" if decoder else f"roundtrip_{name}"
    return query(f"SELECT {key}, sha256({column}) AS digest FROM {table.__name__}")(run)


for _name in ("delta", "xor", "byteshuffle", "bitorder", "numpy", "png", "spng", "apng", "bmp", "tiff"):
    _array_trip(_name, pages, "page_id", "html")
_array_trip("tga", pages, "page_id", "html", 4, width=16)
# slower kernels: the shorter texts
for _name in ("pcx", "ljpeg", "jpegls"):
    _array_trip(_name, benchmark, "item_id", "text")
_array_trip("ljpeg", benchmark, "item_id", "text", decoder="jpegsof3")
_array_trip("gif", benchmark, "item_id", "text", asrgb=False)
_array_trip("hcomp", benchmark, "item_id", "text", width=8, dtype="u1")
_array_trip("webp", benchmark, "item_id", "text", 4, width=16, hasalpha=True)
_array_trip("qoi", benchmark, "item_id", "text", 4, width=16)


def _exr_trip(spark, sf_dir):
    """Whole texts as rows of 16 unsigned samples."""
    cells = lines_of(F.col("html"), 16, 4)
    wide = F.struct(F.lit("u4").alias("dtype"), F.slice(cells["shape"], 1, 2).alias("shape"), cells["data"].alias("data"))
    rows = pages(spark, sf_dir).select("page_id", "html").repartition("page_id")
    return rows.select("page_id", text_digest(registry.decode("exr", registry.encode("exr", wide)), F.col("html")).alias("digest"))


_exr_trip.__name__ = "roundtrip_exr"
query("SELECT page_id, sha256(html) AS digest FROM pages")(_exr_trip)


@query("SELECT page_id, sha256(html) AS digest FROM pages")
def roundtrip_floatpred(spark, sf_dir):
    """Whole texts as the bits of floats."""
    cells = lines_of(F.col("html"), 16, 4)
    wide = F.struct(F.lit("f4").alias("dtype"), F.slice(cells["shape"], 1, 2).alias("shape"), cells["data"].alias("data"))
    rows = pages(spark, sf_dir).select("page_id", "html").repartition("page_id")
    return rows.select("page_id", text_digest(registry.decode("floatpred", registry.encode("floatpred", wide)), F.col("html")).alias("digest"))


@query("SELECT item_id, sha256(text) AS digest FROM benchmark")
def roundtrip_bfloat16(spark, sf_dir):
    """Every two bytes of a text as the high half of a float; no text has the bits of an infinity."""
    cells = lines_of(F.col("text"), 32, 2)
    wide = F.struct(F.lit("f4").alias("dtype"), F.slice(cells["shape"], 1, 2).alias("shape"), F.unhex(F.regexp_replace(F.hex(cells["data"]), "(....)", "0000$1")).alias("data"))
    back = registry.decode("bfloat16", registry.encode("bfloat16", wide))["data"]
    text = F.unhex(F.regexp_replace(F.hex(back), "0000(....)", "$1"))
    return benchmark(spark, sf_dir).select("item_id", F.sha2(F.substr(text, F.lit(1), F.octet_length("text")), 256).alias("digest"))


@query(_DOCS)
def roundtrip_rcomp(spark, sf_dir):
    """Digests as 16-bit integers."""
    made = registry.encode("rcomp", chunk(F.unhex(F.sha2("text", 256)), "i2", (16,)))
    return documents(spark, sf_dir).select("doc_id", F.lower(F.hex(registry.decode("rcomp", made, shape=(16,), dtype="i2")["data"])).alias("digest"))


def _packints_trip(name: str, bits: int, bitorder: str | None):
    """Bytes of the texts' digests as integers of so many bits."""

    def run(spark, sf_dir):
        data = chunk(F.unhex(F.regexp_replace(F.sha2("text", 256), "(..)", "$100")), "u2", (32,))
        back = registry.decode("packints", registry.encode("packints", data, bitspersample=bits, bitorder=bitorder), dtype="u2", bitspersample=bits, bitorder=bitorder)
        return documents(spark, sf_dir).select("doc_id", F.regexp_replace(F.lower(F.hex(back["data"])), "(..)00", "$1").alias("digest"))

    run.__name__ = name
    return query(_DOCS)(run)


_packints_trip("roundtrip_packints", 11, None)
_packints_trip("roundtrip_packints_lsb", 12, "<")
_packints_trip("roundtrip_packints_pairs", 10, ">")


def _light(v: str) -> str:
    """What the curve of sRGB, in steps of 2 ** -16 as profiles hold it, makes of a byte: 16 bits."""
    g, a, b, c, d = (round(x * 65536) / 65536 for x in (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045))
    return f"round_even(65535 * CASE WHEN {v} / 255.0 >= {d} THEN pow({a}::DOUBLE * {v} / 255 + {b}, {g}) ELSE {c}::DOUBLE * {v} / 255 END, 0)::INT"


@query(f"SELECT doc_id, array_to_string(list_transform(x[1:30], lambda v: {_light('v')}), ',') AS light FROM (SELECT doc_id, {_BYTES} AS x FROM (SELECT doc_id, unhex(sha256(text)) AS b FROM documents))")
def cms_light_of_digests(spark, sf_dir):
    """The digests' first 30 bytes as ten pixels, from sRGB to linear light."""
    data = chunk(F.substr(F.unhex(F.sha2("text", 256)), F.lit(1), F.lit(30)), "u1", (1, 10, 3))
    made = registry.encode("cms", data, profile="srgb", outprofile="linearrgb", outdtype="u2")["data"]
    words = F.transform(F.regexp_extract_all(F.hex(made), F.lit("...."), F.lit(0)), lambda x: F.conv(F.concat(F.substr(x, F.lit(3), F.lit(2)), F.substr(x, F.lit(1), F.lit(2))), 16, 10))
    return documents(spark, sf_dir).select("doc_id", F.array_join(words, ",").alias("light"))


@query("SELECT p_partkey, p_size AS value FROM part")
def roundtrip_plio(spark, sf_dir):
    """Sizes as one-byte rows; decoded, they are 32-bit integers."""
    made = registry.encode("plio", chunk(F.unhex(F.lpad(F.hex("p_size"), 2, "0")), "u1", (1,)))
    value = F.conv(F.hex(F.reverse(F.to_binary(F.hex(registry.decode("plio", made, npix=1)["data"]), F.lit("hex")).cast("binary"))), 16, 10)
    return part(spark, sf_dir).select("p_partkey", value.cast("int").alias("value"))


@query()
def jpeg_error_of_documents(spark, sf_dir):
    """Summed differences of digests as 8 x 4 pixels from what a JPEG of level 95 gives back."""
    data = chunk(F.unhex(F.sha2("text", 256)), "u1", (4, 8))
    rows = documents(spark, sf_dir).select("doc_id", data["data"].alias("a"), registry.decode("jpeg", registry.encode("jpeg", data))["data"].alias("b"))
    error = F.aggregate(F.zip_with(native.bytes_of(F.col("a")), native.bytes_of(F.col("b")), lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda t, v: t + v)
    return rows.select("doc_id", error.alias("error"))


@query("SELECT lang, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS raw_bytes FROM documents GROUP BY lang")
def sizes_by_language(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("raw_bytes"))


@query()
def compression_ratio_by_language(spark, sf_dir):
    packed = F.octet_length(registry.encode("zstd", F.col("text").cast("binary")))
    return documents(spark, sf_dir).select("lang", F.octet_length("text").alias("raw"), packed.alias("packed")).groupBy("lang").agg(F.sum("raw").alias("raw_bytes"), F.sum("packed").alias("packed_bytes"))


#: The codecs by what they take and give, as SQL counts them on its own.
_NAMES = {
    "bytes->bytes": "aec bitshuffle blosc blosc2 brotli bz2 checksum deflate dicomrle gzip lz4 lz4f lz4h5 lzf lzfse lzham lzma lzo lzw none packbits pglz snappy szip zlib zlibng zopfli zstd",
    "array->array": "bitorder byteshuffle cms delta floatpred quantize xor",
    "array->bytes": (
        "apng avif bcn bfloat16 bmp brunsli ccittfax3 ccittfax4 ccittrle dds eer exr float24 gif hcomp heif htj2k jetraw jpeg jpeg2k jpeg8 jpegls jpegsof3 jpegxl jpegxr jpegxs lerc ljpeg "
        "meshopt mozjpeg numpy packints pcodec pcx pixarlog plio png qoi quantize rcomp rgbe sperr spng sz3 tga tiff ultrahdr wavpack webp wic zfp"
    ).replace(" quantize", ""),
}


def _values(kind: str) -> str:
    return f"SELECT unnest(string_split('{_NAMES[kind]}', ' ')) AS name, '{kind}' AS kind"


@query(" UNION ALL ".join(map(_values, _NAMES)))
def codec_catalog(spark, sf_dir):
    return registry.catalog(spark).select("name", "kind")


@query("SELECT name, CASE WHEN name IN (" + ", ".join(f"'{c.name}'" for c in registry.CODECS.values() if not c.available) + ") THEN name || ' n/a' ELSE name || ' tesserae 0.1.0' END AS version FROM (" + " UNION ALL ".join(map(_values, _NAMES)) + ")")
def codec_versions(spark, sf_dir):
    return registry.catalog(spark).select("name", "version")


#: Codecs whose chains give back what they took, on arrays of bytes; every one, by itself.
LOSSLESS = "aec apng bitorder bitshuffle blosc blosc2 bmp brotli byteshuffle bz2 checksum deflate delta gzip jpegls lz4 lz4f lz4h5 lzf lzma lzw none numpy packbits pglz png snappy spng szip tiff xor zlib zlibng zopfli zstd".split()


@query("SELECT item_id, name, sha256(text) AS digest FROM benchmark, (SELECT unnest(string_split('" + " ".join(LOSSLESS) + "', ' ')) AS name)")
def chains_of_every_codec(spark, sf_dir):
    data = lines_of(F.col("text"))
    made = [F.struct(F.lit(n).alias("name"), text_digest(Chain([(n, {})]).decode(Chain([(n, {})]).encode(data)), F.col("text")).alias("digest")) for n in LOSSLESS]
    return benchmark(spark, sf_dir).repartition("item_id").select("item_id", F.explode(F.array(*made)).alias("x")).select("item_id", "x.name", "x.digest")


#: First bytes of files (hex), each also tried with 160 bytes behind it.
PROBES = (
    "89504E470D0A1A0A 424D 44445320 762F3101 474946383761 474946383961 1F8B FF4FFF51 0000000C6A502020 0D0A870A 4949BC FF10FF50 0000000C4A585320 4C6572633220 436E745A496D616765 04224D18 627678 716F6966 233F "
    "49492A00 4D4D002A 49492B00 4D4D002B 45502A00 5045002A 7776706B 7A6670 28B52FFD DD99 FF0A 0000000C4A584C20 789C 785E 7801 78DA 0000001C6674797061766966 0000001C6674797068656963 0000001C667479706D696631 0000001C6674797061626364 "
    "FFD8FFDB FFD8FFEE FFD8FFC3 FFD8FFC4 FFD8FFE000104A464946 FFD8FFE1001045786966 FFD8FFE00010 FFD8FFF7 FFD8FFE80020535049464600 F0 F1000000000000 000000009CFF 524946460000000057454250 5249464600000000 "
    "B168DE3A 0A050108 0A060108 80 0001 0002 934E554D5059 504B0304004E554D5059 504B0304 0000020000 0100000040000000 020000004000000042000000 0200000040000000 030000004000000041000000FF000000 00"
).split()


def _probe_sql() -> str:
    """The 73 checks by their published descriptions, on h, the hex digits of the bytes, n in number."""
    some = lambda hexes: "(" + " OR ".join(f"starts_with(h, '{x}')" for x in hexes) + ")"
    jpeg = some(["FFD8FFDB", "FFD8FFEE", "FFD8FFC3", "FFD8FFC4"]) + " OR starts_with(h, 'FFD8FF') AND substr(h, 13, 8) IN ('4A464946', '45786966')"
    rules = {name: some(hexes) for name, hexes in native.PREFIXES.items()}
    rules |= {"bmp": "n > 54 AND starts_with(h, '424D')", "hcomp": "n >= 25 AND starts_with(h, 'DD99')"}
    rules |= {name: f"CASE WHEN {some(hexes)} THEN true END" for name, hexes in native.MAYBE.items()}
    rules |= {name: "NULL::BOOLEAN" for name in native.UNKNOWN}
    rules |= {
        "avif": "CASE WHEN substr(h, 9, 16) = '6674797061766966' THEN true WHEN substr(h, 9, 8) = '66747970' THEN NULL ELSE false END",
        "heif": "CASE WHEN substr(h, 9, 16) IN ('6674797068656963', '6674797068656978', '667479706865766D', '667479706D696631') THEN true WHEN substr(h, 9, 8) = '66747970' THEN NULL ELSE false END",
        "cms": "CASE WHEN n < 40 THEN false WHEN substr(h, 73, 8) = '61637370' THEN true END",
        "jpeg8": jpeg,
        "mozjpeg": jpeg,
        "jpeg": jpeg,
        "ultrahdr": "CASE WHEN starts_with(h, 'FFD8FF') THEN NULL ELSE false END",
        "jpegls": "CASE WHEN starts_with(h, 'FFD8FFF7') OR starts_with(h, 'FFD8FFE8') AND substr(h, 13, 12) = '535049464600' THEN true END",
        "lz4h5": "CASE WHEN n < 12 THEN false END",
        "lzo": "CASE WHEN n > 5 AND substr(h, 1, 2) IN ('F0', 'F1') THEN true END",
        "plio": "substr(h, 9, 4) = '9CFF'",
        "webp": "starts_with(h, '52494646') AND substr(h, 17, 8) = '57454250'",
        "tga": "right(h, 36) = '54525545564953494F4E2D5846494C452E00' OR n >= 18 AND substr(h, 3, 2) IN ('00', '01') AND substr(h, 5, 2) IN ('01', '02', '03', '09', '0A', '0B')",
        "pcx": "starts_with(h, 'B168DE3A') OR n >= 128 AND starts_with(h, '0A') AND substr(h, 3, 2) IN ('00', '02', '03', '04', '05') AND substr(h, 5, 2) IN ('00', '01') AND substr(h, 7, 2) IN ('01', '02', '04', '08')",
        "lzw": "starts_with(h, '80') OR starts_with(h, '00') AND substr(h, 4, 1) IN ('1', '3', '5', '7', '9', 'B', 'D', 'F')",
        "numpy": "starts_with(h, '934E554D5059') OR starts_with(h, '504B') AND contains(substr(h, 1, 128), '4E554D5059')",
        "dicomrle": "CASE WHEN n < 64 THEN false ELSE substr(h, 1, 8) IN (" + ", ".join(f"'{i:02X}000000'" for i in range(1, 16)) + ") AND substr(h, 9, 8) = '40000000'"
        + " AND len(list_filter(range(1, ('0x' || substr(h, 1, 2))::INT + 1), lambda i: list_contains(['00000000'], substr(h, 8 * i + 1, 8)) OR try_cast('0x' || substr(h, 8 * i + 7, 2) || substr(h, 8 * i + 5, 2) || substr(h, 8 * i + 3, 2) || substr(h, 8 * i + 1, 2) AS BIGINT) >= n)) = 0 END",
        "snappy": "CASE WHEN n = 0 THEN false END",
        "wic": "false",
    }
    probes = "SELECT unnest(string_split('" + " ".join(PROBES) + "', ' ')) AS p"
    each = ", ".join(f"{{'name': '{name}', 'result': {rule}}}" for name, rule in sorted(rules.items()))
    return f"SELECT probe, x.name AS name, x.result AS result FROM (SELECT h AS probe, unnest([{each}]) AS x FROM (SELECT h, len(h) // 2 AS n FROM (SELECT p AS h FROM ({probes}) UNION ALL SELECT p || repeat('00', 160) FROM ({probes}))))"


@query(_probe_sql())
def checks_of_probes(spark, sf_dir):
    names = sorted({*native.PREFIXES, *native.MAYBE, *native.UNKNOWN, *"avif heif cms jpeg8 mozjpeg jpeg ultrahdr jpegls lz4h5 lzo plio webp tga pcx lzw numpy dicomrle snappy wic".split()})
    rows = spark.createDataFrame([(x + tail,) for x in PROBES for tail in ("", "00" * 160)], "probe string")
    checked = [F.struct(F.lit(n).alias("name"), registry.check(n, F.unhex("probe")).alias("result")) for n in names]
    return rows.select("probe", F.explode(F.array(*checked)).alias("x")).select("probe", "x.name", "x.result")


@query()
def lookup3_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", registry.checksum("lookup3", F.col("url").cast("binary")).alias("hash"))


@query(f"""
SELECT page_id, (CASE WHEN b = 0 THEN 0 ELSE (b - 1) % 65535 + 1 END * 65536 + CASE WHEN a = 0 THEN 0 ELSE (a - 1) % 65535 + 1 END)::BIGINT AS hash
FROM (SELECT page_id, list_sum(w) AS a, list_sum(list_transform(range(1, len(w) + 1), lambda i: w[i] * (len(w) - i + 1))) AS b
  FROM (SELECT page_id, list_transform(range(1, len(x) + 1, 2), lambda i: x[i]::BIGINT * 256 + coalesce(x[i + 1], 0)) AS w
    FROM (SELECT page_id, {{_BYTES}} AS x FROM (SELECT page_id, encode(url) AS b FROM pages))))""".replace("{_BYTES}", _BYTES))
def fletcher32_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", native.fletcher32(F.col("url")).alias("hash"))
