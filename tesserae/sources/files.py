"""Files of images and arrays as tables of chunks, and back."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import images
from tesserae.plans.pipeline import Chain
from tesserae.registry import CODECS, sniff
from tesserae.schema import CHUNK, from_array, to_array


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, length, codec (by signature, else by extension) and content of every file."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    by_name = {e: c.name for c in CODECS.values() for e in c.extensions}
    names = F.create_map(*[F.lit(x) for kv in by_name.items() for x in kv])
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return reader.load(path).select("path", "length", F.coalesce(sniff(F.col("content")), F.try_element_at(names, ext)).alias("codec"), "content")


def read_images(spark: SparkSession, path: str, codec: str | None = None, index: int | None = None, glob: str | None = None) -> DataFrame:
    """path, codec, page, chunk, error: one row for each page of each file, or page `index`."""
    files = read_files(spark, path, glob)
    if codec:
        files = files.withColumn("codec", F.lit(codec))
    decoders = {c.name: c.decode for c in CODECS.values() if c.decode and c.kind == "array->bytes"}

    def frames(f):
        def split(data):
            whole, first = f(data), f(data, 0)
            return list(whole) if whole.ndim > first.ndim else [whole]

        return split

    paged = {"tiff": lambda d: [images._tiff_page(d, t) for t in images.tiff_pages(d)], "numpy": images.numpy_arrays, "apng": frames(images.apng_decode), "png": frames(images.apng_decode), "gif": frames(images.gif_decode)}

    def decode(batches):
        for b in batches:
            rows = []
            for p, name, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    pages = paged[name](content) if name in paged else [decoders[name](content)]
                    rows += [(p, name, i, from_array(x), None) for i, x in enumerate(pages) if index is None or i == index]
                except Exception as e:
                    rows.append((p, name, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.struct([("dtype", pa.string()), ("shape", pa.list_(pa.int32())), ("data", pa.binary())]), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "codec", "page", "chunk", "error"])

    return files.select("path", "codec", "content").mapInArrow(decode, f"path string, codec string, page int, chunk {CHUNK}, error string")


def write_images(df: DataFrame, folder: str, codec: str, path: str = "path", column: str = "chunk", **options) -> DataFrame:
    """One file for each row: `column`, a chunk, encoded, at folder/path, on any store that pyarrow reaches. Gives path
    and length of the files as they are written, so it writes when the result is read. A file appears under its name
    only once it is whole, and one written again by a repeated task replaces the first."""
    encode = CODECS[codec].encode
    if encode is None or CODECS[codec].kind != "array->bytes":
        raise NotImplementedError(f"{codec} does not encode images")

    def write(batches):
        from uuid import uuid4

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for b in batches:
            sizes = []
            for name, chunk in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = encode(to_array(chunk), **options)
                at = f"{root.rstrip('/')}/{name}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                part = f"{at}.{uuid4().hex}.part"
                with store.open_output_stream(part) as f:
                    f.write(data)
                store.move(part, at)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["path", "length"])

    rows = df.where(F.col(path).isNotNull() & F.col(column).isNotNull())
    return rows.select(F.col(path).cast("string"), column).mapInArrow(write, "path string, length long")


#: The file in a store's folder that says how its chunks are coded.
LAYOUT = "_chain.json"


def write_chunks(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists", chain: Chain | None = None, column: str = "chunk") -> None:
    """A chunk store: Parquet, dealt by the columns named. With a chain, `column` is stored encoded, and the chain beside
    the chunks."""
    spark = df.sparkSession
    writer = (df.withColumn(column, chain.encode(F.col(column))) if chain else df).write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    if chain:
        _text(spark, path, json.dumps({"column": column, "chain": json.loads(chain.to_json())}))


def read_chunks(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """A chunk store, decoded by the chain beside it. `where` selects chunks by the other columns (their place in the
    array, say) before any is decoded: on partition columns only the folders needed are read."""
    rows = spark.read.parquet(path)
    rows = rows.where(where) if where else rows
    layout = _text(spark, path)
    if layout is None:
        return rows
    own = json.loads(layout)
    return rows.withColumn(own["column"], Chain.from_json(json.dumps(own["chain"])).decode(F.col(own["column"])))


def _text(spark: SparkSession, folder: str, text: str | None = None) -> str | None:
    """Writes the layout file of a store, or reads it (None if there is none)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder, LAYOUT)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if text is not None:
        out = store.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
        return None
    if not store.exists(p):
        return None
    stream = store.open(p)
    raw = bytes(stream.readAllBytes())
    stream.close()
    return raw.decode()


def imagefileext() -> list[str]:
    return sorted({e for c in CODECS.values() for e in c.extensions})
