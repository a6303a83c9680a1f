"""What the corpus operators share: tables, scratch tables, process-wide caches and byte-level text kernels."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import sys
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: Bytes of text that a kernel holds as numpy arrays at once; one longer document is held alone.
CHUNK_BYTES = 700_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only in local mode may it be unset, and is then of this machine."""
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "_tesserae_scratch" not in sys.__dict__:
        sys._tesserae_scratch = tempfile.mkdtemp(prefix="tesserae-")
        atexit.register(shutil.rmtree, sys._tesserae_scratch, True)
    return "file://" + sys._tesserae_scratch


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the scratch folder: cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if not WRITTEN:
        atexit.register(_drop_all)
    WRITTEN[path] = spark
    return out


#: Scratch tables that stand, with their sessions; those that a result still reads go at the driver's end.
WRITTEN: dict[str, SparkSession] = {}


def _delete(path: str, spark: SparkSession) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    WRITTEN.pop(path, None)


def _drop_all() -> None:
    for path, spark in list(WRITTEN.items()):
        try:
            _delete(path, spark)
        except Exception:  # the JVM has gone
            return


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables that written() made, when nothing reads them any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(path, df.sparkSession)


#: Bytes of a batch on its way to Python: both sides hold a few of them.
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow in batches of about BATCH_BYTES (set for the session); what a task freed goes back at its end,
    so workers that serve many stages don't add up."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(_returning(f), schema)


def _returning(f):
    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return run


def process_cache(name: str, make):
    """A value kept as long as the Python worker lives, over tasks."""
    store = sys.__dict__.setdefault("_tesserae_cache", {})
    if name not in store:
        store[name] = make()
    return store[name]


def keyed_documents(docs: DataFrame, *more: str) -> DataFrame:
    """did (doc_id, null as the smallest long), tid (a hash of the text, so that rows that share a doc_id but not
    the text stay apart), doc_id, text and the columns named."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"),
        F.xxhash64(F.col("text")).alias("tid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        *more,
    )


# ---- byte kernels ----


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i < n."""

    def grow(b: int) -> np.ndarray:
        a = np.full(size, b, np.uint64)
        a[0] = 1
        return np.multiply.accumulate(a)

    key = f"powers{base}"
    have = process_cache(key, lambda: (np.zeros(0, np.uint64),) * 2)
    if len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        have = (grow(base), grow(pow(base, -1, 2**64)))
        if size <= 4 * CHUNK_BYTES:
            sys.__dict__["_tesserae_cache"][key] = have
    return have[0][:n], have[1][:n]


#: Two odd bases; a window's pair of hashes stands for its contents.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span: differences of prefix sums of value * base ** i, shifted back."""
    n = len(values)
    power, inverse = _powers(base, n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * power[:n], out=sums[1:])
    return splitmix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * U(0x9FB21C651E98DF25))


def gram_hashes(values: np.ndarray, k: int, base: int = BASES[0]) -> np.ndarray:
    """span_hashes of every k consecutive values."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(base, n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * power[:n], out=sums[1:])
    return splitmix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def byte_values() -> np.ndarray:
    return process_cache("bytes", lambda: splitmix(np.arange(1, 257, dtype=np.uint64) * U(0x2545F4914F6CDD1D)))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of UTF-8 documents laid end to end, and offsets of the
    documents in these lists."""
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    word = ~space
    before = np.empty(len(buf), bool)
    before[:1] = False
    before[1:] = word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(buf)]
    before[inner] = False
    after = np.empty(len(buf), bool)
    after[-1:] = False
    after[:-1] = word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def chunks(column, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets from 0) of an Arrow string column in runs of at most limit bytes, or one row.
    A null is an empty text."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def sliding_argmin(keys: np.ndarray, w: int) -> np.ndarray:
    """For every run of w values, the place of its smallest one, the first of equals."""
    n = len(keys)
    bits = max(8, int(n).bit_length())
    m = (keys >> U(bits) << U(bits)) | np.arange(n, dtype=np.uint64)
    have = 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
    return (m & U((1 << bits) - 1)).astype(np.int64)


def merged_runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by [s, s + length) over ascending starts; touching ones join."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + length
