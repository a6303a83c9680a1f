"""Which content-chosen anchors occur twice: the filter before the exact search for repeated windows.

Every window of a document (20 words, or 200 bytes) takes as its anchor the k-gram with the smallest hash inside it.
Equal windows have equal anchors, so a window whose anchor occurs once is unique and never leaves its scan task.
Repeated anchors go into a bit map of LOAD bits each, of at most MOST_BITS whatever the corpus, so the broadcast has a
proven bound: a false hit only costs a row of the exact search. A corpus with many more repeated anchors fills the map,
and its windows then all go through the exact search; none is ever given up.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import U, arrow_map, chunks, drop_written, gram_hashes, process_cache, sliding_argmin, written

#: At LOAD bits for each anchor, one window in 30 to 60 that does not repeat passes.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 30
SLICES = 64
LOAD = 32
#: Anchors that one task counts together before they go to the shuffle.
FLUSH = 1_000_000


class Windows:
    """Windows of `length` values whose anchors are grams of `k` values; layout(buf, offsets) gives values and the
    offsets of documents among them."""

    def __init__(self, length: int, k: int, layout):
        self.length, self.k, self.layout = length, k, layout

    def of(self, buf: np.ndarray, offsets: np.ndarray):
        """values, document offsets among them, starts of the windows, each one's anchor place, hashes by place."""
        values, at = self.layout(buf, offsets)
        none = np.zeros(0, np.int64)
        if len(values) < self.length:
            return values, at, none, none, np.zeros(0, np.uint64)
        grams = gram_hashes(values, self.k)
        place = sliding_argmin(grams, self.length - self.k + 1)
        n = np.maximum(np.diff(at) - self.length + 1, 0)
        total = int(n.sum())
        starts = np.arange(total) + np.repeat(at[:-1] - (np.cumsum(n) - n), n)
        return values, at, starts, place[starts], grams


def first_of_runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def repeated_anchors(docs: DataFrame, windows: Windows) -> bytes:
    """The packed bit map of the anchors that occur twice."""

    def count(batches):
        held, n = [], 0

        def out():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for batch in batches:
            for _, buf, offsets in chunks(batch.column(0)):
                _, at, starts, place, grams = windows.of(buf, offsets)
                own = np.searchsorted(at, starts, "right")
                pick = first_of_runs(place * np.int64(1) + own * np.int64(1 << 40))
                held.append(grams[place[pick]])
                n += len(pick)
                if n >= FLUSH:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    found = arrow_map(docs.select("text"), count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    found = written(found.select("h"), "anchors")
    made = _sketch(found, min(MOST_BITS, max(LEAST_BITS, 1 << (found.count() * LOAD).bit_length())))
    drop_written(found)
    return made


def _sketch(found: DataFrame, size: int) -> bytes:
    """The bit map, merged in slices on the executors; the driver gets size / 8 bytes at most."""
    width = size // SLICES

    def bits(batches):
        own = np.zeros(size // 8, np.uint8)
        for b in batches:
            i = bit_of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)
            np.bitwise_or.at(own, i >> 3, (1 << (i & 7)).astype(np.uint8))
        each = own.reshape(SLICES, -1)
        full = np.flatnonzero(each.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([zlib.compress(each[i], 1) for i in full], pa.binary())], ["slice", "bits"])

    def merge(key, t):
        own = np.zeros(width // 8, np.uint8)
        for x in t.column("bits").to_pylist():
            own |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(own, 1)], pa.binary())], ["slice", "bits"])

    parts = arrow_map(found, bits, "slice int, bits binary").groupBy("slice").applyInArrow(merge, "slice int, bits binary")
    whole = np.zeros((SLICES, width // 8), np.uint8)
    for row in parts.collect():
        whole[row["slice"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return zlib.compress(whole.tobytes(), 1)


def bit_of(h: np.ndarray, size: int) -> np.ndarray:
    # anchors are the smallest hashes of their windows: spread them over the whole map first
    return (h * U(0xD1342543DE82EF95) >> U(64 - size.bit_length() + 1)).astype(np.int64)


def in_sketch(sketch: np.ndarray, h: np.ndarray) -> np.ndarray:
    i = bit_of(h, 8 * len(sketch))
    return (sketch[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1


def opened(shared) -> np.ndarray:
    """The bit map of a broadcast, opened once in each worker."""
    held = process_cache("sketch", dict)
    key = zlib.crc32(shared.value), zlib.adler32(shared.value), len(shared.value)
    if key not in held:
        held.clear()
        held[key] = np.frombuffer(zlib.decompress(shared.value), np.uint8)
    return held[key]
