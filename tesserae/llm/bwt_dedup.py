"""Repeated byte strings by column-wise multi-document construction of a Burrows-Wheeler order.

Only windows whose anchor repeats (see anchors.py) can repeat. The stretch of a document around such an anchor is a
fragment, laid out so that all anchors share one column; equal windows then share their columns too. Equal fragments
are counted and kept once. Blocks of distinct fragments (stretches.py) are built column by column from the right: each
round inserts one symbol per fragment in front of its suffix, which updates the collection's order (a stable sort by
the new symbol of the order before, as in the multi-string Burrows-Wheeler transform) and the longest common prefixes
of neighbours (one more than the smallest one between them, where the symbols agree). A neighbour with a common prefix
of `length` bytes is a repeat. A column is read once, in sequence, and only the state of the last round is held.

The fragments of a very frequent anchor are cut in halves by the distance of their windows from it, and each half is
dealt by the bytes its windows share, until a block is small; so the largest groups go the same way. A block holds some
20,000 fragments at most, of under 2 * `length` bytes: its columns fit in memory, and come from the sorted shuffle files
of Spark. Files of this operator's own would hold the same bytes once more.

Nulls: a null text is empty. Texts under `length` bytes stay whole. Rows with one doc_id and one text count as two
places, so both lose what they share; ties do not occur. A text is held by one task as about 60 bytes for each of its
bytes. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.anchors import Windows, in_sketch, opened, repeated_anchors
from tesserae.llm.common import arrow_map, byte_values, chunks, keyed_documents, written
from tesserae.llm.stretches import class_id, solved

ANCHOR_BYTES = 24


def _byte_layout(buf: np.ndarray, offsets: np.ndarray):
    return byte_values()[buf], offsets


def repeats(fragments: list[bytes], before: np.ndarray, length: int) -> np.ndarray:
    """For each fragment and column, whether the `length` bytes from there occur in the same column of another one.
    before[i]: bytes of fragment i in front of its anchor."""
    n = len(fragments)
    sizes = np.array([len(f) for f in fragments])
    left = int(before.max())
    begin = left - before
    end = begin + sizes
    width = int(end.max())
    data = np.frombuffer(b"".join(fragments), np.uint8)
    cells = np.zeros((width, n), np.uint8)
    of = np.repeat(np.arange(n), sizes)
    at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cells[at + np.repeat(begin, sizes), of] = data
    dup = np.zeros((width, n), bool)
    order = np.arange(n)
    shared = np.zeros(n, np.int32)  # common prefix with the one before in the order, at most `length`
    for column in range(width - 1, -1, -1):
        symbol = cells[column].astype(np.int16) + 1
        symbol[(column < begin) | (column >= end)] = 0
        now = symbol[order]
        move = np.argsort(now, kind="stable")
        # smallest common prefix between consecutive ones of a symbol in the order before
        far = np.diff(move)
        same = now[move[1:]] == now[move[:-1]]
        fresh = np.zeros(n, np.int32)
        if n > 1:
            lows = _range_min(shared, move[:-1][same] + 1, move[1:][same] + 1, int(far[same].max()) if same.any() else 1)
            fresh[1:][same] = np.minimum(lows + 1, length)
        order = order[move]
        fresh[now[move] == 0] = 0
        shared = fresh
        hit = shared >= length
        if hit.any():
            which = hit.copy()
            which[:-1] |= hit[1:]
            dup[column, order[which]] = True
    return dup


def _range_min(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, longest: int) -> np.ndarray:
    """Smallest of x[lo:hi] for each pair, by tables of runs of powers of two."""
    size = hi - lo
    level = np.frexp(size.astype(np.float64))[1] - 1
    out = np.empty(len(lo), x.dtype)
    table, k = x, 0
    while True:
        pick = np.flatnonzero(level == k)
        if len(pick):
            out[pick] = np.minimum(table[lo[pick]], table[hi[pick] - (1 << k)])
        if (2 << k) > longest:
            return out
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        k += 1


def _packed(starts: np.ndarray, length: int) -> bytes:
    """Runs [start, end) of a fragment's repeated windows, as pairs of 32-bit integers."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    a, b = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + length
    return np.stack([a, b], 1).astype("<i4").tobytes()


def fragments(keyed: DataFrame, windows: Windows, sketch) -> DataFrame:
    """did, tid, start, key (the anchor), before (bytes in front of it) and content of every stretch whose anchor may
    repeat."""

    def emit(batches):
        bits = opened(sketch)
        for batch in batches:
            did, tid = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, buf, offsets in chunks(batch.column(2)):
                values, at, starts, place, grams = windows.of(buf, offsets)
                if not len(starts):
                    continue
                own = np.searchsorted(at, starts, "right") - 1
                key = place + own * np.int64(1 << 40)
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                last = np.r_[first[1:], len(key)] - 1
                h = grams[place[first]]
                hit = np.flatnonzero(in_sketch(bits, h))
                first, last, h = first[hit], last[hit], h[hit]
                s, e, own = starts[first], starts[last] + windows.length, own[first]
                raw = buf.tobytes()
                for k in range(0, len(s), 20_000):
                    t = slice(k, k + 20_000)
                    parts = [raw[a:b] for a, b in zip(s[t].tolist(), e[t].tolist(), strict=True)]
                    cols = (did[i + own[t]], tid[i + own[t]], s[t] - at[own[t]], h[t].view(np.int64), (place[first] - s)[t].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(parts, pa.binary())], ["did", "tid", "start", "key", "before", "content"])

    return arrow_map(keyed.select("did", "tid", "text"), emit, "did long, tid long, start long, key long, before int, content binary")


def halves(length: int):
    """Cuts fragments of a frequent key in two: the windows that begin nearer to the anchor and those that begin
    farther from it, by halves of the range lo to hi of distances. All windows of a half share the bytes between its
    farthest start and its first end, and these become its key: in the end, the whole window."""

    def split(batches):
        for b in batches:
            rows = []
            names = ("c1", "c2", "key", "lo", "hi", "before", "n", "content")
            for c1, c2, key, lo, hi, before, n, content in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in names), strict=True):
                middle = (lo + hi + 1) // 2
                for near, far in ((lo, middle), (middle, hi)):  # windows that begin near <= distance < far in front of the anchor
                    first, last = max(0, before - far + 1), min(len(content) - length, before - near)
                    if near < far and first <= last:
                        shared = content[before - near : before - far + 1 + length]
                        part = int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=f"{key} {near} {far}".encode()).digest(), "little", signed=True)
                        rows.append((c1, c2, first, part, near, far, before - first, n, content[first : last + length]))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["p1", "p2", "shift", "key", "lo", "hi", "before", "n", "content"])

    return split


PART = "p1 long, p2 long, shift int, key long, lo int, hi int, before int, n long, content binary"


def repeated_block(length: int):
    """The repeated windows of the classes of a block's keys, built column by column."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        n, text = t.column("n").to_numpy(), t.column("content").to_pylist()
        c1, c2, key = (t.column(x).to_numpy() for x in ("c1", "c2", "key"))
        _, inverse, size = np.unique(key, return_inverse=True, return_counts=True)
        build = np.flatnonzero(size[inverse] > 1)
        spans: dict[int, bytes] = {}
        for i in np.flatnonzero(n > 1).tolist():
            spans[i] = _packed(np.arange(len(text[i]) - length + 1), length)
        if len(build):
            before = t.column("before").to_numpy()[build].astype(np.int64)
            dup = repeats([text[i] for i in build.tolist()], before, length)
            shift = int(before.max()) - before
            for j in np.flatnonzero(dup.any(0) & (n[build] == 1)).tolist():
                spans[int(build[j])] = _packed(np.flatnonzero(dup[:, j]) - shift[j], length)
        rows = np.array(sorted(spans), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c1[rows]), pa.array(c2[rows]), pa.array([spans[i] for i in rows.tolist()], pa.binary())], ["c1", "c2", "spans"])

    return solve


def repeated_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """did, tid, spans array<struct<start, spans>>: for each document that has any, byte runs of repeated windows,
    as packed runs from the start of a fragment."""
    windows = Windows(length, min(ANCHOR_BYTES, length), _byte_layout)
    keyed = keyed_documents(docs)
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_anchors(keyed, windows))
    own = fragments(keyed, windows, sketch)
    reach = F.lit(length - windows.k + 1)
    classes = own.groupBy("key", "before", "content").agg(F.count("*").alias("n"))
    classes = written(classes.select("key", F.lit(0).alias("lo"), reach.alias("hi"), "before", "n", "content").withColumns(class_id()), "classes")
    again = lambda cut: cut.groupBy("key", "lo", "hi", "before", "content").agg(F.sum("n").alias("n")).select("key", "lo", "hi", "before", "n", "content").withColumns(class_id())
    spans, _ = solved(classes, again, halves(length), PART, repeated_block(length), "spans binary")
    found = own.select("did", "tid", "start", *[x.alias(n) for n, x in class_id().items()]).join(spans, ["c1", "c2"])
    return found.groupBy("did", "tid").agg(F.collect_list(F.struct((F.col("start") + F.col("shift")).alias("start"), "spans")).alias("spans"))


def suffix_dedup(docs: DataFrame, length: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (maximal runs of removed bytes) and kept (the bytes left, concatenated)."""
    keyed = keyed_documents(docs)
    joined = keyed.join(repeated_spans(docs, length), ["did", "tid"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        for batch in batches:
            spans, ids = batch.column(2), batch.column(0)
            for i, buf, offsets in chunks(batch.column(1)):
                kept, gone, runs = [], [], []
                for j in range(len(offsets) - 1):
                    own = buf[offsets[j] : offsets[j + 1]]
                    removed = []
                    if spans[i + j].is_valid:
                        edge = np.zeros(len(own) + 1, np.int64)
                        for x in spans[i + j].as_py():
                            pair = np.frombuffer(x["spans"], "<i4").reshape(-1, 2) + x["start"]
                            np.add.at(edge, pair[:, 0], 1)
                            np.add.at(edge, pair[:, 1], -1)
                        cover = np.r_[0, (np.cumsum(edge[:-1]) > 0).view(np.int8), 0]
                        turn = np.flatnonzero(np.diff(cover))
                        removed = [{"start": int(a), "end": int(b)} for a, b in turn.reshape(-1, 2)]
                        own = own[cover[1:-1] == 0]
                    kept.append(own.tobytes())
                    gone.append(int(offsets[j + 1] - offsets[j]) - len(own))
                    runs.append(removed)
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(kept)), pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(runs, RUNS), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "removed", "kept"])

    return arrow_map(joined, cut, "doc_id long, n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary")


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def op5(spark, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import documents

    out = suffix_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
