"""Best-fit decreasing packing of token pieces, with a segment tree over the remaining capacities.

Tokens come from wordpieces.py.

The pieces are only numbers to the packing: equal lengths are interchangeable, so the driver plans over the counts of
the lengths (at most `capacity` of them, whatever the corpus). Lengths are taken in decreasing order; a segment tree
over the capacities 0..capacity, that holds how many open bins have each, finds the tightest bin that fits in
logarithmic time, and the run of equal pieces fills all bins of that capacity at once. The plan is exact best-fit
decreasing of all pieces: a list of bin groups, each with the bins it splits from. Pieces then take their places by
their rank among pieces of their length, which comes from counts per scan task, never from one global sort.

Nulls: a null text is empty (one token, the end id); a null doc_id is an id of its own. Repeated rows are packed
each. Longer documents than `capacity` are cut there; the last piece may be shorter. Very long texts are tokenized in
parts, and words of any length in n log n steps. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, chunks, keyed_documents, process_cache, written
from tesserae.llm.wordpieces import Encoder, parts

CAPACITY = 4096
END_ID = 1
#: Bytes of text tokenized at once; what fits a core's cache is fastest.
TOKEN_BYTES = 500_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task and turn (a piece's rank among its task's of that length)."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        from pyspark import TaskContext

        encoder = process_cache(f"encoder {path}", lambda: Encoder(path))
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for k, buf, offsets in chunks(batch.column(1), TOKEN_BYTES):
                if len(buf) > 2 * TOKEN_BYTES:  # one long text
                    ids = np.concatenate([encoder.batch(x, np.array([0, len(x)]))[0] for x in parts(buf, TOKEN_BYTES)])
                    at = np.array([0, len(ids)])
                else:
                    ids, at = encoder.batch(buf, offsets)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    for i, s in enumerate(range(0, len(own), capacity)):
                        n = min(capacity, len(own) - s)
                        rows.append((k, i, s, n, zlib.crc32(own[s : s + n].tobytes()), int(seen[n])))
                        seen[n] += 1
                    k += 1
            k, i, s, n, crc, turn = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), pa.array(i.astype(np.int32)), *map(pa.array, (s, n, crc)), pa.array(np.full(len(n), task, np.int32)), pa.array(turn)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "turn"])

    return arrow_map(keyed_documents(docs).select("doc_id", "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, turn long")


class CapacityTree:
    """Counts of open bins by remaining capacity; fit(n) is the smallest capacity >= n that has any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        at = room + self.leaves
        while at:
            self.sums[at] += bins
            at >>= 1

    def fit(self, n: int) -> int | None:
        at = n + self.leaves
        if self.sums[at]:
            return n
        while at > 1:
            if not at & 1 and self.sums[at + 1]:  # the nearest subtree to the right that has a bin
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.sums[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing over counts of lengths. For each length, in order of rank: (pieces, first bin, pieces in
    each bin, place of the first one in its bin)."""
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[list[int]]] = {}  # by room left: [first bin, bins]
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins.setdefault(room, []).append([first, n])
            tree.add(room, n)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, own = counts[length], []
        while left:
            room = tree.fit(length)
            if room is None:  # new bins, each filled with as many as it takes, as one by one would
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    own.append((full * each, bins, each, 0))
                    put(capacity - each * length, bins, full)
                    bins += full
                if rest:
                    own.append((rest, bins, rest, 0))
                    put(capacity - rest * length, bins, 1)
                    bins += 1
                break
            first, n = open_bins[room][-1]
            each = min(room // length, left)
            use = min(n, left // each)
            own.append((use * each, first, each, capacity - room))
            tree.add(room, -use)
            if use == n:
                open_bins[room].pop()
            else:
                open_bins[room][-1] = [first + use, n - use]
            put(room - each * length, first, use)
            left -= use * each
        out[length] = own
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    cut = written(pieces(docs, tokenizer, capacity), "pieces")
    tasks = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = {n: np.array(rows, np.int64).reshape(-1, 4) for n, rows in plan(counts, capacity).items()}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(table)
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = tasks.select("length", "task", F.coalesce(before, F.lit(0)).cast("long").alias("before"))

    def place(batches):
        table = shared.value
        ends = {n: np.cumsum(x[:, 0]) for n, x in table.items()}
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                i = np.searchsorted(ends[n], rank[own], "right")
                run = table[n][i]
                turn = rank[own] - (ends[n][i] - run[:, 0])
                sequence[own] = run[:, 1] + turn // run[:, 2]
                offset[own] = run[:, 3] + turn % run[:, 2] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(offsets, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("turn")).alias("rank"))
    return arrow_map(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4(spark, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import documents

    return pack(documents(spark, sf_dir))
