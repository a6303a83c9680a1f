"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard checks.

A document's set holds the distinct 5-word shingles of its text, A-Z lower-cased. Two permutations of 32-bit numbers
make the whole signature: the first scatters the shingles, the second, shifted circularly by k, gives coordinate k
(its smallest value over the set). Coordinates are cut into bands; documents that agree on a band meet in a bucket.

Documents with equal sets form one class from the start, and only the class goes on, so exact copies, however many,
cost one row. Buckets with the same members in several bands count once. A bucket is dealt over tiles of about TILE
members; in a tile all pairs are compared on their full sets at once (a product of occurrence matrices), and the links
of a spanning forest leave it, never all pairs. About PIVOTS members of a bucket are in all of its tiles, so that a
group of near copies, however large, becomes one component by work that grows with its size. Only members outside
their bucket's largest component are then compared with the whole bucket, so no link between components is lost. Links
are closed to components.
With BANDS x ROWS = 16 x 4 a pair at the similarity of 0.85 is missed with probability (1 - 0.85^4)^16 = 7.5e-6; a lower
similarity takes more bands (at 0.8, 23 bands miss (1 - 0.8^4)^23 = 5.4e-6).

Nulls and texts without words: an empty set, linked with nothing. A null doc_id: n_shingles is given, it is linked
with nothing and kept. Rows that share a doc_id count as one document. A text is held by one task as about 60 bytes for
each of its bytes. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, byte_values, chunks, drop_written, gram_hashes, keyed_documents, span_hashes, splitmix, word_spans, written
from tesserae.llm.components import components

BANDS, ROWS = 16, 4
#: Sets compared at once; of a larger bucket, so many are in every tile of it.
TILE, PIVOTS = 256, 8
SHINGLE = 5


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return buf + ((buf >= 65) & (buf <= 90)) * np.uint8(32)


def shingle_sets(column, words: int = SHINGLE):
    """(row, sorted distinct 64-bit shingle hashes) of every text of an Arrow column."""
    for i, buf, offsets in chunks(column):
        buf = lower_ascii(buf)
        starts, ends, at = word_spans(buf, offsets)
        h = span_hashes(byte_values()[buf], starts, ends)
        grams = gram_hashes(h, words)
        for j in range(len(at) - 1):
            a, b = at[j], at[j + 1]
            if b - a >= words:
                yield i + j, np.unique(grams[a : b - words + 1])
            elif b > a:  # the whole sequence as one; its length keeps it apart from longer shingles
                yield i + j, span_hashes(h[a:b], np.zeros(1, np.int64), np.full(1, b - a))
            else:
                yield i + j, np.zeros(0, np.uint64)


def _permute(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k: the smallest second permutation, shifted by k, of the shingles scattered by the first."""
    first = _permute((shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32) ^ np.uint32(0x3C6EF372))
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(1, size + 1, dtype=np.uint32)[:, None]
    for k in range(0, len(first), 512):
        best = np.minimum(best, _permute(first[None, k : k + 512] - shift).min(1))
    return best


def profiles(keyed: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """did, tid, n_shingles, digest of the set, bands (a hash of each band's coordinates; none for an empty set)."""

    def make(batches):
        for batch in batches:
            digests, bands, n = [], [], []
            for _, s in shingle_sets(batch.column(2)):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    x = splitmix(signature(s, n_bands * ROWS).astype(np.uint64).reshape(n_bands, ROWS) + np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    bands.append(splitmix((x * np.array([3, 5, 7, 9], np.uint64)).sum(1)).view(np.int64))
                else:
                    bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["did", "tid", "n_shingles", "digest", "bands"])

    return arrow_map(keyed.select("did", "tid", "text"), make, "did long, tid long, n_shingles long, digest binary, bands array<long>")


def tile_links(sets: list[np.ndarray], ids: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    both = np.concatenate(sets)
    of = np.repeat(np.arange(n), size)
    _, name, often = np.unique(both, return_inverse=True, return_counts=True)
    shared = often[name] > 1
    of, name = of[shared], name[shared]
    if not len(name):
        return []
    name = np.unique(name, return_inverse=True)[1]
    common = np.zeros((n, n), np.float32)
    width = 4096
    order = np.argsort(name, kind="stable")
    of, name = of[order], name[order]
    for lo in range(0, int(name[-1]) + 1, width):
        a, b = np.searchsorted(name, [lo, lo + width])
        cells = np.zeros((n, width), np.float32)
        cells[of[a:b], name[a:b] - lo] = 1
        common += cells @ cells.T
    common = common.astype(np.int64)
    link = np.triu(100 * common >= percent * (size[:, None] + size[None] - common), 1)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(link)), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ids[i]), int(ids[j])))
    return out


def members(classes: DataFrame) -> DataFrame:
    """rep, tid, band, key, m, chunks and chunk: each class in the buckets of more than one, equal buckets once."""
    banded = classes.select("rep", "tid", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("rep").alias("low"), F.sum(F.xxhash64("rep", "tid").cast("decimal(38,0)")).alias("who")).where("m > 1")
    buckets = buckets.groupBy("m", "low", "who").agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key", "m")
    # merge: a large bucket's rows may be split, and the plan is the same at every size
    out = banded.join(buckets.hint("merge"), ["band", "key"]).withColumn("chunks", F.ceil(F.col("m") / TILE).cast("int"))
    return out.withColumn("chunk", F.pmod(F.xxhash64("rep", "tid", F.lit("chunk")), F.col("chunks")).cast("int"))


def first_tiles(own: DataFrame) -> DataFrame:
    """rep, tid, band, key, a, b (the tiles) and large of every class: a tile for each chunk; the pivots of a bucket of
    several chunks (large), about PIVOTS of them, are in all of its tiles."""
    pivot = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("rep", "tid", F.lit("pivot")), F.col("m")) < PIVOTS)
    chunks = F.when(pivot, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    return own.select("rep", "tid", "band", "key", chunks.alias("a"), F.array(F.lit(-1)).alias("b"), (F.col("chunks") > 1).alias("large"))


def rest_tiles(own: DataFrame, found: DataFrame) -> DataFrame:
    """The same for what the first tiles leave open: pairs of one bucket that lie in several chunks and several
    components. All members outside a bucket's largest component meet all members of the bucket."""
    large = own.where("chunks > 1").join(found.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    sizes = large.groupBy("band", "key", "label").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy("band", "key").agg(F.max_by("label", F.struct("k", "label")).alias("most"), (F.sum("k") - F.max("k")).alias("open")).where("open > 0")
    large = large.join(sizes.repartition(F.xxhash64("band", "key")).hint("merge"), ["band", "key"]).withColumn("parts", F.ceil(F.col("open") / TILE).cast("int"))
    every = large.select("rep", "tid", "band", "key", F.array("chunk").alias("a"), F.sequence(F.lit(0), F.col("parts") - 1).alias("b"), F.lit(True).alias("large"))
    part = F.pmod(F.xxhash64("rep", "tid", F.lit("part")), F.col("parts")).cast("int")
    return every.unionAll(large.where("label <> most").select("rep", "tid", "band", "key", F.sequence(F.lit(0), F.col("chunks") - 1).alias("a"), F.array(part).alias("b"), F.lit(True).alias("large")))


def placed(texts: DataFrame, tiles: DataFrame) -> DataFrame:
    """rep, tid, text, places and large of every class in a tile; texts has rep, tid and text."""
    tiles = tiles.groupBy("rep", "tid").agg(F.collect_list(F.struct("band", "key", "a", "b")).alias("places"), F.max("large").alias("large"))
    return texts.join(tiles.hint("merge"), ["rep", "tid"]).select("rep", "tid", "text", "places", "large")


def tiled_links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that connect what the pairs within the tiles of placed() connect, checked on full sets."""

    def to_tiles(batches):
        for batch in batches:
            rep, tid, places = batch.column(0), batch.column(1), batch.column(3)
            rows, held = [], 0

            def out():
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TILE_TYPES, strict=True)], TILE_NAMES)

            for i, s in shingle_sets(batch.column(2)):
                packed = s.astype("<u8").tobytes()
                for p in places[i].as_py() if packed else ():
                    for x, y in ((x, y) for x in p["a"] for y in p["b"]):
                        rows.append((p["band"], p["key"], x, y, rep[i].as_py(), tid[i].as_py(), packed))
                        held += len(packed)
                        if held > 4_000_000:
                            yield out()
                            rows, held = [], 0
            if rows:
                yield out()

    def compare(batches):
        held: dict[tuple, bytes] = {}
        now = None

        def solve():
            ids = np.array([r for r, _ in held], np.int64)
            return tile_links([np.frombuffer(x, "<u8") for x in held.values()], ids, percent) if len(held) > 1 else []

        for batch in batches:
            out = []
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for key, r, t, packed in zip(keys, *(batch.column(i).to_pylist() for i in (4, 5, 6)), strict=True):
                if key != now:
                    out += solve()
                    held.clear()
                    now = key
                held[r, t] = packed
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        out = solve()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    dealt = arrow_map(sets.select("rep", "tid", "text", "places"), to_tiles, "band int, key long, x int, y int, rep long, tid long, items binary")
    dealt = dealt.repartition("band", "key", "x", "y").sortWithinPartitions("band", "key", "x", "y")
    return arrow_map(dealt, compare, "a long, b long")


TILE_NAMES = ["band", "key", "x", "y", "rep", "tid", "items"]
TILE_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def near_duplicates(docs: DataFrame, percent: int = 85, n_bands: int = BANDS) -> DataFrame:
    """did, tid, doc_id, n_shingles, component_id (smallest doc_id reachable) and kept for every document."""
    keyed = keyed_documents(docs)
    made = written(profiles(keyed, n_bands), "profiles")
    classes = made.where("digest is not null and did > -9223372036854775808").groupBy("digest").agg(F.min("did").alias("rep"), F.first("bands").alias("bands"), F.min_by("tid", "did").alias("tid"))
    classes = written(classes, "classes")
    own = written(members(classes), "members")
    sets = written(placed(keyed.select(F.col("did").alias("rep"), "tid", "text"), first_tiles(own)), "sets")
    near = written(tiled_links(sets, percent), "near")
    # rows that share a doc_id are one document: their classes meet
    same = made.where("digest is not null").join(classes.select("digest", "rep"), "digest").where("did > -9223372036854775808 and did <> rep").select(F.col("did").alias("a"), F.col("rep").alias("b"))
    twice = made.groupBy("did").agg(F.count_distinct("digest").alias("k")).where("k > 1").select("did")
    same = same.join(twice, F.col("a") == F.col("did"), "left_semi")
    links = near.unionAll(same)
    found = components(links)
    if own.where("chunks > 1").take(1):
        rest = rest_tiles(own, found)
        if rest.take(1):
            found = components(links.unionAll(tiled_links(placed(sets.where("large").select("rep", "tid", "text"), rest), percent)))
    drop_written(own, sets, near)
    named = classes.select("digest", "rep").join(found, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = made.join(named, "digest", "left")
    null = F.col("did") == F.lit(-(2**63))
    own = F.when(null, None).otherwise(F.col("did"))
    return out.select("did", "tid", own.alias("doc_id"), "n_shingles", F.when(null, None).otherwise(F.coalesce("component", "did")).alias("component_id"), (null | (F.coalesce("component", "did") == F.col("did"))).alias("kept"))


def op8(spark, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import documents

    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")
