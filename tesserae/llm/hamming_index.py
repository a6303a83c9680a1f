"""Nearest vectors by multi-index hashing of learned binary codes.

Codes: ROTATIONS rotations are learned by iterative quantisation on a bounded sample (SAMPLE rows, chosen by a hash of
vec_id); each gives one bit per principal dimension. Rows are dealt over index blocks of at most BLOCK rows, each
indexed once for all queries of a part; the code is cut into 16-bit substrings and every substring has a directory of
its present values. By the pigeonhole principle a code within Hamming radius r of a query has a substring within
r / substrings of the query's, so probing all directories to that radius finds every one: by the values within reach
where these are few, else by the values present. The radius is set on the sample so that the true neighbours of its
rows are retrieved with the recall MARGIN; a block with under k codes in it widens the radius until it has them. What
is retrieved is ranked by the inner product in double precision on the original vectors.

Queries meet every index block, in parts of at most BLOCK; each gives k rows a block, and the k best of all stay. Up to
BLOCK queries, rows are shuffled once, and queries once for each block.

Nulls: vectors that are null, zero, of another length than most or hold null or non-finite components take no part;
neither does a row with a null vec_id. Repeated rows: a row is no candidate of its own id; others count each. Ties go to
the smaller vec_id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import written

ROTATIONS = 2
SAMPLE = 4_000
MARGIN = 0.97
#: Rows of a block, and queries of a part; and the rows for which a block more is worth its while.
BLOCK, LEAST_BLOCK = 65_536, 2_048


def usable(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), (e if single else e.cast("array<double>")).alias("embedding"))


def learn(sample: np.ndarray, rotations: int = ROTATIONS, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection: iterative quantisation from `rotations` random starts."""
    mean = sample.mean(0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    v = x @ axes
    out = []
    for seed in range(rotations):
        r = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1],) * 2))[0]
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (a @ b).T
        out.append(axes @ r)
    return mean, np.hstack(out)


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as 16-bit substrings [row, substring]."""
    bits = (x - mean) @ projection > 0
    pad = -bits.shape[1] % 16
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint16)


def radius(sample: np.ndarray, codes: np.ndarray, k: int, margin: float) -> int:
    """The Hamming radius within which the share `margin` of the sample's true neighbours lies."""
    own = np.arange(0, len(sample), max(1, len(sample) // 200))
    near = sample[own] @ sample.T
    near[np.arange(len(own)), own] = -np.inf
    top = np.argsort(-near, 1)[:, : max(1, min(k, len(sample) - 1) // 2)]
    far = np.bitwise_count(codes[own][:, None] ^ codes[top]).sum(2)
    return int(np.quantile(far, margin)) + 1


class Index:
    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray):
        self.ids, self.x, self.codes = ids, x, codes
        self.directories = []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, first = np.unique(codes[order, j], return_index=True)
            self.directories.append((values, np.r_[first, len(order)], order))
        self.masks = np.argsort(np.bitwise_count(np.arange(65536, dtype=np.uint16)), kind="stable").astype(np.uint16)

    def probe(self, values: np.ndarray, own: np.uint16, reach: int) -> np.ndarray:
        """Which of a directory's values differ from `own` in at most `reach` bits."""
        n = sum(math.comb(16, i) for i in range(min(reach, 16) + 1))
        if 8 * n > len(values):
            return np.flatnonzero(np.bitwise_count(values ^ own) <= reach)
        near = self.masks[:n] ^ own
        at = np.minimum(np.searchsorted(values, near), len(values) - 1)
        return at[values[at] == near]

    def within(self, code: np.ndarray, r: int) -> np.ndarray:
        """Rows whose code is within r of `code`."""
        reach = r // codes_in(code)
        seen = np.zeros(len(self.ids), bool)
        for j, (values, first, order) in enumerate(self.directories):
            hit = self.probe(values, code[j], reach)
            if len(hit) == len(values):
                seen[:] = True
                break
            size = first[hit + 1] - first[hit]
            end = np.cumsum(size)
            seen[order[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(first[hit] - (end - size), size)]] = True
        rows = np.flatnonzero(seen)
        far = np.bitwise_count(self.codes[rows] ^ code).sum(1)
        return rows[far <= r]

    def search(self, q_id: int, q: np.ndarray, code: np.ndarray, r: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        most = int((self.ids != q_id).sum())
        while True:
            rows = self.within(code, r)
            rows = rows[self.ids[rows] != q_id]
            if len(rows) >= min(k, most):
                break
            r += max(4, r // 4)
        score = np.einsum("ij,j->i", self.x[rows].astype(np.float64), q.astype(np.float64))
        if len(rows) > k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            pick = score >= least
            rows, score = rows[pick], score[pick]
        order = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[order]], score[order]


def codes_in(code: np.ndarray) -> int:
    return len(code)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of `vectors` found for every row of `queries`."""
    spark = vectors.sparkSession
    out = "query_id long, vec_id long, score double"
    base, asked = written(usable(vectors), "vectors"), usable(queries)
    n = base.count()
    pick = base.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(n, 1)))).toPandas()
    if not len(pick):
        pick = base.limit(SAMPLE).toPandas()
    if not len(pick):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = int(pick.embedding.map(len).mode()[0])
    sample = np.stack([x for x in pick.embedding if len(x) == width]).astype(np.float64)
    mean, projection = learn(sample)
    r = radius(sample, encode(sample, mean, projection), k, MARGIN)
    base, asked = base.where(F.size("embedding") == width), asked.where(F.size("embedding") == width)
    blocks = max(1, -(-n // BLOCK), min(spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    rows = base.withColumns({"block": F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int"), "query": F.lit(False)})
    groups = max(1, -(-asked.count() // BLOCK))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.lit(groups)).cast("int"))
    parts = F.sequence(F.lit(0), F.lit(groups - 1))
    left = rows.select("block", F.explode(parts).alias("part"), "query", "vec_id", "embedding")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "part", F.lit(True).alias("query"), "vec_id", "embedding")

    def search(key, t):
        query = t.column("query").to_numpy(zero_copy_only=False)
        ids = t.column("vec_id").to_numpy()
        x = t.column("embedding").combine_chunks().values.to_numpy().reshape(-1, width)
        code = encode(x.astype(np.float64), mean, projection)
        index = Index(ids[~query], x[~query], code[~query])
        found = [[], [], []]
        if len(index.ids):
            for i in np.flatnonzero(query).tolist():
                near, score = index.search(ids[i], x[i], code[i], r, k)
                found[0].append(np.full(len(near), ids[i]))
                found[1].append(near)
                found[2].append(score)
        cols = [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(found, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    best = left.unionAll(right).groupBy("block", "part").applyInArrow(search, out)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10(spark, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import table

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
