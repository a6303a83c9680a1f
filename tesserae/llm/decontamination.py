"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Tokens are the lower-case runs of letters and digits. A mask reads some token positions and ignores the others; the
hashes under every mask of every place of the test items are joined with those of the documents. Along a hit's
alignment every window of WINDOW tokens (the whole item, if it has fewer) that holds the hit is compared token by
token; where at least `similar` of them agree in one, substitutions included, the document holds the item.

MASKS and MORE_MASKS together miss no window of 10 to 20 tokens at 0.8: for each of these widths, every choice of up to
a fifth of the places as substitutions leaves some mask untouched (tests enumerate them). Items of LEAST to
SPAN - 1 tokens are cut in three blocks and hashed without one of them, each in turn, so one substitution, all that 0.8
lets through, is never missed either. Below `similar` = 0.8 some windows are missed.

A bit map of the items' seeds, of a fixed size, is broadcast; documents are read once for the seeds of all items, and
only a seed that the map knows leaves its scan task, with the stretch of the text that its windows reach. The share of
others that pass is the number of item seeds by MAP_BITS (a benchmark of a million tokens: one in 13).
Items with one token sequence count as one, named by their smallest item_id. Items under LEAST tokens are no evidence.
Nulls: a null text, item or item_id takes no part; a document with a null text is clean. Rows with one doc_id and one
text get equal results. The tokens of a text are held by one task. An empty benchmark leaves all clean. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import keyed_documents

MASKS = ((0, 1, 2, 5, 7, 9), (0, 2, 3, 4, 8, 9), (0, 1, 4, 6, 8, 9))
#: With these the masks leave no gap from SPAN to WINDOW tokens.
MORE_MASKS = ((0, 1, 3, 4, 6), (0, 2, 6, 7, 8))
SPAN = 10
WINDOW = 20
LEAST = 5


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def blocks(n: int) -> list[tuple[int, ...]]:
    """For items of n tokens: the places outside each of three blocks."""
    cut = [0, n // 3, n - n // 3, n]
    return [tuple(k for k in range(n) if not a <= k < b) for a, b in zip(cut[:-1], cut[1:], strict=True)]


#: Tokens before and after a seed's first place that windows with it may reach.
BEFORE, AFTER = WINDOW - 1 - min(m[-1] for m in MASKS + MORE_MASKS), WINDOW
#: Bits of the map of item seeds: at most MAP_BITS / 64 rows are broadcast, whatever the benchmark.
MAP_BITS = 1 << 26


def seeds_at(h: Column, pos: Column, masks: list[tuple[int, tuple[int, ...]]]) -> Column:
    """The seeds of the masks (number, places) laid at pos of h; null where one does not fit."""
    return F.array(*[F.when(pos + m[-1] < F.size(h), F.xxhash64(F.lit(i), *[F.get(h, pos + k) for k in m])) for i, m in masks])


def long_masks() -> list[tuple[int, tuple[int, ...]]]:
    return list(enumerate(MASKS + MORE_MASKS))


def short_masks(n: int) -> list[tuple[int, tuple[int, ...]]]:
    return [(100 * n + i, m) for i, m in enumerate(blocks(n))]


def item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """seed, item_id, width, ahead and g: g is the stretch of the item that windows with the seed reach, and begins
    at `ahead` of the seed."""
    q = F.col("q")
    at = items.where(F.size("h") >= SPAN).select("item_id", "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1 - min(m[-1] for _, m in long_masks()))).alias("q"))
    begin = F.greatest(F.lit(0), q - BEFORE)
    out = at.select(F.explode(seeds_at(F.col("h"), q, long_masks())).alias("seed"), "item_id", F.least(F.lit(WINDOW), F.size("h")).alias("width"), (begin - q).alias("ahead"), F.slice("h", begin + 1, q + AFTER - begin).alias("g"))
    for n in lengths:
        own = items.where(F.size("h") == n)
        out = out.unionAll(own.select(F.explode(seeds_at(F.col("h"), F.lit(0), short_masks(n))).alias("seed"), "item_id", F.lit(n).alias("width"), F.lit(0).alias("ahead"), F.col("h").alias("g")))
    return out.where("seed is not null")


def hits(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """did, tid, item_id, width, d, g and c: g lies on c, a stretch of the text, at d (which may be negative)."""
    lengths = sorted(r["n"] for r in items.where(F.size("h") < SPAN).select(F.size("h").alias("n")).distinct().collect())  # at most SPAN - LEAST
    test = item_seeds(items, lengths)
    place = F.col("seed").bitwiseAND(F.lit(MAP_BITS - 1))
    word, bit = F.shiftright(place, 6).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")
    bits = test.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    masks = long_masks() + [m for n in lengths for m in short_masks(n)]
    last = F.size("h") - 1 - min(m[-1] for _, m in masks)
    pos, since = F.col("pos"), F.greatest(F.lit(0), F.col("pos") - BEFORE)
    at = keyed.where(last >= 0).select("did", "tid", "h", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    at = at.select("did", "tid", "h", "pos", F.explode(seeds_at(F.col("h"), pos, masks)).alias("seed")).where("seed is not null")
    at = at.withColumn("word", word).join(F.broadcast(bits), "word").where(F.getbit("bits", bit) == 1)
    at = at.select("did", "tid", "seed", (pos - since).alias("back"), F.slice("h", since + 1, pos + AFTER - since).alias("c"))
    found = at.join(test, "seed").withColumn("d", F.col("back") + F.col("ahead"))
    # some window lies within the text
    found = found.where(F.least(F.size("c"), F.col("d") + F.size("g")) - F.greatest(F.lit(0), F.col("d")) >= F.col("width"))
    return found.select("did", "tid", "item_id", "width", "d", "g", "c").distinct()


def best_share() -> Column:
    """The largest share of equal tokens in a window of `width` tokens of g, laid on c at d."""
    total = lambda bits: F.aggregate(bits, F.lit(0), lambda a, b: a + b)
    skip = F.greatest(F.lit(0), -F.col("d"))
    size = F.least(F.size("g") - skip, F.size("c") - F.col("d") - skip)
    equal = F.zip_with(F.slice("c", F.col("d") + skip + 1, size), F.slice("g", skip + 1, size), lambda a, b: (a == b).cast("int"))
    windows = F.transform(F.array(equal), lambda e: F.array_max(F.transform(F.sequence(F.lit(1), F.size(e) - F.col("width") + 1), lambda k: total(F.slice(e, k, F.col("width"))))))
    return windows[0] / F.col("width")


def contaminated(docs: DataFrame, benchmark: DataFrame, similar: float = 0.8) -> DataFrame:
    """did, tid, item_id (the smallest found), n_items and best (the largest share of equal tokens) of documents that
    hold a test item."""
    hashed = lambda column: F.transform(tokens(F.col(column)), lambda w: F.xxhash64(w))
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), hashed("text").alias("h")).groupBy("h").agg(F.min("item_id").alias("item_id"))
    items = items.where(F.size("h") >= LEAST)
    keyed = keyed_documents(docs).where("text is not null").select("did", "tid", hashed("text").alias("h"))
    hit = hits(keyed, items).select("did", "tid", "item_id", best_share().alias("share")).where(F.col("share") >= similar)
    return hit.groupBy("did", "tid", "item_id").agg(F.max("share").alias("best")).groupBy("did", "tid").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), F.max("best").alias("best"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similar: float = 0.8) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (null if clean) and best (0 if clean) of every document."""
    found = contaminated(docs, benchmark, similar)
    out = keyed_documents(docs).select("did", "tid", "doc_id").join(found, ["did", "tid"], "left")
    return out.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("best", F.lit(0.0)).alias("best"))


def op3(spark, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import documents, table

    return decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_MASK = ", ".join("concat_ws(' ', '{}', {})".format(i, ", ".join(f"t[p + {k}]" for k in m)) for i, m in enumerate(MASKS))
OP3_SQL = rf"""
WITH items AS (SELECT min(item_id) AS item_id, g FROM (SELECT item_id,
    list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS g FROM benchmark
    WHERE item_id IS NOT NULL AND text IS NOT NULL) GROUP BY g HAVING len(g) >= {LEAST}),
docs AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
doc_seeds AS (SELECT doc_id, t, p, unnest([{_MASK}]) AS seed FROM (SELECT doc_id, t, unnest(range(1, len(t) - {SPAN} + 2)) AS p FROM docs WHERE len(t) >= {SPAN})),
item_seeds AS (SELECT item_id, t AS g, p AS q, unnest([{_MASK}]) AS seed FROM (SELECT item_id, g AS t, unnest(range(1, len(g) - {SPAN} + 2)) AS p FROM items WHERE len(g) >= {SPAN})),
hits AS (SELECT doc_id, item_id, t, g, p, q, least({WINDOW}, len(g)) AS w FROM doc_seeds JOIN item_seeds USING (seed)),
placed AS (SELECT *, greatest(0, least(q - 1 + {SPAN // 2} - w // 2, len(g) - w)) AS s FROM hits),
aligned AS (SELECT *, p - q + s AS d FROM placed WHERE p - q + s >= 0 AND p - q + s + w <= len(t)),
shares AS (SELECT doc_id, item_id, len(list_filter(range(1, w + 1), lambda i: t[d + i] = g[s + i])) / w AS share FROM aligned),
short AS (SELECT doc_id, item_id, 1.0 AS share FROM (SELECT doc_id, t, unnest(range(1, len(t) - {LEAST} + 2)) AS p FROM docs WHERE len(t) >= {LEAST}) d
  JOIN items i ON len(g) < {SPAN} AND t[p:p + len(g) - 1] = g),
found AS (SELECT doc_id, min(item_id) AS item_id, count(DISTINCT item_id) AS n_items, max(share) AS best
  FROM (SELECT * FROM shares WHERE share >= 0.8 UNION ALL SELECT * FROM short) GROUP BY doc_id)
SELECT d.doc_id, f.item_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, f.item_id, coalesce(best, 0)::DOUBLE AS best
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""
