"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with one space for every run of other characters. Four consecutive symbols (16 bits
each) form one 64-bit key. Each language's keys are counted over all training documents, in the scan tasks and then
in one aggregate, and all of them enter the model. Discounts, continuation counts and back-off weights follow Kneser
and Ney in the interpolated form, with discount n1 / (n1 + 2 n2) per order; the counts of all orders and the discounts
come from Spark, over all keys. The log probabilities of all languages lie in sorted key arrays, one per order; a text
takes the longest order it finds.

The model grows with the input: keys of 4 and 3 symbols are dealt over as many shards as hold SHARD_CELLS values (keys
times languages) each, by their two middle symbols (a 4-gram, its context, the 3-gram it backs off to and that one's
context meet in one shard). The driver builds one shard at a time and broadcasts it; a task that judges texts reads
the shards one after another for every GROUP characters. Keys of 2 symbols and 1 are in every task, as are all keys
if one shard holds them.

The language with the lowest cross-entropy per symbol wins. A bounded calibration sample (CALIBRATION labelled
training rows, chosen by a hash of doc_id; only they are left out of the counts) gives the temperature of the score and, for each
language, the spread of the cross-entropy against the length; texts far above it (`accepted` false) are rejected.

Nulls: a null text, or one without a letter, is `und` with score 0 and not accepted. A null doc_id counts as the
empty string for the folds (held out). Rows with a null lang train nothing. Without any training row all texts are
`und`. Repeated rows count each. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, drop_written, process_cache, written

ORDER = 4
#: Distinct 4-grams times languages that one shard of the model holds, about.
SHARD_CELLS = 8_000_000
#: Keys that a counting task holds before it passes them on.
HELD_KEYS = 2_000_000
#: Characters of texts that meet all shards together, if there are several.
GROUP = 4_000_000
CALIBRATION = 4_000
#: Characters looked up at once.
BLOCK = 400_000
SPACE = 32


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For every code point below 2 ** 16: whether it is a letter, and its lower case. Above: by the letter test
    of each distinct code point found."""
    letters = np.fromiter((chr(i).isalpha() for i in range(65536)), bool, 65536)
    lower = np.fromiter((ord(chr(i).lower()[0]) & 0xFFFF for i in range(65536)), np.uint32, 65536)
    return letters, lower


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, each with a space before and after it, and their offsets."""
    letters, lower = process_cache("letters", _tables)
    points = np.frombuffer("".join(f"\n{t}\n" if t else "\n\n" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) + 2 if t else 2 for t in texts], np.int64)
    offsets = np.r_[0, np.cumsum(size)]
    high = points > 0xFFFF
    small = np.where(high, 0, points)
    ok = letters[small]
    out = np.where(ok, lower[small], SPACE).astype(np.uint64)
    if high.any():
        rare, inverse = np.unique(points[high], return_inverse=True)
        alpha = np.array([chr(x).isalpha() for x in rare.tolist()])[inverse]
        ok[high] = alpha
        out[high] = np.where(alpha, points[high] & 0xFFFF | 0x8000, SPACE)
    keep = ok.copy()
    keep[0] = True
    keep[1:] |= ok[:-1]  # the first of a run of others
    keep[offsets[:-1]] = True
    return out[keep], np.r_[0, np.cumsum(keep)][offsets]


def keys(s: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the last ORDER symbols at every symbol but a document's leading space (padded with spaces), and the
    documents' offsets among them."""
    place = np.ones(len(s), bool)
    place[offsets[:-1]] = False
    k = s.copy()
    first = np.repeat(offsets[:-1], np.diff(offsets))
    at = np.arange(len(s))
    for j in range(1, ORDER):
        back = at - j
        k |= np.where(back >= first, s[np.maximum(back, 0)], np.uint64(SPACE)) << np.uint64(16 * j)
    return k[place], np.r_[0, np.cumsum(place)][offsets]


def blocks(texts: list):
    """(first row, texts) of at most BLOCK characters, or one row; a longer text is cut, and its parts share the row."""
    i, held, n = 0, [], 0
    for j, t in enumerate(texts):
        t = t or ""
        if held and n + len(t) > BLOCK:
            yield i, held
            held, n = [], 0
        if not held:
            i = j
        while len(t) > BLOCK:
            yield j, [t[:BLOCK]]
            t = t[BLOCK:]
            i = j
        held.append(t)
        n += len(t)
    if held:
        yield i, held


def shard_of(k, n: int):
    """The shard of a key of 3 symbols or 4, of n, by the two symbols before its last (numpy or Column)."""
    middle = k.bitwiseAND(F.lit((1 << 48) - 1)) if isinstance(k, Column) else k & np.uint64((1 << 48) - 1)
    if isinstance(k, Column):
        return (F.shiftright(middle, 16) % 1_000_003 * 7919 % 1_000_003 % n).cast("int")
    return ((middle >> np.uint64(16)) % np.uint64(1_000_003) * np.uint64(7919) % np.uint64(1_000_003) % np.uint64(n)).astype(np.int64)


#: Tables of two orders: the longer first, sorted keys and log probabilities [key, language] in base e; and sorted
#: contexts and log back-off weights [context, language] of both.
Tables = tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]


@dataclass
class Model:
    languages: list[str]
    #: Keys of 2 symbols and of 1.
    low: Tables
    #: Broadcast tables of the keys of 4 symbols and 3 (type Tables), in order.
    shards: list
    unseen: float
    temperature: float = 1.0
    #: For each language: mean cross-entropy, variance of a long text's, and of one symbol's.
    spread: np.ndarray | None = None
    limit: float = 6.0

    def shard(self, i: int) -> Tables:
        shared = self.shards[i]
        if len(self.shards) == 1 or shared._path is None:
            return shared.value
        return shared.load_from_path(shared._path)  # not kept

    def entropy(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy of every text under every language, its symbols and its letters."""
        total = np.zeros((len(texts), len(self.languages)))
        n, inked = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        held, size = [], 0

        def solve():
            for shard in range(len(self.shards)) if held else ():
                tables = self.shard(shard)
                for rows, k, each, at in held:
                    own = np.ones(len(k), bool) if len(self.shards) == 1 else shard_of(k, len(self.shards)) == shard
                    score = np.zeros((len(k), len(self.languages)))
                    score[own] = self.log_p(k[own], tables)
                    some = at[1:] > at[:-1]
                    if some.any():
                        np.add.at(total, rows[some], np.add.reduceat(score[each], at[:-1][some], 0))
            held.clear()

        for i, part in blocks(texts):
            s, at = symbols(part)
            k, at_k = keys(s, at)
            rows = np.arange(i, i + len(part))
            ink = np.r_[0, np.cumsum(s != SPACE)]
            np.add.at(inked, rows, ink[at[1:]] - ink[at[:-1]])
            np.add.at(n, rows, np.diff(at_k))
            distinct, each = np.unique(k, return_inverse=True)  # few, and looked up in order
            held.append((rows, distinct, each.astype(np.int32), at_k))
            size += len(k)
            if len(self.shards) == 1 or size > GROUP:
                solve()
                size = 0
        solve()
        return -total / np.maximum(n, 1)[:, None], n, inked

    def log_p(self, k: np.ndarray, tables: Tables) -> np.ndarray:
        out = np.zeros((len(k), len(self.languages)), np.float32)
        left = np.arange(len(k))
        grams, back = tables[0] + self.low[0], tables[1] + self.low[1]
        for j in range(ORDER):  # the longest order first
            own, table = grams[j]
            q = k[left] & np.uint64((1 << 16 * (ORDER - j)) - 1)
            i = np.minimum(np.searchsorted(own, q), max(len(own) - 1, 0))
            hit = own[i] == q if len(own) else np.zeros(len(q), bool)
            out[left[hit]] += table[i[hit]]
            left, q = left[~hit], q[~hit]
            if not len(left):
                return out
            if j < ORDER - 1:
                contexts, weights = back[j]
                c = q >> np.uint64(16)
                i = np.minimum(np.searchsorted(contexts, c), max(len(contexts) - 1, 0))
                known = contexts[i] == c if len(contexts) else np.zeros(len(c), bool)
                out[left[known]] += weights[i[known]]
            else:
                out[left] += np.float32(self.unseen)
        return out

    def judge(self, texts: list) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether it is accepted, of every text."""
        h, n, inked = self.entropy(texts)
        best = h.argmin(1)
        at = np.arange(len(h))
        gap = np.minimum((h - h[at, best][:, None]) * np.minimum(n, 200)[:, None] * self.temperature, 700)
        score = 1 / np.exp(-gap).sum(1)
        low = h[at, best]
        accepted = inked > 0
        if self.spread is not None:
            mean, far, one = self.spread[best].T
            accepted &= (low - mean) / np.sqrt(far + one / np.maximum(n, 1)) <= self.limit
        return [self.languages[b] if i else "und" for b, i in zip(best.tolist(), inked.tolist(), strict=True)], np.where(inked > 0, score, 0.0), np.where(inked > 0, low, np.nan), accepted


def count_keys(train: DataFrame) -> DataFrame:
    """lang, k, n: how often each key occurs in the texts of each language."""

    def count(batches):
        held: dict[str, list] = {}

        def out():
            for lang, (k, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k)), pa.array(k.view(np.int64)), pa.array(n)], ["lang", "k", "n"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for _, part in blocks([t for t, x in zip(texts, langs, strict=True) if x == lang]):
                    k, n = np.unique(keys(*symbols(part))[0], return_counts=True)
                    if lang in held:
                        a, b = held[lang]
                        k, i = np.unique(np.r_[a, k], return_inverse=True)
                        n = np.bincount(i, np.r_[b, n]).astype(np.int64)
                    held[lang] = (k, n)
            if sum(len(k) for k, _ in held.values()) > HELD_KEYS:
                yield from out()
        yield from out()

    return arrow_map(train.select("lang", "text"), count, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame, languages: list[str]) -> np.ndarray:
    """Kneser and Ney's discount of each language: n1 / (n1 + 2 n2), over all keys of one order."""
    got = {r["lang"]: r for r in counts.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
    return np.array([r["n1"] / (r["n1"] + 2 * r["n2"]) if r["n1"] and r["n2"] else 0.5 for r in (got[x] for x in languages)])


def shorter(counts: DataFrame, order: int) -> DataFrame:
    """Continuation counts of the keys of `order` symbols: how many keys of one symbol more end in each."""
    return counts.groupBy("lang", F.col("k").bitwiseAND(F.lit((1 << 16 * order) - 1)).alias("k")).agg(F.count("*").alias("n"))


def fetched(counts: DataFrame, languages: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted keys, and counts, of each language."""
    number = F.coalesce(*[F.when(F.col("lang") == x, F.lit(i)) for i, x in enumerate(languages)])
    got = counts.select(number.alias("i"), "k", "n").toArrow()
    lang, k, n = got["i"].to_numpy(), got["k"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.lexsort((k, lang))
    lang, k, n = lang[order], k[order], n[order]
    at = np.searchsorted(lang, np.arange(len(languages) + 1))
    return [(k[a:b], n[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def interpolate(counts: list, discount: np.ndarray, order: int, lower: tuple[np.ndarray, np.ndarray] | float):
    """Keys of `order` symbols with their probabilities, and contexts with their back-off weights, given those of the
    order below."""
    union = np.unique(np.concatenate([k for k, _ in counts]))
    if isinstance(lower, float):
        below = np.full((len(union), len(counts)), lower)
    else:
        below = lower[1][np.searchsorted(lower[0], union & np.uint64((1 << 16 * (order - 1)) - 1))]
    contexts, of = np.unique(union >> np.uint64(16), return_inverse=True)
    p, back = np.empty_like(below), np.ones((len(contexts), len(counts)))
    for i, (k, n) in enumerate(counts):
        c = np.zeros(len(union))
        c[np.searchsorted(union, k)] = n
        total = np.bincount(of, c, len(contexts))
        kinds = np.bincount(of, c > 0, len(contexts))
        weight = np.where(total > 0, discount[i] * kinds / np.maximum(total, 1), 1.0)
        p[:, i] = np.maximum(c - discount[i], 0) / np.maximum(total, 1)[of] + weight[of] * below[:, i]
        back[:, i] = weight
    return union, p, contexts, back


def logs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys, np.log(values).astype(np.float32)


def fit(counts: DataFrame) -> Model | None:
    """A model from the table lang, k, n of all keys of 4 symbols."""
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    n = max(1, -(-counts.select("k").distinct().count() * len(languages) // SHARD_CELLS))
    thirds = written(shorter(counts, 3), "thirds")
    seconds = shorter(thirds, 2)
    seen = fetched(seconds, languages)
    firsts = [np.unique(k & np.uint64(0xFFFF), return_counts=True) for k, _ in seen]
    alphabet = len(np.unique(np.concatenate([k for k, _ in firsts]))) + 1

    def discount(own):
        n1, n2 = np.array([[(n == 1).sum(), (n == 2).sum()] for _, n in own], float).T
        return np.where((n1 > 0) & (n2 > 0), n1 / np.maximum(n1 + 2 * n2, 1), 0.5)

    k1, p1, c1, b1 = interpolate(firsts, discount(firsts), 1, 1 / alphabet)
    k2, p2, c2, b2 = interpolate(seen, discount(seen), 2, (k1, p1))
    d3, d4 = discounts(thirds, languages), discounts(counts, languages)
    shards = []
    for i in range(n):
        own = lambda t: fetched(t.where(shard_of(F.col("k"), n) == i) if n > 1 else t, languages)  # noqa: B023, E731
        k3, p3, c3, b3 = interpolate(own(thirds), d3, 3, (k2, p2))
        k4, p4, c4, b4 = interpolate(own(counts), d4, 4, (k3, p3))
        shards.append(counts.sparkSession.sparkContext.broadcast(([logs(k4, p4), logs(k3, p3)], [logs(c4, b4), logs(c3, b3)])))
    drop_written(thirds)
    unseen = float(np.log(1 / alphabet)) + float(np.log(b1[0]).astype(np.float32).mean())
    return Model(languages, ([logs(k2, p2), logs(k1, p1)], [logs(c2, b2)]), shards, unseen)


def sharing(model: Model, spark):
    """A broadcast of the model's plain fields (executors need no copy of this package) without its shards, and
    these: broadcasts go to tasks by themselves."""
    return spark.sparkContext.broadcast({f.name: getattr(model, f.name) for f in fields(model) if f.name != "shards"}), model.shards


def calibrate(model: Model, sample: DataFrame) -> Model:
    """Sets the temperature, the spread and the limit from labelled rows."""

    shared, shards = sharing(model, sample.sparkSession)

    def measure(batches):
        model = Model(**shared.value, shards=shards)
        for batch in batches:
            h, n, inked = model.entropy(batch.column(1).to_pylist())
            ok = inked > 0
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array(list(h[ok]), pa.list_(pa.float64())), pa.array(n[ok])], ["lang", "h", "n"])

    got = arrow_map(sample.select("lang", "text"), measure, "lang string, h array<double>, n long").toPandas()
    if got.empty:
        return model
    h, n = np.stack(got.h.to_numpy()), got.n.to_numpy()
    truth = got.lang.map({x: i for i, x in enumerate(model.languages)}).to_numpy()
    at = np.arange(len(h))
    gap = (h - h.min(1)[:, None]) * np.minimum(n, 200)[:, None]
    loss = {t: float((np.log(np.exp(-np.minimum(gap * t, 700)).sum(1)) + gap[at, truth] * t).mean()) for t in (0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5)}
    model.temperature = min(loss, key=loss.get)
    right = h.argmin(1) == truth
    low = h.min(1)
    spread, z = np.zeros((len(model.languages), 3)), []
    for i in range(len(model.languages)):
        own = right & (truth == i)
        x, m = (low[own], n[own]) if own.sum() >= 8 else (low, n)
        mean = float(np.average(x, weights=np.minimum(m, 2000)))
        square = (x - mean) ** 2
        one = float(np.median(square * m))
        far = float(np.percentile(square[m >= np.median(m)], 90))
        spread[i] = mean, max(far, 1e-6), max(one, 1e-6)
        z.append((x - mean) / np.sqrt(spread[i, 1] + spread[i, 2] / m))
    model.spread = spread
    model.limit = max(4.0, float(np.percentile(np.concatenate(z), 99.9))) * 1.5
    return model


def calibration(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows to count and about CALIBRATION rows, at most a quarter, to calibrate on, by a hash of doc_id. A language
    of which the hash would leave nothing to count gives no calibration row."""
    n = labelled.count()
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(0.25, CALIBRATION / max(n, 1)))
    rare = [r["lang"] for r in labelled.groupBy("lang").agg(F.count_if(~picked).alias("left")).where("left = 0").collect()]
    picked = picked & ~F.col("lang").isin(rare)
    return labelled.where(~picked), labelled.where(picked)


def train(docs: DataFrame) -> Model | None:
    """A model from the labelled rows out of fold 0: all are counted but the calibration rows."""
    counted, sample = calibration(docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(fold(F.col("doc_id")) != 0))
    counts = written(count_keys(counted), "counts")
    model = fit(counts)
    drop_written(counts)
    if model is None:
        return None
    return calibrate(model, sample.where(F.col("lang").isin(model.languages)))


def identify(docs: DataFrame, model: Model | None, *more: str) -> DataFrame:
    """doc_id, text, held_out, lang_pred, score, entropy (per symbol, in nats), accepted, and the columns named."""
    kinds = dict(docs.dtypes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (fold(F.col("doc_id")) == 0).alias("held_out"), *[F.col(c).alias(f"_{c}") for c in more])
    names = ["doc_id", "text", "held_out", "lang_pred", "score", "entropy", "accepted", *more]
    shared, shards = (None, None) if model is None else sharing(model, docs.sparkSession)

    def judge(batches):
        model = shared and Model(**shared.value, shards=shards)
        for b in batches:
            texts = b.column(1).to_pylist()
            if model is None:
                lang, score, h, ok = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.zeros(len(texts), bool)
            else:
                lang, score, h, ok = model.judge(texts)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(lang, pa.string()), pa.array(score), pa.array(h), pa.array(ok), *b.columns[3:]], names)

    return arrow_map(rows, judge, "doc_id long, text string, held_out boolean, lang_pred string, score double, entropy double, accepted boolean" + "".join(f", `{c}` {kinds[c]}" for c in more))


def op1(spark, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import documents

    docs = documents(spark, sf_dir)
    return identify(docs, train(docs)).drop("text")
