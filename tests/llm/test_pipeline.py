"""The pipeline and the language model against plain versions, and every stage on odd rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import language_id, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TOKEN = re.compile(r"[^\W_]+")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def without_lines(docs):
    """Texts without the lines of three-line windows seen before."""
    seen, out = set(), {}
    for i in sorted(docs):
        lines = docs[i].split("\n")
        full = [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for p in range(len(full) - 2):
            window = tuple(x for _, x in full[p : p + 3])
            if window in seen:
                gone |= {k for k, _ in full[p : p + 3]}
            seen.add(window)
        if len(gone) < len(full) or not full:
            out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def one_of_each(docs):
    own = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(own)
    for i in order:
        for j in order:
            if j < i and own[i] and own[j] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: docs[i] for i in order if root(i) == i}


def clean_of(docs, items):
    """Texts in which no window of 20 tokens (or a whole shorter item) agrees with an item's in four fifths."""
    names: dict = {}
    number = lambda t: np.array([names.setdefault(w, len(names)) for w in TOKEN.findall(t.lower())], np.int32)
    tests = [g for g in map(number, items) if len(g) >= 5]
    out = {}
    for i, t in docs.items():
        own = number(t)
        if not any(_holds(own, g) for g in tests):
            out[i] = t
    return out


def _holds(own, g):
    width = min(20, len(g))
    if len(own) < width:
        return False
    for d in range(-len(g) + width, len(own) - width + 1):  # every alignment
        a, b = max(0, d), min(len(own), d + len(g))
        equal = np.r_[0, np.cumsum(own[a:b] == g[a - d : b - d])]
        if (equal[width:] - equal[:-width]).max(initial=0) * 10 >= 8 * width:
            return True
    return False


def test_pipeline_against_a_plain_version(spark, sf):
    """Every stage's rows after the first, whose decisions are taken from it; whole documents."""
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 4000").select(*corpus_pipeline.COLUMNS)
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = corpus_pipeline.identified(spark, table, sf)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    given = {r["doc_id"]: r["text"] for r in table.collect()}
    assert len(texts) > 0.8 * len(given) and all(given[i] == t for i, t in texts.items())
    sizes = [len(texts)]
    for (_, stage), plain in zip(corpus_pipeline.STAGES[1:4], (without_lines, one_of_each, lambda d: clean_of(d, items)), strict=True):
        docs = stage(spark, docs, sf)
        texts = plain(texts)
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
        sizes.append(len(texts))
    assert sizes[0] > sizes[2] > sizes[3] > 0  # the near copies and the benchmark passages are there
    whole = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for i, t in texts.items():
        ids = whole.encode(t, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))
    rows = corpus_pipeline.packed(spark, docs, sf).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    rooms: list = []  # best fit decreasing, one piece at a time
    for n in sorted((n for _, n, _ in want.values()), reverse=True):
        fit = [k for k, room in enumerate(rooms) if room >= n]
        k = min(fit, key=lambda k: rooms[k]) if fit else len(rooms)
        rooms[k:k + 1] = [(rooms[k] if fit else 4096) - n]
    assert len(bins) == len(rooms)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, sf, name):
    """Nulls in any column, empty and very long texts, repeated rows, extra and clashing columns, an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    prose = "the quick brown fox jumps over the lazy dog and runs away from the old grey house by the river"
    rows = [(i, f"{prose} number {i} of many words in plain English", "en", "a", 90) for i in range(40)]
    rows += [(40, None, "en", "a", None), (41, "", None, None, 0), (42, "   ", "en", "a", 3), (None, prose, None, None, None), (43, "x" * 200_000, None, "b", 1), (44, "word " * 50_000, "en", "b", 1)]
    rows += [(45, prose + " once more", "en", "a", 5)] * 3 + [(46, prose + " for a last time", None, None, None), (46, "another text altogether of the same number", "en", None, 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    wide = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("did", "tid", "kept", "found", "n", "h", "accepted", "lang_pred", "score", "component_id", "starts"))])
    out, extra = stage(spark, docs, sf), stage(spark, wide.select(*wide.columns), sf)
    key = [c for c in out.columns if c not in ("sequence_id", "offset")]
    plain = lambda df: sorted(map(repr, df.select(*key).collect()))
    assert out.columns == extra.columns and plain(out) == plain(extra)
    if name != "packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
        given = {(r[0], r[1]) for r in rows}
        assert all((r["doc_id"], r["text"]) in given for r in out.collect()) or name == "line_dedup"
    else:
        assert out.where("piece = 0").count() == len(rows)
    assert stage(spark, docs.where("false"), sf).count() == 0
    assert stage(spark, docs.where("text is null"), sf).count() == (1 if name == "packing" else stage(spark, docs.where("doc_id = 40"), sf).count())


def plain_model(texts):
    """Interpolated Kneser-Ney over four characters, by dictionaries: the log probability of a text's characters."""
    symbols = lambda t: "   " + re.sub("[^a-z]+", " ", f" {t.lower()} ")
    counts = {lang: Counter(s[i - 3 : i + 1] for t in own for s in [symbols(t)] for i in range(4, len(s))) for lang, own in texts.items()}
    orders = {}
    for lang, four in counts.items():
        each = {4: four}
        for n in (3, 2, 1):
            each[n] = Counter(k[1:] for k in each[n + 1])
        orders[lang] = each
    alphabet = len({k for each in orders.values() for k in each[1]}) + 1

    def discount(own):
        n1, n2 = (sum(v == x for v in own.values()) for x in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    found = {lang: {n: discount(own) for n, own in each.items()} for lang, each in orders.items()}
    totals = {lang: {n: defaultdict(lambda: [0, 0]) for n in each} for lang, each in orders.items()}
    for lang, each in orders.items():
        for n, own in each.items():
            for k, c in own.items():
                totals[lang][n][k[:-1]][0] += c
                totals[lang][n][k[:-1]][1] += 1

    def p(lang, k):
        if not k:
            return 1 / alphabet
        total, kinds = totals[lang][len(k)].get(k[:-1], (0, 0))
        lower = p(lang, k[1:])
        if not total:
            return lower
        d = found[lang][len(k)]
        return max(orders[lang][len(k)].get(k, 0) - d, 0) / total + d * kinds / total * lower

    def entropy(lang, t):
        s = symbols(t)
        grams = [s[i - 3 : i + 1] for i in range(4, len(s))]
        return -sum(math.log(p(lang, k)) for k in grams) / len(grams)

    return entropy


def test_language_model_against_a_plain_version(spark):
    own = np.random.default_rng(8)
    words = {lang: ["".join(own.choice(list(letters), int(own.integers(2, 7)))) for _ in range(60)] for lang, letters in (("aa", "abcdef"), ("bb", "defghi"), ("cc", "abcghi"))}
    texts = {lang: [" ".join(own.choice(w, 30)) for _ in range(20)] for lang, w in words.items()}
    rows = [(t, lang) for lang, every in texts.items() for t in every]
    counts = language_id.count_keys(spark.createDataFrame(rows, "text string, lang string"))
    model = language_id.fit(language_id.written(counts, "counts"))
    entropy = plain_model(texts)
    tried = [texts["aa"][0], texts["cc"][3] + "!", "abc zzz, qi", "defi ghab"]
    got, n, _ = model.entropy(tried)
    want = np.array([[entropy(lang, t) for lang in model.languages] for t in tried])
    assert model.languages == ["aa", "bb", "cc"]
    seen = [0, 1, 3]  # no character unknown to all languages
    assert np.allclose(got[seen], want[seen], atol=2e-3), (got, want)
    assert (got.argmin(1) == want.argmin(1)).all()
