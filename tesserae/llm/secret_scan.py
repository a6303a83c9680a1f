"""Secret scan: fixed patterns and a battery of randomness tests, in DataFrame functions only.

Fixed patterns give assign (a keyword, then a value of 12 or more characters), access and hex spans, leftmost and not
overlapping per kind. Besides, every run of 20 or more characters of [A-Za-z0-9+/_=-] that mixes letters and digits is a
candidate. Signs are split off; the classes of the other characters give the alphabet (16, 32, 36 or 62 symbols). A
name, a word or a number range has few changes between digits, capitals and small letters, so the runs test is taken
one-sided against the rate NATURAL of such changes: its p-value shrinks with the length. The chi-squared test of a
uniform alphabet and the serial correlation of neighbouring symbols speak against randomness: the smaller of their
p-values divides that of the runs test (at most 1), so it never gets smaller and no test is a gate of its own. These
p-values of all candidates of the corpus go through the Benjamini-Hochberg procedure at `rate` (by a histogram of
-log10 p, so nothing is sorted in one place). What is left, and overlaps no fixed span, is a span of the kind random.

Spans are kind:start:end in code points. Nulls: a null text is empty; a null doc_id is an id of its own. Rows with one
doc_id and one text get equal results. A text is held by one task, and split once for each pattern it holds. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import keyed_documents, written

# The patterns and lengths of the contract, in their order.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16,}+",  # [0-9a-f]+ of 16 or more characters: its matches are maximal runs
}
#: What a text must hold for a pattern to give a span: bounded forms of the same patterns.
QUICK = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{16}",
}
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: Share of neighbouring characters of natural strings that change between digit, capital and small letter.
NATURAL = 0.12
#: Scores end here (-log10 p), and with them the bins of the histogram: 20 a unit.
MOST_SCORE = 400


def places(rows: DataFrame, kind: str, pattern: str) -> DataFrame:
    """did, tid, kind, start, end, match for every match in text: lengths of the matches and of the text between them
    add up along the document."""
    gaps = F.transform(F.split("text", pattern, -1), lambda x: F.char_length(x))
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    zipped = rows.select("did", "tid", gaps.alias("gap"), found.alias("match")).select("did", "tid", F.posexplode(F.arrays_zip("gap", "match")).alias("k", "x"))
    zipped = zipped.where("x.match is not null")
    w = Window.partitionBy("did", "tid").orderBy("k")
    size = F.char_length("x.match")
    end = F.sum(F.col("x.gap") + size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return zipped.select("did", "tid", F.lit(kind).alias("kind"), (end - size).alias("start"), end.alias("end"), F.col("x.match").alias("match"))


def base_spans(texts: DataFrame) -> DataFrame:
    out = None
    for kind in KINDS:
        found = places(texts.where(F.col("text").rlike(QUICK[kind])), kind, PATTERNS[kind])
        good = {"assign": F.char_length(F.regexp_extract("match", PATTERNS["assign"], 2)) >= 12, "access": F.char_length("match") >= 18, "hex": F.char_length("match") >= 16}[kind]
        found = found.where(good)
        out = found if out is None else out.unionAll(found)
    return out


def tail(z: Column) -> Column:
    """An upper bound of the normal tail P(Z > z), as -log10."""
    return F.when(z <= 0, F.lit(0.0)).otherwise(z * z / 2 * math.log10(math.e) + F.log10(F.greatest(F.lit(1.0), z)) + 0.3)


def battery(found: DataFrame) -> DataFrame:
    """Candidates with alphabet, uniform and serial (standard deviations from what a random string has) and score, the
    -log10 p of the runs test against natural strings, less that of the stronger of the two others."""
    rows = found.withColumn("bare", F.regexp_replace("match", "[^A-Za-z0-9]", ""))
    bare = F.col("bare")
    alphabet = F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0).when(bare.rlike("^([a-z2-7]+|[A-Z2-7]+)$"), 32.0).when(bare.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), 36.0).otherwise(62.0)
    rows = rows.withColumn("alphabet", alphabet)
    rows = rows.withColumn("chars", F.split(F.regexp_replace("bare", "(?<=.)(?=.)", "\n"), "\n")).withColumn("n", F.size("chars").cast("double"))
    squares = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda a, c: a + F.pow(F.length("bare") - F.length(F.replace("bare", c, F.lit(""))), 2))
    rows = rows.withColumn("uniform", (squares * F.col("alphabet") / F.col("n") - F.col("n") - (F.col("alphabet") - 1)) / F.sqrt(2 * (F.col("alphabet") - 1)))
    value = F.transform("chars", lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).when(c.between("a", "z"), F.ascii(c) - 87).otherwise(F.ascii(c) - 29).cast("double"))
    rows = rows.withColumn("v", value).withColumn("mean", F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n"))
    shifted = F.aggregate(F.zip_with(F.slice("v", F.lit(1), F.size("v") - 1), F.slice("v", F.lit(2), F.size("v") - 1), lambda x, y: (x - F.col("mean")) * (y - F.col("mean"))), F.lit(0.0), lambda s, x: s + x)
    spread = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    rows = rows.withColumn("serial", F.when(spread > 0, shifted / spread * F.sqrt("n")).otherwise(F.lit(99.0)))
    kind = F.regexp_replace(F.regexp_replace(F.regexp_replace("bare", "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    repeats = F.length(kind) - F.length(F.regexp_replace(kind, r"(.)(?=\1)", ""))
    changes = F.col("n") - 1 - repeats
    z = (changes - NATURAL * (F.col("n") - 1)) / F.sqrt(NATURAL * (1 - NATURAL) * (F.col("n") - 1))
    # the smallest p-value of three tails (one, and two of serial), for their number
    against = F.greatest(F.lit(0.0), F.greatest(tail(F.col("uniform")), tail(F.abs("serial"))) - math.log10(3))
    return rows.withColumn("score", F.least(F.lit(float(MOST_SCORE)), F.greatest(F.lit(0.0), tail(z) - against))).select("did", "tid", "start", "end", "alphabet", "uniform", "serial", "score")


def discoveries(tested: DataFrame, rate: float) -> DataFrame:
    """The candidates that Benjamini and Hochberg's procedure keeps at the false-discovery rate `rate`."""
    width = 0.05
    bins = tested.groupBy(F.floor(F.col("score") / width).alias("bin")).agg(F.count("*").alias("n"))
    ranked = bins.select("bin", F.sum("n").over(Window.orderBy(F.desc("bin"))).alias("k"), F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("m"))
    # a bin's largest p is 10 ** -(bin * width)
    least = ranked.where(F.pow(F.lit(10.0), -F.col("bin") * width) <= rate * F.col("k") / F.col("m")).agg(F.min("bin")).first()[0]
    return tested.where(F.lit(False)) if least is None else tested.where(F.col("score") >= float(least) * width)


def random_spans(texts: DataFrame, base: DataFrame, rate: float) -> DataFrame:
    found = places(texts.where(F.col("text").rlike(CANDIDATE)), "random", CANDIDATE).where(F.col("match").rlike("[0-9]") & F.col("match").rlike("[A-Za-z]"))
    tested = written(battery(found), "candidates")
    kept = discoveries(tested, rate)
    overlap = (kept.did == base.did) & (kept.tid == base.tid) & (kept.start < base.end) & (base.start < kept.end)
    return kept.join(base, overlap, "left_anti").select("did", "tid", F.lit("random").alias("kind"), "start", "end")


def secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base and found: spans as kind:start:end, by start, then kind."""
    keyed = keyed_documents(docs)
    some = F.col("text").rlike(CANDIDATE)
    for kind in KINDS:
        some = some | F.col("text").rlike(QUICK[kind])
    texts = written(keyed.where(some).select("did", "tid", "text").dropDuplicates(["did", "tid"]), "texts")
    base = written(base_spans(texts).select("did", "tid", "kind", "start", "end"), "base")
    every = base.unionAll(random_spans(texts, base, rate))
    turn = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate((*KINDS, "random"))])
    span = F.struct("start", turn.alias("turn"), F.concat_ws(":", "kind", "start", "end").alias("s"), (F.col("kind") != "random").alias("fixed"))
    own = every.groupBy("did", "tid").agg(F.array_sort(F.collect_list(span)).alias("all"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in (*KINDS, "random")])
    join = lambda spans: F.array_join(F.transform(spans, lambda x: x["s"]), ",")
    own = own.select("did", "tid", *[f"n_{k}" for k in (*KINDS, "random")], join(F.filter("all", lambda x: x["fixed"])).alias("base"), join(F.col("all")).alias("found"))
    out = keyed.select("did", "tid", "doc_id").join(own, ["did", "tid"], "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in (*KINDS, "random")], F.coalesce("base", F.lit("")).alias("base"), F.coalesce("found", F.lit("")).alias("found"))


def op9(spark, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import documents

    out = secrets(documents(spark, sf_dir))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), F.col("found").alias("spans"), "n_random")
