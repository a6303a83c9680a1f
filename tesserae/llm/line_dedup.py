"""Line dedup by overlapping windows of three consecutive lines.

Lines end at "\\n"; a line counts without the white space around it, and blank lines are passed over (they are in no
window and always stay). The 128-bit hash of every three consecutive lines is counted over the corpus; of a window
that occurs more than once, the first place (smallest doc_id, then smallest line) stays and every later one is
covered; the lines that covered windows hold, merged, go.

Nulls: a null text has no lines and stays null; a null doc_id sorts first. Documents of under three lines stay whole.
Rows with one doc_id and one text are one document. A text is held by one task, with about as many bytes again for its
lines. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, keyed_documents

WINDOW = 3
#: White space trimmed from lines.
BLANK = " \t\r\x0b\x0c"


def covered_lines(docs: DataFrame) -> DataFrame:
    """did, tid, starts: for each document that has any, the first lines (among its non-blank ones) of the windows
    that occurred earlier."""
    keyed = keyed_documents(docs)
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")
    held = keyed.select("did", "tid", F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("second"), x).alias("b"))).alias("h"))
    held = held.where(F.size("h") >= WINDOW)
    at = held.select("did", "tid", "h", F.explode(F.sequence(F.lit(0), F.size("h") - WINDOW)).alias("pos"))
    part = lambda name: [F.col("h")[F.col("pos") + k][name] for k in range(WINDOW)]
    windows = at.select("did", "tid", "pos", F.xxhash64(*part("a")).alias("h1"), F.xxhash64(F.lit("window"), *part("b")).alias("h2"))
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("did", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    first = first.repartition(F.xxhash64("h1"))  # so the join deals the windows itself, and may split a very common one's
    later = windows.join(first, ["h1", "h2"]).where("first.did <> did or first.pos <> pos")
    return later.groupBy("did", "tid").agg(F.collect_set("pos").alias("starts"))


def line_dedup(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the lines left, joined by "\\n"; null if all went or the text is null), and
    the columns named, which may be any but these."""
    keyed = keyed_documents(docs, *[F.col(c).alias(f"_{c}") for c in more])
    joined = keyed.join(covered_lines(docs), ["did", "tid"], "left").select("doc_id", "text", "starts", *[f"_{c}" for c in more])

    def cut(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text is None:
                    total.append(0), gone.append(0), kept.append(None)
                    continue
                lines = text.split("\n")
                total.append(len(lines))
                if starts is None:
                    gone.append(0), kept.append(text)
                    continue
                full = [i for i, x in enumerate(lines) if x.strip(BLANK)]
                drop = {full[s + k] for s in starts for k in range(WINDOW)}
                gone.append(len(drop))
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if len(drop) < len(full) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), *[batch.column(3 + k) for k in range(len(more))]], ["doc_id", "n_lines", "n_removed", "kept", *more])

    kinds = dict(docs.dtypes)
    return arrow_map(joined, cut, ", ".join(["doc_id long, n_lines long, n_removed long, kept string", *[f"`{c}` {kinds[c]}" for c in more]]))


def op6(spark, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import documents

    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = """
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, text IS NULL AS none FROM documents),
full_lines AS (
  SELECT doc_id, lines, none, list_filter(list_transform(range(1, len(lines) + 1),
    lambda i: {'i': i, 's': trim(lines[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12))}), lambda x: x.s <> '') AS f FROM docs),
windows AS (
  SELECT doc_id, p, [f[p].s, f[p + 1].s, f[p + 2].s] AS w, [f[p].i, f[p + 1].i, f[p + 2].i] AS spots
  FROM (SELECT doc_id, f, unnest(range(1, len(f) - 1)) AS p FROM full_lines WHERE len(f) >= 3)),
ranked AS (SELECT doc_id, spots, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS r FROM windows),
gone AS (SELECT doc_id, list(DISTINCT i) AS d FROM (SELECT doc_id, unnest(spots) AS i FROM ranked WHERE r > 1) GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN none THEN 0 ELSE len(lines) END AS n_lines, coalesce(len(d), 0) AS n_removed,
  sha256(CASE WHEN len(d) = len(f) THEN '' ELSE array_to_string(list_transform(list_filter(range(1, len(lines) + 1),
    lambda i: NOT list_contains(coalesce(d, []), i)), lambda i: lines[i]), chr(10)) END) AS kept_sha256
FROM full_lines l LEFT JOIN gone g ON l.doc_id = g.doc_id
"""
