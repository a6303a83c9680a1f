"""Substring dedup by relative Lempel-Ziv parsing.

The corpus itself is the reference, cut into reference blocks: all stretches around one repeated anchor (stretches.py)
form a block, indexed by their phrases of `window` words, and every document meets each block that could hold one of
its phrases, once. In a block a stretch is factored greedily against those that start earlier: from its first phrase
that occurs among them, the longest run of phrases that one of them continues becomes a factor, with its source; then
the phrase that straddles the factor's end is looked up, and so on (the check at factor boundaries). A document's
factors are put together: where one goes on at the same source in the next block, both become one. Factors are at
least `window` words long and cover exactly the words of all phrases that start earlier in the corpus.

Nulls: a null text has no words; a null doc_id sorts before all others (as a source it is null). Repeated rows: rows
that share a doc_id are one document, whose places are shared (nothing is removed from one of two equal rows because of
the other). Ties do not occur: places differ. Documents under `window` words stay whole; a text is held by one task as
about 60 bytes for each of its bytes. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.anchors import Windows, in_sketch, opened, repeated_anchors
from tesserae.llm.common import BASES, U, arrow_map, byte_values, chunks, gram_hashes, keyed_documents, span_hashes, splitmix, word_spans, written
from tesserae.llm.stretches import class_id, solved

#: Long enough that frequent words alone rarely repeat one (at 6, a third of all windows looked repeated).
ANCHOR_WORDS = 8
WINDOWS = 20
NULL = -(2**63)


def _word_layout(buf: np.ndarray, offsets: np.ndarray):
    starts, ends, at = word_spans(buf, offsets)
    return span_hashes(byte_values()[buf], starts, ends), at


def stretches(keyed: DataFrame, windows: Windows, sketch) -> DataFrame:
    """did, start (word), key (the anchor), before (words of the stretch in front of it) and content (64 bits of each
    phrase) of every stretch whose anchor may repeat."""

    def emit(batches):
        bits = opened(sketch)
        for batch in batches:
            did, tid = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, buf, offsets in chunks(batch.column(2)):
                values, at, starts, place, grams = windows.of(buf, offsets)
                if not len(starts):
                    continue
                own = np.searchsorted(at, starts, "right") - 1
                first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (own[1:] != own[:-1])])
                size = np.diff(np.r_[first, len(starts)])
                keep = in_sketch(bits, grams[place[first]])
                phrases = gram_hashes(values, windows.length, BASES[1])[starts][np.repeat(keep, size)]
                first, size = first[keep], size[keep]
                s, h = starts[first], grams[place[first]]
                ends = np.r_[0, np.cumsum(size)]
                for k in range(0, len(first), 50_000):
                    t = slice(k, k + 50_000)
                    edge = ends[k : k + len(first[t]) + 1]
                    of = own[first[t]]
                    cols = (did[i + of], tid[i + of], s[t] - at[of], h[t].view(np.int64), (place[first[t]] - s[t]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), binaries(phrases, edge)], ["did", "tid", "start", "key", "before", "content"])

    return arrow_map(keyed.select("did", "tid", "text"), emit, "did long, tid long, start long, key long, before int, content binary")


def entries(content) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of a binary column, and the places where each row's begin."""
    column = content.combine_chunks() if isinstance(content, pa.ChunkedArray) else content
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data.slice(int(off[0]), int(off[-1] - off[0])).to_pybytes(), np.uint64), (off - off[0]) // 8


def binaries(phrases: np.ndarray, begin: np.ndarray) -> pa.Array:
    """The other way round."""
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(((begin - begin[0]) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(phrases[begin[0] : begin[-1]]))])


def parse(group: np.ndarray, before: np.ndarray, phrases: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of stretches, in order of their places within their group (block), against the earlier ones of
    it: the row, the first phrase, the phrases, and the row of the source."""
    n = len(group)
    size = np.diff(begin)
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(phrases)) - begin[:-1][row]
    longest, source = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
    left = np.arange(len(phrases))
    key = splitmix(group.astype(np.uint64)[row] * U(0x9E3779B97F4A7C15) + (before[row] - at).astype(np.uint64)) ^ phrases
    k = 1
    while len(left):  # runs of k phrases from the same distance of the anchor, by the hash of all of them
        _, first, inverse, often = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        from_row = row[left[first[inverse]]]
        hit = from_row < row[left]
        longest[left[hit]], source[left[hit]] = k, from_row[hit]
        on = (often[inverse] > 1) & (at[left] + k < size[row[left]])
        left, key = left[on], key[on]
        if len(left):
            key = splitmix(key + U(0xD1342543DE82EF95)) ^ phrases[left + k]
        k += 1
    out, cursor, live = [], begin[:-1].copy(), np.arange(n)
    while len(live):
        c = cursor[live]
        c, live = c[c < begin[1:][live]], live[c < begin[1:][live]]
        found = longest[c] > 0
        out.append((live[found], c[found]))
        cursor[live] = c + np.maximum(longest[c], 1)
    rows, first = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
    return rows, first - begin[:-1][rows], longest[first], source[first]


#: Rows for the occurrences of a class: first is true for those that speak of its first place (fdid, fpos) and false
#: for those that speak of all others; at and phrases: the factor; sdid and spos: its source.
RESULT = "first boolean, at int, phrases int, sdid long, spos long, fdid long, fpos long"
COLUMNS = ["c1", "c2", "first", "at", "phrases", "sdid", "spos", "fdid", "fpos"]


def factor_block(t: pa.Table) -> pa.RecordBatch:
    t = t.sort_by([("key", "ascending"), ("did", "ascending"), ("start", "ascending")])
    key, did, start, n, before, c1, c2 = (t.column(x).to_numpy() for x in ("key", "did", "start", "n", "before", "c1", "c2"))
    phrases, begin = entries(t.column("content"))
    size = np.diff(begin)
    copied = np.flatnonzero(n > 1)
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
    many = np.bincount(group)[group] > 1
    pick = np.flatnonzero(many)
    inner = phrases[np.repeat(many, size)]
    rows, at, length, source = parse(group[pick], before[pick], inner, np.r_[0, np.cumsum(size[pick])])
    rows, source = pick[rows], pick[source]
    same = start[source] + before[source] - before[rows] + at  # the source's phrase at the same distance of the anchor
    both = [np.r_[rows, copied], np.r_[np.ones(len(rows), bool), np.zeros(len(copied), bool)], np.r_[at, np.zeros(len(copied), np.int64)].astype(np.int32), np.r_[length, size[copied]].astype(np.int32), np.r_[did[source], did[copied]], np.r_[same, start[copied]]]
    r = both[0]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (c1[r], c2[r], *both[1:], did[r], start[r])], COLUMNS)


def single_phrases(batches):
    """Stretches of a frequent anchor as one part for each phrase, whose key is the phrase itself."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = {x: b.column(x) for x in ("c1", "c2", "key", "did", "start", "before", "n")}
        phrases, begin = entries(b.column(b.schema.get_field_index("content")))
        row = np.repeat(np.arange(b.num_rows), np.diff(begin))
        at = np.arange(len(phrases)) - begin[:-1][row]
        key, did, start, before, n = (cols[x].to_numpy() for x in ("key", "did", "start", "before", "n"))
        before = (before[row] - at).astype(np.int32)
        part = splitmix(key.view(np.uint64)[row] + before.astype(np.uint64)) ^ phrases
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (cols["c1"].to_numpy()[row], cols["c2"].to_numpy()[row], at.astype(np.int32), did[row], start[row] + at, part.view(np.int64), before, n[row])] + [binaries(phrases, np.arange(len(phrases) + 1))],
            ["p1", "p2", "shift", "did", "start", "key", "before", "n", "content"],
        )


PART = "p1 long, p2 long, shift int, did long, start long, key long, before int, n long, content binary"


def classed(rows: DataFrame, count) -> DataFrame:
    """Classes of equal stretches, with the first place and the number of each."""
    own = rows.groupBy("key", "before", "content").agg(F.min(F.struct("did", "start")).alias("first"), count.alias("n"))
    return own.select("key", "before", "content", "first.did", "first.start", "n").withColumns(class_id())


def factors(docs: DataFrame, window: int = WINDOWS) -> tuple[DataFrame, list[DataFrame]]:
    """did, tid, factors array<struct<pos, phrases, sdid, spos>>, within blocks; and the scratch tables it reads."""
    windows = Windows(window, min(ANCHOR_WORDS, window), _word_layout)
    keyed = keyed_documents(docs)
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_anchors(keyed, windows))
    own = stretches(keyed, windows, sketch)
    classes = written(classed(own, F.count("*")), "classes")
    found, scratch = solved(classes, lambda rows: classed(rows, F.sum("n")), single_phrases, PART, factor_block, RESULT)
    found = own.select("did", "tid", "start", *[x.alias(n) for n, x in class_id().items()]).join(found, ["c1", "c2"])
    place = F.col("start") + F.col("shift")
    found = found.where(F.col("first") == ((F.col("did") == F.col("fdid")) & (place == F.col("fpos"))))
    found = found.select("did", "tid", F.struct((place + F.col("at")).alias("pos"), "phrases", "sdid", "spos").alias("x"))
    return found.groupBy("did", "tid").agg(F.collect_list("x").alias("factors")), [classes, *scratch]


def joined_factors(pos: np.ndarray, phrases: np.ndarray, sdid: np.ndarray, spos: np.ndarray):
    """A document's factors in order, those that go on at the same source as one."""
    if not len(pos):
        return pos, pos, pos, pos
    order = np.lexsort((phrases, pos))
    pos, phrases, sdid, spos = pos[order], phrases[order], sdid[order], spos[order]
    new = np.r_[True, (sdid[1:] != sdid[:-1]) | (spos[1:] - pos[1:] != spos[:-1] - pos[:-1]) | (pos[1:] > pos[:-1] + phrases[:-1])]
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(pos + phrases, first)
    return pos[first], end - pos[first], sdid[first], spos[first]


def substring_dedup(docs: DataFrame, window: int = WINDOWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (its kept words, joined by one space), factors (start and words of every one,
    the document and the word they were copied from): every word within a factor goes."""
    own, _ = factors(docs, window)
    joined = keyed_documents(docs).join(own, ["did", "tid"], "left").select("doc_id", "text", "factors")

    def cut(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            off = lists.offsets.to_numpy()
            flat = lists.values
            pos, phrases, sdid, spos = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            for i, buf, offsets in chunks(batch.column(1)):
                starts, ends, at = word_spans(buf, offsets)
                kept, removed, made = [], [], []
                for j in range(len(at) - 1):
                    s, e = starts[at[j] : at[j + 1]], ends[at[j] : at[j + 1]]
                    own = slice(off[i + j], off[i + j + 1]) if lists[i + j].is_valid else slice(0, 0)
                    p, n, d, q = joined_factors(pos[own], phrases[own], sdid[own], spos[own])
                    n = n + window - 1
                    if len(p):
                        edge = np.zeros(len(s) + 1, np.int64)
                        np.add.at(edge, p, 1)
                        np.add.at(edge, p + n, -1)
                        keep = np.cumsum(edge[:-1]) == 0
                        s, e = s[keep], e[keep]
                    kept.append(_joined(buf, s, e))
                    removed.append(int(at[j + 1] - at[j]) - len(s))
                    made.append([{"start": a, "words": b, "source": None if c == NULL else c, "at": f} for a, b, c, f in zip(p.tolist(), n.tolist(), d.tolist(), q.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(kept)), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(made, FACTOR)], ["doc_id", "n_words", "n_removed", "kept", "factors"])

    return arrow_map(joined, cut, "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start: long, words: long, source: long, at: long>>")


FACTOR = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "words", "source", "at")]))


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words, joined by one space."""
    if not len(starts):
        return b""
    lengths = ends - starts + 1
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    at = np.arange(total) + np.repeat(starts - begin, lengths)
    out = buf[np.minimum(at, len(buf) - 1)]
    out[begin[1:] - 1] = 32
    return out[:-1].tobytes()


def op2(spark, sf_dir: str) -> DataFrame:
    from tesserae.llm.common import documents

    out = substring_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("factors").alias("n_factors"))
