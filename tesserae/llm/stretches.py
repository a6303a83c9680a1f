"""Stretches of documents around repeated anchors, met in blocks.

A stretch is a run of windows that share one anchor place (see anchors.py); each window of a document lies in exactly
one. Equal stretches form a class, counted as they leave their tasks. The classes of one key (at first the anchor) form
a block, which a solver gets as a whole. Keys of more than MOST classes, such as the flanks of a very frequent passage,
are split: `split` cuts each of their classes into parts with keys of their own, so that equal windows still meet;
parts are classed again, and so on, until every block is small. What the solver says of a part is carried back to the
classes it was cut from by a join, so no class, key or window is ever left out.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import arrow_map, written

#: Classes of one key that are solved together, and of all keys of a batch.
MOST, BATCH = 128, 20_000


def class_id(content: str = "content") -> dict[str, Column]:
    """128 bits for the content of a stretch."""
    return {"c1": F.xxhash64(content), "c2": F.xxhash64(F.lit("second"), content)}


def solved(classes: DataFrame, again: Callable[[DataFrame], DataFrame], split, split_schema: str, solve, result: str) -> tuple[DataFrame, list[DataFrame]]:
    """What `solve` (a table of the columns of `classes`, all classes of its keys, to rows of c1, c2 and `result`) says
    of each class, with `shift`, the place in the class of the part that a row speaks of; and the scratch tables to
    drop after use. classes: key, c1, c2 and the solver's columns. split: the columns of `classes` to rows of p1, p2
    (the class), shift and its columns but c1 and c2; again: classes of these rows."""
    levels, parts, scratch = [], [], []
    while True:
        hot = written(classes.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > MOST).select("key"), "hot")
        scratch.append(hot)
        if not hot.take(1):
            levels.append(_blocks(classes, solve, result))
            break
        levels.append(_blocks(classes.join(hot, "key", "left_anti").select(*classes.columns), solve, result))
        large = classes.join(hot, "key", "left_semi").select(*classes.columns)
        cut = written(arrow_map(large, split, split_schema).withColumns(class_id()), "parts")
        parts.append(cut.select("p1", "p2", "shift", "c1", "c2"))
        classes = written(again(cut), "classes")
        scratch += [cut, classes]
    every = levels.pop().withColumn("shift", F.lit(0))
    while levels:
        every = parts.pop().withColumnRenamed("shift", "by").join(every, ["c1", "c2"]).withColumn("shift", F.col("shift") + F.col("by")).drop("c1", "c2", "by").withColumnsRenamed({"p1": "c1", "p2": "c2"})
        every = levels.pop().withColumn("shift", F.lit(0)).unionByName(every)
    return every, scratch


def _blocks(classes: DataFrame, solve, result: str) -> DataFrame:
    def run(batches):
        held, rows = [], 0
        for batch in batches:
            key = batch.column(0).to_numpy()
            edges = [0, *((key[1:] != key[:-1]).nonzero()[0] + 1).tolist()]
            begin = 0
            for edge in edges:  # a key's first row, or the batch's
                if rows + edge - begin >= BATCH and (edge or key[0] != held[-1].column(0)[-1].as_py()):
                    yield solve(pa.Table.from_batches([*held, batch.slice(begin, edge - begin)] if edge > begin else held))
                    held, rows, begin = [], 0, edge
            held.append(batch.slice(begin))
            rows += len(key) - begin
        if rows:
            yield solve(pa.Table.from_batches(held))

    dealt = classes.select("key", *[c for c in classes.columns if c != "key"]).repartition("key").sortWithinPartitions("key")
    return arrow_map(dealt, run, f"c1 long, c2 long, {result}")

