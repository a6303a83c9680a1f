"""From documents to training sequences: language, lines, near copies, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontamination, language_id, line_dedup, near_dedup, packing
from tesserae.llm.common import drop_written, keyed_documents, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A pair with a similarity of 0.8 meets in none of them with probability 5.4e-6.
NEAR_BANDS = 23


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; lang is the one found."""
    out = language_id.identify(docs, language_id.train(docs), "source", "n_chars")
    return out.where("accepted").select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later repeats; those of which no line is left go."""
    out = line_dedup.line_dedup(docs, "lang", "source").where("kept is not null")
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_duplicates(docs, percent=80, n_bands=NEAR_BANDS).where("not kept").select("did", "tid")
    return keyed_documents(docs, "lang", "source", "n_chars").join(classes, ["did", "tid"], "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contaminated(docs, benchmark).select("did", "tid")
    return keyed_documents(docs, "lang", "source", "n_chars").join(found, ["did", "tid"], "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: The stages learn a model, build signatures and tokenize: not SQL. Tested against a plain version (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
            drop_written(before)
    return docs
