"""Codecs over streams of chunks. Codec expressions keep no state, so they run in a stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.pipeline import Chain


def read_chunk_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def encoded_stream(stream: DataFrame, chain: Chain, column: str = "chunk") -> DataFrame:
    return stream.withColumn(column, chain.encode(F.col(column)))


def once(stream: DataFrame, data: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """The stream without repeated payloads within the watermark, by a 256-bit digest."""
    return stream.withWatermark(at, delay).withColumn("digest", F.sha2(data, 256)).dropDuplicatesWithinWatermark(["digest"])


def volume(stream: DataFrame, data: str, at: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Rows and bytes by window."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window)).agg(F.count("*").alias("n"), F.sum(F.octet_length(data)).alias("bytes"))
