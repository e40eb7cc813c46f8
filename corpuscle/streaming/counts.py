"""Chunk and firing counts over a stream of documents: the same plans as in batch, with running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions.patterns import BASE


def documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string", files_at_once: int = 64) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def chunk_counts(stream: DataFrame, pattern: str = BASE) -> DataFrame:
    """(chunk, n), for output mode update or complete."""
    return stream.select(F.explode(T.chunks(F.col("text"), pattern)).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by key and window of event time, for output mode append."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
