"""Chunks of texts: the fact table of the corpus analytics. Texts are split and counted in one job; what comes after works on distinct chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions.patterns import BASE


def positioned(docs: DataFrame, pattern: str = BASE, text: str = "text") -> DataFrame:
    """docs without the text, with pos (from 0) and chunk, a row for each chunk."""
    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, F.posexplode(T.chunks(F.col(text), pattern)).alias("pos", "chunk"))


def counted(docs: DataFrame, pattern: str = BASE, by: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """(by..., chunk, n)."""
    return docs.select(*by, F.explode(T.chunks(F.col(text), pattern)).alias("chunk")).groupBy(*by, "chunk").agg(F.count("*").alias("n"))


def shard_star(docs: DataFrame, shard: str = "source", pattern: str = BASE) -> tuple[DataFrame, DataFrame]:
    """Distinct chunks (cid, chunk) and their counts by shard (shard, cid, n): chunks are encoded once for all shards."""
    counts = counted(docs, pattern, (shard,)).withColumnRenamed(shard, "shard")
    keyed = counts.withColumn("cid", F.xxhash64("chunk"))
    return keyed.groupBy("cid", "chunk").agg(F.count("*").alias("shards")).select("cid", "chunk"), keyed.select("shard", "cid", "n")
