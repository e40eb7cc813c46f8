"""Shape of a table of vectors: variance, effective rank, and how straight sequences of vectors run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    return rows.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def covariance(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(i, j, n, cov) for i <= j: each task sums its products as a matrix, Spark adds the matrices up entry by entry. Vectors that are null or hold
    null or non-finite components, or have another length than the first dimension's most frequent one, take no part."""
    rows = _usable(rows, vector).select(F.col(vector).alias("v"))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = size.d if size else 0

    def partial(batches):
        n, sums, products = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            m = np.array(b.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
            n, sums = n + len(m), sums + m.sum(0)
            products += m.T @ m
        if n:
            i, j = np.triu_indices(dims)
            i, j, x = np.r_[i, np.full(dims, -1)], np.r_[j, np.arange(dims)], np.r_[products[np.triu_indices(dims)], sums]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n), pa.int64()), pa.array(x)], ["i", "j", "n", "x"])

    total = rows.where(F.size("v") == dims).mapInArrow(partial, "i int, j int, n long, x double").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    mean = total.where("i = -1").select("j", (F.col("x") / F.col("n")).alias("m"))  # a row for each dimension
    own = total.where("i >= 0").join(F.broadcast(mean.withColumnRenamed("m", "mj")), "j").join(F.broadcast(mean.select(F.col("j").alias("i"), F.col("m").alias("mi"))), "i")
    return own.select("i", "j", "n", (F.col("x") / F.col("n") - F.col("mi") * F.col("mj")).alias("cov"))


def spread(cov: DataFrame) -> DataFrame:
    """One row: vectors, dimensions, mean variance of a dimension, and the participation ratio: the squared trace over the squared entries' sum."""
    on = F.col("i") == F.col("j")
    t = cov.agg(F.max("n").alias("n"), F.sum(on.cast("long")).alias("dims"), F.sum(F.when(on, F.col("cov"))).alias("trace"), F.sum(F.col("cov") * F.col("cov") * F.when(on, 1).otherwise(2)).alias("squares"))
    return t.select("n", "dims", (F.col("trace") / F.col("dims")).alias("mean_variance"), F.when(F.col("trace") > 0, F.col("trace") * F.col("trace") / F.col("squares")).otherwise(F.lit(0.0)).alias("effective_rank"))


def _cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a) * dot(b, b)), F.lit(1e-8))


def straightness(rows: DataFrame, sequence: str, order: str, spans: tuple[int, ...] = (1,), vector: str = "embedding") -> DataFrame:
    """(span, n, cosine): the mean cosine of two steps of so many places, one behind the other, over sequences (of bounded length) of vectors in order."""
    w = Window.partitionBy(sequence).orderBy(order)
    wide = F.transform(vector, lambda x: x.cast("double"))
    rows = _usable(rows, vector).select(sequence, order, wide.alias("_v"))
    out = None
    for d in spans:
        t = rows.withColumn("_b", F.lead("_v", d).over(w)).withColumn("_c", F.lead("_v", 2 * d).over(w)).where("_c is not null and size(_b) = size(_v) and size(_c) = size(_v)")
        step = lambda x, y: F.zip_with(y, x, lambda p, q: p - q)
        one = t.select(_cosine(step(F.col("_v"), F.col("_b")), step(F.col("_b"), F.col("_c"))).alias("c")).agg(F.lit(d).alias("span"), F.count("*").alias("n"), F.avg("c").alias("cosine"))
        out = one if out is None else out.union(one)
    return out
