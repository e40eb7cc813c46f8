"""Rows in order without a task that holds all: ranges of the order, and what each range hands on to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.cluster import checkpointed


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """rows with _part, the number of their range of the order. Written once, so that the numbers hold wherever they are used."""
    return checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def started(parts: DataFrame, total: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., _part, _start): of each range's total, the sum of those before it. parts: (by..., _part, total), a row for each range."""
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*by, "_part", F.coalesce(F.sum(total).over(w), F.lit(0)).alias("_start"))


def summed_before(rows: DataFrame, value: str, order: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """rows with _before, the sum of a value over the rows before each in order (of its group). rows: of ranged() by the group and the order."""
    parts = rows.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))  # a row for each range (and group)
    own = F.coalesce(F.sum(value).over(Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = started(parts, "_sum", by)
    same = [F.col(f"r.`{k}`").eqNullSafe(F.col(f"s.`{k}`")) for k in (*by, "_part")]
    joined = rows.withColumn("_own", own).alias("r").join(starts.alias("s"), same)
    return joined.select("r.*", (F.col("_start") + F.col("_own")).alias("_before")).drop("_own")
