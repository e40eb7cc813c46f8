"""Small helpers about the session a query runs in: shared folders, intermediate tables and their removal, code shipping, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a measured side may be broadcast.
BROADCAST_BYTES = 32 << 20

#: Rows of an Arrow batch; those of texts may be long.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whether the shuffle files of a query go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that Python workers can import it; keeps Arrow batches of long texts small."""
    if spark.conf.get(BATCH_ROWS) == "10000":  # Spark's default; another value was chosen by the user
        spark.conf.set(BATCH_ROWS, "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="corpuscle-code-")) / "corpuscle_code.zip"  # read by the driver alone, which serves it
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a temporary one is made, in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="corpuscle-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder (which Spark removes with the frame, if spark.cleaner.referenceTracking.cleanCheckpoints is set)."""
    shared_dir(df.sparkSession)
    with _tidy(df.sparkSession):
        return df.checkpoint(eager=True)


@contextmanager
def _tidy(spark: SparkSession):
    """Within, shuffle files go when a query ends: it is written and won't run again."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if before is None:  # an older Spark
        yield
        return
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Intermediate tables of one operator: Parquet in the shared folder, so that they outlive executors and columns can still be pruned.

    Used in a with statement: all tables are deleted at its end, so what leaves it must have been written (checkpointed) before. Tables
    that aren't needed any longer can be dropped sooner.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.folder)

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        """The frame written and read back."""
        path = f"{self.folder}/{name}-{len(self._paths)}"
        with _tidy(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self._paths[id(t)][1])


def staged(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back, for results that are read lazily later on; the folder stays."""
    return Scratch(df.sparkSession, "staged").staged(df, name)


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(c, F.lit(16), lambda n, x: n + _width(x, kind.elementType).cast("int")), F.lit(16))
        return F.greatest(F.size(c), F.lit(0)) * 8 + 24
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def byte_size(df: DataFrame) -> int:
    """Bytes of all rows in memory, about. Measure a frame that is staged or checkpointed."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The frame with a broadcast hint if all its rows were measured to take few bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if byte_size(df) <= limit else df
