"""Documents in the order in which files hold them, row group by row group, with files behind a cap never read.

Row counts of row groups come from the files' footers, which Spark's own file systems read; a row's place comes from the scan's
metadata columns. Lengths of texts are summed file by file, some files at a time and twice as many each time, until the cap is reached; what is
returned reads the files up to there alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str) -> list[str]:
    """The Parquet files at a path, in name order; the path may be one of them."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    if status is None or not len(status):
        raise FileNotFoundError(path)
    names = [f.getPath() for f in status if f.isFile()]
    return sorted(n.toString() for n in names if not n.getName().startswith(("_", ".")) and (n.getName().endswith(".parquet") or len(names) == 1))


def row_groups(spark: SparkSession, file: str) -> list[int]:
    """Rows of each row group of a file, from its footer."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    try:
        return [int(b.getRowCount()) for b in reader.getFooter().getBlocks()]
    finally:
        reader.close()


def placed(spark: SparkSession, names: list[str], *columns: str) -> DataFrame:
    """(columns..., file, row) of files, given by name in order: the number of the file among them, and the row's place in it."""
    number = spark.createDataFrame(list(enumerate(names)), "file int, _name string")  # a row for each file
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    rows = spark.read.parquet(*names).select(*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("row"))
    # Paths come back encoded as in a URL.
    return rows.join(F.broadcast(number), plain(F.url_decode(F.regexp_replace("_path", r"\+", "%2B"))) == plain(F.col("_name"))).select(*columns, "file", "row")


def _groups(spark: SparkSession, names: list[str], rows_a_batch: int | None) -> DataFrame:
    """(file, batch, first, behind): the batches of files: row groups, or so many rows of one each."""
    out = []
    for k, name in enumerate(names):
        at = batch = 0
        for n in row_groups(spark, name):
            for i in range(0, n, rows_a_batch or max(1, n)):
                out.append((k, batch, at + i, at + min(n, i + (rows_a_batch or n))))
                batch += 1
            at += n
    return spark.createDataFrame(out, "file int, batch int, first long, behind long")


def _taken(spark: SparkSession, names: list[str], max_chars: int, text: str, rows_a_batch: int | None) -> Iterator[tuple[int, int, int]]:
    """(file, first row, row behind the last) of each batch that begins before the cap is reached."""
    before, start, step = 0, 0, 1
    while start < len(names) and before < max_chars:
        some = names[start : start + step]
        batches = _groups(spark, some, rows_a_batch)
        length = F.coalesce(F.length(text), F.lit(0)).cast("long")
        sizes = placed(spark, some, text).join(F.broadcast(batches), "file").where("row >= first and row < behind").groupBy("file", "batch", "first", "behind").agg(F.sum(length).alias("n"))
        for r in sizes.orderBy("file", "batch").collect():  # a row for each row group, of some files
            if before >= max_chars:
                return
            before += r.n
            yield start + r.file, r.first, r.behind
        start, step = start + step, 2 * step


def capped_by_batch(spark: SparkSession, path: str, max_chars: int, *columns: str, text: str = "text", rows_a_batch: int | None = None) -> DataFrame:
    """(columns..., file, row) of whole batches in the files' order until max_chars: the cap is looked at between batches, so the last may exceed it.

    A batch is a row group, or at most so many rows of one. Files behind the last batch aren't read."""
    names, last = files(spark, path), {}
    for k, _, behind in _taken(spark, names, max_chars, text, rows_a_batch):
        last[k] = behind
    if not last:
        return placed(spark, names[:1], *columns).where("false")
    end = max(last)
    return placed(spark, names[: end + 1], *columns).where((F.col("file") < end) | (F.col("row") < last[end]))


def capped_by_document(spark: SparkSession, path: str, max_chars: int, *columns: str, text: str = "text") -> DataFrame:
    """(columns..., file, row) of documents in the files' order until max_chars; the one that reaches the cap is the last. Files behind it aren't read."""
    from corpuscle.ranges import ranged, summed_before

    names, end = files(spark, path), -1
    for end, _, _ in _taken(spark, names, max_chars, text, None):
        pass
    rows = placed(spark, names[: max(end, 0) + 1], *dict.fromkeys((*columns, text)))
    sizes = summed_before(ranged(rows.select("file", "row", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("_n")), "file", "row"), "_n", ("file", "row"))
    # The first row that begins at the cap or behind it: one row.
    cut = sizes.where(F.col("_before") >= max_chars).agg(F.min(F.struct("file", "row")).alias("c")).first()["c"]
    kept = rows if cut is None else rows.where((F.col("file") < cut["file"]) | ((F.col("file") == cut["file"]) & (F.col("row") < cut["row"])))
    return kept.select(*columns, "file", "row")
