"""Sources: capped corpus scans, splits, benchmark items, evaluation archives, vocabulary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.ranges import ranged, summed_before


def split_of(doc_id: Column, parts: int = 10) -> Column:
    """'val' for the last of so many residues of doc_id, 'train' for the others."""
    return F.when(F.pmod(doc_id, F.lit(parts)) == parts - 1, "val").otherwise("train")


def last_file_split(docs: DataFrame) -> DataFrame:
    """docs with a split by file: the last file in name order is 'val'."""
    named = docs.withColumn("_file", F.input_file_name())
    last = named.agg(F.max("_file").alias("_last"))  # one row
    return named.crossJoin(F.broadcast(last)).withColumn("split", F.when(F.col("_file") == F.col("_last"), "val").otherwise("train")).drop("_file", "_last")


def capped(docs: DataFrame, max_chars: int, order: tuple[str, ...] = ("doc_id",), shard: str | None = None, doc_cap: int | None = None, after: bool = False, text: str = "text") -> DataFrame:
    """Documents in order until max_chars; the one that reaches the cap is the last (with after=True, the one that exceeds it). With a shard, those of each shard.

    The running total is in two steps, so that no task holds all rows or a whole shard: totals of ranges of the order, then
    within the range. doc_cap cuts each text first. Documents alike in order and text, of which only some fit, are kept or left together with the first of them.
    """
    t = F.substring(F.col(text), 1, doc_cap) if doc_cap else F.col(text)
    cut = docs.withColumn(text, t).withColumn("_h", F.xxhash64(text))
    by = (shard,) if shard else ()
    # Copies count as one place, with all their characters.
    places = cut.groupBy(*by, *order, "_h").agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("_n"))
    rows = summed_before(ranged(places, *by, *order, "_h"), "_n", (*order, "_h"), by)
    kept = rows.where((F.col("_before") <= max_chars) if after else (F.col("_before") < max_chars)).select(*by, *order, "_h")
    same = [F.col(f"c.`{k}`").eqNullSafe(F.col(f"k.`{k}`")) for k in (*by, *order, "_h")]
    return cut.alias("c").join(kept.alias("k"), same, "left_semi").drop("_h")


def capped_batches(docs: DataFrame, max_chars: int, batch: str, text: str = "text") -> DataFrame:
    """Whole batches (by the column batch, in order) until max_chars: the cap is looked at between batches alone, so the last one may exceed it."""
    sizes = docs.groupBy(batch).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("_n"))  # a row per batch
    before = F.coalesce(F.sum("_n").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return docs.join(sizes.withColumn("_before", before).where(F.col("_before") < max_chars).select(batch), batch, "left_semi")


def capped_equally(docs: DataFrame, max_chars: int, shards: int, shard: str, order: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """capped() by shard, with the cap split among so many shards."""
    return capped(docs, max_chars // shards, order, shard, text=text)


def first_documents(docs: DataFrame, n: int, doc_cap: int | None = None, order: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The first n documents in order, cut to doc_cap characters."""
    out = docs.orderBy(*order).limit(n)
    return out.withColumn(text, F.substring(text, 1, doc_cap)) if doc_cap else out


def last_shard(spark: SparkSession, folder: str) -> DataFrame:
    """The last Parquet file of a folder by name, in any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = sorted(f.getPath().toString() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p) if f.getPath().getName().endswith(".parquet"))
    if not names:
        raise FileNotFoundError(folder)
    return spark.read.parquet(names[-1])


def registers(docs: DataFrame, by: str, doc_chars: int | None = None, text: str = "text", drop_last: str | None = None) -> DataFrame:
    """(by, doc_id, text): lower case, null as empty; cut to doc_chars, if given. drop_last: a column of file names, whose last file is left out."""
    if drop_last:
        last = docs.agg(F.max(drop_last).alias("_last"))  # one row
        docs = docs.crossJoin(F.broadcast(last)).where(F.col(drop_last) < F.col("_last")).drop("_last")
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(by, "doc_id", F.lower(F.substring(t, 1, doc_chars) if doc_chars else t).alias("text"))


def benchmark_items(spark: SparkSession, path: str, meta: DataFrame | None = None) -> DataFrame:
    """JSON lines of multiple-choice or continuation items, with the task's name from the file and its metadata (task, ...) if given."""
    schema = "query string, choices array<string>, gold int, context string, continuation string"
    items = spark.read.schema(schema).json(path).withColumn("task", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl?$", 1))
    return items.join(F.broadcast(meta), "task", "left") if meta is not None else items


def eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """(file, task, accuracy, centered) of rows with a number; a header and short rows are passed over."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    p = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = lines.select("file", p.alias("p")).where(F.size("p") >= 3)
    return rows.select("file", F.col("p")[0].alias("task"), F.expr("try_cast(p[1] as double)").alias("accuracy"), F.expr("try_cast(p[2] as double)").alias("centered")).where("centered is not null")


def eval_meta(spark: SparkSession, path: str) -> DataFrame:
    """(task, n, baseline) of rows with six columns and a whole number in the fifth."""
    rows = spark.read.text(path).select(F.split("value", ",").alias("p")).where(F.size("p") >= 6)
    out = rows.select(F.col("p")[0].alias("task"), F.expr("try_cast(trim(p[4]) as long)").alias("n"), (F.expr("try_cast(trim(p[5]) as double)") / 100).alias("baseline"))
    return out.where("n is not null")


def last_match(spark: SparkSession, path: str, pattern: str, groups: tuple[str, ...]) -> DataFrame:
    """(file, groups...): numbers of the last match in each log. Lines are read apart, so a log may be of any size."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), "value").where(F.col("value").rlike(pattern))
    at = lambda k: F.element_at(F.regexp_extract_all("value", F.lit(pattern), F.lit(k + 1)), -1)
    found = lines.select("file", "place", F.struct(*[at(k).alias(g) for k, g in enumerate(groups)]).alias("found"))
    last = found.groupBy("file").agg(F.max_by("found", "place").alias("found"))
    return last.select("file", *[F.expr(f"try_cast(found.{g} as double)").alias(g) for g in groups])


def run_index(spark: SparkSession, root: str) -> DataFrame:
    """(run, folder): the newest archive of each run named in meta.json or ENV; runs named dummy are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.col("content").cast("string")
    name = F.when(F.col("path").endswith("/meta.json"), F.get_json_object(text, "$.user_config.run")).when(F.col("path").endswith("/ENV"), F.regexp_extract(text, r"(?m)^(?:WANDB_RUN|RUN)=(.*)$", 1))
    rows = files.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"), "modificationTime", F.nullif(name, F.lit("")).alias("run"), F.col("path").endswith("/meta.json").alias("first"))
    named = rows.where("run is not null").groupBy("folder").agg(F.max_by("run", F.struct("first", "run")).alias("run"), F.max("modificationTime").alias("time"))
    return named.where("run <> 'dummy'").groupBy("run").agg(F.max_by("folder", F.struct("time", "folder")).alias("folder"))


def word_list(spark: SparkSession, path: str) -> DataFrame | None:
    """(word): distinct, in lower case; None if there is no such file."""
    from corpuscle.sources.vocabularies import exists

    if not exists(spark, path):
        return None
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def words_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word): a dictionary from texts, where no list is at hand."""
    return texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()


def vocab_dump(spark: SparkSession, path: str) -> DataFrame:
    """(rank, count, byte_len, repr) of a text dump; comments and headers are passed over, of equal tokens the last counts."""
    p = F.split(F.trim("value"), r"\s+", 4)
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(p.alias("p")).where(F.size("p") == 4)
    cast = rows.select(F.expr("try_cast(p[0] as int)").alias("rank"), F.expr("try_cast(p[1] as long)").alias("count"), F.expr("try_cast(p[2] as int)").alias("byte_len"), F.col("p")[3].alias("repr")).where("rank is not null")
    return cast.groupBy("repr").agg(F.max_by(F.struct("rank", "count", "byte_len"), "rank").alias("x")).select("x.*", "repr")


def boundary_stats(spark: SparkSession, path: str) -> DataFrame:
    """Counters of a sidecar; nulls where it is malformed."""
    return spark.read.schema("schema_version int, n_total long, n_boundary_crossing long, boundary_crossing_pct double").option("multiLine", True).json(path)


def checkpoint_rounds(spark: SparkSession, path: str) -> DataFrame:
    """(round, pair, d_cov, d_comp, d_dead): verdicts of a search journal."""
    schema = "rounds array<struct<round: int, verdicts: map<string, array<double>>>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("rounds").alias("r"))
    v = r.select("r.round", F.explode("r.verdicts").alias("pair", "d"))
    return v.select("round", "pair", *[F.col("d")[k].alias(c) for k, c in enumerate(("d_cov", "d_comp", "d_dead"))])


def kept_steps(spark: SparkSession, root: str) -> DataFrame:
    """Tables in folders keep=N under root, with N."""
    return spark.read.parquet(root)
