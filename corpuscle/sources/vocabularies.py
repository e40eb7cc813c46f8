"""Vocabularies and pair lists from files: rank files, byte-level JSON, own merge tables; block lists, subsets, mined pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.operators import bpe
from corpuscle.operators.probes import bytes_of_glyphs
from corpuscle.ranges import ranged, summed_before


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(vocabulary, merges) of a tokenizer: (id, bytes, is_special) and, where the file tells them, (id, left, right, bytes, n, forced).

    path: a rank file (*.tiktoken: base64 of bytes, and rank), which has no merges; a byte-level JSON file (or a folder with
    tokenizer.json), or a folder of a saved merge table.
    """
    if path.endswith(".tiktoken"):
        p = F.split("value", " ")
        rows = spark.read.text(path).where("value <> ''").select(p.alias("p"))
        return rows.select(F.col("p")[1].cast("int").alias("id"), F.unbase64(F.col("p")[0]).alias("bytes"), F.lit(False).alias("is_special")), None
    if not path.endswith(".json"):
        if not exists(spark, f"{path}/tokenizer.json"):
            merges = spark.read.parquet(path)
            return bpe.vocabulary(merges), merges
        path = f"{path}/tokenizer.json"
    text = spark.read.text(path, wholetext=True)  # one row: a vocabulary is of bounded size
    added = "array<struct<id: int, content: string, special: boolean>>"
    pairs = F.coalesce(
        F.from_json("value", "struct<model: struct<merges: array<array<string>>>>")["model"]["merges"],
        F.transform(F.from_json("value", "struct<model: struct<merges: array<string>>>")["model"]["merges"], lambda m: F.split(m, " ", 2)),
    )
    whole = text.select(F.from_json("value", "struct<model: struct<vocab: map<string, int>>>")["model"]["vocab"].alias("vocab"), F.from_json("value", f"struct<added_tokens: {added}>")["added_tokens"].alias("added"), pairs.alias("pairs"))
    special = whole.select(F.explode("added").alias("a")).select("a.id", F.encode("a.content", "utf-8").alias("bytes"), F.lit(True).alias("is_special"))
    glyphs = whole.select(F.explode("vocab").alias("token", "id"))
    own = glyphs.join(F.broadcast(special.select("id")), "id", "left_anti").select("id", bytes_of_glyphs(F.col("token")).alias("bytes"), F.lit(False).alias("is_special"))
    made = whole.select(F.posexplode("pairs").alias("k", "p")).select("k", F.col("p")[0].alias("l"), F.col("p")[1].alias("r"))
    ids = lambda key, name: glyphs.select(F.col("token").alias(key), F.col("id").alias(name))
    joined = made.join(ids("l", "left"), "l").join(ids("r", "right"), "r").withColumn("t", F.concat("l", "r")).join(ids("t", "id"), "t")
    merges = joined.select("id", "left", "right", bytes_of_glyphs(F.col("t")).alias("bytes"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("forced"))
    return own.union(special), merges


def pair_list(spark: SparkSession, path: str) -> DataFrame:
    """(ord, l, r) of a JSON list of pairs, or of JSON lines with l and r."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("p"))
    return raw.select(F.posexplode("p").alias("ord", "x")).select("ord", F.col("x")[0].alias("l"), F.col("x")[1].alias("r"))


def excluded(lists: list[DataFrame]) -> DataFrame:
    """(l, r): the union of block lists."""
    out = lists[0].select("l", "r")
    for x in lists[1:]:
        out = out.unionByName(x.select("l", "r"))
    return out.distinct()


def subset(pairs: DataFrame, first: int | None = None, places: list[int] | None = None) -> DataFrame:
    """The first so many pairs (ord, l, r), or those at some places; a place that isn't there is an error."""
    if places is None:
        return pairs if first is None else pairs.where(F.col("ord") < first)
    wanted = pairs.sparkSession.createDataFrame([(p,) for p in sorted(set(places))], "ord int")
    missing = [r.ord for r in wanted.join(pairs.select("ord"), "ord", "left_anti").collect()]
    if missing:
        raise IndexError(f"no pairs at {sorted(missing)}")
    return pairs.join(F.broadcast(wanted), "ord", "left_semi")


def mined_artefact(pairs: DataFrame) -> DataFrame:
    """(ord, l, r, n, shadowed) of mined pairs (ord, l, r, n): a pair is shadowed if an earlier pair that isn't has its left operand as the right one.

    A list of mined pairs is short and read in order, so one task reads it.
    """
    import pandas as pd

    def marked(batches):
        taken: set[str] = set()
        for b in batches:
            flags = []
            for left, right in zip(b["l"], b["r"], strict=True):
                flags.append(left in taken)
                if left not in taken:
                    taken.add(right)
            yield pd.DataFrame({"ord": b["ord"], "l": b["l"], "r": b["r"], "n": b["n"], "shadowed": flags})

    return pairs.select("ord", "l", "r", "n").coalesce(1).sortWithinPartitions("ord").mapInPandas(marked, "ord int, l string, r string, n long, shadowed boolean")


def first_wins(pairs: DataFrame, order: str = "ord") -> DataFrame:
    """Each pair (l, r) once, where it comes first."""
    return pairs.groupBy("l", "r").agg(F.min(order).alias(order))


def pooled(miners: dict[str, DataFrame]) -> DataFrame:
    """(l, r, miners): the union of what miners propose, with their names."""
    out = None
    for name, pairs in sorted(miners.items()):
        rows = pairs.select("l", "r", F.lit(name).alias("miner"))
        out = rows if out is None else out.union(rows)
    return out.groupBy("l", "r").agg(F.array_sort(F.collect_set("miner")).alias("miners"))


def latest_state(sources: list[tuple[str, DataFrame | None]]) -> tuple[str, DataFrame] | None:
    """The first of the named sources (in progress, converged, last round) that is there."""
    return next(((n, df) for n, df in sources if df is not None and not df.isEmpty()), None)


def lineage_lines(spark: SparkSession, path: str) -> DataFrame:
    """(round, kind, l, r, string, fires) of a lineage file, a JSON object a line; malformed lines are passed over."""
    schema = "round int, kind string, l string, r string, string string, fires long, _bad string"
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).cache()
    return rows.where("_bad is null").drop("_bad")


def kept_folders(folders: DataFrame) -> DataFrame:
    """(keep, folder) of folders named keep_N, by N; others are passed over."""
    n = F.regexp_extract("folder", r"keep_(\d+)/*$", 1)
    return folders.where(n != "").select(n.cast("int").alias("keep"), "folder")


def ranked_texts(docs: DataFrame, shard: str, max_chars: int, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, text): the documents of each shard in order, one behind another, up to max_chars, which bounds what a task holds: the last one is cut before
    texts are gathered. To split whole shards without gathering them see operators/joined.py."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(shard, order, F.xxhash64(t).alias("_h"), t.alias("t"))
    places = summed_before(ranged(rows.groupBy(shard, order, "_h").agg(F.sum(F.length("t").cast("long")).alias("_n")), shard, order, "_h"), "_n", (order, "_h"), (shard,))
    near = rows.join(places.where(F.col("_before") < max_chars).select(shard, order, "_h", "_before"), [shard, order, "_h"]).withColumn("t", F.left("t", (F.lit(max_chars) - F.col("_before")).cast("int")))
    whole = near.groupBy(shard).agg(F.array_sort(F.collect_list(F.struct(order, "_h", "t"))).alias("x"))
    return whole.select(shard, F.substring(F.array_join(F.transform("x", lambda v: v["t"]), ""), 1, max_chars).alias(text))
