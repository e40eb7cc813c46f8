"""Sinks: reports, trajectories, block lists, wrong answers, counters, review boards. Frames go to folders of any file system."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a frame that a report shows; the frames themselves are written whole.
SHOWN = 50


def write_report(report: dict[str, DataFrame], folder: str) -> str:
    """Each frame as JSON lines in folder/<name>, and report.md with the first SHOWN rows of each. Returns the Markdown."""
    out = []
    for name, df in report.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
        rows = df.limit(SHOWN).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows] + [""]
    text = "\n".join(out)
    spark = next(iter(report.values())).sparkSession
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report.md")
    return text


def write_series(series: DataFrame, folder: str, order: tuple[str, ...]) -> None:
    """A trajectory as one CSV file in order (a row a step)."""
    series.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def append_journal(events: DataFrame, folder: str) -> None:
    """Adds rows to a journal."""
    events.write.mode("append").json(folder)


def ledger(spark: SparkSession, events: DataFrame) -> list[str]:
    """Lines of a ledger of a search (round, seq, l, r, kind): one for each event, in order."""
    marks = {"commit": "+", "eject": "-", "veto": "!", "release": "~"}
    return [f"{r['round']:>5} {marks.get(r.kind, '?')} {r.l!r} {r.r!r} {r.kind}" for r in events.orderBy("round", "seq").collect()]


def pair_source(pairs: DataFrame, name: str = "BLOCKED_PAIRS") -> str:
    """A list of pairs (ord, l, r) as Python source."""
    rows = pairs.orderBy("ord").collect()
    return f"{name} = [\n" + "".join(f"    ({r.l!r}, {r.r!r}),\n" for r in rows) + "]\n"


def write_wrong(predictions: DataFrame, folder: str) -> bool:
    """The items that were answered wrongly, as JSON lines. A folder that can't be written is told, not raised, as the evaluation matters more; a query that is
    wrong, or fails, is raised."""
    wrong = predictions.where(~F.col("gold").eqNullSafe(F.col("pred")))
    spark = predictions.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.mkdirs(path):
            return False
    except Py4JJavaError:  # no such file system, no right to write, or a file in the way
        return False
    wrong.write.mode("append").json(folder)
    return True


def write_boundary_stats(counters: DataFrame, folder: str, version: int = 1) -> None:
    """Sums of per-task counters (n_total, n_crossing) with their share, as one JSON object."""
    g = counters.agg(F.sum("n_total").alias("n_total"), F.sum("n_crossing").alias("n_boundary_crossing"))
    share = F.when(F.col("n_total") > 0, 100 * F.col("n_boundary_crossing") / F.col("n_total"))
    g.select(F.lit(version).alias("schema_version"), "n_total", "n_boundary_crossing", share.alias("boundary_crossing_pct")).coalesce(1).write.mode("overwrite").json(folder)


def board(scored: DataFrame, born: DataFrame, words: int = 8) -> DataFrame:
    """(l, r, cov, comp, dead, born): scored candidates with the most firing strings that they bring, for review by hand. born: (l, r, s, fires)."""
    top = born.groupBy("l", "r").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("fires")).alias("o"), "s", "fires"))), 1, words).alias("x"))
    text = F.array_join(F.transform("x", lambda v: F.concat_ws(":", v["s"], v["fires"].cast("string"))), " ")
    return scored.join(top, ["l", "r"], "left").select("l", "r", "cov", "comp", "dead", F.coalesce(text, F.lit("")).alias("born"))


def as_json(state: dict) -> str:
    """A small state as JSON, keys in order."""
    return json.dumps(state, sort_keys=True)
