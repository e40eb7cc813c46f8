"""Overlap of registers, rare spans, and statistics of runs and predictions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.cluster import checkpointed, small_side
from corpuscle.functions import text as T
from corpuscle.ranges import ranged

WORD = "[a-z']+"


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))


def _after_last_word(texts: DataFrame, by: str, text: str, order: str) -> DataFrame:
    """(by, _w): the words of each text, behind the last word of the texts before it in its register."""
    rows = texts.select(by, order, _words(text).alias("_w"))
    rows = ranged(rows.withColumn("_last", F.when(F.size("_w") > 0, F.element_at("_w", -1))), by, order)
    inside = Window.partitionBy(by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.where("_last is not null").groupBy(by, "_part").agg(F.max_by("_last", order).alias("_end"))  # a row for each range
    ranges = rows.select(by, "_part").distinct().join(ends, [by, "_part"], "left")
    handed = F.last("_end", ignorenulls=True).over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_own", F.last("_last", ignorenulls=True).over(inside)).join(ranges.select(by, "_part", handed.alias("_before")), [by, "_part"])
    return rows.select(by, F.concat(F.array_compact(F.array(F.coalesce("_own", "_before"))), "_w").alias("_w"))


def _behind_characters(texts: DataFrame, by: str, text: str, order: str, n: int = 4) -> DataFrame:
    """(by, _x): each text behind the last n characters of those before it in its register, which a newline ends each."""
    rows = ranged(texts.select(by, order, F.col(text).alias("_t")), by, order)
    inside = Window.partitionBy(by, "_part").orderBy(order)
    tail = lambda c: F.concat(F.right(c, F.lit(n - 1)), F.lit("\n"))
    before = F.concat(*[F.coalesce(tail(F.lag("_t", k).over(inside)), F.lit("")) for k in range(n, 0, -1)])
    rows = rows.withColumn("_own", before).withColumn("_place", F.row_number().over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # What a range hands on: its last characters, and those of the n ranges before it, which may be shorter than n.
    last = rows.groupBy(by, "_part").agg(F.max_by(F.concat("_own", tail(F.col("_t"))), "_place").alias("_end"))  # a row for each range
    ranges = Window.partitionBy(by).orderBy("_part")
    handed = F.concat(*[F.coalesce(F.lag(F.right("_end", F.lit(n)), k).over(ranges), F.lit("")) for k in range(n, 0, -1)])
    rows = rows.join(last.select(by, "_part", handed.alias("_before")), [by, "_part"])
    return rows.select(by, F.concat(F.right(F.concat("_before", "_own"), F.lit(n)), "_t").alias("_x"))


def grams(texts: DataFrame, kind: str, by: str, text: str = "text", order: str | None = None) -> DataFrame:
    """(by, gram, n) of lower-case texts: word, bigram or char4. With an order, the texts of each register are read as one, in that
    order with a newline between them, so that n-grams cross from text to text; else they don't. Registers are read in ranges, each of which hands its end on to the next."""
    if kind == "word":
        g = _words(text)
    elif kind == "bigram":
        texts = _after_last_word(texts, by, text, order) if order else texts.select(by, _words(text).alias("_w"))
        g = T.bound(F.col("_w"), lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))
    else:
        if order:
            texts, text = _behind_characters(texts, by, text, order), "_x"
        g = F.regexp_extract_all(F.col(text), F.lit("(?s)(?=(.{4}))"), F.lit(1))
    return texts.select(by, F.explode(g).alias("gram")).groupBy(by, "gram").agg(F.count("*").alias("n"))


def overlap(p: DataFrame, q: DataFrame, by: str) -> DataFrame:
    """(by, cosine, kl) of each of p's distributions (by, gram, n) to q (gram, n). cosine: 0 if either is empty. kl: in nats over p's support; where q lacks a gram
    it has 1 / (q's total + p's grams). p is read once: q's counts are joined to it, and what both figures need are sums over its rows."""
    q = small_side(checkpointed(q.select("gram", F.col("n").cast("double").alias("m"))))
    qs = q.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("qt"), F.coalesce(F.sum(F.col("m") * F.col("m")), F.lit(0.0)).alias("qq")).first()  # two numbers
    j = p.select(by, "gram", F.col("n").cast("double").alias("n")).join(q, "gram", "left")
    n, m, here = F.col("n"), F.col("m"), F.col("m").isNotNull()
    s = j.groupBy(by).agg(
        F.sum("n").alias("pt"), F.count("*").alias("k"), F.sum(n * n).alias("pp"), F.coalesce(F.sum(n * m), F.lit(0.0)).alias("dot"), F.sum(n * F.log(n)).alias("own"),
        F.coalesce(F.sum(n * F.log(m)), F.lit(0.0)).alias("other"), F.coalesce(F.sum(F.when(here, n)), F.lit(0.0)).alias("shared"),
    )
    qt, pt = F.lit(qs["qt"]), F.col("pt")
    kl = F.col("own") / pt - F.log(pt) - F.col("other") / pt + F.when(qt > 0, F.col("shared") / pt * F.log(qt)).otherwise(0.0) + (pt - F.col("shared")) / pt * F.log(qt + F.col("k"))
    return s.select(by, F.coalesce(F.col("dot") / F.nullif(F.sqrt(F.col("pp") * F.lit(qs["qq"])), F.lit(0.0)), F.lit(0.0)).alias("cosine"), kl.alias("kl"))


def cosine(p: DataFrame, q: DataFrame, by: str) -> DataFrame:
    """(by, cosine) of overlap()."""
    return overlap(p, q, by).select(by, "cosine")


def divergence(p: DataFrame, q: DataFrame, by: str) -> DataFrame:
    """(by, kl) of overlap()."""
    return overlap(p, q, by).select(by, "kl")


def word_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


SPAN = r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?"
SPAN_LOWER = r"(?<![\p{L}'])\p{Ll}{4,}(?: \p{Ll}{4,})?"


def spans_in_band(docs: DataFrame, frequency: DataFrame, low: int, high: int, span: str = SPAN, context: int = 240, min_context: int = 80, drop_sentence_start: bool = True) -> DataFrame:
    """(doc_id, k, span, start, min_freq, n_words): spans whose rarest word has a frequency in the band, with enough text before them, and not at a sentence's start."""
    # What stands before each span, and the span; the piece behind the last one is left out.
    found = F.regexp_extract_all("text", F.lit(span), F.lit(0))
    pieces = docs.select("doc_id", F.split("text", span).alias("p"), found.alias("s")).where(F.size("s") > 0)
    rows = pieces.select("doc_id", F.posexplode(F.zip_with(F.slice("p", 1, F.size("s")), "s", lambda p, s: F.struct((F.length(p) + F.length(s)).alias("n"), s.alias("s")))).alias("k", "x"))
    w = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("doc_id", "k", F.col("x.s").alias("span"), F.sum("x.n").over(w).alias("end")).withColumn("start", F.col("end") - F.length("span"))
    words = rows.select("doc_id", "k", F.explode(F.regexp_extract_all(F.lower("span"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    least = words.join(frequency, "word", "left").groupBy("doc_id", "k").agg(F.min(F.coalesce("n", F.lit(0))).alias("min_freq"), F.count("*").alias("n_words")).where(F.col("min_freq").between(low, high))
    j = rows.join(least, ["doc_id", "k"]).join(docs.select("doc_id", "text"), "doc_id")
    before = F.col("text").substr(F.greatest(F.col("start") - 1, F.lit(1)).cast("int"), F.least(F.col("start"), F.lit(2)).cast("int"))
    ctx = F.col("text").substr(F.greatest(F.col("start") - context + 1, F.lit(1)).cast("int"), F.least(F.col("start"), F.lit(context)).cast("int"))
    j = j.where(F.length(F.regexp_replace(ctx, r"(?U)\s", "")) >= min_context)
    if drop_sentence_start:
        j = j.where(~T.ends_sentence(before))
    return j.select("doc_id", "k", "span", "start", "min_freq", "n_words")


def _poisson(seeds: np.ndarray, resamples: int) -> np.ndarray:
    """A Poisson count with mean 1 for each seed and resample: a hash of both, looked up in the cumulated probabilities."""
    z = seeds.astype(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the mixing steps of splitmix64
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    share = (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)]), share, side="right")


def bootstrap(rows: DataFrame, a: str, b: str, weight: str, key: str, resamples: int = 2000, seed: int = 1234, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, diff, low, high): the difference of ratios sum(a)/sum(weight) - sum(b)/sum(weight), and its 2.5 and 97.5 % resample values.

    Each resample gives every item a Poisson count, the limit of drawing as many items as there are with replacement. An item's counts
    follow from its key alone (unique, of any type), so the interval doesn't depend on how rows are dealt. A task sums all resamples of a batch by one
    product of matrices and sends on a row for each resample and group.
    """
    names = list(by)

    def drawn(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(names, dropna=False, sort=False) if names else [((), pdf)]
            for g, part in groups:
                x, h = part[["_a", "_b", "_w"]].to_numpy(float).T, part["_h"].to_numpy(np.int64).view(np.uint64)
                own = sums.setdefault(tuple(g) if names else (), np.zeros((3, resamples)))
                for i in range(0, len(h), 256):
                    own += x[:, i : i + 256] @ _poisson(h[i : i + 256], resamples)
        for g, s in sums.items():
            yield pd.DataFrame({**{n: pd.Series([None if pd.isna(v) else v] * resamples, dtype=object) for n, v in zip(names, g, strict=True)}, "_k": np.arange(resamples), "_a": s[0], "_b": s[1], "_w": s[2]})

    kinds = [f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names]
    value = lambda c, n: F.col(c).cast("double").alias(n)
    r = rows.select(*names, value(a, "_a"), value(b, "_b"), value(weight, "_w"), F.xxhash64(F.lit(seed), F.col(key)).alias("_h"))
    change = (F.sum("_a") - F.sum("_b")) / F.sum("_w")
    d = r.mapInPandas(drawn, ", ".join([*kinds, "_k int, _a double, _b double, _w double"])).groupBy(*names, "_k").agg(change.alias("_d"))
    ends = d.groupBy(*names).agg(F.percentile("_d", 0.025).alias("low"), F.percentile("_d", 0.975).alias("high"))
    whole = r.groupBy(*names).agg(F.count("*").alias("n"), change.alias("diff"))
    same = [F.col(f"w.`{k}`").eqNullSafe(F.col(f"e.`{k}`")) for k in names] or [F.lit(True)]  # without groups, one row each
    return whole.alias("w").join(ends.alias("e"), same).select(*[f"w.{k}" for k in names], "n", "diff", "low", "high")


def accuracy(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, accuracy, flip_rate) of (gold, pred, pred_changed)."""
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("pred") == F.col("gold")).cast("double")).alias("accuracy"), F.avg((F.col("pred") != F.col("pred_changed")).cast("double")).alias("flip_rate"))


def prediction_shares(predictions: DataFrame) -> DataFrame:
    g = predictions.groupBy("pred").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("_all")))).select("pred", "n", (F.col("n") / F.col("_all")).alias("share"))


def chosen(scores: DataFrame, item: str = "item", option: str = "option", nats: str = "nats", tokens: str = "tokens") -> DataFrame:
    """(item, pred): the option of least mean loss, of equal ones the first."""
    return scores.groupBy(item).agg(F.min_by(option, F.struct(F.col(nats) / F.col(tokens), F.col(option))).alias("pred"))


def swapped(items: DataFrame, key: str, value: str, by: int = 1) -> DataFrame:
    """items (a benchmark, of bounded size) with the value of the item so many places on, in key order and around; never an item's own (of two or more)."""
    ranked = items.select(key, value, F.row_number().over(Window.orderBy(key)).alias("_i"))
    n = ranked.agg(F.max("_i").alias("_n"))
    shift = ranked.crossJoin(F.broadcast(n)).withColumn("_j", F.pmod(F.col("_i") - 1 + by, F.col("_n")) + 1)
    other = ranked.select(F.col("_i").alias("_j"), F.col(value).alias(f"{value}_swapped"))
    return shift.join(other, "_j").select(key, value, f"{value}_swapped")


def few_shot(items: DataFrame, key: str, k: int, seed: int = 1234) -> DataFrame:
    """(key, shot, r): k other items (of a benchmark, of bounded size) for each, by a hash; all others, if there are fewer.

    Items stand in a circle in the order of a hash. An item takes the k at places that step round the circle from itself, by a step
    of its own that has no divisor in common with their number, so that it meets every other item once before itself.
    """
    ranked = items.select(key, (F.row_number().over(Window.orderBy(F.xxhash64(F.lit(seed), key), key)) - 1).alias("_i"))
    n = ranked.agg(F.count("*").alias("_n"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.pmod(F.xxhash64(F.lit(seed + 1), key, t), F.greatest(F.col("_n") - 1, F.lit(1))) + 1)
    coprime = F.filter(steps, lambda s: _gcd(s, F.col("_n")) == 1)
    placed = ranked.crossJoin(F.broadcast(n)).where("_n > 1").withColumn("_s", F.coalesce(F.get(coprime, F.lit(0)), F.lit(1).cast("long")))
    shots = placed.withColumn("r", F.explode(F.sequence(F.lit(1), F.least(F.lit(k).cast("long"), F.col("_n") - 1))))
    shots = shots.withColumn("_j", F.pmod(F.col("_i") + F.col("r") * F.col("_s"), F.col("_n")))
    return shots.join(ranked.select(F.col("_i").alias("_j"), F.col(key).alias("shot")), "_j").select(key, "shot", F.col("r").cast("int").alias("r"))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; 92 of them do for 64-bit numbers."""
    pair = F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.cast("long").alias("x"), b.cast("long").alias("y")), lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), F.pmod(p["x"], F.nullif(p["y"], F.lit(0))).alias("y"))))
    return pair["x"]


def shuffled(choices: Column, key: Column, seed: int = 1234) -> Column:
    """An array in an order by a hash."""
    return F.transform(F.array_sort(F.transform(choices, lambda c, i: F.struct(F.xxhash64(F.lit(seed), key, i).alias("h"), i.alias("i"), c.alias("c")))), lambda x: x["c"])


def is_lettered(choices: Column) -> Column:
    return F.forall(choices, lambda c: c.rlike("^[A-Z]$"))


def common_steps(history: DataFrame, runs: int) -> DataFrame:
    """(step, key) that all runs of (run, key, step, value) have."""
    return history.groupBy("key", "step").agg(F.count_distinct("run").alias("n")).where(F.col("n") == runs).select("key", "step")


def loss_summary(history: DataFrame, last: int = 5) -> DataFrame:
    """(run, count, max, min, last_mean) of (run, step, value)."""
    w = Window.partitionBy("run").orderBy(F.desc("step"))
    r = history.withColumn("_r", F.row_number().over(w))
    return r.groupBy("run").agg(F.count("*").alias("count"), F.max("value").alias("max"), F.min("value").alias("min"), F.avg(F.when(F.col("_r") <= last, F.col("value"))).alias("last_mean"))


def task_changes(control: DataFrame, candidate: DataFrame, meta: DataFrame) -> DataFrame:
    """(task, n, d_centered, se, z): changes of centered accuracy, with the standard error of the control's accuracy."""
    j = control.select("task", "accuracy", F.col("centered").alias("c0")).join(candidate.select("task", F.col("centered").alias("c1")), "task").join(meta, "task")
    se = F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n"))
    return j.select("task", "n", (F.col("c1") - F.col("c0")).alias("d_centered"), se.alias("se")).withColumn("z", F.when(F.col("se") > 0, F.col("d_centered") / F.col("se")))


def mean_of_all(scores: DataFrame, by: str, key: str, value: str, keys: tuple[str, ...]) -> DataFrame:
    """(by, mean) over the values of the keys; null unless all are there."""
    there = scores.where(F.col(key).isin(list(keys))).groupBy(by).agg(F.avg(value).alias("m"), F.count(value).alias("n"))
    return scores.select(by).distinct().join(there, by, "left").select(by, F.when(F.col("n") == len(keys), F.col("m")).alias("mean"))


def combined_change(control: DataFrame, candidate: DataFrame, meta: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row: the mean change of centered accuracy over the keys that both have, its sampling error and their ratio. meta: (task, n, baseline)."""
    k = len(keys)
    j = control.select("task", "accuracy", F.col("centered").alias("c0")).join(candidate.select("task", F.col("centered").alias("c1")), "task").join(meta, "task").where(F.col("task").isin(list(keys)))
    se = F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n")) / (1 - F.col("baseline")) / k
    g = j.agg(F.sum((F.col("c1") - F.col("c0")) / k).alias("change"), F.sqrt(F.sum(se * se)).alias("se"))
    return g.withColumn("sigma", F.when(F.col("se") > 0, F.abs("change") / F.col("se")))


def split_gap(nll: DataFrame, bucket: str, split: str, nats: str = "nats", byte_len: str = "bytes") -> DataFrame:
    """(bucket, train, val, gap): bits a byte of each bucket on two splits."""
    bits = lambda s: F.sum(F.when(F.col(split) == s, F.col(nats))) / F.log(F.lit(2.0)) / F.sum(F.when(F.col(split) == s, F.col(byte_len)))
    return nll.groupBy(bucket).agg(bits("train").alias("train"), bits("val").alias("val")).withColumn("gap", F.col("val") - F.col("train"))


def from_first(series: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """series with the change from each key's first step."""
    w = Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return series.withColumn("from_first", F.col(value) - F.first(value).over(w))


def sparklines(series: DataFrame, key: str, value: str) -> DataFrame:
    """series with a level from 0 to 7 between the least and the greatest value of its key."""
    w = Window.partitionBy(key)
    return series.withColumn("level", sparkline(F.col(value), F.min(value).over(w), F.max(value).over(w)))


def in_batches(rows: DataFrame, size: int, order: tuple[str, ...]) -> DataFrame:
    """rows (candidates, few) with the batch of so many that each falls into."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size).cast("int"))


def rarest_first(spans: DataFrame, k: int, rarest: bool = True) -> DataFrame:
    """The k rarest spans (of more words first among equals), or the most common ones."""
    first = F.asc("min_freq") if rarest else F.desc("min_freq")
    return spans.orderBy(first, F.desc("n_words"), "doc_id", "k").limit(k)


def sparkline(value: Column, low: Column, high: Column) -> Column:
    """0 to 7 by place between low and high."""
    return F.when(high > low, F.least(F.lit(7), F.floor((value - low) / (high - low) * 8))).otherwise(F.lit(0)).cast("int")


def changes(series: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """series with the change from the step before; null where it is absent."""
    w = Window.partitionBy(key).orderBy(step)
    return series.withColumn("change", F.when(F.lag(step).over(w) == F.col(step) - 1, F.col(value) - F.lag(value).over(w)))
