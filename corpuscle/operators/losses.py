"""Token losses from documents: an interpolated n-gram model counted on one split and scored on others.

A token's probability is that of its unigram, with one added to each count, mixed with its share among what follows the token before it,
and that with its share behind the two before. Everything works on distinct runs of three tokens with their counts; contexts go to all tasks if they were
measured to be few. bucketed() takes runs as arrays of the tokens' hashes, dealt to slices by their token and then by the one before it, so
that documents are split twice whatever their size, and a task holds one slice.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, checkpointed, small_side
from corpuscle.functions import text as T
from corpuscle.functions.patterns import BASE, RANK_BUCKETS

#: Weight of the longer history where it was seen; what stands before a text.
WEIGHT, START = 0.7, "\x02"


def runs(docs: DataFrame, by: str, pattern: str = BASE, text: str = "text") -> DataFrame:
    """(by, h2, h1, token, n): each chunk with the two before it in its text, counted."""
    c = F.col("_c")
    before = lambda i, k: F.coalesce(F.get(c, i - k), F.lit(START))
    rows = docs.select(by, T.chunks(F.col(text), pattern).alias("_c")).select(by, F.explode(F.transform(c, lambda x, i: F.struct(before(i, 2).alias("h2"), before(i, 1).alias("h1"), x.alias("token")))).alias("r"))
    return rows.groupBy(by, "r.h2", "r.h1", "r.token").agg(F.count("*").alias("n"))


def ranks(counts: DataFrame) -> DataFrame:
    """(token, n, rank) of token counts (token, n): how many tokens have a greater count. Cumulated over distinct counts, not over tokens."""
    sizes = counts.groupBy("n").agg(F.count("*").alias("_k"))
    above = F.coalesce(F.sum("_k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each count that occurs
    return counts.join(small_side(checkpointed(sizes.select("n", above.alias("rank")))), "n").select("token", "n", "rank")


def bucket(rank: Column, edges: tuple[int, ...] = RANK_BUCKETS) -> Column:
    """The lower edge of a rank's bucket; -1 for tokens without a rank."""
    out = F.when(rank.isNull(), -1)
    for edge in reversed(edges):
        out = out.when(rank >= edge, edge)
    return out


#: Tokens of texts whose runs are a slice, or are counted at once where they are read.
SLICE = 1 << 21


def _ranked(scratch: Scratch, tokens: DataFrame) -> tuple[DataFrame, int, int]:
    """(token, c1, rank) of token counts (token, n), their sum, and how many they are."""
    one = scratch.staged(ranks(scratch.staged(tokens, "tokens")).withColumnRenamed("n", "c1"), "ranks")
    total = one.agg(F.sum("c1").alias("_n"), F.count("*").alias("_v")).first()  # two numbers
    return one, total["_n"] or 0, total["_v"]


def _scored(scratch: Scratch, counts: DataFrame, by: str, train: str, weight: float) -> DataFrame:
    own = scratch.staged(counts.where(F.col(by) == train).groupBy("h2", "h1", "token").agg(F.sum("n").alias("c3")), "threes")
    pairs = scratch.staged(own.groupBy("h1", "token").agg(F.sum("c3").alias("c2")), "pairs")
    one, size, kinds = _ranked(scratch, pairs.groupBy("token").agg(F.sum("c2").alias("n")))
    after = lambda t, keys, c, name: small_side(scratch.staged(t.groupBy(*keys).agg(F.sum(c).alias(name)), name))
    j = counts.join(own, ["h2", "h1", "token"], "left").join(after(own, ("h2", "h1"), "c3", "b3"), ["h2", "h1"], "left")
    j = j.join(pairs, ["h1", "token"], "left").join(after(pairs, ("h1",), "c2", "b2"), "h1", "left").join(small_side(one), "token", "left")
    seen = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    p = (seen("c1") + 1) / F.lit(float(size + kinds + 1))
    for c, b in (("c2", "b2"), ("c3", "b3")):
        p = F.when(F.col(b).isNull(), p).otherwise(F.lit(weight) * seen(c) / F.col(b) + F.lit(1 - weight) * p)
    return j.select(by, "token", "n", (-F.log(p) * F.col("n")).alias("nats"), (F.octet_length("token") * F.col("n")).alias("bytes"), "rank")


def scored(counts: DataFrame, by: str, train: str, weight: float = WEIGHT) -> DataFrame:
    """(by, token, n, nats, bytes, rank): summed losses of each distinct run's token under the model counted on the split `train`; rank by its count there, null if unseen. counts: of runs()."""
    with Scratch(counts.sparkSession, "losses") as scratch:
        return checkpointed(_scored(scratch, counts, by, train, weight))


def _sorted_rows(columns: list[np.ndarray], kinds: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, starts): rows of numbers below `kinds` in order by the columns, and where in it the first column's groups, those of the first two, and so on begin."""
    keys, size = columns[0].astype(np.int64), max(kinds[0], 1)
    for c, k in zip(columns[1:], kinds[1:], strict=True):
        if size * max(k, 1) >= 1 << 62:
            own, keys = np.unique(keys, return_inverse=True)
            size = len(own)
        keys, size = keys * k + c, size * max(k, 1)
    order = np.argsort(keys)
    new, starts = np.zeros(len(keys), bool), []
    new[:1] = True
    for c in columns:
        own = c[order]
        new[1:] |= own[1:] != own[:-1]
        starts.append(np.flatnonzero(new))
    return order, starts


def _per_row(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row the sum of its group."""
    return np.repeat(np.add.reduceat(values, starts), np.diff(np.r_[starts, len(values)]))


def _cells(names: list[str], slices: np.ndarray, words: np.ndarray, coded: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each slice that occurs: its rows' columns, as narrow as they can be. The first `coded` ones are places in words, of which a slice gets those that it has."""
    order = np.argsort(slices, kind="stable")
    own, starts = np.unique(slices[order], return_index=True)
    place, rows = np.zeros(len(words), np.int64), []
    for k, at in zip(own.tolist(), np.split(order, starts[1:]), strict=True):
        cut = [c[at] for c in columns]
        there = np.zeros(len(words), bool)
        for c in cut[:coded]:
            there[c] = True
        there = np.flatnonzero(there)
        place[there] = np.arange(len(there))
        cut[:coded] = [place[c] for c in cut[:coded]]
        rows.append((k, len(at), words[there].tobytes(), *(c.astype(np.min_scalar_type(int(c.max()))).tobytes() for c in cut)))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * (len(names) - 2)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _of_cells(cells: pa.Table, coded: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words, columns) of the cells of one slice."""
    columns = [c.to_pylist() for c in cells.columns[1:]]
    sizes, own = columns[0], [np.frombuffer(x, np.int64) for x in columns[1]]
    words, place = np.unique(np.concatenate(own), return_inverse=True)
    before = np.repeat(np.cumsum([0, *map(len, own)])[:-1], sizes)
    read = lambda c: np.concatenate([np.frombuffer(x, f"u{len(x) // n}").astype(np.int64) for x, n in zip(c, sizes, strict=True)])
    return words, [place[read(c) + before] if k < coded else read(c) for k, c in enumerate(columns[2:])]


#: Columns of cells: runs where they were read, and with what their token's counts are.
_RUNS, _COUNTED = ["slice", "rows", "words", "h2", "h1", "token", "group", "n"], ["slice", "rows", "words", "h2", "h1", "group", "n", "c1", "c2", "c3"]


def _schema(names: list[str]) -> str:
    return ", ".join(f"{n} {'int' if k < 2 else 'binary'}" for k, n in enumerate(names))


def _dealt(first: np.ndarray, second: np.ndarray, words: np.ndarray, hot: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each row: by its first word, or by both if that is a hot one."""
    spread = np.isin(words, hot)[first]
    mixed = words[first].astype(np.uint64) ^ np.where(spread, words[second].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
    return ((mixed >> np.uint64(7)) % np.uint64(slices)).astype(np.int32)


def _by_token(batches, codes: dict, hot: np.ndarray, slices: int, most: int):
    """Cells of the runs in texts (group, ids), ids being hashes behind two that stand for START, counted for `most` tokens at once."""

    def counted(ids, inside, group):
        words, place = np.unique(ids, return_inverse=True)
        at = np.flatnonzero(inside)
        if not len(at):
            return
        columns = [place[at - 2], place[at - 1], place[at], group[at]]
        order, starts = _sorted_rows([columns[2], columns[1], columns[0], columns[3]], [len(words)] * 3 + [len(codes)])
        first = order[starts[-1]]
        columns = [c[first] for c in columns] + [np.diff(np.r_[starts[-1], len(order)])]
        yield _cells(_RUNS, _dealt(columns[2], columns[1], words, hot, slices), words, 3, columns)

    held: list[list[np.ndarray]] = []
    for b in batches:
        lists = b.column("ids")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        inside = np.ones(sizes.sum(), bool)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        inside[starts] = inside[starts + 1] = False
        group = np.repeat(np.array([codes.get(v, 0) for v in b.column("group").to_pylist()], np.int32), sizes)
        held.append([lists.flatten().to_numpy(zero_copy_only=False), inside, group])
        while sum(len(h[0]) for h in held) > most:
            ids, inside, group = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from counted(ids[:most], inside[:most], group[:most])
            rest = [ids[most - 2 :], inside[most - 2 :].copy(), group[most - 2 :]]  # two tokens stand before the next one
            rest[1][:2] = False
            held = [rest]
    if held:
        yield from counted(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _by_history(cells: pa.Table, groups: int, train: int, hot: np.ndarray, c1_of_hot: np.ndarray, slices: int) -> pa.Table:
    """The runs of one slice of tokens, with how often the token and its pair occur in training, dealt by the token before."""
    words, (h2, h1, token, group, n) = _of_cells(cells, 3)
    order, (tokens, pairs, threes, rows) = _sorted_rows([token, h1, h2, group], [len(words)] * 3 + [groups])
    first, n = order[rows], np.add.reduceat(n[order], rows)
    h2, h1, token, group = h2[first], h1[first], token[first], group[first]
    own = n * (group == train)
    c1, c2, c3 = (_per_row(own, np.searchsorted(rows, s)) for s in (tokens, pairs, threes))
    if len(hot):
        at = np.minimum(np.searchsorted(hot, words[token]), len(hot) - 1)
        c1 = np.where(hot[at] == words[token], c1_of_hot[at], c1)
    return pa.Table.from_batches([_cells(_COUNTED, _dealt(h1, h2, words, hot, slices), words, 2, [h2, h1, group, n, c1, c2, c3])])


def _nats(cells: pa.Table, train: int, hot: np.ndarray, b2_of_hot: np.ndarray, total: float, weight: float, counts: np.ndarray, places: np.ndarray) -> pa.Table:
    """(group, place, nats): sums over one slice of histories. places: that of the bucket of each count in counts; 0 is that of tokens unseen in training."""
    words, (h2, h1, group, n, c1, c2, c3) = _of_cells(cells, 2)
    order, (ones, twos) = _sorted_rows([h1, h2], [len(words)] * 2)
    h1, group, n, c1, c2, c3 = (x[order] for x in (h1, group, n, c1, c2, c3))
    own = n * (group == train)
    b2, b3 = _per_row(own, ones), _per_row(own, twos)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, words[h1]), len(hot) - 1)
        b2 = np.where(hot[at] == words[h1], b2_of_hot[at], b2)
    p = (c1 + 1.0) / total
    for c, b in ((c2, b2), (c3, b3)):
        p = np.where(b == 0, p, weight * c / np.maximum(b, 1) + (1 - weight) * p)
    place = np.zeros(len(c1), np.int64)
    seen = c1 > 0
    place[seen] = places[np.searchsorted(counts, c1[seen])]
    wide = int(places.max(initial=0)) + 1
    sums = np.bincount(group * wide + place, -np.log(p) * n)
    there = np.unique(group * wide + place)
    return pa.table({"group": pa.array(there // wide, pa.int32()), "place": pa.array(there % wide, pa.int32()), "nats": pa.array(sums[there])})


def _hashed(tokens: DataFrame) -> int:
    """A seed by which no two of the tokens (token), nor one and START, have the same hash."""
    own = tokens.select("token").union(tokens.sparkSession.createDataFrame([(START,)], "token string")).distinct()
    seed = 0
    while True:
        n = own.agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(F.lit(seed), "token")).alias("h")).first()
        if n["n"] == n["h"]:
            return seed
        seed += 1


def bucketed(docs: DataFrame, by: str, train: str, pattern: str = BASE, text: str = "text", weight: float = WEIGHT, edges: tuple[int, ...] = RANK_BUCKETS, most: int = SLICE) -> DataFrame:
    """(by, bucket, n, nats, bytes): sums of scored() by the rank's bucket over whole documents, which are split twice.

    Tokens are counted first. Then runs, as arrays of hashes that were checked to be different, are counted where they are read, `most` tokens at
    once, and dealt to slices by their token, where the counts of tokens, pairs and runs are known; and again by the token before it, where
    those of histories are. There are as many slices as hold about `most` tokens each. Tokens that are more than a quarter of that are dealt by
    their pairs; their own counts, which no slice then has, are handed to all.
    """
    spark = docs.sparkSession
    with Scratch(spark, "losses") as scratch:
        split = docs.select(F.col(by).alias("group"), T.chunks(F.col(text), pattern).alias("_c"))
        rows = split.select("group", F.size("_c").alias("_k"), F.posexplode("_c").alias("_p", "token"))
        counts = scratch.staged(rows.groupBy("group", "token").agg(F.count("*").alias("n"), F.count_if(F.col("_p") == F.col("_k") - 1).alias("ends")), "counts")
        own = F.col("group") == F.lit(train)
        one, size, kinds = _ranked(scratch, counts.where(own).groupBy("token").agg(F.sum("n").alias("n")))
        seed = _hashed(counts)
        hashed = lambda c: F.xxhash64(F.lit(seed), c)
        sums = counts.groupBy("token").agg(F.sum("n").alias("n"), *[F.sum(F.when(own, F.col(c)).otherwise(0)).alias(a) for c, a in (("n", "c1"), ("ends", "ends"))])
        groups = [r[0] for r in counts.select("group").distinct().collect()]  # as many as there are splits
        total, texts = counts.agg(F.sum("n"), F.sum(F.when(own, F.col("ends")))).first()
        slices = max(1, math.ceil((total or 0) / most))
        hot = {r.h: (r.c1, r.c1 - r.ends) for r in sums.where((F.col("n") * 4 > most) | (F.col("token") == START)).select(hashed(F.col("token")).alias("h"), "c1", "ends").collect()}  # at most 4 a slice
        start = spark.range(1).select(hashed(F.lit(START))).first()[0]
        before = hot.get(start, (0, 0))
        hot[start] = (before[0], before[1] + (texts or 0))  # each text begins behind it
        hots, c1_of_hot, b2_of_hot = (np.array(x, np.int64) for x in zip(*sorted((h, *c) for h, c in hot.items()), strict=True))
        ranked = sorted((r.c1, r["rank"]) for r in one.select("c1", "rank").distinct().collect())  # distinct counts, of which there are few
        sizes, places = (np.array(x, np.int64) for x in (zip(*ranked, strict=True) if ranked else ((), ())))
        places = np.searchsorted(np.array(edges), places, "right") + 1
        codes, wide = {v: k for k, v in enumerate(groups)}, max(1, len(groups))
        own_code, sum_of_all = codes.get(train, -1), float(size + kinds + 1)

        ids = split.select("group", F.concat(F.array(hashed(F.lit(START)), hashed(F.lit(START))), F.transform("_c", hashed)).alias("ids"))
        runs_of = ids.mapInArrow(lambda batches: _by_token(batches, codes, hots, slices, most), _schema(_RUNS))
        known = runs_of.groupBy("slice").applyInArrow(lambda t: _by_history(t, wide, own_code, hots, c1_of_hot, slices), _schema(_COUNTED))
        losses = known.groupBy("slice").applyInArrow(lambda t: _nats(t, own_code, hots, b2_of_hot, sum_of_all, weight, sizes, places), "group int, place int, nats double")
        found = losses.groupBy("group", "place").agg(F.sum("nats").alias("nats")).collect()  # a row for each split and bucket
        labels = [-1, None, *edges]
        kind = docs.schema[by].dataType.simpleString()
        nats = spark.createDataFrame([(groups[r.group], labels[r.place], 0, r.nats, 0) for r in found], f"`{by}` {kind}, bucket int, n long, nats double, bytes long")
        sums = counts.join(small_side(one), "token", "left").select(F.col("group").alias(by), bucket(F.col("rank"), edges).alias("bucket"), "n", F.lit(0.0).alias("nats"), (F.octet_length("token") * F.col("n")).alias("bytes"))
        return checkpointed(sums.union(nats).groupBy(by, "bucket").agg(*[F.sum(c).alias(c) for c in ("n", "nats", "bytes")]))

def by_rank(losses: DataFrame, by: str, edges: tuple[int, ...] = RANK_BUCKETS) -> DataFrame:
    """(bucket, by, tokens, bytes, bits_per_byte) of scored() tokens, or of their sums by bucketed()."""
    at = F.col("bucket") if "bucket" in losses.columns else bucket(F.col("rank"), edges)
    g = losses.groupBy(at.alias("bucket"), by).agg(F.sum("n").alias("tokens"), F.sum("bytes").alias("bytes"), F.sum("nats").alias("nats"))
    return g.select("bucket", by, "tokens", "bytes", (F.col("nats") / F.log(F.lit(2.0)) / F.col("bytes")).alias("bits_per_byte"))
