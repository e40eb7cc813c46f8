"""Phrases of neighbouring chunks, mined in two passes: pairs of chunks, then pairs whose left side is a phrase of the first pass.

Texts are split by Spark; tasks number the chunks of a block and sum pairs by array operations, so that no row for a
token leaves them. In the second pass neighbours that are a phrase are fused from the left, so that fused ones don't overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions.patterns import BASE
from corpuscle.operators.morphology import unshadowed

Pair = tuple[str, str]


def _neighbours(left: frozenset, right: frozenset, phrases: tuple[Pair, ...] | None):
    """(l, r, n) of neighbouring chunks whose first is in `left` and second in `right`; with phrases, of a fused phrase and a chunk of `right` behind it."""

    def run(batches):
        for b in batches:
            lists = b.column("c")
            lists = lists.filter(pc.is_valid(lists))
            coded = lists.flatten().dictionary_encode()
            codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
            doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            if len(codes) < 2:
                continue
            k, of = len(names), {s: i for i, s in enumerate(names)}
            chosen = lambda words: np.array([s in words for s in names])
            same = np.flatnonzero(doc[1:] == doc[:-1])
            pair = codes[same] * k + codes[same + 1]
            if phrases is None:
                keep = chosen(left)[codes[same]] & chosen(right)[codes[same + 1]]
                first, second = codes[same][keep], codes[same + 1][keep]
                shown = [(names[i],) for i in range(k)]
            else:
                known = sorted({of[a] * k + of[c] for a, c in phrases if a in of and c in of})
                if not known:
                    continue
                at = same[np.isin(pair, known)]
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])  # of phrases that overlap in a row every other one, from the left
                at = at[(np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))) % 2 == 0] if len(at) else at
                fused = np.zeros(len(codes) + 1, bool)
                fused[at] = True
                at = at[at + 2 < len(codes)]
                # What stands behind is a chunk that is no part of a fused phrase.
                at = at[(doc[at + 2] == doc[at]) & ~fused[at + 2]]
                at = at[chosen(right)[codes[at + 2]]]
                which = np.searchsorted(known, codes[at] * k + codes[at + 1])
                first, second = which, codes[at + 2]
                shown = [(names[p // k] + names[p % k],) for p in known]
            keys, n = np.unique(first * k + second, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([shown[x // k][0] for x in keys.tolist()], pa.string()), pa.array([names[x % k] for x in keys.tolist()], pa.string()), pa.array(n.astype(np.int64))], ["l", "r", "n"])

    return run


def neighbours(docs: DataFrame, left: list[str], right: list[str], phrases: list[Pair] | None = None, pattern: str = BASE, text: str = "text") -> DataFrame:
    """(l, r, n): see _neighbours(). The word lists and the phrases are rules, given by value."""
    rows = docs.select(T.chunks(F.col(text), pattern).alias("c")).mapInArrow(_neighbours(frozenset(left), frozenset(right), None if phrases is None else tuple(phrases)), "l string, r string, n long")
    return rows.groupBy("l", "r").agg(F.sum("n").alias("n"))


def mined(docs: DataFrame, left: list[str], right: list[str], top: int = 150, derived: int = 50, least: int = 2, pattern: str = BASE, text: str = "text") -> DataFrame:
    """(pass, ord, l, r, n): the most frequent pairs of the first pass, then of the second, each without those that an earlier pair of
    its pass which stays shadows. At most `top` and `derived` pairs are looked at, as told."""
    out: list[tuple] = []
    first: list[Pair] | None = None
    for number, most in ((1, top), (2, derived)):
        found = neighbours(docs, left, right, first, pattern, text).where(F.col("n") >= least).orderBy(F.desc("n"), "l", "r").limit(most).collect()
        n = {(r.l, r.r): r.n for r in found}
        stay = unshadowed(list(n))
        out += [(number, k, *p, n[p]) for k, p in enumerate(stay)]
        if first is None:
            first = stay
    return docs.sparkSession.createDataFrame(out, "pass int, ord int, l string, r string, n long")
