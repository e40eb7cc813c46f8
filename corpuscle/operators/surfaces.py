"""Surfaces of any script found standing alone: an automaton of all of them at once, read from the left, the longest first."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import byte_size, checkpointed

#: Bytes of surfaces that a task's automaton is made of at most.
AUTOMATON_BYTES = 256 << 20

_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def automaton(surfaces: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for s in surfaces:
        a.add_word(s)
    a.make_automaton()
    return a


def alone(text: str, a) -> list[tuple[int, int]]:
    """(start, end) of what an alternation of the surfaces, the longest first, would match one after another, with no ASCII letter right before or behind."""
    found, size = [], len(text)
    for last, length in a.iter(text):
        start, end = last - length + 1, last + 1
        if (start == 0 or text[start - 1] not in _LETTERS) and (end == size or text[end] not in _LETTERS):
            found.append((start, -length))
    out, free = [], 0
    for start, length in sorted(found):
        if start >= free:
            free = start - length
            out.append((start, free))
    return out


def standalone(docs: DataFrame, surfaces: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of surfaces (word), which may hold marks, spaces and letters of any script: how often each stands alone in the texts. Empty ones don't count."""
    words = checkpointed(surfaces.select("word").where("word <> ''").distinct())
    if (size := byte_size(words)) > AUTOMATON_BYTES:
        raise ValueError(f"the surfaces take {size} bytes, an automaton's are at most {AUTOMATON_BYTES}")
    names = [r.word for r in words.collect()]

    def counted(batches):
        a, sums = automaton(names), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t and names:
                    sums.update(t[i:j] for i, j in alone(t, a))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["word", "n"])

    found = docs.select(F.col(text)).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
