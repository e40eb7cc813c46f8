"""Byte pairs with dropout: merges left out by lot, for each occurrence of a chunk anew, yet alike whenever the same documents are encoded.

Whether a merge is left out follows from a hash of the seed, the document, the place of its first byte and the merge, so segmentations differ
from occurrence to occurrence and from seed to seed, and a document's doesn't depend on partitions or on other documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions.patterns import BASE
from corpuscle.operators.bpe import Merge, encode_arrays

#: Bytes of text that are encoded at once.
BLOCK = 4 << 20


def _lot(seeds: np.ndarray, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A number between 0 and 1 for each, by the mixing steps of splitmix64."""
    z = seeds.astype(np.uint64) + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ids.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def encoded(docs: DataFrame, merges: list[Merge], share: float, seed: int = 0, pattern: str = BASE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the text, with ids: the tokens of each text, where each merge is left out with the given share. merges: without forced ones. Null texts have no tokens."""
    if not 0 <= share <= 1:
        raise ValueError("share: from 0 to 1")
    if any(m.forced for m in merges):
        raise ValueError("forced merges have no order to be left out by")
    keep = [c for c in docs.columns if c != text]

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column("_c")
        words = lists.flatten().cast(pa.binary())
        row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
        of_byte = np.repeat(row, sizes)
        seeds = b.column("_h").to_numpy(zero_copy_only=False).view(np.uint64)[of_byte]
        bytes_of_row = np.bincount(of_byte, minlength=b.num_rows)
        place = np.arange(len(data)) - np.repeat(np.cumsum(bytes_of_row) - bytes_of_row, bytes_of_row)  # in its own text
        ids, size = encode_arrays(data, sizes, merges, (lambda at, merge: _lot(seeds[at], place[at], merge) < share) if share else None)
        of_row = np.bincount(row, size, b.num_rows).astype(np.int64)
        out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(of_row)].astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), out], [*keep, "ids"])

    def run(batches):
        for b in batches:
            size = np.cumsum(pc.fill_null(b.column("_n"), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < b.num_rows:
                n = max(1, int(np.searchsorted(size[at:], (size[at - 1] if at else 0) + BLOCK, side="right")))
                yield block(b.slice(at, n))
                at += n

    chunks = F.coalesce(T.chunks(F.col(text), pattern), F.array().cast("array<string>"))
    rows = docs.select(*keep, chunks.alias("_c"), F.octet_length(text).cast("long").alias("_n"), F.xxhash64(F.lit(seed), F.col(key)).alias("_h"))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}{', ' if keep else ''}ids array<int>")
