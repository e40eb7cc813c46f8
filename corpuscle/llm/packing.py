"""Best-fit packing of documents into fixed token sequences by large-item matching.

Documents longer than a sequence are cut into full pieces and a rest; nothing else is cut. Only the histogram of piece lengths,
with at most as many rows as a sequence has tokens, decides the packing. Lengths above a third of the capacity are matched: at
most two of them fit into one sequence, and the longest takes the longest partner that fits. Smaller lengths, longest first, go
to the fullest sequence that still has room. The plan is a list of runs (so many sequences alike), whose number doesn't grow
with the number of documents; pieces of one length are interchangeable, so a piece finds its place by its rank among them.

Null texts count as empty: a document is then one piece with the end id alone. Rows that repeat are packed each. A null doc_id is
kept. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, checkpointed
from corpuscle.llm.encoding import piece_table
from corpuscle.llm.neardup import blocks

CAPACITY = 4096


class _Gaps:
    """Open runs of sequences by the room that each of a run's sequences has left."""

    def __init__(self):
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, list]]] = {}

    def add(self, room: int, count: int, items: list) -> None:
        if count:
            if room not in self.runs:
                insort(self.rooms, room)
                self.runs[room] = []
            self.runs[room].append((count, items))

    def take(self, least: int) -> tuple[int, int, list] | None:
        """A run of the smallest room that is at least so large."""
        i = bisect_left(self.rooms, least)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        count, items = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room], self.rooms[i]
        return room, count, items


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs (number of sequences, [(length, how many of it), ...]) that hold every piece of the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    gaps = _Gaps()
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        i = bisect_left(large, capacity - n + 1) - 1  # the longest partner that fits
        if i < 0:
            gaps.add(capacity - n, left[n], [(n, 1)])
            large.pop()
            continue
        m = large[i]
        count = left[n] // 2 if m == n else min(left[n], left[m])
        if not count:  # a last one of its length, with itself as the longest partner
            if i == 0:
                gaps.add(capacity - n, 1, [(n, 1)])
                large.pop()
                continue
            m, count = large[i - 1], 1
        gaps.add(capacity - n - m, count, [(n, 2)] if m == n else [(n, 1), (m, 1)])
        for k in (n, m):
            left[k] -= count
        large = [k for k in large if left[k]] if not (left[n] and left[m]) else large
    for n in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        c = left[n]
        while c:
            room, count, items = gaps.take(n) or (capacity, c, [])
            each = min(room // n, c)
            full = min(count, c // each)
            gaps.add(room - each * n, full, [*items, (n, each)])
            gaps.add(room, count - full if items else 0, items)
            c -= full * each
    return [run for room in gaps.rooms for run in gaps.runs[room]]


def placed(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Of each length: ranks that begin a stretch, and the stretch's first sequence, pieces a sequence, and offset there."""
    out: dict[int, list] = {}
    ranks: dict[int, int] = {}
    first = 0
    for count, items in runs:
        offset = 0
        for n, each in items:
            out.setdefault(n, []).append((ranks.get(n, 0), first, each, offset))
            ranks[n] = ranks.get(n, 0) + count * each
            offset += n * each
        first += count
    return {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in out.items()}


def cut(ids: bytes, capacity: int) -> list[bytes]:
    return [ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)]


def _pieces(path: str, leading: bool, end_id: int, capacity: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])]

    def run(batches):
        table, end = piece_table(path, leading), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            texts, docs = [t or "" for t in b.column("text").to_pylist()], b.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for i, j in blocks(texts, 1 << 22):
                for d, ids in zip(docs[i:j], table.ids(texts[i:j]), strict=True):
                    for k, piece in enumerate(cut(ids + end, capacity)):
                        n = len(piece) // 4
                        seen[n] = seen.get(n, -1) + 1
                        rows.append((d, k, k * capacity, n, zlib.crc32(piece), part, seen[n], piece))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[: len(names)], kinds[: len(names)], strict=True)], names)

    return run


def packed(docs: DataFrame, path: str, leading: bool = False, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, as little-endian 32-bit bytes)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids binary" * with_ids
    with Scratch(docs.sparkSession, "packing") as scratch:
        pieces = scratch.staged(docs.select("doc_id", "text").mapInArrow(_pieces(path, leading, end_id, capacity, with_ids), schema), "pieces")
        # Ranks within a task become ranks within a length; the counts have a row for each task and length, so they are joined by a shuffle.
        counts = scratch.staged(pieces.groupBy("length", "part").agg((F.max("rank") + 1).alias("n")), "counts")
        histogram = dict(counts.groupBy("length").agg(F.sum("n").alias("n")).collect())  # at most `capacity` rows
        places = placed(plan(histogram, capacity))
        before = counts.withColumn("before", F.expr("sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding)")).select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
        ranked = pieces.hint("merge").join(before, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
        return checkpointed(_placed_rows(ranked, places, with_ids))


def _placed_rows(ranked: DataFrame, places: dict[int, tuple[np.ndarray, ...]], with_ids: bool) -> DataFrame:
    """Pieces with their sequence and offset, by their rank among those of their length."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches):
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
                if len(some):
                    ranks, first, each, offset = places[int(n[some[0]])]
                    k = np.searchsorted(ranks, rank[some], side="right") - 1
                    at = rank[some] - ranks[k]
                    seq[some], off[some] = first[k] + at // each[k], offset[k] + at % each[k] * n[some[0]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    out = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(place, out)
