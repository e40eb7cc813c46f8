"""Chunks of shards read as one string each, whose documents are never gathered.

Documents are dealt to ranges of their shard and order. A range is split from the left; its last piece is open, as what follows may
change it: the last chunk, and where that is white space all such chunks before it. The open piece is put before the next range's
first document, and so is a document's own within a range. A range that was split with another piece before it than
it should have been is split again, until every range had the piece that the one before it handed on.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, checkpointed
from corpuscle.functions.patterns import BASE
from corpuscle.ranges import ranged

#: Distinct chunks that a task sums before it sends them on.
HELD = 500_000

_PARTS = "part int, shard string, open string, chunk string, n long"


_SPACE = regex.compile(r"\s+")


def closed(chunks: list[str]) -> int:
    """How many chunks no text behind them can change."""
    k = len(chunks) - 1
    while k > 0 and _SPACE.fullmatch(chunks[k]) and _SPACE.fullmatch(chunks[k - 1]):
        k -= 1
    return max(k, 0)


def _split(pattern: str, carried: dict[tuple[int, str], str], ends: frozenset):
    """Of rows (_part, shard, t) in order: summed chunks of each range and shard, and its open piece. carried: pieces to begin with; ends: ranges behind which their shard ends."""
    find = regex.compile(pattern).findall

    def run(batches):
        now, rest, sums = None, "", Counter()

        def out(last: bool):
            if last and now in ends:
                sums.update(find(rest))
            rows = list(sums.items())
            columns = [[now[0]] * len(rows), [now[1]] * len(rows), [None] * len(rows), [c for c, _ in rows], [n for _, n in rows]]
            if last:
                for c, v in zip(columns, (now[0], now[1], "" if now in ends else rest, None, None), strict=True):
                    c.append(v)
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["part", "shard", "open", "chunk", "n"])

        for b in batches:
            for part, shard, t in zip(*(b.column(c).to_pylist() for c in ("_part", "_shard", "_t")), strict=True):
                if now != (part, shard):
                    if now is not None:
                        yield out(True)
                    now, rest = (part, shard), carried.get((part, shard), "")
                if t:
                    found = find(rest + t)
                    k = closed(found)
                    sums.update(found[:k])
                    rest = "".join(found[k:])
                    if len(sums) >= HELD:
                        yield out(False)
        if now is not None:
            yield out(True)

    return run


def counted_joined(docs: DataFrame, shard: str, pattern: str = BASE, order: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, chunk, n) of each shard's texts in order, read as one string. Null shards are ''."""
    with Scratch(docs.sparkSession, "joined") as scratch:
        rows = docs.select(F.coalesce(F.col(shard), F.lit("")).alias("_shard"), F.col(order).alias("_order"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
        rows = scratch.staged(ranged(rows, "_shard", "_order"), "rows")
        there = sorted((r["_shard"], r["_part"]) for r in rows.select("_shard", "_part").distinct().collect())  # a row for each range, and for each shard that begins inside one
        of_shard = defaultdict(list)
        for s, p in there:
            of_shard[s].append(p)
        ends = frozenset((ps[-1], s) for s, ps in of_shard.items())
        # The first time all ranges begin with nothing; then those that should have begun with a piece.
        carried: dict[tuple[int, str], str] = {}
        done, todo = None, None
        while todo is None or todo:
            some = rows if todo is None else rows.join(F.broadcast(docs.sparkSession.createDataFrame(sorted(todo), "_part int, _shard string")), ["_part", "_shard"], "left_semi")
            some = some.repartition("_part", "_shard").sortWithinPartitions("_part", "_shard", "_order", "_t").select("_part", "_shard", "_t")
            got = scratch.staged(some.mapInArrow(_split(pattern, carried, ends), _PARTS), "parts")
            if done is not None:
                again = docs.sparkSession.createDataFrame(sorted(todo), "part int, shard string")
                done = done.join(F.broadcast(again), ["part", "shard"], "left_anti").select(got.columns).union(got)
            else:
                done = got
            handed = {(r.part, r.shard): r.open for r in done.where("open is not null").select("part", "shard", "open").collect()}
            want = {(p, s): handed[before, s] for s, ps in of_shard.items() for before, p in zip(ps, ps[1:], strict=False)}
            todo = {k for k, v in want.items() if v != carried.get(k, "")}
            carried = carried | {k: want[k] for k in todo}
        return checkpointed(done.where("chunk is not null").groupBy(F.col("shard").alias(shard), "chunk").agg(F.sum("n").alias("n")))
