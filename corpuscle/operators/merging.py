"""Training of byte pairs over many tasks: several merges a round, chosen so that they are the ones that training pair by pair would make.

Distinct chunks are dealt to blocks, rows of arrays of some megabytes, which stay where they are: no task holds all. The driver keeps
the pairs whose count is at least a floor, with an upper bound for each: once the younger of its two tokens is made, a pair's count
only falls, so a pair that is born below the floor never counts before the floor is lowered by a full count.

A round looks at the pairs with the highest bounds. One pass over the blocks gives their exact counts, how often one overlaps another,
and how often their most frequent neighbour stands beside them, which no pair that their merge brings about can exceed. From
the first on, a pair is taken while nothing can come before it: no pair that a merge of this round makes, no pair passed over
(it overlaps one that was taken, which may have lowered it by no more than these overlaps), and no pair outside the list. A second pass merges all
that were taken, which overlap nowhere, and sums what pairs are new. Ties go by the tokens' ids, as ever. A pair of a token with itself is merged alone.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch
from corpuscle.operators.bpe import _ARROW, BYTES, MERGES, Rules, _Book, _frame, _Trainer, collected

#: Bytes of chunks in a block; pairs that the driver keeps at least, where there are as many; pairs that a round looks at.
BLOCK, HOT, LOOK = 2 << 20, 100_000, 1024
WIDE = 1 << 32

_BLOCK = "block long, tokens binary, sizes binary, weights binary, born binary, sums binary"
_NAMES = ["block", "tokens", "sizes", "weights", "born", "sums"]


def _row(block: int, tokens: np.ndarray, sizes: np.ndarray, weights: np.ndarray, born: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    columns = (tokens.astype("<i4"), sizes.astype("<i4"), weights.astype("<i8"), born.astype("<i8"), sums.astype("<i8"))
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], _NAMES)


def _read(b: pa.RecordBatch):
    """(block, tokens, sizes, weights) of each row."""
    for block, tokens, sizes, weights in zip(*(b.column(c).to_pylist() for c in _NAMES[:4]), strict=True):
        yield block, np.frombuffer(tokens, "<i4").astype(np.int64), np.frombuffer(sizes, "<i4").astype(np.int64), np.frombuffer(weights, "<i8")


def _blocks(batches):
    """Chunks (chunk, n) as blocks of byte tokens. Chunks of one byte have no pairs and stay out."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 32, [], 0

    def block():
        data, sizes, n = (np.concatenate(x) for x in zip(*held, strict=True))
        keep = sizes > 1
        return _row(number, data[np.repeat(keep, sizes)], sizes[keep], n[keep], np.zeros(0), np.zeros(0))

    for b in batches:
        chunk = b.column("chunk").cast(pa.binary())
        data = np.frombuffer(b"".join(chunk.to_pylist()), np.uint8)
        held.append((data, pc.binary_length(chunk).to_numpy(zero_copy_only=False).astype(np.int64), b.column("n").to_numpy(zero_copy_only=False)))
        size += len(data)
        if size >= BLOCK:
            yield block()
            number, held, size = number + 1, [], 0
    if held:
        yield block()


class _Places:
    """A block's adjacent tokens: at[k] and at[k] + 1 are in one chunk."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, weights: np.ndarray):
        self.tokens, self.sizes = tokens, sizes
        self.weight = np.repeat(weights, sizes)
        self.last = np.zeros(len(tokens), bool)
        self.last[np.cumsum(sizes) - 1] = True
        self.keys = np.full(len(tokens), -1, np.int64)  # of the pair that begins at each place
        at = np.flatnonzero(~self.last)
        self.keys[at] = tokens[at] * WIDE + tokens[at + 1]

    def found(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places where one of the wanted pairs, sorted, begins; which)."""
        which = np.minimum(np.searchsorted(wanted, self.keys), len(wanted) - 1)
        at = np.flatnonzero(wanted[which] == self.keys)
        return at, which[at]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, which = np.unique(keys, return_inverse=True)
    return names, np.bincount(which, weights, len(names)).astype(np.int64)


def _pair_sums(batches):
    for b in batches:
        for _, *rest in _read(b):
            p = _Places(*rest)
            at = np.flatnonzero(p.keys >= 0)
            keys, sums = _summed(p.keys[at], p.weight[at])
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(sums[i : i + 100_000])], ["pair", "n"])


def _looked(wanted: np.ndarray):
    """Of each block, for the wanted pairs: kind 0, count (other: -1); kind 1, the count of the most frequent token on the left (other: the least
    such token); kind 2, on the right; kind 3, places where the pair's second token is the first of the other wanted pair."""

    def run(batches):
        for b in batches:
            for _, *rest in _read(b):
                p = _Places(*rest)
                at, which = p.found(wanted)
                if not len(at):
                    continue
                w = p.weight[at]
                rows = [(np.zeros(len(wanted), np.int64), np.arange(len(wanted)), np.full(len(wanted), -1), np.bincount(which, w, len(wanted)).astype(np.int64))]
                first = np.zeros(len(p.tokens), bool)
                first[np.cumsum(p.sizes) - p.sizes] = True
                for kind, inside, step in ((1, ~first[at], -1), (2, ~p.last[at + 1], 2)):
                    side, of = at[inside], which[inside]
                    names, sums = _summed(of * WIDE + p.tokens[side + step], w[inside])
                    if not len(names):
                        continue
                    starts = np.flatnonzero(np.r_[True, names[1:] // WIDE != names[:-1] // WIDE])
                    rows.append((np.full(len(starts), kind), names[starts] // WIDE, names[starts] % WIDE, np.maximum.reduceat(sums, starts)))
                place = np.full(len(p.tokens) + 1, -1, np.int64)
                place[at] = which
                both = place[at + 1] >= 0
                names, sums = _summed(which[both] * WIDE + place[at + 1][both], w[both])
                rows.append((np.full(len(names), 3), names // WIDE, names % WIDE, sums))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows, strict=True)], ["kind", "pair", "other", "n"])

    return run


def _merge(pairs: list[tuple[int, int]], first: int):
    """Blocks with all pairs merged, to tokens from `first` on, and the sums of the pairs that the new tokens are in."""
    order = sorted(range(len(pairs)), key=lambda k: pairs[k])
    wanted = np.array([pairs[k][0] * WIDE + pairs[k][1] for k in order], np.int64)
    made = np.array([first + k for k in order], np.int64)
    itself = len(pairs) == 1 and pairs[0][0] == pairs[0][1]

    def run(batches):
        for b in batches:
            for block, tokens, sizes, weights in _read(b):
                p = _Places(tokens, sizes, weights)
                at, which = p.found(wanted)
                if itself and len(at):  # of overlapping places in a run every other one, from the left
                    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
                    odd = (np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))) % 2 == 0
                    at, which = at[odd], which[odd]
                tokens = tokens.copy()
                tokens[at] = made[which]
                keep = np.ones(len(tokens), bool)
                keep[at + 1] = False
                word = np.repeat(np.arange(len(sizes)), sizes)
                sizes = sizes - np.bincount(word[at], minlength=len(sizes))
                tokens = tokens[keep]
                long = sizes > 1
                tokens, sizes, weights = tokens[np.repeat(long, sizes)], sizes[long], weights[long]
                p = _Places(tokens, sizes, weights)
                here = np.flatnonzero(p.keys >= 0)
                here = here[(tokens[here] >= first) | (tokens[here + 1] >= first)]
                yield _row(block, tokens, sizes, weights, *_summed(p.keys[here], p.weight[here]))

    return run


def _born(batches):
    for b in batches:
        for keys, sums in zip(b.column("born").to_pylist(), b.column("sums").to_pylist(), strict=True):
            keys, sums = np.frombuffer(keys, "<i8"), np.frombuffer(sums, "<i8")
            for i in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 100_000]), pa.array(sums[i : i + 100_000])], ["pair", "n"])


class _Looked:
    """What a pass found out about the pairs looked at, in their order."""

    def __init__(self, n: int, rows):
        self.count = np.zeros(n, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.least_left = np.full(n, WIDE, np.int64)
        self.behind: dict[int, dict[int, int]] = {}  # pair -> pairs that begin at its second token -> places
        for kind, pair, other, n_places, least in rows:
            if kind == 0:
                self.count[pair] = n_places
            elif kind == 1:
                self.left[pair], self.least_left[pair] = n_places, least
            elif kind == 2:
                self.right[pair] = n_places
            else:
                self.behind.setdefault(pair, {})[other] = n_places


def taken(pairs: list[tuple[int, int]], seen: _Looked, limit: tuple[int, int], room: int) -> list[int]:
    """Which of the pairs looked at, in order, are the next merges that training one by one would make. limit: (-count, pair) that no pair outside the list comes before."""
    order = sorted((k for k in range(len(pairs)) if seen.count[k] > 0), key=lambda k: (-seen.count[k], pairs[k]))
    out: list[int] = []
    first_of: dict[int, list[int]] = {}
    second_of: dict[int, list[int]] = {}
    passed = highest = 0  # the greatest counts of pairs passed over, and of new pairs with the new token on the left, which lose a tie
    on_right: list[tuple[int, int]] = []  # the same with the new token on the right, which win a tie if their left token is a lesser one
    for k in order:
        a, b = pairs[k]
        n = int(seen.count[k])
        if (-n, a * WIDE + b) >= limit or len(out) >= room:
            break
        if out and (n <= passed or n < highest or any(n < m or (n == m and low < a) for m, low in on_right)):
            break
        if a == b:
            return out or [k]
        before, behind = second_of.get(a, ()), first_of.get(b, ())
        if before or behind:
            lost = max(sum(seen.behind.get(j, {}).get(k, 0) for j in before), sum(seen.behind.get(k, {}).get(j, 0) for j in behind))
            passed = max(passed, n - lost)
            continue
        out.append(k)
        first_of.setdefault(a, []).append(k)
        second_of.setdefault(b, []).append(k)
        highest = max(highest, int(seen.right[k]))
        on_right.append((int(seen.left[k]), int(seen.least_left[k])))
    return out


#: Behind all pairs.
END = (0, -1)


class _Rounds:
    """The state between rounds: blocks, and the pairs kept with their bounds. A pair is kept if it comes before the floor, (-count, pair)."""

    def __init__(self, chunks: DataFrame, book: _Book, scratch: Scratch, hot: int, look: int):
        self.book, self.scratch, self.hot, self.look = book, scratch, hot, look
        tasks = chunks.sparkSession.sparkContext.defaultParallelism
        self.blocks = scratch.staged(chunks.select("chunk", "n").where("chunk is not null").repartition(tasks).mapInArrow(_blocks, _BLOCK), "blocks")
        self.rounds = 0
        self._counted()

    def left(self) -> int:
        """Tokens in the blocks."""
        return (self.blocks.agg(F.sum(F.length("tokens"))).first()[0] or 0) // 4

    def _counted(self) -> None:
        """Pairs counted anew: the first ones, and the floor, which is the first that isn't kept."""
        sums = self.blocks.select(*_NAMES[:4]).mapInArrow(_pair_sums, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0")
        rows = sums.orderBy(F.desc("n"), "pair").limit(self.hot + 1).collect()
        self.floor = (-rows[self.hot].n, rows[self.hot].pair) if len(rows) > self.hot else END
        self._kept([(-r.n, r.pair) for r in rows[: self.hot]])

    def _kept(self, rows: list[tuple[int, int]]) -> None:
        """Keeps pairs (-count, pair). If none of them may be merged, more are kept, as counting anew would give the same."""
        self.bound = {pair: -n for n, pair in rows if self.book.allows(*divmod(pair, WIDE))}
        self.heap = [(-n, k) for k, n in self.bound.items()]
        heapq.heapify(self.heap)
        if not self.bound and self.floor != END:
            self.hot *= 2
            self._counted()

    def _keep(self, pair: int, n: int) -> None:
        if n > 0 and (-n, pair) < self.floor:
            self.bound[pair] = n
            heapq.heappush(self.heap, (-n, pair))
        else:
            self.bound.pop(pair, None)

    def _next(self) -> tuple[int, int] | None:
        """The kept pair with the highest bound that may be merged, as it stands on the heap."""
        while self.heap:
            n, pair = self.heap[0]
            if self.bound.get(pair) == -n:
                if self.book.allows(*divmod(pair, WIDE)):
                    return self.heap[0]
                del self.bound[pair]
            heapq.heappop(self.heap)
        return None

    def natural(self, until: int) -> None:
        """Merges until there are so many tokens."""
        while len(self.book.bytes) < until:
            top: list[int] = []
            while len(top) < self.look and (found := self._next()):
                heapq.heappop(self.heap)
                if not top or found[1] != top[-1]:  # a bound may stand on the heap twice
                    top.append(found[1])
            if top:
                self._round(sorted(set(top)), min(self._next() or END, self.floor), until)
            elif self.floor == END:
                return
            else:
                self._counted()

    def _round(self, top: list[int], limit: tuple[int, int], until: int) -> None:
        self.rounds += 1
        wanted = np.array(top, np.int64)
        rows = self.blocks.select(*_NAMES[:4]).mapInArrow(_looked(wanted), "kind long, pair long, other long, n long")
        rows = rows.groupBy("kind", "pair", F.when(F.col("kind") == 3, F.col("other")).alias("with")).agg(F.sum("n").alias("n"), F.min("other").alias("least")).collect()
        seen = _Looked(len(top), ((r.kind, r.pair, r["with"], r.n, r.least) for r in rows))
        pairs = [divmod(k, WIDE) for k in top]
        chosen = taken(pairs, seen, limit, until - len(self.book.bytes))
        for k, pair in enumerate(top):
            self._keep(pair, int(seen.count[k]))
        if not chosen:  # bounds have fallen, so that the list will be another one
            return
        first = len(self.book.bytes)
        for k in chosen:
            self.book.add(*pairs[k], int(seen.count[k]))
            del self.bound[top[k]]
        before = self.blocks
        self.blocks = self.scratch.staged(before.select(*_NAMES[:4]).mapInArrow(_merge([pairs[k] for k in chosen], first), _BLOCK), "blocks")
        self.scratch.drop(before)
        born = self.blocks.select("born", "sums").mapInArrow(_born, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        for r in born.where(F.col("n") >= max(1, -self.floor[0])).collect():  # of this many occurrences there are few pairs, as of those kept
            self._keep(r.pair, r.n)


#: Merges after which it is looked at again how many tokens are left.
STEP = 128


def _trained_on(book: _Book, rules: Rules, vocab_size: int, least: int):
    """Merges made in one task, from blocks as they stand after those in a book."""

    def run(batches):
        held = [[], [], []]
        for b in batches:
            for kept, c, kind in zip(held, _NAMES[1:4], ("<i4", "<i4", "<i8"), strict=True):
                kept.extend(np.frombuffer(x, kind) for x in b.column(c).to_pylist())
        if held[0]:
            tokens, sizes, weights = (np.concatenate(x) for x in held)
            held.clear()
            trainer = _Trainer(tokens, sizes.astype(np.int64), weights, rules, book, least)
            yield from pa.Table.from_pandas(_frame(trainer.book.run(trainer.natural, vocab_size)), preserve_index=False).cast(_ARROW).to_batches()

    return run


def train_in_rounds(chunks: DataFrame, vocab_size: int, rules: Rules = Rules(), hot: int = HOT, look: int = LOOK, most: int = 0, least: int = 1) -> tuple[DataFrame, int]:
    """(the merge table, the number of rounds): the merges of bpe.train, made over blocks of chunks (chunk, n) that no task holds together. most: tokens in
    chunks of more than one; when so few are left, one task goes on with them, from the merges made until then. 0: never. least: that of bpe.train."""
    spark = chunks.sparkSession
    book = _Book(rules)
    vocab_size = max(vocab_size, BYTES)
    with Scratch(spark, "merging") as scratch:
        rounds = _Rounds(chunks, book, scratch, hot, look)
        until = max(BYTES, vocab_size - len(rules.forced))
        left = rounds.left() if most else 0
        while left > most > 0 and len(book.bytes) < until:
            before = len(book.bytes)
            rounds.natural(min(until, before + STEP))
            if len(book.bytes) == before:
                break
            left = rounds.left()
        if 0 < left <= most:
            made = collected(rounds.blocks.select(*_NAMES[:4]).repartition(1).mapInArrow(_trained_on(book, rules, vocab_size, least), MERGES))
        else:
            made = book.run(rounds.natural, vocab_size)
    return (spark.createDataFrame(_frame(made), MERGES) if made else spark.createDataFrame([], MERGES)), rounds.rounds
