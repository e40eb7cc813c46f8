"""Unigram vocabularies: seed substrings, expectation-maximisation over the segmentations of distinct chunks, pruning, and the best segmentation.

Chunks are counted first, so a round's work follows the distinct chunks. Tasks sum expected counts of pieces over their chunks, Spark adds the sums up, and
the driver holds the pieces alone, of which there are at most as many as seeds. Each character that occurs is a piece and stays one, so
every chunk can be segmented.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch

#: Characters of a piece at most; seeds to each piece wanted; rounds between two prunings; share of pieces that a pruning keeps at least.
LONGEST, SEEDS, ROUNDS, KEEP = 16, 8, 2, 0.75


def seeds(chunks: DataFrame, most: int, longest: int = LONGEST) -> dict[str, float]:
    """Weights of all characters, and of the substrings (of two characters or more, twice or more often) with the greatest product of count and length."""
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("chunk")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("chunk") - i + 1)), lambda k: F.substring(F.col("chunk"), i, k))))
    counted = chunks.where("chunk <> ''").select(F.explode(cuts).alias("piece"), "n").groupBy("piece").agg(F.sum("n").alias("n"))
    letters = {r.piece: float(r.n) for r in counted.where("length(piece) = 1").collect()}  # as many as there are characters
    long = counted.where("length(piece) > 1 and n > 1").orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(max(0, most - len(letters)))
    return letters | {r.piece: float(r.n) for r in long.collect()}


def logs(weights: dict[str, float]) -> dict[str, float]:
    total = math.log(sum(weights.values()))
    return {p: math.log(w) - total for p, w in weights.items() if w > 0}


def _sum(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def lattice(chunk: str, pieces: dict[str, float], longest: int) -> list[list[tuple[int, str, float]]]:
    """For each place the pieces that end there, with where they begin."""
    return [[(i, p, pieces[p]) for i in range(max(0, j - longest), j) if (p := chunk[i:j]) in pieces] for j in range(len(chunk) + 1)]


def expected(chunk: str, pieces: dict[str, float], longest: int) -> tuple[float, dict[str, float]]:
    """(log-likelihood of a chunk, expected counts of pieces over all its segmentations)."""
    ends, n = lattice(chunk, pieces, longest), len(chunk)
    forth, back = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for j in range(1, n + 1):
        for i, _, w in ends[j]:
            forth[j] = _sum(forth[j], forth[i] + w)
    for j in range(n, 0, -1):
        for i, _, w in ends[j]:
            back[i] = _sum(back[i], back[j] + w)
    out: dict[str, float] = {}
    for j in range(1, n + 1):
        for i, p, w in ends[j]:
            out[p] = out.get(p, 0.0) + math.exp(forth[i] + w + back[j] - forth[n])
    return forth[n], out


def best(chunk: str, pieces: dict[str, float], longest: int = LONGEST) -> list[str]:
    """The likeliest segmentation; of equal ones the one whose last pieces are longest. Characters that no piece has stand alone."""
    score, step = [0.0] + [-math.inf] * len(chunk), [0] * (len(chunk) + 1)
    for j, ends in enumerate(lattice(chunk, pieces, longest)):
        for i, _, w in ends:
            if score[i] + w > score[j]:
                score[j], step[j] = score[i] + w, i
        if j and score[j] == -math.inf:
            score[j], step[j] = score[j - 1] - 100.0, j - 1
    out, j = [], len(chunk)
    while j:
        out.append(chunk[step[j] : j])
        j = step[j]
    return out[::-1]


class _Lattices:
    """The lattices of many chunks at once, in arrays: a node stands before and behind each character, an edge is a piece between two nodes.

    Pieces are found by a trie, one step for all places together; sums and maxima go from node to node, one step for all chunks together.
    """

    #: Entries of the trie as a table; larger ones are searched.
    TABLE = 1 << 24

    def __init__(self, pieces: dict[str, float]):
        self.names, self.weights = list(pieces), np.array([*pieces.values(), -100.0])  # the last one: a character that no piece has
        letters = sorted({c for p in self.names for c in p})
        self.wide = len(letters) + 1
        self.codes = np.full(0x110000, len(letters), np.int32)
        self.codes[[ord(c) for c in letters]] = np.arange(len(letters))
        code, steps, ends = {c: k for k, c in enumerate(letters)}, {}, {}
        for k, p in enumerate(self.names):
            at = 0
            for c in p:
                at = steps.setdefault(at * self.wide + code[c], len(steps) + 1)
            ends[at] = k
        self.ends = np.full(len(steps) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        self.keys, self.values = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int32)
        self.table = None
        if len(self.ends) * self.wide <= self.TABLE:
            self.table = np.zeros(len(self.ends) * self.wide, np.int32)
            self.table[self.keys] = self.values
        else:
            order = np.argsort(self.keys)
            self.keys, self.values = self.keys[order], self.values[order]

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """States behind (state, character); 0 if there is none."""
        if self.table is not None:
            return self.table[keys]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], 0)

    def of(self, chunks: list[str], longest: int) -> None:
        """The lattices of these chunks, without empty ones: edges by the level of their last node, by that node, longest first."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        self.points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        code, ends = self.codes[self.points], np.cumsum(sizes)
        chunk = np.repeat(np.arange(len(sizes)), sizes)
        self.first = ends - sizes + np.arange(len(sizes))  # nodes before the first character of each chunk
        self.last = self.first + sizes
        self.nodes = len(code) + len(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(code))  # characters up to the chunk's end
        place, state, found = np.arange(len(code)), np.zeros(len(code), np.int64), []
        for k in range(1, longest + 1):
            state = self._next(state * self.wide + code[place + k - 1]).astype(np.int64)
            piece = self.ends[state]
            hit = (state > 0) & (piece >= 0)
            found.append((place[hit], np.full(int(hit.sum()), k), piece[hit]))
            more = (state > 0) & (left[place] > k)
            place, state = place[more], state[more]
            if not len(place):
                break
        start, size, piece = (np.concatenate(x) for x in zip(*found[::-1], strict=True))
        end = start + size
        reached = np.zeros(len(code) + 1, bool)
        reached[end] = True
        lone = np.flatnonzero(~reached[1:])  # characters behind which no piece ends
        start, end, piece = np.r_[start, lone], np.r_[end, lone + 1], np.r_[piece, np.full(len(lone), len(self.names))]
        self.level = np.zeros(self.nodes, np.int64)  # characters before each node
        self.level[np.delete(np.arange(self.nodes), self.first)] = np.repeat(sizes, sizes) - left + 1
        own = chunk[start]
        start, end = start + own, end + own
        order = np.argsort(self.level[end] * self.nodes + end, kind="stable")
        self.start, self.end, self.piece, self.chunk = start[order], end[order], piece[order], own[order]
        self.weight = self.weights[self.piece]

    def _steps(self, node: np.ndarray):
        """(edges, where each node's begin among them, the nodes) of each level. node: of each edge, in order of levels."""
        groups = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        levels = self.level[node[groups]]
        cuts = [*np.flatnonzero(np.r_[True, levels[1:] != levels[:-1]]).tolist(), len(groups)]
        ends = [*groups.tolist(), len(node)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            edges = slice(ends[i], ends[j])
            yield edges, groups[i:j] - ends[i], node[groups[i:j]]

    @staticmethod
    def _log_sums(x: np.ndarray, groups: np.ndarray) -> np.ndarray:
        most = np.maximum.reduceat(x, groups)
        return most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, np.diff(np.r_[groups, len(x)]))), groups))

    def expected(self, n: np.ndarray) -> tuple[float, np.ndarray]:
        """(log-likelihood of chunks that occur n times each, expected counts of the pieces)."""
        forth, back = np.full(self.nodes, -np.inf), np.full(self.nodes, -np.inf)
        forth[self.first], back[self.last] = 0.0, 0.0
        for edges, groups, nodes in self._steps(self.end):
            forth[nodes] = self._log_sums(forth[self.start[edges]] + self.weight[edges], groups)
        order = np.argsort(self.level[self.start] * self.nodes + self.start, kind="stable")
        start, end, weight = self.start[order], self.end[order], self.weight[order]
        for edges, groups, nodes in reversed(list(self._steps(start))):
            back[nodes] = self._log_sums(back[end[edges]] + weight[edges], groups)
        whole = forth[self.last]
        shares = np.exp(forth[self.start] + self.weight + back[self.end] - whole[self.chunk]) * n[self.chunk]
        return float((n * whole).sum()), np.bincount(self.piece, shares, len(self.names) + 1)[:-1]

    def best(self) -> np.ndarray:
        """The edges of the likeliest segmentations, in order; see best()."""
        score, step = np.full(self.nodes, -np.inf), np.zeros(self.nodes, np.int64)
        score[self.first] = 0.0
        for edges, groups, nodes in self._steps(self.end):
            x = score[self.start[edges]] + self.weight[edges]
            most = np.maximum.reduceat(x, groups)
            at = np.where(x == np.repeat(most, np.diff(np.r_[groups, len(x)])), np.arange(len(x)), len(x))
            score[nodes], step[nodes] = most, edges.start + np.minimum.reduceat(at, groups)
        at, out = self.last, [np.zeros(0, np.int64)]
        while len(at):
            out.append(step[at])
            at = self.start[out[-1]]
            at = at[self.level[at] > 0]
        edges = np.concatenate(out)
        return edges[np.argsort(self.start[edges])]


#: Characters of chunks that are segmented at once.
AT_ONCE = 200_000


def _blocks(batches) -> Iterator[list[pa.RecordBatch]]:
    """Batches with a chunk column, about AT_ONCE bytes of chunks together."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += pc.sum(pc.binary_length(b.column("chunk"))).as_py() or 0
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _counted(batches) -> Iterator[tuple[list[str], np.ndarray]]:
    """Chunks that aren't empty, with their numbers, in parts of about AT_ONCE characters."""
    for held in _blocks(batches):
        rows = [(c, n) for b in held for c, n in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist(), strict=True) if c]
        i, size = 0, 0
        for j, (c, _) in enumerate(rows):
            size += len(c)
            if size >= AT_ONCE or j + 1 == len(rows):
                yield [c for c, _ in rows[i : j + 1]], np.array([n for _, n in rows[i : j + 1]], np.float64)
                i, size = j + 1, 0


def _counts(pieces: dict[str, float], longest: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        lattices, total = _Lattices(pieces), 0.0
        sums = np.zeros(len(pieces))
        for chunks, n in _counted(batches):
            lattices.of(chunks, longest)
            like, own = lattices.expected(n)
            total += like
            sums += own
        there = np.flatnonzero(sums).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([*(lattices.names[k] for k in there), None], pa.string()), pa.array([*sums[there].tolist(), total])], ["piece", "x"])

    return run


def _uses(pieces: dict[str, float], longest: int):
    """How often the best segmentations use each piece."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        lattices = _Lattices(pieces)
        sums = np.zeros(len(pieces) + 1, np.int64)
        for chunks, n in _counted(batches):
            lattices.of(chunks, longest)
            edges = lattices.best()
            np.add.at(sums, lattices.piece[edges], n[lattices.chunk[edges]].astype(np.int64))
        there = np.flatnonzero(sums[:-1]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([lattices.names[k] for k in there], pa.string()), pa.array(sums[there], pa.int64())], ["piece", "x"])

    return run


def train(chunks: DataFrame, size: int, longest: int = LONGEST, rounds: int = ROUNDS, many: int | None = None) -> tuple[dict[str, float], list[tuple[int, float]]]:
    """(log-probabilities of `size` pieces, (pieces, log-likelihood) of each round) learned from chunks (chunk, n). Fewer pieces if there are no more.

    Rounds of expectation-maximisation alternate with prunings, each of which drops the pieces whose loss costs least, a quarter of them at most, until
    so many are left; the last rounds follow. Between two prunings the likelihood never falls.
    """
    with Scratch(chunks.sparkSession, "unigram") as scratch:
        tasks = chunks.sparkSession.sparkContext.defaultParallelism
        own = scratch.staged(chunks.select("chunk", "n").where("chunk <> ''").repartition(tasks), "chunks")
        weights, log = seeds(own, many or SEEDS * size, longest), []
        letters = {p for p in weights if len(p) == 1}
        pieces = logs(weights) if weights else {}
        while pieces:
            for _ in range(rounds):
                rows = own.mapInArrow(_counts(pieces, longest), "piece string, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()
                found = {r.piece: r.x for r in rows}
                log.append((len(pieces), found.pop(None)))
                # A letter stays, be it that longer pieces always win.
                pieces = logs({p: max(found.get(p, 0.0), 1e-12) if p in letters else found.get(p, 0.0) for p in pieces if p in letters or found.get(p, 0.0) > 0})
            if len(pieces) <= size:
                break
            uses = {r.piece: r.x for r in own.mapInArrow(_uses(pieces, longest), "piece string, x long").groupBy("piece").agg(F.sum("x").alias("x")).collect()}
            cost = {}
            for p in pieces.keys() - letters:
                rest = {q: pieces[q] for i in range(len(p)) for j in range(i + 1, len(p) + 1) if (q := p[i:j]) in pieces and q != p}
                cost[p] = uses.get(p, 0) * (pieces[p] - sum(rest[q] for q in best(p, rest, longest)))
            left = max(size, int(KEEP * len(pieces))) - len(letters)
            kept = sorted(cost, key=lambda p: (-cost[p], p))[: max(0, left)]
            pieces = logs({p: math.exp(pieces[p]) for p in (*sorted(letters), *kept)})
        return pieces, log


def encoded(chunks: DataFrame, pieces: dict[str, float], longest: int = LONGEST) -> DataFrame:
    """chunks (chunk, ...) with pieces, their best segmentation. Encode distinct chunks."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields]

    def run(batches):
        lattices = _Lattices(pieces)
        names = pa.array(lattices.names, pa.string())
        for held in _blocks(batches):
            whole = pa.Table.from_batches(held).combine_chunks()
            chunks = whole.column("chunk").to_pylist()
            full = [c for c in chunks if c]
            values, sizes = pa.array([], pa.string()), np.zeros(len(full), np.int64)
            if full:
                lattices.of(full, longest)
                edges = lattices.best()
                piece, alone = lattices.piece[edges], lattices.piece[edges] == len(lattices.names)
                sizes = np.bincount(lattices.chunk[edges], minlength=len(full))
                points = lattices.points[(lattices.start - lattices.chunk)[edges[alone]]]
                piece[alone] += np.arange(len(points))
                values = pa.concat_arrays([names, pa.array([chr(c) for c in points.tolist()], pa.string())]).take(pa.array(piece))
            each = np.zeros(len(chunks), np.int64)
            each[[k for k, c in enumerate(chunks) if c]] = sizes
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(each)].astype(np.int32)), values)
            yield from whole.append_column("pieces", lists).to_batches()

    return chunks.mapInArrow(run, ", ".join([*kinds, "pieces array<string>"]))
