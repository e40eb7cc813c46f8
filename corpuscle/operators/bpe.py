"""Byte-pair vocabularies: training with blocked, forced and space rules, encoding, decoding.

A word is a string of tokens: <74> for a byte, <T00042> for the token that merge 42 made. Replacing the text of a pair is
then the left-to-right, non-overlapping merge, and text order of tokens is id order. Few merges are trained as a
DataFrame loop; a vocabulary is trained in one task, by array operations with counts kept up to date, as long as what it is trained on
has no more bytes than MOST_IN_TASK; beyond that, rounds over blocks make the same merges (merging.py), until no more tokens than that are left for a task to go on with.

Chunks are cut into pieces before that, at all places that no merge can cross: two tokens that stand beside each other at a place occur so no more often
than the two bytes do between which the place is. So where these are rarer than the rarest merge made, the place stays a border of
tokens, and a chunk's tokens are those of its pieces. What the rarest merge is shows at the end; if it was taken too high, training begins anew. Of
pieces there are far fewer than chunks, above all of random ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, checkpointed
from corpuscle.functions import text as T

#: Bytes of chunks, or of their pieces, that one task trains on. It holds about 30 times as much.
MOST_IN_TASK = 64 << 20
#: Bytes of chunks that are cut at once.
CUT = 4 << 20
BYTES = 256


@dataclass(frozen=True)
class Rules:
    """Merges that may not be made, and phrases made at the end. Pairs are (left, right) byte strings, in order."""

    blocked: tuple[tuple[bytes, bytes], ...] = ()
    forced: tuple[tuple[bytes, bytes], ...] = ()
    leading_space: bool = False  # no right operand may start with a space, unless the left is all spaces
    trailing_space: bool = False  # no right operand may end with one

    @staticmethod
    def of(blocked=(), forced=(), leading_space: bool = False, trailing_space: bool = False) -> Rules:
        both = lambda pairs: tuple((a.encode(), b.encode()) for a, b in pairs)
        return Rules(both(blocked), both(forced), leading_space, trailing_space)


@dataclass(frozen=True)
class Merge:
    id: int
    left: int
    right: int
    bytes: bytes
    n: int
    forced: bool = False


def word(chunk: Column) -> Column:
    """A chunk as a string of byte tokens."""
    return F.regexp_replace(F.hex(F.encode(chunk, "utf-8")), "(..)", "<$1>")


def tokens(words: Column) -> Column:
    """A word's tokens as an array of strings without brackets."""
    return F.split(F.btrim(words, F.lit("<>")), "><")


def token_name(i: int) -> str:
    return f"{i:02X}" if i < BYTES else f"T{i - BYTES:05d}"


def number(name: str) -> int:
    """The id of a token's name."""
    return BYTES + int(name[1:]) if name.startswith("T") else int(name, 16)


def token_id(name: Column) -> Column:
    return F.when(name.startswith("T"), F.substring(name, 2, 9).cast("int") + BYTES).otherwise(F.conv(name, 16, 10).cast("int"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(a, b, n) of words (w, n): adjacent pairs, overlapping ones too."""
    t = words.select(tokens(F.col("w")).alias("t"), "n").where(F.size("t") > 1)
    pairs = t.select(F.explode(F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"), "n")
    return pairs.groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))


def byte_pairs(chunks: DataFrame) -> DataFrame:
    """pair_counts() of chunks (chunk, n) as bytes: a table of all byte pairs in each task, summed."""

    def counted(batches):
        sums = np.zeros(BYTES * BYTES, np.int64)
        for b in batches:
            chunk, n = b.column("chunk").cast(pa.binary()), b.column("n").to_numpy(zero_copy_only=False)
            data = np.frombuffer(b"".join(x or b"" for x in chunk.to_pylist()), np.uint8)
            sizes = pc.fill_null(pc.binary_length(chunk), 0).to_numpy(zero_copy_only=False)
            if len(data) > 1:
                inside = np.ones(len(data), bool)
                inside[np.cumsum(sizes)[sizes > 0] - 1] = False  # a chunk's last byte begins no pair
                at = np.flatnonzero(inside)
                weights = np.repeat(n, sizes)[at]
                np.add.at(sums, data[at].astype(np.int64) * BYTES + data[at + 1], weights)
        k = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(k // BYTES, pa.int32()), pa.array(k % BYTES, pa.int32()), pa.array(sums[k])], ["a", "b", "n"])

    name = lambda c: F.lpad(F.hex(c), 2, "0").alias(c)
    return chunks.select("chunk", "n").mapInArrow(counted, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).select(name("a"), name("b"), "n")


def top_pair(words: DataFrame):
    """The most frequent pair, of equal ones the least; None if there is none."""
    return pair_counts(words).orderBy(F.desc("n"), "a", "b").limit(1).first()


def merged(words: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return words.withColumn("w", F.replace(F.col("w"), F.lit(f"<{a}><{b}>"), F.lit(f"<{name}>")))


def _allowed(rules: Rules, left: bytes, right: bytes, blocked: set, forced: set, forced_whole: set) -> bool:
    if rules.trailing_space and right.endswith(b" ") and left.strip(b" "):
        return False
    if rules.leading_space and right.startswith(b" ") and left.strip(b" "):
        return False
    return (left, right) not in blocked and (left, right) not in forced and left + right not in forced_whole


class _Book:
    """Tokens and merges made so far, and which pairs may be merged."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.blocked, self.forced = set(rules.blocked), set(rules.forced)
        self.forced_whole = {a + b for a, b in rules.forced}
        self.bytes = [bytes((i,)) for i in range(BYTES)]
        self.merges: list[Merge] = []
        self.rule_of: dict[tuple[int, int], int] = {}

    def copy(self, rules: Rules) -> _Book:
        """The same tokens and merges under other rules."""
        out = _Book(rules)
        out.bytes, out.merges, out.rule_of = list(self.bytes), list(self.merges), dict(self.rule_of)
        return out

    def allows(self, a: int, b: int) -> bool:
        return (a, b) not in self.rule_of and _allowed(self.rules, self.bytes[a], self.bytes[b], self.blocked, self.forced, self.forced_whole)

    def add(self, a: int, b: int, n: int) -> int:
        new = len(self.bytes)
        self.bytes.append(self.bytes[a] + self.bytes[b])
        self.merges.append(Merge(new, a, b, self.bytes[new], n))
        self.rule_of[a, b] = new
        return new

    def force(self, until: int) -> None:
        """Forced pairs in order: skipped if blocked, an operand is missing, or made already; an existing token of the same bytes is reused."""
        known = {b: i for i, b in enumerate(self.bytes)}
        for left, right in self.rules.forced:
            if (left, right) in self.blocked or left not in known or right not in known or (known[left], known[right]) in self.rule_of:
                continue
            whole = left + right
            if whole not in known:
                if len(self.bytes) >= until:
                    break
                known[whole] = len(self.bytes)
                self.bytes.append(whole)
            pair = (known[left], known[right])
            self.rule_of[pair] = known[whole]
            self.merges.append(Merge(known[whole], *pair, whole, 0, True))

    def run(self, natural: Callable[[int], None], vocab_size: int) -> list[Merge]:
        """Room is held for the forced pairs; what they leave is filled by further natural merges. natural(n) merges until there are n tokens."""
        natural(max(BYTES, vocab_size - len(self.rules.forced)))
        if self.rules.forced:
            self.force(vocab_size)
            natural(vocab_size)
        return self.merges


class _Trainer:
    """All words behind one another in arrays: tokens, the places of the tokens before and behind, weights. A merge changes all places of a pair at once.

    A pair is a number (left * WIDE + right); for each there is its count and the places where it stood when it was counted, which
    are checked when it is merged. A heap holds pairs by count; counts that have changed are checked when they come up.
    """

    WIDE = 1 << 32
    #: Places that are sorted by their pairs at once.
    SORTED = 1 << 22

    def __init__(self, data: np.ndarray, sizes: np.ndarray, counts: np.ndarray, rules: Rules, book: _Book | None = None, least: int = 1):
        """data: bytes of words, or their tokens (int32) after the merges in a book. least: pairs that never occur so often are passed over, which is right if no merge is rarer: a pair
        occurs most when the younger of its tokens is made."""
        self.least = least
        self.book = book or _Book(rules)
        n = len(data)
        self.token = data.astype(np.int32)
        left, wide, step = (np.uint16, 1 << 8, self.SORTED) if data.dtype == np.uint8 else (np.int64, self.WIDE, 2 * self.SORTED)
        self.weight = np.repeat(counts.astype(np.int32 if counts.max(initial=0) < 1 << 31 else np.int64), sizes)
        ends = np.cumsum(sizes)
        self.after, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        full = sizes > 0
        self.after[ends[full] - 1] = -1
        self.before[(ends - sizes)[full]] = -1
        self.count: dict[int, int] = {}
        self.where: dict[int, list[np.ndarray]] = {}
        for at in range(0, n, step):
            places = np.flatnonzero(self.after[at : at + step] >= 0).astype(np.int32) + np.int32(at)
            if not len(places):
                continue
            keys = data[places].astype(left) * left(wide) + data[places + 1]
            order = np.argsort(keys, kind="stable")
            places, keys = places[order], keys[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sums = np.add.reduceat(self.weight[places], starts, dtype=np.int64).tolist()
            for name, c, there in zip(keys[starts].tolist(), sums, np.split(places, starts[1:]), strict=True):
                key = (name // wide) * self.WIDE + name % wide
                self.count[key] = self.count.get(key, 0) + c
                self.where.setdefault(key, []).append(there)
        for key in [k for k, c in self.count.items() if c < least]:
            del self.count[key], self.where[key]
        self.heap = [(-c, k) for k, c in self.count.items()]
        heapq.heapify(self.heap)

    def _lost(self, pair: int, n: int) -> None:
        if pair in self.count:
            self.count[pair] -= n

    def _best(self) -> tuple[int, int] | None:
        while self.heap:
            c, key = heapq.heappop(self.heap)
            now = self.count.get(key, 0)
            if now != -c:
                if now > 0:
                    heapq.heappush(self.heap, (-now, key))
            elif now > 0 and self.book.allows(*divmod(key, self.WIDE)):
                return key, now
        return None

    def _sums(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, their weights, which of them stands at each place)."""
        keys, which = np.unique(self.token[places].astype(np.int64) * self.WIDE + self.token[self.after[places]], return_inverse=True)
        return keys, np.bincount(which, self.weight[places], len(keys)).astype(np.int64), which

    #: Places up to which a merge is made by a plain loop, which costs less than array operations do.
    FEW = 300

    def _apply(self, key: int, new: int) -> None:
        a, b = divmod(key, self.WIDE)
        token, after, before = self.token, self.after, self.before
        parts = [np.asarray(p, np.int64) for p in self.where.pop(key)]
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[(token[at] == a) & (after[at] >= 0)]
        at = at[token[after[at]] == b]
        if not len(at):
            self.count.pop(key, None)
            return
        if a != b:
            (self._apply_few if len(at) <= self.FEW else self._apply_many)(a, b, new, at)
            return
        # A token with itself: of overlapping places in a run every other one, from the left.
        first = np.r_[True, after[at[:-1]] != at[1:]]
        starts = np.flatnonzero(first)
        at_all, at = at, at[(np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))) % 2 == 0]
        second = after[at]
        left, right = before[at], after[second]
        gone = np.unique(np.concatenate([at_all, left[left >= 0], second[right >= 0]]))
        keys, sums, _ = self._sums(gone)
        for k, c in zip(keys.tolist(), sums.tolist(), strict=True):
            self._lost(k, c)
        token[at], token[second] = new, -1
        after[at] = right
        before[right[right >= 0]] = at[right >= 0]
        left = before[at]
        made = np.unique(np.concatenate([at[right >= 0], left[left >= 0]]))
        keys, sums, which = self._sums(made)
        made = made[np.argsort(which, kind="stable")]
        ends = np.cumsum(np.bincount(which, minlength=len(keys))).tolist()
        for k, c, i, j in zip(keys.tolist(), sums.tolist(), [0, *ends], ends, strict=False):
            self._born(k, c, made[i:j])
        if not self.count.get(key):
            self.count.pop(key, None)

    def _born(self, pair: int, n: int, places) -> None:
        if n < self.least:
            return
        self.count[pair] = now = self.count.get(pair, 0) + n
        self.where.setdefault(pair, []).append(np.array(places, np.int32))
        heapq.heappush(self.heap, (-now, pair))

    def _apply_many(self, a: int, b: int, new: int, at: np.ndarray) -> None:
        """The pair (a, b) of different tokens merged at its places, all of them, in order."""
        token, after, before, wide, weight = self.token, self.after, self.before, self.WIDE, self.weight

        def grouped(tokens, places):
            """(token, its weight, its places) of each token."""
            sums, n = np.bincount(tokens, weight[places]), np.bincount(tokens)
            there = np.flatnonzero(n)
            order = np.argsort(tokens.astype(np.uint16) if new < 1 << 16 else tokens, kind="stable")
            ends = np.cumsum(n[there]).tolist()
            places = places[order]
            return zip(there.tolist(), sums[there].astype(np.int64).tolist(), (places[i:j] for i, j in zip([0, *ends], ends, strict=False)), strict=True)

        second = after[at]
        right, left = after[second], before[at]
        del self.count[a * wide + b]
        # Where a place follows right behind another the pair between them is taken off once, as a right one.
        own = (left >= 0) & ~np.r_[False, left[1:] == second[:-1]]
        for x, n, _ in grouped(token[left[own]], left[own]):
            self._lost(x * wide + a, n)
        has_right = right >= 0
        for y, n, _ in grouped(token[right[has_right]], at[has_right]):
            self._lost(b * wide + y, n)
        token[at], token[second] = new, -1
        after[at] = right
        before[right[has_right]] = at[has_right]
        left = before[at]
        left = left[left >= 0]
        left = left[token[left] != new]
        for x, n, places in grouped(token[left], left):
            self._born(x * wide + new, n, places)
        own = at[has_right]
        for y, n, places in grouped(token[after[own]], own):
            self._born(new * wide + y, n, places)

    def _apply_few(self, a: int, b: int, new: int, at: np.ndarray) -> None:
        """The pair (a, b) merged at its places, all of them, in order."""
        token, after, before, wide, count = self.token, self.after, self.before, self.WIDE, self.count
        second = after[at]
        right, left = after[second], before[at]
        weights = self.weight[at].tolist()
        del count[a * wide + b]
        rights, lefts = token[right].tolist(), token[left].tolist()
        has_right, has_left = (right >= 0).tolist(), (left >= 0).tolist()
        # A place that follows right behind another: the pair between them is taken off once.
        follows = [False, *(left[1:] == second[:-1]).tolist()]
        for w, x, y, is_left, is_right, follow in zip(weights, lefts, rights, has_left, has_right, follows, strict=True):
            if is_left and not follow and x * wide + a in count:
                count[x * wide + a] -= w
            if is_right and b * wide + y in count:
                count[b * wide + y] -= w
        token[at], token[second] = new, -1
        after[at] = right
        right = right[right >= 0]
        before[right] = at[has_right]
        lefts, rights = token[before[at]].tolist(), token[after[at]].tolist()
        made: dict[int, tuple[list[int], list[int]]] = {}
        for k, left_at, w, x, y, is_left, is_right in zip(at.tolist(), before[at].tolist(), weights, lefts, rights, has_left, has_right, strict=True):
            if is_left and x != new:  # else it is the one before's right
                places, sums = made.setdefault(x * wide + new, ([], []))
                places.append(left_at)
                sums.append(w)
            if is_right:
                places, sums = made.setdefault(new * wide + y, ([], []))
                places.append(k)
                sums.append(w)
        for k, (places, sums) in made.items():
            self._born(k, sum(sums), places)

    def copy(self, rules: Rules, found: tuple[int, int] | None = None) -> _Trainer:
        """The trainer as it stands, to go on by other rules. found: a pair and its count that were taken from the heap and not merged."""
        out = object.__new__(_Trainer)
        out.book, out.least = self.book.copy(rules), self.least
        out.weight = self.weight  # never changed
        out.token, out.after, out.before = self.token.copy(), self.after.copy(), self.before.copy()
        out.count, out.where, out.heap = dict(self.count), {k: list(v) for k, v in self.where.items()}, list(self.heap)
        if found:
            heapq.heappush(out.heap, (-found[1], found[0]))
        return out

    def natural(self, until: int) -> None:
        """Merges until there are so many tokens."""
        while len(self.book.bytes) < until and (found := self._best()):
            self._apply(found[0], self.book.add(*divmod(found[0], self.WIDE), found[1]))


def train_local(chunks: list[bytes], counts: list[int], vocab_size: int, rules: Rules = Rules()) -> list[Merge]:
    data, sizes = np.frombuffer(b"".join(chunks), np.uint8), np.fromiter(map(len, chunks), np.int64, len(chunks))
    trainer = _Trainer(data, sizes, np.array(counts, np.int64), rules)
    return trainer.book.run(trainer.natural, vocab_size)


def pair_sums(chunks: DataFrame) -> np.ndarray:
    """How often each byte stands behind each other one in chunks (chunk, n): 65,536 numbers."""
    sums = np.zeros(BYTES * BYTES, np.int64)
    for r in byte_pairs(chunks).collect():
        sums[int(r.a, 16) * BYTES + int(r.b, 16)] = r.n
    return sums


def mergeable(sums: np.ndarray, least: int, rules: list[Rules] = ()) -> np.ndarray:
    """For each pair of bytes whether a merge made at least so often may have its border between them. Borders of forced pairs stay; one before a space only if all rules let it."""
    out = sums >= max(1, least)
    if rules and all(r.leading_space for r in rules):
        out[np.arange(BYTES) * BYTES + 32] &= np.arange(BYTES) == 32
    for r in rules:
        for pair in r.forced:
            if len(pair) == 2 and all(pair):
                out[pair[0][-1] * BYTES + pair[1][0]] = True
    return out


def first_least(sums: np.ndarray, merges: int, rules: list[Rules] = ()) -> int:
    """How often the rarest of so many merges will occur, as a first guess; 1 where nothing can be told."""
    own = np.sort(sums[mergeable(sums, 1, rules)])[::-1]
    if merges <= 0 or not len(own):
        return 1
    return max(1, int(own[2 * merges]) if 2 * merges < len(own) else 1, int(own.sum()) // (256 * merges))


def pieces(chunks: DataFrame, joined: np.ndarray, by: tuple[str, ...] = (), lone: bool = False) -> DataFrame:
    """(by..., chunk, n): the pieces of chunks (by..., chunk, n) between places that aren't joined, as bytes, counted. lone: also those of one byte."""

    def run(batches):
        def cut(held):
            t = pa.Table.from_batches(held).combine_chunks()
            whole = t.column("chunk").cast(pa.binary())
            sizes = pc.binary_length(whole).to_numpy().astype(np.int64)
            data = np.frombuffer(b"".join(whole.to_pylist()), np.uint8)
            end = np.ones(len(data), bool)
            if len(data) > 1:
                end[:-1] = ~joined[data[:-1].astype(np.int64) * BYTES + data[1:]]
            end[np.cumsum(sizes)[sizes > 0] - 1] = True
            ends = np.flatnonzero(end) + 1
            row = np.repeat(np.arange(len(sizes)), sizes)[ends - 1]
            offsets = np.r_[0, ends].astype(np.int32)
            parts = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
            out = pa.table({**{c: t.column(c).take(pa.array(row)) for c in by}, "chunk": parts, "n": pa.array(t.column("n").to_numpy()[row])})
            if not lone:
                out = out.filter(pa.array(np.diff(offsets) > 1))
            return out.group_by([*by, "chunk"]).aggregate([("n", "sum")]).rename_columns([*by, "chunk", "n"]).to_batches()

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= CUT:
                yield from cut(held)
                held, size = [], 0
        if held:
            yield from cut(held)

    own = chunks.select(*by, "chunk", F.col("n").cast("long").alias("n")).where("chunk is not null")
    kinds = "".join(f"`{c}` {own.schema[c].dataType.simpleString()}, " for c in by)
    return own.mapInArrow(run, f"{kinds}chunk binary, n long").groupBy(*by, "chunk").agg(F.sum("n").alias("n"))


def rarest(merges: list[Merge], vocab_size: int) -> int:
    """How often the rarest natural merge was made; 0 if there were fewer merges than wanted."""
    if BYTES < vocab_size and max((m.id for m in merges), default=0) + 1 < vocab_size:
        return 0
    return min((m.n for m in merges if not m.forced), default=1 << 62)


MERGES = "id int, left int, right int, bytes binary, n long, forced boolean"
_ARROW = pa.schema([("id", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("bytes", pa.binary()), ("n", pa.int64()), ("forced", pa.bool_())])


def _frame(merges: list[Merge]) -> pd.DataFrame:
    return pd.DataFrame([(m.id, m.left, m.right, m.bytes, m.n, m.forced) for m in merges], columns=["id", "left", "right", "bytes", "n", "forced"])


def train(chunks: DataFrame, vocab_size: int, rules: Rules = Rules(), mode: str = "auto", least: int = 1) -> DataFrame:
    """The merge table (id, left, right, bytes, n, forced) learned from chunks (chunk, n). All modes make the same merges.

    mode: "task" trains in one task, which holds about 30 bytes for each byte of the distinct chunks; "rounds" makes several merges a pass
    over blocks of chunks, which no task holds together; "rounds then task" does so until the chunks have no more than MOST_IN_TASK tokens, which one task then goes on
    with; "dataframe" runs a job for each merge and holds nothing. "auto" cuts chunks into pieces, and takes the task for up to MOST_IN_TASK bytes of these, and rounds then task beyond. least: no merge is
    known to be rarer, so that the task needs to keep no rarer pairs.
    """
    if mode == "auto":
        return _train_on_pieces(chunks, vocab_size, rules)
    if mode.startswith("rounds"):
        from corpuscle.operators.merging import train_in_rounds  # builds on this module

        return train_in_rounds(chunks, vocab_size, rules, most=0 if mode == "rounds" else MOST_IN_TASK, least=least)[0]
    if mode == "dataframe":
        return train_by_frames(chunks, vocab_size - BYTES, rules)

    def trained(batches):
        texts, sizes, counts = [], [], []
        for b in batches:
            chunk = b.column("chunk").cast(pa.binary())
            texts.append(b"".join(chunk.to_pylist()))
            sizes.append(pc.binary_length(chunk).to_numpy(zero_copy_only=False).astype(np.int64))
            counts.append(b.column("n").to_numpy(zero_copy_only=False))
        if texts:
            trainer = _Trainer(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(sizes), np.concatenate(counts), rules, least=least)
            del texts, sizes, counts
            yield from pa.Table.from_pandas(_frame(trainer.book.run(trainer.natural, vocab_size)), preserve_index=False).cast(_ARROW).to_batches()

    return chunks.select("chunk", "n").where("chunk is not null").repartition(1).mapInArrow(trained, MERGES)


def _train_on_pieces(chunks: DataFrame, vocab_size: int, rules: Rules) -> DataFrame:
    spark = chunks.sparkSession
    with Scratch(spark, "training") as scratch:
        counts = scratch.staged(chunks.select("chunk", "n"), "chunks")
        sums = pair_sums(counts)
        least = first_least(sums, vocab_size - BYTES, [rules])
        while True:
            own = scratch.staged(pieces(counts, mergeable(sums, least, [rules])), "pieces")
            size = own.agg(F.sum(F.octet_length("chunk"))).first()[0] or 0
            made = collected(train(own, vocab_size, rules, "task" if size <= MOST_IN_TASK else "rounds then task", least))
            if least == 1 or rarest(made, vocab_size) >= least:
                return spark.createDataFrame(_frame(made), MERGES) if made else spark.createDataFrame([], MERGES)
            scratch.drop(own)
            least = max(1, least // 4)


def train_by_frames(chunks: DataFrame, steps: int, rules: Rules = Rules()) -> DataFrame:
    """The same by a DataFrame job for each merge."""
    spark = chunks.sparkSession
    book = _Book(rules)
    words = checkpointed(chunks.select(word(F.col("chunk")).alias("w"), "n"))
    banned: list[tuple[str, str]] = []

    def natural(until: int) -> None:
        nonlocal words
        while len(book.bytes) < until:
            counts = pair_counts(words)
            if banned:
                counts = counts.join(F.broadcast(spark.createDataFrame(banned, "a string, b string")), ["a", "b"], "left_anti")
            best = counts.orderBy(F.desc("n"), "a", "b").limit(1).first()
            if best is None:
                return
            a, b = number(best.a), number(best.b)
            if not book.allows(a, b):
                banned.append((best.a, best.b))
                continue
            words = merged(words, best.a, best.b, token_name(book.add(a, b, best.n)))
            if len(book.merges) % 8 == 0:
                words = checkpointed(words)

    made = book.run(natural, BYTES + steps)
    return spark.createDataFrame(_frame(made), MERGES) if made else spark.createDataFrame([], MERGES)


def vocabulary(merges: DataFrame, specials: tuple[str, ...] = ()) -> DataFrame:
    """(id, bytes, is_special): bytes, merges (one row an id), special tokens behind them."""
    spark = merges.sparkSession
    base = spark.range(BYTES).select(F.col("id").cast("int"), F.unhex(F.lpad(F.hex("id"), 2, "0")).alias("bytes"))
    own = base.union(merges.groupBy("id").agg(F.first("bytes").alias("bytes"))).withColumn("is_special", F.lit(False))
    if not specials:
        return own
    rows = spark.createDataFrame([(k, s.encode()) for k, s in enumerate(specials)], "k int, bytes binary")
    size = own.agg(F.max("id").alias("top"))  # one row
    return own.union(rows.crossJoin(size).select((F.col("top") + 1 + F.col("k")).cast("int").alias("id"), "bytes", F.lit(True)))


def density(vocab: DataFrame) -> DataFrame:
    """One row: number of ids, greatest id, holes among them, tokens of equal bytes."""
    v = vocab.agg(F.count_distinct("id").alias("n_ids"), F.max("id").alias("max_id"), (F.count("*") - F.count_distinct("bytes")).alias("n_same_bytes"))
    return v.withColumn("n_holes", F.col("max_id") + 1 - F.col("n_ids"))


def missing_ids(vocab: DataFrame) -> DataFrame:
    top = vocab.agg(F.max("id")).first()[0]
    return vocab.sparkSession.range((top if top is not None else -1) + 1).select(F.col("id").cast("int")).join(vocab, "id", "left_anti")


def folded_encode(words: DataFrame, merges: list[Merge]) -> DataFrame:
    """Words (w) with merges applied one after another, as text replacement alone. Right where no token has two merges (aliases of forced pairs)."""
    w = F.col("w")
    for m in sorted(merges, key=lambda m: m.id):
        w = F.replace(w, F.lit(f"<{token_name(m.left)}><{token_name(m.right)}>"), F.lit(f"<{token_name(m.id)}>"))
    return words.withColumn("w", w)


def _merged_lowest(parts: list, rank: Callable, made: Callable) -> list:
    """Parts merged, the pair of the lowest rank first, of equal ones the leftmost. rank(a, b): a pair's rank, or None; made(a, b, rank): what it becomes.
    Places wait on a heap, so that a long run costs no more than its length times a logarithm."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, k) for k in range(n - 1) if (r := rank(parts[k], parts[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, k = heapq.heappop(heap)
        j = after[k]
        if parts[k] is None or j >= n or rank(parts[k], parts[j]) != r:
            continue  # one of the two is gone, or another by now
        parts[k], parts[j] = made(parts[k], parts[j], r), None
        after[k] = after[j]
        if after[k] < n:
            before[after[k]] = k
        for left in (before[k], k):
            if left >= 0 and after[left] < n and (r := rank(parts[left], parts[after[left]])) is not None:
                heapq.heappush(heap, (r, left))
    return [p for p in parts if p is not None]


def encode_word(ids: list[int], rule_of: dict[tuple[int, int], int]) -> list[int]:
    """Lowest id first, of equal ones the leftmost."""
    return _merged_lowest(ids, lambda a, b: rule_of.get((a, b)), lambda a, b, r: r)


def encode_bytes(text: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges found by the bytes they make, whatever pair makes them."""
    if text in ranks:
        return [ranks[text]]
    return [ranks[p] for p in _merged_lowest([text[i : i + 1] for i in range(len(text))], lambda a, b: ranks.get(a + b), lambda a, b, r: a + b)]


def encode_arrays(tokens: np.ndarray, sizes: np.ndarray, merges: list[Merge], skip: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """encode_word() for many words at once, one's tokens behind another's: (ids, sizes). Every step merges the lowest pair of each word, at all its places. For merges without
    forced ones, whose ids rise with those of their operands. skip(places, ids): which merges are left out where; a place is that of the first token as given."""
    wide = 1 << 32
    rules = sorted((m.left * wide + m.right, m.id) for m in merges)
    keys, ids = (np.array(x, np.int64) for x in (zip(*rules, strict=True) if rules else ((), ())))
    tokens, word, place = tokens.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), np.arange(len(tokens))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(keys) and len(tokens):
        at = np.flatnonzero(word[1:] == word[:-1])
        pair = tokens[at] * wide + tokens[at + 1]
        rule = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        hit = keys[rule] == pair
        at, rank = at[hit], ids[rule[hit]]
        if skip is not None:
            stays = ~skip(place[at], rank)
            at, rank = at[stays], rank[stays]
        if not len(at):
            break
        starts = np.flatnonzero(np.r_[True, word[at[1:]] != word[at[:-1]]])
        lowest = rank == np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(at)]))
        at, rank = at[lowest], rank[lowest]
        # Places in a row are of a token with itself: every other one.
        runs = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])
        first = (np.arange(len(at)) - np.repeat(runs, np.diff(np.r_[runs, len(at)]))) % 2 == 0
        at, rank = at[first], rank[first]
        busy = np.zeros(len(sizes), bool)
        busy[word[at]] = True
        tokens[at] = rank
        tokens[at + 1] = -1
        here, left = busy[word] & (tokens >= 0), ~busy[word]
        done.append((tokens[left], word[left]))
        tokens, word, place = tokens[here], word[here], place[here]
    done.append((tokens, word))
    tokens, word = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return tokens[order], np.bincount(word, minlength=len(sizes))


def encoder(merges: list[Merge], keyed_by: str = "pair"):
    """A function from a chunk to its ids."""
    if keyed_by == "pair":
        rule_of = {(m.left, m.right): m.id for m in merges}
        return lambda chunk: encode_word(list(chunk.encode()), rule_of)
    ranks = {bytes((i,)): i for i in range(BYTES)} | {m.bytes: m.id for m in merges}
    return lambda chunk: encode_bytes(chunk.encode(), ranks)


def encoded(chunks: DataFrame, merges: list[Merge], keyed_by: str = "pair", chunk: str = "chunk", ids: str = "ids") -> DataFrame:
    """chunks with their ids. Encode distinct chunks and join back; merges are a vocabulary, of bounded size."""
    encode = encoder(merges, keyed_by)
    in_arrays = keyed_by == "pair" and not any(m.forced for m in merges)

    @F.pandas_udf("array<int>")
    def of_chunks(s: pd.Series) -> pd.Series:
        if not in_arrays:
            return s.map(lambda c: encode(c) if c else [])
        data = [(c or "").encode() for c in s]
        ids, sizes = encode_arrays(np.frombuffer(b"".join(data), np.uint8), np.fromiter(map(len, data), np.int64, len(data)), merges)
        return pd.Series(np.split(ids.astype(np.int32), np.cumsum(sizes)[:-1]) if len(data) else [], dtype=object)

    return chunks.withColumn(ids, of_chunks(F.col(chunk)))


def collected(merges: DataFrame) -> list[Merge]:
    """A merge table (of a vocabulary, of bounded size) as a list, by id, forced ones last. Sorted here: a sort in Spark would run the training twice, for its sample."""
    rows = [Merge(r.id, r.left, r.right, bytes(r.bytes), r.n, r.forced) for r in merges.collect()]
    return sorted(rows, key=lambda m: (m.forced, m.id, m.left, m.right))


def insert_seeds(merges: list[Merge], seeds: list[tuple[bytes, bytes]]) -> tuple[list[Merge], list[int]]:
    """(merges, ids of the seeds among them): pairs put into a vocabulary right behind the later of their operands, as if they had been made there.

    A merge behind that place moves up by one for each seed before it, so ids stay dense and in the old order. An operand may be what an earlier
    seed makes. Seeds whose bytes are there already, or of which an operand is missing, are passed over. Appended at the end, a seed would hardly ever fire, as
    merges of its operands with others come first. merges: without forced ones, all ids from 256 on.
    """
    place: dict[bytes, tuple[int, int]] = {bytes((i,)): (i, 0) for i in range(BYTES)} | {m.bytes: (m.id, 0) for m in merges}
    behind: dict[int, int] = {}
    made: list[tuple[bytes, bytes]] = []
    for left, right in seeds:
        if left not in place or right not in place or left + right in place:
            continue
        # Behind all 256 bytes, if both operands are bytes.
        at = max(place[left], place[right], (BYTES - 1, 0))[0]
        behind[at] = behind.get(at, 0) + 1
        place[left + right] = (at, behind[at])
        made.append((left, right))
    number = {b: i for i, b in enumerate(sorted(place, key=place.__getitem__))}
    whole = {i: bytes((i,)) for i in range(BYTES)} | {m.id: m.bytes for m in merges}
    rows = [Merge(number[m.bytes], number[whole[m.left]], number[whole[m.right]], m.bytes, m.n) for m in merges]
    rows += [Merge(number[a + b], number[a], number[b], a + b, 0) for a, b in made]
    return sorted(rows, key=lambda m: m.id), sorted(number[a + b] for a, b in made)


def decoded(ids: DataFrame, vocab: DataFrame, key: str, pos: str = "pos", id: str = "id") -> DataFrame:
    """(key, text) of token rows (key, pos, id)."""
    named = ids.join(F.broadcast(vocab.select(F.col("id").alias(id), F.hex("bytes").alias("_h"))), id)
    whole = named.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(pos, "_h"))).alias("_t"))
    return whole.select(key, F.decode(F.unhex(F.array_join(F.transform("_t", lambda x: x["_h"]), "")), "utf-8").alias("text"))


def _spread(which: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of the items `which`, behind one another, how many each has). values: of all items, behind one another, as many as sizes tell."""
    starts, own = (np.cumsum(sizes) - sizes)[which], sizes[which]
    return values[np.repeat(starts - (np.cumsum(own) - own), own) + np.arange(own.sum())], own


def _list_ends(lists: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Where each list begins and ends, if its items are replaced by so many each."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(lengths)]]


def encoded_texts(docs: DataFrame, merges: list[Merge], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of each text, in order (null: none). Nothing is shuffled: the distinct chunks of a batch are encoded once."""
    forced = any(m.forced for m in merges)
    encode = encoder(merges)
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def run(batches):
        for b in batches:
            lists = b.column("_chunks")
            found = lists.flatten().dictionary_encode()
            own = [c.encode() for c in found.dictionary.to_pylist()]
            if forced:
                each = [encode(c.decode()) for c in own]
                values, sizes = np.array([i for x in each for i in x], np.int64), np.fromiter(map(len, each), np.int64, len(each))
            else:
                values, sizes = encode_arrays(np.frombuffer(b"".join(own), np.uint8), np.fromiter(map(len, own), np.int64, len(own)), merges)
            flat, each = _spread(found.indices.to_numpy(zero_copy_only=False).astype(np.int64), values.astype(np.int32), sizes)
            column = pa.ListArray.from_arrays(pa.array(_list_ends(lists, each), pa.int32()), pa.array(flat, pa.int32()))
            kept = [k for k, n in enumerate(b.schema.names) if n != "_chunks"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), column], [*(b.schema.names[k] for k in kept), ids])

    return docs.withColumn("_chunks", T.chunks(F.col(text), pattern)).mapInArrow(run, ", ".join([*names, f"`{ids}` array<int>"]))


def decoded_bytes(docs: DataFrame, merges: list[Merge], ids: str = "ids", raw: str = "raw") -> DataFrame:
    """docs with the bytes that their ids stand for, in place of these."""
    whole = [bytes((i,)) for i in range(BYTES)] + [b""] * (max((m.id for m in merges), default=0) + 1 - BYTES)
    for m in merges:
        whole[m.id] = m.bytes
    data, sizes = np.frombuffer(b"".join(whole), np.uint8), np.fromiter(map(len, whole), np.int64, len(whole))
    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != ids]

    def run(batches):
        for b in batches:
            lists = b.column(ids)
            flat, each = _spread(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), data, sizes)
            ends = _list_ends(lists, each)
            column = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.tobytes())])
            kept = [k for k, n in enumerate(b.schema.names) if n != ids]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), column], [*(b.schema.names[k] for k in kept), raw])

    return docs.mapInArrow(run, ", ".join([*names, f"`{raw}` binary"]))


def token_rows(docs: DataFrame, merges: list[Merge], pattern: str, keyed_by: str = "pair") -> DataFrame:
    """docs without the text, with pos and id of each token in order; distinct chunks are encoded once."""
    from corpuscle.operators import chunks as C

    rows = C.positioned(docs, pattern).withColumnRenamed("pos", "cpos")
    unique = encoded(rows.select("chunk").distinct(), merges, keyed_by)
    spread = rows.join(unique, "chunk")
    keep = [c for c in docs.columns if c != "text"]
    return spread.select(*keep, "cpos", F.posexplode("ids").alias("tpos", "id"))


def inflects(w: str, words: frozenset) -> bool:
    """Whether the dictionary holds a stem of the word."""
    if any(w.endswith(s) and len(w) > len(s) + 1 and w[: -len(s)] in words for s in ("s", "es", "ed", "ing", "d")):
        return True
    return w.endswith("ies") and len(w) > 4 and w[:-3] + "y" in words
