"""Cross-tokenizer alignment: which tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) cover the same bytes.

Both tokenizers cut a text at every space or newline that stands alone between other characters, so such a text is a row of units (a
space or newline and what follows), whose tokens and groups are those of the units, one behind another. Units recur: each block of
texts encodes the distinct ones that its worker hasn't met lately, many at once, and merges the two lists of cumulative token ends with
two pointers, written as array operations over the block: an end that both lists have closes a group. Other texts are one unit each.
A text takes part if the bytes of its A and of its B tokens are a space and the text.

A document's links are all pairs of an A and a B token of one group. Blocks carry, beside their documents, a list of the pairs that
occur in them with the number of their documents; documents name pairs by their place in it. Spark adds up the pairs' counts, takes the
greatest of each A and each B token, and joins both back to the blocks' lists, from which documents take their sums. So a pair that is in
every document makes a row a block, and no table is broadcast.

Texts that are null, empty, or that a tokenizer changes have no tokens: zeros, and '' for groups. Very long texts are encoded whole.
Rows that repeat get a result each and count as documents of their own; null ids stay null. An empty table gives an empty one. Only the id
and text columns are read.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, checkpointed
from corpuscle.llm.encoding import is_plain
from corpuscle.llm.worker import held

#: Characters of texts that are aligned at once; units that a worker keeps; bytes of a unit beyond which it isn't kept.
BLOCK, KEPT_UNITS, LONG_UNIT = 6 << 20, 300_000, 64
#: Units that are encoded as one text; and in one call.
TOGETHER, AT_ONCE = 500, 50_000
WIDE = 1 << 32
#: The character that stands for a space in pieces.
SPACE = "▁"
#: Units with white space only at their begin, so that others may stand beside them.
_SIMPLE = r"^[ \n][^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones stand for themselves, the others, in order, for 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Tokens of many texts, one text's behind another's: ids, and where each ends in the texts' joined bytes."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, bytes_of: pa.Array):
        self.ids, self.starts = ids, np.r_[0, np.cumsum(sizes)]
        own = bytes_of.take(pa.array(ids))
        self.ends = np.cumsum(pc.binary_length(own).to_numpy(zero_copy_only=False).astype(np.int64))
        self.joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(self.starts.astype(np.int32)), own), b"")  # of each text


class Pair:
    """Both tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        alphabet, entries = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        names = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            names[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.bytes_a = pa.array(names, pa.binary())
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        names = [bytes((int(p[3:5], 16),)) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.bytes_b = pa.array(names, pa.binary())
        #: Whether no piece goes on behind a space or newline, so that both cut texts into units.
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)

    def tokens_a(self, texts: list[str]) -> Tokens:
        lists = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return self._tokens(lists, self.bytes_a)

    def tokens_b(self, texts: list[str]) -> Tokens:
        """Of texts that begin with a space, which the library adds itself."""
        return self._tokens(self.b.encode([t[1:] for t in texts], num_threads=1) if texts else [], self.bytes_b)

    def _tokens(self, lists: list[list[int]], bytes_of: pa.Array) -> Tokens:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return Tokens(np.array(list(chain.from_iterable(lists)), np.int64), sizes, bytes_of)


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two lists of increasing ends merged: (ends that stand in both, the group of each A token, of each B token)."""
    both = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    common = both[1:][both[1:] == both[:-1]]
    return common, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)


def _concatenated(counts: np.ndarray) -> np.ndarray:
    """0 ... counts[0] - 1, 0 ... counts[1] - 1, and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


class Aligned:
    """Units with their tokens: numbers of tokens, groups and links, the groups as text, and the links, one unit's behind another's. ok: whether bytes are kept."""

    def __init__(self, ok, n_a, n_b, n_groups, groups: pa.Array, links: np.ndarray, n_links):
        self.ok, self.n_a, self.n_b, self.n_groups, self.groups, self.links, self.n_links = ok, n_a, n_b, n_groups, groups, links, n_links

    @staticmethod
    def none() -> Aligned:
        z = np.zeros(0, np.int64)
        return Aligned(np.zeros(0, bool), z, z, z, pa.array([], pa.string()), z, z)

    @staticmethod
    def joined(parts: list[Aligned]) -> Aligned:
        cat = lambda name: np.concatenate([getattr(p, name) for p in parts])
        return Aligned(cat("ok"), cat("n_a"), cat("n_b"), cat("n_groups"), pa.concat_arrays([p.groups for p in parts]), cat("links"), cat("n_links"))

    def take(self, at: np.ndarray) -> Aligned:
        starts = np.r_[0, np.cumsum(self.n_links)]
        n = self.n_links[at]
        links = self.links[np.repeat(starts[at], n) + _concatenated(n)]
        return Aligned(self.ok[at], self.n_a[at], self.n_b[at], self.n_groups[at], self.groups.take(pa.array(at)), links, n)


def _numbers_text(ids: np.ndarray, groups: np.ndarray, n_groups: int) -> pa.Array:
    """Of each group its ids, joined by commas."""
    starts = np.searchsorted(groups, np.arange(n_groups + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pc.cast(pa.array(ids), pa.string())), ",")


def align(pair: Pair, texts: list[str], ends: np.ndarray, of_text: np.ndarray) -> Aligned:
    """Units (ends: where each ends in the texts' joined bytes; of_text: which text each is of) aligned. Both tokenizers cut at the ends of units."""
    data = pa.array(texts, pa.string()).cast(pa.binary())
    size = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    text_ends = np.cumsum(size)
    a, b = pair.tokens_a(texts), pair.tokens_b(texts)
    ok = pc.and_(pc.equal(a.joined, data), pc.equal(b.joined, data)).to_numpy(zero_copy_only=False)
    if not ok.all():  # the others alone, so that ends count in the texts' own bytes
        kept = np.flatnonzero(ok)
        shift = (text_ends - size)[of_text]
        own = ok[of_text]
        new_ends = np.cumsum(size[kept])
        new_start = np.zeros(len(texts), np.int64)
        new_start[kept] = new_ends - size[kept]
        place = np.cumsum(ok) - 1
        inner = align(pair, [texts[i] for i in kept.tolist()], (ends - shift + new_start[of_text])[own], place[of_text[own]])
        bad = int((~own).sum())
        z = np.zeros(bad, np.int64)
        out = Aligned.joined([inner, Aligned(np.zeros(bad, bool), z, z, z, pa.array([""] * bad, pa.string()), np.zeros(0, np.int64), z)])
        order = np.empty(len(own), np.int64)
        order[own], order[~own] = np.arange(len(inner.ok)), len(inner.ok) + np.arange(bad)
        return out.take(order)
    common, of_a, of_b = merged(a.ends, b.ends)
    n_groups = len(common)
    left, right = _numbers_text(a.ids, of_a, n_groups), _numbers_text(b.ids, of_b, n_groups)
    per_a, per_b = np.bincount(of_a, minlength=n_groups), np.bincount(of_b, minlength=n_groups)
    # Links of each group: every A token with every B token.
    first_b = np.r_[0, np.cumsum(per_b)][:-1]
    fan = per_b[of_a]
    links = np.repeat(a.ids, fan) * WIDE + b.ids[np.repeat(first_b[of_a], fan) + _concatenated(fan)]
    unit = np.searchsorted(ends, common)  # a group ends in its unit
    n = len(ends)
    count = lambda values, at=unit: np.bincount(at, values, n).astype(np.int64)
    groups_of = np.bincount(unit, minlength=n)
    text = pc.binary_join_element_wise(left, right, "|")
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(groups_of)].astype(np.int32)), text)
    return Aligned(np.ones(n, bool), count(per_a), count(per_b), groups_of, pc.binary_join(lists, ";"), links, count(per_a * per_b))


class UnitTable:
    """Aligned units that a worker keeps, by their text."""

    def __init__(self, path_a: str, path_b: str):
        self.pair = Pair(path_a, path_b)
        self.names = pa.array([], pa.string())
        self.units = Aligned.none()
        self.used = np.zeros(0, np.int64)
        self.clock = 0

    def _fresh(self, names: pa.Array) -> Aligned:
        """Short units many to a text, behind a first one that is dropped; those whose bytes a tokenizer changes, and long ones, alone."""
        units = names.to_pylist()
        lengths = pc.binary_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
        short = (lengths <= LONG_UNIT) & pc.match_substring_regex(names, _SIMPLE).to_numpy(zero_copy_only=False)
        out = [Aligned.none()]
        order = np.empty(len(units), np.int64)
        at, done = np.flatnonzero(short), 0
        if len(at):
            texts, ends, of_text, mine = [], [], [], []
            base = 0
            for i in range(0, len(at), TOGETHER):
                some = at[i : i + TOGETHER]
                texts.append(" a" + "".join(units[k] for k in some.tolist()))
                e = base + np.cumsum(np.r_[2, lengths[some]])
                base = int(e[-1])
                ends.append(e)
                of_text.append(np.full(len(e), len(texts) - 1))
                mine.append(np.r_[False, np.ones(len(some), bool)])
            got = align(self.pair, texts, np.concatenate(ends), np.concatenate(of_text)).take(np.flatnonzero(np.concatenate(mine)))
            good = got.ok
            out.append(got.take(np.flatnonzero(good)))
            order[at[good]] = np.arange(good.sum())
            done = int(good.sum())
            short[at[~good]] = False
        alone = np.flatnonzero(~short)
        # A unit behind a newline is encoded behind a first one too, as text that a space begins.
        texts = [units[k] if units[k][0] == " " else " a" + units[k] for k in alone.tolist()]
        if texts:
            sizes = [[lengths[k]] if units[k][0] == " " else [2, lengths[k]] for k in alone.tolist()]
            got = align(self.pair, texts, np.cumsum(np.concatenate(sizes)), np.repeat(np.arange(len(texts)), [len(s) for s in sizes]))
            out.append(got.take(np.cumsum([len(s) for s in sizes]) - 1))
            order[alone] = done + np.arange(len(alone))
        return Aligned.joined(out).take(order)

    def of(self, names: pa.Array) -> Aligned:
        """Distinct units aligned; those that the table lacks are added to it."""
        self.clock += 1
        if len(self.names) > KEPT_UNITS:
            keep = np.sort(np.argsort(self.used, kind="stable")[-KEPT_UNITS // 2 :])
            self.names, self.units, self.used = self.names.take(pa.array(keep)), self.units.take(keep), self.used[keep]
        at = pc.index_in(names, value_set=self.names)
        lacking = pc.is_null(at)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = names.filter(lacking)
        fresh = Aligned.joined([Aligned.none(), *(self._fresh(new.slice(i, AT_ONCE)) for i in range(0, len(new), AT_ONCE))])
        place[lacking.to_numpy(zero_copy_only=False)] = len(self.names) + np.arange(len(new))
        every = Aligned.joined([self.units, fresh])
        known = place[place < len(self.names)]
        self.used[known] = self.clock
        out = every.take(place)
        keep = np.flatnonzero(pc.binary_length(new).to_numpy(zero_copy_only=False) <= LONG_UNIT)
        if len(keep):
            self.names = pa.concat_arrays([self.names, new.take(pa.array(keep))])
            self.units = Aligned.joined([self.units, fresh.take(keep)])
            self.used = np.r_[self.used, np.full(len(keep), self.clock)]
        return out


def units_of(texts: list[str], cuts: bool) -> tuple[pa.Array, np.ndarray]:
    """(all units, one text's behind another's; where each text's begin and the last one's end)."""
    plain = np.array([cuts and is_plain(t) for t in texts], bool)
    # Each space or newline begins a unit: a mark that no text has is put before it.
    marked = [(" " + t).replace(" ", "\x00 ").replace("\n", "\x00\n")[1:] if p and "\x00" not in t else " " + t for t, p in zip(texts, plain.tolist(), strict=True)]
    lists = pc.split_pattern(pa.array([m if p else "" for m, p in zip(marked, plain.tolist(), strict=True)], pa.string()), "\x00")
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    odd = [i for i, (t, p) in enumerate(zip(texts, plain.tolist(), strict=True)) if not p or "\x00" in t]
    if odd:
        sizes = np.diff(starts)
        first = starts[:-1][odd]
        keep = np.ones(len(flat), bool)
        for i, s in zip(odd, first.tolist(), strict=True):
            keep[s : s + sizes[i]] = False
        place = np.full(len(flat), -1, np.int64)
        place[keep] = np.flatnonzero(keep)
        sizes[odd] = [1 if texts[i] else 0 for i in odd]
        whole = [" " + texts[i] for i in odd if texts[i]]
        new_starts = np.r_[0, np.cumsum(sizes)]
        at = np.empty(new_starts[-1], np.int64)
        is_odd = np.zeros(len(texts), bool)
        is_odd[odd] = True
        of_unit = np.repeat(is_odd, sizes)
        at[~of_unit] = np.flatnonzero(keep)
        at[of_unit] = len(flat) + np.arange(len(whole))
        flat, starts = pa.concat_arrays([flat, pa.array(whole, pa.string())]).take(pa.array(at)), new_starts
    return flat, starts


def varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes, seven bits in each, the last one below 128; and the number of bytes of each."""
    x = x.astype(np.uint64)
    n = 1 + sum((x >= np.uint64(1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    starts = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(5):
        more = np.flatnonzero(n > k)
        out[starts[more] + k] = ((x[more] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(n[more] > k + 1, 128, 0).astype(np.uint8)
    return out, n


def from_varints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers, the place behind the last byte of each)."""
    ends = np.flatnonzero(data < 128) + 1
    if not len(ends):
        return np.zeros(0, np.int64), ends
    starts = np.r_[0, ends[:-1]]
    shift = np.arange(len(data)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * shift), starts), ends


_PARTS = "block long, doc_id {}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, a binary, b binary, docs binary"
_COLUMNS = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "a", "b", "docs"]


def _aligned(path_a: str, path_b: str, doc_id: str, text: str):
    """A row for each document, with its links as differences of places in the block's list and multiplicities; and one for each block with that list."""

    def block(number: int, ids: list, texts: list[str]) -> pd.DataFrame:
        units = held(("aligned", path_a, path_b), lambda: UnitTable(path_a, path_b))
        flat, starts = units_of(texts, units.pair.cuts)
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = units.of(coded.dictionary)
        n, sizes = len(texts), np.diff(starts)
        doc = np.repeat(np.arange(n), sizes)
        ok = np.ones(n, bool)
        ok[doc[~own.ok[codes]]] = False
        ok &= sizes > 0
        of_doc = lambda values: np.bincount(doc, values[codes], n).astype(np.int64) * ok
        numbers = {c: of_doc(getattr(own, c)) for c in ("n_a", "n_b", "n_groups", "n_links")}
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), own.groups.take(pa.array(codes))), ";").to_pylist()
        shas = [hashlib.sha256(g.encode()).hexdigest() if o else "" for g, o in zip(groups, ok.tolist(), strict=True)]
        # Links: pairs numbered by how often they occur, the most frequent first, so that differences are small.
        names, which = np.unique(own.links, return_inverse=True)
        codes, doc = codes[ok[doc]], doc[ok[doc]]
        times = np.bincount(which, np.repeat(np.bincount(codes, minlength=len(own.ok)), own.n_links), len(names)).astype(np.int64)
        order = np.argsort(-times, kind="stable")
        order = order[times[order] > 0]
        place = np.zeros(len(names), np.int64)
        place[order] = np.arange(len(order))
        which = place[which]
        first = np.cumsum(own.n_links) - own.n_links
        fan = own.n_links[codes]
        k = max(1, len(order))
        keys = np.sort(np.repeat(doc, fan) * k + which[np.repeat(first[codes], fan) + _concatenated(fan)])
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        often, keys = np.diff(np.r_[at, len(keys)]), keys[at]
        pair, doc = keys % k, keys // k
        docs_of = np.bincount(pair, minlength=len(order))
        step = np.diff(pair, prepend=0)
        new = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
        step[new] = pair[new]
        data, size = varints(np.stack([step, often], 1).ravel())
        ends = np.r_[0, np.cumsum(np.bincount(doc, size.reshape(-1, 2).sum(1), n).astype(np.int64))].tolist()
        data = data.tobytes()
        rows = {"block": number, "doc_id": ids, **numbers, "groups_sha256": shas, "pairs": [data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], "a": None, "b": None, "docs": None}
        listed = {"block": [number], **{c: [None] for c in _COLUMNS[1:]}, "a": [(names[order] // WIDE).astype("<u4").tobytes()], "b": [(names[order] % WIDE).astype("<u4").tobytes()], "docs": [docs_of.astype("<u4").tobytes()]}
        make = lambda c: pd.DataFrame({k: pd.Series(v, dtype=object) if k != "block" else v for k, v in c.items()}, columns=_COLUMNS)
        return pd.concat([make(rows), make(listed)]) if n else make(listed)

    def run(batches):
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for pdf in batches:
            for i, t in zip(pdf[doc_id].array, pdf[text].tolist(), strict=True):
                t = t or ""
                if texts and size + len(t) > BLOCK:
                    yield block(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(None if pd.isna(i) else i)
                texts.append(t)
                size += len(t)
        if texts:
            yield block(number, ids, texts)

    return run


def _listed(batches):
    """The pairs of blocks' lists, a row each."""
    for b in batches:
        for block, *columns in zip(*(b.column(c).to_pylist() for c in ("block", "a", "b", "docs")), strict=True):
            a, c, n = (np.frombuffer(x, "<u4").astype(np.int64) for x in columns)
            for i in range(0, len(a), 50_000):
                s = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[s]), block)), pa.array(np.arange(i, i + len(a[s]))), *(pa.array(x[s]) for x in (a, c, n))], ["block", "place", "a", "b", "docs"])


def _summed(batches):
    """Of each block: its pairs' counts, in order of their places, then its documents."""
    now, count, best_a, best_b = None, [], [], []
    table = None
    for b in batches:
        blocks, places = b.column("block").to_numpy(), b.column("place")
        edges = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True]) if b.num_rows else np.zeros(0, np.int64)
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if blocks[i] != now:
                now, count, best_a, best_b, table = blocks[i], [], [], [], None
            part = b.slice(i, j - i)
            is_pair = pc.is_valid(places.slice(i, j - i))
            listed, docs = part.filter(is_pair), part.filter(pc.invert(is_pair))
            if listed.num_rows:
                for kept, c in ((count, "count"), (best_a, "best_a"), (best_b, "best_b")):
                    kept.append(listed.column(c).to_numpy(zero_copy_only=False).astype(np.int64))
            if not docs.num_rows:
                continue
            if table is None:
                table = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (count, best_a, best_b)]
            data = docs.column("pairs").to_pylist()
            x, at = from_varints(np.frombuffer(b"".join(data), np.uint8))
            size = np.searchsorted(at, np.cumsum([len(d) for d in data]), side="right") // 2
            doc = np.repeat(np.arange(len(data)), np.diff(size, prepend=0))
            step, often = x[0::2], x[1::2]
            run = np.cumsum(step)
            before = np.r_[0, size[:-1]]
            full = np.diff(size, prepend=0) > 0
            shift = np.zeros(len(data), np.int64)
            shift[full] = (run - step)[before[full]]
            pair = run - shift[doc]
            sums = [pa.array(np.bincount(doc, often * t[pair], len(data)).astype(np.int64)) for t in (table[1], table[0], table[2])]
            yield pa.RecordBatch.from_arrays([*(docs.column(c) for c in _COLUMNS[1:6]), *sums, docs.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_best_b", "groups_sha256"])


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, n_best_b, groups_sha256): a row for each document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    with Scratch(docs.sparkSession, "alignment") as scratch:
        parts = scratch.staged(docs.select(doc_id, text).mapInPandas(_aligned(path_a, path_b, doc_id, text), _PARTS.format(kind)), "parts")
        lists = scratch.staged(parts.where("a is not null").select("block", "a", "b", "docs").mapInArrow(_listed, "block long, place long, a long, b long, docs long"), "lists")
        counts = scratch.staged(lists.groupBy("a", "b").agg(F.sum("docs").alias("count")), "counts")
        most = lambda side: counts.groupBy(side).agg(F.max("count").alias(f"most_{side}"))
        told = counts.join(most("a"), "a").join(most("b"), "b")
        told = told.select("a", "b", "count", (F.col("count") == F.col("most_a")).cast("long").alias("best_a"), (F.col("count") == F.col("most_b")).cast("long").alias("best_b"))
        listed = lists.select("block", "place", "a", "b").join(told, ["a", "b"]).select("block", "place", "count", "best_a", "best_b")
        own = parts.where("a is null").select("block", *_COLUMNS[1:8])
        rows = listed.unionByName(own, allowMissingColumns=True)
        rows = rows.repartition("block").sortWithinPartitions("block", F.asc_nulls_last("place"))
        out = rows.mapInArrow(_summed, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, n_best_b long, groups_sha256 string")
        return checkpointed(out)
