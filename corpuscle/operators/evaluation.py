"""Sets of rules trained and measured on held-out shards, with what they share made once.

A candidate makes the merges of the plain training until the first that its rules forbid. So a task trains once, and where the next
merge is forbidden to candidates, each of them goes on from a copy of the trainer as it stands; those that forbid none take its end. The chunks
are in a table with a row for each, with the count to train on and the counts of each held-out shard; held-out chunks are merged along with the others, at no
weight, so that they are encoded when training ends. Blocks of the table go to as many tasks as there are, not to each candidate.

Chunks are cut into pieces at the places that no candidate's merge can cross (see bpe.py), and the pieces summed: a task holds these alone. Were the
merges of one candidate rarer than was taken for granted, all are measured anew on longer pieces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, checkpointed
from corpuscle.operators.bpe import BYTES, Rules, _allowed, _Trainer, encode_word, first_least, inflects, mergeable, pair_sums, pieces, rarest

#: Rows of a block of chunks.
ROWS = 20_000

_BLOCK = "data binary, sizes binary, counts binary, shards array<string>, entry_word binary, entry_shard binary, entry_n binary"


def _packed(batches):
    """Of (chunk, n, held: (shard, n) each): blocks of chunks."""
    for whole in batches:
        for i in range(0, whole.num_rows, ROWS):
            b = whole.slice(i, ROWS)
            chunk = b.column("chunk").cast(pa.binary())
            held = b.column("held").combine_chunks() if isinstance(b.column("held"), pa.ChunkedArray) else b.column("held")
            entries, words = held.flatten(), pc.list_parent_indices(held).to_numpy(zero_copy_only=False)
            shards = entries.field("shard").dictionary_encode()
            ints = lambda a, kind: np.asarray(a).astype(kind).tobytes()
            row = {
                "data": [b"".join(chunk.to_pylist())], "sizes": [ints(pc.binary_length(chunk), "<i8")], "counts": [ints(b.column("n"), "<i8")], "shards": [shards.dictionary.to_pylist()],
                "entry_word": [ints(words, "<i8")], "entry_shard": [ints(shards.indices, "<i8")], "entry_n": [ints(entries.field("n"), "<i8")],
            }
            kinds = {"shards": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in row.items()], list(row))


class Corpus:
    """The chunks of all blocks behind one another, and an entry for each chunk that a held-out shard has."""

    def __init__(self, blocks):
        none = np.zeros(0, np.int64)
        ints = lambda raw: np.frombuffer(raw, "<i8")
        self.data = np.frombuffer(b"".join(b["data"] for b in blocks), np.uint8)
        self.sizes = np.concatenate([none, *(ints(b["sizes"]) for b in blocks)])
        self.counts = np.concatenate([none, *(ints(b["counts"]) for b in blocks)])
        number: dict[str, int] = {}
        words, shards, first = [none], [none], 0
        for b in blocks:
            words.append(ints(b["entry_word"]) + first)
            first += len(b["sizes"]) // 8
            of = np.array([number.setdefault(s, len(number)) for s in b["shards"]], np.int64)
            shards.append(of[ints(b["entry_shard"])] if len(of) else none)
        self.word, self.shard = np.concatenate(words), np.concatenate(shards)
        self.n = np.concatenate([none, *(ints(b["entry_n"]) for b in blocks)])
        self.shards = list(number)
        self.word_of_place = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def held_out(self, trainer: _Trainer, rules: Rules) -> tuple[dict[str, int], dict[str, int]]:
        """(tokens, tokens that fire) of each shard."""
        if rules.forced:  # what forced pairs make isn't in the trainer's tokens
            rule_of = {(m.left, m.right): m.id for m in trainer.book.merges}
            raw, ends = self.data.tobytes(), np.cumsum(self.sizes)
            ids = {w: encode_word(list(raw[ends[w] - self.sizes[w] : ends[w]]), rule_of) for w in np.unique(self.word).tolist()}
            lengths = np.array([len(ids[w]) if w in ids else 0 for w in range(len(self.sizes))], np.int64)
            token = np.array([t for w in sorted(ids) for t in ids[w]], np.int64)
            word = np.repeat(np.arange(len(lengths)), lengths)
        else:
            alive = trainer.token >= 0
            token, word = trainer.token[alive], self.word_of_place[alive]
            lengths = np.bincount(word, minlength=len(self.sizes))
        total = np.bincount(self.shard, self.n * lengths[self.word], len(self.shards))
        fired = {}
        for k, s in enumerate(self.shards):
            here = np.zeros(len(self.sizes), bool)
            here[self.word[self.shard == k]] = True
            fired[s] = int(np.count_nonzero(np.bincount(token[here[word]])))
        return {s: int(total[k]) for k, s in enumerate(self.shards)}, fired


def _coverage(vocab: dict[int, bytes], words: frozenset) -> tuple[int, int]:
    """(tokens that are a space and a word, tokens that are an inflected one)."""
    base = infl = 0
    for b in vocab.values():
        try:
            s = b.decode()
        except UnicodeDecodeError:
            continue
        if s.startswith(" "):
            w = s[1:].lower()
            base += w in words
            infl += w not in words and inflects(w, words)
    return base, infl


def measured(corpus: Corpus, trainer: _Trainer, rules: Rules, words: frozenset) -> tuple:
    """(base, infl, tokens, dead) of a vocabulary as it stands at the end of training."""
    vocab = {i: bytes((i,)) for i in range(BYTES)} | {m.id: m.bytes for m in trainer.book.merges}
    tokens, fired = corpus.held_out(trainer, rules)
    return *_coverage(vocab, words), tokens, {s: len(vocab) - n for s, n in fired.items()}


def common_rules(rules: list[Rules]) -> Rules:
    """What all of some rules forbid; room is held for no forced pair."""
    if not rules:
        return Rules()
    shared = set(rules[0].blocked).intersection(*(r.blocked for r in rules))
    return Rules(blocked=tuple(p for p in rules[0].blocked if p in shared), leading_space=all(r.leading_space for r in rules), trailing_space=all(r.trailing_space for r in rules))


def trained_apart(trainer: _Trainer, rules: dict[int, Rules], vocab_size: int) -> Iterator[tuple[int, _Trainer]]:
    """Each candidate with a trainer that has trained by its rules. trainer: as it starts, by rules that all candidates share. Use each before the next one is taken."""
    base, book = trainer.book.rules, trainer.book
    of_pair, flagged, stops, rest = defaultdict(set), set(), defaultdict(set), set(rules)
    for c, r in rules.items():
        for p in (*r.blocked, *r.forced):
            of_pair[p].add(c)
        if r.forced or (r.leading_space, r.trailing_space) != (base.leading_space, base.trailing_space):
            flagged.add(c)
        if r.forced:
            stops[max(BYTES, vocab_size - len(r.forced))].add(c)

    def apart(cands, pair=None):
        for c in sorted(cands):
            rest.discard(c)
            own = trainer.copy(rules[c], pair)
            own.book.run(own.natural, vocab_size)
            yield c, own

    while rest:
        yield from apart(rest & stops.get(len(book.bytes), set()))
        found = trainer._best() if len(book.bytes) < vocab_size and rest else None
        if found is None:
            break
        pair, n = found
        a, b = divmod(pair, trainer.WIDE)
        left, right = book.bytes[a], book.bytes[b]
        forbidden = rest & of_pair.get((left, right), set())
        for c in rest & flagged:
            r = rules[c]
            if not _allowed(r, left, right, (), set(r.forced), {x + y for x, y in r.forced}):
                forbidden.add(c)
        yield from apart(forbidden, found)
        trainer._apply(pair, book.add(a, b, n))
    for c in sorted(c for c in rest if rules[c].forced):
        yield from apart({c})
    for c in sorted(rest):
        yield c, trainer


def evaluate_candidates(spark: SparkSession, train_chunks: DataFrame, held_out: DataFrame, words: list[str], candidates: list[tuple[int, Rules]], vocab_size: int, tasks: int | None = None) -> DataFrame:
    """(cand, base, infl, tokens map, dead map, error): each candidate's rules trained and measured; one that fails gives its error, the others their figures.

    train_chunks: (chunk, n); held_out: (shard, chunk, n). tasks: among how many tasks candidates are dealt, each of which holds the pieces (about 60
    bytes of memory for each byte of the distinct ones); as many as run at once, if not told.
    """
    if not candidates:
        return spark.createDataFrame([], "cand int, base int, infl int, tokens map<string,long>, dead map<string,long>, error string")
    rules = [r for _, r in candidates]
    with Scratch(spark, "evaluation") as scratch:
        rows = train_chunks.select("chunk", "n", F.lit(None).cast("string").alias("shard")).union(held_out.select("chunk", "n", "shard")).where("chunk is not null")
        rows = scratch.staged(rows, "chunks")
        sums = pair_sums(rows.where("shard is null"))
        least = first_least(sums, vocab_size - BYTES, rules)
        while True:
            own = scratch.staged(pieces(rows, mergeable(sums, least, rules), ("shard",), lone=True), "pieces")
            out = checkpointed(_evaluated(spark, own, words, candidates, vocab_size, tasks))  # a row for each candidate
            if least == 1 or out.where(F.col("error").isNull() & (F.col("least") < least)).isEmpty():
                return out.drop("least")
            scratch.drop(own)
            least = max(1, least // 4)


def _evaluated(spark: SparkSession, rows: DataFrame, words: list[str], candidates: list[tuple[int, Rules]], vocab_size: int, tasks: int | None) -> DataFrame:
    """(cand, base, infl, tokens, dead, error, least) over pieces (shard, chunk, n), of which those without a shard are trained on; least: how often the rarest merge was made."""
    train = F.sum(F.when(F.col("shard").isNull(), F.col("n")).otherwise(0)).alias("n")
    held = F.collect_list(F.when(F.col("shard").isNotNull(), F.struct("shard", "n"))).alias("held")
    blocks = rows.groupBy("chunk").agg(train, held).mapInArrow(_packed, _BLOCK)
    parts = max(1, min(len(candidates), tasks or spark.sparkContext.defaultParallelism))
    dealt = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionByRange(parts, "part").sortWithinPartitions("part")
    of_part = [dict(candidates[k::parts]) for k in range(parts)]
    dictionary = frozenset(words)

    def run(batches):
        def rows(part, blocks):
            good, bad = {}, {}
            for c, r in of_part[part].items():
                try:
                    _allowed(r, b"", b"", set(r.blocked), set(r.forced), {a + b for a, b in r.forced})
                    good[c] = r
                    if any(len(p) != 2 for p in r.blocked):
                        raise ValueError("a blocked pair is not a pair")
                except Exception as e:  # one candidate's failure is its result
                    good.pop(c, None)
                    bad[c] = repr(e)
            out = [(c, None, None, None, None, e, None) for c, e in bad.items()]
            corpus = Corpus(blocks)
            shared = common_rules(list(good.values()))
            for c, trainer in trained_apart(_Trainer(corpus.data, corpus.sizes, corpus.counts, shared), good, vocab_size):
                try:
                    out.append((c, *measured(corpus, trainer, good[c], dictionary), None, rarest(trainer.book.merges, vocab_size)))
                except Exception as e:
                    out.append((c, None, None, None, None, repr(e), None))
            return pd.DataFrame(out, columns=["cand", "base", "infl", "tokens", "dead", "error", "least"]).astype({"least": "Int64"})

        now, blocks = None, []
        for pdf in batches:
            for block in pdf.to_dict("records"):
                if block["part"] != now:
                    if now is not None:
                        yield rows(now, blocks)
                    now, blocks = block["part"], []
                blocks.append(block)
        if now is not None:
            yield rows(now, blocks)

    return dealt.mapInPandas(run, "cand int, base int, infl int, tokens map<string,long>, dead map<string,long>, error string, least long")
