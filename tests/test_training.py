"""Training in rounds, encoding in arrays, candidates that share a prefix: each against the plain way, on random input."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from corpuscle.cluster import ship_code
from corpuscle.operators import bpe, chunks, evaluation, merging


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_code(spark)


def as_rows(merges):
    return [(m.id, m.left, m.right, m.bytes, m.n, m.forced) for m in merges]


def random_words(rng):
    letters = rng.choice(("ab", "abc", "aab ", "é b", "abcdefgh"))
    words = sorted({"".join(rng.choices(letters, k=rng.randint(0, 12))).encode() for _ in range(rng.randint(0, 40))})
    return words, [rng.randint(1, rng.choice((1, 3, 50))) for _ in words]


def random_rules(rng, forced=True):
    pairs = [("a", "b"), ("b", "a"), ("ab", "a"), ("b", "b"), (" ", "b"), ("c", "ab")]
    pick = lambda share: tuple(p for p in pairs if rng.random() < share)
    return bpe.Rules.of(pick(0.2), pick(0.2) if forced and rng.random() < 0.4 else (), rng.random() < 0.2, rng.random() < 0.2)


class LocalRounds(merging._Rounds):
    """The passes over blocks made here, one block after another."""

    def __init__(self, words, counts, book, hot, look, parts):
        self.book, self.hot, self.look, self.rounds = book, hot, look, 0
        self.rows = []
        for k in range(parts):
            b = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words[k::parts]], pa.string()), pa.array(counts[k::parts], pa.int64())], ["chunk", "n"])
            self.rows += list(merging._blocks([b]))
        self._counted()

    def _sums(self, step):
        out = Counter()
        for b in step(self.rows):
            for pair, n in zip(b.column("pair").to_pylist(), b.column("n").to_pylist(), strict=True):
                out[pair] += n
        return out

    def _counted(self):
        first = sorted((-n, pair) for pair, n in self._sums(merging._pair_sums).items())
        self.floor = first[self.hot] if len(first) > self.hot else merging.END
        self._kept(first[: self.hot])

    def _round(self, top, limit, until):
        self.rounds += 1
        found: dict = {}
        for b in merging._looked(np.array(top, np.int64))(self.rows):
            for r in b.to_pylist():
                key = (r["kind"], r["pair"], r["other"] if r["kind"] == 3 else None)
                n, least = found.get(key, (0, r["other"]))
                found[key] = (n + r["n"], min(least, r["other"]))
        seen = merging._Looked(len(top), ((*key, *value) for key, value in found.items()))
        pairs = [divmod(k, merging.WIDE) for k in top]
        chosen = merging.taken(pairs, seen, limit, until - len(self.book.bytes))
        for k, pair in enumerate(top):
            self._keep(pair, int(seen.count[k]))
        if chosen:
            first = len(self.book.bytes)
            for k in chosen:
                self.book.add(*pairs[k], int(seen.count[k]))
                del self.bound[top[k]]
            self.rows = list(merging._merge([pairs[k] for k in chosen], first)(self.rows))
            for pair, n in self._sums(merging._born).items():
                self._keep(pair, n)


def test_rounds_make_the_merges_of_training_one_by_one(monkeypatch):
    class Context:
        def partitionId(self):
            return 0

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(Context))
    rng, together = random.Random(2), 0
    for _ in range(400):
        words, counts = random_words(rng)
        rules, size = random_rules(rng), 256 + rng.randint(0, 30)
        book = bpe._Book(rules)
        rounds = LocalRounds(words, counts, book, rng.choice((1, 2, 5, 1000)), rng.choice((1, 3, 1000)), rng.randint(1, 4))
        assert as_rows(book.run(rounds.natural, size)) == as_rows(bpe.train_local(words, counts, size, rules))
        together = max(together, len(book.merges) - rounds.rounds)
    assert together > 0


def test_rounds_in_spark(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(merging, "BLOCK", 1 << 14)
    counted = chunks.counted(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select("text"))
    rules = bpe.Rules.of((("t", "h"),), (("o", "f"), ("of", "z")))
    made, rounds = merging.train_in_rounds(counted.repartition(5), bpe.BYTES + 60, rules, hot=200, look=64)
    one_by_one = bpe.collected(bpe.train(counted, bpe.BYTES + 60, rules, "task"))
    assert as_rows(bpe.collected(made)) == as_rows(one_by_one) and rounds < 60
    assert merging.train_in_rounds(counted.where("false"), bpe.BYTES + 5)[0].count() == 0
    assert bpe.train(counted, bpe.BYTES + 3, mode="rounds").count() == 3


@pytest.mark.parametrize("few", [0, 2, 1000])
def test_few_and_many_places_are_merged_alike(few, monkeypatch):
    """The loop and the array operations, against counting anew for each merge."""
    monkeypatch.setattr(bpe._Trainer, "FEW", few)
    rng = random.Random(6)
    for _ in range(150):
        words, counts = random_words(rng)
        made = bpe.train_local(words, counts, 256 + rng.randint(0, 25))
        chunks_now = [list(w) for w in words]
        for m in made:
            pairs = Counter()
            for w, n in zip(chunks_now, counts, strict=True):
                for p in zip(w, w[1:], strict=False):
                    pairs[p] += n
            best = min(pairs, key=lambda p: (-pairs[p], p))
            assert (m.left, m.right, m.n) == (*best, pairs[best])
            chunks_now = [replaced(w, best, m.id) for w in chunks_now]


def replaced(ids, pair, new):
    out, i = [], 0
    while i < len(ids):
        both = tuple(ids[i : i + 2]) == pair
        out.append(new if both else ids[i])
        i += 2 if both else 1
    return out


def lowest_first(ids, rule_of):
    """The definition, word by word: look for the lowest pair anew after each merge."""
    while len(ids) > 1:
        best = min((rule_of.get(p, 1 << 60), k) for k, p in enumerate(zip(ids, ids[1:], strict=False)))
        if best[0] == 1 << 60:
            break
        ids = [*ids[: best[1]], best[0], *ids[best[1] + 2 :]]
    return ids


def test_encoders_equal_the_definition():
    rng = random.Random(3)
    for _ in range(300):
        words, counts = random_words(rng)
        merges = bpe.train_local(words, counts, 256 + rng.randint(0, 20))
        rule_of, ranks = {(m.left, m.right): m.id for m in merges}, {bytes((i,)): i for i in range(256)} | {m.bytes: m.id for m in merges}
        others = [*words, *(w + w for w in words), b"", b"aaaaaaa", b"abababab", b"zzz"]
        want = [lowest_first(list(w), rule_of) for w in others]
        assert [bpe.encode_word(list(w), rule_of) for w in others] == want
        ids, sizes = bpe.encode_arrays(np.frombuffer(b"".join(others), np.uint8), np.array([len(w) for w in others]), merges)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
        assert all(b"".join({v: k for k, v in ranks.items()}[i] for i in bpe.encode_bytes(w, ranks)) == w for w in others)


def test_encoding_a_long_run_is_not_quadratic():
    merges = bpe.train_local([b"abc" * 5, b"ab"], [3, 9], 270)
    rule_of = {(m.left, m.right): m.id for m in merges}
    ids = bpe.encode_word(list(b"abc" * 100_000), rule_of)
    assert len(ids) < 100_000


def test_candidates_that_share_a_prefix_equal_those_trained_alone():
    rng = random.Random(4)
    for _ in range(150):
        words, counts = random_words(rng)
        rules, size = {c: random_rules(rng) for c in range(rng.randint(1, 7))}, 256 + rng.randint(0, 25)
        data, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        trainer = bpe._Trainer(data, sizes, np.array(counts, np.int64), evaluation.common_rules(list(rules.values())))
        got = {c: as_rows(own.book.merges) for c, own in evaluation.trained_apart(trainer, rules, size)}
        assert got == {c: as_rows(bpe.train_local(words, counts, size, r)) for c, r in rules.items()}


def test_many_candidates_are_measured(spark, sf_dir):
    """Each pair that plain training merges, barred by itself, and some sets with forced pairs, against trainings and encodings of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    train, held = chunks.counted(docs.where("doc_id % 2 = 0")), chunks.counted(docs.where("doc_id % 2 = 1"), by=("lang",)).withColumnRenamed("lang", "shard").cache()
    plain = bpe.collected(bpe.train(train, bpe.BYTES + 24, mode="task"))
    whole = {i: bytes((i,)) for i in range(256)} | {m.id: m.bytes for m in plain}
    rules = [bpe.Rules(), *(bpe.Rules(blocked=((whole[m.left], whole[m.right]),)) for m in plain), bpe.Rules.of((("t", "h"),), (("q", "u"), ("z", "z")))]
    words = ["the", "and", "of", "der", "die", "une"]
    got = {r.cand: r for r in evaluation.evaluate_candidates(spark, train, held, words, list(enumerate(rules)), bpe.BYTES + 24, tasks=3).collect()}
    assert len(got) == len(rules) and all(r.error is None for r in got.values())
    for k in (0, 1, 5, 20, 24, 25):
        made = bpe.collected(bpe.train(train, bpe.BYTES + 24, rules[k], "task"))
        per = bpe.encoded(held, made).groupBy("shard").agg(F.sum(F.size("ids") * F.col("n")).alias("tokens"), F.collect_list("ids").alias("ids")).collect()
        size = len({m.id for m in made} | set(range(256)))
        assert got[k].tokens == {r.shard: r.tokens for r in per} and got[k].dead == {r.shard: size - len({i for x in r.ids for i in x}) for r in per}
        names = {m.bytes.decode(errors="replace") for m in made}
        assert got[k].base == sum(f" {w}" in names for w in words)


def test_candidates_are_measured_and_failures_reported(spark):
    docs = spark.createDataFrame([("the cat sat on the mat",), ("the cats",)], "text string")
    c = chunks.counted(docs)
    held = c.select(F.lit("s").alias("shard"), "chunk", "n")
    bad = bpe.Rules(blocked=((b"a", b"b", b"c"),))  # not a pair
    out = {r.cand: r for r in evaluation.evaluate_candidates(spark, c, held, ["the", "cat"], [(0, bpe.Rules()), (1, bad)], bpe.BYTES + 20).collect()}
    assert out[0].error is None and out[0].tokens["s"] > 0 and out[0].base >= 1
    assert out[1].error is not None and out[1].tokens is None
    assert evaluation.evaluate_candidates(spark, c, held, [], [], 300).isEmpty()
    nothing = evaluation.evaluate_candidates(spark, c.where("false"), held.where("false"), [], [(7, bpe.Rules())], 300)
    assert [r.cand for r in nothing.collect()] in ([], [7])


@pytest.mark.parametrize("share", [0.9, 0.6, 0.01])
def test_one_task_goes_on_where_rounds_leave_few_tokens(spark, sf_dir, monkeypatch, share):
    """From tokens and a book of merges the same merges follow, and fewer rounds are made."""
    monkeypatch.setattr(merging, "STEP", 8)
    counted = chunks.counted(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).select("text"))
    size = counted.selectExpr("sum(octet_length(chunk))").first()[0]
    rules = bpe.Rules.of((("t", "h"),), (("o", "f"), ("of", "z")))
    made, rounds = merging.train_in_rounds(counted.repartition(3), bpe.BYTES + 60, rules, hot=200, look=64, most=int(size * share))
    assert as_rows(bpe.collected(made)) == as_rows(bpe.collected(bpe.train(counted, bpe.BYTES + 60, rules, "task")))
    assert rounds < 20 if share > 0.5 else rounds > 10


def test_trainer_goes_on_from_tokens():
    """A trainer made of another's tokens and merges goes on as that one does."""
    rng = random.Random(11)
    for _ in range(200):
        words, counts = random_words(rng)
        rules, k, size = random_rules(rng), rng.randint(0, 10), 256 + rng.randint(10, 30)
        rules = bpe.Rules(rules.blocked, (), rules.leading_space, rules.trailing_space)
        whole = bpe.train_local(words, counts, size, rules)
        book = bpe._Book(rules)
        for m in whole[:k]:
            book.add(m.left, m.right, m.n)
        ids = [bpe.encode_word(list(w), {(m.left, m.right): m.id for m in whole[:k]}) for w in words]
        tokens = np.array([i for x in ids for i in x], np.int32)
        on = bpe._Trainer(tokens, np.array([len(x) for x in ids], np.int64), np.array(counts, np.int64), rules, book)
        assert as_rows(on.book.run(on.natural, size)) == as_rows(whole)


def test_pairs_rarer_than_the_rarest_merge_are_not_kept():
    """Merges stay the same, and pairs that never occur so often are in no table."""
    rng, fewer = random.Random(12), 0
    for few in [0, 1000] * 100:
        words, counts = random_words(rng)
        rules, size = random_rules(rng), 256 + rng.randint(1, 12)
        whole = bpe.train_local(words, counts, size, rules)
        least = max(1, min((m.n for m in whole if not m.forced), default=1))
        data, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
        kept, all_of_them = (bpe._Trainer(data, sizes, np.array(counts, np.int64), rules, least=n) for n in (least, 1))
        kept.FEW = all_of_them.FEW = few
        assert as_rows(kept.book.run(kept.natural, size)) == as_rows(all_of_them.book.run(all_of_them.natural, size)) == as_rows(whole)
        fewer += len(all_of_them.where) - len(kept.where)
    assert fewer > 0
