"""Loaded vocabularies, the search over Spark with its journal, sinks, samplers, codecs, loaders: against brute force and round trips."""

import base64
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, byte_size, shared_dir, ship_code, small_side
from corpuscle.functions import text as T
from corpuscle.operators import bpe, chunks, evaluation, metrics, registers, surface
from corpuscle.plans import fixpoint, reports, sinks
from corpuscle.sources import corpus, vocabularies


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_code(spark)


def naive(words, counts, vocab_size, rules):
    """Merges by counting all pairs anew each time."""
    words, names = [list(w) for w in words], [bytes((i,)) for i in range(256)]
    whole, out, made = {a + b for a, b in rules.forced}, [], set()

    def natural(until):
        while len(names) < until:
            n = {}
            for w, c in zip(words, counts, strict=True):
                for p in zip(w, w[1:], strict=False):
                    n[p] = n.get(p, 0) + c
            ok = [(-c, p) for p, c in n.items() if p not in made and bpe._allowed(rules, names[p[0]], names[p[1]], set(rules.blocked), set(rules.forced), whole)]
            if not ok:
                return
            c, p = min(ok)
            made.add(p)
            out.append((len(names), *p, names[p[0]] + names[p[1]], -c, False))
            for k, w in enumerate(words):
                new, i = [], 0
                while i < len(w):
                    if i + 1 < len(w) and (w[i], w[i + 1]) == p:
                        new.append(len(names))
                        i += 2
                    else:
                        new.append(w[i])
                        i += 1
                words[k] = new
            names.append(names[p[0]] + names[p[1]])

    natural(max(256, vocab_size - len(rules.forced)))
    if rules.forced:
        known = {b: i for i, b in enumerate(names)}
        for a, b in rules.forced:
            if (a, b) in rules.blocked or a not in known or b not in known or (known[a], known[b]) in made:
                continue
            if a + b not in known:
                if len(names) >= vocab_size:
                    break
                known[a + b] = len(names)
                names.append(a + b)
            made.add((known[a], known[b]))
            out.append((known[a + b], known[a], known[b], a + b, 0, True))
        natural(vocab_size)
    return out


def as_rows(merges):
    return [(m.id, m.left, m.right, m.bytes, m.n, m.forced) for m in merges]


def test_trainer_equals_counting_anew():
    rng = random.Random(2)
    for _ in range(120):
        letters = rng.choice(("ab", "abc", "aab ", "é b"))
        words = [w.encode() for w in {"".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 25))}]
        counts = [rng.randint(1, 9) for _ in words]
        rules = bpe.Rules.of((("a", "b"),) if rng.random() < 0.3 else (), (("a", "b"), ("ab", "a"), ("b", "b")) if rng.random() < 0.4 else (), rng.random() < 0.3, rng.random() < 0.3)
        size = 256 + rng.randint(0, 25)
        assert as_rows(bpe.train_local(words, counts, size, rules)) == naive(words, counts, size, rules)


def test_both_modes_make_the_same_merges(spark):
    texts = spark.createDataFrame([("the then than a hat that hat",), ("an ant then the the",)], "text string")
    counts = chunks.counted(texts)
    for rules in (bpe.Rules(), bpe.Rules.of((("h", "e"),), (("t", "h"), ("th", "e"), ("a", "n")))):
        a, b = (bpe.collected(bpe.train(counts, bpe.BYTES + 9, rules, mode)) for mode in ("task", "dataframe"))
        assert as_rows(a) == as_rows(b) and len(a) == 9
    assert bpe.train(counts.where("false"), bpe.BYTES + 9, mode="task").count() == 0


def test_candidates_in_blocks_equal_one_by_one(spark):
    texts = spark.createDataFrame([("the then than a hat that hat", "x"), ("an ant then the the", "y"), (None, "y")], "text string, source string")
    train, held = chunks.counted(texts), chunks.counted(texts, by=("source",)).withColumnRenamed("source", "shard")
    rules = [bpe.Rules(), bpe.Rules.of((("t", "h"),))]
    got = {r.cand: r for r in evaluation.evaluate_candidates(spark, train, held.repartition(5), ["the", "hat", "ant"], list(enumerate(rules)), bpe.BYTES + 12).collect()}
    for k, r in enumerate(rules):
        made = bpe.collected(bpe.train(train, bpe.BYTES + 12, r, "task"))
        enc = bpe.encoded(held, made)
        per = {x.shard: x.tokens for x in enc.groupBy("shard").agg(F.sum(F.size("ids") * F.col("n")).alias("tokens")).collect()}
        assert got[k].tokens == per and got[k].error is None
        fired = {x.shard: x.n for x in enc.select("shard", F.explode("ids").alias("i")).groupBy("shard").agg(F.count_distinct("i").alias("n")).collect()}
        assert got[k].dead == {s: bpe.BYTES + len(made) - n for s, n in fired.items()}


def test_search_goes_on_from_its_journal(spark, tmp_path):
    gains = {("a", "b"): (1, -3, 0), ("c", "d"): (0, -2, 0), ("e", "f"): (-1, -9, 0), ("g", "h"): (0, -1, 0)}
    calls = []

    def evaluate(sets):
        calls.append(len(sets))
        return [tuple(sum(gains[p][k] for p in s) for k in range(3)) for s in sets]

    mine = lambda kept: list(gains)
    whole = fixpoint.run(evaluate, mine, str(tmp_path / "whole"), spark, 10)
    assert whole.status == "converged" and sorted(whole.kept) == [("a", "b"), ("c", "d"), ("g", "h")]
    part = fixpoint.run(evaluate, mine, str(tmp_path / "part"), spark, 1)
    assert len(part.rounds) == 1 and fixpoint.load_state(spark, str(tmp_path / "part")).kept == part.kept
    rest = fixpoint.run(evaluate, mine, str(tmp_path / "part"), spark, 10)
    assert rest.kept == whole.kept and [r["committed"] for r in rest.rounds] == [r["committed"] for r in whole.rounds]
    assert fixpoint.load_state(spark, str(tmp_path / "none")) is None
    events = fixpoint.events(spark, whole)
    assert {(r.l, r.r) for r in events.where("kind = 'commit'").collect()} == set(whole.kept)
    assert fixpoint.verdict_table(spark, whole).where("round = 1").count() == 4
    assert sinks.ledger(spark, events)[0].split()[1] == "+"
    assert [p for p, _ in fixpoint.propose(evaluate, mine, fixpoint.State())] == [("a", "b"), ("c", "d"), ("g", "h")]
    state = fixpoint.State()
    assert fixpoint.commit(evaluate, state, [("c", "d"), ("e", "f"), ("c", "d")]) == {("c", "d"): "evaporated", ("e", "f"): "evaporated"} or state.kept == [("c", "d")]
    bulk = fixpoint.State()
    assert fixpoint.harvest(evaluate, bulk, list(gains), chunk=2, clean_every=1) == 3 and sorted(bulk.kept) == sorted(whole.kept)


def test_search_over_spark(spark):
    texts = spark.createDataFrame([("the then than a hat that hat", "x"), ("an ant then the the", "y")], "text string, source string")
    held = chunks.counted(texts, by=("source",)).withColumnRenamed("source", "shard")
    e = fixpoint.Evaluator(spark, chunks.counted(texts), held, ["the", "hat"], bpe.BYTES + 10)
    none, blocked = e([[], [("t", "h")]])
    assert none[1] < blocked[1] and e.shards == 2
    state = fixpoint.State(kept=[("t", "h")], rounds=[{"committed": ("t", "h"), "verdicts": {}}])
    g = fixpoint.generalization(spark, e, state, 1).collect()
    assert [(r["round"], r.n_kept, r.d_comp) for r in g] == [(1, 1, blocked[1] - none[1])]


def test_tokenizer_files(spark, tmp_path):
    (tmp_path / "r.tiktoken").write_bytes(b"\n".join(base64.b64encode(b) + b" %d" % i for i, b in enumerate((b"a", b" b", b"\xff"))) + b"\n")
    vocab, merges = vocabularies.load_tokenizer(spark, str(tmp_path / "r.tiktoken"))
    assert merges is None and {r.id: bytes(r.bytes) for r in vocab.collect()} == {0: b"a", 1: b" b", 2: b"\xff"}
    spec = {"model": {"vocab": {"a": 0, "b": 1, "ab": 2}, "merges": ["a b"]}, "added_tokens": []}
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / "tokenizer.json").write_text(json.dumps(spec))
    _, merges = vocabularies.load_tokenizer(spark, str(tmp_path / "folder"))
    assert bpe.encoder(bpe.collected(merges))  # a loaded table encodes
    assert [(r.id, r.left, r.right) for r in merges.collect()] == [(2, 0, 1)]
    own = reports.trained_tokenizer(spark.createDataFrame([("the the then",)], "text string"), 260)
    reports.save_tokenizer(own, str(tmp_path / "saved"))
    assert as_rows(bpe.collected(vocabularies.load_tokenizer(spark, str(tmp_path / "saved"))[1])) == as_rows(bpe.collected(own))


def test_pair_subsets_and_lists(spark, tmp_path):
    (tmp_path / "p.json").write_text('[["a", "b"], ["c", "d"], ["a", "b"]]')
    pairs = vocabularies.pair_list(spark, str(tmp_path / "p.json"))
    assert [(r.ord, r.l, r.r) for r in pairs.orderBy("ord").collect()] == [(0, "a", "b"), (1, "c", "d"), (2, "a", "b")]
    assert vocabularies.subset(pairs, first=2).count() == 2
    with pytest.raises(IndexError):
        vocabularies.subset(pairs, places=[1, 7])
    source = sinks.pair_source(pairs.where("ord < 2"))
    space = {}
    exec(source, space)
    assert space["BLOCKED_PAIRS"] == [("a", "b"), ("c", "d")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, s string")
    text = sinks.write_report({"one": df}, str(tmp_path / "r"))
    assert "a\\|b" in text and spark.read.json(str(tmp_path / "r" / "one")).count() == 2
    sinks.write_series(df, str(tmp_path / "s"), ("k",))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2
    wrong = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "a", None)], "item int, gold string, pred string")
    assert sinks.write_wrong(wrong, str(tmp_path / "w")) and spark.read.json(str(tmp_path / "w")).count() == 2
    assert not sinks.write_wrong(wrong, "nosuchfs://x/y")
    sinks.append_journal(df, str(tmp_path / "j"))
    sinks.append_journal(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    born = spark.createDataFrame([("a", "b", "x", 3), ("a", "b", "y", 9)], "l string, r string, s string, fires int")
    scored = spark.createDataFrame([("a", "b", 1, 0, 0), ("c", "d", 0, 0, 0)], "l string, r string, cov int, comp int, dead int")
    assert {(r.l, r.born) for r in sinks.board(scored, born).collect()} == {("a", "y:9 x:3"), ("c", "")}


def test_few_shots_are_k_others(spark):
    for n in (1, 2, 3, 6, 12, 97):
        items = spark.createDataFrame([(f"i{i}",) for i in range(n)], "key string")
        by = {}
        for r in registers.few_shot(items, "key", 5).collect():
            by.setdefault(r.key, []).append((r.r, r.shot))
        assert len(by) == (n if n > 1 else 0)
        for key, shots in by.items():
            names = [s for _, s in sorted(shots)]
            assert len(set(names)) == len(names) == min(5, n - 1) and key not in names


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(3)
    a, b, w = rng.gamma(2, 3, 400), rng.gamma(2, 2.5, 400), rng.integers(1, 9, 400).astype(float)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, w, strict=True))], "key int, a double, b double, w double").repartition(3)
    got = registers.bootstrap(rows, "a", "b", "w", "key", 1000).first()
    assert got.n == 400
    pick = rng.integers(0, 400, (4000, 400))
    d = (a[pick].sum(1) - b[pick].sum(1)) / w[pick].sum(1)
    assert got.diff == pytest.approx((a.sum() - b.sum()) / w.sum())
    spread = np.percentile(d, 97.5) - np.percentile(d, 2.5)
    assert abs(got.low - np.percentile(d, 2.5)) < 0.15 * spread and abs(got.high - np.percentile(d, 97.5)) < 0.15 * spread


def test_noise_and_shuffles_are_shares_and_permutations(spark):
    docs = spark.createDataFrame([(i, " ".join(f"Word{k} plain" for k in range(60))) for i in range(20)], "doc_id long, text string")
    n = docs.select(F.sum(F.regexp_count(T.all_caps(F.col("text"), F.col("doc_id"), 0.25), F.lit(r"\b[A-Z]{4,}"))).alias("n")).first().n
    assert 0.15 < n / (20 * 120) < 0.35
    same = docs.where(T.double_spaces(F.col("text"), F.col("doc_id"), 0.0) != F.col("text")).count()
    assert same == 0
    items = docs.select("doc_id", F.array(*[F.lit(c) for c in "abcde"]).alias("c")).withColumn("s", registers.shuffled(F.col("c"), F.col("doc_id")))
    got = [r.s for r in items.collect()]
    assert all(sorted(s) == list("abcde") for s in got) and len({tuple(s) for s in got}) > 5


CASES = ["", "Plain text", "A b", "McDonald IBM It's x's", "É ß Ǆ Σας", "a  b   c ", " lead", "X", "Don't STOP. Now\n\nNew  line", "日本 Go 1.5 Km", "naïve Café"]


@pytest.mark.parametrize("kind", [surface.SurfaceCodec, surface.OneCapCodec, surface.OffsetCodec])
def test_codecs_round_trip(kind):
    pieces = [p.encode() for p in ("plain", "text", "don't", "stop", "now", "line", "go", "café")]
    made = tuple(bpe.train_local(pieces, [3] * len(pieces), bpe.BYTES + 20))
    codec = kind(made, 6)
    for t in CASES:
        assert codec.decode(codec.encode(t)) == t
    if kind is surface.SurfaceCodec:
        stream = codec.encode("Naïve text")
        grown = surface.growing(codec, stream)
        assert grown[-1] == "Naïve text" and all("naïve text".startswith(g.lower()) for g in grown)


def loader(docs, capacity, buffer):
    """Rows by a plain loop over a list."""
    todo, pool, rows = list(docs), [], []
    while todo or pool:
        row, used = [], []
        while len(row) < capacity:
            while todo and len(pool) < buffer:
                pool.append(todo.pop(0))
            if not pool:
                break
            fit = [x for x in pool if len(x[1]) <= capacity - len(row)]
            pick = max(fit, key=lambda x: len(x[1])) if fit else min(pool, key=lambda x: len(x[1]))
            pool.remove(pick)
            used.append(pick[0])
            row += pick[1][: capacity - len(row)]
        rows.append((used, row))
    return rows


def test_loader_rows(spark):
    rng = random.Random(4)
    docs = [(i, [rng.randrange(99) for _ in range(rng.randint(0, 14))]) for i in range(70)]
    df = surface.with_bos(spark.createDataFrame(docs, "doc_id long, ids array<int>").coalesce(1), "ids", 999)
    got = surface.shifted(surface.packed_rows(df, 11, 6, 1)).orderBy("row").collect()
    assert [(list(r.doc_ids), list(r.ids)) for r in got] == loader([(i, [999, *x]) for i, x in docs], 11, 6)
    assert all(list(r.x) == list(r.ids)[:-1] and list(r.y) == list(r.ids)[1:] for r in got)


def test_caps_and_shards(spark, tmp_path):
    for k, name in enumerate(("a", "b", "c")):
        spark.createDataFrame([(k, name)], "k int, t string").coalesce(1).write.parquet(str(tmp_path / f"x{name}"))
    (tmp_path / "flat").mkdir()
    for name in "abc":
        next((tmp_path / f"x{name}").glob("*.parquet")).rename(tmp_path / "flat" / f"{name}.parquet")
    assert corpus.last_shard(spark, str(tmp_path / "flat")).first().t == "c"
    with pytest.raises(FileNotFoundError):
        corpus.last_shard(spark, str(tmp_path))
    docs = spark.createDataFrame([(i, i // 3, "x" * 10, f"f{i % 2}") for i in range(12)], "doc_id long, batch long, text string, file string")
    assert corpus.capped_batches(docs, 40, "batch").count() == 6  # the cap is passed inside the second batch
    assert corpus.registers(docs, "batch", drop_last="file").count() == 6


def test_pass_metrics_and_reports(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    a, b = (reports.trained_tokenizer(docs, n) for n in (300, 320))
    rows = {r.name: r for r in reports.pass_metrics(docs, {"a": a, "b": b}).collect()}
    assert rows["b"].tokens < rows["a"].tokens and rows["a"].chars == rows["b"].chars and rows["b"].n_tokens == 320
    rep = reports.factoring_report(docs, 300)
    two = rep["dual"].first()
    assert two.same == two.docs
    assert metrics.longest(bpe.vocabulary(a), 3).count() == 3


def test_broadcast_only_what_was_measured(spark):
    small, large = spark.range(10), spark.range(1000).select(F.repeat(F.lit("x"), 1000).alias("t"))
    assert byte_size(small) < 1000 < 1_000_000 < byte_size(large)
    assert "broadcast" in small_side(small)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in small_side(large, 10_000)._jdf.queryExecution().analyzed().toString().lower()


def test_scratch_goes_with_its_operator(spark):
    import os

    with Scratch(spark, "gone") as s:
        t = s.staged(spark.range(5), "t")
        folder = s.folder.removeprefix("file:")
        assert t.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder) and os.path.isdir(shared_dir(spark).removeprefix("file:"))
