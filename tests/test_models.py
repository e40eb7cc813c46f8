"""Losses, surfaces, joined shards, phrases, vectors, files in order, ranges, journals: against plain computations on small input."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from corpuscle import catalog_models
from corpuscle.cluster import ship_code
from corpuscle.functions.patterns import BASE, RANK_BUCKETS
from corpuscle.operators import bpe, chunks, geometry, joined, losses, phrases, registers, search, surfaces
from corpuscle.plans import fixpoint, sinks
from corpuscle.sources import corpus, physical, vocabularies


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_code(spark)


def split(text):
    return regex.findall(BASE, text or "")


# --- losses ---


def test_losses_by_hand(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("the a cat dog sat on mat".split(), k=rng.randint(0, 20))) or None, "train" if i % 3 else "val") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, split string")
    scored = losses.scored(losses.runs(docs, "split"), "split", "train")
    one, two, three, after, after2 = Counter(), Counter(), Counter(), Counter(), Counter()
    tokens = [(s, [losses.START] * 2 + split(t)) for _, t, s in rows]
    for s, ts in tokens:
        for i in range(2, len(ts)):
            if s == "train":
                one[ts[i]] += 1
                two[tuple(ts[i - 1 : i + 1])] += 1
                three[tuple(ts[i - 2 : i + 1])] += 1
                after[ts[i - 1]] += 1
                after2[tuple(ts[i - 2 : i])] += 1
    nats, n = Counter(), Counter()
    for s, ts in tokens:
        for i in range(2, len(ts)):
            p = (one[ts[i]] + 1) / (sum(one.values()) + len(one) + 1)
            if after[ts[i - 1]]:
                p = 0.7 * two[tuple(ts[i - 1 : i + 1])] / after[ts[i - 1]] + 0.3 * p
            if after2[tuple(ts[i - 2 : i])]:
                p = 0.7 * three[tuple(ts[i - 2 : i + 1])] / after2[tuple(ts[i - 2 : i])] + 0.3 * p
            nats[s, ts[i]] -= math.log(p)
            n[s, ts[i]] += 1
    got = {(r.split, r.token): r for r in scored.groupBy("split", "token").agg(F.sum("nats").alias("nats"), F.sum("n").alias("n"), F.max("rank").alias("rank")).collect()}
    assert {k: r.n for k, r in got.items()} == n
    assert all(got[k].nats == pytest.approx(nats[k]) for k in n)
    assert all(got[k].rank == sum(c > one[k[1]] for c in one.values()) for k in n if one[k[1]])
    nothing = losses.scored(losses.runs(docs.where("false"), "split"), "split", "train")
    assert losses.by_rank(nothing, "split").isEmpty()


def test_buckets_of_ranks(spark):
    ranks = [None, 0, 255, 256, 40_000]
    got = [r.b for r in spark.createDataFrame([(r,) for r in ranks], "r long").select(losses.bucket(F.col("r"), RANK_BUCKETS).alias("b")).collect()]
    assert got == [-1, 0, 0, 256, 32768]


# --- surfaces ---


def by_alternation(texts, words):
    pattern = re.compile(r"(?<![A-Za-z])(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")(?![A-Za-z])")
    return Counter(m[1] for t in texts for m in pattern.finditer(t or ""))


def test_surfaces_equal_the_alternation(spark, sf_dir):
    rng = random.Random(2)
    letters = ["a", "b", " ", "é", "-", "'", "中", "ab", "а", "\n", "1"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(300)] + [None, "", "aaaa" * 1000]
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(60)})
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    found = surfaces.standalone(docs, spark.createDataFrame([(w,) for w in [*words, "", words[0]]], "word string"))
    want = by_alternation(texts, words)
    assert {r.word: r.n for r in found.collect()} == {w: want[w] for w in words}
    assert surfaces.standalone(docs, spark.createDataFrame([], "word string")).isEmpty()
    got = {r.word: r.n for r in catalog_models.standalone_surfaces(spark, sf_dir).collect()}
    whole = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    want = by_alternation(whole, list(got))
    assert got == {w: want[w] for w in got} and sum(" " in w and n > 0 for w, n in got.items()) > 0


# --- joined shards ---


def test_joined_shards_equal_the_joined_text(spark, monkeypatch):
    rng = random.Random(3)
    pieces = ["a", "Ab", " ", "  ", "\n", "\n\n", "\t", "'", "'s", "12", "3", "!", "?!\n", "é", "　", ""]
    rows = [(i, rng.choice(["x", "x", "y", None]), rng.choice([None, ""]) if rng.random() < 0.2 else "".join(rng.choices(pieces, k=rng.choice((1, 1, 2, 6))))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, shard string, text string").repartition(3)
    want = Counter()
    for shard in ("x", "y", ""):
        want.update((shard, c) for c in split("".join(t or "" for _, s, t in rows if (s or "") == shard)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that ranges are many
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = {(r.shard, r.chunk): r.n for r in joined.counted_joined(docs, "shard").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want
    assert joined.counted_joined(docs.where("false"), "shard").isEmpty()


def test_joined_borders_that_move_again_and_again(spark):
    """Ranges that are white space or one word through and through hand pieces on over several ranges."""
    rows = [(i, "x", t) for i, t in enumerate([" "] * 30 + ["\n"] * 5 + ["ab"] * 30 + [" "] * 20 + ["c"])]
    docs = spark.createDataFrame(rows, "doc_id long, shard string, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = {r.chunk: r.n for r in joined.counted_joined(docs, "shard").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == Counter(split("".join(t for *_, t in rows)))


# --- phrases ---


def test_two_passes_by_hand(spark):
    rng = random.Random(4)
    words = ["of", "the", "one", "to", "be", "cat"]
    texts = [" " + " ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(60)] + [None, ""]
    glue = [" of", " the", " one", " to", " be"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    count = Counter()
    for t in texts:
        c = split(t)
        count.update((a, b) for a, b in zip(c, c[1:], strict=False) if a in glue and b in glue)
    order = lambda counted, most: sorted((p for p, n in counted.items() if n >= 2), key=lambda p: (-counted[p], p))[:most]

    def stay(pairs):
        out, taken = [], set()
        for a, b in pairs:
            if a not in taken:
                out.append((a, b))
                taken.add(b)
        return out

    first = stay(order(count, 10))
    again = Counter()
    for t in texts:
        c, fused, i = split(t), [], 0
        while i < len(c):
            if i + 1 < len(c) and (c[i], c[i + 1]) in first:
                fused.append((c[i] + c[i + 1], True))
                i += 2
            else:
                fused.append((c[i], False))
                i += 1
        again.update((a, b) for (a, x), (b, y) in zip(fused, fused[1:], strict=False) if x and not y and b in glue)
    second = stay(order(again, 8))
    got = [tuple(r) for r in phrases.mined(docs, glue, glue, 10, 8).collect()]
    assert got == [*((1, k, *p, count[p]) for k, p in enumerate(first)), *((2, k, *p, again[p]) for k, p in enumerate(second))] and len(second) > 1
    assert phrases.mined(docs.where("false"), glue, glue).isEmpty()


# --- vectors ---


def test_shape_of_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((90, 6)).cumsum(0)
    rows = [(i, i // 30, x.tolist()) for i, x in enumerate(v)] + [(200, 9, None), (201, 9, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (202, 9, [1.0]), (203, 9, [])]
    table = spark.createDataFrame(rows, "vec_id long, run long, embedding array<double>").repartition(4)
    cov = np.cov(v.T, bias=True)
    got = geometry.spread(geometry.covariance(table)).first()
    assert (got.n, got.dims) == (90, 6)
    assert got.mean_variance == pytest.approx(np.trace(cov) / 6) and got.effective_rank == pytest.approx(np.trace(cov) ** 2 / (cov**2).sum())
    cos = lambda a, b: (a * b).sum() / max(np.sqrt((a * a).sum() * (b * b).sum()), 1e-8)
    for r in geometry.straightness(table, "run", "vec_id", (1, 4)).collect():
        d = r.span
        want = [cos(v[i + d] - v[i], v[i + 2 * d] - v[i + d]) for i in range(90) if i // 30 == (i + 2 * d) // 30]
        assert r.n == len(want) and r.cosine == pytest.approx(np.mean(want))


# --- files in order ---


@pytest.fixture
def shards(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder, k, out = tmp_path / "with space+%20" / "docs.parquet", 0, []
    folder.mkdir(parents=True)
    for f in range(6):
        n = 20 + f
        rows = [(100 - k - i, "x" * (5 + (k + i) % 7) if (k + i) % 11 else None) for i in range(n)]
        pq.write_table(pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]}), folder / f"part-{f:03}.parquet", row_group_size=8)
        out += [(f, i, *r) for i, r in enumerate(rows)]
        k += n
    return str(folder), out


@pytest.mark.parametrize("cap", [0, 1, 150, 151, 600, 10_000])
@pytest.mark.parametrize("size", [None, 3])
def test_batches_in_the_files_order(spark, shards, cap, size):
    path, rows = shards
    assert physical.row_groups(spark, physical.files(spark, path)[0]) == [8, 8, 4]
    want, total, last = [], 0, None
    for f, i, d, t in rows:
        batch = (f, i // 8, (i % 8) // (size or 8))
        if batch != last:
            if total >= cap:
                break
            last = batch
        want.append((d, f, i))
        total += len(t or "")
    got = physical.capped_by_batch(spark, path, cap, "doc_id", rows_a_batch=size)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1:]) == want
    one_by_one, total = [], 0
    for f, i, d, t in rows:
        if total >= cap:
            break
        one_by_one.append((d, f, i))
        total += len(t or "")
    assert sorted(map(tuple, physical.capped_by_document(spark, path, cap, "doc_id").collect()), key=lambda r: r[1:]) == one_by_one


def test_files_behind_the_cap_are_not_read(spark, shards):
    path, _ = shards
    got = physical.capped_by_batch(spark, path, 100, "doc_id")
    assert len(got.inputFiles()) == 1 and len(physical.capped_by_batch(spark, path, 10_000, "doc_id").inputFiles()) == 6
    from pathlib import Path

    (Path(path) / "part-005.parquet").write_bytes(b"no parquet at all")
    assert physical.capped_by_document(spark, path, 100, "doc_id").count() > 0  # neither it nor its footer was looked at


# --- ranges ---


def many_ranges(spark, run):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_registers_are_read_as_one_text(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("xy"), rng.choice(["", "", "a", "ab", "it's so", "one two three", "?"])) for i in range(200)]
    texts = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    for kind in ("word", "bigram", "char4"):
        want = Counter()
        for lang in "xy":
            whole = "\n".join(t for _, s, t in rows if s == lang)
            ws = re.findall("[a-z']+", whole)
            own = ws if kind == "word" else [f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False)] if kind == "bigram" else [whole[i : i + 4] for i in range(len(whole) - 3)]
            want.update((lang, g) for g in own)
        got = many_ranges(spark, lambda kind=kind: {(r.lang, r.gram): r.n for r in registers.grams(texts, kind, "lang", order="doc_id").collect()})
        assert got == want, kind


def test_caps_by_ranges(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["x", "y", None]), "t" * rng.randint(0, 9) if rng.random() > 0.1 else None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, shard string, text string").repartition(5)
    for cap, shard, after in ((200, None, False), (200, "shard", False), (100, "shard", True), (0, None, False), (0, None, True)):
        want, total = set(), defaultdict(int)
        for i, s, t in rows:
            key = s if shard else None
            if total[key] < cap or (after and total[key] <= cap):
                want.add(i)
            total[key] += len(t or "")
        got = many_ranges(spark, lambda cap=cap, shard=shard, after=after: {r.doc_id for r in corpus.capped(docs, cap, shard=shard, after=after).collect()})
        assert got == want
    twice = docs.union(docs)
    assert corpus.capped(twice, 10**6).count() == 600
    whole = {s: "".join(t or "" for _, x, t in rows if x == s)[:100] for s in ("x", "y")}
    assert {r.shard: r.text for r in vocabularies.ranked_texts(docs.where("shard is not null"), "shard", 100).collect()} == whole


def test_intervals_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(f"k{i}", "g" if i % 3 else None, float(a), float(b), 1.0) for i, (a, b) in enumerate(rng.random((200, 2)))], "key string, g string, a double, b double, w double")
    got = [sorted(registers.bootstrap(rows.repartition(k), "a", "b", "w", "key", 300, by=("g",)).collect(), key=str) for k in (1, 6)]
    for x, y in zip(*got, strict=True):
        assert (x.g, x.n) == (y.g, y.n) and x.low == pytest.approx(y.low) and x.high == pytest.approx(y.high)


# --- journals ---


def test_a_round_goes_on_behind_its_last_batch(spark, tmp_path):
    """The search stops in the middle of its second round; it goes on without scoring a batch again, and ends as one that never stopped."""
    gains = {(a, b): (0, -k, 0) for k, (a, b) in enumerate([("a", "b"), ("c", "d"), ("e", "f"), ("g", "h"), ("i", "j")], 1)}
    seen: list = []

    def evaluate(sets, stop_at=None):
        seen.extend(sets)
        if stop_at and len(seen) > stop_at:
            raise RuntimeError("the driver is gone")
        return [tuple(sum(gains[p][k] for p in s) for k in range(3)) for s in sets]

    mine = lambda kept: list(gains)
    whole = fixpoint.run(evaluate, mine, str(tmp_path / "whole"), spark, 3, batch=2)
    total = len(seen)
    seen.clear()
    with pytest.raises(RuntimeError):
        fixpoint.run(lambda sets: evaluate(sets, 13), mine, str(tmp_path / "cut"), spark, 3, batch=2)
    state = fixpoint.load_state(spark, str(tmp_path / "cut"))
    assert len(state.rounds) == 1 and 0 < len(state.scored) < 4 and state.ejected is not None
    before, state_scored = len(seen), set(state.scored)
    done = fixpoint.run(evaluate, mine, str(tmp_path / "cut"), spark, 3, batch=2)
    assert done.kept == whole.kept and [r["committed"] for r in done.rounds] == [r["committed"] for r in whole.rounds]
    assert [r["verdicts"] for r in done.rounds] == [r["verdicts"] for r in whole.rounds]
    second = [s[-1] for s in seen[before:] if len(s) == 2]
    assert state_scored.isdisjoint(second[: 4 - len(state_scored)]) and total > 0


def test_commits_are_journalled(spark, tmp_path):
    gains = {("a", "b"): (0, -3, 0), ("c", "d"): (0, -2, 0), ("x", "y"): (0, 5, 0)}
    evaluate = lambda sets: [tuple(sum(gains[p][k] for p in s) for k in range(3)) for s in sets]
    for name, act in (("commit", lambda s, j: fixpoint.commit(evaluate, s, list(gains), journal=j)), ("harvest", lambda s, j: fixpoint.harvest(evaluate, s, list(gains), journal=j))):
        folder, state = str(tmp_path / name), fixpoint.State()
        act(state, lambda s, folder=folder: fixpoint.save_state(spark, s, folder))
        back = fixpoint.load_state(spark, folder)
        assert back.kept == state.kept == [("a", "b"), ("c", "d")] and back.saves == 2
    # Of two states the newer one counts, be it the shorter.
    folder, state = str(tmp_path / "order"), fixpoint.State(kept=[("a", "b"), ("c", "d")])
    fixpoint.save_state(spark, state, folder)
    state.kept = []
    fixpoint.save_state(spark, state, folder)
    assert fixpoint.load_state(spark, folder).kept == []


def test_wrong_answers_are_written_or_told(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, None, "b")], "item int, gold string, pred string")
    assert sinks.write_wrong(rows, str(tmp_path / "wrong")) and spark.read.json(str(tmp_path / "wrong")).count() == 2
    (tmp_path / "file").write_text("in the way")
    assert not sinks.write_wrong(rows, str(tmp_path / "file"))
    with pytest.raises(Exception, match="nowhere"):
        sinks.write_wrong(rows.withColumn("pred", F.expr("nowhere")), str(tmp_path / "wrong"))


def test_search_over_documents_by_hand(spark, sf_dir):
    """The registered search against the same search with a vocabulary trained and a corpus encoded for each set, here."""
    got = {(r["round"], r.l, r.r): (r.cov, r.comp, r.dead, r.kept) for r in catalog_models.heldout_search(spark, sf_dir).collect()}
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = {r.word for r in corpus.words_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")).collect()}
    train = {r.chunk: r.n for r in chunks.counted(d.where("doc_id % 5 <> 0").select("text")).collect()}
    held = [tuple(r) for r in chunks.counted(d.where("doc_id % 5 = 0").select("source", "text"), by=("source",)).collect()]
    size, sources = bpe.BYTES + 64, {s for s, *_ in held}

    def vocabulary(barred):
        return bpe.train_local([c.encode() for c in train], list(train.values()), size, bpe.Rules.of(barred))

    def evaluate(sets):
        out = []
        for barred in sets:
            made = vocabulary(barred)
            rule_of = {(m.left, m.right): m.id for m in made}
            ids = {c: bpe.encode_word(list(c.encode()), rule_of) for _, c, _ in held}
            fired = defaultdict(set)
            for s, c, _ in held:
                fired[s].update(ids[c])
            names = [m.bytes.decode(errors="replace") for m in made]
            cov = sum(n.startswith(" ") and (n[1:].lower() in words or bpe.inflects(n[1:].lower(), frozenset(words))) for n in [*names, " "])
            tokens, dead = sum(n * len(ids[c]) for _, c, n in held), sum(len(made) + 256 - len(f) for f in fired.values())
            out.append((cov, round(tokens * 10 / len(sources)), round(dead * 10 / len(sources))))
        return out

    def mine(kept):
        made = vocabulary(tuple(kept))
        rule_of, fires = {(m.left, m.right): m.id for m in made}, Counter({m.id: 0 for m in made})
        for c, n in train.items():
            for i in bpe.encode_word(list(c.encode()), rule_of):
                if i in fires:
                    fires[i] += n
        order = sorted(fires, key=lambda i: (fires[i], i))
        cut = fires[order[int(0.4 * (len(order) - 1))]]
        whole = {i: bytes((i,)) for i in range(256)} | {m.id: m.bytes for m in made}
        parts = {m.id: (whole[m.left], whole[m.right]) for m in made}
        rare = [i for i in order if fires[i] <= cut][:24]
        return [tuple(x.decode() for x in parts[i]) for i in rare if all(regex.fullmatch(r"(?s).*", x.decode(errors="ignore")) and x.decode(errors="ignore").encode() == x for x in parts[i])]

    state = search.search(evaluate, mine, rounds=2, comp_tolerance=20, dead_tolerance=10)
    want = {(k, *p): (*v, p in state.kept) for k, r in enumerate(state.rounds, 1) for p, v in r["verdicts"].items()}
    assert got == want and len(want) > 20
