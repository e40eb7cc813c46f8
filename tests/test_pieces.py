"""Training and measuring on pieces of chunks give what whole chunks give."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import bpe, evaluation


def _chunks(spark, seed=3, lines=False):
    draw = random.Random(seed)
    words = [" the", " then", " cat", " cattle", "aaaa", "aaa", "ï", " über", "banana", " anan"]
    rows = {w: draw.randint(50, 900) for w in words}
    rows |= {"".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(draw.randint(1, 24))): draw.randint(1, 3) for _ in range(400)}
    if lines:
        rows = {" ".join(draw.choice(words).strip() for _ in range(6)) + "  x": n for n in range(1, 300)}
    return spark.createDataFrame(list(rows.items()), "chunk string, n long"), rows


@pytest.mark.parametrize("rules", [bpe.Rules(), bpe.Rules.of(blocked=(("t", "h"),)), bpe.Rules.of(forced=(("q", "z"), ("qz", "t")))])
@pytest.mark.parametrize("merges", [3, 16, 150])
def test_pieces_train_what_chunks_train(spark, rules, merges):
    df, rows = _chunks(spark)
    want = bpe.train_local([c.encode() for c in rows], list(rows.values()), bpe.BYTES + merges, rules)
    assert sorted(map(str, bpe.collected(bpe.train(df, bpe.BYTES + merges, rules)))) == sorted(map(str, want))


def test_pieces_of_lines_under_space_rules(spark):
    df, rows = _chunks(spark, lines=True)
    rules = bpe.Rules(leading_space=True, trailing_space=True)
    want = bpe.train_local([c.encode() for c in rows], list(rows.values()), bpe.BYTES + 14, rules)
    assert sorted(map(str, bpe.collected(bpe.train(df, bpe.BYTES + 14, rules)))) == sorted(map(str, want))


def test_a_guess_too_high_is_mended(spark, monkeypatch):
    df, rows = _chunks(spark)
    want = bpe.train_local([c.encode() for c in rows], list(rows.values()), bpe.BYTES + 30, bpe.Rules())
    monkeypatch.setattr(bpe, "first_least", lambda *_: 1 << 20)
    assert sorted(map(str, bpe.collected(bpe.train(df, bpe.BYTES + 30)))) == sorted(map(str, want))


def test_pieces_are_few(spark):
    """Random chunks, all of them distinct, leave few pieces; the one task of a training sees these alone."""
    draw = random.Random(5)
    rows = [("".join(draw.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(30)), 1) for _ in range(5000)] + [(" the", 90000), (" and", 80000), (" hand", 70000)]
    df = spark.createDataFrame(rows, "chunk string, n long")
    sums = bpe.pair_sums(df)
    own = bpe.pieces(df, bpe.mergeable(sums, bpe.first_least(sums, 4)))
    assert own.count() < 100
    assert own.agg(F.sum(F.octet_length("chunk"))).first()[0] < 1000


def test_candidates_on_pieces(spark, monkeypatch):
    """Tokens and dead tokens of each candidate are those of encoding whole chunks, and the task doesn't see the random ones."""
    df, rows = _chunks(spark)
    held = {w: n + 1 for k, (w, n) in enumerate(rows.items()) if k % 3} | {"zqzq": 4, " thethe": 7}
    h = spark.createDataFrame([("x" if len(w) % 2 else "y", w, n) for w, n in held.items()], "shard string, chunk string, n long")
    rules = [bpe.Rules(), bpe.Rules.of(blocked=((" t", "h"), ("a", "n"))), bpe.Rules.of(forced=(("z", "q"),))]
    for guess in (None, 1 << 20):
        if guess:
            monkeypatch.setattr(evaluation, "first_least", lambda *_: guess)
        got = {r.cand: r for r in evaluation.evaluate_candidates(spark, df, h, ["the"], list(enumerate(rules)), bpe.BYTES + 12).collect()}
        for k, r in enumerate(rules):
            made = bpe.train_local([c.encode() for c in rows], list(rows.values()), bpe.BYTES + 12, r)
            encode = bpe.encoder(made)
            assert got[k].error is None
            for s, odd in (("x", 1), ("y", 0)):
                own = {w: n for w, n in held.items() if len(w) % 2 == odd}
                assert got[k].tokens[s] == sum(n * len(encode(w)) for w, n in own.items())
                assert got[k].dead[s] == bpe.BYTES + 12 - len({t for w in own for t in encode(w)})


@pytest.mark.parametrize("forced", [False, True])
def test_texts_encoded_without_a_shuffle(spark, forced):
    from corpuscle.functions.patterns import BASE

    texts = [(1, "The cat, the cattle  and\nÜber ï €"), (2, None), (3, ""), (4, "then the then")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    made = bpe.train_local([b" the", b"then", b" cat"], [9, 5, 3], bpe.BYTES + 5, bpe.Rules.of(forced=((" ", "c"),)) if forced else bpe.Rules())
    got = {r.doc_id: r for r in bpe.encoded_texts(docs, made, BASE).collect()}
    want = {}
    for r in bpe.token_rows(docs, made, BASE).collect():
        want.setdefault(r.doc_id, []).append((r.cpos, r.tpos, r.id))
    assert {d: list(r.ids or []) for d, r in got.items()} == {d: [i for *_, i in sorted(want.get(d, []))] for d, _ in texts}
    back = {r.doc_id: bytes(r.raw).decode() for r in bpe.decoded_bytes(bpe.encoded_texts(docs, made, BASE), made).collect()}
    assert back == {d: t or "" for d, t in texts}
    assert "Exchange" not in bpe.encoded_texts(docs, made, BASE)._jdf.queryExecution().executedPlan().toString()


def _letters(n):
    sizes = np.full(n // 8, 8)
    return np.random.default_rng(1).integers(97, 101, sizes.sum()).astype(np.uint8), sizes, np.ones(len(sizes), np.int64)


def test_one_task_holds_little(monkeypatch):
    """Under 40 bytes for each byte that it trains on: at MOST_IN_TASK that stays well under 4 GB."""
    monkeypatch.setattr(bpe._Trainer, "SORTED", 1 << 18, raising=False)
    data, sizes, counts = _letters(3_000_000)
    tracemalloc.start()
    try:
        bpe._Trainer(data, sizes, counts, bpe.Rules()).natural(bpe.BYTES + 4)
        assert tracemalloc.get_traced_memory()[1] < 40 * len(data)
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("large", [1, (1 << 31) - 1, 1 << 33])
def test_places_sorted_in_blocks(monkeypatch, large):
    """Blocks cut within chunks, and counts whose sums, or which themselves, take more than 32 bits."""
    chunks = [b"aaaaa", b"", b"b", b"abab", b"baab", b"\xff\xfe\xff\xfe", b"cab", b"aab"]
    counts = [large, 5, 5, large, 3, 2, 1, 7]
    want = bpe.train_local(chunks, counts, bpe.BYTES + 9)
    assert want[0].n == max(4 * large + 3 + 7, 2 * large + 3 + 1 + 7)
    for block in (1, 2, 3, 7):
        monkeypatch.setattr(bpe._Trainer, "SORTED", block, raising=False)
        assert bpe.train_local(chunks, counts, bpe.BYTES + 9) == want
