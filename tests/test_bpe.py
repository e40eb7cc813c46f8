"""Training, encoding and decoding of byte-pair vocabularies: rules, mode equality, round trips."""

import random

import pytest
from pyspark.sql import functions as F

from corpuscle.functions.patterns import BASE
from corpuscle.operators import bpe, chunks, metrics, morphology

TEXTS = ["the cat sat on the mat, the end", "a thin theory of the thing", "xyxy xy 12345 xyz", "Über Łódź naïve café  \n\n  tabs\t"] * 5


@pytest.fixture(scope="module")
def counted(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return docs, chunks.counted(docs.select("text")).persist()


def test_chunks_join_to_the_text(spark):
    texts = ["it's  a b  c　", "", "\t x\r\n\r\n y", "ǅ İ á", "1234 56,7!!"]
    rows = chunks.positioned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BASE).orderBy("doc_id", "pos").collect()
    for i, t in enumerate(texts):
        assert "".join(r.chunk for r in rows if r.doc_id == i) == t


def test_chunks_agree_with_the_regex_module(spark):
    import regex

    texts = [*TEXTS[:4], "a\u0085b  c", "  lead", "trail  ", "x's 'LL we'Re"]
    rows = chunks.positioned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BASE).orderBy("doc_id", "pos").collect()
    for i, t in enumerate(texts):
        assert [r.chunk for r in rows if r.doc_id == i] == regex.findall(BASE.replace("(?i:", "(?i:"), t)


def test_modes_agree(counted):
    _, c = counted
    a = bpe.collected(bpe.train(c, bpe.BYTES + 10, mode="task"))
    b = bpe.collected(bpe.train(c, bpe.BYTES + 10, mode="dataframe"))
    assert a == b and len(a) == 10


def test_ties_go_to_the_least_pair():
    made = bpe.train_local([b"ba", b"ab"], [1, 1], bpe.BYTES + 1)
    assert (made[0].left, made[0].right) == (ord("a"), ord("b"))


def test_repeats_merge_from_the_left():
    made = bpe.train_local([b"aaaaa"], [3], bpe.BYTES + 2)
    assert made[0].n == 12 and made[1].bytes == b"aaa"  # (aa, a) and (aa, aa) both occur three times; the lesser pair wins


def test_blocked_pair_is_absent(counted):
    _, c = counted
    free = {m.bytes for m in bpe.collected(bpe.train(c, bpe.BYTES + 40, mode="task"))}
    barred = {m.bytes for m in bpe.collected(bpe.train(c, bpe.BYTES + 40, bpe.Rules.of((("x", "y"),)), "task"))}
    assert b"xy" in free and b"xy" not in barred


def test_space_rules():
    lines = [b"go to the    old house", b"go to it    now"]
    free = bpe.train_local(lines, [50, 50], bpe.BYTES + 60)
    barred = bpe.train_local(lines, [50, 50], bpe.BYTES + 60, bpe.Rules(leading_space=True, trailing_space=True))
    crossing = lambda made: [m for m in made if b" " in m.bytes.strip(b" ") or (m.bytes.endswith(b" ") and m.bytes.strip(b" "))]
    assert crossing(free) and not crossing(barred)
    assert any(m.bytes == b"    " for m in barred)


def test_forced_pairs_reuse_ids_skip_and_fill():
    rules = bpe.Rules.of(blocked=(("q", "z"),), forced=(("a", "b"), ("ab", "c"), ("q", "z"), ("nope!", "x")))
    made = bpe.train_local([b"abcabd", b"bcbc"], [5, 3], bpe.BYTES + 6, rules)
    forced = [m for m in made if m.forced]
    assert [m.bytes for m in forced] == [b"ab", b"abc"]
    assert len({m.id for m in made}) == len({m.bytes for m in made})


def test_encodings_agree_and_come_back(spark, counted):
    docs, c = counted
    merges = bpe.train(c, bpe.BYTES + 40, mode="task")
    made = bpe.collected(merges)
    by_pair, by_bytes = bpe.encoder(made), bpe.encoder(made, "bytes")
    folded = {r.chunk: r.w for r in bpe.folded_encode(c.withColumn("w", bpe.word(F.col("chunk"))), made).collect()}
    for chunk, w in folded.items():
        ids = by_pair(chunk)
        assert ids == by_bytes(chunk)
        assert "".join(f"<{bpe.token_name(i)}>" for i in ids) == w
    rows = bpe.token_rows(docs, made, BASE).withColumn("pos", F.struct("cpos", "tpos"))
    back = {r.doc_id: r.text for r in bpe.decoded(rows.select("doc_id", "pos", "id"), bpe.vocabulary(merges), "doc_id").collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS))


def test_density_and_specials(counted):
    _, c = counted
    merges = bpe.train(c, bpe.BYTES + 5, mode="task")
    v = bpe.vocabulary(merges, ("<bos>",))
    d = bpe.density(v).first()
    assert d.n_holes == 0 and d.n_same_bytes == 0 and d.max_id == 261
    assert bpe.missing_ids(v.where("id <> 7")).first().id == 7


def test_percentile(spark):
    rows = [(i, bytes((i,)), 0) for i in range(4)] + [(256 + k, b"ab" + bytes((k,)), f) for k, f in enumerate((500, 500, 100, 3, 8, 50))]
    vocab = spark.createDataFrame([(i, b, False) for i, b, _ in rows], "id int, bytes binary, is_special boolean")
    fires = spark.createDataFrame([(i, f) for i, _, f in rows if f], "id int, fires long")
    got = [{r.id for r in morphology.below_percentile(vocab, fires, p).collect()} for p in (0, 20, 50, 100)]
    assert not got[0] and got[0] <= got[1] <= got[2] <= got[3] and min(got[3]) >= 256 and got[1] == {259, 260}


def test_metrics_on_a_known_table(spark):
    enc = spark.createDataFrame([("ab", 3, [256]), ("abc", 2, [256, 99])], "chunk string, n long, ids array<int>")
    fires = {r.id: (r.fires, r["first"], r["last"]) for r in metrics.fire_counts(enc).collect()}
    assert fires == {256: (5, 5, 3), 99: (2, 0, 2)}
    t = metrics.totals(enc).first()
    assert (t.tokens, t.chars, t.bytes) == (7, 12, 12)


def test_unshadowed():
    assert morphology.unshadowed([("a", "b"), ("b", "c"), ("c", "d")]) == [("a", "b"), ("c", "d")]


def test_packed_rows_are_full(spark):
    """Rows of a loader are full but for the last, hold each document once, and don't depend on partitions. Four documents of two rows, as a loader's test has them."""
    from corpuscle.operators import surface

    random.seed(1)
    docs = spark.createDataFrame([(i, [random.randrange(9) for _ in range(random.randint(0, 60))]) for i in range(200)], "doc_id long, ids array<int>")
    got = [sorted((r.loader, r.row, tuple(r.doc_ids), r.crops, tuple(r.ids)) for r in surface.packed_rows(docs.repartition(k), 64, 30, 3).collect()) for k in (1, 5)]
    assert got[0] == got[1] and {r[0] for r in got[0]} == {0, 1, 2}
    last = {r[0]: r[1] for r in got[0]}
    assert all(len(r[4]) == 64 for r in got[0] if r[1] < last[r[0]])
    with_tokens = sorted(r.doc_id for r in docs.collect() if r.ids)
    assert sorted(d for r in got[0] for d in r[2]) == with_tokens
    few = spark.createDataFrame([(i, [7] * n) for i, n in enumerate((30, 20, 40, 10))], "doc_id long, ids array<int>")
    assert [(list(r.doc_ids), len(r.ids), r.crops) for r in surface.packed_rows(few, 49, 6, 1).orderBy("row").collect()] == [([2, 3], 49, 1), ([0, 1], 49, 1)]
    assert surface.packed_rows(few.where("false"), 49).isEmpty()
