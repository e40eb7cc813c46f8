"""Dual stream round trips, gates and the search loop, text functions."""

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.operators import bpe, registers, search, surface

WORDS = ["Of The Rings of the ring", "Łódź in the park", "Ελληνικά and The City", "NASA McDonald İstanbul ǅ", "  two  spaces\n\n New line ", "", " ", "a", "Éa éA"]


@pytest.fixture(scope="module")
def codec():
    pieces = [w for t in WORDS for w in surface.fold(t).split(" ") if w] * 5
    return surface.SurfaceCodec(tuple(bpe.train_local([p.encode() for p in pieces], [1] * len(pieces), bpe.BYTES + 40)), 6)


def test_stream_comes_back(codec):
    for t in WORDS:
        assert codec.decode(codec.encode(t)) == t
        assert codec.byte_count(codec.encode(t)) == len(t.encode())


def test_capital_patterns(codec):
    caps = lambda t: [b for *_, bits, mask in codec.encode(t) for b, m in zip(bits, mask, strict=True) if m]
    assert [caps(t) for t in ("of the", "Of The", "Of the", "of The")] == [[0, 0], [1, 1], [1, 0], [0, 1]]


def test_fold_agrees_with_columns(spark):
    rows = spark.createDataFrame([(t,) for t in WORDS], "text string").select("text", T.fold_case(F.col("text")).alias("f")).collect()
    assert all(r.f == surface.fold(r.text) for r in rows)


def test_stream_in_frames(spark, codec):
    d = spark.createDataFrame(list(enumerate(WORDS)), "doc_id long, text string")
    rows = surface.decoded(surface.encoded(d, codec), codec).collect()
    assert all(r.decoded == r.text for r in rows)


def test_search_commits_what_helps_and_converges():
    worth = {("a", "b"): (1, -5, 0), ("c", "d"): (0, -2, 0), ("e", "f"): (0, 3, 0)}

    def evaluate(sets):
        return [tuple(sum(worth[p][k] for p in s) for k in range(3)) for s in sets]

    s = search.search(evaluate, lambda kept: list(worth), rounds=10)
    assert s.kept == [("a", "b"), ("c", "d")] and s.status == "converged"


def test_search_ejects_what_stops_helping():
    def evaluate(sets):
        out = []
        for s in sets:
            out.append((len(s) - 2 * ({("a", "b"), ("c", "d")} <= set(s)), 0, 0) if s else (0, 0, 0))
        return out

    s = search.search(evaluate, lambda kept: [("a", "b"), ("c", "d")], rounds=4)
    assert len(s.kept) == 1


def test_gate_in_frames_and_rows_agree(spark):
    rows = [(c, p, d) for c in (-1, 0, 1) for p in (-2, 0, 2, 9) for d in (-1, 0, 2)]
    t = spark.createDataFrame(rows, "c int, p int, d int").select("*", search.gate(F.col("c"), F.col("p"), F.col("d"), 2, 3).alias("k")).collect()
    assert all(r.k == search.passes((r.c, r.p, r.d), 2, 3) for r in t)


def test_tenths_round_halves_to_even(spark):
    r = spark.range(1).select(search.tenths(F.lit(25), 100).alias("a"), search.tenths(F.lit(35), 100).alias("b"), search.tenths(F.lit(-126), 10).alias("c")).first()
    assert (r.a, r.b, r.c) == (2, 4, -126)


def test_text_functions(spark):
    r = spark.range(1).select(
        T.stems(F.lit("parties")).alias("stems"), T.longest_affix(F.lit("nationalization"), ["ization", "ation", "ion"]).alias("affix"), T.common_prefix(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (1, 2, 4, 5)))).alias("pre"),
        T.common_suffix(F.array(*map(F.lit, (9, 2, 3))), F.array(*map(F.lit, (2, 3)))).alias("suf"), T.bucket(F.lit(1.2), (1.0, 1.2, 1.5)).alias("b"), T.binary_entropy(F.lit(0.5)).alias("h"), T.binary_entropy(F.lit(0.0)).alias("z"),
    ).first()
    assert set(r.stems) == {"partie", "parti", "party"} and r.affix == "ization" and (r.pre, r.suf, r.b, r.h, r.z) == (2, 2, 2, 1.0, 0.0)


def test_perturbations_keep_what_they_must(spark):
    r = spark.createDataFrame([(1, "The cat sat On a mat")], "k long, t string").select(T.flipped_titlecase(F.col("t"), F.col("k"), 1.0).alias("f"), T.all_caps(F.col("t"), F.col("k"), 1.0).alias("c"), T.double_spaces(F.col("t"), F.col("k"), 1.0).alias("s")).first()
    assert r.f == "the Cat Sat on A Mat" and r.c == "THE CAT SAT ON A MAT" and r.s == "The  cat  sat  On  a  mat"


def test_swap_and_shots(spark):
    items = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id long, t string")
    s = registers.swapped(items, "id", "t").collect()
    assert len(s) == 7 and all(r.t != r.t_swapped for r in s)
    f = registers.few_shot(items, "id", 3).collect()
    assert len(f) == 21 and all(r.id != r.shot for r in f)
