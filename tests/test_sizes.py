"""Steps that cost too much on large tables: what was made twice, spread over rows of tokens, or held whole."""

import pytest
from pyspark.sql import functions as F

from corpuscle import catalog
from corpuscle.functions.patterns import BASE
from corpuscle.operators import bpe, registers
from corpuscle.plans import reports
from corpuscle.streaming import decoding


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "a", "the cat, thé cattle"), (2, "b", None), (3, "a", "€ then the hen")], "doc_id long, source string, text string")


@pytest.fixture(scope="module")
def made():
    return bpe.train_local([b" the", b"then", b" cat"], [9, 5, 3], bpe.BYTES + 5)


def test_round_trips_need_no_rows_of_tokens(spark, docs, made):
    rep = reports.tokenizer_report(docs.select("doc_id", "text"), spark.createDataFrame(bpe._frame(made), bpe.MERGES))
    assert rep["round_trip"].first().asDict() == {"docs": 3, "same": 3}
    assert "posexplode" not in plan(rep["round_trip"]) and "Join" not in plan(rep["round_trip"])


def test_compared_texts_are_split_once(spark, docs, made):
    both = [spark.createDataFrame(bpe._frame(m), bpe.MERGES) for m in (made[:2], made)]
    rep = reports.compared_tokenizers(docs, *both)
    assert all("regexp_extract_all" not in plan(rep[k]) for k in ("gainers", "losers", "shards"))
    assert rep["wins"].first().asDict() == {"shards": 1, "wins": 1}


def test_registers_are_read_once(spark, docs):
    items = spark.createDataFrame([("the",), ("cat",)], "text string")
    p = registers.grams(docs.where("text is not null"), "word", "source")
    q = registers.grams(items.withColumn("source", F.lit("q")), "word", "source").select("gram", "n")
    got = registers.overlap(p, q, "source")
    assert plan(got).count("regexp_extract_all") == 1
    r = got.where("source = 'a'").first()
    n = {"the": 2, "cat": 1, "th": 1, "cattle": 1, "then": 1, "hen": 1}
    import math

    assert r.cosine == pytest.approx(3 / math.sqrt(sum(v * v for v in n.values()) * 2))
    pt, k = sum(n.values()), len(n)
    assert r.kl == pytest.approx(sum(v / pt * math.log(v / pt / ((1 / 2) if w in ("the", "cat") else 1 / (2 + k))) for w, v in n.items()))
    none = registers.overlap(p, q.where("false"), "source").where("source = 'a'").first()
    assert none.cosine == 0 and none.kl == pytest.approx(sum(v / pt * math.log(v / pt * k) for v in n.values()))


def test_runs_of_tokens_are_decoded(spark, tmp_path):
    euro = "a€b".encode()
    spark.createDataFrame([(1, 0, list(euro[:2])), (1, 1, list(euro[2:])), (2, 0, [999])], "doc_id long, pos long, id array<int>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, pos long, id array<int>").parquet(str(tmp_path / "in"))
    decoding.decoded(stream, []).writeStream.format("memory").queryName("runs_of_tokens").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {r.doc_id: r.text for r in spark.table("runs_of_tokens").collect()} == {1: "a€b", 2: "�"}


def test_loaders_take_whole_texts(spark, sf_dir):
    assert "posexplode" not in plan(catalog._loader_rows(spark, sf_dir))


@pytest.mark.parametrize("kind", ["SurfaceCodec", "OneCapCodec", "OffsetCodec"])
def test_round_trips_in_parts(spark, monkeypatch, kind):
    """What is counted in parts is what whole texts give, and a part isn't coded twice."""
    import random

    from corpuscle.operators import surface

    draw = random.Random(2)
    bits = ["the", "The", "Ümlaut", "über", "É", "IBM", "McX", "x's", "don't", "  ", "\n", " ", "1.5", "-", ", ", ". The", "\nThe", ") x", " \n", "! ", "12 ", "日本", "ﬁ", "ß", "!", "é́", "a", "\x1c", "'LL"]
    texts = ["".join(draw.choice(bits) + draw.choice(["", " ", " "]) for _ in range(draw.randint(0, 30))) for _ in range(300)] + ["", None, " ", "a b", "a  b", "a b "]
    codec = getattr(surface, kind)(tuple(bpe.train_local([b"the", b"umlaut", b"don't"], [5, 3, 2], 268)), 2)
    got = {r.k: r for r in surface.round_trips(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), codec).collect()}
    for k, t in enumerate(texts):
        x = codec.encode(t or "")
        caps = sum(v[2] if isinstance(v[2], int) else len(v[2]) if kind == "OffsetCodec" else sum(v[2]) for v in x)
        assert (got[k].n_tokens, got[k].n_spaces, got[k].n_caps, got[k].same) == (len(x), sum(v[1] for v in x), caps, codec.decode(x) == (t or "")), t
    total = surface.round_trip_totals(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), {"x": codec}).first()
    assert (total.docs, total.same, total.spaces) == (len(texts), sum(r.same for r in got.values()), sum(r.n_spaces for r in got.values()))
    parts = spark.createDataFrame([("the cat the cat " * 500 + "end",)], "text string").select(F.explode(F.split("text", surface._PARTS)).alias("p"))
    assert parts.distinct().count() < 6


@pytest.mark.parametrize("most", [60, 1000])
def test_losses_slice_by_slice(spark, most):
    """As many slices as it takes; sums are those of all runs at once."""
    from corpuscle.operators import losses

    rows = [(k, "the cat sat on the mat, the end"[k % 5 :] + (" xyz" if k % 4 == 0 else ""), "val" if k % 4 == 0 else "train") for k in range(20)] + [(99, None, "val")]
    d = spark.createDataFrame(rows, "doc_id long, text string, split string")
    whole = losses.by_rank(losses.scored(losses.runs(d, "split"), "split", "train"), "split", (0, 2, 4))
    got = losses.by_rank(losses.bucketed(d, "split", "train", edges=(0, 2, 4), most=most), "split")
    plain = lambda x: sorted((r.bucket, r.split, r.tokens, r.bytes, round(r.bits_per_byte, 9)) for r in x.collect())
    assert plain(got) == plain(whole) and len(plain(got)) > 4
    assert losses.bucketed(d.where("false"), "split", "train").isEmpty()


@pytest.mark.parametrize("most", [3, 40])
def test_losses_split_texts_once_whatever_the_slices(spark, monkeypatch, most):
    """Documents aren't read again for each slice; sums hold for hot tokens, texts longer than a block, several splits and nulls."""
    from corpuscle.operators import losses

    calls, own = [], losses.T.chunks
    monkeypatch.setattr(losses.T, "chunks", lambda *a: calls.append(a) or own(*a))
    rows = [(["a a a b a c", "b a \x02 a", "", None, "zz, a b\n" * 9][k % 5], ["train", "val", None][k % 3]) for k in range(17)] + [("a unseen b", "val")]
    d = spark.createDataFrame(rows, "text string, split string")
    whole = losses.by_rank(losses.scored(losses.runs(d, "split"), "split", "train"), "split", (1, 3))
    calls.clear()
    got = losses.by_rank(losses.bucketed(d, "split", "train", edges=(1, 3), most=most), "split")
    plain = lambda x: sorted((str(r.bucket), str(r.split), r.tokens, r.bytes, round(r.bits_per_byte, 9)) for r in x.collect())
    assert plain(got) == plain(whole) and {r[0] for r in plain(got)} == {"None", "-1", "1", "3"}
    assert len(calls) <= 2


def test_ownership_without_rows_of_chunks(spark, sf_dir):
    """Counted where texts are read: no row of a chunk is made, no document is sorted; a row is a document, whatever its doc_id."""
    from corpuscle.functions.patterns import SPACELESS
    from corpuscle.operators import surface

    p = plan(catalog.QUERIES["word_start_ownership"](spark, sf_dir))
    assert "posexplode" not in p and "Window" not in p
    texts = ["The cat's 12 mats", "", None, " ", "日本 Éa1b", "a\nB  c", "x" * 70, "123", "a"]
    whole = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.owned: r["count"] for r in surface.ownership(surface.chunk_spans(whole, "[^ ]* ?"), surface.start_offsets(whole)).groupBy("owned").count().collect()}
    assert {r.owned: r.chunks for r in surface.owned_counts(whole, "[^ ]* ?").collect()} == want and max(want) > 1
    want = {r.owned: r["count"] for r in surface.ownership(surface.chunk_spans(whole, SPACELESS), surface.start_offsets(whole)).groupBy("owned").count().collect()}
    twice = whole.union(whole).withColumn("doc_id", F.lit(None).cast("long")).coalesce(1)
    assert {r.owned: r.chunks for r in surface.owned_counts(twice).collect()} == {k: 2 * n for k, n in want.items()}


def test_surface_round_trip_by_distinct_parts(spark, sf_dir):
    """Texts aren't coded one by one where all their parts come back; where one doesn't, rows are what whole texts give. Chunks are folded once each."""
    from corpuscle.functions import text as T
    from corpuscle.functions.patterns import SPACELESS
    from corpuscle.operators import chunks, surface

    p = plan(catalog.QUERIES["surface_roundtrip"](spark, sf_dir))
    assert "of_text" not in p and "of_stream" not in p
    texts = ["The cat's Mat", "a 'Sam 'SAM 'sAm don'T 'Llama 'x", "", None, "One Two\n Ünd É  x\t\n\n!!'S 'Re", "THE The the", "İ ǅ K ſ 'ſam"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folded = chunks.counted(d.select(T.fold_case(F.col("text")).alias("text")), SPACELESS)
    rows = lambda x: sorted((r.chunk, r.n) for r in x.collect())
    assert rows(surface.folded_counts(d)) == rows(folded)
    for slots in (0, 4):  # without slots no capital comes back
        codec = surface.SurfaceCodec(tuple(bpe.train_local([b"the", b"don't"], [5, 2], 260)), slots)
        got = {r.doc_id: (r.bytes, r.same) for r in surface.returned(d, codec).collect()}
        for k, t in enumerate(texts):
            back = None if t is None else codec.decode(codec.encode(t))
            assert got[k] == ((None, True) if t is None else (len(back.encode()), back == t)), t
        assert all(same for _, same in got.values()) == (slots == 4)
