"""Encoders against the libraries, store and packing: round trips, edge cases; neighbours against brute force; the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, ship_code
from corpuscle.llm import ann, encoding, fst, packing, store

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, rank int"
TEXTS = [
    "", " ", "  ", "a", "Hello,  world!\n\nit's  I'LL we've", "tabs\t\tand\r\nlines \n x", "naïve café ß ẞ İ Σας ΟΔΟΣ", "日本語 テキスト 🏳️‍🌈👍🏽", "1234567 89,10", "-" * 300, "a" * 3000, " lead", "trail ", "x  y  z", "\x1c a\x1c b",
    "é ́x", "<|endoftext|> <|startoftext|>", "don't stop.\nNext line. And\nmore", "a\u0085b  c\u0085d", "가 K Å",
]


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_code(spark)


@pytest.fixture
def scratch(spark):
    with Scratch(spark, "test") as s:
        yield s


@pytest.fixture(scope="module")
def corpus(sf_dir):
    import duckdb

    return TEXTS + [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()]


def test_transducer_equals_tiktoken(corpus):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=fst.read_ranks(path), special_tokens={})
    own = fst.Encoder(path, P.PATTERN)
    for t in corpus:
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == enc.encode_ordinary(t), t[:50]
        assert b"".join(r for r, _ in fst.decoded(ids, own.fst.bytes_of)).decode() == t
        assert "".join(c for _, c in fst.decoded(ids, own.fst.bytes_of)) == t


def test_transducer_on_small_merges_is_exhaustive():
    import itertools

    ranks = {bytes((i,)): i for i in range(256)} | {b: 256 + k for k, b in enumerate((b"ab", b"bc", b"abc", b"ca", b"aa", b"aab", b"bcab"))}
    t = fst.BpeTransducer(ranks)
    for n in range(1, 8):
        for s in itertools.product(b"abc", repeat=n):
            assert t.encode(bytes(s)) == (t._merged(bytes(s)) if bytes(s) not in ranks else [ranks[bytes(s)]])


def test_stream_decoder_takes_any_cut():
    data = "aé日👍\x00z".encode() + b"\xff\xe6\x97"
    for k in range(len(data) + 1):
        s = fst.Utf8Stream()
        assert s.feed(data[:k]) + s.feed(data[k:]) + s.finish() == data.decode("utf-8", "replace")


@pytest.mark.parametrize(("name", "leading"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_the_library(corpus, name, leading):
    from tokenizers import Tokenizer

    t = encoding.PieceTable(P.path(name), leading)
    corpus = corpus + ["a<|endoftext|>", "<|ENDOFTEXT|> b", " x <|endoftext|> y\nz", "<|startoftext|><|endoftext|>", "A<|EndOfText|>"]
    want = [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(corpus, add_special_tokens=False)]
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in t.ids(corpus)]
        assert [k for k in range(len(corpus)) if got[k] != want[k]] == []


def test_letters_are_encoded_once_whatever_marks_stand_behind(monkeypatch):
    from tokenizers import Tokenizer

    t, alone = encoding.PieceTable(P.path("byte_bpe_50k.json"), True), []
    own = t._spaced
    monkeypatch.setattr(t, "_spaced", lambda pieces: alone.extend(pieces) or own(pieces))
    marked = [" ".join(w + m for w in ("it", "Ärger", "naïve", "ªº", "thoroneningen") for m in ("", ".", "!?", "***", "$$$", ")]}", "--_"))]
    odd = ["x don't y'll 'tis it's. it'.s abc'' q.'re a.b c1 d2. 日本。 мир! ÿ× µm2 ĊĠ Ġ.Ċ e\u0301. \u00ad. a\x7f", "It's.\nI'm!?\nnaïve***\n.\n!?"]
    want = lambda texts: [e.ids for e in Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in t.ids(marked)] == want(marked)
    assert alone == []
    assert [np.frombuffer(b, "<u4").tolist() for b in t.ids(odd + marked)] == want(odd + marked)


def test_store_round_trip_dedups_and_verifies(spark, tmp_path):
    long = " ".join(f"tok{i * 7919 % 1000}" for i in range(6000))
    rows = [(5, "b", 0), (1, long, 0), (2, long + " tail", 0), (None, None, 0), (3, "", 0), (3, "", 0)]
    out = str(tmp_path / "store")
    store.write_store(spark.createDataFrame(rows, DOCS), out, P.path("byte_bpe_50k.json"))
    table = encoding.PieceTable(P.path("byte_bpe_50k.json"), True)
    order, at = [(None, ""), (1, long), (2, long + " tail"), (3, ""), (3, ""), (5, "b")], 0
    got = sorted(store.verified_digests(spark, out).collect(), key=lambda r: r.start)
    whole = sorted(store.read_documents(spark, out).collect(), key=lambda r: r.start)
    assert len(got) == len(whole) == 6
    for (d, t), r, w in zip(order, got, whole, strict=True):
        ids = table.ids([t])[0] + bytes(4)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.verified) == (d, at, len(ids) // 4, zlib.crc32(ids), True)
        assert w.ids == np.frombuffer(ids, "<u4").tolist()
        at += r.n_tokens
    chunks = store.read_chunks(spark, out)
    assert chunks.count() == chunks.select("name").distinct().count()
    assert chunks.agg(F.sum("n")).first()[0] < 0.7 * at  # the long passage is stored once
    m = spark.read.parquet(f"{out}/manifest")
    assert m.where("part = -1").first().documents == 6


def test_store_of_nothing(spark, tmp_path):
    store.write_store(spark.createDataFrame([], DOCS), str(tmp_path / "s"), P.path("byte_bpe_50k.json"))
    assert store.verified_digests(spark, str(tmp_path / "s")).count() == 0


def test_boundaries_depend_on_content_alone():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50000, 30000), rng.integers(0, 50000, 500)
    x, y = store.boundaries(a), store.boundaries(np.r_[b, a])
    assert len(set(x) & {e - 500 for e in y}) > 0.9 * len(x) - 3
    assert store.boundaries(np.zeros(0, np.int64)) == []
    sizes = np.diff([0, *x])
    assert sizes.max() <= store.MOST and sizes[:-1].min() >= store.LEAST


def test_crc_of_parts():
    for a, b in ((b"", b""), (b"x", b""), (b"", b"y"), (b"abc" * 99, bytes(1000))):
        assert store.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def best_possible(sizes, capacity):
    """Fewest bins by trying everything."""
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] >= sizes[k] and bins[i] not in bins[:i]:
                bins[i] -= sizes[k]
                go(k + 1, bins)
                bins[i] += sizes[k]
        bins.append(capacity - sizes[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


def test_plan_is_whole_and_near_the_fewest():
    rng = random.Random(2)
    for _ in range(60):
        cap = rng.choice((10, 30, 64))
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        hist = {n: sizes.count(n) for n in sizes}
        runs = packing.plan(hist, cap)
        back = {}
        for count, items in runs:
            assert sum(n * k for n, k in items) <= cap and sum(k for n, k in items if 3 * n > cap) <= 2
            for n, k in items:
                back[n] = back.get(n, 0) + count * k
        assert back == hist
        assert sum(c for c, _ in runs) <= best_possible(sizes, cap) + 1
    large = [22, 21, 20, 12, 11, 11]
    assert sum(c for c, _ in packing.plan({n: large.count(n) for n in large}, 33)) == 3


def test_packing_places_every_token_once(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice((3, 40, 400, 900)))), 1) for i in range(80)] + [(None, None, 1), (7, "same", 1), (7, "same", 1), (99, "", 1)]
    got = packing.packed(spark.createDataFrame(rows, DOCS).repartition(5), P.path("word_bpe_49k.json"), capacity=512, with_ids=True).collect()
    table = encoding.PieceTable(P.path("word_bpe_49k.json"), False)
    total = sum(len(table.ids([t or ""])[0]) // 4 + 1 for _, t, _ in rows)
    assert sum(r.length for r in got) == total and all(r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) for r in got)
    by = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 512 and len(by) <= -(-total // 512) + 1
    assert packing.packed(spark.createDataFrame([], DOCS), P.path("word_bpe_49k.json")).count() == 0


def test_neighbours_reach_recall_and_handle_odd_vectors(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1500, 24)).astype(np.float32)
    v[100:160] = v[100]  # equal vectors
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] + [1.0] * 23), (5003, [float("inf")] + [1.0] * 23), (5004, [1.0]), (None, [1.0] * 24), (5005, [None] + [1.0] * 23)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(table, F.col("id") % 20 == 0, k=10).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 20))
    found = 0
    d = v.astype(np.float64)
    for q, rows_ in by.items():
        rows_.sort()
        assert [r for r, *_ in rows_] == list(range(1, 11)) and q not in [i for _, i, _ in rows_]
        s = (d * d[q]).sum(1)
        s[q] = -np.inf
        true = np.lexsort((np.arange(len(s)), -s))[:10]
        assert all(abs(s[i] - x) < 1e-9 for _, i, x in rows_)
        assert [(-x, i) for _, i, x in rows_] == sorted((-x, i) for _, i, x in rows_)
        found += len(set(true.tolist()) & {i for _, i, _ in rows_})
    assert found >= 0.9 * 10 * len(by)


def test_split_leaves_keep_neighbours_together(spark, scratch):
    """Depth bounded by a small sample: leaves are split by planes within a task, or, where a task cannot hold them, over tasks that differ by tree."""
    rng = np.random.default_rng(8)
    v = (rng.standard_normal((40, 24))[np.arange(2000) % 40] + 0.3 * rng.standard_normal((2000, 24))).astype("<f4")
    v[100:200] = v[100]  # equal vectors
    vectors = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "id long, vec binary")
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    worst = np.sort(s, axis=1)[:, -10]
    lists = {r.id: np.frombuffer(r.nbrs, "<i8") for r in ann.neighbour_graph(vectors, "<f4", scratch, rounds=0, leaf=16, fit_rows=64).collect()}
    assert np.mean([min(10, (s[i, lists[i]] >= worst[i] - 1e-5).sum()) / 10 for i in range(2000)]) >= 0.8
    # Only parts of about 32 for all 2000: eight trees show a vector more than one part's members.
    lists = {r.id: np.frombuffer(r.nbrs, "<i8") for r in ann.neighbour_graph(vectors, "<f4", scratch, rounds=0, leaf=16, fit_rows=16, held=1).collect()}
    assert len(lists) == 2000 and np.mean([len(x) for x in lists.values()]) > 39
    parts = ann.halved(v, 32, 3)
    assert sorted(np.concatenate(parts).tolist()) == list(range(2000)) and max(map(len, parts)) <= 32


def test_rounds_go_on_and_hubs_lose_no_pair(spark, scratch):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((1000, 8)).astype("<f4")
    v /= np.linalg.norm(v, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "id long, vec binary").repartition(4)
    s = v @ v.T
    np.fill_diagonal(s, -np.inf)
    true = np.argsort(-s, axis=1)[:, :10]

    def recall(graph, ids):
        lists = {r.id: np.frombuffer(r.nbrs, "<i8").tolist() for r in graph.collect()}
        return np.mean([len(set(true[i]) & set(lists.get(i, ()))) / 10 for i in ids])

    # All know only vector 0: one round brings every pair together.
    star = spark.createDataFrame([(i, np.array([0], "<i8").tobytes(), np.array([s[i, 0]], "<f4").tobytes(), b"\1", 1) for i in range(1, 1000)], "id long, nbrs binary, scores binary, new binary, n_new int")
    assert recall(ann.joined(vectors, star, "<f4", 40, scratch), range(1, 1000)) > 0.98
    # A poor start, short lists: more rounds than three are needed.
    poor = dict(degree=10, trees=2, leaf=4, fit_rows=16, held=1)
    assert recall(ann.neighbour_graph(vectors, "<f4", scratch, **poor), range(1000)) > max(0.9, recall(ann.neighbour_graph(vectors, "<f4", scratch, rounds=3, **poor), range(1000)))


def test_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(11)
    v = rng.standard_normal((300, 12)) * 10.0 ** rng.integers(-12, 13, (300, 1))
    v[0] *= 0
    v[0, 0] = 1e200
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, F.col("id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    found = 0
    for q in range(0, 300, 20):
        s = (v * v[q]).sum(1)
        s[q] = -np.inf
        assert [r for r, *_ in sorted(got[q])] == [1, 2, 3, 4, 5] and all(x == pytest.approx(s[i]) for _, i, x in got[q])
        found += len(set(np.lexsort((np.arange(300), -s))[:5].tolist()) & {i for _, i, _ in got[q]})
    assert found >= 0.9 * 5 * 15


def test_queries_that_reach_too_few_are_compared_with_all(spark, scratch, monkeypatch):
    monkeypatch.setattr(ann, "AT_ONCE", 2)
    rng = np.random.default_rng(12)
    v = rng.standard_normal((50, 6)).astype("<f4")
    vectors = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "id long, vec binary").repartition(3)
    nothing = spark.createDataFrame([], "id long, nbrs binary, scores binary, new binary, n_new int")
    queries = vectors.select("id").where("id % 10 = 0")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.searched(vectors, nothing, queries, "<f4", scratch, k=7).collect()}
    assert len(got) == 35
    for q in range(0, 50, 10):
        s = (v.astype(np.float64) * v[q]).sum(1)
        s[q] = -np.inf
        assert [got[q, r] for r in range(1, 8)] == np.lexsort((np.arange(50), -s))[:7].tolist()


def test_search_looks_at_the_nearest_around_a_hub(spark):
    star = [(i, np.array([0], "<i8").tobytes(), np.array([i], "<f4").tobytes()) for i in range(1, 300)] + [(0, np.array([5, 6], "<i8").tobytes(), np.array([5, 6], "<f4").tobytes())]
    graph = spark.createDataFrame(star, "id long, nbrs binary, scores binary").repartition(4)
    got = {(r.pivot, r.member) for r in ann.search_links(graph, 10).collect()}
    assert {m for p, m in got if p == 0} == {5, 6, *range(290, 300)}
    assert all((i, 0) in got for i in range(1, 300)) and len(got) == 299 + 12


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, [0.0, 1.0]), (21, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(few, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 0.5), (0, 2, 21, 0.0), (20, 1, 0, 0.5), (20, 2, 21, 0.5)]
    assert ann.nearest(few.where("false"), F.col("id") % 20 == 0).count() == 0


def test_byte_bpe_in_frames(spark):
    """Nulls, empty and long texts, repeats, an empty table, clashing columns: ids as the library's, digests of them."""
    import hashlib

    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=fst.read_ranks(path), special_tokens={})
    rows = [(1, None, 0, "x"), (2, "", 0, "x"), (3, "A long one. " * 20_000, 0, "x"), (4, "same é日", 1, "y"), (4, "same é日", 1, "y"), (None, "x" * 50_000, 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = fst.digests(docs, path, P.PATTERN).collect()
    assert len(got) == 6
    for r in got:
        t = next(t or "" for d, t, *_ in rows if d == r.doc_id)
        ids = enc.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.round_trip) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), True)
    whole = fst.encoded(docs.drop("ids"), path, P.PATTERN).collect()
    assert all(list(r.ids) == enc.encode_ordinary(r.text or "") for r in whole) and whole[0].n_tokens == 0
    assert fst.digests(docs.where("false"), path, P.PATTERN).count() == 0


def test_table_forgets_and_stays_right(monkeypatch, corpus):
    """A small table that is emptied again and again."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(encoding, "KEPT_PIECES", 50)
    for name, leading in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        t, lib = encoding.PieceTable(P.path(name), leading), Tokenizer.from_file(P.path(name))
        for i in range(0, len(corpus), 9):
            some = corpus[i : i + 9]
            assert [np.frombuffer(b, "<u4").tolist() for b in t.ids(some)] == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]
        assert t.ids([]) == []


def test_store_and_packing_against_a_fresh_tokenizer(spark, sf_dir, tmp_path):
    """All documents of the smallest table, the end mark among the texts."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("clash").alias("start"), F.lit(1).alias("part"))
    docs = docs.unionByName(spark.createDataFrame([(-5, "a<|endoftext|>b <|ENDOFTEXT|>", "x", 1)], "doc_id long, text string, start string, part int")).repartition(5)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = lambda name, end: {d: [*e.ids, end] for d, e in zip(texts, Tokenizer.from_file(P.path(name)).encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    store.write_store(docs, str(tmp_path / "s"), P.path("byte_bpe_50k.json"))
    want, at = ids("byte_bpe_50k.json", 0), 0
    got = {r.doc_id: r for r in store.verified_digests(spark, str(tmp_path / "s")).collect()}
    for d in sorted(texts):
        raw = np.array(want[d], "<u4").tobytes()
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32, got[d].verified) == (at, len(want[d]), zlib.crc32(raw), True)
        at += len(want[d])
    want = ids("word_bpe_49k.json", 1)
    pieces = sorted(packing.packed(docs, P.path("word_bpe_49k.json")).collect(), key=lambda r: (r.doc_id, r.piece))
    cut = [(d, k, i, np.array(want[d][i : i + 4096], "<u4").tobytes()) for d in sorted(texts) for k, i in enumerate(range(0, len(want[d]), 4096))]
    assert [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces] == [(d, k, i, len(b) // 4, zlib.crc32(b)) for d, k, i, b in cut]
    assert len({r.sequence_id for r in pieces}) <= 1.02 * sum(len(b) // 4 for *_, b in cut) / 4096 + 1


def test_a_missing_chunk_is_told(spark, tmp_path):
    out = str(tmp_path / "s")
    store.write_store(spark.createDataFrame([(1, "one text"), (2, "another text")], "doc_id long, text string"), out, P.path("byte_bpe_50k.json"))
    first = store.read_recipes(spark, out).where("doc_id = 1").first().names[0]
    store.read_chunks(spark, out).where(F.col("name") != F.lit(bytes(first))).write.parquet(f"{out}/less")
    import shutil

    shutil.rmtree(f"{out}/chunks")
    shutil.move(f"{out}/less", f"{out}/chunks")
    assert {r.doc_id: r.verified for r in store.verified_digests(spark, out).collect()} == {1: False, 2: True}


def test_pipeline_on_odd_tables(spark, sf_dir, tmp_path):
    """Nulls, empty texts, repeats and extra columns with names of the operators' own; and no rows at all."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.limit(3).unionAll(docs.limit(3)).unionAll(docs.limit(1).withColumn("text", F.lit(None).cast("string"))).unionAll(docs.limit(1).withColumn("text", F.lit(""))).unionAll(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    odd = docs.unionAll(more).withColumns({"score": F.lit("own"), "_row": F.lit(1), "kept": F.lit("k"), "gone": F.lit(2.5), "_doc": F.lit(3)})
    for name, rows in (("odd", odd), ("none", odd.where("false"))):
        d = tmp_path / name
        rows.write.parquet(str(d / "documents.parquet"))
        (d / "labels.parquet").symlink_to(f"{sf_dir}/labels.parquet")
        now = spark.read.parquet(str(d / "documents.parquet"))
        for k, (stage, f) in enumerate(corpus_pipeline.STAGES[:4]):
            out = f(spark, now, str(d))
            assert out.columns == odd.columns
            out.write.parquet(str(d / stage))
            now = spark.read.parquet(str(d / stage))
            assert now.where("score = 'own' and kept = 'k' and gone = 2.5").count() == now.count()
        if name == "odd":
            ids = [r.doc_id for r in now.select("doc_id").collect()]
            assert len(ids) == len(set(ids)) > 50
            assert now.where("text is null or text = ''").count() <= 1
        else:
            assert now.count() == 0 and corpus_pipeline.run(spark, str(d)).count() == 0


def test_pipeline_near_stage_equals_brute_force(spark, sf_dir):
    """What the last two filtering stages keep of the first ones' rows, by all pairs of lines and of texts."""
    import corpus_pipeline

    from corpuscle.llm import linededup, linkage, neardup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = corpus_pipeline.toxic_documents(spark, corpus_pipeline.quality_rules(spark, docs, sf_dir), sf_dir).cache()
    rows = sorted((r.doc_id, r.text) for r in now.collect())
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, now, sf_dir).collect()}
    lines = sorted({k for _, t in rows for x in t.split("\n") if (k := linededup.line_key(x))})
    codes, parent = [linededup._shingles(x) for x in lines], list(range(len(lines)))

    def root(x, p):
        while p[x] != x:
            x = p[x]
        return x

    by_size = sorted(range(len(lines)), key=lambda i: len(codes[i]))
    for a, i in enumerate(by_size):
        for j in by_size[a + 1 :]:
            if len(codes[i]) < 0.8 * len(codes[j]):
                break
            if min(len(lines[i]), len(lines[j])) >= linededup.SHINGLE and linkage.set_jaccard(codes[i], codes[j], 0.8) >= 0.8:
                x, y = root(i, parent), root(j, parent)
                parent[max(x, y)] = min(x, y)
    place, seen, want = {x: i for i, x in enumerate(lines)}, set(), {}
    for d, t in rows:
        kept = []
        for x in t.split("\n"):
            k = linededup.line_key(x)
            if not k or (r := root(place[k], parent)) not in seen:
                kept.append(x)
                seen |= {r} if k else set()
        want[d] = "\n".join(kept)
    assert got == want
    near = spark.createDataFrame(list(want.items()), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, near, sf_dir).collect()}
    bags = {d: neardup._bag(neardup.normalised(t)) for d, t in want.items()}
    ids = sorted(bags)
    p = {d: d for d in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linkage.bag_jaccard(bags[a], bags[b], 0.8) >= 0.8:
                x, y = root(a, p), root(b, p)
                p[max(x, y)] = min(x, y)
    assert kept == {root(d, p) for d in ids}


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert kept < {r.doc_id for r in docs.select("doc_id").collect()} and len(kept & bad) <= 0.05 * len(bad)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "line_dedup", "near_dedup", "best_fit_packing"]
