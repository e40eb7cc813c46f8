"""Dropout, seeds, unigram vocabularies, SQL functions, online decoding: against definitions on small input."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle import sql
from corpuscle.cluster import ship_code
from corpuscle.functions.patterns import BASE
from corpuscle.operators import bpe, chunks, dropout, surface, unigram
from corpuscle.streaming import decoding

TEXTS = ["the then than a hat that hat", "an ant then the the", "été là, naïve über 中文 🙂 the", "", None, "aaaaaaa aaaa", " lead\n\ntrail "]


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_code(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def merges(spark, docs):
    return bpe.collected(bpe.train(chunks.counted(docs), bpe.BYTES + 25, mode="task"))


# --- dropout ---


def test_dropout_shares(docs, merges):
    whole = {i: bytes((i,)) for i in range(256)} | {m.id: m.bytes for m in merges}
    plain: dict = {}
    for r in sorted(bpe.token_rows(docs, merges, BASE).collect(), key=lambda r: (r.doc_id, r.cpos, r.tpos)):
        plain.setdefault(r.doc_id, []).append(r.id)
    get = lambda share, seed=0, parts=2: {r.doc_id: list(r.ids) for r in dropout.encoded(docs.repartition(parts), merges, share, seed).collect()}
    none, some, every = get(0.0), get(0.4), get(1.0)
    assert {k: v for k, v in none.items() if v} == plain
    assert every == {i: list((t or "").encode()) for i, t in enumerate(TEXTS)}
    for got in (none, some, every):
        assert all(b"".join(whole[i] for i in got[k]) == (t or "").encode() for k, t in enumerate(TEXTS))
    assert some == get(0.4, parts=5) and some != get(0.4, seed=1) and none != some != every
    with pytest.raises(ValueError):
        dropout.encoded(docs, merges, 1.5)


def test_dropout_differs_between_occurrences(spark, merges):
    """The same word many times over: it is cut in more than one way, and a tenth of its merges are missing on the whole."""
    docs = spark.createDataFrame([(1, " the" * 400), (2, " the" * 400)], "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in dropout.encoded(docs, merges, 0.2).collect()}
    assert got[1] != got[2]
    ways, word = Counter(), b""
    whole, at = {i: bytes((i,)) for i in range(256)} | {m.id: m.bytes for m in merges}, []
    for i in got[1]:
        at.append(i)
        word += whole[i]
        if word == b" the":
            ways[tuple(at)] += 1
            word, at = b"", []
    assert len(ways) > 2 and ways.most_common(1)[0][1] < 400


# --- seeds ---


def test_seeds_move_later_ids_up(merges):
    whole = {i: bytes((i,)) for i in range(256)} | {m.id: m.bytes for m in merges}
    seeds = [(b"q", b"q"), (whole[258], b"x"), (b"qq", b"q"), (b"z", whole[merges[-1].id]), (b"missing", b"x"), (whole[merges[0].left], whole[merges[0].right])]
    got, ids = bpe.insert_seeds(merges, seeds)
    assert [m.id for m in got] == list(range(256, 256 + len(got))) and len(got) == len(merges) + 4 == len(merges) + len(ids)
    by = {m.bytes: m.id for m in got}
    assert by[b"qq"] == 256 and by[b"qqq"] == 257 and by[b"z" + whole[merges[-1].id]] == by[whole[merges[-1].id]] + 1 and by[whole[258] + b"x"] == by[whole[258]] + 1
    assert [m.bytes for m in got if m.id not in ids] == [m.bytes for m in merges]
    back = {i: bytes((i,)) for i in range(256)} | {m.id: m.bytes for m in got}
    assert all(back[m.left] + back[m.right] == m.bytes and m.id > max(m.left, m.right) for m in got)


def test_a_seed_fires_where_an_appended_one_does_not():
    """' q' is merged from many words; qq put behind it finds no bare q."""
    made = bpe.train_local([b" qq", b" qa", b" qb"], [5, 50, 50], 258)
    assert made[0].bytes == b" q"
    in_place, _ = bpe.insert_seeds(made, [(b"q", b"q")])
    appended = [*made, bpe.Merge(258, ord("q"), ord("q"), b"qq", 0)]
    name = {m.id: m.bytes for m in in_place}
    assert [name.get(i) for i in bpe.encoder(in_place)(" qq")] == [None, b"qq"] and 258 not in bpe.encoder(appended)(" qq")


# --- unigram ---


def segmentations(chunk, pieces):
    for cuts in itertools.product((False, True), repeat=max(0, len(chunk) - 1)):
        edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(chunk)]
        s = [chunk[i:j] for i, j in zip(edges, edges[1:], strict=False)]
        if all(p in pieces for p in s):
            yield s


def test_expected_counts_and_best_segmentations_by_hand():
    rng = random.Random(1)
    for _ in range(60):
        letters = "abc"
        names = set(letters) | {"".join(rng.choices(letters, k=rng.randint(2, 4))) for _ in range(6)}
        pieces = unigram.logs({p: rng.random() + 0.01 for p in sorted(names)})
        chunk = "".join(rng.choices(letters, k=rng.randint(1, 8)))
        ways = [(s, math.exp(sum(pieces[p] for p in s))) for s in segmentations(chunk, pieces)]
        total = sum(w for _, w in ways)
        like, counts = unigram.expected(chunk, pieces, 4)
        assert like == pytest.approx(math.log(total))
        want = Counter()
        for s, w in ways:
            for p in s:
                want[p] += w / total
        assert counts == pytest.approx(dict(want))
        got = unigram.best(chunk, pieces, 4)
        assert "".join(got) == chunk and sum(pieces[p] for p in got) == pytest.approx(math.log(max(w for _, w in ways)))


def test_unigram_training(spark):
    words = {"banana": 9, "bandana": 5, "ana": 7, "nab": 2, "中文": 1, "": 3}
    table = spark.createDataFrame(list(words.items()), "chunk string, n long").repartition(3)
    pieces, log = unigram.train(table, 14, longest=5, many=60)
    assert len(pieces) == 14 and {"a", "b", "n", "d", "中", "文"} <= set(pieces) and sum(map(math.exp, pieces.values())) == pytest.approx(1)
    for (n, a), (m, b) in zip(log, log[1:], strict=False):
        assert n != m or b >= a - 1e-9  # between prunings the likelihood never falls
    # The first round by hand.
    start = unigram.logs(unigram.seeds(table, 60, 5))
    assert log[0][1] == pytest.approx(sum(n * math.log(sum(math.exp(sum(start[p] for p in s)) for s in segmentations(w, start))) for w, n in words.items() if w))
    rows = {r.chunk: r.pieces for r in unigram.encoded(table, pieces, 5).collect()}
    assert all("".join(p) == w for w, p in rows.items()) and max(map(len, rows["banana"])) > 1
    assert unigram.best("axb", pieces) == ["a", "x", "b"]
    assert unigram.train(table.where("false"), 5) == ({}, [])


@pytest.mark.parametrize("table", [1 << 24, 0])
def test_lattices_in_arrays_equal_those_of_single_chunks(monkeypatch, table):
    monkeypatch.setattr(unigram._Lattices, "TABLE", table)  # 0: the trie is searched
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd é中") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    counted = {}
    for w in words:
        for i in range(len(w)):
            for k in range(1, min(5, len(w) - i) + 1):
                counted[w[i : i + k]] = counted.get(w[i : i + k], 0.0) + 1
    pieces = unigram.logs({p: n for p, n in counted.items() if len(p) == 1 or n > 3})
    own, n = unigram._Lattices(pieces), np.array([rng.randint(1, 9) for _ in words], float)
    own.of(words, 4)
    like, sums = own.expected(n)
    each = [unigram.expected(w, pieces, 4) for w in words]
    assert like == pytest.approx(sum(k * x for k, (x, _) in zip(n, each, strict=True)))
    want = [sum(k * x.get(p, 0.0) for k, (_, x) in zip(n, each, strict=True)) for p in own.names]
    assert sums == pytest.approx(np.array(want))
    words += ["x", "ab!zz\U0001f600", "ab" * 400]  # characters that no piece has
    own.of(words, 4)
    got = {}
    for e in own.best().tolist():
        c = int(own.chunk[e])
        got.setdefault(c, []).append(own.names[own.piece[e]] if own.piece[e] < len(own.names) else words[c][own.level[own.start[e]]])
    assert [got[k] for k in range(len(words))] == [unigram.best(w, pieces, 4) for w in words]


# --- SQL ---


def test_functions_in_sql(spark, docs, merges):
    sql.register_vocabulary(spark, merges, "toy")
    docs.createOrReplaceTempView("toy_texts")
    rows = {r.doc_id: r for r in spark.sql("SELECT doc_id, text, toy_encode(text) AS ids, toy_count(text) AS n, toy_decode(toy_encode(text)) AS back FROM toy_texts").collect()}
    plain = bpe.token_rows(docs, merges, BASE).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in plain} == {k: r.n for k, r in rows.items() if r.n}
    assert all(r.back == r.text and (r.ids is None) == (r.text is None) for r in rows.values())
    tokens = spark.sql("SELECT doc_id, pos, id, bytes FROM toy_texts, LATERAL toy_tokens(text) ORDER BY doc_id, pos").collect()
    for k, r in rows.items():
        assert [t.id for t in tokens if t.doc_id == k] == list(r.ids or []) and b"".join(bytes(t.bytes) for t in tokens if t.doc_id == k) == (r.text or "").encode()
    assert spark.sql("SELECT toy_decode(array(195)) AS half, toy_decode(array(999999)) AS none").first().asDict() == {"half": None, "none": None}


def test_table_function_encodes_by_batches(spark, docs, merges):
    """No row of tokens is made in Python: texts are encoded by batches and Spark makes the rows."""
    sql.register_vocabulary(spark, merges, "toy")
    long = "the cat " * 20_000 + "x" * 300
    docs.select("doc_id", "text").unionByName(spark.createDataFrame([(901, long), (902, ""), (903, None)], "doc_id long, text string")).createOrReplaceTempView("toy_texts")
    rows = spark.sql("SELECT doc_id, count(*) AS n FROM toy_texts, LATERAL toy_tokens(text) GROUP BY doc_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "UDTF" not in plan and "posexplode" in plan
    want = {r.doc_id: r.n for r in spark.sql("SELECT doc_id, toy_count(text) AS n FROM toy_texts").collect()}
    assert want[902] == 0 and want[903] is None
    assert {r.doc_id: r.n for r in rows.collect()} == {k: n for k, n in want.items() if n}


def test_streams_in_sql(spark):
    codec = surface.SurfaceCodec(tuple(bpe.train_local([b"the", b"then", b"cat"], [5, 3, 2], 262)), 4)
    sql.register_stream(spark, codec, "dual")
    spark.createDataFrame([(1, "The cat  then THE"), (2, None), (3, "")], "k long, text string").createOrReplaceTempView("dual_texts")
    got = spark.sql("SELECT k, pos, base, space, caps FROM dual_texts, LATERAL dual_stream(text) ORDER BY k, pos").collect()
    assert [(r.base, r.space, list(r.caps)) for r in got] == [(int(t[0]), int(t[1]), list(t[2])) for t in codec.encode("The cat  then THE")] and {r.k for r in got} == {1}
    assert [r.same for r in spark.sql("SELECT dual_round_trip(text) AS same FROM dual_texts ORDER BY k").collect()] == [True, None, True]


# --- streams ---


def test_streams_of_tokens_become_text(spark, merges, tmp_path):
    """Tokens arrive in several batches that cut characters in two; each document's pieces are its text, whatever the batches."""
    texts = {1: "the été 中文 🙂🙂 then", 2: "naïve 🙂", 3: "hat"}
    rows = [(d, k, i) for d, t in texts.items() for k, i in enumerate(t.encode())]  # bytes, so that every character is cut
    rows += [(4, 0, 0xF0), (5, 0, 999_999)]
    batches = [[r for r in rows if r[1] < 4], [r for r in rows if 4 <= r[1] < 13], [r for r in rows if r[1] >= 13]]
    assert sorted(sum(batches, [])) == sorted(rows)
    folder = tmp_path / "in"
    for k, part in enumerate(batches):
        spark.createDataFrame(part, "doc_id long, pos long, id int").coalesce(1).write.mode("append").parquet(str(folder / f"b={k}"))
    stream = spark.readStream.schema("doc_id long, pos long, id int").option("maxFilesPerTrigger", 1).parquet(str(folder / "*"))
    q = decoding.decoded(stream, merges).writeStream.format("memory").queryName("decoded_pieces").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got: dict = {}
    for r in spark.table("decoded_pieces").orderBy("doc_id", "pos").collect():
        got[r.doc_id] = got.get(r.doc_id, "") + r.text
    assert got == texts | {5: "�"}  # a character that never ends doesn't come out
    assert spark.table("decoded_pieces").where("doc_id = 1").select(F.count("*").alias("n")).first().n > 1
