"""Glyph maps, string ids, ratios, verdicts."""

from pyspark.sql import functions as F

from corpuscle.operators import bpe, probes


def test_glyphs_are_a_bijection_and_come_back(spark):
    table = probes.glyph_table()
    assert sorted(table.values()) == list(range(256))
    back = {b: g for g, b in table.items()}
    texts = [" the", "é\n", "\x00\xff\x80"]
    rows = [("".join(back[b] for b in t.encode("latin-1")), t.encode("latin-1")) for t in texts] + [("日", "日".encode())]
    got = spark.createDataFrame(rows, "g string, b binary").select(probes.bytes_of_glyphs(F.col("g")).alias("x"), "b").collect()
    assert all(bytes(r.x) == bytes(r.b) for r in got)


def test_string_ids_take_the_first(spark):
    v = spark.createDataFrame([(1, b"a", False), (2, b"\xff", False), (3, b"\xfe", False), (4, b"<s>", True)], "id int, bytes binary, is_special boolean")
    assert {r.s: r.id for r in probes.string_ids(v).collect()} == {"a": 1, "�": 2}


def test_ratios_and_round_trip_of_structural_texts(spark):
    made = bpe.train_local([b"abab", b"the"], [9, 9], bpe.BYTES + 4)
    p = spark.createDataFrame(list(probes.STRUCTURAL), "name string, text string")
    r = {x.name: x for x in probes.ratios(p, made).collect()}
    assert r["empty"].ratio == 0.0 and r["repeats"].ratio > 2 and all(x.bytes == len(t.encode()) for (n, t) in probes.STRUCTURAL for x in [r[n]])
    assert probes.token_views(["the"], made)[0][1][-1].endswith(f"@{made[-1].id}") or len(probes.token_views(["the"], made)[0][1]) <= 3


def test_starts_and_verdict(spark):
    v = spark.createDataFrame([(1, b" of the"), (2, b"ing"), (3, b"\xc3")], "id int, bytes binary")
    assert {r.id: r.starts for r in probes.inner_starts(v).collect()} == {1: 2, 2: 1, 3: 0}
    r = spark.range(1).select(probes.verdict(a=F.lit(True), b=F.lit(False), c=F.lit(None).cast("boolean")).alias("v")).first().v
    assert not r.promoted and r.failed == ["b", "c"]
