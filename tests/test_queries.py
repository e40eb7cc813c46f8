"""Every registered query against its SQL on the smallest tables; sources; the stream."""

import math

import duckdb
import pytest

import __spark_entry__
from corpuscle import catalog
from corpuscle.sources import corpus

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert ours == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())


def test_surface_round_trip(spark, sf_dir):
    assert catalog.QUERIES["surface_roundtrip"](spark, sf_dir).where("not same").isEmpty()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 8
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sources(spark, tmp_path):
    run = tmp_path / "a"
    run.mkdir()
    (run / "eval.csv").write_text("Task, Accuracy, Centered\narc, 0.5, 0.2\nshort\nboolq, x, nan?\nCORE,,0.25\n")
    (run / "meta.json").write_text('{"user_config": {"run": "first"}}')
    (run / "train.log").write_text("bpb 1.5 + 0.5\nnoise\nbpb 1.25 + 0.25\nend\n")
    got = {r.task: (r.accuracy, r.centered) for r in corpus.eval_csv(spark, str(run / "eval.csv")).collect()}
    assert got == {"arc": (0.5, 0.2), "CORE": (None, 0.25)}
    assert [r.run for r in corpus.run_index(spark, str(tmp_path)).collect()] == ["first"]
    last = corpus.last_match(spark, str(run / "train.log"), r"bpb ([0-9.]+) \+ ([0-9.]+)", ("joint", "overhead")).first()
    assert (last.joint, last.overhead) == (1.25, 0.25)


def test_stream_counts_equal_batch(spark, tmp_path):
    from corpuscle.operators import chunks
    from corpuscle.streaming import counts

    d = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "in"))
    q = counts.chunk_counts(counts.documents(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("chunk_stream").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("chunk_stream").collect())) == sorted(map(tuple, chunks.counted(d.select("text")).collect()))


def test_reports_run(spark, sf_dir):
    from corpuscle.plans import reports

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    merges = reports.trained_tokenizer(docs, 320)
    rep = reports.tokenizer_report(docs, merges)
    trip = rep["round_trip"].first()
    assert trip.docs == trip.same and rep["density"].first().n_holes == 0
    other = reports.trained_tokenizer(docs, 310)
    assert reports.compared_tokenizers(docs, other, merges)["vocabulary"].where("kind = 'born'").count() == 10
    assert reports.mangled_report(docs, merges)["suffix"].count() >= 1
