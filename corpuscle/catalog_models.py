"""Queries that train, mine and search over the tables: merges in rounds, candidates, losses, phrases, joined shards, files, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle import sql
from corpuscle.catalog import _ID, MERGES, chunk_sql, documents, fires_sql, merge_rows_sql, named, query, register_sql, ship_code, staged_sql, table, vocab_sql
from corpuscle.cluster import Scratch, checkpointed
from corpuscle.functions.patterns import BASE, duckdb_chunks
from corpuscle.operators import bpe, chunks, dropout, evaluation, geometry, joined, losses, merging, phrases, surfaces, unigram
from corpuscle.plans import fixpoint, reports
from corpuscle.sources import corpus, physical
from corpuscle.streaming import decoding

_ROUNDS = 32


@query(f"WITH {staged_sql(_ROUNDS)} {merge_rows_sql(_ROUNDS)}")
def bpe_merges_in_rounds(spark, sf_dir):
    """The merges of training one by one, several a pass, over blocks of chunks."""
    counts = chunks.counted(documents(spark, sf_dir, "text"))
    return named(merging.train_in_rounds(counts, bpe.BYTES + _ROUNDS)[0])


_BARRED = 8


def barred_sql(steps: int) -> str:
    """Candidate k goes on from the words before merge k without that merge's pair; the last one is plain training."""
    out, rows = [staged_sql(steps)], []
    for k in range(steps + 1):
        last = f"w{k}"
        for j in range(k, steps if k < steps else k):
            out.append(
                f"q{k}_{j} AS MATERIALIZED (SELECT a, b, c FROM (SELECT t[i] AS a, t[i + 1] AS b, sum(n)::BIGINT AS c FROM (SELECT t, n, unnest(range(1, len(t))) AS i FROM (SELECT string_split(trim(w, '<>'), '><') AS t, n FROM {last})) GROUP BY 1, 2) "
                f"WHERE (a, b) NOT IN (SELECT (a, b) FROM p{k}) ORDER BY c DESC, a, b LIMIT 1)"
            )
            out.append(f"x{k}_{j + 1} AS MATERIALIZED (SELECT chunk, replace(w, '<' || a || '><' || b || '>', '<T{j:05d}>') AS w, n FROM {last}, q{k}_{j})")
            last = f"x{k}_{j + 1}"
        rows.append(f"SELECT {k} AS cand, sum(n)::BIGINT AS tokens, {256 + steps} - count(DISTINCT t) AS dead FROM (SELECT n, unnest(string_split(trim(w, '<>'), '><')) AS t FROM {last})")
    return f"WITH {', '.join(out)} {' UNION ALL '.join(rows)}"


@query(barred_sql(_BARRED))
def barred_one_by_one(spark, sf_dir):
    """The small vocabulary without each of its merges in turn: what it costs in tokens, and which tokens then never fire."""
    counts = checkpointed(chunks.counted(documents(spark, sf_dir, "text")))
    plain = bpe.collected(bpe.train(counts, bpe.BYTES + _BARRED))
    whole = {i: bytes((i,)) for i in range(bpe.BYTES)} | {m.id: m.bytes for m in plain}
    rules = [*(bpe.Rules(blocked=((whole[m.left], whole[m.right]),)) for m in plain), bpe.Rules()]
    out = evaluation.evaluate_candidates(spark, counts, counts.select(F.lit("all").alias("shard"), "chunk", "n"), [], list(enumerate(rules)), bpe.BYTES + _BARRED)
    return out.select("cand", F.col("tokens")["all"].alias("tokens"), F.col("dead")["all"].alias("dead"))


_RUNS_SQL = f"""c AS MATERIALIZED (SELECT CASE WHEN doc_id % 10 = 9 THEN 'val' ELSE 'train' END AS split, doc_id, unnest(cs) AS token, unnest(range(1, len(cs) + 1)) AS pos FROM (SELECT doc_id, {duckdb_chunks('text', BASE)} AS cs FROM documents)),
r AS MATERIALIZED (SELECT split, h2, h1, token, count(*) AS n FROM (SELECT split, coalesce(lag(token, 2) OVER w, chr(2)) AS h2, coalesce(lag(token) OVER w, chr(2)) AS h1, token FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) GROUP BY ALL),
t3 AS (SELECT h2, h1, token, sum(n) AS c3 FROM r WHERE split = 'train' GROUP BY ALL), b3 AS (SELECT h2, h1, sum(c3) AS b3 FROM t3 GROUP BY ALL),
t2 AS (SELECT h1, token, sum(c3) AS c2 FROM t3 GROUP BY ALL), b2 AS (SELECT h1, sum(c2) AS b2 FROM t2 GROUP BY ALL),
t1 AS (SELECT token, c1, rank() OVER (ORDER BY c1 DESC) - 1 AS rank FROM (SELECT token, sum(c2) AS c1 FROM t2 GROUP BY ALL)), s AS (SELECT sum(c1) + count(*) + 1 AS s FROM t1),
p1 AS (SELECT r.*, c2, b2, c3, b3, rank, (coalesce(c1, 0) + 1)::DOUBLE / s AS p FROM r LEFT JOIN t3 USING (h2, h1, token) LEFT JOIN b3 USING (h2, h1) LEFT JOIN t2 USING (h1, token) LEFT JOIN b2 USING (h1) LEFT JOIN t1 USING (token), s),
p2 AS (SELECT * EXCLUDE (p), CASE WHEN b2 IS NULL THEN p ELSE {losses.WEIGHT} * coalesce(c2, 0)::DOUBLE / b2 + (1 - {losses.WEIGHT}::DOUBLE) * p END AS p FROM p1),
l AS (SELECT split, token, n, strlen(token) * n AS bytes, rank, -ln(CASE WHEN b3 IS NULL THEN p ELSE {losses.WEIGHT} * coalesce(c3, 0)::DOUBLE / b3 + (1 - {losses.WEIGHT}::DOUBLE) * p END) * n AS nats FROM p2)"""
_BUCKET_SQL = "CASE WHEN rank IS NULL THEN -1 WHEN rank < 256 THEN 0 WHEN rank < 512 THEN 256 WHEN rank < 1024 THEN 512 WHEN rank < 2048 THEN 1024 WHEN rank < 4096 THEN 2048 WHEN rank < 8192 THEN 4096 WHEN rank < 16384 THEN 8192 WHEN rank < 32768 THEN 16384 ELSE 32768 END"


def _losses(spark, sf_dir):
    """Losses of every token of documents, scored by a model of nine tenths of them, summed by rank."""
    d = documents(spark, sf_dir, "doc_id", "text").withColumn("split", corpus.split_of(F.col("doc_id")))
    return losses.bucketed(d, "split", "train")


@query(f"WITH {_RUNS_SQL} SELECT {_BUCKET_SQL} AS bucket, split, sum(n)::BIGINT AS tokens, sum(bytes)::BIGINT AS bytes, round(sum(nats) / ln(2) / sum(bytes), 6) AS bits_per_byte FROM l GROUP BY ALL")
def loss_by_rank(spark, sf_dir):
    """Bits a byte by the rank of the token, on the documents learned from and on held-out ones."""
    out = losses.by_rank(_losses(spark, sf_dir), "split")
    return out.withColumn("bits_per_byte", F.round("bits_per_byte", 6))


@query(f"""WITH {_RUNS_SQL}, g AS (SELECT {_BUCKET_SQL} AS bucket, sum(nats) FILTER (split = 'train') / ln(2) / sum(bytes) FILTER (split = 'train') AS train, sum(nats) FILTER (split = 'val') / ln(2) / sum(bytes) FILTER (split = 'val') AS val FROM l GROUP BY 1)
SELECT bucket, round(train, 6) AS train, round(val, 6) AS val, round(val - train, 6) AS gap FROM g""")
def loss_gap_by_rank(spark, sf_dir):
    """How much worse held-out tokens of each rank are predicted than those learned from."""
    from corpuscle.operators import registers

    return registers.split_gap(_losses(spark, sf_dir), "bucket", "split").select("bucket", *[F.round(c, 6).alias(c) for c in ("train", "val", "gap")])


@query()
def standalone_surfaces(spark, sf_dir):
    """Words and pairs of words of the benchmark, in any script, found standing alone in documents."""
    items = table(spark, sf_dir, "benchmark").select("text")
    words = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}'-]+"), F.lit(0)))
    pairs = F.explode(F.regexp_extract_all("text", F.lit(r"(?=(?<![\p{L}\p{M}])([\p{L}\p{M}]+ [\p{L}\p{M}]+))"), F.lit(1)))
    return surfaces.standalone(documents(spark, sf_dir, "text"), items.select(words.alias("word")).union(items.select(pairs.alias("word"))))


@query(f"""WITH t AS (SELECT coalesce(lang, '') AS lang, string_agg(coalesce(text, ''), '' ORDER BY doc_id) AS text FROM documents GROUP BY 1), c AS (SELECT lang, chunk, count(*) AS n FROM ({chunk_sql(columns='lang, ', source='t')}) GROUP BY ALL)
SELECT lang, sum(n)::BIGINT AS n_chunks, count(*) AS n_distinct, sum(length(chunk) * n)::BIGINT AS chars, sum(n * n)::BIGINT AS squares FROM c GROUP BY lang""")
def joined_shard_chunks(spark, sf_dir):
    """Chunks of each language's documents read as one text, so that chunks cross from document to document."""
    c = joined.counted_joined(documents(spark, sf_dir, "doc_id", "lang", "text"), "lang")
    return c.groupBy("lang").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_distinct"), F.sum(F.length("chunk") * F.col("n")).alias("chars"), F.sum(F.col("n") * F.col("n")).alias("squares"))


_GLUE, _TOP, _DERIVED = 60, 80, 40


def _unshadowed_sql(name: str, pairs: str) -> str:
    return f"""{name} AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS taken, ''::VARCHAR AS l, ''::VARCHAR AS r, 0::BIGINT AS n, false AS stays
UNION ALL SELECT p.k, CASE WHEN list_contains(s.taken, p.l) THEN s.taken ELSE list_append(s.taken, p.r) END, p.l, p.r, p.n, NOT list_contains(s.taken, p.l) FROM {name} s JOIN {pairs} p ON p.k = s.k + 1)"""


@query(f"""WITH RECURSIVE c AS MATERIALIZED (SELECT doc_id, unnest(cs) AS chunk, unnest(range(1, len(cs) + 1)) AS pos FROM (SELECT doc_id, {duckdb_chunks('text', BASE)} AS cs FROM documents)),
g AS MATERIALIZED (SELECT chunk FROM c WHERE regexp_full_match(chunk, ' \\p{{L}}+') GROUP BY chunk ORDER BY count(*) DESC, chunk LIMIT {_GLUE}),
t AS MATERIALIZED (SELECT doc_id, pos, chunk AS l, lead(chunk) OVER w AS r, lead(chunk, 2) OVER w AS x FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
p1 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, l, r) AS k FROM (SELECT l, r, count(*) AS n FROM t WHERE l IN (FROM g) AND r IN (FROM g) GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, l, r LIMIT {_TOP})),
{_unshadowed_sql('s1', 'p1')},
h AS (SELECT doc_id, pos, t.l, t.r, x, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM t SEMI JOIN (SELECT l, r FROM s1 WHERE stays) s ON s.l = t.l AND s.r = t.r),
f AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS place FROM h) WHERE place % 2 = 1),
p2 AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY n DESC, l, r) AS k FROM (SELECT f.l || f.r AS l, x AS r, count(*) AS n FROM f ANTI JOIN f y ON y.doc_id = f.doc_id AND y.pos = f.pos + 2 WHERE x IN (FROM g) GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, l, r LIMIT {_DERIVED})),
{_unshadowed_sql('s2', 'p2')}
SELECT 1 AS pass, (row_number() OVER (ORDER BY k) - 1)::INT AS ord, l, r, n FROM s1 WHERE stays UNION ALL SELECT 2, (row_number() OVER (ORDER BY k) - 1)::INT, l, r, n FROM s2 WHERE stays""")
def mined_phrases_two_pass(spark, sf_dir):
    """Phrases of frequent words, then phrases that go on from these; what an earlier one shadows is left out."""
    d = documents(spark, sf_dir, "text")
    glue = chunks.counted(d).where(F.col("chunk").rlike(r"^ \p{L}+$")).orderBy(F.desc("n"), "chunk").limit(_GLUE)
    words = [r.chunk for r in glue.collect()]
    return phrases.mined(d, words, words, _TOP, _DERIVED)


@query("""WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT i, avg(x) AS m, count(*) AS n FROM v GROUP BY i),
c AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / any_value(n) - any_value(p.m) * any_value(q.m) AS cov FROM v a JOIN v b USING (vec_id) JOIN (SELECT i, m, n FROM m) p ON p.i = a.i JOIN (SELECT i, m FROM m) q ON q.i = b.i GROUP BY a.i, b.i)
SELECT (SELECT max(n) FROM m) AS n, count(*) FILTER (i = j) AS dims, round(sum(cov) FILTER (i = j) / count(*) FILTER (i = j), 9) AS mean_variance, round((sum(cov) FILTER (i = j)) ** 2 / sum(cov * cov), 6) AS effective_rank FROM c""")
def embedding_spread(spark, sf_dir):
    """Mean variance and effective rank of the embeddings, from partial matrices."""
    out = geometry.spread(geometry.covariance(table(spark, sf_dir, "embeddings")))
    return out.select("n", "dims", F.round("mean_variance", 9).alias("mean_variance"), F.round("effective_rank", 6).alias("effective_rank"))


@query(" UNION ALL ".join(f"""SELECT {d} AS span, count(*) AS n, round(avg(list_dot_product(s, t) / greatest(sqrt(list_dot_product(s, s) * list_dot_product(t, t)), 1e-8)), 6) AS cosine FROM (
SELECT list_transform(list_zip(b, v), lambda z: z[1] - z[2]) AS s, list_transform(list_zip(c, b), lambda z: z[1] - z[2]) AS t FROM (SELECT v, lead(v, {d}) OVER w AS b, lead(v, {2 * d}) OVER w AS c FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) WINDOW w AS (PARTITION BY vec_id // 32 ORDER BY vec_id)) WHERE c IS NOT NULL)""" for d in (1, 10)))
def embedding_straightness(spark, sf_dir):
    """Cosines of steps, one behind the other, over runs of 32 vectors."""
    rows = table(spark, sf_dir, "embeddings").withColumn("run", F.floor(F.col("vec_id") / 32))
    return geometry.straightness(rows, "run", "vec_id", (1, 10)).select("span", "n", F.round("cosine", 6).alias("cosine"))


@query("""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, row_number() OVER () - 1 AS row FROM documents), b AS (SELECT row // 128 AS batch, sum(n) AS n FROM d GROUP BY 1),
s AS (SELECT batch, coalesce(sum(n) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT doc_id, row FROM d JOIN s ON s.batch = row // 128 WHERE before < 400000""")
def capped_by_file_order(spark, sf_dir):
    """Batches of at most 128 rows of a row group, as the files hold them, until 400,000 characters."""
    ship_code(spark)
    return physical.capped_by_batch(spark, f"{sf_dir}/documents.parquet", 400_000, "doc_id", rows_a_batch=128).select("doc_id", "row")


@query()
def heldout_search(spark, sf_dir):
    """Two rounds of the search over documents: pairs that make mangled tokens are mined, each is measured on held-out sources, the best is kept if nothing gets worse by it."""
    d = documents(spark, sf_dir, "doc_id", "source", "text")
    words = [r.word for r in corpus.words_of(table(spark, sf_dir, "benchmark").select("text")).collect()]  # a dictionary
    held = chunks.counted(d.where("doc_id % 5 = 0"), by=("source",)).withColumnRenamed("source", "shard")
    evaluator = fixpoint.Evaluator(spark, chunks.counted(d.where("doc_id % 5 <> 0")), held, words, bpe.BYTES + 4 * MERGES)
    state = fixpoint.searched(evaluator, fixpoint.miner(evaluator, most=24), rounds=2, comp_tolerance=20, dead_tolerance=10)
    return fixpoint.verdict_table(spark, state).join(fixpoint.kept_table(spark, state), ["l", "r"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


# --- other ways to encode ---


def _small(spark, sf_dir, merges=MERGES):
    """(chunk counts, the small vocabulary's merges)."""
    counts = checkpointed(chunks.counted(documents(spark, sf_dir, "text")))
    return counts, bpe.collected(bpe.train(counts, bpe.BYTES + merges))


@query(f"""WITH {staged_sql(by='lang')} SELECT lang, sum(len(string_split(trim(w, '<>'), '><')) * n)::BIGINT AS kept_all, sum(strlen(chunk) * n)::BIGINT AS kept_none, true AS between FROM w{MERGES} GROUP BY lang""")
def dropout_tokens(spark, sf_dir):
    """Tokens by language where no merge is left out, where all are, and whether leaving out a tenth lies between."""
    _, made = _small(spark, sf_dir)
    d, out = documents(spark, sf_dir, "doc_id", "lang", "text"), None
    for name, share in (("kept_all", 0.0), ("some", 0.1), ("kept_none", 1.0)):
        own = dropout.encoded(d, made, share, seed=7).groupBy("lang").agg(F.sum(F.size("ids")).alias(name))
        out = own if out is None else out.join(own, "lang")
    return out.select("lang", "kept_all", "kept_none", ((F.col("some") > F.col("kept_all")) & (F.col("some") < F.col("kept_none"))).alias("between"))


@query("SELECT doc_id, strlen(text) AS bytes, true AS same FROM documents WHERE text IS NOT NULL")
def dropout_round_trip(spark, sf_dir):
    """Every document encoded with a third of its merges left out, and decoded by a function that SQL calls."""
    _, made = _small(spark, sf_dir)
    sql.register_vocabulary(spark, made, "small")
    d = documents(spark, sf_dir, "doc_id", "text").where("text is not null").withColumn("own", F.col("text"))
    back = dropout.encoded(d, made, 0.33, seed=3).withColumn("back", F.call_function("small_decode", "ids"))
    return back.select("doc_id", F.octet_length("back").cast("long").alias("bytes"), (F.col("back") == F.col("own")).alias("same"))


@query(f"""WITH {staged_sql(by='lang')} SELECT lang, sum(len(string_split(trim(w, '<>'), '><')) * n)::BIGINT AS tokens, sum(len(string_split(trim(w, '<>'), '><')) * n)::BIGINT AS rows FROM w{MERGES} GROUP BY lang""")
def sql_token_counts(spark, sf_dir):
    """Tokens counted in SQL, by a function and by a table function."""
    _, made = _small(spark, sf_dir)
    sql.register_vocabulary(spark, made, "small")
    documents(spark, sf_dir, "lang", "text").createOrReplaceTempView("corpuscle_texts")
    return spark.sql("""SELECT lang, tokens, `rows` FROM (SELECT lang, sum(small_count(text)) AS tokens FROM corpuscle_texts GROUP BY lang)
        JOIN (SELECT lang, count(*) AS `rows` FROM corpuscle_texts, LATERAL small_tokens(text) GROUP BY lang) USING (lang)""")


_SEEDS = 12


def seeded_sql(steps: int, most: int) -> str:
    """Operands' numbers from names; a seed stands behind the later operand, and all later ids move up."""
    number = lambda c: _ID.replace("t[", f"{c}[").replace("|| t)", f"|| {c})")
    return f"""WITH {staged_sql(steps)}, {vocab_sql(steps)}, s AS (SELECT a, b, row_number() OVER (ORDER BY c DESC, a, b) AS k FROM
(SELECT t[i] AS a, t[i + 1] AS b, sum(n) AS c FROM (SELECT t, n, unnest(range(1, len(t))) AS i FROM (SELECT string_split(trim(w, '<>'), '><') AS t, n FROM w{steps})) GROUP BY 1, 2 ORDER BY c DESC, a, b LIMIT {most})),
h AS (SELECT k, greatest({number('a')}, {number('b')}, 255) AS place, x.hex || y.hex AS hex FROM s JOIN v{steps} x ON x.name = a JOIN v{steps} y ON y.name = b),
u AS (SELECT min(k) AS k, min_by(place, k) AS place, hex FROM h WHERE hex NOT IN (SELECT hex FROM vocab) GROUP BY hex),
r AS (SELECT id AS place, 0 AS k, hex, false AS seed FROM vocab UNION ALL SELECT place, k, hex, true FROM u)
SELECT (row_number() OVER (ORDER BY place, k) - 1)::INT AS id, hex, seed FROM r"""


@query(seeded_sql(MERGES, _SEEDS))
def seeded_vocabulary(spark, sf_dir):
    """The small vocabulary with the pairs that stand beside each other most often put in behind their operands."""
    counts, made = _small(spark, sf_dir)
    w = bpe.folded_encode(counts.select(bpe.word(F.col("chunk")).alias("w"), "n"), made)
    whole = {i: bytes((i,)) for i in range(bpe.BYTES)} | {m.id: m.bytes for m in made}
    pairs = [(whole[bpe.number(r.a)], whole[bpe.number(r.b)]) for r in bpe.pair_counts(w).orderBy(F.desc("n"), "a", "b").limit(_SEEDS).collect()]
    merges, ids = bpe.insert_seeds(made, pairs)
    rows = [(i, bytes((i,)).hex().upper(), False) for i in range(bpe.BYTES)] + [(m.id, m.bytes.hex().upper(), m.id in set(ids)) for m in merges]
    return spark.createDataFrame(rows, "id int, hex string, seed boolean")


@query()
def unigram_against_bpe(spark, sf_dir):
    """Bytes a token of a unigram vocabulary of 2,000 pieces and of a byte-pair one of that size, both learned from all documents."""
    counts = checkpointed(chunks.counted(documents(spark, sf_dir, "text")))
    pieces, log = unigram.train(counts, 2000)
    made = bpe.collected(bpe.train(counts, 2000))
    total = counts.agg(F.sum(F.octet_length("chunk") * F.col("n")).alias("bytes"))
    own = unigram.encoded(counts, pieces).agg(F.lit("unigram").alias("kind"), F.lit(len(pieces)).alias("size"), F.sum(F.size("pieces") * F.col("n")).alias("tokens"))
    other = bpe.encoded(counts, made).agg(F.lit("bpe").alias("kind"), F.lit(bpe.BYTES + len(made)).alias("size"), F.sum(F.size("ids") * F.col("n")).alias("tokens"))
    return own.union(other).crossJoin(total).select("kind", "size", "tokens", (F.col("bytes") / F.col("tokens")).alias("bytes_per_token"))  # one row each


#: Tokens of a run in the stream; a character may begin in one and end in the next.
_RUN = 512


@query("SELECT doc_id, strlen(text) AS bytes, true AS same FROM documents WHERE text <> ''")
def stream_decoded_documents(spark, sf_dir):
    """Runs of tokens of all documents as a stream of files, decoded as they arrive; the pieces of each document are its text."""
    _, made = _small(spark, sf_dir)
    d = documents(spark, sf_dir, "doc_id", "text").where("text <> ''")
    with Scratch(spark, "stream") as scratch:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / _RUN).cast("int")), lambda k: F.slice("ids", k * _RUN + 1, F.lit(_RUN)))
        bpe.encoded_texts(d, made, BASE).select("doc_id", F.posexplode(runs).alias("pos", "id")).select("doc_id", F.col("pos").cast("long").alias("pos"), "id").write.parquet(f"{scratch.folder}/rows")
        stream = spark.readStream.schema("doc_id long, pos long, id array<int>").parquet(f"{scratch.folder}/rows")
        pieces = decoding.decoded(stream, made)
        pieces.writeStream.format("parquet").option("path", f"{scratch.folder}/pieces").option("checkpointLocation", f"{scratch.folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(pieces.schema).parquet(f"{scratch.folder}/pieces").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("text").alias("t")))).alias("x"))
        back = got.select("doc_id", F.array_join(F.transform("x", lambda v: v["t"]), "").alias("back"))
        return checkpointed(d.join(back, "doc_id", "left").select("doc_id", F.octet_length("back").cast("long").alias("bytes"), F.coalesce(F.col("back") == F.col("text"), F.lit(False)).alias("same")))


# --- reports ---


@query(" UNION ALL ".join(f"""SELECT * FROM ({register_sql(kind)}, t AS (SELECT lang, sum(n) AS pt, count(*) AS k, sum(n::DOUBLE * n) AS pp FROM p GROUP BY lang), u AS (SELECT sum(m) AS qt, sum(m::DOUBLE * m) AS qq FROM q)
SELECT lang, '{kind}' AS kind, round(coalesce(sum(n::DOUBLE * m) / sqrt(any_value(pp) * any_value(qq)), 0), 6) AS cosine, round(sum(n::DOUBLE / pt * ln((n::DOUBLE / pt) / coalesce(m::DOUBLE / qt, 1.0 / (qt + k)))), 6) AS kl FROM p JOIN t USING (lang) LEFT JOIN q USING (gram), u GROUP BY lang)""" for kind in ("word", "bigram", "char4")))
def register_overlap(spark, sf_dir):
    """Overlap of each language with the benchmark, in words, pairs of words and runs of four characters."""
    out = reports.register_report(documents(spark, sf_dir, "doc_id", "lang", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("lang", "kind", F.round("cosine", 6).alias("cosine"), F.round("kl", 6).alias("kl"))


@query(f"""WITH {fires_sql()}, {vocab_sql()}, t AS (SELECT sum(len(string_split(trim(w, '<>'), '><')) * n)::BIGINT AS tokens, sum(length(chunk) * n)::BIGINT AS chars, sum(strlen(chunk) * n)::BIGINT AS bytes FROM w{MERGES}),
d AS (SELECT count(*) AS n_tokens, count(*) FILTER (fires IS NULL) AS n_dead, max(id) + 1 - count(DISTINCT id) AS n_holes, max(length(hex) // 2) AS longest FROM vocab LEFT JOIN fires USING (id)),
m AS (SELECT round(sum(id * fires)::DOUBLE / sum(fires), 9) AS wmean_id FROM fires), r AS (SELECT count(*) AS docs, count(*) AS same FROM documents)
SELECT tokens, chars, bytes, n_tokens, n_dead, n_holes::BIGINT AS n_holes, longest::INT AS longest, wmean_id, docs, same FROM t, d, m, r""")
def tokenizer_summary(spark, sf_dir):
    """The report on the small vocabulary in one row: compression, dead tokens, holes, and documents that come back from their tokens."""
    d = documents(spark, sf_dir, "doc_id", "text")
    _, made = _small(spark, sf_dir)
    rep = reports.tokenizer_report(d, spark.createDataFrame(bpe._frame(made), bpe.MERGES))
    row = rep["totals"].select("tokens", "chars", "bytes")
    parts = (rep["dead"].select("n_tokens", "n_dead"), rep["density"].select(F.col("n_holes").cast("long").alias("n_holes")), rep["lengths"].select(F.col("max_len").alias("longest")), rep["mean_id"].select(F.round("wmean_id", 9).alias("wmean_id")), rep["round_trip"])
    for part in parts:  # one row each
        row = row.crossJoin(part)
    return row


@query(f"""WITH {fires_sql()}, {vocab_sql()}, h AS (SELECT t, sum(n) AS fires FROM (SELECT n, unnest(string_split(trim(w, '<>'), '><')) AS t FROM w{MERGES // 2}) GROUP BY t),
a AS (SELECT hex AS token, fires FROM h JOIN v{MERGES // 2} ON name = t), b AS (SELECT hex AS token, fires FROM fires JOIN vocab USING (id)),
c AS (SELECT token, coalesce(b.fires, 0)::BIGINT - coalesce(a.fires, 0)::BIGINT AS change FROM a FULL JOIN b USING (token))
SELECT * FROM (SELECT 'gain' AS kind, token, change FROM c ORDER BY change DESC, token LIMIT 15) UNION ALL SELECT * FROM (SELECT 'loss', token, change FROM c ORDER BY change, token LIMIT 15)
UNION ALL SELECT 'born', hex, NULL FROM vocab WHERE hex NOT IN (SELECT hex FROM v{MERGES // 2})""")
def tokenizer_changes(spark, sf_dir):
    """What the small vocabulary's second half changes: tokens that fire more, or less, by their bytes, and those that are new."""
    _, made = _small(spark, sf_dir)
    both = [spark.createDataFrame(bpe._frame(m), bpe.MERGES) for m in (made[: MERGES // 2], made)]
    rep = reports.compared_tokenizers(documents(spark, sf_dir, "source", "text"), *both)
    rows = [rep[name].select(F.lit(kind).alias("kind"), "token", "change") for kind, name in (("gain", "gainers"), ("loss", "losers"))]
    return rows[0].union(rows[1]).union(rep["vocabulary"].where("kind = 'born'").select("kind", "token", F.lit(None).cast("long")))
