"""All queries of the library by name, with SQL that a second engine can run on the same tables.

The SQL is written for DuckDB and shares no code with the Spark side but fixed values (patterns, affix lists). Queries that need a
vocabulary train a small one; the SQL trains the same, one pair of subqueries for each merge.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.cluster import checkpointed, ship_code
from corpuscle.functions import text as T
from corpuscle.functions.patterns import BASE, SPACELESS, SUFFIXES, duckdb_chunks
from corpuscle.operators import bpe, chunks, evaluation, metrics, morphology, registers, surface
from corpuscle.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Merges of the small vocabulary.
MERGES = 16


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def trained(spark: SparkSession, sf_dir: str, rules: bpe.Rules = bpe.Rules(), by: tuple[str, ...] = (), merges: int = MERGES):
    """(merge table, chunks with ids, vocabulary) of the small vocabulary on documents. Texts are split and counted once, and the vocabulary is trained once."""
    counts = checkpointed(chunks.counted(documents(spark, sf_dir, *by, "text"), by=by))
    table = bpe.train(counts.groupBy("chunk").agg(F.sum("n").alias("n")) if by else counts, bpe.BYTES + merges, rules)
    made = bpe.collected(table)  # as many rows as there are merges
    own = spark.createDataFrame(bpe._frame(made), bpe.MERGES)
    return own, checkpointed(bpe.encoded(counts, made)), bpe.vocabulary(own)


# --- the same in SQL ---


def chunk_sql(pattern: str = BASE, columns: str = "", source: str = "documents", text: str = "text") -> str:
    return f"SELECT {columns}unnest({duckdb_chunks(text, pattern)}) AS chunk FROM {source}"


def staged_sql(steps: int = MERGES, allowed: str = "", by: str = "") -> str:
    """CTEs w0 ... w<steps> (by, chunk, w, n) and p0 ... (a, b, c): words after so many merges, and the pair of each."""
    bys = f"{by}, " if by else ""
    out = [
        f"counted AS (SELECT {bys}chunk, count(*) AS n FROM ({chunk_sql(columns=bys)}) GROUP BY ALL)",
        f"w0 AS MATERIALIZED (SELECT {bys}chunk, regexp_replace(hex(chunk), '(..)', '<\\1>', 'g') AS w, n FROM counted)",
    ]
    for k in range(steps):
        out.append(
            f"p{k} AS MATERIALIZED (SELECT t[i] AS a, t[i + 1] AS b, sum(n)::BIGINT AS c FROM (SELECT t, n, unnest(range(1, len(t))) AS i FROM "
            f"(SELECT string_split(trim(w, '<>'), '><') AS t, n FROM w{k})) {f'WHERE {allowed}' if allowed else ''} GROUP BY 1, 2 ORDER BY c DESC, a, b LIMIT 1)"
        )
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT {bys}chunk, replace(w, '<' || a || '><' || b || '>', '<T{k:05d}>') AS w, n FROM w{k}, p{k})")
    return ",\n".join(out)


_ID = "CASE WHEN t[1] = 'T' THEN 256 + t[2:]::INT ELSE ('0x' || t)::INT END"


def fires_sql(steps: int = MERGES, by: str = "") -> str:
    """CTE fires (by, id, fires, first, last)."""
    bys = f"{by}, " if by else ""
    return f"""{staged_sql(steps, by=by)},
spread AS (SELECT {bys}t, n, i, k FROM (SELECT {bys}n, len(ts) AS k, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT {bys}n, string_split(trim(w, '<>'), '><') AS ts FROM w{steps}))),
fires AS MATERIALIZED (SELECT {bys}{_ID} AS id, sum(n)::BIGINT AS fires, coalesce(sum(n) FILTER (i = 1), 0)::BIGINT AS first, coalesce(sum(n) FILTER (i = k), 0)::BIGINT AS last FROM spread GROUP BY ALL)"""


def merge_rows_sql(steps: int) -> str:
    return " UNION ALL ".join(f"SELECT {256 + k} AS id, a, b, c AS n FROM p{k}" for k in range(steps))


def vocab_sql(steps: int = MERGES) -> str:
    """CTE vocab (id, hex)."""
    rows = ["v_bytes AS (SELECT i::INT AS id, printf('%02X', i) AS hex FROM range(256) t(i))"]
    names = "v0 AS (SELECT printf('%02X', i) AS name, printf('%02X', i) AS hex FROM range(256) t(i))"
    rows.append(names)
    for k in range(steps):
        rows.append(f"v{k + 1} AS MATERIALIZED (SELECT * FROM v{k} UNION ALL SELECT 'T{k:05d}', x.hex || y.hex FROM p{k} JOIN v{k} x ON x.name = a JOIN v{k} y ON y.name = b)")
    rows.append(f"vocab AS MATERIALIZED (SELECT {_ID.replace('t[', 'name[').replace('|| t)', '|| name)')} AS id, hex FROM v{steps})")
    return ",\n".join(rows)


# --- chunks ---

TOP = "SELECT chunk, n FROM ({}) ORDER BY n DESC, chunk LIMIT 50"


@query(TOP.format(f"SELECT chunk, count(*) AS n FROM ({chunk_sql()}) GROUP BY chunk"))
def chunk_topk(spark, sf_dir):
    return chunks.counted(documents(spark, sf_dir, "text")).orderBy(F.desc("n"), "chunk").limit(50)


@query(TOP.format(f"SELECT chunk, count(*) AS n FROM ({chunk_sql(SPACELESS)}) GROUP BY chunk"))
def spaceless_chunk_topk(spark, sf_dir):
    return chunks.counted(documents(spark, sf_dir, "text"), SPACELESS).orderBy(F.desc("n"), "chunk").limit(50)


@query(f"SELECT lang, count(*) AS n_chunks, count(DISTINCT chunk) AS n_distinct FROM ({chunk_sql(columns='lang, ')}) GROUP BY lang")
def chunk_count_by_lang(spark, sf_dir):
    c = chunks.counted(documents(spark, sf_dir, "lang", "text"), by=("lang",))
    return c.groupBy("lang").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_distinct"))


@query(f"SELECT count(*) AS n_chunks, count(DISTINCT chunk) AS n_distinct, sum(length(chunk))::BIGINT AS chars FROM ({chunk_sql(source='pages', text='html')})")
def html_chunk_stats(spark, sf_dir):
    c = chunks.counted(table(spark, sf_dir, "pages").select("html"), text="html")
    return c.agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_distinct"), F.sum(F.length("chunk") * F.col("n")).alias("chars"))


@query(f"""SELECT source AS shard, count(*) AS n_distinct, sum(n)::BIGINT AS n_chunks FROM (SELECT source, chunk, count(*) AS n FROM ({chunk_sql(columns='source, ')}) GROUP BY ALL) GROUP BY source""")
def shard_star_counts(spark, sf_dir):
    _, counts = chunks.shard_star(documents(spark, sf_dir, "source", "text"))
    return counts.groupBy("shard").agg(F.count("*").alias("n_distinct"), F.sum("n").alias("n_chunks"))


# --- scans and totals ---


@query("SELECT doc_id FROM (SELECT doc_id, sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents) WHERE coalesce(before, 0) < 500000")
def char_cap_scan(spark, sf_dir):
    return corpus.capped(documents(spark, sf_dir, "doc_id", "text"), 500_000).select("doc_id")


@query("SELECT source, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM (SELECT source, left(text, 1000) AS text, sum(length(left(text, 1000))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents) WHERE coalesce(before, 0) <= 20000 GROUP BY source")
def char_cap_by_shard(spark, sf_dir):
    d = corpus.capped(documents(spark, sf_dir, "doc_id", "source", "text"), 20_000, shard="source", doc_cap=1000, after=True)
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT sum(strlen(text))::BIGINT AS bytes, sum(len(regexp_extract_all(text, ' [^\\s\\x0B]')))::BIGINT AS space_bits FROM documents")
def corpus_bytes_bits(spark, sf_dir):
    return surface.space_bits(documents(spark, sf_dir, "text"))


@query("SELECT CASE WHEN doc_id % 10 = 9 THEN 'val' ELSE 'train' END AS split, count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def split_sizes(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text").select(corpus.split_of(F.col("doc_id")).alias("split"), F.length("text").alias("n"))
    return d.groupBy("split").agg(F.count("*").alias("docs"), F.sum("n").alias("chars"))


# --- byte pairs ---


@query(f"""WITH {staged_sql(0)} SELECT t[i] AS a, t[i + 1] AS b, sum(n)::BIGINT AS n FROM (SELECT t, n, unnest(range(1, len(t))) AS i FROM (SELECT string_split(trim(w, '<>'), '><') AS t, n FROM w0)) GROUP BY 1, 2""")
def byte_pair_counts(spark, sf_dir):
    return bpe.byte_pairs(chunks.counted(documents(spark, sf_dir, "text")))


def named(merges: DataFrame) -> DataFrame:
    name = lambda c: F.when(F.col(c) < 256, F.lpad(F.hex(F.col(c)), 2, "0")).otherwise(F.format_string("T%05d", F.col(c) - 256))
    return merges.select("id", name("left").alias("a"), name("right").alias("b"), "n")


@query(f"WITH {staged_sql(8)} {merge_rows_sql(8)}")
def bpe_merges_8(spark, sf_dir):
    return named(bpe.train_by_frames(chunks.counted(documents(spark, sf_dir, "text")), 8))


@query(f"WITH {staged_sql(32)} {merge_rows_sql(32)}")
def bpe_merges_32_in_task(spark, sf_dir):
    return named(bpe.train(chunks.counted(documents(spark, sf_dir, "text")), bpe.BYTES + 32, mode="task"))


BLOCKED = ((" ", "t"), ("e", "r"), ("t", "h"))


@query(f"""WITH {staged_sql(12, " AND ".join(f"NOT (t[i] = '{a.encode().hex().upper()}' AND t[i + 1] = '{b.encode().hex().upper()}')" for a, b in BLOCKED))} {merge_rows_sql(12)}""")
def bpe_blocked_merges(spark, sf_dir):
    return named(bpe.train(chunks.counted(documents(spark, sf_dir, "text")), bpe.BYTES + 12, bpe.Rules.of(BLOCKED)))


def space_rule_sql(steps: int) -> str:
    """Whole lines as words; no right operand may start or end with a space unless the left is all spaces. CTEs f, e, g: tokens that start, end with, or are spaces."""
    out = [
        "counted AS (SELECT chunk, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\\n]+')) AS chunk FROM documents) GROUP BY ALL)",
        "w0 AS MATERIALIZED (SELECT regexp_replace(hex(chunk), '(..)', '<\\1>', 'g') AS w, n FROM counted)",
        "f0 AS (SELECT '20' AS x), e0 AS (SELECT '20' AS x), g0 AS (SELECT '20' AS x)",
    ]
    for k in range(steps):
        out.append(
            f"p{k} AS MATERIALIZED (SELECT a, b, c FROM (SELECT t[i] AS a, t[i + 1] AS b, sum(n)::BIGINT AS c FROM (SELECT t, n, unnest(range(1, len(t))) AS i FROM (SELECT string_split(trim(w, '<>'), '><') AS t, n FROM w{k})) GROUP BY 1, 2) "
            f"WHERE a IN (SELECT x FROM g{k}) OR NOT (b IN (SELECT x FROM f{k}) OR b IN (SELECT x FROM e{k})) ORDER BY c DESC, a, b LIMIT 1)"
        )
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT replace(w, '<' || a || '><' || b || '>', '<T{k:05d}>') AS w, n FROM w{k}, p{k})")
        for name, test in (("f", f"a IN (SELECT x FROM f{k})"), ("e", f"b IN (SELECT x FROM e{k})"), ("g", f"a IN (SELECT x FROM g{k}) AND b IN (SELECT x FROM g{k})")):
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT x FROM {name}{k} UNION ALL SELECT 'T{k:05d}' FROM p{k} WHERE {test})")
    return ",\n".join(out)


@query(f"WITH {space_rule_sql(12)} {merge_rows_sql(12)}")
def bpe_space_rules(spark, sf_dir):
    """Lines as words, so that phrases could form; the rules bar them."""
    rules = bpe.Rules(leading_space=True, trailing_space=True)
    return named(bpe.train(chunks.counted(documents(spark, sf_dir, "text"), r"[^\n]+"), bpe.BYTES + 12, rules))


#: Bytes that forced pairs and the blocked one keep from merging naturally; "the" can't come about without "th" or "he".
_BARRED = " AND ".join(f"NOT (t[i] = '{a}' AND t[i + 1] = '{b}')" for a, b in (("74", "68"), ("61", "6E"), ("68", "65")))
_NATURAL = " UNION ALL ".join(f"SELECT {256 + k if k < 20 else 279} AS id, a, b FROM p{k}" for k in range(21))


@query(f"""WITH {staged_sql(21, _BARRED)}, {vocab_sql(21)}, m AS ({_NATURAL})
SELECT m.id::INT AS id, {_ID.replace('t[', 'a[').replace('|| t)', '|| a)')}::INT AS "left", {_ID.replace('t[', 'b[').replace('|| t)', '|| b)')}::INT AS "right", x.hex || y.hex AS hex, false AS forced FROM m JOIN v21 x ON x.name = a JOIN v21 y ON y.name = b
UNION ALL VALUES (276, 116, 104, '7468', true), (277, 276, 101, '746865', true), (278, 97, 110, '616E', true)""")
def bpe_forced_merges(spark, sf_dir):
    """Twenty natural merges, three forced ones (the fourth is blocked), one more natural one in the place that is left."""
    rules = bpe.Rules.of(blocked=(("h", "e"),), forced=(("t", "h"), ("th", "e"), ("a", "n"), ("h", "e")))
    m = bpe.train(chunks.counted(documents(spark, sf_dir, "text")), bpe.BYTES + 24, rules)
    return m.select("id", "left", "right", F.hex("bytes").alias("hex"), "forced")


@query(f"WITH {fires_sql()} SELECT id, fires FROM fires")
def bpe_encode_firecounts(spark, sf_dir):
    return metrics.fire_counts(trained(spark, sf_dir)[1]).select("id", "fires")


@query(f"WITH {fires_sql()}, {vocab_sql()} SELECT count(*) AS n_tokens, count(*) FILTER (fires IS NULL) AS n_dead FROM vocab LEFT JOIN fires USING (id)")
def dead_tokens(spark, sf_dir):
    _, e, v = trained(spark, sf_dir)
    return metrics.dead(v, metrics.fire_counts(e))


@query(f"WITH {fires_sql()} SELECT round(sum(id * fires)::DOUBLE / sum(fires), 9) AS wmean_id FROM fires")
def wmean_id(spark, sf_dir):
    return metrics.weighted_mean_id(metrics.fire_counts(trained(spark, sf_dir)[1])).select(F.round("wmean_id", 9).alias("wmean_id"))


@query(f"WITH {fires_sql()}, b(lo, hi) AS (VALUES (0, 256), (256, 512), (512, 1024), (1024, 2048), (2048, 4096), (4096, 8192), (8192, 16384), (16384, 32768)) SELECT lo, hi, coalesce(sum(fires), 0)::BIGINT AS fires FROM b LEFT JOIN fires ON id >= lo AND id < hi GROUP BY ALL")
def rank_buckets(spark, sf_dir):
    return metrics.rank_buckets(metrics.fire_counts(trained(spark, sf_dir)[1]))


@query(f"""WITH {fires_sql()}, r AS (SELECT row_number() OVER (ORDER BY fires DESC, id) AS k, sum(fires) OVER (ORDER BY fires DESC, id ROWS UNBOUNDED PRECEDING) AS u, sum(fires) OVER () AS total FROM fires)
SELECT p.k::INT AS k, round(coalesce(u::DOUBLE / total, 1.0), 9) AS share FROM (VALUES (10), (50), (100), (500), (1000)) p(k) LEFT JOIN r USING (k)""")
def coverage_curve(spark, sf_dir):
    return metrics.coverage_curve(metrics.fire_counts(trained(spark, sf_dir)[1]), (10, 50, 100, 500, 1000)).select("k", F.round("share", 9).alias("share"))


@query(f"WITH {staged_sql()}, {vocab_sql()} SELECT (length(hex) // 2)::INT AS byte_len, count(*) AS n FROM vocab GROUP BY 1")
def vocab_len_hist(spark, sf_dir):
    return metrics.length_histogram(trained(spark, sf_dir)[2])


@query(f"""WITH {staged_sql()}, {vocab_sql()}, l AS (SELECT (length(hex) // 2)::INT AS n, hex FROM vocab)
SELECT count(*) AS n_tokens, avg(n) AS mean_len, max(n) AS max_len, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (regexp_full_match(hex, '(3[0-9])+')) AS n_digit, list_sort(list(n))[(count(*) // 2 + 1)::INT] AS upper_median FROM l""")
def vocab_len_stats(spark, sf_dir):
    return metrics.length_stats(trained(spark, sf_dir)[2]).drop("n_partial")


@query(f"""WITH {staged_sql(by='source')} SELECT source, sum(len(string_split(trim(w, '<>'), '><')) * n)::BIGINT AS tokens, sum(length(chunk) * n)::BIGINT AS chars, sum(strlen(chunk) * n)::BIGINT AS bytes FROM w{MERGES} GROUP BY source""")
def per_source_compression(spark, sf_dir):
    return metrics.totals(trained(spark, sf_dir, by=("source",))[1], ("source",))


@query(f"""WITH {staged_sql(by='source')}, s AS (SELECT source, sum(len(string_split(trim(w, '<>'), '><')) * n) AS t FROM w{MERGES} GROUP BY source), h AS (SELECT source, sum(len(string_split(trim(w, '<>'), '><')) * n) AS u FROM w{MERGES // 2} GROUP BY source)
SELECT count(*) AS shards, count(*) FILTER (t < u) AS wins FROM s JOIN h USING (source)""")
def shard_winrate(spark, sf_dir):
    """The small vocabulary against its first half."""
    own, e, _ = trained(spark, sf_dir, by=("source",))
    half = bpe.encoded(e.drop("ids"), bpe.collected(own)[: MERGES // 2])
    a, b = (x.groupBy("source").agg(F.sum(F.size("ids") * F.col("n")).alias(name)) for x, name in ((e, "t"), (half, "u")))
    return metrics.win_rate(a.join(b, "source"), "t", "u")


@query(f"WITH {fires_sql()} SELECT id, fires, first, last FROM fires")
def word_start_end_counts(spark, sf_dir):
    return metrics.fire_counts(trained(spark, sf_dir)[1])


def reasons_sql(steps: int = 32) -> str:
    affixes = ", ".join(f"'{a}'" for a in SUFFIXES)
    return f"""WITH {fires_sql(steps)}, {vocab_sql(steps)},
toks AS (SELECT id, s FROM (SELECT id, try(decode(unhex(hex))) AS s FROM vocab) WHERE s IS NOT NULL),
f AS (SELECT s, first::DOUBLE / fires AS p, fires FROM toks JOIN fires USING (id)),
a AS (SELECT f.s, (SELECT max_by(x, length(x)) FROM (SELECT unnest([{affixes}]) AS x) WHERE length(f.s) > length(x) AND ends_with(f.s, x)) AS affix FROM f),
r AS (SELECT s, affix, left(s, length(s) - length(affix)) AS rest FROM a),
k AS (SELECT t.s, coalesce(f.p, 0) AS p FROM toks t LEFT JOIN f USING (s)),
c AS (SELECT r.s, CASE WHEN r.s IN ({affixes}) THEN 'is_affix' WHEN own.s IS NOT NULL THEN 'is_word' WHEN affix IS NULL THEN 'no_affix' WHEN rk.s IS NULL THEN 'rest_not_token' WHEN rest IN ({affixes}) THEN 'rest_is_affix'
 WHEN starts_with(rest, ' ') THEN 'rest_spaced' WHEN rk.p >= 0.05 THEN 'rest_free' WHEN sib.s IS NOT NULL THEN 'rest_has_sibling' ELSE 'MANGLED' END AS reason
 FROM r LEFT JOIN k own ON own.s = ' ' || r.s LEFT JOIN k rk ON rk.s = r.rest LEFT JOIN k sib ON sib.s = ' ' || r.rest)
SELECT reason, count(*) AS n FROM c GROUP BY reason"""


@query(reasons_sql())
def mangled_reasons(spark, sf_dir):
    _, e, v = trained(spark, sf_dir, merges=32)
    return morphology.tally(morphology.verdicts(morphology.strings(v), metrics.fire_counts(e)))


@query(f"""WITH {staged_sql(32)}, {vocab_sql(32)}, cut AS (SELECT id, hex, unnest(range(1, length(hex) // 2)) AS k FROM vocab WHERE length(hex) > 2)
SELECT c.id, left(c.hex, 2 * k) AS l, substr(c.hex, 2 * k + 1) AS r, x.id AS l_id, y.id AS r_id FROM cut c JOIN vocab x ON x.hex = left(c.hex, 2 * k) JOIN vocab y ON y.hex = substr(c.hex, 2 * k + 1) WHERE x.id < c.id AND y.id < c.id""")
def formation_routes(spark, sf_dir):
    v = trained(spark, sf_dir, merges=32)[2]
    return morphology.routes(v, v).select("id", F.hex("l").alias("l"), F.hex("r").alias("r"), "l_id", "r_id")


@query(f"""WITH {fires_sql(32)}, m AS (SELECT i::INT AS id, coalesce(fires, 0)::BIGINT AS fires FROM range(256, 288) t(i) LEFT JOIN fires ON id = i),
r AS (SELECT fires, row_number() OVER (ORDER BY fires, id) - 1 AS k, count(*) OVER () AS n FROM m) SELECT id, fires FROM m WHERE fires <= (SELECT fires FROM r WHERE k = floor(0.25 * (n - 1))::INT)""")
def firing_percentile(spark, sf_dir):
    _, e, v = trained(spark, sf_dir, merges=32)
    return morphology.below_percentile(v, metrics.fire_counts(e), 25)


@query(f"""WITH RECURSIVE {staged_sql(32)}, m AS ({merge_rows_sql(32)}), q AS (SELECT id, {_ID.replace('t[', 'a[').replace('|| t)', '|| a)')} AS l, {_ID.replace('t[', 'b[').replace('|| t)', '|| b)')} AS r FROM m),
tree AS (SELECT id AS target, id, 0 AS depth FROM q UNION ALL SELECT target, unnest([q.l, q.r]) AS id, depth + 1 FROM tree JOIN q ON q.id = tree.id) SELECT target, max(depth)::INT AS depth, count(*) AS nodes FROM tree GROUP BY target""")
def merge_lineage(spark, sf_dir):
    own = trained(spark, sf_dir, merges=32)[0]
    return morphology.lineage(own, own).groupBy("target").agg(F.max("depth").alias("depth"), F.count("*").alias("nodes"))


@query(f"""WITH {staged_sql()}, s AS (SELECT DISTINCT chunk, n, unnest(string_split(trim(w, '<>'), '><')) AS t FROM w{MERGES}), i AS (SELECT {_ID} AS id, chunk, n FROM s)
SELECT id, chunk, n, r::INT AS r FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, chunk) AS r FROM i WHERE id >= 256) WHERE r <= 5""")
def token_contexts(spark, sf_dir):
    own, e, _ = trained(spark, sf_dir)
    return morphology.contexts(e, own, 5)


# --- case and space ---

_RUNS = r"regexp_extract_all(text, '\p{L}+|[^\p{L}]+')"
_FOLDED = r"""array_to_string(list_transform(regexp_extract_all(text, '\p{L}+|[^\p{L}]+'), lambda r: CASE WHEN regexp_full_match(r, '\p{Lu}\p{Ll}*') AND upper(lower(r[1])) = r[1] AND length(lower(r[1])) = 1 AND strlen(lower(r[1])) = strlen(r[1]) THEN lower(r[1]) || r[2:] ELSE r END), '')"""


@query(f"SELECT doc_id, md5({_FOLDED}) AS folded_md5 FROM documents")
def case_fold(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(T.fold_case(F.col("text"))).alias("folded_md5"))


@query(f"SELECT sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (regexp_full_match(chunk, ' ?\\p{{Lu}}\\p{{Ll}}*')), 0)::BIGINT AS n_title FROM (SELECT chunk, count(*) AS n FROM ({chunk_sql()}) GROUP BY chunk)")
def titlecase_share(spark, sf_dir):
    c = chunks.counted(documents(spark, sf_dir, "text"))
    return c.agg(F.sum("n").alias("n"), F.sum(F.when(T.is_titlecase(F.col("chunk")), F.col("n")).otherwise(0)).alias("n_title"))


@query(f"""WITH c AS (SELECT DISTINCT chunk, regexp_replace(chunk, '^ ', '') AS core FROM ({chunk_sql()})), t AS (SELECT core, starts_with(chunk, ' ') AS space, regexp_full_match(core, '\\p{{Lu}}\\p{{Ll}}*') AS cap FROM c WHERE regexp_matches(core, '^\\p{{L}}') AND (NOT regexp_matches(core, '^\\p{{Lu}}') OR regexp_full_match(core, '\\p{{Lu}}\\p{{Ll}}*')))
SELECT variants, count(*) AS families FROM (SELECT lower(core), count(DISTINCT (space, cap)) AS variants FROM t GROUP BY 1) GROUP BY variants""")
def case_space_families(spark, sf_dir):
    return metrics.families(chunks.counted(documents(spark, sf_dir, "text"))).groupBy("variants").agg(F.count("*").alias("families"))


def entropy_sql(bit: str, pattern: str) -> str:
    return f"""WITH c AS (SELECT doc_id, unnest(cs) AS chunk, unnest(range(1, len(cs) + 1)) AS pos FROM (SELECT doc_id, {duckdb_chunks('text', pattern)} AS cs FROM documents)),
b AS (SELECT coalesce(lag(chunk) OVER w, chr(2)) AS prev, {bit} AS bit FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT prev, count(*) AS n, sum(bit::INT) AS n1 FROM b GROUP BY prev), h AS (SELECT sum(n)::BIGINT AS n, sum(n1)::BIGINT AS n1, sum(CASE WHEN n1 IN (0, n) THEN 0 ELSE -(n1 * log2(n1::DOUBLE / n) + (n - n1) * log2((n - n1)::DOUBLE / n)) END) AS s FROM g)
SELECT n, n1, round(-(n1::DOUBLE / n * log2(n1::DOUBLE / n) + (1 - n1::DOUBLE / n) * log2(1 - n1::DOUBLE / n)), 6) AS marginal, round(s / n, 6) AS conditional FROM h"""


def _entropy(spark, sf_dir, bit, pattern):
    w = Window.partitionBy("doc_id").orderBy("pos")
    rows = chunks.positioned(documents(spark, sf_dir, "doc_id", "text"), pattern)
    rows = rows.select(F.coalesce(F.lag("chunk").over(w), F.lit("\x02")).alias("prev"), bit.alias("bit"))
    return metrics.conditional_entropy(rows, "prev", "bit").select("n", "n1", F.round("marginal", 6).alias("marginal"), F.round("conditional", 6).alias("conditional"))


@query(entropy_sql("starts_with(chunk, ' ')", BASE))
def space_bit_entropy(spark, sf_dir):
    return _entropy(spark, sf_dir, F.col("chunk").startswith(" "), BASE)


@query(entropy_sql("regexp_full_match(chunk, ' ?\\p{Lu}\\p{Ll}*')", BASE))
def cap_bit_entropy(spark, sf_dir):
    return _entropy(spark, sf_dir, T.is_titlecase(F.col("chunk")), BASE)


_POOL = f"""WITH c AS (SELECT chunk, count(*) AS n FROM ({chunk_sql()}) GROUP BY chunk), k AS (SELECT CASE WHEN regexp_full_match(s, '\\p{{Lu}}\\p{{Ll}}*') AND upper(lower(s[1])) = s[1] AND length(lower(s[1])) = 1 AND strlen(lower(s[1])) = strlen(s[1]) THEN lower(s[1]) || s[2:] ELSE s END AS content, n, strlen(chunk) AS b FROM (SELECT regexp_replace(chunk, '^ ', '') AS s, chunk, n FROM c)),
p AS (SELECT content, sum(n) AS total, max(n) AS top, count(*) AS variants, sum(n * b) AS mass FROM k GROUP BY content)"""


def _pool(spark, sf_dir):
    c = chunks.counted(documents(spark, sf_dir, "text"))
    s = T.without_space(F.col("chunk"))
    whole = F.when(s.rlike(r"^\p{Lu}\p{Ll}*$"), T.fold_case(s)).otherwise(s)
    return metrics.pooled(c.select(whole.alias("content"), "n", F.octet_length("chunk").alias("byte_len")))


@query(f"{_POOL} SELECT content, total::BIGINT AS total, top, variants FROM p WHERE variants >= 2 ORDER BY total DESC, content LIMIT 100")
def content_pooling(spark, sf_dir):
    return _pool(spark, sf_dir).where("variants >= 2").orderBy(F.desc("total"), "content").limit(100).select("content", "total", "top", "variants")


@query(f"{_POOL}, g AS (SELECT *, total::DOUBLE / top AS gain FROM p) SELECT ((gain >= 1.0000001)::INT + (gain >= 1.05)::INT + (gain >= 1.2)::INT + (gain >= 1.5)::INT + (gain >= 2)::INT + (gain >= 3)::INT)::INT AS bucket, count(*) AS families, sum(total)::BIGINT AS occurrences, sum(mass)::BIGINT AS bytes FROM g GROUP BY 1")
def pooling_buckets(spark, sf_dir):
    return metrics.pooling_buckets(_pool(spark, sf_dir))


@query(f"""WITH c AS (SELECT doc_id, unnest(cs) AS chunk, unnest(range(1, len(cs) + 1)) AS pos FROM (SELECT doc_id, {duckdb_chunks('text', SPACELESS)} AS cs FROM documents)),
s AS (SELECT doc_id, pos - 1 AS pos, sum(strlen(chunk)) OVER (PARTITION BY doc_id ORDER BY pos) AS hi, strlen(chunk) AS size FROM c),
r AS (SELECT doc_id, unnest(rs) AS run, unnest(range(1, len(rs) + 1)) AS k FROM (SELECT doc_id, {_RUNS} AS rs FROM documents)),
t AS (SELECT doc_id, run, coalesce(sum(strlen(run)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM r),
o AS (SELECT s.doc_id, s.pos, count(*) AS owned FROM s JOIN t ON s.doc_id = t.doc_id AND off >= hi - size AND off < hi WHERE regexp_matches(run, '^\\p{{L}}') GROUP BY ALL)
SELECT owned, count(*) AS chunks FROM o GROUP BY owned""")
def word_start_ownership(spark, sf_dir):
    return surface.owned_counts(documents(spark, sf_dir, "text"))


@query("SELECT doc_id, strlen(text) AS bytes, true AS same FROM documents WHERE text IS NOT NULL")
def surface_roundtrip(spark, sf_dir):
    """Every document through the dual stream and back."""
    made = bpe.collected(bpe.train(surface.folded_counts(documents(spark, sf_dir, "text")), bpe.BYTES + 64))
    codec = surface.SurfaceCodec(tuple(made), 4)
    return surface.returned(documents(spark, sf_dir, "doc_id", "text").where("text is not null"), codec).select("doc_id", "bytes", "same")


def _loader_rows(spark, sf_dir):
    made = bpe.collected(bpe.train(chunks.counted(documents(spark, sf_dir, "text")), bpe.BYTES + 64))
    whole = bpe.encoded_texts(documents(spark, sf_dir, "doc_id", "text").where("text <> ''"), made, BASE).select("doc_id", "ids")
    return surface.packed_rows(surface.with_bos(whole, "ids", bpe.BYTES + 64), 2049)


@query()
def bestfit_rows(spark, sf_dir):
    return surface.shifted(_loader_rows(spark, sf_dir))


@query("SELECT doc_id, 1::BIGINT AS times FROM documents WHERE text <> ''")
def bestfit_documents(spark, sf_dir):
    """How often each document stands in a loader's rows: once."""
    return _loader_rows(spark, sf_dir).select(F.explode("doc_ids").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("times"))


# --- words ---


@query(f"""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM benchmark), c AS (SELECT chunk, lower(chunk[2:]) AS w, count(*) AS n FROM ({chunk_sql()}) WHERE starts_with(chunk, ' ') GROUP BY ALL),
k AS (SELECT chunk, n, CASE WHEN w IN (SELECT w FROM d) THEN 'base' WHEN (ends_with(w, 's') AND length(w) > 2 AND w[:-2] IN (SELECT w FROM d)) OR (ends_with(w, 'es') AND length(w) > 3 AND w[:-3] IN (SELECT w FROM d)) OR (ends_with(w, 'ed') AND length(w) > 3 AND w[:-3] IN (SELECT w FROM d))
 OR (ends_with(w, 'ing') AND length(w) > 4 AND w[:-4] IN (SELECT w FROM d)) OR (ends_with(w, 'd') AND length(w) > 2 AND w[:-2] IN (SELECT w FROM d)) OR (ends_with(w, 'ies') AND length(w) > 4 AND w[:-4] || 'y' IN (SELECT w FROM d)) THEN 'infl' ELSE 'none' END AS kind FROM c)
SELECT kind, count(*) AS n_chunks, sum(n)::BIGINT AS n FROM k GROUP BY kind""")
def dictionary_coverage(spark, sf_dir):
    words = corpus.words_of(table(spark, sf_dir, "benchmark").select("text"))
    hits = metrics.dictionary_hits(chunks.counted(documents(spark, sf_dir, "text")), words)
    return hits.groupBy("kind").agg(F.count("*").alias("n_chunks"), F.sum("n").alias("n"))


@query("""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM benchmark), o AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) GROUP BY word)
SELECT word, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= 40 THEN 'word' WHEN coalesce(n, 0) < 8 THEN 'fragment' ELSE 'unclear' END AS verdict FROM d LEFT JOIN o USING (word)""")
def standalone_words(spark, sf_dir):
    words = corpus.words_of(table(spark, sf_dir, "benchmark").select("text"))
    return morphology.standalone(documents(spark, sf_dir, "text"), words).withColumn("verdict", morphology.bareness(F.col("n")))


@query("SELECT s, lists FROM (SELECT s, count(DISTINCT source) AS lists FROM (SELECT source, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS s FROM documents) GROUP BY s) WHERE lists >= 20")
def ambient_words(spark, sf_dir):
    lists = documents(spark, sf_dir, "source", "text").select(F.col("source").alias("list"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("s"))
    return morphology.ambient(lists, 20)


@query("""WITH t AS (SELECT quality, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM documents JOIN labels USING (doc_id))
SELECT token, CASE WHEN max(quality) = 1 THEN 'born' ELSE 'died' END AS kind FROM t GROUP BY token HAVING min(quality) = max(quality)""")
def born_died_words(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    words = d.select("quality", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("token"))
    return metrics.born_and_died(words.where("quality = 0"), words.where("quality = 1"))


@query("""WITH t AS (SELECT quality, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM documents JOIN labels USING (doc_id))
SELECT token, fires_a, fires_b, fires_b - fires_a AS change FROM (SELECT token, count(*) FILTER (quality = 0) AS fires_a, count(*) FILTER (quality = 1) AS fires_b FROM t GROUP BY token) ORDER BY change DESC, token LIMIT 15""")
def top_gainers(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    words = d.select("quality", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("token")).groupBy("token", "quality").agg(F.count("*").alias("fires"))
    return metrics.compared(words.where("quality = 0"), words.where("quality = 1")).orderBy(F.desc("change"), "token").limit(15)


_GRAMS = {
    "word": "regexp_extract_all(text, '[a-z'']+')",
    "bigram": "list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])",
    "char4": "list_transform(list_zip(cs, cs[2:], cs[3:], cs[4:])[:length(text) - 3], lambda x: x[1] || x[2] || x[3] || x[4])",
}


def register_sql(kind: str) -> str:
    """The texts of each language as one, in order, with newlines between."""
    return f"""WITH d AS MATERIALIZED (SELECT lang, text, string_split(text, '') AS cs, regexp_extract_all(text, '[a-z'']+') AS ws FROM (SELECT lang, string_agg(lower(coalesce(text, '')), chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY lang)),
b AS (SELECT text, string_split(text, '') AS cs, regexp_extract_all(text, '[a-z'']+') AS ws FROM (SELECT string_agg(lower(coalesce(text, '')), chr(10) ORDER BY item_id) AS text FROM benchmark)),
p AS (SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest({_GRAMS[kind]}) AS gram FROM d) GROUP BY ALL), q AS (SELECT gram, count(*) AS m FROM (SELECT unnest({_GRAMS[kind]}) AS gram FROM b) GROUP BY gram)"""


def _registers(spark, sf_dir, kind):
    d = corpus.registers(documents(spark, sf_dir, "doc_id", "lang", "text"), "lang")
    b = table(spark, sf_dir, "benchmark").select(F.lit("b").alias("lang"), F.col("item_id").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return registers.grams(d, kind, "lang", order="doc_id"), registers.grams(b, kind, "lang", order="doc_id").select("gram", "n")


@query(f"{register_sql('word')} SELECT lang, round(coalesce(sum(n::DOUBLE * m) / sqrt(sum(n::DOUBLE * n) * (SELECT sum(m::DOUBLE * m) FROM q)), 0), 6) AS cosine FROM p LEFT JOIN q USING (gram) GROUP BY lang")
def register_cosine(spark, sf_dir):
    return registers.cosine(*_registers(spark, sf_dir, "word"), "lang").select("lang", F.round("cosine", 6).alias("cosine"))


@query(f"{register_sql('char4')} SELECT lang, round(coalesce(sum(n::DOUBLE * m) / sqrt(sum(n::DOUBLE * n) * (SELECT sum(m::DOUBLE * m) FROM q)), 0), 6) AS cosine FROM p LEFT JOIN q USING (gram) GROUP BY lang")
def register_cosine_char4(spark, sf_dir):
    return registers.cosine(*_registers(spark, sf_dir, "char4"), "lang").select("lang", F.round("cosine", 6).alias("cosine"))


@query(f"""{register_sql('bigram')}, t AS (SELECT lang, sum(n) AS pt, count(*) AS k FROM p GROUP BY lang), qt AS (SELECT sum(m) AS qt FROM q)
SELECT lang, round(sum(n::DOUBLE / pt * ln((n::DOUBLE / pt) / coalesce(m::DOUBLE / qt, 1.0 / (qt + k)))), 6) AS kl FROM p JOIN t USING (lang) LEFT JOIN q USING (gram), qt GROUP BY lang""")
def register_kl(spark, sf_dir):
    return registers.divergence(*_registers(spark, sf_dir, "bigram"), "lang").select("lang", F.round("kl", 6).alias("kl"))


@query("""WITH f AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) GROUP BY word),
p AS (SELECT doc_id, text, unnest(ps) AS p, unnest(ss) AS s, unnest(range(0, len(ps))) AS k FROM (SELECT doc_id, text, regexp_extract_all(text, '(?s)(.*?)(\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)?)') AS ps, regexp_extract_all(text, '(?s)(.*?)(\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)?)', 2) AS ss FROM documents)),
a AS (SELECT doc_id, text, s, k, (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) - length(s))::BIGINT AS start FROM p),
w AS (SELECT a.doc_id, a.k, min(coalesce(n, 0)) AS min_freq, count(*) AS n_words FROM (SELECT doc_id, k, unnest(regexp_extract_all(lower(s), '\\p{L}+')) AS word FROM a) a LEFT JOIN f USING (word) GROUP BY ALL)
SELECT doc_id, k::INT AS k, s AS span, start, min_freq, n_words FROM a JOIN w USING (doc_id, k) WHERE min_freq BETWEEN 0 AND 3 AND start > 0
AND NOT regexp_matches(text[greatest(start - 1, 1):start], '(\\. |\\.\\n|\\n|\\? |! )$') AND length(regexp_replace(text[greatest(start - 239, 1):start], '\\s', '', 'g')) >= 80""")
def rare_spans(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text")
    return registers.spans_in_band(d, registers.word_frequency(d), 0, 3)


@query("""WITH l AS (SELECT quality, octet_length(encode(text)) AS bytes, length(text) AS chars, len(regexp_extract_all(text, '\\p{L}+')) AS words FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)
SELECT quality, count(*) AS n, round((sum(words)::DOUBLE - sum(bytes - chars)) / sum(chars), 9) AS diff, true AS inside FROM l GROUP BY quality""")
def bootstrap_interval(spark, sf_dir):
    """Words against further bytes a character, of good and bad documents, each with a resampled interval that the difference lies in."""
    d = documents(spark, sf_dir, "doc_id", "text").where("text is not null").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    chars = F.length("text")
    rows = d.select("doc_id", "quality", F.size(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("words"), (F.octet_length("text") - chars).alias("more"), chars.alias("chars"))
    out = registers.bootstrap(rows, "words", "more", "chars", "doc_id", by=("quality",))
    return out.select("quality", "n", F.round("diff", 9).alias("diff"), F.col("diff").between(F.col("low"), F.col("high")).alias("inside"))


# --- conversations ---


@query("SELECT prev, role, count(*) AS n FROM (SELECT role, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev FROM conversations) GROUP BY ALL")
def turn_prev_role_pairs(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("role", F.coalesce(F.lag("role").over(w), F.lit("")).alias("prev")).groupBy("prev", "role").agg(F.count("*").alias("n"))


# --- swaps and searches ---

@query("""WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS i, count(*) OVER () AS n FROM benchmark) SELECT a.item_id, md5(a.text) AS own, md5(c.text) AS other FROM b a JOIN b c ON c.i = a.i % a.n + 1""")
def stem_swap(spark, sf_dir):
    s = registers.swapped(table(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id", "text")
    return s.select("item_id", F.md5("text").alias("own"), F.md5("text_swapped").alias("other"))


_CANDIDATES = ((), BLOCKED, ((" ", "t"),))


def candidates_sql(steps: int) -> str:
    """Each candidate's merges on documents of even ids; tokens, dead tokens and dictionary words on those of odd ids, by source."""
    out = [
        f"tr AS MATERIALIZED (SELECT chunk, count(*) AS n FROM ({chunk_sql(source='(SELECT * FROM documents WHERE doc_id % 2 = 0)')}) GROUP BY chunk)",
        f"he AS MATERIALIZED (SELECT source, chunk, count(*) AS n FROM ({chunk_sql(columns='source, ', source='(SELECT * FROM documents WHERE doc_id % 2 = 1)')}) GROUP BY ALL)",
        "d AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM benchmark)",
    ]
    stems = " OR ".join(f"(ends_with(w, '{s}') AND length(w) > {len(s) + 1} AND w[:-{len(s) + 1}] IN (SELECT w FROM d))" for s in ("s", "es", "ed", "ing", "d"))
    rows = []
    for c, pairs in enumerate(_CANDIDATES):
        barred = " AND ".join(f"NOT (t[i] = '{a.encode().hex().upper()}' AND t[i + 1] = '{b.encode().hex().upper()}')" for a, b in pairs) or "true"
        out.append(f"c{c}w0 AS MATERIALIZED (SELECT regexp_replace(hex(chunk), '(..)', '<\\1>', 'g') AS w, n FROM tr), c{c}h0 AS (SELECT source, regexp_replace(hex(chunk), '(..)', '<\\1>', 'g') AS w, n FROM he), c{c}v0 AS (SELECT printf('%02X', i) AS name, printf('%02X', i) AS hex FROM range(256) t(i))")
        for k in range(steps):
            out.append(f"c{c}p{k} AS MATERIALIZED (SELECT t[i] AS a, t[i + 1] AS b, sum(n)::BIGINT AS c FROM (SELECT t, n, unnest(range(1, len(t))) AS i FROM (SELECT string_split(trim(w, '<>'), '><') AS t, n FROM c{c}w{k})) WHERE {barred} GROUP BY 1, 2 ORDER BY c DESC, a, b LIMIT 1)")
            for x, own in (("w", "w, n"), ("h", "source, w, n")):
                out.append(f"c{c}{x}{k + 1} AS MATERIALIZED (SELECT {own.replace('w,', f"replace(w, '<' || a || '><' || b || '>', '<T{k:05d}>') AS w,")} FROM c{c}{x}{k}, c{c}p{k})")
            out.append(f"c{c}v{k + 1} AS MATERIALIZED (SELECT * FROM c{c}v{k} UNION ALL SELECT 'T{k:05d}', x.hex || y.hex FROM c{c}p{k} JOIN c{c}v{k} x ON x.name = a JOIN c{c}v{k} y ON y.name = b)")
        out.append(f"c{c}s AS (SELECT lower(s[2:]) AS w FROM (SELECT try(decode(unhex(hex))) AS s FROM c{c}v{steps}) WHERE starts_with(s, ' ')), c{c}k AS (SELECT w IN (SELECT w FROM d) AS base, {stems} OR (ends_with(w, 'ies') AND length(w) > 4 AND w[:-4] || 'y' IN (SELECT w FROM d)) AS infl FROM c{c}s)")
        out.append(f"c{c}t AS (SELECT source, sum(n)::BIGINT AS tokens, {256 + steps} - count(DISTINCT t) AS dead FROM (SELECT source, n, unnest(string_split(trim(w, '<>'), '><')) AS t FROM c{c}h{steps}) GROUP BY source)")
        rows.append(f"SELECT {c} AS cand, (SELECT count(*) FILTER (base) FROM c{c}k)::INT AS base, (SELECT count(*) FILTER (infl AND NOT base) FROM c{c}k)::INT AS infl, (SELECT sum(tokens) FROM c{c}t)::BIGINT AS tokens, (SELECT sum(dead) FROM c{c}t)::BIGINT AS dead, NULL::VARCHAR AS error")
    return f"WITH {', '.join(out)} {' UNION ALL '.join(rows)}"


@query(candidates_sql(10))
def evaluate_many_small(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "source", "text")
    words = [r.word for r in corpus.words_of(table(spark, sf_dir, "benchmark").select("text")).collect()]
    held = chunks.counted(d.where("doc_id % 2 = 1"), by=("source",)).withColumnRenamed("source", "shard")
    out = evaluation.evaluate_candidates(spark, chunks.counted(d.where("doc_id % 2 = 0")), held, words, [(k, bpe.Rules.of(p)) for k, p in enumerate(_CANDIDATES)], bpe.BYTES + 10)
    total = lambda c: F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("cand", "base", "infl", total("tokens").alias("tokens"), total("dead").alias("dead"), "error")
