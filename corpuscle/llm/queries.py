"""Queries opN_<name>: each applies one operator to its whole table and derives the result columns from the operator's output."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.cluster import shared_dir, ship_code
from corpuscle.llm import alignment, ann, chat, divergence, fst, html, licenses, linededup, neardup, packing, quality, store, toxicity
from corpuscle.llm.encoding import default_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
ORACLE_SQL["op9_quality_rules"] = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), tri AS (
  SELECT rid, i, concat_ws(' ', words[i], words[i + 1], words[i + 2]) AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri), (SELECT unnest(range(0, 3)) AS k)
  WHERE c > 1 GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({_STOP_SQL}))) AS n_stop
  FROM w LEFT JOIN rep USING (rid)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS d, greatest(n_lines, 1) AS l FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / d BETWEEN 2 AND 12 AND n_symbols / d <= 0.1 AND n_stop / d >= 0.02
       AND n_dup_lines / l <= 0.5 AND n_words / l >= 1 AS kept
FROM v
"""


@_query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    out = toxicity.scored(docs, model).withColumn("held_out", toxicity.held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "group_id", "group_size", "kept")


@_query
def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, k, r, "</s>[INST] ok [/INST]") for k, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.segments(turns.unionByName(extra)))


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    kept = linededup.deduplicated(docs.withColumn("n_lines", lines))
    left = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return kept.select("doc_id", "n_lines", left.alias("n_kept_lines"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@_query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return fst.digests(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}"
    store.write_store(table(spark, sf_dir, "documents"), out, default_path("byte_bpe_50k.json"))
    return store.verified_digests(spark, out)


@_query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))


@_query
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


_CONTROL_SQL = r"<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|</s>|<s>"
ORACLE_SQL["op1_chat_formatting"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER w AS k, lag(coalesce(role, '')) OVER w AS prev
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), e AS (
  SELECT *, length(text) + 2 * len(regexp_extract_all(text, '{_CONTROL_SQL}')) + length(text) - length(replace(text, '␛', '')) AS text_chars,
         length(role) + 2 * len(regexp_extract_all(role, '{_CONTROL_SQL}')) + 2 * length(role) - length(replace(role, '␛', '')) - length(replace(role, chr(10), '')) AS role_chars,
         (prev IS NULL AND role IN ('system', 'user')) OR (prev = 'system' AND role = 'user') OR (prev = 'user' AND role = 'assistant') OR (prev = 'assistant' AND role = 'user') AS ok
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + role_chars + 1 + text_chars + 11)::BIGINT AS formatted_chars,
       bool_and(ok IS TRUE) AND max_by(role, k) = 'assistant' AS valid
FROM e GROUP BY conv_id
"""


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE_SQL["op11_source_divergence"] = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), o AS MATERIALIZED (
  SELECT lang, source, id, term, count(*) AS n FROM (SELECT lang, source, id, unnest(terms) AS term FROM d) GROUP BY ALL
), k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM o GROUP BY ALL HAVING count(*) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS MATERIALIZED (
  SELECT s.lang, s.source, coalesce(x.n, 0) AS total, coalesce(v.v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) s
  LEFT JOIN (SELECT o.lang, o.source, sum(o.n) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL) x USING (lang, source) LEFT JOIN v USING (lang)
), c AS (SELECT lang, source, term, sum(n) AS n FROM o GROUP BY ALL),
p AS MATERIALIZED (
  SELECT k.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v))::BIGINT AS p,
         (1 + 1000000000::HUGEINT * (k.n + 1) // (v.n + v.v))::BIGINT AS q
  FROM k JOIN g USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = k.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) f
  ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""


@_query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))


_TEMPLATE_ROWS = ", ".join(f"({k}, '{label}', '{text.replace("'", "''")}')" for k, (label, text) in enumerate(licenses.TEMPLATES))
_FOLD_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL["op13_license_scan"] = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, {_FOLD_SQL.format("coalesce(text, '')")} AS text FROM documents),
w AS MATERIALIZED (SELECT id, doc_id, {_WORDS_SQL.format("text")} AS w FROM d),
h AS (
  SELECT id, i, CASE WHEN w[i + 1] = 'mit' THEN 'mit' WHEN w[i + 1] = 'apache' THEN 'apache' ELSE 'gpl' END AS label FROM (SELECT id, w, unnest(range(0, len(w))) AS i FROM w)
  WHERE (w[i + 1] IN ('mit', 'apache') AND w[i + 2] = 'license') OR (w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license')
), base AS (SELECT id, count(*) AS n, min(i) AS a, max(i) AS b, list(DISTINCT label) AS labels FROM h GROUP BY id),
b AS (SELECT id, row_number() OVER () AS block, {_WORDS_SQL.format("block")} AS w FROM (SELECT id, unnest(regexp_split_to_array(text, '
[ 	
]*
[ 	

]*')) AS block FROM d)),
g AS (SELECT DISTINCT id, block, w[i:i + 2] AS t FROM (SELECT id, block, w, unnest(range(1, len(w) - 1)) AS i FROM b)),
x AS (SELECT k, label, {_WORDS_SQL.format(_FOLD_SQL.format("text"))} AS w FROM (VALUES {_TEMPLATE_ROWS}) t(k, label, text)),
y AS MATERIALIZED (SELECT DISTINCT k, label, w[i:i + 2] AS t FROM (SELECT k, label, w, unnest(range(1, len(w) - 1)) AS i FROM x)),
s AS (SELECT k, count(*) AS n FROM y GROUP BY k),
links AS (SELECT id, label, count(*)::DOUBLE / any_value(n) AS share FROM g JOIN y USING (t) JOIN s USING (k) GROUP BY id, block, k, label HAVING count(*)::DOUBLE / any_value(n) >= 0.8),
m AS (SELECT id, list(DISTINCT label) AS labels, max(share) AS share FROM links GROUP BY id),
n AS (SELECT id, count(*) AS n_links FROM links GROUP BY id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0) AS n_base, a AS first_word, base.b AS last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(m.labels, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(m.share, 0) END::DOUBLE AS score, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN base USING (id) LEFT JOIN m USING (id) LEFT JOIN n USING (id)
"""


@_query
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))
