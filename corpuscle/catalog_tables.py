"""Further queries of the library: vocabulary and text operators over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuscle.catalog import _POOL, MERGES, chunk_sql, documents, fires_sql, query, staged_sql, table, trained, vocab_sql
from corpuscle.cluster import checkpointed
from corpuscle.functions import text as T
from corpuscle.functions.patterns import PREFIXES, SUFFIXES
from corpuscle.operators import bpe, chunks, metrics, morphology, registers
from corpuscle.plans import reports
from corpuscle.sources import corpus, vocabularies


# --- vocabularies ---

_VOCAB_TEXT = "toks AS (SELECT id, hex, try(decode(unhex(hex))) AS s FROM vocab)"


def prefix_reasons_sql(steps: int = 32) -> str:
    affixes = ", ".join(f"'{a}'" for a in PREFIXES)
    return f"""WITH {fires_sql(steps)}, {vocab_sql(steps)}, {_VOCAB_TEXT}, known AS (SELECT id, s FROM toks WHERE s IS NOT NULL), f AS (SELECT s, last::DOUBLE / fires AS p FROM known JOIN fires USING (id)),
a AS (SELECT s, p, (SELECT max_by(x, length(x)) FROM (SELECT unnest([{affixes}]) AS x) WHERE length(f.s) > length(x) AND starts_with(f.s, x)) AS affix FROM f), r AS (SELECT s, p, affix, s[length(affix) + 1:] AS rest FROM a),
k AS (SELECT t.s, coalesce(f.p, 0) AS p FROM known t LEFT JOIN f USING (s))
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN r.s IN ({affixes}) THEN 'is_affix' WHEN affix IS NULL THEN 'no_affix' WHEN r.p >= 0.05 THEN 'is_word' WHEN rk.s IS NULL THEN 'rest_not_token' WHEN rk.p >= 0.05 THEN 'rest_free'
 WHEN sib.s IS NOT NULL AND length(rest) >= 1 THEN 'rest_has_sibling' ELSE 'MANGLED' END AS reason FROM r LEFT JOIN k rk ON rk.s = r.rest LEFT JOIN k sib ON sib.s = ' ' || r.rest) GROUP BY reason"""


@query(prefix_reasons_sql())
def mangled_prefix_reasons(spark, sf_dir):
    _, e, v = trained(spark, sf_dir, merges=32)
    return morphology.tally(morphology.verdicts(morphology.strings(v), metrics.fire_counts(e), suffix=False))


@query(f"WITH {staged_sql()}, {vocab_sql()} SELECT id::INT AS id, (length(hex) // 2)::INT AS byte_len, hex FROM vocab ORDER BY byte_len DESC, id LIMIT 15")
def longest_tokens(spark, sf_dir):
    return metrics.longest(trained(spark, sf_dir)[2])


@query(f"WITH {fires_sql()}, {vocab_sql()} SELECT id::INT AS rank, coalesce(fires, 0)::BIGINT AS count, (length(hex) // 2)::INT AS byte_len, hex FROM vocab LEFT JOIN fires USING (id)")
def vocabulary_dump(spark, sf_dir):
    own, e, _ = trained(spark, sf_dir)
    return reports.vocabulary_dump(own, e, by="count")


@query(f"WITH {fires_sql(by='source')}, t AS (SELECT source, sum(fires) AS tokens, {256 + MERGES} - count(*) AS dead FROM fires GROUP BY source) SELECT count(*) AS shards, round(avg(tokens), 6) AS mean_tokens, round(avg(dead), 6) AS mean_dead FROM t")
def shard_means(spark, sf_dir):
    """Tokens and dead tokens of each source, then their unweighted means."""
    _, e, v = trained(spark, sf_dir, by=("source",))
    fires = metrics.fire_counts(e, ("source",))
    size = v.agg(F.count("*").alias("size"))  # one row
    per = fires.groupBy("source").agg(F.sum("fires").alias("tokens"), F.count("*").alias("alive")).join(F.broadcast(size), F.lit(True)).withColumn("dead", F.col("size") - F.col("alive"))
    means = metrics.shard_means(per, ("tokens", "dead")).join(per.agg(F.count("*").alias("shards")), F.lit(True))
    return means.select("shards", *[F.round(c, 6).alias(c) for c in ("mean_tokens", "mean_dead")])


@query(f"WITH {staged_sql(by='source')} SELECT source AS shard, sum(len(string_split(trim(w, '<>'), '><')) * n)::BIGINT AS tokens FROM w{MERGES} GROUP BY source")
def shard_star_tokens(spark, sf_dir):
    """Distinct chunks are encoded once and joined back to each shard's counts."""
    d = documents(spark, sf_dir, "source", "text")
    made = bpe.collected(trained(spark, sf_dir)[0])
    unique, counts = chunks.shard_star(d)
    size = bpe.encoded(unique, made).select("cid", F.size("ids").alias("k"))
    return counts.join(size, "cid").groupBy("shard").agg(F.sum(F.col("n") * F.col("k")).alias("tokens"))


@query(f"WITH {staged_sql()}, {vocab_sql()}, own AS (SELECT id FROM vocab WHERE id NOT IN (97, 256, 260)) SELECT i::INT AS id FROM range((SELECT max(id) + 1 FROM own)) t(i) WHERE i NOT IN (SELECT id FROM own)")
def missing_ids(spark, sf_dir):
    """Holes of a vocabulary from which three tokens were taken."""
    return bpe.missing_ids(trained(spark, sf_dir)[2].where(~F.col("id").isin(97, 256, 260)))


@query(f"WITH {staged_sql()}, {vocab_sql()} SELECT 300::BIGINT AS n_ids, 300 - count(*) AS n_gaps FROM vocab WHERE id < 300 AND id NOT IN (97, 260)")
def vocab_gaps(spark, sf_dir):
    return morphology.gaps(trained(spark, sf_dir)[2].where(~F.col("id").isin(97, 260)), 300)


@query(f"WITH {staged_sql()}, {vocab_sql()} SELECT count(DISTINCT id) AS n_ids, max(id)::INT AS max_id, count(*) - count(DISTINCT hex) AS n_same_bytes, max(id) + 1 - count(DISTINCT id) AS n_holes FROM vocab WHERE id <> 260")
def vocab_density(spark, sf_dir):
    return bpe.density(trained(spark, sf_dir)[2].where("id <> 260"))


@query(f"""WITH {staged_sql(32)}, {vocab_sql(32)}, cut AS (SELECT id, hex, unnest(range(1, length(hex) // 2)) AS k FROM vocab WHERE length(hex) > 2), made AS (SELECT x.hex AS l, y.hex AS r FROM ({" UNION ALL ".join(f"SELECT a, b FROM p{k}" for k in range(8))}) JOIN v32 x ON x.name = a JOIN v32 y ON y.name = b)
SELECT c.id, left(c.hex, 2 * k) AS l, substr(c.hex, 2 * k + 1) AS r FROM cut c JOIN vocab x ON x.hex = left(c.hex, 2 * k) JOIN vocab y ON y.hex = substr(c.hex, 2 * k + 1) WHERE x.id < c.id AND y.id < c.id AND NOT EXISTS (SELECT 1 FROM made WHERE made.l = x.hex AND made.r = y.hex)""")
def formation_routes_left(spark, sf_dir):
    """Routes without the pairs that the first eight merges made, as if these were blocked."""
    own, _, v = trained(spark, sf_dir, merges=32)
    raw = lambda k: F.broadcast(v.select(F.col("id").alias(f"{k}_id"), F.col("bytes").alias(k)))
    made = own.where("id < 264").select(F.col("left").alias("l_id"), F.col("right").alias("r_id")).join(raw("l"), "l_id").join(raw("r"), "r_id")
    return morphology.routes(v, v, exclude=made).select("id", F.hex("l").alias("l"), F.hex("r").alias("r"))


_CONTENT = "CASE WHEN regexp_full_match(u, '\\p{Lu}\\p{Ll}*') AND upper(lower(u[1])) = u[1] AND length(lower(u[1])) = 1 AND strlen(lower(u[1])) = strlen(u[1]) THEN lower(u[1]) || u[2:] ELSE u END"


@query(f"""WITH {staged_sql(32)}, {vocab_sql(32)}, {_VOCAB_TEXT}, c AS (SELECT id, CASE WHEN s IS NULL THEN 'raw ' || id ELSE (SELECT string_agg({_CONTENT}, '' ORDER BY k) FROM (SELECT unnest(us) AS u, unnest(range(len(us))) AS k FROM (SELECT regexp_extract_all(regexp_replace(s, '^ ', ''), '\\p{{L}}+|[^\\p{{L}}]+') AS us))) END AS content FROM toks)
SELECT coalesce(content, '') AS content, count(*) AS tokens, min(id)::INT AS first FROM c GROUP BY 1""")
def content_forms(spark, sf_dir):
    v = trained(spark, sf_dir, merges=32)[2]
    form = F.regexp_replace(T.content_form(F.col("bytes"), F.col("id")), "^\x00RAW", "raw ")
    return v.select("id", form.alias("content")).groupBy("content").agg(F.count("*").alias("tokens"), F.min("id").alias("first"))


@query(f"WITH c AS (SELECT chunk, count(*) AS n FROM ({chunk_sql()}) GROUP BY chunk), t AS (SELECT chunk, n, CASE WHEN starts_with(chunk, ' ') THEN ' ' ELSE '' END || lower(regexp_replace(chunk, '^ ', '')[1]) || regexp_replace(chunk, '^ ', '')[2:] AS twin FROM c) SELECT count(*) AS pairs, sum(t.n)::BIGINT AS n, sum(c.n)::BIGINT AS n_twin FROM t JOIN c ON c.chunk = twin WHERE twin <> t.chunk")
def lower_twins(spark, sf_dir):
    c = chunks.counted(documents(spark, sf_dir, "text"))
    t = c.select("chunk", "n", T.lower_twin(F.col("chunk")).alias("twin")).where("twin <> chunk")
    return t.join(c.select(F.col("chunk").alias("twin"), F.col("n").alias("m")), "twin").agg(F.count("*").alias("pairs"), F.sum("n").alias("n"), F.sum("m").alias("n_twin"))


@query(f"SELECT count(*) AS n_distinct, count(*) FILTER (regexp_full_match(chunk, '[ \\p{{L}}]+')) AS n_phrases, coalesce(sum(n) FILTER (regexp_full_match(chunk, '[ \\p{{L}}]+')), 0)::BIGINT AS n FROM (SELECT chunk, count(*) AS n FROM ({chunk_sql()}) GROUP BY chunk)")
def word_phrases(spark, sf_dir):
    c = chunks.counted(documents(spark, sf_dir, "text"))
    is_phrase = T.is_word_phrase(F.col("chunk"))
    return c.agg(F.count("*").alias("n_distinct"), F.count_if(is_phrase).alias("n_phrases"), F.sum(F.when(is_phrase, F.col("n")).otherwise(0)).alias("n"))


@query(f"""WITH {fires_sql(32, by='lang')}, {vocab_sql(32)}, {_VOCAB_TEXT}, a AS (SELECT unnest([{', '.join(repr(x) for x in dict.fromkeys(SUFFIXES))}]) AS atom), j AS (SELECT atom, lang, sum(fires) AS fires FROM a JOIN toks ON s = atom JOIN fires USING (id) GROUP BY ALL)
SELECT t.atom, l.lang AS tokenizer, coalesce(j.fires, 0)::BIGINT AS fires FROM (SELECT DISTINCT atom FROM j) t CROSS JOIN (SELECT DISTINCT lang FROM documents) l LEFT JOIN j ON j.atom = t.atom AND j.lang = l.lang""")
def morpheme_atoms(spark, sf_dir):
    """Tokens of the vocabulary that are affixes: how often they fire in each language."""
    _, e, v = trained(spark, sf_dir, by=("lang",), merges=32)
    fires = checkpointed(metrics.fire_counts(e, ("lang",)).join(morphology.strings(v), "id").select("lang", "s", "fires"))
    names = [r.lang for r in documents(spark, sf_dir, "lang").distinct().collect()]  # languages
    return morphology.atom_firings({x: fires.where(F.col("lang") == x).select("s", "fires") for x in names})


@query("""WITH t AS (SELECT quality, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM documents JOIN labels USING (doc_id)), a AS (SELECT w, count(*) AS n FROM t WHERE quality = 1 GROUP BY w)
SELECT round(sum(CASE WHEN w NOT IN (SELECT w FROM t WHERE quality = 0) THEN n * strlen(w) ELSE 0 END)::DOUBLE / sum(n * strlen(w)), 9) AS new_share FROM a""")
def new_atom_share(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    words = d.select("quality", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("content"))
    own = words.where("quality = 1").groupBy("content").agg(F.count("*").alias("n")).withColumn("byte_len", F.octet_length("content"))
    return metrics.new_atom_share(own, words.where("quality = 0")).select(F.round("new_share", 9).alias("new_share"))


@query(f"{_POOL} SELECT count(*) AS families, round(median(total::DOUBLE / top), 9) AS median_gain, round(median(top::DOUBLE / total), 9) AS median_top_share, round(sum(top)::DOUBLE / sum(total), 9) AS top_share FROM p WHERE variants >= 2")
def pooling_summary(spark, sf_dir):
    from corpuscle.catalog import _pool

    r = lambda c: F.round(c, 9).alias(c)
    return metrics.pooling_summary(_pool(spark, sf_dir)).select("families", r("median_gain"), r("median_top_share"), r("top_share"))


@query("""WITH f AS (SELECT word AS w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS v FROM f)
SELECT w AS word, round(-log2((n + 1)::DOUBLE / (total + v)), 9) AS bits FROM f, t""")
def unigram_bits(spark, sf_dir):
    f = registers.word_frequency(documents(spark, sf_dir, "text"))
    t = f.agg(F.sum("n").alias("total"), F.count("*").alias("v"))  # one row
    return f.join(F.broadcast(t), F.lit(True)).select("word", F.round(T.unigram_bits(F.col("n"), F.col("total"), F.col("v")), 9).alias("bits"))


@query("""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS w FROM benchmark), f AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) GROUP BY word)
SELECT w AS word, n FROM d JOIN f ON w = word WHERE length(w) > 3 ORDER BY n DESC, w LIMIT 20""")
def lost_words(spark, sf_dir):
    """Dictionary words that a vocabulary of short words lacks, by how often they occur."""
    d, words = documents(spark, sf_dir, "text"), corpus.words_of(table(spark, sf_dir, "benchmark").select("text"))
    base = words.select(F.concat(F.lit(" "), "word").alias("s"))
    counts = registers.word_frequency(d)
    return morphology.lost_words(base, base.where("length(s) <= 4"), words, counts, 20).where("n > 0")


@query(f"""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM benchmark), f AS (SELECT chunk AS s, count(*) AS fires FROM ({chunk_sql()}) WHERE regexp_full_match(chunk, ' ?[A-Za-z]+') GROUP BY chunk),
o AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) GROUP BY word), t AS (SELECT s, fires, regexp_replace(s, '^ ', '') AS word FROM f), l AS (SELECT *, lower(word) AS w FROM t),
st AS (SELECT *, w IN (SELECT word FROM d) AS dict, (ends_with(w, 's') AND length(w) > 2 AND w[:-2] IN (SELECT word FROM d)) OR (ends_with(w, 'es') AND length(w) > 3 AND w[:-3] IN (SELECT word FROM d)) OR (ends_with(w, 'ed') AND length(w) > 3 AND w[:-3] IN (SELECT word FROM d))
 OR (ends_with(w, 'ing') AND length(w) > 4 AND w[:-4] IN (SELECT word FROM d)) OR (ends_with(w, 'd') AND length(w) > 2 AND w[:-2] IN (SELECT word FROM d)) OR (ends_with(w, 'ies') AND length(w) > 4 AND w[:-4] || 'y' IN (SELECT word FROM d)) AS infl FROM l)
SELECT CASE WHEN dict THEN 'DICT' WHEN infl THEN 'INFL' ELSE '-' END AS status, CASE WHEN fires > 0 AND coalesce(n, 0) = 0 THEN 'ART?' ELSE '' END || CASE WHEN length(s) = 3 THEN 'AMBIENT' ELSE '' END AS flags, count(*) AS n, sum(fires)::BIGINT AS fires FROM st LEFT JOIN o USING (word) GROUP BY ALL""")
def word_realness(spark, sf_dir):
    d, words = documents(spark, sf_dir, "text"), corpus.words_of(table(spark, sf_dir, "benchmark").select("text"))
    surfaces = chunks.counted(d).where(F.col("chunk").rlike("^ ?[A-Za-z]+$")).select(F.col("chunk").alias("s"), F.col("n").alias("fires"))
    counts = morphology.standalone(d, surfaces.select(T.without_space(F.col("s")).alias("word")))
    notes = morphology.annotated(surfaces, words, counts, surfaces.where("length(s) = 3").select("s"))
    return notes.groupBy("status", F.array_join("flags", "").alias("flags")).agg(F.count("*").alias("n"), F.sum("fires").alias("fires"))


# --- texts ---

_RUNS = r"regexp_extract_all(text, '\p{L}+|[^\p{L}]+')"


@query(f"SELECT doc_id, md5(array_to_string(list_transform({_RUNS}, lambda r: CASE WHEN regexp_matches(r, '^\\p{{L}}') THEN upper(replace(r, 'ß', 'SS')) ELSE r END), '')) AS md5 FROM documents")
def all_caps_noise(spark, sf_dir):
    """Noise with a share of 1, which no seed changes."""
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(T.all_caps(F.col("text"), F.col("doc_id"), 1.0)).alias("md5"))


@query(f"SELECT doc_id, md5(array_to_string(list_transform({_RUNS}, lambda r: CASE WHEN regexp_matches(r, '^\\p{{L}}') THEN CASE WHEN r[1] = 'ß' THEN 'SS' WHEN r[1] = upper(r[1]) THEN lower(r[1]) ELSE upper(r[1]) END || r[2:] ELSE r END), '')) AS md5 FROM documents")
def flipped_case_noise(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(T.flipped_titlecase(F.col("text"), F.col("doc_id"), 1.0)).alias("md5"))


@query("SELECT doc_id, md5(replace(text, ' ', '  ')) AS md5 FROM documents")
def double_space_noise(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(T.double_spaces(F.col("text"), F.col("doc_id"), 1.0)).alias("md5"))


@query("SELECT doc_id, text[greatest(length(text) // 2 + 1 - 28, 1):length(text) // 2 + 5 + 28] AS snippet FROM documents")
def snippets(spark, sf_dir):
    """What stands about the middle of each document."""
    middle = (F.floor(F.length("text") / 2) + 1).cast("int")
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", T.snippet(F.col("text"), middle, F.lit(5)).alias("snippet"))


@query("""WITH a AS (SELECT item_id, string_split(text, '') AS x FROM benchmark), p AS (SELECT a.item_id, a.x, b.x AS y, least(len(a.x), len(b.x)) AS n FROM a JOIN a b ON b.item_id = a.item_id + 1)
SELECT item_id, coalesce(list_position(list_transform(range(1, n + 1), lambda i: x[i] = y[i]), false) - 1, n)::INT AS prefix, coalesce(list_position(list_transform(range(1, n + 1), lambda i: x[len(x) + 1 - i] = y[len(y) + 1 - i]), false) - 1, n)::INT AS suffix FROM p""")
def common_lengths(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", "").alias("x"))
    j = a.join(a.select((F.col("item_id") - 1).alias("item_id"), F.col("x").alias("y")), "item_id")
    return j.select("item_id", T.common_prefix(F.col("x"), F.col("y")).alias("prefix"), T.common_suffix(F.col("x"), F.col("y")).alias("suffix"))


@query("""WITH s AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS k FROM documents), b AS (SELECT (doc_id // 100)::BIGINT AS batch, sum(length(text)) AS n FROM documents GROUP BY 1), r AS (SELECT batch, coalesce(sum(n) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT doc_id FROM documents WHERE (doc_id // 100) IN (SELECT batch FROM r WHERE before < 300000)""")
def capped_batches(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text").withColumn("batch", F.floor(F.col("doc_id") / 100))
    return corpus.capped_batches(d, 300_000, "batch").select("doc_id")


@query("SELECT doc_id, left(text, 500) AS text FROM documents ORDER BY doc_id LIMIT 200")
def first_documents(spark, sf_dir):
    return corpus.first_documents(documents(spark, sf_dir, "doc_id", "text"), 200, 500)


@query("SELECT source, count(*) AS docs FROM (SELECT source, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM documents) WHERE coalesce(before, 0) < 1000000 // 20 GROUP BY source")
def capped_equally(spark, sf_dir):
    return corpus.capped_equally(documents(spark, sf_dir, "doc_id", "source", "text"), 1_000_000, 20, "source").groupBy("source").agg(F.count("*").alias("docs"))


@query("""WITH r AS (SELECT lang, doc_id, coalesce(text, '') AS t, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT lang, md5(left(string_agg(t, '' ORDER BY doc_id), 100000)) AS md5 FROM r WHERE before < 100000 GROUP BY lang""")
def joined_shards(spark, sf_dir):
    return vocabularies.ranked_texts(documents(spark, sf_dir, "doc_id", "lang", "text"), "lang", 100_000).select("lang", F.md5("text").alias("md5"))


@query("""WITH f AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM documents) GROUP BY word),
p AS (SELECT doc_id, unnest(ps) AS p, unnest(ss) AS s, unnest(range(0, len(ps))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '(?s)(.*?)(\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)?)') AS ps, regexp_extract_all(text, '(?s)(.*?)(\\p{Lu}\\p{Ll}+(?: \\p{Lu}\\p{Ll}+)?)', 2) AS ss FROM documents)),
a AS (SELECT doc_id, s, k, (sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k) - length(s))::BIGINT AS start FROM p), w AS (SELECT a.doc_id, a.k, min(coalesce(n, 0)) AS min_freq, count(*) AS n_words FROM (SELECT doc_id, k, unnest(regexp_extract_all(lower(s), '\\p{L}+')) AS word FROM a) a LEFT JOIN f USING (word) GROUP BY ALL),
j AS (SELECT a.doc_id, k::INT AS k, s AS span, min_freq, n_words FROM a JOIN w USING (doc_id, k) JOIN documents d ON d.doc_id = a.doc_id WHERE length(regexp_replace(text[greatest(start - 239, 1):start], '\\s', '', 'g')) >= 80 AND start > 0)
SELECT * FROM j ORDER BY min_freq, n_words DESC, doc_id, k LIMIT 25""")
def rarest_spans(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text")
    spans = registers.spans_in_band(d, registers.word_frequency(d), 0, 1 << 40, drop_sentence_start=False)
    return registers.rarest_first(spans, 25).select("doc_id", "k", "span", "min_freq", "n_words")


# --- vocabularies of more merges, codecs, samples ---


@query(f"""WITH {fires_sql(32)}, {vocab_sql(32)}, t AS (SELECT sum(len(string_split(trim(w, '<>'), '><')) * n)::BIGINT AS tokens, sum(length(chunk) * n)::BIGINT AS chars FROM w32) SELECT 'own' AS name, chars, tokens, round(chars / tokens, 9) AS chars_per_token, (SELECT count(*) FROM vocab) AS n_tokens, (SELECT count(*) FROM vocab WHERE id NOT IN (SELECT id FROM fires)) AS n_dead, (SELECT round(sum(id * fires)::DOUBLE / sum(fires), 9) FROM fires) AS wmean_id FROM t""")
def pass_metrics(spark, sf_dir):
    own = trained(spark, sf_dir, merges=32)[0]
    out = reports.pass_metrics(documents(spark, sf_dir, "text"), {"own": own})
    return out.select("name", "chars", "tokens", F.round("chars_per_token", 9).alias("chars_per_token"), "n_tokens", "n_dead", F.round("wmean_id", 9).alias("wmean_id"))


@query()
def vocabulary_32k(spark, sf_dir):
    """A vocabulary of 32,768 tokens learned from all documents, by length."""
    own = bpe.train(chunks.counted(documents(spark, sf_dir, "text")), 32_768)
    return own.groupBy(F.octet_length("bytes").alias("byte_len")).agg(F.count("*").alias("tokens"), F.min("id").alias("first"))


@query("SELECT codec, count(*) AS docs, count(*) AS same, sum(len(regexp_extract_all(text, ' [^\\s\\x0B]')))::BIGINT AS spaces FROM documents, (VALUES ('slots'), ('one'), ('offsets')) t(codec) GROUP BY codec")
def codec_round_trips(spark, sf_dir):
    """The three codecs of spaces and capitals, each over all documents."""
    from corpuscle.operators import surface

    d = documents(spark, sf_dir, "doc_id", "text")
    made = tuple(bpe.collected(bpe.train(surface.folded_counts(d), bpe.BYTES + 64)))
    return surface.round_trip_totals(d, {"slots": surface.SurfaceCodec(made, 4), "one": surface.OneCapCodec(made), "offsets": surface.OffsetCodec(made)})


@query()
def few_shots(spark, sf_dir):
    return registers.few_shot(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 5)
