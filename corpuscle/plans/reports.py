"""Composite reports: what a user of the analytics runs, put together from operators. Each gives a dict of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.cluster import Scratch, checkpointed
from corpuscle.functions import text as T
from corpuscle.functions.patterns import BASE, SPACELESS, VOCAB_SIZE
from corpuscle.operators import bpe, chunks, metrics, morphology, registers, surface
from corpuscle.sources import corpus


def trained_tokenizer(docs: DataFrame, vocab_size: int = VOCAB_SIZE, pattern: str = BASE, rules: bpe.Rules = bpe.Rules(), fold: bool = False) -> DataFrame:
    """A merge table from documents (text), with optional case folding; raises if ids have holes."""
    texts = docs.select(T.fold_case(F.col("text")).alias("text")) if fold else docs.select("text")
    merges = bpe.train(chunks.counted(texts, pattern), vocab_size, rules)
    spark = docs.sparkSession
    kept = spark.createDataFrame(bpe._frame(bpe.collected(merges)), bpe.MERGES)
    if (d := bpe.density(bpe.vocabulary(kept)).first()).n_holes:
        raise ValueError(f"{d.n_holes} ids are missing")
    return kept


def save_tokenizer(merges: DataFrame, folder: str, keep: int | None = None) -> None:
    """Writes a merge table; with keep, as the keep-th step of a search."""
    merges.write.mode("overwrite").parquet(f"{folder}/keep={keep:04d}" if keep is not None else folder)


def vocabulary_dump(merges: DataFrame, encoded: DataFrame, by: str = "rank") -> DataFrame:
    """(rank, count, byte_len, hex) by rank, or by count from the most."""
    fires = metrics.fire_counts(encoded).select("id", "fires")
    rows = bpe.vocabulary(merges).join(fires, "id", "left").select(F.col("id").alias("rank"), F.coalesce("fires", F.lit(0)).alias("count"), F.octet_length("bytes").alias("byte_len"), F.hex("bytes").alias("hex"))
    return rows.orderBy(F.desc("count"), "rank") if by == "count" else rows.orderBy("rank")


def tokenizer_report(docs: DataFrame, merges: DataFrame, pattern: str = BASE) -> dict[str, DataFrame]:
    """Vocabulary statistics, compression, coverage, dead tokens, and whether texts come back."""
    made = bpe.collected(merges)
    vocab = bpe.vocabulary(merges)
    enc = checkpointed(bpe.encoded(chunks.counted(docs.select("text"), pattern), made))
    fires = checkpointed(metrics.fire_counts(enc))  # a row for each token
    back = bpe.decoded_bytes(bpe.encoded_texts(docs.select("text"), made, pattern), made)
    trip = back.agg(F.count("*").alias("docs"), F.count_if(F.col("raw") == F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("same"))
    return {
        "lengths": metrics.length_stats(vocab), "longest": metrics.longest(vocab), "totals": metrics.totals(enc), "dead": metrics.dead(vocab, fires), "mean_id": metrics.weighted_mean_id(fires),
        "buckets": metrics.rank_buckets(fires), "curve": metrics.coverage_curve(fires), "round_trip": trip, "density": bpe.density(vocab),
    }


def pass_metrics(docs: DataFrame, vocabularies: dict[str, DataFrame], pattern: str = BASE, bound: float = 0.05) -> DataFrame:
    """(name, chars, tokens, chars_per_token, n_tokens, n_dead, wmean_id, n_mangled) of each merge table on the same documents, which are split and counted once."""
    counts = checkpointed(chunks.counted(docs.select("text"), pattern))
    out = None
    for name, merges in vocabularies.items():
        enc = checkpointed(bpe.encoded(counts, bpe.collected(merges)))
        vocab = bpe.vocabulary(merges)
        fires = checkpointed(metrics.fire_counts(enc))
        mangled = morphology.verdicts(morphology.strings(vocab), fires, bound=bound).agg(F.count_if(F.col("reason") == "MANGLED").alias("n_mangled"))
        row = metrics.totals(enc).join(metrics.dead(vocab, fires), F.lit(True)).join(metrics.weighted_mean_id(fires), F.lit(True)).join(mangled, F.lit(True))  # one row each
        row = row.select(F.lit(name).alias("name"), "chars", "tokens", (F.col("chars") / F.col("tokens")).alias("chars_per_token"), "n_tokens", "n_dead", "wmean_id", "n_mangled")
        out = row if out is None else out.union(row)
    return out


def compared_tokenizers(docs: DataFrame, a: DataFrame, b: DataFrame, pattern: str = BASE, shard: str = "source") -> dict[str, DataFrame]:
    """Tokens by shard and the shards where b has fewer, strings born and died, greatest changes of firings."""
    out = {}
    with Scratch(docs.sparkSession, "compared") as scratch:
        counts = scratch.staged(chunks.counted(docs.select(shard, "text"), pattern, (shard,)), "counts")
        unique = scratch.staged(counts.groupBy("chunk").agg(F.sum("n").alias("n")), "unique")
        for name, merges in (("a", a), ("b", b)):
            made = bpe.collected(merges)
            fires = metrics.fire_counts(bpe.encoded(unique, made)).join(bpe.vocabulary(merges), "id").groupBy(F.hex("bytes").alias("token")).agg(F.sum("fires").alias("fires"))
            per = metrics.totals(bpe.encoded(counts, made), (shard,)).select(shard, F.col("tokens").alias(f"tokens_{name}"))
            out[name] = checkpointed(per), checkpointed(fires)  # a row for each shard, and for each token
    shards = out["a"][0].join(out["b"][0], shard)
    change = metrics.compared(out["a"][1], out["b"][1])
    strings = lambda m: bpe.vocabulary(m).select(F.hex("bytes").alias("token"))
    return {"shards": shards, "wins": metrics.win_rate(shards, "tokens_b", "tokens_a"), "vocabulary": metrics.born_and_died(strings(a), strings(b)), "gainers": change.orderBy(F.desc("change"), "token").limit(15), "losers": change.orderBy("change", "token").limit(15)}


def mangled_report(docs: DataFrame, merges: DataFrame, pattern: str = BASE, all_routes: bool = True, exclude: DataFrame | None = None) -> dict[str, DataFrame]:
    """Mangled tokens by suffix and prefix, the tally of reasons, and the pairs to block for them."""
    vocab = bpe.vocabulary(merges)
    fires = metrics.fire_counts(bpe.encoded(chunks.counted(docs.select("text"), pattern), bpe.collected(merges))).persist()
    strings = morphology.strings(vocab)
    both = [morphology.verdicts(strings, fires, suffix) for suffix in (True, False)]
    bad = both[0].union(both[1]).where("reason = 'MANGLED'")
    return {"suffix": morphology.tally(both[0]), "prefix": morphology.tally(both[1]), "mangled": bad, "pairs": morphology.routes(vocab, bad, exclude, only_first=not all_routes)}


def blocked_report(base: DataFrame, variant: DataFrame, blocks: DataFrame, words: DataFrame) -> dict[str, DataFrame]:
    """Whole words won and lost by blocking, blocks by right operand, and blocks that the base wouldn't have merged. blocks: (l, r) strings."""
    token = lambda m: bpe.vocabulary(m).where(F.is_valid_utf8(F.col("bytes").cast("string"))).select(F.col("bytes").cast("string").alias("chunk"))
    hits = {n: metrics.dictionary_hits(token(m), words).where("kind <> 'none'") for n, m in (("base", base), ("variant", variant))}
    made = base.join(bpe.vocabulary(base).select(F.col("id").alias("left"), F.col("bytes").alias("lb")), "left").join(bpe.vocabulary(base).select(F.col("id").alias("right"), F.col("bytes").alias("rb")), "right")
    pairs = made.select(F.col("lb").cast("string").alias("l"), F.col("rb").cast("string").alias("r"))
    return {
        "counts": hits["base"].groupBy("kind").count().withColumnRenamed("count", "base").join(hits["variant"].groupBy("kind").count().withColumnRenamed("count", "variant"), "kind", "full_outer"),
        "lost": hits["base"].select("chunk", "kind").join(hits["variant"].select("chunk"), "chunk", "left_anti"), "won": hits["variant"].select("chunk", "kind").join(hits["base"].select("chunk"), "chunk", "left_anti"),
        "by_right": morphology.blocks_by_right(blocks), "no_op": blocks.select("l", "r").join(pairs, ["l", "r"], "left_anti"),
    }


def factoring_report(docs: DataFrame, vocab_size: int = 4096, slots: int = 4) -> dict[str, DataFrame]:
    """Plain against spaceless and case-folded vocabularies of one size: tokens, bits and bytes, and whether texts come back."""
    spark = docs.sparkSession
    plain = bpe.collected(trained_tokenizer(docs, vocab_size, BASE))
    dual = bpe.collected(trained_tokenizer(docs, vocab_size, SPACELESS, fold=True))
    codec = surface.SurfaceCodec(tuple(dual), slots)
    tokens = metrics.totals(bpe.encoded(chunks.counted(docs.select("text"), BASE), plain)).select("tokens", "chars", "bytes")
    streams = surface.decoded(surface.encoded(docs.select("doc_id", "text"), codec), codec)
    two = streams.agg(F.sum(F.size("stream")).alias("tokens"), F.sum(F.aggregate("stream", F.lit(0), lambda a, t: a + t["space"])).cast("long").alias("space_bits"), F.count_if(F.col("decoded") == F.col("text")).alias("same"), F.count("*").alias("docs"))
    return {"plain": tokens, "dual": two, "spark_bits": surface.space_bits(docs), "merges": spark.createDataFrame(bpe._frame(dual), bpe.MERGES)}


def register_report(docs: DataFrame, items: DataFrame, by: str = "lang", key: str = "item_id") -> DataFrame:
    """(by, kind, cosine, kl) of each register to the items, for words, word pairs and runs of four characters."""
    d = corpus.registers(docs, by)
    b = items.select(F.lit("").alias(by), F.col(key).alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    out = None
    for kind in ("word", "bigram", "char4"):
        p, q = registers.grams(d, kind, by, order="doc_id"), registers.grams(b, kind, by, order="doc_id").select("gram", "n")
        row = registers.overlap(p, q, by).select(by, F.lit(kind).alias("kind"), "cosine", "kl")
        out = row if out is None else out.union(row)
    return out


def mined_phrases(docs: DataFrame, merges: DataFrame, whitelist: DataFrame, top: int = 150, least: int = 200, pattern: str = BASE) -> list[tuple[str, str]]:
    """Pairs of neighbouring tokens over chunk borders, from the most frequent, without those that an earlier pair shadows."""
    names = bpe.vocabulary(merges).select("id", F.col("bytes").cast("string").alias("s"))
    rows = bpe.token_rows(docs.select("doc_id", "text"), bpe.collected(merges), pattern).join(F.broadcast(names), "id")
    found = morphology.phrase_pairs(rows, whitelist).where(F.col("n") >= least).orderBy(F.desc("n"), "l", "r").limit(top)
    return morphology.unshadowed([(r.l, r.r) for r in found.collect()])


def archive_report(spark: SparkSession, root: str, control: str, meta: DataFrame) -> DataFrame:
    """Changes of each archived run's tasks against a control run, largest first."""
    runs = corpus.run_index(spark, root)
    scores = corpus.eval_csv(spark, f"{root}/*/eval.csv").withColumn("folder", F.regexp_extract("file", r"^(.*)/[^/]+$", 1))
    named = scores.join(runs, F.regexp_replace("folder", "^file:/+", "/") == F.regexp_replace(runs["folder"], "^file:/+", "/")).select("run", "task", "accuracy", "centered")
    rest = named.where(F.col("run") != control).select("run", "task", F.col("centered").alias("c1"))
    base = named.where(F.col("run") == control).select("task", "accuracy", F.col("centered").alias("c0"))
    j = rest.join(base, "task").join(meta, "task")
    return j.select("run", "task", "n", (F.col("c1") - F.col("c0")).alias("d_centered"), F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.col("n")).alias("se")).orderBy(F.desc(F.abs("d_centered")), "run", "task")


def run_table(scores: DataFrame, boundary: DataFrame, index: DataFrame) -> DataFrame:
    """Scores (run, ...) with each run's boundary counters and folder, null where a run has none."""
    return scores.join(boundary, "run", "left").join(index, "run", "left")
