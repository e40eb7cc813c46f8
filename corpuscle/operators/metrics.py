"""Vocabulary and corpus metrics over distinct chunks with their ids: (chunk, n, ids) and vocabularies (id, bytes, is_special)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions.patterns import CURVE_POINTS, POOLING_EDGES, RANK_BUCKETS


def fire_counts(encoded: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., id, fires, first, last): occurrences of each token, and as a chunk's first and last."""
    t = encoded.select(*by, "n", F.size("ids").alias("_k"), F.posexplode("ids").alias("_p", "id"))
    at = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return t.groupBy(*by, "id").agg(F.sum("n").alias("fires"), at(F.col("_p") == 0).alias("first"), at(F.col("_p") == F.col("_k") - 1).alias("last"))


def totals(encoded: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., tokens, chars, bytes)."""
    s = lambda c: F.sum(c.cast("long") * F.col("n"))
    return encoded.groupBy(*by).agg(s(F.size("ids")).alias("tokens"), s(F.length("chunk")).alias("chars"), s(F.octet_length("chunk")).alias("bytes"))


def dead(vocab: DataFrame, fires: DataFrame) -> DataFrame:
    """One row: mergeable tokens, and those among them that never fire."""
    own = vocab.where("not is_special").join(fires.where("fires > 0").select("id").withColumn("fired", F.lit(1)), "id", "left")
    return own.agg(F.count("*").alias("n_tokens"), F.count_if(F.col("fired").isNull()).alias("n_dead"))


def weighted_mean_id(fires: DataFrame) -> DataFrame:
    return fires.agg(F.coalesce(F.sum(F.col("id").cast("long") * F.col("fires")) / F.sum("fires"), F.lit(0.0)).alias("wmean_id"))


def rank_buckets(fires: DataFrame) -> DataFrame:
    """(lo, hi, fires) of doubling buckets of ids; ids beyond the last are in none."""
    pairs = list(zip(RANK_BUCKETS, RANK_BUCKETS[1:], strict=False))
    rows = fires.sparkSession.createDataFrame(pairs, "lo int, hi int")
    k = T.bucket(F.col("id"), RANK_BUCKETS[1:])
    lo = F.element_at(F.array(*[F.lit(v) for v in RANK_BUCKETS]), k + 1)
    sums = fires.where(F.col("id") < RANK_BUCKETS[-1]).groupBy(lo.alias("lo")).agg(F.sum("fires").alias("fires"))
    return rows.join(sums, "lo", "left").select("lo", "hi", F.coalesce("fires", F.lit(0)).alias("fires"))


def coverage_curve(fires: DataFrame, points: tuple[int, ...] = CURVE_POINTS) -> DataFrame:
    """(k, share) of all firings that the k most frequent tokens have; 1 beyond the tokens seen. fires is a vocabulary's, of bounded size."""
    ranked = fires.where("fires > 0").select("fires", F.row_number().over(Window.orderBy(F.desc("fires"), "id")).alias("r"), F.sum("fires").over(Window.orderBy(F.desc("fires"), "id").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    total = ranked.agg(F.max("upto").alias("total"))
    ks = fires.sparkSession.createDataFrame([(k,) for k in points], "k int")
    at = ks.join(F.broadcast(ranked), F.col("k") == F.col("r"), "left")
    return at.crossJoin(F.broadcast(total)).select("k", F.coalesce(F.col("upto") / F.col("total"), F.lit(1.0)).alias("share"))


def length_stats(vocab: DataFrame) -> DataFrame:
    """One row: tokens, mean, upper median and greatest byte length, single bytes, tokens of digits, tokens that aren't UTF-8."""
    v = vocab.where("not is_special").select(F.octet_length("bytes").alias("n"), F.col("bytes").cast("string").alias("s"), "bytes")
    hist = v.groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # a row per length
    upper = hist.withColumn("upto", F.sum("c").over(w)).crossJoin(F.broadcast(hist.agg(F.sum("c").alias("total")))).where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("n").alias("upper_median"))
    sums = v.agg(F.count("*").alias("n_tokens"), F.avg("n").alias("mean_len"), F.max("n").alias("max_len"), F.count_if(F.col("n") == 1).alias("n_single"), F.count_if(T.is_digits(F.col("s"))).alias("n_digit"), F.count_if(~F.is_valid_utf8("s")).alias("n_partial"))
    return sums.crossJoin(F.broadcast(upper))


def length_histogram(vocab: DataFrame) -> DataFrame:
    return vocab.where("not is_special").groupBy(F.octet_length("bytes").alias("byte_len")).agg(F.count("*").alias("n"))


def longest(vocab: DataFrame, k: int = 15) -> DataFrame:
    return vocab.where("not is_special").select("id", F.octet_length("bytes").alias("byte_len"), F.hex("bytes").alias("hex")).orderBy(F.desc("byte_len"), "id").limit(k)


def conditional_entropy(rows: DataFrame, previous: str, bit: str) -> DataFrame:
    """One row: n, n1, marginal bits, and bits given the previous item: sum of n(prev) times the entropy of the bit there, over n."""
    p = rows.groupBy(previous).agg(F.count("*").alias("n"), F.sum(F.col(bit).cast("long")).alias("n1"))
    h = F.col("n") * T.binary_entropy(F.col("n1") / F.col("n"))
    s = p.agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum(h).alias("_h"))
    return s.select("n", "n1", T.binary_entropy(F.col("n1") / F.col("n")).alias("marginal"), (F.col("_h") / F.col("n")).alias("conditional"))


def families(tokens: DataFrame, token: str = "chunk", n: str = "n") -> DataFrame:
    """(core, variants, reclaimable): words that occur with and without space, in lower and title case."""
    core = T.without_space(F.col(token))
    first = F.substring(core, 1, 1)
    t = tokens.select(core.alias("c"), F.col(token).startswith(" ").alias("space"), first.rlike(r"^\p{Lu}").alias("upper"), first.rlike(r"^\p{L}").alias("letter")).where("letter")
    t = t.withColumn("cap", F.col("c").rlike(r"^\p{Lu}\p{Ll}*$")).where("not upper or cap")
    return t.groupBy(F.lower("c").alias("core")).agg(F.count_distinct("space", "cap").alias("variants")).withColumn("reclaimable", F.col("variants") - 1)


def pooled(tokens: DataFrame, content: str = "content", n: str = "n", byte_len: str = "byte_len") -> DataFrame:
    """(content, total, top, variants, mass, bucket): occurrences pooled over the variants of a content; gain is total / top."""
    p = tokens.groupBy(content).agg(F.sum(n).alias("total"), F.max(n).alias("top"), F.count("*").alias("variants"), F.sum(F.col(n) * F.col(byte_len)).alias("mass"))
    return p.withColumn("bucket", T.bucket(F.col("total") / F.col("top"), POOLING_EDGES))


def pooling_buckets(pool: DataFrame) -> DataFrame:
    return pool.groupBy("bucket").agg(F.count("*").alias("families"), F.sum("total").alias("occurrences"), F.sum("mass").alias("bytes"))


def pooling_summary(pool: DataFrame) -> DataFrame:
    """One row over contents of several variants: their number, median gain, median and weighted share of the busiest variant."""
    m = pool.where("variants >= 2")
    return m.agg(F.count("*").alias("families"), F.median(F.col("total") / F.col("top")).alias("median_gain"), F.median(F.col("top") / F.col("total")).alias("median_top_share"), (F.sum("top") / F.sum("total")).alias("top_share"))


def new_atom_share(tokens: DataFrame, baseline: DataFrame, content: str = "content", n: str = "n", byte_len: str = "byte_len") -> DataFrame:
    """One row: share of bytes in tokens whose content the baseline lacks."""
    known = tokens.join(baseline.select(content).distinct().withColumn("_known", F.lit(1)), content, "left")
    mass = F.col(n) * F.col(byte_len)
    return known.agg((F.sum(F.when(F.col("_known").isNull(), mass).otherwise(0)) / F.sum(mass)).alias("new_share"))


def dictionary_hits(tokens: DataFrame, words: DataFrame, token: str = "chunk") -> DataFrame:
    """tokens that start with a space, with kind: base (in the dictionary), infl (a stem of it is), or none."""
    spaced = tokens.where(F.col(token).startswith(" ")).withColumn("word", F.lower(F.substring(F.col(token), 2, 1 << 30)))
    tries = spaced.select("word").distinct().select("word", F.explode(F.concat(F.array(F.struct(F.col("word").alias("w"), F.lit(0).alias("k"))), F.transform(T.stems(F.col("word")), lambda s: F.struct(s.alias("w"), F.lit(1).alias("k"))))).alias("t"))
    found = tries.select("word", F.col("t.w").alias("_w"), F.col("t.k").alias("_k")).join(words.select(F.col("word").alias("_w")).distinct(), "_w").groupBy("word").agg(F.min("_k").alias("_k"))
    return spaced.join(found, "word", "left").withColumn("kind", F.when(F.col("_k") == 0, "base").when(F.col("_k") == 1, "infl").otherwise("none")).drop("_k")


def win_rate(per_shard: DataFrame, a: str, b: str) -> DataFrame:
    """One row: shards, and those where a is strictly less than b."""
    return per_shard.agg(F.count("*").alias("shards"), F.count_if(F.col(a) < F.col(b)).alias("wins"))


def shard_means(per_shard: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return per_shard.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def bits_per_byte(nll: DataFrame, bucket: str, nats: str = "nats", byte_len: str = "bytes") -> DataFrame:
    """(bucket, bits, bytes, bits_per_byte, byte_share) of a table of token losses."""
    g = nll.groupBy(bucket).agg((F.sum(nats) / F.log(F.lit(2.0))).alias("bits"), F.sum(byte_len).alias("bytes"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("bytes").alias("_all")))).select(bucket, "bits", "bytes", (F.col("bits") / F.col("bytes")).alias("bits_per_byte"), (F.col("bytes") / F.col("_all")).alias("byte_share"))


def compared(a: DataFrame, b: DataFrame, key: str = "token", n: str = "fires") -> DataFrame:
    """(key, fires_a, fires_b, change): firings of two vocabularies by string, 0 where one lacks it."""
    x, y = a.select(key, F.col(n).alias("fires_a")), b.select(key, F.col(n).alias("fires_b"))
    j = x.join(y, key, "full_outer").select(key, F.coalesce("fires_a", F.lit(0)).alias("fires_a"), F.coalesce("fires_b", F.lit(0)).alias("fires_b"))
    return j.withColumn("change", F.col("fires_b") - F.col("fires_a"))


def born_and_died(a: DataFrame, b: DataFrame, key: str = "token") -> DataFrame:
    """(key, kind): strings only b has (born), or only a (died)."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return y.join(x, key, "left_anti").select(key, F.lit("born").alias("kind")).union(x.join(y, key, "left_anti").select(key, F.lit("died")))
