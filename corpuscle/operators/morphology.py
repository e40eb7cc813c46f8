"""Tokens that cut words in the wrong place: affix rules as one CASE, formation routes as self-joins of the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import text as T
from corpuscle.functions.patterns import PREFIXES, SUFFIXES


def strings(vocab: DataFrame) -> DataFrame:
    """(id, s) of tokens that are UTF-8; specials left out."""
    s = F.col("bytes").cast("string")
    return vocab.where(~F.col("is_special") & F.is_valid_utf8(s)).select("id", s.alias("s"))


def verdicts(tokens: DataFrame, fires: DataFrame, suffix: bool = True, bound: float = 0.05, min_fires: int = 1, sibling_len: int = 1) -> DataFrame:
    """(id, s, affix, rest, reason) of every token that fires. Reasons come in the order of the rules; MANGLED passes them all.

    Suffix mode: rest is what stands before the suffix, and is bound if it seldom begins a chunk. Prefix mode mirrors it: rest
    stands behind the prefix and is bound if it seldom ends one; the token itself must seldom end one, too.
    """
    affixes = list(SUFFIXES if suffix else PREFIXES)
    f = fires.where(F.col("fires") >= min_fires).select("id", (F.col("first" if suffix else "last") / F.col("fires")).alias("p"))
    t = tokens.join(f, "id").withColumn("affix", T.longest_affix(F.col("s"), affixes, suffix))
    rest = F.col("s").substr(F.lit(1), F.length("s") - F.length("affix")) if suffix else F.expr("substr(s, length(affix) + 1)")
    t = t.withColumn("rest", rest)
    known = tokens.select("id", "s").join(f, "id", "left").select("s", F.coalesce("p", F.lit(0.0)).alias("p"))
    has = lambda name, key: known.select(F.col("s").alias(key), F.col("p").alias(name))
    t = t.withColumn("_spaced", F.concat(F.lit(" "), "s")).withColumn("_sibling", F.concat(F.lit(" "), "rest"))
    t = t.join(has("_own", "_spaced"), "_spaced", "left").join(has("_rest", "rest"), "rest", "left").join(has("_sib", "_sibling"), "_sibling", "left")
    is_affix = lambda c: F.col(c).isin(affixes)
    if suffix:
        reason = (
            F.when(is_affix("s"), "is_affix").when(F.col("_own").isNotNull(), "is_word").when(F.col("affix").isNull(), "no_affix").when(F.col("_rest").isNull(), "rest_not_token")
            .when(is_affix("rest"), "rest_is_affix").when(F.col("rest").startswith(" "), "rest_spaced").when(F.col("_rest") >= bound, "rest_free")
            .when(F.col("_sib").isNotNull() & (F.length("rest") >= sibling_len), "rest_has_sibling").otherwise("MANGLED")
        )
    else:
        reason = (
            F.when(is_affix("s"), "is_affix").when(F.col("affix").isNull(), "no_affix").when(F.col("p") >= bound, "is_word").when(F.col("_rest").isNull(), "rest_not_token")
            .when(F.col("_rest") >= bound, "rest_free").when(F.col("_sib").isNotNull() & (F.length("rest") >= sibling_len), "rest_has_sibling").otherwise("MANGLED")
        )
    return t.select("id", "s", "affix", "rest", reason.alias("reason"))


def tally(verdict: DataFrame) -> DataFrame:
    return verdict.groupBy("reason").agg(F.count("*").alias("n"))


def below_percentile(vocab: DataFrame, fires: DataFrame, percent: float) -> DataFrame:
    """(id, fires) of merged tokens that fire at most as often as the one at position floor(percent / 100 * (n - 1)) from below."""
    v = vocab.where(~F.col("is_special") & (F.octet_length("bytes") >= 2)).join(fires.select("id", "fires"), "id", "left").select("id", F.coalesce("fires", F.lit(0)).alias("fires"))
    r = v.withColumn("_r", F.row_number().over(Window.orderBy("fires", "id"))).withColumn("_n", F.count("*").over(Window.partitionBy()))  # a vocabulary
    cut = r.where(F.col("_r") == F.floor(F.lit(percent) / 100 * (F.col("_n") - 1)) + 1).agg(F.max("fires").alias("_cut"))
    if percent <= 0:
        return v.where("false")
    return v.crossJoin(F.broadcast(cut)).where("fires <= _cut").select("id", "fires")


def routes(vocab: DataFrame, targets: DataFrame, exclude: DataFrame | None = None, only_first: bool = False) -> DataFrame:
    """(id, l, r, l_id, r_id, route): splits of each target's bytes into two older tokens; route 1 has the least greater id.

    exclude: (l, r) bytes of pairs to pass over.
    """
    v = vocab.where("not is_special").groupBy("bytes").agg(F.min("id").alias("id"))
    t = vocab.join(targets.select("id").distinct(), "id", "left_semi").where(F.octet_length("bytes") > 1)
    cuts = t.select("id", "bytes", F.explode(F.sequence(F.lit(1), F.octet_length("bytes") - 1)).alias("k"))
    split = cuts.select("id", F.expr("substring(bytes, 1, k)").alias("l"), F.expr("substring(bytes, k + 1)").alias("r"))
    if exclude is not None:
        split = split.join(exclude.select("l", "r"), ["l", "r"], "left_anti")
    j = split.join(v.select(F.col("bytes").alias("l"), F.col("id").alias("l_id")), "l").join(v.select(F.col("bytes").alias("r"), F.col("id").alias("r_id")), "r")
    j = j.where("l_id < id and r_id < id")
    out = j.select("id", "l", "r", "l_id", "r_id", F.row_number().over(Window.partitionBy("id").orderBy(F.greatest("l_id", "r_id"), F.octet_length("l"))).alias("route"))
    return out.where("route = 1") if only_first else out


def lineage(merges: DataFrame, targets: DataFrame, depth: int = 32) -> DataFrame:
    """(target, id, depth): a token's merge tree, level by level."""
    level = targets.select(F.col("id").alias("target"), "id", F.lit(0).alias("depth"))
    out = level
    parents = merges.select("id", F.array("left", "right").alias("_p"))
    for k in range(1, depth + 1):
        level = level.join(parents, "id").select("target", F.explode("_p").alias("id"), F.lit(k).alias("depth"))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def standalone(docs: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): occurrences of ASCII words between other characters than ASCII letters, case kept."""
    found = docs.select(F.explode(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word").distinct().join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))


def bareness(n: Column) -> Column:
    """How well a surface stands alone."""
    return F.when(n >= 40, "word").when(n < 8, "fragment").otherwise("unclear")


def ambient(lists: DataFrame, least: int) -> DataFrame:
    """(s) in at least so many of the lists (list, s)."""
    return lists.groupBy("s").agg(F.count_distinct("list").alias("lists")).where(F.col("lists") >= least)


def contexts(encoded: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """(id, chunk, n, r): the k most frequent chunks that hold each target token."""
    t = encoded.select("chunk", "n", F.explode(F.array_distinct("ids")).alias("id")).join(F.broadcast(targets.select("id").distinct()), "id")
    return t.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "chunk"))).where(F.col("r") <= k).select("id", "chunk", "n", "r")


def blocks_by_right(blocks: DataFrame, deny: tuple[str, ...] = ()) -> DataFrame:
    return blocks.where(~F.col("r").isin(list(deny)) if deny else F.lit(True)).groupBy("r").agg(F.count("*").alias("n"))


def phrase_pairs(token_rows: DataFrame, whitelist: DataFrame, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(l, r, n): adjacent tokens across chunk borders whose first is in the whitelist (s). token_rows: (key..., cpos, tpos, s)."""
    w = Window.partitionBy(*key).orderBy("cpos", "tpos")
    t = token_rows.withColumn("_r", F.lead("s").over(w)).withColumn("_c", F.lead("cpos").over(w)).where("_c > cpos")
    return t.select(F.col("s").alias("l"), F.col("_r").alias("r")).join(whitelist.select(F.col("s").alias("l")).distinct(), "l", "left_semi").groupBy("l", "r").agg(F.count("*").alias("n"))


def unshadowed(pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Pairs in order without those whose left operand is the right one of an earlier pair that stays."""
    out, taken = [], set()
    for left, right in pairs:
        if left not in taken:
            out.append((left, right))
            taken.add(right)
    return out


def gaps(vocab: DataFrame, size: int) -> DataFrame:
    """One row: ids below size, and those without bytes."""
    ids = vocab.sparkSession.range(size).select(F.col("id").cast("int"))
    return ids.join(vocab.where(F.col("bytes").isNotNull()).select("id", F.lit(1).alias("_there")), "id", "left").agg(F.count("*").alias("n_ids"), F.count_if(F.col("_there").isNull()).alias("n_gaps"))


def atom_firings(fires: dict[str, DataFrame], suffix: bool = True) -> DataFrame:
    """(atom, tokenizer, fires) of the affixes that any of the tokenizers has: fires holds tables (s, fires)."""
    spark = next(iter(fires.values())).sparkSession
    atoms = F.broadcast(spark.createDataFrame([(a,) for a in (SUFFIXES if suffix else PREFIXES)], "atom string").distinct())
    rows = None
    for name, f in sorted(fires.items()):
        own = atoms.join(f, F.col("atom") == F.col("s")).select("atom", F.lit(name).alias("tokenizer"), "fires")
        rows = own if rows is None else rows.union(own)
    names = spark.createDataFrame([(n,) for n in sorted(fires)], "tokenizer string")
    there = rows.select("atom").distinct().join(F.broadcast(names), F.lit(True))
    return there.join(rows, ["atom", "tokenizer"], "left").groupBy("atom", "tokenizer").agg(F.coalesce(F.sum("fires"), F.lit(0)).alias("fires"))


def latent_routes(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """(l, r, target, l_rank, r_rank, gap): blocks (l, r) whose target was made before one of its operands, the widest gap first. ranks: (s, rank)."""
    rank = lambda key, name: ranks.select(F.col("s").alias(key), F.col("rank").alias(name))
    j = blocks.select("l", "r", F.concat("l", "r").alias("t")).join(rank("t", "target"), "t").join(rank("l", "l_rank"), "l").join(rank("r", "r_rank"), "r")
    late = j.where((F.col("l_rank") >= F.col("target")) | (F.col("r_rank") >= F.col("target"))).withColumn("gap", F.greatest("l_rank", "r_rank") - F.col("target"))
    return late.select("l", "r", "target", "l_rank", "r_rank", "gap").orderBy(F.desc("gap"), "l", "r")


def annotated(surfaces: DataFrame, words: DataFrame, counts: DataFrame, ambient_list: DataFrame, tag: str = "AMBIENT") -> DataFrame:
    """(s, fires, n, status, flags, note) of surfaces (s, fires): how often the bare word stands alone (counts: word, n), whether a dictionary
    holds it (DICT) or a stem of it (INFL), and flags: ART? if it fires but never stands alone, and the tag if it is in the ambient list (s)."""
    t = surfaces.select("s", "fires", T.without_space(F.col("s")).alias("word")).withColumn("_low", F.lower("word"))
    stems = t.select("_low").distinct().select("_low", F.explode(T.stems(F.col("_low"))).alias("w"))
    infl = stems.join(words.select(F.col("word").alias("w")), "w", "left_semi").select("_low").distinct().withColumn("_infl", F.lit(1))
    j = t.join(words.select(F.col("word").alias("_low"), F.lit(1).alias("_dict")).distinct(), "_low", "left").join(infl, "_low", "left")
    j = j.join(counts.select("word", "n"), "word", "left").join(ambient_list.select("s", F.lit(1).alias("_ambient")).distinct(), "s", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("word") == "", "-").when(F.col("_dict") == 1, "DICT").when(F.col("_infl") == 1, "INFL").otherwise("-")
    flags = F.array_compact(F.array(F.when((F.col("fires") > 0) & (F.col("n") == 0), F.lit("ART?")), F.when(F.col("_ambient") == 1, F.lit(tag))))
    j = j.select("s", "fires", "n", status.alias("status"), flags.alias("flags"))
    return j.withColumn("note", F.concat("s", F.lit(":"), "fires", F.lit("["), F.concat_ws(" ", F.concat(F.lit("s"), "n"), "status", "flags"), F.lit("]")))


def lost_words(base: DataFrame, variant: DataFrame, words: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(word, n): the k dictionary words that only the base vocabulary (s) holds behind a space, the most frequent first. counts: (word, n)."""
    own = lambda v: v.where(F.col("s").startswith(" ")).select(F.lower(F.substring("s", 2, 1 << 30)).alias("word")).join(words.select("word"), "word", "left_semi").distinct()
    lost = own(base).join(own(variant), "word", "left_anti").join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    return lost.orderBy(F.desc("n"), "word").limit(k)
