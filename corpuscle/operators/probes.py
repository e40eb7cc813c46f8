"""Probes of a vocabulary: glyph maps, string ids, ratios on short texts, word starts inside tokens, verdicts with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.patterns import BASE
from corpuscle.operators import bpe, chunks

#: Short texts that strain a splitter or a codec: (name, text).
STRUCTURAL = (
    ("empty", ""), ("one", "a"), ("space", " "), ("spaces", "a   b    "), ("tabs", "\ta\t\tb"), ("breaks", "a\r\n\r\nb\n\n\nc"), ("controls", "a\x0b\x0cb"), ("digits", "123456789012345"),
    ("marks", "é ọ̈"), ("right to left", "שלום مرحبا"), ("joined", "👩‍👩‍👧‍👦🏳️‍🌈"), ("wide space", "a　b c"), ("repeats", "abab" * 20), ("symbols", "!!??--==//\\\\"),
)


def glyph_table() -> dict[str, int]:
    """Character by which byte-level vocabularies write each byte: printable bytes are themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def bytes_of_glyphs(token: Column) -> Column:
    """Bytes of a token that is written in glyphs; a token with any other character is taken as UTF-8."""
    table = glyph_table()
    hexes = F.create_map(*[F.lit(x) for g, b in table.items() for x in (g, f"{b:02X}")])
    pairs = F.transform(F.filter(F.split(token, ""), lambda g: g != ""), lambda g: F.element_at(hexes, g))
    return F.when(F.translate(token, "".join(table), "") == "", F.unhex(F.array_join(pairs, ""))).otherwise(F.encode(token, "utf-8"))


def string_ids(vocab: DataFrame) -> DataFrame:
    """(s, id): least id of each string; bytes that aren't UTF-8 share strings with replacement characters."""
    return vocab.where("not is_special").groupBy(F.make_valid_utf8(F.col("bytes").cast("string")).alias("s")).agg(F.min("id").alias("id"))


def ratios(probes: DataFrame, merges: list[bpe.Merge], pattern: str = BASE) -> DataFrame:
    """(name, bytes, tokens, ratio) of (name, text); 0 where there are no tokens."""
    unique = bpe.encoded(chunks.positioned(probes.select("name", "text"), pattern).select("chunk").distinct(), merges)
    n = chunks.positioned(probes.select("name", "text"), pattern).join(unique, "chunk").groupBy("name").agg(F.sum(F.size("ids")).alias("tokens"))
    j = probes.select("name", F.octet_length("text").cast("long").alias("bytes")).join(n, "name", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return j.select("name", "bytes", "tokens", F.when(F.col("tokens") > 0, F.col("bytes") / F.col("tokens")).otherwise(0.0).alias("ratio"))


def token_views(words: list[str], merges: list[bpe.Merge]) -> list[tuple[str, list[str]]]:
    """Tokens of each word, bare and behind a space, as bytes and ids."""
    encode = bpe.encoder(merges)
    raw = {i: bytes((i,)) for i in range(bpe.BYTES)} | {m.id: m.bytes for m in merges}
    return [(w, [f"{raw[i]!r}@{i}" for i in encode(w)]) for word in words for w in (word, " " + word)]


def inner_starts(vocab: DataFrame) -> DataFrame:
    """(id, starts): words that begin inside a token taken alone; 0 where it isn't UTF-8."""
    s = F.col("bytes").cast("string")
    return vocab.select("id", F.when(F.is_valid_utf8(s), F.regexp_count(s, F.lit(r"(?<!\p{L})\p{L}"))).otherwise(0).alias("starts"))


def verdict(**conditions: Column) -> Column:
    """A struct: promoted if all conditions hold, and the names of those that don't (a null doesn't)."""
    failed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), None).otherwise(F.lit(n)) for n, c in conditions.items()]))
    return F.struct((F.size(failed) == 0).alias("promoted"), failed.alias("failed"))
