"""Column functions on texts and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuscle.functions.patterns import java


def bound(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def chunks(text: Column, pattern: str) -> Column:
    """Matches of a split pattern, in order; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))


def fold_case(text: Column) -> Column:
    """Lowers the first letter of each run of letters that is an upper-case letter with lower-case ones behind it, where that can be undone at the same byte length."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))

    def folded(run: Column) -> Column:
        first = F.substring(run, 1, 1)
        low = F.lower(first)
        fits = run.rlike(r"^\p{Lu}\p{Ll}*$") & (F.upper(low) == first) & (F.length(low) == 1) & (F.octet_length(low) == F.octet_length(first))
        return F.when(fits, F.concat(low, F.substring(run, 2, 1 << 30))).otherwise(run)

    return F.array_join(F.transform(runs, folded), "")


def without_space(token: Column) -> Column:
    """The token without one leading space."""
    return F.regexp_replace(token, "^ ", "")


def is_titlecase(token: Column) -> Column:
    return token.rlike(r"^ ?\p{Lu}\p{Ll}*$")


def is_word_phrase(token: Column) -> Column:
    return token.rlike(r"^[ \p{L}]+$")


def is_digits(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def lower_twin(token: Column) -> Column:
    """The token with its first letter lowered, its space kept."""
    space = F.when(token.startswith(" "), F.lit(" ")).otherwise(F.lit(""))
    return bound(without_space(token), lambda s: F.concat(space, F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30)))


def content_form(token_bytes: Column, token_id: Column) -> Column:
    """Token bytes as text without its space, case folded; a key of its own where the bytes aren't UTF-8."""
    s = token_bytes.cast("string")
    return F.when(F.is_valid_utf8(s), fold_case(without_space(s))).otherwise(F.concat(F.lit("\x00RAW"), token_id.cast("string")))


def is_utf8(token_bytes: Column) -> Column:
    return F.is_valid_utf8(token_bytes.cast("string"))


def binary_entropy(p: Column) -> Column:
    """Bits; 0 at 0 and 1."""
    q = 1 - p
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + q * F.log2(q)))


def bucket(value: Column, edges: tuple[float, ...]) -> Column:
    """Number of edges at or below the value."""
    out = F.lit(0)
    for e in edges:
        out = out + (value >= e).cast("int")
    return out


def unigram_bits(n: Column, total: Column, vocab: Column) -> Column:
    """Add-one smoothed."""
    return -F.log2((n + 1) / (total + vocab))


def stems(word: Column) -> Column:
    """What a dictionary may hold for an inflected word: without s, es, ed, ing or d, or with y for ies."""
    cut = lambda suf: F.when(word.endswith(suf) & (F.length(word) > len(suf) + 1), word.substr(F.lit(1), F.length(word) - len(suf)))
    y = F.when(word.endswith("ies") & (F.length(word) > 4), F.concat(word.substr(F.lit(1), F.length(word) - 3), F.lit("y")))
    return F.array_compact(F.array(cut("s"), cut("es"), cut("ed"), cut("ing"), cut("d"), y))


def longest_affix(token: Column, affixes: list[str], suffix: bool = True) -> Column:
    """The longest of the affixes that the token ends (or starts) with and is longer than; null if none."""
    out = F.lit(None).cast("string")
    for a in sorted(set(affixes), key=lambda a: (len(a), a)):
        here = (token.endswith(a) if suffix else token.startswith(a)) & (F.length(token) > len(a))
        out = F.when(here, F.lit(a)).otherwise(out)
    return out


def ends_sentence(before: Column) -> Column:
    """Whether the text before a span ends a sentence, or there is none."""
    return (before == "") | before.rlike(r"(\. |\.\n|\n|\? |! )$")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def slug(path: Column) -> Column:
    """Last part of a path, in lower case, other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]+)/*$", 1)), "[^a-z0-9]+", "_")


def seeded_below(p: float, *columns: Column, seed: int = 0) -> Column:
    """True for about a share p of rows, by a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1_000_000)) < int(p * 1_000_000)


def flipped_titlecase(text: Column, key: Column, p: float, seed: int = 1) -> Column:
    """Letter runs with the case of their first letter flipped, for about a share p of them."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))

    def flipped(run: Column, i: Column) -> Column:
        first = F.substring(run, 1, 1)
        other = F.when(first == F.upper(first), F.lower(first)).otherwise(F.upper(first))
        return F.when(run.rlike(r"^\p{L}") & seeded_below(p, key, i, seed=seed), F.concat(other, F.substring(run, 2, 1 << 30))).otherwise(run)

    return F.array_join(F.transform(runs, flipped), "")


def all_caps(text: Column, key: Column, p: float, seed: int = 2) -> Column:
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r, i: F.when(r.rlike(r"^\p{L}") & seeded_below(p, key, i, seed=seed), F.upper(r)).otherwise(r)), "")


def double_spaces(text: Column, key: Column, p: float, seed: int = 3) -> Column:
    parts = F.split(text, " ")
    return F.array_join(F.transform(parts, lambda s, i: F.when((i > 0) & seeded_below(p, key, i, seed=seed), F.concat(F.lit(" "), s)).otherwise(s)), " ")


def snippet(text: Column, start: Column, length: Column, around: int = 28) -> Column:
    """The text about a span (start from 1)."""
    first = F.greatest(start - around, F.lit(1))
    return text.substr(first, start + length + around - first)


def lambda_schedule(step: Column, total: int, start: float, end: float, shape: str = "linear") -> Column:
    """A weight that goes from start to end over the steps."""
    x = F.least(F.greatest(step / F.lit(max(total, 1)), F.lit(0.0)), F.lit(1.0))
    x = (1 - F.cos(F.lit(3.141592653589793) * x)) / 2 if shape == "cosine" else x
    return start + (end - start) * x
