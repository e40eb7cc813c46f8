"""Split patterns and other fixed values of the vocabulary analytics."""

from __future__ import annotations

import re

# Split patterns, as results depend on every character of them.
DEFAULT = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
BASE = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
SPACELESS = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N} ]?+\p{L}+|\p{N}{1,2}|[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
DIGITFIX = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+| ?\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"

# Bucket edges (each edge belongs to the bucket above it) and vocabulary sizes.
RANK_BUCKETS = (0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768)
POOLING_EDGES = (1.0000001, 1.05, 1.2, 1.5, 2.0, 3.0)
CURVE_POINTS = (100, 500, 1000, 5000, 10000, 32000)
VOCAB_SIZE, VOCAB_SIZE_WITH_PHRASES = 32768, 32890

# English suffixes, longest kinds first as in the inventory, and space-prefixed prefixes.
SUFFIXES = (
    "izations", "isations", "ization", "isation", "ifications", "ification", "abilities", "ability", "ibilities", "ibility", "ologically",
    "ological", "fullness", "lessness", "ousness", "fully", "lessly", "ously", "ically", "ical", "ationally", "ationality", "ations", "ation",
    "tions", "tion", "sions", "sion", "ments", "ment", "nesses", "ness", "ities", "ity", "izing", "izes", "ized", "ize", "ising", "ises", "ised",
    "ise", "ifying", "ifies", "ified", "ify", "ables", "able", "ibles", "ible", "fulnesses", "ful", "less", "ous", "ative", "atives", "itive",
    "itives", "ives", "ive", "ally", "al", "ier", "iest", "ists", "ist", "isms", "ism", "ings", "ing", "ors", "or", "ers", "er", "ies", "ily", "ly",
    "ed", "es", "ences", "ence", "ances", "ance", "ents", "ent", "ants", "ant", "ages", "age", "aries", "ary", "ories", "ory", "eries", "ery",
    "ians", "ian", "ish", "icials", "icial", "ially", "ials", "ial", "itures", "iture", "atures", "ature", "ures", "ure", "ices", "ice", "eties",
    "ety", "acies", "acy", "hoods", "hood",
)
PREFIXES = (
    " counter", " electr", " therm", " chron", " hetero", " hydr", " photo", " macro", " micro", " neur", " astr", " cosm", " inter", " trans",
    " under", " super", " hyper", " ultra", " infra", " intra", " extra", " retro", " ortho", " multi", " pseudo", " proto", " endo", " ecto",
    " meso", " hypo", " hemi", " homo", " mono", " poly", " mega", " mini", " tele", " para", " meta", " anti", " semi", " auto", " exo", " iso",
    " peri", " epi", " bio", " geo", " neo", " over", " dis", " mis", " non", " pre", " pro", " sub", " out", " fore", " post", " un", " re", " in",
    " im", " de", " ex", " en", " co",
)


def java(pattern: str) -> str:
    """The pattern for Spark's regex functions; with (?U), so that white space and letters are Unicode's."""
    return "(?U)" + pattern


def with_phrases(pairs: list[tuple[str, str]], derived: list[tuple[str, str]] = (), longest_first: bool = False) -> str:
    """DIGITFIX with whole phrases tried first: derived ones, then the others, in list order (or all by length). No pairs: DIGITFIX itself."""
    phrases = [a + b for a, b in [*derived, *pairs]]
    if longest_first:
        phrases = sorted(dict.fromkeys(phrases), key=lambda p: -len(p))
    return f"({'|'.join(map(re.escape, phrases))})(?=([^a-z]|$))|{DIGITFIX}" if phrases else DIGITFIX


def duckdb_chunks(column: str, pattern: str = BASE) -> str:
    """SQL for DuckDB: the list of matches of BASE or SPACELESS. Its regex engine has no look-ahead, so the last blank before a non-space is marked first."""
    body = pattern.replace("?+", "?").replace("++", "+").replace(r"|\s+(?!\S)", "").replace("[^", r"[^\x01")
    marked = rf"regexp_replace({column}, '([ \t\f])([^\s])', chr(1) || '\1\2', 'g')"
    quoted = body.replace("'", "''")
    return f"list_transform(regexp_extract_all({marked}, '\\x01?(?:{quoted})'), lambda c: replace(c, chr(1), ''))"
