"""Quality rules: a table of thresholds compiled into one Spark projection; no user functions.

Words are runs of characters other than ASCII white space. A null or empty text has no words: every count is 0 and the
document fails the base rule. Rows are judged one by one, so repeated rows get the same verdict; a null doc_id stays null;
other columns are not read. Texts of any length are judged whole. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the four languages of the corpora.
STOP_WORDS = (
    "the of and to in is a for it on that was with as by are be this at from or an not have he you "
    "der die das und in zu den von mit ist ein eine im nicht sich auf auch für des dem als an es "
    "le la les de des et que un une en est pour dans du pas qui au sur par avec plus ce il "
    "el los las y un por con para se del al no es su lo como más o si"
).split()
#: The characters that count as symbols, and the white space that ends words.
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure <= high; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Measures are the columns that measures() makes.
RULES = (
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.02, None),
    Rule("dup_line_share", None, 0.5),
    Rule("words_per_line", 1.0, None),
)


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once, also where body names it often."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice. Windows are sorted by a 64-bit hash of their words; where hashes are equal the words are compared."""
    n = F.size(words)
    tag = lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2])
    hashes = F.transform(F.sequence(F.lit(0), n - 3), tag)

    def covered(tags: Column) -> Column:
        pairs = F.sort_array(F.transform(tags, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_sorted(s: Column) -> Column:
            last = F.size(s) - 1

            def alike(x: Column, y: Column) -> Column:
                out = x["h"] == y["h"]
                for k in range(3):
                    out = out & (words[x["i"] + k] == words[y["i"] + k])
                return out

            same = lambda x, k: ((k > 0) & alike(x, s[F.greatest(k - 1, F.lit(0))])) | ((k < last) & alike(x, s[F.least(k + 1, last)]))
            at = F.transform(F.filter(s, same), lambda x: x["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(tags)) == F.size(tags), F.lit(0)).otherwise(_bind(pairs, of_sorted))

    return F.when(n < 3, F.lit(0)).otherwise(_bind(hashes, covered))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts and ratios that rules may name."""
    t = F.coalesce(F.col(text), F.lit(""))
    flat = F.translate(t, SPACE[1:], " " * (len(SPACE) - 1))
    has_word = f"[^{SPACE[0]}\\x09-\\x0D]"
    count = lambda c: c.cast("long")
    a = docs.withColumn("_words", F.array_remove(F.split(flat, " "), "")).withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(has_word)))
    stop = sorted(set(STOP_WORDS))
    b = a.select(
        *docs.columns,
        count(F.size("_words")).alias("n_words"),
        count(F.length(F.translate(t, SPACE, ""))).alias("word_chars"),
        count(F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        count(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        count(_repeat_words(F.col("_words"))).alias("n_repeat_words"),
        count(F.size("_lines")).alias("n_lines"),
        F.size(F.filter(F.col("_words"), lambda w: F.lower(w).isin(stop))).alias("_stop"),
    )
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return b.select(
        "*",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("_stop") / words).alias("stop_word_share"),
        (F.col("n_dup_lines") / lines).alias("dup_line_share"),
        (F.col("n_words") / lines).alias("words_per_line"),
    ).drop("_stop")


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column for the whole table of thresholds."""
    verdict = F.lit(True)
    for r in rules:
        if r.low is not None:
            verdict = verdict & (F.col(r.measure) >= r.low)
        if r.high is not None:
            verdict = verdict & (F.col(r.measure) <= r.high)
    return verdict


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs with all measures, base_failed and kept. Columns of docs that clash with a measure's name are left out; select those wanted first."""
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "mean_word_chars", "symbols_per_word", "stop_word_share", "dup_line_share", "words_per_line", "base_failed", "kept", "_words", "_lines", "_stop"}
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if c == text or c.lower() not in made])
    m = measures(docs, text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return m.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def kept_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    j = judged(docs.select(F.struct("*").alias("_doc"), F.col(text).alias("_text")), "_text", rules)
    # The row number keeps the filter above the projection; below it, each use of a measure would compute it anew.
    return j.withColumn("_row", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_row") >= 0)).select("_doc.*")
