"""Toxicity: Levenshtein automata intersected with a lexicon trie find terms and misspellings; context windows weigh the hits.

The lexicon (whole words and word stems) and the weights are learned from labelled rows. Words are read by one automaton:
its states are sets of (trie node, edits so far), determinised as words reach them. A hit counts by whether it is exact or
misspelt, and by its window of words: between quotation marks it is taken as quotation, near other hits as abuse.

Null and empty texts have no hits and get the score of a text without hits. Texts and words of any length are read whole. A null doc_id is kept and
has no label. Rows are scored one by one, so repeated rows score alike; labels that repeat count once, contradicting ones count
as toxic. Of labelled texts that share their least shingle hash (near copies) the one of the least doc_id is learned from. Without labels of both classes the lexicon is empty and all scores are the smoothed share of toxic labels. Only
text is an input of a score; other columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.cluster import checkpointed
from corpuscle.llm.worker import held

#: Bounds of the sample of labelled rows the lexicon and the weights are fitted on, toxic and clean.
FIT_TOXIC, FIT_CLEAN = 2500, 5000
#: Shortest and longest stem.
STEM = (4, 8)
#: Terms of so many letters may be misspelt in their first letter, too; of shorter ones, of which many words differ in the first letter alone, it must match.
FIRST_LETTER = 7
#: States after which the automaton is begun anew; words longer than this aren't kept with their hits.
MAX_STATES, LONG_WORD = 200_000, 40
#: Words on each side of a hit that its context is read from.
WINDOW = 6
#: A term must be this much likelier (log likelihood ratio) to belong to the toxic texts than to be spread evenly.
LEAST_LLR = 16.0
#: Most share of clean texts that hold a term, relative to that of toxic ones.
MOST_RATIO = 0.12
CACHE_WORDS = 200_000
#: Weights before any row is seen: exact, misspelt and quoted hits, hits near each other, the constant.
PRIOR = (2.0, 1.2, 0.2, 0.5, -3.0)
#: Quotation marks.
QUOTES = "\"“”„«»‟"
_EDGES = ".,;:!?()[]{}<>'’‘*_-#&%$|/\\" + QUOTES


def edits_allowed(term: str, stem: bool) -> int:
    """Short terms must match exactly; longer ones may hold one edit, long ones two. Stems, that match more words, hold fewer."""
    n = len(term) - 2 * stem
    return 0 if n < 5 else 1 if n < 9 else 2


class LexiconAutomaton:
    """Deterministic automaton of all terms within their edits, built state by state when words need them; when there are many states it is begun anew.

    The first letter of a term must match, unless the term has at least FIRST_LETTER letters.
    """

    def __init__(self, terms: list[tuple[str, bool, float]]):
        self.children: list[dict[str, int]] = [{}]
        self.limit = [[0, 0]]  # most edits of any term below; of any whose first letter may differ
        self.word_end: list[tuple[int, float, bool] | None] = [None]  # (edits allowed, weight, whether the first letter may differ)
        self.stem_end: list[tuple[int, float, bool] | None] = [None]
        for text, stem, weight in terms:
            node, most, free = 0, edits_allowed(text, stem), len(text) >= FIRST_LETTER
            path = [0]
            for ch in text:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.limit.append([0, 0])
                    self.word_end.append(None)
                    self.stem_end.append(None)
                node = self.children[node][ch]
                path.append(node)
            for k in path:
                self.limit[k] = [max(self.limit[k][0], most), max(self.limit[k][1], most if free else 0)]
            (self.stem_end if stem else self.word_end)[node] = (most, weight, free)
        self.alphabet = {ch for c in self.children for ch in c}
        self._begin()

    def _begin(self) -> None:
        self.moves: list[dict[str, int]] = []
        self.states: list[tuple[frozenset, tuple[int, float] | None]] = []
        self.hits: list[tuple[int, float] | None] = []  # of a word that ends here
        self.numbers: dict = {}
        out: dict[tuple[int, bool], int] = {}
        self._put(out, 0, False, 0)
        self.start = self._number(frozenset((n, late, e) for (n, late), e in out.items()), None)

    def _ends(self, pairs, table) -> list[tuple[int, float]]:
        return [(e, x[1]) for n, late, e in pairs if (x := table[n]) and e <= x[0] and (x[2] or not late)]

    def _number(self, pairs: frozenset, stem_hit) -> int:
        key = (pairs, stem_hit)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.hits.append(min([*self._ends(pairs, self.word_end), *([stem_hit] if stem_hit else [])], key=lambda h: (h[0], -h[1]), default=None))
        return self.numbers[key]

    def _put(self, out: dict, node: int, late: bool, edits: int) -> None:
        """Adds a place in the trie, and those reached if letters of the term are missing. late: an edit was made at the first letter."""
        if edits <= self.limit[node][late] and out.get((node, late), 99) > edits:
            out[node, late] = edits
            for child in self.children[node].values():
                self._put(out, child, late or not node, edits + 1)

    def _move(self, state: int, ch: str) -> int:
        pairs, hit = self.states[state]
        out: dict[tuple[int, bool], int] = {}
        for node, late, edits in pairs:
            for c, child in self.children[node].items():
                if c == ch:
                    self._put(out, child, late, edits)
                else:
                    self._put(out, child, late or not node, edits + 1)
            self._put(out, node, late or not node, edits + 1)
        found = [(n, late, e) for (n, late), e in out.items()]
        hit = min([*self._ends(found, self.stem_end), *([hit] if hit else [])], key=lambda h: (h[0], -h[1]), default=None)
        self.moves[state][ch] = to = self._number(frozenset(found), hit)
        return to

    def match(self, word: str) -> tuple[int, float] | None:
        """(edits, weight) of the nearest term, or None."""
        if len(self.states) > MAX_STATES:
            self._begin()
        s, moves = self.start, self.moves
        for ch in word:
            if ch not in self.alphabet:
                ch = ""
            t = moves[s].get(ch)
            s = self._move(s, ch) if t is None else t
            if not self.states[s][0]:
                break
        return self.hits[s]


@dataclass(frozen=True)
class Model:
    """terms: (text, whether a stem, weight). coefficients: of features(), the last for the constant."""

    terms: tuple[tuple[str, bool, float], ...] = ()
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)
    readers: dict = field(default_factory=dict, compare=False, repr=False)


class _Reader:
    def __init__(self, model: Model):
        self.automaton = LexiconAutomaton(list(model.terms))
        self.cache: dict[str, tuple[int, float] | None] = {}

    def hit(self, raw: str):
        h = self.automaton.match(raw.strip(_EDGES))
        if len(raw) <= LONG_WORD:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            self.cache[raw] = h
        return h

    def features(self, text: str) -> list[float]:
        """Sums of the weights of exact, misspelt and quoted hits, damped, and the share of hits that have another in their window."""
        words = text.lower().split()
        cache, hits = self.cache, []
        for i, w in enumerate(words):
            h = cache[w] if w in cache else self.hit(w)
            if h is not None:
                hits.append((i, *h))
        sums, near = [0.0, 0.0, 0.0], 0
        for k, (i, edits, weight) in enumerate(hits):
            window = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
            quoted = (words[i][0] in QUOTES or any(w[0] in QUOTES and w[-1] not in QUOTES for w in window[0])) and (words[i].rstrip(".,;:!?")[-1:] in QUOTES or any(w.rstrip(".,;:!?")[-1:] in QUOTES for w in window[1]))
            near += (k > 0 and i - hits[k - 1][0] <= WINDOW) or (k + 1 < len(hits) and hits[k + 1][0] - i <= WINDOW)
            sums[2 if quoted else 1 if edits else 0] += weight
        return [math.log1p(s) for s in sums] + [near / len(hits) if hits else 0.0]


def _reader(model: Model) -> _Reader:
    return held(("toxicity", model.terms), lambda: _Reader(model))


def score_texts(model: Model, texts: list[str | None]) -> list[float]:
    r, c = _reader(model), model.coefficients
    out = []
    for t in texts:
        x = r.features(t) if t else [0.0] * 4
        z = sum(a * b for a, b in zip(c, [*x, 1.0], strict=True))
        out.append(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))))
    return out


def _grams(text: str) -> set[str]:
    """Whole words, marked by a $, and their stems."""
    out = set()
    for raw in set(text.lower().split()):
        w = raw.strip(_EDGES)
        if w:
            out.add(w + "$")
            out.update(w[:k] for k in range(STEM[0], min(STEM[1], len(w)) + 1))
    return out


def _sketched(batches):
    """Adds the least hash of a text's runs of five words. Most near copies agree in it, so that a term isn't taken for telling because one text was copied."""
    for b in batches:
        least = []
        for t in b.column("text").to_pylist():
            w = (t or "").lower().split()
            least.append(min(xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))) >> 1)
        yield pa.RecordBatch.from_arrays([b.column("text"), b.column("toxic"), b.column("doc_id"), pa.array(least, pa.int64())], ["text", "toxic", "doc_id", "sketch"])


def _counted(batches):
    """Documents of each label that hold a term: rows (term, toxic, clean), summed within a task."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        keys = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], ["term", "a", "b"])
        counts[0].clear()
        counts[1].clear()
        return out

    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(_grams(text or ""))
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flush()
    yield flush()


def _chosen(rows: list[tuple[str, int, int]], a_all: int, b_all: int) -> list[tuple[str, bool, float]]:
    """Of the terms that tell, the longest stem that keeps a family of words, or the one word that the family consists of."""
    counts = {t: (a, b) for t, a, b in rows}
    weight = lambda a, b: max(0.1, math.log((a + 0.5) / (a_all + 1)) - math.log((b + 0.5) / (b_all + 1)))
    stems = {t: a for t, (a, _) in counts.items() if not t.endswith("$")}
    words = {t[:-1]: a for t, (a, _) in counts.items() if t.endswith("$")}
    out, covered = [], set()
    for root in sorted((t for t in stems if len(t) == STEM[0] or t[:-1] not in stems), key=lambda t: (len(t), t)):
        s = root
        while longer := [t for t in stems if len(t) == len(s) + 1 and t.startswith(s) and stems[t] >= 0.95 * stems[s]]:
            s = max(longer, key=lambda t: (stems[t], t))
        own = [w for w in words if w.startswith(root)]
        covered.update(own)
        if best := [w for w in own if words[w] >= 0.9 * stems[root]]:
            out.append((best[0], False, weight(*counts[best[0] + "$"])))
        else:
            out.append((s, True, weight(*counts[s])))
    out += [(w, False, weight(*counts[w + "$"])) for w in words if w not in covered]
    return sorted(set(out))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05) -> tuple[float, ...]:
    """Weights by Newton's steps with a small ridge about PRIOR, which holds what the sample says nothing of; all but the constant are held at 0 or above."""
    x = np.column_stack([x, np.ones(len(x))])
    w, free = np.array(PRIOR), np.ones(x.shape[1], bool)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (p - y) + l2 * (w - np.array(PRIOR))
        h = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        w = w - np.clip(step, -3, 3)
        if (low := (w[:-1] < 0)).any():
            free[:-1] &= ~low
            w[:-1][low] = 0
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, w))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = FIT_TOXIC, max_clean: int = FIT_CLEAN) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Both lexicon and weights come from at most max_toxic and max_clean labelled rows, chosen by a hash."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic")
    sketched = rows.mapInArrow(_sketched, "text string, toxic int, doc_id long, sketch long")
    rows = checkpointed(sketched.groupBy("sketch", "toxic").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text")).select("text", "toxic"))
    counts = dict(rows.groupBy("toxic").count().collect())
    a_all, b_all = counts.get(1, 0), counts.get(0, 0)
    if not a_all or not b_all:
        prior = (a_all + 1) / (a_all + b_all + 2)
        return Model((), (0.0, 0.0, 0.0, 0.0, math.log(prior / (1 - prior))))
    share = a_all / (a_all + b_all)
    n, p = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    llr = n * (p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0))
    terms = rows.mapInArrow(_counted, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    telling = terms.where((F.col("a") > 0) & (p > share) & (F.col("b") / b_all < MOST_RATIO * F.col("a") / a_all)).withColumn("llr", llr).where(F.col("llr") >= LEAST_LLR)
    lexicon = tuple(_chosen([(r.term, r.a, r.b) for r in telling.collect()], a_all, b_all))  # as many as the bounded sample tells
    blank = Model(lexicon)

    def featured(batches):
        for b in batches:
            r = _reader(blank)
            x = [r.features(t) if t else [0.0] * 4 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    data = rows.mapInArrow(featured, "toxic int, x array<double>").toArrow()
    y = np.array(data.column("toxic").to_pylist(), float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, (1.0, 0.3, 0.1, 0.0, -3.0))
    return Model(lexicon, _logistic(np.array(data.column("x").to_pylist(), float), y))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1."""
    terms, coefficients = model.terms, model.coefficients

    @F.pandas_udf("double")
    def of_text(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(Model(terms, coefficients), texts.tolist()), dtype="float64")

    return docs.withColumn(score, of_text(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    """Whether the crc32 of the doc_id as text leaves 1 when divided by 3; false for a null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
