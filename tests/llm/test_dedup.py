"""Line dedup, near-dedup, components: against brute force, on hot groups, and on edge cases."""

import itertools
import random

import numpy as np
import pytest

from corpuscle.cluster import Scratch, ship_code
from corpuscle.llm import components as module
from corpuscle.llm import linededup, neardup
from corpuscle.llm.components import components
from corpuscle.llm.linkage import bag_jaccard, set_jaccard

DOCS = "doc_id long, text string, row string"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_code(spark)


class Sets:
    def __init__(self):
        self.p = {}

    def root(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            self.p[x] = x = self.p[self.p[x]]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.p[max(a, b)] = min(a, b)


def test_components_of_chains_stars_and_noise(spark, monkeypatch):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 400)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(120)] + [(5, 5)]
    s = Sets()
    for a, b in links:
        s.join(a, b)
    df = spark.createDataFrame(links + [(None, 3)], "a long, b long").repartition(7)
    with Scratch(spark, "test") as scratch:
        got = {r.node: r.root for r in components(df, scratch).collect()}
        assert all(got.get(x, x) == s.root(x) for x in s.p)
        assert components(df.where("false"), scratch).count() == 0
        monkeypatch.setattr(module, "UNITE_AT_ONCE", 20)  # rounds, as for links beyond one task
        got = {r.node: r.root for r in components(df, scratch).collect()}
        assert all(got.get(x, x) == s.root(x) for x in s.p)


def documents(rng):
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=rng.randint(30, 90))) for _ in range(40)]
    out = list(base)
    for b in base[:15]:
        for _ in range(3):
            w = b.split()
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
            out.append(" ".join(w))
    hot = base[0].split() * 2
    for k in range(150):  # a large group of near copies
        w = list(hot)
        w[k % len(w)] = f"hot{k}"
        out.append(" ".join(w))
    out += [base[3]] * 30 + ["", "   ", None, "one two", "ONE  two", "x " * 5000, "x " * 4900]
    return out


def test_near_groups_equal_brute_force(spark):
    texts = documents(random.Random(7))
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in neardup.near_groups(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    bags = [neardup._bag(neardup.normalised(t)) for t in texts]
    s = Sets()
    for i, j in itertools.combinations(range(len(texts)), 2):
        if bag_jaccard(bags[i], bags[j], 0.8) >= 0.8:
            s.join(i, j)
    assert {i: got[i].group_id for i in got} == {i: s.root(i) for i in range(len(texts))}
    assert sum(r.kept for r in got.values()) == len({s.root(i) for i in range(len(texts))})


def test_near_dedup_nulls_repeats_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(40))
    other = " ".join(f"u{i}" for i in range(40))
    rows = [(None, text, "a"), (None, other, "b"), (7, text + " more", "c"), (7, text + " more", "c"), (9, "alone in the world of words", "d"), (None, other, "e")]
    kept = neardup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept) == sorted([(False, 7, text + " more"), (True, 0, other), (False, 9, "alone in the world of words")])
    assert neardup.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_bag_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    items = rng.integers(1, 2**62, 60).astype(np.uint64)
    wa, wb = rng.integers(1, 40, 60), rng.integers(1, 40, 60)
    true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    m = 4096
    sig = neardup.bag_signatures(np.repeat([0, 1], 60), np.r_[items, items], np.r_[wa, wb], 2, m)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / m)


def test_shingle_bags_count_repeats():
    doc, item, count = neardup.shingle_bags(["a b a b a b a b", "one two", "p q r s t"])
    assert [int(count[doc == d].sum()) for d in range(3)] == [4, 1, 1] and sorted(count[doc == 0].tolist()) == [2, 2]


def test_line_signatures_and_codes_equal_plain_ones():
    rng = random.Random(9)
    lines = ["".join(rng.choices("abc é日👍.", k=rng.choice((linededup.SHINGLE, 9, 10, 40, 41, 300, 2000)))) for _ in range(80)] + ["abcdefg"] * 3
    got = linededup.line_signatures(lines, 7)
    for line, row in zip(lines, got, strict=True):
        assert (linededup.line_signatures([line], 7)[0] == row).all()
    plain = ["".join(rng.choices("abé", k=rng.choice((3, 5, 30, 31)))) for _ in range(60)] + lines
    for a, b in zip(plain, plain[1:], strict=False):
        assert linededup.codes_jaccard(linededup._codes(a), linededup._codes(b), 0.1) == set_jaccard(linededup._shingles(a), linededup._shingles(b), 0.1)


def brute_lines(texts):
    keys = [(i, k, linededup.line_key(line)) for i, t in enumerate(texts) if t for k, line in enumerate(t.split("\n"))]
    names = list(dict.fromkeys(s for *_, s in keys if s))
    s = Sets()
    sets = {n: linededup._shingles(n) for n in names}
    for a, b in itertools.combinations(names, 2):
        if min(len(a), len(b)) >= linededup.SHINGLE and set_jaccard(sets[a], sets[b], 0.8) >= 0.8:
            s.join(a, b)
    seen, out = set(), []
    for i, t in enumerate(texts):
        if not t:
            out.append(t)
            continue
        keep = []
        for line in t.split("\n"):
            n = linededup.line_key(line)
            if not n or s.root(n) not in seen:
                keep.append(line)
                seen.add(s.root(n) if n else None)
        out.append("\n".join(keep))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(200)]
    lines = [" ".join(rng.choices(words, k=rng.randint(15, 30))) for _ in range(30)]
    near = [line[:-3] + "abc" for line in lines[:12]] + [line.upper() for line in lines[12:18]] + ["  " + line + " " for line in lines[18:24]]
    pool = lines + near + ["short", "Short", "", "   ", "}", "exactly10!"]
    texts = ["\n".join(rng.choices(pool, k=rng.randint(1, 9))) for _ in range(60)] + [None, "", "\n\n", "x" * 100_000 + "\nshort"]
    docs = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], DOCS).repartition(4)
    got = {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


def test_line_dedup_links_a_typo_in_a_short_line(spark):
    lines = [f"{k} of the quick brown foxes jumped over lazy dogs near the river" for k in ("one", "a hundred and twenty")]
    typo = [x.replace("jumped", "jumbed") for x in lines]
    other = "nothing in this line of text is like what the other lines are saying"
    docs = spark.createDataFrame([(0, "\n".join(lines), "r"), (1, "\n".join([*typo, other]), "r"), (2, "nine char", "r"), (3, "nine chat", "r")], DOCS)
    got = {r.doc_id: r.text for r in linededup.deduplicated(docs).collect()}
    assert got[1] == other and got[2] == "nine char" and got[3] == "nine chat"


def test_line_dedup_hot_line_repeats_nulls_and_empty(spark):
    rows = [(i, f"license line that all share\nown line number {i} of this text here", 0) for i in range(120)] + [(3, "license line that all share\nown line number 3 of this text here", 0), (None, "license line that all share", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = linededup.deduplicated(docs).collect()
    assert sum("license" in r.text for r in out) == 1
    last = [r for r in out if r.doc_id is None][0]
    assert last.text == "" and last.n_chars == 0
    assert len({r.text for r in out if r.doc_id == 3}) == 1
    assert linededup.deduplicated(docs.where("false")).count() == 0


def test_dedup_keeps_columns_of_any_name(spark):
    """Columns that are named like those the operators use inside, very long lines, and an empty table."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, "a shared line of this length\n" + long, "x", 7, "g", "k", 9), (2, "a shared line of this length", None, 8, "h", "l", 9), (2, "a shared line of this length", None, 8, "h", "l", 9), (3, None, "y", 1, "i", "m", 9), (4, long + " more", "z", 2, "j", "n", 9)]
    schema = "doc_id long, text string, _row string, row int, gone string, d string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    out = sorted(linededup.deduplicated(docs).collect(), key=lambda r: (r.doc_id, str(r.text)))
    assert linededup.deduplicated(docs).columns == docs.columns and len(out) == 5
    assert [(r._row, r["row"], r.gone, r.d) for r in out] == sorted([r[2:6] for r in rows], key=lambda x: x[2])
    assert [r.text for r in out if r.doc_id == 2] == ["", ""] and [r.n_chars for r in out if r.doc_id == 2] == [0, 0]
    assert out[-1].text == "" and out[0].text == rows[0][1]  # the long line of 4 is near that of 1
    near = neardup.deduplicated(docs)
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == [1, 2, 3]
    assert neardup.deduplicated(docs.where("false")).count() == linededup.deduplicated(docs.where("false")).count() == 0


def test_a_hot_bucket_of_unlike_items_loses_no_link(spark):
    """All items share a key; alike ones are found though neither is the least, and only once."""
    import pyarrow as pa

    from corpuscle.llm import linkage

    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefgh ", k=60)) for _ in range(150)]
    texts = sorted(base + [t[:-1] + "z" for t in base[:70]])
    key = np.array([42], "<i8").tobytes()
    own = np.array([7], "<i8").tobytes()
    banded = spark.createDataFrame([(i, key + (own if i % 50 == 0 else b"")) for i in range(len(texts))], "id long, keys binary").repartition(3)

    def fetch(wanted, out, schema):
        def run(batches):
            for b in batches:
                ids = b.column("id").to_pylist()
                yield out(ids, [b"%09d" % i for i in ids], [texts[i] for i in ids], b.column("heads").to_pylist(), b.column("salts").to_pylist())

        return wanted.select("id", "heads", "salts").mapInArrow(run, schema)

    assert pa is not None
    want = Sets()
    sets = [linededup._shingles(t) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if set_jaccard(sets[i], sets[j], 0.8) >= 0.8:
            want.join(i, j)
    for sketch in (None, linededup._sketch):
        with Scratch(spark, "hot") as scratch:
            got = {int(r.node): int(r.root) for r in linkage.linked_groups(banded, fetch, linededup._codes, linededup.codes_jaccard, 0.8, scratch, sketch).collect()}
        assert all(got.get(i, i) == want.root(i) for i in range(len(texts))) and len(got) >= 60
