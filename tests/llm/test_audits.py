"""Source divergence, tokenizer alignment, license scan: edge cases and brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpuscle.cluster import ship_code
from corpuscle.llm import alignment, divergence, licenses, words
from corpuscle.llm.encoding import default_path

DOCS = "doc_id long, text string, lang string, source string, term string, n long, rank string, block string, row string, label string"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_code(spark)


def frame(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "x", "x", "x", "x") for r in rows], DOCS)


# --- words ---


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZé中\x00 \n.0_9-`~{[@🙂") for _ in range(rng.randint(0, 12))) for _ in range(500)] + [None, "", "abc", "abc"]
    for digits, pattern in ((False, "[^\x00-\x40\x5b-\x60\x7b-\x7f]+"), (True, "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")):
        got, before, starts = words.cut(*words.raw(pa.array(texts)), words.byte_class(digits))
        want = [[w.translate(licenses._FOLD) for w in re.findall(pattern, t or "")] for t in texts]
        assert got.to_pylist() == [w for ws in want for w in ws] and np.diff(before).tolist() == [len(w) for w in want]
    data = "".join(t or "" for t in texts).encode()
    assert all(data[s : s + 1].strip() for s in starts.tolist())


def test_blocks_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 10)
    texts = ["a" * k for k in (3, 4, 3, 1, 25, 0, 0, 10, 11, 2)] + [None]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 4], pa.string())], ["t"]) for i in range(0, len(texts), 4)]
    tables = list(words.blocks(batches, ["t"], "t"))
    assert [x for t in tables for x in t.column("t").to_pylist()] == texts
    assert all(sum(len(x or "") for x in t.column("t").to_pylist()) <= 10 or t.num_rows == 1 for t in tables)


# --- source divergence ---


def audit_by_hand(rows, least=3, top=200):
    docs = [((lang or ""), (source or ""), [w.translate(licenses._FOLD) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for _, text, lang, source in rows]
    out = set()
    for lang in {x for x, _, _ in docs}:
        seen, counts = Counter(), defaultdict(Counter)
        for x, source, ws in docs:
            if x == lang:
                seen.update(set(ws))
                counts[source].update(ws)
        kept = [t for t, n in seen.items() if n >= least]
        whole = Counter()
        for c in counts.values():
            whole.update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[t] for t in kept) + len(kept)) for t in kept}
        q = share(whole)
        for source in counts:
            p = share(counts[source])
            pairs = [(-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), other.encode()) for other, r in ((o, share(counts[o])) for o in counts if o != source)]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[source][t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, source, part, item.decode(), -v, k) for k, (v, item) in enumerate(sorted(items)[:most], 1)}
    return out


def divergence_rows():
    rng, rows = random.Random(5), []
    vocabulary = ["The", "the", "été", "中文", "a", "b", "zz", "q'r", "x_y", "Ünï"] + [f"w{chr(97 + k)}" for k in range(20)]
    for i in range(150):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0"] * 6 + ["s1", "s2", "é", None])
        rows.append((i % 140, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) if rng.random() > 0.1 else rng.choice([None, "", "12 3"]), lang, source))
    rows += [(1, "only few", "fr", "s0"), (None, None, "fr", "s1"), (2, "", "xx", "alone")] + [(3, "same again", "it", s) for s in ("a", "a", "b", "b")]
    return rows


def test_divergence_equals_sums_by_hand(spark, monkeypatch):
    rows = divergence_rows()
    got = {tuple(r) for r in divergence.audited(frame(spark, rows).repartition(5)).collect()}
    assert got == audit_by_hand(rows)
    assert {r[:4] for r in got if r[0] == "fr"} == {("fr", "s0", "pair", "s1"), ("fr", "s1", "pair", "s0")}  # no term is kept there
    # Groups too many to be sent to all tasks: the same rows by shuffles; fewer terms reported.
    monkeypatch.setattr(divergence, "BROADCAST_BYTES", -1)
    assert {tuple(r) for r in divergence.audited(frame(spark, rows), top=4).collect()} == audit_by_hand(rows, top=4)


def test_divergence_cuts_blocks_between_terms():
    """Rows of terms that go on in the next batch stay together."""
    rows = [("en", f"t{k:02}", f"s{j}", 10 + k * j, 5, 20) for k in range(30) for j in range(1 + k % 4)]
    columns = list(zip(*rows, strict=True))
    t = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, divergence._ENTRIES, strict=True)], schema=divergence._ENTRIES)
    old, sums = divergence.ROWS, []
    for most in (1_000_000, 7):
        divergence.ROWS = most
        total = Counter()
        for b in divergence._partial(200)(t.to_batches(max_chunksize=5)):
            for r in b.to_pylist():
                total[r["kind"], r["source"], r["item"], r["p"]] += r["value"]
        sums.append(total)
    divergence.ROWS = old
    assert sums[0] == sums[1] and any(k[0] == "pair" for k in sums[0])


def test_divergence_long_text_and_empty_table(spark):
    long = " ".join(f"w{'abcdefghij'[k % 10]}" for k in range(900_000))
    rows = [(k, long if k == 0 else "wa wb", "en", "s0" if k < 2 else "s1") for k in range(4)]
    assert {tuple(r) for r in divergence.audited(frame(spark, rows)).collect()} == audit_by_hand(rows)
    assert divergence.audited(frame(spark, [])).isEmpty()


# --- tokenizer alignment ---


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))


def align_by_hand(texts, tokenizers):
    """Two pointers over whole texts, token by token, with fresh tokenizers."""
    a, b = tokenizers
    alphabet = alignment.byte_alphabet()
    docs, count = [], Counter()
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False), b.encode(t)) if t else (None, [])
        xs = [(i, bytes(alphabet[c] for c in s)) for i, s in zip(x.ids, x.tokens, strict=True)] if t else []
        ys = [(i, bytes((int(b.id_to_piece(i)[3:5], 16),)) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in y]
        if t and not b"".join(s for _, s in xs) == b"".join(s for _, s in ys) == (" " + t).encode():
            xs = ys = []
        groups, i, j, at_x, at_y, left, right = [], 0, 0, 0, 0, [], []
        while i < len(xs) or j < len(ys):
            if at_x <= at_y:
                left.append(xs[i][0])
                at_x, i = at_x + len(xs[i][1]), i + 1
            else:
                right.append(ys[j][0])
                at_y, j = at_y + len(ys[j][1]), j + 1
            if at_x == at_y:
                groups.append((left, right))
                left, right = [], []
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        count.update(set(links))
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        docs.append((len(xs), len(ys), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    most = Counter()
    for (p, _), n in count.items():
        most[p] = max(most[p], n)
    return [(x, y, g, len(ls), sum(count[k] == most[k[0]] for k in ls), sum(count[k] for k in ls), s) for x, y, g, ls, s in docs]


def hostile_texts():
    rng = random.Random(9)
    pieces = [*"abcXYZ'’ \n\té́ﬁ▁<>|0123,.中文🙂\r 　᠎\u0085\x00", "<|endoftext|>", "</s>", "<0x41>", "  ", "\n\n", " 's", "\n's", " the", " tokenization"]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(400)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_two_pointers(spark, sf_dir, tokenizers, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += hostile_texts() + [None, "", " ", "\n", "▁", "a", "trail ", " lead", "again", "again", "again", "a\nb", "<|endoftext|>", "y" * 3000]
    monkeypatch.setattr(alignment, "BLOCK", 20_000)  # workers are forked from here only before they start, so this may not reach them
    rows = frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.aligned(rows, default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")).collect()}
    want = align_by_hand(texts, tokenizers)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []
    assert got[texts.index("▁")][:4] == (0, 0, 0, 0) and got[texts.index("▁")][-1] == ""


def test_alignment_blocks_and_kept_units(monkeypatch, tokenizers):
    """Units come from a small table, blocks are small, units beyond a bound aren't kept: the same groups."""
    import pandas as pd
    import pyspark

    class Context:
        def partitionId(self):
            return 2

    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(Context))
    for name, value in (("KEPT_UNITS", 20), ("BLOCK", 200), ("TOGETHER", 3), ("LONG_UNIT", 8)):
        monkeypatch.setattr(alignment, name, value)
    alignment.held("nothing", dict)  # lets go of a table made with other bounds
    texts = ["to be or not to be " + "x" * (k % 30) + " tokenization\nagain and " + str(k) for k in range(80)] + hostile_texts()[:50]
    path = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")
    rows = pd.concat(alignment._aligned(*path, "doc_id", "text")([pd.DataFrame({"doc_id": range(len(texts)), "text": texts})]))
    docs, lists = rows[rows.a.isnull()], rows[rows.a.notnull()]
    want = align_by_hand(texts, tokenizers)
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in docs.itertuples()] == [(*w[:4], w[-1]) for w in want]
    assert len(lists) > 5 and lists.block.is_unique


def test_alignment_repeats_nulls_and_empty_table(spark, tokenizers):
    texts = ["one two", "one two", None, "one two"]
    rows = frame(spark, [(None if i == 3 else 7, t, "en", "s") for i, t in enumerate(texts)])
    path = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")
    got = sorted(tuple(r[c] for c in ("doc_id", *COLUMNS)) for r in alignment.aligned(rows, *path).fillna(-1, ["doc_id"]).collect())
    want = align_by_hand(texts, tokenizers)
    assert got == sorted((-1 if i == 3 else 7, *w) for i, w in enumerate(want))
    assert alignment.aligned(frame(spark, []), *path).isEmpty()


def test_varints():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1, 5])
    data, sizes = alignment.varints(x)
    back, ends = alignment.from_varints(data)
    assert back.tolist() == x.tolist() and ends.tolist() == np.cumsum(sizes).tolist() and len(alignment.from_varints(data[:0])[0]) == 0


# --- license scan ---


def scan_by_hand(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    ws = licenses.words_of(text or "")
    places = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
    runs = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    blocks = [runs(licenses.words_of(b)) for b in re.split(r"\n[ \t\r\f\v]*\n", text or "")]
    links = [(label, len(b & runs(licenses.words_of(t))) / len(runs(licenses.words_of(t)))) for b in blocks for label, t in templates]
    links = [x for x in links if x[1] >= threshold]
    base = {label for _, label in places}
    score = 1.0 if places else max((s for _, s in links), default=0.0)
    ends = (places[0][0], places[-1][0]) if places else (None, None)
    return (len(ws), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in links})), score, len(links))


def license_texts():
    rng = random.Random(4)
    whole = [t for _, t in licenses.TEMPLATES]
    texts = [None, "", "MIT\n\nLicense, mit license! MIT LICENSE", "apache  license general public\nlicense General Public Licence", "the mit\x00license", "İ mit license", *whole]
    for _ in range(300):
        t = rng.choice(whole).split(" ")
        for _ in range(rng.randint(0, 3)):  # words lost, changed or moved, and white space of all kinds
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["other"], [t[k], "x"], [t[k].upper()], ["\n", t[k]], ["\n \t\n", t[k]]])
        texts.append(rng.choice(["", "Some words before. ", "a\n"]) + rng.choice([" ", "  ", "\n"]).join(t) + rng.choice(["", "\n\nmore", " and after"]))
    return texts + [f"{a}\n\n{b}" for a, b in zip(whole, whole[1:], strict=False)]


def test_licenses_equal_all_pairs(spark):
    texts = license_texts()
    got = licenses.scanned(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).repartition(4))
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    assert [(t, rows[i], scan_by_hand(t)) for i, t in enumerate(texts) if rows[i] != scan_by_hand(t)] == []
    assert {"mit", "apache", "gpl", "bsd", "cc-by-nc"} <= {x for r in rows.values() for x in r[5].split(",")}


@pytest.mark.parametrize("threshold", [0.3, 0.55, 1.0])
def test_licenses_at_other_thresholds(spark, threshold):
    texts = license_texts()[:120]
    got = licenses.scanned(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), threshold=threshold)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == {i: scan_by_hand(t, threshold=threshold) for i, t in enumerate(texts)}


def test_licenses_repeats_long_texts_and_empty_table(spark):
    long = "word " * 400_000 + "\n\n" + licenses.TEMPLATES[0][1] + "\n" + "mit license " * 3
    rows = [(1, long, "en", "s"), (1, long, "en", "s"), (None, "mit license", "en", "s")]
    got = [tuple(r) for r in licenses.scanned(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(((i, *scan_by_hand(t)) for i, t, *_ in rows), key=str)
    assert licenses.scanned(frame(spark, [])).isEmpty()
    with pytest.raises(ValueError):
        licenses.scanned(frame(spark, []), templates=(("x", "two words"),))


def test_needed_overlap_is_exact():
    for n in range(1, 60):
        for threshold in (0.1, 0.5, 0.8, 0.9, 1.0):
            k = licenses._need(n, threshold)
            assert k / n >= threshold and (k == 1 or (k - 1) / n < threshold), (n, threshold, math.ceil(threshold * n))
