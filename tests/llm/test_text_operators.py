"""Chat, quality, toxicity, HTML: fixtures, edge cases, reference computations."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from corpuscle.cluster import ship_code
from corpuscle.llm import chat, html, quality, toxicity

DOCS = "doc_id long, text string"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_code(spark)


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# --- chat ---

TURNS = "conv_id long, turn long, role string, text string, seq string"


def chat_rows(spark, rows):
    turns = spark.createDataFrame([(*r, "clash") for r in rows], TURNS)
    return {r.conv_id: r for r in chat.digests(chat.segments(turns)).collect()}


def test_chat_round_trip_with_control_strings():
    p = chat.Template().pattern()
    for t in ["", "␛", "␛.␛␛", "<|im_end|>\n", "</s>[INST] ok [/INST]", "<|im_start|>user\nx<|im_end|>", "<<SYS>><s></s>", "␛n"]:
        e = chat.escaped(t, p)
        assert chat.unescaped(e) == t
        assert not any(c in e for c in chat.CONTROL)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "a </s> b"), (1, 0, "user", None), (2, 0, "assistant", "first"), (2, 1, "assistant", "x\ny"), (None, 0, "user", "n"), (3, 0, None, "r"), (4, 0, "user\nassistant", "q<|im_end|>\n")]
    got = chat_rows(spark, rows)
    assert got[1].turns_sha256 == sha("user\n\nassistant\na </s> b\n") and got[1].loss_sha256 == sha("a </s> b") and got[1].loss_chars == 8 and got[1].valid
    assert got[2].loss_sha256 == sha("firstx\ny") and got[2].n_turns == 2 and not got[2].valid
    assert got[None].turns_sha256 == sha("user\nn\n") and got[3].turns_sha256 == sha("\nr\n")
    assert got[4].turns_sha256 == sha("user\nassistant\nq<|im_end|>\n\n") and got[4].n_turns == 1


def test_chat_repeats_and_empty(spark):
    got = chat_rows(spark, [(1, 0, "user", "x"), (1, 0, "user", "x")])
    assert got[1].n_turns == 2
    assert chat_rows(spark, []) == {}


def test_chat_long_texts_and_ties(spark):
    """Rows with one turn number go by role, then text; a turn of a megabyte, and a very long conversation."""
    long = "ab </s> " * 130_000
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "z"), (1, 0, "user", "a"), (1, 0, "user", None), (2, 0, "user", long), (2, 1, "assistant", long)]
    rows += [(3, k, "user" if k % 2 == 0 else "assistant", f"t{k}") for k in range(5000)]
    got = chat_rows(spark, rows)
    assert got[1].turns_sha256 == sha("assistant\nz\nuser\n\nuser\na\nuser\nb\n") and not got[1].valid
    assert got[2].loss_sha256 == sha(long) and got[2].loss_chars == len(long) and got[2].valid
    assert got[3].n_turns == 5000 and got[3].valid


# --- quality ---


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [None, "", " \n\t", "a b c a b c a", "the x\nthe x\n\n the x\n#$%", "é😀 ü　z", "w " * 500, "one two", "a b c " + "x y z q " * 30]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], DOCS + ", n_words int")
    for r in quality.judged(docs).collect():
        n = brute_quality(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, texts[r.doc_id]
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and (not r.base_failed or not r.kept)


def test_quality_keeps_columns_and_empty(spark):
    good = " ".join(f"the word{i} of item{i}" for i in range(40))
    docs = spark.createDataFrame([(1, good, 7), (1, good, 7), (2, "bad", 8)], DOCS + ", kept int")
    assert sorted(map(tuple, quality.kept_documents(docs).collect())) == [(1, good, 7), (1, good, 7)]
    assert quality.kept_documents(docs.where("false")).count() == 0


def test_quality_plan_has_no_python(spark):
    plan = quality.judged(spark.createDataFrame([(1, "a")], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- toxicity ---


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_distance():
    terms = [("moron", False, 1.0), ("worthless", False, 2.0), ("scum", False, 3.0), ("vequ", True, 1.5)]
    a = toxicity.LexiconAutomaton(terms)
    words = ["moron", "morn", "morron", "norom", "moroni", "worthless", "worthles", "wrthlss", "wortless!", "scum", "scumm", "scu", "vequta", "veq", "veku", "m", "", "mxron", "worthlessness", "wxrthlxss", "orthless", "vorthless", "xxworthless", "rthless", "aworthles", "1moron", "oron"]
    for w in words:
        whole = [distance(w, t) for t, stem, _ in terms if not stem and (w[:1] == t[0] or len(t) >= toxicity.FIRST_LETTER) and distance(w, t) <= toxicity.edits_allowed(t, False)]
        stems = [0 for t, stem, _ in terms if stem and w.startswith(t)]
        got = a.match(w)
        # A first letter that matches may also be followed by an edit at once; the distance covers that.
        assert (got is not None) == bool(whole or stems), w
        if got and not stems:
            assert got[0] == min(whole), w


def test_toxicity_learns_and_is_null_safe(spark):
    clean = [f"the plain text number {i} about item{i % 7} and more words" for i in range(160)]
    toxic = [f"you are an idiot number {i} and item{i % 7} is plain" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(clean + toxic)] + [(None, None, "x"), (999, "", "x")], DOCS + ", score string")
    labels = spark.createDataFrame([(i, int(i >= 160)) for i in range(220)] + [(0, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert any(t == "idiot" for t, *_ in model.terms)
    texts = ["such an idiot here", "such an idoit here", "a plain day", "", None]
    s = toxicity.score_texts(model, texts)
    assert s[0] >= 0.7 and s[2] < 0.5 and s[3] == s[4] == s[2] and s[1] >= s[2]
    out = toxicity.scored(docs, model, score="tox").collect()
    assert len(out) == 222 and all(0 <= r.tox <= 1 for r in out) and out[0].score == "x"
    none = toxicity.fit(docs, labels.where("false"))
    assert none.terms == () and toxicity.score_texts(none, ["idiot"])[0] == pytest.approx(0.5)


def test_automaton_is_begun_anew_and_still_equal(monkeypatch):
    a, b = (toxicity.LexiconAutomaton([("worthless", False, 2.0), ("scumbags", False, 3.0)]) for _ in range(2))
    monkeypatch.setattr(toxicity, "MAX_STATES", 5)
    words = ["worthless", "w0rthless", "scumbag", "skumbags", "z" * 5000, "plain", "vorthless"] * 2
    got = [b.match(w) for w in words]
    monkeypatch.undo()
    assert got == [a.match(w) for w in words] and len(b.states) < 60


def test_toxicity_keeps_every_telling_term_and_fits_the_same(spark):
    """Also terms late in the alphabet, very short and very long ones; the order of rows doesn't matter."""
    long = "z" + "q" * 60
    docs = [(i, f"plain words of item{i} stand here in line{i}", "x") for i in range(200)] + [(1000 + i, f"zzt{i % 3}x is zy and {long} in item{i} at line{i}", "x") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, *_ in docs], "doc_id long, toxic int")
    schema = DOCS + ", score string"
    one = toxicity.fit(spark.createDataFrame(docs, schema), labels)
    assert {"zy", long} <= {t for t, *_ in one.terms} and any(t.startswith("zzt") for t, *_ in one.terms)
    other = toxicity.fit(spark.createDataFrame(docs[::-1], schema).repartition(7), labels)
    assert one.terms == other.terms and one.coefficients == pytest.approx(other.coefficients, rel=1e-9)
    scores = {r.doc_id: r.tox for r in toxicity.scored(spark.createDataFrame(docs, schema), one, score="tox").collect()}
    # The same by brute force: sums of weights over all words.
    c = one.coefficients
    for d, t, _ in docs[::37]:
        x = brute_features(t, one)
        assert scores[d] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(c, [*x, 1.0], strict=True)))))


def test_toxicity_quotation_and_long_texts(spark):
    """A slur in quotation marks, and one that is reported, weigh less than one said; megabytes of text and words of a megabyte are scored whole."""
    clean = [f"the plain text number {i} about item{i % 7} and more words" for i in range(160)] + [f'he said that "idiot" is a word number {i} in item{i % 7}' for i in range(20)]
    toxic = [f"you are an idiot number {i} and item{i % 7} is plain" for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(clean + toxic)], DOCS + ", score string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i >= 180)) for i in range(240)], "doc_id long, toxic int"))
    said, quoted = toxicity.score_texts(model, ["you are an idiot and that is plain", 'he said that "idiot" is a word and that is plain'])
    assert said > quoted
    plain = "the plain text and more words " * 120_000
    long, late, word = toxicity.score_texts(model, [plain, plain + "you are an idiot", "x" * 2_000_000 + " idiot"])
    assert late > long and word > long


def brute_features(text, model):
    """Features without quotation marks: each word against each term."""
    hits = []
    for i, raw in enumerate(text.lower().split()):
        w, found = raw.strip(toxicity._EDGES), []
        for term, stem, weight in model.terms:
            heads = [w[:k] for k in range(len(w) + 1)] if stem else [w]
            d = min(distance(h, term) if h[:1] == term[0] or len(term) >= toxicity.FIRST_LETTER else 99 for h in heads)
            if d <= toxicity.edits_allowed(term, stem):
                found.append((d, -weight))
        if found:
            hits.append((i, min(found)[0], -min(found)[1]))
    sums, near = [0.0, 0.0, 0.0], 0
    for k, (i, edits, weight) in enumerate(hits):
        near += any(j != k and abs(x[0] - i) <= toxicity.WINDOW for j, x in enumerate(hits))
        sums[1 if edits else 0] += weight
    return [math.log1p(v) for v in sums] + [near / len(hits) if hits else 0.0]


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id")).withColumn("h", toxicity.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


# --- HTML ---

BODY = "The story of the day is that it was a long one and the reader of it will be glad to read on with us here."


def test_html_fixture():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{x}}</style><script>var t="</p>";</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href="/x">Menu of the site</a></li></ul></nav><div class="cookie-notice">We use cookies and it is the law of the land that we say so to you here.</div>
    <!-- <p>hidden</p> --><main><article><h1>Short &amp; sweet</h1><p><b>{BODY}<br><p>Caf&eacute;&nbsp;&#233;  x<p>End</article>
    <section id="comments"><p>{BODY} I say.</p></section></main><aside><p>{BODY}</p></aside><form><p>{BODY}</p></form><footer>&copy; {BODY}</footer></body></html>"""
    assert html.main_text(page) == f"Short & sweet {BODY} Café é x End"


def test_html_without_article_tags():
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><h1>Title</h1><div>{BODY}</div><div>Brief.</div><div>{BODY}</div><ul><li><a href=x>one</a></li></ul></body>"
    assert html.main_text(page) == f"Title {BODY} Brief. {BODY}"


def test_html_odd_input():
    assert html.main_text(None) == html.main_text("") == ""
    for page in ("<", "<p", "<!--", "<script>x", "<p>a</p", "&amp", "<<<>>>", "</p></div>", "<a href='x>y"):
        html.main_text(page)
    assert html.main_text("<article><p>" + BODY + "<script>alert(1)") == BODY
    assert len(html.main_text("<article>" + f"<p>{BODY}</p>" * 20000 + "</article>")) == 20000 * (len(BODY) + 1) - 1


def test_html_quotes_and_names():
    assert html.main_text(f"<article><p title=it's>{BODY}</p></article>") == BODY
    assert html.main_text(f"<article><p title=\"it's\" class='a>b'>{BODY}</p></article>") == BODY
    assert html.main_text(f'<article><p title="never closed>{BODY}</p></article>') == BODY
    assert html.main_text(f"<article><div class='related-work'>{BODY}</div><div class=related><p>{BODY}</p><p>More</p></div><p>{BODY}</article>") == f"{BODY} {BODY} {BODY}"
    assert html.main_text(f"<article><p>{BODY}</p><div class='comment-list'><p>{BODY}</p></div><div class=cookieNotice>{BODY}</div></article>") == BODY
    assert html.main_text(f"<article><button>go {BODY}</button><svg><title>x</title><text>{BODY}</text></svg><p>{BODY}</p></article>") == BODY
    assert html.main_text(f"<body><div>{BODY}</div><div>The end.</div><footer>{BODY}</footer></body>") == f"{BODY} The end."
    assert html.main_text("<body><nav><a href=x>one</a></nav><p>Short.</p><footer>foot</footer>") == "Short."
    assert html.main_text(f"<ul><li class=ad>{BODY}<li>{BODY}</ul>") == BODY


def test_html_hostile_pages_take_linear_time():
    import time

    began = time.time()
    for page in ('<a href="x' * 100_000, "<a b='" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<" * 200_000, "<!--" * 100_000, "<script" * 50_000, "</" * 100_000, "<p a= " * 100_000, "&#" * 100_000):
        html.main_text(page)
    assert time.time() - began < 10


def plain_article(page):
    """The article's text by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    r = Reader()
    r.feed(page)
    return " ".join(x for x in (" ".join(b.split()) for b in r.blocks) if x)


def test_html_pages_equal_a_plain_reader(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.text for r in html.extracted(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id] == plain_article(r.html)


def test_html_in_frames(spark):
    one = f"<article><p>{BODY}</p></article>"
    pages = spark.createDataFrame([(1, one, "x", "own"), (1, one, "x", "own"), (2, None, "y", None)], "page_id long, html string, n_chars string, text string")
    got = sorted((r.page_id, r.n_chars, r.text) for r in html.extracted(pages).collect())
    assert got == [(1, "x", BODY), (1, "x", BODY), (2, "y", "")]
    assert html.extracted(pages.where("false")).count() == 0


# --- page shapes ---

_FIRST = "The than of the article text that goes on with the words and to the end of it, as it was in the long one that is for this."
_SECOND = "Another paragraph of the prose that is in the page and that we want to keep, with the stop words of the language and more of it."
_OTHER = "This is the long prose of a block that is not a part of the article but has all of the words that the language has, and it is long."
_KEPT = f"Title of it {_FIRST} {_SECOND}"


def shaped(inner="", after="", before=""):
    return f"<html><head><title>x</title></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>{before}<article><h1>Title of it</h1><p>{_FIRST}</p>{inner}<p>{_SECOND}</p></article>{after}<footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize("name", "reader-comments article-comments fb-comments blog-sidebar primary-nav google-ad cookie-law-info newsletter-cta sidebar commentList".split())
def test_html_names_set_parts_aside(name):
    for body in (f"<p>{_OTHER}</p>", "<p>Short one.</p>", f"<ul><li>{_OTHER}</li></ul>"):
        part = f'<div class="{name}">{body}</div>'
        assert html.main_text(shaped(part)) == html.main_text(shaped("", part)) == html.main_text(shaped("", "", part.replace("class", "id"))) == _KEPT


def test_html_looser_names_are_evidence_only():
    between = f"Title of it {_FIRST} {_OTHER} {_SECOND}"
    assert html.main_text(shaped(f'<div class="login"><p>{_OTHER}</p></div>')) == html.main_text(shaped(f'<div class="no-sidebar"><p>{_OTHER}</p></div>')) == between
    assert html.main_text(f'<body><article><div class="login"><p>{_OTHER}</p></div></article></body>') == _OTHER
    body = f"<h1>Title of it</h1><p>{_FIRST}</p><p>{_SECOND}</p>"
    assert html.main_text(f'<body class="comments-open"><div class="page sidebar-right"><article>{body}</article></div></body>') == _KEPT
    assert html.main_text(f'<body><div class="main-nav-wrapper">{body}</div><div class="sidebar"><p>Some short.</p></div></body>') == _KEPT


def test_html_list_items_of_links_stay_in_articles():
    items = "<ul><li><a href=1>Chapter one</a></li><li><a href=2>Chapter two</a></li></ul>"
    assert html.main_text(shaped(items)) == f"Title of it {_FIRST} Chapter one Chapter two {_SECOND}"
    assert html.main_text(shaped("", items)) == html.main_text(shaped(f'<div class="share">{items}</div>')) == _KEPT
    times = "<ul><li>Opening of it 12:30</li><li>Closing of it 18:00</li></ul>"
    assert html.main_text(shaped(times)) == f"Title of it {_FIRST} Opening of it 12:30 Closing of it 18:00 {_SECOND}"


def test_html_threads_are_found_without_names():
    items = [
        ["<ol>", *(f"<li><b>{n}</b> <time>2020</time><cite>{n}</cite><p>{_OTHER}</p></li>" for n in ("Ann", "Bob", "Cid")), "</ol>"],
        [f'<div class="x"><span class="author">{n}</span><span class="date">May</span><p>{_OTHER}</p></div>' for n in ("Ann", "Bob")],
        ["<section>", *(f"<div><div>{n}, 3 days ago</div><div>{_OTHER}</div></div>" for n in ("Ann Smith", "Bob", "Cid")), "</section>"],
        [f"<article><address>{n}</address><time>x</time><p>{_OTHER}</p></article>" for n in "ab"],
    ]
    for thread in map("".join, items[:3]):
        assert html.main_text(shaped("", f"<h3>Two answers</h3>{thread}")) == html.main_text(shaped(thread)) == _KEPT
    assert html.main_text(shaped("".join(items[3]))) == html.main_text(shaped("", f'<article class="comment"><p>{_OTHER}</p></article>')) == _KEPT
