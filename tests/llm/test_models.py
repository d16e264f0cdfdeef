"""Trained operators: held-out accuracy, planted cases, defined odd cases."""

import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from spanqa.llm import html_crf, langid, toxicity
from spanqa.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_toxicity_query(spark):
    got = QUERIES["op10_toxicity"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r.toxic == r.predicted for r in rows) >= 0.88 * len(rows)
    assert got.where("score < 0 or score > 1 or (score >= 0.3) != (predicted = 1)").count() == 0


def test_toxicity_finds_the_sentence(spark, odd, none):
    rng = random.Random(2)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]

    def sentence(bad):
        w = rng.choices(plain, k=6)
        return " ".join(w[:3] + (["vilestuff"] if bad else []) + w[3:])
    rows, labels = [], []
    for i in range(400):
        bad = i % 3 == 0
        s = [sentence(False) for _ in range(4)] + ([sentence(True)] if bad else [])
        rng.shuffle(s)
        rows.append((i, ". ".join(s)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    for r in toxicity.score(docs, model).collect():
        assert (r.toxicity >= 0.3) == (r.doc_id % 3 == 0)
        hit = [r.text[o.start:o.end] for o in r.offending]
        assert all("vilestuff" in h for h in hit) and len(hit) == (r.doc_id % 3 == 0)
    out = toxicity.score(odd, model)
    assert out.count() == odd.count() and out.where("trim(text) = '' or text is null").where("toxicity != 0").count() == 0
    assert toxicity.score(none, model).collect() == []
    blank = toxicity.train(none.select("doc_id", "text"), lab.limit(0))
    assert toxicity.score(odd, blank).where("toxicity >= 0.3").count() == 0
    one = toxicity.train(docs, lab.where("toxic = 1"))
    assert toxicity.score(docs, one).where("toxicity < 0.3").count() == 0


def test_noisy_or():
    m = toxicity.Model({"bad": 0}, np.array([3.0]), -1.0)
    p, q = 1 / (1 + np.exp(1)), 1 / (1 + np.exp(-2))
    score, found = m.score("so bad. fine thing! ...")
    assert abs(score - (1 - (1 - p) * (1 - q))) < 1e-12 and [f[:2] for f in found] == [(0, 6)]


def test_language_query(spark, odd, none):
    got = QUERIES["op5_language_id"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert got.count() == docs.count()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert got.where("score < 0 or score > 1").count() == 0
    net = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), max_docs=200)
    out = langid.predict(odd, net)
    assert out.count() == odd.count()
    assert out.where("(text is null or trim(text) = '' or length(trim(text)) < 1) and (lang_pred != 'und' or lang_score != 0)").count() == 0
    assert langid.train(none) is None
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.predict(none, net).collect() == []
    digits = spark.createDataFrame([(1, "123 456 _ -"), (2, "12 a")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(digits, net).orderBy("doc_id").collect()] == [True, False]


def test_windows_cover_the_text():
    text = "Ünï " * 500
    x, size = langid.windows(text)
    assert bytes(x.ravel()[:size.sum()].tobytes()) == text.encode().translate(langid._LOWER) and size.max() == langid.WINDOW


PAGE = """<html><head><title>T &amp; U</title><script>var t="</p>";</script><style>p{}</style></head><body>
<header>Site</header><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><div class="ad">Buy now!</div>
<article><h1>T &amp; U</h1><p>First   para&nbsp;with <b>bold</b> text that goes on.<br>And on it goes, at length.
<p>Second para, R&#233;sum&eacute; words and more of them.</p><form><input> Send</form></article>
<aside>Also read</aside><div class="comments"><p>I like it</p></div><footer>&copy; me</footer>"""


def test_main_text(spark):
    got = QUERIES["op7_main_text"](spark, SF)
    rows = got.collect()
    src = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(src) and all(r.n_chars == len(r.text) for r in rows)
    true = {}
    for k, h in src.items():  # what lies in the article element, with this test's own reading of it
        page = html_crf.blocks(h[h.index("<article"):h.index("<footer")] if "<article" in h else "")
        true[k] = "\n\n".join(b.text for b in page)
    assert sum(true[r.page_id] == r.text for r in rows) >= 0.98 * len(rows)


def test_blocks_and_chain(spark):
    rng = random.Random(4)

    def page(sections):
        word = lambda n: " ".join(rng.choices("one two three four five six seven".split(), k=n))
        main = "".join(f"<p>{word(rng.randint(15, 60))}. {word(9)}.</p>" for _ in range(rng.randint(2, 6)))
        a, b, c = ("article", "nav", "footer") if sections else ("div", "div", "div")
        nav = "".join(f"<li><a href=/>{word(1)}</a></li>" for _ in range(6))
        return f"<body><{b}><ul>{nav}</ul></{b}><{a}><h1>{word(5)}</h1>{main}</{a}><{c}>&copy; {word(3)}</{c}></body>"
    chain = html_crf.fit([PAGE] + [page(True) for _ in range(80)])
    assert chain.main_text(PAGE) == (
        "T & U\n\nFirst para with bold text that goes on. And on it goes, at length.\n\n"
        "Second para, Résumé words and more of them.")
    good = 0
    for _ in range(30):
        h = page(False)
        good += chain.main_text(h).split("\n\n")[-1] == html_crf.blocks(h)[-2].text
    assert good >= 24  # pages without sections are read from text, links and places
    e = np.array([[0.0, 1.0], [2.0, 0.0], [0.0, 0.5]])
    best = max(((a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)), key=lambda y: chain.s[y[0]] + sum(
        e[i, y[i]] for i in range(3)) + chain.t[y[0], y[1]] + chain.t[y[1], y[2]])
    assert tuple(chain.viterbi(e)) == best


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (None, "u", "", "x"), (3, "u", "<p", "x"), (4, "u", "<p>a</i></div></p><li>b<li>c", "x"),
            (5, "u", "<article><p>" + "long text here. " * 40_000, "x"), (6, "u", "plain & text", "x"), (6, "u", "plain & text", "x"),
            (7, "u", "<div>" * 3000 + "deep", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_crf.extract(pages, html_crf.train(pages)).collect()
    assert len(out) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in out)
    assert [r.text for r in out if r.page_id == 1] == [""]
    assert html_crf.extract(pages.limit(0), html_crf.fit([])).collect() == []
    assert html_crf.fit([]).main_text("<p>all of it</p>") == "all of it"


def test_toxic_documents_held_out(spark):
    """Recall and precision of label 1 on rows that training never saw."""
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where(
        "held_out and toxic is not null").select("toxic", "predicted").collect()
    toxic, caught = sum(r.toxic for r in got), sum(r.toxic and r.predicted for r in got)
    assert caught >= 0.8 * toxic and caught >= 0.85 * sum(r.predicted for r in got) and toxic > 80


def best_by_all(chain, e):
    n = len(e)
    paths = [[k >> i & 1 for i in range(n)] for k in range(1 << n)]
    return max(chain.s[y[0]] + sum(e[i, v] for i, v in enumerate(y)) + sum(chain.t[a, b] for a, b in zip(y, y[1:])) for y in paths)


def total(chain, e, y):
    return chain.s[y[0]] + sum(e[i, v] for i, v in enumerate(y)) + sum(chain.t[a, b] for a, b in zip(y, y[1:]))


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(3)
    chain = html_crf.Chain(["a"])
    for _ in range(200):
        chain.t, chain.s, e = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=(rng.integers(1, 9), 2))
        assert abs(total(chain, e, chain.viterbi(e)) - best_by_all(chain, e)) < 1e-9


def test_chain_is_trained_to_the_optimum():
    """No small step improves the likelihood, which is summed over all labellings by hand."""
    rng = np.random.default_rng(5)
    names = ["a", "b", "c"]
    pages = []
    for _ in range(12):
        n = rng.integers(1, 6)
        fs = [[str(x) for x in rng.choice(names, size=rng.integers(1, 3), replace=False)] for _ in range(n)]
        pages.append((fs, [int("a" in f) if rng.random() < .8 else int(rng.integers(2)) for f in fs]))
    chain = html_crf.Chain(names)
    chain.train(pages, rounds=4000, rate=0.02, decay=0.05)
    blocks = sum(len(y) for _, y in pages)

    def loss():
        out = 0.0
        for fs, y in pages:
            e, n = chain.scores(fs), len(fs)
            z = [total(chain, e, [k >> i & 1 for i in range(n)]) for k in range(1 << n)]
            out += np.logaddexp.reduce(z) - total(chain, e, y)
        return out / blocks + 0.05 / 2 * sum((p * p).sum() for p in (chain.w, chain.t, chain.s))

    least = loss()
    for _ in range(60):
        kept = [p.copy() for p in (chain.w, chain.t, chain.s)]
        for p in (chain.w, chain.t, chain.s):
            p += rng.normal(size=p.shape) * 0.02
        assert loss() > least - 1e-7
        chain.w[:], chain.t[:], chain.s[:] = kept


def test_noisy_or_is_trained_to_the_optimum():
    rng = np.random.default_rng(6)
    bags, y = [], []
    for _ in range(60):
        bag = [sorted(set(rng.choice(4, size=rng.integers(1, 3)).tolist())) for _ in range(rng.integers(0, 4))]
        bags.append(bag)
        y.append(int(any(0 in s for s in bag)) if rng.random() < .85 else int(rng.integers(2)))
    plain = rng.integers(0, 3, size=60).astype(float)
    y = np.array([label if bag or more else 0 for label, bag, more in zip(y, bags, plain)])  # an empty text can't be toxic
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag])
    flat = [s for bag in bags for s in bag]
    sent, feat = np.array([i for i, s in enumerate(flat) for _ in s]), np.array([f for s in flat for f in s])
    m = toxicity.fit(list("abcd"), y, plain, doc, sent, feat, rounds=6000, rate=0.02, decay=0.01)
    w0 = np.array(m.weights)

    def loss(w, b):
        out = 0.0
        for bag, label, more in zip(bags, y, plain):
            clean = (1 - 1 / (1 + np.exp(-b))) ** more
            for s in bag:
                clean *= 1 - 1 / (1 + np.exp(-(b + sum(w[f] for f in s))))
            out -= np.log(max(1 - clean, 1e-300)) if label else np.log(clean)
        return out / len(y) + 0.01 / 2 * (w * w).sum()

    least = loss(w0, m.bias)
    for _ in range(60):
        assert loss(w0 + rng.normal(size=4) * 0.02, m.bias + rng.normal() * 0.02) > least - 1e-6


def test_deep_pages_are_linear():
    for pattern in ("<div>x", "<h1>x", "<a>x<p>y", "<own-tag>x"):
        start = time.time()
        assert len(html_crf.blocks(pattern * 100_000)) >= 100_000
        assert time.time() - start < 60
    deep = html_crf.blocks("<div>" * 50_000 + "x" + "</span></b>" * 50_000 + "y")
    assert [b.text for b in deep] == ["xy"]


def test_pages_without_marks(spark):
    """Blocks of pages whose sectioning elements, classes and ids are taken away, against the labels those gave: over 0.9."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").select("html").collect()]
    chain = html_crf.fit(pages[:150])
    hit = wrong = missed = 0
    for html in pages[150:]:
        page = html_crf.blocks(html)
        true = html_crf.label(page)
        bare = re.sub(r"<(/?)(article|main|nav|header|footer|aside|section)\b", r"<\1div", html)
        bare = html_crf.blocks(re.sub(r'\s(class|id|role)="[^"]*"', "", bare))
        if true and [b.text for b in bare] == [b.text for b in page]:
            got = chain.viterbi(chain.scores(html_crf.features(bare)))
            hit += sum(a and b for a, b in zip(true, got))
            wrong += sum(b and not a for a, b in zip(true, got))
            missed += sum(a and not b for a, b in zip(true, got))
    assert hit > 200 and 2 * hit / (2 * hit + wrong + missed) > 0.9
