"""Main-text extraction with a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of blocks: the text between block-level tags, with the tags and the class, id and role
words of its ancestors. Features of the markup and of the text feed a two-label chain (main text or not) that is
trained in numpy on labelled pages and decoded by Viterbi.

Pages carry no labels of their own. Labelled pages are made from those that mark their text by meaning: blocks inside
an article or main element, and outside navigation, headers and footers, asides, forms and boxes whose names say
they are adverts, notices, comments and the like, are main text; the rest isn't. On every other training
page the sectioning marks are hidden from the features, so that the chain also learns from text, position and
neighbours and works on pages without such marks. Training uses a bounded sample of `MAX_PAGES` pages in
expectation, chosen by a hash among those of at most `MAX_CHARS` characters, and the first `MAX_BLOCKS` blocks of each;
extraction covers every page whole.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAGES = 600
MAX_BLOCKS = 200
MAX_CHARS = 200_000
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style template noscript head title svg math iframe object canvas audio video map".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
             "strong sub sup time tt u var label br wbr img".split())
#: Elements that end an open element of the same group (paragraphs and list or table items need no end tag).
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
BOUND = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "main", "body", "nav", "aside", "header", "footer",
         "form", "blockquote", "td", "th"}
MAIN = {"article", "main"}
NOT_MAIN = {"nav", "header", "footer", "aside", "form", "menu", "button", "select", "textarea", "dialog", "fieldset"}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story"}
NOT_MAIN_WORDS = set("ad ads advert advertisement sponsor sponsored promo banner nav navbar navigation menu sidebar side widget "
                     "footer header masthead breadcrumb breadcrumbs cookie cookies consent notice alert popup modal comment comments "
                     "reply replies disqus share social related recommended newsletter subscribe signup login search form "
                     "copyright legal pager pagination toolbar".split())
#: Elements known by their name; others count as one.
ELEMENTS = VOID | HIDDEN | INLINE | set(
    "html body address article aside blockquote button caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu meter nav ol optgroup "
    "option output p picture pre progress search section select slot summary table tbody td textarea tfoot th thead tr ul".split())
OTHER = "other"
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


class Place:
    """What a block needs to know of its ancestors; elements share their parent's where they add nothing.

    path: number of the sequence of block-level tags; tags: those tags, each once; leaf, plain_leaf: the last one, and the last
    one that isn't a sectioning tag; good, bad: whether a name of an ancestor has a word of those lists.
    """
    __slots__ = ("path", "tags", "leaf", "plain_leaf", "good", "bad")

    def __init__(self, path: int = 0, tags: tuple[str, ...] = (), leaf: str = "-", plain_leaf: str = "-", good: bool = False,
                 bad: bool = False):
        self.path, self.tags, self.leaf, self.plain_leaf, self.good, self.bad = path, tags, leaf, plain_leaf, good, bad

    def inner(self, path: int, tag: str | None, names: set[str]) -> Place:
        """The place inside an element; `tag` is None for an inline one."""
        good, bad = self.good or not names.isdisjoint(MAIN_WORDS), self.bad or not names.isdisjoint(NOT_MAIN_WORDS)
        if tag is None and (good, bad) == (self.good, self.bad):
            return self
        tags, leaf, plain = self.tags, self.leaf, self.plain_leaf
        if tag is not None and tag not in ("html", "body"):
            tags = tags if tag in tags else (*tags, tag)
            leaf, plain = tag, plain if tag in MAIN or tag in NOT_MAIN else tag
        return Place(path, tags, leaf, plain, good, bad)


_TOP = Place()


class Block:
    __slots__ = ("text", "place", "linked")

    def __init__(self, text: str, place: Place, linked: float):
        self.text, self.place, self.linked = text, place, linked


class _Reader(HTMLParser):
    """Collects blocks in page order. Work and memory are linear in the page, however deep its elements nest."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, Place]] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # where in `open` the elements of a tag are
        self.solid: list[int] = []  # where those are that aren't inline
        self.paths: dict[tuple[int, str], int] = {}
        self.parts: list[str] = []
        self.linked = 0
        self.hidden = 0
        self.blocks: list[Block] = []

    def flush(self):
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                place = self.open[-1][1] if self.open else _TOP
                self.blocks.append(Block(text, place, min(1.0, self.linked / len(text))))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == "body":
            self._leave({"head"}, set())
        if tag in CLOSES:
            self._leave(CLOSES[tag], BOUND - CLOSES[tag])
        elif tag not in INLINE and tag not in HIDDEN:
            self._leave({"p"}, BOUND)
        names = {w for k, v in attrs if k in ("class", "id", "role") and v for w in _NAME.findall(v.lower())}
        place = self.open[-1][1] if self.open else _TOP
        if tag in INLINE:
            place = place.inner(place.path, None, names)
        else:
            path = self.paths.setdefault((place.path, tag), len(self.paths) + 1)
            place = place.inner(path, tag if tag in ELEMENTS else OTHER, names)
            self.solid.append(len(self.open))
        self.at[tag].append(len(self.open))
        self.open.append((tag, place))
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _last(self, tags: set[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def _leave(self, tags: set[str], bound: set[str]):
        """Close the innermost open element among `tags`, unless an element of `bound` is in between."""
        i = self._last(tags)
        if i > self._last(bound):
            self._cut(i)

    def _cut(self, i: int):
        for tag, _ in reversed(self.open[i:]):
            self.at[tag].pop()
            self.hidden -= tag in HIDDEN
        del self.open[i:]
        while self.solid and self.solid[-1] >= i:
            self.solid.pop()

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        i = self._last({tag})
        if i >= 0 and not (tag in INLINE and self.solid and self.solid[-1] > i):
            self._cut(i)

    def handle_data(self, data):
        if self.hidden:
            return
        self.parts.append(data)
        if self.at.get("a"):
            self.linked += len(data.strip())


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in order; broken markup is read as far as it goes, an unclosed last tag included."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    r.flush()
    return r.blocks


def label(page: list[Block]) -> list[int] | None:
    """Main text (1) or not (0) by the meaning of the markup; None for a page that doesn't mark its text."""
    inside = [not MAIN.isdisjoint(b.place.tags) for b in page]
    if not any(inside):
        return None
    return [int(i and NOT_MAIN.isdisjoint(b.place.tags) and not b.place.bad) for i, b in zip(inside, page)]


def _bucket(v: float, cuts: tuple[float, ...]) -> int:
    return sum(v >= c for c in cuts)


def features(page: list[Block], hide: bool = False) -> list[list[str]]:
    """Feature names of every block; `hide` leaves out the sectioning tags that labels are made from."""
    out = []
    n = len(page)
    seen = Counter(b.place.path for b in page)
    for i, b in enumerate(page):
        words = len(b.text.split())
        f = ["bias", f"words{_bucket(words, (3, 8, 15, 30, 60, 120))}", f"linked{_bucket(b.linked, (.01, .3, .7, .95))}",
             f"stops{_bucket(sum(b.text.count(c) for c in '.!?'), (1, 2, 4))}",
             f"at{_bucket(i / max(1, n - 1), (.05, .2, .8, .95))}", f"alike{_bucket(seen[b.place.path], (2, 4, 10))}"]
        if any(c in b.text for c in "©|·»"):
            f.append("mark")
        place = b.place
        f.append(f"leaf {place.plain_leaf if hide else place.leaf}")
        f += [f"in {t}" for t in place.tags if not (hide and (t in MAIN or t in NOT_MAIN))]
        f += ["named bad"] * place.bad + ["named good"] * place.good
        out.append(f)
    return out


class Chain:
    """Two-label linear chain: emission weights per feature, transition and start weights."""

    def __init__(self, names: list[str]):
        self.ids = {f: i for i, f in enumerate(names)}
        self.w = np.zeros((len(names), 2))
        self.t = np.zeros((2, 2))
        self.s = np.zeros(2)

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        ids, w = self.ids, self.w
        return np.array([w[[ids[f] for f in fs if f in ids]].sum(axis=0) for fs in feats]).reshape(-1, 2)

    def viterbi(self, e: np.ndarray) -> list[int]:
        """Best label sequence; ties go to label 0."""
        t = self.t.tolist()
        a, b = (self.s + e[0]).tolist()
        back = []
        for x, y in e[1:].tolist():
            to0 = (a + t[0][0], b + t[1][0])
            to1 = (a + t[0][1], b + t[1][1])
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            a, b = max(to0) + x, max(to1) + y
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.1, decay: float = 1e-3):
        """Maximise the conditional likelihood with Adam; forward and backward run over all pages side by side."""
        n, length = len(pages), max(len(y) for _, y in pages)
        on = np.zeros((n, length), bool)
        gold = np.zeros((n, length), int)
        row, feat = [], []
        for p, (fs, y) in enumerate(pages):
            on[p, :len(y)], gold[p, :len(y)] = True, y
            for i, f in enumerate(fs):
                ids = [self.ids[x] for x in f if x in self.ids]
                row += [p * length + i] * len(ids)
                feat += ids
        row, feat = np.array(row), np.array(feat)
        params = [self.w, self.t, self.s]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        both = on[:, 1:]
        total = on.sum()
        for step in range(1, rounds + 1):
            e = np.stack([np.bincount(row, self.w[feat, k], n * length) for k in (0, 1)], axis=1).reshape(n, length, 2)
            fw, bw = np.zeros((n, length, 2)), np.zeros((n, length, 2))
            fw[:, 0] = self.s + e[:, 0]
            for i in range(1, length):
                nxt = np.logaddexp(fw[:, i - 1, 0, None] + self.t[0], fw[:, i - 1, 1, None] + self.t[1]) + e[:, i]
                fw[:, i] = np.where(on[:, i, None], nxt, fw[:, i - 1])
            for i in range(length - 2, -1, -1):
                x = e[:, i + 1] + bw[:, i + 1]
                nxt = np.logaddexp(self.t[:, 0] + x[:, 0, None], self.t[:, 1] + x[:, 1, None])
                bw[:, i] = np.where(on[:, i + 1, None], nxt, 0)
            z = np.logaddexp(fw[:, -1, 0], fw[:, -1, 1])
            p = np.exp(fw + bw - z[:, None, None]) * on[..., None]
            pair = np.exp(fw[:, :-1, :, None] + self.t + (e + bw)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
            p[np.arange(n)[:, None], np.arange(length), gold] -= on
            seen = np.zeros((2, 2))
            np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            flat = p.reshape(-1, 2)
            gw = np.stack([np.bincount(feat, flat[row, k], len(self.w)) for k in (0, 1)], axis=1)
            for i, g in enumerate((gw, pair.sum((0, 1)) - seen, p[:, 0].sum(axis=0))):
                g = g / total + decay * params[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)

    def main_text(self, html: str | None) -> str:
        page = blocks(html)
        if not page:
            return ""
        keep = self.viterbi(self.scores(features(page)))
        return "\n\n".join(b.text for b, k in zip(page, keep) if k)


def fit(htmls: list[str]) -> Chain:
    """Train on the pages that can be labelled; without any, every block counts as main text."""
    pages = []
    for i, h in enumerate(htmls):
        page = blocks(h)[:MAX_BLOCKS]
        y = label(page) if page else None
        if y:
            pages.append((features(page, hide=i % 2 == 1), y))
    chain = Chain(sorted({f for fs, _ in pages for f in sum(fs, [])} | {"bias"}))
    if pages:
        chain.train(pages)
    else:
        chain.w[chain.ids["bias"], 1] = 1.0
    return chain


def train(pages: DataFrame, max_pages: int = MAX_PAGES) -> Chain:
    """Fit on a bounded sample of `pages(html, ...)`; rows are drawn by a hash of all their columns, so that very many
    copies of one page under different ids count no more than any other rows."""
    html = F.col("html").cast("string")
    known = pages.withColumn("_h", F.xxhash64(*pages.columns)).where(F.length(html) <= MAX_CHARS).select(
        "_h", html.alias("html"))
    share = min(1.0, max_pages / max(known.count(), 1))
    rows = known.where(F.pmod("_h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy("html", "_h").select("html")
    return fit([r.html for r in rows.toLocalIterator()])


def extract(pages: DataFrame, chain: Chain) -> DataFrame:
    """`pages` plus text (main text, blocks joined by an empty line) and n_chars (its code points).

    Null, empty and textless pages give an empty text. Columns of those names are replaced, others pass through.
    """
    @F.pandas_udf("string")
    def run(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in htmls:
            yield h.map(chain.main_text, na_action=None)

    return pages.withColumn("text", run(F.col("html").cast("string"))).withColumn("n_chars", F.length("text").cast("long"))
