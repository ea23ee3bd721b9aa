"""Main text of web pages by a tree-structured graphical model.

Every block element of a page is a node that is main text or not. What a node shows (its name, the
words of its class, id and role, how much text and how many links it has) gives its own potential,
a linear model's log odds; a parent and its child share a potential that depends on what kind of
element the child is. Messages go up the tree and down again (sum-product, exact on a tree), and a
block whose marginal is one half or more is part of the text.

Both potentials are learned from labelled pages: pages of the table whose markup names the article,
and pages that this module composes of usual page parts, whose labels are known.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import linear
from cohortlens.llm.common import staged
from cohortlens.llm.dom import Node, Page, attributes, parse
from cohortlens.llm.linear import HashedLinear, hashed
from cohortlens.runtime import hash_first

#: Pages of the table that are learned from, at most: those with the smallest hash of their id.
MAX_TRAIN = 1_000
#: Composed labelled pages.
COMPOSED = 400

# Words in classes, ids and roles that mark what is not main text.
ASIDE_WORDS = frozenset((
    "ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice alert notification "
    "newsletter subscribe signup share sharing social related recommended comment comments commentlist disqus respond reply sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs pagination pager login masthead topbar toolbar header footer copyright disclaimer widget popup "
    "modal overlay search toc tags complementary contentinfo search dialog").split())
CONTAINERS = frozenset("article section div main td form fieldset details blockquote figure table tbody tr ul ol dl menu".split())
SECTIONS = frozenset("nav aside header footer form dialog address".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def tokens(node: Node) -> list[str]:
    """Words of a node's class, id and role."""
    if not node.attrs:
        return []
    attrs = attributes(node.attrs)
    return [t.lower() for key in ("class", "id", "role") for t in _TOKEN.findall(attrs.get(key, ""))]


def kind(node: Node) -> int:
    return 2 if node.tag in SECTIONS else 1 if node.tag in CONTAINERS else 0


def features(page: Page) -> list[list[int]]:
    """Hashed features of every node."""
    n = len(page.nodes)
    chars, links, stops = ([getattr(node, c) for node in page.nodes] for c in ("chars", "link_chars", "stops"))
    for i in range(n - 1, 0, -1):
        p = page.nodes[i].parent
        chars[p] += chars[i]
        links[p] += links[i]
        stops[p] += stops[i]
    out = []
    for i, node in enumerate(page.nodes):
        words = tokens(node)
        names = [f"tag {node.tag}", f"own {_step(node.chars)} {kind(node)}", f"all {_step(chars[i])}",
                 f"links {4 * links[i] // max(1, chars[i])} {kind(node)}", f"stops {min(stops[i], 3)}", *[f"word {w}" for w in words]]
        if any(w in ASIDE_WORDS for w in words):
            names.append("aside")
        if "hidden" in node.attrs or "display:none" in node.attrs.replace(" ", ""):
            names.append("hidden")
        out.append(sorted({_id(name) for name in names}))
    return out


_IDS: dict[str, int] = {}


def _id(name: str) -> int:
    found = _IDS.get(name)
    if found is None:
        if len(_IDS) > 100_000:
            _IDS.clear()
        found = _IDS[name] = hashed(name)
    return found


def _step(chars: int) -> int:
    """Length of a text in powers of four."""
    return (chars.bit_length() + 1) // 2


@dataclass
class TreeModel:
    """The linear model of a node alone, and ``log P(child, parent) / (P(child) P(parent))`` by kind
    of child, parent's and child's label."""

    nodes: HashedLinear
    pairs: list[list[list[float]]]

    def marginals(self, page: Page) -> list[float]:
        """Probability of every node to be main text, given the whole page."""
        n, nodes = len(page.nodes), page.nodes
        weights, bias, pairs = self.nodes.weights, self.nodes.bias, self.pairs
        no, yes = [0.0] * n, [0.0] * n
        for i, ids in enumerate(features(page)):
            yes[i] = -30.0 if nodes[i].dropped else bias + float(weights[ids].sum())
        up_no, up_yes = [0.0] * n, [0.0] * n
        for i in range(n - 1, 0, -1):  # from the leaves up: what each child tells its parent
            (a, b), (c, d) = pairs[kind(nodes[i])]
            up_no[i], up_yes[i] = _log_sum(no[i] + a, yes[i] + b), _log_sum(no[i] + c, yes[i] + d)
            p = nodes[i].parent
            no[p] += up_no[i]
            yes[p] += up_yes[i]
        for i in range(1, n):  # and down: what the parent knows from elsewhere
            (a, b), (c, d) = pairs[kind(nodes[i])]
            p = nodes[i].parent
            rest_no, rest_yes = no[p] - up_no[i], yes[p] - up_yes[i]
            no[i] += _log_sum(rest_no + a, rest_yes + c)
            yes[i] += _log_sum(rest_no + b, rest_yes + d)
        return [1 / (1 + math.exp(min(700.0, n - y))) for n, y in zip(no, yes)]

    def text(self, html: str | None) -> str:
        """The main text: blocks in page order, white space in a block made one space."""
        page = parse(html or "")
        if not page.runs:
            return ""
        p = self.marginals(page)
        return "\n\n".join(words for node, words in page.runs if p[node] >= 0.5)


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


# ------------------------------------------------------------------ labelled pages

def labels(page: Page) -> list[int] | None:
    """Labels of a page whose markup tells: those of composed pages, or else whether a node is in
    an article or main element and in nothing within it that is marked as something else. None if
    there is no such element."""
    out: list[int] = []
    told = False
    for node in page.nodes:
        above = out[node.parent] if node.parent >= 0 else 0
        mark = attributes(node.attrs).get("data-label") if "data-label" in node.attrs else None
        if mark is not None:
            label = int(mark)
        elif node.tag in ("article", "main") and not above:
            label = int(not any(w in ASIDE_WORDS for w in tokens(node)))
        elif node.dropped or node.tag in ("nav", "aside", "footer", "form", "dialog") or (node.tag != "header" and any(w in ASIDE_WORDS for w in tokens(node))):
            label = 0
        else:
            label = above
        told = told or label == 1
        out.append(label)
    return out if told else None


# Parts of pages, with @ for a few words, $ for sentences, % for a list of links.
_ARTICLES = [
    "<article {m}>{c}</article>", "<main {m}>{c}</main>", '<main {m} role="main"><article>{c}</article></main>', '<div {m} class="content">{c}</div>',
    '<div {m} id="main-content">{c}</div>', '<div {m} class="post-body entry-content">{c}</div>', '<section {m} class="article-text">{c}</section>',
    '<div {m} class="story">{c}</div>', '<div class="wrapper"><div {m} id="content">{c}</div></div>', '<div class="container"><article {m} class="post">{c}</article></div>',
    '<div id="page"><div class="row"><div {m} class="col main">{c}</div></div></div>', '<table><tr><td {m}>{c}</td></tr></table>', "<div {m}>{c}</div>",
]
_CONTENT = [
    "<p>$</p>", "<p>$</p>", "<p>$</p>", "<p>$</p>", "<p>@.</p>", "<h2>@</h2>", "<h3>@</h3>", "<ul><li>$</li><li>@</li></ul>", "<ol><li>@</li><li>$</li></ol>",
    "<blockquote><p>$</p></blockquote>", "<blockquote>$</blockquote>", "<pre>@</pre>", "<table><tr><th>@</th><td>@</td></tr><tr><td>@</td><td>$</td></tr></table>",
    "<figure><figcaption>@</figcaption></figure>", "<div>$</div>", "<div><p>$</p><p>$</p></div>", "<section><h2>@</h2><p>$</p></section>", "<p><b>@<br>$</p>",
    '<p>$ <a href="/x">@</a> $</p>', "<dl><dt>@</dt><dd>$</dd></dl>", '<p class="lead">$</p>', "<h4>@</h4>",
]
_ASIDES = [
    "<nav {m}>%</nav>", '<div {m} class="menu">%</div>', '<ul {m} class="navigation">%</ul>', '<header {m}>@ %</header>', '<header {m} class="site-header"><h1>@</h1><p>@</p></header>',
    "<footer {m}>@ %</footer>", "<footer {m}><p>$</p></footer>", '<div {m} id="footer"><p>$</p></div>', "<aside {m}><h3>@</h3><p>$</p></aside>", '<aside {m} class="sidebar">%</aside>',
    '<div {m} class="sidebar"><h4>@</h4><p>$</p>%</div>', '<div {m} class="ad">@</div>', '<div {m} class="advert"><p>$</p></div>', '<div {m} class="ads banner">$</div>',
    '<div {m} class="promo">@</div>', '<div {m} class="sponsored"><p>$</p></div>', '<section {m} class="advertisement"><h3>@</h3><p>$</p></section>', '<div {m} class="cookie-notice"><p>$</p></div>',
    '<div {m} id="cookie-banner">$</div>', '<div {m} class="gdpr consent"><p>$</p></div>', '<div {m} class="notice">$</div>', '<div {m} role="alert"><p>$</p></div>', '<p {m} class="notice">$</p>',
    '<div {m} class="newsletter"><p>$</p><form><label>@</label></form></div>', "<form {m}><label>@</label><p>@</p></form>", "<form {m}><p>$</p></form>", '<div {m} class="share">%</div>',
    '<div {m} class="social-share">@</div>', '<div {m} class="related"><h3>@</h3>%</div>', '<section {m} class="recommended"><h2>@</h2><p>$</p></section>',
    '<section {m} class="comments"><h2>@</h2><div class="comment"><p>$</p></div><div class="comment"><p>$</p><p>@</p></div></section>',
    '<div {m} id="comments"><p>$</p><p>$</p></div>', '<ol {m} class="comment-list"><li><p>$</p></li><li>$</li></ol>', '<div {m} class="comment"><b>@</b><p>$</p></div>',
    '<ul {m} class="comments"><li>$</li><li>$</li></ul>', '<div {m} class="user-comments"><article class="comment"><p>$</p></article></div>', '<div {m} class="breadcrumbs">%</div>',
    '<div {m} class="pagination">%</div>', '<div {m} class="login">@</div>', '<div {m} class="copyright">@</div>', '<div {m} class="disclaimer"><p>$</p></div>', '<div {m} class="widget"><h3>@</h3><p>$</p></div>',
    '<div {m} class="tags">%</div>', '<dialog {m} open><p>$</p></dialog>', '<div {m} class="popup modal"><p>$</p></div>', "<div {m}>%</div>", "<ul {m}>%</ul>", '<div {m} class="top-bar">@</div>',
]


def composed_pages(count: int = COMPOSED, seed: int = 4) -> list[str]:
    """Labelled pages put together at random: an article somewhere, other parts before, after and
    inside it; in one of six the article's blocks lie in the body itself."""
    rng = random.Random(seed)

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))

    def fill(part: str) -> str:
        def put(m: re.Match) -> str:
            if m[0] == "@":
                return words(rng.randrange(1, 9))
            if m[0] == "$":
                return " ".join(words(rng.randrange(3, 25)).capitalize() + "." for _ in range(rng.randrange(1, 6)))
            return "".join(f'<li><a href="/{words(1)}">{words(rng.randrange(1, 4))}</a></li>' for _ in range(rng.randrange(2, 8)))

        return re.sub(r"[@$%]", put, part)

    def other() -> str:
        return fill(rng.choice(_ASIDES).replace("{m}", 'data-label="0"'))

    pages = []
    for _ in range(count):
        blocks = [fill(rng.choice(_CONTENT)) for _ in range(rng.choice([1, 2, 4, 8, 15, 25]))]
        if rng.random() < 0.7:
            head = rng.choice(["<h1>@</h1>", "<header data-label=\"1\"><h1>@</h1></header>"])
            blocks.insert(0, fill(head))
        for _ in range(rng.choice([0, 0, 1, 2])):
            blocks.insert(rng.randrange(len(blocks) + 1), other())
        before, after = ("".join(other() for _ in range(rng.randrange(4))) for _ in range(2))
        inside = "".join(blocks)
        if rng.random() < 1 / 6:
            pages.append(f'<html><body data-label="1">{before}{inside}{after}</body></html>')
        else:
            whole = rng.choice(_ARTICLES).replace("{m}", 'data-label="1"').replace("{c}", inside)
            pages.append(f"<html><body>{before}{whole}{after}</body></html>")
    return pages


def training_rows(pages: DataFrame) -> DataFrame:
    """From ``html``: a row per node of the pages whose markup tells the labels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for html in pdf["html"]:
                page = parse(html or "")
                y = labels(page)
                if y is None:
                    continue
                for node, ids, own in zip(page.nodes, features(page), y):
                    rows.append((ids, None, float(own), 1.0, kind(node), y[node.parent] if node.parent >= 0 else None))
            yield pd.DataFrame(rows, columns=["ids", "signs", "y", "weight", "kind", "above"]).astype({"above": "Int32"})

    return pages.select("html").mapInPandas(run, "ids array<int>, signs array<float>, y double, weight double, kind int, above int")


def fit(spark: SparkSession, pages: DataFrame | None = None, max_train: int = MAX_TRAIN) -> TreeModel:
    """Learn from at most ``max_train`` rows of ``pages`` (``page_id, html``) and the composed pages."""
    known = spark.createDataFrame([(p,) for p in composed_pages()], "html string").repartition(4)
    if pages is not None:
        ids = pages.select(F.col("page_id").alias("id")).where("id IS NOT NULL").distinct()
        chosen = hash_first(ids, max_train, 4, ids.count())
        known = pages.select("page_id", "html").join(F.broadcast(chosen), F.col("page_id") == F.col("id"), "left_semi").select("html").unionByName(known)
    rows = staged(training_rows(known), "html-training")
    nodes = linear.fit(rows, l2=2.0)
    count = np.ones((3, 2, 2))  # none is impossible
    for r in rows.where("above IS NOT NULL").groupBy("kind", "above", "y").agg(F.count("*").alias("n")).collect():
        count[r.kind, r.above, int(r.y)] += r.n
    joint = count / count.sum(axis=(1, 2), keepdims=True)
    apart = joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True)
    return TreeModel(nodes, np.log(joint / apart).tolist())


def extract(pages: DataFrame, model: TreeModel) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; a null html is an empty page,
    which has the empty text. Other columns are ignored; repeated rows appear each."""

    @F.pandas_udf("string")
    def of(htmls: pd.Series) -> pd.Series:
        return pd.Series([model.text(h) for h in htmls], dtype=object)

    out = pages.select("page_id", "url", of("html").alias("text"))
    return out.select("*", F.length("text").cast("bigint").alias("n_chars"))


def main_texts(pages: DataFrame) -> DataFrame:
    """``extract`` with a model learned from ``pages`` and the composed pages."""
    return extract(pages, fit(pages.sparkSession, pages))
