"""The main text of web pages: flat blocks of text, classified by a decision tree.

A page is cut into blocks at its block-level tags; scripts, styles, comments and other hidden parts
never make one. A block is described by its word count and link density, those of the blocks before
and after it, and what it stands in: whether an element around it is named as something other than
text (a tag such as `nav` or `footer`, or a word of its class, id or role such as `ad` or
`comments`), whether an `article` or `main` is around it, and whether it is a heading. The tree is
trained on `LABELLED`, a small table of blocks from layouts written down here. The text of a page
is its main blocks in page order.

Character references are decoded, white space inside a block becomes one space. A null or empty
page has no text; broken markup ends where its parent does. Nothing is capped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.llm.tables import read
from cinefold.llm.words import blocks

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "aside", "article", "heading")

# Elements whose content is never text of the page.
_SKIPPED = ("script", "style", "noscript", "template", "svg", "math", "iframe", "canvas", "object",
            "audio", "video", "title", "select", "textarea", "button")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<skip>{'|'.join(_SKIPPED)})\b[^>]*>.*?(?:</(?P=skip)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)"
    r"(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-z!?][^>]*(?:>|\Z)", re.IGNORECASE | re.DOTALL)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?<![\w-])hidden(?![\w-])"
                     r"|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt "
                    "ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ASIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset label".split())
_ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline "
    "comment comments comentarios consent contentinfo cookie cookies copyright disclaimer "
    "discussion footer form login masthead menu modal nav navbar navigation newsletter notice "
    "notices notification popup promo promoted promotion reactions related replies reply respond "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "tags toolbar topbar widget".split())
_TOP_NAMES = frozenset(("header", "head", "top"))
_ARTICLE_TAGS = frozenset(("article", "main"))


@dataclass
class Block:
    text: str
    start: int
    linked: int
    aside: bool
    article: bool
    heading: bool

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1


def cut(page: str) -> list[Block]:
    """The blocks of a page, in order."""
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    # Open elements: tag, whether it or one around it is aside or an article.
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    state = {"link": False, "heading": False, "start": 0}

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(t for t, _ in parts))).strip()
        if text:
            linked = sum(len(html.unescape(t).split()) for t, link in parts if link)
            _, aside, article = stack[-1]
            found.append(Block(text, state["start"], linked, aside, article, state["heading"]))
        parts.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            if not parts:
                state["start"] = at
            parts.append((page[at:m.start()], state["link"]))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            state["link"] = not m["end"] and "href" in m["attributes"].lower()
        names = m["attributes"] if not m["end"] else ""
        marked = bool(names) and ("=" in names or "hidden" in names)
        if tag in _INLINE and not marked and not any(t == tag for t, _, _ in stack[1:]):
            continue
        if m["end"]:
            place = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if tag not in _INLINE or place:
                if tag not in _INLINE or stack[place][1] != stack[place - 1][1]:
                    close()
                    state["link"] = False
                if place:
                    del stack[place:]
            if tag in _HEADINGS:
                state["heading"] = False
            continue
        if tag not in _INLINE:
            close()
            if tag in _VOID:
                continue
            # A paragraph or an item ends where the next block begins.
            if stack[-1][0] == "p" or tag == "li" == stack[-1][0]:
                stack.pop()
            state["heading"] = tag in _HEADINGS
        aside, article = stack[-1][1:]
        inside = article or tag in _ARTICLE_TAGS
        off = aside or tag in _ASIDE_TAGS or (tag == "header" and not article)
        if marked:
            words = {w for x in _NAMES.findall(names) for w in
                     re.split(r"[^a-z0-9]+", "".join(x).lower())}
            inside = inside or "main" in words or "article" in words
            off = off or bool(words & _ASIDE_NAMES) or bool(_HIDDEN.search(names)) or (
                not article and bool(words & _TOP_NAMES))
        if tag in _INLINE:
            if off == aside or tag in _VOID:
                continue
            close()
        if tag == "body":
            inside = off = False
        stack.append((tag, off, inside))
    if at < len(page):
        if not parts:
            state["start"] = at
        parts.append((page[at:], state["link"]))
    close()
    return found


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row of FEATURES for each block of each page."""
    rows = []
    for page in pages:
        own = [(b.words, min(1.0, b.linked / b.words)) for b in page]
        around = [(0, 0.0), *own, (0, 0.0)]
        rows += [(*around[i + 1], *around[i], *around[i + 2], b.aside, b.article, b.heading)
                 for i, b in enumerate(page)]
    return np.array(rows, float).reshape(-1, len(FEATURES))


@dataclass
class Tree:
    """A trained tree as arrays; a node without a feature (-1) is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    main: np.ndarray

    def predict(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return self.main[node]
            at = node[inner]
            low = rows[inner, self.feature[at]] <= self.threshold[at]
            node[inner] = np.where(low, self.left[at], self.right[at])


def train(spark: SparkSession, rows: np.ndarray, main: np.ndarray, depth: int = 6) -> Tree:
    """A tree for labelled blocks, trained by Spark ML."""
    table = spark.createDataFrame(
        [(x.tolist(), float(y)) for x, y in zip(rows, main)], "row array<double>, label double")
    table = table.select(array_to_vector("row").alias("features"), "label").coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(table)
    nodes: list[list] = []

    def walk(node) -> int:
        place = len(nodes)
        nodes.append([-1, 0.0, 0, 0, node.prediction() == 1.0])
        if node.subtreeDepth():
            nodes[place][:2] = node.split().featureIndex(), node.split().threshold()
            nodes[place][2], nodes[place][3] = walk(node.leftChild()), walk(node.rightChild())
        return place

    walk(model._java_obj.rootNode())
    feature, threshold, left, right, found = zip(*nodes)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right),
                np.array(found))


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Per row: page_id, url, text, n_chars, and how many blocks the page has and gave."""
    tree = tree or train(pages.sparkSession, *labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            cuts = [cut(x or "") for x in batch.column("html").to_pylist()]
            main = tree.predict(features(cuts)).tolist()
            texts, given, at = [], [], 0
            for page in cuts:
                kept = [b.text for b, ok in zip(page, main[at:at + len(page)]) if ok]
                texts.append(" ".join(kept))
                given.append(len(kept))
                at += len(page)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64()),
                 pa.array([len(x) for x in cuts], pa.int64()), pa.array(given, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"),
                        pages["url"].cast("string").alias("url"),
                        pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, "
                                "n_blocks bigint, n_main bigint")


def _say(n: int, seed: int = 0) -> str:
    words = "river stone under quiet morning letter seldom carries winter open field and the".split()
    return " ".join(words[(seed + i * i) % len(words)] for i in range(n)).capitalize() + "."


def _links(n: int, words: int = 1) -> str:
    return "".join(f'<li><a href="/{i}">{_say(words, i)}</a></li>' for i in range(n))


def _paragraphs(sizes: tuple[int, ...]) -> str:
    return "".join(f"<p>{_say(n, i)}</p>" for i, n in enumerate(sizes))


# The labelled layouts: parts of a page in order, true for main text.
LABELLED: tuple[tuple[tuple[bool, str], ...], ...] = (
    ((False, f"<nav><ul>{_links(6)}</ul></nav><div class='ad'>{_say(9)}</div><article>"),
     (True, f"<h1>{_say(7)}</h1>{_paragraphs((60, 4, 1, 35, 80, 2))}"),
     (False, f"</article><footer>&copy; {_say(8)}</footer>")),
    ((False, f"<header><a href='/'>{_say(3)}</a><p>{_say(12)}</p></header><main>"),
     (True, f"<h1>{_say(5)}</h1>{_paragraphs((3, 90, 40))}<h2>{_say(4)}</h2>{_paragraphs((55, 6))}"
            f"<ul><li>{_say(9)}</li><li>{_say(1)}</li><li>{_say(14)}</li></ul>"),
     (False, f"</main><aside><h3>{_say(2)}</h3><p>{_say(25)}</p><ul>{_links(4, 5)}</ul></aside>"
             f"<section class='comments'><h2>{_say(2)}</h2><p>{_say(30)}</p><p>{_say(45)}</p>"
             f"</section><footer><p>{_say(16)}</p><ul>{_links(3)}</ul></footer>")),
    ((False, f"<div id='menu'>{_links(5)}</div><div class='cookie-notice'><p>{_say(28)}</p></div>"
             f"<div class='content'>"),
     (True, f"<h1>{_say(6)}</h1>{_paragraphs((70, 52, 5, 38, 64))}"),
     (False, f"</div><div class='sidebar'><p>{_say(22)}</p></div><form><p>{_say(7)}</p>"
             f"<label>{_say(3)}</label></form><div class='footer'>{_say(11)}</div>")),
    ((False, f"<table><tr><td><a href='/a'>{_say(2)}</a> <a href='/b'>{_say(2)}</a></td></tr>"
             f"<tr><td><a href='/c'>{_say(4)}</a></td></tr></table>"),
     (True, f"<div><p>{_say(48)}</p><p>{_say(66)}</p><p>{_say(12)}</p><p>{_say(58)}</p></div>"),
     (False, f"<div><a href='/1'>{_say(6)}</a></div><div><a href='/2'>{_say(8)}</a></div>"
             f"<div>{_say(4)} <a href='/3'>{_say(5)}</a></div>")),
    ((False, f"<div><a href='/home'>{_say(1)}</a> | <a href='/news'>{_say(1)}</a></div>"),
     (True, f"<h1>{_say(8)}</h1><div>{_say(75)}</div><div>{_say(33)} <a href='/x'>{_say(2)}</a> "
            f"{_say(40)}</div><blockquote>{_say(20)}</blockquote><div>{_say(51)}</div>"),
     (False, f"<div>{_say(3)}</div><div><a href='/p'>{_say(3)}</a></div><div>{_say(5)}</div>")),
    ((False, f"<nav>{_links(4, 2)}</nav><article><div class='share'>{_say(3)}</div>"),
     (True, f"<header><h1>{_say(9)}</h1></header>{_paragraphs((2, 44))}"),
     (False, f"<div class='promo'>{_say(18)}</div><aside>{_say(40)}</aside>"),
     (True, f"{_paragraphs((57, 1, 29))}<pre>{_say(12)}</pre>"),
     (False, f"<div id='comments'><p>{_say(50)}</p><p>{_say(9)}</p></div>"
             f"<div class='newsletter'><p>{_say(15)}</p></div></article><footer>{_say(6)}</footer>")),
    ((False, f"<div class='banner'><p>{_say(20)}</p></div><article>"), (True, f"<p>{_say(3)}</p>"),
     (False, f"</article><footer>{_say(9)}</footer>")),
    ((True, f"<article><p>{_say(1)}</p></article>"),),
    ((True, f"<article><h1>{_say(4)}</h1>{_paragraphs((30, 2, 1))}</article>"),),
    ((True, f"<main><p>{_say(2)}</p><p>{_say(3)}</p></main>"),),
    *(((False, f"<nav><a href='/a'>{_say(1)}</a> <a href='/b'>{_say(n)}</a></nav><{tag}>"),
       (True, f"<h1>{_say(n)}</h1>{_paragraphs((n + 2, 1, 20 * n))}"),
       (False, f"</{tag}><aside>{_say(8)}</aside><footer>{_say(n)}</footer>"))
      for n in (1, 2, 4) for tag in ("article", "main")),
    *(((False, f"<div><a href='/a'>{_say(n)}</a></div><div>{_say(n)}</div>"),
       (True, f"<div>{_say(45 + n)}</div><div>{_say(70)}</div>"),
       (False, f"<div>{_say(n)}</div><div><a href='/b'>{_say(2)}</a> {_say(1)}</div>"))
      for n in (1, 2, 3, 5)),
    ((False, f"<ul>{_links(5, 2)}</ul>"), (True, f"<div>{_say(62)}</div><div>{_say(37)}</div>")),
    ((False, "<article>"), (True, f"<h1>{_say(2)}</h1><p>{_say(5)} <a href='/y'>{_say(9)}</a></p>"
                                  f"<p><a href='/z'>{_say(6)}</a></p>"),
     (False, f"</article><div class='related'>{_links(3, 7)}</div><footer>{_say(30)}</footer>")),
)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table: features and labels of the blocks of `LABELLED`."""
    pages, main = [], []
    for parts in LABELLED:
        page = cut("<html><body>" + "".join(x for _, x in parts) + "</body></html>")
        edges = np.cumsum([len("<html><body>"), *(len(x) for _, x in parts)])
        main += [parts[int(np.searchsorted(edges, b.start, "right")) - 1][0] for b in page]
        pages.append(page)
    return features(pages), np.array(main)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
