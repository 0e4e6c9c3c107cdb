"""Operator 9, HTML extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

Each element of a page gets features of its subtree (text, link share, density), its attribute tokens
and those around it, its depth and its siblings. Trees boosted by Spark ML give the odds that it belongs
to the main text. Decoding is hierarchical: for every element the better of two labels is chosen bottom
up, drop the whole subtree or keep the element and decide on each child, weighted by text, so that nothing is kept
below a dropped ancestor.

The trees are fitted on TRAINING_PAGES pages at most, chosen by a hash of their ids. As pages carry no
labels these are made from pages with an <article> or <main>: its elements are main text, but for
sections that the standard's own elements (nav, aside, footer, form) or a few plain names set apart.
Each such page is used as it is and in variants, whose labels come from how they are put together, not
from names: the main text in an element of a usual, an invented or no name, or straight in the body, with
menus, notices, side bars, adverts, forms and reader comments, of usual or invented names, around and
inside it. A table without such pages is learned from made-up pages in the same variants.

Defined cases: null and empty pages give an empty text; text outside any element belongs to the page's
root; repeated rows are pages of their own; an empty table gives an empty result; other columns are not
read. Broken markup is read leniently: end tags without a start are skipped, what is open at the end is closed.
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import table

TRAINING_PAGES = 150
TREES, DEPTH = 30, 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|svg|iframe|textarea|title|select|button"
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
#: Tokens of tags, classes, ids and roles that speak against or for main text.
AGAINST = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer foot aside sidebar side rail widget widgets ad ads advert adverts"
    " advertisement advertising sponsor sponsored promo promotion promoted popup modal overlay cookie cookies consent gdpr notice notices alert comment comments"
    " comentarios disqus reply replies respond discussion form search login signup subscribe newsletter share sharing social related recommended recommendations"
    " popular trending tags tagcloud meta pagination pager skip toolbar copyright legal contentinfo complementary dialog button input".split()
)
FOR = frozenset("article main content post entry story body text page articlebody maincontent blogpost hentry prose".split())

#: Names that set a section inside the main text apart, for labels.
APART = frozenset("nav aside footer form ad ads advert advertisement sponsored comments sidebar cookie newsletter".split())

#: Attributes with balanced quotes, else whatever comes before the next >.
_ATTRIBUTES = r"""(?:(?:[^>"'=]|=\s*"[^"]*"(?=[\s/>])|=\s*'[^']*'(?=[\s/>])|=(?!\s*["']))*(?=>)|[^>]*)"""
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Page:
    """The elements of a page in page order, and its pieces of text with the element that holds each."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.tokens = ["#root"], [-1], [()]
        self.pieces: list[tuple[int, str, bool]] = []  # element, text, whether a block starts here
        stack, at, fresh = [0], 0, True
        for m in _TAG.finditer(source):
            if m.start() > at:
                self.pieces.append((stack[-1], html_lib.unescape(source[at : m.start()]), fresh))
                fresh = False
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if name not in INLINE:
                fresh = True
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if name in VOID:
                continue
            if name in CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == "p":
                        del stack[k:]
                        break
                    if self.tags[stack[k]] not in INLINE:
                        break
            if name in SELF_CLOSING:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == name:
                        del stack[k:]
                        break
                    if self.tags[stack[k]] in SELF_CLOSING[name]:
                        break
            self.tags.append(name)
            self.parents.append(stack[-1])
            found = _ATTRIBUTE.findall(m[4]) if m[4] else ()
            self.tokens.append(tuple(t.lower() for value in found for t in _TOKEN.findall(value)))
            if not m[4].endswith("/"):
                stack.append(len(self.tags) - 1)
        if at < len(source):
            self.pieces.append((stack[-1], html_lib.unescape(source[at:]), fresh))

    def features(self) -> np.ndarray:
        n = len(self.tags)
        parent = self.parents
        own, links, marks, blocks = [0] * n, [0] * n, [0] * n, [0] * n
        begin, total = [0] * n, 0
        seen = [False] * n
        in_link = [False] * n
        for v in range(1, n):
            in_link[v] = self.tags[v] == "a" or in_link[parent[v]]
        for v, text, _ in self.pieces:
            size = len(text.strip())
            if size:
                own[v] += size
                links[v] += size if in_link[v] else 0
                marks[v] += len(_PUNCTUATION.findall(text))
                blocks[v] += 1
                if not seen[v]:
                    begin[v], seen[v] = total, True
                total += size
        chars, tags = own[:], [1] * n
        against = [(self.tags[v] in AGAINST) + sum(t in AGAINST for t in self.tokens[v]) for v in range(n)]
        pro = [(self.tags[v] in FOR) + sum(t in FOR for t in self.tokens[v]) for v in range(n)]
        below = against[:]
        children: list[int] = [0] * n
        same: dict[tuple[int, str], int] = {}
        alike: dict[tuple, int] = {}
        place = [0] * n
        for v in range(1, n):
            p = parent[v]
            place[v] = children[p]
            children[p] += 1
            same[p, self.tags[v]] = same.get((p, self.tags[v]), 0) + 1
            if self.tokens[v]:
                alike[p, self.tags[v], self.tokens[v]] = alike.get((p, self.tags[v], self.tokens[v]), 0) + 1
        for v in range(n - 1, 0, -1):
            p = parent[v]
            for a in (chars, links, marks, blocks, tags, below):
                a[p] += a[v]
            if seen[v] and (not seen[p] or begin[v] < begin[p]):
                begin[p], seen[p] = begin[v], True
        depth, above_against, above_for = [0] * n, [0] * n, [0] * n
        # elements of one name in a row, as reader comments are
        row, above_row, rows_below = [0] * n, [0] * n, [0] * n
        for v in range(1, n):
            p = parent[v]
            depth[v], above_against[v], above_for[v] = depth[p] + 1, above_against[p] + against[p], above_for[p] + pro[p]
            row[v] = alike.get((p, self.tags[v], self.tokens[v]), 0)
            above_row[v] = max(above_row[p], row[v])
            rows_below[p] = max(rows_below[p], row[v])
        out = np.zeros((n, FEATURES))
        total = max(total, 1)
        for v in range(n):
            p = max(parent[v], 0)
            siblings = max(children[p], 1)
            size = chars[v]
            out[v] = (
                against[v], pro[v], above_against[v], above_for[v], depth[v], size, links[v] / (size or 1), size / tags[v], size / total, place[v] / siblings,
                siblings, same.get((p, self.tags[v]), 1) / siblings, own[v], marks[v] / (size or 1), size / (blocks[v] or 1), (below[v] - against[v]) / tags[v],
                begin[v] / total, size * siblings / (chars[p] or 1), self.tags[v] in INLINE, above_row[v], rows_below[v], bool(self.tokens[v]),
            )
        return out

    def decode(self, odds: np.ndarray) -> list[bool]:
        """keep for each element, never below a dropped one: the best labelling, bottom up."""
        n = len(self.tags)
        weight = [1.0] * n
        for v, text, _ in self.pieces:
            weight[v] += len(text.strip())
        p = np.clip(1 / (1 + np.exp(-2 * odds)), 1e-4, 1 - 1e-4)
        keep, drop = (np.log(p) * weight).tolist(), (np.log(1 - p) * weight).tolist()
        for v in range(n - 1, 0, -1):
            keep[self.parents[v]] += max(keep[v], drop[v])
            drop[self.parents[v]] += drop[v]
        out = [True] * n
        for v in range(1, n):
            out[v] = out[self.parents[v]] and keep[v] > drop[v]
        return out

    def text(self, keep: list[bool]) -> str:
        parts: list[str] = []
        gap = True
        for v, text, fresh in self.pieces:
            gap = gap or fresh
            if keep[v]:
                parts.append(" " + text if gap else text)
                gap = False
            else:
                gap = True
        return " ".join("".join(parts).split())


FEATURES = 22


class Forest:
    """The fitted trees as arrays, evaluated for many rows at once."""

    def __init__(self, trees: list[tuple], weights: list[float]) -> None:
        self.trees, self.weights = trees, weights

    @classmethod
    def of(cls, model) -> "Forest":
        trees = []
        for tree in model.trees:
            feature, threshold, left, right, value = [], [], [], [], []

            def walk(node) -> int:
                me = len(feature)
                for x in (feature, threshold, left, right):
                    x.append(0)
                value.append(node.prediction())
                if node.subtreeDepth():
                    feature[me], threshold[me] = node.split().featureIndex(), node.split().threshold()
                    left[me], right[me] = walk(node.leftChild()), walk(node.rightChild())
                return me

            walk(tree._call_java("rootNode"))
            trees.append(tuple(map(np.array, (feature, threshold, left, right, value))))
        return cls(trees, list(model.treeWeights))

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                down = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
                at = np.where(left[at] > 0, down, at)
            out += weight * value[at]
        return out


#: Names that carry the labels of a variant; they are taken off before features are computed.
MAIN, FURNITURE = "zzmain", "zzfurniture"


def labels(page: Page, marked: bool) -> np.ndarray:
    """1 for elements of the main text: by the marks of a variant, else those in <article> or <main>."""
    out = np.zeros(len(page.tags), np.int64)
    inside, apart = [False] * len(page.tags), [False] * len(page.tags)
    for v in range(1, len(page.tags)):
        p, tokens = page.parents[v], page.tokens[v]
        inside[v] = inside[p] or (MAIN in tokens if marked else page.tags[v] in ("article", "main"))
        apart[v] = apart[p] or FURNITURE in tokens or page.tags[v] in APART or not APART.isdisjoint(tokens)
        out[v] = inside[v] and not apart[v]
        if marked:
            page.tokens[v] = tuple(t for t in tokens if t not in (MAIN, FURNITURE))
    return out


_MAIN_TEXT = re.compile(r"<(article|main)\b[^>]*>(.*)</\1\s*>", re.S | re.I)


def variants(source: str, seed: int) -> Iterator[tuple[str, bool]]:
    """(page, whether it is marked): the page as it is, then its main text in other layouts."""
    found = _MAIN_TEXT.search(source)
    if not found:
        return
    yield source, False
    rng = random.Random(seed)
    words = re.sub(r"<[^>]*>", " ", source).split()[:400] or ["text"]
    inner = found[2]

    def some(a: int, b: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))

    def content() -> str:
        """The main text, or a short one made of its words."""
        return inner if rng.random() < 0.5 else "".join(f"<p>{some(8, 60)}.</p>" for _ in range(rng.randint(1, 6)))

    def invented() -> str:
        return "-".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))) for _ in range(rng.randint(1, 2)))

    def box(tags: list[str], names: list[str], content: str, strange: bool) -> str:
        tag, name = ("div", invented()) if strange else (rng.choice(tags), rng.choice(names))
        return f'<{tag} {rng.choice(["class", "id"])}="{name}" itemprop="{FURNITURE}">{content}</{tag}>'

    def links(n: int) -> str:
        items = [f'<a href="/x">{some(1, 4)}</a>' for _ in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if rng.random() < 0.7 else " ".join(items)

    def remarks(strange: bool) -> str:
        one = invented() if strange else rng.choice(["comment", "reply", "comment-body"])
        who = rng.choice(["span", "b", "cite", "strong"])
        return "".join(f'<div class="{one}"><{who}>{some(1, 2)}</{who}><p>{some(5, 60)}</p></div>' for _ in range(rng.randint(1, 5)))

    def furniture(strange: bool) -> tuple[str, str, str]:
        before = [
            box(["header", "div"], ["header", "masthead", "site-header"], f"<p>{some(2, 8)}</p>" + links(rng.randint(0, 4)), strange),
            box(["nav", "div"], ["menu", "navbar", "main-navigation", "breadcrumbs"], links(rng.randint(2, 9)), strange),
            box(["div", "section"], ["cookie-notice", "notice", "alert", "consent"], f"<p>{some(5, 40)}</p>", False),
            box(["div"], ["ad", "advert", "sponsored"], some(4, 40), False),
        ]
        after = [
            box(["aside", "div"], ["sidebar", "related", "widget", "popular"], f"<h3>{some(1, 4)}</h3>" + links(rng.randint(2, 6)) + f"<p>{some(5, 50)}</p>", False),
            box(["section", "div"], ["comments", "comment-list", "discussion"], f"<h2>{some(1, 2)}</h2>" * rng.randint(0, 1) + remarks(strange), strange),
            box(["form", "div"], ["search", "newsletter", "subscribe", "login-form"], f"<label>{some(1, 4)}</label><p>{some(2, 25)}</p>", False),
            box(["footer", "div"], ["footer", "site-footer", "copyright"], f"<p>&copy; {some(3, 40)}</p>" + links(rng.randint(0, 5)), False),
        ]
        inside = rng.choice(
            [
                "",
                box(["div"], ["ad", "advert", "sponsored"], f"<p>{some(4, 40)}</p>", False),
                box(["aside", "div"], ["share", "social", "related"], links(3), False),
                box(["section", "div"], ["comments", "comment-list"], remarks(strange), strange),
            ]
        )
        return tuple("".join(x for x in part if rng.random() < 0.75) for part in (before, [inside], after))

    head = f"<html><head><title>{some(2, 8)}</title></head>"
    named = rng.choice(["content", "post", "entry-content", "article-body", "story", "main", "post-content", "page-text"])
    for opening, closing, strange in (
        (f'<article itemprop="{MAIN}">', "</article>", False),
        (f'<main itemprop="{MAIN}"><div class="{invented()}">', "</div></main>", True),
        (f'<div class="{named}" itemprop="{MAIN}">', "</div>", False),
        (f'<div id="{invented()}" itemprop="{MAIN}">', "</div>", True),
        (f'<div itemprop="{MAIN}">', "</div>", rng.random() < 0.5),
    ):
        before, inside, after = furniture(strange)
        wrap = rng.choice([("", ""), ("<div>", "</div>"), (f'<div id="{invented()}">', "</div>")])
        yield f"{head}<body>{wrap[0]}{before}{opening}{content()}{inside}{closing}{after}{wrap[1]}</body></html>", True
    yield f'{head}<body itemprop="{MAIN}">{content()}</body></html>', True
    yield f'{head}<body><div itemprop="{MAIN}">{content()}</div></body></html>', True
    yield f'<div itemprop="{MAIN}">{content() if rng.random() < 0.5 else some(8, 200)}</div>', True


def made_up(seed: int) -> str:
    """A page with an article of invented words, for tables that have no page to learn from."""
    rng = random.Random(seed)

    def sentence() -> str:
        said = " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 20)))
        return said.capitalize() + "."

    paragraphs = "".join("<p>" + " ".join(sentence() for _ in range(rng.randint(1, 8))) + "</p>" for _ in range(rng.randint(1, 9)))
    return f"<html><body><article><h1>{sentence()}</h1>{paragraphs}</article></body></html>"


def fit(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> Forest | None:
    """The trees, fitted on at most training_pages pages and their variants; None for a table without a page."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    spark = pages.sparkSession
    # the bound on the hash comes first, so that no task sends more pages than are chosen
    hashed = pages.where("html IS NOT NULL").select("page_id", "html", F.xxhash64("page_id", "html").alias("_h"))
    bound = hashed.select("_h").orderBy("_h").limit(training_pages).agg(F.max("_h")).first()[0]
    sample = hashed.where(F.col("_h") <= bound).orderBy("_h").limit(training_pages).collect() if bound is not None else []
    if not sample:
        return None
    sources = [row["html"] for row in sample if _MAIN_TEXT.search(row["html"])] or [made_up(k) for k in range(60)]
    rows = []
    for k, base in enumerate(sources):
        for source, marked in variants(base, k):
            page = Page(source)
            truth = labels(page, marked)
            # an element weighs more the more text it holds, as in decoding
            rows += [(float(y), Vectors.dense(f), 1 + math.log1p(f[5])) for y, f in zip(truth[1:], page.features()[1:], strict=True)]
    frame = spark.createDataFrame(rows, ["label", "features", "weight"]).coalesce(2).persist()
    try:
        return Forest.of(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, maxBins=64, weightCol="weight").fit(frame))
    finally:
        frame.unpersist()


def extracted(pages: DataFrame, forest: Forest | None) -> DataFrame:
    """page_id, url, text, n_chars; one row per row of pages."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for i in range(0, len(batch), 256):
                read = [Page(x or "") for x in batch["html"].iloc[i : i + 256]]
                x = [page.features() for page in read]
                odds = forest.odds(np.concatenate(x)) if forest else np.zeros(sum(map(len, x)))
                cuts = np.cumsum([len(f) for f in x])[:-1]
                texts += [page.text(page.decode(o)) for page, o in zip(read, np.split(odds, cuts), strict=True)]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(extract, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, fit(pages))
