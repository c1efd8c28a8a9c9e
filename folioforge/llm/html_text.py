"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks, the text between two block-level tags. Each block is described by its words and
link density, those of its neighbours before and after, its kind (heading, paragraph, other), where it is (in the
article or main element, outside of it, on a page that has none) and whether page furniture encloses it: an element
or role that is furniture by definition, or a class or id that is the name of one. A decision tree, trained on a
small labelled table of blocks (``PAGES``), keeps or drops each block.

Defined cases: a null or empty page has an empty text; unclosed tags, comments, scripts and attributes are
tolerated; pages of any length are read whole; equal blocks are judged by their neighbours each; repeated rows give
repeated results; a table without rows gives none; output columns replace input columns of the same name.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"""
    r"""|<(?P<raw>script|style|noscript|template|svg|iframe|object|math)\b(?>[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?>[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<[!?/a-z][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre"
    " section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu dialog select button textarea fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
PARAGRAPHS = frozenset("p blockquote pre dd figcaption".split())
#: Roles of page furniture, and whole class or id names of it. Fixed values.
FURNITURE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment-list comment-section commentlist comments cookie-banner"
    " cookie-notice cookies disqus_thread footer menu modal navbar navigation newsletter notice pagination pager popup promo related-articles"
    " related-links related-posts respond share share-buttons sharing sidebar signup site-banner site-footer site-header site-notice social-links"
    " social-share sponsored subscribe taboola toolbar widget".split()
)
AD_NAME = re.compile(r"(?:google[-_]?)?ads?[-_](?:box|slot|unit|container|wrapper|banner|block|label|\d+)|(?:sponsored|advert|cookie|newsletter|sidebar|comments)[-_][a-z0-9-_]+|[a-z0-9-_]+[-_](?:ads?|advert|sidebar|comments|newsletter)")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "kind", "place", "furniture", "named", "head")
OTHER, HEADING, PARAGRAPH = 0, 1, 2
OUTSIDE, UNKNOWN, INSIDE = 0, 1, 2


def is_named_furniture(names: str) -> bool:
    return any(x in FURNITURE_NAMES or AD_NAME.fullmatch(x) for x in names.lower().split())


def blocks(page: str) -> list[tuple[str, int, float, int, int, bool, bool, bool]]:
    """(text, words, link density, kind, place, in furniture, in named furniture, in head) of every block with text."""
    found = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, opens furniture, opens named furniture, opens main
    furniture = named = main = anchors = heading = paragraph = head = 0
    has_main = False
    parts: list[str] = []
    linked: list[str] = []

    def close() -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                n_linked = len("".join(linked).split())
                kind = HEADING if heading else PARAGRAPH if paragraph else OTHER
                found.append((" ".join(words), len(words), min(1.0, n_linked / len(words)), kind, INSIDE if main else OUTSIDE, furniture > 0, named > 0, head > 0))
            parts.clear()
            linked.clear()

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if anchors:
                linked.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCK:
            close()
        elif tag == "br":
            parts.append(" ")
            linked.append(" ")
        if tag in VOID:
            continue
        if not m["end"]:
            rest = m["rest"]
            if rest.endswith("/") and tag not in BLOCK and tag != "a":
                continue
            is_main, is_named = tag in MAIN, False
            is_furniture = tag in FURNITURE or tag == "header" and not main
            if "=" in rest and tag not in ("html", "body", "article", "main"):
                for attribute, x, y, z in NAMED.findall(rest):
                    value = (x or y or z).lower()
                    if attribute.lower() == "role":
                        is_main |= value in ("main", "article")
                        is_furniture |= value in FURNITURE_ROLES
                    else:
                        is_named |= is_named_furniture(value)
            if tag == "p":  # a paragraph ends where the next begins
                while stack and stack[-1][0] == "p":
                    stack.pop()
                    paragraph -= 1
            stack.append((tag, is_furniture, is_named, is_main))
            furniture += is_furniture
            named += is_named
            main += is_main
            has_main |= is_main
            anchors += tag == "a"
            heading += tag in HEADINGS
            paragraph += tag in PARAGRAPHS
            head += tag in ("head", "title")
        elif any(x[0] == tag for x in stack):
            while True:
                last, was_furniture, was_named, was_main = stack.pop()
                furniture -= was_furniture
                named -= was_named
                main -= was_main
                anchors -= last == "a"
                heading -= last in HEADINGS
                paragraph -= last in PARAGRAPHS
                head -= last in ("head", "title")
                if last == tag:
                    break
    close()
    return found if has_main else [(*b[:4], UNKNOWN, *b[5:]) for b in found]


def features(page_blocks: list[tuple]) -> list[tuple[float, ...]]:
    """A row of FEATURES for each block."""
    none = ("", 0, 0.0)
    padded = [none, *page_blocks, none]
    return [(*b[1:3], *before[1:3], *after[1:3], *b[3:]) for before, b, after in zip(padded, page_blocks, padded[2:])]


def train(rows: list[tuple[float, ...]], labels: list[int], depth: int = 12) -> tuple | int:
    """A decision tree as nested (feature, threshold, at or below, above) with labels as leaves; Gini impurity."""
    ones = sum(labels)
    if not depth or ones in (0, len(labels)):
        return int(2 * ones >= len(labels))
    best = None
    for f in range(len(rows[0])):
        ordered = sorted((r[f], y) for r, y in zip(rows, labels))
        left = left_ones = 0
        for (value, y), (following, _) in zip(ordered, ordered[1:]):
            left, left_ones = left + 1, left_ones + y
            if value == following:
                continue
            right, right_ones = len(ordered) - left, ones - left_ones
            impurity = left_ones * (left - left_ones) / left + right_ones * (right - right_ones) / right
            if best is None or impurity < best[0]:
                best = (impurity, f, (value + following) / 2)
    if best is None or best[0] >= ones * (len(labels) - ones) / len(labels):
        return int(2 * ones >= len(labels))
    _, f, at = best
    low = [i for i, r in enumerate(rows) if r[f] <= at]
    high = [i for i, r in enumerate(rows) if r[f] > at]
    return (f, at, train([rows[i] for i in low], [labels[i] for i in low], depth - 1), train([rows[i] for i in high], [labels[i] for i in high], depth - 1))


def classify(tree: tuple | int, row: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


#: The labelled pages: +n stands for n words of main text, -n for n words of anything else, n..m for a number between.
PAGES = (
    """<head><title>-3..12</title></head><header><a href=/>-1..3</a><p>-3..12</p></header><nav><ul><li><a>-1..3</a><li><a>-1..3</a><li><a>-1..3</a></ul></nav>
    <article><header class=entry-header><h1>+2..12</h1><p>+3..20</p></header><p>+20..90</p><p>+1..12</p><h2>+1..6</h2><p>+30..80</p><blockquote>+4..30</blockquote>
    <ul><li>+2..12<li>+2..20</ul><p>+1..4</p></article><aside><h3>-1..4</h3><p>-5..90</p></aside><footer>-3..40</footer>""",
    """<title>-3..12</title><main><h1><a>+3..9</a></h1><p>+15..90</p><p>+2..9 <a>+1..2</a> +2..9</p><div>+1..60</div><p>+1..3</p><h2>-1..4</h2>
    <ul><li><a>-3..10</a><li><a>-3..10</a><li><a>-3..10</a><li><a>-3..10</a></ul></main><footer><p>-2..60</p></footer>""",
    """<div><a>-1..2</a> <a>-1..2</a> <a>-1..2</a></div><div><h1>+3..9</h1><div>+40..120</div><p>+2..10</p><p>+30..80</p></div><div><a>-2..9</a></div><div><a>-3..9</a></div><div>-2..6</div>""",
    """<p>+3..14</p><p>+3..14</p>""",
    """<p>+1..9</p>""",
    """<article><h1>+2..9</h1><p>+9..60</p><div class=ad>-2..60</div><p>+2..20</p><form><p>-2..30</p></form><p>+1..9</p><section class=comments><h2>-1..3</h2><p>-5..90</p><p>-5..60</p></section></article>""",
    """<nav><a>-1..2</a> <a>-1..2</a></nav><h1>+2..9</h1><p>+1..10</p><p>+10..90</p><p>+1..5</p><h2>+1..5</h2><p>+10..90</p><aside><p>-10..90</p></aside><footer>-2..60</footer>""",
    """<div class=site-notice><p>-3..60</p></div><div class=ad>-3..60</div><article><p>+1..3</p></article><div>-3..90</div><p>-2..60</p>""",
    """<table><tr><td><a>-1..2</a><br><a>-1..2</a></td><td>+50..140</td><td><a>-2..9</a></td></tr></table>""",
    """<article><h1>+2..9</h1><p><a>+2..6</a></p><p>+20..90</p><h2>+1..9</h2><p>+2..20</p></article><h2>-1..9</h2><p>-9..60</p>""",
    """<h3>-1..4</h3><ul><li><a>-2..9</a><li><a>-2..9</a><li><a>-2..9</a></ul><h1>+3..9</h1><p>+15..90</p><h2>+1..5</h2><p>+5..60</p><div class=newsletter-box><p>-5..60</p></div><div id=comments><p>-9..90</p></div>""",
    """<ul><li><a>-1..3</a><li><a>-1..3</a></ul><div>+20..140</div>""",
    """<article><h2>+1..9</h2><div>+5..60</div><div>+1..20</div><ul><li>+1..9<li>+1..9 <a>+1</a></ul></article>""",
    """<article><p>+5..60</p><div>+1..60</div></article>""",
    """<div>+30..90</div><div>+30..90</div><ul><li>+9..30<li>+9..30</ul><div>+30..90</div>""",
    """<main><h1>+2..9</h1><p>+10..60</p><h3>-1..5</h3><div><a>-3..9</a></div><div><a>-3..9</a></div><div><a>-3..9</a></div></main>""",
)
LENGTH = re.compile(r"([+-])(\d+)(?:\.\.(\d+))?")
MARK = "†"


def labelled_blocks(copies: int = 12, seed: int = 7) -> tuple[list[tuple[float, ...]], list[int]]:
    """The labelled table: the blocks of the labelled pages, each page some times with other numbers of words."""
    pick = random.Random(seed)

    def words(m: re.Match) -> str:
        n = pick.randint(int(m[2]), int(m[3] or m[2]))
        return " ".join([("" if m[1] == "-" else MARK) + "word"] * n)

    rows, labels = [], []
    for page in PAGES * copies:
        of_page = blocks(LENGTH.sub(words, page))
        rows += features(of_page)
        labels += [int(MARK in b[0]) for b in of_page]
    return rows, labels


def main_text(page: str, tree: tuple | int) -> str:
    """The kept blocks in page order, a line feed between two."""
    of_page = blocks(page)
    return "\n".join(b[0] for b, row in zip(of_page, features(of_page)) if classify(tree, row))


def extract_text(pages: DataFrame, page: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in ``text``; a map without a shuffle."""
    tree = train(*labelled_blocks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = pa.array([main_text(p or "", tree) for p in batch.column(page).to_pylist()], pa.string())
                keep = [c for c in batch.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], [*keep, text])

    schema = T.StructType([*(f for f in pages.schema if f.name != text), T.StructField(text, T.StringType())])
    return pages.mapInArrow(run, schema)
