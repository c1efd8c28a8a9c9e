"""The block classifier on held-out pages and on the pages' defined cases."""

import html
import re

import pytest

from folioforge.llm.html_text import FEATURES, classify, extract_text, labelled_blocks, main_text, train
from folioforge.llm.queries_html import op10_html_text

TREE = train(*labelled_blocks())


def features_of(tree):
    return set() if isinstance(tree, int) else {FEATURES[tree[0]]} | features_of(tree[2]) | features_of(tree[3])


def test_tree_uses_words_links_and_neighbours():
    used = features_of(TREE)
    assert {"words", "links"} & used and {"words_before", "links_before", "words_after", "links_after"} & used


FILLER = "This sentence of the story goes on for a good while, with commas and clauses, so that nobody takes it for a menu entry. "
#: Pages in other styles than the labelled ones: (page, its main text).
HELD_OUT = [
    ('<article><header class="entry-header"><h1>Great title</h1></header><p>Body text here.</p></article>', "Great title\nBody text here."),
    (f'<article><p>{FILLER}</p><p class="related-work">Related work.</p><div class="social-history">Social history of it.</div></article>', f"{FILLER.strip()}\nRelated work.\nSocial history of it."),
    ("<html><body><p>Hello world.</p><p>Two short paragraphs.</p></body></html>", "Hello world.\nTwo short paragraphs."),
    (f"<main><h1>Story</h1><p>{FILLER}</p><h2>More stories</h2><ul><li><a href=1>Another story here</a><li><a href=2>And a third one</a></ul></main>", f"Story\n{FILLER.strip()}"),
    (f'<div id=top><a href=/>Home</a> <a href=/b>Blog</a></div><div class=post><h2>A post</h2><p>{FILLER * 2}</p><p>Fine.</p></div><div class="ad-slot">Buy this now, it is very good.</div>', f"A post\n{(FILLER * 2).strip()}\nFine."),
    (f'<div role="banner"><p>Daily News of the town</p></div><div role="main"><h1>Rain</h1><p>{FILLER}</p><div role="complementary"><p>{FILLER}</p></div><p>The end.</p></div><div role="contentinfo">About us</div>', f"Rain\n{FILLER.strip()}\nThe end."),
    (f'<article><h1>Recipe</h1><ul><li>Two eggs<li>Some flour</ul><p>{FILLER}</p><section id="comments"><p>{FILLER}</p></section><footer>Filed under food</footer></article>', f"Recipe\nTwo eggs\nSome flour\n{FILLER.strip()}"),
    (f'<nav class=menu><a href=/>x</a></nav><h1>Plain page</h1><p>{FILLER}</p><blockquote>Quoted.</blockquote><p>{FILLER}</p><footer>{FILLER}</footer>', f"Plain page\n{FILLER.strip()}\nQuoted.\n{FILLER.strip()}"),
    (f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a></td><td>{FILLER * 3}</td></tr></table>", (FILLER * 3).strip()),
    (f'<article><p>{FILLER}</p><p><a href="/paper">Read the paper</a></p><p>{FILLER}</p></article><div class="sidebar-left"><p>{FILLER}</p></div><p>{FILLER}</p>', f"{FILLER.strip()}\nRead the paper\n{FILLER.strip()}"),
]


@pytest.mark.parametrize("page, want", HELD_OUT)
def test_held_out_pages(page, want):
    assert main_text(page, TREE) == want


def test_held_out_accuracy():
    rows, labels = labelled_blocks(40, 99)
    assert sum(classify(TREE, r) == y for r, y in zip(rows, labels)) >= 0.98 * len(labels)


def test_parts_of_a_page():
    page = """<!DOCTYPE html><title>T</title><body class="with-sidebar"><header><a href=/>Home</a></header>
    <nav><ul><li><a href="/a>b">menu</a></ul></nav><!-- <p>no</p> --><div class='cookie-notice'>We use cookies and long words about them.</div>
    <article><h1>Head&amp;line</h1><p>One <b>two</b>
    three&nbsp;&eacute;<br>four<p>Short.<script>if (a < b) { "<p>x</p>" }</script><form><input><p>Sign up</form>
    <section class="comments"><p>First! a reader says a good many words in this comment here today</section></article>
    <aside>See also</aside><footer>&copy; 2024</footer>"""
    assert main_text(page, TREE) == "Head&line\nOne two three é four\nShort."


def test_defined_cases(spark):
    long = "<article>" + "<p>word &lt;b&gt;</p>" * 20_000 + "</article>"
    rows = [(0, "u", None), (1, None, ""), (2, "u", "<p"), (3, "u", long), (3, "u", long), (4, "u", "<article><p>x</p>"), (5, "u", "<nav>a</nav>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in extract_text(pages).collect())
    whole = "\n".join(["word <b>"] * 20_000)
    assert got == [(0, ""), (1, ""), (2, ""), (3, whole), (3, whole), (4, "x"), (5, "")]
    assert extract_text(pages.limit(0)).count() == 0


def test_query_against_the_article_element(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        want[r.page_id] = "\n".join(x for x in parts if x)
    got = {r.page_id: (r.text, r.n_chars) for r in op10_html_text(spark, sf).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}
