import random
import re
import time

import pytest

from logsieve.llm import article
from logsieve.llm.article import Markup, Weights, best_region, extract_articles, fit_weights, main_text

PRIOR = Weights({})
SF = "/root/testdata/sf0.01"

CASES = {
    "marked": (
        "<html><head><title>T</title><style>p{x:1}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        "<article><header><h1>Head</h1><p>By Ann</p></header><p>One  two\n<b>three</b>four &amp; &eacute;&nbsp;x</p><div class='ad-box'><p>Buy now please</p></div>"
        "<p>Last<br>line</p><form><input><label>Mail</label></form></article><aside><p>Other things to read here</p></aside>"
        "<section id=comments><article><p>I do not agree with this at all</p></article></section><footer>&copy; us</footer></body></html>",
        "Head\nOne two threefour & é x\nLast line",
    ),
    "by class": (
        "<body><div class='top-menu'><a href=/a>A</a> <a href=/b>B</a></div><div id='cookie-notice'>We use cookies to make things better.</div>"
        "<div class='post-content'><h2>Title</h2><p>The first paragraph has some words.</p><ul><li>item one</li><li>item two</li></ul>"
        "<script>if (a < b) document.write('<p>no</p>')</script><p>The second one ends it.</p></div>"
        "<div class='comments'><p>A reader says a lot of words here, more than the article itself does, to be sure.</p></div>"
        "<div class=footer>All rights reserved</div></body>",
        "Title\nThe first paragraph has some words.\nitem one\nitem two\nThe second one ends it.",
    ),
    "plain": (
        "<body><ul><li><a href=/>Home</a><li><a href=/x>More of it</a></ul><p>Some words of the text that stand here.<p>And <i>more</i> words of it."
        "<ul><li><a href=/>Home</a><li><a href=/x>More of it</a></ul>",
        "Some words of the text that stand here.\nAnd more words of it.",
    ),
    "form around all": ("<form><main><p>Text of the page</p></main><input><label>Name</label></form>", "Text of the page"),
    "comment and quotes": (
        "<article title='a>b'><!-- <p>no</p> --><p title=\"it's > 1\">Yes 1 < 2 and <3</p><p>Don't</p></article>",
        "Yes 1 < 2 and <3\nDon't",
    ),
    "hidden": ("<main><p>Shown text</p><p hidden>not</p><div style='display: none'>nor this</div></main>", "Shown text"),
    "unclosed": ("<article><p><b>One.<br><p>Two &am", "One.\nTwo &am"),
    "no markup": ("just words", "just words"),
    "empty": ("", ""), "only tags": ("<div><br></div>", ""), "only a menu": ("<nav>a b c</nav>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    page, text = CASES[name]
    assert main_text(page, PRIOR) == text


def test_region_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-2, -1, -0.5, 0.25, 1, 2]) for _ in range(rng.randrange(1, 14))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        best = max(sums.values())
        low, high = best_region(scores)
        if best <= 0:
            assert (low, high) == (0, 0)
        else:
            assert sums[low, high] == best


def plain_text(page):
    """The article of the driver's pages, read with expressions that fit only these."""
    found = re.search(r"<article>(.*)</article>", page, re.S)[1]
    lines = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", found).replace("<br>", " "))
    return "\n".join(x for x in (" ".join(article.markup.unescape(line).split()) for line in lines) if x)


def test_weights_of_labelled_pages_find_unmarked_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    weights = fit_weights(pages.where("page_id % 2 = 0"))
    held_out = pages.where("page_id % 2 = 1")
    rows = held_out.collect()
    got = {r["page_id"]: r for r in extract_articles(held_out, weights).collect()}
    assert all(got[r["page_id"]]["text"] == plain_text(r["html"]) for r in rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    hidden = [re.sub(r"(</?)article>", r"\1div>", r["html"]) for r in rows]
    assert sum(main_text(h, weights) == plain_text(r["html"]) for h, r in zip(hidden, rows)) >= 0.95 * len(rows)
    # The weights matter: those a context starts with lose headings of unmarked pages.
    assert sum(main_text(h, PRIOR) == plain_text(r["html"]) for h, r in zip(hidden, rows)) < len(rows)


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>Some words</p>", "x"), (3, "u", "<p>Some words</p>", "x"), (3, "u", "<p>Some words</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_articles(pages, fit_weights(pages)).collect()
    assert sorted((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in got) == [
        ("1", "u", "", 0), ("2", None, "", 0), ("3", "u", "Some words", 10), ("3", "u", "Some words", 10), ("None", "u", "Some words", 10),
    ]
    assert extract_articles(pages.limit(0), fit_weights(pages.limit(0))).collect() == []


def test_long_and_broken_pages_take_linear_time():
    texts = ["<a href=\"" * 20_000, "<!--" * 50_000, "<" * 200_000, "<b>" * 50_000, "<div>" * 30_000 + "x" + "</div>" * 30_000,
             "<p>word " * 50_000, "</p>" * 50_000, "<script>" * 20_000, "&" * 100_000, "<a b='" * 20_000]
    for text in texts:
        started = time.time()
        main_text(text, PRIOR)
        Markup("<article>" + text)
        assert time.time() - started < 5, text[:20]
