"""Main text of web pages: the contiguous region of greatest score.

A page is read as a sequence of text runs and tags. Every word scores between -1 and 1 and every tag
between -1 and 0, by weights for its context: where it stands (inside the marked article, outside of it,
inside a container whose name hints at content, or on a page without such marks), the kind of
surroundings that never belong to an article (menu, advert, form, …), the block element, and whether it
is a link. One pass finds the region with the greatest sum; surroundings of those kinds inside the region
are left out of its text.

Weights come from labelled pages: pages that mark their article themselves. Each is counted twice, as it
is and with its marks hidden, so that pages without marks are judged by what articles look like.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsieve.llm.batches import small_batches

#: Elements whose content is no markup, up to their end tag; none of it is text of the page.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stand for a kind of surroundings by their name.
KINDS = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form",
    "dialog": "notice", "head": "code", "template": "code", "svg": "code", "object": "code", "canvas": "code",
    "video": "code", "audio": "code", "button": "form", "select": "form", "option": "form", "label": "form",
    "fieldset": "form", "datalist": "form", "input": "form",
}
ROLES = {
    "navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "header", "contentinfo": "footer",
    "complementary": "sidebar", "search": "form", "form": "form", "dialog": "notice", "alertdialog": "notice", "alert": "notice",
}
#: Words of class names and ids, and the kind of surroundings they stand for.
HINTS = {
    word: kind
    for kind, words in {
        "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sitemap skip",
        "header": "masthead topbar toolbar",
        "footer": "footer copyright colophon legal imprint",
        "sidebar": "sidebar aside rail widget widgets related recommended recommendations trending teaser teasers",
        "advert": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner adsense dfp",
        "notice": "cookie cookies consent gdpr notice notices popup modal overlay alert newsletter subscribe signup paywall",
        "comment": "comment comments commentlist discussion disqus respond replies reply",
        "share": "share sharing social",
        "form": "form search searchbox login",
    }.items()
    for word in words.split()
}
GOOD = frozenset("article post entry story content main".split())
#: A class name with one of these words describes a layout, not its own content.
LAYOUT = frozenset("with has no without wrapper layout page site".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td tfoot th thead tr ul button template".split()
)
NOT_P = BLOCKS - {"p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An opening tag ends these elements if they are open inside the nearest of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"tr", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
}
NO_ARTICLE = frozenset(["sidebar", "footer", "comment", "code", "hidden"])

TAG = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|style|itemprop|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Whether an element marks the article, most trusted last.
PLAIN, HINTED, MAIN, ARTICLE = range(4)


class Markup:
    """Reads one page into text runs and tags, tolerating what browsers tolerate."""

    judged: dict[tuple[str, str], tuple[int, str]] = {}

    def __init__(self, html: str):
        self.html = html
        #: (is text, text or tag name, mark, kind, block element, block number, inside a link)
        self.tokens: list[tuple] = []
        #: (name, mark, kind, innermost block element) of every open element.
        self.open: list[tuple[str, int, str, str]] = [("", PLAIN, "", "")]
        self.count: Counter = Counter()
        self.block = 0
        self._read()

    def _read(self) -> None:
        html, at, end = self.html, 0, len(self.html)
        missing: set[str] = set()
        while at < end:
            start = html.find("<", at)
            if start < 0:
                start = end
            found = TAG.match(html, start)
            while start < end and found is None:
                start = html.find("<", start + 1)
                start = end if start < 0 else start
                found = TAG.match(html, start)
            if start > at:
                self._text(html[at:start])
            if found is None:
                break
            name = found[2]
            if name is None:
                close = "-->" if found[0] == "<!--" else ">"
                at = html.find(close, found.end())
                at = end if at < 0 else at + len(close)
                continue
            name, at = name.lower(), found.end()
            stop = STOP.search(html, at)
            while stop and stop[0] != ">":
                quote, place = stop[0], stop.start()
                after = -1
                if quote not in missing and html[max(0, place - 16) : place].rstrip().endswith("="):
                    after = html.find(quote, place + 1)
                    if after < 0:
                        missing.add(quote)
                stop = STOP.search(html, max(after, place) + 1)
            attributes = html[at : stop.start()] if stop else html[at:]
            at = stop.end() if stop else end
            if found[1]:
                self._close(name)
            elif name in RAW:
                raw = RAW_END[name].search(html, at)
                at = raw.start() if raw else end
            else:
                self._start(name, attributes)

    def _text(self, text: str) -> None:
        if "&" in text:
            text = markup.unescape(text)
        self._add(True, text)

    def _add(self, is_text: bool, value: str) -> None:
        _, mark, kind, block = self.open[-1]
        self.tokens.append((is_text, value, mark, kind, block, self.block, bool(self.count["a"])))

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.block += 1
            if self.count["p"]:
                self._end_open({"p"}, NOT_P)
            if name in ENDS:
                self._end_open(*ENDS[name])
        if name == "br":
            self._add(True, " ")
        mark, kind = self._judge(name, attributes)
        _, above, surroundings, block = self.open[-1]
        if mark >= MAIN and kind == "" and surroundings not in NO_ARTICLE:
            surroundings = ""
        if kind == "header" and above >= MAIN:
            kind = "heading"
        if surroundings == "heading" and name in HEADINGS:
            surroundings = ""
        self.open.append((name, max(mark, above), surroundings or kind, name if name in BLOCKS else block))
        self._add(False, name)
        if name in VOID:
            self.open.pop()
        else:
            self.count[name] += 1

    def _judge(self, name: str, attributes: str) -> tuple[int, str]:
        known = self.judged.get((name, attributes))
        if known is None:
            if len(self.judged) > 10_000:
                self.judged.clear()
            known = self.judged[name, attributes] = judge(name, attributes)
        return known

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self.block += 1
        if name in VOID or not self.count[name]:
            return
        barrier = frozenset() if name in BLOCKS else BLOCKS
        self._end_open({name}, barrier)

    def _end_open(self, names: set[str], barrier: frozenset[str]) -> None:
        """Closes the innermost open element of ``names``, unless one of ``barrier`` is open inside it."""
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth][0]
            if name in names:
                for gone, *_ in self.open[depth:]:
                    self.count[gone] -= 1
                self._add(False, "/" + name)
                del self.open[depth:]
                return
            if name in barrier:
                return


def judge(name: str, attributes: str) -> tuple[int, str]:
    """How far an element marks the article, and its kind of surroundings ('' for none)."""
    mark = {"article": ARTICLE, "main": MAIN}.get(name, PLAIN)
    kind = KINDS.get(name, "")
    if not attributes.strip() or name in ("html", "body"):
        return mark, kind
    names: list[str] = []
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value)):
            return PLAIN, "hidden"
        if key == "role":
            kind = kind or ROLES.get(value.lower(), "")
            mark = max(mark, {"article": ARTICLE, "main": MAIN}.get(value.lower(), PLAIN))
        elif key == "itemprop" and value.lower() == "articlebody":
            mark = ARTICLE
        elif key in ("class", "id"):
            names += value.split()
    for each in names:
        words = [w.lower() for w in WORDS.findall(each)]
        if not words or LAYOUT.intersection(words):
            continue
        kind = kind or HINTS.get(words[-1], "") or HINTS.get(words[0], "")
        if GOOD.intersection(words):
            mark = max(mark, HINTED)
    return (PLAIN if kind and mark == HINTED else mark), kind


#: Where a token stands.
PLACES = ("plain", "hinted", "outside", "article")


def places(tokens: list[tuple], hidden_marks: bool = False) -> list[str]:
    """The place of each token; only the most trusted mark that holds words counts."""
    level = max((t[2] for t in tokens if t[0] and not t[3] and t[1].strip()), default=PLAIN)
    if hidden_marks or level == PLAIN:
        return ["plain"] * len(tokens)
    if level == HINTED:
        return ["hinted" if t[2] == HINTED else "plain" for t in tokens]
    return ["article" if t[2] >= level else "outside" for t in tokens]


SHOWN = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 li dd dt td th div section figcaption body".split())
INLINE = frozenset("a b i em strong br span code u small sub sup img ul ol table tr".split())


def context(token: tuple, place: str) -> tuple[str, str, str, str]:
    is_text, value, _, kind, block, _, link = token
    if is_text:
        return "word", place, kind, (block if block in SHOWN else "other") + ("/a" if link else "")
    value = value.lstrip("/")
    return "tag", place, kind, value if value in SHOWN or value in INLINE else "other"


def before_labels(key: tuple[str, str, str, str]) -> tuple[float, float]:
    """Counts inside and outside of articles that a context starts with."""
    what, place, kind, where = key
    if place == "outside":
        return 1, 19
    if place == "article":
        return 19, 1
    if kind:
        return 1, 19
    if place == "hinted":
        return (8, 2) if "/a" not in where else (5, 5)
    if "/a" in where:
        return 2, 8
    usual = where in ("p", "pre", "blockquote", "b", "i", "em", "strong", "br") or where in HEADINGS
    return (7, 3) if usual else (5.5, 4.5) if what == "word" else (4, 6)


def n_words(token: tuple) -> int:
    return len(token[1].split()) if token[0] else 1


def labelled_counts(html: str) -> Counter:
    """Words and tags inside and outside of the marked article by context, with and without the marks.

    The article reaches from its first to its last word. Empty for a page that marks none.
    """
    tokens = Markup(html).tokens
    where = places(tokens)
    inside = [i for i, t in enumerate(tokens) if where[i] == "article" and t[0] and not t[3] and t[1].strip()]
    out: Counter = Counter()
    if not inside:
        return out
    low, high = inside[0], inside[-1]
    for view in (where, places(tokens, hidden_marks=True)):
        for i, token in enumerate(tokens):
            out[(*context(token, view[i]), low <= i <= high)] += n_words(token)
    return out


class Weights:
    """Scores of contexts from counts inside and outside of labelled articles."""

    def __init__(self, counts: dict[tuple, int]):
        self.counts = counts
        self.known: dict[tuple, float] = {}

    def of(self, key: tuple[str, str, str, str]) -> float:
        if key not in self.known:
            a, b = before_labels(key)
            a, b = a + self.counts.get((*key, True), 0), b + self.counts.get((*key, False), 0)
            self.known[key] = (2 * a / (a + b) - 1) if key[0] == "word" else -b / (a + b)
        return self.known[key]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the first, shortest run with the greatest positive sum; (0, 0) if none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(html: str, weights: Weights) -> str:
    """The text of a page's best region, a line for each block."""
    tokens = Markup(html).tokens
    where = places(tokens)
    low, high = best_region([weights.of(context(t, p)) * n_words(t) for t, p in zip(tokens, where)])
    blocks: dict[int, list[str]] = {}
    for is_text, value, _, kind, _, block, _ in tokens[low:high]:
        if is_text and not kind:
            blocks.setdefault(block, []).append(value)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def fit_weights(pages: DataFrame, sample: int = 2000) -> Weights:
    """Weights from labelled pages of ``pages`` (page_id, html): those with an article or main element.

    ``sample`` bounds the pages taken, those of least hash of page_id and then page; contexts are few,
    so what reaches the driver is bounded. Without labelled pages the weights are those contexts start with.
    """
    small_batches(pages.sparkSession)
    marked = pages.select("page_id", "html").where(F.lower("html").rlike("<(article|main)[\\s>]"))
    keys = marked.select(F.xxhash64("page_id").alias("_h"), F.xxhash64("html").alias("_t")).distinct().orderBy("_h", "_t").limit(sample)
    some = marked.join(F.broadcast(keys), (F.xxhash64("page_id") == F.col("_h")) & (F.xxhash64("html") == F.col("_t")), "left_semi")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for html in batch["html"]:
                total.update(labelled_counts(html))
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["what", "place", "kind", "element", "inside", "n"])

    counts = some.select("html").mapInPandas(count, "what string, place string, kind string, element string, inside boolean, n long")
    keys = ["what", "place", "kind", "element", "inside"]
    rows = counts.groupBy(*keys).agg(F.sum("n").alias("n")).collect()
    return Weights({tuple(r[k] for k in keys): r["n"] for r in rows})


def extract_articles(pages: DataFrame, weights: Weights) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html).

    Blocks are lines, white space inside a block is one blank, ``<br>`` counts as white space. A null or
    empty page and one without a region of positive score have empty text. Pages are taken whole and each
    on its own: no shuffle, repeated rows come back repeated, other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(html, weights) if html else "" for html in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].array, "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
