"""Main-text extraction by line-block distribution.

The page's markup is stripped so that every block element becomes one line. Lines in elements that are never
part of an article (menus, headers, footers, asides, forms, scripts, styles, notices, adverts, reader
comments, by tag, role or class and id words) become blank lines, and blank lines stand around articles. A class or id counts
if all of its words are words of furniture or of page structure ("related-links", not "related-work"), and never for an article or
main element itself. Every other line weighs by its length. Weights
are summed over sliding windows of lines: a surge point is a line whose window reaches a threshold, a dive point
one whose window weighs nothing. The text runs from a dive or the page's start to the next dive, wherever there
is a surge between, without lines at its ends that weigh nothing (links alone). Other lines are dropped, but for short ones (a closing line after a notice) that stand in
the element, or beside the element, of a line of the text: after it, or in an article.

Article and main elements are evidence, by the share of the page's text that they hold. The larger the share,
the more lines in them weigh, their link text included, and the less others do; so a teaser in an article beside
a long story loses to it. A page of short blocks alone has a lower threshold: half of its heaviest window.

Cases: null or empty html gives an empty text, and so does a page of furniture or links alone; unclosed and stray tags
are tolerated, and a tag that nothing closes is text; pages are scanned once, whole, in time linear in their length; repeated rows are extracted
alike; an empty table gives an empty result; other columns are carried through unchanged, but for those named
``text`` and ``n_chars``, which the result replaces.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from traceforge.llm.shared import worked

#: Lines in a window, and the weight that makes a surge.
WINDOW = 3
SURGE = 80
#: What a character weighs in an article that holds all of the page's text, and out of one that holds nearly none.
INSIDE, OUTSIDE = 3.0, 1.5

# Element names by role in a page, and class or id words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math canvas object".split())
FURNITURE = frozenset("nav header footer aside form button select menu dialog fieldset".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus "
    "footer header masthead menu menus modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion "
    "related replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
BESIDE = frozenset("has with no without".split())
STRUCTURE_WORDS = frozenset(
    "area articles aside bar block bottom box button buttons column container content float footer global group head header inner item items label left link links list main message module outer page "
    "panel post posts primary reader readers region right row rail secondary section site slot stories strip text title top unit user users wrap wrapper zone".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORDS = re.compile(r"[a-z]+")
TAG_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
TAG_END = re.compile(r"[>\"']")


def is_furniture(attributes: str, by_class: bool = True) -> bool:
    """Whether an element's attributes say that it is page furniture; ``by_class``: its class and id words count."""
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            for word in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split() if by_class else ():
                parts = WORDS.findall(word)
                # "with-sidebar" and the like say what stands beside an element
                if parts and parts[0] not in BESIDE and not FURNITURE_WORDS.isdisjoint(parts) and (FURNITURE_WORDS | STRUCTURE_WORDS).issuperset(parts):
                    return True
        elif name == "role" and value.lower() in FURNITURE_ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value) or name == "hidden":
            return True
    return "hidden" in attributes.lower() and "hidden" in ATTRIBUTE.sub(" ", attributes).lower().replace("/", " ").split()


def tokens(page: str) -> Iterator[tuple[str, str, str, int]]:
    """``(kind, name, content, end)`` of texts, tags (``<`` and ``/``) and marked data, in one scan; a position may be sent back to go on from.

    A quote inside a tag that nothing closes is an ordinary character, and so is every ``<`` that no ``>`` follows.
    """
    at, size, last = 0, len(page), page.rfind(">")
    quotes = {q: page.rfind(q) for q in "\"'"}
    text = 0  # where text that is not given out yet begins
    while (lt := page.find("<", at)) >= 0 and lt < last:
        name, end, kind = TAG_NAME.match(page, lt + 1), -1, ""
        if name:
            at = name.end()
            while (m := TAG_END.search(page, at)) and m[0] != ">":
                at = page.index(m[0], m.end()) + 1 if quotes[m[0]] > m.start() else m.end()
            if not m:
                break  # the rest holds no tag that ends
            end, kind = m.end(), name[1] or "<"
        elif page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            end = stop + 3 if stop >= 0 else size
        elif page.startswith("<![CDATA[", lt) and (stop := page.find("]]>", lt)) >= 0:
            end, kind = stop + 3, "["
        elif page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.index(">", lt) + 1
        else:
            at = lt + 1
            continue
        yield "", "", page[text:lt], lt
        at = text = end
        if kind == "[":
            yield kind, "", page[lt + 9 : end - 3], end
        elif kind:
            to = yield kind, name[2].lower(), page[name.end() : end - 1], end
            if to is not None:
                at = text = to
                yield "", "", "", to
    rest = page.find("<!--", text)
    yield "", "", page[text : rest if rest >= 0 else size], size


class Line(NamedTuple):
    """A block's text, how many of its characters are link text, whether it stands in an article, and the numbers
    of the block element around it and the one around that."""

    text: str = ""
    links: int = 0
    article: bool = False
    places: frozenset[int] = frozenset()


BLANK = Line()


def lines_of(page: str) -> list[Line]:
    """One line per block of the page, blanks for furniture."""
    lines: list[Line] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it starts furniture, whether it is an article
    open_tags: Counter[str] = Counter()
    blocks = [-1, 0]  # numbers of the open block elements, under two for the page itself
    off = inside = links = link_chars = opened = 0

    def flush() -> None:
        nonlocal link_chars
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            lines.append(Line(text, min(link_chars, len(text)), inside > 0, frozenset(blocks[-2:])))
        link_chars = 0

    def pop() -> None:
        nonlocal off, inside, links
        tag, starts, is_article = stack.pop()
        open_tags[tag] -= 1
        if tag not in INLINE:
            blocks.pop()
        if starts:
            off -= 1
            if not off:
                lines.extend([BLANK] * WINDOW)
        inside -= is_article
        if is_article and not inside:
            lines.extend([BLANK] * WINDOW)
        links -= tag == "a"

    def add(raw: str) -> None:
        nonlocal link_chars
        if raw and not off:
            text = html_lib.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            link_chars += len(text) if links else 0

    found, size = tokens(page), len(page)
    for kind, tag, content, at in found:
        if not kind:
            add(content)
            continue
        if kind == "[":
            add(html_lib.escape(content))
            continue
        closing = kind == "/"
        if tag not in INLINE:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if closing:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or content.rstrip().endswith("/"):
            continue
        if tag in CLOSES_P and any(t == "p" for t, _, _ in stack[-8:]):
            k = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p")
            if not any(t in ("article", "section", "div", "td", "li", "main", "aside", "body", "blockquote", "form", "nav") for t, _, _ in stack[k + 1 :]):
                while len(stack) > k:
                    pop()
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            pop()
        is_article = tag in ("article", "main")
        starts = tag in FURNITURE or tag not in ("html", "body", "main") and content.strip() != "" and is_furniture(content, not is_article)
        if starts and not off or is_article and not inside:
            flush()
            lines.extend([BLANK] * WINDOW)
        off += starts
        inside += is_article
        links += tag == "a"
        stack.append((tag, starts, is_article))
        open_tags[tag] += 1
        if tag not in INLINE:
            opened += 1
            blocks.append(opened)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            found.send(end.start() if end else size)
    flush()
    return lines


def weights(lines: list[Line]) -> tuple[np.ndarray, float]:
    """The weight of each line, and the threshold of a surge."""
    length, links = np.array([len(x.text) for x in lines], float), np.array([x.links for x in lines], float)
    article = np.array([x.article for x in lines])
    if not article.any():
        return length - links, min(SURGE, window_sums(length - links).max() / 2)
    held, other = length[article].sum(), (length - links)[~article].sum()
    share = held / (held + other)
    weight = np.where(article, INSIDE * share * length, OUTSIDE * (1 - share) * (length - links))
    return weight, min(SURGE, window_sums(weight).max() / 2)


def window_sums(weight: np.ndarray) -> np.ndarray:
    """For each line, the weight of the window that begins with it."""
    padded = np.r_[weight, np.zeros(WINDOW)]
    return sum(padded[k : k + len(weight)] for k in range(WINDOW))


def main_text(page: str | None) -> str:
    """The text between surge and dive points, blocks joined by a blank line."""
    lines = lines_of(page or "")
    if not lines:
        return ""
    weight, threshold = weights(lines)
    sums = window_sums(weight)
    dives = sums <= 0
    run = np.cumsum(np.r_[False, dives[1:] != dives[:-1]])  # stretches between dive points and of them
    text = np.isin(run, run[(sums >= threshold) & ~dives])
    # a stretch begins and ends with lines that weigh something
    heavy = np.flatnonzero(text & (weight > 0))
    k = np.searchsorted(heavy, np.arange(len(run)))
    before, after = np.r_[-1, heavy][k], np.r_[heavy, -1][k]
    text &= (weight > 0) | (before >= 0) & (after >= 0) & (run[before] == run) & (run[after] == run)
    places = frozenset().union(*(x.places for x, t in zip(lines, text) if t and x.text))
    after = np.cumsum(text) > 0
    near = [bool(x.text) and (w > 0) and (a or x.article) and not places.isdisjoint(x.places) for x, w, a in zip(lines, weight, after)]
    return "\n\n".join(x.text for x, t, n in zip(lines, text, near) if x.text and (t or n))


def extracted(df: DataFrame, html: str = "html") -> DataFrame:
    """``df`` without its html column, with ``text`` and ``n_chars`` (code points) added."""
    rest = df.select(*[c for c in df.columns if c not in ("text", "n_chars") or c == html])

    def work(pages: list) -> tuple[list, list]:
        texts = list(map(main_text, pages))
        return texts, list(map(len, texts))

    return worked(rest, [html], {"text": "string", "n_chars": "long"}, lambda: work)
