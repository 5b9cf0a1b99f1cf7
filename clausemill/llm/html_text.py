"""Main text of web pages by line-block distribution.

Markup is stripped, and each block of text becomes a line. A line weighs the characters of its text outside links (inside an article
element, links outside of lists count too), and nothing in places that hold no article text: menus, headers, footers, sidebars, notices,
adverts, forms, comments, and all that is outside of the article elements if there are any with text. The weights of sliding windows of LINES
lines are summed; a surge point is the heavy line where the sum leaves zero, a dive point that where it falls back to zero. The text between
all surge and dive points is the main text. So lines of links alone stay where text is near before and after them, and go as a menu would
where LINES or more of them follow each other, or before the first and after the last text. No stretch is dropped for being short.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines summed in a window.
LINES = 3
LISTS = {"li", "dd", "dt", "td", "th", "menu"}

# HTML's element kinds.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "title", "textarea", "select", "object", "canvas", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_LIKE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "option": {"form"}}
ASIDE_TAGS = {"nav", "aside", "footer", "form", "dialog", "menu", "button", "label", "fieldset"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status"}
ASIDE_NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside cookie cookies consent gdpr notice notices alert popup modal overlay banner newsletter subscribe subscription signup login "
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion related recommended share sharing social comment comments commentlist disqus respond reply replies discussion reactions pagination pager widget copyright legal toolbar skip hidden".split()
)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Line:
    text: str
    plain: int  # characters outside links
    dropped: bool  # in a place without article text
    article: int  # number of the article or main element around it, 0 outside of any
    listed: bool


def is_aside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element's tag, role, class or id says that it holds no article text. An article's own header is kept."""
    if tag in ASIDE_TAGS or tag == "header" and not in_article:
        return True
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN_STYLE.search(value):
            return True
        if name == "role" and value.lower() in ASIDE_ROLES:
            return True
        if name in ("class", "id"):
            parts = [p.lower() for p in NAME_PARTS.findall(value)]
            # with-sidebar and the like say what is beside the element; an article's own header is part of it
            if any(p in ASIDE_NAMES and not (k and parts[k - 1] in ("with", "has", "no", "without")) and not (p == "header" and in_article) for k, p in enumerate(parts)):
                return True
    return False


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order."""
    out: list[Line] = []
    stack: list[tuple[str, bool, int]] = []  # open blocks: tag, whether text in it is dropped, article
    parts: list[str] = []
    unlinked: list[str] = []
    still: Counter[str] = Counter()  # open blocks by tag
    state = {"link": 0, "articles": 0}
    at = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            plain = len("".join(html.unescape("".join(unlinked)).split()))
            out.append(Line(text, plain, dropped, article, bool(stack) and stack[-1][0] in LISTS))
        unlinked.clear()

    def add(raw: str) -> None:
        if raw:
            parts.append(raw)
            if not state["link"]:
                unlinked.append(raw)

    def pop(tag: str, within: set[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                still.subtract(x[0] for x in stack[k:])
                del stack[k:]
                return
            if stack[k][0] in within:
                return

    while m := TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                state["link"] = 0
            elif tag == "p" or tag in BLOCKS or still[tag] > 0:
                flush()
                pop(tag, set())
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            parts.append(" ")
            continue
        if tag in ("br", "wbr") or tag in VOID and tag != "hr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag == "a":
            state["link"] = 1
            continue
        aside = is_aside(tag, m[3], bool(stack and stack[-1][2]))
        if tag not in BLOCKS and not aside:
            continue
        flush()
        if tag in BLOCKS:
            while stack and stack[-1][0] == "p":
                still[stack.pop()[0]] -= 1
        if tag in CLOSED_BY_LIKE:
            pop(tag, CLOSED_BY_LIKE[tag])
        if tag in VOID or m[3].endswith("/"):
            continue
        dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
        if tag in ("article", "main") and not article:
            state["articles"] += 1
            article = state["articles"]
        stack.append((tag, dropped or aside, article))
        still[tag] += 1
    add(page[at:])
    flush()
    return out


def stretches(weights: list[int]) -> list[tuple[int, int]]:
    """(from, to) of runs of lines between a surge and a dive point of the window sums; windows look ahead, so a run begins at a heavy line and ends after one."""
    before = [0, *itertools.accumulate(weights)]
    sums = [before[min(k + LINES, len(weights))] - before[k] for k in range(len(weights))]
    out, start = [], None
    for k, s in enumerate([*sums, 0]):
        if start is None and s > 0 and weights[k] > 0:
            start = k
        elif start is not None and s == 0:
            out.append((start, k))
            start = None
    return out


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by a line break; empty if there are none."""
    lines = lines_of(page or "")
    articles = any(x.article and x.plain and not x.dropped for x in lines)
    out = [x.dropped or articles and not x.article for x in lines]
    weights = [0 if o else x.plain or (len(x.text) if x.article and not x.listed else 0) for x, o in zip(lines, out, strict=True)]
    return "\n".join(lines[k].text for a, b in stretches(weights) for k in range(a, b) if not out[k])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages` (page_id, url, html).

    Null or empty html, and pages without text: empty text. Null ids and urls and repeated rows pass through. No rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
