"""Main text of HTML pages by line-block distribution.

1. Markup is stripped: the page becomes lines, one for each block of text. Scripts, styles, forms and other elements that
   never hold article text lose theirs, and lines of menus, footers, adverts, notices, sidebars and comments, known by
   element or by whole class, id and role names, go. Where the page has a main, or articles that hold most of the unmarked
   text, lines outside main and article elements go too. Where they leave no surge point (below), names that may be those
   of the text's own wrapper don't count, if a heading stands in it. Elements and names are a help: what they leave is laid out.
2. Lines are laid out container by container (the nearest div, section outside articles, or the like), so that no window
   spans two. Text that stands bare in a container whose text is mostly in paragraphs is laid out apart from these. A
   heading that ends its container is laid out with the line that follows it, an article without a container of its own
   with the line before it.
3. A line's length is its characters outside links. Sums over windows of WINDOW lines locate dive points, where a window is
   empty, and surge points, where one holds SURGE characters (on short pages SHARE of the page's fullest window). Text that
   surges is kept from its first line after the last dive point to the next one, in page order. On a page whose text is
   links alone every line stays.

Defined cases: null or empty html gives the empty text; unclosed elements end with their parent or the page; character
references are decoded once; very long pages are read whole, in one pass; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescore.llm import common

# Names of HTML elements.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "math", "canvas", "object", "select", "option", "button", "xmp", "noframes"}
RAW_ENDS = {"script", "style", "textarea", "title", "xmp", "iframe", "noframes"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "legend", "head",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html", "head"}
#: Whole class, id or role names of adverts, comments and links to other pages: these mark articles in them too.
MARKS_ALL = re.compile(
    r"(?:ads?|advert(?:s|isements?|ising)?|ads?[_-](?:banner|block|box|container|slot|unit|wrapper|label|\d+)|adsense|adsbygoogle|sponsor(?:s|ed)?|sponsored[_-](?:content|links?|posts?)|promo(?:s|ted|tions?)?|promo[_-](?:box|banner)|"
    r"comments?|commentlist|comments?[_-](?:list|body|form|area|section|respond|\d+)|respond|disqus|disqus_thread|repl(?:y|ies)|related|related[_-](?:posts?|articles?|links|stories)|recommend(?:ed|ations?)|recommended[_-](?:posts?|articles?|links|stories))",
    re.I,
)
#: Whole names of other boilerplate; a page's wrapper may have them, so articles in it are not marked.
MARKS = re.compile(
    r"(?:banner|sidebar|side-bar|cookies?|cookie-?(?:notice|banner|bar|consent|popup|message)|consent|notices?|alert|popup|modal|newsletter|subscribe|newsletter[_-](?:box|form|signup)|nav|navbar|navigation|menu|"
    r"(?:main|site|top|primary|secondary|footer)[_-](?:nav|navigation|menu)|breadcrumbs?|footer|(?:site|page)[_-]footer|share|sharing|social|(?:share|sharing|social)[_-](?:buttons?|links|icons|bar)|"
    r"login|signup|search|(?:login|signup|search)[_-](?:form|box|bar)|complementary|contentinfo|hidden)",
    re.I,
)
#: Elements whose id is judged; ids of headings, paragraphs and inline elements name places in a text.
IDS = {"div", "section", "header", "ul", "ol", "dl", "table", "td"}
#: Lines of a window; characters that one needs for a surge, but no more than a share of the page's fullest one.
WINDOW, SURGE, SHARE = 3, 140, 1 / 3
#: Elements that lines are laid out by, and those that are no such container within an article or main.
CONTAINERS, PARTS = {"div", "section", "header", "footer", "aside", "nav", "form", "dialog", "menu", "center", "fieldset", "details", "td"}, {"section", "header", "footer", "details", "td"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose own text is that of a paragraph, not bare.
PARAGRAPHS = HEADINGS | {"p", "li", "dt", "dd", "blockquote", "pre", "td", "th", "caption", "figcaption", "summary", "address", "article", "main"}
#: How far a mark reaches: not at all, down to an article or main, down to a main, to all that an element contains.
PLAIN, WRAPPER, CLOSED, HIDDEN = range(4)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def attributes_of(tag: str) -> dict[str, str]:
    """Attributes by lower-case name; of one that repeats, the first."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def mark_of(name: str, tag: str, inside: bool) -> int:
    """How far an element's attributes mark what it contains; inside: it stands in an article or main."""
    has = attributes_of(tag)
    if "hidden" in has or has.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", has.get("style", ""), re.I):
        return HIDDEN
    classes = has.get("class", "").split()
    names = classes + has.get("role", "").split()
    if name in IDS and not (inside and (name == "section" or "section" in classes)):
        names += has.get("id", "").split()
    if any(map(MARKS_ALL.fullmatch, names)):
        return CLOSED
    return WRAPPER if any(map(MARKS.fullmatch, names)) else PLAIN


def is_comment(tag: str) -> bool:
    has = attributes_of(tag)
    return any(x.lower() in ("comment", "comments", "comment-body") for x in (has.get("class", "") + " " + has.get("id", "")).split())


class Line(NamedTuple):
    text: str
    mark: int  # above PLAIN: boilerplate
    article: bool  # in an article element
    main: bool  # in a main element
    length: int  # characters outside links
    container: int  # number of the container, the page's being 0
    bare: bool  # in no paragraph
    heading: bool


class Open(NamedTuple):
    name: str
    mark: int
    article: bool
    main: bool
    container: int
    paragraph: bool  # the innermost block is one
    heading: bool


PAGE = Open("", PLAIN, False, False, 0, False, False)


def lines_of(page: str) -> list[Line]:
    """Each block of text, in page order."""
    lines: list[Line] = []
    open_: list[Open] = []
    held: Counter[str] = Counter()  # open elements by name; keeps pages with many unclosed elements linear
    parts: list[str] = []
    own: list[str] = []  # of these, text outside links
    links, muted, containers = 0, 0, 0

    def end_line() -> None:
        text = " ".join("".join(parts).split())
        if text:
            top = open_[-1] if open_ else PAGE
            length = len(" ".join("".join(own).split()))
            lines.append(Line(text, top.mark, top.article, top.main, length, top.container, not top.paragraph, top.heading))
        parts.clear()
        own.clear()

    def say(text: str) -> None:
        if text and not muted:
            text = html_lib.unescape(text)
            parts.append(text)
            if not links:
                own.append(text)

    def close(name: str) -> None:
        nonlocal links, muted
        if not held[name]:
            return
        if name in BLOCKS or any(x.name in BLOCKS for x in open_[_last(open_, name) :]):
            end_line()
        while open_:
            got = open_.pop().name
            held[got] -= 1
            links -= got == "a"
            muted -= got in RAW
            if got == name:
                break

    pos = 0
    while pos < len(page):
        m = _TOKEN.search(page, pos)
        if not m:
            say(page[pos:])
            break
        say(page[pos : m.start()])
        pos = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                parts.append("" if muted else m[0][9:].removesuffix("]]>"))
                own.append("" if links else parts[-1])
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" and not held["p"]:
                end_line()
            close(name)
            continue
        if name in BLOCKS:
            if name in CLOSES_P and held["p"] and not _shielded(open_, "p"):
                _drop_p(open_, end_line)
                held["p"] -= 1
            if name == "li" and held["li"] and not _shielded(open_, "li"):
                close("li")
            end_line()
        elif name == "br":
            parts.append("\n")
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        above = open_[-1] if open_ else PAGE
        article, main = above.article or name == "article", above.main or name == "main"
        inside = article or main
        container = above.container
        if name in CONTAINERS and not (inside and name in PARTS):
            containers += 1
            container = containers
        if name in ("html", "body"):
            mark = above.mark if held[name] else PLAIN
        elif name == "main":
            mark = above.mark if above.mark == HIDDEN else PLAIN
        elif name == "article":
            mark = CLOSED if is_comment(m[3]) else PLAIN
            mark = max(mark, above.mark) if above.mark >= CLOSED else mark
        else:
            element = CLOSED if name in BOILERPLATE and name != "form" else WRAPPER if name == "form" or name == "header" and not inside else PLAIN
            mark = max(above.mark, element, mark_of(name, m[3], inside) if m[3] else PLAIN)
        paragraph = name in PARAGRAPHS if name in BLOCKS and name not in ("ul", "ol", "dl", "table", "tr", "tbody", "thead", "tfoot") else above.paragraph
        open_.append(Open(name, mark, article, main, container, paragraph, name in HEADINGS or above.heading))
        held[name] += 1
        links += name == "a"
        muted += name in RAW
        if name in RAW_ENDS:
            end = re.compile(rf"</{name}\b", re.I).search(page, pos)
            pos = end.start() if end else len(page)
    end_line()
    return lines


def _last(open_: list[Open], name: str) -> int:
    return next(i for i in range(len(open_) - 1, -1, -1) if open_[i].name == name)


def _shielded(open_: list[Open], name: str) -> bool:
    """Whether a container stands between the innermost open element and the nearest one of that name."""
    for x in reversed(open_):
        if x.name == name:
            return False
        if x.name in ("table", "td", "th", "ul", "ol", "div", "section", "article", "main", "body", "blockquote"):
            return True
    return True


def _drop_p(open_: list[Open], end_line) -> None:
    """Ends an open paragraph; inline elements that stand open in it go on after it."""
    end_line()
    i = _last(open_, "p")
    del open_[i]


def layout(lines: list[Line]) -> list[list[int]]:
    """Places of lines, by container, bare text apart where paragraphs hold most of a container's."""
    home = [x.container for x in lines]
    joined: dict[int, int] = {}  # containers that articles stand in, and those that they go on from
    for i, x in enumerate(lines):
        if x.article:
            if i and not lines[i - 1].article and x.container < home[i - 1]:
                joined[x.container] = home[i - 1]
            home[i] = joined.get(x.container, x.container)
    last = {x.container: i for i, x in enumerate(lines)}
    for i in range(len(lines) - 2, -1, -1):
        if lines[i].heading and last[lines[i].container] == i:
            home[i] = home[i + 1]
    total, bare = Counter[int](), Counter[int]()
    for x, at in zip(lines, home, strict=True):
        total[at] += x.length
        bare[at] += x.length * x.bare
    laid: dict[tuple[int, bool], list[int]] = {}
    for i, (x, at) in enumerate(zip(lines, home, strict=True)):
        laid.setdefault((at, x.bare and 2 * bare[at] < total[at]), []).append(i)
    return list(laid.values())


def window_sums(lengths: list[int]) -> list[int]:
    """Of each line, the sum over the window that starts there."""
    return [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]


def between(lengths: list[int], surge: float) -> list[int]:
    """Places of the stretches between dive points that hold a surge point."""
    sums = window_sums(lengths)
    out: list[int] = []
    start, surged = None, False
    for i, length in enumerate(lengths):
        if start is None and length:
            start, surged = i, False
        if start is not None:
            surged = surged or sums[i] >= surge
            if i - start >= WINDOW and not sums[i - WINDOW + 1]:  # the window that ends here is empty
                out += range(start, i - WINDOW + 1) if surged else ()
                start = None
    return out + list(range(start, len(lengths)) if start is not None and surged else ())


def fullest_window(lines: list[Line]) -> int:
    return max((max(window_sums([lines[i].length for i in run])) for run in layout(lines)), default=0)


def main_text(page: str | None) -> str:
    every = lines_of(common.text_of(page))
    lines = [x for x in every if x.mark == PLAIN]
    in_main = any(x.main for x in lines)
    in_article = sum(len(x.text) for x in lines if x.article)
    if in_main or 2 * in_article > sum(len(x.text) for x in lines):
        lines = [x for x in lines if x.main or x.article]
    fullest = fullest_window(lines)
    if fullest < SURGE and not any(x.main or x.article for x in lines):
        wrapped = [x for x in every if x.mark <= WRAPPER]  # the names may be those of the text's own wrapper
        if any(x.heading and x.mark for x in wrapped) and (held := fullest_window(wrapped)) >= SURGE:
            lines, fullest = wrapped, held
    if not fullest:
        return "\n\n".join(x.text for x in lines)
    surge = min(SURGE, SHARE * fullest)
    kept = sorted(run[k] for run in layout(lines) for k in between([lines[i].length for i in run], surge))
    return "\n\n".join(lines[i].text for i in kept)


def extract(pages: DataFrame, html_col: str = "html", id_cols=("page_id", "url")) -> DataFrame:
    """The id columns, text and n_chars, one row per row of pages."""
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in id_cols)

    def work(batches):
        for batch in common.slices(batches, len(id_cols)):
            texts = [main_text(x) for x in batch.column(len(id_cols)).to_pylist()]
            arrays = [*batch.columns[: len(id_cols)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*id_cols, "text", "n_chars"])

    return pages.select(*id_cols, html_col).mapInArrow(work, f"{kinds}, text string, n_chars bigint")


def op5_html(pages: DataFrame) -> DataFrame:
    return extract(pages)
