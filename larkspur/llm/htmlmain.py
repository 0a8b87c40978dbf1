"""Main text of HTML pages by the distribution of text over line blocks.

Markup is stripped so that every block element leaves lines of its own; scripts,
styles, forms, comments and containers that are boilerplate leave nothing: menus,
headers, footers and asides by their element, others by the names they give
themselves.  Each remaining line counts with the length of its text without
links, lines mostly of links with nothing, and lengths are summed over sliding
windows.  Where the windows rise from nothing text surges if one of them reaches
``SURGE``, and it lasts until they have fallen to nothing again, the dive.  What
lies between surge and dive points is kept, in a marked article as on any page.

Markup only says where to look: lines outside a marked article count nothing, and
an article (or a page) too short for any surge is taken whole.  In an article a
name must be plainly that of an advert, of reader comments or of navigation to
drop its container; elsewhere a part of a name is enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from larkspur.llm.frames import small_batches

WINDOW = 3
#: Characters in a window from which text has surged.
SURGE = 80

# Attributes as browsers read them: a quote opens a value only after an equals sign.  A tag or comment that never
# ends reaches to the end of the page, so each character is visited a bounded number of times.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+(?:>|\Z)"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)({_REST})", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"?+|'([^']*+)'?+|([^\s>]*+)))?+""")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select", "xmp"}
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in _RAW}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
_MAIN = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Names of containers that are boilerplate anywhere.
_PLAINLY = {"ad", "ads", "adbox", "ad-banner", "ad-container", "ad-slot", "advert", "adverts", "advertisement", "adsbygoogle", "sponsored", "comments", "comment-list", "comment-section", "comments-section", "commentlist", "disqus_thread", "sidebar", "nav", "navbar", "menu", "breadcrumb", "breadcrumbs", "pagination", "newsletter-signup", "cookie-notice", "cookie-banner", "share-buttons", "social-share", "related-posts"}
#: Parts of names that make a container boilerplate outside articles.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adv|banner|promo\w*|sponsor\w*|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|header|masthead|footer|comments?|disqus|replies|respond|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|widget|toolbar|pagination|pager|copyright|disclaimer|legal)(?=$|[\s_-])",
    re.I,
)
#: Names that mark the article where no element does.
_STORY = {"article", "article-body", "article-content", "post", "post-content", "post-body", "entry", "entry-content", "story", "story-body", "content", "main-content", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search"}
_SPACE = re.compile(r"\s+")


class _Line:
    __slots__ = ("parts", "linked", "article", "story")

    def __init__(self, article: int, story: int):
        self.parts: list[str] = []
        self.linked = 0
        self.article, self.story = article, story


def _named(attributes: str) -> tuple[set[str], str]:
    """The names in class and id, and the role, in lower case."""
    names, role, low = set(), "", attributes.lower()
    if "class" in low or "id" in low or "role" in low:
        for key, *values in _ATTRIBUTE.findall(low):
            if key in ("class", "id"):
                names.update(unescape(values[0] or values[1] or values[2]).split())
            elif key == "role":
                role = (values[0] or values[1] or values[2]).strip()
    return names, role


def _lines(html: str, forms: bool = False) -> list[tuple[str, int, int]]:
    """(text, length without links, number of the article it stands in or 0) of every line outside boilerplate.

    Articles are the outermost article and main elements, or without any the
    outermost containers named as one.  ``forms``: forms are no boilerplate.
    """
    lines: list[_Line] = []
    stack: list[tuple[str, int, int, int]] = []  # open elements: name, and what skipping, article and story were before
    opened: dict[str, int] = {}
    skipping = article = story = articles = stories = links = headings = 0
    current = _Line(0, 0)
    at = 0

    def text(piece: str) -> None:
        if piece and not skipping:
            current.parts.append(piece)
            if links and not headings:
                current.linked += len(_SPACE.sub(" ", piece).strip())

    def flush() -> None:
        nonlocal current
        if current.parts:
            lines.append(current)
        current = _Line(article, story)

    def push(name: str) -> None:
        nonlocal links, headings
        stack.append((name, skipping, article, story))
        opened[name] = opened.get(name, 0) + 1
        links += name == "a"
        headings += name in _HEADINGS

    def pop() -> str:
        nonlocal skipping, article, story, links, headings
        name, skipping, article, story = stack.pop()
        opened[name] -= 1
        links -= name == "a"
        headings -= name in _HEADINGS
        return name

    while m := _TOKEN.search(html, at):
        text(html[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in _INLINE and name != "a":
                continue
            if name != "a":
                flush()
            if opened.get(name):
                while pop() != name:
                    pass
            if name != "a":
                flush()
            continue
        if name in _RAW:
            if not m[0].endswith("/>"):
                end = _ENDS[name].search(html, at)
                at = end.end() if end else len(html)
            flush()
            continue
        if name in _VOID:
            if name not in _INLINE:
                flush()
            continue
        if name == "a":
            if opened.get("a"):  # a link ends an open one
                while pop() != "a":
                    pass
            push("a")
            continue
        if name in _INLINE:
            continue
        names, role = _named(m[3])
        flush()
        if name == "p":  # a paragraph ends an open one
            while stack and stack[-1][0] in ("p", "a"):
                pop()
        push(name)
        if (name in _MAIN or role == "main") and not article and not names & _PLAINLY:
            articles += 1
            article, skipping = articles, 0  # an article in a form, or in a menu left open, is one all the same
        elif name in _BOILERPLATE and not (forms and name in ("form", "fieldset")) or name == "header" and not (article or story) or role in _ROLES or names & _PLAINLY and name not in ("html", "body"):
            skipping = 1
        elif not (article or story) and names and name not in ("html", "body"):
            if names & _STORY:
                stories += 1
                story = stories
            elif _NAMES.search(" ".join(names)):
                skipping = 1
        flush()
    text(html[at:])
    flush()
    marked = any(line.article for line in lines)
    out = []
    for line in lines:
        words = _SPACE.sub(" ", unescape("".join(line.parts))).strip()
        if words:
            out.append((words, 0 if 2 * line.linked > len(words) else len(words) - line.linked, line.article if marked else line.story))
    return out


def surges(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Stretches (from, to) between surge and dive points.

    A window sums the lengths of ``window`` lines from one on.  Text rises at the
    first line whose window is not empty and dives where windows have become
    empty; between, one window has to reach ``surge``.
    """
    n = len(lengths)
    total = [0]
    for x in lengths:
        total.append(total[-1] + x)
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    out, i = [], 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        dive = i
        while dive < n and sums[dive]:
            dive += 1
        if max(sums[i:dive]) >= surge:
            out.append((i, dive))
        i = dive
    return out


def main_text(html: str | None) -> str:
    """The main text's blocks, joined by line feeds; empty for null, empty or text-free pages."""
    lines = _lines(html or "") or _lines(html or "", forms=True)
    marked = any(a for _, _, a in lines)
    groups: list[list[tuple[str, int, int]]] = []
    for line in lines:
        if not marked:
            line = (line[0], line[1], 0)
        elif not line[2]:
            continue
        if not groups or groups[-1][0][2] != line[2]:
            groups.append([])
        groups[-1].append(line)
    kept: list[str] = []
    for group in groups:
        lengths = [size for _, size, _ in group]
        for a, b in surges(lengths):
            # Fewer lines of links than a window belong to the text around them in an article; elsewhere they are cut off its ends.
            reach = max(i for i in range(a, b) if lengths[i]) + 1
            while not lengths[a] and not (marked and a == 0):
                a += 1
            b = len(group) if marked and len(group) - reach < WINDOW else reach
            kept += [t for t, _, _ in group[a:b]]
    if not kept:
        kept = [t for group in groups for t, size, _ in group if marked or size]
    return "\n".join(kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of ``pages`` (page_id, url, html, ...).

    A null html is an empty one, whose text is empty.  Repeated rows are returned
    as often as they come; other columns are ignored; an empty table gives an
    empty result.  Whole pages are read, in time linear in their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return small_batches(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")
