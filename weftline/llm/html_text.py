"""Main text of web pages by line-block distribution.

Markup is stripped to lines: every tag of a block element ends one, so tags without text between them give empty
lines, MOST_EMPTY in a row at most. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are taken out with their elements and leave an empty line. A line's length counts its characters
outside links. Lengths are summed over sliding windows of lines; text lies between a surge, where a window's sum passes
the threshold, and the dive, where a window holds nothing.

Lines are judged by their own text and their windows; elements and names are evidence of bounded weight:

- a line of an article or main element that has text outside links weighs BONUS more, which is less than the threshold; one of
  links only weighs nothing in a run of such lines, as in a menu;
- lines outside of these elements weigh a part of their length, and surge if a window of them does: a body that lies beside a
  main element stays, the lines around an article go. Short lines without the end of a sentence (plain menus, copyright lines)
  are cut off the ends of such stretches;
- without main elements the heaviest stretch stays, with others of at least a fifth of its weight, cut in the same way; headings
  and sentences right before a surge belong to it;
- parts that only their names mark go unless nothing is left without them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
THRESHOLD = 86
BONUS = THRESHOLD - 1  # of a line in a main element
OUTSIDE = 2  # divides the lengths of lines outside the main elements of a page that has them
OTHERS = 0.2  # weight of further stretches, as a share of the heaviest
SHORT = 40  # characters of a line that may be cut off the ends
MOST_EMPTY = 2

# Element names of HTML and words by which pages name their parts.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "plaintext"}
DROPPED = {
    "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "math", "iframe", "object", "button",
    "select", "dialog", "menu", "head", "canvas", "audio", "video", "map", "datalist", "fieldset",
}
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt",
    "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
NAMED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored",
    "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "notification",
    "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toolbar", "pagination", "pager",
    "header", "masthead", "footer", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe",
    "subscription", "signup", "login", "popup", "modal", "overlay", "widget", "skip", "hidden", "topbar", "search",
    "complementary", "contentinfo",
}
READERS = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
# Words that go with those in names of parts, and never make one alone.
BESIDE = {
    "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form",
    "global", "icons", "inner", "item", "items", "layer", "left", "link", "links", "list", "main", "media", "message",
    "outer", "page", "panel", "post", "posts", "primary", "reader", "right", "secondary", "section", "site", "slot",
    "stories", "text", "thread", "top", "unit", "user", "wrap", "wrapper",
}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=<][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?)?""")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SENTENCE = re.compile(r"""[.!?:;…。！？]["'”’»)\]]*$""")
_RIGHTS = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_KEPT = {"class", "id", "role", "hidden", "aria-hidden", "style"}


def _named(value: str) -> set[str]:
    """Which of the words that name parts make up a name of the value: all its parts name one or go beside."""
    found: set[str] = set()
    for name in _CAMEL.sub(r"\1-\2", value).split():
        parts = set(_PARTS.findall(name.lower()))
        own = parts & (NAMED | READERS)
        if own and parts <= NAMED | READERS | BESIDE:
            found |= own
    return found


class Tag:
    """A tag or what is skipped. kind: + opens, - closes, x is skipped; close: index of the tag that closes it."""

    __slots__ = ("start", "end", "name", "attributes", "kind", "close")

    def __init__(self, start: int, end: int, name: str, attributes: dict[str, str], kind: str) -> None:
        self.start, self.end, self.name, self.attributes, self.kind, self.close = start, end, name, attributes, kind, None


def _attributes(page: str, at: int) -> tuple[int | None, dict[str, str]]:
    """The end of the tag whose attributes begin at `at`, None if it never ends, -1 if another begins before."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m[1] and (name := m[1].lower()) in _KEPT:
            found.setdefault(name, m[2] or m[3] or m[4] or "")
        at = m.end()
        if at >= len(page):
            return None, found
        if page[at] == ">":
            return at + 1, found
        if page[at] == "<" and not m[1]:
            return -1, found
        if not m[1]:
            at += 1


def tags(page: str) -> list[Tag]:
    """The tags of a page in order, in time that grows with its length. A tag that another one begins before it ends
    is text; once one has no end outside quotes, quotes are ignored from there on."""
    out: list[Tag] = []
    open_: dict[str, list[int]] = {}
    at, quotes, comments = 0, True, True
    while (start := page.find("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            end = page.find("-->", start + 4) if comments and page.startswith("<!--", start) else -1
            if end >= 0:
                end += 3
            else:
                comments = comments and not page.startswith("<!--", start)
                end = page.find(">", start) + 1 or len(page)
            out.append(Tag(start, end, "", {}, "x"))
            at = end
            continue
        if not (m := _NAME.match(page, start + 1)):
            at = start + 1
            continue
        end, attributes = _attributes(page, m.end()) if quotes else (page.find(">", m.end()) + 1 or -1, {})
        if end is None:
            quotes, end = False, page.find(">", m.end()) + 1 or -1
        if end < 0:
            at = start + 1
            continue
        name, at = m[2].lower(), end
        if name in RAW and not m[1]:
            close = re.compile(rf"</{name}(?=[\s/>]|$)[^>]*>?", re.I).search(page, end)
            at = close.end() if close else len(page)
            out.append(Tag(start, at, name, {}, "x"))
        elif m[1]:
            if held := open_.get(name):
                out[held.pop()].close = len(out)
            out.append(Tag(start, end, name, {}, "-"))
        else:
            if name not in VOID and page[end - 2] != "/":
                open_.setdefault(name, []).append(len(out))
            out.append(Tag(start, end, name, attributes, "+"))
    return out


def _boilerplate(tag: Tag, in_main: bool) -> str:
    """Why an element goes: "element", "named" or "readers"; empty if it stays."""
    name, attributes = tag.name, tag.attributes
    if name in DROPPED and not (name == "header" and in_main):
        return "element"
    if not attributes or name in ("html", "body"):
        return ""
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _NONE.search(attributes.get("style", "")):
        return "element"
    words = set()
    for key in ("class", "role") if name == "p" or name in HEADINGS else ("class", "id", "role"):
        if value := attributes.get(key):
            words |= _named(value)
    if words & READERS:
        return "readers"
    return "named" if words and name not in MAIN and not (name == "header" and in_main) else ""


class Line:
    __slots__ = ("text", "free", "main", "heading")

    def __init__(self, text: str, free: int, main: bool, heading: bool) -> None:
        self.text, self.free, self.main, self.heading = text, free, main, heading


def _taken_out(found: list[Tag], named: bool) -> dict[int, int]:
    """Index of each tag that begins what goes -> index of the tag after it.

    An element that is never closed goes up to its next block. One that only its name marks goes if `named` and if it holds
    no article or main element."""
    mains = [0]
    for tag in found:
        mains.append(mains[-1] + (tag.kind == "+" and tag.name in MAIN))
    out: dict[int, int] = {}
    inside = i = 0
    while i < len(found):
        tag = found[i]
        if tag.name in MAIN:
            inside = max(0, inside + (1 if tag.kind == "+" else -1 if tag.kind == "-" else 0))
        if tag.kind == "+" and tag.name not in VOID and (why := _boilerplate(tag, inside > 0)):
            if tag.close is None:
                after = next((j for j in range(i + 1, len(found)) if found[j].name in BLOCKS or found[j].name in DROPPED), len(found))
            else:
                after = tag.close + 1
                holds_main = mains[after] > mains[i + 1]
                if why == "named" and (holds_main or not named):
                    after = 0
            if after:
                out[i] = after
                i = after
                continue
        i += 1
    return out


def lines(page: str) -> list[Line]:
    """The lines of a page without what goes. Where nothing would be left, parts that only names mark are kept."""
    found = tags(page)
    out = _lines(page, found, _taken_out(found, True))
    return out if any(x.text for x in out) else _lines(page, found, _taken_out(found, False))


def _lines(page: str, found: list[Tag], gone: dict[int, int]) -> list[Line]:
    out: list[Line] = []
    text: list[str] = []
    linked, link_until, mains, heading, empty = 0, -1, 0, 0, 0

    def end_line() -> None:
        nonlocal linked, empty
        line = " ".join("".join(text).split())
        empty = 0 if line else empty + 1
        if empty <= MOST_EMPTY:
            out.append(Line(line, max(0, len(line) - linked), mains > 0, heading > 0))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece := html.unescape(piece))
        if link_until >= 0:
            linked += len(" ".join(piece.split()))

    at = i = 0
    while i < len(found):
        tag = found[i]
        if tag.start > at:
            add(page[at : tag.start])
        if i in gone:
            end_line()
            i = gone[i]
            at = found[i - 1].end if found[i - 1].kind == "-" else found[i].start if i < len(found) else len(page)
            empty = 0
            out.append(Line("", 0, False, False))
            link_until = link_until if link_until >= i else -1
            continue
        at = tag.end
        if tag.name in BLOCKS or tag.kind == "x" and tag.name:
            end_line()
            if link_until == len(found):  # of a link that is never closed
                link_until = -1
        opens = tag.kind == "+"
        if tag.name == "a":
            link_until = (len(found) if tag.close is None else tag.close) if opens else -1
        elif tag.name in MAIN:
            mains = max(0, mains + (1 if opens else -1))
        elif tag.name in HEADINGS:
            heading = (tag.close is not None) if opens else 0
        i += 1
    add(page[at:])
    end_line()
    return out


def stretches(lengths: list[int], window: int = WINDOW, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """The stretches of lines from a surge to its dive: first line, line after the last."""
    n = len(lengths)
    ends = [0]
    for x in lengths:
        ends.append(ends[-1] + x)
    sums = [ends[min(n, i + window)] - ends[i] for i in range(n)]
    out, at = [], 0
    while at < n:
        if sums[at] > threshold and lengths[at]:
            dive = at
            while dive < n and sums[dive] > 0:
                dive += 1
            out.append((at, dive))
            at = dive
        at += 1
    return out


def _sentence(x: Line) -> bool:
    return x.heading or bool(_SENTENCE.search(x.text))


def _begun(found: list[Line], at: int) -> int:
    """Where the stretch that surges at a line begins: at the first of the headings and sentences right before it."""
    first = i = at
    while i and at - i <= MOST_EMPTY:
        i -= 1
        if found[i].text:
            if not found[i].free or not _sentence(found[i]):
                break
            first = at = i
    return first


def _heaviest(found: list[Line], window: int, threshold: int) -> list[tuple[int, int]]:
    lengths = [x.free for x in found]
    some = stretches(lengths, window, threshold) or stretches(lengths, window, 0)
    weight = [sum(lengths[a:b]) for a, b in some]
    return [s for s, w in zip(some, weight) if w >= OTHERS * max(weight)]


def _trimmed(found: list[Line]) -> list[Line]:
    """Lines without short ones that end no sentence at both ends; all of them if nothing else is left."""
    ends = lambda x: not x.heading and len(x.text) < SHORT and not _SENTENCE.search(x.text) or bool(_RIGHTS.match(x.text))
    kept = [i for i, x in enumerate(found) if not ends(x)]
    return found[kept[0] : kept[-1] + 1] if kept else found


def _inside(found: list[Line], window: int, threshold: int) -> list[Line]:
    """Lines of main elements, from each surge to its dive."""
    links_only = [x.main and bool(x.text) and not x.free and not x.heading for x in found]
    with_text = [i for i, x in enumerate(found) if x.text]
    alone = {b for a, b, c in zip([-1, *with_text], with_text, [*with_text[1:], -1]) if not (a >= 0 and links_only[a]) and not (c >= 0 and links_only[c])}
    weights = [0 if not (x.main and x.text) else int(i in alone) if links_only[i] else len(x.text) + BONUS for i, x in enumerate(found)]
    some = stretches(weights, window, threshold) or stretches(weights, window, 0)
    return [found[i] for a, b in some for i in range(a, b) if found[i].main and found[i].text]


def _outside(found: list[Line], window: int, threshold: int) -> list[Line]:
    """Lines of the stretches beside main elements; main lines part them."""
    out: list[Line] = []
    for main, run in groupby(found, key=lambda x: x.main and bool(x.text)):
        if not main:
            part = list(run)
            for a, b in stretches([x.free // OUTSIDE for x in part], window, threshold):
                out += _trimmed([x for x in part[a:b] if x.text])
    return out


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The main text, its blocks joined by line feeds; empty for a null or empty page and one without text."""
    if not page:
        return ""
    found = lines(page)
    if any(x.free for x in found if x.main):
        chosen = {id(x) for x in [*_inside(found, window, threshold), *_outside(found, window, threshold)]}
        kept = [x for x in found if id(x) in chosen]
    else:
        parts, last = [], 0
        for a, b in _heaviest(found, window, threshold):
            parts += _trimmed([x for x in found[max(last, _begun(found, a)) : b] if x.text])
            last = b
        kept = parts
    return "\n".join(x.text for x in kept)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, threshold: int = THRESHOLD
) -> DataFrame:
    """(id_col, url_col, text, n_chars) for every page. A null page is an empty one; null and repeated ids and
    urls stay as they are; other columns aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, window, threshold) for p in batch.column(2).to_pylist()]
            made = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=[id_col, url_col, "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
