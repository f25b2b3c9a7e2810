"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of text. Parts that are named
as something else than content (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments), by their element, role, class
or id, are stripped with it and leave nothing. What is left is decided by the
lengths of its lines, links not counted:

* over every ``WINDOW`` neighbouring lines the lengths are summed. The first
  window over the threshold is a surge and the last one before a sum at or below
  it a dive; a stretch runs from the first line of the one to the last line of
  the other, so a short line next to text belongs to it. The threshold is
  ``LEAST``, or half the longest line on a page without longer ones;
* lines at the borders of a stretch that are links alone, or short and no
  paragraphs, headings, items or cells, are taken off, unless there are no others;
  a gap of paragraphs, headings, items and cells with text outside of links
  doesn't end a stretch;
* windows don't reach over the borders of ``article`` and ``main``. Inside these
  one with a stretch is kept, but for link bars without a telling name: runs of
  lines that are links alone, outside of paragraphs, headings, items and cells,
  which a dive cuts, as windows don't reach all of them. If such parts hold half of
  the text in all stretches or more, what lies outside of them goes.

Elements end as HTML ends them: by their end tag, by that of an element around
them, or, where the end tag may be left out (``p li dt dd td tr option`` and so on),
by what follows. So a part that is left out takes no more with it than itself.

Defined results: null, empty and text-free pages give an empty text; a page
without any stretch (links only) gives all its lines; an unclosed element that
would be left out ends with the element around it, or at the next ``article`` or
``main``, an unclosed comment or script at the end of the page.
"""

from __future__ import annotations

import re
from html import unescape
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import DataFrame

from .arrowio import map_rows

WINDOW, LEAST = 3, 40
#: Elements of HTML by their part in a page.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
LEFT_OUT = frozenset("aside button canvas datalist dialog footer form head iframe map menu nav noscript object search select svg template".split())
RAW = frozenset("script style title textarea xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: What classes and ids call parts that are no content, words that may follow, and words that deny it.
NAMES = frozenset(
    "ad ads adbox advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popup promo promoted promotion related replies share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget".split()
)
HOLDERS = frozenset("area bar block box buttons container content form group inner item items left links list main outer panel right section slot thread top wrap wrapper".split())
DENIALS = frozenset("has hide is no not with without".split())
#: Start tags that end an element whose end tag may be left out, and what such an end doesn't reach over.
_ROWS, _CELLS = frozenset("tbody tfoot thead".split()), frozenset("td th".split())
ENDS = {
    "p": BLOCKS - frozenset("body html legend option optgroup".split()),
    "li": frozenset({"li"}),
    **dict.fromkeys(("dt", "dd"), frozenset({"dt", "dd"})),
    **dict.fromkeys(("option", "optgroup"), frozenset({"option", "optgroup"})),
    **dict.fromkeys(_CELLS, _CELLS | _ROWS | {"tr"}),
    "tr": _ROWS | {"tr"},
    **dict.fromkeys(_ROWS | {"caption", "colgroup"}, _ROWS),
}
ENDED_BY = {tag: frozenset(name for name, tags in ENDS.items() if tag in tags) for tag in BLOCKS}
HOLDS = {
    **dict.fromkeys(("option", "optgroup"), frozenset("datalist select".split())),
    **dict.fromkeys(("dt", "dd"), frozenset("dl table".split())),
    **dict.fromkeys(_CELLS | _ROWS | {"tr"}, frozenset({"table"})),
    "li": frozenset("dir menu ol table ul".split()),
}
SCOPE = frozenset("button caption object table td template th".split())
_TABLE_PARTS = _CELLS | _ROWS | {"caption", "table", "tr"}
_TAG = re.compile(r"</?([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/>]|$))", re.I)
_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def names_a_part(token: str) -> bool:
    """Whether a class or an id is the name of a part, as in ``site-footer`` and ``comment-list`` but not ``menu-prices``."""
    words = _PARTS.findall(token)
    if len(words) > 1 and words[0] in DENIALS:
        return False
    while len(words) > 1 and words[-1] in HOLDERS:
        words.pop()
    return bool(words) and words[-1] in NAMES


def left_out(name: str, attributes: str, in_content: bool) -> bool:
    """Whether an element is something else than content."""
    if name in LEFT_OUT:
        return True
    if name == "header":
        return not in_content
    if name in ("html", "body", "article", "main") or not attributes:
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return True
        if key == "role" and value in ROLES or key in ("class", "id") and any(map(names_a_part, value.split())):
            return True
    return False


class Line(NamedTuple):
    text: str
    size: int  # characters outside of links
    prose: bool  # whether a paragraph, heading, item or cell
    part: int  # number of the outermost article or main, 0 outside


def squeeze(parts: list[str]) -> str:
    return " ".join(unescape("".join(parts)).split())


class Open:
    """The open elements of a page, in order; ``left_out`` is the place of the one that is left out, or -1."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.left_out = -1
        self.parts = 0  # open article and main elements

    def push(self, name: str) -> None:
        self.names.append(name)
        self.parts += name in ("article", "main")

    def cut(self, at: int) -> None:
        """End the elements from place ``at`` on."""
        self.parts -= sum(x in ("article", "main") for x in self.names[at:])
        del self.names[at:]
        if self.left_out >= at:
            self.left_out = -1

    def start(self, name: str) -> None:
        """End what the start tag of ``name`` ends."""
        targets = ENDED_BY.get(name)
        if not targets:
            return
        found, far = len(self.names), HOLDS.get(name, SCOPE)
        for at in range(len(self.names) - 1, -1, -1):
            if self.names[at] in targets:
                found = at
            elif self.names[at] in far:
                break
            elif name in ENDS["p"] and name not in HOLDS and self.names[at] in BLOCKS:
                break  # a paragraph holds no blocks, so there is none open around one
        self.cut(found)

    def end(self, name: str) -> None:
        """End ``name`` and what is open in it; other elements' blocks stay open behind an inline end tag."""
        far = frozenset({"table"}) if name in _TABLE_PARTS else SCOPE
        inline = name not in BLOCKS and name not in LEFT_OUT
        over = False
        for at in range(len(self.names) - 1, -1, -1):
            here = self.names[at]
            if here == name:
                if not over:
                    self.cut(at)
                elif at == self.left_out:
                    self.left_out = -1
                    del self.names[at]
                else:
                    del self.names[at]
                    self.left_out -= self.left_out > at
                return
            if here in far:
                return
            over = over or inline and here in BLOCKS


def blocks(html: str) -> list[Line]:
    """The lines of a page in order, without the parts that are left out."""
    lines: list[Line] = []
    parts: list[str] = []
    links: list[str] = []
    opened, n_parts = Open(), 0
    in_link, block = False, ""
    at, n = 0, len(html)

    def end_line() -> None:
        text = squeeze(parts) if parts else ""
        if text:
            size = max(0, len(text) - len(squeeze(links))) if links else len(text)
            lines.append(Line(text, size, block in PROSE, n_parts if opened.parts else 0))
        parts.clear()
        links.clear()

    while at < n:
        low = html.find("<", at)
        if low < 0:
            low = n
        if low > at and opened.left_out < 0:
            parts.append(html[at:low])
            if in_link:
                links.append(html[at:low])
        if low == n:
            break
        if html.startswith("<!--", low):
            end = html.find("-->", low + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), low):
            end = html.find(">", low)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(html, low)
        if not m:
            if html[low + 1 : low + 2].isalpha() or html.startswith("</", low):
                end = html.find(">", low)
                at = n if end < 0 else end + 1  # a tag with a stray quote
            else:
                if opened.left_out < 0:
                    parts.append("&lt;")
                at = low + 1
            continue
        at, name, closing = m.end(), m[1].lower(), html[low + 1] == "/"
        alone = name in VOID or m[2].endswith("/")
        if name in RAW and not closing:
            end = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            at = n if end is None else (html.find(">", end.start()) + 1 or n)
            continue
        if opened.left_out < 0:
            if name == "br":
                parts.append(" ")
                links.append(" ")
            elif name == "a":
                in_link = not closing and "href" in m[2].lower()
            elif name in BLOCKS or name in LEFT_OUT:
                end_line()
                block = "" if closing else name
                in_link = in_link and not closing  # an unclosed link ends with its block
        was = opened.left_out
        if closing:
            opened.end(name)
        else:
            opened.start(name)
            if name in ("article", "main") and opened.left_out >= 0 and opened.names[opened.left_out] not in ("article", "main"):
                opened.cut(opened.left_out)
        if was >= 0 and opened.left_out < 0:
            block, in_link = "" if closing else name, name == "a" and not closing and "href" in m[2].lower()
        if closing or alone:
            continue
        content = opened.parts > 0
        opened.push(name)
        n_parts += opened.parts == 1 and not content
        if opened.left_out < 0 and name not in ("article", "main") and left_out(name, m[2], content):
            end_line()
            opened.left_out = len(opened.names) - 1
    end_line()
    return lines


def reached(lines: list[Line], threshold: int) -> list[bool]:
    """Whether a line lies in a window whose sum is over the threshold."""
    n = len(lines)
    text = [False] * n
    for i in range(max(1, n - WINDOW + 1) if n else 0):
        window = range(i, min(i + WINDOW, n))
        if sum(lines[j].size for j in window) > threshold:
            for j in window:
                text[j] = True
    return text


def stretches(lines: list[Line], threshold: int) -> list[tuple[int, int]]:
    """Line ranges from a surge to the next dive of the window sums."""
    text = reached(lines, threshold)
    out: list[tuple[int, int]] = []
    for kept, places in groupby(range(len(lines)), text.__getitem__):
        if not kept:
            continue
        whole = list(places)
        # a paragraph that is one long link is text, too
        core = [i for i in whole if lines[i].prose and (lines[i].size or len(lines[i].text) > 2 * LEAST) or lines[i].size > threshold] or whole
        first, last = core[0], core[-1]
        if out and all(x.prose and x.size for x in lines[out[-1][1] : first]):
            first = out.pop()[0]
        out.append((first, last + 1))
    return out


def extract(html: str | None) -> str:
    """The main text: its blocks, one a line."""
    lines = blocks(html) if html else []
    threshold = min(LEAST, max((x.size for x in lines), default=0) // 2)
    inside, outside, at = [], [], 0
    for part, members in groupby(lines, lambda x: x.part):
        members = list(members)
        found = stretches(members, threshold)
        if part and found:
            near = reached(members, threshold)
            for bar, run in groupby(range(len(members)), lambda i: not members[i].prose and not members[i].size):
                run = list(run)
                if not bar or all(near[i] for i in run):
                    inside.append((at + run[0], at + run[-1] + 1))
        elif not part:
            outside += [(at + a, at + b) for a, b in found]
        at += len(members)
    load = lambda ranges: sum(x.size for a, b in ranges for x in lines[a:b])
    kept = inside if load(inside) >= load(outside) else sorted(inside + outside)
    return "\n".join(x.text for a, b in kept or [(0, len(lines))] for x in lines[a:b])


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def make():
        def each(row):
            text = extract(row[2])
            return [(row[0], row[1], text, len(text))]

        return each

    return map_rows(pages.select("page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long", limit=200)
