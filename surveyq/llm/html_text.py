"""Main text of web pages by line-block distribution.

Markup is stripped to lines: one for each block of text, menus and notices
too. A line weighs its characters outside links. Marks in the page change
weights within a bound: in boilerplate (menus, forms, notices, ...) a line
weighs nothing; in a marked article it weighs SURGE more, so that a short
paragraph surges as a long one does, but a line of links alone still weighs
nothing; beside a marked article it weighs an eighth. Weights are summed over
sliding windows of lines. Text begins where a window surges over a threshold
and ends where the windows dive to nothing, or boilerplate or an article's
border begins; what lies between is kept, and nothing else.

A page without a marked article is read twice: the first surges tell the
elements that hold its text, and their lines count as marked after that.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from surveyq.llm.common import give_back, slices, texts_of, tuned

#: Lines of a window, the characters that make a surge, and what a line beside a marked article weighs less by.
WINDOW, SURGE, BESIDE = 3, 80, 8

#: Elements whose content is no text, and those of them that run to the page's end without an end tag.
_RAW = frozenset("script style template iframe svg textarea select title".split())
_TO_THE_END = frozenset(("script", "style"))
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in _RAW}
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(r"""=\s*(["'])""")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Levels of what may hold the article; the highest level that a page has text in is taken.
_MAIN = {"article": 3, "main": 2}
_CONTENT = frozenset("content article post entry story main maincontent articlebody".split())
_NOT_AN_ARTICLE = frozenset("comment comments reply replies ad ads advert advertisement sponsored promo related teaser widget".split())
_OUTER = frozenset(("header", "hgroup"))
_BOILER = frozenset("nav footer aside form button menu dialog fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words of class and id that mark boilerplate outside a marked article.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu menus nav navbar navigation "
    "navi breadcrumb breadcrumbs sidebar side widget widgets aside footer foot cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "commentlist respond reply replies disqus discussion form search pagination pager toolbar copyright legal disclaimer masthead topbar skip".split()
)
#: Those of them that do so inside one, too; the others may name a part of the article there.
_INNER_HINTS = _HINTS - frozenset("side foot footer legal copyright disclaimer search skip form masthead signup login alert share".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"""display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*["']?true""", re.I)
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
#: How a notice begins that is no text of the page.
_NOTICE = re.compile(r"(?:©|\(c\)\s|copyright\b)", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Line:
    text: str
    own: int  # characters outside links
    level: int  # of the article that holds it
    boiler: bool
    home: int  # the container that holds it


def _named(attributes: str) -> tuple[set[str], str]:
    """Words of class and id, and the role."""
    words, role = set(), ""
    for key, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        if key.lower() == "role":
            role = value.lower()
        else:
            words.update(_SPLIT.split(_CAMEL.sub("-", value).lower()))
    return words, role


def _kind(name: str, attributes: str, level: int) -> tuple[bool, int]:
    """Whether an element is boilerplate, and the level of article that it opens."""
    words, role = _named(attributes) if attributes else (set(), "")
    if name in ("html", "body"):
        return False, 0
    if name in _MAIN:
        return not _NOT_AN_ARTICLE.isdisjoint(words), _MAIN[name]
    if role == "main":
        return False, 2
    if name in _BOILER or (name in _OUTER and not level) or role in _ROLES or not (_INNER_HINTS if level else _HINTS).isdisjoint(words):
        return True, 0
    if attributes and (_HIDDEN.search(attributes) or _BARE_HIDDEN.search(_QUOTED.sub("=", attributes))):
        return True, 0
    return False, int(name not in _INLINE and not _CONTENT.isdisjoint(words))


def tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, end tag?, name, attributes) of every tag, and the text after the last, with an empty name.

    A tag ends at the first > outside its quoted values; one whose quote never
    closes ends at the first >. Comments, declarations and elements without
    text are left out. Every search goes forward or is not repeated, so the
    work is linear in the page.
    """
    n, at, begin = len(page), 0, 0
    unclosed: set[str] = set()  # quotes, and ends of raw elements, that the rest of the page lacks
    parts: list[str] = []

    def before(end: int) -> str:
        parts.append(page[begin:end])
        text = "".join(parts)
        parts.clear()
        return text

    def ends(mark: str, start: int) -> int:
        """Where the mark after start ends, or the page's end."""
        found = page.find(mark, start)
        return n if found < 0 else found + len(mark)

    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            stop = at + 5 if page.startswith("<!-->", at) else ends("-->", at + 4)
        elif page.startswith("<![CDATA[", at):
            stop = ends("]]>", at + 9)
        elif page.startswith(("<!", "<?"), at):
            stop = ends(">", at + 2)
        elif not (name := _NAME.match(page, at + 1)):
            at += 1
            continue
        else:
            stop = page.find(">", name.end())
            if stop < 0:  # an unfinished tag to the end
                yield before(at), False, "", ""
                return
            seen = name.end()
            while opened := _VALUE.search(page, seen, stop):
                quote = opened[1]
                closed = -1 if quote in unclosed else page.find(quote, opened.end())
                if closed < 0:
                    unclosed.add(quote)
                    break
                seen = closed + 1
                if closed > stop and (stop := page.find(">", closed)) < 0:
                    yield before(at), False, "", ""
                    return
            kind, attributes = name[2].lower(), page[name.end() : stop]
            stop += 1
            if kind in _RAW:
                if not name[1] and not attributes.endswith("/") and kind not in unclosed:
                    end = _ENDS[kind].search(page, stop)
                    if end:
                        stop = ends(">", end.end())
                    elif kind in _TO_THE_END:
                        stop = n
                    else:
                        unclosed.add(kind)
            else:
                yield before(at), bool(name[1]), kind, attributes
                at = begin = stop
                continue
        parts.append(page[begin:at])
        at = begin = stop
    yield before(n), False, "", ""


#: Elements that end boilerplate whose own end tag is missing.
_FRESH = frozenset("p h1 h2 h3 h4 h5 h6 div section article main blockquote pre table header footer aside".split())
#: End tags that close cells left open; others don't reach out of a cell.
_OUT_OF_CELLS = frozenset("tr table tbody thead tfoot body html article main".split())
_CELLS = frozenset(("td", "th", "table"))
_LEFT_OPEN = frozenset("p li dt dd option tr td th".split())
_CONTAINERS = frozenset("div section article main body td th blockquote ul ol dl figure center form".split())


def lines_of(page: str) -> list[Line]:
    """The page's lines. An element of boilerplate without text is an empty line of it."""
    every = list(tokens(page))
    # boilerplate elements without an end tag
    waiting: dict[str, list[int]] = {}
    for k, (_, end, name, _) in enumerate(every):
        if name in _BOILER:
            if not end:
                waiting.setdefault(name, []).append(k)
            elif waiting.get(name):
                waiting[name].pop()
    unended = {k for found in waiting.values() for k in found}

    stack: list[tuple[str, bool, int, bool, int]] = []  # name; before it: in boilerplate, level of article, in a link, home
    places: dict[str, list[int]] = {}  # name -> its places in the stack
    cells: list[int] = []  # places of cells
    boiler = link = loose = False  # loose: in boilerplate that has no end tag
    level = home = 0
    out: list[Line] = []
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Line(text, max(0, len(text) - linked), level, boiler, home))
        parts, linked = [], 0

    def unwind(size: int) -> None:
        """Close the elements above this height of the stack."""
        nonlocal boiler, level, link, home, loose
        was = (boiler, level, link, home)
        while len(stack) > size:
            name, *was = stack.pop()
            places[name].pop()
            if cells and cells[-1] == len(stack):
                cells.pop()
        if boiler and not was[0]:
            close()
            out.append(Line("", 0, 0, True, 0))
            loose = False
        boiler, level, link, home = was

    for k, (text, end, name, attributes) in enumerate(every):
        if text:
            parts.append(text)
            linked += len(text) if link else 0
        if not name:
            continue
        if name not in _INLINE:
            close()
        if end:
            found = places.get(name)
            if found and (name in _OUT_OF_CELLS or not cells or cells[-1] <= found[-1]):
                unwind(found[-1])
            continue
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        if loose and name in _FRESH:
            close()
            boiler = loose = False
            out.append(Line("", 0, 0, True, 0))
        if name in _LEFT_OPEN and stack and stack[-1][0] == name:
            unwind(len(stack) - 1)  # the end tag may be left out
        places.setdefault(name, []).append(len(stack))
        if name in _CELLS:
            cells.append(len(stack))
        stack.append((name, boiler, level, link, home))
        if not boiler:
            drop, opened = _kind(name, attributes, level)
            if drop:
                close()
                boiler, loose = True, k in unended
            elif opened > level:
                close()
                level = opened
        if name in _CONTAINERS:
            home = k
        link = link or name == "a"
    close()
    return out


def between(weights: list[int], window: int = WINDOW, surge: int = SURGE, cuts: list[bool] | None = None) -> list[bool]:
    """Which lines lie between a surge and the next dive.

    block[i] sums the weights of lines i .. i + window - 1, up to the next cut
    (a line before which windows end). A surge is a line that weighs something
    and from which a block reaches `surge`; the dive is the next cut, or the
    next line from which the block is 0, or the end.
    """
    n = len(weights)
    cuts = cuts or [False] * n
    block = [0] * n
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    stop = n
    for i in range(n - 1, -1, -1):
        block[i] = sums[min(stop, i + window)] - sums[i]
        if cuts[i]:
            stop = i
    keep, i = [False] * n, 0
    while i < n:
        if block[i] >= surge and weights[i]:
            begin = i
            while i < n and block[i] and (i == begin or not cuts[i]):
                keep[i] = True
                i += 1
        else:
            i += 1
    return keep


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks, joined by line feeds; empty if no line weighs anything."""
    lines = lines_of(page)
    top = max((line.level for line in lines if line.text and not line.boiler), default=0)
    notice = [not (top and line.level == top) and _NOTICE.match(line.text) is not None for line in lines]
    bonus = surge

    def kept(marked: list[bool], beside: int, surge: int = surge) -> list[bool]:
        weights = [
            0 if line.boiler or no or not line.own else line.own + bonus if mark else line.own // beside for line, mark, no in zip(lines, marked, notice)
        ]
        sides = [(line.boiler or no, mark) for line, mark, no in zip(lines, marked, notice)]
        cuts = [i == 0 or side[0] or side != sides[i - 1] for i, side in enumerate(sides)]
        return between(weights, window, surge, cuts)

    if top:
        keep = kept([line.level == top for line in lines], BESIDE)
    else:
        plain = [False] * len(lines)
        first = kept(plain, 1)
        if not any(first):  # a page of little text: its heaviest lines surge
            surge = max((line.own for line, no in zip(lines, notice) if not line.boiler and not no), default=0) or 1
            first = kept(plain, 1, surge)
        held: dict[int, int] = {}
        for line, k in zip(lines, first):
            held[line.home] = held.get(line.home, 0) + k * line.own
        again = kept([held[line.home] >= surge for line in lines], 1)
        keep = [a or b for a, b in zip(first, again)]
    return "\n".join(line.text for line, k in zip(lines, keep) if k and line.text)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page: its main text, empty if there is none, and the text's code points.

    The whole html is read; null counts as empty. Null ids and urls are kept;
    equal pages give equal texts. Only these three columns are read; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            whole = texts_of(batch.column(2))
            for a, b in slices(whole.bounds[1:] - whole.bounds[:-1]):
                texts = [main_text(whole.bytes_of(i).decode()) for i in range(a, b)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [id_col, url_col, "text", "n_chars"],
                )

    kinds = dict(pages.dtypes)
    tuned(pages.sparkSession)
    return pages.select(pages[id_col], pages[url_col], pages[html_col].alias("html")).mapInArrow(
        run, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long"
    )
