"""Text functions as Column builders: normalisers, splitters, extractors, parsers.

All are built-in expressions. White space follows the Unicode sense ((?U)\\s),
line ends are \\n alone ((?d)), offsets count code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

_WS = r"(?U)\s"
_MARK = "\u0001"


def _c(column: ColumnOrName) -> Column:
    return F.col(column) if isinstance(column, str) else column


def let(value: Column, body) -> Column:
    """body(value) with value computed once; null stays null if body says so."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chain(column: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        column = F.regexp_replace(column, pattern, to)
    return column


def strip(column: ColumnOrName, extra: str = "") -> Column:
    """Without white space, and the characters in extra, at both ends."""
    inner = rf"[\s{extra}]"
    return F.regexp_replace(_c(column), rf"(?U)\A{inner}+|{inner}+\z", "")


def collapse(column: ColumnOrName) -> Column:
    """Runs of white space to one space, trimmed."""
    return F.trim(F.regexp_replace(_c(column), _WS + "+", " "))


def blank_to_null(column: ColumnOrName) -> Column:
    """null for null, empty and white-space strings: the truth value of text."""
    c = _c(column)
    return F.when(F.rlike(c, F.lit(r"(?U)\S")), c)


def empty_to_null(column: ColumnOrName) -> Column:
    return F.nullif(_c(column), F.lit(""))


# --- normalisers ---------------------------------------------------------


def norm_title(column: ColumnOrName) -> Column:
    """Title key: ASCII letters only, lowered."""
    return F.lower(F.regexp_replace(_c(column), "[^a-zA-Z]", ""))


def norm_alnum(column: ColumnOrName) -> Column:
    """Lowered ASCII letters and digits."""
    return F.regexp_replace(F.lower(_c(column)), "[^a-z0-9]", "")


def norm_words(column: ColumnOrName) -> Column:
    """Lowered ASCII letters and digits, runs of anything else as one space; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_c(column), F.lit(""))), "[^a-z0-9]+", " "))


def norm_loose(column: ColumnOrName) -> Column:
    """Lowered, without punctuation, single spaces; letters of every script stay."""
    return collapse(F.regexp_replace(F.lower(_c(column)), r"(?U)[^\w\s]", ""))


def norm_sentence(column: ColumnOrName) -> Column:
    """Lowered sentence without bracket markers, single spaces."""
    return F.lower(collapse(F.regexp_replace(F.coalesce(_c(column), F.lit("")), r"\[[^\]]{1,40}\]", "")))


#: What is taken off a web title, in this order.
WEB_TITLE = (
    (r"(?i)^\[PDF\]\s*", ""),
    (r"^\[\d{4}\.\d{4,6}\]\s*", ""),
    (r"(?i)\s*[-–]\s*(?:arXiv(?:\.org)?|ar5iv|Semantic\s*Scholar|ResearchGate|ACM|IEEE|Springer|CVPR|NeurIPS|ICLR|ICML|AAAI|EMNLP|ACL|NAACL)\b.*$", ""),
    (r"(?i)\s*[-–]\s*\S+\.(?:com|org|edu|io|net)\S*\s*$", ""),
    (r"\s*\.\.\.\s*$", ""),
)


def clean_web_title(column: ColumnOrName) -> Column:
    """A title as search engines return it, without file marks, id prefixes, site and domain suffixes; null as empty."""
    return strip(_chain(strip(F.coalesce(_c(column), F.lit(""))), *WEB_TITLE))


#: Words that open the venue part of a bibliography entry.
VENUE = (
    r"(?i)\s+(?:In\s+(?:Proceedings|Advances|Proc\.?|Workshop|IEEE|ACM|20\d{2}|19\d{2})|Proceedings\s+of|Proc\.\s+of"
    r"|Conference\s+on|\[Online\]|Available:|pp\.\s|vol\.\s|doi:|arXiv:|URL\s)"
)


def clean_query_title(column: ColumnOrName, max_words: int = 20) -> Column:
    """A bibliography title for an exact-title search: no year in front, no venue past character 10, no page range, few words."""
    t = F.regexp_replace(strip(F.coalesce(_c(column), F.lit(""))), r"^\s*\(?\d{4}\)?\.?\s*", "")

    def cut(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(VENUE))
        return F.when(at > 11, F.substring(t, F.lit(1), at - 1)).otherwise(t)

    t = F.regexp_replace(let(t, cut), r"\s+\d+\s*[-–—]+\s*\d+\s*\.?\s*$", "")
    t = strip(collapse(t), r".,;:\-\"'")
    return F.array_join(F.slice(F.split(t, " "), 1, max_words), " ")


#: LaTeX marks of a title and what they become, in this order.
LATEX_TITLE = (
    (r"\\\\(?:\[[^\]]*\])?", " "),
    (r"\\[a-zA-Z]+\*?\s*\{([^{}]*)\}", "$1"),
    (r"\\[a-zA-Z]+\*?", ""),
    (r"[{}]", ""),
    ("~", " "),
    (r"\$([^$]*)\$", "$1"),
)

#: LaTeX marks of a bibliography fragment and what they become, in this order.
LATEX_FRAGMENT = (
    (r"\\bib(?:info|field)\s*\{[^{}]*\}\s*\{", ""),
    (r"\\(?:emph|textit|textbf|textsc|mbox|text|href|url|texttt)\s*\{([^{}]*)\}", "$1"),
    (r"\\\\(?:\[[^\]]*\])?", " "),
    (r"\\newblock\b", " "),
    (r"\\natexlab\s*\{[^{}]*\}|\\BIBentry[A-Za-z]+|\\shownote\s*\{[^{}]*\}", ""),
    (r"\\[A-Za-z@]+\*?\s*\{([^{}]*)\}", "$1"),
    (r"\\[A-Za-z@]+\*?", ""),
    ("~", " "),
    (r"[{}]", ""),
    ("``|''", '"'),
    ("`", "'"),
)


def clean_latex_title(column: ColumnOrName) -> Column:
    """LaTeX title to plain text: line breaks, commands, braces, ties and inline maths unwrapped."""
    return strip(collapse(_chain(_c(column), *LATEX_TITLE)), ".:;,")


def clean_latex_fragment(column: ColumnOrName) -> Column:
    """A LaTeX bibliography fragment to one plain line; null as empty."""
    return strip(collapse(_chain(F.coalesce(_c(column), F.lit("")), *LATEX_FRAGMENT)), ".,;:")


def strip_markup(column: ColumnOrName) -> Column:
    """Tags removed, white space collapsed."""
    return collapse(F.regexp_replace(_c(column), "<[^>]+>", ""))


def strip_controls(column: ColumnOrName) -> Column:
    """Control characters, but tab and line ends, to spaces."""
    return F.regexp_replace(_c(column), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " ")


def strip_json_fence(column: ColumnOrName) -> Column:
    """A model's answer without the code fence around it."""
    return strip(_chain(strip(column), (r"(?i)\A```(?:json)?\s*", ""), (r"\s*```\z", "")))


def first_json_object(column: ColumnOrName) -> Column:
    """The text from the first { to the last }, or null."""
    return empty_to_null(F.regexp_extract(_c(column), r"(?s)\{.*\}", 0))


def slug(column: ColumnOrName) -> Column:
    """A safe file name: anything but letters, digits, dot, dash and underscore as _."""
    return F.regexp_replace(_c(column), r"[^A-Za-z0-9._-]+", "_")


def clean_markdown(column: ColumnOrName) -> Column:
    """Converted markdown without attribute blocks, at most one blank line in a row, ending in one line feed."""
    return F.concat(
        strip(_chain(_c(column), (r"(?md)^\s*\{#[^}]*\}\s*$", ""), (r"(?md)\s*\{[^{}\n]*\}\s*$", ""), (r"\n{3,}", "\n\n"))), F.lit("\n")
    )


# --- splitting -----------------------------------------------------------

_BOUNDARY = r"(?U)(?<=[.!?])\s+(?=[A-Z])"


def split_sentences(column: ColumnOrName, min_chars: int = 30, drop_markers: bool = True) -> Column:
    """Sentences longer than min_chars, split after . ! ? before a capital; bracket markers of up to 40 characters go first."""
    text = F.regexp_replace(_c(column), r"\[[^\]]{1,40}\]", "") if drop_markers else _c(column)
    parts = F.transform(F.split(collapse(text), _BOUNDARY), lambda x: F.trim(x))
    return F.filter(parts, lambda s: F.length(s) > min_chars)


def split_line_sentences(column: ColumnOrName) -> Column:
    """Sentences of each non-blank line apart, so that list items are not run together."""
    lines = F.filter(F.transform(F.split(_c(column), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"), lambda x: strip(x)), lambda s: s != "")
    return F.flatten(F.transform(lines, lambda s: F.split(s, _BOUNDARY)))


def split_paragraphs(column: ColumnOrName) -> Column:
    """Blocks between blank lines that have a sentence: array of (text, sentences)."""
    blocks = F.transform(
        F.split(_c(column), r"(?U)\n\s*\n+"),
        lambda b: let(split_sentences(b), lambda s: F.struct(F.array_join(s, " ").alias("text"), s.alias("sentences"))),
    )
    return F.filter(blocks, lambda p: F.size(p["sentences"]) > 0)


def _sentences_of(paragraphs: Column) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: p["sentences"]))


def _section(title: Column, body: Column) -> Column:
    return let(
        split_paragraphs(body),
        lambda p: F.struct(title.alias("title"), _sentences_of(p).alias("sentences"), p.alias("paragraphs")),
    )


def split_sections(column: ColumnOrName) -> Column:
    """Sections under headings of level 1 to 3 that have a sentence; text before the first heading is not in any.

    Without such a section the whole text is one, named "Full text". Array of
    (title, sentences, paragraphs).
    """

    def cut(text: Column) -> Column:
        marked = F.regexp_replace(text, r"(?md)^#{1,3}(?U:\s)+(.+)$", _MARK + "$1" + _MARK)
        # preamble, title, body, title, body, ...; bound once: inside the transform the text would be cut again for each section
        found = let(F.split(marked, _MARK), each)
        return let(found, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(_section(F.lit("Full text"), text))))

    def each(parts: Column) -> Column:
        pairs = F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(2))
        sections = F.transform(pairs, lambda i: _section(strip(F.get(parts, i)), strip(F.get(parts, i + 1))))
        return F.filter(sections, lambda s: F.size(s["sentences"]) > 0)

    return let(_c(column), cut)


def split_tagged_sentences(column: ColumnOrName) -> Column:
    """Text whose sentences begin with [X.S1] marks: array of (id, sentence)."""
    parts = F.filter(F.split(_c(column), r"(?=\[[A-Za-z0-9_]+\.S\d+\])"), lambda s: s.rlike(r"^\[[A-Za-z0-9_]+\.S\d+\]"))
    return F.transform(
        parts,
        lambda s: F.struct(
            F.regexp_extract(s, r"^\[([A-Za-z0-9_]+\.S\d+)\]", 1).alias("id"),
            strip(F.regexp_replace(s, r"^\[[A-Za-z0-9_]+\.S\d+\]", "")).alias("sentence"),
        ),
    )


def word_chunks(sentences: Column, words: Column, chunk_words: int = 350) -> Column:
    """Chunks of whole sentences, about chunk_words each, from a text's sentences and its number of words."""

    def cut(s: Column) -> Column:
        n = F.greatest(F.floor(F.size(s) / (F.floor(words / chunk_words) + 1)), F.lit(1)).cast("int")
        starts = lambda n: F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1)), n)
        chunks = let(n, lambda n: F.transform(starts(n), lambda i: F.trim(F.array_join(F.slice(s, i, n), " "))))
        return F.filter(chunks, lambda c: c != "")

    # bound once: inside the transform the text would be split and counted again for each chunk
    return let(sentences, cut)


def word_count(column: ColumnOrName) -> Column:
    """Words between white space; 0 for null and blank."""
    t = collapse(F.coalesce(_c(column), F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


# --- citations and headings ----------------------------------------------

#: An inline citation that is no link, an author-year mark, and a line of a reference list.
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\](?!\()"
AUTHOR_YEAR = r"\[([A-Z][^,\[\]]{2,40},\s*\d{4}[^\]]*)\]"
REFERENCE_LINE = r"(?d)^\s*(?:\[(\d+)\]|(\d+)\.)\s*(.+?)\s*(?:URL:\s*(\S+))?\s*$"


def citations(column: ColumnOrName) -> Column:
    """Numbers of inline citations [N] and [N, M] in order, but not of links [N](...)."""
    found = F.regexp_extract_all(_c(column), F.lit(CITATION), F.lit(1))
    return F.transform(F.flatten(F.transform(found, lambda g: F.split(g, ","))), lambda n: F.trim(n).cast("int"))


def headings(column: ColumnOrName) -> Column:
    """Headings of level 1 to 6 with their offsets: array of (start, end, level), end at the next heading or the end."""
    text = _c(column)
    lines = F.split(text, "\n")
    none = F.array().cast("array<struct<start:int,level:int>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, r"^(#{1,6})[ \t]+\S", 1))
        new = F.when(level > 0, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("start"), level.alias("level"))))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), new.alias("found"))

    found = F.aggregate(lines, begin, step, lambda acc: acc["found"])
    return let(
        found,
        lambda hs: F.transform(
            hs,
            lambda h, i: F.struct(
                h["start"].alias("start"),
                F.coalesce(F.get(hs, i + 1)["start"], F.length(text)).alias("end"),
                h["level"].alias("level"),
            ),
        ),
    )


def outline(column: ColumnOrName, max_chars: int | None = None, max_lines: int | None = None) -> Column:
    """Lines that start with #; the text itself where there is none; cut to max_chars or max_lines."""
    text = _c(column)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda s: s.startswith("#"))
    if max_lines is not None:
        lines = F.slice(lines, 1, max_lines)
    out = F.coalesce(empty_to_null(F.array_join(lines, "\n")), text)
    return F.substring(out, 1, max_chars) if max_chars is not None else out


def outline_sections(column: ColumnOrName) -> Column:
    """Titles of an outline's numbered or # lines that are longer than 5 characters."""
    lines = F.transform(F.split(_c(column), "\n"), lambda x: strip(x))
    titles = F.transform(
        lines, lambda s: F.regexp_replace(strip(F.regexp_extract(s, r"^(?:\d+[.)]\s*|#{1,3}\s*)(.+)", 1)), ":+$", "")
    )
    return F.filter(titles, lambda t: F.length(t) > 5)


def author_year_references(column: ColumnOrName, most: int = 150) -> Column:
    """[Author, year] marks and then the lines of the reference section, distinct, at most `most`."""
    text = _c(column)
    inline = F.regexp_extract_all(text, F.lit(AUTHOR_YEAR), F.lit(1))
    lines = F.transform(F.split(text, "\n"), lambda x: strip(x))
    heading = r"(?i)^#*\s*(?:references|bibliography)"
    first = F.array_position(F.transform(lines, lambda s: s.rlike(heading)), True)
    after = F.when(first > 0, F.slice(lines, first.cast("int") + 1, F.size(lines))).otherwise(F.array().cast("array<string>"))
    listed = F.filter(after, lambda s: (s != "") & ~s.startswith("#") & ~s.rlike(heading))
    return F.slice(F.array_distinct(F.concat(inline, listed)), 1, most)


def reference_lines(column: ColumnOrName) -> Column:
    """Entries "[N] title URL: x" or "N. title" under a References heading, to the next heading: array of (idx, title, url, arxiv_id)."""
    body = F.regexp_extract(_c(column), r"(?sid)(?:^|\n)[ \t]*#{1,3}\s+references[ \t]*(?:\n(.*))?$", 1)
    upto = F.regexp_replace(body, r"(?s)(?:^|\n)#{1,3}\s+\S.*$", "")
    entry = REFERENCE_LINE
    lines = F.filter(F.split(upto, "\n"), lambda s: s.rlike(entry))
    return F.transform(
        lines,
        lambda s: F.struct(
            F.coalesce(empty_to_null(F.regexp_extract(s, entry, 1)), F.regexp_extract(s, entry, 2)).cast("int").alias("idx"),
            F.regexp_extract(s, entry, 3).alias("title"),
            F.regexp_extract(s, entry, 4).alias("url"),
            arxiv_id(F.regexp_extract(s, entry, 4)).alias("arxiv_id"),
        ),
    )


def references_section(references: Column) -> Column:
    """## References with a line "[idx] title" for each of an array of (idx, title, canonical_title); empty for none."""
    lines = F.transform(
        references, lambda r: F.concat(F.lit("["), r["idx"].cast("string"), F.lit("] "), F.coalesce(empty_to_null(r["canonical_title"]), r["title"]))
    )
    return F.when(F.size(references) > 0, F.concat(F.lit("## References\n\n"), F.array_join(lines, "\n"))).otherwise("")


def replace_references(text: ColumnOrName, references: Column) -> Column:
    """The text with its References section replaced, up to the next heading of the same or a higher level, or appended."""
    text, section = _c(text), references_section(references)
    heading = r"(?mid)^(#{1,3})\s*references\s*$"
    at = F.regexp_instr(text, F.lit(heading))
    level = F.length(F.regexp_extract(text, heading, 1))
    rest = F.regexp_replace(F.substring(text, at, F.length(text)), r"(?id)^#{1,3}\s*references[^\S\n]*", "")
    # the next heading of at most that level
    tail = F.coalesce(*(F.when(level == k, F.regexp_extract(rest, rf"(?sd)\n(#{{1,{k}}}\s+\S.*)$", 1)) for k in (1, 2, 3)))
    rtrim = lambda c: F.regexp_replace(c, r"(?U)\s+\z", "")
    inside = F.concat(
        rtrim(F.substring(text, F.lit(1), at - 1)), F.lit("\n\n"), section,
        F.when(tail != "", F.concat(F.lit("\n\n"), strip(tail))).otherwise(""),
    )
    added = F.concat(rtrim(text), F.lit("\n\n"), section)
    return F.when(F.size(references) <= 0, text).when(at > 0, inside).otherwise(added)


#: Fixed value: a numbered section, up to the line that begins the next one.
NUMBERED_SECTION = r"(?s)## \d+\.?\s*.*?(?=\n##|\z)"


def repeat_outer_sections(column: ColumnOrName) -> Column:
    """A text whose first and last numbered section say their body again under a subsection of their title.

    Texts of fewer than two sections stay as they are. A section whose text
    occurs again is changed at each place.
    """

    def doubled(section: Column) -> Column:
        title = strip(F.substring_index(section, "\n", 1))
        body = F.when(section.contains("\n"), strip(F.regexp_replace(section, r"^[^\n]*\n", ""))).otherwise("")
        named = empty_to_null(F.regexp_extract(title, r"^\S+\s+\S+\s+(.*)$", 1))
        name = F.coalesce(named, F.regexp_extract(title, r"(\S+)$", 1))
        number = F.regexp_extract(section, r"## (\d+)", 1)
        return F.concat(title, F.lit("\n"), body, F.lit("\n\n### "), number, F.lit(".1 "), name, F.lit("\nDescription: "), body, F.lit("\n\n"))

    text = _c(column)
    found = F.regexp_extract_all(text, F.lit(NUMBERED_SECTION), F.lit(0))

    def both(sections: Column) -> Column:
        first, last = F.element_at(sections, 1), F.element_at(sections, -1)
        return F.when(F.size(sections) < 2, text).otherwise(F.replace(F.replace(text, first, doubled(first)), last, doubled(last)))

    return let(found, both)


# --- identifiers ---------------------------------------------------------

#: Forms in which texts name an arXiv id, the most explicit first.
ARXIV = (r"(?i)arxiv[:\s/]+(\d{4}\.\d{4,5}(?:v\d+)?)", r"(?i)arxiv\.org/abs/(\d{4}\.\d{4,5}(?:v\d+)?)", r"\b(\d{4}\.\d{4,5})\b")


def bare_arxiv(column: ColumnOrName) -> Column:
    """An arXiv id without its version."""
    return F.regexp_replace(_c(column).cast("string"), r"v\d+$", "")


def arxiv_id(column: ColumnOrName) -> Column:
    """The arXiv id in a URL or text, or null."""
    return empty_to_null(F.regexp_extract(F.coalesce(_c(column), F.lit("")), r"(?i)arxiv(?:\.org)?(?:/(?:abs|pdf|html)/|[:/\s]\s*)(\d{4}\.\d{4,5})", 1))


def arxiv_ids(column: ColumnOrName) -> Column:
    """Distinct arXiv ids of a text whose year is 07 to 30 and month 01 to 12, in order of the pattern that finds them."""
    text = _c(column)
    found = F.transform(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in ARXIV)), bare_arxiv)

    def plausible(i: Column) -> Column:
        year, month = F.substring(i, 1, 2).cast("int"), F.substring(i, 3, 2).cast("int")
        return year.between(7, 30) & month.between(1, 12)

    return F.array_distinct(F.filter(found, plausible))


def first_url(column: ColumnOrName) -> Column:
    r"""\url, else \href, else a bare URL without closing punctuation; null for none."""
    c = _c(column)
    bare = F.regexp_replace(F.regexp_extract(c, r"https?://[^\s}\\]+", 0), "[.,;:]+$", "")
    return F.coalesce(
        empty_to_null(F.trim(F.regexp_extract(c, r"\\url\s*\{([^{}]+)\}", 1))),
        empty_to_null(F.trim(F.regexp_extract(c, r"\\href\s*\{([^{}]+)\}\s*\{", 1))),
        empty_to_null(bare),
    )


def bib_title(column: ColumnOrName) -> Column:
    """A bibliography entry's title: marked title, else quoted, else the second block, else the first 160 characters."""
    raw = _c(column)
    blocks = F.filter(F.transform(F.split(raw, r"\\newblock"), lambda x: strip(x)), lambda s: s != "")
    return F.coalesce(
        empty_to_null(clean_latex_fragment(F.regexp_extract(raw, r"(?s)\\bibinfo\s*\{\s*title\s*\}\s*\{([^{}]+)\}", 1))),
        empty_to_null(clean_latex_fragment(F.regexp_extract(raw, r"(?s)``([^`']{8,}?)''", 1))),
        F.regexp_replace(empty_to_null(clean_latex_fragment(F.get(blocks, F.lit(1)))), r"\.+$", ""),
        empty_to_null(F.substring(clean_latex_fragment(raw), 1, 160)),
        F.substring(raw, 1, 160),
    )


def last_name(column: ColumnOrName) -> Column:
    """An author's family name, lowered: the last word of two letters or more, before a comma if there is one."""
    c = _c(column)
    tokens = lambda x: F.regexp_extract_all(x, F.lit("[A-Za-zА-Яа-я]{2,}"), F.lit(0))
    head = F.when(F.instr(c, ",") > 0, F.try_element_at(tokens(F.substring_index(c, ",", 1)), F.lit(-1)))
    return F.lower(F.coalesce(head, F.try_element_at(tokens(c), F.lit(-1))))


#: Words that carry no content in a survey's title.
STOPWORDS = (
    "a an the and or of in on for to with from at by as is are via using towards survey review overview brief comprehensive systematic"
).split()


def keywords(column: ColumnOrName) -> Column:
    """Content words of a title before its first colon; all words where none is left."""
    tokens = F.regexp_extract_all(F.substring_index(_c(column), ":", 1), F.lit("[A-Za-z][A-Za-z0-9-]*"), F.lit(0))
    kept = F.filter(tokens, lambda t: ~F.lower(t).isin(STOPWORDS) & (F.length(t) >= 2))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def title_score(query: ColumnOrName, candidate: ColumnOrName) -> Column:
    """1 for equal titles, 0.9 where one holds the other, else 0, over lowered letters and digits; 0 if either is empty."""
    q, c = norm_alnum(query), norm_alnum(candidate)
    return (
        F.when(F.coalesce(q, F.lit("")).eqNullSafe("") | F.coalesce(c, F.lit("")).eqNullSafe(""), 0.0)
        .when(q == c, 1.0).when(q.contains(c) | c.contains(q), 0.9).otherwise(0.0)
    )


def title_score_words(query: ColumnOrName, candidate: ColumnOrName) -> Column:
    """As title_score, but titles that differ score their shared words over the larger word set."""
    q, c = F.array_distinct(F.split(norm_words(query), " ")), F.array_distinct(F.split(norm_words(candidate), " "))
    shared = F.size(F.array_intersect(q, c)) / F.greatest(F.size(q), F.size(c))
    base = title_score(query, candidate)
    return F.when((base == 0) & (norm_words(query) != "") & (norm_words(candidate) != ""), shared).otherwise(base)


def cache_key(*columns: ColumnOrName) -> Column:
    """SHA-256 of the parts joined by ||."""
    return F.sha2(F.concat_ws("||", *(_c(c).cast("string") for c in columns)), 256)


# --- composing -----------------------------------------------------------


def evidence_text(labels: list[str], columns: list[ColumnOrName], gap: str = "\n\n\n") -> Column:
    """Labelled parts that are not blank, joined by gap."""
    return F.concat_ws(gap, *(F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(f"{n}\n"), _c(c))) for n, c in zip(labels, columns)))


def paper_text(title: ColumnOrName, abstract: ColumnOrName, separator: str = "[SEP]") -> Column:
    """title + separator + abstract, nulls as empty."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.lit(separator), F.coalesce(_c(abstract), F.lit("")))


def excerpt(sentences: Column, i: Column, before: int, after: int, edge: str = "[...]") -> Column:
    """Sentence i (from 0) with those around it, one a line, with edge marks where the text goes on."""
    start, end = F.greatest(i - before, F.lit(0)), F.least(i + after + 1, F.size(sentences))
    mark = lambda there: F.when(there, F.array(F.lit(edge))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(mark(start > 0), F.slice(sentences, start + 1, end - start), mark(end < F.size(sentences)))
    return F.array_join(parts, "\n")


def neighbours(sentences: Column, i: Column, before: int, after: int) -> Column:
    """(before, after): the sentences next to sentence i (from 0), as far as there are any."""
    start = F.greatest(i - before, F.lit(0))
    return F.struct(F.slice(sentences, start + 1, i - start).alias("before"), F.slice(sentences, i + 2, F.lit(after)).alias("after"))


def snippet(sentences: Column, i: Column) -> Column:
    """Three sentences before, sentence i marked, one after; in texts of more than five sentences the first goes ahead."""
    some = lambda a, n: F.trim(F.array_join(F.slice(sentences, a + 1, n), " "))
    start = F.greatest(i - 3, F.lit(0))
    marked = F.concat(F.lit("<SOS>"), strip(F.get(sentences, i)), F.lit("<EOS>"))
    body = F.concat_ws(" ", some(start, i - start), marked, some(i + 1, F.lit(1)))
    lead = F.concat_ws(" ", F.when(F.size(sentences) > 5, F.trim(F.get(sentences, F.lit(0)))), body)
    return F.trim(lead)


def sentence_window(full_text: ColumnOrName, paragraph: ColumnOrName, radius: int = 10) -> Column:
    """Where a paragraph's sentences stand in a text, and the sentences around them; null if nowhere.

    First the exact run of sentences, then the first sentence contained in or
    containing one, then the first sentence found in the paragraph as a whole.
    Struct (text, window_start, window_end, paragraph_start, paragraph_end,
    total), sentences counted from 1.
    """
    full, para = split_sentences(full_text, drop_markers=False), split_sentences(paragraph, drop_markers=False)
    norm = F.transform(full, norm_sentence)
    wanted = F.filter(F.transform(para, norm_sentence), lambda s: s != "")

    def placed(x: Column) -> Column:
        n, w, f = x["n"], x["w"], x["f"]
        width = F.least(F.size(w), F.size(n))
        places = F.sequence(F.lit(1), F.size(n))
        first = lambda test: F.get(F.filter(places, test), F.lit(0))
        head = F.get(w, F.lit(0))
        at = F.coalesce(
            first(lambda i: (i + width - 1 <= F.size(n)) & (F.slice(n, i, width) == F.slice(w, 1, width))),
            first(lambda i: F.get(n, i - 1).contains(head) | head.contains(F.get(n, i - 1))),
            first(lambda i: (F.get(n, i - 1) != "") & F.array_join(w, " ").contains(F.get(n, i - 1))),
        )
        end = F.least(F.size(f), at - 1 + F.size(w))
        left, right = F.greatest(at - 1 - radius, F.lit(0)), F.least(F.size(f), end + radius)
        return F.when(
            at.isNotNull() & (F.size(w) > 0),
            F.struct(
                F.array_join(F.slice(f, left + 1, right - left), " ").alias("text"),
                (left + 1).alias("window_start"), right.alias("window_end"),
                at.alias("paragraph_start"), end.alias("paragraph_end"), F.size(f).alias("total"),
            ),
        )

    ready = F.when(
        (F.size(full) > 0) & (F.size(wanted) > 0), F.struct(norm.alias("n"), wanted.alias("w"), full.alias("f"))
    )
    return F.get(F.transform(F.filter(F.array(ready), lambda x: x.isNotNull()), placed), F.lit(0))


def truncate(column: ColumnOrName, most: int) -> Column:
    """The first `most` characters, with a note where more stood."""
    c = _c(column)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit(f"\n\n[... truncated at {most} chars ...]")))


def text_from_index(inverted: Column) -> Column:
    """The text of a map word -> array of positions; null for an empty map."""
    pairs = F.flatten(
        F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))
    )
    # no comparator in Spark's expressions, as array_sort has one
    return empty_to_null(collapse(F.array_join(F.transform(F.sort_array(pairs), lambda x: x["w"]), " ")))


def word_index(words: Column) -> Column:
    """A map of each of an array's words to its positions, ascending; each row by itself. Words and array are not null."""

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["w"] != F.get(s, i - 1)["w"]))
        return let(
            begins, lambda b: F.map_from_arrays(
                F.transform(b, lambda i: F.get(s, i)["w"]),
                F.transform(b, lambda i, k: F.transform(F.slice(s, i + 1, F.coalesce(F.get(b, k + 1), F.size(s)) - i), lambda x: x["p"])),
            ),
        )

    return let(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("p")))), runs)


def short_count(column: ColumnOrName) -> Column:
    """1234 as 1k, as run names write counts."""
    c = _c(column)
    return F.when(c >= 1000, F.concat(F.floor(c / 1000).cast("string"), F.lit("k"))).otherwise(c.cast("string"))


# --- model answers -------------------------------------------------------

#: The marks and phrases that judges' and extractors' answers are asked to use.
SCORE, WINNER = r"(?i)SCORE:\s*(\d+)", r"(?i)WINNER:\s*(A|B|TIE)"
BETTER_A, BETTER_B = r"(?i)\bSurvey A\b.*\bbetter\b", r"(?i)\bSurvey B\b.*\bbetter\b"
NO_CLAIM = "No verifiable claim."
FINAL = r"Final submission:\s*\n?(.+)"
VERIFIABLE, NOT_VERIFIABLE = "Contains a specific and verifiable proposition", "Does NOT"
REWRITTEN = r"(?s)Sentence with only verifiable information:\s*\n?(.*?)(?:\n\n|\z)"
DECONTEXTUALIZED, CANNOT = r"(?s)DecontextualizedSentence:\s*(.*?)(?:\n\n|\z)", "Cannot be decontextualized"
PROPOSITIONS = "Specific, Verifiable, and Decontextualized Propositions with Essential Context/Clarifications:"
TRUE_OR_FALSE = r"(?i)\s*-\s*true or false\?$"


def parse_score(column: ColumnOrName) -> Column:
    """"SCORE: n", else the last number from 0 to 10; at most 100; null for none."""
    c = _c(column)
    named = empty_to_null(F.regexp_extract(c, SCORE, 1)).cast("long")
    last = F.try_element_at(F.regexp_extract_all(c, F.lit(r"\b(10|[0-9])\b"), F.lit(1)), F.lit(-1)).cast("long")
    found = F.coalesce(named, last)
    return F.when(found.isNotNull(), F.least(found, F.lit(100))).cast("int")


def parse_winner(column: ColumnOrName) -> Column:
    """"WINNER: A|B|TIE", else which survey is called better; null for neither."""
    c = _c(column)
    return (
        F.when(c.rlike(WINNER), F.upper(F.regexp_extract(c, WINNER, 1)))
        .when(c.rlike(BETTER_A), "A")
        .when(c.rlike(BETTER_B), "B")
    )


def parse_level(column: ColumnOrName) -> Column:
    """A judge's single digit 0 to 5; null for anything else."""
    c = strip(column)
    return F.when(c.rlike("^[0-5]$"), c.cast("int"))


def parse_claim_lines(column: ColumnOrName) -> Column:
    """Claims of an answer, a line each, without bullets and numbers; none if it says there is no verifiable claim."""
    c = F.coalesce(_c(column), F.lit(""))
    lines = F.transform(
        F.split(c, "\n"), lambda s: F.regexp_replace(F.replace(strip(s), F.lit("- "), F.lit("")), r"^\d+\.?\s+", "")
    )
    kept = F.filter(lines, lambda s: (s != "") & ~s.startswith("Note:"))
    return F.when((c == "") | c.contains(NO_CLAIM), F.array().cast("array<string>")).otherwise(kept)


def parse_selection(answer: ColumnOrName, sentence: ColumnOrName) -> Column:
    """Selection stage: (ok, verifiable, sentence); ok is false without the final mark."""
    a = _c(answer)
    final = strip(F.regexp_extract(a, FINAL, 1))
    ok = a.rlike(FINAL)
    verifiable = final.contains(VERIFIABLE) & ~final.contains(NOT_VERIFIABLE)
    head = REWRITTEN
    text = strip(F.regexp_replace(F.regexp_replace(strip(F.regexp_extract(a, head, 1)), '^"+|"+$', ""), "^'+|'+$", ""))
    rewritten = (
        F.when(~a.rlike(head) | (F.lower(text) == "remains unchanged"), _c(sentence)).when((text == "") | (F.lower(text) == "none"), None).otherwise(text)
    )
    good = verifiable & rewritten.isNotNull()
    return F.struct(ok.alias("ok"), (ok & good).alias("verifiable"), F.when(ok & good, rewritten).alias("sentence"))


def parse_disambiguation(answer: ColumnOrName) -> Column:
    """Disambiguation stage: (ok, sentence); sentence is null where the text cannot stand alone."""
    a = _c(answer)
    pattern = DECONTEXTUALIZED
    text = strip(F.regexp_extract(a, pattern, 1))
    return F.struct(
        a.rlike(pattern).alias("ok"), F.when((text != "") & ~text.contains(CANNOT), text).alias("sentence")
    )


def parse_decomposition(answer: ColumnOrName) -> Column:
    """Decomposition stage: (ok, claims) from the JSON list after the last heading, without "true or false?" tails."""
    a = _c(answer)
    # reversed, the last heading is the first; substring_index counts from the right
    rest = strip(F.substring_index(a, PROPOSITIONS, -1))
    listed = F.regexp_extract(rest, r"(?s)\[(?:[^\"\]]|\"(?:[^\"\\]|\\.)*\")*\]", 0)
    json = _chain(listed, (r",\s*\]$", "]"), (r"\\([^\"\\/bfnrtu])", r"\\\\\\\\$1"))
    items = F.from_json(json, "array<string>")
    claims = F.filter(
        F.transform(items, lambda s: strip(F.regexp_replace(s, TRUE_OR_FALSE, ""))), lambda s: s.isNotNull() & (s != "")
    )
    ok = a.contains(PROPOSITIONS) & items.isNotNull()
    return F.struct(ok.alias("ok"), F.when(ok, claims).otherwise(F.array().cast("array<string>")).alias("claims"))
