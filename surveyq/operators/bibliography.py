"""LaTeX bibliographies: entries with nested brackets, BibTeX, and \\cite rewriting.

Balanced brackets are no regular language, so these three run as Arrow UDFs,
one text a row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyq.functions import text as X


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


_INT, _STR = T.IntegerType(), T.StringType()
_ITEM = T.ArrayType(_struct(idx=_INT, key=_STR, raw=_STR))
_BLOCK = re.compile(r"\\begin\s*\{thebibliography\}(.*?)\\end\s*\{thebibliography\}", re.S)
_PAIRS = {"[": "]", "{": "}"}


def balanced(s: str, at: int) -> int:
    """The place after the bracket that closes the one at `at`, or -1."""
    left, right, depth = s[at], _PAIRS[s[at]], 0
    for m in re.finditer(re.escape(left) + "|" + re.escape(right), s[at:]):
        depth += 1 if m[0] == left else -1
        if depth == 0:
            return at + m.end()
    return -1


def bib_items(tex: str | None) -> list[tuple[int, str, str]]:
    """(idx from 1, key, raw) of every \\bibitem[label]{key} of the bibliography; entries without a key are skipped."""
    block = _BLOCK.search(tex or "")
    out = []
    for chunk in block[1].split("\\bibitem")[1:] if block else []:
        s = chunk.lstrip()
        at = balanced(s, 0) if s.startswith("[") else 0
        if at < 0:
            continue
        s = s[at:].lstrip()
        end = balanced(s, 0) if s.startswith("{") else -1
        if end > 0:
            out.append((len(out) + 1, s[1 : end - 1].strip(), s[end:].strip()))
    return out


@F.pandas_udf(_ITEM)
def _items(tex: pd.Series) -> pd.Series:
    return tex.map(bib_items)


def parse_bibliography(df: DataFrame, tex: str, key: str) -> DataFrame:
    """(key, idx, cite_key, raw, title, canonical_title, url, arxiv_id) of each entry, numbered in order."""
    each = df.select(key, F.explode(_items(tex)).alias("i"))
    raw = F.col("i.raw")
    url = X.first_url(raw)
    return each.select(
        key, "i.idx", F.col("i.key").alias("cite_key"), raw.alias("raw"), X.bib_title(raw).alias("title"),
        X.empty_to_null(X.norm_words(X.bib_title(raw))).alias("canonical_title"), url.alias("url"), F.coalesce(X.arxiv_id(raw), X.arxiv_id(url)).alias("arxiv_id"),
    )


#: The citation commands that are rewritten.
_CITE = re.compile(
    r"\\(?:cite|citep|citet|citeauthor|citeyear|citealp|autocite|textcite|parencite|nocite)\*?(?:\[[^\]]*\]){0,2}\s*\{([^{}]*)\}"
)


def rewrite_cites(tex: str, places: dict[str, int]) -> tuple[str, int, int]:
    """\\cite{a,b} to [1][2]; unknown keys are dropped. Also the number of commands and of those with a known key."""
    seen = known = 0

    def replace(m: re.Match) -> str:
        nonlocal seen, known
        numbers = [places[k] for k in map(str.strip, m[1].split(",")) if k in places]
        seen, known = seen + 1, known + bool(numbers)
        return "".join(f"[{n}]" for n in numbers)

    return _CITE.sub(replace, tex), seen, known


@F.pandas_udf(_struct(text=_STR, n_cites=_INT, n_resolved=_INT))
def _rewritten(tex: pd.Series, keys: pd.Series) -> pd.DataFrame:
    rows = [rewrite_cites(t or "", {k["key"]: k["idx"] for k in (ks if ks is not None else [])}) for t, ks in zip(tex, keys)]
    return pd.DataFrame(rows, columns=["text", "n_cites", "n_resolved"])


def numbered_citations(df: DataFrame, tex: str, key: str) -> DataFrame:
    """(key, text, n_cites, n_resolved): the LaTeX with citations as numbers of its own bibliography."""
    keys = F.transform(_items(tex), lambda i: F.struct(i["key"].alias("key"), i["idx"].alias("idx")))
    return df.select(key, _rewritten(F.col(tex), keys).alias("r")).select(key, "r.*")


_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s}]*)\s*,?")
_FIELD = re.compile(r"([A-Za-z][\w-]*)\s*=\s*")


def bibtex_entries(source: str | None) -> list[dict]:
    """Fields of each BibTeX entry, names lowered, values without their outer braces or quotes."""
    out, s = [], source or ""
    for m in _ENTRY.finditer(s):
        if m[1].lower() in ("comment", "string", "preamble"):
            continue
        end = balanced(s, s.index("{", m.start()))
        body = s[m.end() : (end if end > 0 else len(s) + 1) - 1]
        fields, at = {"key": m[2]}, 0
        while f := _FIELD.search(body, at):
            i = f.end()
            if body[i : i + 1] == "{":
                stop = balanced(body, i)
                stop = stop if stop > 0 else len(body)
                value = body[i + 1 : stop - 1]
            elif body[i : i + 1] == '"':
                stop = body.find('"', i + 1)
                stop = stop + 1 if stop > 0 else len(body)
                value = body[i + 1 : stop - 1]
            else:
                stop = body.find(",", i)
                stop = stop if stop >= 0 else len(body)
                value = body[i:stop]
            fields[f[1].lower()] = value.strip().strip("{}")
            at = stop
        out.append(fields)
    return out


@F.pandas_udf(T.ArrayType(_struct(idx=_INT, title=_STR, url=_STR, eprint=_STR, archive=_STR)))
def _bibtex(source: pd.Series) -> pd.Series:
    return source.map(
        lambda s: [(i, e.get("title"), e.get("url"), e.get("eprint"), e.get("archiveprefix")) for i, e in enumerate(bibtex_entries(s), 1)]
    )


def parse_bibtex(df: DataFrame, source: str, key: str) -> DataFrame:
    """(key, idx, title, url, arxiv_id, canonical_title): arXiv ids from eprint where the archive is arXiv, else from the URL."""
    each = df.select(key, F.explode(_bibtex(source)).alias("e")).select(key, "e.*")
    number = r"(\d{4}\.\d{4,6})"
    found = F.coalesce(
        F.when(F.lower("archive") == "arxiv", X.empty_to_null(F.regexp_extract(F.coalesce("eprint", F.lit("")), number, 1))),
        F.when(F.col("url").contains("arxiv.org"), X.empty_to_null(F.regexp_extract("url", number, 1))),
    )
    return each.select(
        key, "idx", X.empty_to_null("title").alias("title"),
        F.coalesce(X.empty_to_null("url"), F.concat(F.lit("https://arxiv.org/abs/"), found), F.lit("")).alias("url"), found.alias("arxiv_id"),
        F.lit(None).cast("string").alias("canonical_title"),
    )
