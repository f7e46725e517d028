"""References joined to a paper corpus by title, and what follows from the matches.

Shapes: refs(survey_key, pos, idx, title, canonical_title, doc_id, ...),
corpus(doc_id, Title or title, Abstract or abstract), truth(survey_key, doc_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyq.functions import text as X
from surveyq.operators.scans import dealt, fresh
from surveyq.session import kept

#: Fixed value: so many tasks at most share one survey's papers.
SLICES = 16


def _first_present(df: DataFrame, *names: str) -> Column:
    """coalesce of the columns of these exact spellings that df has, empty strings as missing."""
    have = [X.empty_to_null(F.col(f"`{n}`")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def corpus_papers(corpus: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, abstract), either spelling of the corpus's columns; with ids only those doc_ids."""
    papers = corpus.select(
        F.col("doc_id").cast("long").alias("doc_id"), _first_present(corpus, "Title", "title").alias("title"),
        _first_present(corpus, "Abstract", "abstract").alias("abstract"),
    )
    return papers if ids is None else papers.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def corpus_texts(corpus: DataFrame) -> DataFrame:
    """(doc_id, text): title, blank line, abstract; papers with neither go."""
    return corpus_papers(corpus).select("doc_id", X.empty_to_null(F.concat_ws("\n\n", "title", "abstract")).alias("text")).where("text IS NOT NULL")


def title_index(corpus: DataFrame, order: str = "doc_id") -> DataFrame:
    """(norm_title, doc_id): one row for each title key; of several papers the one last in order."""
    keyed = corpus_papers(corpus).withColumn("norm_title", X.norm_title("title"))
    if order != "doc_id":
        keyed = keyed.join(corpus.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(order).alias("__order")), "doc_id")
    rank = F.col("doc_id" if order == "doc_id" else "__order")
    return keyed.where(F.col("norm_title") != "").groupBy("norm_title").agg(F.max_by("doc_id", rank).alias("doc_id"))


def match_references(refs: DataFrame, index: DataFrame) -> DataFrame:
    """refs with matched_doc_id: by canonical title, else by cleaned title, else null.

    Titles repeat, so each distinct pair of titles is cleaned and looked up
    once, and only pairs with a match are joined back. References without any title
    are dealt by a hash of the row, so that they don't meet in one partition of
    that join.
    """
    c, t, salt, tried = fresh([*refs.columns, "matched_doc_id"], "canon", "name", "salt", "tried")
    key = lambda x: X.empty_to_null(X.norm_title(x))
    pairs = refs.select(F.col("canonical_title").alias(c), F.col("title").alias(t)).distinct()
    each = pairs.select(c, t, F.posexplode(F.array(key(c), key(X.clean_web_title(t)))).alias(tried, "norm_title")).where("norm_title IS NOT NULL")
    hits = each.join(index.select("norm_title", "doc_id"), "norm_title").groupBy(c, t).agg(F.min_by("doc_id", tried).alias("matched_doc_id"))
    row = F.pmod(F.xxhash64(*(n for n, kind in refs.dtypes if "map<" not in kind)), F.lit(1 << 16))
    bare = (F.coalesce("canonical_title", F.lit("")) == "") & (F.coalesce("title", F.lit("")) == "")
    asked = refs.withColumn(salt, F.when(bare, row + 1).otherwise(0)).alias("r")
    found = asked.join(
        hits.withColumn(salt, F.lit(0).cast("long")).alias("h"),
        F.col("r.canonical_title").eqNullSafe(F.col(f"h.{c}")) & F.col("r.title").eqNullSafe(F.col(f"h.{t}")) & (F.col(f"r.{salt}") == F.col(f"h.{salt}")), "left",
    )
    return found.select(*(F.col(f"r.`{n}`") for n in refs.columns if n != "matched_doc_id"), "h.matched_doc_id")


def first_hit(candidates: DataFrame, index: DataFrame, key: str, titles: str) -> DataFrame:
    """(key, doc_id): the match of the first of an array of candidate titles that has one."""
    each = candidates.select(key, F.posexplode(titles).alias("pos", "t")).withColumn("norm_title", X.norm_title("t"))
    return each.join(index, "norm_title").groupBy(key).agg(F.min_by("doc_id", "pos").alias("doc_id"))


def self_citation(refs: DataFrame, surveys: DataFrame, key: str = "survey_key", title: str = "survey_title") -> DataFrame:
    """(key, self_cited, first_self_pos): whether a reference bears the survey's own title."""
    mine = surveys.select(key, X.empty_to_null(X.norm_title(title)).alias("__own"))
    names = refs.select(key, "pos", X.norm_title("canonical_title").alias("a"), X.norm_title(X.clean_web_title("title")).alias("b"))
    hits = names.join(mine, key).where((F.col("a") == F.col("__own")) | (F.col("b") == F.col("__own"))).groupBy(key).agg(F.min("pos").alias("first_self_pos"))
    return surveys.select(key).join(hits, key, "left").withColumn("self_cited", F.col("first_self_pos").isNotNull())


def first_per_idx(refs: DataFrame, keys: list[str]) -> DataFrame:
    """Of the references of one idx the first by pos."""
    rest = [c for c in refs.columns if c not in keys]
    picked = refs.groupBy(*keys).agg(F.min_by(F.struct(*rest), "pos").alias("__r"))
    return picked.select(*keys, "__r.*")


def reference_keys(refs: DataFrame, matched: str = "doc_id") -> DataFrame:
    """refs with ref_key: the doc id as text, else the title; idx falls back to the place from 1."""
    return refs.withColumns(
        {
            "idx": F.coalesce(F.col("idx").try_cast("int"), F.col("pos") + 1),
            "ref_key": F.coalesce(F.col(matched).cast("string"), X.empty_to_null("title")),
        }
    )


def cited_doc_ids(matched: DataFrame) -> DataFrame:
    """(doc_id): every paper that some reference matches, once."""
    return matched.where("matched_doc_id IS NOT NULL").select(F.col("matched_doc_id").alias("doc_id")).distinct()


def citation_metrics(surveys: DataFrame, matched: DataFrame, truth: DataFrame | str, key: str = "survey_key") -> DataFrame:
    """key, n_refs, n_matched, match_rate, n_truth, n_hit, coverage, coverage_distinct.

    truth is a table, or names a boolean column of matched that marks the
    references whose papers are the truth. coverage counts every matched
    reference, so papers cited twice count twice over the distinct truth and it
    can pass 1; coverage_distinct can't. Without references the rates are 0;
    without truth coverage is null.

    The rows are written once under the shared folder and dealt by their count,
    so that a task's memory doesn't grow with them; a large survey is dealt
    into slices of its papers.
    """
    doc, paper = F.col("__doc"), F.col("__doc").isNotNull()
    column = F.col(truth) if isinstance(truth, str) else F.lit(False)
    rows = matched.select(key, F.col("matched_doc_id").cast("long").alias("__doc"), F.lit(1).alias("__n"), F.coalesce(column, F.lit(False)).alias("__t"))
    if not isinstance(truth, str):
        rows = rows.unionAll(truth.select(key, F.col("doc_id").cast("long").alias("__doc"), F.lit(0).alias("__n"), F.lit(True).alias("__t")))
    # references without a paper have nothing to be told apart by and go to any slice
    piece = F.pmod(F.when(paper, F.xxhash64(doc)).otherwise(F.monotonically_increasing_id()), F.lit(SLICES)).cast("int")
    rows = kept(rows.withColumn("__slice", piece), "citations")
    count = rows.count()
    each = dealt(rows, count, key, "__slice").groupBy(key, "__slice", "__doc").agg(F.sum("__n").alias("__n"), F.bool_or("__t").alias("__t"))
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("__n"))), F.lit(0))
    sums = ("n_refs", "n_matched", "n_hit", "n_hit_distinct", "n_truth")
    slices = each.groupBy(key, "__slice").agg(
        F.sum("__n").alias("n_refs"), n(paper).alias("n_matched"), n(paper & F.col("__t")).alias("n_hit"),
        F.count_if(paper & F.col("__t") & (F.col("__n") > 0)).alias("n_hit_distinct"), F.count_if(paper & F.col("__t")).alias("n_truth"),
        F.bool_or(~paper & F.col("__t")).alias("__t"),
    )
    # truth without a paper counts once
    per = dealt(slices, count, key).groupBy(key).agg(*(F.sum(c).alias(c) for c in sums), F.bool_or("__t").cast("int").alias("__t")).withColumn("n_truth", F.col("n_truth") + F.col("__t"))
    out = dealt(surveys.select(key), count, key).join(per, key, "left").select(key, *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in sums))
    return out.select(
        key, "n_refs", "n_matched", "n_truth", "n_hit",
        F.when(F.col("n_refs") > 0, F.col("n_matched") / F.col("n_refs")).otherwise(0.0).alias("match_rate"),
        F.when(F.col("n_truth") > 0, F.col("n_hit") / F.col("n_truth")).alias("coverage"),
        F.when(F.col("n_truth") > 0, F.col("n_hit_distinct") / F.col("n_truth")).alias("coverage_distinct"),
    )


def enrich_references(refs: DataFrame, service: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """refs completed field by field from a service's records of the same keys; empty strings count as missing."""
    fields = ["title", "url", "arxiv_id", "semantic_scholar_id", "doi", "year"]
    other = service.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields if f in service.columns))
    out = refs.join(other, keys, "left")
    for f in fields:
        theirs = F.col(f"__{f}") if f"__{f}" in out.columns else F.lit(None).cast("string")
        ours = F.col(f) if f in refs.columns else F.lit(None).cast("string")
        blank = (lambda c: X.empty_to_null(c.cast("string"))) if f != "year" else (lambda c: c)
        out = out.withColumn(f, F.coalesce(blank(theirs), blank(ours)))
    out = out.drop(*(f"__{f}" for f in fields)).drop("doc_id")
    hit = index.select(F.col("norm_title").alias("__k"), "doc_id")
    return out.withColumn("__k", X.norm_title("title")).join(hit, "__k", "left").drop("__k")


def enrichment_counts(refs: DataFrame) -> DataFrame:
    """One row of how many references have each identifier."""
    has = lambda c: F.count_if(X.blank_to_null(F.col(c).cast("string")).isNotNull()).alias(f"n_{c}")
    return refs.agg(F.count(F.lit(1)).alias("n_refs"), *(has(c) for c in ("title", "url", "arxiv_id", "semantic_scholar_id", "doc_id")))


def pick_candidate(surveys: DataFrame, candidates: DataFrame, accept: float = 0.6, author_below: float = 0.9) -> DataFrame:
    """The best search candidate of each survey, by strategies in order.

    candidates(survey_key, priority, pos, title, year, authors array, arxiv_id).
    A title scores by title_score, plus 0.02 for the same year (at most 1);
    below author_below a family name has to be shared. Of the strategies with
    an accepted best, the one of smallest priority wins; ties go to the first.
    """
    both = candidates.join(
        surveys.select("survey_key", X.clean_latex_title("survey_title").alias("__q"), F.col("year").alias("__year"), F.col("authors").alias("__authors")), "survey_key"
    )
    names = lambda c: F.filter(F.transform(c, X.last_name), lambda n: n.isNotNull())
    base = X.title_score("__q", "title")
    score = F.when((X.empty_to_null("__year") == F.col("year")), F.least(F.lit(1.0), base + 0.02)).otherwise(base)
    agree = F.coalesce(F.arrays_overlap(names(F.col("__authors")), names(F.col("authors"))), F.lit(False))
    scored = both.withColumn("score", score).where((F.col("score") >= accept) & ((F.col("score") >= author_below) | agree))
    best = scored.groupBy("survey_key").agg(
        F.min_by(F.struct("arxiv_id", "title", "score", "priority"), F.struct("priority", (-F.col("score")).alias("s"), "pos")).alias("b")
    )
    return best.select("survey_key", "b.*")
