"""Bibliography entries matched to titles: substring scores, greedy one-to-one, conflicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from surveyq.functions import text as X
from surveyq.session import kept


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common substring, by a suffix automaton of a: time linear in both."""
    if not a or not b:
        return 0
    nxt: list[dict[str, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in a:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                copy = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    best = state = run = 0
    for c in b:
        while state and c not in nxt[state]:
            state = link[state]
            run = size[state]
        if c in nxt[state]:
            state, run = nxt[state][c], run + 1
        best = max(best, run)
    return best


@F.pandas_udf(T.DoubleType())
def lcs_ratio(title: pd.Series, entry: pd.Series) -> pd.Series:
    """Longest common substring over the title's length; 0 for an empty side."""
    return pd.Series([lcs_length(e, t) / len(t) if t and e else 0.0 for t, e in zip(title.fillna(""), entry.fillna(""))], dtype=float)


#: Lengths of the grams that the index holds; a title uses the longest that its least match allows.
GRAMS = (8, 4, 2, 1)


def _grams(text: str, q: Column) -> Column:
    """All grams of length q of a text that is at least as long."""
    return F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(F.col(text), i, q))


def _numbered_grams(text: str, q: int) -> Column:
    """The distinct grams of length q with q; none in a shorter text."""
    distinct = F.array_distinct(_grams(text, F.lit(q)))
    return F.when(F.length(text) >= q, F.transform(distinct, lambda g: F.struct(F.lit(q).alias("q"), g.alias("g")))).otherwise(F.array())


def gram_candidates(titles: DataFrame, entries: DataFrame, at_least: float) -> DataFrame:
    """(survey_key, t, e): titles t and entries e of a survey that may share a substring of at_least of the title's length; none such is left out.

    A common substring of length m holds m - q + 1 grams of length q that follow each other, so one of
    them lies at a place of each residue modulo m - q + 1. A title looks up the
    grams of one residue only, the one whose grams are in the fewest entries.
    """
    n = F.length("t")
    told = titles.select("survey_key", "t", F.greatest(F.ceil(at_least * n - 1e-9), F.lit(1)).cast("int").alias("need")).where(F.col("need") <= n)
    longest = F.coalesce(*(F.when(F.col("need") >= q, q) for q in GRAMS))
    told = told.withColumn("q", longest)
    used = [r.q for r in told.select("q").distinct().collect()]  # four at most
    if not used:
        return titles.join(entries, "survey_key").where("false").select("survey_key", "t", "e")
    each = F.flatten(F.array(*(_numbered_grams("e", q) for q in used)))
    index = kept(entries.select("survey_key", "e", F.explode(each).alias("x")).select("survey_key", "e", "x.q", "x.g"), "grams")
    held = index.groupBy("survey_key", "q", "g").agg(F.count(F.lit(1)).alias("n_entries"))
    placed = told.select("survey_key", "t", "q", (F.col("need") - F.col("q") + 1).alias("step"), F.posexplode(_grams("t", F.col("q"))).alias("at", "g"))
    by_residue = placed.join(held, ["survey_key", "q", "g"], "left").groupBy("survey_key", "t", "q", (F.col("at") % F.col("step")).alias("residue")).agg(
        F.sum(F.coalesce("n_entries", F.lit(0))).alias("cost"), F.collect_set(F.when(F.col("n_entries").isNotNull(), F.col("g"))).alias("gs")
    )
    chosen = by_residue.groupBy("survey_key", "t", "q").agg(F.min_by("gs", F.struct("cost", "residue")).alias("gs"))
    return chosen.select("survey_key", "t", "q", F.explode("gs").alias("g")).join(index, ["survey_key", "q", "g"]).select("survey_key", "t", "e").distinct()


def _normed(entries: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries (survey_key, k, e) and titles (survey_key, j, t) by their words; titles without any go."""
    return entries.select("survey_key", "k", X.norm_words("raw").alias("e")), titles.select("survey_key", "j", X.norm_words("title").alias("t")).where("t <> ''")


def _scored_texts(entries: DataFrame, titles: DataFrame, at_least: float) -> DataFrame:
    """(survey_key, t, e, score): the distinct texts of a survey that score at_least, each pair once."""
    each_e, each_t = entries.select("survey_key", "e").distinct(), titles.select("survey_key", "t").distinct()
    may = gram_candidates(each_t, each_e, at_least) if at_least > 0 else each_t.join(each_e, "survey_key")
    return may.withColumn("score", lcs_ratio("t", "e")).where(F.col("score") >= at_least)


def score_pairs(entries: DataFrame, titles: DataFrame, at_least: float) -> DataFrame:
    """(survey_key, k, j, score) of a survey's entries (k, raw) and titles (j, title) that score at_least.

    Each distinct text is looked up and scored once; candidates come from an
    index of grams, unless at_least is 0 or less and every pair counts. Titles
    without letters or digits are in no pair; null texts are empty. Copies are
    told as pairs of their own, which is the square of their number: title_links counts them instead.
    """
    a, b = _normed(entries, titles)
    scored = _scored_texts(a, b, at_least)
    return scored.join(b, ["survey_key", "t"]).join(a, ["survey_key", "e"]).select("survey_key", "k", "j", "score")


def title_links(entries: DataFrame, titles: DataFrame, at_least: float) -> DataFrame:
    """(survey_key, j, n_entries, sum_k, best): what score_pairs has for each title with a pair, by count, sum of k and best score.

    Entries of one text are one row with their count and sum before texts
    meet, so copies are in the figures and not in pairs.
    """
    a, b = _normed(entries, titles)
    held = a.groupBy("survey_key", "e").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    of_text = _scored_texts(a, b, at_least).join(held, ["survey_key", "e"]).groupBy("survey_key", "t").agg(
        F.sum("n").alias("n_entries"), F.sum("k").alias("sum_k"), F.max("score").alias("best")
    )
    return b.join(of_text, ["survey_key", "t"]).groupBy("survey_key", "j").agg(
        F.sum("n_entries").alias("n_entries"), F.sum("sum_k").alias("sum_k"), F.max("best").alias("best")
    )


def greedy_match(pairs: DataFrame) -> DataFrame:
    """(survey_key, k, j, score): best pairs first (then k, j), each k and j once.

    In rounds: a pair that is the best of its k and of its j is what the greedy
    choice takes, whatever comes before it; it is taken and the pairs of its ends go. A
    round is two aggregates and joins, so a survey is no single task; rounds
    end when no pair is left. Scores are not null.
    """
    key = F.struct((-F.col("score")).alias("s"), F.col("k"), F.col("j"))
    left = kept(pairs.select("survey_key", "k", "j", "score").distinct(), "pairs")
    taken = []
    while not left.isEmpty():
        of_k = left.groupBy("survey_key", "k").agg(F.min(key).alias("b")).select("survey_key", "k", "b.j", (-F.col("b.s")).alias("score"))
        of_j = left.groupBy("survey_key", "j").agg(F.min(key).alias("b")).select("survey_key", "b.k", "j")
        taken.append(kept(of_k.join(of_j, ["survey_key", "k", "j"]).select("survey_key", "k", "j", "score"), "taken"))
        left = kept(left.join(taken[-1].select("survey_key", "k"), ["survey_key", "k"], "left_anti").join(taken[-1].select("survey_key", "j"), ["survey_key", "j"], "left_anti"), "pairs")
    out = left.select("survey_key", "k", "j", "score")
    for t in taken:
        out = out.unionByName(t)
    return out


def resolve_conflicts(picks: DataFrame) -> DataFrame:
    """(survey_key, k, j, score, losers): of titles j that picked one entry k the best, then the smallest j; the others listed."""
    every = picks.groupBy("survey_key", "k").agg(
        F.max_by(F.struct("j", "score"), F.struct("score", (-F.col("j")).alias("nj"))).alias("w"), F.collect_list("j").alias("js")
    )
    return every.select("survey_key", "k", "w.j", "w.score", F.array_sort(F.array_except("js", F.array("w.j"))).alias("losers"))


def unmatched(entries: DataFrame, titles: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries and titles that the mapping leaves over."""
    return (
        entries.join(mapping.select("survey_key", "k"), ["survey_key", "k"], "left_anti"),
        titles.join(mapping.select("survey_key", "j"), ["survey_key", "j"], "left_anti"),
    )


def top_entries(pairs: DataFrame, k: int) -> DataFrame:
    """The k best entries of each title."""
    w = Window.partitionBy("survey_key", "j").orderBy(F.desc("score"), "k")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def match_statistics(entries: DataFrame, titles: DataFrame, mapping: DataFrame) -> DataFrame:
    """survey_key, n_entries, n_titles, n_matched, entry_rate, title_rate, mean_score, fetchable and its rate."""
    fetch = X.blank_to_null(F.col("arxiv_id")).isNotNull() if "arxiv_id" in titles.columns else F.lit(False)
    e = entries.groupBy("survey_key").agg(F.count(F.lit(1)).alias("n_entries"))
    t = titles.groupBy("survey_key").agg(F.count(F.lit(1)).alias("n_titles"), F.count_if(fetch).alias("n_fetchable"))
    m = mapping.groupBy("survey_key").agg(F.count(F.lit(1)).alias("n_matched"), F.avg("score").alias("mean_score"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    rate = lambda a, b: F.when(b > 0, a / b)
    return e.join(t, "survey_key", "full").join(m, "survey_key", "left").select(
        "survey_key", *(z(c).alias(c) for c in ("n_entries", "n_titles", "n_matched", "n_fetchable")), "mean_score",
        rate(z("n_matched"), z("n_entries")).alias("entry_rate"), rate(z("n_matched"), z("n_titles")).alias("title_rate"),
        rate(z("n_fetchable"), z("n_titles")).alias("fetchable_rate"),
    )
