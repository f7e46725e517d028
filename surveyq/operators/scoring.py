"""Per-survey scores from claim, judge and pair tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyq.functions import scores as S
from surveyq.functions import text as X
from surveyq.operators.quantiles import summarised
from surveyq.operators.scans import fresh, ranked

CATEGORIES = ("A", "B", "C", "D")


def citation_correctness(claims: DataFrame, by: list[str]) -> DataFrame:
    """by, n_claims, n_supported, cit_correct_overall and cit_correct_A to D.

    Three-valued support: a null stays in the denominator. A category without
    claims is null.
    """
    yes = F.coalesce(F.col("supported"), F.lit(False))
    per = [
        c for k in CATEGORIES for c in (
            F.count_if(F.col("category") == k).alias(f"n_{k}"),
            S.share(F.count_if((F.col("category") == k) & yes), F.count_if(F.col("category") == k)).alias(f"cit_correct_{k}"),
        )
    ]
    return claims.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(yes).alias("n_supported"),
        S.share(F.count_if(yes), F.count(F.lit(1))).alias("cit_correct_overall"), *per,
    )


def claim_failures(claims: DataFrame, by: list[str]) -> DataFrame:
    """by, n_no_evidence, n_scope_failed."""
    return claims.groupBy(*by).agg(
        F.count_if(F.coalesce(F.size("evidence_refs"), F.lit(0)) <= 0).alias("n_no_evidence"), F.count_if(F.coalesce("scope_failed", F.lit(False))).alias("n_scope_failed")
    )


def expert_profile(claims: DataFrame, by: list[str]) -> DataFrame:
    """by, n_claims, shares m_crit, m_comp_total, m_open, m_mod (entropy in nats of levels 1 to 5) and modality_dist.

    Null flags are false; a missing level is 1; levels outside 1 to 5 count nowhere.
    """
    flag = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double"))
    level = F.coalesce("modality_level", F.lit(1))
    counts = [F.count_if(level == k) for k in range(1, 6)]
    return claims.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_claims"), flag("is_critical").alias("m_crit"), flag("is_comparative").alias("m_comp_total"),
        flag("is_open_question").alias("m_open"), S.entropy(F.array(*counts)).alias("m_mod"),
        F.map_from_arrays(F.array(*(F.lit(k) for k in range(1, 6))), F.array(*counts)).alias("modality_dist"),
    )


def dedupe_claims(extracted: DataFrame, by: list[str]) -> DataFrame:
    """by, claim_id, claim, sources: equal claims once, with every sentence they came from, numbered as first seen.

    extracted(by, sentence_idx, claim_idx, sentence, claim). Numbers come from
    running counts over ranges, so a group of very many claims is many tasks.
    """
    first, = fresh([*by, "claim", "sources"], "first")
    once = extracted.groupBy(*by, "claim").agg(
        F.min(F.struct("sentence_idx", "claim_idx")).alias(first), F.array_sort(F.collect_list(F.struct("sentence_idx", "claim_idx", "sentence"))).alias("sources")
    )
    return ranked(once, by, [f"{first}.sentence_idx", f"{first}.claim_idx", "claim"], "claim_id").drop(first)


def majority(completions: DataFrame, by: list[str], need: int = 2) -> DataFrame:
    """by, text: the first successful of several completions, where at least `need` succeed."""
    ok = completions.where("ok")
    return ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n_ok"), F.min_by("text", "completion_no").alias("text")).where(F.col("n_ok") >= need)


def last_attempts(log: DataFrame, by: list[str]) -> DataFrame:
    """by, n_attempts and the last attempt's columns of a judge log."""
    rest = [c for c in log.columns if c not in by and c != "attempt_idx"]
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n_attempts"), F.max_by(F.struct(*rest), "attempt_idx").alias("r")).select(*by, "n_attempts", "r.*")


def score_stats(scores: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by and the mean, least and largest of each score."""
    return scores.groupBy(*by).agg(*(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "avg"), (F.min, "min"), (F.max, "max"))))


def pairwise_verdicts(calls: DataFrame, by: list[str]) -> DataFrame:
    """by, votes for A, B and tie, the verdict by votes, mean scores and the verdict by scores. calls(by, winner, score_a, score_b)."""
    n = lambda w: F.count_if(F.col("winner") == w)
    votes = calls.groupBy(*by).agg(
        n("A").alias("n_a"), n("B").alias("n_b"), n("TIE").alias("n_tie"), F.avg("score_a").alias("score_a"), F.avg("score_b").alias("score_b")
    )
    return votes.withColumns(
        {"cwr": S.verdict_by_votes(F.col("n_a"), F.col("n_b"), F.col("n_tie")), "swr": S.verdict_by_scores(F.col("score_a"), F.col("score_b"))}
    )


def win_rates(verdicts: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """by, win, tie, lose, unknown, win_rate."""
    n = lambda w: F.count_if(F.col(verdict) == w)
    table = verdicts.groupBy(*by).agg(n("win").alias("win"), n("tie").alias("tie"), n("lose").alias("lose"), n("unknown").alias("unknown"))
    return table.withColumn("win_rate", S.win_rate(F.col("win"), F.col("tie"), F.col("lose")))


def topic_pairs(generated: DataFrame, human: DataFrame, topic: str = "topic") -> DataFrame:
    """Generated and human surveys of one topic, each with each; topics hold a few of either."""
    g = generated.select(topic, *(F.col(c).alias(f"gen_{c}") for c in generated.columns if c != topic))
    h = human.select(topic, *(F.col(c).alias(f"human_{c}") for c in human.columns if c != topic))
    return g.join(h, topic)


def section_lengths(sections: DataFrame, by: list[str]) -> DataFrame:
    """by, n, n_failed, and quartiles of the length of what was found. sections(by, length), null where it failed."""
    quarters = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    found = summarised(
        sections, by, "length", quarters, F.count("length").alias("n"), F.count_if(F.col("length").isNull()).alias("n_failed"), F.avg("length").alias("mean"), F.max("length").alias("max")
    )
    return found.select(*by, "n", "n_failed", "mean", *quarters, "max")


def citation_quality(nli: DataFrame, by: list[str]) -> DataFrame:
    """by, citation_recall, citation_precision over statements and their citations.

    nli(by, statement, idx, all_entail, one_entails, rest_entail): recall is the
    share of statements that their citations together entail; a citation is
    precise in such a statement if it entails it alone, or if the rest doesn't.
    """
    useful = F.col("all_entail") & (F.col("one_entails") | ~F.col("rest_entail"))
    per = nli.groupBy(*by, "statement").agg(F.bool_or("all_entail").alias("ok"), F.count_if(useful).alias("good"), F.count("idx").alias("n"))
    return per.groupBy(*by).agg(F.avg(F.col("ok").cast("double")).alias("citation_recall"), S.share(F.sum("good"), F.sum("n")).alias("citation_precision"))


def eligible(df: DataFrame) -> DataFrame:
    """Successful generations with text."""
    return df.where(F.coalesce(F.col("success"), F.lit(False)) & X.blank_to_null("text").isNotNull())


def generation_flags(df: DataFrame, text: str = "text", error: str = "error", least: int = 200) -> DataFrame:
    """df with n_words and success (no error and more than `least` characters)."""
    return df.withColumns(
        {"n_words": X.word_count(text), "success": X.blank_to_null(error).isNull() & (F.length(F.coalesce(F.col(text), F.lit(""))) > least)}
    )


def cer(metric: Column, cost: Column) -> Column:
    """Metric per dollar; null without cost."""
    return F.when(cost > 0, metric / cost)


def claims_per_survey(claims: DataFrame, by: list[str]) -> DataFrame:
    """by, claims_per_survey (claims over distinct surveys) and n_surveys, from claims (by, survey_key, claim_id)."""
    return claims.groupBy(*by).agg((F.count(F.lit(1)) / F.countDistinct("survey_key")).alias("claims_per_survey"), F.countDistinct("survey_key").alias("n_surveys"))
