"""Evidence waterfalls: where each reference's abstract and text come from.

External services are tables that the caller supplies. Tiers are tried in
order; the first non-blank value wins; a miss stays in the result with the
trail of what was tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyq.functions import text as X
from surveyq.operators.quantiles import summarised
from surveyq.operators.scans import fresh


def evidence_key(df_arxiv: Column, df_ss: Column, df_doc: Column) -> Column:
    """arxiv:, ss: or doc: key of a reference, in this order; "unknown" without any id. A doc id of 0 is an id."""
    part = lambda name, c: F.concat(F.lit(f"{name}:"), X.blank_to_null(c.cast("string")))
    return F.coalesce(part("arxiv", X.bare_arxiv(df_arxiv)), part("ss", df_ss), part("doc", df_doc), F.lit("unknown"))


def identifier(doi: Column, arxiv: Column, ss: Column, title: Column) -> Column:
    """The one identifier to ask services with: DOI, arXiv id, paper id, title."""
    some = lambda name, c: F.concat(F.lit(f"{name}:"), X.blank_to_null(c.cast("string")))
    return F.coalesce(some("doi", doi), some("arxiv", X.bare_arxiv(arxiv)), some("ss", ss), some("title", title))


def waterfall(refs: DataFrame, tiers: list[tuple[str, DataFrame, str, str]], value: str = "abstract") -> DataFrame:
    """refs with value, `<value>_source` and `<value>_errors`.

    tiers: (label, table, key column in both, value column in the table). A
    tier without a row is tried in vain ("not_found"), one with a blank value
    as well ("empty"), and one for which the reference has no key is
    "no_identifier". The trail is what stands before the first hit and is null
    where there is a hit.
    """
    out = refs
    for i, (_, table, key, column) in enumerate(tiers):
        asked = refs.where(F.col(key).isNotNull()).select(F.col(key).alias(f"__a{i}")).distinct()
        rows = table.select(F.col(key).alias(f"__k{i}"), F.col(column).alias(f"__v{i}"))
        one = rows.join(asked, F.col(f"__k{i}") == F.col(f"__a{i}"), "left_semi").groupBy(f"__k{i}").agg(
            F.max(F.struct(X.blank_to_null(f"__v{i}").isNotNull().alias("some"), F.col(f"__v{i}").alias("v")))["v"].alias(f"__v{i}"), F.lit(True).alias(f"__r{i}")
        )
        out = out.join(one, F.col(key) == F.col(f"__k{i}"), "left")
    hits = [X.blank_to_null(f"__v{i}") for i in range(len(tiers))]
    source = F.coalesce(*(F.when(h.isNotNull(), F.lit(label)) for h, (label, *_) in zip(hits, tiers)))
    trail = F.array(
        *(
            F.struct(
                F.lit(label).alias("source"),
                F.when(F.col(key).isNull(), "no_identifier").when(F.col(f"__r{i}").isNull(), "not_found").otherwise("empty").alias("reason"),
            )
            for i, (label, _, key, _) in enumerate(tiers)
        )
    )
    return out.withColumns(
        {value: F.coalesce(*hits), f"{value}_source": source, f"{value}_errors": F.when(source.isNull(), trail)}
    ).drop(*(f"__{c}{i}" for i in range(len(tiers)) for c in "kvr"))


def reuse_resolved(cache: DataFrame, want_text: bool) -> DataFrame:
    """Cache rows that still answer: rows resolved for the abstract alone don't where the text is wanted."""
    return cache.where(~F.coalesce(F.col("abstract_only"), F.lit(False))) if want_text else cache


def fetch_plan(refs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The distinct keys that no cache row answers: many references, one fetch each."""
    return refs.where(F.col(key).isNotNull()).select(key).distinct().join(cache.select(key).distinct(), key, "left_anti")


def back_to_references(refs: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Every reference with what was fetched for its key; of repeated keys the last row by fetched_at."""
    rest = [c for c in fetched.columns if c != key]
    order = F.col("fetched_at") if "fetched_at" in fetched.columns else F.lit(0)
    last = fetched.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, "__r.*")
    return refs.join(last, key, "left")


def explode_evidence(files: DataFrame, version: int = 1) -> DataFrame:
    """(survey_key, ref, fields) of versioned evidence rows with a map refs; another version is an error."""
    checked = files.withColumn(
        "refs", F.when(F.col("schema_version") == version, F.col("refs")).otherwise(F.raise_error(F.lit(f"evidence schema version is not {version}")).cast(files.schema["refs"].dataType))
    )
    return checked.select("survey_key", F.explode("refs").alias("ref", "r")).select("survey_key", "ref", "r.*")


def refs_with_text(evidence: DataFrame) -> DataFrame:
    """(survey_key, ids): numbers of the references whose text is not blank."""
    return (
        evidence.where(X.blank_to_null("text").isNotNull()).withColumn("id", F.col("ref").try_cast("int")).where("id IS NOT NULL")
        .groupBy("survey_key").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    )


def claim_evidence(scoped: DataFrame, evidence: DataFrame, on: list[str]) -> DataFrame:
    """(survey_key, claim_id, evidence): the claim's references that have a text, by idx; misses are dropped."""
    hit = scoped.join(evidence, on).where(X.blank_to_null("text").isNotNull())
    return hit.groupBy("survey_key", "claim_id").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("evidence"))


def coverage(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Abstract and text coverage: counts, the 2 x 2 table, and lengths of texts."""
    a, t = X.blank_to_null("abstract").isNotNull(), X.blank_to_null("text").isNotNull()
    size = F.when(t, F.length("text").cast("double"))
    n = F.count(F.lit(1))
    length, = fresh(evidence.columns, "text_length")
    found = summarised(
        evidence.withColumn(length, size), by, length, {"text_median": 0.5},
        n.alias("n_refs"), F.count_if(a).alias("n_abstract"), F.count_if(t).alias("n_text"), F.count_if(a & t).alias("n_both"),
        F.count_if(a & ~t).alias("n_abstract_only"), F.count_if(~a & t).alias("n_text_only"), F.count_if(~a & ~t).alias("n_neither"),
        (F.count_if(t) / n).alias("text_rate"), F.min(size).alias("text_min"), F.avg(size).alias("text_mean"), F.max(size).alias("text_max"),
    )
    return found.select(*(c for c in found.columns if c not in ("text_median", "text_mean", "text_max")), "text_median", "text_mean", "text_max")


def source_histogram(evidence: DataFrame, source: str) -> DataFrame:
    return evidence.groupBy(F.coalesce(F.col(source), F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def error_summary(evidence: DataFrame, errors: str, by: list[str]) -> DataFrame:
    """by, summary: map source -> map reason -> count."""
    counts = evidence.select(*by, F.explode(errors).alias("e")).groupBy(*by, "e.source", "e.reason").agg(F.count(F.lit(1)).alias("n"))
    inner = counts.groupBy(*by, "source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("m"))
    return inner.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("source", "m"))).alias("summary"))


def rate_stats(coverage: DataFrame, rate: str) -> DataFrame:
    """n, mean, min, median and max of a per-survey rate."""
    found = summarised(coverage, [], rate, {"median": 0.5}, F.count(rate).alias("n"), F.avg(rate).alias("mean"), F.min(rate).alias("min"), F.max(rate).alias("max"))
    return found.select("n", "mean", "min", "median", "max")
