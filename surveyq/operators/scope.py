"""Which citations support a claim: from its source sentence to a scope of text and the references cited there.

Everything is arithmetic on code point offsets inside one row (a text with its
headings as an array), so no range join is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyq.functions import text as X


def find_sentence(text: Column, sentence: Column, min_chars: int = 10) -> Column:
    """(offset, resolution) of a sentence: exact, or by its first 10, 5 or 3 words (fallback), or null."""
    words = F.split(X.collapse(sentence), " ")

    def anchor(k: int) -> Column:
        a = F.array_join(F.slice(words, 1, k), " ")
        usable = (F.length(a) >= min_chars) & ((F.size(words) >= k) | F.lit(k == 3))
        at = F.instr(text, a)
        return F.when(usable & (at > 0), at - 1)

    exact = F.when((sentence != "") & (F.instr(text, sentence) > 0), F.instr(text, sentence) - 1)
    loose = F.when(sentence != "", F.coalesce(anchor(10), anchor(5), anchor(3)))
    return F.when(exact.isNotNull(), F.struct(exact.alias("offset"), F.lit("exact").alias("resolution"))).when(
        loose.isNotNull(), F.struct(loose.alias("offset"), F.lit("fallback").alias("resolution"))
    )


def paragraph_span(text: Column, offset: Column) -> Column:
    """(start, end) of the paragraph, between blank lines, that holds offset."""
    # the last break that ends at or before offset, by the reversed head
    back = F.instr(F.reverse(F.substring(text, F.lit(1), offset)), "\n\n")
    ahead = F.instr(F.substring(text, offset + 1, F.length(text)), "\n\n")
    start = F.when((offset > 0) & (back > 0), offset - back + 1).otherwise(0)
    end = F.when(ahead > 0, offset + ahead - 1).otherwise(F.length(text))
    return F.struct(start.alias("start"), end.alias("end"))


def section_spans(headings: Column, length: Column, offset: Column, depth: int | None = None) -> Column:
    """Spans of the section that holds offset and of its `depth` nearest ancestors, outermost first.

    An ancestor's span ends at its next heading, so siblings are not in it.
    Before the first heading the span is the preamble; without headings it is
    the whole text. depth None takes all (levels 1 to 6 have at most five).
    """
    span = lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))
    own = F.try_element_at(F.filter(headings, lambda h: h["start"] <= offset), F.lit(-1))
    steps = 5 if depth is None else min(depth, 5)
    chain = F.array(own)

    def climb(chain: Column, _: Column) -> Column:
        top = F.element_at(chain, 1)
        parent = F.try_element_at(
            F.filter(headings, lambda h: (h["start"] < top["start"]) & (h["level"] < top["level"])), F.lit(-1)
        )
        return F.when(parent.isNull(), chain).otherwise(F.concat(F.array(parent), chain))

    if steps > 0:
        chain = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), chain, climb)
    first = F.get(headings, F.lit(0))
    whole = F.struct(F.lit(0).alias("start"), length.alias("end"))
    preamble = F.struct(F.lit(0).alias("start"), first["start"].alias("end"))
    return (
        F.when(F.size(headings) == 0, F.array(whole))
        .when(own.isNull(), F.array(preamble))
        .otherwise(F.transform(chain, span))
    )


def spans_citations(text: Column, spans: Column) -> Column:
    """Distinct citation numbers inside the spans, sorted."""
    found = F.transform(spans, lambda s: X.citations(F.substring(text, s["start"] + 1, s["end"] - s["start"])))
    return F.sort_array(F.array_distinct(F.flatten(found)))


def claim_sources(claims: DataFrame) -> DataFrame:
    """(survey_key, claim_id, claim, sentence, sentence_idx) from claims with sources, or with one source_sentence."""
    old = F.array(F.struct(F.col("source_sentence").alias("sentence"), F.lit(None).cast("int").alias("sentence_idx")))
    if "sources" not in claims.columns:
        sources = old
    elif "source_sentence" in claims.columns:
        sources = F.when(F.size("sources") > 0, F.col("sources")).otherwise(old)
    else:
        sources = F.col("sources")
    return claims.select("survey_key", "claim_id", "claim", F.explode_outer(sources).alias("s")).select(
        "survey_key", "claim_id", "claim", "s.sentence", "s.sentence_idx"
    )


def citation_union(refs: str) -> Column:
    """Aggregate: all citations of a group's lists, once, sorted."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(refs))))


def claim_scopes(claims: DataFrame, surveys: DataFrame, level: str = "section", depth: int | None = None) -> DataFrame:
    """survey_key, claim_id, claim, resolution, spans, scope_refs, scope_failed of each claim.

    claims(survey_key, claim_id, claim, sources); surveys(survey_key, text).
    level is "paragraph" or "section"; the scope of a claim with several source
    sentences is the union of theirs. A claim none of whose sentences is found
    has scope_failed true and no references.
    """
    texts = surveys.select("survey_key", "text", X.headings("text").alias("__h"))
    found = claim_sources(claims).join(texts, "survey_key").withColumn("at", find_sentence(F.col("text"), F.coalesce("sentence", F.lit(""))))
    offset = F.col("at.offset")
    spans = F.array(paragraph_span(F.col("text"), offset)) if level == "paragraph" else section_spans(F.col("__h"), F.length("text"), offset, depth)
    placed = found.withColumn("spans", F.when(F.col("at").isNotNull(), spans))
    cited = placed.withColumn("refs", F.when(F.col("spans").isNotNull(), spans_citations(F.col("text"), F.col("spans"))))
    return cited.groupBy("survey_key", "claim_id").agg(
        F.first("claim").alias("claim"),
        F.min("at.resolution").alias("resolution"),
        F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
        citation_union("refs").alias("scope_refs"),
        F.bool_and(F.col("at").isNull()).alias("scope_failed"),
    )


def scope_references(scopes: DataFrame, refs: DataFrame) -> DataFrame:
    """(survey_key, claim_id, idx, arxiv_id, semantic_scholar_id, doc_id): each cited number with its first reference, nulls where there is none."""
    from surveyq.operators.citations import first_per_idx

    first = first_per_idx(refs.select("survey_key", "pos", "idx", "arxiv_id", "semantic_scholar_id", "doc_id"), ["survey_key", "idx"]).drop("pos")
    return scopes.select("survey_key", "claim_id", F.explode("scope_refs").alias("idx")).join(first, ["survey_key", "idx"], "left")


def fully_covered(scope: Column, ids: Column) -> Column:
    """Whether a non-empty scope lies inside ids."""
    numbers = F.filter(F.transform(scope, lambda x: x.try_cast("int")), lambda x: x.isNotNull())
    return (F.size(numbers) > 0) & (F.size(F.array_except(numbers, ids)) == 0)
