"""Interfaces of model-bound steps, offline backends, and the keyed cache before them.

A backend maps a frame to a frame, so that a served model or an Arrow UDF fits
as well as an expression. Offline backends are deterministic and need nothing;
they stand for the models' contracts, not for their quality.
"""

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from surveyq.functions import text as X
from surveyq.functions import vector as V
from surveyq.session import kept, scratch_folder


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...


class Nli(Protocol):
    def score(self, df: DataFrame, premise: str, hypothesis: str) -> DataFrame: ...


class Aligner(Protocol):
    def score(self, df: DataFrame, premise: str, claim: str, out: str) -> DataFrame: ...


class Judge(Protocol):
    def ask(self, df: DataFrame, prompt: str, out: str) -> DataFrame: ...


def _words(column: Column) -> Column:
    return F.filter(F.array_distinct(F.split(X.norm_words(column), " ")), lambda w: w != "")


@dataclass(frozen=True)
class HashEmbedder:
    """Bag of hashed words in `dims` signed dimensions. Words are hashed in the JVM and counted over Arrow."""

    dims: int = 256

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        dims = self.dims

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def count(hashes: pd.Series) -> pd.Series:
            def one(h: np.ndarray) -> np.ndarray:
                h = np.asarray(h, np.int64)
                sign = np.where((h >> 20) & 1, -1.0, 1.0)
                return np.bincount(h % dims, weights=sign, minlength=dims).astype(np.float32)

            return hashes.map(one)

        words = F.filter(F.split(X.norm_words(text), " "), lambda w: w != "")
        return df.withColumn(out, count(F.transform(words, lambda w: F.xxhash64(w))))


@dataclass(frozen=True)
class OverlapAligner:
    """Share of the claim's words that the premise has."""

    def score(self, df: DataFrame, premise: str, claim: str, out: str) -> DataFrame:
        share = lambda c: F.when(F.size(c) > 0, F.size(F.array_intersect(c, _words(F.col(premise)))) / F.size(c)).otherwise(0.0)
        return df.withColumn(out, X.let(_words(F.col(claim)), share))


#: Cells of a table of word weights.
CELLS = 1 << 16


def word_weights(df: DataFrame, text: str, cells: int = CELLS) -> np.ndarray:
    """Inverse document frequencies of hashed words, counted over all rows: a table of `cells` numbers, whatever the vocabulary.

    Words that share a cell share the weight of their common count, so a collision can only lower it.
    """
    cell = F.transform(_words(F.col(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(cells)).cast("int"))
    total = df.count()
    counts = df.select(F.explode(F.array_distinct(cell)).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toPandas()  # `cells` rows at most
    table = np.full(cells, np.log(1.0 + total) + 1.0)
    table[counts["cell"].to_numpy(int)] = np.log((1.0 + total) / (1.0 + counts["n"].to_numpy(float))) + 1.0
    return table


#: A word at so few places is aligned by numbers, others by arrays.
FEW = 3


def local_alignment(claim: np.ndarray, premise: np.ndarray, weight: np.ndarray, gap: float) -> float:
    """Weight of the best local alignment of two word sequences (Smith and Waterman, 1981).

    A matched word counts its weight, a claim word that is left out costs gap times its weight, a premise word gap. Only
    claim words that the premise has make a step, over their places there. What was left out is not subtracted
    step by step: `low` and `passed` are the costs up to a premise and a claim word, scores are kept with both
    added, and the best score before a place is a running maximum.
    """
    if not len(claim) or not len(premise):
        return 0.0
    order = np.argsort(premise, kind="stable")
    words, first = np.unique(premise[order], return_index=True)
    at = np.minimum(np.searchsorted(words, claim), len(words) - 1)
    low, passed = gap * np.arange(len(premise) + 1), gap * np.cumsum(weight)
    met = np.flatnonzero(words[at] == claim)
    begin, end = first[at[met]].tolist(), np.append(first[1:], len(premise))[at[met]].tolist()
    top, best, places = np.full(len(premise) + 1, -np.inf), 0.0, {}
    for a, b, w, spent in zip(begin, end, weight[met].tolist(), passed[met].tolist()):
        if a not in places:
            hit = order[a:b]
            places[a] = (hit, hit + 1, low[hit]) if b - a > FEW else hit.tolist()
        cost, gain = spent - gap * w, w + gap + gap * w
        if b - a > FEW:
            hit, after, paid = places[a]
            score = np.maximum(top[hit] - paid, cost)  # from the best before it, or from nothing
            best = max(best, float(score.max()) + w - cost)
            score += paid
            score += gain
            top[after] = np.maximum(top[after], score)
            rest = top[after[0] :]
            np.maximum.accumulate(rest, out=rest)
        else:
            # the same place by place; all are read before one is written
            scores = [max(float(top[h]) - gap * h, cost) for h in places[a]]
            best = max(best, max(scores) + w - cost)
            for h, score in zip(places[a], scores):
                score += gap * h + gain
                rest = top[h + 1 :]
                rest[: rest.searchsorted(score)] = score
    return best


@dataclass(frozen=True)
class OrderedAligner:
    """Share of the claim's word weights that the premise has in order: the best local alignment over their sum, 0 to 1.

    weights are those of word_weights, or None for words of equal weight. Words
    are hashed in the JVM and aligned over Arrow, in time of claim by premise and memory of the premise; null and empty texts score 0.
    """

    weights: np.ndarray | None = None
    gap: float = 0.1

    def score(self, df: DataFrame, premise: str, claim: str, out: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.weights)
        gap = self.gap

        @F.pandas_udf(T.DoubleType())
        def aligned(p: pd.Series, c: pd.Series) -> pd.Series:
            table = shared.value

            def one(premise, claim) -> float:
                if premise is None or claim is None or not len(claim):
                    return 0.0
                claim = np.asarray(claim, np.int64)
                weight = np.ones(len(claim)) if table is None else table[claim % len(table)]
                return local_alignment(claim, np.asarray(premise, np.int64), weight, gap) / float(weight.sum())

            return pd.Series([one(a, b) for a, b in zip(p, c)], dtype=float)

        hashed = lambda c: F.transform(F.filter(F.split(X.norm_words(c), " "), lambda w: w != ""), lambda w: F.xxhash64(w))
        return df.withColumn(out, aligned(hashed(premise), hashed(claim)))


@dataclass(frozen=True)
class OverlapNli:
    """entailment: overlap with the hypothesis; contradiction where exactly one side negates and overlap is high."""

    def score(self, df: DataFrame, premise: str, hypothesis: str) -> DataFrame:
        p, h = _words(F.col(premise)), _words(F.col(hypothesis))
        share = F.when(F.size(h) > 0, F.size(F.array_intersect(h, p)) / F.size(h)).otherwise(0.0)
        negated = lambda c: F.arrays_overlap(c, F.array(*map(F.lit, ("not", "no", "never", "cannot"))))
        against = F.when(negated(p) != negated(h), share).otherwise(0.0)
        agree = F.greatest(share - against, F.lit(0.0))
        return df.withColumns({"entailment": agree, "contradiction": against, "neutral": 1 - agree - against})


@dataclass(frozen=True)
class RuleJudge:
    """Answers by an expression over the prompt; status is failed where it gives none."""

    rule: Callable[[Column], Column]

    def ask(self, df: DataFrame, prompt: str, out: str) -> DataFrame:
        answer = self.rule(F.col(prompt))
        return df.withColumn(out, answer).withColumn(f"{out}_status", F.when(answer.isNull(), "failed").otherwise("ok"))


@dataclass(frozen=True)
class Retrying:
    """A judge that is asked again for what it failed to answer.

    Each round asks the prompts still without an answer, at most `at_once` of
    them side by side, and waits `wait` ** round seconds before the next. What
    fails `attempts` times gets what `on_failure` makes of the prompt, else the
    fallback, with the status fallback, or stays failed without either. Equal prompts are asked once; null prompts fail.
    Answers lie in the scratch folder, so none is asked for twice.
    """

    judge: Judge
    attempts: int = 3
    wait: float = 2.0
    fallback: str | None = None
    at_once: int | None = None
    on_failure: Callable[[Column], Column] | None = None

    def ask(self, df: DataFrame, prompt: str, out: str) -> DataFrame:
        spark, status = df.sparkSession, f"{out}_status"
        todo, answered = df.select(F.col(prompt).alias("__q")).where("__q IS NOT NULL").distinct(), []
        for k in range(1, self.attempts + 1):
            asked = todo if self.at_once is None else todo.repartition(self.at_once)
            path = scratch_folder(spark, "answers")
            self.judge.ask(asked, "__q", out).write.parquet(path)
            got = spark.read.parquet(path)
            answered.append(got.where(F.col(status) != "failed"))
            todo = got.where(F.col(status) == "failed").select("__q")
            if k == self.attempts or todo.isEmpty():
                break
            time.sleep(self.wait**k)
        every = answered[0]
        for more in answered[1:]:
            every = every.unionByName(more)
        joined = df.join(every.withColumnRenamed("__q", prompt), prompt, "left")
        instead = F.lit(self.fallback) if self.on_failure is None else F.coalesce(self.on_failure(F.col(prompt)), F.lit(self.fallback))
        late = F.when(instead.isNull(), "failed").otherwise("fallback")
        return joined.withColumns({out: F.when(F.col(status).isNull(), instead).otherwise(F.col(out)), status: F.coalesce(status, late)})


def validity_prompt(claim: Column, context: Column) -> Column:
    """What a judge of comparisons is shown: the claim's first 600 and the context's first 800 characters."""
    shown = F.coalesce(F.substring(X.blank_to_null(context), 1, 800), F.lit("Not available"))
    return F.concat(F.lit("Claim: "), F.substring(claim, 1, 600), F.lit("\nContext: "), shown)


def comparison_validity(answer: Column) -> Column:
    """A judge's JSON on a comparison as a struct (is_valid, invalidity_type); nulls where it can't be read."""
    parsed = F.from_json(X.first_json_object(X.strip_json_fence(answer)), "is_valid boolean, invalidity_type string")
    return F.struct(parsed["is_valid"].alias("is_valid"), parsed["invalidity_type"].alias("invalidity_type"))


def cached(requests: DataFrame, cache: DataFrame, key: str, answer: str, call: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Answers of all requests, and the cache rows to append.

    Requests of one key call once; keys in the cache don't call; a failed
    answer (status) is returned but not kept for the cache. call gets the
    missing requests and adds answer and `status`.
    """
    missing = requests.dropDuplicates([key]).join(cache.select(key), key, "left_anti")
    # written once, so that neither a second use nor a lost executor calls the backend again
    fresh = kept(call(missing).select(key, answer, "status"), "answers")
    known = cache.select(key, answer, F.lit("ok").alias("status"), F.lit(True).alias("from_cache"))
    answers = known.unionByName(fresh.withColumn("from_cache", F.lit(False)))
    return requests.join(answers, key, "left"), fresh.where(F.col("status") != "failed").select(key, answer)


def usage(log: DataFrame, by: list[str]) -> DataFrame:
    """by, calls, tokens and cost of judge calls; answers from the cache cost nothing. Missing numbers count as 0."""
    paid = ~F.coalesce(F.col("from_cache"), F.lit(False))
    total = lambda c: F.sum(F.when(paid, F.coalesce(F.col(c), F.lit(0))).otherwise(0))
    return log.groupBy(*by).agg(
        F.count_if(paid).alias("n_calls"), F.count_if(~paid).alias("n_cached"), total("in_tokens").alias("in_tokens"),
        total("out_tokens").alias("out_tokens"), total("cost_usd").alias("cost_usd"),
    )


def category(answer: Column) -> tuple[Column, Column]:
    """(category, confidence) of a judge's letter: A to D, anything else falls back to A with low confidence."""
    letter = F.upper(X.strip(F.coalesce(answer, F.lit(""))))
    good = letter.isin("A", "B", "C", "D")
    return F.when(good, letter).otherwise("A"), F.when(good, "high").otherwise("low")


def expert_flags(answer: Column) -> Column:
    """A judge's JSON on one claim as a struct; all false and level 1 where it can't be read."""
    schema = (
        "is_critical boolean, critical_type string, is_comparative boolean, compared_entities array<string>, "
        "is_open_question boolean, question_type string, modality_level int, hedging_markers array<string>"
    )
    parsed = F.from_json(X.strip_json_fence(answer), schema)
    no = F.lit(False)
    return F.struct(
        F.coalesce(parsed["is_critical"], no).alias("is_critical"), parsed["critical_type"].alias("critical_type"),
        F.coalesce(parsed["is_comparative"], no).alias("is_comparative"), parsed["compared_entities"].alias("compared_entities"),
        F.coalesce(parsed["is_open_question"], no).alias("is_open_question"), parsed["question_type"].alias("question_type"),
        F.coalesce(parsed["modality_level"], F.lit(1)).alias("modality_level"), parsed["hedging_markers"].alias("hedging_markers"),
        (parsed.isNull() | parsed["modality_level"].isNull()).alias("fell_back"),
    )


# --- alignment variants --------------------------------------------------


def align_concat(claims: DataFrame, aligner: Aligner, threshold: float = 0.5) -> DataFrame:
    """claims(…, claim, evidence array of (idx, text)) with alignscore, supported, evidence_refs: one premise for each claim."""
    some = F.size("evidence") > 0
    premise = F.array_join(F.transform("evidence", lambda e: e["text"]), "\n\n\n")
    scored = aligner.score(claims.withColumn("__p", F.when(some, premise)), "__p", "claim", "__s")
    score = F.when(some, F.col("__s"))
    return scored.withColumns(
        {"alignscore": score, "supported": score >= threshold, "evidence_refs": F.coalesce(F.transform("evidence", lambda e: e["idx"]), F.array().cast("array<int>"))}
    ).drop("__p", "__s")


def best_evidence(scored: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """keys, alignscore, supported, evidence_refs, per_ref, best_ref from (keys, idx, pos, score); the first of equal scores wins."""
    has = scored.where("score IS NOT NULL")
    return has.groupBy(*keys).agg(
        F.max("score").alias("alignscore"), (F.max("score") >= threshold).alias("supported"),
        F.max_by("idx", F.struct("score", (-F.col("pos")).alias("p"))).alias("best_ref"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx", "score"))), lambda x: F.struct(x["idx"].alias("idx"), x["score"].alias("score"))).alias("per_ref"),
    ).withColumn("evidence_refs", F.transform("per_ref", lambda r: r["idx"]))


def align_per_ref(claims: DataFrame, aligner: Aligner, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Each (claim, reference) pair scored apart; then best_evidence."""
    pairs = claims.select(*keys, "claim", F.posexplode("evidence").alias("pos", "e")).select(*keys, "claim", "pos", "e.idx", "e.text")
    found = best_evidence(aligner.score(pairs, "text", "claim", "score"), keys, threshold)
    return claims.join(found, keys, "left")


def align_cascade(
    pairs: DataFrame, aligner: Aligner, embedder: Embedder, keys: list[str], skip_at: float = 0.75, top_k: int = 5, chunk_words: int = 350, threshold: float = 0.5
) -> DataFrame:
    """Abstract first: pairs (keys, idx, pos, claim, abstract, full_text) scored on the abstract, and on the full text's best chunks below skip_at.

    The full text of a reference is split and embedded once, whatever the
    number of claims; chunks are ranked by cosine with the claim. The score is
    the larger of the two; evidence_source says which. Pairs are scored on the abstract once and written with a
    number; what is ranked are numbers and vectors, and texts meet again only for the chunks that were picked.
    """
    a, t = X.blank_to_null("abstract"), X.blank_to_null("full_text")
    first = aligner.score(pairs.withColumns({"abstract": a, "full_text": t}), "abstract", "claim", "__a")
    first = first.withColumn("abstract_score", F.when(F.col("abstract").isNotNull(), F.col("__a"))).drop("__a")
    first = kept(first.withColumns({"__i": F.monotonically_increasing_id(), "__ref": X.cache_key("full_text"), "__q": X.cache_key("claim")}), "cascade", compression="zstd")
    need = first.where(F.col("full_text").isNotNull() & (F.coalesce("abstract_score", F.lit(-1.0)) < skip_at) & F.col("claim").isNotNull())
    refs = need.select("__ref", "full_text").dropDuplicates(["__ref"])
    cut = X.word_chunks(X.split_sentences("full_text", 0, False), X.word_count("full_text"), chunk_words)
    chunked = kept(refs.select("__ref", cut.alias("chunks")), "chunks", compression="zstd")
    chunks = embedder.embed(chunked.select("__ref", F.posexplode("chunks").alias("c", "chunk")), "chunk", "cv").select("__ref", "c", "cv")
    claims = embedder.embed(need.select("__q", "claim").dropDuplicates(["__q"]), "claim", "qv").select("__q", "qv")
    asked = need.select("__i", "__ref", "__q").join(claims, "__q").join(chunks, "__ref").select("__i", "__ref", "c", V.cosine(F.col("cv"), F.col("qv")).alias("__s"))
    rank = F.row_number().over(Window.partitionBy("__i", "__ref").orderBy(F.desc("__s"), "c"))
    best = asked.withColumn("__r", rank).where(F.col("__r") <= top_k).groupBy("__i", "__ref").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    text = F.array_join(F.transform("cs", lambda c: F.get("chunks", c)), "\n\n")
    picked = need.select("__i", "claim", "abstract").join(best.join(chunked, "__ref").select("__i", text.alias("text")), "__i")
    premise = picked.withColumn("__p", X.evidence_text(["Abstract:", "Full text:"], ["abstract", "text"]))
    second = aligner.score(premise, "__p", "claim", "full_text_score").select("__i", "full_text_score")
    both = first.drop("claim", "__ref", "__q").join(second, "__i", "left")
    better = F.col("full_text_score") > F.coalesce("abstract_score", F.lit(-1.0))
    scored = both.withColumns(
        {
            "score": F.greatest("abstract_score", "full_text_score"),
            "evidence_source": F.when(better & F.col("abstract").isNotNull(), "full_text_or_abstract_top_k").when(better, "full_text_top_k").when(F.col("abstract_score").isNotNull(), "abstract"),
            "skipped_full_text": F.col("full_text").isNotNull() & (F.col("abstract_score") >= skip_at),
        }
    )
    found = best_evidence(scored, keys, threshold)
    # told apart by key, so that no claim is shuffled where none is asked for
    every = first.groupBy(*keys, "__q", F.col("claim").isNull().alias("__none")).agg(F.first("claim").alias("claim")).drop("__q", "__none").join(found, keys, "left")
    return every.join(scored.groupBy(*keys).agg(F.count_if("skipped_full_text").alias("n_abstract_skip")), keys, "left")


def align_cascade_concat(claims: DataFrame, aligner: Aligner, embedder: Embedder, keys: list[str], skip_at: float = 0.75, top_k: int = 5, threshold: float = 0.5) -> DataFrame:
    """As align_cascade at claim level: distinct abstracts of a claim as one premise, and all full texts as one."""
    grouped = claims.groupBy(*keys).agg(
        F.first("claim").alias("claim"), F.min("idx").alias("idx"), F.min("pos").alias("pos"),
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "abstract"))), lambda x: x["abstract"])), "\n\n\n").alias("abstract"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "full_text"))), lambda x: x["full_text"]), "\n\n\n").alias("full_text"),
    )
    return align_cascade(grouped, aligner, embedder, keys, skip_at, top_k, threshold=threshold)


def both_entail(pairs: DataFrame, nli: Nli, at_least: float = 0.5) -> DataFrame:
    """Pairs (…, s1, s2) whose sentences entail each other."""
    there = nli.score(pairs, "s1", "s2").withColumnRenamed("entailment", "__e1").drop("contradiction", "neutral")
    back = nli.score(there, "s2", "s1").withColumnRenamed("entailment", "__e2").drop("contradiction", "neutral")
    return back.where((F.col("__e1") >= at_least) & (F.col("__e2") >= at_least)).drop("__e1", "__e2")


def contradictions(pairs: DataFrame, topic: Judge, check: Judge, by: list[str], most: int = 400) -> DataFrame:
    """by, n_candidates, n_same_topic, n_confirmed, n_failed, m_contr from pairs (…, s1, s2).

    Pairs are filtered by topic, the rest is checked; a failed call is counted
    and left out of both. m_contr is null without pairs of one subject. A
    prompt has `most` characters of each side: 400 for sentences, 1800 for paragraphs.
    """
    prompt = F.concat(F.lit("1: "), F.substring("s1", 1, most), F.lit("\n2: "), F.substring("s2", 1, most))
    a = topic.ask(pairs.withColumn("__q", prompt), "__q", "same")
    b = check.ask(a, "__q", "contra")
    same = F.coalesce(F.col("same").cast("boolean") & (F.col("same_status") != "failed"), F.lit(False))
    ok = same & (F.col("contra_status") != "failed")
    return b.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(ok).alias("n_same_topic"),
        F.count_if(ok & F.col("contra").cast("boolean")).alias("n_confirmed"),
        F.count_if((F.col("same_status") == "failed") | (same & (F.col("contra_status") == "failed"))).alias("n_failed"),
    ).withColumn("m_contr", F.when(F.col("n_same_topic") > 0, F.col("n_confirmed") / F.col("n_same_topic")))


# --- overlap scores, from their published definitions ----------------------


def _longer(shorter: str, words: str, n: int) -> Column:
    """Hashes of a text's n-grams in order, from those of its grams of one word less."""
    return F.zip_with(F.slice(shorter, 1, F.greatest(F.size(shorter) - 1, F.lit(0))), F.slice(words, n, F.size(words)), lambda a, b: F.xxhash64(a, b))


def _shared(a: Column, b: Column) -> Column:
    """How many of the numbers of a are in b, each at most as often as there: one pass over both, sorted together."""
    side = lambda x, bit: F.transform(x, lambda v: v.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))
    zero = F.lit(0).cast("long")

    def step(s: Column, v: Column) -> Column:
        key, second = v.bitwiseAND(F.lit(-2)), v.bitwiseAND(F.lit(1)) == 1
        free = F.when(key == s["key"], s["free"]).otherwise(zero)
        hit = second & (free > 0)
        return F.struct(key.alias("key"), F.when(hit, free - 1).when(second, zero).otherwise(free + 1).alias("free"), F.when(hit, s["hits"] + 1).otherwise(s["hits"]).alias("hits"))

    begin = F.struct(F.lit(1).cast("long").alias("key"), zero.alias("free"), zero.alias("hits"))
    return F.aggregate(F.sort_array(F.concat(side(a, 0), side(b, 1))), begin, step, lambda s: s["hits"])


def _clipped(df: DataFrame, candidate: str, reference: str, orders: list[int]) -> DataFrame:
    """df with __hits<n>, __cand<n>, __ref<n> for each n: n-grams of the candidate that the reference has, each at most as often as there.

    Each row by itself, so that no text is shuffled. Grams count by 63 bits of a hash, so two of a pair of
    texts with a thousand grams are taken for one in about one of 10 ** 13 pairs.
    """
    hashed = lambda c: F.transform(F.filter(F.split(X.norm_words(c), " "), lambda w: w != ""), lambda w: F.xxhash64(w))
    out = df.withColumns({"__c1": hashed(candidate), "__r1": hashed(reference)})
    # a step a column, so that each is formed once
    for n in range(2, max(orders) + 1):
        out = out.withColumns({f"__{x}{n}": _longer(f"__{x}{n - 1}", f"__{x}1", n) for x in "cr"})
    sizes = {f"__{name}{n}": F.greatest(F.size(f"__{name[0]}1") - (n - 1), F.lit(0)).cast("long") for n in orders for name in ("cand", "ref")}
    told = {f"__hits{n}": _shared(F.col(f"__c{n}"), F.col(f"__r{n}")) for n in orders}
    return out.select(*df.columns, *(c.alias(name) for name, c in (sizes | told).items()))


def rouge_n(df: DataFrame, keys: list[str], candidate: str, reference: str, n: int) -> DataFrame:
    """keys, rouge_<n>: F1 of clipped n-gram overlap (Lin, 2004), a row each."""
    hit, total = F.col(f"__hits{n}"), F.col(f"__cand{n}") + F.col(f"__ref{n}")
    return _clipped(df, candidate, reference, [n]).select(*keys, F.when(total > 0, 2 * hit / total).otherwise(0.0).alias(f"rouge_{n}"))


def bleu(df: DataFrame, keys: list[str], candidate: str, reference: str, most: int = 4) -> DataFrame:
    """keys, bleu: geometric mean of clipped precisions to 4-grams with brevity penalty (Papineni et al., 2002), a row each; 0 if one is 0."""
    orders = list(range(1, most + 1))
    rates = {f"__p{n}": F.when(F.col(f"__cand{n}") > 0, F.col(f"__hits{n}") / F.col(f"__cand{n}")).otherwise(0.0) for n in orders}
    out = _clipped(df, candidate, reference, orders).withColumns(rates)
    logs = sum((F.ln(f"__p{n}") for n in orders[1:]), F.ln("__p1"))
    brief = F.when(F.col("__cand1") >= F.col("__ref1"), 1.0).otherwise(F.exp(1 - F.col("__ref1") / F.col("__cand1")))
    zero = F.array_min(F.array(*rates)) <= 0
    return out.select(*keys, F.when(zero, 0.0).otherwise(brief * F.exp(logs / most)).alias("bleu"))


def rouge_l(df: DataFrame, keys: list[str], candidate: str, reference: str) -> DataFrame:
    """keys, rouge_l: F1 of the longest common subsequence of words. One row at a time, linear memory; bit-parallel over words."""

    @F.pandas_udf(T.DoubleType())
    def score(c: pd.Series, r: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> float:
            a, b = a.split(), b.split()
            if not a or not b:
                return 0.0
            places: dict[str, int] = {}
            for i, w in enumerate(a):
                places[w] = places.get(w, 0) | 1 << i
            full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
            for w in b:
                m = row & places.get(w, 0)
                row = ((row + m) | (row - m)) & full
            lcs = len(a) - row.bit_count()
            return 2 * lcs / (len(a) + len(b))

        return pd.Series([one(x, y) for x, y in zip(c, r)], dtype=float)

    return df.select(*keys, score(X.norm_words(candidate), X.norm_words(reference)).alias("rouge_l"))


def _near_sums(tile: int = 1024, floor: float = V.FLOOR) -> Callable[[pa.Table], pa.Table]:
    """A function of two blocks of vectors that meet, or of one with itself: __i, and w and f, a vector's similarities to the other block's times their counts.

    Products of `tile` by `tile` vectors are formed at once. It carries all it needs, as workers may lack this package.
    """

    def sums(unit: pa.Table) -> pa.Table:
        x = unit["__v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(unit.num_rows, unit["__s"][0].as_py())
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), floor)
        counts = np.column_stack([unit[c].to_numpy() for c in ("__w", "__f")]).astype(float)
        out, (m, a, b) = np.zeros_like(counts), (unit[c].to_numpy() for c in ("__m", "__a", "__b"))
        tiles = lambda rows: [rows[k : k + tile] for k in range(0, len(rows), tile)]
        left, right = tiles(np.flatnonzero(m == a)), tiles(np.flatnonzero(m == b))
        for k, of in enumerate(left):
            # a product counts for both its tiles; in a block of its own each two tiles meet once
            for to in right if a[0] != b[0] else right[k:]:
                near = x[of] @ x[to].T
                np.maximum(near, 0.0, out=near)
                out[of] += near @ counts[to]
                if to[0] != of[0]:
                    out[to] += near.T @ counts[of]
        return pa.table({"__i": unit["__i"], "w": out[:, 0], "f": out[:, 1]})

    return sums


def soft_recall(wanted: DataFrame, found: DataFrame, by: list[str], vector: str = "embedding", block: int = 16384) -> DataFrame:
    """by, soft_recall: soft cardinality of the union's overlap (Franti and Mariescu-Istodor, 2023) over that of the wanted set.

    Soft cardinality of a set is the sum of 1 / sum of similarities to its own
    members, similarities below 0 as 0. Equal vectors of a group are one row
    with its counts in both sets; the rows are dealt into blocks by a hash of
    the vector, and each two blocks meet once under a key of their own, so no row or task holds a whole
    group. All pairs of a group are formed, as products of matrices of doubles in Python workers, a tile at a time;
    the sums of each vector are written, and what follows them stays in the JVM. Rows without a vector are in no set.
    """
    side = lambda df, w: df.select(*by, F.col(vector).alias("__v"), F.lit(w).alias("__w"), F.lit(1 - w).alias("__f"))
    every = side(wanted, 1).unionByName(side(found, 0)).where("__v IS NOT NULL")
    rows = every.groupBy(*by, "__v").agg(F.sum("__w").alias("__w"), F.sum("__f").alias("__f"))
    # a struct, so that a key of nulls joins as well; written, so that the numbers of rows are fixed
    rows = kept(rows.select(F.struct(*by).alias("__g"), "__v", "__w", "__f", F.monotonically_increasing_id().alias("__i")), "vectors")
    # written, so that few groups are known to be few, and vectors don't go through a shuffle to meet them
    sizes = kept(rows.groupBy("__g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__n")), "sizes")
    # vectors of unequal length or with a null are not near
    whole = rows.where(~F.exists("__v", lambda x: x.isNull())).withColumn("__s", F.size("__v")).join(sizes, "__g").withColumn("__m", F.pmod(F.xxhash64("__v"), "__n").cast("int"))
    other = whole.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    unit = ["__g", "__s", "__a", "__b"]
    met = other.select("__g", "__s", F.least("__m", "__o").alias("__a"), F.greatest("__m", "__o").alias("__b"), "__m", "__i", "__w", "__f", "__v")
    # by number, as the time of a task follows its pairs and not its bytes
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = met.repartition(tasks, *unit).groupBy(*unit).applyInArrow(_near_sums(), "__i long, w double, f double")
    part = kept(near.groupBy("__i").agg(F.sum("w").alias("w"), F.sum("f").alias("f")), "sums")
    none = F.lit(0.0)
    summed = rows.join(part, "__i", "left").withColumns({"w": F.coalesce("w", none), "f": F.coalesce("f", none)})
    size = lambda n, s: F.sum(F.when(n > 0, n / s).otherwise(0.0))
    w, f = F.col("__w"), F.col("__f")
    sums = summed.groupBy("__g").agg(size(w, F.col("w")).alias("a"), size(f, F.col("f")).alias("b"), size(w + f, F.col("w") + F.col("f")).alias("c"))
    return sums.where("a > 0").select(*(F.col("__g")[c].alias(c) for c in by), ((F.col("a") + F.col("b") - F.col("c")) / F.col("a")).alias("soft_recall"))
