"""Sentence splitting with a model that is trained on the corpus without labels.

After Kiss and Strunk (Unsupervised Multilingual Sentence Boundary Detection,
2006). A word that ends in a period more often than chance is an abbreviation,
the more so the shorter it is and the more periods it holds; words that begin sentences more often than
chance are starters; pairs around a period that meet more often than chance are
collocations. All counts are aggregates over the whole corpus, one model for
each language; only the words that pass their thresholds are the model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyq.operators.scans import fresh
from surveyq.session import kept

#: Thresholds of the published method.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Most entries of a model that is sent to the executors.
MOST_ENTRIES = 1_000_000

#: A word: what stands between white space without punctuation around it but for final periods.
_LEAD, _TRAIL = r"^[^\p{L}\p{N}]+", r"[^\p{L}\p{N}.]+$"
_NUMBER = r"^[\p{N}.,]*\p{N}[\p{N}.,]*$"
_MARKED = r"[?!][^\p{L}\p{N}]*$"


def _core(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, _LEAD, ""), _TRAIL, "")


def _type(core: Column) -> Column:
    """What a word counts as: lower case, without its final period; all numbers are one."""
    bare = F.lower(F.regexp_replace(core, r"\.$", ""))
    return F.when(bare.rlike(_NUMBER), F.lit("##")).otherwise(bare)


def _raw_words(text: str) -> Column:
    """What stands between white space and has a letter or digit."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def word_uses(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, type, period, n): uses of each word as it is written; equal words are counted before any pattern runs."""
    each = docs.select(F.col(lang).alias("lang"), F.explode(_raw_words(text)).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    cored = each.select("lang", "n", _core(F.col("w")).alias("core"))
    return cored.select("lang", _type(F.col("core")).alias("type"), F.endswith("core", F.lit(".")).alias("period"), "n")


def word_pairs(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, type, period, marked, upper, lower, p_type, p_period, p_marked, n): each word with the word before it in its text, n times.

    p_* is the word before; null at the start of a text, and of an empty type
    where that word has no period, ? or !, whatever it is. marked words end in ? or !. Equal pairs are counted as they
    are written, before any pattern runs.
    """
    told = docs.select(F.col(lang).alias("lang"), _raw_words(text).alias("w"))
    before = lambda i: F.get(F.col("w"), i - 1)
    pair = F.transform("w", lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.when(before(i).rlike("[.?!]"), before(i)).otherwise("")).alias("p")))
    each = told.select("lang", F.explode(pair).alias("e")).groupBy("lang", F.col("e.w").alias("w"), F.col("e.p").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    cored = each.select("lang", "n", _core(F.col("w")).alias("core"), _core(F.col("p")).alias("p_core"), F.rlike("w", F.lit(_MARKED)).alias("marked"), F.rlike("p", F.lit(_MARKED)).alias("p_marked"))
    first = F.substring("core", 1, 1)
    return cored.select(
        "lang", _type(F.col("core")).alias("type"), F.endswith("core", F.lit(".")).alias("period"), "marked", (first != F.lower(first)).alias("upper"), (first != F.upper(first)).alias("lower"),
        _type(F.col("p_core")).alias("p_type"), F.endswith("p_core", F.lit(".")).alias("p_period"), "p_marked", "n",
    )


def _safe(x: Column) -> Column:
    """A share kept from 0 and 1, where its logarithm ends."""
    return F.greatest(F.least(x, F.lit(1 - 1e-12)), F.lit(1e-12))


def _log(k: Column, n: Column, p: Column) -> Column:
    return k * F.log(_safe(p)) + (n - k) * F.log(1 - _safe(p))


def abbreviation_score(total: Column, period: Column, words: Column, periods: Column, type_: Column) -> Column:
    """How much more likely a word's periods are if it is an abbreviation, weighed by its length, inner periods and uses without a period."""
    chance = periods / words
    ratio = 2 * (_log(period, total, F.lit(0.99)) - _log(period, total, chance))
    inner = F.length(type_) - F.length(F.replace(type_, F.lit("."), F.lit("")))
    letters = F.length(type_) - inner
    return ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -(total - period).cast("double"))


def together_score(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio that b follows a more or less often than chance."""
    rest = n - a
    p, p1, p2 = b / n, ab / a, F.when(rest > 0, (b - ab) / rest).otherwise(0.0)
    return 2 * (_log(ab, a, p1) + _log(b - ab, rest, p2) - _log(ab, a, p) - _log(b - ab, rest, p))


def word_types(uses: DataFrame) -> DataFrame:
    """(lang, type, n, k, words, periods, score) of word_uses or word_pairs: each word's uses, those with a period, the language's sums, and its score as an abbreviation.

    Words without a letter or a period score null.
    """
    types = kept(uses.groupBy("lang", "type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("period"), F.col("n")).otherwise(0)).alias("k")), "types")
    sums = types.groupBy("lang").agg(F.sum("n").alias("words"), F.sum("k").alias("periods"))  # a row a language
    all_of = types.alias("t").join(F.broadcast(sums.alias("s")), _same("t", "s")).select("t.*", "words", "periods")
    score = abbreviation_score(F.col("n"), F.col("k"), F.col("words"), F.col("periods"), F.col("type"))
    return all_of.withColumn("score", F.when(F.col("type").rlike(r"\p{L}") & (F.col("k") > 0), score))


def _same(x: str, y: str) -> Column:
    return F.col(f"{x}.lang").eqNullSafe(F.col(f"{y}.lang"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, a, b, score): the model of each language.

    Kinds: abbreviation a; starter a; collocation (a, b); lower and upper: a word a that
    follows unsure periods is seen in that case, upper only inside sentences. Null languages are one language; null and empty
    texts have no words. The corpus is read once; what is kept of it are counts of words and of pairs around periods.
    """
    pairs = kept(word_pairs(docs, text, lang), "pairs")
    types = word_types(pairs)
    abbreviations = kept(types.where(F.col("score") >= ABBREVIATION).select("lang", "type", "score"), "abbreviations")
    known = checked(abbreviations).select("lang", F.col("type").alias("abbreviation"))
    seen = pairs.alias("w").join(F.broadcast(known.alias("a")), [_same("w", "a"), F.col("p_type") == F.col("abbreviation")], "left").select("w.*", "abbreviation")
    # what stands before a word: nothing, a sentence's end, or a period that may belong to the word before
    unsure = F.coalesce(F.col("p_period") & (F.col("abbreviation").isNotNull() | F.col("p_type").rlike(r"^\p{L}$") | (F.col("p_type") == "##")), F.lit(False))
    after = F.coalesce(F.col("p_marked") | (F.col("p_period") & ~unsure), F.lit(False))
    told = seen.withColumns({"unsure": unsure, "after": after, "first": F.col("p_type").isNull() | after})
    counts = kept(
        told.groupBy("lang", "type", F.when(F.col("unsure"), F.col("p_type")).alias("before")).agg(
            F.sum("n").alias("n"), F.sum(F.when(F.col("after"), F.col("n")).otherwise(0)).alias("after"), F.bool_or("lower").alias("lower"),
            F.bool_or(F.col("upper") & ~F.col("first") & ~F.col("unsure")).alias("upper"),
        ), "words",
    )
    counted = counts.groupBy("lang", "type").agg(
        F.sum("n").alias("n"), F.sum("after").alias("after"), F.bool_or(F.col("before").isNotNull()).alias("asked"), F.bool_or("lower").alias("lower"), F.bool_or("upper").alias("upper")
    )
    sums = counted.groupBy("lang").agg(F.sum("after").alias("ends"), F.sum("n").alias("words"))
    led = counted.where((F.col("after") > 0) & F.col("type").rlike(r"\p{L}")).alias("t").join(F.broadcast(sums.alias("s")), _same("t", "s")).select("t.*", "ends", "words")
    starters = led.withColumn("score", together_score(F.col("ends"), F.col("n"), F.col("after"), F.col("words"))).where(
        (F.col("score") >= STARTER) & (F.col("after") / F.col("ends") > F.col("n") / F.col("words"))
    )
    sizes = types.select("lang", "type", F.col("n").alias("size"), "words")
    around = counts.where("before IS NOT NULL AND n > 1").select("lang", "before", "type", F.col("n").alias("ab"))
    joined = (
        around.alias("r").join(sizes.alias("x"), [_same("r", "x"), F.col("r.before") == F.col("x.type")])
        .join(sizes.alias("y"), [_same("r", "y"), F.col("r.type") == F.col("y.type")])
        .join(starters.alias("z"), [_same("r", "z"), F.col("r.type") == F.col("z.type")], "left_anti")
        .select("r.*", F.col("x.size").alias("na"), F.col("y.size").alias("nb"), F.col("x.words").alias("words"))
    )
    together = joined.withColumn("score", together_score(F.col("na"), F.col("nb"), F.col("ab"), F.col("words"))).where(
        (F.col("score") >= COLLOCATION) & (F.col("words") / F.col("na") > F.col("nb") / F.col("ab"))
    )

    def entries(df: DataFrame, kind: str, a: str = "type", b: Column | None = None, score: Column | None = None) -> DataFrame:
        second = F.lit(None).cast("string") if b is None else b
        return df.select("lang", F.lit(kind).alias("kind"), F.col(a).alias("a"), second.alias("b"), (F.col("score") if score is None else score).alias("score"))

    out = entries(abbreviations, "abbreviation").unionByName(entries(starters, "starter")).unionByName(entries(together, "collocation", "before", F.col("type")))
    for case in ("lower", "upper"):
        out = out.unionByName(entries(counted.where(F.col("asked") & F.col(case)), case, score=F.lit(0.0)))
    return kept(out, "sentence-model")


def checked(entries: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """entries, which are about to be sent to all executors; an error if they are too many."""
    if entries.limit(most + 1).count() > most:
        raise ValueError(f"a sentence model of more than {most} entries is not sent to executors; train on fewer languages at a time")
    return entries


@dataclass
class Model:
    """The entries of one language."""

    abbreviation: set[str] = field(default_factory=set)
    starter: set[str] = field(default_factory=set)
    collocation: set[tuple[str, str]] = field(default_factory=set)
    lower: set[str] = field(default_factory=set)
    upper: set[str] = field(default_factory=set)

    def ends(self, word: str, following: str) -> bool:
        """Whether a sentence ends with a word that ends in a period, before the following word."""
        a, b = type_of(core_of(word)), type_of(core_of(following))
        bare = core_of(following)
        if a not in self.abbreviation and a != "##" and not (len(a) == 1 and a.isalpha()):
            return True
        if (a, b) in self.collocation:
            return False
        if bare[:1].islower():
            return False
        # a capital where the word is never one inside sentences, and is lower elsewhere, begins a sentence
        if bare[:1].isupper() and b in self.lower and b not in self.upper:
            return True
        if a in self.abbreviation:
            return b in self.starter and not len(a) == 1
        return a == "##"


_IS_NUMBER = re.compile(r"[\d.,]*\d[\d.,]*")
#: A place where a sentence may end: a word that ends in . ? or ! with closing marks, white space, and the following word.
_CANDIDATE = re.compile(r"(?<!\S)\S*[.?!][^\w\s]*(?=\s+(\S+))")


def core_of(word: str) -> str:
    """word without what is no letter or digit around it, but with final periods."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not (word[b - 1].isalnum() or word[b - 1] == "."):
        b -= 1
    return word[a:b]


def type_of(core: str) -> str:
    bare = (core[:-1] if core.endswith(".") else core).lower()
    return "##" if _IS_NUMBER.fullmatch(bare) else bare


def split(text: str | None, model: Model) -> list[str]:
    """Sentences of a text, each line of it apart, without white space around them."""
    out = []
    for line in (text or "").splitlines():
        begin = 0
        for found in _CANDIDATE.finditer(line):
            word = found.group()
            marked = word.rstrip("\"')]}»”’*_")[-1:] in "?!"
            if (marked and not found.group(1)[:1].islower()) or (not marked and (not core_of(word) or model.ends(word, found.group(1)))):
                out.append(line[begin : found.end()].strip())
                begin = found.end()
        out.append(line[begin:].strip())
    return [s for s in out if s]


def split_sentences(docs: DataFrame, model: DataFrame, text: str = "text", lang: str = "lang", name: str = "sentences") -> DataFrame:
    """docs with an array of sentences, split by the model of their language; a language without a model has no abbreviations.

    The model (of train) is sent to the executors once its size has been checked. Null and empty texts have no sentences.
    """
    models: dict[str | None, Model] = {}
    for r in checked(model).toLocalIterator():
        mine = getattr(models.setdefault(r.lang, Model()), r.kind)
        mine.add((r.a, r.b) if r.kind == "collocation" else r.a)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    none = Model()
    docs = docs.drop(name)
    text_copy, lang_copy = fresh([*docs.columns, name], "text_of", "lang_of")
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (text_copy, lang_copy))
            found = pa.array([split(t, shared.value.get(code, none)) for t, code in zip(texts, langs)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names) - 1)), found], names)

    rows = docs.withColumns({text_copy: F.col(text), lang_copy: F.col(lang).cast("string")})
    return rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))]))
