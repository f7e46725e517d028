import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from surveyq.operators import sentences as N

TEXTS = [
    ("en", "Dr. Smith met Mr. Brown on Jan. 5. They talked about e.g. methods. The talk was long. It was good! Was it?"),
    ("en", "Dr. Jones met Mr. Brown at 3.30 p.m. on Monday. The talk was short. They left, etc. They met J. Smith.\nThe end"),
    ("en", "see Fig. 3 for details. We saw Dr. Smith. The Fig. 4 is new. see also Fig. 5 and Fig. 6. The plot is in Fig. 7."),
    ("de", "Das ist z.B. ein Satz. Der Satz ist kurz. Am 3. Mai war Dr. Weber da. Der Text usw. ist neu."),
    ("de", None), ("de", ""), (None, "No lang. At all. None."), ("fr", "..."), ("en", "x" * 50_000), ("en", "-" * 50_000 + ". A"),
] + [("en", f"The report no. {i} was sent to Dr. Brown. The answer was late. They said no. It was fine.") for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, *row, "keep") for i, row in enumerate(TEXTS)], "id long, lang string, text string, type string").repartition(3)


def plain_training():
    """The same training in one process, with counters."""
    words = collections.defaultdict(list)
    for lang, text in TEXTS:
        told = []
        for w in (text or "").split():
            core = N.core_of(w)
            if core:
                told.append((N.type_of(core), core.endswith("."), bool(re.search(r"[?!][\W_]*$", w)), core[0].isupper(), core[0].islower()))
        words[lang].append(told)
    safe = lambda p: max(min(p, 1 - 1e-12), 1e-12)
    log = lambda k, n, p: k * math.log(safe(p)) + (n - k) * math.log(1 - safe(p))

    def dunning(a, b, ab, n):
        rest = n - a
        p, p1, p2 = b / n, ab / a, (b - ab) / rest if rest > 0 else 0.0
        return 2 * (log(ab, a, p1) + log(b - ab, rest, p2) - log(ab, a, p) - log(b - ab, rest, p))

    out = set()
    for lang, texts in words.items():
        n, k = collections.Counter(), collections.Counter()
        for told in texts:
            for t, period, *_ in told:
                n[t] += 1
                k[t] += period
        total, periods = sum(n.values()), sum(k.values())
        abbreviations = set()
        for t in n:
            if k[t] and re.search(r"[^\W\d_]", t):
                inner = t.count(".")
                letters = len(t) - inner
                score = 2 * (log(k[t], n[t], 0.99) - log(k[t], n[t], periods / total)) * math.exp(-letters) * (inner + 1) * float(letters) ** -(n[t] - k[t])
                if score >= N.ABBREVIATION:
                    abbreviations.add(t)
        after, around, asked, lower, upper = collections.Counter(), collections.Counter(), set(), set(), set()
        for told in texts:
            for i, (t, _, _, up, low) in enumerate(told):
                p = told[i - 1] if i else None
                unsure = bool(p and p[1] and (p[0] in abbreviations or p[0] == "##" or (len(p[0]) == 1 and p[0].isalpha())))
                starts = bool(p and (p[2] or (p[1] and not unsure)))
                after[t] += starts
                if unsure:
                    around[p[0], t] += 1
                    asked.add(t)
                if low:
                    lower.add(t)
                if up and p and not starts and not unsure:
                    upper.add(t)
        ends = sum(after.values())
        starters = {t for t in n if after[t] and re.search(r"[^\W\d_]", t) and dunning(ends, n[t], after[t], total) >= N.STARTER and after[t] / ends > n[t] / total}
        out |= {(lang, "abbreviation", t, None) for t in abbreviations} | {(lang, "starter", t, None) for t in starters}
        out |= {(lang, "lower", t, None) for t in asked & lower} | {(lang, "upper", t, None) for t in asked & upper}
        out |= {
            (lang, "collocation", a, b) for (a, b), ab in around.items()
            if ab > 1 and b not in starters and dunning(n[a], n[b], ab, total) >= N.COLLOCATION and total / n[a] > n[b] / ab
        }
    return out


def test_training_equals_one_process(docs):
    got = {(r.lang, r.kind, r.a, r.b) for r in N.train(docs).collect()}
    assert got == plain_training()
    kinds = collections.Counter((lang, kind) for lang, kind, _, _ in got)
    assert kinds["en", "abbreviation"] and kinds["en", "starter"] and {("en", "abbreviation", "dr", None), ("en", "abbreviation", "mr", None)} <= got
    assert not any(lang == "de" and a == "mr" for lang, _, a, _ in got)  # languages are apart


def test_abbreviations_do_not_end_sentences(docs):
    got = {r.id: r.sentences for r in N.split_sentences(docs, N.train(docs)).collect()}
    assert got[2] == ["see Fig. 3 for details.", "We saw Dr. Smith.", "The Fig. 4 is new.", "see also Fig. 5 and Fig. 6.", "The plot is in Fig. 7."]
    assert got[0][0] == "Dr. Smith met Mr. Brown on Jan. 5." or got[0][0].startswith("Dr. Smith met Mr. Brown")
    assert got[0][-2:] == ["It was good!", "Was it?"] and got[1][-1] == "The end"  # lines are apart
    assert got[4] == got[5] == [] and got[6] == ["No lang.", "At all.", "None."] and got[7] == ["..."] and len(got[8][0]) == 50_000


def test_columns_pass_and_models_are_checked(docs, spark):
    model = N.train(docs)
    out = N.split_sentences(docs, model, name="type")
    assert out.columns == ["id", "lang", "text", "type"] and out.where(F.size("type") > 0).count() == 48
    with pytest.raises(ValueError, match="not sent"):
        N.checked(model, 2)
    none = spark.createDataFrame([], docs.schema)
    assert N.train(none).count() == 0 and N.split_sentences(none, model).count() == 0
    assert N.split("One two. Three four.", N.Model()) == ["One two.", "Three four."]


def test_initials_numbers_and_marks():
    model = N.Model(abbreviation={"dr", "etc"}, starter={"they"}, lower={"the", "they"})
    cut = lambda t: N.split(t, model)
    assert cut("He met J. Smith. They left.") == ["He met J. Smith.", "They left."]
    assert cut("Books, pens etc. They left.") == ["Books, pens etc.", "They left."]
    assert cut("It costs 5. The rest is free.") == ["It costs 5.", "The rest is free."]
    assert cut('He said "stop." Then he left.') == ['He said "stop."', "Then he left."]
    assert cut("Why? no idea! Yes.") == ["Why? no idea!", "Yes."]


def test_equal_words_are_counted_before_patterns_run(spark):
    from surveyq.operators import sentences as N

    df = spark.createDataFrame([("en", "See Fig. 3! - (See) fig. 3!")] * 50, "lang string, text string")
    uses = {(r.type, r.period): r.n for r in N.word_uses(df).groupBy("type", "period").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert uses == {("see", False): 100, ("fig", True): 100, ("##", False): 100}
    assert N.word_uses(df).count() == 5
    pairs = {(r.type, r.p_type, r.p_period, r.p_marked): r.n for r in N.word_pairs(df).collect() if r.type == "see"}
    assert pairs == {("see", None, None, None): 50, ("see", "##", False, True): 50}
