import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyq.functions import scores as S
from surveyq.functions import vector as V
from surveyq.operators import bibliography as L
from surveyq.operators import citations as C
from surveyq.operators import evidence as E
from surveyq.operators import matching as B
from surveyq.operators import models as M
from surveyq.operators import pairs as P
from surveyq.operators import scope as O
from surveyq.operators import scoring as G
from surveyq.operators import summary as U


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) if columns else tuple(r) for r in df.collect()), key=str)


REFS = "survey_key string, pos int, idx int, title string, canonical_title string, arxiv_id string, semantic_scholar_id string, doc_id long"


def test_citation_joins(spark):
    corpus = spark.createDataFrame([(0, "Zero Paper", "z"), (5, "Graph nets", None), (6, "GRAPH NETS!", "last wins")], "doc_id long, Title string, Abstract string")
    index = C.title_index(corpus)
    assert rows(index) == [("graphnets", 6), ("zeropaper", 0)]
    refs = spark.createDataFrame(
        [("s", 0, 1, "[PDF] Zero paper - arXiv", None, None, None, None), ("s", 1, 2, "wrong", "Graph Nets", None, None, None),
         ("s", 2, 3, "Graph nets", "", None, None, None), ("s", 3, 4, "unknown", None, None, None, None)], REFS)
    matched = C.match_references(refs, index)
    assert rows(matched, "idx", "matched_doc_id") == [(1, 0), (2, 6), (3, 6), (4, None)]
    odd = spark.createDataFrame(
        [(1, "zero paper", "GRAPH nets", {"a": 1}), (2, "zero paper", "no such", None), (3, None, None, None), (4, "", "", None), (5, "12", "34", None), (6, None, "Zero Paper", None), (1, "zero paper", "GRAPH nets", {"a": 1})],
        "salt int, title string, canonical_title string, name map<string,int>")
    found = C.match_references(odd, index)
    assert found.columns == [*odd.columns, "matched_doc_id"]
    assert rows(found, "salt", "matched_doc_id") == [(1, 6), (1, 6), (2, 0), (3, None), (4, None), (5, None), (6, 0)]
    assert C.match_references(odd.limit(0), index).count() == 0 and rows(C.match_references(odd, index.limit(0)), "matched_doc_id") == [(None,)] * 7
    surveys = spark.createDataFrame([("s", "GRAPH nets"), ("t", "Other")], "survey_key string, survey_title string")
    truth = spark.createDataFrame([("s", 6), ("s", 7), ("t", 1)], "survey_key string, doc_id long")
    got = {r.survey_key: r for r in C.citation_metrics(surveys, matched, truth).collect()}
    assert (got["s"].match_rate, got["s"].coverage, got["s"].coverage_distinct) == (0.75, 1.0, 0.5)
    assert (got["t"].n_refs, got["t"].match_rate, got["t"].coverage) == (0, 0.0, 0.0)
    assert rows(C.self_citation(refs, surveys), "survey_key", "self_cited", "first_self_pos") == [("s", True, 1), ("t", False, None)]
    cands = spark.createDataFrame([("a", ["nope", "zero paper", "graph nets"]), ("b", ["nope"])], "k string, t array<string>")
    assert rows(C.first_hit(cands, index, "k", "t")) == [("a", 0)]
    assert rows(C.corpus_texts(corpus)) == [(0, "Zero Paper\n\nz"), (5, "Graph nets"), (6, "GRAPH NETS!\n\nlast wins")]
    lower = spark.createDataFrame([(1, "t", "a")], "doc_id long, title string, abstract string")
    assert rows(C.corpus_papers(lower)) == [(1, "t", "a")]


def test_citation_metrics_deal_rows_by_their_count(spark, monkeypatch):
    """One survey has most references, some repeat or have no paper; the more rows there are, the more tasks share them."""
    from surveyq.operators import scans

    monkeypatch.setattr(scans, "PER_TASK", 100, raising=False)
    r = random.Random(7)
    refs = [(r.choice([1, 1, 1, *range(2, 40), None]), r.choice([None, *range(60)]), r.random() < 0.4) for _ in range(3000)]
    true = [(k, d) for k, d, t in refs if t] + [(2, 1000), (2, 1000), (41, 5)]
    surveys = [*range(1, 43), 3, None]

    def want(truth):
        out = []
        for k in surveys:
            docs = [] if k is None else [d for s, d, _ in refs if s == k]
            facts = {d for s, d in truth if s == k and k is not None}
            found = [d for d in docs if d is not None]
            hits = [d for d in found if d in facts]
            out.append((k, len(docs), len(found), len(facts), len(hits), len(found) / len(docs) if docs else 0.0, len(hits) / len(facts) if facts else None, len(set(hits)) / len(facts) if facts else None))
        return sorted(out, key=str)

    keys = spark.createDataFrame([(k,) for k in surveys], "survey_key long")
    matched = spark.createDataFrame(refs, "survey_key long, matched_doc_id long, mark boolean")
    got = C.citation_metrics(keys, matched, spark.createDataFrame(true, "survey_key long, doc_id long"))
    assert rows(got) == want(true)
    assert got.select(F.spark_partition_id()).distinct().count() > 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows(C.citation_metrics(keys, matched, "mark")) == want([(k, d) for k, d, t in refs if t])
    assert rows(C.citation_metrics(keys, matched.limit(0), "mark")) == sorted([(k, 0, 0, 0, 0, 0.0, None, None) for k in surveys], key=str)


def test_spread_deals_a_large_table_only(spark):
    from surveyq.operators.scans import spread

    df = spark.range(1000).withColumn("k", F.col("id") % 50)
    assert spread(df, "k") is df
    dealt = spread(df, "k", 50)
    assert dealt.rdd.getNumPartitions() == 20 and rows(dealt) == rows(df)
    assert dealt.withColumn("p", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0


def test_enrichment_and_candidates(spark):
    refs = spark.createDataFrame([("s", 1, "old title", "", "1")], "survey_key string, idx int, title string, url string, arxiv_id string")
    service = spark.createDataFrame([("s", 1, "", "http://u", "d")], "survey_key string, idx int, title string, url string, doi string")
    index = spark.createDataFrame([("oldtitle", 0)], "norm_title string, doc_id long")
    got = C.enrich_references(refs, service, index, ["survey_key", "idx"]).head()
    assert (got.title, got.url, got.arxiv_id, got.doi, got.doc_id) == ("old title", "http://u", "1", "d", 0)
    surveys = spark.createDataFrame([("s", "Graph Nets", "2020", ["Jane Doe"])], "survey_key string, survey_title string, year string, authors array<string>")
    cands = spark.createDataFrame(
        [("s", 2, 0, "Graph Nets", "2020", ["X Y"], "exact"), ("s", 1, 0, "Graph Nets and more", "2020", ["Nobody"], "weak-stranger"), ("s", 1, 1, "Graph", "2019", ["J. Doe"], "first-tier")],
        "survey_key string, priority int, pos int, title string, year string, authors array<string>, arxiv_id string")
    assert C.pick_candidate(surveys, cands, author_below=0.95).head().arxiv_id == "first-tier"


def test_scope(spark):
    text = "pre [9]\n\n# A\nalpha [1]\n\n## B\nbeta words are here in this sentence [2, 3].\n\n## C\ngamma [4]\n\n# D\ndelta [5](x) [6]"
    surveys = spark.createDataFrame([("s", text), ("flat", "no headings [7] at all here")], "survey_key string, text string")
    claims = spark.createDataFrame(
        [("s", 1, "c", "beta words are here in this sentence"), ("s", 2, "c", "beta words are changed"), ("s", 3, "c", "nowhere to be found at all"), ("s", 4, "c", "pre [9]"),
         ("flat", 5, "c", "no headings"), ("s", 6, "c", "gamma [4]")],
        "survey_key string, claim_id int, claim string, source_sentence string")
    got = {r.claim_id: r for r in O.claim_scopes(claims, surveys).collect()}
    assert (got[1].resolution, got[1].scope_refs, got[1].scope_failed) == ("exact", [1, 2, 3], False)
    assert (got[2].resolution, got[2].scope_refs) == ("fallback", [1, 2, 3])
    assert (got[3].scope_refs, got[3].scope_failed) == ([], True)
    assert got[4].scope_refs == [9] and got[5].scope_refs == [7] and got[6].scope_refs == [1, 4]
    own = {r.claim_id: r.scope_refs for r in O.claim_scopes(claims, surveys, depth=0).collect()}
    assert own[1] == [2, 3]
    par = {r.claim_id: r.scope_refs for r in O.claim_scopes(claims, surveys, level="paragraph").collect()}
    assert par[1] == [2, 3] and par[4] == [9]
    refs = spark.createDataFrame([("s", 0, 1, "t", None, "a1", None, 0), ("s", 1, 1, "t", None, "a2", None, 1)], REFS)
    linked = O.scope_references(O.claim_scopes(claims.where("claim_id = 1"), surveys), refs)
    assert rows(linked, "idx", "arxiv_id", "doc_id") == [(1, "a1", 0), (2, None, None), (3, None, None)]


def test_evidence(spark):
    refs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "ref int, k string")
    first = spark.createDataFrame([("a", " "), ("b", "from first")], "k string, v string")
    second = spark.createDataFrame([("a", "from second")], "k string, v string")
    got = {r.ref: r for r in E.waterfall(refs, [("one", first, "k", "v"), ("two", second, "k", "v")]).collect()}
    assert (got[1].abstract, got[1].abstract_source, got[1].abstract_errors) == ("from second", "two", None)
    assert got[2].abstract_source == "one" and got[3].abstract is None
    assert [(e.source, e.reason) for e in got[3].abstract_errors] == [("one", "no_identifier"), ("two", "no_identifier")]
    keyed = spark.createDataFrame([("1.2v3", None, 0), (None, "s", 4), (None, None, 0), (None, None, None)], "a string, s string, d long")
    assert [r.k for r in keyed.select(E.evidence_key(F.col("a"), F.col("s"), F.col("d")).alias("k")).collect()] == ["arxiv:1.2", "ss:s", "doc:0", "unknown"]
    cov = E.coverage(spark.createDataFrame([("s", "a", "tt"), ("s", None, "tttt"), ("s", "", None)], "k string, abstract string, text string"), ["k"]).head()
    assert (cov.n_refs, cov.n_abstract, cov.n_text, cov.n_both, cov.n_text_only, cov.n_neither, cov.text_median) == (3, 1, 2, 1, 1, 1, 3.0)
    todo = E.fetch_plan(refs.unionByName(refs), first.where("k = 'a'"), "k")
    assert rows(todo) == [("b",)]
    files = spark.createDataFrame([(1, "s", {"1": ("x",), "y": (" ",)})], "schema_version int, survey_key string, refs map<string,struct<text:string>>")
    assert rows(E.refs_with_text(E.explode_evidence(files))) == [("s", [1])]
    with pytest.raises(Exception, match="schema version"):
        E.explode_evidence(files.withColumn("schema_version", F.lit(2))).collect()


def brute_lcs(a, b):
    return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)


def test_matching(spark):
    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choice("ab ") for _ in range(r.randint(0, 12))) for _ in "xy")
        assert B.lcs_length(a, b) == brute_lcs(a, b)
    entries = spark.createDataFrame([("s", 0, "A. Author, Graph nets are great, 2019"), ("s", 1, "Deep learning. Nature"), ("s", 2, "zzz")], "survey_key string, k int, raw string")
    titles = spark.createDataFrame([("s", 0, "Deep Learning"), ("s", 1, "Graph Nets"), ("s", 2, "graph nets"), ("s", 3, "")], "survey_key string, j int, title string")
    pairs = B.score_pairs(entries, titles, 0.9)
    mapping = B.greedy_match(pairs)
    assert rows(mapping, "k", "j", "score") == [(0, 1, 1.0), (1, 0, 1.0)]
    left_e, left_t = B.unmatched(entries, titles, mapping)
    assert rows(left_e, "k") == [(2,)] and rows(left_t, "j") == [(2,), (3,)]
    won = B.resolve_conflicts(pairs).where("k = 0").head()
    assert (won.j, won.losers) == (1, [2])
    assert B.match_statistics(entries, titles, mapping).head().entry_rate == pytest.approx(2 / 3)


def test_bibliography(spark):
    tex = r"Text \cite{a, b} and \citep[see][p.~2]{zz} \begin{thebibliography}{9}\bibitem[Doe [et al.](2020)]{a} J. Doe. \newblock First title. \newblock arXiv:2001.00001" "\n" r"\bibitem{b} ``A second title here,'' \url{http://x.org}." "\n" r"\bibitem nokey \end{thebibliography} tail"
    df = spark.createDataFrame([(1, tex), (2, None)], "k int, tex string")
    got = L.parse_bibliography(df, "tex", "k").orderBy("idx").collect()
    assert [(r.idx, r.cite_key, r.title, r.arxiv_id) for r in got] == [(1, "a", "First title", "2001.00001"), (2, "b", "A second title here", None)]
    assert got[1].url == "http://x.org"
    text = {r.k: r for r in L.numbered_citations(df, "tex", "k").collect()}
    assert text[1].text.startswith("Text [1][2] and  ") and (text[1].n_cites, text[1].n_resolved) == (2, 1) and text[2].n_cites == 0
    bib = '@article{x, title = {{A} big {Title}}, url="http://u", eprint = {2101.00002}, archivePrefix = {arXiv}}\n@comment{y}\n@misc{z, title = {Other}, url = {https://arxiv.org/abs/1706.03762}}'
    got = L.parse_bibtex(spark.createDataFrame([(1, bib)], "k int, b string"), "b", "k").orderBy("idx").collect()
    assert [(r.idx, r.arxiv_id) for r in got] == [(1, "2101.00002"), (2, "1706.03762")] and got[1].title == "Other"


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(i, i % 2, [float(v) for v in row]) for i, row in enumerate(x)], "i int, g int, v array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.g: r.diversity for r in V.diversity(df, ["g"], "v").collect()}
    for g in (0, 1):
        u = unit[g::2]
        want = np.mean([1 - a @ b for i, a in enumerate(u) for b in u[i + 1 :]])
        assert got[g] == pytest.approx(want, abs=1e-6)
    assert V.diversity(df.where("i = 0"), ["g"], "v").head().diversity is None
    shift = V.distribution_shift(df.where("g = 0").withColumn("k", F.lit(1)), df.where("g = 1").withColumn("k", F.lit(1)), ["k"], "v").head().distribution_shift
    a, b = unit[0::2].mean(0), unit[1::2].mean(0)
    assert shift == pytest.approx(1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-6)
    for block in (4, 1000):
        pairs = P.similar_pairs(df.withColumn("k", F.lit(1)), "k", "i", "g", "v", 0.3, block)
        want = [(i, j) for i in range(40) for j in range(i + 1, 40) if i % 2 != j % 2 and unit[i] @ unit[j] >= 0.3]
        assert rows(pairs, "i", "j") == sorted(want, key=str)
    assert rows(P.top_neighbours(pairs, "k", 99), "i", "j") == rows(pairs, "i", "j")
    dots, variance = V.pca_dots(df.where("g = 0"), df.where("g = 1"), "i", "v")
    p = {r.i: np.array([r.x, r.y]) for r in dots.collect()}
    centred = x - x[0::2].mean(0)
    _, _, vt = np.linalg.svd(centred[0::2])
    want = centred @ vt[:2].T
    assert np.linalg.norm(p[3] - p[8]) == pytest.approx(np.linalg.norm(want[3] - want[8]), abs=1e-4) and len(variance) == 2


def test_distributions(spark):
    spans = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 10, 12), ("a", 11, 11), ("b", 1, 2)], "k string, s int, e int")
    assert rows(V.interval_union(spans, ["k"], "s", "e")) == [("a", 10), ("b", 1)]
    sims = spark.createDataFrame([(0.49,), (0.5,), (0.54,), (0.899,), (0.95,)], "s double")
    assert [r.b for r in sims.select(V.similarity_bucket(F.col("s")).alias("b")).collect()] == [None, 0, 1, 9, None]
    area = V.kde(sims.where("s < 0.8").withColumn("k", F.lit(1)), "s", ["k"], 0.05, 0, 1, 201).agg(F.sum("density") / 200).head()[0]
    assert area == pytest.approx(1, abs=0.01)
    e = spark.range(1).select(S.entropy(F.array(F.lit(2), F.lit(2), F.lit(0))).alias("a"), S.entropy(F.array(F.lit(0))).alias("b")).head()
    assert e.a == pytest.approx(math.log(2)) and e.b == 0
    assert rows(V.histogram(sims, "s", 5, 0.0, 1.0)) == [(3, 3), (5, 2)]


def test_scores(spark):
    claims = spark.createDataFrame([("s", "A", True), ("s", "A", None), ("s", "B", False), ("s", "A", True)], "k string, category string, supported boolean")
    r = G.citation_correctness(claims, ["k"]).head()
    assert (r.cit_correct_A, r.cit_correct_B, r.cit_correct_C, r.cit_correct_overall) == (pytest.approx(2 / 3), 0.0, None, 0.5)
    expert = spark.createDataFrame(
        [("s", True, None, False, 1), ("s", False, True, False, 2), ("s", False, False, None, 7), ("s", False, False, False, None)],
        "k string, is_critical boolean, is_comparative boolean, is_open_question boolean, modality_level int")
    r = G.expert_profile(expert, ["k"]).head()
    assert (r.m_crit, r.m_comp_total, r.m_open) == (0.25, 0.25, 0.0) and r.m_mod <= math.log(5) and r.modality_dist == {1: 2, 2: 1, 3: 0, 4: 0, 5: 0}
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), ("b", "b")], "t string, p string")
    got = {r["class"]: r for r in S.class_scores(p, "t", "p", ["a", "b"]).collect()}
    assert (got["a"].tp, got["a"].fn, got["b"].fp, got["b"].fn, got["b"].support) == (1, 1, 1, 1, 2)
    assert rows(S.confusion(p, "t", "p", ["a", "b"])) == [("a", 1, 1), ("b", 0, 1)]
    v = spark.createDataFrame([(2, 1, 1), (1, 1, 0), (0, 0, 0), (0, 2, 1)], "a int, b int, t int").select(S.verdict_by_votes(F.col("a"), F.col("b"), F.col("t")).alias("v"))
    assert [r.v for r in v.collect()] == ["win", "tie", "unknown", "lose"]
    m = spark.createDataFrame([(50.0, 48.5), (50.0, 49.5), (None, 1.0)], "a double, b double").select(S.verdict_by_scores(F.col("a"), F.col("b")).alias("v"))
    assert [r.v for r in m.collect()] == ["win", "tie", "unknown"]
    runs = spark.createDataFrame([("s", 1, False, "x"), ("s", 2, True, "second"), ("s", 3, True, "third"), ("t", 1, True, "only")], "k string, completion_no int, ok boolean, text string")
    assert rows(G.majority(runs, ["k"]), "k", "text") == [("s", "second")]
    found = spark.createDataFrame([("s", 0, 0, "S0", "c1"), ("s", 1, 0, "S1", "c2"), ("s", 2, 0, "S2", "c1")], "k string, sentence_idx int, claim_idx int, sentence string, claim string")
    assert [(r.claim_id, r.claim, len(r.sources)) for r in G.dedupe_claims(found, ["k"]).orderBy("claim_id").collect()] == [(1, "c1", 2), (2, "c2", 1)]
    gold = spark.createDataFrame([("s", "a", "b"), ("s", "c", "d")], "k string, a string, b string")
    pred = spark.createDataFrame([("s", "b", "a"), ("s", "a", "d")], "k string, a string, b string")
    r = P.compare_pairs(gold, pred, "k").head()
    assert (r.tp, r.fp, r.fn, r.f1) == (1, 1, 1, 0.5)
    rec = spark.createDataFrame([("s", 1, ["x", "y", "z"])], "k string, r int, v array<string>")
    assert rows(P.all_pairs_of(rec, "k", "r", "v"), "a", "b") == [("x", "y"), ("x", "z"), ("y", "z")]


def test_summaries(spark):
    long = spark.createDataFrame([("m1", "s1", "x", 1.0), ("m1", "s2", "x", 3.0), ("m2", "s1", "x", 2.0), ("m2", "s2", "x", None), (None, "s1", "x", 5.0)], "model string, survey_id string, metric string, value double")
    got = {r.model: r for r in U.metric_summary(long, ["model"]).collect()}
    assert (got["m1"].mean, got["m1"].median, got["m2"].n, got[None].mean) == (2.0, 2.0, 1, 5.0) and got["m1"].std_sample == pytest.approx(math.sqrt(2)) and got["m1"].std_pop == 1.0
    d = U.paired_delta(long, "m1", "m2")
    assert rows(d, "survey_id", "delta") == [("s1", 1.0)]
    assert U.delta_summary(d, ["metric"]).head().share_up == 100.0
    ids = spark.createDataFrame([("10",), ("x",), ("2",), ("1a",)], "i string")
    assert [r.i for r in ids.orderBy(*U.numeric_then_text(F.col("i"))).collect()] == ["2", "10", "1a", "x"]
    assert rows(U.up_to_id(ids, "i", 5)) == [("2",)]
    assert U.expand_metrics(["rouge_bleu", "logic", "bleu"]) == ["rouge1", "rouge2", "rougeL", "bleu", "logic"]
    flags = spark.createDataFrame([("true",), ("NaN",), ("1.5",), ("x",)], "v string").select(U.as_metric(F.col("v")).alias("v"))
    assert [r.v for r in flags.collect()] == [1.0, None, 1.5, None]


def test_alignment_and_cache(spark):
    claims = spark.createDataFrame(
        [("s", 1, "cats eat mice", [(3, "dogs bark"), (4, "cats eat mice daily")]), ("s", 2, "x", [])], "k string, claim_id int, claim string, evidence array<struct<idx:int,text:string>>")
    got = {r.claim_id: r for r in M.align_per_ref(claims, M.OverlapAligner(), ["k", "claim_id"]).collect()}
    assert (got[1].alignscore, got[1].best_ref, got[1].supported, got[1].evidence_refs) == (1.0, 4, True, [3, 4]) and got[2].supported is None
    got = {r.claim_id: r for r in M.align_concat(claims, M.OverlapAligner()).collect()}
    assert (got[1].alignscore, got[2].supported, got[2].evidence_refs) == (1.0, None, [])
    full = "Nothing in here. " * 50 + "Cats eat mice in this chapter of it. " + "Again nothing. " * 50
    pairs = spark.createDataFrame(
        [("s", 1, 1, 0, "cats eat mice", "cats eat mice", full), ("s", 2, 1, 0, "cats eat mice", "dogs", full), ("s", 3, 1, 0, "cats eat mice", None, None)],
        "k string, claim_id int, idx int, pos int, claim string, abstract string, full_text string")
    got = {r.claim_id: r for r in M.align_cascade(pairs, M.OverlapAligner(), M.HashEmbedder(1024), ["k", "claim_id"], chunk_words=20).collect()}
    assert (got[1].alignscore, got[1].n_abstract_skip) == (1.0, 1) and got[2].alignscore == 1.0 and got[3].alignscore is None
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("b", "known")], "key string, answer string")
    call = lambda df: df.withColumn("answer", F.when(F.col("key") == "a", "new")).withColumn("status", F.when(F.col("key") == "c", "failed").otherwise("ok"))
    answers, keep = M.cached(asked, cache, "key", "answer", call)
    assert rows(answers, "key", "answer") == [("a", "new"), ("a", "new"), ("b", "known"), ("c", None)] and rows(keep) == [("a", "new")]
    sents = spark.createDataFrame([("s", "cats eat mice", "mice cats eat"), ("s", "cats eat mice", "cats eat")], "k string, s1 string, s2 string")
    assert rows(M.both_entail(sents, M.OverlapNli(), 0.9), "s2") == [("mice cats eat",)]
    judge = lambda f: M.RuleJudge(f)
    r = M.contradictions(sents, judge(lambda p: F.lit(True)), judge(lambda p: F.when(p.endswith("eat"), p.contains("mice cats"))), ["k"]).head()
    assert (r.n_candidates, r.n_same_topic, r.n_confirmed, r.m_contr, r.n_failed) == (2, 2, 1, 0.5, 0)
    j = spark.createDataFrame([('```json\n{"is_critical": true, "modality_level": 3}\n```',), ("junk",)], "a string").select(M.expert_flags(F.col("a")).alias("f")).collect()
    assert (j[0].f.is_critical, j[0].f.modality_level, j[1].f.is_critical, j[1].f.modality_level, j[1].f.fell_back) == (True, 3, False, 1, True)


def test_overlap_scores(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat is on the mat"), (2, "", "x"), (3, "a b c d e", "a b c d e")], "k int, c string, r string")
    r1 = {r.k: r.rouge_1 for r in M.rouge_n(df, ["k"], "c", "r", 1).collect()}
    assert r1[1] == pytest.approx(5 / 6) and r1[2] == 0 and r1[3] == 1
    rl = {r.k: r.rouge_l for r in M.rouge_l(df, ["k"], "c", "r").collect()}
    assert rl[1] == pytest.approx(5 / 6) and rl[2] == 0 and rl[3] == 1
    b = {r.k: r.bleu for r in M.bleu(df, ["k"], "c", "r").collect()}
    assert b[3] == pytest.approx(1) and b[1] == 0 and b[2] == 0
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "k int, embedding array<double>")
    assert M.soft_recall(vec, vec, ["k"]).head().soft_recall == pytest.approx(1)
    assert M.soft_recall(vec, vec.limit(1), ["k"]).head().soft_recall == pytest.approx(0.5)


def brute_soft_recall(wanted, found):
    def size(x):
        if not x:
            return 0.0
        u = np.array(x, float)
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-8)
        return (1 / np.maximum(u @ u.T, 0).sum(1)).sum()

    return (size(wanted) + size(found) - size([*wanted, *found])) / size(wanted)


def test_soft_recall_by_blocks(spark):
    """Groups of several blocks, with copies inside and across the sets, and one without found vectors."""
    draw = np.random.default_rng(5)
    rows = [(g, int(i % 2), draw.normal(size=6).round(1).tolist()) for g, n in (("a", 70), ("b", 9), ("c", 1)) for i in range(n)]
    rows += [("a", s, rows[3][2]) for s in (0, 0, 0, 1, 1)] + [("a", 0, None)]
    df = spark.createDataFrame(rows, "k string, s int, embedding array<float>")
    got = M.soft_recall(df.where("s = 0"), df.where("s = 1"), ["k"], block=8)
    assert "Exchange" in got._jdf.queryExecution().toString()
    pick = lambda k, s: [v for g, t, v in rows if (g, t) == (k, s) and v is not None]
    assert {r.k: r.soft_recall for r in got.collect()} == {k: pytest.approx(brute_soft_recall(pick(k, 0), pick(k, 1)), rel=1e-5) for k in "abc"}


def test_soft_recall_query_reads_all_embeddings(spark, sf):
    from surveyq.plans.registry import QUERIES

    every = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    assert max(r.vec_id for r in every) >= 200
    pick = lambda k, s: [r.embedding for r in every if r.label == k and r.vec_id % 2 == s]
    want = {k: pytest.approx(brute_soft_recall(pick(k, 0), pick(k, 1)), rel=1e-5) for k in {r.label for r in every if r.vec_id % 2 == 0}}
    assert {r.label: r.soft_recall for r in QUERIES["m11_soft_recall"](spark, sf).collect()} == want


def test_greedy_match_query_takes_every_part(spark, sf):
    from surveyq.plans.registry import QUERIES

    norm = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()
    parts = [(r.p_partkey, norm(f"{r.p_brand} {r.p_name}, 2019."), norm(r.p_name)) for r in spark.read.parquet(f"{sf}/part.parquet").collect()]

    def longest(a, b):
        return next(n for n in range(len(a), -1, -1) if any(a[i : i + n] in b for i in range(len(a) - n + 1)))

    scored = sorted((-longest(t, e) / len(t), k, j) for k, e, _ in parts for j, _, t in parts if k // 100 == j // 100)
    ks, js, want = set(), set(), set()
    for s, k, j in scored:
        if -s >= 0.7 and k not in ks and j not in js:
            ks.add(k)
            js.add(j)
            want.add((k // 100, k, j, -s))
    assert {tuple(r) for r in QUERIES["j14_j15_greedy_match"](spark, sf).select("survey_key", "k", "j", "score").collect()} == want
    assert ks == {k for k, _, _ in parts}


def test_overlap_queries_read_whole_texts_of_all_rows(spark):
    from collections import Counter
    from types import SimpleNamespace

    from surveyq.plans import documents as D
    from surveyq.plans import more as Q

    draw = random.Random(3)
    texts = ["", None, "Ab", "one two one two", " ".join(f"w{draw.randrange(60)}" for _ in range(900)), "x y z. " * 150 + "the end is new " * 90]
    t = SimpleNamespace(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))

    def sides(text):
        text = text or ""
        cut = -(-len(text) // 2)
        return [re.sub("[^a-z0-9]+", " ", x.lower()).split() for x in (text[:cut], text[cut:])]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    def hits(a, b, n):
        grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        return sum((grams(a) & grams(b)).values()) / max(1, len(a) - n + 1)

    def bleu(a, b):
        rates = [hits(a, b, n) for n in range(1, 5)]
        return 0.0 if min(rates) <= 0 else min(1.0, math.exp(1 - len(b) / len(a))) * math.exp(sum(map(math.log, rates)) / 4)

    both = {i: sides(x) for i, x in enumerate(texts)}
    near = lambda f: {i: pytest.approx(f(a, b)) for i, (a, b) in both.items()}
    got = lambda df, c: {r.doc_id: r[c] for r in df.collect()}
    f1 = lambda n, a, b: 2 * n / (len(a) + len(b)) if a or b else 0.0
    share = lambda a, b: len({*a} & {*b}) / len({*b}) if b else 0.0
    assert got(D.m11_rouge_l(t), "rouge_l") == near(lambda a, b: f1(lcs(a, b), a, b))
    assert got(D.m11_rouge_1_whole(t), "rouge_1") == near(lambda a, b: f1(hits(a, b, 1) * len(a), a, b))
    assert got(D.m11_bleu(t), "bleu") == near(bleu)
    assert got(Q.c7_concat_alignment_whole(t), "alignscore") == near(share)
    assert got(Q.c8_per_ref_alignment_whole(t), "alignscore") == near(share)
    cascade = {r.survey_key: r.alignscore for r in D.c5_cascade(t).collect()}
    # a blank text gives no score; "b" is no word of "Ab"; the best chunks of the others have all words of the claim
    assert cascade == {0: None, 1: None, 2: 0.0, 3: 1.0, 4: 1.0, 5: 1.0}


def test_text_queries_read_whole_texts_of_all_rows(spark):
    from types import SimpleNamespace

    from surveyq.plans import analytics as A
    from surveyq.plans import documents as D
    from surveyq.plans import more as Q

    long = " ".join(f"Word{i % 400}" for i in range(900))
    docs = spark.createDataFrame([(1, "en", long), (2, "fr", "- Eins zwei\n2. Drei\n\nvier")], "doc_id long, lang string, text string")
    lines = spark.createDataFrame([(7, n, float(n), 0.5, None) for n in (1, 2)], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double")
    t = SimpleNamespace(documents=docs, lineitem=lines)
    got = lambda df, c: {r.doc_id: r[c] for r in df.collect()}
    assert got(Q.t33_text_from_index(t), "text") == {1: long, 2: "- Eins zwei 2. Drei vier"}
    assert got(D.t4_loose_title(t), "t4") == {1: long.lower(), 2: "eins zwei 2 drei vier"}
    assert got(D.t47_claim_lines(t), "claims") == {1: [long], 2: ["Eins zwei", "Drei", "vier"]}
    words = got(D.t37_keywords(t), "words")
    assert set(words) == {1, 2} and words[2] == ["Eins", "zwei", "Drei", "vier"]
    assert rows(A.pf3_unpivot(t)) == sorted([(7, n, m, v) for n in (1, 2) for m, v in (("quantity", float(n)), ("discount", 0.5))], key=str)


def test_contradictions_of_paragraphs_see_more_than_400_characters(spark):
    pair = spark.createDataFrame([("a", "x" * 1000 + " it is", "y" * 1700 + " it is not")], "k string, s1 string, s2 string")
    yes, no = M.RuleJudge(lambda q: F.lit(True)), M.RuleJudge(lambda q: q.contains(" it is\n") & q.endswith(" it is not"))
    seen = lambda **most: M.contradictions(pair, yes, no, ["k"], **most).head().n_confirmed
    assert (seen(), seen(most=1800)) == (0, 1)


def test_evaluators_by_name(spark):
    from surveyq.operators import evaluators as EV

    long = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "metric string, value double")
    got = {r.metric: r.mean for r in EV.load_evaluator("summary", {"by": ["metric"]})({"long": long}).collect()}
    assert got == {"a": 2.0, "b": 2.0}
    for name, config in (("nothing", {}), ("summary", {})):
        with pytest.raises(ValueError):
            EV.load_evaluator(name, config)
    with pytest.raises(ValueError):
        EV.load_evaluator("summary", {"by": ["metric"]})({})
    with pytest.raises(ValueError):
        EV.register("summary", lambda t, c: t["long"], ("long",))


def test_every_evaluator(spark):
    """Each name of the registry gives what its operator gives."""
    from surveyq.operators import evaluators as EV

    run = lambda name, config, **tables: EV.load_evaluator(name, config)(tables).collect()
    pairs = spark.createDataFrame(
        [("s", 1, 1, 0, "graph nets work", "graph nets work", None), ("s", 2, 1, 0, "trees fail", "nothing", "trees fail here")],
        "survey_key string, claim_id int, idx int, pos int, claim string, abstract string, full_text string")
    claims = spark.createDataFrame([("s", 1, "A"), ("s", 2, "B"), ("s", 3, "A")], "survey_key string, claim_id int, category string")
    (got,) = run("alignment", {"aligner": M.OverlapAligner(), "embedder": M.HashEmbedder(), "keys": ["survey_key", "claim_id"], "by": ["survey_key"]}, claims=claims, pairs=pairs)
    assert (got.n_claims, got.n_supported, got.cit_correct_A, got.cit_correct_B) == (3, 2, 0.5, 1.0)
    two = spark.createDataFrame([("s", "it works", "it fails"), ("s", "x", "y")], "survey_key string, s1 string, s2 string")
    (got,) = run("contradiction", {"topic": M.RuleJudge(lambda p: p.contains("it")), "check": M.RuleJudge(lambda p: p.contains("fails")), "by": ["survey_key"]}, pairs=two)
    assert (got.n_candidates, got.n_same_topic, got.n_confirmed, got.m_contr) == (2, 1, 1, 1.0)
    (got,) = run("evidence", {"by": ["survey_key"]}, evidence=spark.createDataFrame([("s", "a", None), ("s", " ", "text")], "survey_key string, abstract string, text string"))
    assert (got.n_refs, got.n_abstract, got.n_text, got.n_both, got.text_max) == (2, 1, 1, 0, 4.0)
    judged = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("B", None)], "gold string, predicted string")
    assert {r["class"]: (r.tp, r.fp, r.fn) for r in run("expert_validation", {"classes": ["A", "B"]}, judged=judged)} == {"A": (1, 0, 1), "B": (1, 1, 1)}
    texts = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "x", "y")], "k int, candidate string, reference string")
    assert {r.k: r.rouge_2 for r in run("rouge", {"keys": ["k"], "n": 2}, texts=texts)} == {1: 1.0, 2: 0.0}
    assert {r.k: round(r.bleu, 9) for r in run("bleu", {"keys": ["k"]}, texts=texts)} == {1: 1.0, 2: 0.0}


def test_config_files(spark, tmp_path):
    from surveyq.sources.config import read_config

    (tmp_path / "a.yaml").write_text("top_k: 5\nthresholds:\n  skip: 0.75\n")
    (tmp_path / "b.yaml").write_text("- 1\n")
    assert read_config(spark, str(tmp_path / "a.yaml")) == {"top_k": 5, "thresholds": {"skip": 0.75}}
    with pytest.raises(ValueError):
        read_config(spark, str(tmp_path / "b.yaml"))


def test_places_over_all_rows(spark):
    from surveyq.operators.summary import numbered

    df = spark.createDataFrame([(i * 7919 % 1009, i) for i in range(3000)], "a long, b long").repartition(7)
    got = sorted((r.place, r.a, r.b) for r in numbered(df, [F.col("a"), F.col("b")]).collect())
    assert [x[0] for x in got] == list(range(1, 3001)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
    assert numbered(df.limit(0), [F.col("a")]).count() == 0


def test_retries_ask_again_only_what_failed(spark):
    class Judge:
        asked = []

        def ask(self, df, prompt, out):
            self.asked.append(sorted(r[0] for r in df.select(prompt).collect()))
            known = F.when(F.col(prompt) <= chr(ord("a") + len(self.asked) - 1), F.upper(prompt))
            return M.RuleJudge(lambda q: known).ask(df, prompt, out)

    df = spark.createDataFrame([("a",), ("b",), ("b",), ("z",), (None,)], "q string")
    got = sorted((str(r.q), r.x, r.x_status) for r in M.Retrying(Judge(), attempts=2, wait=0.0).ask(df, "q", "x").collect())
    assert Judge.asked == [["a", "b", "z"], ["b", "z"]]
    assert got == [("None", None, "failed"), ("a", "A", "ok"), ("b", "B", "ok"), ("b", "B", "ok"), ("z", None, "failed")]


def test_failure_hook(spark):
    never = M.RuleJudge(lambda q: F.when(q == "a", "yes"))
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "q string")
    hook = lambda q: F.when(q != "c", F.concat(F.lit("no answer to "), q))
    ask = lambda **kw: sorted((str(r.q), r.x, r.x_status) for r in M.Retrying(never, attempts=1, wait=0.0, **kw).ask(df, "q", "x").collect())
    assert ask(on_failure=hook) == [("None", None, "failed"), ("a", "yes", "ok"), ("b", "no answer to b", "fallback"), ("c", None, "failed")]
    assert ask(on_failure=hook, fallback="?") == [("None", "?", "fallback"), ("a", "yes", "ok"), ("b", "no answer to b", "fallback"), ("c", "?", "fallback")]


# --- running aggregates ----------------------------------------------------------


@pytest.mark.parametrize("before", [False, True])
def test_running_equals_a_window(spark, before):
    from pyspark.sql.window import Window

    from surveyq.operators.scans import running

    r = random.Random(1)
    # one group holds most rows and crosses many ranges; nulls in group and value
    data = [(r.choice(["hot"] * 8 + ["a", "b", None]), i, r.choice([None, 1.5, -2.0, 7.0]), "x", "y") for i in range(900)]
    df = spark.createDataFrame(data, "g string, o int, v double, part string, lo string").repartition(7)
    kinds = {"s": "sum", "n": "count", "least": "min", "most": "max"}
    got = running(df, ["g"], ["o"], {k: (f, "v") for k, f in kinds.items()}, before)
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = df.withColumns({k: getattr(F, f)("v").over(w) for k, f in kinds.items()})
    assert sorted(got.columns) == sorted(want.columns)
    columns = [*want.columns]
    assert rows(got, *columns) == rows(want, *columns)


def test_ranks_over_all_rows_ties_and_empty_tables(spark):
    from surveyq.operators.scans import ranked

    df = spark.createDataFrame([(i % 5, "x") for i in range(50)], "o int, every string")
    got = ranked(df, [], ["o"]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 51)) and [r.o for r in sorted(got, key=lambda r: r["rank"])] == sorted(i % 5 for i in range(50))
    assert ranked(df.where("false"), ["o"], ["every"]).count() == 0


def test_no_window_over_a_whole_group(spark):
    claims = spark.createDataFrame([("s", i, 0, "t", f"c{i % 30}") for i in range(90)], "source string, sentence_idx int, claim_idx int, sentence string, claim string")
    found = G.dedupe_claims(claims, ["source"])
    assert rows(found.select("claim_id", "claim", F.size("sources").alias("n"))) == sorted(((i + 1, f"c{i}", 3) for i in range(30)), key=str)
    assert not any("Window" in line and "source" in line.split("Window")[1] for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "rank" in line)
    spans = spark.createDataFrame([("g", 0, 10), ("g", 5, 12), ("g", 20, 21), ("g", 20, 21), ("g", 3, 3), (None, 1, 4)], "g string, s long, e long")
    assert rows(V.interval_union(spans, ["g"], "s", "e")) == [("g", 13), (None, 3)]


# --- threshold join and one-to-one matching ----------------------------------------


def lcs(a, b):
    return max((n for n in range(len(a), 0, -1) for i in range(len(a) - n + 1) if a[i : i + n] in b), default=0)


@pytest.mark.parametrize("at_least", [0.0, 0.15, 0.5, 0.7, 1.0])
def test_threshold_join_loses_no_pair(spark, at_least):
    r = random.Random(3)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(r.randint(0, n)))
    es = [(s, k, None if k == 3 else text(7)) for s in ("x", "y") for k in range(25)]
    ts = [(s, j, None if j == 3 else text(4)) for s in ("x", "z", "y") for j in range(25)]
    entries, titles = spark.createDataFrame(es, "survey_key string, k long, raw string"), spark.createDataFrame(ts, "survey_key string, j long, title string")
    norm = lambda v: " ".join((v or "").split())
    want = {(s, k, j, lcs(norm(t), norm(e)) / len(norm(t))) for s, k, e in es for s2, j, t in ts if s == s2 and norm(t)}
    assert {tuple(x) for x in B.score_pairs(entries, titles, at_least).collect()} == {x for x in want if x[3] >= at_least}


def test_links_of_copies_are_counted_without_pairs(spark):
    es, ts = [("x", k, ["Deep nets", "graph NETS", "none", None][k % 4]) for k in range(400)], [("x", j, ["deep nets", "nets", "", None][j % 4]) for j in range(400)]
    entries, titles = spark.createDataFrame(es, "survey_key string, k long, raw string"), spark.createDataFrame(ts, "survey_key string, j long, title string")
    pairs = B.score_pairs(entries, titles, 0.7).groupBy("survey_key", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"), F.max("score").alias("best"))
    links = B.title_links(entries, titles, 0.7)
    assert rows(links) == rows(pairs) and links.count() == 200
    assert {(r.n_entries, r.best) for r in links.collect()} == {(100, 1.0), (200, 1.0)}


def test_candidates_are_few(spark):
    texts = [f"{a} {b} survey of methods" for a in ("deep", "graph", "causal", "sparse", "robust") for b in ("nets", "trees", "flows", "models", "agents")]
    t, e = (spark.createDataFrame([("s", x) for x in texts], f"survey_key string, {c} string") for c in "te")
    may = B.gram_candidates(t, e, 0.95).count()
    assert 25 <= may <= 60 and B.gram_candidates(t, e, 1.5).count() == 0  # 625 pairs; " survey of methods" is in all of them


def test_rounds_equal_the_sequential_choice(spark):
    r = random.Random(9)
    pairs = {(s, k, j): r.choice([0.5, 0.7, 0.7, 0.9]) for s in "ab" for k in range(12) for j in range(12) if r.random() < 0.5}
    pairs |= {("c", i, i): 1 - i / 100 for i in range(20)} | {("c", i + 1, i): 1 - (i + 0.5) / 100 for i in range(19)}  # a chain: a round each
    want, used = set(), set()
    for (s, k, j), score in sorted(pairs.items(), key=lambda x: (-x[1], x[0][1], x[0][2])):
        if (s, "k", k) not in used and (s, "j", j) not in used:
            used |= {(s, "k", k), (s, "j", j)}
            want.add((s, k, j, score))
    df = spark.createDataFrame([(*k, v) for k, v in pairs.items()], "survey_key string, k long, j long, score double")
    assert {tuple(x) for x in B.greedy_match(df).collect()} == want
    assert B.greedy_match(df.where("false")).count() == 0


# --- quantiles -----------------------------------------------------------------------


def test_selected_quantiles_equal_percentile_bit_by_bit(spark):
    from surveyq.operators.quantiles import select_quantiles, summarised

    r = random.Random(4)
    inf, nan = float("inf"), float("nan")
    values = {"wide": [r.uniform(-1, 1) * 10 ** r.randint(-3, 3) for _ in range(500)], "few": [1.5, 2.0, 2.0, -7.25] * 50, "one": [3.0], "ends": [inf, -inf, nan, 1.7e308, -1.7e308, 0.5, None] * 9, None: [float(i) for i in range(101)], "none": [None]}
    df = spark.createDataFrame([(g, v, "x", 1) for g, vs in values.items() for v in vs], "g string, v double, lo string, rank int").repartition(5)
    ps = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0, "h": 1 / 3}
    want = {x.g: [repr(x[n]) for n in ps] for x in df.groupBy("g").agg(*(F.percentile("v", F.lit(p)).alias(n) for n, p in ps.items())).collect()}
    got = {x.g: [repr(x[n]) for n in ps] for x in select_quantiles(df, ["g"], "v", ps, bins=64).collect()}
    assert got == {g: v for g, v in want.items() if g != "none"}
    mixed = {x.g: [repr(x[n]) for n in ps] + [x.n] for x in summarised(df, ["g"], "v", ps, F.count("v").alias("n"), large=60).collect()}
    assert mixed == {g: v + [sum(y is not None for y in values[g])] for g, v in want.items()}
    whole = summarised(df, [], "v", {"m": 0.5}, F.count("v").alias("n"), large=10).head()
    assert (whole.m, whole.n) == tuple(df.agg(F.percentile("v", F.lit(0.5)), F.count("v")).head())
    assert summarised(df.where("false"), ["g"], "v", ps).count() == 0


def test_one_large_group_over_all_rows(spark):
    from surveyq.operators.quantiles import select_quantiles

    rows_ = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select("l_extendedprice")
    ps = {f"q{i}": i / 100 for i in (0, 1, 25, 50, 77, 99, 100)}
    want = rows_.agg(*(F.percentile("l_extendedprice", F.lit(p)).alias(n) for n, p in ps.items())).head()
    assert select_quantiles(rows_, [], "l_extendedprice", ps).head() == want


# --- ordered alignment ----------------------------------------------------------------


def plain_alignment(claim, premise, weight, gap):
    h = [[0.0] * (len(premise) + 1) for _ in range(len(claim) + 1)]
    for i, (c, w) in enumerate(zip(claim, weight), 1):
        for j, p in enumerate(premise, 1):
            h[i][j] = max(0.0, h[i - 1][j - 1] + w if c == p else 0.0, h[i - 1][j] - gap * w, h[i][j - 1] - gap)
    return max(map(max, h))


def test_local_alignment_equals_the_plain_table():
    r = np.random.default_rng(1)
    for _ in range(200):
        claim, premise = r.integers(0, 4, r.integers(0, 9)), r.integers(0, 4, r.integers(0, 12))
        weight, gap = r.uniform(0.1, 3, len(claim)), float(r.choice([0.0, 0.1, 0.7]))
        assert M.local_alignment(claim, premise, weight, gap) == pytest.approx(plain_alignment(claim, premise, weight, gap), abs=1e-12)


def test_order_and_weights_count(spark):
    texts = ["the model learns graph structure", "structure graph learns model the", "the the the", None, "", "The model, slowly, LEARNS graph structure."]
    df = spark.createDataFrame([(i, t, texts[0]) for i, t in enumerate(texts)], "id long, premise string, claim string")
    got = {x.id: x.s for x in M.OrderedAligner().score(df, "premise", "claim", "s").collect()}
    assert got[0] == 1.0 and got[1] < 0.5 < got[5] < 1.0 and got[2] == 0.2 and got[3] == got[4] == 0.0
    table = M.word_weights(df.select("premise").union(spark.createDataFrame([("the",)] * 20, "premise string")), "premise")
    assert len(table) == M.CELLS and table.max() == np.log(27) + 1
    weighed = {x.id: x.s for x in M.OrderedAligner(table).score(df, "premise", "claim", "s").collect()}
    assert weighed[0] == 1.0 and weighed[2] < 0.15  # a frequent word counts less
    none = M.OrderedAligner().score(df.withColumn("claim", F.lit(None).cast("string")), "premise", "claim", "s")
    assert {x.s for x in none.collect()} == {0.0}


# --- learned embeddings ----------------------------------------------------------------


def topic_texts(r, n=120):
    topics = [[f"{t}word{i}" for i in range(12)] for t in ("a", "b", "c", "d")]
    return [" ".join(r.choice(topics[i % 4]) for _ in range(20)) for i in range(n)]


def test_learned_vectors_are_the_leading_singular_vectors(spark):
    from surveyq.operators import embeddings as L

    texts = [*topic_texts(random.Random(2)), None, "", "  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(5)
    found = L.learn_embedder(df, dims=4, cells=256, rounds=6)
    lists = [r.w for r in df.select(L.word_cells("text", 256).alias("w")).collect()]
    full = L.weighted([w for w in lists if w], found.idf)
    _, s, vt = np.linalg.svd(full.astype(float))
    np.testing.assert_allclose(found.strength, s[:4], rtol=1e-3)
    np.testing.assert_allclose(found.vectors @ found.vectors.T, vt[:4].T @ vt[:4], atol=0.02)  # one subspace
    counts = np.bincount([c for w in lists if w for c in set(w)], minlength=256)
    np.testing.assert_allclose(found.idf, np.log(121 / (1 + counts)) + 1)
    rows_ = {r.id: r.v for r in found.embed(df, "text", "v").collect()}
    np.testing.assert_allclose(rows_[0], L.weighted([next(w for w in df.where("id = 0").select(L.word_cells("text", 256)).head())], found.idf)[0] @ found.vectors, atol=1e-5)
    assert rows_[120] == rows_[121] == [0.0] * 4
    none = L.learn_embedder(df.where("false"), dims=2, cells=64)
    assert none.vectors.shape == (64, 2) and not none.strength.any()


def test_halves_of_a_text_are_nearer_than_those_of_others(spark):
    from surveyq.operators import embeddings as L

    r = random.Random(5)
    train, held = topic_texts(r), [" ".join(x) for t in topic_texts(r, 40) for x in (t.split()[:10], t.split()[10:])]
    df = spark.createDataFrame([(t,) for t in train], "text string")
    out = spark.createDataFrame([(i, t) for i, t in enumerate(held)], "id long, text string")

    def gap(embedder):
        v = np.array([x.v for x in embedder.embed(out, "text", "v").orderBy("id").collect()], float)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        own = (v[::2] * v[1::2]).sum(1).mean()
        other = np.mean([v[2 * i] @ v[2 * j + 1] for i in range(40) for j in range(40) if i % 4 != j % 4])
        return own - other

    assert gap(L.learn_embedder(df, dims=4, cells=1024)) > gap(M.HashEmbedder()) + 0.3


# --- growth of single steps ----------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_soft_recall_forms_products_over_columns(spark):
    """No loop over the arrays of a pair in Spark's interpreter; vectors of other lengths and with nulls are near to none."""
    draw = np.random.default_rng(9)
    df = spark.createDataFrame([("a", i % 2, draw.normal(size=70).tolist()) for i in range(40)], "k string, s int, embedding array<float>")
    got = M.soft_recall(df.where("s = 0"), df.where("s = 1"), ["k"], block=16)
    pick = lambda s: [r.embedding for r in df.collect() if r.s == s]
    assert got.head().soft_recall == pytest.approx(brute_soft_recall(pick(0), pick(1)), rel=1e-6)
    assert "zip_with" not in got._jdf.queryExecution().toString()


def test_overlap_scores_shuffle_no_text(spark):
    r = random.Random(4)
    text = lambda: " ".join(r.choice(["a", "b", "c", "dd"]) for _ in range(r.randint(0, 30)))
    data = [(i, text(), text()) for i in range(60)] + [(60, None, "a"), (61, "a b c dd e", "a b c dd e")]
    df = spark.createDataFrame(data, "k int, c string, r string")
    grams = lambda t, n: [tuple((t or "").split()[i : i + n]) for i in range(len((t or "").split()) - n + 1)]
    for n in (1, 2, 3):
        got = M.rouge_n(df, ["k"], "c", "r", n)
        assert "Exchange" not in plan_of(got)
        for k, score in ((x.k, x[f"rouge_{n}"]) for x in got.collect()):
            a, b = grams(data[k][1], n), grams(data[k][2], n)
            hits = sum(min(a.count(g), b.count(g)) for g in set(a))
            assert score == pytest.approx(2 * hits / (len(a) + len(b)) if a or b else 0.0)
    got = M.bleu(df, ["k"], "c", "r")
    assert "Exchange" not in plan_of(got)
    assert {x.k: x.bleu for x in got.collect()}[61] == pytest.approx(1.0)


def test_texts_from_index_shuffle_nothing(spark, sf):
    from surveyq.functions import text as X
    from surveyq.plans.registry import QUERIES

    assert "Exchange" not in plan_of(QUERIES["t33_text_from_index"](spark, sf))
    words = spark.createDataFrame([(["b", "a", "b", "", "a", "b"],), ([""],)], "w array<string>").select(X.word_index(F.col("w")).alias("m"))
    assert [r.m for r in words.collect()] == [{"": [3], "a": [1, 4], "b": [0, 2, 5]}, {"": [0]}]


def test_sections_cut_a_text_once(spark, sf):
    from surveyq.plans.registry import QUERIES

    plan = plan_of(QUERIES["t16_sections"](spark, sf))
    assert plan.count("(?md)^#{1,3}") == 1


def test_chunks_bind_their_sentences(spark):
    """Sentences are formed once a text and not again for each chunk."""
    from surveyq.functions import text as X

    df = spark.range(1).select(F.concat(F.lit("One is here. " * 60), F.col("id").cast("string")).alias("t"))
    cut = df.select(X.word_chunks(X.split_sentences("t", 0, False), X.word_count("t"), 20).alias("c"))
    assert " ".join(cut.head().c) == "One is here. " * 60 + "0" and plan_of(cut).count("(?<=[.!?])") == 1


def test_cascade_of_null_and_equal_claims(spark):
    """Texts are ranked by number: rows of equal keys stay apart, a null claim is no empty one."""
    text = "alpha beta gamma. Delta epsilon zeta. " * 30
    data = [(1, 1, 0, None, None, text), (2, 1, 0, "", None, text), (3, 1, 0, "alpha zeta", None, text), (3, 2, 1, "alpha zeta", "alpha", text), (4, 1, 0, "alpha zeta", "zeta alpha", text)]
    pairs = spark.createDataFrame(data, "k int, idx int, pos int, claim string, abstract string, full_text string")
    got = {r.k: r for r in M.align_cascade(pairs, M.OverlapAligner(), M.HashEmbedder(), ["k"], chunk_words=20).collect()}
    assert [got[k].alignscore for k in (1, 2, 3, 4)] == [None, 0.0, 1.0, 1.0]
    assert [(got[k].best_ref, got[k].n_abstract_skip) for k in (3, 4)] == [(1, 0), (1, 1)]


def test_alignment_steps_over_shared_words_only():
    import time

    r = np.random.default_rng(2)
    claim, premise = np.arange(30_000), np.arange(30_000) + 29_998
    begin = time.perf_counter()
    assert M.local_alignment(claim, premise, np.ones(len(claim)), 0.1) == pytest.approx(2.0)
    assert time.perf_counter() - begin < 1
    for n, words in ((40, 3), (60, 40)):
        claim, premise, weight = r.integers(0, words, n), r.integers(0, words, n + 9), r.random(n) + 0.1
        assert M.local_alignment(claim, premise, weight, 0.1) == pytest.approx(plain_alignment(claim, premise, weight, 0.1), abs=1e-9)


def test_learning_keeps_counts_of_cells(spark):
    from surveyq.operators import embeddings as L

    df = spark.createDataFrame([([3, 1, 3],), (None,), ([],), ([7],)], "w array<int>").coalesce(1)
    assert [tuple(r) for r in L._counts(df).collect()] == [([1, 3], [1, 2]), ([7], [1])]


def as_its_sql(spark, name, folder, rows, schema, table="documents"):
    """Rows of a query and of its SQL over a small table, sorted as text."""
    import duckdb

    from surveyq.plans.registry import ORACLES, QUERIES

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    return sorted(map(repr, (tuple(r[n] for n in names) for r in QUERIES[name](spark, str(folder)).collect()))), sorted(map(repr, want.fetchall()))


def test_cascade_concat_rounds_as_its_sql(spark, tmp_path):
    """323 of 640 words: a half of the seventh place, which SQL's product in doubles puts below the half."""
    words = [f"w{i:03}" for i in range(640)]
    first, second = words[:110] + ["zzzz"] * 530, words  # the last third of the second half has 213 of its words
    got, want = as_its_sql(spark, "c6_cascade_concat", tmp_path, [(1, " ".join(first) + " " + " ".join(second) + " ")], "doc_id long, text string")
    assert got == want == ["(1, 1, 0.504687)"]


def test_cascade_concat_of_odd_texts_is_as_its_sql(spark, tmp_path):
    texts = ["", None, "  \n ", "a", "?!", " " * 40 + "abstract alpha beta gamma delta epsilon", "alpha beta gamma delta, full text of one " + "." * 16, "one two three four. abstract full text " + "\u65e5" * 14]
    texts += ["istanbul and i others. \u0130stanbul, \u0130 and others", " " * 30 + "abstract words " + "-" * 15, "\u00a0" * 20 + "full text abstract a"]
    rows = [*enumerate(texts), (3, "b c d. B c e f"), (3, "b c d. B c e f"), (3, "full abstract. x y z u v w"), (None, "some words. Some more"), (None, "")]
    got, want = as_its_sql(spark, "c6_cascade_concat", tmp_path, rows, "doc_id long, text string")
    assert got == want


def test_soft_recall_forms_no_row_a_pair(spark):
    """36 million ordered pairs as products of matrices, over several blocks and tiles; a row a pair took 2 microseconds of a core each."""
    import time

    draw = np.random.default_rng(11)
    x = draw.normal(size=(6000, 64)).astype(np.float32)
    x[5990:] = x[:10]  # equal vectors, some across the sets
    df = spark.createDataFrame([(i % 2 if i < 5995 else 1, v.tolist()) for i, v in enumerate(x)], "s int, embedding array<float>").withColumn("k", F.lit("a")).repartition(4)
    kept = M.kept(df, "drawn")
    M.soft_recall(kept.limit(9), kept.limit(9), ["k"]).collect()  # workers are there
    begin = time.perf_counter()
    got = M.soft_recall(kept.where("s = 0"), kept.where("s = 1"), ["k"], block=2500).head().soft_recall
    took = time.perf_counter() - begin
    pick = lambda s: [r.embedding for r in kept.where(f"s = {s}").collect()]
    assert got == pytest.approx(brute_soft_recall(pick(0), pick(1)), rel=1e-10)
    assert took < 15, took
