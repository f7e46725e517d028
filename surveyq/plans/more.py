"""Further queries: one for each remaining operator that the test tables can exercise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyq.functions import scores as S
from surveyq.functions import text as X
from surveyq.functions import vector as V
from surveyq.operators import citations as C
from surveyq.operators import evidence as E
from surveyq.operators import matching as B
from surveyq.operators import models as M
from surveyq.operators import pairs as P
from surveyq.operators import scope as O
from surveyq.operators import scoring as G
from surveyq.operators import summary as U
from surveyq.plans.documents import SQL_HALVES, halves
from surveyq.plans.registry import Tables, query
from surveyq.sources import surveys as R


def _pad(c, n):
    return F.lpad(c.cast("string"), n, "0")


# --- sources ------------------------------------------------------------------


@query("SELECT p_partkey AS doc_id, p_name || chr(10) || chr(10) || p_type AS text FROM part")
def sc6_corpus_texts(t: Tables) -> DataFrame:
    return C.corpus_texts(t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract")))


@query("SELECT DISTINCT string_split(p_type, ' ')[1] AS dataset FROM part")
def sc13_datasets(t: Tables) -> DataFrame:
    return R.datasets(t.part.select(F.translate("p_type", " ", "_").alias("dir")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS title FROM orders")
def sc16_legacy_records(t: Tables) -> DataFrame:
    even = F.col("o_orderkey") % 2 == 0
    new = t.orders.where(even).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("query"))
    old = t.orders.where(~even).select(F.col("o_orderkey").alias("topic_id"), F.col("o_orderstatus").alias("survey_title"))
    both = new.unionByName(old, allowMissingColumns=True)
    raw = F.from_json(F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("topic_id").cast("string").alias("topic_id"), "query", F.col("survey_title").alias("topic"))), R.GENERATION)
    found = R.generations_of(both.select(raw.alias("g")).select("g.*", F.lit("set_model").alias("dir"), F.lit("1").alias("stem")))
    return found.select(F.col("id").cast("long").alias("id"), F.col("query").alias("title"))


@query("SELECT DISTINCT 'run_' || lower(o_orderstatus) || '_k' || (o_custkey % 3) AS run FROM orders")
def sk5_run_ids(t: Tables) -> DataFrame:
    return t.orders.select(R.run_id(F.lit("run"), F.lower("o_orderstatus"), F.concat(F.lit("k"), (F.col("o_custkey") % 3).cast("string")), F.lit(" ")).alias("run")).distinct()


# --- predicates -----------------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE doc_id % 3 > 0 AND length(trim(text)) > 0")
def pf1_eligible(t: Tables) -> DataFrame:
    return G.eligible(t.documents.select("doc_id", "text", (F.col("doc_id") % 3 > 0).alias("success"))).select("doc_id")


@query("""WITH s AS (SELECT l_orderkey AS k, list(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY 1), i AS (SELECT l_orderkey AS k, list(DISTINCT l_linenumber) AS i FROM lineitem WHERE l_discount < 0.09 GROUP BY 1)
SELECT s.k AS survey_key, coalesce(len(list_filter(s, lambda x: NOT list_contains(coalesce(i, []), x))) = 0, false) AS covered FROM s LEFT JOIN i ON s.k = i.k""")
def pf6_fully_covered(t: Tables) -> DataFrame:
    key = F.col("l_orderkey").alias("survey_key")
    scope = t.lineitem.groupBy(key).agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("scope"))
    ids = t.lineitem.where("l_discount < 0.09").groupBy(key).agg(F.collect_set("l_linenumber").alias("ids"))
    return scope.join(ids, "survey_key", "left").select("survey_key", F.coalesce(O.fully_covered(F.col("scope"), F.col("ids")), F.lit(False)).alias("covered"))


@query("""SELECT d.source AS survey_key, list_sort(list(DISTINCT (d.doc_id % 50)::INT)) AS ids FROM documents d WHERE length(trim(d.text)) > 0 AND d.doc_id % 3 > 0 GROUP BY 1""")
def pf7_refs_with_text(t: Tables) -> DataFrame:
    """Every third text is blank."""
    rows = t.documents.select(
        F.col("source").alias("survey_key"), (F.col("doc_id") % 50).cast("string").alias("ref"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).otherwise(" \n").alias("text")
    )
    return E.refs_with_text(rows)


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE substring(text, 1, 400) || chr(10) || chr(10) || '[... truncated at 400 chars ...]' END AS prompt FROM documents")
def pf10_truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.truncate("text", 400).alias("prompt"))


# --- joins ----------------------------------------------------------------------


@query("SELECT l_orderkey AS survey_key, l_linenumber AS idx, CASE WHEN l_partkey % 2 = 0 THEN l_partkey::VARCHAR ELSE 'part ' || l_partkey END AS ref_key FROM lineitem")
def j5_reference_keys(t: Tables) -> DataFrame:
    even = F.col("l_partkey") % 2 == 0
    refs = t.lineitem.select(
        F.col("l_orderkey").alias("survey_key"), F.lit(None).cast("string").alias("idx"), (F.col("l_linenumber") - 1).alias("pos"),
        F.when(even, F.col("l_partkey")).alias("doc_id"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("title"),
    )
    return C.reference_keys(refs).select("survey_key", "idx", "ref_key")


@query("""SELECT doc_id % 20 AS survey_key, doc_id AS claim_id, list_sort(list(i)) AS idxs FROM (SELECT DISTINCT d.doc_id, b.item_id % 7 AS i FROM documents d JOIN benchmark b ON b.item_id % 7 = d.doc_id % 7 OR b.item_id % 7 = (d.doc_id + 1) % 7) GROUP BY 1, 2""")
def j12_claim_evidence(t: Tables) -> DataFrame:
    d = t.documents.select((F.col("doc_id") % 20).alias("survey_key"), F.col("doc_id").alias("claim_id"), F.explode(F.array(F.col("doc_id") % 7, (F.col("doc_id") + 1) % 7)).alias("idx"))
    texts = t.benchmark.groupBy((F.col("item_id") % 7).alias("idx")).agg(F.min("text").alias("text"))
    found = E.claim_evidence(d, texts, ["idx"])
    return found.select("survey_key", "claim_id", F.transform("evidence", lambda e: e["idx"]).alias("idxs"))


@query("""WITH e AS (SELECT p_partkey % 30 AS s, p_partkey AS k FROM part WHERE p_size <= 20), m AS (SELECT p_partkey % 30 AS s, p_partkey AS k FROM part WHERE p_size BETWEEN 10 AND 30)
SELECT s AS survey_key, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.s = e.s AND m.k = e.k) GROUP BY 1""")
def j17_unmatched(t: Tables) -> DataFrame:
    keyed = t.part.select((F.col("p_partkey") % 30).alias("survey_key"), F.col("p_partkey").alias("k"), F.col("p_partkey").alias("j"), "p_size")
    left, _ = B.unmatched(keyed.where("p_size <= 20"), keyed, keyed.where("p_size BETWEEN 10 AND 30"))
    return left.groupBy("survey_key").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS norm, min(p_partkey) AS doc_id FROM part WHERE p_size <= 25 GROUP BY 1)
SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'own title' END AS title, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'own url' END AS url, CASE WHEN p_size % 2 = 0 THEN doc_id END AS doc_id
FROM part LEFT JOIN i ON norm = regexp_replace(lower(p_name), '[^a-z]', '', 'g')""")
def j18_enrichment(t: Tables) -> DataFrame:
    refs = t.part.select(F.col("p_partkey").alias("k"), F.lit("own title").alias("title"), F.lit("own url").alias("url"), F.lit("").alias("arxiv_id"))
    service = t.part.select(
        F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("title"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("url")
    )
    index = t.part.where("p_size <= 25").groupBy(X.norm_title("p_name").alias("norm_title")).agg(F.min("p_partkey").alias("doc_id"))
    return C.enrich_references(refs, service, index, ["k"]).select("k", "title", "url", "doc_id")


@query("SELECT l_partkey AS key, count(*) AS n, min(p_name) AS fetched FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 25 GROUP BY 1")
def j22_cross_walk(t: Tables) -> DataFrame:
    refs = t.lineitem.select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("o"))
    cache = t.part.where("p_size > 25").select(F.col("p_partkey").alias("key"))
    plan = E.fetch_plan(refs, cache, "key")
    fetched = plan.join(t.part, F.col("key") == F.col("p_partkey")).select("key", F.col("p_name").alias("v"))
    return E.back_to_references(refs, fetched, "key").where("v IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("fetched"))


@query("SELECT n_regionkey AS topic, count(*) AS n FROM (SELECT n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY 1")
def j24_topic_pairs(t: Tables) -> DataFrame:
    g = t.nation.select(F.col("n_regionkey").alias("topic"), F.col("n_name").alias("name"))
    h = t.region.select(F.col("r_regionkey").alias("topic"), F.col("r_name").alias("name"))
    return G.topic_pairs(g, h).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey AS survey_key, CASE WHEN c_custkey % 4 = 0 THEN 'second' ELSE 'first' END AS arxiv_id FROM customer""")
def j25_j26_candidates(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    title = F.concat(F.lit("Survey of things number "), k.cast("string"))
    who = F.array(F.concat(F.lit("Jane Doe"), F.translate(k.cast("string"), "0123456789", "abcdefghij")))
    surveys = t.customer.select(k.alias("survey_key"), title.alias("survey_title"), F.lit("2020").alias("year"), who.alias("authors"))
    cand = lambda p, name, title, authors: t.customer.select(
        k.alias("survey_key"), F.lit(p).alias("priority"), F.lit(0).alias("pos"), title.alias("title"), F.lit("2020").alias("year"), authors.alias("authors"), F.lit(name).alias("arxiv_id")
    )
    first = cand(1, "first", F.when(k % 4 == 0, "nothing alike").otherwise(title), who)
    return C.pick_candidate(surveys, first.unionByName(cand(2, "second", title, who))).select("survey_key", "arxiv_id")


# --- text -----------------------------------------------------------------------


@query("SELECT p_partkey, p_name AS title FROM part")
def t13_bib_title(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    raw = (
        F.when(k == 0, F.concat(F.lit("\\bibinfo{author}{X} \\bibinfo{title}{"), "p_name", F.lit("}. 2020")))
        .when(k == 1, F.concat(F.lit("A. Author, ``"), "p_name", F.lit(",'' Venue, 2019")))
        .otherwise(F.concat(F.lit("A. Author.\n\\newblock "), "p_name", F.lit(".\n\\newblock Venue")))
    )
    return t.part.select("p_partkey", X.bib_title(raw).alias("title"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n, trim(string_split(text, chr(10))[1]) AS first FROM documents WHERE length(trim(string_split(text, chr(10))[1])) > 0")
def t17_tagged_sentences(t: Tables) -> DataFrame:
    tagged = F.array_join(F.transform(F.split("text", "\n"), lambda s, i: F.concat(F.lit("[A.S"), (i + 1).cast("string"), F.lit("] "), s)), "\n")
    rows = t.documents.where("length(trim(split(text, '\n')[0])) > 0").select("doc_id", X.split_tagged_sentences(tagged).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0))["sentence"].alias("first"))


@query("SELECT p_partkey, [p_name, 'Second part'] AS titles FROM part WHERE length(p_name) > 5")
def t24_outline_sections(t: Tables) -> DataFrame:
    text = F.concat(F.lit("1. "), "p_name", F.lit(":\n- no\n## Second part\n# abc"))
    return t.part.where("length(p_name) > 5").select("p_partkey", X.outline_sections(text).alias("titles"))


@query("SELECT p_partkey, ['Smith et al., 20' || lpad((p_size % 30)::VARCHAR, 2, '0'), '[1] ' || p_name] AS refs FROM part")
def t25_author_year(t: Tables) -> DataFrame:
    mark = F.concat(F.lit("Smith et al., 20"), _pad(F.col("p_size") % 30, 2))
    text = F.concat(F.lit("As ["), mark, F.lit("] says.\n## References\n[1] "), "p_name", F.lit("\n\n# end"))
    return t.part.select("p_partkey", X.author_year_references(text).alias("refs"))


@query("SELECT p_partkey, p_size AS idx, p_name AS title, '2001.' || lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS arxiv_id FROM part")
def t26_reference_lines(t: Tables) -> DataFrame:
    text = F.concat(
        F.lit("Body\n## References\n["), F.col("p_size").cast("string"), F.lit("] "), "p_name", F.lit(" URL: https://arxiv.org/abs/2001."), _pad(F.col("p_partkey") % 100000, 5), F.lit("\n# Appendix\n[99] no")
    )
    return t.part.select("p_partkey", F.inline(X.reference_lines(text))).select("p_partkey", "idx", "title", "arxiv_id")


@query("SELECT p_partkey, 'Intro' || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || '[' || p_size || '] ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '## Next' || chr(10) || 'x' ELSE '' END AS text FROM part")
def t27_replace_references(t: Tables) -> DataFrame:
    old = F.when(F.col("p_partkey") % 2 == 0, "Intro\n\n## References\n[1] old\n\n## Next\nx").otherwise("Intro\n")
    refs = F.array(F.struct(F.col("p_size").alias("idx"), F.col("p_name").alias("title"), F.lit("").alias("canonical_title")))
    return t.part.select("p_partkey", X.replace_references(old, refs).alias("text"))


@query("SELECT doc_id, nullif(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), '') AS text FROM documents")
def t33_text_from_index(t: Tables) -> DataFrame:
    """The whole texts of all rows; a text without a word gives null."""
    index = t.documents.select("doc_id", X.word_index(F.split(X.collapse(F.coalesce("text", F.lit(""))), " ")).alias("m"))
    return index.select("doc_id", X.blank_to_null(X.text_from_index(F.col("m"))).alias("text"))




_SQL_PLAIN_SENTENCES = r"""list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 30)"""
_SQL_NORM = r"""lower(trim(regexp_replace(regexp_replace(s, '\[[^\]]{1,40}\]', '', 'g'), '\s+', ' ', 'g')))"""


@query(f"""WITH l AS (SELECT doc_id, {_SQL_PLAIN_SENTENCES} AS l FROM documents), n AS (SELECT doc_id, len(l) AS total, list_transform(l, lambda s: {_SQL_NORM}) AS n FROM l WHERE len(l) >= 4),
p AS (SELECT doc_id, total, list_position(n, n[4]) AS k FROM n)
SELECT doc_id, k AS paragraph_start, k AS paragraph_end, greatest(k - 3, 0) + 1 AS window_start, least(total, k + 2) AS window_end, total FROM p""")
def t40_sentence_window(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "text", F.get(X.split_sentences("text", drop_markers=False), F.lit(3)).alias("s")).where("s IS NOT NULL")
    return rows.select("doc_id", X.sentence_window("text", "s", 2).alias("w")).select("doc_id", "w.paragraph_start", "w.paragraph_end", "w.window_start", "w.window_end", "w.total")


@query("SELECT event_id, CASE WHEN event_id % 8 <= 5 THEN (event_id % 8)::INT END AS level FROM events")
def t45_levels(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.parse_level(F.concat(F.lit(" "), (F.col("event_id") % 8).cast("string"), F.lit("\n"))).alias("level"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Rewritten ' || doc_id WHEN doc_id % 3 = 1 THEN 'original' END AS selected, 'Whole ' || doc_id AS sentence, ['A' || doc_id, 'B is so'] AS claims FROM documents")
def t46_claim_parsers(t: Tables) -> DataFrame:
    k, d = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    head = "Final submission:\nContains a specific and verifiable proposition\n\nSentence with only verifiable information:\n"
    answer = F.when(k == 0, F.concat(F.lit(head + "Rewritten "), d)).when(k == 1, head + "remains unchanged").otherwise("Final submission:\nDoes NOT contain a specific and verifiable proposition")
    listed = F.concat(F.lit(X.PROPOSITIONS + '\n["A'), d, F.lit('", "B is so - true or false?"]'))
    return t.documents.select(
        "doc_id", X.parse_selection(answer, F.lit("original"))["sentence"].alias("selected"),
        X.parse_disambiguation(F.concat(F.lit("DecontextualizedSentence: Whole "), d))["sentence"].alias("sentence"), X.parse_decomposition(listed)["claims"].alias("claims"),
    )


@query("SELECT p_partkey, p_name || '[SEP]' || p_type AS paper, 'Abstract:' || chr(10) || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || chr(10) || 'Full text:' || chr(10) || p_type ELSE '' END AS evidence FROM part")
def t50_t51_composed(t: Tables) -> DataFrame:
    full = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" ")
    return t.part.select("p_partkey", X.paper_text("p_name", "p_type").alias("paper"), X.evidence_text(["Abstract:", "Full text:"], ["p_name", full]).alias("evidence"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 1000 THEN (o_orderkey // 1000) || 'k' ELSE o_orderkey::VARCHAR END AS short FROM orders")
def t53_short_counts(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", X.short_count("o_orderkey").alias("short"))


# --- vectors, scores, aggregates ------------------------------------------------


@query()
def v5_pca(t: Tables) -> DataFrame:
    dots, _ = V.pca_dots(t.embeddings.where("label < 5"), t.embeddings.where("label >= 5"), "vec_id")
    return dots.select("vec_id", "group", "x", "y")


_SQL_BUCKET = "CASE " + " ".join(f"WHEN v >= {a!r}::DOUBLE AND v < {b!r}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(V.EDGES, V.EDGES[1:]))) + " END"


@query(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 10 AS v FROM lineitem), b AS (SELECT l_orderkey, l_linenumber, l_partkey, {_SQL_BUCKET} AS bucket FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('7|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), l_orderkey, l_linenumber, l_partkey) AS r
  FROM b WHERE bucket IS NOT NULL) WHERE r = 1""")
def v10_one_per_bucket(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", V.similarity_bucket(F.col("l_discount") * 10).alias("bucket")).where("bucket IS NOT NULL")
    return P.one_per_bucket(rows, "bucket", 7, "l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH g AS (SELECT o_custkey AS s, sum((o_orderstatus = 'F')::INT) AS tp, sum((o_orderstatus = 'O')::INT) AS fp, sum((o_orderstatus = 'P')::INT) AS fn FROM orders GROUP BY 1), m AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM g)
SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM m""")
def ag20_micro(t: Tables) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    each = t.orders.groupBy("o_custkey").agg(n("F").alias("tp"), n("O").alias("fp"), n("P").alias("fn"))
    return P.micro(each).select("tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""SELECT o_custkey AS k, count(*) FILTER (o_orderkey % 3 = 0) AS n_no_evidence, count(*) FILTER (o_orderkey % 5 = 0) AS n_scope_failed FROM orders GROUP BY 1""")
def ag3_claim_failures(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    claims = t.orders.select(
        F.col("o_custkey").alias("k"), F.when(o % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("evidence_refs"), F.when(o % 5 == 0, True).alias("scope_failed")
    )
    return G.claim_failures(claims, ["k"])


@query("""WITH f AS (SELECT o_custkey AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT k, n AS n_claims, round(s::DOUBLE / n, 6) AS cit_correct_overall FROM f""")
def ag2_profile_on_subset(t: Tables) -> DataFrame:
    claims = t.orders.select(F.col("o_custkey").alias("k"), F.lit("A").alias("category"), (F.col("o_orderstatus") == "F").alias("supported"), F.array((F.col("o_orderkey") % 2).cast("string")).alias("scope"))
    covered = claims.where(O.fully_covered(F.col("scope"), F.array(F.lit(0))))
    return G.citation_correctness(covered, ["k"]).select("k", "n_claims", F.round("cit_correct_overall", 6).alias("cit_correct_overall"))


@query("""SELECT conv_id, count(*) - 1 AS n_candidates, count(*) FILTER (turn > 0 AND turn % 2 = 0) AS n_same_topic, count(*) FILTER (turn > 0 AND turn % 4 = 0) AS n_confirmed,
  round(count(*) FILTER (turn > 0 AND turn % 4 = 0)::DOUBLE / nullif(count(*) FILTER (turn > 0 AND turn % 2 = 0), 0), 6) AS m_contr FROM conversations GROUP BY 1 HAVING count(*) > 1""")
def ag6_contradictions(t: Tables) -> DataFrame:
    turn = F.col("turn").cast("string")
    pairs = t.conversations.where("turn > 0").select("conv_id", F.concat(F.lit("t"), turn, F.lit(";")).alias("s1"), F.lit("x").alias("s2"))
    number = lambda p: F.regexp_extract(p, r"t(\d+);", 1).cast("int")
    out = M.contradictions(pairs, M.RuleJudge(lambda p: number(p) % 2 == 0), M.RuleJudge(lambda p: number(p) % 4 == 0), ["conv_id"])
    return out.select("conv_id", "n_candidates", "n_same_topic", "n_confirmed", F.round("m_contr", 6).alias("m_contr"))


@query("""WITH r AS (SELECT source, avg((length(text) > 1000)::INT::DOUBLE) AS r FROM documents GROUP BY 1) SELECT count(r) AS n, round(avg(r), 6) AS mean, round(min(r), 6) AS min, round(quantile_cont(r, 0.5), 6) AS median, round(max(r), 6) AS max FROM r""")
def ag17_rate_stats(t: Tables) -> DataFrame:
    rates = t.documents.groupBy("source").agg(F.avg((F.length("text") > 1000).cast("int").cast("double")).alias("r"))
    return E.rate_stats(rates, "r").select("n", *(F.round(c, 6).alias(c) for c in ("mean", "min", "median", "max")))


@query("""SELECT count(*) AS n_refs, count(*) FILTER (p_size % 2 = 0) AS n_title, count(*) AS n_url, 0::BIGINT AS n_arxiv_id, count(*) FILTER (p_size % 5 = 0) AS n_semantic_scholar_id, count(*) AS n_doc_id FROM part""")
def ag19_enrichment_counts(t: Tables) -> DataFrame:
    refs = t.part.select(
        F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(" ").alias("title"), F.col("p_brand").alias("url"), F.lit(None).cast("string").alias("arxiv_id"),
        F.when(F.col("p_size") % 5 == 0, "s").alias("semantic_scholar_id"), F.lit(0).alias("doc_id"),
    )
    return C.enrichment_counts(refs)


@query("""SELECT lang AS k, count(*) FILTER (length(text) > 300) AS n, count(*) FILTER (length(text) <= 300) AS n_failed, round(avg(length(text)) FILTER (length(text) > 300), 6) AS mean, round(quantile_cont(length(text)::DOUBLE, 0.25) FILTER (length(text) > 300), 6) AS q25,
  round(quantile_cont(length(text)::DOUBLE, 0.5) FILTER (length(text) > 300), 6) AS median, round(quantile_cont(length(text)::DOUBLE, 0.75) FILTER (length(text) > 300), 6) AS q75, (max(length(text)) FILTER (length(text) > 300))::DOUBLE AS max FROM documents GROUP BY 1""")
def ag29_section_lengths(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("lang").alias("k"), F.when(F.length("text") > 300, F.length("text").cast("double")).alias("length"))
    return G.section_lengths(rows, ["k"]).select("k", "n", "n_failed", *(F.round(c, 6).alias(c) for c in ("mean", "q25", "median", "q75")), "max")


@query("""WITH s AS (SELECT l_orderkey % 50 AS k, l_orderkey AS st, bool_or(l_tax < 0.03) AS ok, count(*) FILTER (l_tax < 0.03 AND (l_discount < 0.05 OR NOT l_quantity < 25)) AS good, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT k, round(avg(ok::INT::DOUBLE), 6) AS citation_recall, round(sum(good)::DOUBLE / sum(n), 6) AS citation_precision FROM s GROUP BY k""")
def v21_citation_quality(t: Tables) -> DataFrame:
    nli = t.lineitem.select(
        (F.col("l_orderkey") % 50).alias("k"), F.col("l_orderkey").alias("statement"), F.col("l_linenumber").alias("idx"), (F.col("l_tax") < 0.03).alias("all_entail"),
        (F.col("l_discount") < 0.05).alias("one_entails"), (F.col("l_quantity") < 25).alias("rest_entail"),
    )
    return G.citation_quality(nli, ["k"]).select("k", F.round("citation_recall", 6).alias("citation_recall"), F.round("citation_precision", 6).alias("citation_precision"))


@query("SELECT l_orderkey AS k, max(l_extendedprice) / max(l_quantity) AS cer FROM lineitem GROUP BY 1")
def v15_cer(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_extendedprice").alias("m"), F.max("l_quantity").alias("c"))
    return g.select("k", G.cer(F.col("m"), F.col("c")).alias("cer"))


@query("SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN l_tax < 0.08 THEN l_discount >= 0.05 END AS supported FROM lineitem")
def v19_supported(t: Tables) -> DataFrame:
    score = F.when(F.col("l_tax") < 0.08, F.col("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", S.supported(score, 0.05).alias("supported"))


# --- windows, sets, cascades ------------------------------------------------------


@query("""WITH p AS (SELECT l_suppkey AS survey_key, l_orderkey % 20 AS j, l_partkey AS k, max(l_discount) AS score FROM lineitem GROUP BY 1, 2, 3)
SELECT survey_key, j, k, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY survey_key, j ORDER BY score DESC, k)::INT AS rank FROM p) WHERE rank <= 2""")
def w4_top_entries(t: Tables) -> DataFrame:
    pairs = t.lineitem.groupBy(F.col("l_suppkey").alias("survey_key"), (F.col("l_orderkey") % 20).alias("j"), F.col("l_partkey").alias("k")).agg(F.max("l_discount").alias("score"))
    return B.top_entries(pairs, 2)


@query("SELECT o_orderkey FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 50")
def w8_sample(t: Tables) -> DataFrame:
    return U.sample_rows(t.orders.select("o_orderkey"), 50, 42, "o_orderkey")


@query(f"SELECT {_SQL_BUCKET} AS bucket, count(*) AS n FROM (SELECT l_discount * 10 AS v FROM lineitem) GROUP BY 1")
def ag28_bucket_counts(t: Tables) -> DataFrame:
    return V.bucket_counts(t.lineitem.select((F.col("l_discount") * 10).alias("similarity")), "similarity")


@query("SELECT o_custkey AS k, list_sort(list(DISTINCT x)) AS refs FROM (SELECT o_custkey, unnest([o_orderkey % 5, o_orderkey % 7]) AS x FROM orders) GROUP BY 1")
def s1_citation_union(t: Tables) -> DataFrame:
    each = t.orders.select(F.col("o_custkey").alias("k"), F.array(F.col("o_orderkey") % 5, F.col("o_orderkey") % 7).alias("r"))
    return each.groupBy("k").agg(O.citation_union("r").alias("refs"))


@query("SELECT DISTINCT c_mktsegment AS kind, max(c_custkey) AS at FROM customer GROUP BY 1")
def s3_variants(t: Tables) -> DataFrame:
    return U.distinct_runs(t.customer.select(F.col("c_mktsegment").alias("kind"), F.col("c_custkey").alias("at")), ["kind"], "at")


@query("""SELECT DISTINCT a.o_custkey AS g, least(a.o_orderkey, b.o_orderkey) AS a, greatest(a.o_orderkey, b.o_orderkey) AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey""")
def s4_record_pairs(t: Tables) -> DataFrame:
    records = t.orders.groupBy(F.col("o_custkey").alias("g")).agg(F.collect_set("o_orderkey").alias("ids")).withColumn("r", F.lit(1))
    return P.all_pairs_of(records, "g", "r", "ids")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'ss' WHEN o_orderkey % 3 = 1 THEN 'arxiv' END AS source, CASE WHEN o_orderkey % 3 = 2 THEN 2 END AS n_errors FROM orders""")
def c2_error_trail(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    refs = t.orders.select("o_orderkey", k.alias("key"))
    ss = t.orders.where(k % 3 == 0).select(k.alias("key"), F.lit("abstract").alias("v"))
    arxiv = t.orders.where(k % 3 == 1).select(k.alias("key"), F.lit("abstract").alias("v")).unionByName(t.orders.where(k % 3 == 2).select(k.alias("key"), F.lit(" ").alias("v")))
    out = E.waterfall(refs, [("ss", ss, "key", "v"), ("arxiv", arxiv, "key", "v")])
    return out.select("o_orderkey", F.col("abstract_source").alias("source"), F.when(F.col("abstract_errors").isNotNull(), F.size("abstract_errors")).alias("n_errors"))


@query("SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'doi' WHEN o_orderkey % 4 = 1 THEN 'arxiv' WHEN o_orderkey % 4 = 2 THEN 'ss' ELSE 'title' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def c4_identifier(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    only = lambda i, v: F.when(k % 4 == i, v)
    name = E.identifier(only(0, F.lit("10.1/x")), only(1, F.lit("2001.00001v2")), only(2, F.lit("abc")), F.lit("a title"))
    return t.orders.groupBy(F.substring_index(name, ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey % 300 AS key, CASE WHEN o_custkey % 300 < 100 THEN 'known' WHEN o_custkey % 300 % 7 = 0 THEN NULL ELSE 'new' END AS answer, count(*) AS n FROM orders GROUP BY 1, 2")
def c9_judge_cache(t: Tables) -> DataFrame:
    asked = t.orders.select((F.col("o_custkey") % 300).alias("key"))
    cache = asked.where("key < 100").distinct().withColumn("answer", F.lit("known"))
    call = lambda df: df.withColumn("answer", F.when(F.col("key") % 7 != 0, "new")).withColumn("status", F.when(F.col("key") % 7 == 0, "failed").otherwise("ok"))
    answers, _ = M.cached(asked, cache, "key", "answer", call)
    return answers.groupBy("key", "answer").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0")
def c11_reuse(t: Tables) -> DataFrame:
    return E.reuse_resolved(t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, True).alias("abstract_only")), True).select("o_orderkey")


def c7_concat_alignment_whole(t: Tables) -> DataFrame:
    """The whole texts of all rows: the second half is the claim, the first the premise."""
    rows = halves(t).select("doc_id", F.col("r").alias("claim"), F.array(F.struct(F.lit(1).alias("idx"), F.col("c").alias("text"))).alias("evidence"))
    return M.align_concat(rows, M.OverlapAligner()).select("doc_id", "alignscore")


def c8_per_ref_alignment_whole(t: Tables) -> DataFrame:
    """As c7, with a reference that has no word of the claim before the one that may."""
    one = lambda i, text: F.struct(F.lit(i).alias("idx"), text.alias("text"))
    rows = halves(t).select("doc_id", F.col("r").alias("claim"), F.array(one(1, F.lit("0x0")), one(2, F.col("c"))).alias("evidence"))
    return M.align_per_ref(rows, M.OverlapAligner(), ["doc_id"]).select("doc_id", "alignscore", "best_ref")


_SHARED = f"""SELECT doc_id, len(list_distinct(r)) AS n, len(list_intersect(list_distinct(r), c)) AS b FROM {SQL_HALVES}"""


@query(f"SELECT doc_id, round(CASE WHEN n > 0 THEN b::DOUBLE / n ELSE 0 END, 6) AS alignscore FROM ({_SHARED})")
def c7_concat_alignment(t: Tables) -> DataFrame:
    return c7_concat_alignment_whole(t).select("doc_id", F.round("alignscore", 6).alias("alignscore"))


@query(f"SELECT doc_id, round(CASE WHEN n > 0 THEN b::DOUBLE / n ELSE 0 END, 6) AS alignscore, CASE WHEN n > 0 AND b > 0 THEN 2 ELSE 1 END AS best_ref FROM ({_SHARED})")
def c8_per_ref_alignment(t: Tables) -> DataFrame:
    return c8_per_ref_alignment_whole(t).select("doc_id", F.round("alignscore", 6).alias("alignscore"), "best_ref")


@query("""WITH a AS (SELECT CASE WHEN o_custkey % 7 > 0 THEN chr((65 + o_custkey % 6)::INT) END AS letter FROM orders)
SELECT letter, CASE WHEN letter <= 'D' THEN letter ELSE 'A' END AS category, CASE WHEN letter <= 'D' THEN 'high' ELSE 'low' END AS confidence, count(*) AS n FROM a GROUP BY 1""")
def m5_categories(t: Tables) -> DataFrame:
    """Answers A to F in either case with white space, and no answer: letters beyond D and none fall back."""
    letter = F.when(F.col("o_custkey") % 7 > 0, F.char(65 + F.col("o_custkey") % 6))
    said = F.concat(F.lit(" "), F.when(F.col("o_orderkey") % 2 == 0, F.lower(letter)).otherwise(letter), F.lit("\n"))
    category, confidence = M.category(said)
    return t.orders.groupBy(letter.alias("letter"), category.alias("category"), confidence.alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderkey % 2 = 0 AS is_critical, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE (o_orderkey % 5 + 1)::INT END AS modality_level FROM orders")
def m6_expert_flags(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    level = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit(', "modality_level": '), (k % 5 + 1).cast("string")))
    said = F.concat(F.lit('```json\n{"is_critical": '), F.when(k % 2 == 0, "true").otherwise("false"), level, F.lit("}\n```"))
    return t.orders.select("o_orderkey", M.expert_flags(said).alias("f")).select("o_orderkey", "f.is_critical", "f.modality_level")


_SQL_UNIT = "(SELECT label, vec_id % 2 AS side, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))), 1e-8)) AS v FROM embeddings WHERE embedding IS NOT NULL)"


def _soft(where: str) -> str:
    return f"SELECT a.label, sum(1 / s) AS size FROM (SELECT a.label, a.i, sum(greatest(list_dot_product(a.v, b.v), 0)) AS s FROM n a JOIN n b ON a.label = b.label AND {where} GROUP BY 1, 2) a GROUP BY 1"


@query(f"""WITH n AS (SELECT label, side, v, row_number() OVER () AS i FROM {_SQL_UNIT}), a AS ({_soft("a.side = 0 AND b.side = 0")}), b AS ({_soft("a.side = 1 AND b.side = 1")}), c AS ({_soft("true")})
SELECT c.label, round((a.size + coalesce(b.size, 0) - c.size) / a.size, 9) AS soft_recall FROM c JOIN a ON a.label = c.label LEFT JOIN b ON b.label = c.label""")
def m11_soft_recall(t: Tables) -> DataFrame:
    e = t.embeddings
    return M.soft_recall(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), ["label"]).select("label", F.round("soft_recall", 9).alias("soft_recall"))
