"""Queries over metric tables: summaries, deltas, votes, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyq.functions import scores as S
from surveyq.functions import vector as V
from surveyq.operators import pairs as P
from surveyq.operators import scoring as G
from surveyq.operators import summary as M
from surveyq.plans.registry import Tables, query

#: Order values as a long metric table: metric = segment, model = status, survey = customer.
_LONG = """
WITH base AS (
  SELECT c_mktsegment AS metric, o_orderstatus AS model, o_custkey AS survey_id, avg(o_totalprice) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)
"""


def _long(t: Tables) -> DataFrame:
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("metric"), F.col("o_orderstatus").alias("model"), F.col("o_custkey").alias("survey_id"))
        .agg(F.avg("o_totalprice").alias("value"))
    )


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else c for c, k in df.dtypes))


@query(_LONG + """, d AS (
  SELECT a.metric, b.value - a.value AS delta FROM base a JOIN base b USING (metric, survey_id) WHERE a.model = 'F' AND b.model = 'O')
SELECT metric, count(*) AS n, round(avg(delta), 6) AS mean, round(stddev_pop(delta), 6) AS std_pop, round(min(delta), 6) AS min,
  round(quantile_cont(delta, 0.1), 6) AS q10, round(quantile_cont(delta, 0.25), 6) AS q25, round(quantile_cont(delta, 0.5), 6) AS median,
  round(quantile_cont(delta, 0.75), 6) AS q75, round(quantile_cont(delta, 0.9), 6) AS q90, round(max(delta), 6) AS max,
  round(100 * avg(CAST(CAST(delta > 0 AS INT) AS DOUBLE)), 6) AS share_up, round(100 * avg(CAST(CAST(delta < 0 AS INT) AS DOUBLE)), 6) AS share_down
FROM d GROUP BY metric""")
def q1_delta_summary(t: Tables) -> DataFrame:
    return _round(M.delta_summary(M.paired_delta(_long(t), "F", "O"), ["metric"]))


@query(_LONG + """SELECT model, metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std_sample,
  round(stddev_pop(value), 6) AS std_pop, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
  round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max
FROM base GROUP BY model, metric""")
def ag9_metric_summary(t: Tables) -> DataFrame:
    return _round(M.metric_summary(_long(t), ["model", "metric"]))


@query("""SELECT o_orderstatus AS model, o_custkey AS survey_id, o_orderkey AS run FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""")
def w1_latest_run(t: Tables) -> DataFrame:
    runs = M.latest_runs(t.orders, ["o_orderstatus", "o_custkey"], "o_orderdate", "o_orderkey")
    return runs.select(F.col("o_orderstatus").alias("model"), F.col("o_custkey").alias("survey_id"), F.col("o_orderkey").alias("run"))


@query(_LONG + """SELECT model, round(avg(value) FILTER (metric = 'AUTOMOBILE'), 6) AS "AUTOMOBILE", round(avg(value) FILTER (metric = 'BUILDING'), 6) AS "BUILDING",
  round(avg(value) FILTER (metric = 'MACHINERY'), 6) AS "MACHINERY" FROM base GROUP BY model""")
def ag11_pivot(t: Tables) -> DataFrame:
    return _round(M.wide_means(_long(t), ["model"], ["AUTOMOBILE", "BUILDING", "MACHINERY"]))


@query(_LONG + "SELECT survey_id FROM base WHERE model IN ('F', 'O', 'P') GROUP BY survey_id HAVING count(DISTINCT model) = 3")
def j20_shared_surveys(t: Tables) -> DataFrame:
    return M.shared_surveys(_long(t), ["F", "O", "P"])


@query(_LONG + """, m AS (SELECT model, metric, avg(value) AS v FROM base GROUP BY 1, 2)
SELECT model, metric, round(v / CASE WHEN max(v) OVER (PARTITION BY metric) > 0 THEN max(v) OVER (PARTITION BY metric) ELSE 1 END, 6) AS scaled FROM m""")
def v12_radar(t: Tables) -> DataFrame:
    means = _long(t).groupBy("model", "metric").agg(F.avg("value").alias("v"))
    return S.radar(means, "metric", "v").select("model", "metric", F.round("scaled", 6).alias("scaled"))


@query("""SELECT l_orderkey AS survey_id, l_linenumber AS line, metric, CAST(value AS DOUBLE) AS value FROM (
  SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem)
UNPIVOT (value FOR metric IN (quantity, discount, tax))""")
def pf3_unpivot(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("survey_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )
    return M.to_long(lines, ["survey_id", "line"], ["quantity", "discount", "tax"]).where("value IS NOT NULL")




@query("""SELECT event_id, CASE lower(json_extract_string(props, '$.k')) WHEN 'true' THEN 1.0 WHEN 'false' THEN 0.0
  ELSE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS value FROM events""")
def pf2_numeric_coercion(t: Tables) -> DataFrame:
    return t.events.select("event_id", M.as_metric(F.get_json_object("props", "$.k")).alias("value"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT user_id, sum(n)::BIGINT AS n, round(-sum(p * ln(p)), 6) AS entropy FROM s GROUP BY user_id""")
def v6_event_entropy(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("user_id").agg(F.sum("n").alias("total"), F.collect_list("n").alias("each"))
    return per.select("user_id", F.col("total").alias("n"), F.round(S.entropy(F.col("each")), 6).alias("entropy"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT event_type, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY user_id) AS p FROM c)
SELECT 'all' AS model, event_type AS level, round(avg(p), 6) AS share FROM s GROUP BY event_type""")
def ag13_modality_mix(t: Tables) -> DataFrame:
    levels = t.events.groupBy(F.col("user_id").alias("survey_id"), F.col("event_type").alias("level")).agg(F.count(F.lit(1)).alias("n")).withColumn("model", F.lit("all"))
    return _round(M.modality_mix(levels), 6)


@query("""WITH c AS (SELECT l_returnflag AS model, l_orderkey AS survey_id, l_linestatus AS category, count(*) AS n, count(*) FILTER (l_discount >= 0.05) AS n_supported
  FROM lineitem GROUP BY 1, 2, 3), k AS (SELECT l_orderkey AS survey_id, count(*) AS n_claims FROM lineitem GROUP BY 1)
SELECT model, category, round(avg(n::DOUBLE / n_claims), 6) AS share_of_claims, round(avg(n::DOUBLE / t), 6) AS share_of_counted, round(avg(n_supported::DOUBLE / n), 6) AS support_rate
FROM (SELECT c.*, n_claims, sum(n) OVER (PARTITION BY model, c.survey_id) AS t FROM c JOIN k USING (survey_id)) GROUP BY model, category""")
def ag12_category_shares(t: Tables) -> DataFrame:
    counts = t.lineitem.groupBy(F.col("l_returnflag").alias("model"), F.col("l_orderkey").alias("survey_id"), F.col("l_linestatus").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") >= 0.05).alias("n_supported")
    )
    claims = t.lineitem.groupBy(F.col("l_orderkey").alias("survey_id")).agg(F.count(F.lit(1)).alias("n_claims"))
    return _round(M.category_shares(counts.join(claims, "survey_id")), 6)


@query("""SELECT o_orderpriority AS system, count(*) FILTER (v = 'win') AS win, count(*) FILTER (v = 'tie') AS tie, count(*) FILTER (v = 'lose') AS lose,
  count(*) FILTER (v = 'unknown') AS unknown, round(coalesce((count(*) FILTER (v = 'win') + 0.5::DOUBLE * count(*) FILTER (v = 'tie')) / nullif(count(*) FILTER (v <> 'unknown'), 0), 0), 6) AS win_rate
FROM (SELECT o_orderpriority, CASE WHEN s IS NULL OR o IS NULL THEN 'unknown' WHEN s - o > 1 THEN 'win' WHEN o - s > 1 THEN 'lose' ELSE 'tie' END AS v FROM (
  SELECT o_custkey, o_orderpriority, avg(o_totalprice) FILTER (o_orderstatus = 'F') / 5000 AS s, avg(o_totalprice) FILTER (o_orderstatus = 'O') / 5000 AS o
  FROM orders GROUP BY 1, 2)) GROUP BY 1""")
def ag25_win_rates(t: Tables) -> DataFrame:
    part = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))) / 5000
    both = t.orders.groupBy("o_custkey", F.col("o_orderpriority").alias("system")).agg(part("F").alias("a"), part("O").alias("b"))
    return _round(G.win_rates(both.withColumn("verdict", S.verdict_by_scores(F.col("a"), F.col("b"))), ["system"]), 6)


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_a, count(*) FILTER (o_orderstatus = 'O') AS n_b, count(*) FILTER (o_orderstatus = 'P') AS n_tie,
  CASE WHEN count(*) FILTER (o_orderstatus = 'F') > greatest(count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'P')) THEN 'win'
       WHEN count(*) FILTER (o_orderstatus = 'O') > greatest(count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'P')) THEN 'lose' ELSE 'tie' END AS cwr
FROM orders GROUP BY o_custkey""")
def v18_votes(t: Tables) -> DataFrame:
    winner = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").when(F.col("o_orderstatus") == "P", "TIE")
    calls = t.orders.select("o_custkey", winner.alias("winner"), F.col("o_totalprice").alias("score_a"), F.lit(0.0).alias("score_b"))
    return G.pairwise_verdicts(calls, ["o_custkey"]).select("o_custkey", "n_a", "n_b", "n_tie", "cwr")


@query("""WITH s AS (SELECT unnest([0, 1]) AS class), l AS (SELECT quality AS p, 1 - toxic AS t FROM labels), k AS (
  SELECT class, count(*) FILTER (t = class AND p = class) AS tp, count(*) FILTER (t <> class AND p = class) AS fp, count(*) FILTER (t = class AND p <> class) AS fn FROM s, l GROUP BY class)
SELECT class, tp, fp, fn, tp + fn AS support, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM k""")
def ag21_class_scores(t: Tables) -> DataFrame:
    return _round(S.class_scores(t.labels.select(F.col("quality").alias("p"), (1 - F.col("toxic")).alias("t")), "t", "p", [0, 1]), 6)


@query("""SELECT quality, count(*) FILTER (toxic = 0) AS "0", count(*) FILTER (toxic = 1) AS "1" FROM labels WHERE quality IN (0, 1) AND toxic IN (0, 1) GROUP BY quality""")
def v8_confusion(t: Tables) -> DataFrame:
    return S.confusion(t.labels, "quality", "toxic", [0, 1])


@query("""WITH g AS (SELECT DISTINCT l_suppkey % 10 AS grp, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_discount >= 0.05),
p AS (SELECT DISTINCT l_suppkey % 10 AS grp, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_tax >= 0.04),
f AS (SELECT coalesce(g.grp, p.grp) AS grp, g.a IS NOT NULL AS ing, p.a IS NOT NULL AS inp FROM g FULL JOIN p ON g.grp = p.grp AND g.a = p.a AND g.b = p.b),
k AS (SELECT grp, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (inp AND NOT ing) AS fp, count(*) FILTER (ing AND NOT inp) AS fn FROM f GROUP BY grp)
SELECT grp, tp, fp, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM k""")
def j21_gold_pairs(t: Tables) -> DataFrame:
    pairs = lambda c: t.lineitem.where(c).select((F.col("l_suppkey") % 10).alias("grp"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return _round(P.compare_pairs(pairs("l_discount >= 0.05"), pairs("l_tax >= 0.04"), "grp"), 6)


@query("""WITH u AS (SELECT label, len(embedding) AS d, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-8)) AS e FROM embeddings),
f AS (SELECT label, unnest(range(len(e))) AS i, unnest(e) AS x FROM u), s AS (SELECT label, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM f GROUP BY 1, 2)
SELECT label, max(n) AS n, round(1 - (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1.0)), 6) AS diversity FROM s GROUP BY label""")
def v3_diversity(t: Tables) -> DataFrame:
    return _round(V.diversity(t.embeddings, ["label"]), 6)


@query("""WITH u AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-8)) AS e FROM embeddings),
f AS (SELECT label, unnest(range(len(e))) AS i, unnest(e) AS x FROM u), c AS (SELECT label, i, avg(x) AS m FROM f GROUP BY 1, 2)
SELECT a.label AS a, b.label AS b, round(1 - sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) AS distance FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""")
def v4_centroid_distance(t: Tables) -> DataFrame:
    c = V.centroids(t.embeddings, ["label"])
    a, b = c.select(F.col("label").alias("a"), F.col("centroid").alias("x")), c.select(F.col("label").alias("b"), F.col("centroid").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(V.centroid_distance(F.col("x"), F.col("y")), 6).alias("distance"))


_SIM = """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-8)) AS e FROM embeddings),
p AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e, b.e) AS s FROM u a JOIN u b ON a.vec_id < b.vec_id AND a.vec_id // 100 = b.vec_id // 100 AND a.label <> b.label WHERE list_dot_product(a.e, b.e) >= 0.2)
"""


def _surveys(t: Tables) -> DataFrame:
    """Every 100 vectors in a row are the sentences of one survey, so that surveys grow in number and not in size."""
    return t.embeddings.withColumn("g", F.floor(F.col("vec_id") / 100))


@query(_SIM + "SELECT i // 100 AS g, i, j, round(s, 6) AS similarity FROM p")
def j13_cross_pairs(t: Tables) -> DataFrame:
    return _round(P.similar_pairs(_surveys(t), "g", "vec_id", "label", at_least=0.2), 6)


@query(_SIM + """, d AS (SELECT i AS x, j AS y, s FROM p UNION ALL SELECT j, i, s FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS k FROM d)
SELECT DISTINCT x // 100 AS g, least(x, y) AS i, greatest(x, y) AS j, round(s, 6) AS similarity FROM r WHERE k <= 3""")
def w2_top_neighbours(t: Tables) -> DataFrame:
    pairs = P.similar_pairs(_surveys(t), "g", "vec_id", "label", at_least=0.2)
    return _round(P.top_neighbours(pairs, "g", 3), 6)


@query(_SIM + """, e AS (SELECT DISTINCT unnest([i, j]) AS s FROM p), r AS (SELECT s // 100 AS g, count(*) AS n FROM e GROUP BY 1), a AS (SELECT vec_id // 100 AS g, count(*) AS n FROM embeddings GROUP BY 1)
SELECT a.g, a.n AS n_sentences, coalesce(r.n, 0) AS n_repeated, round(coalesce(r.n, 0)::DOUBLE / a.n, 6) AS m_rep FROM a LEFT JOIN r ON r.g = a.g""")
def ag7_repetition(t: Tables) -> DataFrame:
    rows = _surveys(t)
    return _round(P.repetition_share(P.similar_pairs(rows, "g", "vec_id", "label", at_least=0.2), rows, "g"), 6)


@query("""WITH b AS (SELECT CASE WHEN l_discount * 10 >= 0.5 AND l_discount * 10 < 0.9 THEN l_discount * 10 END AS v FROM lineitem)
SELECT width, count(*) AS n FROM (SELECT CASE """ + " ".join(f"WHEN v >= {a!r}::DOUBLE AND v < {b!r}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(V.EDGES, V.EDGES[1:]))) + " END AS width FROM b) GROUP BY width")
def v9_similarity_buckets(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(V.similarity_bucket(F.col("l_discount") * 10).alias("width")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, i * 0.05::DOUBLE AS x, round(avg(exp(-0.5 * pow((i * 0.05::DOUBLE - v) / 0.05, 2))) / (0.05 * sqrt(2 * pi())), 6) AS density
FROM (SELECT o_orderstatus, o_totalprice / 500000 AS v FROM orders), (SELECT unnest(range(21)) AS i) GROUP BY o_orderstatus, i""")
def v11_kde(t: Tables) -> DataFrame:
    scaled = t.orders.select("o_orderstatus", (F.col("o_totalprice") / 500000).alias("v"))
    return V.kde(scaled, "v", ["o_orderstatus"], 0.05, 0.0, 1.0, 21).select("o_orderstatus", "x", F.round("density", 6).alias("density"))


@query("""WITH e AS (SELECT user_id, epoch(ts) AS s, epoch(ts) + value * 60 AS e FROM events WHERE value > 0),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e)
SELECT user_id, round(sum(greatest(e - greatest(s, coalesce(r, s)), 0)), 3) AS total FROM m GROUP BY user_id""")
def v13_interval_union(t: Tables) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    spans = t.events.where("value > 0").select("user_id", s.alias("s"), (s + F.col("value") * 60).alias("e"))
    return V.interval_union(spans, ["user_id"], "s", "e").select("user_id", F.round("total", 3).alias("total"))


@query("""SELECT least(floor((l_quantity - 0) / 5)::INT + 1, 10) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1""")
def v14_histogram(t: Tables) -> DataFrame:
    return V.histogram(t.lineitem, "l_quantity", 10, 0.0, 50.0)


@query("""SELECT o_custkey AS survey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'A' WHEN o_orderpriority = '2-HIGH' THEN 'B' WHEN o_orderpriority = '3-MEDIUM' THEN 'C' ELSE 'D' END AS category,
  count(*) AS n, round(count(*) FILTER (CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END)::DOUBLE / count(*), 6) AS cit_correct FROM orders GROUP BY 1, 2""")
def ag1_citation_correctness(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    claims = t.orders.select(
        F.col("o_custkey").alias("survey"),
        F.when(p == "1-URGENT", "A").when(p == "2-HIGH", "B").when(p == "3-MEDIUM", "C").otherwise("D").alias("category"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("supported"),
    )
    wide = G.citation_correctness(claims, ["survey"])
    rows = F.array(*(F.struct(F.lit(k).alias("category"), F.col(f"n_{k}").alias("n"), F.round(f"cit_correct_{k}", 6).alias("cit_correct")) for k in G.CATEGORIES))
    return wide.select("survey", F.inline(rows)).where("n > 0")


@query("""SELECT o_custkey AS survey, count(*) AS n_claims, round(avg((o_orderstatus = 'F')::INT::DOUBLE), 6) AS m_crit, round(avg((o_totalprice > 200000)::INT::DOUBLE), 6) AS m_comp_total,
  round(avg((o_orderstatus = 'O')::INT::DOUBLE), 6) AS m_open FROM orders GROUP BY 1""")
def ag4_expert_shares(t: Tables) -> DataFrame:
    claims = t.orders.select(
        F.col("o_custkey").alias("survey"), (F.col("o_orderstatus") == "F").alias("is_critical"), (F.col("o_totalprice") > 200000).alias("is_comparative"),
        (F.col("o_orderstatus") == "O").alias("is_open_question"), F.substring("o_orderpriority", 1, 1).cast("int").alias("modality_level"),
    )
    return _round(G.expert_profile(claims, ["survey"]), 6).select("survey", "n_claims", "m_crit", "m_comp_total", "m_open")


@query("""WITH c AS (SELECT o_custkey AS survey, substring(o_orderpriority, 1, 1)::INT AS k, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT survey, n::DOUBLE / sum(n) OVER (PARTITION BY survey) AS p FROM c)
SELECT survey, round(-sum(p * ln(p)) + 0.0, 6) AS m_mod FROM p GROUP BY survey""")
def ag5_modality_entropy(t: Tables) -> DataFrame:
    claims = t.orders.select(
        F.col("o_custkey").alias("survey"), *(F.lit(False).alias(c) for c in ("is_critical", "is_comparative", "is_open_question")),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("modality_level"),
    )
    return G.expert_profile(claims, ["survey"]).select("survey", F.round(F.col("m_mod") + 0.0, 6).alias("m_mod"))


@query("""SELECT c_mktsegment AS kind, round(avg(c_acctbal), 6) AS c_acctbal_avg, min(c_acctbal) AS c_acctbal_min, max(c_acctbal) AS c_acctbal_max FROM customer GROUP BY 1""")
def ag14_score_stats(t: Tables) -> DataFrame:
    return _round(G.score_stats(t.customer.withColumnRenamed("c_mktsegment", "kind"), ["kind"], ["c_acctbal"]))


@query("""SELECT l_orderkey AS claim, max(l_extendedprice) AS alignscore, arg_max(l_partkey, (l_extendedprice, -l_linenumber)) AS best_ref, max(l_extendedprice) >= 50000 AS supported FROM lineitem GROUP BY 1""")
def ag26_best_evidence(t: Tables) -> DataFrame:
    from surveyq.operators.models import best_evidence

    scored = t.lineitem.select(
        F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("idx"), F.col("l_linenumber").alias("pos"), F.col("l_extendedprice").alias("score")
    )
    return best_evidence(scored, ["claim"], 50000.0).select("claim", "alignscore", "best_ref", "supported")


@query("""SELECT conv_id, turn, role, n_attempts FROM (SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, role) AS n_attempts,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1""")
def ag27_last_attempts(t: Tables) -> DataFrame:
    log = t.conversations.select("conv_id", "role", F.col("turn").alias("attempt_idx"), "turn", "text")
    return G.last_attempts(log, ["conv_id", "role"]).select("conv_id", "turn", "role", "n_attempts")


@query("""SELECT conv_id, n_ok, text FROM (SELECT conv_id, count(*) AS n_ok, arg_min(text, turn) AS text FROM conversations WHERE length(text) > 100 GROUP BY conv_id) WHERE n_ok >= 2""")
def ag24_majority(t: Tables) -> DataFrame:
    runs = t.conversations.select("conv_id", F.col("turn").alias("completion_no"), "text", (F.length("text") > 100).alias("ok"))
    return G.majority(runs, ["conv_id"])


@query("""SELECT o_custkey, n_paid AS n_calls, n_cached, in_tokens, out_tokens, round(cost_usd, 6) AS cost_usd FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F') AS n_paid, count(*) FILTER (o_orderstatus = 'F') AS n_cached,
  coalesce(sum(length(o_orderpriority)) FILTER (o_orderstatus <> 'F'), 0)::BIGINT AS in_tokens, count(*) FILTER (o_orderstatus <> 'F') AS out_tokens, coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 0) AS cost_usd FROM orders GROUP BY 1)""")
def ag23_usage(t: Tables) -> DataFrame:
    from surveyq.operators.models import usage

    log = t.orders.select(
        "o_custkey", (F.col("o_orderstatus") == "F").alias("from_cache"), F.length("o_orderpriority").cast("long").alias("in_tokens"),
        F.lit(1).cast("long").alias("out_tokens"), F.col("o_totalprice").alias("cost_usd"),
    )
    return _round(usage(log, ["o_custkey"]))


@query("""SELECT o_custkey, round(sum(l_quantity * 1.25 + l_tax * 10) / 1e6, 9) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def v15_cost(t: Tables) -> DataFrame:
    cost = S.cost_usd(F.col("l_quantity"), F.col("l_tax"), 1.25, 10.0)
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.round(F.sum(cost), 9).alias("cost"))


@query("""SELECT k, row_number() OVER (ORDER BY TRY_CAST(k AS BIGINT) IS NULL, TRY_CAST(k AS BIGINT), k) AS r FROM (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer UNION ALL SELECT c_name FROM customer WHERE c_custkey <= 50)""")
def w6_numeric_then_text(t: Tables) -> DataFrame:
    keys = t.customer.select(F.col("c_custkey").cast("string").alias("k")).unionByName(t.customer.where("c_custkey <= 50").select(F.col("c_name").alias("k")))
    return M.numbered(keys, M.numeric_then_text(F.col("k")), "r").select("k", F.col("r").cast("long").alias("r"))


@query("SELECT doc_id FROM documents WHERE doc_id <= 100")
def sc2_up_to_id(t: Tables) -> DataFrame:
    return M.up_to_id(t.documents.select("doc_id"), "doc_id", 100)


@query("SELECT min(name) FILTER (p = (SELECT 0)) AS model FROM (SELECT upper(c_mktsegment) AS name, 0 AS p FROM customer UNION ALL SELECT lower(c_mktsegment), 1 FROM customer) GROUP BY lower(name)")
def sc12_model_names(t: Tables) -> DataFrame:
    a = t.customer.select(F.upper("c_mktsegment").alias("name"), F.lit(0).alias("priority"))
    return M.dedupe_models(a.unionByName(t.customer.select(F.lower("c_mktsegment").alias("name"), F.lit(1).alias("priority"))))


@query("SELECT date_trunc('hour', ts)::VARCHAR AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def ext_windowed_events(t: Tables) -> DataFrame:
    from surveyq.streaming.resume import windowed_counts

    counts = windowed_counts(t.events, "ts", "event_type", "value")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 6).alias("total"))
