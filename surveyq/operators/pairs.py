"""Similar pairs inside a group: blocked matrix products, top-k neighbours and what is counted over them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyq.operators.scans import ranked

#: Rows of a block; two blocks and their product are held at once.
BLOCK = 1024


def similar_pairs(
    df: DataFrame, group: str, key: str, part: str | None, vector: str = "embedding", at_least: float = 0.6, block: int = BLOCK
) -> DataFrame:
    """(group, i, j, similarity) of all pairs of a group with cosine >= at_least, i < j, whose part differs.

    Rows of a group are dealt into blocks by a hash of the key, and each two
    blocks meet in one task as a matrix product, so a large group is many
    tasks and none holds it whole. Keys are unique in a group; part None
    compares all pairs. Rows without a vector are in no pair.
    """
    kinds = dict(df.dtypes)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    rows = df.where(F.col(vector).isNotNull()).join(sizes, group)
    parts = F.ceil(F.col("__n") / block).cast("int")
    mine = F.pmod(F.xxhash64(key), parts).cast("int")
    meets = F.transform(
        F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least(mine, o).alias("a"), F.greatest(mine, o).alias("b"))
    )
    side = F.col(part).cast("string") if part else F.lit(None).cast("string")
    placed = rows.select(
        F.col(group).alias("g"), F.col(key).alias("k"), F.coalesce(side, F.lit("")).alias("p"), F.col(vector).alias("v"),
        mine.alias("m"), F.explode(meets).alias("c"),
    ).select("g", "k", "p", "v", "m", "c.a", "c.b")

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-8)
        m, k, p = pdf["m"].to_numpy(), pdf["k"].to_numpy(), pdf["p"].to_numpy()
        a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
        left, right = np.flatnonzero(m == a), np.flatnonzero(m == b)
        sims = x[left] @ x[right].T
        i, j = np.nonzero(sims >= at_least)
        li, rj = left[i], right[j]
        keep = (p[li] != p[rj]) if part else np.ones(len(i), bool)
        keep &= k[li] < k[rj] if a == b else k[li] != k[rj]
        li, rj, s = li[keep], rj[keep], sims[i[keep], j[keep]]
        swap = k[li] > k[rj]
        li, rj = np.where(swap, rj, li), np.where(swap, li, rj)
        return pd.DataFrame({"g": np.repeat(pdf["g"].iloc[:1].to_numpy(), len(s)), "i": k[li], "j": k[rj], "similarity": s})

    out = placed.groupBy("g", "a", "b").applyInPandas(products, f"g {kinds[group]}, i {kinds[key]}, j {kinds[key]}, similarity double")
    return out.withColumnRenamed("g", group)


def top_neighbours(pairs: DataFrame, group: str, k: int, at_least: float | None = None) -> DataFrame:
    """Pairs that are among the k best of either end, by similarity and then the smaller neighbour."""
    kept = pairs if at_least is None else pairs.where(F.col("similarity") >= at_least)
    both = kept.select(group, F.col("i").alias("x"), F.col("j").alias("y"), "similarity").unionByName(
        kept.select(group, F.col("j").alias("x"), F.col("i").alias("y"), "similarity")
    )
    rank = F.row_number().over(Window.partitionBy(group, "x").orderBy(F.desc("similarity"), "y"))
    best = both.withColumn("r", rank).where(F.col("r") <= k)
    return best.select(group, F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "similarity").distinct()


def by_similarity(pairs: DataFrame, group: str, name: str = "place") -> DataFrame:
    """pairs with their place in their group, from 1: most similar first, then by i and j. No group is in one task."""
    return ranked(pairs, [group], [F.desc("similarity"), "i", "j"], name)


def repetition_share(duplicates: DataFrame, sentences: DataFrame, group: str) -> DataFrame:
    """group, n_sentences, n_repeated, m_rep: sentences in some duplicate pair over all; 0 with fewer than two."""
    ends = duplicates.select(group, F.explode(F.array("i", "j")).alias("s")).distinct()
    hit = ends.groupBy(group).agg(F.count(F.lit(1)).alias("n_repeated"))
    totals = sentences.groupBy(group).agg(F.count(F.lit(1)).alias("n_sentences"))
    n = F.coalesce("n_repeated", F.lit(0))
    return totals.join(hit, group, "left").select(
        group, "n_sentences", n.alias("n_repeated"),
        F.when(F.col("n_sentences") >= 2, n / F.col("n_sentences")).otherwise(0.0).alias("m_rep"),
    )


def all_pairs_of(ids: DataFrame, group: str, record: str, values: str) -> DataFrame:
    """(group, a, b): all unordered pairs of the values of each record, once. Records are short lists of ids."""
    pairs = F.flatten(
        F.transform(F.col(values), lambda a: F.transform(F.col(values), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))
    )
    return ids.select(group, F.explode(F.filter(pairs, lambda p: p["a"] != p["b"])).alias("p")).select(group, "p.a", "p.b").distinct()


def compare_pairs(gold: DataFrame, predicted: DataFrame, group: str) -> DataFrame:
    """group, tp, fp, fn, precision, recall, f1 of unordered pairs (a, b)."""
    from surveyq.functions.scores import with_prf

    norm = lambda df, flag: df.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn(flag, F.lit(1))
    both = norm(gold, "g").join(norm(predicted, "p"), [group, "a", "b"], "full")
    g, p = F.col("g").isNotNull(), F.col("p").isNotNull()
    return with_prf(both.groupBy(group).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn")))


def micro(scores: DataFrame) -> DataFrame:
    """One row: sums over all groups and their scores."""
    from surveyq.functions.scores import with_prf

    return with_prf(scores.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))


def one_per_bucket(pairs: DataFrame, bucket: str, seed: int, *keys: str) -> DataFrame:
    """One pair of each bucket, by a seeded hash of its keys: MD5 of seed and keys, joined by |."""
    w = Window.partitionBy(bucket).orderBy(F.md5(F.concat_ws("|", F.lit(seed), *keys)), *keys)
    return pairs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def top_chunks(chunks: DataFrame, claims: list[str], score: str, k: int, pos: str = "pos", text: str = "chunk", join: str = "\n\n") -> DataFrame:
    """claims, text: the k best chunks of each claim and reference, in document order."""
    w = Window.partitionBy(*claims).orderBy(F.desc(score), pos)
    best = chunks.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(text).alias("t"))))
    return best.groupBy(*claims).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), join).alias("text"))


