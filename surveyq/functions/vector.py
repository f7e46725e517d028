"""Vector columns (array<float>) and distribution functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-8


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length, at least 1e-8."""
    return F.greatest(F.sqrt(dot(v, v)), F.lit(FLOOR))


def unit(v: Column) -> Column:
    return F.element_at(F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def _sums(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """by, n, s (the sum of the unit vectors) and q (of their squared lengths): one buffer a group and task before the shuffle, no row a dimension."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    units = df.where(F.col(vector).isNotNull()).select(*by, unit(F.col(vector)).alias("u"))
    found = units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.sum(array_to_vector("u")).alias("s"), F.sum(dot(F.col("u"), F.col("u"))).alias("q")
    )
    return found.withColumn("s", vector_to_array("s"))


def diversity(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Mean pairwise cosine distance of each group; null for fewer than two vectors.

    No pairs are formed: over unit vectors u, the sum of all u_i . u_j with
    i <> j is |sum u|^2 - sum |u|^2.
    """
    n = F.col("n").cast("double")
    spread = 1 - (dot(F.col("s"), F.col("s")) - F.col("q")) / (n * (n - 1))
    return _sums(df, by, vector).select(*by, "n", F.when(F.col("n") >= 2, spread).alias("diversity"))


def centroids(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """by, n, centroid: the mean of the unit vectors of each group."""
    return _sums(df, by, vector).select(*by, "n", F.transform("s", lambda x: x / F.col("n")).alias("centroid"))


def centroid_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two centroids; null where one is missing or shorter than 1e-8."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na >= FLOOR) & (nb >= FLOOR), 1 - dot(a, b) / (na * nb))


def distribution_shift(sample: DataFrame, target: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """by, distribution_shift: distance of each group's centroid in sample from its centroid in target."""
    a, b = centroids(sample, by, vector), centroids(target, by, vector).withColumnRenamed("centroid", "other").drop("n")
    return a.join(b, by, "left").select(*by, centroid_distance(F.col("centroid"), F.col("other")).alias("distribution_shift"))


def pca_dots(fit_on: DataFrame, also: DataFrame, key: str, vector: str = "embedding", k: int = 2) -> tuple[DataFrame, list[float]]:
    """Coordinates of two sets in the first k components of the first, and the variance they explain.

    The set's mean is subtracted before the transform. Signs are arbitrary.
    The fit is distributed; the driver gets the means and the k components.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    # one number for each dimension: the only other thing that the driver gets
    means = fit_on.select(F.posexplode(doubles(F.col(vector))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    middle = F.array(*(F.lit(float(r["m"])) for r in means))

    def centred(df: DataFrame, group: str) -> DataFrame:
        v = array_to_vector(F.zip_with(doubles(F.col(vector)), middle, lambda x, m: x - m))
        return df.select(key, F.lit(group).alias("group"), v.alias("v"))

    first = centred(fit_on, "reference")
    model = PCA(k=k, inputCol="v", outputCol="p").fit(first)
    dots = model.transform(first.unionByName(centred(also, "generated"))).withColumn("p", vector_to_array("p"))
    return dots.select(key, "group", *(F.col("p")[i].alias("xyz"[i]) for i in range(k))), [float(x) for x in model.explainedVariance]


#: Edges of the similarity buckets, 0.5 to 0.9 in steps of 0.04.
EDGES = tuple(0.5 + 0.04 * i for i in range(11))


def similarity_bucket(sim: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """Index of the left-closed bucket, null outside; a value over the last edge is outside."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        out = F.when((sim >= edges[i]) & (sim < edges[i + 1]), i).otherwise(out)
    return out


def bucket_counts(df: DataFrame, sim: str, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """bucket, n: how many similarities fall into each bucket; those outside all under a null bucket."""
    return df.groupBy(similarity_bucket(F.col(sim), edges).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def kde(df: DataFrame, value: str, by: list[str], bandwidth: float = 0.025, low: float = 0.0, high: float = 1.0, points: int = 101) -> DataFrame:
    """by, x, density: Gaussian kernel density of value on a grid of `points` places."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * ((high - low) / (points - 1))))
    z = (F.col("x") - F.col("v")) / bandwidth
    return (
        df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"), grid.alias("x"))
        .groupBy(*by, "x").agg((F.avg(F.exp(-0.5 * z * z)) / (bandwidth * math.sqrt(2 * math.pi))).alias("density"))
    )


def interval_union(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """by, total: the length that intervals [start, end) of a group cover together.

    The running end of a group comes from ranges with carry, so a group of very many intervals is many tasks.
    """
    from surveyq.operators.scans import fresh, running

    reach, = fresh([*by, start, end], "reach")
    spans = df.where(F.col(end) > F.col(start)).select(*by, start, end).distinct()
    # what an interval adds is its part past everything before it
    added = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce(F.col(reach), F.col(start))), F.lit(0))
    return running(spans, by, [start, end], {reach: ("max", end)}, before=True).groupBy(*by).agg(F.sum(added).alias("total"))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """bin (from 1), n: counts of equal bins of [low, high], the last closed."""
    b = F.when(F.col(value) == high, bins).otherwise(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)))
    return df.where(F.col(value).between(low, high)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
