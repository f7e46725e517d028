"""Exact quantiles of groups of any size.

percentile() holds all distinct values of a group in one buffer. Here only groups
of few values are done so. In larger ones the values at the wanted ranks are
selected: a pass counts the values of the range that holds a rank in BINS
equal bins, and the range becomes the bin's least and largest value, until these
are one. The largest buffer is a bin's count, and no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyq.operators.scans import fresh
from surveyq.session import kept

#: Bins of a range in each pass, and values of a group from which on they are used.
BINS, LARGE = 8192, 1_000_000
#: A group is large only if it has more than this share of all values, so there are fewer large groups than its inverse.
SHARE = 1 / 10_000


def summarised(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], *aggregates: Column, large: int = LARGE) -> DataFrame:
    """by, the aggregates and the exact quantiles of value, as groupBy().agg() with percentile() gives them, null groups included.

    Quantiles are interpolated as percentile() does; null values don't count, NaN is the largest. Without a group of more than
    `large` values it is one aggregate; else df is read again for the others, so it should be cheap to read.
    """
    plain = [F.percentile(value, F.lit(p)).alias(name) for name, p in quantiles.items()]
    n, = fresh(df.columns, "n_values")
    sizes = df.groupBy(*by).agg(F.count(value).alias(n))
    total, most = sizes.agg(F.sum(n), F.max(n)).head()
    limit = max(large, int((total or 0) * SHARE))
    if (most or 0) <= limit:
        return df.groupBy(*by).agg(*aggregates, *plain)
    if not by:
        every, = fresh(df.columns, "every")
        return summarised(df.withColumn(every, F.lit(0)), [every], value, quantiles, *aggregates, large=large).drop(every)
    # fewer than 1 / SHARE rows
    hot = kept(sizes.where(F.col(n) > limit).drop(n), "large-groups")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    of_hot = lambda how: df.alias("r").join(F.broadcast(hot.alias("h")), same("r", "h"), how)
    small = of_hot("left_anti").groupBy(*by).agg(*aggregates, *plain)
    chosen = select_quantiles(of_hot("left_semi").select(*by, value), by, value, quantiles)
    others = of_hot("left_semi").groupBy(*by).agg(*aggregates)
    full = others.alias("o").join(chosen.alias("q"), same("o", "q")).select("o.*", *(f"q.{name}" for name in quantiles))
    return small.unionByName(full)


def select_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], bins: int = BINS) -> DataFrame:
    """by and the exact quantiles of each group that has a value, by passes of counting; no group is one over all rows.

    A pass makes ranges BINS times smaller, so values of one scale take two or three and
    values over many orders of magnitude more.
    """
    if not by:
        every, = fresh(df.columns, "every")
        return select_quantiles(df.withColumn(every, F.lit(0)), [every], value, quantiles, bins).drop(every)
    inner = [f"g{i}" for i in range(len(by))]
    rows = kept(df.where(F.col(value).isNotNull()).select(*(F.col(c).alias(g) for c, g in zip(by, inner)), F.col(value).cast("double").alias("v")), "values")
    finite = ~F.isnan("v") & (F.abs("v") < float("inf"))
    sizes = kept(rows.groupBy(*inner).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == float("-inf")).alias("below"), F.count_if(finite).alias("inside"),
        F.count_if(F.col("v") == float("inf")).alias("above"), F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi"),
    ), "sizes")
    at = {name: (F.col("n") - 1) * F.lit(p) for name, p in quantiles.items()}
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in at.values()))))
    rank = F.col("rank")
    ends = F.when(rank < F.col("below"), float("-inf")).when(rank < F.col("below") + F.col("inside"), None).when(rank < F.col("below") + F.col("inside") + F.col("above"), float("inf")).otherwise(float("nan"))
    wanted = sizes.select("*", F.explode(ranks).alias("rank")).select(*inner, "rank", F.coalesce(ends, F.col("lo")).alias("lo"), F.coalesce(ends, F.col("hi")).alias("hi"), F.col("below").alias("ahead"))
    wanted = kept(wanted, "ranks")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in inner]
    while not wanted.where("lo < hi").isEmpty():
        # ranges of a group are apart or the same, so a value is in one at most; a few rows for each large group
        open_ = wanted.where("lo < hi").select(*inner, "lo", "hi").distinct()
        within = rows.alias("r").join(F.broadcast(open_.alias("w")), [*same("r", "w"), F.col("v").between(F.col("lo"), F.col("hi"))]).select("r.*", "lo", "hi")
        half = lambda c: F.col(c) / 2  # noqa: E731  so that no difference overflows
        bin_ = F.least(F.floor((half("v") - half("lo")) / (half("hi") - half("lo")) * bins), F.lit(bins - 1))
        counted = within.groupBy(*inner, "lo", "hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("c").over(Window.partitionBy(*inner, "lo", "hi").orderBy("bin"))  # over at most `bins` rows
        ladder = counted.withColumn("upto", upto)
        narrowed = wanted.where("lo < hi").alias("w").join(
            ladder.alias("l"),
            [*same("w", "l"), F.col("w.lo") == F.col("l.lo"), F.col("w.hi") == F.col("l.hi"), rank - F.col("ahead") < F.col("upto"), rank - F.col("ahead") >= F.col("upto") - F.col("c")],
        ).select(*(f"w.{c}" for c in inner), "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("ahead") + F.col("upto") - F.col("c")).alias("ahead"))
        wanted = kept(wanted.where("NOT lo < hi").unionByName(narrowed), "ranks")
    values = wanted.groupBy(*inner).agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("values"))

    def interpolated(x: Column) -> Column:
        low, high = (F.element_at("values", f(x)) for f in (F.floor, F.ceil))
        return F.when((F.floor(x) == F.ceil(x)) | (low == high), low).otherwise((F.ceil(x) - x) * low + (x - F.floor(x)) * high)

    joined = sizes.alias("s").join(values.alias("x"), same("s", "x"))
    return joined.select(*(F.col(f"s.{g}").alias(c) for c, g in zip(by, inner)), *(interpolated(x).alias(name) for name, x in at.items()))
