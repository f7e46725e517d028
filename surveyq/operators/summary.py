"""Summaries of long metric tables: latest runs, statistics, pivots, paired deltas.

A long table has (dataset, model, kind, survey_id, metric, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyq.operators.quantiles import summarised
from surveyq.session import scratch_folder


def as_metric(column: Column) -> Column:
    """A value as a double: booleans as 0 and 1, NaN and what is no number as null."""
    text = column.cast("string")
    number = F.when(F.lower(text) == "true", 1.0).when(F.lower(text) == "false", 0.0).otherwise(text.try_cast("double"))
    return F.nullif(number, F.lit(float("nan")))


def to_long(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: the listed columns as rows."""
    return wide.select(*keys, *(as_metric(F.col(m)).alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")


def expand_metrics(names: list[str]) -> list[str]:
    """Requested metric names with the compound one written out, in order, once."""
    parts = {"rouge_bleu": ["rouge1", "rouge2", "rougeL", "bleu"]}
    return list(dict.fromkeys(p for n in names for p in parts.get(n, [n])))


def latest_runs(runs: DataFrame, by: list[str], recency: str, tie: str) -> DataFrame:
    """The newest run of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc(recency), F.desc(tie))
    return runs.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def distinct_runs(runs: DataFrame, by: list[str], recency: str) -> DataFrame:
    """Runs without repeats of a key, newest first."""
    return runs.groupBy(*by).agg(F.max(recency).alias(recency)).orderBy(F.desc(recency), *by)


def metric_summary(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, n, mean, std_sample, std_pop, min, q25, median, q75, max; groups of null keys stay, null values don't count."""
    quarters = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    return summarised(
        long, by, value, quarters, F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_sample"), F.stddev_pop(value).alias("std_pop"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ).select(*by, "n", "mean", "std_sample", "std_pop", "min", *quarters, "max")


def paired_delta(long: DataFrame, a: str, b: str, model: str = "model", on: tuple[str, ...] = ("survey_id", "metric"), value: str = "value") -> DataFrame:
    """on, value_a, value_b, delta = b - a, for surveys that both models have. One pass, no self-join."""
    side = lambda m, name: F.max(F.when(F.col(model) == m, F.col(value))).alias(name)
    both = long.where(F.col(model).isin(a, b) & F.col(value).isNotNull()).groupBy(*on).agg(side(a, "value_a"), side(b, "value_b"))
    return both.where("value_a IS NOT NULL AND value_b IS NOT NULL").withColumn("delta", F.col("value_b") - F.col("value_a"))


def delta_summary(deltas: DataFrame, by: list[str], delta: str = "delta") -> DataFrame:
    """by, n, mean, std_pop, min, q10, q25, median, q75, q90, max, share_up and share_down in percent."""
    share = lambda test: 100 * F.avg(test.cast("int").cast("double"))
    d, levels = F.col(delta), {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    return summarised(
        deltas, by, delta, levels, F.count(delta).alias("n"), F.avg(delta).alias("mean"), F.stddev_pop(delta).alias("std_pop"), F.min(delta).alias("min"),
        F.max(delta).alias("max"), share(d > 0).alias("share_up"), share(d < 0).alias("share_down"),
    ).select(*by, "n", "mean", "std_pop", "min", *levels, "max", "share_up", "share_down")


def wide_means(long: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """by and a mean for each listed metric."""
    return long.groupBy(*by).pivot("metric", metrics).agg(F.avg("value"))


def shared_surveys(long: DataFrame, models: list[str], model: str = "model") -> DataFrame:
    """(survey_id): surveys that every listed model has."""
    return long.where(F.col(model).isin(models)).groupBy("survey_id").agg(F.count_distinct(model).alias("n")).where(F.col("n") == len(models)).select("survey_id")


def category_shares(counts: DataFrame, model: str = "model") -> DataFrame:
    """model, category, share_of_claims, share_of_counted, support_rate: means over surveys.

    counts(model, survey_id, category, n, n_supported, n_claims). The two
    shares divide by the survey's claims and by the sum of its categories.
    """
    total = F.sum("n").over(Window.partitionBy(model, "survey_id"))
    rate = lambda a, b: F.when(b > 0, a / b)
    per = counts.withColumn("total", total)
    return per.groupBy(model, "category").agg(
        F.avg(rate(F.col("n"), F.col("n_claims"))).alias("share_of_claims"), F.avg(rate(F.col("n"), F.col("total"))).alias("share_of_counted"),
        F.avg(rate(F.col("n_supported"), F.col("n"))).alias("support_rate"),
    )


def modality_mix(levels: DataFrame, model: str = "model") -> DataFrame:
    """model, level, share: each survey's levels as shares, then their mean. levels(model, survey_id, level, n)."""
    total = F.sum("n").over(Window.partitionBy(model, "survey_id"))
    return levels.withColumn("t", total).where("t > 0").groupBy(model, "level").agg(F.avg(F.col("n") / F.col("t")).alias("share"))


def dedupe_models(named: DataFrame) -> DataFrame:
    """(model): names that differ in case alone once, in the spelling of smallest priority. named(name, priority)."""
    return named.groupBy(F.lower("name").alias("__k")).agg(F.min_by("name", F.struct("priority", "name")).alias("model")).select("model")


def sample_rows(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """k rows, the same for the same seed: those of smallest MD5 of seed and keys, joined by |. A top-k, not a full sort."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *keys)), *keys).limit(k)


def numeric_then_text(column: Column) -> list[Column]:
    """Sort keys: numbers first, by value, then the rest by text."""
    n = column.try_cast("bigint")
    return [n.isNull().asc(), n.asc(), column.asc()]


def first_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of an order: a top-k, not a full sort."""
    return df.orderBy(*order).limit(n)


def of_systems(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows whose system is listed, whatever the case; no list means all."""
    return df.where(F.lower(column).isin([w.lower() for w in wanted])) if wanted else df


def up_to_id(df: DataFrame, column: str, limit: int) -> DataFrame:
    """Rows whose id is a number not above limit; ids that are no number go."""
    return df.where(F.col(column).try_cast("bigint") <= limit)


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with the place of each row in an order over all rows, from 1.

    A range partition, sorted and written once; a row's place is its place in
    its partition and the rows of the partitions before. No task holds more
    than its range. Rows of one sort key share a partition.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, "numbered")
    # partition and place in it are the two halves of the id
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumns({"__part": F.shiftright("__id", 33), "__in": F.col("__id").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row a partition
    before = sizes.select("__part", (F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("__before"))
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__in") + 1).drop("__id", "__part", "__in", "__before")
