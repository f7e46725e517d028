"""Score formulas as Column builders and small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(n: Column, total: Column) -> Column:
    """n / total; null where total is 0 or null."""
    return F.when(total > 0, n.cast("double") / total)


def zero_div(n: Column, total: Column) -> Column:
    return F.coalesce(share(n, total), F.lit(0.0))


def precision(tp: Column, fp: Column) -> Column:
    return zero_div(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return zero_div(tp, tp + fn)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = precision(tp, fp), recall(tp, fn)
    return zero_div(2 * p * r, p + r)


def entropy(counts: Column) -> Column:
    """Shannon entropy in nats of an array of counts; 0 for none."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return F.when(
        total > 0,
        F.aggregate(
            F.filter(counts, lambda x: x > 0), F.lit(0.0), lambda s, x: s - (x.cast("double") / total) * F.ln(x.cast("double") / total)
        ),
    ).otherwise(0.0)


def confusion(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """A row for each true class and a column for each predicted one; rows with another class count nowhere."""
    inside = df.where(F.col(truth).isin(classes) & F.col(predicted).isin(classes))
    return inside.groupBy(truth).pivot(predicted, classes).agg(F.count(F.lit(1))).na.fill(0)


def class_scores(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """class, tp, fp, fn, support, precision, recall, f1 of each class, in one pass; a missing prediction misses."""
    hits = [
        F.struct(
            F.lit(c).alias("class"),
            ((F.col(truth) == c) & F.col(predicted).eqNullSafe(F.lit(c))).cast("long").alias("tp"),
            ((F.col(truth) != c) & F.col(predicted).eqNullSafe(F.lit(c))).cast("long").alias("fp"),
            ((F.col(truth) == c) & ~F.col(predicted).eqNullSafe(F.lit(c))).cast("long").alias("fn"),
        )
        for c in classes
    ]
    sums = df.select(F.inline(F.array(*hits))).groupBy("class").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))
    return with_prf(sums.withColumn("support", F.col("tp") + F.col("fn")))


def with_prf(df: DataFrame) -> DataFrame:
    """df with precision, recall and f1 of its tp, fp and fn."""
    tp, fp, fn = (F.col(x) for x in ("tp", "fp", "fn"))
    return df.withColumns({"precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def radar(df: DataFrame, by: str, value: str) -> DataFrame:
    """df with `scaled`: value over the largest of its metric; a largest of 0 or less counts as 1."""
    from pyspark.sql.window import Window

    top = F.max(value).over(Window.partitionBy(by))
    return df.withColumn("scaled", F.col(value) / F.when(top > 0, top).otherwise(1.0))


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Prices are per million tokens."""
    return (F.coalesce(tokens_in, F.lit(0)) * price_in + F.coalesce(tokens_out, F.lit(0)) * price_out) / 1e6


def win_rate(win: Column, tie: Column, lose: Column) -> Column:
    """(wins + ties / 2) over all decided; 0 for none."""
    return zero_div(win + tie * 0.5, win + tie + lose)


def verdict_by_scores(a: Column, b: Column, margin: float = 1.0) -> Column:
    """win, lose or tie by the difference of two mean scores on 0..100; unknown without both."""
    return F.when(a.isNull() | b.isNull(), "unknown").when(a - b > margin, "win").when(b - a > margin, "lose").otherwise("tie")


def verdict_by_votes(a: Column, b: Column, tie: Column) -> Column:
    """The side with strictly more calls than both others, else tie; unknown without calls."""
    return (
        F.when(a + b + tie == 0, "unknown").when((a > b) & (a > tie), "win").when((b > a) & (b > tie), "lose").otherwise("tie")
    )


def supported(score: Column, threshold: float = 0.5) -> Column:
    """Three-valued: null stays null."""
    return score >= threshold
