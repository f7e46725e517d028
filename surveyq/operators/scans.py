"""Running aggregates over ordered groups, without a group in one task.

A window over a group sorts all of it in one task. Here rows are dealt by
ranges of (group, order), so that a large group is many ranges; each range runs
on its own, and what the ranges before it add to a group is carried over. Only
groups that cross a border carry anything: at most one for each range.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from surveyq.session import scratch_folder

#: Kind -> aggregate of rows, and how what was before joins what is here.
KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "count": (F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def fresh(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened until none is among names; Spark's names differ by more than case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Fixed value: rows that one task takes of a table that is dealt by its count.
PER_TASK = 1 << 18


def dealt(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df by the hash of columns, in more partitions the more rows there are, so that what a task holds doesn't grow; a few rows are left to the session."""
    n = -(-rows // PER_TASK)
    return df.repartition(*by) if n <= 1 else df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by)


def spread(df: DataFrame, by: str, most: int = 1 << 22) -> DataFrame:
    """df as it is where the session's shuffle partitions take at most so many rows each, else dealt by a column into more, for a join on it that may sort."""
    n = -(-df.count() // most)
    return df if n <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(n, by)


def running(df: DataFrame, group: list[str], order: list[Column | str], values: dict[str, tuple[str, Column | str]], before: bool = False) -> DataFrame:
    """df with a running aggregate of each group in an order: values is name -> (sum, count, min or max; column).

    A row's value covers the rows of its group up to it, or with `before` those
    ahead of it. Rows that are equal in group and order share a range and
    come in any order, so a group of very many such rows is to be counted
    first. Null groups are a group; no group is one over all rows. The rows are
    written once under the shared folder.
    """
    spark = df.sparkSession
    part, lo, hi, every = fresh([*df.columns, *values], "part", "lo", "hi", "every")
    group, rows = (group, df) if group else ([every], df.withColumn(every, F.lit(0)))
    inputs = dict(zip(values, fresh([*rows.columns, *values, part, lo, hi, every], *(f"in_{n}" for n in values))))
    carried = dict(zip(values, fresh([*rows.columns, *values, *inputs.values(), part, lo, hi, every], *(f"carry_{n}" for n in values))))
    rows = rows.withColumns({inputs[n]: F.col(c) if isinstance(c, str) else c for n, (_, c) in values.items()})
    w = Window.partitionBy(part, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    dealt = rows.repartitionByRange(*(F.col(c) for c in group), *order).withColumn(part, F.spark_partition_id())
    path = scratch_folder(spark, "running")
    dealt.withColumns({n: KINDS[kind][0](inputs[n]).over(w) for n, (kind, _) in values.items()}).write.parquet(path)
    here = spark.read.parquet(path)
    key = F.struct(*group)
    # from here on a row or two a range
    edges = here.select(part, *group).distinct().groupBy(part).agg(F.min(key).alias(lo), F.max(key).alias(hi))
    crossing = edges.select(lo, F.lag(hi).over(Window.orderBy(part)).alias(hi)).where(F.col(lo).eqNullSafe(F.col(hi))).select(f"{lo}.*").distinct()
    same = lambda other: [F.col(f"h.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in group]
    own = here.alias("h").join(F.broadcast(crossing.alias("c")), same("c"), "left_semi").groupBy(part, *group).agg(
        *(KINDS[kind][0](inputs[n]).alias(carried[n]) for n, (kind, _) in values.items())
    )
    ahead = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = own.select(part, *group, *((F.sum if kind == "count" else KINDS[kind][0])(carried[n]).over(ahead).alias(carried[n]) for n, (kind, _) in values.items()))
    joined = here.alias("h").join(F.broadcast(carry.alias("c")), [F.col(f"h.{part}") == F.col(f"c.{part}"), *same("c")], "left")
    return joined.select(
        *(F.col(f"h.{c}") for c in df.columns if c not in values),
        *(KINDS[kind][1](F.col(f"c.{carried[n]}"), F.col(f"h.{n}")).alias(n) for n, (kind, _) in values.items()),
    )


def ranked(df: DataFrame, group: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with the place of each row in its group, from 1: row_number without a group in one task."""
    return running(df, group, order, {name: ("count", F.lit(1))})
