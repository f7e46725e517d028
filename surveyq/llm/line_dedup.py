"""Line deduplication over levelled, sorted runs of line hashes.

A run is a table of line hashes and the document that holds each first,
bucketed and sorted by hash. A batch of documents is hashed, reduced to one row
per line, sorted once and merged with every run in the order in which both lie:
what no run holds is new and becomes a run of level 0. When a level has
`fanout` runs they are merged to one of the next level, so there are about
fanout * log(batches) runs. Runs stay in their folder if they are given one, and
a later job's batches meet them there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyq.llm.common import UNMARKED, Shelf, fresh, join_hot, remove, scratch, split_by_keys, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\f\r"
_FIRST_OF_ALL = -(1 << 63)
#: Lines of a batch for each bucket of its run, as far as the session's shuffle partitions go: a bucket is a task and a file.
BUCKET_LINES = 100_000

#: Session settings with which scans of bucketed tables read a bucket a task and tell its order, where a bucket is one file.
_WRITTEN_ORDER = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextmanager
def in_written_order(spark: SparkSession) -> Iterator[None]:
    """Runs are read bucket by bucket, and Spark doesn't sort them again."""
    before = {key: spark.conf.get(key) for key in _WRITTEN_ORDER}
    for key, value in _WRITTEN_ORDER.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


_RUN = "h1 BIGINT, h2 BIGINT, first BIGINT, last BIGINT, n BIGINT, seen BOOLEAN"


def _as_run(rows: DataFrame) -> DataFrame:
    return rows.select("h1", "h2", "first", F.col("first").alias("last"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("seen"))


class LineRuns:
    """Levelled runs of line hashes (h1, h2, first) in a folder.

    Without a path they lie under the shared folder and go on close(); with one
    they stay, and another LineRuns opens them again. A run is a folder
    level-<k>-<buckets>-<id> that gets this name when it is complete, and a
    merged run gets it before the runs in it go; a line that stands in two runs
    is as good as in one, so a job that dies at any point leaves valid runs.
    One job at a time may add to a folder. New runs have as many buckets as the
    last one found there, else `buckets`, the session's shuffle partitions at
    most; runs of other counts are read and merged like others, but shuffled.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, path: str | None = None, buckets: int | None = None):
        if fanout < 2:
            raise ValueError("fanout must be 2 or more")
        self.spark, self.fanout, self.keep = spark, fanout, path is not None
        self.root = (path or scratch(spark, "line-runs")).rstrip("/")
        self.parted = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = min(buckets or self.parted, self.parted)
        self.levels: list[list[str]] = []
        self._folders: dict[str, str] = {}  # table -> folder
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self.keep and self._fs.exists(self._path(self.root)):
            for found in sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(self.root))):
                part = found.split("-")
                if part[0] == "level":
                    self.buckets = int(part[2])
                    self._put(int(part[1]), self._table(found, self.buckets))

    def _table(self, folder: str, buckets: int) -> str:
        name = f"surveyq_run_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({_RUN}) USING parquet "
            f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS LOCATION '{self.root}/{folder}'"
        )
        self._folders[name] = folder
        return name

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _write(self, rows: DataFrame, level: int) -> str:
        """rows (of _RUN), which are parted by hash already, as a run of a level."""
        making, folder = f"making-{uuid.uuid4().hex}", f"level-{level}-{self.buckets}-{uuid.uuid4().hex}"
        write_buckets(rows, self.buckets, making.replace("-", "_"), f"{self.root}/{making}")
        self.spark.sql(f"DROP TABLE {making.replace('-', '_')}")
        self._fs.rename(self._path(f"{self.root}/{making}"), self._path(f"{self.root}/{folder}"))
        return self._table(folder, self.buckets)

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, f"{self.root}/{self._folders.pop(name)}")

    def _lines(self, name: str) -> DataFrame:
        """(h1, h2, first) of a run: its batch's lines but those that a run before it holds."""
        return self.spark.table(name).where("NOT seen").select("h1", "h2", "first")

    def tables(self) -> list[DataFrame]:
        return [self._lines(name) for level in self.levels for name in level]

    def marked(self, firsts: DataFrame) -> DataFrame:
        """firsts (h1, h2, ...) with seen: whether a run holds the line. One row a line; sorted once, for all runs."""
        if self.buckets != self.parted:  # one task a bucket, and so one file
            firsts = firsts.repartition(self.buckets, "h1", "h2")
        seen = F.lit(False)
        for k, run in enumerate(self.tables()):
            mark = f"run_{k}"
            held = run.select("h1", "h2", F.lit(True).alias(mark)).hint("merge")
            firsts = firsts.join(held, ["h1", "h2"], "left")
            seen = seen | F.col(mark).isNotNull()
        return firsts.withColumn("seen", seen).drop(*(f"run_{k}" for k in range(len(self.tables()))))

    def unseen(self, firsts: DataFrame) -> DataFrame:
        """Rows of firsts (h1, h2, ...) whose line is in no run."""
        return self.marked(firsts).where(~F.col("seen")).drop("seen")

    def take(self, firsts: DataFrame) -> DataFrame:
        """Meet firsts (h1, h2, first, last, n), a batch's lines, with all runs and make them a run of level 0.

        Returns them with seen, readable until the next compact(). What is seen
        lies in the run as well, so that a batch is written once; it doesn't
        count as the run's, and a merge leaves it out.
        """
        name = self._write(self.marked(firsts).select("h1", "h2", "first", "last", "n", "seen"), 0)
        self._put(0, name)
        return self.spark.table(name)

    def add(self, rows: DataFrame) -> DataFrame:
        """Add (h1, h2, first) as a run of level 0 and return it, readable until the next compact()."""
        name = self._write(_as_run(rows), 0)
        self._put(0, name)
        return self._lines(name)

    def compact(self) -> None:
        """Merge the runs of every full level into one of the next, in the order in which they lie."""
        k = 0
        while k < len(self.levels):
            if len(self.levels[k]) >= self.fanout:
                merged, *rest = (self._lines(n) for n in self.levels[k])
                for one in rest:
                    one = one.withColumnRenamed("first", "other").hint("merge")
                    merged = merged.join(one, ["h1", "h2"], "full").select("h1", "h2", F.least("first", "other").alias("first"))
                name = self._write(_as_run(merged), k + 1)
                for old in self.levels[k]:
                    self._forget(old)
                self.levels[k] = []
                self._put(k + 1, name)
            k += 1

    def close(self) -> None:
        """Forget the tables, and delete runs that have no folder of their own."""
        for name in self._folders:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._folders, self.levels = {}, []
        if not self.keep:
            remove(self.spark, self.root)

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def write_buckets(rows: DataFrame, buckets: int, name: str, path: str) -> DataFrame:
    """rows as a table bucketed and sorted by (h1, h2). Rows that aren't parted by them yet are shuffled: a bucket is one file then."""
    rows.write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").options(path=path, **UNMARKED).format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def line_key(line: Column) -> Column:
    """A line's key: A-Z lowered, [\\x20\\x09-\\x0D] stripped at both ends."""
    return F.btrim(F.translate(line, _UPPER, _LOWER), F.lit(_SPACE))


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, ord, mark, pos) of every line whose key has min_chars or more: a 128-bit hash, its row and place."""
    lines = docs.select(
        "ord", "mark", F.posexplode(F.split(F.translate(F.col("body"), _UPPER, _LOWER), "\n")).alias("pos", "line")
    ).select("ord", "mark", "pos", F.btrim(F.col("line"), F.lit(_SPACE)).alias("k"))
    return lines.where(F.char_length("k") >= min_chars).select(
        F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), F.col("k")).alias("h2"), "ord", "mark", "pos"
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2, runs: str | None = None
) -> DataFrame:
    """Every text without the lines that a document of smaller id holds.

    Keys (line_key) of min_chars code points or more that stand in two or more
    documents lose all lines except in the document of smallest id; lines that
    repeat inside one document stay. Documents are taken in `batches` ranges of
    the id, smallest first. Returns docs with the text replaced, and
    line_count (before dropping) and lines_dropped.

    runs is a folder whose runs stay for later calls; documents of an earlier
    call go before all of this one, whatever their ids.

    Texts that may lose a line are told from the others by a bit table and are
    the only ones that are shuffled, to meet the places of their lines.

    A null or empty text is one empty line and stays empty. A null id counts
    as smaller than every other; rows of one id are one document, and each
    keeps its own text. Ids are integers. Extra columns of any name pass
    through, but for line_count and lines_dropped, which are replaced. An
    empty table gives none.
    """
    spark = docs.sparkSession
    docs = docs.drop("line_count", "lines_dropped")
    order, body, mark, gone = fresh(docs.columns, "order", "body", "mark", "gone")
    with_row = docs.withColumns(
        {
            order: F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_OF_ALL).cast("long")),
            body: F.coalesce(F.col(text_col), F.lit("")),
        }
    ).withColumn(mark, F.xxhash64(body))
    with Shelf(spark) as shelf:
        places = _dropped(shelf, with_row.select(F.col(order).alias("ord"), F.col(mark).alias("mark"), F.col(body).alias("body")), min_chars, batches, fanout, runs)
        per_row = stored(
            places.groupBy("ord", "mark").agg(F.sort_array(F.collect_set("pos")).alias(gone)).withColumnsRenamed({"ord": order, "mark": mark}), "dropped-lines"
        )
    # the bit table outlives this call, as the result reads it
    touched, whole = split_by_keys(Shelf(spark), with_row, per_row, [order, mark])
    all_lines = F.split(F.col(body), "\n")
    # the places that stay, in order: linear in the lines
    stays = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(gone))
    lines, = fresh([*docs.columns, order, body, mark, gone], "lines")
    kept = F.array_join(F.transform(stays, lambda i: F.get(F.col(lines), i)), "\n")
    cut = touched.join(per_row, [order, mark], "left").withColumn(lines, all_lines).withColumns(
        {
            text_col: F.when(F.col(gone).isNull(), F.col(body)).otherwise(kept),
            "line_count": F.size(lines).cast("long"),
            "lines_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
        }
    )
    breaks = F.octet_length(body) - F.octet_length(F.replace(F.col(body), F.lit("\n"), F.lit("")))
    same = whole.withColumns({text_col: F.col(body), "line_count": (breaks + 1).cast("long"), "lines_dropped": F.lit(0).cast("long")})
    names = [*docs.columns, "line_count", "lines_dropped"]
    return cut.select(*names).unionByName(same.select(*names))


def _dropped(shelf: Shelf, rows: DataFrame, min_chars: int, batches: int, fanout: int, path: str | None) -> DataFrame:
    """(ord, mark, pos) of every line that goes, of rows (ord, mark, body)."""
    spark = shelf.spark
    lines = shelf.stored(_hashed_lines(rows, min_chars), "lines")
    # the cuts only balance the batches; any cuts give the same rows
    wanted = [i / batches for i in range(1, batches)]
    cuts, total = lines.agg(F.percentile_approx("ord", wanted, 1000) if wanted else F.lit(None), F.count(F.lit(1))).head()
    edges = [None, *sorted(set(cuts or [])), None]
    gone = []
    with LineRuns(spark, fanout, path, 1 + total // (len(edges) - 1) // BUCKET_LINES) as runs, in_written_order(spark):
        for low, high in zip(edges, edges[1:]):
            batch = lines
            if low is not None:
                batch = batch.where(F.col("ord") > low)
            if high is not None:
                batch = batch.where(F.col("ord") <= high)
            firsts = batch.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("n"))
            keys = runs.take(firsts)
            # a key that a run holds stood in an earlier batch: all its lines here go
            doomed = keys.where("seen OR first < last").select("h1", "h2", F.when(~F.col("seen"), F.col("first")).alias("first"), "n")
            hit = join_hot(batch, doomed, ["h1", "h2"], "n", total).where(F.col("first").isNull() | (F.col("ord") > F.col("first")))
            gone.append(shelf.stored(hit.select("ord", "mark", "pos"), "gone"))
            if runs.keep or high is not None:
                runs.compact()
    dropped = gone[0]
    for more in gone[1:]:
        dropped = dropped.unionByName(more)
    return dropped
