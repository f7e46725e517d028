"""Shared folder, Arrow text buffers and word hashing used by several operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by the vectorised word scanner.
SLICE_BYTES = 2 << 20
_BLOCK = 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the setting is absent a temporary folder is made once and set, if all
    of Spark is one machine (tests); a cluster has to name its folder.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="surveyq-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return context.getCheckpointDir() or where


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/surveyq-{label}-{uuid.uuid4().hex}"


#: Session settings for rows of long texts: rows that a Parquet scan and an Arrow batch hold at once. Spark's own defaults are made for narrow rows.
BATCH_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1024")}


def tuned(spark: SparkSession) -> SparkSession:
    """The session with BATCH_ROWS, as far as it still has Spark's defaults."""
    for key, (default, better) in BATCH_ROWS.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, better)
    return spark


#: Writer options of all intermediate tables: nobody waits for their marker files.
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}

#: Writer options for rows of up to some MB: Parquet looks at the size of its pages and row groups after each few rows, not first after a hundred.
LARGE_ROWS = {
    "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "64",
    "parquet.block.size.row.check.min": "4", "parquet.block.size.row.check.max": "64",
    "parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false",
}


def stored(df: DataFrame, label: str, path: str | None = None, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and is computed once."""
    spark = df.sparkSession
    path = path or scratch(spark, label)
    df.write.options(**UNMARKED, **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Shelf:
    """Intermediate tables of one job under the shared folder; they go when the job ends, however it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = tuned(spark), []

    def path(self, label: str) -> str:
        self.paths.append(scratch(self.spark, label))
        return self.paths[-1]

    def stored(self, df: DataFrame, label: str, **options: str) -> DataFrame:
        return stored(df, label, self.path(label), **options)

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def fresh(names: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, lengthened until none is among names; Spark's names differ by more than case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Most keys that join_hot broadcasts.
HOT_KEYS = 100_000


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined with keyed, which has one row for each key and in column n the number of rows of that key.

    Keys with more than total / HOT_KEYS of all rows are fewer than HOT_KEYS,
    whatever the data, so these are broadcast and their rows are not shuffled;
    all other keys are small enough for a shuffle by key. rows and keyed are
    read twice, so both should be cheap to read.
    """
    hot = F.broadcast(keyed.where(F.col(n) > total / HOT_KEYS))
    cold = keyed.where(F.col(n) <= total / HOT_KEYS)
    rest = rows.join(hot.select(*on), on, "left_anti")
    return rows.join(hot, on).unionByName(rest.join(cold, on))


#: Longs of a bit table, so it has 2^26 bits at most.
BIT_WORDS = 1 << 20


def split_by_keys(shelf: Shelf, rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows whose key may be among keys, and those whose key surely isn't; neither is shuffled.

    Each key sets one bit of a table of BIT_WORDS longs, which is broadcast:
    16 MB at most, whatever the keys. Rows with a bit that isn't set pass by.
    With many more keys than bits all rows may match, and nothing is lost but
    time. rows are read twice.
    """
    bit, = fresh(rows.columns, "bit")
    word, bits = fresh([*rows.columns, bit], "word", "bits")
    hashed = F.xxhash64(*on)
    numbered = lambda df, *more: df.select(*more, hashed.bitwiseAND(63).cast("int").alias(bit), F.shiftrightunsigned(hashed, 6).bitwiseAND(BIT_WORDS - 1).alias(word))
    table = shelf.stored(
        numbered(keys).groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias(bits)).coalesce(1), "bits"
    )
    marked = numbered(rows, *rows.columns).join(F.broadcast(table), word, "left")
    there = F.expr(f"coalesce(getbit({bits}, {bit}), 0) = 1")
    return marked.where(there).select(*rows.columns), marked.where(~there).select(*rows.columns)


def without(shelf: Shelf, rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """rows whose key is not among keys; only rows that may match are shuffled."""
    maybe, others = split_by_keys(shelf, rows, keys, on)
    return maybe.join(keys, on, "left_anti").select(*rows.columns).unionByName(others)


@dataclass
class Texts:
    """UTF-8 bytes of consecutive texts: text i is data[bounds[i]:bounds[i + 1]]; nulls are empty."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, offsets, values = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return Texts(data[bounds[0] : bounds[-1]], bounds - bounds[0])


def slices(lengths: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive runs of rows whose lengths sum to about `most`; every row is in one run."""
    ends = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _table(word: bytes) -> bytes:
    """Translation that lower-cases A-Z and turns every byte outside `word` into a space."""
    inside = set(word)
    return bytes(
        (b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in inside else 32
        for b in range(256)
    )


#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered: digits, a-z and all bytes of non-ASCII characters.
ALNUM = _table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Words of [^\x20\x09-\x0D]+ after A-Z are lowered.
SOLID = _table(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_P, _BLOCK), _powers(_P_INV, _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of several texts in order: byte range, 64-bit hash, and first[i]: index of text i's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    lowered: np.ndarray


def words_of(texts: Texts, table: bytes) -> Words:
    """All words of all texts, hashed with a polynomial over their bytes.

    Memory is a few times the bytes of `texts`; callers pass slices of about
    SLICE_BYTES, and a longer single text only costs its own size.
    """
    low = np.frombuffer(texts.data.tobytes().translate(table), np.uint8)
    n = len(low)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64), low)
    inside = low != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = texts.bounds[:-1]
    edge = edge[edge < n]
    first[edge] = inside[edge]
    edge = edge[edge > 0] - 1
    last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(start), np.uint64)
    i, k = 0, len(start)
    while i < k:
        base = start[i]
        j = int(np.searchsorted(end, base + _BLOCK, "right"))
        if j <= i:  # one word longer than a block
            hashes[i] = _long_hash(low[base : end[i]])
            i += 1
            continue
        m = int(end[j - 1] - base)
        sums = np.empty(m + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_POW[:m] * (low[base : base + m].astype(np.uint64) + np.uint64(1)), out=sums[1:])
        s = start[i:j] - base
        hashes[i:j] = (sums[end[i:j] - base] - sums[s]) * _INV[s]
        i = j
    hashes = mix(hashes)
    return Words(start, end, hashes, np.searchsorted(start, texts.bounds), low)


def _long_hash(piece: np.ndarray) -> np.uint64:
    total, scale = np.zeros(1, np.uint64), np.ones(1, np.uint64)
    step = _POW[-1:] * _P
    for a in range(0, len(piece), _BLOCK):
        part = piece[a : a + _BLOCK].astype(np.uint64) + np.uint64(1)
        total += scale * np.sum(_POW[: len(part)] * part, dtype=np.uint64)
        scale = scale * step
    return total[0]


def word_hash(word: str) -> int:
    """The hash that words_of gives to this word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(mix(np.array([_long_hash(data)], np.uint64))[0])


def give_back() -> None:
    """In a worker: free Arrow memory goes back to the system, as Arrow's own pools keep it and workers live as long as their executor."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())


def with_text_batches(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Each Arrow batch in slices of about SLICE_BYTES of text, with the text's bytes."""
    give_back()
    for batch in batches:
        whole = texts_of(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(np.diff(whole.bounds)):
            lo, hi = whole.bounds[a], whole.bounds[b]
            yield batch.slice(a, b - a), Texts(whole.data[lo:hi], whole.bounds[a : b + 1] - lo)
